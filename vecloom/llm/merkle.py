"""Merkle fingerprints of documents in DataFrame functions only (operator 9, native).

A text is cut into sections (after a blank line), these into paragraphs (lines) and these into chunks,
cut behind pairs of bytes that a fixed rule picks, in any script, hence the same after an edit elsewhere.
A paragraph's node is the SHA-256 of its bytes, a section's that of its paragraphs' nodes, the root that
of the sections' nodes; below a paragraph are its leaves, a short hash and the size of each chunk. Roots
test equality, and differing branches locate an edit. The fingerprint string holds the whole tree, so the
likeness of two texts follows from their fingerprints alone: from differing roots down, branches that are
equal at their place are paired off, and below the others equal leaves are, once for each time they occur.

Defined results: ids are whole numbers; null is the empty text; equal texts have equal fingerprints; two
empty texts have likeness 1; equal rows get equal results, but for the last of a run of them, whose next row
differs; null ids come after all others; texts of any length are whole, so a fingerprint grows with its text
(some 12 characters for 45 bytes); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Chunks are LEAST to MOST bytes of UTF-8, one character a byte, and end where a pair of bytes says so.
LEAST, MOST = 24, 128


def _bytes(factor: int, shift: int) -> str:
    """A character class of 60 of the 256 bytes, spread by a rule over all of them, hence over all scripts."""
    return "[" + "".join(f"\\x{b:02X}" for b in range(256) if (b * factor + shift) % 256 < 60) + "]"


CHUNK = rf"(?s).{{{LEAST},{MOST - 2}}}?{_bytes(157, 11)}{_bytes(89, 101)}|(?s).{{1,{MOST}}}"
#: Rows are dealt in blocks of about BLOCK neighbouring ids, at most BLOCKS of them.
BLOCK, BLOCKS = 2048, 16_384


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(text: Column, mark: str, last: Column) -> Column:
    """The text cut behind each mark; the end of it gets `last` instead. Joined, the pieces are text and last; empty ones are left out."""
    ends = lambda p: F.transform(p, lambda x, i: F.concat(x, F.when(i < F.size(p) - 1, F.lit(mark)).otherwise(last)))
    return F.filter(_with(F.split(text, mark), ends), lambda x: x != "")


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def _leaf(chunk: Column) -> Column:
    """32 bits of the chunk's hash and, in the lowest 8, its bytes."""
    return F.shiftleft(F.xxhash64(chunk).bitwiseAND(F.lit(0xFFFFFFFF)), 8).bitwiseOR(F.length(chunk).cast("long"))


def branches(text: Column) -> Column:
    """Sections: node and paragraphs; paragraphs: node and leaves.

    A paragraph's node is the SHA-256 of its bytes, a section's that of its paragraphs' nodes.
    """
    raw = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    paragraph = lambda p: F.struct(F.sha2(p, 256).alias("node"), F.transform(F.regexp_extract_all(p, F.lit(CHUNK), F.lit(0)), _leaf).alias("leaves"))
    section = lambda ps: F.struct(_node(ps["node"]).alias("node"), ps.alias("paragraphs"))

    def sections(parts):
        return F.transform(parts, lambda s, i: _with(F.transform(_pieces(s, "\n", F.when(i < F.size(parts) - 1, F.lit("\n\n")).otherwise(F.lit(""))), paragraph), section))

    # A section of nothing but its two line ends is a section; only an empty end is left out.
    return F.filter(_with(F.split(raw, "\n\n"), sections), lambda s: F.size(s["paragraphs"]) > 0)


def root_of(sections: Column) -> Column:
    return _node(sections["node"])


def tree(text: Column) -> Column:
    """Struct of root, sections (nodes) and paragraphs (nodes by section)."""
    return _with(branches(text), lambda x: F.struct(root_of(x).alias("root"), x["node"].alias("sections"), F.transform(x, lambda s: s["paragraphs"]["node"]).alias("paragraphs")))


def _total(leaves: Column) -> Column:
    """Bytes of some leaves."""
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(255)))


def spelled(sections: Column) -> Column:
    """root,size:section;section... with section = node,size=paragraph/paragraph..., paragraph = node,size-leaf.leaf...

    The root's node is whole; sections and paragraphs show 16 digits of theirs, leaves are in hexadecimal.
    """
    of = lambda node, leaves: F.concat(node, F.lit(","), _total(leaves).cast("string"))
    paragraph = lambda p: F.concat(of(F.substring(p["node"], 1, 16), p["leaves"]), F.lit("-"), F.array_join(F.transform(p["leaves"], F.hex), "."))
    section = lambda s: F.concat(of(F.substring(s["node"], 1, 16), F.flatten(s["paragraphs"]["leaves"])), F.lit("="), F.array_join(F.transform(s["paragraphs"], paragraph), "/"))
    return F.concat(of(root_of(sections), _leaves(sections)), F.lit(":"), F.array_join(F.transform(sections, section), ";"))


def _leaves(sections: Column) -> Column:
    return F.flatten(F.flatten(F.transform(sections, lambda s: s["paragraphs"]["leaves"])))


def fingerprint(text: Column) -> Column:
    """The whole tree as a string."""
    return _with(branches(text), spelled)


def parsed(text: Column) -> Column:
    """Paragraphs (16 digits of their nodes, and leaves) of a fingerprint."""
    full = lambda c, mark: F.filter(F.split(c, mark), lambda x: x != "")
    paragraphs = F.flatten(F.transform(full(F.substring_index(text, ":", -1), ";"), lambda s: full(F.substring_index(s, "=", -1), "/")))
    leaf = lambda x: F.conv(x, 16, 10).cast("long")
    return F.transform(paragraphs, lambda p: F.struct(F.substring_index(p, ",", 1).alias("node"), F.transform(full(F.substring_index(p, "-", -1), r"\."), leaf).alias("leaves")))


def _numbered(leaves: Column) -> Column:
    """The leaves; of equal ones, all but the first are changed by their number (their size stays). In time in proportion to a sort."""

    def runs(s):
        first = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        again = lambda x, k: F.shiftleft(F.xxhash64(x, k), 8).bitwiseOR(x.bitwiseAND(F.lit(255)))
        return _with(first, lambda h: F.flatten(F.transform(h, lambda b, j: F.transform(
            F.sequence(b, F.coalesce(F.get(h, j + 1), F.size(s)) - 1), lambda i: F.when(i == b, F.get(s, b)).otherwise(again(F.get(s, b), i - b))))))

    # Most texts repeat nothing.
    return _with(leaves, lambda n: F.when(F.size(F.array_distinct(n)) == F.size(n), n).otherwise(_with(F.sort_array(n), runs)))


def common(a: Column, b: Column) -> Column:
    """Share of the larger text's bytes that two lists of paragraphs have in common.

    Branches with equal nodes at their place are paired off; below those that differ, equal leaves are, each as often as both have it.
    """
    differ = lambda x, y: F.flatten(F.filter(x, lambda p, i: ~F.get(y, i)["node"].eqNullSafe(p["node"]))["leaves"])
    size = lambda x: _total(F.flatten(x["leaves"]))

    def part(n):
        lost = _with(F.struct(_numbered(differ(n["a"], n["b"])).alias("x"), _numbered(differ(n["b"], n["a"])).alias("y")), lambda r: _total(F.array_except(r["x"], r["y"])))
        return _with(size(n["a"]), lambda s: (s - lost) / F.greatest(s, size(n["b"])))

    return F.coalesce(_with(F.struct(a.alias("a"), b.alias("b")), part).cast("double"), F.lit(0.0))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two texts from their fingerprints alone: 1 for equal roots, else what their branches have in common."""
    same = F.substring_index(a, ",", 1) == F.substring_index(b, ",", 1)
    return F.when(same, F.lit(1.0)).otherwise(common(parsed(a), parsed(b)))


def _alike(a: Column, b: Column) -> Column:
    """The same from the trees that the fingerprints spell."""
    cut = lambda t: F.flatten(F.transform(t, lambda s: F.transform(s["paragraphs"], lambda p: F.struct(F.substring(p["node"], 1, 16).alias("node"), p["leaves"].alias("leaves")))))
    return F.when(a["node"] == b["node"], F.lit(1.0)).otherwise(common(cut(a), cut(b)))


def differing(a: Column, b: Column) -> Column:
    """Positions (section, paragraph) whose nodes differ between two trees, descending only below differing sections."""
    n = F.greatest(F.size(a["sections"]), F.size(b["sections"]))
    sections = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ~F.get(a["sections"], i).eqNullSafe(F.get(b["sections"], i)))

    def below(i):
        p, q = (F.coalesce(F.get(t["paragraphs"], i), F.array().cast("array<string>")) for t in (a, b))
        last = F.greatest(F.size(p), F.size(q), F.lit(1)) - 1
        return F.transform(F.filter(F.sequence(F.lit(0), last), lambda j: ~F.get(p, j).eqNullSafe(F.get(q, j))), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    return F.when(a["root"] == b["root"], F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.flatten(F.transform(sections, below)))


def _located(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with at and h, by which they are put in order, and block: a number that falls as they go on.

    Quantiles of the ids, one small row, cut them into blocks of about BLOCK rows whatever their spacing. An id (or null)
    that fills several blocks by itself is split by the hash of the text.
    """
    rows = rows.withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn("h", F.xxhash64("text"))
    n = min(BLOCKS, rows.count() // BLOCK + 1)
    shares = [i / n for i in range(n)]
    cuts = rows.agg(F.sort_array(F.percentile_approx("at", shares, 4 * max(n, 1000))).alias("q"))
    edges = F.array_distinct(F.concat(F.array(F.lit(-(1 << 63)).cast("long")), F.col("q")))
    # A block's edge and how many quantiles fall on it, in chunks of 128 for a search in two steps.
    wide = _with(edges, lambda e: F.transform(e, lambda x: F.struct(x.alias("edge"), F.size(F.filter("q", lambda y: y == x)).alias("many"))))
    cuts = cuts.where("q is not null").select(wide.alias("e"))
    cuts = cuts.select(F.transform(F.sequence(F.lit(0), F.floor((F.size("e") - 1) / 128).cast("int")), lambda i: F.slice("e", i * 128 + 1, F.lit(128))).alias("parts"))
    cuts = cuts.withColumn("starts", F.transform("parts", lambda p: F.get(p, F.lit(0))["edge"]))
    both = rows.join(F.broadcast(cuts))  # one row of at most BLOCKS numbers
    i = F.size(F.filter("starts", lambda x: x <= F.col("at"))) - 1
    both = both.withColumn("i", i).withColumn("part", F.get("parts", F.col("i"))).withColumn("j", F.size(F.filter("part", lambda x: x["edge"] <= F.col("at"))) - 1)
    both = both.withColumn("e", F.get("part", F.col("j")))
    many = F.col("e.many")
    place = F.least(many - 1, F.floor((F.col("h").cast("double") / float(1 << 63) + 1) / 2 * many))
    sub = F.when((many > 1) & (F.col("e.edge") == F.col("at")), place).otherwise(many)
    return both.select("doc_id", "text", "at", "h", (F.shiftleft((F.col("i") * 128 + F.col("j")).cast("long"), 20) + sub.cast("long")).alias("block"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, tree (branches), and next_text, next_tree: those of the next row in descending doc_id; the last row's next is the first.

    Rows are dealt in blocks by quantiles of their ids, each block looks ahead on its own, and blocks pass on their first
    rows. Rows with equal ids follow each other in descending order of their texts' hashes; null ids come last.
    """
    rows = _located(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = [F.desc("at"), F.desc("h"), F.desc("text")]
    own = rows.withColumn("x", F.struct("text", branches(F.col("text")).alias("tree")))
    inside = own.select("doc_id", "at", "h", "text", "block", "x").withColumn("y", F.lead("x").over(W.partitionBy("block").orderBy(*order)))
    first = rows.groupBy("block").agg(F.max_by(F.col("text"), F.struct("at", "h", "text")).alias("head"))
    # One small row a block: let each point to the one after it.
    blocks = rows.select("block").distinct()
    ends = W.orderBy(F.desc("block"))
    after = blocks.select(F.col("block").alias("to_block"), F.lag("block").over(ends).alias("block"))
    top = blocks.agg(F.max("block").alias("to_block"), F.min("block").alias("block"))
    links = after.where("block is not null").unionByName(top.where("block is not null"))
    heads = links.join(first.withColumnRenamed("block", "to_block"), "to_block").select("block", F.struct(F.col("head").alias("text"), branches(F.col("head")).alias("tree")).alias("head"))
    both = inside.join(heads, "block", "left").withColumn("y", F.coalesce("y", "head"))
    return both.select("doc_id", "text", "x.tree", F.col("y.text").alias("next_text"), F.col("y.tree").alias("next_tree"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness to each other and to the next text's."""
    df = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    df = df.select("doc_id", "n_chars", F.sha2(edited, 256).alias("edited_sha256"), "tree", branches(edited).alias("edited"), "next_tree")
    return df.select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("tree")).alias("fingerprint"), spelled(F.col("edited")).alias("edited_fingerprint"),
        _alike(F.col("tree"), F.col("edited")).alias("near_edited"), _alike(F.col("tree"), F.col("next_tree")).alias("near_next"),
    )


def op9_merkle(spark, sf_dir):
    from ._common import read_documents

    return fingerprints(read_documents(spark, sf_dir))
