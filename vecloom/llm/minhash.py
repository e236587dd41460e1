"""Near-duplicate components by a signature-coordinate inverted join (operator 4).

Each distinct shingle set has a MinHash signature of COORDS coordinates and is posted under its
(coordinate, value) pairs. Two sets of the wanted similarity agree on at least MATCHES coordinates, but
for a chance of about 1e-6. So it is enough to post a set under its COORDS - MATCHES + 1 rarest pairs
(prefix), and the long lists of common pairs are skipped: they are only counted, by comparing whole
signatures of the candidates that the short lists give. What has MATCHES collisions is confirmed on the
full shingle sets.

Copies never meet each other: equal sets are one class. The members of a posting list belong to the
group of its pivot, the member whose signature collides most over all lists, which is the centre of a
group of near copies. Signatures are counted against the pivot's, and those that differ from it against
the whole group's, in blocks. Members that collide often enough with any other are confirmed on full
sets: first with the pivot; then what is outside the pivot's component meets all likely members of the
group in blocks. A task holds at most about BLOCK sets in an index and streams as many past it. It
returns only links that join components, so a group gives rows in proportion to its size, and no link
is lost.

Defined results: null and blank texts have an empty set and are linked with nothing; a text with fewer
words than a shingle has one shingle, its whole sequence; rows with a null id are linked with nothing
and kept; rows that repeat an id count as one document, which has the links of all its texts, each row
with the set size of its own text; texts of any length are whole; ties of pivots go to the larger id and
change no result; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, free_name, read_documents
from ._packed import squeeze, unsqueeze
from ._text import U64, Words, chunks, mix, pair_hash, to_bytes, trim
from .components import components
from .pieces import spread

COORDS = 64
#: With 64 coordinates and similarity 0.8, fewer than 35 agree with probability 1.2e-6.
MATCHES = 35
#: Most sets that a task holds in its index.
BLOCK = 4096
#: Up to so many ids are broadcast (some dozen MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles."""
    w = Words(texts)
    rolled = w.hash
    for k in range(1, n):
        rolled = pair_hash(rolled[: len(w.hash) - k], w.hash[k:]) if len(w.hash) > k else rolled[:0]
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            h = w.hash[a : a + 1]
            for x in range(a + 1, b):
                h = pair_hash(h, w.hash[x : x + 1])
            out.append(mix(h + U64(b - a)))
        else:
            out.append(w.hash[:0])
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), sig (32-bit values by coordinate) and code (their low bytes)."""
    rng = np.random.default_rng(41)
    factors = rng.integers(0, 1 << 63, COORDS, dtype=np.uint64) * U64(2) + U64(1)
    terms = rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)

    def run(batches):
        for b in batches:
            texts = to_bytes(b.column(1))
            for lo, hi in chunks(texts, 1 << 20):
                sets = shingle_sets(texts[lo:hi], n)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                sig = np.zeros((len(sets), COORDS), np.uint32)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    for c in range(COORDS):
                        low = np.minimum.reduceat(flat * factors[c] + terms[c], starts)
                        sig[full, c] = low >> U64(32)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * COORDS, pa.int32()), pa.array(sig.ravel().view(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(sizes), pa.array(digests, pa.binary()), lists, pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], names=["doc_id", "n_shingles", "digest", "sig", "code"])
                trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, sig array<int>, code binary")


def postings(reps: DataFrame) -> DataFrame:
    """key, rep, weight: each set under the rarest of its pairs that others share; weight counts all its collisions."""
    posts = reps.select("rep", F.posexplode("sig").alias("c", "v"))
    posts = posts.select("rep", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    shared = posts.groupBy("key").count().where("count > 1")
    mine = posts.join(shared, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("count", "key"))).alias("keys"), F.sum("count").alias("weight"))
    # Pairs that no other set has are the rarest; they use up their part of the prefix.
    room = F.lit(COORDS - MATCHES + 1 - COORDS) + F.size("keys")
    return mine.where(room > 0).select("rep", "weight", F.explode(F.slice("keys", F.lit(1), room)).alias("k")).select(F.col("k.key").alias("key"), "rep", "weight")


def likely(owned: DataFrame, reps: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """a, rep, near: the members of each pivot's group that collide often enough with the pivot (near) or with another member.

    owned: a (pivot), rep. Only signature bytes travel here, so that texts are fetched for likely members alone.
    """
    kind = owned.schema["rep"].dataType.simpleString()
    code = reps.select("rep", "code", F.col("n_shingles").alias("n"))
    both = owned.join(code, "rep").join(code.toDF("a", "code_a", "n_a"), "a").select("a", "rep", "n", "code", "n_a", "code_a")

    def agree(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, COORDS) for k in (3, 5))
            n, m = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            near = ((x == y).sum(1) >= MATCHES) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(near)], names=["a", "rep", "code", "near"])

    met = checkpointed(both.mapInArrow(agree, f"a {kind}, rep {kind}, code binary, near boolean"))
    dealt = deal(met.withColumn("out", ~F.col("near")), ["code"], block)

    def partners(batches):
        name, ids, held = None, [], []
        for b in batches:
            found: set = set()
            for a, i, j, role, rep, code in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if name != (a, i, j):
                    name, ids, held, table = (a, i, j), [], [], None
                if role == 0:
                    ids.append(rep)
                    held.append(code)
                    continue
                if table is None:
                    table = np.frombuffer(b"".join(held), np.uint8).reshape(-1, COORDS)
                hit = np.flatnonzero((table == np.frombuffer(code, np.uint8)).sum(1) >= MATCHES).tolist()
                hit = [ids[k] for k in hit if ids[k] != rep]
                if hit:
                    found.update((a, x) for x in (rep, *hit))
            found = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], b.schema.types[4]) for k in (0, 1)], names=["a", "rep"])

    others = dealt.mapInArrow(partners, f"a {kind}, rep {kind}").distinct()
    return checkpointed(met.where("near").select("a", "rep", "near").unionByName(others.join(met.where("near"), ["a", "rep"], "left_anti").withColumn("near", F.lit(False))))


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    # Texts come compressed; the pivot's set is kept while its pairs go by.
    with_texts = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        held, own = None, None
        for batch in batches:
            keep = []
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                if x != held:
                    held, own = x, shingle_sets([unsqueeze(x)], n)[0]
                other = shingle_sets([unsqueeze(y)], n)[0]
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(other) - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            trim()

    kind = pairs.schema["a"].dataType.simpleString()
    return with_texts.mapInArrow(run, f"a {kind}, b {kind}")


def member_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """rep and text (compressed) of the members."""
    few = members.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([squeeze(t) for t in to_bytes(b.column(1))], pa.binary())], names=["rep", "text"])

    rows = docs.select(F.col("doc_id").alias("rep"), "text").join(F.broadcast(members) if few else members, "rep", "left_semi")
    return rows.mapInArrow(run, f"rep {kind}, text binary").dropDuplicates(["rep"])


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (rep, comp) after the components at both ends of each link (a, b) have become one."""
    ends = links.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    labels = components(ends)
    return checkpointed(comp.join(labels.toDF("comp", "label"), "comp", "left").select("rep", F.coalesce("label", "comp").alias("comp")))


def deal(member: DataFrame, carry: list[str], block: int, extra: DataFrame | None = None) -> DataFrame:
    """Blocks of what is out of its group (role 0) with all members streamed past (role 1), in order of role.

    member: a, rep, out and what is carried. Both the blocks and the streams of a group hold about `block` rows.
    """
    size = member.groupBy("a").agg(F.count_if("out").alias("outs"), F.count("*").alias("all")).where("outs > 0 and all > 1")
    size = size.select("a", F.ceil(F.col("outs") / block).cast("int").alias("blocks"), F.ceil(F.col("all") / block).cast("int").alias("streams"))
    part = lambda count, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    sized = member.join(size, "a")
    held = sized.where("out").select("a", part("blocks", 1).alias("i"), every("streams").alias("j"), F.lit(0).alias("role"), "rep", *carry)
    passing = sized.select("a", every("blocks").alias("i"), part("streams", 2).alias("j"), F.lit(1).alias("role"), "rep", *carry)
    dealt = held.unionByName(passing)
    if extra is not None:
        dealt = dealt.join(extra, "rep").select("a", "i", "j", "role", "rep", *carry, *(c for c in extra.columns if c != "rep"))
    return dealt.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j", "role", "rep")


def open_links(member: DataFrame, comp: DataFrame, texts: DataFrame, n: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between components that share a pivot's group; member: a, rep (pivots have met their groups already)."""
    now = member.select("a", "rep").join(comp, "rep").join(comp.toDF("a", "comp_a"), "a")
    dealt = deal(now.select("a", "rep", "comp", (F.col("comp") != F.col("comp_a")).alias("out")), ["comp"], block, texts)

    def run(batches):
        block_now = None
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in range(6)), map(unsqueeze, b.column(6).to_pylist()), strict=True))
            found = []
            for lo, hi in chunks([r[6] for r in rows], 1 << 20):
                for (a, i, j, role, rep, c, _), own in zip(rows[lo:hi], shingle_sets([r[6] for r in rows[lo:hi]], n), strict=True):
                    if block_now is None or block_now.name != (a, i, j):
                        block_now = Block((a, i, j))
                    if role == 0:
                        block_now.hold(rep, c, own)
                    else:
                        found += block_now.match(rep, c, own, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], b.schema.types[4]) for k in (0, 1)], names=["a", "b"])

    kind = member.schema["rep"].dataType.simpleString()
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


class Block:
    """Held sets in an index of shingles; sets that pass are counted against all of them at once."""

    def __init__(self, name: tuple):
        self.name = name
        self.ids, self.comps, self.sets, self.index = [], [], [], None
        self.parent: dict = {}

    def hold(self, rep, comp, own: np.ndarray) -> None:
        self.ids.append(rep)
        self.comps.append(comp)
        self.sets.append(own)

    def root(self, c):
        while (up := self.parent.setdefault(c, c)) != c:
            self.parent[c] = c = self.parent[up]
        return c

    def match(self, rep, comp, own: np.ndarray, percent: int) -> list[tuple]:
        """Links of a passing set with held ones, only where they join components that this task has not joined yet."""
        if self.index is None:
            sizes = np.array([len(s) for s in self.sets], np.int64)
            flat = np.concatenate(self.sets) if self.sets else np.zeros(0, U64)
            order = np.argsort(flat, kind="stable")
            keys = flat[order]
            head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            self.index = (keys[head], np.append(head, len(keys)), np.repeat(np.arange(len(sizes)), sizes)[order], sizes)
        keys, edges, who, sizes = self.index
        if not len(keys):
            return []
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        at = at[keys[at] == own]
        common = np.bincount(who[spread(edges[at], edges[at + 1] - edges[at])], minlength=len(sizes))
        out = []
        for k in np.flatnonzero(100 * common >= percent * (sizes + len(own) - common)).tolist():
            x, y = self.root(self.comps[k]), self.root(comp)
            if x != y:
                self.parent[x] = y
                out.append((self.ids[k], rep))
        return out


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) and kept of each row."""
    sigs = checkpointed(signatures(docs, n))
    several = sigs.where("doc_id is not null and digest is not null").groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
    if not several.isEmpty():
        return _of_repeated_ids(docs, n, percent)
    return _near_duplicates(docs, sigs, n, percent)


def _of_repeated_ids(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The same where some id has several texts: each text is linked on its own, and the texts of an id are one document."""
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", key.alias("key"), "text")
    alone = rows.where("key is not null").select(F.col("key").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    found = checkpointed(_near_duplicates(alone, checkpointed(signatures(alone, n)), n, percent).select(F.col("doc_id").alias("key"), "n_shingles", F.col("component_id").alias("comp")))
    named = rows.select("doc_id", "key").join(found, "key")
    first = named.groupBy("doc_id").agg(F.min("comp").alias("a"))
    labels = components(named.join(first, "doc_id").select("a", F.col("comp").alias("b")))
    joined_up = checkpointed(named.join(labels.toDF("comp", "label"), "comp", "left").select("doc_id", "key", "n_shingles", F.coalesce("label", "comp").alias("comp")))
    least = joined_up.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = joined_up.join(least, "comp").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    lost = signatures(docs.where("doc_id is null"), n).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(lost)


def _near_duplicates(docs: DataFrame, sigs: DataFrame, n: int, percent: int) -> DataFrame:
    named = sigs.where("doc_id is not null and digest is not null")
    first = named.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "code")).alias("x"))
    reps = checkpointed(first.select("digest", F.col("x.doc_id").alias("rep"), "x.n_shingles", "x.sig", "x.code"))
    lists = checkpointed(postings(reps), release=True)
    top = lists.groupBy("key").agg(F.max(F.struct("weight", "rep")).alias("p")).select("key", F.col("p.rep").alias("a"))
    owned = lists.join(top, "key").where("a <> rep").select("a", "rep").distinct()
    member = likely(owned, reps, percent)
    comp = checkpointed(member.select("a").union(member.select("rep")).toDF("rep").distinct().withColumn("comp", F.col("rep")), release=True)
    texts = checkpointed(member_texts(docs, comp.select("rep")), release=True)
    comp = joined(comp, confirm(member.where("near").select("a", F.col("rep").alias("b")), texts, n, percent))
    comp = joined(comp, checkpointed(open_links(member, comp, texts, n, percent), release=True))
    by_digest = reps.join(comp, "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    out = sigs.select("doc_id", "n_shingles", "digest").join(by_digest, "digest", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that are near duplicates of a row with a smaller id; columns as they are."""
    name = free_name("gone", docs)
    gone = near_duplicates(docs.select("doc_id", "text"), n, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def op4_minhash(spark, sf_dir):
    return near_duplicates(read_documents(spark, sf_dir), n=2, percent=80)
