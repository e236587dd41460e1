"""Mix overlapping sources to target weights by min-cost flow (operator 8).

Documents are aggregated by membership pattern (the set of sources that hold them). Word capacity
flows from patterns through their sources to the sources' quotas; a second copy of a document costs
more than the first, so copies repeat only when every document of the pattern is in already. The
flow of a pattern then becomes whole copies of all its documents, and one more copy of a seeded
part of them.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in
order; equal rows are treated alike; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._common import checkpointed, free_name
from ._text import Words, chunks, to_bytes

#: Parts of a pattern's seeded order, as a power of two; only the part where a quota ends is sorted.
BIN_BITS = 16
MAX_PATTERNS = 200_000


def count_words(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and size: the number of words of the text."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("size", T.LongType())])

    def count(batches):
        for b in batches:
            texts = to_bytes(b.column(b.num_columns - 1))
            sizes = [Words(texts[lo:hi], lower=False, hashed=False).counts for lo, hi in chunks(texts, 2 << 20)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], names=[*keep, "size"]
            )

    return docs.select(*keep, "text").mapInArrow(count, schema)


def quotas(sizes: dict, weights: dict, share: Fraction, most: int) -> dict:
    """Targets by weight that sum to share of all sizes; none over most times its source, the excess reshared."""
    left, free, out = share * sum(sizes.values()), set(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] > most * sizes[s] * total}
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        out |= {s: Fraction(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def route(patterns: dict[tuple, int], targets: dict, most: int) -> dict[tuple, dict]:
    """Min-cost flow of words from patterns to source quotas: {pattern: {source: words}}.

    The k-th copy of a pattern's words costs k*k, the same for all patterns. So capacity is opened copy by copy, and
    after each the flow is made as large as it can be: what flows out of a pattern never falls again on the way, so no
    copy is used while a cheaper one is free anywhere. Each maximum is found by blocking flows over shortest paths.
    """
    order = sorted(patterns, key=str)
    sources = sorted(targets, key=str)
    first = {s: 2 + i for i, s in enumerate(sources)}
    n = 2 + len(sources) + len(order)
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []

    def edge(u: int, v: int, c: int) -> int:
        graph[u].append(len(to))
        graph[v].append(len(to) + 1)
        to.extend((v, u))
        cap.extend((c, 0))
        return len(to) - 2

    for s in sources:
        edge(first[s], 1, round(targets[s]))
    opens, arcs = [], {}
    for i, p in enumerate(order):
        at = 2 + len(sources) + i
        opens.append(edge(0, at, 0))
        for s in p:
            arcs[p, s] = edge(at, first[s], patterns[p] * most)
    for _ in range(most):
        for e, p in zip(opens, order, strict=True):
            cap[e] += patterns[p]
        while True:
            depth = [-1] * n
            depth[0], now = 0, [0]
            while now and depth[1] < 0:
                after = []
                for u in now:
                    for e in graph[u]:
                        if cap[e] and depth[to[e]] < 0:
                            depth[to[e]] = depth[u] + 1
                            after.append(to[e])
                now = after
            if depth[1] < 0:
                break
            turn = [0] * n
            path: list[int] = []
            u = 0
            while True:
                if u == 1:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    k = next(i for i, e in enumerate(path) if not cap[e])
                    u = to[path[k] ^ 1]
                    del path[k:]
                    continue
                while turn[u] < len(graph[u]):
                    e = graph[u][turn[u]]
                    if cap[e] and depth[to[e]] == depth[u] + 1:
                        break
                    turn[u] += 1
                if turn[u] < len(graph[u]):
                    path.append(graph[u][turn[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    turn[u] += 1
                else:
                    break
    out: dict = {p: {} for p in patterns}
    for (p, s), e in arcs.items():
        if cap[e ^ 1]:
            out[p][s] = cap[e ^ 1]
    return out


def mix_sources(
    docs: DataFrame,
    members: str = "source",
    weights: tuple[int, ...] | dict = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    most: int = 2,
    seed: int = 17,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, carried columns, pattern, size, copies, taken, source_size and target for each row.

    members is a string column (one source each) or an array of sources (documents in several).
    weights repeat over the sources in code-point order, or are given by source. Only one row for each
    membership pattern reaches the driver; more than MAX_PATTERNS of them are refused, since their flow is found there.
    """
    kind = docs.schema[members].dataType
    pattern = F.array_sort(F.array_distinct(F.col(members))) if isinstance(kind, T.ArrayType) else F.array(F.col(members))
    rest = [c for c in dict.fromkeys(("doc_id", *carry)) if c not in ("text", members)]
    # Rows without an id are drawn by their texts.
    lone = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("lone")
    sized = count_words(docs.select(*rest, F.col(members), lone, "text"), [*rest, members, "lone"])
    sized = checkpointed(sized.select(*rest, "lone", pattern.alias("pattern"), "size"))
    found = sized.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r.pattern or ()): r.words or 0 for r in found}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(w for p, w in patterns.items() if s in p) for s in names}
    given = weights if isinstance(weights, dict) else {s: weights[i % len(weights)] for i, s in enumerate(names)}
    reach = sum(patterns.values())
    targets = quotas(sizes, given, share * Fraction(reach, max(1, sum(sizes.values()))), most)
    flow = route(patterns, targets, most)

    plan = []
    for p, words in patterns.items():
        whole, part = divmod(sum(flow[p].values()), words) if words else (0, 0)
        one = p[0] if len(p) == 1 else None
        plan.append((list(p), whole, part, sizes[one] if len(p) == 1 else None, float(targets[one]) if len(p) == 1 else None))
    spark = docs.sparkSession
    item = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("p", item), T.StructField("whole", T.LongType()), T.StructField("part", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    plan_df = spark.createDataFrame(plan, schema)
    # An array never equals null inside a join key unless its text form is compared.
    key = lambda c: F.to_json(F.struct(F.coalesce(c, F.array().cast("array<string>")).alias("p")))
    draw = F.xxhash64(F.lit(seed), "doc_id", "lone")
    keyed = sized.withColumn("key", key(F.col("pattern"))).withColumn("draw", draw).withColumn("bin", F.shiftrightunsigned("draw", 64 - BIN_BITS))
    plan_df = plan_df.withColumn("key", key(F.col("p"))).drop("p")

    # The seeded part: whole bins first, then an order inside the one bin where the quota ends.
    bins = keyed.groupBy("key", "bin").agg(F.sum("size").alias("w"))
    upto = F.sum("w").over(W.partitionBy("key").orderBy("bin"))
    cuts = (
        bins.withColumn("upto", upto).join(plan_df.select("key", "part"), "key").where((F.col("upto") >= F.col("part")) & (F.col("w") > 0))
        .groupBy("key").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("w")).alias("before")), "bin").alias("cut"))
    )
    plan_df = plan_df.join(cuts, "key", "left").select("key", "whole", "part", "source_size", "target", F.col("cut.bin").alias("cut"), F.col("cut.before").alias("before"))
    plan_df = checkpointed(plan_df.coalesce(1))
    # One row for each pattern, at most MAX_PATTERNS: small enough to broadcast, else Spark joins by key.
    joined = keyed.join(F.broadcast(plan_df) if len(plan) <= 10_000 else plan_df, "key", "left")
    at_cut = F.col("bin") == F.col("cut")
    so_far = F.sum("size").over(W.partitionBy("key").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    near = joined.where(at_cut).withColumn("more", (2 * (F.col("before") + so_far) + F.col("size") <= 2 * F.col("part")) & (F.col("part") > 0))
    far = joined.where(~F.coalesce(at_cut, F.lit(False))).withColumn("more", F.coalesce(F.col("bin") < F.col("cut"), F.lit(False)) & (F.col("part") > 0))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more").cast("long")).otherwise(0).cast("long")
    return far.unionByName(near).withColumn("copies", copies).select(
        *rest, "pattern", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it; columns as they are. Rows that repeat an id share a decision."""
    name, copies, nth = (free_name(x, docs) for x in ("id", "copies", "nth"))
    plan = mix_sources(docs.select("doc_id", options.get("members", "source"), "text"), **options).groupBy(F.col("doc_id").alias(name)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    rows = docs.join(plan, docs["doc_id"].eqNullSafe(plan[name]))
    return rows.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), plan[copies])).alias(nth)).drop(nth)


def op8_mixing(spark, sf_dir):
    from ._common import read_documents

    mixed = mix_sources(read_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
