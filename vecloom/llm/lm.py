"""Language-model scores from a log-frequency Bloom filter of n-gram counts (operator 6).

Training documents' n-grams of two to ORDER words are counted exactly, those seen once too; counts are
quantised on a logarithmic scale, and an n-gram of level q is put into a Bloom filter under levels 1 to q.
An n-gram is probed under levels upwards until one is missing, and the level reached gives the count.

Probabilities are smoothed by backing off: that of a token after a history h of n - 1 tokens is
(c(h, token) + MASS * p) / (c(h) + MASS), where p is its probability after the shorter history, and in the
end the base. What seen n-grams do not use of a history's mass goes to all tokens alike, so exact counts
would give a distribution; the levels bend that by their step.

The filter is never in one place: each hash range fills and probes its own part, which grows with its
items and is dropped afterwards. Groups of documents ask the ranges that own their words and n-grams,
held-out ones too, and exact unigram counts and n-gram levels come back by an exchange whose rows grow with
the groups (_exchange). So neither a vocabulary nor a filter is broadcast, and no count is left out at any size.

Defined results: null and empty texts have one token, the end; without training documents each token
has probability one; rows with a null id are training rows; equal texts have equal scores; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, crc_mod, group_count, read_documents
from ._exchange import BACK, FAN, SAID, exchange, heard, narrowed, say, table
from ._packed import LOW40, pack_texts, range_of, unpack_texts
from ._text import K1, K2, U64, Words, chunks, mix, pair_hash, to_bytes, trimmed

END, BEGIN = U64(0x1F83D9ABFB41BD6B), U64(0x5BE0CD19137E2179)
MIN_COUNT = 1
STEP = 1.5
PROBES = 4
#: Bits an item, and least bits of a part: an absent n-gram is found by chance in some 0.6 % of cases.
BITS_EACH, LEAST_BITS = 12, 4096
ORDER = 3
#: Weight of the shorter history, in tokens.
MASS = 2.0


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text's words and then one end; and the number of tokens of each text."""
    parts, counts = [], []
    for lo, hi in chunks(texts, 2 << 20):
        w = Words(texts[lo:hi])
        parts.append(np.insert(w.hash, w.bounds[1:], END))
        counts.append(w.counts + 1)
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(counts)


def ngrams(h: np.ndarray, counts: np.ndarray, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 2 to order: hash of each token with the n - 1 before it, and whether it has so many (the beginning counts as one)."""
    nth = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.where(nth == 0, BEGIN, np.roll(h, 1))
    out = [(pair_hash(last, h), np.ones(len(h), bool))]
    for n in range(3, order + 1):
        # The n-gram that ends one token earlier, and this token.
        out.append((pair_hash(np.roll(out[-1][0], 1) + U64(n), h), nth >= n - 2))
    return out


def level(count: np.ndarray, least: int) -> np.ndarray:
    """Quantised level of a count; 0 below least."""
    c = np.maximum(count, 1) / least
    return np.where(count < least, 0, 1 + np.floor(np.log(np.maximum(c, 1)) / math.log(STEP) + 1e-9).astype(np.int64))


def estimate(q: np.ndarray, least: int) -> np.ndarray:
    """Count that a level stands for: the middle of its span; 0 for level 0."""
    return np.where(q > 0, least * STEP ** (q - 0.5), 0.0)


class Filter:
    """Bits of all hash ranges, one after the other; range r has sizes[r] bits (a multiple of 8)."""

    def __init__(self, sizes: np.ndarray, top: int, least: int, bits: bytes):
        self.sizes, self.top, self.least = sizes.astype(U64), top, least
        self.begin = (np.cumsum(sizes) - sizes).astype(U64)
        self.bits = np.frombuffer(bits, np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes: up from level 1 until one probe fails."""
        out = np.zeros(len(h), np.int64)
        if not len(self.bits):
            return out
        r = range_of(h, len(self.sizes))
        size, begin, key = self.sizes[r], self.begin[r], h & LOW40
        left = np.flatnonzero(size)
        for q in range(1, self.top + 1):
            for p in range(PROBES):
                at = begin[left] + probe(key[left], q, p) % size[left]
                left = left[(self.bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1]
            out[left] = q
            if not len(left):
                break
        return out


def probe(key: np.ndarray, q: int, p: int) -> np.ndarray:
    return mix(key * K1 + np.full(1, q * PROBES + p + 1, U64) * K2)


def fill(keys: np.ndarray, levels: np.ndarray, size: int) -> bytes:
    """Bits of one range."""
    bits = np.zeros(size, np.uint8)
    for q in range(1, int(levels.max(initial=0)) + 1):
        now = keys[levels >= q]
        for p in range(PROBES):
            bits[(probe(now, q, p) % np.full(1, size, U64)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def size_of(items: int) -> int:
    return max(LEAST_BITS, 8 * math.ceil(items * BITS_EACH / 8)) if items else 0


def probability(base: np.ndarray, c: np.ndarray, seen: list[tuple[np.ndarray, np.ndarray]], begin: np.ndarray, begun: int) -> np.ndarray:
    """Smoothed probability of each token. c: its training count; seen: for n = 2, 3, ... the count of its n-gram and whether there is one."""
    p, history = base, np.roll(c, 1)
    history[begin] = begun
    for count, there in seen:
        # Quantised counts can be over that of their history, which exact ones never are.
        longer = (count + MASS * p) / (np.maximum(history, count) + MASS)
        p = np.where(there, longer, p)
        history = np.roll(count, 1)
    return p


def score_documents(docs: DataFrame, held_out, max_filter_mb: int = 128, mb_each: float = 4.0, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    max_filter_mb is accepted and changes nothing: the filter stays in its ranges, so there is no size to bound.
    """
    groups = group_count(docs, mb_each)
    own = pack_texts(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), groups, ["doc_id", "held_out"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keys_of(t: pa.Table) -> tuple:
        """Counts of tokens by text; and for tokens (0) and n-grams (1): distinct keys, where each occurrence stands among them, whose it is."""
        h, counts = tokens(to_bytes(t["text"].combine_chunks()))
        several = ngrams(h, counts)
        place = np.concatenate([np.flatnonzero(there) for _, there in several]) if len(h) else np.zeros(0, np.int64)
        x = np.concatenate([narrowed(g[there]) for g, there in several])
        return h, counts, several, [(*np.unique(narrowed(h), return_inverse=True), np.arange(len(h))), (*np.unique(x, return_inverse=True), place)]

    def ask(t: pa.Table) -> pa.Table:
        """What a group says to the ranges: its distinct tokens and n-grams with their training counts."""
        g = t["g"][0].as_py()
        t = unpack_texts(t)
        _, counts, _, found = keys_of(t)
        train = np.repeat(~np.array(t["held_out"].to_pylist(), bool), counts)
        return table([x for k, (keys, inverse, place) in enumerate(found) for x in say(k, g, 0, keys, np.bincount(inverse, train[place], len(keys)), 1, fan)], SAID)

    def answer(k: int, keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Training counts of tokens; levels of n-grams, by filling and probing this range's filter."""
        if k == 0:
            return sums
        q = level(sums, MIN_COUNT)
        size = size_of(int(q.sum()))
        return Filter(np.array([size]), int(q.max(initial=0)), MIN_COUNT, fill(keys & LOW40, q, size) if size else b"").levels(keys & LOW40)

    answers = checkpointed(exchange(own.groupBy("g").applyInArrow(trimmed(ask), SAID), groups, answer, True, fan), release=True)

    def add(t: pa.Table) -> pa.Table:
        return table([(0, 0, -1, 0, np.sum([np.frombuffer(x, np.int64) for x in t["back"].to_pylist()], axis=0).tobytes())], BACK)

    # Totals of ranges are added in two steps, so that the driver gets a few rows at any size.
    parts = answers.where("g = -1").groupBy(F.pmod("q", F.lit(FAN)).alias("w")).applyInArrow(lambda t: add(t), BACK).select("back").collect()
    n, v = np.sum([np.frombuffer(t["back"], np.int64) for t in parts], axis=0).tolist() if parts else (0, 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left = unpack_texts(left)
        h, counts, several, ((_, one, _), (_, inverse, place)) = keys_of(left)
        c = heard(right, 0)[one].astype(np.float64)
        levels = heard(right, 1)[inverse].astype(np.int64)
        seen, at = [], 0
        for _, there in several:
            m = int(there.sum())
            count = np.zeros(len(h))
            count[there] = estimate(levels[at : at + m], MIN_COUNT)
            seen.append((count, there))
            at += m
        base = (c + 0.5) / (n + 0.5 * (v + 1))
        begin = np.cumsum(counts) - counts
        p = probability(base, c, seen, begin, train_docs)
        total = lambda x: np.add.reduceat(x, begin)
        return pa.table({
            "doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": pa.array(counts, pa.int64()), "n_known": pa.array(total((c > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array([n] * len(counts), pa.int64()), "base_score": pa.array(total(np.log10(base))), "score": pa.array(total(np.log10(p))),
        })

    # As many texts begin as end, so the end token's count is the count of beginnings.
    train_docs = docs.select(F.coalesce(held_out, F.lit(False)).alias("h")).where("not h").count()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.groupBy("g").cogroup(answers.where("g >= 0").groupBy("g")).applyInArrow(trimmed(score), out)


def op6_lm(spark, sf_dir):
    return score_documents(read_documents(spark, sf_dir), crc_mod(F.col("doc_id"), 5) == 1)
