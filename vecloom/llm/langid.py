"""Language identification in two steps (operator 2).

First a language family is predicted (one linear support vector machine for each family against the
rest), then one-versus-one linear machines tell the languages of that family apart by votes. Features
are hashed byte bigrams and trigrams of the whole lower-cased text, letters only.

The machines are fitted on the driver on a bounded sample: at most per_language rows of a language and
SAMPLE rows in all, those with the smallest hash of their id. Everything else covers all rows.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled row
every text is `und`; rows with a null label are not learned from; equal texts get equal results, ties go to
the family or language that is first in order; texts of any length are whole; an empty table gives an empty table; extra columns are carried only when asked for.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._common import crc_mod, read_documents
from ._text import chunks, trim

DIM = 2048
SAMPLE = 20_000
#: At most so many languages are learned, the most frequent ones.
LANGUAGES = 1000
#: Language families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "Germanic": "en de nl af sv da no nb nn is fy lb yi",
    "Romance": "fr es it pt ro ca gl oc la",
    "Slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "Uralic": "fi et hu",
    "Turkic": "tr az kk uz ky tk",
    "Indo-Aryan": "hi ur bn pa mr gu ne",
    "Semitic": "ar he am mt",
    "Sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def features(texts: list[bytes]) -> np.ndarray:
    """One row a text: square roots of the shares of hashed byte bigrams and trigrams, hence of length 1."""
    out = np.zeros((len(texts), DIM), np.float32)
    for lo, hi in chunks(texts, 1 << 20):
        b = np.frombuffer(b" " + b" ".join(texts[lo:hi]).translate(_FOLD) + b"  ", np.uint8).astype(np.uint32)
        two = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77)
        three = (two + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(21)
        two = (two * np.uint32(0x165667B1)) >> np.uint32(21)
        blank = (b[:-1] == 32) & (b[1:] == 32)
        two[blank[:-1]], three[blank[:-1] | blank[1:]] = 0, 0
        at = 0
        for i in range(lo, hi):
            n = len(texts[i]) + 1
            c = np.bincount(two[at : at + n], minlength=DIM) + np.bincount(three[at : at + n], minlength=DIM)
            c[0] = 0
            out[i] = np.sqrt(c / max(1, c.sum()))
            at += n
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float, float]:
    """Squared-hinge machine by dual coordinate descent; y is +-1. Returns weights, bias and Platt slope."""
    n = len(y)
    x = np.hstack([x, np.full((n, 1), 0.5, np.float32)]).astype(np.float64)
    w, a = np.zeros(x.shape[1]), np.zeros(n)
    cost = {s: c * n / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    ridge = np.array([1 / (2 * cost[s]) for s in y])
    norm = (x * x).sum(1) + ridge
    order = np.random.default_rng(7)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(n):
            g = y[i] * (x[i] @ w) - 1 + ridge[i] * a[i]
            step = max(a[i] - g / norm[i], 0.0) - a[i]
            if step:
                a[i] += step
                w += step * y[i] * x[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    m = y * (x @ w)
    slope = max(1.0, 5.0 / max(0.1, float(np.median(m))))
    return w[:-1], float(w[-1] * 0.5), slope


class Model:
    """Family machines, then pairwise machines by family."""

    def __init__(self, x: np.ndarray, langs: list[str], sizes: np.ndarray | None = None):
        labels = np.array(langs, dtype=object)
        self.langs = sorted(set(langs))
        self.family = {g: FAMILY_OF.get(g, g) for g in self.langs}
        self.families = sorted(set(self.family.values()))
        of = np.array([self.family[g] for g in langs], dtype=object)
        self.members = {f: [g for g in self.langs if self.family[g] == f] for f in self.families}
        machines = [linear_svm(x, np.where(of == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = [(f, a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        for _, a, b in self.pairs:
            pick = (labels == a) | (labels == b)
            machines.append(linear_svm(x[pick], np.where(labels[pick] == a, 1, -1)))
        self.w = np.array([m[0] for m in machines], np.float64).reshape(-1, x.shape[1])
        self.bias = np.array([m[1] for m in machines])
        self.slope = np.array([m[2] for m in machines])

        self._fit_plausible(x.astype(np.float64) ** 2, labels, np.full(len(x), 1000.0) if sizes is None else sizes)

    def _fit_plausible(self, share: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> None:
        """What texts of each language usually get: mean log ratio of a feature to chance, and how that varies."""
        p = np.array([0.999 * share[labels == g].mean(0) + 0.001 / DIM for g in self.langs])
        self.ratio = np.log(p * DIM)
        got = share @ self.ratio.T
        self.usual, self.between, self.within = (np.zeros(len(self.langs)) for _ in range(3))
        self.least = np.full(len(self.langs), -4.0)
        for i, g in enumerate(self.langs):
            mine, n = got[labels == g, i], sizes[labels == g]
            self.usual[i] = np.median(mine)
            self.within[i] = 4 * max(1e-6, float(p[i] @ self.ratio[i] ** 2 - (p[i] @ self.ratio[i]) ** 2))
            self.between[i] = float(np.median(np.abs(mine - self.usual[i]))) * 1.5
            # No row that was learned from is implausible, but for the worst in a thousand.
            self.least[i] = min(-4.0, float(np.quantile(self._distance(mine, n, i), 0.001)) * 1.2)

    def _distance(self, got: np.ndarray, sizes: np.ndarray, i) -> np.ndarray:
        return (got - self.usual[i]) / np.sqrt(self.between[i] ** 2 + self.within[i] / np.maximum(sizes, 1) + 1e-9)

    def plausible(self, x: np.ndarray, langs: list[str], sizes: np.ndarray) -> np.ndarray:
        """Whether texts look like their predicted languages at all, however much less they look like the others.

        Judged on what a language's own texts get, so texts of languages that were not learned, or of random letters, fail.
        """
        if not len(langs):
            return np.zeros(0, bool)
        at = {g: i for i, g in enumerate(self.langs)}
        i = np.array([at[g] for g in langs])
        got = ((x.astype(np.float64) ** 2) * self.ratio[i]).sum(1)
        return self._distance(got, sizes, i) >= self.least[i]

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        out = []
        p = 1 / (1 + np.exp(-np.clip(self.slope * (x.astype(np.float64) @ self.w.T + self.bias), -50, 50)))
        k = len(self.families) if len(self.families) > 1 else 0
        for row in p:
            f = int(np.argmax(row[:k])) if k else 0
            sure = float(row[f] / max(row[:k].sum(), 1e-12)) if k else 1.0
            family = self.families[f]
            votes = {g: [0, 0.0] for g in self.members[family]}
            for (g, a, b), q in zip(self.pairs, row[k:], strict=True):
                if g == family:
                    votes[a if q >= 0.5 else b][0] += 1
                    votes[a][1] += float(q)
                    votes[b][1] += 1 - float(q)
            best = max(votes, key=lambda g: (*votes[g], [-ord(c) for c in g]))
            rivals = len(votes) - 1
            out.append((best, round(sure * (votes[best][1] / rivals if rivals else 1.0), 6)))
        return out


def fit(docs: DataFrame, per_language: int = 1000) -> Model | None:
    """Fit on rows of docs (doc_id, text, lang) whose lang and text are not null."""
    docs = docs.where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    most = max(20, min(per_language, SAMPLE // len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30))
    # A hash threshold leaves little more than the sample before rows of a language are put in order.
    cut = F.lit(1 << 30)
    for g, n in sorted(counts.items()):
        cut = F.when(F.col("lang") == g, F.lit(min(1 << 30, math.ceil((1 << 30) * (1.3 * most + 60) / n)))).otherwise(cut)
    order = W.partitionBy("lang").orderBy("draw", "doc_id", "text")
    picked = docs.where(F.col("lang").isin(sorted(counts))).select("doc_id", "text", "lang", draw.alias("draw")).where(F.col("draw") < cut)
    picked = picked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", "rank", "text")

    def extract(batches):
        for b in batches:
            texts = b.column(2).cast("binary").to_pylist()
            x = features(texts).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=["lang", "rank", "x", "size"])

    rows = sorted(picked.mapInArrow(extract, "lang string, rank int, x binary, size long").collect(), key=lambda r: (r.lang, r["rank"]))
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32)
    return Model(x, [r.lang for r in rows], np.array([r["size"] for r in rows], np.float64))


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """keep columns, lang_pred and score of every whole text."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            raw, names, scores = [x or b"" for x in texts.cast("binary").to_pylist()], [], []
            for lo in range(0, len(raw), 512):
                part = raw[lo : lo + 512]
                found = model.predict(features(part)) if model else [("und", 0.0)] * len(part)
                for t, (g, s) in zip(part, found, strict=True):
                    ok = model and _LETTER.search(t.decode("utf-8", "ignore")) is not None
                    names.append(g if ok else "und")
                    scores.append(s if ok else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(predict, schema)


def accepted(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """The rows of docs whose text has a predicted language with a score of at least `least` and is plausible in it; columns as they are.

    Texts without a letter, of languages that were not learned, and of letters in no language's order go.
    """
    at = docs.columns.index("text")

    def choose(batches):
        for b in batches:
            raw = [x or b"" for x in b.column(at).cast("binary").to_pylist()]
            keep: list[bool] = []
            for lo in range(0, len(raw), 512):
                part = raw[lo : lo + 512]
                if model is None:
                    keep += [False] * len(part)
                    continue
                x = features(part)
                found = model.predict(x)
                fits = model.plausible(x, [g for g, _ in found], np.array([len(t) for t in part], np.float64))
                keep += [bool(ok) and s >= least and _LETTER.search(t.decode("utf-8", "ignore")) is not None for t, (_, s), ok in zip(part, found, fits, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))
            trim()

    return docs.mapInArrow(choose, docs.schema)


def op2_langid(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    model = fit(docs.where(F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(True))))
    found = identify(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
