"""Hot groups: copies, one source and common passages that hold a large part of all rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vecloom.llm import lm, minhash, mixing, substrings, tokencount


@pytest.fixture(scope="module")
def hot_rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    copy, passage, rows = prose(80), prose(55), []
    for d in range(400):
        if d % 3 == 0:
            t = copy
        elif d % 3 == 1:
            t = f"{prose(20)} {passage} {prose(20)}"
        else:
            w = copy.split()
            for i in rng.sample(range(80), rng.choice([1, 2, 5])):
                w[i] = f"x{d}y{i}"
            t = " ".join(w) if d % 2 else prose(rng.randint(1, 200))
        rows.append((d, t, "hot" if d % 3 else f"s{d % 7}"))
    return rows


@pytest.fixture(scope="module")
def hot(spark, hot_rows):
    return spark.createDataFrame(hot_rows, "doc_id long, text string, source string").repartition(7)


def test_hot_near_duplicates(hot, hot_rows, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    texts = {d: t for d, t, _ in hot_rows}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(hot, 2).collect()} == brute.components(texts, 2, 80)


@pytest.mark.parametrize("options", [{}, {"mb_each": 0.01, "hot_groups": 2}, {"mb_each": 0.003, "fan": 2}, {"mb_each": 0.003, "fan": 4, "hot_groups": 3}])
def test_hot_passages(hot, hot_rows, options):
    texts = {d: t for d, t, _ in hot_rows}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(hot, **options).collect()}
    assert got == brute.repeats(texts)


def test_results_do_not_depend_on_partitions(hot):
    for fn in (tokencount.token_counts, lambda d: lm.score_documents(d, F.col("doc_id") % 5 == 1, mb_each=0.01), mixing.mix_sources):
        a, b = (Counter(str(tuple(r)) for r in fn(d).collect()) for d in (hot, hot.repartition(3, "source")))
        assert a == b


def test_scores_do_not_depend_on_rounds(hot):
    """One round of the exchange or several: the same counts, and scores but for what a filter says by chance."""
    one, many = ({r.doc_id: r for r in lm.score_documents(hot, F.col("doc_id") % 5 == 1, mb_each=0.003, fan=f).collect()} for f in (256, 2))
    for d, r in one.items():
        assert (r.n_known, r.train_tokens, r.base_score) == (many[d].n_known, many[d].train_tokens, many[d].base_score)
        assert abs(r.score - many[d].score) <= 0.2 * r.n_tokens


@pytest.mark.parametrize("route", [False, True])
def test_rows_of_exchanges_grow_with_the_input(spark, monkeypatch, route):
    """Twice, four and eight times the groups: no round has more than so many times the rows."""
    import numpy as np

    from vecloom.llm import _exchange

    seen: list[int] = []

    def spy(df, release=False):
        kept = df.persist()
        seen.append(kept.count())
        return kept

    monkeypatch.setattr(_exchange, "checkpointed", spy)
    monkeypatch.setattr(substrings, "checkpointed", spy)
    rng = np.random.default_rng(1)

    def rows(groups):
        out = []
        for g in range(groups):
            keys = np.unique(rng.integers(0, 1 << 48, 200, dtype=np.uint64))
            if not route:
                out += _exchange.say(0, g, 0, keys, np.ones(len(keys), np.int64), 1, 4)
                continue
            m = np.zeros(len(keys), substrings.META)
            m["anchor"], m["id"], m["g"], m["size"] = keys << np.uint64(16), g, g, 50
            out += substrings.packed(m, rng.integers(0, 255, 50 * len(m)).astype(np.uint8), np.arange(len(m)) * 50, np.arange(len(m)), 1, 4, 0, g)
        return _exchange.table(out, substrings.SENT if route else _exchange.SAID)

    most = {}
    for groups in (16, 32, 64, 128):
        seen.clear()
        t = rows(groups)
        df = spark.createDataFrame(t.to_pandas(), substrings.SENT if route else _exchange.SAID)
        if route:
            seen.append(substrings.route(df, groups, 4).count())
        else:
            found = _exchange.exchange(df, groups, lambda k, keys, sums: sums, fan=4).collect()
            assert len(found) == t.num_rows
        most[groups] = max(t.num_rows, *seen)
    assert all(most[n] <= most[16] * n / 16 * 1.05 for n in most)
