"""Mixing: shares, caps, inclusion probabilities, and odd inputs."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

mixing = pytest.importorskip("ledgerlog.llm.mixing")
from ledgerlog.llm import bpe  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="the vocabulary is not there")
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, sizes, words=20):
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((i, "word " * (words + k % 7), source, "clash", 0, 0.0, 0))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string, copies int, p double, slice int").repartition(3)


def taken(df):
    return [(r.doc_id, r.source, r.tokens, r.copies) for r in df.collect()]


def test_shares_are_reached_within_the_caps(spark):
    docs = corpus(spark, {"Big ": 600, "mid": 200, " SMALL": 30, "other": 50})
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("absent", 0.1, 3)], TARGETS)
    got = taken(mixing.mix(docs, targets))
    total = sum(t * c for _, _, t, c in got)
    by = Counter()
    for _, s, t, c in got:
        by[s] += t * c
    assert set(by) == {"big", "mid", "small"} and max(c for _, s, _, c in got if s == "small") <= 4 and {c for _, s, _, c in got if s == "big"} == {1}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        assert abs(by[s] / total - share / 0.9) < 0.02
    # the source that limits the corpus gives all that it may
    assert min(c for _, s, _, c in got if s == "small") == 4
    report = {r.source: r for r in mixing.shares(mixing.mix(docs, targets), targets).collect()}
    assert report["absent"].tokens == 0 and report["absent"].actual_share == 0 and abs(report["mid"].actual_share - by["mid"] / total) < 1e-9 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_a_given_size_is_met_or_capped(spark):
    docs = corpus(spark, {"a": 400, "b": 10})
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 2)], TARGETS)
    size = {r.source: r.tokens for r in mixing.shares(mixing.mix(docs, targets, total_tokens=4000), targets).collect()}
    assert abs(size["a"] - 2000) <= 30
    assert size["b"] == sum(t * 2 for _, s, t, _ in taken(mixing.mix(docs, targets, total_tokens=4000)) if s == "b")  # as often as allowed


def test_repeatable_and_seeded(spark):
    docs, targets = corpus(spark, {"a": 200, "b": 100}), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    one = sorted(taken(mixing.mix(docs, targets)))
    assert one == sorted(taken(mixing.mix(docs.repartition(7), targets))) and one != sorted(taken(mixing.mix(docs, targets, seed=8)))


def test_unequal_weights_give_inclusion_probabilities(spark):
    docs = corpus(spark, {"a": 300, "b": 300}, words=30).withColumn("w", F.when(F.col("doc_id") % 3 == 0, 3.0).otherwise(1.0))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    hits = defaultdict(list)
    for seed in range(6):
        got = {d for d, *_ in taken(mixing.mix(docs, targets, total_tokens=6000, weight="w", seed=seed))}
        for d in range(600):
            hits[d % 3 == 0].append(d in got)
    heavy, light = (sum(hits[k]) / len(hits[k]) for k in (True, False))
    assert 2.4 < heavy / light < 3.6


def test_the_sample_is_the_front_of_the_order(spark, monkeypatch):
    docs, targets = corpus(spark, {"a": 500, "b": 500}), spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 1)], TARGETS)
    fine = sorted(taken(mixing.mix(docs, targets)))
    monkeypatch.setattr(mixing, "SLICES", 4)  # coarse slices: the boundary slice is large, the result the same
    assert sorted(taken(mixing.mix(docs, targets))) == fine


def test_odd_inputs(spark):
    docs = corpus(spark, {"a": 20, "b": 20})
    odd = spark.createDataFrame([(1000, None, "a"), (1001, "", "a"), (1002, "x y", None), (1003, "x y", "  "), (None, "no id here", "a"), (0, "word " * 20, "a")], "doc_id long, text string, source string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    targets = spark.createDataFrame([("a", 0.3, 2), (" A", 0.2, 5), ("b", 0.5, 1), (None, 0.5, 1), ("c", None, 1), ("d", 0.5, None), ("e", 0.0, 1), ("f", 0.1, 0)], TARGETS)
    got = taken(mixing.mix(both, targets))
    assert {s for _, s, _, _ in got} == {"a", "b"} and not {1000, 1001, 1002, 1003} & {d for d, *_ in got} and max(c for *_, c in got) <= 2
    assert mixing.mix(both.where("false"), targets).count() == 0 and mixing.mix(both, targets.where("false")).count() == 0
    assert mixing.shares(mixing.mix(both.where("false"), targets), targets).where("tokens > 0").count() == 0


def test_corpus_has_every_copy(spark):
    docs, targets = corpus(spark, {"a": 40, "b": 5}), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], TARGETS)
    mixed = mixing.mix(docs, targets)
    whole = mixing.corpus(docs, mixed).collect()
    assert Counter(r.doc_id for r in whole) == {d: c for d, _, _, c in taken(mixed)} and all(r.text.startswith("word ") and r.copy >= 1 for r in whole)


def test_rates_fill_up_to_the_cap(spark):
    """Expected copies are least(rate * weight, cap), and their tokens what was asked for."""
    docs = corpus(spark, {"a": 300}, words=30).withColumn("w", F.exp(F.pmod("doc_id", F.lit(50)) / 10.0))
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    every = {r.doc_id: r.w for r in docs.collect()}
    sizes = {d: t for d, _, t, _ in taken(mixing.mix(docs, targets))}
    assert len(sizes) == 300
    total = sum(sizes.values())
    for part in (0.3, 1.0, 1.7, 1.999):
        got = {d: c for d, _, _, c in taken(mixing.mix(docs, targets, total_tokens=part * total, weight="w"))}
        low, high = 0.0, 1e6
        for _ in range(200):  # the rate by bisection
            rate = (low + high) / 2
            low, high = (rate, high) if sum(t * min(2.0, rate * every[d]) for d, t in sizes.items()) < part * total else (low, rate)
        for d in every:
            assert abs(got.get(d, 0) - min(2.0, rate * every[d])) < 1.08 and got.get(d, 0) <= 2
        assert abs(sum(sizes[d] * c for d, c in got.items()) - part * total) < 60


def test_a_source_at_its_cap_gives_all(spark):
    docs = corpus(spark, {"a": 100, "b": 10}).withColumn("w", F.col("doc_id") + 1.0)
    got = taken(mixing.mix(docs, spark.createDataFrame([("a", 0.5, 9), ("b", 0.5, 3)], TARGETS), weight=F.sqrt("w")))
    assert [c for _, s, _, c in got if s == "b"] == [3] * 10
