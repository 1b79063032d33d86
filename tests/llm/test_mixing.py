from collections import Counter

import pytest

from tidemark.llm.mixing import mix, reached, source_rates


def frames(spark, docs, targets):
    return spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_copies_are_systematic_and_capped(spark):
    docs = [(i, "big", 10) for i in range(600)] + [(10_000 + i, "small", 10) for i in range(100)] + [(20_000 + i, "tiny", 5) for i in range(10)] + [(30_000, None, 9), (30_001, "other", 9)]
    sized, targets = frames(spark, docs, [("big", 0.4, 1), ("small", 0.4, 4), ("tiny", 0.15, 3), ("absent", 0.05, 9)])
    rates = {r["source"]: r for r in source_rates(sized, targets).collect()}
    total = 6000 + 1000 + 50
    assert rates["big"]["rate"] == pytest.approx(0.4 * total / 6000) and rates["small"]["rate"] == pytest.approx(0.4 * total / 1000)
    assert {s for s, r in rates.items() if r["short"]} == {"tiny", "absent"} and rates["tiny"]["rate"] == 3
    mixed = mix(sized, targets, bucket_rows=37)
    got = mixed.collect()
    assert len(got) == 710 and {r["source"] for r in got} == {"big", "small", "tiny"}
    copies = Counter()
    for r in got:
        copies[r["source"]] += r["copies"]
        assert int(rates[r["source"]]["rate"]) <= r["copies"] <= -(-rates[r["source"]]["rate"] // 1)
    for s in ("big", "small", "tiny"):
        assert abs(copies[s] - rates[s]["rate"] * {"big": 600, "small": 100, "tiny": 10}[s]) < 1
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in mix(sized, targets, bucket_rows=37).collect())
    shares = {r["source"]: r for r in reached(mixed, source_rates(sized, targets)).collect()}
    assert sum(r["actual_share"] for r in shares.values()) == pytest.approx(1) and shares["absent"]["actual_share"] == 0 and shares["tiny"]["most_copies"] == 3


def test_buckets_change_no_totals(spark):
    docs = [(i, "a", 3) for i in range(500)]
    sized, targets = frames(spark, docs, [("a", 0.37, 2)])
    assert {sum(r["copies"] for r in mix(sized, targets, bucket_rows=n).collect()) for n in (1, 50, 10**6)} <= {184, 185, 186}


def test_nothing_and_empty_texts(spark):
    sized, targets = frames(spark, [], [("a", 1.0, 2)])
    assert mix(sized, targets).count() == 0 and [r["short"] for r in source_rates(sized, targets).collect()] == [False]
    sized, targets = frames(spark, [(1, "a", 0), (2, "a", 0)], [("a", 0.5, 2), ("a", 0.5, 3), (None, 0.1, 1)])
    assert {r["copies"] for r in mix(sized, targets).collect()} == {0}
    assert [(r["target_share"], r["max_repeats"]) for r in source_rates(sized, targets).collect()] == [(1.0, 2)]
    assert mix(*frames(spark, [(1, "a", 5)], [])).count() == 0


def test_shares_come_near_the_targets(spark):
    import random

    rng = random.Random(5)
    docs = [(i, rng.choice("aaaabbc"), int(rng.lognormvariate(6, 1.2))) for i in range(4000)]
    targets = [("a", 0.3, 1), ("b", 0.5, 3), ("c", 0.2, 2)]
    sized, wanted = frames(spark, docs, targets)
    for seed in (11, 12):
        got = reached(mix(sized, wanted, bucket_rows=100, seed=seed), source_rates(sized, wanted)).collect()
        for r in got:
            assert not r["short"] and abs(r["used"] - r["wanted"]) <= 0.01 * r["wanted"] + 2 * r["largest"] and r["most_copies"] <= r["max_repeats"], r


def test_short_is_what_the_mix_cannot_reach(spark):
    docs = [(1, "one", 10), (2, "two", 6), (3, "two", 4), (4, "rest", 80)]
    for repeats in (1, 2, 3):
        targets = [("one", 0.2, repeats), ("two", 0.25, repeats), ("rest", 0.5, 1), ("none", 0.05, repeats)]
        sized, wanted = frames(spark, docs, targets)
        rates = source_rates(sized, wanted)
        assert {r["source"] for r in reached(mix(sized, wanted), rates).filter("short").collect()} == {r["source"] for r in rates.filter("short").collect()}
