"""Operators whose groups may be as large as the table: order statistics, draws, assignment, nearest atoms, copies, pairing."""

import heapq
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import alignment, annotations, confidence, sampling, spatial


def score_rows():
    rng = random.Random(1)
    rows = [("hot", i, rng.gauss(0, 1)) for i in range(3000)] + [("ties", i, float(rng.randrange(3))) for i in range(500)] + [("wide", i, rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300)) for i in range(300)]
    rows += [("one", 0, 4.0), ("two", 0, 1.0), ("two", 1, 3.0), (None, 0, 2.0), (None, 1, 5.0), ("gone", 0, None), ("gone", 1, float("nan")), ("ends", 0, -1.7e308), ("ends", 1, 1.7e308), ("ends", 2, 0.0)]
    return rows


def groups_of(rows):
    groups = defaultdict(list)
    for g, seed, v in rows:
        if v is not None and not math.isnan(v):
            groups[g].append((seed, v))
    return groups


@pytest.mark.parametrize("most", [100_000, 7])
def test_order_statistics(spark, monkeypatch, most):
    monkeypatch.setattr(confidence, "SORTED_ROWS", most)
    rows = [r for r in score_rows() if most > 7 or r[0] != "wide"]
    df = spark.createDataFrame(rows, "metric string, seed long, value double")
    got = {r["metric"]: r for r in confidence.order_statistics(df, ["metric"], "value", {"third": lambda n: F.least(n, F.lit(3)), "middle": lambda n: F.floor((n + 1) / 2), "last": lambda n: n}).collect()}
    groups = groups_of(rows)
    assert set(got) == set(groups)
    for g, own in groups.items():
        v = sorted(x for _, x in own)
        assert (got[g]["n"], got[g]["third"], got[g]["middle"], got[g]["last"]) == (len(v), v[min(len(v), 3) - 1], v[(len(v) + 1) // 2 - 1], v[-1])


def test_no_task_sorts_a_group(spark, monkeypatch):
    """Rows that reach a sort lie in ranges of bounded size, and ranges are counted before the shuffle."""
    monkeypatch.setattr(confidence, "SORTED_ROWS", 40)
    df = spark.createDataFrame(score_rows(), "metric string, seed long, value double").where("metric = 'hot'")
    seen = []
    real = confidence._meet
    monkeypatch.setattr(confidence, "_meet", lambda data, ranges, by: seen.append((real(data, ranges, by), ranges.count())) or seen[-1][0])
    confidence.order_statistics(df, ["metric"], "value", {"m": lambda n: F.floor(n / 2)}).collect()
    sorted_rows = [met.count() for (met, n) in seen[::2] if n]  # every other call is for what is sorted
    assert max(sorted_rows) <= 40
    plan = seen[1][0].groupBy("metric", "lo", "hi").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2


def test_aggregates_and_percentiles(spark, monkeypatch):
    monkeypatch.setattr(confidence, "SORTED_ROWS", 11)
    rows = [r for r in score_rows() if r[0] not in ("wide", "ends")]
    df = spark.createDataFrame(rows, "metric string, seed long, value double")
    groups = groups_of(rows)
    got = {r["metric"]: r for r in confidence.sample_aggregate(df, ["metric"]).collect()}
    pct = {r["metric"]: r for r in confidence.metric_percentiles(df, ["metric"]).collect()}
    assert set(got) == set(pct) == set(groups)
    for g, own in groups.items():
        v = sorted((x for _, x in own), reverse=True)
        assert got[g]["median"] == v[len(v) // 2] and got[g]["best"] == v[0] and got[g]["random"] == min(own)[1] and got[g]["n"] == len(v)
        for name, q in (("median", 50), ("pct90", 90), ("pct99", 99)):
            assert pct[g][name] == pytest.approx(np.percentile(v, q), rel=1e-12)
    assert confidence.metric_percentiles(df.limit(0), ["metric"]).count() == 0


def test_nearest_goes_as_far_as_it_must(spark):
    rng = random.Random(2)
    points = [(0, i, x, 0.0, 0.0) for i, x in enumerate((0.0, 3.0, 20.0, 500.0))] + [(1, i, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(60)] + [(2, 0, 1.0, 1.0, 1.0), (3, 0, 0.0, 0.0, 0.0), (3, 1, 0.0, 0.0, 1000.0)]
    df = spark.createDataFrame(points, "pdb_id long, atom_idx long, x double, y double, z double")
    got = Counter((r["pdb_id"], r["i"], r["j"], r["rank"]) for r in spatial.nearest(df, 2, 4.0).collect())
    want = Counter()
    for s, i, *p in points:
        others = sorted((round(math.dist(p, q), 9), j) for t, j, *q in points if t == s and j != i)
        want.update((s, i, j, k) for k, (_, j) in enumerate(others[:2], 1))
    assert got == want
    assert spatial.nearest(df.limit(0), 2, 4.0).count() == 0


def test_draws_follow_the_weights(spark):
    weights = {f"k{i:03d}": float(i % 7) for i in range(300)} | {"heavy": 300.0}
    df = spark.createDataFrame(list(weights.items()), "k string, w double").repartition(5)
    for block in (3, 1024):
        draws = sampling.weighted_draws(df, "w", 20_000, "k", block=block).collect()
        assert sorted(r["draw"] for r in draws) == list(range(20_000))
        n, total = Counter(r["k"] for r in draws), sum(weights.values())
        assert all(weights[k] > 0 for k in n)
        assert n["heavy"] / 20_000 == pytest.approx(300 / total, rel=0.08)
        assert sum(n[k] for k in n if k != "heavy" and weights[k] == 6.0) / 20_000 == pytest.approx(6 * sum(w == 6.0 for w in weights.values()) / total, rel=0.1)
    assert sampling.weighted_draws(df.where("w < 0"), "w", 5, "k").count() == 0


def plain_assignment(keys, workers):
    n = len(keys) // workers
    heap, count, out = [(0.0, w) for w in range(workers)], [0] * workers, []
    for i, k in enumerate(keys):
        if i >= n * workers:
            out.append(i - n * workers)
            continue
        load, w = heapq.heappop(heap)
        out.append(w)
        count[w] += 1
        if count[w] < n:
            heapq.heappush(heap, (load + k * k, w))
    return out


def test_assignment_by_ranges(spark):
    rng = random.Random(3)
    keys = sorted((rng.randrange(1, 2000) for _ in range(3007)), reverse=True)
    df = spark.createDataFrame(list(enumerate(keys)), "i long, k long").repartition(6)
    one = {r["i"]: r["worker"] for r in sampling.balanced_assignment(df, "k", "i", 4).collect()}
    assert [one[i] for i in range(len(keys))] == plain_assignment([float(k) for k in keys], 4)
    many = {r["i"]: r["worker"] for r in sampling.balanced_assignment(df, "k", "i", 4, range_rows=60, fan_in=3).collect()}
    count, load = Counter(many.values()), Counter()
    for i, w in many.items():
        load[w] += keys[i] ** 2
    assert set(many) == set(range(3007)) and max(count.values()) - min(count.values()) <= 1
    assert max(load.values()) < 1.01 * min(load.values())


def test_copies_over_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i, i % 3) for i in range(50)], "entity long, n long")
        rows = annotations.entity_copies(df, lambda n: n).orderBy("entity", "copy").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["chain"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == sum(i % 3 for i in range(50))


def test_pairing_is_bounded_before_the_shuffle(spark):
    rows = [("q1", i, "a") for i in range(50)] + [("q2", i, "a") for i in range(7)] + [("q1", 90, "b"), ("q2", 91, "")]
    df = spark.createDataFrame(rows, "query string, row long, species string")
    out = alignment.pair_by_species(df, 5)
    assert sorted((r["query"], r["row"], r["nth"]) for r in out.collect()) == sorted((q, i, i + 1) for q in ("q1", "q2") for i in range(5))
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
