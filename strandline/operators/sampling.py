"""Weighted sampling and balanced assignment.

Draws come from hashes of keys and a seed, so they are the same on any cluster:
equal in distribution to a pseudo-random generator's, not draw for draw.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.index_table import with_row_number
from strandline.shared import materialise


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) for each key."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def weighted_sample(rows: DataFrame, weight: str, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows without replacement, with chances in proportion to their weights: the n least -ln(u) / w."""
    priority = -F.log(uniform(seed, *keys)) / F.col(weight)
    return rows.where(F.col(weight) > 0).withColumn("_p", priority).orderBy("_p", *keys).limit(n).drop("_p")


#: Rows of a block of keys, the lowest level that a draw descends to.
BLOCK = 1024


def _descend(edges: Column, x: Column, most: int) -> Column:
    """Index of the last of the edges (sorted array of (lo, ...)) whose lo is below x, by binary search over up to `most`."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda k, step: F.when(F.coalesce(F.get(edges, k + step)["lo"] < x, F.lit(False)), k + step).otherwise(k))


def _edges(sums: DataFrame, by: list[str], at: str) -> DataFrame:
    """by, edges: the sorted array of (lo, at) of the weights w before each `at`."""
    before = F.coalesce(F.sum("w").over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return sums.withColumn("lo", before).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lo", at))).alias("edges"), F.sum("w").alias("total"))


def weighted_draws(rows: DataFrame, weight: str, n: int, key: str, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """n draws with replacement (draw, key), with chances in proportion to the weights.

    The keys are sorted into parts, and these into blocks; a draw finds its part, its block and its key by binary search over
    prefix sums, so it meets the rows of one block only. The parts' sums go to every task; there are
    as many as the sorted table has partitions.
    """
    spark = rows.sparkSession
    placed = rows.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("w")).orderBy(key).withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "draws-sorted")
    inside = W.partitionBy("part").orderBy(key)
    placed = materialise(placed.withColumn("block", F.floor((F.row_number().over(inside) - 1) / block)), "draws-blocks")
    blocks = materialise(placed.groupBy("part", "block").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")), "draws-sums")
    parts = blocks.groupBy("part").agg(F.sum("w").alias("w")).withColumn("all", F.lit(0))
    most = blocks.agg(F.countDistinct("part"), F.max("block")).head()
    whole = _edges(parts, ["all"], "part").select("edges", "total")
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("u", uniform(seed, "draw")).crossJoin(F.broadcast(whole)).withColumn("x", F.col("u") * F.col("total"))
    at = F.get("edges", _descend(F.col("edges"), F.col("x"), max(1, most[0] or 1)))
    draws = draws.select("draw", at.alias("e"), "x").select("draw", F.col("e.part").alias("part"), (F.col("x") - F.col("e.lo")).alias("x"))
    inner = _edges(blocks.select("part", "block", "w"), ["part"], "block").select("part", "edges")
    draws = draws.join(inner, "part")
    at = F.get("edges", _descend(F.col("edges"), F.col("x"), max(1, (most[1] or 0) + 1)))
    draws = draws.select("draw", "part", at.alias("e"), "x").select("draw", "part", F.col("e.block").alias("block"), (F.col("x") - F.col("e.lo")).alias("x"))
    keys = placed.groupBy("part", "block").agg(F.sort_array(F.collect_list(F.struct(key, "w"))).alias("k"))
    # Within a block: the first key whose running weight reaches the draw; rounding may leave the last.
    chosen = F.aggregate(
        "k", F.struct(F.col("x").cast("double").alias("left"), F.lit(None).cast(rows.schema[key].dataType).alias("key")),
        lambda s, e: F.struct((s["left"] - e["w"]).alias("left"), F.when(s["key"].isNotNull() & (s["left"] <= 0), s["key"]).otherwise(e[key]).alias("key")), lambda s: s["key"],
    )
    return draws.join(keys, ["part", "block"]).select("draw", chosen.alias(key))


def _greedy(pdf: pd.DataFrame, key: str, order: str, workers: int) -> list[int]:
    """Workers of the rows by falling key: the least loaded (sum of squares) that has room; what is left over goes one to each."""
    n = len(pdf) // workers
    heap, count, out = [(0.0, w) for w in range(workers)], [0] * workers, []
    for i, k in enumerate(pdf.sort_values([key, order], ascending=[False, True])[key].tolist()):
        if i >= n * workers:
            out.append(i - n * workers)
            continue
        load, w = heapq.heappop(heap)
        out.append(w)
        count[w] += 1
        if count[w] < n:
            heapq.heappush(heap, (load + float(k) ** 2, w))
    return out


def balanced_assignment(rows: DataFrame, key: str, order: str, workers: int, range_rows: int = 1 << 16, fan_in: int = 16) -> DataFrame:
    """order, key, worker: each worker gets as many rows as the others, and about the same sum of squared keys.

    Rows by falling key are cut into ranges of range_rows (rounded to a multiple of the workers). Within a range each row goes to the
    least loaded worker that has room. Ranges are then joined, fan_in at a time in a tree: the most loaded worker of a range becomes the
    least loaded of those joined before it. With one range that is the plain greedy rule; no task holds more than a range, or
    the loads of fan_in ranges.
    """
    size = workers * max(1, range_rows // workers)
    numbered = with_row_number(rows.select(order, key), [F.desc(key), F.asc(order)], "_n")
    placed = numbered.withColumn("_range", F.floor(F.col("_n") / size))
    kinds = f"{order} {rows.schema[order].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, order], ascending=[False, True])
        return pdf[[order, key, "_range"]].assign(_local=_greedy(pdf, key, order, workers))

    dealt = materialise(placed.select(order, key, "_range").groupBy("_range").applyInPandas(one, f"{kinds}, _range long, _local long"), "balanced")
    loads = dealt.groupBy("_range", "_local").agg(F.sum(F.pow(F.col(key).cast("double"), F.lit(2))).alias("load"))
    names = materialise(loads.select("_range", "_local", F.col("_range").alias("group"), F.col("_local").alias("worker"), "load"), "balanced-loads")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        total, out = np.zeros(workers), []
        for child, own in pdf.sort_values(["group", "worker"]).groupby("group", sort=True):
            load = np.zeros(workers)
            load[own["worker"].to_numpy()] = own["load"].to_numpy()
            to = np.empty(workers, dtype=np.int64)
            to[np.argsort(-load, kind="stable")] = np.argsort(total, kind="stable") if len(out) else np.argsort(-load, kind="stable")
            np.add.at(total, to, load)
            out.append(pd.DataFrame({"group": child, "worker": np.arange(workers), "to": to}))
        return pd.concat(out)

    while names.select("group").distinct().count() > 1:
        sums = names.groupBy("group", "worker").agg(F.sum("load").alias("load"))
        moved = sums.withColumn("up", F.floor(F.col("group") / fan_in)).groupBy("up").applyInPandas(join, "group long, worker long, to long")
        names = materialise(names.join(moved, ["group", "worker"]).select("_range", "_local", F.floor(F.col("group") / fan_in).alias("group"), F.col("to").alias("worker"), "load"), "balanced-loads")
    return dealt.join(names.select("_range", "_local", "worker"), ["_range", "_local"]).select(order, key, "worker")
