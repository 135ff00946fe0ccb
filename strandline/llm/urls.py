"""URL filter: host and path rules, and gradient-boosted trees on lexical features for all other URLs.

A rule has a host and a path prefix; it fits its host and all subdomains, and
of the rules that fit, the longest wins. URLs without a rule are judged by
boosted trees over length, depth, digit ratio, entropy, parameter counts and
statistics of suffixes and path heads. The trees learn from labelled URLs. Where
none are given, weak labels stand in: the verdicts of the rules, and for other URLs
whether a seed word stands in the host. The trees see no word, only lexical
features, so what they learn from the seeds reaches hosts that have none.

Statistics of a suffix or head leave out the URL's own fifth of the labels (a hash
of the URL), so a URL's label is in no feature that it is learned or judged by.

Defined results: a null URL, or one without ://, has an empty host and path and
is judged by the trees like any other; an empty table gives an empty result; with
labels of one kind only, that kind is the verdict; ties between rules of equal
length go to the one that sorts first; repeated rows give repeated results.

The statistics of suffixes are counted over all rows by the cluster. The trees are
fitted on the driver on at most `sample_rows` labelled rows in expectation, drawn by
id and URL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import textkernels as tk
from strandline.llm.common import bounded_batches, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict, host, path prefix
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Seeds: words in a host that label a URL as blocked, where no labels are given.
MARKED = ("spam", "casino", "porn", "xxx", "viagra", "poker", "escort", "torrent", "warez", "phish", "malware")


@dataclass(frozen=True)
class Boosting:
    #: Labelled rows that the trees are fitted on, in expectation.
    sample_rows: int = 20_000
    trees: int = 40
    depth: int = 4
    bins: int = 32
    rate: float = 0.3
    ridge: float = 1.0
    #: Probability from which a URL is blocked.
    threshold: float = 0.5
    #: Weight, in rows, of the overall share in a suffix's share.
    prior_rows: float = 20.0
    #: Parts of the labels, of which a URL's own is left out of its statistics.
    folds: int = 5


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule (host and path end to end) and verdict of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    name = reduce(lambda w, x: w.when(x[0], x[1][1] + x[1][2]), zip(fits[1:], ordered[1:]), F.when(fits[0], ordered[0][1] + ordered[0][2]))
    verdict = reduce(lambda w, x: w.when(x[0], x[1][0]), zip(fits[1:], ordered[1:]), F.when(fits[0], ordered[0][0]))
    return name, verdict


FEATURES = (
    "url length", "host length", "path length", "depth", "host labels", "digit ratio", "digit count", "entropy", "parameters", "hyphens", "capitals", "percent signs",
    "is https", "has fragment", "suffix share", "suffix rows", "head share",
)


def lexical(urls: pa.Array, host_n: np.ndarray, path_n: np.ndarray) -> np.ndarray:
    """The features of URLs that need no statistics (rows x 14)."""
    out = np.zeros((len(urls), 14))
    for a, b, data, offsets in tk.chunks(urls):
        n = np.diff(offsets)
        row = np.repeat(np.arange(b - a), n)
        counts = np.bincount(row * 128 + np.minimum(data, 127), minlength=(b - a) * 128).reshape(b - a, 128)
        total = np.maximum(n, 1)[:, None]
        share = counts / total
        entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
        at = lambda chars: counts[:, list(chars)].sum(axis=1)
        digits = at(range(48, 58))
        https = np.array([bytes(data[o : o + 5]) == b"https" for o in offsets[:-1]], dtype=float) if b > a else np.zeros(0)
        out[a:b] = np.stack(
            [n, host_n[a:b], path_n[a:b], at(b"/"), at(b"."), digits / total[:, 0], digits, entropy, at(b"&") + at(b"="), at(b"-"), at(range(65, 91)), at(b"%"), https, at(b"#")],
            axis=1,
        )
    return out


class Trees:
    """Boosted trees for the logistic loss, grown level by level on binned features."""

    def __init__(self, p: Boosting):
        self.p, self.edges, self.trees, self.base = p, [], [], 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = y.mean() if len(y) else 0.0
        self.base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        if not len(y) or share in (0.0, 1.0):
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.p.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned, score, n_bins = self._bin(x), np.full(len(y), self.base), self.p.bins + 1
        for _ in range(self.p.trees):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            node, splits = np.zeros(len(y), dtype=np.int64), []
            for level in range(self.p.depth):
                width = 1 << level
                best_gain, best = np.full(width, 1e-9), np.zeros((width, 2), dtype=np.int64)
                best[:, 1] = n_bins  # every row goes left
                for j in range(x.shape[1]):
                    cell = node * n_bins + binned[:, j]
                    g = np.bincount(cell, grad, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                    h = np.bincount(cell, hess, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + self.p.ridge) + (gt - gl) ** 2 / (ht - hl + self.p.ridge) - gt**2 / (ht + self.p.ridge)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    better = top > best_gain
                    best_gain[better] = top[better]
                    best[better] = np.stack([np.full(width, j), k], axis=1)[better]
                splits.append(best)
                node = node * 2 + (binned[np.arange(len(y)), best[node, 0]] > best[node, 1])
            leaves = 1 << self.p.depth
            value = self.p.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.p.ridge)
            self.trees.append((splits, value))
            score += value[node]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        if self.trees:
            binned, rows = self._bin(x), np.arange(len(x))
            for splits, value in self.trees:
                node = np.zeros(len(x), dtype=np.int64)
                for best in splits:
                    node = node * 2 + (binned[rows, best[node, 0]] > best[node, 1])
                score += value[node]
        return 1 / (1 + np.exp(-score))


def _featured(rows: DataFrame, keep: list[str]) -> tuple[DataFrame, T.StructType]:
    """rows has url, host_n, path_n, suffix_share, suffix_rows, head_share; adds features (array of doubles)."""
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))], names=[*keep, "features"])

    return rows.mapInArrow(run, schema), schema


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
    x = lexical(batch.column("url"), number("host_n"), number("path_n"))
    return np.column_stack([x, number("suffix_share"), np.log1p(number("suffix_rows")), number("head_share")])


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, marked: tuple[str, ...] = MARKED, p: Boosting = Boosting(), labels: DataFrame | None = None
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, block_probability.

    labels: columns url, blocked (boolean) to learn from; by default the rows'
    own rules and marked words. These name only some of what is to be blocked, so a row that they don't name is
    unlabelled, not harmless: the trees learn the chance of being named, and that of being blocked is this chance over its mean
    among named rows (positive and unlabelled learning, Elkan and Noto 2008). Each URL is judged by trees and statistics
    of the other folds, so none is judged by its own label; two labels of one URL both count.
    """
    spark = pages.sparkSession
    bounded_batches(spark)

    def prepared(df: DataFrame, *more: Column) -> DataFrame:
        host, path = host_path(F.col(url_col))
        df = df.select(*more, F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        suffix = F.substring_index("host", ".", -2)
        head = F.concat_ws("/", F.substring_index("host", ".", -1), F.element_at(F.split("path", "/", 3), F.least(F.lit(2), F.size(F.split("path", "/", 3)))))
        has_mark = reduce(lambda a, b: a | b, [F.contains("host", F.lit(m)) for m in marked]) if marked else F.lit(False)
        df = df.select("*", rule.alias("rule"), verdict.alias("by_rule"), suffix.alias("suffix"), head.alias("head"))
        return df.select("*", F.coalesce(F.col("by_rule") == "block", has_mark).alias("own_label"), F.length("host").alias("host_n"), F.length("path").alias("path_n"), F.pmod(F.xxhash64("url", F.lit(4)), F.lit(p.folds)).cast("int").alias("fold"))

    rows = prepared(pages, F.col(id_col).alias("id"))
    if labels is None:
        learned = rows.withColumn("blocked", F.col("own_label"))
    else:
        labels = labels.where("blocked IS NOT NULL").select("url", "blocked").distinct()  # else a hot URL's rows would share one draw
        learned = prepared(labels.withColumnRenamed("url", url_col), F.col("blocked"), F.xxhash64(url_col).alias("id"))
    total = learned.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("blocked").cast("double")), F.lit(0.0)).alias("share")).first()

    def statistics(key: str) -> DataFrame:
        """For each value of key and each fold: share of blocked labels and their number, without the fold's own."""
        counts = learned.groupBy(key, "fold").agg(F.sum(F.col("blocked").cast("double")).alias("b"), F.count(F.lit(1)).alias("n"))
        totals = counts.groupBy(key).agg(F.sum("b").alias("tb"), F.sum("n").alias("tn")).withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(p.folds)])))
        own = counts.select(F.col(key).alias("_key"), F.col("fold").alias("_fold"), "b", "n")
        rest = totals.join(own, (F.col(key) == F.col("_key")) & (F.col("fold") == F.col("_fold")), "left")
        blocked, n = F.col("tb") - F.coalesce("b", F.lit(0.0)), F.col("tn") - F.coalesce("n", F.lit(0))
        return rest.select(key, "fold", ((blocked + p.prior_rows * total["share"]) / (n + p.prior_rows)).alias(f"{key}_share"), n.alias(f"{key}_rows"))

    # Left joins on the small side's size as Spark finds it at run time; hot keys are split by adaptive execution.
    def with_statistics(df: DataFrame) -> DataFrame:
        df = df.join(statistics("suffix"), ["suffix", "fold"], "left").join(statistics("head").drop("head_rows"), ["head", "fold"], "left")
        return df.fillna({"suffix_share": total["share"], "suffix_rows": 0, "head_share": total["share"]})

    million = 1_000_000
    sample = learned.where(F.pmod(F.xxhash64("id", "url", F.lit(9)), F.lit(million)) < min(million, -(-million * p.sample_rows // max(1, total["n"]))))
    got = _featured(with_statistics(sample), ["blocked", "fold"])[0].toArrow()
    x = np.array(got.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y, fold = np.array(got.column("blocked").to_pylist(), dtype=float), got.column("fold").to_numpy()
    models = [Trees(p).fit(x[fold != k], y[fold != k]) for k in range(p.folds)]
    # Of labels that name only some of what is to be blocked: the chance that such a URL is named, by trees that have not seen it.
    seen = 1.0
    if labels is None and y.any():
        seen = float(np.concatenate([m.probability(x[(fold == k) & (y == 1)]) for k, m in enumerate(models)]).mean())
    trees = spark.sparkContext.broadcast((models, max(seen, 1e-6)))

    keep = ["id", "host", "path", "rule", "by_rule"]
    scored = with_statistics(rows)
    schema = T.StructType([scored.schema[c] for c in keep] + [T.StructField("block_probability", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, seen = trees.value
        for batch in batches:
            x, fold, named = _matrix(batch), batch.column("fold").to_numpy(zero_copy_only=False), np.zeros(batch.num_rows)
            for k, model in enumerate(models):
                named[fold == k] = model.probability(x[fold == k])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.minimum(named / seen, 1.0))], names=[*keep, "block_probability"])

    found = scored.mapInArrow(run, schema)
    verdict = F.coalesce("by_rule", F.when(F.col("block_probability") >= p.threshold, "block").otherwise("allow"))
    return found.select("id", "host", "path", "rule", verdict.alias("verdict"), "block_probability")


def op9_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the rules and the trees."""
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
