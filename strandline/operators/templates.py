"""Template hits: reasons to reject, selection, cut-off dates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.kernels import global_alignment, ids, typed


def reject_reason(release: Column, cutoff: Column, aligned: Column, query_length: Column, hit_length: Column, is_part: Column, least_ratio: float = 0.1, most_part: float = 0.95, least_residues: int = 10) -> Column:
    """The first reason that holds, else null: after the cut-off, poorly aligned, a near copy of the query, too short."""
    return (
        F.when(F.coalesce(release > cutoff, F.lit(False)), "date")
        .when(aligned / query_length <= least_ratio, "align_ratio")
        .when(is_part & (hit_length / query_length > most_part), "duplicate")
        .when(hit_length < least_residues, "length")
    )


def select_hits(hits: DataFrame, most: int, score: str = "sum_probs", sequence: str = "hit_sequence", order: str = "hit") -> DataFrame:
    """The best hits of each query: by score (null as 0), one for each sequence, and at most `most`."""
    rows = hits.withColumn("_s", F.coalesce(F.col(score), F.lit(0.0)))
    best = rows.groupBy("query", sequence).agg(F.min(F.struct((-F.col("_s")).alias("m"), order)).alias("b"))
    best = best.select("query", sequence, (-F.col("b.m")).alias("score"), F.col(f"b.{order}").alias(order))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), order)))
    return ranked.where(F.col("rank") <= most)


def index_maps(hits: DataFrame, least_identity: float) -> DataFrame:
    """query, hit, mapping, identity, error: query places (from 0) of the residues that a hit's own chain pairs with.

    hits: query, hit, query_seq, hit_seq. Each pair of sequences is aligned in its own row; error tells an absent chain and
    too few equal residues, and the mapping is null there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, t in zip(pdf["query_seq"], pdf["hit_seq"]):
                if not q or not t:
                    out.append((None, None, "no sequence"))
                    continue
                a, b = global_alignment(q, t)
                at, to, pairs, same = -1, -1, {}, 0
                for x, y in zip(a, b):
                    at, to = at + (x != "-"), to + (y != "-")
                    if x != "-" and y != "-":
                        pairs[at] = to
                        same += x == y
                share = same / len(pairs) if pairs else None
                bad = share is not None and share < least_identity
                out.append((None, share, "identity") if bad else (pairs, share, None))
            yield pd.DataFrame({"query": pdf["query"], "hit": pdf["hit"], "mapping": [m for m, _, _ in out], "identity": [s for _, s, _ in out], "error": ids([e for _, _, e in out])})

    return hits.select("query", "hit", "query_seq", "hit_seq").mapInPandas(run, f"{typed(hits, 'query', 'hit')}, mapping map<int,int>, identity double, error string")


def assembled(tokens: DataFrame, features: DataFrame, chains: DataFrame, most: int, values: dict[str, Column], shortest: int = 5) -> DataFrame:
    """pdb_id, token, template (from 0) and values: the template features of every token, `most` templates each.

    tokens: pdb_id, token, entity_id, place (in the chain's sequence); features: pdb_id, entity_id, template, place and the columns of
    values; chains: pdb_id, entity_id, is_protein, length. values names the columns and what stands where there is no
    feature: other molecules, sequences under `shortest`, templates that an entity lacks. Copies of an entity share its features.
    """
    fit = chains.where(F.col("is_protein") & (F.col("length") >= shortest)).select("pdb_id", "entity_id").distinct()
    own = features.where(F.col("template") < most).join(fit, ["pdb_id", "entity_id"], "left_semi").select("pdb_id", "entity_id", F.col("template").cast("int").alias("template"), "place", *values)
    grid = tokens.select("pdb_id", "token", "entity_id", "place", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("template"))
    rows = grid.join(own, ["pdb_id", "entity_id", "template", "place"], "left")
    return rows.select("pdb_id", "token", "template", *[F.coalesce(F.col(v), fill).alias(v) for v, fill in values.items()])
