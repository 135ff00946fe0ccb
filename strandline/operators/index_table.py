"""The chain and interface index: filters, keys, weights, statistics.

Columns: pdb_id, type, entity_{1,2}_id, cluster_id, mol_{1,2}_type, num_tokens,
release_date; keys are strings and compare as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.graph import checkpointed

#: Weight of a row's type, and of its number of chains of each molecule type.
BETA = {"chain": 0.5, "interface": 1.0}
ALPHA = {"prot": 3.0, "nuc": 3.0, "ligand": 1.0}


def entity_key() -> Column:
    """pdb_id with the sorted entity pair; a missing entity is the text None."""
    e1, e2 = F.coalesce("entity_1_id", F.lit("None")), F.coalesce("entity_2_id", F.lit("None"))
    return F.concat_ws("_", "pdb_id", F.least(e1, e2), F.greatest(e1, e2))


def type_pair(missing: str = "intra") -> tuple[Column, Column]:
    """The unordered pair of molecule types."""
    m1, m2 = F.coalesce("mol_1_type", F.lit(missing)), F.coalesce("mol_2_type", F.lit(missing))
    return F.least(m1, m2), F.greatest(m1, m2)


def sample_weights(index: DataFrame, beta: dict = BETA, alpha: dict = ALPHA, eps: float = 1e-9) -> DataFrame:
    """Adds key, member_num, cluster_size and weight.

    weight = beta(type) * sum of alpha over the row's chains / (distinct keys of
    the cluster + eps) / rows of the key. Both counts come from one aggregation
    by (cluster, key), which combines map-side, so a hot cluster is a row for each key.
    """
    rows = index.withColumn("key", entity_key())
    of = lambda m, col: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(col)), F.lit(0.0))
    counts = rows.groupBy("cluster_id", "key").agg(F.count(F.lit(1)).alias("n"))
    members = counts.groupBy("key").agg(F.sum("n").alias("member_num"))
    clusters = counts.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    weight = of(beta, "type") * (of(alpha, "mol_1_type") + F.when(F.col("mol_2_type").isNull(), 0.0).otherwise(of(alpha, "mol_2_type"))) / (F.col("cluster_size") + eps) / F.col("member_num")
    return rows.join(members, "key").join(clusters, "cluster_id", "left").withColumn("weight", weight)


def filter_chain(
    index: DataFrame, pdb_ids: DataFrame | None = None, least_tokens: int | None = None, most_tokens: int | None = None, excluded: DataFrame | None = None, eval_types: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """The index query: id list, token range, excluded tuples, evaluation types, order by tokens, limit on ids.

    excluded: columns named like index columns; rows that equal one of its rows
    in all of them go.
    """
    if pdb_ids is not None:
        index = index.join(pdb_ids.select("pdb_id").distinct(), "pdb_id", "left_semi")
    if most_tokens is not None:
        index = index.where(F.col("num_tokens") <= most_tokens)
    if least_tokens is not None:
        index = index.where(F.col("num_tokens") >= least_tokens)
    if excluded is not None:
        index = index.join(excluded.distinct(), excluded.columns, "left_anti")
    if eval_types is not None:
        index = index.where(F.col("eval_type").isin(eval_types))
    if limit is not None:
        first = index.groupBy("pdb_id").agg(F.max("num_tokens").alias("_most")).orderBy(F.desc("_most"), "pdb_id").limit(limit)
        index = index.join(first.select("pdb_id"), "pdb_id", "left_semi")
    return index


def type_pair_stats(index: DataFrame) -> DataFrame:
    """Rows, share in percent, clusters and structures of each unordered type pair."""
    low, high = type_pair()
    stats = index.groupBy(low.alias("type_a"), high.alias("type_b")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster_id").alias("clusters"), F.countDistinct("pdb_id").alias("structures"))
    return stats.crossJoin(F.broadcast(stats.agg(F.sum("n").alias("_all")))).withColumn("percent", F.round(100 * F.col("n") / F.col("_all"), 6)).drop("_all")


def merge_datasets(datasets: list[tuple[DataFrame, float]], weight_col: str = "weight") -> DataFrame:
    """Union of datasets; a row's weight is its share of its dataset's weight, times the dataset's."""
    parts = []
    for i, (df, w) in enumerate(datasets):
        total = df.agg(F.sum(weight_col).alias("_total"))
        parts.append(df.crossJoin(F.broadcast(total)).withColumn("merged_weight", F.col(weight_col) / F.col("_total") * F.lit(float(w))).withColumn("dataset", F.lit(i)).drop("_total"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_pair_per_entity(index: DataFrame, order: list) -> DataFrame:
    """The first interface row of each unordered entity pair of a structure."""
    rows = index.where("type = 'interface'").withColumn("key", entity_key())
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(*order))).where("_n = 1").drop("_n")


def majority_type(index: DataFrame, by: str, of: str) -> DataFrame:
    """The most frequent value of each group; of ties the largest."""
    counts = index.where(F.col(of).isNotNull()).groupBy(by, of).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.max(F.struct("n", of)).alias("m")).select(by, F.col(f"m.{of}").alias("majority"), F.col("m.n").alias("n"))


def eval_type(index: DataFrame) -> DataFrame:
    """Adds eval_type: the sorted type pair, or intra and the type; nucleic pairs are split by an odd or even first entity."""
    low, high = type_pair()
    nuc = F.when(F.col("entity_1_id").cast("long") % 2 == 0, "dna").otherwise("rna")
    base = F.when(low == "intra", F.concat(F.lit("intra_"), high)).when(high == "intra", F.concat(F.lit("intra_"), low)).otherwise(F.concat_ws("_", low, high))
    return index.withColumn("eval_type", F.when(base == "intra_nuc", F.concat(F.lit("intra_"), nuc)).when(base == "nuc_prot", F.concat(nuc, F.lit("_prot"))).otherwise(base))


def peptide_filter(index: DataFrame, shortest: int = 16) -> DataFrame:
    """Drops rows whose only polymer is a protein shorter than a peptide; flags the peptides that stay."""
    peptide = (F.col("mol_1_type") == "prot") & (F.col("num_tokens") < shortest)
    alone = peptide & F.coalesce(~F.col("mol_2_type").isin("prot", "nuc"), F.lit(True))
    return index.withColumn("is_peptide", peptide).where(~alone)


def strided_shard(rows: DataFrame, order: list, replicas: int) -> DataFrame:
    """Deals the rows of an order to replicas in turn: draw is a row's place, replica its place modulo their number."""
    return with_row_number(rows, order, "draw").withColumn("replica", F.pmod("draw", F.lit(replicas)))


def with_row_number(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds a number from 0 in the order, over all rows: ranges are sorted apart and shifted by the sizes of those before.

    The sorted rows are checkpointed: evaluated twice, they could be cut into other
    ranges the second time, and the sizes would belong to other parts.
    """
    placed = checkpointed(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_at", "_before")
