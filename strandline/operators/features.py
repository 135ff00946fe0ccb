"""Features of templates, constraints, clusters and samples: distance bins, token expansion, cluster names, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def a3m_text(rows: DataFrame) -> DataFrame:
    """rows (query, pos, seq) -> query, text: numbered records in order of pos."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("seq", F.lit("")).alias("seq"))))
    record = lambda r, i: F.concat(F.lit(">sequence "), (i + 1).cast("string"), F.lit("\n"), r["seq"], F.lit("\n"))
    return rows.groupBy("query").agg(ordered.alias("_r")).select("query", F.array_join(F.transform("_r", record), "").alias("text"))


def squared_distance_bin(d2: Column, low: float, high: float, bins: int) -> Column:
    """Bin k where lower_k^2 < d2 < lower_(k+1)^2, the last up to 1e8; null on an edge and outside."""
    edges = [(low + (high - low) * k / max(bins - 1, 1)) ** 2 for k in range(bins)] + [1e8]
    k = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < d2)) - 1
    on_edge = F.exists(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e == d2)
    return F.when((k >= 0) & (k < bins) & ~on_edge, k)


def cluster_ids(rows: DataFrame, residues: DataFrame, standard: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds cluster_id to the index rows; of modified chains the cluster names their other residues, sorted.

    rows: pdb_id, type, chain_1_id, sub_mol_1_type, cluster_1_id, the same of side
    2, mol_1_type, mol_type_group; residues: pdb_id, chain_id, res_name; standard:
    the standard residues of modified_prot, modified_dna and modified_rna.
    """
    names = residues.groupBy("pdb_id", "chain_id").agg(F.array_sort(F.collect_set("res_name")).alias("_names"))
    out = rows
    for i in "12":
        kind, cluster = F.col(f"sub_mol_{i}_type"), F.col(f"cluster_{i}_id")
        chains = names.select("pdb_id", F.col("chain_id").alias(f"chain_{i}_id"), "_names")
        others = F.raise_error(F.concat(F.lit("unknown sub_mol_type: "), kind)).cast("array<string>")
        for name, known in standard.items():
            others = F.when(kind == name, F.array_except(F.coalesce("_names", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in known]))).otherwise(others)
        joined = out.join(chains, ["pdb_id", f"chain_{i}_id"], "left")
        out = joined.withColumn(f"cluster_{i}_id", F.when(F.contains(kind, F.lit("modified_")), F.concat(cluster, F.lit("_"), F.array_join(others, "_"))).otherwise(cluster)).drop("_names")
    both = F.when(F.col("type") == "chain", F.col("cluster_1_id")).otherwise(F.array_join(F.array_sort(F.array("cluster_1_id", "cluster_2_id")), ":"))
    polymer = F.when(F.col("mol_1_type") == "ligand", F.col("cluster_2_id")).otherwise(F.col("cluster_1_id"))
    return out.select(*rows.columns, F.when(F.col("mol_type_group").isin("ligand_prot", "ligand_nuc"), polymer).otherwise(both).alias("cluster_id"))


def without_polymer_chain_bonds(bonds: DataFrame, atoms: DataFrame, poly_types: DataFrame) -> DataFrame:
    """bonds (pdb_id, i, j) less those between different chains of polymers; atoms: pdb_id, atom_idx, chain_id, entity_id; poly_types: pdb_id, entity_id."""
    polymers = atoms.join(poly_types.select("pdb_id", "entity_id").distinct(), ["pdb_id", "entity_id"], "left_semi")
    ends = [polymers.select("pdb_id", F.col("atom_idx").alias(k), F.col("chain_id").alias(f"_c{k}")) for k in "ij"]
    between = bonds.select("pdb_id", "i", "j").join(ends[0], ["pdb_id", "i"]).join(ends[1], ["pdb_id", "j"]).where("_ci <> _cj")
    return bonds.join(between.select("pdb_id", "i", "j").distinct(), ["pdb_id", "i", "j"], "left_anti")


def samples_of(table: DataFrame, key: str, arrays: list[str], shared: list[str]) -> DataFrame:
    """One row for each sample of columns that hold an array of all samples; shared columns are copied. Unequal lengths are an error."""
    same = F.forall(F.array(*[F.size(a) for a in arrays]), lambda n: n == F.size(arrays[0]))
    zipped = F.when(same, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    return table.select(key, *shared, F.posexplode(zipped).alias("sample", "_z")).select(key, *shared, "sample", *[F.col(f"_z.{a}").alias(a) for a in arrays])


def stacked(samples: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """The reverse of samples_of: arrays in order of sample; a missing value keeps its place as null."""
    rows = F.sort_array(F.collect_list(F.struct("sample", *arrays)))
    return samples.groupBy(key).agg(rows.alias("_r")).select(key, *[F.col(f"_r.{a}").alias(a) for a in arrays])


def expand_columns(cells: DataFrame, token_map: DataFrame, values: list[str]) -> DataFrame:
    """Alignment cells (query, row, col, values) on new tokens: query, row, col, values; a new token that nothing maps to is 0.

    token_map: query, old, new; the new tokens run from 0 to the largest.
    """
    last = token_map.groupBy("query").agg(F.max("new").alias("_last"))
    moved = cells.join(token_map.withColumnRenamed("old", "col"), ["query", "col"], "left").select("query", "row", F.col("new").cast("long").alias("col"), *values)
    # A row of the alignment is one list, so its empty columns are added where it lies and the grid is not shuffled. A row that nothing maps has an empty list.
    kept = moved.groupBy("query", "row").agg(F.collect_list(F.when(F.col("col") >= 0, F.struct("col", *values))).alias("_cells"))
    every = F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))
    null = [F.lit(None).cast(cells.schema[v].dataType).alias(v) for v in values]
    empty = F.transform(F.array_except(every, F.col("_cells.col")), lambda c: F.struct(c.alias("col"), *null))
    rows = kept.join(last, "query").select("query", "row", F.explode(F.concat("_cells", empty)).alias("_c"))
    return rows.select("query", "row", "_c.col", *[F.coalesce(f"_c.{v}", F.lit(0)).alias(v) for v in values])


def schedule(config: float | dict, t: Column) -> Column:
    """A number or const is constant; exp_interpolation goes from start to end, linear where alpha is 0."""
    if isinstance(config, (int, float)):
        return F.lit(float(config))
    if not isinstance(config, dict):
        raise TypeError(f"unsupported schedule: {type(config)}")
    kind = str(config["type"]).lower()
    if kind == "const":
        return F.lit(float(config["value"]))
    if kind != "exp_interpolation":
        raise ValueError(f"unknown schedule type: {kind}")
    start, end, alpha = float(config["start"]), float(config["end"]), float(config.get("alpha", 0.0))
    part = t if alpha == 0 else (F.exp(alpha * t) - 1) / (F.exp(F.lit(alpha)) - 1)
    return F.lit(start) + (end - start) * part
