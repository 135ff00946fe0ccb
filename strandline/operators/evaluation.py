"""The index as it is evaluated: relabelled molecules, rows that are not scored, and what belongs to a ligand and its pocket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Polymer types that are proteins, and those that are too rare to be scored.
PROTEINS = ("polypeptide(D)", "polypeptide(L)")
RARE = ("polydeoxyribonucleotide/polyribonucleotide hybrid", "peptide nucleic acid", "polypeptide(D)")
#: Residues from which on a protein is no peptide.
SHORTEST = 16
KEPT = ("mol_1_type", "mol_2_type", "cluster_1_id", "cluster_2_id", "cluster_id")


def ligand_types(codes: DataFrame, sets: DataFrame) -> DataFrame:
    """code, kind: glycans if any part of the code (parts are joined by _) is one; else ions or excluded_ligand if the whole is.

    codes: code, distinct; sets: code, set (glycan, ion or excluded). Codes of no set have no row.
    """
    parts = codes.select("code", F.explode(F.split("code", "_")).alias("part"))
    glycans = parts.join(sets.where("set = 'glycan'").select(F.col("code").alias("part")).distinct(), "part", "left_semi").select("code", F.lit(0).alias("rank"), F.lit("glycans").alias("kind"))
    whole = codes.join(sets.where("set <> 'glycan'"), "code").select("code", F.when(F.col("set") == "ion", 1).otherwise(2).alias("rank"), F.when(F.col("set") == "ion", "ions").otherwise("excluded_ligand").alias("kind"))
    return glycans.unionByName(whole).groupBy("code").agg(F.min(F.struct("rank", "kind")).alias("b")).select("code", "b.kind")


def evaluation_index(index: DataFrame, entities: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows to be scored, with peptides, glycans, ions and excluded ligands named as such; what they were stays as ori_....

    index: pdb_id, type (chain or interface), entity_{1,2}_id (null on the second side of a chain), mol_{1,2}_type, cluster_{1,2}_id,
    cluster_id. entities: pdb_id, entity_id, poly_type, residues, is_standard (all residues are).

    Not scored: peptides alone or with peptides, rare polymers, and interfaces without a protein or nucleic acid (a
    peptide is neither). Adds entity_{1,2}_mod_res_peptide (y or n) and mol_type_group.
    """
    protein = F.col("poly_type").isin(*PROTEINS)
    short = protein & (F.col("residues") < SHORTEST)
    facts = entities.select("pdb_id", "entity_id", F.col("poly_type").isin(*RARE).alias("rare"), short.alias("peptide"), (short & ~F.col("is_standard")).alias("modified"))
    rows = index.select("*", *[F.col(c).alias(f"ori_{c}") for c in KEPT])
    for i in "12":
        side = facts.select("pdb_id", F.col("entity_id").alias(f"entity_{i}_id"), *[F.col(c).alias(f"{c}_{i}") for c in ("rare", "peptide", "modified")])
        rows = rows.join(side, ["pdb_id", f"entity_{i}_id"], "left")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    absent = lambda i: F.col(f"entity_{i}_id").isNull() | (F.col(f"entity_{i}_id") == "")
    alone = (true("peptide_1") | absent("1")) & (true("peptide_2") | absent("2"))
    for i in "12":
        rows = rows.withColumn(f"mol_{i}_type", F.when(true(f"peptide_{i}"), "peptide").otherwise(F.col(f"mol_{i}_type")))
    polymer = lambda i: F.coalesce(F.col(f"mol_{i}_type").isin("nuc", "prot"), F.lit(False))
    rows = rows.where(~alone & ~true("rare_1") & ~true("rare_2") & ((F.col("type") != "interface") | polymer("1") | polymer("2")))
    for i in "12":
        kinds = ligand_types(index.where(F.col(f"mol_{i}_type") == "ligand").select(F.col(f"cluster_{i}_id").alias("code")).where("code IS NOT NULL").distinct(), sets)
        rows = rows.join(kinds.select(F.col("code").alias(f"cluster_{i}_id"), F.col("kind").alias(f"kind_{i}")), f"cluster_{i}_id", "left")
        rows = rows.withColumn(f"mol_{i}_type", F.when(F.col(f"mol_{i}_type") == "ligand", F.coalesce(f"kind_{i}", F.lit("ligand"))).otherwise(F.col(f"mol_{i}_type")))
    group = F.when(F.col("type") == "chain", F.concat(F.lit("intra_"), "mol_1_type")).otherwise(F.concat_ws("_", F.array_sort(F.array("mol_1_type", "mol_2_type"))))
    flag = lambda i: F.when(true(f"modified_{i}"), "y").otherwise("n").alias(f"entity_{i}_mod_res_peptide")
    return rows.select(*index.columns, *[f"ori_{c}" for c in KEPT], flag("1"), flag("2"), group.alias("mol_type_group"))


def ligand_index(index: DataFrame, ligands: DataFrame) -> DataFrame:
    """Rows of each structure's ligand (is_pocket 0), and chains and interfaces among the chains that it touches (is_pocket 1).

    index: pdb_id, type, chain_1_id, chain_2_id (null for a chain); ligands: pdb_id, chain_id. Only structures with a ligand are kept.
    """
    chosen = ligands.select("pdb_id", F.col("chain_id").alias("_lig")).distinct()
    one, two = F.col("chain_1_id"), F.nullif(F.col("chain_2_id"), F.lit(""))
    met = index.join(chosen, "pdb_id").where((one == F.col("_lig")) | F.coalesce(two == F.col("_lig"), F.lit(False)))
    partner = F.when(one == F.col("_lig"), two).otherwise(one)
    pocket = met.select("pdb_id", "_lig", partner.alias("_p")).where("_p IS NOT NULL").distinct()
    first = index.join(pocket.select("pdb_id", "_lig", F.col("_p").alias("chain_1_id")), ["pdb_id", "chain_1_id"])
    alone = first.where("type = 'chain'")
    both = first.where("type <> 'chain'").join(pocket.select("pdb_id", "_lig", F.col("_p").alias("chain_2_id")), ["pdb_id", "_lig", "chain_2_id"], "left_semi").where("chain_1_id <> chain_2_id")
    columns = [*index.columns, F.col("_lig").alias("ligand")]
    out = met.select(*columns, F.lit(0).alias("is_pocket"))
    return out.unionByName(alone.select(*columns, F.lit(1).alias("is_pocket"))).unionByName(both.select(*columns, F.lit(1).alias("is_pocket")))


def entity_table(residues: DataFrame, poly_types: DataFrame, standard: tuple[str, ...]) -> DataFrame:
    """The entities that evaluation_index reads, from residues (pdb_id, entity_id, res_id, res_name) and poly_types (pdb_id, entity_id, poly_type)."""
    known: Column = F.bool_and(F.col("res_name").isin(*standard))
    sizes = residues.groupBy("pdb_id", "entity_id").agg(F.countDistinct("res_id").alias("residues"), known.alias("is_standard"))
    return poly_types.join(sizes, ["pdb_id", "entity_id"])
