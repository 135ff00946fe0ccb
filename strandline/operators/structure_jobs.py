"""Prediction jobs from structures: entities with their copies and modifications, and the bonds of ligands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators import entities

# The polymer types that a job can hold, and the kinds that it calls them by.
KINDS = {"polypeptide(L)": "proteinChain", "polydeoxyribonucleotide": "dnaSequence", "polyribonucleotide": "rnaSequence"}


def job_entities(atoms: DataFrame, polymers: DataFrame, residues: DataFrame, letters: DataFrame, standard: tuple[str, ...]) -> DataFrame:
    """pdb_id, entity_id, entity (from 1), kind, value, n, chains, modifications (array of position, code).

    atoms: pdb_id, atom_idx, entity_id, chain_id, res_id, res_name; polymers: pdb_id, entity_id, poly_type; residues: pdb_id, entity_id,
    pos, res_name of all polymers; letters: res_name, letter. Entities are numbered in the order of their ids as text; polymers of
    other types are left out. A ligand's value names the residues of its last chain, and a polymer's is its sequence of letters.
    """
    key = ["pdb_id", "entity_id"]
    chains = atoms.groupBy(*key, "chain_id").agg(F.min("atom_idx").alias("start"))
    copies = chains.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("start", "chain_id"))), lambda c: c["chain_id"]).alias("chains"), F.max("chain_id").alias("_last"))
    kind = F.coalesce(*[F.when(F.col("poly_type") == t, k) for t, k in KINDS.items()])
    typed = copies.join(polymers.select(*key, F.col("poly_type")), key, "left")
    typed = typed.withColumn("kind", F.when(F.col("poly_type").isNull(), "ligand").otherwise(kind)).where("kind IS NOT NULL")
    own = atoms.join(typed.where("kind = 'ligand'").select(*key, F.col("_last").alias("chain_id")), [*key, "chain_id"])
    names = own.groupBy(*key, "res_id", "res_name").agg(F.min("atom_idx").alias("at")).groupBy(*key).agg(F.concat(F.lit("CCD_"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "res_name"))), lambda r: r["res_name"]), "_")).alias("ligand"))
    sequences = entities.sequences(residues, letters, key)
    odd = residues.where(~F.col("res_name").isin(*standard)).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("position"), F.concat(F.lit("CCD_"), "res_name").alias("code")))).alias("modifications"))
    rows = typed.join(names, key, "left").join(sequences, key, "left").join(odd, key, "left")
    value = F.when(F.col("kind") == "ligand", F.col("ligand")).otherwise(F.col("sequence"))
    number = F.row_number().over(W.partitionBy("pdb_id").orderBy("entity_id"))
    return rows.select(*key, number.alias("entity"), "kind", value.alias("value"), F.col("n").cast("int").alias("n"), "chains", "modifications")


def ligand_bonds(job: DataFrame, atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """pdb_id, entity1, position1, atom1, copy1, entity2, ...: bonds between residues of which a ligand takes part; single atoms (ions) don't.

    Where every copy of both entities has the bond, and only then, one row without copies stands for all.
    """
    copies = job.select("pdb_id", "entity_id", "entity", "kind", F.col("n").alias("n"), F.posexplode("chains").alias("copy", "chain_id"))
    sizes = atoms.groupBy("pdb_id", "chain_id").agg(F.count(F.lit(1)).alias("atoms"))
    ends = atoms.select("pdb_id", "atom_idx", "chain_id", "res_id", "atom_name").join(copies, ["pdb_id", "chain_id"]).join(sizes.where("atoms > 1").select("pdb_id", "chain_id"), ["pdb_id", "chain_id"])
    side = lambda k, end: ends.select("pdb_id", F.col("atom_idx").alias(end), F.col("chain_id").alias(f"chain{k}"), F.col("entity").alias(f"entity{k}"), F.col("res_id").cast("int").alias(f"position{k}"), F.col("atom_name").alias(f"atom{k}"), (F.col("copy") + 1).alias(f"copy{k}"), F.col("kind").alias(f"kind{k}"), F.col("n").alias(f"n{k}"))
    rows = bonds.select("pdb_id", "i", "j").join(side(1, "i"), ["pdb_id", "i"]).join(side(2, "j"), ["pdb_id", "j"])
    rows = rows.where("(chain1 <> chain2 OR position1 <> position2) AND (kind1 = 'ligand' OR kind2 = 'ligand')")
    site = ["pdb_id", "entity1", "position1", "atom1", "entity2", "position2", "atom2"]
    pair = F.struct("copy1", "copy2")
    merged = rows.groupBy(*site).agg(F.count(F.lit(1)).alias("_n"), F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.collect_list(pair).alias("_pairs"))
    whole = (F.col("_n") == F.col("n1")) & (F.col("_n") == F.col("n2"))
    none = F.array(F.struct(F.lit(None).cast("int").alias("copy1"), F.lit(None).cast("int").alias("copy2")))
    return merged.select(*site, F.inline(F.when(whole, none).otherwise(F.array_sort("_pairs"))))


def job_texts(job: DataFrame, bonds: DataFrame) -> DataFrame:
    """pdb_id, value: the JSON of each structure's job, as a list of one."""
    is_ = lambda kind: F.col("kind") == kind
    mods = lambda position, code: F.transform("modifications", lambda m: F.struct(m["position"].alias(position), m["code"].alias(code)))
    protein = F.struct(F.col("value").alias("sequence"), F.col("n").alias("count"), mods("ptmPosition", "ptmType").alias("modifications"))
    nucleic = F.struct(F.col("value").alias("sequence"), F.col("n").alias("count"), mods("basePosition", "modificationType").alias("modifications"))
    entity = F.struct(F.when(is_("proteinChain"), protein).alias("proteinChain"), F.when(is_("dnaSequence"), nucleic).alias("dnaSequence"), F.when(is_("rnaSequence"), nucleic).alias("rnaSequence"), F.when(is_("ligand"), F.struct(F.col("value").alias("ligand"), F.col("n").alias("count"))).alias("ligand"))
    sequences = job.groupBy("pdb_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("entity", entity.alias("e")))), lambda x: x["e"]).alias("sequences"))
    columns = [c for k in "12" for c in (f"entity{k}", f"copy{k}", f"position{k}", f"atom{k}")]
    text = lambda c: F.col(c).cast("string").alias(c) if c.startswith(("entity", "position")) else F.col(c)
    linked = bonds.groupBy("pdb_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"_{c}") for c in ("entity1", "position1", "atom1", "copy1", "entity2", "position2", "atom2", "copy2")], F.struct(*[text(c) for c in columns]).alias("b")))), lambda x: x["b"]).alias("covalent_bonds"))
    both = sequences.join(linked, "pdb_id", "left")
    return both.select("pdb_id", F.concat(F.lit("["), F.to_json(F.struct(F.col("pdb_id").cast("string").alias("name"), "sequences", "covalent_bonds")), F.lit("]")).alias("value"))
