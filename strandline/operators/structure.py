"""Atom tables: filters, annotations, runs and ids.

Columns: pdb_id, atom_idx (the order of atoms), chain_id, res_id, res_name,
atom_name, entity_id, x, y, z, is_resolved. Every window is within a structure or
a chain, so structures are spread over the cluster and none needs the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WATER = ("HOH", "DOD")
HYDROGEN = ("H", "D")
BACKBONE_GAP = 10.0


def remove_water(atoms: DataFrame) -> DataFrame:
    return atoms.where(~F.col("res_name").isin(*WATER))


def remove_hydrogens(atoms: DataFrame, element: str = "element") -> DataFrame:
    return atoms.where(~F.col(element).isin(*HYDROGEN))


def met_from_mse(atoms: DataFrame) -> DataFrame:
    """Selenomethionine as methionine: MSE -> MET, atom SE -> SD, element S."""
    mse = F.col("res_name") == "MSE"
    out = atoms.withColumn("atom_name", F.when(mse & (F.col("atom_name") == "SE"), "SD").otherwise(F.col("atom_name")))
    if "element" in atoms.columns:
        out = out.withColumn("element", F.when(mse & (F.col("element") == "SE"), "S").otherwise(F.col("element")))
    return out.withColumn("res_name", F.when(mse, "MET").otherwise(F.col("res_name")))


def replace_unknown_elements(atoms: DataFrame) -> DataFrame:
    """Drop UNX and UNL residues; ASX and GLX become ASP and GLU, their X atoms oxygen."""
    as_name = F.col("res_name")
    in_asx, in_glx = as_name == "ASX", as_name == "GLX"
    atom = F.when((in_asx | in_glx) & F.col("atom_name").rlike("^X[DE][12]$"), F.regexp_replace("atom_name", "^X", "O")).otherwise(F.col("atom_name"))
    return atoms.where(~as_name.isin("UNX", "UNL")).withColumn("atom_name", atom).withColumn("res_name", F.when(in_asx, "ASP").when(in_glx, "GLU").otherwise(as_name))


def resolved_chains(atoms: DataFrame) -> DataFrame:
    """Chains with at least one resolved atom."""
    keep = atoms.groupBy("pdb_id", "chain_id").agg(F.bool_or("is_resolved").alias("_k")).where("_k").drop("_k")
    return atoms.join(keep, ["pdb_id", "chain_id"], "left_semi")


def all_unknown_chains(atoms: DataFrame, unknown: tuple[str, ...] = ("UNK", "N")) -> DataFrame:
    """Atoms without the chains whose residues are all unknown."""
    drop = atoms.groupBy("pdb_id", "chain_id").agg(F.bool_and(F.col("res_name").isin(*unknown)).alias("_d")).where("_d").drop("_d")
    return atoms.join(drop, ["pdb_id", "chain_id"], "left_anti")


def short_chains(atoms: DataFrame, least: int = 4) -> DataFrame:
    """Atoms without the chains of fewer residues."""
    drop = atoms.groupBy("pdb_id", "chain_id").agg(F.countDistinct("res_id").alias("_n")).where(F.col("_n") < least).drop("_n")
    return atoms.join(drop, ["pdb_id", "chain_id"], "left_anti")


def distance(a: str = "", b: str = "", names: tuple[str, str, str] = ("x", "y", "z")) -> Column:
    """Euclidean distance between the points of two aliases."""
    return F.sqrt(sum((F.pow(F.col(f"{a}{n}") - F.col(f"{b}{n}"), 2) for n in names[1:]), F.pow(F.col(f"{a}{names[0]}") - F.col(f"{b}{names[0]}"), 2)))


def gapped_chains(atoms: DataFrame, most: float = BACKBONE_GAP, atom_name: str = "CA") -> DataFrame:
    """Chains in which atoms of the name in neighbouring residues lie too far apart: pdb_id, chain_id."""
    ca = atoms.where(F.col("atom_name") == atom_name)
    w = W.partitionBy("pdb_id", "chain_id").orderBy("res_id", "atom_idx")
    nxt = ca.select("pdb_id", "chain_id", "res_id", "x", "y", "z", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("res_id", "x", "y", "z")])
    far = (F.pow(F.col("x") - F.col("n_x"), 2) + F.pow(F.col("y") - F.col("n_y"), 2) + F.pow(F.col("z") - F.col("n_z"), 2)) > most * most
    return nxt.where((F.col("n_res_id") == F.col("res_id") + 1) & far).select("pdb_id", "chain_id").distinct()


def drop_gapped_chains(atoms: DataFrame, most: float = BACKBONE_GAP) -> DataFrame:
    return atoms.join(gapped_chains(atoms, most), ["pdb_id", "chain_id"], "left_anti")


def present_ligand_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms whose (res_name, atom_name) is resolved in at least one copy."""
    seen = atoms.where("is_resolved").select("res_name", "atom_name").distinct()
    return atoms.join(seen, ["res_name", "atom_name"], "left_semi")


def chain_runs(atoms: DataFrame) -> DataFrame:
    """Adds run (of equal chain ids in the order of atoms), copy (nth run of the id) and unique_chain (A, A.1, ...)."""
    w = W.partitionBy("pdb_id").orderBy("atom_idx")
    begins = F.coalesce((F.col("chain_id") != F.lag("chain_id").over(w)).cast("int"), F.lit(1))
    rows = atoms.withColumn("_b", begins).withColumn("run", F.sum("_b").over(w) - 1)
    firsts = rows.where("_b = 1").select("pdb_id", "run", (F.row_number().over(W.partitionBy("pdb_id", "chain_id").orderBy("run")) - 1).alias("copy"))
    name = F.when(F.col("copy") == 0, F.col("chain_id").cast("string")).otherwise(F.concat_ws(".", F.col("chain_id").cast("string"), F.col("copy").cast("string")))
    return rows.drop("_b").join(firsts, ["pdb_id", "run"]).withColumn("unique_chain", name)


def dense_ids(rows: DataFrame, by: list[str], within: list[str], name: str) -> DataFrame:
    """Dense number from 0 of the sorted distinct values of `by` within each group."""
    distinct = rows.select(*within, *by).distinct()
    numbered = distinct.withColumn(name, F.dense_rank().over(W.partitionBy(*within).orderBy(*by)) - 1)
    return rows.join(numbered, [*within, *by])


def atom_index_in_molecule(atoms: DataFrame, molecule: str = "chain_id") -> DataFrame:
    """Running number from 0 of the atoms of each molecule."""
    return atoms.withColumn("mol_atom_index", F.row_number().over(W.partitionBy("pdb_id", molecule).orderBy("atom_idx")) - 1)


def altloc_by_local_largest(atoms: DataFrame) -> DataFrame:
    """Keep, in each run of residues with alternate locations, the letter with the highest mean occupancy.

    atoms has alt_id ('.' for none) and occupancy. Runs are consecutive residues
    of a chain with alternates; ties go to the smaller letter.
    """
    residues = atoms.where("alt_id <> '.'").groupBy("pdb_id", "chain_id", "res_id", "alt_id").agg(F.min("occupancy").alias("occupancy"))
    places = residues.select("pdb_id", "chain_id", "res_id").distinct()
    w = W.partitionBy("pdb_id", "chain_id").orderBy("res_id")
    places = places.withColumn("_run", F.col("res_id") - F.row_number().over(w))
    means = residues.join(places, ["pdb_id", "chain_id", "res_id"]).groupBy("pdb_id", "chain_id", "_run", "alt_id").agg(F.avg("occupancy").alias("m"), F.count(F.lit(1)).alias("n"))
    best = means.withColumn("_r", F.row_number().over(W.partitionBy("pdb_id", "chain_id", "_run").orderBy(F.desc("n"), F.desc(F.round("m", 9)), "alt_id"))).where("_r = 1")
    chosen = places.join(best.select("pdb_id", "chain_id", "_run", F.col("alt_id").alias("best_alt")), ["pdb_id", "chain_id", "_run"]).drop("_run")
    return atoms.join(chosen, ["pdb_id", "chain_id", "res_id"], "left").where("alt_id = '.' OR alt_id = best_alt").drop("best_alt")


def complete_atoms(reference: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Reference atoms with the observed coordinates; missing atoms are unresolved at the origin."""
    seen = observed.select(*keys, "x", "y", "z", F.lit(True).alias("_seen"))
    out = reference.join(seen, keys, "left")
    return out.select(*reference.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x", "y", "z")], F.coalesce("_seen", F.lit(False)).alias("is_resolved"))


def expand_assembly(atoms: DataFrame, operations: DataFrame) -> DataFrame:
    """Apply symmetry operations (op_id, chains array, r11..r33, t1..t3): each atom once for each operation of its chain."""
    ops = operations.select("*", F.explode("chains").alias("chain_id")).drop("chains")
    both = atoms.join(ops, "chain_id")
    new = [sum((F.col(f"r{i}{j}") * F.col(c) for j, c in ((2, "y"), (3, "z"))), F.col(f"r{i}1") * F.col("x")) + F.col(f"t{i}") for i in (1, 2, 3)]
    return both.select(*[c for c in atoms.columns if c not in ("x", "y", "z")], "op_id", *[n.alias(c) for n, c in zip(new, ("x", "y", "z"))])


def token_mean(atoms: DataFrame, token: list[str], value: str) -> DataFrame:
    """Mean, sum and extremes of an atom value by token, with the atoms where the extremes stand."""
    return atoms.groupBy(*token).agg(
        F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.min(F.struct(value, "atom_idx")).alias("_lo"), F.max(F.struct(F.col(value), -F.col("atom_idx"))).alias("_hi"), F.count(F.lit(1)).alias("n")
    ).select(*token, "mean", "sum", F.col(f"_lo.{value}").alias("least"), F.col("_lo.atom_idx").alias("argmin"), F.col(f"_hi.{value}").alias("most"), (-F.col("_hi.col2")).alias("argmax"), "n")


def centred(atoms: DataFrame, by: list[str]) -> DataFrame:
    """Coordinates less their mean within each group."""
    w = W.partitionBy(*by)
    return atoms.select(*[c for c in atoms.columns if c not in ("x", "y", "z")], *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in ("x", "y", "z")])


def renamed_atoms(atoms: DataFrame, element: str = "element") -> DataFrame:
    """Names of atoms as element and running number within the residue."""
    w = W.partitionBy("pdb_id", "chain_id", "res_id", element).orderBy("atom_idx")
    return atoms.withColumn("new_name", F.concat(F.upper(element), F.row_number().over(w).cast("string")))


def fix_arginine(atoms: DataFrame) -> DataFrame:
    """Swap the positions of NH1 and NH2 of an arginine where NH2 is nearer to CD; a residue without one of the three stays."""
    by = ["pdb_id", "chain_id", "res_id"]
    at = lambda name, c: F.max(F.when(F.col("atom_name") == name, F.col(c)))
    names = ("CD", "NH1", "NH2")
    spots = atoms.where((F.col("res_name") == "ARG") & F.col("atom_name").isin(*names)).groupBy(*by).agg(*[at(n, c).alias(f"{n}_{c}") for n in names for c in "xyz"])
    d2 = lambda n: F.pow(F.col(f"{n}_x") - F.col("CD_x"), 2) + F.pow(F.col(f"{n}_y") - F.col("CD_y"), 2) + F.pow(F.col(f"{n}_z") - F.col("CD_z"), 2)
    swaps = spots.where(d2("NH2") < d2("NH1"))
    rows = atoms.join(swaps, by, "left")
    swapped = (F.col("res_name") == "ARG") & F.col("CD_x").isNotNull()
    new = {c: F.when(swapped & (F.col("atom_name") == "NH1"), F.col(f"NH2_{c}")).when(swapped & (F.col("atom_name") == "NH2"), F.col(f"NH1_{c}")).otherwise(F.col(c)) for c in "xyz"}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in atoms.columns])


def label_numbering(atoms: DataFrame) -> DataFrame:
    """Chains named by label_asym_id; residues without a label number are numbered from 1 within their chain."""
    w = W.partitionBy("pdb_id", "label_asym_id").orderBy("res_id")
    number = F.coalesce(F.col("label_seq_id").try_cast("long"), F.dense_rank().over(w).cast("long"))
    return atoms.withColumn("_n", number).withColumn("chain_id", F.col("label_asym_id")).withColumn("res_id", F.col("_n")).drop("_n")


def token_atom_index(atoms: DataFrame, positions: DataFrame) -> DataFrame:
    """Adds tokatom_idx, the place of an atom in its residue's dictionary (res_name, atom_name, place); 0 where there is none."""
    return atoms.join(positions, ["res_name", "atom_name"], "left").withColumn("tokatom_idx", F.coalesce("place", F.lit(0))).drop("place")


def canonical_names(atoms: DataFrame, letters: DataFrame, standard: dict[str, dict[str, str]], unknown: dict[str, str]) -> DataFrame:
    """Adds cano_res_name: the standard residue of the same letter and molecule type, else the type's unknown.

    letters: res_name, letter; standard: type -> letter -> residue; unknown: type -> residue.
    """
    pairs = [(f"{t}/{letter}", name) for t, m in standard.items() for letter, name in m.items()]
    of = F.create_map(*[F.lit(x) for p in pairs for x in p])
    other = F.create_map(*[F.lit(x) for p in unknown.items() for x in p])
    rows = atoms.join(letters, "res_name", "left")
    name = F.coalesce(F.try_element_at(of, F.concat_ws("/", "mol_type", "letter")), F.try_element_at(other, F.col("mol_type")))
    return rows.withColumn("cano_res_name", F.when(F.col("letter").isNull(), F.try_element_at(other, F.col("mol_type"))).otherwise(name)).drop("letter")


def chains_by_entity(atoms: DataFrame) -> DataFrame:
    """Adds place, from 0: chains by entity as text, those of one entity by atoms, most first, then as they stood; atoms keep their order."""
    chains = atoms.groupBy("pdb_id", "chain_id").agg(F.min(F.struct("atom_idx", F.col("entity_id").cast("string").alias("e"))).alias("_f"), F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(W.partitionBy("pdb_id").orderBy("_f.e", F.desc("_n"), "_f.atom_idx"))
    ranked = chains.select("pdb_id", "chain_id", rank.alias("_rank"), "_n")
    before = F.coalesce(F.sum("_n").over(W.partitionBy("pdb_id").orderBy("_rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("pdb_id", "chain_id").orderBy("atom_idx")) - 1
    return atoms.join(ranked.select("pdb_id", "chain_id", before.alias("_before")), ["pdb_id", "chain_id"]).withColumn("place", F.col("_before") + within).drop("_before")


def polymer_frames(atoms: DataFrame) -> DataFrame:
    """pdb_id, token, has_frame, frame: the atoms that span a polymer token's frame, N, CA and C of protein, C1', C3' and C4' of nucleic acids.

    atoms: pdb_id, token, mol_type, atom_name, atom_idx. A token that lacks one of the three has no frame, and -1 for each atom.
    """
    protein = F.col("mol_type") == "protein"
    at = lambda a, b: F.min(F.when(F.col("atom_name") == F.when(protein, a).otherwise(b), F.col("atom_idx")))
    spots = atoms.groupBy("pdb_id", "token").agg(F.array(at("N", "C1'"), at("CA", "C3'"), at("C", "C4'")).alias("_a"))
    has = ~F.exists("_a", lambda x: x.isNull())
    return spots.select("pdb_id", "token", has.cast("int").alias("has_frame"), F.when(has, F.col("_a")).otherwise(F.array(*[F.lit(-1).cast("long")] * 3)).alias("frame"))
