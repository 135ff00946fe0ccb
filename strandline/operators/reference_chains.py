"""Reference chains of polymers: the atoms that each residue should have, less what leaves when it is bonded.

The components table has the atoms of each residue with their leaving flags, and its bonds, both without hydrogens. A
leaving group is a connected set of leaving atoms with one bond to an atom that stays, its centre. A residue with a
group on two centres keeps all its atoms.

Centres lose as many groups as they have bonds to other residues, the most in any copy of the entity counting; groups of which
no copy has an atom go first, then groups in the order of their atoms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.shared import materialise


def leaving_groups(comp_atoms: DataFrame, comp_bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (res_name, centre, grp, atom_name; grp is the place of its first atom) and the residues whose groups can't be told apart.

    comp_atoms: res_name, pos, atom_name, leaving; comp_bonds: res_name, a, b (atom names).
    """
    at = comp_atoms.select("res_name", "atom_name", F.col("pos").cast("long").alias("pos"), "leaving")
    ends = lambda k: at.select("res_name", F.col("atom_name").alias(k), F.col("pos").alias(f"p{k}"), F.col("leaving").alias(f"l{k}"))
    bonds = comp_bonds.select("res_name", "a", "b").join(ends("a"), ["res_name", "a"]).join(ends("b"), ["res_name", "b"])
    own = at.where("leaving").select("res_name", F.col("pos").alias("node"))
    inner = bonds.where("la AND lb").select("res_name", F.col("pa").alias("i"), F.col("pb").alias("j"))
    nodes = graph.components(inner.unionByName(own.select("res_name", F.col("node").alias("i"), F.col("node").alias("j"))), "res_name")
    members = materialise(nodes.select("res_name", F.col("node").alias("pos"), F.col("component").alias("grp")).join(at.select("res_name", "pos", "atom_name"), ["res_name", "pos"]), "leaving")
    out = bonds.where("la <> lb").select("res_name", F.when(F.col("la"), F.col("pa")).otherwise(F.col("pb")).alias("pos"), F.when(F.col("la"), F.col("b")).otherwise(F.col("a")).alias("centre"))
    held = out.join(members.select("res_name", "pos", "grp"), ["res_name", "pos"])
    counts = held.groupBy("res_name", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("centre").alias("centre"))
    return counts.where("n = 1").join(members.select("res_name", "grp", "atom_name"), ["res_name", "grp"]).select("res_name", "centre", "grp", "atom_name"), counts.where("n > 1").select("res_name").distinct()


def reference_chains(residues: DataFrame, comp_atoms: DataFrame, comp_bonds: DataFrame, types: DataFrame, atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms (pdb_id, entity_id, res_id, res_name, pos, atom_name) and links (pdb_id, entity_id, res_id, atom, next_atom) of the reference chains.

    residues: pdb_id, entity_id, res_id (from 1, without gaps), res_name; types: res_name, type (protein or nucleic); atoms: pdb_id,
    atom_idx, entity_id, chain_id, res_id, atom_name; bonds: pdb_id, i, j.

    Residues that follow one another are linked C to N or O3' to P, but not where some copy has both atoms without a bond. A centre that
    no group of the component names loses instead, in the copy where these are most, the neighbours that are bonded to nothing else and
    that the copy doesn't have bonded to it.
    """
    key, site = ["pdb_id", "entity_id"], ["pdb_id", "entity_id", "res_id", "atom_name"]
    full = residues.join(comp_atoms.select("res_name", "pos", "atom_name"), "res_name")
    placed = materialise(atoms.select("pdb_id", "atom_idx", "entity_id", "chain_id", "res_id", "atom_name"), "reference-atoms")
    both = materialise(bonds.select("pdb_id", "i", "j").unionByName(bonds.select("pdb_id", F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "reference-bonds")
    far = placed.select("pdb_id", F.col("atom_idx").alias("j"), F.col("chain_id").alias("_c"), F.col("res_id").alias("_r"), F.col("atom_name").alias("other"))
    met = placed.select("*", F.col("atom_idx").alias("i")).join(both, ["pdb_id", "i"]).join(far, ["pdb_id", "j"])

    # Links of the reference itself, and the copies that contradict them.
    kinds = residues.join(types, "res_name")
    following = kinds.select(*key, (F.col("res_id") - 1).alias("res_id"), F.col("type").alias("_t"), F.col("res_name").alias("_name"))
    linked = kinds.join(following, [*key, "res_id"]).where("type = _t")
    linked = linked.select(*key, "res_id", "res_name", "_name", F.when(F.col("type") == "protein", "C").otherwise("O3'").alias("atom"), F.when(F.col("type") == "protein", "N").otherwise("P").alias("next_atom"))
    has = lambda name, atom: comp_atoms.select(F.col("res_name").alias(name), F.col("atom_name").alias(atom)).distinct()
    linked = linked.join(has("res_name", "atom"), ["res_name", "atom"]).join(has("_name", "next_atom"), ["_name", "next_atom"]).select(*key, "res_id", "atom", "next_atom")
    first = placed.select(*key, "chain_id", "res_id", F.col("atom_name").alias("atom"), F.col("atom_idx").alias("i"))
    second = placed.select(*key, "chain_id", (F.col("res_id") - 1).alias("res_id"), F.col("atom_name").alias("next_atom"), F.col("atom_idx").alias("j"))
    seen = linked.join(first, [*key, "res_id", "atom"]).join(second, [*key, "chain_id", "res_id", "next_atom"])
    torn = seen.join(both, ["pdb_id", "i", "j"], "left_anti").select(*key, "res_id").distinct()
    links = materialise(linked.join(torn, [*key, "res_id"], "left_anti"), "reference-links")

    # Bonds to other residues at each centre: one for a link, else the most of any copy.
    central = F.when(F.col("atom") == "C", F.struct("res_id", F.col("atom").alias("atom_name"))).otherwise(F.struct((F.col("res_id") + 1).alias("res_id"), F.col("next_atom").alias("atom_name")))
    wanted = links.select(*key, central.alias("c")).select(*key, "c.*", F.lit(1).cast("long").alias("n"))
    found = met.where("_c <> chain_id OR _r <> res_id").groupBy(*key, "chain_id", "res_id", "atom_name", "atom_idx").agg(F.count(F.lit(1)).alias("n")).select(*site, "n")
    centres = wanted.unionByName(found).groupBy(*site).agg(F.max("n").alias("n")).join(residues, [*key, "res_id"])
    groups, mixed = leaving_groups(comp_atoms, comp_bonds)
    centres = materialise(centres.join(mixed, "res_name", "left_anti").withColumnRenamed("atom_name", "centre"), "reference-centres")

    present = placed.select(*site).distinct().withColumn("_seen", F.lit(1))
    open_ = centres.join(groups, ["res_name", "centre"]).join(present, site, "left")
    by = [*key, "res_id", "centre"]
    ranked = open_.groupBy(*by, "grp").agg(F.max("n").alias("n"), F.max(F.coalesce("_seen", F.lit(0))).alias("resolved"), F.collect_list("atom_name").alias("names"))
    ranked = ranked.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy("resolved", "grp"))).where("nth <= n")
    gone = ranked.select(*key, "res_id", F.explode("names").alias("atom_name"))

    # Centres without groups of their own: leaves that a copy lacks.
    pairs = comp_bonds.select("res_name", "a", "b").unionByName(comp_bonds.select("res_name", F.col("b").alias("a"), F.col("a").alias("b")))
    leaves = pairs.join(pairs.groupBy("res_name", F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("d")).where("d = 1"), ["res_name", "b"]).select("res_name", F.col("a").alias("centre"), F.col("b").alias("leaf"))
    other = centres.join(groups.select("res_name", "centre").distinct(), ["res_name", "centre"], "left_anti").join(leaves, ["res_name", "centre"])
    copies = other.join(placed.withColumnRenamed("atom_name", "centre"), [*key, "res_id", "centre"])
    bonded = met.select(*key, "atom_idx", F.col("other").alias("leaf")).distinct()
    lacking = copies.join(bonded, [*key, "atom_idx", "leaf"], "left_anti").groupBy(*by, "atom_idx").agg(F.collect_list("leaf").alias("names"))
    most = lacking.groupBy(*by).agg(F.max(F.struct(F.size("names").alias("k"), (-F.col("atom_idx")).alias("at"), "names")).alias("m"))
    gone = gone.unionByName(most.select(*key, "res_id", F.explode("m.names").alias("atom_name"))).distinct()
    return full.join(gone, site, "left_anti").select(*key, "res_id", "res_name", "pos", "atom_name"), links
