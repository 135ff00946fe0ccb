"""Spatial joins and the measures built on them.

A range join goes through a grid: cells as wide as the radius, each point of one
side met by the 27 cells around it, all keyed by structure and cell. So it is an
equi-join that shuffles each side once, whatever the density.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators import blocks
from strandline.operators.structure import distance

AXES = ("x", "y", "z")
#: Atoms of a block where all pairs of a structure are needed.
PAIR_BLOCK = 1024


def grid_pairs(left: DataFrame, right: DataFrame, radius: float, within: str = "pdb_id", strict: bool = True) -> DataFrame:
    """Pairs of rows of one structure closer than radius, as columns a.* and b.*, with their distance d."""
    cell = lambda c: F.floor(F.col(c) / radius)
    a = left.select("*", *[cell(c).alias(f"_cell_{c}") for c in AXES])
    b = right
    for c in AXES:
        b = b.select("*", F.explode(F.array(*[cell(c) + k for k in (-1, 0, 1)])).alias(f"_cell_{c}"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (within, *[f"_cell_{c}" for c in AXES])]
    both = a.alias("a").join(b.alias("b"), reduce(lambda x, y: x & y, same)).withColumn("d", distance("a.", "b."))
    return both.where(F.col("d") < radius if strict else F.col("d") <= radius)


def neighbour_pairs(atoms: DataFrame, radius: float, strict: bool = True) -> DataFrame:
    """Unordered pairs of atoms of a structure within radius: a.atom_idx < b.atom_idx."""
    return grid_pairs(atoms, atoms, radius, strict=strict).where("a.atom_idx < b.atom_idx")


def interfaces(atoms: DataFrame, radius: float = 5.0) -> DataFrame:
    """Chain pairs with resolved atoms within radius, ordered by entity and then chain."""
    close = neighbour_pairs(atoms.where("is_resolved").select("pdb_id", "atom_idx", "chain_id", "entity_id", *AXES), radius, strict=False).where("a.chain_id <> b.chain_id")
    one, two = F.struct("a.entity_id", "a.chain_id"), F.struct("b.entity_id", "b.chain_id")
    pair = close.select("a.pdb_id", F.least(one, two).alias("l"), F.greatest(one, two).alias("g"), "d")
    return pair.groupBy("pdb_id", F.col("l.chain_id").alias("chain_1"), F.col("g.chain_id").alias("chain_2"), F.col("l.entity_id").alias("entity_1"), F.col("g.entity_id").alias("entity_2")).agg(
        F.count(F.lit(1)).alias("contacts"), F.min("d").alias("least_distance")
    )


def clash_ratio(atoms: DataFrame, radius: float = 1.6) -> DataFrame:
    """Share of each chain's atoms that lie within radius of another chain."""
    close = grid_pairs(atoms, atoms, radius, strict=True).where("a.chain_id <> b.chain_id")
    clashing = close.select("a.pdb_id", "a.chain_id", "a.atom_idx").distinct().groupBy("pdb_id", "chain_id").agg(F.count(F.lit(1)).alias("clashing"))
    sizes = atoms.groupBy("pdb_id", "chain_id").agg(F.count(F.lit(1)).alias("n"))
    out = sizes.join(clashing, ["pdb_id", "chain_id"], "left").fillna({"clashing": 0})
    return out.withColumn("ratio", F.col("clashing") / F.col("n"))


def chain_clashes(atoms: DataFrame, radius: float = 1.1, most_pairs: int = 100, most_share: float = 0.5) -> DataFrame:
    """Chain pairs with their clashing atom pairs, and whether these are too many, or too many for the smaller chain."""
    close = neighbour_pairs(atoms, radius).where("a.chain_id <> b.chain_id")
    pairs = close.select("a.pdb_id", F.least("a.chain_id", "b.chain_id").alias("chain_1"), F.greatest("a.chain_id", "b.chain_id").alias("chain_2"))
    pairs = pairs.groupBy("pdb_id", "chain_1", "chain_2").agg(F.count(F.lit(1)).alias("pairs"))
    sizes = atoms.groupBy("pdb_id", "chain_id").agg(F.count(F.lit(1)).alias("n"))
    one, two = (sizes.select("pdb_id", F.col("chain_id").alias(f"chain_{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    out = pairs.join(one, ["pdb_id", "chain_1"]).join(two, ["pdb_id", "chain_2"])
    return out.withColumn("has_clash", (F.col("pairs") > most_pairs) | (F.col("pairs") / F.least("n1", "n2") > most_share)).drop("n1", "n2")


def contacts(atoms: DataFrame, least: float, most: float, apart: int) -> DataFrame:
    """Resolved atom pairs at a distance in [least, most], of two chains or far apart in one."""
    close = neighbour_pairs(atoms.where("is_resolved"), most, strict=False)
    return close.where(F.col("d") >= least).where((F.col("a.chain_id") != F.col("b.chain_id")) | (F.abs(F.col("a.atom_idx") - F.col("b.atom_idx")) >= apart))


def structure_pairs(atoms: DataFrame) -> DataFrame:
    """All unordered atom pairs of each structure with true and predicted distances: for measures that need every pair.

    A structure's atoms are dealt to blocks of about PAIR_BLOCK, and each pair of
    blocks is a key of its own, so that a large structure is spread over many tasks.
    """
    parts = atoms.groupBy("pdb_id").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("_parts"))
    rows = atoms.join(parts, "pdb_id").withColumn("_own", F.pmod(F.xxhash64("atom_idx"), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    a, b = rows.withColumn("_other", every).alias("a"), rows.withColumn("_other", every).alias("b")
    predicted = distance("a.", "b.", ("px", "py", "pz"))
    met = (F.col("a.pdb_id") == F.col("b.pdb_id")) & (F.col("a._own") == F.col("b._other")) & (F.col("a._other") == F.col("b._own"))
    return a.join(b, met & (F.col("a.atom_idx") < F.col("b.atom_idx"))).select(
        F.col("a.pdb_id").alias("pdb_id"), F.col("a.atom_idx").alias("i"), F.col("b.atom_idx").alias("j"), F.col("a.chain_id").alias("ci"), F.col("b.chain_id").alias("cj"), F.col("a.res_id").alias("ri"), F.col("b.res_id").alias("rj"),
        (F.col("a.is_resolved") & F.col("b.is_resolved")).alias("both_resolved"), distance("a.", "b.").alias("d"), predicted.alias("pd"),
    )


def residue_distance(atoms: DataFrame, places: int | None = None) -> DataFrame:
    """Least distance of any two atoms of each pair of residues of a structure, rounded to `places` where they are given."""
    near = blocks.group_extremes(atoms, "res_id", "res_id", most=False, places=places)
    return near.select("pdb_id", F.col("a").alias("res_a"), F.col("b").alias("res_b"), F.col("least").alias("least_distance"))


def residue_extremes(atoms: DataFrame, within: float | None = None, ordered: bool = False) -> DataFrame:
    """pdb_id, a, b, least, most: extremes of the distances of two atoms of each pair of residues a < b, or in both orders; with `within`, of pairs that come so near."""
    return blocks.group_extremes(atoms, "res_id", "res_id", within, ordered=ordered)


def lddt_pairs(atoms: DataFrame, radius: float = 15.0) -> DataFrame:
    """Ordered resolved pairs closer than radius: pdb_id, i, j and score, the mean of four thresholds on the distance error."""
    near = grid_pairs(atoms.where("is_resolved"), atoms.where("is_resolved"), radius).where("a.atom_idx <> b.atom_idx")
    error = F.abs(distance("a.", "b.", ("px", "py", "pz")) - F.col("d"))
    score = reduce(lambda s, t: s + (error < t).cast("double"), (0.5, 1.0, 2.0, 4.0), F.lit(0.0)) * 0.25
    return near.select("a.pdb_id", F.col("a.atom_idx").alias("i"), F.col("b.atom_idx").alias("j"), score.alias("score"))


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Number of boundaries below the value; boundaries cut [low, high] into bins - 2 equal parts."""
    width = (high - low) / (bins - 2)
    return F.least(F.greatest(F.ceil((value - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")


def distogram(atoms: DataFrame, low: float = 2.0, high: float = 22.0, bins: int = 64) -> DataFrame:
    """Pairs by structure and distance bin."""
    pairs = structure_pairs(atoms).where("both_resolved")
    return pairs.groupBy("pdb_id", bin_of(F.col("d"), low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))


def rmsd(atoms: DataFrame, eps: float = 0.0) -> DataFrame:
    """Root mean square deviation of resolved atoms without alignment, by structure."""
    square = sum((F.pow(F.col(f"p{c}") - F.col(c), 2) for c in "yz"), F.pow(F.col("px") - F.col("x"), 2))
    return atoms.where("is_resolved").groupBy("pdb_id").agg(F.sqrt(F.avg(square) + eps).alias("rmsd"), F.count(F.lit(1)).alias("n"))


def spatial_crop(atoms: DataFrame, anchors: DataFrame, size: int) -> DataFrame:
    """The nearest resolved atoms to the anchor (pdb_id, atom_idx) of each structure, with their rank by distance; ties by index.

    The bound on the rank reaches the plan as a group limit before the shuffle, so each task sends at most `size` rows of a structure.
    """
    ref = anchors.join(atoms, ["pdb_id", "atom_idx"]).select("pdb_id", *[F.col(c).alias(f"r{c}") for c in AXES])
    both = atoms.where("is_resolved").join(ref, "pdb_id")
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"r{c}"), 2) for c in "yz"), F.pow(F.col("x") - F.col("rx"), 2)))
    ranked = both.select("pdb_id", "atom_idx", d.alias("d")).withColumn("rank", F.row_number().over(W.partitionBy("pdb_id").orderBy(F.round("d", 9), "atom_idx")))
    return ranked.where(F.col("rank") <= size)


def pocket(atoms: DataFrame, ligand_chain, radius: float = 10.0) -> DataFrame:
    """Residues of other chains within radius of the ligand chain, and whether they are in the chain with most such atoms."""
    ligand, rest = atoms.where(F.col("chain_id") == ligand_chain), atoms.where((F.col("chain_id") != ligand_chain) & F.col("is_resolved"))
    near = grid_pairs(rest, ligand, radius).select("a.pdb_id", "a.chain_id", "a.res_id", "a.atom_idx").distinct()
    by_chain = near.groupBy("pdb_id", "chain_id").agg(F.count(F.lit(1)).alias("n"))
    top = by_chain.groupBy("pdb_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "chain_id")).alias("b")).select("pdb_id", F.col("b.chain_id").alias("primary"))
    residues = near.groupBy("pdb_id", "chain_id", "res_id").agg(F.count(F.lit(1)).alias("atoms"))
    return residues.join(top, "pdb_id").withColumn("is_primary", F.col("chain_id") == F.col("primary")).drop("primary")


def nearest(atoms: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """The k nearest other atoms of each atom of its structure: pdb_id, i, j, rank, d; fewer where the structure has fewer.

    Each pair of blocks gives the nearest k, of which the nearest k are ranked; what is shuffled grows with the atoms and not with
    their density. radius was where a search by cells began, and has no effect.
    """
    near = blocks.nearest_candidates(atoms, k)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("pdb_id", "i").orderBy(F.round("d", 9), "j"))).where(F.col("rank") <= k)
    return ranked.select("pdb_id", "i", "j", "rank", "d")


def angle_degrees(a: str, b: str, c: str, eps: float = 1e-4) -> Column:
    """Angle at b between b-a and c-b, of points under three prefixes."""
    u = [F.col(f"{b}{n}") - F.col(f"{a}{n}") for n in AXES]
    v = [F.col(f"{c}{n}") - F.col(f"{b}{n}") for n in AXES]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    cos = dot(u, v) / (F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)) + eps)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def bonds(atoms: DataFrame, radius: float) -> DataFrame:
    """A bond list by distance: pdb_id, i, j with i < j, and the residues of both."""
    return neighbour_pairs(atoms, radius).select("a.pdb_id", F.col("a.atom_idx").alias("i"), F.col("b.atom_idx").alias("j"), F.col("a.res_id").alias("ri"), F.col("b.res_id").alias("rj"))


def angle_triples(edges: DataFrame) -> DataFrame:
    """Wedges i < k around a shared vertex j."""
    both = edges.select("pdb_id", "i", "j").union(edges.select("pdb_id", F.col("j"), F.col("i")))
    left, right = both.select("pdb_id", F.col("i").alias("i"), F.col("j").alias("centre")), both.select("pdb_id", F.col("i").alias("k"), F.col("j").alias("centre"))
    return left.join(right, ["pdb_id", "centre"]).where("i < k")


def near_triples(atoms: DataFrame, radius: float) -> DataFrame:
    """The wedges of `angle_triples` over `bonds` of that radius, without the bonds: those around an atom are listed in the task that meets its neighbours."""
    near = blocks.near_lists(atoms, radius)
    return near.withColumn("i", F.explode("near")).withColumn("k", F.explode("near")).where("i < k").select("pdb_id", "centre", "i", "k")


def near_residues(atoms: DataFrame, radius: float) -> DataFrame:
    """The residue pairs of `token_adjacency` over `bonds` of that radius, without the bonds: each pair is met in one task."""
    pairs = residue_extremes(atoms, radius)
    both = F.explode(F.array(F.struct(F.col("a").alias("token_a"), F.col("b").alias("token_b")), F.struct(F.col("b").alias("token_a"), F.col("a").alias("token_b"))))
    return pairs.select("pdb_id", both.alias("p")).select("pdb_id", "p.token_a", "p.token_b")


def token_adjacency(edges: DataFrame) -> DataFrame:
    """Distinct symmetric residue pairs that bonds join."""
    pairs = edges.where("ri <> rj").select("pdb_id", F.col("ri").alias("token_a"), F.col("rj").alias("token_b"))
    return pairs.union(pairs.select("pdb_id", "token_b", "token_a")).distinct()


def flat_bottom_linear(value: Column, low: float | None, high: float | None, k: float = 1.0) -> Column:
    over = F.greatest(F.lit(0.0), value - high) if high is not None else F.lit(0.0)
    under = F.greatest(F.lit(0.0), F.lit(low) - value) if low is not None else F.lit(0.0)
    return k * (over + under)


def flat_bottom_parabolic(value: Column, low: float | None, high: float | None, k: float = 1.0) -> Column:
    return 0.5 * k * F.pow(flat_bottom_linear(value, low, high), 2)


#: Weights of the two Gaussians and the repulsion in the published AutoDock Vina scoring function (Trott and Olson, 2010).
STERIC = (-0.0356, -0.00516, 0.84)


def steric_energy(d: Column, equilibrium: float) -> Column:
    """Two attractive Gaussians and a repulsion below the equilibrium distance, with the weights of STERIC."""
    delta = d - equilibrium
    near, far, repulsion = STERIC
    return near * F.exp(-F.pow(delta / 0.5, 2)) + far * F.exp(-F.pow((delta - 3) / 2, 2)) + repulsion * F.pow(F.least(delta, F.lit(0.0)), 2)
