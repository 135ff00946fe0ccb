"""Matching of copies: chains by a search over anchors, and pockets with their ligands.

Both rest on moments. A rigid move and the deviation after it follow from a few sums over pairs of
points, so points are joined and summed once, by pair of chains; what is then tried for each candidate
(move, distance of centres, deviation) is arithmetic on those sums. Only three by three sums reach the
kernel that finds rotations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.kernels import typed

AXES = ("x", "y", "z")
#: Sums over pairs of points: weights, both sides, products, squares.
MOMENTS = ["w", *[f"s{c}" for c in AXES], *[f"t{c}" for c in AXES], *[f"m{a}{b}" for a in AXES for b in AXES], "ss", "tt"]


def moments(pairs: DataFrame, by: list[str], source: str = "s", target: str = "t", weight: Column | None = None) -> DataFrame:
    """MOMENTS of the points source.x.. and target.x.. (columns sx, tx, ...) in each group; combined before the shuffle."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    s, t = {c: F.col(f"{source}{c}") for c in AXES}, {c: F.col(f"{target}{c}") for c in AXES}
    square = lambda p: p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"]
    rows = pairs.select(*by, w.alias("w"), *[(w * s[c]).alias(f"s{c}") for c in AXES], *[(w * t[c]).alias(f"t{c}") for c in AXES], *[(w * s[a] * t[b]).alias(f"m{a}{b}") for a in AXES for b in AXES], (w * square(s)).alias("ss"), (w * square(t)).alias("tt"))
    return rows.groupBy(*by).agg(*[F.sum(m).alias(m) for m in MOMENTS])


def rotations(cross: np.ndarray) -> np.ndarray:
    """For each 3 x 3 sum of centred source times target: the proper rotation of source onto target."""
    u, _, vt = np.linalg.svd(cross)
    v = np.swapaxes(vt, -1, -2)
    sign = np.ones((len(cross), 3))
    sign[:, 2] = np.where(np.linalg.det(v @ np.swapaxes(u, -1, -2)) < 0, -1.0, 1.0)
    return (v * sign[:, None, :]) @ np.swapaxes(u, -1, -2)


def rigid_moves(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rotation (nine numbers, by rows) and shift (three) of the best rigid move of source onto target; rows without weight have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = pdf["w"].to_numpy(float)[:, None]
            s, t = (pdf[[f"{k}{c}" for c in AXES]].to_numpy(float) / w for k in "st")
            product = pdf[[f"m{a}{b}" for a in AXES for b in AXES]].to_numpy(float).reshape(-1, 3, 3)
            turn = rotations(product - w[:, :, None] * s[:, :, None] * t[:, None, :])
            shift = t - np.einsum("nij,nj->ni", turn, s)
            yield pdf[keys].assign(rotation=list(turn.reshape(-1, 9)), shift=list(shift))

    return sums.where("w > 0").select(*keys, *MOMENTS).mapInPandas(run, f"{typed(sums, *keys)}, rotation array<double>, shift array<double>")


def moved_centre(axis: int) -> Column:
    """A coordinate of the source's centre after the move."""
    return F.get("shift", axis) + sum((F.get("rotation", 3 * axis + i) * F.col(f"s{c}") / F.col("w") for i, c in enumerate(AXES)), F.lit(0.0))


def centre_distance() -> Column:
    """Distance of the moved source's centre from the target's; null without weight."""
    return F.when(F.col("w") > 0, F.sqrt(sum((F.pow(moved_centre(i) - F.col(f"t{c}") / F.col("w"), F.lit(2)) for i, c in enumerate(AXES)), F.lit(0.0))))


def deviation() -> Column:
    """Root mean square of the moved source's distances from the target, from the sums alone; null without weight."""
    turned = [sum((F.get("rotation", 3 * i + k) * F.col(f"s{c}") for k, c in enumerate(AXES)), F.lit(0.0)) for i in range(3)]
    shift = [F.get("shift", i) for i in range(3)]
    cross = sum((F.get("rotation", 3 * i + k) * F.col(f"m{a}{b}") for i, b in enumerate(AXES) for k, a in enumerate(AXES)), F.lit(0.0))
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    target = [F.col(f"t{c}") for c in AXES]
    square = F.col("ss") + F.col("tt") + F.col("w") * dot(shift, shift) + 2 * dot(shift, turned) - 2 * dot(shift, target) - 2 * cross
    return F.when(F.col("w") > 0, F.sqrt(F.greatest(square, F.lit(0.0)) / F.col("w")))


def _named(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in AXES])


def anchor_chains(predicted: DataFrame, true: DataFrame, least: int = 4, polymer: int = 12) -> DataFrame:
    """pdb_id, entity_id, chain_id of the predicted chain of each structure that is laid on true ones.

    Chains of fewer than `least` tokens, and entities without a true chain of so many resolved ones, don't count.
    Of the rest polymers (at most half ligand, `polymer` tokens of the entity or more) come first, then entities
    with the fewest true copies, then long chains, then the least id.
    """
    ligand = F.sum(F.col("is_ligand").cast("long"))
    chains = predicted.groupBy("pdb_id", "entity_id", "chain_id").agg(F.count(F.lit(1)).alias("n"), ligand.alias("ligand"))
    entities = chains.groupBy("pdb_id", "entity_id").agg(((F.sum("n") >= polymer) & (2 * F.sum("ligand") <= F.sum("n"))).alias("polymer"))
    copies = true.groupBy("pdb_id", "entity_id", "chain_id").agg(F.sum(F.col("is_resolved").cast("long")).alias("resolved"))
    copies = copies.groupBy("pdb_id", "entity_id").agg(F.count(F.lit(1)).alias("copies"), F.max("resolved").alias("resolved"))
    fit = chains.where(F.col("n") >= least).join(entities, ["pdb_id", "entity_id"]).join(copies.where(F.col("resolved") >= least), ["pdb_id", "entity_id"])
    order = F.struct((~F.col("polymer")).alias("a"), "copies", (-F.col("n")).alias("b"), "chain_id", "entity_id")
    return fit.groupBy("pdb_id").agg(F.min(order).alias("o")).select("pdb_id", "o.entity_id", "o.chain_id")


def _greedy(candidates: Column) -> Column:
    """Array of (chain_id, true_chain): chains in the given order, each with the nearest true chain that is left.

    candidates: array of (chain_id, options), options being an array of (distance, true_chain). An unresolved option has no
    distance and is taken only when no other is left.
    """

    def step(done: Column, chain: Column) -> Column:
        left = F.filter(chain["options"], lambda o: ~F.array_contains(F.transform(done, lambda d: F.coalesce(d["true_chain"], F.lit(""))), o["true_chain"]))
        near = F.array_min(F.filter(left, lambda o: o["distance"].isNotNull()))["true_chain"]
        return F.concat(done, F.array(F.struct(chain["chain_id"].alias("chain_id"), F.coalesce(near, F.array_min(F.transform(left, lambda o: o["true_chain"]))).alias("true_chain"))))

    return F.aggregate(candidates, F.expr("CAST(array() AS array<struct<chain_id:string,true_chain:string>>)"), step)


def match_by_anchor(predicted: DataFrame, true: DataFrame, least: int = 4, polymer: int = 12, by_centre: bool = False) -> DataFrame:
    """The true chain of each predicted chain, by the anchor whose move brings the rest nearest.

    predicted: pdb_id, entity_id, chain_id, token, is_ligand, x, y, z; true: the same with is_resolved in place of is_ligand. Tokens
    are numbered within a chain, and are the same in all copies of an entity. Chain ids are read as text.

    Each true copy of the anchor's entity is laid on the anchor. The other chains, long ones first, take the nearest
    true chain of their entity that is left, by their centres; the copy with the least mean deviation
    of the chains wins (ties: the least id). Chains without resolved tokens count as zero.

    pdb_id, chain_id, true_chain, anchor, anchor_true, rmsd (of the chain; null if nothing of it is resolved), total (the mean).
    A structure without an anchor has no rows; a chain for which no true chain is left has none.
    """
    text = lambda df: df.withColumn("chain_id", F.col("chain_id").cast("string"))
    predicted, true = text(predicted), text(true)
    key = ["pdb_id", "entity_id"]
    pairs = _named(true.where("is_resolved").withColumnRenamed("chain_id", "true_chain"), "s", [*key, "true_chain", "token"]).join(_named(predicted, "t", [*key, "chain_id", "token"]), [*key, "token"])
    sums = moments(pairs, [*key, "chain_id", "true_chain"])
    sizes = predicted.groupBy(*key, "chain_id").agg(F.count(F.lit(1)).alias("n"))
    every = sizes.join(true.select(*key, F.col("chain_id").alias("true_chain")).distinct(), key, "left").join(sums, [*key, "chain_id", "true_chain"], "left")

    anchors = anchor_chains(predicted, true, least, polymer).select(*key, F.col("chain_id").alias("anchor"))
    moves = rigid_moves(sums.join(anchors, key).where("chain_id = anchor").withColumnRenamed("true_chain", "anchor_true"), ["pdb_id", "anchor", "anchor_true"])
    allowed = (F.col("chain_id") == F.col("anchor")) == F.col("true_chain").eqNullSafe(F.col("anchor_true"))
    tried = every.join(moves, "pdb_id").select("pdb_id", "anchor", "anchor_true", "entity_id", "chain_id", "true_chain", "n", centre_distance().alias("distance"), deviation().alias("rmsd"), allowed.alias("allowed"))
    if by_centre:
        tried = tried.withColumn("rmsd", F.col("distance"))

    search = ["pdb_id", "anchor", "anchor_true", "entity_id"]
    options = tried.groupBy(*search, "chain_id").agg(F.max("n").alias("n"), F.collect_list(F.when(F.col("allowed") & F.col("true_chain").isNotNull(), F.struct("distance", "true_chain"))).alias("options"))
    chains = F.sort_array(F.collect_list(F.struct((F.col("chain_id") != F.col("anchor")).alias("a"), (-F.col("n")).alias("b"), "chain_id", "options")))
    matched = options.groupBy(*search).agg(chains.alias("chains")).select(*search, F.inline(_greedy("chains")))
    scored = matched.join(tried.select(*search, "chain_id", "true_chain", "rmsd"), [*search, "chain_id", "true_chain"], "left")
    totals = scored.groupBy("pdb_id", "anchor_true").agg(F.avg(F.coalesce("rmsd", F.lit(0.0))).alias("total"))
    best = totals.groupBy("pdb_id").agg(F.min(F.struct("total", "anchor_true")).alias("b")).select("pdb_id", "b.anchor_true", "b.total")
    return scored.join(best, ["pdb_id", "anchor_true"]).select("pdb_id", "chain_id", "true_chain", "anchor", "anchor_true", "rmsd", "total")


def match_pockets(predicted: DataFrame, true: DataFrame, by_centre: bool = False, least_gain: float = 1e-12) -> DataFrame:
    """The copies of a pocket and of its ligand in each sample whose ligand lies best once the pocket is laid on the true one.

    predicted: pdb_id, sample, entity_id, chain_id, token, x, y, z. true: pdb_id, entity_id, chain_id, token, is_resolved, is_pocket,
    is_ligand, x, y, z, where pocket and ligand are parts of one chain each. Candidates are the chains of the
    same entities, at the tokens of the true pocket and ligand; ties go to the least pocket, then the least ligand.

    pdb_id, sample, pocket_chain, ligand_chain, rmsd, unpermuted_rmsd, permuted_pocket, permuted_ligand, outcome (better, worse or equal to the
    chains as they are named, by at least least_gain; null if those can't be fitted).
    """
    where = ["pdb_id", "entity_id", "token"]
    source = _named(predicted, "s", [*where, "sample", "chain_id"])
    side = lambda flag: _named(true.where(F.col(flag) & F.col("is_resolved")), "t", where)
    own = lambda flag: true.where(flag).groupBy("pdb_id").agg(F.min("chain_id").alias(flag))
    at = ["pdb_id", "sample", "chain_id"]
    pockets = rigid_moves(moments(source.join(side("is_pocket"), where), at), at).withColumnRenamed("chain_id", "pocket_chain")
    ligands = moments(source.join(side("is_ligand"), where), at).withColumnRenamed("chain_id", "ligand_chain")
    rmsd = centre_distance() if by_centre else deviation()
    tried = pockets.join(ligands, ["pdb_id", "sample"]).select("pdb_id", "sample", "pocket_chain", "ligand_chain", rmsd.alias("rmsd"))
    tried = tried.join(own("is_pocket"), "pdb_id").join(own("is_ligand"), "pdb_id")
    named = (F.col("pocket_chain") == F.col("is_pocket")) & (F.col("ligand_chain") == F.col("is_ligand"))
    best = tried.groupBy("pdb_id", "sample").agg(F.min(F.struct("rmsd", "pocket_chain", "ligand_chain", "is_pocket", "is_ligand")).alias("b"), F.min(F.when(named, F.col("rmsd"))).alias("unpermuted_rmsd"))
    gain = F.col("unpermuted_rmsd") - F.col("rmsd")
    outcome = F.when(gain >= least_gain, "better").when(gain < 0, "worse").when(gain.isNotNull(), "equal")
    return best.select("pdb_id", "sample", "b.*", "unpermuted_rmsd").select(
        "pdb_id", "sample", "pocket_chain", "ligand_chain", "rmsd", "unpermuted_rmsd", (F.col("pocket_chain") != F.col("is_pocket")).alias("permuted_pocket"), (F.col("ligand_chain") != F.col("is_ligand")).alias("permuted_ligand"), outcome.alias("outcome")
    )
