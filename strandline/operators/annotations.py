"""Annotations, exact matches, constraints, frames and energies on atom tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators import blocks
from strandline.operators.kernels import typed
from strandline.operators.spatial import AXES, grid_pairs
from strandline.shared import materialise

PURINES, PYRIMIDINES = ("A", "G", "DA", "DG"), ("C", "U", "DC", "DT")


def representative_atoms(atoms: DataFrame, standard: tuple[str, ...]) -> DataFrame:
    """Adds is_centre, is_distogram_rep and is_plddt_rep; a residue without a distogram atom takes its first."""
    std, name, res = F.col("res_name").isin(*standard), F.col("atom_name"), F.col("res_name")
    main = name == F.when(F.length(res) == 3, "CA").otherwise("C1'")
    beta = F.when(res == "GLY", name == "CA").when(F.length(res) == 3, name == "CB").when(res.isin(*PURINES), name == "C4").when(res.isin(*PYRIMIDINES), name == "C2").otherwise(F.lit(False))
    w = W.partitionBy("pdb_id", "chain_id", "res_id")
    rows = atoms.withColumn("is_centre", F.when(std, main).otherwise(True)).withColumn("is_plddt_rep", std & main).withColumn("_b", std & beta)
    return rows.withColumn("is_distogram_rep", F.when(F.bool_or("_b").over(w), F.col("_b")).otherwise(F.col("atom_idx") == F.min("atom_idx").over(w))).drop("_b")


def uid_extent(atoms: DataFrame, by: list[str]) -> DataFrame:
    """First and last atom of each group, and whether it is a single atom."""
    return atoms.groupBy(*by).agg(F.min("atom_idx").alias("first"), F.max("atom_idx").alias("last"), (F.count(F.lit(1)) == 1).alias("is_single"))


def exact_matches(queries: DataFrame, reference: DataFrame, keys: list[str], index: str) -> DataFrame:
    """queries with the index of the reference row that has the same keys, -1 without one; a queried key with several is an error."""
    found = reference.groupBy(*keys).agg(F.min(index).alias("match"), F.count(F.lit(1)).alias("_n"))
    joined = queries.join(found, keys, "left")
    match = F.when(F.col("_n") > 1, F.raise_error(F.lit("a queried key matches several rows")).cast("long")).otherwise(F.coalesce("match", F.lit(-1)))
    return joined.withColumn("match", match).drop("_n")


def within_distance(env: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """Rows of env within radius of any query row."""
    near = grid_pairs(env, queries, radius, strict=False).select("a.pdb_id", "a.atom_idx").distinct()
    return env.join(near, ["pdb_id", "atom_idx"], "left_semi")


def near_chains(atoms: DataFrame, core: Column, radius: float) -> DataFrame:
    """Chains with any atom within radius of the core atoms: pdb_id, chain_id."""
    return grid_pairs(atoms, atoms.where(core), radius, strict=False).select("a.pdb_id", "a.chain_id").distinct()


def seeded_order(key: str, seed: int) -> Column:
    """A pseudo-random order of integer keys that any engine can compute."""
    return F.pmod(F.col(key) * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))


def shuffled_ids(rows: DataFrame, within: list[str], key: str, seed: int, name: str) -> DataFrame:
    """A permutation of the distinct keys of each group, from 0."""
    distinct = rows.select(*within, key).distinct()
    numbered = distinct.withColumn(name, F.row_number().over(W.partitionBy(*within).orderBy(seeded_order(key, seed), key)) - 1)
    return rows.join(numbered, [*within, key])


def equivalence_bounds(pairs: DataFrame, group_i: str, group_j: str, upper: str, lower: str, within: list[str]) -> DataFrame:
    """The largest upper and least lower bound of each unordered group pair, on every row."""
    low, high = F.least(group_i, group_j).alias("_lo"), F.greatest(group_i, group_j).alias("_hi")
    rows = pairs.select("*", low, high)
    bounds = rows.groupBy(*within, "_lo", "_hi").agg(F.max(upper).alias("upper_bound"), F.min(lower).alias("lower_bound"))
    return rows.join(bounds, [*within, "_lo", "_hi"]).drop("_lo", "_hi")


#: Rows of bounds up to which they are broadcast.
BROADCAST_ROWS = 500_000


def equivalence_bounds_of_atoms(atoms: DataFrame, group: str, places: int) -> DataFrame:
    """pdb_id, i, j, upper_bound, lower_bound: `equivalence_bounds` of the distances of all atom pairs i < j, rounded.

    Bounds are taken in the tasks that meet the atoms; the pairs then join them where they are listed, unless there are very many.
    """
    found = blocks.group_extremes(atoms, group).groupBy("pdb_id", F.col("a").alias("_lo"), F.col("b").alias("_hi"))
    bounds = materialise(found.agg(F.round(F.max("most"), places).alias("upper_bound"), F.round(F.min("least"), places).alias("lower_bound")), "bounds")
    pairs = blocks.pairs(atoms, [group], lambda d: {}, "").withColumn("_lo", F.least(f"{group}_i", f"{group}_j")).withColumn("_hi", F.greatest(f"{group}_i", f"{group}_j"))
    small = F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds
    return pairs.join(small, ["pdb_id", "_lo", "_hi"]).select("pdb_id", "i", "j", "upper_bound", "lower_bound")


def masked_mean(value: Column, mask: Column, eps: float = 1e-12) -> Column:
    return F.sum(value * mask.cast("double")) / (F.sum(mask.cast("double")) + eps)


def merge_copies(bonds: DataFrame, counts: DataFrame, ends: list[str]) -> DataFrame:
    """Bonds between copies of two entities: one row without copies where every copy has the bond, else all rows.

    bonds has entity1, entity2, copy1, copy2 and the columns `ends`; counts has entity, n.
    """
    by = ["entity1", "entity2", *ends]
    groups = bonds.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    one, two = (counts.select(F.col("entity").alias(f"entity{k}"), F.col("n").alias(f"_n{k}")) for k in (1, 2))
    groups = groups.join(one, "entity1").join(two, "entity2").withColumn("_all", (F.col("_n") == F.col("_n1")) & (F.col("_n") == F.col("_n2"))).select(*by, "_all")
    rows = bonds.join(groups, by)
    whole = rows.where("_all").select(*by).distinct().select(*by, F.lit(None).cast("long").alias("copy1"), F.lit(None).cast("long").alias("copy2"))
    return rows.where("NOT _all").select(*by, "copy1", "copy2").unionByName(whole)


def entity_copies(entities: DataFrame, chain_name) -> DataFrame:
    """One row for each copy of an entity (entity, n), numbered and named over all copies in order of entities.

    The copies before an entity are summed by parts of the sorted table, so no task holds all entities.
    """
    placed = materialise(entities.orderBy("entity").withColumn("_part", F.spark_partition_id()), "entities")
    sums = placed.groupBy("_part").agg(F.sum("n").alias("_n"))
    earlier = sums.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("_part").orderBy("entity").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = placed.withColumn("_inside", inside).join(F.broadcast(earlier), "_part")  # one row for each part
    rows = rows.where("n > 0").withColumn("_before", F.col("_inside") + F.col("_earlier")).withColumn("copy", F.explode(F.expr("sequence(1L, CAST(n AS BIGINT))")))
    return rows.withColumn("chain", chain_name(F.col("_before") + F.col("copy"))).drop("_part", "_inside", "_earlier", "_before")


def _minus(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in AXES]


def _dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _unit(u: list[Column], eps: float) -> list[Column]:
    n = F.greatest(F.sqrt(_dot(u, u)), F.lit(eps))
    return [x / n for x in u]


def in_frame(rows: DataFrame, point: str, a: str, b: str, c: str, eps: float = 1e-8) -> DataFrame:
    """Coordinates fx, fy, fz of a point in the frame of three points, whose origin is b.

    The axes are added column by column, so that no expression holds another twice.
    """
    out = rows
    for i, u in enumerate(_unit(_minus(a, b), eps)):
        out = out.withColumn(f"_u{i}", u)
    for i, v in enumerate(_unit(_minus(c, b), eps)):
        out = out.withColumn(f"_v{i}", v)
    u, v = ([F.col(f"_{n}{i}") for i in range(3)] for n in "uv")
    e1, e2 = _unit([x + y for x, y in zip(u, v)], eps), _unit([y - x for x, y in zip(u, v)], eps)
    out = out.select("*", *[x.alias(f"_p{i}") for i, x in enumerate(e1)], *[x.alias(f"_q{i}") for i, x in enumerate(e2)])
    p, q = ([F.col(f"_{n}{i}") for i in range(3)] for n in "pq")
    d = _minus(point, b)
    return out.select(*rows.columns, _dot(d, p).alias("fx"), _dot(d, q).alias("fy"), _dot(d, _cross(p, q)).alias("fz"))


def dihedral(a: str, b: str, c: str, d: str) -> Column:
    """Signed angle between the planes a b c and b c d, in radians."""
    b1, b2, b3 = _minus(b, a), _minus(c, b), _minus(d, c)
    n1, n2 = _cross(b1, b2), _cross(b2, b3)
    return F.atan2(_dot(_cross(n1, n2), b2) / F.sqrt(_dot(b2, b2)), _dot(n1, n2))


def torsion_energy(phi: Column, v: list[float], signs: list[int]) -> Column:
    """Sum over n of v_n (1 + s_n cos n phi)."""
    total = F.lit(0.0)
    for n, (k, s) in enumerate(zip(v, signs), 1):
        total = total + k * (1 + s * F.cos(n * phi))
    return total


def best_permutation(rows: DataFrame, permutations: DataFrame) -> DataFrame:
    """The permutation of each residue's atoms with the least squared deviation; of ties the first.

    rows: residue, slot, x.., px..; permutations: residue, perm, slot, source (the predicted slot that takes its place).
    """
    true = rows.select("residue", "slot", *AXES)
    predicted = rows.select("residue", F.col("slot").alias("source"), *[f"p{c}" for c in AXES])
    both = permutations.join(true, ["residue", "slot"]).join(predicted, ["residue", "source"])
    square = sum((F.pow(F.col(f"p{c}") - F.col(c), 2) for c in "yz"), F.pow(F.col("px") - F.col("x"), 2))
    cost = both.groupBy("residue", "perm").agg(F.sum(square).alias("cost"))
    return cost.groupBy("residue").agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "perm")).alias("b")).select("residue", F.col("b.perm").alias("perm"), F.col("b.cost").alias("cost"))


def match_chains(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """Greedy assignment of predicted to true chains of one entity by their centroids, nearest first; pdb_id, entity_id, chain_id, x, y, z on both sides."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            d = np.linalg.norm(left[list(AXES)].to_numpy()[:, None] - right[list(AXES)].to_numpy()[None], axis=2)
            order = sorted((d[i, j], left["chain_id"].iloc[i], right["chain_id"].iloc[j]) for i in range(len(left)) for j in range(len(right)))
            used_a, used_b = set(), set()
            for dist, a, b in order:
                if a not in used_a and b not in used_b:
                    used_a.add(a)
                    used_b.add(b)
                    out.append((key[0], key[1], a, b, dist))
        return pd.DataFrame(out, columns=["pdb_id", "entity_id", "chain_id", "predicted", "distance"])

    true, predicted = (df.toDF(*df.columns) for df in (true, predicted))
    return true.groupBy("pdb_id", "entity_id").cogroup(predicted.groupBy("pdb_id", "entity_id")).applyInPandas(run, f"{typed(true, 'pdb_id', 'entity_id', 'chain_id')}, predicted {predicted.schema['chain_id'].dataType.simpleString()}, distance double")


def pocket_constraint(atoms: DataFrame, binder: Column, radius: float, size: int, seed: int) -> DataFrame:
    """At most `size` residues near the binder chain of each structure, in a seeded order."""
    near = within_distance(atoms.where(~binder), atoms.where(binder), radius).select("pdb_id", "res_id").distinct()
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("pdb_id").orderBy(seeded_order("res_id", seed), "res_id")))
    return ranked.where(F.col("rank") <= size)
