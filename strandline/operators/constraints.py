"""Constraints sampled for training: contacts, pockets and substructures, and tokens split for contacts of atoms.

A draw is a hash of a key and a purpose, so each choice is the same on any cluster, and choices under one seed don't hang
on their order. Choosing k of n without replacement is the k least draws. What a later step may choose hangs on
earlier ones: contacts of atoms split their tokens first, and pockets, contacts and substructures
are then sampled over the tokens that are left.

Tokens have pdb_id, token, chain_id, kind (P for polymers, L for ligands), is_resolved, x, y, z.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators import entities, substructure
from strandline.operators.spatial import grid_pairs
from strandline.operators.substructure import draw

AXES = ("x", "y", "z")
Ranges = dict[str, tuple[float, float]]


def _key(*columns: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def size_drawn(size: float, key: Column, purpose: str) -> Column:
    """size itself from 1 on; below it, a geometric number (1, 2, ...) with that chance of ending."""
    if size <= 0:
        raise ValueError("a size is a whole number, or a chance below 1")
    if size >= 1:
        return F.lit(int(size))
    return F.floor(F.log(draw(key, purpose)) / F.log(F.lit(1.0 - size))).cast("long") + 1


def _thresholds(ranges: Ranges, pdb: str, purpose: str) -> dict[str, Column]:
    """The greatest distance of each type, drawn for each structure within its range."""
    return {kind: F.lit(float(low)) + draw(F.col(pdb), f"{purpose}:{kind}") * float(high - low) for kind, (low, high) in ranges.items()}


def _chosen(tokens: DataFrame, prob: float, purpose: str) -> DataFrame:
    """The tokens of the structures that get this constraint."""
    return tokens.where(draw(F.col("pdb_id"), purpose) < prob)


def _last(valid: dict[str, Column], value: dict[str, Column]) -> Column:
    """The value of the last type that holds; null if none does."""
    return F.coalesce(*[F.when(valid[k], value[k]) for k in reversed(valid)])


def contacts(
    tokens: DataFrame, ranges: Ranges, size: float, seed: int, group: str = "complex", least: float = 0.0, prob: float = 1.0, interfaces: DataFrame | None = None, apart: int = 20, purpose: str = "contact", key: str = "token"
) -> DataFrame:
    """pdb_id, i, j, least, most: sampled contacts, in both directions.

    ranges: by pair of kinds (PP, PL, ...; P_ within a chain, at least `apart` tokens away) the range of the greatest distance; where
    several types hold, the last counts. least: -1 draws a least distance below the greatest, which may leave no pair.
    size: contacts of a structure (group complex), or of each pair of chains (interface; of those in interfaces (pdb_id,
    chain_1, chain_2) where given).
    """
    if group not in ("complex", "interface"):
        raise ValueError(f"group is complex or interface, not {group!r}")
    top = max(high for _, high in ranges.values())
    rows = _chosen(tokens.where("is_resolved"), prob, f"{seed}:{purpose}").select("pdb_id", F.col(key).alias("token"), "chain_id", "kind", *AXES)
    near = grid_pairs(rows, rows, top, strict=False).where("a.token < b.token")
    near = near.select("a.pdb_id", F.col("a.token").alias("i"), F.col("b.token").alias("j"), F.col("a.chain_id").alias("ci"), F.col("b.chain_id").alias("cj"), F.col("a.kind").alias("ki"), F.col("b.kind").alias("kj"), "d")
    most = _thresholds(ranges, "pdb_id", f"{seed}:{purpose}")

    def valid(kind: str) -> Column:
        one, two = kind
        if two == "_":
            place = (F.col("ci") == F.col("cj")) & (F.col("j") - F.col("i") >= apart)
        else:
            place = (F.col("ci") != F.col("cj")) & (((F.col("ki") == one) & (F.col("kj") == two)) | ((F.col("ki") == two) & (F.col("kj") == one)))
        low = draw(F.col("pdb_id"), f"{seed}:{purpose}:{kind}:least") * most[kind] if least == -1 else F.lit(float(least))
        return place & (F.col("d") <= most[kind]) & (F.col("d") >= low)

    found = near.withColumn("most", _last({k: valid(k) for k in ranges}, most)).where("most IS NOT NULL")
    if group == "interface":
        found = found.withColumn("c1", F.least("ci", "cj")).withColumn("c2", F.greatest("ci", "cj")).where("c1 <> c2")
        if interfaces is not None:
            pairs = interfaces.select("pdb_id", F.least("chain_1", "chain_2").alias("c1"), F.greatest("chain_1", "chain_2").alias("c2")).distinct()
            found = found.join(pairs, ["pdb_id", "c1", "c2"], "left_semi")
        by = ["pdb_id", "c1", "c2"]
    else:
        by = ["pdb_id"]
    order = W.partitionBy(*by).orderBy(draw(_key("pdb_id", "i", "j"), f"{seed}:{purpose}:pair"), "i", "j")
    picked = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size_drawn(size, _key(*by), f"{seed}:{purpose}:size"))
    one = picked.select("pdb_id", "i", "j", F.lit(0.0).alias("least"), "most")
    return one.unionByName(one.select("pdb_id", F.col("j").alias("i"), F.col("i").alias("j"), "least", "most"))


def pockets(tokens: DataFrame, ranges: Ranges, size: float, seed: int, prob: float = 1.0, binders: DataFrame | None = None, purpose: str = "pocket") -> DataFrame:
    """pdb_id, binder, token, most: of one binder chain of each structure, tokens of its pocket.

    ranges: by kinds of binder and pocket (LP, PP). A binder has more than one token. It is drawn from the chains with a pocket, or given
    by binders (pdb_id, chain_id). The greatest distance is that of the last type under which the token is near the binder.
    """
    top = max(high for _, high in ranges.values())
    chosen = _chosen(tokens, prob, f"{seed}:{purpose}").select("pdb_id", "token", "chain_id", "kind", "is_resolved", *AXES)
    able = chosen.groupBy("pdb_id", "chain_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pdb_id", "chain_id")
    if binders is not None:
        able = able.join(binders.select("pdb_id", "chain_id").distinct(), ["pdb_id", "chain_id"], "left_semi")
    resolved = chosen.where("is_resolved").drop("is_resolved")
    near = grid_pairs(resolved.join(able, ["pdb_id", "chain_id"], "left_semi"), resolved, top, strict=False).where("a.chain_id <> b.chain_id")
    most = _thresholds(ranges, "pdb_id", f"{seed}:{purpose}")
    near = near.select("a.pdb_id", F.col("a.chain_id").alias("binder"), F.col("a.kind").alias("ka"), "b.token", F.col("b.kind").alias("kb"), "d")
    valid = {k: (F.col("ka") == k[0]) & (F.col("kb") == k[1]) & (F.col("d") <= most[k]) for k in ranges}
    near = near.where(reduce(or_, valid.values()))
    found = near.groupBy("pdb_id", "binder", "token").agg(*[F.bool_or(v).alias(f"is_{k}") for k, v in valid.items()])
    found = found.select("pdb_id", "binder", "token", _last({k: F.col(f"is_{k}") for k in ranges}, most).alias("most"))
    drawn = found.select("pdb_id", "binder").distinct().groupBy("pdb_id").agg(F.min(F.struct(draw(_key("pdb_id", "binder"), f"{seed}:{purpose}:binder").alias("u"), "binder")).alias("b"))
    own = found.join(drawn.select("pdb_id", F.col("b.binder").alias("binder")), ["pdb_id", "binder"], "left_semi")
    order = W.partitionBy("pdb_id").orderBy(draw(_key("pdb_id", "token"), f"{seed}:{purpose}:token"), "token")
    return own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size_drawn(size, F.col("pdb_id"), f"{seed}:{purpose}:size")).drop("nth")


def substructures(
    tokens: DataFrame, type_pairs: list[tuple[str, str, float]], size: float, seed: int, full: tuple[float, ...] = (0.0, 0.5, 1.0), partial: float = 0.3, prob: float = 1.0, chains: DataFrame | None = None, purpose: str = "substructure"
) -> DataFrame:
    """pdb_id, chain_id, token, part: resolved tokens of chains that touch another chain.

    size chains of a structure are drawn, a drawn share of `full` of them whole and of the rest a drawn share of tokens, one at
    least. A chain that touches others under two type pairs has two chances. chains (pdb_id, chain_id) names the chain instead; then the
    share is `partial`, and a chain that touches none gives nothing.
    """
    touching = substructure.interface_chains(_chosen(tokens, prob, f"{seed}:{purpose}"), type_pairs)
    resolved = tokens.where("is_resolved").select("pdb_id", "chain_id", "token")
    counts = resolved.groupBy("pdb_id", "chain_id").agg(F.count(F.lit(1)).alias("n"))
    if chains is not None:
        named = touching.select("pdb_id", "chain_id").distinct().join(chains.select("pdb_id", "chain_id").distinct(), ["pdb_id", "chain_id"], "left_semi")
        taken = named.join(counts, ["pdb_id", "chain_id"]).select("pdb_id", "chain_id", F.lit("partial").alias("part"), F.greatest(F.lit(1), F.floor(F.col("n") * partial)).alias("k"))
    else:
        order = W.partitionBy("pdb_id").orderBy(draw(_key("pdb_id", "chain_id", "kinds"), f"{seed}:{purpose}:chain"), "chain_id", "kinds")
        ranked = touching.withColumn("nth", F.row_number().over(order)).withColumn("valid", F.count(F.lit(1)).over(W.partitionBy("pdb_id")))
        ranked = ranked.withColumn("size", size_drawn(size, F.col("pdb_id"), f"{seed}:{purpose}:size"))
        share = F.element_at(F.array(*[F.lit(float(x)) for x in full]), F.floor(draw(F.col("pdb_id"), f"{seed}:{purpose}:full") * len(full)).cast("int") + 1)
        ranked = ranked.withColumn("whole", F.least(F.floor(F.col("size") * share), F.col("valid")))
        ranked = ranked.where(F.col("nth") <= F.col("whole") + F.least(F.col("size") - F.col("whole"), F.col("valid") - F.col("whole")))
        part = F.when(F.col("nth") <= F.col("whole"), "full").otherwise("partial")
        some = F.greatest(F.lit(1), F.floor(F.col("n") * draw(_key("pdb_id", "chain_id", "kinds"), f"{seed}:{purpose}:share")))
        taken = ranked.join(counts, ["pdb_id", "chain_id"]).select("pdb_id", "chain_id", "n", part.alias("part"), F.when(part == "full", F.col("n")).otherwise(some).alias("k"))
        taken = taken.groupBy("pdb_id", "chain_id").agg(F.min("part").alias("part"), F.max("k").alias("k"))
    order = W.partitionBy("pdb_id", "chain_id").orderBy(draw(_key("pdb_id", "chain_id", "token"), f"{seed}:{purpose}:token"), "token")
    rows = resolved.withColumn("nth", F.row_number().over(order)).join(taken, ["pdb_id", "chain_id"])
    return rows.where(F.col("nth") <= F.col("k")).select("pdb_id", "chain_id", "token", "part")


@dataclass(frozen=True)
class Sampling:
    """What is sampled: for each kind the arguments of its function, prob among them; a kind without an entry is left out."""

    atom_contact: dict = field(default_factory=dict)
    pocket: dict = field(default_factory=dict)
    contact: dict = field(default_factory=dict)
    substructure: dict = field(default_factory=dict)
    seed: int = 0


def sample(tokens: DataFrame, atoms: DataFrame, plan: Sampling) -> tuple[DataFrame, DataFrame]:
    """The constraints (pdb_id, constraint, i, j, least, most), and the tokens that they are over (old, new, atom_idx and a token's columns).

    tokens also has is_standard; atoms: pdb_id, atom_idx, token, is_resolved, x, y, z. Contacts of atoms are sampled first, and their
    standard polymer residues split into atoms. i and j are new tokens; a substructure's row has its token as both.
    """
    flat = lambda df, name: df.select("pdb_id", F.lit(name).alias("constraint"), "i", "j", "least", "most")
    of_token = tokens.select("pdb_id", "token", "chain_id", "kind", "is_standard")
    placed = atoms.select("pdb_id", "atom_idx", "token", "is_resolved", *AXES).join(of_token, ["pdb_id", "token"])
    pairs = None
    if plan.atom_contact:
        pairs = contacts(placed, seed=plan.seed, purpose="atom_contact", key="atom_idx", **plan.atom_contact)
        ends = pairs.select("pdb_id", F.col("i").alias("atom_idx")).distinct().join(atoms.select("pdb_id", "atom_idx", "token"), ["pdb_id", "atom_idx"]).select("pdb_id", "token")
    else:
        ends = tokens.select("pdb_id", "token").limit(0)
    mapped = entities.atom_tokens(tokens.select("pdb_id", "token", "is_standard", (F.col("kind") == "L").alias("is_ligand")), atoms, ends)
    whole = tokens.select("pdb_id", F.col("token").alias("old"), "chain_id", "kind", F.col("is_resolved").alias("r"), *[F.col(c).alias(f"_{c}") for c in AXES])
    own = atoms.select("pdb_id", "atom_idx", F.col("is_resolved").alias("ar"), *[F.col(c).alias(f"a{c}") for c in AXES])
    new = mapped.join(whole, ["pdb_id", "old"]).join(own, ["pdb_id", "atom_idx"], "left")
    new = new.select("pdb_id", "old", "new", "atom_idx", F.col("new").alias("token"), "chain_id", "kind", F.coalesce("ar", "r").alias("is_resolved"), *[F.coalesce(f"a{c}", f"_{c}").alias(c) for c in AXES])
    out = []
    if pairs is not None:
        # An atom's token is its own one if it was split off, else the one that its old token became.
        at = atoms.select("pdb_id", "atom_idx", F.col("token").alias("old")).join(mapped.select("pdb_id", "old", F.col("atom_idx").alias("split"), "new"), ["pdb_id", "old"]).where("split IS NULL OR split = atom_idx").select("pdb_id", "atom_idx", "new")
        ends_of = lambda side: at.select("pdb_id", F.col("atom_idx").alias(side), F.col("new").alias(f"t{side}"))
        named = pairs.join(ends_of("i"), ["pdb_id", "i"]).join(ends_of("j"), ["pdb_id", "j"])
        out.append(flat(named.select("pdb_id", F.col("ti").alias("i"), F.col("tj").alias("j"), "least", "most"), "atom_contact"))
    if plan.pocket:
        found = pockets(new, seed=plan.seed, **plan.pocket)
        binder = new.select("pdb_id", F.col("chain_id").alias("binder"), F.col("token").alias("i"))
        out.append(flat(found.join(binder, ["pdb_id", "binder"]).select("pdb_id", "i", F.col("token").alias("j"), F.lit(0.0).alias("least"), "most"), "pocket"))
    if plan.contact:
        out.append(flat(contacts(new, seed=plan.seed, **plan.contact), "contact"))
    if plan.substructure:
        found = substructures(new, seed=plan.seed, **plan.substructure)
        out.append(flat(found.select("pdb_id", F.col("token").alias("i"), F.col("token").alias("j"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most")), "substructure"))
    if not out:
        raise ValueError("the plan samples nothing")
    return reduce(DataFrame.unionByName, out), new
