"""Sampled constraints: what holds for every draw, and chances over many structures."""

import math
from collections import Counter, defaultdict

import pytest

from strandline.operators import constraints

SCHEMA = "pdb_id long, token long, chain_id long, kind string, is_standard boolean, is_resolved boolean, x double, y double, z double"


def line_tokens(spark, structures, n=24):
    """Tokens a unit apart on three parallel lines, a unit from one another; the third is a ligand."""
    rows = [(s, c * n + i, c, "L" if c == 2 else "P", c != 2, i % 11 != 3, float(i), float(c), 0.0) for s in range(structures) for c in range(3) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_contacts_hold(spark):
    tokens = line_tokens(spark, 40)
    at = {(r["pdb_id"], r["token"]): r for r in tokens.collect()}
    ranges = {"PP": (1.0, 2.0), "PL": (1.5, 3.0), "P_": (20.0, 22.0)}
    rows = constraints.contacts(tokens, ranges, 3, 1).collect()
    both = {(r["pdb_id"], r["i"], r["j"]): r["most"] for r in rows}
    assert all(both[s, j, i] == m for (s, i, j), m in both.items()) and len(both) == len(rows)
    assert set(Counter(s for s, i, j in both if i < j).values()) == {3}
    for (s, i, j), most in both.items():
        a, b = at[s, i], at[s, j]
        assert a["is_resolved"] and b["is_resolved"] and math.dist((a["x"], a["y"]), (b["x"], b["y"])) <= most
        low, high = ranges["P_" if a["chain_id"] == b["chain_id"] else "PP" if a["kind"] == b["kind"] else "PL"]
        assert low <= most <= high and (a["chain_id"] != b["chain_id"] or abs(i - j) >= 20)
    # one threshold of a type for each structure
    of_type = defaultdict(set)
    for (s, i, j), most in both.items():
        of_type[s, at[s, i]["kind"] + at[s, j]["kind"], at[s, i]["chain_id"] == at[s, j]["chain_id"]].add(most)
    assert all(len({m for k, v in of_type.items() if k[0] == s and not k[2] and k[1] == "PP" for m in v}) <= 1 for s in range(40))


def test_contacts_of_interfaces_and_chances(spark):
    tokens = line_tokens(spark, 200)
    named = spark.createDataFrame([(s, 1, 0) for s in range(200)], "pdb_id long, chain_1 long, chain_2 long")
    rows = constraints.contacts(tokens, {"PP": (2.0, 2.0)}, 0.25, 2, group="interface", interfaces=named).where("i < j").collect()
    sizes = Counter(r["pdb_id"] for r in rows)
    assert len(sizes) == 200 and sum(sizes.values()) / 200 == pytest.approx(4.0, abs=0.8)  # geometric: mean 1 / p
    half = constraints.contacts(tokens, {"PP": (2.0, 2.0)}, 1, 2, prob=0.5).select("pdb_id").distinct().count()
    assert 70 <= half <= 130
    # every valid pair has the same chance
    picked = Counter((r["i"], r["j"]) for r in constraints.contacts(tokens, {"PP": (1.0, 1.0)}, 5, 9).where("i < j").collect())
    valid = sum(i % 11 != 3 for i in range(24))
    assert len(picked) == valid and max(picked.values()) < 2 * min(picked.values())


def test_pocket_holds(spark):
    tokens = line_tokens(spark, 60)
    at = {(r["pdb_id"], r["token"]): r for r in tokens.collect()}
    rows = constraints.pockets(tokens, {"LP": (1.0, 2.5)}, 4, 3).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["pdb_id"]].append(r)
    assert len(by) == 60 and all(len(v) == 4 and {r["binder"] for r in v} == {2} for v in by.values())
    for r in rows:
        t = at[r["pdb_id"], r["token"]]
        near = min(math.dist((t["x"], t["y"]), (b["x"], b["y"])) for (s, _), b in at.items() if s == r["pdb_id"] and b["chain_id"] == 2 and b["is_resolved"])
        assert t["kind"] == "P" and t["is_resolved"] and near <= r["most"]
    binders = Counter(r["binder"] for r in constraints.pockets(tokens, {"PP": (1.5, 1.5)}, 1, 3).collect())
    assert set(binders) == {0, 1} and min(binders.values()) >= 15
    given = spark.createDataFrame([(s, 1) for s in range(60)], "pdb_id long, chain_id long")
    assert {r["binder"] for r in constraints.pockets(tokens, {"PP": (1.5, 1.5)}, 1, 3, binders=given).collect()} == {1}
    assert constraints.pockets(tokens.where("chain_id < 2 OR token = 48"), {"LP": (1.0, 9.0)}, 4, 3).count() == 0  # a binder of one token


def test_substructure_holds(spark):
    tokens = line_tokens(spark, 60)
    resolved = {(r["pdb_id"], r["token"]) for r in tokens.where("is_resolved").collect()}
    n = Counter((s, t // 24) for s, t in resolved)
    rows = constraints.substructures(tokens, [("P", "P", 1.5), ("P", "L", 1.5)], 2, 5).collect()
    sizes = Counter((r["pdb_id"], r["chain_id"], r["part"]) for r in rows)
    assert {(r["pdb_id"], r["token"]) for r in rows} <= resolved and {c for _, c, _ in sizes} <= {0, 1}
    assert all(k == n[s, c] if part == "full" else 1 <= k <= n[s, c] for (s, c, part), k in sizes.items())
    assert {"full", "partial"} == {part for _, _, part in sizes}
    named = spark.createDataFrame([(s, s % 3) for s in range(60)], "pdb_id long, chain_id long")
    rows = constraints.substructures(tokens, [("P", "P", 1.5)], 1, 5, partial=0.3, chains=named).collect()
    assert Counter(r["pdb_id"] for r in rows) == {s: int(n[s, s % 3] * 0.3) for s in range(60) if s % 3 < 2}


def test_atom_contacts_split_their_tokens_first(spark):
    tokens = line_tokens(spark, 5)
    rows = [(r["pdb_id"], r["token"] * 2 + k, r["token"], r["is_resolved"], r["x"] + 0.25 * k, r["y"], r["z"]) for r in tokens.collect() for k in range(2)]
    atoms = spark.createDataFrame(rows, "pdb_id long, atom_idx long, token long, is_resolved boolean, x double, y double, z double")
    plan = constraints.Sampling(
        atom_contact={"ranges": {"PP": (1.0, 1.5), "PL": (1.0, 1.5)}, "size": 2}, contact={"ranges": {"PP": (1.0, 2.0)}, "size": 3}, pocket={"ranges": {"LP": (1.0, 2.0)}, "size": 2}, substructure={"type_pairs": [("P", "P", 2.0)], "size": 1}, seed=8,
    )
    found, new = constraints.sample(tokens, atoms, plan)
    rows, new = found.collect(), {(r["pdb_id"], r["new"]): r for r in new.collect()}
    assert {r["constraint"] for r in rows} == {"atom_contact", "contact", "pocket", "substructure"}
    split = {(s, r["old"]) for (s, _), r in new.items() if r["atom_idx"] is not None}
    ends = {(r["pdb_id"], new[r["pdb_id"], r["i"]]["old"]) for r in rows if r["constraint"] == "atom_contact"}
    assert split == {(s, old) for s, old in ends if old < 48}  # ligands stay whole
    assert len(new) == 5 * 72 + len(split)
    assert Counter(r["pdb_id"] for r in rows if r["constraint"] == "atom_contact") == {s: 4 for s in range(5)}
    assert all((r["pdb_id"], r["i"]) in new and (r["pdb_id"], r["j"]) in new for r in rows)
    # a contact of atoms that were split is one of their own tokens
    for r in rows:
        if r["constraint"] == "atom_contact":
            a, b = new[r["pdb_id"], r["i"]], new[r["pdb_id"], r["j"]]
            assert all(t["kind"] == "L" or t["atom_idx"] is not None for t in (a, b))


def test_empty_and_wrong(spark):
    tokens = line_tokens(spark, 1).limit(0)
    assert constraints.contacts(tokens, {"PP": (1.0, 2.0)}, 3, 1).count() == 0 and constraints.pockets(tokens, {"LP": (1.0, 2.0)}, 3, 1).count() == 0
    assert constraints.substructures(tokens, [("P", "P", 2.0)], 1, 1).count() == 0
    with pytest.raises(ValueError):
        constraints.contacts(tokens, {"PP": (1.0, 2.0)}, 0, 1)
    with pytest.raises(ValueError):
        constraints.contacts(tokens, {"PP": (1.0, 2.0)}, 1, 1, group="pair")
