"""Operators of operators.substructure, and template and alignment features, against plain Python on small examples."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import alignment, kernels, substructure, templates

ATOM = "pdb_id string, atom_idx int, chain_id string, entity_id string, is_resolved boolean, x double, y double, z double"


def test_random_transform_is_rigid(spark):
    rng = np.random.default_rng(1)
    rows = [(p, i, *map(float, rng.normal(size=3) * 9 + 40)) for p in "ab" for i in range(12)]
    points = spark.createDataFrame(rows, "pdb_id string, atom_idx int, x double, y double, z double")
    moved = {(r["pdb_id"], r["atom_idx"]): np.array([r["x"], r["y"], r["z"]]) for r in substructure.random_transform(points, 7, most=2.0).collect()}
    for p in "ab":
        true, got = np.array([r[2:] for r in rows if r[0] == p]), np.array([moved[p, i] for i in range(12)])
        for i, j in combinations(range(12), 2):
            assert math.isclose(np.linalg.norm(true[i] - true[j]), np.linalg.norm(got[i] - got[j]), rel_tol=1e-9)
        assert np.linalg.norm(got.mean(axis=0)) <= 2 * math.sqrt(3)
        a, b = true - true.mean(axis=0), got - got.mean(axis=0)
        assert np.linalg.det(np.linalg.lstsq(a, b, rcond=None)[0]) == pytest.approx(1)
    still = substructure.random_transform(points, 7, move=False).groupBy("pdb_id").agg(F.avg("x").alias("x")).collect()
    assert all(abs(r["x"]) < 1e-9 for r in still)


def test_unit_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [("p", i, int(i != 3), *map(float, rng.normal(size=9))) for i in range(5)]
    names = [f"{n}{c}" for n in "can" for c in "xyz"]
    out = substructure.unit_vectors(spark.createDataFrame(rows, "pdb_id string, res_id int, mask int, " + ", ".join(f"{n} double" for n in names))).collect()
    assert len(out) == 25
    for r in out:
        (c, a, n), other = (np.array(rows[r["i"]][3:]).reshape(3, 3)), np.array(rows[r["j"]][6:9])
        e1 = (c - a) / np.linalg.norm(c - a)
        e2 = (n - a) - np.dot(n - a, e1) * e1
        e2 /= np.linalg.norm(e2)
        d = np.array([np.dot(v, other - a) for v in (e1, e2, np.cross(e1, e2))])
        expected = d / (np.linalg.norm(d) + 1e-6)
        assert np.allclose([r["ux"], r["uy"], r["uz"]], expected, atol=1e-4)
        assert r["mask"] == rows[r["i"]][2] * rows[r["j"]][2]


def test_interface_chains(spark):
    rows = [("p", 0, "A", "P", True, 0.0), ("p", 1, "L", "L", True, 4.0), ("p", 2, "B", "P", True, 9.0), ("p", 3, "C", "P", False, 4.0)]
    tokens = spark.createDataFrame([(p, i, c, k, r, x, 0.0, 0.0) for p, i, c, k, r, x in rows], "pdb_id string, atom_idx int, chain_id string, kind string, is_resolved boolean, x double, y double, z double")
    out = substructure.interface_chains(tokens, [("P", "L", 4.5), ("L", "P", 4.5), ("P", "P", 9.0)])
    assert sorted((r["chain_id"], r["kinds"]) for r in out.collect()) == [("A", "P:L"), ("A", "P:P"), ("B", "P:P"), ("L", "L:P")]


def test_distance_feature(spark):
    rows = spark.createDataFrame([("p", i, float(x), 0.0, 0.0) for i, x in enumerate((0, 3, 7, 40))] + [("q", 9, 0.0, 0.0, 0.0)], "pdb_id string, token int, x double, y double, z double")
    got = {(r["i"], r["j"]): (r["d"], r["bin"]) for r in substructure.distance_feature(rows, [0.0, 3.5, 4.0, 7.0], 0.0, 1).collect()}
    assert len(got) == 12 and all(got[i, j] == got[j, i] for i, j in got)
    assert [got[k][1] for k in ((0, 1), (1, 2), (0, 2), (0, 3))] == [None, 2, 3, 3]
    noisy = {(r["i"], r["j"]): r["d"] for r in substructure.distance_feature(rows, [0.0], 0.05, 1).collect()}
    assert all(0 < abs(noisy[k] - got[k][0]) < 1 for k in got)


def test_covering_chains(spark):
    # B is largest and sees A; D is of a met entity; C brings the last entity.
    rows = [("A", "1", 0.0), *[("B", "2", 3.0)] * 5, *[("C", "3", 50.0)] * 2, *[("D", "1", 90.0)] * 3, ("E", "3", 51.0), ("F", "2", 120.0)]
    atoms = spark.createDataFrame([("p", i, c, e, True, x, 0.0, 0.0) for i, (c, e, x) in enumerate(rows)], ATOM)
    assert sorted(r["chain_id"] for r in substructure.covering_chains(atoms, 5.0).collect()) == ["A", "B", "C", "E"]


def test_covering_chains_without_resolved_atoms(spark):
    atoms = spark.createDataFrame([("p", 0, "A", "1", False, 0.0, 0.0, 0.0)], ATOM)
    assert substructure.covering_chains(atoms).count() == 0


def test_anchored_molecules(spark):
    # p has four molecules, of which two stay; q is small; r has no interface.
    rows = [("p", 0, 0, False, 0.0), ("p", 1, 1, False, 2.0), ("p", 2, 2, True, 30.0), ("p", 3, 3, False, 32.0), ("p", 4, 3, False, 33.0), ("q", 5, 0, False, 0.0), ("r", 6, 0, False, 0.0), ("r", 7, 1, False, 99.0), ("r", 8, 2, False, 300.0)]
    atoms = spark.createDataFrame([(p, i, m, True, core, True, x, 0.0, 0.0) for p, i, m, core, x in rows], "pdb_id string, atom_idx int, mol_id int, is_centre boolean, is_core boolean, is_resolved boolean, x double, y double, z double")
    kept = lambda tokens: sorted((r["pdb_id"], r["mol_id"]) for r in substructure.anchored_molecules(atoms, 15.0, 2, 42, tokens).collect())
    assert kept(0) == [("p", 2), ("p", 3), ("q", 0)]
    assert kept(4) == [("p", 1), ("p", 2), ("p", 3), ("q", 0)]


def test_without_leaving_atoms(spark):
    # 1 is a ligand centre bonded to protein atom 0; 2-3 hang on it unresolved, 4-5 are resolved. In residue 3 only one neighbour is resolved.
    rows = [(0, "A", 1, False, True), (1, "L", 2, True, True), (2, "L", 2, True, False), (3, "L", 2, True, False), (4, "L", 2, True, True), (5, "L", 2, True, True), (6, "A", 9, False, False), (7, "L", 3, True, True), (8, "L", 3, True, False), (9, "L", 3, True, True)]
    atoms = spark.createDataFrame([("p", *r) for r in rows], "pdb_id string, atom_idx int, chain_id string, res_id int, is_ligand boolean, is_resolved boolean")
    bonds = spark.createDataFrame([("p", i, j) for i, j in ((0, 1), (1, 2), (2, 3), (1, 4), (4, 5), (6, 7), (7, 8), (7, 9))], "pdb_id string, i int, j int")
    out = substructure.without_leaving_atoms(atoms, bonds)
    assert sorted(r["atom_idx"] for r in out.collect()) == [0, 1, 4, 5, 6, 7, 8, 9]
    assert substructure.without_leaving_atoms(atoms, bonds.where("false")).count() == 10


def plain_lost(atoms, bonds):
    """A structure's centres are cut out in turn, with all of its bonds at hand."""
    at, links, gone = {a[0]: a for a in atoms}, {}, set()
    for i, j in bonds:
        links.setdefault(i, set()).add(j)
        links.setdefault(j, set()).add(i)
    for c in sorted(c for c, around in links.items() if at[c][3] and any(at[b][1:3] != at[c][1:3] for b in around)):
        around = links[c]
        links[c] = set()
        for b in around:
            links[b].discard(c)
        if sum(at[b][4] for b in around) == 1:
            continue
        for b in around:
            group, stack = {b}, [b]
            while stack:
                fresh = links[stack.pop()] - group
                group |= fresh
                stack += fresh
            if not any(at[x][4] or at[x][1:3] != at[c][1:3] for x in group):
                gone |= group
    return gone


@pytest.mark.parametrize("most", [1, 10_000])
def test_leaving_atoms_of_many_residues(spark, most, monkeypatch):
    """Many residues come to one task, whole; a call for each would cost milliseconds."""
    monkeypatch.setattr(substructure, "MOST_FOUND", most)
    rng, rows, bonds, want = random.Random(8), [], [], set()
    for p in ("p", "q", "r"):
        own = [(i, "AB"[i // 150], i // 6, rng.random() < 0.7, rng.random() < 0.5) for i in range(300)]
        met = {(i, j) for i in range(300) for j in rng.sample(range(i + 1, min(i + 4, 300)), min(rng.choice([0, 1, 1, 2]), max(0, 299 - i)))}
        rows += [(p, *a) for a in own]
        bonds += [(p, i, j) for i, j in met]
        want |= {(p, i) for i in plain_lost(own, met)}
    atoms = spark.createDataFrame(rows, "pdb_id string, atom_idx int, chain_id string, res_id int, is_ligand boolean, is_resolved boolean")
    out = substructure.without_leaving_atoms(atoms, spark.createDataFrame(bonds, "pdb_id string, i int, j int"))
    assert len(want) > 30 and {(r[0], r[1]) for r in rows} - {(r["pdb_id"], r["atom_idx"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "REPARTITION_BY_NUM" in plan


def test_featurize(spark):
    rows = spark.createDataFrame([("q", 0, "sp|P12345|ABC_HUMAN", "AaR-"), ("q", 1, "x", "C")], "query string, row int, description string, seq string")
    got = {r["row"]: r for r in alignment.featurize(rows).collect()}
    assert (got[0]["codes"], got[0]["deletions"], got[0]["species"], got[0]["depth"]) == ([0, 1, 31], [0, 1, 0], "HUMAN", 2)
    assert (got[1]["codes"], got[1]["species"]) == ([4], "")


def test_index_maps(spark):
    rows = [("q", 1, "ACDEF", "CDEF"), ("q", 2, "ACDEF", "WWWWW"), ("q", 3, "ACDEF", None)]
    got = {r["hit"]: r for r in templates.index_maps(spark.createDataFrame(rows, "query string, hit int, query_seq string, hit_seq string"), 0.5).collect()}
    assert got[1]["mapping"] == {1: 0, 2: 1, 3: 2, 4: 3} and got[1]["identity"] == 1.0 and got[1]["error"] is None
    assert (got[2]["mapping"], got[2]["error"]) == (None, "identity") and got[3]["error"] == "no sequence"


def test_assembled(spark):
    tokens = spark.createDataFrame([("p", t, e, t % 6) for t, e in enumerate("111111" + "222222")], "pdb_id string, token int, entity_id string, place int")
    features = spark.createDataFrame([("p", e, k, n, 100 * k + n) for e in "12" for k in range(3) for n in range(0, 6, 2)], "pdb_id string, entity_id string, template int, place int, code int")
    chains = spark.createDataFrame([("p", "1", True, 6), ("p", "2", False, 6)], "pdb_id string, entity_id string, is_protein boolean, length int")
    got = {(r["token"], r["template"]): r["code"] for r in templates.assembled(tokens, features, chains, 2, {"code": F.lit(31)}).collect()}
    assert len(got) == 24
    assert [got[t, k] for t, k in ((0, 0), (2, 1), (1, 0), (6, 0))] == [0, 102, 31, 31]


def test_text_ids_without_rows(spark):
    ratios = spark.createDataFrame([("p", "A", 9), ("p", "B", 9)], "pdb_id string, chain_id string, n long")
    pairs = spark.createDataFrame([("p", "A", "B", 1)], "pdb_id string, chain_id string, other string, atoms long")
    assert kernels.remove_clashing_chains(ratios, pairs).count() == 0
    assert kernels.contiguous_crop(spark.createDataFrame([("p", "A", 1)], "pdb_id string, chain_id string, token int"), 0).count() == 0
