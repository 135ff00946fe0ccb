"""Operators of operators.features against small examples worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.operators import features


def test_a3m_text(spark):
    rows = spark.createDataFrame([("q", 2, "BB"), ("q", 1, "A-"), ("r", 5, "C")], "query string, pos int, seq string")
    assert {tuple(r) for r in features.a3m_text(rows).collect()} == {("q", ">sequence 1\nA-\n>sequence 2\nBB\n"), ("r", ">sequence 1\nC\n")}


def test_squared_distance_bin(spark):
    values = [3.0, 4.0, 4.1, 9.0, 9.5, 16.0, 17.0, 9e7, 1e8, 2e8, None]  # edges 4, 9, 16, 1e8
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, d2 double")
    got = [r[0] for r in df.orderBy("i").select(features.squared_distance_bin(F.col("d2"), 2.0, 4.0, 3)).collect()]
    assert got == [None, None, 0, None, 1, None, 2, 2, None, None, None]


def test_cluster_ids(spark):
    columns = "pdb_id string, type string, chain_1_id string, sub_mol_1_type string, cluster_1_id string, chain_2_id string, sub_mol_2_type string, cluster_2_id string, mol_1_type string, mol_type_group string"
    rows = [
        ("p", "chain", "A", "modified_prot", "c1", "", "", "", "prot", "intra_prot"), ("p", "interface", "B", "prot", "z", "A", "modified_prot", "c1", "prot", "prot_prot"),
        ("p", "interface", "L", "ligand", "HEM", "B", "prot", "z", "ligand", "ligand_prot"), ("p", "interface", "B", "prot", "z", "L", "ligand", "HEM", "prot", "ligand_prot"),
    ]
    residues = spark.createDataFrame([("p", "A", x) for x in ("SEP", "ALA", "MSE", "SEP")] + [("p", "B", "ALA")], "pdb_id string, chain_id string, res_name string")
    out = features.cluster_ids(spark.createDataFrame(rows, columns), residues, {"modified_prot": ("ALA",)})
    assert sorted(r["cluster_id"] for r in out.collect()) == ["c1_MSE_SEP", "c1_MSE_SEP:z", "z", "z"]
    with pytest.raises(Exception, match="unknown sub_mol_type"):
        features.cluster_ids(spark.createDataFrame([("p", "chain", "A", "modified_x", "c", "", "", "", "prot", "")], columns), residues, {"modified_prot": ("ALA",)}).collect()


def test_polymer_chain_bonds(spark):
    atoms = spark.createDataFrame([("p", 0, "A", "1"), ("p", 1, "A", "1"), ("p", 2, "B", "1"), ("p", 3, "L", "2")], "pdb_id string, atom_idx int, chain_id string, entity_id string")
    bonds = spark.createDataFrame([("p", 0, 1), ("p", 1, 2), ("p", 2, 3)], "pdb_id string, i int, j int")
    out = features.without_polymer_chain_bonds(bonds, atoms, spark.createDataFrame([("p", "1")], "pdb_id string, entity_id string"))
    assert sorted((r["i"], r["j"]) for r in out.collect()) == [(0, 1), (2, 3)]


def test_samples_and_stacks(spark):
    table = spark.createDataFrame([("a", 7, [0.5, None, 0.1], [1, 2, 3])], "name string, n int, x array<double>, y array<int>")
    rows = features.samples_of(table, "name", ["x", "y"], ["n"])
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 7, 0, 0.5, 1), ("a", 7, 1, None, 2), ("a", 7, 2, 0.1, 3)]
    assert tuple(features.stacked(rows, "name", ["x", "y"]).first()) == ("a", [0.5, None, 0.1], [1, 2, 3])


def test_expand_columns(spark):
    cells = spark.createDataFrame([("q", 0, 0, 5), ("q", 0, 1, 6), ("q", 1, 0, 7), ("q", 1, 1, 8)], "query string, row int, col long, code int")
    tokens = spark.createDataFrame([("q", 0, 0), ("q", 1, 1), ("q", 1, 3)], "query string, old long, new long")
    out = features.expand_columns(cells, tokens, ["code"])
    assert sorted(tuple(r) for r in out.collect()) == [("q", r, c, v) for r, codes in ((0, (5, 6, 0, 6)), (1, (7, 8, 0, 8))) for c, v in enumerate(codes)]


def test_schedule(spark):
    t = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "t double")
    of = lambda c: [r[0] for r in t.orderBy("t").select(features.schedule(c, F.col("t"))).collect()]
    assert of(2) == [2.0] * 3 and of({"type": "const", "value": 3}) == [3.0] * 3
    assert of({"type": "exp_interpolation", "start": 1, "end": 0}) == [1.0, 0.5, 0.0]
    half = 1 - (math.exp(1.5) - 1) / (math.exp(3) - 1)
    assert of({"type": "exp_interpolation", "start": 1, "end": 0, "alpha": 3}) == pytest.approx([1, half, 0])
    with pytest.raises(ValueError):
        features.schedule({"type": "other"}, F.col("t"))
