"""Jobs, stores and chains side by side."""

import json

from pyspark.sql import functions as F

from strandline.operators import jobs

TEXT = json.dumps(
    [
        {"name": "a", "sequences": [{"proteinChain": {"sequence": "ACD", "count": 2, "msa": {"precomputed_msa_dir": "/m/1"}}}, {"ligand": {"ligand": "CCD_ATP", "count": 1}}, {"dnaSequence": {"sequence": "AC"}}]},
        {"name": "b", "sequences": [{"proteinChain": {"sequence": "A", "count": 1, "unpairedMsaPath": "x"}}, {"ion": {"ion": "MG"}}]},
    ]
)


def test_jobs(spark):
    parsed = jobs.parse_jobs(spark.createDataFrame([(TEXT,), ("{broken",)], "value string"))
    rows = {(r["name"], r["entity"]): (r["kind"], r["value"], r["n"], r["poly_type"]) for r in jobs.entities(parsed).collect()}
    assert rows == {("a", 1): ("proteinChain", "ACD", 2, "polypeptide(L)"), ("a", 2): ("ligand", "CCD_ATP", 1, None), ("a", 3): ("dnaSequence", "AC", 1, "polydeoxyribonucleotide"), ("b", 1): ("proteinChain", "A", 1, "polypeptide(L)"), ("b", 2): ("ion", "MG", 1, None)}
    assert {r["name"]: r["needs_search"] for r in jobs.needs_search(parsed).collect()} == {"a": True, "b": False}
    new = jobs.modernised(parsed)
    assert {r["name"]: r["needs_search"] for r in jobs.needs_search(new).collect()} == {"a": False, "b": False}
    assert new.where("job.name = 'a'").first()["job"]["sequences"][0]["proteinChain"]["pairedMsaPath"] == "/m/1/pairing.a3m"


def test_store(spark):
    store = jobs.kv_store(spark.createDataFrame([("k", "1"), ("k", "2"), ("x", "3")], "k string, v string"), "k", "v")
    got = jobs.kv_lookup(spark.createDataFrame([("k",), ("none",)], "q string"), store, "q", "found").collect()
    assert {r["q"]: r["found"] for r in got} == {"k": "2", "none": None}


def test_positions(spark):
    tokens = spark.createDataFrame([(0, 1), (0, 9), (1, 2), (2, 1)], "asym long, res long")
    offsets = spark.createDataFrame([(0, 0, 5), (1, 5, 3)], "asym long, offset long, length long")
    assert sorted(tuple(r) for r in jobs.standard_positions(tokens, offsets).collect()) == [(0, 1, 0), (0, 9, -1), (1, 2, 6), (2, 1, 5)]


def test_side_by_side(spark):
    a = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "row long, codes array<int>")
    b = spark.createDataFrame([(0, [9])], "row long, codes array<int>")
    assert {r["row"]: r["codes"] for r in jobs.side_by_side([a, b], [2, 1]).collect()} == {0: [1, 2, 9], 1: [3, 4, 31]}


def test_split_rows(spark):
    msa = spark.createDataFrame([(0, "ACDE"), (1, "aA-bDEx"), (2, "--DE")], "row long, seq string")
    got = {(r["row"], r["chain"]): (r["seq"], r["is_dummy"]) for r in jobs.split_rows(msa, [2, 2]).collect()}
    assert got == {(0, 0): ("AC", False), (0, 1): ("DE", False), (1, 0): ("aA-", False), (1, 1): ("bDEx", False), (2, 0): ("--", True), (2, 1): ("DE", False)}


def test_uneven_bonds(spark):
    chains = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C"), (2, "D"), (3, "E")], "entity long, chain string")
    columns = "entity1 long, chain1 string, res1 long, atom1 string, entity2 long, chain2 string, res2 long, atom2 string"
    rows = [(1, "A", 5, "SG", 2, "C", 1, "C1"), (1, "B", 5, "SG", 2, "D", 1, "C1"), (1, "A", 7, "N", 2, "C", 1, "C2"), (1, "A", 9, "N", 3, "E", 1, "O")]
    assert {(r["res1"], r["chain1"]) for r in jobs.drop_uneven_bonds(spark.createDataFrame(rows, columns), chains).collect()} == {(5, "A"), (5, "B"), (9, "A")}


def test_stockholm(spark):
    msa = spark.createDataFrame([("q", 0, "ACD"), ("q", 1, "AxyC-"), ("q", 2, "zA-Dww")], "query string, row long, seq string")
    got = {r["row"]: r["seq"] for r in jobs.stockholm()(msa).collect()}
    assert got == {0: "-A--CD--", 1: "-AXYC---", 2: "ZA---DWW"}
    assert len({len(s) for s in got.values()}) == 1
    assert jobs.stockholm(lambda r: F.concat(F.lit("s"), r.cast("string")))(msa).where("row = 1").first()["name"] == "s1"


def test_a3m_of_stockholm(spark):
    text = ["# STOCKHOLM 1.0", "a AC--", "b -CXD", "", "a D", "b D", "//"]
    lines = spark.createDataFrame([("q", i, x) for i, x in enumerate(text)], "query string, pos long, line string")
    got = {r["name"]: (r["row"], r["seq"]) for r in jobs.a3m_of_stockholm(lines).collect()}
    assert got == {"a": (0, "ACD"), "b": (1, "-CxdD")}
    assert jobs.a3m_of_stockholm(lines, 1).count() == 1


def test_residue_fixes(spark):
    from strandline.operators import structure

    columns = "pdb_id long, chain_id string, res_id long, res_name string, atom_name string, x double, y double, z double"
    rows = [(1, "A", 1, "ARG", "CD", 0.0, 0.0, 0.0), (1, "A", 1, "ARG", "NH1", 5.0, 0.0, 0.0), (1, "A", 1, "ARG", "NH2", 1.0, 0.0, 0.0), (1, "A", 2, "ARG", "NH1", 5.0, 0.0, 0.0), (1, "A", 3, "GLY", "NH1", 9.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, columns)
    got = {(r["res_id"], r["atom_name"]): r["x"] for r in structure.fix_arginine(df).collect()}
    assert got == {(1, "CD"): 0.0, (1, "NH1"): 1.0, (1, "NH2"): 5.0, (2, "NH1"): 5.0, (3, "NH1"): 9.0}
    labelled = df.withColumn("label_asym_id", F.lit("B")).withColumn("label_seq_id", F.when(F.col("res_id") == 1, "7").otherwise("."))
    assert {(r["chain_id"], r["res_id"]) for r in structure.label_numbering(labelled).collect()} == {("B", 7), ("B", 2), ("B", 3)}
    places = spark.createDataFrame([("ARG", "NH1", 8)], "res_name string, atom_name string, place int")
    assert {(r["res_name"], r["atom_name"], r["tokatom_idx"]) for r in structure.token_atom_index(df, places).collect()} >= {("ARG", "NH1", 8), ("GLY", "NH1", 0)}
    letters = spark.createDataFrame([("GLY", "G"), ("ARG", "X")], "res_name string, letter string")
    named = structure.canonical_names(df.withColumn("mol_type", F.lit("protein")), letters, {"protein": {"G": "GLY"}}, {"protein": "UNK"})
    assert {(r["res_name"], r["cano_res_name"]) for r in named.collect()} == {("GLY", "GLY"), ("ARG", "UNK")}
