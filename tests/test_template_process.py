"""Template processing from mmCIF text to features, by hand; the aligner against a plain one."""

import random

from pyspark.sql import functions as F

from strandline.operators import template_process as T
from strandline.operators.kernels import global_alignment
from strandline.sources import mmcif


def plain_alignment(a, b, match=2, mismatch=-1, gap=-2):
    s = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = [s[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch)] if i and j else []
            options += [s[i - 1, j] + gap] if i else []
            options += [s[i, j - 1] + gap] if j else []
            s[i, j] = max(options, default=0)
    i, j, x, y = len(a), len(b), "", ""
    while i or j:
        if i and j and s[i, j] == s[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j, x, y = i - 1, j - 1, a[i - 1] + x, b[j - 1] + y
        elif i and s[i, j] == s[i - 1, j] + gap:
            i, x, y = i - 1, a[i - 1] + x, "-" + y
        else:
            j, x, y = j - 1, "-" + x, b[j - 1] + y
    return x, y


def test_aligner_against_plain():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ACD") for _ in range(rng.randint(0, 17)))
    for _ in range(400):
        a, b = word(), word()
        assert global_alignment(a, b) == plain_alignment(a, b), (a, b)


def test_aligner_on_long_sequences():
    rng = random.Random(4)
    a = "".join(rng.choice("ACDEFGHIKL") for _ in range(6000))
    x, y = global_alignment(a, a[:1000] + a[1300:])
    assert x == a and y.replace("-", "") == a[:1000] + a[1300:] and y.count("-") == 300


SITES = [
    # record, atom, component, asym, number, author's chain, x, y, z, occupancy, model
    ("ATOM", "N", "ALA", "A", 2, "X", 0, 0, 0, 1, 1),
    ("ATOM", "CA", "ALA", "A", 2, "X", 1, 0, 0, 0.4, 1),
    ("ATOM", "CA", "ALA", "A", 2, "X", 2, 0, 0, 0.6, 1),
    ("ATOM", "CA", "ALA", "A", 2, "X", 9, 0, 0, 1, 2),
    ("HETATM", "SE", "MSE", "A", 3, "X", 3, 0, 0, 1, 1),
    ("HETATM", "CA", "MSE", "A", 3, "X", 4, 0, 0, 1, 1),
    ("ATOM", "CD", "ARG", "A", 4, "X", 0, 5, 0, 1, 1),
    ("ATOM", "NH1", "ARG", "A", 4, "X", 0, 9, 0, 1, 1),
    ("ATOM", "NH2", "ARG", "A", 4, "X", 0, 6, 0, 1, 1),
    ("ATOM", "H", "ARG", "A", 4, "X", 0, 7, 0, 1, 1),
    ("HETATM", "O", "HOH", "B", ".", "X", 0, 8, 0, 1, 1),
]


def tables(spark, tmp_path):
    columns = ["group_PDB", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "auth_asym_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "pdbx_PDB_model_num"]
    loop = lambda category, names, rows: "loop_\n" + "".join(f"_{category}.{n}\n" for n in names) + "".join(" ".join(f"'{v}'" if " " in str(v) else str(v) for v in r) + "\n" for r in rows)
    text = "data_one\n" + loop("atom_site", columns, SITES) + loop("entity_poly_seq", ["entity_id", "num", "mon_id"], [(1, 2, "ALA"), (1, 3, "MSE"), (1, 4, "ARG"), (1, 5, "XYZ")])
    text += loop("struct_asym", ["id", "entity_id"], [("A", 1), ("B", 2)]) + loop("chem_comp", ["id", "type"], [("ALA", "L-peptide linking"), ("HOH", "non-polymer")]) + loop("pdbx_audit_revision_history", ["revision_date"], [("2011-07-13",), ("2009-01-20",)])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.cif").write_text(text)
    got = mmcif.tables(spark, str(tmp_path / "in"), T.CATEGORIES)
    return {k: df.withColumn("file", F.regexp_extract("file", r"([^/]+)\.cif$", 1)) for k, df in got.items()}


def test_from_mmcif_to_features(spark, tmp_path):
    letters = spark.createDataFrame([("ALA", "A"), ("MSE", "M"), ("ARG", "R"), ("XYZ", "QQ")], "res_name string, letter string")
    structures, seqres, atoms = T.template_chains(tables(spark, tmp_path), letters)
    assert [(r["pdb_id"], str(r["release_date"])) for r in structures.collect()] == [("one", "2009-01-20")]
    assert sorted((r["chain_id"], r["place"], r["letter"]) for r in seqres.collect()) == [("X", 0, "A"), ("X", 1, "M"), ("X", 2, "R"), ("X", 3, "X")]
    rows = [
        ("q", 1, "GAMR", "one", "X", 0.5),
        ("q", 2, "GAMR", "old", "Z", None),  # replaced; the only chain stands in
        ("q", 3, "GAMR", "none", "X", None),
        ("q", 4, "GAMR", None, None, None),
        ("e", 5, "", "one", "X", None),
        ("n", 6, None, "one", "X", None),
    ]
    hits = spark.createDataFrame(rows, "query string, hit int, query_seq string, pdb_id string, chain_id string, sum_probs double")
    obsolete = spark.createDataFrame([("old", "one")], "pdb_id string, replaced_by string")
    run = lambda **more: T.process(hits, structures, seqres, atoms, more.pop("latest", "2010-01-01"), obsolete, centre=False, **more)
    results, features = run()
    got = {r["hit"]: r for r in results.collect()}
    assert {h: r["error"] for h, r in got.items()} == {1: None, 2: None, 3: "load", 4: "load", 5: "align", 6: "align"}
    assert [(got[h]["chain_id"], got[h]["sequence"], got[h]["aligned_cols"], got[h]["atoms"], got[h]["sum_probs"]) for h in (1, 2)] == [("X", "-AMR", 3, 7, 0.5), ("X", "-AMR", 3, 7, 0.0)]
    spots = {(r["place"], T.ATOMS[a["atom"]]): (a["x"], a["y"]) for r in features.where("hit = 1").collect() for a in r["positions"]}
    assert spots == {(1, "N"): (0, 0), (1, "CA"): (2, 0), (2, "SD"): (3, 0), (2, "CA"): (4, 0), (3, "CD"): (0, 5), (3, "NH1"): (0, 6), (3, "NH2"): (0, 9)}
    assert {r["error"] for r in run(most_step=1.5)[0].where("hit < 3").collect()} == {"distance"}
    assert {r["error"] for r in run(least_atoms=8)[0].where("hit < 3").collect()} == {"atoms"}
    late = run(latest="2009-01-19")
    assert [(r["error"], r["has_features"]) for r in late[0].where("hit = 1").collect()] == [(None, False)] and late[1].count() == 0
    assert [r["error"] for r in run(latest="2009-01-19", strict=True)[0].where("hit = 1").collect()] == ["date"]


def test_centred(spark):
    atoms = spark.createDataFrame([("p", "A", 0, "GLY", "CA", 1.0, 2.0, 3.0), ("p", "A", 1, "GLY", "CA", 3.0, 2.0, 1.0)], "pdb_id string, chain_id string, place int, res_name string, atom_name string, x double, y double, z double")
    assert sorted((r["x"], r["y"], r["z"]) for r in T.chain_positions(atoms).collect()) == [(-1, 0, 1), (1, 0, -1)]
