"""Entities of PDB text against a plain, sequential reading of the same rules, and a round trip through mmCIF."""

import random

from pyspark.sql import functions as F

from strandline.operators import pdb_entities as P
from strandline.sources import mmcif, text_formats


def line(record, serial, name, res, chain, num, ins=" ", alt=" ", x=0.0, element="C"):
    return f"{record:<6}{serial:>5}  {name:<3}{alt}{res:>3} {chain}{num:>4}{ins}   {x:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{0:6.2f}          {element:>2}"


def plain(atoms):
    """Segments in turn, one atom a residue: (names, entity, turned)."""
    runs = []
    for a in atoms:
        if runs and runs[-1][-1][1] == a[1]:
            runs[-1].append(a)
        else:
            runs.append([a])
    parts = []
    for run in runs:
        het = any(a[0] for a in run)
        kinds = {k: len({a[3] for a in run if a[3] in names}) for k, names in (("p", P.PROTEIN), ("d", P.DNA), ("r", P.RNA))}
        gap = "DN" if kinds["d"] and kinds["d"] >= max(kinds["p"], kinds["r"]) else "N" if kinds["r"] and kinds["r"] >= max(kinds["p"], kinds["d"]) else "UNK"
        part = [run[0][3]]
        for a, b in zip(run, run[1:]):
            if a[0] != b[0] or (a[0] and b[0] and b[2] > a[2]):
                parts.append(part)
                part = []
            elif not het:
                part += [gap] * max(0, b[2] - a[2] - 1)
            part.append(b[3])
        parts.append(part)
    seen, out = {}, []
    for names in parts:
        turned = all(n in P.DNA for n in names) and tuple(names) in seen
        if turned:
            names = names[::-1]
        seen.setdefault(tuple(names), len(seen) + 1)
        out.append((tuple(names), seen[tuple(names)], turned))
    return out


def test_against_plain(spark):
    rng, rows, expected = random.Random(5), [], {}
    for f in range(60):
        names = rng.choice([("DA", "DT"), ("ALA", "GLY"), ("A", "U", "DA"), ("ALA", "HEM", "DA")])
        atoms, num, chain = [], 0, "A"
        for _ in range(rng.randint(1, 24)):
            if rng.random() < 0.25:
                chain, num = rng.choice([c for c in "ABC" if c != chain]), 0
            num += rng.choice([1, 1, 1, 2, 4])
            atoms.append((rng.random() < 0.15, chain, num, rng.choice(names)))
        rows += [(f"f{f}", i, line("HETATM" if a[0] else "ATOM", i, "CA", a[3], a[1], a[2])) for i, a in enumerate(atoms)]
        expected[f"f{f}"] = plain(atoms)
    _, made = P.inferred(spark.createDataFrame(rows, "pdb_id string, pos int, line string"))
    got = {}
    for r in sorted(made.collect(), key=lambda r: r["segment"]):
        got.setdefault(r["pdb_id"], []).append((tuple(r["names"]), r["entity_id"], r["turned"]))
    assert got == expected
    assert any(t for v in expected.values() for _, _, t in v)


def test_models_places_and_odd_lines(spark):
    text = ["HEADER", None, "MODEL        1", line("ATOM", 1, "CA", "ALA", "A", 1, alt="B", x=1), line("ATOM", 2, "CA", "ALA", "A", 1, alt="A", x=2), line("ATOM", 3, "N", "ALA", "A", 1, element=""), line("ATOM", 4, "CA", "GLY", "A", 1, ins="A"), "ENDMDL", "MODEL        2", line("ATOM", 1, "CA", "ALA", "A", 1)]
    atoms, made = P.inferred(spark.createDataFrame([("x", i, t) for i, t in enumerate(text)], "pdb_id string, pos int, line string"))
    assert sorted((r["atom_name"], r["alt"], r["x"], r["seq_id"], r["element"]) for r in atoms.collect()) == [("CA", "", 0.0, 2, "C"), ("CA", "B", 1.0, 1, "C"), ("N", "", 0.0, 1, "N")]
    assert [(r["names"], r["poly_type"]) for r in made.collect()] == [(["ALA", "GLY"], "polypeptide(L)")]


def test_empty(spark):
    atoms, made = P.inferred(spark.createDataFrame([("x", 0, "END")], "pdb_id string, pos int, line string"))
    assert atoms.count() == 0 and made.count() == 0


def test_round_trip_through_cif(spark, tmp_path):
    (tmp_path / "pdb").mkdir()
    text = [line("ATOM", i, "P", n, "A", i) for i, n in enumerate(("DA", "DT", "DG"), 1)] + ["TER"]
    text += [line("ATOM", i + 3, "P", n, "B", i, x=i) for i, n in enumerate(("DA", "DT", "DG"), 1)] + [line("HETATM", i + 6, "O", "HOH", "B", 100 + i, x=i) for i in (1, 2)]
    (tmp_path / "pdb" / "one.pdb").write_text("\n".join(text))
    lines = text_formats.read_lines(spark, str(tmp_path / "pdb")).withColumnRenamed("file", "pdb_id").withColumn("pdb_id", F.regexp_extract("pdb_id", r"([^/]+)\.pdb$", 1))
    atoms, made = P.inferred(lines)
    mmcif.write_cif(mmcif.cif_text(P.cif_tables(atoms, made)), str(tmp_path / "cif"))
    got = mmcif.tables(spark, str(tmp_path / "cif"), P.CATEGORIES, glob="*.txt")
    rows = lambda name: [tuple(r)[2:] for r in got[name].orderBy("row").collect()]
    assert rows("entity") == [("1", "polymer"), ("2", "polymer"), ("3", "non-polymer")]
    assert rows("entity_poly") == [("1", "polydeoxyribonucleotide"), ("2", "polydeoxyribonucleotide")]
    assert rows("entity_poly_seq") == [("1", "1", "DA"), ("1", "2", "DT"), ("1", "3", "DG"), ("2", "1", "DG"), ("2", "2", "DT"), ("2", "3", "DA")]
    assert rows("struct_asym") == [("A", "1"), ("B", "2"), ("C", "3"), ("D", "3")]
    sites = [(r["label_asym_id"], r["label_seq_id"], r["label_comp_id"], r["auth_seq_id"], r["Cartn_x"]) for r in got["atom_site"].orderBy("row").collect()]
    assert sites == [("A", "1", "DA", "1", "0.000"), ("A", "2", "DT", "2", "0.000"), ("A", "3", "DG", "3", "0.000"), ("B", "1", "DG", "3", "3.000"), ("B", "2", "DT", "2", "2.000"), ("B", "3", "DA", "1", "1.000"), ("C", ".", "HOH", "101", "1.000"), ("D", ".", "HOH", "102", "2.000")]


def test_files_are_shuffled_once(spark, tmp_path):
    """Files are dealt to parts that follow their lines, and every window works on what is there: one exchange of all rows, no union, no join."""
    from strandline.plans import conversions

    plan = conversions.pdb_text_entities(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Union" not in plan and "Join" not in plan
    rows = [(k, n, 10 * k + n) for k in range(1, 60) for n in range(1, 8)] * 2 + [(None, 1, 5), (7, None, 5), (7, 3, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(map(str, conversions.pdb_text_entities(spark, str(tmp_path)).collect()))
    assert want and "None" not in {w.split("pdb_id=")[1].split(",")[0] for w in want}
    before, P.LINES = P.LINES, 16
    try:
        made = conversions.pdb_text_entities(spark, str(tmp_path))
        assert made.rdd.getNumPartitions() > 40 and sorted(map(str, made.collect())) == want
    finally:
        P.LINES = before
