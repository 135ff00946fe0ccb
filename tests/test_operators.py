"""Operators against plain Python, with the edge cases of their inputs."""

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import sequences as S
from strandline.operators import alignment, annotations, confidence, graph, index_table, kernels, sampling, spatial, structure, templates
from strandline.sources import text_formats as tf


def test_grid_join_is_brute_force(spark):
    rng = random.Random(1)
    pts = [(i % 3, i, *(rng.uniform(-9, 9) for _ in range(3))) for i in range(150)] + [(0, 900, 0.0, 0.0, 0.0), (0, 901, 3.0, 0.0, 0.0), (0, 902, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "pdb_id long, atom_idx long, x double, y double, z double")
    for strict in (True, False):
        got = {(r[0], r[1]) for r in spatial.neighbour_pairs(df, 3.0, strict).select("a.atom_idx", "b.atom_idx").collect()}
        d = lambda a, b: math.dist(a[2:], b[2:])
        assert got == {(a[1], b[1]) for a in pts for b in pts if a[0] == b[0] and a[1] < b[1] and (d(a, b) < 3.0 if strict else d(a, b) <= 3.0)}
    assert spatial.neighbour_pairs(df.limit(0), 3.0).count() == 0


def test_components_are_a_search(spark):
    rng = random.Random(2)
    edges = [(g, rng.randrange(60), rng.randrange(60)) for g in range(3) for _ in range(40)] + [(9, i, i + 1) for i in range(40)]
    got = {(r[0], r[1]): r[2] for r in graph.components(spark.createDataFrame(edges, "pdb_id long, i long, j long")).collect()}
    for g in {e[0] for e in edges}:
        near = {}
        for _, a, b in (e for e in edges if e[0] == g):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for start in near:
            seen, todo = {start}, [start]
            while todo:
                for n in near[todo.pop()] - seen:
                    seen.add(n)
                    todo.append(n)
            assert got[g, start] == min(seen)


def encode_row(seq):
    codes, deletions, run = [], [], 0
    for c in seq:
        if c.islower():
            run += 1
        else:
            codes.append(S.PROTEIN_CODES.get(c, 20))
            deletions.append(run)
            run = 0
    return codes, deletions


def test_codes_and_deletions(spark):
    rng = random.Random(3)
    seqs = ["", "-", "abc", "ACD", "aAbbC-", "---", "Ax"] + ["".join(rng.choice("ACDEFghik-BZ") for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", S.codes(F.col("s")), S.deletions(F.col("s"))).collect()
    for s, codes, deletions in rows:
        assert (codes, deletions) == encode_row(s)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "Ab", "aA", "AC", "A-"]), st.sampled_from(["q", "r"])), max_size=12))
def test_dedup_keeps_first(spark, rows):
    df = spark.createDataFrame([(q, i, s) for i, (s, q) in enumerate(rows)], "query string, row long, seq string")
    seen, first = set(), set()
    for i, (s, q) in enumerate(rows):
        k = (q, "".join(c for c in s if not c.islower()))
        if k not in seen:
            first.add(i)
        seen.add(k)
    assert {r["row"] for r in alignment.dedup(df).collect()} == first


def test_species_and_letters(spark):
    d = ["UniRef100_A0A1_9606/1-50", "tr|A0A146SKV9|A0A146SKV9_FUNHE", "sp|P12345|ABC_HUMAN x", "other", ""]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in d], "d string").select(S.species(F.col("d"))).collect()] == ["9606", "FUNHE", "HUMAN", "", ""]
    names = [r[0] for r in spark.createDataFrame([(n,) for n in (1, 26, 27, 52, 53, 702, 703)], "n long").select(S.letters_of_number(F.col("n"))).collect()]
    assert names == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    row = spark.range(1).select(S.align_to_query(F.lit("AC-DE"), F.lit("A--DE")), S.hit_indices(F.lit("AbC-D"), F.lit(5)), S.one_hot(F.lit(2), 4), S.date_or_last(F.lit("x")), S.first_resolution(F.lit("?"), F.lit("0.0"), F.lit("2.5"))).first()
    assert row[0] == "AcDE" and row[1] == [5, 7, -1, 8] and row[2] == [0, 0, 1, 0] and str(row[3]) == "9999-12-31" and row[4] == 2.5


def test_weights_follow_the_rule(spark):
    rows = [("1", "chain", "10", None, "c1", "prot", None), ("1", "interface", "10", "2", "c1", "prot", "ligand"), ("1", "interface", "2", "10", "c1", "prot", "ligand"), ("2", "chain", "3", None, None, "nuc", None)]
    df = spark.createDataFrame(rows, "pdb_id string, type string, entity_1_id string, entity_2_id string, cluster_id string, mol_1_type string, mol_2_type string")
    got = {(r["key"], r["type"]): (r["member_num"], r["cluster_size"], r["weight"]) for r in index_table.sample_weights(df).collect()}
    assert got["1_10_None", "chain"][:2] == (1, 2) and math.isclose(got["1_10_None", "chain"][2], 0.5 * 3 / (2 + 1e-9))
    assert got["1_10_2", "interface"][:2] == (2, 2) and got["2_3_None", "chain"][1] is None  # entities sort as text


def test_row_numbers_are_global(spark):
    rows = [(i * 7919 % 1000,) for i in range(1000)]
    got = index_table.with_row_number(spark.createDataFrame(rows, "v long"), ["v"], "n").collect()
    assert sorted((r["v"], r["n"]) for r in got) == [(i, i) for i in range(1000)]


def test_draws_follow_weights(spark):
    df = spark.createDataFrame([(i, float(i % 2 * 3 + 1)) for i in range(100)], "k long, w double")
    draws = sampling.weighted_draws(df, "w", 4000, "k", block=16).collect()
    assert len(draws) == 4000
    assert abs(sum(r["k"] % 2 for r in draws) / 4000 - 0.8) < 0.05
    top = sampling.weighted_sample(df.where("k < 2"), "w", 5, ["k"]).count()
    assert top == 2


def test_balanced_assignment(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate([9, 8, 7, 6, 5, 4, 3])], "i long, k long")
    got = {r["i"]: r["worker"] for r in sampling.balanced_assignment(df, "k", "i", 2).collect()}
    counts = [list(got.values()).count(w) for w in (0, 1)]
    assert sum(counts) == 7 and abs(counts[0] - counts[1]) <= 1 and got[0] != got[1]


def test_alignment_by_rotation(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    y = x @ q + [1.0, 2.0, 3.0]
    rows = [(1, i, *map(float, a), *map(float, b), True) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "pdb_id long, atom_idx long, x double, y double, z double, px double, py double, pz double, is_resolved boolean")
    assert kernels.aligned_rmsd(df).first()["aligned_rmsd"] < 1e-6
    mirrored = df.withColumn("px", -F.col("px"))
    assert kernels.aligned_rmsd(mirrored).first()["aligned_rmsd"] > 0.1


def test_crop_fills_budget(spark):
    df = spark.createDataFrame([(1, c, t) for c in range(3) for t in range(10)], "pdb_id long, chain_id long, token long")
    rows = kernels.contiguous_crop(df, 12).collect()
    assert len(rows) == 12
    for c in range(3):
        own = sorted(r["token"] for r in rows if r["chain_id"] == c)
        assert own == list(range(own[0], own[0] + len(own))) if own else True


def test_global_alignment():
    assert kernels.global_alignment("ACDE", "ACE") == ("ACDE", "AC-E")
    assert kernels.global_alignment("", "A") == ("-", "A")


def test_annotations(spark):
    rows = [(1, 0, "A", 1, "MSE", "SE", "SE"), (1, 1, "A", 1, "ASX", "XD1", "X"), (1, 2, "B", 1, "UNX", "X", "X"), (1, 3, "A", 2, "HOH", "O", "O"), (1, 4, "A", 2, "GLY", "H", "H")]
    df = spark.createDataFrame(rows, "pdb_id long, atom_idx long, chain_id string, res_id long, res_name string, atom_name string, element string")
    out = [(r["res_name"], r["atom_name"]) for r in structure.met_from_mse(structure.replace_unknown_elements(df)).orderBy("atom_idx").collect()]
    assert out == [("MET", "SD"), ("ASP", "OD1"), ("HOH", "O"), ("GLY", "H")]
    assert structure.remove_hydrogens(structure.remove_water(df)).count() == 3
    runs = {r["atom_idx"]: r["unique_chain"] for r in structure.chain_runs(df).collect()}
    assert runs == {0: "A", 1: "A", 2: "B", 3: "A.1", 4: "A.1"}
    assert [r["new_name"] for r in structure.renamed_atoms(df).orderBy("atom_idx").collect()] == ["SE1", "X1", "X1", "O1", "H1"]


def test_percentiles_interpolate(spark):
    m = confidence.metric_percentiles(spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "m string, value double"), ["m"]).first()
    assert math.isclose(m["pct90"], 3.7) and m["median"] == 2.5


def test_fasta_and_a3m(spark, tmp_path):
    (tmp_path / "x.fasta").write_text("junk\n>q one\nAC\nDE\n\n#note\n>UniRef100_X_77/\nA-dDE\n>again\nACDE\n")
    rows = tf.read_fasta(spark, str(tmp_path / "x.fasta")).orderBy("record").collect()
    assert [(r["description"], r["seq"]) for r in rows] == [("q one", "ACDE"), ("UniRef100_X_77/", "A-dDE"), ("again", "ACDE")]
    a3m = tf.read_a3m(spark, str(tmp_path / "x.fasta")).orderBy("row").collect()
    assert [(r["row"], r["species"]) for r in a3m] == [(0, ""), (1, "77")]


def test_mmcif_round_trip(spark, tmp_path):
    text = """data_x
_entry.id 'X Y'
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_entity_id
_atom_site.label_seq_id
_atom_site.label_alt_id
_atom_site.occupancy
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM 1 O "O5'" ALA A 1 1 . 1.0 1.5 -2.25 3.0
HETATM 2 C CA GLY B 2 . . 0.5 0.0 0.0 1.0
#
loop_
_note.text
;two
lines
;
"""
    p = tmp_path / "x.cif"
    p.write_text(text)
    atoms = tf.atoms_of(tf.read_mmcif(spark, [str(p)]))
    rows = atoms.orderBy("atom_idx").collect()
    assert [(r["atom_name"], r["res_id"], r["x"]) for r in rows] == [("O5'", 1, 1.5), ("CA", None, 0.0)]
    assert tf.read_mmcif(spark, [str(p)], "entry").first()["id"] == "X Y"
    assert tf.read_mmcif(spark, [str(p)], "note").first()["text"] == "two\nlines"
    assert tf.read_mmcif(spark, [str(p)], "absent").count() == 0
    out = tmp_path / "y.cif"
    out.write_text(tf.cif_of(atoms).first()["value"])
    again = tf.read_mmcif(spark, [str(out)]).orderBy("id").collect()
    assert [(r["label_atom_id"], r["Cartn_x"]) for r in again] == [("O5'", "1.500"), ("CA", "0.000")]


def test_clusters_and_hits(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1ABC_1 AF_X 2DEF_2\n\nMA_1\n")
    rows = {r["member"]: (r["cluster_id"], r["cluster_size"]) for r in tf.read_clusters(spark, str(tmp_path / "c.txt")).collect()}
    assert rows == {"1abc_1": ("pdb_cluster_1ABC_1", 2), "2def_2": ("pdb_cluster_1ABC_1", 2)}
    (tmp_path / "h.m8").write_text("a\t1\nbad\nb\t2\textra\n")
    assert {r["hit"]: r["taxid"] for r in tf.read_hit_table(spark, str(tmp_path / "h.m8")).collect()} == {"a": "1", "b": "2"}


def test_stream_equals_batch(spark, tmp_path):
    from strandline.streaming import scores

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 7) AS ts, id % 3 AS user_id, concat('e', id % 2) AS event_type, CAST(id AS DOUBLE) AS value FROM range(60)")
    rows.write.parquet(str(tmp_path / "events"))
    stream = scores.windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed_scores").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["start"], r["event_type"], r["n"], r["mean"])
    assert sorted(map(key, spark.table("windowed_scores").collect())) == sorted(map(key, scores.windowed(rows).collect()))


def test_row_numbers_of_a_wide_table(spark):
    """A million rows with a payload: every number once, in the order."""
    rows = spark.range(1_000_000, numPartitions=7).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 20).alias("payload"), "id")
    out = index_table.with_row_number(rows, ["k"], "number")
    assert out.agg(F.countDistinct("number"), F.min("number"), F.max("number")).first()[:] == (1_000_000, 0, 999_999)
    w = Window.orderBy("number")
    part = out.where("number BETWEEN 400000 AND 420000").withColumn("up", F.lead("k").over(w) > F.col("k"))
    assert part.where("NOT up").isEmpty()
    assert index_table.with_row_number(rows.limit(0), ["k"], "number").count() == 0


def test_text_ids_through_kernels(spark):
    """Ids as an mmCIF file has them: structures and chains are text."""
    rng = random.Random(4)
    rows = [(s, c, k * 60 + i, i // 4, float(i % 4) + k * 0.4, float(i // 4), rng.random(), True, str(k % 2 + 1)) for s in ("1abc", "2xyz") for k, c in enumerate("ABC") for i in range(60)]
    atoms = spark.createDataFrame(rows, "pdb_id string, chain_id string, atom_idx long, res_id long, x double, y double, z double, is_resolved boolean, entity_id string")
    crop = kernels.contiguous_crop(atoms.select("pdb_id", "chain_id", F.col("atom_idx").alias("token")), 50, seed=1)
    assert {r["n"] for r in crop.groupBy("pdb_id").agg(F.count("*").alias("n")).collect()} == {50}
    close = spatial.grid_pairs(atoms, atoms, 1.0).where("a.chain_id <> b.chain_id")
    pairs = close.select("a.pdb_id", "a.chain_id", F.col("b.chain_id").alias("other"), "a.atom_idx").distinct().groupBy("pdb_id", "chain_id", "other").agg(F.count(F.lit(1)).alias("atoms"))
    gone = kernels.remove_clashing_chains(atoms.groupBy("pdb_id", "chain_id").agg(F.count(F.lit(1)).alias("n")), pairs)
    assert gone.where("pdb_id = '1abc' AND step = 0").count() == 1
    near = spatial.pocket(atoms, F.lit("C"), 3.0)
    assert {(r["chain_id"], r["is_primary"]) for r in near.collect()} == {("A", True), ("B", False)}  # both near as often: the smaller name
    centres = atoms.groupBy("pdb_id", "entity_id", "chain_id").agg(*[F.avg(c).alias(c) for c in "xyz"])
    assert annotations.match_chains(centres, centres).where("chain_id <> predicted").count() == 0
    edges = spatial.bonds(atoms.where("chain_id = 'A'"), 1.2).select("pdb_id", F.concat(F.lit("n"), "i").alias("i"), F.concat(F.lit("n"), "j").alias("j"))
    assert graph.largest_component(graph.components(edges)).select("pdb_id").distinct().count() == 2
    hits = spark.createDataFrame([("q", "b", 1.0, "S"), ("q", "a", 1.0, "S"), ("q", "c", 0.5, "T")], "query string, hit string, sum_probs double, hit_sequence string")
    assert [r["hit"] for r in templates.select_hits(hits, 5).orderBy("rank").collect()] == ["a", "c"]


def test_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIR_BLOCK", 3)
    rows = [(s, i, i % 2, i, float(i), 0.0, 0.0, float(i), 1.0, 0.0, True) for s, n in ((1, 10), (2, 1), (3, 2)) for i in range(n)]
    atoms = spark.createDataFrame(rows, "pdb_id long, atom_idx long, chain_id long, res_id long, x double, y double, z double, px double, py double, pz double, is_resolved boolean")
    got = sorted((r["pdb_id"], r["i"], r["j"], r["d"]) for r in spatial.structure_pairs(atoms).collect())
    assert got == [(s, i, j, float(j - i)) for s, n in ((1, 10), (3, 2)) for i in range(n) for j in range(i + 1, n)]


def test_fasta_is_split_between_records(spark, tmp_path):
    text = "".join(f">r{i} a>b\n" + "".join(f"{'ACDE' * (i % 5 + 1)}\n" for _ in range(i % 3)) + ("# note\n\n" if i % 7 == 0 else "") for i in range(3000))
    (tmp_path / "a,b.fasta").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = tf.scan_fasta(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        assert [(r["description"], r["seq"]) for r in df.orderBy("place").collect()] == [(f"r{i} a>b", "ACDE" * (i % 5 + 1) * (i % 3)) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_mmcif_paths_and_columns(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"s,{k}.cif").write_text(f"data_s\nloop_\n_exptl.entry_id\n_exptl.method\n{k} 'X-RAY DIFFRACTION'\n#\n")
    paths = [str(tmp_path / f"s,{k}.cif") for k in range(5)]
    for columns in (None, ["method", "entry_id", "absent"]):
        rows = tf.read_mmcif(spark, paths, "exptl", columns, files=2).collect()
        assert sorted((r["file"], r["entry_id"], r["method"]) for r in rows) == [(p, str(k), "X-RAY DIFFRACTION") for k, p in enumerate(paths)]
    assert all(r["absent"] is None for r in rows)
