"""Alignments beyond the sizes of the driver's tables: many rows of a species, files that no task holds."""

from strandline.operators import alignment
from strandline.sources import text_formats as tf


def test_pairing_without_a_bound(spark):
    """More rows of a species than any bound, a null chain, and a species without a name, over several parts of the sort."""
    rows = [("q1", 7 * i % 1501, "a") for i in range(1501)] + [(None, i, "a") for i in range(701)] + [("q1", 5000, ""), ("q2", 5001, ""), ("q2", 5002, None), ("q1", 5003, None), ("q2", 6000, "b")]
    df = spark.createDataFrame(rows, "query string, row long, species string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = alignment.pair_by_species(df, None, named_only=False).collect()
        named = alignment.pair_by_species(df, None).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {("a", i + 1, q, i, 2) for q in ("q1", None) for i in range(701)}
    assert len(named) == 1402 and {tuple(r) for r in named} == {(s, n, q, r, c) for s, n, q, r, c in want}
    assert len(got) == 1404 and {tuple(r) for r in got} == want | {("", 1, "q1", 5000, 2), ("", 1, "q2", 5001, 2)}


def test_a_deep_alignment_makes_several_files(spark, tmp_path):
    rows = [("en", i, str(i), f"AC{'de' * (i % 3)}{'FGHIKLMN'[i % 8]}") for i in range(2000)] + [(None, i, str(i), "A") for i in range(3)]
    df = spark.createDataFrame(rows, "query string, row long, description string, seq string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for by_query, glob in ((True, "query=en/*.txt"), (False, "*.txt")):
            path = tmp_path / str(by_query)
            tf.write_a3m(df, str(path), by_query)
            sizes = [f.stat().st_size for f in path.glob(glob)]
            assert len(sizes) > 1 and max(sizes) < 0.5 * sum(sizes)
            assert tf.scan_fasta(spark, str(path) + ("/*" if by_query else "")).count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {tuple(r) for r in alignment.first_digests(df).select("query", "row").collect()}
    assert got == {("en", i) for i in range(8)} | {(None, 0)} == {tuple(r) for r in alignment.dedup(df).select("query", "row").collect()} | {(None, 0)}


def test_features_of_a_deep_alignment_are_not_shuffled(spark):
    df = spark.createDataFrame([(q, i, "sp|P12345|A_HUMAN", "ACd") for q in ("en", None) for i in range(4)], "query string, row long, description string, seq string")
    out = alignment.featurize(df)
    assert [r["depth"] for r in out.collect()] == [4] * 8
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
