"""Multiple sequence alignments as rows (query, row, species, seq) and in long form (query, row, col, code)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import sequences as S
from strandline.operators.index_table import with_row_number
from strandline.shared import materialise

#: Queries whose depths are broadcast.
BROADCAST_ROWS = 500_000


def dedup(msa: DataFrame, order: str = "row") -> DataFrame:
    """The first row of each query for each aligned sequence; a hot sequence is combined before the shuffle."""
    rows = msa.withColumn("aligned", S.aligned(F.col("seq")))
    firsts = rows.groupBy("query", "aligned").agg(F.min(order).alias(order))
    return rows.join(firsts, ["query", "aligned", order], "left_semi")


def first_digests(msa: DataFrame, order: str = "row") -> DataFrame:
    """query, order and digest (MD5) of the aligned sequence of the rows that `dedup` keeps; sequences stay where they are read, and only digests are shuffled."""
    aligned = msa.select("query", order, S.aligned(F.col("seq")).alias("aligned"))
    keyed = aligned.select("query", F.sha2("aligned", 256).alias("_key"), F.struct(order, F.md5("aligned").alias("digest")).alias("_row"))
    return keyed.groupBy("query", "_key").agg(F.min("_row").alias("_f")).select("query", f"_f.{order}", "_f.digest")


def merge(parts: list[DataFrame]) -> DataFrame:
    """Union in order of priority, then the first row of each aligned sequence."""
    out = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("priority", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    rows = out.withColumn("aligned", S.aligned(F.col("seq")))
    firsts = rows.groupBy("query", "aligned").agg(F.min(F.struct("priority", "row")).alias("_f")).select("query", "aligned", "_f.priority", "_f.row")
    return rows.join(firsts, ["query", "aligned", "priority", "row"], "left_semi")


def deletion_counts(msa: DataFrame) -> DataFrame:
    """Columns, columns with deletions and sum of deletions of each row."""
    d = msa.withColumn("d", S.deletions(F.col("seq")))
    return d.select("query", "row", F.size("d").cast("long").alias("columns"), F.size(F.filter("d", lambda x: x > 0)).cast("long").alias("with_deletion"), F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x).alias("deletions"))


def long_form(msa: DataFrame) -> DataFrame:
    """query, row, col, code."""
    return msa.select("query", "row", F.posexplode(S.codes(F.col("seq"))).alias("col", "code"))


def profile(msa: DataFrame) -> DataFrame:
    """Share of each code in each column, over all rows of the query."""
    depth = msa.groupBy("query").agg(F.count(F.lit(1)).alias("depth"))
    counts = long_form(msa).groupBy("query", "col", "code").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(depth, "query").select("query", "col", "code", (F.col("n") / F.col("depth")).alias("share"))


def gap_rows(msa: DataFrame, gap: int = 31) -> DataFrame:
    """Rows with at least one column that is no gap."""
    return msa.where(F.exists(S.codes(F.col("seq")), lambda c: c != gap))


def pair_by_species(msa: DataFrame, most_per_species: int | None = 600, named_only: bool = True) -> DataFrame:
    """Rows of several chains (query) side by side: the nth row of a species in one chain with the nth in the others.

    Per species as many rows as the poorest of its chains has, and at most most_per_species (None: all of them); only species of
    two chains or more. A null chain is a chain; rows of no species are left out: null, and with named_only the empty name.
    """
    named = msa.where("species <> ''" if named_only else "species IS NOT NULL").select("species", "query", "row")
    sizes = named.groupBy("species", "query").agg(F.count(F.lit(1)).alias("n"))
    least = F.min("n") if most_per_species is None else F.least(F.min("n"), F.lit(most_per_species))
    common = sizes.groupBy("species").agg(F.count(F.lit(1)).alias("chains"), least.alias("take")).where("chains >= 2")
    if most_per_species is not None:
        # The literal bound is a group limit before the shuffle: no task gets more rows of a species than may be taken from each split.
        numbered = named.withColumn("nth", F.row_number().over(W.partitionBy("species", "query").orderBy("row"))).where(F.col("nth") <= most_per_species)
    else:
        numbered = _numbered(named)
    return numbered.join(common, "species").where("nth <= take").select("species", "nth", "query", "row", "chains")


def _numbered(named: DataFrame) -> DataFrame:
    """Adds nth, from 1 by row within species and query, by parts of the sorted rows, so that no group has to fit a task."""
    placed = with_row_number(named, ["species", "query", "row"], "_place")
    first = placed.groupBy("species", "query").agg(F.min("_place").alias("_first"))
    met = (F.col("a.species") == F.col("b.species")) & F.col("a.query").eqNullSafe(F.col("b.query"))
    return placed.alias("a").join(first.alias("b"), met).select("a.species", "a.query", "a.row", (F.col("_place") - F.col("_first") + 1).alias("nth"))


def featurize(msa: DataFrame, table: dict = S.PROTEIN_CODES, other: int = 20) -> DataFrame:
    """query, row, codes, deletions, species, depth (rows of the query): the features of an alignment, row by row.

    msa: query, row, description, seq. The depths are broadcast unless there are very many, so a deep alignment stays where it is read.
    """
    depth = materialise(msa.groupBy(F.col("query").alias("_query")).agg(F.count(F.lit(1)).alias("depth")), "depth")
    depth = F.broadcast(depth) if depth.count() <= BROADCAST_ROWS else depth
    rows = msa.select("query", "row", S.codes(F.col("seq"), table, other).alias("codes"), S.deletions(F.col("seq")).alias("deletions"), S.species(F.col("description")).alias("species"))
    return rows.join(depth, F.col("query").eqNullSafe(F.col("_query"))).drop("_query")


def unpaired(msa: DataFrame, paired: DataFrame) -> DataFrame:
    """Rows whose aligned sequence no paired row of the query has."""
    seen = paired.select("query", S.aligned(F.col("seq")).alias("aligned")).distinct()
    return msa.withColumn("aligned", S.aligned(F.col("seq"))).join(seen, ["query", "aligned"], "left_anti")


def with_taxid(records: DataFrame, taxa: DataFrame) -> DataFrame:
    """Records with their taxon, and a header that names it once; of repeated hits the last taxon wins."""
    last = taxa.groupBy("hit").agg(F.max(F.struct("pos", "taxid")).alias("t")).select("hit", F.col("t.taxid").alias("taxid"))
    header = F.when(F.col("taxid").isNull(), F.col("hit")).otherwise(F.concat(F.lit("UniRef100_"), F.regexp_replace("hit", "^UniRef100_", ""), F.lit("_"), F.col("taxid").cast("string"), F.lit("/")))
    return records.join(last, "hit", "left").withColumn("header", header)


def route(records: DataFrame) -> DataFrame:
    """Where each record goes: pairing for headers of UniRef100, else non_pairing."""
    return records.withColumn("target", F.when(F.col("header").startswith("UniRef100"), "pairing").otherwise("non_pairing"))


def fasta_records(lines: DataFrame, by: list[str]) -> DataFrame:
    """Records of FASTA text given as lines (by, pos, line): description and joined sequence; text before the first > is ignored."""
    w = W.partitionBy(*by).orderBy("pos")
    clean = lines.withColumn("line", F.trim("line")).where("line <> '' AND NOT startswith(line, '#')")
    clean = clean.withColumn("record", F.sum(F.col("line").startswith(">").cast("int")).over(w)).where("record > 0")
    grouped = clean.groupBy(*by, "record").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return grouped.select(*by, "record", F.substring(F.col("l")[0]["line"], 2, 1 << 30).alias("description"), F.array_join(F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: x["line"]), "").alias("seq"))
