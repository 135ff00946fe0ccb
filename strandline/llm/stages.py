"""The operators as stages over tables with the columns of documents.

Each takes (spark, docs, sf_dir) and returns the rows that stay, with the same
columns, but for the last, which returns the packed pieces. In the first two
stages the whole row travels as the operator's id, so texts are not joined
back; the dedup stages join each verdict to its own row, by a number that they give
to the rows where doc_id does not tell them apart.

Defined results, in every stage: a null text is empty (and goes in the first stage,
as it has under 50 words); rows without a doc_id are judged like any others, and
of equal or near texts they stay only if no row with an id does; rows that share a
doc_id are judged one by one, and of fully repeated rows one stays after exact dedup;
ties go to the largest doc_id among exact copies and to the smallest among near
ones; long texts are read whole; an empty table gives an empty result. The columns
of documents come out; other columns are dropped, so their names cannot clash, and
of lang, source and n_chars those that a table lacks are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import exact_dedup, language, near_dup, packing, quality
from strandline.llm.common import in_order
from strandline.llm.near_dup import _small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of a document's main language.
MAIN_SHARE = 0.5


TYPES = {"lang": "string", "source": "string", "n_chars": "long"}


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents; those that are absent are null."""
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(TYPES[c]).alias(c) for c in COLUMNS])


def _as_rows(docs: DataFrame) -> DataFrame:
    return _columns(docs).select(F.struct(*COLUMNS).alias("row"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed, and documents that fail or lose too much go."""
    found = quality.judge(_as_rows(docs), id_col="row").where("kept")
    changed = F.col("n_failed_lines") > 0
    text = F.when(changed, F.col("cleaned_text")).otherwise(F.col("id.text"))
    n_chars = F.when(changed, F.char_length("cleaned_text").cast("long")).otherwise(F.col("id.n_chars"))
    return found.select("id.doc_id", text.alias("text"), "id.lang", "id.source", n_chars.alias("n_chars"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a main language go; a missing label is filled in."""
    docs = _columns(docs)
    model = language.learn(docs.where(~language.held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = language.predict(_as_rows(docs), model, id_col="row")
    found = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MAIN_SHARE))
    return found.select("id.doc_id", "id.text", F.coalesce("id.lang", "lang_pred").alias("lang"), "id.source", "id.n_chars")


def _with_row(docs: DataFrame, nulls_first: bool) -> DataFrame:
    """Adds row, a number of each row in the order of doc_id: doc_id itself, unless some row lacks it or shares it with another."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    return in_order(docs, F.asc_nulls_first("doc_id") if nulls_first else F.asc_nulls_last("doc_id"), "row")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id stays; one without an id only if none has one."""
    docs = _with_row(_columns(docs), nulls_first=True)
    gone = exact_dedup.exact_dedup(docs, id_col="row", keep="largest").where("NOT kept").select(F.col("id").alias("row"))
    return docs.join(_small(gone), "row", "left_anti").select(COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five words, similarity 0.8) one row with the smallest doc_id stays; one without an id only if none has one."""
    docs = _with_row(_columns(docs), nulls_first=False)
    gone = near_dup.near_dup(docs, near_dup.NearDup(shingle=5, percent=80), id_col="row").where("NOT kept").select(F.col("id").alias("row"))
    return docs.join(_small(gone), "row", "left_anti").select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, in windows of at most 2048 tokens."""
    return packing.pack(docs, packing.tokenizer_text())
