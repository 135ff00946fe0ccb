"""Exact deduplication through a log-structured merge index of digests.

Documents come in batches, and every split of a batch is a memtable: its rows are reduced to (digest, id), sorted
by digest and flushed as one run, a Parquet file with a bloom filter on the
digest. Compaction merges the runs flushed since the last one into a sorted level
that has, for each digest, the identifier that stays and the number of rows. The
level has a blocked bloom filter of its own, a table of words: new digests probe it,
those that it rules out are appended without a look at the level, and the
few others are looked up. Digests with more than one row are hits; their bytes are
compared before any row is given up.

Defined results: a null text equals the empty text; equal texts form one group
whatever their other columns hold; repeated rows (same id and text) count as
rows of their group; a row without an id is counted but never the one that stays;
an empty table gives an empty result; further columns of
the input are never read, so their names cannot clash.

Only DataFrame operations run here. The hot group of a third of all rows is
reduced before each shuffle: compaction combines map-side, and the byte
comparison is min(text) = max(text) per digest, which combines map-side too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import shared_folder, table

#: Bytes of digests up to which the hits are broadcast; beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes that a digest with its id and count takes in a broadcast relation, and a word of a filter.
HIT_BYTES, WORD_BYTES = 120, 48
#: Digests for each 64-bit word of a filter, and the bits that each sets.
PER_WORD, BITS = 5, 3


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _small(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """df, to be broadcast if its rows, which are counted, fit the bound."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df


def _word(digest: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(words))


def _mask(digest: Column) -> Column:
    """The bits that a digest sets in its word."""
    h = F.xxhash64(digest, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int")) for i in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


class DigestIndex:
    """Runs of (digest, id) below one folder, and the level they are compacted into.

    keep: 'smallest' or 'largest', the identifier of a digest that stays.
    digest: text column -> binary column; any function works, since hits are verified.
    """

    def __init__(self, spark: SparkSession, root: str, keep: str = "smallest", digest: Callable[[Column], Column] = sha256_digest):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")
        self.spark, self.root, self.digest = spark, root, digest
        self.pick = F.min if keep == "smallest" else F.max
        self.n_batches = self.n_merged = 0
        self.level: str | None = None
        self.words = 0

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Flush each split of docs as a sorted run with a filter; no row is shuffled."""
        if self.level is not None and self.n_merged == self.n_batches:
            self.build_filter()  # the batch will be merged with what is there
        path = f"{self.root}/runs/batch={self.n_batches}"
        rows = docs.select(self.digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.col(id_col).cast("long").alias("id"))
        (
            rows.sortWithinPartitions("digest", "id")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(path)
        )
        self.n_batches += 1
        return self._read(path)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("digest binary, id long").parquet(path)

    def runs(self) -> DataFrame:
        """All flushed rows, one for each row of the input."""
        return self._read(f"{self.root}/runs").select("digest", "id")

    def fresh(self) -> DataFrame:
        """Digests of the runs that are not yet in the level: digest, keep_id, n."""
        paths = [f"{self.root}/runs/batch={k}" for k in range(self.n_merged, self.n_batches)]
        rows = self.spark.read.schema("digest binary, id long").parquet(*paths)
        return rows.groupBy("digest").agg(self.pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))

    def probe(self, digests: DataFrame) -> DataFrame:
        """Those rows whose digest the level may hold, by its filter; the level itself is not read."""
        words = self.spark.read.schema("word long, bits long").parquet(f"{self.level}-filter")
        placed = digests.withColumn("word", _word(F.col("digest"), self.words)).join(_small(words, WORD_BYTES), "word")
        mask = _mask(F.col("digest"))
        return placed.where(F.col("bits").bitwiseAND(mask) == mask).drop("word", "bits")

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
        return self.spark.read.schema("digest binary, keep_id long, n long").parquet(path)

    def compact(self) -> DataFrame:
        """Merge the runs since the last compaction into the level, sorted by digest: digest, keep_id, n."""
        merged = self.fresh()
        if self.level is not None:
            fresh = self._write(merged, f"{self.root}/fresh-{self.n_batches}")
            suspects = self._write(self.probe(fresh), f"{self.root}/suspects-{self.n_batches}")
            old = self.index()
            both = old.select("digest", F.col("keep_id").alias("_k"), F.col("n").alias("_n")).join(_small(suspects, HIT_BYTES), "digest")
            pick = F.least if self.pick is F.min else F.greatest
            again = self._write(both.select("digest", pick("_k", "keep_id").alias("keep_id"), (F.col("_n") + F.col("n")).alias("n")), f"{self.root}/again-{self.n_batches}")
            known = _small(again.select("digest"), HIT_BYTES)
            merged = old.join(known, "digest", "left_anti").unionByName(fresh.join(known, "digest", "left_anti")).unionByName(again)
        path = f"{self.root}/level-{self.n_batches}"
        self._write(merged, path)
        self.level, self.n_merged = path, self.n_batches
        return self.index()

    def build_filter(self) -> None:
        """Write the filter of the level, which the next compaction probes."""
        index = self.index()
        self.words = max(1, -(-index.count() // PER_WORD))
        words = index.groupBy(_word(F.col("digest"), self.words).alias("word")).agg(F.bit_or(_mask(F.col("digest"))).alias("bits"))
        words.write.parquet(f"{self.level}-filter")

    def index(self) -> DataFrame:
        if self.level is None:
            raise ValueError("compact() comes first")
        return self.spark.read.schema("digest binary, keep_id long, n long").parquet(self.level)

    def hits(self) -> DataFrame:
        """The index rows with more than one input row, broadcast if they are few."""
        return _small(self.index().where("n > 1"), HIT_BYTES)

    def verify(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
        """Compare the bytes of all hits. None if every digest stands for one text.

        Otherwise the rows of the digests that stand for several texts, regrouped
        by the bytes themselves: digest, id, keep_id, n.
        """
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(self.digest(text).alias("digest"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
        hit = rows.join(self.hits().select("digest"), "digest", "left_semi")
        # Binary collation: min and max agree exactly when all bytes agree.
        mixed = hit.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("digest")
        path = f"{self.root}/mixed-{self.n_batches}"
        mixed.write.parquet(path)
        mixed = self.spark.read.schema("digest binary").parquet(path)
        if mixed.isEmpty():
            return None
        rows = rows.join(mixed, "digest", "left_semi")
        groups = rows.groupBy("digest", "text").agg(self.pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        return rows.join(groups, ["digest", "text"]).select("digest", "id", "keep_id", "n")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    digest: Callable[[Column], Column] = sha256_digest,
    batches: int = 3,
    index: DigestIndex | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    kept holds for the row whose id is keep_id; if that id itself is repeated
    with the same text, all of its rows carry kept = true. The rows come to the index in `batches` parts by
    their ids, as a corpus does that grows: from the second on, each probes the filter of the level and is merged into it. An empty index may be given.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, shared_folder(spark, "exact-dedup"), keep, digest)
    for k in range(batches):
        index.flush(docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(batches)) == k), id_col, text_col)
        index.compact()
    found = index.runs().join(index.hits(), "digest", "left").select(
        "digest", "id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("n")
    )
    regrouped = index.verify(docs, id_col, text_col)
    if regrouped is not None:
        found = found.join(regrouped.select("digest").distinct(), "digest", "left_anti").unionByName(regrouped)
    return found.select("id", "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), "digest")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of documents; of equal texts the largest doc_id stays."""
    found = exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
