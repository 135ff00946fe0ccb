r"""Line dedup: lines that several documents hold stay in the first of them only.

A line's key is the line stripped of [\x20\x09-\x0D] at both ends, A-Z lower-cased. Two
Bloom filters find the keys that may repeat. Every split sends each distinct hash of a key once, marked if
two of its rows hold it. The hashes are dealt to shards, and a shard streams them
through a filter of hashes seen once; those that are there already, or are marked, enter the filter of
hashes seen twice. The parts of that filter, of a bounded size, go to every task, and
only lines that it holds are shuffled with their keys: the keys themselves are compared, the
smallest document of each is chosen, and the lines of the others go.

A filter never misses a repeat, so results are exact whatever its size. Where a corpus has
more hashes than fit its bound, it lets more lines pass as suspects, up to all of them; `most_words` is
for the cluster to choose.

Defined results: a null or empty text is one empty line; documents are told apart by their
id, so rows that share an id count as one document, of which each row is judged by its own lines; rows without an
id are together one document, which comes after all others; repeated lines of a document stay or go together; an
empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, materialise, table

SPACE = b" \t\n\x0b\x0c\r"
#: Keys with more suspects than this are hot and are broadcast; of a large corpus, those with more than one in so many of all suspects.
HOT, MOST_HOT = 1 << 16, 200_000


@dataclass(frozen=True)
class LineDedup:
    #: Code points that a key has at least.
    least_points: int = 10
    #: Hashes for each 64-bit word of a filter.
    per_word: int = 4
    #: Words of the twice-seen filter at most; it goes to every task.
    most_words: int = 1 << 22
    #: Words of a shard's once-seen filter at most.
    shard_words: int = 1 << 19


def keys_of(text: bytes, least_points: int) -> list[bytes | None]:
    """The key of each line; None where it is too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()  # of bytes, so A-Z only
        n = len(key)
        out.append(key if n >= least_points and (n >= 4 * least_points or len(key.decode("utf-8", "replace")) >= least_points) else None)
    return out


def _hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def _mixed(h: np.ndarray) -> np.ndarray:
    return h * np.uint64(0x9E3779B97F4A7C15)


def _mask(h: np.ndarray) -> np.ndarray:
    """The three bits that a hash sets in its word."""
    g, one, low = _mixed(h), np.uint64(1), np.uint64(63)
    return (one << (g >> np.uint64(58))) | (one << ((g >> np.uint64(52)) & low)) | (one << ((g >> np.uint64(46)) & low))


def _entries(rows: DataFrame, p: LineDedup) -> DataFrame:
    """Distinct hashes of the keys of each batch: h, and whether two rows of the batch hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for text in batch.column("text").to_pylist():
                found.extend({_hash(k) for k in keys_of(text, p.least_points) if k is not None})
            h, n = np.unique(np.array(found, dtype=np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], ["h", "twice"])

    return rows.select("text").mapInArrow(run, "h long, twice boolean")


def twice_filter(entries: DataFrame, p: LineDedup) -> np.ndarray:
    """Words of the filter of hashes that are marked or come at least twice; entries may be read several times."""
    spark = entries.sparkSession
    n = max(1, entries.count())
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (p.per_word * p.shard_words)))
    words = max(1, -(-min(p.most_words, -(-n // p.per_word)) // shards))
    once_words = max(64, -(-2 * n // (p.per_word * shards)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            shard = (h % np.uint64(words * shards)) // np.uint64(words)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("twice"), pa.array(shard.astype(np.int32))], ["h", "twice", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            every = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            marked, shard = batch.column("twice").to_numpy(zero_copy_only=False), batch.column("shard").to_numpy(zero_copy_only=False)
            for s in np.unique(shard).tolist():
                once, twice = filters.setdefault(s, (np.zeros(once_words, np.uint64), np.zeros(words, np.uint64)))
                here = shard == s
                h, back, count = np.unique(every[here], return_inverse=True, return_counts=True)
                repeated = count > 1
                repeated[back[marked[here]]] = True
                at, mask = (_mixed(h) >> np.uint64(8)) % np.uint64(once_words), _mask(h)
                repeated |= (once[at] & mask) == mask
                np.bitwise_or.at(once, at, mask)
                np.bitwise_or.at(twice, (h % np.uint64(words * shards) % np.uint64(words))[repeated], mask[repeated])
        full = [(s, twice.tobytes()) for s, (_, twice) in filters.items() if twice.any()]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in full], pa.int32()), pa.array([b for _, b in full], pa.binary())], ["shard", "words"])

    dealt = entries.mapInArrow(deal, "h long, twice boolean, shard int").repartition(shards, "shard")
    out = np.zeros(words * shards, np.uint64)
    for row in dealt.mapInArrow(run, "shard int, words binary").toLocalIterator():
        out[row["shard"] * words : (row["shard"] + 1) * words] = np.frombuffer(row["words"], np.uint64)
    return out


def _suspects(rows: DataFrame, twice: np.ndarray, p: LineDedup) -> DataFrame:
    """id, t, key, digest of the lines whose hash the filter holds, each key once for each row."""
    shared = rows.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            keys: list[bytes] = []
            owners: list[int] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = {k for k in keys_of(text, p.least_points) if k is not None}
                keys.extend(own)
                owners.extend([i] * len(own))
            h = np.array([_hash(k) for k in keys], dtype=np.uint64)
            mask = _mask(h)
            held = np.flatnonzero((words[h % np.uint64(len(words))] & mask) == mask)
            owner = pa.array(np.array(owners, dtype=np.int64)[held])
            suspected = [keys[i] for i in held]
            digests = pa.array([_digest(k) for k in suspected], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(owner), batch.column("t").take(owner), pa.array(suspected, pa.binary()), digests], ["id", "t", "key", "digest"])

    return rows.mapInArrow(run, "id long, t long, key binary, digest binary")


def _dropped(suspects: DataFrame) -> DataFrame:
    """id, t, digest of the lines that go: their key is in several documents, and theirs is not the first.

    Keys are compared as they are; from there on their digests stand for them. Hot keys, of which there are at most MOST_HOT
    in any corpus, are broadcast, so no task gets all their rows.
    """
    held = suspects.groupBy("key", "digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.bool_or(F.col("id").isNull()).alias("nameless"), F.count(F.lit(1)).alias("n"))
    confirmed = materialise(held.where("first <> last OR (nameless AND first IS NOT NULL)").select("digest", "first", "n"), "lines-confirmed")
    hot = F.col("n") > max(HOT, suspects.count() // MOST_HOT)
    first = F.broadcast(confirmed.where(hot).select("digest", F.col("first").alias("hot_first")))
    narrow = suspects.select("id", "t", "digest").join(first, "digest", "left")
    rest = narrow.where("hot_first IS NULL").join(confirmed.where(~hot).select("digest", "first"), "digest")
    met = rest.select("id", "t", "digest", "first").unionByName(narrow.where("hot_first IS NOT NULL").select("id", "t", "digest", F.col("hot_first").alias("first")))
    return met.where("id IS NULL OR id <> first").select("id", "t", "digest")


def _without(rows: DataFrame, p: LineDedup) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, kept = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                every = text.split(b"\n")
                lines.append(len(every))
                if gone:
                    away = set(gone)
                    rest = [line for line, key in zip(every, keys_of(text, p.least_points)) if key is None or _digest(key) not in away]
                    dropped.append(len(every) - len(rest))
                    text = b"\n".join(rest)
                else:
                    dropped.append(0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_lines", "n_dropped", "kept"])

    return rows.mapInArrow(run, "id long, n_lines long, n_dropped long, kept binary")


def line_dedup(docs: DataFrame, p: LineDedup = LineDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_lines (before), n_dropped, text (the lines that stay)."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # t tells the rows of one id apart; rows that share both have the same lines, or at least the same document.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))
    twice = twice_filter(materialise(_entries(rows, p), "lines-hashes"), p)
    suspects = materialise(_suspects(rows, twice, p), "lines-suspects")
    gone = _dropped(suspects).groupBy("id", "t").agg(F.collect_set("digest").alias("gone"))
    both = rows.alias("r").join(gone.alias("g"), F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.t") == F.col("g.t")), "left").select("r.id", "r.text", "g.gone")
    return _without(both, p).select("id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of documents, with digests of the texts that stay."""
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT doc_id, line, i, coalesce(first_id <> doc_id, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
