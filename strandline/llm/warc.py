"""Deterministic sharded WARC writer, and a reader that checks every digest.

Records are sorted by id and digest into shards of about equal payload: the bytes of
all records before each are summed exactly, and shards are cut where the sum
passes a multiple of the shard's size, whatever the ids are. Each shard is a stream of
files that roll once their compressed size reaches a bound. Headers, record ids and
digests are derived from the rows alone, so the same table gives the same bytes
whatever the cluster. A file is written under a temporary name and renamed when
complete; the files of an archive are those in its manifest, which is written last,
and temporary files that failed attempts left are removed then. A task that is run
again writes the same bytes to the same names; a file that stands there already is
replaced.

Of records with equal payloads (of a least size), that with the smallest id is a
response and the others are revisits that refer to it.

Defined results: a null payload is empty; a null URL becomes urn:page:<id>; a row
without an id is always a response and is read back without one; rows
with the same id and payload are all responses, or all revisits of a smaller id, and
stand in one shard; any 64-bit id is allowed;
an empty table gives an archive without files; further columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, materialise, shared_folder, table

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    #: Payload bytes that a shard has about; more, where there would be more than most_shards.
    shard_bytes: int = 32 << 20
    most_shards: int = 16384
    #: Compressed bytes after which a file is closed.
    file_bytes: int = 16 << 20
    #: Payloads smaller than this are never revisits.
    least_bytes: int = 0
    level: int = 6
    date: str = "2020-01-01T00:00:00Z"
    prefix: str = "pages"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, a: Archive) -> bytes:
    """One gzip member with a response, or with a revisit where refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {a.date}",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{_sha1(block)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"WARC-Refers-To-Target-URI: {_uri(refers_url, refers_to)}",
            f"WARC-Refers-To-Date: {a.date}",
            f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    member = zlib.compressobj(a.level, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


class _Files:
    """The files of one shard: temporary names while open, their own when closed."""

    def __init__(self, root: str, shard: int, a: Archive):
        self.fs, self.path = pafs.FileSystem.from_uri(root)
        self.shard, self.a, self.roll, self.out = shard, a, 0, None
        self.fs.create_dir(self.path, recursive=True)

    def write(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"{self.a.prefix}-{self.shard:08d}-{self.roll:05d}.warc.gz"
            self.temp = f"{self.path}/.{self.name}.{TaskContext.get().taskAttemptId()}.{uuid.uuid4().hex}.tmp"
            self.out, self.n, self.size = self.fs.open_output_stream(self.temp, compression=None), 0, 0
        self.out.write(data)
        self.n, self.size = self.n + 1, self.size + len(data)
        if self.size >= self.a.file_bytes:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            final = f"{self.path}/{self.name}"
            if self.fs.get_file_info(final).type != pafs.FileType.NotFound:  # an earlier attempt's, with the same bytes
                self.fs.delete_file(final)
            self.fs.move(self.temp, final)
            yield self.shard, self.roll, self.name, self.n, self.size
            self.roll, self.out = self.roll + 1, None


_MANIFEST = "shard long, roll long, file string, records long, bytes long"


def _key(page_id: Column, digest: Column) -> Column:
    """Text that sorts as id and digest do; rows without an id come first."""
    place = F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.coalesce(place, F.lit("")), F.substring(F.hex(digest), 1, 16))


def first_keys(sized: DataFrame, a: Archive) -> list[str]:
    """The least key of each shard but the first, from columns key and n: at most most_shards of them reach the driver."""
    total = sized.agg(F.sum("n")).first()[0] or 0
    width = max(1, a.shard_bytes, -(-total // a.most_shards))
    sums = sized.groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").withColumn("part", F.spark_partition_id())
    sums = materialise(sums, "warc-keys")
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = sums.withColumn("inside", inside).join(F.broadcast(parts.select("part", earlier.alias("earlier"))), "part")
    firsts = before.groupBy(F.floor((F.col("earlier") + F.col("inside")) / width).alias("shard")).agg(F.min("key").alias("key"))
    return sorted(r["key"] for r in firsts.collect())[1:]


def _shard(key: Column, firsts: list[str]) -> Column:
    """Number of the shard that a key stands in, by binary search."""
    if not firsts:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps(firsts)), "array<string>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(firsts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.coalesce(F.get(array, n + step - 1) <= key, F.lit(False)), n + step).otherwise(n))


def _remove_temporary(spark: SparkSession, root: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, ".*.tmp")) or []:
        fs.delete(found.getPath(), False)


def write(pages: DataFrame, root: str, a: Archive = Archive(), id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows below root and return the manifest: shard, roll, file, records, bytes."""
    spark = pages.sparkSession
    bounded_batches(spark)
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    sized = materialise(rows.select("id", "url", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").cast("long").alias("n")), "warc-digests")

    # The smallest id of each repeated payload; combined map-side, so a hot payload is one row for each task.
    first = F.min(F.struct("id", "url"))
    repeated = sized.where((F.col("n") >= a.least_bytes) & F.col("id").isNotNull()).groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = sized.join(repeated.select("digest", F.col("f.id").alias("refers_to"), F.col("f.url").alias("refers_url")), "digest")
    revisits = revisits.where("id <> refers_to").select("id", "digest", "refers_to", "refers_url").distinct()

    # A revisit's note travels just before its row, so payloads are shuffled once.
    firsts = first_keys(sized.select(_key(F.col("id"), F.col("digest")).alias("key"), "n"), a)
    none, blank = F.lit(None).cast("long"), F.lit(None).cast("string")
    digest = F.unhex(F.sha2("payload", 256))
    both = revisits.select("id", "digest", F.lit(0).alias("kind"), blank.alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to", "refers_url")
    both = both.unionByName(rows.select("id", digest.alias("digest"), F.lit(1).alias("kind"), "url", "payload", none.alias("refers_to"), blank.alias("refers_url")))
    both = both.select(_shard(_key(F.col("id"), F.col("digest")), firsts).cast("long").alias("shard"), "*")
    both = both.repartitionById(len(firsts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, note = None, None
        done: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "id", "digest", "kind", "url", "payload", "refers_to", "refers_url")]
            for i in range(batch.num_rows):
                shard, page_id, digest, kind, url, payload, refers_to, refers_url = (c[i].as_py() for c in columns)
                if kind == 0:
                    note = (page_id, digest, refers_to, refers_url)
                    continue
                if files is None or files.shard != shard:
                    done += files.close() if files else ()
                    files = _Files(root, shard, a)
                of = note[2:] if note and note[:2] == (page_id, digest) else (None, None)
                done += files.write(record(page_id, url, payload, *of, a))
        done += files.close() if files else ()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["shard", "roll", "file", "records", "bytes"])

    manifest = both.mapInArrow(run, _MANIFEST)
    manifest.write.parquet(f"{root}/manifest")
    _remove_temporary(spark, root)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name] = value.strip()
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head['WARC-Record-ID']} is cut short")
        yield head, block


_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(spark: SparkSession, root: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the files in the manifest, with every digest computed again; a wrong one is an error."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        out, size = [], 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in _records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = head["WARC-Type"]
                        if _sha1(block) != head["WARC-Block-Digest"].removeprefix("sha1:") or kind == "response" and _sha1(payload) != digest:
                            raise ValueError(f"record {head['WARC-Record-ID']} of {name} does not have its digest")
                        n = int(http.decode().lower().partition("content-length:")[2].split("\r\n")[0])
                        refers_to = head.get("WARC-Refers-To-Page-ID")
                        page_id = head["WARC-Page-ID"]
                        out.append((int(page_id) if page_id else None, head["WARC-Target-URI"], kind, n, digest, refers_to and int(refers_to), payload if with_payload and kind == "response" else None))
                        size += len(payload) + 200
                        if size > 4 << 20:
                            yield _batch(out)
                            out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    files = manifest.select("file", "shard", "roll")
    n = max(1, min(files.count(), 4096))
    return files.repartition(n, "shard", "roll").select("file").mapInArrow(run, _READ)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives in the shared folder and read them back."""
    root = shared_folder(spark, "warc")
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    manifest = write(table(spark, sf_dir, "pages"), root)
    return read(spark, root, manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A digest's 160 bits as text, cut into 32 letters of five.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
bits AS (
  SELECT page_id, strlen(body) AS payload_bytes, min(page_id) OVER (PARTITION BY body) AS first,
         array_to_string(list_transform(string_split(sha1(body), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', strpos('0123456789abcdef', c) * 4 - 3, 4)), '') AS b
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(b, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(b, i * 5 + 2, 1) AS INT) + 4 * CAST(substr(b, i * 5 + 3, 1) AS INT)
           + 2 * CAST(substr(b, i * 5 + 4, 1) AS INT) + CAST(substr(b, i * 5 + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM bits
"""
