r"""Near-duplicate groups by one-permutation MinHash.

Words are runs of characters other than space, tab, newline, vertical tab, form
feed and carriage return, with A-Z lower-cased; a text's set holds its distinct
shingles of k words (a text of fewer words: the whole sequence; a text without
words: empty, linked with nothing). Two texts are linked if the Jaccard
similarity of their sets reaches the threshold, and groups are the connected
components of the links.

1. One permutation: each set is cut into bins by the top bits of its hashes, and
   a bin's value is its least hash. Empty bins borrow from a filled bin chosen
   by fixed random ranks of the pair (empty, filled): optimal densification.
2. Equal sets collapse into their smallest id, so thousands of copies cost one row.
3. Bands of bins make buckets. A bucket gives a star, not all pairs: its smallest
   id against the other members.
4. Links are confirmed on the full sets, and groups are merged.
5. A star can miss links between its leaves. So a bucket whose members are still
   in several groups deals out further centres, more in each round, against
   members of other groups, until every pair of a bucket is in one group,
   compared, or ruled out by sizes: elements that no other set of an open bucket
   holds can't be common, and of the others two sets share in each slice of the
   hash range at most the smaller count. Both bound the similarity from above.
   No bucket, partner or candidate is capped.

Pairs of a bucket are dealt by blocks of its members and blocks of its centres, so
a bucket with a third of all rows is spread over many tasks.

Defined results: null and empty texts have empty sets and stay alone; rows
without an id are in no group and not kept; rows that share an id are documents of
their own, each with its own set and group (where their texts are equal, of one
group), and every input row gives one row; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import textkernels as tk
from strandline.llm.common import bounded_batches, in_order, materialise, table
from strandline.llm.components import components

#: Bytes of ids up to which a list of ids is broadcast; beyond it, it is joined by shuffle.
BROADCAST_BYTES = 16 << 20
ID_BYTES = 48
#: Most centres that a bucket deals out in each round after the first, which has one; the last number is repeated.
#: Buckets up to that size have all members as centres and are done.
SLOTS = (1024, 16384)


#: Members, and centres, of a block; the pairs of two blocks of a bucket are dealt together.
BLOCK = 512
#: Pairs of one document beyond which they are split, each part with its own copy of the document's set.
SPLIT = 4096
#: Parts of a bucket's rows where a join by bucket goes through a shuffle.
SALT = 16
#: Slices of the hash range; in each, two sets share at most the smaller of their counts.
SLICES = 64


@dataclass(frozen=True)
class NearDup:
    """Parameters: words of a shingle, threshold in percent, bins (a power of two)."""

    shingle: int = 5
    percent: int = 80
    bins: int = 128
    #: Most chance that a pair at the threshold shares no bucket.
    miss: float = 1e-6

    @property
    def rows(self) -> int:
        """Bins of a band: the most with which a pair at the threshold is missed less often than allowed."""
        s = self.percent / 100
        return max([r for r in range(1, 17) if (1 - s**r) ** (self.bins // r) <= self.miss], default=1)

    @property
    def bands(self) -> int:
        return self.bins // self.rows


def signatures(h: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signatures (rows x bins) of sorted sets; rows of empty sets are zero."""
    n = len(offsets) - 1
    out, filled = np.zeros((n, bins), dtype=np.uint64), np.zeros((n, bins), dtype=bool)
    if len(h):
        row = np.repeat(np.arange(n), np.diff(offsets))
        slot = row * bins + (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
        first = np.concatenate(([True], slot[1:] != slot[:-1]))  # sets are sorted, so the first of a bin is its least
        out.reshape(-1)[slot[first]], filled.reshape(-1)[slot[first]] = h[first], True
    ranks = tk.seeds(bins * bins, 7).reshape(bins, bins)
    for r in np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1)):
        empty, full = np.flatnonzero(~filled[r]), np.flatnonzero(filled[r])
        donor = full[ranks[np.ix_(empty, full)].argmin(axis=1)]
        out[r, empty] = out[r, donor]
    return out


def band_hashes(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit hash for each band, which also holds the band's number."""
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for j in range(rows):
        h = tk.mix(h + signature[:, j : rows * bands : rows] * np.uint64(0x9E3779B97F4A7C15))
    return h


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(_signed(values)))


def sign(docs: DataFrame, p: NearDup) -> DataFrame:
    """id, n (set size), h1 and h2 (a 128-bit hash of the set), bands; docs has id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column("text")):
                h, at = tk.shingle_sets(data, offsets, p.shingle)
                n, bands = np.diff(at), band_hashes(signatures(h, at, p.bins), p.rows, p.bands)
                wide = [np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(tk.mix(h ^ s)))) for s in tk.seeds(2, 3)]
                h1, h2 = (tk.mix(w[at[1:]] - w[at[:-1]] + n.astype(np.uint64)) for w in wide)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(n), pa.array(_signed(h1)), pa.array(_signed(h2)), _lists(bands.reshape(-1), np.arange(b - a + 1) * p.bands)],
                    names=["id", "n", "h1", "h2", "bands"],
                )

    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long, bands array<long>")


def sets(docs: DataFrame, p: NearDup) -> DataFrame:
    """id and set (distinct 64-bit shingle hashes); docs has id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column("text")):
                h, at = tk.shingle_sets(data, offsets, p.shingle)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), _lists(h, at)], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set array<long>")


def _small(df: DataFrame, bytes_a_row: int = ID_BYTES) -> DataFrame:
    """df, to be broadcast if its rows, which are counted, fit the bound."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df


def _reach(p: NearDup, common: Column, union: Column) -> Column:
    """Whether so many common elements of so many reach the threshold."""
    return 100 * common >= p.percent * union


def _in_several_groups(live: DataFrame) -> DataFrame:
    """Rows (bucket, root, ...) of the buckets with more than one root, with size, the rows of the bucket."""
    several = live.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("bucket", "size")
    several = materialise(several, "near-several")
    if several.count() * ID_BYTES <= BROADCAST_BYTES:
        return live.join(F.broadcast(several), "bucket")
    salted = live.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    return salted.join(several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["bucket", "salt"]).drop("salt")


def _block(of: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(seed)), blocks).cast("int")


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _sizes(full: DataFrame) -> DataFrame:
    """id, n (elements of its set), shared (those that another of these sets holds as well) and slices (shared, by slice of the hash)."""
    elements = full.select("id", F.explode("set").alias("element"))
    alone = elements.groupBy("element").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("holders")).where("holders = 1")
    part = F.pmod("element", F.lit(SLICES)).cast("int").alias("slice")
    marks = elements.select("id", part, F.lit(1).alias("k")).union(alone.select("id", part, F.lit(-1)))
    counts = marks.groupBy("id", "slice").agg(F.sum("k").cast("int").alias("k"))
    by_id = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slice", "k"))).alias("m"), F.sum("k").alias("shared"))
    slices = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    sizes = full.select("id", F.size("set").cast("long").alias("n"))
    return sizes.join(by_id, "id").select("id", "n", "shared", slices.alias("slices"))


def _confirmed(pairs: DataFrame, full: DataFrame, p: NearDup) -> DataFrame:
    """Those pairs (u, v) whose full sets reach the threshold."""
    # The pairs of a document with very many are split, and its set goes to each part.
    parts = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("u", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    parts = _small(materialise(parts, "near-parts"))
    dealt = pairs.join(parts, "u", "left").select("u", "v", _block(F.col("v"), F.coalesce("parts", F.lit(1)), 5).alias("part"))
    left = full.select(F.col("id").alias("u"), F.col("set").alias("a")).join(parts, "u", "left")
    left = left.select("u", "a", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    right = full.select(F.col("id").alias("v"), F.col("set").alias("b"))
    both = dealt.join(right, "v").join(left, ["u", "part"])
    na, nb = F.size("a"), F.size("b")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(_reach(p, F.least(na, nb), F.greatest(na, nb))).where(_reach(p, common, na + nb - common)).select("u", "v")


def near_dup(docs: DataFrame, p: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = materialise(sign(rows, p), "near-signatures")
    if not every.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # Rows share an id: they are numbered in its order, grouped by their numbers, and named by their ids again.
        named = in_order(rows.where("id IS NOT NULL"), F.asc("id"), "node")
        found = _groups(named.select(F.col("node").alias("id"), "text"), materialise(sign(named.select(F.col("node").alias("id"), "text"), p), "near-signatures"), p)
        names = named.select(F.col("node").alias("component_id"), F.col("id").alias("component"))
        found = found.join(named.select(F.col("node").alias("id"), F.col("id").alias("name")), "id").join(names, "component_id")
        nameless = every.where("id IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
        found = found.select(F.col("name").alias("id"), "n_shingles", F.col("component").alias("component_id")).unionByName(nameless)
    else:
        found = _groups(rows, every, p)
    return found.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _groups(rows: DataFrame, every: DataFrame, p: NearDup) -> DataFrame:
    """id, n_shingles, component_id of rows (id, text) with the signatures `every`; ids that are not null are distinct."""
    signed = every.where("id IS NOT NULL")

    # Equal sets: one representative, the smallest id, stands for all of them.
    classes = signed.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copied = materialise(classes.where("copies > 1").select("h1", "h2", "rep"), "near-copied")
    copies = materialise(signed.select("id", "h1", "h2").join(_small(copied, 64), ["h1", "h2"]).where("id <> rep").select("id", "rep"), "near-copies")

    # Buckets of two members or more, each with its smallest id as the centre of a star.
    reps = signed.where("n > 0").join(_small(copies), "id", "left_anti").select("id", F.explode("bands").alias("bucket"))
    stars = reps.groupBy("bucket").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    members = materialise(reps.join(stars, "bucket").distinct(), "near-buckets")
    candidates = materialise(members.select("id").distinct(), "near-candidates")
    full = materialise(sets(rows.join(_small(candidates), "id", "left_semi"), p), "near-sets")

    pairs = materialise(members.where("id <> centre").select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct(), "near-pairs")
    roots = components(materialise(_confirmed(pairs, full, p), "near-links"))
    rest, done = members.where("id <> centre").select("bucket", "id"), 0
    while True:
        # Buckets whose members, less the centres so far, are in several groups.
        live = rest.join(_small(roots.withColumnRenamed("node", "id")), "id", "left").withColumn("root", F.coalesce("root", "id"))
        live = materialise(_in_several_groups(live).drop("size"), "near-open")
        if live.isEmpty():
            break
        # What no other open set holds can't be shared, and bounds each set's similarity to any of them.
        ids = materialise(live.select("id").distinct(), "near-candidates")
        open_sets = full.join(_small(ids), "id", "left_semi")
        bands = signed.select("id", "bands").join(_small(ids), "id", "left_semi")
        sizes = materialise(_sizes(open_sets).join(bands, "id"), "near-sizes")
        live = materialise(_in_several_groups(live.join(_small(sizes.where(_reach(p, F.col("shared"), F.col("n"))).select("id")), "id")), "near-open")
        slots = SLOTS[min(done, len(SLOTS) - 1)]
        # In small buckets all members are centres. In others the least id of each slot is one, so map-side combine bounds what is kept.
        slot = F.pmod(F.xxhash64("id", F.lit(done)), F.lit(slots))
        dealt = live.where(F.col("size") > slots).groupBy("bucket", slot.alias("slot")).agg(F.min(F.struct("id", "root", "size")).alias("c"))
        centres = materialise(live.where(F.col("size") <= slots).unionByName(dealt.select("bucket", "c.*")), "near-centres")
        # Each member meets each block of centres, and each centre each block of members, once.
        of_members, of_centres = _blocks(F.col("size")), _blocks(F.least(F.col("size"), F.lit(slots)))
        every_block = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        facts = F.broadcast(sizes) if sizes.count() * (ID_BYTES + 8 * SLICES + 8 * p.bands) <= BROADCAST_BYTES else sizes
        m = live.join(facts, "id").select("*", _block(F.col("id"), of_members, 1).alias("mb"), every_block(of_centres).alias("cb"))
        c = centres.join(facts, "id").select("*", _block(F.col("id"), of_centres, 2).alias("cb"), every_block(of_members).alias("mb"))
        a, b = {k: F.col(f"m.{k}") for k in ("id", "root", "n", "shared")}, {k: F.col(f"c.{k}") for k in ("id", "root", "n", "shared")}
        union = F.greatest(a["shared"], b["shared"]) + (a["n"] - a["shared"]) + (b["n"] - b["shared"])
        possible = _reach(p, F.least(a["shared"], b["shared"]), union)
        common = F.aggregate(F.zip_with("m.slices", "c.slices", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        by_slices = _reach(p, common, a["n"] + b["n"] - common)
        once = F.when(F.col("m.size") <= slots, a["id"] > b["id"]).otherwise(a["id"] != b["id"])
        # A pair is dealt in the first of the buckets that it shares; there it stays until it is compared or in one group.
        here = F.array_intersect("m.bands", "c.bands")[0] == F.col("m.bucket")
        same = reduce(and_, [F.col(f"m.{k}") == F.col(f"c.{k}") for k in ("bucket", "mb", "cb")])
        met = m.alias("m").join(c.alias("c"), same & once & (a["root"] != b["root"]) & possible & here & by_slices)
        pairs = materialise(met.select(F.least(a["id"], b["id"]).alias("u"), F.greatest(a["id"], b["id"]).alias("v")).distinct(), "near-pairs")
        links = materialise(_confirmed(pairs, open_sets, p), "near-links")
        if not links.isEmpty():
            roots = components(links.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        # A centre has met every member of its bucket; small buckets are done.
        large = live.where(F.col("size") > slots).select("bucket", "id")
        if large.isEmpty():
            break
        rest = large.join(_small(centres.where(F.col("size") > slots).select("bucket", "id")), ["bucket", "id"], "left_anti")
        done += 1

    roots = _small(roots.withColumnRenamed("node", "rep"))
    joined = every.select("id", "n").join(_small(copies), "id", "left").withColumn("rep", F.coalesce("rep", "id")).join(roots, "rep", "left")
    return joined.select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: shingles of three words, similarity of 0.85 or more."""
    found = near_dup(table(spark, sf_dir, "documents"), NearDup(shingle=3, percent=85))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


#: All pairs by shared shingles; for small tables.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
sets AS (
  SELECT DISTINCT doc_id, [w[i], w[i + 1], w[i + 2]] AS g FROM places
  UNION ALL SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 2
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
walk AS (SELECT DISTINCT u AS node, u AS seen FROM both_ways UNION SELECT node, v FROM walk JOIN both_ways ON u = seen),
roots AS (SELECT node, min(seen) AS root FROM walk GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON node = d.doc_id
"""
