r"""Spelling variants: words that differ in one letter, each led to its most frequent form.

The words are sorted, and every prefix gets the number of its node in their trie; every suffix gets that of
its node in the trie of the reversed words. A word is then a row of pairs of integers: for each
position, (prefix node before it, suffix node after it) with the letter skipped, and (prefix node, suffix
node) with nothing between. Two skipped pairs are equal exactly if the words differ in that letter only; a skipped
pair of one word equals a plain pair of another exactly if the second lacks that letter. So one
equi-join on integers gives the neighbours, without comparing words. A pair of nodes has at most
one word for each letter of the alphabet, and one without, so no group of the join is large. Of equal neighbouring
letters only the first counts as left out, so no pair of words is found twice.

Nodes are numbered in the order of the words, within parts of their range: a word shares the nodes of
its common prefix with the word before it. Prefixes that reach over the edge of two parts are
numbered first, from the last word of one and the first of the other, so they have one number everywhere.

A word's form is its neighbour with the most occurrences (ties: the smallest in code-point order), if
that has `times` as many as the word. Forms are followed to their end by pointers that double
their reach; counts grow on the way, so there are no cycles and few rounds.

Defined results: a null or empty text has no words; a null id reads as the empty string in what is hashed; rows that are
repeated count as often as they stand; words of any length are numbered in full; an empty table gives
an empty result; no other column is read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, materialise, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Kinds of pairs: a letter skipped that equals the one before it, another letter skipped, nothing skipped.
AGAIN, SKIPPED, PLAIN = 0, 1, 2
_PART_BITS = 40


def damaged(doc_id: int | None, run: str) -> str:
    """The run, or what is left of it where its checksum asks for a slip: one code point less."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % 97 == 0 else run


def unchanged(doc_id: int | None, run: str) -> str:
    return run


def word_counts(docs: DataFrame, slip: Callable[[int | None, str], str] = unchanged, least_points: int = 5, least_n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters of the whole texts, A-Z lower-cased, after `slip`; counted by batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                own: Counter[str] = Counter()
                for word, n in Counter(RUN.findall(text)).items():
                    own[word.translate(_LOWER)] += n
                for word, n in own.items():
                    word = slip(doc_id, word)
                    if len(word) >= least_points:
                        total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def _edges(ends: list[tuple[int, str, str]]) -> dict[int, tuple[str, np.ndarray]]:
    """By part: the prefix that its first word shares with the last of the part before it, and the numbers of its nodes, all negative."""
    out: dict[int, tuple[str, np.ndarray]] = {}
    text, numbers, free = "", np.zeros(0, np.int64), -1
    for (_, _, last), (part, first, _) in zip(ends, ends[1:]):
        prefix = first[: _common(last, first)]
        known = _common(text, prefix)
        fresh = len(prefix) - known
        numbers = np.concatenate([numbers[:known], free - np.arange(fresh)])
        text, free = prefix, free - fresh
        out[part] = (text, numbers)
    return out


def trie_nodes(words: DataFrame, word: str) -> DataFrame:
    """Adds place (a number that grows with the word) and nodes (numbers of its prefixes, from the empty one, 0, to itself).

    Words are distinct. Two words have a number in common exactly where they have that prefix in common. What goes to the
    driver is the first and last word of each part.
    """
    spark = words.sparkSession
    sorted_parts = materialise(words.repartitionByRange(F.col(word)).withColumn("part", F.spark_partition_id()), "variants-parts")
    ends = sorted((r["part"], r["first"], r["last"]) for r in sorted_parts.groupBy("part").agg(F.min(word).alias("first"), F.max(word).alias("last")).collect())
    edges, following = _edges(ends), dict(zip([p for p, _, _ in ends], [p for p, _, _ in ends[1:]]))
    none = ("", np.zeros(0, np.int64))
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("nodes", pa.list_(pa.int64()))])
    names = [c for c in words.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, path, made, seen = -1, "", [0], 0, 0
        left = right = none
        for batch in batches:
            places, nodes = [], []
            for p, w in zip(batch.column("part").to_pylist(), batch.column(word).to_pylist()):
                if p != part:
                    part, before, path, made, seen = p, "", [0], 0, 0
                    left, right = edges.get(p, none), edges.get(following.get(p, -1), none)
                known = _common(before, w)
                del path[known + 1 :]
                for text, numbers in (left, right):
                    shared = _common(text, w)
                    path.extend(numbers[len(path) - 1 : shared].tolist())
                fresh = len(w) + 1 - len(path)
                base = ((part + 1) << _PART_BITS) + made
                path.extend(range(base, base + fresh))
                made += fresh
                before = w
                places.append((part << _PART_BITS) + seen)
                seen += 1
                nodes.append(path.copy())
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int64()), pa.array(nodes, schema.field("nodes").type)], [*names, "place", "nodes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema.fields)
    shuffled = sorted_parts.repartition(max(1, len(ends)), "part").sortWithinPartitions("part", word)
    return shuffled.mapInArrow(run, f"{kinds}, place long, nodes array<long>")


def neighbours(numbered: DataFrame) -> DataFrame:
    """word_no, near, near_n: each pair of words at distance one, in both directions, once.

    numbered: word_no, word, n, nodes (of the forward trie).
    """
    backward = trie_nodes(numbered.select("word_no", F.reverse("word").alias("reversed")), "reversed").select("word_no", F.col("nodes").alias("back"))
    letters, size = F.split("word", ""), F.size("nodes") - 1
    both = numbered.join(backward, "word_no").select("word_no", "n", "nodes", "back", letters.alias("letters"), size.alias("size"))
    again = lambda i: (i > 0) & (F.get("letters", i) == F.get("letters", i - 1))
    pair = lambda p, s, kind: F.struct(F.get("nodes", p).alias("p"), F.get("back", s).alias("s"), kind.cast("tinyint").alias("kind"))
    skipped = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: pair(i, F.col("size") - 1 - i, F.when(again(i), AGAIN).otherwise(SKIPPED)))
    plain = F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: pair(i, F.col("size") - i, F.lit(PLAIN)))
    pairs = materialise(both.select("word_no", "n", F.inline(F.concat(skipped, plain))), "variants-pairs")
    a, b = pairs.alias("a"), pairs.alias("b")
    replaced = (F.col("a.kind") != PLAIN) & (F.col("b.kind") != PLAIN)
    moved = F.col("a.kind") + F.col("b.kind") == SKIPPED + PLAIN
    met = (F.col("a.p") == F.col("b.p")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.word_no") != F.col("b.word_no")) & (replaced | moved)
    return a.join(b, met).select("a.word_no", F.col("b.word_no").alias("near"), F.col("b.n").alias("near_n"))


def _ends(forms: DataFrame) -> DataFrame:
    """word_no, root: the last form that is reached from each word of forms (word_no, form_no)."""
    step = materialise(forms.select("word_no", F.col("form_no").alias("root")), "variants-forms")
    while True:
        on = step.select(F.col("word_no").alias("root"), F.col("root").alias("further"))
        moved = materialise(step.join(on, "root", "left").select("word_no", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        step = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return step


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words with their counts (word, n)."""
    numbered = trie_nodes(words.select("word", "n"), "word")
    numbered = materialise(numbered.select(F.col("place").alias("word_no"), "word", "n", "nodes"), "variants-words")
    # Numbers grow with the words, so the smallest word of equal counts has the smallest number.
    best = F.max(F.struct("near_n", (-F.col("near")).alias("back")))
    near = neighbours(numbered).groupBy("word_no").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    names = numbered.select("word_no", "word", "n")
    near = materialise(near.select("word_no", "n_near", F.col("b.near_n").alias("near_n"), (-F.col("b.back")).alias("near")).join(names, "word_no"), "variants-near")
    near = near.withColumn("form_no", F.when(F.col("near_n") >= times * F.col("n"), F.col("near")))
    forms = near.where("form_no IS NOT NULL").select("word_no", "form_no", F.col("near_n").alias("form_n"))
    ends = forms.join(_ends(forms), "word_no")
    named = ends.join(names.select(F.col("word_no").alias("form_no"), F.col("word").alias("form")), "form_no")
    named = named.join(names.select(F.col("word_no").alias("root"), F.col("word").alias("root_word")), "root").select("word_no", "form", "form_n", F.col("root_word").alias("root"))
    out = names.join(near.select("word_no", "n_near"), "word_no", "left").join(named, "word_no", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the words of documents, some of which get a slip by their checksum."""
    return variants(word_counts(table(spark, sf_dir, "documents"), damaged))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: crc32 is folded byte by byte over all runs at once; neighbours are found by the strings around a position.
OP13_SQL = f"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tbl AS MATERIALIZED (SELECT i, c FROM bits WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{_UP}', '{_LOW}') AS run FROM documents) GROUP BY ALL),
keyed AS MATERIALIZED (SELECT row_number() OVER () AS k, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs),
crc(k, pos, c) AS (
  SELECT k, 0, 4294967295 FROM keyed UNION ALL
  SELECT s.k, s.pos + 1, xor(s.c >> 8, t.c) FROM crc s JOIN keyed r USING (k) JOIN tbl t ON t.i = xor(s.c, ('0x' || substr(r.hx, 2 * s.pos + 1, 2))::BIGINT) & 255 WHERE 2 * s.pos < length(r.hx)),
hashed AS (SELECT run, n, xor(max_by(c, pos), 4294967295) AS h FROM crc JOIN keyed USING (k) GROUP BY k, run, n),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM cut x JOIN words y ON x.a || x.b = y.word),
best AS MATERIALIZED (SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) = 1),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk(word, here, step) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, max_by(here, step) AS root FROM walk GROUP BY word) r USING (word)
"""
