r"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut into words: a run of the space mark with what follows it, and every
character by itself that no longer piece has. No piece reaches across words, so
equal words have equal ids. Each distinct word becomes a lattice: its substrings of
bounded length are exploded, joined to the piece table by equality, the edges are
grouped by word, and a fold over the groups picks the path. The models read here
rank their pieces by merges, so the fold takes the best-ranked edge that joins
two neighbours until none is left; where no piece covers a character, its bytes
stand for it.

`encode` runs this plan within each Arrow batch, with a memory of words: the same
explode, join, group and fold as arrays. `encode_words` is the plan in Spark SQL,
with a higher-order aggregate as the fold, for tables of distinct words. On
running text the latter would shuffle every occurrence of a word twice.

Defined results: a null text is empty; an empty text has no pieces; a literal space
mark decodes to a space, as with any such model; repeated rows give repeated
results; an empty table gives an empty result; only the id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import textkernels as tk
from strandline.llm.common import bounded_batches, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass(frozen=True)
class PieceTable:
    """Pieces by id with scores and kinds."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]

    @staticmethod
    def load(path: str | None = None) -> PieceTable:
        """Read a model file; by default the public one of 32k pieces."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only merge-ranked models without normalisation and with a leading space are read")
        return PieceTable([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


class Lattice:
    """Encodes and decodes with one piece table; words once encoded are remembered."""

    def __init__(self, t: PieceTable, remembered: int = 400_000):
        normal = [i for i, k in enumerate(t.kinds) if k == NORMAL]
        self.longest = max([len(t.pieces[i]) for i in normal], default=1)
        joined = _points("".join(t.pieces[i] for i in normal))
        stop = np.cumsum([len(t.pieces[i]) for i in normal])
        start = np.concatenate(([0], stop[:-1])).astype(np.int64)
        hashes = self._spans(joined, start, stop)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(normal)[order]
        self.score = np.array(t.scores)[self.ids]
        inner = [joined[a:b] for a, b in zip(start, stop) if b - a > 1]
        self.joining = np.unique(np.concatenate(inner)) if inner else np.zeros(0, dtype="<u4")
        self.bytes = np.zeros(256, dtype=np.int64)
        for i, k in enumerate(t.kinds):
            if k == BYTE:
                self.bytes[int(t.pieces[i][3:-1], 16)] = i
        self.text = [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode() for p, k in zip(t.pieces, t.kinds)]
        self.is_byte = np.array(t.kinds) == BYTE
        self.remembered = remembered
        self._forget()

    @staticmethod
    def _spans(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tk.value_span_hashes(tk.mix(points.astype(np.uint64) + np.uint64(1)), start, end)

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.start, self.n = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > self.remembered:
            self._forget()
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        points = _points("".join(marked))
        offsets = np.concatenate(([0], np.cumsum([len(m) for m in marked]))).astype(np.int64)
        if not len(points):
            return [np.zeros(0, dtype="<u4") for _ in texts]
        mark = points == ord(MARK)
        at = np.minimum(np.searchsorted(self.joining, points), max(len(self.joining) - 1, 0))
        lone = self.joining[at] != points if len(self.joining) else np.ones(len(points), dtype=bool)
        begins = lone.copy()
        begins[1:] |= lone[:-1] | (mark[1:] & ~mark[:-1])
        begins[offsets[:-1][offsets[:-1] < len(points)]] = True
        start = np.flatnonzero(begins)
        end = np.concatenate((start[1:], [len(points)]))
        hashes, first, which = np.unique(self._spans(points, start, end), return_index=True, return_inverse=True)
        hashes = hashes.tolist()
        found = list(map(self.known.get, hashes))
        new = [i for i, k in enumerate(found) if k is None]
        if new:
            a, b = start[first[new]], end[first[new]]
            n = b - a
            own = points[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            ids, counts = self._fold(own, n)
            for k, i in enumerate(new, len(self.n)):
                found[i] = self.known[hashes[i]] = k
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(counts) - counts))
            self.n, self.flat = np.concatenate((self.n, counts)), np.concatenate((self.flat, ids))
        k = np.array(found, dtype=np.int64)[which]
        n = self.n[k]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(self.start[k] - upto[:-1], n) + np.arange(upto[-1])]
        edges = upto[np.searchsorted(start, offsets)]
        return [ids[x:y] for x, y in zip(edges[:-1], edges[1:])]

    def _edges(self, points: np.ndarray, word: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece over each substring (start x length), -inf and -1 where there is none."""
        m = len(points)
        score, ids = np.full((m, self.longest), -np.inf), np.full((m, self.longest), -1, dtype=np.int64)
        for length in range(1, self.longest + 1):
            s = np.flatnonzero(np.arange(m) + length <= stop[word])
            if not len(s):
                break
            h = self._spans(points, s, s + length)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            score[s[hit], length - 1], ids[s[hit], length - 1] = self.score[at[hit]], self.ids[at[hit]]
        return score, ids

    def _fold(self, points: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that stand end to end, and the number of ids of each."""
        word = np.repeat(np.arange(len(n)), n)
        score, ids = self._edges(points, word, np.cumsum(n))
        start, length, own = np.arange(len(points)), np.ones(len(points), dtype=np.int64), word
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(start):
            joint = np.full(len(start), -np.inf)
            both = length[:-1] + length[1:]
            ok = np.flatnonzero((own[:-1] == own[1:]) & (both <= self.longest))
            joint[ok] = score[start[ok], both[ok] - 1]
            seg = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
            size = np.diff(np.concatenate((seg, [len(start)])))
            best = np.maximum.reduceat(joint, seg)
            open_ = best > -np.inf
            live = np.repeat(open_, size)
            ended.append((start[~live], length[~live]))
            # The leftmost of the best joints of each word.
            place = np.where(live & (joint == np.repeat(best, size)), np.arange(len(start)), len(start))
            left = np.minimum.reduceat(place, seg)[open_]
            length = length.copy()
            length[left] += length[left + 1]
            live[left + 1] = False
            start, length, own = start[live], length[live], own[live]
        start, length = (np.concatenate(x) for x in zip(*ended))
        order = np.argsort(start, kind="stable")
        start, length = start[order], length[order]
        piece = ids[start, length - 1]
        # A character without a piece becomes its bytes.
        lone = np.flatnonzero(piece < 0)
        spelled = [self.bytes[np.frombuffer(chr(points[start[i]]).encode("utf-8"), dtype=np.uint8)] for i in lone]
        counts = np.ones(len(piece), dtype=np.int64)
        counts[lone] = [len(x) for x in spelled]
        out = np.repeat(piece, counts)
        if len(lone):
            at = np.cumsum(counts) - counts
            for i, x in zip(lone, spelled):
                out[at[i] : at[i] + len(x)] = x
        return out.astype("<u4"), np.bincount(word[start], counts, len(n)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, t: PieceTable, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: id, ids (or null), n_pieces, n_byte_pieces, ids_crc32 (little-endian unsigned 32-bit), round_trip."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(t)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", "ids", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        for batch in batches:
            for a, b, _, _ in tk.chunks(batch.column("text")):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                found = lattice.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        pa.array([x.astype(np.int32) for x in found] if with_ids else [None] * len(found), pa.list_(pa.int32())),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([int(lattice.is_byte[x].sum()) for x in found], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()),
                        pa.array([lattice.decode(x) == text for x, text in zip(found, texts)], pa.bool_()),
                    ],
                    names=names,
                )

    return rows.mapInArrow(run, "id long, ids array<int>, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, t: PieceTable, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, text; null ids decode to the empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        for batch in batches:
            texts = [lattice.decode(np.array(x or [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")


def encode_words(words: DataFrame, t: PieceTable, word_col: str = "word") -> DataFrame:
    """The lattice in Spark SQL: word, ids for each distinct word (with its space marks); the piece table is broadcast, as the model bounds it."""
    spark = words.sparkSession
    longest = max(len(p) for p in t.pieces)
    normal = [(p, i, s) for i, (p, s, k) in enumerate(zip(t.pieces, t.scores, t.kinds)) if k == NORMAL]
    pieces = F.broadcast(spark.createDataFrame(normal, "piece string, id int, score double"))
    of_byte = F.create_map(*[F.lit(x) for i, (p, k) in enumerate(zip(t.pieces, t.kinds)) if k == BYTE for x in (p[3:-1], i)])
    distinct = words.select(F.col(word_col).alias("word")).where("word <> ''").distinct()
    starts = distinct.select("word", F.explode(F.expr("sequence(0, char_length(word) - 1)")).alias("at"))
    spans = starts.select("word", "at", F.explode(F.expr(f"sequence(1, least({longest}, char_length(word) - at))")).alias("n"))
    edges = spans.join(pieces, F.expr("substr(word, at + 1, n)") == F.col("piece"), "left").where("id IS NOT NULL OR n = 1")
    # Single characters stay without a piece, so that no word is lost.
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", "n", "score", "id"))).alias("edges"))
    # State: the ends of the pieces so far. A joint spans two neighbours: its start and end are ends with one end between.
    joints = (
        "filter(edges, e -> e.n > 1 AND array_position(ends, e.at) > 0 "
        "AND array_position(ends, e.at + e.n) = array_position(ends, e.at) + 2)"
    )
    best = f"array_max(transform({joints}, e -> named_struct('score', e.score, 'minus_at', -e.at, 'n', e.n)))"
    fold = (
        "aggregate(sequence(1, char_length(word)), sequence(0, char_length(word)), (ends, step) -> "
        f"coalesce(get(transform(filter(array({best}), b -> b IS NOT NULL), b -> filter(ends, x -> x <= -b.minus_at OR x >= -b.minus_at + b.n)), 0), ends))"
    )
    folded = grouped.select("word", "edges", F.expr(fold).alias("ends"))
    path = folded.select("word", F.posexplode(F.expr("transform(slice(ends, 1, size(ends) - 1), (x, i) -> named_struct('at', x, 'n', ends[i + 1] - x))")).alias("pos", "p"), "edges")
    chosen = path.select("word", "pos", "p", F.expr("filter(edges, e -> e.at = p.at AND e.n = p.n)[0].id").alias("id"))
    spelled = F.transform(F.expr("filter(split(hex(encode(substr(word, p.at + 1, p.n), 'UTF-8')), '(?<=\\\\G..)'), x -> x <> '')"), lambda b: F.element_at(of_byte, b))
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(spelled)
    ordered = chosen.select("word", F.struct("pos", ids.alias("ids")).alias("x")).groupBy("word").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return ordered.select("word", F.flatten(F.transform("xs", lambda x: x["ids"])).alias("ids"))


def op5_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return encode(table(spark, sf_dir, "documents"), PieceTable.load(), with_ids=False).withColumnRenamed("id", "doc_id").drop("ids")
