r"""Packing documents into windows of tokens by order-preserving dynamic programming.

The documents of an input split form one stream of tokens. Cuts may fall at ends
of documents (free), at ends of sentences (a small penalty) and, where a text
has no such ends, at fixed distances (a larger penalty). The cost of a window
is a fixed cost, so that short ones are not free, its padding, and the penalty of the
cut that ends it, and the cheapest cuts are found exactly: with f(j) the least cost
up to cut j at stream position x(j),

    f(j) = fixed + penalty(j) + min over i with x(j) - x(i) <= window of f(i) + padding(x(j) - x(i))

As padding is window - length, the minimum is over f(i) + x(i), kept in a
monotone queue, so each cut enters and leaves it once. Windows whose length is
a power of two need no padding and are tried besides.

A split is packed in blocks; the last window of a block is given up again and
starts the next block. So memory is bounded by a block and one document (its ids,
4 bytes each, and its cuts, some 100 bytes for each sentence), and no row is shuffled.

Defined results: a null text is empty; an empty text has the end id alone; ties
between cuts go to the earlier start; repeated rows are packed like any others;
an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import textkernels as tk
from strandline.llm.common import bounded_batches, table

DOCUMENT, SENTENCE, ANYWHERE = 0, 1, 2
CUTS = ("document", "sentence", "anywhere")


@dataclass(frozen=True)
class Packing:
    window: int = 2048
    end_id: int = 1
    #: Penalty, in tokens, of a cut of each kind.
    penalty: tuple[int, int, int] = (0, 8, 48)
    #: Cost, in tokens, of each window.
    window_cost: int = 64
    #: Tokens without an end of document or sentence after which a cut is offered anyway.
    stride: int = 128
    #: Windows of a block.
    block: int = 128
    #: Words whose ids a worker remembers; beyond it, it starts anew.
    remembered: int = 400_000


SPACE, LETTER, NUMBER, OTHER = range(4)
#: Code points up to which classes come from a table; texts beyond go through the tokenizer whole.
TABLE_END = 0x250


def _classes() -> np.ndarray:
    """Class of each code point of the table: white space, letter, number, anything else."""
    spaces = {*range(9, 14), 32, 0x85, 0xA0}
    of = {"L": LETTER, "N": NUMBER}
    return np.array([SPACE if c in spaces else of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(TABLE_END)], dtype=np.uint8)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of texts under a byte-level BPE of words that lower-cases and drops white space.

    Before its merges such a tokenizer cuts a text into contractions, runs of
    letters, single numbers and runs of anything else, and the merges never
    reach across. So a text's ids are those of its parts, and a part is
    merged once and then remembered by its 64-bit hash. Texts with characters
    beyond the table, or with the mark of a special token, go through the
    tokenizer whole.
    """

    def __init__(self, tokenizer_json: str, remembered: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_str(tokenizer_json)
        self.parts = Tokenizer.from_str(tokenizer_json)
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        names = sorted(self.whole.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.ends_part, self.ends_sentence = np.zeros((2, names[-1][1] + 1), dtype=bool)
        for name, i in names:
            self.ends_part[i] = name.endswith("</w>")
            self.ends_sentence[i] = name.endswith((".</w>", "!</w>", "?</w>"))
        classes = _classes()
        self.one = np.where(np.arange(256) < 128, np.resize(classes[:128], 256), OTHER).astype(np.uint8)
        leads, more = np.meshgrid(np.arange(0xC2, 0xCA), np.arange(0x80, 0xC0), indexing="ij")
        points = (leads - 0xC0) * 64 + more - 0x80
        self.two = np.where(points < TABLE_END, classes[np.minimum(points, TABLE_END - 1)], OTHER).astype(np.uint8)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.start, self.n = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        quick, lowered = [], []
        for i, t in enumerate(texts):
            if _BEYOND.search(t):
                out[i] = np.array(self.whole.encode(t.decode(), add_special_tokens=False).ids, dtype="<u4")
            else:
                low = t.decode().lower().encode()
                if _BEYOND.search(low):
                    out[i] = np.array(self.whole.encode(t.decode(), add_special_tokens=False).ids, dtype="<u4")
                else:
                    quick.append(i)
                    lowered.append(low)
        for i, ids in zip(quick, self._quick(lowered)):
            out[i] = ids
        return out

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each part of lower-cased texts that stand end to end."""
        kind = self.one[data]
        lead = np.flatnonzero(data >= 0xC2)
        kind[lead] = kind[lead + 1] = self.two[data[lead] - 0xC2, data[lead + 1] - 0x80]
        inside, edge = kind != SPACE, np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        starts = np.ones(len(data), dtype=bool)
        starts[1:] = (kind[1:] != kind[:-1]) | edge[1:-1] | (kind[1:] == NUMBER)
        starts &= inside & ((data & 0xC0) != 0x80)
        # 's 't 'm 'd 're 've 'll at the start of a run of other characters
        q = np.flatnonzero(starts & (data == 0x27))
        if len(q):
            padded, far = np.concatenate((data, np.zeros(3, dtype=np.uint8))), np.concatenate((edge, np.ones(3, dtype=bool)))
            a, b = np.where(far[q + 1], 0, padded[q + 1]), np.where(far[q + 1] | far[q + 2], 0, padded[q + 2])
            short = np.isin(a, list(b"stmd"))
            long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for which, size in ((short, 1), (long, 2)):
                at = q[which]
                starts[at + 1] = False
                after = at + 1 + size
                after = after[after < len(data)]
                starts[after] |= (kind[after] == LETTER) & ~edge[after]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | starts[1:] | edge[1:-1]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def _quick(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.known) > self.remembered:
            self._forget()
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        start, end = self.cut(data, offsets)
        hashes, first, which = np.unique(tk.span_hashes(data, start, end), return_index=True, return_inverse=True)
        hashes = hashes.tolist()
        found = list(map(self.known.get, hashes))
        new = [i for i, k in enumerate(found) if k is None]
        if new:
            raw = data.tobytes()
            parts = [raw[a:b].decode("latin-1").translate(self.letters) for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            joined = [" ".join(parts[i : i + 1000]) for i in range(0, len(parts), 1000)]
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.parts.encode_batch_fast(joined, add_special_tokens=False)])
            stop = np.flatnonzero(self.ends_part[ids]) + 1
            n = np.diff(stop, prepend=0)
            for k, i in enumerate(new, len(self.n)):
                found[i] = self.known[hashes[i]] = k
            self.start, self.n = np.concatenate((self.start, stop - n + len(self.flat))), np.concatenate((self.n, n))
            self.flat = np.concatenate((self.flat, ids))
        k = np.array(found, dtype=np.int64)[which]
        n = self.n[k]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(self.start[k] - upto[:-1], n) + np.arange(upto[-1])]
        edges = upto[np.searchsorted(start, offsets)]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]


#: A character beyond the table, or the mark of a special token.
_BEYOND = re.compile(rb"[\xCA-\xFF]|\xC9[\x90-\xBF]|<\|")


def cut_places(n: int, sentence_ends: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of cuts inside and at the end of a document of n tokens."""
    inner = np.unique(sentence_ends[(sentence_ends > 0) & (sentence_ends < n)])
    edges = np.concatenate(([0], inner, [n]))
    extra = [np.arange(a + stride, b, stride) for a, b in zip(edges[:-1], edges[1:]) if b - a > stride]
    if extra:
        more = np.concatenate(extra)
        at = np.concatenate((inner, more))
        kind = np.concatenate((np.full(len(inner), SENTENCE), np.full(len(more), ANYWHERE)))
        order = np.argsort(at, kind="stable")
        at, kind = at[order], kind[order]
    else:
        at, kind = inner, np.full(len(inner), SENTENCE)
    return np.concatenate((at, [n])), np.concatenate((kind, [DOCUMENT]))


def best_cuts(place: list[int], penalty: list[int], window: int) -> list[int]:
    """Indexes of the cuts that end the cheapest windows; place[0] is the start and neighbours are at most a window apart."""
    n = len(place)
    cost, came = [0] * n, [0] * n
    at = {x: i for i, x in enumerate(place)}
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    queue = deque([0])
    shifted = [0] * n  # cost + place
    shifted[0] = place[0]
    for j in range(1, n):
        x = place[j]
        while x - place[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        best = shifted[i] + window - x
        for length in powers:
            k = at.get(x - length)
            if k is not None and (cost[k] < best or cost[k] == best and k < i):
                best, i = cost[k], k
        cost[j], came[j] = best + penalty[j], i
        shifted[j] = cost[j] + x
        while queue and shifted[queue[-1]] > shifted[j]:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents; pieces come out as soon as their window is decided."""

    def __init__(self, p: Packing, first_sequence: int):
        self.p, self.sequence = p, first_sequence
        self.docs: deque = deque()  # id, ids, stream position of the first
        self.place, self.kind = [0], [DOCUMENT]
        self.length, self.begun = 0, 0

    def add(self, doc_id: int, ids: np.ndarray, sentence_ends: np.ndarray) -> Iterator[tuple]:
        places, kinds = cut_places(len(ids), sentence_ends, min(self.p.stride, self.p.window))
        self.docs.append((doc_id, ids, self.length))
        self.place.extend((places + self.length).tolist())
        self.kind.extend(kinds.tolist())
        self.length += len(ids)
        if self.length - self.begun > self.p.block * self.p.window:
            yield from self._flush(last=False)

    def finish(self) -> Iterator[tuple]:
        """Pack what is left; every place near the end is offered, so that the tail can fall into powers of two."""
        if self.length > self.begun:
            have = dict(zip(self.place, self.kind))
            for x in range(max(self.begun, self.length - self.p.window) + 1, self.length):
                have.setdefault(x, ANYWHERE)
            self.place = sorted(have)
            self.kind = [have[x] for x in self.place]
            yield from self._flush(last=True)

    def _flush(self, last: bool) -> Iterator[tuple]:
        cuts = best_cuts(self.place, [self.p.window_cost + self.p.penalty[k] for k in self.kind], self.p.window)
        if not last:
            cuts = cuts[:-1]
        for j in cuts:
            yield from self._pieces(self.begun, self.place[j], CUTS[self.kind[j]])
            self.begun = self.place[j]
        if cuts:
            self.place, self.kind = self.place[cuts[-1] :], self.kind[cuts[-1] :]

    def _pieces(self, a: int, b: int, cut: str) -> Iterator[tuple]:
        offset = 0
        while offset < b - a:
            doc_id, ids, at = self.docs[0]
            start = a + offset - at
            stop = min(len(ids), b - at)
            piece = ids[start:stop]
            yield doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), self.sequence, offset, cut
            offset += len(piece)
            if stop == len(ids):
                self.docs.popleft()
        self.sequence += 1


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cut", pa.string())]
)


def pack(docs: DataFrame, tokenizer_json: str, p: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cut (kind of the cut that ends the window)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(tokenizer_json)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), _SCHEMA)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(sent.value, p.remembered)
        packer = Packer(p, TaskContext.get().partitionId() << 40)
        end = np.array([p.end_id], dtype="<u4")
        for batch in batches:
            ids_of, texts, size = [], [], 0
            names, column = batch.column("id").to_pylist(), batch.column("text")
            pieces: list[tuple] = []
            for i, name in enumerate(names):
                ids_of.append(name)
                texts.append(column[i].as_py())
                size += len(texts[-1])
                if size >= tk.CHUNK_BYTES or i == len(names) - 1:
                    for doc_id, ids in zip(ids_of, words.encode(texts)):
                        pieces.extend(packer.add(doc_id, np.concatenate((ids, end)), np.flatnonzero(words.ends_sentence[ids]) + 1))
                    ids_of, texts, size = [], [], 0
            if pieces:
                yield batch_of(pieces)
        pieces = list(packer.finish())
        if pieces:
            yield batch_of(pieces)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut string")


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer's file, read on the driver and sent with the job; by default the public word-level BPE of 49k ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op10_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in windows of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_text())
