"""Language proportions of each document by expectation-maximisation.

A language is a smoothed distribution over byte trigrams inside words, learned
from labelled rows. A document is a mixture: each word comes from one of its
languages, with the likelihood of the word's trigrams. Expectation-maximisation
finds the proportions. Sets of languages are compared by their likelihood less half the
logarithm of the number of words for each language beyond the first; tried are the best single language and the
sets of the largest shares under all languages. The prediction is the language with the largest share.

Defined results: `und` with score 0 where the text is null, empty or has no
letter; a tie goes to the language whose name sorts first; repeated rows give
repeated results; an empty table gives an empty result; without labelled rows
every text is `und`. Whole texts are read; the longest go through in pieces that end
between words, and their distinct words are fitted with their counts. Any number of languages can be learned: scores of very many are
kept sparse, and words are fitted in blocks of bounded size. held_out is null for a row without an id. Only the id and text columns take part in a prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import textkernels as tk
from strandline.llm.common import bounded_batches, materialise, table

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParameters:
    #: Labelled rows of each language to learn from, in expectation; all of a language that has fewer.
    rows_per_language: int = 4000
    #: Trigrams are hashed to this number of bits.
    bits: int = 16
    #: Count added to every trigram of every language.
    smoothing: float = 0.1
    #: Steps of expectation-maximisation.
    steps: int = 12
    #: Least likelihood of a word in one language relative to its best.
    floor: float = 1e-30


#: Cells (words x languages) that are held at once, and bytes of a model up to which it is kept as a full matrix.
CELLS, DENSE_BYTES = 1 << 22, 64 << 20

#: ASCII letters and every byte of a character beyond ASCII.
NOT_WORD = np.array([not (chr(b).isalpha() and b < 128 or b >= 128) for b in range(256)])


def trigrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram around each byte of a word, index of each word's first, and row of each word."""
    start, end, row = tk.words(data, offsets, NOT_WORD)
    inside = ~NOT_WORD[data]
    before, after = np.zeros(len(data), dtype=np.uint32), np.zeros(len(data), dtype=np.uint32)
    before[1:], after[:-1] = data[:-1], data[1:]
    before[start], after[end - 1] = 0, 0
    gram = (before << np.uint32(16) | data.astype(np.uint32) << np.uint32(8) | after)[inside]
    gram = (gram * np.uint32(2654435769)) >> np.uint32(32 - bits)
    return gram.astype(np.int64), np.concatenate(([0], np.cumsum(end - start)))[:-1], row


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ends of pieces of about a chunk that end between words; a longer word stays whole."""
    a = 0
    while a < len(data):
        b = min(a + tk.CHUNK_BYTES, len(data))
        if b < len(data):
            gap = np.flatnonzero(NOT_WORD[data[b : b + 4096]])
            while not len(gap) and b < len(data):
                b += 4096
                gap = np.flatnonzero(NOT_WORD[data[b : b + 4096]])
            b = min(b + int(gap[0]), len(data)) if len(gap) else len(data)
        yield a, b
        a = b


@dataclass(frozen=True)
class SparseScores:
    """Log probabilities (trigrams x languages) of which most are those of a trigram never seen: these by language, the differences of others by trigram."""

    unseen: np.ndarray
    ends: np.ndarray
    langs: np.ndarray
    above: np.ndarray

    @classmethod
    def of(cls, gram: np.ndarray, lang: np.ndarray, n: np.ndarray, size: int, n_langs: int, smoothing: float) -> SparseScores:
        order = np.argsort(gram, kind="stable")
        gram, lang, n = gram[order], lang[order], n[order]
        total = np.bincount(lang, weights=n, minlength=n_langs) + smoothing * size
        return cls(np.log(smoothing / total), np.concatenate(([0], np.cumsum(np.bincount(gram, minlength=size)))), lang.astype(np.int32), np.log((n + smoothing) / smoothing).astype(np.float32))

    def matrix(self) -> np.ndarray:
        out = np.repeat(self.unseen[None, :], len(self.ends) - 1, axis=0)
        out[np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends)), self.langs] += self.above
        return out.astype(np.float32)

    def words(self, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums over the trigrams of each word (words x languages)."""
        k, size = len(self.unseen), np.diff(np.append(first, len(gram)))
        start, n = self.ends[gram], self.ends[gram + 1] - self.ends[gram]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(start, n) + inner
        word = np.repeat(np.repeat(np.arange(len(first)), size), n)
        added = np.bincount(word * k + self.langs[entry], weights=self.above[entry], minlength=len(first) * k)
        return added.reshape(len(first), k) + size[:, None] * self.unseen


@dataclass(frozen=True)
class LanguageModel:
    """Names of the languages and log probabilities (trigrams x languages), as a matrix or, for very many languages, sparse."""

    names: list[str]
    logp: np.ndarray | SparseScores
    p: LanguageParameters

    def word_p(self, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Likelihood of each word (gram[first[i]:first[i + 1]]) in each language, relative to its best."""
        ll = self.logp.words(gram, first) if isinstance(self.logp, SparseScores) else np.add.reduceat(self.logp[gram], first, axis=0, dtype=np.float64)
        ll -= ll.max(axis=1, keepdims=True)
        return np.maximum(np.exp(ll), self.p.floor)

    def mixtures(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (rows x languages, zero outside the chosen set) and number of words of each row.

        Rows are taken together up to a chunk of bytes and CELLS cells; a row beyond these is read in pieces.
        """
        n_rows, k = len(offsets) - 1, len(self.names)
        share, count = np.zeros((n_rows, k)), np.zeros(n_rows, dtype=np.int64)
        open_ = [(0, n_rows)] if n_rows else []
        while open_:
            lo, hi = open_.pop()
            a, b = int(offsets[lo]), int(offsets[hi])
            if b - a <= tk.CHUNK_BYTES:
                gram, first, row = trigrams(data[a:b], offsets[lo : hi + 1] - a, self.p.bits)
                if len(row) * k <= CELLS:
                    count[lo:hi] = np.bincount(row, minlength=hi - lo)
                    rows = lo + np.flatnonzero(count[lo:hi])
                    if len(rows) and k:
                        share[rows] = _choose(self.word_p(gram, first), count[rows], self.p.steps)
                    continue
            if hi - lo > 1:
                middle = min(max(int(np.searchsorted(offsets, (a + b) // 2)), lo + 1), hi - 1)
                open_ += [(lo, middle), (middle, hi)]
            else:
                count[lo], found = self._long(data[a:b])
                if found is not None:
                    share[lo] = found
        return share, count

    def _long(self, data: np.ndarray) -> tuple[int, np.ndarray | None]:
        """Number of words and proportions of one long text: its distinct words with their counts, in blocks."""
        hashes, sizes, counts, grams = [], [], [], []
        for a, b in pieces(data):
            gram, first, _ = trigrams(data[a:b], np.array([0, b - a]), self.p.bits)
            if not len(first):
                continue
            size = np.diff(np.append(first, len(gram)))
            place = np.arange(len(gram)) - np.repeat(first, size)
            h = np.add.reduceat(tk.mix((gram.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1)), first)
            h, at, n = np.unique(h, return_index=True, return_counts=True)
            hashes.append(h), sizes.append(size[at]), counts.append(n)
            grams.append(gram[np.repeat(first[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum())].astype(np.int32))
        if not hashes or not self.names:
            return int(sum(n.sum() for n in counts)), None
        _, at, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        weight = np.bincount(back, weights=np.concatenate(counts))
        size, gram = np.concatenate(sizes), np.concatenate(grams)
        start = np.cumsum(size) - size
        step = max(1, CELLS // len(self.names))

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i in range(0, len(at), step):
                own = at[i : i + step]
                first = np.cumsum(size[own]) - size[own]
                yield self.word_p(gram[np.repeat(start[own] - first, size[own]) + np.arange(size[own].sum())].astype(np.int64), first), weight[i : i + step]

        held = list(blocks()) if len(at) <= 2 * step else None
        return int(weight.sum()), _choose_long((lambda: iter(held)) if held else blocks, weight.sum(), len(self.names), self.p.steps)


def _choose_long(blocks: Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]], total: float, k: int, steps: int) -> np.ndarray:
    """What _choose does, for one text whose words come in blocks (likelihoods, weights)."""

    def maximise(allowed: np.ndarray) -> tuple[np.ndarray, float]:
        share = allowed / allowed.sum()
        for _ in range(steps):
            new = np.zeros(k)
            for word_p, weight in blocks():
                part = word_p * share
                new += (part * (weight / part.sum(axis=1))[:, None]).sum(axis=0)
            share = new / total
        return share, sum(float(weight @ np.log(np.maximum(word_p @ share, 1e-300))) for word_p, weight in blocks())

    alone = sum(weight @ np.log(word_p) for word_p, weight in blocks())
    best, out, penalty = alone.max(), np.zeros(k), 0.5 * np.log(total)
    out[alone.argmax()] = 1
    share, full = maximise(np.ones(k))
    order = np.argsort(-share, kind="stable")
    for size in range(2, k + 1):
        if full - penalty * (size - 1) <= best:
            break
        allowed = np.zeros(k)
        allowed[order[:size]] = 1
        part, ll = maximise(allowed)
        if ll - (size - 1) * penalty > best:
            best, out = ll - (size - 1) * penalty, part
    return out


def _maximise(word_p: np.ndarray, count: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of documents whose words stand end to end."""
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        part = word_p * np.repeat(share, count, axis=0)
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / count[:, None]
    likely = (word_p * np.repeat(share, count, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(likely, 1e-300)), first)


def _choose(word_p: np.ndarray, count: np.ndarray, steps: int) -> np.ndarray:
    """Proportions under the set of languages with the best penalised likelihood, of the sets that the full mixture's largest shares make."""
    n, k = len(count), word_p.shape[1]
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    alone = np.add.reduceat(np.log(word_p), first, axis=0)
    share, full = _maximise(word_p, count, np.ones((n, k)), steps)
    best = alone.max(axis=1)
    out = np.zeros((n, k))
    out[np.arange(n), alone.argmax(axis=1)] = 1
    penalty = 0.5 * np.log(count)
    # No set does better than all languages together, so most documents end here with one, and the rest once no larger set can win.
    order = np.argsort(-share, axis=1, kind="stable")
    for size in range(2, k + 1):
        mixed = np.flatnonzero(full - (size - 1) * penalty > best)
        if not len(mixed):
            break
        words = np.repeat(np.isin(np.arange(n), mixed), count)
        allowed = np.zeros((len(mixed), k))
        np.put_along_axis(allowed, order[mixed][:, :size], 1, axis=1)
        part, ll = _maximise(word_p[words], count[mixed], allowed, steps)
        better = ll - (size - 1) * penalty[mixed] > best[mixed]
        best[mixed[better]] = (ll - (size - 1) * penalty[mixed])[better]
        out[mixed[better]] = part[better]
    return out


def learn(labelled: DataFrame, p: LanguageParameters = LanguageParameters()) -> LanguageModel:
    """Learn from columns id, text, lang; rows without text or label are left out.

    rows_per_language bounds the sample; which rows are in it depends on their
    ids and texts alone, so that rows that share an id do not share a draw. Counts are summed by the cluster; at most 2 ** bits rows for each
    language reach the driver, and of a language with few rows only the trigrams that these have. There is no bound on languages.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "language-sizes")
    names = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not names:
        return LanguageModel(names, np.zeros((1 << p.bits, 0), dtype=np.float32), p)
    million = 1_000_000
    limits = sizes.select("lang", F.least(F.lit(million), F.ceil(F.lit(million * p.rows_per_language) / F.col("rows"))).alias("limit"))
    sample = rows.join(limits, "lang").where(F.pmod(F.xxhash64("id", "text", F.lit(20)), F.lit(million)) < F.col("limit"))
    bits = p.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column("lang").dictionary_encode()
            langs, code = np.array(named.dictionary.to_pylist(), dtype=object), named.indices.to_numpy().astype(np.int64)
            for a, b, data, offsets in tk.chunks(batch.column("text")):
                gram, first, row = trigrams(data, offsets, bits)
                of_gram = np.repeat(row, np.diff(np.concatenate((first, [len(gram)]))))
                pair, n = np.unique((code[a:b][of_gram] << bits) + gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs[pair >> bits], pa.string()), pa.array(pair & ((1 << bits) - 1)), pa.array(n)], names=["lang", "gram", "n"])

    counted = (
        sample.select(F.lower("text").alias("text"), "lang")
        .mapInArrow(run, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    got = counted.toArrow()
    at = {name: i for i, name in enumerate(names)}
    lang = np.array([at[x] for x in got.column("lang").to_pylist()], dtype=np.int64)
    scores = SparseScores.of(got.column("gram").to_numpy(), lang, got.column("n").to_numpy(), 1 << bits, len(names), p.smoothing)
    return LanguageModel(names, scores.matrix() if (len(names) << bits) * 4 <= DENSE_BYTES else scores, p)


def _few_rows(chunks: Iterator[tuple], most: int) -> Iterator[tuple]:
    """The chunks in parts of at most so many rows."""
    for a, b, data, offsets in chunks:
        for i in range(0, b - a, most):
            j = min(i + most, b - a)
            yield a + i, a + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


_PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.StringType())]


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (its share), mixture (name:share, largest first)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text).alias("text"), text.rlike(r"\p{L}").alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.names, UNDETERMINED], dtype=object)
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in _few_rows(tk.chunks(batch.column("text")), max(1, CELLS // max(1, len(model.names)))):
                share, count = model.mixtures(data, offsets)
                known = (share.sum(axis=1) > 0) & letters[a:b]
                best = np.where(known, share.argmax(axis=1) if share.shape[1] else 0, len(names) - 1)
                score = np.where(known, share.max(axis=1, initial=0.0), 0.0)
                mixture = [
                    ",".join(f"{names[j]}:{s[j]:.3f}" for j in np.argsort(-s, kind="stable") if s[j] >= 0.0005) if ok else None
                    for s, ok in zip(share, known)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(mixture, pa.string())],
                    names=["id", "lang_pred", "score", "mixture"],
                )

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *_PREDICTED])
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = predict(docs, model)
    return found.select(
        F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score", "mixture"
    )
