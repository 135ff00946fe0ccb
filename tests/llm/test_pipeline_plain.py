"""The pipeline against a plain version of its five stages, row by row in Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm import packing, quality, stages
from test_pipeline import sample

SPACE = r"[\x20\x09-\x0D]"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def failing(line):
    words = len(re.split(r"[ \t\x0B\f\r]+", line.strip(" ")))
    capitals, letters = sum(c.isupper() for c in line), sum(c.isalpha() for c in line)
    separators = len(re.findall(r" [|>»•·](?= )", line))
    return (
        len(re.findall(r"[#*$%&|<>]", line)) > 0.5 * words
        or (separators >= 2 and separators > 0.2 * words)
        or (bool(re.search(r"[A-ZÀ-ÖØ-Þ]{2}", line)) and letters >= 12 and capitals > 0.7 * letters)
        or any(p in line.lower() for p in quality.BOILERPLATE)
        or (words >= 40 and not re.search(r"[.!?…。！？:;,\"'”’)\]]", line))
    )


def by_quality(docs):
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        good = [x for x in lines if not failing(x)]
        chars = lambda s: len(re.findall(r"[^\x20\x09-\x0D]", s))
        if len(words) < 50 or 2 * len(repeated) > len(words) or chars("".join(good)) < 0.5 * chars(text):
            continue
        yield i, "\n".join(good) if len(good) < len(lines) else text, lang


def grams(text):
    """Hashed trigrams of each word of bytes."""
    out = []
    for word in re.findall(rb"[a-zA-Z\x80-\xff]+", text.lower().encode()):
        w = b"\0" + word + b"\0"
        out.append([((w[k] << 16 | w[k + 1] << 8 | w[k + 2]) * 2654435769 % (1 << 32)) >> 16 for k in range(len(word))])
    return out


def by_language(docs):
    docs = list(docs)
    counts = defaultdict(Counter)
    for i, text, lang in docs:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for word in grams(text):
                counts[lang].update(word)
    names = sorted(counts)
    total = [sum(counts[n].values()) + 0.1 * 65536 for n in names]
    for i, text, lang in docs:
        words = grams(text)
        if not words or not any(c.isalpha() for c in text):
            continue
        ll = np.array([[sum(math.log((counts[n][g] + 0.1) / t) for g in w) for n, t in zip(names, total)] for w in words])
        p = np.maximum(np.exp(ll - ll.max(axis=1, keepdims=True)), 1e-30)

        def em(chosen):
            pi = np.array([1.0 / len(chosen) if k in chosen else 0.0 for k in range(len(names))])
            for _ in range(12):
                r = p * pi
                pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            return pi, np.log((p * pi).sum(axis=1)).sum()

        full, _ = em(range(len(names)))
        order, penalty = np.argsort(-full, kind="stable"), 0.5 * math.log(len(words))
        alone = np.log(p).sum(axis=0)
        best, share = alone.max(), np.eye(len(names))[alone.argmax()]
        for size in range(2, len(names) + 1):
            pi, value = em(order[:size].tolist())
            if value - (size - 1) * penalty > best:
                best, share = value - (size - 1) * penalty, pi
        if share.max() >= stages.MAIN_SHARE:
            yield i, text, lang or names[int(share.argmax())]


def by_text(docs):
    last = {}
    for i, text, lang in docs:
        last[text] = max(last.get(text, (i, text, lang)), (i, text, lang), key=lambda d: d[0])
    return list(last.values())


def by_shingles(docs):
    docs = sorted(docs, key=lambda d: d[0])
    sets = []
    for _, text, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(A_Z))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [d for k, d in enumerate(docs) if find(k) == k]


def test_pipeline_is_the_plain_one(spark, tmp_path):
    sample(spark, tmp_path)
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    want = by_shingles(by_text(by_language(by_quality(docs))))
    tokenizer = Tokenizer.from_str(packing.tokenizer_text())
    ids = {i: [*tokenizer.encode(text, add_special_tokens=False).ids, 1] for i, text, _ in want}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(ids) and len(want) > 50
    of_doc, of_window = defaultdict(list), defaultdict(list)
    for r in pieces:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and len(own) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        of_doc[r["doc_id"]].append((r["start"], r["length"]))
        of_window[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in of_doc.items():  # each id once
        own.sort()
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == len(ids[i])
    for own in of_window.values():  # no gap, and no window too long
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
