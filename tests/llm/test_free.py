"""The operators with array kernels: language, near-dup, pieces, WARC, URLs, packing."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import components, language, near_dup, packing, pieces, urls, warc

ODD = ["", None, " ", "\n\n", "12 34 !!", "a", "a b", "x" * 5000, "one two three " * 300, "İstanbul ß é 日本語"]


def docs_of(spark, texts, **more):
    rows = [(i, t, "x", 3.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, bands string, score double")


# --- language ---

SYLLABLES = {"aa": ["th", "er", "ing", "on"], "bb": ["sch", "ei", "ung", "ö"], "cc": ["que", "eau", "ment", "é"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_mixtures(spark):
    rng = random.Random(5)
    train = [(i, sentence(rng, lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)] + [(90, None, "aa"), (91, "x", None)]
    model = language.learn(spark.createDataFrame(train, "id long, text string, lang string"))
    assert model.names == ["aa", "bb", "cc"]
    texts = [sentence(rng, lang, 30) for lang in ("aa", "bb", "cc")] + [sentence(rng, "aa", 70) + " " + sentence(rng, "cc", 30)]
    rows = sorted(language.predict(docs_of(spark, [*texts, *ODD]), model).collect())
    assert [r["lang_pred"] for r in rows[:4]] == ["aa", "bb", "cc", "aa"]
    assert all(r["score"] > 0.99 for r in rows[:3]) and 0.6 < rows[3]["score"] < 0.8 and "cc:" in rows[3]["mixture"]
    for r, t in zip(rows[4:], ODD):
        assert (r["lang_pred"] == "und") == (not t or not re.search(r"[^\W\d_]", t)) and 0 <= r["score"] <= 1
    assert language.predict(docs_of(spark, ODD).limit(0), model).count() == 0
    none = language.learn(spark.createDataFrame([], "id long, text string, lang string"))
    assert {r["lang_pred"] for r in language.predict(docs_of(spark, ["abc"]), none).collect()} == {"und"}


def test_language_choice_is_brute_force():
    """Sets of languages by penalised likelihood, over all sets, where the best sets are nested as those tried are."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    for _ in range(20):
        count, mix = int(rng.integers(30, 120)), rng.dirichlet([0.5, 0.5, 0.5])
        word_p = np.maximum(np.eye(3)[rng.choice(3, count, p=mix)], 1e-6) * rng.uniform(0.5, 1, (count, 1))

        def em(langs):
            pi = np.zeros(3)
            pi[list(langs)] = 1 / len(langs)
            for _ in range(12 if len(langs) > 1 else 0):
                r = word_p * pi
                pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            return np.log((word_p * pi).sum(axis=1)).sum() - (len(langs) - 1) * 0.5 * np.log(count), pi

        want = max((em(s) for k in (1, 2, 3) for s in combinations(range(3), k)), key=lambda x: x[0])[1]
        assert np.allclose(language._choose(word_p, np.array([count]), 12)[0], want, atol=1e-6)


def test_language_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    model = language.LanguageModel(["a", "b"], np.log(rng.random((1 << 16, 2)).astype(np.float32)), language.LanguageParameters())
    rows = [b"some words here " * 4000, b"x" * 30_000, b"", b"a" * 9000 + b" b", "é ".encode() * 5000]
    data, offsets = np.frombuffer(b"".join(rows), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    whole = model.mixtures(data, offsets)
    monkeypatch.setattr(language.tk, "CHUNK_BYTES", 1000)
    cut = model.mixtures(data, offsets)
    assert len(list(language.pieces(data))) > 20 and (whole[1] == cut[1]).all() and np.allclose(whole[0], cut[0])


def test_language_held_out_accuracy(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    found = language.op1_language_mixture(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    rows = found.where("lang IS NOT NULL AND lang_pred <> 'und'").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).collect()
    assert len(rows) > 20 and np.mean([r["ok"] for r in rows]) > 0.95


def test_em_is_the_slow_em():
    rng = np.random.default_rng(1)
    p, count = rng.random((50, 3)), np.array([20, 30])
    share, ll = language._maximise(p, count, np.ones((2, 3)), 12)
    for d, (a, b) in enumerate(((0, 20), (20, 50))):
        pi = np.full(3, 1 / 3)
        for _ in range(12):
            r = p[a:b] * pi
            pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(share[d], pi) and np.isclose(ll[d], np.log((p[a:b] * pi).sum(axis=1)).sum())


# --- near duplicates ---


def brute_groups(texts, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed):
    rng = random.Random(seed)
    texts = [*ODD, "A B", "a  b", "b a"]
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 8, 40, 120]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(400)}"
            texts.append(rng.choice([" ", "\n"]).join(copy))
    return texts


@pytest.mark.parametrize("k,percent,slots,block", [(3, 85, None, None), (5, 80, None, 2), (3, 85, (2, 3), 2)])
def test_near_dup_is_brute_force(spark, monkeypatch, k, percent, slots, block):
    if slots:  # small numbers of centres, so that several rounds are needed; and nothing is broadcast
        monkeypatch.setattr(near_dup, "SLOTS", slots)
        monkeypatch.setattr(near_dup, "BROADCAST_BYTES", 0)
    if block:  # many blocks of a bucket, and many parts of a document's pairs
        monkeypatch.setattr(near_dup, "BLOCK", block)
        monkeypatch.setattr(near_dup, "SPLIT", block)
    texts = near_texts(k)
    rows = sorted(near_dup.near_dup(docs_of(spark, texts), near_dup.NearDup(shingle=k, percent=percent)).collect())
    assert [(r["n_shingles"], r["component_id"]) for r in rows] == brute_groups(texts, k, percent)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in rows)


def test_near_dup_rows_that_share_an_id(spark):
    rng = random.Random(11)
    x, y, z = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(100)) for k in "xyz")
    near = lambda t: t.rsplit(" ", 1)[0] + f" {rng.randrange(10**6)}"
    rows = [(5, x), (5, y), (3, near(y)), (5, near(x)), (5, x), (9, z), (9, None), (None, x), (None, z), (7, near(near(z)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near_dup.near_dup(df, near_dup.NearDup(3, 85)).collect()]
    n = {t: len({tuple(t.split(" ")[i : i + 3]) for i in range(98)}) for _, t in rows if t}
    component = {x: 5, y: 3, z: 7}
    stem = lambda t: next(b for b in (x, y, z) if t[:200] == b[:200])
    want = [(i, n.get(t, 0), None if i is None else component[stem(t)] if t else i) for i, t in rows]
    assert sorted(map(repr, got)) == sorted(repr((*w, w[0] is not None and w[0] == w[2])) for w in want)


def test_near_dup_hot_groups_and_empty(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    hot = [" ".join(base)] * 40 + [" ".join([f"x{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in base]) for _ in range(60)]
    rows = sorted(near_dup.near_dup(docs_of(spark, hot), near_dup.NearDup(3, 85)).collect())
    assert [(r["n_shingles"], r["component_id"]) for r in rows] == brute_groups(hot, 3, 85)
    assert near_dup.near_dup(docs_of(spark, hot).limit(0)).count() == 0
    assert near_dup.near_dup(docs_of(spark, [None, ""])).where("kept").count() == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.unique(np.concatenate((a[:240], rng.integers(0, 2**63, 60).astype(np.uint64))))
    for x, y, want in ((a, b, 240 / 360), (a[:9], a[:10], 0.9), (a[:1], a[:1], 1.0)):
        s = near_dup.signatures(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]), 128)
        assert abs((s[0] == s[1]).mean() - want) < 0.15


def test_components_of_a_path_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 520)] + [(7, 7), (600, 601), (601, 600)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 101)) and all(got[i] == 500 for i in range(501, 520)) and got[601] == 600


# --- pieces ---


def test_pieces_equal_the_reference_tokenizer(spark):
    sp = pytest.importorskip("sentencepiece")
    pt = pytest.importorskip("public_tokenizers")
    model = sp.SentencePieceProcessor(model_file=pt.path("piece_bpe_32k.model"))
    table = pieces.PieceTable.load()
    rng = random.Random(3)
    texts = [*ODD, "▁", "  lead", "trail  ", "\ttab\r\n", "aaaa" * 50] + ["".join(rng.choice("abcdeé日本\n\t   ▁'.,the in er") for _ in range(rng.randrange(40))) for _ in range(300)]
    encoded = pieces.encode(docs_of(spark, texts), table)
    rows = sorted(encoded.collect())
    for r, t in zip(rows, texts):
        want = model.encode(t or "")
        assert r["ids"] == want and r["n_pieces"] == len(want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        assert r["round_trip"] == ("▁" not in (t or ""))
    back = {r["id"]: r["text"] for r in pieces.decode(encoded, table).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    words = ["▁the", "▁▁▁Hello,", "日本", "▁é日", "x", "▁" * 11 + "a", "\n", "😀b"]
    lattice = pieces.Lattice(table)
    for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table).collect():
        w = r["word"]
        assert r["ids"] == lattice._fold(np.frombuffer(w.encode("utf-32-le"), dtype="<u4"), np.array([len(w)]))[0].tolist()
    assert pieces.encode(docs_of(spark, texts).limit(0), table).count() == 0


# --- WARC ---


def test_warc_round_trip_and_determinism(spark, tmp_path):
    rng = random.Random(4)
    html = ["", None, "<p>a</p>", "<p>a</p>", "é" * 50, "x" * 100_000, "<p>a</p>"] + ["<b>%d</b>" % rng.randrange(20) * rng.randrange(1, 50) for _ in range(60)]
    rows = [(i * 3 + 1, None if i % 9 == 0 else f"http://h/{i} \r\nX: y", h, "z") for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    a = warc.Archive(shard_bytes=20_000, file_bytes=3_000)
    found = []
    for name, parts in (("a", 3), ("b", 1)):
        root = f"file://{tmp_path}/{name}"
        manifest = warc.write(df.repartition(parts), root, a)
        got = {r["page_id"]: r for r in warc.read(spark, root, manifest).collect()}
        first = {}
        for i, _, h, _ in rows:
            body = (h or "").encode()
            keep = first.setdefault(body, i)
            r = got[i]
            assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert (r["record_type"], r["refers_to"]) == (("response", None) if keep == i else ("revisit", keep))
            assert r["payload"] == (body if keep == i else None)
        assert len(got) == len(rows) and manifest.count() > 3
        found.append({f.name: f.read_bytes() for f in (tmp_path / name).glob("*.warc.gz")})
        assert not list((tmp_path / name).glob(".*tmp"))
    assert found[0] == found[1]
    root = f"file://{tmp_path}/empty"
    assert warc.read(spark, root, warc.write(df.limit(0), root)).count() == 0


def test_warc_shards_by_bytes_whatever_the_ids(spark, tmp_path):
    ids = [-(2**63), 2**63 - 1, 2**62, *range(-1000, 1000), *[7] * 30, None, None]
    rows = [(i, f"http://h/{k}", f"<p>{k}</p>" * 50, 1) for k, i in enumerate(ids)] + [(7, "http://h/0", "<p>0</p>" * 50, 1)] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string, shard int")
    a, found = warc.Archive(shard_bytes=50_000, file_bytes=1 << 20), []
    for parts in (5, 2):
        root = f"{tmp_path}/{parts}"
        (tmp_path / str(parts)).mkdir()
        (tmp_path / str(parts) / ".pages-00000001-00000.warc.gz.9.dead.tmp").write_bytes(b"x")
        (tmp_path / str(parts) / "pages-00000001-00000.warc.gz").write_bytes(b"an earlier attempt's")
        manifest = warc.write(df.repartition(parts), f"file://{root}", a)
        got = warc.read(spark, f"file://{root}", manifest, with_payload=False).collect()
        assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)
        sizes = [r["records"] for r in manifest.orderBy("shard").collect()]
        total = sum(len(r[2]) for r in rows)
        assert total // 50_000 <= len(sizes) <= total // 50_000 + 2 and max(sizes) < 200
        assert not list((tmp_path / str(parts)).glob(".*.tmp"))
        found.append({f.name: f.read_bytes() for f in (tmp_path / str(parts)).glob("*.warc.gz")})
    assert found[0] == found[1]


def test_warc_reader_rejects_changed_bytes(spark, tmp_path):
    import gzip

    root = f"file://{tmp_path}/w"
    manifest = warc.write(spark.createDataFrame([(1, "http://a/", "<p>hello</p>")], "page_id long, url string, html string"), root)
    f = next((tmp_path / "w").glob("*.warc.gz"))
    f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace(b"hello", b"jello")))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, root, manifest).collect()


# --- URLs ---


def brute_url(url):
    m = re.search(r"://", url or "")
    if not m:
        return "", "", None, None
    rest = url[m.end() :]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_urls(spark):
    rng = random.Random(6)
    texts = [None, "", "no scheme", "http://", "x://a?b/c", "HTTP://EXAMPLE.com/en/7x", "http://example.com/en/8", "http://mycom/en/", "http://a.example.net/de/8#x", "http://a.net/de/1?q=://z", "http://É.org/es/\nx", "http://org/es/"]
    texts += [f"http{rng.choice(['', 's'])}://{rng.choice(['m.', '', 'spam-'])}{rng.choice('abc')}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(999)}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(texts)], "page_id long, url string, host int")
    rows = sorted(urls.judge(df).collect())
    for r, u in zip(rows, texts):
        host, path, rule, verdict = brute_url(u)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict), u
        assert r["verdict"] in ("block", "allow")
    free = [r for r in rows if r["rule"] is None and r["host"]]
    marked = [r["verdict"] == "block" for r in free if "spam" in r["host"]]
    clean = [r["verdict"] == "block" for r in free if "spam" not in r["host"]]
    assert np.mean(marked) > 0.9 and np.mean(clean) < 0.1
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_learn_given_labels(spark):
    """Labels of some URLs decide others; the sample is bounded, and rows that share an id do not share a draw."""
    rng = random.Random(7)
    bad = lambda: f"http://{rng.choice('abcdef')}{rng.randrange(999)}-{rng.randrange(99)}-win.example.com/x{rng.randrange(9999)}?a={rng.randrange(9)}&b=1&c=2"
    good = lambda: f"https://{rng.choice('abcdef')}{rng.choice('klm')}site.example.com/{rng.choice(['news', 'wiki'])}/{rng.choice('uvw')}"
    labelled = spark.createDataFrame([(bad(), True) for _ in range(600)] + [(good(), False) for _ in range(600)], "url string, blocked boolean")
    held_out = [(7, bad(), True) for _ in range(200)] + [(None, good(), False) for _ in range(200)]
    pages = spark.createDataFrame(held_out, "page_id long, url string, bad boolean")
    for p in (urls.Boosting(), urls.Boosting(sample_rows=200)):
        got = urls.judge(pages, labels=labelled, marked=(), p=p).collect()
        assert len(got) == 400 and np.mean([(r["verdict"] == "block") == (r["id"] == 7) for r in got]) > 0.95


def test_url_seeds_reach_other_hosts():
    """Trained with the word spam only, hosts of the same shape with other words are found, and clean ones are left alone."""
    rng = random.Random(8)
    hosts = [(f"http://{rng.choice(['', 'm.', 'www.'])}{w}.example.com/fr/{rng.randrange(99)}", w) for w in rng.choices(["spam-farm", "casino-win", "free-bets", *[f"th{rng.choice('abcdef')}{rng.choice('klmn')}er" for _ in range(20)]], k=1500)]
    import pyarrow as pa

    x = urls.lexical(pa.array([u for u, _ in hosts]), np.array([len(u.split("/")[2]) for u, _ in hosts]), np.array([len(u) - len("http://") - len(u.split("/")[2]) for u, _ in hosts]))
    seeds = np.array([w == "spam-farm" for _, w in hosts])
    other = np.array([w in ("casino-win", "free-bets") for _, w in hosts])
    trees = urls.Trees(urls.Boosting()).fit(x[~other], seeds[~other].astype(float))
    p = trees.probability(x) >= 0.5
    assert p[other].mean() > 0.8 and p[~seeds & ~other].mean() < 0.05


def test_trees_learn_held_out_labels():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 17))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = urls.Trees(urls.Boosting()).fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert (urls.Trees(urls.Boosting()).fit(x[:9], np.ones(9)).probability(x) > 0.5).all()


# --- packing ---


def brute_cost(places, penalties, window):
    n = len(places)
    cost = [0] + [10**9] * (n - 1)
    for j in range(1, n):
        for i in range(j):
            size = places[j] - places[i]
            if size <= window:
                cost[j] = min(cost[j], cost[i] + penalties[j] + (0 if size & (size - 1) == 0 else window - size))
    return cost[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 8), st.integers(0, 5)), min_size=1, max_size=30))
def test_cuts_are_the_cheapest(steps):
    places, penalties = [0], [0]
    for gap, penalty in steps:
        places.append(places[-1] + gap)
        penalties.append(penalty)
    cuts = packing.best_cuts(places, penalties, 8)
    at, total = 0, 0
    for j in cuts:
        size = places[j] - places[at]
        assert 0 < size <= 8
        total += penalties[j] + (0 if size & (size - 1) == 0 else 8 - size)
        at = j
    assert at == len(places) - 1 and total == brute_cost(places, penalties, 8)


def test_packing_keeps_every_id(spark):
    tokenizers = pytest.importorskip("tokenizers")
    text = packing.tokenizer_text()
    reference = tokenizers.Tokenizer.from_str(text)
    rng = random.Random(8)
    docs = [*ODD, "don't it's we'll 'tis '", "<|endoftext|> x", "a\x85b\xa0c ² 3.14"] + [" ".join("abc"[: rng.randint(1, 3)] * rng.randint(1, 3) + rng.choice(["", ".", ","]) for _ in range(rng.randrange(400))) for _ in range(60)]
    p = packing.Packing(window=256, block=3, window_cost=8)
    rows = packing.pack(docs_of(spark, docs).repartition(2, "doc_id"), text, p).collect()
    ids = {i: np.array(reference.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in enumerate(docs)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        assert [x for r in sorted(parts, key=lambda r: r["start"]) for x in range(r["start"], r["start"] + r["length"])] == list(range(len(ids[i])))
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
        padding, total = padding + (0 if at & (at - 1) == 0 else 256 - at), total + at
    assert padding / (padding + total) < 0.05
    assert packing.pack(docs_of(spark, docs).limit(0), text).count() == 0


def test_word_ids_equal_the_tokenizer():
    pytest.importorskip("tokenizers")
    words = packing.WordIds(packing.tokenizer_text(), 50)
    rng = random.Random(1)
    alphabet = [*"abcdefgstmdrvleABC'''''    ..,!?012 \n\t-_", "é", "É", "İ", "²", "\x85", "\xa0", "\x1c", "'ll", "'RE", "<|endoftext|>", "Σ", "日"] + [chr(c) for c in range(1, 0x260)]
    texts = ["".join(rng.choice(alphabet[:60] if rng.random() < 0.9 else alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for i in range(0, len(texts), 41):
        for t, ids in zip(texts[i : i + 41], words.encode([x.encode() for x in texts[i : i + 41]])):
            assert ids.tolist() == words.whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_rows_without_an_id(spark):
    """No operator fails on them, and each keeps its rows."""
    texts = ["same words in both rows here", "same words in both rows here", None, "other text, of its own."]
    df = spark.createDataFrame([(None if i % 2 else i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    from strandline.llm import chat, exact_dedup, licenses, quality, stages

    assert near_dup.near_dup(df, near_dup.NearDup(3, 85)).where("NOT kept AND component_id IS NULL").count() == 2
    assert exact_dedup.exact_dedup(df).where("kept").count() == 2
    assert quality.judge(df).count() == licenses.scan(df).count() == pieces.encode(df, pieces.PieceTable.load()).count() == 4
    assert packing.pack(df, packing.tokenizer_text()).select("start").count() >= 4
    assert language.predict(df, language.learn(df.withColumnRenamed("doc_id", "id"))).count() == 4
    assert stages.exact_stage(spark, df, "").count() == 3  # of the equal texts the row with an id stays
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    assert urls.judge(pages).count() == 4
    from strandline.llm.common import shared_folder

    root = shared_folder(spark, "warc")
    got = warc.read(spark, root, warc.write(pages, root)).collect()
    assert sorted((r["page_id"] is None, r["record_type"]) for r in got) == [(False, "response")] * 2 + [(True, "response")] * 2
    messages = df.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), "text")
    assert chat.reply_order(messages).count() == 4
