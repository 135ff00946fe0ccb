"""Conversation repair, line dedup, spelling variants; many languages and long texts; batches of the digest index; quoting conversations."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat, exact_dedup, language, lines, repair, variants

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- conversation repair ---

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """Least (cost, audit, role initials) by a search over edits: rows are (initial, must go, truncated)."""
    states = {"": (0, "")}  # by what stands there; at most two are inserted before each row
    grow = lambda st: {(s + x): (c + 2, a + "I") for s, (c, a) in st.items() for x in "ua"}

    def merged(*many):
        out = {}
        for st in many:
            for s, v in st.items():
                # What stands there counts only by its last letter, and whether it can go on.
                if re.match(r"(s?(ua)*u?)\Z", s) and (s not in out or v < out[s]):
                    out[s] = v
        short = {}
        for s, v in out.items():
            k = s[-1:] if s else ""
            if k not in short or v < short[k][1]:
                short[k] = (s, v)
        return dict(short.values())

    def inserted(st):
        one = merged(st, grow(st))
        return merged(one, grow(one), grow(grow(st)))

    states = inserted(states)
    for initial, must_go, truncated in rows:
        after = [{s: (c + 3, a + "D") for s, (c, a) in states.items()}]
        if not must_go:
            after.append({s + (initial or "?"): (c + truncated, a + "K") for s, (c, a) in states.items()})  # a role without characters fits nowhere
            after += [{s + x: (c + 2 + truncated, a + "R") for s, (c, a) in states.items()} for x in "ua"]
        states = inserted(merged(*after))
    return min(v for s, v in states.items() if LEGAL.match(s))


def every_edit(rows, most):
    """The same by trying all edit sequences with at most `most` insertions in a row."""
    best = None
    inserts = [list(x) for n in range(most + 1) for x in itertools.product("ua", repeat=n)]
    options = []
    for initial, must_go, truncated in rows:
        own = [("D", 3, "")]
        if not must_go:
            own += [("K", truncated, initial), ("R", 2 + truncated, "u"), ("R", 2 + truncated, "a")]
        options.append(own)
    for edits in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for k in range(len(rows) + 1):
                roles, audit, cost = roles + "".join(gaps[k]), audit + "I" * len(gaps[k]), cost + 2 * len(gaps[k])
                if k < len(rows):
                    letter, c, role = edits[k]
                    roles, audit, cost = roles + role, audit + letter, cost + c
            if LEGAL.match(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_repair_grammar_is_brute_force():
    rng = random.Random(1)
    for n in (1, 2, 3):
        for _ in range(25 if n < 3 else 8):
            rows = tuple((rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n))
            want = every_edit(rows, 2 if n < 3 else 1)
            assert repair.best(repair.chart(rows, repair.Costs())) <= want  # a bound on insertions can only cost more
            assert cheapest(rows) == repair.best(repair.chart(rows, repair.Costs()))
            if n < 3:
                assert repair.best(repair.chart(rows, repair.Costs())) == want


def test_every_split_gives_one_cell():
    rng = random.Random(2)
    for _ in range(40):
        rows = [(rng.choice("suua" "a"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(rng.randrange(1, 30))]
        whole = repair.chart(tuple(rows), repair.Costs())
        spans = repair.Spans()
        at = 0
        while at < len(rows):
            k = rng.randrange(1, 8)
            spans.add(len(rows[at : at + k]), repair.chart(tuple(rows[at : at + k]), repair.Costs()))
            at += k
        assert spans.whole() == (len(rows), whole) and repair.best(whole) == cheapest(rows)


def brute_repair(rows, ids):
    """Everything the query gives, row by row in Python."""
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ids}
    damaged = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        damaged[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for conv, own in damaged.items():
        if not own:
            continue
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, symbols, counts = set(), [], Counter()
        for _, role, text in own:
            last = text.rstrip(SPACE)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, audit = cheapest(symbols)
        fixed, rest = [], iter(own)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(rest)[1:]
            if letter == "D":
                continue
            if letter in "IR":
                n = len(fixed) - (1 if fixed and fixed[0][0].startswith("s") else 0)
                role = ("user", "assistant")[n % 2]
            fixed.append((role, text))
        body = "\n".join(f"{r}:{t}" for r, t in fixed)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string"


def as_folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/sf/{name}.parquet")
    return f"{tmp_path}/sf"


def check_repair(spark, folder, rows):
    found = repair.op11_conversation_repair(spark, folder).collect()
    want = brute_repair(rows, {r[0] for r in rows})
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in found}
    assert len(got) == len(found) and got == want


def test_repair_query_is_brute_force(spark, tmp_path):
    rng = random.Random(3)
    said = ["Yes.", "No", "Why?", "", " \t", "So it is!", "à la carte. ", "x" * 3000, None, "long " * 2000 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""]), rng.choice(said)) for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(None, t, "user", "Hello.") for t in (1, 2, None)] + [(500, None, "user", "A."), (500, None, "assistant", "B."), (500, 3, "user", "C.")] + rows[:20]
    rows += [(900, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(300)]  # blocks beyond one chart
    df = spark.createDataFrame(rows, CONV).withColumn("digest", F.lit("clash")).withColumn("place", F.lit(0)).withColumn("conv", F.lit("x"))
    check_repair(spark, as_folder(spark, tmp_path, conversations=df.repartition(5)), rows)


def test_repair_of_given_and_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], CONV)
    assert repair.op11_conversation_repair(spark, as_folder(spark, tmp_path, conversations=empty)).count() == 0
    if os.path.isdir(SF):
        rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        check_repair(spark, SF, rows)


def test_repair_messages(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C"), (2, 0, "assistant", "D.")]
    found = repair.repair(spark.createDataFrame(rows, CONV))
    got = defaultdict(list)
    for r in found.messages.collect():
        got[r["conv"]].append((r["edit"], r["role"], r["text"]))
    assert got == {1: [("K", "user", "A."), ("I", "assistant", ""), ("K", "user", "B."), ("K", "assistant", "C")], 2: [("I", "user", ""), ("K", "assistant", "D.")]}
    assert {r["conv"]: (r["cost"], r["audit"]) for r in found.verdicts.collect()} == {1: (3, "KIKK"), 2: (2, "IK")}


# --- line dedup ---


def brute_lines(docs):
    keys = lambda t: [k if len(k) >= 10 else None for k in (x.strip(SPACE).translate(A_Z) for x in (t or "").split("\n"))]
    holders = defaultdict(set)
    for i, t in docs:
        for k in keys(t):
            if k is not None:
                holders[k].add((i is None, i or 0))
    out = []
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x, k in zip(every, keys(t)) if k is None or len(holders[k]) == 1 or min(holders[k]) == (i is None, i or 0)]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def line_docs():
    rng = random.Random(4)
    common = ["All rights reserved.", "  Read More About It\t", "short", "ÀÉÎÕÜ ten", "ten points", "nine chars", "x" * 100_000, "Ünïcödé line here"]
    docs = [(i, "\n".join(rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(400)} of it" for _ in range(rng.randrange(12)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "READ more about it\n\n \n"), (None, "All rights reserved.\nunique to no id"), (None, "all rights reserved. "), (3, "All rights reserved.\nwritten twice over"), (3, "written twice over")]
    return docs + [(2000 + i, "All rights reserved.\n" * 3 + "copy of a text") for i in range(40)]


def test_lines_are_brute_force(spark):
    docs = line_docs()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, key string, t long").repartition(7)
    want = Counter(brute_lines(docs))
    for p in (lines.LineDedup(), lines.LineDedup(most_words=1, shard_words=1), lines.LineDedup(per_word=1)):  # a full filter makes all suspects
        got = Counter((r["id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.line_dedup(df, p).collect())
        assert got == want
    assert lines.line_dedup(df.limit(0)).count() == 0


def test_hot_keys_go_their_own_way(spark, monkeypatch):
    docs = line_docs()
    monkeypatch.setattr(lines, "HOT", 5)
    monkeypatch.setattr(lines, "MOST_HOT", 10)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter((r["id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.line_dedup(df).collect()) == Counter(brute_lines(docs))


def test_filter_misses_no_repeat_and_spares_most_others(spark):
    rng = np.random.default_rng(5)
    once, often = rng.integers(-(1 << 63), 1 << 63, 50_000), rng.integers(-(1 << 63), 1 << 63, 3000)
    rows = [(int(h), False) for h in np.concatenate([once, often[:2000], often[:2000]])] + [(int(h), True) for h in often[2000:]]
    p = lines.LineDedup()
    words = lines.twice_filter(spark.createDataFrame(rows, "h long, twice boolean").repartition(6), p)
    held = lambda h: (words[h.view(np.uint64) % np.uint64(len(words))] & lines._mask(h.view(np.uint64))) == lines._mask(h.view(np.uint64))
    assert held(often).all() and held(once).mean() < 0.05


def test_line_query_is_its_sql(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({lines.OP12_SQL})").fetchall()
    assert sorted(map(tuple, lines.op12_line_dedup(spark, SF).select(columns).collect())) == sorted(want)


# --- spelling variants ---


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times=2):
    out = {}
    close = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and near(v, w)] for w in counts}
    for w in counts:
        best = min(close[w], key=lambda v: (-counts[v], v), default=None)
        out[w] = best if best is not None and counts[best] >= times * counts[w] else None
    def root(w):  # noqa: E306
        return w if out[w] is None else root(out[w])
    return {(w, out[w], root(w), counts[w], len(close[w]), counts.get(out[w])) for w in counts}


def test_variants_are_brute_force(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randrange(1, 8))) for _ in range(400)} | {"aaaaa", "aaaaaa", "z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1500, "ÿÿÿ"}
    counts = {w: 2 ** rng.randrange(10) for w in words}
    for parts in (1, 9):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == brute_variants(counts)
    assert variants.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_nodes_are_those_of_a_trie(spark):
    words = sorted({"".join(random.Random(i).choices("ab", k=1 + i % 9)) for i in range(300)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = variants.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    of = defaultdict(set)
    for r in rows:
        for i, node in enumerate(r["nodes"]):
            of[r["word"][:i]].add(node)
    assert all(len(v) == 1 for v in of.values()) and len({n for v in of.values() for n in v}) == len(of)
    assert [r["word"] for r in sorted(rows, key=lambda r: r["place"])] == words


def test_word_counts(spark):
    docs = [(1, "Hello HELLO hello world, naïve naïve naïve"), (2, None), (3, ""), (None, "hello wörld wörld wörld İx"), (4, "a" * 50_000 + " " + "a" * 50_000 + " " + "a" * 50_000)]
    got = {r["word"]: r["n"] for r in variants.word_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {"hello": 4, "naïve": 3, "wörld": 3, "a" * 50_000: 3}
    slipped = {w: variants.damaged(7, w) for w in (f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))}
    for w, v in slipped.items():
        h = zlib.crc32(f"7:{w}".encode())
        assert v == (w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :])
    assert any(w != v for w, v in slipped.items())


def test_variant_query_is_its_sql(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({variants.OP13_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, variants.op13_spelling_variants(spark, SF).select(columns).collect()))) == sorted(map(repr, want))


# --- many languages, long texts ---


def test_six_hundred_languages(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:03d}": ["".join(rng.choices(letters, k=6)) for _ in range(12)] for k in range(600)}
    rows = [(i, " ".join(rng.choices(words, k=30)), name) for i, (name, words) in enumerate(own.items())]
    model = language.learn(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert len(model.names) == 600 and isinstance(model.logp, language.SparseScores)
    texts = [" ".join(rng.choices(own[f"l{k:03d}"], k=20)) for k in range(0, 600, 40)]
    mixed = " ".join(rng.choices(own["l001"], k=40) + rng.choices(own["l002"], k=20))
    found = sorted(language.predict(spark.createDataFrame(list(enumerate([*texts, mixed, "", None])), "doc_id long, text string"), model).collect())
    assert [r["lang_pred"] for r in found] == [f"l{k:03d}" for k in range(0, 600, 40)] + ["l001", "und", "und"]
    assert 0.5 < found[15]["score"] < 0.8 and "l002:" in found[15]["mixture"]


def test_sparse_scores_are_the_matrix():
    rng = np.random.default_rng(8)
    gram, lang = rng.integers(0, 256, 500), rng.integers(0, 5, 500)
    pair = np.unique(lang * 256 + gram)
    gram, lang, n = pair % 256, pair // 256, rng.integers(1, 9, len(pair))
    scores = language.SparseScores.of(gram, lang, n, 256, 5, 0.1)
    counts = np.full((256, 5), 0.1)
    counts[gram, lang] += n
    assert np.allclose(scores.matrix(), np.log(counts / counts.sum(axis=0)), atol=1e-5)
    text, first = rng.integers(0, 256, 90), np.array([0, 7, 8, 40])
    assert np.allclose(scores.words(text, first), np.add.reduceat(scores.matrix()[text], first, axis=0), atol=1e-4)


def test_long_text_of_fifty_megabytes():
    rng = np.random.default_rng(9)
    p = language.LanguageParameters()
    model = language.LanguageModel(["a", "b"], np.log(rng.random((1 << 16, 2)).astype(np.float32)), p)
    vocabulary = np.array(["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(20_000)])
    text = " ".join(rng.choice(vocabulary, 6_300_000)).encode()
    assert len(text) > 50_000_000
    share, count = model.mixtures(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    part = text[:900_000]
    expected, _ = model.mixtures(np.frombuffer(part, dtype=np.uint8), np.array([0, len(part)]))
    assert count[0] == 6_300_000 and abs(share.sum() - 1) < 1e-9 and np.allclose(share, expected, atol=0.02)


def test_blocks_of_words_change_nothing(monkeypatch):
    rng = np.random.default_rng(10)
    model = language.LanguageModel(["a", "b", "c"], np.log(rng.random((1 << 16, 3)).astype(np.float32)), language.LanguageParameters())
    rows = ["".join(rng.choice(list("abcdefg é"), rng.integers(0, 900))).encode() for _ in range(40)]
    data, offsets = np.frombuffer(b"".join(rows), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    whole = model.mixtures(data, offsets)
    monkeypatch.setattr(language, "CELLS", 60)
    cut = model.mixtures(data, offsets)
    assert (whole[1] == cut[1]).all() and np.allclose(whole[0], cut[0])


# --- the digest index in batches, conversations without quotes ---


def test_dedup_comes_through_the_index(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, f"text {i}" if rng.random() < 0.8 else f"copy {rng.randrange(40)}") for i in range(900)] + [(None, "copy 1"), (None, "alone"), (5000, "long " * 400_000), (5001, "long " * 400_000)]
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/lsm", "largest")
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep="largest", index=index).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = Counter((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t])) for i, t in rows)
    assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in found) == want
    n = lambda name: spark.read.parquet(f"file://{tmp_path}/lsm/{name}").count()
    for k in (2, 3):  # each batch probed the filter of the level: few of its digests were looked up, all that were there were met
        fresh, suspects, again = n(f"fresh-{k}"), n(f"suspects-{k}"), n(f"again-{k}")
        assert fresh > 200 and 0 < again <= suspects < again + 0.1 * fresh


def test_only_quoting_conversations_send_their_lines(spark, monkeypatch):
    made = []
    real = chat.materialise

    def watched(df, purpose):
        out = real(df, purpose)
        if purpose == "chat-quoting":
            made.extend(r["conv_id"] for r in out.collect())
        return out

    monkeypatch.setattr(chat, "materialise", watched)
    rows = [(1, 0, "user", "first line here\nand a second"), (1, 1, "user", "> first line here\nI agree"), (2, 0, "user", "first line here"), (2, 1, "user", "nothing quoted")]
    messages = spark.createDataFrame(rows, CONV)
    found = {(r["conv_id"], r["turn"]): r["original"] for r in chat.links(chat.parse(messages)).collect()}
    assert made == [1] and found == {(1, 1): 0}
    plan = chat.links(chat.parse(messages))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
