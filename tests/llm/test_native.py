"""The operators made of DataFrame expressions: dedup, quality, licenses, chat."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from strandline.llm import chat, exact_dedup, licenses, quality


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n long")  # extra columns with clashing names


ODD = ["", None, " ", "\n\n", "a", "a b", "A b.", "a b", "x" * 5000, "one two three " * 300, "İstanbul ß é", "#$ | | > <", "\t tab\x0bfeed\r\n"]


def test_exact_dedup_groups(spark):
    texts = [*ODD, "", "dup", "dup", "dup", "Dup"]
    for keep, pick in (("smallest", min), ("largest", max)):
        rows = exact_dedup.exact_dedup(docs_of(spark, texts), keep=keep).collect()
        groups = {}
        for i, t in enumerate(texts):
            groups.setdefault(t or "", []).append(i)
        assert {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows} == {(i, pick(g), len(g), i == pick(g)) for g in groups.values() for i in g}
        assert all(r["digest"] == hashlib.sha256((texts[r["id"]] or "").encode()).digest() for r in rows)
    assert exact_dedup.exact_dedup(docs_of(spark, texts).limit(0)).count() == 0


def test_exact_dedup_survives_colliding_digests(spark):
    texts = ["ab", "ba", "ab", "cc", "", "q"]
    rows = exact_dedup.exact_dedup(docs_of(spark, texts), digest=lambda t: F.encode(F.char_length(t).cast("string"), "UTF-8")).collect()
    assert {(r["id"], r["keep_id"], r["group_size"]) for r in rows} == {(0, 0, 2), (2, 0, 2), (1, 1, 1), (3, 3, 1), (4, 4, 1), (5, 5, 1)}


def test_exact_dedup_repeated_rows_and_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/lsm")
    index.flush(docs_of(spark, ["a", "b"], [7, 8]))
    index.compact()
    index.flush(docs_of(spark, ["a", "a", "c"], [3, 3, 9]))
    index.compact()
    assert {(r["keep_id"], r["n"]) for r in index.index().collect()} == {(3, 3), (8, 1), (9, 1)}


def test_exact_dedup_merges_level_and_new_runs_only(spark, tmp_path):
    rng = random.Random(3)
    for keep, pick in (("smallest", min), ("largest", max)):
        root = f"file://{tmp_path}/{keep}"
        index, seen = exact_dedup.DigestIndex(spark, root, keep), {}
        for k in range(3):
            ids = list(range(1000 * k, 1000 * k + 600))
            texts = [f"{k} {i}" if rng.random() < 0.9 else f"copy {rng.randrange(50)}" for i in ids]
            for i, t in zip(ids, texts):
                seen.setdefault(hashlib.sha256(t.encode()).digest(), []).append(i)
            index.flush(docs_of(spark, texts, ids))
            got = {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in index.compact().collect()}
            assert got == {d: (pick(x), len(x)) for d, x in seen.items()}
        # A compaction reads the new runs; of them the filter lets few pass that the level lacks; no run is read again.
        n = lambda name: spark.read.parquet(f"{root}/{name}").count()
        again, suspects, fresh = n("again-3"), n("suspects-3"), n("fresh-3")
        assert again <= suspects < again + 0.1 * fresh and fresh <= 600
        index.flush(docs_of(spark, ["copy 1", "new"], [-5, 9999]))
        assert {p.split("/runs/")[1].split("/")[0] for p in index.fresh().inputFiles()} == {"batch=3"}


def base_figures(s):
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if n[tuple(w[i : i + 3])] > 1}
    lines = [x for x in s.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_base(spark):
    rng = random.Random(1)
    texts = [*ODD, "a a a a", "a b c a b c d", "l.\nl.\n l.\nl."] + ["".join(rng.choice(["a ", "b ", "c", "\n", "# ", ". "]) for _ in range(rng.randrange(300))) for _ in range(60)]
    for r in quality.judge(docs_of(spark, texts), "doc_id").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_figures(texts[r["id"]] or "")
    assert quality.judge(docs_of(spark, ODD).limit(0)).count() == 0


def test_quality_lines(spark):
    prose = " ".join(f"word{i} and{i} more{i}." for i in range(40))
    junk = {"symbols": "a$$$ b### c%%% d***", "navigation": "home | about | contact | more", "shouting": "BUY NOW!! BEST PRICE!!", "boilerplate": "Please enable cookies now.", "punctuation": "word " * 45}
    fine = ["Short heading", "A sentence, fine.", "NASA and ESA met in Paris.", "a | b"]
    rows = docs_of(spark, [*junk.values(), *fine]).select("doc_id", quality.line_failure(F.col("text")).alias("rule")).collect()
    assert [r["rule"] for r in sorted(rows)] == [*junk, *[None] * len(fine)]
    texts = [prose, prose + "\n" + junk["symbols"], "\n".join([" ".join(f"w{i}$$$" for i in range(k, k + 9)) for k in range(0, 90, 9)]), prose + "\n" + "\n".join(f"a{i} | b{i} | c{i} | d{i}" for i in range(200))]
    rows = sorted(quality.judge(docs_of(spark, texts)).collect())
    assert [r["kept"] for r in rows] == [True, True, False, False]
    assert [r["n_failed_lines"] for r in rows] == [0, 1, 10, 200] and rows[1]["cleaned_text"] == prose
    # a filter on the verdict stays above the expressions
    assert quality.judge(docs_of(spark, texts)).where("kept").count() == 2


def brute_scan(text):
    w = re.findall(licenses.WORD, text.translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split(" ")
        for k in range(len(w) - len(parts) + 1):
            if w[k : k + len(parts)] == parts:
                places.append(k)
                labels.add(label)
    canon = " " + " ".join(w) + " "
    # Every pattern, whatever its keyword; best first, unless inside another or overlapping one that stays.
    hits = {(m.start(), m.end(), r.priority, i, r.label, r.weight) for i, r in enumerate(licenses.rules()) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", canon)}
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and ((a[0], a[1]) != (b[0], b[1]) or (b[2], b[3]) < (a[2], a[3]))
    kept = []
    for h in sorted((h for h in hits if not any(inside(h, g) for g in hits)), key=lambda h: (h[2], h[0])):
        if all(h[1] <= k[0] or k[1] <= h[0] for k in kept):
            kept.append(h)
    score = max([h[5] for h in kept] + [0.8] * bool(places), default=0.0)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {h[4] for h in kept})), score


def test_licenses(spark):
    texts = [
        *ODD, "Licensed under the Apache License, Version 2.0.", "CC BY-NC-SA 4.0", "cc-by; CC BY", "accby", "MIT license MIT License", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 2", "(c) Copyright 2019 X. All rights reserved.",
        "released under the terms of the MIT license or the Apache License 2.0", "Public domain. Creative Commons Attribution ShareAlike 3.0", "gnu general\npublic  LICENSE", "permission is hereby granted, free of charge, to any person obtaining a copy",
        "the unlicense", "éMIT license", "mit lıcense", "X11 license, ISC licence and zlib/libpng license", "license " * 500,
    ]
    got = sorted(licenses.scan(docs_of(spark, texts)).drop("detections").collect())
    for r, t in zip(got, texts):
        assert tuple(r)[1:] == brute_scan(t or ""), t
    assert len(licenses.rules()) >= 200
    assert licenses.scan(docs_of(spark, texts)).where("labels <> ''").count() > 5


def test_long_license_texts(spark):
    """A megabyte of license lines, with overlaps that chain, in a time that grows with its length."""
    import time

    lines = "Apache License 2.0, released under the MIT License. GNU General Public License version 2. Permission is hereby granted, free of charge, to any person obtaining a copy. "
    scan = lambda n: licenses.scan(docs_of(spark, [lines * n]).coalesce(1)).select("n_base", "labels", F.size("detections").alias("n")).first()
    small = scan(10)
    began = time.time()
    large = scan(6000)
    assert time.time() - began < 60
    assert large["n_base"] == 600 * small["n_base"] and large["n"] == 600 * small["n"] and large["labels"] == small["labels"]


def words_of(parsed, rng):
    """A text that a parsed pattern accepts, with random choices."""
    out = ""
    for op, value in parsed:
        match str(op):
            case "LITERAL":
                out += chr(value)
            case "ANY":
                out += rng.choice("abc")
            case "IN":
                kind, x = rng.choice(value)
                out += chr(x if str(kind) == "LITERAL" else rng.randint(*x))
            case "BRANCH":
                out += words_of(rng.choice(value[1]), rng)
            case "SUBPATTERN":
                out += words_of(value[-1], rng)
            case "MAX_REPEAT":
                least, most, part = value
                out += "".join(words_of(part, rng) for _ in range(rng.randint(least, max(least, min(most, 2)))))
            case _:
                raise ValueError(op)
    return out


def test_keywords_drop_nothing_that_a_pattern_accepts(spark):
    from re import _parser

    rng, rules = random.Random(2), licenses.rules()
    assert len(rules) >= 300 and len({r.pattern for r in rules}) == len(rules)
    examples = [(r, words_of(_parser.parse(r.pattern), rng)) for r in rules for _ in range(12)]
    assert [x for r, x in examples if not re.fullmatch(r.pattern, x) or f" {r.keyword}" not in f" {x}"] == []
    stems, rest = licenses.gate_stems(rules)
    assert all(any(s in w for s in stems for w in x.split(" ")) for r, x in examples if r not in rest) and len(rest) < 20
    texts = [x for _, x in examples]
    assert docs_of(spark, [t.upper().replace(" ", " (*)\n") for t in texts]).where(~licenses._gate(F.lower("text"), rules)).count() == 0
    some = ["GNU Library General Public License version 2", "Released under the GNU Library General Public Licence 2.0", "It was released under my own terms.", "RELEASED - under: x", *rng.sample(texts, 300)]
    got = sorted(licenses.scan(docs_of(spark, some)).drop("detections").collect())
    for r, t in zip(got, some):
        assert tuple(r)[1:] == brute_scan(t), t
    assert [r["labels"] for r in got[:4]] == ["lgpl-2.0", "lgpl-2.0,licensed", "licensed", "licensed"]


def test_chat(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "Fine."), (1, 2, "u", "On Monday Bob wrote:\n> hello  THERE.\n> How are you?\n>> older\nI replied to the first."), (1, 3, "a", "continue 2"),
        (1, 4, "u", "> Fine.\nto one"), (1, 5, "u", "> I replied to the first.\nnested > not quote"), (1, 6, "a", None), (1, 7, "u", "> Hello there.\nsecond reply to 0"), (2, 0, "u", "> unknown\nx"), (2, 0, "u", "> unknown\nx"), (None, 3, "u", "y"), (4, None, "u", ""),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, quotes int")
    out = chat.conversations(df).collect()
    assert len(out) == len(rows)
    first = [r for r in out if r["conv_id"] == 1]
    assert [r["turn"] for r in first] == [0, 1, 4, 2, 3, 5, 6, 7]
    assert {r["turn"]: r["reply_to"] for r in first} == {0: None, 1: 0, 2: 0, 3: 2, 4: 1, 5: 2, 6: 5, 7: 0}
    own = {r["turn"]: r["own_text"] for r in first}
    assert own[2] == "I replied to the first." and own[5] == "nested > not quote" and own[6] == ""
    quotes = {r["turn"]: (r["n_quotes"], r["n_linked"], r["max_level"]) for r in first}
    assert quotes[2] == (2, 1, 2) and quotes[0] == (0, 0, 0)
    assert chat.reply_order(df.limit(0)).count() == 0


def test_chat_runs_across_blocks(spark):
    n = chat.BLOCK * 2 + 5
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.when(F.col("id") == n - 2, "> first\nback").when(F.col("id") == 0, "first").otherwise(F.concat(F.lit("m"), "id")).alias("text"))
    out = {r["turn"]: r for r in chat.reply_order(df).collect()}
    assert out[chat.BLOCK]["reply_to"] == chat.BLOCK - 1 and out[n - 2]["reply_to"] == 0 and out[n - 1]["reply_to"] == n - 2
    assert [out[t]["reply_place"] for t in range(n)] == list(range(n))


def brute_threads(messages):
    """Quotes, links and reply order of one conversation's messages (turn -> text), line by line."""
    norm = lambda t: re.sub(r"[\s\xa0>]+", " ", t.lower(), flags=re.A).strip(" ")
    keys = lambda t: {norm(p) for p in [t, *re.split(r"\n\s*\n", t, flags=re.A), *t.split("\n")]} - {""}
    own, quotes = {}, {}
    for turn, text in messages.items():
        passages = []
        for line in (text or "").split("\n"):
            m = re.match(r"\s*((?:>\s?)+)", line, re.A)
            level, body = (m[1].count(">"), line[m.end() :]) if m else (0, line)
            if passages and passages[-1][0] == level:
                passages[-1][1].append(body)
            else:
                passages.append((level, [body]))
        quoting = any(lv for lv, _ in passages)
        mine = [x for lv, p in passages if not lv for x in p if not (quoting and re.match(r"\s*on .{1,200} wrote\s*:\s*$", x, re.I | re.A))]
        own[turn] = "\n".join(mine).strip("\n \t\r") if quoting else text or ""
        quotes[turn] = [(lv, "\n".join(p)) for lv, p in passages if lv]
    first = {}
    for turn in sorted(own):
        for k in keys(own[turn]):
            first.setdefault(k, turn)
    linked, figures = {}, {}
    for turn, qs in quotes.items():
        found = []
        for lv, q in qs:
            votes = {}
            for k in keys(q):
                o = first.get(k)
                o = o if o is not None and o < turn else None
                w, n = votes.get(o, (False, 0))
                votes[o] = (w or k == norm(q), n + 1)
            best = max(votes, key=lambda o: (o is not None, *votes[o], o if o is not None else 0), default=None)
            found.append((lv, best))
        outer = [o for lv, o in found if lv == 1 and o is not None]
        anywhere = [o for _, o in found if o is not None]
        linked[turn] = max(outer) if outer else max(anywhere) if anywhere else None
        figures[turn] = (len(qs), len(anywhere))
    turns = sorted(messages)
    reply_to = {t: linked[t] if linked[t] is not None else (turns[i - 1] if i else None) for i, t in enumerate(turns)}
    after = {t: turns[i + 1] for i, t in enumerate(turns[:-1]) if reply_to[turns[i + 1]] == t}
    order = []

    def walk(t):
        run = [t]
        while run[-1] in after:
            run.append(after[run[-1]])
        order.extend(run)
        for m in reversed(run):
            for child in turns:
                if reply_to[child] == m and after.get(m) != child:
                    walk(child)

    if turns:
        walk(turns[0])
    return own, figures, reply_to, {t: i for i, t in enumerate(order)}


def test_chat_is_brute_force(spark):
    rng, rows, threads = random.Random(21), [], {}
    for conv in range(40):
        base = rng.choice([0, -50, 10**13, -(10**15)])
        turns = sorted(rng.sample(range(60), rng.randrange(1, 30)))
        messages = {}
        for t in turns:
            lines = [f"{rng.choice('abcdef')} line {rng.randrange(9)}" for _ in range(rng.randrange(1, 4))]
            if messages and rng.random() < 0.5:  # quote some earlier message, at times with its quotes
                old = messages[rng.choice(list(messages))] or ""
                part = old.split("\n")[: rng.randrange(1, 5)]
                lines = (["On Monday X wrote:"] if rng.random() < 0.3 else []) + [rng.choice(["> ", ">"]) + x for x in part] + ([""] if rng.random() < 0.5 else []) + lines
            messages[base + t] = None if rng.random() < 0.03 else "\n".join(lines)
        threads[conv] = brute_threads(messages)
        rows += [(conv, t, "u", x, 0) for t, x in messages.items()]
    deep = {t: f"message {t}" if not t else f"> message {t - 2 if t > 1 else 0}\nmessage {t}" for t in range(60)}  # each but the first answers the one before the last
    threads[99] = brute_threads(deep)
    rows += [(99, t, "u", x, 0) for t, x in deep.items()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, reply_place int")
    for r in chat.reply_order(df).collect():
        own, figures, reply_to, place = threads[r["conv_id"]]
        t = r["turn"]
        assert (r["own_text"], r["n_quotes"], r["n_linked"], r["reply_to"], r["reply_place"]) == (own[t], *figures[t], reply_to[t], place[t]), (r["conv_id"], t)


def test_chat_long_texts_and_quote_levels(spark):
    rows = [(1, 0, "u", "word " * 200_000), (1, 1, "u", ">" * 20_000 + " deep\n" + "> " + "word " * 200_000 + "\nyes"), (1, 2, "u", "x\n" * 20_000)]
    out = {r["turn"]: r for r in chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (out[1]["n_quotes"], out[1]["n_linked"], out[1]["max_level"], out[1]["reply_to"], out[1]["own_text"]) == (2, 1, 20_000, 0, "yes")


def test_shared_folder_can_be_cleared(spark):
    from strandline.llm.common import clear_shared, materialise

    df = materialise(spark.range(3).toDF("n"), "test")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 3 and __import__("os").path.exists(path)
    clear_shared(spark)
    assert not __import__("os").path.exists(path)


def test_chat_links_paragraphs_that_were_wrapped_anew(spark):
    rows = [
        (1, 0, "u", "The first paragraph holds some words.\n\nThe second one holds\na few more of them.\n\nThe third is not quoted."), (1, 1, "a", "Something else."),
        (1, 2, "u", "> The first paragraph\n> holds some words.\n>\n> The second one\n> holds a few\n> more of them.\nI agree."),
    ]
    out = {r["turn"]: r for r in chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (out[2]["n_quotes"], out[2]["n_linked"], out[2]["reply_to"]) == (1, 1, 0)
    assert out[1]["reply_to"] == 0
