r"""License detection by ordered signature rules.

A text's words are its runs of letters, digits and characters beyond ASCII,
with A-Z lower-cased. Rules are regular expressions over these words, joined
by single spaces. Each rule has a keyword, which stands in all that its pattern
accepts. Only rules whose keyword stands in the text are tried; a text without
any keyword is not looked at further.

Detections are intervals. One that lies within another's interval is
suppressed (of equal intervals the rule with the better priority stays). The others
are taken by priority, then by place, and each stays unless it overlaps one that
stays already; so one beaten by a detection that is itself beaten may stay.

The work on a text grows with its length and its detections, not with their square.

Four base phrases are counted besides, at every place where their words stand
consecutively; their labels are never suppressed.

Defined results: a null text is empty; a text without words has no detections;
repeated rows give repeated results; an empty table gives an empty result; only
the id and text columns are read. The whole text is scanned, and everything is
an expression on one row, so nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import held, table
from strandline.llm.license_signatures import SIGNATURES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that are counted, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Names of licenses: label, keyword, name as a regular expression over words.
NAMES = (
    ("gpl-1.0", "gnu general public", r"gnu general public licen[sc]e (?:version |v )?1(?: 0)?"),
    ("gpl-2.0", "gnu general public", r"gnu general public licen[sc]e (?:version |v )?2(?: 0)?"),
    ("gpl-3.0", "gnu general public", r"gnu general public licen[sc]e (?:version |v )?3(?: 0)?"),
    ("gpl", "gnu general public", r"gnu general public licen[sc]e"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?"),
    ("lgpl-2.0", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e (?:version |v )?2(?: 0)?"),
    ("lgpl-2.0", "library general public", r"(?:gnu )?library general public licen[sc]e (?:version |v )?2(?: 0)?"),
    ("lgpl-2.1", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1"),
    ("lgpl-3.0", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)?"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e"),
    ("agpl-3.0", "affero general public", r"(?:gnu )?affero general public licen[sc]e(?: version 3(?: 0)?| v3)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?: version 1 [0-9])?"),
    ("apache-1.0", "apache", r"apache (?:software )?licen[sc]e (?:version |v )?1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:version |v )?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("mit", "mit", r"(?:the )?mit(?: x11)? licen[sc]e"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("mit-0", "mit", r"mit no attribution licen[sc]e"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:(?:simplified|freebsd) bsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[sc]e"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|revised|modified) bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[sc]e"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) licen[sc]e"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause) licen[sc]e"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[sc]e (?:version |v )?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v )?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e (?:version |v )?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e (?:version |v )?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e (?:version |v )?2(?: 0)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: (?:version |v )?1 0)?"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e(?: (?:version |v )?1 0)?"),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?: (?:version |v )?1 0)?"),
    ("eupl", "european union public", r"european union public licen[sc]e(?: (?:version |v )?1 [0-9])?"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e(?: (?:version |v )?1(?: 0)?)?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e (?:version |v )?2(?: 0)?"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: (?:version |v )?1 0)?"),
    ("busl-1.1", "business source", r"business source licen[sc]e(?: (?:version |v )?1 1)?"),
    ("sspl-1.0", "server side public", r"server side public licen[sc]e(?: (?:version |v )?1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: (?:version |v )?2(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("psf-2.0", "python software", r"python software foundation licen[sc]e(?: (?:version |v )?2)?"),
    ("php-3.0", "php", r"php licen[sc]e(?: (?:version |v )?3 01?)?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: (?:version |v )?2)?"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: (?:version |v )?1 1)?"),
    ("odbl-1.0", "open database", r"open (?:data commons open )?database licen[sc]e(?: (?:version |v )?1 0)?"),
    ("odc-by-1.0", "data commons", r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", "public domain dedication", r"open data commons public domain dedication and licen[sc]e"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons", r"creative commons (?:zero|cc0)(?: 1 0)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [0-9])?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [0-9])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [0-9])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [0-9])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [0-9])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [0-9])?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative|ativ)e?s?(?: works)?(?: [1-4] [0-9])?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [0-9])?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [0-9])?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative|ativ)e?s?(?: works)?(?: [1-4] [0-9])?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [0-9])?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [0-9])?"),
    ("creative-commons", "creative commons", r"creative commons(?: licen[sc]e)?"),
    ("public-domain", "public domain", r"public domain"),
    ("open-government", "open government", r"open government licen[sc]e(?: v?[1-3](?: 0)?)?"),
    ("proprietary", "proprietary", r"proprietary licen[sc]e"),
)
NAME_PRIORITY, NAME_WEIGHT = 5, 0.8


@dataclass(frozen=True)
class Rule:
    priority: int
    weight: float
    label: str
    keyword: str
    pattern: str


def rules() -> list[Rule]:
    """All rules, signatures and names, in the order of their priority."""
    out = [Rule(priority, weight, *x) for priority, weight, signatures in SIGNATURES for x in signatures]
    out += [Rule(NAME_PRIORITY, NAME_WEIGHT, *x) for x in NAMES]
    return sorted(out, key=lambda r: r.priority)


#: Parts of words; every rule's pattern has one of them in a word outside its choices, and the gate looks for them in the text as it is.
STEMS = (
    "licen", "software", "copyright", "permi", "public", "distribut", "spdx", "gpl", "gnu", "apache", "bsd", "creative", "commons", "proprietary", "reserved", "confidential", "copyleft", "mozilla",
    "expat", "cc0", "wtfpl", "fuck", "reproduced", "publication", "redistribut", "openstreetmap", "waived", "affirmer", "evaluation", "personal", "academic", "research", "material",
    "commercial", "government", "reverse", "document", "relinquishment", "contributor", "perl", "python", "program", "library", "remix", "functionality", "charityware", "png", "font", "skeleton", "jpeg", "postgresql", "restriction", "computer", "executable", "cecill", "eclipse", "openrail", "unauthorized", "scripts",
)


def certain(pattern: str) -> list[str]:
    """Parts of words that stand in all that a pattern accepts: what is outside its groups, classes and options."""
    while (shorter := re.sub(r"\((?:\?:)?[^()]*\)\??", "\n", pattern)) != pattern:
        pattern = shorter
    return re.split(r"[ \n]+", re.sub(r"\[[^\]]*\]\??|\.\{\d+,\d+\}|.[?*+]", "\n", pattern))


def _literal(found: list[Rule]) -> Column:
    """The rules as one constant array, by keyword, which begins a word; a pattern stands between spaces."""
    by_keyword: dict[str, list[dict]] = {}
    for i, r in enumerate(found):
        by_keyword.setdefault(f" {r.keyword}", []).append({"rule": i, "priority": r.priority, "weight": r.weight, "label": r.label, "pattern": f"(?<= )(?:{r.pattern})(?= )"})
    # As JSON, which the optimiser reads once, the driver builds one expression in place of thousands.
    groups = [{"keyword": k, "rules": v} for k, v in by_keyword.items()]
    return F.from_json(F.lit(json.dumps(groups)), "array<struct<keyword: string, rules: array<struct<rule: int, priority: int, weight: double, label: string, pattern: string>>>>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


#: Elements of a block of the running values below.
RUN = 64


def _before(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """What combine makes of the values before each place: within blocks, and over the blocks before."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, combine)

    def placed(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
        whole = F.transform(starts, lambda b: fold(F.slice(v, b * RUN + 1, F.lit(RUN))))
        return _let(whole, lambda w: _let(F.transform(w, lambda _, b: fold(F.slice(w, F.lit(1), b))), lambda earlier: F.transform(
            v, lambda _, i: combine(F.get(earlier, (i / RUN).cast("int")), fold(F.slice(v, (i / RUN).cast("int") * RUN + 1, i % RUN)))
        )))

    return F.when(F.size(values) > 0, _let(values, placed)).otherwise(F.slice(F.array(zero), F.lit(1), F.lit(0)))


def _spans(canon: Column, rule: Column) -> Column:
    """All matches of a rule as intervals of characters of the joined words, in a time that grows with the text and the matches."""

    def intervals(matches: Column) -> Column:
        def placed(gaps: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.char_length(g) + F.char_length(m))
            before = _before(steps, lambda a, x: a + x, F.lit(0))
            return _let(before, lambda b: F.transform(matches, lambda m, k: F.struct(
                (F.get(b, k) + F.char_length(F.get(gaps, k))).alias("start"), (-(F.get(b, k) + F.char_length(F.get(gaps, k)) + F.char_length(m))).alias("minus_end"),
                rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["weight"].alias("weight"),
            )))

        # The text is split only where the rule has matches.
        return F.when(F.size(matches) > 0, _let(F.split(canon, rule["pattern"], -1), placed))

    return _let(F.regexp_extract_all(canon, rule["pattern"], F.lit(0)), intervals)


def _kept(detections: Column) -> Column:
    """Suppress contained intervals, then settle other overlaps by priority; detections are sorted by start, longest first."""

    def outer(d: Column) -> Column:
        reach = _before(F.transform(d, lambda x: -x["minus_end"]), lambda a, x: F.greatest(a, x), F.lit(-1))
        return _let(reach, lambda r: F.filter(d, lambda x, i: -x["minus_end"] > F.get(r, i)))

    def settled(chain: Column) -> Column:
        # Best first; one stays if it overlaps none that stays already.
        ranked = F.array_sort(F.transform(chain, lambda x: F.struct(x["priority"].alias("p"), x["start"].alias("s"), x.alias("x"))))
        add = lambda kept, r: F.when(F.exists(kept, lambda k: (k["start"] < -r["x"]["minus_end"]) & (r["x"]["start"] < -k["minus_end"])), kept).otherwise(F.concat(kept, F.array(r["x"])))
        return F.aggregate(ranked, F.slice(chain, F.lit(1), F.lit(0)), add)

    def chains(o: Column) -> Column:
        # Starts and ends both grow here, so overlaps are between neighbours, and chains of them are runs.
        begins = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i == 0) | (F.get(o, i)["start"] >= -F.get(o, i - 1)["minus_end"]))
        runs = lambda b: F.transform(b, lambda s, j: F.slice(o, s + 1, F.coalesce(F.get(b, j + 1), F.size(o)) - s))
        return F.sort_array(F.flatten(F.transform(_let(begins, runs), lambda c: F.when(F.size(c) == 1, c).otherwise(settled(c)))))

    return _let(_let(detections, outer), chains)


def gate_stems(found: list[Rule]) -> tuple[list[str], list[Rule]]:
    """Stems of which a text has one if any of the rules matches it, and the rules that have none."""
    of = {r: {s for s in STEMS if any(s in part for part in certain(r.pattern))} for r in found}
    left, stems = {r for r in found if of[r]}, []
    while left:  # the stems with most rules first, so that few are looked for
        stems.append(max(STEMS, key=lambda s: sum(s in of[r] for r in left)))
        left = {r for r in left if stems[-1] not in of[r]}
    return stems, [r for r in found if not of[r]]


def _gate(text: Column, found: list[Rule]) -> Column:
    """Whether a text, in lower case, can have any rule or base phrase; words of a phrase may stand apart in other ways than by spaces."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    stems, rest = gate_stems(found)
    # Base phrases, and rules without a stem, by their own words.
    phrases = sorted({p for p, _ in BASE if not any(s in w for s in stems for w in p.split(" "))} | {r.keyword for r in rest})
    tests = [F.contains(text, F.lit(s)) for s in stems]
    if phrases:
        tests.append(text.rlike(f"(?:^|{gap})(?:{'|'.join(p.replace(' ', gap) for p in phrases)})(?:{gap}|$)"))
    return reduce(or_, tests)


def _places(words: Column, phrase: str) -> Column:
    first, *others = phrase.split(" ")

    def start(w: Column, i: Column) -> Column:
        follows = [F.coalesce(F.get(words, i + k) == other, F.lit(False)) for k, other in enumerate(others, 1)]
        return F.when(reduce(and_, [w == first, *follows]), i)

    return F.array_compact(F.transform(words, start))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: list[Rule] | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections: those that stay, with start and end as characters of the words
    joined by single spaces, with a space before the first.
    """
    found = rules() if found is None else found
    literal = _literal(found)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.lower(text).alias("lowered"))
    rows = rows.select("id", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), "text", _gate(F.col("lowered"), found).alias("gate"))
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = rows.select("id", "n_words", F.when(F.col("gate"), words).alias("words"))
    # Starts of the base phrases: the first word leads, the others are compared only behind it.
    places = [_places(F.col("words"), phrase) for phrase, _ in BASE]
    rows = rows.select(
        "id", "n_words", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("canon"), *[p.alias(f"base_{k}") for k, p in enumerate(places)]
    )
    canon = F.col("canon")
    tried = F.flatten(F.transform(F.filter(literal, lambda g: F.contains(canon, g["keyword"])), lambda g: g["rules"]))
    hits = F.sort_array(F.flatten(F.array_compact(F.transform(tried, lambda r: _spans(canon, r)))))
    all_places = F.concat(*[F.col(f"base_{k}") for k in range(len(BASE))])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"base_{k}") > 0, label) for k, (_, label) in enumerate(BASE)]))
    rows = rows.select("id", "n_words", all_places.alias("places"), base_labels.alias("base"), F.when(canon.isNotNull(), hits).alias("hits"))
    rows = rows.select("id", "n_words", *(c.alias(n) for n, c in zip(("places", "base", "kept"), held(F.col("places"), F.col("base"), F.when(F.size("hits") > 0, _kept(F.col("hits")))))))
    empty = F.array().cast("array<string>")
    labels = F.array_union(F.coalesce("base", empty), F.coalesce(F.transform("kept", lambda d: d["label"]), empty))
    # A base phrase alone counts as a name; several detections do not add up.
    score = F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0)), F.when(F.size("places") > 0, 0.8).otherwise(0.0))
    return rows.select(
        "id",
        "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.coalesce("base", empty)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        score.alias("score"),
        F.transform("kept", lambda d: F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"), d["label"].alias("label"), d["priority"].alias("priority"))).alias("detections"),
    )


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license rules over every document."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("detections")
