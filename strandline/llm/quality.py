r"""Line-first quality rules.

Each line is judged by itself: punctuation, navigation and boilerplate rules.
Lines that fail are removed, and a document that loses too much of its text
this way, or that fails the base rules on length and repetition, is rejected.

Words are runs of characters other than space, tab, newline, vertical tab, form
feed and carriage return. Lines are what stands between newlines; a line
without a word is blank, never judged and never kept.

Defined results: a null text is a text without words; empty texts fail the base
rule (under 50 words); ties do not occur, as no rows are compared; repeated rows
give repeated results; an empty table gives an empty result; only the id and
text columns are read.

Everything is a DataFrame expression on one row, so there is no shuffle, and
the longest document bounds the memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import held, table

SPACE = r"[ \t\n\x0B\f\r]"
WORD_CHAR = r"[^ \t\n\x0B\f\r]"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"

#: Phrases of page furniture, in lower case; a line with one of them is boilerplate.
BOILERPLATE = (
    "lorem ipsum",
    "javascript",
    "enable cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "subscribe to our newsletter",
    "click here",
    "read more",
    "sign in to",
    "share this",
    "powered by",
    "skip to content",
    "back to top",
)
#: Separators of menu entries.
SEPARATORS = (" | ", " > ", " » ", " • ", " · ")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document's verdict."""

    #: Most symbols of SYMBOLS for each word of a line.
    symbols_per_word: float = 0.5
    #: From this share of capitals among a line's letters on, a line of some length is shouting.
    capitals: float = 0.7
    #: Letters that a line has at least before its capitals are judged.
    capitals_letters: int = 12
    #: Most separators (a bar, bullet or angle between spaces) for each word.
    separators_per_word: float = 0.2
    #: Words from which on a line fails that holds no punctuation mark anywhere (commas, quotes and closing brackets count); shorter lines
    #: are headings or menu entries and pass. A line that only lacks a mark at its end passes: lines of wrapped prose end anywhere.
    punctuation_words: int = 40
    #: Most of the word characters that a document may lose with its lines.
    lost: float = 0.5
    #: Base rules.
    base_words: int = 50
    base_repeat: float = 0.5


def count_of(text: Column, pattern: str) -> Column:
    """Characters of text that match a pattern of single characters."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"(?:{pattern})+", ""))


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(p)) for p in phrases))


def line_failure(line: Column, rules: LineRules = LineRules(), gates: dict[str, Column] | None = None) -> Column:
    """Name of the first rule that a line fails, else null.

    gates: rule -> a condition on the whole text without which none of its lines
    can fail the rule; it saves the work on most texts and changes no result.
    """
    words = F.size(F.split(F.trim(line), r"[ \t\x0B\f\r]+"))
    capitals, letters = count_of(line, r"\p{Lu}"), count_of(line, r"\p{L}")
    separators = F.size(F.split(line, r" [|>»•·] ")) - 1
    gate = lambda rule: (gates or {}).get(rule, F.lit(True))
    return (
        F.when(gate("symbols") & (count_of(line, SYMBOLS) > rules.symbols_per_word * words), "symbols")
        .when(gate("navigation") & (separators >= 2) & (separators > rules.separators_per_word * words), "navigation")
        .when(gate("shouting") & line.rlike(r"\p{Lu}{2}") & (letters >= rules.capitals_letters) & (capitals > rules.capitals * letters), "shouting")
        .when(gate("boilerplate") & _any_of(F.lower(line), BOILERPLATE), "boilerplate")
        .when(~line.rlike(r"[.!?…。！？:;,\"'”’)\]]") & (words >= rules.punctuation_words), "punctuation")
    )


def text_gates(text: Column) -> dict[str, Column]:
    """Conditions for line_failure, each one pass over the whole text."""
    return {
        "symbols": text.rlike(SYMBOLS),
        "navigation": _any_of(text, SEPARATORS),
        "shouting": text.rlike(r"\p{Lu}{2}"),
        "boilerplate": _any_of(F.lower(text), BOILERPLATE),
    }


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per input row: id, the base figures, n_failed_lines, cleaned_text, lost, base_failed and kept.

    Windows of three words are compared by 64-bit hashes inside one text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", _words(F.col("text")).alias("words"), F.split("text", "\n").alias("all_lines"))
    rows = rows.select(
        "id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.sort_array(
            F.expr(
                "CASE WHEN size(words) < 3 THEN CAST(array() AS array<struct<h:bigint,i:int>>) ELSE "
                "transform(slice(words, 1, size(words) - 2), (w, i) -> "
                "named_struct('h', xxhash64(w, words[i + 1], words[i + 2]), 'i', i)) END"
            )
        ).alias("windows"),
        F.expr(f"filter(all_lines, l -> rlike(l, '{WORD_CHAR}'))").alias("lines"),
        *(gate.alias(f"may_{rule}") for rule, gate in text_gates(F.col("text")).items()),
    )
    gates = {rule: F.col(f"may_{rule}") for rule in text_gates(F.col("text"))}
    # Starts of the windows that occur again, in order of the text.
    repeated = F.expr(
        "array_sort(transform(filter(windows, (e, j) -> e.h = windows[greatest(j - 1, 0)].h AND j > 0 "
        "OR e.h = get(windows, j + 1).h), e -> e.i))"
    )
    good = F.filter("lines", lambda l: line_failure(l, rules, gates).isNull())
    rows = rows.select(
        "id",
        "n_words",
        count_of(F.col("text"), WORD_CHAR).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("starts"),
        F.size("lines").alias("n_lines"),
        good.alias("good"),
    )
    rows = rows.select(
        "id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.expr("aggregate(transform(starts, (s, j) -> least(3, coalesce(get(starts, j + 1) - s, 3))), 0L, (a, x) -> a + x)").alias(
            "n_repeat_words"
        ),
        (F.col("n_lines") - F.size("good")).cast("long").alias("n_failed_lines"),
        F.array_join("good", "\n").alias("cleaned_text"),
    )
    rows = rows.withColumn("left_chars", count_of(F.col("cleaned_text"), WORD_CHAR))
    lost = F.when(F.col("word_chars") > 0, 1 - F.col("left_chars") / F.col("word_chars")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < rules.base_words) | (100 * F.col("n_repeat_words") > 100 * rules.base_repeat * F.col("n_words"))
    return rows.select(
        "id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_failed_lines",
        "cleaned_text",
        lost.alias("lost"),
        failed.alias("base_failed"),
    ).withColumn("kept", held(~F.col("base_failed") & (F.col("lost") <= rules.lost))[0])


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line rules over every document."""
    found = judge(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle(rules: LineRules = LineRules()) -> str:
    def count_of(text: str, pattern: str) -> str:
        return f"(length({text}) - length(regexp_replace({text}, '{pattern}+', '', 'g')))"

    has = lambda text, phrases: "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD_CHAR}+') AS w FROM d),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM starts),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id
),
lines AS (
  SELECT * FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD_CHAR}')
),
counted AS (
  SELECT doc_id, l, len(string_split_regex(trim(l, ' '), '[ \t\x0B\f\r]+')) AS words, {count_of("l", WORD_CHAR)} AS chars,
         {count_of("l", SYMBOLS)} AS symbols, len(string_split_regex(l, ' [|>»•·] ')) - 1 AS separators,
         {count_of("l", "[" + chr(92) + "p{Lu}]")} AS capitals, {count_of("l", "[" + chr(92) + "p{L}]")} AS letters
  FROM lines
),
judged AS (
  SELECT *, NOT (
    symbols > {rules.symbols_per_word} * words
    OR (separators >= 2 AND separators > {rules.separators_per_word} * words)
    OR (regexp_matches(l, '\p{{Lu}}{{2}}') AND letters >= {rules.capitals_letters} AND capitals > {rules.capitals} * letters)
    OR {has("lower(l)", BOILERPLATE)}
    OR (words >= {rules.punctuation_words} AND NOT regexp_matches(l, '[.!?…。！？:;,"''”’)\]]'))) AS good
  FROM counted
),
by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE good), 0) AS left_chars
  FROM judged GROUP BY doc_id
),
figures AS (
  SELECT w.doc_id, len(w) AS n_words, {count_of("t", WORD_CHAR)} AS word_chars, {count_of("t", SYMBOLS)} AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(left_chars, 0) AS left_chars
  FROM w LEFT JOIN repeated USING (doc_id) LEFT JOIN by_line USING (doc_id)
),
base AS (SELECT *, n_words < {rules.base_words} OR 100 * n_repeat_words > {100 * rules.base_repeat} * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (CASE WHEN word_chars > 0 THEN 1 - left_chars / word_chars ELSE 0 END) <= {rules.lost} AS kept
FROM base
"""


OP4_SQL = _oracle()
