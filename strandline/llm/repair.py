r"""Repair of the structure of conversations by weighted interval parsing.

A conversation should read (s?(ua)+)? by the initials of its roles: perhaps a system message, then user and
assistant in turn. The repair grammar is in Chomsky normal form. Its nonterminals are pairs [p, q] of what stood
last before a span and what stands last in it; [p, q] -> [p, r] [r, q] joins two spans, and a span of one row is kept, given a
new role, or deleted, with inserted messages around it: the closure of insertions is applied once, to these
spans, and stays closed from there on. Each cell holds the least (cost, audit), the
audit being the initials of the edits in order.

Spans are combined bottom-up by their length. Up to BLOCK rows, the chart holds every span and tries every
split. As nonterminals are pairs, whole blocks are spans of the same kind, and every split of a span gives the same cell (audits of
one span and cost are never prefixes of one another, so the least of a concatenation is that of its parts); so beyond a block, spans
of about equal length are joined, one split each, and a conversation of n rows takes n log n and not n**3. Parts of a
long conversation are parsed where they lie, in ranges of (conversation, place), and what is joined last is one span for
each range.

Faults: the first that applies to a row of blank, duplicate (role and text stood earlier in
the conversation) and truncated. Blank and duplicate rows must be deleted.

Defined results: a null role or text is one space; a null conversation id is a conversation of its own; rows are
ordered by turn, nulls first, and where turns are equal by role and by the SHA-256 of the text; a role without
characters fits nowhere, and is given a new role or deleted; repeated rows are duplicates; an empty table gives an
empty result; further columns are not read. The digest of a conversation is a sum over all its
text in order, so its text passes through one task, as a stream: nothing of it is held but one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, materialise, table

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
ROLES = ("user", "assistant")
#: Rows of a full chart.
BLOCK = 8

#: What stood last: nothing, or a system, user or assistant message; and the steps that each initial allows.
STATES = range(4)
STEPS = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
ACCEPTED = (0, 3)

#: By 4 * p + q: the least (cost, audit) of a span, or None.
Cell = tuple["tuple[int, str] | None", ...]


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


def _least(pairs: Iterator[tuple[int, tuple[int, str]]]) -> Cell:
    out: list[tuple[int, str] | None] = [None] * 16
    for at, found in pairs:
        if out[at] is None or found < out[at]:
            out[at] = found
    return tuple(out)


def _rules() -> list[tuple[int, int, int]]:
    """[p, q] -> [p, r] [r, q] for states that can follow one another."""
    reach = {(p, q) for p, q in product(STATES, STATES) if p == q or q > p or (p, q) == (3, 2)}
    return [(4 * p + q, 4 * p + r, 4 * r + q) for p, r, q in product(STATES, STATES, STATES) if {(p, r), (r, q), (p, q)} <= reach]


RULES = _rules()


def join_spans(left: Cell, right: Cell) -> Cell:
    out: list[tuple[int, str] | None] = [None] * 16
    for at, a, b in RULES:
        x, y = left[a], right[b]
        if x is not None and y is not None:
            best, cost = out[at], x[0] + y[0]
            if best is None or cost < best[0]:
                out[at] = (cost, x[1] + y[1])
            elif cost == best[0]:
                out[at] = min(best, (cost, x[1] + y[1]))
    return tuple(out)


@lru_cache(maxsize=16)
def _insertions(costs: Costs) -> Cell:
    """The cheapest way from state to state by insertions alone, the empty one included."""
    steps = [(4 * p + q, (costs.insert, INSERT)) for letter in "ua" for p, q in STEPS[letter]]
    none = [(5 * p, (0, "")) for p in STATES]
    cell = _least(iter([*none, *steps]))
    for _ in STATES:
        cell = join_spans(cell, cell)
    return cell


@lru_cache(maxsize=256)
def row_cell(initial: str, must_go: bool, truncated: bool, costs: Costs) -> Cell:
    """The span of one row, closed under insertions."""
    edits = [(5 * p, (costs.delete, DELETE)) for p in STATES]
    if not must_go:
        edits += [(4 * p + q, (costs.truncated * truncated, KEEP)) for p, q in STEPS.get(initial, [])]
        edits += [(4 * p + q, (costs.rerole + costs.truncated * truncated, REROLE)) for letter in "ua" for p, q in STEPS[letter]]
    around = _insertions(costs)
    return join_spans(join_spans(around, _least(iter(edits))), around)


@lru_cache(maxsize=1 << 16)
def chart(rows: tuple[tuple[str, bool, bool], ...], costs: Costs) -> Cell:
    """The cell of all rows: every span, by length, with every split. Blocks of equal rows are parsed once."""
    n = len(rows)
    cells = {(i, i + 1): row_cell(*row, costs) for i, row in enumerate(rows)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            j = i + length
            splits = [join_spans(cells[i, k], cells[k, j]) for k in range(i + 1, j)]
            cells[i, j] = tuple(min((c[at] for c in splits if c[at] is not None), default=None) for at in range(16))
    return cells[0, n]


class Spans:
    """Cells of neighbouring spans, joined as their lengths become equal."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Cell]] = []

    def add(self, length: int, cell: Cell) -> None:
        while self.stack and self.stack[-1][0] <= length:
            before, left = self.stack.pop()
            length, cell = before + length, join_spans(left, cell)
        self.stack.append((length, cell))

    def whole(self) -> tuple[int, Cell]:
        length, cell = self.stack.pop()
        while self.stack:
            before, left = self.stack.pop()
            length, cell = before + length, join_spans(left, cell)
        return length, cell


def best(cell: Cell) -> tuple[int, str]:
    return min(found for found in (cell[q] for q in ACCEPTED) if found is not None)


_SPAN = "conv long, place long, rows long, first string, last string, illegal long, costs array<int>, audits array<string>"
_LEGAL = ("su", "ua", "au")


def _spans(rows: DataFrame, costs: Costs, symbols: bool) -> DataFrame:
    """One span for each conversation and partition; rows (or spans, if symbols is False) lie in order of conv and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("rows", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("costs", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))])
        spans, block, head, last, illegal, open_ = Spans(), [], None, "", 0, False

        def closed() -> dict:
            if block:
                spans.add(len(block), chart(tuple(block), costs))
                block.clear()
            n, cell = spans.whole()
            return {"conv": head["conv"], "place": head["place"], "rows": n, "first": head["first"], "last": last, "illegal": illegal, "costs": [c and c[0] for c in cell], "audits": [c and c[1] for c in cell]}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not open_ or row["conv"] != head["conv"]:
                    if open_:
                        out.append(closed())
                    spans, head, illegal, open_ = Spans(), row, 0, True
                else:
                    illegal += last + row["first"] not in _LEGAL
                last = row["last"]
                if symbols:
                    block.append((row["first"], row["must_go"], row["truncated"]))
                    if len(block) == BLOCK:
                        spans.add(BLOCK, chart(tuple(block), costs))
                        block.clear()
                else:
                    illegal += row["illegal"]
                    spans.add(row["rows"], tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])))
            yield pa.RecordBatch.from_pylist(out, schema)
        if open_:
            yield pa.RecordBatch.from_pylist([closed()], schema)

    return rows.mapInArrow(run, _SPAN)


def _last(text: Column) -> Column:
    """Its last character that is no white space; empty if there is none."""
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))


def _messages(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    named = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
    return named.withColumn("digest", F.unhex(F.sha2("text", 256)))


def faults(messages: DataFrame) -> DataFrame:
    """conv, place (grows with the order of a conversation), turn, initial, blank, duplicate, truncated; no text."""
    last = _last(F.col("text"))
    narrow = messages.select("conv", "turn", "role", "digest", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    ordered = narrow.orderBy("conv", F.asc_nulls_first("turn"), "role", "digest").withColumn("place", F.monotonically_increasing_id())
    ordered = materialise(ordered, "repair-rows")
    firsts = ordered.groupBy("conv", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    rows = ordered.join(firsts, "place", "left")
    duplicate = ~F.col("blank") & F.col("is_first").isNull()
    truncated = ~F.col("blank") & F.col("is_first").isNotNull() & F.col("open")
    return rows.select("conv", "place", "turn", F.substring("role", 1, 1).alias("initial"), "blank", duplicate.alias("duplicate"), truncated.alias("truncated"))


@dataclass(frozen=True)
class Repaired:
    #: conv, rows, gaps, blank, duplicate, truncated, illegal, cost, audit: one row for each conversation.
    verdicts: DataFrame
    #: conv, place, edit, role, text: what is kept or inserted. A conversation lies in one partition, in order.
    messages: DataFrame


def repair(rows: DataFrame, costs: Costs = Costs(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """The cheapest repair of each conversation."""
    bounded_batches(rows.sparkSession)
    messages = _messages(rows, conv, turn, role, text)
    found = materialise(faults(messages), "repair-faults")
    symbols = found.select("conv", "place", F.col("initial").alias("first"), F.col("initial").alias("last"), (F.col("blank") | F.col("duplicate")).alias("must_go"), "truncated")
    ranges = symbols.repartitionByRange("conv", "place").sortWithinPartitions("conv", "place")
    spans = _spans(ranges, costs, symbols=True).repartition("conv").sortWithinPartitions("conv", "place")
    parsed = materialise(_spans(spans, costs, symbols=False), "repair-spans")
    ends = F.array_min(F.filter(F.array(*[F.struct(F.get("costs", q).alias("cost"), F.get("audits", q).alias("audit")) for q in ACCEPTED]), lambda c: c["cost"].isNotNull()))
    parsed = parsed.select("conv", "rows", "illegal", ends.alias("best")).select("conv", "rows", "illegal", F.col("best.cost").cast("long").alias("cost"), F.col("best.audit").alias("audit"))
    turns = found.groupBy("conv", "turn").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    both = counts.alias("c").join(parsed.alias("p"), F.col("c.conv").eqNullSafe(F.col("p.conv")))
    verdicts = materialise(both.select("c.*", "p.rows", "p.illegal", "p.cost", "p.audit"), "repair-verdicts")
    return Repaired(verdicts, _apply(messages, verdicts.select("conv", "audit")))


def _apply(messages: DataFrame, audits: DataFrame) -> DataFrame:
    """The messages that the audits leave or insert; audits and rows pass as one stream of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        conv, audit, at, end, place, system = None, "", 0, 0, 0, 0

        def role() -> str:
            return ROLES[(place - system) % 2]

        for batch in batches:
            out = []

            def put(edit: str, role: str, text: str) -> None:
                nonlocal place
                out.append((conv, place, edit, role, text))
                place += 1

            def inserted() -> None:
                nonlocal at
                while at < len(audit) and audit[at] == INSERT:
                    put(INSERT, role(), "")
                    at += 1

            for c, is_row, own, text in zip(*[batch.column(x).to_pylist() for x in ("conv", "is_row", "role", "text")]):
                if not is_row:
                    conv, audit, at, place, system = c, text, 0, 0, 0
                    end = 1 + max(audit.rfind(edit) for edit in (KEEP, REROLE, DELETE))
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == KEEP:
                    system += place == 0 and own[0] == "s"
                    put(KEEP, own, text)
                elif edit == REROLE:
                    put(REROLE, role(), text)
                if at == end:
                    inserted()  # after the last row
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    heads = audits.select("conv", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    both = heads.unionByName(messages.select("conv", F.lit(True).alias("is_row"), "turn", "role", "digest", "text"))
    lying = both.repartition("conv").sortWithinPartitions("conv", "is_row", F.asc_nulls_first("turn"), "role", "digest")
    return lying.select("conv", "is_row", "role", "text").mapInArrow(run, "conv long, place long, edit string, role string, text string")


def digests(messages: DataFrame) -> DataFrame:
    """conv, sha256 of the lines role:text of each conversation; messages as repair gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, total = None, None
        for batch in batches:
            out = []
            for c, place, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv", "place", "role", "text")]):
                if place == 0:
                    if total is not None:
                        out.append((conv, total.hexdigest()))
                    conv, total = c, hashlib.sha256()
                else:
                    total.update(b"\n")
                total.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["conv", "sha256"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([total.hexdigest()])], ["conv", "sha256"])

    return messages.mapInArrow(run, "conv long, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the checksum of their key asks for: conv_id, turn, role, text."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(text_of("role"))
    rows = conversations.withColumn("fault", fault).where("fault <> 0")
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair, with digests of the repaired text."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found.verdicts.alias("v"), every["conv_id"].eqNullSafe(F.col("v.conv")), "left")
    out = out.join(digests(found.messages).alias("d"), every["conv_id"].eqNullSafe(F.col("d.conv")), "left")
    zeros = [F.coalesce(f"v.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("v.audit", F.lit("")).alias("audit"), F.coalesce("d.sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
