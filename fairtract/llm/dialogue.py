"""Repair of conversations: weighted CYK parsing of the roles of their turns.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles. The
automaton of that pattern has four states, and the repair grammar in Chomsky
normal form has a symbol ``N(p, q)`` for each two of them: what leads from
``p`` to ``q``. ``N(p, r) -> N(p, q) N(q, r)`` joins neighbouring spans, and
``N(p, q) -> row`` keeps, reroles or deletes one row. Insertions derive from
the empty span; their closure is put around every row. A cell of a span is the
least (cost, audit) of a symbol. Equal costs never have one audit begin
another, as the letters fix the cost, so least audits stay least when spans are
joined. A symbol over a span may be split at any place, so spans are joined
pairwise, bottom up by length, within a slice of rows first and then over the
slices of a conversation: a conversation of any length is spread over tasks.

Order: rows of a conversation go by turn, nulls first, rows of one turn by a
digest of role and text. A null role or text counts as one space, and a null
conv_id is a conversation of its own. Equal rows beyond the first are duplicates.
An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract.llm.storage import stage

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Moves of the automaton by the initial of a role.
MOVES = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
FINAL = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: White space of the fault rules.
SPACES = " \t\n\x0b\x0c\r"

Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]


def _least(cells: Cells, symbol: tuple[int, int], cost: int, *audit: str) -> None:
    old = cells.get(symbol)
    if old is None or cost < old[0]:
        cells[symbol] = (cost, "".join(audit))
    elif cost == old[0]:
        joined = "".join(audit)
        if joined < old[1]:
            cells[symbol] = (cost, joined)


@cache
def insertions() -> Cells:
    """The cells of the empty span: the cheapest insertions between any two states."""
    cells: Cells = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, q), (cost, audit) in list(cells.items()):
            for initial in ROLES:
                for a, b in MOVES[initial]:
                    if a == q:
                        _least(cells, (p, b), cost + INSERT, audit, "I")
    return cells


@cache
def row_cells(initial: str, gone: bool, cut: bool) -> Cells:
    """The cells of one row, with insertions on both sides. ``gone`` rows must be deleted."""
    bare: Cells = {(p, p): (DELETE, "D") for p in STATES}
    if not gone:
        extra = CUT if cut else 0
        for target, moves in MOVES.items():
            for move in moves:
                if target == initial:
                    _least(bare, move, extra, "K")
                if target in ROLES:
                    _least(bare, move, REROLE + extra, "R")
    return join(join(insertions(), bare), insertions())


def join(left: Cells, right: Cells) -> Cells:
    """The cells of two neighbouring spans taken as one."""
    cells: Cells = {}
    for (p, q), (cost, audit) in left.items():
        for r in STATES:
            other = right.get((q, r))
            if other is not None:
                _least(cells, (p, r), cost + other[0], audit, other[1])
    return cells


def parse(spans: list[Cells]) -> Cells:
    """The cells of neighbouring spans as one, joined in pairs from the shortest spans up."""
    while len(spans) > 1:
        longer = [join(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = longer + spans[2 * len(longer) :]
    return spans[0] if spans else insertions()


def cheapest(cells: Cells) -> Cell:
    return min(cells[START, q] for q in FINAL if (START, q) in cells)


def _or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def prepare(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with nulls of role and text as one space."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"), _or_space("text").alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that their checksum asks for; ``dropped`` rows only show that their conversation exists.

    The checksum is that of ``conv_id:turn``, a null being one space.
    """
    kind = F.crc32(F.concat_ws(":", _or_space("conv_id"), _or_space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = prepare(conversations).withColumn("kind", kind)
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("copy")
    ).drop("copy")


def _with_digest(rows: DataFrame) -> DataFrame:
    named = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("digest", F.sha2(named, 256))


def _facts(rows: DataFrame) -> DataFrame:
    """What the parser needs of each row, in order, cut into slices: a stored table without texts."""
    bare = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    facts = _with_digest(rows).select(
        "conv_id",
        "turn",
        "dropped",
        "digest",
        F.when(initial.isin(list(MOVES)), initial).otherwise("").alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    sliced = facts.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = sliced.select("*", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("position"))
    return stage(placed, "turns")


_SPAN = T.StructType(
    [
        T.StructField("blank", T.LongType()),
        T.StructField("duplicate", T.LongType()),
        T.StructField("truncated", T.LongType()),
        T.StructField("illegal", T.LongType()),
        T.StructField("turns", T.LongType()),
        T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()),
        T.StructField("symbols", T.ArrayType(T.IntegerType())),
        T.StructField("costs", T.ArrayType(T.LongType())),
        T.StructField("audits", T.ArrayType(T.StringType())),
    ]
)
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "rows")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Sorted rows as (key, rows) by runs of equal keys, over the bounds of batches."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return itertools.groupby(rows, lambda row: tuple(row[k] for k in keys))


def _emit(rows: Iterator[dict], schema: pa.Schema, size: int = 2_000, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows; audits of very long conversations make a batch end early."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += sum(map(len, row.get("audits") or ())) + len(row.get("audit") or "")
        if len(out) == size or held > most:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _packed(cells: Cells) -> dict:
    return {
        "symbols": [4 * p + q for p, q in cells],
        "costs": [cost for cost, _ in cells.values()],
        "audits": [audit for _, audit in cells.values()],
    }


def _unpacked(row: dict) -> Cells:
    return {divmod(s, 4): (cost, audit) for s, cost, audit in zip(row["symbols"], row["costs"], row["audits"])}


def _span(rows: Iterator[dict]) -> dict:
    """One slice of a conversation: counts of faults, its turns and ends, and its cells."""
    found = dict.fromkeys(_COUNTS, 0) | {"low": None, "high": None, "first": None, "last": None}
    cells = []
    for row in rows:
        if row["dropped"]:
            continue
        fault = "blank" if row["blank"] else "duplicate" if row["repeated"] else "truncated" if row["cut"] else None
        if fault:
            found[fault] += 1
        if found["rows"]:
            found["illegal"] += found["last"] + row["initial"] not in LEGAL
        else:
            found["first"] = row["initial"]
        found["rows"] += 1
        found["last"] = row["initial"]
        turn = row["turn"]
        if turn is not None and turn != found["high"]:
            found["turns"] += 1
            found["low"] = turn if found["low"] is None else found["low"]
            found["high"] = turn
        cells.append(row_cells(row["initial"], fault in ("blank", "duplicate"), fault == "truncated"))
    return found | _packed(parse(cells))


def _joined(spans: Iterator[dict]) -> dict:
    """All slices of a conversation as one result."""
    found = dict.fromkeys(_COUNTS, 0) | {"low": None, "high": None, "last": None}
    cells = []
    for span in spans:
        if not span["rows"]:
            continue
        for name in _COUNTS:
            found[name] += span[name]
        if found["last"] is not None:
            found["illegal"] += found["last"] + span["first"] not in LEGAL
        if span["low"] is not None:
            found["turns"] -= found["high"] == span["low"]
            found["low"] = span["low"] if found["low"] is None else found["low"]
            found["high"] = span["high"]
        found["last"] = span["last"]
        cells.append(_unpacked(span))
    cost, audit = cheapest(parse(cells))
    gaps = 0 if found["low"] is None else found["high"] - found["low"] + 1 - found["turns"]
    return {"gaps": gaps, "cost": cost, "audit": audit, **{k: found[k] for k in ("blank", "duplicate", "truncated", "illegal")}}


_VERDICT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation: ``gaps`` in its turns, counts of faulty rows and of ``illegal`` neighbours, the least ``cost``
    and the ``audit`` of the cheapest edits, a letter each: Keep, Rerole, Delete, Insert.

    ``rows`` has ``conv_id, turn, role, text, dropped``.
    """
    facts = _facts(rows)
    present = facts.where("not dropped")
    firsts = present.groupBy("conv_id", "digest").agg(F.min("position").alias("position")).select("position", F.lit(False).alias("repeated"))
    judged = facts.drop("digest").join(firsts, "position", "left").withColumn("repeated", F.coalesce("repeated", F.lit(True)))
    key = facts.schema["conv_id"]
    spans = T.StructType([key, T.StructField("slice", T.IntegerType()), *_SPAN.fields])
    verdicts = T.StructType([key, *T.StructType.fromDDL(_VERDICT).fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _groups(batches, ["conv_id", "slice"])
        return _emit(({"conv_id": c, "slice": s, **_span(g)} for (c, s), g in groups), _arrow(spans))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _groups(batches, ["conv_id"])
        return _emit(({"conv_id": c, **_joined(g)} for (c,), g in groups), _arrow(verdicts))

    sliced = judged.repartition("conv_id", "slice").sortWithinPartitions("conv_id", "slice", "position")
    folded = sliced.mapInArrow(fold, spans)
    return folded.repartition("conv_id").sortWithinPartitions("conv_id", "slice").mapInArrow(combine, verdicts)


def _lines(audit: str, rows: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    """``edit, role, text`` of each row that the audit leaves, inserted ones included."""
    # An odd number of rows begins with a system row, at place -1.
    place = -((len(audit) - audit.count("D")) % 2)
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        role = row["role"] if edit == "K" else ROLES["ua"[place % 2]]
        yield edit, role, row["text"] if row else ""
        place += 1


def _in_order(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each conversation's verdict, then its rows in the parser's order.

    One task reads the rows of a conversation one after the other; it holds
    the audit, but never the rows.
    """
    texts = _with_digest(rows.where("not dropped")).withColumn("is_row", F.lit(True))
    both = verdicts.withColumn("is_row", F.lit(False)).unionByName(texts.drop("dropped"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", F.col("turn").asc_nulls_first(), "digest")


def repaired(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, edit, role, text``, places from 0."""
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL("place long, edit string, role string, text string").fields])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for (c,), group in _groups(batches, ["conv_id"]):
            verdict = next(group)
            for i, (edit, role, text) in enumerate(_lines(verdict["audit"], group)):
                yield {"conv_id": c, "place": i, "edit": edit, "role": role, "text": text}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(lines(batches), _arrow(schema), 500)

    return _in_order(rows, verdicts).mapInArrow(write, schema)


def repair(rows: DataFrame) -> DataFrame:
    """``audits`` of every conversation with ``repaired_sha256``, the digest of its repaired ``role:text`` lines."""
    verdicts = audits(rows)
    names = verdicts.columns
    schema = T.StructType([*verdicts.schema.fields, T.StructField("repaired_sha256", T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, group in _groups(batches, ["conv_id"]):
            verdict = next(group)
            digest = hashlib.sha256()
            for i, (_, role, text) in enumerate(_lines(verdict["audit"], group)):
                digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
            yield {name: verdict[name] for name in names} | {"repaired_sha256": digest.hexdigest()}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(hashed(batches), _arrow(schema))

    return _in_order(rows, verdicts).mapInArrow(write, schema)
