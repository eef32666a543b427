"""Conversation repair by a min-plus scan of turn matrices.

A conversation is well formed if its roles' initials read `(s?(ua)+)?`. That language has four states: nothing
read, after the system turn, after a user turn, after an assistant turn. A turn is a 4 x 4 matrix whose cell (i, j) is
the cheapest edit that leads from state i to state j: keep (0), give it the role user or assistant (3), delete
(4). A cell is a pair (cost, audit), the audit being the edits' initials. Cells add by concatenation and meet by
the least cost, then the audit first in ASCII order; inserting an empty turn (3, `I`) anywhere is the closure that
each matrix is multiplied by. Two audits of one cost over the same turns are never prefixes of each other, as each further
insert costs, so the least audit stays least whatever follows and the product is associative.

So turns need no state carried from the start of a conversation. They are range-sorted by conversation and turn, a
partition reduces each stretch of a conversation to one matrix (equal stretches of eight turns once, by a tree), and
the few stretches that a partition border cuts meet in a tree of 16 partials a task, in Spark. A conversation of
any length is so repaired by many tasks. The audits then run along the turns in order, which gives the repaired turns;
only a digest over a whole conversation, a serial function, reads it in one task, streaming.

Faults, of which each turn's first counts: `blank` (nothing but white space), `duplicate` (role and text stood in an
earlier turn of the conversation), `truncated` (its last character that is not white space is none of `.!?`). Blank
and duplicate turns must be deleted; a truncated turn that stays costs 3 more.

Rules: a null role or text is one space; null conversations are one conversation; null turns come first; turns of one
number are ordered by role, then by the SHA-256 of the text, then by row (which differs only for equal rows); an empty role
has no legal initial; a conversation all of whose turns were dropped has zeros and an empty audit; other columns are ignored;
an empty table gives an empty table. Gaps beyond a long are held at its limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialize, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Which states each initial joins.
MOVES = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
SPACE = " \t\n\x0b\x0c\r"
FAN, LEAF = 16, 8

Matrix = tuple  # of 16 cells by rows, each None or (cost, audit)


def least(cells) -> tuple | None:
    return min((c for c in cells if c is not None), default=None)


def times(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for i in (0, 4, 8, 12):
        for j in range(4):
            best = None
            for k in range(4):
                x, y = a[i + k], b[4 * k + j]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is None or cost <= best[0]:
                    audit = x[1] + y[1]
                    if best is None or (cost, audit) < best:
                        best = cost, audit
            out.append(best)
    return tuple(out)


def matrix(cells: dict) -> Matrix:
    return tuple(cells.get((i, j)) for i in range(4) for j in range(4))


ONE = matrix({(i, i): (0, "") for i in range(4)})


def _closure() -> Matrix:
    step = matrix({move: (INSERT, "I") for c in "ua" for move in MOVES[c]})
    out = tuple(least(x) for x in zip(ONE, step))
    while (more := times(out, out)) != out:
        out = more
    return out


CLOSURE = _closure()


@lru_cache(None)
def turn(kind: str) -> Matrix:
    """The matrix of a turn, inserts after it included. `-`: dropped, no turn; `!`: must go; else the initial (x: none of s, u, a), upper case if truncated."""
    if kind == "-":
        return CLOSURE
    cells = {(i, i): (DELETE, "D") for i in range(4)}
    if kind != "!":
        extra = TRUNCATED if kind.isupper() else 0
        for c, joined in MOVES.items():
            for move in joined:
                ways = [(KEEP + extra, "K")] if c == kind.lower() else []
                ways += [(REROLE + extra, "R")] if c != "s" else []
                if ways:
                    cells[move] = min(ways)
    return times(matrix(cells), CLOSURE)


@lru_cache(1 << 15)
def _leaf(kinds: str) -> Matrix:
    out = turn(kinds[0])
    for k in kinds[1:]:
        out = times(out, turn(k))
    return out


def product(kinds: str) -> Matrix:
    """The product of a stretch of turns, by a tree over leaves of eight."""
    level = [_leaf(kinds[i : i + LEAF]) for i in range(0, len(kinds), LEAF)] or [CLOSURE]
    while len(level) > 1:
        level = [times(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cheapest(whole: Matrix) -> tuple[int, str]:
    """Cost and audit of a conversation from the product of its turns."""
    row = times(CLOSURE, whole)
    return least((row[0], row[3]))


class Stretch:
    """What is known of successive turns of a conversation; stretches join associatively."""

    FIELDS = "rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<long>, audits array<string>"
    PENDING = 1 << 16

    def __init__(self):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.done, self.kinds = None, []

    def add(self, turn: int | None, kind: str, initial: str) -> None:
        if kind == "-":
            return
        self.rows += 1
        self.blank += kind == "b"
        self.duplicate += kind == "d"
        self.truncated += kind.isupper()
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.high = turn
            self.low = turn if self.low is None else self.low
        self.kinds.append("!" if kind in "bd" else kind)
        if len(self.kinds) >= self.PENDING:
            self.product()

    def product(self) -> Matrix:
        if self.kinds or self.done is None:
            new = product("".join(self.kinds))
            self.done, self.kinds = new if self.done is None else times(self.done, new), []
        return self.done

    def join(self, after: Stretch) -> Stretch:
        """This stretch with the next one."""
        if not self.rows or not after.rows:
            return self if self.rows else after
        self.done = times(self.product(), after.product())
        self.illegal += after.illegal + (self.last + after.first not in ("su", "ua", "au"))
        self.turns += after.turns - (after.low is not None and after.low == self.high)
        for k in ("rows", "blank", "duplicate", "truncated"):
            setattr(self, k, getattr(self, k) + getattr(after, k))
        self.last, self.low, self.high = after.last, after.low if self.low is None else self.low, self.high if after.high is None else after.high
        return self

    def values(self) -> list:
        m = self.product()
        return [self.rows, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.turns, [c and c[0] for c in m], [c and c[1] for c in m]]

    @classmethod
    def of(cls, row: dict) -> Stretch:
        s = cls()
        for k in ("rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns"):
            setattr(s, k, row[k])
        s.done = tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"]))
        return s

    def facts(self) -> dict:
        cost, audit = cheapest(self.product())
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ORDER = ["turn", "role", "digest", "row", "copy"]


def damage(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as they are after damage, dropped ones with `dropped` true and no text; `copy` tells a repeated turn's two rows apart."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    # the row's number is taken before turns repeat
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), lot.alias("lot"), F.monotonically_increasing_id().alias("row"))
    out = out.select("*", F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    changed = F.when(F.col("lot") <= 1, F.lit("")).when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return out.select("conv_id", "turn", F.when(F.col("lot") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"), "row", "copy", (F.col("lot") == 0).alias("dropped"))


def as_turns(rows: DataFrame) -> DataFrame:
    """Undamaged turns (conv_id, turn, role, text) in the form that damage() returns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.monotonically_increasing_id().alias("row"), F.lit(0).alias("copy"), F.lit(False).alias("dropped"))


def faults(turns: DataFrame) -> DataFrame:
    """The turns with `kind`: `-` dropped, `b` blank, `d` duplicate, else the role's initial (x if none of s, u, a), upper case if truncated."""
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    kind = F.when(F.col("dropped"), F.lit("-")).when(bare == "", F.lit("b")).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    turns = materialize(turns.select("*", kind.alias("kind"), initial.alias("initial"), F.unhex(F.sha2("text", 256)).alias("digest")))
    # most texts stand once: what is joined are the first of those that recur
    again = turns.where(~F.col("kind").isin("-", "b")).groupBy("conv_id", "role", "digest")
    again = again.agg(F.count("*").alias("n"), F.min(F.struct("turn", "row", "copy")).alias("first")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    out = turns.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.struct("turn", "row", "copy") > F.col("first")
    return out.withColumn("kind", F.when(later & ~F.col("kind").isin("-", "b"), F.lit("d")).otherwise(F.col("kind"))).drop("c", "r", "d", "first")


def _table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _arrow(conv: pa.DataType, rest: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([("conv_id", conv), *rest])


_PARTS = [
    ("part", pa.int64()),
    ("edge", pa.bool_()),
    *[(k, pa.int64()) for k in ("rows", "blank", "duplicate", "truncated", "illegal")],
    ("first", pa.string()),
    ("last", pa.string()),
    *[(k, pa.int64()) for k in ("low", "high", "turns")],
    ("costs", pa.list_(pa.int64())),
    ("audits", pa.list_(pa.string())),
]


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns -> a row for each conversation in the partition; `edge` marks the first and last, which may go on in other partitions."""
    part, schema, held, conv, run = TaskContext.get().partitionId(), None, [], None, None

    def out(edge: bool) -> None:
        held.append([conv, part, edge, *run.values()])

    def flush() -> pa.RecordBatch:
        cols = dict(zip(schema.names, map(list, zip(*held)))) if held else {n: [] for n in schema.names}
        held.clear()
        return _table(cols, schema)

    first = True
    for b in batches:
        schema = schema or _arrow(b.schema.field("conv_id").type, _PARTS)
        for c, t, kind, initial in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "kind", "initial"))):
            if run is None or c != conv:
                if run is not None:
                    out(first)
                    first = False
                conv, run = c, Stretch()
            run.add(t, kind, initial)
        if len(held) >= 4096:
            yield flush()
    if run is not None:
        out(True)
        yield flush()


def _join(parts: pa.Table) -> pa.Table:
    """Stretches of one conversation -> their product, under the number of their group."""
    rows = parts.sort_by("part").to_pylist()
    run = Stretch.of(rows[0])
    for r in rows[1:]:
        run = run.join(Stretch.of(r))
    row = [rows[0]["conv_id"], rows[0]["part"] // FAN, True, *run.values()]
    return pa.Table.from_batches([_table({n: [v] for n, v in zip(parts.schema.names, row)}, parts.schema)])


def stretches(turns: DataFrame) -> DataFrame:
    """A row for each conversation: its whole stretch. turns: as faults() returns them."""
    names = ["conv_id", "part", "edge", *[f.split()[0] for f in Stretch.FIELDS.split(", ")]]
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, part long, edge boolean, {Stretch.FIELDS}"
    placed = turns.select("conv_id", *ORDER, "kind", "initial").repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    parts = materialize(placed.select("conv_id", "turn", "kind", "initial").mapInArrow(_reduce, schema))
    edges = parts.where("edge")
    top = edges.agg(F.max("part")).first()[0] or 0
    while True:  # two edges a partition at most, so the tree's first level has few rows
        edges = edges.groupBy("conv_id", F.floor(F.col("part") / FAN)).applyInArrow(_join, schema)
        if top < FAN:
            break
        top //= FAN
    return parts.where("not edge").select(*names).union(edges.select(*names))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [Stretch.of(r).facts() for r in b.to_pylist()]
        yield _table({"conv_id": b.column("conv_id").to_pylist(), **{k.split()[0]: [g[k.split()[0]] for g in got] for k in FACTS.split(", ")}}, _arrow(b.schema.field("conv_id").type, [(k.split()[0], pa.string() if k.endswith("string") else pa.int64()) for k in FACTS.split(", ")]))


def report(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation. turns: as faults() returns them."""
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {FACTS}"
    return stretches(turns).mapInArrow(_facts, schema)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit, then its turns -> a row of facts (at -1), then the repaired turns."""
    names, schema, held, size = ("conv_id", "facts", "at", "edit", "role", "text"), None, [], 0
    conv = audit = facts = last = None
    at = step = 0

    def put(edit: str, role: str, text: str) -> None:
        nonlocal at, last, size
        held.append((conv, None, at, edit, role, text))
        at, last, size = at + 1, role[:1], size + len(text) + 64

    def turn_due() -> str:
        return "assistant" if last == "u" else "user"

    def inserts() -> None:
        nonlocal step
        while audit is not None and step < len(audit) and audit[step] == "I":
            put("I", turn_due(), "")
            step += 1

    def flush() -> pa.RecordBatch:
        nonlocal size
        cols = dict(zip(names, map(list, zip(*held)))) if held else {n: [] for n in names}
        held.clear()
        size = 0
        return _table(cols, schema)

    for b in batches:
        schema = schema or _arrow(b.schema.field("conv_id").type, [("facts", b.schema.field("facts").type), ("at", pa.int64()), *[(k, pa.string()) for k in ("edit", "role", "text")]])
        for c, facts, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "facts", "role", "text"))):
            if facts is not None:
                inserts()
                conv, audit, at, step, last = c, facts["audit"], 0, 0, None
                held.append((conv, facts, -1, None, None, None))
                size += len(audit) + 128
            else:
                inserts()
                edit = audit[step]
                step += 1
                if edit != "D":
                    put(edit, turn_due() if edit == "R" else role, text)
            if size > SLICE_BYTES:
                yield flush()
        if schema is not None:
            yield flush()
    if schema is not None:
        inserts()
        yield flush()


def _repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, facts, at, edit, role, text), conversations whole and in order within a partition: a row with its facts (at -1), then its repaired turns."""
    facts = report(turns).select("conv_id", F.struct(*[k.split()[0] for k in FACTS.split(", ")]).alias("facts"))
    empty = [F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in (*ORDER, "text")]
    rows = turns.where("kind <> '-'").select("conv_id", F.lit(None).cast(facts.schema["facts"].dataType).alias("facts"), *ORDER, "text")
    both = facts.select("conv_id", "facts", *empty).union(rows)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("facts").isNull(), *ORDER)
    conv = turns.schema["conv_id"].dataType.simpleString()
    return both.select("conv_id", "facts", "role", "text").mapInArrow(_walk, f"conv_id {conv}, facts struct<{FACTS.replace(' ', ':').replace(',:', ',')}>, at long, edit string, role string, text string")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, at, edit, role, text) of conversations (conv_id, turn, role, text): at counts from 0, edit is K, R or I."""
    return _repaired(materialize(faults(as_turns(rows)))).where("at >= 0").select("conv_id", "at", "edit", "role", "text")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [k.split()[0] for k in FACTS.split(", ")]
    schema, held, hashed = None, [], None

    def close() -> None:
        if hashed is not None:
            held[-1].append(hashed.hexdigest())

    def flush(whole: bool) -> pa.RecordBatch:
        """The rows that are closed; the last one may go on."""
        done = held[:] if whole else held[:-1]
        del held[: len(done)]
        cols = dict(zip(schema.names, map(list, zip(*done)))) if done else {n: [] for n in schema.names}
        return _table(cols, schema)

    for b in batches:
        schema = schema or _arrow(b.schema.field("conv_id").type, [*((k, pa.string() if k == "audit" else pa.int64()) for k in names), ("repaired_sha256", pa.string())])
        for c, facts, at, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "facts", "at", "role", "text"))):
            if facts is not None:
                close()
                held.append([c, *(facts[k] for k in names)])
                hashed = hashlib.sha256()
            else:
                hashed.update(("\n" * (at > 0) + f"{role}:{text}").encode())
        yield flush(False)
    if hashed is not None:
        close()
        yield flush(True)


def digests(turns: DataFrame) -> DataFrame:
    """report() with repaired_sha256, the SHA-256 of a conversation's repaired `role:text` lines."""
    turns = materialize(faults(turns))
    return _repaired(turns).mapInArrow(_digest, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {FACTS}, repaired_sha256 string")


def op13(spark, sf_dir: str) -> DataFrame:
    return digests(damage(table(spark, sf_dir, "conversations")))
