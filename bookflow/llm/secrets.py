"""Secret scanning: fixed patterns, and guess-cost dynamic programming on values in a credential's context.

Base spans (kinds assign, access, hex) are regular-expression matches, leftmost and non-overlapping within
a kind, whose length qualifies. The method adds spans of kind guess: a value that stands where a credential
would (after a credential word and a separator, or as the password of a URL) is segmented at the least
total guess cost into dictionary words (by rank, with a factor for capitals and for letters written as
digits), dates, sequences, repeats, keyboard walks and brute-force characters. A value that costs at least
`THRESHOLD` powers of ten is a secret; words, dates and placeholders are cheap and stay. A value that one
base span, or one added before, holds whole adds nothing; one that goes beyond is costed whole and added. Cost adds up left to right, so a value of any length takes time in proportion to it.

Rules: null text is empty text; spans are code-point offsets, end exclusive, by start, then kind as
listed, then end; repeated rows get a row each; other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

KINDS = ("assign", "access", "hex", "guess")
THRESHOLD = 10.0

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run that is too short holds no other match
_CONTEXT = re.compile(r"""(?ai)(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|(?:access|private|client|secret)[ _-]?key|credentials?|auth|bearer|login)["']?(?:\x20*(?:[:=]|->|=>)\x20*|\x20+is\x20+|(?<=bearer)\x20+)["']?([^\s"'<>,;]{6,})""")
_URL = re.compile(r"://[^\s/:@]+:([^\s/:@]{4,})@")
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login")

#: Key rows of a keyboard, letters that digits and signs stand for.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


def _neighbours() -> dict[str, str]:
    """Keys that touch: beside each other in a row, or in the next row at the same or the previous place."""
    out: dict[str, set[str]] = {c: set() for row in _ROWS for c in row}
    for r, row in enumerate(_ROWS):
        for k, c in enumerate(row):
            for rr, kk in ((r, k + 1), (r + 1, k), (r + 1, k - 1)):
                shift = -1 if rr == 1 and r == 0 else 0
                if rr < len(_ROWS) and 0 <= kk + shift < len(_ROWS[rr]):
                    d = _ROWS[rr][kk + shift]
                    out[c].add(d)
                    out[d].add(c)
    return {c: "".join(sorted(s)) for c, s in out.items()}


_NEXT = _neighbours()


def dictionary(path: str) -> dict[str, float]:
    """log10 rank of each word of three letters or more in a tokenizers file with end-of-word marks; its ids follow frequency."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    words = [t[: -len(end)] for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1]) if t.endswith(end)]
    words = [w for w in words if len(w) >= 3 and w.isascii() and w.isalpha()]
    return {w: math.log10(k + 2) for k, w in enumerate(words)}


def _brute(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isascii():
        return math.log10(26) if c.isalpha() else math.log10(33)
    return 2.5


def guess_cost(value: str, words: dict[str, float], longest: int = 20) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses that the cheapest segmentation takes, and its segments (kind, start, end)."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(_LEET)
    best: list[float] = [0.0] + [math.inf] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)

    def offer(kind: str, a: int, b: int, cost: float) -> None:
        if best[a] + cost < best[b]:
            best[b], back[b] = best[a] + cost, (kind, a)

    # how far a sequence, a walk and a repeat with each unit go on from each place; turns of a walk so far
    run, walk, turns = [n] * (n + 1), [n] * (n + 1), [0] * (n + 1)
    steps = [ord(y) - ord(x) for x, y in zip(low, low[1:])]
    for a in range(n - 2, -1, -1):
        run[a] = a + 1 if abs(steps[a]) != 1 else run[a + 1] if a + 2 < n and steps[a + 1] == steps[a] else a + 2
        walk[a] = walk[a + 1] if low[a + 1] in _NEXT.get(low[a], "") else a + 1
    for a in range(2, n):
        turns[a] = turns[a - 1] + (steps[a - 1] != steps[a - 2])
    same = [[0] * (n + 1) for _ in range(9)]
    for unit in range(1, 9):
        for a in range(n - unit - 1, -1, -1):
            same[unit][a] = same[unit][a + 1] + 1 if value[a] == value[a + unit] else 0

    for a in range(n):
        offer("brute", a, a + 1, _brute(value[a]) + (0.3 if back[a][0] != "brute" and a else 0.0))
        for b in range(a + 3, min(n, a + longest) + 1):
            rank = words.get(plain[a:b])
            if rank is not None:
                part = value[a:b]
                capitals = sum(c.isupper() for c in part)
                odd = min(capitals, b - a - capitals) if capitals > 1 and capitals < b - a else bool(capitals)
                offer("word", a, b, rank + 0.3 + 0.3 * odd + 0.3 * sum(x != y for x, y in zip(low[a:b], plain[a:b])))
        if found := _DATE.match(value, a):
            offer("date", a, found.end(), (2.2 if found.end() - a == 4 else 4.6) + 0.3)
        b = run[a]
        if b - a >= 3:
            offer("sequence", a, b, 1.5 + math.log10(b - a))
        b = walk[a]
        if b - a >= 4:
            offer("walk", a, b, math.log10(47) + math.log10(b - a) + 0.6 * (turns[b - 1] - turns[a + 1]))
        for unit in range(1, min(8, n - a) + 1):
            times = same[unit][a] // unit + 1
            if times * unit >= 3 and times > 1:
                inner = sum(map(_brute, value[a : a + unit]))
                inner = min(inner, words.get(plain[a : a + unit], math.inf))
                offer("repeat", a, a + times * unit, inner + math.log10(times) + 0.3)
    parts, b = [], n
    while b > 0:
        kind, a = back[b]
        if kind == "brute" and parts and parts[-1][0] == "brute":
            parts[-1] = ("brute", a, parts[-1][2])
        else:
            parts.append((kind, a, b))
        b = a
    return best[n], parts[::-1]


def scan(text: str | None, words: dict[str, float], threshold: float = THRESHOLD) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, cost) of a text's secrets, in order."""
    text, low = text or "", (text or "").lower()
    found: list[tuple[str, int, int, float | None]] = []
    if any(k in low for k in ("password", "passwd", "secret", "token", "api")):
        found += [("assign", *m.span(), None) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), None) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span(), None) for m in _HEX.finditer(text)]
    values = []
    if any(h in low for h in _HINTS):
        values += [m.span(1) for m in _CONTEXT.finditer(text)]
    if "://" in text:
        values += [m.span(1) for m in _URL.finditer(text)]
    taken = list(found)
    for a, b in sorted(set(values)):
        while b > a and text[b - 1] in ".:!?)":
            b -= 1
        if not any(x <= a and b <= y for _, x, y, _ in taken) and (cost := guess_cost(text[a:b], words)[0]) >= threshold:
            taken.append(("guess", a, b, cost))
    return sorted(taken, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, words: dict[str, float], mark: str = "[SECRET]") -> str:
    """The text with every secret, overlapping ones together, replaced by the mark."""
    out, at, end = [], 0, 0
    for _, a, b, _ in scan(text, words):
        if a < end:
            end = max(end, b)
            continue
        out += [text[at:end] and mark, text[end:a]] if end else [text[:a]]
        at, end = a, b
    return "".join([*out, mark, text[end:]]) if end else text


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,cost:double>>"


def find(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) of every row; cost is the log10 guess cost of guess spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))
        for b in slices(batches):
            rows = [[dict(zip(("kind", "start", "end", "cost"), s)) for s in scan(t, words, threshold)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SPANS)


def redact(docs: DataFrame, vocabulary: str, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of docs, all their columns, with secrets masked in the text and, where there is such a column, the characters counted anew."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(vocabulary)
        for b in slices(batches, text_col):
            clean = pa.array([None if t is None else redacted(t, words) for t in b.column(text_col).to_pylist()], pa.string())
            k = b.schema.get_field_index(text_col)
            yield pa.RecordBatch.from_arrays([clean if i == k else c for i, c in enumerate(b.columns)], b.schema.names)

    done = docs.mapInArrow(run, schema)
    return done.withColumn(chars_col, F.length(text_col).cast(schema[chars_col].dataType)) if chars_col in docs.columns else done


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = find(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = said(F.filter("spans", lambda s: s.kind != "guess"))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), of("guess").alias("n_guess"))
