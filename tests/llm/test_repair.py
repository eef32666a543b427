import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from bookflow.llm import repair as R

FORM = re.compile("(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        if lot:
            out += [(c, t, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def brute(rows):
    """By an automaton over (row, state) with memory, the audits compared as whole strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, kinds, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        bare = text.rstrip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            n[fault] += 1
        kinds.append((role, text, fault))
    step = lambda state, c: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, c))

    @lru_cache(None)
    def best(k, state, inserts):
        ways = []
        if k == len(kinds):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text, fault = kinds[k]
            extra = 3 * (fault == "truncated")
            todo = [(4, "D", state, None)]
            if fault in ("", "truncated"):
                todo.append((extra, "K", step(state, role[:1]), (role, text)))
                todo += [(3 + extra, "R", step(state, r[0]), (r, text)) for r in ("user", "assistant")]
            for cost, edit, to, line in todo:
                if to is not None and (rest := best(k + 1, to, 0)):
                    ways.append((cost + rest[0], edit + rest[1], (line, *rest[2]) if line else rest[2]))
        if inserts < 2:
            for r in ("user", "assistant"):
                if (to := step(state, r[0])) is not None and (rest := best(k, to, inserts + 1)):
                    ways.append((3 + rest[0], "I" + rest[1], ((r, ""), *rest[2])))
        return min(ways) if ways else None

    cost, audit, lines = best(0, "", 0)
    assert FORM.fullmatch("".join(r[:1] for r, _ in lines))
    turns = {t for _, t, _, _ in rows if t is not None}
    initials = [r[:1] for r, _, _ in kinds]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **n,
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    }


def check(got, rows):
    by = {c: [] for c, *_ in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    assert sorted(map(str, (r.conv_id for r in got))) == sorted(map(str, by))
    for r in got:
        want = brute(by[r.conv_id])
        assert {k: r[k] for k in want} == want, (r.conv_id, by[r.conv_id])


def test_products_equal_the_cheapest_of_all_edits():
    """Every edit string with up to two inserts between turns, for every short row of kinds."""
    letters = {"s": "s", "u": "u", "a": "a", "S": "s", "A": "a", "x": "x", "!": "!"}

    def all_ways(kinds):
        gaps = [[""] + ["I"] + ["II"]] * (len(kinds) + 1)
        edits = [["D"] if k == "!" else ["K", "Ru", "Ra", "D"] for k in kinds]
        for between in itertools.product(*gaps):
            for chosen in itertools.product(*edits):
                cost, audit, roles = 0, "", ""
                for k, (ins, e) in enumerate(itertools.zip_longest(between, chosen)):
                    for _ in ins:
                        cost, audit, roles = cost + 3, audit + "I", roles + "?"
                    if e is not None:
                        cost += {"K": 0, "R": 3, "D": 4}[e[0]] + 3 * (kinds[k].isupper() and e != "D")
                        audit += e[0]
                        roles += "" if e == "D" else letters[kinds[k]] if e == "K" else e[1]
                for fill in itertools.product("ua", repeat=roles.count("?")):
                    it = iter(fill)
                    if FORM.fullmatch("".join(next(it) if c == "?" else c for c in roles)):
                        yield cost, audit

    for n in range(3):
        for kinds in itertools.product(letters, repeat=n):
            assert R.cheapest(R.product("".join(kinds))) == min(all_ways(kinds)), kinds


def test_the_product_is_associative():
    r = random.Random(3)
    for _ in range(60):
        a, b, c = (R.product("".join(r.choices("suaxSUAX!-", k=r.randrange(1, 12)))) for _ in range(3))
        assert R.times(R.times(a, b), c) == R.times(a, R.times(b, c))


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(R.op13(spark, sf).collect(), rows)


def test_nulls_ties_repeats_and_strange_rows(spark, monkeypatch):
    r = random.Random(5)
    texts = [None, "", " \t", "Yes.", "no", "Why?  ", "… wait!\n", "x" * 50_000 + ".", "ja."]
    rows = [(r.choice([None, *range(40)]), r.choice([None, 0, 1, 2, 3, 5, 9, -4]), r.choice([None, "user", "assistant", "system", "tool", "", "user"]), r.choice(texts)) for _ in range(260)]
    rows += [(99, k, "user" if k % 2 else "assistant", f"turn {k % 50}.") for k in range(300)]
    table = spark.createDataFrame([(*x, "clash", 7) for x in rows], "conv_id long, turn long, role string, text string, kind string, digest int")
    monkeypatch.setattr(R, "table", lambda *_: table.repartition(5))
    check(R.op13(spark, "").collect(), rows)
    monkeypatch.setattr(R, "table", lambda *_: table.limit(0))
    assert R.op13(spark, "").collect() == []


@pytest.mark.parametrize("partitions", [1, 70])
def test_a_conversation_over_many_partitions(spark, partitions):
    r = random.Random(7)
    rows = [(1, k, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["a.", "b", "", f"text {k}."])) for k in range(2000)]
    rows += [(c, k, r.choice(["user", "assistant"]), "so." + "!" * k) for c in (0, 2, 3) for k in range(5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = R.faults(R.as_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")))
        got = {x.conv_id: x for x in R.report(turns).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {0, 1, 2, 3}
    kinds, seen = "", set()
    for _, k, role, text in rows[:2000]:
        kinds += "!" if not text or (role, text) in seen else role[0] if text[-1] == "." else role[0].upper()
        seen.add((role, text))
    whole = R.CLOSURE
    for k in kinds:  # one turn after the other
        row = R.times(whole[:4] + (None,) * 12, R.turn(k))
        whole = row[:4] + (None,) * 12
    assert (got[1].cost, got[1].audit) == R.least((whole[0], whole[3]))
    assert got[1].truncated == sum(k.isupper() for k in kinds) and got[1].gaps == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi!"), (1, 3, "user", ""), (2, 0, "tool", "x.")]
    got = sorted(tuple(r) for r in R.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    # dropping the assistant's turn and adding one costs as much as any other way; D comes before I
    assert [(r[2], r[3], r[4]) for r in got if r[0] == 1] == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Hi!"), ("I", "assistant", "")]
    assert [r for r in got if r[0] == 2] == []
