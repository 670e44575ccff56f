"""Conversation repair against all possible edits, and its digests against the repaired turns themselves."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import oracle
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import conversations as c, sql

INS = [("", 0, ""), ("u", 3, "I"), ("a", 3, "I"), ("ua", 6, "II"), ("au", 6, "II")]


def brute(rows):
    """The least (cost, audit) of all edits of (initial, fault) rows, with up to two inserts in each gap."""
    options = []
    for initial, fault in rows:
        cut = c.CUT if fault == c.TRUNCATED else 0
        own = [("D", "", 4)]
        if fault not in (c.BLANK, c.DUPLICATE):
            own += [("K", initial or "?", cut), ("R", "u", 3 + cut), ("R", "a", 3 + cut)]
        options.append(own)
    found = []
    for gaps in itertools.product(INS, repeat=len(rows) + 1):
        for edits in itertools.product(*options):
            parts = [x for pair in zip(gaps, [(r, n, e) for e, r, n in edits] + [("", 0, "")], strict=True) for x in pair]
            if re.fullmatch("(s?(ua)+)?", "".join(p[0] for p in parts)):
                found.append((sum(p[1] for p in parts), "".join(p[2] for p in parts)))
    return min(found)


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(3)
    cases = [[], [("s", 0)], [("a", 0)], [("u", 0), ("u", 3)], [("", 0), ("x", 0)]]
    cases += [[(rng.choice("suasuax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.choice([1, 2, 3, 3]))] for _ in range(150)]
    for rows in cases:
        edits = c.Edits()
        for r in rows:
            edits.feed(*r)
        assert edits.done() == brute(rows), rows


def test_long_audits_are_whole():
    """Beyond the letters that are copied; a pair kept, a turn in between deleted, over and over."""
    edits = c.Edits()
    for _ in range(5000):
        for row in (("u", 0), ("u", 1), ("a", 0)):
            edits.feed(*row)
    assert edits.done() == (20_000, "KDK" * 5000)


def test_repaired_turns_give_the_digests(spark):
    rows = c.damaged(spark.read.parquet(f"{oracle.DATA}/conversations.parquet"))
    made = c.plans(rows)
    said, edits = collections.defaultdict(list), collections.defaultdict(str)
    for r in c.repaired(rows, made).orderBy("conv_id", "place").collect():
        said[r.conv_id].append(f"{r.role}:{r.text}")
        edits[r.conv_id] += r.edit
    for r in c.digests(rows, made).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(said[r.conv_id]).encode()).hexdigest()
        assert edits[r.conv_id] == r.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in said[r.conv_id]))


def odd_rows():
    def drops(i):
        return all(zlib.crc32(f"{i}:{t}".encode()) % 20 == 0 for t in (0,))

    gone = next(i for i in range(10_000) if drops(i))
    rows = [(None, None, None, None), (None, 1, "user", "x."), (None, 1, "user", "x."), (1, None, "user", "b"), (1, None, "user", "b"), (1, 5, "", "c."), (1, 2, "System", "d. \t"), (2, 1, "user", " \x0b\x0c"), (2, 3, "assistant", "é"), (2, 9, "assistant", "."), (gone, 0, "user", "only")]
    rows += [(3, t, "user" if t % 2 else "assistant", "w" * 300_000 + "?" + " " * 50_000) for t in range(4)] + [(4, t, "user", "again.") for t in range(40)]
    return gone, rows


def test_odd_conversations(spark, folder):
    gone, rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(1) for n in ("conv", "audit", "tie", "plan", "cost")})
    path = folder(conversations=df)
    duck = oracle.duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet/*.parquet')")
    names = sorted(c.op11(spark, path).columns)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({sql.conversation_repair()})").fetchall()
    got = c.op11(spark, path).select(*names).collect()
    assert oracle.ordered(got) == oracle.ordered(want)
    one = {r.conv_id: r for r in got}
    assert set(one) == {None, 1, 2, 3, 4, gone} and (one[gone].audit, one[gone].cost, one[gone].repaired_sha256) == ("", 0, hashlib.sha256().hexdigest())


@pytest.mark.parametrize("name", ["op11", "plans", "repaired"])
def test_no_conversations(spark, folder, name):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = {"op11": lambda: c.op11(spark, folder(conversations=df)), "plans": lambda: c.plans(df), "repaired": lambda: c.repaired(df, c.plans(df))}[name]()
    assert out.count() == 0
