"""Conversation structure repair: the cheapest edits that make a conversation's roles an optional system turn and then
pairs of user and assistant.

A dynamic programme over the turns that are retained, each kept or rerolled. A turn's cost is that of the best retained turn
before it, of the deletions between the two (a difference of prefix sums), of the inserts that the two roles need, and its
own. So of all earlier turns only the best of each role counts: a running minimum of cost less the prefix sum. Of
equally cheap edits those with the least audit string stay. Audits of as many turns that end in different roles differ before
either ends, so their order is known from the order of what they were made from, and no two of them are ever compared.

A conversation is one chain, as is the digest of its repair; it is read in order, turn by turn, by the task that it is sorted
in, and never held: `plans` keeps three running minima and the audits' letters, `repaired` the audit. Both shuffle once, by
conversation; only `repaired` shuffles texts. Sorting and counting of repeats spill.

Defined results: a null role or text is one space, so a null text is blank; a null id is a conversation of its own, a null turn
comes first. Turns that share a number are ordered by role, then by the SHA-256 of role and text; equal ones stay
adjacent, and all but the first are duplicates. A turn whose role starts with none of s, u, a (in lower case), or is empty, can
be rerolled or deleted, not kept. Empty tables give empty tables. Further columns aren't read, so their names can't clash.
Gaps beyond a long are held to its end. Very long texts pass whole, one batch at a time.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.llm import kit

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Inserts between the last retained role ("" for none) and the next one.
NEEDS = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "u"): 1, ("u", "a"): 0, ("a", "u"): 0, ("a", "a"): 1}
#: Inserts behind the last retained role.
CLOSES = {"": 0, "s": 2, "u": 1, "a": 0}
LEGAL = {"su", "ua", "au"}
#: Letters of an audit that are copied when it grows.
TAIL = 4096
FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LAST = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"
FLUSH = 4 << 20


class Edits:
    """The cheapest edits of the turns that were fed."""

    def __init__(self):
        self.n = 0
        #: By last retained role: cost less the deletions so far, place among the audits in order, audit and the turns it covers.
        self.best = {"": (0, 0, (None, ""), 0)}

    def feed(self, initial: str, fault: int) -> None:
        at, self.n = self.n, self.n + 1
        if fault in (BLANK, DUPLICATE):
            return
        new = {}
        for (last, role), inserts in NEEDS.items():
            if last not in self.best or role == "s" != initial:
                continue
            less, place, _, _ = self.best[last]
            edit, price = ("K", 0) if role == initial else ("R", REROLE)
            # all turns before this one that the last one's audit doesn't cover are deleted; this one isn't
            cost = less - DELETE + price + (CUT if fault == TRUNCATED else 0) + inserts * INSERT
            new[role] = min(new.get(role, (cost + 1,)), (cost, place, "I" * inserts + edit, last))
        taken, order = {}, {}
        for role in {*self.best, *new}:
            old = (self.best[role][0], self.best[role][1], "D") if role in self.best else None
            if role in new and (old is None or new[role][:3] < old):
                taken[role] = new[role]
            order[role] = taken.get(role, old)[1:3]
        if taken:
            place = {role: i for i, role in enumerate(sorted(order, key=order.get))}
            grown = {r: (cost, 0, self._grown(last, at, edits), self.n) for r, (cost, _, edits, last) in taken.items()}
            self.best = {r: (grown.get(r) or self.best[r])[:1] + (place[r],) + (grown.get(r) or self.best[r])[2:] for r in order}

    def _grown(self, last: str, at: int, edits: str) -> tuple:
        """The audit of `last`, deletions up to turn `at`, and edits."""
        _, _, (before, tail), covered = self.best[last]
        tail += "D" * (at - covered) + edits
        return ((before, tail), "") if len(tail) > TAIL else (before, tail)

    def done(self) -> tuple[int, str]:
        """Cost and audit."""
        ends = [(less + DELETE * self.n + INSERT * CLOSES[last], place, last) for last, (less, place, _, _) in self.best.items()]
        cost, _, last = min(ends)
        node, parts = self._grown(last, self.n, "I" * CLOSES[last]), []
        while node is not None:
            node, tail = node
            parts.append(tail)
        return cost, "".join(reversed(parts))


def _turns(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    return rows.withColumn("tie", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def plans(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation.

    audit has a letter for each edit in order: Delete, Insert, Keep, Rerole.
    """
    last, known = F.regexp_extract("text", LAST, 1), F.substring("role", 1, 1)
    rows = _turns(df, conv_id, turn, role, text).select("conv", "turn", "role", "tie", known.alias("initial"), last.alias("last")).repartition("conv")
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("conv", "tie").orderBy("turn")) > 1)
    fault = F.when(F.col("last") == "", BLANK).when(F.col("again"), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(GOOD)
    rows = rows.withColumn("fault", fault).sortWithinPartitions("conv", "turn", "role", "tie", "again").select("conv", "turn", "initial", "fault")
    kind = dict(rows.dtypes)["conv"]
    schema = _arrow(kind, FACTS)

    def run(batches):
        out = []
        turns = (r for b in batches for r in _listed(b))
        for conv, own in itertools.groupby(turns, key=lambda r: r[0]):
            out.append((conv, *_plan(own)))
            if len(out) == 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return rows.mapInArrow(kit.lean(run), f"conv {kind}, {FACTS}").withColumnRenamed("conv", "conv_id")


def _listed(batch: pa.RecordBatch):
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _plan(turns) -> tuple:
    edits, faults, illegal, before = Edits(), [0] * 4, 0, None
    low = high = None
    distinct = 0
    for _, turn, initial, fault in turns:
        edits.feed(initial, fault)
        faults[fault] += 1
        illegal += before is not None and before + initial not in LEGAL
        before = initial
        if turn is not None and turn != high:
            low, high, distinct = turn if low is None else low, turn, distinct + 1
    gaps = 0 if low is None else min(high - low + 1 - distinct, 2**63 - 1)
    return (gaps, *faults[1:], illegal, *edits.done())


def _arrow(kind: str, rest: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(f"conv {kind}, {rest}"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _repairs(batches):
    """(plan, repaired turns) of each conversation; its turns (edit, role, text) must be read before the next one's."""
    rows, nth = (r for b in batches for r in _listed(b)), 0

    def own(row):
        nonlocal nth
        nth += row[1] is not None
        return nth

    for _, group in itertools.groupby(rows, key=own):
        conv, plan, _, _ = next(group)
        yield conv, plan, _edited(plan["audit"], group)


def _edited(audit: str, turns):
    last, letters = "", iter(audit)
    follows = lambda: ("a", "assistant") if last == "u" else ("u", "user")
    for _, _, role, text in itertools.chain(turns, [(None,) * 4]):
        for edit in letters:
            if edit == "I":
                last, name = follows()
                yield "I", name, b""
                continue
            if edit == "K":
                last = role[:1]
                yield "K", role, text
            elif edit == "R":
                last, name = follows()
                yield "R", name, text
            break


def _with_plans(df: DataFrame, made: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation's plan and then its turns, in order, in one task."""
    rows = _turns(df, conv_id, turn, role, text)
    plan = F.struct(*[F.col(c) for c in made.columns if c != "conv_id"])
    none = F.lit(None)
    heads = made.select(F.col("conv_id").alias("conv"), plan.alias("plan"), none.cast(rows.schema["turn"].dataType).alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("text"), none.cast("string").alias("tie"))
    turns = rows.select("conv", none.cast(heads.schema["plan"].dataType).alias("plan"), "turn", "role", F.col("text").cast("binary").alias("text"), "tie")
    both = heads.unionByName(turns).repartition("conv").sortWithinPartitions("conv", F.col("plan").isNull(), "turn", "role", "tie")
    return both.select("conv", "plan", "role", "text")


def repaired(df: DataFrame, made: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, edit, role, text) of the turns that conversations have after the edits that `made` plans for them."""
    rows = _with_plans(df, made, conv_id, turn, role, text)
    kind, rest = dict(rows.dtypes)["conv"], "place long, edit string, role string, text string"
    schema = _arrow(kind, rest)

    def run(batches):
        out, held = [], 0
        for conv, _, turns in _repairs(batches):
            for place, (edit, name, t) in enumerate(turns):
                out.append((conv, place, edit, name, t.decode()))
                held += len(t) + 64
                if held > FLUSH:
                    yield _batch(out, schema)
                    out, held = [], 0
        if out:
            yield _batch(out, schema)

    return rows.mapInArrow(kit.lean(run), f"conv {kind}, {rest}").withColumnRenamed("conv", "conv_id")


def digests(df: DataFrame, made: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`made` with `repaired_sha256`: of the repaired turns' role:text, joined by line ends."""
    rows = _with_plans(df, made, conv_id, turn, role, text)
    names = [c for c in made.columns if c != "conv_id"]
    kind, rest = dict(rows.dtypes)["conv"], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name in names) + ", repaired_sha256 string"
    schema = _arrow(kind, rest)

    def run(batches):
        out = []
        for conv, plan, turns in _repairs(batches):
            sha = hashlib.sha256()
            for i, (_, name, t) in enumerate(turns):
                sha.update((b"\n" if i else b"") + name.encode() + b":")
                sha.update(t)
            out.append((conv, *(plan[c] for c in names), sha.hexdigest()))
            if len(out) == 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return rows.mapInArrow(kit.lean(run), f"conv {kind}, {rest}").withColumnRenamed("conv", "conv_id")


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of conversations with a fifth of the turns damaged, by hashes of their ids and numbers."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = df.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), how.alias("how")).where("how != 0")
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("nth")).drop("nth")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = damaged(given)
    out = digests(rows, plans(rows))
    every = given.select(F.col("conv_id").alias("id")).distinct()
    fill = {f.name: F.coalesce(F.col(f.name), F.lit("") if f.name == "audit" else F.lit(0)) for f in out.schema if f.name not in ("conv_id", "repaired_sha256")}
    fill["repaired_sha256"] = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
    return every.join(out, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *[c.alias(n) for n, c in fill.items()])
