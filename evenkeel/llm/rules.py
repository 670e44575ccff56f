"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Defined results: a null or empty text has no words, so every count is 0 and the base rule rejects it. Repeated
rows are judged each by itself, ties do not arise, and an empty table gives an empty table. A very long text is judged whole, in
the one task that reads it, in time n log n of its words. Only the text column is read; other columns pass through,
whatever their names (the projection's own names start with `__`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import kit

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages that the rules know, lower case.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was as with be by are this at an from or which",
    "de": "der die das und ist von zu mit den ein eine auf für im dem nicht des sich in als auch",
    "fr": "le la les de des et un une est dans que qui pour en du au par sur ce il ne pas",
    "es": "el la los las de y que en un una es por con para del se al lo su como no",
}


@dataclass(frozen=True)
class Rule:
    """A document passes while low <= metric <= high."""

    name: str
    metric: str
    low: float = float("-inf")
    high: float = float("inf")


RULES = (
    Rule("length", "n_words", low=50),
    Rule("repeats", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("capitals", "capital_ratio", high=0.5),
    Rule("duplicate_lines", "duplicate_line_ratio", high=0.5),
)
#: Those of the rules that the counts' definition fixes.
BASE = ("length", "repeats")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more, from a text's array of words.

    Windows are told apart by 64-bit hashes of 64-bit word hashes. Texts whose windows all differ stop at a
    hash set; others sort (hash, place) pairs, so the cost is n log n for one text of n words.
    """
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    windows = let(hashed, lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def repeats(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        met = let(pairs, lambda s: F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])))
        return let(F.sort_array(F.transform(met, lambda e: e["i"])), covered)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats(h))).cast("long")


def measured(df: DataFrame, text: str | Column = "text") -> DataFrame:
    """df with `__words` and a struct `__m` of the counts."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    stop = sorted({x for s in STOP_WORDS.values() for x in s.split()})
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(kit.WHITE))) > 0)
    df = df.withColumn("__words", kit.words(t)).withColumn("__lines", lines)
    w = F.col("__words")
    bare = F.concat_ws("", w)
    return df.withColumn("__m", F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[" + SYMBOLS.replace("&", r"\&") + "]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size("__lines").cast("long").alias("n_lines"),
    ))


def ratios() -> dict[str, Column]:
    """The metrics that a Rule may name, over `__m`."""
    m = lambda k: F.col("__m")[k].cast("double")
    n = F.greatest(m("n_words"), F.lit(1.0))
    return {
        "n_words": m("n_words"),
        "repeat_ratio": m("n_repeat_words") / n,
        "mean_word_chars": m("word_chars") / n,
        "symbol_ratio": m("n_symbols") / n,
        "stop_ratio": m("n_stop") / n,
        "capital_ratio": m("n_capitals") / F.greatest(m("word_chars"), F.lit(1.0)),
        "duplicate_line_ratio": m("n_dup_lines") / F.greatest(m("n_lines"), F.lit(1.0)),
    }


def failed(rules) -> Column:
    """Whether any of the rules rejects the row."""
    metric, out = ratios(), F.lit(False)
    for r in rules:
        x = metric[r.metric]
        if r.low > float("-inf"):
            out = out | (x < r.low)
        if r.high < float("inf"):
            out = out | (x > r.high)
    return out


def judged(df: DataFrame, text: str | Column = "text", rules=RULES) -> DataFrame:
    """df with `__m`, `__base_failed` and `__kept`."""
    base = [r for r in rules if r.name in BASE]
    return measured(df, text).withColumn("__base_failed", failed(base)).withColumn("__kept", ~failed(rules)).drop("__words", "__lines")


def keep(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of df that pass every rule, with df's own columns."""
    return judged(kit.whole(df), kit.of_row(text), rules).where("__kept").select("__row.*")


def op1(spark, sf_dir):
    q = judged(kit.documents(spark, sf_dir).select("doc_id", "text"))
    m = F.col("__m")
    return q.select("doc_id", *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))
