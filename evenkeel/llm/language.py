"""Language identification in two steps: a family of languages first, then the language within it.

Families are groups of languages with like n-gram profiles, found from the learned languages themselves. Families, and
the languages of one family, are told apart by one-versus-one linear support vector machines over square roots of
byte n-gram shares. Fitted on at most `SAMPLE` rows of each language (by hashes of ids and texts; documented bound), however many
languages there are: the driver holds a profile of 32 KB a row, some 16 MB a language, and no text. Every whole text is scored in one pass without
a shuffle.

Defined results: texts that are null or have no letter are `und` with score 0, and so is every text if there is
nothing to learn from. A letter is a character of the Unicode categories L. A null id is not learned from. Very long
texts are scored whole. Repeated rows are scored alike, an empty table gives an empty
table, and only the id and text columns (and lang, to learn from) are read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm import kit, svm

SAMPLE = 500
ORDERS, BITS = (1, 2, 3), 13
LETTER = regex.compile(r"\p{L}")


def profile(text: bytes) -> np.ndarray:
    x = np.sqrt(np.bincount(svm.grams(b" " + text + b" ", ORDERS, BITS), minlength=1 << BITS))
    return (x / max(np.sqrt(x @ x), 1e-12)).astype(np.float32)


def _profiled(df: DataFrame, text: str) -> DataFrame:
    """The rows of df whose text has a letter, with its profile in its place."""
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            keep = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
            x = pa.array([profile(texts[i].encode()).tobytes() for i in keep], pa.binary())
            yield b.take(pa.array(keep, pa.int64())).set_column(at, text, x)

    fields = list(df.schema.fields)
    fields[at] = T.StructField(text, T.BinaryType())
    return df.mapInArrow(kit.lean(run), T.StructType(fields))


def families(centres: dict[str, np.ndarray], n: int) -> list[list[str]]:
    """The languages in n groups; the two groups with the most alike mean profiles are joined until n are left."""
    groups = [[k] for k in sorted(centres)]
    means = np.array([centres[k] for k in sorted(centres)], np.float64)
    units = means / np.linalg.norm(means, axis=1, keepdims=True)
    alike = np.tril(np.full((len(groups), len(groups)), -np.inf)) + units @ units.T
    while len(groups) > n:
        i, j = divmod(int(alike.argmax()), len(groups))
        groups[i] = sorted(groups[i] + groups.pop(j))
        mean = np.mean([centres[k] for k in groups[i]], axis=0, dtype=np.float64)
        units = np.delete(units, j, axis=0)
        units[i] = mean / np.linalg.norm(mean)
        alike = np.delete(np.delete(alike, j, axis=0), j, axis=1)
        near = units @ units[i]
        alike[i, i + 1 :], alike[:i, i] = near[i + 1 :], near[:i]
    return groups


def _versus(x: np.ndarray, y: np.ndarray, classes: list) -> list[tuple]:
    """(class, other, weights, bias, scale, offset) of each pair of classes."""
    out, ids = [], np.arange(x.shape[1])
    for a, b in itertools.combinations(classes, 2):
        at = np.flatnonzero((y == a) | (y == b))
        s = np.where(y[at] == a, 1, -1)
        w = svm.descend([(ids, x[i].astype(np.float64)) for i in at], s, x.shape[1], epochs=12)
        out.append((a, b, w[:-1].astype(np.float32), float(w[-1]), *svm.calibrated(x[at] @ w[:-1] + w[-1], s)))
    return out


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """The model, from rows all of which may be learned from."""
    rows = df.where(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    some = svm.sampled(rows.select(doc_id, text, lang), lang, F.col(doc_id), SAMPLE, F.col(text), lambda d: _profiled(d, text))
    got = some.select(F.col(text).alias("x"), F.col(lang).alias("lang")).collect()
    if not got:
        return {"families": []}
    x, y = np.empty((len(got), 1 << BITS), np.float32), np.array([r.lang for r in got])
    while got:  # what was fetched goes as the matrix is filled
        last = got.pop()
        x[len(got)] = np.frombuffer(last.x, np.float32)
    names = sorted(set(y.tolist()))
    groups = families({k: x[y == k].mean(0) for k in names}, max(1, round(len(names) ** 0.5)))
    of = {k: i for i, g in enumerate(groups) for k in g}
    first = _versus(x, np.array([of[k] for k in y]), list(range(len(groups))))
    return {"families": groups, "first": first, "within": [_versus(x, y, g) for g in groups]}


def _vote(x: np.ndarray, pairs: list[tuple], classes: list) -> tuple[np.ndarray, np.ndarray]:
    """For each row the class with the most votes (then the largest sum of probabilities) and a share for it."""
    votes, sums = np.zeros((len(x), len(classes))), np.zeros((len(x), len(classes)))
    at = {c: i for i, c in enumerate(classes)}
    for a, b, w, bias, scale, offset in pairs:
        p = 1 / (1 + np.exp(-np.clip(scale * (x @ w + bias) + offset, -30, 30)))
        for c, q in ((a, p), (b, 1 - p)):
            votes[:, at[c]] += q >= 0.5
            sums[:, at[c]] += q
    best = np.argmax(votes * len(classes) + sums, axis=1)
    share = sums[np.arange(len(x)), best] / (len(classes) - 1) if pairs else np.ones(len(x))
    return best, share


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model["families"] else []
    for lo in range(0, len(at), 256):
        part = np.array(at[lo : lo + 256])
        x = np.stack([profile(texts[i].encode()) for i in part])
        family, p = _vote(x, model["first"], list(range(len(model["families"]))))
        for f, group in enumerate(model["families"]):
            own = np.flatnonzero(family == f)
            if len(own):
                best, q = _vote(x[own], model["within"][f], group)
                for i, k, s in zip(part[own], best, p[own] * q, strict=True):
                    names[i], score[i] = group[k], s
    return names, score


def predicted(df: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            names, score = predict(held.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(kit.lean(run), f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.documents(spark, sf_dir)
    model = fit(docs.where(~kit.held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang"))
    out = predicted(docs, model)
    return out.select("doc_id", kit.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
