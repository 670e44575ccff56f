"""Quality classifier: n-gram indicators scaled by the classes' log-count ratios, under a linear hinge-loss model.

Fitted on at most `SAMPLE` labelled rows of each label (by hashes of ids and texts; documented bound), so what the task that
fits it holds doesn't grow with the corpus, nor with the texts: a row's set of n-grams takes 16 KB at the most, all of them 66 MB, as
do the values that are kept beside the sets of up to 4,096 ids. The driver gets the model alone. Only labels of documents at hand are drawn, however many others there are.
Every whole text is scored in one pass without a shuffle.

Defined results: null and empty texts have no n-gram and get the score of the bias alone; a null id is held out.
Labels other than 0 and 1 are not learned from, an id labelled twice counts as its higher label. Without both labels the
score is the share of label 1 among those learned from, or 0.5 if there are none. Very long texts are scored whole, with
memory in proportion to the longest. Repeated rows are scored alike, an empty table gives an empty table, and only the id and text columns are read.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm import kit, svm

SAMPLE = 2000
ORDERS, BITS = (1, 2, 3, 4), 17
#: Besides hashed byte n-grams, indicators of the word n-grams that repeat one word, of 2 words and up.
SAME = 6
SIZE = (1 << BITS) + SAME
#: Bytes of a set of ids with a bit for each.
BYTES = (SIZE + 7) // 8


def ngrams(text: bytes) -> np.ndarray:
    """Ids below SIZE of a whole text's n-grams, some more than once."""
    w = text.lower().split()
    same = bytes(map(operator.eq, w, w[1:]))
    n = next((n for n in range(SAME, 0, -1) if b"\1" * n in same), 0)
    return np.concatenate([svm.grams(text, ORDERS, BITS), np.arange(n, dtype=np.uint32) + np.uint32(1 << BITS)])


def packed(ids: np.ndarray) -> bytes:
    """A set of ids below SIZE in BYTES at the most: the ids, or a bit for each that there could be, if that is shorter."""
    if 4 * len(ids) < BYTES:
        return ids.astype(np.int32).tobytes()
    held = np.zeros(SIZE, bool)
    held[ids] = True
    return np.packbits(held).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    """The ids in order."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), count=SIZE).view(bool)) if len(x) == BYTES else np.frombuffer(x, np.int32)


class _Rows:
    """(ids, values) of each packed set; large sets' are made when they are asked for, as together they could take gigabytes."""

    def __init__(self, sets: list[bytes], ratios: np.ndarray):
        self.sets, self.ratios = sets, ratios
        self.norms = [max(np.linalg.norm(ratios[unpacked(s)]), 1e-12) for s in sets]
        self.small = {i: self._made(i) for i, s in enumerate(sets) if len(s) < BYTES}

    def _made(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        x = unpacked(self.sets[i])
        return x, (self.ratios[x] / self.norms[i]).astype(np.float32)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.small.get(i) or self._made(i)

    def __iter__(self):
        return (self[i] for i in range(len(self.sets)))


def _indicated(df: DataFrame, text: str) -> DataFrame:
    """df with each text's packed set of n-grams in its place."""
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            sets = [packed(np.unique(ngrams(t or b""))) for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.set_column(at, text, pa.array(sets, pa.binary()))

    fields = list(df.schema.fields)
    fields[at] = T.StructField(text, T.BinaryType())
    return df.mapInArrow(kit.lean(run), T.StructType(fields))


#: What the task that fits returns: a constant score, or a model, whose arrays are bytes of single precision.
MODEL = "constant double, r binary, w binary, bias double, a double, b double"


def _learned(sets: list[bytes], y: np.ndarray) -> dict:
    """The model from packed sets and labels of 1 and -1."""
    if len(set(y.tolist())) < 2:
        return {"constant": float((y > 0).mean()) if len(y) else 0.5}
    up, down = np.ones(SIZE), np.ones(SIZE)
    for x, s in zip(sets, y, strict=True):
        (up if s > 0 else down)[unpacked(x)] += 1
    r = np.log((up / up.sum()) / (down / down.sum()))
    rows = _Rows(sets, r)
    w = svm.descend(rows, y, SIZE)
    margins = np.array([w[x] @ v + w[-1] for x, v in rows])
    a, b = svm.calibrated(margins, y)
    return {"r": r.astype(np.float32), "w": (r * w[:-1]).astype(np.float32), "bias": float(w[-1]), "a": a, "b": b}


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> dict:
    """The model, from rows with an id, a text and a label of 0 or 1 (all of which may be learned from).

    One task fits it on the bounded sample; the driver gets the model, a megabyte, and none of the rows.
    """
    rows = labelled.where(F.col(doc_id).isNotNull()).select(doc_id, text, label)
    some = svm.sampled(rows, label, F.col(doc_id), SAMPLE, F.col(text), lambda d: _indicated(d, text))

    def run(batches):
        sets, y = [], []
        for b in batches:
            sets += b.column(0).to_pylist()
            y += [1 if x else -1 for x in b.column(1).to_pylist()]
        m = _learned(sets, np.array(y))
        row = [m[c].tobytes() if c in ("r", "w") and c in m else m.get(c) for c in names]
        yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema)

    names = [c.split()[0] for c in MODEL.split(", ")]
    schema = pa.schema([(c, pa.binary() if c in ("r", "w") else pa.float64()) for c in names])
    got = some.select(F.col(text).alias("ids"), F.col(label).cast("int").alias("label")).coalesce(1).mapInArrow(kit.lean(run), MODEL).collect()
    if not got or got[0].constant is not None:
        return {"constant": got[0].constant if got else 0.5}
    m = got[0].asDict()
    return {c: np.frombuffer(x, np.float32) if c in ("r", "w") else x for c, x in m.items() if c != "constant"}


def scores(model: dict, texts: list[bytes | None]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    margin = np.full(len(texts), model["bias"])
    seen = np.zeros(SIZE, bool)
    square = model["r"].astype(np.float64) ** 2
    for i, t in enumerate(texts):
        x = ngrams(t or b"")
        if len(x):
            seen[x] = True
            ids = np.flatnonzero(seen)
            seen[ids] = False
            margin[i] += model["w"][ids].sum(dtype=np.float64) / max(np.sqrt(square[ids].sum()), 1e-12)
    return 1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -700, 700)))


def scored(df: DataFrame, model: dict, text: str = "text", score: str = "score") -> DataFrame:
    """df with a column of scores from 0 to 1 added last."""
    held, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches):
        for b in batches:
            s = scores(held.value, b.column(at).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, score])

    out = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())])
    return df.mapInArrow(kit.lean(run), out)


def learnable(docs: DataFrame, labels: DataFrame, n: int = 3, rest: int = 1) -> DataFrame:
    """Rows of docs with their labels' quality in `label`, of ids outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & ~kit.held_out(F.col("doc_id"), n, rest)).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("int").alias("label"))
    # the labels of these documents alone are sampled, before they meet the texts: ids are shuffled, then few rows joined
    known = known.join(docs.select(F.col("doc_id").alias("__own")), F.col("__id") == F.col("__own"), "left_semi")
    known = svm.sampled(known, "label", F.col("__id"), SAMPLE)
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.documents(spark, sf_dir).select("doc_id", "text")
    model = fit(learnable(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = scored(docs, model)
    return out.select("doc_id", kit.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
