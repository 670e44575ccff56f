"""Linear hinge-loss models by dual coordinate descent, hashed byte n-grams and bounded samples to fit on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm import kit


#: Labels whose counts are sent to every task at most.
LABELS = 65_536


def grams(text: bytes, orders, bits: int) -> np.ndarray:
    """Hashed ids below 2 ** bits of a whole text's byte n-grams, A-Z lower-cased, repeats included."""
    a = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    out = []
    for n in orders:
        if len(a) < n:
            continue
        x = np.full(len(a) - n + 1, n, np.uint32)
        for i in range(n):
            x = (x * np.uint32(0x01000193)) ^ a[i : len(a) - n + 1 + i]
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        out.append(x >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def descend(rows, y: np.ndarray, size: int, c: float = 1.0, epochs: int = 30, seed: int = 1) -> np.ndarray:
    """Weights (the last one is the bias) of a hinge-loss model of sparse rows [(ids, values)] and labels of 1 and -1.

    Each class's rows together may weigh as much as the other's.
    """
    w = np.zeros(size + 1)
    alpha = np.zeros(len(y))
    bound = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            ids, v = rows[i]
            g = y[i] * (w[ids] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), bound[i])
            if (d := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[ids] += d * y[i] * v
                w[-1] += d * y[i]
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic 1 / (1 + exp(-(a m + b))) that fits the margins, with smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    weight = np.where(y > 0, 0.5 / max(1, up), 0.5 / max(1, down)) * len(y)
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-9)
        m = np.array([[h @ (margins * margins) + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(m, [g @ margins, g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def sampled(df: DataFrame, label: str, doc_id: Column, cap: int, contents: Column | None = None, made=None) -> DataFrame:
    """At most `cap` rows of each non-null label, however many labels there are; about that many, or all, if fewer.

    Rows are drawn by a hash of their id and contents, and equal rows once, so an id with very many rows neither fills a
    sample nor drops out of it; a label of which most rows are copies gives fewer than `cap`. Labels are counted first, in
    a table that is sent to every task up to `LABELS` of them; only about `cap` rows of each are ranked in its task. What made(rows) makes of those that are drawn, beside the columns
    that it doesn't know, is ranked and returned in their place, so that whole texts don't meet in a label's task.
    """
    names = df.columns
    drawn, place, own, part = [kit.fresh(df, "__drawn"), kit.fresh(df, "__label")], kit.fresh(df, "__place"), kit.fresh(df, "__own"), kit.fresh(df, "__part")
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias(own)).agg(F.count(F.lit(1)).alias(part))
    shares = counts.select(own, F.least(F.lit(1.0), F.lit(cap + 4 * cap**0.5) / F.col(part)).alias(part))
    shares = F.broadcast(shares) if shares.limit(LABELS + 1).count() <= LABELS else shares
    key = F.xxhash64(doc_id, *([] if contents is None else [contents]), F.lit(11))
    u = (F.pmod(key, F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    some = df.withColumns({drawn[0]: key, drawn[1]: F.col(label)}).join(shares, F.col(label) == F.col(own)).where(u < F.col(part)).drop(own, part).dropDuplicates(drawn)
    some = made(some) if made else some
    rank = F.row_number().over(Window.partitionBy(drawn[1]).orderBy(drawn[0]))
    return some.withColumn(place, rank).where(F.col(place) <= cap).select(*names)
