"""Language-model scores: the marginal probability of a text over all of its segmentations into subwords.

The pieces are those of an existing vocabulary file. Scores of a unigram model weight the segmentations from the start; a
vocabulary of merges has ranks only, for which 1 / (rank + 10) stands in. Either are then learned as expected counts over
the words of the training documents, by forward-backward in log space, in ROUNDS rounds. No piece holds white space
inside, so the forward recursion over a document is the sum of those over its words, each of which is run once for the
corpus. Single bytes are pieces too, so every text has a probability; the end is one more piece. Pieces are told apart by
64-bit polynomial hashes, which differ for the pieces of the vocabulary (checked) and are taken to tell them from other
substrings.

What is gathered are counts of all distinct words, by a shuffle that grows with the corpus. The `HEAD` most frequent
words are broadcast; words outside it are joined by shuffle.

Defined results: a null text is an empty one, whose only token is its end. A null id is held out. Repeated rows are
counted and scored each. With nothing to learn from, all counts are 0, base_score is n_tokens * log10(1 / 1) = 0 and
pieces keep the vocabulary's scores. Very long texts, and words of any length, are scored whole: words over `LONG` bytes
one by one, arcs in windows of `WINDOW` starts, so that memory is 16 bytes for each of a word's. An empty table gives an
empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import kit

#: Words whose counts and scores are sent to every task: a bound on what is broadcast, whatever the corpus.
HEAD = 200_000
#: Distinct words that a task counts before it hands them on.
FLUSH = 300_000
ROUNDS = 3
#: Words of more bytes than this are run one by one.
LONG = 48
#: Starts in such a word whose arcs are held at a time.
WINDOW = 1 << 14
SMOOTH = 0.1
_MULT, _SHIFT = np.uint64(0x9E3779B97F4A7C15), 44
_BASE = 0x100000001B3


def pieces(model: str) -> tuple[list[bytes], np.ndarray]:
    """The vocabulary's pieces, a leading space for the word mark, with each byte last; and their log scores.

    Those of a unigram model are its own, and bytes without one have the least; else the r-th piece has 1 / (r + 10).
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(model, "rb") as f:
        raw = f.read()
    p = sentencepiece.SentencePieceProcessor(model_proto=raw)
    unigram = sentencepiece_model_pb2.ModelProto.FromString(raw).trainer_spec.model_type == 1
    return listed([(p.id_to_piece(i), p.get_score(i)) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))], unigram)


def listed(own: list[tuple[str, float]], unigram: bool) -> tuple[list[bytes], np.ndarray]:
    best: dict[bytes, float] = {}
    for name, score in sorted(own, key=lambda x: -x[1]):
        best.setdefault(name.replace("▁", " ").encode(), score)
    rest = [bytes([b]) for b in range(256) if bytes([b]) not in best]
    names = [*best, *rest]
    if unigram:
        return names, np.array([*best.values(), *[min(best.values(), default=0.0)] * len(rest)])
    return names, -np.log(np.arange(len(names)) + 10.0)


class Lattice:
    """Forward and backward sums over the segmentations of words (each with a space in front)."""

    def __init__(self, names: list[bytes], logp: np.ndarray):
        self.names, self.logp = names, logp
        self.longest = max(map(len, names))
        powers = [1]
        for _ in range(LONG + 2):
            powers.append(powers[-1] * _BASE % (1 << 64))
        self.powers = np.array(powers, np.uint64)
        h = np.array([self._hash(x) for x in names], np.uint64)
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have one hash")
        self.lengths = sorted({len(x) for x in names})
        # a perfect hash in a few tables: what collides in one goes on to the next
        self.tables, left, mult = [], np.arange(len(names)), int(_MULT)
        while len(left):
            with np.errstate(over="ignore"):
                slot = (h[left] * np.uint64(mult)) >> np.uint64(_SHIFT)
            table = np.full(1 << (64 - _SHIFT), -1, np.int32)
            table[slot[::-1]] = left[::-1]
            self.tables.append((np.uint64(mult), table))
            left = left[table[slot] != left]
            mult = (mult * 0xD6E8FEB86659FD93 + 2) % (1 << 64) | 1
        self.hashes = np.append(h, np.uint64(0))

    @staticmethod
    def _hash(x: bytes) -> int:
        h = 0
        for b in x:
            h = (h * _BASE + b + 1) % (1 << 64)
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with the hashes, or -1."""
        out, rest = np.full(len(h), -1, np.int32), None
        for mult, table in self.tables:
            own = h if rest is None else h[rest]
            i = table[(own * mult) >> np.uint64(_SHIFT)]
            hit = (self.hashes[i] == own) & (i >= 0)
            if rest is None:
                out[hit], rest = i[hit], np.flatnonzero(~hit & (i >= 0))
            else:
                out[rest[hit]], rest = i[hit], rest[~hit & (i >= 0)]
            if not len(rest):
                break
        return out

    def _same_length(self, words: list[bytes], counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        n, size = len(words), len(words[0])
        a = np.frombuffer(b"".join(words), np.uint8).reshape(n, size).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((size + 1, n), np.uint64)
        forward = np.full((size + 1, n), -np.inf)
        forward[0] = 0.0
        arcs = []
        with np.errstate(over="ignore", invalid="ignore"):
            for j in range(size):
                prefix[j + 1] = prefix[j] * np.uint64(_BASE) + a[:, j]
            for j in range(1, size + 1):
                for i in range(j - 1, max(-1, j - 1 - self.longest), -1):
                    ids = self._find(prefix[j] - prefix[i] * self.powers[j - i])
                    at = np.flatnonzero(ids >= 0)
                    if not len(at):
                        continue
                    arc = ids[at]
                    forward[j, at] = np.logaddexp(forward[j, at], forward[i, at] + self.logp[arc])
                    if expected is not None:
                        arcs.append((i, j, at, arc))
            if expected is not None:
                back = np.full((size + 1, n), -np.inf)
                back[size] = 0.0
                for i, j, at, arc in sorted(arcs, key=lambda x: -x[1]):
                    back[i, at] = np.logaddexp(back[i, at], back[j, at] + self.logp[arc])
                for i, j, at, arc in arcs:
                    share = np.exp(forward[i, at] + self.logp[arc] + back[j, at] - forward[size, at]) * counts[at]
                    expected += np.bincount(arc, share, minlength=len(expected))
        return forward[size]

    def _arcs(self, word: np.ndarray, lo: int, hi: int):
        """(start, end, piece) of the arcs that start from lo to hi, in order of their starts."""
        part = word[lo : min(len(word), hi + self.longest - 1)].astype(np.uint64) + np.uint64(1)
        h, found = np.zeros(hi - lo, np.uint64), []
        with np.errstate(over="ignore"):
            for n in range(1, min(self.longest, len(part)) + 1):
                h = h[: len(part) - n + 1]
                h = h * np.uint64(_BASE) + part[n - 1 : n - 1 + len(h)]
                if n in self.lengths:
                    ids = self._find(h)
                    at = np.flatnonzero(ids >= 0)
                    found.append(np.stack([at + lo, at + lo + n, ids[at]]))
        arcs = np.concatenate(found, axis=1)
        return arcs[:, np.argsort(arcs[0], kind="stable")]

    def _one(self, word: bytes, count: float, expected: np.ndarray | None) -> float:
        """The forward recursion over one long word, and the backward one over windows of arcs that are found again."""
        raw, size = np.frombuffer(word, np.uint8), len(word)
        forward, back = array("d", [-math.inf]) * (size + 1), array("d", [-math.inf]) * (size + 1)
        forward[0] = back[size] = 0.0
        exp, log1p = math.exp, math.log1p
        windows = range(0, size, WINDOW)

        def into(table, at, t):
            other = table[at]
            if other == -math.inf:
                table[at] = t
            else:
                table[at] = t + log1p(exp(other - t)) if t > other else other + log1p(exp(t - other))

        for lo in windows:
            arcs = self._arcs(raw, lo, min(lo + WINDOW, size))
            for i, j, p in zip(*arcs[:2].tolist(), self.logp[arcs[2]].tolist(), strict=True):
                into(forward, j, forward[i] + p)
        total = forward[size]
        if expected is not None:
            for lo in reversed(windows):
                arcs = self._arcs(raw, lo, min(lo + WINDOW, size))[:, ::-1]
                for i, j, p in zip(*arcs[:2].tolist(), self.logp[arcs[2]].tolist(), strict=True):
                    into(back, i, back[j] + p)
                f, b = np.frombuffer(forward), np.frombuffer(back)
                expected += np.bincount(arcs[2], np.exp(f[arcs[0]] + self.logp[arcs[2]] + b[arcs[1]] - total) * count, minlength=len(expected))
        return total

    def marginals(self, words: list[bytes], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each word; adds its expected pieces, times its count, to `expected`."""
        out = np.zeros(len(words))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for size, at in by.items():
            if size + 1 > LONG:
                for i in at:
                    out[i] = self._one(b" " + words[i], 0 if counts is None else counts[i], expected)
                continue
            for lo in range(0, len(at), 8192):
                part = at[lo : lo + 8192]
                out[part] = self._same_length([b" " + words[i] for i in part], None if counts is None else counts[part], expected)
        return out


def _gathered(batches, least: int = 65_536):
    """Tables of at least so many rows, for longer vectors of words of one length."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= least:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _texts(batch, column: int):
    for t in batch.column(column).to_pylist():
        yield (t or b"").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): how often each word is in rows to learn from, and in all rows; docs has `__text`, `__learn`."""

    def run(batches):
        learned, rest = Counter(), Counter()

        def flush():
            names = list(learned.keys() | rest.keys())
            c = [learned[x] for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(c, pa.int64()), pa.array([a + rest[x] for a, x in zip(c, names, strict=True)], pa.int64())], ["word", "c", "n"])
            learned.clear()
            rest.clear()

        for b in batches:
            for w, learn in zip(_texts(b, 0), b.column(1).to_pylist(), strict=True):
                (learned if learn else rest).update(w)
                if len(learned) + len(rest) > FLUSH:
                    yield from flush()
        yield from flush()

    part = docs.select("__text", "__learn").mapInArrow(kit.lean(run), "word binary, c long, n long")
    return part.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def most_frequent(words: DataFrame) -> DataFrame:
    """At most HEAD of the most frequent words: those from a count up that a histogram of counts gives.

    No task gathers the candidates of all others, as it would for a top-k of this size.
    """
    n = F.col("n")
    level = F.when(n < 4096, n).otherwise(4096 + F.floor(F.log2(n / 4096) * 64)).cast("int")
    bins = {r.b: r.k for r in words.groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, total = max(bins, default=0) + 1, 0
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > HEAD:
            break
        least = b
    return words.where(level >= least)


def learned_pieces(words: DataFrame, names: list[bytes], start: np.ndarray, ends: int) -> np.ndarray:
    """Natural log probabilities of the pieces, and of the end last, after ROUNDS rounds over all words."""
    sc = words.sparkSession.sparkContext

    def normal(weights: np.ndarray) -> np.ndarray:
        p = np.append(weights, ends) + SMOOTH
        return np.log(p / p.sum())

    total = max(1.0, float(ends))
    logp = normal(np.exp(start) / np.exp(start).sum() * total * 1000)
    for _ in range(ROUNDS):
        held = sc.broadcast((names, logp[:-1]))

        def run(batches, held=held):
            lattice = Lattice(*held.value)
            expected = np.zeros(len(lattice.names))
            for b in _gathered(batches):
                lattice.marginals(b.column(0).to_pylist(), b.column(1).to_numpy().astype(float), expected)
            at = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(expected[at])], ["piece", "n"])

        got = words.where("c > 0").select("word", "c").mapInArrow(kit.lean(run), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        if not got:
            break
        expected = np.zeros(len(names))
        for r in got:
            expected[r.piece] = r.n
        logp = normal(expected)
    return logp


def scored(df: DataFrame, learn: Column, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`__id`, n_tokens, n_known, train_tokens, base_score and score of every row."""
    sc = df.sparkSession.sparkContext
    docs = df.select(F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("__text"), learn.alias("__learn"))
    words = kit.checkpointed(word_counts(docs))
    ends = docs.where("__learn").count()
    r = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = r[0] + ends, r[1] + (ends > 0)
    names, start = pieces(model)
    logp = learned_pieces(words, names, start, ends)
    held = sc.broadcast((names, logp[:-1]))
    base = lambda c: np.log10((c + 1.0) / (total + distinct + 1.0) if total else np.ones_like(c, float))

    def lattice(batches):
        own = Lattice(*held.value)
        for b in _gathered(batches):
            c = b.column(1).to_numpy()
            m = own.marginals(b.column(0).to_pylist()) / math.log(10)
            yield from pa.table([b.column(0), b.column(1), pa.array(base(c)), pa.array(m)], names=["word", "c", "base", "m"]).to_batches(max_chunksize=10_000)

    shape = "word binary, c long, base double, m double"
    # no more than HEAD rows reach the driver
    head = most_frequent(words).select("word", "c").mapInArrow(kit.lean(lattice), shape).toArrow()
    index = {w: i for i, w in enumerate(head.column(0).to_pylist())}
    known = [np.append(head.column("c").to_numpy() > 0, False), np.append(head.column("base").to_numpy(), 0.0), np.append(head.column("m").to_numpy(), 0.0)]
    sent = sc.broadcast((index, known))
    end = (int(ends > 0), float(base(np.array([ends]))[0]), float(logp[-1] / math.log(10)))

    def first(batches):
        index, known = sent.value
        get, row = index.get, TaskContext.get().partitionId() << 33
        for b in batches:
            out, missing = [], []
            for w in _texts(b, 1):
                at = [get(x, -1) for x in w]
                i = np.array(at, np.int64)
                out.append([len(w) + 1] + [float(k[i].sum()) + e for k, e in zip(known, end, strict=True)])
                missing.append(zlib.compress(b" ".join([x for x, j in zip(w, at, strict=True) if j < 0]), 1) if -1 in at else b"")
            x = np.array(out, float).reshape(len(out), 4)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(out))), b.column(0), pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1].astype(np.int64)), pa.array(x[:, 2]), pa.array(x[:, 3]), pa.array(missing, pa.binary())], ["__row", "__id", "n_tokens", "n_known", "base_score", "score", "__missing"])
            row += len(out)

    kind = dict(docs.dtypes)["__id"]
    rows = kit.checkpointed(docs.select("__id", "__text").mapInArrow(kit.lean(first), f"__row long, __id {kind}, n_tokens long, n_known long, base_score double, score double, __missing binary"))

    def split(batches):
        for b in batches:
            for lo in range(0, len(b), 512):
                at, names, n = [], [], []
                for r, m in zip(b.column(0)[lo : lo + 512].to_pylist(), b.column(1)[lo : lo + 512].to_pylist(), strict=True):
                    c = Counter(zlib.decompress(m).split())
                    at.append((r, len(c)))
                    names += c.keys()
                    n += c.values()
                where = np.repeat(np.array([r for r, _ in at], np.int64), [k for _, k in at])
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(names, pa.binary()), pa.array(n, pa.int32())], ["__r", "word", "times"])

    rare = rows.where(F.length("__missing") > 0).select("__row", "__missing").mapInArrow(kit.lean(split), "__r long, word binary, times int")
    scores = words.select("word", "c").mapInArrow(kit.lean(lattice), shape)
    extra = rare.join(scores, "word").groupBy("__r").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.col("base")).alias("b"), F.sum(F.col("times") * F.col("m")).alias("s"))
    more = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return rows.drop("__missing").join(extra, F.col("__row") == F.col("__r"), "left").select("__id", "n_tokens", more("n_known", F.col("k")), F.lit(total).cast("long").alias("train_tokens"), more("base_score", F.col("b")), more("score", F.col("s")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scored(kit.documents(spark, sf_dir), ~kit.held_out(F.col("doc_id"), 7, 2), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(F.col("__id").alias("doc_id"), kit.held_out(F.col("__id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
