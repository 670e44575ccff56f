"""SentencePiece encoding and decoding with a given model file, by a shared-prefix Viterbi recursion.

The distinct marked words of a batch of texts are sorted, which is the depth-first order of their trie: a stack holds
the forward state of every prefix on the path, and the next word starts from the prefix that it shares with the last
one. The forward state depends on the model's kind:

* unigram: the best sum of scores of the pieces that spell the prefix, and the last of these pieces;
* merges (BPE): the last piece of the prefix's encoding. A prefix's encoding is that of a shorter prefix and one piece,
  and of the pieces that end there, just one follows the shorter prefix's last piece without the two being merged
  otherwise. So the recursion gives exactly what merging gives, and a long word takes time in proportion to its length.

Characters without a piece are spelled as bytes. A worker keeps the words that it has encoded, up to `CACHE`.

Defined results: null and empty texts have no ids, and no ids decode to an empty text. Null ids decode to null.
Repeated rows are encoded alike, an empty table gives an empty table, and only the id and text columns are read. Very
long texts and words are encoded whole, with memory in proportion to the longest.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm import kit, text as texts_

MARK = "▁"
#: Encoded words and answers for pairs of pieces that a worker keeps, some 200 and 120 bytes each; words over LONG
#: characters are not kept.
CACHE, PAIRS, LONG = 120_000, 200_000, 48
#: Characters of text whose distinct words are sorted together.
PIECE = 1 << 21
#: What a character without a piece costs a unigram model, below the lowest score.
UNKNOWN = 10.0


@dataclass(frozen=True)
class Model:
    """pieces and scores by id; bytes: the id of each byte's piece; unknown: the id for what has no piece."""

    pieces: list[str]
    scores: list[float]
    usable: list[bool]
    bytes: dict[int, int]
    unknown: int
    merges: bool

    @staticmethod
    def load(path: str) -> Model:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        proto = sentencepiece_model_pb2.ModelProto.FromString(raw)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models that leave texts as they are, but for the mark in front, are known")
        p = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = range(p.vocab_size())
        usable = [not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)) for i in n]
        own = {int(p.id_to_piece(i)[3:5], 16): i for i in n if p.is_byte(i)}
        return Model([p.id_to_piece(i) for i in n], [p.get_score(i) for i in n], usable, own, p.unk_id(), proto.trainer_spec.model_type == 2)


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        self.id = {x: i for i, (x, ok) in enumerate(zip(model.pieces, model.usable, strict=True)) if ok}
        self.longest = max(map(len, self.id), default=1)
        self.least = min((model.scores[i] for i in self.id.values()), default=0.0) - UNKNOWN
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def merged(self, word: str) -> list[str]:
        """The encoding of a short string by its definition: the best-scored neighbours are merged, leftmost first."""
        parts, scores = list(word), self.model.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b apart and each whole; a or b may be -1 for none."""
        if (got := self.fits.get(a << 20 | b)) is None:
            want = [self.model.pieces[i] for i in (a, b) if i >= 0]
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            got = self.fits[a << 20 | b] = self.merged("".join(want)) == want
        return got

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of distinct words, as 32-bit numbers, into the cache; a word without a mark stands for a marked one."""
        get, fits, follows, longest, scores, merges = self.id.get, self.fits, self.follows, self.longest, self.model.scores, self.model.merges
        last, begin, best = [-1], [0], [0.0]  # by prefix length: last piece, where it begins, the unigram score
        before = ""
        for key in sorted(words):
            word = key if key[:1] == MARK else MARK + key
            n, k, most = len(word), 0, min(len(word), len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del last[k + 1 :], begin[k + 1 :], best[k + 1 :]
            before = word
            for j in range(k + 1, n + 1):
                low = j - longest if j > longest else 0
                if merges:
                    for i in range(j - 1, low - 1, -1):
                        b = get(word[i:j])
                        if b is not None:
                            ok = fits.get(last[i] << 20 | b)
                            if ok or (ok is None and follows(last[i], b)):
                                break
                    else:
                        b, i = -1, j - 1
                    top = 0.0
                else:
                    b, i, top = -1, j - 1, best[j - 1] + self.least
                    for s in range(low, j):
                        c = get(word[s:j])
                        if c is not None and best[s] + scores[c] > top:
                            b, i, top = c, s, best[s] + scores[c]
                last.append(b)
                begin.append(i)
                best.append(top)
            out, j = [], n
            while j:
                if last[j] >= 0:
                    out.append(last[j])
                else:
                    out += [self.model.bytes.get(x, self.model.unknown) for x in reversed(word[j - 1].encode())] if self.model.bytes else [self.model.unknown]
                j = begin[j]
            out.reverse()
            self.cache[key] = array("i", out).tobytes()

    def split(self, text: str) -> list[str]:
        """A text's words, marks included only if some word has more than the one in front."""
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return self.words(MARK + text.replace(" ", MARK))
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers."""
        split = [self.split(t) if t else [] for t in texts]
        new: set[str] = set()
        for w in split:
            new |= set(w).difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = set().union(*split)
        self.encode_words(list(new))
        get = self.cache.__getitem__
        out = [b"".join(map(get, w)) for w in split]
        for w in new:
            if len(w) > LONG:
                del self.cache[w]
        return out


class Decoder:
    def __init__(self, model: Model):
        byte = {i: bytes([b]) for b, i in model.bytes.items()}
        self.spelled = [byte.get(i, b"" if not ok else p.replace(MARK, " ").encode()) for i, (p, ok) in enumerate(zip(model.pieces, model.usable, strict=True))]
        self.spelled[model.unknown] = " ⁇ ".encode()

    def decode(self, ids) -> str:
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def encoded(df: DataFrame, model: str, text: str = "text", ids: str = "ids", check: str | None = None, keep_text: bool = True) -> DataFrame:
    """df, with its text column or without, and the texts' ids after; model: the model file's path on the driver.

    check: the name of one more column, whether the ids decode to the text (for null: to nothing), from the same pass.
    """
    loaded = astuple(Model.load(model))
    name, held = f"pieces {kit.digest(loaded)}", df.sparkSession.sparkContext.broadcast(loaded)
    at = df.columns.index(text)
    kept = [i for i in range(len(df.columns)) if keep_text or i != at]

    def run(batches):
        encoder, decoder = kit.kept_in_worker(name, lambda: (Encoder(Model(*held.value)), Decoder(Model(*held.value))))
        for b in batches:
            for lo, hi in texts_.runs(pa.compute.binary_length(b.column(at)).fill_null(0).to_pylist(), PIECE):
                part = b.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                got = encoder.encode(texts)
                ends = np.cumsum([0] + [len(x) // 4 for x in got], dtype=np.int32)
                flat = np.frombuffer(b"".join(got), np.int32)
                del got
                more = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if check:
                    more.append(pa.array([decoder.decode(flat[s:e].tolist()) == (t or "") for t, s, e in zip(texts, ends, ends[1:], strict=False)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *more], [*[part.schema.names[i] for i in kept], ids, *[check] * bool(check)])

    import pyarrow.compute  # noqa: F401

    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if check:
        added.append(T.StructField(check, T.BooleanType()))
    return df.mapInArrow(kit.lean(run, name), T.StructType([*[df.schema.fields[i] for i in kept], *added]))


def decoded(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that each row's ids spell in a last column."""
    loaded = astuple(Model.load(model))
    name, held = f"spelled {kit.digest(loaded)}", df.sparkSession.sparkContext.broadcast(loaded)

    def run(batches):
        decode = kit.kept_in_worker(name, lambda: Decoder(Model(*held.value))).decode
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.slice(lo, 64)
                v = part.column(part.num_columns - 1)
                flat, ends, none = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy(), v.is_null().to_pylist()
                x = [None if no else decode(flat[s:e].tolist()) for no, s, e in zip(none, ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(x, pa.string())], [*part.schema.names[:-1], text])

    out = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    return df.withColumn(kit.fresh(df, "__ids"), F.col(f"`{ids}`")).mapInArrow(kit.lean(run, name), out)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = encoded(kit.documents(spark, sf_dir).select("doc_id", "text"), model, check="round_trip", keep_text=False)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
