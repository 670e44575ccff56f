"""Token counts of a byte-level BPE without a shuffle of pre-tokens.

Two tiers: a compact table of frequent pre-tokens' lengths, made from the vocabulary and a bounded number of texts, is
broadcast; a pre-token that it lacks is encoded by the library once for each worker, whose bounded cache later tasks
share. The table only saves time: every count is the library's own.

Defined results: a null text counts as empty, with 0 bytes and tokens. Special strings in a text are split off first,
as the library does by default, and count as one token each. Very long texts are split and counted whole, with memory in
proportion to the longest. A description that doesn't split texts in the way that SPLIT does has the library encode
whole texts. Repeated rows are counted alike, an empty table gives an empty table, and only the id and text columns are
read.
"""

from __future__ import annotations

import collections
import json
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import kit

#: Texts that the frequent pre-tokens are counted in, pre-tokens in the table, and in a worker's cache.
TEXTS, TABLE, CACHE = 2000, 50_000, 400_000
#: Characters of a text that the frequent pre-tokens are counted in, at most.
MODERATE = 10_000
#: Pre-tokens that are longer than this are encoded but not cached.
LONG = 64

#: Fixed value: the published splitting pattern of this kind of tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def splits(description: str) -> bool:
    """Whether a description's texts are split by SPLIT, and by special strings as they stand, and nothing else is done to them."""
    d = json.loads(description)
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    plain = d.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
    bytewise = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
    return plain and bytewise and not any(x.get(k) for x in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))


class Counter:
    """Counts tokens of texts as the tokenizer of a JSON description does."""

    def __init__(self, description: str, table: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(description)
        library.no_truncation()
        library.no_padding()
        self.encode, self.splits = library.encode_batch_fast, splits(description)
        specials = [x["content"] for x in json.loads(description)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.split = regex.compile(SPLIT).findall
        self.table, self.cache = table, {}

    def lengths(self, missing: list[str]) -> None:
        for lo in range(0, len(missing), 4096):
            part = missing[lo : lo + 4096]
            self.cache.update(zip(part, map(len, self.encode(part, add_special_tokens=False)), strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.encode([t or "" for t in texts], add_special_tokens=False)]
        out, pending, missing = [], [], set()
        get = self.table.get
        for i, t in enumerate(texts):
            n = 0
            pieces = [t] if t else []
            if t and self.special and self.special.search(t):
                pieces = self.special.split(t)
                n = len(pieces) - 1
            for p in pieces:
                parts = self.split(p)
                known = [get(x) for x in parts]
                if None in known:
                    rest = collections.Counter(x for x, k in zip(parts, known, strict=True) if k is None)
                    pending.append((i, rest))
                    missing.update(rest)
                    known = filter(None, known)
                n += sum(known)
            out.append(n)
        if len(self.cache) + len(missing) > CACHE:
            self.cache.clear()
        self.lengths([x for x in missing if x not in self.cache])
        for i, rest in pending:
            out[i] += sum(self.cache[x] * k for x, k in rest.items())
        for x in [x for x in missing if len(x) > LONG]:
            self.cache.pop(x, None)
        return out


def frequent(df: DataFrame, text: str, description: str) -> dict[str, int]:
    """Lengths of at most TABLE pre-tokens, the most frequent ones of the first TEXTS texts of moderate length."""
    split, seen = regex.compile(SPLIT).findall, collections.Counter()
    for r in df.select(F.col(text).alias("t")).where(F.length("t") <= MODERATE).limit(TEXTS).collect():
        seen.update(x for x in split(r.t) if len(x) <= LONG)
    counter, top = Counter(description, {}), [x for x, _ in seen.most_common(TABLE)]
    counter.lengths(top)
    return {x: counter.cache[x] for x in top}


def counted(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row; tokenizer: the path, on the driver, of its JSON description."""
    with open(tokenizer, encoding="utf-8") as f:
        description = f.read()
    table = frequent(df, text, description) if splits(description) else {}
    name, held = f"tokens {kit.digest(description, sorted(table.items()))}", df.sparkSession.sparkContext.broadcast((description, table))

    def run(batches):
        counter = kit.kept_in_worker(name, lambda: Counter(*held.value))
        for b in batches:
            texts = b.column(1).to_pylist()
            size = pa.compute.binary_length(b.column(1).cast(pa.binary())).fill_null(0).cast(pa.int64())
            n = []
            for lo in range(0, len(texts), 128):
                n += counter.counts(texts[lo : lo + 128])
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(kit.lean(run, name), f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = counted(kit.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
