"""Classifiers by held-out accuracy, language model scores by enumeration, neighbours by recall against brute force."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import language, lattice, neighbours, quality, svm

DATA = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = quality.op3(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert {r.held_out for r in rows} == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(own) > 50 and sum(r.predicted == r.quality for r in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_without_both_labels(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, None, 1)], "doc_id long, text string, label int")
    assert quality.scores(quality.fit(df), [b"x", None]).tolist() == [1, 1]
    assert quality.scores(quality.fit(df.limit(0)), [None]).tolist() == [0.5]


def test_quality_of_long_texts(spark):
    """80 texts in which most n-grams occur: the driver gets some 16 KB of each, where their ids take 380 KB."""
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789      ", np.uint8)
    texts = [rng.choice(letters, 150_000).tobytes().decode() + (" bad" * 4000 if i % 2 else "") for i in range(80)]
    assert sum(4 * len(np.unique(quality.ngrams(t.encode()))) for t in texts) > 20_000_000
    df = spark.createDataFrame([(i, t, 1 - i % 2) for i, t in enumerate(texts)], "doc_id long, text string, label int").repartition(8)
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "4m")
    try:
        model = quality.fit(df)
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert ((quality.scores(model, [t.encode() for t in texts]) >= 0.5) == (np.arange(80) % 2 == 0)).all()


def test_the_driver_gets_the_model_alone(spark):
    """400 texts, whose sets take 6 MB together; the model takes 1 MB."""
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789      ", np.uint8)
    texts = [rng.choice(letters, 30_000).tobytes().decode() + (" bad" * 400 if i % 2 else "") for i in range(400)]
    assert sum(len(quality.packed(np.unique(quality.ngrams(t.encode())))) for t in texts) > 6_000_000
    df = spark.createDataFrame([(i, t, 1 - i % 2) for i, t in enumerate(texts)], "doc_id long, text string, label int").repartition(8)
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "3m")
    try:
        model = quality.fit(df)
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert ((quality.scores(model, [t.encode() for t in texts]) >= 0.5) == (np.arange(400) % 2 == 0)).all()


def test_packed_sets_are_whole():
    rng = np.random.default_rng(2)
    ratios = rng.normal(size=quality.SIZE)
    plain = [np.sort(rng.choice(quality.SIZE, n, replace=False)) for n in (0, 1, quality.BYTES // 4, quality.BYTES // 4 + 1, 60_000, quality.SIZE)]
    sets = [quality.packed(x) for x in plain]
    assert max(map(len, sets)) <= quality.BYTES
    for x, s, (ids, values) in zip(plain, sets, quality._Rows(sets, ratios), strict=True):
        assert quality.unpacked(s).tolist() == ids.tolist() == x.tolist()
        assert np.array_equal(values, (ratios[x] / max(np.linalg.norm(ratios[x]), 1e-12)).astype(np.float32))


def test_labels_of_other_documents_take_no_part(spark):
    """As many labels again for 99 tables' documents: the same rows are learned from."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    label = lambda n: spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    own, all_ = (sorted(map(tuple, quality.learnable(docs, label(n)).collect())) for n in (600, 60_000))
    assert own == all_ and len(own) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(600))
    few = quality.learnable(docs, label(60_000).withColumn("doc_id", F.col("doc_id") * 100))
    assert few.count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(0, 600, 100))


def test_hinge_model_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] - x[:, 1] + 0.3 > 0, 1, -1)
    w = svm.descend([(np.arange(5), v) for v in x], y, 5, c=10, epochs=200)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.98
    a, b = svm.calibrated(x @ w[:-1] + w[-1], y)
    assert a > 0 and math.isfinite(b)


def test_language_on_held_out_rows(spark):
    rows = language.op5(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in own) >= 0.98 * len(own) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_nothing(spark):
    model = language.fit(spark.createDataFrame([(1, "le la les", "fr"), (2, "the of and", "en"), (3, None, "de")], "doc_id long, text string, lang string"))
    names, score = language.predict(model, [None, "", "12 %", "the and of the", "les la le"])
    assert names == ["und", "und", "und", "en", "fr"] and (score[:3] == 0).all()
    assert language.predict(language.fit(spark.createDataFrame([], "doc_id long, text string, lang string")), ["a"])[0] == ["und"]


def test_families_join_like_profiles():
    c = {"a": np.array([1.0, 0, 0]), "b": np.array([0.9, 0.1, 0]), "c": np.array([0, 0, 1.0]), "d": np.array([0, 0.1, 0.9])}
    assert language.families(c, 2) == [["a", "b"], ["c", "d"]]


@pytest.mark.parametrize("head", [lattice.HEAD, 50])
def test_word_counts_and_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lattice, "HEAD", head)
    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c, ends = collections.Counter(), sum(not v for v in out.values())
    for i, w in docs.items():
        if not out[i]:
            c.update(w)
    n, v = sum(c.values()) + ends, len(c) + 1
    for r in lattice.op4(spark, DATA).collect():
        w = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (out[r.doc_id], len(w) + 1, n, sum(c[x] > 0 for x in w) + 1)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert abs(r.base_score - base) <= 1e-9 * abs(base) and math.isfinite(r.score) and r.score < 0


def test_marginal_is_the_sum_over_all_segmentations():
    names = [b" ", b" a", b"a", b"b", b"ab", b"ba", b"bb", b" ab"] + [bytes([x]) for x in range(256) if bytes([x]) not in (b" ", b"a", b"b")]
    rng = np.random.default_rng(4)
    p = rng.random(len(names))
    logp = np.log(p / p.sum())
    own = lattice.Lattice(names, logp)

    def total(w):
        return 1.0 if not w else sum(math.exp(logp[i]) * total(w[len(x) :]) for i, x in enumerate(names) if w.startswith(x))

    words = [b"", b"a", b"ab", b"abba", b"bbabab", b"xa", b"\xc3\xa9b"]
    assert np.allclose(own.marginals(words), [math.log(total(b" " + w)) for w in words])
    counts, expected = np.arange(1.0, 8), np.zeros(len(names))
    own.marginals(words, counts, expected)
    spelled = sum(len(names[i]) * e for i, e in enumerate(expected))
    assert abs(spelled - sum(k * (len(w) + 1) for w, k in zip(words, counts, strict=True))) < 1e-9
    single = np.zeros(len(names))
    for w, k in zip(words, counts, strict=True):
        own._one(b" " + w, k, single)
    assert np.allclose(single, expected)


def test_long_words_and_vocabulary():
    names, start = lattice.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    own = lattice.Lattice(names, start - np.log(np.exp(start).sum()))
    assert len(set(names)) == len(names) and all(bytes([b]) in set(names) for b in range(256))
    got = own.marginals([b"ab" * 3000, b"tion"])
    assert np.isfinite(got).all() and got[0] < got[1] < 0


def test_every_piece_of_a_large_vocabulary_is_found():
    rng = np.random.default_rng(7)
    names = sorted({bytes(x) for x in rng.integers(97, 123, (240_000, 5), dtype=np.uint8)} | {bytes([b]) for b in range(256)})
    own = lattice.Lattice(names, np.zeros(len(names)))
    assert len(own.tables) >= 3 and (own._find(own.hashes[:-1]) == np.arange(len(names))).all()
    assert (own._find(own.hashes[:1000] + np.uint64(12345)) == -1).sum() >= 999


def test_windows_of_a_long_word(monkeypatch):
    """A word over LONG, in one window and in many, has the sum over all segmentations that the short one's code gives."""
    names = [b" ", b" a", b"a", b"b", b"ab", b"ba", b"bab", b"abb"] + [bytes([x]) for x in range(256) if x not in b" ab"]
    rng = np.random.default_rng(4)
    logp = np.log(rng.dirichlet(np.ones(len(names))))
    own, word = lattice.Lattice(names, logp), bytes(rng.choice([97, 98, 120], 300).tolist())
    want = np.zeros(len(names))
    monkeypatch.setattr(lattice, "LONG", 400)
    own = lattice.Lattice(names, logp)
    total = own.marginals([word], np.array([3.0]), want)[0]
    for window in (1 << 14, 7, 1):
        monkeypatch.setattr(lattice, "WINDOW", window)
        got = np.zeros(len(names))
        assert abs(own._one(b" " + word, 3.0, got) - total) < 1e-9 * abs(total) and np.allclose(got, want)


def test_memory_of_a_very_long_word():
    import tracemalloc

    names, start = lattice.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    own, word = lattice.Lattice(names, start - np.log(np.exp(start).sum())), bytes(np.random.default_rng(1).integers(97, 123, 200_000, dtype=np.uint8))
    tracemalloc.start()
    assert math.isfinite(own._one(b" " + word, 1.0, np.zeros(len(names))))
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_scores_of_unigram_models_are_used():
    names, score = lattice.listed([("▁a", -1.5), ("b", -0.5), ("▁a", -9.0)], True)
    assert names[:2] == [b"b", b" a"] and score[:2].tolist() == [-0.5, -1.5] and set(score[2:]) == {-1.5} and len(names) == 257
    assert lattice.listed([("a", -3.0)], False)[1][0] == -math.log(10)


@pytest.mark.parametrize("head", [lattice.HEAD, 4])
def test_scores_of_documents_are_sums_over_all_segmentations(spark, monkeypatch, head):
    """Query-level: each document's score, by enumeration with the probabilities that were learned."""
    monkeypatch.setattr(lattice, "HEAD", head)
    texts = ["the cat", "a cat the", None, " ", "Cat dog", "the the the a", "x¿"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path, learned = public_tokenizers.path("piece_bpe_32k.model"), {}
    own = lattice.learned_pieces

    def kept(words, names, start, ends):
        learned["names"], learned["logp"] = names, own(words, names, start, ends)
        return learned["logp"]

    monkeypatch.setattr(lattice, "learned_pieces", kept)
    got = {r["__id"]: r["score"] for r in lattice.scored(df, F.lit(True), path).collect()}
    p = dict(zip(learned["names"], np.exp(learned["logp"][:-1]), strict=True))

    def total(w):
        return 1.0 if not w else sum(p[w[:n]] * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in p)

    for i, t in enumerate(texts):
        want = sum(math.log10(total(b" " + w)) for w in (t or "").encode().lower().split()) + learned["logp"][-1] / math.log(10)
        assert abs(got[i] - want) < 1e-9 * abs(want)


@pytest.mark.parametrize("chunk, block, rerank", [(neighbours.CHUNK, neighbours.BLOCK, neighbours.RERANK), (neighbours.CHUNK, neighbours.BLOCK, 2), (90, 7, 1)])
def test_neighbours_recall(spark, monkeypatch, chunk, block, rerank):
    """The middle one leaves it to the codes which 40 of 500 rows are ranked again."""
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "RERANK", rerank)
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = collections.defaultdict(list)
    for r in neighbours.op8(spark, DATA).collect():
        got[r.query_id].append(r)
    hit = 0
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, own in got.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.argsort(-s)[:20]]) & {r.vec_id for r in own})
        assert all(abs(s[ids == r.vec_id][0] - r.score) < 1e-12 for r in own)
    assert hit >= 0.9 * 20 * len(got)


def test_neighbours_of_odd_vectors(spark, folder):
    rows = [(i, [1.0, float(i % 3)]) for i in range(1, 60)] + [(0, [1.0, 1.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (100, [float("inf"), 0.0]), (120, []), (140, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows = [r for r in rows if r[0] not in (20, 40) or r[1] is None or r[1] == [0.0, 0.0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in neighbours.op8(spark, folder(embeddings=df)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0}
    want = sorted(((i, 1.0 + i % 3) for i in range(1, 60) if i not in (20, 40)), key=lambda r: (-r[1], r[0]))[:20]
    assert got[0] == want
    assert neighbours.op8(spark, folder(embeddings=df.limit(0))).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r["rank"], r.score) for r in neighbours.op8(spark, folder(embeddings=few)).collect()] == [(5, 1, 2.0)]


def test_cells_hold_lists_of_a_size():
    rng = np.random.default_rng(3)
    for _ in range(20):
        size = rng.choice([0, 1, 4, 9, 10, 35], 30)
        begin, parts = neighbours.cells(rng.normal(size=(30, 3)), size, 10)
        load = collections.Counter()
        for b, k, n in zip(begin.tolist(), parts.tolist(), size.tolist(), strict=True):
            assert k == max(1, -(-n // 10))
            load.update({b: n} if k == 1 else dict.fromkeys(range(b, b + k), 10))
        assert max(load.values()) <= 10


def test_queries_go_to_cells_that_they_probe_only(spark, monkeypatch):
    """Clustered vectors and few probes: of 12 cells each query reaches few, and finds its cluster."""
    monkeypatch.setattr(neighbours, "CHUNK", 100)
    monkeypatch.setattr(neighbours, "PROBE", 0.05)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 10
    x = np.concatenate([c + rng.normal(size=(100, 16)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.search(df, lambda i: i % 20 == 0)
    hit = collections.Counter()
    got = collections.defaultdict(set)
    for r in out.collect():
        got[r.query_id].add(r.vec_id)
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit.update(n=len(found & set(np.argsort(-s)[:20].tolist())))
    assert len(got) == 60 and hit["n"] >= 0.9 * 20 * 60


def test_codes_leave_a_hundredth_to_rank_again(spark):
    """20,000 vectors without structure, in three cells: 100 rows of a cell are ranked again, 300 of 20,000."""
    x = np.random.default_rng(8).normal(size=(20_000, 16))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}))
    found, hit = collections.defaultdict(set), 0
    for r in neighbours.search(df, lambda i: i % 400 == 0).collect():
        found[r.query_id].add(r.vec_id)
    for q, own in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(own & set(np.argsort(-s)[:20].tolist()))
    assert len(found) == 50 and hit >= 0.95 * 20 * 50


def test_neighbours_of_small_tables(spark):
    rng = np.random.default_rng(4)
    for n in (3, 8, 15, 21, 22, 30):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 16)))], "vec_id long, embedding array<double>")
        got = neighbours.search(df, lambda i: i >= 0).groupBy("query_id").count().collect()
        assert len(got) == n and {r["count"] for r in got} == {min(20, n - 1)}


def test_samples_have_a_hard_bound(spark):
    """300 languages; one id with very many rows, of one text and of many."""
    df = spark.createDataFrame([(i, f"l{i:03}") for i in range(300)], "doc_id long, lang string")
    assert svm.sampled(df, "lang", F.col("doc_id"), 500).select("lang").distinct().count() == 300
    one = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("lang"), F.concat(F.lit("t"), F.col("id")).alias("t"))
    assert svm.sampled(one, "lang", F.col("doc_id"), 500, F.col("t")).count() == 500
    assert svm.sampled(one.withColumn("t", F.lit("t")), "lang", F.col("doc_id"), 500, F.col("t")).count() <= 1


def test_counts_of_many_labels_are_joined(spark, monkeypatch):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("l"), F.col("id") % 300)).alias("lang"))
    rows = lambda: sorted(map(tuple, svm.sampled(df, "lang", F.col("doc_id"), 20).collect()))
    sent = rows()
    assert sum(x == "hot" for _, x in sent) == 20 and None not in {x for _, x in sent} and len({x for _, x in sent}) == df.where("lang IS NOT NULL").select("lang").distinct().count()
    monkeypatch.setattr(svm, "LABELS", 10)
    assert rows() == sent
    assert svm.sampled(df.limit(0), "lang", F.col("doc_id"), 20).collect() == []


def test_language_learns_from_profiles_of_whole_texts(spark, monkeypatch):
    """Texts of 200 KB: no text is ranked or fetched, and what tells the languages apart stands at their ends."""
    conf = spark.sparkContext._jsc.sc().conf()
    rows = [(i, "x y z " * 35_000 + ("le la les " if i % 2 else "the of and ") * 3000, "fr" if i % 2 else "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "3m")
    try:
        model = language.fit(df)
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert language.predict(model, [rows[0][1], rows[1][1]])[0] == ["en", "fr"]


def test_numbers_are_no_letters():
    assert [bool(language.LETTER.search(t)) for t in ("½", "²", "①", "Ⅷ", "12_", "é", "ß", "中")] == [False] * 5 + [True] * 3
