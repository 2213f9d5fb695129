"""Language, quality and pseudo-likelihood models: definitions, held-out accuracy, edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetaudit.llm import language, lm_score, quality
from fleetaudit.session import work_dir

EDGE = [(1, None, None, None), (2, "", "en", "x"), (3, " 12 %!", None, "x"), (None, "the cat", "en", None), (4, "word " * 60_000, "en", "x"),
        (4, "word " * 60_000, "en", "x"), (5, "É", "fr", "x")]
SCHEMA = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def plain_ngrams(text):
    """Runs of one to three characters of the text between blanks, each with a letter."""
    out, flat = [], "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    flat = " ".join(flat.split(" "))
    while "  " in flat:
        flat = flat.replace("  ", " ")
    for n in (1, 2, 3):
        out += [flat[i:i + n] for i in range(len(flat) - n + 1) if flat[i:i + n].strip()]
    return Counter(out)


@pytest.mark.parametrize("text", ["a", "Hello, world!", "É 12 b", "x1y  z", "中文 ok", "𝒳y"])
def test_ngrams_equal_the_definition(text):
    bucket, owner, known = language.ngram_buckets(["junk", text, None, "!"])
    grams = Counter(bucket[owner == 1].tolist())
    assert sum(grams.values()) == sum(plain_ngrams(text).values())
    assert known.tolist() == [True, True, False, False]


def test_language_held_out(spark, documents):
    rows = language.identify_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.99 * len(held)


def test_language_counts_cover_all_rows(spark):
    docs = spark.createDataFrame([(k, "ab", "en", "") for k in range(50)], SCHEMA).repartition(5)
    counts = {r["bucket"]: r["n"] for r in language.bucket_counts(docs).collect()}
    assert counts.pop(-1) == 50 and sum(counts.values()) == 50 * 7  # a b, " a" "ab" "b ", " ab" "ab "


def test_language_edges(spark):
    docs = spark.createDataFrame(EDGE + [(k, "le la les", "fr", "") for k in range(10, 19)], SCHEMA)
    rows = language.identify_languages(docs).collect()
    assert len(rows) == len(EDGE) + 9
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [got[k] for k in (1, 2, 3)] == ["und"] * 3 and got[4] == "en"
    unlabelled = language.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    assert language.identify_languages(docs.limit(0)).count() == 0


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        chunks = quality.chunk_bytes("".join(chr(97 + i % 26) for i in range(n))) & 255
        seen = np.zeros(max(n, 1), bool)
        for k in range(len(chunks)):
            seen[k * quality.STEP:k * quality.STEP + quality.CHUNK] = True
        assert n == 0 or seen[:n].all()


def test_repeats_equal_the_definition():
    rng = random.Random(3)
    for _ in range(40):
        data = bytes(rng.choice(b"ab c") for _ in range(rng.randrange(90)))
        want = [any(i - lag >= 5 and data[i - 5:i + 1] == data[i - 5 - lag:i + 1 - lag] for lag in range(2, quality.LAG)) for i in range(len(data))]
        assert quality._repeats(np.frombuffer(data, np.uint8)).tolist() == want


def test_quality_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in quality.fit([], np.empty(0)).items()}
    for v in w.values():
        v += rng.normal(0, 0.2, v.shape)
    chunks, starts, labels = rng.integers(0, 512, (5, quality.CHUNK)).astype(np.uint16), np.array([0, 2]), np.array([1.0, 0.0])

    def loss():
        p = quality.score_chunks(w, chunks, starts)
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    for key, g in quality._gradients(w, chunks, starts, labels).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        held = w[key][at]
        w[key][at] = held + 1e-5
        up = loss()
        w[key][at] = held - 1e-5
        down = loss()
        w[key][at] = held
        assert np.isclose(g[at], (up - down) / 2e-5, rtol=1e-2, atol=1e-6), key


def test_quality_gradients_by_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    w = quality.fit([], np.empty(0))
    w["out"] = rng.normal(0, 1, w["out"].shape).astype(np.float32)
    chunks, starts, labels = rng.integers(0, 512, (37, quality.CHUNK)).astype(np.uint16), np.array([0, 9, 10]), np.array([1.0, 0.0, 1.0])
    whole = quality._gradients(w, chunks, starts, labels)
    monkeypatch.setattr(quality, "BLOCK", 4)
    for key, g in quality._gradients(w, chunks, starts, labels).items():
        assert np.allclose(g, whole[key], atol=1e-5), key


def test_quality_trains_on_whole_texts(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(30_000))
    docs = spark.createDataFrame([(2, text), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int")
    rows = {r["label"]: np.frombuffer(r["inputs"], np.uint16) for r in quality.training_rows(docs, labels).collect()}
    assert bytes((rows[1] & 255).astype(np.uint8)).rstrip(b"\0").decode() == text and len(rows[0]) == quality.CHUNK
    assert len(quality.as_chunks(rows[1])) == len(quality.chunk_bytes(text)) > 24


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.classify_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    assert sum(r["predicted"] for r in held if r["quality"] == 1) >= 0.99 * sum(r["quality"] for r in held)


def test_quality_edges(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    labels = spark.createDataFrame([(2, 1, None), (2, 1, None), (3, None, 1), (None, 0, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = quality.classify_quality(docs, given).collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert quality.classify_quality(docs.limit(0), labels).count() == 0
    weights = quality.fit([], np.empty(0))
    assert quality.drop_low_quality(docs, weights).collect() == docs.collect()


def _plain_log_prob(w, seen, token):
    """Log-probability of a token by the formulas, without blocks."""
    k = w["class_bias"].size
    h = np.maximum(np.concatenate([w["embed"][s] for s in seen]) @ w["inner"] + w["inner_bias"], 0)
    a, b = h @ w["classes"] + w["class_bias"], h @ w["words"][token % k] + w["word_bias"][token % k]
    return a[token % k] - np.log(np.exp(a).sum()) + b[token // k] - np.log(np.exp(b).sum())


def _moved(layout, seed=5):
    rng = np.random.default_rng(seed)
    return {k: v + rng.normal(0, 0.1, v.shape) for k, v in lm_score.first_weights(layout).items()}


def test_pseudo_likelihood_equals_the_definition(spark):
    w, byte_w = _moved(lm_score.SHAPES), _moved(lm_score.BYTE_SHAPES)
    known = {b"the": 1, b"cat": 2}

    def token_of(word):
        a, b, c = (*word[:-4:-1], 0, 0)[:3]
        return known.get(word, lm_score.TOKENS - lm_score.ENDINGS + ((a + 257 * b + 257 * 257 * c) * 40_503 >> 4) % lm_score.ENDINGS)

    def plain(weights, ids):
        line = [0, 0, *ids, 0, 0]
        return sum(_plain_log_prob(weights, line[i:i + 2] + line[i + 3:i + 5], t) for i, t in enumerate(ids))

    texts = ["The cat sat", None, "cat", "a b c d e f the", "naïve sat sat", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.score_documents(lm_score.tokenized(docs, known, byte_w), w).collect()}
    for k, text in enumerate(texts):
        words = lm_score.split_words(text)
        want = plain(w, [token_of(x) for x in words]) + sum(plain(byte_w, list(x)) for x in words if x not in known)
        assert got[k]["n_tokens"] == len(words) and np.isclose(got[k]["log_prob"], want, rtol=1e-5)


def test_words_are_cut_at_ascii_white_space_alone():
    texts = ["  The cat\tsat ", None, "", " \n", "a\x1fb\x0bC\x0cd\r\u00a0e\u2003f \u00c9\u0130K", "x"]
    words, sizes = lm_score.words_of(pa.array(texts))
    want = [lm_score.split_words(t) for t in texts]
    assert words.to_pylist() == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]


def test_equal_neighbourhoods_of_bytes_are_worked_out_once(monkeypatch):
    byte_w = _moved(lm_score.BYTE_SHAPES)
    words = [b"banana", b"banana", b"bananana", b"\xc3\xa9", b"a", b"\xff\xfe"]
    want = [sum(_plain_log_prob(byte_w, (line := [0, 0, *x, 0, 0])[i:i + 2] + line[i + 3:i + 5], t) for i, t in enumerate(x)) for x in words]
    asked = []
    plain = lm_score.log_probs
    monkeypatch.setattr(lm_score, "log_probs", lambda w, near, token: asked.append(len(token)) or plain(w, near, token))
    assert np.allclose(lm_score.spelling(byte_w, words), want, rtol=1e-5)
    assert sum(asked) == len({(x[max(0, i - 2):i], x[i:i + 3]) for x in words for i in range(len(x))})


def test_every_byte_of_a_rare_word_counts(spark):
    byte_w = _moved(lm_score.BYTE_SHAPES)
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "xbcdefgh"), (3, "abcdXfgh")], "doc_id long, text string")
    assert len({r["spelled"] for r in lm_score.tokenized(docs, {}, byte_w).collect()}) == 3


@pytest.mark.parametrize("layout", [lm_score.shapes(4, 3, 5), lm_score.BYTE_SHAPES])
def test_gradients_are_those_of_the_mean_log_probability(layout):
    rng = np.random.default_rng(8)
    w = _moved(layout)
    n, most = 150, w["embed"].shape[0]
    near, token = rng.integers(0, most, (n, 4)).astype(np.uint16), (rng.integers(0, most, n) ** 2 // most).astype(np.uint16)
    loss = lambda x: -np.mean([_plain_log_prob(x, seen, int(t)) for seen, t in zip(near, token, strict=True)])
    for k, g in lm_score.gradients(w, near, token).items():
        assert g.shape == w[k].shape
        for place in rng.integers(0, g.size, 8):
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k].flat[place] += 1e-5
            down[k].flat[place] -= 1e-5
            assert np.isclose(g.flat[place], (loss(up) - loss(down)) / 2e-5, rtol=1e-3, atol=1e-7)


def test_copies_are_averaged_by_the_tokens_they_saw(spark):
    w = lm_score.first_weights(lm_score.BYTE_SHAPES)
    size = sum(v.size for v in w.values())
    flat = np.arange(size, dtype=float)
    rows = [(p, seen, (flat[p * lm_score.PART:(p + 1) * lm_score.PART] * scale).tolist())
            for seen, scale in ((1.0, 1.0), (3.0, 2.0)) for p in range(-(-size // lm_score.PART))]
    copies = spark.createDataFrame(rows, "part int, seen double, weights array<double>")
    mean = lm_score.averaged(copies, w)
    assert np.allclose(np.concatenate([v.ravel() for v in mean.values()]), flat * 1.75)
    assert {k: v.shape for k, v in mean.items()} == {k: v.shape for k, v in w.items()}
    assert lm_score.averaged(copies.limit(0), w) is w


def test_spelling_learns_words(spark):
    rng = random.Random(4)
    part = lambda: "".join(rng.choice("bdg") + rng.choice("aei") for _ in range(4))
    counts = spark.createDataFrame([(bytearray(part().encode()), 1) for _ in range(60_000)], "word binary, n long")
    w = lm_score.fit_spelling(counts.repartition(2), {}, rate=0.02)
    like, unlike = lm_score.spelling(w, [b"badegiba", b"qzxkvwpj"])
    assert like > unlike + 5


def test_pseudo_likelihood_learns(spark):
    rng = random.Random(1)
    grammar = lambda n: " ".join("the big dog saw a small cat ." for _ in range(n))
    rows = [(k, grammar(rng.randrange(20, 60)), "en", "") for k in range(300)]
    shuffled = grammar(40).split()
    rng.shuffle(shuffled)
    probe = [(1, grammar(40), "", ""), (2, " ".join(shuffled), "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    known = lm_score.fit_tokens(docs, work_dir(spark))
    w = lm_score.fit_network(lm_score.tokenized(docs, *known), rate=0.02)
    got = {r["doc_id"]: r for r in lm_score.score_documents(lm_score.tokenized(spark.createDataFrame(probe, SCHEMA), *known), w).collect()}
    assert got[1]["mean_log_prob"] > got[2]["mean_log_prob"] + 0.5
    assert got[1]["n_tokens"] == 320 and np.isclose(got[1]["log_prob"], 320 * got[1]["mean_log_prob"])


def test_frequent_words_are_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "ENDINGS", lm_score.TOKENS - 11)
    rng = random.Random(2)
    words = [f"w{min(rng.randrange(1, 200), rng.randrange(1, 200))}" for _ in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(words[k::7]), "", "") for k in range(7)], SCHEMA)
    best = sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:10]
    assert lm_score.frequent_words(lm_score.word_counts(docs)) == {w.encode(): 1 + i for i, (w, _) in enumerate(best)}


def test_pseudo_likelihood_edges(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    rows = {r["doc_id"]: r for r in lm_score.pseudo_likelihood(docs, work_dir(spark)).collect()}
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == 0 and rows[1]["log_prob"] == 0
    assert rows[5]["n_tokens"] == 1 and rows[5]["log_prob"] < 0 and rows[4]["n_tokens"] == 60_000
    assert lm_score.pseudo_likelihood(docs.limit(0), work_dir(spark)).count() == 0
    counts = {bytes(r["word"]): r["n"] for r in lm_score.word_counts(docs).collect()}
    assert counts == {b"word": 120_000, b"the": 1, b"cat": 1, b"12": 1, b"%!": 1, "É".encode(): 1}
