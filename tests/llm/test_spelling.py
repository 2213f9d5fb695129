"""Spelling variants against plain counts and plain edit distances, and the bound on affected grams."""

import random
import re
import zlib
from collections import Counter

import pytest

from fleetaudit.llm import queries, spelling
from fleetaudit.session import work_dir


def plain_counts(docs):
    """Counter of words after damage over (doc_id, text)."""
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(counts):
    """word -> (form, root, n, n_near, form_n); near words are looked up by all strings one deletion away."""
    shorter = {}
    for w in counts:
        for v in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            shorter.setdefault(v, set()).add(w)
    near = {w: {x for v in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))} for x in shorter[v] if one_edit(w, x)} for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), form[w] and counts[form[w]])
    return out


def collected(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def edits(rnd, word):
    k = rnd.randrange(len(word) + 1)
    kind = rnd.randrange(3)
    if kind == 0 or k == len(word):
        return word[:k] + rnd.choice("abc") + word[k:]
    return word[:k] + ("" if kind == 1 else rnd.choice("abc")) + word[k + 1:]


@pytest.mark.parametrize("seed", range(8))
def test_bound_on_affected_grams(seed):
    rnd = random.Random(seed)
    letters = "abc"
    for _ in range(400):
        dictionary = {"".join(rnd.choices("^" + letters + "$", k=rnd.randrange(3, 7))) for _ in range(rnd.randrange(0, 120))}
        cutter = spelling.Grams(dictionary)
        word = "".join(rnd.choices(letters, k=rnd.randrange(6, 14)))
        other = edits(rnd, word)
        cuts = []
        for w in (word, other):
            padded = f"^{w}$"
            grams = cutter.of(padded)
            assert len(padded) - 1 == grams[-1][1] and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(grams, grams[1:], strict=False))
            cuts.append((Counter(padded[a:b + 1] for a, b in grams), cutter.affected(padded, grams)))
        (s, s_most), (t, t_most) = cuts
        assert sum((s - t).values()) <= s_most and sum((t - s).values()) <= t_most


def words_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("frequent, grams", [(2, 1 << 16), (5, 1 << 16), (2, 40), (10**6, 1)])
def test_variants_of_dense_words(spark, frequent, grams):
    rnd = random.Random(frequent)
    counts = {"".join(rnd.choices("ab", k=rnd.randrange(6, 10))): rnd.choice([5, 6, 30, 31, 200, 5000]) for _ in range(500)}
    counts |= {"é" * 6: 7, "é" * 7: 35, "ÿé" * 40: 5, "ÿé" * 40 + "a": 25, "x" * 3000: 5, "x" * 3001: 25}
    assert collected(spelling.variant_groups(words_of(spark, counts), work_dir(spark), frequent, grams)) == plain_variants(counts)


def test_query_as_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(plain_counts(docs))
    assert collected(queries.op12(spark, "/root/testdata/sf0.01")) == want
    assert sum(v[0] is not None for v in want.values()) > 100


def test_edges(spark):
    data = [(None, "Straße " * 3, "x", 1), (None, "Straße " * 3, "x", 1), (1, None, "x", 1), (2, "", "x", 1),
            (3, "wording wordings Wording! " * 30_000, "x", 1), (4, "ÉCOLES ÉcoleS écoles\n" * 9, "x", 1), (4, "ÉCOLES ÉcoleS écoles\n" * 9, "x", 1),
            (5, "tied-alpha tiedalphb tiedalpha tiedalphx " * 5, "x", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, word string, n long")
    want = plain_variants(plain_counts([d[:2] for d in data]))
    assert collected(spelling.spelling_variants(docs, work_dir(spark))) == want and {"Écoles", "ÉcoleS"} & set(want) == {"Écoles"}
    assert spelling.spelling_variants(docs.limit(0), work_dir(spark)).count() == 0


def test_counts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 3)
    data = [(k, "alphabet betabeta gammagam deltadel " * 2) for k in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(2)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == plain_counts(data)


def test_very_long_words(spark):
    long = "yz" * 50_000
    got = collected(spelling.variant_groups(words_of(spark, {long: 5, long + "a": 25, "a" + long[1:]: 6}), work_dir(spark), 2))
    assert got == {long: (long + "a", long + "a", 5, 2, 25), long + "a": (None, long + "a", 25, 1, None), "a" + long[1:]: (None, "a" + long[1:], 6, 1, None)}
