"""Fingerprints, the search for near fingerprints and the groups against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from fleetaudit.llm import simhash
from fleetaudit.session import work_dir


def plain_fingerprint(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in low.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    runs = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(keys, distance=4):
    """Smallest member reachable, by comparing all pairs."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def clouds(seed, n):
    """Fingerprints around a few centres, with chains of near ones."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 12))]
    out = set()
    while len(out) < n:
        c = rng.choice(centres)
        for _ in range(rng.choice((0, 1, 2, 4, 5, 6, 9))):
            c ^= 1 << rng.randrange(64)
        out.add(c)
    return sorted(out)


def parts_of(roots):
    found = {}
    for k, r in roots.items():
        found.setdefault(r, set()).add(k)
    return sorted(map(sorted, found.values()))


@pytest.mark.parametrize("n", [1, 2, 17, 300, 700])
def test_search_finds_every_group(n):
    keys = clouds(n, n)
    fp = np.array(keys, np.uint64)
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    root = simhash.near_groups(fp)
    got = {int(k): int(fp[r]) for k, r in zip(fp, root, strict=True)}
    assert parts_of(got) == parts_of(plain_groups(keys))


def test_dense_cloud_is_one_group():
    fp = np.arange(3000, dtype=np.uint64)
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    assert set(simhash.near_groups(fp)) == {0}


def test_fingerprints_equal_the_definition():
    for text in (None, "", "  \t", "One", "a b c", "The the THE the the", "É b\x0bc  d\ne f É", "x " * 9000, "\x1ca b c d\x85e"):
        assert simhash.fingerprint(simhash.shingle_hashes(text)) & (2**64 - 1) == plain_fingerprint(text)


@pytest.mark.parametrize("split", [1024, 8])
def test_groups_across_shards(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT_FROM", split)
    keys = clouds(5, 400)
    signed = [k - 2**64 if k >= 2**63 else k for k in keys]
    links = simhash.connected(simhash.shard_links(spark.createDataFrame([(k,) for k in signed], "fp long")), work_dir(spark))
    root = dict.fromkeys(signed) | {k: k for k in signed} | {r["a"]: r["b"] for r in links.collect()}
    got = {k & (2**64 - 1): r & (2**64 - 1) for k, r in root.items()}
    assert parts_of(got) == parts_of(plain_groups(keys))


def test_documents(spark):
    long = " ".join(f"word{i}" for i in range(400))
    near = long.replace("word7 ", "other ")
    rows = [(5, long, "x"), (3, near, "x"), (9, None, None), (8, "", "x"), (2, "quite different words stand here", "x"),
            (5, long, "x"), (None, long, "x"), (None, "alone and without an id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, work_dir(spark)).collect())
    texts = {plain_fingerprint(t) for _, t, _ in rows}
    roots = plain_groups(sorted(texts))
    low = {}
    for d, t, _ in rows:
        if d is not None:
            r = roots[plain_fingerprint(t)]
            low[r] = min(d, low.get(r, d))
    want = Counter((d, f"{plain_fingerprint(t):016x}", low.get(roots[plain_fingerprint(t)])) for d, t, _ in rows)
    assert got == want
    assert roots[plain_fingerprint(long)] == roots[plain_fingerprint(near)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs, work_dir(spark)).count() == 0
