"""Exact duplicates against brute force, with buckets small enough to split and chain."""

import hashlib

import pytest

from fleetaudit.llm import exact_dedup as ex
from fleetaudit.session import work_dir

SCHEMA = "doc_id long, text string, hash long, kept string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(low(t), []).append(d)
    out = []
    for d, t, *_ in rows:
        ids = groups[low(t)]
        best = max((i for i in ids if i is not None), default=None)
        out.append((d, best, len(ids), d == best, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def case():
    rows = [(i, f"Text {i % 37} É", 1, "x") for i in range(300)]
    rows += [(1000 + i, "HOT text", None, None) for i in range(150)]  # a third of all rows
    rows += [(5000, None, 1, None), (5001, "", None, "x"), (5002, "É", 1, "a"), (5003, "é", 1, "a"), (5003, "é", 1, "a")]
    rows += [(None, "no id", 1, "x"), (None, None, 1, "x"), (6000, "Long " * 200_000, 1, "x"), (6001, "long " * 200_000, 1, "x")]
    return rows


@pytest.mark.parametrize("capacity", [ex.CAPACITY, 2])
def test_matches_brute_force(spark, capacity):
    rows = case()
    found = ex.exact_duplicates(spark.createDataFrame(rows, SCHEMA), work_dir(spark), capacity)
    got = sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found.collect()], key=repr)
    assert got == brute(rows)


def test_directory_splits_only_overfull_buckets(spark):
    spread = [(i << 58,) for i in range(-32, 32)] + [((1 << 57) + i,) for i in range(40)]
    cells, depth = ex.directory(spark.createDataFrame(spread, "hash long"), 16)
    rows = cells.collect()
    assert len({r["cell"] for r in rows}) == len(rows)
    depths = {r["local_depth"] for r in rows}
    assert min(depths) < max(depths) <= depth
    for r in rows:
        assert r["bucket"] == r["cell"] >> (depth - r["local_depth"])


def test_equal_hashes_chain(spark, monkeypatch):
    """All texts share one hash: the bytes decide, and entries chain."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(ex.F, "xxhash64", lambda *a: F.lit(5).cast("long"))
    rows = [(1, "a", 0, ""), (2, "b", 0, ""), (3, "A", 0, ""), (4, "c", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    index = ex.build_index(docs.select("doc_id", "text"), work_dir(spark))
    assert sorted(r["chain"] for r in index.collect()) == [0, 1, 2]
    got = {r["doc_id"]: r["keep_id"] for r in ex.exact_duplicates(docs, work_dir(spark)).collect()}
    assert got == {1: 3, 2: 2, 3: 3, 4: 4}


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame(case(), SCHEMA)
    left = ex.drop_exact_duplicates(docs, work_dir(spark))
    assert left.columns == docs.columns
    assert {low(r["text"]) for r in left.collect()} == {low(t) for _, t, *_ in case()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ex.exact_duplicates(docs, work_dir(spark)).count() == 0
    assert ex.drop_exact_duplicates(docs, work_dir(spark)).count() == 0
