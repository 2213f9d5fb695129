"""Phrase and proximity matches of the positional index against brute force."""

import hashlib
import random
import re

import pytest

from fleetaudit.llm import decontaminate as dc
from fleetaudit.session import work_dir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, segment string, n_words string", "item_id long, text string, item string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13):
    windows = {}
    for i, t, *_ in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def case(seed=1):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["the", "of", "and", "Öl", "é", "x1", *map(str, range(12))]) for _ in range(n))
    items = [(k, say(rng.choice((3, 12, 13, 14, 30))), "x") for k in range(25)]
    items += [(100, items[0][1], None), (101, None, "x"), (102, " .,", "x"), (None, say(20), "x"), (103, "alone", None)]
    docs = []
    for k in range(120):
        parts = [say(rng.choice((0, 5, 60)))]
        for _ in range(rng.choice((0, 0, 1, 3))):
            parts += [rng.choice(items)[1] or "", say(rng.choice((0, 2, 40)))]
        docs.append((k, rng.choice((" ", "\n", ", ")).join(parts).replace(" ", rng.choice((" ", "-", "  "))), "a", None))
    long = say(100_000) + " " + items[3][1].upper() + " " + say(50)
    docs += [(900, None, None, None), (901, "", "a", None), (902, long, "a", "b"), (903, "ALONE!", None, None), (903, "ALONE!", None, None),
             (None, items[4][1], None, "x")]
    return docs, items


@pytest.mark.parametrize("block", [dc.WINDOW_BLOCK, 40])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dc.phrase_matches, "__defaults__", (dc.WINDOW, block))
    docs, items = case()
    found = dc.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), work_dir(spark))
    got = sorted([tuple(r) for r in found.collect()], key=repr)
    assert got == brute(docs, items)
    assert 0 < sum(r[5] for r in got) < len(got)


def test_filter_keeps_columns(spark):
    docs, items = case(2)
    table = spark.createDataFrame(docs, DOCS)
    left = dc.drop_contaminated(table, spark.createDataFrame(items, ITEMS), work_dir(spark))
    assert left.columns == table.columns
    want = sorted(repr(d) for d, b in zip(docs, [r for d in docs for r in brute([d], items)], strict=True) if not b[5])
    bad = {b[0] for d in docs for b in brute([d], items) if b[5]}
    assert sorted(repr(tuple(r)) for r in left.collect()) == [w for w in want if eval(w)[0] not in bad]


def test_proximity(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((0, 3, 40)))), "", "") for k in range(60)]
    index = dc.build_index(spark.createDataFrame(docs, DOCS).coalesce(1), work_dir(spark))
    for terms, within in ((["a", "b", "c"], 4), (["h"], 1), (["a", "zzz"], 9), (["A b"], 3)):
        asked = {w for t in terms for w in words(t)}
        want = set()
        for d, t, *_ in docs:
            w = words(t)
            spans = {(s, e) for s in range(len(w)) for e in range(s + 1, min(len(w), s + within) + 1) if asked <= set(w[s:e])}
            want |= {(d, s, e) for s, e in spans if not any((a, b) != (s, e) and s <= a and b <= e for a, b in spans)}
        found = dc.proximity_matches(index, [("q", terms)], within).join(dc.index_documents(index), ["segment", "doc_no"])
        assert {(r["doc_id"], r["first"], r["last"]) for r in found.collect()} == want


def test_empty_tables(spark):
    docs, items = case()
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame(docs, DOCS)
    assert dc.contamination(none, spark.createDataFrame(items, ITEMS), work_dir(spark)).count() == 0
    clean = dc.contamination(some, spark.createDataFrame([], ITEMS), work_dir(spark)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] or r["n_hit"] for r in clean)
