"""Benchmark decontamination with a distributed positional inverted index.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.

1. Index.  Each task turns runs of documents into segments and stores them in the shared folder: the
   terms of the segment, the length of each posting list, and the positions, document after document
   with one free place between them.  All tokens are stored; nothing is shuffled.
2. Test terms are ranked by how often they occur in the whole index (sums of list lengths).
3. A search takes test windows in blocks of bounded size against all segments.  The list of a window's
   rarest term, moved by its offset, gives the possible starts; the lists of its other terms, from
   rare to common, are intersected with them.  What is left are exact phrase matches.
   `proximity_matches` asks for the terms of a query within a span of words in any order.
4. Matches become runs (document, item, first word, end); words inside any run are hit.

Edge cases: null and empty texts have no words; items without words have no window; an item shorter
than a window is one window; items with equal windows all match; repeated rows are searched each;
rows without doc_id get a result; items without item_id are named by the empty text; empty tables
give an empty result, or no hit; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, numbered, one_by_one, small_slices, stored

WINDOW = 13
#: Test windows that a search holds at a time (about 20 MB).
WINDOW_BLOCK = 100_000
#: Contaminated: hit words times this reach the words of the document.
SHARE = 20
INDEX = "segment long, doc_ids array<long>, n_words array<int>, terms binary, lengths binary, positions binary"

_LOWER_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER_WORDS).split()


def build_index(docs: DataFrame, folder: str) -> DataFrame:
    """Stores and returns the index of doc_id, text: one row for each segment."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in small_slices(batches, "text"):
            number: dict[bytes, int] = {}
            ids, places, counts, base = [], [], [], 0
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                places.append(np.arange(base, base + len(words), dtype=np.int32))
                counts.append(len(words))
                base += len(words) + 1
            term = np.concatenate(ids)
            order = np.argsort(term, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([counts], pa.list_(pa.int32())), pa.array([b" ".join(number)], pa.binary()),
                 pa.array([np.bincount(term, minlength=len(number)).astype("<i4").tobytes()], pa.binary()),
                 pa.array([np.concatenate(places)[order].astype("<i4").tobytes()], pa.binary())],
                names=["segment", "doc_ids", "n_words", "terms", "lengths", "positions"])
            segment += 1

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, INDEX), f"{folder}/index")


def item_windows(items: Iterator[tuple[str, str | None]], size: int = WINDOW) -> Iterator[tuple[str, tuple[bytes, ...]]]:
    """Item and words of each window; an item of fewer words is one window."""
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            yield item, tuple(words[i:i + size])


def term_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How often each of some terms occurs in the whole index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for row in one_by_one(batch):
                for word, n in zip(row["terms"].split(), np.frombuffer(row["lengths"], "<i4").tolist(), strict=True):
                    if word in terms:
                        total[word] = total.get(word, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    found = index.select("terms", "lengths").mapInArrow(count, "term binary, n long")
    return {bytes(r["term"]): r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}


class Segment:
    """Posting lists of one segment for the terms of a search."""

    def __init__(self, terms: bytes, lengths: bytes, positions: bytes, wanted: dict[bytes, int], gap: int):
        size = np.frombuffer(lengths, "<i4")
        self.positions = np.frombuffer(positions, "<i4")
        self.first = np.zeros(len(wanted) + 1, np.int64)
        self.length = np.zeros(len(wanted) + 1, np.int64)
        ends = np.cumsum(size)
        # The place a term stands at, for every position; the last `gap` places are free.
        self.at = np.full(int(self.positions.max(initial=0)) + 1 + gap, -1, np.int32)
        for i, word in enumerate(terms.split()):
            if (t := wanted.get(word)) is not None:
                self.first[t], self.length[t] = ends[i] - size[i], size[i]
                self.at[self.positions[ends[i] - size[i]:ends[i]]] = t

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term]:self.first[term] + self.length[term]]


class Phrases:
    """A block of windows as arrays, terms from rare to common."""

    def __init__(self, windows: list[tuple[str, tuple[bytes, ...]]], counts: dict[bytes, int]):
        self.items = [item for item, _ in windows]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in windows for w in words}))}
        self.size = np.array([len(words) for _, words in windows], np.int32)
        self.longest = int(self.size.max(initial=1))
        self.term = np.full((len(windows), self.longest), -1, np.int32)
        self.offset = np.zeros((len(windows), self.longest), np.int32)
        for k, (_, words) in enumerate(windows):
            order = sorted(range(len(words)), key=lambda i: (counts.get(words[i], 0), i))
            self.offset[k, :len(words)] = order
            self.term[k, :len(words)] = [self.vocabulary[words[i]] for i in order]

    def search(self, segment: Segment, run: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Window and start of every exact match."""
        n = segment.length[self.term[:, 0]]
        live = np.flatnonzero(n)
        found = []
        while len(live):
            take = max(1, int(np.searchsorted(np.cumsum(n[live]), run, "right")))
            part, live = live[:take], live[take:]
            window = np.repeat(part, n[part])
            nth = np.arange(len(window)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            start = segment.positions[segment.first[self.term[window, 0]] + nth] - self.offset[window, 0]
            window, start = window[start >= 0], start[start >= 0]
            for r in range(1, self.longest):
                used = r < self.size[window]
                same = ~used | (segment.at[start + self.offset[window, r]] == self.term[window, r])
                window, start = window[same], start[same]
                if not len(window):
                    break
            found.append((window, start))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))


MATCHES = "segment long, doc_no int, item string, first long, last long"


def _matches(index: DataFrame, phrases: Phrases) -> DataFrame:
    """Runs of matched words: segment, doc_no, item, first, last (exclusive)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                segment = Segment(row["terms"], row["lengths"], row["positions"], phrases.vocabulary, phrases.longest)
                window, start = phrases.search(segment)
                if not len(window):
                    continue
                base = np.cumsum([0] + [n + 1 for n in row["n_words"][:-1]])
                doc = np.searchsorted(base, start, "right") - 1
                items, item = np.unique(np.array(phrases.items, object)[window], return_inverse=True)
                end = start + phrases.size[window]
                order = np.lexsort((end, start, item, doc))
                doc, item, start, end = doc[order], item[order], start[order], end[order]
                # Windows of one item that touch in one document make one run.
                key = doc * len(items) + item
                new = np.ones(len(doc), bool)
                new[1:] = (key[1:] != key[:-1]) | (start[1:] > end[:-1])
                at = np.flatnonzero(new)
                last = np.maximum.reduceat(end, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * len(at), pa.int64()), pa.array(doc[at].astype(np.int32)),
                     pa.array(items[item[at]].tolist(), pa.string()), pa.array(start[at] - base[doc[at]]),
                     pa.array(last - base[doc[at]])], names=["segment", "doc_no", "item", "first", "last"])

    return index.select("segment", "n_words", "terms", "lengths", "positions").mapInArrow(search, MATCHES)


def phrase_matches(index: DataFrame, items: DataFrame, item_id: str, text: str, folder: str, size: int = WINDOW,
                   block: int = WINDOW_BLOCK) -> DataFrame:
    """Runs of words inside windows of the items; each block of windows is one pass over the index."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    windows = item_windows(((r["i"], r["t"]) for r in rows.toLocalIterator()), size)
    out, held = [], list(_take(windows, block))
    while held or not out:
        counts = term_counts(index, {w for _, words in held for w in words})
        out.append(stored(_matches(index, Phrases(held, counts)), f"{folder}/matches-{len(out)}"))
        held = list(_take(windows, block))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _take(source: Iterator, n: int) -> Iterator:
    for _, x in zip(range(n), source, strict=False):
        yield x


def proximity_matches(index: DataFrame, queries: list[tuple[str, list[str]]], within: int) -> DataFrame:
    """Shortest spans of at most `within` words that hold all terms of a query, in any order.

    One row for each span that holds no shorter one: segment, doc_no, item (the query's name), first,
    last (exclusive).  `queries` is a stated, bounded list.
    """
    asked = [(name, sorted({w for t in terms for w in words_of(t)})) for name, terms in queries]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in asked for w in words}))}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                segment = Segment(row["terms"], row["lengths"], row["positions"], vocabulary, 1)
                base = np.cumsum([0] + [n + 1 for n in row["n_words"][:-1]])
                out = []
                for name, words in asked:
                    lists = sorted((segment.postings(vocabulary[w]) for w in words), key=len)
                    if not lists or not len(lists[0]):
                        continue
                    # A span's end is the place where its last term came; its start follows from the
                    # nearest place of every term at or before that end.
                    ends = np.unique(np.concatenate(lists))
                    near = np.searchsorted(lists[0], ends - within, "right") < np.searchsorted(lists[0], ends, "right")
                    ends = ends[near]
                    start, ok = ends.copy(), np.ones(len(ends), bool)
                    for held in lists:
                        k = np.searchsorted(held, ends, "right") - 1
                        ok &= k >= 0
                        start = np.minimum(start, held[np.maximum(k, 0)])
                    doc = np.searchsorted(base, ends, "right") - 1
                    ok &= (ends - start < within) & (start >= base[doc])
                    start, ends, doc = start[ok], ends[ok], doc[ok]
                    tight = np.append(True, start[1:] != start[:-1])  # the earliest end of a start
                    out += [(row["segment"], int(d), name, int(s - base[d]), int(e + 1 - base[d]))
                            for d, s, e in zip(doc[tight], start[tight], ends[tight], strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                        names=["segment", "doc_no", "item", "first", "last"])

    return index.select("segment", "n_words", "terms", "lengths", "positions").mapInArrow(search, MATCHES)


def index_documents(index: DataFrame) -> DataFrame:
    """segment, doc_no, doc_id, n_words of each indexed row."""
    return index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc_no", "d")).select(
        "segment", "doc_no", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, folder: str, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    index = build_index(docs, folder)
    runs = phrase_matches(index, benchmark, "item_id", "text", folder, size)
    document = Window.partitionBy("segment", "doc_no").orderBy("first", "last")
    covered = F.coalesce(F.max("last").over(document.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("last") - F.greatest("first", covered))
    hit = runs.select("segment", "doc_no", "item", new.alias("new")).groupBy("segment", "doc_no").agg(
        F.sum("new").alias("n_hit"), F.collect_set("item").alias("items"))
    found = index_documents(index).join(hit, ["segment", "doc_no"], "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, folder: str, size: int = WINDOW) -> DataFrame:
    """The rows that are not contaminated, with all their columns, whatever their ids."""
    rows = numbered(docs, f"{folder}/rows")
    found = contamination(rows.select(F.col(ROW).alias("doc_id"), "text"), benchmark, folder, size)
    bad = found.filter("contaminated").select(F.col("doc_id").alias(ROW))
    return rows.join(bad, ROW, "left_anti").select(docs.columns)
