"""Near-duplicate groups by SimHash with a Gray-ordered hierarchical index.

A fingerprint has 64 bits; a bit is set if over half of the XXH64 values of the shingles have it.
Fingerprints that differ in `distance` bits or fewer are linked, groups are what links connect.

1. Fingerprints are made in numpy and stored with the ids; equal ones are grouped first.
2. The top of the index factors the 64 bits into `distance + 1` bit patterns.  Two linked
   fingerprints agree in one of them, so each goes to one shard for each pattern and no pair is
   lost.  A shard far above the mean is split into parts, and every two parts meet in one group.
3. In a shard, fingerprints are sorted by Gray rank.  Runs of neighbours form nodes with the mask of
   bits that all share and their pattern; nodes of nodes go up to a root.  Pairs of nodes are pruned
   as a whole once the differences of their shared bits exceed the distance, and are linked as a
   whole once no difference beyond it is left.
4. A shard returns each fingerprint's group in it, one row for each linked fingerprint, never pairs.
   Stars of the smallest neighbour, stored after each round, join the groups of all shards.

Edge cases: null, empty and blank texts have fingerprint zero, which links like any other; fewer
words than a shingle make one; rows without doc_id take part but never name a group (a group of
such rows alone has none); repeated rows are returned as often; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, numbered, small_slices, stored

DISTANCE = 4
SHINGLE = 4
#: Children of a node of the hierarchy.
FAN = 16
#: Pairs of nodes looked at together; bounds the memory of a search.
FRONTIER = 1 << 12
#: A shard is split beyond this many fingerprints and twice the mean shard.
SPLIT_FROM = 1024


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every run of words, repeats included."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.append(0, ends[:-1]).tolist()
    ends = (ends - 1).tolist()
    last = ends[min(words, len(ends)) - 1:]
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, last, strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp for each row; also its number if given."""
    row = [ROW] if ROW in docs.columns else []

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            fp = [fingerprint(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fp, pa.int64()), *(batch.column(r) for r in row)], names=["doc_id", "fp", *row])

    return docs.select(F.col("doc_id").cast("long"), "text", *row).mapInArrow(
        make, ", ".join(["doc_id long", "fp long", *(f"{r} long" for r in row)]))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the Gray code."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Groups:
    """Connected groups of 0..n-1, joined by arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def near_groups(fp: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For different fingerprints in Gray order, the first index of each one's group."""
    groups = Groups(len(fp))
    # Level 0 holds the fingerprints; a node covers FAN nodes of the level below.
    masks, patterns = [np.full(len(fp), np.uint64(2**64 - 1))], [fp]
    while len(patterns[-1]) > 1:
        at = np.arange(0, len(patterns[-1]), FAN)
        ones = np.bitwise_and.reduceat(patterns[-1] & masks[-1], at)
        zeros = np.bitwise_and.reduceat(~patterns[-1] & masks[-1], at)
        masks.append(ones | zeros)
        patterns.append(ones)
    top = len(patterns) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        shared = masks[level][a] & masks[level][b]
        differ = np.bitwise_count((patterns[level][a] ^ patterns[level][b]) & shared)
        a, b, shared, differ = (x[differ <= distance] for x in (a, b, shared, differ))
        if not len(a):
            continue
        step = FAN**level
        if level == 0:
            groups.link(a, b)
            continue
        whole = differ + np.bitwise_count(~shared) <= distance
        for first, second in zip(a[whole].tolist(), b[whole].tolist(), strict=True):
            members = np.append(np.arange(first * step, min((first + 1) * step, len(fp))),
                                np.arange(second * step, min((second + 1) * step, len(fp))))
            groups.link(members, np.full(len(members), members[0]))
        a, b = a[~whole], b[~whole]
        below = len(patterns[level - 1])
        left = np.repeat((a[:, None] * FAN + np.arange(FAN)), FAN, axis=1).ravel()
        right = np.tile((b[:, None] * FAN + np.arange(FAN)), (1, FAN)).ravel()
        there = (left < below) & (right < below) & (left < right if level == 1 else left <= right)
        if len(a):
            stack.append((level - 1, left[there], right[there]))
    return groups.root


def _links_of_shards(distance: int):
    """Maps sorted shard rows to links (a, b); a shard may span Arrow batches."""
    keys = ["block", "value", "part_a", "part_b"]

    def links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = np.unique(fp).view(np.uint64)
        fp = fp[np.argsort(gray_rank(fp))]
        root = near_groups(fp, distance)
        linked = root != np.arange(len(fp))
        return fp[linked].view(np.int64), fp[root[linked]].view(np.int64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key = None
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            shard = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            fp = batch.column("fp").to_numpy()
            cuts = np.append(np.flatnonzero((shard[1:] != shard[:-1]).any(1)) + 1, len(fp)) if len(fp) else []
            start = 0
            for end in cuts:
                key = tuple(shard[start])
                if key != held_key:
                    if sum(map(len, held)) > 1:
                        out.append(links(np.concatenate(held)))
                    held, held_key = [], key
                held.append(fp[start:end])
                start = end
            if out:
                yield _as_batch(out)
        if sum(map(len, held)) > 1:
            yield _as_batch([links(np.concatenate(held))])

    return make


def _as_batch(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])


def shard_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between different fingerprints `fp` that connect all within the distance."""
    width = -(-64 // (distance + 1))
    blocks = [F.struct(F.lit(k).alias("block"),
                       F.shiftrightunsigned("fp", k * width).bitwiseAND((1 << min(width, 64 - k * width)) - 1).alias("value"))
              for k in range(distance + 1)]
    rows = prints.select("fp", F.explode(F.array(*blocks)).alias("s")).select("s.block", "s.value", "fp")
    # Bounded by (distance + 1) * 2^width rows, 40,960 as a rule, so it may be broadcast.
    sizes = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
    most = max(SPLIT_FROM, 2 * prints.count() / 2**width)
    parts = sizes.filter("n > 1").select("block", "value", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    routed = rows.join(F.broadcast(parts), ["block", "value"]).withColumn("part", part).select(
        "block", "value", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    keyed = routed.select(
        "block", "value", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "fp")
    keys = ["block", "value", "part_a", "part_b"]
    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links_of_shards(distance), "a long, b long")


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node above its neighbours is tied to the smallest, then small stars."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a != b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def connected(edges: DataFrame, folder: str) -> DataFrame:
    """a, b for each node a of a group but the smallest one, b; rounds are stored in `folder`."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges, turn, before = stored(edges, f"{folder}/links-0"), 0, None
    while True:
        turn += 1
        edges = stored(_stars(edges), f"{folder}/links-{turn}")
        # bit_xor and a count tell whether a round changed the links.
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges
        before = now


def near_members(docs: DataFrame, folder: str, distance: int = DISTANCE, words: int = SHINGLE) -> DataFrame:
    """One row for each document: doc_id, fp, root (names its group), component_id; also its number if given."""
    marked = stored(fingerprints(docs, words), f"{folder}/fingerprints")
    prints = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), f"{folder}/prints")
    group = connected(shard_links(prints.select("fp"), distance), folder)
    tied = prints.join(group, prints["fp"] == group["a"], "left").select(
        "fp", "first_id", F.coalesce("b", "fp").alias("root"))
    first = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(tied.join(first, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, folder: str, distance: int = DISTANCE, words: int = SHINGLE) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id."""
    return near_members(docs.select("doc_id", "text"), folder, distance, words).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, folder: str, distance: int = DISTANCE, words: int = SHINGLE) -> DataFrame:
    """One row of each group, with all its columns; of rows with the smallest id, the first."""
    rows = numbered(docs, f"{folder}/rows")
    found = near_members(rows, folder, distance, words).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = found.groupBy("root").agg(F.min(ROW).alias(ROW))
    return rows.join(keep, ROW, "left_semi").select(docs.columns)
