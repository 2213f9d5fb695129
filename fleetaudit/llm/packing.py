"""Best-fit packing of token pieces into sequences by linear grouping.

Documents become token ids with an end id; longer ones are cut into pieces of the sequence
length.  The pieces, a few numbers each, are stored and dealt at random into blocks of bounded
size.  Each block is packed on its own, so no task ever holds more than one block, and the cost
of a block border is one sequence that may stay half full:

1. pieces over a quarter of a sequence are large; sorted by length they form groups of equal
   cardinality, and every length is rounded up to the largest of its group;
2. a linear programme over configurations (multisets of the few rounded lengths that fit into a
   sequence) is optimised by column generation; pricing is a knapsack over the rounded lengths;
3. whole multiples of the configurations are taken and actual pieces replace rounded ones;
4. pieces that rounding down left over and all small ones go, longest first, where they fit best.

Edge cases: null and empty text give one piece with the end id alone; a document of any length
is cut, never shortened; equal lengths and repeated rows are packed each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_slices, stored

SEQUENCE = 2048
#: Pieces a packing task holds on average.
BLOCK = 50_000
#: Groups of large pieces in a block.
GROUPS = 128

#: ASCII punctuation at the end of a word.
TAIL = re.compile(r"[!-/:-@\[-`{-~]+$")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder(dict):
    """Token ids of texts as little-endian 32-bit bytes, word by word with a bounded memory.

    The tokenizer drops white space before it looks for words and lower-cases, so the ids of a
    text are those of its words in order.  Plain words go straight to the tokenizer's model;
    everything unusual, and any text that may hold a special token, takes the whole tokenizer.
    """

    def __init__(self, path: str, words: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), words
        self.model = self.tokenizer.model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __call__(self, text: str) -> bytes:
        if "<|" in text or re.search("[\x1c-\x1f]", text):
            return self._whole(text)
        if len(self) > self.words:
            self.clear()
        return b"".join(map(self.__getitem__, text.encode().lower().decode().split()))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and (plain := self._plain(word)):
            ids = np.array([t.id for t in self.model.tokenize(plain)], "<u4").tobytes()
        elif (tail := TAIL.search(word)) and word[:tail.start()].isalpha():
            ids = self[word[:tail.start()]] + self[tail[0]]
        else:
            ids = self._whole(word)
        self[word] = ids
        return ids

    def _plain(self, word: str) -> str | None:
        """The word as the tokenizer's model wants it, for Latin letters in composed form."""
        if word.isascii():
            return word.lower()
        low = word.lower()
        if max(word) >= "ɐ" or not low.isalpha() or not unicodedata.is_normalized("NFC", word):
            return None
        return "".join(map(self.letters.__getitem__, low.encode()))


def token_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """One row for each piece; `tokenizer` is the path of a vocabulary file on every machine."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordEncoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in small_slices(batches, "text"):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * sequence)):
                    part = ids[at:at + 4 * sequence]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def _configurations(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often the linear programme uses each.

    Minimises the number of sequences that hold `counts` pieces of each of `sizes`.  The sizes
    rise and exceed a quarter of the room, so a configuration has three pieces at most.
    """
    m = len(sizes)
    pairs = sizes[:, None] + sizes[None, :]
    pair_fits = pairs <= room
    third_from = np.where(pair_fits, np.searchsorted(sizes, room - pairs, "right"), 0)  # sizes that fit besides
    inverse = np.diag(1.0 / (room // sizes))
    basis = np.diag((room // sizes).astype(float))
    for turn in range(20 * m):
        worth = inverse.sum(0)
        most = np.maximum.accumulate(np.append(0.0, worth))
        total = np.where(pair_fits, worth[:, None] + worth[None, :] + most[third_from], worth[:, None])
        i, j = divmod(int(total.argmax()), m)
        if total[i, j] <= 1 + 1e-7:
            break
        column = np.zeros(m)
        column[i] += 1
        if pair_fits[i, j]:
            column[j] += 1
            if most[third_from[i, j]] > 0:
                column[int(worth[:third_from[i, j]].argmax())] += 1
        step = inverse @ column
        use = inverse @ counts
        leaves = int(np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf).argmin())
        basis[:, leaves] = column
        if turn % 50 == 49:
            inverse = np.linalg.inv(basis)
            continue
        row = inverse[leaves] / step[leaves]
        inverse = inverse - np.outer(step, row)
        inverse[leaves] = row
    return basis, np.maximum(np.linalg.solve(basis, counts), 0)


def pack(lengths: np.ndarray, room: int = SEQUENCE, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length; lengths are 1 to `room`."""
    lengths = np.asarray(lengths, np.int64)
    sequence, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    full = order[ordered == room]
    sequence[full] = np.arange(len(full))
    used = [room] * len(full)
    large = order[(ordered < room) & (ordered > room // 4)]
    if len(large):
        each = -(-len(large) // min(groups, len(large)))
        starts = np.arange(0, len(large), each)
        sizes, counts = lengths[large[starts]], np.diff(np.append(starts, len(large)))
        sizes, same = np.unique(sizes, return_inverse=True)
        bins = [list(large[np.isin(np.arange(len(large)) // each, np.flatnonzero(same == g))]) for g in range(len(sizes))]
        columns, use = _configurations(sizes, np.bincount(same, counts), room)
        for c in np.argsort(-use):
            slots = np.repeat(np.arange(len(sizes)), columns[:, c].astype(int))
            for _ in range(int(use[c] + 1e-6)):
                if any(len(bins[g]) < n for g, n in enumerate(columns[:, c]) if n):
                    break
                at = 0
                for g in slots:
                    piece = bins[g].pop()
                    sequence[piece], offset[piece] = len(used), at
                    at += int(lengths[piece])
                used.append(at)
    # Longest first, each where it leaves least room; a bit set names the rooms that exist.
    rooms: list[list[int]] = [[] for _ in range(room + 1)]
    there = 0
    for s, n in enumerate(used):
        if n < room:
            rooms[room - n].append(s)
            there |= 1 << (room - n)
    for piece in order[sequence[order] < 0].tolist():
        n = int(lengths[piece])
        wide = there >> n
        if wide:
            left = n + (wide & -wide).bit_length() - 1
            s = rooms[left].pop()
            if not rooms[left]:
                there ^= 1 << left
        else:
            left, s = room, len(used)
            used.append(0)
        sequence[piece], offset[piece] = s, used[s]
        used[s] += n
        if left > n:
            rooms[left - n].append(s)
            there |= 1 << (left - n)
    return sequence, offset


def pack_documents(docs: DataFrame, folder: str, tokenizer: str, sequence: int = SEQUENCE, end_id: int = 0,
                   block: int = BLOCK) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A sequence_id is the block number times 2^32 plus a number within the block.
    """
    pieces = stored(token_pieces(docs, tokenizer, sequence, end_id), f"{folder}/pieces")
    blocks = max(1, -(-pieces.count() // block))
    # A row's place in the stored files decides its block, so equal rows spread as well.
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        number, offset = pack(frame["length"].to_numpy(), sequence)
        return frame.drop(columns="block").assign(sequence_id=(int(key[0]) << 32) + number, offset=offset)

    return dealt.groupBy("block").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")
