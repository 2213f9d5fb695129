"""Byte-level BPE by merge replay over the distinct words of many texts.

Texts are cut into words by the tokenizer's pattern.  Merges never cross a word, so a word has the same ids
wherever it stands, and the merges are replayed over distinct words instead of texts:

1. the bytes of all new words of a block lie in one row of positions, linked within each word;
2. an inverted index leads from the rank of a token pair to the positions where such a pair begins;
3. ranks are taken in rising order; at each position of a rank, left to right, the pair becomes one token and
   only its two neighbours are looked up again.  Pairs that a merge has made and that rank no later than
   the present one are merged before the next position, as this vocabulary has tokens that rank before their parts.

Each task replays the words of a block of its documents that it has not met yet; what it remembers is bounded.
Texts are never shuffled, so the operator costs one scan.

Edge cases: null and empty texts have no ids; a text of any length is encoded whole, memory grows with the block
and with the longest single word; repeated rows are encoded each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_slices

#: Bytes of text whose new words are replayed together.
BLOCK = 4 << 20
#: Bytes of distinct words that a task remembers before it starts anew.
REMEMBERED = 8 << 20
#: Texts of more characters are cut into words one by one.
LONG = 1 << 20
#: Rank of a pair that is no token.
NONE = 1 << 30


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order; ranks are 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        rows = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    rows.sort()
    if [rank for rank, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks must be 0 to n - 1")
    return [token for _, token in rows]


def newer_letters(pattern: str) -> str:
    """Characters that `regex` takes for letters or numbers and tiktoken, with older Unicode tables, does not.

    Only code points unknown to Python's own, older tables can differ.  A probe with a token for the end of the
    character and "!" tells: the two are one word only where the character is neither letter nor number.
    """
    tokens = [bytes([b]) for b in range(256)] + [bytes([b, 0x21]) for b in range(0x80, 0xC0)]
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    known = regex.compile(r"[\p{L}\p{N}]")
    return "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)])
                   if unicodedata.category(c) == "Cn" and known.match(c) and probe.encode_ordinary(c + "!")[-1] >= 256)


class Splitter:
    """Words of a text by the pattern, as tiktoken's regular expressions see it."""

    def __init__(self, pattern: str):
        self.newer = newer_letters(pattern)
        self.plain = regex.compile(pattern)
        self.first, without = min(self.newer, default=chr(0x10FFFF)), f"--[{self.newer}]]"
        self.other = regex.compile(f"[{self.newer}]") if self.newer else None
        self.exact = regex.compile(
            "(?V1)" + pattern.replace(r"\p{L}", r"[\p{L}" + without).replace(r"\p{N}", r"[\p{N}" + without)) if self.newer else self.plain

    def of(self, text: str) -> regex.Pattern:
        """The pattern that cuts this text right."""
        return self.exact if max(text, default="") >= self.first and self.other.search(text) else self.plain


class Merges:
    """Rank of each token and of each pair of tokens that makes one."""

    def __init__(self, tokens: Sequence[bytes]):
        self.tokens, self.size = tokens, len(tokens)
        self.rank = {token: rank for rank, token in enumerate(tokens)}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {}
        for token, rank in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a * self.size + b] = rank
        # Rank of each pair of bytes.
        self.first = np.full((256, 256), NONE, np.int64)
        for token, rank in self.rank.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank

    def replay(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has.  Words are not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        last = np.cumsum(lengths) - 1
        begin = last - lengths + 1
        places = np.arange(len(data))
        token = self.single[data].tolist()
        follow, before = places + 1, places - 1
        follow[last], before[begin] = -1, -1
        start = np.full(len(data), NONE, np.int64)
        start[:-1] = self.first[data[:-1], data[1:]]
        start[last] = NONE
        # A word that is a token keeps its rank even if no merges lead to it.
        whole = [self.rank.get(w, -1) for w in words]
        ready = np.array(whole, np.int64) >= 0
        start[np.repeat(ready, lengths)] = NONE

        index: dict[int, list[int]] = {}
        found = np.flatnonzero(start < NONE)
        found = found[np.argsort(start[found], kind="stable")]
        for part in np.split(found, np.flatnonzero(np.diff(start[found])) + 1):
            if len(part):
                index[int(start[part[0]])] = part.tolist()
        token = self._merge(index, token, follow.tolist(), before.tolist(), start.tolist())

        ids = np.array(token, np.int64)
        ids[np.repeat(ready, lengths)] = -1
        ids[begin[ready]] = np.array(whole, np.int64)[ready]
        left = ids >= 0
        counts = np.add.reduceat(left, begin) if len(words) else lengths
        return ids[left].astype(np.uint32), counts

    def _merge(self, index: dict[int, list[int]], token: list[int], follow: list[int], before: list[int],
               start: list[int]) -> list[int]:
        """Applies all merges; positions that went into a token on their left get the id -1."""
        pairs, size = self.pairs.get, self.size
        for rank in range(size):
            positions = index.pop(rank, None)
            if positions is None:
                continue
            positions.sort()
            for p in positions:
                if start[p] != rank:
                    continue
                made = rank
                while True:
                    q = follow[p]
                    n, o = follow[q], before[p]
                    token[p], token[q], follow[p], start[q] = made, -1, n, NONE
                    right = left = NONE
                    if n >= 0:
                        before[n] = p
                        right = pairs(made * size + token[n], NONE)
                    if o >= 0:
                        left = pairs(token[o] * size + made, NONE)
                    if left <= rank and left <= right:
                        p, made = o, left
                    elif right <= rank:
                        made = right
                    else:
                        break
                start[p] = right
                if right < NONE:
                    index.setdefault(right, []).append(p)
                if o >= 0:
                    start[o] = left
                    if left < NONE:
                        index.setdefault(left, []).append(o)
        return token


class Numbers(dict):
    """Number of each word in the order of first sight; `new` holds those not replayed yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes blocks of texts; remembers the ids of words between blocks."""

    def __init__(self, merges: Merges, splitter: Splitter, remembered: int = REMEMBERED):
        self.merges, self.splitter, self.remembered = merges, splitter, remembered
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.bytes = Numbers(), 0
        self.ids, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _words(self, text: str) -> np.ndarray:
        number, pattern = self.numbers.__getitem__, self.splitter.of(text)
        if len(text) <= LONG:
            return np.array(list(map(number, pattern.findall(text))), np.int64)
        return np.fromiter((number(m[0]) for m in pattern.finditer(text)), np.int64)

    def __call__(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.bytes > self.remembered:
            self._forget()
        rows = [self._words(text or "") for text in texts]
        words = [w.encode() for w in self.numbers.new]
        self.numbers.new.clear()
        self.bytes += sum(map(len, words))
        ids, counts = self.merges.replay(words)
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        ends = np.cumsum(self.counts)
        begins = ends - self.counts
        return [self._of(row, begins) for row in rows]

    def _of(self, row: np.ndarray, begins: np.ndarray) -> np.ndarray:
        counts = self.counts[row]
        total = np.cumsum(counts)
        if not len(row):
            return np.zeros(0, np.uint32)
        return self.ids[np.arange(total[-1]) + np.repeat(begins[row] - total + counts, counts)]


def encode_documents(docs: DataFrame, tokens: Sequence[bytes], pattern: str, block: int = BLOCK) -> DataFrame:
    """doc_id and ids, little-endian unsigned 32-bit numbers, of each text."""

    splitter = Splitter(pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(tokens), splitter)
        for batch in small_slices(batches, "text", block):
            ids = [row.astype("<u4").tobytes() for row in encoder(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary")


def decode_ids(ids: bytes, tokens: Sequence[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode_documents(encoded: DataFrame, tokens: Sequence[bytes]) -> DataFrame:
    """doc_id, ids and the decoded bytes of each row of ids; null ids decode to nothing."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "ids", BLOCK):
            data = [decode_ids(ids or b"", tokens) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(data, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, tokens: Sequence[bytes], pattern: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, in one pass."""

    splitter = Splitter(pattern)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(tokens), splitter)
        for batch in small_slices(batches, "text", block):
            sizes, hashes, decoded = [], [], []
            for row in encoder(batch.column("text").to_pylist()):
                ids = row.astype("<u4").tobytes()
                sizes.append(len(row))
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(ids, tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        code, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
