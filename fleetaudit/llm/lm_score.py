"""Masked pseudo-likelihood of documents from bidirectional window networks in numpy.

Words are tokens.  A network sees `SIDE` tokens on both sides of a place, never the place itself, and
predicts its token: embeddings of the neighbours, one hidden layer, and a two-step softmax (class of
the token, token within its class) that costs 2 * sqrt(tokens) instead of all tokens.  A word
without a token of its own is predicted in two steps: one of `ENDINGS` tokens that such words share, and
then each of its bytes by a second network of the same kind, which sees `SIDE` bytes of the word on both
sides.  So every byte of a text counts.  The sum of all these log-probabilities is the score of a document.

Everything is gathered from the whole corpus and grows with it: words are counted over all documents
(combined in each task, added up by Spark), the most frequent get own tokens, the byte network learns every
other distinct word, and each document is trained on in one of `rounds` rounds.  In a round every
task trains a copy on its rows and returns it in rows; Spark averages the copies by the tokens they
saw, so the driver gets one network (about 0.8 MB).  A lost task trains its copy again.  Texts are cut into
tokens once, and the tokens stored in the shared folder (two bytes a word).

Edge cases: null, empty and blank texts have no tokens and score 0; a single word is predicted from
borders; texts of any length are read whole; an empty corpus leaves the first weights; repeated rows are
counted and scored each; rows without doc_id are like others; other columns are not read; a zero byte
is the same token as the border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_slices, stored

SIDE = 2
#: Token 0 is the border, then come frequent words, then the tokens that other words share.
CLASSES = 64
TOKENS = CLASSES * CLASSES
ENDINGS = 512
BATCH = 8192
#: Places worked on together, so that their arrays stay in the cache of a core.
BLOCK = 1024
ROUNDS = 2
PART = 2048
#: Different words of slices that a task holds before it adds their counts up.
HELD = 500_000

Weights = dict[str, np.ndarray]


def shapes(classes: int, embed: int, hidden: int) -> dict[str, tuple[int, ...]]:
    """Arrays of a network over `classes` ** 2 tokens."""
    return {"embed": (classes * classes, embed), "inner": (2 * SIDE * embed, hidden), "inner_bias": (hidden,),
            "classes": (hidden, classes), "class_bias": (classes,), "words": (classes, hidden, classes), "word_bias": (classes, classes)}


#: Least log-probability of a token.
LEAST = np.log(1e-30)
SHAPES = shapes(CLASSES, 16, 32)
BYTE_SHAPES = shapes(16, 8, 16)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as `split_words` makes them, one after the other, and their number in each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
    # White space at the ends of a text leaves empty words.
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        owner = np.repeat(np.arange(len(sizes)), sizes)
        words, sizes = words.filter(pa.array(~empty)), sizes - np.bincount(owner[empty], minlength=len(sizes))
    return words.cast(pa.binary()), sizes.astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in small_slices(batches, "text"):
            counted = words_of(batch.column("text"))[0].value_counts()
            held.append(pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["word", "n"]))
            rows += len(counted)
            if rows > HELD:
                yield from _added(held)
                held, rows = [], 0
        if held:
            yield from _added(held)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _added(counted: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """One row for each word of some counts."""
    table = pa.Table.from_batches(counted).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return table.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()


def frequent_words(counts: DataFrame) -> dict[bytes, int]:
    """Tokens of the most frequent words of `word_counts`; ties go by the word.

    The driver learns how many words there are for each power of two of their counts, and then
    only gets words above the power at which there are enough.
    """
    most = TOKENS - ENDINGS - 1
    least = 0
    for row in counts.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect():
        least, most = row["power"], most - row["count"]
        if most <= 0:
            break
    rows = counts.filter(F.col("n") >= 2**least).orderBy(F.desc("n"), "word").limit(TOKENS - ENDINGS - 1).collect()
    # Frequent words are dealt over the classes in turn.
    return {bytes(r["word"]): 1 + i for i, r in enumerate(rows)}


def _bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words in a row, and the length of each word."""
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


def shared_tokens(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens of words without an own one, by their last three bytes; words as `_bytes` gives them."""
    data = np.append(np.zeros(2, np.int64), data)
    ends = 1 + np.cumsum(sizes)
    tail = data[ends] + 257 * np.where(sizes > 1, data[ends - 1], 0) + 257 * 257 * np.where(sizes > 2, data[ends - 2], 0)
    return (TOKENS - ENDINGS + (tail * 40_503 >> 4) % ENDINGS).astype(np.uint16)


def first_weights(layout: dict[str, tuple[int, ...]] = SHAPES, seed: int = 11) -> Weights:
    rng = np.random.default_rng(seed)
    w = {k: np.zeros(s, np.float32) for k, s in layout.items()}
    w["embed"] = rng.normal(0, 0.3, layout["embed"]).astype(np.float32)
    w["inner"] = rng.normal(0, layout["inner"][0] ** -0.5, layout["inner"]).astype(np.float32)
    for k in ("classes", "words"):
        w[k] = rng.normal(0, 0.05, layout[k]).astype(np.float32)
    return w


def windows(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Neighbours (place, 2 * SIDE) of each place; `ids` are runs of `sizes` tokens with borders between."""
    places = SIDE + np.arange(len(ids)) + np.repeat(np.arange(len(sizes)) * SIDE, sizes)
    line = np.zeros(len(ids) + SIDE * (len(sizes) + 1), ids.dtype)
    line[places] = ids
    return np.stack([line[places + k] for k in range(-SIDE, SIDE + 1) if k], 1)


def spelling(w: Weights, words: list[bytes]) -> np.ndarray:
    """Log-probability of the bytes of each word given those beside them."""
    return _spelling(w, *_bytes(words))


def _spelling(w: Weights, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    # A byte's probability depends on the bytes beside it alone, so each such group is worked out once.
    near = windows(data, sizes)
    groups = data.astype(np.int64)
    for k in range(2 * SIDE):
        groups = groups << 8 | near[:, k]
    groups = pa.array(groups).dictionary_encode()
    each = groups.dictionary.to_numpy()
    beside = np.stack([each >> 8 * k & 255 for k in reversed(range(2 * SIDE))], 1)
    p = log_probs(w, beside, each >> 16 * SIDE)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), p[groups.indices.to_numpy()], len(sizes))


def _log_softmax(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One entry of each row's logarithmic softmax.  One largest value serves all rows unless that leaves too little of a row."""
    rows, ones = np.arange(len(x)), np.ones(x.shape[1], x.dtype)
    x -= x.max()
    total = np.exp(x) @ ones
    if total.min() < 1e-12:
        x -= x.max(1, keepdims=True)
        total = np.exp(x) @ ones
    return x[rows, at] - np.log(total)


def _softmax(x: np.ndarray) -> None:
    """By rows and in place; the largest value as in `_log_softmax`."""
    ones = np.ones(x.shape[1], x.dtype)
    y = x - x.max()
    total = np.exp(y, out=y) @ ones
    if total.min() < 1e-12:
        np.subtract(x, x.max(1, keepdims=True), out=y)
        total = np.exp(y, out=y) @ ones
    np.multiply(y, (1 / total)[:, None], out=x)


def _with_bias(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes, and of the tokens of each class, with the bias as their last row."""
    return np.append(w["classes"], w["class_bias"][None], 0), np.concatenate([w["words"], w["word_bias"][:, None]], 1)


def _hidden(w: Weights, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings beside each place, and its hidden layer with a column of ones for the bias of the next."""
    seen = w["embed"].take(near, axis=0).reshape(len(near), -1)
    x = seen @ w["inner"]
    x += w["inner_bias"]
    hidden = np.ones((len(x), x.shape[1] + 1), x.dtype)
    np.maximum(x, 0, out=hidden[:, :-1])
    return seen, hidden


def _blocks(group: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Blocks of places in order of their class, with the runs (class, start, end) of each."""
    order = np.argsort(group, kind="stable")
    for at in range(0, len(order), BLOCK):
        places = order[at:at + BLOCK]
        part = group[places]
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        yield places, [(int(part[i]), i, j) for i, j in zip(cuts, cuts[1:], strict=False)]


def _inside(words: np.ndarray, hidden: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Each row's values of the tokens of its class."""
    x = np.empty((len(hidden), words.shape[2]), hidden.dtype)
    for c, i, j in runs:
        np.matmul(hidden[i:j], words[c], out=x[i:j])
    return x


def log_probs(w: Weights, near: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Log-probability of each token given its neighbours."""
    of_class, of_words = _with_bias(w)
    classes = len(of_words)
    out = np.empty(len(token))
    for at in range(0, len(token), 1 << 17):
        for places, runs in _blocks((token[at:at + (1 << 17)] % classes).astype(np.uint8)):
            places = places + at
            own = token[places]
            _, hidden = _hidden(w, near.take(places, axis=0))
            p = _log_softmax(hidden @ of_class, own % classes)
            p += _log_softmax(_inside(of_words, hidden, runs), own // classes)
            out[places] = np.maximum(p, LEAST)
    return out


def gradients(w: Weights, near: np.ndarray, token: np.ndarray) -> Weights:
    """Gradients of the mean negative log-probability."""
    of_class, of_words = _with_bias(w)
    n, classes = len(token), len(of_words)
    g_class, g_words, g_inner = np.zeros_like(of_class), np.zeros_like(of_words), np.zeros_like(w["inner"])
    g_bias, embed = np.zeros_like(w["inner_bias"]), w["embed"].shape[1]
    # Embeddings by column, as sums by token take one at a time.
    d_seen, around, done = np.empty((embed, 2 * SIDE, n)), np.empty((2 * SIDE, n), np.int64), 0
    for places, runs in _blocks((token % classes).astype(np.uint8)):
        rows, own, beside = np.arange(len(places)), token[places], near.take(places, axis=0)
        seen, hidden = _hidden(w, beside)
        d_class = hidden @ of_class
        _softmax(d_class)
        d_class[rows, own % classes] -= 1
        d_word = _inside(of_words, hidden, runs)
        _softmax(d_word)
        d_word[rows, own // classes] -= 1
        d_hidden = d_class @ w["classes"].T
        for c, i, j in runs:
            g_words[c] += hidden[i:j].T @ d_word[i:j]
            d_hidden[i:j] += d_word[i:j] @ w["words"][c].T
        d_hidden *= hidden[:, :-1] > 0
        g_class += hidden.T @ d_class
        g_inner += seen.T @ d_hidden
        g_bias += hidden[:, -1] @ d_hidden
        d_seen[:, :, done:done + len(places)] = (w["inner"] @ d_hidden.T).reshape(2 * SIDE, embed, -1).transpose(1, 0, 2)
        around[:, done:done + len(places)] = beside.T
        done += len(places)
    around = around.ravel()
    g_embed = np.stack([np.bincount(around, d, len(w["embed"])) for d in d_seen.reshape(embed, -1)], 1)
    grads = {"embed": g_embed.astype(w["embed"].dtype), "inner": g_inner, "inner_bias": g_bias, "classes": g_class[:-1],
             "class_bias": g_class[-1], "words": g_words[:, :-1], "word_bias": g_words[:, -1]}
    return {k: g / n for k, g in grads.items()}


class Adam:
    def __init__(self, w: Weights, rate: float):
        self.w, self.rate, self.step = w, rate, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def update(self, grads: Weights) -> None:
        self.step += 1
        for k, g in grads.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            self.w[k] -= self.rate * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.99**self.step)) + 1e-8)


def train_round(rows: DataFrame, column: str, read: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], w: Weights, rate: float) -> Weights:
    """Trains a copy in each task on `column` and averages the copies by the tokens they saw.

    `read` makes the tokens of the rows, one after the other, and their number in each row.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adam, seen = Adam({k: v.copy() for k, v in w.items()}, rate), 0
        for batch in small_slices(batches, column, 1 << 20):
            token, sizes = read(batch.column(column))
            near = windows(token, sizes)
            for at in range(0, len(token), BATCH):
                adam.update(gradients(adam.w, near[at:at + BATCH], token[at:at + BATCH]))
            seen += len(token)
        if seen:
            flat = np.concatenate([v.ravel() for v in adam.w.values()])
            parts = [flat[i:i + PART] for i in range(0, len(flat), PART)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)),
                 pa.array(parts, pa.list_(pa.float32()))], names=["part", "seen", "weights"])

    return averaged(rows.select(column).mapInArrow(train, "part int, seen double, weights array<float>"), w)


def averaged(copies: DataFrame, w: Weights) -> Weights:
    """Mean of the copies (part, seen, weights) by the tokens they saw; `w` where there is none."""
    cells = copies.select("part", "seen", F.posexplode("weights").alias("place", "weight"))
    mean = cells.groupBy("part", "place").agg((F.sum(F.col("weight") * F.col("seen")) / F.sum("seen")).alias("mean")).toPandas()
    if mean.empty:
        return w
    flat = np.zeros(sum(v.size for v in w.values()), np.float32)
    flat[mean["part"].to_numpy() * PART + mean["place"].to_numpy()] = mean["mean"].to_numpy()
    ends = np.cumsum([v.size for v in w.values()])[:-1]
    return {k: part.reshape(v.shape) for (k, v), part in zip(w.items(), np.split(flat, ends), strict=True)}


def _stored_tokens(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = ids.to_pylist()
    return np.frombuffer(b"".join(rows), "<u2"), np.fromiter(map(len, rows), np.int64, len(rows)) // 2


def _word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return _bytes(words.to_pylist())


def fit_spelling(counts: DataFrame, tokens: dict[bytes, int], rate: float = 4e-3) -> Weights:
    """Byte network learned from each distinct word without a token of its own, once."""
    least = counts.sparkSession.createDataFrame([(bytearray(w),) for w in tokens], "word binary")
    return train_round(counts.join(F.broadcast(least), "word", "left_anti"), "word", _word_bytes, first_weights(BYTE_SHAPES), rate)


def tokenized(docs: DataFrame, tokens: dict[bytes, int], byte_weights: Weights) -> DataFrame:
    """doc_id, ids (two bytes a word), spelled (log-probability of the bytes of words without an own token)."""

    own = pa.array(list(tokens), pa.binary())
    numbers = np.fromiter(tokens.values(), np.uint16, len(tokens))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            words, sizes = words_of(batch.column("text"))
            place = pc.fill_null(pc.index_in(words, value_set=own), -1).to_numpy()
            ids = np.append(numbers, np.uint16(0))[place]
            other = np.flatnonzero(place < 0)
            spelled = np.zeros(len(sizes))
            if len(other):
                # What a word without an own token gives is worked out once a slice.
                found = words.take(pa.array(other)).dictionary_encode()
                which = found.indices.to_numpy()
                data, lengths = _bytes(found.dictionary.to_pylist())
                ids[other] = shared_tokens(data, lengths)[which]
                owner = np.repeat(np.arange(len(sizes)), sizes)[other]
                spelled = np.bincount(owner, _spelling(byte_weights, data, lengths)[which], len(sizes))
            cuts = np.append(0, np.cumsum(sizes)) * 2
            data = ids.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([data[i:j] for i, j in zip(cuts, cuts[1:])], pa.binary()), pa.array(spelled)],
                names=["doc_id", "ids", "spelled"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, ids binary, spelled double")


def fit_network(cut: DataFrame, rounds: int = ROUNDS, rate: float = 4e-3) -> Weights:
    """Weights learned from all rows of `tokenized`."""
    w = first_weights()
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    for k in range(rounds):
        w = train_round(cut.filter(turn == k), "ids", _stored_tokens, w, rate / (1 + k))
    return w


def score_documents(cut: DataFrame, w: Weights) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum) and mean_log_prob (a word) of each row of `tokenized`."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "ids", 1 << 20):
            token, sizes = _stored_tokens(batch.column("ids"))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            total = batch.column("spelled").to_numpy() + np.bincount(owner, log_probs(w, windows(token, sizes), token), len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(total), pa.array(total / np.maximum(sizes, 1))],
                names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return cut.mapInArrow(score, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")


def fit_tokens(docs: DataFrame, folder: str) -> tuple[dict[bytes, int], Weights]:
    """Own tokens of words and the byte network for the others, from all documents."""
    counts = stored(word_counts(docs), f"{folder}/words")
    tokens = frequent_words(counts)
    return tokens, fit_spelling(counts, tokens)


def pseudo_likelihood(docs: DataFrame, folder: str) -> DataFrame:
    """Scores of all documents by networks that all documents trained."""
    cut = stored(tokenized(docs, *fit_tokens(docs, folder)), f"{folder}/tokens")
    return score_documents(cut, fit_network(cut))
