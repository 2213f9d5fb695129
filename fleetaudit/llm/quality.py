"""Document quality from a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover all of it; a byte carries a mark where six
bytes repeat some that stand shortly before.  Learned filters slide over a chunk, are max-pooled
over it and mixed by a small layer; the chunks of a document meet as maximum
and mean in one logistic output.  The weights (about 60 KB) are fitted on the driver with Adam from a
bounded sample of labelled rows and then score every chunk of every text in Arrow batches.

The one bound of the fit is a parameter: `sample` labelled rows, those with the smallest hash of their doc_id, so
every label has the same chance.  The whole text of each is trained on, all chunks in blocks, as
scores also read all chunks of a text.

Edge cases: null and empty texts are one chunk of padding and get a score like any other; no label
or only one kind of label gives the share of label 1 (0.5 without labels) to every document; labels
that are null or neither 0 nor 1 are ignored; repeated rows are scored each, labels of one doc_id
that repeat count once each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_slices

CHUNK, STEP = 256, 192
WIDTH, STRIDE = 8, 4
EMBED, FILTERS, HIDDEN = 8, 32, 32
LAG = 40
SAMPLE, EPOCHS = 5_000, 6
#: Chunks that are worked on together.
BLOCK = 512
#: A small sample is gone through more often.
LEAST_STEPS = 400
KEEP_FROM = 0.3

Weights = dict[str, np.ndarray]


def _repeats(data: np.ndarray) -> np.ndarray:
    """Whether a byte ends six bytes that also stand up to LAG bytes before."""
    found = np.zeros(len(data), bool)
    for lag in range(2, min(LAG, len(data) - 5)):
        same = data[lag:] == data[:-lag]
        same = same[1:] & same[:-1]
        same = same[4:] & same[2:-2] & same[:-4]
        found[lag + 5:] |= same
    return found


def chunk_inputs(text: str | None) -> np.ndarray:
    """The inputs of a text, padded with zeros to whole chunks.

    An input is a byte, plus 256 where the text repeats itself.
    """
    data = np.frombuffer((text or "").encode(), np.uint8)
    data = data + np.uint16(256) * _repeats(data)
    n = max(1, -(-max(0, len(data) - CHUNK) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint16)
    padded[:len(data)] = data
    return padded


def as_chunks(inputs: np.ndarray) -> np.ndarray:
    """All chunks of padded inputs, one row each, without a copy."""
    return np.lib.stride_tricks.sliding_window_view(inputs, CHUNK)[::STEP]


def chunk_bytes(text: str | None) -> np.ndarray:
    """All chunks of a text, one row of inputs each."""
    return as_chunks(chunk_inputs(text))


def _windows(w: Weights, chunks: np.ndarray) -> np.ndarray:
    """The inputs under each filter position, embedded: chunk, position, WIDTH * EMBED."""
    flat = w["embed"][chunks].reshape(len(chunks), CHUNK * EMBED)
    return np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]


def _pooled(w: Weights, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each filter in each chunk, and its position."""
    values = np.ascontiguousarray(_windows(w, chunks)) @ w["filters"] + w["filter_bias"]
    where = values.argmax(1)
    return np.take_along_axis(values, where[:, None], 1)[:, 0], where


def _blocks(chunks: np.ndarray) -> range:
    return range(0, len(chunks), BLOCK)


def _mix(w: Weights, pooled: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hidden = np.maximum(np.maximum(pooled, 0) @ w["mix"] + w["mix_bias"], 0)
    counts = np.diff(np.append(starts, len(hidden)))[:, None]
    both = np.concatenate([np.maximum.reduceat(hidden, starts), np.add.reduceat(hidden, starts) / counts], axis=1)
    return 1 / (1 + np.exp(-np.clip(both @ w["out"] + w["out_bias"], -30, 30))), hidden, both


def score_chunks(w: Weights, chunks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each document; `starts` is each one's first chunk."""
    parts = [_pooled(w, chunks[at:at + BLOCK])[0] for at in _blocks(chunks)]
    return _mix(w, np.concatenate(parts), starts)[0]


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Weights:
    """Weights from documents (arrays of chunks) and labels 0 or 1."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape).astype(np.float32)
    w = {"embed": rng.normal(0, 0.5, (512, EMBED)).astype(np.float32), "filters": normal(WIDTH * EMBED, FILTERS),
         "filter_bias": np.zeros(FILTERS, np.float32), "mix": normal(FILTERS, HIDDEN),
         "mix_bias": np.zeros(HIDDEN, np.float32), "out": normal(2 * HIDDEN)[:, None][:, 0] * 0.1,
         "out_bias": np.zeros(1, np.float32)}
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        w["out"][:] = 0
        w["out_bias"][:] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return w
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step, rows = 0, 48
    epochs = max(epochs, -(-LEAST_STEPS // max(1, len(texts) // rows)))
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        for take in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // rows)):
            chunks = np.concatenate([texts[i] for i in take])
            starts = np.cumsum([0] + [len(texts[i]) for i in take[:-1]])
            grads = _gradients(w, chunks, starts, labels[take])
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.002 * (g * g - second[k])
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.998**step)) + 1e-8)
    return w


def _gradients(w: Weights, chunks: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> Weights:
    """Gradients over all chunks of some documents; memory is that of a block and a few numbers a chunk."""
    pooled, where = map(np.concatenate, zip(*[_pooled(w, chunks[at:at + BLOCK]) for at in _blocks(chunks)], strict=True))
    p, hidden, both = _mix(w, pooled, starts)
    n = np.diff(np.append(starts, len(chunks)))
    d = ((p - labels) / len(labels)).astype(np.float32)
    grads = {"out": both.T @ d, "out_bias": d.sum(keepdims=True)}
    of = np.repeat(np.arange(len(n)), n)
    d_both = d[:, None] * w["out"]
    d_hidden = (d_both[:, HIDDEN:] / n[:, None])[of] + d_both[of, :HIDDEN] * (hidden == both[of, :HIDDEN])
    d_hidden *= hidden > 0
    grads |= {"mix": np.maximum(pooled, 0).T @ d_hidden, "mix_bias": d_hidden.sum(0)}
    d_pooled = (d_hidden @ w["mix"].T) * (pooled > 0)
    grads |= {"filter_bias": d_pooled.sum(0), "filters": np.zeros_like(w["filters"]), "embed": np.zeros_like(w["embed"])}
    for at in _blocks(chunks):
        part, share = chunks[at:at + BLOCK], d_pooled[at:at + BLOCK]
        # The inputs that each filter saw where it was largest get its share of the gradient.
        place = where[at:at + BLOCK, :, None] * STRIDE + np.arange(WIDTH)
        seen = np.take_along_axis(part, place.reshape(len(part), -1), 1)
        at_best = w["embed"][seen].reshape(len(part), FILTERS, WIDTH * EMBED)
        grads["filters"] += np.einsum("cf,cfk->kf", share, at_best)
        d_seen = (share[:, :, None] * w["filters"].T).reshape(-1, EMBED)
        grads["embed"] += np.stack([np.bincount(seen.ravel(), d_seen[:, e], 512) for e in range(EMBED)], 1).astype(np.float32)
    return grads


def held_out_quality(doc_id) -> F.Column:
    """Rows that labels are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """label and inputs (16 bits each) of the whole texts of the sampled labelled rows."""
    chosen = labels.filter(F.col("quality").isin(0, 1)).filter(~held_out_quality(F.col("doc_id"))).select(
        "doc_id", F.col("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", 1 << 20):
            found = [chunk_inputs(text).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], names=["label", "inputs"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    return rows.mapInArrow(cut, "label int, inputs binary")


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from the labels; the driver gets the whole texts of `sample` labelled rows, two bytes a byte."""
    rows = training_rows(docs, labels, sample).collect()
    rows.sort(key=lambda r: (r["label"], r["inputs"]))  # the order of tasks must not matter
    texts = [as_chunks(np.frombuffer(r["inputs"], np.uint16)) for r in rows]
    return fit(texts, np.array([r["label"] for r in rows], np.float32))


def quality_scores(docs: DataFrame, weights: Weights) -> DataFrame:
    """One row for each document: doc_id, score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", 1 << 20):
            texts = [chunk_bytes(t) for t in batch.column("text").to_pylist()]
            starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
            p = score_chunks(weights, np.concatenate(texts), starts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.astype(float))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")


def drop_low_quality(docs: DataFrame, weights: Weights) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; no row moves."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", 1 << 20):
            texts = [chunk_bytes(t) for t in batch.column("text").to_pylist()]
            starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
            yield batch.filter(pa.array(score_chunks(weights, np.concatenate(texts), starts) >= KEEP_FROM))

    return docs.mapInArrow(keep, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    scored = quality_scores(docs, fit_quality(docs, labels, sample))
    return scored.select("doc_id", held_out_quality(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
