"""Language of texts by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of characters that are no letters becomes one blank, and all runs of
one to `longest` characters are hashed into `buckets` in numpy.  Training counts buckets by language in
each task and adds the counts up in Spark, so the driver gets `buckets` rows a language at most; the
matrix of log-probabilities (1 MB for four languages) goes to the tasks, which add up its rows for the
n-grams of whole texts.  Corpus counts cover all training rows.

Edge cases: a text that is null or has no letter is `und` with score 0, and so is every text if
nothing could be learned; null languages are not learned from; ties go to the first language in
alphabetical order; repeated rows count each; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_slices

BUCKETS = 1 << 15
LONGEST = 3
SMOOTH = 0.1
UNKNOWN = "und"


@dataclass
class Model:
    """Languages, their log shares of the training rows, and log-probabilities (language, bucket)."""

    languages: list[str]
    prior: np.ndarray
    log_prob: np.ndarray


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter; made once in a task."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def ngram_buckets(texts: list[str | None], buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text that each belongs to, and whether a text has a letter.

    The n-grams of a text follow one another for each length.
    """
    whole = " " + " \n ".join((t or "").lower().replace("\n", " ") for t in texts) + " "
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    border = codes == 10
    letter = _letters()[codes]
    keep = letter | border
    keep[1:] |= letter[:-1] | border[:-1]  # the first of a run of other characters
    keep[0] = True
    codes, letter, border = codes[keep], letter[keep], border[keep]
    text = np.cumsum(border)
    codes = np.where(letter, codes, 32).astype(np.uint32)
    known = np.bincount(text[letter], minlength=len(texts)) > 0
    found, owners = [], []
    mixed = np.zeros(len(codes), np.uint32)
    for n in range(1, longest + 1):
        mixed = (mixed[:len(codes) - n + 1] if n > 1 else mixed) * np.uint32(0x9E3779B1) + codes[n - 1:] + np.uint32(n)
        # Within one text, with a letter, and not over the border.
        inside = (text[:len(mixed)] == text[n - 1:]) & ~border[:len(mixed)]
        has = letter[:len(mixed)].copy()
        for k in range(1, n):
            has |= letter[k:len(letter) - n + 1 + k]
        inside &= has
        h = mixed[inside]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        found.append((h >> np.uint32(9)) % np.uint32(buckets))
        owners.append(text[:len(mixed)][inside])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), known


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """lang, bucket, n over all rows (text, lang); bucket -1 counts the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in small_slices(batches, "text", 1 << 20):
            bucket, owner, _ = ngram_buckets(batch.column("text").to_pylist(), buckets, longest)
            names, which = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            grid = np.bincount(which[owner] * buckets + bucket, minlength=len(names) * buckets).reshape(-1, buckets)
            for i, name in enumerate(names):
                held = total.setdefault(name, np.zeros(buckets + 1, np.int64))
                held[:-1] += grid[i]
                held[-1] += int((which == i).sum())
        for name, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(np.where(at == buckets, -1, at), pa.int32()), pa.array(held[at])],
                names=["lang", "bucket", "n"])

    part = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    return part.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(rows: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> Model:
    """Learns from all rows (text, lang) with both."""
    counted = bucket_counts(rows.filter("text IS NOT NULL AND lang IS NOT NULL"), buckets, longest).toPandas()
    languages = sorted(counted["lang"].unique())
    n = np.zeros((len(languages), buckets + 1))
    n[counted["lang"].map({x: i for i, x in enumerate(languages)}).astype(int), counted["bucket"]] = counted["n"]
    seen = n[:, :buckets] + SMOOTH
    return Model(languages, np.log(n[:, -1] / max(1.0, n[:, -1].sum())), np.log(seen / seen.sum(1, keepdims=True)))


def predict_texts(model: Model, texts: list[str | None], longest: int = LONGEST) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    bucket, owner, known = ngram_buckets(texts, model.log_prob.shape[1], longest)
    total = np.stack([np.bincount(owner, row[bucket], len(texts)) for row in model.log_prob]) + model.prior[:, None]
    best = total.argmax(0)
    share = 1 / np.exp(np.maximum(total - total.max(0), -700)).sum(0)
    names = [model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
    return names, np.where(known, share, 0.0)


def held_out_language(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def predict_languages(docs: DataFrame, model: Model, longest: int = LONGEST) -> DataFrame:
    """doc_id, lang_pred, score for each row."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", 1 << 20):
            names, share = predict_texts(model, batch.column("text").to_pylist(), longest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document; learns from the rows not held out."""
    model = fit_languages(docs.filter(~held_out_language(F.col("doc_id"))).select("text", "lang"))
    return predict_languages(docs, model).select(
        "doc_id", held_out_language(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
