"""Groups of spelling variants: words within one edit of each other, by an index of variable-length grams.

1. Words are counted over all texts.
2. A gram dictionary holds the grams of more than `SHORTEST` and at most `LONGEST` letters that are frequent among
   the words; rarer ones are pruned, so a frequent place in a word gets a long gram and a rare one a short gram.
3. A word is cut into grams: at each place the longest of the dictionary, or one of the shortest length, unless an
   earlier gram covers it.  Words are padded with one mark on each side.
4. For each word the most grams that one edit can affect is found from the dictionary.  A word near it shares all
   its other grams, shifted by one place at most.
5. So of the rarest grams, one more than can be affected, two near words share one.  Only these short lists are
   merged.  The edit lies wholly before or wholly after a gram that stays, so the list of a gram is cut by what stands
   on its other side: words meet on the gram with all that is before it, or with all that is after it, and on their
   lengths.  Each pair is verified.
6. A word with no gram that an edit leaves alone is not safe in this index.  Such words also get the grams of an
   empty dictionary, all of the shortest length, under which every word of six letters keeps some, and two unsafe
   words meet there.

The dictionary and the sizes of its lists are broadcast; both are bounded, as the least frequency of a gram grows with the
number of places.
Everything else is joins of tables that grow with the number of different words.

Edge cases: null and empty texts have no words; a null doc_id stands as an empty id in the damage; repeated rows
count each; words of equal count are taken in code-point order; words of any length are indexed whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Collection, Iterator, Sequence
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_slices, stored

WORD = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Least code points and occurrences of a word, and how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One of so many (document, word) loses a letter.
DAMAGED = 199
#: Lengths of grams.
SHORTEST, LONGEST = 2, 4
#: Least words with a gram of the dictionary; more where the dictionary would pass `GRAMS` entries of a length.
FREQUENT, GRAMS = 16, 1 << 16
#: Marks around a word; they are no letters.
BEFORE, AFTER = "^", "$"
#: Longer words are compared in Python.
LONG_WORD = 64
#: Different words that a task counts before it hands them on.
COUNTED = 1 << 18


def damaged_word(word: str, doc: int) -> str:
    """The word as it stands in a document; `doc` is the crc32 of the id and a colon."""
    h = zlib.crc32(word.encode(), doc)
    if h % DAMAGED:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word and n, its occurrences in all texts, for words of enough letters and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in small_slices(batches, "text", 1 << 22):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(WORD.findall((text or "").translate(LOWER))).items():
                    if len(word) >= LEAST_LENGTH and len(word := damaged_word(word, doc)) >= LEAST_LENGTH:
                        counts[word] += n
            if len(counts) >= COUNTED:
                yield counted(counts, "word")
        yield counted(counts, "word")

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT, grams: int = GRAMS) -> list[str]:
    """Grams of more than the shortest length that are frequent among the words.

    At most `grams` places of all can have a gram of one length and this frequency, so the list has at most
    `grams` times the number of lengths.
    """
    places = words.select(F.sum(F.length("word") + 2)).first()[0] or 0
    least = max(frequent, -(-places // grams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                padded = BEFORE + word + AFTER
                for k in range(SHORTEST + 1, LONGEST + 1):
                    counts.update(padded[a:a + k] for a in range(len(padded) - k + 1))
                if len(counts) >= COUNTED:
                    yield counted(counts)
        yield counted(counts)

    found = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return [r["gram"] for r in found.filter(F.col("n") >= least).select("gram").collect()]


def counted(counts: Counter[str], name: str = "gram") -> pa.RecordBatch:
    """The counts so far as a batch; counting starts anew."""
    batch = pa.RecordBatch.from_pydict({name: pa.array(counts, pa.string()), "n": pa.array(counts.values(), pa.int64())})
    counts.clear()
    return batch


class Grams:
    """Cuts padded words into grams of a dictionary and bounds what an edit affects."""

    def __init__(self, dictionary: Collection[str]):
        self.dictionary = set(dictionary)
        #: Parts that a longer gram of the dictionary begins or ends with.
        self.begins = {g[:k] for g in self.dictionary for k in range(1, len(g))}
        self.ends = {g[k:] for g in self.dictionary for k in range(1, len(g))}

    def of(self, word: str) -> list[tuple[int, int]]:
        """First and last place of each gram."""
        found, covered = [], -1
        for a in range(len(word) - SHORTEST + 1):
            n = next((k for k in range(min(LONGEST, len(word) - a), SHORTEST, -1) if word[a:a + k] in self.dictionary), SHORTEST)
            if a + n - 1 > covered:
                covered = a + n - 1
                found.append((a, covered))
        return found

    def affected(self, word: str, grams: Sequence[tuple[int, int]]) -> int:
        """The most of these grams that one edit of the word can change or cover.

        An edit takes the places `left` to `right` - 1 away, none for an insertion.  It changes the grams that hold such
        a place or both sides of an insertion.  A gram to the left can become covered only if a part that
        begins no later than the gram and ends before the edit begins a longer gram of the dictionary, and
        likewise to the right.
        """
        most = 0
        firsts, lasts = [a for a, _ in grams], [b for _, b in grams]
        for left in range(1, len(word)):  # the first and last place are marks and stay
            # The leftmost place from which a longer gram may reach over the edit.
            low = next((c for c in range(max(0, left - LONGEST + 1), left) if word[c:left] in self.begins), left)
            over = bisect_left(lasts, left)  # grams before this one end before the edit
            for right in (left, left + 1):
                if right == len(word):
                    continue
                high = next((d for d in range(min(len(word), right + LONGEST - 1), right, -1) if word[right:d] in self.ends), right) - 1
                after = bisect_left(firsts, right)  # grams from this one on begin after the edit
                most = max(most, max(0, over - bisect_left(firsts, low)) + after - over + max(0, bisect_right(lasts, high) - after))
        return most

    def both(self, word: str) -> tuple[str, list[tuple[int, int]], int]:
        padded = BEFORE + word + AFTER
        grams = self.of(padded)
        return padded, grams, self.affected(padded, grams)


def list_sizes(words: DataFrame, dictionary: list[str]) -> dict[str, int]:
    """Words that have each gram, by the dictionary and by the empty one together.

    As many entries as the dictionary has, and one for each pair of letters at most.
    """
    shared = words.sparkSession.sparkContext.broadcast(dictionary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        families = Grams(shared.value), Grams(())
        for batch in batches:
            for word in batch.column("word").to_pylist():
                padded = BEFORE + word + AFTER
                for cutter in families:
                    counts.update(padded[a:b + 1] for a, b in cutter.of(padded))
        yield counted(counts)

    found = words.select("word").mapInArrow(count, "gram string, n long")
    return {r["gram"]: r["n"] for r in found.groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def short_lists(words: DataFrame, dictionary: list[str], sizes: dict[str, int]) -> DataFrame:
    """word, n, length and part: the rarest grams of each word, one more than an edit can affect, with what is
    before or after them.  Unsafe words also have those by the empty dictionary.
    """
    shared = words.sparkSession.sparkContext.broadcast((dictionary, sizes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, sizes = shared.value
        families = Grams(dictionary), Grams(())
        for batch in batches:
            out = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                parts = set()
                for cutter in families:
                    padded, grams, affected = cutter.both(word)
                    ranked = sorted((sizes[padded[a:b + 1]], padded[a:b + 1], a, b) for a, b in grams)
                    for _, _, a, b in ranked[:affected + 1]:
                        parts |= {padded[:b + 1], padded[a:]}
                    if affected < len(grams):
                        break
                # No edit is before the first mark or after the last.
                parts.discard(padded)
                out += [(word, n, len(word), part) for part in parts]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = pa.string(), pa.int64(), pa.int32(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["word", "n", "length", "part"])

    return words.select("word", "n").mapInArrow(cut, "word string, n long, length int, part string")


def one_edit(a: str, b: str) -> bool:
    """Whether words, the first not longer, differ by exactly one inserted, deleted or replaced code point."""
    k = len(commonprefix((a, b)))
    return a != b and (a[k + 1:] == b[k + 1:] if len(a) == len(b) else len(a) + 1 == len(b) and a[k:] == b[k + 1:])


def near_pairs(kept: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each two words that differ by one code point, once; a is not longer."""
    left = kept.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "part", F.col("length").alias("a_length"),
                       F.explode(F.array("length", F.col("length") + 1)).alias("length"))
    right = kept.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "part", "length")
    met = left.join(right, ["part", "length"]).filter((F.col("a_length") < F.col("length")) | (F.col("a") < F.col("b")))
    columns = "a", "a_n", "b", "b_n"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = map(one_edit, batch.column("a").to_pylist(), batch.column("b").to_pylist())
            yield batch.filter(pa.array(near, pa.bool_()))

    # The built-in distance is fast on short words, and takes the square of the length.
    short = met.filter(F.col("length") <= LONG_WORD).filter(F.levenshtein("a", "b", 1) == 1).select(*columns)
    long = met.filter(F.col("length") > LONG_WORD).select(*columns).mapInArrow(verify, "a string, a_n long, b string, b_n long")
    return short.unionByName(long).distinct()


def nearest(pairs: DataFrame) -> DataFrame:
    """word, n_near, and of its near words the one of largest n, the smallest of equal ones: best, best_n."""
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("e")).select("e.*")
    return ends.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")).select(
        "word", "n_near", F.col("best.near").alias("best"), (-F.col("best.rank")).alias("best_n"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word and root, the last of its forms; each round doubles the steps, and each step takes `TIMES` the occurrences."""
    spark, step = forms.sparkSession, 0
    table = stored(forms.select("word", F.col("form").alias("root")), f"{folder}/roots-0")
    while True:
        further = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        stored(table.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                          F.col("next").isNotNull().alias("moved")), f"{folder}/roots-{step}")
        table = spark.read.parquet(f"{folder}/roots-{step}")
        if table.filter("moved").isEmpty():
            return table.select("word", "root")
        table = table.select("word", "root")


def variant_groups(words: DataFrame, folder: str, frequent: int = FREQUENT, grams: int = GRAMS) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of a table of words and their counts."""
    words = stored(words, f"{folder}/words")
    dictionary = gram_dictionary(words, frequent, grams)
    kept = short_lists(words, dictionary, list_sizes(words, dictionary))
    found = nearest(near_pairs(stored(kept, f"{folder}/lists")))
    often = F.col("best_n") >= TIMES * F.col("n")
    all_ = stored(words.join(found, "word", "left").select(
        "word", F.when(often, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(often, F.col("best_n")).alias("form_n")), f"{folder}/forms")
    return all_.join(roots(all_.filter("form IS NOT NULL"), folder), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, folder: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the texts."""
    return variant_groups(word_counts(docs), folder)
