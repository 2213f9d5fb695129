"""License scan by an exact set-similarity join of text blocks and license templates.

Blocks are the lines of a text, sets of words; for notices also the runs of words, as long as a template,
of a paragraph (lines up to a blank one), as notices are wrapped.  A template is contained in a block if the block has at
least `threshold` of its words.  Words of templates are put in one global order, rare to common, by
their counts over all documents.  A block with enough of a template has one of the template's first
words in that order (prefix), as many template words as needed (length), and enough words left on
both sides of the first common one (position); what passes is counted exactly, so no block is missed.
The templates, a fixed short list, are the small side and go to every task; the documents do not move.

A notice needs the words that tell its license from neighbours (`REQUIRED`) and none of a narrower
license (`REFUSED`), so two notices in one paragraph are both found.

Besides, places where the words of a base phrase stand one after another are counted.

Edge cases: null and empty texts have no words and no place; blocks of any length are sets; a block may
contain several templates; ties in the order go by the word; repeated rows are scanned each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_slices

THRESHOLD = 0.8
#: Phrases and labels of the base scan.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices and opening sentences of common licenses, as their publishers word them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words without which a notice is that of a neighbour, or of nobody.
REQUIRED = {"mit": "mit", "apache": "apache", "gpl": "gnu general", "lgpl": "lesser", "agpl": "affero", "mpl": "mozilla",
            "cc-by-nc": "cc nc", "cc-by-sa": "cc sa", "cc-by": "creative commons attribution", "unlicense": "unencumbered"}
#: Words that make a notice that of a narrower license.
REFUSED = {"gpl": "lesser affero", "cc-by": "noncommercial sharealike noderivatives noderivs nc sa nd"}
_LOWER_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return (text or "").encode().translate(_LOWER_WORDS).split()


def word_counts(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """Counts of some words over all documents; one row a word and task is added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(words, 0)
        for batch in small_slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                for w in words_of(text):
                    if w in total:
                        total[w] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}


@dataclass
class Template:
    label: str
    words: list[int]  # ranks in the global order, ascending
    need: int


class TemplateIndex:
    """Templates by the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float = THRESHOLD):
        sets = [(label, set(words_of(text))) for label, text in templates]
        self.rank = {w: i for i, w in enumerate(sorted({w for _, s in sets for w in s}, key=lambda w: (counts.get(w, 0), w)))}
        self.templates = [
            Template(label, sorted(self.rank[w] for w in s), math.ceil(threshold * len(s) - 1e-9)) for label, s in sets if s]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            for place, r in enumerate(t.words[:len(t.words) - t.need + 1]):
                self.prefix.setdefault(r, []).append((k, place))
        names = list(self.rank)
        self.first_words = frozenset(names[r] for r in self.prefix)

    def matches(self, block: list[bytes]) -> list[tuple[str, float]]:
        """Labels that a block contains, with their containment."""
        return [(self.templates[k].label, n / len(self.templates[k].words)) for k, n in self.contained(block).items()]

    def contained(self, block: list[bytes]) -> dict[int, int]:
        """Templates that a block contains, with the number of their words in it."""
        held = sorted({self.rank[w] for w in block if w in self.rank})
        best: dict[int, int] = {}
        for at, r in enumerate(held):
            for k, place in self.prefix.get(r, ()):
                t = self.templates[k]
                if k in best or len(held) < t.need or min(len(t.words) - place, len(held) - at) < t.need:
                    continue
                best[k] = len(set(held).intersection(t.words))
        return {k: n for k, n in best.items() if n >= self.templates[k].need}


class NoticeIndex(TemplateIndex):
    """Templates within the lines and runs of paragraphs; the words that tell a license from its neighbours decide."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float = THRESHOLD):
        super().__init__(templates, counts, threshold)
        spelled = [(label, words_of(text)) for label, text in templates if words_of(text)]
        self.length = [len(words) for _, words in spelled]
        # The long permission text does not name its license.
        self.required = [frozenset(words_of(REQUIRED.get(label, ""))) & frozenset(words) for label, words in spelled]
        self.refused = [frozenset(words_of(REFUSED.get(label, ""))) for label, _ in spelled]

    def notices(self, paragraph: list[list[bytes]]) -> list[tuple[str, float]]:
        """Labels that the lines of a paragraph contain, with their containment."""
        words = [w for line in paragraph for w in line]
        held, out = set(words), []
        for k in self.contained(words):
            if not self.required[k] <= held:
                continue
            n = max(self._most(k, words, self.length[k]), *(self._most(k, line, len(line)) for line in paragraph))
            if n >= self.templates[k].need:
                out.append((self.templates[k].label, n / len(self.templates[k].words)))
        return out

    def _most(self, k: int, words: list[bytes], size: int) -> int:
        """Most words of a template in a run of `size` words that has the required words and no refused one."""
        asked = set(self.templates[k].words)
        counts: dict[int, int] = {}
        named: dict[bytes, int] = {}
        refused = best = 0
        for at, w in enumerate(words):
            for word, step in ((w, 1), *([(words[at - size], -1)] if at >= size else [])):
                refused += step * (word in self.refused[k])
                if word in self.required[k]:
                    named[word] = named.get(word, 0) + step
                r = self.rank.get(word)
                if r in asked:
                    counts[r] = counts.get(r, 0) + step
                    if not counts[r]:
                        del counts[r]
            if at + 1 >= min(size, len(words)) and not refused and all(named.get(x, 0) for x in self.required[k]):
                best = max(best, len(counts))
        return best


def paragraphs(text: str) -> Iterator[tuple[int, list[list[bytes]]]]:
    """First line and the words of each line of every run of lines that are not blank."""
    held: list[list[bytes]] = []
    for k, line in enumerate(text.split("\n")):
        if line.strip():
            held.append(words_of(line))
        elif held:
            yield k - len(held), held
            held = []
    if held:
        yield k + 1 - len(held), held


RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "blocks array<struct<block:int,label:string,containment:double>>")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE,
         threshold: float = THRESHOLD, notices: bool = False) -> DataFrame:
    """One row for each document: base counts and places, and every block that contains a template.

    Blocks are lines.  With `notices` runs across the lines of a paragraph count too, and each label
    is given once a paragraph, by the paragraph's first line.
    """
    counts = word_counts(docs, {w for _, text in templates for w in words_of(text)})
    index = (NoticeIndex if notices else TemplateIndex)(templates, counts, threshold)
    phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in base.items():
        words = words_of(phrase)
        phrases.setdefault(words[-1], []).append((words, label))

    def base_places(words: list[bytes]) -> list[tuple[int, str]]:
        found = []
        for last, asked in phrases.items():
            at = -1
            for _ in range(words.count(last)):
                at = words.index(last, at + 1)
                found += [(at - len(p) + 1, label) for p, label in asked if at + 1 >= len(p) and words[at - len(p) + 1:at + 1] == p]
        return found

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                places = base_places(words)
                blocks = []
                if not index.first_words.isdisjoint(words):
                    if notices:
                        found = ((k, index.notices(lines)) for k, lines in paragraphs(text))
                    else:
                        found = ((k, index.matches(words_of(line))) for k, line in enumerate(text.split("\n")))
                    blocks = [{"block": k, "label": x, "containment": c} for k, labels in found for x, c in labels]
                starts = [p for p, _ in places]
                for column, value in zip(out, (
                        len(words), len(places), min(starts, default=None), max(starts, default=None),
                        sorted({x for _, x in places}), blocks), strict=True):
                    column.append(value)
            kinds = (pa.int64(),) * 4 + (pa.list_(pa.string()), pa.list_(pa.struct(
                [("block", pa.int32()), ("label", pa.string()), ("containment", pa.float64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, RESULT)


def license_digest(docs: DataFrame, notices: bool = False) -> DataFrame:
    """doc_id, counts, places, base_labels, labels, score; the score of a base phrase is 1.

    With `notices` wrapped notices are found and telling words decide between neighbours.
    """
    both = F.array_sort(F.array_union("base_labels", F.transform("blocks", lambda b: b["label"])))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return scan(docs, notices=notices).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"))
