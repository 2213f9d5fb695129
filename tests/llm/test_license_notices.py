"""Labels of the license query: neighbours are told apart, wrapped notices are found."""

import textwrap

import pytest

from fleetaudit.llm import licenses, queries

LINES = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Released under the license.", ""), ("Released under the MIT License.", "mit"), ("Licensed under the License, Version 2.0.", ""),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ""),
]


def labels(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return {r["doc_id"]: r["labels"] for r in queries.QUERIES["op10_license_scan"](spark, str(tmp_path)).collect()}


def test_neighbours_are_told_apart(spark, tmp_path):
    got = labels(spark, tmp_path, [f"Some words.\n{line}\nMore words." for line, _ in LINES])
    assert got == {k: want for k, (_, want) in enumerate(LINES)}


def test_narrower_notices_refuse_the_wider_one():
    index = licenses.NoticeIndex(licenses.TEMPLATES, {})
    lesser = "This work is licensed under the GNU Lesser General Public License, version 3."
    both = [licenses.words_of(x) for x in (lesser, LINES[0][0])]
    assert {x for x, _ in index.notices(both[:1])} == {"lgpl"}
    assert {x for x, _ in index.notices(both)} == {"gpl", "lgpl"}
    assert {x for x, _ in index.notices([both[0] + both[1]])} == {"gpl", "lgpl"}


@pytest.mark.parametrize("width, prefix", [(72, ""), (72, " * "), (30, "# ")])
def test_wrapped_templates_are_found(spark, tmp_path, width, prefix):
    texts = ["Head\n\n" + textwrap.fill(t, width, initial_indent=prefix, subsequent_indent=prefix) + "\n\nTail" for _, t in licenses.TEMPLATES]
    got = labels(spark, tmp_path, texts)
    for k, (label, text) in enumerate(licenses.TEMPLATES):
        assert label in got[k].split(","), text


def test_words_scattered_over_a_paragraph_are_no_notice(spark, tmp_path):
    far = "Wir gehen mit.\n" + "So it goes on.\n" * 5 + LINES[0][0]
    assert labels(spark, tmp_path, [far]) == {0: "gpl"}


def test_paragraphs_end_at_blank_lines():
    assert list(licenses.paragraphs("a\nb c\n \n\nd\r\n\r\n")) == [(0, [[b"a"], [b"b", b"c"]]), (4, [[b"d"]])]
    assert list(licenses.paragraphs("")) == []
