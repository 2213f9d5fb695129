"""Stages decide each row by itself: rows without doc_id and rows that repeat one."""

import pytest

from fleetaudit.llm import decontaminate, exact_dedup, simhash
from fleetaudit.session import work_dir

PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen"
LONG = " ".join(f"word{i}" for i in range(400))
SCHEMA = "doc_id long, text string, n int"


@pytest.fixture(params=["stored", "made"])
def table(request, spark, tmp_path):
    """Makes a table of texts and ids; stored ones lie in several files."""

    def make(rows):
        docs = spark.createDataFrame([(d, t, n) for n, (d, t) in enumerate(rows)], SCHEMA).repartition(3)
        if request.param == "stored":
            docs.write.parquet(str(tmp_path / "docs"))
            docs = spark.read.parquet(str(tmp_path / "docs"))
        return docs

    return make


def left(found):
    assert found.columns == ["doc_id", "text", "n"]
    return sorted(r["n"] for r in found.collect())


def test_clean_rows_stay_beside_contaminated_ones(spark, table):
    docs = table([(None, PASSAGE), (None, "a clean text"), (5, PASSAGE), (5, "another clean text"), (6, "more")])
    items = spark.createDataFrame([("i", PASSAGE)], "item_id string, text string")
    assert left(decontaminate.drop_contaminated(docs, items, work_dir(spark))) == [1, 3, 4]


def test_one_copy_stays(spark, table):
    docs = table([(None, "a"), (None, "A"), (None, "b"), (3, "b"), (4, "c"), (4, "c"), (4, "d"), (9, "d"), (None, "e")])
    got = left(exact_dedup.drop_exact_duplicates(docs, work_dir(spark)))
    assert len(got) == 5 and got[0] in (0, 1) and got[1] == 3 and got[2] in (4, 5) and got[3:] == [7, 8]


def test_one_near_copy_stays(spark, table):
    near, other = LONG.replace("word7 ", "other "), LONG.replace("word", "else")
    docs = table([(None, LONG), (None, near), (None, "quite different words stand here"), (2, other), (2, other), (None, other), (2, "short text of another group"), (8, "short text of another group")])
    got = left(simhash.drop_near_duplicates(docs, work_dir(spark)))
    assert len(got) == 4 and got[0] in (0, 1) and got[1] == 2 and got[2] in (3, 4) and got[3] == 6
