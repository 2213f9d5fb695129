"""The pipeline stage by stage against brute force, and the registered corpus queries."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_decontaminate import brute as contaminated
from test_similar import brute_links
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from fleetaudit.llm import quality, queries
from fleetaudit.session import work_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages_match_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    chunks = {d: quality.chunk_bytes(t) for d, t in rows.items()}
    scores = {d: float(quality.score_chunks(weights, c, np.array([0]))[0]) for d, c in chunks.items()}
    sure = {d for d, s in scores.items() if abs(s - quality.KEEP_FROM) > 1e-4}
    want = {d for d, s in scores.items() if s >= quality.KEEP_FROM}
    for (name, stage), columns in zip(corpus_pipeline.STAGES, [docs.columns] * 4 + [None], strict=True):
        out = stage(spark, docs, sf_dir)
        if name == "pack":
            break
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "exact":
            best = {}
            for d in want:
                best[low(rows[d])] = max(d, best.get(low(rows[d]), d))
            want = set(best.values())
        elif name == "near":
            ids = sorted(want)
            first = {d: d for d in ids}
            for i, j in brute_links([rows[d] for d in ids]):
                low_root, high_root = sorted((first[ids[i]], first[ids[j]]))
                first = {d: low_root if r == high_root else r for d, r in first.items()}
            want = set(first.values())
        elif name == "decontaminate":
            want -= {r[0] for r in contaminated([(d, rows[d]) for d in want], items) if r[5]}
        else:
            assert set(got) & sure == want & sure
            want = set(got)
        assert set(got) == want and all(got[d] == rows[d] for d in got)
        assert 0 < len(want) < len(rows)
        before = want
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = out.toPandas()
    assert set(pieces["doc_id"]) == before
    for doc, part in pieces.sort_values("piece").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(rows[doc], add_special_tokens=False).ids, 0], "<u4")
        assert part["length"].sum() == len(ids)
        for p in part.itertuples():
            assert zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32
    for _, part in pieces.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 2048


def test_edges_go_through(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 1, 0), (None, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "in/labels.parquet"))
    spark.createDataFrame([(None, "one two three"), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "in/benchmark.parquet"))
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, "no id here", None, None, None, None),
            (4, "Some words that stay.", "en", None, 3, "x"), (5, "some WORDS that stay.", None, "s", 3, "x"), (6, "one two three", "en", "s", 3, "x"),
            (7, "long text " * 40_000, "en", "s", None, "x"), (7, "long text " * 40_000, "en", "s", None, "x")]
    for given, ids in ((rows, {2, 5, 7}), ([], set())):
        docs = spark.createDataFrame(given, DOCS)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path / "in"))
        assert {r["doc_id"] for r in docs.collect()} - {None} == ids


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_check(spark, name):
    sf_dir, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = con.execute(queries.ORACLES[name])
    order = [df.columns.index(d[0]) for d in cursor.description]
    assert len(order) == len(df.columns)
    assert Counter(tuple(r[i] for i in order) for r in df.collect()) == Counter(cursor.fetchall())


def test_every_operator_is_registered():
    names = entry_module.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert work_dir and set(entry_module.oracle_sql()) >= set(queries.ORACLES)


def test_stages_take_long_texts_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(k, "word " * 40_000, "en", "x") for k in range(100)], "doc_id long, text string, lang string, source string")
    try:
        corpus_pipeline.exact(spark, docs, "")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("text").nbytes])], names=["n"])

        assert max(r["n"] for r in docs.coalesce(1).mapInArrow(sizes, "n long").collect()) < 5 << 20
    finally:
        spark.conf.set(key, before)
