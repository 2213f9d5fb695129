"""Named queries of the corpus operators and their DuckDB checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import work_dir
from .byte_bpe import read_ranks, round_trip
from .conversation_repair import repair_conversations
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .html_text import extract_text
from .language import identify_languages
from .licenses import license_digest
from .line_dedup import LEAST_PAGES, RATIO, drop_boilerplate
from .lm_score import pseudo_likelihood
from .packing import pack_documents
from .quality import classify_quality
from .simhash import near_duplicates
from .spelling import spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_exact_dedup", f"""
WITH n AS (SELECT doc_id, {LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"), work_dir(spark))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(
        table(spark, sf_dir, "documents"), work_dir(spark), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), work_dir(spark))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), work_dir(spark))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"), notices=True)


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"), work_dir(spark))


@query("op4_line_dedup", f"""
WITH l AS (
    SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
c AS (SELECT host, trim(line) AS line, count(DISTINCT doc_id) AS pages FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
t AS (SELECT coalesce(source, '') AS host, count(*) AS host_pages FROM documents GROUP BY 1),
b AS (SELECT host, line FROM c JOIN t USING (host) WHERE pages >= {LEAST_PAGES} AND pages > {RATIO} * host_pages)
SELECT l.doc_id, l.host, count(*) AS n_lines, count(b.line) AS n_dropped,
       coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '') AS text
FROM l LEFT JOIN b ON l.host = b.host AND trim(l.line) = b.line
GROUP BY l.doc_id, l.host""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents"), "source")


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN)


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"), work_dir(spark))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), work_dir(spark))
