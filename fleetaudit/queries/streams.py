"""Queries of the streaming operators and of user rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures.views import Fixtures
from ..operators.rules import registry as reg, sdk, text_scan
from ..session import work_dir
from ..streaming import incremental as inc
from ..plans import audit
from .base import query
from .rules import (
    CONTENTS_DUCK, _COMP_SQL, _DETECTED, _EXPOSED, _MAN_SQL, _NET_002, _NET_008, _PAIR_SQL, _TEXT_SQL, _TITLE_FAM, contents, fleet_inputs, shown,
)

c = F.col


def _document_targets(batch):
    return batch.select(c("doc_id").cast("string").alias("app_id"), F.lit(0).cast("bigint").alias("target_seq"),
                        c("source").alias("location"), "text")


_STR_1 = _TEXT_SQL["SEC-004"].replace("fx_artifacts", "doc_targets")


@query("str_1", "WITH doc_targets AS (SELECT CAST(doc_id AS STRING) AS app_id, 0 AS target_seq, source AS location, text FROM documents) " + _STR_1)
def str_1(fx: Fixtures):
    base = work_dir(fx.spark)
    documents = fx.table("documents")
    # Three batches, so that batches have to agree with one another; the files of a batch grow in number with the table, not in size.
    files = max(3, fx.spark.read.parquet(f"{fx.sf_dir}/documents.parquet").rdd.getNumPartitions())
    documents.repartition(files, "doc_id").write.parquet(f"{base}/in")
    stream = inc.incremental_scan(
        fx.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint",
        lambda batch: text_scan.text_findings(_document_targets(batch), ["SEC-004"], keep_key=True), schema=documents.schema,
        files_per_batch=-(-files // 3), keys=["app_id", "rule_id", "dedupe_key"])
    stream.awaitTermination()
    return shown(fx.spark.read.parquet(f"{base}/out"))


def _event_stream(fx: Fixtures):
    schema = fx.table("events").schema
    return (fx.spark.readStream.schema(schema).parquet(f"{fx.sf_dir}/events*.parquet")
            .withColumn("event_time", c("ts").cast("timestamp"))
            .withColumn("sha256", F.sha2(F.concat_ws("/", "user_id", "event_type"), 256)))


@query("str_2", "SELECT DISTINCT sha256(user_id || '/' || event_type) AS sha256 FROM events")
def str_2(fx: Fixtures):
    base = work_dir(fx.spark)
    fresh = inc.skip_seen(_event_stream(fx), "sha256", "event_time", "60 days").select("sha256")
    inc.append_batches(fresh, lambda b: b, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return fx.spark.read.parquet(f"{base}/out").select("sha256")


@query("str_3", """SELECT CAST(date_trunc('day', ts) AS STRING) AS window_start, event_type AS status, count(*) AS items FROM events GROUP BY 1, 2""")
def str_3(fx: Fixtures):
    base = work_dir(fx.spark)
    counts = inc.lifecycle_counts(_event_stream(fx), "event_time", "event_type")
    inc.append_batches(counts, lambda b: b, f"{base}/out", f"{base}/checkpoint", mode="update").awaitTermination()
    return inc.latest_counts(fx.spark.read.parquet(f"{base}/out")).select(c("window_start").cast("string").alias("window_start"), "status", "items")


_BAD = "CASE event_id % 5 WHEN 0 THEN 'not json' ELSE props END"


@query("str_4", """SELECT event_id, CASE WHEN e = '' THEN 'COMPLETE' ELSE 'FAILED' END AS status, nullif(e, '') AS error_message FROM (
    SELECT event_id, concat_ws('; ', CASE WHEN event_id % 5 = 0 THEN 'props is not JSON' END, CASE WHEN event_id % 7 = 0 THEN 'value is not a number' END) AS e FROM events)""")
def str_4(fx: Fixtures):
    value = F.when(c("event_id") % 7 == 0, "n/a").otherwise(c("value").cast("string"))
    rows = fx.table("events").select("event_id", F.expr(_BAD).alias("props"), value.alias("value"))
    return inc.isolate_failures(rows, {
        "props is not JSON": F.get_json_object("props", "$.k").isNotNull(),
        "value is not a number": c("value").try_cast("double").isNotNull(),
    }).select("event_id", "status", "error_message")


# --- user rules and replacement catalogs -----------------------------------------------------------


@query("ext_1", """SELECT app_id, 'USR-001' AS rule_id, 'Large target' AS title, 'OTHER' AS category, 'LOW' AS severity, 'HIGH' AS confidence,
    'characters: ' || length(text) AS evidence, location FROM fx_artifacts WHERE length(text) > 2000""")
def ext_1(fx: Fixtures):
    def apply(inputs):
        n = F.length("text")
        return inputs.artifacts.where(n > 2000).select(
            "app_id", c("target_seq").alias("finding_seq"), F.lit("USR-001").alias("rule_id"), F.lit("Large target").alias("title"),
            F.lit("OTHER").alias("category"), F.lit("LOW").alias("severity"), F.lit("HIGH").alias("confidence"),
            F.concat(F.lit("characters: "), n.cast("string")).alias("evidence"), "location")

    registry = reg.RuleRegistry(builtin=False)
    registry.register(reg.Rule("USR-001", "Large target", "OTHER", "LOW", apply=apply))
    return shown(registry.run(reg.Inputs(artifacts=fx.artifacts())))


def _shouting(app_id: str, location: str, text: str):
    if location == "key.pem":
        raise ValueError("password=hunter2hunter2 in " + location)
    if "TODO" in text or "setSeed" in text:
        yield {"evidence": "marker found"}


@query("ext_3", """SELECT app_id, 'found' AS outcome, 'marker found' AS detail FROM fx_artifacts WHERE location <> 'key.pem' AND (contains(text, 'TODO') OR contains(text, 'setSeed'))
      AND app_id NOT IN (SELECT app_id FROM fx_artifacts WHERE location = 'key.pem')
    UNION ALL SELECT app_id, 'error', 'ValueError: [REDACTED_SECRET] in key.pem' FROM fx_artifacts WHERE location = 'key.pem'""")
def ext_3(fx: Fixtures):
    registry = reg.RuleRegistry(builtin=False)
    registry.register(reg.Rule("USR-002", "Marker", "OTHER", evaluate=_shouting))
    inputs = reg.Inputs(artifacts=fx.artifacts())
    rows = registry.user_rows(inputs, work_dir(fx.spark))
    found = registry.run(inputs, user_rows=rows).select("app_id", F.lit("found").alias("outcome"), c("evidence").alias("detail"))
    return found.union(registry.errors(rows).select("app_id", F.lit("error"), "error"))


_OWN_SDKS = [("shop_ui", "Shop UI", "social", r"com\.shop\.ui", "Own catalog row.", [])]


@query("ext_4", """SELECT app_id, 'Shop UI' AS sdk_name, count(*) AS hits FROM fx_components WHERE regexp_matches(name, '(?i)com\\.shop\\.ui')
    GROUP BY app_id""")
def ext_4(fx: Fixtures):
    found = sdk.detected_sdks(fx.candidates(), _OWN_SDKS).select("app_id", sdk._sdk_field(1, _OWN_SDKS).alias("sdk_name"))
    named = fx.components.where(c("name").rlike(r"(?i)com\.shop\.ui")).groupBy("app_id").agg(F.count("*").alias("hits"))
    return found.join(named, "app_id")


# --- the whole audit ------------------------------------------------------------------------------

_PARTS = [*_MAN_SQL.values(), *_COMP_SQL.values(), _PAIR_SQL, *_TEXT_SQL.values(), _NET_002, _NET_008]
_SDK_1 = f"""SELECT app_id, 'SDK-001' AS rule_id, 'Third-Party SDK Detected: ' || name || ' (' || category || ')' AS title,
    'SDK: ' || name || ' (Category: ' || category || ', Matched: ' || matched || ' in ' || kind || ')' AS evidence, kind AS location FROM {_DETECTED}"""
_SDK_2 = f"""SELECT app_id, 'SDK-002' AS rule_id, 'SDK Permission Exposure: ' || name || ' with ' || {_TITLE_FAM} || ' Access' AS title,
    'SDK ''' || name || ''' (' || d.category || ') detected in ' || kind || ' + Host permissions: [' || perms || ']' AS evidence,
    kind || ':<uses-permission>' AS location FROM {_EXPOSED}"""
_KEY = "app_id, rule_id, title, evidence, location"


@query("audit", "SELECT rule_id, count(*) AS findings, count(DISTINCT app_id) AS apps, "
       f"{CONTENTS_DUCK} FROM (SELECT DISTINCT * FROM ("
       + " UNION ALL ".join(f"SELECT {_KEY} FROM ({s})" for s in [*_PARTS, _SDK_1, _SDK_2]) + ")) GROUP BY 1")
def whole_audit(fx: Fixtures):
    found = audit.audit_findings(fleet_inputs(fx))
    per_app = found.groupBy("rule_id", "app_id").agg(F.count("*").alias("n"), contents())
    return per_app.groupBy("rule_id").agg(
        F.sum("n").alias("findings"), F.count("*").alias("apps"), F.sum("contents").alias("contents"))


@query("audit_scores")
def audit_scores(fx: Fixtures):
    """Scores of the audit; the findings are written once and read back, as a job would."""
    path = work_dir(fx.spark)
    audit.audit_findings(fleet_inputs(fx)).write.parquet(path)
    return audit.audit_scores(fx.spark.read.parquet(path), fx.apps)
