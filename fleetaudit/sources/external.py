"""Readers for other tools' results, ground truth and our own results."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.classify import canonical_category
from ..functions.text import normalize_name, strip

REQUIRED = ["apk_hash", "tool", "finding_category", "finding_name", "severity"]
OUR_TOOL = "fleetaudit"
#: Column with the file of a record.
FILE = "__file"


#: Column with the text of a record that does not parse, or not wholly.
CORRUPT = "__corrupt"


def read_external_csv(spark: SparkSession, path: str) -> DataFrame:
    """External findings: headers in any case, BOM tolerated, rows without hash dropped.

    A quoted cell may hold line breaks, so a file is read by one task.  A row with too few cells has empty ones, one
    with too many loses the last; `external_csv_problems` lists these and the dropped rows.
    """
    return external_findings(_csv(spark, path))


def external_csv_problems(spark: SparkSession, path: str) -> DataFrame:
    """file, record, reason, kept of the rows that are not taken as they stand.

    Reasons are `ragged` (cells are missing or too many; kept if there is a hash) and `no hash` (dropped).  The rows of
    the file are those of `read_external_csv` and the problems that are not kept.
    """
    raw = _csv(spark, path)
    there = F.coalesce(strip(F.col("apk_hash")), F.lit("")) != ""
    cells = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in raw.columns if c not in (CORRUPT, FILE)])
    ragged = F.col(CORRUPT).isNotNull()
    return raw.select(
        F.col(FILE).alias("file"), F.coalesce(CORRUPT, cells).alias("record"),
        F.when(~there, "no hash").when(ragged, "ragged").alias("reason"), there.alias("kept")).where("reason IS NOT NULL")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text with clean names, `CORRUPT` and `FILE`."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    names = spark.read.csv(path, **options).columns
    schema = StructType([StructField(n, StringType()) for n in [*names, CORRUPT]])
    raw = spark.read.csv(path, schema, enforceSchema=False, columnNameOfCorruptRecord=CORRUPT, **options)
    clean = [c.replace("\ufeff", "").strip().lower() for c in names]
    return raw.select("*", F.col("_metadata.file_path")).toDF(*clean, CORRUPT, FILE)


def external_findings(raw: DataFrame) -> DataFrame:
    missing = sorted(set(REQUIRED) - set(raw.columns))
    if missing:
        raise ValueError(f"external results lack required columns: {missing}")
    cell = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    return raw.where(cell("apk_hash") != "").select(
        F.lower(cell("apk_hash")).alias("apk_hash"),
        cell("tool").alias("tool"),
        canonical_category(cell("finding_category")).alias("finding_category"),
        cell("finding_category").alias("raw_finding_category"),
        cell("finding_name").alias("finding_name"),
        normalize_name(cell("finding_name")).alias("normalized_name"),
        F.upper(cell("severity")).alias("severity"),
    )


_ENTRY = "struct<expected_rules:array<string>,filename:string,sha256:string,package:string,identifier:string>"


def truth_from_documents(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Ground truth from JSON documents keyed by application: plain or under `apks`.

    One row per document; a corpus is many documents, each of its own size.
    """
    entries = F.coalesce(
        F.from_json(F.get_json_object(column, "$.apks"), f"map<string,{_ENTRY}>"),
        F.from_json(column, f"map<string,{_ENTRY}>"),
    )
    rows = docs.select(F.posexplode(F.map_entries(entries)).alias("pos", "e")).where(F.col("e.value").isNotNull())
    return _last_per_key(rows.select("pos", F.col("e.key").alias("key"), F.col("e.value.expected_rules").alias("expected_rules")))


def truth_from_records(records: DataFrame) -> DataFrame:
    """Ground truth from one record per application: the first identifier that is set is the key."""
    key = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("filename", "sha256", "package", "identifier") if c in records.columns])
    return _last_per_key(
        records.select(F.lit(0).alias("pos"), key.alias("key"), "expected_rules").where("key IS NOT NULL"))


def _last_per_key(rows: DataFrame) -> DataFrame:
    last = Window.partitionBy("gt_key").orderBy(F.col("pos").desc())
    return (
        rows.select("pos", F.lower(strip(F.col("key"))).alias("gt_key"),
                    F.coalesce("expected_rules", F.array().cast("array<string>")).alias("expected_rules"))
        .withColumn("rn", F.row_number().over(last)).where("rn = 1").select("gt_key", "expected_rules")
    )


_FINDING = (
    "struct<rule_id:string,finding_name:string,title:string,finding_category:string,category:string,severity:string>"
)
RESULT_SCHEMA = (
    f"sha256 string, findings array<{_FINDING}>, detected_rules array<string>, "
    f"application struct<sha256:string>, apks array<struct<sha256:string,findings:array<{_FINDING}>,detected_rules:array<string>>>"
)


def read_own_results(spark: SparkSession, path: str, form: str | None = None, records: DataFrame | None = None) -> DataFrame:
    """Findings of result files: CSV, whole JSON documents, or JSON lines.

    `form` is `csv` or `json`; by default `csv` for a path that ends in `.csv`.  Each JSON file tells by itself
    whether it is one document, indented or not, or has a record a line, so a folder may hold both.
    `own_result_problems` lists records that cannot be read.  `records` are those of `own_records`, if there are any yet.
    """
    if (form or ("csv" if path.lower().endswith(".csv") else "json")) == "csv":
        return own_findings_csv(_csv(spark, path))
    return own_findings((own_records(spark, path) if records is None else records).where(F.col(CORRUPT).isNull()))


def own_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each JSON record with its file; one that does not parse has its text in `CORRUPT`."""
    reader = spark.read.schema(f"{RESULT_SCHEMA}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
    # Folders named key=value would add columns of their own.
    columns = ["sha256", "findings", "detected_rules", "application", "apks", CORRUPT, F.col("_metadata.file_path").alias(FILE)]
    whole = whole_documents(spark, path)
    lines = reader.json(path).select(*columns)
    if not whole:
        return lines
    documents = reader.json([unquote(f) for f in whole], multiLine=True).select(*columns)
    return lines.where(~F.col(FILE).isin(whole)).unionByName(documents)


def whole_documents(spark: SparkSession, path: str) -> list[str]:
    """Files whose first line with text is not JSON by itself: each is one document over many lines.

    The reader lists the files on the driver anyway; of their text only one line each is kept.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_path").alias(FILE))
    first = lines.where(F.trim("value") != "").groupBy(FILE).agg(F.min_by("value", "n").alias("line"))
    return sorted(r[FILE] for r in first.where(F.expr("try_parse_json(line) IS NULL")).select(FILE).collect())


def own_result_problems(spark: SparkSession, path: str, records: DataFrame | None = None) -> DataFrame:
    """file, record, reason of JSON records without findings of an application: `malformed` or `no hash`."""
    records = own_records(spark, path) if records is None else records
    hashes = F.coalesce(F.transform("apks", lambda a: a["sha256"]), F.array(F.coalesce(F.col("sha256"), F.col("application.sha256"))))
    known = F.exists(hashes, lambda h: F.coalesce(F.lower(strip(h)), F.lit("")).isin("", "n/a") == F.lit(False))
    text = F.coalesce(CORRUPT, F.to_json(F.struct("sha256", "detected_rules")))
    return records.select(
        F.col(FILE).alias("file"), text.alias("record"),
        F.when(F.col(CORRUPT).isNotNull(), "malformed").when(~known, "no hash").alias("reason")).where("reason IS NOT NULL")


def own_findings_csv(raw: DataFrame) -> DataFrame:
    """Findings of our flat result table; a column that is absent counts as empty."""
    cell = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) if c in raw.columns else F.lit("")
    either = lambda *names: F.coalesce(*[F.nullif(cell(n), F.lit("")) for n in names])
    name = F.coalesce(either("finding_name", "title", "rule_id"), F.lit("Finding"))
    return raw.select(
        F.lower(either("sha256", "apk_hash")).alias("apk_hash"), F.lit(OUR_TOOL).alias("tool"),
        canonical_category(either("finding_category", "category")).alias("finding_category"), name.alias("finding_name"),
        normalize_name(name).alias("normalized_name"), F.upper(F.coalesce(either("severity"), F.lit("MEDIUM"))).alias("severity"),
        either("rule_id").alias("rule_id"),
    ).where("apk_hash IS NOT NULL")


def own_findings(results: DataFrame) -> DataFrame:
    """Findings of our result files.

    Accepts a document with an `apks` list, one record per application, or a
    single result document; without `findings` the rule ids stand in.
    """
    one = F.array(F.struct(
        F.coalesce(F.col("sha256"), F.col("application.sha256")).alias("sha256"), "findings", "detected_rules"))
    apk = F.col("a")
    stand_in = F.transform(
        apk["detected_rules"],
        lambda r: F.struct(
            r.alias("rule_id"), F.lit(None).cast("string").alias("finding_name"), F.lit(None).cast("string").alias("title"),
            r.alias("finding_category"), F.lit(None).cast("string").alias("category"), F.lit("HIGH").alias("severity")),
    )
    f = F.col("f")
    name = F.coalesce(F.nullif(f["finding_name"], F.lit("")), F.nullif(f["title"], F.lit("")), f["rule_id"], F.lit("Finding"))
    category = F.coalesce(F.nullif(f["finding_category"], F.lit("")), f["category"])
    return (
        results.select(F.explode(F.coalesce("apks", one)).alias("a"))
        .select(F.lower(strip(apk["sha256"])).alias("apk_hash"), F.explode(F.coalesce(apk["findings"], stand_in)).alias("f"))
        .where((F.coalesce("apk_hash", F.lit("")) != "") & (F.col("apk_hash") != "n/a"))
        .select(
            "apk_hash", F.lit(OUR_TOOL).alias("tool"), canonical_category(category).alias("finding_category"),
            name.alias("finding_name"), normalize_name(name).alias("normalized_name"),
            F.upper(F.coalesce(f["severity"], F.lit("MEDIUM"))).alias("severity"), f["rule_id"].alias("rule_id"),
        )
    )
