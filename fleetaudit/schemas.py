"""Table contracts.

Every operator takes and returns DataFrames with these columns; extra columns
on an input are ignored.
"""

APPS = """
    app_id string, filename string, sha256 string, file_size bigint, package_name string,
    app_name string, version_name string, version_code string, min_sdk string, target_sdk string,
    allow_backup boolean, debuggable boolean, uses_cleartext_traffic boolean,
    network_security_config string, manifest_xml string, analyzed_at timestamp
"""

COMPONENTS = """
    app_id string, comp_seq bigint, component_type string, name string, exported boolean,
    permission string, read_permission string, write_permission string,
    has_intent_filter boolean, is_main_launcher boolean, actions array<string>
"""

PERMISSIONS = "app_id string, perm_seq bigint, permission string"

ARTIFACTS = "app_id string, target_seq bigint, location string, text string"

CANDIDATES = "app_id string, cand_seq bigint, kind string, text string"

ARCHIVE_ENTRIES = """
    app_id string, entry_seq bigint, entry_name string, file_size bigint, compress_size bigint
"""

# finding_seq is any number, unique in the application; the rules of this package give decimals of 38 digits.
FINDINGS = """
    app_id string, finding_seq bigint, rule_id string, title string, category string,
    severity string, confidence string, evidence string, location string
"""

SCANS = """
    scan_id string, app_id string, risk_score double, risk_rating string, duration double,
    analyzer_version string, created_at timestamp, result_json string
"""

GROUND_TRUTH = "gt_key string, expected_rules array<string>"

EXTERNAL_FINDINGS = """
    apk_hash string, tool string, finding_category string, raw_finding_category string,
    finding_name string, normalized_name string, severity string
"""

FINDING_COLUMNS = [
    "app_id", "finding_seq", "rule_id", "title", "category",
    "severity", "confidence", "evidence", "location",
]
