"""Positive and negative snippets of the text, manifest and SDK rules."""

import pytest

from fleetaudit.operators.rules import manifest, sdk, text_scan
from fleetaudit.operators.rules.registry import Inputs, Rule, RuleRegistry
from fleetaudit.schemas import APPS, ARTIFACTS, CANDIDATES, COMPONENTS, PERMISSIONS


def scan(spark, text, location="A.java", rules=None):
    df = spark.createDataFrame([("1", 0, location, text)], ARTIFACTS)
    return text_scan.text_findings(df, rules).collect()


def ids(spark, text, location="A.java"):
    return {r["rule_id"] for r in scan(spark, text, location)}


NEAR3 = "File f = Environment.getExternalStorageDirectory();\n\n\nsave(password);"
NEAR4 = "File f = Environment.getExternalStorageDirectory();\n\n\n\nsave(password);"
TOKEN = "aK9xQ2mZ7pL4wR8tB3nV6cY1"


@pytest.mark.parametrize("rule, yes, no", [
    ("NET-001", 'u = "http://api.real-host.io/x"', 'u = "http://localhost/x"; v = "https://api.real-host.io"'),
    ("NET-003", "void checkServerTrusted(X[] c, String s) { }", "void checkServerTrusted(X[] c, String s) { throw e; }"),
    ("NET-004", "boolean verify(String h, S s) { return true; }", "boolean verify(String h, S s) { return hv.verify(h, s); }"),
    ("NET-005", "onReceivedSslError(W v, H handler) { handler.proceed(); }", "onReceivedSslError(W v, H handler) { handler.cancel(); }"),
    ("NET-006", "s.setAllowFileAccessFromFileURLs(true)", "s.setAllowFileAccessFromFileURLs(false)"),
    ("NET-007", "call mixpanel.com now", "call unrelated-host.org now"),
    ("NET-008", 'u = "https://api.vendor.io/x"', 'u = "https://www.google.com/x"'),
    ("STO-001", 'openFileOutput("a", 1)', 'openFileOutput("a", 0)'),
    ("STO-002", NEAR3, NEAR4),
    ("STO-003", 'editor.putString("auth_token", t)', 'EncryptedSharedPreferences e; editor.putString("auth_token", t)'),
    ("STO-004", "CREATE TABLE u (id INT, password TEXT)", "CREATE TABLE u (id INT, title TEXT)"),
    ("STO-005", 'Log.d(TAG, "x" + token)', 'Log.d(TAG, "x" + count)'),
    ("STO-006", "getCacheDir()\n\n\ncvv", "getCacheDir()\n\n\n\ncvv"),
    ("CRY-001", 'Cipher.getInstance("DES")', 'Cipher.getInstance("AES/GCM/NoPadding")'),
    ("CRY-002", 'Cipher.getInstance("AES")', 'Cipher.getInstance("aes")'),
    ("CRY-003", "new IvParameterSpec(new byte[16])", "new IvParameterSpec(random)"),
    ("CRY-003", "byte[] v = new byte[16];" + " " * 100 + "new IvParameterSpec(v)", "byte[] v = new byte[16];" + " " * 200 + "new IvParameterSpec(v)"),
    ("CRY-003", "byte[] v = new byte[16]; new IvParameterSpec(v)", "byte[] v = new byte[16]; new IvParameterSpec(w)"),
    ("CRY-004", 'new SecretKeySpec("abcdefgh1".getBytes(), "AES")', 'new SecretKeySpec(ks.getKey(), "AES")'),
    ("CRY-005", 'MessageDigest.getInstance("MD5"); // cache checksum of the password', 'MessageDigest.getInstance("MD5"); // cache checksum'),
    ("CRY-006", "SecureRandom r; r.setSeed(42);", "Random r; r.setSeed(42);"),
    ("SEC-004", f'api_key = "{TOKEN}"', 'api_key = "your_api_key_1234567890"'),
    ("SEC-005", 'password = "correct-horse"', 'text = "Please enter your password in the form below."'),
])
def test_snippets(spark, rule, yes, no):
    assert rule in ids(spark, yes)
    assert rule not in ids(spark, no)


def test_cleartext_config_depends_on_location(spark):
    text = '<base-config cleartextTrafficPermitted="true"/>'
    assert "NET-002" in ids(spark, text, "res/xml/network_security_config.xml")
    assert "NET-002" not in ids(spark, text, "assets/notes.txt")


def test_tracking_match_is_a_substring_of_host_and_path(spark):
    found = scan(spark, 'a("https://notadjust.com/p")', rules=["NET-007"])
    assert [r["evidence"] for r in found] == ["Static evidence: URL: https://notadjust.com/p (matches adjust.com)"]


def test_first_target_wins(spark):
    rows = [("1", 1, "B.java", "http://x.real-host.io/a"), ("1", 0, "A.java", "http://x.real-host.io/a")]
    found = text_scan.text_findings(spark.createDataFrame(rows, ARTIFACTS), ["NET-001"]).collect()
    assert [(r["location"], r["rule_id"]) for r in found] == [("A.java", "NET-001")]


def test_secret_never_shown_in_full(spark):
    found = scan(spark, f'token = "{TOKEN}"', rules=["SEC-004"])
    assert len(found) == 1 and TOKEN not in found[0]["evidence"]
    assert found[0]["evidence"] == f"Token: {TOKEN[:4]}********{TOKEN[-3:]}"


def test_first_party_hosts_are_left_out(spark):
    art = spark.createDataFrame([("1", 0, "A.java", "https://cdn.bigshop.net/a https://cdn.other.net/a")], ARTIFACTS)
    apps = spark.createDataFrame([("1", "com.bigshop.android")], "app_id string, package_name string")
    found = text_scan.text_findings(art, ["NET-008"], apps).collect()
    assert [r["evidence"] for r in found] == ["Static endpoint reference: https://cdn.other.net/a"]


def test_long_text_is_read_to_its_end(spark):
    text = "word " * 400_000 + '\nCipher.getInstance("DES")'
    assert "CRY-001" in ids(spark, text)


def test_backup_fires_on_missing_flag(spark):
    base = dict.fromkeys([c.split()[0] for c in APPS.replace("\n", " ").split(",")])
    rows = [tuple({**base, "app_id": str(i), "allow_backup": v, "target_sdk": "30"}.values()) for i, v in enumerate([True, False, None])]
    got = manifest.manifest_findings(apps=spark.createDataFrame(rows, APPS), rules=["MAN-002", "MAN-001"]).collect()
    assert sorted(r["app_id"] for r in got) == ["0", "2"]


def test_sensitive_action_lists_three(spark):
    row = ("1", 0, "service", "a.b.Sync", True, None, None, None, True, False, ["x.LOGIN", "x.SYNC", "x.view", "x.RESET", "x.EXPORT"])
    got = manifest.manifest_findings(components=spark.createDataFrame([row], COMPONENTS), rules=["MAN-009"]).collect()
    assert got[0]["evidence"] == "Action(s): x.LOGIN, x.SYNC, x.RESET on exported component 'a.b.Sync'"


def test_sdk_exposure_needs_the_permission(spark):
    cand = spark.createDataFrame([("1", 0, "Class", "com.appsflyer.Lib"), ("2", 0, "Class", "com.appsflyer.Lib")], CANDIDATES)
    perms = spark.createDataFrame([("1", 0, "android.permission.ACCESS_FINE_LOCATION"), ("2", 0, "android.permission.INTERNET")], PERMISSIONS)
    found = sdk.detected_sdks(cand)
    assert sdk.sdk_findings(found).count() == 2
    assert [r["title"] for r in sdk.exposure_findings(found, perms).collect()] == [
        "SDK Permission Exposure: AppsFlyer with Location Access"]


def test_registry_keeps_the_last_registration(spark):
    registry = RuleRegistry(builtin=False)
    registry.register(Rule("U-1", "old", "OTHER"))
    registry.register(Rule("U-1", "new", "OTHER"))
    assert registry.get("U-1").title == "new" and len(registry.all()) == 1
    assert registry.disable("U-1") and registry.enabled() == []
    assert registry.unregister("U-1") and not registry.unregister("U-1")


def test_stage_routing_drops_permission_rules():
    routed = {r.rule_id for r in RuleRegistry().routed(by_stage=True)}
    assert "MAN-010" not in routed and {"MAN-003", "MAN-001"} <= routed


def test_failing_user_rule_does_not_stop_the_others(spark):
    def bad(app, loc, text):
        raise RuntimeError("token=abcdefgh")

    registry = RuleRegistry(builtin=False)
    registry.register(Rule("U-1", "bad", "OTHER", evaluate=bad))
    registry.register(Rule("U-2", "good", "OTHER", evaluate=lambda a, l, t: [{"evidence": t}]))
    inputs = Inputs(artifacts=spark.createDataFrame([("1", 0, "A", "hi")], ARTIFACTS))
    assert [r["rule_id"] for r in registry.run(inputs).collect()] == ["U-2"]
    assert [r["error"] for r in registry.errors(inputs).collect()] == ["RuntimeError: [REDACTED_SECRET]"]


def test_hot_application_scan(spark):
    rows = [("hot", i, "A.java", 'Cipher.getInstance("DES")' if i % 2 else "http://x.real-host.io/a") for i in range(3000)]
    found = text_scan.text_findings(spark.createDataFrame(rows, ARTIFACTS), ["CRY-001", "NET-001"]).collect()
    assert sorted((r["rule_id"], r["location"]) for r in found) == [("CRY-001", "A.java"), ("NET-001", "A.java")]
