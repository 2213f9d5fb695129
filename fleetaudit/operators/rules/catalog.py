"""Rule metadata: stage order, category, default severity, reference, prose.

The order of `RULES` is the discovery order of the stages (manifest, secrets,
network, storage, crypto, SDK).  `finding_seq` packs it with the position of
the hit, so the order of findings never needs a sort or a global counter.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.classify import literal_case

M1 = "OWASP-M1: Improper Platform Usage"
M2 = "OWASP-M2: Insecure Data Storage"
M3 = "OWASP-M3: Insecure Communication"
M5 = "OWASP-M5: Insufficient Cryptography"
M9 = "OWASP-M9: Reverse Engineering"


@dataclass(frozen=True)
class RuleInfo:
    rule_id: str
    title: str
    category: str
    severity: str
    confidence: str
    owasp: str
    description: str
    impact: str
    remediation: str


MAN, SEC, NET = "MANIFEST_MISCONFIG", "HARDCODED_SECRET", "NETWORK_INDICATOR"
STO, CRY, SDK, PERM = "STORAGE_INSECURITY", "CRYPTO_FLAW", "TRACKING_SDK", "PERMISSION"

RULES: list[RuleInfo] = [
    RuleInfo("MAN-001", "Application Marked Debuggable", MAN, "HIGH", "HIGH", M1,
             "The manifest switches debugging on.", "A debugger can attach and read process memory.",
             "Ship release builds without the debuggable flag."),
    RuleInfo("MAN-002", "Application Data Backup Enabled", MAN, "MEDIUM", "HIGH", M2,
             "Application data may be copied by a device backup.", "Private files can leave the device without root.",
             "Disable backups or restrict them with extraction rules."),
    RuleInfo("MAN-003", "Cleartext HTTP Traffic Permitted", NET, "HIGH", "HIGH", M3,
             "Plain HTTP is allowed, explicitly or by an old target level.", "Traffic can be read on the network path.",
             "Forbid cleartext traffic and raise the target level."),
    RuleInfo("MAN-004", "Missing Custom Network Security Configuration", NET, "LOW", "MEDIUM", M3,
             "No network security configuration is declared.", "TLS rules per domain and pinning are not in force.",
             "Declare a network security configuration."),
    RuleInfo("MAN-005", "Exported Activity Without Permission Protection", MAN, "MEDIUM", "HIGH", M1,
             "An activity other than the launcher is open to every application.",
             "Other applications can start internal screens.", "Unexport the activity or require a permission."),
    RuleInfo("MAN-006", "Exported Service Without Permission Protection", MAN, "HIGH", "HIGH", M1,
             "A service is open to every application.", "Other applications can start or bind to it.",
             "Unexport the service or require a signature permission."),
    RuleInfo("MAN-007", "Exported Broadcast Receiver Without Permission Protection", MAN, "HIGH", "HIGH", M1,
             "A receiver is open to every application.", "Forged broadcasts can change application state.",
             "Unexport the receiver or require a permission."),
    RuleInfo("MAN-008", "Exported Content Provider Without Permission Protection", MAN, "CRITICAL", "HIGH", M2,
             "A content provider is open for reading and writing.", "Its records can be read or changed by anyone.",
             "Unexport the provider or require read and write permissions."),
    RuleInfo("MAN-009", "Sensitive Action Exposed on Unprotected Component", MAN, "HIGH", "MEDIUM", M1,
             "An open component answers actions with a sensitive name.", "Sensitive flows can be entered unauthenticated.",
             "Protect the component with a signature permission."),
    RuleInfo("MAN-010", "Sensitive Permission Combination (Exfiltration Vector Indicator)", PERM, "HIGH", "HIGH", M1,
             "Sensitive data access and Internet access are requested together.",
             "Data could be collected and sent; a static indicator only.", "Request only what core features need."),
    RuleInfo("SEC-001", "Hardcoded Google API Key", SEC, "HIGH", "HIGH", M9,
             "A Google API key is embedded.", "The key can be extracted and used.", "Restrict and rotate the key."),
    RuleInfo("SEC-002", "Hardcoded AWS Access Key", SEC, "CRITICAL", "HIGH", M9,
             "An AWS access key id is embedded.", "Cloud resources may be reachable with it.", "Rotate it; use short-lived credentials."),
    RuleInfo("SEC-003", "Hardcoded Service Token", SEC, "CRITICAL", "HIGH", M9,
             "A source-hosting or chat token is embedded.", "The account behind it can be used.", "Revoke the token."),
    RuleInfo("SEC-004", "Hardcoded Generic API Token", SEC, "HIGH", "MEDIUM", M9,
             "A high-entropy value is assigned to a token-like name.", "It may grant access to a service.", "Move it to a server-side store."),
    RuleInfo("SEC-005", "Hardcoded Password", SEC, "HIGH", "MEDIUM", M9,
             "A literal is assigned to a password-like name.", "The password can be extracted.", "Remove it and change the password."),
    RuleInfo("SEC-006", "Hardcoded OAuth Client Secret", SEC, "HIGH", "MEDIUM", M9,
             "An OAuth client secret is embedded.", "The client can be impersonated.", "Use a flow without a client secret."),
    RuleInfo("SEC-007", "Database Connection String With Credentials", SEC, "CRITICAL", "HIGH", M9,
             "A connection string carries user and password.", "The database may be reachable directly.", "Put a service in front; rotate the password."),
    RuleInfo("SEC-008", "Embedded Private Key", SEC, "CRITICAL", "HIGH", M9,
             "A PEM private key header is embedded.", "Signatures or sessions can be forged.", "Revoke the key pair."),
    RuleInfo("NET-001", "Hardcoded Cleartext HTTP URL", NET, "MEDIUM", "HIGH", M3,
             "A plain HTTP URL is embedded.", "Traffic to it can be read or altered.", "Use HTTPS."),
    RuleInfo("NET-002", "Cleartext Network Traffic Permitted", NET, "HIGH", "HIGH", M3,
             "Configuration allows plain HTTP.", "Traffic can be read on the network path.", "Forbid cleartext traffic."),
    RuleInfo("NET-003", "Trust-All X.509 Certificate Validation Pattern", NET, "HIGH", "HIGH", M3,
             "Certificate validation is switched off.", "Any certificate is accepted.", "Use the platform trust store."),
    RuleInfo("NET-004", "Permissive HostnameVerifier Pattern", NET, "HIGH", "HIGH", M3,
             "Every host name is accepted.", "A valid certificate of another host passes.", "Use the default verifier."),
    RuleInfo("NET-005", "SSL/TLS Certificate Validation Bypass Pattern", NET, "HIGH", "HIGH", M3,
             "TLS errors are ignored or a custom trust manager is set.", "Connections can be intercepted.", "Cancel on TLS errors."),
    RuleInfo("NET-006", "Insecure WebView Network Configuration", NET, "MEDIUM", "HIGH", M1,
             "A WebView setting weakens origin or transport checks.", "Local files or plain content may be loaded.", "Switch the setting off."),
    RuleInfo("NET-007", "Embedded Tracking or Advertising Endpoint", NET, "MEDIUM", "HIGH", M3,
             "A known tracking domain is embedded.", "Telemetry may be sent when contacted.", "Review against the privacy policy."),
    RuleInfo("NET-008", "Embedded Third-Party Endpoint", NET, "LOW", "MEDIUM", M3,
             "A third-party host is embedded.", "An external dependency to assess.", "Keep an inventory of endpoints."),
    RuleInfo("STO-001", "World-Readable or World-Writable Storage Mode", STO, "HIGH", "HIGH", M2,
             "A legacy world-accessible file mode is used.", "Other applications can read or write the file.", "Use the private mode."),
    RuleInfo("STO-002", "Sensitive Data Stored on External/Public Storage", STO, "HIGH", "HIGH", M2,
             "Public storage is used near a sensitive word.", "Other applications may read the data.", "Use internal storage."),
    RuleInfo("STO-003", "Plaintext SharedPreferences Storing Sensitive Data", STO, "MEDIUM", "HIGH", M2,
             "Preferences with a sensitive name are written in plain text.", "They can be read from a backup.", "Use encrypted preferences."),
    RuleInfo("STO-004", "Plaintext SQLite Database Schema with Sensitive Fields", STO, "HIGH", "HIGH", M2,
             "A table without encryption has a sensitive column.", "The database file can be read.", "Encrypt the database."),
    RuleInfo("STO-005", "Sensitive Data Logged to System Logs", STO, "MEDIUM", "HIGH", M2,
             "A log call names a sensitive value.", "Logs may reveal it.", "Remove it from release logs."),
    RuleInfo("STO-006", "Sensitive Data Stored in Temporary/Cache Directory", STO, "MEDIUM", "HIGH", M2,
             "A cache or temporary file is used near a sensitive word.", "Cached data may be read.", "Do not cache credentials."),
    RuleInfo("CRY-001", "Broken / Deprecated Cryptographic Algorithm", CRY, "HIGH", "HIGH", M5,
             "An outdated cipher is used.", "Encrypted data can be recovered.", "Use AES-GCM or ChaCha20-Poly1305."),
    RuleInfo("CRY-002", "Insecure ECB Cipher Mode", CRY, "HIGH", "HIGH", M5,
             "ECB mode is requested or implied.", "Patterns of the plain text survive.", "Name an authenticated mode."),
    RuleInfo("CRY-003", "Static or Weak Initialization Vector (IV)", CRY, "HIGH", "HIGH", M5,
             "An initialization vector is constant.", "Equal beginnings become visible.", "Draw a random vector each time."),
    RuleInfo("CRY-004", "Hardcoded Cryptographic Key in Code", CRY, "HIGH", "HIGH", M5,
             "A key is built from a constant.", "Data can be decrypted by anyone with the package.", "Use the platform key store."),
    RuleInfo("CRY-005", "Obsolete Hash Function in Security Context", CRY, "MEDIUM", "HIGH", M5,
             "MD5 or SHA-1 is used near a sensitive word.", "Collisions can be computed.", "Use SHA-256 or a password hash."),
    RuleInfo("CRY-006", "Insecure Random Number Generator or Static Seed", CRY, "HIGH", "HIGH", M5,
             "Random values are predictable.", "Keys or tokens can be guessed.", "Use SecureRandom without a fixed seed."),
    RuleInfo("SDK-001", "Third-Party SDK Identified", SDK, "INFO", "HIGH", M3,
             "A third-party library is present.", "It runs with the rights of the application.", "Review its data handling."),
    RuleInfo("SDK-002", "SDK Permission Exposure Indicator", SDK, "MEDIUM", "MEDIUM", M3,
             "A library could use a sensitive permission of its host.", "It could read that data.", "Restrict the library or the permission."),
]

INFO: dict[str, RuleInfo] = {r.rule_id: r for r in RULES}
ORDINAL: dict[str, int] = {r.rule_id: i + 1 for i, r in enumerate(RULES)}

# finding_seq = rule ordinal | target (63 bits) | pattern of the rule (8 bits) | match number (40 bits), as a decimal
# of 38 digits, which holds 122 bits: no field can run over, so every finding has a number of its own.
RULE_SHIFT, TARGET_SHIFT, PART_SHIFT = 111, 48, 40
SEQ = "decimal(38,0)"


def pack_seq(rule_ordinal: Column, target: Column, part: Column, pos: Column) -> Column:
    at = lambda value, shift: value.cast(SEQ) * F.lit(Decimal(2**shift)).cast(SEQ)
    return (at(rule_ordinal, RULE_SHIFT) + at(target, TARGET_SHIFT) + at(part, PART_SHIFT) + pos.cast(SEQ)).cast(SEQ)


def pack_row_seq(rule_ordinal: Column, row: Column) -> Column:
    """finding_seq of a rule with one finding for each row of a table."""
    return pack_seq(rule_ordinal, row, F.lit(0), F.lit(0))


def rule_column(rule_id: str, field: str) -> Column:
    """Metadata of a rule as a CASE over the fixed rule list."""
    if field == "ordinal":
        return literal_case(rule_id, ORDINAL, 0)
    return literal_case(rule_id, {r.rule_id: getattr(r, field) for r in RULES}, None)


def with_prose(findings: DataFrame) -> DataFrame:
    """Add description, impact, remediation and reference by rule id.

    Kept out of the scan: the long texts would travel through every shuffle.
    """
    return findings.select(
        "*",
        F.coalesce(rule_column("rule_id", "description"), F.lit("")).alias("description"),
        rule_column("rule_id", "impact").alias("impact"),
        rule_column("rule_id", "remediation").alias("remediation"),
        rule_column("rule_id", "owasp").alias("owasp_reference"),
        F.lit(True).alias("is_static_indicator"),
    )
