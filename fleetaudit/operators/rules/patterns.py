"""Detection patterns of the text rules.

Fixed values: each pattern is part of the meaning of its rule.  All of them are
literal, so Spark compiles each once per task.  `gate` is a plain substring that
every match must contain; it keeps the regular expression away from most rows.
"""

from __future__ import annotations

from ...functions import text as tx

# Sensitive identifiers shared by the storage rules.
SENSITIVE_WORD = (
    r"(?i)(?:password|passwd|secret|token|auth_token|authtoken|credential|cred|pin|ssn"
    r"|credit_card|cvv|private_key|privkey|bank_account|auth\b)"
)

# Network rules.
CLEARTEXT_CONFIG = r"(?i)cleartextTrafficPermitted\s*=\s*[\"']true[\"']"
EMPTY_SERVER_CHECK = (
    # Whole comment lines are possessive: giving them back one by one recurses once a line.
    r"void\s+checkServerTrusted\s*\([^)]*\)\s*\{\s*(?:"
    r"(?://[^\n]*\n\s*|/\*[^\n]*?\*/\s*)*+(?://[^\n]*)?\}"
    r"|(?://[^\n}]*\n\s*|/\*[^\n]*?\*/\s*)*+//[^\n]*\})"
)
SMALI_SERVER_CHECK = (
    r"\.method\s+[^\n]*checkServerTrusted[^\n]*\n(?:\s*\.[a-zA-Z0-9_-]+[^\n]*\n)*+"
    r"\s*return-void\s*\n\s*\.end\s+method"
)
TRUST_ALL_CLASS = (
    r"\b(?:TrustAll(?:Trust)?Manager|TrustAllCertificates|TrustAllSSLSocketFactory"
    r"|NaiveTrustManager|InsecureTrustManager)\b"
)
VERIFIER_CONSTANT = r"\b(?:ALLOW_ALL_HOSTNAME_VERIFIER|AllowAllHostnameVerifier|NullHostnameVerifier)\b"
VERIFY_TRUE = r"boolean\s+verify\s*\([^)]*\)\s*\{\s*return\s+true\s*;?\s*\}"
LAMBDA_TRUE = r"\(\s*[a-zA-Z0-9_]+\s*,\s*[a-zA-Z0-9_]+\s*\)\s*->\s*true"
SSL_PROCEED = r"onReceivedSslError\s*\([^)]*\)\s*\{[^}]*\bhandler\.proceed\(\)"
SSL_CONTEXT = (
    r"(?:SSLContext\b[^\n;]*|\b[a-zA-Z0-9_]+)\.init\s*\(\s*null\s*,\s*new\s+TrustManager\[\]"
)
WEBVIEW_SETTINGS = [
    ("WebView Universal File Access Enabled", "setAllowUniversalAccessFromFileURLs",
     r"setAllowUniversalAccessFromFileURLs\s*\(\s*true\s*\)"),
    ("WebView File Access from File URLs Enabled", "setAllowFileAccessFromFileURLs",
     r"setAllowFileAccessFromFileURLs\s*\(\s*true\s*\)"),
    ("WebView Mixed Content Allowed", "setMixedContentMode",
     r"setMixedContentMode\s*\(\s*(?:WebSettings\.MIXED_CONTENT_ALWAYS_ALLOW|0)\s*\)"),
]

# Storage rules.
WORLD_MODE = r"\b(?:Context\.)?MODE_WORLD_(?:READABLE|WRITEABLE)\b"
WORLD_MODE_NUMBER = (
    r"\b(?:openFileOutput|getSharedPreferences|openOrCreateDatabase)\s*\([^,]+,\s*([12])\s*\)"
)
EXTERNAL_STORAGE = (
    r"(?:Environment\.getExternalStorageDirectory\(\)"
    r"|Environment\.getExternalStoragePublicDirectory\([^)]*\)"
    r"|(?:Context\.)?getExternalFilesDir\([^)]*\)"
    r"|(?:Context\.)?getExternalCacheDir\(\)"
    r"|[\"']/sdcard/)"
)
EXTERNAL_STORAGE_GATES = ["getExternal", "/sdcard/"]
PREFERENCE_PUT = (
    r"(?i)\b(?:editor|sp|pref|preferences)\.put(?:String|Int|Long|Float|Boolean)"
    r"\s*\(\s*[\"']([^\"']*)[\"']"
)
PREFERENCE_FILE = (
    r"(?i)getSharedPreferences\s*\(\s*[\"']"
    r"([^\"']*(?:password|token|auth|cred|secret|account|session)[^\"']*)[\"']"
)
ENCRYPTED_PREFERENCE_MARKS = ["EncryptedSharedPreferences", "MasterKey"]
CREATE_TABLE = r"(?i)CREATE\s+TABLE\s+[^(]+\(([^)]+)\)"
CIPHER_DATABASE_MARKS = ["net.sqlcipher", "SQLCipher", "SQLiteDatabaseHook"]
LOG_CALL = (
    r"(?i)\b(?:Log\.[dview]|System\.(?:out|err)\.println)\s*\(\s*(?:[^,]+,\s*)?([^)]+)\)"
)
CACHE_STORAGE = r"(?:getCacheDir\(\)|getExternalCacheDir\(\)|File\.createTempFile\([^)]*\))"
CACHE_STORAGE_GATES = ["CacheDir()", "File.createTempFile("]

# Crypto rules.
BROKEN_CIPHERS = [
    ("DES", r"(?i)Cipher\.getInstance\s*\(\s*[\"']DES(?:/[^\"']*)?[\"']\)"),
    ("3DES / TripleDES", r"(?i)Cipher\.getInstance\s*\(\s*[\"'](?:DESede|TripleDES)(?:/[^\"']*)?[\"']\)"),
    ("RC4 / ARCFOUR", r"(?i)Cipher\.getInstance\s*\(\s*[\"'](?:RC4|ARC4|ARCFOUR)(?:/[^\"']*)?[\"']\)"),
    ("Blowfish", r"(?i)Cipher\.getInstance\s*\(\s*[\"']Blowfish(?:/[^\"']*)?[\"']\)"),
]
EXPLICIT_ECB = r"(?i)Cipher\.getInstance\s*\(\s*[\"'][^\"']*/ECB/[^\"']*[\"']\)"
BARE_AES = r"Cipher\.getInstance\s*\(\s*[\"']AES[\"']\)"
INLINE_IV = (
    r"new\s+IvParameterSpec\s*\(\s*(?:[\"'][^\"']+[\"']\.getBytes\(\)"
    r"|new\s+byte\[\]\s*\{[^}]+\}|new\s+byte\[\s*(?:8|12|16)\s*\])\s*\)"
)
ZERO_IV = (
    r"byte\[\]\s+([a-zA-Z0-9_]+)\s*=\s*new\s+byte\[\s*(?:8|12|16)\s*\];"
    r"[\s\S]{0,150}?\bnew\s+IvParameterSpec\s*\(\s*\1\s*\)"
)
KEY_SPEC = (
    r"new\s+SecretKeySpec\s*\(\s*(?:[\"']([^\"']{8,})[\"']\.getBytes\(\)"
    r"|new\s+byte\[\]\s*\{([^}]{16,})\})\s*,\s*[\"']([^\"']+)[\"']\s*\)"
)
HASH_CALL = r"(?i)MessageDigest\.getInstance\s*\(\s*[\"'](MD5|SHA-1|SHA1)[\"']\s*\)"
# Words that make a hash security relevant, alphabetical so the
# first one found is well defined.
HASH_CONTEXT_WORDS = [
    "auth", "cred", "credential", "login", "passwd", "password",
    "pin", "private", "secret", "sign", "signature", "token",
]
SET_SEED = r"\b[a-zA-Z0-9_]+\.setSeed\s*\([^)]+\)"
UTIL_RANDOM = (
    r"(?i)new\s+Random\s*\(\s*\)[^;]*(?:nextBytes|nextInt)[^;]*(?:key|token|iv|secret|password)"
)

# Secret rules: our own shapes around the shared token patterns.
GOOGLE_KEY, AWS_KEY = tx.GOOGLE_KEY, tx.AWS_KEY
GITHUB_TOKEN, SLACK_TOKEN = tx.GITHUB_TOKEN, tx.SLACK_TOKEN
TOKEN_ASSIGNMENT = (
    r"(?i)\b(?:api_?key|auth_?token|access_?token|secret_?key|token|secret)\b"
    r"\s*[=:]\s*[\"']([A-Za-z0-9_.+/=-]{16,})[\"']"
)
PASSWORD_ASSIGNMENT = r"(?i)\b(?:password|passwd|pwd)\s*[=:]\s*[\"']([^\"'\r\n]{8,})[\"']"
CLIENT_SECRET = r"(?i)\bclient_?secret\b\s*[=:]\s*[\"']([A-Za-z0-9_.~-]{16,})[\"']"
CONNECTION_STRING = (
    r"(?i)\b(?:mysql|postgres|postgresql|mongodb|redis|amqp|sqlserver)://"
    r"[^\s:@/\"']+:([^\s@/\"']+)@[^\s\"'<>]+"
)
PRIVATE_KEY = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"
