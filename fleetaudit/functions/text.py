"""String expressions: trimming, redaction, entropy, placeholders, lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Characters removed by `strip` (ASCII white space and separators).
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"

# Line boundaries: CR LF as one, then every single-character boundary.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"

CONTROL_CHARS = r"[\x00-\x1f\x7f-\x9f]"

MASK = "********"

# Substrings that mark a value as a sample.
PLACEHOLDER_SUBSTRINGS = [
    "example",
    "placeholder",
    "insert_here",
    "insert_your",
    "your_key",
    "your_api_key",
    "your_token",
    "your_secret",
    "api_key_here",
    "change_me",
    "test_key",
    "test_secret",
    "fake_key",
    "fake_secret",
    "sample_key",
    "sample_secret",
    "dummy",
    "secret_here",
    "my_secret",
    "foobar",
    "1234567890",
    "abcdef123456",
    "null",
    "undefined",
    "00000000",
    "xxxxxxxx",
]
# Patterns that mark a value as a sample.  A run of one repeated
# character needs no pattern: the distinct-character test below covers it.
PLACEHOLDER_PATTERNS = [
    r"^(your|my|test|sample|dummy|demo|fake)[-_]?(api|key|secret|token|password)",
    r"insert[-_]?your",
]

# Token shapes; prefix and suffix characters kept by redaction.
GOOGLE_KEY = r"AIza[0-9A-Za-z\-_]{30,45}"
AWS_KEY = r"AKIA[0-9A-Z]{16}"
GITHUB_TOKEN = r"gh[pousr]_[A-Za-z0-9_]{36,120}"
SLACK_TOKEN = r"xox[baprs]-[0-9a-zA-Z-]{24,80}"
TOKEN_MASKS = [
    r"(AIza[0-9A-Za-z\-_]{4})[0-9A-Za-z\-_]{23,38}([0-9A-Za-z\-_]{3})",
    r"(AKIA[0-9A-Z]{2})[0-9A-Z]{12}([0-9A-Z]{2})",
    r"(gh[pousr]_[A-Za-z0-9_]{2})[A-Za-z0-9_]{31,115}([A-Za-z0-9_]{3})",
    r"(xox[baprs]-[0-9a-zA-Z-]{1})[0-9a-zA-Z-]{20,76}([0-9a-zA-Z-]{3})",
]
KEY_VALUE_HEAD = r"(?i)(password|secret|token|api_key|client_secret)\s*([=:])\s*([\"']?)"
LOG_PATTERNS = [
    GOOGLE_KEY,
    AWS_KEY,
    GITHUB_TOKEN,
    SLACK_TOKEN,
    r"(?i)(password|secret|token|api_key|apikey)\s*[=:]\s*([^\s,;]+)",
]
REDACTED = "[REDACTED_SECRET]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def contains_any(c: Column, words: list[str]) -> Column:
    """True when `c` contains one of a plan-time list of plain substrings."""
    test = F.lit(False)
    for w in words:
        test = test | F.contains(c, F.lit(w))
    return test


def sql_contains_any(column: str, words: list[str]) -> str:
    """The same test as SQL text on a named column, for plans with many gates."""
    quoted = [w.replace("\\", "\\\\").replace("'", "\\'") for w in words]
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in quoted) + ")"


def literal_forms(pattern: str) -> list[str] | None:
    """Plain strings one of which every match contains, for patterns made of
    literals and at most one group of literal alternatives; else None."""
    literal = r"(?:\\.|[^\\()\[\]{}|*+?^$])*"
    m = re.fullmatch(rf"({literal})(?:\((?:\?:)?((?:{literal}\|)*{literal})\))?({literal})", pattern)
    if m is None:
        return None
    plain = lambda s: re.sub(r"\\(.)", r"\1", s)
    if re.search(r"(?<!\\)\.|\\[a-zA-Z0-9]", pattern):
        return None
    return [plain(m[1] + alt + m[3]) for alt in (m[2] or "").split("|")]


def alternation(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL_CHARS, "")


def escape_controls(c: Column) -> Column:
    """One-line form of a log message: CR and LF escaped, other controls as \\xHH."""
    out = F.replace(F.replace(c, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    masked = out
    for code in [*range(0x00, 0x09), *range(0x0B, 0x20), 0x7F]:
        masked = F.replace(masked, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    needs = out.rlike(r"[\x00-\x08\x0b-\x1f\x7f]")
    return F.coalesce(F.when(needs, masked).otherwise(out), F.lit(""))


def distinct_chars(c: Column) -> Column:
    return F.array_distinct(F.split(c, ""))


def shannon_entropy(c: Column) -> Column:
    """Bits per character; meant for short token candidates, not whole texts."""
    n = F.length(c).cast("double")

    def add(acc: Column, ch: Column) -> Column:
        p = (F.length(c) - F.length(F.replace(c, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    total = F.aggregate(distinct_chars(c), F.lit(0.0), add)
    return F.when(F.length(c) > 0, total).otherwise(F.lit(0.0))


def is_placeholder(c: Column) -> Column:
    v = F.lower(strip(c))
    return (
        (F.length(v) < 8)
        | v.rlike(alternation(PLACEHOLDER_SUBSTRINGS))
        | v.rlike("|".join(PLACEHOLDER_PATTERNS))
        | (F.size(distinct_chars(v)) <= 2)
    )


def redact_secret(c: Column, prefix: int | Column = 8, suffix: int | Column = 3) -> Column:
    """Mask a value, keeping its ends: all of six characters or fewer, two and two of a short one."""
    v = strip(c)
    n = F.length(v)
    col = lambda k: F.lit(k) if isinstance(k, int) else k
    keep = lambda p, s: F.concat(F.left(v, col(p)), F.lit(MASK), F.right(v, col(s)))
    short = F.when(n <= 6, F.lit(MASK)).otherwise(keep(2, 2))
    return (
        F.when(F.length(F.coalesce(c, F.lit(""))) == 0, F.lit(""))
        .when(n <= col(prefix) + col(suffix), short)
        .otherwise(keep(prefix, suffix))
    )


def redact_text(c: Column) -> Column:
    """Mask token shapes, then the values of key=value pairs, in free text.

    Values of five or more characters keep two at each end and are masked first;
    the second pass takes the shorter ones whole, so a mask is never matched.
    """
    out = c
    for pattern in TOKEN_MASKS:
        out = F.regexp_replace(out, pattern, "$1" + MASK + "$2")
    v = r"[^\"'\s,;]"
    out = F.regexp_replace(out, KEY_VALUE_HEAD + f"({v}{{2}}){v}+({v}{{2}})", "$1$2$3$4" + MASK + "$5")
    out = F.regexp_replace(out, KEY_VALUE_HEAD + f"{v}{{1,4}}(?!{v})", "$1$2$3" + MASK)
    return F.coalesce(out, F.lit(""))


def redact_for_log(c: Column) -> Column:
    out = c
    for pattern in LOG_PATTERNS:
        out = F.regexp_replace(out, pattern, REDACTED)
    return F.coalesce(out, F.lit(""))


# ASCII characters that are neither letters nor digits.
_MARKS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def normalize_name(c: Column) -> Column:
    """Finding title reduced to lower-case words separated by one blank."""
    low = F.lower(c)
    # Plain ASCII, nearly every title, takes no regular expression: no mark is left, so "<>" stands for a blank and
    # "><", where two of them meet, goes.
    blank = F.replace(F.translate(low, _MARKS, " " * len(_MARKS)), F.lit(" "), F.lit("<>"))
    plain = F.replace(F.replace(blank, F.lit("><"), F.lit("")), F.lit("<>"), F.lit(" "))
    words = F.when(F.octet_length(low) == F.length(low), plain).otherwise(F.regexp_replace(low, "[^a-zA-Z0-9]+", " "))
    return F.coalesce(F.trim(words), F.lit(""))


def neutralize_formula(c: Column) -> Column:
    """Prefix a quote when a spreadsheet would read the cell as a formula."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    risky = F.substring(v, 1, 1).isin("=", "+", "-", "@", "\t", "\r")
    return F.when(risky, F.concat(F.lit("'"), v)).otherwise(v)


def printable_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\x20-\x7E]{4,}"), F.lit(0))


def simple_name(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def numbered_lines(c: Column) -> Column:
    """Lines as an array without the empty piece after a final line break."""
    ls = lines(c)
    last = F.element_at(ls, -1)
    return F.when(last == "", F.slice(ls, 1, F.size(ls) - 1)).otherwise(ls)
