"""URL expressions used by the network rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# URL shape and the characters trimmed from its end.
URL_PATTERN = r"(?i)\bhttps?://[a-zA-Z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>`\[\]{}|\\^]*)?"
URL_TRAILING = ".,;:)\"'>`];{}"

# Identifier domains that are not network targets.
SCHEMA_DOMAINS = [
    "schemas.android.com",
    "www.w3.org",
    "w3.org",
    "apache.org",
    "www.apache.org",
    "xml.org",
    "json-schema.org",
    "schemas.xmlsoap.org",
    "java.sun.com",
    "xmlns.jcp.org",
    "oasis-open.org",
]
SCHEMA_PATHS = [
    "/apk/res/android",
    "/apk/res-auto",
    "/apk/res/",
    "/apk/distribution",
    "/tools",
    "/xmlns",
]
# Loopback and test hosts.
TEST_HOSTS = [
    "localhost",
    "127.0.0.1",
    "10.0.2.2",
    "0.0.0.0",
    "::1",
    "example.com",
    "example.org",
    "example.net",
    "sample.com",
    "test.com",
    "placeholder.com",
]
TEST_SUFFIXES = [".localhost", ".test", ".example", ".invalid", ".local"]
# Platform domains.
PLATFORM_DOMAINS = [
    "android.com",
    "google.com",
    "googleapis.com",
    "gstatic.com",
    "play.google.com",
    "android.googlesource.com",
]
# Package labels too common to identify a first party.
GENERIC_LABELS = ["com", "org", "net", "io", "app", "dev", "co", "uk", "de", "fr", "android"]


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0))


def clean_url(url: Column) -> Column:
    return F.rtrim(url, F.lit(URL_TRAILING))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/:?#]*)", 1))


def url_path(url: Column) -> Column:
    """Path without query, fragment and the parameters of its last segment."""
    raw = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def in_domains(host: Column, domains: list[str]) -> Column:
    """Host equals one of the domains or is below it; one literal pattern."""
    return host.rlike(r"^(?:.*\.)?(?:" + "|".join(re.escape(d) for d in domains) + r")$")


def is_schema_url(url: Column, host: Column) -> Column:
    test = in_domains(host, SCHEMA_DOMAINS)
    for part in SCHEMA_PATHS:
        test = test | F.contains(F.lower(url), F.lit(part))
    return test


def is_test_host(host: Column) -> Column:
    test = host.isin(TEST_HOSTS)
    for suffix in TEST_SUFFIXES:
        test = test | F.endswith(host, F.lit(suffix))
    return test


def is_platform_host(host: Column) -> Column:
    return in_domains(host, PLATFORM_DOMAINS)


def first_party_tokens(package: Column) -> Column:
    labels = F.split(F.lower(F.coalesce(package, F.lit(""))), r"\.")
    return F.array_distinct(
        F.filter(labels, lambda p: (F.length(p) >= 4) & ~p.isin(GENERIC_LABELS))
    )


def is_first_party(host: Column, package: Column) -> Column:
    return F.exists(first_party_tokens(package), lambda t: F.contains(host, t))
