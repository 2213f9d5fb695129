"""Rule registry and user rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ...functions.text import redact_for_log
from ...session import work_dir
from . import manifest, sdk, text_scan
from .catalog import RULES

USER_SCHEMA = (
    "app_id string, target_seq bigint, position int, rule_id string, title string, category string, "
    "severity string, confidence string, evidence string, location string, error string"
)
# User rules follow the built-in ones in discovery order.
USER_RULE_BASE = 1000


@dataclass
class Inputs:
    """The tables rules read; a missing one simply yields nothing."""

    apps: DataFrame | None = None
    components: DataFrame | None = None
    permissions: DataFrame | None = None
    artifacts: DataFrame | None = None
    candidates: DataFrame | None = None
    sdk_catalog: list[tuple] | None = None
    tracking_catalog: list[tuple] | None = None


@dataclass
class Rule:
    """A rule: metadata plus one way to evaluate it.

    `apply` builds a findings DataFrame from the inputs (Column expressions, runs in
    the JVM).  `evaluate` is a Python function called for each text target with
    (app_id, location, text); it yields dicts with `evidence` and optionally `title`,
    `severity`, `confidence`, `location`.  Built-in rules have neither: their family
    evaluates them together.
    """

    rule_id: str
    title: str
    category: str
    severity: str = "MEDIUM"
    confidence: str = "HIGH"
    apply: Callable[[Inputs], DataFrame] | None = None
    evaluate: Callable[[str, str, str], Iterable[dict]] | None = field(default=None)
    enabled: bool = True


# Categories that a stage-routed registry evaluates, in stage order.
STAGE_CATEGORIES = [
    "MANIFEST_MISCONFIG",
    "HARDCODED_SECRET",
    "NETWORK_INDICATOR",
    "STORAGE_INSECURITY",
    "CRYPTO_FLAW",
    "TRACKING_SDK",
]


def python_rule_rows(artifacts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Evaluate Python rules target by target; an exception becomes a row with `error`.

    Targets are independent rows of a map, so neither a large application nor a
    failing rule holds up or ends a task.
    """
    specs = [(r.rule_id, r.title, r.category, r.severity, r.confidence, r.evaluate) for r in rules]
    columns = [c.split()[0] for c in USER_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for app, seq, loc, text in zip(pdf["app_id"], pdf["target_seq"], pdf["location"], pdf["text"]):
                for rid, title, cat, sev, conf, evaluate in specs:
                    try:
                        found = list(evaluate(app, loc, text))
                        rows += [
                            (app, seq, i, rid, f.get("title", title), f.get("category", cat), f.get("severity", sev),
                             f.get("confidence", conf), f.get("evidence"), f.get("location", loc), None)
                            for i, f in enumerate(found)
                        ]
                    except Exception as exc:
                        rows.append((app, seq, 0, rid, title, cat, sev, conf, None, loc, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=columns)

    rows = artifacts.select("app_id", "target_seq", "location", "text").mapInPandas(run, USER_SCHEMA)
    return rows.withColumn("error", F.when(F.col("error").isNotNull(), redact_for_log(F.col("error"))))


class RuleRegistry:
    """Plan-time dictionary of rules; the last registration of an id wins."""

    def __init__(self, builtin: bool = True) -> None:
        self._rules: dict[str, Rule] = {}
        if builtin:
            for r in RULES:
                self.register(Rule(r.rule_id, r.title, r.category, r.severity, r.confidence))

    def register(self, rule: Rule) -> None:
        self._rules[rule.rule_id] = rule

    def unregister(self, rule_id: str) -> bool:
        return self._rules.pop(rule_id, None) is not None

    def get(self, rule_id: str) -> Rule | None:
        return self._rules.get(rule_id)

    def all(self) -> list[Rule]:
        return list(self._rules.values())

    def enabled(self) -> list[Rule]:
        return [r for r in self._rules.values() if r.enabled]

    def set_enabled(self, rule_id: str, on: bool) -> bool:
        rule = self._rules.get(rule_id)
        if rule is not None:
            rule.enabled = on
        return rule is not None

    def enable(self, rule_id: str) -> bool:
        return self.set_enabled(rule_id, True)

    def disable(self, rule_id: str) -> bool:
        return self.set_enabled(rule_id, False)

    def routed(self, by_stage: bool) -> list[Rule]:
        """Enabled rules; with stage routing, rules of other categories (PERMISSION) drop out."""
        rules = self.enabled()
        return [r for r in rules if r.category in STAGE_CATEGORIES] if by_stage else rules

    def user_rows(self, inputs: Inputs, folder: str) -> DataFrame:
        """What the enabled Python rules found or raised, evaluated once and stored in `folder`.

        Hand it to `run` and `errors`.
        """
        rules = [r for r in self.enabled() if r.evaluate is not None]
        python_rule_rows(inputs.artifacts, rules).write.mode("overwrite").parquet(folder)
        return inputs.artifacts.sparkSession.read.schema(USER_SCHEMA).parquet(folder)

    def run(self, inputs: Inputs, by_stage: bool = False, user_rows: DataFrame | None = None) -> DataFrame:
        """Findings of all enabled rules as one DataFrame (not yet deduplicated).

        A Python rule that raised for an application yields nothing for it.  Its rows come
        from `user_rows`; without them they are stored in a new folder of the session.
        """
        rules = self.routed(by_stage)
        native = [r.rule_id for r in rules if r.apply is None and r.evaluate is None]
        parts = [r.apply(inputs) for r in rules if r.apply is not None]
        man = [r for r in native if r.startswith("MAN-")]
        if man and (inputs.apps is not None or inputs.components is not None or inputs.permissions is not None):
            tables = {
                "apps": inputs.apps if set(man) & {"MAN-001", "MAN-002", "MAN-003", "MAN-004"} else None,
                "components": inputs.components if set(man) & {f"MAN-00{i}" for i in range(5, 10)} else None,
                "permissions": inputs.permissions if "MAN-010" in man else None,
            }
            if any(t is not None for t in tables.values()):
                parts.append(manifest.manifest_findings(**tables, rules=man))
        text = [r for r in native if r[:3] in ("SEC", "NET", "STO", "CRY")]
        if text and inputs.artifacts is not None:
            parts.append(text_scan.text_findings(inputs.artifacts, text, inputs.apps, inputs.tracking_catalog))
        if "NET-002" in native and inputs.apps is not None:
            parts.append(manifest.manifest_cleartext(inputs.apps))
        if inputs.candidates is not None and {"SDK-001", "SDK-002"} & set(native):
            found = sdk.detected_sdks(inputs.candidates, inputs.sdk_catalog)
            if {"SDK-001", "SDK-002"} <= set(native) and inputs.permissions is not None:
                parts.append(sdk.all_sdk_findings(found, inputs.permissions, inputs.sdk_catalog))
            elif "SDK-001" in native:
                parts.append(sdk.sdk_findings(found, inputs.sdk_catalog))
            elif inputs.permissions is not None:
                parts.append(sdk.exposure_findings(found, inputs.permissions, inputs.sdk_catalog))
        user = [r for r in rules if r.evaluate is not None]
        if user and inputs.artifacts is not None:
            if user_rows is None:
                user_rows = self.user_rows(inputs, work_dir(inputs.artifacts.sparkSession))
            parts.append(self._user_findings(user_rows, user))
        return reduce(DataFrame.unionByName, parts)

    def _user_findings(self, rows: DataFrame, rules: list[Rule]) -> DataFrame:
        from ...functions.classify import literal_case
        from .catalog import pack_seq

        order = {r.rule_id: USER_RULE_BASE + i for i, r in enumerate(rules)}
        failed = rows.where("error IS NOT NULL").select("app_id", "rule_id").distinct()
        rows = rows.where(F.col("rule_id").isin(list(order))).join(failed, ["app_id", "rule_id"], "left_anti")
        seq = pack_seq(literal_case("rule_id", order, 0), F.col("target_seq"), F.lit(0), F.col("position"))
        return rows.select("app_id", seq.alias("finding_seq"), "rule_id", "title", "category", "severity",
                           "confidence", "evidence", "location")

    def errors(self, rows: DataFrame | Inputs) -> DataFrame:
        """(app_id, rule_id, location, error) of user rules that raised.

        Takes the table of `user_rows`; from inputs the rules are evaluated for this call.
        """
        if isinstance(rows, Inputs):
            rows = self.user_rows(rows, work_dir(rows.artifacts.sparkSession))
        return rows.where("error IS NOT NULL").select("app_id", "rule_id", "location", "error")
