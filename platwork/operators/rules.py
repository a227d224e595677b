"""Validation and transformation rules held as data, compiled to column expressions.

Rule tables are metadata, written by people: they are read once and become part of the plan; the
records they apply to never leave the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platwork.operators.clean import blank
from platwork.operators.shape import field
from platwork.operators.validate import append_errors

Rules = DataFrame | Iterable[Mapping[str, Any]]


def read_rules(rules: Rules, import_type: str, order: list[str]) -> list[dict[str, Any]]:
    """Active rules of an import type in ``order``."""
    if isinstance(rules, DataFrame):
        active = rules.filter((F.col("ImportType") == import_type) & F.col("IsActive").cast("boolean"))
        rows = [r.asDict() for r in active.toLocalIterator()]
    else:
        rows = [dict(r) for r in rules if r["ImportType"] == import_type and r.get("IsActive", True)]
    return sorted(rows, key=lambda r: tuple(r[c] for c in order))


def _violated(rule: Mapping[str, Any]) -> Column:
    c, kind = field(rule["FieldName"]), rule["RuleType"]
    config = json.loads(rule.get("RuleConfig") or "{}")
    if kind == "Required":
        return blank(c.cast("string"))
    if kind == "Format":
        return ~blank(c.cast("string")) & ~c.cast("string").rlike(config["pattern"])
    if kind == "Range":
        number = c.cast("string").try_cast("double")
        outside = F.lit(False)
        if config.get("min") is not None:
            outside = outside | (number < F.lit(float(config["min"])))
        if config.get("max") is not None:
            outside = outside | (number > F.lit(float(config["max"])))
        return outside
    if kind == "Custom":
        # The expression states what a good record satisfies; null counts as not satisfied.
        return ~F.coalesce(F.expr(config["expression"]), F.lit(False))
    raise ValueError(f"Unsupported validation rule type: {kind}")


def apply_validation_rules(df: DataFrame, rules: Rules, import_type: str) -> DataFrame:
    """Append the message of every active rule a record breaks, in rule-id order.

    ``Required`` wants a value, ``Format`` a regular expression (config ``pattern``), ``Range``
    bounds (config ``min``/``max``), ``Custom`` a SQL condition (config ``expression``). Rules of
    absent columns are skipped.
    """
    compiled = [
        (rule["FieldName"], _violated(rule), rule["ErrorMessage"])
        for rule in read_rules(rules, import_type, ["ValidationRuleID"])
        if rule["FieldName"] in df.columns
    ]
    return append_errors(df, compiled)


def _transformed(rule: Mapping[str, Any]) -> Column:
    c, kind, logic = field(rule["FieldName"]), rule["RuleType"], rule["TransformationLogic"]
    if kind == "Mapping":
        pairs = json.loads(logic)
        table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
        return F.coalesce(F.try_element_at(table, c.cast("string")), c.cast("string"))
    if kind == "Format":
        config = json.loads(logic)
        return F.regexp_replace(c.cast("string"), config["pattern"], config["replacement"])
    if kind in ("Calculate", "Custom"):
        return F.expr(logic)
    raise ValueError(f"Unsupported transformation rule type: {kind}")


def apply_transformation_rules(df: DataFrame, rules: Rules, import_type: str) -> DataFrame:
    """Apply active rules in execution order; each sees the result of the ones before it.

    ``Mapping`` looks the value up in a JSON object, ``Format`` replaces a regular expression,
    ``Calculate`` and ``Custom`` are SQL expressions and may create their column.
    """
    for rule in read_rules(rules, import_type, ["ExecutionOrder", "TransformationRuleID"]):
        if rule["FieldName"] in df.columns or rule["RuleType"] in ("Calculate", "Custom"):
            df = df.withColumn(rule["FieldName"], _transformed(rule))
    return df
