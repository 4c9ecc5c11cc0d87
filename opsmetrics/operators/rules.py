"""Ordered rule tables turned into column expressions, and threshold checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col

# Request path classes, first match wins; ``*`` stands for any text.
URL_RULES: list[tuple[str, str]] = [
    ("metrics", "/controller/instance/*/metrics*"),
    ("configreg", "/controller/instance/0/applicationConfiguration*"),
    ("configuration", "/controller/instance/*/applicationConfiguration*"),
    ("dbmon", "/controller/instance/*/registerDB*"),
    ("dbmon", "/controller/instance/*/registerSQL*"),
    ("dbmon", "/controller/instance/*/writeQueryStats*"),
    ("dbmon", "/controller/instance/*/collectWaitTimes*"),
    ("dbmon", "/controller/instance/*/db-monitor-config*"),
    ("agent", "/controller/instance/*"),
    ("other", "/controller/sim/*/user*"),
    ("agent", "/controller/sim/*"),
    ("analyticsui", "/controller/restui/analytics/*"),
    ("restapi", "/controller/rest/applications*"),
    ("entitysearch", "/controller/restui/entity/search*"),
    ("ajax", "/controller/restui/dashboards/*"),
    ("ajax", "/controller/restui/events/*"),
    ("ajax", "/controller/restui/warrooms/*"),
    ("status", "/controller/rest/serverstatus"),
]

# Host limits, each with the smallest acceptable value.
HOST_LIMITS: list[tuple[str, int, str]] = [
    ("open files", 100000, "not enough open files = %d"),
    ("processes", 8192, "not enough processes = %d"),
    ("swap", 10000, "not enough swap space = %d"),
    ("free swap", 4000, "not enough free swap space = %d"),
]


def glob_regex(pattern: str) -> str:
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def first_match(rules: list[tuple[str, Column]], default: str | None) -> Column:
    """The label of the first condition that holds."""
    out = None
    for label, condition in rules:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def url_class(path: Column | str, rules: list[tuple[str, str]] = URL_RULES, default: str = "other") -> Column:
    """Traffic class of a request path; a query string takes part in the match."""
    p = _col(path)
    return first_match([(label, p.rlike(glob_regex(g))) for label, g in rules], default)


def threshold_rules(spark, limits: list[tuple[str, int, str]] = HOST_LIMITS) -> DataFrame:
    return spark.createDataFrame(limits, "name string, minimum bigint, message string")


def threshold_violations(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """Readings (.., name, value) below their rule's minimum, with the message filled in."""
    return (
        readings.join(rules, "name").filter(F.col("value") < F.col("minimum"))
        .withColumn("message", F.replace("message", F.lit("%d"), F.col("value").cast("string")))
    )
