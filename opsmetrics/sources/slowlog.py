"""Metric-insert statements in a database's slow-query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import number, unix_lines, whole
from ..functions.time import ntz_in_zone
from ..operators.bursts import burst_numbers
from .files import carried, without_overlap

RECORD_SEP = "# User@Host: "  # fixed value: begins every record
# Statement forms of a metric insert, across versions.
INSERT_PATTERNS = [
    r"LOAD DATA CONCURRENT LOCAL INFILE .dummy.txt. IGNORE INTO TABLE metricdata_min FIELDS",
    r".. .. LOAD DATA CONCURRENT LOCAL INFILE .dummy.txt. IGNORE INTO TABLE metricdata_min FIELDS",
    r"INSERT IGNORE INTO metricdata_min\s+SELECT",
]


def parse_mysql_slow_log(df: DataFrame, patterns: list[str] = INSERT_PATTERNS) -> DataFrame:
    """Every matching statement: (provenance, epoch, query_tm, lock_tm, rows).

    ``value`` is a record or a file; a record may hold several statements.
    """
    keep = carried(df)
    # one piece for each header: what follows its first label, up to the next one
    pieces = F.split("__record", "# Query_time: ")
    headed = (
        df.select(*keep, F.explode(F.split(unix_lines("value"), RECORD_SEP)).alias("__record"))
        .select(*keep, F.explode(F.slice(pieces, F.lit(2), F.size(pieces))).alias("__piece"))
    )

    def after(label: str, text: str = "__piece"):
        """What follows a label's first place; null without it."""
        return F.get(F.split(text, label, 2), 1)

    def word(text):
        return F.get(F.split(text, r"\s", 2), 0)
    read = headed.select(
        *keep, number(word(F.col("__piece"))).alias("query_tm"), number(word(after("Lock_time: "))).alias("lock_tm"),
        whole(word(after("Rows_examined: "))).alias("rows"), F.split(after("SET timestamp="), ";", 2).alias("__stamped"))
    inserts = F.get("__stamped", 1).rlike(r"(?ms)\A\s+(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")
    found = read.filter(inserts).withColumn("epoch", whole(F.get("__stamped", 0)))
    return found.filter(F.col("epoch").isNotNull() & F.col("rows").isNotNull()).select(*keep, "epoch", "query_tm", "lock_tm", "rows")


def mine_slow_log(
    df: DataFrame, zone: str = "UTC", min_secs: float = 0, patterns: list[str] = INSERT_PATTERNS,
    max_gap: int = 15, max_group: int = 4, keys: tuple[str, ...] = ("host",), slice_seconds: int = 3600,
) -> DataFrame:
    """Metric inserts with burst numbers and local time, those slower than ``min_secs``.

    Overlapping captures repeat statements, so equal rows of a host count as often as in the capture with most of them.
    Numbers are given before the threshold drops rows.
    """
    found = parse_mysql_slow_log(df, patterns)
    by = [k for k in keys if k in found.columns]
    file = [c for c in found.columns if c == "file_path"]
    facts = without_overlap(found.select(*by, *file, "epoch", "query_tm", "lock_tm", "rows"))
    numbered = burst_numbers(
        facts, by, "epoch", ["query_tm", "lock_tm", "rows"], "buffer", max_gap, max_group, slice_seconds
    )
    return numbered.filter(F.col("query_tm") > min_secs).withColumn("timestamp", ntz_in_zone("epoch", zone))
