"""Database-status snapshots: one text per sample, three sections, 37 measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_after, no_commas, percent, unix_lines, whole
from .monitors import DBVARS_V2

# Headings inside the engine-status section.
HEADINGS = ("FILE I/O", "LOG", "BUFFER POOL AND MEMORY", "INDIVIDUAL BUFFER POOL INFO", "ROW OPERATIONS")
# Measure, heading it stands under, start of its line, and where in the rest of the line it is.
ENGINE_FIELDS = [
    ("OS_file_reads", "FILE I/O", "", r"^(\d+) OS file reads"),
    ("OS_file_writes", "FILE I/O", "", r"(\d+) OS file writes"),
    ("OS_fsyncs", "FILE I/O", "", r"(\d+) OS fsyncs$"),
    ("Log_sequence_number", "LOG", "Log sequence number", None),
    ("Log_flushed_up_to", "LOG", "Log flushed up to", None),
    ("Last_checkpoint_at", "LOG", "Last checkpoint at", None),
    ("pending_log_flushes", "LOG", "", r"^(\d+) pending log flushes"),
    ("pending_chkp_writes", "LOG", "", r"(\d+) pending chkp writes$"),
    ("log_ios_done", "LOG", "", r"^(\d+) log i/o"),
    ("buffer_pool_size", "BUFFER POOL AND MEMORY", "Buffer pool size", None),
    ("free_buffers", "BUFFER POOL AND MEMORY", "Free buffers", None),
    ("Database_pages", "BUFFER POOL AND MEMORY", "Database pages", None),
    ("Old_database_pages", "BUFFER POOL AND MEMORY", "Old database pages", None),
    ("Modified_db_pages", "BUFFER POOL AND MEMORY", "Modified db pages", None),
    ("Pending_writes_LRU", "BUFFER POOL AND MEMORY", "Pending writes: LRU", r"^([\d,]*\d)"),
    ("Pending_writes_flush", "BUFFER POOL AND MEMORY", "Pending writes: LRU", r"flush list ([\d,]*\d)"),
    ("Pending_writes_single", "BUFFER POOL AND MEMORY", "Pending writes: LRU", r"single page (\d+)$"),
    ("rows_inserted", "ROW OPERATIONS", "Number of rows inserted", r"^([\d,]*\d)"),
    ("rows_updated", "ROW OPERATIONS", "Number of rows inserted", r" updated ([\d,]*\d)"),
    ("rows_deleted", "ROW OPERATIONS", "Number of rows inserted", r" deleted ([\d,]*\d)"),
    ("rows_read", "ROW OPERATIONS", "Number of rows inserted", r" read (\d+)$"),
]
# Counters of the global-status section.
STATUS_FIELDS = (
    "Queries", "Questions", "Aborted_clients", "Aborted_connects", "Connections",
    "Created_tmp_tables", "Created_tmp_disk_tables", "Threads_created",
    "Innodb_buffer_pool_reads", "Innodb_buffer_pool_wait_free", "Innodb_log_waits",
    "Innodb_row_lock_waits", "Table_locks_waited",
)
GLOBALS = ("innodb_log_buffer_size", "innodb_log_file_size", "innodb_log_files_in_group")


def _section(n: int) -> Column:
    """Text of a numbered section, beginning with a newline."""
    after = F.split_part("value", F.lit(f"START SECTION {n}"), F.lit(2))
    return F.concat(F.lit("\n"), F.split_part(after, F.lit("START SECTION"), F.lit(1)))


def _under(heading: str) -> Column:
    """Text below a heading of the engine section; empty when it is missing."""
    block = F.try_element_at(F.filter("__blocks", lambda b: b.startswith(heading)), F.lit(-1))
    return F.concat(F.lit("\n"), F.coalesce(block, F.lit("")))


def _engine_field(heading: str, start: str, pattern: str | None) -> Column:
    under = F.col(f"__h{HEADINGS.index(heading)}")
    if pattern is None:
        return whole(line_after(under, start))
    if start:
        return whole(no_commas(F.regexp_extract(line_after(under, start), pattern, 1)))
    return whole(no_commas(F.regexp_extract(under, "(?m)" + pattern, 1)))


def log_settings(variables: DataFrame, by: list[str] = ()) -> DataFrame:
    """The log-size variables as columns, per host if ``by`` says so, from name/value rows."""
    return variables.filter(F.col("name").isin(*GLOBALS)).groupBy(*by).agg(
        *[F.max(F.when(F.col("name") == g, whole("value"))).alias(g) for g in GLOBALS]
    )


def parse_db_status(df: DataFrame, variables: DataFrame) -> DataFrame:
    """Snapshots (``value``, ``timestamp``, maybe ``host``) to one row with all measures.

    ``variables`` has one row of log-size settings, per ``host`` where it has that
    column (see ``log_settings``; give those of many hosts as a stored table, whose
    size Catalyst knows, or the snapshots are shuffled by host). Every field is read from its own section and
    heading; the three percentages are computed.
    """
    keep = [c for c in df.columns if c != "value"]
    text = df.withColumn("value", F.replace(unix_lines("value"), F.lit("\t"), F.lit(" ")))
    cut = text.select(*keep, *[_section(i).alias(f"__s{i}") for i in (1, 2, 3)])
    cut = cut.withColumn("__blocks", F.split("__s1", r"\n(?=(?:" + "|".join(HEADINGS) + r")\b)"))
    cut = cut.withColumns({f"__h{i}": _under(h) for i, h in enumerate(HEADINGS)})
    engine = [_engine_field(h, start, pattern).alias(name) for name, h, start, pattern in ENGINE_FIELDS]
    status = [whole(line_after("__s2", n + " ")).alias(n) for n in STATUS_FIELDS]
    sessions = [
        whole(F.regexp_extract("__s3", r"hiwat:?\s+(\d+)", 1)).alias("current_query_maxtime"),
        whole(F.regexp_extract("__s3", r"xcount:?\s+(\d+)", 1)).alias("current_query_count"),
    ]
    fields = cut.select(*keep, *engine, *status, *sessions)
    if "host" in variables.columns and "host" in keep:
        sized = fields.join(variables, "host", "left")
    else:
        settings = variables.select(F.struct(*GLOBALS)).scalar()
        sized = fields.withColumns({g: settings[g] for g in GLOBALS})
    seq = F.col("Log_sequence_number")
    return (
        sized.withColumn("Log_unflushed_pct_buf", percent(seq - F.col("Log_flushed_up_to"), F.col("innodb_log_buffer_size")))
        .withColumn("checkpoint_age_pct_log", percent(
            seq - F.col("Last_checkpoint_at"), F.col("innodb_log_file_size") * F.col("innodb_log_files_in_group")))
        .withColumn("free_pct_bufpages", percent(F.col("free_buffers"), F.col("buffer_pool_size")))
        .select(*keep, *DBVARS_V2)
    )


def query_sessions(processes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Longest running time and number of sessions that are executing a query."""
    return processes.filter(F.col("command") == "Query").groupBy(*by).agg(
        F.max("time").alias("hiwat"), F.count("*").alias("xcount")
    )
