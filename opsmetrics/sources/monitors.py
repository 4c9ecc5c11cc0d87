"""Parsers of the line-based monitors. Each is one narrow projection: no shuffle, no UDF.

Input has ``value`` (a line, a record or a file, as stated) and optionally
``host``, ``file_path`` and ``pos``, which pass through. ``timestamp`` is a wall
clock without zone.

Formats that name their columns themselves (status counters, process figures,
pool tables) can be read ``keyed``: a row then holds ``cells``, a map from the
names the capture gives to the cells' texts, so that captures with more or
other columns load as they are. Without it the rows have the fixed columns of
the known versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import after_equals, get, number, pairs, unix_lines, whole, words
from ..functions.time import is_iso, parse_iso
from .files import ParseResult, carried, carried_forward, placed_lines, split_rows, without_overlap

# Position (from 1) of each kept field in a stamped virtual-memory line.
VMSTAT_FIELDS = {
    "running": 1, "swpd": 3, "free": 4, "cache": 6, "si": 7, "so": 8, "bi": 9, "bo": 10,
    "in": 11, "cs": 12, "us": 13, "sy": 14, "id": 15,
}
# Socket states of a connection-count row.
TCP_STATES = (
    "ESTABLISHED", "SYN_SENT", "SYN_RECV", "FIN_WAIT1", "FIN_WAIT2", "TIME_WAIT",
    "CLOSED", "CLOSE_WAIT", "LAST_ACK", "LISTEN", "CLOSING", "UNKNOWN",
)
# Counters of the first database-status format.
DBVARS_V1 = (
    "Queries", "Aborted_clients", "Aborted_connects", "Connections",
    "Created_tmp_tables", "Created_tmp_disk_tables", "Threads_created",
)
# Measures of the second database-status format, in file order.
DBVARS_V2 = (
    "OS_file_reads", "OS_file_writes", "OS_fsyncs",
    "Log_sequence_number", "Log_flushed_up_to", "Log_unflushed_pct_buf",
    "Last_checkpoint_at", "checkpoint_age_pct_log", "pending_log_flushes",
    "pending_chkp_writes", "log_ios_done",
    "free_pct_bufpages", "Database_pages", "Old_database_pages", "Modified_db_pages",
    "Pending_writes_LRU", "Pending_writes_flush", "Pending_writes_single",
    "rows_inserted", "rows_updated", "rows_deleted", "rows_read",
    "Queries", "Questions", "Aborted_clients", "Aborted_connects", "Connections",
    "Created_tmp_tables", "Created_tmp_disk_tables", "Threads_created",
    "Innodb_buffer_pool_reads", "Innodb_buffer_pool_wait_free", "Innodb_log_waits",
    "Innodb_row_lock_waits", "Table_locks_waited",
    "current_query_maxtime", "current_query_count",
)
DBVARS_PERCENT = ("Log_unflushed_pct_buf", "checkpoint_age_pct_log", "free_pct_bufpages")
# Measures per section of an app-server pool capture.
POOL_SECTIONS = {
    "http-service": (
        "http200", "http2xx", "http3xx", "http4xx", "http5xx", "http_not_2345xx",
        "http_bytes_in", "http_bytes_out", "http_requests", "http_maxtime", "http_avgtime",
    ),
    "thread-pool": (
        "listener", "conq_open", "conq_queued", "conq_oflow", "conq_1minq", "conq_5minq", "conq_15minq",
        "conq_totalq", "conq_maxq", "conq_peakq", "conq_ticksq", "thrp_busy", "thrp_max",
        "thrp_total_tasks", "thrp_est_wait",
    ),
    "connection-pool": (
        "pool", "conp_avg_wait", "conp_peak_wait", "conp_acquired", "conp_released", "conp_used",
        "conp_peak_used", "conp_size_waitq", "conp_free", "conp_timedout",
    ),
}
PROCIO_KEYS = ("rchar", "wchar", "syscr", "syscw", "read_bytes", "write_bytes", "cancelled_write_bytes")
MEMSIZE_V2_KEYS = ("peak_m", "rss_m", "swap_m", "threads")


def _lines(df: DataFrame) -> DataFrame:
    """One line per row with carriage returns and empty lines removed; multi-line values are split."""
    keep = [c for c in df.columns if c != "value"]
    return (
        df.select(*keep, F.explode(F.split(unix_lines("value"), "\n")).alias("value"))
        .filter(F.col("value").rlike(r"\S"))
    )


def _fits(cell: Column, convert=whole) -> Column:
    """An empty cell, or one that converts: text in place of a number must not turn into a null without a reject."""
    return (F.length(F.trim(cell)) == 0) | convert(F.trim(cell)).isNotNull()


def _all_fit(cells: Column) -> Column:
    return F.forall(cells, lambda x: _fits(x, number))


#: Columns of named formats that are words, not figures.
WORDS = ("listener", "pool")


def _named_cells(names: Column, cells: Column) -> Column:
    return F.map_from_arrays(F.transform(names, lambda x: F.trim(x)), F.transform(cells, lambda x: F.trim(x)))


def _named_fit(names: Column, cells: Column) -> Column:
    """As many cells as names, a time stamp in front, and figures in all columns but the words."""
    known = F.array(*[F.lit(w) for w in WORDS])
    rest = F.zip_with(F.slice(names, F.lit(2), F.size(names)), F.slice(cells, F.lit(2), F.size(cells)),
                      lambda n, c: F.array_contains(known, F.trim(n)) | _fits(c, number))
    return (F.size(names) == F.size(cells)) & (F.size(names) > 1) & is_iso(F.get(cells, 0)) & F.forall(rest, lambda x: F.coalesce(x, F.lit(False)))


def parse_vmstat(df: DataFrame, on_bad: str = "quarantine") -> ParseResult:
    """17 numbers and a time stamp; header lines start with ``p`` or ``r``."""
    f = words("value")
    lines = _lines(df).withColumn("__f", f).filter(~F.col("__f")[0].rlike("^[pr]"))
    ok = (F.size("__f") == 18) & is_iso(F.try_element_at("__f", F.lit(18))) & F.forall(F.slice("__f", 1, 17), lambda x: _fits(x))
    res = split_rows(lines, ok, "not a vmstat row", on_bad)
    fields = [whole(F.col("__f")[i - 1]).alias(c) for c, i in VMSTAT_FIELDS.items()]
    rows = res.rows.select(*carried(df), parse_iso(F.col("__f")[17]).alias("timestamp"), *fields)
    return ParseResult(rows, res.rejects)


def parse_fdcount(df: DataFrame, on_bad: str = "quarantine") -> ParseResult:
    """Open file counts; a stopped process counts 0."""
    pattern = r"gf_fdcount=(\S+)\s+mysql_fdcount=(\S+)\s+(\S+)"
    def part(i):
        return F.regexp_extract("value", pattern, i)
    def count(i):
        return F.when(part(i).startswith("NO"), F.lit(0).cast("bigint")).otherwise(whole(part(i)))
    lines = _lines(df)
    ok = (F.size(words("value")) == 3) & is_iso(part(3)) & count(1).isNotNull() & count(2).isNotNull()
    res = split_rows(lines, ok, "not an fdcount row", on_bad)
    rows = res.rows.select(
        *carried(df), parse_iso(part(3)).alias("timestamp"), count(1).alias("gf_fdcount"), count(2).alias("mysql_fdcount")
    )
    return ParseResult(rows, res.rejects)


def _not_running(value: Column) -> Column:
    return value.rlike("UNABLE_TO_READ|_RUNNING")


def parse_memsize(df: DataFrame, on_bad: str = "quarantine", keyed: bool = False) -> dict[str, ParseResult]:
    """Process memory: ``v1`` (one row per sample) and ``v2`` (one row per process).

    The version is told line by line, so captures of both may be mixed. Lines of
    stopped or unreadable processes are skipped.
    """
    lines = _lines(df).filter(~_not_running(F.col("value")))
    is_v2 = F.col("value").rlike(r"^\s*\d{4}-\d\d-\d\dT\d\d:\d\d")
    sizes = r"(\d+)m,(\d+)m(?:,(\d+)m)?"
    pattern = rf"^gf_rss_[^=]+={sizes}\s+mysql_rss_[^=]+={sizes}\s(?:.*\s)?(\S+)$"
    def part(i):
        return F.regexp_extract("value", pattern, i)
    same_width = (F.length(part(3)) > 0) == (F.length(part(6)) > 0)
    v1 = split_rows(lines.filter(~is_v2), is_iso(part(7)) & same_width, "not a memsize row", on_bad)
    names = ("gf_rss_m", "gf_prss_m", "gf_swap_m", "mysql_rss_m", "mysql_prss_m", "mysql_swap_m")
    v1_rows = v1.rows.select(
        *carried(df), parse_iso(part(7)).alias("timestamp"),
        *[whole(part(i)).alias(n) for i, n in enumerate(names, start=1)],
    )
    return {"v1": ParseResult(v1_rows, v1.rejects), "v2": _per_process(lines.filter(is_v2), df, MEMSIZE_V2_KEYS, on_bad, keyed)}


def _per_process(lines: DataFrame, df: DataFrame, keys: tuple[str, ...], on_bad: str, keyed: bool = False) -> ParseResult:
    """``ISO process k=v k=v ..``"""
    split = lines.withColumn("__f", words("value"))
    values = F.slice("__f", F.lit(3), F.greatest(F.lit(0), F.size("__f") - 2))
    if keyed:
        ok = is_iso(F.col("__f")[0]) & (F.size("__f") > 2) & F.forall(values, lambda x: F.contains(x, F.lit("=")) & _fits(F.substring_index(x, "=", -1), number))
    else:
        ok = is_iso(F.col("__f")[0]) & (F.size("__f") == len(keys) + 2) & F.forall(values, lambda x: _fits(F.substring_index(x, "=", -1)))
    res = split_rows(split, ok, "wrong number of fields", on_bad)
    rows = res.rows.withColumn("__m", pairs(F.array_join(values, " "), " "))
    figures = [F.col("__m").alias("cells")] if keyed else [whole(get(F.col("__m"), k)).alias(k) for k in keys]
    return ParseResult(rows.select(*carried(df), parse_iso(F.col("__f")[0]).alias("timestamp"), F.col("__f")[1].alias("node"), *figures), res.rejects)


def parse_procio(df: DataFrame, on_bad: str = "quarantine", keyed: bool = False) -> ParseResult:
    """Process I/O totals, one row per process."""
    lines = _lines(df).filter(~_not_running(F.col("value")))
    return _per_process(lines, df, PROCIO_KEYS, on_bad, keyed)


def parse_conxcount(df: DataFrame, on_bad: str = "quarantine") -> ParseResult:
    """Connections per socket state and port; absent states are 0, unknown ones are counted in ``ignored_states``."""
    lines = _lines(df).withColumn("__svals", F.regexp_extract("value", r"^([^\t]+)\t(\S+)$", 1)).withColumn(
        "__ts", F.regexp_extract("value", r"^([^\t]+)\t(\S+)$", 2))
    counts = F.filter(F.split("__svals", ","), lambda x: F.length(F.trim(x)) > 0)
    ok = is_iso("__ts") & F.forall(counts, lambda x: _fits(F.substring_index(x, "=", -1)))
    res = split_rows(lines, ok, "no time stamp or a bad count", on_bad)
    rows = res.rows.withColumn("__m", pairs("__svals"))
    m = F.col("__m")
    known = F.array(*[F.lit(k) for k in ("port", *TCP_STATES, "TOTAL")])
    rows = rows.select(
        *carried(df), parse_iso("__ts").alias("timestamp"), whole(get(m, "port")).alias("port"),
        *[F.coalesce(whole(get(m, s)), F.lit(0)).cast("bigint").alias(s) for s in TCP_STATES],
        F.coalesce(whole(get(m, "TOTAL")), F.lit(0)).cast("bigint").alias("TOTAL"),
        F.size(F.array_except(F.map_keys(m), known)).alias("ignored_states"),
    )
    return ParseResult(rows, res.rejects)


def parse_dbvars(df: DataFrame, on_bad: str = "quarantine", keyed: bool = False) -> dict[str, ParseResult]:
    """Database status: ``v1`` (``K=V,..<tab>ISO``) and ``v2`` (CSV with a header), told line by line.

    ``keyed`` reads lines with their places: a header line of the capture names the columns of the lines up to the next
    one; before the first one, and without places, the known columns hold.
    """
    named = keyed and "split" in df.columns
    lines = (placed_lines(df).filter(F.col("value").rlike(r"\S")) if named else _lines(df)).filter(~F.col("value").rlike("timed out|call failed"))
    cut = F.split("value", ",")
    is_header = F.trim(cut[0]) == "timestamp"
    known = F.lit(",".join(("timestamp", *DBVARS_V2)))
    if named:
        lines = carried_forward(lines, {"__header": F.when(is_header, F.col("value"))})
    is_v1 = cut[0].rlike(r"^\w+=\d+$")
    stamp, listed = F.element_at(F.split("value", "\t"), -1), F.substring_index("value", "\t", 1)
    figures = F.filter(F.split(listed, ","), lambda x: F.length(F.trim(x)) > 0)
    v1_ok = (F.size(F.split("value", "\t")) == 2) & is_iso(stamp) & F.forall(
        figures, lambda x: F.contains(x, F.lit("=")) & _fits(F.substring_index(x, "=", -1), number if keyed else whole))
    v1 = split_rows(lines.filter(is_v1), v1_ok, "no time stamp or a bad count", on_bad)
    v1_rows = v1.rows.withColumn("__m", pairs(listed)).select(
        *carried(df), parse_iso(stamp).alias("timestamp"),
        *([F.col("__m").alias("cells")] if keyed else [whole(get(F.col("__m"), k)).alias(k) for k in DBVARS_V1]))

    body = lines.filter(~is_v1 & ~is_header).withColumn("__c", cut)
    if keyed:
        body = body.withColumn("__n", F.split(F.coalesce("__header", known) if named else known, ","))
        v2 = split_rows(body, _named_fit(F.col("__n"), F.col("__c")), "wrong number of columns", on_bad)
        cells = F.map_filter(_named_cells(F.col("__n"), F.col("__c")), lambda k, v: k != "timestamp")
        v2_rows = v2.rows.select(*carried(df), parse_iso(F.col("__c")[0]).alias("timestamp"), cells.alias("cells"))
    else:
        share = F.array(*[F.lit(n in DBVARS_PERCENT) for n in DBVARS_V2])
        fits = F.zip_with(F.slice("__c", F.lit(2), len(DBVARS_V2)), share, lambda c, p: F.when(p, _fits(c, number)).otherwise(_fits(c)))
        v2_ok = (F.size("__c") == len(DBVARS_V2) + 1) & is_iso(F.col("__c")[0]) & F.forall(fits, lambda x: F.coalesce(x, F.lit(False)))
        v2 = split_rows(body, v2_ok, "wrong number of columns", on_bad)
        v2_rows = v2.rows.select(
            *carried(df), parse_iso(F.col("__c")[0]).alias("timestamp"),
            *[(number if n in DBVARS_PERCENT else whole)(F.trim(F.col("__c")[i])).alias(n)
              for i, n in enumerate(DBVARS_V2, start=1)],
        )
    return {"v1": ParseResult(v1_rows, v1.rejects), "v2": ParseResult(v2_rows, v2.rejects)}


def parse_slowlog(
    df: DataFrame, on_bad: str = "quarantine", number_missing: bool = True, keys: tuple[str, ...] = ("host",),
    slice_seconds: int = 3600,
) -> ParseResult:
    """Slow-insert lines with or without a ``buffer`` field.

    Lines without one are numbered per host (see ``burst_numbers``). Lines
    repeated by overlapping captures are removed first; the file they came from is then no longer known.
    """
    lines = _lines(df).withColumn("__f", words("value"))
    equals = F.length("value") - F.length(F.translate("value", "=", ""))
    with_buffer = (F.size("__f") == 5) & (equals == 4)
    without = (F.size("__f") == 4) & (equals == 3)
    res = split_rows(lines, (with_buffer | without) & is_iso(F.col("__f")[0]), "wrong shape", on_bad)
    v = after_equals(F.col("__f"))
    n = F.size("__f")
    keep = [c for c in carried(df) if c != "pos"]
    rows = res.rows.withColumn("__v", v).select(
        *keep, parse_iso(F.col("__v")[0]).alias("timestamp"),
        F.when(n == 5, whole(F.col("__v")[1])).alias("buffer"),
        number(F.element_at("__v", -3)).alias("query_tm"), number(F.element_at("__v", -2)).alias("lock_tm"),
        whole(F.element_at("__v", -1)).alias("rows"),
    )
    rows = without_overlap(rows)
    if not number_missing:
        return ParseResult(rows, res.rejects)
    from ..functions.time import epoch_of
    from ..operators.bursts import burst_numbers

    have = rows.filter(F.col("buffer").isNotNull())
    lack = rows.filter(F.col("buffer").isNull()).drop("buffer").withColumn("__epoch", epoch_of("timestamp"))
    numbered = burst_numbers(
        lack, [k for k in keys if k in keep], "__epoch", ["query_tm", "lock_tm", "rows"], slice_seconds=slice_seconds
    ).drop("__epoch")
    return ParseResult(have.unionByName(numbered), res.rejects)


def parse_gfpools(df: DataFrame, on_bad: str = "quarantine", keyed: bool = False) -> dict[str, ParseResult]:
    """App-server pools, ``value`` a ``#section``-separated record or a whole file; one table per section.

    A section brings its own header, which names the columns if ``keyed``; ``other`` then holds sections that are not
    known. ``error`` sections fall out.
    """
    keep = carried(df)
    records = df.select(*keep, F.explode(F.split(unix_lines("value"), "#section ")).alias("value"))
    title = F.btrim(F.substring_index("value", "\n", 1), F.lit(" \t"))
    titled = records.withColumn("__section", F.when(title.endswith(":"), F.substring_index(title, ":", 1)))
    is_header = lambda line: F.exists(F.split(line, ","), lambda c: F.lower(F.trim(c)) == "timestamp")
    held = titled.filter(F.col("__section").isNotNull() & (F.col("__section") != "error")).withColumn("__lines", F.split("value", "\n"))
    lines = (
        held.withColumn("__n", F.split(F.get(F.filter("__lines", is_header), 0), ","))
        .select(*keep, "__section", "__n", F.explode(F.slice("__lines", F.lit(2), F.size("__lines"))).alias("value"))
        .filter(F.col("value").rlike(r"\S") & ~is_header(F.col("value")))
        .withColumn("__c", F.split("value", ","))
    )
    out = {}
    known = F.col("__section").isin(*POOL_SECTIONS)
    for section, names in POOL_SECTIONS.items() if not keyed else [*POOL_SECTIONS.items(), ("other", ())]:
        own = lines.filter(F.col("__section") == section if names else ~known)
        if keyed:
            res = split_rows(own, F.col("__n").isNotNull() & _named_fit(F.col("__n"), F.col("__c")), "wrong number of columns", on_bad)
            figures = [F.map_filter(_named_cells(F.col("__n"), F.col("__c")), lambda k, v: k != "timestamp").alias("cells")]
        else:
            words_ = F.array(*[F.lit(n in WORDS) for n in names])
            fits = F.zip_with(F.slice("__c", F.lit(2), len(names)), words_, lambda c, w: w | _fits(c))
            ok = (F.size("__c") == len(names) + 1) & is_iso(F.col("__c")[0]) & F.forall(fits, lambda x: F.coalesce(x, F.lit(False)))
            res = split_rows(own, ok, "wrong number of columns", on_bad)
            figures = [
                (F.col("__c")[i] if n in WORDS else whole(F.col("__c")[i])).alias(n)
                for i, n in enumerate(names, start=1)
            ]
        out[section] = ParseResult(res.rows.select(*keep, parse_iso(F.col("__c")[0]).alias("timestamp"), *figures), res.rejects)
    return out


def parse_numabuddyrefs(df: DataFrame, on_bad: str = "quarantine", vmstat_keys: list[str] | None = None) -> dict[str, ParseResult]:
    """Memory-node captures, ``value`` a ``datetime: ``-separated record or a whole file.

    ``buddyinfo``: free blocks per node, zone and order. ``procvmstat``: counters,
    as a map, or as columns when ``vmstat_keys`` names them. ``numastat``: the
    measure-by-node matrix turned to one row per node with a map of measures;
    measures before the second node heading are megabytes and end in ``_mb``.
    """
    keep = carried(df)
    records = (
        df.select(*keep, F.explode(F.split(unix_lines("value"), "datetime: ")).alias("value"))
        .filter(F.col("value").rlike(r"\S"))
    )
    # The parts of a record, in order.
    titles = ("buddyinfo:", "procvmstat:", "numastat:")
    parts = F.split("value", "#section ")
    stamped = records.withColumn("timestamp", parse_iso("value")).withColumn("__parts", parts)
    complete = F.size("__parts") == len(titles) + 1
    for i, title in enumerate(titles, start=1):
        complete = complete & F.coalesce(F.get("__parts", i).startswith(title), F.lit(False))
    res = split_rows(stamped, F.col("timestamp").isNotNull() & complete, "incomplete record", on_bad)
    def section(i):
        return F.substring(F.get("__parts", i), len(titles[i - 1]) + 1, F.length(F.get("__parts", i)))
    def lines_of(i):
        return F.filter(F.split(section(i), "\n"), lambda x: x.rlike(r"\S"))

    buddy = res.rows.select(*keep, "timestamp", F.explode(lines_of(1)).alias("value")).withColumn("__f", words("value"))
    bad_buddy = split_rows(buddy, F.size("__f") == 15, "wrong number of columns", on_bad)
    buddy_rows = bad_buddy.rows.select(
        *keep, "timestamp", F.regexp_extract("value", r"^\s*Node\s+(\S+),", 1).alias("node"),
        F.regexp_extract("value", r"zone\s+(\S+)", 1).alias("zone"),
        *[whole(F.col("__f")[i + 4]).alias(f"order{i}") for i in range(11)],
    )

    counter = lambda x: (F.size(words(x)) == 2) & whole(F.get(words(x), 1)).isNotNull()
    bad_counters = split_rows(res.rows.select(*keep, F.explode(lines_of(2)).alias("value")), counter(F.col("value")), "not a counter", on_bad)
    entries = F.transform(F.filter(lines_of(2), counter), lambda x: F.struct(words(x)[0].alias("k"), whole(words(x)[1]).alias("v")))
    counters = res.rows.select(*keep, "timestamp", F.map_from_entries(entries).alias("counters"))
    if vmstat_keys:
        counters = counters.select(*keep, "timestamp", *[get(F.col("counters"), k).alias(k) for k in vmstat_keys])

    body = F.regexp_replace(section(3), r"(?m)^(Per-node.*|\s*-+[\s-]*)$", "")
    # Everything after the second node heading is the hit-counter block.
    blocks = F.split(body, r"(?m)^\s+Node .*$")
    nodes = F.regexp_extract_all(F.regexp_extract(body, r"(?m)^\s+(Node .*?)\s*(?:Total)?\s*$", 1), F.lit(r"(\d+)"), 1)
    def measures(block: int, suffix: str):
        text = F.coalesce(F.try_element_at(blocks, F.lit(block)), F.lit(""))
        return F.transform(
            F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")),
            lambda x: F.struct(
                F.translate(F.concat(words(x)[0], F.lit(suffix)), "()", "_").alias("label"),
                F.slice(words(x), F.lit(2), F.size(words(x)) - 1).alias("v"),
            ),
        )
    matrix = F.concat(measures(2, "_mb"), measures(3, ""))
    per_node = res.rows.withColumn("__m", matrix).withColumn("__n", nodes).select(
        *keep, "timestamp", F.posexplode("__n").alias("__i", "node"), "__m"
    )
    numa = per_node.select(
        *keep, "timestamp", "node",
        F.map_from_arrays(
            F.transform("__m", lambda e: e["label"]),
            F.transform("__m", lambda e: number(F.try_element_at(e["v"], F.col("__i") + 1))),
        ).alias("measures"),
    )
    # a row of the matrix has a label and a figure for each node and the total
    cells = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"\S") & ~x.rlike(r"^\s+Node "))
    matrix_rows = res.rows.withColumn("__nodes", F.size(nodes)).select(*keep, "__nodes", F.explode(cells).alias("value"))
    values = F.slice(words("value"), F.lit(2), F.size(words("value")))
    bad_matrix = split_rows(matrix_rows, (F.size(values) >= F.col("__nodes")) & _all_fit(values), "not a row of the matrix", on_bad)
    return {
        "buddyinfo": ParseResult(buddy_rows, res.rejects.unionByName(bad_buddy.rejects, allowMissingColumns=True)),
        "procvmstat": ParseResult(counters, bad_counters.rejects),
        "numastat": ParseResult(numa, bad_matrix.rejects),
    }
