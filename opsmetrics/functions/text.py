"""Text, number and key-value helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unix_lines(text: Column | str) -> Column:
    """CRLF to LF."""
    return F.regexp_replace(_col(text), "\r", "")


def words(text: Column | str) -> Column:
    """Whitespace-separated fields, edge blanks ignored."""
    return F.split(F.btrim(_col(text), F.lit(" \t\r\n")), r"\s+")


def after_equals(tokens: Column) -> Column:
    """``label=value`` tokens to their values."""
    return F.transform(tokens, lambda x: F.regexp_replace(x, r"^.*=", ""))


def before_equals(tokens: Column) -> Column:
    """``label=value`` tokens to their labels."""
    return F.transform(tokens, lambda x: F.regexp_replace(x, r"=.*$", ""))


def entries_to_map(entries: Column) -> Column:
    """Map of (k, v) entries in which a repeated key keeps its last value.

    Repeats are rare, so the plain conversion serves every row without one. Give
    ``entries`` as a column of its own where it is costly: the other branch looks
    it up once per key.
    """
    keys = F.transform(entries, lambda e: e["k"])
    unique = F.array_distinct(keys)
    last = F.transform(unique, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])
    return F.when(F.size(unique) == F.size(keys), F.map_from_entries(entries)).otherwise(F.map_from_arrays(unique, last))


def pairs(text: Column | str, sep: str = ",", kv: str = "=") -> Column:
    """``k=v`` text to a map; a repeated key keeps its last value, empty pieces are ignored."""
    pieces = F.filter(F.split(_col(text), sep), lambda x: F.length(F.trim(x)) > 0)
    return entries_to_map(F.transform(pieces, lambda x: F.struct(
        F.trim(F.substring_index(x, kv, 1)).alias("k"),
        F.when(F.contains(x, F.lit(kv)), F.substring(x, F.instr(x, kv) + len(kv), F.length(x))).alias("v"),
    )))


def get(m: Column, key: str, default=None) -> Column:
    v = F.try_element_at(m, F.lit(key))
    return v if default is None else F.coalesce(v, F.lit(default))


def whole(text: Column | str) -> Column:
    """Text to bigint, null when it is not one."""
    return _col(text).try_cast("bigint")


def number(text: Column | str) -> Column:
    return _col(text).try_cast("double")


def line_after(text: Column | str, start: str) -> Column:
    """Rest of the first line that begins with ``start``, empty without one; ``text`` must begin with a newline.

    A pattern that opens with literal text is searched skipping ahead, which is
    several times cheaper than an anchored multi-line pattern or a map of all lines.
    """
    return F.trim(F.regexp_extract(_col(text), "\n\\Q" + start + "\\E([^\n]*)", 1))


def no_commas(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), ",", "")


def or_default(text: Column | str, default: str) -> Column:
    """The default replaces null and empty text."""
    c = _col(text)
    return F.coalesce(F.when(F.length(c) > 0, c), F.lit(default))


def host_from_path(path: Column | str) -> Column:
    """Host part of a capture's file name ``<ticket>_<monitor>_<host>_<epoch>.txt``.

    Between the last two underscores, cut at the first dot, blanks and dashes to
    underscores. A host that itself holds underscores keeps only its last piece.
    """
    stem = F.regexp_replace(F.substring_index(_col(path), "/", -1), r"_[^_]*$", "")
    return F.translate(F.substring_index(F.substring_index(stem, "_", -1), ".", 1), " -", "__")


def metric_header(name: Column | str) -> Column:
    """Column header to metric column name: first ``%`` to ``pct``, ``(`` to ``_``, ``)`` dropped."""
    once = F.regexp_replace(_col(name), r"^([^%]*)%", "$1pct")
    return F.translate(F.trim(once), "()", "_")


def scaled_round(x: Column, digits: int) -> Column:
    """``x * 10**digits`` rounded to a whole number as C's printf rounds: on the exact
    binary value, ties to even. ``digits`` is at most 3; with 3, ``x`` is whole or above 1.

    Spark's own rounding works on the shortest decimal text of a double, which
    lies on a tie more often than the double itself. Here the fraction is split
    off exactly and scaled in integers.
    """
    shift = (60, 59, 56, 53)[digits]  # as many binary places as fit a bigint after scaling
    size = F.abs(x)
    units = F.floor(size).cast("bigint")
    bits = (size - units) * F.lit(float(2 ** shift))
    fraction = F.floor(bits).cast("bigint")
    wide = fraction * F.lit(10 ** digits).cast("bigint")
    low = F.shiftright(wide, shift)
    rest = wide.bitwiseAND(F.lit(2 ** shift - 1).cast("bigint"))
    half = F.lit(2 ** (shift - 1)).cast("bigint")
    up = (rest > half) | ((rest == half) & ((bits > fraction) | ((units * F.lit(10 ** digits).cast("bigint") + low) % 2 == 1)))
    whole_part = units * F.lit(10 ** digits).cast("bigint") + low + up.cast("bigint")
    return F.when(x < 0, -whole_part).otherwise(whole_part)


def human_bytes(n: Column | str) -> Column:
    """Divide by 1000 while above 1000; three decimals and a unit letter (blank for none)."""
    left = _col(n).cast("double")
    amount, letter = left, F.lit(" ")
    # Unit letters of rising powers of 1000.
    for unit in "KMGT":
        more = left > 1000
        left = left / F.lit(1000.0)
        amount = F.when(more, left).otherwise(amount)
        letter = F.when(more, F.lit(unit)).otherwise(letter)
    milli = scaled_round(amount, 3)
    thousandths = F.lpad((milli % 1000).cast("string"), 3, "0")
    return F.concat(F.floor(milli / 1000).cast("string"), F.lit("."), thousandths, letter)


def kb_to_mb(kb: Column | str) -> Column:
    """Kilobytes to whole megabytes, ties to even as C's ``%.0f`` prints them."""
    return F.bround(_col(kb) / F.lit(1024.0)).cast("bigint")


def ceil_div(x: Column | str, d: int) -> Column:
    """Ceiling of x / d for positive x."""
    return F.floor((_col(x) - 1) / F.lit(d)).cast("bigint") + 1


def percent(part: Column, base: Column) -> Column:
    """``100 * part / base`` to one decimal, null on a zero base."""
    return scaled_round(F.try_divide(part * F.lit(100.0), base), 1) / F.lit(10.0)


def json_metric_sum(text: Column | str) -> Column:
    """First ``sum`` of a metric-data JSON reply, non-digits removed, 0 when absent."""
    raw = F.regexp_extract(_col(text), r'"sum"\s*:\s*([^,}\]]*)', 1)
    return F.coalesce(F.regexp_replace(raw, r"\D", "").try_cast("bigint"), F.lit(0).cast("bigint"))
