"""Operator 9, secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums.

One automaton over all keywords runs through each whole text (ASCII letters lowered); an expression is only tried at
the place of a hit. Long runs of hexadecimal digits have no keyword; they are found as runs over the bytes. Kinds:

* ``assign``, ``access``, ``hex``: the base kinds, as fixed below;
* ``github``, ``npm``: prefix and 36 base-62 characters, the last six being the CRC-32 of those before them;
* ``jwt``: three base64url parts of which the first decodes to a JSON object with ``alg``;
* ``slack``, ``stripe``: vendor prefixes with their alphabets; ``pem``: a private-key block's first line to its last
  (the first line alone, if no last line of its label follows).

Null and empty texts have no spans. Rows are independent of each other: repeated rows, null ids and extra columns are
kept as they are, an empty table gives an empty result. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, byte_table, raw, slices, table
from .registry import query

# Base kinds, in the order in which they are listed.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16

MORE = {
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "slack": re.compile(r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    "stripe": re.compile(r"[rs]k_live_[0-9A-Za-z]{16,}"),
    "pem": re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----"),
}
PEM_END = re.compile(r"-----END ([A-Z ]*)PRIVATE KEY(?=-----)")
BASE64URL = re.compile(r"[A-Za-z0-9_-]*")
KINDS = (*BASE, *MORE)
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access", **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"), "npm_": "npm", "eyj": "jwt",
    **dict.fromkeys(("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), "slack"), "sk_live_": "stripe", "rk_live_": "stripe",
    "-----begin ": "pem",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_BYTES = byte_table((0x30, 0x39), (0x61, 0x66))

SPAN = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.LongType()),
    T.StructField("kind", T.StringType())]))
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())]))


def crc62(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def valid(kind: str, m: re.Match) -> bool:
    """Whether a match's length, checksum or encoded header holds."""
    if kind == "assign":
        return len(m[2]) >= ASSIGN_MIN
    if kind == "access":
        return m.end() - m.start() >= ACCESS_MIN
    if kind in ("github", "npm"):
        return crc62(m[1][:30]) == m[1][30:]
    if kind == "jwt":
        try:
            head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
        except (ValueError, RecursionError):  # brackets nested too deeply are no header
            return False
        return isinstance(head, dict) and "alg" in head
    return True


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def keyword_spans(found, lowered: str, text: str) -> list[tuple[int, int, int, str]]:
    """Spans of all kinds with keywords; per kind leftmost and without overlap, failing matches dropped afterwards.

    No part of the text is read again and again: where a token's first part is not followed by the others, no hit within
    that part is; the ends of key blocks are found once.
    """
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in found.iter(lowered))
    free = dict.fromkeys(KINDS, 0)
    ends: dict[str, list[int]] | None = None
    out = []
    for start, kind in hits:
        if start < free[kind]:
            continue
        m = (ASSIGN if kind == "assign" else ACCESS if kind == "access" else MORE[kind]).match(text, start)
        if m is None:
            if kind == "jwt" and text.startswith("eyJ", start):
                free[kind] = BASE64URL.match(text, start).end()
            continue
        end = m.end()
        if kind == "pem":
            if ends is None:
                ends = {}
                for e in PEM_END.finditer(text):
                    ends.setdefault(e[1], []).append(e.start())
            closing = ends.get(m[1], [])
            k = bisect_left(closing, end)
            if k < len(closing):
                end = closing[k] + len(m[1]) + len("-----END PRIVATE KEY-----")
        free[kind] = end
        if valid(kind, m):
            out.append((start, KINDS.index(kind), end, kind))
    return out


def hex_runs(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) in code points of each run of at least HEX_MIN lower-case hexadecimal digits."""
    inside = HEX_BYTES[data]
    inside_at = np.flatnonzero(inside)
    if len(inside_at) < HEX_MIN:
        return
    # a run never needs bytes of two texts: break at text starts
    row = np.searchsorted(offs, inside_at, "right")
    new = np.flatnonzero((np.diff(inside_at) != 1) | (np.diff(row) != 0)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(inside_at)]])
    for k in np.flatnonzero(last - first >= HEX_MIN):
        at = int(inside_at[first[k]])
        r = int(row[first[k]]) - 1
        begin = int(np.count_nonzero((data[offs[r] : at] & 0xC0) != 0x80))
        yield r, begin, begin + int(last[k] - first[k])


def slice_spans(found, texts: pa.Array) -> list[list[tuple[int, int, int, str]]]:
    data, offs = raw(texts)
    lowered = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(LOWER[data]))
    spans = [keyword_spans(found, a, b) if a else [] for a, b in zip(lowered.to_pylist(), texts.to_pylist())]
    for r, start, end in hex_runs(data, offs):
        spans[r].append((start, KINDS.index("hex"), end, "hex"))
    return [sorted(s) for s in spans]


def scan(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with a column ``out`` of spans (start, rank, end, kind), ordered by start and kind."""
    def run(batches):
        found = automaton()
        for part, texts in slices(batches, text):
            spans = pa.array([[dict(zip(("start", "rank", "end", "kind"), s)) for s in row] for row in slice_spans(found, texts)], _ARROW_SPAN)
            yield pa.RecordBatch.from_arrays([*part.columns, spans], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, SPAN)]))


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one) and ``length`` counted anew; clean texts stay."""
    def run(batches):
        found = automaton()
        for part, texts in slices(batches, text):
            fresh = []
            for old, own in zip(texts.to_pylist(), slice_spans(found, texts)):
                pieces, at = [], 0
                for start, _, end, _ in own:
                    if start >= at:
                        pieces += [old[at:start], mark]
                    at = max(at, end)
                fresh.append("".join(pieces) + old[at:] if own else None)
            k = part.schema.get_field_index(text)
            old = part.column(k)
            new = pa.array(fresh, old.type)
            column = pa.compute.coalesce(new, old)
            part = part.set_column(k, part.schema.field(k), column)
            if length in part.schema.names:
                j = part.schema.get_field_index(length)
                changed = pa.compute.utf8_length(new).cast(part.column(j).type)
                part = part.set_column(j, part.schema.field(j), pa.compute.coalesce(changed, part.column(j)))
            yield part

    return docs.mapInArrow(run, docs.schema)


def labelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(labelled(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        labelled(F.col("spans")).alias("spans"))
