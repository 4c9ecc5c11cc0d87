"""Operator 4, exact embedding near-dedup: vectors of one label with a cosine of at least a threshold are linked.

Equal vectors of a label are one node. **Blocks:** the nodes of a label are dealt by hash into blocks of about
``BLOCK``, and each pair of blocks, and each block with itself, is one group of rows in which all cosines are computed.
So every link is found; nothing is sampled or capped. The work grows with the square of a label's size: a node is sent
once for each block of its label, and ``BLOCK`` vectors of double precision are multiplied with as many at a time.
**Links:** a group of rows gives, for each node that has links in it, their number (copies counted) and the node's root
among the links of the group; pairs are not emitted. These stars, at most one edge per node and group, connect what the
links connect, and the components of all stars are the components of all links.

Cosines are computed in double precision. Vectors that are null or zero, or hold null or non-finite components, and
vectors without a label link with nothing; vectors of different lengths are never compared. Repeated rows are vectors
of their own and link with each other; rows with a null id are nodes like others but name no component. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table
from .components import components
from .registry import query

BLOCK, STRIP = 4096, 512


def _unit(vectors) -> np.ndarray:
    """Unit rows in double precision."""
    x = np.stack(vectors).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(x: np.ndarray, y: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which rows of ``x`` are linked with which rows of ``y``, or with which other rows of ``x`` if there is no ``y``."""
    other = x if y is None else y
    out = np.zeros((len(x), len(other)), bool)
    for at in range(0, len(x), STRIP):
        out[at : at + STRIP] = x[at : at + STRIP] @ other.T >= threshold
    if y is None:
        out = np.triu(out, 1)
        out |= out.T
    return out


def _sums(linked: np.ndarray, of_rows: np.ndarray, of_columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies that each row and each column is linked with."""
    rows, columns = np.zeros(len(of_rows)), np.zeros(len(of_columns))
    for at in range(0, len(linked), STRIP):
        part = linked[at : at + STRIP].astype(np.float64)
        rows[at : at + STRIP] = part @ of_columns
        columns += of_rows[at : at + STRIP] @ part
    return rows.astype(np.int64), columns.astype(np.int64)


def _roots(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column, a row of its component; ``same``: rows and columns are the same nodes. Every row has a link."""
    rows, columns = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    if same:
        columns = rows
    for k in range(len(rows)):
        if rows[k] >= 0:
            continue
        rows[k], wave = k, np.array([k])
        while len(wave):
            new = np.flatnonzero(linked[wave].any(axis=0) & (columns < 0))
            columns[new] = k
            if not same:
                new = np.flatnonzero(linked[:, new].any(axis=1) & (rows < 0))
                rows[new] = k
            wave = new
    return rows, columns


def _links(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, others, root) per node and pair of blocks in which it has links."""
    sizes = stored(nodes.groupBy("group").agg(F.ceil(F.count("*") / block).cast("bigint").alias("blocks")), "neardup")
    placed = nodes.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = placed.select(
        "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("right"), "node", "copies", "vector")

    def run(key, rows):
        import pandas as pd

        same, right = key[1] == key[2], rows["right"].to_numpy()
        x, ids, copies = _unit(rows["vector"].to_numpy()), rows["node"].to_numpy(), rows["copies"].to_numpy()
        a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~right), np.flatnonzero(right))
        linked = _linked(x[a], None if same else x[b], threshold)
        r, c = linked.any(axis=1), linked.any(axis=0)
        linked, a, b = linked[r][:, c], a[r], b[c]
        (of_a, of_b), (root_a, root_b) = _sums(linked, copies[a], copies[b]), _roots(linked, same)
        out = pd.DataFrame({"node": ids[a], "others": of_a, "root": ids[a][root_a]})
        return out if same else pd.concat([out, pd.DataFrame({"node": ids[b], "others": of_b, "root": ids[a][root_b]})])

    return dealt.groupBy("group", "i", "j").applyInPandas(run, "node bigint, others bigint, root bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors (vec_id, embedding, label)``: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("group", F.when(F.coalesce(good, F.lit(False)), F.concat_ws(":", F.size("vector").cast("string"), "label")))
    # a sign of zero makes no other vector
    rows = rows.withColumn("vector", F.when(F.col("group").isNotNull(), F.transform("vector", lambda v: v + F.lit(0.0))))
    rows = stored(rows.withColumn("node", F.when(F.col("group").isNotNull(), F.xxhash64("group", "vector"))).select("vec_id", "node", "group", "vector"), "neardup")
    nodes = stored(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.first("group").alias("group"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least")),
        "neardup")
    # vectors of floats are sent as such; cosines are computed in double precision all the same
    narrow = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    links = stored(_links(nodes.withColumn("vector", F.col("vector").cast("array<float>")) if narrow else nodes, threshold, block), "neardup")
    roots = stored(components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))), "neardup")
    others = links.groupBy("node").agg(F.sum("others").alias("others"))
    named = nodes.select("node", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(others, "node", "left")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select(
        "node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("links"), "component")
    out = rows.select("vec_id", "node").join(named, "node", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, e FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.b FROM reach JOIN links ON links.a = reach.y),
named AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM named LEFT JOIN counted USING (vec_id)
"""


@query("op4_embedding_near_dedup", SQL)
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
