"""Operator 12, conversation prefix trie by the recursion of van Emde Boas: cut at half depth, name, recurse, graft.

**Naming.** A block of 2h depths is cut at half depth: its upper half is a trie of its own, and what lies below a cut
prefix is a forest of its own. Both are named by the same recursion, and a name in the lower forest becomes the name of
the cut prefix above it joined with its own. All blocks of one size are done at the same time, as one join on
(conversation, block), small blocks first: a name then covers the turns from its block's beginning. Depth d is
done after log2(d) rounds, and later rounds no longer touch it. Names are 128-bit digests of role and text and of the
names they join, so equal prefixes get equal names wherever they stand, without looking at each other.

**Nodes** are the distinct names; a node's smallest member stands for it.

**Totals** go up the same way: within a block, the forest below the cut has its totals; each of its roots adds them
to its h ancestors in the upper half, which its smallest member's path names. A round is a join on (member, block), with
at most one root each, and a grouping by ancestor, which combines before it shuffles. The number of rounds grows with
the logarithm of the greatest depth, and no round handles a conversation or a subtree as a whole.

Turns are numbered by range partitions of (conversation, turn): a conversation may span many. The digest of a node's
members is one long text by definition; it is made in pieces by range partitions and hashed as a stream.

Turns stand in the order of turn (null first), role and the digest of role and text; repeated rows are turns of their
own. A null role or text counts as empty. Rows with a null conversation are left out. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table
from .registry import query

EMPTY = hashlib.sha256(b"").hexdigest()


def digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, at, name, words) of all turns, ``at`` counted from 0; (conv, turns) of all conversations)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        digest(F.length(role).cast("string"), F.lit(":"), role, text).alias("name"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("words"))
    order = ("conv", "turn", "role", "name")

    def run(batches):
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            conv = batch.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            size = np.diff(np.append(first, n))
            at = np.arange(n) - np.repeat(first, size)
            if conv[0] == last:
                at[: size[0]] += held
            last, held = conv[-1], at[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(at), batch.column(3), batch.column(4)],
                names=["conv", "part", "at", "name", "words"])

    held = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "conv bigint, part int, at bigint, name binary, words bigint"), "trie-turns")
    counts = held.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # at most one conversation for each partition begins in an earlier one
    later = stored(counts.withColumn("base", F.sum("n").over(before)).where("base > 0").select("conv", "part", "base"), "trie-later")
    turns = held.join(later, ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("base", F.lit(0))).alias("at"), "name", "words")
    return turns, counts.groupBy("conv").agg(F.sum("n").alias("turns"))


def sequences(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv, depth, name, words, total) of turns as they are; ``total`` is the conversation's depth."""
    return turns.join(sizes, "conv").select("conv", (F.col("at") + 1).alias("depth"), "name", "words", F.col("turns").alias("total"))


def shared_heads(turns: DataFrame, sizes: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(sequences, sizes) of conversations rebuilt: the first h turns of conversation ``c - c % every``, then the own ones from the h-th.

    h is the crc32 of c's decimal form modulo ``most``; a head has all of that conversation's turns if there are fewer.
    """
    own = sizes.withColumn("head", F.col("conv") - F.col("conv") % every).withColumn("h", F.crc32(F.col("conv").cast("string")) % most)
    heads = sizes.select(F.col("conv").alias("head"), F.col("turns").alias("there"))
    plan = own.join(heads, "head", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))).select(
        "conv", "head", "h", "k", (F.col("k") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("total"))
    plan = stored(plan, "trie-plan")
    rest = turns.join(plan.drop("head"), "conv").where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("k") + 1).alias("depth"), "name", "words", "total")
    front = turns.where((F.col("conv") % every == 0) & (F.col("at") < most - 1)).withColumnRenamed("conv", "head").join(
        plan.drop("h"), "head").where("at < k").select("conv", (F.col("at") + 1).alias("depth"), "name", "words", "total")
    return rest.union(front), plan.select("conv", F.col("total").alias("turns"))


def block(half: int) -> tuple[Column, Column]:
    """(block, offset in it) of a depth counted from 1, for blocks of 2 * half."""
    at = F.col("depth") - 1
    return F.floor(at / (2 * half)), at % (2 * half)


def paths(rows: DataFrame) -> tuple[DataFrame, int]:
    """(``rows`` with the name of the prefix that ends there, greatest depth); rows have the turn's digest as name."""
    live = stored(rows, "trie-rows")
    deepest = live.agg(F.max("depth")).first()[0] or 0
    done, half = live.where("depth = 1"), 1
    while half < deepest:
        at, offset = block(half)
        placed = live.withColumn("block", at).withColumn("offset", offset)
        cut = placed.where(F.col("offset") == half - 1).select("conv", "block", F.col("name").alias("above"))
        lower = placed.where(F.col("offset") >= half).join(cut, ["conv", "block"]).withColumn("name", digest(F.col("above"), F.col("name")))
        upper = placed.where((F.col("offset") < half) & (F.col("depth") > half))
        live = stored(lower.select(*rows.columns).union(upper.select(*rows.columns)), "trie-rows")
        half *= 2
        done = done.union(live.where((F.col("depth") > half // 2) & (F.col("depth") <= half)))
    return done, deepest


def grafted(nodes: DataFrame, path: DataFrame, deepest: int, totals: tuple[str, ...]) -> DataFrame:
    """``nodes`` with each of ``totals`` summed over the node's subtree. ``nodes`` are (depth, name, conv_id, *totals), depths from 0."""
    half = 1
    while half <= deepest:
        at = F.floor(F.col("depth") / (2 * half))
        roots = nodes.where(F.col("depth") % (2 * half) == half).select(F.col("conv_id").alias("conv"), at.alias("block"), *totals)
        upper = path.withColumn("block", at).where((F.col("depth") % (2 * half) < half) & (F.col("total") >= F.col("block") * (2 * half) + half))
        below = upper.select("conv", "block", "depth", "name").join(roots, ["conv", "block"]).groupBy("depth", "name").agg(*(F.sum(t).alias(f"{t}_below") for t in totals))
        nodes = stored(
            nodes.join(below, ["depth", "name"], "left")
            .select(*(c for c in nodes.columns if c not in totals), *((F.col(t) + F.coalesce(f"{t}_below", F.lit(0))).alias(t) for t in totals)), "trie-totals")
        half *= 2
    return nodes


def member_digests(ends: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256): the digest of each node's ``conv`` values, ascending, in decimal form, comma-joined."""
    def pieces(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            depth, names, conv = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            first = [k for k in range(n) if k == 0 or names[k] != names[k - 1] or depth[k] != depth[k - 1]]
            spans = list(zip(first, [*first[1:], n]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(depth[x]) for x, _ in spans]), pa.array([names[x] for x, _ in spans], pa.binary()), pa.array([conv[x] for x, _ in spans]),
                 pa.array([",".join(map(str, conv[x:y])) for x, y in spans])], names=["depth", "name", "conv", "text"])

    def hashed(batches):
        key, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for depth, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if key == (depth, name):
                    state.update(f",{text}".encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (depth, name), hashlib.sha256(text.encode())
            if done:
                yield out(done)
                done = []
        if key is not None:
            yield out([(*key, state.hexdigest())])

    def out(rows):
        depth, name, sha = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(name, pa.binary()), pa.array(sha)], names=["depth", "name", "ends_sha256"])

    rows = ends.select("depth", "name", "conv").repartitionByRange("depth", "name", "conv").sortWithinPartitions("depth", "name", "conv")
    cut = rows.mapInArrow(pieces, "depth bigint, name binary, conv bigint, text string")
    return cut.repartition("depth", "name").sortWithinPartitions("depth", "name", "conv").mapInArrow(hashed, "depth bigint, name binary, ends_sha256 string")


def trie(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of sequences (conv, depth, name, words, total) and (conv, turns): one row per node, by its smallest member and depth."""
    roots = sizes.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(b"").alias("name"), F.lit(0).cast("bigint").alias("words"), F.col("turns").alias("total"))
    named, deepest = paths(rows)
    path = stored(named.select(*roots.columns).union(roots), "trie-paths")
    first = stored(path.groupBy("depth", "name").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "trie-names")
    above = path.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    placed = stored(first.join(above, ["conv_id", "depth"], "left"), "trie-placed")
    children = placed.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = placed.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(
        nodes.select("depth", "name", "conv_id", "parent", "n_convs", "n_children", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
                     ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "trie-nodes")
    nodes = grafted(nodes, path, deepest, ("n_leaves", "saved_tokens"))
    parents = first.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = member_digests(path.where("depth = total"))
    return nodes.join(parents, ["depth", "parent"], "left").join(ends, ["depth", "name"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "name")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are; ``name`` is the digest that stands for the node's prefix."""
    turns, sizes = numbered(conversations)
    return trie(sequences(turns, sizes), sizes)


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                            md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, xor(4294967295, list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ord(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT)) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
turns AS (
  SELECT convs.c, 0 AS own, t.i, t.r, t.x FROM convs JOIN t ON t.c = convs.c - convs.c % 20 AND t.i <= convs.h
  UNION ALL SELECT convs.c, 1, t.i, t.r, t.x FROM convs JOIN t ON t.c = convs.c AND t.i > convs.h),
whole AS (
  SELECT convs.c, coalesce(any_value(s.l), []) AS l
  FROM convs LEFT JOIN (SELECT c, list({'r': r, 'x': x} ORDER BY own, i) AS l FROM turns GROUP BY c) s USING (c) GROUP BY convs.c),
prefixes AS (SELECT c, d, l[1:d] AS p, len(l) AS n FROM whole, LATERAL (SELECT unnest(range(0, len(l) + 1)) AS d)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(sha256(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c)), sha256('')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) END AS own
  FROM prefixes GROUP BY p, d),
linked AS (SELECT a.*, b.conv_id AS parent_conv_id FROM nodes a LEFT JOIN nodes b ON a.d > 0 AND b.d = a.d - 1 AND b.p = a.p[1:a.d - 1]),
children AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT linked.*, coalesce(children.n, 0) AS n_children FROM linked LEFT JOIN children USING (p, d)),
totals AS (
  SELECT p[1:k] AS p, k AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved
  FROM full_nodes, LATERAL (SELECT unnest(range(0, d + 1)) AS k) GROUP BY ALL)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM full_nodes JOIN totals USING (p, d)
"""


@query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with shared heads."""
    turns, sizes = numbered(table(spark, sf_dir, "conversations"))
    return trie(*shared_heads(turns, sizes)).drop("name")
