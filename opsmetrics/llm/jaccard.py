"""Operator 5, n-gram Jaccard join: universe partition and pigeonhole, exact verification.

**Signatures.** Two sets of sizes a and b with Jaccard similarity of at least p % differ in at most
``H = (a + b)(100 - p) / (100 + p)`` elements. The universe of shingle hashes is cut into ``m = H + 1`` equal segments
(H for the largest sets of a size band), so a similar pair agrees on at least one whole segment. Size bands are chosen
so that partners lie in the same band or the next; a set is indexed under its own band and, as the smaller partner, the
next one.

**Allocation.** An empty segment would be a signature that unrelated sets share, so it is skipped; every skipped
segment is paid for by a segment that is matched up to one deletion. With h segments empty in both sets, at most h - 1
of the others differ by two or more, so any h usable others contain one that differs by exactly one element, and
``Q`` leading segments with their one-deletion neighbourhoods hold h usable ones as long as each set has at most Q / 3
empty segments and at most Q / 3 with fewer than two elements among the Q. Sets outside these limits index
everything: their empty segments and all one-deletion neighbourhoods. ``allocate`` picks Q per band by expected cost
(signatures of ordinary sets against those of the sets outside the limits), or, where segments would be too short,
half as many segments, all with one-deletion neighbourhoods.

**Hopeless sets.** Most sets of a large corpus have no partner. With o = ceil(p % of n) a similar pair shares at least o of a set's n
elements, so at least t of its first n - o + t elements by hash are also among the first ones of the partner. ``_hopeful``
counts, for every set, how many of these leading elements another set leads with too; sets with too few are not indexed.
The test drops no similar pair, and its work is a fixed share of the elements.

**Candidates.** Within a signature's group every set is paired with the smallest one (its pivot) only, so a group of n
copies makes n - 1 pairs. Each is verified on the whole sets. A similar pair x, y of which at least one is not
similar to their common pivot p still has to be found: with ``Rx`` the elements in which x and p differ,
``|x - y| = |Rx| + |Ry| - 2 |Rx and Ry|``, so Rx and Ry overlap in at least ``(|Rx| + |Ry| - H) / 2`` elements. These
small difference sets are joined by prefix: elements ordered by frequency around the pivot, rare ones first, pairs
only where both positions still allow the overlap and so do bit maps of both sets (a bit that only one has stands for
an element outside the overlap); the whole sets decide. Sets near p (d of at most four times h, the most in which a set
and a partner differ) meet with all of their differences, sets far from it with a prefix of their own elements, which is
the same around each pivot and held once. If one of a pair is not near, both count as far: the limit for far is four times the h of the smallest partner, less the set's own h. Pairs that may share no element (both very close to p) are joined on the pivot by size of difference. Only
pairs that are not connected yet are kept, so a large group of near copies yields no square of links: at each shared
element one set is drawn and the others are compared with it, for ``TURNS`` turns with other draws; what is similar to many
is connected then, and the pairs left, which are compared in full, are around the smallest pivot that both sets have.

Equal sets are one node from the start (its key is a 64-bit hash of the set's size and two sums of element hashes), so
exact copies cost one row per task. Elements are 64-bit hashes of word runs; two different runs share one with a
probability of 2^-64, as do two different sets.

Null and empty texts have an empty set and link with nothing. Rows with equal ids stay separate rows; a null id is
never a component's name unless all of its ids are null. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, Words, mix, signed, slices, stored, table, windows
from .components import components
from .registry import query

#: A small side is broadcast up to this many rows of 16 bytes; beyond it, an ordinary join.
BROADCAST_ROWS = 2_000_000
#: Sets already indexed by a task are remembered up to this many.
SEEN = 500_000
#: One in so many elements of a set is asked for beyond the prefix that all similar sets share one element of.
LEADING = 10
#: Elements or index keys that a task holds at a time.
TOGETHER = 1 << 18
#: Times that sets around a pivot are compared with one of them before all pairs left are.
TURNS = 3
#: Words of 64 bits in the bit map of a difference set.
MAP_BITS = 2
MAP_WORDS = 1 << MAP_BITS


def difference(a, b, percent: int):
    """The largest number of elements in which similar sets of sizes a and b differ."""
    return (a + b) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def bands(percent: int, largest: int = 1 << 40) -> tuple[int, ...]:
    """First sizes of the bands: a partner's size lies in the same band or a neighbour."""
    edges = [1, 2]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // percent + 1))
    return tuple(edges)


@lru_cache(maxsize=None)
def allocate(percent: int, band: int) -> tuple[int, int]:
    """(segments, leading segments with one-deletion neighbourhoods) of a band; all of them have these if both are equal."""
    edges = bands(percent)
    size = edges[band + 1] - 1
    budget = difference(size, size, percent)
    m = budget + 1
    each = size / m
    empty, thin = np.exp(-each), np.exp(-each) * (1 + each)

    def above(n: int, p: float, most: int) -> float:
        """Chance of more than ``most`` successes, by a normal bound from above."""
        mean, sd = n * p, max(1e-9, np.sqrt(n * p))
        return float(min(1.0, n * p)) if most == 0 else float(np.exp(-max(0.0, most + 0.5 - mean) ** 2 / (2 * sd * sd + (most + 0.5 - mean) / 1.5)))

    def cost(q: int) -> float:
        outside = min(1.0, above(m, empty, q // 3) + (above(q, thin, q // 3) if q else 0.0))
        return m + q * (1 + each) + outside * (size + m)

    best = min(range(0, m + 1, 3), key=cost)
    half = (budget + 2) // 2
    if half * (1 + size / half) + half < cost(best):
        return half, half
    return m, best


def set_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes; with fewer words than ``width``, all of them as one."""
    if len(hashes) == 0:
        return hashes
    return np.unique(windows(hashes, min(width, len(hashes))))


_SALT = np.uint64(0xA24BAED4963EE407)


def set_key(s: np.ndarray) -> int:
    """A 64-bit key of a set."""
    both = np.array([len(s), s.sum(dtype=np.uint64), mix(s ^ _SALT).sum(dtype=np.uint64)], dtype=np.uint64)
    return int(windows(both, 3)[:1].view(np.int64)[0])


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """All index keys of a sorted set."""
    edges = bands(percent)
    n = len(s)
    own = int(np.searchsorted(edges, n, "right")) - 1
    out = []
    value = mix(s ^ _SALT)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    for band in (own, own + 1):
        if band > own and n * 100 // percent < edges[band]:
            break
        m, q = allocate(percent, band)
        cuts = np.searchsorted(s, _segment_starts(m))
        cuts = np.append(cuts, n)
        counts = np.diff(cuts)
        content = total[cuts[1:]] - total[cuts[:-1]]
        names = _names(band, m)
        if m == q:
            full, deleted = np.zeros(0, bool), m
        else:
            outside = np.count_nonzero(counts == 0) > q // 3 or np.count_nonzero(counts[:q] < 2) > q // 3
            full = counts > 0
            if outside:
                full[:] = True
            deleted = m if outside else q
            out.append(mix(content[full] ^ names[full]))
        if deleted:
            lead = slice(0, deleted)
            usable = np.ones(deleted, bool) if deleted == m else counts[lead] >= 2
            marks = mix(names[lead] ^ _SALT)
            out.append(mix(content[lead][usable] ^ marks[usable]))
            segment = np.repeat(np.arange(deleted), counts[lead])
            keep = usable[segment]
            segment = segment[keep]
            out.append(mix((content[segment] - value[: cuts[deleted]][keep]) ^ marks[segment]))
    return np.unique(np.concatenate(out))


@lru_cache(maxsize=4096)
def _segment_starts(m: int) -> np.ndarray:
    return np.array([(j << 64) // m for j in range(m)], dtype=np.uint64)


@lru_cache(maxsize=4096)
def _names(band: int, m: int) -> np.ndarray:
    return mix(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 32))


def _sets(batches, width: int):
    """(record batch, sorted set of each of its texts) for bounded slices."""
    for part, texts in slices(batches):
        words = Words(texts, NOT_SPACE)
        yield part, [set_of(words.hash[a:b], width) for a, b in zip(words.lo, words.hi)]


def _numbered(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, n) per row; the node of an empty set is null."""
    def run(batches):
        for part, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
                names=["doc_id", "node", "n"])

    return docs.mapInArrow(run, "doc_id bigint, node bigint, n bigint")


def with_node(docs: DataFrame, width: int, out: str) -> DataFrame:
    """``docs`` with the key of each text's set; null for an empty set."""
    def run(batches):
        for part, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def shared_leaders(n: int, percent: int) -> int:
    """How many leading elements two similar sets share, if the smaller one has n elements."""
    return min(n // LEADING + 1, -(-n * percent // 100))


def leaders(s: np.ndarray, percent: int) -> np.ndarray:
    """The first elements of a sorted set that are compared before it is indexed."""
    return s[: len(s) - (-(-len(s) * percent // 100)) + shared_leaders(len(s), percent)]


def _new_sets(batches, width: int):
    """(node, sorted set) of each set, once per task."""
    seen: set[int] = set()
    for _, sets in _sets(batches, width):
        for s in sets:
            if len(s) == 0 or (node := set_key(s)) in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
            yield node, s


def _combined(nodes: np.ndarray, elements: np.ndarray) -> pa.RecordBatch:
    """Leading elements of some sets: those that only one holds as they are, the others once, with a credit for each holder."""
    order = np.argsort(elements, kind="stable")
    e, node = elements[order], nodes[order]
    first = np.flatnonzero(np.append(True, e[1:] != e[:-1])) if len(e) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(e)))
    held, times = np.unique(node[np.repeat(count > 1, count)], return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([e[first].view(np.int64), held])), pa.array(np.concatenate([node[first], held])),
         pa.array(np.concatenate([np.where(count > 1, 0, -1), times]).astype(np.int64))], names=["e", "node", "credit"])


def _hopeful(docs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(node) of the sets that share enough leading elements with others to have a similar one.

    A row's credit is -1 for an element not met again so far, 0 for one whose holders have their credits, and positive for
    those credits, which go under the node's own key. A hot element thus sends one row per ``TOGETHER`` elements.
    """
    def run(batches):
        nodes, found, size = [], [], 0
        for node, s in _new_sets(batches, width):
            found.append(leaders(s, percent))
            nodes.append(np.full(len(found[-1]), node, np.int64))
            size += len(found[-1])
            if size >= TOGETHER:
                yield _combined(np.concatenate(nodes), np.concatenate(found))
                nodes, found, size = [], [], 0
        if found:
            yield _combined(np.concatenate(nodes), np.concatenate(found))

    keys = docs.mapInArrow(run, "e bigint, node bigint, credit bigint").withColumn("given", F.col("credit") > 0)
    met = W.partitionBy("e", "given").orderBy("node")
    other = lambda c: F.coalesce(c.over(met) != F.col("node"), F.lit(False))
    shared = other(F.lag("node")) | other(F.lead("node"))
    # an element met within one task's elements has a credited row; others that hold it meet that row
    held = keys.withColumn("shared", shared).withColumn(
        "credit", F.when(F.col("given"), F.col("credit")).when(F.col("shared") & (F.col("credit") < 0), 1).otherwise(0))
    least = F.ceil(F.col("n") * percent / 100).cast("bigint")
    need = F.least(F.floor(least / LEADING) + 1, F.ceil(least * percent / 100))
    sizes = rows.where("node IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"))
    return held.where("credit > 0").groupBy("node").agg(F.sum("credit").alias("held")).join(sizes, "node").where(F.col("held") >= need).select("node")


def _indexed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, node) of every set, once per set and task."""
    def run(batches):
        nodes, keys, size = [], [], 0
        for node, s in _new_sets(batches, width):
            keys.append(signatures(s, percent))
            nodes.append(np.full(len(keys[-1]), node, np.int64))
            size += len(keys[-1])
            if size >= TOGETHER:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["sig", "node"])
                nodes, keys, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    return docs.mapInArrow(run, "sig bigint, node bigint")


def _documents_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents that hold the wanted nodes: all rows of one id per node."""
    one = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("key"))
    one = stored(one.select("key").distinct(), "jaccard")
    if one.count() <= BROADCAST_ROWS:
        one = F.broadcast(one)
    return docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 62)))).join(one, "key", "left_semi").select("doc_id", "text")


def _wanted_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, elements) of the wanted nodes, each from one document."""
    def run(batches):
        for _, sets in _sets(batches, width):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "elements"])

    held = _documents_of(docs, rows, wanted)
    return held.mapInArrow(run, "node bigint, elements array<bigint>").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _both_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, p) pairs with both sets; the hot side of a star is joined last, where adaptive execution may split it."""
    return (
        pairs.join(sets.select(F.col("node").alias("x"), F.col("elements").alias("ex")), "x")
        .join(sets.select(F.col("node").alias("p"), F.col("elements").alias("ep")), "p").select("p", "x", "ep", "ex"))


def _pair_arrays(batch: pa.RecordBatch):
    """Unsigned element arrays of both sides of each row."""
    sides = []
    for name in ("ep", "ex"):
        column = batch.column(batch.schema.get_field_index(name))
        values, offs = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
        offs = offs - offs[0]
        sides.append([values[a:b] for a, b in zip(offs[:-1], offs[1:])])
    return zip(*sides)


def _small(batches, rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _against_pivot(pairs: DataFrame, percent: int) -> DataFrame:
    """(p, x, n_p, n_x, linked, d, diff, far, m0 ..): the number of elements in which x and p differ, these if they are few,
    whether they are so many that a partner of x may not be near p, and a bit map of their hashes."""
    def run(batches):
        for batch in _small(batches):
            rows = {k: [] for k in ("n_p", "n_x", "linked", "d", "diff", "far", *(f"m{k}" for k in range(MAP_WORDS)))}
            for p, x in _pair_arrays(batch):
                d = np.setxor1d(p, x, assume_unique=True)
                common = (len(p) + len(x) - len(d)) // 2
                rows["n_p"].append(len(p))
                rows["n_x"].append(len(x))
                rows["linked"].append(100 * common >= percent * (common + len(d)))
                h = difference(len(x), len(x) * 100 // percent, percent)
                rows["d"].append(len(d))
                rows["diff"].append((d if len(d) <= 4 * h else d[:0]).view(np.int64))
                least = -(-len(x) * percent // 100)
                limit = 4 * difference(least, least * 100 // percent, percent) - h
                rows["far"].append(len(d) > limit)
                bits = mix(d ^ _SALT) >> np.uint64(64 - 6 - MAP_BITS)
                held = np.zeros(MAP_WORDS, np.uint64)
                np.bitwise_or.at(held, (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
                for k, m in enumerate(held.view(np.int64).tolist()):
                    rows[f"m{k}"].append(m)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), *[pa.int64()] * MAP_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(rows.values(), kinds))], names=["p", "x", *rows])

    return pairs.mapInArrow(run, "p bigint, x bigint, n_p bigint, n_x bigint, linked boolean, d bigint, diff array<bigint>, far boolean, " + ", ".join(f"m{k} bigint" for k in range(MAP_WORDS)))


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose whole sets are similar."""
    def run(batches):
        for batch in _small(batches):
            good = []
            for p, x in _pair_arrays(batch):
                common = len(np.intersect1d(p, x, assume_unique=True))
                good.append(100 * common >= percent * (len(p) + len(x) - common))
            keep = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1)], names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _around_pivots(stars: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): similar pairs of sets around a common pivot that the links to pivots do not connect yet."""
    top, sum_ = 100 - percent, 100 + percent
    h = lambda a, b: F.floor((a + b) * top / sum_).cast("bigint")
    alone = stars.groupBy("p").agg(F.count("*").alias("members"), F.sum(F.when(F.col("linked"), 0).otherwise(1)).alias("apart"))
    rows = (
        stars.join(alone.where("members > 1 AND apart > 0"), "p")
        .join(roots.select(F.col("node").alias("x"), "root"), "x", "left").withColumn("root", F.coalesce("root", "x"))
        .withColumn("h", h(F.col("n_x"), F.floor(F.col("n_x") * 100 / percent)))
        .withColumn("least", h(F.ceil(F.col("n_x") * percent / 100), F.col("n_p")) + 1))
    # sets close to the pivot: elements by frequency around it, rare ones first; far ones: their own elements by hash, once for
    # all of their pivots
    near = rows.where("d <= 4 * h")
    element = near.select("p", "x", F.explode("diff").alias("e"))
    often = element.groupBy("p", "e").agg(F.count("*").alias("f"))
    ordered = (
        element.join(often, ["p", "e"]).groupBy("p", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "e"))), lambda s: s["e"]).alias("diff")))
    near = near.drop("diff").join(ordered, ["p", "x"]).withColumn("part", F.lit(0))
    maps = [f"m{k}" for k in range(MAP_WORDS)]
    least = F.ceil(F.col("n_x") * percent / 100)
    far = (
        rows.where("far").select("x", "n_x").distinct().join(sets.select(F.col("node").alias("x"), F.col("elements").alias("diff")), "x")
        .select(F.lit(0).cast("bigint").alias("p"), F.lit(1).alias("part"), "x", "n_x", F.lit(False).alias("linked"), F.col("n_x").alias("d"),
                *(F.lit(0).cast("bigint").alias(m) for m in maps), (F.col("n_x") - least + 1).alias("prefix"), "diff"))
    # at most one of the pair is similar to the pivot, so the overlap has a lower bound that depends on one side only
    bound = F.when(F.col("linked"), F.ceil((F.col("d") + F.col("least") - F.col("h")) / 2)).otherwise(F.col("d") - F.col("h"))
    cols = ["x", "n_x", "linked", "d", *maps]
    prefix = (
        near.withColumn("prefix", F.col("d") - F.greatest(F.lit(1), bound) + 1).select("p", "part", *cols, "prefix", "diff")
        .unionByName(far.select("p", "part", *cols, "prefix", "diff"))
        .select("p", "part", *cols, F.posexplode(F.slice("diff", F.lit(1), F.greatest(F.lit(0), F.col("prefix")).cast("int"))).alias("pos", "e")))
    prefix = stored(prefix, "jaccard")
    at = ["p", "part", "e"]
    need = F.greatest(F.lit(1), F.ceil((F.col("d_a") + F.col("d_b") - h(F.col("n_x_a"), F.col("n_x_b"))) / 2))
    only = lambda a, b: sum((F.bit_count(F.col(f"{m}_{a}").bitwiseAND(F.bitwise_not(f"{m}_{b}"))) for m in maps), F.lit(0))
    may_link = (
        F.expr("x_a <> x_b AND NOT (linked_a AND linked_b) AND root_a <> root_b")
        & (F.col("pos_a") + need <= F.col("d_a")) & (F.col("pos_b") + need <= F.col("d_b"))
        & (only("a", "b") + need <= F.col("d_a")) & (only("b", "a") + need <= F.col("d_b")))

    def apart(named: DataFrame) -> DataFrame:
        """The prefixes with present roots, at elements where more than one root meets."""
        now = prefix.join(named, "x")
        open_ = now.groupBy(at).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("linked").alias("linked")).where("lo < hi AND NOT linked")
        return now.join(open_.select(at), at, "left_semi")

    def side(frame: DataFrame, n: str, *more: str) -> DataFrame:
        return frame.select(*at, *(F.col(c).alias(f"{c}_{n}") for c in (*cols, "pos", "root", *more)))

    def linked(met: DataFrame) -> DataFrame:
        pairs = met.select(F.least("x_a", "x_b").alias("p"), F.greatest("x_a", "x_b").alias("x")).distinct()
        return stored(_verified(_both_sets(stored(pairs, "jaccard"), sets), percent), "jaccard")

    # sets that meet at an element are compared with one of them first, another at each element and turn: what is similar
    # to many is linked by a number of pairs in proportion to the prefixes
    named = stored(rows.select("x", "root").distinct(), "jaccard")
    found = None
    for turn in range(TURNS):
        now = stored(apart(named), "jaccard")
        one = now.groupBy(at).agg(F.min(F.struct(F.xxhash64("x", "e", F.lit(turn)).alias("draw"), *cols, "pos", "root")).alias("q")).select(*at, "q.*")
        new = linked(side(now, "a").join(side(one, "b"), at).where(may_link))
        if new.isEmpty():
            break
        found = new if found is None else found.union(new)
        roots_of = lambda c: named.select(F.col("x").alias(c), F.col("root").alias(f"root_{c}"))
        merged = components(new.join(roots_of("a"), "a").join(roots_of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        merged = merged.select(F.col("node").alias("root"), F.col("root").alias("into"))
        named = stored(named.join(merged, "root", "left").select("x", F.coalesce("into", "root").alias("root")), "jaccard")
    # all pairs that are left and share a pivot; near ones each around the smallest that both have
    pivots = stars.groupBy("x").agg(F.collect_set("p").alias("pivots"))
    now = apart(named).join(pivots, "x").withColumn("pivots", F.filter("pivots", lambda q: (F.col("part") == 1) | (q < F.col("p"))))
    now = stored(now, "jaccard")
    met = side(now, "a", "pivots").join(side(now, "b", "pivots"), at)
    new = linked(met.where(may_link & F.expr("x_a < x_b AND arrays_overlap(pivots_a, pivots_b) = (part = 1)")))
    found = new if found is None else found.union(new)
    rows = rows.drop("root").join(named, "x")
    # pairs whose difference sets may be disjoint: the sum of the differences alone is small enough
    close = rows.where("NOT linked AND d <= h").select("p", *(F.col(c).alias(f"{c}_a") for c in ("x", "n_x", "root", "d")))
    closer = rows.where("d + least <= h").select("p", *(F.col(c).alias(f"{c}_b") for c in ("x", "n_x", "root", "d")))
    touch = close.join(closer, "p").where(F.expr("root_a <> root_b") & (F.col("d_a") + F.col("d_b") <= h(F.col("n_x_a"), F.col("n_x_b"))))
    return found.union(touch.select("x_a", "x_b").toDF("a", "b"))


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, n_shingles, component_id, node, a key shared by equal sets, and root, the node that names the group."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    rows = stored(_numbered(docs, width), "jaccard")
    hopeful = stored(_hopeful(docs, rows, width, percent), "jaccard")
    group = W.partitionBy("sig").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)
    pairs = stored(
        _indexed(_documents_of(docs, rows, hopeful), width, percent).withColumn("p", F.first("node").over(group)).where("node > p")
        .select("p", F.col("node").alias("x")).distinct(), "jaccard")
    wanted = stored(pairs.select(F.col("p").alias("node")).union(pairs.select(F.col("x").alias("node"))).distinct(), "jaccard")
    sets = stored(_wanted_sets(docs, rows, wanted, width), "jaccard")
    stars = stored(_against_pivot(_both_sets(pairs, sets), percent), "jaccard")
    links = stars.where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
    roots = components(links)
    roots = components(links.union(_around_pivots(stars, roots, sets, percent)))
    named = (
        rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node")))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id", "root")
    return rows.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node", "root")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS s FROM words),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.b FROM reach JOIN links ON links.a = reach.y),
named AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN named USING (doc_id)
"""


@query("op5_ngram_jaccard_join", SQL)
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")
