"""Operator 2, preference formatting: the longest common turn prefix as prompt, paired masked completions.

Built-in DataFrame functions only. A turn is rendered as ``<|role|>``, a line break, its text, ``<|end|>`` and a line
break. Of a pair of conversations the leading turns that are equal in role and text are rendered once, as prompt; the
other turns of either side are its completion. Masks are the code-point ranges of a completion that are to be learned:
the text and end mark of each assistant turn, counted from the completion's start.

A conversation becomes one row, as its rendering is one text; turns are combined by an ordinary grouping. Turns are
ordered by turn, role and text, so repeated turns stay, in a defined order. Null roles and texts count as empty. A pair
with no common turn has an empty prompt, equal conversations have empty completions. A side that is missing has no
turns. Pairs with a null id stand together as one conversation with a null id. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query

END = "<|end|>"


def gathered(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns): the ordered turns of each conversation as an array of (turn, role, text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return turns.groupBy(F.col(key).alias(key)).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(f"{END}\n"))


def common(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    differ = F.zip_with(a, b, lambda x, y: ~(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])))
    first = F.array_position(differ, F.lit(True))
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("bigint")


def masks(turns: Column) -> Column:
    """``start:end`` of what an assistant says in the rendering of ``turns``, comma-joined."""
    def add(held: Column, turn: Column) -> Column:
        start = held["at"] + F.length(turn["role"]) + 5
        end = start + F.length(turn["text"]) + len(END)
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(
            (end + 1).cast("bigint").alias("at"),
            F.when(turn["role"] == "assistant", F.concat(held["spans"], F.array(span))).otherwise(held["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, zero, add, lambda held: held["spans"]), ",")


def preference_pairs(pairs: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Rows of (key, two arrays of turns) as key, n_common, prompt, chosen, rejected and the masks of both."""
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    held = pairs.select(key, F.coalesce(F.col(chosen), empty).alias("a"), F.coalesce(F.col(rejected), empty).alias("b"))
    held = held.withColumn("n_common", common(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n_common").cast("int") + 1, F.size(c))
    joined = lambda c: F.array_join(F.transform(c, rendered), "")
    tail = held.withColumn("ra", F.when(F.size("a") > 0, rest(F.col("a"))).otherwise(F.col("a"))).withColumn(
        "rb", F.when(F.size("b") > 0, rest(F.col("b"))).otherwise(F.col("b")))
    head = F.filter(F.col("a"), lambda x, i: i < F.col("n_common"))
    return tail.select(
        key, "n_common", joined(head).alias("prompt"), joined(F.col("ra")).alias("chosen"), joined(F.col("rb")).alias("rejected"),
        masks(F.col("ra")).alias("chosen_mask"), masks(F.col("rb")).alias("rejected_mask"))


def _last_reply(turns: Column) -> Column:
    """Place (from 1, 0 if there is none) of the last assistant turn."""
    return F.coalesce(F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1))), F.lit(0))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations),
l AS (SELECT conv_id, max(i) AS la FROM t WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT l.conv_id, t.text FROM l JOIN t ON t.conv_id = l.conv_id AND t.i = l.la),
ids AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN conv_id + 1 ELSE conv_id - 1 END AS partner FROM t),
r0 AS (
  SELECT t.conv_id, t.i, t.role, CASE WHEN t.i = l.la THEN reply.text ELSE t.text END AS text, t.i = l.la AS swapped
  FROM t JOIN ids ON ids.conv_id = t.conv_id LEFT JOIN l ON l.conv_id = t.conv_id LEFT JOIN reply ON reply.conv_id = ids.partner),
r AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS i
  FROM r0 WHERE text IS NOT NULL),
n AS (
  SELECT t.conv_id, min(CASE WHEN r.i IS NULL OR r.role <> t.role OR r.text <> t.text THEN t.i - 1 END) AS differ, max(t.i) AS k
  FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.i = t.i GROUP BY t.conv_id),
c AS (SELECT conv_id, coalesce(differ, k) AS n_common FROM n),
both_ AS (
  SELECT 'a' AS side, t.conv_id, t.i, t.role, t.text FROM t
  UNION ALL SELECT 'b' AS side, r.conv_id, r.i, r.role, r.text FROM r),
out_ AS (
  SELECT b.side, b.conv_id, b.i, b.role, c.n_common, b.i <= c.n_common AS head,
         '<|' || b.role || '|>' || chr(10) || b.text || '<|end|>' || chr(10) AS piece,
         length(b.role) + 5 AS lead, length(b.text) + 7 AS said
  FROM both_ b JOIN c ON c.conv_id = b.conv_id),
at_ AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY side, conv_id, head ORDER BY i) - length(piece) + lead AS s FROM out_)
SELECT conv_id, CAST(n_common AS BIGINT) AS n_common,
       coalesce(string_agg(CASE WHEN side = 'a' AND head THEN piece END, '' ORDER BY i), '') AS prompt,
       coalesce(string_agg(CASE WHEN side = 'a' AND NOT head THEN piece END, '' ORDER BY i), '') AS chosen,
       coalesce(string_agg(CASE WHEN side = 'b' AND NOT head THEN piece END, '' ORDER BY i), '') AS rejected,
       coalesce(string_agg(CASE WHEN side = 'a' AND NOT head AND role = 'assistant' THEN CAST(s AS BIGINT) || ':' || CAST(s + said AS BIGINT) END, ',' ORDER BY i), '') AS chosen_mask,
       coalesce(string_agg(CASE WHEN side = 'b' AND NOT head AND role = 'assistant' THEN CAST(s AS BIGINT) || ':' || CAST(s + said AS BIGINT) END, ',' ORDER BY i), '') AS rejected_mask
FROM at_ GROUP BY conv_id, n_common
"""


@query("op2_preference_format", SQL)
def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as chosen; as rejected, the same with its last reply taken from its partner.

    Partners are the conversations 2k and 2k + 1; where the partner has no reply, the rejected side ends without one.
    """
    own = gathered(table(spark, sf_dir, "conversations"), "conv_id").withColumn("la", _last_reply(F.col("turns")))
    id_ = F.col("conv_id")
    replies = own.where("la > 0").select(
        F.when(F.pmod(id_, F.lit(2)) == 0, id_ + 1).otherwise(id_ - 1).alias("conv_id"), F.element_at("turns", F.col("la").cast("int"))["text"].alias("reply"))
    pairs = own.join(replies, "conv_id", "left")
    swapped = F.transform("turns", lambda t, i: F.struct(
        t["turn"].alias("turn"), t["role"].alias("role"), F.when(i + 1 == F.col("la"), F.col("reply")).otherwise(t["text"]).alias("text")))
    rejected = F.filter(swapped, lambda t: t["text"].isNotNull())
    return preference_pairs(pairs.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected")), "conv_id")
