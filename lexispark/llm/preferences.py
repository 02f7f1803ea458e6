"""Preference formatting: one prompt for the common turns, paired completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.runtime import read_table

HEAD, TAIL = ("<|", "|>\n"), "<|end|>\n"


def opening(turn: Column) -> Column:
    return F.concat(F.lit(HEAD[0]), turn["role"], F.lit(HEAD[1]))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(opening(t), t["text"], F.lit(TAIL))), "")


def masks(turns: Column) -> Column:
    """Spans (start, end) in code points of `rendered(turns)` that count in the loss: what assistants say, with the end mark."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + F.char_length(opening(t))
        b = a + F.char_length(t["text"]) + len(TAIL)
        return F.struct(b.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, zero, step)["out"]


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations begin with alike."""
    shorter = F.least(F.size(a), F.size(b))
    differ = F.transform(F.sequence(F.lit(1), shorter + 1), lambda i: (i > shorter) | (F.get(a, i - 1) != F.get(b, i - 1)))
    return (F.array_position(differ, True) - 1).cast("int")


def format_preferences(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """`df` with n_common, prompt, chosen_text, rejected_text, chosen_mask, rejected_mask.

    `chosen` and `rejected` are arrays of (role, text). The longest common run
    of first turns is rendered once, as the prompt; each side's other turns
    are its completion, whose masks say what counts in the loss (never the prompt). Null
    arrays are empty, null roles and texts are empty strings. A side that the
    other one continues has an empty completion, as both have if they are
    equal. Row by row: no shuffle, repeated rows repeat, new columns replace
    ones of the same name.
    """
    turns = "array<struct<role:string,text:string>>"
    clean = lambda c: F.coalesce(F.transform(F.col(c).cast(turns), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))), F.array().cast(turns))
    kept = df.columns
    new = ["n_common", "prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask"]
    x = df.select("*", clean(chosen).alias("__a"), clean(rejected).alias("__b")).withColumn("__n", common_turns(F.col("__a"), F.col("__b")))
    rest = lambda c: F.slice(c, F.col("__n") + 1, F.size(c))
    x = x.withColumn("__ra", rest(F.col("__a"))).withColumn("__rb", rest(F.col("__b")))
    prompt = rendered(F.slice("__a", F.lit(1), F.col("__n")))
    values = [F.col("__n"), prompt, rendered(F.col("__ra")), rendered(F.col("__rb")), masks(F.col("__ra")), masks(F.col("__rb"))]
    return x.select(*(F.col(f"`{c}`") for c in kept if c not in new), *(v.alias(n) for v, n in zip(values, new)))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation up to its last reply, against itself with the last reply of the next id.

    Conversations without a reply give no pair; where the next id has none,
    the rejected reply is empty. Turns are ordered by number, then role, then text.
    """
    turn = F.struct("turn", "role", "text")
    # one example is one row, so its turns meet in one row; the longest conversation bounds it
    talks = conversations.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)))
    talks = talks.withColumn("last", last).filter("last IS NOT NULL")
    pair = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    chosen = talks.select("conv_id", F.transform(F.slice("turns", F.lit(1), F.col("last")), pair).alias("chosen"))
    reply = talks.select((F.col("conv_id") - 1).alias("conv_id"), F.element_at("turns", F.col("last"))["text"].alias("other"))
    worse = F.array_append(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.struct(F.lit("assistant").alias("role"), F.coalesce("other", F.lit("")).alias("text")))
    return chosen.join(reply, "conv_id", "left").select("conv_id", "chosen", worse.alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = format_preferences(swapped_replies(read_table(spark, sf_dir, "conversations")))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return x.select("conv_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen_text", "rejected_text", flat("chosen_mask"), flat("rejected_mask"))


SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(k) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT t.conv_id, t.text FROM t JOIN l ON t.conv_id = l.conv_id AND t.k = l.last),
s AS (
  SELECT t.conv_id, k, role, t.text AS a, CASE WHEN k < last THEN t.text ELSE coalesce(r.text, '') END AS b
  FROM t JOIN l ON t.conv_id = l.conv_id AND k <= last LEFT JOIN r ON r.conv_id = t.conv_id + 1),
n AS (SELECT conv_id, coalesce(min(CASE WHEN a <> b THEN k END), max(k) + 1) - 1 AS n_common FROM s GROUP BY conv_id),
u AS (
  SELECT s.conv_id, n_common, k, role,
         '<|' || role || '|>' || chr(10) || a || '<|end|>' || chr(10) AS ra, '<|' || role || '|>' || chr(10) || b || '<|end|>' || chr(10) AS rb
  FROM s JOIN n ON s.conv_id = n.conv_id),
v AS (
  SELECT *, sum(length(ra)) OVER w AS ea, sum(length(rb)) OVER w AS eb
  FROM u WHERE k > n_common WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
m AS (
  SELECT conv_id, string_agg(ra, '' ORDER BY k) AS chosen_text, string_agg(rb, '' ORDER BY k) AS rejected_text,
         string_agg((ea - length(ra) + length(role) + 5)::BIGINT || ':' || ea::BIGINT, ',' ORDER BY k) FILTER (role = 'assistant') AS chosen_mask,
         string_agg((eb - length(rb) + length(role) + 5)::BIGINT || ':' || eb::BIGINT, ',' ORDER BY k) FILTER (role = 'assistant') AS rejected_mask
  FROM v GROUP BY conv_id)
SELECT n.conv_id, n_common, coalesce(p.prompt, '') AS prompt, coalesce(chosen_text, '') AS chosen_text, coalesce(rejected_text, '') AS rejected_text,
       coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask
FROM n LEFT JOIN (SELECT conv_id, string_agg(ra, '' ORDER BY k) AS prompt FROM u WHERE k <= n_common GROUP BY conv_id) p ON p.conv_id = n.conv_id
LEFT JOIN m ON m.conv_id = n.conv_id
"""
