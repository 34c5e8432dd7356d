"""Chat formatting: preference pairs with the common turns as prompt.

A pair is a chosen and a rejected conversation. Their longest common turn prefix (equal role and text, turn by turn) is
rendered once as the prompt; what each side adds is its completion. Masks are character spans of the completion that carry
loss: the turns of assistants without their headers.

Input turns are (pair_id, side, pos, role, text), ``side`` being ``chosen`` or ``rejected``; turns are ordered by pos, then
role and text, so repeated positions have a defined order. A null role reads as ``user``, a null text as empty; rows with
a null pair_id or side are no part of a pair. A pair that lacks a side has an empty prompt and a null completion there.
Both sides equal: all turns are prompt and both completions are empty. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
HEAD = len(OPEN) + len(CLOSE)


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """[from, to) of each assistant's text and end mark in the rendered turns, which carry their own size and the running
    size ``upto`` of their pair's turns."""
    origin = F.get(turns, F.lit(0))["upto"] - F.get(turns, F.lit(0))["size"]
    carrying = F.filter(turns, lambda t: t["role"] == "assistant")
    span = lambda t: F.struct((t["upto"] - t["size"] + HEAD - origin + F.length(t["role"])).cast("int").alias("lo"), (t["upto"] - origin).cast("int").alias("hi"))
    return F.when(F.size(turns) > 0, F.transform(carrying, span)).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask; one row a pair."""
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    size = (HEAD + F.length("role") + F.length("text") + len(END)).cast("long")
    turns = turns.filter("pair_id is not null and side is not null").select("pair_id", "side", "pos", role.alias("role"), text.alias("text"))
    # sizes are summed up by a window over the same exchange that brings the turns of a pair together
    along = Window.partitionBy("pair_id").orderBy("side", "pos", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("size", size).withColumn("upto", F.sum("size").over(along))
    turn = F.struct("pos", "role", "text", "upto", "size")
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, turn)))  # noqa: E731  # the turns of one conversation
    pairs = turns.groupBy("pair_id").agg(side("chosen").alias("a"), side("rejected").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    parted = F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1
    pairs = pairs.withColumn("n", F.coalesce(parted, F.size(same)).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c) - F.col("n"))
    some = lambda c, x: F.when(F.size(c) > 0, x)
    return pairs.select(
        "pair_id",
        F.col("n").cast("long").alias("n_common"),
        rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        some("a", rendered(rest("a"))).alias("chosen"),
        some("b", rendered(rest("b"))).alias("rejected"),
        some("a", loss_spans(rest("a"))).alias("chosen_mask"),
        some("b", loss_spans(rest("b"))).alias("rejected_mask"),
    )


def branched_pairs(conversations: DataFrame) -> DataFrame:
    """A preference pair of each conversation: the whole of it as chosen, and as rejected a branch that goes astray at one
    of its answers, where an earlier answer is given again, and goes on with the turns that followed.

    A hash of the id picks the answer (any but the first) and the earlier one. Where both have one text, the branches part
    nowhere; so how far their turns agree is left to the search. A conversation of fewer than two answers has no branch:
    its pair lacks the rejected side. Turns whose conv_id is null are no part of a conversation. Turns of equal number are
    ordered by role and text."""
    turn = F.struct(F.col("turn").alias("pos"), "role", "text")
    talks = conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))  # one conversation
    found = F.filter(F.transform("t", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    draw = F.conv(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8), 16, 10).cast("long")
    talks = talks.withColumns({"answers": found, "draw": draw})
    talks = talks.withColumn("pick", F.when(F.size("answers") > 1, (F.col("draw") % (F.size("answers") - 1) + 1).cast("int")))
    old = (F.col("draw") % F.col("pick")).cast("int")
    talks = talks.withColumns({"astray": F.get("answers", F.col("pick")), "said": F.get("t", F.get("answers", old))["text"]})
    branch = F.transform("t", lambda x, i: F.struct(i.alias("pos"), x["role"].alias("role"), F.when(i == F.col("astray"), F.col("said")).otherwise(x["text"]).alias("text")))
    chosen = F.transform("t", lambda x, i: F.struct(i.alias("pos"), x["role"].alias("role"), x["text"].alias("text")))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), chosen.alias("t")), F.struct(F.lit("rejected").alias("side"), F.when(F.col("pick").isNotNull(), branch).alias("t")))
    return talks.select(F.col("conv_id").alias("pair_id"), F.inline(sides)).select("pair_id", "side", F.inline("t"))


def op6_preference_format(spark, sf_dir: str) -> DataFrame:
    out = format_preferences(branched_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    flat = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws("-", s["lo"].cast("string"), s["hi"].cast("string"))))
    masks = [F.when(F.col(c).isNotNull(), flat(c)).alias(c) for c in ("chosen_mask", "rejected_mask")]
    return out.select("pair_id", "n_common", "prompt", "chosen", "rejected", *masks)


_SHOWN = "'<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)"


def _joined(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda x: {_SHOWN}), ''), '')"


def _spans(turns: str) -> str:
    upto = f"coalesce(list_sum(list_transform({turns}[1 : i], lambda x: length({_SHOWN}))), 0)"
    text = f"length({turns}[i].text)"
    own = f"list_filter(generate_series(1, len({turns})), lambda i: {turns}[i].role = 'assistant')"
    return f"coalesce(array_to_string(list_transform({own}, lambda i: CAST(CAST({upto} AS BIGINT) - {text} - 8 AS VARCHAR) || '-' || CAST(CAST({upto} AS BIGINT) AS VARCHAR)), ','), '')"


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, 'user'), 'text': coalesce(text, '')}} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS t,
         list(role ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS roles
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
a AS (SELECT conv_id, t, list_filter(generate_series(1, len(t)), lambda i: roles[i] = 'assistant') AS ans, CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) AS draw FROM t),
k AS (SELECT *, CASE WHEN len(ans) > 1 THEN draw % (len(ans) - 1) + 1 END AS pick FROM a),
b AS (
  SELECT conv_id, t AS a, CASE WHEN pick IS NOT NULL THEN list_transform(generate_series(1, len(t)), lambda i: {{'role': t[i].role, 'text': CASE WHEN i = ans[pick + 1] THEN t[ans[draw % pick + 1]].text ELSE t[i].text END}}) END AS b FROM k),
n AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_min(list_filter(generate_series(1, len(a)), lambda i: a[i].role <> b[i].role OR a[i].text <> b[i].text)) - 1, len(a)) END AS n FROM b),
r AS (SELECT conv_id, n, a[1 : n] AS head, a[n + 1 :] AS a, b[n + 1 :] AS b FROM n)
SELECT conv_id AS pair_id, CAST(n AS BIGINT) AS n_common, {_joined("head")} AS prompt, {_joined("a")} AS chosen, CASE WHEN b IS NOT NULL THEN {_joined("b")} END AS rejected,
  {_spans("a")} AS chosen_mask, CASE WHEN b IS NOT NULL THEN {_spans("b")} END AS rejected_mask
FROM r
"""
