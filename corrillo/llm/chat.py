"""Chat formatting after a cumulative-snapshot collapse.

A logger that writes a conversation again after every turn leaves snapshots, each a prefix of the next. Every turn
gets the hash of its conversation up to there (rolling: the xor of the turns' hashes, each of which includes its
place, in two independent 64-bit halves). A conversation whose whole hash is another one's prefix hash at the same
length, that other being longer, goes in an anti-join; of equal conversations the smallest conv_id stays. What
remains is rendered, in the markup of `ROLE_OPEN` and `ROLE_CLOSE`.

Texts cross the network once to be placed and hashed, in a stored table; hashes are compared without them, and only the
turns of conversations that stay cross it again to be rendered.

A very long conversation is not one sort: turns are ranked and hashed in blocks of BLOCK_TURNS turn numbers, and the
blocks' sums run along the conversation. Only the rendered text of one conversation meets in one place, as it is one
value of the result.

Defined results: turns are ordered by (turn, role, text), nulls first; a null role renders as ROLE_UNKNOWN and hashes
as a value of its own, a null text renders and hashes as empty; repeated rows are turns of their own; rows whose
conv_id is null form one conversation; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrillo.llm.common import table, written

BLOCK_TURNS = 256
ROLE_OPEN, ROLE_CLOSE, ROLE_UNKNOWN = "<|im_start|>", "<|im_end|>\n", "unknown"


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(ROLE_OPEN), F.coalesce(role, F.lit(ROLE_UNKNOWN)), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(ROLE_CLOSE))


def placed(turns: DataFrame) -> DataFrame:
    """The turns of a table with n (the place from 1), block, and two halves h1, h2 of each turn's own hash; c and none stand for conv_id.

    One exchange of whole turns, by conversation and block, ranks them; where a block begins comes from the blocks' sizes.
    """
    key = (F.coalesce("conv_id", F.lit(0).cast(dict(turns.dtypes)["conv_id"])).alias("c"), F.col("conv_id").isNull().alias("none"))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**62))).cast("long").alias("block")
    text = F.coalesce("text", F.lit(""))
    before = Window.partitionBy("c", "none").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.select(*key, block).groupBy("c", "none", "block").agg(F.count("*").alias("rows"))
    firsts = sizes.select("c", "none", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("c", "none", "block").orderBy("turn", "role", "text"))
    ranked = turns.select(*key, block, "turn", "role", "text").withColumn("rank", rank)
    found = ranked.join(firsts, ["c", "none", "block"]).withColumn("n", F.col("first") + F.col("rank"))
    return found.select(
        "c", "none", "block", "n", rendered_turn(F.col("role"), F.col("text")).alias("piece"),
        F.xxhash64("n", F.col("role").isNull(), "role", text).alias("h1"),
        F.xxhash64(F.lit("second"), text, "role", F.col("role").isNull(), "n").alias("h2"),
    )


def prefix_hashes(found: DataFrame) -> DataFrame:
    """c, none, n, the two halves of the hash of all turns up to each, and whether it is the last; texts stay behind."""
    upto = Window.partitionBy("c", "none", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c", "none").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = found.select("c", "none", "block", "n", *(F.bit_xor(h).over(upto).alias(h) for h in ("h1", "h2")))
    sums = found.groupBy("c", "none", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.max("n").alias("last"))
    sums = sums.select("c", "none", "block", F.max("last").over(Window.partitionBy("c", "none")).alias("last"), *(F.coalesce(F.bit_xor(b).over(before), F.lit(0).cast("long")).alias(b) for b in ("b1", "b2")))
    return inner.join(sums, ["c", "none", "block"]).select(
        "c", "none", "n", F.col("h1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("b2")).alias("h2"), (F.col("n") == F.col("last")).alias("ends"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """c, none and n_turns of the conversations that no other one continues, one of each set of equal ones."""
    least = F.min(F.struct("none", "c"))  # a null id only if there is no other
    whole = prefixes.where("ends").groupBy("n", "h1", "h2").agg(least.alias("first"))
    inner = prefixes.where("NOT ends").select("n", "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("first.c", "first.none", F.col("n").alias("n_turns"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered text of every maximal conversation.

    The placed turns are a table: their hashes are read without the texts, and texts only of conversations that stay.
    """
    found = written(placed(turns), "chat-placed")
    kept = written(maximal(written(prefix_hashes(found), "chat-prefixes")), "chat-kept")
    pieces = F.array_sort(F.collect_list(F.struct("n", "piece")))
    lines = found.select("c", "none", "n", "piece").join(kept, ["c", "none"])
    rendered = lines.groupBy("c", "none").agg(F.max("n_turns").alias("n_turns"), F.array_join(F.transform(pieces, lambda p: p.piece), "").alias("rendered"))
    return rendered.select(F.when(~F.col("none"), F.col("c")).alias("conv_id"), "n_turns", "rendered")


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH placed AS (
    SELECT conv_id, role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
    FROM conversations),
prefixes AS (
    SELECT conv_id, n, md5(string_agg(coalesce('=' || role, '-') || chr(31) || text || chr(30), '') OVER (PARTITION BY conv_id ORDER BY n)) AS h
    FROM placed),
whole AS (SELECT conv_id, max(n) AS n, arg_max(h, n) AS h FROM prefixes GROUP BY conv_id),
firsts AS (SELECT n, h, min(conv_id) AS conv_id FROM whole GROUP BY n, h),
kept AS (
    SELECT conv_id, n FROM firsts f
    WHERE NOT EXISTS (SELECT 1 FROM prefixes p JOIN whole w ON p.conv_id IS NOT DISTINCT FROM w.conv_id WHERE p.n = f.n AND p.h = f.h AND p.n < w.n))
SELECT k.conv_id, CAST(k.n AS BIGINT) AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY p.n) AS rendered
FROM kept k JOIN placed p ON p.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.n
"""
