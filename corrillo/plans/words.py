"""Words: top lists, rates, distinctive vocabulary and shifts, over documents (by source) and conversations (by role)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrillo.functions.text import CHAT_STOP_WORDS, STOP_WORDS, is_laugh, is_stop_word
from corrillo.plans.base import per_group, query, table, word_list, words

#: Thresholds of the distinctive vocabulary: content words of a sender, uses of a word, uses by the sender.
SENDER_WORDS, WORD_USES, PAIR_USES, PER_SENDER = 2000, 50, 10, 8
_LAUGH_SQL = "^(" + "|".join([*(f"a?[jh]+[aeiou]*{v}([jh]+{v}+)+[jh]*" for v in "aeiou"), "j[jks]*s[jks]*", "x+d+", "lo+l"]) + ")$"
_STOPS = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *CHAT_STOP_WORDS}))
_NOT_STOP = f"token NOT IN ({_STOPS}) AND length(token) > 1 AND NOT regexp_matches(token, '{_LAUGH_SQL}')"
_CONVERSATION = r"tokens AS (SELECT conv_id, turn, role AS sender, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM conversations)"
_DOCUMENTS = r"tokens AS (SELECT doc_id, source AS sender, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM documents)"
_CONTENT = f"content AS (SELECT * FROM tokens WHERE {_NOT_STOP} AND sender IS NOT NULL)"


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(table(spark, sf_dir, "conversations").withColumnRenamed("role", "sender"), "conv_id", "turn", "sender")


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(table(spark, sf_dir, "documents").withColumnRenamed("source", "sender"), "doc_id", "sender")


def content(tokens: DataFrame) -> DataFrame:
    """Counted by sender and token first; the stop-word test runs once per distinct pair."""
    pairs = tokens.where("sender IS NOT NULL").groupBy("sender", "token").agg(F.count("*").alias("uses"))
    return pairs.where(per_group(F.col("uses"), ~is_stop_word(F.col("token"))))


def top(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.groupBy("token").agg(F.sum("uses").alias("uses")).orderBy(F.desc("uses"), "token").limit(k)


@query(f"WITH {_CONVERSATION} SELECT token, count(*) AS uses FROM tokens GROUP BY token ORDER BY uses DESC, token LIMIT 10")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "token").limit(10)


@query(f"WITH {_CONVERSATION}, {_CONTENT} SELECT token, count(*) AS uses FROM content GROUP BY token ORDER BY uses DESC, token LIMIT 20")
def top_content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(content(conversation_words(spark, sf_dir)), 20)


@query(f"WITH {_DOCUMENTS}, {_CONTENT} SELECT token, count(*) AS uses FROM content GROUP BY token ORDER BY uses DESC, token LIMIT 80")
def cloud_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(content(document_words(spark, sf_dir)), 80)


@query(f"WITH {_DOCUMENTS} SELECT token, count(*) AS uses FROM tokens WHERE regexp_matches(token, '{_LAUGH_SQL}') GROUP BY token")
def laughs(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = document_words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("uses"))
    return uses.where(per_group(F.col("uses"), is_laugh(F.col("token"))))


@query(f"WITH {_DOCUMENTS} SELECT CASE token WHEN 'buen' THEN 'bueno' WHEN 'mal' THEN 'malo' WHEN 'gran' THEN 'grande' WHEN 'primer' THEN 'primero' WHEN 'tercer' THEN 'tercero' ELSE token END AS lemma, count(*) AS uses "
       "FROM tokens WHERE regexp_matches(token, '(os?|as?|es?|buen|mal|gran|primer|tercer)$') GROUP BY 1 ORDER BY uses DESC, lemma LIMIT 20")
def top_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top forms with adjective endings, apocopes under their long form."""
    from corrillo.functions.tagging import adjective_lemma

    uses = document_words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    uses = uses.where(per_group(F.col("n"), F.col("token").rlike("(os?|as?|es?|buen|mal|gran|primer|tercer)$")))
    return uses.groupBy(adjective_lemma(F.col("token")).alias("lemma")).agg(F.sum("n").alias("uses")).orderBy(F.desc("uses"), "lemma").limit(20)


@query(rf"""
SELECT count(*) AS messages, count(*) FILTER (spaces > 0) AS with_words, round(median(spaces) FILTER (spaces > 0), 4) AS median_by_spaces, round(median(tokens) FILTER (spaces > 0), 4) AS median_tokens
FROM (SELECT len(regexp_extract_all(text, '[^ \n\t]+')) AS spaces, len(regexp_extract_all(lower(text), '\p{{L}}+')) AS tokens FROM conversations)
""")
def word_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = F.array_remove(F.split("text", r"[ \n\t]+"), "")
    n = table(spark, sf_dir, "conversations").select(F.size(spaces).alias("spaces"), F.size(word_list("text")).alias("tokens"))
    some = lambda c: F.round(F.median(F.when(F.col("spaces") > 0, F.col(c))), 4)
    return n.agg(F.count("*").alias("messages"), F.count_if(F.col("spaces") > 0).alias("with_words"), some("spaces").alias("median_by_spaces"), some("tokens").alias("median_tokens"))


@query(f"""
WITH {_DOCUMENTS}, {_CONTENT}, n AS (SELECT sender, token, count(*) AS uses, row_number() OVER (PARTITION BY sender ORDER BY count(*) DESC, token) AS k FROM content GROUP BY sender, token)
SELECT sender, string_agg(token || ' (' || uses || ')', ', ' ORDER BY k) AS words FROM n WHERE k <= 5 GROUP BY sender
""")
def words_by_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("sender").orderBy(F.desc("uses"), "token"))
    ranked = content(document_words(spark, sf_dir)).withColumn("k", k).where("k <= 5")
    line = F.array_sort(F.collect_list(F.struct("k", F.concat("token", F.lit(" ("), F.col("uses").cast("string"), F.lit(")")).alias("t"))))
    return ranked.groupBy("sender").agg(F.array_join(F.transform(line, lambda x: x.t), ", ").alias("words"))


@query(f"""
WITH {_DOCUMENTS}, {_CONTENT},
top_senders AS (SELECT sender, count(*) AS total FROM content GROUP BY sender ORDER BY total DESC, sender LIMIT 15),
top_words AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS rank FROM content GROUP BY token ORDER BY count(*) DESC, token LIMIT 12)
SELECT sender, token, rank, round(1000.0 * count(*) / any_value(total), 6) AS per_mille FROM content JOIN top_senders USING (sender) JOIN top_words USING (token) GROUP BY sender, token, rank
""")
def word_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = content(document_words(spark, sf_dir))
    senders = pairs.groupBy("sender").agg(F.sum("uses").alias("total")).orderBy(F.desc("total"), "sender").limit(15)
    rank = F.row_number().over(Window.orderBy(F.desc("all"), "token")).cast("long")
    ranked = pairs.groupBy("token").agg(F.sum("uses").alias("all")).orderBy(F.desc("all"), "token").limit(12).withColumn("rank", rank).drop("all")
    joined = pairs.join(F.broadcast(senders), "sender").join(F.broadcast(ranked), "token")
    return joined.select("sender", "token", "rank", F.round(1000.0 * F.col("uses") / F.col("total"), 6).alias("per_mille"))


@query(f"""
WITH {_DOCUMENTS}, {_CONTENT}, dated AS (SELECT c.token, strftime(o_orderdate, '%Y-%m') AS month FROM content c JOIN orders ON o_orderkey = doc_id),
top_words AS (SELECT token FROM dated GROUP BY token ORDER BY count(*) DESC, token LIMIT 12),
months AS (SELECT month, count(*) AS total FROM dated GROUP BY month HAVING count(*) >= 1000)
SELECT month, token, round(1000.0 * count(*) / any_value(total), 6) AS per_mille FROM dated JOIN top_words USING (token) JOIN months USING (month) GROUP BY month, token
""")
def monthly_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    tokens = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "text").join(orders, "doc_id")
    pairs = content(words(tokens, "month").withColumnRenamed("month", "sender")).withColumnRenamed("sender", "month")
    months = pairs.groupBy("month").agg(F.sum("uses").alias("total")).where("total >= 1000")
    joined = pairs.join(F.broadcast(top(pairs, 12).select("token")), "token").join(F.broadcast(months), "month")
    return joined.select("month", "token", F.round(1000.0 * F.col("uses") / F.col("total"), 6).alias("per_mille"))


@query(f"""
WITH {_DOCUMENTS}, {_CONTENT},
senders AS (SELECT sender, count(*) AS total FROM content GROUP BY sender HAVING count(*) >= {SENDER_WORDS}),
pairs AS (SELECT sender, token, count(*) AS uses FROM content JOIN senders USING (sender) GROUP BY sender, token),
known AS (SELECT token, count(*) AS df FROM pairs GROUP BY token HAVING sum(uses) >= {WORD_USES}),
scores AS (
    SELECT sender, token, uses, uses::DOUBLE / total * ln((SELECT count(*) FROM senders)::DOUBLE / df) AS tfidf
    FROM pairs JOIN senders USING (sender) JOIN known USING (token) WHERE uses >= {PAIR_USES}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY round(tfidf, 10) DESC, token) AS k FROM scores)
SELECT sender, token, uses, round(tfidf, 8) AS tfidf, k AS rank FROM ranked WHERE k <= {PER_SENDER}
""")
def tfidf_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = content(document_words(spark, sf_dir))
    senders = pairs.groupBy("sender").agg(F.sum("uses").alias("total")).where(F.col("total") >= SENDER_WORDS)
    pairs = pairs.join(F.broadcast(senders), "sender")
    known = pairs.groupBy("token").agg(F.count("*").alias("df"), F.sum("uses").alias("all")).where(F.col("all") >= WORD_USES)
    scores = pairs.where(F.col("uses") >= PAIR_USES).join(known, "token").crossJoin(F.broadcast(senders.agg(F.count("*").alias("n"))))
    scores = scores.withColumn("tfidf", F.col("uses") / F.col("total") * F.log(F.col("n") / F.col("df")))
    rank = F.row_number().over(Window.partitionBy("sender").orderBy(F.desc(F.round("tfidf", 10)), "token"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= PER_SENDER).select("sender", "token", "uses", F.round("tfidf", 8).alias("tfidf"), "rank")


@query(f"""
WITH {_DOCUMENTS}, {_CONTENT}, half AS (SELECT token, doc_id > (SELECT max(doc_id) / 2 FROM documents) AS late FROM content),
counts AS (SELECT token, count(*) FILTER (late) AS now, count(*) FILTER (NOT late) AS before FROM half GROUP BY token HAVING count(*) >= 40),
totals AS (SELECT count(*) FILTER (late) AS all_now, count(*) FILTER (NOT late) AS all_before FROM half)
SELECT token, now, before, round((now / all_now) / nullif(before / all_before, 0), 6) AS ratio FROM counts, totals
""")
def word_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative frequency in the later half by that in the earlier one; null where the word is new."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "text")
    middle = table(spark, sf_dir, "documents").agg((F.max("doc_id") / 2).alias("middle"))
    halves = words(docs.crossJoin(F.broadcast(middle)).withColumn("sender", F.col("doc_id") > F.col("middle")), "sender")
    pairs = content(halves)
    side = lambda late: F.coalesce(F.sum(F.when(F.col("sender") == late, F.col("uses"))), F.lit(0))
    counts = pairs.groupBy("token").agg(side(True).alias("now"), side(False).alias("before")).where("now + before >= 40")
    totals = pairs.agg(side(True).alias("all_now"), side(False).alias("all_before"))
    ratio = (F.col("now") / F.col("all_now")) / F.nullif(F.col("before") / F.col("all_before"), F.lit(0.0))
    return counts.crossJoin(F.broadcast(totals)).select("token", "now", "before", F.round(ratio, 6).alias("ratio"))


_SHIFT = f"""
WITH {_DOCUMENTS}, {_CONTENT}, half AS (SELECT token, doc_id > (SELECT max(doc_id) / 2 FROM documents) AS late FROM content),
counts AS (SELECT token, count(*) FILTER (late) AS now, count(*) FILTER (NOT late) AS before FROM half GROUP BY token HAVING count(*) >= 40),
totals AS (SELECT count(*) FILTER (late) AS all_now, count(*) FILTER (NOT late) AS all_before FROM half),
shift AS (SELECT token, now, before, round((now / all_now) / nullif(before / all_before, 0), 6) AS ratio FROM counts, totals)
"""


@query(_SHIFT + "SELECT token, ratio, CAST(row_number() OVER (ORDER BY ratio DESC NULLS FIRST, token) AS INTEGER) AS rank FROM shift QUALIFY rank <= 30")
def word_shift_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by how much commoner they became, new ones (without a ratio) first."""
    first = word_shift(spark, sf_dir).orderBy(F.desc_nulls_first("ratio"), "token").limit(30)
    return first.select("token", "ratio", F.row_number().over(Window.orderBy(F.desc_nulls_first("ratio"), "token")).alias("rank"))  # 30 rows


@query(_SHIFT + """
, steady AS (SELECT * FROM shift WHERE now >= 20 AND before >= 20)
SELECT 'rising' AS side, token, ratio AS times FROM (SELECT * FROM steady ORDER BY ratio DESC, token LIMIT 12)
UNION ALL SELECT 'falling', token, round(1 / ratio, 6) FROM (SELECT * FROM steady ORDER BY ratio, token LIMIT 12)
""")
def rising_falling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve words of both halves that rose and fell most, by how many times."""
    steady = word_shift(spark, sf_dir).where("now >= 20 AND before >= 20")
    rising = steady.orderBy(F.desc("ratio"), "token").limit(12).select(F.lit("rising").alias("side"), "token", F.col("ratio").alias("times"))
    falling = steady.orderBy("ratio", "token").limit(12).select(F.lit("falling").alias("side"), "token", F.round(1 / F.col("ratio"), 6).alias("times"))
    return rising.unionAll(falling)


@query(f"""
WITH {_DOCUMENTS}, per_doc AS (SELECT doc_id, count(*) AS words FROM tokens GROUP BY doc_id)
SELECT d.doc_id, coalesce(words, 0) AS words FROM documents d LEFT JOIN per_doc USING (doc_id)
""")
def left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per document, 0 without any, by an outer join as where words are a table of their own."""
    per_document = words(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("words"))
    return table(spark, sf_dir, "documents").select("doc_id").join(per_document, "doc_id", "left").na.fill(0, ["words"])
