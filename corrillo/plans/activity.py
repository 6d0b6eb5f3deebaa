"""Who writes, what and when, over the timeline of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrillo.functions.times import boundary_days, boundary_seconds, iso_weekday, month_label
from corrillo.operators.ordering import previous, running
from corrillo.plans.base import query, table, timeline

#: Names of the ISO weekdays (fixed values), Monday first.
WEEKDAYS = ("lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo")


@query("""
SELECT user_id AS sender, count(*) AS messages, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
FROM events GROUP BY user_id
""")
def sender_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_sender = timeline(spark, sf_dir).groupBy("sender").agg(F.count("*").alias("messages"))
    total = per_sender.agg(F.sum("messages").alias("total"))  # one row
    return per_sender.crossJoin(F.broadcast(total)).select("sender", "messages", F.round(100.0 * F.col("messages") / F.col("total"), 6).alias("pct"))


@query("""
WITH n AS (SELECT user_id, count(*) AS messages FROM events GROUP BY user_id),
run AS (SELECT sum(messages) OVER (ORDER BY messages DESC, user_id ROWS UNBOUNDED PRECEDING) AS upto, sum(messages) OVER () AS total FROM n)
SELECT count(*) FILTER (upto <= 0.5 * total) + 1 AS people FROM run
""")
def sender_half_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many people write half of all messages; the running sum is over the senders, in ranges."""
    n = timeline(spark, sf_dir).groupBy("sender").agg(F.count("*").alias("messages")).withColumn("fewest", -F.col("messages"))
    upto = running(n, ["fewest", "sender"], "messages", "upto").crossJoin(F.broadcast(n.agg(F.sum("messages").alias("total"))))
    return upto.agg((F.count_if(F.col("upto") <= 0.5 * F.col("total")) + 1).alias("people"))


@query("""
SELECT event_type AS message_type, count(*) AS messages, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct,
       count(*) FILTER (value > 50) AS captioned
FROM events GROUP BY event_type
""")
def type_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = timeline(spark, sf_dir).groupBy("message_type").agg(F.count("*").alias("messages"), F.count_if(F.col("n_words") > 50).alias("captioned"))
    return n.withColumn("pct", F.round(100.0 * F.col("messages") / F.sum("messages").over(Window.partitionBy()), 6))


@query("""
SELECT user_id AS sender, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS longest, count(*) AS messages
FROM events WHERE value IS NOT NULL GROUP BY user_id HAVING count(*) >= 60
""")
def value_stats_per_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        timeline(spark, sf_dir).where("n_words IS NOT NULL").groupBy("sender")
        .agg(F.round(F.avg("n_words"), 6).alias("mean"), F.round(F.median("n_words"), 6).alias("median"), F.max("n_words").alias("longest"), F.count("*").alias("messages"))
        .where("messages >= 60")
    )


@query("""
SELECT event_id AS message_id, user_id AS sender, value AS n_words FROM events
WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 6)
""")
def top6_semi_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = timeline(spark, sf_dir)
    top = messages.groupBy("sender").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sender").limit(6)
    return messages.join(F.broadcast(top), "sender", "left_semi").select("message_id", "sender", "n_words")


@query("""
SELECT count(*) AS messages, count(DISTINCT user_id) AS people, count(*) FILTER (event_type = 'click') AS clicks,
       count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buyers, round(sum(value) FILTER (event_type = 'purchase'), 4) AS bought,
       round(median(value) FILTER (event_type = 'view'), 6) AS median_view, min(ts) AS first_at, max(ts) AS last_at
FROM events
""")
def totals_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind, x: F.when(F.col("message_type") == kind, F.col(x))
    return timeline(spark, sf_dir).agg(
        F.count("*").alias("messages"), F.count_distinct("sender").alias("people"), F.count_if(F.col("message_type") == "click").alias("clicks"),
        F.count_distinct(of("purchase", "sender")).alias("buyers"), F.round(F.sum(of("purchase", "n_words")), 4).alias("bought"),
        F.round(F.median(of("view", "n_words")), 6).alias("median_view"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
    )


@query("""
SELECT user_id AS sender, round(sum(value), 4) AS words, count(*) FILTER (event_type = 'view') AS views, count(*) AS messages
FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10
""")
def totals_per_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        timeline(spark, sf_dir).groupBy("sender")
        .agg(F.round(F.sum("n_words"), 4).alias("words"), F.count_if(F.col("message_type") == "view").alias("views"), F.count("*").alias("messages"))
        .orderBy(F.desc("messages"), "sender").limit(10)
    )


@query(f"""
SELECT {list(WEEKDAYS)}[isodow(ts)] AS weekday, count(*) AS messages, count(DISTINCT CAST(ts AS DATE)) AS days,
       round(count(*) / count(DISTINCT CAST(ts AS DATE)), 4) AS per_day
FROM events GROUP BY isodow(ts)
""")
def by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, WEEKDAYS))
    n = timeline(spark, sf_dir).groupBy(iso_weekday("timestamp").alias("d")).agg(F.count("*").alias("messages"), F.count_distinct(F.to_date("timestamp")).alias("days"))
    return n.select(F.element_at(names, F.col("d")).alias("weekday"), "messages", "days", F.round(F.col("messages") / F.col("days"), 4).alias("per_day"))


@query("SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS messages FROM events GROUP BY hour(ts)")
def by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).groupBy(F.hour("timestamp").cast("long").alias("hour")).agg(F.count("*").alias("messages"))


@query("SELECT CAST(isodow(ts) AS BIGINT) AS weekday, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS messages FROM events GROUP BY ALL")
def weekday_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).groupBy(iso_weekday("timestamp").cast("long").alias("weekday"), F.hour("timestamp").cast("long").alias("hour")).agg(F.count("*").alias("messages"))


@query("SELECT count(*) FILTER (hour(ts) BETWEEN 4 AND 7) AS early, count(*) AS messages FROM events")
def early_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_hour(spark, sf_dir).agg(F.sum(F.when(F.col("hour").between(4, 7), F.col("messages"))).alias("early"), F.sum("messages").alias("messages"))


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS messages, count(DISTINCT o_custkey) AS people, count(DISTINCT CAST(o_orderdate AS DATE)) AS active_days,
       count(DISTINCT CAST(o_orderdate AS DATE)) < day(last_day(min(CAST(o_orderdate AS DATE)))) AS incomplete
FROM orders GROUP BY 1
""")
def by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    n = o.groupBy(month_label("o_orderdate").alias("month")).agg(F.count("*").alias("messages"), F.count_distinct("o_custkey").alias("people"), F.count_distinct(day).alias("active_days"), F.min(day).alias("d"))
    return n.withColumn("incomplete", F.col("active_days") < F.dayofmonth(F.last_day("d"))).drop("d")


@query("""
SELECT min(ts) AS first_at, max(ts) AS last_at, date_diff('day', min(ts), max(ts)) + 1 AS calendar_days, count(DISTINCT CAST(ts AS DATE)) AS active_days,
       round(count(*) / (date_diff('day', min(ts), max(ts)) + 1), 4) AS per_day
FROM events
""")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = timeline(spark, sf_dir).agg(F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.count_distinct(F.to_date("timestamp")).alias("active_days"), F.count("*").alias("n"))
    return n.withColumn("calendar_days", boundary_days("first_at", "last_at") + 1).withColumn("per_day", F.round(F.col("n") / F.col("calendar_days"), 4)).drop("n")


@query("""
WITH steps AS (SELECT event_type, date_diff('second', lag(ts) OVER (ORDER BY event_id), ts) AS jump FROM events)
SELECT event_type AS kind, count(*) FILTER (jump < 0) AS backward, count(*) FILTER (jump < -3600) AS over_an_hour,
       round(median(-jump) FILTER (jump < 0), 4) AS median_seconds
FROM steps GROUP BY event_type
""")
def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = previous(timeline(spark, sf_dir), ["message_id"], ["timestamp"]).withColumn("jump", boundary_seconds("previous_timestamp", "timestamp"))
    back = F.when(F.col("jump") < 0, -F.col("jump"))
    return steps.groupBy(F.col("message_type").alias("kind")).agg(
        F.count(back).alias("backward"), F.count_if(F.col("jump") < -3600).alias("over_an_hour"), F.round(F.median(back), 4).alias("median_seconds"))


@query("""
WITH steps AS (SELECT l_orderkey, l_linenumber, l_shipdate, lag(l_shipdate) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS before FROM lineitem)
SELECT l_orderkey, l_linenumber, l_shipdate, before, date_diff('day', before, l_shipdate) AS days
FROM steps WHERE abs(date_diff('day', before, l_shipdate)) > 1500
""")
def big_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows far away from the one before, in the order of a composite key."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    steps = previous(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_shipdate"]).withColumnRenamed("previous_l_shipdate", "before").withColumn("days", boundary_days("before", "l_shipdate"))
    return steps.where(F.abs("days") > 1500).drop("l_partkey", "l_suppkey")


@query("SELECT event_type AS kind, event_id AS message_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def first_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", first).where("k = 1").select(F.col("event_type").alias("kind"), F.col("event_id").alias("message_id"), "value")


@query("""
SELECT event_type AS kind, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(avg(value), 6) AS mean
FROM events GROUP BY event_type
""")
def boxplot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(cuts.alias("q"), F.round(F.avg("value"), 6).alias("mean"))
    return n.select("kind", *(F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)), "mean")


@query("""
SELECT ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS recent, count(*) AS messages FROM events GROUP BY 1
""")
def recent_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = timeline(spark, sf_dir)
    last = messages.agg(F.max("timestamp").alias("last"))
    recent = F.col("timestamp") > F.col("last") - F.expr("INTERVAL '7' DAY")
    return messages.crossJoin(F.broadcast(last)).groupBy(recent.alias("recent")).agg(F.count("*").alias("messages"))


@query("""
WITH q AS (SELECT event_type AS kind, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT kind, round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS high,
       count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outside
FROM events JOIN q ON event_type = kind GROUP BY kind
""")
def boxplot_whiskers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The farthest values within one and a half times the box, and how many lie beyond."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "value")
    box = e.groupBy("kind").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))  # a row per type
    reach = (F.col("q")[1] - F.col("q")[0]) * 1.5
    least, most, value = F.col("q")[0] - reach, F.col("q")[1] + reach, F.col("value")
    return e.join(F.broadcast(box), "kind").groupBy("kind").agg(
        F.round(F.min(F.when(value >= least, value)), 6).alias("low"), F.round(F.max(F.when(value <= most, value)), 6).alias("high"), F.count_if((value < least) | (value > most)).alias("outside"))


@query("""
SELECT count(*) AS senders, count(*) FILTER (median < mean) AS skewed
FROM (SELECT user_id, avg(value) AS mean, median(value) AS median FROM events WHERE value IS NOT NULL GROUP BY user_id)
""")
def skewed_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders whose few long messages pull the mean above the median."""
    n = timeline(spark, sf_dir).where("n_words IS NOT NULL").groupBy("sender").agg(F.avg("n_words").alias("mean"), F.median("n_words").alias("median"))
    return n.agg(F.count("*").alias("senders"), F.count_if(F.col("median") < F.col("mean")).alias("skewed"))


@query("""
SELECT month, messages FROM (
    SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS messages, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, day(last_day(min(CAST(o_orderdate AS DATE)))) AS last
    FROM orders GROUP BY 1) WHERE days = last
""")
def full_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_month(spark, sf_dir).where("NOT incomplete").select("month", "messages")


@query("SELECT o_orderdate > (SELECT max(o_orderdate) - INTERVAL 1 YEAR FROM orders) AS recent, count(*) AS messages, count(DISTINCT o_custkey) AS people FROM orders GROUP BY 1")
def year_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    recent = F.col("o_orderdate") > F.col("last") - F.expr("INTERVAL '1' YEAR")
    return o.crossJoin(F.broadcast(last)).groupBy(recent.alias("recent")).agg(F.count("*").alias("messages"), F.count_distinct("o_custkey").alias("people"))


@query("SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, CAST(CAST(l_shipdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS year_before FROM lineitem WHERE day(l_shipdate) >= 28")
def year_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year before each day; before a leap day it is the 28th."""
    days = table(spark, sf_dir, "lineitem").where(F.dayofmonth("l_shipdate") >= 28).select(F.to_date("l_shipdate").alias("day")).distinct()
    return days.withColumn("year_before", F.col("day") - F.expr("INTERVAL '1' YEAR"))


@query("SELECT event_type AS kind, count(*) AS messages FROM events WHERE value > 25.5 AND event_type <> 'click' GROUP BY event_type")
def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a frame with values bound by name, never put into the text."""
    text = "SELECT event_type AS kind, count(*) AS messages FROM {events} WHERE value > :least AND event_type <> :but GROUP BY event_type"
    return spark.sql(text, args={"least": 25.5, "but": "click"}, events=table(spark, sf_dir, "events"))
