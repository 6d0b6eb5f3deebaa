"""URL filters by a temporal list join.

A list is a log of dated entries (pattern, date, add or remove). Per pattern, each entry holds until the next one, so
the adds become disjoint validity intervals; a capture is judged by the entries in force at its fetch time. A pattern
is a host, which also covers its subdomains, or a host and the first segment of its path.

Captures are first reduced to distinct (page_id, url, fetch_time), so that a hot page is joined once; their keys then
meet the intervals by equality, with the interval as a condition. A list of up to BROADCAST_ENTRIES entries (checked
by a count) is broadcast; a larger one is joined by a shuffle on pattern and one of SALTS salts, the list repeated for
each salt, so that one host's captures spread over many tasks.

Defined results: a null or unparsable url has host '' and is not blocked; a null fetch time meets no interval; entries
of one pattern and date count in the order add, remove; repeated captures give a row each; a very long url is judged
whole; empty tables give an empty result (no captures) or nothing blocked (no entries); other columns, whatever their
names, are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrillo.llm.common import table

BROADCAST_ENTRIES = 100_000
SALTS = 32
#: A host as it stands in a url, an IPv6 address in its brackets.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"
ROOT_DOTS = r"\.+$"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"
#: The crawl's clock: page k is fetched k hours after its start, within CRAWL_HOURS.
CRAWL_START, CRAWL_HOURS = "2024-01-01 00:00:00", 8784
#: The dated list of the registered query (fixed values; read_entries() reads any other): host without top-level domain, path, date, action, category.
HISTORY = (
    ("spam-farm.example", "", "2024-01-03", "add", "spam"),
    ("spam-farm.example", "", "2024-04-01", "remove", "spam"),
    ("spam-farm.example", "", "2024-06-15", "add", "spam"),
    ("adult-x.example", "", "2024-01-01", "add", "adult"),
    ("adult-x.example", "", "2024-01-09", "remove", "adult"),
    ("adult-x.example", "", "2024-01-10", "add", "adult"),
    ("adult-x.example", "/en", "2024-01-09", "add", "adult"),
    ("spam-farm.example", "/es", "2024-05-01", "add", "spam"),
    ("casino-win.example", "", "2024-01-01", "add", "gambling"),
    ("free-bets.example", "", "2024-01-01", "add", "gambling"),
    ("ads-track.example", "", "2024-01-01", "add", "ads"),
    ("cheap-pills.example", "", "2024-01-01", "add", "spam"),
)
#: The hosts are listed under each of these; the tables' pages have no others.
TOP_LEVELS = ("com", "net", "org")
#: pattern, date, action, category.
ENTRIES = tuple((f"{host}.{top}{path}", *rest) for host, path, *rest in HISTORY for top in TOP_LEVELS)


def host_of(url: Column) -> Column:
    """In lower case, without the dot of the root; an address is a host without parents."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), ROOT_DOTS, ""), F.lit(""))


def url_keys(url: Column) -> Column:
    """The host, every parent domain of it, and the host and its parents with the first path segment."""
    host = host_of(url)
    address = host.rlike(r"^\[|^[0-9.]+$")
    labels = F.when(address, F.array(host)).otherwise(F.split(host, r"\.", -1))
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.coalesce(F.regexp_extract(url, SEGMENT, 1), F.lit(""))
    paths = F.when(segment != "", F.transform(names, lambda n: F.concat(n, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(names, paths))


def validity(entries: DataFrame) -> DataFrame:
    """pattern, category, valid_from, valid_to (null: still in force) of every add."""
    order = Window.partitionBy("pattern").orderBy("at", "action", "category")
    return (
        entries.where("pattern IS NOT NULL AND at IS NOT NULL").withColumn("valid_to", F.lead("at").over(order))
        .where("action = 'add' AND (valid_to IS NULL OR valid_to > at)")
        .select("pattern", "category", F.col("at").alias("valid_from"), "valid_to")
    )


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, host, fetch_time, n_rules, blocked, rule (the longest pattern in force, then the first) and its category."""
    distinct = captures.groupBy("page_id", "url", "fetch_time").agg(F.count("*").alias("copies"))
    keyed = distinct.withColumn("key", F.explode_outer(url_keys(F.col("url"))))
    rules = validity(entries)
    if entries.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES:
        rules, on = F.broadcast(rules), F.col("key") == F.col("pattern")
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetch_time"), F.lit(SALTS)).cast("int"))
        rules = rules.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = (F.col("key") == F.col("pattern")) & (F.col("salt") == F.col("rule_salt"))
    during = (F.col("fetch_time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_time") < F.col("valid_to")))
    best = F.min(F.when(F.col("pattern").isNotNull(), F.struct((-F.length("pattern")).alias("order"), "pattern", "category")))
    return (
        keyed.join(rules, on & during, "left")
        .groupBy("page_id", "url", "fetch_time").agg(F.first("copies").alias("copies"), F.count("pattern").alias("n_rules"), best.alias("best"))
        .select(
            "page_id", "url", host_of(F.col("url")).alias("host"), "fetch_time", "n_rules", (F.col("n_rules") > 0).alias("blocked"),
            F.col("best.pattern").alias("rule"), F.col("best.category").alias("category"),
            F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        ).drop("copy")
    )


def crawl_time(page_id: Column) -> Column:
    hours = F.pmod(page_id, F.lit(CRAWL_HOURS)).cast("int")
    return F.lit(CRAWL_START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours)


def list_entries(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{p}', timestamp_ntz'{d} 00:00:00', '{a}', '{c}')" for p, d, a, c in ENTRIES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS entries(pattern, at, action, category)")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """A dated list from CSV files with a header: pattern, at, action, category. Patterns are compared in lower case, without the dot of the root.

    Lines without a pattern, a readable time or one of the two actions are no entries.
    """
    found = spark.read.csv(path, header=True, schema="pattern string, at string, action string, category string")
    host, rest = F.substring_index("pattern", "/", 1), F.regexp_extract("pattern", "/.*$", 0)
    pattern = F.concat(F.regexp_replace(F.lower(F.trim(host)), ROOT_DOTS, ""), rest)
    entries = found.select(pattern.alias("pattern"), F.try_to_timestamp("at").cast("timestamp_ntz").alias("at"), F.lower(F.trim("action")).alias("action"), "category")
    return entries.where("pattern <> '' AND at IS NOT NULL AND action IN ('add', 'remove')")


def op7_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", crawl_time(F.col("page_id")).alias("fetch_time"))
    return judged(pages, list_entries(spark))


OP7_SQL = f"""
WITH entries(pattern, since, action, category) AS (VALUES {", ".join(f"('{p}', TIMESTAMP '{d} 00:00:00', '{a}', '{c}')" for p, d, a, c in ENTRIES)}),
rules AS (
    SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since, action, category) AS until FROM entries)
    WHERE action = 'add' AND (until IS NULL OR until > since)),
captures AS (
    SELECT row_number() OVER () AS rid, page_id, url,
           TIMESTAMP '{CRAWL_START}' + to_hours(CAST(((page_id % {CRAWL_HOURS}) + {CRAWL_HOURS}) % {CRAWL_HOURS} AS INTEGER)) AS fetch_time,
           coalesce(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '{ROOT_DOTS}', ''), '') AS host, coalesce(regexp_extract(url, '{SEGMENT}', 1), '') AS segment
    FROM pages),
active AS (
    SELECT c.rid, r.pattern, r.category, row_number() OVER (PARTITION BY c.rid ORDER BY length(r.pattern) DESC, r.pattern, r.category) AS k,
           count(*) OVER (PARTITION BY c.rid) AS n
    FROM captures c JOIN rules r
      ON (c.host = split_part(r.pattern, '/', 1) OR ends_with(c.host, '.' || split_part(r.pattern, '/', 1)))
     AND (NOT contains(r.pattern, '/') OR split_part(r.pattern, '/', 2) = c.segment)
     AND c.fetch_time >= r.since AND (r.until IS NULL OR c.fetch_time < r.until))
SELECT page_id, url, host, fetch_time, CAST(coalesce(n, 0) AS BIGINT) AS n_rules, n IS NOT NULL AS blocked, pattern AS rule, category
FROM captures LEFT JOIN active ON captures.rid = active.rid AND k = 1
"""
