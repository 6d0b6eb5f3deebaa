"""Patterns in texts: line ends, marks, masks, notices, characters and emojis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrillo.functions import text as t
from corrillo.operators.silver import notice_patterns
from corrillo.plans.base import query, table

#: Patterns of notices, the first that fits (fixed values, for the driver's documents).
NOTICES = (("capitals", r"^[A-Z]+!!"), ("table", r" \| "), ("symbols", r"(###|\$\$\$|%%%|&&&|\*\*\*)"), ("token", r"token ="), ("email", r"@[\w-]+\."), ("digits", r"[0-9]{8}"))


def _list(texts: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in texts) + "]"


@query(r"""
SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) AS line_feeds, length(text) - length(replace(text, chr(13), '')) AS returns,
       (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2 AS pairs, starts_with(text, chr(65279)) AS marked
FROM documents""")
def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(text).cast("long").alias("chars"), t.occurrences(text, "\n").alias("line_feeds"), t.occurrences(text, "\r").alias("returns"), t.occurrences(text, "\r\n").alias("pairs"),
        text.startswith("\ufeff").alias("marked"))


@query("SELECT doc_id, CAST(i AS BIGINT) AS record_no, records[i] AS record FROM (SELECT doc_id, string_split(text, chr(10)) AS records FROM documents) t, range(1, len(records) + 1) r(i) WHERE records[i] <> ''")
def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "record"))
    return found.where("record <> ''").select("doc_id", (F.col("i") + 1).cast("long").alias("record_no"), "record")


@query(f"SELECT CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in NOTICES)} ELSE 'none' END AS pattern, count(*) AS documents FROM documents GROUP BY 1")
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.lit("none")
    for name, pattern in reversed(NOTICES):
        found = F.when(F.col("text").rlike(pattern), name).otherwise(found)
    return table(spark, sf_dir, "documents").groupBy(found.alias("pattern")).agg(F.count("*").alias("documents"))


@query(r"SELECT source, regexp_extract(text, 'token = \"([0-9a-f]{4})', 1) AS marker, count(*) AS documents, count(*) FILTER (length(text) > 2000) AS longer FROM documents WHERE regexp_matches(text, 'token = \"') GROUP BY ALL")
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.regexp_extract("text", 'token = "([0-9a-f]{4})', 1)
    found = table(spark, sf_dir, "documents").where(F.col("text").rlike('token = "'))
    return found.groupBy("source", marker.alias("marker")).agg(F.count("*").alias("documents"), F.count_if(F.length("text") > 2000).alias("longer"))


@query(r"""
SELECT role, count(*) FILTER (contains(text, '?')) AS asks, count(*) FILTER (contains(text, chr(10))) AS multiline, max(len(string_split(text, chr(10)))) AS most_lines, round(median(length(text)), 4) AS median_length
FROM conversations GROUP BY role""")
def text_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count_if(text.contains("?")).alias("asks"), F.count_if(text.contains("\n")).alias("multiline"), F.max(F.size(F.split(text, "\n", -1))).cast("long").alias("most_lines"),
        F.round(F.median(F.length(text)), 4).alias("median_length"))


@query(r"""
WITH marks AS (SELECT unnest(list_filter(regexp_extract_all(text, '(###|%%%|&&&)'), lambda m: m <> '&&&')) AS mark FROM documents)
SELECT mark, count(*) AS uses FROM marks GROUP BY mark""")
def content_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.regexp_extract_all("text", F.lit("(###|%%%|&&&)"), F.lit(1)), lambda m: m != "&&&")
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("mark")).groupBy("mark").agg(F.count("*").alias("uses"))


@query(r"SELECT doc_id, regexp_replace(text, '[\w.+-]+@[\w-]+(\.[\w-]+)+', '[correo]', 'g') AS masked FROM documents WHERE contains(text, '@')")
def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", t.mask_emails(F.col("text")).alias("masked"))


@query(r"SELECT page_id, '[url:' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www[.]', '') || ']' AS masked FROM pages WHERE regexp_matches(url, '^https?://[^\s<>\"]+$')")
def mask_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").rlike(r'^https?://[^\s<>"]+\z')).select("page_id", t.mask_urls(F.col("url")).alias("masked"))


@query()
def mask_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document. Needs look-around, which the other engine's patterns lack."""
    return table(spark, sf_dir, "documents").select("doc_id", t.mask_numbers(F.col("text")).alias("masked"))


@query("""
WITH chars(name, c) AS (VALUES ('line feed', chr(10)), ('e acute', 'é'), ('bang', '!'), ('bar', '|'))
SELECT name, CAST((SELECT sum(length(text) - length(replace(text, c, ''))) FROM documents) AS BIGINT) AS uses FROM chars""")
def codepoint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a short list are counted in one pass, then turned into rows."""
    chars = (("line feed", "\n"), ("e acute", "é"), ("bang", "!"), ("bar", "|"))
    one = table(spark, sf_dir, "documents").agg(*(F.sum(t.occurrences(F.col("text"), c)).alias(n) for n, c in chars))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("uses")) for n, _ in chars))).alias("r")).select("r.*")


@query("SELECT pattern, doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY doc_id) AS k FROM (SELECT lang AS pattern, doc_id, left(text, 60) AS text FROM documents)) WHERE k = 1")
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("pattern").orderBy("doc_id"))
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("pattern"), "doc_id", F.substring("text", 1, 60).alias("text"))
    return docs.withColumn("k", first).where("k = 1").drop("k")


#: What is put after the conversations' texts, which have no emojis, turn by turn.
TAILS = ("", " \U0001f602\U0001f602", " \U0001f469\U0001f3fe\u200d\U0001f680 a", " \U0001f1f2\U0001f1fd\U0001f1ea\U0001f1f8", " 3\ufe0f\u20e3 \u2764\ufe0f :-) \u00a9")


@query(rf"""
WITH found AS (SELECT unnest(regexp_extract_all(text || {_list(TAILS)}[turn % {len(TAILS)} + 1], '{t.EMOJI}')) AS emoji FROM conversations)
SELECT count(*) AS emojis, count(DISTINCT emoji) AS distinct_emojis, count(*) FILTER (contains(emoji, chr(8205))) AS joined, count(*) FILTER (regexp_matches(emoji, '[\x{{1F3FB}}-\x{{1F3FF}}]')) AS toned
FROM found""")
def emoji_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emojis of all texts, each with a tail of emojis, with joined sequences and skin tones."""
    tail = F.get(F.array(*map(F.lit, TAILS)), F.pmod("turn", F.lit(len(TAILS))).cast("int"))
    found = table(spark, sf_dir, "conversations").select(F.explode(t.emojis(F.concat("text", tail))).alias("emoji"))
    return found.agg(F.count("*").alias("emojis"), F.count_distinct("emoji").alias("distinct_emojis"), F.count_if(F.col("emoji").contains("\u200d")).alias("joined"), F.count_if(F.col("emoji").rlike(r"[\x{1F3FB}-\x{1F3FF}]")).alias("toned"))


#: Bodies of notices with invented names, by the number of an event.
BODIES = tuple(body.format("\u200e") for body in (
    "{}Meta AI pinned a message", "{}Eva pinned a message", "{}Eva pinned a message!", "{}Eva changed the group description", "{}Eva changed the group name to X", "{}Eva was added", "{}Eva added Leo",
    "{}Eva removed Leo", "{}Eva left", "{}Leo joined using a link", "{}Eva turned on admin approval to join", "{}Eva changed the settings", "{}Messages are end-to-end encrypted.", "{}This message was deleted by admin Eva.",
    "{}This message was deleted.", "{}Location: https://maps.example.org", "{}something else"))


@query(f"""
WITH bronze AS (
    SELECT {_list(BODIES)}[event_id % {len(BODIES)} + 1] AS body,
           CASE WHEN contains(body, 'deleted') THEN 'deleted' WHEN contains(body, 'Location') THEN 'location' WHEN event_type = 'click' THEN 'text' ELSE 'system_notice' END AS kind FROM events)
SELECT kind, CASE WHEN contains(body, 'Meta AI') THEN 'Meta AI' WHEN suffix(body, ' pinned a message') THEN 'pinned a message' WHEN suffix(body, ' changed the group description') THEN 'changed the description'
    WHEN contains(body, ' changed the group name') THEN 'changed the name' WHEN suffix(body, ' was added') THEN 'was added' WHEN contains(body, ' added ') THEN 'added' WHEN contains(body, ' removed ') THEN 'removed'
    WHEN suffix(body, ' left') THEN 'left' WHEN contains(body, ' joined ') THEN 'joined' WHEN contains(body, 'admin approval') OR contains(body, 'changed the settings') THEN 'changed the settings'
    WHEN contains(body, 'end-to-end encrypted') THEN 'encrypted' WHEN contains(body, 'by admin') THEN 'deleted by an admin' WHEN kind IN ('deleted', 'location') THEN kind ELSE 'other' END AS pattern,
    count(*) AS records
FROM bronze WHERE kind <> 'text' GROUP BY ALL""")
def notice_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the notices of a chat say, on a chat made of the events' numbers."""
    body = F.get(F.array(*map(F.lit, BODIES)), F.pmod("event_id", F.lit(len(BODIES))).cast("int"))
    kind = F.when(F.col("body").contains("deleted"), "deleted").when(F.col("body").contains("Location"), "location").when(F.col("event_type") == "click", "text").otherwise("system_notice")
    return notice_patterns(table(spark, sf_dir, "events").select("event_type", body.alias("body")).withColumn("kind", kind))
