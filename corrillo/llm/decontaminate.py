"""Benchmark decontamination by a distributed positional inverted index (DataFrame functions only).

1. Every document word that is also a test term becomes a posting (term, document, position) in a stored table; a
   posting without a term closes each document, its position being the number of words. Texts are read and cut once.
2. The postings give each test term's corpus frequency. Of the five rarest terms of a window of 13, those of frequency 0
   included, any match (10 words or more in place) has two in place; alignments (document, item, shift) with two seeds
   of an item among their offset-adjusted postings are the candidates, so that no match is lost.
3. Round each candidate the offset-adjusted postings of the other terms are intersected; runs of consecutive item
   words as long as a window are phrase matches, windows with any PROXIMITY_WORDS of their words in place proximity matches.

A window is WINDOW consecutive item words, or the whole item if it has fewer. The test vocabulary is broadcast only up
to BROADCAST_TERMS terms (counted first), the candidates' documents up to BROADCAST_DOCUMENTS; beyond that they meet the postings by a shuffle join. Postings of hot terms
are never gathered: they are only counted with a partial aggregation and looked up by (document, term, position).

Defined results: null texts have no words; n_words, hits and items of repeated rows are those of each row for itself;
documents are told apart by doc_id and text together, so that repeated or null doc_ids do no harm; items with the same
item_id count once; a null item_id shows as an empty string; without documents the result is empty, without items
nothing is hit; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrillo.llm.common import drop_keys, row_keys, table, written

WINDOW = 13
PROXIMITY_WORDS = 10
#: Seed terms of a window that a candidate has in place; 2 is what the least and the greatest seed in place can tell.
SEEDS_IN_PLACE = 2
BROADCAST_TERMS = 200_000
BROADCAST_DOCUMENTS = 500_000
#: What lies between words of either case; the contract's class before lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """All words in order; split() leaves an empty string before the first and after the last separator."""
    return F.array_remove(F.coalesce(F.split(text, BETWEEN), F.array().cast("array<string>")), "")


def lowered(word: Column) -> Column:
    """A-Z only; lower() does the same to a word of ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def item_terms(benchmark: DataFrame) -> DataFrame:
    """item, item_id, n (words of the item), i (place from 0), term, tid."""
    found = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    found = found.select(F.xxhash64("item_id", F.col("item_id").isNull(), "text").alias("item"), F.coalesce("item_id", F.lit("")).alias("item_id"), words(F.col("text")).alias("w"))
    found = found.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    return found.select("item", "item_id", "n", "i", lowered(F.col("word")).alias("term")).withColumn("tid", F.xxhash64("term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: tid, k1, k2 (document), pos of every document word that is a test term, and each row's closing posting.

    The keys and words of a text are computed below the explode and, as it is an outer one, not a second time in a filter.
    """
    vocabulary = small(terms.select("term", "tid").distinct(), BROADCAST_TERMS)
    closed = F.array_append(words(F.col("text")), F.lit(None).cast("string"))
    found = docs.select(*row_keys(), F.col("doc_id").isNull().alias("no_id"), closed.alias("w"))
    tokens = found.select("k1", "k2", "no_id", F.posexplode_outer("w").alias("pos", "word")).withColumn("term", lowered(F.col("word")))
    return tokens.join(vocabulary, "term", "left").where("tid IS NOT NULL OR word IS NULL").select("tid", "k1", "k2", "no_id", "pos")


def documents(index: DataFrame) -> DataFrame:
    """k1, k2, doc_id, n_words of every row, from its closing posting."""
    return index.where("tid IS NULL").select("k1", "k2", F.when(~F.col("no_id"), F.col("k1")).alias("doc_id"), F.col("pos").cast("long").alias("n_words"))


def seeds(index: DataFrame, terms: DataFrame, window: int, least: int) -> DataFrame:
    """item, i, tid, need: the rarest terms of each window, of which any match has at least `need` in place.

    A match of a window of `size` words has `required` of them in place, so of any size - required + need words at least
    `need`. Words that no document has are among the rarest: they may be the changed ones.
    """
    frequency = index.where("tid IS NOT NULL").groupBy("tid").agg(F.count("*").alias("tf"))
    ahead = Window.partitionBy("item").orderBy("i").rowsBetween(0, window - 1)
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("tf", F.lit(0)).alias("tf"), "i", "tid")).over(ahead))
    whole = (F.col("i") + window <= F.col("n")) | ((F.col("n") < window) & (F.col("i") == 0))
    size = F.least(F.lit(window), F.col("n"))
    required = F.least(F.lit(least), size)
    need = F.least(F.lit(SEEDS_IN_PLACE), required)
    rarest = terms.join(frequency, "tid", "left").withColumn("r", ranked).where(whole)
    rarest = rarest.select("item", need.alias("need"), F.explode(F.slice("r", F.lit(1), size - required + need)).alias("s"))
    return rarest.select("item", "s.i", "s.tid", "need").distinct()


def small(df: DataFrame, bound: int) -> DataFrame:
    """df marked for broadcast if it has no more than `bound` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def aligned(index: DataFrame, terms: DataFrame, window: int, least: int) -> DataFrame:
    """k1, k2, item, n, shift, i: item words in place around a candidate alignment (pos = shift + i)."""
    best = small(written(seeds(index, terms, window, least), "decontaminate-seeds"), BROADCAST_TERMS)
    met = index.join(best, "tid").select("k1", "k2", "item", (F.col("pos") - F.col("i")).alias("shift"), "i", "need")
    met = met.groupBy("k1", "k2", "item", "shift", "need").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    candidates = written(met.where((F.col("need") == 1) | (F.col("first") < F.col("last"))).drop("need"), "decontaminate-candidates")
    around = (candidates.item == terms.item) & (F.col("i") > F.col("first") - window) & (F.col("i") < F.col("last") + window)
    expected = candidates.join(terms, around).select("k1", "k2", "tid", (F.col("shift") + F.col("i")).alias("pos"), terms.item, "n", "shift", "i")
    docs = small(written(candidates.select("k1", "k2").distinct(), "decontaminate-documents"), BROADCAST_DOCUMENTS)
    near = index.join(docs, ["k1", "k2"], "left_semi")
    return near.join(expected.where("pos >= 0"), ["k1", "k2", "tid", "pos"]).select("k1", "k2", "item", "n", "shift", "i").distinct()


def phrase_hits(found: DataFrame, window: int) -> DataFrame:
    """k1, k2, item, pos of every document word inside an occurrence of a window."""
    line = Window.partitionBy("k1", "k2", "item", "shift").orderBy("i")
    runs = found.withColumn("run", F.col("i") - F.row_number().over(line))
    runs = runs.withColumn("length", F.count("*").over(Window.partitionBy("k1", "k2", "item", "shift", "run")))
    return runs.where(F.col("length") >= F.least(F.lit(window), F.col("n"))).select("k1", "k2", "item", (F.col("shift") + F.col("i")).alias("pos"))


def item_ids(found: DataFrame, terms: DataFrame) -> DataFrame:
    """k1, k2, ids: the sorted ids of the items in found."""
    names = found.select("k1", "k2", "item").distinct().join(terms.select("item", "item_id").distinct(), "item")
    return names.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))


def proximity_items(found: DataFrame, window: int, least: int) -> DataFrame:
    """k1, k2, item with `least` words of some window in place, the others changed or missing."""
    ahead = Window.partitionBy("k1", "k2", "item", "shift").orderBy("i").rangeBetween(0, window - 1)
    near = found.withColumn("there", F.count("*").over(ahead)).where(F.col("there") >= F.least(F.lit(least), F.col("n")))
    return near.select("k1", "k2", "item")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: k1, k2, doc_id, n_words; n_hit, n_items, items (sorted, comma-joined), n_near_items, near_items, null without any match."""
    terms = written(item_terms(benchmark), "decontaminate-terms")
    index = written(postings(docs, terms), "decontaminate-index")
    found = written(aligned(index, terms, window, PROXIMITY_WORDS), "decontaminate-aligned")
    hits = phrase_hits(found, window)
    n_hit = hits.select("k1", "k2", "pos").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_hit"))
    listed = lambda ids, n, name: ids.select("k1", "k2", F.size("ids").cast("long").alias(n), F.array_join("ids", ",").alias(name))
    exact = listed(item_ids(hits, terms), "n_items", "items")
    near = listed(item_ids(proximity_items(found, window, PROXIMITY_WORDS), terms), "n_near_items", "near_items")
    matched = written(n_hit.join(exact, ["k1", "k2"]).join(near, ["k1", "k2"], "full"), "decontaminate-matched")
    return documents(index).join(small(matched, BROADCAST_DOCUMENTS), ["k1", "k2"], "left")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, hits, items and the verdict on phrases; items in proximity, exact ones among them."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return matches(docs, benchmark, window).select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        contaminated(F.coalesce("n_hit", F.lit(0)), F.col("n_words")).alias("contaminated"),
        zero("n_near_items"),
        F.coalesce("near_items", F.lit("")).alias("near_items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = matches(docs, benchmark, window).where(contaminated(F.col("n_hit"), F.col("n_words")))
    return drop_keys(docs, bad.select("k1", "k2").distinct(), "decontaminate-bad")


def op1_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP1_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_sql_words("text")} AS w FROM documents),
items AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
windows AS (
    SELECT item_id, least({WINDOW}, len(w)) AS size, unnest([array_to_string(w[k:k + least({WINDOW}, len(w)) - 1], ' ') FOR k IN range(1, len(w) - least({WINDOW}, len(w)) + 2)]) AS phrase
    FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
    SELECT rid, size, unnest(range(1, len(w) - size + 2)) AS pos, unnest([array_to_string(w[k:k + size - 1], ' ') FOR k IN range(1, len(w) - size + 2)]) AS phrase
    FROM docs, sizes WHERE len(w) >= size),
found AS (SELECT DISTINCT g.rid, g.pos, g.size, v.item_id FROM grams g JOIN windows v ON g.size = v.size AND g.phrase = v.phrase),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS p FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY rid),
placed AS (SELECT item, item_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, * FROM items)),
tokens AS (SELECT rid, unnest(range(len(w))) AS pos, unnest(w) AS term FROM docs),
aligned AS (
    SELECT rid, item, item_id, n, list(i) AS there FROM tokens JOIN placed USING (term)
    GROUP BY rid, item, item_id, n, pos - i HAVING count(*) >= least({PROXIMITY_WORDS}, n)),
close AS (
    SELECT DISTINCT rid, coalesce(CAST(item_id AS VARCHAR), '') AS id FROM (SELECT *, unnest(range(greatest(n - {WINDOW}, 0) + 1)) AS a FROM aligned)
    WHERE len(list_filter(there, lambda i: i >= a AND i < a + {WINDOW})) >= least({PROXIMITY_WORDS}, n)),
near AS (SELECT rid, count(*) AS n_near, string_agg(id, ',' ORDER BY id) AS near_ids FROM close GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items, coalesce(near_ids, '') AS near_items
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid) LEFT JOIN near USING (rid)
"""
