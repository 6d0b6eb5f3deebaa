"""Names, ids, aliases, masks and leaks; profiles and differences of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrillo.functions import names
from corrillo.functions.masking import form_marks, marks_frame, mask_names as mask_by_names
from corrillo.operators.quality import difference, leaks, profile
from corrillo.plans.base import query, table

SALT = b"a salt for the queries only"
_PEOPLE = "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region"
_ANIMALS = "[" + ", ".join(f"'{a}'" for a in names.ANIMALS) + "]"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()


@query(_PEOPLE)
def union_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir)


@query(f"""
WITH f AS (SELECT o_custkey AS member, min(o_orderdate) AS first_message, min(o_orderkey) AS first_id FROM orders GROUP BY o_custkey),
r AS (SELECT *, row_number() OVER (ORDER BY first_message, first_id, member) AS rank FROM f)
SELECT member, first_message, coalesce({_ANIMALS}[rank], 'Animal ' || rank) AS alias FROM r""")
def alias_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.min("o_orderdate").alias("first_message"), F.min("o_orderkey").alias("first_id"))
    return names.alias_frame(orders, ["first_message", "first_id", "member"]).select("member", "first_message", "alias")


@query()
def keyed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.people_frame(people(spark, sf_dir), SALT).select("name", "id")


@query("SELECT DISTINCT name, lower(strip_accents(name)) AS folded FROM (SELECT replace(replace(c_mktsegment, 'A', 'Á'), 'U', 'ü') || ' Ñandú' AS name FROM customer UNION ALL SELECT c_mktsegment FROM customer)")
def fold_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as they are, and with marks over their letters."""
    plain = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    marked = plain.select(F.concat(F.translate("name", "AU", "Áü"), F.lit(" Ñandú")).alias("name"))
    return plain.union(marked).withColumn("folded", names.fold_column("name"))


@query(f"""
WITH p AS ({_PEOPLE}), parts AS (SELECT name, unnest(list_append(regexp_extract_all(name, '[0-9A-Za-z_]+'), name)) AS part FROM p)
SELECT lower(part) AS form, list_sort(list(DISTINCT name)) AS owners FROM parts WHERE length(part) >= 3 AND NOT regexp_full_match(part, '[0-9]+') GROUP BY 1""")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.forms_frame(people(spark, sf_dir))


@query()
def mask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without the names of nations and regions and two more; as many members as a chat has."""
    members = names.people_frame(people(spark, sf_dir), SALT)
    found = {r["form"]: r["mark"] for r in marks_frame(names.forms_frame(members), members).collect()}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", mask_by_names(form_marks(["then", "ouen"], found), "text").alias("masked"))


@query(r"""
WITH words AS (SELECT rid, list_distinct(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS w FROM (SELECT row_number() OVER () AS rid, text FROM conversations))
SELECT form, count(*) AS hits FROM (SELECT unnest(w) AS form FROM words) WHERE form IN ('then', 'that', 'ouen') GROUP BY form""")
def leak_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, folded, accented ones too; in how many each form is."""
    return leaks(table(spark, sf_dir, "conversations"), ["then", "that", "ouen"])


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS type, coalesce(round(100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 2), 0.0) AS null_pct, count(DISTINCT {c}) AS distinct_values, {r} AS range FROM events"
    for c, k, r in (("event_id", "bigint", "coalesce(min(event_id) || ' – ' || max(event_id), '')"), ("user_id", "bigint", "coalesce(min(user_id) || ' – ' || max(user_id), '')"), ("event_type", "string", "''"))))
def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))


@query("""
WITH l AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 200000)
SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""")
def except_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"))
    return difference(some, table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id")))


@query("SELECT count(*) AS customers, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)) AS silent FROM customer")
def anti_join_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrote = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("wrote", F.lit(1))
    return table(spark, sf_dir, "customer").join(wrote, "c_custkey", "left").agg(F.count("*").alias("customers"), F.count_if(F.col("wrote").isNull()).alias("silent"))


@query("SELECT doc_id, lang FROM documents WHERE text IS NOT NULL ORDER BY md5('42-' || doc_id), doc_id LIMIT 200")
def sample_reproducible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a fixed size: the rows with the least seeded hashes, among those that pass the filter."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.orderBy(F.md5(F.concat(F.lit("42-"), F.col("doc_id").cast("string"))), "doc_id").limit(200).select("doc_id", "lang")
