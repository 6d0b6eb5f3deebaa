"""Every registered query against its SQL, on the tables of the driver."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corrillo.functions.names import folded
from corrillo.operators.ordering import RANGE, dealt, previous, running
from corrillo.operators.sessions import by_lag, of_everybody
from corrillo.plans import registry
from corrillo.plans.base import timeline
from corrillo.plans.people import SALT
from corrillo.streaming.sessions import stream_sessions

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert rows
    if name not in registry.ORACLE_SQL:
        return  # held against plain Python below and in test_text.py
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("minutes,per_range", [(10, 100), (30, 700), (30, 10**6)])
def test_both_forms_of_sessions_agree(spark, sf_dir, minutes, per_range):
    messages, gap = timeline(spark, sf_dir).withColumn("key", F.lit(1)), f"'{minutes}' MINUTE"
    by = by_lag(messages, gap, "key").drop("key", "session")
    ranged = of_everybody(messages, gap, per_range).select(by.columns)
    assert by.exceptAll(ranged).count() == 0 == ranged.exceptAll(by).count()


def test_no_total_order_is_one_partition(spark, sf_dir):
    """Rows are lagged and summed by range; a single partition only ever has a row per range or per group."""
    plan = of_everybody(timeline(spark, sf_dir), "'10' MINUTE", 500)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "windowspecdefinition" in line:
            spec = line.split("windowspecdefinition(")[1]
            assert spec.startswith("__range#") and ("message_id" in spec or "_before" in line or "_ahead" in line or "_we" in line)


def test_ranges_cut_a_hot_leading_value(spark):
    """Two thirds of all rows share the leading value; no range has far more rows than others."""
    rows = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE 5 END AS k", "id AS tie", "CASE WHEN id % 7 = 0 THEN NULL ELSE id END AS v").repartition(5)
    sizes = [r["count"] for r in dealt(rows, ["k", "tie"], 500).groupBy(RANGE).count().collect()]
    assert len(sizes) == 18 and max(sizes) < 1000
    order = [i for _, i in sorted(((i if i % 3 == 0 else 5), i) for i in range(9000))]
    value = lambda i: None if i % 7 == 0 else i
    got = {r["tie"]: r["previous_v"] for r in previous(rows, ["k", "tie"], ["v"], 500).collect()}
    assert got == {i: (None if n == 0 else value(order[n - 1])) for n, i in enumerate(order)}
    sums = {r["tie"]: r["s"] for r in running(rows, ["k", "tie"], F.lit(2), "s", 500).collect()}
    assert sums == {i: 2 * (n + 1) for n, i in enumerate(order)}
    assert running(rows.limit(0), ["k", "tie"], "v", "s").count() == 0 == previous(rows.limit(0), ["k", "tie"], ["v"]).count()


def test_filters_on_words_run_once_per_group(spark, sf_dir):
    """The stop-word test stays above the aggregation that counts words."""
    plan = registry.QUERIES["top_content_words"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Aggregate"):]
    assert "RLIKE" in plan and "RLIKE" not in below and "xd" not in below


def test_streamed_sessions(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 02:00:00"), ("b", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "sender string, t string").selectExpr("sender", "cast(t AS timestamp) AS timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sender string, timestamp timestamp").parquet(str(tmp_path / "in"))
    run = stream_sessions(stream).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r["sender"], r["messages"]) for r in spark.table("streamed").collect()) == [("a", 1), ("a", 2)]


def test_leaks_in_accented_texts(spark, sf_dir, tmp_path):
    """Every text is scanned, against folding in plain Python."""
    rows = [("habló de Ouën", ), ("ÓUEN, thén y thát", ), ("then ouen", ), ("señor thenard", ), (None, )]
    spark.createDataFrame(rows, "text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for path in (str(tmp_path), sf_dir):
        expected = Counter(form for r in spark.read.parquet(f"{path}/conversations.parquet").select("text").collect() for form in set(re.findall(r"[^\W_]+", folded(r["text"] or ""))) & {"then", "that", "ouen"})
        assert {r["form"]: r["hits"] for r in registry.QUERIES["leak_hits"](spark, path).collect()} == expected
        assert path == sf_dir or expected == {"ouen": 3, "then": 2, "that": 1}


def test_keyed_ids_and_masked_names(spark, sf_dir):
    """The two queries with a keyed hash, against plain Python over whole tables."""
    people = {r["name"]: r["id"] for r in registry.QUERIES["keyed_ids"](spark, sf_dir).collect()}
    assert people == {n: hashlib.blake2b(n.encode(), key=SALT, digest_size=5).hexdigest() for n in people} and len(people) == 30
    forms = {}
    for name, i in people.items():
        for form in {name.lower(), *re.findall(r"\w+", name.lower())}:
            if len(form) >= 3:
                forms.setdefault(form, set()).add(i)
    marks = {"then": "[nombre]", "ouen": "[nombre]"} | {f: f"[{min(x)}]" if len(x) == 1 else "[nombre]" for f, x in forms.items()}
    known = "|".join(sorted((re.escape(f) + ("(?:es|s)?" if len(f) > 3 else "") for f in marks), key=len, reverse=True))
    mark = lambda m: next(marks[f] for f in (m[0], m[0].removesuffix("es"), m[0].removesuffix("s")) if f in marks)
    texts = {(r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    got = {(r["conv_id"], r["turn"]): r["masked"] for r in registry.QUERIES["mask_names"](spark, sf_dir).collect()}
    plain = [(c, t, x) for c, t, x in texts if x and x.isascii()]
    assert all(got[c, t].lower() == re.sub(rf"(?<![a-z])(?:{known})(?![a-z])", mark, x.lower()) for c, t, x in plain) and any("[nombre]" in x for x in got.values() if x)


def test_numbers_in_short_groups_are_masked(spark, tmp_path):
    """No four digits in a row are needed, and no document is left out."""
    rows = [(1, "from 196.251.51.155 on"), (2, "call 66 21 23 45 67"), (3, "no number"), (4, "card 1234 5678 9012 3456"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["masked"] for r in registry.QUERIES["mask_number"](spark, str(tmp_path)).collect()}
    assert found == {1: "from [numero] on", 2: "call [numero]", 3: "no number", 4: "card [numero]", 5: None}
