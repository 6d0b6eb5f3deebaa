"""Profiles, documentation, drift and leak checks, and row-level differences."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrillo.functions.names import fold_column

#: Columns that hold names of words, never of people.
NEVER_SCANNED = ("lemma", "emoji_name")


def profile(df: DataFrame) -> DataFrame:
    """column, type, null_pct, distinct_values (exact), range ('min – max'; empty for text, which may be private) of each column.

    One aggregation per column over the pruned column: many exact distincts in one aggregation would multiply every row.
    """
    parts = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        text = isinstance(field.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
        shown = F.lit("") if text else F.coalesce(F.concat(F.min(c).cast("string"), F.lit(" – "), F.max(c).cast("string")), F.lit(""))
        parts.append(df.select(c).agg(
            F.lit(field.name).alias("column"), F.lit(field.dataType.simpleString()).alias("type"),
            F.coalesce(F.round(100.0 * F.avg(c.isNull().cast("double")), 2), F.lit(0.0)).alias("null_pct"), F.count_distinct(c).alias("distinct_values"), shown.alias("range")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found


def drift(df: DataFrame, documented: Iterable[str]) -> None:
    """Fails when columns are not documented or documented ones are missing."""
    documented, there = set(documented), set(df.columns)
    if there != documented:
        raise ValueError(f"undocumented columns {sorted(there - documented)}, missing columns {sorted(documented - there)}")


def document(df: DataFrame, name: str, about: str, columns: dict[str, str], generated: str) -> dict:
    """A data dictionary of a dataset: descriptions with each column's profile."""
    drift(df, columns)
    rows = {r["column"]: r for r in profile(df).collect()}
    texts = any(t == "string" for _, t in df.dtypes)
    found = [{"name": c, "type": rows[c]["type"], "description": columns[c], "null_pct": rows[c]["null_pct"], "distinct_values": rows[c]["distinct_values"], "range": rows[c]["range"]} for c in df.columns]
    return {"dataset": name, "description": about, "generated": generated, "rows": df.count(), "privacy": "Text columns publish no range." if texts else "", "columns": found}


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with their side; nulls are equal."""
    return left.subtract(right).withColumn("side", F.lit("left")).unionAll(right.subtract(left).withColumn("side", F.lit("right")))


def text_rows(df: DataFrame) -> DataFrame:
    """column, text of every string column that may hold names."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in NEVER_SCANNED]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, text string")
    return df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("text")) for n in names))).alias("r")).select("r.*").where("text IS NOT NULL")


def leaks(texts: DataFrame, forms: Iterable[str], text: str = "text") -> DataFrame:
    """form, hits: the folded forms found in folded texts, single words by a join, several by a pattern.

    Texts are folded once per distinct value. forms are members' name forms: a list as short as the members.
    """
    forms = sorted(set(forms))
    single, several = [f for f in forms if re.fullmatch(r"[^\W_]+", f)], [f for f in forms if not re.fullmatch(r"[^\W_]+", f)]
    spark = texts.sparkSession
    counted = texts.groupBy(text).agg(F.count("*").alias("n")).select(fold_column(text).alias("folded"), "n")
    words = counted.select(F.explode(F.array_distinct(F.regexp_extract_all("folded", F.lit(r"(?U)[^\W_]+"), F.lit(0)))).alias("form"), "n")
    found = words.join(F.broadcast(spark.createDataFrame([(f,) for f in single], "form string")), "form")
    if several:
        tests = F.array(*(F.when(F.col("folded").rlike(rf"(?U)(?<!\w){re.escape(f)}(?!\w)"), F.lit(f)) for f in several))
        found = found.unionByName(counted.select(F.explode(tests).alias("form"), "n").where("form IS NOT NULL"))
    return found.groupBy("form").agg(F.sum("n").alias("hits"))
