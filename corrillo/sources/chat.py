"""Reading exported chats: records, dates, layered datasets and publishable files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrillo.functions.text import LRM, NNBSP, message_kind
from corrillo.functions.times import chat_timestamp

#: How a record of the export begins (fixed values).
HEADER, SENDER, BEFORE_BODY = rf"^{LRM}?\[([^\]]*)\] ", r"^[^\]]*\] ([^:]+?):( |\z)", r"^[^\]]*\] [^:]+?:( |\z)"
DATED = rf"^{LRM}?\[(\d{{2}})/(\d{{2}})/(\d{{2}}), "


def records(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """record_no (from 1, empty records counted) and record of a file whose records end in CRLF; a lone LF is text.

    With `empty`, empty records too, and whether a record is the last one.

    An export is one file and is read whole, as a lone line feed does not end a record; many chats are many tasks.
    """
    invalid = spark.read.format("binaryFile").load(path).where(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count()
    if invalid:
        raise ValueError(f"{path} is not valid UTF-8")
    whole = spark.read.text(path, wholetext=True)
    pieces = F.split("value", "\r\n", -1)
    found = whole.select(F.size(pieces).alias("n"), F.posexplode(pieces).alias("i", "record"))
    numbered = found.select((F.col("i") + 1).cast("long").alias("record_no"), "record", (F.col("i") == F.col("n") - 1).alias("last"))
    return numbered if empty else numbered.where("record <> ''").drop("last")


def parsed(found: DataFrame, group: str) -> DataFrame:
    """record_no, timestamp, sender, body, kind of each record; nothing is checked yet."""
    sender, body = F.regexp_extract("record", SENDER, 1), F.regexp_replace("record", BEFORE_BODY, "")
    parts = found.select("record_no", chat_timestamp(F.regexp_extract("record", HEADER, 1)).alias("timestamp"), sender.alias("sender"), body.alias("body"))
    return parts.withColumn("kind", message_kind(F.col("sender"), F.col("body"), group))


def bronze(spark: SparkSession, path: str, group: str) -> DataFrame:
    """The parsed chat; fails when records have no readable header, as those of other exports."""
    found = parsed(records(spark, path), group)
    total, bad = found.agg(F.count("*"), F.count_if(F.col("timestamp").isNull() | (F.col("sender") == ""))).first()
    if bad:
        raise ValueError(f"{bad} of {total} records in {path} have no parseable header; is this an iOS export?")
    return found


def header_check(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many records there are, and how many have each part of a header."""
    found, header = records(spark, path, empty=True).where("NOT (last AND record = '')"), F.regexp_extract("record", HEADER, 1)
    there = F.col("record") != ""
    return found.agg(
        F.count("*").alias("records"), F.count_if(~there).alias("empty_records"), F.count_if(header != "").alias("with_header"),
        F.count_if(header.contains(NNBSP)).alias("narrow_space"), F.count_if(there & chat_timestamp(header).isNull()).alias("unread_time"),
        F.count_if(there & (F.regexp_extract("record", SENDER, 1) == "")).alias("no_sender"), F.count_if(F.col("record").startswith(LRM)).alias("marked"))


def date_range(spark: SparkSession, path: str) -> tuple[str, str, int]:
    """First and last date of the lines that begin a record, and how many there are."""
    lines = spark.read.text(path).where(F.col("value").rlike(DATED))
    part = lambda i: F.regexp_extract("value", DATED, i)
    date = F.concat(F.lit("20"), part(3), F.lit("-"), part(2), F.lit("-"), part(1))
    first, last, n = lines.agg(F.min(date), F.max(date), F.count("*")).first()
    if not n:
        raise ValueError(f"no dated line in {path}; is this an iOS export?")
    return first, last, n


def views(spark: SparkSession, folder: str, private: bool = False) -> list[str]:
    """Temporary views of a folder's Parquet datasets by name; bronze, which has real names, only when private."""
    names = sorted(p.stem for p in Path(folder).glob("*.parquet") if private or p.stem != "bronze")
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    return names


def notebook_texts(path: str) -> list[str]:
    """Sources and outputs of a notebook, without images."""
    found = []
    for cell in json.loads(Path(path).read_text(encoding="utf-8")).get("cells", []):
        found.append("".join(cell.get("source", [])))
        for output in cell.get("outputs", []):
            found.append("".join(output.get("text", [])))
            found += ["".join(data) if isinstance(data, list) else str(data) for kind, data in output.get("data", {}).items() if not kind.startswith("image/")]
    return [x for x in found if x]


def publishable_texts(spark: SparkSession, path: str) -> DataFrame:
    """column, text of a Parquet dataset, a notebook or a text file."""
    from corrillo.operators.quality import text_rows

    if path.endswith(".parquet"):
        return text_rows(spark.read.parquet(path))
    if path.endswith(".ipynb"):
        return spark.createDataFrame([("notebook", x) for x in notebook_texts(path)], "column string, text string")
    return spark.read.text(path, wholetext=True).select(F.lit("file").alias("column"), F.col("value").alias("text"))
