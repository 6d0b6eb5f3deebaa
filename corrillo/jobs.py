"""The steps of a chat: python -m corrillo.jobs ingest|anonymize|process|dictionary|leak-check --root FOLDER ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from corrillo.operators import quality, silver
from corrillo.session import build
from corrillo.sources import chat, config, ingest

#: What each column of the published datasets holds.
COLUMNS = {
    "messages": {
        "message_id": "number of the record in the export", "timestamp": "local time, without zone", "sender": "alias of the member", "message_type": "what the message is",
        "content": "readable text, masked", "is_edited": "whether it was edited", "n_words": "words of letters", "n_emojis": "emojis", "n_mentions": "mentions", "has_url": "whether it has a link",
    },
    "tokens": {
        "message_id": "message", "token_idx": "place from 0", "token": "in lower case", "lemma": "base form", "pos": "part of speech",
        "is_alpha": "letters only", "is_stop": "stop word", "is_laugh": "laughter",
    },
    "emojis": {"message_id": "message", "emoji_idx": "place from 0", "emoji": "symbol", "emoji_name": "its name"},
}


def put(df: DataFrame, path: Path, order: str | None = None) -> None:
    (df.orderBy(order) if order else df).write.mode("overwrite").parquet(str(path))


@config.logged
def run_ingest(spark: SparkSession, root: Path, name: str, archive: Path, existing: config.Existing, about: dict[str, str]) -> None:
    raw = root / "data/raw" / config.valid_chat(name)
    kept = ingest.copy(archive, raw, existing)
    ingest.extract(archive, raw, existing)
    file = ingest.chat_file(raw)
    described = raw / "FUENTE.txt"
    if existing.writes(described):
        described.write_text(ingest.source_text(ingest.group_name(archive), about, [kept, file], chat.date_range(spark, str(file))), encoding="utf-8")


def group_of(raw: Path) -> str:
    return (raw / "FUENTE.txt").read_text(encoding="utf-8").split('"')[1]


@config.logged
def run_anonymize(spark: SparkSession, root: Path, name: str, salt: bytes, settings: config.Anonymization) -> None:
    raw, out = root / "data/raw" / name, root / "data/interim" / name
    put(chat.bronze(spark, str(ingest.chat_file(raw)), group_of(raw)), out / "bronze.parquet", "record_no")
    bronze = spark.read.parquet(str(out / "bronze.parquet"))  # read again: four steps use it
    people = silver.people_of(bronze, salt, settings.allow_names).cache()
    marks = silver.marks_of(people, **asdict(settings))
    put(silver.anonymised(bronze, people, marks), out / "messages_anon.parquet", "message_id")
    put(silver.members(bronze, people, {w for form in marks for w in form.split()}), out / "members.parquet", "first_message")
    people.unpersist()


@config.logged
def run_process(spark: SparkSession, root: Path, name: str) -> None:
    interim, out = root / "data/interim" / name, root / "data/processed" / name
    content = silver.with_content(spark.read.parquet(str(interim / "messages_anon.parquet")), spark.read.parquet(str(interim / "members.parquet")))
    put(silver.tokens(content), out / "tokens.parquet")
    put(silver.emojis(content), out / "emojis.parquet")
    put(silver.messages(content, spark.read.parquet(str(out / "tokens.parquet"))), out / "messages.parquet", "message_id")


@config.logged
def run_dictionary(spark: SparkSession, root: Path, name: str) -> None:
    (root / "references").mkdir(parents=True, exist_ok=True)
    for dataset, columns in COLUMNS.items():
        frame = spark.read.parquet(str(root / "data/processed" / name / f"{dataset}.parquet"))
        found = quality.document(frame, dataset, f"{dataset} of {name}", columns, datetime.now().isoformat(timespec="seconds"))
        (root / "references" / f"diccionario_{dataset}.json").write_text(json.dumps(found, indent=2, ensure_ascii=False), encoding="utf-8")


@config.logged
def run_leak_check(spark: SparkSession, root: Path, name: str, paths: list[str], settings: config.Anonymization = config.Anonymization()) -> dict[str, dict[str, int]]:
    """path -> form -> hits of real names in publishable files; empty when nothing leaks. Names are those that the same settings mask."""
    bronze = spark.read.parquet(str(root / "data/interim" / name / "bronze.parquet"))
    forms = silver.marks_of(silver.people_of(bronze, b"forms only", settings.allow_names), **asdict(settings))
    found = {p: {r["form"]: r["hits"] for r in quality.leaks(chat.publishable_texts(spark, p), forms).collect()} for p in paths}
    return {p: hits for p, hits in found.items() if hits}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("step", choices=["ingest", "anonymize", "process", "dictionary", "leak-check"])
    parser.add_argument("--root", type=Path, default=Path("."))
    parser.add_argument("--chat")
    parser.add_argument("--zip", type=Path)
    parser.add_argument("--existing", choices=[e.value for e in config.Existing], help="what happens to files that are there; else `source.on_exists` of the parameters")
    parser.add_argument("paths", nargs="*")
    args = parser.parse_intermixed_args(arguments)
    params = config.load_params(args.root / "params.yml")
    source = params.get("source") or {}
    if args.step == "ingest":
        name, archive = ingest.chosen_export(params, args.chat, args.zip)
        about = {k: v for k, v in source.items() if k != "on_exists"}
        run_ingest(build(), args.root, name, archive, config.Existing(args.existing or source.get("on_exists", "error")), about)
        return 0
    name, spark, settings = config.active_chat(params, args.chat), build(), config.Anonymization.of(params)
    if args.step == "anonymize":
        run_anonymize(spark, args.root, name, config.load_salt(args.root / ".env"), settings)
    elif args.step == "process":
        run_process(spark, args.root, name)
    elif args.step == "dictionary":
        run_dictionary(spark, args.root, name)
    else:
        hits = run_leak_check(spark, args.root, name, args.paths, settings)
        for path, found in hits.items():
            print(path, found)
        return int(bool(hits))
    return 0


if __name__ == "__main__":
    sys.exit(main())
