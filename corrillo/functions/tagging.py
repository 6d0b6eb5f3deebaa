"""Tokens of a text by a pluggable tagger; the default one is a pattern and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrillo.functions.text import STOP_WORDS, is_laugh, is_stop_word

TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"
#: Short forms of adjectives and their long ones (fixed values).
ADJECTIVE_APOCOPES = {"buen": "bueno", "mal": "malo", "gran": "grande", "primer": "primero", "tercer": "tercero"}
COLUMNS = "token_idx bigint, token string, lemma string, pos string"


def adjective_lemma(lemma: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ADJECTIVE_APOCOPES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, lemma), lemma)


def by_pattern(frame: DataFrame, key: str, text: str) -> DataFrame:
    """key, token_idx (from 0), token, lemma, pos: lemma is the token, pos one of ADJ (known apocopes), WORD, NUM, SYM."""
    token = F.lower("t")
    pos = F.when(token.isin(*ADJECTIVE_APOCOPES), "ADJ").when(token.rlike(r"^[\p{L}\p{M}]+$"), "WORD").when(token.rlike(r"^\p{N}+$"), "NUM").otherwise("SYM")
    found = frame.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("i", "t"))
    return found.select(key, F.col("i").cast("long").alias("token_idx"), token.alias("token"), adjective_lemma(token).alias("lemma"), pos.alias("pos"))


def by_tagger(frame: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list[list[tuple[str, str, str]]]]]) -> DataFrame:
    """The same by a tagger that `load` returns on the executor: texts to lists of (token, lemma, pos), in Arrow batches."""
    kind = dict(frame.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = load()
        for batch in frames:
            rows = [(k, i, *t) for k, tokens in zip(batch[key], tag(list(batch[text]))) for i, t in enumerate(tokens)]
            yield pd.DataFrame(rows, columns=[key, "token_idx", "token", "lemma", "pos"])

    found = frame.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {kind}, {COLUMNS}")
    return found.withColumn("lemma", F.when(F.col("pos") == "ADJ", adjective_lemma(F.lower("lemma"))).otherwise(F.lower("lemma"))).withColumn("token", F.lower("token"))


def with_flags(tokens: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Adds is_alpha, is_stop, is_laugh; the last two only of words of letters."""
    alpha = F.col("token").rlike(r"^\p{L}+$")
    return tokens.withColumns({"is_alpha": alpha, "is_stop": alpha & is_stop_word(F.col("token"), stop_words), "is_laugh": alpha & is_laugh(F.col("token"))})
