"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks, with limits that depend on length.

A text that repeats itself compresses too well, random or encoded text hardly at all. A short text has no room for
either, so each length has its own band; a text shorter than a chunk is its own chunk, judged by that band. The last chunk
of a text is aligned to its end, so that every byte is judged. The work is per row in Arrow batches: no shuffle, memory
bounded by a batch; a very long text is compressed whole and in chunks, one at a time.

Defined results: null and empty texts have no words, so base_failed is true and kept false; repeated rows are judged
each for itself; an empty table gives an empty result; other columns neither matter nor clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrillo.llm.common import table

LEVEL = 3
CHUNK_BYTES = 2048
#: Bytes of text below which a band holds, the least ratio and the largest one. They are read from observed_bands() over
#: the labelled table of 10,000 documents: what good texts show and four hundredths more lies inside every band, and
#: floors are lowered to a common one, as random and encoded text stay below 1.35. The ratio of clean text rises with its
#: length; beyond the lengths labelled, the chunks alone judge.
BANDS = (
    (200, 0.0, 2.1),
    (400, 1.05, 2.15),
    (800, 1.2, 2.05),
    (1600, 1.38, 2.2),
    (3200, 1.38, 2.3),
    (6400, 1.38, 2.42),
    (12_800, 1.38, 2.5),
    (25_600, 1.38, 2.58),
    (131_072, 1.38, 2.7),
    (float("inf"), 0.0, float("inf")),
)
#: How much wider than what is observed a band is.
SLACK = 1.04
#: The band of a chunk of CHUNK_BYTES, and the share of chunks that may lie outside it.
CHUNK_BAND = (1.3, 2.3)
CHUNK_SHARE = 0.2
MIN_WORDS = 50
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found more than once."""
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    again = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= again
    return int(covered.sum())


def base_measures(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; bytes.split() cuts at exactly \\x20 and \\x09-\\x0D."""
    words = data.split()
    joined = b"".join(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(joined.decode("utf-8", "replace")),
        len(joined) - len(joined.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def compression(data: bytes, press: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """The whole text's ratio, its chunks, the last one aligned to the end, and those outside the chunks' band."""
    if not data:
        return 0.0, 0, 0
    whole = len(data) / len(press.compress(data))
    cuts = [*range(0, len(data) - CHUNK_BYTES + 1, CHUNK_BYTES)]
    if cuts and len(data) % CHUNK_BYTES:
        cuts.append(len(data) - CHUNK_BYTES)
    low, high = CHUNK_BAND
    bad = sum(not low <= CHUNK_BYTES / len(press.compress(data[i : i + CHUNK_BYTES])) <= high for i in cuts)
    return whole, len(cuts), bad


def in_bands(n_bytes: int, ratio: float, n_chunks: int, n_bad: int) -> bool:
    low, high = next((low, high) for below, low, high in BANDS if n_bytes < below)
    return low <= ratio <= high and n_bad <= CHUNK_SHARE * n_chunks


def judge(data: bytes | None, press: zstandard.ZstdCompressor) -> tuple:
    data = data or b""
    n_words, word_chars, n_symbols, n_dup, n_repeat = base_measures(data)
    ratio, n_chunks, n_bad = compression(data, press)
    failed = n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words
    return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, not failed and in_bands(len(data), ratio, n_chunks, n_bad), ratio, n_chunks, n_bad


def measure(docs: DataFrame) -> DataFrame:
    """Every document's measures and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            found = list(zip(*(judge(x.as_py(), press) for x in batch.column(1)))) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            columns = [batch.column(0), *(pa.array(x, k) for x, k in zip(found, kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in MEASURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data")).mapInArrow(run, MEASURES)


def observed_bands(docs: DataFrame, labels: DataFrame, slack: float = SLACK) -> DataFrame:
    """What BANDS are read from: below, n, low, high of each length, over all documents labelled good that pass the base rules.

    low and high are the least and the largest ratio, SLACK wider. One row per band.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("labelled")).distinct()
    size = docs.select(F.col("doc_id").cast("long").alias("id"), F.octet_length("text").alias("n_bytes")).distinct()
    found = measure(docs).where("NOT base_failed").join(good, F.col("doc_id") == F.col("labelled"), "left_semi").join(size, F.col("doc_id") == F.col("id"))
    edges = F.array(*(F.lit(float(b)) for b, _, _ in BANDS))
    below = F.element_at(F.filter(edges, lambda b: F.col("n_bytes") < b), 1)
    return found.groupBy(below.alias("below")).agg(F.count("*").alias("n"), (F.min("ratio") / slack).alias("low"), (F.max("ratio") * slack).alias("high"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            good = [judge(x.as_py(), press)[6] for x in batch.column(at).cast(pa.binary())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))
