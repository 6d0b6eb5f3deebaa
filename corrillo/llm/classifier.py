"""A quality classifier by Bradley-Terry pairwise ranking.

A text's features are frequencies of pairs of byte classes and some measures of repetition, all over the whole text,
however long; an Arrow batch of texts is in memory at a time.
All labelled documents of the training folds are learned from. They are dealt to blocks of about BLOCK_ROWS by a hash, in
which every good text meets every bad one; logistic loss on the feature differences of all these pairs gives a linear
score, by which the better of two texts is the likelier winner. The loss is convex with one minimum, and is minimised
over all blocks until its slope vanishes (L-BFGS; a round is one pass over the blocks and brings one vector a task to the
driver). A fit on at most MAX_LABELLED documents is only where the search begins: it saves rounds and decides nothing.
Where a kind is too rare for the blocks, its texts go to several. The cut is a quantile of all training scores, the share
of bad documents among them, found exactly; scores are squashed so that the cut lies at CUT. Scoring is per row in Arrow
batches, without a shuffle; for learning, features of the training folds are shuffled once to their labels and once to
blocks, never texts.

Defined results: null and empty texts have features of zero and are scored; a document of which the label is null or
missing is not learned from; equal rows are learned from once, and each of a doc_id's different texts;
with labels of one kind only every score is CUT; repeated rows are scored each for
itself; a null doc_id counts as held out; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrillo.llm.common import rows_of, table, written
from corrillo.llm.quality import base_measures

MAX_LABELLED, PAIRS, STEPS, RIDGE, SEED = 8000, 20_000, 300, 1e-3, 7
CUT = 0.3
#: Documents of a block, and how many of each kind there should be in it.
BLOCK_ROWS, OF_A_KIND = 1024, 16
#: The largest component of the slope at the end, rounds until a warning, steps remembered, and sums sent to the driver.
TOLERANCE, ROUNDS, REMEMBERED, MAX_SUMS = 1e-6, 300, 20, 1024
#: For the exact quantile: distinct scores that the driver looks through, and bins that more of them are counted in.
LOOKED_THROUGH, BINS = 10_000, 1000
BLOCK = "good binary, bad binary"
SCORED = "doc_id long, held_out boolean, score double, predicted int"
#: Bytes that are a class of their own; others are lower case, upper case, digit, other ASCII or not ASCII.
OWN_CLASS = b" \n\t.,;:!?#*$%&|<>-_=@/\"'()"
N_CLASSES = len(OWN_CLASS) + 5
N_EXTRA = 9


def class_table() -> np.ndarray:
    kinds = np.full(256, N_CLASSES - 1)
    kinds[:128] = N_CLASSES - 2
    kinds[48:58], kinds[65:91], kinds[97:123] = N_CLASSES - 3, N_CLASSES - 4, N_CLASSES - 5
    for i, byte in enumerate(OWN_CLASS):
        kinds[byte] = i
    return kinds


CLASSES = class_table()
N_FEATURES = N_CLASSES * N_CLASSES + N_EXTRA


def features(data: bytes | None) -> np.ndarray:
    out = np.zeros(N_FEATURES, np.float32)
    if not data:
        return out
    kinds = CLASSES[np.frombuffer(data, np.uint8)]
    pairs = np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=N_CLASSES * N_CLASSES)
    out[: N_CLASSES * N_CLASSES] = np.sqrt(pairs / len(data))
    n_words, chars, symbols, dup_lines, repeated = base_measures(data)
    words = data.lower().split()
    lines = data.count(b"\n") + 1
    n = max(1, n_words)
    out[-N_EXTRA:] = (
        np.log1p(n_words), chars / n / 10, symbols / n, dup_lines / lines, repeated / n, len(set(words)) / n,
        np.log1p(lines), np.sqrt(n_words / lines) / 10, sum(a == b for a, b in zip(words, words[1:])) / n,
    )
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    offset: float

    def scores(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(found @ self.weights - self.offset + np.log(CUT / (1 - CUT)), -30, 30)))


def fit_pairs(found: np.ndarray, good: np.ndarray) -> Model:
    """Weights by which the good text of a pair wins, and the score at the quantile of bad texts."""
    found = found.astype(np.float64)
    if good.all() or not good.any():
        return Model(np.zeros(found.shape[1]), 0.0)
    draw = np.random.default_rng(SEED)
    scale = found.std(0)
    scale = np.where(scale > 1e-6, 1 / np.maximum(scale, 1e-6), 0.0)
    wins, loses = (draw.choice(np.flatnonzero(x), PAIRS) for x in (good, ~good))
    differences = ((found[wins] - found[loses]) * scale).astype(np.float32)
    w = np.zeros(found.shape[1], np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        lost = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
        slope = -(lost @ differences) / PAIRS + RIDGE * w
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - 0.03 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = w.astype(np.float64) * scale
    return Model(weights, float(np.quantile(found @ weights, 1 - good.mean())))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def featured(docs: DataFrame, columns: str) -> DataFrame:
    """Features as packed float32, after doc_id and the other columns of docs (text last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([features(x.as_py()).tobytes() for x in batch.column(batch.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=[*batch.schema.names[:-1], "features"])

    return docs.mapInArrow(run, columns)


def matrix(packed: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.float32).reshape(len(packed), N_FEATURES).astype(np.float64)


def summed(rows: DataFrame, measure: Callable[[pa.RecordBatch], np.ndarray], n: int) -> np.ndarray:
    """The sum of measure(batch), n numbers, over all rows: a task sends one vector, in the order of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            total += measure(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    found = rows.coalesce(MAX_SUMS).mapInArrow(run, "total binary").collect()
    return sum((np.frombuffer(r["total"]) for r in found), np.zeros(n))


def moments(batch: pa.RecordBatch) -> np.ndarray:
    found = matrix(batch.column("features"))
    return np.concatenate([found.sum(0), (found**2).sum(0)])


def pack_block(rows: pa.Table) -> pa.Table:
    """The good and the bad texts' features of a block, each kind in one order."""
    good = rows["label"].to_numpy() > 0
    kinds = (b"".join(sorted(rows["features"].filter(pa.array(kind)).to_pylist())) for kind in (good, ~good))
    return rows_of(BLOCK, [tuple(zstandard.compress(x, 1) for x in kinds)])


def dealt_to_blocks(rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """Blocks of about BLOCK_ROWS texts; the texts of a rare kind are in several of them."""
    blocks = -(-(n_good + n_bad) // BLOCK_ROWS)
    copies = lambda n: min(blocks, -(-OF_A_KIND * blocks // n))
    first = F.xxhash64("doc_id", "label", "features")
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("label") > 0, copies(n_good)).otherwise(copies(n_bad)) - 1))
    spread = rows.select("label", "features", first.alias("first"), copy.alias("copy"))
    return spread.withColumn("block", F.pmod(F.pmod("first", F.lit(blocks)) + F.col("copy"), F.lit(blocks))).groupBy("block").applyInArrow(pack_block, BLOCK)


def pair_loss(weights: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Of all pairs of a good and a bad text in each block: their number, their logistic loss and its slope, end to end."""

    def run(batch: pa.RecordBatch) -> np.ndarray:
        unzip, out = zstandard.ZstdDecompressor(), np.zeros(2 + N_FEATURES)
        for kinds in zip(*(c.to_pylist() for c in batch.columns)):
            good, bad = (np.frombuffer(unzip.decompress(x), np.float32).reshape(-1, N_FEATURES).astype(np.float64) for x in kinds)
            margins = (good @ weights)[:, None] - (bad @ weights)
            lost = 1 / (1 + np.exp(np.clip(margins, -500, 500)))
            out[0] += margins.size
            out[1] += np.logaddexp(0, -margins).sum()
            out[2:] += lost.sum(0) @ bad - lost.sum(1) @ good
        return out

    return run


def direction(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The L-BFGS direction, downhill, from the last steps and the changes of slope along them."""
    out, shares = -slope, []
    for step, change in reversed(steps):
        shares.append(step @ out / (step @ change))
        out = out - shares[-1] * change
    if steps:
        step, change = steps[-1]
        out = out * (step @ change / (change @ change))
    else:
        out = out / max(1.0, float(np.linalg.norm(out)))
    for (step, change), share in zip(steps, reversed(shares)):
        out = out + (share - change @ out / (step @ change)) * step
    return out


def least(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray) -> np.ndarray:
    """Where a smooth convex loss is least: its slope is within TOLERANCE, or no step lowers the loss any more."""
    (value, slope), steps = loss(at), []
    for _ in range(ROUNDS):
        if np.abs(slope).max() <= TOLERANCE:
            return at
        down, length = direction(slope, steps), 1.0
        while (found := loss(at + length * down))[0] > value + 1e-4 * length * (slope @ down):
            length /= 2
            if length < 1e-9:
                return at
        step, change = length * down, found[1] - slope
        if step @ change > 0:
            steps = [*steps, (step, change)][-REMEMBERED:]
        at, (value, slope) = at + step, found
    warnings.warn(f"the slope of the loss is {np.abs(slope).max():.1e} after {ROUNDS} rounds", stacklevel=2)
    return at


def quantile(scores: DataFrame, share: float) -> float:
    """The exact quantile of the column score, between two scores in proportion: a range is counted in bins until few scores are left."""
    counted = written(scores.groupBy("score").agg(F.count("*").alias("n")), "ranking-scores")
    low, high, n = counted.agg(F.min("score"), F.max("score"), F.sum("n")).first()
    rank, below = share * (n - 1), 0
    wanted = int(rank), min(int(rank) + 1, n - 1)
    while True:
        inside = counted.where(F.col("score").between(low, high))
        few = inside.limit(LOOKED_THROUGH + 1).count() <= LOOKED_THROUGH
        bin_ = F.col("score") if few else F.floor((F.col("score") - low) / ((high - low) / BINS))
        bins = inside.groupBy(bin_.alias("bin")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("n").alias("n")).orderBy("bin").collect()
        ends = below + np.cumsum([b["n"] for b in bins])
        first, second = (int(np.searchsorted(ends, k, side="right")) for k in wanted)
        if few or first != second:
            a, b = bins[first]["high"], bins[second]["low"]
            return float(a + (b - a) * (rank - wanted[0]))
        low, high, below = bins[first]["low"], bins[first]["high"], int(ends[first]) - bins[first]["n"]


def learned(rows: DataFrame, n_good: int, n_bad: int, start: Model | None = None) -> Model:
    """The model of the least loss over all rows (label, features); the search begins at `start`."""
    n = n_good + n_bad
    first, second = np.split(summed(rows, moments, 2 * N_FEATURES) / n, 2)
    deviation = np.sqrt(np.maximum(second - first**2, 0))
    scale = np.where(deviation > 1e-6, 1 / np.maximum(deviation, 1e-6), 0.0)
    blocks = written(dealt_to_blocks(rows, n_good, n_bad), "ranking-blocks")

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        found = summed(blocks, pair_loss(w * scale), 2 + N_FEATURES)
        pairs = max(found[0], 1)
        return float(found[1] / pairs + RIDGE / 2 * (w @ w)), found[2:] * scale / pairs + RIDGE * w

    weights = least(loss, np.zeros(N_FEATURES) if start is None else start.weights * np.where(scale > 0, deviation, 0)) * scale

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(matrix(batch.column("features")) @ weights, pa.float64())], names=["score"])

    return Model(weights, quantile(rows.mapInArrow(score, "score double"), n_bad / n))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learns from all labelled documents outside the held-out fold."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data"))
    # a doc_id may be there many times: equal rows count once
    rows = written(featured(texts, "doc_id long, features binary").join(known.distinct(), "doc_id").select("doc_id", "label", "features").distinct(), "ranking-rows")
    n_good, n = rows.agg(F.count_if(F.col("label") > 0), F.count("*")).first()
    if not n:
        return Model(np.zeros(N_FEATURES), 0.0)
    key = F.xxhash64("doc_id", "features")
    last = rows.select(key.alias("key")).orderBy("key").limit(MAX_LABELLED).agg(F.max("key")).first()[0]
    some = sorted(rows.where(key <= last).collect(), key=lambda r: (r["doc_id"], r["label"], r["features"]))[:MAX_LABELLED]
    found = np.stack([np.frombuffer(r["features"], np.float32) for r in some])
    start = fit_pairs(found, np.array([r["label"] > 0 for r in some]))
    return learned(rows, n_good, n - n_good, start) if 0 < n_good < n else start


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(2)]
            scores = model.scores(np.stack(found).astype(np.float64)) if found else np.empty(0)
            columns = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= CUT).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("data")).mapInArrow(run, SCORED)


def op5_pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
