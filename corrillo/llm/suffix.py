"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Of all suffixes only those at the anchors of 50-byte strings are sorted (see anchors.py); what an anchor stands for, its
bytes to the right and then those to the left, is its key.

1. Documents are dealt to buckets of bounded size. Each bucket sends the hashes of its anchors' cores to the owners of
   hash ranges, which answer which of them occur elsewhere. Anchors that occur nowhere else need not travel.
2. Each bucket sorts the keys that are left, settles those it holds twice itself (one with a larger doc_id than an
   equal one is covered whole), and sends the others as front-coded runs: shared prefix length, then the rest.
3. The receivers, one for each range of core hashes, merge the runs with a loser tree that never compares known prefixes
   again. Runs of keys with one gram
   lie together; prefix lengths to the right and to the left tell which 50-byte strings are equal, and which of them
   occur under a smaller doc_id.
4. Each bucket gets its covered ranges back, joins them and removes their bytes.

A passage of which there are very many copies travels once per bucket. Buckets, hash ranges and merges are as many as
the input needs for one to fit a task.

Defined results: null texts are empty; a null doc_id is smaller than any other; rows with one doc_id never cover each
other but each is judged; equal texts keep the one with the smallest doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrillo.llm.anchors import GRAM, SPAN, SPREAD, anchors_of_all
from corrillo.llm.common import bucket_count, dealt, rows_of, table, text_bytes, unpacked
from corrillo.llm.losertree import merge
from corrillo.llm.packing import pack, pack_sorted, split_by_range, unpack, unpack_sorted

BUCKET_BYTES = 6 << 20
FLUSH_KEYS = 16_384
LEFT = SPREAD - 1  # bytes to the left of an anchor that its strings can hold
KEY = SPAN + LEFT + 2
NO_ID = -(1 << 63)

SENT = "part long, bucket long, keys binary"
ANSWERED = "bucket long, keys binary"
RUN = "part long, bucket long, kind int, lcps binary, rests binary, ids binary, places binary"
COVERED = "bucket long, starts binary, ends binary"
RUNS, SETTLED = 0, 1
SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def bucket_texts(bucket: pa.Table) -> tuple[list[int], np.ndarray, list[bytes]]:
    """The rows' order by doc_id and text, which is the same in every step; doc_ids and texts in that order."""
    ids = [NO_ID if x is None else x for x in bucket["__id"].to_pylist()]
    texts = [x or b"" for x in bucket["__data"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return order, np.array([ids[i] for i in order], np.int64), [texts[i] for i in order]


def keys_of(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Key of each anchor: bytes to the right, bytes to the left backwards, least and largest offset in its strings."""
    out = np.zeros((len(at), KEY), np.uint8)
    right, left = np.arange(SPAN), np.arange(1, LEFT + 1)
    for lo in range(0, len(at), 16_384):
        rows = slice(lo, lo + 16_384)
        a, least, most = at[rows, None], at[rows, None] - last[rows, None], at[rows, None] - first[rows, None]
        out[rows, :SPAN] = np.where(right < SPAN - least, data[np.minimum(a + right, len(data) - 1)], 0)
        out[rows, SPAN : SPAN + LEFT] = np.where(left <= most, data[np.maximum(a - left, 0)], 0)
        out[rows, -2:] = np.concatenate([least, most], 1)
    return out


def sorted_order(keys: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")


def prefix_lengths(keys: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before; 0 for the first."""
    if not len(keys):
        return np.empty(0, np.int64)
    differ = keys[1:] != keys[:-1]
    found = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return np.concatenate([[0], found])


def short(cores: np.ndarray, bits: int) -> np.ndarray:
    """The leading `bits` bits of core hashes: enough to tell most cores apart; one taken for another only travels in vain."""
    return cores >> np.uint64(64 - bits)


def send_cores(parts: int, bits: int):
    def run(key: tuple, bucket: pa.Table) -> pa.Table:
        cores = np.unique(short(anchors_of_all(bucket_texts(unpacked(bucket))[2])[2], bits))
        cuts = split_by_range(cores << np.uint64(64 - bits), parts)
        return rows_of(SENT, [(p, key[0].as_py(), pack_sorted(cores[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b])

    return run


def answer_cores(sent: pa.Table) -> pa.Table:
    """To each bucket those of its cores that another bucket has too."""
    lists = [unpack_sorted(k) for k in sent["keys"].to_pylist()]
    keys = np.concatenate(lists)
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order] = np.append(equal, False) | np.insert(equal, 0, False)
    answers = [x[own] for x, own in zip(lists, np.split(shared, np.cumsum([len(x) for x in lists])[:-1]))]
    return rows_of(ANSWERED, [(b, pack_sorted(x)) for b, x in zip(sent["bucket"].to_pylist(), answers) if len(x)])


def send_runs(parts: int, bits: int):
    def run(bucket: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(bucket):
            return rows_of(RUN, [])
        name = bucket["bucket"][0].as_py()
        _, ids, texts = bucket_texts(unpacked(bucket))
        number, at, core, first, last, data, _ = anchors_of_all(texts)
        elsewhere = np.sort(np.concatenate([np.empty(0, np.uint64), *map(unpack_sorted, answers["keys"].to_pylist())]))
        doc = ids[number]
        order = np.argsort(core, kind="stable")
        bounds = np.flatnonzero(np.diff(core[order], prepend=~core[order][:1]) != 0)
        here = np.zeros(len(core), bool)
        if len(order):
            several = np.minimum.reduceat(doc[order], bounds) < np.maximum.reduceat(doc[order], bounds)
            here[order] = np.repeat(several, np.diff(np.append(bounds, len(order))))
        brief = short(core, bits)
        where = np.minimum(np.searchsorted(elsewhere, brief), max(0, len(elsewhere) - 1))
        going = np.flatnonzero(here | (elsewhere[where] == brief) if len(elsewhere) else here)
        going = going[np.argsort(doc[going], kind="stable")]
        keys = keys_of(data, at[going], first[going], last[going])
        order = sorted_order(keys)
        going, keys = going[order], keys[order]
        fresh = prefix_lengths(keys) < KEY
        if len(fresh):
            fresh[0] = True
        smallest = doc[going][np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(going) else doc[going]
        mine = doc[going] == smallest
        settled = going[~mine]
        rows = [(name % parts, name, SETTLED, b"", b"", pack(first[settled]), pack(last[settled] + SPAN))] if len(settled) else []
        going, keys = going[mine], keys[mine]
        part = (core[going] // np.uint64((1 << 64) // parts + 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        going, keys, part = going[order], keys[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        press = zstandard.ZstdCompressor(level=1)
        for p in np.unique(part):
            own, block = going[cuts[p] : cuts[p + 1]], keys[cuts[p] : cuts[p + 1]]
            lcps = prefix_lengths(block)
            rests = block[np.arange(KEY) >= lcps[:, None]]
            rows.append((int(p), name, RUNS, pack(lcps.astype(np.uint8)), press.compress(rests.tobytes()), pack(doc[own]), pack(at[own])))
        return rows_of(RUN, rows)

    return run


def front_coded(lcps: list[int], rests: bytes, run: int) -> Iterator[tuple[int, bytes, tuple[int, int]]]:
    key, at = b"", 0
    for i, lcp in enumerate(lcps):
        key = key[:lcp] + rests[at : at + KEY - lcp]
        at += KEY - lcp
        yield lcp, key, (run, i)


def covered_offsets(keys: np.ndarray, lcps: np.ndarray, smallest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per distinct sorted key: least and largest offset of its strings that another key has under a smaller doc_id (least > largest: none)."""
    least, most = np.full(len(keys), SPAN), np.full(len(keys), -1)
    group = np.cumsum(lcps < GRAM)
    rows = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(rows):
        return least, most
    low, high = keys[rows, -2], keys[rows, -1]
    left = keys[rows, SPAN : SPAN + LEFT]
    order = sorted_order(left)
    left_lcps = prefix_lengths(left[order])
    left_class = np.empty(len(rows), np.int64)
    for offset in range(SPREAD):
        own = np.flatnonzero((low <= offset) & (offset <= high))
        if len(own) < 2:
            continue
        left_class[order] = np.cumsum(left_lcps < offset)
        right_class = np.cumsum(lcps < SPAN - offset)[rows[own]]
        code = right_class * (len(rows) + 1) + left_class[own]
        by = np.argsort(code, kind="stable")
        bounds = np.flatnonzero(np.diff(code[by], prepend=-1) != 0)
        first = np.repeat(np.minimum.reduceat(smallest[rows[own]][by], bounds), np.diff(np.append(bounds, len(by))))
        hit = rows[own][by][smallest[rows[own]][by] > first]
        least[hit] = np.minimum(least[hit], offset)
        most[hit] = np.maximum(most[hit], offset)
    return least, most


def settle(keys: list[bytes], lcps: list[int], which: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest covered offset of each entry: which of the sorted distinct keys it has, and under what doc_id."""
    matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), KEY)
    smallest = np.minimum.reduceat(doc, np.flatnonzero(np.diff(which, prepend=-1)))
    least, most = covered_offsets(matrix, np.array(lcps), smallest)
    whole = doc > smallest[which]
    return np.where(whole, matrix[which, -2], least[which]), np.where(whole, matrix[which, -1], most[which])


def merge_runs(sent: pa.Table) -> pa.Table:
    """Ranges covered, per bucket. Keys are held until the gram changes and FLUSH_KEYS have come."""
    rows = sorted(sent.to_pylist(), key=lambda r: r["bucket"])
    out = [(r["bucket"], r["ids"], r["places"]) for r in rows if r["kind"] == SETTLED]
    rows = [r for r in rows if r["kind"] == RUNS]
    if not rows:
        return rows_of(COVERED, out)
    press = zstandard.ZstdDecompressor()
    runs = [front_coded(unpack(r["lcps"], np.uint8).tolist(), press.decompress(r["rests"]), i) for i, r in enumerate(rows)]
    counts = [len(unpack(r["lcps"], np.uint8)) for r in rows]
    ids, places = (np.concatenate([unpack(r[c], np.int64) for r in rows]) for c in ("ids", "places"))
    starts = np.cumsum([0, *counts]).tolist()
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    keys, lcps, entry, which = [], [], [], []

    def flush() -> None:
        found = np.array(entry)
        least, most = settle(keys, lcps, np.array(which), ids[found])
        hit = np.flatnonzero(least <= most)
        hits.append((found[hit], places[found[hit]] - most[hit], places[found[hit]] - least[hit] + SPAN))
        for held in (keys, lcps, entry, which):
            held.clear()

    for lcp, key, (run, i) in merge(runs):
        if lcp < GRAM and len(keys) >= FLUSH_KEYS:
            flush()
        if lcp < KEY or not keys:
            keys.append(key)
            lcps.append(lcp if len(keys) > 1 else 0)
        entry.append(starts[run] + i)
        which.append(len(keys) - 1)
    flush()
    at, begins, ends = (np.concatenate(x) for x in zip(*hits))
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], starts)
    for r, a, b in zip(rows, cuts, cuts[1:]):
        if a < b:
            own = order[a:b]
            out.append((r["bucket"], pack(begins[own]), pack(ends[own])))
    return rows_of(COVERED, out)


def removed_bytes(texts: list[bytes], covered: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end, which of their bytes go, and the texts' offsets."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    starts, ends = (np.concatenate([np.empty(0, np.int64), *(unpack(x, np.int64) for x in covered[c].to_pylist())]) for c in ("starts", "ends"))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    apart = np.flatnonzero(starts[1:] > ends[:-1]) + 1  # ranges that touch or overlap are one
    change = np.zeros(offsets[-1] + 1, np.int8)
    if len(starts):
        change[starts[np.insert(apart, 0, 0)]] = 1
        change[ends[np.append(apart - 1, len(ends) - 1)]] = -1
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(change[:-1], dtype=np.int8) > 0, offsets


def report_spans(bucket: pa.Table, covered: pa.Table) -> pa.Table:
    _, ids, texts = bucket_texts(unpacked(bucket))
    data, gone, offsets = removed_bytes(texts, covered)
    rows = []
    for doc_id, a, b in zip(ids.tolist(), offsets, offsets[1:]):
        own = gone[a:b]
        spans = int(np.count_nonzero(own[1:] & ~own[:-1]) + (own[:1].any()))
        rows.append((None if doc_id == NO_ID else doc_id, int(b - a), int(own.sum()), spans, hashlib.sha256(data[a:b][~own].tobytes()).hexdigest()))
    return rows_of(SPANS, rows)


def cut_texts(columns: list[str], text: str):
    """The bucket's rows with what is left of their texts; pieces of characters cut through go too."""

    def run(bucket: pa.Table, covered: pa.Table) -> pa.Table:
        bucket = unpacked(bucket)
        order, _, texts = bucket_texts(bucket)
        data, gone, offsets = removed_bytes(texts, covered)
        rows = bucket.take(pa.array(order, pa.int64()))
        left = [data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(offsets, offsets[1:])]
        null = rows["__data"].is_null().to_pylist()
        whole = pa.array([None if n else t for n, t in zip(null, left)], pa.string())
        return pa.table([whole if c == text else rows[c] for c in columns], names=columns)

    return run


def covered_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs dealt to buckets, and the ranges to remove by bucket."""
    n_bytes = text_bytes(docs)
    buckets = max(bucket_count(n_bytes, BUCKET_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = min(64, n_bytes.bit_length() + 12)  # a core is taken for another one about once in 40,000
    rows = docs.withColumns({
        "__id": F.col("doc_id").cast("long"), "__data": F.col("text").cast("binary"),
        "__bucket": F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("long"),
    })
    found = dealt(rows.drop("text"), "__bucket")
    answers = found.groupBy("bucket").applyInArrow(send_cores(buckets, bits), SENT).groupBy("part").applyInArrow(answer_cores, ANSWERED)
    runs = found.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(send_runs(buckets, bits), RUN)
    return found, runs.groupBy("part").applyInArrow(merge_runs, COVERED)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """What is removed from every document, and the digest of what is left."""
    docs = docs.select("doc_id", "text")
    found, covered = covered_ranges(docs)
    return found.groupBy("bucket").cogroup(covered.groupBy("bucket")).applyInArrow(report_spans, SPANS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; all rows and columns stay."""
    found, covered = covered_ranges(docs)
    return found.groupBy("bucket").cogroup(covered.groupBy("bucket")).applyInArrow(cut_texts(docs.columns, "text"), docs.schema)


def op4_front_coded_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
