"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the set of its shingles of five words, each weighing 1 + ln(count) times its smoothed inverse document
frequency, augmented by AUGMENT. Two documents are linked from THRESHOLD weighted Jaccard similarity (sum of least weights by sum of
largest); a class is what links connect, named by its smallest doc_id.

1. Buckets of documents send their shingles to the owners of hash ranges and get back in how many documents each
   occurs: exact frequencies over all documents.
2. A document of which less than THRESHOLD of the weight also occurs elsewhere can have no link and stops here. The
   others are sampled (ICWS: BANDS * ROWS samples), and each band's samples make a key.
3. Documents that share a band key are candidates; candidate groups are connected over ids alone, so that the vectors of
   a group meet once.
4. Within a group the texts that share a band are compared, and only verified links make classes. A group of more than
   GROUP_BYTES (many texts, each alike to some others) is taken apart again into the buckets of single bands, of which
   those with the same texts are verified once. A bucket that is too large as well is verified in blocks over many
   tasks: some leaders against every block, then what they left over against every block.

Copies of a text in a bucket are one entry, so a text copied very often is at most one row per bucket from then on.

Defined results: documents without a word (null, empty, punctuation) are in a class with equal texts only, null being
one such text; a text of fewer than five words has one shingle; the smallest doc_id of a class may be null, which is
smaller than any other; repeated rows are in one class; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrillo.llm.common import bucket_count, dealt, drop_keys, rows_of, table, unpacked, written
from corrillo.llm.packing import pack, pack_sorted, split_by_range, unpack, unpack_sorted
from corrillo.llm.shingles import mixed, shingles

THRESHOLD = 0.8
BANDS, ROWS = 12, 4
#: The augmented inverse document frequency is AUGMENT..1, as augmented term frequencies are: shingles of large groups of
#: near copies, frequent by definition, count for half of unique ones at least. 0 is the plain inverse document frequency.
AUGMENT = 0.5
BUCKET_BYTES = 8 << 20
SAMPLED_ENTRIES = 1 << 17
GROUP_BYTES = 24 << 20
LEADERS = 16
NO_ID = -(1 << 63)
U64 = np.uint64

SENT = "part long, bucket long, keys binary, counts binary"
COUNTED = "bucket long, part long, counts binary"
SAMPLED = "d1 long, d2 long, doc_id long, bands array<long>, shingles binary, weights binary, bytes long"
LINKED = "a1 long, a2 long, a_id long, b1 long, b2 long, b_id long"


def send_shingles(parts: int, bits: int):
    def run(key: tuple, bucket: pa.Table) -> pa.Table:
        _, codes, _ = shingles([x or b"" for x in unpacked(bucket)["data"].to_pylist()], bits)
        keys, counts = np.unique(codes, return_counts=True)
        cuts = split_by_range(keys << U64(64 - bits), parts)
        return rows_of(SENT, [(p, key[0].as_py(), pack_sorted(keys[a:b]), pack(counts[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b])

    return run


def count_shingles(sent: pa.Table) -> pa.Table:
    """To each bucket the document frequencies of the shingles it sent, in its order."""
    lists = [unpack_sorted(k) for k in sent["keys"].to_pylist()]
    keys, counts = np.concatenate(lists), np.concatenate([unpack(c, np.uint32) for c in sent["counts"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    fresh = np.append(True, keys[order][1:] != keys[order][:-1])
    sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(fresh))
    total = np.empty(len(keys), np.int64)
    total[order] = sums[np.cumsum(fresh) - 1]
    ends = np.cumsum([len(x) for x in lists])
    part = sent["part"][0].as_py()
    return rows_of(COUNTED, [(b, part, pack(total[e - len(x) : e])) for b, x, e in zip(sent["bucket"].to_pylist(), lists, ends)])


def icws(codes: np.ndarray, weights: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """Consistent weighted samples of documents whose shingles begin at `starts`: a row per document."""
    out = np.empty((len(starts), samples), U64)
    document = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    log_weights = np.log(weights).astype(np.float32)

    def uniform(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = (h & U64(0xFFFFFFFF)).astype(np.uint32), (h >> U64(32)).astype(np.uint32)
        return tuple((x >> np.uint32(8)).astype(np.float32) * np.float32(2**-24) + np.float32(2**-25) for x in (low, high))

    for k in range(samples):
        seed = mixed(codes + U64((k * 0x9E3779B97F4A7C15 + 1) % (1 << 64)))
        u1, u2 = uniform(seed)
        u3, u4 = uniform(mixed(seed + U64(1)))
        beta, _ = uniform(mixed(seed + U64(2)))
        r, c = -np.log(u1 * u2), -np.log(u3 * u4)
        t = np.floor(log_weights / r + beta)
        value = np.log(c) - r * (t - beta) - r
        least = np.minimum.reduceat(value, starts)
        first = np.flatnonzero(value == least[document])
        first = first[np.diff(document[first], prepend=-1) != 0]
        out[:, k] = mixed(codes[first] ^ mixed(t[first].astype(np.int64).view(U64) + U64(k)))
    return out


def blocks_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Documents, by number, in blocks of about SAMPLED_ENTRIES shingles, a longer document by itself."""
    cuts = [0]
    while cuts[-1] < len(starts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + SAMPLED_ENTRIES))))
    return list(zip(cuts, cuts[1:]))


def keys_of_documents(codes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys, a row per document; only a block's numbers are in memory at a time."""
    out, ends = [np.empty((0, BANDS), np.int64)], np.append(starts, len(codes))
    for i, j in blocks_of(starts):
        own = slice(ends[i], ends[j])
        out.append(band_keys(icws(codes[own], weights[own], starts[i:j] - starts[i], BANDS * ROWS)))
    return np.concatenate(out)


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), U64)
    for band in range(BANDS):
        for row in range(ROWS):
            keys[:, band] = mixed(keys[:, band] + samples[:, band * ROWS + row] + U64(band))
    return keys.view(np.int64)


def idf(frequency: np.ndarray, n_docs: int, augment: float = AUGMENT) -> np.ndarray:
    """The smoothed inverse document frequency 1 + ln((1 + N) / (1 + df)), 1 for a shingle of one document, scaled to augment..1."""
    whole = 1 + np.log((1 + n_docs) / 2)
    return augment + (1 - augment) * (1 + np.log((1 + n_docs) / (1 + frequency))) / whole


def tf(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def sample_bucket(n_docs: int, bits: int, augment: float):
    def run(bucket: pa.Table, counted: pa.Table) -> pa.Table:
        copies: dict[tuple[int, int], tuple[int, bytes]] = {}
        bucket = unpacked(bucket)
        for d1, d2, doc_id, data in zip(*(bucket[c].to_pylist() for c in ("d1", "d2", "id", "data"))):
            doc_id = NO_ID if doc_id is None else doc_id
            if (d1, d2) not in copies or doc_id < copies[d1, d2][0]:
                copies[d1, d2] = doc_id, data or b""
        if not copies:
            return rows_of(SAMPLED, [])
        names, ids, texts = list(copies), [x[0] for x in copies.values()], [x[1] for x in copies.values()]
        number, codes, counts = shingles(texts, bits)
        rows = sorted(zip(counted["part"].to_pylist(), counted["counts"].to_pylist()))
        total = np.concatenate([np.empty(0, np.int64), *(unpack(c, np.int64) for _, c in rows)])
        frequency = total[np.searchsorted(np.unique(codes), codes)]
        weights = (tf(counts) * idf(frequency, n_docs, augment)).astype(np.float32)
        n = len(texts)
        whole = np.bincount(number, weights, n)
        shared = np.bincount(number, weights * (frequency > 1), n)
        going = shared >= THRESHOLD * whole * (1 - 1e-6)
        own = going[number] & (whole > 0)[number]
        starts = np.flatnonzero(np.diff(number[own], prepend=-1) != 0)
        keys = keys_of_documents(codes[own], weights[own], starts)
        at = dict(zip(number[own][starts].tolist(), range(len(starts))))
        ends = np.append(starts, own.sum())[1:]
        codes, weights, out = codes[own], weights[own], []
        for i in np.flatnonzero(going).tolist():
            k = at.get(i)
            a, b = (starts[k], ends[k]) if k is not None else (0, 0)
            out.append((*names[i], ids[i], keys[k].tolist() if k is not None else [], pack_sorted(codes[a:b]), pack(weights[a:b]), int(12 * (b - a))))
        return rows_of(SAMPLED, out)

    return run


class Vectors:
    """The vectors of some documents end to end, one entry for each text, by doc_id, with their band keys."""

    def __init__(self, group: pa.Table) -> None:
        found: dict[tuple[int, int], tuple] = {}
        for d1, d2, doc_id, *rest in zip(*(group[c].to_pylist() for c in ("d1", "d2", "doc_id", "shingles", "weights", "bands"))):
            if (d1, d2) not in found or doc_id < found[d1, d2][0]:
                found[d1, d2] = doc_id, *rest
        order = sorted(found, key=lambda d: (found[d][0], d))
        self.names, self.ids = order, [found[d][0] for d in order]
        codes = [unpack_sorted(found[d][1]) for d in order]
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = np.concatenate([np.empty(0, U64), *codes])
        self.weights = np.concatenate([np.empty(0, np.float32), *(unpack(found[d][2], np.float32) for d in order)])
        self.row = np.repeat(np.arange(len(order)), self.sizes)
        self.total = np.bincount(self.row, self.weights, len(order))
        self.bands = np.array([found[d][3] for d in order], np.int64).reshape(len(order), BANDS)

    def one(self, i: int) -> tuple[np.ndarray, np.ndarray, float]:
        own = slice(self.starts[i], self.starts[i] + self.sizes[i])
        return self.codes[own], self.weights[own], self.total[i]

    def candidates(self, bands: np.ndarray) -> np.ndarray:
        """A mask of the texts that share a band."""
        return (self.bands == bands).any(1)

    def similar(self, codes: np.ndarray, weights: np.ndarray, total: float, among: np.ndarray) -> np.ndarray:
        """Numbers of those `among` (a mask) with THRESHOLD weighted Jaccard similarity to the vector given."""
        fits = among & (np.minimum(self.total, total) >= THRESHOLD * np.maximum(self.total, total) * (1 - 1e-6))
        rows = np.flatnonzero(fits)
        if not len(codes) or not len(rows):
            return np.empty(0, np.int64)
        entries = np.concatenate([np.arange(self.starts[r], self.starts[r] + self.sizes[r]) for r in rows])
        at = np.minimum(np.searchsorted(codes, self.codes[entries]), len(codes) - 1)
        both = codes[at] == self.codes[entries]
        least = np.where(both, np.minimum(weights[at], self.weights[entries]), 0)
        least = np.bincount(self.row[entries], least, len(self.ids))
        return np.flatnonzero(fits & (least >= THRESHOLD * (total + self.total - least) * (1 - 1e-6)) & (least > 0))


def verify_group(group: pa.Table) -> pa.Table:
    """The class of every text in a candidate group: only texts that share a band are compared, only verified links connect."""
    v = Vectors(group)
    label, later = np.arange(len(v.ids)), np.arange(len(v.ids))
    for i in range(len(v.ids)):
        others = (label != label[i]) & (later > i)
        if others.any():
            for j in v.similar(*v.one(i), others & v.candidates(v.bands[i])):
                if label[j] != label[i]:
                    low, high = sorted((label[i], label[j]))
                    label[label == high] = low
    return rows_of(LINKED, [(*name, i, *v.names[k], v.ids[k]) for name, i, k in zip(v.names, v.ids, label.tolist())])


def verify_blocks(leaders: pa.Table, block: pa.Table) -> pa.Table:
    """Links of each of some texts with the texts of a block."""
    if not len(leaders) or not len(block):
        return rows_of(LINKED, [])
    a, b = Vectors(leaders), Vectors(block)
    out = []
    for i, (name, doc_id) in enumerate(zip(a.names, a.ids)):
        out += [(*b.names[j], b.ids[j], *name, doc_id) for j in b.similar(*a.one(i), np.ones(len(b.ids), bool))]
    return rows_of(LINKED, out)


def connected(edges: DataFrame, tag: str) -> DataFrame:
    """node, label: the least node in each component of the bipartite edges (node, hub)."""
    edges = written(edges.distinct(), f"{tag}-edges")
    labels = written(edges.select("node", F.col("node").alias("label")).distinct(), f"{tag}-labels")
    while True:
        hubs = edges.join(labels, "node").groupBy("hub").agg(F.min("label").alias("label"))
        found = edges.join(hubs, "hub").groupBy("node").agg(F.min("label").alias("label"))
        jumps = found.join(found.select(F.col("node").alias("label"), F.col("label").alias("jump")), "label", "left")
        found = written(jumps.select("node", F.least("label", F.coalesce("jump", "label")).alias("label")), f"{tag}-labels")
        if not found.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count():
            return found
        labels = found


def linked(links: DataFrame) -> DataFrame:
    """The edges of verified links, between texts as structs that sort by doc_id."""
    a, b = F.struct("a_id", "a1", "a2"), F.struct("b_id", "b1", "b2")
    return links.select(a.alias("node"), b.alias("hub")).union(links.select(b.alias("node"), b.alias("hub")))


def verify_buckets(large: DataFrame) -> DataFrame:
    """The links within candidate groups that are too large for a task: verified in each bucket of a band for itself.

    Of buckets with the same texts one is enough. A bucket that is too large as well is verified in blocks.
    """
    hits = large.select("d1", "d2", "bytes", F.posexplode("bands").alias("band", "key"))
    sized = hits.distinct().groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bucket_bytes"), F.bit_xor(F.xxhash64("d1", "d2")).alias("members")).where("n > 1")
    one = sized.groupBy("members", "n").agg(F.min(F.struct("band", "key", "bucket_bytes")).alias("b")).select(F.xxhash64("b.band", "b.key").alias("group"), "b.bucket_bytes")
    chosen = written(one, "near-buckets")
    keyed = large.withColumn("group", F.explode(F.transform("bands", lambda key, band: F.xxhash64(band, key))))
    inside = keyed.join(chosen.where(F.col("bucket_bytes") <= GROUP_BYTES).drop("bucket_bytes"), "group")
    links = inside.groupBy("group").applyInArrow(verify_group, LINKED)
    beyond = chosen.where(F.col("bucket_bytes") > GROUP_BYTES)
    if beyond.limit(1).count():
        links = links.union(verify_in_blocks(written(keyed.join(beyond, "group"), "near-beyond")))
    return links


def verify_in_blocks(large: DataFrame) -> DataFrame:
    """The links in buckets that are too large for a task: leaders against every block, then what they left over against every block."""
    blocks = F.ceil(F.col("bucket_bytes") / GROUP_BYTES * 4).cast("long")
    large = large.withColumn("block", F.pmod(F.xxhash64("d1", "d2"), blocks)).withColumn("blocks", blocks)

    def links(left: DataFrame) -> DataFrame:
        spread = left.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = large.join(left.select("group", "part").distinct().withColumnRenamed("group", "g"), F.col("group") == F.col("g")).drop("g").withColumn("to", F.col("block"))
        on = ("group", "part", "to")
        spread, right = spread.toDF(*spread.columns), right.toDF(*right.columns)
        return spread.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(verify_blocks, LINKED)

    slot = F.pmod(F.xxhash64("d1", "d2", F.lit("leader")), F.lit(4096))
    leaders = large.groupBy("group").agg(F.slice(F.array_sort(F.collect_set(slot)), 1, LEADERS).alias("chosen"))
    chosen = large.join(leaders, "group").where(F.array_contains("chosen", slot)).drop("chosen")
    # a leader's slot may hold many texts of a very large bucket; each part of them is a task of bounded size
    first = written(links(chosen.withColumn("part", F.pmod(F.xxhash64("d1", "d2", F.lit("part")), F.col("blocks")))), "near-links")
    labels = connected(linked(first), "near-first")
    sized = large.withColumn("node", F.struct(F.col("doc_id").alias("a_id"), F.col("d1").alias("a1"), F.col("d2").alias("a2"))).join(labels, "node", "left")
    most = sized.where("label IS NOT NULL").groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = sized.join(most, "group", "left").where("label IS NULL OR label <> main").drop("node", "label", "main")
    return first.union(links(rest.withColumn("part", F.col("block"))))


def classes(docs: DataFrame, n_bytes: int, n_docs: int, augment: float = AUGMENT) -> DataFrame:
    """d1, d2 (a text), class_id and c1, c2 (the class's first text) of every text."""
    spark = docs.sparkSession
    buckets = max(bucket_count(n_bytes, BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = min(64, max(40, int(np.ceil(np.log2(max(2, n_bytes)))) + 20))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), *text_keys(), F.col("text").cast("binary").alias("data"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("long").alias("bucket"),
    )
    texts_dealt = dealt(rows, "bucket")
    counted = texts_dealt.groupBy("bucket").applyInArrow(send_shingles(buckets, bits), SENT).groupBy("part").applyInArrow(count_shingles, COUNTED)
    sampled = written(texts_dealt.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(sample_bucket(n_docs, bits, augment), SAMPLED), "near-sampled")
    own = F.struct(F.min("doc_id").alias("class_id"), F.col("d1").alias("c1"), F.col("d2").alias("c2"))
    texts = sampled.groupBy("d1", "d2").agg(own.alias("own"))
    hubs = sampled.select(F.col("d1").alias("node"), F.posexplode("bands").alias("band", "key")).distinct()
    shared = hubs.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    edges = hubs.join(shared, ["band", "key"]).select("node", F.xxhash64("band", "key").alias("hub"))
    groups = connected(edges, "near-groups").select(F.col("node").alias("d1"), F.col("label").alias("group"))
    members = sampled.join(groups, "d1")
    sizes = written(members.groupBy("group").agg(F.sum("bytes").alias("group_bytes")).where(F.col("group_bytes") > GROUP_BYTES), "near-large")
    whole = members.join(sizes.select("group"), "group", "left_anti")
    links = whole.groupBy("group").applyInArrow(verify_group, LINKED)
    if sizes.limit(1).count():
        # a group is wholly verified in one way, so that links of both ways never meet
        large = verify_buckets(written(members.join(sizes.select("group"), "group").drop("group"), "near-members"))
        named = connected(linked(large), "near-classes").select("node.a1", "node.a2", *(F.col(f"label.a{x}").alias(f"b{x}") for x in ("_id", "1", "2")))
        links = links.select("a1", "a2", "b_id", "b1", "b2").union(named)
    # a text that is in no group is its own class; verification names a class by its smallest doc_id and that one's text
    first = F.min(F.struct(F.col("b_id").alias("class_id"), F.col("b1").alias("c1"), F.col("b2").alias("c2")))
    verified = links.groupBy(F.col("a1").alias("d1"), F.col("a2").alias("d2")).agg(first.alias("verified"))
    return texts.join(verified, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("verified", "own").alias("c")).select("d1", "d2", "c.*")


def text_keys() -> tuple:
    """Two independent hashes of the text, null told apart from empty."""
    return F.xxhash64("text", F.col("text").isNull()).alias("d1"), F.xxhash64(F.lit("second"), F.col("text").isNull(), "text").alias("d2")


def near_duplicates(docs: DataFrame, augment: float = AUGMENT) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class) of every document, with the text's d1, d2 and those of the class's first text."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # a table of its own, so that the join can split a text that very many documents have
    found = written(classes(docs, size[1], size[0], augment), "near-classes")
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), *text_keys()).join(found, ["d1", "d2"], "left")
    known = lambda c, own: F.coalesce(F.col(c), F.col(own)).alias(c)
    named = named.select("id", "d1", "d2", known("class_id", "id"), known("c1", "d1"), known("c2", "d2"))
    return named.select(*(F.when(F.col(c) != NO_ID, F.col(c)).alias(n) for c, n in (("id", "doc_id"), ("class_id", "class_id"))), "d1", "d2", "c1", "c2")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with all columns: the smallest (doc_id, text); of repeated rows that with the least hash."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID))
    rows = written(near_duplicates(docs).select(number("doc_id").alias("k1"), F.col("d1").alias("k2"), number("class_id").alias("first"), "c1"), "near-rows")
    keys = number("doc_id"), text_keys()[0]
    left = drop_keys(docs, rows.where("k1 <> first OR k2 <> c1").select("k1", "k2").distinct(), "near-bad", keys=keys)
    repeated = written(rows.where("k1 = first AND k2 = c1").groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"), "near-repeated")
    if not repeated.limit(1).count():
        return left
    again = left.select(F.struct(*left.columns).alias("r"), *(k.alias(n) for k, n in zip(keys, ("k1", "k2")))).join(repeated, ["k1", "k2"], "left_semi")
    one = again.groupBy("k1", "k2").agg(F.min_by("r", F.xxhash64("r")).alias("r")).select("r.*")
    return drop_keys(left, repeated, "near-bad", keys=keys).union(one)


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
