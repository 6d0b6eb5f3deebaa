"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Documents are dealt to buckets of bounded size. A bucket cuts its texts into pre-tokens and sends its distinct words,
   packed, to the owners of the words' hash ranges.
2. An owner encodes each distinct word of the corpus once and answers every bucket with the ids, in the order asked.
   A frequent word comes at most once from a bucket, so it is no hot key.
3. The bucket joins the ids back to its pre-tokens and puts each document together by position; decoding looks every id
   up in the token-byte table (as many entries as the vocabulary has, broadcast).

Words and ids cross the network packed, never as a row per token. Nothing is decided by the order of rows, so that a
lost task gives the same when it runs again. A task holds one bucket, or one longer document.

Defined results: null texts count as empty (0 tokens, digests of the empty string); repeated rows are encoded each for
itself; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrillo.llm.common import bucket_count, dealt, rows_of, table, text_bytes, unpacked
from corrillo.llm.packing import pack, unpack

BUCKET_BYTES = 4 << 20
#: Text bytes whose words one owner encodes; words take about a fifth of that on their way, as a bucket sends each one once.
OWNER_BYTES = 64 << 20
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: White space as Unicode has it (fixed values); Python's \s also takes U+001C to U+001F.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SENT = "part long, bucket long, lengths binary, words binary"
ANSWERED = "bucket long, part long, sizes binary, ids binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def splitter(pattern: str) -> regex.Pattern:
    pattern = pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\s", rf"[{SPACE}]").replace(r"\S", rf"[^{SPACE}]")
    return regex.compile(pattern)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(shared: Broadcast, name: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of the broadcast vocabulary `name`, built once in a worker."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
    return _encoders[name]


class Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def bucket_texts(bucket: pa.Table) -> tuple[list, list[str]]:
    """doc_ids and texts in one order, whatever order the rows came in, so that questions and answers agree."""
    rows = unpacked(bucket)
    pairs = sorted(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    return [i for i, _ in pairs], [t or "" for _, t in pairs]


def by_owner(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers grouped by owner, and where each owner's begin and end."""
    owners = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
    order = np.argsort(owners, kind="stable")
    return order, np.searchsorted(owners[order], np.arange(parts + 1))


def send_words(parts: int, pattern: str):
    def run(key: tuple, bucket: pa.Table) -> pa.Table:
        find, press = splitter(pattern).findall, zstandard.ZstdCompressor(level=3)
        words: dict[str, None] = {}
        for text in bucket_texts(bucket)[1]:
            words.update(dict.fromkeys(find(text)))
        encoded = [w.encode() for w in words]
        order, cuts = by_owner(encoded, parts)
        rows = []
        for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                own = [encoded[i] for i in order[a:b].tolist()]
                rows.append((part, key[0].as_py(), pack(np.array([len(w) for w in own], np.uint32)), press.compress(b"".join(own))))
        return rows_of(SENT, rows)

    return run


def encode_words(shared: Broadcast, name: str, pattern: str):
    def run(sent: pa.Table) -> pa.Table:
        encode = encoder(shared, name, pattern).encode_ordinary
        unzip, known, rows = zstandard.ZstdDecompressor(), {}, []
        for bucket, part, lengths, words in zip(*(sent[c].to_pylist() for c in ("bucket", "part", "lengths", "words"))):
            data, at, answer = unzip.decompress(words), 0, []
            for n in unpack(lengths, np.uint32).tolist():
                word = data[at : at + n]
                at += n
                if (ids := known.get(word)) is None:
                    ids = known[word] = encode(word.decode())
                answer.append(ids)
            sizes = np.fromiter(map(len, answer), np.uint32, len(answer))
            rows.append((bucket, part, pack(sizes), pack(np.fromiter(chain.from_iterable(answer), np.uint32, int(sizes.sum())))))
        return rows_of(ANSWERED, rows)

    return run


def put_together(shared: Broadcast, parts: int, pattern: str):
    def run(bucket: pa.Table, answers: pa.Table) -> pa.Table:
        find, numbers = splitter(pattern).findall, Numbers()
        doc_ids, texts = bucket_texts(bucket)
        codes = [np.fromiter(map(numbers.__getitem__, find(text)), np.uint32) for text in texts]
        order, _ = by_owner([w.encode() for w in numbers], parts)
        rows = sorted(zip(*(answers[c].to_pylist() for c in ("part", "sizes", "ids"))))
        sizes, ids = (np.concatenate([np.empty(0, np.uint32), *(unpack(r[k], np.uint32) for r in rows)]) for k in (1, 2))
        tokens = {i: (str(i).encode(), token) for token, i in shared.value.items()}  # not kept: a worker's memory is the tasks' of all stages
        n, listed, decoded = np.zeros(len(order), np.int64), [b""] * len(order), [b""] * len(order)
        n[order] = sizes
        ends, ids = np.cumsum(sizes).tolist(), ids.tolist()
        for number, size, end in zip(order.tolist(), sizes.tolist(), ends):
            own = [tokens[i] for i in ids[end - size : end]]
            listed[number] = b",".join([t[0] for t in own])
            decoded[number] = b"".join([t[1] for t in own])
        out = []
        for doc_id, own in zip(doc_ids, codes):
            at = own.tolist()
            digests = (hashlib.sha256(by.join([known[k] for k in at])).hexdigest() for by, known in ((b",", listed), (b"", decoded)))
            out.append((doc_id, int(n[own].sum()), *digests))
        return rows_of(RESULT, out)

    return run


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text by the ranks in the file `vocabulary`, cut by `pattern`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    n_bytes, least = text_bytes(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, parts = (max(bucket_count(n_bytes, size), least) for size in (BUCKET_BYTES, OWNER_BYTES))
    ranks = read_ranks(vocabulary)
    shared, name = spark.sparkContext.broadcast(ranks), hashlib.sha256(b"".join(ranks)).hexdigest()  # as many entries as the vocabulary
    found = dealt(docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("long")), "bucket")
    answers = found.groupBy("bucket").applyInArrow(send_words(parts, pattern), SENT).groupBy("part").applyInArrow(encode_words(shared, name, pattern), ANSWERED)
    return found.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(put_together(shared, parts, pattern), RESULT)


def byte_bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))
