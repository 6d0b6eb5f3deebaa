"""The pipeline's stages, one after the other, against plain Python on the smallest tables; queries against their SQL."""

import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from test_against_brute_force import classes_by_force

import corpus_pipeline
from corrillo.llm import bpe, quality, queries
from corrillo.llm.common import table

SMALLEST = "/root/testdata/sf0.001"


def kept_by_rules(rows):
    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    return [(i, t) for i, t in rows if quality.judge((t or "").encode(), press)[6]]


def kept_by_classes(rows):
    label = classes_by_force(rows)
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    return [(i, t) for i, t in rows if label[i] == i and first[t] == i]


def cut(rows):
    first, out = {}, []
    for i, t in sorted(rows):
        data = t.encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    for i, t in rows:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = True
        out.append((i, np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return out


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def uncontaminated(rows, items):
    windows = {tuple(w[k : k + 13]) for w in map(words, items) for k in range(max(1, len(w) - 12)) if w}
    out = []
    for i, t in rows:
        w = words(t)
        hit = {k + j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(w):
            out.append((i, t))
    return out


def encoded(rows):
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = [(i, plain.encode_ordinary(t), t.encode()) for i, t in rows]
    return [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t).hexdigest()) for i, ids, t in found]


def test_stages(spark):
    docs = table(spark, SMALLEST, "documents")
    items = [r["text"] for r in table(spark, SMALLEST, "benchmark").collect()]
    expected = [(r["doc_id"], r["text"]) for r in docs.collect()]
    steps = [kept_by_rules, kept_by_classes, cut, lambda rows: uncontaminated(rows, items)]
    for (_, stage), by_hand in zip(corpus_pipeline.STAGES, steps):
        docs = stage(spark, docs, SMALLEST)
        expected = by_hand(expected)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(expected)
        docs = spark.createDataFrame(rows, docs.schema)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SMALLEST).collect()
    assert sorted(map(tuple, final)) == sorted(encoded(expected))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALLEST).collect())) == sorted(map(tuple, final))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    found = queries.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, result.fetchall()))
