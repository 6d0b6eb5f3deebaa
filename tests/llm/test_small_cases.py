"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import gzip
import html
import html.entities
import random

import pytest
from pyspark.sql import functions as F

from corrillo.llm import bpe, chat, classifier, decontaminate, minhash, quality, sharding, suffix, urls, warc

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog " * 8, "en", 5, "clash"),
    (1, "the quick brown fox jumps over the lazy dog " * 8, "en", 5, "clash"),
    (2, None, None, None, None),
    (3, "", "en", 0, ""),
    (4, LONG, "en", 1, "x"),
    (5, LONG, "en", 1, "x"),
    (6, "\n\n \t", "en", 1, "x"),
    (7, "é日本 \U0001f600" * 30, None, 1, "x"),
    (None, "no id here " * 12, "en", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, n_words long, bucket string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "The QUICK brown fox"), (1, "The QUICK brown fox"), (2, None), (3, ""), (None, "nothing like it")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (4, 1), (3, None)], "doc_id long, quality int")


def per_document(spark, docs, benchmark, labels):
    return {
        "decontaminate": lambda d: decontaminate.report(d, benchmark),
        "quality": quality.measure,
        "suffix": suffix.repeated_spans,
        "classifier": lambda d: classifier.scored(d, classifier.fit(d, labels)),
        "bpe": bpe.byte_bpe,
        "minhash": minhash.near_duplicates,
        "sharding": sharding.bounded_ring,
    }


@pytest.mark.parametrize("name", ["decontaminate", "quality", "suffix", "classifier", "bpe", "minhash", "sharding"])
def test_one_row_per_row(spark, docs, benchmark, labels, name):
    run = per_document(spark, docs, benchmark, labels)[name]
    found = run(docs).select("doc_id").collect()
    assert sorted(str(r[0]) for r in found) == sorted(str(r[0]) for r in ROWS)
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [quality.keep_good, minhash.keep_one, suffix.remove_repeats])
def test_stages_keep_columns(docs, stage):
    found = stage(docs)
    assert found.columns == docs.columns
    assert found.count() <= len(ROWS)
    assert stage(docs.limit(0)).count() == 0


def test_decontaminate_stage_keeps_columns(docs, benchmark):
    found = decontaminate.drop_contaminated(docs, benchmark)
    assert found.columns == docs.columns
    assert {r[0] for r in found.select("doc_id").collect()} == {2, 3, 4, 5, 6, 7, None}


def test_short_items_and_repeated_items(docs, benchmark):
    rows = {r["doc_id"]: r for r in decontaminate.report(docs, benchmark).collect()}
    assert (rows[1]["n_words"], rows[1]["n_hit"], rows[1]["n_items"], rows[1]["contaminated"]) == (72, 32, 1, True)
    assert (rows[2]["n_words"], rows[2]["n_hit"], rows[2]["contaminated"]) == (0, 0, False)


def test_without_benchmark(spark, docs, benchmark):
    assert decontaminate.report(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    words = [f"w{i}" for i in range(13)]
    changed = ["other"] + words[1:]  # the two rarest words, w6 and w7, stay
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:6])), (4, " ".join(words[:5] + ["other"]))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    rows = {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in decontaminate.report(docs, items).collect()}
    assert rows == {1: (1, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


def test_equal_texts_share_a_class(docs):
    rows = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert rows == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, None: None}


def test_conversations(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"),
        (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"),
        (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"),
        (4, None, None, None), (5, 0, "user", "b"), (None, 0, "user", "z"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash"))
    found = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.collapse_and_render(turns).collect()}
    assert set(found) == {2, 4, 5, None}
    assert found[2] == (3, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n")
    assert found[4][1] == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.collapse_and_render(turns.limit(0)).count() == 0


def test_long_conversation_runs_over_blocks(spark):
    turns = spark.range(1000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    prefix = turns.where("turn < 700").selectExpr("2L AS conv_id", "turn", "role", "text")
    found = chat.collapse_and_render(turns.union(prefix)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in found] == [(1, 1000)]


def test_temporal_list(spark):
    entries = spark.sql("SELECT * FROM VALUES ('bad.org', timestamp_ntz'2024-01-02 00:00:00', 'add', 'x'), ('bad.org', timestamp_ntz'2024-01-05 00:00:00', 'remove', 'x') AS t(pattern, at, action, category)")
    captures = spark.sql("""SELECT * FROM VALUES (1, 'http://a.bad.org/x', timestamp_ntz'2024-01-01 00:00:00'), (2, 'http://a.bad.org/x', timestamp_ntz'2024-01-02 00:00:00'),
        (3, 'HTTP://BAD.org:80', timestamp_ntz'2024-01-04 23:00:00'), (4, 'http://bad.org', timestamp_ntz'2024-01-05 00:00:00'), (5, 'http://notbad.org', timestamp_ntz'2024-01-03 00:00:00'),
        (6, NULL, timestamp_ntz'2024-01-03 00:00:00'), (6, NULL, timestamp_ntz'2024-01-03 00:00:00'), (7, 'http://bad.org', NULL) AS t(page_id, url, fetch_time)""")
    found = sorted((r["page_id"], r["blocked"]) for r in urls.judged(captures, entries).collect())
    assert found == [(1, False), (2, True), (3, True), (4, False), (5, False), (6, False), (6, False), (7, False)]
    assert urls.judged(captures, entries.limit(0)).where("blocked").count() == 0


def test_hosts(spark):
    urls_ = {"HTTP://User@Sub.Bad.Org.:80/a": "sub.bad.org", "https://[2001:DB8::1]:443/x": "[2001:db8::1]", "ftp://10.0.0.1/": "10.0.0.1", "bad.org/x": "", "mailto:a@bad.org": "", "http:///x": ""}
    rows = spark.createDataFrame(list(urls_.items()), "u string, h string").select("h", urls.host_of(F.col("u")).alias("got"), urls.url_keys(F.col("u")).alias("keys")).collect()
    assert all(r["h"] == r["got"] for r in rows)
    keys = {r["h"]: r["keys"] for r in rows}
    assert keys["sub.bad.org"] == ["sub.bad.org", "bad.org", "org", "sub.bad.org/a", "bad.org/a", "org/a"] and keys["10.0.0.1"] == ["10.0.0.1"] and keys["[2001:db8::1]"] == ["[2001:db8::1]", "[2001:db8::1]/x"]


def test_read_list_and_clashing_columns(spark, tmp_path):
    (tmp_path / "list.csv").write_text("pattern,at,action,category\nBad.ORG.,2024-01-02,Add,x\nbad.org,2024-01-05 00:00:00,remove,x\n,2024-01-01,add,x\na.b,never,add,x\na.b/C,2024-01-01,add,y\na.b,2024-01-01,drop,x\n")
    entries = urls.read_entries(spark, str(tmp_path / "list.csv"))
    assert sorted((r["pattern"], r["action"]) for r in entries.collect()) == [("a.b/C", "add"), ("bad.org", "add"), ("bad.org", "remove")]
    captures = spark.sql("SELECT 1 AS page_id, 'http://x.bad.org./' AS url, timestamp_ntz'2024-01-03 00:00:00' AS fetch_time, 'k' AS key, 'p' AS pattern, 7 AS copies, 's' AS salt, 'b' AS best")
    assert [(r["blocked"], r["rule"]) for r in urls.judged(captures, entries).collect()] == [(True, "bad.org")]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_list_covers_every_flagged_host(spark, sf):
    """Whatever the top-level domain; spam-farm and adult-x but in their gaps."""
    found = urls.op7_temporal_list(spark, f"/root/testdata/{sf}").where("host RLIKE '(spam-farm|casino-win|free-bets|ads-track|cheap-pills|adult-x)'").collect()
    open_days = {"spam-farm": [("2024-01-01", "2024-01-03"), ("2024-04-01", "2024-06-15")], "adult-x": [("2024-01-09", "2024-01-10")]}
    assert len(found) >= 3
    for r in found:
        gaps = next((g for name, g in open_days.items() if name in r["host"]), [])
        assert r["blocked"] or any(a <= str(r["fetch_time"]) < b for a, b in gaps), r


def test_temporal_list_salted(spark, sf_dir, monkeypatch):
    expected = sorted(map(str, urls.op7_temporal_list(spark, sf_dir).collect()))
    monkeypatch.setattr(urls, "BROADCAST_ENTRIES", 2)
    assert sorted(map(str, urls.op7_temporal_list(spark, sf_dir).collect())) == expected


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x.org/a", "<html lang='x'><title>T &amp; U</title><p>one<br>two</p><a href=\"/l\">l</a><script>no()</script></html>"), (2, None, None)], "page_id long, url string, html string")
    derived = warc.derive(warc.responses(pages)).cache()
    texts = {(r["page_id"], r["record_type"]): r["block"] for r in derived.collect()}
    assert texts[1, "conversion"] == "T & U\none\ntwo\nl" and texts[2, "conversion"] == ""
    assert "outlink: /l\r\n" in texts[1, "metadata"] and "sourceHeader: HTTP/1.1 200 OK\r\n" in texts[1, "metadata"]
    warc.write_warc(derived, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out")).selectExpr("record_id", "refers_to", "cast(block AS string) AS block")
    assert back.exceptAll(derived.select("record_id", "refers_to", "block")).count() == 0 and back.count() == 4
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def record(kind, block, length=None, **headers):
    lines = [f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length: {len(block) if length is None else length}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_real_files_are_derived(spark, tmp_path, zipped):
    """Responses of a file with other records, junk between records and a record cut off; a gzip member a record."""
    page = "HTTP/1.1 200 OK\r\nX-Y: z\r\n\r\n<title>Caf&eacute;</title><p>uno".encode()
    records = [
        record("warcinfo", b"software: x"), record("request", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", page, WARC_Record_ID="<urn:uuid:1>", WARC_Target_URI="http://a.example/", WARC_Date="2024-01-01T00:00:00Z"),
        b"junk\r\n", record("Response", b"\xff<p>dos", WARC_Target_URI="http://b.example/"), record("response", b"<p>tres", length="many"), record("response", b"<p>cuatro", length=999)[:-4],
    ]
    (tmp_path / "f.warc").write_bytes(b"".join(gzip.compress(r) if zipped else r for r in records))
    found = warc.read_warc(spark, str(tmp_path / "f.warc")).cache()
    assert [(r["record_type"], r["problem"]) for r in found.collect()] == [("warcinfo", None), ("request", None), ("response", None), ("Response", None), ("response", "no length"), ("response", "block cut off")]
    derived = warc.derive(warc.captured(found)).collect()
    texts = {r["target_uri"]: r["block"] for r in derived if r["record_type"] == "conversion" and r["target_uri"]}
    assert texts == {"http://a.example/": "Caf\u00e9\nuno", "http://b.example/": "\ufffd\ndos"} and len(derived) == 8
    first = next(r for r in derived if r["refers_to"] == "<urn:uuid:1>" and r["record_type"] == "metadata")
    assert "sourceHeader: X-Y: z\r\n" in first["block"] and first["warc_date"] == "2024-01-01T00:00:00Z"
    assert sorted(r["block"] for r in derived if not r["target_uri"] and r["record_type"] == "conversion") == ["", "cuatro"]


def test_damaged_files_give_what_is_there(spark, tmp_path):
    whole = gzip.compress(record("response", b"<p>uno")) + gzip.compress(record("response", b"<p>dos" * 5000))
    for name, data in {"cut": whole[:-20], "empty": b"", "none": b"no record at all", "headless": b"WARC/1.1\r\nWARC-Type: response"}.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    read = lambda name: [(r["record_type"], r["problem"]) for r in warc.read_warc(spark, str(tmp_path / f"{name}.warc")).collect()]
    assert read("empty") == read("none") == [] and read("headless") == [("response", "headers cut off")] and read("cut")[0] == ("response", None)


def test_all_character_references_are_decoded(spark):
    page = "<title>Caf&eacute; &middot; &#233;&#xE9;</title><p>&copy; host &middot; &lt;b&gt; &amp;copy; a&nbsp;&#160;&#xA0;b &#0160;c&#39;s &quot;q&quot; &#1600; &unknown; R&D &amp;nbsp;</p>"
    rows = {r["record_type"]: r["block"] for r in warc.derive(warc.responses(spark.createDataFrame([(1, "http://x.org/", page)], "page_id long, url string, html string"))).collect()}
    assert rows["conversion"] == "Caf\u00e9 \u00b7 \u00e9\u00e9\n\u00a9 host \u00b7 <b> &copy; a b c's \"q\" \u0640 &unknown; R&D &nbsp;"
    assert rows["metadata"].startswith("title: Caf\u00e9 \u00b7 \u00e9\u00e9\r\n")


def test_references_are_those_of_html(spark):
    draw = random.Random(7)
    parts = ["&", "&amp;", "&amp", "&notit;", "&ampcopy;", "&#", "&#x", "&#0;", "&#0128;", "&#x9F", "&#xD800;", "&#x1F600;", "&#65279;", "&#1114112;", "&#99999999999999999999;", "&#11;", "&#xFFFE;", "&#13;", "&Tab;", "&NewLine;", "&ngE;", ";", "x", " ", "9", "é", "&CounterClockwiseContourIntegral;", "&hearts", "&frac12"]
    texts = [f"a&{n}b" for n in html.entities.html5] + [f"&#{n};&#x{n:x}" for n in (*range(400), *range(0xD7F0, 0xE010), *range(0xFDC0, 0xFE00), 0x10FFFD, 0x10FFFF)] + ["".join(draw.choices(parts, k=9)) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.unescaped(F.col("t")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in rows if r["got"] != html.unescape(r["t"]).replace("\xa0", " ")] == []
