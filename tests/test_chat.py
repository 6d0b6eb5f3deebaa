"""From the export to the datasets, on an invented chat."""

import json
import zipfile
from datetime import datetime

import pytest
import yaml
from chat_export import CLUB, INES, MESSAGES, OLAF, export

from corrillo import jobs
from corrillo.functions.names import keyed_id
from corrillo.operators import quality, silver
from corrillo.sources import chat, config, ingest

SALT = b"grains for the tests"
CHAT = "torre_y_alfil"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """The whole chain of jobs, run once."""
    root = tmp_path_factory.mktemp("chat")
    archive = root / f"WhatsApp Chat - {CLUB}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr(zipfile.ZipInfo("_chat.txt", (2023, 11, 6, 8, 0, 0)), export())
    name, found = ingest.chosen_export({}, None, archive)
    assert name == CHAT
    jobs.run_ingest(spark, root, name, found, config.Existing.ERROR, {"Origen": "inventado"})
    jobs.run_anonymize(spark, root, name, SALT, config.Anonymization())
    jobs.run_process(spark, root, name)
    jobs.run_dictionary(spark, root, name)
    return root


def read(spark, root, layer, name):
    return spark.read.parquet(str(root / f"data/{layer}/{CHAT}/{name}.parquet"))


def test_bronze(spark, root):
    rows = read(spark, root, "interim", "bronze").orderBy("record_no").collect()
    assert [(r["record_no"], r["timestamp"], r["sender"], r["body"], r["kind"]) for r in rows] == [(k, m.at, m.who, m.body, m.kind) for k, m in enumerate(MESSAGES, 1)]
    assert {"text", "attachment", "poll", "location", "view_once", "deleted", "unavailable", "system_notice", "group_notice", "empty"} == {m.kind for m in MESSAGES}


@pytest.mark.parametrize("data,complaint", [(b"[2023-11-03 18:40] Olaf - hola\r\n", "iOS export"), (b"3.11.23 18:40 Olaf: hola\r\n", "iOS export"), (b"caf\xe9\r\n", "UTF-8")])
def test_other_exports_are_refused(spark, tmp_path, data, complaint):
    (tmp_path / "chat.txt").write_bytes(data)
    with pytest.raises(ValueError, match=complaint):
        chat.bronze(spark, str(tmp_path / "chat.txt"), CLUB)


def test_nobody_is_named(spark, root):
    rows = {r["message_id"]: r for r in read(spark, root, "interim", "messages_anon").collect()}
    ines, olaf = keyed_id(INES, SALT), keyed_id(OLAF, SALT)
    assert rows[5]["body"] == f"gracias @[{ines}] 🙌🏽, llega [{olaf}] también" and rows[4]["body"].startswith(f"mesa lista, la puso [{olaf}] ")
    assert rows[1]["sender_id"] is None and {rows[k]["sender_id"] for k in (2, 5, 7)} == {olaf}
    assert {r["kind"] for r in rows.values() if r["body"] is not None} == {"text", "attachment", "poll"}
    published = [str(root / f"data/interim/{CHAT}/{n}.parquet") for n in ("messages_anon", "members")]
    assert jobs.run_leak_check(spark, root, CHAT, published) == {}
    assert set(jobs.run_leak_check(spark, root, CHAT, [str(root / f"data/interim/{CHAT}/bronze.parquet")]).popitem()[1]) >= {"olaf", "quiroga", "ines quiroga"}


def test_members(spark, root):
    rows = read(spark, root, "interim", "members").orderBy("first_message").collect()
    assert [(r["sender_id"], r["alias"]) for r in rows] == [(keyed_id(OLAF, SALT), "Ajolote"), (keyed_id(INES, SALT), "Jaguar")]


def test_messages_tokens_emojis(spark, root):
    rows = {r["message_id"]: r for r in read(spark, root, "processed", "messages").collect()}
    assert rows[5]["content"] == "gracias @[Jaguar] 🙌🏽, llega [Ajolote] también" and (rows[5]["n_words"], rows[5]["n_mentions"], rows[5]["n_emojis"]) == (3, 1, 1)
    assert (rows[3]["message_type"], rows[3]["content"]) == ("audio", None) and (rows[4]["message_type"], rows[4]["content"]) == ("document", "mesa lista, la puso [Ajolote]")
    assert rows[13]["is_edited"] and rows[13]["content"] == "jaque mate, [Ajolote]" and not rows[5]["is_edited"]
    words = read(spark, root, "processed", "tokens").where("is_alpha").groupBy("message_id").count().collect()
    assert {r[0]: r[1] for r in words} == {i: r["n_words"] for i, r in rows.items() if r["n_words"]}
    assert [(r["message_id"], r["emoji_idx"], r["emoji"]) for r in read(spark, root, "processed", "emojis").collect()] == [(5, 0, "🙌🏽")]


def test_emoji_names_and_top_list(spark, root):
    content = silver.with_content(read(spark, root, "interim", "messages_anon"), read(spark, root, "interim", "members"))
    names = spark.createDataFrame([("🙌🏽", "manos_en_alto")], "emoji string, emoji_name string")
    assert [tuple(r) for r in silver.top_emojis(content, names).collect()] == [("🙌🏽", "manos en alto", 1)]


def test_header_check_and_mentions(spark, root):
    bronze = read(spark, root, "interim", "bronze")
    path = str(root / f"data/raw/{CHAT}/chat.txt")
    assert chat.header_check(spark, path).first().asDict() == {
        "records": 13, "empty_records": 0, "with_header": 13, "narrow_space": 13, "unread_time": 0, "no_sender": 0, "marked": 2}
    assert silver.mention_summary(bronze, SALT).first().asDict() == {"mentions": 1, "people": 1, "silent_people": 0, "numbers": 0}


def test_notice_patterns(spark, root):
    found = {(r["kind"], r["pattern"]): r["records"] for r in silver.notice_patterns(read(spark, root, "interim", "bronze")).collect()}
    assert found == {("group_notice", "other"): 1, ("system_notice", "changed the description"): 1, ("location", "location"): 1, ("deleted", "deleted"): 1}


def test_dictionary(spark, root):
    found = json.loads((root / "references/diccionario_messages.json").read_text())
    assert found["rows"] == len(MESSAGES) and found["privacy"] and {c["name"]: c["range"] for c in found["columns"]}["content"] == ""
    with pytest.raises(ValueError, match="undocumented"):
        quality.drift(read(spark, root, "processed", "messages"), ["message_id"])


def test_leaks_in_files(spark, root, tmp_path):
    (tmp_path / "notes.txt").write_text("gana OLÁF a quiroga; pierde Olafson")
    cells = [{"source": ["x"], "outputs": [{"data": {"image/png": "brandt", "text/html": ["<i>Brandt</i>"]}}]}, {"source": [], "outputs": [{"data": {"image/png": "ines"}}]}]
    (tmp_path / "book.ipynb").write_text(json.dumps({"cells": cells}))
    paths = [str(tmp_path / "notes.txt"), str(tmp_path / "book.ipynb")]
    found = jobs.run_leak_check(spark, root, CHAT, paths)
    assert {p: set(f) for p, f in found.items()} == {paths[0]: {"olaf", "quiroga"}, paths[1]: {"brandt"}}
    check = lambda **settings: {p: set(f) for p, f in jobs.run_leak_check(spark, root, CHAT, paths, config.Anonymization(**settings)).items()}
    assert check(allow_names=("Olaf Brandt",)) == {paths[0]: {"quiroga"}}
    assert check(min_length=5) == {paths[0]: {"quiroga"}, paths[1]: {"brandt"}}
    assert check(keep_words=("Quiroga", "olaf"), extra_names=("pierde",)) == {paths[0]: {"pierde"}, paths[1]: {"brandt"}}
    frame = spark.createDataFrame([("olaf", "brandt")], "lemma string, text string")
    assert {r["form"] for r in quality.leaks(quality.text_rows(frame), ["olaf", "brandt"]).collect()} == {"brandt"}


def test_views_hide_real_names(spark, root):
    folder = str(root / f"data/interim/{CHAT}")
    assert chat.views(spark, folder) == ["members", "messages_anon"] and "bronze" in chat.views(spark, folder, private=True)


def test_ingest(spark, root, tmp_path):
    text = (root / f"data/raw/{CHAT}/FUENTE.txt").read_text()
    assert text.startswith(f'Grupo: "{CLUB}"') and "2023-11-03 a 2023-11-05 (13 mensajes)" in text and "sha256" in text
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("good.txt", "x")
        z.writestr("sub/../../out.txt", "x")
    with pytest.raises(ValueError, match="unsafe"):
        ingest.extract(tmp_path / "evil.zip", tmp_path / "into", config.Existing.SKIP)
    assert not (tmp_path / "into/good.txt").exists()


def test_which_export(tmp_path):
    named = lambda name: ingest.chosen_export({}, None, tmp_path / name)[0]
    assert named("WhatsApp Chat with Café & Ñandú 2.zip") == "cafe_nandu_2" and named("backup.2023.zip") == "backup_2023"
    with pytest.raises(ValueError, match="folder name"):
        named("♜♜.zip")
    params = {"chat": "uno", "chats": {"uno": "~/exports/a.zip"}}
    name, archive = ingest.chosen_export(params, None, None)
    assert name == "uno" and archive.is_absolute() and archive.name == "a.zip"
    assert ingest.chosen_export(params, "dos", tmp_path / "b.zip") == ("dos", tmp_path / "b.zip")
    with pytest.raises(ValueError, match="registered"):
        ingest.chosen_export(params, "dos", None)


def test_published_settings_run_end_to_end(spark, tmp_path, monkeypatch):
    """A parameter file in the published shape: flat settings, archives by chat, a policy for files that are there."""
    archive = tmp_path / "club.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("_chat.txt", export())
    params = {
        "chat": "club", "chats": {"club": str(archive)}, "source": {"name": "inventado", "on_exists": "skip"},
        "anonymize": {"keep_words": ["mesa"], "allow_names": ["Inés Quiroga"], "min_length": 3, "extra_names": ["Siciliana"]},
    }
    (tmp_path / "params.yml").write_text(yaml.safe_dump(params, allow_unicode=True))
    monkeypatch.setenv("ANON_SALT", "sal")
    monkeypatch.delenv("CHAT", raising=False)
    monkeypatch.setattr(jobs, "build", lambda: spark)
    for step in ("ingest", "ingest", "anonymize", "process", "dictionary"):
        assert jobs.main([step, "--root", str(tmp_path)]) == 0
    rows = {r["message_id"]: r["body"] for r in spark.read.parquet(str(tmp_path / "data/interim/club/messages_anon.parquet")).collect()}
    assert rows[5].startswith("gracias @Inés Quiroga ") and "OPTION: [nombre] (2 votes)" in rows[7] and "mesa lista" in rows[4]
    assert jobs.main(["leak-check", "--root", str(tmp_path), str(tmp_path / "data/interim/club/messages_anon.parquet")]) == 0
    (tmp_path / "leak.txt").write_text("Olaf")
    assert jobs.main(["leak-check", "--root", str(tmp_path), str(tmp_path / "leak.txt")]) == 1


def test_settings():
    assert config.Anonymization.of({}) == config.Anonymization(allow_names=("Meta AI",)) and config.Anonymization.of({"anonymize": {"min_length": 4}}).min_length == 4
    with pytest.raises(ValueError, match="chats"):
        config.Anonymization.of({"anonymize": {"chats": {"uno": {"extra_names": ["x"]}}}})


def test_existing_files(tmp_path):
    path = tmp_path / "x"
    assert config.Existing.ERROR.writes(path)
    path.write_text("")
    assert not config.Existing.SKIP.writes(path) and config.Existing.OVERWRITE.writes(path)
    with pytest.raises(FileExistsError):
        config.Existing.ERROR.writes(path)


def test_chosen_chat_and_salt(monkeypatch, tmp_path):
    monkeypatch.delenv("CHAT", raising=False)
    assert config.active_chat({"chat": "uno"}) == "uno" and config.active_chat({"chat": "uno"}, "dos") == "dos"
    with pytest.raises(ValueError, match="no chat"):
        config.active_chat({})
    monkeypatch.setenv("CHAT", "tres")
    assert config.active_chat({"chat": "uno"}) == "tres"
    for name in ("..", "../x", "Con Blanco", "a/b", "a__b", "MAYUS", "b_"):
        with pytest.raises(ValueError):
            config.valid_chat(name)
    monkeypatch.delenv("ANON_SALT", raising=False)
    with pytest.raises(ValueError):
        config.load_salt(tmp_path / ".env")
    (tmp_path / ".env").write_text("ANON_SALT= abc \n")
    assert config.load_salt(tmp_path / ".env") == b"abc"


def test_log_of_steps(caplog):
    caplog.set_level("INFO")

    @config.logged
    def step(fail):
        if fail:
            raise KeyError("x")

    step(False)
    with pytest.raises(KeyError):
        step(True)
    assert "step completed in" in caplog.text and "step failed" in caplog.text
