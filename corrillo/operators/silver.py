"""The layered datasets of a chat: anonymised messages and members, then tidy messages, tokens and emojis."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrillo.functions import text as t
from corrillo.functions.masking import MENTIONED, form_marks, marks_frame, masked_body, mention_mark
from corrillo.functions.names import alias_frame, forms_frame, people_frame, written_name
from corrillo.functions.tagging import by_pattern, with_flags

#: Members of a chat, mentioned people included; more than that is no chat, and neither broadcast nor put into a trie.
MOST_PEOPLE = 100_000


def raw_names(bronze: DataFrame) -> DataFrame:
    """name: who wrote, or was mentioned, as written in the export."""
    senders = bronze.where("kind <> 'group_notice'").select(F.col("sender").alias("name"))
    return senders.union(bronze.select(F.explode(F.regexp_extract_all("body", F.lit(MENTIONED), F.lit(1))))).distinct()


def people_of(bronze: DataFrame, salt: bytes, allow_names: Iterable[str] = ()) -> DataFrame:
    """raw, name, id, mention (what stands for a mention) of everybody; checked against MOST_PEOPLE."""
    found = people_frame(raw_names(bronze), salt)
    if found.limit(MOST_PEOPLE + 1).count() > MOST_PEOPLE:
        raise ValueError(f"more than {MOST_PEOPLE} people in one chat")
    return found.withColumn("mention", mention_mark(F.col("name"), F.col("id"), sorted(map(written_name, allow_names))))


def marks_of(people: DataFrame, min_length: int = 3, keep_words: Iterable[str] = (), allow_names: Iterable[str] = (), extra_names: Iterable[str] = ()) -> dict[str, str]:
    """Folded form -> mark of the names that may not be told; of at most MOST_PEOPLE people."""
    named = people.where("name <> ''")
    if allowed := sorted(map(written_name, allow_names)):
        named = named.where(~F.col("name").isin(allowed))
    forms = forms_frame(named, min_length=min_length, keep_words=keep_words)
    return form_marks(extra_names, {r["form"]: r["mark"] for r in marks_frame(forms, named).collect()})


def sender_ids(bronze: DataFrame, people: DataFrame) -> DataFrame:
    """bronze with sender_id; null for the group's own notices."""
    ids = people.select(F.col("raw").alias("sender"), F.col("id").alias("sender_id"))
    joined = bronze.join(F.broadcast(ids), "sender", "left")
    return joined.withColumn("sender_id", F.when(F.col("kind") != "group_notice", F.col("sender_id")))


def anonymised(bronze: DataFrame, people: DataFrame, marks: dict[str, str]) -> DataFrame:
    """message_id, timestamp, sender_id (null for the group's own notices), kind, body (masked; null unless a person wrote it)."""
    mentions = people.agg(F.map_from_entries(F.collect_list(F.struct("raw", "mention"))).alias("mentions"))
    found = sender_ids(bronze, people).crossJoin(F.broadcast(mentions))
    return found.select(F.col("record_no").alias("message_id"), "timestamp", "sender_id", "kind", masked_body(F.col("kind"), F.col("body"), F.col("mentions"), marks).alias("body"))


def members(bronze: DataFrame, people: DataFrame, avoid_words: Iterable[str] = ()) -> DataFrame:
    """sender_id, alias, first_message, one row per member, by the first message."""
    firsts = sender_ids(bronze, people).where("sender_id IS NOT NULL").groupBy("sender_id").agg(F.min("timestamp").alias("first_message"), F.min("record_no").alias("first_no"))
    return alias_frame(firsts, ["first_message", "first_no"], avoid_words).select("sender_id", "alias", "first_message").orderBy("first_message")


def mention_summary(bronze: DataFrame, salt: bytes) -> DataFrame:
    """mentions, people mentioned, those of them who never write, and mentions of numbers."""
    found = bronze.select(F.explode(F.regexp_extract_all("body", F.lit(MENTIONED), F.lit(1))).alias("raw"))
    ids = people_frame(raw_names(bronze), salt)
    wrote = bronze.select(F.col("sender").alias("raw")).distinct().join(ids, "raw").select("id").distinct().withColumn("wrote", F.lit(True))
    named = found.groupBy("raw").agg(F.count("*").alias("n")).join(ids, "raw").join(wrote, "id", "left")
    number = F.col("raw").rlike(rf"^[+]?[0-9 {t.NNBSP}-]+\z")
    return named.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"), F.count_distinct("id").alias("people"), F.count_distinct(F.when(F.col("wrote").isNull(), F.col("id"))).alias("silent_people"),
        F.coalesce(F.sum(F.when(number, F.col("n"))), F.lit(0)).alias("numbers"))


def notice_patterns(bronze: DataFrame) -> DataFrame:
    """kind, pattern, records of the notices."""
    found = bronze.where(F.col("kind").isin(*t.NOTICE_KINDS))
    return found.groupBy("kind", t.notice_pattern(F.col("kind"), F.col("body")).alias("pattern")).agg(F.count("*").alias("records"))


def with_content(anonymous: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Messages with the sender's alias and the readable content; ids within texts become aliases too."""
    names = member_rows.agg(F.map_from_entries(F.collect_list(F.struct("sender_id", "alias"))).alias("names"))
    joined = anonymous.join(F.broadcast(member_rows.select("sender_id", F.col("alias").alias("sender"))), "sender_id", "left").crossJoin(F.broadcast(names))
    return joined.withColumn("content", t.clean_content(F.col("kind"), F.col("body"), F.col("names"))).drop("names")


def tokens(content: DataFrame, tagged: Callable[[DataFrame, str, str], DataFrame] = by_pattern, stop_words: tuple[str, ...] = t.STOP_WORDS) -> DataFrame:
    """message_id, token_idx, token, lemma, pos, is_alpha, is_stop, is_laugh."""
    written = content.where("content IS NOT NULL").select("message_id", t.text_for_words(F.col("content")).alias("words"))
    return with_flags(tagged(written, "message_id", "words"), stop_words)


def emojis(content: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """message_id, emoji_idx, emoji, emoji_name; names: emoji, emoji_name in the language wanted, else Unicode's own."""
    found = content.select("message_id", F.posexplode(t.emojis(F.col("content"))).alias("i", "emoji")).select("message_id", F.col("i").cast("long").alias("emoji_idx"), "emoji")
    if names is None:
        names = found.select("emoji").distinct().withColumn("emoji_name", t.emoji_name("emoji"))
    return found.join(F.broadcast(names.select("emoji", F.replace("emoji_name", F.lit("_"), F.lit(" ")).alias("emoji_name"))), "emoji", "left").select("message_id", "emoji_idx", "emoji", "emoji_name")


def top_emojis(content: DataFrame, names: DataFrame | None = None, k: int = 10) -> DataFrame:
    """emoji, emoji_name, uses of the k commonest emojis."""
    uses = emojis(content, names).groupBy("emoji").agg(F.first("emoji_name").alias("emoji_name"), F.count("*").alias("uses"))
    return uses.orderBy(F.desc("uses"), "emoji").limit(k)


def messages(content: DataFrame, token_rows: DataFrame) -> DataFrame:
    """message_id, timestamp, sender, message_type, content, is_edited, n_words, n_emojis, n_mentions, has_url."""
    n_words = token_rows.where("is_alpha").groupBy("message_id").agg(F.count("*").alias("n_words"))
    text = F.coalesce("content", F.lit(""))
    return content.join(n_words, "message_id", "left").select(
        "message_id", "timestamp", "sender", t.message_type(F.col("kind"), F.col("body")).alias("message_type"), "content", t.is_edited(F.col("body")).alias("is_edited"),
        F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), F.size(t.emojis(F.col("content"))).cast("long").alias("n_emojis"),
        t.occurrences(text, "@[").alias("n_mentions"), text.contains("[url:").alias("has_url"))
