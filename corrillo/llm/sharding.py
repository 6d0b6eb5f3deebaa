"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has a fixed number of slots. Each shard owns `vnodes` virtual nodes at hashed slots; a key's home is the
first virtual node at or after the key's slot. A shard takes rows up to its capacity; rows that find a shard full go
on clockwise to the next virtual node. The law kept is `rows`: capacities differ by at most one and add up to the
number of rows, so every shard ends exactly full.

What meets on the driver is one count per slot (RING_SLOTS at most, whatever the input); the walk round the ring is
arithmetic over these counts. Equal rows are counted first and are one group from then on; groups are ranked inside
their slot and find their shards by joining the slot's rank ranges, a table bounded by slots and virtual nodes.

Defined results: a null key is placed by its text (and a null text counts 0 bytes); repeated rows are separate rows
and get separate places; which of two rows that tie in key and text comes first does not matter, as they are equal; very
long texts count by their length and hash alone, which are all that leaves the scan; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrillo.llm.common import table, written

RING_SLOTS = 16_384
SUBSLOTS = 64
#: Equal rows that one task lists.
CHUNK_ROWS = 100_000
VNODES = 64
SHARDS = 40
ROW_OVERHEAD = 16
PLACES = "slot_on_ring int, rank_from long, rank_to long, shard int, first_place long"


@dataclass(frozen=True)
class Ring:
    """Owners of the virtual nodes in clockwise order, and each slot's first virtual node."""

    owners: tuple[int, ...]
    home: tuple[int, ...]


def build_ring(spark: SparkSession, shards: int, vnodes: int = VNODES, slots: int = RING_SLOTS) -> Ring:
    """Hashes the virtual nodes onto the slots; the table has shards * vnodes rows."""
    position = F.xxhash64(F.lit("shard"), "shard", "vnode")
    rows = (
        spark.range(shards).select(F.col("id").cast("int").alias("shard"))
        .select("shard", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("vnode"))
        .select("shard", F.pmod(position, F.lit(slots)).cast("int").alias("at"), position.alias("h"))
        .collect()
    )
    rows = sorted((r["at"], r["h"], r["shard"]) for r in rows)
    home, k = [], 0
    for slot in range(slots):
        while k < len(rows) and rows[k][0] < slot:
            k += 1
        home.append(k % len(rows))
    return Ring(tuple(r[2] for r in rows), tuple(home))


def capacities(n_rows: int, shards: int) -> list[int]:
    return [n_rows // shards + (s < n_rows % shards) for s in range(shards)]


def walk(ring: Ring, counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Places every slot's rows: in turn r all that is still unplaced tries the r-th virtual node after its home.

    Returns (slot, first rank, rank after the last, shard, place of the first) and uses up `room`.
    """
    room, filled, places = list(room), [0] * len(room), []
    pending = [(slot, 0, n) for slot, n in sorted(counts.items()) if n]
    for turn in range(len(ring.owners)):
        left = []
        for slot, start, n in pending:
            shard = ring.owners[(ring.home[slot] + turn) % len(ring.owners)]
            if take := min(room[shard], n):
                places.append((slot, start, start + take, shard, filled[shard]))
                room[shard] -= take
                filled[shard] += take
            if n > take:
                left.append((slot, start + take, n - take))
        if not (pending := left):
            break
    # shards whose virtual nodes all lost their slots still take what is left
    for slot, start, n in pending:
        for shard in range(len(room)):
            if take := min(room[shard], n):
                places.append((slot, start, start + take, shard, filled[shard]))
                room[shard] -= take
                filled[shard] += take
                start, n = start + take, n - take
    return places


def ring_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.when(F.col(key).isNull(), F.col(text)))


def placed(keyed: DataFrame) -> DataFrame:
    """Groups of equal rows with n, and the rank of the first one in its slot on the ring.

    A slot is ranked in SUBSLOTS parts, so that neither a key with very many texts nor a text with very many rows, which
    are one group by then, is a hot task.
    """
    part = "slot_on_ring", "subslot"
    order = Window.partitionBy(*part).orderBy("h", "doc_id", "text_crc32", "size")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*part).agg(F.sum("n").alias("rows"))
    firsts = sums.select(*part, F.coalesce(F.sum("rows").over(before(Window.partitionBy("slot_on_ring").orderBy("subslot"))), F.lit(0)).alias("ahead"))
    ranked = keyed.withColumn("rank", F.coalesce(F.sum("n").over(before(order)), F.lit(0)))
    return ranked.join(firsts, list(part)).withColumn("rank", F.col("rank") + F.col("ahead"))


def row_by_row(groups: DataFrame) -> DataFrame:
    """A row for each of the `n` rows of a group, slots from `slot` on. Large groups are cut up and dealt to all tasks first."""
    each = lambda g: g.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1)))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK_ROWS).cast("long")))
    chunks = groups.where(F.col("n") > CHUNK_ROWS).withColumn("at", cut)
    chunks = chunks.withColumns({"slot": F.col("slot") + F.col("at"), "n": F.least(F.col("n") - F.col("at"), F.lit(CHUNK_ROWS))}).drop("at")
    spread = chunks.repartition(F.xxhash64("doc_id", "text_crc32", "shard", "slot"))
    return each(groups.where(F.col("n") <= CHUNK_ROWS)).unionByName(each(spread))


def bounded_ring(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot (gapless in its shard), grown_shard (null under this law)."""
    spark = df.sparkSession
    h = ring_key(key, text)
    rows = df.select(
        F.pmod(h, F.lit(RING_SLOTS)).cast("int").alias("slot_on_ring"),
        F.pmod(F.xxhash64(h, text), F.lit(SUBSLOTS)).cast("int").alias("subslot"),
        h.alias("h"),
        F.col(key).alias("doc_id"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
    )
    equal = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "ring-rows")
    counts = {r["slot_on_ring"]: r["rows"] for r in equal.groupBy("slot_on_ring").agg(F.sum("n").alias("rows")).collect()}  # at most RING_SLOTS rows
    places = walk(build_ring(spark, shards, vnodes), counts, capacities(sum(counts.values()), shards))
    ranges = spark.createDataFrame(places, PLACES).hint("broadcast")  # bounded by slots and virtual nodes
    groups = placed(equal)
    inside = (groups.slot_on_ring == ranges.slot_on_ring) & (F.col("rank") < F.col("rank_to")) & (F.col("rank") + F.col("n") > F.col("rank_from"))
    begin, end = F.greatest("rank", "rank_from"), F.least(F.col("rank") + F.col("n"), F.col("rank_to"))
    pieces = groups.join(ranges, inside).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_place") + begin - F.col("rank_from")).alias("slot"), (end - begin).alias("n"))
    return row_by_row(pieces).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_ring(table(spark, sf_dir, "documents"))
