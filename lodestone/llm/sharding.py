"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Each shard has its own permutation of the slots of a prime-sized table, drawn from hashes of its name.
The shards take turns; at its turn a shard claims the first slot of its permutation that is still free.
Every shard so gets as many slots as any other, give or take one, and when a shard comes or goes few
slots of the others change. A document's slot is a hash of its key; the table is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table, a prime: the only thing broadcast, so its size is fixed here. With fewer
#: shards than a hundredth of it, shares of slots differ by under one in a hundred.
SLOTS = 65537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The shard's index for each slot. Names must be distinct, and no more than slots."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not a prime: a permutation would not reach every slot")
    digest = [hashlib.sha256(name.encode()).digest() for name in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digest]
    table, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % slots
            table[place[k]] = k
            free -= 1
            if not free:
                return table


def table_frame(spark: SparkSession, shards: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) as a DataFrame made from literals."""
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    names = F.split(F.lit("\x00".join(shards)), "\x00")
    rows = spark.range(1).select(F.posexplode(table).alias("slot", "index"))
    return rows.select("slot", F.element_at(names, F.col("index").cast("int") + 1).alias("shard"))


def assign(docs: DataFrame, key_col: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with the columns slot and shard; columns of those names are replaced.

    The slot is the first 60 bits of the key's MD5, modulo the table. Rows with equal keys share a
    shard. A null key is replaced by a hash of the whole row, so rows without a key spread as well;
    an empty key is a key. An empty table gives an empty result.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("slot", "shard")]
    plain = [F.col(f"`{c}`").cast("string") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.concat(F.lit("row "), F.xxhash64(*plain).cast("string")))
    slot = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots
    table = F.broadcast(table_frame(docs.sparkSession, shards, slots))
    return docs.select(*kept, slot.cast("int").alias("slot")).join(table, "slot").select(*kept, "slot", "shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")).select("doc_id", "slot", "shard")
