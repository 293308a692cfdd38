"""Semi-join reduction: large tables cut to the keys that are asked for.

A scoring run asks for few hosts and URLs of a large crawl.  ``asked`` measures
the keys; ``reduced`` drops the other rows of a table inside its scan, before
anything is parsed or shuffled:

* keys of a measured size under ``BROADCAST_BYTES``: a broadcast left-semi
  join, exact;
* more keys: a split-block Bloom filter of them, a table of 512-bit blocks of a
  size known beforehand, broadcast while that is under ``FILTER_BYTES``.  It lets
  all asked rows pass, and about one in a hundred others; the join
  that follows anyway drops those;
* more than that: no reduction (the request is as large as the crawl).

All three lead to the same result of the later left join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Keys up to this size are broadcast themselves.
BROADCAST_BYTES = 8 << 20
#: A filter up to this size is broadcast (about 40 million keys).
FILTER_BYTES = 64 << 20
WORDS = 8
BITS_PER_KEY = 12
#: Bytes of a broadcast row of a filter: its number, eight words, overhead.
ROW_BYTES = 112


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit of each of a block's words."""
    h = F.xxhash64(key, F.lit(1))
    at = lambda i: F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), at(i)) for i in range(WORDS)]


@dataclass
class Bloom:
    """A split-block Bloom filter: ``block`` and words ``w0`` to ``w7``."""
    table: DataFrame
    blocks: int

    def passing(self, df: DataFrame, key: Column) -> DataFrame:
        """Rows of ``df`` whose key may be in the set (null keys: none); no
        shuffle of ``df``."""
        names = df.columns
        probe = df.select("*", _block(key, self.blocks).alias("_block"), *[b.alias(f"_b{i}") for i, b in enumerate(_bits(key))])
        hit = F.lit(True)
        for i in range(WORDS):
            hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"_b{i}")) != 0)
        table = F.broadcast(self.table)  # at most FILTER_BYTES
        return probe.where(key.isNotNull()).join(table, F.col("_block") == F.col("block")).where(hit).select(*names)


def bloom(keys: DataFrame, n: int, max_bytes: int = FILTER_BYTES, bits_per_key: int = BITS_PER_KEY) -> Bloom | None:
    """A filter of ``keys(key)``, ``n`` of them; None if it would be too large."""
    blocks = max(1, -(-n * bits_per_key // (64 * WORDS)))
    if blocks * ROW_BYTES > max_bytes:
        return None
    rows = keys.where("key is not null").select(_block(F.col("key"), blocks).alias("block"),
                                                *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    table = rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    return Bloom(materialize(table, "bloom"), blocks)


@dataclass
class Keys:
    """Distinct keys (column ``key``) with their measured number and bytes."""
    df: DataFrame
    n: int
    bytes: int
    filter: Bloom | None = None

    @property
    def small(self) -> bool:
        return self.bytes <= BROADCAST_BYTES


def asked(df: DataFrame, **columns: Column) -> dict[str, Keys]:
    """Keys of each given column of a (written) table, measured in one pass."""
    sizes = df.agg(*[F.count_distinct(c).alias(f"{k}_n") for k, c in columns.items()],
                   *[F.coalesce(F.sum(F.octet_length(c.cast("string")) + 16), F.lit(0)).alias(f"{k}_b")
                     for k, c in columns.items()]).first()
    out = {}
    for k, c in columns.items():
        keys = Keys(df.select(c.alias("key")).where("key is not null").distinct(), sizes[f"{k}_n"], sizes[f"{k}_b"])
        if not keys.small:
            keys.df = materialize(keys.df, f"asked-{k}")
            keys.filter = bloom(keys.df, keys.n)
        out[k] = keys
    return out


def reduced(df: DataFrame | None, col: str, keys: Keys) -> DataFrame | None:
    """The rows of ``df`` that the keys ask for (see above)."""
    if df is None:
        return None
    if keys.small:
        return df.join(F.broadcast(keys.df), F.col(col) == F.col("key"), "left_semi")
    return keys.filter.passing(df, F.col(col)) if keys.filter is not None else df
