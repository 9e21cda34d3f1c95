"""Sharding by weighted rendezvous hashing (operator 11).

Every shard draws a number for a record's key; the record goes to the shard with the best draw, ``weight / -ln(u)`` with u
uniform in (0, 1) from the first 52 bits of md5(key, shard). A draw depends on nothing but key, shard and weight. So a new
shard takes records only into itself, a removed one gives away only its own, a changed weight moves records only into or
out of that shard, and shares follow the weights. All of it is one column expression: nothing is shuffled to place records.

``slots`` numbers the records of every shard without gaps. Records are narrowed to their sort columns, ranged by (shard,
order, row) and numbered from the counts of each range, so neither a shard nor a key has to fit in one task.

Rows: a null key is a key of its own (rows without id share a shard); a null text has size 0 + 1 and the checksum of the
empty text; repeated rows share their shard and have slots of their own; an empty table gives no rows; texts of any length
are read by built-in functions only; further columns, also of the names used here, are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frayline.llm.common import saved, unused

DRAW_HEX = 13  # hex digits of a draw: 52 bits, exact in a double


def stable_key(*columns: str) -> Column:
    """One text for the values of ``columns``; different values, null among them, never share it."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns])


def uniform(key: Column, shard: int) -> Column:
    """The number in (0, 1) that ``shard`` draws for ``key``."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{shard}")).cast("binary")), 1, DRAW_HEX)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DRAW_HEX)


def draw(key: Column, shard: int, weight: float) -> Column:
    """(score, -shard): the largest wins, of equal scores the smaller shard."""
    return F.struct((F.lit(float(weight)) / -F.log(uniform(key, shard))).alias("score"), F.lit(-shard).alias("other"))


def best_draw(key: Column, weights: Mapping[int, float]) -> Column:
    """The winning draw of all shards with a weight above 0."""
    draws = [draw(key, shard, weight) for shard, weight in sorted(weights.items()) if weight > 0]
    if not draws:
        raise ValueError("no shard has a weight above 0")
    return F.greatest(*draws) if len(draws) > 1 else draws[0]


def assigned(rows: DataFrame, weights: Mapping[int, float], key: Sequence[str] = ("doc_id",), out: str = "shard") -> DataFrame:
    """``rows`` with the shard of every row in column ``out``."""
    return rows.withColumn(out, -best_draw(stable_key(*key), weights)["other"])


def moved(rows: DataFrame, old: Mapping[int, float], new: Mapping[int, float], key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Records by shard under ``old`` and ``new`` weights: from_shard, to_shard, n_rows. What moves has two different shards."""
    pair = rows.select(*key).select((-best_draw(stable_key(*key), old)["other"]).alias("from_shard"), (-best_draw(stable_key(*key), new)["other"]).alias("to_shard"))
    return pair.groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("n_rows"))


def slots(rows: DataFrame, shard: str = "shard", order: Sequence[str] = (), out: str = "slot") -> DataFrame:
    """``rows`` with their place, from 0 and without gaps, in the order of their shard.

    Rows that tie in ``order`` stand in any order. ``rows`` should be narrow: they are written, ranged and written again.
    """
    number, part, place, first, start = (unused(rows, n) for n in ("row", "part", "place", "first", "start"))
    kept = saved(rows.withColumn(number, F.monotonically_increasing_id()))
    ranged = kept.repartitionByRange(shard, *order, number).sortWithinPartitions(shard, *order, number)
    # the upper bits of the id are the range, the lower ones the place in it
    at = F.monotonically_increasing_id()
    ranged = saved(ranged.withColumns({part: F.shiftright(at, 33), place: at.bitwiseAND((1 << 33) - 1)}).drop(number))
    counts = ranged.groupBy(part, shard).agg(F.count(F.lit(1)).alias(start), F.min(place).alias(first))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0)))
    return ranged.join(counts, [part, shard]).withColumn(out, F.col(start) + F.col(place) - F.col(first)).select(*rows.columns, out)


def placed(documents: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float], text: str = "text") -> DataFrame:
    """Per document: size, checksum, shard, slot, and its shard under the weights ``grown``; the key is doc_id."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = stable_key("doc_id")
    rows = documents.select(
        "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"),
        (-best_draw(key, weights)["other"]).alias("shard"), (-best_draw(key, grown)["other"]).alias("grown_shard"),
    )
    return slots(rows, "shard", ["doc_id", "size", "text_crc32"])


def write_shards(rows: DataFrame, weights: Mapping[int, float], folder: str, key: Sequence[str] = ("doc_id",), shard: str = "shard") -> None:
    """All columns of ``rows`` as Parquet, one folder per shard; each task writes to every shard it has rows of."""
    assigned(rows, weights, key, shard).write.partitionBy(shard).parquet(folder)
