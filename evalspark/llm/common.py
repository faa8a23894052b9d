"""Helpers that the text operators share: input columns, joins that survive hot keys, word rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.plans.lineage import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
HOT_PARTS = 10_000


def plain(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the names given: whatever else the table holds cannot clash later."""
    return docs.select(*[docs[old].alias(new) for new, old in columns.items()])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def source_key(name: str = "source") -> Column:
    """A source as a key that is never NULL and keeps NULL apart from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("~"))


def document_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A digest that names an id and a text and is never NULL; NULL ids and texts are values of their own."""
    tagged = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("~"))
    return F.unhex(F.md5(F.concat(tagged, F.lit(":"), F.coalesce(F.md5(text_col), F.lit("~")))))


def join_by_size(rows: DataFrame, groups: DataFrame, on: Sequence[str], size: str, how: str = "inner",
                 parts: int = HOT_PARTS) -> DataFrame:
    """Attach `groups` (one row per key, `size` = the rows of that key) to `rows`, with no key held by one task.

    A key is hot when it holds more than 1/parts of the total of `size`. There are fewer than `parts` hot keys by this
    very definition, so they are broadcast; every other key is joined by shuffle and holds at most 1/parts of the rows.
    Keys must not be NULL. `groups` should be stored (checkpointed): it is read three times. `size` is not returned
    unless it is also another column of `groups`.
    """
    on = list(on)
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(total / parts, 1.0)
    rest = [c for c in groups.columns if c not in on and c != size]
    hot = F.broadcast(groups.filter(F.col(size) > limit).select(*on, F.struct(F.lit(1).alias("__one"), *rest).alias("__hot")))
    cold = groups.filter(F.col(size) <= limit).select(*on, *rest)
    tried = rows.join(hot, on, "left")
    warm = tried.filter(F.col("__hot").isNotNull()).select(*rows.columns, *[F.col(f"__hot.{c}").alias(c) for c in rest])
    return warm.unionByName(tried.filter(F.col("__hot").isNull()).select(*rows.columns).join(cold, on, how)
                            .select(*rows.columns, *rest))


FILTER_BITS = 23


def maybe_among(rows: DataFrame, ids: DataFrame, key: str, negate: bool = False) -> DataFrame:
    """The rows whose key may be among `ids` (all that are, and a few by chance), or with `negate` the others, of which
    none is. It spares a scan the shuffle of most rows before an exact join. The filter is a bitmap over 2^FILTER_BITS
    hash values, at most 256 rows of 4 KB whatever the input, so it is broadcast."""
    at = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    bits = cut_lineage(ids.groupBy(F.bitmap_bucket_number(at).alias("__k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits")))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.floor(byte / F.pow(F.lit(2.0), place % 8)) % 2 == 1, F.lit(False))
    tried = rows.withColumn("__k", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "__k", "left")
    return tried.filter(~bit if negate else bit).select(*rows.columns)
