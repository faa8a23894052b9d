"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import WORD, join_by_size, plain, source_key, text_or_empty
from evalspark.plans.lineage import cut_lineage

FAN_IN = 64
UNIT = "struct<h:bigint,doc_id:{id},skey:string,size:bigint,w:double,p:double>"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(skey, source_size, n, target, n_rows) from one row (skey, source_size, n, n_rows) per source.

    Sources in code point order, NULL last, take the weights in turn. target = min(cap * size, level * weight), where
    the level uses up the total: what repeated resharing of the excess converges to, found here at once. Sources sorted
    by cap * size / weight reach their cap in that order, so the level follows from running sums over the sources. The
    window runs over one row per source, never over documents.
    """
    place = F.row_number().over(Window.orderBy("skey"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(place - 1, F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(full), F.lit(0.0)))
                     / F.sum("weight").over(rest))
    # the level rises while sources above their cap leave, and falls after: the first that holds is the largest that does
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    s = s.withColumn("target", F.coalesce(F.least("most", level * F.col("weight")), F.col("most")))
    return s.select("skey", "source_size", "n", "target", "n_rows")


def _uniform(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _step(state: Column, y: Column, seed: int) -> Column:
    """Pair the carried document x with y: mass moves one way or the other, with odds that keep both expectations,
    until one of the two probabilities is 0 or 1. That one is settled; the other is carried on."""
    x = state["x"]
    room_x, room_y = (1.0 - x["p"]) * x["w"], (1.0 - y["p"]) * y["w"]
    mass_x, mass_y = x["p"] * x["w"], y["p"] * y["w"]
    up, down = F.least(room_x, mass_y), F.least(mass_x, room_y)
    rise = (_uniform(x["h"], y["h"], F.lit(seed)) * (up + down) < down) | (up + down == 0)

    def carry(u: Column, p: Column) -> Column:
        return F.struct(u["h"].alias("h"), u["doc_id"].alias("doc_id"), u["skey"].alias("skey"), u["size"].alias("size"),
                        u["w"].alias("w"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    none = F.filter(state["won"], lambda _: F.lit(False))
    won = (F.when(rise & (room_x <= mass_y), F.array(x)).when(~rise & (mass_x > room_y), F.array(y)).otherwise(none))
    left = (F.when(rise & (room_x <= mass_y), carry(y, y["p"] - room_x / y["w"]))
            .when(rise, carry(x, x["p"] + mass_y / x["w"]))
            .when(mass_x <= room_y, carry(y, y["p"] + mass_x / y["w"]))
            .otherwise(carry(x, x["p"] - room_y / x["w"])))
    return F.when(x.isNull(), F.struct(state["won"].alias("won"), y.alias("x"))).otherwise(
        F.struct(F.concat(state["won"], won).alias("won"), left.alias("x")))


def _fold(units: DataFrame, unit: str, level: int, blocks: Column) -> DataFrame:
    """One level of the tree: blocks of about FAN_IN documents of a source are each folded to the documents that won a
    copy and one carried document."""
    block = F.pmod(F.xxhash64("u.h", F.lit(level)), F.greatest(F.lit(1).cast("bigint"), blocks.cast("bigint")))
    grouped = units.withColumn("block", block).groupBy("u.skey", "block").agg(F.sort_array(F.collect_list("u")).alias("us"),
                                                                              F.max("n").alias("n"))
    start = F.struct(F.expr(f"cast(array() as array<{unit}>)").alias("won"), F.expr(f"cast(null as {unit})").alias("x"))
    folded = grouped.select("n", F.aggregate("us", start, lambda s, y: _step(s, y, level)).alias("s"))
    return folded.select("n", "s.won", "s.x")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per input row: (doc_id, source, size, source_size, target, copies, taken).

    Every document of a source has the same wanted number of copies r = target / source_size. It gets floor(r) copies
    and, with probability p = r - floor(r), one more. The p are rounded by the pivotal method on words, not documents:
    pairs pass mass until one is settled, so the words taken of a source always sum to its target but for the single
    document carried out of the root. Pairs are folded in blocks of about FAN_IN documents; the carried documents of
    all blocks meet in the next level, until one per source is left, which a last draw settles. Draws are hashes of the
    documents' keys, so reruns agree on any partitioning. A source with a third of all rows only has more blocks.

    Size is the number of words; NULL text has 0. Rows that agree in id, source and size are one unit of their joint
    size and share the decision. NULL ids and sources are values like others. Other columns are not read.
    """
    base = plain(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = cut_lineage(base.select("doc_id", "source", source_key().alias("skey"),
                                   F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint").alias("size")))
    units = rows.groupBy("doc_id", "skey", "size").agg(F.count(F.lit(1)).alias("m"))
    sizes = units.groupBy("skey").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n"),
                                      F.sum("m").alias("n_rows"))
    targets = cut_lineage(source_targets(sizes, weights, float(cap)))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base_copies = F.floor(wanted + F.lit(1e-12)).cast("bigint")
    odds = F.greatest(F.lit(0.0), wanted - base_copies)
    unit = UNIT.format(id=dict(units.dtypes)["doc_id"])
    spread = join_by_size(units, targets.withColumn("units", F.col("n")), ["skey"], "units")
    open_units = spread.withColumn("p", odds).filter((F.col("p") > 0) & (F.col("size") > 0)).select(
        F.struct(F.xxhash64("doc_id", "skey", "size").alias("h"), "doc_id", "skey", "size",
                 (F.col("size") * F.col("m")).cast("double").alias("w"), "p").cast(unit).alias("u"), "n")
    most = targets.agg(F.max("n")).first()[0] or 0
    level, won, layer = 0, [], open_units
    while True:
        blocks = F.ceil(F.col("n") / F.lit(float(FAN_IN ** (level + 1))))
        layer = cut_lineage(_fold(layer, unit, level, blocks))
        won.append(layer.select(F.explode("won").alias("u")))
        layer = layer.filter("x is not null").select(F.col("x").alias("u"), "n")
        level += 1
        if FAN_IN ** level >= most:
            break
    last = layer.filter(_uniform(F.col("u.h"), F.lit(-1)) < F.col("u.p")).select("u")
    for w in won:
        last = last.unionByName(w)
    extra = last.select(F.struct("u.doc_id", "u.skey", "u.size").alias("k"), F.lit(1).alias("extra"))
    out = join_by_size(rows, targets, ["skey"], "n_rows").withColumn("k", F.struct("doc_id", "skey", "size"))
    out = out.join(extra, out["k"].eqNullSafe(extra["k"]), "left").withColumn(
        "copies", base_copies + F.coalesce("extra", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))
