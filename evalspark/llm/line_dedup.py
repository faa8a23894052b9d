"""Line dedup within one edit by a deletion-neighbourhood join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import join_by_size, maybe_among, plain
from evalspark.plans.lineage import cut_lineage

PIECE = 64
LINE = ["h", "g", "n"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, h, g, n) of the lines that are not blank: two hashes and the length name a line."""
    rows = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.filter(F.trim("line") != "")
    return rows.withColumns({"h": F.xxhash64("line"), "g": F.hash("line"), "n": F.length("line")})


def _half_keys() -> Column:
    """Keys of which two lines one edit apart share one: the edit leaves the first or the last half of the shorter line
    whole. A line is taken both as the shorter or equal one, of n letters, and as the longer one."""
    def both(half: Column) -> list[Column]:
        return [F.xxhash64(F.lit(0), half, F.substring(F.col("line"), F.lit(1), half)),
                F.xxhash64(F.lit(1), half, F.substring(F.col("line"), F.col("n") - half + 1, half))]
    return F.array_distinct(F.array(*both(F.floor(F.col("n") / 2).cast("int")), *both(F.floor((F.col("n") - 1) / 2).cast("int"))))


def _outside(j: Column, width: Column) -> Column:
    """What surrounds piece j of `width` letters: its place, and hashes of all before and all after it."""
    return F.xxhash64(j, F.substring(F.col("line"), F.lit(1), j * PIECE), F.substring(F.col("line"), j * PIECE + width + 1, F.col("n")))


def _without(piece: Column, i: Column) -> Column:
    return F.concat(F.substring(piece, F.lit(1), i - 1), F.substring(piece, i + 1, F.length(piece)))


def near_lines(docs: DataFrame, distinct: DataFrame, min_fuzzy: int) -> DataFrame:
    """The distinct lines (h, g, n) of at least `min_fuzzy` letters that have an earlier line at edit distance 1."""
    long = distinct.filter(F.col("n") >= min_fuzzy)
    # the first place names a line, so hashes and length stay behind and are taken anew from the text
    keyed = cut_lineage(long.select("first.doc_id", "first.line_no", F.explode("keys").alias("key")))
    shared = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    some = cut_lineage(join_by_size(keyed, shared, ["key"], "size").select("doc_id", "line_no").distinct())
    texts = cut_lineage(_lines(maybe_among(docs, some.select("doc_id"), "doc_id")).join(some, ["doc_id", "line_no"])
                        .select(*LINE, F.struct("doc_id", "line_no").alias("first"), "line"))
    # role 0: the line as it may be substituted in or added to; role 1: as the longer line, whose piece has one letter more
    pieces = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int"))
    width = PIECE + F.col("role")
    placed = texts.withColumn("role", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("j", F.explode(pieces))
    placed = placed.withColumn("outside", _outside(F.col("j"), width))
    placed = cut_lineage(placed.select(*LINE, "first", "role", F.xxhash64("outside", F.col("n") - F.col("role")).alias("as_short"), "outside",
                                       F.substring(F.col("line"), F.col("j") * PIECE + 1, width).alias("piece")))
    around = cut_lineage(placed.groupBy("outside").agg(F.count(F.lit(1)).alias("size"), F.count_distinct(*LINE).alias("lines"))
                         .filter("lines > 1").drop("lines"))
    close = join_by_size(placed, around, ["outside"], "size")
    i = F.explode(F.sequence(F.lit(1), F.length("piece")))
    substituted = (close.filter("role = 0").withColumn("i", i)
                   .select(*LINE, "first", F.lit(0).alias("kind"), F.lit(0).alias("longer"),
                           F.xxhash64(F.lit(0), "outside", "n", "i", _without(F.col("piece"), F.col("i"))).alias("variant")))
    deleted = (close.filter("role = 1").withColumn("i", i)
               .select(*LINE, "first", F.lit(1).alias("kind"), F.lit(1).alias("longer"),
                       F.xxhash64(F.lit(1), "as_short", "outside", _without(F.col("piece"), F.col("i"))).alias("variant")))
    whole = close.filter("role = 0").select(*LINE, "first", F.lit(1).alias("kind"), F.lit(0).alias("longer"),
                                            F.xxhash64(F.lit(1), "as_short", "outside", "piece").alias("variant"))
    variants = cut_lineage(substituted.unionByName(deleted).unionByName(whole).distinct())
    me = F.struct("first", *LINE)
    groups = cut_lineage(variants.groupBy("variant").agg(
        F.min(F.when(F.col("longer") == 0, me)).alias("short"), F.min(F.when(F.col("longer") == 1, me)).alias("long"),
        F.count(F.lit(1)).alias("size")).filter("size > 1"))
    met = join_by_size(variants, groups, ["variant"], "size")
    partner = F.when((F.col("kind") == 1) & (F.col("longer") == 0), F.col("long")).otherwise(F.col("short"))
    met = met.withColumn("other", partner).filter(F.col("other.first") < F.col("first"))
    pairs = met.select(*LINE, *[F.col(f"other.{c}").alias(f"o_{c}") for c in LINE]).distinct()
    verified = (pairs.join(texts.select(*LINE, "line"), LINE)
                .join(texts.select(*[F.col(c).alias(f"o_{c}") for c in (*LINE, "line")]), [f"o_{c}" for c in LINE])
                .filter(F.levenshtein("line", "o_line", 1) >= 0))
    return verified.select(*LINE).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_fuzzy: int = 16,
               carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text), one row per input row: the text without lines that came earlier.

    Lines are split at \\n and ordered by (doc_id, line number). A line goes if an equal line came earlier, or if it has
    at least `min_fuzzy` letters and a line at edit distance 1 came earlier (whether or not that one stays). Blank
    lines stay. Distances are counted in code points.

    Equal lines collapse to their first place before anything else, so a line found everywhere is one row per task.
    Then keys get narrower: halves of a line, then all but one piece of PIECE letters, and only for pieces whose
    surroundings occur twice the deletion variants: the hashes of the piece with each letter left out (substitutions
    meet where both sides drop the same place, insertions where the longer side's variant is the shorter line). In a group
    of equal variants only the earliest line of either side can decide, so no pairs of a group are made. What meets is
    verified by edit distance. Long lines cost a hash of the line per piece, not per letter.

    NULL text stays NULL with 0 lines; text "" is one blank line. Ids name one text: rows that repeat an id and its text
    give one row each with the same result, and do not drop each other's lines. Rows with a NULL id stay as they are.
    Other columns than those named in `carry`, which are handed on, are not read.
    """
    base = plain(docs, doc_id=id_col, text=text_col)
    places = _lines(base).withColumn("keys", F.when(F.col("n") >= min_fuzzy, _half_keys()))
    distinct = cut_lineage(places.groupBy(*LINE).agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("places"),
                                                     F.first("keys").alias("keys")))
    near = near_lines(base, distinct, min_fuzzy).withColumn("near", F.lit(True))
    late = distinct.drop("keys").join(near, LINE, "left").withColumn("near", F.coalesce("near", F.lit(False)))
    late = cut_lineage(late.filter("near or places > 1"))
    drops = join_by_size(_lines(base).drop("line"), late, LINE, "places")
    drops = drops.filter("near or doc_id <> first.doc_id or line_no <> first.line_no")
    drops = cut_lineage(drops.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")))
    split = docs.select(docs[id_col].alias("doc_id"), F.split(docs[text_col], "\n").alias("lines"), F.struct(F.lit(0).alias("__"), *carry).alias("rest"))
    changed = maybe_among(split, drops.select("doc_id"), "doc_id").join(drops, "doc_id", "left")
    out = changed.unionByName(maybe_among(split, drops.select("doc_id"), "doc_id", negate=True), allowMissingColumns=True)
    gone = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    return out.select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.size(gone).alias("n_dropped"),
                      F.when(F.col("lines").isNotNull(), F.array_join(F.transform(kept, lambda k: F.get("lines", k)), "\n")).alias("text"),
                      *[F.col("rest")[c].alias(c) for c in carry])
