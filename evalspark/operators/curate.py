"""Curation of labelled cohorts: filters with reasons, spatial tests, deduplication, caps, quotas, checks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import box_intersection, draw_index, hash_int, iou, overlap_1d, uniform
from evalspark.plans.lineage import stored
from evalspark.plans.groups import first_per_group, join_groups, join_skewed, rank_rows, top_per_group
from evalspark.plans.prefix import exact_quantiles
from evalspark.plans.suppress import FOLD_ROWS, real, suppress

BBOX = ("x", "y", "w", "h")
# fixed curation values
MIN_SIDE, EDGE, DUPLICATE_IOU, NEIGHBOUR_SHARE, X_SCALE, CONTEXT, SLIDE_CAP = 8, 3, 0.5, 0.25, 0.60, 2.18, 100


# --- boxes ---

def drop_repeats(boxes: DataFrame) -> DataFrame:
    """First annotation of every exact (file, category, box)."""
    return first_per_group(boxes, ["file_name", "category", *BBOX], ["source_json", "annotation_id"])


def flag_conflicts(boxes: DataFrame) -> DataFrame:
    """`conflicting`: the same exact box of a document carries more than one category."""
    keys = ["source_json", "file_name", *BBOX]
    mixed = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), (F.min("category") != F.max("category")).alias("mixed"))
    hit = mixed.filter("mixed").select(*keys, "__n", F.lit(True).alias("conflicting"))
    return join_skewed(boxes, hit, keys, "__n", "left").withColumn("conflicting", F.coalesce("conflicting", F.lit(False)))


def filter_categories(df: DataFrame, mapping: Mapping[str, int], category: str = "category") -> DataFrame:
    """Rows of the categories of interest with their label."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("label", m[F.col(category)]).filter(F.col(category).isin(*mapping))


def entities_by_file(df: DataFrame, null_category: str = "none") -> DataFrame:
    """Every annotated entity as a neighbour of its file."""
    return df.filter(F.col("category") != null_category).select("file_name", "annotation_id", "category", *BBOX)


def _boxes_clash(k: np.ndarray, row: np.ndarray, thr: float) -> bool:
    x, y, w, h = row
    ix = np.minimum(k[:, 0] + k[:, 2], x + w) - np.maximum(k[:, 0], x)
    iy = np.minimum(k[:, 1] + k[:, 3], y + h) - np.maximum(k[:, 1], y)
    inter = np.maximum(0.0, ix) * np.maximum(0.0, iy)
    return bool((inter > thr * (k[:, 2] * k[:, 3] + w * h - inter)).any())


def _cell_ids(structs: Column) -> Column:
    return F.transform(structs, lambda s: F.xxhash64(s))


def greedy_iou_dedup(boxes: DataFrame, thr: float = DUPLICATE_IOU, by: Sequence[str] = ("file_name", "label"),
                     order: Sequence = ("source_json", "annotation_id"), fold_rows: int = FOLD_ROWS) -> DataFrame:
    """`kept` is False for a box that overlaps an earlier kept box of its group by more than `thr`. A box without an area
    overlaps nothing and is kept.

    For the grid: an overlap above thr needs side ratios below 1/thr and offsets below (1 - thr) of the larger side,
    so cells are scaled per size class and only neighbouring cells and size classes matter.
    """
    base = 1.0 / thr
    reach = max(1.0, (1.0 - thr) / thr) * 1.01

    def level(side: str) -> Column:
        return F.floor(F.log(F.col(side)) / math.log(base))

    def cell(v: str, lev: Column) -> Column:
        return F.floor(F.col(v) / (F.pow(F.lit(base), lev + 1) * reach))

    lw, lh = level("w"), level("h")
    register = _cell_ids(F.array(*[F.struct(lw.alias("a"), lh.alias("b"), (cell("x", lw) + i).alias("c"), (cell("y", lh) + j)
                                            .alias("d")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    probe = _cell_ids(F.array(*[F.struct((lw + i).alias("a"), (lh + j).alias("b"), cell("x", lw + i).alias("c"),
                                         cell("y", lh + j).alias("d")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return suppress(boxes, by, order, lambda k, u: iou([k + c for c in BBOX], [u + c for c in BBOX]) > thr,
                    lambda k, row: _boxes_clash(k, row, thr), real(*BBOX) & (F.col("w") > 0) & (F.col("h") > 0), register, probe,
                    BBOX, fold_rows)


def skip_reason(boxes: DataFrame, denied: DataFrame | None = None, excluded: Sequence[str] = ("CLL",),
                duplicates: bool = True) -> DataFrame:
    """First reason to leave a box out, NULL when it stays. Duplicates are judged among boxes without another reason."""
    d = boxes
    deny = F.lit(False)
    if denied is not None:
        d = d.join(denied.select("file_name", "annotation_id", F.lit(True).alias("__deny")).distinct(),
                   ["file_name", "annotation_id"], "left")
        deny = F.coalesce("__deny", F.lit(False))
    margin = F.least("x", "y", F.col("img_w") - F.col("x") - F.col("w"), F.col("img_h") - F.col("y") - F.col("h"))
    reason = (F.when(F.col("image_path").isNull(), "missing_image").when(deny, "misplaced_box")
              .when(F.least("w", "h") < MIN_SIDE, "degenerate_box").when(margin <= EDGE, "truncated_cell")
              .when((F.col("label") == 0) & F.col("leukemia_type").isin(*excluded), "excluded_slide_type")
              .when(F.col("conflicting"), "conflicting_label"))
    d = d.withColumn("skip", reason)
    d = d.drop("__deny") if denied is not None else d
    if not duplicates:
        return d
    judged = greedy_iou_dedup(d.filter(F.col("skip").isNull()))
    judged = judged.withColumn("skip", F.when(~F.col("kept"), F.lit("duplicate_box"))).drop("kept")
    return d.filter(F.col("skip").isNotNull()).unionByName(judged)


def crop_window(df: DataFrame, context: float = CONTEXT, x_scale: float = X_SCALE, ref_side: Column | None = None) -> DataFrame:
    """Integer window (x0, y0, win_w, win_h) centred on the box: `context` times the reference side, or times the
    box's own longer unsqueezed side. Rounds half to even."""
    side = ref_side if ref_side is not None else F.greatest(F.col("w") / x_scale, F.col("h"))
    height = F.greatest(F.lit(1.0), F.rint(F.lit(context) * side))
    d = df.withColumn("win_h", height)
    d = d.withColumn("win_w", F.greatest(F.lit(1.0), F.rint(F.col("win_h") * x_scale)))
    return d.withColumns({"x0": F.rint(F.col("x") + F.col("w") / 2 - F.col("win_w") / 2),
                          "y0": F.rint(F.col("y") + F.col("h") / 2 - F.col("win_h") / 2)})


def reference_side(boxes: DataFrame, x_scale: float = X_SCALE) -> DataFrame:
    """Exact median of the unsqueezed longer side over all boxes, one row."""
    side = boxes.select(F.greatest(F.col("w") / x_scale, F.col("h")).alias("side"))
    return exact_quantiles(side, [], "side", {"ref_side": 0.5})


def pad_fraction(df: DataFrame) -> DataFrame:
    """Share of the window outside the frame, to 4 decimals."""
    inside = (overlap_1d("x0", F.col("x0") + F.col("win_w"), F.lit(0.0), "img_w")
              * overlap_1d("y0", F.col("y0") + F.col("win_h"), F.lit(0.0), "img_h"))
    return df.withColumn("pad_fraction", F.bround(1.0 - inside / (F.col("win_w") * F.col("win_h")), 4))


def opposite_neighbour(df: DataFrame, entities: DataFrame, opposing: Mapping[int, Sequence[str]],
                       share: float = NEIGHBOUR_SHARE, cell: float = 128.0) -> DataFrame:
    """`opposite`: the window shows at least `share` of an entity of an opposing category. Windows and entities meet in
    the grid cells both touch, keyed by the window's label too, so a crowded file is not compared all against all and no
    pair of one class is made."""
    def span(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / cell), F.floor(hi / cell))

    def spread(d: DataFrame, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
        return d.withColumn("cx", F.explode(span(x, x + w))).withColumn("cy", F.explode(span(y, y + h)))

    win = df.select("file_name", "annotation_id", "label", "x0", "y0", "win_w", "win_h")
    win = spread(win, F.col("x0"), F.col("y0"), F.col("win_w"), F.col("win_h"))
    labels = F.array_compact(F.array(*[F.when(F.col("category").isin(*cats), F.lit(label)) for label, cats in opposing.items()]))
    e = entities.select("file_name", F.col("annotation_id").alias("eid"), labels.alias("labels"),
                        *[F.col(c).cast("double").alias(f"e{c}") for c in BBOX])
    e = e.withColumn("label", F.explode("labels")).drop("labels")
    e = spread(e, F.col("ex"), F.col("ey"), F.col("ew"), F.col("eh"))
    inter = box_intersection(("x0", "y0", "win_w", "win_h"), ("ex", "ey", "ew", "eh"))
    j = win.join(e, ["file_name", "label", "cx", "cy"])
    hits = j.filter((F.col("annotation_id") != F.col("eid")) & (inter >= F.lit(share) * F.col("ew") * F.col("eh")))
    hits = hits.select("file_name", "annotation_id").distinct().withColumn("opposite", F.lit(True))
    return df.join(hits, ["file_name", "annotation_id"], "left").fillna(False, ["opposite"])


def keep_one_per_entity(df: DataFrame, same: DataFrame) -> DataFrame:
    """Of the boxes of one physical entity keep the least padded, then the lowest id; unlisted boxes all stay."""
    keys = ["file_name", *BBOX]
    listed = same.select(*keys, "cell_group").distinct()
    d = df.join(listed, keys, "left")
    one = first_per_group(d.filter(F.col("cell_group").isNotNull()), ["cell_group"], ["pad_fraction", "annotation_id"])
    return d.filter(F.col("cell_group").isNull()).unionByName(one)


def cap_per_group(df: DataFrame, by: Sequence[str], n: int, order: Sequence, only: Column | None = None) -> DataFrame:
    """At most n rows per group in the given order; rows outside `only` are not capped."""
    if only is None:
        return top_per_group(df, by, n, order)
    return top_per_group(df.filter(only), by, n, order).unionByName(df.filter(~only))


def reason_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("skip").isNotNull()).groupBy("skip").agg(F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, classes: Sequence[str], column: str = "class_name") -> DataFrame:
    """Counts in the fixed class order, 0 for an absent class."""
    frame = df.sparkSession.createDataFrame(list(enumerate(classes)), f"position int, {column} string")
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return frame.join(n, column, "left").select("position", column, F.coalesce("n", F.lit(0)).alias("n"))


def _guard(df: DataFrame, broken: DataFrame, message: str) -> DataFrame:
    """df, failing when `broken` has a row. The check is part of the plan, so the result cannot be used without it."""
    n = broken.limit(1).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    c = df.columns[0]
    return df.withColumn(c, F.when(n > 0, F.raise_error(F.lit(message)).cast(df.schema[c].dataType)).otherwise(F.col(c)))


def assert_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _guard(df, df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"repeated {', '.join(cols)}")


def build_manifest(raw: DataFrame, same: DataFrame, mapping: Mapping[str, int], opposing: Mapping[int, Sequence[str]],
                   class_names: Sequence[str] = ("Normal", "ALL"), denied: DataFrame | None = None, context: float = CONTEXT,
                   x_scale: float = X_SCALE, cap: int = SLIDE_CAP) -> DataFrame:
    """The whole chain to the sorted manifest: reasons, neighbour test, one per entity, cap of the positive class per
    slide, each on the survivors only. The reference side is the median over all boxes before any is skipped. The
    survivors of the walk and the manifest are written, or the neighbour test and the test of the files would run what is before
    them again."""
    boxes = filter_categories(flag_conflicts(raw), mapping)
    boxes = stored(drop_repeats(boxes), "boxes")  # read by the reference side, the reasons and the walk
    ref = reference_side(boxes, x_scale).select("ref_side").scalar()
    kept = skip_reason(boxes, denied).filter(F.col("skip").isNull()).drop("skip")
    kept = stored(pad_fraction(crop_window(kept, context, x_scale, ref)), "kept")  # on both sides of the neighbour test
    kept = opposite_neighbour(kept, entities_by_file(raw), opposing).filter(~F.col("opposite")).drop("opposite")
    kept = keep_one_per_entity(kept, same)
    kept = cap_per_group(kept, ["slide"], cap, [F.col("pad_fraction"), F.col("annotation_id")], F.col("label") == 1)
    name = F.element_at(F.array(*[F.lit(c) for c in class_names]), F.col("label") + 1)
    file = F.concat(name, F.lit("/"), F.concat_ws("_", "slide", "image", F.col("annotation_id").cast("string")), F.lit(".png"))
    m = kept.select(file.alias("file"), "label", name.alias("class_name"), "category", "slide", "leukemia_type",
                    F.col("image_path").alias("source_image"), *BBOX, "annotation_id", "source_json",
                    F.col("win_h").cast("bigint").alias("window_h"), "pad_fraction")
    return assert_unique(stored(m, "manifest"), ["file"]).orderBy("file")


# --- snapshots and checks ---

def manifest_diff(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with its status: add, remove or unchanged."""
    a = wanted.select(*keys).distinct().withColumn("__w", F.lit(1))
    b = have.select(*keys).distinct().withColumn("__h", F.lit(1))
    status = F.when(F.col("__h").isNull(), "add").when(F.col("__w").isNull(), "remove").otherwise("unchanged")
    return a.join(b, list(keys), "full").select(*keys, status.alias("status"))


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of only one side."""
    return a.select(*keys).distinct().exceptAll(b.select(*keys).distinct()).withColumn("side", F.lit("missing")).unionByName(
        b.select(*keys).distinct().exceptAll(a.select(*keys).distinct()).withColumn("side", F.lit("extra")))


def assert_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _guard(a, key_differences(a, b, keys), "the key sets differ")


def assert_counts(df: DataFrame, expected: Mapping[str, int], column: str = "class_name", strict: bool = True) -> DataFrame:
    """Expected and found counts per class; a mismatch is an error."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{column} string, expected bigint")
    t = df.groupBy(column).agg(F.count(F.lit(1)).alias("found")).join(want, column, "full").fillna(0)
    t = t.withColumn("matches", F.col("found") == F.col("expected"))
    return _guard(t, t.filter(~F.col("matches")), "class counts differ") if strict else t


# --- sampling ---

def stratified_subset(df: DataFrame, strata: Sequence[str], fraction: float, seed: int, item: str = "item_id") -> DataFrame:
    """A reproducible share of every stratum, at least one row of each."""
    r = rank_rows(df.withColumn("__h", hash_int(item, F.lit(seed))), strata, ["__h", item], "__r")
    n = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    return join_groups(r, n, strata).filter(
        F.col("__r") <= F.greatest(F.lit(1.0), F.rint(F.lit(fraction) * F.col("__n")))).drop("__r", "__n", "__h")


def canonical_groups(df: DataFrame, group: str = "group_id", file: str = "file", out: str = "group_no") -> DataFrame:
    """Group numbers 0..G-1 in order of first appearance by file."""
    g = df.groupBy(group).agg(F.min(file).alias("__first"), F.count(F.lit(1)).alias("__n"))
    no = rank_rows(g, [], ["__first", group], "__r").select(group, "__n", (F.col("__r") - 1).alias(out))
    return join_skewed(df, no, [group], "__n")


def balanced_limit(df: DataFrame, n: int, label: str = "y", order: Sequence = ("item_id",)) -> DataFrame:
    """The first n / 2 rows of each class."""
    return top_per_group(df, [label], n // 2, list(order))


def quota_sample(df: DataFrame, passed: Column, quotas: Mapping[int, int], seed: int, label: str = "y",
                 item: str = "item_id") -> DataFrame:
    """A seeded permutation of every class, rows failing the check skipped, up to the quota of the class."""
    ok = df.filter(passed).filter(F.col(label).isin(*quotas))
    r = rank_rows(ok.withColumn("__h", hash_int(item, F.lit(seed))), [label], ["__h", item], "__r")
    limit = F.lit(0)
    for k, q in quotas.items():
        limit = F.when(F.col(label) == k, F.lit(q)).otherwise(limit)
    return r.filter(F.col("__r") <= limit).drop("__r", "__h")


def qc_rules(df: DataFrame, area: str, border: str, max_area: float) -> DataFrame:
    """First quality problem of a measured mask (empty, touches the frame, too large), NULL when it passes."""
    return df.withColumn("qc", F.when(F.col(area) <= 0, "empty").when(F.col(area) > max_area, "too_large")
                         .when(F.col(border), "touches_frame"))


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Inverse-frequency weight N / (classes * n_c)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"))
    total, k = t.select("N").scalar(), t.select("k").scalar()
    return c.withColumn("weight", total.cast("double") / (k * F.col("n")))


def content_digest(df: DataFrame, parts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One digest of the multiset of rows. Row digests are combined by their leading hex digits in a tree (8, 4, 0
    digits), so no step concatenates more than 65,536 children; equal rows collapse to a count first."""
    by = list(by)
    leaf = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(p).cast("string"), F.lit("\u0002")) for p in parts]), 256)
    d = df.select(*by, leaf.alias("h")).groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n"))
    d = d.select(*by, F.col("h").alias("path"), F.concat_ws(":", "h", F.col("n").cast("string")).alias("v"), "n")
    for digits in (8, 4, 0):
        up = F.substring("path", 1, digits) if digits else F.lit("")
        d = d.groupBy(*by, up.alias("p")).agg(F.sort_array(F.collect_list("v")).alias("vs"), F.sum("n").alias("n"))
        d = d.select(*by, F.col("p").alias("path"), F.concat_ws("", "p", F.sha2(F.concat_ws("", "vs"), 256)).alias("v"), "n")
    return d.select(*by, F.col("n").alias("rows"), F.col("v").alias("digest"))


def provenance_changed(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys whose digest differs between two digest tables, or that exist in one only."""
    x, y = a.select(*by, F.col("digest").alias("__a")), b.select(*by, F.col("digest").alias("__b"))
    return x.join(y, list(by), "full").filter(~F.col("__a").eqNullSafe(F.col("__b"))).select(*by)


def _pool(df: DataFrame, label: str, item: str) -> DataFrame:
    """Items with their index and the size of their class."""
    r = rank_rows(df.select(item, label), [label], [item], "idx").withColumn("idx", F.col("idx") - 1)
    return join_groups(r, r.groupBy(label).agg(F.count(F.lit(1)).alias("n")), [label])


def assign_donors(df: DataFrame, condition: str, k: int, seed: int, label: str = "y", item: str = "item_id") -> DataFrame:
    """k seeded donors per item from the other or the same class, never the item itself (binary labels)."""
    p = _pool(df, label, item)
    draws = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    if condition == "same":
        d = p.filter("n > 1").withColumn("draw", draws)
        i = draw_index(F.col("n") - 1, item, "draw", F.lit(seed), F.lit("same"))
        want = d.select(item, label, "draw", F.col(label).alias("__c"), F.when(i >= F.col("idx"), i + 1).otherwise(i).alias("__i"))
    else:
        sizes = p.groupBy(label).agg(F.max("n").alias("__m")).select((1 - F.col(label)).alias(label), "__m")
        d = join_groups(p.withColumn("draw", draws), sizes, [label])
        want = d.select(item, label, "draw", (1 - F.col(label)).alias("__c"),
                        draw_index("__m", item, "draw", F.lit(seed), F.lit("other")).alias("__i"))
    pool = p.select(F.col(label).alias("__c"), F.col("idx").alias("__i"), F.col(item).alias("donor"))
    return want.join(pool, ["__c", "__i"]).select(item, label, "draw", "donor")


def compose_bags(df: DataFrame, lo: int, hi: int, seed: int, label: str = "y", item: str = "item_id") -> DataFrame:
    """Bags of lo..hi members of the item's own class, drawn with replacement, the item itself first."""
    p = _pool(df, label, item)
    count = F.lit(lo) + F.least(F.floor(uniform(item, F.lit(seed), F.lit("n")) * (hi - lo + 1)), F.lit(hi - lo))
    d = p.withColumn("slot", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    i = F.when(F.col("slot") == 0, F.col("idx")).otherwise(draw_index("n", item, "slot", F.lit(seed)))
    want = d.select(F.col(item).alias("bag"), label, "slot", i.alias("__i"))
    return want.join(p.select(label, F.col("idx").alias("__i"), F.col(item).alias("member")), [label, "__i"]).drop("__i")


def filter_with_fallback(df: DataFrame, by: Sequence[str], passed: Column) -> DataFrame:
    """Rows passing a test; a group the test would empty keeps all its rows."""
    d = df.withColumn("__ok", F.coalesce(passed, F.lit(False)))
    g = d.groupBy(*by).agg(F.max("__ok").alias("__any"), F.count(F.lit(1)).alias("__n"))
    return join_skewed(d, g, list(by), "__n").filter(F.col("__ok") | ~F.col("__any")).drop("__ok", "__any")


def _discs_clash(k: np.ndarray, row: np.ndarray, sep: float) -> bool:
    return bool((np.hypot(k[:, 0] - row[0], k[:, 1] - row[1]) <= sep * (k[:, 2] + row[2])).any())


def radius_nms(df: DataFrame, by: Sequence[str], sep: float = 0.8, fold_rows: int = FOLD_ROWS, min_level: int = -8) -> DataFrame:
    """Instances left after dropping each one within sep * (r1 + r2) of a larger kept one. Cells are scaled per size
    class (radii below 2^min_level share one); an instance looks only into its own and larger classes. Instances whose
    place or radius is missing, not finite or negative stay and drop nothing."""
    level = F.greatest(F.floor(F.log2("r")), F.lit(min_level)).cast("int")
    max_level = df.agg(F.max(level)).first()[0] or 0

    def cell(v: str, lev: Column) -> Column:
        return F.floor(F.col(v) / (F.pow(F.lit(2.0), lev + 1) * (2.0 * sep * 1.01)))

    register = _cell_ids(F.array(*[F.struct(level.alias("a"), (cell("x", level) + i).alias("b"), (cell("y", level) + j).alias("c"))
                                   for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    probe = F.transform(F.sequence(level, F.lit(max_level)), lambda m: F.xxhash64(F.struct(
        m.alias("a"), cell("x", m).alias("b"), cell("y", m).alias("c"))))

    def near(k: str, u: str) -> Column:
        return F.hypot(F.col(k + "x") - F.col(u + "x"), F.col(k + "y") - F.col(u + "y")) <= F.lit(sep) * (
            F.col(k + "r") + F.col(u + "r"))

    order = [-F.col("r"), -F.col("x"), -F.col("y"), F.col("inst_id")]
    t = suppress(df, by, order, near, lambda k, row: _discs_clash(k, row, sep), real("x", "y", "r") & (F.col("r") >= 0), register,
                 probe, ("x", "y", "r"), fold_rows)
    return t.filter("kept").drop("kept")


def examples(df: DataFrame, by: Sequence[str], n: int, order: Sequence[str] = ("item_id",)) -> DataFrame:
    """n rows per group evenly spaced in order (the first row when n is 1): positions floor(i * (size - 1) / (n - 1))."""
    by = list(by)
    r = rank_rows(df, by, order, "__r")
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    d = join_groups(r, size, by)
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(
        i * (F.col("__n") - 1) / F.lit(float(max(1, n - 1)))).cast("bigint"))
    return d.filter(F.array_contains(spots, F.col("__r") - 1)).drop("__r", "__n")
