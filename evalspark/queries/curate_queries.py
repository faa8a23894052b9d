"""Curation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.functions.columns import iou, uniform
from evalspark.operators import curate as C
from evalspark.queries.metrics_queries import rounded
from evalspark.queries.oracle import U, sql
from evalspark.sources import views as V
from evalspark.sources.tables import table

Q = {}
MAP = {"lymph": 0, "blast": 1}
OPP = {0: ["blast", "mono"], 1: ["lymph"]}
box = V.box


def labelled(s, d):
    return C.filter_categories(C.flag_conflicts(box(s, d)), MAP)


def same_entity(s, d):
    return wanted_boxes(s, d).filter(uniform("slide", "x", "y") < 0.3).select(
        "file_name", "x", "y", "w", "h", F.concat_ws("_", "slide", F.col("x").cast("int").cast("string"),
                                                     F.col("y").cast("int").cast("string")).alias("cell_group")).distinct()


def denied(s, d):
    return box(s, d).filter(uniform("annotation_id", F.lit("deny")) < 0.01).select("file_name", "annotation_id")


ROWS = dict(
    firsts="""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_name, category, x, y, w, h ORDER BY source_json, annotation_id)
 AS rn FROM box) WHERE rn = 1""",
    conf="""SELECT *, min(category) OVER k <> max(category) OVER k AS conflicting FROM box WINDOW k AS (PARTITION BY source_json, file_name, x, y, w, h)""",
    lab="SELECT *, (category = 'blast')::INT AS label FROM conf WHERE category IN ('lymph', 'blast')",
    labf="""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_name, category, x, y, w, h ORDER BY source_json, annotation_id)
 AS rn FROM lab) WHERE rn = 1""",
    refs="SELECT quantile_cont(greatest(w / 0.6::DOUBLE, h), 0.5) AS ref_side FROM labf",
    win1="SELECT *, greatest(1.0, round_even(2.18::DOUBLE * ref_side, 0)) AS win_h FROM labf, refs",
    win2="SELECT *, greatest(1.0, round_even(win_h * 0.6::DOUBLE, 0)) AS win_w FROM win1",
    win="SELECT *, round_even(x + w/2 - win_w/2, 0) AS x0, round_even(y + h/2 - win_h/2, 0) AS y0 FROM win2",
    pad="""SELECT *, round_even(1 - greatest(0.0, least(x0 + win_w, img_w) - greatest(x0, 0)) * greatest(0.0, least(y0 + win_h, img_h) - greatest(y0, 0))
 / (win_w * win_h), 4) AS pad_fraction FROM win""",
    same=f"""SELECT DISTINCT file_name, x, y, w, h, slide || '_' || x::INT || '_' || y::INT AS cell_group FROM lab WHERE {U("slide", "x::INT || '.0'", "y::INT || '.0'")}
 < 0.3::DOUBLE""",
    one="""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(cell_group, annotation_id::VARCHAR) ORDER BY pad_fraction,
 annotation_id) AS rn FROM pad LEFT JOIN same USING (file_name, x, y, w, h)) WHERE rn = 1""",
    reason=f"""SELECT file_name, annotation_id, CASE WHEN image_path IS NULL THEN 'missing_image' WHEN {U("annotation_id", "'deny'")} < 0.01::DOUBLE
 THEN 'misplaced_box' WHEN least(w, h) < 8 THEN 'degenerate_box' WHEN least(x, y, img_w - x - w, img_h - y - h) <= 3 THEN 'truncated_cell'
 WHEN label = 0 AND leukemia_type = 'CLL' THEN 'excluded_slide_type' WHEN conflicting THEN 'conflicting_label' END AS skip FROM labf""")


def q(name, fn, body, **kw):
    Q[name] = (fn, sql(body, **{**ROWS, **kw}) if body else None)


def wanted_boxes(s, d):
    """Boxes of the categories of interest without the flag of conflicts, which costs two shuffles of all boxes."""
    return C.filter_categories(box(s, d), MAP)


def boxes1(s, d):
    return C.drop_repeats(wanted_boxes(s, d))


def flagged1(s, d):
    return C.drop_repeats(labelled(s, d))


def keys1(s, d):
    """The first boxes with no more columns than it takes to find them."""
    return C.drop_repeats(wanted_boxes(s, d).select("file_name", "category", *C.BBOX, "source_json", "annotation_id"))


def windows(s, d):
    b = boxes1(s, d)
    return C.pad_fraction(C.crop_window(b, ref_side=C.reference_side(b).select("ref_side").scalar()))


q("c01_drop_repeats", lambda s, d: C.drop_repeats(box(s, d)).select("file_name", "category", "x", "y", "w", "h", "annotation_id"),
  "SELECT file_name, category, x, y, w, h, annotation_id FROM firsts")
q("c02_flag_conflicts", lambda s, d: C.flag_conflicts(box(s, d)).select("annotation_id", "conflicting"),
  "SELECT annotation_id, conflicting FROM conf")
q("c03_filter_categories", lambda s, d: labelled(s, d).select("annotation_id", "category", "label"),
  "SELECT annotation_id, category, label FROM lab")
q("c04_entities_by_file", lambda s, d: C.entities_by_file(box(s, d)),
  "SELECT file_name, annotation_id, category, x, y, w, h FROM box WHERE category <> 'none'")


def iou_pairs(s, d):
    """Every box with the next one of its file and column, by annotation id."""
    w = Window.partitionBy("file_name", "x").orderBy("annotation_id")
    b = boxes1(s, d).select("file_name", "annotation_id", *[F.col(c).alias("a" + c) for c in C.BBOX], "x")
    b = b.select("*", *[F.lead("a" + c).over(w).alias("b" + c) for c in C.BBOX]).filter("bx IS NOT NULL")
    return b.select("file_name", "annotation_id", F.round(iou(["a" + c for c in C.BBOX], ["b" + c for c in C.BBOX]), 6).alias("iou"))


q("c05_iou", iou_pairs,
  """SELECT file_name, annotation_id, round(i / (w*h + bw*bh - i), 6) AS iou FROM (SELECT *, greatest(0.0, least(x+w, bx+bw) - greatest(x, bx)) *
 greatest(0.0, least(y+h, by_+bh) - greatest(y, by_)) AS i FROM (SELECT file_name, annotation_id, x, y, w, h, lead(x) OVER o AS bx, lead(y) OVER o AS by_,
 lead(w) OVER o AS bw, lead(h) OVER o AS bh FROM labf WINDOW o AS (PARTITION BY file_name, x ORDER BY annotation_id)) WHERE bx IS NOT NULL)""")


def walk_sql(group: str, fields: str, conflict: str) -> dict[str, str]:
    """The greedy walk, one row of every group a step: `kept` holds the rows kept so far. `ranked` gives the order r."""
    made = ", ".join(f"{f} := o.{f}" for f in fields.split(", "))
    return dict(
        walk=f"""SELECT {group}, 0::BIGINT AS r, list_filter([struct_pack({", ".join(f"{f} := {f}" for f in fields.split(", "))})], lambda s : FALSE) AS kept
 FROM ranked WHERE r = 1 UNION ALL SELECT {", ".join("k." + g.strip() for g in group.split(","))}, o.r, CASE WHEN len(list_filter(k.kept, lambda s : {conflict})) = 0
 THEN list_append(k.kept, struct_pack({made})) ELSE k.kept END FROM walk k JOIN ranked o ON {" AND ".join(f"o.{g.strip()} = k.{g.strip()}" for g in group.split(","))} AND o.r = k.r + 1""",
        ends=f"SELECT {group}, unnest(kept) AS s FROM (SELECT {group}, arg_max(kept, r) AS kept FROM walk GROUP BY ALL)")


IOU_SQL = """greatest(0.0, least(s.x + s.w, o.x + o.w) - greatest(s.x, o.x)) * greatest(0.0, least(s.y + s.h, o.y + o.h) - greatest(s.y, o.y))"""
q("c06_greedy_iou_dedup", lambda s, d: C.greedy_iou_dedup(boxes1(s, d)).select("file_name", "annotation_id", "kept"),
  """SELECT b.file_name, b.annotation_id, e.s IS NOT NULL AS kept FROM ranked b LEFT JOIN ends e ON e.file_name = b.file_name AND e.label = b.label
 AND e.s.annotation_id = b.annotation_id""", recursive=True,
  ranked="""SELECT file_name, label, annotation_id, x, y, w, h, row_number() OVER (PARTITION BY file_name, label ORDER BY source_json, annotation_id) AS r FROM labf""",
  **walk_sql("file_name, label", "annotation_id, x, y, w, h", f"{IOU_SQL} > 0.5::DOUBLE * (s.w * s.h + o.w * o.h - {IOU_SQL})"))
q("c07_skip_reason", lambda s, d: C.skip_reason(flagged1(s, d), denied(s, d), duplicates=False).select("file_name", "annotation_id", "skip"),
  "SELECT file_name, annotation_id, skip FROM reason")
WIN = ["annotation_id", "x0", "y0", "win_w", "win_h"]
q("c08_crop_window", lambda s, d: windows(s, d).select(*WIN), f"SELECT {', '.join(WIN)} FROM win")
q("c09_reference_side", lambda s, d: rounded(C.reference_side(boxes1(s, d))), "SELECT round(ref_side, 6) AS ref_side FROM refs")
q("c10_pad_fraction", lambda s, d: windows(s, d).select("annotation_id", "pad_fraction"), "SELECT annotation_id, pad_fraction FROM pad")
NEIGHBOUR = """SELECT 1 FROM box e WHERE e.file_name = p.file_name AND e.annotation_id <> p.annotation_id AND
 ((p.label = 0 AND e.category IN ('blast', 'mono')) OR (p.label = 1 AND e.category = 'lymph')) AND
 greatest(0.0, least(x0 + win_w, e.x + e.w) - greatest(x0, e.x)) * greatest(0.0, least(y0 + win_h, e.y + e.h) - greatest(y0, e.y)) >= 0.25 * e.w * e.h"""
q("c11_opposite_neighbour", lambda s, d: C.opposite_neighbour(windows(s, d), C.entities_by_file(box(s, d)), OPP)
  .select("file_name", "annotation_id", "opposite"),
  f"SELECT file_name, annotation_id, EXISTS ({NEIGHBOUR}) AS opposite FROM pad p")
q("c12_keep_one_per_entity", lambda s, d: C.keep_one_per_entity(windows(s, d), same_entity(s, d)).select("annotation_id", "cell_group"),
  "SELECT annotation_id, cell_group FROM one")
q("c13_cap_per_group", lambda s, d: C.cap_per_group(windows(s, d), ["slide"], 100, [F.col("pad_fraction"), F.col("annotation_id")],
                                                    F.col("label") == 1).select("slide", "annotation_id", "label"),
  """SELECT slide, annotation_id, label FROM (SELECT *, row_number() OVER (PARTITION BY slide, label ORDER BY pad_fraction, annotation_id) AS rn FROM pad)
 WHERE label = 0 OR rn <= 100""")
q("c14_reason_counts", lambda s, d: C.reason_counts(C.skip_reason(flagged1(s, d), denied(s, d), duplicates=False)),
  "SELECT skip, count(*) AS n FROM reason WHERE skip IS NOT NULL GROUP BY ALL")
q("c14_class_counts", lambda s, d: C.class_counts(box(s, d), ["lymph", "blast", "mono", "absent"], "category"),
  """SELECT position, t.category, count(b.category) AS n FROM (VALUES (0, 'lymph'), (1, 'blast'), (2, 'mono'), (3, 'absent')) t(position, category)
 LEFT JOIN box b USING (category) GROUP BY ALL""")
q("c15_assert_unique", lambda s, d: C.assert_unique(box(s, d).select("file_name", "annotation_id", "category"), ["file_name", "annotation_id"]),
  "SELECT file_name, annotation_id, category FROM box")
MANIFEST = """SELECT concat(name, '/', slide, '_', image, '_', annotation_id, '.png') AS file, label, name AS class_name, category, slide, leukemia_type, image_path AS source_image,
 x, y, w, h, annotation_id, source_json, win_h::BIGINT AS window_h, pad_fraction FROM (SELECT *, CASE label WHEN 0 THEN 'Normal' ELSE 'ALL' END AS name,
 row_number() OVER (PARTITION BY slide, label ORDER BY pad_fraction, annotation_id) AS place FROM single) WHERE label = 0 OR place <= 100"""
CHAIN = dict(
  good="SELECT p.* FROM pad p JOIN reason r USING (file_name, annotation_id) WHERE r.skip IS NULL",
  ranked="""SELECT file_name, label, annotation_id, x, y, w, h, row_number() OVER (PARTITION BY file_name, label ORDER BY source_json, annotation_id) AS r FROM good""",
  **walk_sql("file_name, label", "annotation_id, x, y, w, h", f"{IOU_SQL} > 0.5::DOUBLE * (s.w * s.h + o.w * o.h - {IOU_SQL})"),
  alone=f"""SELECT p.* FROM good p JOIN ends e ON e.file_name = p.file_name AND e.label = p.label AND e.s.annotation_id = p.annotation_id
 WHERE NOT EXISTS ({NEIGHBOUR})""",
  single="""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(cell_group, annotation_id::VARCHAR) ORDER BY pad_fraction, annotation_id) AS rn
 FROM alone LEFT JOIN same USING (file_name, x, y, w, h)) WHERE rn = 1""")
q("c16_build_manifest", lambda s, d: C.build_manifest(box(s, d), same_entity(s, d), MAP, OPP, denied=denied(s, d)), MANIFEST, recursive=True, **CHAIN)


def wanted(s, d):
    return keys1(s, d).filter("x >= 40").select("annotation_id", "file_name")


def have(s, d):
    return keys1(s, d).filter("y >= 40").select("annotation_id", "file_name")


q("c17_manifest_diff", lambda s, d: C.manifest_diff(wanted(s, d), have(s, d), ["annotation_id"]),
  """SELECT annotation_id, CASE WHEN y < 40 THEN 'add' WHEN x < 40 THEN 'remove' ELSE 'unchanged' END AS status FROM labf WHERE x >= 40 OR y >= 40""")
q("c18_key_differences", lambda s, d: C.key_differences(wanted(s, d), have(s, d), ["annotation_id"]),
  """SELECT annotation_id, CASE WHEN y < 40 THEN 'missing' ELSE 'extra' END AS side FROM labf WHERE (x >= 40) <> (y >= 40)""")
q("c19_stratified_subset", lambda s, d: C.stratified_subset(V.items(s, d), ["cohort", "subtype"], 0.1, 7).select("cohort", "subtype", "item_id"),
  f"""SELECT cohort, subtype, item_id FROM (SELECT *, row_number() OVER (PARTITION BY cohort, subtype ORDER BY {U("item_id", "7")}, item_id) AS rn,
 count(*) OVER (PARTITION BY cohort, subtype) AS n FROM items) WHERE rn <= greatest(1, round_even(0.1::DOUBLE * n, 0))""")


def grouped(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("group_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file"))


q("c20_canonical_groups", lambda s, d: C.canonical_groups(grouped(s, d)),
  """SELECT o_custkey AS group_id, lpad(o_orderkey::VARCHAR, 12, '0') AS file, dense_rank() OVER (ORDER BY f) - 1 AS group_no FROM (SELECT *,
 min(lpad(o_orderkey::VARCHAR, 12, '0')) OVER (PARTITION BY o_custkey) AS f FROM orders)""")
q("c21_balanced_limit", lambda s, d: C.balanced_limit(V.items(s, d), 3000).select("item_id", "y"),
  "SELECT item_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY item_id) AS rn FROM items) WHERE rn <= 1500")
MASKS = "SELECT l_orderkey*10+l_linenumber AS item_id, (l_returnflag = 'A')::INT AS y, l_partkey, l_suppkey, l_quantity - 2 AS area, l_tax >= 0.08::DOUBLE AS border FROM lineitem"


def masks(s, d):
    li = table(s, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), (F.col("l_returnflag") == "A").cast("int").alias("y"),
                     "l_partkey", "l_suppkey", (F.col("l_quantity") - 2).alias("area"), (F.col("l_tax") >= 0.08).alias("border"))


QC = "CASE WHEN area <= 0 THEN 'empty' WHEN area > 45 THEN 'too_large' WHEN border THEN 'touches_frame' END"


def item_masks(s, d):
    o = V.items(s, d).select("item_id", "y")
    a = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.sum("l_quantity").alias("area"), F.max("l_tax").alias("t"))
    return C.qc_rules(o.join(a, "item_id").withColumn("border", F.col("t") >= 0.08), "area", "border", 150.0)


q("c22_quota_sample", lambda s, d: C.quota_sample(item_masks(s, d), F.col("qc").isNull(), {0: 1500, 1: 400}, 3).select("item_id", "y"),
  f"""SELECT item_id, y FROM (SELECT item_id, y, row_number() OVER (PARTITION BY y ORDER BY {U("item_id", "3")}, item_id) AS rn FROM (SELECT l_orderkey AS item_id,
 sum(l_quantity) AS area, max(l_tax) AS t FROM lineitem GROUP BY ALL) JOIN items USING (item_id) WHERE area > 0 AND area <= 150 AND t < 0.08::DOUBLE)
 WHERE rn <= CASE y WHEN 0 THEN 1500 ELSE 400 END""")
q("c23_qc_rules", lambda s, d: C.qc_rules(masks(s, d), "area", "border", 45.0).groupBy("y", "qc").agg(F.count(F.lit(1)).alias("n")),
  f"SELECT y, {QC} AS qc, count(*) AS n FROM ({MASKS}) GROUP BY ALL")
q("c24_class_weights", lambda s, d: rounded(C.class_weights(V.items(s, d), "subtype")),
  "SELECT subtype, count(*) AS n, round((SELECT count(*) FROM items) / (4.0 * count(*)), 6) AS weight FROM items GROUP BY ALL")
q("c25_content_digest", lambda s, d: C.content_digest(V.items(s, d), ["item_id", "y", "unit"], ["cohort"]),
  """SELECT cohort, sum(n)::BIGINT AS rows, sha256(string_agg(v, '' ORDER BY v)) AS digest FROM dg4 GROUP BY ALL""",
  dg0="SELECT cohort, h, h || ':' || count(*) AS v, count(*) AS n FROM (SELECT cohort, sha256(concat_ws(chr(1), item_id, y, unit)) AS h FROM items) GROUP BY cohort, h",
  dg8="SELECT cohort, substr(h, 1, 8) AS p, substr(h, 1, 8) || sha256(string_agg(v, '' ORDER BY v)) AS v, sum(n) AS n FROM dg0 GROUP BY cohort, substr(h, 1, 8)",
  dg4="SELECT cohort, substr(p, 1, 4) AS q, substr(p, 1, 4) || sha256(string_agg(v, '' ORDER BY v)) AS v, sum(n) AS n FROM dg8 GROUP BY cohort, substr(p, 1, 4)")
q("c25_provenance_changed", lambda s, d: C.provenance_changed(
    C.content_digest(V.items(s, d), ["item_id", "y"], ["cohort"]),
    C.content_digest(V.items(s, d).filter("cohort <> 'testb' OR y = 1"), ["item_id", "y"], ["cohort"]), ["cohort"]),
  "SELECT DISTINCT cohort FROM items WHERE cohort = 'testb'")
q("c26_assert_counts", lambda s, d: C.assert_counts(V.items(s, d), {"base": 1, "sub0": 2, "gone": 3}, "subtype", strict=False),
  """SELECT subtype, coalesce(n, 0) AS found, coalesce(e, 0)::BIGINT AS expected, coalesce(n, 0) = coalesce(e, 0) AS matches FROM (SELECT subtype, count(*) AS n FROM items
 GROUP BY ALL) FULL JOIN (VALUES ('base', 1), ('sub0', 2), ('gone', 3)) t(subtype, e) USING (subtype)""")
POOL = dict(pool="SELECT item_id, y, row_number() OVER (PARTITION BY y ORDER BY item_id) - 1 AS idx, count(*) OVER (PARTITION BY y) AS n FROM items")
DI = "least(floor({u} * {n})::BIGINT, {n} - 1)"
q("c27_donors_other", lambda s, d: C.assign_donors(V.items(s, d), "other", 2, 5),
  f"""SELECT w.item_id, w.y, draw, p.item_id AS donor FROM (SELECT a.item_id, a.y, draw, {DI.format(u=U("item_id", "draw", "5", "'other'"), n="m")} AS i FROM pool a,
 (VALUES (0), (1)) t(draw), (SELECT y AS oy, max(n) AS m FROM pool GROUP BY ALL) o WHERE o.oy = 1 - a.y) w JOIN pool p ON p.y = 1 - w.y AND p.idx = w.i""", **POOL)
q("c27_donors_same", lambda s, d: C.assign_donors(V.items(s, d), "same", 2, 5),
  f"""SELECT w.item_id, w.y, draw, p.item_id AS donor FROM (SELECT item_id, y, draw, CASE WHEN i >= idx THEN i + 1 ELSE i END AS i FROM (SELECT item_id, y, idx, draw,
 {DI.format(u=U("item_id", "draw", "5", "'same'"), n="(n - 1)")} AS i FROM pool, (VALUES (0), (1)) t(draw))) w JOIN pool p ON p.y = w.y AND p.idx = w.i""", **POOL)
q("c28_compose_bags", lambda s, d: C.compose_bags(V.items(s, d), 2, 5, 9),
  f"""SELECT w.item_id AS bag, w.y, slot, p.item_id AS member FROM (SELECT item_id, y, slot, CASE WHEN slot = 0 THEN idx ELSE
 {DI.format(u=U("item_id", "slot", "9"), n="n")} END AS i FROM (SELECT *, unnest(range((2 + least(floor({U("item_id", "9", "'n'")} * 4), 3))::INT))::INT AS slot
 FROM pool)) w JOIN pool p ON p.y = w.y AND p.idx = w.i""", **POOL)
q("c29_filter_with_fallback", lambda s, d: C.filter_with_fallback(V.instance(s, d), ["item_id"], F.col("keep")).select("item_id", "inst_id", "keep"),
  "SELECT item_id, inst_id, keep FROM (SELECT *, bool_or(keep) OVER (PARTITION BY item_id) AS k FROM instance) WHERE keep OR NOT k")
q("c30_radius_nms", lambda s, d: C.radius_nms(V.instance(s, d), ["item_id"]).select("item_id", "inst_id", "r"),
  "SELECT item_id, s.inst_id AS inst_id, s.size AS r FROM ends", recursive=True,
  ranked="SELECT item_id, inst_id, x, y, r AS size, row_number() OVER (PARTITION BY item_id ORDER BY r DESC, x DESC, y DESC, inst_id) AS r FROM instance",
  **walk_sql("item_id", "inst_id, x, y, size", "sqrt((s.x - o.x) * (s.x - o.x) + (s.y - o.y) * (s.y - o.y)) <= 0.8::DOUBLE * (s.size + o.size)"))
q("c31_examples", lambda s, d: C.examples(V.items(s, d), ["subtype"], 8).select("subtype", "item_id"),
  """SELECT subtype, item_id FROM (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY item_id) - 1 AS r, count(*) OVER (PARTITION BY subtype) AS n FROM items)
 WHERE r IN (SELECT floor(i * (n - 1) / 7.0::DOUBLE)::BIGINT FROM range(8) t(i))""")
