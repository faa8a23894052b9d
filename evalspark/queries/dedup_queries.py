"""Duplicates, leakage and grouping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from evalspark.functions import fingerprint as FP
from evalspark.functions.simhash import text_fingerprints
from evalspark.operators import dedup as D
from evalspark.queries.metrics_queries import rounded
from evalspark.queries.oracle import sql
from evalspark.sources import views as V
from evalspark.sources.tables import table

Q = {}
MM, MO, MS = 3, 0.5, 0.7  # required matches, overlap and similarity of a pair


def values(m: np.ndarray, name: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {float(m[i, j])!r}::DOUBLE)" for i in range(m.shape[0])
                                              for j in range(m.shape[1])) + f") t(o, i, {name})"


VIEW = "SELECT * FROM (VALUES " + ", ".join(f"({k}, {pos}, {int(src)})" for k, v in enumerate(FP.view_index())
                                           for pos, src in enumerate(v)) + ") t(view, pos, src)"
FPC = dict(
    lowf=values(FP.LOW_FREQUENCY, "k"), grad=values(FP.GRADIENT, "k"), vidx=VIEW,
    gv="SELECT source, item_id, view, pos // 8 AS r, pos % 8 AS c, grid[src + 1] AS v FROM grey_items, vidx",
    half="SELECT source, item_id, view, r, o AS w, sum(v * k) AS v FROM gv JOIN lowf ON i = c GROUP BY ALL",
    freq="SELECT source, item_id, view, o * 8 + w AS f, sum(v * k) AS v FROM half JOIN lowf ON i = r GROUP BY ALL",
    med="SELECT source, item_id, view, quantile_cont(v, 0.5) AS m FROM freq WHERE f > 0 GROUP BY ALL",
    hash1="""SELECT source, item_id, view, sum(CASE WHEN v > m THEN 1::HUGEINT << (CASE WHEN f = 0 THEN 0 ELSE 64 - f END)::INT ELSE 0 END)
 AS h FROM freq JOIN med USING (source, item_id, view) GROUP BY ALL""",
    wide="SELECT source, item_id, view, r, o AS w, sum(v * k) AS v FROM gv JOIN grad ON i = c GROUP BY ALL",
    hash2="""SELECT a.source, a.item_id, a.view, sum(CASE WHEN b.v > a.v THEN 1::HUGEINT << (63 - a.r * 8 - a.w)::INT ELSE 0 END) AS h
 FROM wide a JOIN wide b ON a.source = b.source AND a.item_id = b.item_id AND a.view = b.view AND a.r = b.r AND b.w = a.w + 1 GROUP BY ALL""",
    fp="""SELECT source, item_id, view, (CASE WHEN p.h >= 9223372036854775808::HUGEINT THEN p.h - 18446744073709551616::HUGEINT ELSE p.h END)::BIGINT AS h1,
 (CASE WHEN d.h >= 9223372036854775808::HUGEINT THEN d.h - 18446744073709551616::HUGEINT ELSE d.h END)::BIGINT AS h2
 FROM hash1 p JOIN hash2 d USING (source, item_id, view)""",
    dist="""SELECT a.source AS source_a, b.source AS source_b, a.item_id AS ia, b.item_id AS ib, min(bit_count(xor(a.h1, b.h1))) AS d1,
 min(bit_count(xor(a.h2, b.h2))) AS d2 FROM fp a JOIN fp b ON b.view = 0 AND a.source < b.source GROUP BY ALL""",
    exact="""SELECT a.source AS source_a, b.source AS source_b, count(DISTINCT a.k) AS exact_duplicates FROM
 (SELECT source, md5(content) AS k FROM grey_items) a JOIN (SELECT source, md5(content) AS k FROM grey_items) b ON a.k = b.k AND a.source < b.source GROUP BY ALL""")


def fsql(body):
    return sql(body, **FPC)


def prints(s, d):
    return D.fingerprints(D.exact_key(V.grey_items(s, d), "content").drop("content"))


def docs(s, d):
    return D.exact_key(table(s, d, "documents").select("source", F.col("doc_id").alias("item_id"), "text"), "text").drop("text")


Q["d01_exact_key"] = (docs, "SELECT source, doc_id AS item_id, md5(text) AS key FROM documents")
Q["d02_exact_overlap"] = (
    lambda s, d: D.exact_overlap(docs(s, d)),
    """SELECT a.source AS source_a, b.source AS source_b, count(DISTINCT md5(a.text)) AS exact_duplicates FROM documents a
 JOIN documents b ON a.text = b.text AND a.source < b.source GROUP BY ALL""")
Q["d03_fingerprints"] = (
    lambda s, d: prints(s, d).select("source", "item_id", F.col("h1")[0].alias("h1"), F.col("h2")[0].alias("h2")),
    fsql("SELECT source, item_id, h1, h2 FROM fp WHERE view = 0"))
Q["d04_fingerprint_views"] = (
    lambda s, d: prints(s, d).select("source", "item_id", F.posexplode(F.arrays_zip("h1", "h2")).alias("view", "h"))
    .select("source", "item_id", "view", "h.h1", "h.h2"),
    fsql("SELECT source, item_id, view, h1, h2 FROM fp"))

SP = "[ \\t\\r\\n]+"
VOTES = ", ".join(f"sum((h >> {b}) & 1) AS c{b}" for b in range(64))
BITS = " + ".join(f"CASE WHEN 2 * c{b} > n THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))
TXT = dict(
    step1="SELECT source, doc_id AS item_id, coalesce(text, '') AS t0, lower(coalesce(text, '')) AS t1 FROM documents",
    step2="SELECT *, array_to_string(list_sort(string_split(t1, chr(10))), chr(10)) AS t2 FROM step1",
    step3=f"SELECT *, trim(regexp_replace(t2, '{SP}', ' ', 'g'), ' ') AS t3 FROM step2",
    step4="SELECT *, trim(regexp_replace(regexp_replace(t3, '[^\\p{L}\\p{N} ]', '', 'g'), ' +', ' ', 'g'), ' ') AS t4 FROM step3",
    tview="SELECT source, item_id, unnest([0, 1, 2, 3, 4]) AS view, unnest([t0, t1, t2, t3, t4]) AS t FROM step4",
    tpart=f"""SELECT source, item_id, view, kind, k, len(ws) AS m, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
 SELECT source, item_id, view, 1 AS kind, 3 AS k, list_filter(regexp_split_to_array(t, '{SP}'), lambda w : w <> '') AS ws FROM tview
 UNION ALL SELECT source, item_id, view, 2, 5, list_filter(string_split(t, ''), lambda w : w <> '') FROM tview)""",
    tgram="""SELECT source, item_id, view, kind, CASE kind WHEN 1 THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o)
 ELSE concat(w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS g FROM tpart
 WINDOW o AS (PARTITION BY source, item_id, view, kind ORDER BY i) QUALIFY i <= greatest(m - k, 0)""",
    tvote=f"""SELECT source, item_id, view, kind, count(*) AS n, {VOTES} FROM (SELECT *, ('0x' || substr(md5(g), 1, 16))::UBIGINT AS h FROM tgram) GROUP BY ALL""",
    tprint=f"SELECT source, item_id, view, kind, {BITS} AS h FROM tvote",
    tfp="""SELECT v.source, v.item_id, v.view, (CASE WHEN a.h >= 9223372036854775808::HUGEINT THEN a.h - 18446744073709551616::HUGEINT ELSE coalesce(a.h, 0) END)::BIGINT AS h1,
 (CASE WHEN b.h >= 9223372036854775808::HUGEINT THEN b.h - 18446744073709551616::HUGEINT ELSE coalesce(b.h, 0) END)::BIGINT AS h2 FROM tview v
 LEFT JOIN tprint a ON a.source = v.source AND a.item_id = v.item_id AND a.view = v.view AND a.kind = 1
 LEFT JOIN tprint b ON b.source = v.source AND b.item_id = v.item_id AND b.view = v.view AND b.kind = 2""")


def tsql(body):
    return sql(body, **TXT)


def text_prints(s, d, **kw):
    return text_fingerprints(table(s, d, "documents").select("source", F.col("doc_id").alias("item_id"), "text"), ["source", "item_id"], **kw)


Q["d03_text_fingerprints"] = (
    lambda s, d: text_prints(s, d, views=("as it is",)).select("source", "item_id", F.col("h1")[0].alias("h1"), F.col("h2")[0].alias("h2")),
    tsql("SELECT source, item_id, h1, h2 FROM tfp WHERE view = 0"))
Q["d04_text_views"] = (
    lambda s, d: text_prints(s, d).select("source", "item_id", F.posexplode(F.arrays_zip("h1", "h2")).alias("view", "h"))
    .select("source", "item_id", "view", "h.h1", "h.h2"),
    tsql("SELECT source, item_id, view, h1, h2 FROM tfp"))
Q["d05_hamming"] = (
    lambda s, d: prints(s, d).select("source", "item_id", *[
        F.bit_count(F.col("h1")[0].bitwiseXOR(F.col("h1")[k])).alias(f"d{k}") for k in range(1, 8)]),
    fsql("SELECT a.source, a.item_id, " + ", ".join(
        f"max(bit_count(xor(a.h1, b.h1))) FILTER (b.view = {k})::INT AS d{k}" for k in range(1, 8)) +
        " FROM fp a JOIN fp b ON a.view = 0 AND a.source = b.source AND a.item_id = b.item_id GROUP BY ALL"))
Q["d06_near_duplicates"] = (
    lambda s, d: D.near_duplicates(prints(s, d)),
    fsql("SELECT source_a, source_b, count(*) AS near_duplicates FROM dist WHERE d1 <= 6 AND d2 <= 10 GROUP BY ALL"))
Q["d07_min_distance"] = (
    lambda s, d: D.min_distance(prints(s, d)),
    fsql("SELECT source_a, source_b, min(d1)::INT AS min_distance FROM dist GROUP BY ALL"))
Q["d08_leak_audit"] = (
    lambda s, d: D.leak_audit(prints(s, d), ["copy0", "copy1"]),
    fsql("""SELECT source_a, source_b, n_a, n_b, coalesce(exact_duplicates, 0) AS exact_duplicates, near_duplicates, min_distance,
 CASE WHEN source_a = 'copy0' AND source_b = 'copy1' THEN 'format dominates the hash' ELSE '' END AS note FROM (SELECT source_a, source_b,
 count(DISTINCT ia) AS n_a, count(DISTINCT ib) AS n_b, count(*) FILTER (d1 <= 6 AND d2 <= 10) AS near_duplicates, min(d1)::INT AS min_distance
 FROM dist GROUP BY ALL) LEFT JOIN exact USING (source_a, source_b)"""))

EV = dict(
    cnt="SELECT cls, item_id, code, count(*) AS w FROM doc_features GROUP BY ALL",
    own="""SELECT cls, item_id, string_agg(code || ':' || w, ',' ORDER BY code || ':' || w) AS digest, count(*) AS n, sum(w * w) AS norm
 FROM cnt GROUP BY ALL""",
    mem="SELECT *, min(item_id) OVER (PARTITION BY cls, digest) AS content, count(*) OVER (PARTITION BY cls, digest) AS copies FROM own",
    feat="SELECT c.cls, c.item_id AS content, code, w, n, norm, copies FROM cnt c JOIN mem m ON c.item_id = m.item_id AND m.item_id = m.content",
    evid="""SELECT a.cls, a.content AS a, b.content AS b, max(a.copies) AS copies_a, max(b.copies) AS copies_b, count(*) AS matches,
 count(*) / greatest(max(a.n), max(b.n)) AS overlap, sum(a.w * b.w) / sqrt(max(a.norm)::DOUBLE * max(b.norm)) AS similarity
 FROM feat a JOIN feat b ON a.cls = b.cls AND a.code = b.code AND a.content < b.content GROUP BY ALL""",
    acc=f"SELECT * FROM evid WHERE matches >= {MM} AND overlap >= {MO} AND similarity > {MS}",
    edge=f"""SELECT a, b FROM acc UNION SELECT b, a FROM acc UNION SELECT content, item_id FROM mem WHERE n >= {MM} AND content <> item_id
 UNION SELECT item_id, content FROM mem WHERE n >= {MM} AND content <> item_id""",
    reach="SELECT item_id AS node, item_id AS seen FROM mem UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.seen",
    grp="SELECT node AS item_id, min(seen) AS group_id FROM reach GROUP BY ALL")


def esql(body):
    return sql(body, recursive=True, **EV)


def cand(s, d):
    feats, _ = D.feature_sets(V.doc_features(s, d))
    e = D.pair_evidence(feats, D.pairs_within(feats, MM, MO))
    return e.filter((F.col("matches") >= MM) & (F.col("overlap") >= MO)).select("cls", "a", "b", "matches")


def groups(s, d):
    return D.overlap_groups(V.doc_features(s, d), MM, MO, MS)


def labelled(s, d):
    return groups(s, d).join(table(s, d, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("y")), "item_id")


Q["d09_pairs_within"] = (cand, esql(f"SELECT cls, a, b, matches FROM evid WHERE matches >= {MM} AND overlap >= {MO}"))
Q["d10_pair_evidence"] = (
    lambda s, d: rounded(D.accepted_pairs(V.doc_features(s, d), MM, MO, MS)),
    esql("SELECT cls, a, b, copies_a, copies_b, matches, round(overlap, 6) AS overlap, round(similarity, 6) AS similarity FROM acc"))
Q["d11_connected_components"] = (groups, esql("SELECT cls, item_id, group_id FROM grp JOIN mem USING (item_id)"))
LAB = "(SELECT item_id, group_id, quality AS y FROM grp JOIN labels ON doc_id = item_id)"
PER = f"SELECT group_id, y, count(*) AS n FROM {LAB} GROUP BY ALL"
REP = """count(*) AS groups, count(*) FILTER (n > 1) AS repeated_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS items_in_repeats, max(n)::BIGINT AS largest"""
Q["d12_group_report"] = (
    lambda s, d: D.group_report(labelled(s, d)),
    esql(f"""SELECT 'all' AS part, sum(n)::BIGINT AS items, {REP} FROM (SELECT group_id, sum(n) AS n FROM ({PER}) GROUP BY ALL)
 UNION ALL SELECT y::VARCHAR, sum(n)::BIGINT, {REP} FROM ({PER}) GROUP BY y"""))


def crossing(s, d):
    """One class for all, so that pairs, and so groups, may cross the labels."""
    g = D.overlap_groups(V.doc_features(s, d).withColumn("cls", F.lit("all")), MM, MO, MS)
    return g.join(table(s, d, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("y")), "item_id")


ALL1 = dict(EV, cnt="SELECT 'all' AS cls, item_id, code, count(*) AS w FROM doc_features GROUP BY ALL")
Q["d13_mixed_groups"] = (
    lambda s, d: D.mixed_groups(crossing(s, d)),
    sql(f"SELECT group_id, count(*) AS items, count(DISTINCT y) AS labels FROM {LAB} GROUP BY ALL HAVING count(DISTINCT y) > 1", recursive=True, **ALL1))
Q["d13_mixed_units"] = (
    lambda s, d: D.mixed_groups(table(s, d, "orders").select(F.col("o_custkey").alias("group_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))),
    """SELECT o_custkey AS group_id, count(*) AS items, count(DISTINCT o_orderstatus = 'F') AS labels FROM orders GROUP BY ALL
 HAVING count(DISTINCT o_orderstatus = 'F') > 1""")


def units_of(s, d):
    m = V.features(s, d).filter("f2 > 2").select("item_id", F.concat(F.lit("c"), F.col("y").cast("string")).alias("class_name"),
                                                  F.col("unit").alias("group_id"))
    return D.attach_units(V.features(s, d).select("item_id", "y"), m)


Q["d14_attach_units"] = (
    units_of, sql("""SELECT item_id, y, CASE WHEN f2 > 2 THEN 'c' || y || '_' || unit ELSE 'solo_' || item_id END AS unit FROM features"""))
Q["d15_contiguous_blocks"] = (
    lambda s, d: D.contiguous_blocks(V.items(s, d), ["subtype"], ["item_id"], 89).select("subtype", "item_id", "block"),
    sql("SELECT subtype, item_id, ntile(89) OVER (PARTITION BY subtype ORDER BY item_id) - 1 AS block FROM items"))
