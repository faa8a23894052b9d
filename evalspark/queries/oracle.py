"""SQL text of the same views, for the side-by-side check."""

from __future__ import annotations

import re

from evalspark.sources.views import ARM_WEIGHTS, GAUGES, SEEDS, SWAP


def U(*parts: str) -> str:
    """The md5 uniform of evalspark.functions.columns.uniform."""
    text = f"concat_ws(':', {', '.join(parts)})"
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def normal(*parts: str) -> str:
    return (f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {U(*parts, chr(39) + 'a' + chr(39))}))"
            f" * cos(6.283185307179586::DOUBLE * {U(*parts, chr(39) + 'b' + chr(39))}))")


def grain(x: str) -> str:
    return f"(floor(({x}) * 1000.0::DOUBLE) / 1000.0::DOUBLE)"


def bin_sql(p: str, bins: int = 10) -> str:
    step = 1.0 / bins
    return "(" + " + ".join(f"({p} >= {k * step!r}::DOUBLE)::INT" for k in range(1, bins)) + ")"


LI = "l_orderkey, l_linenumber, l_partkey, l_suppkey".split(", ")


def _k(s: str) -> str:
    return U(*LI, f"'{s}'")


VIEWS = {
    "items": """
 SELECT CASE o_orderkey % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'testa' ELSE 'testb' END AS cohort, o_orderkey AS item_id,
  (o_orderstatus = 'F')::INT AS y, o_custkey || '_' || (o_orderstatus = 'F')::INT AS unit,
  CASE WHEN o_orderstatus = 'F' THEN 'sub' || (o_custkey % 3) ELSE 'base' END AS subtype FROM orders""",
    "arm_weight": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {w}::DOUBLE)" for a, w in ARM_WEIGHTS.items())
                  + ") t(arm, w)",
    "seed_list": "SELECT * FROM (VALUES " + ", ".join(f"({s})" for s in SEEDS) + ") t(seed)",
    "prediction": f"""
 SELECT cohort, arm, seed, item_id, unit, subtype, y,
  {grain("0.5::DOUBLE * k * y + u * (1.0::DOUBLE - 0.5::DOUBLE * k)")} AS p
 FROM (SELECT *, w + 0.05::DOUBLE * seed AS k, {U("item_id", "arm", "seed")} AS u
       FROM items, arm_weight, seed_list)""",
    "swap_scores": f"""
 SELECT p.* REPLACE ({grain("p * (1.0::DOUBLE - s) + s * " + U("item_id", "arm", "seed", "condition"))} AS p), condition
 FROM prediction p, (VALUES {", ".join(f"('{c}', {s}::DOUBLE)" for c, s in SWAP.items())}) t(condition, s)""",
    "instance": f"""
 SELECT l_orderkey AS item_id, (l_linenumber::BIGINT * 1000000 + l_partkey) * 10000 + l_suppkey AS inst_id,
  floor({_k("x")} * 200)::DOUBLE AS x, floor({_k("y")} * 200)::DOUBLE AS y, l_quantity AS r,
  {grain(_k("p"))} AS p, l_discount < 0.05::DOUBLE AS keep FROM lineitem""",
    "instance_runs": f"""
 SELECT item_id, inst_id, r, arm, seed, scale, {grain("0.5::DOUBLE * p + 0.5::DOUBLE * " + U("item_id", "inst_id", "arm", "seed", "scale"))} AS p
 FROM instance, (VALUES ('full'), ('plain')) a(arm), seed_list, (VALUES (0), (1)) s(scale)""",
    "box": f"""
 SELECT CASE WHEN l_suppkey % 17 <> 0 THEN 'fields/' || file_name END AS image_path, * EXCLUDE (l_suppkey) FROM (
 SELECT l_suppkey, (l_suppkey % 20) || '_' || l_suppkey || '_1000_' ||
    CASE l_suppkey % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'CLL' ELSE 'AML' END || '.png' AS file_name,
  (l_suppkey % 20)::VARCHAR AS slide, l_suppkey::VARCHAR AS image,
  CASE l_suppkey % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'CLL' ELSE 'AML' END AS leukemia_type,
  CASE WHEN l_returnflag = 'A' THEN 'lymph' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'mono'
   WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'none' ELSE 'blast' END AS category,
  8.0::DOUBLE * floor({_k("x")} * 77) AS x, 8.0::DOUBLE * floor({_k("y")} * 77) AS y,
  CASE WHEN {_k("ws")} < 0.02::DOUBLE THEN 4.0::DOUBLE ELSE 16.0::DOUBLE + 8.0::DOUBLE * floor({_k("w")} * 4) END AS w,
  CASE WHEN {_k("hs")} < 0.02::DOUBLE THEN 4.0::DOUBLE ELSE 16.0::DOUBLE + 8.0::DOUBLE * floor({_k("h")} * 4) END AS h,
  640 AS img_w, 640 AS img_h, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS annotation_id,
  CASE WHEN l_orderkey % 2 = 0 THEN 'a.json' ELSE 'b.json' END AS source_json FROM lineitem)""",
    "features": """
 SELECT d.doc_id AS item_id, l.quality AS y, d.source AS unit, d.lang AS subtype,
  ln(1.0::DOUBLE + d.n_chars) AS f1, (length(d.text) - length(replace(d.text, chr(10), '')))::DOUBLE AS f2,
  (length(d.text) - length(translate(d.text, '0123456789', '')))::DOUBLE / d.n_chars::DOUBLE AS f3
 FROM documents d JOIN labels l USING (doc_id)""",
    "vector": """
 SELECT item_id, label, pos, CASE WHEN pos < 32 THEN 'a' ELSE 'b' END AS region, pos % 4 AS channel, value FROM (
  SELECT vec_id AS item_id, label, unnest(range(64))::INT AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings)
""",
    "heat_grid": """
 SELECT item_id, pos // 8 AS row, pos % 8 AS col, greatest(value * 2.0::DOUBLE, 0.0::DOUBLE) AS heat,
  (pos // 8 BETWEEN 2 AND 5 AND pos % 8 BETWEEN 2 AND 5)::INT AS mask, value FROM vector""",
    "grey_items": f"""
 SELECT *, array_to_string(list_transform(grid, lambda v: floor(v * 1000.0::DOUBLE)::BIGINT::VARCHAR), ',') AS content FROM (
 SELECT 's' || label AS source, vec_id::VARCHAR AS item_id, list_transform(embedding, lambda x: x::DOUBLE) AS grid
 FROM embeddings UNION ALL
 SELECT 'copy' || (label % 3), 'c' || vec_id, CASE WHEN {U("vec_id", "'copy'")} < 0.1::DOUBLE THEN
  list_transform(embedding, lambda x: x::DOUBLE) ELSE list_transform(range(64), lambda i: embedding[((i % 8) * 8 + 7 - i // 8 + 1)::INT]::DOUBLE
   * 1.001::DOUBLE) END FROM embeddings WHERE {U("vec_id", "'copy'")} < 0.3::DOUBLE)""",
    "doc_features": """
 SELECT cls, item_id, ('0x' || substr(md5(line), 1, 15))::BIGINT AS code FROM (SELECT lang AS cls, doc_id AS item_id,
  unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''""",
    "train_log": f"""
 SELECT 'cls_' || arm || '_seed' || seed AS run_id, * FROM (
 SELECT (['blend', 'full', 'jitter', 'plain', 'base'])[(user_id % 5 + 1)::INT] AS arm, (user_id // 5)::BIGINT AS seed,
  day(ts)::BIGINT AS epoch, event_id AS arrival, ts, {grain("value / (value + 50.0::DOUBLE)")} AS metric,
  floor({U("event_id", "'loss'")} * 20) / 20.0::DOUBLE AS loss, ({U("event_id", "'best'")} < 0.1::DOUBLE)::INT AS is_best,
  round({U("event_id", "'n'")}, 3) AS neg_score, round({U("event_id", "'q'")}, 3) AS pos_score FROM events)""",
    "resource_sample": f"""
 SELECT 'cls_a' || (user_id % 7) || '_seed' || (user_id // 7) AS run_id, day(ts)::BIGINT AS epoch, ts,
  CASE event_type WHEN 'click' THEN 'train' WHEN 'view' THEN 'val' WHEN 'error' THEN 'train' ELSE 'idle' END AS phase,
  {", ".join(f"CASE WHEN {U('event_id', repr(g))} >= 0.1::DOUBLE THEN floor({U('event_id', repr(g), repr('v'))} * 1000) / 10.0::DOUBLE END AS {g}" for g in GAUGES)},
  180.0::DOUBLE + 10 * (user_id % 7) AS gpu_mem_total_gb, 100.0::DOUBLE AS ram_total_gb, 100.0::DOUBLE AS shm_total_gb, (user_id % 7 + 8)::DOUBLE AS cpu_count,
  floor(value)::BIGINT AS step_ms, floor(value * {U("event_id", "'wait'")})::BIGINT AS wait_ms FROM events""",
    "duration_log": f"""
 SELECT event_type AS stage, 'cell' || user_id AS cell, value AS seconds, CASE WHEN u < 0.7::DOUBLE THEN 'ok'
  WHEN u < 0.85::DOUBLE THEN 'skipped' WHEN u < 0.95::DOUBLE THEN 'failed' ELSE 'interrupted' END AS status
 FROM (SELECT *, {U("event_id", "'status'")} AS u FROM events)""",
}


def add_view(name: str, text: str) -> None:
    VIEWS[name] = text


def sql(body: str, recursive: bool = False, **ctes: str) -> str:
    """Prefix the body with the views it (transitively) names and the query's own CTEs, in dependency order."""
    known = {**VIEWS, **ctes}
    order: list[str] = []
    active: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", re.sub(r"'[^']*'", "", text))):
            if word in known and word not in order and word not in active:
                active.add(word)
                visit(known[word])
                order.append(word)

    visit(body)
    head = ",\n".join(f"{n} AS ({known[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body}" if head else body


def student_tail(t: str, df: str) -> str:
    """P(|T| >= |t|) by Simpson's rule: the tail is an integral of a power of the sine, drawn out near 0, where it is steep."""
    angle = f"atan(sqrt({df}) / abs({t}))"
    return f"""(list_sum(list_transform(range(1, 801), lambda i : (CASE WHEN i = 800 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 3 * {angle} * pow(i / 800.0::DOUBLE, 2)
 * pow(sin({angle} * pow(i / 800.0::DOUBLE, 3)), {df} - 1))) / 2400 / (sqrt(pi()) / 2 * gamma({df} / 2) / gamma({df} / 2 + 0.5::DOUBLE)))"""


def student_quantile(df: str) -> str:
    """The t with a two-sided tail of 0.05, by bisection."""
    mid = "((a.lo + a.hi) / 2)"
    return f"""(list_reduce(list_prepend(struct_pack(lo := 0.0::DOUBLE, hi := 1000.0::DOUBLE), list_transform(range(50), lambda z : struct_pack(lo := 0.0::DOUBLE, hi := 0.0::DOUBLE))),
 lambda a, z : CASE WHEN {student_tail(mid, df)} > 0.05::DOUBLE THEN struct_pack(lo := {mid}, hi := a.hi) ELSE struct_pack(lo := a.lo, hi := {mid}) END).lo)"""


def welch(src: str, keys: str) -> dict[str, str]:
    """Welch's test of the `value`s of side a against side b of a table with the given name, as the table `wp`."""
    return dict(
        wa=f"""SELECT {keys}, avg(value) FILTER (side = 'a') AS mean_a, avg(value) FILTER (side = 'b') AS mean_b, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb,
 var_samp(value) FILTER (side = 'a') / count(*) FILTER (side = 'a') AS va, var_samp(value) FILTER (side = 'b') / count(*) FILTER (side = 'b') AS vb FROM {src} GROUP BY ALL""",
        wt=f"""SELECT {keys}, 'Welch t' AS test, mean_a, mean_b, mean_a - mean_b AS delta, sqrt(va + vb) AS se, (va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)) AS df,
 (mean_a - mean_b) / sqrt(va + vb) AS t FROM wa""",
        wp=f"SELECT *, delta - half AS ci_low, delta + half AS ci_high FROM (SELECT *, {student_tail('t', 'df')} AS p, {student_quantile('df')} * se AS half FROM wt)")


WELCH = ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_a", "mean_b", "delta", "df", "t", "ci_low", "ci_high", "p"))
