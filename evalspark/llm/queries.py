"""One query per operator, with production parameters over whole tables, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm.bpe import encode_documents
from evalspark.llm.collocations import collocations
from evalspark.llm.exact_dedup import exact_dedup
from evalspark.llm.html_text import extract
from evalspark.llm.language import held_out, identify, train
from evalspark.llm.line_dedup import line_dedup
from evalspark.llm.mixing import mix
from evalspark.llm.neighbours import nearest
from evalspark.llm.ngram_join import ngram_groups
from evalspark.llm.prefix_trie import branched, prefix_trie, turns_of
from evalspark.llm.repeats import remove_repeats
from evalspark.llm.secrets import labelled_findings, scan
from evalspark.llm.secrets import train as train_forest
from evalspark.llm.token_counts import count_tokens
from evalspark.sources.tables import table

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        Q[name] = (fn, sql)
        return fn
    return put


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"), word_vocabulary(), digests_only=True)


@query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"), keep="largest")


@query("op8_mixing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


@query("op1_neighbours")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), query_step=20, k=20)


@query("op4_language")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    told = identify(docs.select("doc_id", "text"), train(docs))
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op2_ngram_join", """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x : x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
             ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i : ws[i:i + 2])) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
f AS (SELECT g, count(*) AS df FROM u GROUP BY g HAVING df > 1),
r AS (SELECT u.*, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(df, 1), g) AS place, df FROM u LEFT JOIN f USING (g)),
p AS (SELECT * FROM r WHERE place <= n - (9 * n + 9) // 10 + 1 AND df > 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id),
l AS (SELECT c.a, c.b FROM c JOIN u x ON x.doc_id = c.a JOIN u y ON y.doc_id = c.b AND y.g = x.g
      GROUP BY c.a, c.b, c.na, c.nb HAVING 190 * count(*) >= 90 * (c.na + c.nb)),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
t(x, y) AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM s LEFT JOIN (SELECT x, min(y) AS m FROM t GROUP BY x) ON x = doc_id""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_groups(table(spark, folder, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query("op6_html_text")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


@query("op9_line_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(table(spark, folder, "documents"))


@query("op10_secrets")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"), train_forest(labelled_findings(spark)))


@query("op3_repeats")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), span=400).drop("kept")


@query("op11_collocations", """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x : x <> '') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i : array_to_string(ws[i:i + m - 1], ' '))) AS phrase
      FROM w, range(1, 6) AS r(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 100),
d AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c b ON b.lang = s.lang AND b.m > s.m AND b.f >= s.f
      AND contains(concat(' ', b.phrase, ' '), concat(' ', s.phrase, ' '))),
k AS (SELECT c.*, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y
      FROM c ANTI JOIN d USING (lang, phrase), range(1, 5) AS r(k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, k.f AS a, x.f AS l, y.f AS r, n, k, 1000::HUGEINT * k.f * n // (x.f::HUGEINT * y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score FROM b QUALIFY rank <= 2000""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


@query("op12_prefix_trie", """
WITH t AS (SELECT conv_id, list(md5(concat(len(r), ':', r, x)) ORDER BY turn NULLS FIRST, md5(concat(len(r), ':', r, x))) AS ds,
           list(len(x) ORDER BY turn NULLS FIRST, md5(concat(len(r), ':', r, x))) AS ns
           FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
c AS (SELECT *, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda l : CAST(ascii(l) AS BIGINT))), lambda a, b : list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda p, z : xor(p >> 1, 3988292384 * (p & 1)))), 4294967295) % 6 AS h FROM t),
f AS (SELECT c.conv_id, list_concat(coalesce(b.ds[1:c.h], []), c.ds[c.h + 1:]) AS ds, list_concat(coalesce(b.ns[1:c.h], []), c.ns[c.h + 1:]) AS ns
      FROM c LEFT JOIN t b ON b.conv_id = c.base),
p AS (SELECT conv_id, ds, ns, unnest(range(0, len(ds) + 1)) AS depth FROM f),
n AS (SELECT depth, array_to_string(ds[1:depth], '') AS k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE ns[depth] END) AS own,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ds) = depth), '')) AS ends_sha256 FROM p GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, substr(k, 1, 32 * (depth - 1)) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, k)),
s AS (SELECT d AS depth, substr(k, 1, 32 * d) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * own) AS saved_tokens
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, k) LEFT JOIN n q ON q.depth = m.depth - 1 AND q.k = substr(m.k, 1, 32 * (m.depth - 1))""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(branched(turns_of(table(spark, folder, "conversations"))))


@query("op13_token_counts")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), byte_vocabulary())
