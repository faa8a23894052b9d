"""Secret scan: candidate strings judged by a random forest, in DataFrame operations only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import plain

CANDIDATE = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*[0-9])[A-Za-z0-9+/_.-]{16,}={0,2}"
# Words that make up identifiers, and words beside a finding that speak for or against it.
DICTIONARY = ("account access api app auth base build cache class client code com config data date default demo dev file get html http https id image index "
              "info json key lib list local log main name node num org page path php post prod public query read request response sample server set src "
              "static string sub test text time token type update user util value version view web www xml").split()
FOR = "token secret passwd password pwd apikey api_key api-key auth authorization bearer credential credentials private access_key signature"
AGAINST = "commit sha sha1 sha256 md5 hash checksum digest uuid guid revision version build etag example sample isbn issn order invoice phone card doi"
FEATURES = ["length", "digits", "upper", "lower", "signs", "switches", "variety", "hex_only", "vowels", "coverage", "path", "dots", "assigned", "quoted", "for_words",
            "against_words"]


def _share(pattern: str) -> Column:
    return F.regexp_count(F.col("token"), F.lit(pattern)) / F.length("token")


def features(found: DataFrame) -> DataFrame:
    """Features of (token, word, before, after): length, letter classes and changes between them, dictionary coverage,
    path, and neighbouring words."""
    near = F.lower(F.concat_ws(" ", "before", F.col("word")))
    words = lambda names: F.when(near.rlike(r"(?:^|[^a-z0-9])(?:" + "|".join(names.split()) + r")(?:$|[^a-z0-9])"), 1.0).otherwise(0.0)
    bare = F.regexp_replace(F.lower("token"), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")
    yes = lambda c: c.cast("double")
    return found.withColumns({
        "length": F.log2(F.length("token").cast("double")), "digits": _share("[0-9]"), "upper": _share("[A-Z]"), "lower": _share("[a-z]"),
        "signs": _share("[+/_=.-]"), "vowels": _share("[aeiouAEIOU]"),
        "switches": _share("[0-9](?=[A-Za-z])") + _share("[A-Za-z](?=[0-9])") + _share("[a-z](?=[A-Z])"),
        "variety": F.size(F.array_distinct(F.split("token", ""))) / F.least(F.length("token"), F.lit(64)),
        "hex_only": yes(F.col("token").rlike("^[0-9a-fA-F]+$")), "coverage": 1.0 - F.length(bare) / F.length("token"),
        "path": yes(F.col("word").rlike(r"://|^\.{0,2}/|[A-Za-z]/[A-Za-z]+/|\.(?:com|org|net|html?|php|js|css|png|jpg|py|md|txt|json)\b")), "dots": _share("[.]"),
        "assigned": yes(F.concat_ws("", "before", "word").rlike("[=:]")), "quoted": yes(F.col("word").rlike("[\"'`]")),
        "for_words": words(FOR), "against_words": words(AGAINST)})


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word_no, token, word, before, after): every run of 16 or more letters, digits and + / _ . - that holds a
    digit (with up to two = at its end), with the word it stands in and the three words before and one after it. Texts without one are left at the
    scan; of the others only the words around candidates leave it."""
    base = plain(docs, doc_id=id_col, text=text_col).filter(F.col("text").rlike(CANDIDATE)).select("doc_id", F.split("text", r"[\x20\x09-\x0D]+").alias("words"))
    pad = F.array(F.lit(""))

    def back(k: int) -> Column:
        return F.concat(F.array_repeat(F.lit(""), k), F.col("words"))

    rows = F.arrays_zip(F.col("words").alias("word"), back(3).alias("b3"), back(2).alias("b2"), back(1).alias("b1"),
                        F.concat(F.slice("words", F.lit(2), F.size("words")), pad).alias("after"),
                        F.sequence(F.lit(0), F.size("words") - 1).alias("word_no"))
    hit = base.select("doc_id", F.inline(F.filter(rows, lambda r: r["word"].rlike(CANDIDATE))))
    return hit.select("doc_id", "word_no", F.explode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("token"), "word",
                      F.concat_ws(" ", "b3", "b2", "b1").alias("before"), "after")


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled findings to learn from: n strings of known kind in known surroundings, drawn by hashes. Keys and tokens
    in random letters stand beside words of their kind; the rest are digests, numbers, paths, identifiers and
    placeholders, some of them in the surroundings of keys."""
    r = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256)
    pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(values))).cast("int") + 1)
    cut = lambda text, k, lengths: F.substring(text, F.lit(1), pick(k, lengths))
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(r(1), r(2)))), "[+/=]", pick(9, ["", "_", "-"]))
    key_words = ["token =", "secret:", "password =", "api_key =", "auth:", "Bearer", "private key", "access_key ="]
    other_words = ["commit", "sha1:", "md5 =", "checksum", "version", "order", "see", "the", "card", "id =", "from", "uuid:"]
    kind = lambda label, token, before: F.struct(F.lit(label).alias("label"), token.alias("token"), before.alias("before"))
    kinds = F.array(
        kind(1, cut(r(3), 1, [32, 40, 64]), pick(2, key_words)),
        kind(1, cut(mixed, 3, [20, 24, 36, 40, 64]), pick(4, key_words)),
        kind(1, F.concat(pick(5, ["ghp_", "sk-", "AKIA", "xoxb-"]), cut(mixed, 6, [16, 24, 36])), pick(7, key_words + ["the", "use", ""])),
        kind(0, cut(r(4), 1, [32, 40, 64]), pick(8, other_words)),
        kind(0, cut(F.translate(r(5), "abcdef", "123456"), 1, [16, 18]), pick(10, other_words + ["", "", ""])),
        kind(0, F.concat_ws("/", F.lit(""), pick(11, DICTIONARY), pick(12, DICTIONARY), F.concat(pick(13, DICTIONARY), F.lit("2.html"))), pick(14, other_words)),
        kind(0, F.concat_ws("_", pick(15, DICTIONARY), pick(16, DICTIONARY), pick(17, DICTIONARY), F.lit("01")), pick(18, other_words + key_words)),
        kind(0, F.concat(pick(19, ["XXXX", "0000", "1234"]), F.repeat(pick(20, ["x0", "00", "1x"]), 8)), pick(21, key_words)),
        kind(0, F.concat_ws("-", *[F.substring(r(6), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), pick(22, other_words)))
    rows = spark.range(n).select("id", F.element_at(kinds, F.pmod("id", F.lit(9)).cast("int") + 1).alias("k")).select("id", "k.*")
    quote = pick(23, ["\"", "'", ""])
    return rows.filter(F.length("token") >= 16).select(F.col("label").cast("double").alias("label"), "token",
                                                       F.concat(quote, "token", quote).alias("word"), "before", F.lit("").alias("after"))


def train(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel:
    """The forest over a bounded table of labelled findings (label, token, word, before, after)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(findings)).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows.coalesce(1))


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """(doc_id, word_no, token, before, score, is_secret): every candidate with the forest's score. Map-only.

    NULL and empty texts have no candidates; repeated rows are scanned each; a NULL id stays NULL. Words of any length
    are searched whole. Other columns are not read."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs, id_col, text_col)))
    return model.transform(rows).select(
        "doc_id", F.col("word_no").cast("bigint").alias("word_no"), "token", "before",
        vector_to_array("probability")[1].alias("score")).withColumn("is_secret", F.col("score") >= at_least)
