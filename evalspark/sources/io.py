"""Scans and sinks: prediction files, annotation documents, labelled folders, append-only logs, results."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.columns import nan_to_null
from evalspark.operators.curate import canonical_groups
from evalspark.plans.groups import join_groups

# fixed name format
FIELD_NAME = r"^(\d+)_(\d+)_(\d+)(?:_([A-Za-z]+))?\.[a-z]+$"

PREDICTION = "y_true array<int>, probs array<array<double>>, names array<string>, y_pred array<int>, threshold double, " \
             "inference string, cell_probs array<array<double>>"
ANNOTATION = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, categories array<struct<id:bigint,name:string>>, " \
             "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>"


def _must(value: Column, ok: Column, message: str, dtype) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(dtype))


def _run_key(path: Column) -> dict[str, Column]:
    """arm, seed and cohort from the file or folder named cls_ARM_seedN_COHORT or cls_ARM_seedN_test_COHORT, with or
    without .json; every part but the seed may hold underscores. All empty for other paths."""
    named = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "^[a-z]+=", ""))  # as partition folders are
    inside = F.filter(named, lambda x: x.startswith("cls_") & x.contains("_seed"))
    run = F.regexp_replace(F.coalesce(F.get(inside, F.size(inside) - 1), F.lit("")), r"\.json$", "")
    arm = F.substring(F.substring_index(run, "_seed", 1), 5, 1000)
    rest = F.substring_index(run, "_seed", -1)
    seed = F.substring_index(rest, "_", 1)
    cohort = F.regexp_replace(F.substring(rest, F.length(seed) + 2, F.length(rest)), "^test_", "")
    known = seed.rlike("^[0-9]+$")
    return {"arm": F.when(known, arm).otherwise(""), "seed": F.when(known, seed), "cohort": F.when(known, cohort).otherwise("")}


def run_paths(spark: SparkSession, path: str, cohorts: Sequence[str] | None = None, arms: Sequence[str] | None = None,
              seeds: Sequence[int] | None = None) -> list[str]:
    """Files and folders under `path` (or one folder below it) whose name is that of a wanted run; None wants all."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    base = path.rstrip("/")
    files = at(base).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f"{front}cls_{arm}_seed{seed}_{test}{cohort}{end}" for arm in arms or ["*"] for seed in seeds or ["*"] for cohort in cohorts or ["*"]
             for front in ("", "*=") for test in ("", "test_") for end in ("", ".json")]
    found = {s.getPath().toString() for n in names for depth in ("", "*/") for s in files.globStatus(at(f"{base}/{depth}{n}")) or []}
    return sorted(found)


def read_predictions(spark: SparkSession, path: str, cohorts: Sequence[str] | None = None, arms: Sequence[str] | None = None,
                     seeds: Sequence[int] | None = None) -> DataFrame:
    """One row per (run, item) from prediction files of parallel arrays; the run key comes from the file name. A run
    may be spread over several files or lines. With wanted cohorts, arms or seeds only the files of those runs are listed
    and opened; without such files the result is empty."""
    name = F.input_file_name()
    wanted = {"cohort": cohorts, "arm": arms, "seed": seeds}
    places = path if not any(wanted.values()) else run_paths(spark, path, cohorts, arms, seeds)
    d = spark.read.schema(PREDICTION).option("recursiveFileLookup", "true").json(places) if places else spark.createDataFrame([], PREDICTION)
    d = d.withColumns(_run_key(name)).filter("arm <> '' and cohort <> ''")
    for key, values in wanted.items():  # a pattern may match more than the run, as names hold underscores
        d = d.filter(F.col(key).isin(*map(str, values))) if values else d
    same = (F.size("y_true") == F.size("probs")) & (F.size("probs") == F.size("names"))
    d = d.withColumn("y_true", _must(F.col("y_true"), same, "parallel arrays differ in length", "array<int>"))
    e = d.select("cohort", "arm", F.col("seed").cast("int").alias("seed"), "inference",
                 F.explode(F.arrays_zip("names", "y_true", "probs", F.coalesce("cell_probs", F.array().cast("array<array<double>>"))
                                        .alias("cells"))).alias("r"))
    return e.select("cohort", "arm", "seed", F.col("r.names").alias("item_id"), F.col("r.y_true").alias("y"),
                    nan_to_null(F.col("r.probs")[1]).alias("p"), "inference", F.col("r.cells").alias("instance_p"))


def read_annotations(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Box table of annotation documents. Image entries may repeat; ids are unique per source document name."""
    d = spark.read.schema(ANNOTATION).option("multiLine", str(multiline).lower()).option("recursiveFileLookup", "true").json(path)
    source = F.regexp_extract(F.input_file_name(), r"([^/=]+\.json)(?:/[^/]*)?$", 1)
    d = d.withColumn("source_json", source)
    images = d.select("source_json", F.explode("images").alias("i")).select(
        "source_json", F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"), F.col("i.width").alias("img_w"),
        F.col("i.height").alias("img_h")).dropDuplicates(["source_json", "image_id"])
    cats = d.select("source_json", F.explode("categories").alias("c")).select(
        "source_json", F.col("c.id").alias("category_id"), F.col("c.name").alias("category")).distinct()
    a = d.select("source_json", F.explode("annotations").alias("a")).select(
        "source_json", F.col("a.id").alias("annotation_id"), F.col("a.image_id").alias("image_id"),
        F.col("a.category_id").alias("category_id"), *[F.col("a.bbox")[i].alias(c) for i, c in enumerate("xywh")])
    b = a.join(images, ["source_json", "image_id"]).join(cats, ["source_json", "category_id"])
    part = {n: F.regexp_extract("file_name", FIELD_NAME, i) for i, n in ((1, "slide"), (2, "image"), (4, "leukemia_type"))}
    b = b.withColumns(part)
    b = b.withColumn("slide", _must(F.col("slide"), F.col("slide") != "", "cannot parse slide and image from the file name", "string"))
    return b.select("file_name", "slide", "image", "leukemia_type", "category", "x", "y", "w", "h", "img_w", "img_h",
                    "annotation_id", "source_json")


def scan_labelled(spark: SparkSession, roots: Sequence[str], classes: Sequence[str],
                  extensions: Sequence[str] = ("png", "jpg", "bmp", "tif")) -> DataFrame:
    """Files under <root>/<class>/, label from the class position; resource forks and other extensions are skipped, a
    class without files is an error. File contents are not read."""
    glob = "{" + ",".join(f"*.{e}" for e in extensions) + "}"
    parts = []
    for root in roots:
        for label, name in enumerate(classes):
            f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{root}/{name}")
            f = f.select("path", "length", "modificationTime", F.lit(root).alias("root"), F.lit(name).alias("class_name"),
                         F.lit(label).alias("label"), F.regexp_extract("path", r"([^/]+)$", 1).alias("item_id"))
            parts.append(f.filter(~F.col("item_id").startswith("._")))
    d = reduce(DataFrame.unionByName, parts)
    found = d.groupBy("class_name").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("k")).select("k").scalar()
    return d.withColumn("label", _must(F.col("label"), found == len(classes), "a class has no files", "int"))


def map_labels(df: DataFrame, rules: Sequence[tuple[str, str, str]], source: str = "source", stem: str = "stem") -> DataFrame:
    """Class and output name of every file: rules are (source, class, name prefix), a source without a rule is dropped;
    a stem ending in _1 is positive whatever its source rule says when the rule's class is '*'."""
    table = {s: (c, p) for s, c, p in rules}
    cls = F.create_map(*[x for s, (c, _) in table.items() for x in (F.lit(s), F.lit(c))])[F.col(source)]
    prefix = F.create_map(*[x for s, (_, p) in table.items() for x in (F.lit(s), F.lit(p))])[F.col(source)]
    d = df.filter(F.col(source).isin(*table))
    by_suffix = F.when(F.col(stem).endswith("_1"), "ALL").otherwise("Normal")
    return d.withColumn("class_name", F.when(cls == "*", by_suffix).otherwise(cls)).withColumn(
        "file", F.concat(F.concat_ws("_", prefix, F.col(stem)), F.lit(".png")))


def header_names(line: Column) -> Column:
    """The column names of a header line."""
    return F.split(F.translate(line, '"\r', ""), ",")


def is_header(line: Column, schema: T.StructType) -> Column:
    """Whether the line names exactly the columns of the schema, in any order."""
    return F.array_sort(header_names(line)) == F.array(*[F.lit(n) for n in sorted(schema.names)])


def parse_log(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema from (names, value): a CSV record and the column names of its file. NaN becomes NULL; a
    record with another number of cells, or with a cell that is not of its column's type, is skipped."""
    cells = [f"c{i}" for i in range(len(schema.fields))]
    record = F.from_csv("value", ", ".join(f"{c} string" for c in [*cells, "torn"]), {"columnNameOfCorruptRecord": "torn"})
    by_name = F.map_from_arrays("names", F.array(*[F.col(f"record.{c}") for c in cells]))
    rows = lines.withColumn("record", record).filter("record.torn is null").select(by_name.alias("cell"))
    typed = rows.select("cell", *[F.col("cell")[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields])
    for f in schema.fields:
        typed = typed.filter(F.col("cell")[f.name].isNull() | F.col(f.name).isNotNull())
    doubles = {f.name: nan_to_null(f.name) for f in schema.fields if isinstance(f.dataType, T.DoubleType)}
    return typed.drop("cell").withColumns(doubles)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of an append-only log of CSV files. Columns are found by the header of each file, so files may order them
    differently; files with other columns are skipped, and so are torn rows."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    head = is_header(F.col("value"), schema)
    names = lines.filter(head).groupBy("file").agg(F.min(header_names(F.col("value"))).alias("names"))
    return parse_log(join_groups(lines.filter(~head), names, ["file"]).select("names", "value"), schema)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows; every part file carries the header once."""
    df.write.mode("append").option("header", "true").csv(path)


def write_result(df: DataFrame, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet") -> None:
    """Replace a result. The new one is written beside the old one and takes its place once it is complete; a write that
    fails leaves the old result as it was."""
    spark = df.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex
    here, new, old = (path_of(f"{path.rstrip('/')}{end}") for end in ("", f".new-{mark}", f".old-{mark}"))
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        (df.select(*columns) if columns else df).write.format(fmt).save(new.toString())
    except Exception:
        files.delete(new, True)
        raise
    replaced = files.exists(here) and files.rename(here, old)
    if not files.rename(new, here):
        if replaced:
            files.rename(old, here)
        raise OSError(f"cannot put the result at {path}")
    if replaced:
        files.delete(old, True)


def import_groups(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Groups of an earlier table (class_name, relative_path, group) under the new file names, renumbered by first
    appearance."""
    stem = F.regexp_extract("relative_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    d = df.select(F.concat(F.concat_ws("_", F.lit((names or {}).get("prefix", "item")), "class_name", stem), F.lit(".png")).alias("file"),
                  "class_name", F.col("group").alias("group_id"))
    return canonical_groups(d)
