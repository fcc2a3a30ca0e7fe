"""Reading and writing documents, golden sets and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmeter.operators.retrieval import small
from docmeter.sources.folders import exists

# File kinds by extension.
KINDS = {
    "pdf": ["pdf"], "docx": ["docx", "doc"], "xlsx": ["xlsx", "xls", "csv"], "md": ["md", "markdown"], "txt": ["txt"], "pptx": ["pptx", "ppt"], "image": ["png", "jpg", "jpeg", "gif", "bmp"],
}
# The document lists and the sign of each ability of a benchmark row.
ABILITIES = {"noise": (["positive", "negative"], False), "rejection": (["negative"], True), "integration": (["positive", "negative"], False), "counterfactual": (["positive_wrong", "negative"], False)}


class MissingInput(FileNotFoundError):
    """An input that is not there; it is never replaced by an empty one."""


def kind(name: Column) -> Column:
    """The kind of a file by its extension; unknown ones are `unknown`."""
    base = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"([^/\\]*)$", 1)
    ext = F.regexp_extract(base, r"^.+\.([^.]*)$", 1)
    out = F.lit("unknown")
    for k, ends in KINDS.items():
        out = F.when(ext.isin(ends), k).otherwise(out)
    return out


def required(spark: SparkSession, path: str) -> str:
    """The path, or an error."""
    if not exists(spark, path):
        raise MissingInput(path)
    return path


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_num, text): a file is one page; bytes that are no UTF-8 are ignored."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(required(spark, path))

    def task(batches):  # noqa: ANN001, ANN202
        for b in batches:
            b["text"] = [bytes(c).decode("utf-8", "ignore") for c in b["content"]]
            yield b[["path", "text"]]

    return raw.select("path", "content").mapInPandas(task, "path string, text string").select("path", F.lit(1).alias("page_num"), "text")


def row_lines(rows: DataFrame, columns: list[str]) -> Column:
    """S3: a row's values joined by " | ", nulls left out."""
    return F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns))


def tables(spark: SparkSession, path: str) -> DataFrame:
    """S3: CSV files as text: (path, text), a header line and a line a row."""
    lines = spark.read.csv(required(spark, path), header=False).withColumn("path", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id())
    body = lines.select("path", "at", row_lines(lines, [c for c in lines.columns if c not in ("path", "at")]).alias("line"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return body.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("t")).select("path", F.concat(F.lit("## "), name, F.lit("\n"), "t").alias("text"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set, one JSON array."""
    schema = "question string, expect string, page int, negative boolean, doc string, reference string, `group` string"
    return spark.read.schema(schema).json(required(spark, path), multiLine=True)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line_no, line) of text files of any size: byte ranges are read in parallel, and each line's number in
    its file is its place in its range plus the lines of the ranges before, a sum over one row a range."""
    meta = lambda c: F.col(f"_metadata.{c}")
    raw = spark.read.text(required(spark, path)).select(meta("file_path").alias("file"), meta("file_block_start").alias("split"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("id"))
    ranges = raw.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("file", "split", (before + 1 - F.col("first")).alias("shift"))
    return raw.join(small(starts), ["file", "split"]).select("file", "split", (F.col("id") + F.col("shift")).alias("line_no"), "line")


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, item as variant) of files of JSON lines, or of one JSON array each. A bad line is an error that names it; so is no item.

    JSON lines are read in byte ranges; an array, which no range can be cut out of, is one row.
    """
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    first = lines.groupBy("file").agg(F.min_by("line", "line_no").alias("head"))
    arrays = first.where(F.startswith(F.trim("head"), F.lit("["))).select("file")
    listed = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").join(arrays, "file", "left_semi").select("file", F.posexplode(F.from_json("value", "array<string>")).alias("k", "line"))
    single = lines.join(arrays, "file", "left_anti").select("file", "line_no", "line").unionByName(listed.select("file", (F.col("k") + 1).cast("long").alias("line_no"), "line"))
    rows = single.select("file", "line_no", F.try_parse_json("line").alias("item"))
    n, bad = rows.agg(F.count("*"), F.min(F.when(F.col("item").isNull(), F.struct("file", "line_no")))).first()
    if bad is not None:
        raise ValueError(f"{bad['file']}: line {bad['line_no']} is no JSON")
    if not n:
        raise ValueError(f"{path}: no items")
    return rows.select("line_no", "item")


def flat_texts(value: Column) -> Column:
    """A text, a list or a list of lists (JSON text) as an array of trimmed texts; an object is an error."""
    kind_ = F.substring(F.trim(value), 1, 1)
    inner = F.transform(F.from_json(value, "array<string>"), lambda x: F.when(F.startswith(F.trim(x), F.lit("[")), F.from_json(x, "array<string>")).otherwise(F.array(x)))
    one = F.when(kind_ == "[", F.flatten(inner)).when(kind_ == "{", F.raise_error(F.concat(F.lit("a text or a list is wanted, not "), value))).when(kind_ == '"', F.array(F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"])).otherwise(F.array(value))
    return F.filter(F.transform(one, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")


def abilities(items: DataFrame) -> DataFrame:
    """items(id, query, answers, positive, negative, positive_wrong as arrays of texts) once an ability, with its documents."""
    empty = F.array().cast("array<string>")
    rows = F.array(*(F.struct(F.lit(a).alias("ability"), F.concat(*(F.coalesce(k, empty) for k in keys)).alias("documents"), F.lit(neg).alias("negative_item")) for a, (keys, neg) in ABILITIES.items()))
    return items.select("id", "query", "answers", F.explode(rows).alias("x")).select("id", "query", "x.ability", "x.documents", F.col("x.negative_item").alias("negative"), F.when(~F.col("x.negative_item"), F.try_element_at("answers", F.lit(1))).alias("expect"))


def write_metrics(metrics: DataFrame, path: str, run: str) -> None:
    """A run's metric table; a run that is written again replaces its own rows."""
    metrics.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
