"""JSON-lines sources and sinks. Schemas are given, never inferred; missing and null fields take defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.text import strip

EVIDENCE = "array<struct<doc_id:string,text:string,title:string,score:double,metadata:map<string,string>>>"
RECORD = f"claim_id string, claim string, label string, split string, evidence {EVIDENCE}, metadata map<string,string>"
CORPUS = "doc_id string, text string, title string, score double, split string, metadata map<string,string>"
VERIFIER = "claim_id string, claim string, evidence string, label string, source string, evidence_type string"

# Five passages served where no corpus is given.
DEMO = (
    ("1", "Paris is the capital of France.", "France"),
    ("2", "The Eiffel Tower is in Paris.", "Eiffel Tower"),
    ("3", "Berlin is the capital of Germany.", "Germany"),
    ("4", "Water boils at 100 degrees Celsius at sea level.", "Water"),
    ("5", "The Moon orbits the Earth.", "Moon"),
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, in whatever store it is, is there."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def with_place(df: DataFrame, name: str = "ord") -> DataFrame:
    """Rows numbered from 0 in file order: a count per file part, then numbers within each.

    Only the counts of parts are gathered in one task.
    """
    marked = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    sizes = marked.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__start")
    return marked.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__start")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; blank lines don't count. A missing file is empty, or raises if `strict`."""
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return empty(spark, schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def read_splits(spark: SparkSession, folder: str, splits: list[str], suffix: str = "") -> DataFrame:
    """Records of {split}{suffix}.jsonl with split_name and ord; underscores of labels become spaces; missing files are empty."""
    out = None
    for i, s in enumerate(splits):
        part = with_place(read_jsonl(spark, f"{folder}/{s}{suffix}.jsonl", RECORD)).withColumn("split_name", F.lit(s)).withColumn("split_no", F.lit(i))
        out = part if out is None else out.unionByName(part)
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default)).alias(c)
    label = F.replace(F.coalesce(F.col("label"), F.lit("NOT ENOUGH INFO")), F.lit("_"), F.lit(" ")).alias("label")
    return out.select("split_no", "ord", "split_name", text("claim_id"), text("claim"), label, "split", F.coalesce("evidence", F.array().cast(EVIDENCE)).alias("evidence"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def select_splits(records: DataFrame, suffix: str | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Records whose split_name ends with `suffix` or starts with any of `prefixes`."""
    keep = F.lit(False)
    if suffix is not None:
        keep = keep | F.endswith("split_name", F.lit(suffix))
    for p in prefixes:
        keep = keep | F.startswith("split_name", F.lit(p))
    return records.where(keep)


def read_corpus(spark: SparkSession, path: str | None, trimmed: bool = False) -> DataFrame:
    """Passages with ord; doc_id defaults to the place. Without a file, or an empty one, the demo passages.

    `trimmed` drops blank texts, strips the rest and keeps only `split` of the metadata.
    """
    rows = with_place(read_jsonl(spark, path, CORPUS)) if path else None
    if rows is None or rows.isEmpty():
        rows = spark.createDataFrame([(d, t, n, i) for i, (d, t, n) in enumerate(DEMO)], "doc_id string, text string, title string, ord long")
        rows = rows.withColumn("score", F.lit(None).cast("double")).withColumn("metadata", F.create_map().cast("map<string,string>")).withColumn("split", F.lit(None).cast("string"))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.col("ord").cast("string"))).withColumn("text", F.coalesce("text", F.lit("")))
    if trimmed:
        rows = rows.withColumn("text", strip("text")).where("text <> ''").withColumn("metadata", F.map_filter(F.create_map(F.lit("split"), F.col("split")), lambda _, v: v.isNotNull()))
    return rows


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_tables(df: DataFrame, path: str, by: str = "split", mode: str = "overwrite") -> None:
    """A Parquet copy partitioned by split, so that split filters prune files."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def text_or(column: str, default: str = "") -> Column:
    return F.coalesce(F.col(column), F.lit(default))
