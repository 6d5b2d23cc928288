"""File sources and sinks: payloads, line logs, CSV, vector stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of a leaderboard payload.
ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("item_id", "item_title", "nick_name", "item_url")]
    + [T.StructField(n, T.LongType()) for n in ("like_cnt", "play_cnt", "item_duration", "media_type", "publish_time")]
)
PAYLOAD = T.StructType([T.StructField("code", T.LongType()), T.StructField("data", T.StructType([T.StructField("objs", T.ArrayType(ITEM))]))])


def read_leaderboards(spark: SparkSession, path: str) -> DataFrame:
    """Items of leaderboard documents; the list comes from the name of the file (``_<list>.json``) or of its folder (``list=<list>``), the rank from the place, dropped items counted."""
    docs = spark.read.schema(PAYLOAD).option("recursiveFileLookup", True).json(path, multiLine=True).withColumn("list_id", F.regexp_extract(F.input_file_name(), r"(?:_|/list=)(\d+)(?:\.json|/[^/]*)$", 1).try_cast("long"))
    items = docs.select(F.when(F.col("list_id").isNull(), F.raise_error(F.lit("no list in the file name"))).otherwise(F.col("list_id")).alias("list_id"), F.posexplode("data.objs").alias("place", "item"))
    known = items.where("item.item_id IS NOT NULL AND trim(item.item_id) <> ''")
    return known.select("item.item_id", "list_id", (F.col("place") + 1).cast("long").alias("rank"), F.col("item.like_cnt").alias("likes"), F.col("item.play_cnt").alias("views"), F.col("item.item_title").alias("title"), F.col("item.nick_name").alias("author"))


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One object a line."""
    df.write.mode("overwrite").json(path)


BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV files of fixed columns, each with a byte order mark, a header and empty text for null."""
    chosen = df.select(*(columns or df.columns))
    chosen.toDF(BOM + chosen.columns[0], *chosen.columns[1:]).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of ``write_csv``: the header is skipped, so its mark is too, and empty text is null."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("nullValue", "").csv(path)


def write_envelopes(df: DataFrame, path: str, folder: str) -> None:
    """Envelopes (tool, source_id, output) as JSON, in a folder for each value of ``folder``."""
    df.repartition(folder).write.mode("overwrite").partitionBy(folder).json(path)


def read_envelopes(spark: SparkSession, path: str, tool: str, output: str) -> DataFrame:
    """Envelopes of one tool from all folders under ``path``, with the folder, the file and when it changed.

    ``output`` is the type of the payload. Files of other shapes, without a tool, or not JSON at all are passed over; the filter on the tool reaches the scan.
    """
    rows = spark.read.schema(f"tool string, source_id string, output {output}").option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path)
    folder = F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1)
    return rows.where(F.col("tool") == tool).select(folder.alias("folder"), "tool", "source_id", "output", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"))


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    """An order-free fingerprint of rows: the sum of their 64-bit hashes."""
    return F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string")


def write_vectors(df: DataFrame, path: str, model: str) -> None:
    """Vectors (id, text, embedding) as Parquet with a row of facts to check on reading."""
    df.write.mode("overwrite").parquet(f"{path}/vectors")
    facts = df.agg(F.count(F.lit(1)).alias("rows"), content_hash(df, ["id", "text"]).alias("hash")).withColumn("model", F.lit(model))
    facts.write.mode("overwrite").json(f"{path}/facts")


def read_vectors(spark: SparkSession, path: str, rows: DataFrame, model: str) -> DataFrame:
    """The stored vectors, if they were made by ``model`` from exactly ``rows`` (id, text); else an error."""
    want = rows.agg(F.count(F.lit(1)).alias("rows"), content_hash(rows, ["id", "text"]).alias("hash")).first()
    got = spark.read.schema("rows long, hash string, model string").json(f"{path}/facts").first()
    if (got["rows"], got["hash"], got["model"]) != (want["rows"], want["hash"], model):
        raise ValueError(f"the vector store is stale: {got} for {want}, model {model}")
    return spark.read.parquet(f"{path}/vectors")


def first_json(text: Column) -> Column:
    """The text from the first brace to the last, without thinking tags and code fences."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def device_eligibility(devices: DataFrame, processes: DataFrame, own: list[int]) -> DataFrame:
    """Devices without processes and nearly idle, or used by the caller's own processes only."""
    used = processes.groupBy("uuid").agg(F.collect_set("pid").alias("pids"))
    joined = devices.join(used, "uuid", "left")
    pids = F.coalesce("pids", F.array().cast("array<bigint>"))
    foreign = F.array_except(pids, F.array(*(F.lit(p).cast("long") for p in own)).cast("array<bigint>"))
    idle = (F.size(pids) == 0) & (F.col("memory_mib") <= 1000) & (F.col("load") <= 5)
    return joined.withColumn("eligible", idle | ((F.size(pids) > 0) & (F.size(foreign) == 0))).drop("pids")
