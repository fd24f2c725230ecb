"""Session logs, usage lines and request logs from JSON lines, in batch or as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK = "type string, text string, id string, name string, input variant, tool_use_id string, content variant, is_error boolean"
REQUEST = (
    "ts string, action string, path string, status int, thread string, model string, input long, charsIn long, charsOut long, charsFixed long, "
    "cacheRead long, cacheWrite long, uncached long, compacted boolean, turns int, window long, reranked string, rerankError string, overflow long, fit string"
)


def lines(spark: SparkSession, path: str, *, modified_after: str | None = None, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """(file, modified, line, value) of text lines; old files are pruned before they are opened.

    line orders the lines of a file: the start of the block that was read, then the number of the row within
    the scan, which rises along a block.  Streams have no such number; there only the block is known.
    """
    reader = spark.readStream if stream else spark.read
    if modified_after and not stream:
        reader = reader.option("modifiedAfter", modified_after)
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.struct(F.col("_metadata.file_block_start").alias("block"), (F.lit(None).cast("long") if stream else F.monotonically_increasing_id()).alias("row")).alias("line"), "value")


def parsed(rows: DataFrame) -> DataFrame:
    """Adds json (VARIANT); lines that do not parse go."""
    return rows.withColumn("json", F.try_parse_json("value")).where("json is not null")


def field(path: str, kind: str = "string", of: str = "json") -> Column:
    return F.try_variant_get(of, f"$.{path}", kind)


def blocks(content: Column) -> Column:
    """Content that is a string or an array of blocks, as an array of typed blocks."""
    plain = F.try_variant_get(content, "$", "string")
    is_text = F.schema_of_variant(content) == "STRING"
    one = F.struct(F.lit("text").alias("type"), plain.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("id", "string"), ("name", "string"), ("input", "variant"), ("tool_use_id", "string"), ("content", "variant"), ("is_error", "boolean"))])
    many = F.transform(
        F.try_variant_get(content, "$", "array<variant>"),
        lambda b: F.struct(*[F.try_variant_get(b, f"$.{n}", t).alias(n) for n, t in (x.split() for x in BLOCK.split(", "))]),
    )
    return F.when(is_text, F.array(one)).otherwise(F.coalesce(many, F.array().cast(f"array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>")))


def joined_text(blocks_: Column) -> Column:
    return F.array_join(F.transform(F.filter(blocks_, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")


def session_entries(rows: DataFrame) -> DataFrame:
    """The typed core of session lines, the raw line kept."""
    return parsed(rows).select(
        "file", "line", field("type").alias("type"), field("subtype").alias("subtype"), F.coalesce(field("isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"),
        F.coalesce(field("isMeta", "boolean"), F.lit(False)).alias("is_meta"), F.coalesce(field("isCompactSummary", "boolean"), F.lit(False)).alias("is_summary"),
        field("agentId").alias("agent_id"), field("timestamp").alias("ts"), field("cwd").alias("cwd"), field("message.role").alias("role"),
        blocks(field("message.content", "variant")).alias("blocks"), F.col("value").alias("raw"),
    )


def messages(entries: DataFrame, sidechain: bool | None = False) -> DataFrame:
    """User and assistant rows with a message, without compaction summaries; side chains as asked for (None: all)."""
    rows = entries.where(~F.col("is_summary") & F.col("type").isin("user", "assistant") & F.col("role").isNotNull())
    return rows if sidechain is None else rows.where(F.col("is_sidechain") == sidechain)


def usage_lines(rows: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Usage rows from `since_ms` on; lines without the marker are dropped before anything is parsed, those without message.usage or a time after."""
    u = lambda n, t="bigint": field(f"message.usage.{n}", t)
    return parsed(rows.where(F.contains("value", F.lit('"usage"')))).select(
        "file", "line", field("message.usage", "variant").isNotNull().alias("used"), F.unix_millis(F.try_to_timestamp(field("timestamp"))).alias("at"), field("message.id").alias("message_id"), field("requestId").alias("request_id"),
        field("message.model").alias("model"), u("input_tokens").alias("input_tokens"), u("output_tokens").alias("output_tokens"), u("cache_creation_input_tokens").alias("cache_creation_input_tokens"),
        u("cache_read_input_tokens").alias("cache_read_input_tokens"), u("cache_creation.ephemeral_1h_input_tokens").alias("ephemeral_1h_input_tokens"), u("service_tier", "string").alias("service_tier"), u("speed", "string").alias("speed"),
    ).where("at is not null and used").drop("used").where(F.lit(True) if since_ms is None else F.col("at") >= since_ms)


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the request log; malformed lines are dropped."""
    return spark.read.schema(REQUEST).option("mode", "DROPMALFORMED").json(path)


def append_requests(rows: DataFrame, path: str) -> None:
    rows.withColumn("ts", F.coalesce("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))).write.mode("append").json(path)


def folder_name(cwd: Column) -> Column:
    return F.regexp_replace(cwd, "[^A-Za-z0-9]", "-")


def is_session_id(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9-]+$")


def by_prefix(names: DataFrame, prefix: str, name: str) -> DataFrame:
    """The one name that begins so, exact matches first; no row unless it is unique."""
    found = names.where(F.startswith(name, F.lit(prefix))).select(name).distinct()
    exact = found.withColumn("__exact", F.col(name) == prefix)
    counted = exact.agg(F.count(F.lit(1)).alias("n"), F.max("__exact").alias("exact"), F.min(name).alias("only"))
    return counted.where(F.col("exact") | (F.col("n") == 1)).select(F.when(F.col("exact"), F.lit(prefix)).otherwise(F.col("only")).alias(name))
