"""Reading and writing posts: logs, envelopes, JSON lines, and the stream source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlake.schemas import ENVELOPE, POST

COMMENTS = "array<struct<user: string, text: string, likes: bigint, timestamp: string>>"


def type_comments(df: DataFrame) -> DataFrame:
    """`comments` is a number or an array by platform: split it into two typed columns."""
    raw = F.col("comments")
    return df.withColumns({"comment_list": F.when(raw.startswith("["), F.from_json(raw, COMMENTS)),
                           "comment_count": raw.try_cast("bigint")}).drop("comments")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Post log, one JSON object per line, mixed platforms; bad lines stay as corrupt rows."""
    got = (spark.read.schema(POST).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return type_comments(got)


def read_post_stream(spark: SparkSession, path: str, max_files: int | None = None,
                     schema=ENVELOPE) -> DataFrame:
    """Envelope stream over a folder, from the oldest file on.

    Progress lives in the query's checkpoint, so a restarted job goes on where it was and
    every file is processed at least once. A Kafka topic replaces the folder by
    ``format('kafka').option('startingOffsets', 'earliest')`` with the same columns.
    """
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def decode_envelope(df: DataFrame, schema: str, now: Column | None = None) -> DataFrame:
    """Parse ``post_data`` and fill in the envelope defaults."""
    return df.select(
        F.from_json(F.coalesce("post_data", F.lit("{}")), schema).alias("post"),
        F.coalesce("platform", F.lit("unknown")).alias("platform"),
        F.coalesce("post_type", F.lit("unknown")).alias("post_type"),
        F.coalesce("timestamp", (now if now is not None else F.current_timestamp()).cast("string")).alias("timestamp"),
        *[c for c in df.columns if c not in ("post_data", "platform", "post_type", "timestamp")])


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append one JSON object per line; nulls are written, text stays as it is."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def incremental_append(df: DataFrame, path: str, schema, key: str, arrival: list[str]) -> None:
    """Append the first row of every id the target does not hold yet."""
    from hazardlake.operators.feed import drop_seen

    seen = df.sparkSession.read.schema(schema).json(path)
    append_jsonl(drop_seen(df, seen, key, arrival), path)
