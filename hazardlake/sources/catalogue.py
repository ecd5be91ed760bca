"""Split manifests, tile catalogues, event indexes and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlake.functions.text import non_empty
from hazardlake.schemas import EVENT_TILE, MANIFEST, MANIFEST_TRIPLE, METRICS
from hazardlake.session import cut_lineage


def clean_manifest(df: DataFrame) -> DataFrame:
    """Trimmed rows with every column present."""
    out = df.select(*[F.trim(c).alias(c) for c in df.columns])
    for c in df.columns:
        out = out.filter(F.col(c).isNotNull())
    return out


def read_manifest(spark: SparkSession, path: str, triple: bool = False) -> DataFrame:
    """Split manifest without header; rows with too few columns are dropped."""
    schema = MANIFEST_TRIPLE if triple else MANIFEST
    return clean_manifest(spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path))


def existing_samples(manifest: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """Manifest rows whose files all exist."""
    have = files.select(F.col(name).alias("__f"))
    for c in manifest.columns:
        manifest = manifest.join(have, F.col(c) == F.col("__f"), "left_semi")
    return manifest


FLOOD_PATH = r"([^/]+)/(s[12])_(before|during)_flood/([^/_]+)_[^/]*\.tif$"
MASK_PATH = r"([^/]+)/flood_mask/([^/_]+)_[^/]*\.tif$"


def tile_catalogue(paths: DataFrame, path: str = "path") -> DataFrame:
    """Event, sensor, phase and tile out of flood file paths (masks have phase 'mask')."""
    p = F.col(path)
    event = F.coalesce(non_empty(F.regexp_extract(p, FLOOD_PATH, 1)), non_empty(F.regexp_extract(p, MASK_PATH, 1)))
    return paths.select(
        path, event.alias("event"), non_empty(F.regexp_extract(p, FLOOD_PATH, 2)).alias("sensor"),
        F.coalesce(non_empty(F.regexp_extract(p, FLOOD_PATH, 3)),
                   F.when(F.regexp_extract(p, MASK_PATH, 1) != "", F.lit("mask"))).alias("phase"),
        F.coalesce(non_empty(F.regexp_extract(p, FLOOD_PATH, 4)), non_empty(F.regexp_extract(p, MASK_PATH, 2))).alias("tile"),
    ).filter(F.col("event").isNotNull())


def file_paths(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """Paths and sizes of files below a folder, without reading their content."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime"))


def site_catalogue(paths: DataFrame, path: str = "url") -> DataFrame:
    """Host, section and document number of page addresses: the same parsing on URLs."""
    p = F.col(path)
    get = lambda i: non_empty(F.regexp_extract(p, r"^https?://([^/]+)/([a-z]{2})/(\d+)", i))
    return paths.select(path, get(1).alias("event"), get(2).alias("phase"), get(3).alias("tile"))


def filter_events(cat: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Tiles of events that have both phases, optionally only of named events."""
    if names:
        cat = cat.filter(F.col("event").isin(names))
    both = (cat.groupBy("event").agg(F.count_if(F.col("phase") == "before").alias("b"),
                                     F.count_if(F.col("phase") == "during").alias("d"))
            .filter("b > 0 and d > 0").select("event"))
    return cat.join(both, "event", "left_semi")


def write_event_index(df: DataFrame, path: str) -> None:
    """One JSON line per tile, foldered by year and clustered by event.

    Lines replace one nested list per event: an event may have any number of tiles. The
    range split includes the tile, so a large event is written by several tasks.
    """
    (df.select("event", "tile_id", "source_split", "mgrs", "year", "doy")
     .repartitionByRange("year", "event", "tile_id")
     .write.mode("overwrite").partitionBy("year").json(path))


def read_event_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_TILE).json(path)


_INDEX_TILE = "tile_id string, source_split string, mgrs string, year int, doy int"


def write_nested_index(df: DataFrame, path: str) -> None:
    """Index in the nested form {event: {tiles: [...]}}, as lines that are one document together.

    Rows are dealt by ranges of event and tile and numbered; a line is a tile, the first one of
    an event opens it. So a document of any size, and an event of any size, is written by many
    tasks, and none holds more than a line. The lines in order of their files are the document.
    """
    names = ["tile_id", "source_split", "mgrs", "year", "doy"]
    ranged = df.select("event", *names).repartitionByRange("event", "tile_id").sortWithinPartitions("event", *names)
    rows = cut_lineage(ranged.withColumn("id", F.monotonically_increasing_id()), "index")
    first = rows.groupBy("event").agg(F.min("id").alias("id")).withColumn("opens", F.lit(True))
    start = first.agg(F.min("id")).scalar()
    quoted = F.regexp_extract(F.to_json(F.array("event")), r"^\[(.*)\]$", 1)
    opened = F.concat(F.when(F.col("id") == start, "{").otherwise("]},"), quoted, F.lit(':{"tiles":['))
    lines = rows.join(first, ["event", "id"], "left").select(
        "id", F.concat(F.when(F.col("opens"), opened).otherwise(","), F.to_json(F.struct(*names))).alias("value"))
    end = rows.agg(F.when(F.count(F.lit(1)) == 0, "{}").otherwise("]}}").alias("value")).select(F.lit((1 << 63) - 1).alias("id"), "value")
    lines.unionByName(end).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)


def read_nested_index(spark: SparkSession, path: str) -> DataFrame:
    """Tile rows of an index in the nested form {event: {tiles: [...]}}.

    The text is cut at closing braces where it is read, so a document is split over many tasks
    however it is laid out. A piece is a tile; the one that opens an event names it, and the
    name is carried on: inside a block of the file, and from block to block by the last name of
    each. Strings must not contain braces; other plain fields of an event before its tiles are
    skipped.
    """
    raw = spark.read.text(path, lineSep="}").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"))
    name = F.regexp_extract("value", r'"([^"]+)"\s*:\s*\{[^{]*"tiles"\s*:\s*\[', 1)
    tile = F.from_json(F.concat(F.regexp_extract("value", r"(\{[^{]*)$", 1), F.lit("}")), _INDEX_TILE)
    pieces = raw.select("file", "block", "id", F.nullif(name, F.lit("")).alias("name"), tile.alias("t"))
    inside = Window.partitionBy("file", "block").orderBy("id")
    pieces = pieces.withColumn("here", F.last("name", True).over(inside))
    ends = pieces.groupBy("file", "block").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("id"))).alias("end"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    ends = ends.withColumn("carried", F.last("end", True).over(before)).drop("end")
    got = pieces.filter("t.tile_id is not null").join(ends, ["file", "block"])
    return got.select(F.coalesce("here", "carried").alias("event"), "t.*")


def write_report_csv(df: DataFrame, path: str) -> None:
    """Metric rows as CSV with a header; averages are computed, never stored as a row."""
    df.write.mode("overwrite").option("header", True).csv(path)


def type_report(raw: DataFrame, text: tuple[str, ...] = ("event_id", "tile_id")) -> DataFrame:
    """Drop average rows and turn every other column into a number where it is one."""
    data = raw.filter((F.col("tile_id").isNotNull()) & (F.col("tile_id") != "")
                      & (F.col("tile_id") != "AVERAGE") & (F.col("event_id") != "AVERAGE"))
    return data.select(*[F.col(c) if c in text else F.col(c).try_cast("double").alias(c) for c in data.columns])


def read_report_csv(spark: SparkSession, path: str, schema=METRICS) -> DataFrame:
    return type_report(spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path))
