"""Text and CSV inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapanel.functions.columns import bound, day_of_year_to_date, strip_units
from terrapanel.operators.cleaning import null_nan, require_columns, resolve_columns
from terrapanel.session import cut_lineage, fits_broadcast, measured

# Columns of a weather file.
WEATHER_FILE = "LAT double, LON double, YEAR int, DOY int, {factor} double"

# Code points that count as white space.
_BLANK_POINTS = [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BLANK_CHARACTERS = "".join(map(chr, _BLANK_POINTS))


def scan_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str, *, aliases: dict | None = None, required: Sequence[str] = (), date_format: str | None = None
) -> DataFrame:
    """CSV with a header under a declared schema; ``path`` may be a list or hold wildcards.

    Columns are matched by position as Spark's reader does; malformed fields become NULL.
    """
    reader = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").option("mode", "PERMISSIVE").option("enforceSchema", False)
    if date_format:
        reader = reader.option("dateFormat", date_format)
    df = null_nan(reader.csv(path if isinstance(path, str) else list(path)))
    if aliases:
        df = resolve_columns(df, aliases)
    return require_columns(df, required)


def scan_headed_text(spark: SparkSession, path: str, aliases: dict[str, Sequence[str]], required: Sequence[str]) -> DataFrame:
    """CSV of unknown column order read as text: header names trimmed and matched regardless of case."""
    return headed_text(spark.read.option("header", True).csv(path), aliases, required)


def headed_text(df: DataFrame, aliases: dict[str, Sequence[str]], required: Sequence[str]) -> DataFrame:
    """Text columns under the canonical names their trimmed headers stand for in any case."""
    trimmed = df.toDF(*[c.strip() for c in df.columns])
    lower = {c.lower(): c for c in trimmed.columns}
    found = {name: [lower[o.lower()] for o in options if o.lower() in lower] for name, options in aliases.items()}
    return require_columns(resolve_columns(trimmed, found), required)


def scan_elevation(spark: SparkSession, path: str) -> DataFrame:
    """Elevation samples with a units row below the header; numbers may carry units or commas.

    A row is the units row when none of its three fields reads as a number; other
    rows stay even if a field is unreadable.
    """
    return elevation_rows(spark.read.option("header", True).csv(path))


def elevation_rows(df: DataFrame) -> DataFrame:
    """The same from text columns."""
    names = ("longitude", "latitude", "elev")
    text = headed_text(df, {n: [n] for n in names}, names)
    parsed = text.withColumns({n: strip_units(F.col(n)) for n in names})
    unreadable = F.col("longitude").isNull() & F.col("latitude").isNull() & F.col("elev").isNull()
    return parsed.where(~unreadable)


def body_lines(text: Column, marker: str) -> Column:
    """Text from the first token that starts with ``marker`` on, one token per line; NULL without one.

    Tokens are cut at any white space, so lines must hold none; a later token that
    starts with the marker comes twice.
    """
    spaced = F.concat(F.lit(" "), F.rtrim(F.translate(text, _BLANK_CHARACTERS, " " * len(_BLANK_CHARACTERS))))
    body = bound(spaced, lambda t: F.when(F.instr(t, f" {marker}") > 0, F.substring(t, F.instr(t, f" {marker}") + 1, F.length(t))))
    doubled = F.regexp_replace(body, rf" (\Q{marker}\E[^ ]*)", " $1 $1")
    return F.regexp_replace(doubled, " +", "\n")


def scan_preamble(spark: SparkSession, path: str, schema: str, marker: str = "LAT") -> DataFrame:
    """Rows of files that carry free text above a header line starting with ``marker``.

    Files are read line by line and may be cut into blocks.  A line's place is its
    block's and its own order of reading; the marker's place in each file, one row,
    tells the lines above it from those below.
    """
    source = F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block")
    lines = spark.read.text(path).select(*source, F.monotonically_increasing_id().alias("_line"), "value")
    blank = F.translate("value", _BLANK_CHARACTERS, " " * len(_BLANK_CHARACTERS))
    tokens = lines.select("_path", "file", "_block", "_line", F.posexplode(F.array_remove(F.split(blank, " +"), "")).alias("_pos", "token"))
    place = F.struct("_block", "_line", "_pos")
    starts = tokens.where(F.col("token").startswith(marker)).groupBy("_path").agg(F.min(place).alias("_start"))
    body = tokens.join(starts, "_path").where((place > F.col("_start")) & ~F.col("token").startswith(marker))
    return body.select("file", F.from_csv("token", schema).alias("r")).select("file", "r.*")


def factor_of(file: Column) -> Column:
    """Factor name of a file such as ``T2M_202306_tile1.csv``: the text before the first underscore."""
    return F.split(file, "_")[0]


def scan_factors(spark: SparkSession, path: str) -> DataFrame:
    """All weather files under ``path`` as (factor, LAT, LON, DATE, value): one job whatever the number of files."""
    rows = scan_preamble(spark, path, WEATHER_FILE.format(factor="value"))
    return null_nan(rows.select(factor_of(F.col("file")).alias("factor"), "LAT", "LON", day_of_year_to_date(F.col("YEAR"), F.col("DOY")).alias("DATE"), "value"))


def parquet_to_csv(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.mode("overwrite").option("header", True).csv(target)


def with_position(read: DataFrame, out: str = "position") -> DataFrame:
    """Adds each row's number in file order, from 0: files by name, rows as they stand.

    ``read`` comes straight from a file reader.  A row's place in its block is known
    where it is read; what lies before a block follows from a table with one row a
    block.  The rows are materialised once, with the blocks they were read in, so that
    numbers hold whatever the split size and whatever is read again.
    """
    block = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
    located = cut_lineage(read.select("*", *[c.alias(n) for n, c in block.items()], F.monotonically_increasing_id().alias("_at")))
    blocks = cut_lineage(located.groupBy(*block).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("_file").agg(F.sum("_rows").alias("_held"))  # one row a file
    whole = files.select("_file", F.coalesce(F.sum("_held").over(Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_files"))
    starts = blocks.join(whole, "_file").select(*block, (F.col("_files") + F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    starts = cut_lineage(starts)
    rows, size = measured(starts)
    joined = located.join(F.broadcast(starts) if fits_broadcast(1, size) else starts, [*block])
    return joined.withColumn(out, F.col("_at") + F.col("_shift")).drop(*block, "_at", "_shift")


def align_by_position(left: DataFrame, right: DataFrame, out: str = "position") -> DataFrame:
    """Rows of two file readers side by side, first with first; files without a key, such as features and their labels.

    An error if one holds more rows than the other, or if they share a column.
    """
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    first, second = (cut_lineage(with_position(side, out)) for side in (left, right))
    sizes = first.count(), second.count()
    if sizes[0] != sizes[1]:
        raise ValueError(f"{sizes[0]} rows on one side, {sizes[1]} on the other")
    return first.join(second, out)
