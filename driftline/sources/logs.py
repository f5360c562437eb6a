"""Recorder logs, events and model files: readers and writers over Spark's own sources."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import number


#: The characters that code page 1252 has where ISO 8859-1 has controls.
_CONTROLS = {chr(b): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def read_log(spark: SparkSession, path: str | list[str], encoding: str = "windows-1252") -> DataFrame:
    """A CSV log as text columns, header names trimmed; ``file`` is where a row comes from.

    Code page 1252 is read as ISO 8859-1, which Spark's reader knows, and then told apart from it.
    """
    western = encoding == "windows-1252"
    df = spark.read.option("header", True).option("encoding", "ISO-8859-1" if western else encoding).option("ignoreLeadingWhiteSpace", True).csv(path)
    names = [c.strip().lstrip("\ufeff").removeprefix("ï»¿") for c in df.columns]
    if western:
        controls, characters = "".join(_CONTROLS), "".join(_CONTROLS.values())
        names = [c.translate(str.maketrans(_CONTROLS)) for c in names]
        file = F.col("_metadata.file_path").alias("file")
        return df.select(*[F.translate(F.col(f"`{c}`"), controls, characters).alias(n) for c, n in zip(df.columns, names)], file)
    return df.toDF(*names).withColumn("file", F.col("_metadata.file_path"))


def column(df: DataFrame, prefix: str) -> str:
    """The one column whose name begins so; an error if there are none or several."""
    found = [c for c in df.columns if c == prefix] or [c for c in df.columns if c.startswith(prefix)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns begin with {prefix!r}")
    return found[0]


def numbers(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Finite doubles of the named columns (new name: prefix); text that is no number is null. Only these are scanned."""
    return df.select("file", *[number(F.col(f"`{column(df, prefix)}`")).alias(new) for new, prefix in names.items()])


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted columns that the table lacks, in the order asked."""
    return [c for c in wanted if c not in set(df.columns)]


def missing_by_file(spark: SparkSession, path: str | list[str], wanted: list[str], separator: str = ",") -> DataFrame:
    """(file, missing) of text files that lack wanted columns in their first line: names trimmed, in the order asked.

    Of each file only the split with its begin is asked for a line, and one line of it goes on.
    """
    rows = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0)
    first = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"), "value").groupBy("file").agg(F.min_by("value", "_at").alias("value"))
    names = F.transform(F.split(F.regexp_replace("value", "^\ufeff", ""), separator), lambda x: F.trim(x, F.lit(' "\r')))
    return first.select("file", F.array_except(F.array(*map(F.lit, wanted)), names).alias("missing")).where(F.size("missing") > 0)


def file_pairs(paths: DataFrame, path: str = "path") -> DataFrame:
    """Logs named S-<drive>.csv and V-<drive>.csv in one folder, as (folder, drive, phone, vehicle); others are left out."""
    parts = paths.select(F.col(path).alias("path"), F.regexp_extract(path, r"^(.*/)[SV]-[^/]*\.csv$", 1).alias("folder"), F.regexp_extract(path, r"/([SV])-[^/]*\.csv$", 1).alias("side"), F.regexp_extract(path, r"/[SV]-([^/]*)\.csv$", 1).alias("drive"))
    phone = parts.where("side = 'S'").select("folder", "drive", F.col("path").alias("phone"))
    return phone.join(parts.where("side = 'V'").select("folder", "drive", F.col("path").alias("vehicle")), ["folder", "drive"])


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Paths below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")


#: Events of the line protocol: inertial samples and fixes in one wide row.
EVENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("timestamp", T.DoubleType()), T.StructField("timestamp_ns", T.LongType()),
    T.StructField("acceleration", T.ArrayType(T.DoubleType())), T.StructField("angular_rate", T.ArrayType(T.DoubleType())), T.StructField("gravity", T.ArrayType(T.DoubleType())),
    T.StructField("quality", T.DoubleType()), T.StructField("normal_driving", T.BooleanType()), T.StructField("stationary", T.BooleanType()),
    T.StructField("latitude_deg", T.DoubleType()), T.StructField("longitude_deg", T.DoubleType()), T.StructField("horizontal_sigma_m", T.DoubleType()),
    T.StructField("speed_mps", T.DoubleType()), T.StructField("heading_deg_north_clockwise", T.DoubleType()), T.StructField("_corrupt", T.StringType()),
])


def parse_events(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, errors) of JSON lines, in batch or stream. Blank lines are skipped; NaN and infinities are errors.

    Other columns, such as ``line`` of ``numbered_lines``, stay in both; errors have the line's ``text`` and what is wrong.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "false"}
    parsed = lines.where(F.trim(text) != "").withColumn("_e", F.from_json(F.col(text), EVENT, options))
    why = F.when(F.col("_e._corrupt").isNotNull() | F.col("_e").isNull(), "not a JSON object").when(~F.coalesce(F.col("_e.type").isin("imu", "gnss"), F.lit(False)), F.concat(F.lit("type="), F.coalesce("_e.type", F.lit("None")), F.lit(" is not in {imu, gnss}")))
    own = [c for c in lines.columns if c != text]
    events = parsed.where(why.isNull()).select(*own, *[F.col(f"_e.{f.name}") for f in EVENT if f.name != "_corrupt"])
    return events, parsed.where(why.isNotNull()).select(*own, F.col(text).alias("text"), why.alias("error"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1 in each file, blank ones too.

    A split of a file numbers its own lines; what stands before it comes from the counts of the file's earlier splits, of
    which there is a row each. Files are not sorted and no file is read by one task.
    """
    split = ["file", "_block"]
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    counts = rows.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*split, "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(starts, split).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), "value")


def read_summaries(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Navigation outputs with the wanted schema name; other lines are left out."""
    form = "schema string, timestamp_ns long, mode string, target_output_hz double"
    return spark.read.schema(form).json(path).where(F.col("schema") == name)


def load_model(text: str, needed: dict[str, int | None]) -> dict:
    """A model file as a dictionary, checked: every needed field is there, finite, and as long as said."""
    model = json.loads(text)
    for field, size in needed.items():
        value = model.get(field)
        if value is None:
            raise ValueError(f"the model lacks {field}")
        if size is not None and (not isinstance(value, list) or len(value) != size):
            raise ValueError(f"{field} must have {size} values")
        flat = value if isinstance(value, list) else [value]
        flat = [x for row in flat for x in (row if isinstance(row, list) else [row])]
        if any(isinstance(x, float) and x - x != 0 for x in flat):
            raise ValueError(f"{field} must be finite")
    return model


# --- writers ----------------------------------------------------------------------------------------------------------
def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines with their nulls."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text in ``value``, nulls included; NaN and infinities, which JSON lacks, are null."""
    finite = lambda f: F.when(F.abs(F.col(f.name)) < float("inf"), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
    return df.select(F.to_json(F.struct(*[finite(f) for f in df.schema]), {"ignoreNullFields": "false"}).alias("value"))


def append_lines(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines."""
    lines(df).write.mode("append").text(path)


def stream_lines(df: DataFrame, path: str, checkpoint: str):
    """A running query that adds a stream's rows to a folder of JSON lines, each batch once."""
    return lines(df).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def write_table(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet in folders by key, a few files each."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def capture_rows(df: DataFrame, values: list[str], start_utc_ms: Column, start_elapsed_ns: Column) -> DataFrame:
    """Capture rows with numbers at three decimals and UTC from the start's clock and whole elapsed milliseconds."""
    utc = start_utc_ms + F.floor((F.col("timestamp_elapsed_ns") - start_elapsed_ns) / 1_000_000)
    return df.withColumn("timestamp_utc_ms", utc).withColumns({c: F.round(c, 3) for c in values})
