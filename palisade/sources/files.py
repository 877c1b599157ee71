"""Event files: nested JSON and flat CSV, both ways."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from palisade.functions.instants import iso_label
from palisade.functions.text import jtrim
from palisade.operators.table import from_csv_row, to_csv_row
from palisade.schema import CSV_COLUMNS, EVENT_SCHEMA
from palisade.sources import ranges

_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])
# Cells keep their white space and line breaks, both ways.
_CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "multiLine": True, "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def format_of(path: str) -> str:
    """``json`` or ``csv`` from the extension, in any case; Spark's output folders too."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix, fmt in ((".jsonl", "json"), (".json", "json"), (".csv", "csv")):
        if name.endswith(suffix):
            return fmt
    raise ValueError(f"unsupported event file {path!r}; use .json, .jsonl or .csv")


def read_events(
    spark: SparkSession, path: str, array: bool | None = None, line_breaks: bool = True,
    split: bool = True,
) -> DataFrame:
    """Nested events, with their place in the files as ``arrival_seq`` (0, 1, ... over the files
    in path order), from a file or folder whose name ends in .json, .jsonl or .csv.

    JSON is one event per line, or, as ``array=True``, one array (or object) per file; without
    the argument a ``.json`` input that begins with a bracket is taken as arrays. A file that
    holds more than its array fails; nothing is left out in silence. CSV cells may contain line
    breaks; ``line_breaks=False`` is the shorter way where none does.

    Arrays and CSV with line breaks are read by ranges of a file, in as many tasks as it has splits;
    ``split=False`` reads each file in one task.
    """
    if format_of(path) == "csv":
        if split and line_breaks:
            return _csv_ranges(spark, path)
        options = {**_CSV_OPTIONS, "multiLine": line_breaks}
        rows = spark.read.schema(_CSV_SCHEMA).options(**options).csv(path)
        return _sequenced(rows, _CSV_SCHEMA.fieldNames(), from_csv_row)
    if array is None:
        array = not path.rstrip("/").lower().endswith(".jsonl") and _begins_array(spark, path)
    if array:
        return _array_ranges(spark, path) if split else _arrays(spark, path)
    return _sequenced(
        spark.read.schema(EVENT_SCHEMA).json(path), EVENT_SCHEMA.fieldNames(), lambda df: df)


def _begins_array(spark: SparkSession, path: str) -> bool:
    """One small task: the first line that is not blank."""
    first = spark.read.text(path).where(F.length(jtrim(F.col("value"))) > 0).limit(1).collect()
    return bool(first) and first[0]["value"].strip().startswith("[")


def _arrays(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, which cannot be split, each one array or object."""
    whole = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path")
    # Inside one more pair of brackets, a second document would make the text invalid.
    documents = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), T.ArrayType(T.StringType()))
    parsed = whole.select("file_path", F.posexplode(F.when(
        F.size(documents) == 1,
        F.from_json("value", T.ArrayType(EVENT_SCHEMA))).otherwise(
        F.raise_error(F.concat(F.lit("not one JSON array or object: "), "file_path")))
    ).alias("_at", "_event"))
    counts = parsed.groupBy("file_path").agg(F.count(F.lit(1)).alias("_n"))
    return parsed.join(_starts(counts, ["file_path"]), "file_path").select(
        "_event.*", (F.col("_start") + F.col("_at")).alias("arrival_seq"))


def _array_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Events of arrays (or single objects), each cut out of its file and parsed on its own."""
    found = ranges.records(spark, path, ranges.JSON)
    blank = "[ \\t\\r\\n]"
    text, array = F.col("text"), F.col("level") == 1
    trimmed = F.regexp_replace(text, f"^\\uFEFF?{blank}*|{blank}+$", "")
    opened = F.when(array & (F.col("no") == 0), F.expr("substring(text, 2)")).otherwise(text)
    # What follows an array's bracket is no event; a lone bracket fails below.
    closed = (
        F.when(array & F.col("last"), F.when(
            text.endswith("]"), F.expr("left(text, length(text) - 1)")).otherwise("]"))
        .when(F.col("open") == 1, F.concat(text, F.lit("}"))).otherwise(text))
    records = (
        found.withColumn("text", trimmed).withColumn("text", opened).withColumn("text", closed))
    # Inside a pair of brackets, anything but one value would make another array, or none.
    one = F.size(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), T.ArrayType(T.StringType()))) == 1
    # The one record of an empty array is no record.
    return records.where(~F.col("hollow")).select(
        F.when(one, F.from_json("text", EVENT_SCHEMA)).otherwise(
            F.raise_error(F.concat(F.lit("not one JSON array or object: "), "file"))).alias("_event"),
        (F.col("start") + F.col("no")).alias("arrival_seq")).select("_event.*", "arrival_seq")


def _csv_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header each, cut out of their files and parsed each on its own."""
    found = ranges.records(spark, path, ranges.CSV)
    schema = ", ".join(f"`{c}` string" for c in CSV_COLUMNS)
    options = {k: str(v).lower() if isinstance(v, bool) else v
               for k, v in _CSV_OPTIONS.items() if k not in ("header", "lineSep")}
    parsed = found.where((F.col("no") > 0) & (F.col("text") != "")).select(
        (F.col("start") + F.col("no") - F.col("blanks") - 1).alias("arrival_seq"),
        F.from_csv("text", schema, options).alias("_row"))
    return from_csv_row(parsed.select("_row.*", "arrival_seq"))


def _starts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """First number of each part: a running sum over one row per file split."""
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _sequenced(rows: DataFrame, columns: list[str], shape) -> DataFrame:
    """Numbers rows in file order. Spark reads a split in one piece, so its rows have
    consecutive ids; splits are counted once and put behind each other."""
    split = ["_file", "_block"]
    placed = rows.select(
        *(F.col(f"`{c}`") for c in columns), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))
    counts = placed.groupBy(*split).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    numbered = placed.join(_starts(counts, split), split).withColumn(
        "arrival_seq", F.col("_start") + F.col("_id") - F.col("_first"))
    return shape(numbered.select(*(F.col(f"`{c}`") for c in columns), "arrival_seq"))


def write_events(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes by extension. JSON goes out as splittable lines and keeps every nested field;
    CSV has the 20 dotted columns and leaves the server-side fields out."""
    if format_of(path) == "csv":
        flat = to_csv_row(df)
        cells = flat.select(*(
            (iso_label(F.col(f"`{c}`")) if flat.schema[c].dataType == T.TimestampType()
             else F.col(f"`{c}`").cast("string")).alias(c) for c in flat.columns))
        options = {k: v for k, v in _CSV_OPTIONS.items() if k != "multiLine"}
        cells.write.mode(mode).options(**options, emptyValue="", nullValue="").csv(path)
    else:
        df.select(*(f.name for f in EVENT_SCHEMA.fields if f.name in df.columns)).write.mode(
            mode).options(ignoreNullFields=False, timestampFormat=_ISO_MICROS).json(path)


def chronological(df: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """Feed order for an export: by event time, then by arrival."""
    return df.orderBy("timestamp", order)
