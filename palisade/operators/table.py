"""Stored shape: flattening and one row per event id."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palisade.functions.instants import parse_iso_offset
from palisade.functions.text import has_text, jtrim
from palisade.schema import CSV_COLUMNS, ENRICHED_SCHEMA, EVENT_SCHEMA, STORED_PATHS
from palisade.sources.scratch import kept


def flatten(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Nested events to the 24 stored columns; a null struct gives null columns, and a column
    the events do not carry yet is null."""
    present = set(df.columns)
    columns = []
    for field in ENRICHED_SCHEMA.fields:
        path = STORED_PATHS[field.name]
        known = path.split(".")[0] in present
        value = path if known else f"CAST(NULL AS {field.dataType.simpleString()})"
        if field.name == "repeatOffender":
            value = f"coalesce({value}, false)"
        columns.append(f"{value} AS {field.name}")
    return df.selectExpr(*columns, *keep)


def to_csv_row(df: DataFrame) -> DataFrame:
    """The 20 dotted CSV columns. Server-side fields are left out of files by design."""
    return df.select(*(F.col(path).alias(path) for path in CSV_COLUMNS))


def from_csv_row(df: DataFrame) -> DataFrame:
    """Text cells to nested events: an empty cell is null, numbers and enums are trimmed, and
    the geo struct is null when both parts are. An ``arrival_seq`` is kept."""
    def text(name: str) -> Column:
        cell = F.col(f"`{name}`")
        return F.when(cell != "", cell)

    def cell_of(name: str, sql_type) -> Column:
        cell = F.when(has_text(F.col(f"`{name}`")), jtrim(F.col(f"`{name}`")))
        if sql_type.typeName() == "timestamp":
            return parse_iso_offset(cell)
        return cell.try_cast(sql_type)

    def struct_of(prefix: str, fields, trimmed: Sequence[str] = ()) -> Column:
        return F.struct(*(
            (cell_of(f"{prefix}.{f.name}", f.dataType) if f.name in trimmed
             else text(f"{prefix}.{f.name}")).alias(f.name) for f in fields))

    columns = []
    for field in EVENT_SCHEMA.fields:
        if field.name == "rule":
            col = struct_of("rule", field.dataType.fields, ("severity", "action"))
        elif field.name == "geoLocation":
            geo = struct_of("geoLocation", field.dataType.fields)
            present = text("geoLocation.country").isNotNull() | text(
                "geoLocation.city").isNotNull()
            col = F.when(present, geo)
        elif field.name == "repeatOffender":
            col = F.lit(False)
        elif field.name not in CSV_COLUMNS:
            col = F.lit(None).cast(field.dataType)
        elif field.dataType.typeName() == "string":
            col = text(field.name)
        else:
            col = cell_of(field.name, field.dataType)
        columns.append(col.alias(field.name))
    return df.select(*columns, *(c for c in df.columns if c == "arrival_seq"))


def _one_per(df: DataFrame, keys: Sequence[Column], order: Column) -> DataFrame:
    # The rank filter plans a map-side group limit: each task keeps one row per key before
    # the shuffle, so a key with many copies does not pile up.
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


# Keys that come more than once, of which each task gets a list; more are joined as Spark sees fit.
MOST_REPEATED = 100_000


def _one_per_rare(df: DataFrame, keys: Sequence[Column], order: Column) -> DataFrame:
    """As ``_one_per``, but rows whose key comes once are not ranked: sorting whole rows before their
    shuffle takes many times the table's size on disk. Hashes of the keys are counted at once; rows
    that share one are ranked by the keys themselves, so two keys of one hash both stay."""
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    again = kept(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(
        "_n > 1").drop("_n"), "repeated")
    found = again.limit(MOST_REPEATED + 1).count()
    if not found:
        return df
    listed = F.broadcast(again) if found <= MOST_REPEATED else again
    lone, shared = (hashed.join(listed, "_hash", how).drop("_hash") for how in ("left_anti", "left_semi"))
    return lone.unionByName(_one_per(shared, keys, order))


def _latest_keys(key: str, order: str) -> list[Column]:
    return [F.col(key), F.when(F.col(key).isNull(), F.col(order))]


def latest(df: DataFrame, key: str = "eventId", order: str = "arrival_seq") -> DataFrame:
    """Last write wins: the newest arrival of each id. Rows without an id are all kept."""
    return _one_per(df, _latest_keys(key, order), F.col(order).desc())


def compacted(df: DataFrame, key: str = "eventId", order: str = "arrival_seq") -> DataFrame:
    """As ``latest``, for a table whose ids rarely come again; counts them at once."""
    return _one_per_rare(df, _latest_keys(key, order), F.col(order).desc())


def first_arrival(
    df: DataFrame, keys: Sequence[str] = ("clientIp", "eventId"), order: str = "arrival_seq",
) -> DataFrame:
    """Drops retries, keeping the first arrival. Rows with a blank key part are all kept. Counts
    the keys at once."""
    complete = F.lit(True)
    for key in keys:
        complete &= has_text(F.col(key).cast("string"))
    unique = F.when(~complete, F.col(order))
    return _one_per_rare(df, [*(F.col(k) for k in keys), unique], F.col(order))
