"""Records of JSON arrays and of quoted CSV, cut out of byte ranges.

A range of such a file does not tell by itself whether it begins inside a string, nor how deep. Each
range is therefore read for both answers at once: the parity of its quotes, its change of depth and
the record ends at every relative depth. These summaries add up: running sums over one small row per
range give every range its true state, its depth and the number of its first record. A second pass
cuts whole records; pieces at the edges of ranges, two each at most, are put together by record.

Spark's text source makes the ranges, its line separator being a character of the format, so a file
of any size is read by as many tasks as it has splits.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

_ESCAPED = re.compile(rb"(?s)\\.")


@dataclass(frozen=True)
class Dialect:
    """``separator`` parts the text into rows and is put back before each row but a file's first;
    ``end`` parts records where it stands outside quotes at the record level."""
    separator: bytes
    end: bytes
    opens: bytes
    closes: bytes
    escapes: bool


JSON = Dialect(b"}", b",", b"{[", b"}]", True)
CSV = Dialect(b"\n", b"\n", b"", b"", False)


def _marks(data: bytes, dialect: Dialect) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes, brackets and ends, and which byte stands there; what is escaped is none."""
    kinds = np.zeros(256, bool)
    kinds[list(b'"' + dialect.end + dialect.opens + dialect.closes)] = True
    a = np.frombuffer(
        _ESCAPED.sub(b"__", data) if dialect.escapes and b"\\" in data else data, np.uint8)
    places = np.flatnonzero(kinds[a])
    return places, a[places]


class Reading:
    """One way to read a range, batch after batch: starting in a string or not."""

    def __init__(self, inside: bool):
        self.inside, self.depth = int(inside), 0

    def feed(
        self, places: np.ndarray, bytes_there: np.ndarray, dialect: Dialect,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of possible record ends, their relative depths, and the depths that closing
        brackets lead to, from the ``_marks`` of a batch."""
        quotes = bytes_there == ord('"')
        outside = ((np.cumsum(quotes, dtype=np.int64) + self.inside) & 1) == 0
        self.inside = (self.inside + int(quotes.sum())) & 1
        table = np.zeros(256, np.int32)
        table[list(dialect.opens)], table[list(dialect.closes)] = 1, -1
        step = np.where(outside, table[bytes_there], 0)
        depth = np.cumsum(step) + self.depth
        if len(depth):
            self.depth = int(depth[-1])
        end = (bytes_there == dialect.end[0]) & outside
        return places[end], depth[end], depth[step < 0]


def _rows(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame:
    return spark.read.text(path, lineSep=dialect.separator.decode()).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))


def _pieces(batches: Iterator[pa.RecordBatch], dialect: Dialect) -> Iterator[tuple[str, int, bool, bytes]]:
    """``(file, block, first, data)``: the text of a range, a batch at a time."""
    last = None
    for batch in batches:
        values, files, blocks = batch.columns
        n = len(values)
        if not n:
            continue
        other = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
        edges = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for start, stop in zip(edges, edges[1:]):
            key = (files[start].as_py(), blocks[start].as_py())
            rows = values[start:stop].cast(pa.binary())
            text = pc.binary_join(
                pa.ListArray.from_arrays(pa.array([0, stop - start], pa.int32()), rows),
                dialect.separator)[0].as_py()
            first = key != last
            if not (first and key[1] == 0):
                text = dialect.separator + text
            yield (*key, first, text)
            last = key


def _between(data: bytes, ends: np.ndarray) -> pa.Array:
    """The texts between neighbouring ends, in one array."""
    low, high = int(ends[0]) + 1, int(ends[-1])
    inner = ends[1:-1] - low
    body = np.delete(np.frombuffer(data, np.uint8)[low:high], inner)
    offsets = np.append(np.concatenate([[0], inner - np.arange(len(inner))]), len(body))
    texts = pa.StringArray.from_buffers(
        len(ends) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))
    texts.validate(full=True)
    return texts


def _blank_ends(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Which ends begin an empty record: another end, or the end of the batch, is next to them."""
    following = np.append(ends[1:], len(data))[:len(ends)]
    return following == ends + 1


def summaries(rows: DataFrame, dialect: Dialect) -> DataFrame:
    """One row per range: for both readings the change of depth and, by relative depth, how many
    record ends, empty records and closing brackets; and how many bytes are no white space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def row():
            file, block, begins, readings, counts, solid = held
            return pa.RecordBatch.from_pylist([{
                "file": file, "block": block, "begins": begins, "parity": readings[0].inside,
                "solid": solid, "deltas": [r.depth for r in readings],
                **{name: [list(c[name].items()) for c in counts]
                   for name in ("ends", "blanks", "closings")}}], schema=schema)

        for file, block, first, data in _pieces(batches, dialect):
            if first:
                if held:
                    yield row()
                held = (file, block, None, [Reading(False), Reading(True)],
                        [{n: Counter() for n in ("ends", "blanks", "closings")} for _ in range(2)], 0)
            if held[2] is None:
                stripped = data.lstrip(b" \t\r\n\xef\xbb\xbf")[:1]
                held = (*held[:2], stripped.decode("latin-1") or None, *held[3:])
            inked = data.removeprefix(b"\xef\xbb\xbf") if first and block == 0 else data
            held = (*held[:5], held[5] + len(inked) - sum(map(inked.count, b" \t\r\n")))
            marks = _marks(data, dialect)
            for reading, counts in zip(held[3], held[4]):
                ends, depths, closed = reading.feed(*marks, dialect)
                for name, found in (("ends", depths), ("blanks", depths[_blank_ends(data, ends)]),
                                    ("closings", closed)):
                    levels_there, times = np.unique(found, return_counts=True)
                    counts[name].update(dict(zip(levels_there.tolist(), times.tolist())))
        if held:
            yield row()

    levels = pa.list_(pa.map_(pa.int32(), pa.int64()))
    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("begins", pa.string()), ("parity", pa.int32()),
        ("solid", pa.int64()), ("deltas", pa.list_(pa.int32())), ("ends", levels), ("blanks", levels), ("closings", levels)])
    return rows.mapInArrow(run, (
        "file string, block bigint, begins string, parity int, solid bigint, deltas array<int>, "
        "ends array<map<int, bigint>>, blanks array<map<int, bigint>>, closings array<map<int, bigint>>"))


def states(found: DataFrame) -> DataFrame:
    """The true state of each range: ``inside`` a string, ``depth``, the ``level`` at which records
    end, the numbers of its first record (``base``) and of empty ones before (``blanks``), whether
    it is its file's ``last``; and of its file how many ends and closings to nothing there are."""
    within = Window.partitionBy("file").orderBy("block")
    before, whole = within.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    at = lambda c, level: F.coalesce(F.element_at(
        F.element_at(c, F.col("inside") + 1), F.expr(level).cast("int")), F.lit(0))
    return (
        found.withColumn("inside", (sum_before("parity") % 2).cast("int"))
        .withColumn("delta", F.element_at("deltas", F.col("inside") + 1))
        .withColumn("depth", sum_before("delta"))
        .withColumn("level", F.when(F.first("begins", ignorenulls=True).over(
            within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "[", 1).otherwise(0))
        .withColumn("n", at("ends", "level - depth")).withColumn("empty", at("blanks", "level - depth"))
        .withColumn("zero", at("closings", "-depth"))
        .select(
            "file", "block", "inside", "depth", "level", sum_before("n").alias("base"),
            sum_before("empty").alias("blanks"),
            F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))).alias("from_end"),
            F.sum("n").over(whole).alias("file_ends"), F.sum("empty").over(whole).alias("file_blanks"),
            F.sum("zero").over(whole).alias("file_zero"), F.sum("solid").over(whole).alias("file_solid"),
            F.sum("delta").over(whole).alias("file_depth"),
            (F.sum("parity").over(whole) % 2).alias("file_inside")))


def cut(rows: DataFrame, known: dict, dialect: Dialect, whole: bool) -> DataFrame:
    """``file, no, blanks, block, text``: records that lie in one range, or (``whole=False``) the
    pieces at its edges. ``known`` holds one small row per range, as the driver's own plan does."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("file", pa.string()), ("no", pa.int64()), ("blanks", pa.int64()),
                        ("block", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = None

        def put(end: bool) -> None:
            """The record held so far; ``end``: the range ends here."""
            edge = (state["at_edge"] and not state["first"]) or (end and not state["last"])
            if edge != whole:
                out.append((state["file"], state["no"], state["blanks"], state["block"],
                            b"".join(state["held"]).decode()))
            state["held"], state["at_edge"] = [], False

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for file, block, first, data in _pieces(batches, dialect):
            if first:
                if state:
                    put(True)
                inside, depth, level, base, blanks, last = shared.value[file, block]
                state = {"file": file, "block": block, "no": base, "blanks": blanks, "held": [],
                         "first": block == 0, "last": last, "at_edge": True, "level": level - depth,
                         "reading": Reading(inside)}
            ends, depths, _ = state["reading"].feed(*_marks(data, dialect), dialect)
            mine = depths == state["level"]
            blank = _blank_ends(data, ends)[mine]
            ends = ends[mine]
            if len(ends):
                state["held"].append(data[:int(ends[0])])
                put(False)
                # Records that begin and end in this batch are at no edge.
                n = len(ends) - 1
                if whole and n:
                    if out:
                        yield flushed()
                    yield pa.RecordBatch.from_arrays([
                        pa.repeat(file, n), pa.array(state["no"] + 1 + np.arange(n), pa.int64()),
                        pa.array(state["blanks"] + np.cumsum(blank[:-1]), pa.int64()),
                        pa.repeat(block, n), _between(data, ends)], schema=schema)
                state["no"] += n + 1
                state["blanks"] += int(blank.sum())
                data = data[int(ends[-1]) + 1:]
            state["held"].append(data)
            if out:
                yield flushed()
        if state:
            put(True)
        if out:
            yield flushed()

    return rows.mapInArrow(run, "file string, no bigint, blanks bigint, block bigint, text string")


def records(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame:
    """``file, no, blanks, text`` of every record, with its number in its file and the empty ones
    before it, and of its file ``start``, the records of the files before it, ``last``, whether it is
    the last, ``level``, ``open`` and ``hollow``, an array of nothing. Fails where a file's quotes or
    brackets do not close, or close twice."""
    rows = _rows(spark, path, dialect)
    found = states(summaries(rows, dialect)).collect()
    for r in found:
        json = bool(dialect.opens)
        # The text source drops a separator at the end of a file: the brace of a single object.
        closed = r["file_depth"] == 0 and r["file_zero"] == 1 or (
            r["level"] == 0 and r["file_depth"] == 1 and r["file_zero"] == 0)
        if r["file_inside"] or json and not closed:
            raise ValueError(f"not one JSON array or object: {r['file']}" if json
                             else f"a quote never ends: {r['file']}")
    known = {(r["file"], r["block"]): (bool(r["inside"]), r["depth"], r["level"], r["base"], r["blanks"],
                                       r["from_end"] == 1) for r in found}
    # One small row per file, sent to every task: a join by file would put each in one task.
    files, start = [], 0
    for r in sorted({r["file"]: r for r in found}.values(), key=lambda r: r["file"].encode()):
        hollow = r["level"] == 1 and r["file_ends"] == 0 and r["file_solid"] == 2
        files.append((r["file"], r["file_ends"], r["level"], r["file_depth"], hollow, start))
        # Empty lines are no records of CSV, nor is its header.
        start += 0 if hollow else r["file_ends"] + 1 if dialect.opens else r["file_ends"] - r["file_blanks"]
    per_file = spark.createDataFrame(
        files, "file string, ends bigint, level int, open bigint, hollow boolean, start bigint")
    edges = (
        cut(rows, known, dialect, False).groupBy("file", "no").agg(
            F.max("blanks").alias("blanks"),
            F.array_join(F.expr("transform(array_sort(collect_list(struct(block, text))), x -> x.text)"), "")
            .alias("text")))
    return (
        cut(rows, known, dialect, True).select("file", "no", "blanks", "text").unionByName(edges)
        .join(F.broadcast(per_file), "file").withColumn("last", F.col("no") == F.col("ends")))
