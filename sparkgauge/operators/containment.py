"""Interval containment: which spans hold a place, and which of them is the nearest.

A place and a span meet if their keys are equal and ``start <= at <= end``.  Rows are dealt
by ranges of (key, place), whose bounds come from a sample, so a key with most of the rows is
split by position, and many rows at one place by chance.  In each part, sorted by place, a
sweep keeps the spans that are open: what begins later lies on top, and what has ended goes
when it comes to the top.  No place is compared with a span that does not hold it, save the
ended ones that each go once.

A span reaches the parts where it begins and ends.  Parts between hold only places inside it:
for all containers it goes there too, where each of its copies is needed for every place; for
the nearest container only the latest begin counts there, one row for a task, part and key.

Of spans that begin at the same place the one that ends first is nearer, and of equal ones
that with the smaller ``span_id``.  Places with a null key or position are in no span; spans
with one, or that end before they begin, hold none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.storage import partitions

#: Sampled rows for each part; the driver sorts these alone.
SAMPLED = 50
#: Rows of an answer that a task holds at once.
ROWS = 50_000
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
OPENS, HELD, LOST = 0, 1, 2


def placed(rows: DataFrame, key: list[str], at: Column, name: str) -> DataFrame:
    """(h, key, at, salt) and the whole row as a struct ``name``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(name)
    keys = [F.col(f"`{c}`") for c in key]
    return rows.select(F.xxhash64(*keys).alias("h"), F.struct(*keys).alias("key"), at.cast("long").alias("at"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), whole)


def bounds(places: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """Where parts begin: places of a sample at even distances."""
    some = places.select("h", "at", "salt").where("at is not null").orderBy("salt").limit(SAMPLED * parts).collect()
    rows = sorted(tuple(r) for r in some)
    return sorted({rows[i * len(rows) // parts] for i in range(1, parts)}) if rows else []


def deal_places(places: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at, salt = (b.column(i).to_pylist() for i in (0, 2, 3))
            part = [bisect_right(cuts, (x, LOWEST if y is None else y, z)) for x, y, z in zip(h, at, salt)]
            kind = pa.array(np.array([LOST if y is None else HELD for y in at], np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), b.column(1), b.column(2), kind, b.column(4)], ["part", "h", "key", "at", "kind", "p"])

    types = places.schema
    schema = StructType([*StructType.fromDDL("part int, h long").fields, types["key"], *StructType.fromDDL("at long, kind int").fields, types["p"]])
    return places.mapInArrow(run, schema)


def deal_spans(spans: DataFrame, cuts: list[tuple[int, int, int]], nearest: bool) -> DataFrame:
    """Spans for the parts that need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner: dict[tuple, tuple[np.ndarray, dict]] = {}  # latest begins by part of each key that has more than two parts, and the rows they are of
        for b in batches:
            part, row = [], []
            for i, (h, start, end) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3)))):
                first, last = bisect_right(cuts, (h, start, LOWEST)), bisect_right(cuts, (h, end, HIGHEST))
                if nearest and last - first > 1:
                    key = tuple(b.column(1)[i].as_py().values())
                    begins, rows = inner.setdefault(key, (np.full(len(cuts) + 1, LOWEST), {}))
                    for p in np.flatnonzero(begins[first + 1 : last] <= start) + first + 1:
                        new = (start, -end, -b.column(4)[i].as_py())
                        if p not in rows or new > rows[p][0]:
                            begins[p], rows[p] = start, (new, b.slice(i, 1))
                    part += [first, last]
                    row += [i, i]
                else:
                    part += range(first, last + 1)
                    row += [i] * (last + 1 - first)
            yield given(b.take(pa.array(row, pa.int64())), part)
        for _, rows in inner.values():
            for p, (_, one) in rows.items():
                yield given(one, [int(p)])

    def given(b: pa.RecordBatch, part: list[int]) -> pa.RecordBatch:
        kind = pa.array(np.full(len(part), OPENS, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), b.column(1), b.column(2), kind, b.column(3), b.column(4), b.column(5)], ["part", "h", "key", "at", "kind", "end", "id", "s"])

    types = spans.schema
    schema = StructType([*StructType.fromDDL("part int, h long").fields, types["key"], *StructType.fromDDL("at long, kind int, end long, id long").fields, types["s"]])
    return spans.mapInArrow(run, schema)


def sweep(rows: DataFrame, nearest: bool) -> DataFrame:
    """Answers of sorted parts: ``p`` with each open span, or with the one on top."""
    types = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ends, spans = None, [], []  # of the open spans
        for b in batches:
            at_row, found = [], []
            kind_of_span = b.schema.field("s").type

            def answer():
                return pa.RecordBatch.from_arrays([b.column(5).take(pa.array(at_row, pa.int64())), pa.array(found, kind_of_span)], ["p", "s"])

            for i, (part, key, at, kind, end) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 4)))):
                if (part, key) != here:
                    here, ends, spans = (part, key), [], []
                if kind == OPENS:
                    ends.append(end)
                    spans.append(b.column(6)[i].as_py())
                elif nearest:
                    while ends and kind == HELD and ends[-1] < at:
                        ends.pop()
                        spans.pop()
                    at_row.append(i)
                    found.append(spans[-1] if ends and kind == HELD else None)
                elif kind == HELD:
                    if ends and min(ends) < at:
                        left = [k for k, e in enumerate(ends) if e >= at]
                        ends, spans = [ends[k] for k in left], [spans[k] for k in left]
                    for k in range(0, len(spans), ROWS):
                        at_row += [i] * len(spans[k : k + ROWS])
                        found += spans[k : k + ROWS]
                        if len(found) >= ROWS:
                            yield answer()
                            at_row, found = [], []
            if found:
                yield answer()

    ordered = rows.sortWithinPartitions("part", "h", "key", F.col("at"), "kind", F.col("end").desc(), F.col("id").desc())
    return ordered.select("part", "key", "at", "kind", "end", "p", "s").mapInArrow(run, StructType([types["p"], types["s"]]))


def joined(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, span_id: str, parts: int | None, nearest: bool) -> DataFrame:
    parts = parts or 4 * partitions(points.sparkSession)
    places = placed(points, key, F.col(f"`{at}`"), "p")
    whole = spans.where(F.expr(f"`{start}` <= `{end}`")).dropna(subset=[*key, start, end])
    opened = placed(whole, key, F.col(f"`{start}`"), "s").select("h", "key", "at", F.col(f"s.`{end}`").cast("long").alias("end"), F.col(f"s.`{span_id}`").cast("long").alias("id"), "s")
    cuts = bounds(places, parts)
    dealt = deal_places(places, cuts).unionByName(deal_spans(opened, cuts, nearest), allowMissingColumns=True)
    return sweep(dealt.repartition(parts, "part"), nearest)


def containers(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, span_id: str, parts: int | None = None) -> DataFrame:
    """The columns of ``points`` and a struct ``span``, a row for each place and span that holds it."""
    return joined(points, spans, key, at, start, end, span_id, parts, False).select("p.*", F.col("s").alias("span"))


def nearest_container(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, span_id: str, parts: int | None = None) -> DataFrame:
    """Every row of ``points`` with the nearest span that holds it as a struct ``span``, null where none does."""
    return joined(points, spans, key, at, start, end, span_id, parts, True).select("p.*", F.col("s").alias("span"))
