"""Walks over logs in which each decision depends on those before it, in slices that run side by side.

A log is sorted by key and order and dealt by range into slices, so that a key with most of the rows lies in many
slices and keys with few share one. All slices are walked at once, each from the state that a key begins with. A slice
that begins inside a key should have begun with the state in which the slice before it ended: those for which that differs from what
was assumed are walked again from it, and so on until all ends and beginnings agree. Then every slice has been walked as one
walk from the log's beginning would have walked it, by induction from the first slice on.

How many rounds that takes depends on how far a state reaches. A cache is filled anew by a slice that asks for more answers than it
holds, and a limit forgets what is older than its window, so that slices longer than a window take few rounds. Each round settles one
more slice at least; a log whose limits never let go takes as many rounds as slices, as slow as one walk. A task holds
one batch of rows and one state. The driver holds one line for each slice: its first and last key and digests.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}
EXIT = "_slice int, _first string, _last string, _state string"


@dataclass(frozen=True)
class Walk:
    """``begin`` makes the state of a key; ``step`` changes it by a row and gives the row's result; ``dump`` and ``load`` turn it into JSON values and back.

    What ``dump`` gives must be equal for states that decide alike as far as can be told: it drops what has expired.
    """

    begin: Callable[[], Any]
    step: Callable[[Any, tuple], tuple]
    dump: Callable[[Any], Any]
    load: Callable[[Any], Any]

    def text(self, state: Any) -> str:
        return json.dumps(self.dump(state), separators=(",", ":"))


def _named(key: object) -> str:
    return "" if key is None else f"={key}"


def _walker(walk: Walk, names: list[str], by: str, schema: str) -> Callable:
    """Walks the slices that it is given row by row; a slice's entry state comes before its rows, and its exit state is put out after them."""
    place, columns = names.index(by), [c.split() for c in f"{schema}, {EXIT}".split(", ")]
    width = len(columns) - 4

    def run(batches):
        number = first = key = state = entry = None
        out: list[tuple] = []

        def ended() -> tuple:
            return (None,) * width + (number, first, _named(key), walk.text(state))

        for batch in batches:
            for slice_, at, given, last, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slice_ != number:
                    if first is not None:
                        out.append(ended())
                    number, first, entry = slice_, None, None
                if at < 0:
                    entry = (last, given)
                    continue
                if first is None or row[place] != key:
                    key = row[place]
                    goes_on = first is None and entry is not None and entry[0] == _named(key)
                    state = walk.load(json.loads(entry[1])) if goes_on else walk.begin()
                    first = _named(key) if first is None else first
                out.append((*walk.step(state, tuple(row)), slice_, None, None, None))
            if out:
                yield _batch(out, columns)
                out = []
        if first is not None:
            yield _batch([ended()], columns)

    return run


def _batch(rows: list[tuple], columns: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])


def walked(table: DataFrame, by: str, order: list[str], walk: Walk, schema: str, slices: int | None = None) -> DataFrame:
    """What ``walk`` gives for each row, in order within each value of ``by``, as columns of ``schema``.

    Without a number of slices, Spark's shuffle settings say how large a slice is.
    """
    spark, names = table.sparkSession, table.columns
    keys = [by, *order]
    dealt = table.repartitionByRange(slices, *keys) if slices else table.repartitionByRange(*keys)
    # The number of a row within its slice keeps their order.
    dealt = dealt.sortWithinPartitions(*keys).select(F.spark_partition_id().alias("_slice"), F.monotonically_increasing_id().alias("_at"), F.lit(None).cast("string").alias("_state"), F.lit(None).cast("string").alias("_last"), *names)
    rows = scratch.kept(dealt, "slices")
    path = scratch.place(spark, "walks")
    read = spark.read.schema(f"{schema}, {EXIT}, round int")
    begun = sha256(walk.text(walk.begin()).encode()).hexdigest()
    ends: dict[int, tuple[str, str, str]] = {}  # of each slice: first and last key, digest of its last state
    entered: dict[int, str] = {}
    latest: dict[int, int] = {}
    todo: list[tuple[int, int]] = []  # slices to walk, with the one before each
    round_ = 0
    while True:
        some = rows
        if round_:
            some = rows.where(F.col("_slice").isin([b for b, _ in todo]))
            which = spark.createDataFrame([(latest[a], a, b) for b, a in todo], "round int, _slice int, next int")
            states = read.parquet(path).where("_state is not null").join(F.broadcast(which), ["round", "_slice"])
            some = some.unionByName(states.select(F.col("next").alias("_slice"), F.lit(-1).cast("long").alias("_at"), "_state", "_last"), allowMissingColumns=True)
        together = some.repartition("_slice").sortWithinPartitions("_slice", "_at")
        together.mapInArrow(_walker(walk, names, by, schema), f"{schema}, {EXIT}").write.parquet(f"{path}/round={round_}")
        for r in read.parquet(path).where((F.col("round") == round_) & F.col("_state").isNotNull()).select("_slice", "_first", "_last", F.sha2("_state", 256).alias("d")).collect():
            ends[r["_slice"]] = (r["_first"], r["_last"], r["d"])
            latest[r["_slice"]] = round_
        in_order, todo = sorted(ends), []
        for a, b in zip(in_order, in_order[1:], strict=False):
            wanted = ends[a][2] if ends[a][1] == ends[b][0] else begun
            if wanted != entered.get(b, begun):
                entered[b] = wanted
                todo.append((b, a))
        if not todo:
            break
        round_ += 1
    last = spark.createDataFrame([(k, n) for n, k in latest.items()], "round int, _slice int")
    return read.parquet(path).where("_state is null").join(F.broadcast(last), ["round", "_slice"]).select(*(c.split()[0] for c in schema.split(", ")))
