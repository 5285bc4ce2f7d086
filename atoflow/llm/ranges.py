"""Ordered groups that may be too large for one task: bounded segments, and digests of ordered rows."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atoflow.llm.common import shared_table

#: Most rows and most characters of text in a segment; one longer row is a segment of its own.
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 4 << 20


def group_key(c: Column | str) -> Column:
    """A string that is equal for equal ids and never null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def tie(*cols: str) -> Column:
    """Order of rows that the sort columns leave equal: a hash of their contents."""
    return F.xxhash64(*cols)


def segments(rows: DataFrame, key: str, order: list[Column], values: list[str], chars: list[str] = (), label: str = "segments",
             size: int = SEGMENT_ROWS, most_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Rows of each ``key`` in ``order``, cut into bounded segments: ``key``, ``seg`` and one array per value.

    ``seg`` ascends along the order of a key, and a segment holds rows of one key: at most ``size``,
    and at most ``most_chars`` characters in the columns ``chars``.  The rows are dealt by ranges
    of key, order and row number, so a key with many rows, also equal ones, lies in many ranges and
    no task sees more than its range.  ``key`` is a string without nulls; ``order`` must be short
    values, as a sample of them goes to the driver.  No rows give no segments.
    """
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("seg", T.LongType()),
                           *(T.StructField(v, T.ArrayType(rows.schema[v].dataType)) for v in values)])
    sort = [f"s{i}" for i in range(len(order))]
    flat = rows.select(F.col(key).alias("k"), *(c.alias(s) for c, s in zip(order, sort)), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    # numbered in a table of its own: a task that is run again finds the same numbers
    flat = shared_table(flat.withColumn("n", F.monotonically_increasing_id()), label)
    by = ["k", *(F.col(s).asc_nulls_first() for s in sort), "n"]
    wide = [i for i, v in enumerate(values) if v in chars]

    def cut(batches):
        at = TaskContext.get().partitionId() << 32
        now, held, lengths = None, [[] for _ in values], 0
        done: list[tuple] = []

        def close():
            nonlocal held, lengths, at
            if held[0]:
                done.append((now, at, *held))
                at, held, lengths = at + 1, [[] for _ in values], 0

        def out():
            cols = list(zip(*done))
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)
            done.clear()
            return batch

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for k, *row in zip(*cols):
                n = sum(len(row[i] or "") for i in wide)
                if k != now or len(held[0]) >= size or lengths + n > most_chars:
                    close()
                    now = k
                for h, x in zip(held, row):
                    h.append(x)
                lengths += n
            if done:
                yield out()
        close()
        if done:
            yield out()

    arrow = _arrow(schema)
    ranged = flat.repartitionByRange(*by).sortWithinPartitions(*by).select("k", *(f"v{i}" for i in range(len(values))))
    return shared_table(ranged.mapInArrow(cut, schema), label)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def digests(pieces: DataFrame, key: str, order: list[str], text: str, sep: str) -> DataFrame:
    """SHA-256 of each key's texts in order, joined by ``sep``: ``key``, ``digest`` (lowercase hex).

    A digest is one sequence, so one task reads a key's pieces, but only one batch of them at a
    time; callers hand over few and bounded pieces per key.  Keys of one piece are not shuffled with
    their texts twice.  Null texts are left out; a key with none of them has the digest of nothing.
    """
    cols = [key, *order, text]
    rows = pieces.select(*cols).repartition(key).sortWithinPartitions(key, *order)
    joint = sep.encode()

    def run(batches):
        now, state, any_ = None, None, False
        keys, out = [], []
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(len(cols) - 1)):
                if state is None or k != now:
                    if state is not None:
                        keys.append(now)
                        out.append(state.hexdigest())
                    now, state, any_ = k, hashlib.sha256(), False
                t = t.as_py()
                if t is not None:
                    if any_:
                        state.update(joint)
                    state.update(t.encode())
                    any_ = True
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(out, pa.string())], names=[key, "digest"])
            keys, out = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], names=[key, "digest"])

    schema = T.StructType([T.StructField(key, pieces.schema[key].dataType), T.StructField("digest", T.StringType())])
    kind = _arrow(schema)[0].type
    return rows.mapInArrow(run, schema)
