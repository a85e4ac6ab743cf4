"""Shared scratch tables, storage access, running totals and connected components."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..plans.scratch import Scratch, partitions

__all__ = ["Scratch", "arrow_rows", "connected_components", "forget", "open_file", "partitions", "running_totals", "sorted_groups", "spare", "worker_state", "write_file"]

#: Rows of whole texts that one Arrow batch brings to Python.
TEXT_ROWS = 1000


@contextmanager
def arrow_rows(spark: SparkSession, n: int = TEXT_ROWS):
    """Batches of at most so many rows for what runs inside: texts may be long, and a batch is held whole on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spare(columns: list[str], name: str) -> str:
    """The name, or where columns have it (in any case) the name with underscores after it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_state() -> dict:
    """What one Python worker keeps between tasks."""
    return sys.modules.setdefault("_quarry_worker", types.ModuleType("_quarry_worker")).__dict__


def forget(*names: str) -> None:
    """Frees what other operators' tasks have left with this worker."""
    for n in names:
        worker_state().pop(n, None)


# Storage as executors see it: a shared file system, or whatever pyarrow opens by URI.


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def write_file(uri: str, chunks: Iterator[bytes]) -> int:
    """Writes under another name first; the file appears whole or not at all. Returns its size."""
    size = 0
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            for c in chunks:
                f.write(c)
                size += len(c)
        os.replace(f"{path}.part", path)
        return size
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        for c in chunks:
            f.write(c)
            size += len(c)
    return size


def open_file(uri: str):
    """A seekable binary file."""
    if path := _local(uri):
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by keys, one table at a time."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            key = tuple(b.column(k)[s].as_py() for k in keys)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def running_totals(scratch: Scratch, df: DataFrame, group: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Adds start_<value>: the sum over earlier rows of the group, in the given order.

    Rows are dealt by ranges of (group, order), so that a group of any size spreads over partitions; each partition
    sums its own rows and the sums of earlier partitions (one row for each partition and group in it) are added.
    Rows that are equal in group and order come in any order, fixed by the written table. group and values: no nulls.
    """
    spark = df.sparkSession
    n = partitions(spark)
    schema = T.StructType(list(df.schema.fields))
    for v in values:
        schema = schema.add(f"start_{v}", "long")
    schema = schema.add("_pid", "integer")

    def local(batches):
        import pandas as pd
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        carry: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            code, keys = pd.factorize(pd.Series(list(zip(*(b.column(g).to_pylist() for g in group)))))
            more = []
            for v in values:
                x = pd.Series(b.column(v).to_numpy(zero_copy_only=False))
                prior = pd.Series([carry.get((k, v), 0) for k in keys])
                more.append(pa.array(x.groupby(code).cumsum().to_numpy() - x.to_numpy() + prior.to_numpy()[code], pa.int64()))
                for i, total in x.groupby(code).sum().items():
                    carry[keys[i], v] = int(prior[i] + total)
            yield pa.RecordBatch.from_arrays([*b.columns, *more, pa.array([pid] * b.num_rows, pa.int32())], [*b.schema.names, *(f"start_{v}" for v in values), "_pid"])

    dealt = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    with arrow_rows(spark):
        rows = scratch.table(dealt.mapInArrow(local, schema), "running")
    sums = rows.groupBy(*group, "_pid").agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "_pid", *(F.coalesce(F.sum(f"_s_{v}").over(earlier), F.lit(0)).alias(f"_b_{v}") for v in values))
    base = scratch.table(base, "bases")
    joined = rows.join(base, [*group, "_pid"], "left")
    return joined.select(*df.columns, *((F.col(f"start_{v}") + F.col(f"_b_{v}")).alias(f"start_{v}") for v in values))
