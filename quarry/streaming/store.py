"""A tenant's sync state as committed versions of tables, and the loop that pulls and pushes.

Each commit writes all tables under a new version and then a marker; a version without its marker does not exist, so a
crash leaves the state before. Streaming batches carry their number into the commit and are applied once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import second_before
from ..functions.payload import canonical
from ..operators import sync
from ..plans.scratch import Scratch, exists, partitions, remove


class PullCapacityError(RuntimeError):
    """The page never came up short, so it cannot be told that all changes were seen."""


class WriteTimeout(Exception):
    """The server did not answer; the write may have happened."""


class WriteConflict(Exception):
    """The record has changed since the base version."""


class Store:
    """States of one tenant under a folder; `keep` versions stay."""

    def __init__(self, spark: SparkSession, path: str, tenant: str, keep: int = 3):
        self.spark, self.path, self.tenant, self.keep = spark, path, tenant, keep
        self.version = max((v for v in self._versions() if exists(spark, f"{path}/v{v:08d}/COMMITTED")), default=0)
        if self.version:
            if self.meta()["tenant"] != tenant:
                raise ValueError("the store is another tenant's")
        else:
            self.commit({n: spark.createDataFrame([], s) for n, s in sync.SCHEMAS.items()}, {"cursor": None, "batch": -1})

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        _, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/v{self.version:08d}/meta").first()[0])

    def state(self) -> sync.State:
        return {n: self.spark.read.schema(s).parquet(f"{self.path}/v{self.version:08d}/{n}") for n, s in sync.SCHEMAS.items()}

    def commit(self, state: sync.State, meta: dict) -> None:
        new = max([0, *self._versions()]) + 1
        at = f"{self.path}/v{new:08d}"
        for n, df in state.items():
            df.write.mode("overwrite").parquet(f"{at}/{n}")
        self.spark.createDataFrame([(json.dumps(meta | {"tenant": self.tenant}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/meta")
        jvm, _, fs = self._fs()
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{at}/COMMITTED"), False).close()
        self.version = new
        for v in self._versions():
            if v <= new - self.keep:
                remove(self.spark, f"{self.path}/v{v:08d}")

    def record(self, key: str):
        return self.state()["records"].where(F.col("id") == key).first()

    def cursor(self) -> str | None:
        return self.meta()["cursor"]

    def edit(self, key: str, payload: dict) -> None:
        edits = self.spark.createDataFrame([(key, canonical(payload))], "id string, payload string")
        self.commit(sync.edit(self.state(), edits), self.meta())


def _none(_: str) -> None:
    return None


def pull(feed: Callable[[str | None, int], DataFrame], store: Store, page_size: int = 50, max_records: int = 100_000, full: bool = False, crash_hook: Callable[[str], None] = _none) -> int:
    """Applies the changes since the cursor, less a second; returns how many. feed(since, limit): the first changes after
    `since`, oldest first. Pages double until one is short; the state changes in one commit or not at all."""
    if page_size < 1 or max_records < page_size:
        raise ValueError("page_size and max_records do not fit")
    meta = store.meta()
    cursor = None if full else meta["cursor"]
    since = store.spark.range(1).select(second_before(F.lit(cursor))).first()[0] if cursor else None
    limit = page_size
    while True:
        page = feed(since, limit)
        n = page.count()
        if n < limit:
            break
        if limit >= max_records:
            raise PullCapacityError("the last page was full; the cursor stays")
        limit = min(max_records, limit * 2)
    if not n:
        return 0
    state = store.state()
    applied = sync.classify(state, page).where("todo = 'apply'").count()
    crash_hook("after_record")
    newest = page.agg(F.max("updated_at")).first()[0]
    new = sync.apply_page(state, page)
    crash_hook("before_commit")
    store.commit(new, meta | {"cursor": max(newest, meta["cursor"] or "")})
    return applied


OUTCOME = "op string, result string, version long, updated_at string, remote string"


def send(client, op: dict, max_attempts: int) -> tuple:
    """One operation's outcome. An answer that shows our payload at base + 1 is ours, whoever says so."""
    result, answer = None, None
    for _ in range(max_attempts):
        try:
            answer = client.write(op["id"], json.loads(op["payload"]), op["base"], op["key"])
            result = "done"
            break
        except Exception as e:
            # By name: the library goes to executors by value, so that its classes are copies there.
            kinds = {c.__name__ for c in type(e).__mro__}
            if "WriteTimeout" in kinds:
                result = "uncertain"
            elif "WriteConflict" in kinds:
                answer = client.get(op["id"])
                ours = answer and answer[0] == op["base"] + 1 and canonical(answer[1]) == op["payload"]
                result = "done" if ours else "conflict"
                break
            else:
                raise
    return op["op"], result, answer[0] if answer else None, answer[2] if answer else None, canonical(answer[1]) if answer else None


def push(client, store: Store, max_attempts: int = 3, crash_hook: Callable[[str], None] = _none) -> int:
    """Sends what is due, one by one from the driver; returns how many were acknowledged. client.write(id, payload, base, key)
    returns (version, payload, updated_at) or raises WriteTimeout or WriteConflict; client.get(id) returns the same or None.

    Operations are committed before the first is sent and keep their key, so a repeated one is recognised. Each outcome is
    committed as it comes: for few operations. push_all() is for many.
    """
    if max_attempts < 1:
        raise ValueError("max_attempts must be positive")
    store.commit(sync.stage(store.state(), store.tenant), store.meta())
    crash_hook("after_outbox_commit")
    pushed = 0
    for op in [r.asDict() for r in sync.due(store.state()).toLocalIterator()]:
        row = send(client, op, max_attempts)
        if row[1] == "done":
            crash_hook("after_remote_commit")
            pushed += 1
        store.commit(sync.settle(store.state(), store.spark.createDataFrame([row], OUTCOME)), store.meta())
    return pushed


def push_all(make_client: Callable[[], object], store: Store, max_attempts: int = 3, tasks: int | None = None) -> int:
    """push() of any number of operations: executors send them, each task with a client of its own, and all outcomes are
    committed at once. A task or a whole push that runs again sends the same keys, which the server knows."""
    if max_attempts < 1:
        raise ValueError("max_attempts must be positive")
    store.commit(sync.stage(store.state(), store.tenant), store.meta())
    spark = store.spark

    def run(batches):
        import pyarrow as pa

        client = None
        for b in batches:
            rows = []
            for op in b.to_pylist():
                client = client or make_client()
                rows.append(send(client, op, max_attempts))
            if rows:
                types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in OUTCOME.split(", ")])

    due = sync.due(store.state()).select("op", "id", "payload", "base", "key").repartition(tasks or partitions(spark), "id")
    outcomes = Scratch(spark, "push").table(due.mapInArrow(run, OUTCOME), "outcomes")
    store.commit(sync.settle(store.state(), outcomes), store.meta())
    return outcomes.where("result = 'done'").count()


def apply_stream(changes: DataFrame, store: Store, checkpoint: str):
    """Starts a query that applies each micro-batch of a stream of changes once, whatever restarts."""

    def each(batch: DataFrame, number: int) -> None:
        meta = store.meta()
        if number <= meta["batch"] or batch.isEmpty():
            return
        newest = batch.agg(F.max("updated_at")).first()[0]
        store.commit(sync.apply_page(store.state(), batch), meta | {"batch": number, "cursor": max(newest, meta["cursor"] or "")})

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
