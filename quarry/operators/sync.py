"""Change-data sync as pure steps from state and input to new state.

State: records (id, payload, version, updated_utc, dirty), applied (id, version), outbox (op, id, payload, base, state,
key), conflicts (id, remote, version, reason). A page: (external_id, payload, version, updated_at), payload as canonical
JSON, updated_at as the server's wall clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import utc_text

RECORDS = "id string, payload string, version long, updated_utc string, dirty boolean"
APPLIED = "id string, version long"
OUTBOX = "op string, id string, payload string, base long, state string, key string"
CONFLICTS = "id string, remote string, version long, reason string"
SCHEMAS = {"records": RECORDS, "applied": APPLIED, "outbox": OUTBOX, "conflicts": CONFLICTS}
OPEN = ("pending", "uncertain")

State = dict[str, DataFrame]


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new in place of those of old with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def latest(page: DataFrame, key: str = "external_id", version: str = "version") -> DataFrame:
    """Of each key the row of highest version."""
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("updated_at"))
    return page.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def classify(state: State, page: DataFrame) -> DataFrame:
    """Each latest change with what is to be done: apply, conflict, own (our pending write, seen early) or skip."""
    local = state["records"].select(F.col("id").alias("external_id"), F.col("version").alias("have"), "dirty")
    pending = state["outbox"].where(F.col("state").isin(*OPEN)).select(F.col("id").alias("external_id"), F.col("payload").alias("sent"), "base")
    j = latest(page).join(local, "external_id", "left").join(pending, "external_id", "left")
    moved = F.col("version") != F.col("have")
    own = F.coalesce((F.col("version") == F.col("base") + 1) & (F.col("payload") == F.col("sent")), F.lit(False))
    todo = F.when(F.col("dirty"), F.when(moved & ~own, "conflict").when(moved, "own").otherwise("skip")).when(F.col("have") >= F.col("version"), "skip").otherwise("apply")
    return j.select("external_id", "payload", "version", "updated_at", todo.alias("todo"))


def apply_page(state: State, page: DataFrame) -> State:
    """The state after a page: newer rows replace clean ones, changes under a local edit are set aside as conflicts."""
    done = classify(state, page)
    new = done.where("todo = 'apply'").select(F.col("external_id").alias("id"), "payload", "version", utc_text(F.col("updated_at")).alias("updated_utc"), F.lit(False).alias("dirty"))
    bad = done.where("todo = 'conflict'").select(F.col("external_id").alias("id"), F.col("payload").alias("remote"), "version", F.lit("remote_changed_while_dirty").alias("reason"))
    return state | {"records": upsert(state["records"], new), "applied": state["applied"].unionByName(new.select("id", "version")).distinct(), "conflicts": upsert(state["conflicts"], bad)}


def edit(state: State, edits: DataFrame) -> State:
    """The state after local edits (id, payload). Raises if one of them has an open operation or a conflict."""
    for df, why in ((state["outbox"].where(F.col("state").isin(*OPEN)), "an unresolved operation; reconcile before editing"), (state["conflicts"], "a conflict; resolve it first")):
        if stuck := edits.join(df.select("id"), "id", "left_semi").select("id").take(1):
            raise ValueError(f"{stuck[0]['id']} has {why}")
    new = edits.join(state["records"].select("id", F.col("version").alias("v"), F.col("updated_utc").alias("u")), "id", "left")
    new = new.select("id", "payload", F.coalesce("v", F.lit(0)).cast("long").alias("version"), F.coalesce("u", F.lit("")).alias("updated_utc"), F.lit(True).alias("dirty"))
    return state | {"records": upsert(state["records"], new)}


def stage(state: State, tenant: str) -> State:
    """The state with an operation for each dirty record that has neither one open nor a conflict."""
    busy = state["outbox"].where(F.col("state").isin(*OPEN)).select("id").unionByName(state["conflicts"].select("id")).distinct()
    ops = state["records"].where("dirty").join(busy, "id", "left_anti").select(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")).alias("op"), "id", "payload", F.col("version").alias("base"), F.lit("pending").alias("state"))
    return state | {"outbox": state["outbox"].unionByName(ops.withColumn("key", F.concat(F.lit(f"{tenant}:"), "op")))}


def due(state: State) -> DataFrame:
    """Operations to send, in order; those of records in conflict wait."""
    return state["outbox"].where(F.col("state").isin(*OPEN)).join(state["conflicts"].select("id"), "id", "left_anti").orderBy("op")


def settle(state: State, outcomes: DataFrame) -> State:
    """The state after outcomes (op, result, version, updated_at, remote): result is done, uncertain or conflict."""
    o = state["outbox"].join(outcomes.withColumnRenamed("version", "remote_version"), "op", "left")
    outbox = o.select("op", "id", "payload", "base", F.coalesce("result", "state").alias("state"), "key")
    done = o.where("result = 'done'").select("id", F.col("payload").alias("sent"), "remote_version", utc_text(F.col("updated_at")).alias("at"))
    r = state["records"].join(done, "id", "left")
    mine = F.coalesce(F.col("payload") == F.col("sent"), F.lit(False))
    records = r.select("id", "payload", F.when(mine, F.col("remote_version")).otherwise(F.col("version")).alias("version"), F.when(mine, F.col("at")).otherwise(F.col("updated_utc")).alias("updated_utc"), (F.col("dirty") & ~mine).alias("dirty"))
    applied = state["applied"].unionByName(done.select("id", F.col("remote_version").alias("version"))).distinct()
    bad = o.where("result = 'conflict'").select("id", F.coalesce("remote", F.lit("{}")).alias("remote"), F.coalesce("remote_version", F.lit(0)).cast("long").alias("version"), F.lit("compare_and_swap_conflict").alias("reason"))
    return {"records": records, "applied": applied, "outbox": outbox, "conflicts": upsert(state["conflicts"], bad)}


def invariants(records: DataFrame, remote: DataFrame, writes: DataFrame) -> DataFrame:
    """(invariant, n) of broken invariants: remote rows that are missing or of another version locally, payloads written twice."""
    j = remote.select("external_id", F.col("version").alias("remote_version")).join(records.select(F.col("id").alias("external_id"), "version"), "external_id", "left")
    counts = j.agg(F.count_if(F.col("version").isNull()).alias("missing_locally"), F.count_if(F.col("version") != F.col("remote_version")).alias("version_drift"))
    twice = writes.groupBy("external_id", "payload").count().where("count > 1").agg(F.count("*").alias("duplicate_writes"))
    return counts.join(twice).select(F.explode(F.map_from_arrays(F.array(F.lit("missing_locally"), F.lit("version_drift"), F.lit("duplicate_writes")), F.array("missing_locally", "version_drift", "duplicate_writes"))).alias("invariant", "n"))
