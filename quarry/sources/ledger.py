"""A seeded ledger of match events for benchmarks: tenants of uneven size, disabled items, log-normal latencies.

Every value follows from its row's number by whole-number arithmetic in SQL that other engines read too, so that the ledger
is the same on any number of machines, and so that another engine can check a report on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Shape of the ledger. Days are 31 to a month, so that days beyond a month's end occur.
TENANTS, ITEMS, DAYS, LINES, SEED = 40, 1200, 120, 120_000, 20260809
WEIGHTS = (40, 30, 22, *[3] * 17, *[1] * 20)
DISABLED, ACCEPTED, CUSTOMERS = 0.06, 0.72, 399
CANDIDATES = (3, 5, 8, 8, 12, 20)
SCORES, LATENCY = (0.1, 0.99), (4.2, 0.9)
CHANNELS = ("whatsapp", "email_pdf", "portal_csv", "voice_note")
PLANS = ("starter", "growth", "growth", "enterprise")
STAGES = ("alias", "lexical", "lexical", "dense", "dense", "rerank")

_PRIME = 2147483647
#: What the engines spell differently: a column id of numbers below n, and a row for each number below a column n.
SPARK = {"ids": "range({})", "each": "explode(sequence(0, n - 1))"}
DUCKDB = {"ids": "(SELECT range AS id FROM range({}))", "each": "unnest(range(0, n))"}


def _u(seed: int, tag: int, *keys: str) -> str:
    """Uniform in [0, 1): two quadratic steps modulo a prime; nothing in them exceeds 63 bits."""
    x = f"(({' + '.join(f'({k}) % {_PRIME} * {48271 + 21350 * i}' for i, k in enumerate(keys))} + {(seed + 7919 * tag) % _PRIME}) % {_PRIME})"
    for a, b in ((48271, 12345), (69621, 977 + tag)):
        x = f"(({x} * {x} + {a} * {x} + {b}) % {_PRIME})"
    return f"(CAST({x} AS DOUBLE) / {_PRIME + 1}e0)"


def _below(n: int | str, u: str) -> str:
    return f"CAST(floor({u} * {n}) AS INT)"


def _pick(values: tuple, u: str) -> str:
    quoted = [repr(v) for v in values]
    return f"CASE {_below(len(values), u)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted[:-1])) + f" ELSE {quoted[-1]} END"


def _padded(head: str, n: str, width: int) -> str:
    return f"{head} || lpad(CAST({n} AS STRING), {width}, '0')"


def ledger_sql(engine: dict[str, str] = SPARK, seed: int = SEED, lines: int = LINES) -> dict[str, str]:
    """The SQL of tenants, order_lines, events and items."""
    u = lambda tag, *keys: _u(seed, tag, *keys)
    edges = [sum(WEIGHTS[: i + 1]) for i in range(TENANTS)]
    owner = "CASE " + " ".join(f"WHEN w < {e} THEN {i + 1}" for i, e in enumerate(edges[:-1])) + f" ELSE {TENANTS} END"
    tenant = _padded("'T'", "t", 3)
    day = "'2026-' || lpad(CAST(CAST(floor(d / 31) AS INT) + 4 AS STRING), 2, '0') || '-' || lpad(CAST(d % 31 + 1 AS STRING), 2, '0')"
    base = f"SELECT id, {owner} AS t, d, n, win FROM (SELECT id, {_below(sum(WEIGHTS), u(1, 'id'))} AS w, {_below(DAYS, u(2, 'id'))} AS d, {_pick(CANDIDATES, u(3, 'id'))} AS n, {u(4, 'id')} AS win FROM {engine['ids'].format(lines)}) AS drawn"
    each = f"SELECT id, t, d, n, win, {engine['each']} AS r FROM ({base}) AS lines"
    item = lambda k: _padded(f"{tenant} || '-I'", k, 5)
    low, high = SCORES
    normal = f"sqrt(-2 * ln(1 - {u(12, 'id', 'r')})) * cos(6.283185307179586e0 * {u(13, 'id', 'r')})"
    return {
        "tenants": f"SELECT {tenant} AS tenant_id, 'Tenant ' || CAST(t AS STRING) AS name, {_pick(PLANS, u(5, 't'))} AS plan FROM (SELECT id + 1 AS t FROM {engine['ids'].format(TENANTS)}) AS numbers",
        "items": f"SELECT {tenant} AS tenant_id, {item('k')} AS item_code, CASE WHEN {u(6, 't', 'k')} < {DISABLED} THEN 1 ELSE 0 END AS disabled FROM (SELECT CAST(floor(id / {ITEMS}) AS INT) + 1 AS t, id % {ITEMS} AS k FROM {engine['ids'].format(TENANTS * ITEMS)}) AS numbers",
        "order_lines": f"SELECT {_padded(repr('L'), 'id', 7)} AS line_id, {tenant} AS tenant_id, {_padded(repr('C'), '1 + ' + _below(CUSTOMERS, u(7, 'id')), 4)} AS customer_id, {_pick(CHANNELS, u(8, 'id'))} AS channel, {day} AS day FROM ({base}) AS lines",
        # A line is accepted or not; its winner is any of its candidates alike.
        "events": f"SELECT id * {max(CANDIDATES)} + r AS event_id, {tenant} AS tenant_id, {_padded(repr('L'), 'id', 7)} AS line_id, {item(_below(ITEMS, u(9, 'id', 'r')))} AS item_code, {_pick(STAGES, u(10, 'id', 'r'))} AS stage, round({low}e0 + {u(11, 'id', 'r')} * {high - low:.2f}e0, 4) AS score, CAST(r AS INT) AS rank, CASE WHEN win < {ACCEPTED}e0 AND r = CAST(floor(win / {ACCEPTED}e0 * n) AS INT) THEN 1 ELSE 0 END AS accepted, CAST(floor(exp({LATENCY[0]}e0 + {LATENCY[1]}e0 * {normal})) AS BIGINT) AS latency_ms, {day} AS day FROM ({each}) AS candidates",
    }


def ledger(spark: SparkSession, seed: int = SEED, lines: int = LINES) -> dict[str, DataFrame]:
    """tenants, order_lines, events and items, as match_health() takes them."""
    return {name: spark.sql(sql) for name, sql in ledger_sql(SPARK, seed, lines).items()}
