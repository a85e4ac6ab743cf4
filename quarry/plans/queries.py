"""The library's operators as queries over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as X
from ..operators import decision, evaluation, identifiers, lexical, report, split, sync
from ..operators.catalogue import eligible
from ..sources import files
from ..sources.ledger import ledger
from ..streaming.feed import list_changes
from .inputs import load, whole_aliases
from .scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Text days and months all lie between.
EVER = ("0000", "9999")
#: Parts, by tenant, in which match_contract checks results.
CONTRACT_PARTS = 4


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    return df.select(*(F.array_join(c, "|").alias(c) if c in arrays else F.col(f"`{c}`") for c in df.columns))


def _rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return report.normalised(df, places)


# Report


def _ledger(spark, sf, kind):
    return tuple(load(spark, sf, f"{kind}_{n}") for n in ("tenants", "lines", "events", "items"))


@query
def report_days(spark, sf):
    """All columns by tenant, channel and day."""
    return report.normalised(report.match_health(*_ledger(spark, sf, "day"), "2024-01-02", "2024-01-29"))


@query
def report_months(spark, sf):
    """By month, with events of other tenants and months than their orders."""
    return report.normalised(report.match_health(*_ledger(spark, sf, "month"), "1996-01", "1999-12", prior=report.prior_month))


@query
def report_days_all(spark, sf):
    """report_days over every day of the table."""
    return report.normalised(report.match_health(*_ledger(spark, sf, "day"), *EVER))


@query
def report_months_all(spark, sf):
    """report_months over every month of the table."""
    return report.normalised(report.match_health(*_ledger(spark, sf, "month"), *EVER, prior=report.prior_month))


@query
def report_slice(spark, sf):
    """Some metrics of some tenants: a plan without the scans of the others."""
    return report.match_health(*_ledger(spark, sf, "day"), "2024-01-05", "2024-01-08", names=("lines_accepted", "distinct_customers"), only_tenants=("T1", "T4"))


@query
def report_rerun_differences(spark, sf):
    """What the reports before and after a loss of events do not share, by side; two runs over the same share all."""
    tenants, lines, events, items = _ledger(spark, sf, "day")
    one = lambda e: report.match_health(tenants, lines, e, items, "2024-01-10", "2024-01-12")
    lost = report.differences(one(events), one(events.where("item_code <> 'I7'"))).groupBy("side").agg(F.count("*").alias("n"))
    same = report.differences(one(events), one(events)).agg(F.lit("none").alias("side"), F.count("*").alias("n"))
    return lost.unionByName(same)


@query
def report_seeded_ledger(spark, sf):
    """The report of the whole seeded ledger; what it reads is generated. Its window holds days beyond a month's end."""
    g = ledger(spark)
    return report.normalised(report.match_health(g["tenants"], g["order_lines"], g["events"], g["items"], "2026-04-28", "2026-06-31"), 12)


@query
def p95_by_window(spark, sf):
    return report.p95_by_window(load(spark, sf, "day_events"))


@query
def previous_days(spark, sf):
    """Days before text days, some of them beyond their month's end."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    d = F.concat(F.substring(F.col("o_orderdate").cast("string"), 1, 8), F.lpad((1 + F.col("o_orderkey") % 31).cast("string"), 2, "0"))
    return orders.select(d.alias("d")).distinct().select("d", dates.previous_day(F.col("d")).alias("before"))


# Matcher


def _evidence(spark, sf, s=None, cold=False):
    s = s or Scratch(spark, "match", frees=True)
    return identifiers.retrieve_identifiers(s, load(spark, sf, "lines"), load(spark, sf, "catalogue"), None if cold else load(spark, sf, "aliases"))


def _retrieval(spark, sf, s=None):
    s = s or Scratch(spark, "match", frees=True)
    retrieval = s.table(lexical.retrieve(s, load(spark, sf, "lines"), load(spark, sf, "catalogue"), _evidence(spark, sf, s)), "retrieval")
    s.keep(retrieval)
    return retrieval


@query
def catalogue_eligible(spark, sf):
    return load(spark, sf, "catalogue").select("tenant", "item_code", eligible().alias("eligible"))


@query
def audit_catalogue(spark, sf):
    return evaluation.audit_catalogue(load(spark, sf, "catalogue"))


@query
def audit_aliases(spark, sf):
    return evaluation.audit_aliases(load(spark, sf, "aliases"))


@query
def identifier_index(spark, sf):
    return identifiers.identifier_index(load(spark, sf, "catalogue"))


@query
def identifier_hits(spark, sf):
    cat = load(spark, sf, "catalogue")
    own = load(spark, sf, "lines").join(cat.select("tenant").distinct(), "tenant", "left_semi")
    return identifiers.identifier_hits(own, identifiers.identifier_index(cat))


@query
def identifier_evidence(spark, sf):
    return _joined(_evidence(spark, sf), "codes", "sources", "issues")


@query
def identifier_cold_start(spark, sf):
    """Without buyers' codes."""
    return _joined(_evidence(spark, sf, cold=True), "codes", "issues").drop("sources")


@query
def identifier_counters(spark, sf):
    return evaluation.identifier_counters(_evidence(spark, sf), load(spark, sf, "labels_of_lines"))


@query
def alias_targets(spark, sf):
    own = load(spark, sf, "lines").join(load(spark, sf, "catalogue").select("tenant").distinct(), "tenant", "left_semi")
    return identifiers.alias_evidence(own, load(spark, sf, "aliases")).where("code is not null").select("line_id", "code")


@query
def normalised_texts(spark, sf):
    """Texts with every abbreviation, unit mark and slash."""
    t = F.col("raw_text")
    return load(spark, sf, "texts").select("line_id", X.normalise(t).alias("normalised"), X.word_key(t).alias("word_key"))


@query
def item_attributes(spark, sf):
    """All attributes: amounts in thousandths of mm, g and ml."""
    named = load(spark, sf, "texts").withColumn("name", X.normalise(F.col("raw_text"))).withColumn("a", X.attributes(F.col("name")))
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    amount = lambda k: text(F.transform(f"a.{k}", lambda x: F.round(x * 1000).cast("long").cast("string"))).alias(k)
    return named.select("line_id", *(amount(k) if k in ("length", "weight", "volume") else text(F.col(f"a.{k}")).alias(k) for k in X.ATTRIBUTES))


@query
def noise_flag_counts(spark, sf):
    flags = X.noise_flags(F.col("raw_text"), F.col("uom_text"), F.col("buyer_sku"), F.col("raw_barcode"))
    return load(spark, sf, "lines").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query
def pack_families(spark, sf):
    return lexical.pack_families(lexical.prepared_items(load(spark, sf, "catalogue")))


@query
def lexical_candidates(spark, sf):
    """Up to three candidates of each line."""
    return _retrieval(spark, sf).select("line_id", F.posexplode("candidates").alias("rank", "c")).select("line_id", (F.col("rank") + 1).alias("rank"), "c.code", F.round("c.score", 6).alias("score"))


@query
def lexical_issues(spark, sf):
    return _joined(_retrieval(spark, sf), "issues").select("line_id", "issues", "exact_unique")


@query
def match_decisions(spark, sf):
    """The matcher from lines to decisions."""
    return decision.decide(_retrieval(spark, sf), None, load(spark, sf, "policy")).drop("candidates")


@query
def match_contract(spark, sf):
    """Rules of the result contract, and rows that break them: decisions as they are (none), then with faults put in."""
    s = Scratch(spark, "contract", frees=True)
    results = s.table(decision.decide(_retrieval(spark, sf, s), None, load(spark, sf, "policy"), keep=["tenant"]).drop("bucket"), "results")
    s.keep(results)
    k = F.substring("line_id", 2, 7).cast("int") % 11
    put = lambda n, c, value: F.when(k == n, value).otherwise(F.col(c)).alias(c)
    code = F.when((k == 3) & (F.col("decision") == "auto"), "").when((k == 4) & (F.col("decision") == "auto"), "NONE").otherwise(F.col("item_code")).alias("item_code")
    faulty = results.select("line_id", "tenant", code, put(0, "confidence", F.lit(1.5)), put(1, "decision", F.lit("maybe")), put(2, "reason_code", F.lit("Not ok")), put(5, "candidates", F.concat("candidates", "candidates")))
    catalogue = load(spark, sf, "catalogue")
    # Some tenants at a time, each part written before the next, so that disk holds the shuffle of one.
    part = lambda rows, p: rows.where(F.pmod(F.xxhash64("tenant"), F.lit(CONTRACT_PARTS)) == p)
    broken = lambda r, kind, p: s.table(decision.violations(part(r, p), None, part(catalogue, p)), f"{kind}-{p}").select(F.lit(kind).alias("results"), F.explode("broken").alias("rule"))
    each = [broken(r, kind, p) for r, kind in ((results, "decided"), (faulty, "faulty")) for p in range(CONTRACT_PARTS)]
    return reduce(DataFrame.unionByName, each).groupBy("results", "rule").agg(F.count("*").alias("broken_rows"))


@query
def predictions(spark, sf):
    """Decisions as the prediction file has them."""
    return files.formatted_predictions(decision.decide(_retrieval(spark, sf), None, load(spark, sf, "policy")))


@query
def proposal_curve(spark, sf):
    return evaluation.proposal_curve(_retrieval(spark, sf), labels=load(spark, sf, "labels_of_lines")).drop("precision")


@query
def review_queue(spark, sf):
    """The first 20 lines whose best candidate is wrong."""
    r = _retrieval(spark, sf).join(load(spark, sf, "labels_of_lines"), "line_id").withColumn("position", F.col("line_id"))
    return evaluation.review_queue(r).select("line_id", "label")


@query
def review_only(spark, sf):
    return decision.review_only(load(spark, sf, "lines"), load(spark, sf, "catalogue")).select("line_id", "reason_code", "decision")


# Evaluation


def _records(spark, sf):
    r = load(spark, sf, "records")
    one = lambda c: F.struct(F.col(c).alias("item_code"), F.lit(0.5).alias("score"))
    candidates = F.slice(F.array(one("first_code"), one("second_code")), 1, F.col("n_candidates").cast("int"))
    flags = F.when(F.col("position") % 6 == 0, F.array(F.lit("pack_word"), F.lit("separator_or_spacing"))).when(F.col("position") % 6 == 1, F.array(F.lit("pack_word"))).otherwise(F.array(F.lit("other")))
    return r.withColumn("candidates", candidates).withColumn("flags", flags)


@query
def evaluation_summary(spark, sf):
    return _rounded(evaluation.summarise(_records(spark, sf)))


@query
def evaluation_segments(spark, sf):
    return _rounded(evaluation.summaries(_records(spark, sf)))


@query
def threshold_curve(spark, sf):
    return _rounded(evaluation.threshold_curve(_records(spark, sf)))


@query
def calibration(spark, sf):
    return _rounded(evaluation.calibration(_records(spark, sf)))


@query
def calibration_error(spark, sf):
    return _rounded(evaluation.calibration_error(_records(spark, sf)))


@query
def bucket_fit(spark, sf):
    right = F.coalesce(F.get("candidates", F.lit(0))["item_code"] == F.col("label"), F.lit(False))
    return _rounded(evaluation.fit_buckets(_records(spark, sf).select("bucket", right.alias("correct"))))


@query
def release_gates(spark, sf):
    """All gates fed: times and digests are made from the tables, one digest of them changed."""
    times = load(spark, sf, "records").select((F.col("position") % 300).cast("double").alias("ms"))
    files_then = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"), "n_nationkey")
    now = files_then.select("path", F.when(F.col("n_nationkey") == 3, "changed").otherwise(F.col("sha256")).alias("sha256"))
    return _rounded(evaluation.gates(evaluation.release_metrics(_records(spark, sf), times, files_then.drop("n_nationkey"), now)))


@query
def line_split(spark, sf):
    """Lines that share a text, target, alias or barcode, together in one partition."""
    return split.build_split(Scratch(spark, "split"), load(spark, sf, "lines").join(load(spark, sf, "labels_of_lines"), "line_id"))


# Sync


def _state(spark, sf):
    empty = lambda n: spark.createDataFrame([], sync.SCHEMAS[n])
    return {"records": load(spark, sf, "local_records"), "outbox": load(spark, sf, "local_outbox"), "applied": empty("applied"), "conflicts": empty("conflicts")}


@query
def feed_page(spark, sf):
    return list_changes(load(spark, sf, "changes"), "2024-01-15 00:00:00", 50)


@query
def latest_versions(spark, sf):
    return sync.latest(load(spark, sf, "changes"))


@query
def sync_classes(spark, sf):
    """What is to be done with the latest changes."""
    return sync.classify(_state(spark, sf), load(spark, sf, "changes")).groupBy("todo").agg(F.count("*").alias("n"))


@query
def sync_records(spark, sf):
    return sync.apply_page(_state(spark, sf), load(spark, sf, "changes"))["records"]


@query
def sync_conflicts(spark, sf):
    return sync.apply_page(_state(spark, sf), load(spark, sf, "changes"))["conflicts"]


@query
def sync_applied(spark, sf):
    return sync.apply_page(_state(spark, sf), load(spark, sf, "changes"))["applied"]


@query
def outbox_staged(spark, sf):
    return sync.stage(_state(spark, sf), "T")["outbox"].select("id", "payload", "base")


@query
def outbox_due(spark, sf):
    state = _state(spark, sf)
    return sync.due(state | {"conflicts": sync.apply_page(state, load(spark, sf, "changes"))["conflicts"]}).select("op", "id")


@query
def sync_settled(spark, sf):
    """The outbox after answers of every kind."""
    state = _state(spark, sf)
    kind = F.when(F.col("base") % 3 == 0, "done").when(F.col("base") % 3 == 1, "uncertain").otherwise("conflict")
    answers = state["outbox"].where("state = 'pending'").select("op", kind.alias("result"), (F.col("base") + 1).alias("version"), F.lit("2024-02-01 00:00:00").alias("updated_at"), F.lit("{}").alias("remote"))
    return sync.settle(state, answers)["outbox"].drop("key")


@query
def sync_invariants(spark, sf):
    changes = load(spark, sf, "changes")
    return sync.invariants(load(spark, sf, "local_records"), sync.latest(changes), changes)


@query
def utc_times(spark, sf):
    c = F.col("updated_at")
    return load(spark, sf, "changes").select("updated_at").distinct().select("updated_at", dates.utc_text(c).alias("utc"), dates.second_before(c).alias("second_before"))


# The queries that read aliases, over those of every part


ALIASED = ("audit_aliases", "alias_targets", "identifier_evidence", "identifier_counters", "lexical_candidates", "lexical_issues", "match_decisions", "match_contract", "predictions", "proposal_curve", "review_queue")


def _over_all(f: Query) -> Query:
    def run(spark, sf):
        with whole_aliases():
            return f(spark, sf)

    return run


QUERIES.update({f"{n}_all": _over_all(QUERIES[n]) for n in ALIASED})
