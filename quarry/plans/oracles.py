"""SQL for the queries of this library, for another engine to check them by."""

from __future__ import annotations

from ..sources.ledger import DUCKDB, ledger_sql
from .inputs import SQL, WHOLE, ctes


def norm(x: str) -> str:
    """Normalised text, for inputs that hold none of the abbreviations."""
    return f"array_to_string(regexp_extract_all(lower({x}), '[0-9]+/[0-9]+|[0-9]+(?:\\.[0-9]+)?|[a-z]+'), ' ')"


def normalised(x: str) -> str:
    """Normalised text, abbreviations and all. Slashes between digits are kept by a mark, put in twice as matches do not overlap."""
    t = f"replace(lower({x}), 'ß', 'ss')"
    for mark in ("″", '"', "''''"):
        t = f"replace({t}, '{mark}', ' inch ')"
    t = f"regexp_replace({t}, '\\bss(\\s*[0-9])', 'stainless \\1', 'g')"
    t = f"regexp_replace({t}, '\\bsds\\b', 'self drilling screw', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([0-9])/([0-9])', '\\1§\\2', 'g')"
    t = f"replace(replace({t}, '/', ' '), '§', '/')"
    for pattern, word in (("z\\s*\\.\\s*p\\.?", "zinc plated"), ("zp", "zinc plated"), ("s\\s*/?\\s*s", "stainless"), ("skru", "screw"), ("ayam", "chicken"), ("susu", "milk")):
        t = f"regexp_replace({t}, '\\b{pattern}\\b', '{word}', 'g')"
    return f"array_to_string(regexp_extract_all({t}, '[0-9]+/[0-9]+|[0-9]+(?:\\.[0-9]+)?|[a-z]+'), ' ')"


ELIGIBLE = "(disabled = '0' AND NOT ends_with(item_code, '-OLD') AND upper(trim(item_name)) NOT IN ('DELIVERY FEE', 'OPENING BALANCE'))"

EVIDENCE = f"""
idx AS (SELECT DISTINCT tenant, item_code AS value, item_code AS code, 'item_code' AS source FROM catalogue UNION SELECT DISTINCT tenant, barcode, item_code, 'barcode' FROM catalogue WHERE barcode <> ''),
own AS (SELECT * FROM lines WHERE tenant IN (SELECT tenant FROM catalogue)),
vals AS (SELECT line_id, tenant, unnest(list_distinct(list_concat(regexp_extract_all(raw_text, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*'), CASE WHEN raw_barcode <> '' THEN [raw_barcode] ELSE [] END))) AS value FROM own),
hits AS (SELECT line_id, value, code, source FROM vals JOIN idx USING (tenant, value)),
ali AS (SELECT o.line_id, a.item_code AS target, try_cast(o.order_date AS DATE) AS d,
   CASE WHEN valid_from = '' THEN DATE '0001-01-01' ELSE try_cast(valid_from AS DATE) END AS s, CASE WHEN valid_to = '' THEN DATE '9999-12-31' ELSE try_cast(valid_to AS DATE) END AS e,
   (a.source <> 'confirmed_order' OR coalesce(try_cast(confidence AS DOUBLE), -1) <> 1) AS weak
  FROM own o LEFT JOIN aliases a ON o.tenant = a.tenant AND o.customer_id = a.customer_id AND o.buyer_sku = a.customer_sku WHERE o.buyer_sku <> ''),
ali2 AS (SELECT *, target IS NOT NULL AND NOT coalesce(s <= e, false) AS bad, coalesce(target IS NOT NULL AND s <= e AND d BETWEEN s AND e, false) AS active FROM ali),
per AS (SELECT line_id, bool_or(target IS NOT NULL) AS f, bool_or(d IS NULL) AS nod, bool_or(bad) AS bad, bool_or(active) AS act, bool_or(active AND weak) AS weak FROM ali2 GROUP BY line_id),
targets AS (SELECT line_id, code, source FROM hits UNION SELECT line_id, target, 'buyer_alias' FROM ali2 WHERE active),
tgt AS (SELECT t.line_id, t.code, coalesce({ELIGIBLE}, false) AS ok,
   len(list_filter(regexp_extract_all(regexp_replace(o.raw_text, 'P-[0-9]{{6}}(-OLD)?', ' ', 'g'), '[0-9]+(?:[./][0-9]+)?'), lambda x: NOT list_contains(regexp_extract_all(c.item_name, '[0-9]+(?:[./][0-9]+)?'), x))) > 0 AS odd
  FROM (SELECT DISTINCT line_id, code FROM targets) t JOIN own o USING (line_id) LEFT JOIN catalogue c ON c.tenant = o.tenant AND c.item_code = t.code),
raw_issues AS (
  SELECT line_id, 'unknown_tenant' AS issue FROM lines WHERE tenant NOT IN (SELECT tenant FROM catalogue)
  UNION SELECT line_id, 'unresolved_explicit_barcode' FROM own WHERE raw_barcode <> '' AND NOT EXISTS (SELECT 1 FROM idx WHERE idx.tenant = own.tenant AND idx.value = own.raw_barcode)
  UNION SELECT line_id, 'unresolved_buyer_sku' FROM per WHERE NOT f
  UNION SELECT line_id, 'invalid_order_date' FROM per WHERE nod
  UNION SELECT line_id, 'invalid_alias_dates' FROM per WHERE NOT nod AND bad
  UNION SELECT line_id, 'untrusted_alias_metadata' FROM per WHERE NOT nod AND weak
  UNION SELECT line_id, 'no_date_valid_alias' FROM per WHERE NOT nod AND f AND NOT act
  UNION SELECT line_id, 'identifier_conflict' FROM tgt GROUP BY line_id HAVING count(*) > 1
  UNION SELECT line_id, 'ineligible_identifier_target' FROM tgt WHERE NOT ok
  UNION SELECT line_id, 'numeric_text_conflict_or_unparsed_quantity' FROM tgt WHERE ok AND odd),
ev AS (SELECT l.line_id,
   coalesce((SELECT list(code ORDER BY code) FROM tgt t WHERE t.line_id = l.line_id AND ok), []) AS codes,
   coalesce((SELECT list(source ORDER BY source) FROM (SELECT DISTINCT source FROM targets t WHERE t.line_id = l.line_id)), []) AS sources,
   coalesce((SELECT list(issue ORDER BY issue) FROM raw_issues r WHERE r.line_id = l.line_id), []) AS issues
  FROM lines l)"""

RETRIEVAL = f"""
items AS (SELECT tenant, item_code AS code, {norm('item_name')} AS name, {norm('brand')} AS brand, lower(stock_uom) AS uom, uom_conversions AS packs FROM catalogue WHERE {ELIGIBLE}),
it AS (SELECT *, list_contains(string_split(name, ' '), 'bulk') AS bulk, trim(regexp_replace(name, '\\bbulk\\b', '', 'g')) AS stem,
   list_sort(list_distinct(list_transform(regexp_extract_all(name, '([0-9]+(?:\\.[0-9]+)?)\\s*mm\\b', 1), lambda x: CAST(x AS DOUBLE)))) AS len_, list_sort(list_distinct(regexp_extract_all(name, '\\b(red|blue)\\b', 1))) AS col_ FROM items),
fam AS (SELECT tenant, brand, stem, uom FROM it GROUP BY ALL HAVING count(*) > 1 AND bool_or(bulk) AND count(DISTINCT packs) > 1),
q0 AS (SELECT l.line_id, l.tenant, {norm('l.raw_text')} AS query, {norm("regexp_replace(l.raw_text, 'P-[0-9]{6}(-OLD)?', ' ', 'g')")} AS bare FROM lines l),
q AS (SELECT *, CASE WHEN tenant NOT IN (SELECT tenant FROM catalogue) THEN 'unknown_tenant' WHEN query = '' THEN 'empty_text' WHEN query IN ('delivery charge', 'delivery fee', 'opening balance') THEN 'not_an_item' END AS early,
   list_sort(list_distinct(list_transform(regexp_extract_all(bare, '([0-9]+(?:\\.[0-9]+)?)\\s*mm\\b', 1), lambda x: CAST(x AS DOUBLE)))) AS qlen, list_sort(list_distinct(regexp_extract_all(bare, '\\b(red|blue)\\b', 1))) AS qcol,
   list_filter(['branda', 'brandb'], lambda b: contains(' ' || query || ' ', ' ' || b || ' ')) AS mentioned FROM q0),
qt AS (SELECT line_id, tenant, tok, count(*) AS c FROM (SELECT line_id, tenant, unnest(string_split(query, ' ')) AS tok FROM q WHERE early IS NULL) GROUP BY ALL),
itt AS (SELECT tenant, code, tok, count(*) AS c FROM (SELECT tenant, code, unnest(string_split(name, ' ')) AS tok FROM it) GROUP BY ALL),
qg AS (SELECT line_id, tenant, g, count(*) AS c FROM (SELECT line_id, tenant, unnest(list_transform(range(1, length(query) + 1), lambda i: substr(' ' || query || ' ', i, 3))) AS g FROM q WHERE early IS NULL) GROUP BY ALL),
ig AS (SELECT tenant, code, g, count(*) AS c FROM (SELECT tenant, code, unnest(list_transform(range(1, length(name) + 1), lambda i: substr(' ' || name || ' ', i, 3))) AS g FROM it) GROUP BY ALL),
dt AS (SELECT line_id, code, sum(a.c * b.c) AS d FROM qt a JOIN itt b ON a.tenant = b.tenant AND a.tok = b.tok GROUP BY ALL),
dg AS (SELECT line_id, code, sum(a.c * b.c) AS d FROM qg a JOIN ig b ON a.tenant = b.tenant AND a.g = b.g GROUP BY ALL),
nqt AS (SELECT line_id, sum(c * c) AS n FROM qt GROUP BY ALL), nit AS (SELECT tenant, code, sum(c * c) AS n FROM itt GROUP BY ALL),
nqg AS (SELECT line_id, sum(c * c) AS n FROM qg GROUP BY ALL), nig AS (SELECT tenant, code, sum(c * c) AS n FROM ig GROUP BY ALL),
sc AS (SELECT q.line_id, q.tenant, it.code, it.name, q.query, it.brand, it.stem, it.uom, it.len_, it.col_, list_contains(ev.codes, it.code) AS ided,
   round(CASE WHEN list_contains(ev.codes, it.code) THEN greatest(s, 0.99) ELSE s END, 8) AS score,
   (len(qcol) > 0 AND len(col_) > 0 AND qcol <> col_) OR (len(qlen) > 0 AND len(len_) > 0 AND qlen <> len_) OR (len(mentioned) > 0 AND NOT list_contains(mentioned, it.brand)) AS bad
  FROM (SELECT q.*, it.code AS icode, 0.55 * coalesce(dt.d / sqrt(nqt.n * nit.n), 0) + 0.45 * coalesce(dg.d / sqrt(nqg.n * nig.n), 0) AS s FROM q JOIN it ON q.tenant = it.tenant
     LEFT JOIN dt ON dt.line_id = q.line_id AND dt.code = it.code LEFT JOIN dg ON dg.line_id = q.line_id AND dg.code = it.code
     LEFT JOIN nqt ON nqt.line_id = q.line_id LEFT JOIN nqg ON nqg.line_id = q.line_id LEFT JOIN nit ON nit.tenant = it.tenant AND nit.code = it.code LEFT JOIN nig ON nig.tenant = it.tenant AND nig.code = it.code
     WHERE q.early IS NULL) q JOIN it ON it.tenant = q.tenant AND it.code = q.icode JOIN ev ON ev.line_id = q.line_id),
fit AS (SELECT s.*, f.stem IS NOT NULL AS packed FROM sc s LEFT JOIN fam f USING (tenant, brand, stem, uom) WHERE NOT bad),
fams AS (SELECT line_id, tenant, brand, stem, uom, max(score) AS best, any_value(list_filter(['bulk', 'standard'], lambda w: list_contains(string_split(query, ' '), w))) AS asked FROM fit WHERE packed GROUP BY ALL),
sib0 AS (SELECT f.*, it.code, it.bulk, len(ev.codes) = 1 AND len(ev.issues) = 0 AND EXISTS (SELECT 1 FROM it k WHERE k.tenant = f.tenant AND k.brand = f.brand AND k.stem = f.stem AND k.uom = f.uom AND k.code = ev.codes[1]) AS own, ev.codes[1] AS sole
  FROM fams f JOIN it USING (tenant, brand, stem, uom) JOIN ev USING (line_id)),
sib AS (SELECT *, (CASE WHEN len(asked) = 1 THEN bulk = (asked[1] = 'bulk') ELSE true END) AND (NOT own OR code = sole) AS chosen FROM sib0),
sib2 AS (SELECT *, NOT bool_or(chosen) OVER (PARTITION BY line_id, brand, stem, uom) OR len(asked) > 1 AS stuck FROM sib),
rem AS (SELECT * FROM fit WHERE NOT EXISTS (SELECT 1 FROM sib2 x WHERE x.line_id = fit.line_id AND x.code = fit.code AND NOT x.stuck AND NOT x.chosen)),
rk AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, code) AS rank FROM rem),
top AS (SELECT * FROM rk WHERE rank <= 3 AND score >= 0.25),
h AS (SELECT t.*, (SELECT score FROM top u WHERE u.line_id = t.line_id AND u.rank = 2) AS second,
   (SELECT count(*) FROM rk r WHERE t.packed AND r.line_id = t.line_id AND r.brand = t.brand AND r.stem = t.stem AND r.uom = t.uom) AS kin FROM top t WHERE rank = 1),
ex AS (SELECT line_id, count(*) FILTER (WHERE name = query) AS exact FROM rk GROUP BY line_id),
tc AS (SELECT DISTINCT line_id FROM sc WHERE ided AND bad),
sup AS (SELECT h.line_id, len(ev.codes) = 1 AND len(ev.issues) = 0 AND ev.codes[1] = h.code AND h.line_id NOT IN (SELECT line_id FROM tc) AS ok FROM h JOIN ev USING (line_id)),
iss AS (
  SELECT line_id, early AS issue FROM q WHERE early IS NOT NULL
  UNION SELECT q.line_id, x.issue FROM q JOIN raw_issues x USING (line_id) WHERE early IS NULL
  UNION SELECT line_id, 'identifier_text_conflict' FROM tc
  UNION SELECT line_id, 'pack_evidence_conflict' FROM sib2 WHERE stuck AND best >= 0.25
  UNION SELECT line_id, 'ambiguous_pack' FROM h WHERE kin > 1
  UNION SELECT line_id, 'ambiguous_exact_names' FROM ex WHERE exact > 1
  UNION SELECT line_id, 'no_candidate_above_floor' FROM q WHERE early IS NULL AND line_id NOT IN (SELECT line_id FROM h)
  UNION SELECT line_id, 'small_candidate_margin' FROM h WHERE CASE WHEN second IS NULL THEN score ELSE score - second END < 0.05
  UNION SELECT h.line_id, 'complex_request' FROM h WHERE regexp_matches(query, '\\b(not|except|instead|or)\\b')
  UNION SELECT h.line_id, 'missing_length' FROM h JOIN sup USING (line_id) JOIN q USING (line_id) WHERE NOT sup.ok AND len(h.len_) > 0 AND len(qlen) = 0
  UNION SELECT h.line_id, 'missing_colour' FROM h JOIN sup USING (line_id) JOIN q USING (line_id) WHERE NOT sup.ok AND len(h.col_) > 0 AND len(qcol) = 0),
il AS (SELECT line_id, list(issue ORDER BY issue) AS issues FROM iss GROUP BY line_id),
ret AS (SELECT q.line_id, coalesce((SELECT list(code ORDER BY rank) FROM top t WHERE t.line_id = q.line_id), []) AS codes, coalesce((SELECT list(score ORDER BY rank) FROM top t WHERE t.line_id = q.line_id), []) AS scores,
   coalesce(il.issues, []) AS issues, early IS NULL AND coalesce(ex.exact, 0) = 1 AS exact_unique
  FROM q LEFT JOIN il USING (line_id) LEFT JOIN ex USING (line_id)),
dec AS (SELECT r.*, ev.codes AS ecodes, CASE WHEN len(r.codes) = 0 THEN 'no_candidate' WHEN len(r.issues) > 0 THEN 'blocked' WHEN len(ev.codes) = 1 AND ev.codes[1] = r.codes[1] THEN 'identifier' WHEN exact_unique THEN 'lexical_exact' WHEN r.scores[1] >= 0.9 THEN 'lexical_high' ELSE 'lexical_other' END AS bucket FROM ret r JOIN ev USING (line_id))"""

MATCH = ctes("catalogue", "lines", "aliases") + "," + EVIDENCE
FULL = MATCH + "," + RETRIEVAL


def report(prefix: str, first: str, last: str, prior: str, given: str | None = None) -> str:
    """The report as scalar subqueries over groups. given: common table expressions of its inputs."""
    c = given or ctes(f"{prefix}_tenants", f"{prefix}_lines", f"{prefix}_events", f"{prefix}_items")
    return f"""{c},
t AS (SELECT * FROM {prefix}_tenants), ol AS (SELECT * FROM {prefix}_lines), me AS (SELECT * FROM {prefix}_events), im AS (SELECT * FROM {prefix}_items WHERE disabled = 1),
g AS (SELECT ol.tenant_id, plan, channel, day, count(DISTINCT line_id) AS lines_total, count(DISTINCT customer_id) AS distinct_customers FROM ol JOIN t ON ol.tenant_id = t.tenant_id WHERE day BETWEEN '{first}' AND '{last}' GROUP BY ALL),
a AS (SELECT me.tenant_id, channel, ol.day, count(DISTINCT me.line_id) AS n FROM me JOIN ol ON me.line_id = ol.line_id WHERE accepted = 1 GROUP BY ALL),
o AS (SELECT ol.tenant_id, channel, ol.day, count(*) AS n FROM me JOIN ol ON me.line_id = ol.line_id GROUP BY ALL),
e AS (SELECT tenant_id, day, CAST(sum(CAST(score AS DECIMAL(28,12))) FILTER (WHERE accepted = 1) AS DOUBLE) / nullif(count(score) FILTER (WHERE accepted = 1), 0) AS s, max(latency_ms) AS mx, avg(latency_ms) AS av, quantile_disc(latency_ms, 0.95) AS p FROM me GROUP BY ALL),
seen AS (SELECT DISTINCT tenant_id, day, item_code FROM me WHERE accepted = 1),
r AS (SELECT x.tenant_id, x.day, count(*) AS n FROM seen x SEMI JOIN seen y ON x.tenant_id = y.tenant_id AND x.item_code = y.item_code AND y.day = {prior.format('x.day')} GROUP BY ALL),
d AS (SELECT me.tenant_id, me.day, count(*) AS n FROM me JOIN im ON me.tenant_id = im.tenant_id AND me.item_code = im.item_code WHERE accepted = 1 GROUP BY ALL)
SELECT g.tenant_id, g.plan, g.channel, g.day, lines_total, coalesce(a.n, 0) AS lines_accepted, coalesce(o.n, 0) AS candidates_considered, round(s, 6) AS avg_accept_score, mx AS max_latency_ms, round(av, 6) AS avg_latency_ms, distinct_customers, coalesce(r.n, 0) AS repeat_items_prev_day, coalesce(d.n, 0) AS accepted_disabled, CAST(p AS DOUBLE) AS p95_latency_ms
FROM g LEFT JOIN a ON (a.tenant_id, a.channel, a.day) = (g.tenant_id, g.channel, g.day) LEFT JOIN o ON (o.tenant_id, o.channel, o.day) = (g.tenant_id, g.channel, g.day)
LEFT JOIN e ON (e.tenant_id, e.day) = (g.tenant_id, g.day) LEFT JOIN r ON (r.tenant_id, r.day) = (g.tenant_id, g.day) LEFT JOIN d ON (d.tenant_id, d.day) = (g.tenant_id, g.day)"""


DAY_BEFORE = "strftime(CAST({0} AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d')"
#: Also of days beyond a month's end.
DAY_BEFORE_ANY = "strftime(CAST(substr({0}, 1, 8) || '01' AS DATE) + to_days(CAST(substr({0}, 9, 2) AS INT) - 2), '%Y-%m-%d')"
LEDGER = "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in zip(("ledger_tenants", "ledger_items", "ledger_lines", "ledger_events"), ledger_sql(DUCKDB).values()))
MONTH_BEFORE = "strftime(CAST({0} || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')"

HIT = "(label <> '' AND (first_code = label AND n_candidates > 0 OR second_code = label AND n_candidates > 1))"
TOP_RIGHT = "(n_candidates > 0 AND first_code = label)"
SUMMARY = f"""count(*) AS lines, count(*) FILTER (WHERE decision = 'auto') AS auto,
 count(*) FILTER (WHERE decision = 'auto' AND label <> '' AND item_code = label) AS correct_auto, count(*) FILTER (WHERE decision = 'auto' AND NOT (label <> '' AND item_code = label)) AS wrong_auto,
 count(*) FILTER (WHERE decision = 'review') AS review, count(*) FILTER (WHERE decision = 'reject') AS reject, count(*) FILTER (WHERE label <> '') AS answerable, count(*) FILTER (WHERE label = '') AS unanswerable,
 count(*) FILTER (WHERE decision <> 'auto' AND label = '') AS correct_abstentions, count(*) FILTER (WHERE decision <> 'auto' AND label <> '') AS answerable_abstentions,
 count(*) FILTER (WHERE {HIT}) AS top3_hits, count(*) FILTER (WHERE decision <> 'auto' AND {HIT}) AS abstained_top3_hits"""
RATES = """round(correct_auto / nullif(auto, 0), 9) AS precision, round(auto / nullif(lines, 0), 9) AS coverage, round((correct_auto + correct_abstentions) / nullif(lines, 0), 9) AS accuracy_including_correct_abstention,
 round(correct_abstentions / nullif(unanswerable, 0), 9) AS blank_label_abstention_rate, round(top3_hits / nullif(answerable, 0), 9) AS recall_at_3, round(abstained_top3_hits / nullif(answerable_abstentions, 0), 9) AS recall_at_3_on_answerable_abstentions,
 20 * correct_auto - 800 * wrong_auto - 40 * (review + reject) AS utility_seconds_equivalent, 60 * correct_auto - 760 * wrong_auto AS improvement_over_all_review"""
FLAGGED = """fl AS (SELECT *, CASE WHEN position % 6 = 0 THEN ['pack_word', 'separator_or_spacing'] WHEN position % 6 = 1 THEN ['pack_word'] ELSE ['other'] END AS flags FROM records)"""
FEED = """lc AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY version DESC) = 1),
cl AS (SELECT lc.*, CASE WHEN r.dirty THEN CASE WHEN lc.version <> r.version THEN CASE WHEN coalesce(lc.version = o.base + 1 AND lc.payload = o.payload, false) THEN 'own' ELSE 'conflict' END ELSE 'skip' END
   WHEN r.version >= lc.version THEN 'skip' ELSE 'apply' END AS todo
  FROM lc LEFT JOIN local_records r ON r.id = lc.external_id LEFT JOIN (SELECT * FROM local_outbox WHERE state IN ('pending', 'uncertain')) o ON o.id = lc.external_id)"""
UTC = "strftime(CAST({0} AS TIMESTAMP) - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
SYNC = ctes("changes", "local_records", "local_outbox") + "," + FEED

DECIDED = FULL + ", " + ctes("policy").removeprefix("WITH ") + """, m0 AS (SELECT d.*, p.probability, len(d.issues) = 0 AND coalesce(p.enabled, false) AND len(d.codes) > 0 AS auto FROM dec d LEFT JOIN policy p USING (bucket)),
m AS (SELECT line_id, bucket, auto, codes, scores, CASE WHEN auto THEN codes[1] ELSE '' END AS item_code, CAST(coalesce(probability, 0) AS DOUBLE) AS confidence, CASE WHEN list_contains(issues, 'not_an_item') THEN 'reject' WHEN auto THEN 'auto' ELSE 'review' END AS decision,
 CASE WHEN len(issues) > 0 THEN issues[1] WHEN auto AND bucket = 'identifier' THEN 'identifier_verified' ELSE bucket END AS reason_code FROM m0)"""

ORACLES = {
    "report_days": report("day", "2024-01-02", "2024-01-29", DAY_BEFORE),
    "report_months": report("month", "1996-01", "1999-12", MONTH_BEFORE),
    "report_slice": f"SELECT tenant_id, plan, channel, day, lines_total, lines_accepted, distinct_customers FROM ({report('day', '2024-01-05', '2024-01-08', DAY_BEFORE)}) WHERE tenant_id IN ('T1', 'T4')",
    "report_rerun_differences": f"""WITH a AS ({report('day', '2024-01-10', '2024-01-12', DAY_BEFORE)}), b AS ({report('day', '2024-01-10', '2024-01-12', DAY_BEFORE).replace('me AS (SELECT * FROM day_events)', "me AS (SELECT * FROM day_events WHERE item_code <> 'I7')")})
SELECT 'a' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'b', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT 'none', 0""",
    "report_seeded_ledger": report("ledger", "2026-04-28", "2026-06-31", DAY_BEFORE_ANY, LEDGER).replace("round(s, 6)", "round(s, 12)").replace("round(av, 6)", "round(av, 12)"),
    "p95_by_window": ctes("day_events") + " SELECT tenant_id, day, CAST(quantile_disc(latency_ms, 0.95) AS DOUBLE) AS p95_latency_ms FROM day_events GROUP BY ALL",
    "previous_days": """SELECT DISTINCT d, strftime(CAST(substr(d, 1, 8) || '01' AS DATE) + to_days(CAST(CAST(substr(d, 9, 2) AS INT) - 2 AS INT)), '%Y-%m-%d') AS before
FROM (SELECT substr(CAST(o_orderdate AS STRING), 1, 8) || lpad(CAST(1 + o_orderkey % 31 AS STRING), 2, '0') AS d FROM orders)""",
    "catalogue_eligible": ctes("catalogue") + f" SELECT tenant, item_code, {ELIGIBLE} AS eligible FROM catalogue",
    "audit_catalogue": ctes("catalogue") + """, s AS (SELECT tenant, upper(trim(item_name)) AS n FROM catalogue WHERE disabled = '0' GROUP BY ALL HAVING count(*) > 1), k AS (SELECT tenant, count(*) AS n FROM s GROUP BY ALL)
SELECT tenant, count(*) AS "rows", count(*) FILTER (WHERE disabled = '1') AS disabled, coalesce(any_value(k.n), 0) AS duplicate_name_groups FROM catalogue LEFT JOIN k USING (tenant) GROUP BY tenant""",
    "audit_aliases": ctes("aliases") + """, k AS (SELECT count(DISTINCT item_code) AS t, count(*) AS n, count(*) FILTER (WHERE source = 'inferred_match') AS i, count(*) FILTER (WHERE try_cast(confidence AS DOUBLE) < 1) AS w, count(*) FILTER (WHERE valid_to <> '') AS e FROM aliases GROUP BY tenant, customer_id, customer_sku)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS "rows", count(*) FILTER (WHERE t > 1) AS ambiguous_keys, CAST(coalesce(sum(i), 0) AS BIGINT) AS inferred, CAST(coalesce(sum(w), 0) AS BIGINT) AS below_full_confidence, CAST(coalesce(sum(e), 0) AS BIGINT) AS with_end_date FROM k""",
    "identifier_index": MATCH + " SELECT tenant, value, code, source FROM idx",
    "identifier_hits": MATCH + " SELECT line_id, value, code, source FROM hits",
    "identifier_evidence": MATCH + " SELECT line_id, array_to_string(codes, '|') AS codes, array_to_string(sources, '|') AS sources, array_to_string(issues, '|') AS issues FROM ev",
    "identifier_cold_start": ctes("catalogue", "lines") + ", aliases AS (SELECT '' AS tenant, '' AS customer_id, '' AS customer_sku, '' AS item_code, '' AS valid_from, '' AS valid_to, '' AS source, '' AS confidence WHERE false)," + EVIDENCE + " SELECT line_id, array_to_string(codes, '|') AS codes, array_to_string(issues, '|') AS issues FROM ev",
    "identifier_counters": MATCH + ", " + ctes("labels_of_lines").removeprefix("WITH ") + """, j AS (SELECT ev.*, label FROM ev JOIN labels_of_lines USING (line_id)),
c AS (SELECT 'lines' AS counter FROM j UNION ALL SELECT 'with_candidates' FROM j WHERE len(codes) > 0 UNION ALL SELECT 'target_retrieved' FROM j WHERE label <> '' AND list_contains(codes, label) UNION ALL SELECT 'unique_without_issue' FROM j WHERE len(codes) = 1 AND len(issues) = 0 UNION ALL SELECT 'issue:' || unnest(issues) FROM j)
SELECT counter, count(*) AS n FROM c GROUP BY counter""",
    "alias_targets": MATCH + " SELECT DISTINCT line_id, target AS code FROM ali2 WHERE active",
    "normalised_texts": ctes("texts") + f" SELECT line_id, {normalised('raw_text')} AS normalised, array_to_string(regexp_extract_all(replace(lower(raw_text), 'ß', 'ss'), '\\w+'), ' ') AS word_key FROM texts",
    "item_attributes": ctes("texts") + f""", n AS (SELECT line_id, {normalised('raw_text')} AS name FROM texts),
q AS (SELECT line_id, name, unnest(regexp_extract_all(name, '([0-9]+/[0-9]+|[0-9]+(?:\\.[0-9]+)?)\\s*(mm|cm|inch|kg|g|ml|l)\\b', 1)) AS v, unnest(regexp_extract_all(name, '([0-9]+/[0-9]+|[0-9]+(?:\\.[0-9]+)?)\\s*(mm|cm|inch|kg|g|ml|l)\\b', 2)) AS u FROM n),
w AS (SELECT line_id, CASE WHEN u IN ('mm', 'cm', 'inch') THEN 'length' WHEN u IN ('kg', 'g') THEN 'weight' ELSE 'volume' END AS kind,
  CAST(round(round(CAST(split_part(v, '/', 1) AS DOUBLE) / nullif(CASE WHEN contains(v, '/') THEN CAST(split_part(v, '/', 2) AS DOUBLE) ELSE 1 END, 0) * CASE u WHEN 'cm' THEN 10 WHEN 'inch' THEN 25.4 WHEN 'kg' THEN 1000 WHEN 'l' THEN 1000 ELSE 1 END, 6) * 1000) AS BIGINT) AS x FROM q),
g AS (SELECT line_id, {', '.join(f"coalesce(array_to_string(list_transform(list_sort(list_distinct(list(x) FILTER (WHERE kind = '{k}' AND x IS NOT NULL))), lambda y: CAST(y AS STRING)), '|'), '') AS {k}" for k in ('length', 'weight', 'volume'))} FROM w GROUP BY line_id)
SELECT n.line_id, {', '.join(f"coalesce(g.{k}, '') AS {k}" for k in ('length', 'weight', 'volume'))}, {', '.join(f"array_to_string(list_sort(list_distinct(regexp_extract_all(name, '{p}', 1))), '|') AS {k}" for k, p in (('colour', '\\b(red|blue|brown|white|black|yellow|green)\\b'), ('grade', '\\bclass ([a-z])\\b'), ('disc_kind', '\\b(grinding|cutting|flap)\\b'), ('material', '\\b(stainless|zinc plated|brass|pvc|hdg)\\b'), ('steel_grade', '\\bstainless (304|316|410)\\b')))}
FROM n LEFT JOIN g ON n.line_id = g.line_id""",
    "noise_flag_counts": ctes("lines") + """, f AS (SELECT unnest(CASE WHEN len(x) = 0 THEN ['other'] ELSE x END) AS flag FROM (SELECT list_filter([CASE WHEN buyer_sku <> '' OR raw_barcode <> '' THEN 'structured_identifier' END, CASE WHEN regexp_matches(raw_text || ' ' || uom_text, '(?i)\\b(?:ctn|carton|box|case|pack|packet)\\b') THEN 'pack_word' END,
 CASE WHEN regexp_matches(raw_text, '(?i)[0-9]\\s*(?:mm|cm|kg|inch|"|″)') THEN 'dimension_or_weight_token' END, CASE WHEN regexp_matches(raw_text, '(?i)\\b(?:skru|ayam|susu)\\b') THEN 'selected_malay_word' END, CASE WHEN contains(raw_text, '/') OR contains(raw_text, '  ') THEN 'separator_or_spacing' END], lambda v: v IS NOT NULL) AS x FROM lines))
SELECT flag, count(*) AS n FROM f GROUP BY flag""",
    "pack_families": FULL + " SELECT tenant, brand, stem, uom FROM fam",
    "lexical_candidates": FULL + " SELECT line_id, CAST(rank AS INT) AS rank, code, round(score, 6) AS score FROM top",
    "lexical_issues": FULL + " SELECT line_id, array_to_string(issues, '|') AS issues, exact_unique FROM ret",
    "match_decisions": DECIDED + " SELECT line_id, bucket, item_code, confidence, decision, reason_code FROM m",
    "match_contract": DECIDED + """, x AS (SELECT *, CAST(substr(line_id, 2) AS INT) % 11 AS k, len(codes) AS n FROM m),
r AS (SELECT 'confidence_range' AS rule FROM x WHERE k = 0 UNION ALL SELECT 'unknown_decision' FROM x WHERE k = 1 UNION ALL SELECT 'reason_token' FROM x WHERE k = 2 UNION ALL SELECT 'auto_needs_code' FROM x WHERE k IN (1, 3) AND auto
 UNION ALL SELECT unnest(['ineligible_item', 'item_not_first']) FROM x WHERE k = 4 AND auto UNION ALL SELECT 'too_many_candidates' FROM x WHERE k = 5 AND 2 * n > 3 UNION ALL SELECT 'duplicate_candidates' FROM x WHERE k = 5 AND n > 0 UNION ALL SELECT 'unsorted_candidates' FROM x WHERE k = 5 AND n > 1)
SELECT 'faulty' AS results, rule, count(*) AS broken_rows FROM r GROUP BY rule""",
    "predictions": DECIDED + """ SELECT line_id, item_code, printf('%.8f', confidence) AS confidence, decision, reason_code, array_to_string(list_transform(range(1, len(codes) + 1), lambda i: codes[i] || ':' || printf('%.8f', scores[i])), '|') AS candidates FROM m""",
    "proposal_curve": FULL + ", " + ctes("labels_of_lines").removeprefix("WITH ") + """, z AS (SELECT ret.*, label, coalesce(CASE WHEN len(scores) > 1 THEN scores[1] - scores[2] ELSE scores[1] END, 0) AS margin FROM ret JOIN labels_of_lines USING (line_id)), t AS (SELECT unnest([0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0]::DOUBLE[]) AS threshold)
SELECT threshold, count(*) FILTER (WHERE len(codes) > 0 AND len(issues) = 0 AND scores[1] >= threshold AND margin >= 0.05) AS proposed, count(*) FILTER (WHERE len(codes) > 0 AND len(issues) = 0 AND scores[1] >= threshold AND margin >= 0.05 AND codes[1] = label) AS correct FROM z, t GROUP BY threshold""",
    "review_queue": FULL + ", " + ctes("labels_of_lines").removeprefix("WITH ") + " SELECT line_id, label FROM ret JOIN labels_of_lines USING (line_id) WHERE label <> '' AND (len(codes) = 0 OR codes[1] <> label) ORDER BY line_id LIMIT 20",
    "review_only": ctes("lines", "catalogue") + " SELECT line_id, CASE WHEN tenant IN (SELECT tenant FROM catalogue) THEN 'baseline_review' ELSE 'unknown_tenant' END AS reason_code, 'review' AS decision FROM lines",
    "evaluation_summary": ctes("records") + f", s AS (SELECT {SUMMARY} FROM records) SELECT *, {RATES} FROM s",
    "evaluation_segments": ctes("records") + f", {FLAGGED}, x AS (SELECT *, 'overall' AS scope, 'all' AS segment FROM fl UNION ALL SELECT *, 'tenant', tenant FROM fl UNION ALL SELECT *, 'noise_flag', unnest(flags) FROM fl), s AS (SELECT scope, segment, {SUMMARY} FROM x GROUP BY scope, segment) SELECT *, {RATES} FROM s",
    "threshold_curve": ctes("records") + f", x AS (SELECT r.* REPLACE (CASE WHEN decision = 'auto' AND confidence < threshold THEN 'review' ELSE decision END AS decision, CASE WHEN decision = 'auto' AND confidence < threshold THEN '' ELSE item_code END AS item_code), threshold FROM records r, (SELECT unnest([0, 0.93, 0.95, 0.975, 0.99, 1]::DOUBLE[]) AS threshold)), s AS (SELECT threshold, {SUMMARY} FROM x GROUP BY threshold) SELECT *, {RATES} FROM s",
    "calibration": ctes("records") + f" SELECT printf('%.6f', confidence) AS bucket_confidence, count(*) AS n, count(*) FILTER (WHERE {TOP_RIGHT}) AS correct, max(confidence) AS confidence, round(count(*) FILTER (WHERE {TOP_RIGHT}) / count(*), 9) AS observed FROM records GROUP BY 1",
    "calibration_error": ctes("records") + f", b AS (SELECT confidence, count(*) AS n, count(*) FILTER (WHERE {TOP_RIGHT}) / count(*) AS o FROM records GROUP BY 1) SELECT (SELECT round(sum(n * abs(confidence - o)) / sum(n), 9) FROM b) AS ece, (SELECT round(avg(pow(confidence - CASE WHEN {TOP_RIGHT} THEN 1 ELSE 0 END, 2)), 9) FROM records) AS brier",
    "bucket_fit": ctes("records") + f""", b AS (SELECT bucket, count(*) AS n, count(*) FILTER (WHERE {TOP_RIGHT}) AS correct FROM records GROUP BY bucket),
w AS (SELECT *, CASE WHEN bucket = 'no_candidate' THEN 0.0 ELSE (correct + 1) / (n + 2) END AS probability, correct / n AS p, (correct / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS c, 1.96 * sqrt(correct / n * (1 - correct / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) AS h FROM b)
SELECT bucket, n, correct, round(probability, 9) AS probability, round(p, 9) AS observed_precision, round(greatest(0, c - h), 9) AS wilson_low, round(least(1, c + h), 9) AS wilson_high, bucket NOT IN ('blocked', 'no_candidate') AND n >= 10 AND p >= 0.98 AND probability > 760 / 820 AS enabled FROM w""",
    "release_gates": ctes("records") + f", b AS (SELECT confidence, count(*) AS n, count(*) FILTER (WHERE {TOP_RIGHT}) / count(*) AS o FROM records GROUP BY 1), ce AS (SELECT (SELECT sum(n * abs(confidence - o)) / sum(n) FROM b) AS ece, (SELECT avg(pow(confidence - CASE WHEN {TOP_RIGHT} THEN 1 ELSE 0 END, 2)) FROM records) AS brier), s AS (SELECT {SUMMARY} FROM records), r AS (SELECT *, {RATES} FROM s), g AS (SELECT unnest(['lines =', 'wrong_auto =', 'precision >=', 'coverage >=', 'improvement_over_all_review >=', 'recall_at_3 >=', 'ece <=', 'brier <=', 'warm_p95_ms <=', 'stale_files =']) AS gate, unnest([lines, wrong_auto, precision, coverage, improvement_over_all_review, recall_at_3, ece, brier, warm_p95_ms, 1]::DOUBLE[]) AS value, unnest([114, 0, 0.98, 0.2, 1200, 0.8, 0.1, 0.16, 250, 0]::DOUBLE[]) AS bound FROM r, ce, (SELECT quantile_disc(CAST(position % 300 AS DOUBLE), 0.95) AS warm_p95_ms FROM records)) SELECT gate, round(value, 9) AS value, bound, coalesce(CASE WHEN ends_with(gate, '>=') THEN value >= bound WHEN ends_with(gate, '<=') THEN value <= bound ELSE value = bound END, false) AS passed FROM g",
    "line_split": ctes("catalogue", "lines", "labels_of_lines") + """, k AS (SELECT line_id, unnest(list_filter(['t|' || tenant || '|' || array_to_string(regexp_extract_all(lower(raw_text), '\\w+'), ' '), CASE WHEN label <> '' THEN 'g|' || tenant || '|' || label END, CASE WHEN buyer_sku <> '' THEN 'a|' || tenant || '|' || customer_id || '|' || buyer_sku END, CASE WHEN raw_barcode <> '' THEN 'b|' || tenant || '|' || raw_barcode END], lambda x: x IS NOT NULL)) AS key FROM lines JOIN labels_of_lines USING (line_id)),
m AS (SELECT key, min(line_id) AS m FROM k GROUP BY key), e AS (SELECT line_id AS a, m AS b FROM k JOIN m USING (key) UNION SELECT m, line_id FROM k JOIN m USING (key)),
r(a, b) AS (SELECT line_id, line_id FROM lines UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS line_id, min(b) AS root FROM r GROUP BY a),
h AS (SELECT root, sha256('quarry-split-v1|' || string_agg(line_id, '|' ORDER BY line_id)) AS "group" FROM g GROUP BY root)
SELECT line_id, CASE WHEN CAST('0x' || substr("group", 1, 8) AS BIGINT) % 4 = 0 THEN 'validation' ELSE 'development' END AS partition, "group" FROM g JOIN h USING (root)""".replace("WITH ", "WITH ", 1),
    "feed_page": ctes("changes") + " SELECT * FROM changes WHERE updated_at > '2024-01-15 00:00:00' ORDER BY updated_at, external_id LIMIT 50",
    "latest_versions": SYNC + " SELECT external_id, payload, version, updated_at FROM lc",
    "sync_classes": SYNC + " SELECT todo, count(*) AS n FROM cl GROUP BY todo",
    "sync_records": SYNC + f" SELECT external_id AS id, payload, version, {UTC.format('updated_at')} AS updated_utc, false AS dirty FROM cl WHERE todo = 'apply' UNION ALL SELECT id, payload, version, updated_utc, dirty FROM local_records WHERE id NOT IN (SELECT external_id FROM cl WHERE todo = 'apply')",
    "sync_conflicts": SYNC + " SELECT external_id AS id, payload AS remote, version, 'remote_changed_while_dirty' AS reason FROM cl WHERE todo = 'conflict'",
    "sync_applied": SYNC + " SELECT external_id AS id, version FROM cl WHERE todo = 'apply'",
    "outbox_staged": SYNC + """ SELECT r.id, r.payload, r.version AS base FROM local_records r WHERE dirty AND id NOT IN (SELECT id FROM local_outbox WHERE state IN ('pending', 'uncertain')) UNION ALL SELECT id, payload, base FROM local_outbox""",
    "outbox_due": SYNC + " SELECT op, id FROM local_outbox WHERE state IN ('pending', 'uncertain') AND id NOT IN (SELECT external_id FROM cl WHERE todo = 'conflict')",
    "sync_settled": SYNC + f""", oc AS (SELECT op, id, payload, base, CASE WHEN base % 3 = 0 THEN 'done' WHEN base % 3 = 1 THEN 'uncertain' ELSE 'conflict' END AS result FROM local_outbox WHERE state = 'pending')
SELECT o.op, o.id, o.payload, o.base, coalesce(oc.result, o.state) AS state FROM local_outbox o LEFT JOIN oc USING (op)""",
    "sync_invariants": SYNC + """, j AS (SELECT lc.version AS rv, r.version AS v FROM lc LEFT JOIN local_records r ON r.id = lc.external_id)
SELECT 'missing_locally' AS invariant, count(*) FILTER (WHERE v IS NULL) AS n FROM j UNION ALL SELECT 'version_drift', count(*) FILTER (WHERE v <> rv) FROM j UNION ALL SELECT 'duplicate_writes', (SELECT count(*) FROM (SELECT external_id, payload FROM changes GROUP BY ALL HAVING count(*) > 1))""",
    "utc_times": ctes("changes") + f" SELECT DISTINCT updated_at, {UTC.format('updated_at')} AS utc, strftime(CAST(updated_at AS TIMESTAMP) - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS second_before FROM changes",
}
ORACLES["line_split"] = ORACLES["line_split"].replace("WITH ", "WITH RECURSIVE ", 1)
# The report without a window.
ORACLES["report_days_all"] = report("day", "0000", "9999", DAY_BEFORE)
ORACLES["report_months_all"] = report("month", "0000", "9999", MONTH_BEFORE)
# The same over the aliases of every part.
for _n in ("audit_aliases", "alias_targets", "identifier_evidence", "identifier_counters", "lexical_candidates", "lexical_issues", "match_decisions", "match_contract", "predictions", "proposal_curve", "review_queue"):
    ORACLES[f"{_n}_all"] = ORACLES[_n]
    for _cut, _all in WHOLE.items():
        ORACLES[f"{_n}_all"] = ORACLES[f"{_n}_all"].replace(SQL[_cut], SQL[_all])
