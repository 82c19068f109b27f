"""DuckDB SQL of the query catalogue: what each query must return, said independently of Spark."""

from __future__ import annotations

from skarn.functions.text import STOPWORDS

_RESAMPLES = 10_000


def _variants(x: str) -> str:
    """Renderings of the double x as a DuckDB list."""
    parts = []
    for scale in ("1", "1e3", "1e6"):
        s = f"({x} / {scale}::DOUBLE)"
        parts.append(f"CASE WHEN abs({s}) >= 0.01 THEN [CASE WHEN abs({s} - round_even({s}, 0)) < 1e-6 THEN format('{{:,.0f}}', round_even({s}, 0)) END, format('{{:,.1f}}', {s}), format('{{:,.2f}}', {s})] ELSE [] END")
    both = f"list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]})"
    short = f"list_transform(list_filter({both}, lambda v: v IS NOT NULL), lambda v: regexp_replace(v, '\\.0$', ''))"
    return f"list_sort(list_distinct(list_filter({short}, lambda v: length(regexp_replace(v, '[^0-9]', '', 'g')) >= 3)))"


def _split(x: str) -> str:
    b = f"(('0x' || substr(sha256(upper({x})), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
    return f"CASE WHEN {b} < 0.8::DOUBLE THEN 'train' WHEN {b} < 0.9::DOUBLE THEN 'val' ELSE 'test' END"


def _mix(source: str, keep: str, x: str, name: str) -> str:
    """CTEs that end with a table name (keep, x): x of source through the finalizer of resample.mix(), in 128-bit numbers."""
    step = "SELECT {0}, (xor(x, x // {1}) * {2}) % 18446744073709551616::HUGEINT AS x FROM {3}"
    first = step.format(keep, 1 << 30, 0x3F58476D1CE4E5B9, f"(SELECT {keep}, ({x}) % 18446744073709551616::HUGEINT AS x FROM {source})")
    return f"{name}_a AS ({first}), {name}_b AS ({step.format(keep, 1 << 27, 0x14D049BB133111EB, f'{name}_a')}), {name} AS (SELECT {keep}, xor(x, x // {1 << 31}) AS x FROM {name}_b)"


def _tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([{stop}], w)))"


def _dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0.0::DOUBLE END"


_VERDICTS = """
WITH pairs AS (
  SELECT o_orderpriority AS field, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS g,
    CASE o_orderkey % 8 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice * 1.005::DOUBLE WHEN 2 THEN o_totalprice / 1000 WHEN 3 THEN o_totalprice / 1e6
      WHEN 4 THEN o_totalprice * 1.5::DOUBLE WHEN 5 THEN -o_totalprice WHEN 6 THEN NULL ELSE o_totalprice END AS p
  FROM orders
), verdicts AS (
  SELECT field, CASE
    WHEN g IS NULL AND p IS NULL THEN 'not_scored' WHEN g IS NULL THEN 'spurious' WHEN p IS NULL THEN 'missing'
    WHEN (CASE WHEN g = 0 THEN abs(p) ELSE abs(p - g) / abs(g) END) <= 1e-9 THEN 'exact'
    WHEN (CASE WHEN g = 0 THEN abs(p) ELSE abs(p - g) / abs(g) END) <= 0.01::DOUBLE THEN 'close'
    WHEN g <> 0 AND p <> 0 AND (g < 0) = (p < 0) AND len(list_filter([1e3, 1e6, 1e9, 1e-3, 1e-6, 1e-9], lambda r: abs(abs(g) / abs(p) - r) <= 1e-6 * greatest(abs(g) / abs(p), r))) > 0 THEN 'scale_error'
    ELSE 'wrong' END AS verdict
  FROM pairs
)
"""

_SELECTED = """
WITH usable AS (
  SELECT l_orderkey AS accession_no, l_returnflag AS concept, l_extendedprice AS value,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END,
      (l_linestatus = 'F') DESC, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) DESC, l_linenumber, l_partkey, l_suppkey) AS nth
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_partkey % 13 <> 0 AND NOT (l_discount >= 0.08::DOUBLE) AND l_returnflag IN ('A', 'R', 'N')
    AND (o_orderkey % 3 <> 0 OR year(l_shipdate) = year(o_orderdate))
), selected AS (SELECT accession_no, concept, value FROM usable WHERE nth = 1)
"""

_SHEET = f"""
WITH sheet AS (
  SELECT documents.doc_id::VARCHAR AS id, source AS accession_no, CASE WHEN documents.doc_id % 2 = 0 THEN 'random' ELSE 'test' END AS stratum,
    {_split("source")} AS split, CASE WHEN documents.doc_id % 4 = 0 THEN 'd1' ELSE 'd2' END AS risk_digest,
    ['market', 'legal', 'cyber'][(documents.doc_id % 3 + 1)::INT] AS teacher_category,
    CASE WHEN documents.doc_id % 9 <> 0 THEN ['market', 'legal', 'cyber'][((documents.doc_id + toxic + CASE WHEN documents.doc_id % 5 = 0 THEN 1 ELSE 0 END) % 3 + 1)::INT] END AS human_category,
    CASE WHEN documents.doc_id % 6 <> 0 THEN quality = 1 END AS grounded, CASE WHEN documents.doc_id % 8 <> 0 THEN toxic = 0 END AS summary_ok,
    CASE documents.doc_id % 10 WHEN 0 THEN 'UNINFORMATIVE: title says nothing'
      WHEN 1 THEN 'revised; blind verdict was ''' || ['market', 'legal', 'cyber'][((documents.doc_id + 1) % 3 + 1)::INT] || ''''
      WHEN 2 THEN 'revised after a second look' WHEN 3 THEN 'blind verdict was ''weather''' WHEN 4 THEN 'UNINFORMATIVE title' WHEN 5 THEN '' END AS note
  FROM documents JOIN labels ON documents.doc_id = labels.doc_id
), live AS (
  SELECT DISTINCT source AS accession_no, CASE WHEN source = 'src4' THEN 'd1' ELSE 'd2' END AS risk_digest FROM documents WHERE source <> 'src3'
), stale AS (
  SELECT sheet.id, sheet.accession_no FROM sheet JOIN live ON sheet.accession_no = live.accession_no WHERE sheet.risk_digest <> live.risk_digest
), seen AS (
  SELECT *, CASE WHEN regexp_matches(coalesce(note, ''), 'blind verdict was ''([a-z_]+)''') THEN regexp_extract(note, 'blind verdict was ''([a-z_]+)''', 1) ELSE human_category END AS blind,
    NOT regexp_matches(coalesce(note, ''), '\\bUNINFORMATIVE\\b\\s*:') AS counts
  FROM sheet WHERE human_category IS NOT NULL
)
"""

_CHATS = """
WITH chats AS (
  SELECT conv_id, string_agg('<|' || role || '|>' || coalesce(text, ''), '' ORDER BY turn) FILTER (WHERE role <> 'assistant') AS p,
    coalesce(first(coalesce(text, '') ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS c
  FROM conversations GROUP BY conv_id
), rendered AS (SELECT conv_id, coalesce(p, '') || '<|assistant|>' AS p, c FROM chats)
"""

_ENCODED = (
    _CHATS
    + """, ids AS (
  SELECT conv_id, list_transform(string_split(p, ''), lambda x: unicode(x)) AS p,
    CASE WHEN c = '' THEN [2] ELSE list_append(list_transform(string_split(c, ''), lambda x: unicode(x)), 2) END AS c
  FROM rendered
), budgets AS (SELECT conv_id, p, c, 512 - len(c) AS b FROM ids WHERE 512 - len(c) > 0
), encoded AS (
  SELECT conv_id, len(p) > b AS truncated, c, CASE WHEN len(p) <= b THEN p ELSE list_concat(p[1:b // 2], p[len(p) - (b - b // 2) + 1:len(p)]) END AS p FROM budgets
), arrays AS (
  SELECT conv_id, truncated, list_concat(p, c) AS input_ids, list_concat(list_transform(range(0, len(p)), lambda i: -100), c) AS labels, len(c) AS nc FROM encoded
)
"""
)


def _checksum(c: str) -> str:
    return f"coalesce(list_sum(list_transform({c}, lambda x, i: x::BIGINT * ((i - 1) % 97 + 1))), 0)::BIGINT"


def _bootstrap(stats: str, key: str, metrics: list[str], gaps: dict[str, tuple[str, str]] | None = None, digits: int = 6) -> str:
    """Interval SQL over CTE text that ends with a table stats (key, <m>_num, <m>_den), of one block of clusters (4096 or fewer) and seed 0."""
    sums = ", ".join(f"sum({m}_{x}) AS {m}_{x}" for m in metrics for x in ("num", "den"))
    values = {m: f"CASE WHEN {m}_den <> 0 THEN {m}_num / {m}_den END" for m in metrics}
    values |= {g: f"({values[a]}) - ({values[b]})" for g, (a, b) in (gaps or {}).items()}
    union = " UNION ALL ".join(f"SELECT '{m}' AS metric, {v} AS value FROM sums" for m, v in values.items())
    return f"""{stats}, numbered AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS slot FROM stats
), resamples AS (SELECT r::HUGEINT AS r FROM range(0, {_RESAMPLES}) AS a(r)
), {_mix("resamples", "r", "r", "once")}, {_mix("once", "r", "x", "keys")}
, places AS (SELECT r, x, j FROM keys, range(0, (SELECT count(*) FROM stats)) AS b(j)
), {_mix("places", "r", "x + j", "hashes")}
, drawn AS (SELECT r, (x // 4294967296 * (SELECT count(*) FROM stats) // 4294967296)::BIGINT AS slot FROM hashes
), sums AS (SELECT r, {sums} FROM drawn JOIN numbered USING (slot) GROUP BY r
), long AS ({union})
SELECT metric, round(quantile_cont(value, (1 - 0.95::DOUBLE) / 2), {digits}) AS low, round(quantile_cont(value, 1 - (1 - 0.95::DOUBLE) / 2), {digits}) AS high, count(*) AS draws
FROM long WHERE value IS NOT NULL GROUP BY metric"""


def _excerpt() -> str:
    def stripped(c: str) -> str:
        return f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"

    return f"""
WITH f AS (
  SELECT doc_id, source AS company, upper(lang) AS ticker, CASE WHEN doc_id % 5 <> 0 THEN (2020 + doc_id % 5)::VARCHAR ELSE 'None' END AS fy,
    {stripped("text")} AS business, CASE WHEN doc_id % 2 = 0 THEN {stripped("text")} ELSE '' END AS mdna, CASE WHEN doc_id % 3 = 0 THEN {stripped("text")} ELSE '' END AS risk,
    CASE WHEN doc_id % 4 = 0 THEN '## Income' || chr(10) || 'Net sales: ' || format('{{:,}}', doc_id) END AS income
  FROM documents
), e AS (
  SELECT doc_id, concat_ws(chr(10), 'Company: ' || company, 'Ticker: ' || ticker, 'Form: 10-K', 'Fiscal year: ' || fy,
    CASE WHEN business <> '' THEN chr(10) || '## Item 1. Business' || chr(10) || substr(business, 1, 3000) END,
    CASE WHEN income IS NOT NULL THEN chr(10) || substr(income, 1, 3500) END,
    CASE WHEN mdna <> '' THEN chr(10) || '## Item 7. Management''s Discussion and Analysis' || chr(10) || substr(mdna, 1, 6000) END,
    CASE WHEN risk <> '' THEN chr(10) || '## Item 1A. Risk Factors' || chr(10) || substr(risk, 1, 12000) END) AS x
  FROM f
)
SELECT doc_id, length(x)::INT AS n_chars, md5(x) AS excerpt_md5 FROM e"""


_SIM = f"""
WITH t AS (SELECT p_partkey, p_brand, {_tokens("p_name")} AS n, {_tokens("p_type")} AS s, p_type FROM part)
"""

_GREEDY = _SIM + f""", nth AS (SELECT t.*, substr(part.p_name, 1, 2) AS c, part.p_type AS kind, part.p_size AS size, row_number() OVER (PARTITION BY part.p_brand, part.p_type, part.p_size ORDER BY t.p_partkey) - 1 AS i FROM t JOIN part ON part.p_partkey = t.p_partkey
), pairs AS (
  SELECT a.p_brand, a.kind, a.size, a.i // 2 AS g, b.i // 2 AS p, 0.7::DOUBLE * ({_dice('a.n', 'b.n')}) + (1 - 0.7::DOUBLE) * ({_dice('a.s', 'b.s')}) AS score, a.c = b.c AS same
  FROM nth a JOIN nth b ON a.p_brand = b.p_brand AND a.kind = b.kind AND a.size = b.size AND a.i % 2 = 0 AND b.i % 2 = 1
), ranked AS (
  SELECT p_brand, kind, size, list({{'g': g, 'p': p, 'score': score, 'same': same}} ORDER BY score DESC, g, p) AS l FROM pairs WHERE score >= 0.3::DOUBLE GROUP BY p_brand, kind, size
), folded AS (
  SELECT p_brand, kind, size, list_reduce(list_transform(l, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.g = x[1].g OR k.p = x[1].p)) = 0 THEN list_concat(kept, x) ELSE kept END) AS m FROM ranked
)
"""


ORACLES = {
    "verdict_accuracy": _VERDICTS
    + """SELECT field, count(*) AS n, sum((verdict NOT IN ('not_scored', 'spurious'))::INT)::BIGINT AS scorable, sum((verdict IN ('exact', 'close'))::INT)::BIGINT AS hits,
  round(sum((verdict IN ('exact', 'close'))::INT)::DOUBLE / nullif(sum((verdict NOT IN ('not_scored', 'spurious'))::INT), 0), 6) AS accuracy
FROM (SELECT field, verdict FROM verdicts UNION ALL SELECT 'ALL', verdict FROM verdicts) GROUP BY field""",
    "verdict_tally_pivot": _VERDICTS + "SELECT field, " + ", ".join(f"sum((verdict = '{v}')::INT)::BIGINT AS {v}" for v in ("exact", "close", "scale_error", "wrong", "missing", "spurious", "not_scored")) + " FROM verdicts GROUP BY field",
    "split_assignment": f"""WITH c AS (SELECT c_name, {_split("c_name")} AS split FROM customer)
SELECT d.split, count(c_name) AS filings, count(DISTINCT c_name) AS companies FROM (VALUES ('train'), ('val'), ('test')) AS d(split) LEFT JOIN c ON c.split = d.split GROUP BY d.split""",
    "split_leak_check": f"""WITH s AS (SELECT source, {_split("source")} AS split FROM documents)
SELECT count(DISTINCT source) AS companies, count(*) AS filings, (SELECT count(*) FROM (SELECT source FROM s GROUP BY source HAVING count(DISTINCT split) > 1)) AS leaks FROM s""",
    "split_freshness": f"""SELECT {_split("c_name")} AS split, count(*) AS filings, count(DISTINCT c_name) AS companies, round(avg((year(o_orderdate) >= 1999)::INT), 6) AS share_fresh
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "latest_n_per_company": """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS rank
FROM orders) WHERE rank <= 2""",
    "fact_selection": _SELECTED + "SELECT accession_no, concept, value FROM selected",
    "fact_fallback_eps": _SELECTED
    + """, shares AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1
), rows AS (
  SELECT o_orderkey AS accession_no, coalesce(value, o_totalprice) AS revenue, o_totalprice * 2 AS total_assets, value IS NULL AS fell,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS ni, q
  FROM orders LEFT JOIN selected ON accession_no = o_orderkey LEFT JOIN shares ON k = o_orderkey
), derived AS (SELECT *, ni IS NOT NULL AND coalesce(q, 0) <> 0 AS d FROM rows)
SELECT accession_no, revenue, total_assets, CASE WHEN d THEN replace(format('{:,.2f}', ni / q), ',', '')::DOUBLE END AS eps_diluted,
  concat_ws(',', CASE WHEN fell THEN 'revenue_from_metrics_fallback' END, 'total_assets_from_metrics_fallback', CASE WHEN d THEN 'eps_diluted_derived_from_net_income_and_shares' END) AS warnings
FROM derived""",
    "refresh_diff": """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders), d AS (
  SELECT 'revenue' AS field, k FROM o WHERE k % 13 <> 0 AND k % 11 = 0 AND p <> p * 2
  UNION ALL SELECT 'net_income', k FROM o WHERE k % 13 <> 0 AND k % 7 = 0
  UNION ALL SELECT 'eps_diluted', k FROM o WHERE k % 13 <> 0 AND k % 5 = 0
  UNION ALL SELECT 'failed', k FROM o WHERE k % 13 = 0)
SELECT field, count(*) AS n, count(DISTINCT k) AS filings FROM d GROUP BY field""",
    "kept_warnings": """SELECT concat_ws('|', 'missing_' || event_type, CASE WHEN event_id % 2 <> 0 THEN 'income_statement_failed: x' END, CASE WHEN event_id % 3 <> 0 THEN 'ok' END) AS kept, count(*) AS n
FROM events GROUP BY 1""",
    "incremental_anti": "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1",
    "cik_override": "SELECT c_custkey, CASE c_custkey WHEN 1 THEN '62709' WHEN 2 THEN '1013462' WHEN 3 THEN '1532961' ELSE c_custkey::VARCHAR END AS cik FROM customer",
    "statement_render": """WITH lines AS (
  SELECT l_orderkey AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth,
    replace('Part $0.00' || l_partkey || ': ' || format('{:,.2f}', floor(l_extendedprice) + CASE WHEN l_partkey % 2 = 0 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END), '.00', '') AS line
  FROM lineitem WHERE l_linenumber <> 7 AND NOT (l_discount >= 0.09::DOUBLE) AND l_partkey % 13 <> 0
), texts AS (SELECT a, count(*)::INT AS n, '## Income Statement (period ending 2025-01-01)' || chr(10) || string_agg(line, chr(10) ORDER BY nth) AS t FROM lines WHERE nth <= 60 GROUP BY a)
SELECT a AS accession_no, n AS n_lines, md5(t) AS text_md5, length(t)::INT AS n_chars FROM texts""",
    "statement_pair_warnings": """SELECT concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'missing_income_statement' END, CASE WHEN o_orderkey % 4 = 0 THEN 'missing_balance_sheet' END) AS warnings, count(*) AS n
FROM orders GROUP BY 1""",
    "numeric_variants": f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN floor(o_totalprice) * 1e6 ELSE o_totalprice END AS v FROM orders)
SELECT o_orderkey, unnest({_variants("v")}) AS variant FROM o""",
    "grounding_rate": f"""WITH o AS (
  SELECT CASE o_orderkey % 3 WHEN 0 THEN 'total of ' || format('{{:,.2f}}', o_totalprice) WHEN 1 THEN 'in thousands ' || format('{{:,.1f}}', o_totalprice / 1000) ELSE 'nothing here' END AS x,
    o_totalprice AS revenue, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice * 2 END AS net_income FROM orders
), long AS (SELECT 'revenue' AS field, x, revenue AS v FROM o UNION ALL SELECT 'net_income', x, net_income FROM o WHERE net_income IS NOT NULL
), tested AS (SELECT field, len(list_filter({_variants("v")}, lambda w: contains(x, w))) > 0 AS ok FROM long)
SELECT field, sum(ok::INT)::BIGINT AS hits, count(*) AS total, round(avg(ok::INT), 6) AS rate FROM tested GROUP BY field""",
    "excerpt_build": _excerpt(),
    "figure_window": f"""WITH d AS (SELECT doc_id, text, TRY_CAST(nullif(regexp_extract(text, '([0-9]{{3}})', 1), '') AS DOUBLE) AS v FROM documents
), places AS (SELECT doc_id, text, CASE WHEN v IS NULL THEN NULL ELSE list_min(list_filter(list_transform({_variants("v")}, lambda w: instr(text, w)), lambda i: i > 0)) END AS spot FROM d
), w AS (SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE substr(text, greatest(1, coalesce(spot, 1) - 150), 600) END AS x FROM places)
SELECT doc_id, length(x)::INT AS n_chars, md5(x) AS window_md5 FROM w""",
    "risk_slice": """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '## Item 1A. Risk Factors' || chr(10) || text ELSE '' END AS x FROM documents)
SELECT doc_id, length(x)::INT AS n_chars, md5(x) AS slice_md5 FROM s""",
    "by_reference_flag": """WITH d AS (
  SELECT doc_id, source, CASE doc_id % 7 WHEN 0 THEN '  ' || text || ' is Incorporated herein  ' WHEN 1 THEN text || ' CAN BE FOUND there' WHEN 2 THEN NULL ELSE text END AS t FROM documents
), f AS (
  SELECT lpad(doc_id::VARCHAR, greatest(12, length(doc_id::VARCHAR))::INT, '0') AS id, source, coalesce(length(t) > 0 AND length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) <= 1500
    AND (contains(lower(t), 'incorporated') OR contains(lower(t), 'by reference') OR contains(lower(t), 'can be found')), false) AS flag FROM d)
SELECT source, count(*) AS n, sum(flag::INT)::BIGINT AS flagged, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE flag), '') AS docs FROM f GROUP BY source""",
    "category_distribution": "SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1",
    "risk_list_sizes": "SELECT min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
    "theme_modal_share": """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS nth, sum(n) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS k FROM c)
SELECT source AS theme, k AS categories, total::BIGINT AS n, lang AS modal_category, round(n::DOUBLE / total, 6) AS modal_share FROM r WHERE nth = 1""",
    "json_validity": """SELECT event_id % 8 AS shape, count(*) AS n, sum((event_id % 8 IN (0, 7))::INT)::BIGINT AS strict, sum((event_id % 8 IN (0, 1, 2, 3, 7))::INT)::BIGINT AS lenient,
  max(CASE event_id % 8 WHEN 6 THEN 'empty' WHEN 1 THEN 'schema: 1 validation error' WHEN 2 THEN 'schema: 1 validation error' WHEN 3 THEN 'schema: 1 validation error'
    WHEN 4 THEN 'schema: 1 validation error' WHEN 5 THEN 'schema: 1 validation error' END) AS error,
  sum((event_id % 8 IN (0, 1, 2, 3, 7))::INT)::BIGINT AS with_revenue
FROM events GROUP BY 1""",
    "first_object": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS object FROM events",
    "category_multiset_f1": """WITH c AS (
  SELECT l_orderkey AS k, l_returnflag AS f, sum((l_linenumber % 2 = 1)::INT) AS g, sum((l_linenumber % 2 = 0)::INT) AS p FROM lineitem GROUP BY 1, 2
), o AS (SELECT k, sum(g) AS g, sum(p) AS p, sum(least(g, p)) AS tp FROM c GROUP BY k
), s AS (SELECT *, CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0.0::DOUBLE END AS pr, CASE WHEN g > 0 THEN tp::DOUBLE / g ELSE 0.0::DOUBLE END AS rc FROM o
), t AS (SELECT count(*) AS n, sum(g)::BIGINT AS g, sum(p)::BIGINT AS p, sum(tp)::BIGINT AS tp, avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0::DOUBLE END) AS m FROM s)
SELECT n, g AS n_gold, p AS n_pred, tp AS category_tp, round(m, 6) AS macro_category_f1, round(2 * (tp::DOUBLE / p) * (tp::DOUBLE / g) / (tp::DOUBLE / p + tp::DOUBLE / g), 6) AS micro_category_f1, NULL::DOUBLE AS macro_category_accuracy FROM t""",
    "token_dice": _SIM + f"SELECT a.p_partkey, round(0.7::DOUBLE * ({_dice('a.n', 'b.n')}) + (1 - 0.7::DOUBLE) * ({_dice('a.s', 'b.s')}), 6) AS similarity FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1",
    "greedy_match": _GREEDY + """SELECT b.p_brand, b.p_type, b.p_size, b.n_parts, coalesce(len(m), 0)::INT AS matched, coalesce(array_to_string(list_transform(m, lambda x: x.g::VARCHAR || '-' || x.p::VARCHAR), ','), '') AS pairs,
  round(coalesce(list_sum(list_transform(m, lambda x: x.score)), 0.0::DOUBLE), 6) AS score_sum
FROM (SELECT p_brand, p_type, p_size, count(*) AS n_parts FROM part GROUP BY ALL) b LEFT JOIN folded ON folded.p_brand = b.p_brand AND folded.kind = b.p_type AND folded.size = b.p_size""",
    "match_long_lists": _SIM
    + f""", pairs AS (
  SELECT a.p_brand, a.p_partkey AS g, b.p_partkey AS p, 0.7::DOUBLE * ({_dice("a.n", "b.n")}) + (1 - 0.7::DOUBLE) * ({_dice("a.s", "b.s")}) AS score
  FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey % 2 = 1 AND b.p_partkey % 2 = 0
), ranked AS (SELECT p_brand, list({{'g': g, 'p': p, 'score': score}} ORDER BY score DESC, g, p) AS l FROM pairs WHERE score >= 0.3::DOUBLE GROUP BY p_brand
), folded AS (
  SELECT p_brand, list_reduce(list_transform(l, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.g = x[1].g OR k.p = x[1].p)) = 0 THEN list_concat(kept, x) ELSE kept END) AS m FROM ranked
)
SELECT p_brand AS accession_no, x.g AS g, x.p AS p, round(x.score, 6) AS score FROM folded, unnest(m) AS u(x)""",
    "bootstrap_ci": _bootstrap(
        """WITH stats AS (SELECT source, sum(quality)::DOUBLE AS quality_num, count(*)::DOUBLE AS quality_den, sum(toxic)::DOUBLE AS toxic_num, sum(quality)::DOUBLE AS toxic_den
FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY source)""",
        "source",
        ["quality", "toxic"],
    ),
    "paired_gap_ci": _bootstrap(
        """WITH stats AS (SELECT source, sum((quality = toxic)::INT)::DOUBLE AS blind_num, count(*)::DOUBLE AS blind_den,
  sum(CASE WHEN documents.doc_id % 4 = 0 THEN 1 ELSE (quality = toxic)::INT END)::DOUBLE AS recorded_num, count(*)::DOUBLE AS recorded_den
FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY source)""",
        "source",
        ["blind", "recorded"],
        {"anchoring_gap": ("recorded", "blind")},
    ),
    "cluster_sample": """WITH c AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('0|' || source), source LIMIT 12
), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0|' || source || '|' || doc_id), doc_id) AS n FROM documents WHERE source IN (SELECT source FROM c))
SELECT source, doc_id FROM r WHERE n <= 4""",
    "stratified_sample": f"""WITH c AS (SELECT c_name, {_split("c_name")} AS split FROM customer
), main AS (SELECT c_name, split FROM c ORDER BY md5('0|' || c_name), c_name LIMIT 12
), more AS (SELECT c_name, split FROM c WHERE split = 'test' AND c_name NOT IN (SELECT c_name FROM main) ORDER BY md5('1|' || c_name), c_name LIMIT 3)
SELECT c_name, split, 'random' AS stratum FROM main UNION ALL SELECT c_name, split, 'test' FROM more""",
    "audit_agreement": _SHEET
    + """SELECT stratum, count(*) AS n_reviewed, count(DISTINCT accession_no) AS n_filings,
  round(avg((blind = teacher_category)::INT) FILTER (WHERE counts), 6) AS category_agreement,
  round(avg((human_category = teacher_category)::INT) FILTER (WHERE counts), 6) AS category_agreement_recorded,
  sum((NOT counts)::INT)::BIGINT AS n_uninformative, sum((counts AND blind <> human_category)::INT)::BIGINT AS n_revised,
  round(avg(grounded::INT), 6) AS grounded_rate, round(avg(summary_ok::INT), 6) AS summary_ok_rate FROM seen GROUP BY stratum""",
    "audit_confusions": _SHEET
    + "SELECT teacher_category, blind AS human_category, count(*) AS n FROM seen WHERE counts AND blind <> teacher_category AND id NOT IN (SELECT id FROM stale) GROUP BY 1, 2",
    "audit_ci": _bootstrap(
        _SHEET
        + """, stats AS (SELECT accession_no, sum((counts AND blind = teacher_category)::INT)::DOUBLE AS category_agreement_num, sum(counts::INT)::DOUBLE AS category_agreement_den,
  sum((counts AND human_category = teacher_category)::INT)::DOUBLE AS category_agreement_recorded_num, sum(counts::INT)::DOUBLE AS category_agreement_recorded_den,
  sum(coalesce(grounded, false)::INT)::DOUBLE AS grounded_rate_num, sum((grounded IS NOT NULL)::INT)::DOUBLE AS grounded_rate_den,
  sum(coalesce(summary_ok, false)::INT)::DOUBLE AS summary_ok_rate_num, sum((summary_ok IS NOT NULL)::INT)::DOUBLE AS summary_ok_rate_den FROM seen GROUP BY accession_no)""",
        "accession_no",
        ["category_agreement", "category_agreement_recorded", "grounded_rate", "summary_ok_rate"],
        {"anchoring_gap": ("category_agreement_recorded", "category_agreement")},
    ),
    "implied_recall": """WITH f AS (SELECT source, count(*) AS n, sum(toxic) AS t FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY source)
SELECT CASE WHEN length(source) = 4 THEN 'random' ELSE 'test' END AS stratum, count(*) AS filings_read, sum(n)::BIGINT AS labelled, sum(t)::BIGINT AS missed, round(sum(n)::DOUBLE / (sum(n) + sum(t)), 6) AS recall
FROM f WHERE right(source, 1) <> '7' GROUP BY 1""",
    "stale_rows": _SHEET + "SELECT id, accession_no FROM stale",
    "note_lint": _SHEET
    + """SELECT id, 'revised_without_blind_verdict' AS problem FROM sheet WHERE regexp_matches(note, '\\brevised\\b') AND NOT regexp_matches(note, 'blind verdict was ''([a-z_]+)''')
UNION ALL SELECT id, 'unknown_blind_category' FROM sheet WHERE note LIKE '%weather%'
UNION ALL SELECT id, 'uninformative_without_colon' FROM sheet WHERE contains(note, 'UNINFORMATIVE') AND NOT regexp_matches(note, '\\bUNINFORMATIVE\\b\\s*:')""",
    "population_meta": """WITH f AS (SELECT source, count(*) AS n FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY source)
SELECT count(*) AS filings, sum(n)::BIGINT AS risks, sum(least(n, 4))::BIGINT AS sampled FROM f""",
    "stratum_split_crosstab": _SHEET + "SELECT stratum, split, count(*) AS n FROM sheet GROUP BY 1, 2",
    "render_prompt": _CHATS + "SELECT conv_id, length(p)::INT AS n_chars, md5(p) AS prompt_md5 FROM rendered",
    "encode_truncate_mask": _ENCODED + f"SELECT conv_id, truncated, len(input_ids)::INT AS n_ids, {_checksum('input_ids')} AS ids_sum, {_checksum('labels')} AS labels_sum, len(input_ids)::INT AS n_mask FROM arrays",
    "encoding_stats": _ENCODED
    + f"""SELECT {_split("conv_id::VARCHAR")} AS split, count(*) AS n, sum(truncated::INT)::BIGINT AS truncated, max(len(input_ids))::INT AS max_tokens, sum(len(input_ids) - nc)::BIGINT AS prompt_tokens, sum(nc)::BIGINT AS completion_tokens,
  round(sum(nc)::DOUBLE / greatest(1, sum(len(input_ids))), 6) AS supervised_share FROM arrays GROUP BY 1""",
    "pad_batches": _ENCODED
    + f""", b AS (SELECT *, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch FROM arrays
), w AS (SELECT *, (ceil(max(len(input_ids)) OVER (PARTITION BY batch) / 8.0) * 8)::INT AS width FROM b)
SELECT conv_id, batch::BIGINT AS batch, width, width AS n_ids, {_checksum("list_concat(labels, list_transform(range(0, width - len(labels)), lambda i: -100))")} AS labels_sum, len(input_ids)::INT AS n_real FROM w""",
    "length_distribution": _CHATS
    + """, l AS (SELECT length(p) + length(c) + 1 AS t, length(c) + 1 AS c FROM rendered
), s AS (SELECT list(t ORDER BY t) AS ts FROM l)
SELECT count(*) AS n, quantile_cont(t, 0.5) AS median, max(t)::INT AS max, quantile_cont(c, 0.5) AS completion_median, max(c)::INT AS completion_max, round(sum(c)::DOUBLE / sum(t), 6) AS supervised_share,
  any_value(ts[floor(0.9::DOUBLE * len(ts))::INT + 1])::INT AS p90, any_value(ts[floor(0.99::DOUBLE * len(ts))::INT + 1])::INT AS p99 FROM l, s""",
    "window_fit": _CHATS
    + """, l AS (SELECT length(p) + length(c) + 1 AS t, length(c) + 1 AS c FROM rendered)
SELECT m::INT AS max_len, sum((t > m)::INT)::BIGINT AS truncated, sum((c >= m)::INT)::BIGINT AS impossible, count(*) AS n FROM l, (VALUES (256), (512), (1024), (2048)) AS v(m) GROUP BY m""",
    "longest_examples": _CHATS
    + "SELECT conv_id, length(p)::INT AS prompt, (length(c) + 1)::INT AS completion, (length(p) + length(c) + 1)::INT AS total FROM rendered ORDER BY total DESC, conv_id LIMIT 5",
    "usage_cost": """WITH u AS (
  SELECT event_type AS model, count(*) AS calls, sum(event_id % 1000)::BIGINT AS i, sum(CASE WHEN event_id % 7 <> 0 THEN event_id % 300 ELSE 0 END)::BIGINT AS o, sum(event_id % 11)::BIGINT AS r, sum(event_id % 13)::BIGINT AS w
  FROM events GROUP BY 1
), p AS (SELECT * FROM (VALUES ('click', 1.0::DOUBLE, 5.0::DOUBLE), ('view', 2.0::DOUBLE, 10.0::DOUBLE), ('purchase', 3.0::DOUBLE, 15.0::DOUBLE)) AS v(m, a, b))
SELECT model, calls, i AS input_tokens, o AS output_tokens, r AS cache_read_tokens, w AS cache_creation_tokens, round(((i + r * 0.1::DOUBLE + w * 1.25::DOUBLE) * a + o * b) / 1e6, 6) AS cost_usd FROM u LEFT JOIN p ON m = model""",
    "run_stats": """WITH e AS (
  SELECT event_type, event_id AS k, CASE WHEN event_id % 5 = 0 THEN 'cached' WHEN event_id % 17 = 0 THEN 'failed' ELSE 'generated' END AS s,
    CASE WHEN event_id % 19 = 0 THEN 'max_tokens' WHEN event_id % 23 = 0 THEN 'length' WHEN event_id % 29 = 0 THEN 'refusal' ELSE 'end_turn' END AS stop FROM events
), a AS (
  SELECT event_type, sum((s = 'cached')::INT)::BIGINT AS cached, sum((s = 'generated')::INT)::BIGINT AS generated, sum((s = 'failed')::INT)::BIGINT AS failed,
    sum((stop IN ('max_tokens', 'length'))::INT)::BIGINT AS truncated, sum((stop = 'refusal')::INT)::BIGINT AS refused,
    sum(CASE WHEN s <> 'failed' THEN k % 100 ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN s <> 'failed' THEN k % 10 ELSE 0 END)::BIGINT AS output_tokens FROM e GROUP BY 1)
SELECT *, CASE WHEN input_tokens <> 0 OR output_tokens <> 0 THEN round(input_tokens / 1e6 * 2.0::DOUBLE + output_tokens / 1e6 * 10.0::DOUBLE, 6) END AS cost_usd FROM a""",
    "statement_cap": """WITH lines AS (
  SELECT l_suppkey AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS nth, replace('Part ' || l_partkey || ': ' || format('{:,.2f}', floor(l_quantity)::DOUBLE), '.00', '') AS line FROM lineitem
)
SELECT a AS accession_no, count(*)::INT AS n_lines, md5('## Income Statement (period ending 2025-01-01)' || chr(10) || string_agg(line, chr(10) ORDER BY nth)) AS text_md5 FROM lines WHERE nth <= 60 GROUP BY a""",
    "latest_filings": """SELECT o_custkey, o_orderkey, '10-K' AS form_type, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS rank
FROM orders WHERE o_orderkey % 4 NOT IN (1, 2)) WHERE rank <= 2""",
    "section_projection": """SELECT doc_id, CASE WHEN doc_id % 6 > 1 THEN (2000 + doc_id % 25)::INT END AS fiscal_year,
  concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'old' END, CASE WHEN doc_id % 3 < 2 THEN 'missing_business' END, CASE WHEN doc_id % 4 < 2 THEN 'missing_risk_factors' END, CASE WHEN doc_id % 5 < 2 THEN 'missing_management_discussion' END) AS warnings,
  doc_id % 3 < 2 AS no_business, doc_id % 4 < 2 AS no_risk_factors, doc_id % 5 < 2 AS no_management_discussion FROM documents""",
    "fact_periods": """WITH r AS (
  SELECT CASE WHEN l_partkey % 5 > 1 THEN l_shipdate::DATE END AS e, CASE WHEN l_partkey % 3 > 0 THEN l_shipdate::DATE - (l_partkey % 50 - 10)::INT END AS i, CASE WHEN l_partkey % 7 > 1 THEN l_shipdate::DATE - (l_partkey % 50 - 10)::INT END AS s FROM lineitem
), p AS (SELECT coalesce(strftime(coalesce(e, i), '%Y-%m'), '') AS month, coalesce(date_diff('day', s, e), 0)::INT AS days FROM r)
SELECT month, count(*) AS n, sum(days)::BIGINT AS days, min(days) AS least, max(days) AS most FROM p GROUP BY month""",
    "period_columns": """SELECT o_orderkey, '2024-12-31' AS period, 0 AS period_pos, o_totalprice::DOUBLE AS value FROM orders UNION ALL SELECT o_orderkey, '2023-12-31 (FY)', 1, o_custkey::DOUBLE FROM orders""",
    "facts_refresh": """SELECT o_orderkey AS accession_no, o_orderstatus AS business, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice * 2 END AS revenue, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN o_totalprice END AS net_income,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS total_assets, 'USD' AS unit, CASE WHEN o_orderkey % 3 = 0 THEN 'missing_business,xbrl_unavailable: x' ELSE 'missing_business,revenue_from_metrics_fallback' END AS warnings FROM orders""",
    "refresh_counters": """WITH o AS (SELECT o_orderkey % 3 = 0 AS failed, o_orderkey % 2 = 0 AS even, o_totalprice AS p FROM orders), c AS (
  SELECT count(*) AS n, sum((NOT failed)::INT) AS changed, sum(failed::INT) AS failed, sum((NOT failed AND p <> 0)::INT) AS revenue, sum((NOT failed AND even)::INT) AS net_income, sum((NOT failed)::INT) AS total_assets FROM o
)
SELECT 'n' AS counter, n::BIGINT AS value FROM c UNION ALL SELECT 'changed', changed::BIGINT FROM c UNION ALL SELECT 'failed', failed::BIGINT FROM c UNION ALL SELECT 'changed_revenue', revenue::BIGINT FROM c
UNION ALL SELECT 'changed_net_income', net_income::BIGINT FROM c UNION ALL SELECT 'changed_total_assets', total_assets::BIGINT FROM c UNION ALL SELECT 'changed_eps_diluted', 0::BIGINT FROM c UNION ALL SELECT 'rows_of_version_2', n::BIGINT FROM c""",
    "split_write": f"""SELECT {_split("doc_id::VARCHAR")} AS split, doc_id::VARCHAR AS accession_no, source AS ticker, doc_id % 2 = 0 AS risk_factors_by_reference, md5(coalesce(text, 'null')) AS content_md5 FROM documents""",
    "cache_lookup": """SELECT doc_id, 'M-1/' || doc_id || '_' || substr(sha256('p' || coalesce(text, '')), 1, 12) AS cache_key,
  CASE WHEN doc_id % 3 <> 1 AND doc_id % 7 <> 0 THEN 'answer ' || doc_id END AS raw, doc_id % 3 <> 1 AND doc_id % 7 <> 0 AS cache_hit FROM documents""",
    "tokenized": """SELECT doc_id, length(coalesce(text, ''))::INT AS n_ids, coalesce(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)), 0)::BIGINT AS sum_ids FROM documents""",
    "json_forms": r"""WITH l AS (
  SELECT *, l_extendedprice::VARCHAR AS price, CASE WHEN l_linenumber <> 3 THEN l_discount::VARCHAR ELSE 'null' END AS rate FROM lineitem
)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  '{"flags": ["' || l_linestatus || '"], "note": "say \"' || l_returnflag || '\u00e9\\\n", "part": ' || l_partkey || ', "price": ' || price || ', "rate": ' || rate || '}' AS in_line,
  md5('{' || chr(10) || '  "price": ' || price || ',' || chr(10) || '  "part": ' || l_partkey || ',' || chr(10) || '  "note": "say \"' || l_returnflag || 'é\\\n",' || chr(10) || '  "rate": ' || rate || ',' || chr(10)
    || '  "flags": [' || chr(10) || '    "' || l_linestatus || '"' || chr(10) || '  ]' || chr(10) || '}') AS indented_md5
FROM l""",
    "override_check": "SELECT * FROM (VALUES ('-5', 13::BIGINT), ('nobody', 14::BIGINT)) AS v(key, identifier)",
    "grounded_projection": f"""WITH o AS (SELECT o_orderkey, o_totalprice AS v, o_totalprice * 2 AS w, CASE WHEN o_orderkey % 3 = 0 THEN 'total of ' || format('{{:,.2f}}', o_totalprice) ELSE 'nothing here' END AS x FROM orders)
SELECT o_orderkey, CASE WHEN len(list_filter({_variants("v")}, lambda y: contains(x, y))) > 0 THEN v END AS revenue, CASE WHEN len(list_filter({_variants("w")}, lambda y: contains(x, y))) > 0 THEN w END AS net_income, NULL::DOUBLE AS total_assets FROM o""",
    "target_json": f"""SELECT doc_id::VARCHAR AS accession_no, {_split("lang")} AS split, 3 AS turns, source AS company, (2020 + doc_id % 5)::VARCHAR AS year, CASE WHEN doc_id % 2 = 0 THEN source END AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'a "quoted" line' END AS summary, true AS keeps_nulls FROM documents WHERE doc_id % 5 <> 0""",
    "labeled_filings": f"SELECT source AS ticker, doc_id::VARCHAR AS accession_no, {_split('source')} AS split, (doc_id % 4)::INT AS n_risks, substr(sha256('[' || array_to_string(list_transform(range(doc_id % 4), lambda i: '{{\"category\": \"legal\", \"summary\": \"' || source || '\", \"title\": \"t\"}}'), ', ') || ']'), 1, 12) AS risk_digest FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 4 <> 0",
    "risk_rows": """SELECT l_orderkey AS accession_no, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1)::INT AS risk_index, 'risk ' || l_partkey AS title, l_returnflag AS category, l_linestatus AS summary, o_orderstatus
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 0""",
    "risk_report": _GREEDY
    + """, lists AS (
  SELECT p_brand, p_type, p_size, count(*) FILTER (WHERE i % 2 = 0) AS ng, count(*) FILTER (WHERE i % 2 = 1) AS np
  FROM (SELECT p_brand, kind AS p_type, size AS p_size, i FROM nth) GROUP BY ALL
), cats AS (
  SELECT p_brand, kind AS p_type, size AS p_size, c, least(count(*) FILTER (WHERE i % 2 = 0), count(*) FILTER (WHERE i % 2 = 1)) AS tp FROM nth GROUP BY ALL
), rows AS (
  SELECT ng, np, (SELECT sum(tp) FROM cats WHERE cats.p_brand = l.p_brand AND cats.p_type = l.p_type AND cats.p_size = l.p_size) AS tp, coalesce(len(m), 0) AS mt, coalesce(len(list_filter(m, lambda x: x.same)), 0) AS ms
  FROM lists l LEFT JOIN folded f ON f.p_brand = l.p_brand AND f.kind = l.p_type AND f.size = l.p_size
), sums AS (SELECT count(*) AS n, sum(ng)::BIGINT AS g, sum(np)::BIGINT AS p, sum(tp)::BIGINT AS t, sum(mt)::BIGINT AS m, sum(ms)::BIGINT AS s,
  avg(CASE WHEN np > 0 AND ng > 0 AND tp > 0 THEN 2 * (tp::DOUBLE / np) * (tp::DOUBLE / ng) / (tp::DOUBLE / np + tp::DOUBLE / ng) ELSE 0.0::DOUBLE END) AS mc, avg(CASE WHEN np > 0 AND ng > 0 AND mt > 0 THEN 2 * (mt::DOUBLE / np) * (mt::DOUBLE / ng) / (mt::DOUBLE / np + mt::DOUBLE / ng) ELSE 0.0::DOUBLE END) AS mm, avg(CASE WHEN mt > 0 THEN ms::DOUBLE / mt END) AS ma FROM rows)
SELECT n, g AS n_gold, p AS n_pred, t AS category_tp, m AS matched, s AS matched_same_category, round(mc, 6) AS macro_category_f1, round(mm, 6) AS macro_match_f1, round(ma, 6) AS macro_category_accuracy,
  round(CASE WHEN p > 0 AND g > 0 AND t > 0 THEN 2 * (t::DOUBLE / p) * (t::DOUBLE / g) / (t::DOUBLE / p + t::DOUBLE / g) ELSE 0.0::DOUBLE END, 6) AS micro_category_f1, round(CASE WHEN p > 0 AND g > 0 AND m > 0 THEN 2 * (m::DOUBLE / p) * (m::DOUBLE / g) / (m::DOUBLE / p + m::DOUBLE / g) ELSE 0.0::DOUBLE END, 6) AS micro_match_f1 FROM sums""",
    "prediction_join": """SELECT o_orderstatus, count(*) AS n, sum((o_orderkey % 10 = 3)::INT)::BIGINT AS empty, count(DISTINCT CASE WHEN o_orderkey % 10 = 3 THEN '' ELSE 'a' || o_custkey END) AS answers FROM orders GROUP BY 1""",
    "prediction_alignment": """SELECT CASE o_orderkey % 10 WHEN 3 THEN 'missing' WHEN 5 THEN 'repeated' ELSE 'orphan' END AS fault, count(*) AS n FROM orders WHERE o_orderkey % 10 IN (3, 5, 7) GROUP BY 1""",
    "validity_rates": """SELECT count(*) AS n, round(avg((event_id % 8 IN (0, 7))::INT), 6) AS strict_rate, round(avg((event_id % 8 IN (0, 1, 2, 3, 7))::INT), 6) AS lenient_rate FROM events""",
    "filing_stats": """WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 7 <> 0)::INT AS g, o_totalprice AS p FROM orders
), v AS (SELECT k, 1 * g AS revenue_num, g AS revenue_den, 0 AS net_income_num, g AS net_income_den, (k % 5 <> 0)::INT * g AS total_assets_num, g AS total_assets_den, 0 AS eps_diluted_num, g AS eps_diluted_den,
  (k % 3 <> 0)::INT AS has, k % 4 AS ng, k % 5 AS np, least(k % 4, k % 5) AS tp, least(k % 2, k % 5, k % 4) AS mt FROM o)
SELECT k::VARCHAR AS accession_no, (k % 2 = 0)::INT::DOUBLE AS strict_valid_rate_num, 1.0::DOUBLE AS strict_valid_rate_den, (k % 4 <> 1)::INT::DOUBLE AS lenient_valid_rate_num, 1.0::DOUBLE AS lenient_valid_rate_den,
  (revenue_num + total_assets_num)::DOUBLE AS numeric_accuracy_num, (4 * revenue_den)::DOUBLE AS numeric_accuracy_den,
  revenue_num::DOUBLE AS numeric_revenue_num, revenue_den::DOUBLE AS numeric_revenue_den, net_income_num::DOUBLE AS numeric_net_income_num, net_income_den::DOUBLE AS numeric_net_income_den,
  total_assets_num::DOUBLE AS numeric_total_assets_num, total_assets_den::DOUBLE AS numeric_total_assets_den, eps_diluted_num::DOUBLE AS numeric_eps_diluted_num, eps_diluted_den::DOUBLE AS numeric_eps_diluted_den,
  round(CASE WHEN has = 1 THEN CASE WHEN np > 0 AND ng > 0 AND tp > 0 THEN 2 * (tp::DOUBLE / np) * (tp::DOUBLE / ng) / (tp::DOUBLE / np + tp::DOUBLE / ng) ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END, 6) AS macro_category_f1_num, has::DOUBLE AS macro_category_f1_den, round(CASE WHEN has = 1 THEN CASE WHEN np > 0 AND ng > 0 AND mt > 0 THEN 2 * (mt::DOUBLE / np) * (mt::DOUBLE / ng) / (mt::DOUBLE / np + mt::DOUBLE / ng) ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END, 6) AS macro_match_f1_num, has::DOUBLE AS macro_match_f1_den FROM v""",
    "encode_rejects": _CHATS + "SELECT conv_id, 'completion_too_long' AS reason FROM rendered WHERE length(c) + 1 >= 512",
    "subset_first": "SELECT doc_id, source AS ticker FROM documents WHERE source IN ('src1', 'src2', 'src3') ORDER BY doc_id LIMIT 50",
    "measured_lengths": "SELECT doc_id, (length(coalesce(text, '')) + 2)::INT AS prompt, (length(source) + 1)::INT AS completion, (length(coalesce(text, '')) + length(source) + 3)::INT AS total FROM documents",
    "cache_keys": """SELECT doc_id, source || '-a-b/' || doc_id || '_' || substr(sha256('prompt ' || text), 1, 12) AS cache_key, doc_id % 4 = 0 AS cache_hit FROM documents""",
}

_METRICS = ["strict_valid_rate", "lenient_valid_rate", "numeric_accuracy", "numeric_revenue", "numeric_net_income", "numeric_total_assets", "numeric_eps_diluted", "macro_category_f1", "macro_match_f1"]
_EVALUATION = ", ".join(f"sum({m}_{x}) AS {m}_{x}" for m in _METRICS for x in ("num", "den"))
ORACLES["evaluation_ci"] = _bootstrap(
    f"WITH stats AS (SELECT o_custkey, {_EVALUATION} FROM ({ORACLES['filing_stats']}) JOIN orders ON o_orderkey::VARCHAR = accession_no GROUP BY o_custkey)", "o_custkey", _METRICS, digits=4
)
