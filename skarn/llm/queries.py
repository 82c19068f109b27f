"""Queries of the operators with production parameters, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe_lexicon, centroid_clusters, decontaminate, html_extract, language_id, ngram_join, prefix_trie, quality_mil, secret_scan, substring_dedup, token_counts, url_filter

#: Rules of the URL query.
RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 20)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_lexicon.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), judged AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM urls
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

OP2_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS s
  FROM texts, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS u(i) WHERE len(ws) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
)
SELECT reach.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""

OP6_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(ws[i:i + 19], ' ')) ORDER BY doc_id, i) AS nth
  FROM texts, unnest(range(1, len(ws) - 18)) AS u(i)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM windows, unnest(range(0, 20)) AS v(k) WHERE nth > 1
), places AS (
  SELECT doc_id, i, ws[i] AS w FROM texts, unnest(range(1, len(ws) + 1)) AS u(i)
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""



OP12_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END)) AS t
), turns AS (
  SELECT conv_id AS c, x, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS p
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT c, n, c - c % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda x, b: xor(t[xor(x, b) % 256 + 1], x // 256))) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc
), plan AS (SELECT convs.*, least(h, coalesce(o.n, 0)) AS lent FROM convs LEFT JOIN (SELECT c AS base, n FROM convs) o USING (base)
), rebuilt AS (
  SELECT plan.c, p AS d, x, size FROM plan JOIN turns ON turns.c = base AND p <= lent
  UNION ALL SELECT plan.c, p - h + lent, x, size FROM plan JOIN turns ON turns.c = plan.c AND p > h
), paths AS (SELECT c, d, size, list(x) OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT c, 0, 0, [] FROM plan
), members AS (SELECT c, d, size, min(c) OVER (PARTITION BY path) AS m, max(d) OVER (PARTITION BY c) AS n FROM paths
), nodes AS (
  SELECT m, d, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256 FROM members GROUP BY m, d
), linked AS (SELECT nodes.*, up.m AS parent FROM nodes LEFT JOIN members up ON up.c = nodes.m AND up.d = nodes.d - 1
), counted AS (SELECT linked.*, coalesce(k, 0) AS n_children FROM linked LEFT JOIN (SELECT parent AS m, d - 1 AS d, count(*) AS k FROM linked WHERE d > 0 GROUP BY ALL) USING (m, d)
), sums AS (
  SELECT up.m, up.d, sum((low.n_children = 0)::INT) AS n_leaves, sum((low.n_convs - 1) * low.size) AS saved_tokens
  FROM counted low JOIN members up ON up.c = low.m AND up.d <= low.d GROUP BY up.m, up.d
)
SELECT m AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (m, d)
"""


def _op13_sql(rounds: int = 10) -> str:
    ctes = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64)""", """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h LIMIT 8))"""]
    near = "a{0} AS MATERIALIZED (SELECT r, min((d, c)) AS m FROM (SELECT v.r, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - k.q[i]) * (v.q[i] - k.q[i])))::BIGINT AS d FROM v, c{0} k) GROUP BY r)"
    for k in range(rounds):
        ctes.append(near.format(k))
        sums = f"SELECT m[2] AS c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{k} JOIN v USING (r), unnest(range(1, 65)) AS u(i) GROUP BY ALL"
        ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(w.q, o.q) AS q FROM c{k} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM ({sums}) GROUP BY c) w USING (c))")
    return f"""
WITH {", ".join([*ctes, near.format(rounds)])}
SELECT vec_id, m[2]::INT AS cluster, m[1] AS distance, (sum(m[1]) OVER (PARTITION BY m[2]))::BIGINT AS cluster_inertia, (sum(m[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} k ON k.c = m[2]
"""


OP13_SQL = _op13_sql()


def _op9_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    entropy = secret_scan.CANDIDATE.removesuffix("+")
    kinds = [("assign", secret_scan.ASSIGN, 2, "length(g[i]) >= 6"), ("access", secret_scan.ACCESS, 0, "length(m[i]) >= 20"), ("hex", secret_scan.HEX, 0, "length(m[i]) >= 24"), ("entropy", entropy, 0, "true")]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, m[i] AS hit, (list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT AS s "
        f"FROM (SELECT doc_id, regexp_split_to_array(x, {quoted(pattern)}) AS p, regexp_extract_all(x, {quoted(pattern)}) AS m, regexp_extract_all(x, {quoted(pattern)}, {group}) AS g FROM t WHERE regexp_matches(x, {quoted(pattern)})), "
        f"unnest(range(1, len(m) + 1)) AS u(i) WHERE {ok}"
        for k, (kind, pattern, group, ok) in enumerate(kinds)
    )
    # RE2 has no back references: a run of one character is told by its first character.
    allowed = " OR ".join(f"regexp_matches(hit, {quoted(p)})" for p in secret_scan.ALLOW if "\\1" not in p) + " OR length(replace(hit, hit[1], '')) = 0"
    w, least = secret_scan.WINDOW, secret_scan.LEAST_BITS
    highest = f"list_max(list_transform(range(1, greatest(1, length(hit) - {w - 1}) + 1), lambda j: list_aggregate(string_split(substr(hit, j, {w}), ''), 'entropy')))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents
), spans AS (SELECT doc_id, k, kind, hit, s, s + length(hit) AS e FROM ({found})
), random AS (
  SELECT doc_id, k, kind, s, e FROM spans r
  WHERE k = 3 AND NOT ({allowed}) AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
    AND {highest} >= CASE WHEN regexp_matches(hit, '^[0-9a-fA-F]+$') THEN {least["hex"]}::DOUBLE WHEN regexp_matches(hit, '^[A-Za-z0-9]+$') THEN {least["alnum"]}::DOUBLE ELSE {least["base64"]}::DOUBLE END
    AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = r.doc_id AND b.k < 3 AND b.s <= r.s AND b.e >= r.e)
), both_kinds AS (SELECT doc_id, k, kind, s, e FROM spans WHERE k < 3 UNION ALL SELECT * FROM random)
SELECT t.doc_id, coalesce(sum((k = 0)::INT), 0)::BIGINT AS n_assign, coalesce(sum((k = 1)::INT), 0)::BIGINT AS n_access, coalesce(sum((k = 2)::INT), 0)::BIGINT AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '') AS spans
FROM t LEFT JOIN both_kinds ON both_kinds.doc_id = t.doc_id GROUP BY t.doc_id
"""


QUERIES = {f.__name__: f for f in (op1_language_id, op2_ngram_jaccard_join, op3_nearest_neighbours, op4_html_extraction, op5_url_filters, op6_substring_dedup, op7_bpe_round_trip, op8_decontamination, op9_secret_scans, op10_token_counts, op11_quality_classifier, op12_conversation_prefix_trie, op13_centroid_clustering)}
ORACLES = {"op2_ngram_jaccard_join": OP2_SQL, "op6_substring_dedup": OP6_SQL, "op9_secret_scans": _op9_sql(), "op5_url_filters": OP5_SQL, "op12_conversation_prefix_trie": OP12_SQL, "op13_centroid_clustering": OP13_SQL}
