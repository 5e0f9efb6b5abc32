"""The query of each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm import crf, langid, licenses, linedup, mixing, simhash, sphere, substrings, warc, winnow
from paneloom.llm.shared import fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    at = F.transform("places", lambda p: p["word"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    other = F.transform("blocks", lambda b: b["label"])
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, other))), ",").alias("labels"),
        score.alias("score"),
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sphere.linked_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    number = lambda c: F.substring_index(c, "-", -1).cast("long")
    return found.select(number("record_id").alias("page_id"), "canonical", "status", number("response_id").alias("response_page_id"), headers.alias("headers"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.where(F.col("lang").isNotNull() & (fold_of(F.col("doc_id")) != 2))
    found = langid.identify(docs, learned)
    return found.select(F.col("id").alias("doc_id"), (fold_of(F.col("id")) == 2).alias("held_out"), "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    other = fold_of(F.col("doc_id")) != 2
    found = crf.tag(docs, docs.where(other), labels.where(other))
    return found.select(F.col("id").alias("doc_id"), (fold_of(F.col("id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op1_simhash": op1_simhash, "op2_licenses": op2_licenses, "op3_embeddings": op3_embeddings, "op4_substrings": op4_substrings, "op5_warc": op5_warc, "op6_mixing": op6_mixing, "op7_langid": op7_langid, "op8_decontaminate": op8_decontaminate, "op9_toxicity": op9_toxicity, "op10_linededup": op10_linededup}

ORACLES = {
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source AS src, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
totals AS (SELECT src, CAST(sum(size) AS DOUBLE) AS tokens FROM sized GROUP BY src),
ranked AS (SELECT *, row_number() OVER (ORDER BY src NULLS LAST) - 1 AS rk FROM totals),
weighed AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS wt, 3.0::DOUBLE * tokens AS cap FROM ranked),
levels AS (
  SELECT *, (sum(tokens) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / wt, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(wt) OVER (ORDER BY cap / wt, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
open_level AS (SELECT level AS lv FROM levels WHERE level * wt <= cap ORDER BY cap / wt, rk LIMIT 1),
targets AS (SELECT src, tokens, CASE WHEN lv IS NULL THEN cap ELSE least(cap, lv * wt) END AS target FROM levels LEFT JOIN open_level ON true),
rates AS (SELECT *, CASE WHEN tokens > 0 THEN target / tokens ELSE 0 END AS rate FROM targets),
groups AS (SELECT s.src, s.size, count(*) AS n, any_value(target) AS target, any_value(tokens) AS tokens, any_value(rate) AS rate FROM sized s JOIN rates r ON s.src IS NOT DISTINCT FROM r.src GROUP BY s.src, s.size),
started AS (SELECT *, floor(rate) AS low, coalesce(sum(n) OVER (PARTITION BY src ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start FROM groups),
rounded AS (SELECT *, floor((start + n) * (rate - low) + 0.5) - floor(start * (rate - low) + 0.5) AS ups FROM started),
missed AS (SELECT *, target - sum((low * n + ups) * size) OVER (PARTITION BY src) AS miss FROM rounded),
able AS (SELECT *, CASE WHEN rate = low THEN 0 WHEN miss > 0 THEN n - ups ELSE ups END AS can FROM missed),
spent AS (SELECT *, coalesce(sum(can * size) OVER (PARTITION BY src ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM able),
turned AS (SELECT *, CASE WHEN size > 0 THEN greatest(0, least(can, round((abs(miss) - used) / size))) ELSE 0 END AS turn FROM spent),
final AS (SELECT src, size, low, target, tokens, ups + CASE WHEN miss > 0 THEN turn ELSE -turn END AS ups FROM turned),
placed AS (SELECT *, row_number() OVER (PARTITION BY src, size ORDER BY h, doc_id) AS i FROM sized)
SELECT p.doc_id, p.size, CAST(f.tokens AS BIGINT) AS source_size, f.target, CAST((f.low + CASE WHEN p.i <= f.ups THEN 1 ELSE 0 END) * p.size AS BIGINT) AS taken
FROM placed p JOIN final f ON p.src IS NOT DISTINCT FROM f.src AND p.size = f.size
""",
    "op5_warc": r"""
WITH parts AS (
  SELECT page_id, url, html, regexp_replace(url, '#.*$', '') AS u FROM pages),
canon AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, CAST(coalesce(strlen(html), 0) AS VARCHAR) AS n,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(u, '^[^:]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS params
  FROM parts),
caps AS (SELECT page_id, digest, n, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN params = '' THEN '' ELSE '?' || params END AS canonical FROM canon),
met AS (
  SELECT a.page_id, a.canonical, a.digest, max(f.page_id) AS response_page_id
  FROM caps a LEFT JOIN caps f ON a.canonical = f.canonical AND f.page_id * 2 < a.page_id * 2 + 2001 AND f.page_id % 10 <> 7
  GROUP BY ALL)
SELECT m.page_id, m.canonical, m.response_page_id,
  CASE WHEN m.response_page_id IS NULL THEN 'none' WHEN m.page_id % 5 <> 4 AND m.digest = f.digest THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN m.response_page_id IS NOT NULL AND m.page_id % 5 <> 4 AND m.digest = f.digest
    THEN 'age=' || m.page_id || ';content-length=' || f.n || ';content-type=text/html;etag=W/' || m.digest END AS headers
FROM met m LEFT JOIN caps f ON m.response_page_id = f.page_id
""",
    "op3_embeddings": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_ AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN least_ ON vec_id = least_.x LEFT JOIN n ON vec_id = n.x
""",
    "op4_substrings": r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM words, unnest(range(1, len(w) - 11)) AS t(i)),
first AS (SELECT win, min(doc_id) AS low FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, p FROM windows JOIN first USING (win), unnest(range(i, i + 13)) AS t(p) WHERE low < doc_id),
gone_lists AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
places AS (SELECT doc_id, p, w[p] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS txt FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM words LEFT JOIN gone_lists USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op8_decontaminate": r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS t(i) WHERE len(w) > 0),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM words, (SELECT DISTINCT n FROM item_windows) AS lens, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT d.doc_id, d.i, d.n, x.item_id FROM doc_windows d JOIN item_windows x ON d.win = x.win AND d.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op10_linededup": r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)),
doomed AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
flagged AS (SELECT doc_id, i, line, (last IS NOT NULL AND doc_id <> last) AS gone FROM lines LEFT JOIN doomed USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
""",
}


def _license_sql() -> str:
    """Phrases by their words, and every block of consecutive lines against every template."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    between = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    phrases = ", ".join(f"({text(p)}, {text(label)}, {len(p.split())})" for p, label in licenses.PHRASES)
    words = lambda own: "[" + ", ".join(text(w.decode()) for w in sorted(own)) + "]"
    size = lambda own: licenses.LONG_LINES if len(own) >= licenses.LONG_FROM else licenses.SHORT_LINES
    templates = ", ".join(f"({text(label)}, {words(own)}, {size(own)})" for label, own in licenses.template_words())
    return f"""
WITH docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, list_filter(string_split_regex(t, {between}), lambda w: w <> '') AS w FROM docs),
places AS (SELECT doc_id, i - 1 AS place, label FROM words, (VALUES {phrases}) AS p(phrase, label, n), unnest(range(1, len(w) - n + 2)) AS s(i) WHERE w[i] = split_part(phrase, ' ', 1) AND array_to_string(w[i:i + n - 1], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda l: string_split_regex(l, {between})) AS ls FROM docs),
shares AS (SELECT doc_id, label, len(list_intersect(flatten(ls[i:i + size - 1]), own)) / len(own) AS share FROM lines, (VALUES {templates}) AS m(label, own, size), unnest(range(1, len(ls) + 1)) AS s(i)),
found AS (SELECT doc_id, label, max(share) AS share FROM shares WHERE share >= {licenses.THRESHOLD} - 1e-9 GROUP BY doc_id, label),
labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM found UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0)) AS DOUBLE) AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN labelled USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLES["op2_licenses"] = _license_sql()
