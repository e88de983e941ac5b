"""The registered queries of the corpus operators, thin over the operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, hard_negatives, jaccard_join, language, packing, repair, simhash, substring_dedup, token_output, url_filter, warc

#: The rules that op8 applies before the method's own patterns. Fixed values.
HOST_RULES = (
    url_filter.host_rule("block", "net", "/"),
    url_filter.host_rule("allow", "example.net", "/en/"),
    url_filter.host_rule("block", "example.com", "/de/"),
    url_filter.host_rule("allow", "org", "/fr/"),
)


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), window=35, texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), ngram=3, words=1, radius=2)
    return found.select("doc_id", "fingerprint", "component_id", "group_size")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations")).select("conv_id", F.lit(0).alias("segment"), "n_turns", "text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "similarity", "distance")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_table(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.filter_urls(_table(spark, sf_dir, "pages"), HOST_RULES + url_filter.OWN_PATTERNS)
    return found.withColumn("rule", F.when(F.col("rule").isin(*[r.name for r in HOST_RULES]), F.col("rule")))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log derived from pages: each page as a response (every fiftieth a 404), and for every third page a revisit two
    days later; some with another ETag, some from before any response, some without validators."""
    p = F.col("page_id")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (p % 28) * 86_400 + p % 86_400)
    tag = F.concat(F.lit('ETag: "e'), (p % 7).cast("string"), F.lit('"\r\n'))
    first = pages.select(
        (p * 10).alias("record_id"), "url", F.lit("response").alias("kind"), at.alias("at"), F.when(p % 50 == 0, 404).otherwise(200).alias("status"),
        F.concat(F.lit("Content-Type: text/html\r\nCache-Control: max-age=60\r\n"), tag).alias("http"), F.col("html").alias("payload"),
    )
    again = pages.where(p % 3 == 0).select(
        (p * 10 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), F.lit("revisit").alias("kind"),
        F.when(p % 21 == 0, at - F.expr("INTERVAL 40 DAYS")).otherwise(at + F.expr("INTERVAL 2 DAYS")).alias("at"), F.lit(304).alias("status"),
        F.concat(F.lit("Server: edge\r\nCache-Control: max-age=120\r\n"), F.when(p % 15 == 0, F.lit('ETag: "other"\r\n')).when(p % 33 == 0, F.lit("")).otherwise(tag)).alias("http"), F.lit("").alias("payload"),
    )
    return first.union(again)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, parsed again and their revisits resolved."""
    return warc.resolve_revisits(warc.parse_records(warc.format_records(captures(_table(spark, sf_dir, "pages")))))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=1)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return repair.repair_conversations(repair.damaged(rows), ids=rows, texts=False)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"), ngram=4, percent=85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_simhash_near_dedup, op3_token_output, op4_chat_format, op5_decontaminate, op6_language_id, op7_exact_dedup, op8_url_filter, op9_warc_revisits, op10_packing, op11_structure_repair, op12_hard_negatives, op13_jaccard_join, pipeline)}

ORACLES = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tok AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, n, i, word, CASE WHEN i + 34 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS k FROM tok),
rep AS (SELECT doc_id, i, word, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS again FROM win),
cov AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM rep),
s AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""",
    "op4_chat_format": r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line FROM conversations),
p AS (SELECT conv_id, pos, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pre, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
whole AS (SELECT conv_id, n, pre FROM p WHERE pos = n)
SELECT min(conv_id) AS conv_id, CAST(0 AS INT) AS segment, n AS n_turns, pre AS text FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.n AND p.pre = w.pre) GROUP BY n, pre""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents""",
    "op8_url_filter": r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT page_id, max_by(h || rules.p, length(h || rules.p)) AS rule, max_by(v, length(h || rules.p)) AS v FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host || path, '(?i)/(account/)?login(/|$)') OR regexp_matches(host || path, '(?i)^([^/]*\.)?adserver\.') OR regexp_matches(host || path, '(?i)/checkout(/|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON best.page_id = p.page_id""",
    "op9_warc_revisits": r"""
WITH u AS (SELECT page_id, html, regexp_replace(coalesce(url, ''), '#.*$', '') AS u FROM pages),
parts AS (SELECT page_id, html, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM u),
q AS (SELECT page_id, html, head, regexp_extract(rest, '^([^?]*)', 1) AS path,
  array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')), '&') AS query FROM parts),
c AS (SELECT page_id, html, 1704067200 + (page_id % 28) * 86400 + page_id % 86400 AS ts, '"e' || CAST(page_id % 7 AS VARCHAR) || '"' AS tag,
  head || CASE WHEN head <> '' AND path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url FROM q),
resp AS (SELECT page_id * 10 AS id, url, ts, tag, html FROM c WHERE page_id % 50 <> 0),
rev AS (SELECT page_id * 10 + 1 AS record_id, url, CASE WHEN page_id % 21 = 0 THEN ts - 40 * 86400 ELSE ts + 2 * 86400 END AS ts,
  CASE WHEN page_id % 15 = 0 THEN '"other"' WHEN page_id % 33 = 0 THEN '' ELSE tag END AS tag FROM c WHERE page_id % 3 = 0),
j AS (SELECT v.record_id, v.url, v.tag, max_by(r.id, (r.ts, r.id)) AS id, max_by(r.tag, (r.ts, r.id)) AS rtag, max_by(sha256(coalesce(r.html, '')), (r.ts, r.id)) AS digest
  FROM rev v LEFT JOIN resp r ON r.url = v.url AND r.ts < v.ts GROUP BY v.record_id, v.url, v.tag),
o AS (SELECT *, CASE WHEN id IS NULL THEN 'no_response' WHEN tag = '' THEN 'unverified' WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
SELECT record_id, url AS canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN id END AS response_id,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || tag END AS headers,
  CASE WHEN outcome = 'resolved' THEN digest END AS digest FROM o""",
    "op11_structure_repair": r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0 FROM conversations),
hit AS (SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fault FROM keyed, tab),
dam AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE r0 END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE fault <> 0),
o AS (SELECT conv_id AS c, turn, role, text, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS x,
  lag(left(role, 1)) OVER w AS before FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut FROM o),
facts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
  count(*) FILTER (WHERE i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY c),
pre(q, p, q1, made) AS (VALUES (0, '', 0, ''), (1, '', 1, ''), (2, '', 2, ''), (3, '', 3, ''), (0, 'I', 2, chr(10) || 'user:'), (1, 'I', 2, chr(10) || 'user:'), (2, 'I', 3, chr(10) || 'assistant:'), (3, 'I', 2, chr(10) || 'user:'),
  (0, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 'II', 2, chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:')),
ed(q1, e, x, q2, cost) AS (VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0), (0, 'R', NULL, 2, 1), (1, 'R', NULL, 2, 1), (2, 'R', NULL, 3, 1), (3, 'R', NULL, 2, 1), (0, 'D', NULL, 0, 2), (1, 'D', NULL, 1, 2), (2, 'D', NULL, 2, 2), (3, 'D', NULL, 3, 2)),
best(c, i, q, b) AS (SELECT c, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'made': ''} FROM facts
  UNION ALL SELECT best.c, f.i, q2, min({'cost': best.b.cost + 5 * length(p) + ed.cost + CASE WHEN e <> 'D' AND cut THEN 5 ELSE 0 END, 'audit': best.b.audit || p || e,
    'made': best.b.made || pre.made || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || text END})
  FROM best JOIN f ON f.c IS NOT DISTINCT FROM best.c AND f.i = best.i + 1 JOIN pre ON pre.q = best.q JOIN ed ON ed.q1 = pre.q1 AND (ed.x IS NULL OR ed.x = f.x) AND (e = 'D' OR NOT blank AND NOT dup) GROUP BY best.c, f.i, q2),
done AS (SELECT best.c, min({'cost': b.cost + 5 * length(p), 'audit': b.audit || p, 'made': b.made || pre.made}) AS b FROM best JOIN facts ON facts.c IS NOT DISTINCT FROM best.c AND n = best.i JOIN pre ON pre.q = best.q WHERE q1 IN (0, 3) GROUP BY best.c)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(substr(b.made, 2), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN facts ON facts.c IS NOT DISTINCT FROM d.conv_id LEFT JOIN done ON done.c IS NOT DISTINCT FROM d.conv_id""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, p.s AS ps, s.b AS negative_id, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank FROM p JOIN s ON s.a = p.a AND s.la <> s.lb AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 10""",
    "op13_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) m ON m.a = d.doc_id""",
}
