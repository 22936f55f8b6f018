"""DuckDB equivalents of the registered queries. The exact Unicode mode is compared on text in which both modes agree, as that of the tables."""

from __future__ import annotations

from ..operators.access import DOMAINS
from ..operators.vector import IGNORED, LOWER, TOKEN_DOMAIN, UPPER
from .queries import DIMENSION, GATED, PUBLIC_FIELDS, QUESTIONS, SCORER, scorer

_DOMAINS = "[" + ", ".join(f"'{d}'" for d in DOMAINS) + "]"
#: Pages as members v (page_id, path, shown) and their spellings s (spelling, path, refused).
_MEMBERS = r"""WITH u AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS p FROM pages),
v AS (SELECT page_id, 'Core/' || CASE WHEN page_id % 3 = 0 THEN '_' ELSE '' END || p[2] || '/' || left(p[3], 2) || '.md' AS path, 'Core/' || p[2] || '/' || left(p[3], 2) || '.md' AS shown FROM u),
x AS (SELECT path AS spelling, path FROM v UNION SELECT shown, path FROM v),
b AS (SELECT path FROM x WHERE spelling IN (SELECT spelling FROM x GROUP BY spelling HAVING count(DISTINCT path) > 1)),
s AS (SELECT spelling, path, path IN (SELECT path FROM b) AS refused FROM x)"""
_FLAT = r"trim(regexp_replace(body, '\s+', ' ', 'g'))"
_TOKENS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9]+|[^\\x00-\\x7f{IGNORED}]')"
_BUCKETS = f"""
tok AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents),
cnt AS (SELECT doc_id, token, count(*) AS c FROM tok GROUP BY ALL),
buckets AS (
  SELECT doc_id, ((('0x' || substr(sha256('{TOKEN_DOMAIN}' || token), 1, 16))::UBIGINT) % {DIMENSION})::INTEGER AS bucket, sum(c)::BIGINT AS n FROM cnt GROUP BY ALL
)"""

_SNIPPETS = f"""WITH {PUBLIC_FIELDS}, {SCORER}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM kept),
h AS (SELECT r.qid, rank, r.total, r.doc_id, {_FLAT} AS flat, list_min(list_filter(list_transform(tokens, lambda t: strpos(lower({_FLAT}), t)), lambda p: p > 0)) AS hit
  FROM r JOIN gated g USING (doc_id) JOIN q USING (qid) WHERE rank <= 10),
w AS (SELECT *, greatest(0, coalesce(hit - 1, 0) - 106) AS s0 FROM h),
e AS (SELECT *, least(length(flat), s0 + 320) AS e FROM w), bb AS (SELECT *, greatest(0, e - 320) AS s FROM e),
c AS (SELECT *, substr(flat, s + 1, e - s) AS cut FROM bb),
l AS (SELECT *, CASE WHEN s > 0 THEN '…' || substr(cut, 2) ELSE cut END AS left_cut FROM c),
snippets AS (SELECT qid, rank, total, doc_id, CASE WHEN length(flat) <= 320 THEN flat WHEN e < length(flat) THEN substr(left_cut, 1, length(left_cut) - 1) || '…' ELSE left_cut END AS snippet FROM l)"""
_FOLDED_FIELDS = PUBLIC_FIELDS
for _field in ("title", "description", "metadata", "body"):
    _FOLDED_FIELDS = _FOLDED_FIELDS.replace(f"lower({_field})", f"replace(lower(nfc_normalize({_field})), 'ß', 'ss')")
_GATE = """WITH s AS (
  SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS correct, count(*) FILTER (event_type = 'error' AND value < 0) AS leaks, count(*) FILTER (event_type = 'signup') AS asked, count(*) FILTER (event_type = 'signup' AND value > 20) AS hits,
    round_even(count(*) FILTER (event_type = 'purchase' AND value > 20) / nullif(count(*) FILTER (event_type = 'purchase'), 0), 4) AS mine, count(*) FILTER (value > 50) AS lt, count(*) FILTER (value > 40) AS bt, count(*) FILTER (value IS NULL) AS unmeasured,
    coalesce(quantile_disc(value, 0.95) FILTER (event_type = 'purchase'), 0) AS lp, coalesce(quantile_disc(value, 0.95) FILTER (event_type = 'signup'), 0) AS bp FROM events
), d AS (SELECT *, round_even(hits / nullif(asked, 0), 4) AS theirs, asked > 0 AND hits = 0 AS degenerate, asked = 0 AS alone FROM s),
judged AS (
  SELECT ['citation_correctness', 'privacy_false_negative', 'baseline_compared', 'baseline_scope_overlap', 'answerable_hit_rate', 'context_token_total', 'latency_p95', 'stale_exclusion', 'privacy_false_positive'] || CASE WHEN degenerate THEN ['degenerate_baseline'] ELSE [] END AS items,
    ['absolute', 'absolute', 'precondition', 'precondition', 'relative', 'relative', 'relative', 'relative', 'quality'] || CASE WHEN degenerate THEN ['absolute'] ELSE [] END AS kinds,
    [CASE WHEN total = 0 THEN 'not_evaluable' WHEN correct = total THEN 'pass' ELSE 'fail' END, CASE WHEN leaks = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN asked > 0 THEN 'pass' ELSE 'fail' END, CASE WHEN hits > 0 THEN 'pass' ELSE 'fail' END,
      CASE WHEN degenerate OR alone OR mine IS NULL OR theirs IS NULL THEN 'not_evaluable' WHEN mine >= theirs THEN 'pass' ELSE 'fail' END, CASE WHEN degenerate OR alone OR unmeasured > 0 THEN 'not_evaluable' WHEN lt <= bt THEN 'pass' ELSE 'fail' END,
      CASE WHEN degenerate OR alone THEN 'not_evaluable' WHEN lp <= 2 * bp THEN 'pass' ELSE 'fail' END, 'not_evaluable', 'recorded'] || CASE WHEN degenerate THEN ['fail'] ELSE [] END AS statuses FROM d
)"""
_ASKED = ", ".join(f"('{q}', '{text}', '{p}', '{a}', '{b}')" for q, text, p, (a, b) in QUESTIONS)
#: Per question and engine: expected and returned paths with what the report measures.
_SHADOW = f"""WITH {PUBLIC_FIELDS}, {scorer([(q, text) for q, text, _, _ in QUESTIONS])}, {_BUCKETS},
asked AS (SELECT * FROM (VALUES {_ASKED}) t(qid, text, provenance, a, b)),
least_doc AS (SELECT qid, min(doc_id) AS e FROM asked, f WHERE contains(f.body, a) AND contains(f.body, b) GROUP BY qid),
questions AS (SELECT qid, provenance, e, CASE WHEN e IS NULL THEN 'no-answer' ELSE 'lookup' END AS category FROM asked LEFT JOIN least_doc USING (qid)),
qtok AS (SELECT qid, unnest({_TOKENS}) AS token FROM asked),
qcnt AS (SELECT qid, token, count(*) AS c FROM qtok GROUP BY ALL),
qb AS (SELECT qid, ((('0x' || substr(sha256('{TOKEN_DOMAIN}' || token), 1, 16))::UBIGINT) % {DIMENSION})::INTEGER AS bucket, sum(c)::BIGINT AS n FROM qcnt GROUP BY ALL),
bn AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)::DOUBLE) AS x FROM buckets JOIN f USING (doc_id)),
qn AS (SELECT qid, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY qid)::DOUBLE) AS x FROM qb),
docs_in AS (SELECT DISTINCT doc_id FROM bn),
cosine AS (SELECT qid, doc_id, coalesce(sum(bn.x * qn.x), 0) AS score FROM (SELECT * FROM docs_in, (SELECT DISTINCT qid FROM qn)) JOIN bn USING (doc_id) LEFT JOIN qn USING (qid, bucket) GROUP BY ALL),
returned AS (
  SELECT qid, 'lexical' AS engine, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM kept) WHERE r <= 10
  UNION ALL SELECT qid, 'vector', doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM cosine) WHERE r <= 10
),
old AS (SELECT doc_id FROM (SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY text) AS o FROM documents) WHERE o),
tokens AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS tokens FROM documents),
per AS (
  SELECT qid, engine, count(*) AS results, list(doc_id) AS ids, sum(tokens) AS cost, count(*) FILTER (tokens IS NULL) AS unmeasured, count(*) FILTER (doc_id IN (SELECT doc_id FROM old)) AS stale
  FROM returned LEFT JOIN tokens USING (doc_id) GROUP BY ALL
),
report AS (
  SELECT q.qid, e.engine, category, provenance, (q.e IS NOT NULL)::INTEGER AS expected, coalesce(results, 0)::INTEGER AS results, CASE WHEN q.e IS NOT NULL THEN coalesce(list_contains(ids, q.e), false) END AS hit,
    0::BIGINT AS leaks, CASE WHEN coalesce(unmeasured, 0) = 0 THEN coalesce(cost, 0) END::BIGINT AS token_cost, coalesce(stale, 0) > 0 AS stale_returned, true AS citations_correct
  FROM questions q CROSS JOIN (SELECT unnest(['lexical', 'vector']) AS engine) e LEFT JOIN per USING (qid, engine)
)"""

ORACLES: dict[str, str] = {
    "gate_partition": f"""WITH {GATED}
SELECT privacy, CASE WHEN privacy IS NULL THEN 'privacy-missing' WHEN privacy = 'student-private' THEN 'student-private-sink' WHEN privacy <> 'public' THEN 'privacy-not-admissible' END AS reason,
  privacy IS NOT NULL AND privacy = 'public' AS admitted, count(*) AS n FROM gated GROUP BY ALL""",
    "strictness_histogram": f"""WITH {GATED}
SELECT privacy, count(*) AS n, max(list_position(['public', 'internal', 'sensitive', 'student-private'], privacy) - 1)::INTEGER AS strictness,
  count(*) FILTER (privacy IN ('sensitive', 'student-private')) AS at_least_sensitive FROM gated WHERE privacy IS NOT NULL GROUP BY privacy""",
    "note_classification": r"""WITH t AS (
  SELECT CASE WHEN doc_id % 7 = 0 THEN text WHEN doc_id % 11 = 0 THEN '---' || chr(10) || 'privacy: public' || chr(10) || regexp_replace(text, '(?m)^---$', '', 'g')
    ELSE '---' || chr(13) || chr(10) || ['privacy: public', 'privacy:  ''internal'' ', 'privacy:public', 'privacy: Public', 'tags: x', 'privacy: sensitive' || chr(10) || 'privacy: public'][doc_id % 6 + 1] || chr(10) || '---' || chr(10) || text END AS note FROM documents
), l AS (SELECT list_transform(string_split(note, chr(10)), lambda x: regexp_replace(x, '\r+$', '')) AS lines FROM t),
e AS (SELECT lines, list_position(lines[2:], '---') AS stop FROM l),
p AS (SELECT lines, stop, list_filter(lines[2:stop], lambda x: starts_with(x, 'privacy:')) AS found FROM e),
v AS (SELECT *, regexp_extract(found[1], '^privacy:[ \t]+(?:''([a-z-]+)''|"([a-z-]+)"|([a-z-]+))[ \t]*$', ['a', 'b', 'c']) AS m FROM p),
c AS (SELECT *, coalesce(nullif(m.a, ''), nullif(m.b, ''), nullif(m.c, '')) AS value FROM v)
SELECT CASE WHEN len(found) = 1 AND lines[1] = '---' AND stop > 0 AND value IN ('public', 'internal', 'sensitive', 'student-private') THEN value END AS privacy,
  CASE WHEN lines[1] <> '---' THEN 'frontmatter-missing' WHEN coalesce(stop, 0) = 0 THEN 'frontmatter-unterminated' WHEN len(found) = 0 THEN 'privacy-missing' WHEN len(found) > 1 THEN 'privacy-duplicate'
    WHEN value IS NULL OR value NOT IN ('public', 'internal', 'sensitive', 'student-private') THEN 'privacy-invalid' END AS reason, count(*) AS n FROM c GROUP BY ALL""",
    "catalog_page": f"""WITH {GATED}, p AS (SELECT doc_id, title, metadata AS type FROM gated WHERE privacy = 'public' AND metadata = 'en'), t AS (SELECT count(*) AS total FROM p)
SELECT doc_id, title, type, total, CASE WHEN 15 < total THEN 15 END::BIGINT AS next_offset FROM p, t ORDER BY doc_id LIMIT 10 OFFSET 5""",
    "catalog_facets": f"""WITH {GATED}
SELECT metadata AS value, count(*) AS n, 'type' AS facet FROM gated WHERE privacy = 'public' AND metadata IS NOT NULL GROUP BY 1
UNION ALL SELECT description, count(*), 'source' FROM gated WHERE privacy = 'public' AND description IS NOT NULL GROUP BY 1""",
    "corpus_field_averages": f"""WITH {PUBLIC_FIELDS}
SELECT round(coalesce(avg(length(title)), 0), 6) AS title, round(coalesce(avg(length(description)), 0), 6) AS description, round(coalesce(avg(length(metadata)), 0), 6) AS metadata, round(coalesce(avg(length(body)), 0), 6) AS body FROM f""",
    "lexical_scores": f"WITH {PUBLIC_FIELDS}, {SCORER} SELECT qid, doc_id, round(score, 6) AS score, coverage FROM scored",
    "lexical_topk": f"""WITH {PUBLIC_FIELDS}, {SCORER}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM kept)
SELECT qid, doc_id, round(score, 6) AS score, total, rank FROM r WHERE rank <= 10""",
    "lexical_totals": f"WITH {PUBLIC_FIELDS}, {SCORER} SELECT qid, max(total) AS total, round(max(score), 6) AS top FROM kept GROUP BY qid",
    "snippet_window": f"{_SNIPPETS} SELECT qid, rank, doc_id, snippet FROM snippets",
    # DuckDB does not fold case: of what the tables hold, only the sharp s folds otherwise than it lowers.
    "lexical_topk_folded": f"""WITH {_FOLDED_FIELDS}, {SCORER}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM kept)
SELECT qid, doc_id, round(score, 6) AS score, total, rank FROM r WHERE rank <= 10""",
    "snippet_window_folded": f"{_SNIPPETS} SELECT qid, rank, doc_id, snippet FROM snippets",
    "context_pack": f"""{_SNIPPETS.replace('WITH', 'WITH RECURSIVE', 1)},
b AS (SELECT s.qid, rank, total, s.doc_id::VARCHAR AS id, trim(regexp_replace(snippet, '\\s+', ' ', 'g')) AS text, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title FROM snippets s JOIN gated g USING (doc_id)),
i AS (SELECT *, '] ' || CASE WHEN title = '' THEN id ELSE title END || chr(10) AS head, chr(10) || 'citation: concept_id=' || id || '; path=' || id || '.md; bundle_commit=0123abc; index_revision=r1' AS citation FROM b),
p AS (
  SELECT DISTINCT qid, 0 AS rank, 0 AS n, '' AS context, false AS cut, false AS closed FROM b
  UNION ALL
  SELECT qid, rank, CASE WHEN closed OR room < 0 THEN n ELSE n + 1 END, CASE WHEN closed OR room < 0 THEN context WHEN strlen(text) <= room THEN lead || text || citation
      ELSE lead || CASE WHEN room < 3 THEN '' ELSE rtrim(left(text, list_max(list_filter(range(0, length(text) + 1), lambda k: strlen(left(text, k::INTEGER)) <= room - 3))::INTEGER)) || '…' END || citation END,
    CASE WHEN closed OR room < 0 THEN cut ELSE cut OR strlen(text) > room END, closed OR room < 0
  FROM (SELECT p.qid, i.rank, p.n, p.context, p.cut, p.closed, i.text, i.citation, CASE WHEN p.n > 0 THEN p.context || chr(10) || chr(10) ELSE '' END || '[' || (p.n + 1) || i.head AS lead, 2048 - strlen(lead || i.citation) AS room FROM p JOIN i ON i.qid = p.qid AND i.rank = p.rank + 1)
)
SELECT qid, n::INTEGER AS n_items, sha256(context) AS context_sha256, strlen(context)::INTEGER AS used, cut OR total > n AS truncated
FROM (SELECT p.*, row_number() OVER (PARTITION BY p.qid ORDER BY p.rank DESC) AS r FROM p) JOIN (SELECT qid, max(total) AS total FROM b GROUP BY qid) USING (qid) WHERE r = 1""",
    # Two digits of the range, as of up to 1,048,576 members; a further level each 256 times as many.
    "bundle_revision": """WITH m AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS k, sha256(text) AS h FROM documents),
r AS (SELECT substr(sha256(k), 1, 2) AS range, sha256('sextant-index-v1' || chr(10) || coalesce(string_agg(k || chr(0) || h || chr(10), '' ORDER BY k, h), '')) AS d FROM m GROUP BY 1)
SELECT 'sha256:' || sha256('sextant-index-v1' || chr(10) || string_agg(range || chr(0) || d || chr(10), '' ORDER BY range, d)) AS revision FROM r""",
    "source_revisions": """WITH m AS (SELECT source, lpad(doc_id::VARCHAR, 12, '0') AS k, sha256(text) AS h FROM documents),
r AS (SELECT source, substr(sha256(k), 1, 2) AS range, count(*) AS c, sha256('sextant-index-v1' || chr(10) || coalesce(string_agg(k || chr(0) || h || chr(10), '' ORDER BY k, h), '')) AS d FROM m GROUP BY 1, 2)
SELECT source, sum(c)::BIGINT AS n, 'sha256:' || sha256('sextant-index-v1' || chr(10) || string_agg(range || chr(0) || d || chr(10), '' ORDER BY range, d)) AS revision FROM r GROUP BY source""",
    "framed_digests": """SELECT page_id, 'sha256:' || sha256(unhex(lpad(hex(strlen('page-v1')), 16, '0')) || encode('page-v1') || unhex(lpad(hex(strlen(url)), 16, '0')) || encode(url) || unhex(lpad(hex(strlen(html)), 16, '0')) || encode(html)) AS digest FROM pages""",
    "token_cost": f"""WITH {PUBLIC_FIELDS}, {SCORER}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM kept),
m AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS tokens FROM documents)
SELECT qid, CASE WHEN count(tokens) = count(*) THEN sum(tokens) END::BIGINT AS token_cost FROM r LEFT JOIN m USING (doc_id) WHERE rank <= 10 GROUP BY qid""",
    "text_sizes": r"""SELECT doc_id, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars, len(regexp_extract_all(text, '\S+'))::BIGINT AS words, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS compact_sha256 FROM documents""",
    "hash_embedding_buckets": f"WITH {_BUCKETS} SELECT * FROM buckets",
    "hash_embedding_rows": f"WITH {_BUCKETS} SELECT doc_id, round(max(n) / sqrt(sum(n * n)::DOUBLE), 9) AS largest, count(*)::INTEGER AS used FROM buckets GROUP BY doc_id",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(list_transform(p.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, round(score, 9) AS score FROM r WHERE rank < 10""",
    "rerank_topk": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(p.e, q.e) AS score, list_dot_product(p.e, q.e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(q.e, q.e))) AS cosine, p.label = q.label AS same FROM v q, v p WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) - 1)::INTEGER AS rank FROM n WHERE place <= 50 AND query_id <> vec_id AND same)
SELECT query_id, vec_id, round(cosine, 9) AS score, rank FROM r WHERE rank < 5""",
    "domain_scope": f"""WITH {GATED} SELECT {_DOMAINS}[doc_id % 6 + 1] AS domain, metadata AS type, count(*) AS n, min(doc_id) AS first FROM gated WHERE privacy = 'public' GROUP BY ALL""",
    "grant_resolution": f"""WITH j AS (SELECT e.*, o_custkey % 7 AS actor, o_orderdate + INTERVAL 24 YEARS AS issued, o_orderstatus AS st, o_orderkey FROM events e LEFT JOIN orders ON event_id = o_orderkey)
SELECT CASE WHEN o_orderkey IS NULL THEN 'invalid-credential' WHEN user_id % 7 <> actor THEN 'wrong-actor' WHEN ts < issued - INTERVAL 3 YEARS THEN 'scope-not-active' WHEN ts >= issued + INTERVAL 4 YEARS THEN 'scope-expired'
  WHEN st <> 'F' AND event_id % 6 >= 3 THEN 'domain-denied' WHEN event_type = 'view' AND st <> 'P' THEN 'capability-denied' END AS denial, event_type, count(*) AS n FROM j GROUP BY ALL""",
    "hit_rate_grouping_sets": f"""WITH {GATED}, f AS (SELECT doc_id, lower(title) AS title, lower(description) AS description, lower(metadata) AS metadata, lower(body) AS body FROM gated WHERE privacy IS NOT NULL), {SCORER},
h AS (SELECT metadata, CASE WHEN toxic = 1 THEN doc_id IN (SELECT doc_id FROM kept WHERE qid IN ('q2', 'q5')) END AS hit FROM gated WHERE privacy IS NOT NULL)
SELECT metadata, grouping(metadata) = 1 AS pooled, count(*) AS questions, count(hit) AS scored, count(*) FILTER (hit) AS hits, round_even(count(*) FILTER (hit) / nullif(count(hit), 0), 4) AS rate FROM h GROUP BY GROUPING SETS ((), (metadata))""",
    "latency_percentiles": """SELECT event_type, round_even(sum(value), 3) AS total, round_even(quantile_disc(value, 0.5), 3) AS p50, round_even(quantile_disc(value, 0.95), 3) AS p95 FROM events GROUP BY event_type""",
    "leak_and_false_positive": f"""WITH {GATED}, f AS (SELECT doc_id, lower(title) AS title, lower(description) AS description, lower(metadata) AS metadata, lower(body) AS body FROM gated), {SCORER}
SELECT qid AS what, count(*) AS n FROM scored JOIN gated USING (doc_id) WHERE privacy IS NULL OR privacy <> 'public' GROUP BY qid
UNION ALL SELECT 'false_positives', count(DISTINCT doc_id) FROM gated WHERE privacy = 'public' AND doc_id NOT IN (SELECT doc_id FROM gated WHERE metadata <> 'fr')""",
    "stale_exclusion": """WITH d AS (SELECT source, doc_id <> min(doc_id) OVER (PARTITION BY text) AS old FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (old) AS superseded, round_even(count(*) FILTER (NOT old) / count(*), 4) AS current_rate FROM d GROUP BY source""",
    "export_diff": """WITH c AS (SELECT o_orderkey AS k, 'Core/' || o_orderkey AS path, o_orderpriority AS title, o_orderstatus AS status FROM orders),
x AS (SELECT l_orderkey AS k, l_linenumber AS no, CASE WHEN l_returnflag = 'R' THEN './Core/' ELSE 'Core/' END || l_orderkey AS path, CASE WHEN l_returnflag = 'A' THEN 'old' ELSE o_orderpriority END AS title, CASE WHEN l_quantity > 45 THEN '' ELSE o_orderstatus END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT k, count(*) AS n, arg_min(path, (no, path, title, status)) AS path, arg_min(title, (no, path, title, status)) AS title, arg_min(status, (no, path, title, status)) AS status FROM x GROUP BY k),
j AS (SELECT c.k, g.k IS NULL AS missing, n > 1 AS extra, g.path <> c.path AS pm, g.title <> c.title OR nullif(g.status, '') IS DISTINCT FROM c.status AS mm FROM c LEFT JOIN g USING (k)),
l AS (SELECT unnest(CASE WHEN missing THEN ['missing_from_export'] WHEN NOT extra AND NOT pm AND NOT mm THEN ['matched_clean']
    ELSE list_filter([CASE WHEN extra THEN 'extra_in_export' END, CASE WHEN pm THEN 'path_mismatch' END, CASE WHEN mm THEN 'metadata_mismatch' END], lambda v: v IS NOT NULL) END) AS category,
  CASE WHEN missing THEN CASE WHEN k % 3 = 0 THEN 'structural' WHEN k % 2 = 0 THEN 'freshness' ELSE 'unknown' END END AS reason FROM j)
SELECT category, reason, count(*) AS n FROM l GROUP BY ALL""",
    "shadow_report": f"{_SHADOW} SELECT * FROM report",
    "shadow_summary": f"""{_SHADOW},
groups AS (SELECT engine, provenance FROM (SELECT unnest(['lexical', 'vector']) AS engine) CROSS JOIN (SELECT unnest([NULL, 'real', 'synthetic', 'imported']) AS provenance)),
m AS (SELECT g.engine, g.provenance, r.* EXCLUDE (engine, provenance) FROM groups g LEFT JOIN report r ON g.engine = r.engine AND (g.provenance IS NULL OR g.provenance = r.provenance)),
sums AS (
  SELECT engine, provenance, count(qid) AS questions, count(hit) AS scored, count(*) FILTER (hit) AS hits, coalesce(sum(token_cost), 0)::BIGINT AS token_total, count(qid) FILTER (token_cost IS NULL) AS unmeasured,
    coalesce(sum(leaks), 0)::BIGINT AS leaks, count(*) FILTER (NOT stale_returned) AS stale_excluded, count(*) FILTER (citations_correct) AS citations_correct,
    count(*) FILTER (category = 'no-answer' AND expected = 0) AS silent, count(*) FILTER (category = 'no-answer' AND expected = 0 AND results > 0) AS spoken FROM m GROUP BY ALL
)
SELECT engine, provenance, questions, scored, hits, round_even(hits / nullif(scored, 0), 4) AS hit_rate, token_total, unmeasured, leaks, stale_excluded, round_even(stale_excluded / nullif(questions, 0), 4) AS stale_excluded_rate,
  citations_correct, CASE WHEN silent > 0 THEN spoken = 0 END AS no_answer_correct FROM sums""",
    "gate_from_report": f"""{_SHADOW},
w AS (SELECT qid, any_value(provenance) = 'real' AS real, bool_and(citations_correct) AS cited, sum(leaks) AS leaks, bool_or(hit) FILTER (engine = 'lexical') AS ch, bool_or(hit) FILTER (engine = 'vector') AS bh,
  max(token_cost) FILTER (engine = 'lexical') AS cc, max(token_cost) FILTER (engine = 'vector') AS bc, max(results) FILTER (engine = 'vector') AS bk FROM report GROUP BY qid),
g AS (SELECT count(*) FILTER (cited) AS correct, count(*) AS total, sum(leaks) AS leaks, CASE WHEN count(*) FILTER (bk > 0) > 0 THEN true END AS overlap, round_even(count(*) FILTER (real AND ch) / nullif(count(*) FILTER (real AND ch IS NOT NULL), 0), 4) AS cr,
  round_even(count(*) FILTER (real AND bh) / nullif(count(*) FILTER (real AND bh IS NOT NULL), 0), 4) AS br, count(*) FILTER (real AND bh IS NOT NULL) AS scored, count(*) FILTER (real AND bh) AS hits,
  sum(cc) FILTER (real AND bh) AS ct, sum(bc) FILTER (real AND bh) AS bt, count(*) FILTER (real AND bh AND (cc IS NULL OR bc IS NULL)) AS unmeasured FROM w),
l AS (SELECT quantile_disc(value, 0.95) FILTER (event_type = 'view') AS cp, quantile_disc(value, 0.95) FILTER (event_type = 'click') AS bp FROM events),
d AS (SELECT *, scored > 0 AND hits = 0 AS degenerate FROM g, l)
SELECT unnest(['citation_correctness', 'privacy_false_negative', 'baseline_compared', 'baseline_scope_overlap', 'answerable_hit_rate', 'context_token_total', 'latency_p95', 'stale_exclusion', 'privacy_false_positive'] || CASE WHEN degenerate THEN ['degenerate_baseline'] ELSE [] END) AS item,
  unnest(['absolute', 'absolute', 'precondition', 'precondition', 'relative', 'relative', 'relative', 'relative', 'quality'] || CASE WHEN degenerate THEN ['absolute'] ELSE [] END) AS kind,
  unnest([CASE WHEN correct = total THEN 'pass' ELSE 'fail' END, CASE WHEN leaks = 0 THEN 'pass' ELSE 'fail' END, 'pass', CASE WHEN overlap = false THEN 'fail' ELSE 'pass' END,
    CASE WHEN degenerate OR cr IS NULL OR br IS NULL THEN 'not_evaluable' WHEN cr >= br THEN 'pass' ELSE 'fail' END, CASE WHEN degenerate OR ct IS NULL OR bt IS NULL OR unmeasured > 0 THEN 'not_evaluable' WHEN ct <= bt THEN 'pass' ELSE 'fail' END,
    CASE WHEN degenerate OR bp IS NULL THEN 'not_evaluable' WHEN cp <= 2 * bp THEN 'pass' ELSE 'fail' END, 'not_evaluable', 'recorded'] || CASE WHEN degenerate THEN ['fail'] ELSE [] END) AS status FROM d""",
    # One request of every user a step, in order: operations and keys never leave their user.
    "outbox_crossing": """WITH RECURSIVE r AS (SELECT user_id, event_id, event_id % 3 AS op, (event_id // 3) % 4 AS key, event_type AS actor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT user_id, 0::BIGINT AS n, []::STRUCT(op BIGINT, key BIGINT, actor VARCHAR)[] AS held, 0::BIGINT AS accepted, 0::BIGINT AS duplicates, 0::BIGINT AS conflicts, 0::BIGINT AS ids FROM (SELECT DISTINCT user_id FROM r)
  UNION ALL
  SELECT user_id, s.n + 1, CASE WHEN free THEN list_append(held, me) ELSE held END, accepted + free::BIGINT, duplicates + (NOT free AND same)::BIGINT, conflicts + (NOT free AND NOT same)::BIGINT, ids + CASE WHEN free THEN event_id ELSE 0 END
  FROM (SELECT s.*, r.event_id, struct_pack(op := r.op, key := r.key, actor := r.actor) AS me, list_contains(held, struct_pack(op := r.op, key := r.key, actor := r.actor)) AS same,
    len(list_filter(held, lambda h: h.op = r.op OR h.key = r.key)) = 0 AS free FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1) s
)
SELECT user_id, max(accepted) AS accepted, max(duplicates) AS duplicates, max(conflicts) AS conflicts, max(ids)::BIGINT AS accepted_ids FROM s GROUP BY user_id""",
    "zone_eligibility": """WITH p AS (
  SELECT string_split([ 'Private/_inbox/info-collect/' || page_id, 'Private/Life/health/reports/' || page_id, 'Core/project-' || page_id, 'Core/_inbox/' || page_id, 'Core/' || page_id][page_id % 5 + 1], '/') AS s,
    CASE WHEN page_id % 2 = 0 THEN 'active' END AS status, page_id % 4 = 0 AS candidate, CASE WHEN page_id % 3 = 0 THEN 'lib' END AS library FROM pages
)
SELECT array_to_string(list_filter([
  CASE WHEN len(s) = 4 AND s[1] = 'Private' AND s[2] = '_inbox' AND s[3] = 'info-collect' THEN 'knowledge_feed' END, CASE WHEN len(s) = 5 AND s[1] = 'Private' AND s[2] = 'Life' AND s[4] = 'reports' THEN 'life_domains' END,
  CASE WHEN len(s) = 2 AND s[1] = 'Core' AND starts_with(s[2], 'project-') AND status = 'active' THEN 'projects' END, CASE WHEN len(s) >= 3 AND s[1] = 'Core' AND s[2] = '_inbox' AND candidate THEN 'development_candidates' END,
  CASE WHEN library <> '' THEN 'topics' END], lambda v: v IS NOT NULL), ',') AS zones, count(*) AS n FROM p GROUP BY 1""",
    "pilot_zones": """WITH p AS (
  SELECT string_split(CASE WHEN toxic = 1 THEN 'Core/_inbox/' || doc_id || '.md' ELSE 'Core/project-' || doc_id || '.md' END, '/') AS s, lang = 'en' AS active, coalesce(toxic = 1, false) AS candidate, coalesce(n_chars % 2 = 0, false) AND source <> '' AS library
  FROM documents LEFT JOIN labels USING (doc_id)
)
SELECT array_to_string(list_filter([CASE WHEN len(s) = 2 AND s[1] = 'Core' AND starts_with(s[2], 'project-') AND active THEN 'projects' END, CASE WHEN len(s) >= 3 AND s[1] = 'Core' AND s[2] = '_inbox' AND candidate THEN 'development_candidates' END,
  CASE WHEN library THEN 'topics' END], lambda v: v IS NOT NULL), ',') AS zones, 'current' AS fresh, count(*) AS n FROM p GROUP BY 1""",
    "plain_paths": """WITH RECURSIVE r AS (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '' ELSE '/' END AS root, string_split(regexp_replace(url, '^[a-z]+://', '') || CASE WHEN page_id % 3 = 0 THEN '/../x//./y' WHEN page_id % 5 = 0 THEN '/../../../../z' ELSE '/' END, '/') AS todo FROM pages
), f AS (
  SELECT page_id, root, todo, []::VARCHAR[] AS done FROM r
  UNION ALL
  SELECT page_id, root, todo[2:], CASE WHEN todo[1] IN ('', '.') THEN done WHEN todo[1] <> '..' THEN list_append(done, todo[1]) WHEN len(done) > 0 AND done[-1] <> '..' THEN done[:-2] WHEN root <> '' THEN done ELSE list_append(done, '..') END FROM f WHERE len(todo) > 0
)
SELECT page_id, CASE WHEN root || array_to_string(done, '/') = '' THEN '.' ELSE root || array_to_string(done, '/') END AS plain FROM f WHERE len(todo) = 0""",
    "grant_validation": f"""WITH g AS (
  SELECT o_orderkey % 6 AS d, CASE o_orderstatus WHEN 'P' THEN ['report-generation'] WHEN 'F' THEN ['read', 'report-generation'] ELSE ['read'] END AS caps, ['public', 'internal', 'sensitive', 'student-private'][(o_orderkey // 4) % 4 + 1] AS class,
    starts_with(o_orderpriority, '5') AS stranger, o_orderkey % 23 AS items, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), m AS (SELECT *, {_DOMAINS}[d + 1] AS domain, CASE WHEN c_nationkey IS NOT NULL AND d <= c_nationkey % 6 THEN CASE WHEN c_nationkey % 2 = 0 THEN ['read', 'report-generation'] ELSE ['read'] END ELSE [] END AS granted FROM g)
SELECT CASE WHEN items NOT BETWEEN 1 AND 20 THEN 'grant-malformed' WHEN stranger THEN 'owner-trust-required' WHEN list_contains(caps, 'report-generation') AND NOT list_contains(caps, 'read') THEN 'report-requires-read'
  WHEN class = 'student-private' THEN 'student-private-scope-denied' WHEN len(list_filter(caps, lambda c: NOT list_contains(granted, c))) > 0 THEN 'agent-domain-capability-denied'
  WHEN domain = 'core-engineering' AND class = 'sensitive' THEN 'sensitive-core-routing-denied' END AS refusal, count(*) AS n FROM m GROUP BY 1""",
    "domain_entries": f"""WITH {GATED} SELECT metadata, count(*) AS n, min(doc_id) AS first FROM gated WHERE privacy = 'public' AND {_DOMAINS}[doc_id % 6 + 1] = 'finance' GROUP BY metadata""",
    "writer_actors": r"""WITH a AS (
  SELECT user_id, CASE WHEN event_type <> 'error' THEN user_id END AS credential, user_id % 7 <> 0 AS known, user_id % 5 = 0 AS person, user_id % 3 <> 0 AS gen, user_id % 2 = 0 AS cap, CASE WHEN event_id % 31 = 0 THEN '' ELSE 't1' END AS task,
    CASE event_type WHEN 'click' THEN 'captured' WHEN 'signup' THEN 'other' ELSE 'generated' END AS mode, CASE WHEN value > 50 THEN 'model-1' WHEN value > 45 THEN 'unknown' END AS model FROM events
), r AS (SELECT *, CASE WHEN credential IS NULL OR task = '' THEN 'identity-missing' WHEN NOT known THEN 'actor-denied' WHEN mode = 'other' THEN 'identity-missing' WHEN mode = 'generated' AND NOT gen OR mode = 'captured' AND NOT cap THEN 'actor-denied'
    WHEN (mode = 'captured' OR person) AND model IS NOT NULL THEN 'actor-denied' WHEN mode = 'generated' AND NOT person AND (model IS NULL OR model = 'unknown') THEN 'model-identity-missing' END AS refusal FROM a)
SELECT refusal, CASE WHEN refusal IS NULL THEN mode = 'generated' AND NOT person END AS with_model, count(*) AS n FROM r GROUP BY ALL""",
    "create_targets": r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages), h AS (SELECT host, min(page_id) AS low FROM p GROUP BY host),
k AS (SELECT host, CASE WHEN low % 7 = 0 THEN NULL WHEN low % 5 = 0 THEN 'link' WHEN low % 3 = 0 THEN 'file' ELSE 'folder' END AS kind FROM h)
SELECT CASE WHEN kind IS NULL THEN 'target-denied' WHEN kind = 'link' THEN 'symlink-denied' WHEN kind = 'file' OR page_id % 4 = 0 THEN 'path-conflict' END AS refusal, count(*) AS n FROM p JOIN k USING (host) GROUP BY 1""",
    "index_differences": "SELECT vec_id::VARCHAR AS point_id FROM embeddings WHERE vec_id % 10 IN (3, 4, 5)",
    "dedup_first_seen": """WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS first_seen FROM f GROUP BY user_id""",
    "outbox_enqueue": """WITH r AS (SELECT event_id, event_type, event_id % 997 AS op, user_id % 2 AS actor, row_number() OVER w AS n, first_value(user_id % 2) OVER w AS first_actor FROM events WINDOW w AS (PARTITION BY event_id % 997 ORDER BY ts, event_id))
SELECT CASE WHEN n = 1 THEN 'accepted' WHEN actor = first_actor THEN 'duplicate' ELSE 'conflict' END AS outcome, event_type, count(*) AS n, min(event_id) AS first FROM r GROUP BY 1, 2""",
    # The commits that each named commit reaches, followed parent by parent.
    "history_freshness": """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
p AS (SELECT event_id, before AS parent FROM e WHERE before IS NOT NULL UNION SELECT event_id, event_id - 7 FROM e WHERE event_type = 'signup' AND event_id % 3 = 0 AND event_id >= 7),
u AS (SELECT user_id, max(event_id) FILTER (event_type = 'view') AS x, max(event_id) FILTER (event_type = 'click') AS t FROM e GROUP BY user_id),
n AS (SELECT user_id || '-own' AS path, x, t FROM u UNION ALL SELECT u.user_id || '-next', b.x, u.t FROM u JOIN u b ON b.user_id + 1 = u.user_id),
r AS (SELECT x AS source, x AS node FROM n WHERE x IS NOT NULL UNION SELECT t, t FROM n WHERE t IS NOT NULL UNION SELECT source, parent FROM r JOIN p ON p.event_id = r.node)
SELECT path, CASE WHEN x IS NULL OR t IS NULL THEN 'unknown' WHEN x = t THEN 'current' WHEN EXISTS (SELECT 1 FROM r WHERE source = t AND node = x) THEN 'stale' WHEN EXISTS (SELECT 1 FROM r WHERE source = x AND node = t) THEN 'current' ELSE 'unknown' END AS verdict FROM n""",
    "request_hashes": """SELECT doc_id, 'sha256:' || sha256('{"body":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"frontmatter":{"lang":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"source":' || coalesce(to_json(source)::VARCHAR, 'null')
  || '},"operation_id":"op' || doc_id || '","provenance_mode":"generated","target_path":"Core/_inbox/' || doc_id || '.md"}') AS request_hash FROM documents""",
    "json_faults": """SELECT event_type, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'not-json' WHEN 2 THEN 'not-finite' WHEN 3 THEN CASE WHEN event_id % 5 + 2 > 4 THEN 'too-deep' END WHEN 4 THEN 'not-json' WHEN 5 THEN NULL WHEN 6 THEN 'not-json' END AS fault,
  count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE json_valid(props) GROUP BY ALL""",
    "spelling_refusals": rf"""{_MEMBERS} SELECT refused, count(*) AS spellings, count(DISTINCT path) AS members FROM s GROUP BY refused""",
    "spelled_hits": rf"""{_MEMBERS}, h AS (SELECT page_id, string_split(path, '/')[2] AS query, CASE page_id % 4 WHEN 0 THEN path WHEN 1 THEN shown WHEN 2 THEN path ELSE 'other://none' END AS spelling FROM v)
SELECT query, path, min(page_id) AS rank FROM h JOIN s USING (spelling) WHERE NOT refused GROUP BY query, path""",
    "receipt_faults": """WITH e AS (SELECT event_type, event_id % 11 AS mode, ts::DATE AS day FROM events),
f AS (SELECT *, [NULL, 'path', 'status', 'keys', 'mode', 'line', 'key', 'repeated', 'contract', 'id', NULL][mode + 1] AS fault FROM e)
SELECT event_type, fault, CASE WHEN mode = 10 THEN '3' END AS contract, count(*) AS n, count(DISTINCT CASE WHEN fault IS NULL THEN day END) AS paths FROM f GROUP BY ALL""",
    "index_recovery": """WITH r AS (SELECT sha256(o_orderkey::VARCHAR) AS name, o_custkey || '-' || left(o_orderpriority, 1) AS key FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT o_custkey || '-' || left(o_orderpriority, 1) AS key, max(o_orderkey) AS k FROM orders GROUP BY 1),
i AS (SELECT key, CASE WHEN k % 5 = 0 THEN left(sha256(k::VARCHAR), 40) ELSE sha256(k::VARCHAR) END AS name FROM f WHERE k % 7 <> 0),
e AS (SELECT *, CASE WHEN length(name) <> 64 THEN 'torn' WHEN name NOT IN (SELECT name FROM r) THEN 'lost' ELSE 'kept' END AS action FROM i),
a AS (SELECT * FROM e UNION ALL SELECT key, min(name), 'rebuilt' FROM r WHERE key NOT IN (SELECT key FROM e WHERE action = 'kept') GROUP BY key)
SELECT action, count(*) AS n, min(key) AS first, max(name) AS last FROM a GROUP BY action""",
    "record_order": "SELECT o_orderkey, row_number() OVER (ORDER BY sha256(o_orderkey::VARCHAR)) AS place FROM orders WHERE o_orderkey % 9 <> 0",
    "outbox_replay": """WITH r AS (SELECT event_type, ts, (event_id % 7)::INTEGER AS attempts, CASE event_type WHEN 'click' THEN 'leased' WHEN 'signup' THEN 'committed' ELSE 'queued' END AS state,
  CASE event_type WHEN 'purchase' THEN 'base-moved' WHEN 'error' THEN 'path-conflict' WHEN 'click' THEN 'leader-unavailable' END AS code FROM events),
s AS (SELECT *, CASE WHEN state = 'committed' OR state = 'leased' AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-11' THEN 'skip' WHEN TIMESTAMP '2024-01-11' >= ts + INTERVAL 7 DAYS THEN 'expire' ELSE 'replay' END AS step FROM r),
k AS (SELECT *, CASE WHEN code IS NULL THEN 'commit' WHEN code = 'base-moved' THEN CASE WHEN attempts >= 5 THEN 'quarantine' ELSE 'retry-transient' END WHEN code = 'leader-unavailable' THEN 'retry-free' WHEN code = 'path-conflict' THEN 'conflict' ELSE 'quarantine' END AS kind FROM s)
SELECT event_type, step, CASE WHEN step = 'skip' THEN state WHEN step = 'expire' THEN 'expired' WHEN kind = 'commit' THEN 'committed' WHEN kind IN ('retry-transient', 'retry-free') THEN 'queued' WHEN kind = 'conflict' THEN 'conflict' ELSE 'quarantined' END AS new_state,
  CASE WHEN step = 'expire' THEN 'record-expired' WHEN step = 'replay' THEN code END AS new_code, count(*) AS n, sum(attempts + CASE WHEN step = 'replay' AND kind = 'retry-transient' THEN 1 ELSE 0 END)::BIGINT AS attempts FROM k GROUP BY 1, 2, 3, 4""",
    "metadata_conversion": """WITH e AS (SELECT event_id AS k, event_id % 19 = 0 AS created, event_id % 13 = 0 OR event_id % 17 <> 0 AS stamped, event_id % 13 <> 0 AND event_id % 6 IN (0, 2, 4, 5) AS aware, event_id % 3 = 0 AS c1, event_id % 5 = 0 AS c2, event_id % 7 = 0 AS src, event_id % 4 = 0 AS gen FROM events),
g AS (SELECT *, NOT created AND stamped AND aware AS good, c1 OR c2 AND k % 2 = 0 AS usable FROM e)
SELECT CASE WHEN c1 AND c2 AND k % 2 = 1 THEN 'conflicting-citations' END AS error,
  array_to_string(list_filter([CASE WHEN stamped AND NOT created AND NOT good THEN 'created_at' END, CASE WHEN NOT gen THEN 'generated' END], lambda v: v IS NOT NULL), ',') AS gaps,
  array_to_string(list_filter([CASE WHEN c1 AND c2 THEN 'Citations' END, CASE WHEN (c1 OR c2) AND (src OR NOT usable) THEN CASE WHEN c1 THEN 'citations' ELSE 'Citations' END END, CASE WHEN stamped AND NOT good THEN 'timestamp' END], lambda v: v IS NOT NULL), ',') AS dropped,
  count(*) AS n, count(*) FILTER (created OR good) AS with_created_at, count(*) FILTER (src OR usable) AS with_sources, count(*)::BIGINT AS unmapped FROM g GROUP BY 1, 2, 3""",
    "write_targets": r"""WITH p AS (
  SELECT page_id % 6 AS shape, ['Core/_inbox/p' || page_id || '.md', 'Private/_inbox/p' || page_id || '.md', '/Core/_inbox/p' || page_id || '.md', 'Core/_inbox/../p' || page_id || '.md', 'Core/_inbox/a/p' || page_id || '.md', 'Core/_inbox/p' || page_id][page_id % 6 + 1] AS path,
    ['public', 'internal', 'sensitive', 'student-private'][page_id % 4 + 1] AS class FROM pages
), z AS (SELECT *, CASE WHEN starts_with(path, 'Core/_inbox/') THEN 'Core/_inbox/' WHEN starts_with(path, 'Private/_inbox/') THEN 'Private/_inbox/' END AS zone FROM p)
SELECT CASE WHEN zone IS NULL OR length(path) > 240 OR NOT ends_with(path, '.md') OR NOT regexp_full_match(substr(path, length(zone) + 1), '[a-z0-9][a-z0-9._-]*\.md') OR len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) > 0 THEN 'target-denied'
  WHEN class = 'student-private' THEN 'student-private-denied' WHEN NOT (zone = 'Core/_inbox/' AND class IN ('public', 'internal') OR zone = 'Private/_inbox/' AND class = 'sensitive') THEN 'cross-zone-denied' END AS refusal, shape, count(*) AS n FROM z GROUP BY ALL""",
    "payload_markers": """SELECT CASE WHEN contains(text, 'BEGIN PRIVATE KEY') THEN 'BEGIN PRIVATE KEY' WHEN contains(text, 'AKIA') THEN 'AKIA' WHEN contains(text, 'password') THEN 'password' WHEN contains(text, 'secret') THEN 'secret' END AS marker, count(*) AS n FROM documents GROUP BY 1""",
    "revision_changes": """WITH w AS (SELECT role, turn, lag(turn) OVER o AS t0, lag(text) OVER o AS x0, text FROM conversations WINDOW o AS (PARTITION BY conv_id, role ORDER BY turn))
SELECT role, CASE WHEN t0 IS NULL THEN false WHEN x0 IS NULL OR text IS NULL THEN NULL ELSE x0 <> text END AS changed, count(*) AS n FROM w GROUP BY ALL""",
    "gate_items": f"{_GATE} SELECT unnest(items) AS item, unnest(kinds) AS kind, unnest(statuses) AS status FROM judged",
    "gate_verdict": f"{_GATE} SELECT CASE WHEN list_contains(statuses, 'fail') THEN 'fail' ELSE 'pass' END AS verdict FROM judged",
}
