"""The registered queries of the engine's own operators, each with its DuckDB equivalent.

Lexical queries run in the ``lower`` mode that both engines share; ``*_folded`` queries
run in the exact mode (compatibility composition and case folding).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.digest import framed_sha256, tree_revision
from ..functions import receipt, values
from ..functions.text import byte_length, compact, snippet, snippet_lower, strip_frontmatter, word_count
from ..operators import access, catalog, context, convert, evaluate, history, lexical, outbox, privacy, shadow, spelling, vector, writer
from ..sources.tables import scratch, stored
from .tables import classified, dealt, domain_of, table

#: The stated lexical requests.
REQUESTS = (("q1", "apache license version"), ("q2", "pathetic moron"), ("q3", "released under the MIT license"), ("q4", "keit schach der"), ("q5", "idiot"))
DIMENSION = 64
REVISION_DOMAIN = "sextant-index-v1"
GATED = """
gated AS (
  SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title, d.source AS description, d.lang AS metadata, d.text AS body, l.toxic,
    CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'public' WHEN l.quality = 0 AND l.toxic = 0 THEN 'internal'
      WHEN l.quality = 1 AND l.toxic = 1 THEN 'sensitive' WHEN l.quality = 0 AND l.toxic = 1 THEN 'student-private' END AS privacy
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def _values(requests) -> str:
    return ", ".join(f"('{q}', [{', '.join(repr(t) for t in dict.fromkeys(text.lower().split()))}])" for q, text in requests)


#: The scorer in SQL over a relation ``f`` (doc_id and the four fields, lower-case).
def scorer(requests=REQUESTS) -> str:
    return f"""
q AS (SELECT * FROM (VALUES {_values(requests)}) t(qid, tokens)),
a AS (SELECT coalesce(avg(length(title)), 0) AS a1, coalesce(avg(length(description)), 0) AS a2, coalesce(avg(length(metadata)), 0) AS a3, coalesce(avg(length(body)), 0) AS a4 FROM f),
t AS (
  SELECT qid, len(tokens) AS n, doc_id,
    CASE WHEN length(title) > 0 THEN 4.0 * ((length(title) - length(replace(title, token, ''))) / length(token)) * a1 / length(title) ELSE 0 END
    + CASE WHEN length(description) > 0 THEN 2.0 * ((length(description) - length(replace(description, token, ''))) / length(token)) * a2 / length(description) ELSE 0 END
    + CASE WHEN length(metadata) > 0 THEN 2.0 * ((length(metadata) - length(replace(metadata, token, ''))) / length(token)) * a3 / length(metadata) ELSE 0 END
    + CASE WHEN length(body) > 0 THEN 1.0 * ((length(body) - length(replace(body, token, ''))) / length(token)) * a4 / length(body) ELSE 0 END AS tf
  FROM f, a, (SELECT qid, tokens, unnest(tokens) AS token FROM q)
),
s AS (
  SELECT qid, doc_id, sum(tf * 4.0 / (tf + 3.0)) AS score, count(*) FILTER (tf > 0)::INTEGER AS coverage, max(n) AS n FROM t GROUP BY qid, doc_id
),
scored AS (SELECT * FROM s WHERE score > 0 AND coverage >= least(2, n)),
top AS (SELECT qid, count(*) AS c, max(score) AS m FROM scored GROUP BY qid),
kept AS (
  SELECT s.*, count(*) OVER (PARTITION BY qid) AS total FROM scored s JOIN top USING (qid)
  WHERE CASE WHEN c <= 2 THEN 3 * score >= m ELSE 4 * score >= 3 * m END
)"""


SCORER = scorer()
PUBLIC_FIELDS = GATED + ", f AS (SELECT doc_id, lower(title) AS title, lower(description) AS description, lower(metadata) AS metadata, lower(body) AS body FROM gated WHERE privacy = 'public')"


def _public(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.admitted(classified(spark, sf))


def _fields(spark: SparkSession, sf: str, exact: bool = False) -> DataFrame:
    rows = _public(spark, sf)
    return lexical.fields(rows, "doc_id", tuple(F.col(c) for c in ("title", "description", "metadata", "body")), exact)


def gate_partition(spark, sf):
    return privacy.partition_counts(classified(spark, sf))


def strictness_histogram(spark, sf):
    rows = classified(spark, sf).where("privacy is not null")
    return rows.groupBy("privacy").agg(F.count("*").alias("n"), F.max(privacy.strictness(F.col("privacy"))).cast("int").alias("strictness"), F.count_if(privacy.is_at_least(F.col("privacy"), "sensitive")).alias("at_least_sensitive"))


def note_classification(spark, sf):
    """Documents written as notes, in the shapes that occur, and their declared class."""
    docs = table(spark, sf, "documents")
    declared = F.element_at(F.array(*map(F.lit, ("privacy: public", "privacy:  'internal' ", "privacy:public", "privacy: Public", "tags: x", "privacy: sensitive\nprivacy: public"))), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    text = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.col("text")).when(F.pmod("doc_id", F.lit(11)) == 0, F.concat(F.lit("---\nprivacy: public\n"), F.regexp_replace("text", "(?m)^---$", "")))
    text = F.coalesce(text, F.concat(F.lit("---\r\n"), declared, F.lit("\n---\n"), F.col("text")))
    verdict = privacy.declared(text)
    return docs.select(verdict.alias("v")).groupBy(F.col("v.privacy").alias("privacy"), F.col("v.reason").alias("reason")).agg(F.count("*").alias("n"))


def catalog_page(spark, sf):
    rows = _public(spark, sf).select("doc_id", "title", F.col("metadata").alias("type"))
    return catalog.page(rows, limit=10, offset=5, type_="en", key="doc_id")


def catalog_facets(spark, sf):
    rows = _public(spark, sf)
    return catalog.facet(rows, "metadata").withColumn("facet", F.lit("type")).unionByName(catalog.facet(rows, "description").withColumn("facet", F.lit("source")))


def corpus_field_averages(spark, sf):
    return lexical.averages(_fields(spark, sf)).select(*(F.round(f, 6).alias(f) for f in lexical.FIELDS))


def lexical_scores(spark, sf):
    return lexical.scores(_fields(spark, sf), "doc_id", REQUESTS, exact=False).withColumn("score", F.round("score", 6))


def lexical_topk(spark, sf):
    return lexical.search(_fields(spark, sf), "doc_id", REQUESTS, 10, exact=False).withColumn("score", F.round("score", 6))


def lexical_totals(spark, sf):
    return lexical.cutoff(lexical.scores(_fields(spark, sf), "doc_id", REQUESTS, exact=False)).groupBy("qid").agg(F.max("total").alias("total"), F.round(F.max("score"), 6).alias("top"))


def lexical_topk_folded(spark, sf):
    return lexical.search(_fields(spark, sf, True), "doc_id", REQUESTS, 10).withColumn("score", F.round("score", 6))


def _hits(spark, sf):
    tokens = F.create_map(*(x for q, text in REQUESTS for x in (F.lit(q), F.array(*map(F.lit, dict.fromkeys(text.lower().split()))))))
    ranked = lexical.search(_fields(spark, sf), "doc_id", REQUESTS, 10, exact=False)
    return ranked.join(_public(spark, sf).select("doc_id", "title", "body"), "doc_id").withColumn("tokens", tokens[F.col("qid")])


def snippet_window(spark, sf):
    return _hits(spark, sf).select("qid", "rank", "doc_id", snippet_lower(F.col("body"), F.col("tokens")).alias("snippet"))


def snippet_window_folded(spark, sf):
    return _hits(spark, sf).select("qid", "rank", "doc_id", snippet("body", "tokens").alias("snippet"))


def context_pack(spark, sf):
    rows = _hits(spark, sf).select("qid", "rank", F.col("doc_id").cast("string").alias("concept_id"), "title", snippet("body", "tokens").alias("snippet"), F.concat("doc_id", F.lit(".md")).alias("path"), F.lit("r1").alias("index_revision"), F.lit("0123abc").alias("bundle_commit"), "total")
    return context.pack(rows, 10, 2_048).select("qid", F.size("items").alias("n_items"), F.sha2("context", 256).alias("context_sha256"), "used", "truncated")


def bundle_revision(spark, sf):
    docs = table(spark, sf, "documents").select(F.format_string("%012d", "doc_id").alias("key"), F.sha2("text", 256).alias("content_sha256"))
    return tree_revision(docs, REVISION_DOMAIN).select("revision")


def source_revisions(spark, sf):
    """One revision per source of the catalog."""
    docs = table(spark, sf, "documents").select("source", F.format_string("%012d", "doc_id").alias("key"), F.sha2("text", 256).alias("content_sha256"))
    return tree_revision(docs, REVISION_DOMAIN, by=("source",)).select("source", "n", "revision")


def framed_digests(spark, sf):
    return table(spark, sf, "pages").select("page_id", framed_sha256(F.lit("page-v1"), F.col("url"), F.col("html")).alias("digest"))


def token_cost(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", word_count(strip_frontmatter(F.col("text"))).cast("long").alias("tokens"))
    ranked = lexical.search(_fields(spark, sf), "doc_id", REQUESTS, 10, exact=False)
    return evaluate.token_cost(ranked.select("qid", "doc_id"), docs, "qid", "doc_id")


def text_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", byte_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"), word_count(F.col("text")).cast("long").alias("words"), F.sha2(compact(F.col("text")), 256).alias("compact_sha256"))


def hash_embedding_buckets(spark, sf):
    rows = dealt(spark, sf, "documents")
    return vector.bucket_counts(rows, "doc_id", "text", DIMENSION, exact=False)


def hash_embedding_rows(spark, sf):
    rows = vector.embed_rows(dealt(spark, sf, "documents"), "doc_id", "text", DIMENSION, exact=False)
    return rows.select("doc_id", F.round(F.array_max("vector"), 9).alias("largest"), F.size(F.filter("vector", lambda x: x > 0)).alias("used"))


def vector_topk(spark, sf):
    points = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = points.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vector.search(points, "vec_id", "embedding", asked, "query_id", "q", 10).withColumn("score", F.round("score", 9))


def rerank_topk(spark, sf):
    """The 50 nearest of each query, except itself, reranked by cosine among those with its label."""
    points = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    asked = points.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("asked_label"))
    near = vector.search(points, "vec_id", "embedding", asked, "query_id", "q", 50).where("vec_id <> query_id").select("query_id", "vec_id")
    found = near.join(points, "vec_id").join(asked, "query_id").where("label = asked_label")
    return vector.rerank(found, "query_id", "vec_id", "embedding", "q", 5, cosine=True).withColumn("score", F.round("score", 9))


def domain_scope(spark, sf):
    rows = _public(spark, sf).withColumn("domain", domain_of(F.col("doc_id")))
    return rows.groupBy("domain", F.col("metadata").alias("type")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def grant_resolution(spark, sf):
    """Events ask with the grant that their number names; an order is a grant of its customer for a year of 2024 on."""
    grants = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.pmod("o_custkey", F.lit(7)).alias("actor"), (F.col("o_orderdate") + F.expr("INTERVAL 24 YEARS")).alias("issued"), F.col("o_orderstatus").alias("st"), F.lit(True).alias("granted"))
    rows = table(spark, sf, "events").join(grants, "event_id", "left").withColumn("actor2", F.pmod("user_id", F.lit(7)))
    domains = F.when(F.col("st") == "F", F.array(*map(F.lit, access.DOMAINS))).otherwise(F.array(*map(F.lit, access.DOMAINS[:3])))
    capabilities = F.when(F.col("st") == "P", F.array(F.lit("read"), F.lit("report-generation"))).otherwise(F.array(F.lit("read")))
    required = F.when(F.col("event_type") == "view", F.array(F.lit("read"), F.lit("report-generation"))).otherwise(F.array(F.lit("read")))
    denial = access.decide(rows, F.col("ts"), F.col("actor2"), F.col("actor"), F.col("granted"), F.col("issued") - F.expr("INTERVAL 3 YEARS"), F.col("issued") + F.expr("INTERVAL 4 YEARS"), domain_of(F.col("event_id")), domains, required, capabilities)
    return rows.groupBy(denial.alias("denial"), "event_type").agg(F.count("*").alias("n"))


def hit_rate_grouping_sets(spark, sf):
    """A toxic document is a question; it is hit if the lexical requests q2 or q5 return it from the ungated entries."""
    rows = classified(spark, sf).where("privacy is not null")
    served = lexical.fields(rows, "doc_id", tuple(F.col(c) for c in ("title", "description", "metadata", "body")), False)
    found = lexical.cutoff(lexical.scores(served, "doc_id", [r for r in REQUESTS if r[0] in ("q2", "q5")], exact=False)).groupBy("doc_id").agg(F.array("doc_id").alias("found"))
    expected = F.when(F.col("toxic") == 1, F.array("doc_id")).otherwise(F.array().cast("array<bigint>"))
    asked = rows.join(found, "doc_id", "left").withColumn("hit", evaluate.hit(expected, F.coalesce("found", F.array().cast("array<bigint>"))))
    return evaluate.hit_rates(asked.select("metadata", "hit"), "metadata")


def latency_percentiles(spark, sf):
    return evaluate.latency(table(spark, sf, "events"), "value", "event_type")


def leak_and_false_positive(spark, sf):
    """Requests served without the gate leak; public documents that the index (even ids' texts) lacks are false positives."""
    every = classified(spark, sf)
    served = lexical.scores(lexical.fields(every, "doc_id", tuple(F.col(c) for c in ("title", "description", "metadata", "body")), False), "doc_id", REQUESTS, exact=False)
    public = privacy.admitted(every)
    leaked = evaluate.leaks(served.select("qid", "doc_id"), public, "doc_id").groupBy(F.col("qid").alias("what")).agg(F.count("*").alias("n"))
    indexed = every.where("metadata <> 'fr'")
    return leaked.unionByName(evaluate.false_positives(public, indexed, "doc_id").agg(F.lit("false_positives").alias("what"), F.count("*").alias("n")))


def stale_exclusion(spark, sf):
    """An exact copy of a document with a smaller id is superseded."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    rows = docs.join(first, "h")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") != F.col("first")).alias("superseded"), evaluate.rate(F.count_if(F.col("doc_id") == F.col("first")), F.count("*")).alias("current_rate"))


def _summary(spark, sf):
    """Events as the counts of an evaluation: signups are the baseline's questions, purchases the candidate's."""
    events = table(spark, sf, "events")
    share = lambda kind: evaluate.rate(F.count_if((F.col("event_type") == kind) & (F.col("value") > 20)), F.count_if(F.col("event_type") == kind))
    late = lambda kind: evaluate.nearest_rank(f"CASE WHEN event_type = '{kind}' THEN value END", 0.95)
    return events.agg(
        F.count_if(F.col("event_type") != "error").alias("citation_correct"), F.count("*").alias("total_questions"), F.count_if((F.col("event_type") == "error") & (F.col("value") < 0)).alias("false_negatives"),
        (F.count_if(F.col("event_type") == "signup") > 0).alias("compared"), (F.count_if((F.col("event_type") == "signup") & (F.col("value") > 20)) > 0).alias("scope_overlap"),
        share("purchase").alias("lexical_rate"), share("signup").alias("baseline_rate"), F.count_if(F.col("event_type") == "signup").alias("baseline_scored"), F.count_if((F.col("event_type") == "signup") & (F.col("value") > 20)).alias("baseline_hits"),
        F.count_if(F.col("value") > 50).alias("lexical_tokens"), F.count_if(F.col("value") > 40).alias("baseline_tokens"), F.count_if(F.col("value").isNull()).alias("tokens_unmeasured"), late("purchase").alias("lexical_p95"), late("signup").alias("baseline_p95"),
    )


def gate_items(spark, sf):
    return evaluate.gate(_summary(spark, sf))


def gate_verdict(spark, sf):
    return evaluate.verdict(gate_items(spark, sf))


#: Questions of the shadow evaluation: provenance, and words of which the smallest public document that holds both is expected.
QUESTIONS = (
    ("q1", "apache license version", "real", ("apache", "license")), ("q2", "pathetic moron", "synthetic", ("pathetic", "moron")), ("q3", "released under the MIT license", "real", ("released", "mit")),
    ("q4", "keit schach der", "real", ("keit", "schach")), ("n1", "zyzzyva quagga", "synthetic", ("zyzzyva", "quagga")),
)
ENGINES = ("lexical", "vector")


def _shadow(spark, sf):
    """The report of both engines over the public documents: the same index, questions and tokens for both."""
    public = stored(_public(spark, sf).select("doc_id", "title", "description", "metadata", "body"))
    path = F.concat(F.col("doc_id"), F.lit(".md"))
    low = F.lower("body")
    least = public.agg(*(F.min(F.when(F.contains(low, F.lit(a)) & F.contains(low, F.lit(b)), F.col("doc_id"))).alias(q) for q, _, _, (a, b) in QUESTIONS))
    least = stored(least)
    row = lambda q, p: F.struct(F.lit(q).alias("qid"), F.lit(p).alias("provenance"), F.when(F.col(q).isNull(), shadow.NO_ANSWER).otherwise("lookup").alias("category"), F.when(F.col(q).isNotNull(), F.array(F.concat(F.col(q), F.lit(".md")))).otherwise(F.array().cast("array<string>")).alias("expected"))
    questions = least.select(F.inline(F.array(*(row(q, p) for q, _, p, _ in QUESTIONS))))
    requests = [(q, text) for q, text, _, _ in QUESTIONS]
    fields = lexical.fields(public, "doc_id", tuple(F.col(c) for c in ("title", "description", "metadata", "body")), False)
    lex = lexical.search(fields, "doc_id", requests, 10, exact=False).select("qid", F.lit("lexical").alias("engine"), "doc_id")
    asked = least.select(F.inline(F.array(*(F.struct(F.lit(q).alias("qid"), F.lit(text).alias("text")) for q, text in requests))))
    asked = asked.select("qid", vector.embed(F.col("text"), DIMENSION).alias("q"))
    vec = vector.search(vector.embed_rows(public, "doc_id", "body", DIMENSION, exact=False), "doc_id", "vector", asked, "qid", "q", 10, True).select("qid", F.lit("vector").alias("engine"), "doc_id")
    returned = lex.unionByName(vec).select("qid", "engine", F.col("doc_id").cast("string").alias("concept"), path.alias("path"), F.lit("r1").alias("revision"), F.lit("r1").alias("searched"))
    returned = returned.withColumn("cited", shadow.cited("concept", "path", "revision", "searched"))
    # What is measured of every document, by one scan.
    docs = stored(dealt(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), word_count(strip_frontmatter(F.col("text"))).cast("long").alias("tokens")))
    old = docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("first")), "h").where("doc_id <> first")
    tokens = docs.select(path.alias("path"), "tokens")
    return shadow.report(questions, returned, ENGINES, public.select(path.alias("path")), tokens, old.select(path.alias("path")))


def _stored_shadow(spark, sf):
    with scratch(spark):
        return stored(_shadow(spark, sf), keep=True)


def shadow_report(spark, sf):
    return _stored_shadow(spark, sf)


def shadow_summary(spark, sf):
    return shadow.summary(_stored_shadow(spark, sf), ("real", "synthetic", "imported"))


def gate_from_report(spark, sf):
    """The shadow report before the gate; latencies are the values of view and click events."""
    late = table(spark, sf, "events").where("event_type IN ('view', 'click')").select(F.when(F.col("event_type") == "view", "lexical").otherwise("vector").alias("engine"), "value")
    return evaluate.gate(shadow.gate_summary(_stored_shadow(spark, sf), "lexical", "vector", "real", late))


def export_diff(spark, sf):
    """Orders are the catalog; line items that name them are the export, some under other spellings."""
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    cat = orders.select(
        F.concat(F.lit("Core/"), F.col("o_orderkey")).alias("path"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("candidate_status"),
        F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("topics"))).alias("eligible"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "stale").otherwise("current").alias("fresh"),
    )
    shown = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderstatus"), "l_orderkey").select(
        F.when(F.col("l_linenumber") == 1, "projects").otherwise("topics").alias("zone"), F.col("l_linenumber").alias("zone_no"),
        F.concat(F.when(F.col("l_returnflag") == "R", "./Core/").otherwise("Core/"), F.col("l_orderkey")).alias("path"),
        F.when(F.col("l_returnflag") == "A", F.lit("old")).otherwise(F.col("o_orderpriority")).alias("title"), F.when(F.col("l_quantity") > 45, F.lit("")).otherwise(F.col("o_orderstatus")).alias("status"),
    )
    return evaluate.diff_counts(evaluate.export_diff(cat, shown))


def _notes(spark, sf):
    """path, text: documents as notes, whose frontmatter states what their row and labels say."""
    rows = dealt(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    library = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("\nlibrary_id: '"), "source", F.lit("'"))).otherwise(F.lit(""))
    candidate = F.when(F.col("toxic") == 1, F.lit("\ndevelopment_candidate: True")).otherwise(F.lit(""))
    front = F.concat(F.lit("---\nprivacy: "), F.when(F.col("quality") == 1, "public").otherwise("internal"), F.lit("\nstatus: "), F.when(F.col("lang") == "en", "active").otherwise("done"), library, candidate, F.lit("\n---\n"))
    path = F.when(F.col("toxic") == 1, F.concat(F.lit("Core/_inbox/"), "doc_id", F.lit(".md"))).otherwise(F.concat(F.lit("Core/project-"), "doc_id", F.lit(".md")))
    return rows.select("doc_id", path.alias("path"), F.concat(front, F.coalesce("text", F.lit(""))).alias("text"))


def pilot_zones(spark, sf):
    """Zones of notes by the facts that their frontmatter states."""
    notes = _notes(spark, sf).select("path", "text", *(F.lit(None).cast("string").alias(c) for c in ("title", "status", "candidate_status")))
    rows = evaluate.pilot_catalog(notes, notes.select("path", F.lit("current").alias("verdict")))
    return rows.groupBy(F.array_join("eligible", ",").alias("zones"), "fresh").agg(F.count("*").alias("n"))


def plain_paths(spark, sf):
    """Page addresses without their scheme, with detours, in plain form."""
    pages = table(spark, sf, "pages")
    raw = F.concat(F.when(F.col("page_id") % 2 == 0, " ./").otherwise("/"), F.regexp_replace("url", "^[a-z]+://", ""), F.when(F.col("page_id") % 3 == 0, "/../x//./y").when(F.col("page_id") % 5 == 0, "/../../../../z").otherwise("/"))
    return pages.select("page_id", evaluate.plain_path(raw).alias("plain"))


def grant_validation(spark, sf):
    """Orders as grants of their customers, against a matrix of the customers' nations."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("actor"), "c_nationkey")
    matrix = customers.select("actor", F.explode(F.slice(F.array(*map(F.lit, access.DOMAINS)), F.lit(1), F.pmod("c_nationkey", F.lit(6)).cast("int") + 1)).alias("domain"), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("read"), F.lit("report-generation"))).otherwise(F.array(F.lit("read"))).alias("capabilities"))
    o = F.col("o_orderkey")
    grants = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("actor"), F.array(domain_of(o)).alias("domains"), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("report-generation"))).when(F.col("o_orderstatus") == "F", F.array(F.lit("read"), F.lit("report-generation"))).otherwise(F.array(F.lit("read"))).alias("capabilities"),
        F.array(F.element_at(F.array(*map(F.lit, privacy.CLASSES)), (F.pmod(F.floor(o / 4), F.lit(4)) + 1).cast("int"))).alias("privacy_classes"), F.when(F.col("o_orderpriority").startswith("5"), "someone").otherwise("owner").alias("issued_by"),
        F.col("o_orderdate").alias("issued_at"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("expires_at"), F.pmod(o, F.lit(23)).cast("int").alias("max_items"), F.lit(512).alias("max_bytes"),
    )
    return access.validate(grants, matrix, "owner").groupBy("refusal").agg(F.count("*").alias("n"))


def domain_entries(spark, sf):
    """Public documents of one domain by their bindings; a document without a binding is in none."""
    entries = _public(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "metadata")
    bound = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("note_id"), domain_of(F.col("doc_id")).alias("domain"))
    return access.in_domain(entries, bound, "finance").groupBy("metadata").agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("first"))


def writer_actors(spark, sf):
    """Events as writer requests of users, who are people, generating or capturing actors."""
    u = F.col("user_id")
    name = F.concat(F.when(u % 5 == 0, "human:").otherwise("agent:"), u.cast("string"))
    actors = table(spark, sf, "events").select("user_id").distinct().where(u % 7 != 0).select(F.concat(F.lit("sha256:"), F.sha2(u.cast("string"), 256)).alias("credential_sha256"), name.alias("actor"), (u % 3 != 0).alias("generated"), (u % 2 == 0).alias("captured"))
    e = table(spark, sf, "events")
    asked = e.select(
        F.when(F.col("event_type") != "error", u.cast("string")).alias("credential"), F.concat(F.lit("r"), "event_id").alias("request_id"), F.when(F.col("event_id") % 31 == 0, "").otherwise("t1").alias("task_id"),
        F.when(F.col("event_type") == "click", "captured").when(F.col("event_type") == "signup", "other").otherwise("generated").alias("mode"), F.when(F.col("value") > 50, "model-1").when(F.col("value") > 45, "unknown").alias("model_id"),
    )
    return access.writers(asked, actors).groupBy("refusal", F.contains("rendered", F.lit("/")).alias("with_model")).agg(F.count("*").alias("n"))


def create_targets(spark, sf):
    """Pages as new files below folders that their hosts have, are links, files or missing."""
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    pages = table(spark, sf, "pages").select("page_id", host.alias("host"))
    tree = pages.groupBy("host").agg(F.min("page_id").alias("low")).where("low % 7 <> 0").select(F.concat(F.lit("Core/"), "host").alias("path"), F.when(F.col("low") % 5 == 0, "link").when(F.col("low") % 3 == 0, "file").otherwise("folder").alias("kind"))
    taken = pages.where("page_id % 4 = 0").select(F.concat(F.lit("Core/"), "host", F.lit("/"), "page_id", F.lit(".md")).alias("path"), F.lit("file").alias("kind"))
    core = tree.agg(F.lit("Core").alias("path"), F.lit("folder").alias("kind"))
    targets = pages.select(F.concat(F.lit("Core/"), "host", F.lit("/"), "page_id", F.lit(".md")).alias("path"))
    return convert.create_targets(targets, core.unionByName(tree).unionByName(taken)).groupBy("refusal").agg(F.count("*").alias("n"))


def index_differences(spark, sf):
    """Points of a plan against those of an index that lacks some vectors and holds older ones."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("point_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    held = v.where("vec_id % 10 <> 3").withColumn("vector", F.when(F.col("vec_id") % 10 == 4, F.transform("vector", lambda x: x + 1)).otherwise(F.col("vector")))
    return vector.differing(held, v.where("vec_id % 10 <> 5")).select("point_id")


def zone_eligibility(spark, sf):
    pages = table(spark, sf, "pages")
    key = F.col("page_id")
    path = F.element_at(F.array(F.concat(F.lit("Private/_inbox/info-collect/"), key), F.concat(F.lit("Private/Life/health/reports/"), key), F.concat(F.lit("Core/project-"), key), F.concat(F.lit("Core/_inbox/"), key), F.concat(F.lit("Core/"), key)), (F.pmod(key, F.lit(5)) + 1).cast("int"))
    found = evaluate.zones(path, F.when(F.pmod(key, F.lit(2)) == 0, "active"), F.pmod(key, F.lit(4)) == 0, F.when(F.pmod(key, F.lit(3)) == 0, F.lit("lib")), F.lit("internal"))
    return pages.groupBy(F.array_join(found, ",").alias("zones")).agg(F.count("*").alias("n"))


def dedup_first_seen(spark, sf):
    # Nulls come last: the smallest event of each type first, then only the types are ordered.
    first = F.min(F.struct(F.col("ts").isNull().alias("no_ts"), "ts", F.col("event_id").isNull().alias("no_id"), "event_id")).alias("first")
    rows = table(spark, sf, "events").groupBy("user_id", "event_type").agg(first)
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("first_seen"))


def _requests(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("op"), F.pmod("event_id", F.lit(997)).cast("string")).alias("operation_id"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(997)).cast("string")).alias("idempotency_hash"),
        F.pmod("user_id", F.lit(2)).cast("string").alias("actor"), F.lit("t").alias("task_hash"), F.lit("p").alias("target_path"), F.lit("r").alias("request_hash"), F.col("ts").alias("created_at"), "event_id", "event_type", "value",
    )


def outbox_enqueue(spark, sf):
    rows = outbox.enqueue(_requests(spark, sf).withColumn("created_at", F.struct("created_at", "event_id")))
    return rows.groupBy("outcome", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def outbox_crossing(spark, sf):
    """Requests of a user whose operations and keys cross: what a refused request names stays free."""
    e = table(spark, sf, "events")
    rows = e.select(
        F.concat("user_id", F.lit("-"), F.pmod("event_id", F.lit(3))).alias("operation_id"), F.concat("user_id", F.lit("-"), F.pmod(F.floor(F.col("event_id") / 3), F.lit(4))).alias("idempotency_hash"), F.col("event_type").alias("actor"),
        *(F.lit("-").alias(c) for c in ("task_hash", "target_path", "request_hash")), F.struct("ts", "event_id").alias("created_at"), "user_id", "event_id",
    )
    return outbox.enqueue(rows).groupBy("user_id").agg(F.count_if(F.col("outcome") == "accepted").alias("accepted"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"), F.count_if(F.col("outcome") == "conflict").alias("conflicts"), F.sum(F.when(F.col("outcome") == "accepted", F.col("event_id"))).alias("accepted_ids"))


def history_freshness(spark, sf):
    """Events as commits: each user's line, with a merge of another event at every third sign-up.

    A user's last view stands for the export of the user's note and of the next user's; the
    last click, named by a prefix, for the note's last change.
    """
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    name = lambda c: F.sha1(F.col(c).cast("string").cast("binary"))
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    merged = F.when((F.col("event_type") == "signup") & (F.pmod("event_id", F.lit(3)) == 0) & (F.col("event_id") >= 7), F.col("event_id") - 7)
    parents = e.select("event_id", before.alias("before"), merged.alias("merged")).select("event_id", F.posexplode(F.array("before", F.nullif("merged", "before"))).alias("n", "p"))
    known = e.select(F.col("event_id").alias("p"), F.lit(True).alias("known"))
    # A commit without a first parent has one row with none. A parent is an earlier event.
    rows = parents.where("n = 0 OR p IS NOT NULL").join(known, "p", "left").where("n = 0 OR known")
    commits = stored(rows.select(name("event_id").alias("id"), "n", F.when(F.col("known"), name("p")).alias("parent"), F.col("event_id").alias("serial")))
    e = e.withColumn("id", name("event_id"))
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.struct("event_id", "id")))["id"]
    per = e.groupBy("user_id").agg(last("view").alias("export_commit"), F.substring(last("click"), 1, 12).alias("last_touch"))
    own = per.select(F.concat("user_id", F.lit("-own")).alias("path"), "export_commit", "last_touch")
    following = per.select((F.col("user_id") + 1).alias("user_id"), "export_commit").join(per.select("user_id", "last_touch"), "user_id").select(F.concat("user_id", F.lit("-next")).alias("path"), "export_commit", "last_touch")
    return history.freshness_of(stored(own.unionByName(following)), commits)


def request_hashes(spark, sf):
    """Documents as write requests: the digest of what each asks for, whatever order its fields came in."""
    front = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    rows = dealt(spark, sf, "documents")
    return rows.select("doc_id", writer.request_hash(F.concat(F.lit("op"), "doc_id"), F.concat(F.lit("Core/_inbox/"), "doc_id", F.lit(".md")), front, F.col("text"), F.lit("generated")).alias("request_hash"))


def json_faults(spark, sf):
    """Properties of events, some broken: cut off, followed by more, beyond doubles, nested too deep."""
    k, p = F.col("event_id"), F.col("props")
    forms = (p, F.concat(p, F.lit("]")), F.concat(F.lit('{"a":'), p, F.lit(',"x":1e999}')), F.concat(F.repeat(F.lit("["), (F.pmod(k, F.lit(5)) + 1).cast("int")), p, F.repeat(F.lit("]"), (F.pmod(k, F.lit(5)) + 1).cast("int"))), F.expr("left(props, length(props) - 1)"), F.concat(F.lit('["[[[[[[", '), p, F.lit("]")), F.concat(p, F.lit(" "), p))
    text = F.element_at(F.array(*forms), (F.pmod(k, F.lit(len(forms))) + 1).cast("int"))
    return table(spark, sf, "events").groupBy("event_type", values.json_fault(text, 4).alias("fault")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _pages_as_members(spark, sf):
    parts = F.split(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/")
    under = F.when(F.pmod("page_id", F.lit(3)) == 0, F.lit("_")).otherwise(F.lit(""))
    path = F.concat(F.lit("Core/"), under, parts[1], F.lit("/"), F.substring(parts[2], 1, 2), F.lit(".md"))
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


def spelling_refusals(spark, sf):
    """Pages as members, a third of them in folders that another index shows without their underscore."""
    return spelling.spellings(_pages_as_members(spark, sf)).groupBy("refused").agg(F.count("*").alias("spellings"), F.countDistinct("path").alias("members"))


def spelled_hits(spark, sf):
    """Hits of another index, a result list for every host, attributed to the pages that they mean."""
    members = _pages_as_members(spark, sf)
    shown = spelling.visible(F.col("path"))
    raw = F.element_at(F.array(F.concat(F.lit("./"), "path"), F.concat(F.lit("other://notes/"), shown, F.lit("?index=1")), F.col("path"), F.concat(F.lit("other://"), F.lit("none"))), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    hits = members.select(F.split("path", "/")[1].alias("query"), F.col("page_id").alias("rank"), raw.alias("raw"))
    return spelling.attributed(hits, spelling.spellings(members), "other")


def receipt_faults(spark, sf):
    """Receipts of captures, a group of events each in another way broken."""
    k = F.col("event_id")
    mode = F.pmod(k, F.lit(11))
    path = F.concat(F.lit("Core/_inbox/agent-captures/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), "event_type", F.lit(".md"))
    lines = F.array_compact(F.array(
        F.lit("note: done"), F.concat(F.lit("capture_path="), F.when(mode == 1, F.lit("x")).otherwise(path)), F.concat(F.lit("capture_status="), F.when(mode == 2, "planned").otherwise("created")),
        F.when(mode != 3, "capture_surface=core"), F.concat(F.lit("capture_git_mode="), F.when(mode == 4, "other").otherwise("direct")), F.when(mode == 5, F.lit("capture_note")), F.when(mode == 6, F.lit("capture_colour=red")), F.when(mode == 7, F.lit("capture_surface=core")),
        F.when(mode.isin(8, 9, 10), F.concat(F.lit("capture_contract="), F.when(mode == 8, "2").otherwise("3"))), F.when(mode.isin(8, 9, 10), F.concat(F.lit("capture_concept_id="), F.substring(path, F.lit(1), F.length(path) - 3))),
        F.when(mode.isin(8, 9, 10), F.concat(F.lit("capture_id=01890a5d-ac96-"), F.when(mode == 9, "4").otherwise("7"), F.lit("74b-bcce-b302099a8057"))),
    ))
    rows = table(spark, sf, "events").select("event_type", receipt.receipt(F.array_join(lines, "\n"), F.col("event_type"), F.lit(False)).alias("r"))
    return rows.groupBy("event_type", "r.fault", "r.contract").agg(F.count("*").alias("n"), F.count_distinct("r.path").alias("paths"))


def index_recovery(spark, sf):
    """Orders as queue records and the entries that a crash has left of their key index: some torn, some of records that are gone, some missing."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    name = lambda c: F.sha2(c.cast("string"), 256)
    records = o.where("o_orderstatus <> 'P'").select(name(k).alias("name"), F.concat("o_custkey", F.lit("-"), F.substring("o_orderpriority", 1, 1)).alias("key"))
    entry = F.when(F.pmod(k, F.lit(5)) == 0, F.substring(name(k), 1, 40)).otherwise(name(k))
    first = o.groupBy(F.concat("o_custkey", F.lit("-"), F.substring("o_orderpriority", 1, 1)).alias("key")).agg(F.max("o_orderkey").alias("o_orderkey"))
    index = first.where(F.pmod(k, F.lit(7)) != 0).select("key", entry.alias("name"))
    return outbox.recovered_index(index, records).groupBy("action").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("name").alias("last"))


def record_order(spark, sf):
    """Queue records in the order of a scan, each with its place."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.pmod("o_orderkey", F.lit(9)) == 0, F.lit("stray")).otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("name"))
    return outbox.scan_order(rows).select("o_orderkey", "place")


def outbox_replay(spark, sf):
    """Event types stand for states and refusals; the clock is the end of the tenth day."""
    kind = F.create_map(*(F.lit(x) for x in ("view", "queued", "click", "leased", "signup", "committed", "purchase", "queued", "error", "queued")))
    code = F.create_map(*(F.lit(x) for x in ("purchase", "base-moved", "error", "path-conflict", "click", "leader-unavailable")))
    rows = table(spark, sf, "events").select(
        "event_type", kind[F.col("event_type")].alias("state"), F.pmod("event_id", F.lit(7)).cast("int").alias("attempts"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("lease_until"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
        F.try_element_at(code, F.col("event_type")).alias("writer_code"),
    )
    return outbox.replay(rows, F.lit("2024-01-11 00:00:00").cast("timestamp")).groupBy("event_type", "step", "new_state", "new_code").agg(F.count("*").alias("n"), F.sum("new_attempts").alias("attempts"))


def metadata_conversion(spark, sf):
    """Events as legacy metadata: times in several spellings, citations in two fields."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ending = F.element_at(F.array(*map(F.lit, ("Z", "", "+08:00", "-14:00", "+14:00", "+0530"))), (F.pmod(k, F.lit(6)) + 1).cast("int"))
    none = F.lit(None).cast("array<string>")
    rows = e.select(
        F.when(F.pmod(k, F.lit(13)) == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.pmod(k, F.lit(17)) != 0, F.concat(stamp, ending)).alias("timestamp"), F.when(F.pmod(k, F.lit(19)) == 0, stamp).alias("created_at"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.array("props")).otherwise(none).alias("citations"), F.when(F.pmod(k, F.lit(5)) == 0, F.array(F.when(F.pmod(k, F.lit(2)) == 0, F.col("props")).otherwise(" "))).otherwise(none).alias("citations_capital"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.array("event_type")).otherwise(none).alias("sources"), (F.pmod(k, F.lit(4)) == 0).alias("has_generated"), F.array(F.lit("timestamp"), F.col("event_type")).alias("keys"),
    )
    out = convert.convert(rows)
    return out.groupBy("error", F.array_join("gaps", ",").alias("gaps"), F.array_join("dropped", ",").alias("dropped")).agg(F.count("*").alias("n"), F.count("out_created_at").alias("with_created_at"), F.count("out_sources").alias("with_sources"), F.sum(F.size("unmapped")).alias("unmapped"))


def write_targets(spark, sf):
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    stem = F.concat(F.lit("p"), k.cast("string"))
    path = F.element_at(F.array(F.concat(F.lit("Core/_inbox/"), stem, F.lit(".md")), F.concat(F.lit("Private/_inbox/"), stem, F.lit(".md")), F.concat(F.lit("/Core/_inbox/"), stem, F.lit(".md")), F.concat(F.lit("Core/_inbox/../"), stem, F.lit(".md")), F.concat(F.lit("Core/_inbox/a/"), stem, F.lit(".md")), F.concat(F.lit("Core/_inbox/"), stem)), (F.pmod(k, F.lit(6)) + 1).cast("int"))
    cls = F.element_at(F.array(*map(F.lit, privacy.CLASSES)), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    refusal = convert.target_refusal(path, cls, {"Core/_inbox/": ("public", "internal"), "Private/_inbox/": ("sensitive",)})
    return p.groupBy(refusal.alias("refusal"), F.pmod(k, F.lit(6)).alias("shape")).agg(F.count("*").alias("n"))


def payload_markers(spark, sf):
    markers = ["BEGIN PRIVATE KEY", "AKIA", "password", "secret"]
    rows = dealt(spark, sf, "documents")
    return rows.groupBy(convert.first_marker(F.col("text"), markers).alias("marker")).agg(F.count("*").alias("n"))


def revision_changes(spark, sf):
    """Per conversation, whether the text of a turn differs from the turn before of the same role."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("h", F.sha2("text", 256))
    flag = evaluate.stale_flag(F.lag("turn").over(w), F.lag("h").over(w), F.col("h"))
    return rows.withColumn("changed", flag).groupBy("role", "changed").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        gate_partition, strictness_histogram, note_classification, catalog_page, catalog_facets, corpus_field_averages, lexical_scores, lexical_topk, lexical_totals, lexical_topk_folded,
        snippet_window, snippet_window_folded, context_pack, bundle_revision, source_revisions, framed_digests, token_cost, text_sizes, hash_embedding_buckets, hash_embedding_rows, vector_topk, rerank_topk,
        domain_scope, grant_resolution, hit_rate_grouping_sets, latency_percentiles, leak_and_false_positive, stale_exclusion, gate_items, gate_verdict, export_diff, zone_eligibility, dedup_first_seen,
        shadow_report, shadow_summary, gate_from_report, pilot_zones, plain_paths, grant_validation, domain_entries, writer_actors, create_targets, index_differences, outbox_crossing, outbox_enqueue, outbox_replay, history_freshness, request_hashes, json_faults, spelling_refusals, spelled_hits, receipt_faults, index_recovery, record_order, metadata_conversion, write_targets, payload_markers, revision_changes,
    )
}
