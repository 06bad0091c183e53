"""Queries over what is reported about an archive or a run: diagnostics, dates, budgets, evaluation, releases."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import cost, evaluate, figures, longitudinal, safety, stats, tree
from threadloom.plans import dossier
from threadloom.plans import fixtures as X
from threadloom.plans.archive_queries import _MEMBERS, _TALKS, _members
from threadloom.plans.registry import query
from threadloom.plans.semantic_queries import _EVENTS, _TRUTH, _overlaps


_NOTED = _TALKS + """, noted AS (
  SELECT code, conversation_id, NULL AS kind, 0 AS hidden FROM codes JOIN talks USING (source_index)
  UNION ALL SELECT 'unknown_content_type', conversation_id, 'odd-' || source_index % 3, 0 FROM talks WHERE source_index % 37 = 5
  UNION ALL SELECT 'warnings_suppressed', NULL, NULL, source_index FROM talks WHERE source_index % 50 = 7)
"""


@query(_NOTED + """SELECT 'warning_count' AS section, 'all' AS name, count(*) AS n FROM noted HAVING count(*) > 0
UNION ALL SELECT 'warnings_by_code', code, count(*) FROM noted GROUP BY 2
UNION ALL SELECT 'warnings_by_severity', CASE code WHEN 'dangling_parent' THEN 'error' WHEN 'warnings_suppressed' THEN 'info' ELSE 'warning' END, count(*) FROM noted GROUP BY 2
UNION ALL SELECT 'affected_conversations_by_code', code, count(DISTINCT conversation_id) FROM noted GROUP BY 2
UNION ALL SELECT 'unknown_content_types', kind, count(*) FROM noted WHERE kind IS NOT NULL GROUP BY 2
UNION ALL SELECT 'suppressed_count', 'all', sum(hidden)::BIGINT FROM noted HAVING count(*) > 0
UNION ALL SELECT 'source_child_edge_totals', name, sum(n)::BIGINT FROM (UNPIVOT (SELECT * EXCLUDE source_index FROM disagree) ON COLUMNS(*) INTO NAME name VALUE n) GROUP BY 2""")
def diagnostics_report(spark, sf_dir):
    talks = X.conversations(spark, sf_dir)
    edges = tree.edge_disagreement(X.nodes(spark, sf_dir)).select("source_index", F.lit("source_child_edges_disagree").alias("code"), F.to_json(F.struct(*stats.EDGE_COUNTS)).alias("context"))
    found = X.warnings(spark, sf_dir).join(edges, ["source_index", "code"], "left").select("code", "conversation_id", "context")
    i = F.col("source_index")
    odd = talks.where(i % 37 == 5).select(F.lit("unknown_content_type").alias("code"), "conversation_id", F.to_json(F.struct(F.concat(F.lit("odd-"), i % 3).alias("content_type"))).alias("context"))
    hidden = talks.where(i % 50 == 7).select(F.lit("warnings_suppressed").alias("code"), F.lit(None).cast("string").alias("conversation_id"), F.to_json(F.struct(i.alias("suppressed_count"))).alias("context"))
    severity = F.when(F.col("code") == "dangling_parent", "error").when(F.col("code") == "warnings_suppressed", "info").otherwise("warning")
    return stats.diagnostics(found.unionByName(odd).unionByName(hidden).withColumn("severity", severity))


@query(_TALKS + """, d AS (SELECT source_index, coalesce(created_at, updated_at) AS d FROM talks)
SELECT source_index, coalesce(strftime(d, '%B ') || day(d) || ', ' || year(d), 'Undated') AS shown, coalesce(strftime(d, '%b %Y'), 'Undated') AS month FROM d""")
def display_dates(spark, sf_dir):
    return X.conversations(spark, sf_dir).select("source_index", T.display_date(stats.date_of()).alias("shown"), T.month_label(stats.date_of()).alias("month"))


@query("""WITH d AS (SELECT doc_id // 3 AS few, CASE WHEN doc_id % 17 <> 0 THEN make_timestamp((1746266400 + (doc_id * 7919 % 500) * 86400) * 1000000) END AS d FROM documents),
r AS (SELECT few, min(d) AS a, max(d) AS z FROM d GROUP BY 1)
SELECT few, CASE WHEN a IS NULL THEN NULL WHEN strftime(a, '%Y-%m') = strftime(z, '%Y-%m') THEN strftime(z, '%B %Y') WHEN year(a) = year(z) THEN strftime(a, '%B') || '–' || strftime(z, '%B %Y') ELSE strftime(a, '%B %Y') || '–' || strftime(z, '%B %Y') END AS dates FROM r""")
def category_date_ranges(spark, sf_dir):
    items = X.items(spark, sf_dir).select(F.floor(F.col("source_index") / 3).alias("few"), "created_at", "updated_at")
    return stats.date_ranges(items, "few")


@query(_TALKS + """, b AS (SELECT source_index, role, CASE WHEN role = 'assistant' AND source_index % 6 = 1 THEN 'thinking_trace' ELSE block_type END AS block_type FROM nodes)
SELECT source_index, role, count(*) AS blocks FROM b WHERE role IN ('user', 'assistant', 'system', 'developer') AND block_type NOT IN ('thinking_trace', 'reasoning_summary') GROUP BY ALL""")
def printed_blocks(spark, sf_dir):
    thought = (F.col("role") == "assistant") & (F.col("source_index") % 6 == 1)
    blocks = X.nodes(spark, sf_dir).select("source_index", "role", F.when(thought, "thinking_trace").otherwise(F.col("block_type")).alias("block_type"))
    return stats.shown_blocks(blocks, system=True).groupBy("source_index", "role").agg(F.count(F.lit(1)).alias("blocks"))


@query("SELECT doc_id, ((length(text) + 2) // 3)::BIGINT AS tokens, sha256(substr(text, 1, 600)) AS bounded_sha256 FROM documents")
def embedding_bounds(spark, sf_dir):
    return X.read(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"), F.sha2(T.bounded_text(F.col("text"), 200), 256).alias("bounded_sha256"))


@query("""WITH e AS (SELECT count(*) AS items, ((sum(length(text)) + 3) // 4)::BIGINT AS tokens FROM documents),
a AS (SELECT *, least(items, 500, 40 * 6)::BIGINT AS refined FROM e),
b AS (SELECT *, ((refined + 7) // 8)::BIGINT AS requests, least(tokens, items * 8000)::BIGINT AS embedded, (refined * least((tokens + items - 1) // items, 900))::BIGINT AS profile, 2000 + 40 * 700 + refined * 160 AS taxonomy, 3000 + 40 * 1100 + refined * 220 AS synthesis FROM a),
c AS (SELECT *, embedded * 0.02::DOUBLE / 1e6 + (profile * 0.2::DOUBLE + refined * 180 * 1.25::DOUBLE) / 1e6 + (taxonomy * 0.75::DOUBLE + 40 * 150 * 4.5::DOUBLE) / 1e6 + (synthesis * 2.5::DOUBLE + 8000 * 15::DOUBLE) / 1e6 AS expected,
  ((embedded * 12 + 9) // 10) * 0.02::DOUBLE / 1e6 + (((profile * 12 + 9) // 10 + 512 * requests) * 0.2::DOUBLE + requests * 6000 * 1.25::DOUBLE) / 1e6
  + (((taxonomy * 12 + 9) // 10 + 512) * 0.75::DOUBLE + 16000 * 4.5::DOUBLE) / 1e6 + (((synthesis * 12 + 9) // 10 + 512) * 2.5::DOUBLE + 32000 * 15::DOUBLE) / 1e6 AS reserve FROM b)
SELECT items, refined AS refined_count, requests AS profile_requests, embedded AS embedding_tokens, (profile + taxonomy + synthesis)::BIGINT AS structured_input_tokens, (refined * 180 + 40 * 150 + 8000)::BIGINT AS structured_output_tokens,
round(expected, 6) AS expected_cost, round(reserve, 6) AS reserved_cost, reserve <= 5 AS fits FROM c""")
def scheduled_cost_plan(spark, sf_dir):
    estimate = X.read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("items"), T.approximate_tokens(F.sum(F.length("text"))).alias("approximate_tokens"))
    price = lambda read, write="0": cost.Price(Decimal(read), Decimal(write))
    work = cost.Work(leaf_categories=40, refined_per_category=6, most_refined=500, batch=8, embedding_tokens=8000, profile_tokens=900, profile_reply=6000, taxonomy_reply=16000, synthesis_reply=32000)
    return cost.scheduled_plan(estimate, price("0.02"), price("0.2", "1.25"), price("0.75", "4.5"), price("2.5", "15"), work, Decimal(5))


@query("""SELECT event_id, used::BIGINT AS used, used <= 9000 AS fits FROM (SELECT event_id, sum(floor(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS used FROM events)""")
def token_window(spark, sf_dir):
    requests = X.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("at"), F.floor(F.col("value") * 100).alias("tokens"))
    return cost.token_window(requests, 9000, 86_400).select("event_id", "used", "fits")


@query("""WITH g AS (SELECT doc_id AS key FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 13 = 1 UNION ALL SELECT -1 - doc_id FROM documents WHERE doc_id % 11 = 0),
n AS (SELECT key, count(*) AS n FROM g GROUP BY 1)
SELECT key, CASE WHEN n IS NULL THEN 'missing' WHEN key < 0 THEN 'unexpected' ELSE 'repeated' END AS problem FROM (SELECT doc_id AS key FROM documents) FULL JOIN n USING (key) WHERE n IS NULL OR n > 1 OR key < 0""")
def key_differences(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    given = docs.where("key % 7 <> 0").unionByName(docs.where("key % 13 = 1")).unionByName(docs.where("key % 11 = 0").select((-1 - F.col("key")).alias("key")))
    return evaluate.key_differences(docs, given)


_COUNTED = _MEMBERS[: _MEMBERS.index("SELECT page_id, path")]


@query(_COUNTED + """SELECT archive::VARCHAR AS archive, count(*) AS files, sum(size_bytes)::BIGINT AS total_uncompressed_bytes, sum(compressed)::BIGINT AS total_compressed_bytes,
array_to_string(list_filter([CASE WHEN count(*) > 60 THEN 'too_many_files' END, CASE WHEN sum(size_bytes) > 100000 THEN 'too_large_uncompressed' END], lambda x: x IS NOT NULL), '|') AS codes FROM m GROUP BY archive""")
def member_totals(spark, sf_dir):
    from threadloom.schema import Limits
    from threadloom.sources import zip_export

    return zip_export.archive_findings(_members(spark, sf_dir), Limits(max_files=60, max_total_uncompressed_bytes=100_000))


@query(f"""WITH f AS ({_MEMBERS}) SELECT (SELECT count(*) FROM f) AS member_count, (SELECT bool_or(regexp_matches(lower(path), '(^|/)conversations[^/]*$')) FROM f) AS has_conversations,
(SELECT string_agg(c, '|' ORDER BY c) FROM (SELECT DISTINCT unnest(string_split(codes, '|')) AS c FROM f WHERE codes <> '')) AS codes""")
def preflight_summary(spark, sf_dir):
    from threadloom.schema import Limits
    from threadloom.sources import zip_export

    limits = Limits(max_member_uncompressed_bytes=5000, min_ratio_check_bytes=1000, max_compression_ratio=4.0)
    return dossier.preflight_summary(zip_export.findings(_members(spark, sf_dir), limits))


@query("""WITH p AS (SELECT 'project-' || user_id AS project, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT project, n AS members, place, event_id::VARCHAR AS key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment FROM p WHERE n >= 3 AND (n <= 12 OR list_contains([round_even(i * (n - 1) / 11.0, 0)::BIGINT FOR i IN range(12)], place))""")
def project_timelines(spark, sf_dir):
    rows = X.read(spark, sf_dir, "events").select(F.concat(F.lit("project-"), "user_id").alias("project"), F.col("event_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return longitudinal.timelines(rows).select("project", "members", F.explode("events").alias("e")).select("project", "members", "e.place", "e.key", F.col("e.at").alias("moment"))


@query(_EVENTS + "SELECT project, row_number() OVER (PARTITION BY project ORDER BY kind) - 1 AS ordinal, kind AS question FROM (SELECT DISTINCT project, kind FROM e)")
def open_work(spark, sf_dir):
    return figures.open_work(X.projects(spark, sf_dir).groupBy("project").agg(F.sort_array(F.collect_set("kind")).alias("unresolved")))


@query(_TRUTH + """, known AS (SELECT DISTINCT truth FROM t UNION ALL SELECT 'lang-none')
SELECT 'missed' AS verdict, truth AS name FROM known LEFT JOIN o USING (truth) GROUP BY 2 HAVING coalesce(max(overlap), 0) < 0.2
UNION ALL SELECT 'fragmented', truth FROM o WHERE overlap >= 0.12 GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'merged', inferred FROM (SELECT * FROM o WHERE overlap >= 0.12 QUALIFY row_number() OVER (PARTITION BY truth ORDER BY overlap DESC, inferred DESC) = 1) GROUP BY 2 HAVING count(*) > 1""")
def project_verdicts(spark, sf_dir):
    known = X.read(spark, sf_dir, "documents").select(F.concat(F.lit("lang-"), "lang").alias("name")).distinct()
    return evaluate.verdicts(known.unionByName(spark.createDataFrame([("lang-none",)], "name string")), _overlaps(spark, sf_dir))


@query("""WITH c AS (SELECT source AS category, CASE WHEN source < 'src3' THEN ' Shared' ELSE 'Own ' || source END AS name FROM documents GROUP BY ALL),
w AS (SELECT DISTINCT source AS category, CASE doc_id % 4 WHEN 0 THEN 'Design' WHEN 1 THEN 'result' WHEN 2 THEN lang ELSE 'review ' || source END AS term FROM documents)
SELECT 'duplicate name' AS finding, trim(lower(name)) AS name FROM c GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'generic term', lower(term) FROM w WHERE lower(term) IN ('analysis', 'design', 'review', 'conversation', 'project', 'result', 'using') GROUP BY 2 HAVING count(*) >= 2
UNION ALL SELECT 'missed milestone', 'doc-' || doc_id FROM documents WHERE doc_id % 10 = 0 AND doc_id % 3 = 0""")
def evaluation_findings(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    categories = docs.select("source").distinct().select(F.when(F.col("source") < "src3", " Shared").otherwise(F.concat(F.lit("Own "), "source")).alias("name"))
    kind = F.col("doc_id") % 4
    term = F.when(kind == 0, "Design").when(kind == 1, "result").when(kind == 2, F.col("lang")).otherwise(F.concat(F.lit("review "), "source"))
    concepts = docs.select(F.col("source").alias("category"), term.alias("term")).distinct()
    keys = docs.select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("key"))
    parts = {
        "duplicate name": evaluate.duplicate_names(categories),
        "generic term": evaluate.generic_terms(concepts).select(F.col("term").alias("name")),
        "missed milestone": evaluate.missed_milestones(keys.where("doc_id % 10 = 0"), keys.where("doc_id % 3 <> 0")).select(F.col("key").alias("name")),
    }
    first, *others = (part.select(F.lit(finding).alias("finding"), "name") for finding, part in parts.items())
    for other in others:
        first = first.unionByName(other)
    return first


@query("""WITH f AS (SELECT count(*) AS docs, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(*) FILTER (text LIKE '%zzz%') AS none, count(*) FILTER (doc_id % 2 = 0) AS even FROM documents)
SELECT unnest(['timelines', 'matched_projects', 'temporal', 'open_loops', 'dormant', 'reversals', 'connections', 'duplicate_names', 'generic_names', 'evidence_failures', 'unsupported']) AS condition,
unnest([docs >= 4, langs >= 4, sources >= 5, even >= 4, none >= 2, langs >= 2, sources >= 4, none = 0, even = 0, none = 0, docs = 0]) AS passed FROM f""")
def acceptance_conditions(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    row = docs.agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"), F.count_if(F.contains("text", F.lit("zzz"))).alias("none"), F.count_if(F.col("doc_id") % 2 == 0).alias("even"))
    given = {"timelines": "docs", "matched": "langs", "temporal": "sources", "open_loops": "even", "dormant": "none", "reversals": "langs", "connections": "sources", "duplicate_names": "none", "generic_names": "even", "evidence_failures": "none", "unsupported": "docs"}
    return evaluate.acceptance(row.select(*(F.col(c).alias(k) for k, c in given.items())))


_FILES = [
    "src/{}.py", "private_data/{}.txt", "docs/taxonomy.json", "a/conversations-{}.json", "b/{}.ir.json", "dist/{}.md", "notes/{}.MD", "bin/{}.dat", "x/outputs.txt", "outputs/run/{}.html", "conversations.jsonl", "e/.json",
]
_LEAKS = [" key=sk-" + "a1" * 11, " xsk-" + "a1" * 11, " ghp_" + "Z9" * 12, " github_pat_" + "q_" * 10, " sk-short", ""]


@query("WITH f AS (SELECT doc_id, CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN replace('{p}', '{{}}', doc_id::VARCHAR)" for i, p in enumerate(_FILES)) + " END || '' AS p, text || CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_LEAKS)) + """ ELSE '' END AS text FROM documents),
g AS (SELECT p AS path, parse_path(p) AS parts, text, length(text) AS size FROM f),
h AS (SELECT path, CASE WHEN len(list_intersect(parts, ['.semantic_cache', 'outputs', 'private_data', 'source_exports'])) > 0 THEN 'private-artifact-directory'
  WHEN regexp_matches(parts[-1], '^(conversations|taxonomy)\\.json$|^conversations-.*\\.json$|\\.ir\\.json$') THEN 'private-artifact-name'
  WHEN regexp_matches(lower(parts[-1]), '.\\.(py|txt|json|md|html)$') AND size <= 5000000 AND regexp_matches(text, '(^|[^A-Za-z0-9])(sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})') THEN 'credential-pattern' END AS problem FROM g WHERE NOT list_contains(parts, 'dist'))
SELECT * FROM h WHERE problem IS NOT NULL""")
def release_scan(spark, sf_dir):
    d = F.col("doc_id")
    path, leak = F.lit(None).cast("string"), F.lit("")
    for i, p in enumerate(_FILES):
        path = F.when(d % len(_FILES) == i, F.replace(F.lit(p), F.lit("{}"), d.cast("string"))).otherwise(path)
    for i, t in enumerate(_LEAKS):
        leak = F.when(d % 7 == i, F.lit(t)).otherwise(leak)
    files = X.read(spark, sf_dir, "documents").select(path.alias("path"), F.concat("text", leak).alias("text"))
    return safety.release_findings(files.withColumn("size_bytes", F.length("text")))


@query("""WITH r AS (SELECT 'p' || (doc_id * doc_id % 61) AS project, doc_id, n_chars % 100 AS confidence, doc_id * 7919 % 500 AS moment FROM documents),
big AS (SELECT project, count(*) AS occurrences FROM r GROUP BY 1 ORDER BY count(*) DESC, min(doc_id) LIMIT 24),
k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY confidence DESC, doc_id) AS sure, row_number() OVER (PARTITION BY project ORDER BY moment, doc_id) - 1 AS place, count(*) OVER (PARTITION BY project) AS n FROM r JOIN big USING (project) WHERE occurrences >= 2),
o AS (SELECT *, CASE WHEN sure <= 3 THEN 0 WHEN list_contains([round_even(i * (n - 1) / 9.0, 0)::BIGINT FOR i IN range(10)], place) THEN 1 ELSE 2 END AS o FROM k)
SELECT project, occurrences, doc_id FROM o QUALIFY row_number() OVER (PARTITION BY project ORDER BY o, CASE WHEN o = 2 THEN -place ELSE place END) <= 10""")
def project_evidence(spark, sf_dir):
    d = F.col("doc_id")
    rows = X.read(spark, sf_dir, "documents").select(F.concat(F.lit("p"), (d * d) % 61).alias("project"), d.alias("key"), (F.col("n_chars") % 100).alias("confidence"), (d * 7919 % 500).alias("at"), d.alias("position"))
    return longitudinal.project_evidence(rows).select("project", "occurrences", F.col("key").alias("doc_id"))
