"""Queries over texts, vectors, taxonomies, timelines, figures, the book and costs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as T
from threadloom.functions import vectors as H
from threadloom.functions import vocabulary as V
from threadloom.operators import book, cost, evaluate, figures, longitudinal, profiles, simgraph, stats, taxonomy
from threadloom.plans import fixtures as X
from threadloom.plans.registry import query
from threadloom.plans.session import settled


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(column: str, markers) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in markers) + ")"


def _first(column: str, groups, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, m)} THEN '{n}'" for n, m in groups) + f" ELSE {default} END"


_ITEMS = f"""
WITH items AS (
  SELECT doc_id, substr(sha256('semantic-conversation-v1' || chr(0) || doc_id || chr(0) || 'documents' || chr(0) || 'doc-' || doc_id), 1, 24) AS key, doc_id + 1 AS position, lang, source,
    regexp_replace(substr(text, 1, 30), '\\s+', ' ', 'g') AS title,
    CASE WHEN doc_id % 17 <> 0 THEN make_timestamp((1746266400 + (doc_id * 7919 % 500) * 86400) * 1000000) END AS moment,
    text || CASE doc_id % 5 WHEN 0 THEN ' We decided to keep the plan of alpha-beta-tool. It remains to check alpha-beta-tool and report_final.csv.'
      WHEN 1 THEN ' Work resumed after the hiatus! The goal is to build project-' || (doc_id % 20) || '.md and tool-kit.'
      WHEN 2 THEN ' The build failed with a traceback. We will adopt a python notebook instead of midi music.' ELSE '' END AS text
  FROM documents),
toks AS (SELECT key, lang, list_filter(list_transform(regexp_extract_all(text, '{V.TOKEN}'), lambda x: lower(x)), lambda x: NOT list_contains({_list(V.STOPWORDS)}, x)) AS t FROM items),
flat AS (SELECT key, lang, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM toks),
ranked AS (SELECT key, token, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(pos)) AS r FROM flat GROUP BY key, token),
sents AS (SELECT key, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: substr(trim(x), 1, 500)), lambda x: x <> '') AS s FROM items),
hands AS (SELECT key, position, list_distinct(list_transform(regexp_extract_all(' ' || regexp_replace(text, '[^\\x00-\\x7F]', 'Q', 'g'), '{V.HANDLE}'), lambda x: lower(x))) AS h FROM items)
"""


def _told(markers, limit: int = 4) -> str:
    return f"list_filter(s, lambda x: {_any('lower(x)', markers)})[1:{limit}]"


def _marked(markers, limit: int = 4) -> str:
    return f"array_to_string({_told(markers, limit)}, '|')"


@query(_ITEMS + "SELECT lang, token, count(*) AS n FROM flat GROUP BY ALL")
def token_counts(spark, sf_dir):
    return X.items(spark, sf_dir).select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


@query(_ITEMS + "SELECT key AS conversation_key, array_to_string(list(token ORDER BY r), '|') AS keywords FROM ranked WHERE r <= 12 GROUP BY 1")
def keyword_top12(spark, sf_dir):
    return profiles.keywords(X.items(spark, sf_dir), "conversation_key", T.tokens(F.col("text")))


@query(_ITEMS + "SELECT lang, b AS bigram, count(*) AS n FROM (SELECT lang, unnest([t[i] || '::' || t[i + 1] FOR i IN range(1, len(t))]) AS b FROM toks) GROUP BY ALL HAVING count(*) > 1")
def bigram_counts(spark, sf_dir):
    return X.items(spark, sf_dir).select("lang", F.explode(T.bigrams(T.tokens(F.col("text")))).alias("bigram")).groupBy("lang", "bigram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(_ITEMS + "SELECT key AS conversation_key, len(s) AS sentences, s[1] AS first_sentence, s[-1] AS last_sentence FROM sents")
def sentence_split(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return X.items(spark, sf_dir).select("conversation_key", s.alias("s")).select("conversation_key", F.size("s").alias("sentences"), F.element_at("s", 1).alias("first_sentence"), F.element_at("s", -1).alias("last_sentence"))


@query(_ITEMS + f"SELECT key AS conversation_key, {_marked(V.DECISION_MARKERS)} AS decisions, {_marked(V.QUESTION_MARKERS)} AS questions, {_marked(V.GOAL_MARKERS, 3)} AS goals FROM sents")
def marker_sentences(spark, sf_dir):
    rows, said = X.items(spark, sf_dir).select("conversation_key", T.told(F.col("text")).alias("told")), F.col("told")
    return rows.select("conversation_key", T.marked(said, V.DECISION_MARKERS).alias("decisions"), T.marked(said, V.QUESTION_MARKERS).alias("questions"), T.marked(said, V.GOAL_MARKERS, 3).alias("goals"))


@query(_ITEMS + f"SELECT key AS conversation_key, {_first('lower(text)', V.CONVERSATION_TYPES, chr(39) + V.DEFAULT_TYPE + chr(39))} AS conversation_type, {_first('lower(text)', V.TEMPORAL_ROLES, 'NULL')} AS temporal_role FROM items")
def conversation_type(spark, sf_dir):
    return X.items(spark, sf_dir).select("conversation_key", T.conversation_type(F.col("text")).alias("conversation_type"), T.temporal_role(F.col("text")).alias("temporal_role"))


@query(_ITEMS + "SELECT key AS conversation_key, array_to_string(list_sort(h), '|') AS handles FROM hands")
def artifact_handles(spark, sf_dir):
    return X.items(spark, sf_dir).select("conversation_key", F.sort_array(F.array_distinct(T.handles(F.col("text")))).alias("handles"))


@query(_ITEMS + """, each AS (SELECT (position - 1) // 8 AS batch, unnest(h) AS handle FROM hands), sizes AS (SELECT (position - 1) // 8 AS batch, count(*) AS size FROM hands GROUP BY 1)
SELECT batch, handle, count(*) AS n FROM each JOIN sizes USING (batch) GROUP BY batch, handle, size HAVING count(*) >= 3 AND count(*) <= greatest(3, floor(size * 0.45))""")
def recurring_handles_by_batch(spark, sf_dir):
    return profiles.recurring_handles(X.items(spark, sf_dir), 8, text="text")


@query(_ITEMS + "SELECT key AS conversation_key, CASE WHEN length(c) > 360 THEN rtrim(substr(c, 1, 360)) || '…' ELSE c END AS synopsis FROM (SELECT key, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM items)")
def synopsis(spark, sf_dir):
    return X.items(spark, sf_dir).select("conversation_key", T.synopsis(F.col("text"), F.col("title")).alias("synopsis"))


@query(_ITEMS + """, few AS (SELECT key, list(token ORDER BY r) AS w FROM ranked WHERE r <= 3 GROUP BY 1)
SELECT key AS conversation_key, coalesce((SELECT string_agg(array_to_string(list_transform(regexp_extract_all(replace(x, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'), lambda p: upper(p[1]) || lower(p[2:])), ''), ' · ' ORDER BY i) FROM (SELECT unnest(w) AS x, generate_subscripts(w, 1) AS i)), 'General conversation') AS label FROM items LEFT JOIN few USING (key)""")
def subject_labels(spark, sf_dir):
    items = X.items(spark, sf_dir)
    words = profiles.keywords(items, "conversation_key", T.tokens(F.col("text")), 3)
    none = F.array().cast("array<string>")
    return items.join(words, "conversation_key", "left").select("conversation_key", T.label(F.coalesce("keywords", none), F.lit("General conversation")).alias("label"))


@query(_ITEMS + ", hit AS (SELECT key, " + ", ".join(f"len(list_intersect(list_distinct(t), {_list(w)})) AS d{i}" for i, (_, w) in enumerate(V.DOMAINS)) + " FROM toks) SELECT key AS conversation_key, CASE WHEN greatest(" + ", ".join(f"d{i}" for i in range(len(V.DOMAINS))) + f") = 0 THEN '{V.DEFAULT_DOMAIN}' " + " ".join(f"WHEN d{i} = greatest({', '.join(f'd{j}' for j in range(len(V.DOMAINS)))}) THEN '{n}'" for n, i in sorted((n, i) for i, (n, _) in enumerate(V.DOMAINS))) + " END AS domain FROM hit")
def domains(spark, sf_dir):
    return X.items(spark, sf_dir).select("conversation_key", T.domain(T.tokens(F.col("text"))).alias("domain"))


def _named(words: str) -> str:
    """The words of a list, each as a label."""
    return f"list_transform({words}, lambda w: array_to_string(list_transform(regexp_extract_all(replace(w, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'), lambda p: upper(p[1]) || lower(p[2:])), ''))"


_PROFILES = _ITEMS + f""", terms AS (SELECT key, list_filter(list_transform(regexp_extract_all(title || ' ' || title || ' ' || text, '{V.TOKEN}'), lambda x: lower(x)), lambda x: NOT list_contains({_list(V.STOPWORDS)}, x)) AS t,
  list_filter(list_transform(regexp_extract_all(title, '{V.TOKEN}'), lambda x: lower(x)), lambda x: NOT list_contains({_list(V.STOPWORDS)}, x)) AS own FROM items),
spread AS (SELECT key, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM terms),
best AS (SELECT key, token, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(pos)) AS r FROM spread GROUP BY key, token),
kw AS (SELECT key, list(token ORDER BY r) AS k FROM best WHERE r <= 12 GROUP BY key),
found AS (SELECT key, (position - 1) // 8 AS batch, list_transform(regexp_extract_all(' ' || regexp_replace(title || ' ' || text, '[^\\x00-\\x7F]', 'Q', 'g'), '{V.HANDLE}'), lambda x: lower(x)) AS h FROM items),
one AS (SELECT key, batch, h, min(pos) AS pos, count(*) AS n FROM (SELECT key, batch, unnest(h) AS h, generate_subscripts(h, 1) AS pos FROM found) GROUP BY ALL),
sizes AS (SELECT batch, count(*) AS size FROM found GROUP BY 1),
often AS (SELECT batch, h FROM one JOIN sizes USING (batch) GROUP BY batch, h, size HAVING count(*) >= 3 AND count(*) <= greatest(3, floor(size * 0.45))),
projects AS (SELECT key, list(h ORDER BY pos)[1:2] AS p FROM (SELECT one.*, often.h IS NOT NULL AS often FROM one LEFT JOIN often USING (batch, h)) WHERE often OR (contains(h, '-') AND NOT contains(h, '.') AND n >= 2) GROUP BY 1),
made AS (SELECT key, position, regexp_replace(trim(text), '\\s+', ' ', 'g') AS c, title, s, CASE WHEN len(own) > 0 THEN own[1:3] ELSE coalesce(k, [])[1:3] END AS top, coalesce(k, []) AS k, coalesce(p, []) AS p, text
  FROM items JOIN terms USING (key) JOIN sents USING (key) LEFT JOIN kw USING (key) LEFT JOIN projects USING (key)),
profile AS (SELECT key AS conversation_key, position, CASE WHEN length(c) > 360 THEN rtrim(substr(c, 1, 360)) || '…' WHEN c = '' THEN 'Conversation titled ' || chr(39) || title || chr(39) || '.' ELSE c END AS synopsis,
  CASE WHEN len(top) = 0 THEN 'General conversation' ELSE array_to_string({_named('top')}, ' · ') END AS primary_subject, {_named('k[4:8]')} AS secondary_subjects, {_named('p')} AS projects,
  {_first('lower(text)', V.CONVERSATION_TYPES, chr(39) + V.DEFAULT_TYPE + chr(39))} AS conversation_type, {_named('k[1:6]')} AS entities, {_told(V.GOAL_MARKERS, 3)} AS goals, {_told(V.DECISION_MARKERS)} AS decisions,
  {_told(V.QUESTION_MARKERS)} AS unresolved_questions, {_named('k[9:12]')} AS recurring_themes, {_first('lower(text)', V.TEMPORAL_ROLES, 'NULL')} AS temporal_role, 0.5::DOUBLE AS confidence FROM made)
"""
_JOINED = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in ("secondary_subjects", "projects", "entities", "goals", "decisions", "unresolved_questions", "recurring_themes"))


@query(_PROFILES + f"SELECT * REPLACE ({_JOINED}) FROM profile")
def conversation_profiles(spark, sf_dir):
    return profiles.profiles(X.items(spark, sf_dir))


@query(_ITEMS + "SELECT key AS conversation_key, sha256(regexp_replace(regexp_replace(text, '[0-9]{4,}', '<number>', 'g'), '([a-z]+)@([a-z0-9.]+)', '\\1 at <host>', 'g')) AS digest FROM items")
def redacted_text(spark, sf_dir):
    rules = [(r"[0-9]{4,}", "<number>"), (r"([a-z]+)@([a-z0-9.]+)", r"\1 at <host>")]
    return X.items(spark, sf_dir).select("conversation_key", F.sha2(T.redact(F.col("text"), rules), 256).alias("digest"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '([\\`|*_{}\[\]<>()#+.!-])', '\\\1', 'g')) AS digest FROM documents")
def escaped_markdown(spark, sf_dir):
    return X.read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.escape_markdown(F.col("text")), 256).alias("digest"))


@query()
def hash_embedding(spark, sf_dir):
    return H.hash_embeddings(X.items(spark, sf_dir), "conversation_key", F.col("title"), F.col("text")).select("key", F.transform("vector", lambda v: F.round(v, 6)).alias("vector"))


_GRAPH = """
WITH v AS (SELECT printf('v%06d', vec_id) AS key, embedding::DOUBLE[] AS e, printf('category-%04d', label + 1) AS category FROM embeddings),
sims AS (SELECT a.key AS node, b.key AS other, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.key <> b.key),
near AS (SELECT * FROM sims WHERE s >= 0.32),
pick AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY node ORDER BY s DESC, other) <= 10),
edges AS (SELECT least(node, other) AS source_key, greatest(node, other) AS target_key, max(s) AS s FROM pick GROUP BY 1, 2),
ways AS (SELECT source_key AS node, target_key AS other, s FROM edges UNION ALL SELECT target_key, source_key, s FROM edges),
m AS (SELECT key, category FROM v),
scores AS (SELECT w.node AS key, a.category, b.category AS other, sum(s) AS score FROM ways w JOIN m a ON a.key = w.node JOIN m b ON b.key = w.other GROUP BY ALL),
assigned AS (SELECT m.key, m.category, coalesce(t.own / t.every, 0.5) AS structural, 0.45 * 0.5 + 0.35 * 0.5 + 0.2 * coalesce(t.own / t.every, 0.5) AS confidence
  FROM m LEFT JOIN (SELECT key, sum(CASE WHEN category = other THEN score ELSE 0 END) AS own, sum(score) AS every FROM scores GROUP BY 1) t USING (key)),
second AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY round(score, 9) DESC, other) AS rank, other, score FROM (SELECT *, max(score) OVER (PARTITION BY key) AS top FROM scores WHERE category <> other) WHERE score >= greatest(0.01, top * 0.6) QUALIFY rank <= 2),
queue AS (
  SELECT 'low_analysis_confidence' AS code, 'high' AS priority, key, NULL AS category FROM m
  UNION ALL SELECT 'isolated_conversation', 'medium', key, NULL FROM m WHERE key NOT IN (SELECT node FROM ways)
  UNION ALL SELECT 'low_category_confidence', 'high', key, category FROM assigned WHERE confidence < 0.65
  UNION ALL SELECT DISTINCT 'ambiguous_assignment', 'low', key, m.category FROM second JOIN m USING (key)
  UNION ALL SELECT 'singleton_category', 'medium', min(key), category FROM m GROUP BY category HAVING count(*) = 1),
labs AS (SELECT printf('v%06d', doc_id) AS key, 'Label ' || source AS label FROM documents UNION ALL SELECT printf('v%06d', doc_id), lang || ' text' FROM documents),
cand AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, label) AS rank, label, count(*) AS weight FROM labs JOIN m USING (key) GROUP BY category, label QUALIFY rank <= 12)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simgraph.similarity_graph(X.vectors(spark, sf_dir).select("key", "vector"))


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.vectors(spark, sf_dir).select("key", "category")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.read(spark, sf_dir, "documents")
    key = F.format_string("v%06d", "doc_id")
    both = docs.select(key.alias("conversation_key"), F.concat(F.lit("Label "), "source").alias("label")).unionByName(docs.select(key.alias("conversation_key"), F.concat("lang", F.lit(" text")).alias("label")))
    return both.withColumn("confidence", F.lit(0.5))


def _naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _membership(spark, sf_dir).select("category").distinct().withColumn("confidence", F.lit(0.5))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    membership = _membership(spark, sf_dir)
    return taxonomy.assignments(membership, _edges(spark, sf_dir), membership.select("key", F.lit(0.5).alias("analysis")), _naming(spark, sf_dir))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    membership, edges = _membership(spark, sf_dir), _edges(spark, sf_dir)
    return taxonomy.review_queue(membership.select("key", F.lit(0.5).alias("analysis")), edges, _assigned(spark, sf_dir), taxonomy.secondary(membership, edges), membership)


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS keys, min(len(embedding)) AS least, max(len(embedding)) AS most, count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS odd FROM embeddings")
def embedding_validation(spark, sf_dir):
    return simgraph.check_vectors(X.vectors(spark, sf_dir))


@query(_GRAPH + "SELECT node, other, round(s, 6) AS similarity FROM near WHERE node < other")
def similarity_pairs(spark, sf_dir):
    return simgraph.neighbours(X.vectors(spark, sf_dir).select("key", "vector"), 0.32, None).where("node < other")


@query(_GRAPH + "SELECT source_key, target_key, round(s, 6) AS similarity FROM edges")
def knn_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(_GRAPH + """SELECT source_key, target_key, array_to_string(coalesce(list(a.label ORDER BY lower(a.label)) FILTER (b.label IS NOT NULL), [])[1:6], '|') AS shared_signals
FROM edges LEFT JOIN labs a ON a.key = source_key LEFT JOIN labs b ON b.key = target_key AND b.label = a.label GROUP BY 1, 2""")
def shared_signals(spark, sf_dir):
    return simgraph.shared_signals(_edges(spark, sf_dir), _labels(spark, sf_dir)).select("source_key", "target_key", "shared_signals")


@query(_GRAPH + "SELECT node, count(*) AS degree, round(sum(s), 6) AS weight FROM ways GROUP BY 1")
def node_degree(spark, sf_dir):
    return simgraph.degrees(_edges(spark, sf_dir))


@query(_GRAPH + "SELECT key FROM v WHERE key NOT IN (SELECT node FROM ways)")
def isolated_nodes(spark, sf_dir):
    return simgraph.isolated(X.vectors(spark, sf_dir), _edges(spark, sf_dir))


@query(_GRAPH + "SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM v WHERE key NOT IN (SELECT node FROM ways)) AS isolated, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT category) FROM m) AS categories")
def graph_summary(spark, sf_dir):
    return taxonomy.graph_summary(X.vectors(spark, sf_dir), _edges(spark, sf_dir), _membership(spark, sf_dir))


@query()
def bucket_candidates(spark, sf_dir):
    return simgraph.bucket_candidates(X.vectors(spark, sf_dir).select("key", "vector"))


@query(_GRAPH.replace("WITH v", "WITH RECURSIVE v") + ", reach AS (SELECT key AS a, key AS b FROM v UNION SELECT reach.a, w.other FROM reach JOIN ways w ON w.node = reach.b) SELECT a AS key, min(b) AS component FROM reach GROUP BY 1")
def connected_components(spark, sf_dir):
    return simgraph.components(X.vectors(spark, sf_dir).select("key"), _edges(spark, sf_dir))


@query()
def communities(spark, sf_dir):
    return simgraph.communities(X.vectors(spark, sf_dir).select("key"), _edges(spark, sf_dir))


@query()
def consolidated_communities(spark, sf_dir):
    vectors = X.vectors(spark, sf_dir).select("key", "vector")
    return simgraph.consolidate(vectors, simgraph.communities(vectors.select("key"), _edges(spark, sf_dir)), 12)


@query(_GRAPH + """, f AS (SELECT category, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM v), a AS (SELECT category, pos, avg(x) AS x FROM f GROUP BY 1, 2)
SELECT category, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY category)), 6) AS x FROM a""")
def community_centroids(spark, sf_dir):
    return simgraph.centroids(X.vectors(spark, sf_dir).select("key", "vector"), _membership(spark, sf_dir)).select("category", F.posexplode("centroid").alias("pos", "x"))


@query(_GRAPH + "SELECT * FROM cand")
def category_labels(spark, sf_dir):
    return taxonomy.candidate_labels(_membership(spark, sf_dir), _labels(spark, sf_dir))


@query(_GRAPH + "SELECT category, row_number() OVER (PARTITION BY category ORDER BY round(coalesce(w, 0), 9) DESC, key) AS rank, key FROM m LEFT JOIN (SELECT node AS key, sum(s) AS w FROM ways GROUP BY 1) USING (key) QUALIFY rank <= 8")
def category_representatives(spark, sf_dir):
    return taxonomy.representatives(_membership(spark, sf_dir), _edges(spark, sf_dir))


@query(_GRAPH + """, dates AS (SELECT printf('v%06d', doc_id) AS key, make_timestamp((1746266400 + (doc_id * 7919 % 500) * 86400) * 1000000) AS moment FROM documents WHERE doc_id % 17 <> 0)
SELECT category, count(*) AS size, strftime(min(moment), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(moment), '%Y-%m-%d %H:%M:%S') AS latest, coalesce((SELECT string_agg(label, '|' ORDER BY rank) FROM cand WHERE cand.category = m.category), '') AS labels FROM m LEFT JOIN dates USING (key) GROUP BY category""")
def category_drafts(spark, sf_dir):
    dates = X.read(spark, sf_dir, "documents").where("doc_id % 17 <> 0").select(F.format_string("v%06d", "doc_id").alias("key"), F.timestamp_seconds(F.lit(1746266400) + (F.col("doc_id") * 7919 % 500) * 86400).alias("at"))
    return taxonomy.drafts(_membership(spark, sf_dir), _labels(spark, sf_dir), _edges(spark, sf_dir), dates).drop("representatives")


@query(_GRAPH + "SELECT * FROM (SELECT a.category, row_number() OVER (PARTITION BY a.category ORDER BY count(*) DESC, b.category) AS rank, b.category AS other, count(*) AS overlap FROM cand a JOIN cand b ON lower(a.label) = lower(b.label) AND a.category <> b.category GROUP BY a.category, b.category) WHERE rank <= 3")
def related_categories(spark, sf_dir):
    drafts = taxonomy.candidate_labels(_membership(spark, sf_dir), _labels(spark, sf_dir)).groupBy("category").agg(F.collect_list("label").alias("labels"))
    return taxonomy.related(drafts)


@query()
def taxonomy_names(spark, sf_dir):
    drafts = taxonomy.candidate_labels(_membership(spark, sf_dir), _labels(spark, sf_dir)).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("labels"))
    return taxonomy.interpret(drafts)


@query(_GRAPH + "SELECT key, category, round(structural, 6) AS structural, round(confidence, 6) AS confidence FROM assigned")
def assignment_confidence(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query(_GRAPH + "SELECT key, rank, other, round(score, 6) AS score FROM second")
def secondary_categories(spark, sf_dir):
    return taxonomy.secondary(_membership(spark, sf_dir), _edges(spark, sf_dir))


@query("""WITH m AS (SELECT printf('category-%04d', label + 1) AS category, CASE label % 3 WHEN 0 THEN 'Big  Domain' WHEN 1 THEN 'big domain' ELSE 'Other' END AS p FROM embeddings),
c AS (SELECT category, regexp_replace(any_value(p), '\\s+', ' ', 'g') AS p, count(*) AS n FROM m GROUP BY 1)
SELECT 'domain-' || substr(sha256(lower(p)), 1, 12) AS parent_id, arg_min(p, category) AS name, string_agg(category, '|' ORDER BY category) AS children, sum(n)::BIGINT AS size, 0.5::DOUBLE AS confidence FROM c GROUP BY lower(p)""")
def parent_domains(spark, sf_dir):
    k = F.substring("category", -4, 4).cast("int") - 1
    naming = _naming(spark, sf_dir).withColumn("parent_name", F.when(k % 3 == 0, "Big  Domain").when(k % 3 == 1, "big domain").otherwise("Other"))
    return taxonomy.parents(_membership(spark, sf_dir), naming)


@query(_GRAPH + "SELECT * FROM queue")
def review_queue(spark, sf_dir):
    return _queue(spark, sf_dir)


@query(_GRAPH + "SELECT 'code' AS kind, code AS value, count(*) AS n FROM queue GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM queue GROUP BY 2")
def review_queue_counts(spark, sf_dir):
    return taxonomy.review_counts(_queue(spark, sf_dir))


_EVENTS = "WITH e AS (SELECT 'project-' || user_id AS project, ts::TIMESTAMP AS moment, event_type AS kind, value FROM events) "


@query(_EVENTS + """, p AS (SELECT project, moment, row_number() OVER (PARTITION BY project ORDER BY moment) - 1 AS place, count(*) OVER (PARTITION BY project) AS n FROM e)
SELECT project, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, place FROM p WHERE n <= 12 OR list_contains([round_even(i * (n - 1) / 11.0, 0)::BIGINT FOR i IN range(12)], place)""")
def timeline_sampling(spark, sf_dir):
    return longitudinal.evenly_spaced(X.projects(spark, sf_dir).select("project", "at"), "project", [F.col("at")]).select("project", F.col("at").alias("moment"), "place")


@query(_EVENTS + "SELECT project FROM (SELECT project, moment - lag(moment) OVER (PARTITION BY project ORDER BY moment) AS gap FROM e) GROUP BY 1 HAVING max(gap) >= INTERVAL 40 HOUR")
def dormant_projects(spark, sf_dir):
    return longitudinal.dormant(X.projects(spark, sf_dir), "40 hours")


_PAIRS = "WITH q AS (SELECT user_id, {'l': event_type, 'r': lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type)} AS x FROM events) "


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the one after it: whole sequences, however long, without an array of them."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_type"))
    return X.read(spark, sf_dir, "events").select(F.col("user_id").alias("position"), F.array("event_type", after).alias("projects"))


@query("""SELECT printf('v%06d', vec_id) AS key, array_to_string([x.i FOR x IN list_sort([{'a': -abs(embedding[i]::DOUBLE), 'i': i - 1} FOR i IN range(1, len(embedding) + 1)])][1:8], '|') AS dimensions FROM embeddings""")
def top_dimensions(spark, sf_dir):
    return X.vectors(spark, sf_dir).select("key", simgraph.top_dimensions(F.col("vector"), 8).alias("dimensions"))


@query("""WITH d AS (SELECT source AS category, printf('v%06d', doc_id) AS key, doc_id, lang FROM documents),
c AS (SELECT category, key, 1 AS pos, 'chose ' || doc_id AS v FROM d UNION ALL SELECT category, key, 2, 'speaks ' || lang FROM d),
u AS (SELECT category, key, 1 AS pos, 'open ' || doc_id AS v FROM d WHERE doc_id % 3 = 0),
s AS (SELECT category, key, 1 AS pos, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'about ' || doc_id END AS v FROM d),
k AS (SELECT category, key, 1 AS pos, key AS v FROM d),
x AS (SELECT 'c' AS part, 8 AS most, * FROM c UNION ALL SELECT 'u', 8, * FROM u UNION ALL SELECT 's', 3, * FROM s UNION ALL SELECT 'k', 5, * FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY part, category ORDER BY key, pos) AS r FROM x QUALIFY r <= most)
SELECT category, coalesce(string_agg(v, '|' ORDER BY r) FILTER (part = 'c'), '') AS major_conclusions, coalesce(string_agg(v, '|' ORDER BY r) FILTER (part = 'u'), '') AS unresolved_threads,
  coalesce(string_agg(v, '|' ORDER BY r) FILTER (part = 's' AND v <> ''), '') AS characteristic_questions, string_agg(v, '|' ORDER BY r) FILTER (part = 'k') AS representative_keys FROM r GROUP BY 1""")
def category_profiles(spark, sf_dir):
    d, key = F.col("doc_id"), F.format_string("v%06d", "doc_id")
    docs = X.read(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    profiles = docs.select(key.alias("conversation_key"), F.array(F.concat(F.lit("chose "), d), F.concat(F.lit("speaks "), "lang")).alias("decisions"), F.when(d % 3 == 0, F.array(F.concat(F.lit("open "), d))).otherwise(none).alias("unresolved_questions"), F.when(d % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("about "), d)).alias("synopsis"))
    return longitudinal.category_profiles(docs.select(F.col("source").alias("category"), key.alias("key")), profiles)


@query(_PAIRS + "SELECT x.l AS left, x.r AS right, min(user_id) AS first FROM q WHERE x.l <> x.r GROUP BY ALL")
def project_pairs(spark, sf_dir):
    return longitudinal.project_pairs(_sequences(spark, sf_dir))


@query(_PAIRS + "SELECT x.l || ' connects with ' || x.r AS value, min(user_id) AS first FROM q WHERE x.l <> x.r GROUP BY 1 ORDER BY first, value LIMIT 12")
def ordered_distinct_topk(spark, sf_dir):
    pairs = longitudinal.project_pairs(_sequences(spark, sf_dir)).select(F.concat("left", F.lit(" connects with "), "right").alias("v"), "first")
    return longitudinal.first_seen(pairs, "v", ["first", "v"], 12).select("value", F.col("first.first").alias("first"))


@query("SELECT kind AS value, n FROM (SELECT event_type AS kind, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1) ORDER BY n DESC, f LIMIT 3")
def most_common_themes(spark, sf_dir):
    return longitudinal.most_common(X.read(spark, sf_dir, "events"), "event_type", ["event_id"], 3)


@query(_EVENTS + """, d AS (SELECT project, arg_max(kind, moment) AS state, count(*) AS n FROM e GROUP BY 1) SELECT project, state FROM d WHERE n >= 3""")
def project_current_state(spark, sf_dir):
    members = X.projects(spark, sf_dir).withColumn("key", F.date_format("at", "yyyyMMddHHmmssSSSSSS"))
    return longitudinal.current_state(members, "kind")


@query("""WITH c AS (SELECT source AS category, printf('v%06d', doc_id) AS key, CASE WHEN doc_id % 17 <> 0 THEN doc_id * 7919 % 500 END AS moment, CASE WHEN n_chars > 1500 THEN row_number() OVER (PARTITION BY source, n_chars > 1500 ORDER BY n_chars DESC, doc_id) END AS central FROM documents),
d AS (SELECT category, key, CASE WHEN central <= 8 THEN central END AS central, row_number() OVER (PARTITION BY category ORDER BY moment NULLS LAST, key) AS early, count(*) OVER (PARTITION BY category) AS n FROM c),
o AS (SELECT category, key, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN central = 1 THEN 0 WHEN early = 1 THEN 1 WHEN early = n THEN 2 WHEN central IS NOT NULL THEN 2 + central ELSE 1000 + early END) AS rank FROM d)
SELECT category, rank, key FROM o WHERE rank <= 3 ORDER BY rank, category LIMIT 40""")
def refinement_selection(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    long = F.col("n_chars") > 1500
    place = F.row_number().over(Window.partitionBy("source", long).orderBy(F.desc("n_chars"), "doc_id"))
    rows = docs.withColumn("_p", F.when(long, place)).select(F.col("source").alias("category"), F.format_string("v%06d", "doc_id").alias("key"), F.when(F.col("_p") <= 8, F.col("_p")).alias("central"), F.when(F.col("doc_id") % 17 != 0, F.col("doc_id") * 7919 % 500).alias("at"))
    return longitudinal.refinement(rows, 3, 40)


@query("SELECT source, rank, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 12 ORDER BY rank, source LIMIT 90")
def feature_budget_round_robin(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    rows = X.read(spark, sf_dir, "documents").withColumn("rank", rank).where("rank <= 12")
    return longitudinal.round_robin(rows, "source", "rank", 90).select("source", "rank", "doc_id")


@query("""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS period, event_type AS v FROM events), top AS (SELECT v FROM e GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 8)
SELECT p.period, top.v AS value, (SELECT count(*) FROM e WHERE e.period = p.period AND e.v = top.v) AS n FROM (SELECT DISTINCT period FROM e) p, top""")
def period_theme_pivot(spark, sf_dir):
    return figures.period_pivot(X.projects(spark, sf_dir), F.date_format("at", "yyyy-MM-dd"), "kind")


@query("WITH s AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS left, b.event_type AS right, count(*) AS n FROM s a JOIN s b USING (user_id) GROUP BY ALL")
def cooccurrence_matrix(spark, sf_dir):
    return figures.cooccurrence(X.read(spark, sf_dir, "events"), "user_id", "event_type")


@query(_GRAPH + "SELECT a.category AS project, source_key, target_key, round(s, 6) AS similarity FROM edges JOIN m a ON a.key = source_key JOIN m b ON b.key = target_key WHERE a.category = b.category")
def project_lanes(spark, sf_dir):
    return figures.lane_edges(_edges(spark, sf_dir), _membership(spark, sf_dir).withColumnRenamed("category", "project"))


@query("SELECT source, 'Project ' || CASE WHEN n <= 26 THEN chr((64 + n)::INTEGER) ELSE n::VARCHAR END AS alias FROM (SELECT source, row_number() OVER (ORDER BY source) AS n FROM (SELECT DISTINCT source FROM documents))")
def anonymous_aliases(spark, sf_dir):
    return figures.aliases(X.read(spark, sf_dir, "documents").select("source").distinct(), "source")


_TRUTH = """WITH t AS (SELECT 'lang-' || lang AS truth, doc_id FROM documents), i AS (SELECT 'source-' || source AS inferred, doc_id FROM documents),
nt AS (SELECT truth, count(*) AS a FROM t GROUP BY 1), ni AS (SELECT inferred, count(*) AS b FROM i GROUP BY 1),
o AS (SELECT truth, inferred, n::DOUBLE / (a + b - n) AS overlap FROM (SELECT truth, inferred, count(*) AS n FROM t JOIN i USING (doc_id) GROUP BY ALL) JOIN nt USING (truth) JOIN ni USING (inferred)) """


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.read(spark, sf_dir, "documents")
    return evaluate.jaccard(docs.select(F.concat(F.lit("lang-"), "lang").alias("name"), F.col("doc_id").alias("member")), docs.select(F.concat(F.lit("source-"), "source").alias("name"), F.col("doc_id").alias("member")))


@query(_TRUTH + "SELECT truth, inferred, round(overlap, 6) AS overlap FROM o")
def jaccard_matching(spark, sf_dir):
    return _overlaps(spark, sf_dir)


@query(_TRUTH + "SELECT truth, inferred, round(overlap, 6) AS overlap, overlap >= 0.2 AS matched FROM o QUALIFY row_number() OVER (PARTITION BY truth ORDER BY overlap DESC, inferred) = 1")
def best_project_matches(spark, sf_dir):
    return evaluate.best_matches(_overlaps(spark, sf_dir))


_CACHE = "WITH w AS (SELECT doc_id AS key, sha256('local' || chr(0) || text) AS cache_key FROM documents), c AS (SELECT doc_id AS key, sha256('local' || chr(0) || CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE text END) AS cache_key, doc_id % 7 AS seq FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, sha256('local' || chr(0) || text), 9 FROM documents WHERE doc_id % 4 = 1) "


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = X.read(spark, sf_dir, "documents")
    key = lambda text: cost.cache_key(F.lit("local"), text)
    wanted = docs.select(F.col("doc_id").alias("key"), key(F.col("text")).alias("cache_key"))
    old = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("key"), key(F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("text"))).alias("cache_key"), (F.col("doc_id") % 7).alias("seq"))
    new = docs.where("doc_id % 4 = 1").select(F.col("doc_id").alias("key"), key(F.col("text")).alias("cache_key"), F.lit(9).cast("long").alias("seq"))
    return wanted, old.unionByName(new)


@query(_CACHE + "SELECT key, cache_key FROM w ANTI JOIN c USING (key, cache_key)")
def cache_missing(spark, sf_dir):
    return cost.missing(*_cache(spark, sf_dir))


@query(_CACHE + "SELECT key, cache_key, max(seq) AS seq FROM c SEMI JOIN w USING (key, cache_key) GROUP BY ALL")
def cache_hits(spark, sf_dir):
    return cost.cached(*_cache(spark, sf_dir))


@query("""WITH e AS (SELECT count(*) AS items, ((sum(length(text)) + 3) // 4)::BIGINT AS approximate_tokens FROM documents),
p AS (SELECT items, approximate_tokens, ceil(items / 8.0)::BIGINT AS requests, items * 512 AS output_tokens, ceil(approximate_tokens * 1.2::DOUBLE)::BIGINT + 512 * ceil(items / 8.0)::BIGINT AS reserved_tokens FROM e)
SELECT *, round(approximate_tokens * 0.02::DOUBLE / 1e6, 6) AS embedding_cost, round(approximate_tokens * 0.27::DOUBLE / 1e6 + output_tokens * 2.0::DOUBLE / 1e6, 6) AS expected_cost, round(approximate_tokens * 0.02::DOUBLE / 1e6 + reserved_tokens * 0.25::DOUBLE / 1e6 + output_tokens * 2.0::DOUBLE / 1e6, 6) AS reserved_cost FROM p""")
def cost_plan(spark, sf_dir):
    estimate = X.read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("items"), T.approximate_tokens(F.sum(F.length("text"))).alias("approximate_tokens"))
    return cost.plan(estimate, Decimal("0.02"), Decimal("0.25"), Decimal("2.0"))


@query("""WITH l AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'reserved' ELSE 'failed' END AS state, round(o_totalprice, 2)::DECIMAL(18, 2) AS reserved, round(o_totalprice, 2)::DECIMAL(18, 2) - 1 AS settled FROM orders),
s AS (SELECT sum(CASE WHEN state = 'completed' THEN settled ELSE reserved END)::DECIMAL(38, 2) AS charged, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state <> 'completed') AS unsettled FROM l)
SELECT round(charged::DOUBLE, 6) AS charged, completed, unsettled, round(greatest(0, 1000000000000 - charged)::DOUBLE, 6) AS remaining FROM s""")
def ledger_snapshot(spark, sf_dir):
    orders = X.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    money = lambda c: F.round(c, 2).cast("decimal(18,2)").cast(cost.MONEY)
    entries = orders.select(F.when(k == 0, "completed").when(k == 1, "reserved").otherwise("failed").alias("state"), money(F.col("o_totalprice")).alias("reserved"), (money(F.col("o_totalprice")) - 1).cast(cost.MONEY).alias("settled"))
    return cost.ledger_snapshot(entries, Decimal(10**12))


@query("""WITH RECURSIVE i AS (SELECT doc_id AS position, ((length(text) + 2) // 3)::BIGINT AS tokens, row_number() OVER (ORDER BY doc_id) AS place FROM documents),
b AS (SELECT place, position, tokens, 0::BIGINT AS batch, 1::BIGINT AS n, tokens AS t FROM i WHERE place = 1
  UNION ALL SELECT i.place, i.position, i.tokens, CASE WHEN b.n >= 64 OR b.t + i.tokens > 20000 THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.n >= 64 OR b.t + i.tokens > 20000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 64 OR b.t + i.tokens > 20000 THEN i.tokens ELSE b.t + i.tokens END
  FROM b JOIN i ON i.place = b.place + 1)
SELECT position, tokens, batch FROM b""")
def request_batches(spark, sf_dir):
    items = X.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), T.approximate_tokens(F.length("text"), 3).alias("tokens"))
    return cost.request_batches(items, 64, 20_000)


@query(_GRAPH + "SELECT doc_id, printf('v%06d', doc_id) AS key, category, round(confidence, 6) AS confidence, n_chars FROM documents LEFT JOIN assigned ON key = printf('v%06d', doc_id)")
def catalog(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents").select("doc_id", F.format_string("v%06d", "doc_id").alias("key"), "n_chars")
    return docs.join(_assigned(spark, sf_dir).select("key", "category", "confidence"), "key", "left")


_BOOK = """WITH RECURSIVE cats AS (SELECT DISTINCT source AS category, CASE WHEN source = 'src0' THEN NULL WHEN substr(source, 4)::INTEGER < 5 THEN 'src0' ELSE 'src' || (substr(source, 4)::INTEGER // 5) END AS parent, upper(source) AS name FROM documents),
tree AS (SELECT category, category AS above FROM cats UNION ALL SELECT t.category, c.parent FROM tree t JOIN cats c ON c.category = t.above WHERE c.parent IS NOT NULL) """


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int")
    parent = F.when(n == 0, None).when(n < 5, F.lit("src0")).otherwise(F.concat(F.lit("src"), F.floor(n / 5).cast("string")))
    return X.read(spark, sf_dir, "documents").select("source").distinct().select(F.col("source").alias("category"), parent.alias("parent"), F.upper("source").alias("name"))


@query(_BOOK + "SELECT above AS category, count(DISTINCT doc_id) AS n FROM tree JOIN documents ON source = tree.category GROUP BY 1")
def subtree_counts(spark, sf_dir):
    placed = X.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("category"))
    return book.subtree_counts(_categories(spark, sf_dir), placed)


@query(_BOOK + ", depths AS (SELECT category, count(*) - 1 AS depth FROM tree GROUP BY 1) SELECT category, depth FROM depths")
def category_depths(spark, sf_dir):
    return book.preorder(_categories(spark, sf_dir)).select("category", "depth")


@query("""SELECT source AS category, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 10 = 3 THEN doc_id END NULLS LAST, coalesce(CASE WHEN doc_id % 4 <> 0 THEN n_chars % 100 / 100.0::DOUBLE END, -1) DESC, CASE WHEN doc_id % 17 <> 0 THEN doc_id * 7919 % 500 END NULLS LAST, doc_id) AS rank, doc_id AS key FROM documents QUALIFY rank <= 12""")
def featured_entries(spark, sf_dir):
    d = F.col("doc_id")
    rows = X.read(spark, sf_dir, "documents").select(F.col("source").alias("category"), d.alias("key"), F.when(d % 10 == 3, d).alias("rep"), F.when(d % 4 != 0, F.col("n_chars") % 100 / 100.0).alias("confidence"), F.when(d % 17 != 0, d * 7919 % 500).alias("at"))
    return book.featured(rows)


@query(_GRAPH + """, decl AS (SELECT key, 'v000000' AS other, 0.5::DOUBLE AS s FROM v WHERE key LIKE '%7'), al AS (SELECT * FROM ways UNION ALL SELECT * FROM decl)
SELECT node AS key, row_number() OVER (PARTITION BY node ORDER BY max(s) DESC, other) AS rank, other, round(max(s), 6) AS similarity FROM al WHERE node <> other GROUP BY node, other QUALIFY rank <= 8""")
def related_conversations(spark, sf_dir):
    declared = X.vectors(spark, sf_dir).where("key like '%7'").select("key", F.lit("v000000").alias("other"), F.lit(0.5).alias("similarity"))
    return book.symmetric_relations(_edges(spark, sf_dir), declared)


@query("""SELECT 'k' || doc_id AS key, doc_id % 3 > 0 AS entry, CASE WHEN doc_id % 3 = 1 THEN source WHEN doc_id % 3 = 2 THEN lang WHEN doc_id % 4 = 0 THEN source ELSE '__unclassified__' END AS category FROM documents""")
def placements(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    d = F.col("doc_id")
    key, own = F.concat(F.lit("k"), d.cast("string")), F.concat(F.lit("id-"), d.cast("string"))
    none = F.array().cast("array<string>")
    catalog = docs.where("doc_id % 3 > 0").select(F.when(d % 3 == 1, key).otherwise(own).alias("entry"), F.when(d % 3 == 1, F.col("source")).otherwise(F.lit("gone")).alias("primary"), F.when(d % 3 == 1, none).otherwise(F.array("lang")).alias("others"))
    membership = docs.where("doc_id % 4 = 0").select(key.alias("key"), F.col("source").alias("category"))
    categories = docs.select(F.col("source").alias("category")).union(docs.select("lang")).distinct()
    return book.placements(docs.select(key.alias("key"), own.alias("conversation_id")), catalog, membership, categories)


@query("SELECT lang AS category, coalesce(min_by, 'No profile.') AS overview FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN (SELECT lang, arg_min(substr(text, 1, 20), doc_id) AS min_by FROM documents WHERE lang <> 'fr' GROUP BY 1) USING (lang)")
def reconciled_profiles(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    received = docs.where("lang <> 'fr'").select(F.col("lang").alias("category"), F.col("doc_id").alias("seq"), F.substring("text", 1, 20).alias("overview"))
    return book.reconcile(docs.select(F.col("lang").alias("category")).distinct(), received.unionByName(received.withColumn("category", F.lit("unknown"))), "No profile.")


@query("SELECT doc_id, greatest(8, least(22, 7 + doc_id % 13 + n_chars % 9)) AS size FROM documents")
def marker_sizes(spark, sf_dir):
    return X.read(spark, sf_dir, "documents").select("doc_id", figures.marker_size(F.col("doc_id") % 13, F.col("n_chars") % 9).alias("size"))


@query(_PROFILES + """, named AS (SELECT conversation_key AS key, position, unnest(projects) AS v, generate_subscripts(projects, 1) AS pos FROM profile),
member AS (SELECT v AS project, moment FROM named JOIN items USING (key)),
heard AS (
  SELECT 'cross_domain_connections' AS section, projects[1] || ' connects with ' || projects[2] || ' through shared evidence in ' || primary_subject || '.' AS value, position, 1 AS pos FROM profile WHERE len(projects) > 1 AND projects[1] <> projects[2]
  UNION ALL SELECT 'recurring_projects', v, position, pos FROM named WHERE v IN (SELECT project FROM member GROUP BY 1 HAVING count(*) >= 3)
  UNION ALL SELECT 'tensions_and_reversals', unnest(d), position, generate_subscripts(d, 1) FROM (SELECT position, CASE WHEN len(decisions) > 0 THEN decisions ELSE [synopsis] END AS d FROM profile WHERE temporal_role = 'reversal or reframing')
  UNION ALL SELECT 'opportunities', unnest(unresolved_questions), position, generate_subscripts(unresolved_questions, 1) FROM profile),
firsts AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY min(position * 100 + pos)) AS rank, value FROM heard GROUP BY section, value),
themes AS (SELECT v, count(*) AS n, min(position * 100 + pos) AS f FROM (SELECT position, unnest(recurring_themes) AS v, generate_subscripts(recurring_themes, 1) AS pos FROM profile) GROUP BY 1),
silent AS (SELECT project FROM (SELECT project, moment - lag(moment) OVER (PARTITION BY project ORDER BY moment) AS gap FROM member WHERE moment IS NOT NULL) GROUP BY 1 HAVING max(gap) >= INTERVAL 75 DAY)
SELECT section, rank, value FROM firsts WHERE rank <= CASE section WHEN 'recurring_projects' THEN 6 ELSE 12 END
UNION ALL SELECT 'recurring_themes', row_number() OVER (ORDER BY n DESC, f) AS rank, v FROM themes QUALIFY rank <= 6
UNION ALL SELECT 'temporal_evolution', row_number() OVER (ORDER BY profile.position) AS rank, title || ': ' || temporal_role || '.' FROM profile JOIN items ON key = conversation_key WHERE temporal_role IS NOT NULL QUALIFY rank <= 12
UNION ALL SELECT 'dormant_threads', row_number() OVER (ORDER BY project) AS rank, project || ' contains a dormant interval followed by renewed activity.' FROM silent QUALIFY rank <= 12""")
def archive_synthesis(spark, sf_dir):
    items = X.items(spark, sf_dir)
    made = settled(profiles.profiles(items))
    members = longitudinal.project_members(made).join(items.select("conversation_key", stats.date_of().alias("at")), "conversation_key").select("project", F.col("conversation_key").alias("key"), "at")
    return longitudinal.synthesis(made, members, items.select(F.col("conversation_key").alias("key"), "title"))


# Extensions: inventories that an archive's owner asks for.


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_hosts(spark, sf_dir):
    return X.read(spark, sf_dir, "pages").groupBy(F.try_parse_url("url", F.lit("HOST")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS characters FROM conversations GROUP BY 1 ORDER BY characters DESC, conv_id LIMIT 20")
def longest_conversations(spark, sf_dir):
    """A report of the top twenty, which is the feature."""
    rows = X.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("characters"))
    return rows.orderBy(F.desc("characters"), "conv_id").limit(20)


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, 'https?://[^ \t\n]+')) AS urls, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM documents""")
def detector_counts(spark, sf_dir):
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return X.read(spark, sf_dir, "documents").select("doc_id", count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"), count(r"https?://[^ \t\n]+").alias("urls"), count(r"[^\x20\x09-\x0D]+").alias("words"))


@query("""WITH c AS (SELECT DISTINCT source AS category, CASE WHEN source < 'src15' THEN NULL ELSE 'own ' || source END AS overview FROM documents), p AS (SELECT source AS category, min(lang) || ' profile' AS overview FROM documents GROUP BY 1)
SELECT category, coalesce(c.overview, p.overview) AS overview FROM c LEFT JOIN p USING (category)""")
def merged_category_profiles(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    categories = docs.select(F.col("source").alias("category")).distinct().withColumn("overview", F.when(F.col("category") >= "src15", F.concat(F.lit("own "), "category")))
    found = docs.groupBy(F.col("source").alias("category")).agg(F.concat(F.min("lang"), F.lit(" profile")).alias("overview"))
    return book.merged_profiles(categories, found, ["overview"])


@query("""WITH r AS (SELECT source, doc_id, n_chars % 100 AS confidence, doc_id * 7919 % 500 AS moment FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, doc_id) AS sure, row_number() OVER (PARTITION BY source ORDER BY moment, doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM r),
o AS (SELECT *, CASE WHEN sure <= 2 THEN 0 WHEN list_contains([round_even(i * (n - 1) / 5.0, 0)::BIGINT FOR i IN range(6)], place) THEN 1 ELSE 2 END AS o FROM k)
SELECT source, doc_id FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY o, CASE WHEN o = 2 THEN -place ELSE place END) <= 6""")
def stratified_profiles(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("key"), (F.col("n_chars") % 100).alias("confidence"), (F.col("doc_id") * 7919 % 500).alias("at"))
    return longitudinal.stratified(docs, "source", 6).select("source", F.col("key").alias("doc_id"))
