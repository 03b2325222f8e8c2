"""Queries over search, vectors, linking, the graph and imports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import scope, text
from lodestrata.operators import graph, ingest, lexical, linker, merge, profile, skills, vectors
from lodestrata.operators.lexical import Request
from lodestrata.plans import sql
from lodestrata.plans.registry import SQL, Q, query
from lodestrata.sources import views
from lodestrata.streaming import audit

ANY, ALL, PHRASE = "thatin orantion hehely", "the thing", "eriner_thanea"
AS_OF = "2026-06-01T00:00:00Z"
REQUESTS = {
    "q10_rrf_fusion": Request("thing the orantion", limit=40, per_document_limit=None),
    "q11_scope_merge": Request("thing the orantion", workspaces=("src3",), limit=40, per_document_limit=None),
    "q12_session_strict": Request("thing the", session_id="s2", session_scope="strict", limit=30, per_document_limit=None),
    "q13_repo_scope": Request("de la que", repo_id="fr", session_id="s1", limit=30),
    "q14_doc_quota": Request("thing the orantion", limit=30, per_document_limit=1),
    "q15_page_boost_off": Request("thing the orantion", limit=30, page_boost=0.0),
}
TERMS = "Supplier#00000001 nation asia"
MANY = ["doc:7:p1", "doc:3:p1", "doc:nowhere", "doc:3:p1", "doc:14:p2", "doc:1:p1"]

@query(f"with {sql.UNITS} select id, summary, md5(resolution) as text_md5, evidence_json, status, memory_kind, session_id, workspace_id, repo_id, updated_at from units")
def q01_units_view(spark: SparkSession, d: str) -> DataFrame:
    return views.units(spark, d).select("id", "summary", F.md5("resolution").alias("text_md5"), "evidence_json", "status", "memory_kind", "session_id", "workspace_id", "repo_id", "updated_at")


@query(f"""with {sql.UNITS} select count(*) as total, count(*) filter (where status = 'active' and memory_kind = 'memory') as active, count(*) filter (where {sql.SEARCHABLE}) as searchable,
count(*) filter (where memory_kind = 'candidate') as candidate, count(*) filter (where memory_kind = 'raw') as raw, count(*) filter (where context_json ilike '%"imported_from": "continuity"%') as continuity from units""")
def q02_store_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.store_stats(views.units(spark, d))


@query(f"with {sql.UNITS}, v as (select case when trim(workspace_id) = '' then '(empty)' else workspace_id end as value, status from units) select value, count(*) as n from v group by value union all select status, count(*) from v group by status")
def q03_status_distribution(spark: SparkSession, d: str) -> DataFrame:
    units = views.units(spark, d)
    return profile.distribution(units, "workspace_id").unionByName(profile.distribution(units, "status"))


@query(f"with {sql.UNITS} select count(*) filter (where json_array_length(evidence_json) > 0) as evidence_json, count(*) filter (where trim(workspace_id) <> '') as workspace_id, count(*) filter (where trim(repo_id) <> '') as repo_id from units")
def q04_coverage(spark: SparkSession, d: str) -> DataFrame:
    return profile.coverage(views.units(spark, d), ["evidence_json"], ["workspace_id", "repo_id"])


NAMED = ("id", "repo_id", "resolution", "session_id", "summary", "type", "workspace_id")


@query(f"with {sql.UNITS} select id, sha256('{{' || " + " || ', ' || ".join(f"'\"{c}\": ' || to_json({c})" for c in NAMED) + " || '}') as fingerprint from units")
def q05_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return views.units(spark, d).select("id", text.fingerprint({c: F.col(c) for c in NAMED}).alias("fingerprint"))


@query(f"with {sql.UNITS} select distinct workspace_id, case when workspace_id = '' then '' else left(sha256(workspace_id), 20) end as digest from units")
def q06_workspace_digest(spark: SparkSession, d: str) -> DataFrame:
    return views.units(spark, d).select("workspace_id").distinct().select("workspace_id", F.when(F.col("workspace_id") == "", "").otherwise(scope.digest_of(F.col("workspace_id"))).alias("digest"))


def bm25_top(spark: SparkSession, d: str, words: str, every: bool = False) -> DataFrame:
    found = lexical.scored(views.unit_index(spark, d), "text", [text.query_tokens(t) for t in text.terms(words)])
    found = found.where(F.forall("found", lambda n: n > 0)) if every else found
    return found.orderBy(F.round("bm25", lexical.PLACES), F.desc("updated_at"), "id").limit(lexical.CHANNEL_CAP).select("id", F.round("bm25", 6).alias("bm25"))


@query(sql.bm25(ANY))
def q07_bm25_any(spark: SparkSession, d: str) -> DataFrame:
    return bm25_top(spark, d, ANY)


@query(sql.bm25(ALL, every=True))
def q08_bm25_all(spark: SparkSession, d: str) -> DataFrame:
    return bm25_top(spark, d, ALL, every=True)


@query(sql.bm25(PHRASE))
def q09_bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return bm25_top(spark, d, PHRASE)


def _searching(name: str, request: Request) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return lexical.search(views.unit_index(spark, d), request).select("pos", "id", "score", "scope")

    Q[name], SQL[name] = run, sql.search(request)


for _name, _request in REQUESTS.items():
    _searching(_name, _request)


@query(f"with {sql.UNITS}, asked as (select unnest({sql._list(MANY)}) as id, unnest(range({len(MANY)})) as pos) select pos, id, md5(resolution) as text_md5 from asked join units using (id) where {sql.SEARCHABLE}")
def q16_get_many(spark: SparkSession, d: str) -> DataFrame:
    return lexical.get_many(views.units(spark, d), MANY, searchable_only=True).select(F.col("pos").cast("long").alias("pos"), "id", F.md5("resolution").alias("text_md5"))


COSINE = "round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9)"
TOP = f"""vv as (select vec_id, 'doc:' || vec_id || ':p1' as source_id, embedding, label from embeddings),
sc as (select q.vec_id as query_id, v.source_id, {COSINE} as score from vv q join vv v on q.vec_id % 100 = 0 and v.label <> 9),
tp as (select *, row_number() over (partition by query_id order by score desc, source_id) as rank from sc where score > 0 qualify rank <= 10)"""


@query(f"with {TOP} select query_id, source_id, round(score, 6) as score, cast(rank as integer) as rank from tp")
def q17_semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest knowledge vectors of every vector whose id is divisible by 100."""
    rows = views.vectors(spark, d)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_each(rows.where("source_kind = 'knowledge'"), asked, 10).select("query_id", "source_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {sql.UNITS}, {TOP}, h as (select tp.*, u.id is not null as found from tp left join units u on u.id = tp.source_id and {sql.SEARCHABLE} where score >= 0.35) select query_id, count(*) as hits, count(*) filter (where not found) as suppressed from h group by query_id")
def q18_semantic_suppressed(spark: SparkSession, d: str) -> DataFrame:
    rows = views.vectors(spark, d)
    hits = vectors.top_each(rows.where("source_kind = 'knowledge'"), rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    return vectors.resolved(hits, views.units(spark, d)).groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(~F.col("found")).alias("suppressed"))


@query("select count(*) as vectors, cast(coalesce(max(len(embedding)), 0) as integer) as dimensions from embeddings")
def q19_vector_stats(spark: SparkSession, d: str) -> DataFrame:
    return vectors.stats(views.vectors(spark, d))


@query(f"with {sql.gazetteer(tags=True)} select alias, entity_id, display, source, weight from gaz")
def q20_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    return linker.gazetteer(views.entities(spark), include_tags=True).select("alias", "entity_id", "display", "source", "weight")


@query(f"with {sql.gazetteer(tags=True)} select alias, array_to_string(entities, ',') as entities from gaz where len(entities) > 1")
def q21_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return linker.gazetteer(views.entities(spark), include_tags=True).where(F.size("entities") > 1).select("alias", F.array_join("entities", ",").alias("entities"))


@query(f"with {sql.UNITS}, {sql.gazetteer()}, {sql.CHUNKS}, cm as (select alias, count(*) as n from ch join gaz on contains(h, alias) where h <> '' group by alias) select alias, entity_id from gaz where alias not in (select alias from cm where n > greatest(2.0, 0.05 * (select count(*) from ch where h <> '')))")
def q22_alias_df_prune(spark: SparkSession, d: str) -> DataFrame:
    return linker.pruned(linker.gazetteer(views.entities(spark)), views.chunk_texts(spark, d), 0.05).select("alias", "entity_id")


@query(f"with {sql.mentions()} select id, st as start, cast(en as integer) as \"end\", alias, entity_id from ac")
def q23_spans(spark: SparkSession, d: str) -> DataFrame:
    return linker.accepted(linker.spans(views.chunk_texts(spark, d), linker.gazetteer(views.entities(spark)))).select("id", "start", "end", "alias", "entity_id")


def found_mentions(spark: SparkSession, d: str) -> DataFrame:
    return linker.mentions(views.chunk_texts(spark, d), linker.gazetteer(views.entities(spark)))


def rolled(spark: SparkSession, d: str) -> DataFrame:
    return linker.rollup(found_mentions(spark, d), views.chunk_texts(spark, d).drop("text"))


@query(f"with {sql.mentions()} select id, entity_id, alias, source, occurrences, confidence, position from mn")
def q24_mentions(spark: SparkSession, d: str) -> DataFrame:
    return found_mentions(spark, d).select("id", "entity_id", "alias", "source", "occurrences", "confidence", "position")


@query(f"with {sql.mentions()} select document_id, entity_id, alias, occurrences, chunks, confidence, array_to_string(evidence, ',') as evidence from ru")
def q25_document_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rolled(spark, d).select("document_id", "entity_id", "alias", "occurrences", "chunks", "confidence", F.array_join("evidence", ",").alias("evidence"))


PAIRS = "a.document_id < b.document_id"


@query(f"""with {sql.mentions()}, lk as (select a.document_id as source_id, b.document_id as other_id, count(distinct a.entity_id) as shared, list_sort(list_distinct(list(a.entity_id)))[1:8] as e,
flatten(list_sort(list_distinct(list(a.evidence))))[1:3] as ea, flatten(list_sort(list_distinct(list(b.evidence))))[1:3] as eb from ru a join ru b on a.entity_id = b.entity_id and {PAIRS} group by 1, 2)
select source_id, other_id, shared, array_to_string(e, ',') as entity_ids, array_to_string(ea, ',') as source_evidence, array_to_string(eb, ',') as other_evidence from lk order by shared desc, source_id, other_id limit 50""")
def q26_document_links(spark: SparkSession, d: str) -> DataFrame:
    links = linker.document_links(rolled(spark, d), views.entities(spark), limit=50)
    return links.select("source_id", "other_id", "shared", *[F.array_join(c, ",").alias(c) for c in ("entity_ids", "source_evidence", "other_evidence")])


@query(f"""with {sql.mentions()}, lb as (select entity_id, arg_max(display, alias) as label from gaz group by entity_id),
lk as (select a.document_id as source_id, b.document_id as other_id, count(*) as shared, string_agg(coalesce(label, a.entity_id), ',' order by a.entity_id) as labels from ru a join ru b on a.entity_id = b.entity_id and {PAIRS} left join lb on lb.entity_id = a.entity_id group by 1, 2)
select * from lk order by shared desc, source_id, other_id limit 5""")
def q27_planned_links(spark: SparkSession, d: str) -> DataFrame:
    out = linker.planned_links(rolled(spark, d), linker.gazetteer(views.entities(spark)))
    return out.select("source_id", "other_id", F.col("shared").cast("long").alias("shared"), F.array_join("entity_labels", ",").alias("labels"))


@query(sql.graph_search(graph.search_terms(TERMS), 20))
def q28_graph_search(spark: SparkSession, d: str) -> DataFrame:
    hits = graph.search(views.nodes(spark, d), views.edges(spark, d), TERMS, 20)
    keys = graph.matched(views.nodes(spark, d), graph.search_terms(TERMS)).select("id", F.array_join("matched_keys", ",").alias("matched"))
    shown = F.array_join(F.transform("connections", lambda c: F.concat_ws("|", c["edge_id"], c["type"], c["direction"], c["neighbor_id"], c["neighbor_title"])), ";")
    return hits.join(keys, "id").select("id", "type", "summary", "score", "matched", shown.alias("connections"))


@query(f"""with {sql.NODES} select e.src as node, e.id as edge_id, 'outgoing' as direction, e.dst as neighbor_id from edges e where e.src in (select id from nodes where kind = 'nation') and e.dst in (select id from nodes)
union all select e.dst, e.id, 'incoming', e.src from edges e where e.src <> e.dst and e.dst in (select id from nodes where kind = 'nation') and e.src in (select id from nodes)""")
def q29_neighbours(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.nodes(spark, d)
    return graph.neighbours(nodes.where(F.array_contains("labels", "nation")), views.edges(spark, d), nodes).select("node", "edge_id", "direction", "neighbor_id")


@query(f"with {sql.NODES} select id, array_to_string(list_sort(list_transform({sql.SHOWN}, lambda i: ks[i])), ',') as shown from nodes")
def q30_redaction(spark: SparkSession, d: str) -> DataFrame:
    return views.nodes(spark, d).select("id", F.array_join(F.array_sort(F.map_keys(graph.redacted(F.col("props")))), ",").alias("shown"))


@query(f"""with {sql.UNITS}, cur as (select id, resolution, updated_at as created_at from units where doc_id % 2 = 0),
stg as (select id, 'new ' || length(resolution) as resolution, 'later' as created_at, doc_id * 2 as seq from units where doc_id % 3 = 0 union all select id, 'newer', 'later', doc_id * 2 + 1 from units where doc_id % 9 = 0),
lst as (select * from stg qualify row_number() over (partition by id order by seq desc) = 1)
select coalesce(l.id, c.id) as id, coalesce(l.resolution, md5(c.resolution)) as resolution, coalesce(c.created_at, l.created_at) as created_at, l.id is not null and c.id is null as created from cur c full join lst l on l.id = c.id""")
def q31_merge_units(spark: SparkSession, d: str) -> DataFrame:
    units = views.units(spark, d)
    current = units.where("doc_id % 2 = 0").select("id", F.md5("resolution").alias("resolution"), F.col("updated_at").alias("created_at"))
    staged = units.where("doc_id % 3 = 0").select("id", F.concat(F.lit("new "), F.length("resolution").cast("string")).alias("resolution"), F.lit("later").alias("created_at"), (F.col("doc_id") * 2).alias("seq"))
    staged = staged.unionByName(units.where("doc_id % 9 = 0").select("id", F.lit("newer").alias("resolution"), F.lit("later").alias("created_at"), (F.col("doc_id") * 2 + 1).alias("seq")))
    plan = merge.merge_plan(current, staged)
    return merge.merged(current.withColumn("created", F.lit(False)), plan).select("id", "resolution", "created_at", "created")


@query(f"with {sql.NODES} select id, src, dst from edges where src in (select id from nodes) and dst in (select id from nodes)")
def q32_merge_edges_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_both_ends(views.edges(spark, d), views.nodes(spark, d)).select("id", "src", "dst")


@query("""select 'continuity:' || o_orderkey as id, 'order ' || o_orderkey as summary, 'costs ' || cast(cast(o_totalprice as decimal(18,2)) as varchar) as resolution,
case o_orderstatus when 'F' then 'active' when 'O' then 'draft' else 'deprecated' end as status, case o_orderstatus when 'O' then 'candidate' else 'memory' end as memory_kind,
strftime(o_orderdate, '%Y-%m-%d') as created_at, strftime(case when o_orderkey % 3 = 0 then o_orderdate - interval 2 day else o_orderdate end, '%Y-%m-%d') as updated_at from orders where o_orderkey % 11 <> 0""")
def q33_import_decisions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.decisions(views.decisions(spark, d)).select("id", "summary", "resolution", "status", "memory_kind", "created_at", "updated_at")


@query("""select 'continuity:' || o_orderkey || ':' || r.k || ':' || r.v as id, 'continuity:' || o_orderkey as src, 'continuity:' || r.v as dst, case when o_orderpriority = '1-URGENT' then 'high' else 'medium' end as confidence
from (select *, unnest([{'k': 'supersedes', 'v': o_orderkey - 1}, {'k': 'informs', 'v': o_orderkey + 1}]) as r from orders where o_orderkey % 5 = 0 and o_orderkey % 11 <> 0)""")
def q33b_decision_edges(spark: SparkSession, d: str) -> DataFrame:
    return ingest.decision_edges(views.decisions(spark, d)).select("id", "src", "dst", "confidence")


CHUNK_OK = "(doc_id + i) % 13 <> 0 and (doc_id + i) % 17 <> 0 and regexp_matches(t, '[^ \\t\\n\\r\\f\\v]')"
PAPER = "l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as t, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents where doc_id % 19 <> 0)"


@query(f"with {PAPER} select (select count(*) from documents) as received, (select count(*) from documents where doc_id % 19 <> 0) as imported, count(*) filter (where {CHUNK_OK}) as chunks, count(*) filter (where not ({CHUNK_OK})) + (select count(*) from documents where doc_id % 19 = 0) as skipped from l")
def q34_import_documents_report(spark: SparkSession, d: str) -> DataFrame:
    papers = views.papers(spark, d)
    return ingest.document_report(papers, ingest.chunks(papers))


@query(f"with {PAPER} select doc_id || ':' || i as id, doc_id || '.pdf - page ' || (i + 1) as summary, case when doc_id % 6 = 0 then 'draft' else 'active' end as status, case when doc_id % 6 = 0 then 'candidate' else 'memory' end as memory_kind, '[{{\"id\": \"' || doc_id || '#page=' || (i + 1) || '\", \"kind\": \"document-page\"}}]' as evidence_json from l where {CHUNK_OK}")
def q34b_document_units(spark: SparkSession, d: str) -> DataFrame:
    return ingest.document_units(ingest.chunks(views.papers(spark, d)), AS_OF).select("id", "summary", "status", "memory_kind", "evidence_json")


@query("select event_type, user_id % 3 as kind, case when user_id % 3 = 0 then 'draft' when event_type = 'click' then 'rejected' else 'draft' end as status, case when user_id % 3 = 0 then 'raw' when event_type = 'click' then 'memory' else 'candidate' end as memory_kind, count(*) as n from events group by all")
def q35_legacy_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    rows = views.read(spark, d, "events")
    status, kind = ingest.legacy_state(F.when(F.col("event_type") == "click", F.lit(" Rejected ")).otherwise(F.col("event_type")), F.when(F.col("user_id") % 3 == 0, F.lit("RAW")).otherwise("memory"))
    return rows.groupBy("event_type", (F.col("user_id") % 3).alias("kind"), status.alias("status"), kind.alias("memory_kind")).agg(F.count("*").alias("n"))


@query("""with tn as (select 'c' || conv_id || ':t' || turn as id, 'c' || conv_id as s, turn, conv_id from conversations),
nd as (select conv_id % 50 as node, list(id order by conv_id, turn) as ev, list_distinct(list(s)) as ss from tn group by 1)
select 'n' || node as id, array_to_string(ev, ',') as evidence, case when len(ss) = 1 then ss[1] else '' end as session_id, case when len(ss) = 1 then 'w' || (cast(substr(ss[1], 2) as bigint) % 4) else '' end as workspace_id from nd""")
def q36_session_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Nodes over all turns of conversations; evidence that doesn't exist is left out."""
    rows = views.read(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":t"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn")
    nodes = rows.groupBy((F.col("conv_id") % 50).alias("node")).agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "id"))).alias("t"))
    nodes = nodes.select(F.concat(F.lit("n"), F.col("node").cast("string")).alias("id"), F.concat(F.transform("t", lambda x: x["id"]), F.array(F.lit("missing"))).alias("evidence_ids"))
    sessions = rows.select(F.col("session_id").alias("id"), F.concat(F.lit("w"), (F.col("conv_id") % 4).cast("string")).alias("workspace_id")).distinct()
    return ingest.sessions_of(nodes, rows.select("id", "session_id"), sessions).select("id", F.array_join("evidence", ",").alias("evidence"), "session_id", "workspace_id")


def _skills(limit: int, needle: str = "") -> str:
    name = "case when p_partkey % 4 = 0 then repeat(p_name || ' ', 12) else p_name end"
    cut = f"case when length({name}) <= 120 then {name} else left({name}, 119) || '…' end"
    where = f"where contains(lower(name), {sql.lit(needle)}) or contains(lower(description), {sql.lit(needle)})" if needle else ""
    return f"""with c as (select * from part where p_size % 5 <> 0 order by p_partkey desc limit 500),
m as (select 'part:' || p_partkey as id, {cut} as name, p_type || ' of ' || p_brand as description, '1.0.0' as version, array_to_string(list_transform(range(1, 11), lambda i: p_brand || '-' || i), ',') as scope,
  case when p_partkey % 9 = 0 then 0 else 1 end::bigint as evidence, p_partkey from c where p_partkey % 3 = 0 and p_partkey % 18 <> 0)
select id, name, description, version, scope, evidence from m {where} order by p_partkey desc limit {limit}"""


def listed(spark: SparkSession, d: str, needle: str, limit: int) -> DataFrame:
    return skills.list_skills(views.skill_units(spark, d), needle, limit).select("id", "name", "description", "version", F.array_join("scope", ",").alias("scope"), F.size("evidence").cast("long").alias("evidence"))


@query(_skills(20, "brand#1"))
def q37_skills(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, d, " Brand#1", 20)


@query(_skills(50))
def q38_skills_bounded(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, d, "", 1000)


@query("select time_bucket(interval '1 hour', ts) as start, event_type as type, count(*) as events, count(distinct user_id) as units from events group by 1, 2")
def q39_audit_windows(spark: SparkSession, d: str) -> DataFrame:
    log = views.read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("memory_id"))
    return audit.rates(log).select(F.col("start").cast("timestamp_ntz").alias("start"), "type", "events", "units")


@query(f"with {sql.UNITS}, tk as (select len({sql.tok('summary')}) + len({sql.tok('resolution')}) as dl, unnest({sql.tok('resolution')}) as t, id from units), tt as (select t, count(distinct id) as n from tk group by t) select (select count(*) from units) as units, (select round(avg(len({sql.tok('resolution')})), 6) from units) as mean_tokens, count(*) as terms, max(n) as most_units from tt")
def q40_token_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = views.units(spark, d).select("id", text.tokens(F.col("resolution")).alias("t"))
    terms = rows.select(F.explode(F.array_distinct("t")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return rows.agg(F.count("*").alias("units"), F.round(F.avg(F.size("t")), 6).alias("mean_tokens")).join(F.broadcast(terms.agg(F.count("*").alias("terms"), F.max("n").alias("most_units"))))
