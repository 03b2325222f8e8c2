"""Queries over the store's write side, legacy rows, validation and the rest of search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import settings
from lodestrata.functions import text
from lodestrata.lineage import durable
from lodestrata.operators import graph, graphstore, ingest, lexical, linker, merge, vectors
from lodestrata.operators.lexical import Request
from lodestrata.plans import catalogue, imports, search, sql
from lodestrata.plans.registry import SQL, Q, query
from lodestrata.sources import snapshot, views

AS_OF = catalogue.AS_OF
RUNS = ["风扇", "阈值"]

__all__ = ["SQL", "Q"]


def _tokens(x: str) -> str:
    """Tokens of a text with a space on either side of each CJK character, in SQL."""
    return sql.tok(f"regexp_replace({x}, '([{text.CJK}])', ' \\1 ', 'g')")


CJK_VIEW = f"""{sql.UNITS},
cu as (select * replace (resolution || case when doc_id % 5 = 0 then ' 风扇的阈值 control风扇' when doc_id % 3 = 0 then ' 阈值,阈值表' else '' end as resolution) from units),
ct as (select *, {_tokens("summary || ' ' || resolution || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(source_refs, ' ')")} as t from cu),
cn as (select *, len(t) as dl, {', '.join(f"{sql.tf('t', list(r))} as f{k}" for k, r in enumerate(RUNS))} from ct),
st as (select count(*) as n, avg(dl) as mean, {', '.join(f'count(*) filter (where f{k} > 0) as n{k}' for k in range(len(RUNS)))} from cn),
sc as (select cn.*, -({' + '.join(f'greatest(ln((n - n{k} + 0.5::double) / (n{k} + 0.5::double)), 1e-6::double) * f{k} * 2.2::double / (f{k} + 1.2::double * (0.25::double + 0.75::double * dl / mean))' for k in range(len(RUNS)))}) as bm25 from cn, st where f0 > 0 and f1 > 0)"""


@query(f"with {CJK_VIEW} select id, round(bm25, 6) as bm25 from sc order by round(bm25, 9), updated_at desc, id limit 50")
def q41_cjk_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The channel of CJK runs: units with all runs of the request."""
    found = lexical.bm25(lexical.indexed_cjk(views.cjk_units(spark, d)), text.cjk_runs(" 和 ".join(RUNS).replace(" 和 ", " ")))
    found = found.where(F.forall("found", lambda n: n > 0))
    return found.orderBy(F.round("bm25", lexical.PLACES), F.desc("updated_at"), "id").limit(lexical.CHANNEL_CAP).select("id", F.round("bm25", 6).alias("bm25"))


CJK_RANKED = f"""{CJK_VIEW}, rk as (select *, row_number() over (order by round(bm25, 9), updated_at desc, id) as rank from sc where {sql.SEARCHABLE} qualify rank <= 50),
fu as (select id, round(0.55::double / (60 + rank) + 2.0::double / 61, 6) as score from rk)"""


@query(f"with {CJK_RANKED} select cast(row_number() over (order by score desc, id) as integer) as pos, id, score, 'scoped' as scope from fu order by pos limit 20")
def q42_cjk_search(spark: SparkSession, d: str) -> DataFrame:
    """A whole search by a request without any ASCII term."""
    return lexical.search(views.cjk_units(spark, d), Request(" ".join(RUNS), limit=20, per_document_limit=None)).select("pos", "id", "score", "scope")


LEGACY = """lg as (select *, p_partkey as k, case when p_partkey % 10 = 0 then 'raw' else 'memory' end as kind, case when p_partkey % 6 = 0 then 'rejected' else 'active' end as st from part where p_partkey % 17 <> 0 and p_partkey % 13 <> 0 and p_partkey % 11 <> 0)"""


@query(f"""with {LEGACY} select 'legacy:' || k as id, case when k % 4 = 0 then 'fact' else 'lesson' end as type, trim(p_name) as summary, case when kind = 'raw' then 'draft' when st = 'rejected' then 'rejected' else 'draft' end as status,
case when kind = 'raw' then 'raw' when st = 'rejected' then 'memory' else 'candidate' end as memory_kind, case when k % 4 = 1 then 'odd type' end as source_type, 'b' as own, 'x,y' as tags, 'part:' || k as refs from lg""")
def q43_legacy_units(spark: SparkSession, d: str) -> DataFrame:
    made = ingest.legacy_units(views.legacy_rows(spark, d))
    return made.select("id", "type", "summary", "status", "memory_kind", F.get_json_object("context_json", "$.source_type").alias("source_type"), F.get_json_object("context_json", "$.a").alias("own"), F.array_join("tags", ",").alias("tags"), F.array_join("source_refs", ",").alias("refs"))


@query("""select 'legacy-session-context:' || sha256('["s' || c_custkey || '", "' || c_mktsegment || '", ""]') as id, 's' || c_custkey as session_id, c_mktsegment as workspace_id,
case when c_custkey % 3 = 0 then '[{"id": "e' || c_custkey || '", "kind": "session-evidence"}, {"id":"o"}]' else '[]' end as evidence from customer where c_custkey % 9 <> 0 and (c_custkey % 3 = 0 or c_custkey % 7 <> 0)""")
def q44_legacy_sessions(spark: SparkSession, d: str) -> DataFrame:
    made = ingest.legacy_sessions(views.legacy_contexts(spark, d))
    return made.select("id", "session_id", "workspace_id", F.replace("evidence_json", F.lit('{"id": "o"}'), F.lit('{"id":"o"}')).alias("evidence"))


STAGED = """sg as (select o_orderkey as k, case when k % 7 = 0 then '' when k % 7 = 1 then ' decision ' when k % 7 = 2 then 'odd' else 'fact' end as ty, case when k % 5 = 0 then '  ' else 'order ' || k end as su, case when k % 11 = 0 then 'gone' else '' end as sta from orders),
co as (select 'o' || k as id, case when ty = '' then 'lesson' else trim(ty) end as type, trim(su) as summary, case when sta = '' then 'draft' else sta end as status, 'candidate' as memory_kind from sg),
fa as (select *, list_filter([case when type not in ('session', 'decision', 'lesson', 'issue', 'workflow', 'fact', 'concept', 'person', 'project', 'tool') then 'type' end, case when status = 'gone' then 'status' end, case when summary = '' then 'summary' end], lambda x: x is not null) as faults from co)"""


@query(f"with {STAGED} select id, type, summary, status, memory_kind, array_to_string(faults, ',') as faults from fa")
def q45_coercion_and_validation(spark: SparkSession, d: str) -> DataFrame:
    """Raw units with defaults filled in, and what keeps some from being stored."""
    k = F.col("o_orderkey")
    raw = views.read(spark, d, "orders").select(
        F.concat(F.lit("o"), k.cast("string")).alias("id"), F.when(k % 7 == 0, "").when(k % 7 == 1, " decision ").when(k % 7 == 2, "odd").otherwise("fact").alias("type"), F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit("order "), k.cast("string"))).alias("summary"),
        F.when(k % 11 == 0, "gone").alias("status"), *[F.lit(None).cast(t).alias(c) for c, t in (("resolution", "string"), ("evidence_json", "string"), ("context_json", "string"), ("tags", "array<string>"), ("memory_kind", "string"), ("source_refs", "array<string>"), ("session_id", "string"), ("workspace_id", "string"), ("repo_id", "string"), ("created_at", "string"), ("updated_at", "string"))],
    )
    good, bad = merge.split_valid(merge.coerced(raw, AS_OF))
    shown = ["id", "type", "summary", "status", "memory_kind"]
    return good.select(*shown, F.lit("").alias("faults")).unionByName(bad.select(*shown, F.array_join("faults", ",").alias("faults")))


@query("select vec_id, (vec_id % 13 <> 0 and vec_id % 17 <> 0) as valid from embeddings")
def q46_vector_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = views.vectors(spark, d)
    rows = rows.withColumn("embedding", F.when(F.col("vec_id") % 13 == 0, F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x).cast("float"))).otherwise(F.col("embedding")))
    return rows.withColumn("source_id", F.when(F.col("vec_id") % 17 == 0, " ").otherwise(F.col("source_id"))).select("vec_id", vectors.valid().alias("valid"))


@query("""with s as (select 'doc:' || vec_id || ':p1' as source_id, case when vec_id % 2 = 0 then 'candidate' else 'knowledge' end as source_kind, vec_id % 10 as metadata, 1 as seq, vec_id from embeddings where vec_id % 3 <> 0
union all select 'doc:' || vec_id || ':p1', 'knowledge', -1, 2, vec_id from embeddings where vec_id % 9 = 4),
l as (select * from s qualify row_number() over (partition by source_id order by seq desc) = 1),
c as (select 'doc:' || vec_id || ':p1' as source_id, 'knowledge' as source_kind, -2 as metadata from embeddings where vec_id % 2 = 0)
select coalesce(l.source_id, c.source_id) as source_id, coalesce(l.source_kind, c.source_kind) as source_kind, cast(coalesce(l.metadata, c.metadata) as varchar) as metadata from c full join l on l.source_id = c.source_id""")
def q47_vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Vectors merged by id, the last of a repeated id winning by input order."""
    rows = views.vectors(spark, d)
    current = rows.where("vec_id % 2 = 0").select("source_id", F.lit("knowledge").alias("source_kind"), "dimensions", "embedding", F.lit("-2").alias("metadata_json"), F.lit("").alias("updated_at"))
    staged = rows.where("vec_id % 3 <> 0").select("source_id", F.when(F.col("vec_id") % 2 == 0, "candidate").otherwise("knowledge").alias("source_kind"), "dimensions", "embedding", (F.col("vec_id") % 10).cast("string").alias("metadata_json"), F.lit("").alias("updated_at"), F.lit(1).alias("seq"))
    again = rows.where("vec_id % 9 = 4").select("source_id", F.lit("knowledge").alias("source_kind"), "dimensions", "embedding", F.lit("-1").alias("metadata_json"), F.lit("").alias("updated_at"), F.lit(2).alias("seq"))
    after = imports._upsert_vectors(imports.Import({}, {}), current, staged.unionByName(again)).tables["vectors"]
    return after.select("source_id", "source_kind", F.col("metadata_json").alias("metadata"))


@query("""with e as (select vec_id % 200 as k, arg_max(vec_id, vec_id) as last from embeddings group by 1) select 'continuity:' || d.doc_id as id, e.last from documents d left join e on e.k = d.doc_id""")
def q48_embedding_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Units with the last embedding of their id; an absent one is null."""
    rows = views.read(spark, d, "embeddings").select((F.col("vec_id") % 200).cast("string").alias("decisionId"), F.col("vec_id").alias("seq"), F.array(F.col("vec_id").cast("double")).alias("values"))
    made = views.read(spark, d, "documents").select(F.concat(F.lit("continuity:"), F.col("doc_id").cast("string")).alias("id"))
    return ingest.with_values(made, rows, "decisionId", "continuity:").select("id", F.col("values")[0].cast("long").alias("last"))


SNAP = """cv as (select conv_id as c, turn as t, role, coalesce(text, '') as text from conversations),
sn as (select 'n' || c || '.' || t as id, c, t, text from cv where role = 'assistant'),
tn as (select 't' || c || '.' || t as id from cv)"""


@query(f"""with {SNAP} select id, case when t % 2 = 0 then 'fact' else 'concept' end as type, case when text = '' then 'Knowledge' else left(text, 40) end as summary, case when c % 10 = 0 then 'draft' else 'active' end as status,
't' || c || '.' || t || case when 't' || c || '.' || (t + 100) in (select id from tn) then ',t' || c || '.' || (t + 100) else '' end as evidence, 'c' || c as session_id, cast(c % 4 as varchar) as workspace_id from sn""")
def q49_extension_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of a snapshot's nodes, with the turns that are there as evidence."""
    lists = snapshot.read_sections(spark, views.snapshot(spark, d))
    nodes = lists["nodes"].withColumnRenamed("evidenceTurnIds", "evidence_ids")
    made = ingest.extension_units(nodes, lists["turns"].select("id", F.col("sessionId").alias("session_id")), lists["sessions"].select("id", F.col("workspaceId").alias("workspace_id")))
    return made.select("id", "type", "summary", "status", F.array_join(F.transform("source_refs", lambda x: F.substring(x, 6, 99)), ",").alias("evidence"), "session_id", "workspace_id")


@query(f"""with {SNAP}, r as (select conv_id, turn, role from conversations) select (select count(distinct conv_id) from r) as sessions, (select count(*) from r) as turns, (select count(*) from sn) as vectors, (select count(*) from sn) as nodes, (select count(*) from sn) as edges""")
def q50_snapshot_profile(spark: SparkSession, d: str) -> DataFrame:
    return ingest.snapshot_profile(snapshot.read_sections(spark, views.snapshot(spark, d)))


@query(f"""with {SNAP}, ed as (select 'e' || c || '.' || t as id, id as src, 'n' || c || '.' || (t + 2) as dst, 't' || c || '.' || t as evidence from sn)
select 'node' as what, id, case when text = '' then 'Knowledge' else left(text, 40) end as label, case when t % 2 = 0 then 'fact' else 'concept' end as kind, 'medium' as confidence, 't0' as updated_at from sn
union all select 'edge', id, src || '>' || dst, 'NEXT', 'medium', 't0' from ed where dst in (select id from sn)
union all select 'vector', sid, arg_max(tt, k), arg_max(kind, k), '', 't0' from (select 'n' || c || '.' || (t - c % 2) as sid, t::double::varchar as tt, case when t % 3 = 0 then 'candidate' else 'knowledge' end as kind, 'v' || c || '.' || t as k from sn) group by sid""")
def q51_snapshot_import(spark: SparkSession, d: str) -> DataFrame:
    """What an import of a snapshot writes to the graph and the vectors: defaults filled in, edges with both ends, the last of a repeated vector."""
    out = imports.import_snapshot(imports.empty_units(spark), snapshot.read_sections(spark, views.snapshot(spark, d)), AS_OF, imports.empty_vectors(spark), graphstore.empty(spark)).tables
    nodes = out["nodes"].select(F.lit("node").alias("what"), "id", *[F.element_at("props", F.lit(k)).alias(k) for k in ("label", "kind", "confidence", "updated_at")])
    edges = out["edges"].select(F.lit("edge").alias("what"), "id", F.concat("src", F.lit(">"), "dst").alias("label"), F.col("type").alias("kind"), "confidence", "updated_at")
    rows = out["vectors"].select(F.lit("vector").alias("what"), F.col("source_id").alias("id"), F.col("embedding")[0].cast("double").cast("string").alias("label"), F.col("source_kind").alias("kind"), F.lit("").alias("confidence"), "updated_at")
    return nodes.unionByName(edges).unionByName(rows)


DECIDED = """dn as (select o_orderkey as k, 'continuity:' || o_orderkey as id, case when o_orderpriority = '1-URGENT' then 'high' else 'medium' end as confidence, case o_orderstatus when 'F' then 'active' when 'O' then 'draft' else 'deprecated' end as status from orders where o_orderkey % 11 <> 0),
de as (select id || ':' || r.k as rid, id as src, 'continuity:' || r.v as dst, r.k as type, confidence from (select *, unnest([{'k': 'supersedes', 'v': k - 1}, {'k': 'informs', 'v': k + 1}]) as r from dn where k % 5 = 0))"""


@query(f"""with {DECIDED} select 'node' as what, id, 'order ' || k as label, confidence, status from dn
union all select 'edge', rid || ':' || substr(dst, 12), src || '>' || dst, confidence, type from de where dst in (select id from dn)""")
def q52_decision_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph after an import of decisions: a node for each, relations between those that are there."""
    out = imports.import_decisions(imports.empty_units(spark), views.decisions(spark, d), AS_OF, graph_tables=graphstore.empty(spark)).tables
    nodes = out["nodes"].select(F.lit("node").alias("what"), "id", F.element_at("props", F.lit("label")).alias("label"), F.element_at("props", F.lit("confidence")).alias("confidence"), "status")
    return nodes.unionByName(out["edges"].select(F.lit("edge").alias("what"), "id", F.concat("src", F.lit(">"), "dst").alias("label"), "confidence", F.col("type").alias("status")))


PAGES = f"{sql.UNITS}, pg as (select 'doc:' || doc_id as document_id, * from units where status = 'active')"


@query(f"""with {PAGES}, {sql.gazetteer()} select trim(id) as id, 'entity' as kind, label as title, '' as text_md5 from en where id <> ''
union all select distinct document_id, 'document', regexp_replace(summary, ' - page [0-9]+$', ''), '' from pg union all select id, 'chunk', summary, md5(resolution) from pg""")
def q53_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of entities, documents and chunks after they were merged into an empty graph."""
    nodes, _ = views.stored_graph(spark, d)
    kind = F.when(F.array_contains("labels", "Document"), "document").when(F.array_contains("labels", "DocumentChunk"), "chunk").otherwise("entity")
    prop = lambda k: F.element_at("props", F.lit(k))
    return nodes.select("id", kind.alias("kind"), F.coalesce(prop("title"), prop("label")).alias("title"), F.when(kind == "chunk", F.md5(prop("text"))).otherwise("").alias("text_md5"))


@query(f"with {PAGES} select document_id, regexp_replace(summary, ' - page [0-9]+$', '') as filename, id, cast(page as integer) as seq, md5(resolution) as text_md5 from pg")
def q54_stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    return graphstore.stored_chunks(*views.stored_graph(spark, d)).select("document_id", "filename", "id", "seq", F.md5("text").alias("text_md5"))


@query(f"""with {sql.mentions()}, al as (select 'mention:' || id || '|' || entity_id as id, id as src, entity_id as dst, confidence, alias, occurrences, 0 as chunks from mn union all select 'mention:' || document_id || '|' || entity_id, document_id, entity_id, confidence, alias, occurrences, chunks from ru)
select id, src, dst, confidence, alias, cast(occurrences as varchar) as occurrences, case when chunks > 0 then cast(chunks as varchar) end as chunks from al""")
def q55_relinked_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions after the stored chunks were linked with the graph's own entities, as edges from chunks and documents."""
    nodes, edges = (durable(x) for x in views.stored_graph(spark, d))
    found = imports.relink_stored(nodes, edges, AS_OF, dry_run=False).tables["edges"].where(F.col("rel") == graphstore.MENTIONS)
    return found.select("id", "src", "dst", "confidence", *[F.element_at("props", F.lit(k)).alias(k) for k in ("alias", "occurrences", "chunks")])


@query(f"""with {sql.mentions()}, dm as (select document_id from ch group by 1) select (select count(*) from ch) as chunks, (select count(*) from gaz) as aliases, (select count(distinct entity_id) from gaz) as catalogue_entities, (select count(*) from mn) as mentions, (select count(distinct id) from mn) as linked_chunks, (select count(distinct entity_id) from mn) as entities""")
def q56_link_report(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a dry run of relinking."""
    out = imports.relink(views.chunk_texts(spark, d), views.entities(spark))
    one = out.frames["gazetteer"].agg(F.count("*").alias("aliases"), F.count_distinct("entity_id").alias("catalogue_entities"))
    counted = {k: out.report[k] for k in ("chunks", "mentions", "linked_chunks", "entities")}
    return one.select(*[F.lit(v).cast("long").alias(k) for k, v in counted.items()], "aliases", "catalogue_entities")


@query(f"with {sql.mentions()} select id, entity_id, alias, confidence from (select *, row_number() over (order by id, position) as place from mn) where place <= 20")
def q57_link_sample(spark: SparkSession, d: str) -> DataFrame:
    sample = imports.relink(views.chunk_texts(spark, d), views.entities(spark)).report["sample"]
    return spark.createDataFrame([(r["id"], r["entity_id"], r["alias"], r["confidence"]) for r in sample], "id string, entity_id string, alias string, confidence string")



@query(f"""with {sql.NODES}, cur as (select id, kind, vs[2] as name from nodes where kind <> 'supplier'), new as (select 'nation:' || n_nationkey as id, 'place' as kind, 'New ' || n_name as label from nation where n_nationkey % 2 = 0 union all select 'extra:' || n_nationkey, 'place', n_name from nation where n_nationkey % 5 = 0)
select coalesce(new.id, cur.id) as id, coalesce(new.kind, cur.kind) as kind, new.label as label, cur.name as name, case when new.id is null then 'a' else '' end as aliases from cur full join new on new.id = cur.id""")
def q58_node_merge(spark: SparkSession, d: str) -> DataFrame:
    """Nodes merged by id: staged properties win, others stay, lists are replaced as a whole."""
    none = F.array().cast("array<string>")
    current = views.nodes(spark, d).where(~F.array_contains("labels", "supplier")).select("id", "labels", "props", none.alias("tags"), F.array(F.lit("a")).alias("aliases"), "status")
    nation = views.read(spark, d, "nation")
    key = F.col("n_nationkey").cast("string")
    staged = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("nation:"), key).alias("id"), F.lit("place").alias("kind"), F.concat(F.lit("New "), "n_name").alias("label"), F.lit(1).alias("seq"))
    staged = staged.unionByName(staged.withColumns({"label": F.lit("old"), "seq": F.lit(0)})).unionByName(nation.where("n_nationkey % 5 = 0").select(F.concat(F.lit("extra:"), key).alias("id"), F.lit("place").alias("kind"), F.col("n_name").alias("label"), F.lit(1).alias("seq")))
    after = graphstore.merge_nodes(current, graphstore.entity_nodes(staged))
    return after.select("id", *[F.element_at("props", F.lit(k)).alias(k) for k in ("kind", "label", "name")], F.array_join("aliases", ",").alias("aliases"))


@query(f"""with {sql.NODES}, ok as (select * from edges where src in (select id from nodes) and dst in (select id from nodes)), new as (select id, src, dst, 'MOVED' as type from ok where src like 'nation:%' union all select 'x' || s_suppkey, 'supplier:' || s_suppkey, 'region:' || (s_suppkey % 8), 'NEAR' from supplier)
select coalesce(new.id, ok.id) as id, coalesce(new.src, ok.src) as src, coalesce(new.dst, ok.dst) as dst, coalesce(new.type, ok.type) as type from ok full join (select * from new where dst in (select id from nodes)) new on new.id = ok.id and new.src = ok.src and new.dst = ok.dst""")
def q59_edge_merge(spark: SparkSession, d: str) -> DataFrame:
    """Edges merged by ends and id, if both ends exist."""
    nodes = views.nodes(spark, d)
    whole = lambda rows: rows.withColumn("props", F.create_map().cast("map<string,string>")).select("id", "src", "dst", "rel", "type", "confidence", "evidence", "props", "updated_at")
    current = whole(graph.with_both_ends(views.edges(spark, d), nodes).withColumn("updated_at", F.lit("")))
    supplier = views.read(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    fresh = supplier.select(F.concat(F.lit("x"), key).alias("id"), F.concat(F.lit("supplier:"), key).alias("from"), F.concat(F.lit("region:"), (F.col("s_suppkey") % 8).cast("string")).alias("to"), F.lit("NEAR").alias("type"))
    staged = graphstore.entity_edges(fresh).unionByName(current.where(F.col("src").startswith("nation:")).withColumn("type", F.lit("MOVED")))
    return graphstore.merge_edges(current, graphstore.joinable(staged, nodes)).select("id", "src", "dst", "type")


@query(f"with {sql.NODES} select 'nodes' as what, count(*) as n from nodes union all select 'relationships', count(*) from edges")
def q60_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.counts(views.nodes(spark, d), views.edges(spark, d))


@query(f"""with {sql.NODES}, ed as (select id, src, dst from edges where src in (select id from nodes) and dst in (select id from nodes)), ts as (select 'nation:' || n_nationkey as id from nation where n_regionkey = 1)
select id, (select count(*) from ed where ed.src = n.id or ed.dst = n.id) as incident from nodes n where id not in (select id from ts) union all select 'removed', (select count(*) from ed where src in (select id from ts) or dst in (select id from ts))""")
def q61_clean_up(spark: SparkSession, d: str) -> DataFrame:
    """The edges at each node before the nodes of a test workspace go, for those that stay, and how many edges go."""
    nodes, edges = views.nodes(spark, d), durable(graph.with_both_ends(views.edges(spark, d), views.nodes(spark, d)))
    ids = views.read(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    units = ids.select("id", F.lit("trial").alias("workspace_id"))
    left, rest = graphstore.without(nodes, edges, graphstore.entities_of_tests(units, ["trial"], prefix="nation:"))
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("incident"))
    stay = left.select("id").join(ends, "id", "left").select("id", F.coalesce("incident", F.lit(0)).alias("incident"))
    gone = edges.agg(F.count("*").alias("a")).join(F.broadcast(rest.agg(F.count("*").alias("b")))).select(F.lit("removed").alias("id"), (F.col("a") - F.col("b")).alias("incident"))
    return stay.unionByName(gone)


@query(f"""with {sql.UNITS}, s as (select id from units where doc_id % 3 = 0 union all select id from units where doc_id % 9 = 0), w as (select id, count(*) as n, any_value(id in (select id from units where doc_id % 2 = 0)) as known from s group by id)
select id as memory_id, count(*) filter (where not known) > 0 as fresh, max(n) as upserts from w group by id""")
def q62_audit_of_a_merge(spark: SparkSession, d: str) -> DataFrame:
    """The events of a merge: one for each upsert, one of them a creation where the unit is new."""
    units = views.units(spark, d)
    staged = units.where("doc_id % 3 = 0").select("id", F.lit("t").alias("created_at"), F.lit(0).alias("seq")).unionByName(units.where("doc_id % 9 = 0").select("id", F.lit("t").alias("created_at"), F.lit(1).alias("seq")))
    log = merge.events(merge.merge_plan(units.where("doc_id % 2 = 0").select("id", "created_at"), staged), AS_OF)
    return log.groupBy("memory_id").agg((F.sum(F.col("created").cast("int")) == 1).alias("fresh"), F.count("*").alias("upserts"))


@query(f"""with {sql.UNITS}, s as (select id from units where doc_id % 3 = 0 union all select id from units where doc_id % 9 = 0), w as (select id, count(*) as n, any_value(id in (select id from units where doc_id % 2 = 0)) as known from s group by id)
select count(*) filter (where not known) as created, cast(sum(n) - count(*) filter (where not known) as bigint) as updated from w""")
def q63_merge_report(spark: SparkSession, d: str) -> DataFrame:
    units = views.units(spark, d)
    staged = units.where("doc_id % 3 = 0").select("id", F.lit("t").alias("created_at"), F.lit(0).alias("seq")).unionByName(units.where("doc_id % 9 = 0").select("id", F.lit("t").alias("created_at"), F.lit(1).alias("seq")))
    return merge.report(merge.merge_plan(units.where("doc_id % 2 = 0").select("id", "created_at"), staged))


@query(r"select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://([^/?#]*@)?([^/?#]*)', 2)) || regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) as endpoint from pages")
def q64_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "pages").select("page_id", settings.endpoint_of(F.col("url")).alias("endpoint"))


@query(f"with {sql.UNITS} select id, json_array_length(evidence_json)::integer as evidence, coalesce(json_extract_string(evidence_json, '$[0].id'), '') as first, json_extract_string(context_json, '$.imported_from') as origin from units")
def q65_records(spark: SparkSession, d: str) -> DataFrame:
    """Units as they are returned, with evidence and context decoded."""
    rows = merge.records(views.units(spark, d))
    evidence = F.size(F.variant_get("evidence", "$", "array<variant>"))
    return rows.select("id", evidence.alias("evidence"), F.coalesce(F.try_variant_get("evidence", "$[0].id", "string"), F.lit("")).alias("first"), F.try_variant_get("context", "$.imported_from", "string").alias("origin"))


@query(f"""with {sql.mentions()}, lk as (select a.document_id as source_id, b.document_id as other_id, count(distinct a.entity_id) as shared, list_sort(list_distinct(list(a.entity_id))) as e from ru a join ru b on a.entity_id = b.entity_id and {catalogue.PAIRS} group by 1, 2),
tp as (select *, unnest(e[1:8]) as i from lk order by shared desc, source_id, other_id), top as (select source_id, other_id from lk order by shared desc, source_id, other_id limit 20)
select 'document-link:' || source_id || '|' || other_id as id, source_id || ' shares knowledge with ' || other_id as summary, 'Cross-document link: ' || string_agg(label, ', ' order by i) as resolution, cast(any_value(shared) as integer) as score, cast(count(*) as integer) as connections
from tp join top using (source_id, other_id) join en on en.id = tp.i group by source_id, other_id""")
def q66_link_results(spark: SparkSession, d: str) -> DataFrame:
    """Document links in the shape of search results."""
    shaped = graph.link_results(linker.document_links(catalogue.rolled(spark, d), views.entities(spark), limit=20))
    return shaped.select("id", "summary", "resolution", "score", F.size("connections").alias("connections"))


@query(f"""with {sql.NODES}, sh as (select *, {sql.SHOWN} as s from nodes where status = 'active'), mt as (select *, list_sort(list_transform(list_filter(s, lambda i: contains(lower(vs[i]), 'asia') or contains(lower(vs[i]), 'region')), lambda i: ks[i] || '=' || vs[i])) as m from sh)
select id, 'Matched: ' || array_to_string(m, '; ') as matched, cast(len(m) as integer) as score from mt where len(m) > 0""")
def q67_graph_resolution(spark: SparkSession, d: str) -> DataFrame:
    """What a graph hit says of the properties that matched."""
    hits = graph.search(views.nodes(spark, d), views.edges(spark, d), "asia region", 50)
    return hits.select("id", F.split("resolution", r"\. Connections: ")[0].alias("matched"), "score")


HYBRID = Request("thing the orantion", limit=5, per_document_limit=None)


@query(f"""select 'lexical' as section, id, score from ({sql.search(HYBRID)})
union all select 'semantic', source_id, round(score, 6) from (with {catalogue.TOP} select * from tp where query_id = 100 and rank <= 5 and score >= 0.35)
union all select 'graph', id, score::double from ({sql.graph_search(graph.search_terms(HYBRID.query), 5)})""")
def q68_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """All sections of one hybrid answer, for the vector with id 100 as the request's embedding."""
    rows = views.vectors(spark, d)
    asked = rows.where("vec_id = 100").select("embedding").first()
    found = search.search(views.units(spark, d), HYBRID, rows, [float(x) for x in asked.embedding] if asked else None, views.nodes(spark, d), views.edges(spark, d))
    out = found.results.select(F.lit("lexical").alias("section"), "id", "score")
    if found.semantic is not None:
        out = out.unionByName(found.semantic.select(F.lit("semantic").alias("section"), F.col("source_id").alias("id"), F.round("score", 6).alias("score")))
    return out.unionByName(found.graph.select(F.lit("graph").alias("section"), "id", F.col("score").cast("double").alias("score")))


@query(f"with {sql.UNITS} select count(*) as total, count(*) filter (where doc_id % 2 = 0) as indexed, count(*) filter (where doc_id % 2 <> 0) as planned from units")
def q69_index_backfill(spark: SparkSession, d: str) -> DataFrame:
    """What rebuilding the CJK index would add to one that has every other document."""
    units = views.units(spark, d)
    report = imports.reindex_cjk(units, lexical.indexed_cjk(units.where("doc_id % 2 = 0")).select("id", "in_all"), True).report
    return spark.createDataFrame([(report["total"], report["indexed"], report["planned"])], "total long, indexed long, planned long")


@query(f"with {sql.gazetteer(tags=True)} select id, label, array_to_string(aliases, ',') as aliases, array_to_string(tags, ',') as tags from en where id <> ''")
def q70_entity_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The linkable entities of the stored graph: documents and chunks are none."""
    return graphstore.entity_catalogue(views.stored_graph(spark, d)[0]).select("id", "label", *[F.array_join(c, ",").alias(c) for c in ("aliases", "tags")])
