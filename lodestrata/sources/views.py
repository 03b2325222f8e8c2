"""Store tables derived from the driver's tables; each has the same definition in SQL (plans/sql.py)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.lineage import shared_dir
from lodestrata.operators.lexical import Index, build_index

#: A small catalogue (id, label, aliases, tags) with overlapping, ambiguous, unusable and path-like surfaces.
ENTITIES = [
    ("e01", "thatin", ["inoran", "thatin orantion"], ["erble"]),
    ("e02", "inoran", [], ["thing"]),
    ("e03", "orantion", ["Orantion"], []),
    ("e04", "ononst", ["hehely"], ["erble"]),
    ("e05", "hehely", ["value"], []),
    ("e06", "thble", ["tasks.json"], ["ea"]),
    ("e07", "thing", [], []),
    ("e08", "eriner thanea", ["anea eriner"], []),
    ("e09", "anea eriner", ["eriner"], []),
    ("e10", "page", ["the and attion"], []),
    ("e11", "value", ["it"], ["th"]),
    ("e12", "docs/readme", ["attion"], []),
    ("e13", "die und", ["berlich"], []),
    ("e14", "de la", ["éaux"], []),
    ("e15", "ción", ["los las"], []),
    ("", "nameless", [], []),
    ("e17", "", ["tion"], []),
    ("e18", "阈值", ["阈"], []),
    ("e19", "Thing", ["ereler"], []),
    ("e20", "ß", ["weiß"], []),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt out; larger tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each non-blank line of a document as a page."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = spread(read(spark, sf_dir, "documents")).join(labels, "doc_id", "left")
    lines = docs.select("doc_id", "lang", "source", "quality", "toxic", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "resolution")).where(F.col("resolution").rlike("[^ \\t\\n\\r\\f]"))
    doc, n = F.col("doc_id").cast("string"), (F.col("pos") + 1).cast("string")
    name = F.concat("source", F.lit("-"), doc, F.lit(".pdf"))
    when = F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bad, toxic = F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    return lines.select(
        F.concat(F.lit("doc:"), doc, F.lit(":p"), n).alias("id"), F.lit("fact").alias("type"), F.concat(name, F.lit(" - page "), n).alias("summary"), "resolution",
        F.when(F.col("doc_id") % 7 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"id": "'), doc, F.lit("#page="), n, F.lit('", "kind": "document-page"}]'))).alias("evidence_json"),
        F.lit('{"imported_from": "document"}').alias("context_json"), F.array(F.lit("document"), F.lit("pdf")).alias("tags"),
        F.when(bad, "draft").when(toxic, "deprecated").otherwise("active").alias("status"), F.when(bad, "candidate").otherwise("memory").alias("memory_kind"),
        F.array(F.concat(F.lit("document:"), name, F.lit("#page="), n)).alias("source_refs"), F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")).alias("session_id"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("source")).alias("workspace_id"), F.col("lang").alias("repo_id"), when.alias("created_at"), when.alias("updated_at"), "doc_id", (F.col("pos") + 1).alias("page"),
    )


_indexes: dict[tuple[str, str], Index] = {}


def unit_index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of ``units``, as a store keeps one: written to the shared folder when a session first asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = build_index(units(spark, sf_dir), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return _indexes[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.concat(F.lit("doc:"), F.col("vec_id").cast("string"), F.lit(":p1")).alias("source_id"), F.when(F.col("label") == 9, "candidate").otherwise("knowledge").alias("source_kind"), F.size("embedding").alias("dimensions"), "embedding", F.concat(F.lit('{"label":'), F.col("label").cast("string"), F.lit("}")).alias("metadata_json"))


def entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITIES, "id string, label string, aliases array<string>, tags array<string>")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities drawn from the tables: parts with ambiguous and path-like aliases, suppliers, and a topic for each document, its first words."""
    none = F.array().cast("array<string>")
    named = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id")
    part = read(spark, sf_dir, "part").select(named("part", "p_partkey"), F.col("p_name").alias("label"), F.array(F.concat("p_brand", F.lit(" "), "p_type"), F.concat("p_name", F.lit(".json"))).alias("aliases"), F.array("p_type").alias("tags"))
    supplier = read(spark, sf_dir, "supplier").select(named("supplier", "s_suppkey"), F.col("s_name").alias("label"), none.alias("aliases"), none.alias("tags"))
    first = F.array_join(F.slice(F.split(F.split(F.coalesce("text", F.lit("")), "\n", 2)[0], " ", -1), 1, 3), " ")
    topic = read(spark, sf_dir, "documents").select(named("topic", "doc_id"), first.alias("label"), none.alias("aliases"), none.alias("tags"))
    return part.unionByName(supplier).unionByName(topic)


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_id, id, seq, text`` of active pages."""
    return units(spark, sf_dir).where("status = 'active'").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("document_id"), "id", F.col("page").alias("seq"), F.col("resolution").alias("text"))


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active pages of ``units`` as documents to import, each with its pages as chunks."""
    pages = units(spark, sf_dir).where("status = 'active'").select("doc_id", "page", F.regexp_extract("summary", "^(.+) - page", 1).alias("filename"), F.struct("id", F.col("page").cast("int").alias("index"), F.col("page").cast("string").alias("page"), F.col("resolution").alias("text"), F.md5("resolution").alias("contentHash")).alias("chunk"))
    made = pages.groupBy("doc_id").agg(F.first("filename").alias("filename"), F.transform(F.array_sort(F.collect_list(F.struct("page", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
    return made.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), "filename", F.lit("").alias("sourcePath"), F.lit("").alias("contentHash"), F.size("chunks").alias("pageCount"), F.lit("ready").alias("status"), "chunks")


def _node(rows: DataFrame, kind: str, key: str, props: dict[str, str]) -> DataFrame:
    named = F.create_map(*[x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))])
    return rows.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.array(F.lit("KnowledgeEntity"), F.lit(kind)).alias("labels"), F.map_concat(F.create_map(F.lit("kind"), F.lit(kind)), named).alias("props"), F.lit("active").alias("status"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, nations and regions as nodes; suppliers have properties that must not be shown, those in debt are not active."""
    supplier = read(spark, sf_dir, "supplier").withColumn("hint", F.concat(F.lit("pw-"), "s_name"))
    rows = _node(supplier, "supplier", "s_suppkey", {"name": "s_name", "balance": "s_acctbal", "password_hint": "hint", "API_KEY": "hint"})
    poor = supplier.where("s_acctbal < 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"))
    rows = rows.join(poor.withColumn("poor", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("poor"), "draft").otherwise("active")).drop("poor")
    return rows.unionByName(_node(read(spark, sf_dir, "nation"), "nation", "n_nationkey", {"name": "n_name"})).unionByName(_node(read(spark, sf_dir, "region"), "region", "r_regionkey", {"name": "r_name"}))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to nation and nation to region; every tenth supplier also has an edge to a nation that doesn't exist."""

    def made(rows: DataFrame, src: str, src_key: str, dst: str, dst_key: str, kind: str) -> DataFrame:
        a, b = F.concat(F.lit(f"{src}:"), F.col(src_key).cast("string")), F.concat(F.lit(f"{dst}:"), F.col(dst_key).cast("string"))
        return rows.select(F.concat(a, F.lit("->"), b).alias("id"), a.alias("src"), b.alias("dst"), F.lit("RELATED").alias("rel"), F.lit(kind).alias("type"), F.lit("high").alias("confidence"), F.array(a).alias("evidence"))

    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    rows = made(supplier, "supplier", "s_suppkey", "nation", "s_nationkey", "BASED_IN").unionByName(made(nation, "nation", "n_nationkey", "region", "n_regionkey", "PART_OF"))
    return rows.unionByName(made(supplier.where("s_suppkey % 10 = 0").withColumn("nowhere", F.col("s_nationkey") + 1000), "supplier", "s_suppkey", "nation", "nowhere", "BASED_IN"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions: some without a question, states in capitals, relations to other orders, a history for some."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    relation = F.create_map(F.lit("supersedes"), F.array((F.col("o_orderkey") - 1).cast("string"), F.lit(" ")), F.lit("informs"), F.array((F.col("o_orderkey") + 1).cast("string")))
    history = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct(day(F.date_add("o_orderdate", -5)).alias("timestamp")), F.struct(day(F.date_add("o_orderdate", -2)).alias("timestamp")))).otherwise(F.array().cast("array<struct<timestamp:string>>"))
    return o.select(
        key.alias("id"), F.when(F.col("o_orderkey") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" order "), key)).alias("question"), F.concat(F.lit("costs "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("answer"),
        day(F.col("o_orderdate")).alias("timestamp"), F.array(F.lower("o_orderpriority")).alias("tags"), F.when(F.col("o_orderstatus") == "F", "Active").when(F.col("o_orderstatus") == "O", "DRAFT").otherwise("outdated").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").otherwise("unknown").alias("priority"), F.when(F.col("o_orderkey") % 5 == 0, relation).otherwise(F.create_map().cast("map<string,array<string>>")).alias("relationships"), history.alias("history"), F.col("o_orderkey").alias("seq"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with lines as chunks; some without a name, some chunks without an id, some pages that are no number."""
    d = read(spark, sf_dir, "documents")
    doc = F.col("doc_id").cast("string")
    chunk = lambda x, i: F.struct(F.when((F.col("doc_id") + i) % 13 == 0, F.lit(" ")).otherwise(F.concat(doc, F.lit(":"), i.cast("string"))).alias("id"), i.alias("index"), F.when((F.col("doc_id") + i) % 17 == 0, F.lit("x")).otherwise((i + 1).cast("string")).alias("page"), x.alias("text"), F.md5(x).alias("contentHash"))
    return d.select(doc.alias("id"), F.when(F.col("doc_id") % 19 == 0, F.lit("")).otherwise(F.concat(doc, F.lit(".pdf"))).alias("filename"), F.lit("").alias("sourcePath"), F.when(F.col("doc_id") % 6 == 0, F.lit(" Draft ")).otherwise("ready").alias("status"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), chunk).alias("chunks"))


def skill_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as workflow units: only some say that they are skills, some have long names, some neither evidence nor sources."""
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    kind = F.when(F.col("p_partkey") % 3 == 0, "skill").otherwise("tool")
    name = F.when(F.col("p_partkey") % 4 == 0, F.repeat(F.concat("p_name", F.lit(" ")), 12)).otherwise(F.lit(""))
    scopes = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit('"'), F.col("p_brand"), F.lit("-"), i.cast("string"), F.lit('"'))), ","), F.lit("]"))
    context = F.concat(F.lit('{"capability":{"kind":"'), kind, F.lit('","name":"'), name, F.lit('","scope":'), scopes, F.lit("}}"))
    when = F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.col("p_partkey") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return p.select(
        F.concat(F.lit("part:"), key).alias("id"), F.when(F.col("p_size") % 5 == 0, "fact").otherwise("workflow").alias("type"), F.col("p_name").alias("summary"), F.concat("p_type", F.lit(" of "), "p_brand").alias("resolution"),
        F.when(F.col("p_partkey") % 9 == 0, "[]").otherwise(F.concat(F.lit('[{"id":"'), key, F.lit('","kind":"part"}]'))).alias("evidence_json"), context.alias("context_json"), F.lit("active").alias("status"), F.lit("memory").alias("memory_kind"),
        F.when(F.col("p_partkey") % 18 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("part:"), key))).alias("source_refs"), when.alias("updated_at"),
    )


def cjk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of which some have Chinese words in their text: every fifth document two of them apart, every third one of them twice."""
    end = F.when(F.col("doc_id") % 5 == 0, F.lit(" 风扇的阈值 control风扇")).when(F.col("doc_id") % 3 == 0, F.lit(" 阈值,阈值表")).otherwise("")
    return units(spark, sf_dir).withColumn("resolution", F.concat("resolution", end))


def legacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a legacy table: unknown types, raw and rejected ones, malformed JSON, blank summaries."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    key = k.cast("string")
    return p.select(
        F.concat(F.lit(" "), key).alias("id"), F.when(k % 4 == 0, "fact").when(k % 4 == 1, "odd type").otherwise("lesson").alias("type"), F.when(k % 17 == 0, "  ").otherwise(F.col("p_name")).alias("summary"), F.col("p_type").alias("resolution"),
        F.when(k % 13 == 0, "{}").otherwise(F.concat(F.lit('[{"id": "'), key, F.lit('"}]'))).alias("evidence_json"), F.when(k % 11 == 0, "not json").otherwise('{"a": "b"}').alias("context_json"), F.lit('["x", "y"]').alias("tags_json"),
        F.when(k % 6 == 0, "Rejected").otherwise("active").alias("status"), F.when(k % 10 == 0, " RAW").otherwise("memory").alias("memory_kind"), F.concat(F.lit('["part:'), key, F.lit('"]')).alias("source_refs_json"),
        F.lit("s").alias("session_id"), F.lit("w").alias("workspace_id"), F.lit("").alias("repo_id"), F.lit("t0").alias("created_at"), F.lit("t1").alias("updated_at"), F.lit("").alias("fingerprint"), F.lit("{}").alias("storage_targets_json"), F.lit("lazy").alias("loading_policy"), F.lit(None).cast("string").alias("last_accessed_at"),
    )


def legacy_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as legacy session contexts: evidence as objects and as plain ids, some without a session."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    evidence = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('["e'), key, F.lit('", {"id": "o"}]'))).when(F.col("c_custkey") % 7 == 0, "{").otherwise("[]")
    return c.select(F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.concat(F.lit("s"), key)).alias("session_id"), F.col("c_mktsegment").alias("workspace_id"), F.lit("").alias("repo_id"), F.lit("{}").alias("context_json"), evidence.alias("evidence_refs_json"), F.lit("[]").alias("source_refs_json"), F.lit("t0").alias("created_at"), F.lit("t1").alias("updated_at"))


def snapshot(spark: SparkSession, sf_dir: str) -> str:
    """One extension snapshot, of all conversations, as a JSON document in a folder of part files: sessions, turns, a node for every turn of an assistant, edges between
    neighbours, some to nowhere; vectors twice for some nodes. Items are in the order of their ids."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda prefix, at: F.concat(F.lit(prefix), F.col("c").cast("string"), F.lit("."), at.cast("string"))
    text_ = lambda x: F.lit(x).cast("string")
    session = F.concat(F.lit("c"), F.col("c").cast("string"))
    t, said = F.col("t"), F.col("role") == "assistant"
    turn = F.struct(name("t", t).alias("id"), session.alias("sessionId"))
    vector = F.struct(name("v", t).alias("id"), name("n", t - F.col("c") % 2).alias("sourceId"), F.when(t % 3 == 0, "candidate").alias("sourceKind"), F.array(t.cast("double"), F.lit(1.0)).alias("values"), text_("t0").alias("createdAt"))
    node = F.struct(name("n", t).alias("id"), F.when(t % 2 == 0, "fact").alias("kind"), F.when(F.col("text") != "", F.left("text", F.lit(40))).alias("label"), text_("s").alias("summary"), F.when(F.col("c") % 10 == 0, "draft").alias("status"), text_(None).alias("confidence"), F.array(name("t", t), name("t", t + 100)).alias("evidenceTurnIds"), F.lit(None).cast("array<string>").alias("tags"), text_("t0").alias("createdAt"), text_(None).alias("updatedAt"))
    edge = F.struct(name("e", t).alias("id"), name("n", t).alias("from"), name("n", t + 2).alias("to"), text_("NEXT").alias("type"), text_(None).alias("confidence"), F.array(name("t", t)).alias("evidenceTurnIds"), text_("t0").alias("createdAt"), text_(None).alias("updatedAt"))
    own = rows.select(F.struct(session.alias("id"), (F.col("c") % 4).cast("string").alias("workspaceId")).alias("x")).distinct()
    lists = {"sessions": own, "turns": rows.select(turn.alias("x")), **{k: rows.where(said).select(x.alias("x")) for k, x in (("vectors", vector), ("nodes", node), ("edges", edge))}}
    lines = [r.select(F.lit(k).alias("s"), F.lit(1).alias("kind"), F.col("x.id").alias("id"), F.to_json("x").alias("value")) for k, r in enumerate(lists.values())]
    marks = [(k, 0, "", ("{" if k == 0 else "],") + f'"{name}":[') for k, name in enumerate(lists)] + [(len(lists), 0, "", "]}")]
    all_ = reduce(DataFrame.unionByName, [*lines, spark.createDataFrame(marks, "s int, kind int, id string, value string")])
    first = F.broadcast(reduce(DataFrame.unionByName, lines).groupBy("s").agg(F.min("id").alias("first")))
    value = F.when((F.col("kind") == 1) & (F.col("id") > F.col("first")), F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value")).alias("value")
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    all_.join(first, "s", "left").select("s", "kind", "id", value).repartitionByRange("s", "kind", "id").sortWithinPartitions("s", "kind", "id").select("value").write.text(path)
    return path


def stored_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph as the write side keeps it: the entities of the catalogue, and the documents with their active pages as chunks."""
    from lodestrata.operators import graphstore as gs

    pages = units(spark, sf_dir).where("status = 'active'").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("document_id"), F.regexp_extract("summary", "^(.+) - page", 1).alias("filename"), "id", "page", F.col("resolution").alias("text"), F.col("page").alias("seq"), F.md5("resolution").alias("content_hash"), "status")
    heads = pages.groupBy("document_id").agg(F.min("filename").alias("filename"), F.lit("").alias("content_hash"), F.count("*").alias("page_count"), F.lit("active").alias("status"), F.lit(0).alias("seq"))
    entity = gs.entity_nodes(entities(spark).where("id <> ''").withColumn("seq", F.lit(0)))
    staged = entity.unionByName(gs.document_nodes(heads)).unionByName(gs.chunk_nodes(pages))
    nodes, edges = gs.empty(spark)
    return gs.merge_nodes(nodes, staged), gs.merge_edges(edges, gs.chunk_edges(pages))
