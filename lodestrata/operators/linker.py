"""Entity linking without a model: gazetteer, common-alias pruning, spans, mentions, document roll-up, shared-entity links.

An alias that begins with a word character must begin with a whole word of the text and all its words are whole ones there, so texts
and aliases meet on the alias's first words; the others, which begin with CJK or other characters, are compared by containment with a broadcast list of checked size.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as fn
from lodestrata.lineage import durable, written
from lodestrata.operators import members

#: Surfaces that name nothing by themselves.
STOPWORDS = (
    "and the for with that this from into when then there here over under about using used use case value values data item items "
    "note notes test tests code line lines page pages issue issues list step steps 结果 问题 方法 内容 说明 测试 注意 如下 其中"
).split()
#: Bounds of an alias and of a text's mentions, weights of sources.
LEAST_WORD, LEAST_CJK, LONGEST, MOST_MENTIONS, MOST_EVIDENCE = 3, 2, 80, 24, 20
WEIGHTS = {"label": 3, "alias": 2, "tag": 1}
PATHLIKE = r"(?iU)[/\\]|^\.[\w.-]+$|\.(?:md|markdown|json|jsonl|ts|tsx|js|mjs|py|sh|bash|cfg|conf|ini|ya?ml|toml|txt|log|csv|xml)\b"
#: Aliases that every task gets at most: those met on their first words, and those without one.
MOST_BROADCAST, MOST_WORDLESS = 200_000, 100_000
#: Words of an alias, the first ones, by which it is met.
KEY_WORDS = 3


def usable(alias: Column, surface: Column) -> Column:
    cjk, word = alias.rlike(f"[{fn.CJK}]"), alias.rlike("[a-z0-9_]")
    long_enough = F.when(cjk, F.length(alias) >= LEAST_CJK).otherwise(word & (F.length(alias) >= LEAST_WORD))
    return (alias != "") & (F.length(alias) <= LONGEST) & ~alias.isin(*STOPWORDS) & long_enough & ~fn.stripped(surface).rlike(PATHLIKE)


def surfaces(entities: DataFrame, include_tags: bool = False, include_aliases: bool = True) -> DataFrame:
    """``entity_id, surface, source, weight, alias, usable``: a row per surface of each entity (id, label, aliases, tags)."""
    lists = [("label", F.array(F.coalesce("label", F.lit(""))))]
    if include_aliases:
        lists.append(("alias", F.coalesce("aliases", F.array().cast("array<string>"))))
    if include_tags:
        lists.append(("tag", F.coalesce("tags", F.array().cast("array<string>"))))
    each = F.flatten(F.array(*[F.transform(c, _tagged(s)) for s, c in lists]))
    rows = entities.select(fn.stripped(F.coalesce("id", F.lit(""))).alias("entity_id"), F.explode(each).alias("x")).select("entity_id", "x.*")
    rows = rows.withColumn("alias", fn.normalized(F.col("surface")))
    return rows.withColumn("usable", (F.col("entity_id") != "") & usable(F.col("alias"), F.col("surface")))


def _tagged(source: str):  # noqa: ANN202
    return lambda x: F.struct(x.alias("surface"), F.lit(source).alias("source"), F.lit(WEIGHTS[source]).alias("weight"))


def gazetteer(entities: DataFrame, include_tags: bool = False, include_aliases: bool = True) -> DataFrame:
    """``alias, entity_id, display, source, weight, entities``: the winner of each alias, and all entities it could name.

    Heavier sources win, then smaller ids; more than one in ``entities`` makes the alias ambiguous.
    """
    rows = surfaces(entities, include_tags, include_aliases).where("usable")
    pick = F.struct((-F.col("weight")).alias("w"), "entity_id", "source", fn.stripped(F.col("surface")).alias("display"))
    best = rows.groupBy("alias").agg(F.min(pick).alias("b"), F.array_sort(F.collect_set("entity_id")).alias("entities"))
    return best.select("alias", "b.entity_id", "b.display", "b.source", (-F.col("b.w")).alias("weight"), "entities")


def normalized_texts(texts: DataFrame) -> DataFrame:
    """``id, h``: normalised texts that are not empty, kept so that they are normalised once; rows without an id go."""
    return written(texts.where(F.coalesce("id", F.lit("")) != "").select("id", fn.normalized(F.col("text")).alias("h"))).where("h <> ''")


def candidates(texts: DataFrame, names: DataFrame, whole_words: bool = True) -> DataFrame:
    """``id, h`` and the columns of ``names`` for each alias that may occur in a text (id, h).

    With ``whole_words`` an alias that begins with a word character is met on its first words, up to KEY_WORDS, so that
    aliases that share a frequent first word don't all meet the texts that have it.
    """
    if not whole_words:
        return _contained(texts, names)
    words = lambda c: F.regexp_extract_all(c, F.lit("([a-z0-9_]+)"), 1)
    names = names.withColumn("head", F.regexp_extract("alias", "^([a-z0-9_]+)", 1))
    first = F.slice(words("alias"), 1, KEY_WORDS)
    wordy = names.where("head <> ''").withColumns({"n": F.size(first), "key": F.xxhash64(first)})
    few = wordy.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    wordy = wordy if few else written(wordy)
    sizes = sorted(r.n for r in wordy.select("n").distinct().collect())
    spots = lambda w, n: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    grams = lambda w, n: F.transform(spots(w, n), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))
    keys = lambda w: F.array_distinct(F.concat(*([grams(w, n) for n in sizes] or [F.array().cast("array<bigint>")])))
    lists = texts.select("id", "h", F.flatten(F.transform(F.array(words("h")), keys)).alias("keys"))  # a text's words are found once
    if few:
        met = lists.select("id", "h", F.explode("keys").alias("key")).join(F.broadcast(wordy.drop("head", "n")), "key").where(F.contains("h", "alias")).drop("key")
    else:  # words and aliases meet without the texts, only words that may begin an alias, and each text is fetched once
        each = members.listed(lists.select("id", "keys"), wordy.select("key"), wordy.count())
        own = each.join(wordy.drop("head", "n"), "key").drop("key")
        own = own.groupBy("id").agg(F.collect_set(F.struct(*names.drop("head").columns)).alias("own"))
        met = texts.join(own, "id").select("id", "h", F.explode("own").alias("own")).select("id", "h", "own.*").where(F.contains("h", "alias"))
    return met.unionByName(_contained(texts, names.where("head = ''").drop("head")))


def _contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts`` (id, h) with each of ``names`` whose alias is anywhere in them.

    Up to MOST_WORDLESS aliases go to every task as one automaton that reads a text once; more meet the texts on their first two characters.
    """
    listed = [r.alias for r in names.select("alias").distinct().limit(MOST_WORDLESS + 1).collect()]
    if len(listed) > MOST_WORDLESS:
        pair = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("h") - 1, F.lit(1))), lambda i: F.substring(F.col("h"), i, F.lit(2)))))
        return texts.select("id", "h", pair.alias("two")).join(names.withColumn("two", F.left("alias", F.lit(2))), "two").where(F.contains("h", "alias")).drop("two")
    if not listed:
        return texts.join(names, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for alias in listed:
            finder.add_word(alias, alias)
        finder.make_automaton()
        for batch in batches:
            found = [(k, alias) for k, h in enumerate(batch.column("h").to_pylist()) for alias in {a for _, a in finder.iter(h)}]
            at = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("h").take(at), pa.array([a for _, a in found], pa.string())], names=["id", "h", "alias"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "h").mapInArrow(run, f"id {kind}, h string, alias string").join(F.broadcast(names), "alias").select("id", "h", *names.columns)


def pruned(names: DataFrame, texts: DataFrame, most_share: float = 0.25, least_texts: int = 20) -> DataFrame:
    """``names`` without the aliases that occur, anywhere, in more than a share of the texts (id, text); small corpora prune nothing."""
    rows = normalized_texts(texts)
    n = rows.count()
    if n < least_texts:
        return names
    common = _contained(rows.withColumn("id", F.monotonically_increasing_id()), names.select("alias")).groupBy("alias").agg(F.count("*").alias("n"))
    return names.join(common.where(F.col("n") > max(2.0, most_share * n)).select("alias"), "alias", "left_anti")


def spans_of(h: str = "h", alias: str = "alias") -> Column:
    """(start, end) of an alias's occurrences, left to right, not overlapping each other, at word boundaries; from 0."""
    a, text = F.col(alias), F.col(h)
    size = F.length(a)
    parts = F.split(text, F.concat(F.lit("\\Q"), a, F.lit("\\E")), -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(parts, state, lambda s, p: F.struct((s["at"] + F.length(p) + size).alias("at"), F.concat(s["out"], F.array((s["at"] + F.length(p)).cast("int"))).alias("out")), lambda s: F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))))
    edge = "[a-z0-9_]"
    head, tail = F.left(a, F.lit(1)).rlike(edge), F.right(a, F.lit(1)).rlike(edge)

    def fits(s: Column) -> Column:
        before = head & (s > 0) & F.substring(text, s, F.lit(1)).rlike(edge)
        after = tail & (s + size < F.length(text)) & F.substring(text, s + size + 1, F.lit(1)).rlike(edge)
        return ~before & ~after

    return F.transform(F.filter(starts, fits), lambda s: F.struct(s.alias("start"), (s + size).alias("end")))


def spans(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``id, start, end, alias, entity_id, display, source, weight`` of all boundary-checked occurrences in texts (id, text)."""
    rows = candidates(normalized_texts(texts), names.select("alias", "entity_id", "display", "source", "weight"))
    return rows.select("id", F.explode(spans_of()).alias("s"), "alias", "entity_id", "display", "source", "weight").select("id", "s.*", "alias", "entity_id", "display", "source", "weight")


def accepted(found: DataFrame) -> DataFrame:
    """The spans that remain when longer ones win over those they overlap, then earlier ones, then smaller entity ids.

    A text's spans are gone through in this order; what was taken is kept sorted, so a span is compared with one neighbour only.
    """
    item = F.struct((F.col("start") - F.col("end")).alias("rank"), "start", "entity_id", "end", "alias", "display", "source", "weight")
    lists = found.groupBy("id").agg(F.sort_array(F.collect_list(item)).alias("all"))
    names = ("start", "end", "alias", "entity_id", "display", "source", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("all")
            each = dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten(), strict=True))
            starts, ends = each["start"].to_pylist(), each["end"].to_pylist()
            rows, at, kept = [], 0, []
            for k, size in enumerate(pa.compute.list_value_length(lists).to_pylist()):
                first, last = [], []
                for i in range(at, at + size):
                    place = bisect_left(first, ends[i])
                    if not place or last[place - 1] <= starts[i]:
                        first.insert(place, starts[i])
                        last.insert(place, ends[i])
                        kept.append(i)
                        rows.append(k)
                at += size
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *[each[c].take(take) for c in names]], names=["id", *names])

    kinds = dict(found.dtypes)
    return lists.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("id", *names)))


def confidence(source: Column, alias: Column, occurrences: Column) -> Column:
    level = F.when(source == "tag", 2).otherwise(3) - (occurrences < 2).cast("int") - ((source == "tag") & (F.length(alias) <= 4)).cast("int")
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.greatest(level, F.lit(1)))


def mentions(texts: DataFrame, names: DataFrame, most: int = MOST_MENTIONS) -> DataFrame:
    """``id, entity_id, alias, display, source, occurrences, confidence, position``: the first ``most`` mentioned entities of each text."""
    best = F.struct((-F.col("weight")).alias("w"), (-F.length("alias")).alias("l"), "alias", "display", "source")
    rows = accepted(spans(texts, names)).groupBy("id", "entity_id").agg(F.count("*").alias("occurrences"), F.min("start").alias("position"), F.min(best).alias("b"))
    rows = rows.select("id", "entity_id", "b.alias", "b.display", "b.source", "occurrences", confidence(F.col("b.source"), F.col("b.alias"), F.col("occurrences")).alias("confidence"), "position")
    item = F.struct("position", "entity_id", "alias", "display", "source", "occurrences", "confidence")
    first = rows.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(item)), 1, most).alias("m"))
    return first.select("id", F.explode("m").alias("m")).select("id", "m.entity_id", "m.alias", "m.display", "m.source", "m.occurrences", "m.confidence", "m.position")


def rollup(found: DataFrame, documents: DataFrame) -> DataFrame:
    """``document_id, entity_id, alias, occurrences, chunks, confidence, evidence`` from mentions and documents' chunks (document_id, id, seq).

    The alias is that of the first chunk with the greatest confidence; evidence is the first chunk ids in order.
    """
    level = F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("confidence")).cast("int")
    rows = found.join(documents, "id").withColumn("level", level)
    out = rows.groupBy("document_id", "entity_id").agg(
        F.sum("occurrences").alias("occurrences"), F.count("*").alias("chunks"), F.max("level").alias("level"),
        F.max_by("alias", F.struct("level", -F.col("seq"))).alias("best"), F.min_by("alias", "seq").alias("first"),
        F.slice(F.sort_array(F.collect_list("id")), 1, MOST_EVIDENCE).alias("evidence"),
    )
    return out.select("document_id", "entity_id", F.when(F.col("level") == 1, F.col("first")).otherwise(F.col("best")).alias("alias"), "occurrences", "chunks", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("level")).alias("confidence"), "evidence")


def _overlaps(classes: DataFrame, least: int, most_of: int | None = None) -> DataFrame:
    """``ca, cb, shared, na, nb``: pairs of classes (class, n, ranked: entities with their frequency, rarest first) that share ``least`` entities or more.

    Sets that share so many have one in common among all but the ``least`` - 1 most frequent entities of either, so only these are joined, and
    counted afterwards. ``most_of``: only pairs with a common entity that so many classes have at most.
    """
    first = F.slice("ranked", F.lit(1), F.size("ranked") - least + 1)
    first = first if most_of is None else F.filter(first, lambda x: x["df"] <= most_of)
    sets = classes.where(F.size("ranked") >= least)
    entries = sets.select("class", F.explode(F.transform(first, lambda x: x["e"])).alias("e"))
    met = entries.alias("a").join(entries.alias("b"), "e").where("a.class <= b.class").select(F.col("a.class").alias("ca"), F.col("b.class").alias("cb")).distinct()
    side = lambda c: sets.select(F.col("class").alias(f"c{c}"), F.col("n").alias(f"n{c}"), F.transform("ranked", lambda x: x["e"]).alias(f"s{c}"))
    both = met.join(side("a"), "ca").join(side("b"), "cb")
    return both.select("ca", "cb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"), "na", "nb").where(F.col("shared") >= least)


#: Documents' classes that an entity may have to count as rare, when a first bound on the number of shared entities is sought.
RARE = 64


def document_pairs(rolled: DataFrame, limit: int | None, document_id: str = "") -> DataFrame:
    """``source_id, other_id, shared``: pairs of documents with the number of entities that both mention, the ``limit`` first by number and ids.

    Documents that mention the same entities are one class, so pairs are counted between classes. Pairs that meet on rare entities
    say how many entities the last of the first pairs shares at least; with two or more, the most frequent entities bring no pair together and
    are only counted. From a class at most limit + 1 documents can be among the first pairs, those with the smallest ids; only classes
    whose number of shared entities can still matter are expanded. No limit: all pairs.
    """
    sets = rolled.groupBy("document_id").agg(F.array_sort(F.collect_set("entity_id")).alias("set"))
    order = Window.partitionBy("set").orderBy("document_id")
    sized = sets.groupBy("set").agg(F.count("*").alias("n")).withColumn("class", F.xxhash64("set"))
    entries = sized.select("class", "n", F.explode("set").alias("e"))
    ranked = entries.join(entries.groupBy("e").agg(F.count("*").alias("df")), "e").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("ranked"))
    ranked = durable(ranked)
    members = sets.withColumn("class", F.xxhash64("set"))
    many = F.when(F.col("ca") == F.col("cb"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))

    def least_of(pairs: DataFrame, limit: int) -> int:
        """How many entities the ``limit``-th pair shares; 1 if there are not so many pairs."""
        least, left = 1, limit
        for level in pairs.groupBy("shared").agg(F.sum(many).alias("m")).orderBy(F.desc("shared")).toLocalIterator():
            least, left = level.shared, left - level.m
            if left <= 0:
                return least
        return 1

    if limit is not None and not document_id:
        # a pair within a class shares all its entities, so it needs no join
        own = ranked.where("n > 1").select(F.col("class").alias("ca"), F.col("class").alias("cb"), F.size("ranked").cast("long").alias("shared"), F.col("n").alias("na"), F.col("n").alias("nb"))
        rare = _overlaps(ranked, 1, RARE).where("ca <> cb").unionByName(own)
        pairs = durable(_overlaps(ranked, least_of(rare, limit)))
        pairs = pairs.where(F.col("shared") >= least_of(pairs, limit))
        members = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1)
    else:
        pairs = _overlaps(ranked, 1)
    a, b = members.select(F.col("class").alias("ca"), F.col("document_id").alias("x")), members.select(F.col("class").alias("cb"), F.col("document_id").alias("y"))
    both = pairs.select("ca", "cb", "shared").join(a, "ca").join(b, "cb").where((F.col("ca") != F.col("cb")) | (F.col("x") < F.col("y"))).where("x <> y")
    both = both.select(F.least("x", "y").alias("source_id"), F.greatest("x", "y").alias("other_id"), "shared")
    if document_id:
        both = both.where((F.col("source_id") == document_id) | (F.col("other_id") == document_id))
    return both if limit is None else both.orderBy(F.desc("shared"), "source_id", "other_id").limit(limit)


def document_links(rolled: DataFrame, entities: DataFrame, document_id: str = "", entity_ids: list[str] | None = None, limit: int | None = 8) -> DataFrame:
    """``source_id, other_id, shared, entity_ids, entity_labels, source_evidence, other_evidence``: pairs of documents that mention the same entity.

    ``entity_ids=None`` takes all entities, an empty list none. At most eight entities, by id, and three evidence chunks are shown.
    """
    rows = rolled.select("document_id", "entity_id", "evidence")
    if entity_ids is not None:
        rows = rows.where(F.col("entity_id").isin(*entity_ids) if entity_ids else F.lit(False))
    rows = durable(rows)
    top = document_pairs(rows, None if limit is None else max(1, min(limit, 50)), document_id)
    a = rows.select("entity_id", F.col("document_id").alias("source_id"), F.col("evidence").alias("ea"))
    b = rows.select("entity_id", F.col("document_id").alias("other_id"), F.col("evidence").alias("eb"))
    labels = entities.select(F.col("id").alias("entity_id"), F.coalesce("label", "id").alias("label"))
    met = top.join(a, "source_id").join(b, ["other_id", "entity_id"]).join(labels, "entity_id", "left")
    item = F.struct("entity_id", F.coalesce("label", "entity_id").alias("label"))
    out = met.groupBy("source_id", "other_id", "shared").agg(
        F.slice(F.array_sort(F.collect_set(item)), 1, 8).alias("e"),
        F.slice(F.flatten(F.array_sort(F.collect_set("ea"))), 1, 3).alias("source_evidence"), F.slice(F.flatten(F.array_sort(F.collect_set("eb"))), 1, 3).alias("other_evidence"),
    )
    out = out.select("source_id", "other_id", "shared", F.transform("e", lambda x: x["entity_id"]).alias("entity_ids"), F.transform("e", lambda x: x["label"]).alias("entity_labels"), "source_evidence", "other_evidence")
    return out if limit is None else out.orderBy(F.desc("shared"), "source_id", "other_id")


def planned_links(rolled: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """The pairs that relinking would add: uncapped entities, each labelled by its alphabetically last alias."""
    label = names.groupBy("entity_id").agg(F.max_by("display", "alias").alias("label"))
    rows = durable(rolled.select("document_id", "entity_id"))
    top = document_pairs(rows, limit)
    met = top.join(rows.withColumnRenamed("document_id", "source_id"), "source_id").join(rows.withColumnRenamed("document_id", "other_id"), ["other_id", "entity_id"]).join(label, "entity_id", "left")
    item = F.struct("entity_id", F.coalesce("label", "entity_id").alias("label"))
    out = met.groupBy("source_id", "other_id").agg(F.array_sort(F.collect_set(item)).alias("e"))
    out = out.select("source_id", "other_id", F.size("e").alias("shared"), F.transform("e", lambda x: x["entity_id"]).alias("entity_ids"), F.transform("e", lambda x: x["label"]).alias("entity_labels"))
    return out.orderBy(F.desc("shared"), "source_id", "other_id")
