"""The thin queries over the operators of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import byte_bpe, chat, decontaminate, fingerprint, html, lines, packing, phrases, quality, simhash, substrings, suffix_tree, vector_codes
from lodestrata.llm.common import durable, joined_hot, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "host", "path", "low_p", "toxic_p", "low_host", "low_path", "toxic_host", "toxic_path", "keep")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tree = suffix_tree.train(docs.where(~suffix_tree.is_held_out(F.col("doc_id"))))
    out = suffix_tree.score(docs, tree)
    return out.select("doc_id", suffix_tree.is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tree.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near``: for ids divisible by 100, the other documents within the radius of the fingerprint; null for the rest."""
    made = durable(fingerprint.fingerprint_documents(table(spark, sf_dir, "documents")).withColumn("asked", F.coalesce(F.expr("doc_id % 100 = 0"), F.lit(False))))
    sizes = durable(made.groupBy("fp").agg(F.count("*").alias("all"), F.count_if("asked").alias("n")))
    near = fingerprint.within(sizes.where("n > 0"), sizes).join(sizes, "fp").groupBy("query").agg((F.sum("all") - 1).alias("n_near"))
    found = durable(near.withColumnRenamed("query", "fp").join(sizes.select("fp", "n"), "fp"))
    out = joined_hot(made.where("asked"), found, "fp").unionByName(made.where("not asked").withColumn("n_near", F.lit(None).cast("long")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", simhash.hex16("fp").alias("fingerprint"), simhash.hex16("edited_fp").alias("edited_fingerprint"),
        fingerprint.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), fingerprint.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = chat.format_chats(turns).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    whole = F.array_join(F.transform("turns", lambda u: F.concat(u["role"], F.lit("\n"), u["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.encode("masked", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after the host's boilerplate lines are gone, with the counts before and after."""
    docs = table(spark, sf_dir, "documents")
    before = docs.withColumn("lines_in", F.size(lines.lines_of(F.col("text"))))
    out = lines.drop_site_lines(before)
    left = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select("doc_id", "source", F.col("lines_in").cast("long").alias("lines_in"), F.coalesce(left, F.lit(0)).cast("long").alias("lines_kept"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.lit(books.joined()), 256).alias("codebooks_sha256")
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", digest)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks_path(), decoded=True)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(text, "UTF-8"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_lm_scoring, op3_benchmark_decontamination, op4_html_extraction, op5_packing, op6_simhash_near_dedup, op7_document_fingerprints, op8_suffix_array_dedup, op9_chat_formatting, op10_line_dedup, op11_vector_code_compression, op12_byte_bpe, op13_phrase_collocations)}

ORACLE_SQL = {
    "op9_chat_formatting": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s as (
  select *, replace(replace(replace(text, '\', '\s'), '<', '\l'), '#', '\h') as x, replace(replace(replace(replace(role, '\', '\s'), '<', '\l'), '#', '\h'), ':', '\c') as y from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, x)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, x) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(x) + length(y) + 14) as bigint) as formatted_chars
from s group by conv_id""",
    "op10_line_dedup": r"""
with p as (select doc_id, coalesce(source, '') as source, text, string_split(coalesce(text, ''), chr(10)) as l from documents),
n as (select source, count(*) as pages from p group by source),
c as (select source, s, count(*) as k from (select source, unnest(list_distinct(list_transform(l, lambda x: trim(x, ' ')))) as s from p) where s <> '' group by source, s),
b as (select c.source, list(s) as drops from c join n using (source) where k >= 3 and k > 0.1 * pages group by c.source),
j as (select doc_id, source, l, text, case when drops is null then l else list_filter(l, lambda x: not list_contains(drops, trim(x, ' '))) end as kept from p left join b using (source))
select doc_id, source, cast(len(l) as bigint) as lines_in,
  cast(case when coalesce(array_to_string(kept, chr(10)), '') = '' then 0 else len(kept) end as bigint) as lines_kept,
  md5(coalesce(array_to_string(kept, chr(10)), '')) as text_md5
from j""",
    "op11_vector_code_compression": """
with v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as materialized (
  select vec_id, k as part, e[k * len(e) // 4 + 1 : (k + 1) * len(e) // 4] as x from v, range(4) t(k)
), c0 as materialized (
  select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as c from p where vec_id in (select vec_id from v order by vec_id limit 256)
)""" + "".join(f"""
, a{r} as materialized (
  select vec_id, part, x, m.entry, m.error from (
    select vec_id, part, any_value(x) as x, min({{'error': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'entry': entry}}) as m
    from p join c{r} using (part) group by vec_id, part)
)""" + ("" if r == 4 else f""", s{r} as materialized (
  select part, entry, list((t - ((t % n) + n) % n) // n order by i) as c from (
    select part, entry, i, sum(x[i]) as t, count(*) as n from a{r}, range(1, 17) g(i) group by all) group by part, entry
), c{r + 1} as materialized (
  select part, entry, coalesce(s{r}.c, c{r}.c) as c from c{r} left join s{r} using (part, entry)
)""") for r in range(5)) + """
, w as (select vec_id, label, string_agg(printf('%02x', a4.entry), '' order by part) as code, cast(sum(error) as bigint) as error from a4 join v using (vec_id) group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) from c4) as codebooks_sha256
from w""",
    "op13_phrase_collocations": r"""
with p as materialized (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)
), g as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p, range(1, 6) t(k))
), f as materialized (
  select lang, k, phrase, string_split(phrase, ' ') as w, count(*) as a from g group by all having count(*) >= 100
), n as (select lang, sum(len(w)) as n from p group by lang
), c as materialized (
  select f.lang, f.phrase, f.k, f.a, cut, l.a as l, r.a as r, n.n, (1000 * f.a::hugeint * n.n::hugeint) // (l.a::hugeint * r.a::hugeint) as score
  from (select *, unnest(range(1, k)) as cut from f where k > 1) f join n on n.lang = f.lang
  join f l on l.lang = f.lang and l.phrase = array_to_string(f.w[: cut], ' ') join f r on r.lang = f.lang and r.phrase = array_to_string(f.w[cut + 1 :], ' ')
), b as (select * from c qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inside as materialized (
  select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(a) as a from (select *, unnest(range(1, k - m + 2)) as i from f, range(2, 5) t(m) where m < k) group by all
), d as (
  select b.* from b left join inside using (lang, phrase) where inside.a is null or 100 * inside.a < 100 * b.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from d qualify rank <= 2000""",
}
