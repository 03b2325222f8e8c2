"""Language-model scoring with a probabilistic suffix tree.

Symbols are words; the tree is a table. A context of up to ``DEPTH`` symbols is a candidate from ``LEAST_CONTEXT``
occurrences on, and stores a next symbol from ``LEAST_NEXT`` occurrences on: absolute counts, so the tree grows with
the corpus. A candidate is kept if the divergence of what follows it from what follows its suffix, times its count,
pays for its parameters; one that isn't kept behaves like its suffix. Distributions are smoothed towards the
suffix's (Witten-Bell), the shortest towards discounted word counts, and those towards a model of the bytes of a word, so all words, seen
or not, together have a probability of one at most. A token is scored from the longest kept suffix of what precedes it.

Counting is distributed and covers all training texts. Each length is one pass, which leaves out sequences whose two
parts can't be frequent enough; it knows them by bit tables of a bounded size. Workers get the most frequent rows of the
tree, HOT_ROWS at most; what a token needs beyond them is joined with the rest of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import durable, written
from lodestrata.llm.common import STEP_BYTES, buffers, slices
from lodestrata.llm.tokens import LOWER, SPACE, mixed, weighed_words
from lodestrata.operators import members

#: Occurrences of a context, and of a next symbol after it, from which on they are counted.
LEAST_CONTEXT, LEAST_NEXT = 100, 10
DEPTH = 3
#: What each next symbol that a context stores must pay in nats, over all its occurrences.
PRICE = 2.0
#: Rows of the tree that every worker gets, the most frequent contexts, in half of them at most, and the most frequent others.
HOT_ROWS = 2_000_000
#: Sequences that a task sums before it sends them on, and the most of them in one batch.
HELD, SENT = 1_000_000, 100_000
#: Contexts with more than this share of the tokens, of which there are 1 / SHARE at most, are dealt out by the first bits of the next symbol too.
SHARE, SALT_BITS = 1e-3, 6
#: The hashes that stand for the end of a text and for what precedes it.
END, BEGIN = np.uint64(0x5EED0E0D0E0D5EED), np.uint64(0x0BE61D0E6150BE61)


@dataclass
class Tree:
    """``words``: all training words (key, n). ``facts``: rows (key, n, own, bow) of frequent words and kept contexts.

    ``own`` is what a context itself gives to a next symbol, keyed by the hash of both; ``bow``, keyed by the context's
    hash, the weight of its suffix's distribution. ``keys, n, own, bow`` are the hot rows, sorted by key; rarer rows are
    in ``cold`` (None: there are none), and ``cold_own`` and ``cold_bow``, tables of ``members``, tell which hashes may have an own or a bow there (``cold_contexts``: some have a bow). ``spread`` has log10
    probabilities of 256 bytes and the end of a word, ``known_from`` the count from which all words are among the hot rows.
    """

    words: DataFrame
    facts: DataFrame
    cold: DataFrame | None
    cold_contexts: bool
    train_tokens: int
    distinct: int
    discount: float
    depth: int
    known_from: int
    sent: object

    def word_log10(self, n: Column, letters: Column) -> Column:
        """log10 of a word's probability without context; ``letters`` is the byte model's."""
        if not self.train_tokens:
            return letters
        return F.when(n > 0, F.log10((n - self.discount) / self.train_tokens)).otherwise(letters + float(np.log10(self.discount * self.distinct / self.train_tokens)))


@dataclass
class Hot:
    """What workers get of a tree."""

    keys: np.ndarray
    n: np.ndarray
    own: np.ndarray
    bow: np.ndarray
    spread: np.ndarray
    cold_own: tuple[np.ndarray, int] | None
    cold_bow: tuple[np.ndarray, int] | None
    train_tokens: int
    distinct: int
    discount: float
    depth: int
    starts: np.ndarray | None = None

    def look(self, h: np.ndarray) -> np.ndarray:
        """The rows of hashes, -1 for those that are not among them. Keys are spread evenly, so their first bits lead to within a few rows."""
        bits = max(1, len(self.keys).bit_length())
        if self.starts is None:
            self.starts = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
            self.starts = np.append(self.starts, np.int32(len(self.keys)))
        out = np.full(len(h), -1, np.int32)
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        on = np.flatnonzero(at < end)
        at, end, own = at[on], end[on], h[on]
        while len(on):
            same = self.keys[at] == own
            out[on[same]] = at[same]
            at += 1
            left = ~same & (at < end)
            on, at, end, own = on[left], at[left], end[left], own[left]
        return out


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def framed(texts: pa.Array, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens between BEGIN and END, the row of each, its place there (BEGIN: 0), and the words' sums of weights."""
    h, rows, sums = weighed_words(texts, weights)
    n = len(texts)
    ends = np.cumsum(np.bincount(rows, minlength=n))
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    at = np.concatenate((starts, ends))
    order = np.argsort(np.concatenate((2 * np.arange(n), 2 * np.arange(n) + 1)), kind="stable")
    h = np.insert(h, at[order], np.tile(np.array([BEGIN, END]), n))
    rows = np.insert(rows, at[order], np.repeat(np.arange(n), 2))
    if weights is not None:
        sums = np.insert(sums, at[order], 0.0)
    begin = starts + 2 * np.arange(n)
    place = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    return h, rows, place, sums


def joint(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of it without its last and without its first symbol."""
    return mixed(context * np.uint64(0x9E3779B97F4A7C15) + suffix)


def sequences(h: np.ndarray, most: int) -> list[np.ndarray]:
    """For each length up to ``most`` the hashes of the sequences that end at each token; those that cross rows are meaningless."""
    out = [h]
    for _ in range(1, most):
        out.append(joint(np.concatenate((h[:1], out[-1][:-1])), out[-1]))
    return out


def bits_of(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A table of ``members`` for the keys of ``rows``."""
    return members.table_of(rows.select("key"), rows.count())


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def word_counts(texts: DataFrame) -> DataFrame:
    """``kind, key, n``: kind 0 counts words and ends, kind 1 the bytes inside words, in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                h, _, place, _ = framed(part.column("text"))
                key, n = np.unique(h[place > 0], return_counts=True)
                letters = np.bincount(LOWER[buffers(part.column("text"))[0]], minlength=256)
                letters[SPACE] = 0
                seen = np.flatnonzero(letters)
                for kind, k, c in ((0, signed(key), n), (1, pa.array(seen), letters[seen])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), k, pa.array(c.astype(np.int64))], names=["kind", "key", "n"])

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def sequence_counts(texts: DataFrame, length: int, contexts: tuple[np.ndarray, int], suffixes: tuple[np.ndarray, int], hot: np.ndarray) -> DataFrame:
    """``key, context, suffix, n`` of sequences of ``length`` symbols with LEAST_NEXT occurrences; both bit tables must have their parts.

    Tasks send what follows a context in one run, whose rows compress well, and to one task. ``hot`` has the hashes of contexts whose followers are dealt out among tasks.
    """
    sent = texts.sparkSession.sparkContext.broadcast((contexts, suffixes, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_context, of_suffix, dealt = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
            n = np.diff(np.append(first, len(a))).astype(np.int32)
            a, b = a[first], b[first]
            salt = np.where(np.isin(a, dealt), b >> np.uint64(64 - SALT_BITS), np.uint64(0)).astype(np.int32)
            for at in range(0, len(a), SENT):
                some = slice(at, at + SENT)
                yield pa.RecordBatch.from_arrays([signed(a[some]), pa.array(salt[some]), signed(b[some]), pa.array(n[some])], names=["context", "salt", "suffix", "n"])

        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                h, _, place, _ = framed(part.column("text"))
                whole = sequences(h, length - 1)[-1]
                at = np.flatnonzero(place >= length - 1)
                a, b = whole[at - 1], whole[at]
                on = members.set_in(*of_context, a)
                on[on] = members.set_in(*of_suffix, b[on])
                held.append((a[on], b[on]))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from summed()
        if held:
            yield from summed()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(c), dtype=np.int64).view(np.uint64) for c in ("context", "suffix"))
            yield pa.RecordBatch.from_arrays([signed(joint(a, b)), *batch.columns], names=["key", *batch.schema.names])

    each = texts.mapInArrow(run, "context long, salt int, suffix long, n int").repartition("context", "salt")
    found = each.groupBy("context", "salt", "suffix").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_NEXT).drop("salt")
    return found.mapInArrow(named, "key long, context long, suffix long, n long")


def fitted(rows: DataFrame, below: DataFrame, contexts: DataFrame, price: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` (key, n, p, own) of one length, and its kept contexts (key, n, bow).

    ``below`` (key, p) has the suffixes' smoothed probabilities, ``contexts`` (key, n) the candidates. What a context
    doesn't store is one more outcome of the divergence.
    """
    whole = contexts.select(F.col("key").alias("context"), F.col("n").alias("whole"))
    both = durable(rows.join(below.select(F.col("key").alias("suffix"), F.col("p").alias("q")), "suffix").join(whole, "context"))
    sums = both.groupBy("context").agg(F.first("whole").alias("whole"), F.sum("n").alias("stored"), F.count("*").alias("kinds"), F.sum("q").alias("q"), F.sum(F.col("n") * F.log(F.col("n") / F.col("whole") / F.col("q"))).alias("gain"))
    rest = F.col("whole") - F.col("stored")
    gain = F.col("gain") + F.when(rest > 0, rest * F.log(rest / F.col("whole") / F.greatest(1 - F.col("q"), F.lit(1e-12)))).otherwise(0.0)
    bow = (rest + F.col("kinds")) / (F.col("whole") + F.col("kinds"))
    kept = sums.where(gain > price * (F.col("kinds") + 1)).select("context", "kinds", F.col("whole").alias("weight"), bow.alias("bow"))
    own = F.col("n") / (F.col("whole") + F.col("kinds"))
    out = both.join(kept.select("context", "kinds", "bow"), "context", "left")
    out = out.select("key", "n", F.when(F.col("bow").isNull(), F.col("q")).otherwise(own + F.col("bow") * F.col("q")).alias("p"), F.when(F.col("bow").isNotNull(), own).alias("own"))
    return durable(out), durable(kept.select(F.col("context").alias("key"), F.col("weight").alias("n"), "bow"))


def train(docs: DataFrame, text: str = "text", depth: int = DEPTH, price: float = PRICE, hot_rows: int | None = None) -> Tree:
    """The tree of every text of ``docs``. Null text: empty. No rows: words have the byte model's probabilities only."""
    texts = docs.select(F.col(text).alias("text"))
    spark, most = texts.sparkSession, HOT_ROWS if hot_rows is None else hot_rows
    found = durable(word_counts(texts))
    words = found.where("kind = 0").select("key", "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"), F.coalesce(F.sum(F.when(F.col("key") == int(END.astype(np.int64)), F.col("n"))), F.lit(0)).alias("texts")).first()
    total, distinct = int(sums.n), int(sums.v)
    discount = min(0.9, max(0.1, sums.one / (sums.one + 2 * sums.two))) if sums.one else 0.5
    letters = found.where("kind = 1").toPandas()
    spread = np.ones(257)
    spread[letters["key"].to_numpy(np.int64)] += letters["n"].to_numpy(np.int64)
    spread[256] += total
    spread = np.log10(spread / spread.sum())

    often = words.where(F.col("n") >= LEAST_NEXT)
    below = often.select("key", "n", ((F.col("n") - discount) / max(total, 1)).alias("p"))
    first = spark.createDataFrame([(int(BEGIN.astype(np.int64)), int(sums.texts))], "key long, n long")
    contexts = often.unionByName(first).where(F.col("n") >= LEAST_CONTEXT)
    none = F.lit(None).cast("double")
    parts = [often.select("key", "n", F.col("n").alias("weight"), none.alias("own"), none.alias("bow"))]
    for d in range(1, depth + 1):
        hot = [r.key for r in contexts.where(F.col("n") > SHARE * total).select("key").collect()]
        rows = sequence_counts(texts, d + 1, bits_of(contexts), bits_of(below), np.array(hot, np.int64).view(np.uint64))
        below, kept = fitted(rows, below, contexts, price)
        parts.append(below.where("own is not null").select("key", F.lit(None).cast("long").alias("n"), F.col("n").alias("weight"), "own", none.alias("bow")))
        parts.append(kept.select("key", F.lit(None).cast("long").alias("n"), F.col("n").alias("weight"), none.alias("own"), "bow"))
        contexts = below.where(F.col("n") >= LEAST_CONTEXT).select("key", "n")
    facts = durable(reduce(DataFrame.unionByName, parts).groupBy("key").agg(*[F.max(c).alias(c) for c in ("n", "weight", "own", "bow")]))
    # contexts have up to half of the rows before others: without them a worker can't tell what else a token needs
    contexts = F.col("bow").isNotNull()
    least_context = frequent_from(facts.where(contexts), most // 2)
    least = frequent_from(facts.where(~contexts), most - facts.where(contexts & (F.col("weight") >= least_context)).count())
    is_hot = F.col("weight") >= F.when(contexts, least_context).otherwise(least)
    hot = facts.where(is_hot)
    hot = hot.select("key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("own").cast("float"), F.lit(float("nan"))).alias("own"), F.coalesce(F.col("bow").cast("float"), F.lit(float("nan"))).alias("bow")).toArrow()
    least = max(least, least_context)
    cold = facts.where(~is_hot).drop("weight") if least > LEAST_NEXT else None
    key = hot["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    values = [np.asarray(hot[c].to_numpy(), dtype=t)[order] for c, t in (("n", np.int64), ("own", np.float32), ("bow", np.float32))]
    bits: list = [None, None]
    if cold is not None:
        bits = [bits_of(cold.where(F.col(c).isNotNull())) for c in ("own", "bow")]
        bits = bits if bits[1][0].any() else [bits[0], None]
    sent = spark.sparkContext.broadcast(Hot(key[order], *values, spread, *bits, total, distinct, discount, depth))
    return Tree(words, facts, cold, bits[1] is not None, total, distinct, discount, depth, least, sent)


def frequent_from(facts: DataFrame, most: int) -> int:
    """The least weight, LEAST_NEXT or more, from which on ``facts`` has ``most`` rows at most; LEAST_NEXT: all of them. Weights are told apart to a sixteenth of their binary logarithm."""
    step = F.floor(F.log2(F.col("weight").cast("double")) * 16).alias("step")
    at, left = 1 << 62, most
    for r in facts.groupBy(step).agg(F.count("*").alias("rows"), F.min("weight").alias("least")).orderBy(F.desc("step")).collect():
        if r.rows > left:
            return at
        left, at = left - r.rows, r.least
    return LEAST_NEXT


def slot(name: str, d: int) -> str:
    return f"{name}{d}"


def score(docs: DataFrame, tree: Tree, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every text.

    ``base_score`` is the add-one unigram log10 probability, ``score`` the tree's log10 probability of the whole text. Null text: empty,
    whose only token is its end. Null ids and repeated rows are documents of their own; other columns are ignored; no rows give no rows.
    """
    sent, depth = tree.sent, tree.depth
    whole = tree.train_tokens + tree.distinct + 1
    values = [*(slot("own", d) for d in range(1, depth + 1)), *(slot("bow", d) for d in range(1, depth + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                size = part.num_rows
                h, rows, place, sums = framed(part.column("text"), m.spread[:256].take(LOWER))
                sums += m.spread[256]
                grams = sequences(h, depth + 1)
                found = [m.look(grams[0])]
                open_, hard = np.zeros(len(h), bool), np.zeros(len(h), bool)
                p = np.ones(len(h))
                n = np.where(found[0] >= 0, m.n[found[0]], 0) if len(m.keys) else np.zeros(len(h), np.int64)
                known = n > 0
                p[known] = (n[known] - m.discount) / m.train_tokens
                given = np.where(known, p, 0.0)  # what is known of the probability
                facts: dict[str, np.ndarray] = {}
                weights: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for d in range(1, depth + 1):
                    here = np.flatnonzero(place >= d)
                    context = found[d - 1][here - 1]
                    bow = np.where(context >= 0, m.bow[context], np.nan) if len(m.keys) else np.full(len(here), np.nan)
                    on = np.ones(len(here), bool) if m.cold_own is not None or d < depth else ~np.isnan(bow)
                    at = np.full(len(h), -1)
                    at[here[on]] = m.look(grams[d][here[on]])
                    found.append(at)
                    own = np.where(at[here] >= 0, m.own[at[here]], np.nan) if len(m.keys) else np.full(len(here), np.nan)
                    if m.cold_own is not None:
                        ask_bow = (context < 0) & members.set_in(*m.cold_bow, grams[d - 1][here - 1]) if m.cold_bow is not None else np.zeros(len(here), bool)
                        ask_own = (at[here] < 0) & (ask_bow | ~np.isnan(bow))  # else the context isn't kept, and has nothing of its own
                        ask_own[ask_own] = members.set_in(*m.cold_own, grams[d][here[ask_own]])
                        hard[here[ask_bow]] = True
                        for name, value, ask, key in (("own", own, ask_own, grams[d][here]), ("bow", bow, ask_bow, grams[d - 1][here - 1])):
                            open_[here[ask]] = True
                            facts[slot(name, d)], facts[f"{slot(name, d)}_key"] = np.full(len(h), np.nan), np.zeros(len(h), np.uint64)
                            facts[slot(name, d)][here], facts[f"{slot(name, d)}_key"][here] = value, np.where(ask, key, 0)
                    kept = ~np.isnan(bow)
                    p[here[kept]] = np.nan_to_num(own[kept].astype(np.float64)) + bow[kept] * p[here[kept]]
                    given[here[kept]] = np.nan_to_num(own[kept].astype(np.float64)) + bow[kept] * given[here[kept]]
                    weights.append((here, kept, bow))
                token = place > 0
                open_ |= ~known & (given > 0)  # the word's own count matters to the sum
                sure, asked = token & ~open_, token & open_
                base = np.full(len(h), -np.log10(whole))
                base[known] += np.log10(n[known] + 1.0)
                rare = np.flatnonzero(token & ~known)  # the word's own count is yet to be looked up
                rare = rare[np.argsort(rows[rare], kind="stable")]
                ends = np.concatenate(([0], np.cumsum(np.bincount(rows[rare], minlength=size)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([signed(h[rare]), pa.array(sums[rare]), pa.array(sure[rare])], ["key", "letters", "alone"]))
                cols = [part.column("doc_id"), pa.array(np.bincount(rows[token], minlength=size)), pa.array(np.bincount(rows[token & known], minlength=size)), pa.array(np.bincount(rows[token], base[token], size)), pa.array(np.bincount(rows[sure], np.log10(p[sure]), size)), lists]
                names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"]
                if m.cold_own is not None:
                    asks = asked_for(asked & ~hard, known, h, given, sums, weights, facts)
                    asks = asks[np.argsort(rows[asks["token"]], kind="stable")]
                    ends = np.concatenate(([0], np.cumsum(np.bincount(rows[asks["token"]], minlength=size)))).astype(np.int32)
                    each = [pa.array(asks["at"]), signed(asks["key"]), pa.array(asks["base"]), pa.array(asks["coef"]), pa.array(asks["letters"], from_pandas=True)]
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(each, ["at", "key", "base", "coef", "letters"])))
                    names.append("asks")
                if m.cold_bow is not None:
                    some = np.flatnonzero(asked & hard)
                    ends = np.concatenate(([0], np.cumsum(np.bincount(rows[some], minlength=size)))).astype(np.int32)
                    fields = {"word": signed(h[some]), "letters": pa.array(sums[some]), "n": pa.array(n[some])}
                    for v in values:
                        fields |= {v: pa.array(facts[v][some].astype(np.float64), from_pandas=True), f"{v}_key": signed(facts[f"{v}_key"][some])}
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields))))
                    names.append("open")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    cold = tree.cold is not None
    field = "word: bigint, letters: double, n: bigint, " + ", ".join(f"{v}: double, {v}_key: bigint" for v in values)
    ask = "array<struct<at: int, key: bigint, base: double, coef: double, letters: double>>"
    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<struct<key: bigint, letters: double, alone: boolean>>" + (f", asks {ask}" if cold else "") + (f", open array<struct<{field}>>" if tree.cold_contexts else "")
    parts = written(source.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()))
    asked = parts.select("__row", F.explode("rare").alias("r")).select("__row", "r.*")
    few = tree.words.where(F.col("n") < tree.known_from)
    n = F.coalesce("n", F.lit(0))
    found = asked.join(few, "key", "left").groupBy("__row").agg(F.count_if(n > 0).alias("__k"), F.sum(F.log10(n + 1)).alias("__b"), F.sum(F.when(F.col("alone"), tree.word_log10(n, F.col("letters"))).otherwise(0.0)).alias("__s"))
    out = parts.drop("rare", "asks", "open").join(found, "__row", "left")
    added = F.coalesce("__s", F.lit(0.0))
    if cold:
        sums = weighed(parts, tree)
        sums = sums.unionByName(joined(parts, tree, values)) if tree.cold_contexts else sums
        out = out.join(sums.groupBy("__row").agg(F.sum("__t").alias("__t")), "__row", "left")
        added += F.coalesce("__t", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("__k", F.lit(0))).alias("n_known"), (F.col("base_score") + F.coalesce("__b", F.lit(0.0))).alias("base_score"), (F.col("score") + added).alias("score"))


#: What is looked up for a token: ``at`` names the token in its row if it has more than one, and is -1 otherwise.
ASK = np.dtype([("token", np.int64), ("at", np.int32), ("key", np.uint64), ("base", np.float64), ("coef", np.float64), ("letters", np.float64)])


def asked_for(some: np.ndarray, known: np.ndarray, h: np.ndarray, given: np.ndarray, sums: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray, np.ndarray]], facts: dict[str, np.ndarray]) -> np.ndarray:
    """What to look up for ``some`` tokens, all of whose kept contexts are known: the probability is then what is ``given``, the first one's ``base``, and for
    each row that is looked up its value times ``coef``, the product of the weights of the longer contexts. Words that aren't ``known`` are looked up too; they
    have ``letters``."""
    coef, out = np.ones(len(h)), []
    for d in range(len(weights), 0, -1):
        here, kept, bow = weights[d - 1]
        token = np.flatnonzero(some & (facts[f"{slot('own', d)}_key"] != 0))
        out.append((token, facts[f"{slot('own', d)}_key"][token], coef[token], np.full(len(token), np.nan)))
        coef[here[kept]] *= bow[kept]
    token = np.flatnonzero(some & ~known)
    out.append((token, h[token], coef[token], sums[token]))
    asks = np.zeros(sum(len(x[0]) for x in out), ASK)
    for name, values in zip(("token", "key", "coef", "letters"), zip(*out, strict=True), strict=True):
        asks[name] = np.concatenate(values)
    token, first, times = np.unique(asks["token"], return_index=True, return_counts=True)
    asks["base"][first] = given[token]
    asks["at"] = np.where(np.bincount(asks["token"], minlength=len(h))[asks["token"]] > 1, asks["token"], -1)
    return asks


def rare_rows(tree: Tree) -> DataFrame:
    """What workers don't have: rows of the tree and words of few occurrences."""
    return tree.cold.unionByName(tree.words.where(F.col("n") < LEAST_NEXT).select("key", "n", *[F.lit(None).cast("double").alias(c) for c in ("own", "bow")]))


def weighed(parts: DataFrame, tree: Tree) -> DataFrame:
    """``__row, __t``: sums of log10 probabilities of the tokens whose contexts are known, from what they lack (``asked_for``); nothing else of a token is shuffled."""
    asked = parts.select("__row", F.explode("asks").alias("a")).select("__row", "a.*")
    got = asked.join(rare_rows(tree).select("key", "n", "own"), "key", "left")
    word, unseen = F.col("letters").isNotNull(), F.coalesce("n", F.lit(0)) == 0
    low = tree.word_log10(F.coalesce("n", F.lit(0)), F.col("letters"))
    value = F.when(word, F.pow(F.lit(10.0), low)).otherwise(F.coalesce("own", F.lit(0.0)))
    # a word of very many bytes has a probability that no number can hold
    got = got.select("__row", "at", (F.col("base") + F.col("coef") * value).alias("p"), F.when(word & unseen, F.log10("coef") + low).alias("low"))
    one, whole = F.col("at") < 0, lambda p, low: F.when(p > 0, F.log10(p)).otherwise(low)
    each = got.groupBy("__row", "at").agg(F.sum(F.when(one, whole(F.col("p"), F.col("low")))).alias("t"), F.sum(F.when(~one, F.col("p"))).alias("p"), F.max(F.when(~one, F.col("low"))).alias("low"))
    return each.select("__row", F.when(one, F.col("t")).otherwise(whole(F.col("p"), F.col("low"))).alias("__t"))


def joined(parts: DataFrame, tree: Tree, values: list[str]) -> DataFrame:
    """``__row, __t``: log10 probabilities of the tokens that need contexts which workers don't have. A hot row is never asked
    for, so no key that is asked for has more than its share of the tokens, whatever the corpus."""
    tokens = parts.select("__row", F.posexplode("open").alias("__at", "t")).select("__row", "__at", "t.*")
    facts = rare_rows(tree)
    asks = [F.struct(F.lit(v).alias("slot"), F.col(f"{v}_key").alias("key")) for v in values] + [F.struct(F.lit("n").alias("slot"), F.when(F.col("n") == 0, F.col("word")).otherwise(F.lit(0)).alias("key"))]
    asked = tokens.select("__row", "__at", F.explode(F.filter(F.array(*asks), lambda a: a["key"] != 0)).alias("a")).select("__row", "__at", "a.*")
    got = asked.join(facts, "key").groupBy("__row", "__at").agg(F.max(F.when(F.col("slot") == "n", F.col("n"))).alias("__n"), *[F.max(F.when(F.col("slot") == v, F.col(v[:3]))).alias(f"__{v}") for v in values])
    both = tokens.join(got, ["__row", "__at"], "left")
    p = F.pow(F.lit(10.0), tree.word_log10(F.greatest("n", F.coalesce("__n", F.lit(0))), F.col("letters")))
    for d in range(1, tree.depth + 1):
        own, bow = (F.coalesce(F.col(slot(x, d)), F.col(f"__{slot(x, d)}")) for x in ("own", "bow"))
        p = F.when(bow.isNull(), p).otherwise(F.coalesce(own, F.lit(0.0)) + bow * p)
    return both.groupBy("__row").agg(F.sum(F.log10(p)).alias("__t"))
