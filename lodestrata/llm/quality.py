"""Quality and toxicity by hierarchical empirical Bayes.

A document's own evidence is a logistic model over style features and a learned lexicon, fitted on a bounded
sample of labelled rows. Its probabilities, summed by host and by path within the host, give posteriors of each
site: a host with few pages is drawn towards the global rate, a path with few pages towards its host's, each by
as many pseudo-pages as the spread between sites calls for. The site's log-odds against the global rate
then shift the document's. Sites are grouped sums, so a host with a third of all pages costs a row per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import STEP_BYTES, buffers, durable, slices
from lodestrata.llm.tokens import PUNCTUATION, SPACE, word_hashes

#: Labelled rows that the document model is fitted on, at most.
SAMPLE = 20_000
#: A lexicon entry is in so many sampled texts, once or twice at least, and this many standard deviations off the label's rate.
LEAST_TEXTS, DEVIATIONS = 5, 6.0
#: Most that a site's record can shift a document's log-odds.
MOST_SHIFT = 2.0
#: Sites up to which their posteriors are broadcast.
BROADCAST_SITES = 100_000
HEADS = ("low", "toxic")

#: Byte classes: every ASCII punctuation mark on its own, then upper and lower case, digits, white space, other bytes.
MARKS = [x for x in range(33, 127) if not chr(x).isalnum()]
KINDS = np.full(256, len(MARKS) + 4, dtype=np.int64)
KINDS[MARKS] = np.arange(len(MARKS))
KINDS[65:91], KINDS[97:123], KINDS[48:58], KINDS[SPACE] = (len(MARKS) + k for k in range(4))
N_KINDS = len(MARKS) + 5
N_STYLE = N_KINDS + 4
#: After the style: for each head a sum over the lexicon entries that a text has, and its rate over all words.
N_FEATURES = N_STYLE + 4
#: Bytes of the beginnings of longer words that are entries besides the words themselves.
STEMS = (4, 6)
#: Most that the rate of lexicon words counts.
MOST_RATE = 0.5


@dataclass
class Model:
    """``lexicon``: sorted hashes; ``weight``: log-ratios (2 x entries x heads) of texts that have an entry, and more of those that have it twice; ``mean, scale, beta`` of the logistic models."""

    lexicon: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray


def entries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the words, then of the beginnings of longer ones, and their rows; how many are words. Punctuation ends a word."""
    h, rows = word_hashes(texts, PUNCTUATION)
    raw, offsets = buffers(texts)
    gap = PUNCTUATION[raw]
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    begin = np.ones(len(raw), dtype=bool)
    begin[1:] = gap[:-1]
    begin[offsets[:-1][offsets[:-1] < len(raw)]] = True
    hashes, places, inside, code = [h], [rows], begin, np.zeros(len(raw), np.uint64)
    for k in range(max(STEMS) + 1):
        inside = inside.copy()
        inside[: len(raw) - k] &= ~gap[k:]
        inside[max(len(raw) - k, 0) :] = False
        if k in STEMS:
            at = np.flatnonzero(inside)
            row = np.searchsorted(offsets, at, side="right") - 1
            good = at + k + 1 <= offsets[row + 1]
            at, row = at[good], row[good]
            code = np.full(len(at), k, np.uint64)
            for j in range(k):
                code = code << np.uint64(8) | lower[at + j]
            hashes.append(code)
            places.append(row)
    return np.concatenate(hashes), np.concatenate(places), len(h)


def style(texts: pa.Array) -> np.ndarray:
    """Shares of byte classes, length, mean word length, and shares of words equal to the one and the two before."""
    raw, offsets = buffers(texts)
    size = np.diff(offsets)
    n = len(size)
    out = np.zeros((n, N_STYLE))
    row = np.repeat(np.arange(n), size)
    out[:, :N_KINDS] = np.bincount(row * N_KINDS + KINDS[raw], minlength=n * N_KINDS).reshape(n, N_KINDS) / np.maximum(size, 1)[:, None]
    h, rows = word_hashes(texts)
    words = np.bincount(rows, minlength=n)
    out[:, N_KINDS] = np.log1p(words)
    out[:, N_KINDS + 1] = size / np.maximum(words, 1)
    for lag in (1, 2):
        same = (h[lag:] == h[:-lag]) & (rows[lag:] == rows[:-lag])
        out[:, N_KINDS + 1 + lag] = np.bincount(rows[lag:], same, n) / np.maximum(words, 1)
    return out


def features(texts: pa.Array, lexicon: np.ndarray, weight: np.ndarray) -> np.ndarray:
    h, rows, words = entries(texts)
    n = len(texts)
    out = np.zeros((n, N_FEATURES))
    out[:, :N_STYLE] = style(texts)
    if len(lexicon):
        found = pd.Index(lexicon).get_indexer(h)
        on = found >= 0
        pair, times = np.unique(rows[on] * len(lexicon) + found[on], return_counts=True)
        own, entry = pair // len(lexicon), pair % len(lexicon)
        size = np.maximum(np.bincount(rows[:words], minlength=n), 1)
        for k in range(2):
            out[:, N_STYLE + k] = np.clip(np.bincount(own, weight[0, entry, k] + (times > 1) * weight[1, entry, k], n), -6, 12)
            out[:, N_STYLE + 2 + k] = np.minimum(np.bincount(own, times * np.maximum(weight[:, entry, k].max(axis=0), 0), n) / size, MOST_RATE)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the intercept."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The document model from at most ``sample`` labelled rows, those with the smallest hashes of the id.

    Labels with nulls are left out; of copies with different labels the worse counts. The lexicon comes from one half of the sample's distinct texts, the
    logistic models from the other. Without both classes a head's model is its intercept.
    """
    names = labels.select(F.col(doc_id).alias("id"), (1 - F.col("quality")).cast("double").alias("low"), F.col("toxic").cast("double").alias("toxic")).dropna()
    some = names.groupBy("id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    mine = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some), "id")
    half = F.pmod(F.xxhash64(F.md5("text")), F.lit(2)).alias("half")
    mine = durable(mine.groupBy("text").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic")).select("text", half, "low", "toxic"))
    marks = mine.groupBy("half").agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).where("half = 0").first()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                h, rows, _ = entries(part.column("text"))
                key, at = np.unique(h, return_inverse=True)
                pair, times = np.unique(at * part.num_rows + rows, return_counts=True)
                y = [np.asarray(part.column(c), dtype=np.float64) for c in HEADS]
                for kind in range(2):
                    some = pair[times > kind]
                    if not len(some):
                        continue
                    entry, own = some // part.num_rows, some % part.num_rows
                    seen, at = np.unique(entry, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key[seen].view(np.int64)), pa.array(np.full(len(seen), kind, np.int32)), pa.array(np.bincount(at, minlength=len(seen)).astype(float)), *[pa.array(np.bincount(at, v[own], len(seen))) for v in y]], names=["key", "kind", "n", *HEADS])

    lexicon, weight = np.zeros(0, np.uint64), np.zeros((2, 0, 2))
    if marks is not None and marks.n:
        rate = [min(max(marks[h] / marks.n, 1e-3), 1 - 1e-3) for h in HEADS]
        words = mine.where("half = 0").mapInArrow(tally, "key long, kind int, n double, low double, toxic double").groupBy("key", "kind").agg(*[F.sum(c).alias(c) for c in ("n", *HEADS)])
        off = [F.abs(F.col(h) - F.col("n") * r) / F.sqrt(F.col("n") * r * (1 - r)) >= DEVIATIONS for h, r in zip(HEADS, rate, strict=True)]
        found = words.where((F.col("n") >= LEAST_TEXTS) & (off[0] | off[1])).toPandas()
        lexicon, at = np.unique(found["key"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        kind, n = found["kind"].to_numpy(), found["n"].to_numpy()
        weight = np.zeros((2, len(lexicon), 2))
        for k, (h, r) in enumerate(zip(HEADS, rate, strict=True)):
            x = found[h].to_numpy(float)
            sure = np.abs(x - n * r) / np.sqrt(n * r * (1 - r)) >= DEVIATIONS
            weight[kind, at, k] = np.where(sure, np.log((x + r) / (n - x + 1 - r)) - np.log(r / (1 - r)), 0.0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                x = features(part.column("text"), lexicon, weight)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), part.column("low"), part.column("toxic")], names=["x", *HEADS])

    rows = mine.where("half = 1").mapInArrow(spread, "x array<double>, low double, toxic double").orderBy("x").toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, N_FEATURES))
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    z = np.hstack((np.ones((len(x), 1)), (x - mean) / scale))
    beta = []
    for h in HEADS:
        y = rows[h].to_numpy(float) if len(rows) else np.zeros(0)
        both = 0 < y.sum() < len(y)
        beta.append(logistic(z, y) if both else np.concatenate(([-3.0], np.zeros(N_FEATURES))))
    return Model(lexicon, weight, mean, scale, np.stack(beta, axis=1))


def evidence(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``__low`` and ``__toxic``: each document's own log-odds."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, text, STEP_BYTES):
                z = (features(part.column(text), m.lexicon, m.weight) - m.mean) / m.scale
                out = np.clip(z @ m.beta[1:] + m.beta[0], -12, 12)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out[:, 0]), pa.array(out[:, 1])], names=[*part.schema.names, "__low", "__toxic"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__low", T.DoubleType()), T.StructField("__toxic", T.DoubleType())]))


def chance(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def sites(scored: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``__host, __path`` and for each head the host's and the path's posterior rates, and the shift that the path's means.

    Pseudo-pages come from the spread of the rates between sites, by moments, weighted by pages.
    """
    cells = durable(
        scored.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("__path"))
        .agg(F.count("*").alias("n"), *[F.sum(chance(F.col(f"__{h}"))).alias(h) for h in HEADS])
    )
    hosts = cells.groupBy("__host").agg(F.sum("n").alias("host_n"), *[F.sum(h).alias(f"host_{h}") for h in HEADS])

    def moments(rows: DataFrame, n: str, sums: list[str]) -> list[tuple[float, float]]:
        total = rows.agg(F.sum(n).alias("n"), F.count("*").alias("k"), *[F.sum(s).alias(s) for s in sums], *[F.sum(F.col(s) * F.col(s) / F.col(n)).alias(f"{s}2") for s in sums]).first()
        out = []
        for s in sums:
            mu = min(max(total[s] / total["n"], 1e-4), 1 - 1e-4) if total["n"] else 0.1
            between = max((total[f"{s}2"] or 0) - (total["n"] or 0) * mu * mu - mu * (1 - mu) * max((total["k"] or 0) - 1, 0), 0.0) / max(total["n"] or 1, 1)
            out.append((mu, min(max(mu * (1 - mu) / between - 1, 2.0), 1e6) if between > 0 else 1e6))
        return out

    prior = moments(hosts, "host_n", [f"host_{h}" for h in HEADS])
    inner = moments(cells, "n", list(HEADS))
    out = cells.join(hosts, "__host")
    for h, (mu, k), (_, k2) in zip(HEADS, prior, inner, strict=True):
        out = out.withColumn(f"{h}_host", (F.col(f"host_{h}") + k * mu) / (F.col("host_n") + k))
        out = out.withColumn(f"{h}_path", (F.col(h) + k2 * F.col(f"{h}_host")) / (F.col("n") + k2))
        out = out.withColumn(f"{h}_shift", F.greatest(F.lit(-MOST_SHIFT), F.least(F.lit(MOST_SHIFT), odds(F.col(f"{h}_path")) - odds(F.lit(mu)))))
    return out.select("__host", "__path", *[f"{h}_{k}" for h in HEADS for k in ("host", "path", "shift")])


def combined(scored: DataFrame, by_site: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``scored`` with the site's columns, the posterior probabilities ``low_p`` and ``toxic_p``, and ``keep``."""
    by_site = durable(by_site)
    small = by_site.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    same = (F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col("__host")) & (F.coalesce(F.col(path).cast("string"), F.lit("")) == F.col("__path"))
    out = scored.join(F.broadcast(by_site) if small else by_site, same)
    for h in HEADS:
        out = out.withColumn(f"{h}_p", chance(F.col(f"__{h}") + F.col(f"{h}_shift")))
    return out.withColumn("keep", (F.col("low_p") <= 0.5) & (F.col("toxic_p") <= 0.5))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, host, path``, posteriors, ``low_p``, ``toxic_p`` and ``keep`` for every document.

    Null text: empty. Null host or path: the site ''. Null ids and repeated rows are documents of their own. Other
    columns are ignored. Without labels nothing is rejected. No rows give no rows.
    """
    model = fit(docs, labels, sample, doc_id, text)
    mine = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text"))
    scored = durable(evidence(mine, model).drop("text"))
    return combined(scored, sites(scored, "host", "path"), "host", "path").drop("__host", "__path")


def kept(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rejected rows. Texts are scored twice, for the sites and for the decision, but never shuffled."""
    model = fit(docs, labels, sample, doc_id, text)
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    of = {c: f"c{i}" for i, c in enumerate(names)}
    scored = evidence(plain, model, of[text])
    by_site = sites(scored.select(of[host], of[path], "__low", "__toxic"), of[host], of[path])
    return combined(scored, by_site, of[host], of[path]).where("keep").select(*[F.col(v).alias(k) for k, v in of.items()])
