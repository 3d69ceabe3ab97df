"""Toxicity by multiple-instance learning: sentences are scored, noisy-or joins them, document labels train them.

A sentence's probability is logistic in the weights of its words and of their beginnings (lower-cased, outer ASCII punctuation off;
beginnings let inflected and compound forms share evidence); a document's is 1 - prod(1 - p) over its sentences. Only document labels are known, so training climbs the likelihood of the documents; sentence
probabilities, and with them the offending sentences, fall out. The model is fitted to at most `max_docs` labelled rows outside the
held-out fold (those with a document whose id hashes lowest). Spark counts the hashed features of these by class; those that differ by
`least_z` standard errors, and in any case the `min_features` that differ most, are the vocabulary, and only their places in sentences
come to the driver, which climbs the gradient.

Defined cases: a null or empty text has score 0; without labelled documents of both kinds all scores are 0; ids may be null (then not held out);
repeated rows, and rows with one id and other texts, score each by its own text; texts of any length are read whole; ties of the sample's
order go by id; an empty table gives an empty result; other columns are ignored by `score` and kept by `keep`. Labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, U64, cores, mix64, segment_hash, sentence_breaks, slices, utf8, words

FOLDS = 5
PREFIXES = (4, 5, 6, 7, 8, 9)  # bytes of a word's beginnings
OUT = "doc_id bigint, score double, sentences array<struct<start:bigint,end:bigint,score:double>>"


@dataclass
class Model:
    vocabulary: np.ndarray  # hashed words, ascending
    weights: np.ndarray
    bias: float


@dataclass
class Sentences:
    row: np.ndarray  # of each sentence
    begin: np.ndarray  # byte offsets inside the text
    end: np.ndarray
    of: np.ndarray  # the sentence of each feature
    word: np.ndarray  # the feature, hashed


def parse(column: pa.Array) -> Sentences:
    buf, offs = utf8(column)
    starts, ends, row, _ = words(buf, offs)
    breaks = sentence_breaks(buf, starts, ends, row)
    of = np.r_[0, np.cumsum(breaks)[:-1]][: len(ends)].astype(np.int64)
    last = np.flatnonzero(breaks)
    first = np.r_[0, last[:-1] + 1][: len(last)].astype(np.int64)
    a, b = cores(buf, starts, ends)
    low = LOWER[buf]
    found = [(of, segment_hash(low, a, b))]
    for n in PREFIXES:
        longer = np.flatnonzero(b - a > n)
        found.append((of[longer], mix64(segment_hash(low, a[longer], a[longer] + n) + U64(n))))
    return Sentences(row[first], starts[first] - offs[row[first]], ends[last] - offs[row[first]], *(np.concatenate(x) for x in zip(*found, strict=True)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(toxic: np.ndarray, n_sentences: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, size: int, rounds: int = 400, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias. toxic and n_sentences: by document; then the document, sentence and feature of each place in which a feature is."""
    n, y = len(toxic), toxic.astype(float)
    key, s = np.unique(doc * (np.int64(1) + (sentence.max() if len(sentence) else 0)) + sentence, return_inverse=True)
    of = np.zeros(len(key), np.int64)
    of[s] = doc
    idle = n_sentences - np.bincount(of, minlength=n)
    theta = np.r_[np.zeros(size), -7.0]
    m, u = np.zeros_like(theta), np.zeros_like(theta)
    for it in range(1, rounds + 1):
        w, b = theta[:-1], theta[-1]
        x = np.bincount(s, w[feature], len(key)) + b
        p, p0 = 1 / (1 + np.exp(-x)), 1 / (1 + np.exp(-b))
        q = np.exp(-(np.bincount(of, np.logaddexp(0, x), n) + idle * np.logaddexp(0, b)))
        pull = np.where(y > 0, q / np.maximum(1 - q, 1e-6), -1.0)
        g_x = pull[of] * p
        g = np.r_[np.bincount(feature, g_x[s], size), g_x.sum() + (pull * idle).sum() * p0] / n
        g[:-1] -= decay * theta[:-1]
        m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**it)) / (np.sqrt(u / (1 - 0.999**it)) + 1e-9)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 20000, min_features: int = 1000, least_z: float = 3.0, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits the model to labelled documents outside the held-out fold, `max_docs` of them at most."""
    told = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    told = told.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select(F.col(doc_id).cast("bigint").alias("doc_id")), "doc_id", "left_semi")
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(told), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for k, part in enumerate_slices(batch):
                x = parse(part.column("text"))
                row = x.row[x.of]
                order = np.lexsort((row, x.word))
                word, row = x.word[order], row[order]
                once = np.r_[True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])][: len(word)]
                word, hit = word[once], toxic[k + row[once]]
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
                if len(first):
                    yield pa.RecordBatch.from_pydict({"word": pa.array(word[first].view(np.int64)), "df": pa.array(np.diff(np.r_[first, len(word)])), "hits": pa.array(np.add.reduceat(hit, first).astype(np.int64))})

    n, positive = own.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < n:
        return Model(np.zeros(0, U64), np.zeros(0), -30.0)
    base = positive / n
    counted = own.mapInArrow(count, "word bigint, df bigint, hits bigint").groupBy("word").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits")).where("df >= 3")
    z = (F.col("hits") - F.col("df") * base) / F.sqrt(F.col("df") * (base * (1 - base)))
    chosen = counted.where(F.abs(z) >= least_z).select("word").toArrow()["word"].to_numpy()
    if len(chosen) < min_features:
        chosen = counted.orderBy(F.abs(z).desc(), "word").limit(min_features).toArrow()["word"].to_numpy()
    vocabulary = np.sort(chosen.view(U64)) if len(chosen) else np.zeros(0, U64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in enumerate_slices(batch):
                x = parse(part.column("text"))
                s, f = hits(x, vocabulary)
                cut = np.searchsorted(x.row[s], np.arange(part.num_rows + 1))
                packs = [(s[i:j].tobytes(), f[i:j].tobytes()) for i, j in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "n": pa.array(np.bincount(x.row, minlength=part.num_rows)), "s": pa.array([p[0] for p in packs], pa.binary()), "f": pa.array([p[1] for p in packs], pa.binary())}
                )

    found = own.mapInArrow(place, "doc_id bigint, toxic int, n bigint, s binary, f binary").toArrow().sort_by("doc_id")
    doc = np.repeat(np.arange(found.num_rows), [len(x.as_py()) // 8 for x in found["s"]])
    s, f = (np.frombuffer(b"".join(found[c].to_pylist()), np.int64) for c in "sf")
    return Model(vocabulary, *fit(found["toxic"].to_numpy(), found["n"].to_numpy(), doc, s, f, len(vocabulary)))


def enumerate_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices and the place of their first row in the batch."""
    k = 0
    for part in slices(batch, "text"):
        yield k, part
        k += part.num_rows


def hits(x: Sentences, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sentence, place in the vocabulary), ascending."""
    if not len(vocabulary) or not len(x.word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, x.word), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == x.word)
    pair = np.unique(x.of[hit] * np.int64(len(vocabulary)) + at[hit])
    return pair // len(vocabulary), pair % len(vocabulary)


def logits(column: pa.Array, model: Model) -> tuple[Sentences, np.ndarray, np.ndarray]:
    """The sentences, the logit of each, and the score of each text."""
    x = parse(column)
    s, f = hits(x, model.vocabulary)
    logit = model.bias + (np.bincount(s, model.weights[f], len(x.row)) if len(s) else np.zeros(len(x.row)))
    return x, logit, -np.expm1(-np.bincount(x.row, np.logaddexp(0, logit), len(column)))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its score, and the sentences (byte offsets) whose own probability reaches the threshold."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, logit, total = logits(part.column("text"), model)
                n = part.num_rows
                p = 1 / (1 + np.exp(-logit))
                bad = np.flatnonzero(p >= threshold)
                cut = np.r_[0, np.cumsum(np.bincount(x.row[bad], minlength=n))].astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(x.begin[bad]), pa.array(x.end[bad]), pa.array(p[bad])], names=["start", "end", "score"])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(total), "sentences": pa.ListArray.from_arrays(pa.array(cut), spans)})

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(rate, OUT)


def keep(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns, in one pass."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(logits(part.column(text), model)[2] < threshold))

    return docs.mapInArrow(sift, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"))
