"""Quality scores by nearest-neighbour votes among labelled latent-semantic vectors."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.llm.common import broadcast_model, doc_remainder, hold_alone, load, short_batches, smallest_hashes, written
from crawlmill.llm.encoding import segments

#: Labelled documents per label that the model is fitted on at most (whole texts): bounds what is broadcast.
FIT_DOCS = 1500
#: Words of the vocabulary and letters of one, latent dimensions, neighbours that vote, documents compared in a block.
VOCABULARY, WORD_LETTERS, DIMENSIONS, NEIGHBOURS, BLOCK = 4000, 64, 48, 25, 256
#: Scores from here on are label 1.
THRESHOLD = 0.3
#: Words that a worker remembers, and letters of them.
CACHE_ROWS, CACHE_LETTERS = 150_000, 4 << 20
#: Features besides the vocabulary: unknown word, shapes of words, word like the one before, and text without words.
_CASES, _ENDS = 5, 5
_EXTRA = 1 + _CASES * _ENDS + 2


def shape_of(word: str) -> int:
    """Case (none, lower, capital, upper, mixed) and ending (letter or digit, full stop, comma, other, two others)."""
    case = 0 if not any(map(str.isalpha, word)) else 1 if word.islower() else 2 if word[:1].isupper() and not word[1:2].isupper() else 3 if word.isupper() else 4
    tail = len(word) - len(word.rstrip("".join({c for c in word[-8:] if not c.isalnum()}))) if word else 0
    end = 0 if not tail else (1 if word[-1] == "." else 2 if word[-1] == "," else 3) if tail == 1 else 4
    return case * _ENDS + end


@dataclass
class NeighbourModel:
    """Vocabulary with weights, projection to latent dimensions, labelled unit vectors and their labels."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    known: dict = field(default_factory=dict)
    letters: int = 0

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "letters": 0}

    def forget(self) -> None:
        self.known.clear()
        self.letters = 0

    def _word(self, word: str) -> int:
        """Vocabulary place and shape of a word in one number."""
        return self.vocabulary.get(word.lower(), len(self.vocabulary)) * 64 + shape_of(word)

    def _codes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_ROWS or self.letters > CACHE_LETTERS:
            self.forget()
        for w in set(words).difference(self.known):
            self.known[w] = self._word(w)
            self.letters += len(w)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Weighted log counts of words, shapes and repeats: a row per text."""
        hold_alone(self, self.forget)
        v = len(self.vocabulary)
        out = np.zeros((len(texts), v + _EXTRA), np.float32)
        for row, text in zip(out, texts):
            counts, shapes, repeats, last = np.zeros(v + 1), np.zeros(_CASES * _ENDS), 0, None
            for part in segments(text or ""):
                words = part.split()
                if words:
                    codes = self._codes(words)
                    counts += np.bincount(codes >> 6, minlength=v + 1)
                    shapes += np.bincount(codes & 63, minlength=_CASES * _ENDS)
                    repeats += sum(map(str.__eq__, words[1:], words)) + (words[0] == last)
                    last = words[-1]
            n = shapes.sum()
            if not n:
                row[-1] = 1
                continue
            row[:v] = np.log1p(counts[:v])  # how many words are unknown says little
            # shares weigh as much as the whole vocabulary
            row[v + 1 : -2] = shapes / n * 12
            row[-2] = repeats / n * 12
        out[:, : v + 1] *= self.idf
        norm = np.linalg.norm(out[:, :v], axis=1, keepdims=True)
        out[:, :v] *= 6 / np.maximum(norm, 1e-9)
        return out

    def vectors_of(self, texts: list[str | None]) -> np.ndarray:
        x = (self.features(texts) @ self.projection).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by its cosine; the prior without any.

        All that come as near as the last of NEIGHBOURS vote, so ties do not depend on an order.
        """
        out = np.full(len(texts), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for i in range(0, len(texts), BLOCK):
            cosine = self.vectors_of(texts[i : i + BLOCK]) @ self.vectors.T
            last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k] - 1e-6
            weight = np.where(cosine >= last, np.square(np.square(np.maximum(cosine, 0))) + 1e-9, 0)
            out[i : i + BLOCK] = weight @ self.labels / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def latent_directions(x: np.ndarray, most: int = DIMENSIONS, rounds: int = 12) -> np.ndarray:
    """The leading right singular vectors of x, in columns, by subspace iteration: no square matrix of rows or columns."""
    wide = min(most + 16, *x.shape)
    v = np.linalg.qr(np.random.default_rng(5).normal(size=(x.shape[1], wide)))[0]
    for _ in range(rounds):
        v = np.linalg.qr((x.T @ (x @ v.astype(np.float32))).astype(np.float64))[0]
    y = (x @ v.astype(np.float32)).astype(np.float64)
    values, turn = np.linalg.eigh(y.T @ y)
    top = np.argsort(-values)[:most]
    return (v @ turn[:, top[values[top] > 1e-6]]).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, quality, text): of each label the documents of smallest doc_id hash, one row per doc_id.

    A doc_id labelled more than once counts with its smallest label, one with several texts with the smallest; null
    labels and doc_ids count not at all. Labels are learned where crc32(doc_id) modulo 5 is not 0.
    """
    marked = labels.where("doc_id is not null and quality is not null").where(doc_remainder(5) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # only documents that are there, by ids alone
    marked = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = smallest_hashes(marked.withColumn("h", F.xxhash64("doc_id")), "quality", "h", fit_docs).select("doc_id", "quality")
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> NeighbourModel:
    """A model from a bounded sample of labelled documents, by latent semantic analysis.

    The sample's words and features are counted where its documents are; one task sees a row of features per document,
    whatever the length of the texts, and the driver a vocabulary of VOCABULARY words and the model.
    """
    spark = docs.sparkSession
    short_batches(spark)
    sample = written(labelled_sample(docs, labels, fit_docs), "quality-sample")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for text in b.column(0):
                counts.update({w for part in segments(text.as_py() or "") for w in part.lower().split() if len(w) <= WORD_LETTERS})
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    facts = sample.agg(F.count("*").alias("n"), F.avg((F.col("quality") > 0).cast("double")).alias("prior")).first()
    words = sample.select("text").mapInArrow(seen, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    words = words.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    idf = np.array([np.log((1 + facts["n"]) / (1 + w["n"])) + 0.1 for w in words] + [1.0], np.float32)
    none = np.zeros((0, 0), np.float32)
    bare = NeighbourModel({w["word"]: i for i, w in enumerate(words)}, idf, none, none, np.zeros(0), 0.5 if facts["prior"] is None else facts["prior"])
    if not facts["n"]:
        return bare
    held = broadcast_model(spark, bare)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                x = [r.tobytes() for r in held.value.features(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], ["doc_id", "label", "x"])

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(table["doc_id"].to_numpy())
        x = np.stack([np.frombuffer(table["x"][int(i)].as_buffer(), np.float32) for i in order])
        projection = latent_directions(x)
        vectors = (x @ projection).astype(np.float64)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        return pa.table({"parts": pa.array([pickle.dumps((projection, vectors, table["label"].to_numpy()[order].astype(np.float64)))], pa.binary())})

    rows = sample.select("doc_id", (F.col("quality") > 0).cast("int").alias("label"), "text").mapInArrow(features, "doc_id long, label int, x binary")
    projection, vectors, marks = pickle.loads(bytes(rows.groupBy().applyInArrow(fit, "parts binary").first()["parts"]))
    held.unpersist()
    return NeighbourModel(bare.vocabulary, idf, projection, vectors, marks, bare.prior)


def quality_scores(docs: DataFrame, model: NeighbourModel) -> DataFrame:
    """doc_id, score, predicted of every whole text; null is the empty text."""
    short_batches(docs.sparkSession)
    held = broadcast_model(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = held.value.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: labels are learned where crc32(doc_id) modulo 5 is not 0.

    Repeated rows and null doc_ids each give a row; other columns are ignored; without labels every score is 0.5.
    """
    model = fit_quality(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return quality_scores(docs, model).select("doc_id", (doc_remainder(5) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score below the threshold; all columns, no shuffle.

    Null texts score as empty ones do, repeated rows alike; without labels every score is 0.5, so all stay. Other
    columns, whatever their names, are kept; no rows give no rows.
    """
    model = fit_quality(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    short_batches(docs.sparkSession)
    held = broadcast_model(docs.sparkSession, model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.scores(b.column(text).to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
