"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlmill.llm.common import broadcast_model, doc_remainder, hold_alone, load, short_batches, smallest_hashes, written
from crawlmill.llm.encoding import STEP, segments

#: Longest n-gram.
ORDER = 5
#: Labelled documents per language that a model is fitted on at most (whole texts), and those that calibrate it; words
#: that a model is fitted on at most, the commonest, and letters of one.
FIT_DOCS, CALIBRATION_DOCS, FIT_WORDS, FIT_LETTERS = 1200, 500, 60_000, 64
#: Share of a language's own texts that may be rejected, and the standard errors that short texts may differ by besides.
FALSE_REJECTION, STANDARD_ERRORS = 0.001, 3.0
#: How sharply the score may fall with cross-entropy; calibration takes the likeliest.
SHARPNESS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
#: Words that a worker remembers, and letters of them.
CACHE_ROWS, CACHE_LETTERS = 120_000, 4 << 20
_START, _END = 1, 2  # code points that no word holds
_BASE = 0x9E3779B97F4A7C15
UNDETERMINED = "und"


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, each after ORDER - 1 start marks and before an end mark; and the places to predict."""
    pad = chr(_START) * (ORDER - 1)
    codes = np.frombuffer("".join([pad + w + chr(_END) for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return codes, np.flatnonzero(codes != _START)


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """[n] is the hash of the n code points that end at each place; [0] is zero. Arithmetic is modulo 2^64."""
    out, power = [np.zeros(len(codes), np.uint64)], 1
    mixed = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    for n in range(1, ORDER + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[n - 1 :] = mixed[: len(codes) - n + 1]
        out.append(out[-1] + shifted * np.uint64(power))
        power = power * _BASE % (1 << 64)
    return out


@dataclass
class KneserNey:
    """Per order n: sorted n-gram hashes with log probabilities, and sorted context hashes with log back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    @classmethod
    def fit(cls, words: list[str], counts: np.ndarray) -> KneserNey:
        codes, at = _codes(words)
        hashes = _hashes(codes)
        weight = np.repeat(counts.astype(np.float64), [len(w) + 1 for w in words])
        # raw counts of the longest n-grams; a shorter one counts the kinds of symbols before it,
        # or its occurrences where it begins with the start mark and so has one predecessor only
        top, first, inverse = np.unique(hashes[ORDER][at], return_index=True, return_inverse=True)
        value = np.bincount(inverse, weight, len(top))
        where, grams, contexts = at[first], [], []
        tables = []
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                raw_keys, raw_first, raw_inverse = np.unique(hashes[n][at], return_index=True, return_inverse=True)
                raw = np.bincount(raw_inverse, weight, len(raw_keys))
                longer = tables[-1][1]
                kinds = np.bincount(np.searchsorted(raw_keys, hashes[n][longer]), minlength=len(raw_keys)).astype(np.float64)
                where = at[raw_first]
                starts = codes[where - (n - 1)] == _START
                top, value = raw_keys, np.where(starts, raw, kinds)
            tables.append((top, where, value))
        below = None
        symbols = len(np.unique(codes[at])) + 1
        floor = -np.log(symbols)
        for n in range(1, ORDER + 1):
            keys, where, value = tables[ORDER - n]
            ones, twos = float((value == 1).sum()), float((value == 2).sum())
            discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            ctx_keys, ctx = np.unique(hashes[n - 1][where - 1] if n > 1 else np.zeros(len(where), np.uint64), return_inverse=True)
            total, kinds = np.bincount(ctx, value, len(ctx_keys)), np.bincount(ctx, minlength=len(ctx_keys))
            backoff = discount * kinds / total
            if below is None:
                lower = np.full(len(keys), np.exp(floor))
            else:
                lower = np.exp(below[1][np.searchsorted(below[0], hashes[n - 1][where])])
            p = np.maximum(value - discount, 0) / total[ctx] + backoff[ctx] * lower
            below = (keys, np.log(p))
            grams.append(below)
            contexts.append((ctx_keys, np.log(backoff)))
        return cls(grams, contexts, floor)

    def log_probability(self, hashes: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Of each place: hashes[n] of the n symbols that end there, before[n] of the n symbols that end just before."""
        out = np.zeros(len(hashes[1]))
        left = np.arange(len(out))
        for n in range(ORDER, 0, -1):
            keys, logp = self.grams[n - 1]
            h = hashes[n][left]
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[i] == h
            out[left[hit]] += logp[i[hit]]
            left = left[~hit]
            if not len(left):
                return out
            keys, logw = self.contexts[n - 1]
            h = before[n - 1][left]
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out[left] += np.where(keys[i] == h, logw[i], 0.0)
        out[left] += self.floor
        return out

    def to_bytes(self) -> bytes:
        arrays = [a for pair in (*self.grams, *self.contexts) for a in pair]
        head = json.dumps({"sizes": [len(a) for a in arrays], "floor": self.floor}).encode()
        return len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def from_bytes(cls, data: bytes) -> KneserNey:
        n = int.from_bytes(data[:4], "little")
        head = json.loads(data[4 : 4 + n])
        at, arrays = 4 + n, []
        for i, size in enumerate(head["sizes"]):
            arrays.append(np.frombuffer(data, np.float64 if i % 2 else np.uint64, size, at))
            at += 8 * size
        pairs = list(zip(arrays[::2], arrays[1::2]))
        return cls(pairs[:ORDER], pairs[ORDER:], head["floor"])


@dataclass
class LanguageModels:
    """Models by language, the sharpness of the score, and per language the highest cross-entropy of a long text that is
    accepted, and its standard deviation per symbol."""

    languages: list[str]
    models: list[KneserNey]
    sharpness: float = 8.0
    limits: tuple[float, ...] = ()
    spreads: tuple[float, ...] = ()

    def __post_init__(self):
        self.known: dict[str, int] = {}
        self.letters = 0
        self.table = np.zeros((1024, len(self.languages) + 1))

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("languages", "models", "sharpness", "limits", "spreads")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def forget(self) -> None:
        self.__post_init__()

    def _learn(self, words: set[str]) -> None:
        """A row per word: minus log probability under each language, and number of predicted symbols."""
        if len(self.known) > CACHE_ROWS or self.letters > CACHE_LETTERS:
            self.forget()
        new = list(words.difference(self.known))
        if not new:
            return
        cleaned = [letters_of(w) for w in new]
        codes, at = _codes(cleaned)
        hashes = _hashes(codes)
        # equal longest n-grams have equal probabilities: look each up once
        _, first, inverse = np.unique(hashes[ORDER][at], return_index=True, return_inverse=True)
        place = at[first]
        ends, before = [h[place] for h in hashes], [h[place - 1] for h in hashes]
        lengths = np.array([len(w) + 1 for w in cleaned])
        starts = np.cumsum(lengths) - lengths
        base = len(self.known)
        if base + len(new) > len(self.table):
            grown = np.zeros((2 * (base + len(new)), self.table.shape[1]))
            grown[:base] = self.table[:base]
            self.table = grown
        rows = self.table[base : base + len(new)]
        for i, m in enumerate(self.models):
            rows[:, i] = -np.add.reduceat(m.log_probability(ends, before)[inverse], starts)
        rows[:, -1] = lengths
        rows[lengths == 1] = 0  # no letter: says nothing
        self.known.update(zip(new, range(base, base + len(new))))
        self.letters += sum(map(len, new))

    def _rows(self, words: list[str]) -> np.ndarray:
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """A row per text: cross-entropy per symbol under each language (zero where there is no letter), symbols."""
        hold_alone(self, self.forget)
        out, at = np.zeros((len(texts), len(self.languages) + 1)), 0
        parts = [(row, s) for row, t in zip(out, texts) for s in segments(t or "")]
        while at < len(parts):
            # parts of about STEP characters learn together
            cut, size = [], 0
            while at + len(cut) < len(parts) and (not cut or size + len(parts[at + len(cut)][1]) <= STEP):
                size += len(parts[at + len(cut)][1])
                cut.append(parts[at + len(cut)][1].lower().split())
            self._learn(set().union(*cut))
            for (row, _), words in zip(parts[at:], cut):
                row += self._rows(words).sum(axis=0)
            at += len(cut)
        return np.hstack([out[:, :-1] / np.maximum(out[:, -1:], 1), out[:, -1:]])

    def variance(self, text: str, language: int) -> float:
        """Of a text's minus log probability, per symbol, as its words vary around the mean."""
        rows = []
        for part in segments(text):
            words = part.lower().split()
            self._learn(set(words))
            rows.append(self._rows(words)[:, [language, -1]])
        rows = np.concatenate(rows)
        total, n = rows.sum(axis=0)
        return float(((rows[:, 0] - total / max(n, 1) * rows[:, 1]) ** 2).sum() / max(n, 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        e = self.entropies(texts)
        h, n = e[:, :-1], e[:, -1]
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        score = 1 / np.exp(-self.sharpness * (h - low[:, None])).sum(axis=1)
        limit = np.array(self.limits or [np.inf] * len(self.languages))[best]
        spread = np.array(self.spreads or [0.0] * len(self.languages))[best]
        none = n == 0
        over = low > limit + STANDARD_ERRORS * spread / np.sqrt(np.maximum(n, 1))
        return [UNDETERMINED if x else self.languages[b] for x, b in zip(none, best)], np.where(none, 0.0, score), none | over


def labelled_sample(labelled: DataFrame, fit_docs: int = FIT_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> DataFrame:
    """(lang, place, fits, text): of each language the documents of smallest hash, which fit or calibrate its model.

    One text per doc_id and language, the smallest where several rows repeat them; null doc_ids take no part.
    """
    rows = labelled.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null").withColumn("h", F.xxhash64("doc_id", F.lit(3)))
    picked = smallest_hashes(rows.select("doc_id", "lang", "h").distinct(), "lang", "h", fit_docs + calibration_docs)
    share = F.least(F.lit(fit_docs), F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy("lang")) * 4 / 5)))
    picked = picked.select("doc_id", "lang", "place", (F.col("place") <= share).alias("fits"))
    return rows.drop("h").join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("lang", "place", "fits").agg(F.min("text").alias("text"))


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) of the letters of words, long ones in pieces; the FIT_WORDS commonest of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for part in segments(text.as_py()):
                    for w, n in Counter(part.lower().split()).items():
                        kept = letters_of(w)
                        for i in range(0, len(kept), FIT_LETTERS):
                            counts[lang, kept[i : i + FIT_LETTERS]] += n
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counted.withColumn("place", order).where(F.col("place") <= FIT_WORDS).drop("place")


def fit_languages(labelled: DataFrame, fit_docs: int = FIT_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> LanguageModels:
    """Models from labelled (doc_id, text, lang), on a bounded sample of whole documents of each language.

    Words are counted by Spark; a model's task sees at most FIT_WORDS of them. Documents beyond the fitted ones calibrate
    where they are, and the driver receives sums and quantiles per language: the score's sharpness is the likeliest, and
    a language's limit is the cross-entropy that a share FALSE_REJECTION of its own texts exceeds.
    """
    spark = labelled.sparkSession
    short_batches(spark)
    sample = written(labelled_sample(labelled, fit_docs, calibration_docs), "langid-sample")

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        model = KneserNey.fit(table["word"].to_pylist(), table["n"].to_numpy()).to_bytes()
        return pa.table({"lang": [key[0].as_py()], "model": pa.array([model], pa.binary())})

    fitted = word_counts(sample.where("fits")).groupBy("lang").applyInArrow(fit, "lang string, model binary").orderBy("lang").collect()
    bare = LanguageModels([r["lang"] for r in fitted], [KneserNey.from_bytes(bytes(r["model"])) for r in fitted])
    if not fitted:
        return bare
    held = broadcast_model(spark, bare)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        for b in batches:
            rows, texts = [], b.column(1).to_pylist()
            for lang, text, e in zip(b.column(0).to_pylist(), texts, models.entropies(texts)):
                if lang in models.languages and e[-1] > 0:
                    i, h = models.languages.index(lang), e[:-1]
                    loss = [float(np.logaddexp.reduce(-a * (h - h[i]))) for a in SHARPNESS]
                    rows.append({"lang": lang, "own": float(h[i]) if h.argmin() == i else None, "variance": models.variance(text, i), "loss": loss})
            yield pa.RecordBatch.from_pylist(rows, judged)

    judged = pa.schema([("lang", pa.string()), ("own", pa.float64()), ("variance", pa.float64()), ("loss", pa.list_(pa.float64()))])
    rows = sample.where("not fits").select("lang", "text").mapInArrow(judge, "lang string, own double, variance double, loss array<double>")
    sums = [F.sum(F.col("loss")[i]).alias(f"loss{i}") for i in range(len(SHARPNESS))]
    found = {r["lang"]: r for r in rows.groupBy("lang").agg(F.percentile("own", F.lit(1 - FALSE_REJECTION)).alias("limit"), F.avg("variance").alias("variance"), *sums).collect()}
    held.unpersist()
    loss = [sum(r[f"loss{i}"] for r in found.values()) for i in range(len(SHARPNESS))]
    kept = [(found[n]["limit"], found[n]["variance"]) if n in found and found[n]["limit"] is not None else (float("inf"), 0.0) for n in bare.languages]
    return LanguageModels(bare.languages, bare.models, SHARPNESS[int(np.argmin(loss))], tuple(x for x, _ in kept), tuple(v**0.5 for _, v in kept))


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every whole text. Null texts and texts without a letter are `und`."""
    short_batches(docs.sparkSession)
    held = broadcast_model(docs.sparkSession, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = held.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learned from the documents not held out, applied to all.

    Held out are documents whose crc32(doc_id) modulo 4 is 2 (a null doc_id counts as the empty text). Repeated rows
    each give a row; other columns are ignored; without labelled rows every text is `und` with score 0.
    """
    models = fit_languages(docs.where(doc_remainder(4) != 2).select("doc_id", "text", "lang"))
    return identify(docs, models).select("doc_id", (doc_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those that language identification rejects; all columns, no shuffle.

    Null texts and texts without a letter are rejected, and without labelled rows every text. Repeated rows are judged
    alike; other columns, whatever their names, are kept; no rows give no rows.
    """
    models = fit_languages(docs.where(doc_remainder(4) != 2).select("doc_id", "text", "lang"))
    short_batches(docs.sparkSession)
    held = broadcast_model(docs.sparkSession, models)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, rejected = held.value.predict(b.column(text).to_pylist())
            yield b.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(load(spark, sf_dir, "documents"))
