"""Approximate nearest neighbours: cells, score-aware four-bit codes, table scans, exact reranking."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlmill.llm.common import broadcast_model, load, written

#: Vectors that the index is fitted on at most; every vector is indexed.
FIT_ROWS = 8192
#: Vectors per cell, about; fitted vectors per cell, which bound the number of cells; share of the cells that a query
#: looks into, and the fewest. Directions that fill the space evenly leave no cell out of reach, so the share is high by
#: default; pass a lower one where vectors form clusters.
PER_CELL, FIT_PER_CELL, PROBED, LEAST_PROBED = 400, 8, 0.7, 16
#: Candidates that a group reranks per query, and what a rough score may lack to be reranked too (of 255 per table);
#: vectors and queries that one task holds.
RERANKED, ALMOST, BLOCK_VECTORS, BLOCK_QUERIES = 48, 40, 20_000, 4_000
#: Inner products below this share of the largest matter less to the codes.
SCORE_THRESHOLD = 0.2
CODES, WIDTH = 16, 2  # four bits for each pair of dimensions


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors."""
    pick = np.random.default_rng(7).permutation(len(x))[:k]
    centres = x[pick].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        full = np.bincount(own, minlength=len(centres)) > 0
        centres[full] = unit(total[full])
    return centres


@dataclass
class AnisotropicQuantiser:
    """A codebook of 16 words for each pair of dimensions.

    The loss of a unit vector x and its residual r is |r|^2 + (eta - 1) (r . x)^2: error parallel to the vector, which
    moves large inner products, costs eta times as much as error across it.
    """

    books: np.ndarray  # pair of dimensions, code, 2
    eta: float

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = SCORE_THRESHOLD, rounds: int = 4) -> AnisotropicQuantiser:
        pairs = x.reshape(len(x), -1, WIDTH)
        n, m, _ = pairs.shape
        eta = max(1.0, (m * WIDTH - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(11)
        books = np.stack([pairs[rng.integers(0, n, CODES), s] for s in range(m)]) + rng.normal(0, 1e-4, (m, CODES, WIDTH))
        for _ in range(6):  # plain k-means to begin with
            codes = np.argmin(((pairs[:, :, None] - books) ** 2).sum(-1), axis=2)
            for s in range(m):
                for c in range(CODES):
                    own = codes[:, s] == c
                    if own.any():
                        books[s, c] = pairs[own, s].mean(axis=0)
        q = cls(books, eta)
        for _ in range(rounds):
            codes = q.encode(x)
            # least squares over all words at once: a vector's loss is quadratic in the words that it uses
            z = np.zeros((n, m, CODES, WIDTH))
            used = np.zeros((m, CODES))
            for s in range(m):
                z[np.arange(n), s, codes[:, s]] = pairs[:, s]
                used[s] = np.bincount(codes[:, s], minlength=CODES)
            z = z.reshape(n, -1)
            left = (eta - 1) * z.T @ z + np.diag(np.repeat(used.ravel(), WIDTH) + 1e-6)
            right = eta * z.sum(axis=0) + 1e-6 * q.books.ravel()
            q.books = np.linalg.solve(left, right).reshape(q.books.shape)
        return q

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of unit vectors: nearest words first, then each pair of dimensions again for the whole loss."""
        pairs = x.reshape(len(x), -1, WIDTH)
        out = np.empty(pairs.shape[:2], np.uint8)
        along = np.zeros(len(x))  # residual along the vector
        for s in range(pairs.shape[1]):
            out[:, s] = np.argmin(((pairs[:, s, None] - self.books[s]) ** 2).sum(-1), axis=1)
            along += ((pairs[:, s] - self.books[s][out[:, s]]) * pairs[:, s]).sum(-1)
        for _ in range(sweeps):
            for s in range(pairs.shape[1]):
                r = pairs[:, s, None] - self.books[s]
                part = (r * pairs[:, s, None]).sum(-1)
                rest = along - part[np.arange(len(x)), out[:, s]]
                loss = (r**2).sum(-1) + (self.eta - 1) * (rest[:, None] + part) ** 2
                out[:, s] = loss.argmin(axis=1)
                along = rest + part[np.arange(len(x)), out[:, s]]
        return out

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products, up to a scale and shift per query: tables of 16 bytes, sums of 16 bits."""
        tables = np.einsum("qsw,scw->qsc", queries.reshape(len(queries), -1, WIDTH), self.books)
        low = tables.min(axis=2, keepdims=True)
        span = np.maximum((tables - low).max(axis=(1, 2), keepdims=True), 1e-12)
        tables = np.round((tables - low) / span * 255).astype(np.uint8)
        out = np.zeros((len(queries), len(codes)), np.uint16 if tables.shape[1] <= 256 else np.uint32)
        for s in range(codes.shape[1]):
            out += tables[:, s][:, codes[:, s]]
        return out


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    even = np.hstack([codes, np.zeros((len(codes), codes.shape[1] % 2), np.uint8)])
    return even[:, ::2] | (even[:, 1::2] << 4)


def unpack_codes(packed: np.ndarray, m: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)[:, :m]


@dataclass
class Index:
    dimensions: int
    centres: np.ndarray
    quantiser: AnisotropicQuantiser
    probed: int

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))

    def cells(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each unit vector."""
        near = x @ self.centres.T
        return np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(self.centres) else np.broadcast_to(np.arange(len(self.centres)), (len(x), len(self.centres)))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Each vector divided by a power of two, which changes no cosine, so that no square overflows or vanishes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def fit_index(vectors: DataFrame, dims: int, rows: int, per_cell: int = PER_CELL, probed: float = PROBED, fewest: int = LEAST_PROBED) -> Index:
    """From the FIT_ROWS vectors of smallest hash among `rows` distinct ones."""
    cells = max(1, min(FIT_ROWS // FIT_PER_CELL, rows // per_cell))
    share = min(1.0, 1.2 * FIT_ROWS / rows)
    some = vectors.where(F.pmod("h1", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("h1", "h2").limit(FIT_ROWS).select("embedding")

    def fit(table: pa.Table) -> pa.Table:
        x = unit(_matrix(table["embedding"], dims))
        padded = np.pad(x, ((0, 0), (0, -dims % WIDTH)))
        index = Index(dims, k_means(x, cells), AnisotropicQuantiser.fit(padded[: FIT_ROWS // 2]), min(cells, max(fewest, int(np.ceil(cells * probed)))))
        return pa.table({"index": pa.array([pickle.dumps(index)], pa.binary())})

    return pickle.loads(bytes(some.groupBy().applyInArrow(fit, "index binary").first()["index"]))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) without null, zero or non-finite vectors; null ids go too."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("embedding", lambda v: v != 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, per_cell: int = PER_CELL, probed: float = PROBED, fewest: int = LEAST_PROBED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine found for each row whose vec_id `every` divides.

    Vectors of another length than most, and those usable() drops, take no part. Equal vectors are searched as one that
    holds its k + 1 smallest ids, so copies neither crowd the candidates nor lose ties, and rows that repeat a vec_id
    with another vector are candidates each, under that id once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["d"]
    rows = rows.where(F.size("embedding") == dims).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    ids = rows.select("vec_id", "h1", "h2").distinct()
    least = ids.withColumn("place", F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    least = least.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    firsts = rows.groupBy("h1", "h2").agg(F.min("embedding").alias("embedding"))
    distinct = written(firsts.join(least, ["h1", "h2"]).select("h1", "h2", "embedding", "ids"), "ann-distinct")
    index = fit_index(distinct, dims, distinct.count(), per_cell, probed, fewest)
    held, m = broadcast_model(spark, index), (dims + 1) // WIDTH

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column("embedding"), dims))
                cell = held.value.cells(x)[:, 0] if len(held.value.centres) > 1 else np.zeros(len(x), np.int64)
                codes = pack_codes(held.value.quantiser.encode(held.value.padded(x)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], [*b.schema.names, "cell", "codes"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = held.value.cells(unit(_matrix(b.column("embedding"), dims)), held.value.probed)
                at = np.repeat(np.arange(b.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns), pa.array(near.ravel().astype(np.int32))], [*b.schema.names, "cell"])

    indexed = written(distinct.mapInArrow(encode, "h1 long, h2 long, embedding array<double>, ids array<long>, cell int, codes binary"), "ann-index")
    asked = written(ids.where(F.col("vec_id") % every == 0), "ann-queries")
    queries = distinct.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "embedding")
    probes = written(queries.mapInArrow(probe, "h1 long, h2 long, embedding array<double>, cell int"), "ann-probes")
    # cells with many vectors or queries are split: a group meets one block of each
    sizes = indexed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("nv"))
    sizes = sizes.join(probes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("nq")), "cell")

    def blocks(df: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        df = df.join(sizes, "cell").withColumn(own_name, F.pmod(F.xxhash64("h1", "h2", F.lit(5)), F.col(own)).cast("int"))
        return df.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("nv", "nq")

    left = blocks(indexed, "nv", "nq", "v", "q").groupBy("cell", "v", "q")
    right = blocks(probes, "nq", "nv", "q", "v").groupBy("cell", "v", "q")

    def search(vecs: pa.Table, asks: pa.Table) -> pa.Table:
        if not vecs.num_rows or not asks.num_rows:
            return pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        vecs = vecs.combine_chunks()
        x, want = _matrix(vecs["embedding"], dims), _matrix(asks["embedding"], dims)
        codes = unpack_codes(np.frombuffer(b"".join(vecs["codes"].to_pylist()), np.uint8).reshape(len(x), -1), m)
        low = np.array([i[0] for i in vecs["ids"].to_pylist()])
        scale, found, score, asker = np.linalg.norm(x, axis=1), [], [], []
        few, step = min(RERANKED, len(x)), max(1, (1 << 21) // len(x))
        for i in range(0, len(want), step):
            part = want[i : i + step]
            rough = held.value.quantiser.scan(held.value.padded(unit(part)), codes).astype(np.int32)
            # all that come as near as the last of the few, ties and almost ties too
            last = -np.partition(-rough, few - 1, axis=1)[:, few - 1 : few] - ALMOST
            who, near = np.nonzero(rough >= last)
            exact = np.empty(len(who))
            for j in range(0, len(who), 1 << 16):
                exact[j : j + (1 << 16)] = np.einsum("pd,pd->p", part[who[j : j + (1 << 16)]], x[near[j : j + (1 << 16)]])
            exact /= np.linalg.norm(part, axis=1)[who] * scale[near]
            order = np.lexsort((low[near], -exact, who))
            start = np.searchsorted(who, np.arange(len(part)))[who[order]]
            kept = order[np.arange(len(order)) - start <= k]
            found.append(near[kept])
            score.append(exact[kept])
            asker.append(i + who[kept])
        at = pa.array(np.concatenate(asker))
        return pa.table({"h1": asks["h1"].take(at), "h2": asks["h2"].take(at), "ids": vecs["ids"].take(pa.array(np.concatenate(found))), "score": np.concatenate(score)})

    hits = left.cogroup(right).applyInArrow(search, "h1 long, h2 long, ids array<long>, score double")
    best = hits.withColumn("place", F.row_number().over(W.partitionBy("h1", "h2").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("place") <= k + 1).drop("place")
    pairs = asked.withColumnRenamed("vec_id", "query_id").join(best, ["h1", "h2"]).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"))
