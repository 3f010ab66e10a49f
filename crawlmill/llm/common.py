"""What the corpus operators share: the shared folder, written tables, null-safe columns, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlmill.storage import shared_dir, shared_path, written

__all__ = ["shared_dir", "shared_path", "written"]

#: Bytes in an Arrow batch handed to Python: documents may hold megabytes each.
BATCH_BYTES = 2 << 20


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_holder: list = [None, None]


def hold_alone(owner: object, forget: Callable[[], None]) -> None:
    """A Python worker serves one stage after another and lives on: what the last owner remembers is freed first."""
    if _holder[0] is not owner:
        if _holder[1]:
            _holder[1]()
        _holder[:] = owner, forget


class Memory(dict):
    """What `learn` gives for a text, remembered within a number of bytes in two generations, of which the older goes.

    `turn` is called between batches, so nothing that a batch has looked up goes before the batch is done.
    """

    #: Headers of key and value and their place in the table.
    ENTRY_BYTES = 170

    def __init__(self, learn: Callable[[str], bytes], most_bytes: int):
        super().__init__()
        self.learn, self.most, self.old, self.used = learn, most_bytes // 2, {}, 0

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.learn(key)
        self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        self[key] = value
        self.used += len(key) + len(value) + self.ENTRY_BYTES

    def unknown(self, keys: set[str]) -> list[str]:
        return [k for k in keys.difference(self) if k not in self.old]

    def turn(self) -> None:
        if self.used > self.most:
            self.old = self.copy()
            self.clear()
            self.used = 0

    def forget(self) -> None:
        self.clear()
        self.old, self.used = {}, 0


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scan_partitions(df: DataFrame) -> int:
    """How many partitions a scan of df has; grows with its bytes."""
    return max(1, df.rdd.getNumPartitions())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def doc_remainder(divisor: int) -> Column:
    """crc32 of the decimal doc_id modulo divisor; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


#: Groups that smallest_hashes takes at most, those of most rows.
MOST_GROUPS = 200


def smallest_hashes(rows: DataFrame, by: str, hashed: str, most: int) -> DataFrame:
    """rows with place: for each of the MOST_GROUPS commonest values of `by`, the `most` rows of smallest `hashed`.

    `hashed` is a signed 64-bit hash. Counts, which are broadcast, say below which hash half as many again must lie; only
    those rows move, and meet in one task.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("_rows")).orderBy(F.desc("_rows"), by).limit(MOST_GROUPS)
    counts = F.broadcast(rows.sparkSession.createDataFrame(counts.collect(), counts.schema))
    share = F.lit(1.5 * most + 50) / F.col("_rows")
    near = F.col(hashed).cast("double") <= (2 * share - 1) * F.lit(float(1 << 63))
    order = W.partitionBy(by).orderBy(hashed, *[c for c in rows.columns if c not in (by, hashed)])
    return rows.join(counts, by).where(near).drop("_rows").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def commonest(counts: DataFrame, key: str, most: int) -> DataFrame:
    """Of rows (key, n), about `most` at most of those of largest n: classes of n of equal bit length as long as they fit, and
    of the next class a share by hash. For what all workers hold, while the other rows meet by a join: which rows it is, no result shows.
    """
    classed = counts.select(key, "n", F.length(F.bin("n")).alias("bits"))
    held, at, share = 0, 0, 0.0
    for r in classed.groupBy("bits").count().orderBy(F.desc("bits")).collect():  # 64 rows at most
        if held + r["count"] > most:
            at, share = r["bits"], 0.9 * (most - held) / r["count"]
            break
        held += r["count"]
    some = (F.col("bits") == at) & (F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)))
    return classed.where((F.col("bits") > at) | some).select(key, "n")


_models: list[Broadcast] = []


def broadcast_model(spark: SparkSession, model: object) -> Broadcast:
    """A broadcast of bounded size that executors drop when release_models is called, and fetch again if need be."""
    _models.append(spark.sparkContext.broadcast(model))
    return _models[-1]


def destroy_model(model: Broadcast) -> None:
    """Free driver and executors of a model that no plan needs any more; release_models leaves it alone from then on."""
    _models[:] = [m for m in _models if m is not model]
    model.destroy()


def release_models() -> None:
    """Free the executors of models whose results are written."""
    for m in _models:
        m.unpersist()
    _models.clear()


def text_hashes(name: str = "text") -> list[Column]:
    """128 bits that stand for a text, null as the empty one."""
    return [F.xxhash64(text_or_empty(name)), F.xxhash64(F.lit(1), text_or_empty(name))]


#: Bits that marks of keys are spread over: 128 rows of 4 KB for each 4 million.
MARK_BITS = 1 << 25


def _mark_of(names: list[str]) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(MARK_BITS)) + 1


def marked(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """rows with `doubtful`: whether a bit of their key is set in a bitmap of keys. Only keys whose bit is set can be there.

    The bitmap, which is broadcast, holds MARK_BITS bits however many keys there are; more keys set more of them.
    """
    place = F.bitmap_bit_position("mark").cast("int")
    marks = keys.select(_mark_of(names).alias("mark")).select(F.bitmap_bucket_number("mark").alias("bucket"), place.alias("place"))
    marks = marks.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    rows = rows.withColumn("mark", _mark_of(names)).withColumn("place", place).withColumn("bucket", F.bitmap_bucket_number("mark"))
    byte = F.conv(F.hex(F.col("bits").substr((F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, (F.col("place") % 8).cast("int")) == 1
    return rows.join(F.broadcast(marks), "bucket", "left").withColumn("doubtful", F.coalesce(bit, F.lit(False))).drop("mark", "place", "bucket", "bits")


def without_rows(docs: DataFrame, key: list[Column], gone: DataFrame, twice: DataFrame) -> DataFrame:
    """docs without the rows whose key is in `gone`, and with one row of each key in `twice`; their columns are the key's.

    Rows travel as one struct, so no name of theirs can clash. Those whose key a bitmap of bounded size rules out of both
    lists stay where they are; the others are joined. Only where keys repeat are rows grouped, each task sending one row
    per key.
    """
    names, others = [f"k{i}" for i in range(len(key))], [f"o{i}" for i in range(len(key))]

    def meet(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        on = F.lit(True)
        for k, o in zip(names, others):
            on = on & F.col(k).eqNullSafe(F.col(o))
        return rows.join(other.toDF(*others), on, how)

    rows = docs.select(F.struct("*").alias("row"), *[k.alias(n) for k, n in zip(key, names)])
    rows = marked(rows, gone.unionByName(twice).toDF(*names), names)
    clear, doubted = rows.where("not doubtful").select("row"), meet(rows.where("doubtful"), gone, "left_anti")
    if not twice.isEmpty():
        once = meet(doubted, twice, "left_semi").groupBy(*names).agg(F.first("row").alias("row"))
        doubted = meet(doubted, twice, "left_anti").select("row").unionByName(once.select("row"))
    return clear.unionByName(doubted.select("row")).select("row.*")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    edges has two long columns a and b. Returns (u, root), a row for each vertex that is not the smallest of its
    component. Each round is written to the shared folder; the driver sees a row count and a checksum only.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    mark = _mark(e)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        low = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        star = e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        both = star.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = written(both.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        before, mark = mark, _mark(e)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select("u", F.col("v").alias("root"))


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
