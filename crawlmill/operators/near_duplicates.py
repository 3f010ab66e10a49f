"""Near-duplicate pairs, first-come unique responses and clusters, over 64-bit signatures."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.constants import NEAR_DISTANCE, UNIQUE_DISTANCE
from crawlmill.functions.simhash import block_masks, blocks, hamming
from crawlmill.storage import written


def class_pairs(signatures: DataFrame, distance: int = NEAR_DISTANCE, column: str = "signature") -> DataFrame:
    """(a, b, distance): pairs of distinct signatures, a < b, at most `distance` bits apart.

    Signatures meet where they agree on a choice of blocks. Equal signatures are one class, so copies cost nothing. A pair
    is kept in the first choice on which it agrees, so no distinct is needed. Spark takes the rows of all choices to be as
    small as the signatures and would broadcast them, so the join is told to merge.
    """
    distinct = signatures.where(F.col(column).isNotNull()).select(F.col(column).alias("s")).distinct()
    cut = distinct.select("s", blocks(F.col("s"), distance))
    x, y = cut.withColumnRenamed("s", "a"), cut.withColumnRenamed("s", "b")
    xor = F.col("a").bitwiseXOR(F.col("b"))
    agree = F.array(*[xor.bitwiseAND(F.lit(m)) == 0 for m in block_masks(distance)])
    near = hamming(F.col("a"), F.col("b"))
    pairs = x.join(y.hint("merge"), ["block", "part"]).where((F.col("a") < F.col("b")) & (near <= distance))
    return pairs.where(F.array_position(agree, F.lit(True)) == F.col("block") + 1).select("a", "b", near.alias("distance"))


def near_pairs(signatures: DataFrame, key: str, distance: int = NEAR_DISTANCE) -> DataFrame:
    """(a, b, distance) between the smallest keys of signature classes; equal signatures are listed by membership()."""
    reps = signatures.groupBy("signature").agg(F.min(key).alias("rep"))
    pairs = class_pairs(signatures, distance)
    left, right = reps.select(F.col("signature").alias("a"), F.col("rep").alias("ra")), reps.select(F.col("signature").alias("b"), F.col("rep").alias("rb"))
    named = pairs.join(left, "a").join(right, "b")
    return named.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "distance")


def near_between(left: DataFrame, right: DataFrame, key: str, distance: int = NEAR_DISTANCE, column: str = "signature") -> DataFrame:
    """(a, b, distance): the smallest keys of signature classes of left and of right that are at most `distance` bits apart.

    Classes of either table meet where they agree on a choice of blocks, by a merge join as in class_pairs; equal signatures are 0 bits apart.
    """
    x, y = (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(s)).agg(F.min(key).alias(k)) for df, s, k in ((left, "s", "a"), (right, "t", "b")))
    x, y = x.select("s", "a", blocks(F.col("s"), distance)), y.select("t", "b", blocks(F.col("t"), distance))
    xor, near = F.col("s").bitwiseXOR(F.col("t")), hamming(F.col("s"), F.col("t"))
    agree = F.array(*[xor.bitwiseAND(F.lit(m)) == 0 for m in block_masks(distance)])
    pairs = x.join(y.hint("merge"), ["block", "part"]).where(near <= distance)
    return pairs.where(F.array_position(agree, F.lit(True)) == F.col("block") + 1).select("a", "b", near.alias("distance"))


def membership(signatures: DataFrame, key: str) -> DataFrame:
    """(key, representative): the smallest key of equal signatures."""
    reps = signatures.groupBy("signature").agg(F.min(key).alias("representative"))
    return signatures.join(reps, "signature").select(key, "representative")


#: Pairs of a block whose rows one task decides in order.
BLOCK_PAIRS = 1 << 20
_UNDECIDED, _KEPT, _DROPPED = 0, 1, 2


def _decided(table: pa.Table) -> pa.Table:
    """What a block's rows become, in order: (v, state). table has u, v and the state of u where it is known from before."""
    table = table.sort_by("v")
    own: dict[int, int] = {}
    for u, v, state in zip(table["u"].to_pylist(), table["v"].to_pylist(), table["state"].to_pylist()):
        known = own.get(u, state)
        if own.get(v) != _DROPPED:
            own[v] = _DROPPED if known == _KEPT else _UNDECIDED if known == _UNDECIDED or own.get(v) == _UNDECIDED else _KEPT
    return pa.table({"n": pa.array(own.keys(), pa.int64()), "state": pa.array(own.values(), pa.int32())})


def unique_responses(signatures: DataFrame, order: str, distance: int = UNIQUE_DISTANCE, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(order): rows that no earlier kept row is within `distance` bits of; `order` is a unique whole number and ascends.

    The lexicographically first independent set. Pairs lie in blocks by their later row, in order. In a round each block
    decides all its rows that hang on decided rows or on others of the block, so a chain of neighbours in order takes as many
    rounds as it crosses blocks; rows in random order hang on few others. Each round is written to the shared folder.
    Every row of the input has a signature; bodies without one are a class apart and stay out of it.
    """
    nodes = signatures.groupBy("signature").agg(F.min(order).cast("long").alias("n"))
    left, right = nodes.select(F.col("signature").alias("a"), F.col("n").alias("na")), nodes.select(F.col("signature").alias("b"), F.col("n").alias("nb"))
    pairs = class_pairs(signatures, distance).join(left, "a").join(right, "b")
    edges = written(pairs.select(F.least("na", "nb").alias("u"), F.greatest("na", "nb").alias("v")), "unique-edges")
    blocks_there = max(1, -(-edges.count() // block_pairs))
    # rows without an earlier neighbour are kept from the start
    first = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_anti").select(F.col("u").alias("n"), F.lit(_KEPT).alias("state"))
    decided = written(first, "unique-decided")
    edges = edges.repartitionByRange(blocks_there, "v").withColumn("block", F.spark_partition_id()).join(decided.withColumnRenamed("n", "u"), "u", "left")
    open_edges = written(edges.select("u", "v", "block", F.coalesce("state", F.lit(_UNDECIDED)).alias("state")), "unique-open")
    while not open_edges.isEmpty():
        found = open_edges.groupBy("block").applyInArrow(_decided, "n long, state int").where(F.col("state") != _UNDECIDED)
        found = written(found, "unique-decided")
        decided = decided.unionByName(found)
        rest = open_edges.join(found.select(F.col("n").alias("v")), "v", "left_anti").join(found.withColumnsRenamed({"n": "u", "state": "now"}), "u", "left")
        open_edges = written(rest.select("u", "v", "block", F.coalesce("now", "state").alias("state")), "unique-open")
    gone = decided.where(F.col("state") == _DROPPED).select("n")
    return nodes.select("n").join(gone, "n", "left_anti").select(F.col("n").alias(order))


def clusters(signatures: DataFrame, key: str, distance: int = NEAR_DISTANCE) -> DataFrame:
    """(key, cluster): the smallest key that near pairs reach.

    Labels of signature classes fall to the smallest of their neighbours, then jump to their label's label, until none
    changes; each round is written to the shared folder.
    """
    nodes = signatures.groupBy("signature").agg(F.min(key).alias("low"))
    pairs = class_pairs(signatures, distance)
    edges = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cluster-edges")
    labels = written(nodes.select(F.col("signature").alias("a"), F.col("low").alias("label")), "cluster-labels")
    while True:
        around = edges.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        fallen = labels.join(around, "a", "left").select("a", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        fallen = written(fallen, "cluster-labels")
        # low names its own class: follow the label of the class that holds it
        owner = nodes.select(F.col("signature").alias("a"), "low").join(fallen.select("a", F.col("new").alias("next")), "a").select(F.col("low").alias("new"), "next")
        jumped = written(fallen.join(owner, "new", "left").select("a", "label", F.coalesce("next", "new").alias("new")), "cluster-labels")
        if jumped.where("new <> label").isEmpty():
            return signatures.join(jumped.select(F.col("a").alias("signature"), F.col("new").alias("cluster")), "signature").select(key, "cluster")
        labels = jumped.select("a", F.col("new").alias("label"))
