"""Item vectors: ordered item lists, skip-gram training, reduction to a few dimensions."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketweave.operators.recency import with_positions

# The learner keeps the vocabulary and two matrices of this many floats on the driver and on every executor.
MAX_MODEL_FLOATS = 500_000_000


def item_sequences(events: DataFrame, max_length: int = 1000) -> DataFrame:
    """Items of each session in time order, as ``(session, chunk, sentence)``.

    A session longer than ``max_length`` gives several chunks: the learner cuts sentences there anyway, and
    no array grows with a session.
    """
    positioned = with_positions(events)
    return (
        positioned.withColumn("chunk", F.floor(F.col("position") / max_length))
        .groupBy("session", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("position", "aid"))).alias("items"))
        .select("session", "chunk", F.transform("items", lambda i: i["aid"].cast("string")).alias("sentence"))
    )


def overlapping_chunks(positioned: DataFrame, columns: list[str], length: int, margin: int) -> DataFrame:
    """Sessions cut into chunks that know their neighbours: ``(session, chunk, items, skip, core)``.

    ``items`` are structs of ``position`` and ``columns`` in time order. The ``core`` items after the first ``skip``
    belong to this chunk alone; up to ``margin`` (at most ``length``) items of the session on either side come with
    them, so a window of that reach around each core item is whole and no pair is lost or made twice.
    ``positioned`` comes from ``with_positions``.
    """
    at, last = F.col("position"), F.floor((F.col("session_length") - 1) / length)
    first = F.floor(F.greatest(at - margin, F.lit(0)) / length)
    chunk = F.explode(F.sequence(first, F.least(F.floor((at + margin) / length), last))).alias("chunk")
    own = F.when(F.floor(at / length) == F.col("chunk"), 1)
    return (
        positioned.select("session", "position", chunk, *columns)
        .groupBy("session", "chunk")
        .agg(
            F.array_sort(F.collect_list(F.struct("position", *columns))).alias("items"),
            F.count(F.when(at < F.col("chunk") * length, 1)).cast("int").alias("skip"),
            F.count(own).cast("int").alias("core"),
        )
    )


def train_item_vectors(
    sequences: DataFrame,
    size: int = 50,
    window: int = 3,
    epochs: int = 5,
    seed: int = 3655,
    partitions: int | None = None,
) -> DataFrame:
    """Skip-gram vectors ``(aid, vector)`` of every item in ``sequences``.

    The vocabulary is the item catalogue. Its size is checked first, because the learner holds the model in
    each JVM; ``skipgram.train_skipgram`` takes any catalogue.
    """
    spark = sequences.sparkSession
    items = sequences.select(F.explode("sentence").alias("aid")).distinct().count()
    if 2 * items * size > MAX_MODEL_FLOATS:
        raise ValueError(f"{items} items of {size} dimensions exceed MAX_MODEL_FLOATS; use fewer dimensions")
    learner = Word2Vec(
        vectorSize=size,
        windowSize=window,
        maxIter=epochs,
        minCount=1,
        numPartitions=partitions or spark.sparkContext.defaultParallelism,
        seed=seed,
        inputCol="sentence",
        outputCol="vector",
    )
    vectors = learner.fit(sequences.select("sentence")).getVectors()
    return vectors.select(F.col("word").cast("long").alias("aid"), vector_to_array("vector").alias("vector"))


def flatten_vectors(vectors: DataFrame, size: int = 50) -> DataFrame:
    """``(aid, vec_0 .. vec_{size-1})``."""
    return vectors.select("aid", *[F.col("vector")[i].alias(f"vec_{i}") for i in range(size)])


def reduce_vectors(vectors: DataFrame, k: int = 10) -> DataFrame:
    """``(aid, svd_0 .. svd_{k-1})``: rows of U * Sigma of the truncated, uncentred SVD.

    The small right factor V is found from the distributed Gram matrix; items are projected with it as a
    column expression. Each V column gets a positive entry of largest magnitude, which fixes the sign.
    """
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector("vector").alias("row")), "row")
    v = RowMatrix(rows).computeSVD(k, computeU=False).V.toArray()
    columns = []
    for j in range(v.shape[1]):
        column = v[:, j]
        if column[abs(column).argmax()] < 0:
            column = -column
        terms = [F.col("vector")[i].cast("double") * F.lit(float(x)) for i, x in enumerate(column)]
        columns.append(sum(terms[1:], terms[0]).alias(f"svd_{j}"))
    return vectors.select("aid", *columns)
