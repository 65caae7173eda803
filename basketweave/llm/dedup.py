"""Exact duplicates by a content sort: equal texts become neighbours, the smallest identifier stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, Scratch, free_name, text_or_empty

#: Leading characters of the normalised text that the sampled splitters are made of. Whole texts as
#: splitters would pass the driver; texts alike this far are ordered by their hash and compared whole.
SPLIT_CHARS = 48
#: A text is hot if its copies are more than this part of all rows (and at least ``LEAST_HOT``), so there are fewer hot texts than this.
HOT_PARTS = 65_536
LEAST_HOT = 1_000


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), WHITE, " ")


def hot_texts(docs: DataFrame, text_col: str = "text", least: int = LEAST_HOT) -> DataFrame:
    """``(h, runs)``: hash of each hot text, and the number of runs its copies are dealt over, about ``limit`` rows in each.

    ``limit`` is ``least`` or the ``HOT_PARTS``-th part of all rows, whichever is more: at most ``HOT_PARTS`` rows come out,
    whose runs together are at most twice as many. Only hashes are shuffled, as partial counts.
    """
    limit = max(least, docs.count() // HOT_PARTS)
    counts = docs.select(F.xxhash64(normalised(text_col)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > limit).select("h", F.ceil(F.col("n") / limit).cast("long").alias("runs"))


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: DataFrame | None = None) -> DataFrame:
    """One narrow row per input row: id, sha256 of the normalised text, and its place among its copies.

    The normalised texts are range-partitioned by sampled splitters and sorted inside the partitions
    (externally where they don't fit), so equal texts are neighbours, and a window compares each whole
    text with the one before. All copies of a text are in one run (0), except those of the texts in ``hot``
    (``hot_texts``), which are dealt over several by id, each sorted on its own; ``join_runs`` puts these together. Columns: id,
    text_sha256, run, dealt (whether the text has several runs), run_first (smallest id in the run), run_size,
    run_place (1 for the first row of the run), edge (the text, in the first row of a dealt run). Null texts count
    as empty, null ids sort last.
    """
    keyed = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).withColumn("h", F.xxhash64("norm"))
    if hot is None:
        runs, run = F.lit(1).cast("long"), F.lit(0).cast("long")
    else:  # at most HOT_PARTS rows of two numbers
        keyed = keyed.join(F.broadcast(hot), "h", "left")
        runs = F.coalesce("runs", F.lit(1).cast("long"))
        run = F.pmod(F.xxhash64("id"), runs)
    keyed = keyed.select("id", "norm", "h", F.substring("norm", 1, SPLIT_CHARS).alias("lead"), run.alias("run"), (runs > 1).alias("dealt"))
    order = ["lead", "h"] if hot is None else ["lead", "h", "run"]
    ranged = keyed.repartitionByRange(*order)
    same = Window.partitionBy(*order, "norm")
    by = same.orderBy(F.col("id").asc_nulls_last())
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = ranged.select(
        "*", F.first("id").over(whole).alias("run_first"), F.count(F.lit(1)).over(whole).alias("run_size"), F.row_number().over(by).alias("run_place")
    )
    return placed.select(
        "id",
        "run",
        "dealt",
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
        "run_first",
        "run_size",
        "run_place",
        F.when(F.col("dealt") & (F.col("run_place") == 1), F.col("norm")).alias("edge"),
    )


def join_runs(rows: DataFrame) -> DataFrame:
    """The runs of each hot text put together: whole texts at the runs' edges are compared, the smallest first id stays, sizes add up.

    One row per dealt run, so at most twice ``HOT_PARTS``.
    """
    same = Window.partitionBy("text_sha256", "edge")
    first = same.orderBy(F.col("run_first").asc_nulls_last(), "run")
    return rows.filter(F.col("edge").isNotNull()).select(
        "text_sha256",
        "run",
        F.first("run_first").over(first).alias("all_first"),
        F.sum("run_size").over(same).alias("all_size"),
        (F.row_number().over(first) == 1).alias("leads"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_hot: int = LEAST_HOT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space. Of rows that
    repeat both text and id exactly one is kept. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(content_sort(docs, id_col, text_col, hot_texts(docs, text_col, least_hot)), "content-sort")
    together = F.broadcast(join_runs(rows))  # at most 2 * HOT_PARTS rows of a digest and three numbers
    return rows.drop("edge").join(together, ["text_sha256", "run"], "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("dealt"), F.col("all_first")).otherwise(F.col("run_first")).alias("keep_id"),
        F.when(F.col("dealt"), F.col("all_size")).otherwise(F.col("run_size")).alias("group_size"),
        (F.coalesce("leads", F.lit(True)) & (F.col("run_place") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_duplicates`` keeps."""
    sha, of, place, kept_id = (free_name(docs, c) for c in ("text_sha", "kept_sha", "kept_place", "kept_id"))
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(of))
    marked = docs.withColumn(sha, F.sha2(F.encode(normalised(text_col), "UTF-8"), 256))
    # Rows that repeat id and text are told apart by their other columns, then one is taken.
    met = marked.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(of)), "left_semi")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    order = [F.xxhash64(*rest)] if rest else [F.lit(1)]
    first = F.row_number().over(Window.partitionBy(id_col, sha).orderBy(*order))
    return met.withColumn(place, first).filter(F.col(place) == 1).select(*docs.columns)


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM {docs})
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
