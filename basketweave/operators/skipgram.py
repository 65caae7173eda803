"""Skip-gram item vectors with negative sampling, for catalogues of any size.

Items are dealt over blocks by hash. Item blocks and context blocks meet in rounds: in round r the vectors of
block i and the contexts of block i + r learn from their pairs, so no two cells of a round share a vector and no
process holds more than two blocks. A cell with many pairs is split into parts; each part learns from the vectors
the round began with, and an item moves by the mean of what the parts that touched it found. Vectors are a stored
table that each round writes anew, so a lost executor costs the retry of its tasks; all random numbers come from
hashes and from seeds of (epoch, cell, part), so a retry gives the same result.

Negatives of a pair are drawn from the context block it meets. Blocks are random sets of items and a pair draws
once for each context, so in expectation an item meets negatives as it would over the whole catalogue.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketweave.operators.recency import with_positions
from basketweave.operators.vectors import overlapping_chunks
from basketweave.session import drop_stage, write_stage

SLICE = 1000  # items per row of the vector table
MERGE = 64  # parts whose moves are added in one group
SIDES = "side INT, block INT, slice INT"
STATE = f"{SIDES}, aids ARRAY<BIGINT>, counts ARRAY<BIGINT>, vectors ARRAY<FLOAT>"
MOVES = f"{SIDES}, part INT, moves ARRAY<FLOAT>, touched ARRAY<INT>"
LAST_RATE = 1e-4


def uniform(*columns):
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def item_blocks(events: DataFrame, block_items: int, sample: float) -> tuple[DataFrame, str, int]:
    """``(aid, n, block, place, keep)`` of every item, its path, and the number of blocks.

    ``keep`` is the share of the item's events that subsampling keeps.
    """
    counts, path = write_stage(events.where("aid IS NOT NULL").groupBy(F.col("aid").cast("long").alias("aid")).agg(F.count("*").alias("n")), "item-counts")
    items, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-items // block_items))
    share = F.col("n") / F.lit(float(max(total, 1)))
    placed = counts.withColumn("block", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int")).select(
        "aid",
        "n",
        "block",
        (F.row_number().over(Window.partitionBy("block").orderBy("aid")) - 1).cast("int").alias("place"),
        (F.sqrt(sample / share) + sample / share).alias("keep") if sample else F.lit(1.0).alias("keep"),
    )
    stored, stored_path = write_stage(placed, "item-blocks")
    drop_stage(events.sparkSession, path)
    return stored, stored_path, blocks


def context_pairs(events: DataFrame, items: DataFrame, window: int, seed: int, length: int = 1000) -> DataFrame:
    """``(i, j, center, context, mix)``: block and place of both items of each pair, and a hash of the pair.

    Each kept event is the centre of one window of random reach 1 to ``window``, also next to a chunk's edge.
    """
    kept = (
        events.select("session", F.col("aid").cast("long").alias("aid"), "ts", "event_id")
        .join(items, "aid")
        .where(uniform("session", "ts", "event_id", "aid", F.lit(seed)) < F.col("keep"))
        .select("session", "ts", "event_id", "block", F.col("place").alias("row"))
    )
    chunks = overlapping_chunks(with_positions(kept), ["block", "row"], length, window)
    reach = lambda c: (F.pmod(F.xxhash64("session", c["position"], F.lit(seed)), F.lit(window)) + 1).cast("int")
    first = F.col("items")[0]["position"]

    def around(c):
        index = (c["position"] - first).cast("int")
        before = F.least(index, reach(c))
        near = F.slice("items", index - before + 1, before + 1 + reach(c))
        return F.transform(
            F.filter(near, lambda x: x["position"] != c["position"]),
            lambda x: F.struct(
                c["block"].alias("i"),
                x["block"].alias("j"),
                c["row"].alias("center"),
                x["row"].alias("context"),
                F.xxhash64("session", c["position"], x["position"]).alias("mix"),
            ),
        )

    core = F.slice("items", F.col("skip") + 1, F.col("core"))
    return chunks.select(F.explode(F.flatten(F.transform(core, around))).alias("pair")).select("pair.*")


def packed_pairs(pairs: DataFrame, blocks: int, part_pairs: int) -> DataFrame:
    """``(round, i, j, part, centers, contexts)``: rows of about ``part_pairs`` pairs of one cell."""
    cells = pairs.groupBy("i", "j").agg(F.ceil(F.count("*") / part_pairs).alias("parts"))
    return (
        pairs.join(cells, ["i", "j"])
        .withColumn("part", F.pmod("mix", F.col("parts")).cast("int"))
        .groupBy("i", "j", "part")
        .agg(F.collect_list(F.struct("center", "context")).alias("pairs"))
        .select(
            F.pmod(F.col("j") - F.col("i"), F.lit(blocks)).cast("int").alias("round"),
            "i",
            "j",
            "part",
            F.col("pairs.center").alias("centers"),
            F.col("pairs.context").alias("contexts"),
        )
        .sortWithinPartitions("round")
    )


def first_state(items: DataFrame, size: int, seed: int) -> DataFrame:
    """Side 0, item vectors: small random numbers; side 1, context vectors: zeros."""
    slices = (
        items.groupBy("block", F.floor(F.col("place") / SLICE).cast("int").alias("slice"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "aid", "n"))).alias("items"))
        .select("block", "slice", F.col("items.aid").alias("aids"), F.col("items.n").alias("counts"))
    )

    def start(aid):
        return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: ((uniform(aid, k, F.lit(seed)) - 0.5) / size).cast("float"))

    begun = slices.select(F.lit(0).alias("side"), "*", F.flatten(F.transform("aids", start)).alias("vectors"))
    zeros = slices.select(F.lit(1).alias("side"), "*", F.array_repeat(F.lit(0.0).cast("float"), (F.size("aids") * size)).alias("vectors"))
    return begun.unionByName(zeros)


DRAWN = 4096  # pairs whose negatives are drawn, and whose rows are put in order, at once


def runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line of ``rows``: the order that brings equal ones together, where runs of them start in it, their values, and the line's end among these."""
    order = np.argsort(rows, axis=1, kind="stable")
    ordered = np.take_along_axis(rows, order, axis=1)
    first = np.ones(rows.shape, dtype=bool)
    np.not_equal(ordered[:, 1:], ordered[:, :-1], out=first[:, 1:])
    return order, np.nonzero(first)[1], ordered[first], np.cumsum(first.sum(axis=1))


def add_runs(matrix: np.ndarray, order: np.ndarray, first: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add ``values`` to the rows of ``matrix``, those of one row together (see ``runs``)."""
    matrix[rows] += np.add.reduceat(values[order], first)


def add_rows(matrix: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add ``values`` to the given rows, which may repeat."""
    order, first, found, _ = runs(rows[None])
    add_runs(matrix, order[0], first, found, values)


def learn_pairs(inner, outer, counts, centers, contexts, rate, last_rate, negatives, exponent, rng) -> None:
    """One pass over the pairs in random order, in place; batches are small beside the number of contexts.

    What doesn't rest on the vectors is worked out for many batches at once: small blocks make millions of batches.
    """
    weights = np.cumsum(counts.astype(np.float64) ** exponent)
    weights /= weights[-1]
    batch = int(np.clip(len(outer) // 4, 16, 4096))
    size = outer.shape[1]
    order = rng.permutation(len(centers))
    whole = len(order) // batch * batch
    many = max(1, DRAWN // batch) * batch
    for begin in (*range(0, whole, many), *([whole] if whole < len(order) else [])):
        end = min(begin + many, whole) if begin < whole else len(order)
        taken = order[begin:end]
        c, o = centers[taken], contexts[taken]
        drawn = np.minimum(np.searchsorted(weights, rng.random((len(c), negatives)), side="right"), len(outer) - 1)
        targets = np.concatenate([o[:, None], drawn], axis=1)
        struck = np.concatenate([np.zeros((len(c), 1), dtype=bool), drawn == o[:, None]], axis=1)
        length = min(batch, len(c))
        outer_order, outer_first, outer_rows, outer_end = runs(targets.reshape(len(c) // length, -1))
        inner_order, inner_first, inner_rows, inner_end = runs(c.reshape(-1, length))
        p = q = 0
        for k in range(len(c) // length):
            span = slice(k * length, (k + 1) * length)
            w, v = inner[c[span]], outer[targets[span]]
            grad = -1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", w, v), -30, 30)))
            grad[:, 0] += 1
            grad[struck[span]] = 0
            grad = (grad * (rate + (last_rate - rate) * (begin + span.start) / len(order))).astype(np.float32)
            moved = (grad[:, :, None] * w[:, None, :]).reshape(-1, size)
            mine, theirs = slice(p, outer_end[k]), slice(q, inner_end[k])
            add_runs(outer, outer_order[k], outer_first[mine], outer_rows[mine], moved)
            add_runs(inner, inner_order[k], inner_first[theirs], inner_rows[theirs], np.einsum("bk,bkd->bd", grad, v))
            p, q = mine.stop, theirs.stop


def trainer(size: int, rate: float, last_rate: float, negatives: int, exponent: float, seed: tuple):
    """The task of one part of a cell: its pairs and the slices of its two blocks give moves."""

    def train(pairs: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values(["side", "slice"])
        sides = [given[given["side"] == s] for s in (0, 1)]
        old = [np.concatenate(list(part["vectors"])).astype(np.float32).reshape(-1, size) for part in sides]
        new = [m.copy() for m in old]
        cell = pairs.iloc[0]
        centers, contexts = (np.asarray(cell[c], dtype=np.int64) for c in ("centers", "contexts"))
        rng = np.random.default_rng([*seed, int(cell["i"]), int(cell["j"]), int(cell["part"])])
        counts = np.concatenate(list(sides[1]["counts"]))
        learn_pairs(*new, counts, centers, contexts, rate, last_rate, negatives, exponent, rng)
        out = []
        for part, before, after in zip(sides, old, new, strict=True):
            at = 0
            for row in part.itertuples():
                span = slice(at, at + len(row.counts))
                at = span.stop
                moves = after[span] - before[span]
                touched = moves.any(axis=1)
                if touched.any():
                    out.append((row.side, row.block, row.slice, cell["part"], moves.ravel(), touched.astype(np.int32)))
        return pd.DataFrame(out, columns=["side", "block", "slice", "part", "moves", "touched"])

    return train


def add_moves(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum of the moves of at most MERGE parts of a slice."""
    row = rows.iloc[0]
    rows = rows.sort_values("part")
    out = (row["side"], row["block"], row["slice"], row["part"] // MERGE, np.sum(list(rows["moves"]), axis=0), np.sum(list(rows["touched"]), axis=0))
    return pd.DataFrame([out], columns=["side", "block", "slice", "part", "moves", "touched"])


def move(state: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
    """A slice moved by the mean of the parts that touched each item."""
    if len(moves):
        moves = moves.sort_values("part")
        old = np.asarray(state["vectors"].iloc[0], dtype=np.float32)
        touched = np.maximum(np.sum(list(moves["touched"]), axis=0), 1)
        total = np.sum(list(moves["moves"]), axis=0).reshape(len(touched), -1)
        state = state.assign(vectors=[(old + (total / touched[:, None]).ravel()).astype(np.float32)])
    return state


def train_skipgram(
    events: DataFrame,
    size: int = 50,
    window: int = 3,
    epochs: int = 5,
    negatives: int = 5,
    exponent: float = 1.0,
    sample: float = 1e-3,
    rate: float = 0.025,
    seed: int = 3655,
    block_items: int = 100_000,
    part_pairs: int = 1_000_000,
) -> DataFrame:
    """Vectors ``(aid, vector)`` of every item of an event log.

    Frequent items are subsampled (``sample``; 0 keeps all events), which also bounds what one item adds to a cell.
    Subsampling and the reach of windows are drawn once, from hashes, and serve all epochs. An epoch has as many
    rounds as there are blocks of ``block_items`` items. Events without an item are skipped; an item whose events
    are all subsampled away keeps its first random vector. An empty log gives no rows.
    """
    spark = events.sparkSession
    items, items_path, blocks = item_blocks(events, block_items, sample)
    pairs, pairs_path = write_stage(context_pairs(events, items, window, seed), "pairs")
    packed, packed_path = write_stage(packed_pairs(pairs, blocks, part_pairs), "packed-pairs")
    drop_stage(spark, pairs_path)
    state, path = write_stage(first_state(items, size, seed), "item-vectors")
    drop_stage(spark, items_path)
    most = packed.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    cell, sides = ["i", "j", "part"], ["side", "block", "slice"]
    steps = epochs * blocks
    for step in range(steps):
        rates = [max(LAST_RATE, rate * (1 - s / steps)) for s in (step, step + 1)]
        here = packed.where(F.col("round") == step % blocks)
        met = here.select(*[F.col(c).alias(f"met_{c}") for c in cell])
        given = met.join(state.where("side = 0"), F.col("met_i") == F.col("block")).unionByName(
            met.join(state.where("side = 1"), F.col("met_j") == F.col("block"))
        )
        train = trainer(size, *rates, negatives, exponent, (seed, step))
        moves = here.groupBy(*cell).cogroup(given.groupBy(*[f"met_{c}" for c in cell])).applyInPandas(train, MOVES)
        left = most
        while left > MERGE:
            moves = moves.groupBy(*sides, F.floor(F.col("part") / MERGE)).applyInPandas(add_moves, MOVES)
            left = -(-left // MERGE)
        keyed = moves.select(*[F.col(c).alias(f"of_{c}") for c in sides], "part", "moves", "touched")
        moved = state.groupBy(*sides).cogroup(keyed.groupBy(*[f"of_{c}" for c in sides])).applyInPandas(move, STATE)
        state, new_path = write_stage(moved, "item-vectors")
        drop_stage(spark, path)
        path = new_path
    drop_stage(spark, packed_path)
    rows = state.where("side = 0").select(F.posexplode("aids").alias("at", "aid"), "vectors")
    return rows.select("aid", F.slice("vectors", F.col("at") * size + 1, size).cast("array<double>").alias("vector"))
