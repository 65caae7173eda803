"""Near duplicates: a chosen-path join on word shingles, with exact Jaccard similarity at the end."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, Scratch, free_name, map_arrow, salt, text_or_empty
from .components import components
from .shingles import MASK, WORDS, mix, set_key, shingle_sets

THRESHOLD = 0.8
#: Chance that a pair right at the threshold meets in some bucket; pairs above it meet more surely.
RECALL = 0.995
#: Depth of the recursion, and shingles that a set samples at each step on average.
LEVELS, CHOSEN = 3, 1.4
#: A bucket of at most so many sets is compared at once; a larger one is split deeper, then cut into blocks. Blocks of
#: sketches are larger than blocks of whole sets: a group is copied once for each of its blocks.
BUCKET, SKETCH_BLOCK = 256, 1024
#: Bins of a set's sketch. A pair is kept for the exact comparison unless its sketches disagree by five deviations.
BINS, DEVIATIONS = 64, 5.0
_U = np.uint64


def runs_needed(recall: float, threshold: float, levels: int = LEVELS, chosen: float = CHOSEN) -> int:
    """Repeats after which a pair at the threshold has met with the given probability.

    Of the shingles that both sets hold, threshold * chosen are sampled by both on average (a Poisson number)
    at each step, so a branch lives through k more steps with probability 1 - exp(-threshold * chosen * that of k - 1).
    """
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-threshold * chosen * alive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def chosen_nodes(shingles: np.ndarray, runs: int, levels: int = LEVELS, chosen: float = CHOSEN) -> tuple[list[list[int]], list[list[int]]]:
    """The nodes of the recursion tree that the set reaches, per level: their parents, and themselves.

    At a node the set takes the shingles whose hash, keyed by the node, is among the lowest chosen / size part
    of all hashes. Two sets of like size thus take the same shared shingles.
    """
    if not len(shingles):
        return [[] for _ in range(levels)], [[] for _ in range(levels)]
    most = _U(min((1 << 64) - 1, int(chosen / len(shingles) * 2.0**64)))
    above, parents, nodes = list(mix(np.arange(1, runs + 1, dtype=_U))), [], []
    for _ in range(levels):
        up, at = [], []
        for node in above:
            h = mix(shingles ^ node)
            children = mix(h[h <= most] + _U(int(node) * 3 & MASK))
            up += [node] * len(children)
            at += list(children)
        parents.append(np.array(up, _U).astype(np.int64).tolist())
        nodes.append(np.array(at, _U).astype(np.int64).tolist())
        above = at
    return parents, nodes


def sketch(shingles: np.ndarray) -> bytes:
    """One-permutation MinHash: 16 bits of the least hash in each of BINS ranges, 0 where a range is empty."""
    h = np.sort(mix(shingles + _U(77)))
    width = 64 - (BINS.bit_length() - 1)
    bins = h >> _U(width)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1]))) if len(h) else np.zeros(0, int)
    out = np.zeros(BINS, np.uint16)
    out[bins[first].astype(int)] = (mix(h[first]) % _U(65535)).astype(np.uint16) + 1
    return out.tobytes()


def _describe(docs: DataFrame, runs: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, node (names the shingle set), n, sketch, parents and branches per level: one pass over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.int64()))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sets = shingle_sets(part.column("text").to_pylist(), words)
                reached = [chosen_nodes(s, runs) for s in sets]
                columns = [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array([set_key(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                    pa.array([up for up, _ in reached], kind),
                    pa.array([at for _, at in reached], kind),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "n", "sketch", "parents", "branches"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, text_key bigint, node bigint, n int, sketch binary, parents array<array<bigint>>, branches array<array<bigint>>")


def _cells(rows: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """Deal the members of each group over comparison cells (i, j): one cell for a small group, else pairs of blocks.

    Every pair of a group meets in one cell: of block i with block j, or within block i (i = j).
    """
    blocks = F.ceil(size / limit).cast("int")
    own = F.pmod(F.xxhash64("node", key), blocks).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def _each_cell(rows: DataFrame, key: str, columns: list[str], work: Callable, schema: str) -> DataFrame:
    """Bring each cell together and call ``work(own, i, j, *columns as arrays)``, which gives rows of ``schema``."""
    dealt = rows.select(key, "i", "j", "own", *columns).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cells(table: pa.Table, last: bool) -> Iterator[tuple[int, int]]:
            """Row ranges of whole cells; the last cell is open until the input ends."""
            names = [table.column(c).to_numpy() for c in (key, "i", "j")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)) + 1
            ends = [*cut.tolist(), table.num_rows] if last else cut.tolist()
            yield from zip([0, *ends[:-1]], ends)

        def done(table: pa.Table, last: bool) -> tuple[list[tuple], pa.Table]:
            found, end = [], 0
            own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
            values = [table.column(c).to_pylist() if pa.types.is_binary(table.schema.field(c).type) else table.column(c).to_numpy() for c in columns]
            for start, end in cells(table, last):
                found += work(own[start:end], i[start], j[start], *[v[start:end] for v in values])
            return found, table.slice(end)

        def emit(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)], names)

        names = [c.split()[0] for c in schema.split(", ")]
        waiting = 0
        for b in batches:
            held.append(b)
            waiting += b.num_rows
            if waiting >= 4 * BUCKET:
                found, rest = done(pa.Table.from_batches(held).combine_chunks(), False)
                held, waiting = rest.to_batches(), 0
                if found:
                    yield emit(found)
        if held:
            found, _ = done(pa.Table.from_batches(held).combine_chunks(), True)
            if found:
                yield emit(found)

    return map_arrow(dealt, run, schema)


def spanning_edges(near: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the symmetric relation ``near``: fewer than members, whatever the number of pairs."""
    out, free = [], np.ones(len(nodes), bool)
    for root in np.flatnonzero(near.any(axis=1)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(near[at] & free)
            free[new] = False
            out += [(int(nodes[at]), int(nodes[x])) for x in new]
            queue += new.tolist()
    return out


def joining_edges(near: np.ndarray, own: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what ``near`` connects within each of two blocks: one for each two parts that meet.

    The blocks' own cells give the spanning forests of the parts, so a group of many blocks has but a few edges for each pair of blocks.
    """
    place = {int(v): k for k, v in enumerate(nodes)}
    inside = spanning_edges(near & (own[:, None] == own[None, :]), nodes)
    part = np.arange(len(nodes))

    def top(k: int) -> int:
        while part[k] != k:
            part[k] = part[part[k]]
            k = part[k]
        return int(k)

    for a, b in inside:
        part[top(place[b])] = top(place[a])
    part = np.array([top(k) for k in range(len(nodes))])
    first = np.flatnonzero(own == own[0])
    other = np.flatnonzero(own != own[0])
    a, b = np.nonzero(near[np.ix_(first, other)])
    out = []
    for code in np.unique(part[first][a] * len(nodes) + part[other][b]).tolist():
        x, y = divmod(code, len(nodes))
        if top(x) != top(y):
            part[top(y)] = top(x)
            out.append((int(nodes[x]), int(nodes[y])))
    return out


def _forest(near: np.ndarray, own: np.ndarray, i: int, j: int, nodes: np.ndarray) -> list[tuple[int, int]]:
    return spanning_edges(near, nodes) if i == j else joining_edges(near, own, nodes)


def _to_compare(own: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which pairs of rows the cell (i, j) stands for."""
    pairs = own[:, None] != own[None, :] if i != j else np.ones((len(own), len(own)), bool)
    np.fill_diagonal(pairs, False)
    return pairs


def like_sketches(threshold: float) -> Callable:
    def work(own, i, j, node, n, sketches) -> list[tuple]:
        s = np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, BINS)
        near = ~np.eye(len(own), dtype=bool)
        near &= np.minimum.outer(n, n) >= threshold * np.maximum.outer(n, n)
        empty = s == 0
        for a in np.flatnonzero(near.any(axis=1)):
            b = np.flatnonzero(near[a])
            used = BINS - (empty[b] & empty[a]).sum(axis=1)
            same = ((s[b] == s[a]) & ~empty[a]).sum(axis=1)
            near[a, b] = same >= threshold * used - DEVIATIONS * np.sqrt(threshold * (1 - threshold) * used)
        return _forest(near, own, i, j, node)

    return work


def exact_links(threshold: float) -> Callable:
    """Per cell: (node, -1, links) with the linked documents of each node, and (node, node, 0) for a spanning forest."""

    def work(own, i, j, node, copies, sets) -> list[tuple]:
        tokens = [np.frombuffer(s, _U) for s in sets]
        n = np.array([len(t) for t in tokens])
        shared = np.zeros((len(n), len(n)), np.float64)
        _, column, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(n)), n)
        kept = count[column] > 1
        order = np.argsort(column[kept], kind="stable")
        row, column = row[kept][order], column[kept][order]
        _, column = np.unique(column, return_inverse=True)
        for at in range(0, int(column.max()) + 1 if len(column) else 0, 8192):
            a, b = np.searchsorted(column, [at, at + 8192])
            block = np.zeros((len(n), 8192), np.float32)
            block[row[a:b], column[a:b] - at] = 1
            shared += block @ block.T
        union = n[:, None] + n[None, :] - shared
        near = (shared >= threshold * union - 1e-9) & ~np.eye(len(n), dtype=bool)
        links = (near & _to_compare(own, i, j)) @ copies
        return [(int(v), -1, int(k)) for v, k in zip(node, links) if k] + [(a, b, 0) for a, b in _forest(near, own, i, j, node)]

    return work


def _sets_of(rows: DataFrame, words: int, columns: list[str]) -> DataFrame:
    """node, ``columns`` and the shingle set (8 bytes each) of rows (node, columns, text) whose text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = shingle_sets(part.column("text").to_pylist(), words)
                right = [k for k, (s, node) in enumerate(zip(sets, part.column("node").to_pylist())) if set_key(s) == node]
                kept = part.take(pa.array(right, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("node", *columns)), pa.array([sets[k].tobytes() for k in right], pa.binary())], ["node", *columns, "shingles"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return map_arrow(rows.select("node", *columns, "text"), run, ", ".join(f"{c} {kinds[c]}" for c in ("node", *columns)) + ", shingles binary")


def _buckets(leaders: DataFrame, levels: int, limit: int, scratch: Scratch) -> DataFrame:
    """bucket, node, size: each branch is followed until its bucket is small, or to its end."""
    parts, large = [], None
    for k in range(levels):
        zipped = F.arrays_zip(F.get("parents", F.lit(k)).alias("parent"), F.get("branches", F.lit(k)).alias("bucket"))
        members = leaders.select("node", F.inline(zipped))
        if large is not None:  # only what lies below a large bucket
            members = scratch.put(members.join(large, "parent").select("node", "bucket"), f"below-{k}")
        sizes = scratch.put(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), f"sizes-{k}")
        small = sizes if k == levels - 1 else sizes.filter(F.col("size") <= limit)
        parts.append(members.select("bucket", "node").join(small, "bucket"))
        large = sizes.filter(F.col("size") > limit).select(F.col("bucket").alias("parent"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies, text_key, first_key.

    Two documents are linked when the Jaccard similarity of their sets of ``words`` words in a row (of all words,
    if fewer; words end at ASCII white space) is ``threshold`` or more. ``n_links`` counts the linked documents,
    ``n_copies`` of them have the very same set; ``class_id`` is the smallest id among all that links join.

    1. One pass describes each text: the name of its set, a sketch, and its branches in the chosen-path tree.
    2. Equal sets become one node. Nodes that share a branch meet in a bucket; buckets above ``BUCKET`` members are
       split by the next level, what is still large at the end is cut into pairs of blocks. No bucket is dropped.
    3. In a bucket sketches are compared, and a spanning forest of the likely pairs is kept, not the pairs.
    4. In each component of likely pairs all pairs are compared exactly, again in pairs of blocks; the tasks give
       link counts per node and a spanning forest of the links, whose components are the classes.

    Texts without words form one class of equal texts. Null texts count as empty; rows with a null id take part,
    a class of such rows alone has class_id null; rows that repeat an id are documents of their own.
    An empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = scratch.put(_describe(docs, runs_needed(recall, threshold), words, id_col, text_col), "described")

    # Nodes: equal sets, counted over salted runs, so that a frequent text is never in one task.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    narrow = rows.select("doc_id", "text_key", "node", salt("doc_id", salts).alias("run"))
    runs = narrow.groupBy("node", "run").agg(F.count(F.lit(1)).alias("rows"), F.min(first).alias("first"))
    same = Window.partitionBy("node")
    runs = runs.select("node", "run", F.sum("rows").over(same).alias("copies"), F.min("first").over(same).alias("first"))
    runs = scratch.put(runs, "runs")
    nodes = runs.select("node", "copies", "first").distinct()

    lead = runs.select("node", "run", F.col("first.doc_id").alias("lead_id"), F.col("first.text_key").alias("lead_key"))
    mine = rows.withColumn("run", salt("doc_id", salts)).join(lead, ["node", "run"])
    mine = mine.filter(F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("text_key") == F.col("lead_key")))
    leaders = scratch.put(mine.select("lead_id", "lead_key", "node", "n", "sketch", "parents", "branches").dropDuplicates(["node"]), "leaders")

    buckets = _buckets(leaders, LEVELS, BUCKET, scratch)
    cells = _cells(buckets, "bucket", F.col("size"), SKETCH_BLOCK).join(leaders.select("node", "n", "sketch"), "node")
    likely = _each_cell(cells, "bucket", ["node", "n", "sketch"], like_sketches(threshold), "a bigint, b bigint")
    groups = components(likely.distinct(), scratch, "likely")
    groups = scratch.put(groups, "groups")

    sizes = scratch.put(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    wanted = groups.join(sizes, "component").join(leaders.select("lead_id", "lead_key", "node"), "node")
    wanted = wanted.join(nodes.select("node", "copies"), "node")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"), text_or_empty(text_col).alias("text"))
    that_text = F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("text_key") == F.col("lead_key"))
    wanted = texts.join(wanted, that_text).select("node", "component", "size", "copies", "text")
    sets = _sets_of(wanted, words, ["component", "size", "copies"]).dropDuplicates(["node"])
    cells = _cells(sets, "component", F.col("size"), BUCKET)
    found = scratch.put(_each_cell(cells, "component", ["node", "copies", "shingles"], exact_links(threshold), "a bigint, b bigint, links bigint"), "links")
    links = found.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = components(found.filter("links = 0").select("a", "b"), scratch, "linked")

    # The least document of each class, then back to the rows by node and run.
    known = nodes.select("node", "copies", "first").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = scratch.put(known.join(links, "node", "left"), "known")
    heads = scratch.put(known.groupBy("component").agg(F.min("first").alias("head")), "heads")
    info = known.join(heads, "component").select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), "head")
    placed = scratch.put(runs.select("node", "run").join(info, "node"), "placed")
    out = narrow.join(placed, ["node", "run"]).select(
        "doc_id",
        F.col("head.doc_id").alias("class_id"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"),
        (F.col("copies") - 1).alias("n_copies"),
        "text_key",
        F.col("head.text_key").alias("first_key"),
    )
    out = scratch.put(out, "near-duplicates")
    scratch.drop(*[name for name in list(scratch.paths) if name != "near-duplicates"])
    return out


def keep_first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row, with all columns, of each class of near duplicates: that of the smallest id (and least text key)."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    key, of, place, kept_id = (free_name(docs, c) for c in ("text_key", "kept_key", "kept_place", "kept_id"))
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("first_key")))
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(of))
    marked = docs.withColumn(key, F.xxhash64(text_or_empty(text_col)))
    met = marked.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(of)), "left_semi")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    first = F.row_number().over(Window.partitionBy(id_col, key).orderBy(F.xxhash64(*rest) if rest else F.lit(1)))
    return met.withColumn(place, first).filter(F.col(place) == 1).select(*docs.columns)
