"""Operator 5: exact top-k search by no-random-access aggregation.

The score of a row for a query is the inner product: a sum over dimensions, each of which is a list of the rows, sorted by the vectors' component.

1. Rows are put into packs of up to PACK; each pack's lists are sorted once, when it is made. Rows with like signs stand together, which makes bounds tight.
2. Query rows are put into blocks of up to BLOCK. Each block meets each pack; a task takes many packs for the same block, one after the other.
3. For a query the lists of a pack are read sequentially, from the end where the query's component is best, level by level, lists of greater weight deeper.
   What was read of a row is summed; what wasn't is at most the lists' last values read, and within what the lengths of the unread parts allow
   (Cauchy-Schwarz), which gives the lower bounds. Rows whose upper bound is under the k-th best lower bound, or under the k-th best score of the packs before, are out.
   Reading stops when the outsiders can't qualify: nothing is left, or no more than 1 / RESOLVE of the pack. Only those that are left are resolved, in
   double precision.
4. A query's best of all tasks are merged.

Nothing is sent to every executor and no list of a bucket is capped. A block meets all rows: packs are shuffled once for each block of queries.

Results: k rows a query (fewer if there are no more): vec_id, rank, neighbor_id, score (rounded to 6 decimals, as rank order is by the unrounded
score, ties by neighbor_id, null last). Rows with the query's own id aren't its neighbours (a null id is no id: such a row meets itself); an equal vector under another
id is. Repeated query rows are answered each. Ids can be of any type that sorts. Rows whose vector is null, empty or has a null, NaN or
infinite component have no neighbours and are none; vectors of other lengths aren't compared. Extra columns don't matter; no query or no row gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

K, PACK, RESOLVE = 10, 4096, 16
#: Shares of the lists' entries read before bounds are compared; the last level is all.
LEVELS = (0.02, 0.1, 0.25, 0.4, 0.55, 0.65, 0.75, 0.85, 0.93, 1.0)
#: Queries of a block, at least and at most: as many blocks as there are tasks, if there are enough queries.
BLOCKS = (64, 4096)
#: Room for rounding in the bounds, in shares of the vectors' lengths.
SLACK = 1e-9


class Lists:
    """A pack's rows, and its lists: for each dimension the rows' places by ascending component."""

    def __init__(self, rows: np.ndarray, order: np.ndarray | None = None) -> None:
        self.rows = rows.astype(np.float64)
        self.order = np.argsort(rows, axis=0, kind="stable").T if order is None else order.astype(np.int64)
        self.values = np.take_along_axis(self.rows.T, self.order, axis=1)
        self.square = (self.rows**2).sum(axis=1)
        self.longest = float(self.square.max(initial=0.0))


def depths(query: np.ndarray) -> np.ndarray:
    """A row a level: the share of each list to read, on average LEVELS; lists of greater weight are read deeper."""
    weight = np.abs(query)
    out = []
    for level in LEVELS:
        low, high = 0.0, float(weight.max(initial=0.0)) * len(query) + 1e-300
        for _ in range(40 if level < 1 else 0):  # unread shares in inverse proportion to the weights
            mid = (low + high) / 2
            low, high = (mid, high) if (1 - np.minimum(1.0, mid / np.maximum(weight, 1e-300))).mean() > level else (low, mid)
        out.append(np.where(weight > 0, 1 - np.minimum(1.0, low / np.maximum(weight, 1e-300)), 0.0))
    return np.array(out)


def nra(query: np.ndarray, lists: Lists, k: int, floor: float = -np.inf, barred: np.ndarray | None = None, shares: np.ndarray | None = None, level: int = 0) -> tuple[np.ndarray, int, int]:
    """(places of rows that surely hold the k best with a score of floor or more, ties included; entries read from the lists; level at which reading stopped)."""
    n, width = lists.rows.shape
    up = query > 0
    best = np.where(up, lists.values[:, -1], lists.values[:, 0])
    worst = np.where(up, lists.values[:, 0], lists.values[:, -1])
    length = float(query @ query)
    slack = SLACK * (1 + np.sqrt(length * lists.longest))
    if min(float(query @ best), np.sqrt(length * lists.longest)) < floor - slack:  # nothing read: no row of the pack can qualify
        return np.zeros(0, np.int64), 0, level
    shares = depths(query) if shares is None else shares
    read = 0
    while True:
        to = np.ceil(shares[level] * n).astype(np.int64)
        last = np.where(to >= n, worst, np.where(up, lists.values[np.arange(width), n - 1 - np.minimum(to, n - 1)], lists.values[np.arange(width), np.minimum(to, n - 1)]))
        above = np.zeros(n)
        open_floor = floor == -np.inf
        known, left_q, left_x = (np.zeros(n), np.full(n, length), lists.square.copy()) if open_floor else (above,) * 3
        for d in np.flatnonzero(to).tolist():
            t, q = to[d], query[d]
            places, values = (lists.order[d, n - t :], lists.values[d, n - t :]) if up[d] else (lists.order[d, :t], lists.values[d, :t])
            above[places] += q * (values - last[d])
            if open_floor:
                known[places] += q * values
                left_q[places] -= q * q
                left_x[places] -= values * values
        read = int(to.sum())
        high = above + float(query @ last)
        kth = floor
        if open_floor and k < n:
            rest = np.sqrt(np.maximum(left_q, 0.0) * np.maximum(left_x, 0.0))
            high = np.minimum(high, known + rest)
            low = known - rest
            if barred is not None:
                low[barred] = -np.inf
            kth = float(np.partition(low, n - k)[n - k])
        left = high >= kth - slack
        if barred is not None:
            left[barred] = False
        count = int(np.count_nonzero(left))
        if level == len(LEVELS) - 1 or count <= max(2 * k, n // RESOLVE):
            return np.flatnonzero(left), read, level
        level += 1


def _places(rows: int) -> type:
    return np.uint16 if rows <= 1 << 16 else np.uint32


def _pack(pack: int, sort: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def emit(width: int, ids_type: pa.DataType) -> pa.RecordBatch:
            nonlocal made
            parts = held.pop(width)
            made += 1
            rows, ids = np.concatenate([x for _, x in parts]), pa.concat_arrays([i for i, _ in parts])
            order = Lists(rows).order.astype(_places(len(rows))).tobytes() if sort else b""
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([width], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(pa.list_(ids_type)), pa.array([rows.tobytes()], pa.binary()), pa.array([order], pa.binary())], names=["pack", "width", "ids", "data", "orders"]
            )

        kind = None
        for b in batches:
            kind = b.column(0).type
            vectors = b.column(1)
            size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            for width in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == width)
                flat = vectors.take(pa.array(at)).flatten().cast(pa.float32()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
                good = np.isfinite(flat).all(axis=1)
                flat, ids = np.ascontiguousarray(flat[good]), b.column(0).take(pa.array(at[good]))
                while len(flat):
                    room = pack - sum(len(x) for _, x in held.get(width, []))
                    held.setdefault(width, []).append((ids[:room], flat[:room]))
                    ids, flat = ids[room:], flat[room:]
                    if room <= len(held[width][-1][1]):
                        yield emit(width, kind)
        for width in list(held):
            yield emit(width, kind)

    return run


def _matrix(data: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.float32).reshape(-1, width)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floors, shares, levels = None, np.zeros(0), [], np.zeros(0, np.int64)
        for b in batches:
            for r in range(b.num_rows):
                width = b.column("width")[r].as_py()
                queries, rows = _matrix(b.column("q_data")[r], width).astype(np.float64), _matrix(b.column("data")[r], width)
                lists = Lists(rows, np.frombuffer(b.column("orders")[r].as_buffer(), _places(len(rows))).reshape(width, -1))
                q_ids, ids = b.column("q_ids")[r].values, b.column("ids")[r].values
                if block != b.column("block")[r].as_py():  # the k best scores so far of each query, over this task's packs
                    block, floors, shares, levels = b.column("block")[r].as_py(), np.full((len(queries), k), -np.inf), [depths(q) for q in queries], np.zeros(len(queries), np.int64)
                by_id = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="first").to_numpy()
                own: dict = {}
                for at, place in enumerate(pc.index_in(ids, q_ids, skip_nulls=True).to_pylist()):
                    if place is not None:
                        own.setdefault(q_ids[place].as_py(), []).append(at)
                names = q_ids.to_pylist() if own else [None] * len(queries)
                where, best, score = [], [], []
                for i, query in enumerate(queries):
                    barred = np.array(own.get(names[i], []), np.int64)
                    at, _, level = nra(query, lists, k + len(barred), floors[i, 0], barred, shares[i], levels[i])
                    levels[i] = max(0, level - (len(at) < len(rows) // (4 * RESOLVE)))  # the next pack is begun where this one ended, or before
                    if not len(at):
                        continue
                    s = np.einsum("ij,j->i", lists.rows[at], query)  # the same sum for equal rows, wherever they stand
                    order = np.lexsort((by_id[at], -s))[:k]
                    at, s = at[order], s[order]
                    floors[i] = np.sort(np.concatenate([floors[i], s]))[-k:]
                    where.append(np.full(len(at), i))
                    best.append(at)
                    score.append(s)
                where, best, score = (np.concatenate(x) if x else np.zeros(0) for x in (where, best, score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(where), block, np.int64)), pa.array(where.astype(np.int32)), q_ids.take(pa.array(where.astype(np.int64))), ids.take(pa.array(best.astype(np.int64))), pa.array(score.astype(np.float64))], names=["block", "at", "vec_id", "neighbor_id", "exact"]
                )

    return run


def top_k(df: DataFrame, k: int = K, queries: Column | None = None, pack: int = PACK, blocks: tuple[int, int] = BLOCKS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best rows of df for each row of df that is a query (where queries is true; each row, if None)."""
    kind = df.schema[vec_id].dataType.simpleString()
    wanted = df if queries is None else df.filter(queries)
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, asked = (d.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<float>").alias("vector")) for d in (df, wanted))
    schema = f"pack bigint, width int, ids array<{kind}>, data binary, orders binary"
    # Packs are numbered by their task, so they are written: the numbers must stay the same if a task is run again.
    signs = F.transform(F.slice(F.coalesce("vector", F.array().cast("array<float>")), 1, 16), lambda x: x > 0)
    sorted_rows = rows.repartitionByRange(max(1, min(shuffle, -(-rows.count() // pack))), signs, F.xxhash64("vec_id", "vector")).sortWithinPartitions(signs)
    packs = checkpoint(sorted_rows.mapInArrow(_pack(pack, True), schema))
    n_asked = asked.count()
    block = min(blocks[1], max(blocks[0], -(-n_asked // shuffle)))
    made = checkpoint(asked.repartition(max(1, -(-n_asked // block)), F.xxhash64("vec_id", "vector")).mapInArrow(_pack(block, False), schema))
    # Where there are fewer blocks than tasks, a block's packs are dealt out to lanes; a lane carries its best scores on.
    lanes = max(1, -(-shuffle // max(1, made.count())))
    q = made.select(F.col("pack").alias("block"), F.col("width"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    pairs = q.select("block", "width").join(packs.select("pack", "width"), "width").select("block", "pack", F.pmod(F.xxhash64("pack"), F.lit(lanes)).alias("lane"))
    met = pairs.join(packs, "pack").join(q.drop("width"), "block").repartition(shuffle, "block", "lane").sortWithinPartitions("block", "lane", "pack")
    found = met.select("block", "q_ids", "q_data", "width", "ids", "data", "orders").mapInArrow(_search(k), f"block bigint, at int, vec_id {kind}, neighbor_id {kind}, exact double")
    order = Window.partitionBy("block", "at").orderBy(F.col("exact").desc(), F.col("neighbor_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", (F.floor(F.col("exact") * 1e6 + 0.5) / 1e6).alias("score"))


def every_hundredth(df: DataFrame, k: int = K, vec_id: str = "vec_id") -> DataFrame:
    """The stated set of queries: every row whose id is divisible by 100, against all rows."""
    return top_k(df, k, F.col(vec_id) % 100 == 0, vec_id=vec_id)


SQL = f"""
SELECT vec_id, rank::INTEGER AS rank, neighbor_id, floor(exact * 1e6 + 0.5) / 1e6 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY exact DESC, neighbor_id) AS rank FROM (
    SELECT a.vec_id, b.vec_id AS neighbor_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS exact
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0))
WHERE rank <= {K}
"""
