"""Exact top-k inner products over a pivot-distance index.

With M the greatest norm, a vector x becomes the point (x, sqrt(M^2 - |x|^2)) and a query q
the point (q, 0); then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the best scores are the nearest
points, and the triangle inequality bounds them by distances to pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basinframe.llm.repeats import stored


def quantised(vector: Column | str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    c = F.col(vector) if isinstance(vector, str) else vector
    c = c.cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~F.exists(c, odd), F.transform(c, lambda x: F.floor(scale * x)))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Points of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Points of vectors, one coordinate longer."""
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _index(vectors: DataFrame, pivots: np.ndarray, top: float, block: int) -> DataFrame:
    """Blocks of vectors of one pivot in order of their distance from it: sorted annuli.

    A block: (block, pivot, near, far, vectors: 64-bit components, handles, firsts).
    """

    def place(batches):
        for batch in batches:
            d = _distances(lifted(_matrix(batch.column("q")).astype(float), top), pivots)
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("v"), batch.column("first"), batch.column("q"), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])],
                names=["v", "first", "q", "pivot", "r"],
            )

    def build(batches):
        held, count = [], 0
        worker = TaskContext.get().partitionId()

        def flush(rows):
            nonlocal count
            v, first, q, pivot, r = zip(*rows, strict=True)
            data = np.array(q, np.int64).tobytes()
            out = [[worker << 32 | count], [pivot[0]], [min(r)], [max(r)], [data], [v], [first]]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            count += 1
            names = ["block", "pivot", "near", "far", "data", "v", "first"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("v", "first", "q", "pivot", "r")), strict=True):
                if held and (row[3] != held[-1][3] or len(held) >= block):
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    placed = vectors.mapInArrow(place, "v long, first long, q array<bigint>, pivot int, r double")
    ordered = placed.repartitionByRange("pivot", "r", "v").sortWithinPartitions("pivot", "r", "v")
    ddl = "block long, pivot int, near double, far double, data binary, v array<bigint>, first array<bigint>"
    return stored(ordered.mapInArrow(build, ddl), "index")


def _query_groups(queries: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """Rows (grp, v, q, low: per pivot distance): queries of one nearest pivot lie together."""

    def place(batches):
        for batch in batches:
            q = _matrix(batch.column("q")).astype(float)
            d = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
            own = d.argmin(1)
            rows = pa.array(list(d), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("q"), pa.array(own.astype(np.int32)), rows], names=["v", "q", "pivot", "d"])

    def number(batches):
        worker, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = np.arange(n, n + batch.num_rows) // size
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(worker << 32 | ids), *batch.columns], names=["grp", *batch.schema.names])

    ddl = "v long, q array<bigint>, pivot int, d array<double>"
    near = queries.select("v", "q").mapInArrow(place, ddl).repartitionByRange("pivot", "v").sortWithinPartitions("pivot", "v")
    return stored(near.mapInArrow(number, f"grp long, {ddl}"), "queries")


def _search(groups: DataFrame, plan: DataFrame, blocks: DataFrame, k: int, top: float, dim: int) -> DataFrame:
    """Best ``k`` (query, v, first, score) of each query over the planned (grp, part, block, bound).

    A task holds one group's queries and streams blocks by bound; a query skips blocks
    whose annulus cannot hold a score as good as its k-th, and when none is left that
    can, the rest of the stream is passed over.
    """
    none = lambda kind: F.lit(None).cast(kind)
    data = plan.join(blocks, "block").select("grp", "part", F.lit(1).alias("turn"), "bound", "pivot", "near", "far", "data", F.col("v").alias("vs"), "first", none("bigint").alias("v"), none("array<bigint>").alias("q"), none("array<double>").alias("d"))
    parts = plan.select("grp", "part").distinct()
    asked = groups.join(parts, "grp").select("grp", "part", F.lit(0).alias("turn"), F.lit(-1.0).alias("bound"), none("int").alias("pivot"), none("double").alias("near"), none("double").alias("far"), none("binary").alias("data"), none("array<bigint>").alias("vs"), none("array<bigint>").alias("first"), "v", "q", "d")
    rows = asked.unionByName(data).repartition("grp", "part").sortWithinPartitions("grp", "part", "turn", "bound")

    class Group:
        def __init__(self):
            self.v, self.q, self.d, self.best = [], [], [], None

        def close(self):
            self.q = np.array(self.q, np.int64).reshape(len(self.v), dim)
            self.d = np.array(self.d)
            self.norm = (self.q.astype(float) ** 2).sum(1)
            self.best = [np.zeros((len(self.v), 0), np.int64) for _ in range(3)]  # score, first, v

        def add(self, pivot, near, far, data, vs, first):
            if self.best is None:
                self.close()
            score = self.best[0]
            if score.shape[1] >= k:
                low = np.maximum(0, np.maximum(self.d[:, pivot] - far, near - self.d[:, pivot]))
                least = score[:, k - 1]
                use = np.flatnonzero((self.norm + top - low * low) / 2 >= least - 1 - 1e-9 * (self.norm + top))
            else:
                use = np.arange(len(self.v))
            if not len(use):
                return
            x = np.frombuffer(data, np.int64).reshape(-1, dim)
            q = self.q[use]
            if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * dim < 2.0**52:
                fresh = (q.astype(float) @ x.T.astype(float)).astype(np.int64)
            else:
                fresh = q @ x.T
            wide = lambda a: np.broadcast_to(np.array(a, np.int64), fresh.shape)
            both = [np.hstack([old[use], new]) for old, new in zip(self.best, (fresh, wide(first), wide(vs)), strict=True)]
            order = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
            both = [np.take_along_axis(b, order, 1) for b in both]
            if both[0].shape[1] != score.shape[1]:
                self.best = both
            else:
                for old, new in zip(self.best, both, strict=True):
                    old[use] = new

        def result(self):
            if self.best is None:
                return None
            score, first, v = self.best
            query = np.repeat(np.array(self.v, np.int64), score.shape[1])
            return pa.RecordBatch.from_arrays([pa.array(a) for a in (query, v.ravel(), first.ravel(), score.ravel())], names=["query", "v", "first", "score"])

    def run(batches):
        now, group = None, Group()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grp, part, turn, _, pivot, near, far, data, vs, first, v, q, d = row
                if (grp, part) != now:
                    if (done := group.result()) is not None:
                        yield done
                    now, group = (grp, part), Group()
                if turn == 0:
                    group.v.append(v)
                    group.q.append(q)
                    group.d.append(d)
                else:
                    group.add(pivot, near, far, data, vs, first)
        if (done := group.result()) is not None:
            yield done

    return rows.mapInArrow(run, "query long, v long, first long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "first", "v")
    return found.withColumn("r", F.row_number().over(order)).where(f"r <= {k}")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    pivots: int = 32,
    sample: int = 4096,
    block: int = 512,
    group: int = 512,
    share: int = 1000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` best integer inner products of each query with all other rows.

    Vectors are quantised (:func:`quantised`). Equal vectors are one entry with its k + 1
    least ids, enough for any query. Pivots come from at most ``sample`` vectors (those of
    least hash); every vector is keyed by its nearest pivot and the distance, and blocks of
    neighbouring keys are annuli. Queries near one pivot form groups. A group first
    searches the few annuli of the least bounds, which gives each query a radius; then
    those annuli whose bound lies within the group's greatest radius, in order, dealt to
    tasks of at most ``share`` annuli. All comparison is exact and in integers.

    Rows (query_id, rank, vec_id, score), ties to the smaller id. Null vectors and vectors
    with null or non-finite components take no part, nor do null ids; repeated rows count
    once; only vectors of equal length are compared; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("q"), is_query.alias("asked"))
    rows = rows.where("id is not null and q is not null and size(q) > 0").withColumn("asked", F.coalesce("asked", F.lit(False)))
    least = W.partitionBy("q").orderBy("id")
    ids = rows.select("id", "q").distinct().withColumn("r", F.row_number().over(least)).where(f"r <= {k + 1}")
    entries = ids.groupBy("q").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = stored(entries.select(F.monotonically_increasing_id().alias("v"), "q", "ids", F.col("ids")[0].alias("first")), "vectors")
    asked = stored(rows.where("asked").select(F.col("id").alias("query_id"), "q").distinct().join(entries.select("q", "v"), "q"), "asked")
    norm = F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    found = []
    for dim, top in entries.groupBy(F.size("q")).agg(F.max(norm)).collect():
        own = entries.where(F.size("q") == dim)
        some = own.orderBy(F.xxhash64("q"), "v").limit(sample).select("q").collect()
        centres = choose_pivots(lifted(np.array([r[0] for r in some], float), top), pivots)
        blocks = _index(own, centres, top, block)
        groups = _query_groups(asked.where(F.size("q") == dim).dropDuplicates(["v"]), centres, group)
        # Distances of a group to each pivot, as intervals, bound a whole annulus at once.
        spread = groups.select("grp", F.posexplode("d").alias("pivot", "x")).groupBy("grp", "pivot").agg(F.min("x").alias("a"), F.max("x").alias("b"))
        bound = F.greatest(F.lit(0.0), F.col("a") - F.col("far"), F.col("near") - F.col("b"))
        pairs = stored(blocks.select("block", "pivot", "near", "far").join(spread, "pivot").select("grp", "block", bound.alias("bound")), "bounds")
        nearest = W.partitionBy("grp").orderBy("bound", "block")
        first = pairs.withColumn("r", F.row_number().over(nearest)).where("r <= 4").select("grp", "block", "bound", F.lit(0).alias("part"))
        start = stored(_search(groups, first, blocks, k + 1, top, dim), "start")
        # The radius of a query with fewer results than asked for is not bounded yet.
        kth = start.groupBy("query").agg(F.min("score").alias("s"), F.count("*").alias("c"))
        own_norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
        square = F.when(F.col("c") > k, own_norm + top - 2 * F.col("s")).otherwise(F.lit(float("inf")))
        radius = (
            groups.join(kth, groups["v"] == kth["query"], "left")
            .groupBy("grp")
            .agg(F.max(F.coalesce(square, F.lit(float("inf")))).alias("radius"))
        )
        slack = (F.col("bound") * F.col("bound")) * (1 - 1e-9) - 2
        rest = pairs.join(radius, "grp").where(slack <= F.col("radius")).select("grp", "block", "bound")
        rest = rest.withColumn("part", F.expr(f"cast((row_number() over (partition by grp order by bound, block) - 1) div {share} as int)"))
        found.append(_best(_search(groups, rest, blocks, k + 1, top, dim), k + 1).drop("r"))
    if not found:
        return entries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    hits = every.join(entries.select("v", F.explode("ids").alias("vec_id")), "v")
    hits = asked.select("query_id", F.col("v").alias("query")).join(hits, "query").where("query_id <> vec_id")
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(rank)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
