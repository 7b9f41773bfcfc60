"""Radius, nearest and buffer joins on the sphere, as equi-joins on cube keys.

Points are unit vectors. Each reference point falls in one cube per level of a
fixed hierarchy; a ``groupBy`` counts what every cube holds. A search starts at
the few cubes around its query and goes down one level per join, dropping cubes
that lie too far away and taking cubes that lie wholly inside a radius by their
totals. Only cubes with at most ``leaf`` points are opened. A dense cluster with
a third of all points is therefore split by depth instead of being paired with
every query near it, and the result is exact at all latitudes.

Each point is stored once, under its leaf: the first cube on its way down that is
small enough to be opened. A cube inside a leaf finds its points there.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinframe.functions.geo import chord_of_km, km_of_chord, unit_xyz
from basinframe.operators.ordered import top_n
from basinframe.session import materialize, shuffle_width

#: Cube edges are 2 / 2**level; the last level is about 12 m.
LEVELS = tuple(range(2, 21))
STEP = 1
LEAF = 16
_TOP, _LAST = LEVELS[0], LEVELS[-1]
#: Levels down to this one (about 25 km) are always counted, finer ones only
#: where a cube is still crowded.
_COARSE = 9


def _index(v: Column, level: int) -> Column:
    n = 2**level
    return F.least(
        F.greatest(F.floor((v + 1.0) * (n / 2.0)), F.lit(0)), F.lit(n - 1)
    ).cast("long")


def _key(ix: Column, iy: Column, iz: Column) -> Column:
    return F.shiftleft(ix, 42).bitwiseOR(F.shiftleft(iy, 21)).bitwiseOR(iz)


def _with_cells(points: DataFrame, deepest: int = _LAST, top: int = _TOP) -> DataFrame:
    """One row per point and level from ``top`` to ``deepest``, with its cube."""
    fine = points.withColumns({f"__{k}": _index(F.col(k), _LAST) for k in "xyz"})
    levels = F.array(*[F.lit(v) for v in range(top, deepest + 1)])
    out = fine.withColumn("level", F.explode(levels)).withColumns(
        {f"i{k}": F.expr(f"shiftright(__{k}, {_LAST} - level)") for k in "xyz"}
    )
    cell = _key(F.col("ix"), F.col("iy"), F.col("iz"))
    return out.withColumn("cell", cell).drop("__x", "__y", "__z")


def _box_gap(far: bool) -> Column:
    """Distance from the query ``x, y, z`` to the nearest / farthest box corner."""
    form = (
        "greatest(abs({k} - lo_{k}), abs({k} - hi_{k}))"
        if far
        else "greatest(lo_{k} - {k}, {k} - hi_{k}, 0.0D)"
    )
    return F.expr("sqrt(" + " + ".join(f"pow({form.format(k=k)}, 2)" for k in "xyz") + ")")


def _chord() -> Column:
    """Chord between the query ``x, y, z`` and the point ``px, py, pz``."""
    return F.expr("sqrt(" + " + ".join(f"pow({k} - p{k}, 2)" for k in "xyz") + ")")


class CubeIndex:
    """Reference points counted at every level.

    ``scope`` columns keep searches apart (a fold only sees its own references);
    ``carry`` columns travel with the points but do not restrict the search.
    ``totals`` are summed per cube for radius totals. With ``ids`` the points keep
    their identity; at one location only the ``keep`` smallest ids can ever be
    among the nearest, so no more are kept.
    """

    def __init__(
        self,
        ref: DataFrame,
        lat: str = "lat",
        lon: str = "lon",
        *,
        scope: Sequence[str] = (),
        carry: Sequence[str] = (),
        totals: Sequence[str] = (),
        ids: Sequence[str] = (),
        keep: int | None = None,
        leaf: int = LEAF,
    ):
        self.scope, self.carry = list(scope), list(carry)
        # A cube that is opened must be able to hold as many points as a search returns.
        leaf = max(leaf, keep or 0)
        self.totals, self.ids, self.leaf, self.keep = list(totals), list(ids), leaf, keep
        group = self.scope + self.carry
        base = ref.select(*group, *self.totals, *self.ids, *unit_xyz(lat, lon))
        if not self.ids:
            # Points at one location count as one point with a weight.
            base = base.groupBy(*group, "x", "y", "z").agg(
                F.count(F.lit(1)).alias("n_here"),
                *[F.sum(t).alias(t) for t in self.totals],
            )
        else:
            if keep is not None:
                base = top_n(base, [*group, "x", "y", "z"], self.ids, keep)
            base = base.withColumn("n_here", F.lit(1).cast("long"))
        # Few bytes of points make many cubes, which many tasks should count.
        self.width = shuffle_width(ref.sparkSession)
        self.base = materialize(base.repartition(self.width, F.xxhash64("x", "y", "z")), "points")
        nodes = materialize(self._count(self.base, _TOP, _COARSE), "nodes")
        crowded = self._crowded(nodes)
        if crowded == _COARSE:
            dense = nodes.where((F.col("level") == _COARSE) & (F.col("n") > leaf))
            at = _with_cells(self.base, _COARSE, _COARSE)
            inside = at.join(dense.select(*group, "cell"), [*group, "cell"], "left_semi")
            finer = self._count(inside.select(*self.base.columns), _COARSE + 1, _LAST)
            nodes = nodes.unionByName(materialize(finer, "nodes"))
            crowded = self._crowded(nodes)
        # Below this level every cube is small enough to be opened.
        self.bottom = min(crowded + STEP, _LAST)
        nodes = nodes.where(F.col("level") <= self.bottom)
        full = nodes.where((F.col("n") > leaf) & (F.col("level") < self.bottom))
        part = {k: F.shiftright("cell", 21 * (2 - i)).bitwiseAND(2**21 - 1) for i, k in enumerate("xyz")}
        placed = nodes.withColumns({f"__{k}": part[k] for k in "xyz"})
        nodes = self._leaf(placed, F.col("level"), full, group).drop("__x", "__y", "__z")
        self.nodes = materialize(nodes, "nodes")
        fine = self.base.withColumns({f"__{k}": _index(F.col(k), _LAST) for k in "xyz"})
        self.leaves = materialize(
            self._leaf(fine, F.lit(_LAST), full, group).select(
                *group, "leaf_level", "leaf_cell", *self.ids, *self.totals, F.col("n_here").alias("n_rows"),
                *[F.col(k).alias(f"p{k}") for k in "xyz"], *[F.col(f"__{k}").alias(f"f{k}") for k in "xyz"],
            ),
            "leaves",
        )

    def _count(self, points: DataFrame, top: int, deepest: int) -> DataFrame:
        """Cubes with what they hold. Boxes around the points actually present prune
        better than cube walls."""
        nodes = _with_cells(points, deepest, top).groupBy(*self.scope, *self.carry, "level", "cell").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("n_here").alias("n_rows"),
            *[F.sum(t).alias(t) for t in self.totals],
            *[F.min(k).alias(f"lo_{k}") for k in "xyz"],
            *[F.max(k).alias(f"hi_{k}") for k in "xyz"],
            *[F.first(f"i{k}").alias(f"i{k}") for k in "xyz"],
        )
        up = [F.shiftright(F.col(f"i{k}"), STEP) for k in "xyz"]
        return nodes.withColumn("parent", _key(*up)).drop("ix", "iy", "iz")

    def _crowded(self, nodes: DataFrame) -> int:
        """Deepest level that still has a cube too full to open."""
        deepest = nodes.where(F.col("n") > self.leaf).agg(F.max("level").alias("m")).first()["m"]
        return deepest if deepest is not None else _TOP - STEP

    def _deepest(self, rows: DataFrame, own: Column, cubes: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``__deep``: level of the deepest of ``cubes`` on the way to a row's place.

        Every cube around one of them is one of them too, so the level is found by
        halving the range, a join each. ``__x, __y, __z`` are the place at level ``own``.
        """
        out = rows.withColumns({"__deep": F.lit(_TOP - 1), "__to": F.least(own, F.lit(self.bottom))})
        has = cubes.select(*keys, F.col("level").alias("__mid"), F.col("cell").alias("__at"), F.lit(True).alias("__hit"))
        for _ in range((self.bottom - _TOP + 1).bit_length()):
            out = out.withColumn("__mid", F.expr("(__deep + __to + 1) div 2").cast("int"))
            out = out.withColumn("__at", self._cell_at(own, F.col("__mid"))).join(has, [*keys, "__mid", "__at"], "left")
            hit = F.coalesce("__hit", F.lit(False))
            out = out.withColumns(
                {"__deep": F.when(hit, F.col("__mid")).otherwise(F.col("__deep")), "__to": F.when(hit, F.col("__to")).otherwise(F.greatest("__deep", F.col("__mid") - 1))}
            ).drop("__mid", "__at", "__hit")
        return out.drop("__to")

    @staticmethod
    def _cell_at(own: Column, level: Column, names: Sequence[str] = ("__x", "__y", "__z")) -> Column:
        """Cube at ``level`` of a place given at the finer level ``own``."""
        by = F.greatest(own - level, F.lit(0)).cast("int")
        return _key(*[F.call_function("shiftright", F.col(n), by) for n in names])

    def _leaf(self, rows: DataFrame, own: Column, full: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Attach ``leaf_level, leaf_cell``: the first cube below the crowded ones."""
        level = F.least(F.col("__deep") + 1, own).cast("int")
        out = self._deepest(rows, own, full, keys).withColumn("leaf_level", level)
        return out.withColumn("leaf_cell", self._cell_at(own, F.col("leaf_level"))).drop("__deep")

    def _opened(self, front: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The points inside the cubes of ``front``, from the leaves these lie in."""
        inside = self._cell_at(F.lit(_LAST), F.col("level"), ("fx", "fy", "fz")) == F.col("cell")
        found = front.join(self.leaves, [*self.scope, *keys, "leaf_level", "leaf_cell"]).where(inside)
        return found.drop("fx", "fy", "fz")

    # -- building blocks ---------------------------------------------------------

    def _spots(self, queries: DataFrame) -> DataFrame:
        """Distinct places of a search, over all tasks: a place is a few bytes and meets many
        cubes, so tasks sized by their bytes would be one or two. Stored first, as Spark leaves
        out a repartition right after a grouping by the same columns."""
        spot = [*self.scope, "x", "y", "z"]
        return materialize(queries.select(*spot).distinct(), "spots").repartition(self.width, *spot)

    def _match(self, left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
        return left.join(right, [*self.scope, *keys])

    def _around(self, queries: DataFrame) -> DataFrame:
        """Cubes covering the ball of chord ``bound`` at each query's own level.

        The level is the finest fully counted one whose edge is at least ``bound``;
        27 cubes there always cover the ball. Without such a level all 64 top cubes
        are taken. Finer levels hold crowded places only and are reached by descent.
        """
        level = F.lit(_TOP)
        for lv in LEVELS[1:]:
            if lv <= min(self.bottom, _COARSE):
                level = F.when(F.col("bound") <= 2.0 / 2**lv, F.lit(lv)).otherwise(level)
        q = queries.withColumns({"level": level, "__wide": F.col("bound") > 2.0 / 2**_TOP})
        for k in "xyz":
            scale = "(1 << (level - 1))"
            lo = f"greatest(cast(floor(({k} - bound + 1.0D) * {scale}) as int), 0)"
            hi = f"least(cast(floor(({k} + bound + 1.0D) * {scale}) as int), (1 << level) - 1)"
            span = F.expr(f"sequence(if(__wide, 0, {lo}), if(__wide, (1 << level) - 1, {hi}))")
            q = q.withColumn(f"__c{k}", F.explode(span))
        cell = _key(*[F.col(f"__c{k}").cast("long") for k in "xyz"])
        return q.withColumn("cell", cell).drop("__wide", *[f"__c{k}" for k in "xyz"])

    def _start(self, queries: DataFrame) -> DataFrame:
        return self._match(self._around(queries), self.nodes.drop("parent"), ["level", "cell"])

    def _descend(self, front: DataFrame, settle) -> DataFrame:
        """Replace crowded cubes by their children, one level per join; ``settle``
        prunes after each. Cubes that are small enough ride along unchanged."""
        values = ["cell", "leaf_level", "leaf_cell", *self.carry, "n", "n_rows", *self.totals]
        values += [f"{s}_{k}" for s in ("lo", "hi") for k in "xyz"]
        renamed = [*self.scope, "level", "parent", *values]
        child = self.nodes.selectExpr(*[f"`{v}` as `__{v}`" for v in renamed])
        front = settle(front)
        for step in range((self.bottom - _TOP) // STEP):
            if step and step % 4 == 0:
                # Deep searches are cut into short plans and end as soon as no
                # query has a crowded cube left.
                front = materialize(front, "front")
                full = (F.col("n") > self.leaf) & (F.col("level") < self.bottom)
                if "__whole" in front.columns:
                    full = full & ~F.col("__whole")
                if front.where(full).isEmpty():
                    break
            whole = " and not __whole" if "__whole" in front.columns else ""
            crowded = f"n > {self.leaf} and level < {self.bottom}{whole}"
            # A key no cube has, spread by value, keeps the rest from piling up.
            idle = f"-1 - abs(xxhash64(x, y, z, cell) % {2**40})"
            f = front.selectExpr("*", f"if({crowded}, cell, {idle}) as __open")
            on = F.expr(
                " and ".join(
                    [f"__open = __parent and level + {STEP} = __level"]
                    + [f"`{s}` = `__{s}`" for s in [*self.scope, *self.carry]]
                )
            )
            took = {v: f"if(__level is not null, `__{v}`, `{v}`) as `{v}`" for v in [*values, "level"]}
            picked = [took.get(c, f"`{c}`") for c in front.columns]
            front = settle(f.join(child, on, "left").selectExpr(*picked))
        return front

    # -- searches ------------------------------------------------------------------

    def nearest(self, queries: DataFrame, qid: Sequence[str], k: int = 1) -> DataFrame:
        """The ``k`` nearest points: ``qid, ids, chord, rank``.

        ``queries`` carries ``scope``, ``qid`` and ``x, y, z``; each distinct
        location is searched once. Ties are broken by the ids, so the outcome does
        not depend on partitioning.
        """
        if k > self.leaf or (self.keep is not None and k > self.keep):
            raise ValueError("k exceeds what the index keeps")
        spot = [*self.scope, "x", "y", "z"]
        # Stored once: the positions are join keys below and must not be recomputed.
        asked = materialize(queries.select(*self.scope, *qid, "x", "y", "z"), "queries")
        q = self._spots(asked)
        # A cube that holds the query and at least k points bounds the distance
        # by its farthest corner.
        full = self.nodes.where(F.col("n") >= k)
        boxes = full.select(*self.scope, "level", "cell", *[f"{s}_{k}" for s in ("lo", "hi") for k in "xyz"])
        fine = q.withColumns({f"__{c}": _index(F.col(c), _LAST) for c in "xyz"})
        # Several carried groups may share a cube; one is enough to go on.
        cubes = full.select(*self.scope, "level", "cell").distinct()
        own = self._deepest(fine, F.lit(_LAST), cubes, self.scope).where(F.col("__deep") >= _TOP)
        own = own.withColumns({"level": F.col("__deep"), "cell": self._cell_at(F.lit(_LAST), F.col("__deep"))})
        bound = (
            self._match(own.select(*spot, "level", "cell"), boxes, ["level", "cell"])
            .groupBy(*spot)
            .agg(F.min(_box_gap(True)).alias("bound"))
        )
        q = q.join(bound, spot, "left").withColumn("bound", F.coalesce("bound", F.lit(2.0)))
        per_query = Window.partitionBy(*spot)
        slack = F.col("bound") * (1 + 1e-12) + 1e-15  # exact arithmetic would need none

        def settle(f: DataFrame) -> DataFrame:
            # The cubes are disjoint: once those with the nearest far corners hold k
            # points, the k-th point cannot be farther than the last of these corners.
            f = f.withColumn("__far", _box_gap(True))
            held = F.sum("n").over(per_query.orderBy("__far").rowsBetween(Window.unboundedPreceding, 0))
            f = f.withColumn("__enough", F.when(held >= k, F.col("__far")))
            f = f.withColumn("bound", F.least("bound", F.min("__enough").over(per_query)))
            return f.where(_box_gap(False) <= slack).drop("__far", "__enough")

        leaves = self._descend(self._start(q), settle).select(*spot, "bound", "level", "cell", "leaf_level", "leaf_cell")
        pairs = (
            self._opened(leaves, [])
            .withColumn("chord", _chord())
            .where(F.col("chord") <= slack)
            .select(*spot, *self.ids, "chord")
        )
        rank = F.row_number().over(per_query.orderBy("chord", *self.ids))
        found = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
        return asked.join(found, spot).select(*self.scope, *qid, *self.ids, "chord", "rank")

    def _radius(self, queries: DataFrame, radius_km: float) -> DataFrame:
        """Per distinct location: cubes wholly inside, and points inside from the
        cubes the circle cuts, as ``scope, x, y, z, carry, n_rows, totals``."""
        q = self._spots(queries).withColumn("bound", F.lit(chord_of_km(radius_km)))

        def settle(f: DataFrame) -> DataFrame:
            f = f.where(_box_gap(False) <= F.col("bound"))
            return f.withColumn("__whole", _box_gap(True) <= F.col("bound"))

        start = self._start(q).withColumn("__whole", F.lit(False))
        front = self._descend(start, settle)
        out = [*self.scope, "x", "y", "z", *self.carry, "n_rows", *self.totals]
        cut = front.where(~F.col("__whole")).select(
            *self.scope, "x", "y", "z", *self.carry, "bound", "level", "cell", "leaf_level", "leaf_cell"
        )
        pairs = self._opened(cut, self.carry)
        inside = pairs.where(_chord() <= F.col("bound")).select(*out)
        return front.where("__whole").select(*out).unionByName(inside)

    def within(self, queries: DataFrame, qid: Sequence[str], radius_km: float) -> DataFrame:
        """Totals of the points within the radius: ``n_rows`` and every total."""
        spot = [*self.scope, "x", "y", "z"]
        queries = materialize(queries.select(*self.scope, *qid, "x", "y", "z"), "queries")
        per_spot = self._radius(queries, radius_km).groupBy(*spot, *self.carry).agg(
            F.sum("n_rows").alias("n_rows"), *[F.sum(t).alias(t) for t in self.totals]
        )
        asked = queries.select(*self.scope, *qid, "x", "y", "z")
        return asked.join(per_spot, spot).drop("x", "y", "z")

    def touching(self, queries: DataFrame, qid: Sequence[str], radius_km: float) -> DataFrame:
        """Distinct ``qid`` (and ``carry``) with any point within the radius."""
        spot = [*self.scope, "x", "y", "z"]
        queries = materialize(queries.select(*self.scope, *qid, "x", "y", "z"), "queries")
        near = self._radius(queries, radius_km).select(*spot, *self.carry).distinct()
        asked = queries.select(*self.scope, *qid, "x", "y", "z")
        return asked.join(near, spot).drop("x", "y", "z").distinct()

    def touched(self, queries: DataFrame, qid: Sequence[str], radius_km: float, out: str) -> DataFrame:
        """``qid`` and in ``out`` the sorted carried values of the points within the radius; rows
        without any are left out. One row a query: the values are gathered per location."""
        spot = [*self.scope, "x", "y", "z"]
        asked = materialize(queries.select(*self.scope, *qid, "x", "y", "z"), "queries")
        (value,) = self.carry
        near = self._radius(asked, radius_km).groupBy(*spot).agg(F.array_sort(F.collect_set(value)).alias(out))
        return asked.join(near, spot).drop("x", "y", "z")

    def pairs(self, queries: DataFrame, qid: Sequence[str], radius_km: float) -> DataFrame:
        """``qid, ids, chord`` of every point within the radius; each distinct location is
        searched once."""
        spot = [*self.scope, "x", "y", "z"]
        asked = materialize(queries.select(*self.scope, *qid, "x", "y", "z"), "queries")
        q = self._spots(asked).withColumn("bound", F.lit(chord_of_km(radius_km)))
        front = self._descend(self._start(q), lambda f: f.where(_box_gap(False) <= F.col("bound")))
        cut = front.select(*spot, "bound", "level", "cell", "leaf_level", "leaf_cell")
        found = self._opened(cut, []).withColumn("chord", _chord())
        found = found.where(F.col("chord") <= F.col("bound")).select(*spot, *self.ids, "chord")
        return asked.join(found, spot).select(*self.scope, *qid, *self.ids, "chord")


def as_queries(df: DataFrame, cols: Sequence[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.select(*cols, *unit_xyz(lat, lon))


def nearest_join(
    points: DataFrame,
    ref: DataFrame,
    point_id: str,
    ref_id: str,
    k: int = 1,
    scope: Sequence[str] = (),
) -> DataFrame:
    """``point_id, ref_id, distance_km, rank`` of the k nearest reference points."""
    index = CubeIndex(ref, scope=scope, ids=[ref_id], keep=k)
    found = index.nearest(as_queries(points, [*scope, point_id]), [point_id], k)
    return found.withColumn("distance_km", km_of_chord("chord"))


def radius_totals(
    points: DataFrame,
    ref: DataFrame,
    point_id: str,
    radius_km: float,
    totals: Sequence[str] = (),
) -> DataFrame:
    """``point_id, n_rows, totals`` of the reference rows within the radius;
    points with none keep a zero row."""
    index = CubeIndex(ref, totals=totals)
    hit = index.within(as_queries(points, [point_id]), [point_id], radius_km)
    out = points.select(point_id).join(hit, point_id, "left")
    return out.select(
        point_id,
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ["n_rows", *totals]],
    )


def radius_pairs(
    points: DataFrame, ref: DataFrame, point_id: str, ref_id: str, radius_km: float
) -> DataFrame:
    """Every pair within the radius with its distance, for callers that need the
    pairs themselves. The output grows with the pairs; prefer ``radius_totals``."""
    index = CubeIndex(ref, ids=[ref_id])
    found = index.pairs(as_queries(points, [point_id]), [point_id], radius_km)
    return found.select(point_id, ref_id, km_of_chord("chord").alias("distance_km"))


def buffer_anti_join(
    train: DataFrame, test: DataFrame, train_id: str, buffer_km: float = 50.0
) -> DataFrame:
    """Train rows strictly farther than the buffer from every test row."""
    index = CubeIndex(test)
    close = index.touching(as_queries(train, [train_id]), [train_id], buffer_km)
    return train.join(close, train_id, "left_anti")
