"""Raster channels as long cell tables ``(row, col, value columns)``.

Windows here run along one grid row or one grid column, so a partition holds at
most ``n_cols`` or ``n_rows`` cells however many grids or channels there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinframe.functions.geo import EARTH_RADIUS_KM, Grid, km_of_chord
from basinframe.functions.scalars import finite_or_null
from basinframe.operators.contracts import require_none, unknown_codes
from basinframe.operators.ordered import prefix
from basinframe.operators.spatial import CubeIndex, as_queries
from basinframe.session import materialize

KM_PER_DEGREE = pi * EARTH_RADIUS_KM / 180.0


def lookup(
    points: DataFrame, cells: DataFrame, grid: Grid, channels: Sequence[str], tile: int | None = None
) -> DataFrame:
    """Value of each channel in the cell that contains the point.

    ``tile`` is the tile size that stored cells were written with: only the tiles that
    hold a point are then read. Their list is bounded by the tiles of the grid.
    """
    located = points.withColumns({"row": grid.row_of("lat"), "col": grid.col_of("lon")})
    if tile:
        at = [F.expr(f"`{c}` div {tile}").cast("int") for c in ("row", "col")]
        used = located.select(*at).distinct().dropna().collect()
        cells = cells.where((F.col("tile_row") * 100_000 + F.col("tile_col")).isin([a * 100_000 + b for a, b in used]))
    return located.join(cells.select("row", "col", *channels), ["row", "col"], "left")


def coarsen_mean(cells: DataFrame, factor: int, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Block mean over the cells that have a value; an empty block is NULL."""
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return cells.groupBy(*keys, *block).agg(F.avg(finite_or_null(value)).alias(value))


def _slope_along(axis: str, across: str, value: str, n: int) -> Column:
    """Difference along one axis: central inside, one-sided at the ends."""
    w = Window.partitionBy(across).orderBy(axis)
    v = F.col(value)
    prev = F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(v).over(w))
    nxt = F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(v).over(w))
    return (
        F.when(F.col(axis) == 0, nxt - v)
        .when(F.col(axis) == n - 1, v - prev)
        .otherwise((nxt - prev) / 2.0)
    )


def gradient(cells: DataFrame, grid: Grid, value: str, out: str) -> DataFrame:
    """Magnitude of the gradient per km. Columns do not wrap at the antimeridian."""
    d_lat = grid.res_deg * KM_PER_DEGREE
    d_lon = F.lit(d_lat) * F.cos(F.radians(grid.lat_of("row")))
    return (
        cells.withColumn("__dr", _slope_along("row", "col", value, grid.n_rows))
        .withColumn("__dc", _slope_along("col", "row", value, grid.n_cols))
        .withColumn(out, F.sqrt(F.pow(F.col("__dr") / d_lat, 2) + F.pow(F.col("__dc") / d_lon, 2)))
        .drop("__dr", "__dc")
    )


def slope_degrees(cells: DataFrame, grid: Grid, elevation: str, out: str) -> DataFrame:
    g = gradient(cells, grid, elevation, "__g")
    return g.withColumn(out, F.degrees(F.atan(F.col("__g") / 1000.0))).drop("__g")


def channel_stats(cells: DataFrame, channels: Sequence[str]) -> DataFrame:
    """``channel, median, iqr, n_valid, n_cells`` over finite cells, exact at any size.

    Values are counted, their counts run up in order over all partitions, and the values
    at the quartiles' places are picked and interpolated; no task holds a channel.
    """
    stacked = cells.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("channel"), finite_or_null(c).alias("v"))
                    for c in channels
                ]
            )
        ).alias("s")
    ).select("s.channel", "s.v")
    sizes = stacked.groupBy("channel").agg(F.count("v").alias("n_valid"), F.count(F.lit(1)).alias("n_cells"))
    counted = stacked.where("v is not null").groupBy("channel", "v").agg(F.count(F.lit(1)).alias("n_here"))
    ranked = prefix(counted, ["channel"], ["v"], sums={"below": "n_here"}).join(sizes, "channel")
    last = F.col("below") + F.col("n_here")
    places = {q: (F.col("n_valid") - 1) * q for q in (0.25, 0.5, 0.75)}

    def value(place: Column) -> Column:
        return F.max(F.when((F.col("below") <= place) & (place < last), F.col("v")))

    found = ranked.groupBy("channel").agg(
        *[value(F.floor(p)).alias(f"lo{q}") for q, p in places.items()],
        *[value(F.ceil(p)).alias(f"hi{q}") for q, p in places.items()],
    )
    out = sizes.join(found, "channel", "left")
    lo, hi, part = (lambda q: F.col(f"`lo{q}`")), (lambda q: F.col(f"`hi{q}`")), (lambda q: places[q] - F.floor(places[q]))
    at = {q: F.when(lo(q) == hi(q), lo(q)).otherwise((1 - part(q)) * lo(q) + part(q) * hi(q)) for q in places}
    return out.select("channel", at[0.5].alias("median"), (at[0.75] - at[0.25]).alias("iqr"), "n_valid", "n_cells")


def robust_z(cells: DataFrame, value: str, out: str, stats: DataFrame) -> DataFrame:
    """``(x - median) / iqr`` with the stored statistics; a constant or empty
    channel fails the query instead of turning into zeros."""
    one = stats.where(F.col("channel") == value).select("median", "iqr")
    row = one.first()
    if row is None or row["iqr"] is None or row["iqr"] <= 0:
        raise ValueError(f"channel {value} has no spread")
    return cells.withColumn(out, (finite_or_null(value) - row["median"]) / row["iqr"])


def channel_metadata(
    stats: DataFrame, units: dict[str, str], source_id: str, transform_version: str
) -> DataFrame:
    """One row per channel: unit, provenance and the normalisation constants."""
    unit = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    return stats.select(
        "channel",
        F.try_element_at(unit, F.col("channel")).alias("units"),
        F.lit(source_id).alias("source_id"),
        F.lit(transform_version).alias("transform_version"),
        "median",
        "iqr",
        (F.col("n_valid") / F.col("n_cells")).alias("valid_share"),
    )


def sentinel_to_null(cells: DataFrame, value: str, sentinel: float) -> DataFrame:
    v = finite_or_null(value)
    return cells.withColumn(value, F.when(v != sentinel, v))


def class_of_code(cells: DataFrame, code: str, classes: DataFrame, source_id: str) -> DataFrame:
    """Coded cells to ordinal classes; a code outside the map raises."""
    require_none(unknown_codes(cells, code, classes, "code"), source_id, "unmapped cell codes")
    return cells.join(
        classes.select(F.col("code").alias(code), F.col("class").cast("double").alias("class")),
        code,
        "left",
    )


# ---- regrid --------------------------------------------------------------------


def regrid(
    src: DataFrame,
    dst: DataFrame,
    value: str,
    *,
    lat0: float,
    lon0: float,
    d_lat: float,
    d_lon: float,
    n_lat: int,
    n_lon: int,
    method: str = "linear",
    wrap: bool = False,
) -> DataFrame:
    """Sample a regular source grid at the centres of ``dst`` (``row, col, lat, lon``).

    ``src`` is indexed ``(row, col)`` from its northernmost, westernmost centre
    ``(lat0, lon0)`` in steps of ``d_lat`` southwards and ``d_lon`` eastwards.
    Outside the source, and wherever a needed corner is empty, the result is NULL.
    """
    v = finite_or_null(value)
    src = src.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), v.alias("s_v"))
    # Fractional positions counted northwards and eastwards.
    up = F.lit(n_lat - 1) - (F.lit(lat0) - F.col("lat")) / F.lit(d_lat)
    right = (F.col("lon") - F.lit(lon0)) / F.lit(d_lon)
    if wrap:
        right = F.pmod(right, F.lit(float(n_lon)))
    last_col = n_lon if wrap else n_lon - 1
    d = dst.withColumns({"__u": up, "__r": right})
    inside = F.col("__u").between(0, n_lat - 1) & F.col("__r").between(0, last_col)
    d = d.withColumns(
        {
            "__i": F.least(F.floor("__u"), F.lit(n_lat - 2)).cast("int"),
            "__j": F.least(F.floor("__r"), F.lit(last_col - 1)).cast("int"),
            "__in": inside,
        }
    ).withColumns({"__fu": F.col("__u") - F.col("__i"), "__fr": F.col("__r") - F.col("__j")})
    if method == "nearest":
        i = F.when(F.col("__fu") <= 0.5, F.col("__i")).otherwise(F.col("__i") + 1)
        j = F.when(F.col("__fr") <= 0.5, F.col("__j")).otherwise(F.col("__j") + 1)
        near = d.withColumns({"s_row": F.lit(n_lat - 1) - i, "s_col": j % n_lon})
        hit = near.join(src, ["s_row", "s_col"], "left")
        return hit.select("row", "col", F.when(F.col("__in"), F.col("s_v")).alias(value))
    corners = F.array(
        *[
            F.struct(
                (F.lit(n_lat - 1) - F.col("__i") - a).cast("int").alias("s_row"),
                ((F.col("__j") + b) % n_lon).cast("int").alias("s_col"),
                (
                    (F.col("__fu") if a else 1 - F.col("__fu"))
                    * (F.col("__fr") if b else 1 - F.col("__fr"))
                ).alias("w"),
            )
            for a in (0, 1)
            for b in (0, 1)
        ]
    )
    spread = d.select("row", "col", "__in", F.explode(corners).alias("c")).select(
        "row", "col", "__in", "c.s_row", "c.s_col", "c.w"
    )
    hit = spread.join(src, ["s_row", "s_col"], "left")
    return (
        hit.groupBy("row", "col")
        .agg(
            F.sum(F.col("w") * F.col("s_v")).alias("__sum"),
            F.count("s_v").alias("__n"),
            F.first("__in").alias("__in"),
        )
        .select("row", "col", F.when(F.col("__in") & (F.col("__n") == 4), F.col("__sum")).alias(value))
    )


# ---- neighbourhoods ----------------------------------------------------------------


def _tiles_around(grid: Grid, wanted: DataFrame, reach: int, tile: int) -> DataFrame:
    """``(tr, tc)``: the tiles that squares of ``reach`` cells around ``wanted`` touch.

    A tile is at least as wide as a square (the last one of a row or column takes the
    remainder), so a square's corners name all tiles it touches.
    """
    width = max(tile, 2 * reach + 1)
    down, across = (max(n // width, 1) for n in (grid.n_rows, grid.n_cols))
    steps = F.array(F.lit(-reach), F.lit(reach))
    rows = F.transform(steps, lambda d: F.least(F.greatest(F.col("row") + d, F.lit(0)), F.lit(grid.n_rows - 1)))
    cols = F.transform(steps, lambda d: F.pmod(F.col("col") + d, F.lit(grid.n_cols)))
    spread = wanted.select(F.explode(rows).alias("r"), cols.alias("cs")).select("r", F.explode("cs").alias("c"))
    return spread.select(_tile("r", width, down).alias("tr"), _tile("c", width, across).alias("tc")).distinct()


def _tile(c: str, width: int, count: int) -> Column:
    return F.least(F.floor(F.col(c) / F.lit(width)), F.lit(count - 1)).cast("int")


def _cells_around(cells: DataFrame, grid: Grid, wanted: DataFrame, reach: int, tile: int) -> DataFrame:
    """Every cell of the tiles around ``wanted``, with the values of ``cells`` where it has some."""
    width = max(tile, 2 * reach + 1)
    down, across = (max(n // width, 1) for n in (grid.n_rows, grid.n_cols))
    tiles = materialize(_tiles_around(grid, wanted, reach, tile), "tiles")

    def line(c: str, count: int, size: int) -> Column:
        last = F.when(F.col(c) == count - 1, F.lit(size - 1)).otherwise((F.col(c) + 1) * width - 1)
        return F.sequence(F.col(c) * width, last)

    full = tiles.select(F.explode(line("tr", down, grid.n_rows)).alias("row"), "tc")
    full = full.select("row", F.explode(line("tc", across, grid.n_cols)).alias("col"))
    placed = cells.withColumns({"tr": _tile("row", width, down), "tc": _tile("col", width, across)})
    return full.join(placed.join(tiles, ["tr", "tc"], "left_semi").drop("tr", "tc"), ["row", "col"], "left")


def neighbourhood(
    cells: DataFrame, grid: Grid, channels: Sequence[str], radii: dict[str, int], wanted: DataFrame | None = None, tile: int = 64
) -> DataFrame:
    """Mean and population standard deviation over a square of cells around every
    cell of the grid, or around the cells ``wanted`` (``row, col``) alone.

    Rows stop at the poles, columns wrap. Two passes of running sums (along rows,
    then along columns) serve every radius; values are centred on the channel's mean
    first so that squares do not cancel. For ``wanted`` cells only the tiles of
    ``tile`` cells that their squares touch take part, at any size of the grid; a null
    row or column has no square.
    """
    reach = max(radii.values())
    # Every cell takes part, also one without a row of its own: its neighbours count.
    if wanted is None:
        full = grid.centres(cells.sparkSession).select("row", "col")
        full = full.join(cells.select("row", "col", *channels), ["row", "col"], "left")
    else:
        wanted = wanted.select("row", "col").dropna().distinct()
        full = materialize(_cells_around(cells.select("row", "col", *channels), grid, wanted, reach, tile), "around")
    middle = full if wanted is not None else cells
    stats = middle.agg(*[F.avg(finite_or_null(c)).alias(c) for c in channels]).first().asDict()
    base = full.select(
        "row",
        "col",
        *[(finite_or_null(c) - F.lit(float(stats[c] or 0.0))).alias(f"v_{c}") for c in channels],
    )
    wrapped = base.withColumn("at", F.col("col"))
    left = base.where(F.col("col") >= grid.n_cols - reach).withColumn("at", F.col("col") - grid.n_cols)
    right = base.where(F.col("col") < reach).withColumn("at", F.col("col") + grid.n_cols)
    wrapped = wrapped.unionByName(left).unionByName(right)
    along = {}
    for tag, r in radii.items():
        w = Window.partitionBy("row").orderBy("at").rangeBetween(-r, r)
        for c in channels:
            v = F.col(f"v_{c}")
            along[f"n_{c}_{tag}"] = F.count(v).over(w)
            along[f"s_{c}_{tag}"] = F.sum(v).over(w)
            along[f"q_{c}_{tag}"] = F.sum(v * v).over(w)
    rows = wrapped.withColumns(along).where((F.col("at") >= 0) & (F.col("at") < grid.n_cols))
    down = {}
    for tag, r in radii.items():
        w = Window.partitionBy("col").orderBy("row").rangeBetween(-r, r)
        for c in channels:
            for k in "nsq":
                down[f"t{k}_{c}_{tag}"] = F.sum(f"{k}_{c}_{tag}").over(w)
    summed = rows.withColumns(down)
    out = []
    for tag in radii:
        for c in channels:
            n, s, q = (F.col(f"t{k}_{c}_{tag}") for k in "nsq")
            mean = s / F.nullif(n, F.lit(0))
            out.append((mean + F.lit(float(stats[c] or 0.0))).alias(f"{c}_mean_{tag}"))
            var = q / F.nullif(n, F.lit(0)) - mean * mean
            std = F.when(n > 0, F.sqrt(F.greatest(var, F.lit(0.0))))
            out.append(std.alias(f"{c}_std_{tag}"))
    around = summed.select("row", "col", *out)
    return around if wanted is None else around.join(wanted, ["row", "col"], "left_semi")


# ---- distances ---------------------------------------------------------------------


def distance_grid(cells: DataFrame, points: DataFrame, out: str) -> DataFrame:
    """Distance from every cell centre (``row, col, lat, lon``) to the nearest point."""
    if points.isEmpty():
        raise ValueError("no points to measure to")
    found = CubeIndex(points).nearest(as_queries(cells, ["row", "col"]), ["row", "col"], 1)
    return found.select("row", "col", km_of_chord("chord").alias(out))


def shelf_break_cells(cells: DataFrame, elevation: str, isobath: float = -200.0) -> DataFrame:
    """Shallow cells with a deep direct neighbour. No elevation counts as deep."""
    shallow = F.coalesce(finite_or_null(elevation) > isobath, F.lit(False))
    flagged = cells.withColumn("__deep", ~shallow)

    def beside(axis: str, across: str) -> Column:
        w = Window.partitionBy(across).orderBy(axis)
        near = F.lit(False)
        for fn, step in ((F.lag, -1), (F.lead, 1)):
            hit = (fn(axis).over(w) == F.col(axis) + step) & fn("__deep").over(w)
            near = near | F.coalesce(hit, F.lit(False))
        return near

    return (
        flagged.withColumn("__b", beside("row", "col"))
        .withColumn("__b", F.col("__b") | beside("col", "row"))
        .where(~F.col("__deep") & F.col("__b"))
        .drop("__deep", "__b")
    )


def idw(
    cells: DataFrame,
    points: DataFrame,
    value: str,
    point_id: str,
    k: int = 12,
    power: float = 2.0,
    max_km: float | None = None,
) -> DataFrame:
    """Inverse-distance field and mean neighbour distance for every cell centre."""
    k = min(k, points.limit(k).count())
    if k == 0:
        raise ValueError("no points to interpolate")
    index = CubeIndex(points, ids=[point_id, value], keep=k)
    near = index.nearest(as_queries(cells, ["row", "col"]), ["row", "col"], k)
    km = km_of_chord("chord")
    weighted = near.withColumns(
        {"__d": km, "__w": 1.0 / F.pow(F.greatest(km, F.lit(1e-9)), power)}
    )
    out = weighted.groupBy("row", "col").agg(
        (F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias("field"),
        F.avg("__d").alias("mean_distance_km"),
        F.min("__d").alias("__near"),
    )
    if max_km is not None:
        out = out.withColumn("field", F.when(F.col("__near") <= max_km, F.col("field")))
    return out.drop("__near")


def plausible_points(raw: DataFrame, value: str, lat: str, lon: str, lo=0.0, hi=500.0) -> DataFrame:
    """Measurements with all three numbers present and in a credible range."""
    cols = {c: finite_or_null(F.col(c).try_cast("double")) for c in (value, lat, lon)}
    kept = raw.withColumns(cols).dropna(subset=[value, lat, lon])
    return kept.where(
        (F.col(value) > lo)
        & (F.col(value) <= hi)
        & F.col(lat).between(-90, 90)
        & F.col(lon).between(-180, 180)
    )


def well_distance_channels(
    cells: DataFrame, wells: DataFrame, cutoff_year: int | None = None
) -> DataFrame:
    """Distance to the nearest discovery and dry hole known by the cutoff year."""
    known = wells if cutoff_year is None else wells.where(F.col("spud_year") <= cutoff_year)
    known = materialize(known.select("lat", "lon", "label"), "known")
    hit = distance_grid(cells, known.where("label = 1"), "dist_discovery_km")
    dry = distance_grid(cells, known.where("label = 0"), "dist_dryhole_km")
    return hit.join(dry, ["row", "col"])
