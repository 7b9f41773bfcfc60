"""Near duplicates: SuperMinHash signatures, banding, full verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basinframe.llm.common import chunks, id_ddl, mix64, utf8
from basinframe.llm.repeats import gram_hashes, keyed, stored, word_symbols

_BLOCK = 1 << 17


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words, A to Z in lower case.

    A text of fewer words has the one shingle of all its words, one without words none.
    """
    sym = word_symbols(text.lower())
    if not len(sym):
        return np.zeros(0, np.uint64)
    if len(sym) < size:
        return mix64(gram_hashes(sym, len(sym)) + np.uint64(len(sym)))
    step = 1 << 20
    parts = [gram_hashes(sym[a : a + step + size - 1], size) for a in range(0, len(sym) - size + 1, step)]
    return np.unique(np.concatenate(parts))


def signatures(sets: list[np.ndarray], length: int) -> np.ndarray:
    """SuperMinHash of each set: one row of ``length`` values, infinite for an empty set.

    Element e puts r(e, j) + j into place p(e, j) for j = 0, 1, ..., where p(e, .) is a
    random permutation of the places and r uniform in [0, 1); a place keeps the least
    value. The values of a set's elements for one j are drawn together; a set stops at
    the first j that is above all its values, mostly after one or two.
    """
    out = np.full((len(sets), length), np.inf)
    flat = out.reshape(-1)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    items = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), sizes)

    def draw(x, j):
        seed = np.uint64(0xA0761D6478BD642F + 2 * j)
        r = (mix64(x ^ seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (mix64(x + seed + np.uint64(1)) % np.uint64(length - j)).astype(np.int64)
        return r, k

    r, first = draw(items, 0)
    np.minimum.at(flat, owner * length + first, r)
    # Sets whose places are not all below 1 go on; their elements carry their permutation.
    rest = np.flatnonzero((out.max(1) >= 1)[owner])
    for at in range(0, len(rest), _BLOCK):
        these = rest[at : at + _BLOCK]
        x, own = items[these], owner[these]
        perm = np.tile(np.arange(length, dtype=np.int16), (len(these), 1))
        row = np.arange(len(these))
        perm[row, 0], perm[row, first[these]] = first[these], 0
        for j in range(1, length):
            live = out[own].max(1) >= j if len(own) < 4096 else (out.max(1) >= j)[own]
            if not live.all():
                x, own, perm = x[live], own[live], perm[live]
                row = np.arange(len(x))
            if not len(x):
                break
            r, k = draw(x, j)
            place = perm[row, k]
            perm[row, k] = perm[:, j]
            perm[:, j] = place
            np.minimum.at(flat, own * length + place, r + j)
    return out


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` consecutive values."""
    values = signature.view(np.uint64).reshape(len(signature), -1, rows)
    h = np.zeros(values.shape[:2], np.uint64) + np.arange(values.shape[1], dtype=np.uint64)
    for i in range(rows):
        h = mix64(h ^ values[:, :, i])
    return h.view(np.int64)


def _sketch(rows: DataFrame, size: int, bands: int, band_rows: int) -> DataFrame:
    """(_id, _d, n, k1, k2, bands): size, content and bands of every document's set."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 2 << 20):
                sets = [shingle_set(t, size) for t in part.column(1).to_pylist()]
                keys = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets]
                k = (np.array(keys, np.uint64).reshape(-1, 2)).view(np.int64)
                found = band_hashes(signatures(sets, bands * band_rows), band_rows)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), bands).cast(pa.list_(pa.int64()))
                columns = [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_d", "n", "k1", "k2", "bands"])

    return rows.mapInArrow(run, f"{id_ddl(rows, '_id')}, _d long, n long, k1 long, k2 long, bands array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int, share: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The texts of a pivot's partners stream past its set; a pivot with over ``share``
    partners is split, and each part gets its text.
    """
    parts = pairs.groupBy("a").agg((F.expr(f"count(*) div {share}") + 1).cast("int").alias("parts"))
    parts = stored(parts, "pivots")
    part = F.expr("pmod(hash(b), parts)")
    members = pairs.join(parts, "a").select("a", part.alias("part"), F.lit(1).alias("turn"), F.col("b").alias("_d"))
    pivots = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"), F.col("a").alias("_d"))
    rows = pivots.unionByName(members).join(texts, "_d").select("a", "part", "turn", "_d", "_text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "turn")

    def run(batches):
        pivot, mine = None, None
        for batch in batches:
            out = []
            for a, part, turn, d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingle_set(text, size)
                if turn == 0:
                    pivot, mine = (a, part), own
                elif pivot == (a, part):
                    both = len(np.intersect1d(mine, own, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(own) - both):
                        out.append((a, d))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _block_links(sets: list[np.ndarray], comps: list[int], percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """Pairs of components that links between the sets join, only as many as join them: a forest.

    Intersections come from products of 0/1 matrices over the shared elements, some
    columns at a time; counts stay exact in single precision.
    """
    _, comp = np.unique(np.array(comps, np.int64), return_inverse=True)
    if comp.max(initial=0) == 0:
        return []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(items, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    place, owner = (np.cumsum(times > 1) - 1)[code[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((times > 1).sum()), columns):
        a, b = np.searchsorted(place, [low, low + columns])
        matrix = np.zeros((len(sets), columns), np.float32)
        matrix[owner[a:b], place[a:b] - low] = 1
        both += matrix @ matrix.T
    link = 100 * both >= percent * (sizes[:, None] + sizes - both)
    out, open_ = [], np.ones(comp.max() + 1, bool)
    mates = np.split(np.argsort(comp, kind="stable"), np.cumsum(np.bincount(comp))[:-1])
    for start in range(len(open_)):
        todo = [start] if open_[start] else []
        open_[start] = False
        while todo:
            c = todo.pop()
            near = np.unique(comp[link[mates[c]].any(axis=0)])
            near = near[open_[near]]
            open_[near] = False
            out += [(comps[mates[c][0]], comps[mates[k][0]]) for k in near.tolist()]
            todo += near.tolist()
    return out


def _crowded_links(mixed: DataFrame, texts: DataFrame, size: int, percent: int, crowd: int, block: int) -> DataFrame:
    """Pairs (a, b) of components that links inside crowded buckets join, each pair once.

    A document's home is the least of its crowded buckets. In a home, components of over
    ``block`` members are cut into blocks of their own, smaller ones share blocks. Two
    blocks meet in a task once, if some bucket has members in both, however many do;
    blocks of one component never meet, as there is nothing left to join.
    """
    large = stored(mixed.groupBy("bucket").agg(F.count("*").alias("c")).where(f"c > {crowd}").select("bucket"), "crowded")
    inside = mixed.join(large, "bucket").select("bucket", "d", "comp")
    homes = inside.groupBy("d", "comp").agg(F.min("bucket").alias("home"))
    sizes = homes.groupBy("home", "comp").agg(F.count("*").alias("size")).withColumn("alone", F.when(F.col("size") > block, F.col("comp")))
    width = sizes.groupBy("home", "alone").agg(F.expr(f"sum(size) div {block} + 1").alias("parts"))
    homes = homes.join(sizes.select("home", "comp", "alone"), ["home", "comp"])
    homes = homes.join(width.withColumnRenamed("alone", "own"), F.expr("own <=> alone") & (homes["home"] == width["home"])).drop(width["home"])
    part = F.expr("pmod(hash(if(alone is null, comp, d)), parts)").alias("part")
    homes = stored(homes.select("d", "comp", F.struct("home", "alone", part).alias("block")), "homes")
    seen = inside.join(homes.select("d", "block"), "d").select("bucket", "block").distinct()
    meets = seen.join(seen.select("bucket", F.col("block").alias("other")), "bucket").where("block <= other")
    meets = meets.where("not coalesce(block.alone = other.alone, false)")
    meets = stored(meets.select("block", "other").distinct(), "meets")
    key = F.xxhash64("block", "other").alias("task")
    left = meets.select(key, "block", "other").join(homes, "block").select("task", "d", "comp")
    right = meets.where("block < other").select(key, F.col("other").alias("block")).join(homes, "block").select("task", "d", "comp")
    rows = left.unionByName(right).distinct().join(texts.withColumnRenamed("_d", "d"), "d").select("task", "d", "comp", "_text")
    rows = rows.repartition("task").sortWithinPartitions("task")

    def run(batches):
        now, held = None, []

        def flush():
            pairs = _block_links([s for _, s in held], [c for c, _ in held], percent)
            ends = [[f(p) for p in pairs] for f in (min, max)]
            return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])

        for batch in batches:
            for task, _, comp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != now and held:
                    yield flush()
                    held = []
                now = task
                held.append((comp, shingle_set(text, size)))
        if held:
            yield flush()

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for nodes with an edge.

    Each round a node takes the least root among its own and its neighbours', then its
    root's root, so that distances to the root halve. Rounds are stored; only a count of
    changes comes to the driver.
    """
    both = stored(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    roots = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
        hop = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("next"))
        up = roots.select(F.col("node").alias("next"), F.col("root").alias("above"))
        moved = stored(hop.join(up, "next").select("node", "old", F.least("next", "above").alias("root")), "roots")
        roots = moved.select("node", "root")
        if moved.where("root <> old").isEmpty():
            return roots


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: the old ones are joined, not built again."""
    if roots is None:
        return components(links)
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias("up"))
        links = links.join(own, end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "contracted")
    above = components(links)
    up = above.select(F.col("node").alias("root"), F.col("root").alias("up"))
    old = roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return stored(old.unionByName(above.join(roots, "node", "left_anti")), "roots")


def _mixed(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members (bucket, d, n, comp) of the buckets that hold several components."""
    if roots is None:
        now = members.withColumn("comp", F.col("d"))
    else:
        now = members.join(roots.withColumnRenamed("node", "d"), "d", "left").withColumn("comp", F.coalesce("root", "d")).drop("root")
    several = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return stored(now.join(stored(several, "several"), "bucket"), "mixed")


def _cross_pairs(mixed: DataFrame, tested: DataFrame | None, percent: int, cap: int) -> DataFrame:
    """Untested pairs (lo, hi; a: the pivot, b) of pivots and members of other components.

    Up to ``cap`` members of a bucket are pivots, one of each component before a second of
    any. Their order is the same in all buckets, so that like buckets have like pivots.
    """
    turn = W.partitionBy("bucket", "comp").orderBy(F.xxhash64("d"))
    each = W.partitionBy("bucket").orderBy("turn", F.xxhash64("comp"))
    pivots = (
        mixed.withColumn("turn", F.row_number().over(turn)).where(f"turn <= {cap}")
        .withColumn("rank", F.row_number().over(each)).where(f"rank <= {cap}")
        .select("bucket", F.col("d").alias("a"), F.col("n").alias("m"), F.col("comp").alias("other"))
    )
    close = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    pairs = (
        mixed.join(pivots, "bucket").where(f"comp <> other and {close}")
        .groupBy(F.least("a", "d").alias("lo"), F.greatest("a", "d").alias("hi")).agg(F.min("a").alias("a"))
        .withColumn("b", F.expr("if(a = lo, hi, lo)"))
    )
    return pairs if tested is None else pairs.join(tested, ["lo", "hi"], "left_anti")


def _grouped(
    docs: DataFrame, size: int, percent: int, bands: int, band_rows: int, share: int, crowd: int, block: int, id_col: str, text_col: str, few: int = 4
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketch; the classes (root, k1, k2, _d); the components (root, least)).

    ``least`` is the component's first row by id, then by row hash: (whether the id is
    null, first, _d).

    Equal sets are one class. Classes that agree on a band of the signature share a
    bucket; of a bucket with several components, one member, and later ``few``, become
    pivots, are compared with all members of other components on full sets, and the links
    join components. Buckets of over ``crowd`` members that still hold several components
    are then compared whole, in blocks, and in the others all members become pivots; so no
    link within a bucket is lost and members of one component are not paired with each
    other. With the default bands a pair at 0.85 shares no bucket with probability 4e-7,
    one at 0.8 with 3e-5.
    """
    rows = keyed(docs, id_col, text_col)
    sketch = stored(_sketch(rows, size, bands, band_rows), "sketch")
    least = F.min(F.struct(F.col("_id").isNull(), "_id", "_d", "n", "bands")).alias("at")
    classes = stored(
        sketch.where("n > 0").groupBy("k1", "k2").agg(least).select("k1", "k2", F.col("at._id").alias("first"), "at._d", "at.n", "at.bands"),
        "classes",
    )
    slots = classes.select(F.col("_d").alias("d"), "n", F.explode("bands").alias("bucket"))
    shared = stored(slots.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "shared")
    members = stored(slots.join(shared, "bucket"), "members")
    inside = members.select(F.col("d").alias("_d")).distinct()
    texts = stored(rows.join(inside, "_d", "left_semi").select("_d", "_text").dropDuplicates(["_d"]), "texts")
    roots = tested = None
    for cap in (1, few, crowd):
        mixed = _mixed(members, roots)
        if cap == crowd:
            more = stored(_crowded_links(mixed, texts, size, percent, crowd, block), "links")
            if not more.isEmpty():
                roots = _joined(roots, more)
            sizes = members.groupBy("bucket").agg(F.count("*").alias("c")).where(f"c <= {crowd}").select("bucket")
            mixed = _mixed(members.join(sizes, "bucket", "left_semi"), roots)
        pairs = stored(_cross_pairs(mixed, tested, percent, cap), "pairs")
        if pairs.isEmpty():
            continue
        found = stored(_linked(pairs.select("a", "b"), texts, size, percent, share), "links")
        pairs = pairs.select("lo", "hi")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not found.isEmpty():
            roots = _joined(roots, found)
    if roots is None:
        roots = texts.select(F.col("_d").alias("node"), F.col("_d").alias("root"))
    named = classes.join(roots.withColumnRenamed("node", "_d"), "_d", "left").withColumn("root", F.coalesce("root", "_d"))
    names = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "_d")).alias("least"))
    return sketch, named, names


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    bands: int = 20,
    band_rows: int = 4,
    share: int = 2000,
    crowd: int = 64,
    block: int = 800,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Group documents linked by 100 * intersection >= ``percent`` * union of their shingles.

    See :func:`_grouped` for how links are found.

    Per row: the id, ``n_shingles``, ``component_id`` (the least id of its component) and
    ``kept`` (whether that is its own). A null or wordless text has no shingles, its own id
    as component and stays; repeated rows are copies, all of the least id are kept; null
    ids count as larger than others; no rows give no rows.
    """
    sketch, named, names = _grouped(docs, size, percent, bands, band_rows, share, crowd, block, id_col, text_col)
    named = named.join(names, "root").select("k1", "k2", F.col("least.first").alias("component_id"))
    out = sketch.join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept")
    )


def keep_one(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    bands: int = 20,
    band_rows: int = 4,
    share: int = 2000,
    crowd: int = 64,
    block: int = 800,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Whole rows of ``docs``: one of each component of :func:`near_duplicates`.

    It is the row of the least id, a null id after all others, then of the least hash of id
    and text; of rows that agree in both, the first by all columns. Rows are told apart by
    that hash, so ids may be null or used again. Rows without words have no shingles and all stay.
    """
    *_, names = _grouped(docs, size, percent, bands, band_rows, share, crowd, block, id_col, text_col)
    worded = F.coalesce(F.col(text_col).rlike(r"\S"), F.lit(False))
    rows = docs.where(worded).select(F.struct(docs.columns).alias("_doc"), F.xxhash64(id_col, utf8(text_col)).alias("_d"))
    # Repeated rows are cut before the shuffle, by the limit on the row number.
    one = W.partitionBy("_d").orderBy("_doc")
    rows = rows.withColumn("_row", F.row_number().over(one)).where("_row = 1")
    rows = rows.join(names.select("least._d"), "_d", "left_semi").select("_doc.*")
    return rows.unionByName(docs.where(~worded))
