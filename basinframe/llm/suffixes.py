"""Repeated substrings by suffix arrays, sorted by induction with queues on disk."""

from __future__ import annotations

import hashlib
import tempfile
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.llm.repeats import byte_symbols, candidates, finer_runs, finished, run_texts, stored
from basinframe.session import shuffle_width


#: Entries handled at once, and "no limit" for a count of shared symbols.
_BLOCK = 1 << 16
_ALL = np.uint16(65535)


class BucketQueues:
    """A queue of suffixes per first symbol: out in order of symbol, then of entry.

    An entry is a suffix's position and the number of symbols it shares with the entry
    before it. Suffixes enter in the order of the suffixes they precede, so the queues
    together are a priority queue. Beyond ``budget`` entries in memory, all move to a
    temporary file without a name, which goes with the process.
    """

    spills = 0

    def __init__(self, budget: int):
        self.budget, self.held, self.file = budget, 0, None
        self.memory: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.disk: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def push(self, symbol: int, positions: np.ndarray, shared: np.ndarray) -> None:
        self.memory[symbol].append((positions, shared))
        self.held += len(positions)
        if self.held > self.budget:
            self._spill()

    def push_all(self, positions: np.ndarray, symbols: np.ndarray, shared: np.ndarray) -> None:
        """Entries whose symbols are in order."""
        cuts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])).tolist() if len(symbols) else []
        for a, b in zip(cuts, [*cuts[1:], len(symbols)]):
            self.push(int(symbols[a]), positions[a:b], shared[a:b])

    def _spill(self) -> None:
        BucketQueues.spills += 1
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, parts in self.memory.items():
            own, shared = (np.concatenate(x) for x in zip(*parts, strict=True))
            for low in range(0, len(own), _BLOCK):
                part = own[low : low + _BLOCK]
                self.disk[symbol].append((self.file.tell(), len(part)))
                self.file.write(part.astype(np.int32).tobytes())
                self.file.write(shared[low : low + _BLOCK].astype(np.uint16).tobytes())
        self.memory.clear()
        self.held = 0

    def _read(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at)
        own = np.frombuffer(self.file.read(4 * n), np.int32)
        return own, np.frombuffer(self.file.read(2 * n), np.uint16)

    def pop(self, symbol: int):
        """Blocks (positions, shared) of a symbol, those that enter meanwhile included."""
        while symbol in self.disk or symbol in self.memory:
            if symbol in self.disk:
                # What is in memory came later, and what comes now later still.
                for at, n in self.disk.pop(symbol):
                    yield self._read(at, n)
            else:
                parts = self.memory.pop(symbol)
                self.held -= sum(len(p) for p, _ in parts)
                own, shared = (np.concatenate(x) for x in zip(*parts, strict=True))
                for low in range(0, len(own), _BLOCK):
                    yield own[low : low + _BLOCK], shared[low : low + _BLOCK]

    def pop_back(self, symbol: int):
        """Blocks of a symbol from the last entry to the first, each block reversed."""
        for own, shared in reversed(self.memory.pop(symbol, ())):
            self.held -= len(own)
            yield own[::-1], shared[::-1]
        for at, n in reversed(self.disk.pop(symbol, ())):
            own, shared = self._read(at, n)
            yield own[::-1], shared[::-1]


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values[low : high + 1]`` for each pair of places, by halves."""
    span = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table = np.empty((int(span.max(initial=0)) + 1, len(values)), values.dtype)
    table[0] = values
    for k in range(1, len(table)):
        half, n = 1 << (k - 1), len(values) - (1 << k) + 1
        np.minimum(table[k - 1, :n], table[k - 1, half : half + n], out=table[k, :n])
    return np.minimum(table[span, low], table[span, high - (1 << span.astype(np.int64)) + 1])


class _Shared:
    """Common prefixes of suffixes that enter one queue, from those of the suffixes behind them.

    Two suffixes with one first symbol share one symbol more than the two behind them do,
    which share the least common prefix of all suffixes taken between the two.
    """

    def __init__(self, symbols: int, cap: int):
        self.cap = cap
        self.low = np.zeros(symbols, np.uint16)

    def fresh(self) -> None:
        """The next suffixes share nothing with those before."""
        self.low[:] = 0

    def of(self, shared: np.ndarray, places: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """For a block with common prefixes ``shared``, of which ``places`` put a suffix into
        the queues ``symbols`` (in order of symbol, then place), what those share."""
        head = np.append(True, symbols[1:] != symbols[:-1])
        last = np.append(head[1:], True)
        low = np.where(head, 0, np.append(0, places[:-1] + 1))
        found = _least(shared, low, places)
        found[head] = np.minimum(found[head], self.low[symbols[head]])
        np.minimum(self.low, shared.min(), out=self.low)
        after = places[last] + 1
        rest = np.minimum.accumulate(shared[::-1])[::-1]
        self.low[symbols[last]] = np.where(after < len(shared), rest[np.minimum(after, len(shared) - 1)], _ALL)
        return np.minimum(found, self.cap - 1) + np.uint16(1)


def _suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last counts as such)."""
    n = len(text)
    rise = np.sign(np.diff(text, append=text[-1])).astype(np.int8)
    rise[-1] = 1
    known = np.where(rise != 0, np.arange(n, dtype=np.int32), np.int32(n))
    return rise[np.minimum.accumulate(known[::-1])[::-1]] > 0


def _seam(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """Symbols that two suffixes share, at most ``cap``; separators are all different."""
    n = min(cap, len(text) - max(a, b))
    x, y = text[a : a + n], text[b : b + n]
    stop = np.flatnonzero((x != y) | (x <= 1))
    return int(stop[0]) if len(stop) else n


def _induce(text, small, seeds, seed_shared, budget, cap):
    """All suffixes from the last to the first, from the seeds (leftmost small suffixes) in order.

    Yields blocks (positions, symbols shared with the suffix yielded before, up to ``cap``).
    Large suffixes follow from left to right, then small ones from right to left: each
    taken suffix puts the one before it into that one's queue, with what it shares there.
    Separators (symbol 1) are in order by place. A ``cap`` of 0 leaves common prefixes out.
    """
    last = int(text.max())
    starts = np.searchsorted(text[seeds], np.arange(last + 2))
    queues, large, shares = BucketQueues(budget), BucketQueues(budget), _Shared(last + 1, cap)

    def put(own, shared, kind):
        places = np.flatnonzero(own > 0)
        places = places[small[own[places] - 1] == kind]
        if len(places):
            symbols = text[own[places] - 1]
            order = np.argsort(symbols, kind="stable")
            places, symbols = places[order], symbols[order]
            new = shares.of(shared, places, symbols) if cap else np.zeros(len(places), np.uint16)
            queues.push_all(own[places] - 1, symbols, new)
        elif cap:
            np.minimum(shares.low, shared.min(initial=_ALL), out=shares.low)

    def headed(shared, first):
        shared = shared.copy()
        shared[0] = first
        return shared

    for c in range(last + 1):
        shares.fresh()
        before = None
        for own, shared in queues.pop(c):
            shared = headed(shared, 0) if before is None else shared
            large.push(c, own, shared)
            put(own, shared, False)
            before = int(own[-1])
        for at in range(starts[c], starts[c + 1], _BLOCK):
            own, shared = (x[at : min(at + _BLOCK, starts[c + 1])] for x in (seeds, seed_shared))
            if at == starts[c]:
                shared = headed(shared, 0 if before is None else _seam(text, before, int(own[0]), cap))
            put(own, shared, False)
    shares.fresh()
    queues.push(0, np.array([len(text) - 1], np.int32), np.zeros(1, np.uint16))
    for c in range(last, -1, -1):
        shares.fresh()
        before = None
        blocks = queues.pop(c)
        if c == 1:
            list(blocks)
            own = np.flatnonzero(text == 1)[::-1].astype(np.int32)
            blocks = [(own[k : k + _BLOCK], np.zeros(len(own[k : k + _BLOCK]), np.uint16)) for k in range(0, len(own), _BLOCK)]
        for own, shared in blocks:
            shared = headed(shared, 0) if before is None else shared
            put(own, shared, True)
            yield own, shared
            before = int(own[-1])
        ahead = None
        for own, shared in large.pop_back(c):
            if ahead is None:
                ahead = 0 if before is None else _seam(text, before, int(own[0]), cap)
            moved = np.append(np.uint16(ahead), shared[:-1])
            ahead = shared[-1]
            put(own, moved, True)
            yield own, moved


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling the compared length.

    The string ends with its least name. Only names that still tie are sorted again.
    """
    n = len(names)
    order = np.argsort(names, kind="stable").astype(np.int32)
    # A tie's members share the place of the first of them.
    head = np.append(True, np.diff(names[order]) != 0)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))
    width = 1
    while True:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1).astype(np.int32)
        del size
        if not len(tied):
            return np.argsort(rank, kind="stable").astype(np.int32)
        nxt = rank[np.minimum(tied + width, n - 1)]
        own = rank[tied]
        at = np.argsort(own.astype(np.int64) * n + nxt)
        a, b, who = own[at], nxt[at], tied[at]
        new_group = np.append(True, a[1:] != a[:-1])
        head = new_group | np.append(True, b[1:] != b[:-1])
        index = np.arange(len(at), dtype=np.int32)
        first = np.maximum.accumulate(np.where(new_group, index, np.int32(0)))
        lead = np.maximum.accumulate(np.where(head, index, np.int32(0)))
        rank[who] = a + lead - first
        width *= 2


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all strings, each after a separator (1), and a last 0; where strings begin."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(lens + 1) - lens
    text = np.frombuffer(b"\0".join([b"", *strings, b""]), np.uint8).astype(np.int16)
    text += 2
    text[begin - 1] = 1
    text[0], text[-1] = 1, 0
    return text, begin


def _neighbours_share(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Symbols that each suffix of ``order`` shares with the one before it, at most ``cap``."""
    flat = np.zeros(len(text) + cap + 8, np.uint8)
    flat[: len(text)] = text.astype(np.uint8)
    words = np.ndarray((len(flat) - 7,), np.uint64, flat, strides=(1,))
    out = np.full(len(order), cap, np.uint16)
    out[:1] = 0
    live = np.arange(1, len(order), dtype=np.int32)
    for step in range(0, cap, 8):
        differ = words[order[live] + step] ^ words[order[live - 1] + step]
        done = differ != 0
        low = differ[done]
        low &= np.uint64(0) - low
        out[live[done]] = np.minimum(step + (np.frexp(low.astype(np.float64))[1] - 1) // 8, cap)
        live = live[~done]
        if not len(live):
            break
    # No common prefix goes past a separator; those hold none at all.
    ends = np.append(np.flatnonzero(text <= 1), len(text))
    left = ends[np.searchsorted(ends, order)] - order
    out[1:] = np.minimum(out[1:], np.minimum(left[1:], left[:-1]))
    return out


def sorted_suffixes(strings: list[bytes], cap: int, budget: int = 1 << 20):
    """Suffixes of all strings from the last to the first, as blocks (positions, shared).

    Positions are those in the joined text; ``shared`` counts the symbols a suffix shares
    with the one yielded before it, up to ``cap``. Separators are smaller than all bytes
    and differ, so no order depends on what follows a string. Leftmost small substrings,
    sorted by a first induction, get names; the order of the string of names seeds the
    final one. Both inductions go through queues of at most ``budget`` entries in memory;
    besides, the text takes three bytes a symbol, and its seeds, at most every other
    symbol, some thirty bytes each.
    """
    text, _ = _joined(strings)
    total = len(text)
    small = _suffix_types(text)
    # Neighbouring separators (empty strings) are told apart by place like all others.
    separator = text == 1
    small |= separator
    is_seed = separator | (small & np.append(False, ~small[:-1]))
    is_seed[-1] = True
    seeds = np.flatnonzero(is_seed).astype(np.int32)
    first = seeds[np.argsort(text[seeds], kind="stable")]
    none = np.zeros(len(seeds), np.uint16)
    rough = np.concatenate([own[is_seed[own]] for own, _ in _induce(text, small, first, none, budget, 0)])[::-1]
    del first, separator
    # Equal neighbours in this order share a name: same length, same symbols.
    length = np.minimum(np.append(seeds[1:], total) + 1, total).astype(np.int32) - seeds
    at = (np.cumsum(is_seed, dtype=np.int32) - np.int32(1))[rough]
    a, b = rough[:-1], rough[1:]
    span = length[at[:-1]]
    same = (span == length[at[1:]]) & (text[a] > 1)
    step, live = 0, np.flatnonzero(same).astype(np.int32)
    while len(live):
        live = live[span[live] > step]
        differ = text[a[live] + step] != text[b[live] + step]
        same[live[differ]] = False
        live = live[~differ]
        step += 1
    # A substring that ends at a separator ends at one of its own.
    same[np.flatnonzero(same)[text[a[same] + span[same] - 1] <= 1]] = False
    name = np.empty(len(seeds), np.int32)
    name[at] = np.append(0, np.cumsum(~same))
    del a, b, same, span, at, rough, length, is_seed
    order = seeds[_rank_names(name)]
    del seeds, name
    yield from _induce(text, small, order, _neighbours_share(text, order, cap), budget, cap)


def repeated_windows(
    strings: list[bytes], windows: list[int], copies: list[int], width: int, budget: int = 1 << 20
) -> list[np.ndarray]:
    """For each string, which of its first ``windows`` substrings of ``width`` bytes occur
    twice or more among all strings, a string counting ``copies`` times.

    The sorted suffixes are read as they come: a window joins the group of the one before
    if both share ``width`` bytes. Suffixes with fewer bytes left are in no group.
    """
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(lens + 1) - lens
    count = np.array(windows, np.int64)
    hit = np.zeros(int(lens.sum()) + len(strings) + 2, bool)
    # Copies of the window that starts at a place, two standing for more; 0 where none starts.
    weight = np.zeros(len(hit), np.uint8)
    starts = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    weight[starts] = np.repeat(np.minimum(copies, 2).astype(np.uint8), count)
    del starts
    held, total = -1, 0  # The last group's copies so far, and its member while it is alone.
    for own, shared in sorted_suffixes(strings, width, budget):
        own, shared = own[inside := weight[own] > 0], shared[inside]
        if not len(own):
            continue
        group = np.cumsum(shared < width)
        sums = np.bincount(group, weights=weight[own], minlength=int(group[-1]) + 1)
        if group[0] == 0:
            sums[0] += total
            if sums[0] > 1 and held >= 0:
                hit[held] = True
        hit[own] = sums[group] > 1
        total = int(sums[-1])
        held = int(own[-1]) if total <= 1 else -1
    return [hit[a : a + n] for a, n in zip(begin.tolist(), windows, strict=True)]


def _byte_cut(text: bytes):
    return lambda a, b: text[a:b]


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as (first, number)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def _sort_shards(rows: DataFrame, width: int, shard_bytes: int, queue_entries: int) -> DataFrame:
    """Rows (g, w, n, copies, cut): the repeated windows of each run, as (g, w, from, count).

    Rows with one g come together, in order; a shard is as many of them as fit, one at least.
    """

    def flush(held):
        hits = repeated_windows([h[4] for h in held], [h[2] for h in held], [h[3] for h in held], width, queue_entries)
        found = [(h[0], h[1], a, n) for h, hit in zip(held, hits, strict=True) for a, n in spans_of(hit)]
        g, w, a, n = zip(*found) if found else ((), (), (), ())
        arrays = [pa.array(g, pa.int64()), pa.array(w, pa.int64()), pa.array(a, pa.int32()), pa.array(n, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["g", "w", "at", "count"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "w", "n", "copies", "cut")), strict=True):
                if size > shard_bytes and held[-1][0] != row[0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush(held)

    # Sorting costs more than the rows' bytes tell, so their partitions are not merged.
    rows = rows.repartition(shuffle_width(rows.sparkSession), "g").sortWithinPartitions("g", "w")
    return rows.mapInArrow(run, "g long, w long, at int, count int")


def repeated_spans(
    docs: DataFrame,
    width: int = 200,
    gram: int = 50,
    crowd: int = 20_000,
    shard_bytes: int = 6 << 20,
    queue_entries: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    finish=None,
    finish_ddl: str = "",
) -> DataFrame:
    """Remove each byte covered by a ``width``-byte string that also starts anywhere else.

    Runs of windows with a recurring anchor (see :mod:`repeats`) are grouped by it. Equal
    runs are folded to one string with its number of copies. A group of one string needs
    no order; strings of other groups are dealt to shards by their anchor, sorted as suffix
    arrays, and windows whose neighbours share ``width`` bytes are repeats. An anchor with
    over ``crowd`` different strings is cut by longer grams, at last by whole windows,
    where equal ones fold, so that no shard grows with a common phrase. A shard's queues
    keep ``queue_entries`` suffixes in memory, the others on the task's disk.

    ``finish(texts, spans)`` gives the output columns of ``finish_ddl`` from whole texts
    and their removed spans. A null text is empty; repeated rows repeat each other and
    lose all windows; texts shorter than ``width`` bytes stay; no rows give no rows.
    """
    found = candidates(docs, id_col, text_col, byte_symbols, _byte_cut, width, gram, False, finish, finish_ddl)
    rows_of = found.where("_text is not null").groupBy("_d").agg(F.count("*").alias("rows"))
    runs = found.where("_text is not null").dropDuplicates(["_d"]).select("_d", F.explode("_runs").alias("r"))
    runs = runs.select("_d", "r.g", "r.w", "r.lo", "r.n")
    more_rows = rows_of.where("rows > 1")
    ranges = []
    for finer in (3 * width // 4, width, None):
        runs = runs.join(more_rows, "_d", "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
        folded = runs.groupBy("g", "w").agg(F.sum("rows").alias("copies"), F.min(F.struct("_d", "lo", "n")).alias("at"))
        folded = stored(folded.select("g", "w", "copies", "at.*"), "runs")
        groups = folded.groupBy("g").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total"))
        one = folded.join(groups.where("kinds = 1 and total > 1").select("g"), "g", "left_semi")
        several = folded.join(groups.where(f"kinds > 1 and kinds <= {crowd}").select("g"), "g", "left_semi")
        cuts = run_texts(found, several, _byte_cut, width, "g bigint, w bigint, copies bigint")
        hits = _sort_shards(cuts, width, shard_bytes, queue_entries).unionByName(
            one.select("g", "w", F.lit(0).alias("at"), F.col("n").alias("count"))
        )
        places = runs.select("_d", "g", "w", "lo").join(hits, ["g", "w"])
        start = F.col("lo") + F.col("at")
        ranges.append(places.select("_d", start.alias("start"), (start + F.col("count") + (width - 1)).alias("stop")))
        hot = groups.where(f"kinds > {crowd}").select("g")
        if finer is None or hot.isEmpty():
            break
        runs = stored(finer_runs(found, runs, stored(hot, "crowded"), byte_symbols, _byte_cut, width, finer), "finer")
    for other in ranges[1:]:
        ranges[0] = ranges[0].unionByName(other)
    return finished(found, ranges[0], id_col, finish, finish_ddl)


def _without(text: bytes, spans) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def remove_repeats(
    docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, **more
) -> DataFrame:
    """Per row the id, ``kept`` (the remaining bytes, binary) and ``spans`` (removed byte ranges).

    ``as_text`` gives ``kept`` as a string, without the rests of characters that a range cuts.
    """

    def finish(texts, spans):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kept = [_without(t, s) for t, s in zip(texts, spans, strict=True)]
        return [
            pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
            pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], kind),
        ]

    ddl = f"kept {'string' if as_text else 'binary'}, spans array<struct<start:bigint,stop:bigint>>"
    return repeated_spans(docs, width, id_col=id_col, text_col=text_col, finish=finish, finish_ddl=ddl, **more)


def repeat_digests(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """As :func:`remove_repeats`, with counts and a digest in place of the bytes."""

    def finish(texts, spans):
        gone = [sum(b - a for a, b in s) for s in spans]
        return [
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array(gone, pa.int64()),
            pa.array([len(s) for s in spans], pa.int64()),
            pa.array([hashlib.sha256(_without(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)]),
        ]

    ddl = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return repeated_spans(docs, width, id_col=id_col, text_col=text_col, finish=finish, finish_ddl=ddl, **more)
