"""Repeated phrases: confirmed passages, sharded automata, every occurrence located."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.llm.common import Codes, chunks
from basinframe.llm.repeats import candidates, finer_runs, finished, stored, word_symbols


def _word_cut(text: bytes):
    words = text.split()
    return lambda a, b: b" ".join(words[a:b])


def confirm(rows: list[tuple], window: int) -> list[tuple]:
    """Passages of one anchor that occur in documents of different ids.

    ``rows``: (first id, last id, words of the run) of each different run. A passage is a
    run of consecutive windows that each occur under another id too, and first under the
    same one: (that id, words).
    """
    ids: dict[bytes, tuple] = {}
    split = [(first, last, words.split(b" ")) for first, last, words in rows]
    keys = []
    for first, last, words in split:
        own = [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]
        for key in own:
            a, b = ids.get(key, (first, last))
            ids[key] = min(a, first), max(b, last)
        keys.append(own)
    out = set()
    for (_, _, words), own in zip(split, keys, strict=True):
        start, held = 0, None
        for i, key in enumerate([*own, None]):
            first, last = ids[key] if key is not None else (None, None)
            now = first if key is not None and first < last else None
            if now != held:
                if held is not None:
                    out.add((held, b" ".join(words[start : i - 1 + window])))
                start, held = i, now
    return sorted(out)


class PhraseAutomaton:
    """Aho-Corasick automaton over the words of passages; words are compared whole."""

    def __init__(self, passages: list[tuple]):
        self.codes = Codes({b"": 0})
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for first, words in passages:
            key = tuple(self.codes[w] for w in words.split(b" "))
            self.tree.add_word(key, (min(first, self.tree.get(key, (first,))[0]), len(key)))
        self.tree.make_automaton()

    def locate(self, words: list[bytes], own) -> list[tuple[int, int]]:
        """Word ranges of the occurrences of passages that some id before ``own`` has."""
        get = self.codes.get
        found = []
        for end, (first, size) in self.tree.iter(tuple([get(w, 0) for w in words])):
            if first < own:
                found.append((end + 1 - size, end + 1))
        return found


def _pieces(found: DataFrame, specs: DataFrame, kind: str, window: int) -> DataFrame:
    """Contents of representative runs (``rep``) and, per document and shard, the joined
    stretches that hold its candidate runs."""
    parts = ["lo", "n", "rep", "g", "f", "first", "last"]
    lists = specs.groupBy("_d").agg(F.collect_list(F.struct(*parts)).alias("_specs")).withColumnRenamed("_d", "_key")
    texts = found.where("_text is not null").select("_id", "_text", "_d").dropDuplicates(["_d"])
    rows = texts.join(lists, texts["_d"] == lists["_key"]).select("_id", "_text", "_d", "_specs")
    names = ["rep", "g", "f", "first", "last", "d", "id", "at", "cut"]

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 2 << 20):
                out = []
                for own, text, d, specs in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    cut, spans = _word_cut(text), defaultdict(list)
                    for s in specs:
                        a, b = s["lo"], s["lo"] + s["n"] + window - 1
                        if s["rep"]:
                            out.append((True, s["g"], s["f"], s["first"], s["last"], None, None, None, cut(a, b)))
                        else:
                            spans[s["f"]].append((a, b))
                    for f, held in spans.items():
                        start = stop = None
                        for a, b in [*sorted(held), (None, None)]:
                            if stop is not None and (a is None or a > stop):
                                out.append((False, None, f, None, None, d, own, start, cut(start, stop)))
                                start = stop = None
                            if a is not None:
                                start, stop = (a, b) if stop is None else (start, max(stop, b))
                i = part.schema.field("_id").type
                kinds = [pa.bool_(), pa.int64(), i, i, i, pa.int64(), i, pa.int32(), pa.binary()]
                columns = zip(*out, strict=True) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    ddl = f"rep boolean, g long, f {kind}, first {kind}, last {kind}, d long, id {kind}, at int, cut binary"
    return stored(rows.mapInArrow(run, ddl), "pieces")


def _confirmed(pieces: DataFrame, kind: str, window: int) -> DataFrame:
    """(f, first, cut) of the passages; the runs of an anchor come together, in order."""

    def run(batches):
        held, now, out = [], None, []

        def take(last=False):
            nonlocal out
            if held:
                f = held[0][0]
                out += [(f, first, words) for first, words in confirm([h[1:] for h in held], window)]
                held.clear()
            if out and (last or len(out) > 5000):
                yield out
                out = []

        def packed(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), pa.array(columns[1], id_type), pa.array(columns[2], pa.binary())], names=["f", "first", "cut"]
            )

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("f").type
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "f", "first", "last", "cut")), strict=True):
                if g != now:
                    for rows in take():
                        yield packed(rows)
                    now = g
                held.append(row)
        for rows in take(True):
            yield packed(rows)

    rows = pieces.where("rep").select("g", "f", "first", "last", "cut")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, f"f {kind}, first {kind}, cut binary")


def _located(pieces: DataFrame, passages: DataFrame, kind: str, share: int) -> DataFrame:
    """(_d, start, stop): every occurrence of a passage in a document of a later id.

    A shard is the passages whose anchors are first seen under one id. It gets the
    stretches of the documents that hold such anchors; one with over ``share`` bytes of
    them is split, and each part gets the shard's automaton.
    """
    stretches = pieces.where("not rep").select("f", "d", "id", "at", "cut")
    size = stretches.groupBy("f").agg((F.expr(f"sum(length(cut)) div {share}") + 1).cast("int").alias("parts"))
    texts = stretches.join(size, "f").select(
        "f", F.expr("pmod(hash(d), parts)").alias("part"), F.lit(1).alias("turn"), "d", "id", "at", F.lit(None).cast(kind).alias("first"), "cut"
    )
    plans = passages.join(size, "f").select(
        "f", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"),
        F.lit(None).cast("bigint").alias("d"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("int").alias("at"), "first", "cut",
    )
    rows = plans.unionByName(texts).repartition("f", "part").sortWithinPartitions("f", "part", "turn")

    def run(batches):
        shard, plan, tree = None, [], None
        for batch in batches:
            out = []
            for f, part, turn, d, own, at, first, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (f, part) != shard:
                    shard, plan, tree = (f, part), [], None
                if turn == 0:
                    plan.append((first, cut))
                elif plan and own is not None:
                    tree = tree or PhraseAutomaton(plan)
                    out += [(d, at + a, at + b) for a, b in tree.locate(cut.split(b" "), own)]
            d, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["_d", "start", "stop"])

    return rows.mapInArrow(run, "_d long, start int, stop int")


def repeated_phrases(
    docs: DataFrame,
    window: int = 50,
    gram: int = 25,
    crowd: int = 20_000,
    share: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    finish=None,
    finish_ddl: str = "",
) -> DataFrame:
    """Remove each word covered by ``window`` consecutive words that also start in a
    document of a smaller id.

    Runs of windows whose anchor occurs under several ids are candidates (:mod:`repeats`);
    equal ones fold to one with its first and last id. The different runs of an anchor are
    compared window by window, which confirms the passages that recur; passages are
    compiled into automata, one shard per id that has them first, and the candidate
    stretches of all documents are streamed through them. An anchor with over ``crowd``
    different runs is cut by longer grams, at last by whole windows, where equal ones fold.

    Words are runs of bytes other than ASCII white space. ``finish(texts, spans)`` gives
    the output columns of ``finish_ddl`` from whole texts and removed word ranges. A null
    text has no words; rows that share an id do not count as earlier than each other; a row
    without an id loses nothing and is earlier than none; no rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = candidates(docs, id_col, text_col, word_symbols, _word_cut, window, gram, True, finish, finish_ddl)
    open_ = found.where("_text is not null and _id is not null").dropDuplicates(["_d"])
    ids = open_.select("_d", "_id")
    runs = open_.select("_d", "_id", F.explode("_runs").alias("r")).select("_d", "_id", "r.g", "r.w", "r.lo", "r.n")
    specs = []
    for finer in ((window + gram) // 2, window, None):
        folded = stored(
            runs.groupBy("g", "w")
            .agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.min(F.struct("_id", "_d", "lo", "n")).alias("at"))
            .select("g", "w", "first", "last", "at._d", "at.lo", "at.n"),
            "runs",
        )
        groups = folded.groupBy("g").agg(F.min("first").alias("f"), F.max("last").alias("l"), F.count("*").alias("kinds"))
        groups = stored(groups, "groups")
        usable = groups.where(f"f < l and kinds <= {crowd}").select("g", "f")
        reps = folded.join(usable, "g").select("_d", "lo", "n", F.lit(True).alias("rep"), "g", "f", "first", "last")
        no_id = F.lit(None).cast(kind)
        rest = runs.join(usable, "g").where(F.col("_id") > F.col("f")).select(
            "_d", "lo", "n", F.lit(False).alias("rep"), F.lit(None).cast("bigint").alias("g"), "f", no_id.alias("first"), no_id.alias("last")
        )
        specs += [reps, rest]
        hot = groups.where(f"f < l and kinds > {crowd}").select("g")
        if finer is None or hot.isEmpty():
            break
        again = finer_runs(found, runs, stored(hot, "crowded"), word_symbols, _word_cut, window, finer)
        runs = stored(again.join(ids, "_d"), "finer")
    both = specs[0]
    for more in specs[1:]:
        both = both.unionByName(more)
    pieces = _pieces(found, both, kind, window)
    ranges = _located(pieces, _confirmed(pieces, kind, window), kind, share)
    return finished(found, ranges, id_col, finish, finish_ddl)


def _kept(text: bytes, spans) -> tuple[int, int, bytes]:
    words = text.split()
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Per row the id, ``kept`` (remaining words joined by one space) and ``spans`` (removed word ranges)."""

    def finish(texts, spans):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return [
            pa.array([_kept(t, s)[2].decode("utf-8", "replace") for t, s in zip(texts, spans, strict=True)], pa.string()),
            pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], kind),
        ]

    ddl = "kept string, spans array<struct<start:bigint,stop:bigint>>"
    return repeated_phrases(docs, id_col=id_col, text_col=text_col, finish=finish, finish_ddl=ddl, **more)


def phrase_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """As :func:`remove_phrases`, with counts and a digest in place of the words."""

    def finish(texts, spans):
        found = [_kept(t, s) for t, s in zip(texts, spans, strict=True)]
        return [
            pa.array([f[0] for f in found], pa.int64()),
            pa.array([f[1] for f in found], pa.int64()),
            pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string()),
        ]

    ddl = "n_words bigint, n_removed bigint, kept_sha256 string"
    return repeated_phrases(docs, id_col=id_col, text_col=text_col, finish=finish, finish_ddl=ddl, **more)
