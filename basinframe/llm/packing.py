"""Harmonic packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basinframe.llm.common import CACHE_WORDS, chunks, id_ddl, utf8
from basinframe.session import materialize

#: A space beside other white space; texts without one can be cut before every space.
_ODD_SPACE = re.compile(r"\s | \s|^ | $")
_IDS: dict[str, dict[str, bytes]] = {}


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ranked(path: str):
    """The same vocabulary in its ``tiktoken`` form, which encodes a word several times faster."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoded(words: list[str], path: str, ranks: str | None) -> list[bytes]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    full = _tokenizer(path)
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    every = " ".join(words)
    special = [t for t in special if t in every]
    if ranks is None:
        return [array("I", e.ids).tobytes() for e in full.encode_batch_fast(words, add_special_tokens=False)]
    fast = _ranked(ranks).encode_ordinary
    if special:
        slow = lambda w: full.encode(w, add_special_tokens=False).ids
        return [array("I", slow(w) if any(t in w for t in special) else fast(w)).tobytes() for w in words]
    return [array("I", ids).tobytes() for ids in map(fast, words)]


def encode_texts(texts: list[bytes], path: str, ranks: str | None = None) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, for a byte-level BPE file.

    Such a tokenizer starts a new pre-token at a lone space between two visible
    characters, so the parts of a text that begin there are encoded once per worker. A
    text with other white space beside a space is encoded whole. ``ranks`` names the same
    vocabulary as a ``tiktoken`` file, for parts without a special token's string.
    """
    known = _IDS.setdefault(path, {})
    if len(known) > CACHE_WORDS:
        known.clear()
    parts: list[list[str]] = []
    for raw in texts:
        text = raw.decode("utf-8", "replace")
        words = [text] if " " not in text or _ODD_SPACE.search(text) else text.split(" ")
        parts.append([words[0], *map(" ".__add__, words[1:])])
    new = [w for w in set().union(*parts) if w not in known]
    fresh = dict(zip(new, _encoded(new, path, ranks), strict=True))
    known.update((w, ids) for w, ids in fresh.items() if len(w) < 200)
    out = []
    for words in parts:
        try:
            out.append(b"".join(map(known.__getitem__, words)))
        except KeyError:
            out.append(b"".join([known[w] if w in known else fresh[w] for w in words]))
    return out


def cuts(length: int, capacity: int, least: int) -> list[int]:
    """Sizes of the pieces of a document: full sequences, then halves, quarters and so on
    down to ``least``, then what is left."""
    sizes = [capacity] * (length // capacity)
    rest, size = length % capacity, capacity // 2
    while size >= least:
        if rest >= size:
            sizes.append(size)
            rest -= size
        size //= 2
    return sizes + [rest] * (rest > 0)


def _pieces(docs: DataFrame, path: str, ranks: str | None, end_id: int, capacity: int, least: int, with_ids: bool) -> DataFrame:
    key, text = docs.columns
    end = np.array([end_id], "<u4").tobytes()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "_class", "_part", "_rank"] + ["ids"] * with_ids
    ddl = f"{id_ddl(docs, key)}, start long, length long, ids_crc32 long, doc_tokens long, _class long, _part long, _rank long"

    def run(batches):
        worker, rank = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in chunks(batch, 4 << 20):
                rows, pieces, held = [], [], []
                for row, ids in enumerate(encode_texts(part.column(1).to_pylist(), path, ranks)):
                    view, start = memoryview(ids + end), 0
                    total = len(view) // 4
                    for size in cuts(total, capacity, least):
                        piece = view[4 * start : 4 * (start + size)]
                        k = capacity // size if size >= least else -(capacity // size)  # tails apart
                        pieces.append((start, size, zlib.crc32(piece), total, k, worker, rank[k]))
                        rows.append(row)
                        rank[k] += 1
                        start += size
                        if with_ids:
                            held.append(np.frombuffer(piece, "<u4").astype(np.int32))
                columns = [pa.array(c, pa.int64()) for c in np.array(pieces, np.int64).reshape(-1, 7).T]
                more = [pa.array(held, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *columns, *more], names=names)

    return docs.mapInArrow(run, ddl + ", ids array<int>" * with_ids)


def _fit_rest(capacity: int):
    """First fit, longest first, of the few pieces whose bins did not fill."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_bin", "_slot"], ascending=[False, True, True], kind="stable")
        used: list[int] = []
        bins, offsets = [], []
        for size in pdf["length"].tolist():
            b = next((i for i, u in enumerate(used) if u + size <= capacity), len(used))
            if b == len(used):
                used.append(0)
            bins.append(b)
            offsets.append(used[b])
            used[b] += size
        return pdf.assign(sequence_id=np.array(bins, np.int64) << 15, offset=np.array(offsets, np.int64))

    return run


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    capacity: int = 1024,
    least: int = 64,
    with_ids: bool = False,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack tokenised documents into sequences of at most ``capacity`` ids.

    Every document's ids, then ``end_id``, are cut into full sequences, then at most one
    half, quarter, ... down to ``least`` (powers of two, as is ``capacity``), then a tail
    shorter than that. A piece of length n falls into the class k = capacity // n, whose
    bins hold k pieces each. Classes of halved sizes fill their bins without padding; a
    bin of tails lacks less than one tail. Workers number the pieces of a class on their
    own; one small table of counts per worker and class makes the numbers run on, so that
    only the last bin of a class is not full over all workers. The last bin of a halved
    class is split into powers of two; the last bins of all tail classes, a number of
    pieces that ``least`` bounds whatever the input, are fitted together.

    One row per piece: the id, ``start`` in the document, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id`` (not consecutive), ``offset``, and ``ids`` if asked
    for. A null or empty text is its end id alone; repeated rows are packed each; other
    columns are ignored; no rows give no rows.
    """
    rows = docs.select(id_col, utf8(text_col).alias("_text"))
    pieces = materialize(_pieces(rows, path, ranks, end_id, capacity, least, with_ids), "pieces")
    counts = pieces.groupBy("_class", "_part").agg((F.max("_rank") + 1).alias("_n"))
    by_class = W.partitionBy("_class")
    so_far = by_class.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(
        "_class", "_part", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_base"), F.sum("_n").over(by_class).alias("_total")
    )
    k, g = F.abs("_class"), F.col("_base") + F.col("_rank")
    placed = (
        pieces.join(counts, ["_class", "_part"])
        .withColumn("_bin", F.expr("(_base + _rank) div abs(_class)"))
        .withColumn("_slot", g % k)
        .withColumn("_left", F.when(F.expr("_bin = _total div abs(_class)"), F.expr("_total % abs(_class)")).otherwise(0))
        .drop("_part", "_rank", "_base", "_total")
    )
    halved = F.col("length") >= least
    # The last bin of a halved class, _left pieces: split by the binary digits of _left.
    sub, base = F.lit(0), F.lit(0)
    for bit in range((capacity // least).bit_length()):
        low = F.expr(f"(_left div {2 << bit}) * {2 << bit}")
        here = F.expr(f"(_left div {1 << bit}) % 2 = 1") & (F.col("_slot") >= low) & (F.col("_slot") < low + (1 << bit))
        sub, base = F.when(here, bit + 1).otherwise(sub), F.when(here, low).otherwise(base)
    name = F.shiftleft("_bin", 15) + k * 16
    even = placed.where(halved).withColumns({"sequence_id": name + sub, "offset": (F.col("_slot") - base) * F.col("length")})
    tails = placed.where(~halved)
    in_bin = W.partitionBy("sequence_id").orderBy("_slot")
    full = (
        tails.where("_left = 0")
        .withColumn("sequence_id", name + 8)
        .withColumn("offset", F.sum("length").over(in_bin) - F.col("length"))
    )
    rest = tails.where("_left > 0").withColumn("_all", F.lit(0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", sequence_id long, offset long"
    rest = rest.groupBy("_all").applyInPandas(_fit_rest(capacity), schema)
    out = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return even.select(out).unionByName(full.select(out)).unionByName(rest.select(out))
