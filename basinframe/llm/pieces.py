"""SentencePiece BPE by vectorised merge rounds over flat symbol arrays."""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basinframe.llm.common import CACHE_WORDS, per_text, utf8

SPACE = "▁"
NONE = np.int32(2**31 - 1)


class PieceModel:
    """Tables of a BPE model with byte fallback: characters, mergeable pairs, bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.begin, self.end = n, sp.bos_id(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = {p: i for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.byte_ids = np.zeros(256, np.int32)
        self.text = [b""] * n
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                value = int(p[3:5], 16)
                self.byte_ids[value] = i
                self.text[i] = bytes([value])
            elif sp.is_unknown(i):
                self.text[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.text[i] = p.replace(SPACE, " ").encode()
        self.widths = np.fromiter(map(len, self.text), np.int64, n)
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        # Rank of a piece: 0 for the best score; equal scores share a rank.
        scores = np.array([sp.get_score(i) for i in range(n)], np.float32)
        order = np.unique(-scores, return_inverse=True)[1]
        pairs = {}
        for p, i in plain.items():
            for cut in range(1, len(p)):
                a, b = plain.get(p[:cut]), plain.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        keys = np.fromiter(pairs, np.int64, len(pairs))
        at = np.argsort(keys)
        self.keys = np.append(keys[at], np.int64(2**62))
        self.made = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[at], np.int32(-1))
        self.rank = np.append(order[self.made[:-1]].astype(np.int32), NONE)
        # White space starts a word; a line feed stands alone if no longer piece has it.
        stop = "\n" if all("\n" not in p or len(p) == 1 for p in plain) else ""
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("the model has pieces that cross words")
        self.words = re.compile(rf"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + (rf"|{stop}" if stop else ""))
        self.cache: dict[str, tuple[bytes, bytes]] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the pair table; the last place means none."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges and the word of each; unknown characters are negative.

        All words lie in one flat array. A round finds the least pair rank of each word and
        merges its occurrences from the left, as the one-by-one rule would: it stops in a
        word after the first merge that brings forth a pair no worse than the one merged.
        Words without a pair leave the arrays.
        """
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.chars[code]
        sym = np.where(sym < 0, -(code + 2), sym).astype(np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        none = len(self.keys) - 1
        at = np.full(len(sym), none)
        at[:-1] = np.where(word[1:] == word[:-1], self.pair(sym[:-1], sym[1:]), none)
        done: list[tuple[np.ndarray, np.ndarray]] = [(sym[:0], word[:0])]
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(sym)))
            rank = self.rank[at]
            least = np.minimum.reduceat(rank, first)
            low = np.repeat(least, size)
            if (least == NONE).any():
                keep = low != NONE
                done.append((sym[~keep], word[~keep]))
                sym, word, at, rank, low = sym[keep], word[keep], at[keep], rank[keep], low[keep]
                if not len(sym):
                    break
            # Of overlapping hits every other one merges, from the left.
            hit = np.flatnonzero(rank == low)
            fresh = np.append(True, hit[1:] != hit[:-1] + 1)
            run = np.maximum.accumulate(np.where(fresh, hit, 0))
            take = hit[(hit - run) % 2 == 0]
            made = self.made[at[take]].astype(np.int64)
            own = word[take]
            # The pairs a merge makes: with its left neighbour as merged so far, and its right.
            joined = np.append(False, (take[1:] == take[:-1] + 2) & (own[1:] == own[:-1]))
            prev, nxt = np.maximum(take - 1, 0), np.minimum(take + 2, len(sym) - 1)
            left = np.where(joined, np.append(0, made[:-1]), sym[prev])
            on_left = np.where((take > 0) & (word[prev] == own), self.pair(left, made), none)
            on_right = np.where((take + 2 < len(sym)) & (word[nxt] == own), self.pair(made, sym[nxt]), none)
            stop = np.minimum(self.rank[on_left], self.rank[on_right]) <= low[take]
            if stop.any():
                start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                count = np.cumsum(stop) - stop
                ok = count == np.repeat(count[start], np.diff(np.append(start, len(own))))
                take, made = take[ok], made[ok]
            sym[take] = made
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            new = take - np.arange(len(take))
            sym, word, at = sym[keep], word[keep], at[keep]
            touched = np.concatenate([new, np.maximum(new - 1, 0)])
            touched = touched[touched < len(sym) - 1]
            same = word[touched] == word[touched + 1]
            at[touched] = np.where(same, self.pair(sym[touched], sym[touched + 1]), none)
            at[-1] = none
        sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in one array, and where each word's ids begin.

        A character without a piece becomes the pieces of its UTF-8 bytes.
        """
        sym, word = self.merge(words)
        unknown = np.flatnonzero(sym < 0)
        if len(unknown):
            parts = [self.byte_ids[list(chr(-s - 2).encode())] for s in sym[unknown].tolist()]
            count = np.ones(len(sym), np.int64)
            count[unknown] = [len(p) for p in parts]
            here = np.repeat(sym < 0, count)
            sym, word = np.repeat(sym, count), np.repeat(word, count)
            sym[here] = np.concatenate(parts)
        return sym.astype("<u4"), np.searchsorted(word, np.arange(len(words) + 1))

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: set[str]) -> None:
        """Encode and decode the words that are not yet known."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in words if w not in self.cache]
        ids, at = self.encode_words(new)
        raw, packed = self.raw(ids), ids.tobytes()
        ends = np.append(0, np.cumsum(self.widths[ids]))[at].tolist()
        cuts = (at * 4).tolist()
        for w, a, b, c, d in zip(new, cuts, cuts[1:], ends, ends[1:], strict=False):
            self.cache[w] = packed[a:b], raw[c:d]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text between the begin and the end id."""
        ids, _ = self.encode_words(self.split(text))
        return np.concatenate([np.array([self.begin], "<u4"), ids, np.array([self.end], "<u4")])

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.text.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: without the space put before the text; broken bytes are replaced."""
        return self.raw(ids).removeprefix(b" ").decode("utf-8", "replace")


@cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_texts(texts: list[bytes], path: str) -> list[tuple[bytes, bytes]]:
    """Ids (little-endian, 32 bits) and decoded bytes of each text."""
    model = piece_model(path)
    split = [model.split(t.decode("utf-8", "replace")) for t in texts]
    model.learn(set().union(*split))
    known = model.cache
    begin, end = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))
    out = []
    for words in split:
        both = [known[w] for w in words]
        ids = b"".join([begin, *(a for a, _ in both), end])
        out.append((ids, b"".join([b for _, b in both]).removeprefix(b" ")))
    return out


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text between begin and end ids, and the text decoded from them.

    Columns: the id, ``ids array<int>``, ``decoded string``. One row per input row; a null
    or empty text has the two outer ids and decodes to the empty text. Other columns are
    ignored. Each task encodes a distinct word once and joins the words' ids.
    """

    def run(texts):
        both = encode_texts(texts, path)
        ids = [np.frombuffer(a, "<u4").astype(np.int32) for a, _ in both]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([b.decode("utf-8", "replace") for _, b in both])]

    return per_text(docs.select(id_col, utf8(text_col).alias("_text")), run, "ids array<int>, decoded string", 1 << 20)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_documents`, with counts and digests in place of the ids and texts."""

    def run(texts):
        both = encode_texts(texts, path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [
            pa.array([len(a) // 4 for a, _ in both], pa.int64()),
            pa.array([sha(a) for a, _ in both]),
            pa.array([sha(b) for _, b in both]),
        ]

    rows = docs.select(id_col, utf8(text_col).alias("_text"))
    return per_text(rows, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
