"""Operators that look at one text at a time, against the libraries and plain counts."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from basinframe.llm import packing, pieces, quality, tokens

PIECES, BYTES, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def odd_texts(rng):
    texts = ["", " ", "  a  b\n\x00", "é𝛀 ▁x▁▁ y z   \n\n  w", "a" * 3000, " " * 999, "ab" * 2000, "ñ" * 500]
    texts += ["<s></s><unk> <0x0A> x<|endoftext|>y <|startoftext|>", "Ünïcödé́ İ I'll they're '́ ΑΣΑΣ 　x"]
    for letters in ("ab  \nthe▁éx.　'", ["the", "in", "an", "t", "h", "e", "er", "tion", " "]):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    return texts


def test_pieces_equal_the_library(rng):
    library, texts = SentencePieceProcessor(model_file=PIECES), odd_texts(rng)
    model = pieces.piece_model(PIECES)
    for text, (ids, decoded) in zip(texts, pieces.encode_texts([t.encode() for t in texts], PIECES), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == library.decode(want)
        assert model.encode(text).tolist() == want and model.decode(np.array(want)) == library.decode(want)


@pytest.mark.parametrize("frequent", [0, 5, 1 << 16])
def test_token_counts_equal_the_library(spark, rng, frequent):
    """The share of pre-tokens joined inside the tasks, none to all, changes no count."""
    library, texts = Tokenizer.from_file(WORDS), odd_texts(rng)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, f string").repartition(5)
    out = tokens.token_counts(docs, WORDS, id_col="k", text_col="f", frequent=frequent).collect()
    assert {int(r["k"]): r["n_tokens"] for r in out} == dict(enumerate(want)) and len(out) == len(want)


def test_pretoken_table_counts_each_once(spark, monkeypatch):
    """One row per distinct pre-token of all tasks; long ones stay apart under their digest."""
    monkeypatch.setattr(tokens, "_HELD", 2)
    long = ["http://example.org/" + "x" * 40 + tail for tail in "ab"]
    texts = [f"the cat the {long[0]}", f"{long[1]} dog cat", "the", "", f"{long[0]}"]
    rows = spark.createDataFrame([(t.encode(),) for t in texts], "t binary").repartition(3)
    want = Counter(w for t in texts for w in t.encode().split())
    got = {bytes(r["k"]): (r["f"], r["pieces"]) for r in tokens.pretoken_table(rows, WORDS).collect()}
    pieces = dict(zip(want, tokens.count_pieces(list(want), WORDS), strict=True))
    assert got == {tokens.join_key(w): (n, pieces[w]) for w, n in want.items()}
    assert tokens.pretoken_table(rows.where("false"), WORDS).count() == 0


def test_byte_pairs_equal_the_library(rng):
    library, texts = Tokenizer.from_file(BYTES), odd_texts(rng)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    for ranks in (RANKS, None):
        packing._IDS.clear()
        assert packing.encode_texts([t.encode() for t in texts], BYTES, ranks) == want


def test_encoding_of_odd_rows(odd_docs, odd_rows, no_docs):
    library = SentencePieceProcessor(model_file=PIECES)
    got = Counter(tuple(r) for r in pieces.encode_digests(odd_docs, PIECES).collect())
    want = Counter()
    for i, text, *_ in odd_rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())] += 1
    assert got == want
    assert pieces.encode_documents(odd_docs, PIECES).where("doc_id = 3").first()["decoded"] == "a"
    assert pieces.encode_digests(no_docs, PIECES).count() == 0


def test_counts_of_odd_rows(odd_docs, odd_rows, no_docs):
    library = Tokenizer.from_file(WORDS)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = Counter(tuple(r) for r in tokens.token_counts(odd_docs, WORDS).collect())
    assert got == Counter((i, len((t or "").encode()), n(t), n(t) > 2048) for i, t, *_ in odd_rows)
    assert tokens.token_counts(no_docs, WORDS).count() == 0


def test_packing_covers_every_id_once(spark, odd_docs, odd_rows, no_docs, sf):
    library = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for table in (odd_docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]), docs):
        rows = packing.pack(table, BYTES, ranks=RANKS, with_ids=True).toPandas()
        for doc in table.collect():
            ids = np.array(library.encode(doc["text"] or "", add_special_tokens=False).ids + [0], "<u4")
            at = 0
            for p in rows[rows.doc_id == doc["doc_id"]].sort_values("start").itertuples():
                own = ids[at : at + p.length]
                assert (p.start, p.doc_tokens) == (at, len(ids)) and zlib.crc32(own.tobytes()) == p.ids_crc32
                assert list(p.ids) == own.tolist()
                at += p.length
            assert at == len(ids)
        rows = rows.sort_values(["sequence_id", "offset"])
        own = rows.groupby("sequence_id").length
        assert (rows.offset == own.cumsum() - rows.length).all() and own.sum().max() <= 1024
    total = own.sum()
    padded = total[np.log2(total) % 1 != 0]
    assert (1024 - padded).sum() < 0.01 * total.sum()
    assert packing.pack(odd_docs, BYTES).count() > len(odd_rows) - 1
    assert packing.pack(no_docs, BYTES).count() == 0


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    marks = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), marks, len(lines) - len(set(lines)), len(hit), failed


def test_quality_rules(odd_docs, odd_rows, no_docs):
    out = quality.quality_rules(odd_docs, None).collect()
    assert Counter(tuple(r)[:7] for r in out) == Counter((i, *plain_rules(t or "")) for i, t, *_ in odd_rows)
    assert all(r["kept"] != r["base_failed"] for r in out)
    kept = quality.keep_good(odd_docs, None)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in out)
    assert quality.quality_rules(no_docs, None).count() == 0


def test_line_labels_are_the_best_sequence(rng):
    model = quality.LineModel(np.array([1.0, -2.0]), np.array([[0.3, -0.4], [-0.6, 0.5]]))
    sizes = np.array([3, 0, 5, 1])
    x = np.array([[rng.random(), rng.random()] for _ in range(9)])
    got, at = model.label(x, sizes), 0
    for n in sizes.tolist():
        score = x[at : at + n] @ model.weights
        options = [[int(b) for b in np.binary_repr(k, n)] for k in range(2**n)] if n else [[]]
        value = lambda y: sum(s * v for s, v in zip(score, y)) + sum(model.step[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert got[at : at + n].tolist() == max(options, key=value)
        at += n


def test_line_model_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train_line_model(docs, labels, max_docs=200)
    assert quality.train_line_model(docs, labels.where("quality = 1")) is None
    seen = labels.groupBy("doc_id").count().orderBy("doc_id").count()
    out = quality.quality_rules(docs, model).join(labels, "doc_id").where("not base_failed").toPandas()
    assert seen > 200
    assert out[out.quality == 1].kept.mean() > 0.98 and out[out.quality == 0].kept.mean() < 0.4


def test_token_counts_of_bytes_that_are_not_utf8(spark):
    raw = [b"caf\xe9 \xf0\x9f \xff\xff x", "whole é words".encode(), b"\x80"]
    table = spark.createDataFrame([*enumerate(raw)], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw AS string) AS text")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(table, WORDS).collect()}
    library = Tokenizer.from_file(WORDS)
    want = [len(library.encode(b.decode(errors="replace"), add_special_tokens=False).ids) for b in raw]
    assert got == {i: (len(b), n) for i, (b, n) in enumerate(zip(raw, want, strict=True))}
