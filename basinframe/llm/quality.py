"""Quality rules: line labels by a linear-chain conditional random field.

Lines are content or boilerplate; the share of words on content lines decides whether a
document stays. Fixed counts per document come along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.llm.common import Codes, keep_rows, per_text, utf8

FEATURES = 12
_MARKS, _UPPER, _LETTERS, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), b"0123456789"
_END = re.compile(rb"[.?!:;\"')\]]$")


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[float, ...]:
    n, size = len(words), len(line)
    count = lambda chars: size - len(line.translate(None, chars))
    letters = count(_LETTERS)
    last = words[-1]
    return (
        1.0,
        np.log1p(n) / 4,
        min(count(_MARKS) / n, 3.0),
        min(line.count(b"!") / n, 3.0),
        count(_UPPER) / letters if letters else 0.0,
        count(_DIGITS) / size,
        len(set(words)) / n,
        float(seen),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        min(sum(map(len, words)) / n / 10, 3.0),
        float(bool(_END.search(last))),
        float(words[0][:1].isupper()),
    )


def lines_of(text: bytes) -> tuple[list[tuple[float, ...]], list[int], int]:
    """Features and words of each line that has a word; how many equal an earlier one."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            rows.append(line_features(line, words, line in seen))
            sizes.append(len(words))
            seen.add(line)
    return rows, sizes, len(rows) - len(seen)


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    codes = Codes()
    c = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    pair = np.unique(c[:-1] * len(codes) + c[1:], return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * len(codes) + c[2:], return_inverse=True, return_counts=True)
    hit = times[which] > 1
    cover = np.zeros(len(words), bool)
    for shift in range(3):
        cover[shift : shift + len(hit)] |= hit
    return int(cover.sum())


@dataclass(frozen=True)
class LineModel:
    """Weights for 'content' per feature; scores of passing from label to label."""

    weights: np.ndarray
    step: np.ndarray  # (2, 2): from, to; label 1 is content

    def label(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Viterbi labels of the lines of many documents; ``sizes`` are lines per document."""
        labels = np.ones(len(x), np.int8)
        order = np.argsort(-sizes, kind="stable")
        size, first = sizes[order], (np.cumsum(sizes) - sizes)[order]
        score = x @ self.weights
        best = np.zeros((len(sizes), 2))
        back = np.zeros((len(x), 2), np.int8)
        longest = int(size[0]) if len(size) else 0
        for t in range(longest):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = first[:live] + t
            if t:
                paths = best[:live, :, None] + self.step
                back[at] = paths.argmax(1)
                best[:live] = paths.max(1)
            best[:live, 1] += score[at]
        now = best.argmax(1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = first[:live] + t
            labels[at] = now[:live]
            now[:live] = back[at, now[:live]]
        return labels


def _gradient(model: LineModel, x, sizes, y):
    """Gradient of the log likelihood of the labels, by the forward and backward sums."""
    order = np.argsort(-sizes, kind="stable")
    size, first = sizes[order], (np.cumsum(sizes) - sizes)[order]
    emit = np.zeros((len(x), 2))
    emit[:, 1] = x @ model.weights
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    longest = int(size[0])
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]
    for t in range(longest):
        at = first[: live[t]] + t
        if t:
            ahead[at] = np.logaddexp.reduce(ahead[at - 1][:, :, None] + model.step, axis=1)
        ahead[at] += emit[at]
    for t in range(longest - 2, -1, -1):
        at = first[: live[t + 1]] + t
        behind[at] = np.logaddexp.reduce((emit + behind)[at + 1][:, None, :] + model.step, axis=2)
    total = np.logaddexp.reduce(ahead + behind, axis=1)
    inside = np.exp(ahead + behind - total[:, None])
    weights = x.T @ (y - inside[:, 1])
    starts = np.zeros(len(x), bool)
    starts[first] = True
    here = np.flatnonzero(~starts)
    joint = ahead[here - 1][:, :, None] + model.step + (emit + behind)[here][:, None, :] - total[here][:, None, None]
    step = -np.exp(joint).sum(0)
    np.add.at(step, (y[here - 1].astype(int), y[here].astype(int)), 1)
    return weights / len(x), step / len(x)


def fit_line_model(x: np.ndarray, sizes: np.ndarray, good: np.ndarray, rounds: int = 200) -> LineModel:
    """Fit to lines of labelled documents.

    All lines of good documents are content. Which lines of the others are boilerplate is
    not given: first all, and after a fit without transitions those it holds for boilerplate.
    """
    truth = np.repeat(good.astype(float), sizes)
    weights = np.zeros(x.shape[1])
    alone = np.ones(len(x), np.int64)
    for part_sizes, y in ((alone, truth), (sizes, None)):
        if y is None:
            y = np.where((truth == 0) & (x @ weights < 0), 0.0, 1.0)
            if y.all():
                y = truth
        model = LineModel(weights, np.zeros((2, 2)))
        moment = [np.zeros_like(weights), np.zeros((2, 2))]
        square = [np.zeros_like(weights), np.zeros((2, 2))]
        values = [model.weights.copy(), model.step.copy()]
        for n in range(1, rounds + 1):
            found = _gradient(LineModel(*values), x, part_sizes, y)
            for i, (v, g) in enumerate(zip(values, found, strict=True)):
                g = g - 1e-3 * v
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                values[i] = v + 0.1 * (moment[i] / (1 - 0.9**n)) / (np.sqrt(square[i] / (1 - 0.99**n)) + 1e-8)
        weights = values[0]
    return LineModel(*values)


def train_line_model(
    docs: DataFrame,
    labels: DataFrame,
    max_docs: int = 3000,
    max_lines: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> LineModel | None:
    """Fit on at most ``max_docs`` labelled documents (those with the least hash of their
    id) and at most ``max_lines`` lines of each; None if one of the classes is missing."""
    some = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("_good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("_text"))
    rows = texts.join(some, "doc_id").dropDuplicates(["doc_id"]).select(F.struct("doc_id", "_good").alias("_key"), "_text")

    def run(batch):
        found = [lines_of(t)[0][:max_lines] for t in batch]
        return [pa.array([[v for row in rows for v in row] for rows in found], pa.list_(pa.float64()))]

    sample = sorted(per_text(rows, run, "x array<double>").collect(), key=lambda r: r["_key"]["doc_id"])
    sample = [r for r in sample if r["x"]]
    good = np.array([r["_key"]["_good"] for r in sample])
    if len(set(good.tolist())) < 2:
        return None
    xs = [np.array(r["x"]).reshape(-1, FEATURES) for r in sample]
    return fit_line_model(np.concatenate(xs), np.array([len(x) for x in xs]), good)


def _counts(texts: list[bytes], model: LineModel | None, min_words: int, least_content: float) -> list[np.ndarray]:
    """Per text: words, their characters, marks, repeated lines, repeated words, failed, content words, kept."""
    found = [lines_of(t) for t in texts]
    sizes = np.array([len(rows) for rows, _, _ in found], np.int64)
    words = np.array([w for _, n, _ in found for w in n], np.int64)
    if model is None or not sizes.sum():
        content = np.ones(len(words), np.int64)
    else:
        content = model.label(np.array([r for rows, _, _ in found for r in rows]), sizes).astype(np.int64)
    ends = np.append(0, np.cumsum(sizes))
    n_words, n_content = (np.diff(np.append(0, np.cumsum(v))[ends]) for v in (words, words * content))
    split = [t.split() for t in texts]
    chars = np.array([len(b"".join(w).decode("utf-8", "replace")) for w in split], np.int64)
    marks = np.array([len(t) - len(t.translate(None, _MARKS)) for t in texts], np.int64)
    again = np.array([d for _, _, d in found], np.int64)
    repeat = np.array([repeated_words(w) for w in split], np.int64)
    failed = (n_words < min_words) | (100 * repeat > 50 * n_words)
    kept = ~failed & (n_content >= least_content * n_words)
    return [n_words, chars, marks, again, repeat, failed, n_content, kept]


def keep_good(
    docs: DataFrame, model: LineModel | None, min_words: int = 50, least_content: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """Whole rows of the documents that :func:`quality_rules` keeps."""
    return keep_rows(docs, text_col, lambda texts: _counts(texts, model, min_words, least_content)[-1])


def quality_rules(
    docs: DataFrame,
    model: LineModel | None,
    min_words: int = 50,
    least_content: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts of every whole text, the fixed rules, and the verdict of the line labels.

    Per input row: the id, ``n_words`` (runs of characters other than ASCII white space),
    ``word_chars`` (their code points), ``n_symbols`` (characters of ``#*$%&|<>``),
    ``n_dup_lines`` (lines with a word that equal an earlier line), ``n_repeat_words`` (words
    in three-word windows found twice or more), ``base_failed`` (fewer than ``min_words``
    words, or over half of them repeated), ``content_words`` (words on lines labelled
    content), ``kept``: not failed and at least ``least_content`` of the words content.
    Without a model all lines are content. A null text is an empty one and fails; repeated
    rows repeat; other columns are ignored. No shuffle.
    """

    def run(texts):
        return [pa.array(v) for v in _counts(texts, model, min_words, least_content)]

    ddl = (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, content_words bigint, kept boolean"
    )
    return per_text(docs.select(id_col, utf8(text_col).alias("_text")), run, ddl)
