"""Quality rules with line labels: a linear-chain conditional random field marks content and boilerplate lines.

Every line with a word is a position of the chain, described by a few numbers.  Weights are trained here on a bounded
sample of documents with a quality label, whose lines all carry the document's label.  Viterbi decoding labels the lines
of every document; the share of word characters in content lines decides whether it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MIN_SHARE = 0.5
#: Bound of the training sample (documents per label), and lines of one of a document's chains.
TRAIN_DOCS, TRAIN_LINES = 1500, 64
FEATURES = 12

_ENDS = frozenset(b".,;:!?\"')")
_LOUD = frozenset(b"!?*#&$%|<>")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    return analyse(text)[0]


def line_features(text: str) -> tuple[list[list[float]], list[int]]:
    """One row of numbers and the word bytes of every line that has a word."""
    return analyse(text)[1:]


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, each counted once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    mark = bytearray(len(words))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            mark[j : j + 3] = mark[i : i + 3] = b"\1\1\1"
    return sum(mark)


def analyse(text: str) -> tuple[tuple[int, int, int, int, int], list[list[float]], list[int]]:
    """Base counts, line features and line sizes.  ``bytes.split`` cuts at exactly the six blanks of the word rule."""
    raw = text.encode()
    rows, sizes, every = [], [], []
    seen: set[bytes] = set()
    dup = symbols = 0
    for line in raw.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), sum(map(len, words))
        odd = len(line) - len(line.translate(None, SYMBOLS))
        again = line in seen
        seen.add(line)
        every += words
        dup += again
        symbols += odd
        sizes.append(size)
        rows.append(
            [
                1.0,
                min(n, 60) / 20.0,
                n < 6,
                odd / size,
                odd > 0.05 * size,
                sum(map(bytes.isupper, words)) / n,
                sum([w[-1] in _LOUD for w in words]) / n,
                sum(map(bytes.__eq__, words, words[1:])) / n,
                1.0 - len(set(words)) / n if n > 8 else 0.0,
                again,
                words[-1][-1] in _ENDS,
                words,
            ]
        )
    repeated = _repeated(every)
    for row in rows:
        row[-1] = _repeated(row[-1]) / len(row[-1]) if repeated else 0.0
    total = sum(sizes)
    return (len(every), len(text) - (len(raw) - total), symbols, dup, repeated), rows, sizes


@dataclass(frozen=True)
class Crf:
    """Scores of label 1 (content) against 0 (boilerplate) per line, and of label pairs."""

    weights: np.ndarray
    pairs: np.ndarray

    def viterbi(self, rows: list[list[float]]) -> list[int]:
        """The best label sequence of one document; content wins ties."""
        if not rows:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        emit = (np.asarray(rows, float) @ self.weights).tolist()
        bad, good, back = 0.0, emit[0], []
        for e in emit[1:]:
            to_bad, to_good = p10 + good >= p00 + bad, p11 + good >= p01 + bad
            bad, good = (p10 + good if to_bad else p00 + bad), e + (p11 + good if to_good else p01 + bad)
            back.append((to_bad, to_good))
        label = int(good >= bad)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(features: list[np.ndarray], labels: list[int], steps: int = 200, rate: float = 0.1, penalty: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by forward-backward gradients (Adam), all chains at once.

    Without documents of both labels every line is content.
    """
    width = FEATURES
    if not features or len(set(labels)) < 2:
        return Crf(np.eye(1, width)[0], np.zeros((2, 2)))
    n, longest = len(features), max(map(len, features))
    x = np.zeros((n, longest, width))
    on = np.zeros((n, longest))
    for i, f in enumerate(features):
        x[i, : len(f)] = f
        on[i, : len(f)] = 1
    y = np.asarray(labels)
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, pairs = theta[:width], theta[width:].reshape(2, 2)
        emit = np.stack([np.zeros((n, longest)), x @ w], axis=2)
        ahead, after = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0]
        for k in range(1, longest):
            step = np.logaddexp(ahead[:, k - 1, :1] + pairs[0], ahead[:, k - 1, 1:] + pairs[1]) + emit[:, k]
            ahead[:, k] = np.where(on[:, k, None] > 0, step, ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            nxt = emit[:, k + 1] + after[:, k + 1]
            step = np.logaddexp(pairs[:, 0] + nxt[:, :1], pairs[:, 1] + nxt[:, 1:])
            after[:, k] = np.where(on[:, k + 1, None] > 0, step, 0.0)
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        content = np.exp(ahead[:, :, 1] + after[:, :, 1] - z[:, None]) * on
        gain = np.einsum("nkf,nk->f", x, (y[:, None] * on - content) * (balance / on.sum(1))[:, None])
        linked = on[:, 1:] * (balance / on.sum(1))[:, None]
        both = ahead[:, :-1, :, None] + pairs + (emit + after)[:, 1:, None, :] - z[:, None, None, None]
        expected = np.einsum("nkab,nk->ab", np.exp(np.minimum(both, 0.0)), linked)
        observed = np.zeros((2, 2))
        for c in (0, 1):
            observed[c, c] = linked[y == c].sum()
        grad = np.concatenate([gain, (observed - expected).ravel()]) - penalty * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Crf(theta[:width], theta[width:].reshape(2, 2))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    per_label: int = TRAIN_DOCS,
) -> Crf:
    """Train on at most ``per_label`` documents of each label (smallest id hash first).

    Whole texts are used: a document gives one chain for every ``TRAIN_LINES`` lines.  Of several rows of a drawn id that
    of the smallest text hash counts.  These bounds concern training only.  Labels other than 0
    and 1, null texts and labels without a document are left out.
    """
    known = labels.select(F.col("doc_id").alias("_label_id"), F.col("quality").alias("_quality")).filter("_quality in (0, 1)")
    parts = []
    for value in (0, 1):
        # the sample is drawn from ids alone; texts are read for the drawn ids only
        parts.append(known.filter(F.col("_quality") == value).orderBy(F.xxhash64("_label_id"), "_label_id").limit(per_label))
    drawn = parts[0].union(parts[1])
    texts = docs.select(F.col(id_col).alias("_label_id"), F.col(text_col).alias("text")).filter("text is not null")
    named = texts.join(F.broadcast(drawn.dropDuplicates(["_label_id"])), "_label_id").withColumn("_name", F.struct(F.xxhash64("text"), F.octet_length("text")))
    once = named.groupBy("_label_id").agg(F.min("_name").alias("_name"))
    rows = named.join(F.broadcast(once), ["_label_id", "_name"]).dropDuplicates(["_label_id"]).select("_label_id", "text", "_quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [line_features(t)[0] for t in part.column("text").to_pylist()]
            flat = [[float(v) for r in rows for v in r] for rows in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("_label_id"), part.column("_quality"), pa.array(flat, pa.list_(pa.float64()))],
                names=["id", "quality", "flat"],
            )

    sample = rows.mapInArrow(run, "id bigint, quality int, flat array<double>").filter(F.size("flat") > 0)
    taken = sorted(((r["id"], r["quality"], r["flat"]) for r in sample.collect()), key=lambda r: (r[0], r[2]))
    whole = [(np.array(r[2]).reshape(-1, FEATURES), r[1]) for r in taken]
    chains = [(rows[i : i + TRAIN_LINES], label) for rows, label in whole for i in range(0, len(rows), TRAIN_LINES)]
    return train([c for c, _ in chains], [label for _, label in chains])


_COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_ADDED = pa.schema(
    [(f"_{n}", pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("_content_share", pa.float64())]
)


def judged(docs: DataFrame, model: Crf, text_col: str = "text", min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _content_share, _base_failed, _kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text_col, 4 << 20):
            columns: list[list] = [[] for _ in _ADDED]
            for text in part.column(text_col).to_pylist():
                text = text or ""
                counts, rows, sizes = analyse(text)
                good = sum(s for s, y in zip(sizes, model.viterbi(rows)) if y)
                share = good / sum(sizes) if sizes else 0.0
                for c, v in zip(columns, (*counts, share)):
                    c.append(v)
            added = [pa.array(c, f.type) for c, f in zip(columns, _ADDED)]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *_ADDED.names])

    fields = T.StructType.fromDDL(", ".join("_" + c.strip() for c in _COUNTS.split(",")) + ", _content_share double").fields
    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
    failed = (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))
    return out.withColumn("_base_failed", failed).withColumn("_kept", ~failed & (F.col("_content_share") >= min_share))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, kept, content_share.

    A null, empty or blank text has no words: its counts are 0, it fails the base rule and is not kept.  Null and
    repeated ids and repeated rows give one row each; other columns are ignored; an empty table gives no rows.  Without
    labels of both kinds every line is content, so the base rule alone decides.
    """
    model = fit(docs, labels, text_col, id_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = judged(narrow, model, "text", **options)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    return out.select("doc_id", *[F.col(f"_{n}").alias(n) for n in names])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    model = fit(docs, labels, text_col, id_col)
    return judged(docs, model, text_col, **options).filter("_kept").select(*docs.columns)
