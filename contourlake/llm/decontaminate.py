"""Benchmark decontamination: an FM-index per shard of training text answers every benchmark phrase.

Documents are cut into words of ``[0-9a-z]`` and non-ASCII characters (A-Z lower-cased).  A shard is a stretch of a
partition's documents of about ``shard_words`` words.  Words that no benchmark phrase holds cannot be part of a match,
so they end runs; runs shorter than the shortest phrase cannot hold one and are not indexed.  All phrases are searched
backward at once through the wavelet ranks of the shard's Burrows-Wheeler transform; occurrences are located by
sampled suffix positions and merged into spans of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, text_list
from .fmindex import FmIndex

WINDOW = 10
SHARD_WORDS = 400_000
BLOCK_BYTES = 32 << 20

_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Phrases:
    """The windows of a block of items: distinct rows of word numbers (1..), and which items have each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                rows.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.items = [sorted(s) for s in rows.values()]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int64)
        for k, r in enumerate(rows):
            self.rows[k, window - len(r) :] = r
        self.shortest = int(self.lengths.min()) if len(rows) else 0

    def find(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word in the shard) of every occurrence; no phrase crosses a document's end."""
        none = np.zeros(0, np.int64)
        if not self.shortest:
            return none, none
        get = self.vocab.get
        flat = [x for d in docs for x in (*d, None)]
        symbols = np.fromiter((get(w, 0) for w in flat), np.int64, len(flat))
        ends = np.flatnonzero(symbols == 0)
        sizes = np.diff(np.concatenate([[-1], ends]))
        keep = np.repeat(sizes > self.shortest, sizes)
        place = np.flatnonzero(keep)
        if not len(place):
            return none, none
        index = FmIndex(symbols[place], len(self.vocab))
        low, high = index.search(self.rows, self.lengths)
        count = high - low
        hit = np.flatnonzero(count > 0)
        if not len(hit):
            return none, none
        phrase = np.repeat(hit, count[hit])
        offset = np.arange(len(phrase)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
        return phrase, place[index.locate(np.repeat(low[hit], count[hit]) + offset)]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges as maximal ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size, streamed to the driver one partition at a time; null texts have no words."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    blocks, size = [[]], 0
    for r in rows.toLocalIterator():
        body = r["t"].encode()
        if size + len(body) > block_bytes and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r["i"] if r["i"] is not None else "", body))
        size += len(body)
    return blocks


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with three columns appended: _words (count), _spans (merged ranges of hit words), _items (ids).

    The benchmark is broadcast in blocks of at most ``block_bytes`` of text, whatever its size: each block is one more
    narrow pass over the documents (no shuffle, no join).  Every other column of ``docs`` is kept as it is.
    """
    spark = docs.sparkSession
    out = T.StructType(
        docs.schema.fields + T.StructType.fromDDL("_words bigint, _spans array<struct<a:bigint,b:bigint>>, _items array<string>").fields
    )
    df = docs.withColumns(
        {
            "_words": F.lit(None).cast("long"),
            "_spans": F.lit(None).cast("array<struct<a:bigint,b:bigint>>"),
            "_items": F.lit(None).cast("array<string>"),
        }
    )
    span_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def finder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(shared.value, window)
            for part in pieces(batches, text_col, shard_words * 6):
                docs_words = [words(t) for t in text_list(part.column(text_col))]
                sizes = np.array([len(d) for d in docs_words], np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes + 1)])
                phrase, at = phrases.find(docs_words)
                old = part.column("_spans").to_pylist()
                spans = [[(s["a"], s["b"]) for s in x or ()] for x in old]
                items = [set(x or ()) for x in part.column("_items").to_pylist()]
                doc = np.searchsorted(starts, at, side="right") - 1
                for d, a, p in zip(doc.tolist(), (at - starts[doc]).tolist(), phrase.tolist()):
                    spans[d].append((a, a + int(phrases.lengths[p])))
                    items[d].update(phrases.items[p])
                merged = [[{"a": a, "b": b} for a, b in merge_spans(s)] for s in spans]
                columns = [part.column(i) for i in range(part.num_columns - 3)]
                columns += [pa.array(sizes), pa.array(merged, span_type), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

        return run

    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        df = df.mapInArrow(finder(spark.sparkContext.broadcast(block)), out)
    return df


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and is clean; so is every text if the benchmark is empty.  Item ids count as
    strings (null: the empty string), repeated items once.  Repeated and null document ids give one row each; other
    columns are ignored.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = find_hits(narrow, benchmark, "text", **options)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def strip_hits(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Remove merged word spans; what stood around a span is joined by one space."""
    if not spans:
        return text
    clean = text.translate(_WORD)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.frombuffer(clean, np.uint8) != 32).astype(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : int(first[a])].rstrip(b" "))
        at = int(last[b - 1])
    kept.append(text[at:])
    return b" ".join(kept)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with hit spans cut out of the text; rows without a hit stay as they are, and no row is dropped.

    ``length_col``, where the table has it, is set to the new number of characters of changed texts.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            spans = part.column("_spans").to_pylist()
            texts = part.column(text_col).to_pylist()
            lengths = part.column(length_col).to_pylist() if length_col in names else None
            for i, s in enumerate(spans):
                if s:
                    texts[i] = strip_hits(texts[i].encode(), [(x["a"], x["b"]) for x in s]).decode()
                    if lengths is not None:
                        lengths[i] = len(texts[i])
            columns = []
            for name in names:
                old = part.column(name)
                columns.append(pa.array(texts, old.type) if name == text_col else pa.array(lengths, old.type) if name == length_col and lengths is not None else old)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return find_hits(docs, benchmark, text_col, **options).mapInArrow(run, schema)
