"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

Documents are dealt into shards; a shard holds one list per query term, sorted by impact (the term's part of a
document's score without its weight).  A query reads its lists in order, a stretch of each at a time.  Of every document
it knows a lower bound (what was read) and an upper one (that, and for every list where it was not met the list's next
impact).  It stops when each document whose upper bound reaches the k-th lower bound is known in full: then membership,
ties and scores are final.  The best of all shards are merged.

Queries are taken in blocks of bounded size; of the documents only the block's terms are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_list

TOP = 50
SHARD_BYTES = 32 << 20
#: Bytes of distinct terms of the queries of one block, which is all that is broadcast.
QUERY_BYTES = 16 << 20
#: Postings of every list that a query reads before it looks at its bounds for the first time; doubled each time.
STRETCH = 64

_FORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SHARD = "n_docs long, n_terms long, ids array<long>, sizes binary, codes binary, docs binary, counts binary"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FORM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _queries(items: DataFrame) -> DataFrame:
    """(item, terms): the distinct terms of every row of ``items`` (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in text_list(batch.column("text"))]
            size = [sum(map(len, f)) + 8 * len(f) for f in found]
            rows = [batch.column("item"), pa.array([b" ".join(f) for f in found], pa.binary()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=["item", "terms", "size"])

    return items.mapInArrow(run, f"item {items.schema['item'].dataType.simpleString()}, terms binary, size long")


def shards(docs: DataFrame, known: list[bytes], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard of ``docs`` (doc_id, text): its ids and sizes, and where and how often the ``known`` terms occur.

    ``n_docs`` counts documents with a term, ``n_terms`` all their terms.
    """
    words = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(known)})
    width = max(1, len(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = words.value.get
        ids: list[int | None] = []
        sizes: list[int] = []
        keys: list[np.ndarray] = []
        held = 0

        def full() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(keys), return_counts=True)  # by term, then by document
            size = np.array(sizes, np.int64)
            parts = (size, (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32))
            rows = [pa.array([int((size > 0).sum())]), pa.array([int(size.sum())]), pa.array([ids], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*rows, *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["n_docs", "n_terms", "ids", "sizes", "codes", "docs", "counts"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_list(batch.column("text"))):
                own = terms(text)
                codes = np.fromiter(map(get, own, repeat(width)), np.int64, len(own))
                keys.append((codes[codes < width] << 32) | len(ids))
                ids.append(doc_id)
                sizes.append(len(own))
                held += len(text) + 64
                if held >= shard_bytes:
                    yield full()
                    ids, sizes, keys, held = [], [], [], 0
        if ids:
            yield full()

    return docs.mapInArrow(run, _SHARD)


class ImpactLists:
    """The lists of one shard: per term the documents and impacts, largest impact first."""

    def __init__(self, codes: np.ndarray, docs: np.ndarray, counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int):
        tf = counts.astype(np.int64)
        m = 50 + (50 * sizes.astype(np.int64) * n_docs) // max(1, n_terms)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])
        by = np.lexsort((-impact, codes))
        self.docs, self.impact, self.size = docs[by], impact[by], len(sizes)
        self.codes, first = np.unique(codes, return_index=True)
        self.ends = np.r_[first[1:], len(codes)].astype(np.int64)
        self.firsts = first.astype(np.int64)

    def top(self, query: np.ndarray, weights: np.ndarray, k: int, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k highest scores above 0 and of all that tie with the k-th; sums stay below 2^53."""
        place = np.searchsorted(self.codes, query)
        here = (place < len(self.codes)) & (weights > 0)
        here[here] = self.codes[place[here]] == query[here]
        at, end, w = self.firsts[place[here]], self.ends[place[here]], weights[here].astype(np.int64)
        lower = np.zeros(self.size)
        read_docs, read_lists = [], []
        while True:
            to = np.minimum(at + stretch, end)
            size = to - at
            entries = np.arange(size.sum()) + np.repeat(at - np.r_[0, np.cumsum(size)[:-1]], size) if len(at) else np.zeros(0, np.int64)
            lists = np.repeat(np.arange(len(at)), size)
            lower += np.bincount(self.docs[entries], self.impact[entries] * w[lists], self.size)
            read_docs.append(self.docs[entries])
            read_lists.append(lists)
            at, stretch = to, stretch * 2
            more = at < end
            if not more.any():
                break
            ahead = np.zeros(len(at))
            ahead[more] = self.impact[at[more]] * w[more]
            met = np.bincount(np.concatenate(read_docs), ahead[np.concatenate(read_lists)], self.size)
            upper = lower + (ahead.sum() - met)
            floor = np.partition(lower, self.size - k)[self.size - k] if self.size >= k else 0.0
            if floor > 0 and not ((upper >= floor) & (upper > lower)).any():
                break
        floor = np.partition(lower, self.size - k)[self.size - k] if self.size >= k else 0.0
        best = np.flatnonzero((lower > 0) & (lower >= floor))
        return best, lower[best].astype(np.int64)


def _search(docs: DataFrame, queries: list[tuple], item_type: str, arrow_type: pa.DataType, k: int, shard_bytes: int) -> DataFrame:
    """One block of queries (item, terms) over all documents."""
    context = docs.sparkSession.sparkContext
    split = [(item, raw.split()) for item, raw in queries]
    known = sorted({t for _, found in split for t in found})
    number = {t: i for i, t in enumerate(known)}
    made = stored(shards(docs, known, shard_bytes), "impact-shards")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(known), np.int64)
        for batch in batches:
            for raw in batch.column("codes").to_pylist():
                seen += np.bincount(np.frombuffer(raw, np.int32), minlength=len(known))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["code", "df"])

    sums = made.select("codes").mapInArrow(frequencies, "code int, df long").groupBy("code").agg(F.sum("df").alias("df")).toArrow()
    row = made.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = int(row[0] or 0), int(row[1] or 0)
    weights = np.zeros(len(known), np.int64)
    for code, df in zip(sums.column("code").to_pylist(), sums.column("df").to_pylist()):
        weights[code] = weight(n_docs, df)
    asked = context.broadcast([(item, np.array([number[t] for t in found], np.int64)) for item, found in split])
    names = ["query", "item_id", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r] for c in ("ids", "sizes", "codes", "docs", "counts")}
                arrays = [np.frombuffer(one[c].as_py(), t) for c, t in (("codes", np.int32), ("docs", np.int32), ("counts", np.int32), ("sizes", np.int64))]
                lists = ImpactLists(*arrays, n_docs, n_terms)
                ids = one["ids"].values
                out: list[list] = [[], [], [], []]
                for q, (item, codes) in enumerate(asked.value):
                    best, scores = lists.top(codes, weights[codes], k)
                    near = ids.take(pa.array(best))
                    if len(best) > k:  # ties with the k-th: the smallest ids stay
                        first = np.lexsort((near.fill_null(-(1 << 63)).to_numpy(), -scores))[:k]
                        near, scores = near.take(pa.array(first)), scores[first]
                    out[0] += [q] * len(scores)
                    out[1] += [item] * len(scores)
                    out[2].append(near)
                    out[3].append(scores)
                if out[0]:
                    columns = [pa.array(out[0], pa.int32()), pa.array(out[1], arrow_type), pa.concat_arrays(out[2]), pa.array(np.concatenate(out[3]))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    found = made.mapInArrow(run, f"query int, item_id {item_type}, doc_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = TOP,
    shard_bytes: int = SHARD_BYTES,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Per row of ``items`` its ``k`` best documents with a score above 0: item_id, rank (from 1), doc_id, score.

    Ties go by ascending id (null ids first).  Texts and items that are null, empty or without a term match nothing, and
    such documents are not counted in N.  Every row of either table stands for itself, repeated ones too; other columns
    are ignored; an empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = stored(_queries(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))).filter("size > 0"), "queries")
    blocks = max(1, math.ceil((asked.agg(F.sum("size")).first()[0] or 0) / query_bytes))
    item_type = asked.schema["item"].dataType.simpleString()
    dealt = asked.select("item", "terms", F.pmod(F.xxhash64("terms"), F.lit(blocks)).alias("block"))
    parts = []
    for b in range(blocks):
        rows = dealt.filter(F.col("block") == b).select("item", "terms").toArrow()
        queries = list(zip(rows.column("item").to_pylist(), rows.column("terms").to_pylist()))
        parts.append(_search(narrow, queries, item_type, rows.column("item").type, k, shard_bytes))
    return reduce(DataFrame.unionByName, parts)
