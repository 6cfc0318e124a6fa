"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are whole words and word beginnings (four and five characters, so that unseen endings still match): every term of
the bounded labelled examples, however rare.  Inverse document frequencies count all documents; a factor that is never 0
raises terms by how strongly they go with a label.  Terms that no example has meet nothing and are outside the space.
Every document's nearest examples vote with weights that fall with distance; isotonic calibration on leave-one-out votes
of the examples turns the vote into a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, text_list

FOLDS = 5
#: The bounded labelled sample: rows by smallest id hash.
TRAIN_ROWS = 20_000
#: Weight of a term that leans to no label, and pseudo-rows at the labels' own ratio.
NEUTRAL, SHRINK = 0.05, 1.0
NEIGHBOURS = 15
BLOCK = 16
EVIDENCE = 5

_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _of_word(word: bytes) -> list[bytes]:
    """The word and its beginnings of four and five characters, marked by a trailing ``*``."""
    if word.isascii():
        return [word] if len(word) < 4 else [word, word + b"*"] if len(word) == 4 else [word, word[:4] + b"*", word[:5] + b"*"]
    start = word.decode("utf-8", "ignore") if len(word) >= 4 else ""
    return [word, *(start[:k].encode() + b"*" for k in (4, 5) if len(start) >= k)]


def terms(text: bytes) -> Counter:
    """Counts of words and of four- and five-character word beginnings (marked by a trailing ``*``)."""
    out: Counter = Counter()
    for word, n in Counter(text.translate(_WORD).split()).items():
        for t in _of_word(word):
            out[t] += n
    return out


class Vocabulary:
    """Fast counts of known terms in a text: the term numbers of each word seen are kept in a table."""

    KEPT = 300_000

    def __init__(self, known: list[bytes]):
        self.number = {t: i for i, t in enumerate(known)}
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1024, 3), np.int32)

    def __getstate__(self) -> bytes:
        return zlib.compress(b" ".join(self.number), 1)

    def __setstate__(self, state: bytes) -> None:
        self.__init__(zlib.decompress(state).split())

    def count(self, text: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
        """Numbers (ascending) and counts of the known terms, and whether the text has no word at all."""
        words = Counter(text.translate(_WORD).split())
        if len(self.row) > self.KEPT:
            self.row.clear()
        rows = list(map(self.row.get, words))
        if None in rows:
            fresh = [w for w, row in zip(words, rows) if row is None]
            get, found = self.number.get, []
            for w in fresh:
                of = [get(t, -1) for t in _of_word(w)]
                found += of if len(of) == 3 else (of + [-1, -1])[:3]
            k = len(self.row)
            while k + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k : k + len(fresh)] = np.array(found, np.int32).reshape(-1, 3)
            self.row.update(zip(fresh, range(k, k + len(fresh))))
            numbers = iter(range(k, k + len(fresh)))
            rows = [next(numbers) if row is None else row for row in rows]
        ids = self.table[np.array(rows, np.int64)].ravel()
        n = np.repeat(np.fromiter(words.values(), np.int64, len(words)), 3)
        both = np.sort((ids.astype(np.int64) << 32 | n)[ids >= 0])
        if not len(both):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), not words
        ids = (both >> 32).astype(np.int32)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return ids[first], np.add.reduceat(both & 0xFFFFFFFF, first).astype(np.int32), not words


def packed(ids: np.ndarray, counts: np.ndarray, blank: bool) -> bytes:
    """Ascending term numbers by their steps, counts and the mark of a text without words, in the least types."""
    steps = np.diff(ids, prepend=np.int32(0))
    steps = steps.astype(np.uint16 if steps.max(initial=0) < 1 << 16 else np.int32)
    counts = counts.astype(np.min_scalar_type(counts.max(initial=0)))
    return bytes([steps.itemsize, counts.itemsize, blank]) + steps.tobytes() + counts.tobytes()


def unpacked(row: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
    a, b, blank = row[:3]
    n = (len(row) - 3) // (a + b)
    steps, counts = np.frombuffer(row, f"u{a}", n, 3), np.frombuffer(row, f"u{b}", n, 3 + n * a)
    return np.cumsum(steps, dtype=np.int32), counts.astype(np.int32), bool(blank)


def all_terms(sample: DataFrame) -> list[bytes]:
    """Every term of the texts of the labelled sample, those in most texts first: what is read together lies together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

        for part in pieces(batches, "text", 4 << 20):
            for text in text_list(part.column("text")):
                found.update({t for word in set(text.translate(_WORD).split()) for t in _of_word(word)})
            if len(found) > 200_000:
                yield made()
                found = Counter()
        yield made()

    rows = sample.mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    return rows.sort_by([("n", "descending"), ("term", "ascending")]).column("term").to_pylist()


@dataclass
class Hit:
    similarity: float
    example: int


Vector = tuple[np.ndarray, np.ndarray]


def _vector(v: dict[int, float] | Vector) -> Vector:
    return v if isinstance(v, tuple) else (np.array(sorted(v), np.int32), np.array([v[t] for t in sorted(v)], float))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) if len(size) else np.zeros(0, np.int64)


@dataclass
class Flat:
    """Vectors one after another, ``start`` to ``start``: an entry weighs ``level[value] * weight[id]`` by the vector's norm.

    Without ``level`` the values are the weights of unit vectors.
    """

    start: np.ndarray
    ids: np.ndarray
    values: np.ndarray
    level: np.ndarray | None = None
    weight: np.ndarray | None = None

    STRETCH = 1024

    @classmethod
    def of(cls, vectors: Iterable[dict[int, float] | Vector]) -> Flat:
        rows = [_vector(v) for v in vectors]
        start = np.r_[0, np.cumsum([len(t) for t, _ in rows])].astype(np.int64)
        return cls(start, np.concatenate([np.zeros(0, np.int32), *(t for t, _ in rows)]), np.concatenate([np.zeros(0), *(w for _, w in rows)]))

    def __len__(self) -> int:
        return len(self.start) - 1

    def _stretch(self, low: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        high = min(low + self.STRETCH, len(self))
        a, b = self.start[low], self.start[high]
        owner = np.repeat(np.arange(high - low), np.diff(self.start[low : high + 1]))
        ids, values = self.ids[a:b], self.values[a:b]
        return high, owner, ids, values if self.level is None else self.level[values] * self.weight[ids]

    @cached_property
    def norm(self) -> np.ndarray:
        if self.level is None:
            return np.ones(len(self))
        squares = [np.zeros(0)]
        for low in range(0, len(self), self.STRETCH):
            high, owner, _, w = self._stretch(low)
            squares.append(np.bincount(owner, w * w, minlength=high - low))
        norm = np.sqrt(np.concatenate(squares))
        return np.where(norm > 0, norm, 1.0)

    def stretches(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """The vectors, ``STRETCH`` at a time: first and last number, and number from there, term and weight of every entry."""
        for low in range(0, len(self), self.STRETCH):
            high, owner, ids, w = self._stretch(low)
            yield low, high, owner, ids, w / self.norm[low:high][owner]

    def cosines(self, query: np.ndarray, t: np.ndarray, w: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """With some of the vectors; ``query`` holds zeros for all terms, before and after."""
        query[t] = w if self.level is None else w * self.weight[t]
        out = np.zeros(len(numbers))
        for i, (a, b) in enumerate(zip(self.start[numbers].tolist(), self.start[numbers + 1].tolist())):
            values = self.values[a:b]
            out[i] = query[self.ids[a:b]] @ (values if self.level is None else self.level[values])
        query[t] = 0.0
        return np.round(out / self.norm[numbers], 12)


class BlockMaxIndex:
    """Exact nearest unit vectors by bounds on blocks of ``block`` examples; all weights are at least 0.

    Terms that many examples have (a share of ``COMMON``) are columns of a matrix.  All other terms have inverted lists,
    in tiers by their weight for their length.  A query adds up its lists tier by tier.  What the terms not yet read can
    give an example is at most the product of their norms in the query and in the example, so a block's bound is its
    largest sum and its largest remaining norm; blocks and then examples whose bound is below the k-th largest sum are
    out.  Reading ends once scoring the examples that remain costs less than the next tier.  Like examples share a
    block: they lie in order of the nearest of some drawn examples.  Lists and matrix have single precision (``SLACK``
    and ``SUMS`` cover it, as shares of a sum); what remains is scored again in double precision.
    """

    COMMON, SLACK, SUMS = 1 / 16, 4e-6, 5e-4
    #: An example as a query reads so many times its own entries up to the end of each tier but the last.
    TIERS = (4, 16, 64)
    #: Lists from this length are added one by one; scoring an entry of an example costs as much as these of a list.
    LONG, ENTRY = 256, 4

    def __init__(self, vectors: Flat | Iterable[dict[int, float] | Vector], block: int = BLOCK):
        self.rows, self.block = vectors if isinstance(vectors, Flat) else Flat.of(vectors), block
        self.size, self.width = len(self.rows), int(self.rows.ids.max(initial=-1)) + 1
        self.query: np.ndarray | None = None

    def _prepare(self) -> None:
        """Matrix and lists: made where they are used, not sent.  Beside them no more than a stretch of examples is held."""
        seen = np.bincount(self.rows.ids, minlength=self.width)
        common = np.flatnonzero(seen >= max(2, self.size * self.COMMON))
        self.column = np.full(self.width, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.mean = max(1.0, float(seen.sum()) / max(1, self.size))
        squares = np.zeros(self.width)
        for *_, terms, weights in self.rows.stretches():
            squares += np.bincount(terms, weights**2, minlength=self.width)
        by = np.argsort(-squares / np.maximum(seen, 1) ** 2, kind="stable")
        by = by[self.column[by] < 0]
        self.tier = np.full(self.width, len(self.TIERS) + 1, np.int8)
        self.tier[by] = np.searchsorted(self.mean * self.size * np.array(self.TIERS), np.cumsum(seen[by] ** 2))
        del squares, by

        def dense() -> Iterator[tuple[int, np.ndarray]]:
            for low, high, owner, terms, weights in self.rows.stretches():
                inside = self.column[terms] >= 0
                part = np.zeros((high - low, len(common)), np.float32)
                part[owner[inside], self.column[terms[inside]]] = weights[inside]
                yield low, part

        step = max(1, self.size // 512)
        drawn = np.concatenate([part[-low % step :: step] for low, part in dense()])
        nearest = np.concatenate([np.argmax(part @ drawn.T, axis=1) for _, part in dense()])
        del drawn
        self.order = np.argsort(nearest, kind="stable")
        place = np.argsort(self.order)
        self.blocks = -(-self.size // self.block)
        self.dense = np.zeros((self.blocks * self.block, len(common)), np.float32)
        seen[common] = 0
        self.at = np.r_[0, np.cumsum(seen)]
        self.places = np.zeros(self.at[-1], np.min_scalar_type(self.blocks * self.block))
        self.parts = np.zeros(self.at[-1], np.float32)
        #: Per tier and example: the squared norm of the terms of all later tiers and columns.
        self.rest = np.zeros((len(self.TIERS) + 1, len(self.dense)))
        end = self.at[:-1].copy()  # of the list of every term so far
        for low, high, owner, terms, weights in self.rows.stretches():
            inside = np.flatnonzero(self.column[terms] >= 0)
            self.dense[place[low + owner[inside]], self.column[terms[inside]]] = weights[inside]
            tier, square = self.tier[terms], weights**2
            for j, norm in enumerate(self.rest):
                norm[place[low:high]] = np.bincount(owner, square * (tier > j), minlength=high - low)
            rest = np.flatnonzero(self.column[terms] < 0)
            rest = rest[np.argsort(terms[rest], kind="stable")]
            own, first, n = np.unique(terms[rest], return_index=True, return_counts=True)
            to = np.arange(len(rest)) + np.repeat(end[own] - first, n)
            self.places[to], self.parts[to] = place[low + owner[rest]], weights[rest]
            end[own] += n
        self.rest = np.sqrt(self.rest)
        self.rest_of_block = self.rest.reshape(len(self.rest), self.blocks, self.block).max(axis=2)
        self.query = np.zeros(self.width)

    def _add(self, total: np.ndarray, t: np.ndarray, w: np.ndarray) -> None:
        """Add the lists of some terms: each example is once in a list."""
        start, end = self.at[t], self.at[t + 1]
        long = end - start >= self.LONG
        for a, b, x in zip(start[long].tolist(), end[long].tolist(), w[long].tolist()):
            total[self.places[a:b]] += x * self.parts[a:b]
        start, end, w = start[~long], end[~long], w[~long]
        entries = _ranges(start, end)
        total += np.bincount(self.places[entries], np.repeat(w, end - start) * self.parts[entries], minlength=len(total))

    def _floor(self, scores: np.ndarray, k: int) -> float:
        """A little below the k-th largest, so that rounding and ties are covered; below 0 with fewer."""
        kth = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else 0.0
        return kth * (1 - self.SLACK) - 2e-12

    def _near(self, t: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
        """Places of all examples that can be among the k nearest."""
        by = np.argsort(self.tier[t], kind="stable")
        t, w = t[by], w[by]
        cuts = np.searchsorted(self.tier[t], np.arange(len(self.TIERS) + 2))
        later = np.sqrt(np.r_[np.cumsum((w * w)[::-1])[::-1], 0.0]) * (1 + self.SLACK)
        entries = np.r_[0, np.cumsum(self.at[t + 1] - self.at[t])][cuts]
        total = np.zeros(self.blocks * self.block)
        for j in range(len(self.TIERS) + 1):
            self._add(total, t[cuts[j] : cuts[j + 1]], w[cuts[j] : cuts[j + 1]])
            best, more = total.reshape(self.blocks, self.block).max(axis=1), later[cuts[j + 1]]
            # the k largest sums lie in the k blocks of the largest ones
            top = np.argpartition(-best, k - 1)[:k] if self.blocks > k else np.arange(self.blocks)
            floor = self._floor(total.reshape(self.blocks, self.block)[top].ravel(), k)
            open_ = np.flatnonzero(best + more * self.rest_of_block[j] >= floor)
            following = entries[j + 2] - entries[j + 1] if j < len(self.TIERS) else 0
            if j < len(self.TIERS) and len(open_) > 4 * k and len(open_) * self.mean > following:
                continue
            near = (open_[:, None] * self.block + np.arange(self.block)).ravel()
            bound = total[near] + more * self.rest[j][near]
            keep = (bound >= floor) & (bound > 0)
            near, bound = near[keep], bound[keep]
            if len(near) <= 2 * k or len(near) * self.mean * self.ENTRY <= following:
                return near
        own = np.zeros(self.dense.shape[1], np.float32)
        own[self.column[t[cuts[-1] :]]] = w[cuts[-1] :]

        def scored(places: np.ndarray) -> np.ndarray:
            return total[places] + np.concatenate([np.zeros(0), *(self.dense[places[i : i + 256]] @ own for i in range(0, len(places), 256))])

        first = np.argpartition(-bound, 4 * k - 1)[: 4 * k] if len(near) > 4 * k else np.arange(len(near))
        score = scored(near[first])
        open_ = bound >= self._floor(score, k) * (1 - self.SUMS)
        open_[first] = False
        rest = np.flatnonzero(open_)
        near, score = np.r_[near[first], near[rest]], np.r_[score, scored(near[rest])]
        return near[(score >= self._floor(score, k) * (1 - self.SUMS)) & (score > 0)]

    def nearest_of(self, queries: list[dict[int, float] | Vector], k: int) -> list[list[Hit]]:
        """For each query the k largest cosines above 0 and all that tie with the k-th."""
        if not self.size:
            return [[] for _ in queries]
        if self.query is None:
            self._prepare()
        out = []
        for t, w in map(_vector, queries):
            t, w = t[t < self.width], w[t < self.width]
            near = np.sort(self.order[self._near(t, w, k)])
            exact = self.rows.cosines(self.query, t, w, near)
            near, exact = near[exact > 0], exact[exact > 0]
            if len(exact) > k:
                keep = exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
                near, exact = near[keep], exact[keep]
            by = np.lexsort((near, -exact))
            out.append([Hit(s, i) for s, i in zip(exact[by].tolist(), near[by].tolist())])
        return out

    def nearest(self, query: dict[int, float] | Vector, k: int) -> list[Hit]:
        return self.nearest_of([query], k)[0]


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of labels on scores (pool adjacent violators): knots and values for interpolation."""
    order = np.argsort(score, kind="stable")
    x, y = score[order], label[order].astype(float)
    at, first = np.unique(x, return_index=True)
    n = np.diff(np.r_[first, len(x)])
    value = np.add.reduceat(y, first)
    pools: list[list[float]] = []  # sum, count, first knot, last knot
    for k in range(len(at)):
        pools.append([value[k], n[k], at[k], at[k]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, c, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += c
            pools[-1][3] = last
    knots, values = [], []
    for s, c, a, b in pools:
        level = (s + 0.5) / (c + 1.0)  # never exactly 0 or 1
        knots += [a, b] if b > a else [a]
        values += [level, level] if b > a else [level]
    return np.array(knots), np.maximum.accumulate(np.array(values))


def strength(seen: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    """Above 0 for every term: how far the share of toxic rows among a term's rows is from the prior, as squared log odds."""
    if not 0 < prior < 1:
        return np.ones(len(seen))
    p = (toxic + SHRINK * prior) / (seen + SHRINK)
    return NEUTRAL + (np.log(p / (1 - p)) - np.log(prior / (1 - prior))) ** 2


def _key(ids: np.ndarray, counts: np.ndarray) -> bytes:
    return blake2b(ids.tobytes() + counts.tobytes(), digest_size=16).digest()


class NearestVote:
    """Examples (id, term numbers, counts, toxic) merged by equal vectors, their index, and the vote."""

    def __init__(self, examples: list[tuple[int, np.ndarray, np.ndarray, int]], idf: np.ndarray, k: int = NEIGHBOURS):
        self.k, self.n, self.toxic = k, len(examples), sum(e[3] for e in examples)
        self.prior = self.toxic / self.n if self.n else 0.0
        seen, bad = np.zeros(len(idf)), np.zeros(len(idf))
        merged: dict[bytes, list] = {}
        firsts: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for doc_id, ids, counts, toxic in sorted(examples, key=lambda e: e[0]):
            seen[ids] += 1
            bad[ids] += toxic
            key = _key(ids, counts)
            entry = merged.setdefault(key, [0, 0, []])
            firsts.setdefault(key, (ids, counts))
            entry[0] += 1
            entry[1] += toxic
            if len(entry[2]) < EVIDENCE:
                entry[2].append(doc_id)
        self.weight = idf * strength(seen, bad, self.prior)
        nothing = _key(np.zeros(0, np.int32), np.zeros(0, np.int32))
        self.blank = merged.pop(nothing, [0, 0, []])
        firsts.pop(nothing, None)
        self.groups = list(merged.values())
        self.number = {key: i for i, key in enumerate(merged)}
        rows = list(firsts.values())
        self.start = np.r_[0, np.cumsum([len(r[0]) for r in rows])].astype(np.int64)
        self.ids = np.concatenate([np.zeros(0, np.int32), *(r[0] for r in rows)])
        counts = np.concatenate([np.zeros(0, np.int32), *(r[1] for r in rows)])
        self.counts = counts.astype(np.min_scalar_type(counts.max(initial=0)))

    def __getstate__(self) -> dict:
        """What is sent holds term numbers and counts, compressed; the index is built where it is used."""
        state = {k: v for k, v in self.__dict__.items() if k not in ("index", "logs")}
        steps = np.diff(self.ids, prepend=np.int32(0)).astype(np.int32)
        return state | {"ids": zlib.compress(steps.tobytes(), 1), "counts": (self.counts.dtype.str, zlib.compress(self.counts.tobytes(), 1))}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ids = np.cumsum(np.frombuffer(zlib.decompress(state["ids"]), np.int32), dtype=np.int32)
        self.counts = np.frombuffer(zlib.decompress(state["counts"][1]), state["counts"][0])

    @cached_property
    def index(self) -> BlockMaxIndex:
        return BlockMaxIndex(Flat(self.start, self.ids, self.counts, self.logs, self.weight))

    @cached_property
    def logs(self) -> np.ndarray:
        """1 + log of every count that an example has."""
        return 1.0 + np.log(np.maximum(1.0, np.arange(1 + int(self.counts.max(initial=0)))))

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> Vector:
        """Unit vector of (1 + log tf) * idf * strength."""
        known = len(counts) == 0 or counts.max() < len(self.logs)
        v = (self.logs[counts] if known else 1.0 + np.log(counts, dtype=np.float64)) * self.weight[ids]
        norm = float(np.sqrt((v * v).sum()))
        return ids, v / norm if norm else v

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray, bool]], toxic: list[int] | None = None) -> list[tuple[float, list[int]]]:
        """Per row (term numbers, counts, no word at all) the weighted vote and the ids of the nearest examples.

        With ``toxic``, one example of a row's vector and label is out.  A text without words is nearest to the examples
        without any; words that no example has give the prior.
        """
        asked = [i for i, (ids, _, blank) in enumerate(rows) if len(ids) and not blank]
        found = dict(zip(asked, self.index.nearest_of([self.vector(*rows[i][:2]) for i in asked], self.k))) if asked else {}
        return [self._vote(*row, found.get(i, []), toxic[i] if toxic is not None else None) for i, row in enumerate(rows)]

    def _vote(self, ids: np.ndarray, counts: np.ndarray, blank: bool, hits: list[Hit], toxic: int | None) -> tuple[float, list[int]]:
        own = None
        if blank:
            voters, own = [(1.0, -1, self.blank)], -1
        else:
            voters = [(h.similarity, h.example, self.groups[h.example]) for h in hits]
            own = self.number.get(_key(ids, counts)) if toxic is not None else None
        total, vote, out = 1.0, self.prior, []
        for similarity, group, (count, bad, docs) in voters:
            if toxic is not None and group == own:
                count, bad = count - 1, bad - toxic
            weight = 1.0 / (0.05 + max(0.0, 1.0 - similarity))
            total += weight * count
            vote += weight * bad
            out += docs
        return vote / total, out[:EVIDENCE]


def calibrated(raw: float, knots: np.ndarray | None, values: np.ndarray | None) -> float:
    if knots is None:
        return raw
    return min(1.0, max(0.0, 0.98 * float(np.interp(raw, knots, values)) + 0.02 * raw))  # the vote orders documents of one pool


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    train_rows: int = TRAIN_ROWS,
    k: int = NEIGHBOURS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, evidence (ids of nearest labelled examples).

    Labels are learned from rows outside fold 0 only, at most ``train_rows`` of them (smallest id hash first), with all
    their terms (one row per id: of several texts that of the smallest hash); every document is scored, and document frequencies count all of them.  A text without words (null and
    empty ones too) is nearest to the examples without any; one without a word of any example has no evidence and gets
    the labels' ratio, calibrated.  Null ids are in fold 0 and never examples; repeated rows give one row each; of
    several labels of an id the largest counts; other columns are ignored.  Without labels every score is 0; an empty
    table gives no rows.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(fold(F.col("doc_id")) != 0)
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    drawn = stored(drawn.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")), "labelled")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labelled = narrow.join(F.broadcast(drawn), "doc_id").withColumn("name", F.struct(F.xxhash64("text"), F.crc32(F.col("text").cast("binary"))))
    once = labelled.groupBy("doc_id").agg(F.min("name").alias("name"), F.first("toxic").alias("toxic"))
    sample = labelled.select("doc_id", "text", "name").join(F.broadcast(once), ["doc_id", "name"]).dropDuplicates(["doc_id"])
    sample = stored(sample.select("doc_id", "text", "toxic"), "examples")
    context = docs.sparkSession.sparkContext
    found = all_terms(sample)
    size = len(found)
    words = context.broadcast(Vocabulary(found))
    del found

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", 4 << 20):
            rows = pa.array([packed(*words.value.count(t)) for t in text_list(part.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], names=["doc_id", "terms"])

    # read by the frequencies and the scores: words are looked up once
    counts = stored(narrow.mapInArrow(counted, "doc_id bigint, terms binary"), "term-counts")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task: how many documents have each term; number -1 counts all documents."""
        seen, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for row in batch.column("terms").to_pylist():
                seen[unpacked(row)[0]] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n, seen[at]], pa.int64())], names=["t", "n"])

    idf = np.ones(size)
    if size:
        sums = counts.mapInArrow(frequencies, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
        at, n = sums.column("t").to_numpy(), sums.column("n").to_numpy()
        total = int(n[at < 0].sum())
        frequency = np.zeros(size)
        frequency[at[at >= 0]] = n[at >= 0]
        idf = np.log((1 + total) / (1 + frequency)) + 1.0

    def labelled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", 4 << 20):
            rows = pa.array([packed(*words.value.count(t)) for t in text_list(part.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows, part.column("toxic")], names=["doc_id", "terms", "toxic"])

    sample = stored(sample.mapInArrow(labelled_counts, "doc_id bigint, terms binary, toxic int"), "example-counts")
    rows = sample.toArrow()
    of = [unpacked(r) for r in rows.column("terms").to_pylist()]
    examples = [(i, ids, n, toxic) for i, (ids, n, _), toxic in zip(rows.column("doc_id").to_pylist(), of, rows.column("toxic").to_pylist())]
    model = context.broadcast(NearestVote(examples, idf, k))
    del rows, of, examples

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [unpacked(r) for r in batch.column("terms").to_pylist()]
            votes = [v for v, _ in model.value.raw(asked, batch.column("toxic").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column("toxic")], names=["raw", "toxic"])

    votes = sample.repartition(context.defaultParallelism).mapInArrow(left_out, "raw double, toxic int").toArrow()
    knots = values = None
    if votes.num_rows:
        knots, values = isotonic(votes.column("raw").to_numpy(), votes.column("toxic").to_numpy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, list[int]]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = part.column("terms").to_pylist()
                names = [blake2b(row, digest_size=16).digest() for row in rows]
                if len(known) > 50_000:
                    known.clear()
                fresh = {name: row for name, row in zip(names, rows) if name not in known}
                for name, (raw, near) in zip(fresh, model.value.raw([unpacked(row) for row in fresh.values()])):
                    known[name] = calibrated(raw, knots, values), near
                scores, evidence = zip(*(known[name] for name in names))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(list(scores), pa.float64()), pa.array(list(evidence), pa.list_(pa.int64()))],
                    names=["doc_id", "score", "evidence"],
                )

    scored = counts.mapInArrow(score, "doc_id bigint, score double, evidence array<bigint>")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )
