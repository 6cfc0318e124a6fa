"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt at random into groups of about GROUP_TOKENS
tokens; a group is a packing problem of its own.  The pieces of its under-filled sequences (more than 1/32 empty) go back
and are dealt anew, those of all groups together, round after round until one group holds them or a round saves less
than 1 of 256 of its sequences.  Each group evolves on several islands: a crossover injects whole well-filled bins of one
parent into another, removes the bins that hold duplicates, and best-fits the displaced pieces, longest first.  After
each round every island receives its neighbour's elite (a shuffle of solutions, not of texts).  A group whose bins reach
the lower bound is done.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache
from random import Random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces as cut_batches
from .common import stored

MODEL = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CAPACITY = 2048
GROUP, GROUP_TOKENS = 1500, 1 << 20
OPEN, GAIN = 32, 256
ISLANDS = 3
ROUNDS = 2
GENERATIONS = 12
POPULATION = 4


@lru_cache(maxsize=2)
def _encoder(model: str, ranks: str | None):
    """ids of a text as the tokenizers library gives them.

    Texts of code points below U+0280 without a special token's start are encoded from the same ranks by tiktoken,
    which gives equal ids (tested over these code points) in a quarter of the time; all other texts, and any on which
    it fails, by the tokenizers library.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(model)
    exact = lambda text: slow.encode(text, add_special_tokens=False).ids
    if ranks is None:
        return exact
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> list[int]:
        if "<|" not in text and (text.isascii() or max(text) < "ʀ"):
            try:
                return fast.encode_ordinary(text)
            except BaseException as error:  # the library's panics do not derive from Exception
                if isinstance(error, (KeyboardInterrupt, SystemExit)):
                    raise
        return exact(text)

    return encode


def spans(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of ``capacity`` after a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(a, capacity) for a in range(first, n, capacity)]


def tokenized(
    docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, model: str | None = None, ranks: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and a salt that differs between equal rows."""
    path = model or public_tokenizers.path(MODEL)
    fast = ranks or (public_tokenizers.path(RANKS) if model is None else None)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_salt", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, fast)
        salt = 0
        for part in cut_batches(batches, "text", 2 << 20):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), 0], "<u4")
                for k, (start, length) in enumerate(spans(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length]), salt))
                    salt += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _salt bigint")


# A solution is a list of bins, a bin a list of item numbers.


def best_fit(bins: list[list[int]], items: Sequence[int], sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Put each item into the fullest bin that still takes it, else into a new one."""
    free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            insort(free, (capacity - sizes[i], len(bins) - 1))
        else:
            left, k = free.pop(at)
            bins[k].append(i)
            insort(free, (left - sizes[i], k))
    return bins


def fitness(bins: list[list[int]], sizes: Sequence[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the sum of squared fills: full bins and one nearly empty one beat even ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(one: list[list[int]], two: list[list[int]], sizes: Sequence[int], capacity: int, rnd: Random) -> list[list[int]]:
    """Inject well-filled bins of ``two`` into ``one``, drop its bins with duplicates, best-fit what they held."""
    ranked = sorted(two, key=lambda b: -sum(sizes[i] for i in b))
    top = ranked[: max(1, len(ranked) // 2)]
    chosen = rnd.sample(top, max(1, len(top) // 3))
    taken = {i for b in chosen for i in b}
    kept, displaced = [list(b) for b in chosen], []
    for b in one:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    worst = min(range(len(kept)), key=lambda k: sum(sizes[i] for i in kept[k]))
    displaced += kept.pop(worst)  # the emptiest bin is opened too, so that bins can be saved
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(kept, displaced, sizes, capacity)


def evolve(
    sizes: Sequence[int], seeds: list[list[list[int]]], seed: str, capacity: int, generations: int = GENERATIONS, population: int = POPULATION
) -> list[list[list[int]]]:
    """Solutions of one island after some generations, best first."""
    rnd = Random(seed)
    items = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bound = -(-sum(sizes) // capacity)
    score = lambda s: fitness(s, sizes, capacity)
    pool = list(seeds) or [best_fit([], items, sizes, capacity)]
    while len(pool) < population and len(min(pool, key=len)) > bound:
        noisy = sorted(items, key=lambda i: (-sizes[i] * rnd.uniform(0.8, 1.0), i))
        pool.append(best_fit([], noisy, sizes, capacity))
    pool.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(pool[0]) <= bound or len(pool) < 2:
            break
        one, two = rnd.sample(range(len(pool)), 2)
        child = crossover(pool[one], pool[two], sizes, capacity, rnd)
        if score(child) > score(pool[-1]):
            pool[-1] = child
            pool.sort(key=score, reverse=True)
    return pool[:population]


def _encode_bins(bins: list[list[int]], n: int) -> bytes:
    place = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        place[b] = k
    return place.tobytes()


def _decode_bins(raw: bytes) -> list[list[int]]:
    place = np.frombuffer(raw, "<i4")
    bins: list[list[int]] = [[] for _ in range(int(place.max(initial=-1)) + 1)]
    for i, k in enumerate(place.tolist()):
        bins[k].append(i)
    return bins


def _islands(problems: DataFrame, capacity: int, islands: int, rounds: int) -> DataFrame:
    """(group, place): the best solution of each group after all rounds, as bin numbers of its items."""

    def rounds_of(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups, isles = batch.column("group").to_pylist(), batch.column("island").to_pylist()
                for g, isle, sizes, old in zip(groups, isles, batch.column("sizes").to_pylist(), batch.column("pool").to_pylist()):
                    start = [_decode_bins(x) for x in old or ()]
                    pool = evolve(sizes, start, f"{g}/{isle}/{number}", capacity)
                    fit = fitness(pool[0], sizes, capacity)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([g]), pa.array([isle], pa.int32()), pa.array([sizes], pa.list_(pa.int32())),
                            pa.array([[_encode_bins(b, len(sizes)) for b in pool]], pa.list_(pa.binary())),
                            pa.array([-fit[0]], pa.int32()), pa.array([fit[1]], pa.float64()),
                        ],
                        names=["group", "island", "sizes", "pool", "bins", "fill"],
                    )

        return run

    ddl = "group bigint, island int, sizes array<int>, pool array<binary>, bins int, fill double"
    state = problems.select(
        "group",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        "sizes",
        F.lit(None).cast("array<binary>").alias("pool"),
    )
    for number in range(rounds):
        state = stored(state.repartition("group", "island").mapInArrow(rounds_of(number), ddl), "islands")
        if number + 1 < rounds and islands > 1:
            elite = state.select("group", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("pool")[0].alias("migrant"))
            state = state.join(elite, ["group", "island"]).select("group", "island", "sizes", F.concat(F.array("migrant"), "pool").alias("pool"))
    best = F.max_by(F.col("pool")[0], F.struct(-F.col("bins"), F.col("fill"), -F.col("island")))
    return state.groupBy("group").agg(best.alias("place"))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequence, offset and the sequence's fill of every item of a group."""
    for batch in batches:
        sequences, offsets, fills = [], [], []
        for group, lengths, raw in zip(*(batch.column(n).to_pylist() for n in ("group", "lengths", "place"))):
            n = len(lengths)
            bins = np.frombuffer(raw, "<i4").astype(np.int64) if raw else np.zeros(0, np.int64)
            used = int(bins.max(initial=-1)) + 1
            bins = np.concatenate([bins, used + np.arange(n - len(bins))])  # whole pieces sort last
            filled = [0] * (int(bins.max(initial=-1)) + 1)
            at = []
            for k, length in zip(bins.tolist(), lengths):
                at.append(filled[k])
                filled[k] += length
            sequences.append(((group << 24) + bins).tolist())
            offsets.append(at)
            fills.append(np.array(filled, np.int64)[bins].tolist())
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("items"), pa.array(sequences, kind), pa.array(offsets, kind), pa.array(fills, kind)],
            names=["items", "sequence_id", "offset", "fill"],
        )


def _packed(cut: DataFrame, groups: int, base: int, capacity: int, islands: int, rounds: int) -> DataFrame:
    """One round: pieces with sequence_id, offset and the sequence's fill; groups are numbered from ``base``."""
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_salt", F.lit(base)), F.lit(groups)) + F.lit(base)
    item = F.struct(F.col("length"), "doc_id", "piece", "start", "ids_crc32", "_salt")
    dealt = cut.groupBy(key.alias("group")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    dealt = stored(dealt, "packing-groups")
    small = F.filter("items", lambda x: x["length"] < capacity)
    problems = dealt.select("group", F.transform(small, lambda x: x["length"].cast("int")).alias("sizes"))
    solved = _islands(problems.filter(F.size("sizes") > 0), capacity, islands, rounds)
    joined = dealt.join(solved, "group", "left").select(
        "group", "items", F.transform("items", lambda x: x["length"]).alias("lengths"), "place"
    )
    kind = "items array<struct<length:bigint,doc_id:bigint,piece:int,start:bigint,ids_crc32:bigint,_salt:bigint>>"
    placed = joined.mapInArrow(_place, f"{kind}, sequence_id array<bigint>, offset array<bigint>, fill array<bigint>")
    rows = placed.select(F.explode(F.arrays_zip("items", "sequence_id", "offset", "fill")).alias("z"))
    return rows.select("z.items.*", "z.sequence_id", "z.offset", "z.fill")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    group_items: int = GROUP,
    islands: int = ISLANDS,
    rounds: int = ROUNDS,
    model: str | None = None,
    ranks: str | None = None,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and packs as its closing id 0 alone.  Null and repeated ids and repeated rows give pieces of
    their own; other columns are ignored; an empty table gives no rows.  Groups are drawn from a hash with a salt, so
    equal rows spread; a group has about ``group_items`` pieces and ``group_tokens`` tokens at least, if there are so many.
    """
    cut = stored(tokenized(docs, id_col, text_col, capacity, model, ranks), "pieces")
    done: list[DataFrame] = []
    base, before, last = 0, 0, None
    while True:
        n, tokens = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        groups = max(1, min(-(-n // group_items), -(-tokens // group_tokens)))
        placed = stored(_packed(cut, groups, base, capacity, islands, rounds), "packed")
        base += groups
        is_open = F.col("fill") < capacity - capacity // OPEN
        made, left = placed.filter("offset = 0").agg(F.count(F.lit(1)), F.count_if(is_open)).first()
        if last is not None and made > before:  # the former places were better
            done.append(last)
            break
        if groups == 1 or not left or (last is not None and before - made < before / GAIN):
            done.append(placed)
            break
        done.append(placed.filter(~is_open))
        last, before = placed.filter(is_open), left
        cut = last.drop("sequence_id", "offset", "fill")
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
