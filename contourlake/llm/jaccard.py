"""Exact Jaccard join of shingle sets by partition of the universe and the pigeonhole principle.

Sets fall into bands of size.  For a band the universe of shingles is hashed into segments.  Linked sets differ by at
most H shingles, so if segments have capacities that add up to H + 1, some segment differs by less than its capacity:
capacity 1 needs equal segments, capacity 2 (a few designated segments) at most one difference, found by indexing the
segment and its one-deletion neighbourhood.  A set meets smaller ones in its own band; it is put into the next band too
(for meeting larger ones) with no more signatures than it needs there.

Cost-based allocation: capacity beyond H + 1 is given up where it costs most.  Empty segments are left out first, then,
when it is known how many other sets hold a signature, the most frequent ones.

No signature's pairs are listed.  Every signature names one of its holders (the same one for most signatures of a
group); a set is first compared with the nearest of those that its signatures name, and what that links is merged.  A second
such round draws from the largest component of every signature, another member for each.  Then only sets of different components are compared, each with
those of larger components.  Compared pairs pass a necessary test on parity sketches (every differing shingle turns one
bit) and are verified on the words themselves.  A sketch folded to a few words travels with the signatures of the second
step, so that the join by signature gives only pairs that sizes and folded sketches allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from hashlib import blake2b
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few, pieces, stored, text_list
from .components import components

SHINGLE, THRESHOLD = 4, 85
#: Sizes of a band grow by this share (in fifths: 7/5), which is more than 100 / 85, so that links reach the next band only.
GROWTH = (7, 5)
#: Least size of a parity sketch in words of 64 bits.
SKETCH = 16
#: Words of 64 bits of the folded sketch that travels with a signature.
FOLD = 16
#: Rows up to which a list of names is broadcast (16 bytes each); longer lists are joined by shuffle.
BROADCAST_ROWS = 2_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
PROBE, SPARE, NEXT, MINUS = 1, 2, 4, 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


@cache
def bands() -> np.ndarray:
    """First sizes of the bands, up to sizes beyond any text."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * GROWTH[0] // GROWTH[1])))
    return np.array(out, np.int64)


def differences(a: int, b: int, threshold: int = THRESHOLD) -> int:
    """Most shingles in which linked sets of these sizes differ."""
    return (100 - threshold) * (a + b) // (100 + threshold)


@cache
def layout(band: int, threshold: int = THRESHOLD) -> tuple[int, int]:
    """Segments of a band, and how many of them (the first ones) have capacity 2."""
    top = int(bands()[band + 1]) - 1
    most = differences(top, top, threshold)
    return most + 1, min(most + 1, 2 + most // 32) if most else 0


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base modulo 2^64, and of its inverse."""
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))])
    return _powers[0], _powers[1]


def shingle_hashes(text: bytes, shingle: int = SHINGLE, step: int = 200_000) -> np.ndarray:
    """Different hashes of a text's shingles, ascending: polynomials of their bytes as differences of prefix sums."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    out = []
    for low in range(0, max(1, len(words) - shingle + 1), step):  # stretches of words, which overlap by a shingle
        joined = np.frombuffer(b" ".join(words[low : low + step + shingle - 1]), np.uint8)
        up, down = _power(len(joined))
        prefix = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((joined + np.uint64(1)) * up[: len(joined)], out=prefix[1:])
        blank = np.flatnonzero(joined == 32)
        starts, ends = np.concatenate([[0], blank + 1]), np.concatenate([blank, [len(joined)]])
        k = min(shingle, len(starts))
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
        out.append(_mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD[1]))
    return np.unique(np.concatenate(out))


def _segments(h: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature and size of each of ``m`` segments, and the shingles in order of their segments with their number."""
    seg = ((h * (_ODD[4] + np.uint64(2 * band))) >> np.uint64(24)) % np.uint64(m)
    by = np.argsort(seg, kind="stable")
    ends = np.searchsorted(seg[by], np.arange(m + 1, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[by], dtype=np.uint64)])
    return total[ends[1:]] - total[ends[:-1]], np.diff(ends), h[by], seg[by]


def signatures(h: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, tags, spare) of a set: PROBE marks keys by which it seeks others, SPARE those it may
    give up, one unit each, NEXT those in the band above its own, MINUS those of a segment without one shingle (two of which
    need not meet)."""
    s = len(h)
    most = s * 100 // threshold
    own = int(np.searchsorted(bands(), s, side="right")) - 1
    keys, tags, spare = [], [], 0
    for band in (own, own + 1):
        m, designated = layout(band, threshold)
        first, top = int(bands()[band]), int(bands()[band + 1]) - 1
        if band > own and most < first:
            break
        sums, sizes, tokens, seg = _segments(h, band, m)
        name = (np.arange(m, dtype=np.uint64) + np.uint64(band << 40)) * _ODD[2]
        units = np.where(np.arange(m) < designated, 2, 1)
        need = differences(s, min(top, most), threshold) + 1
        if band == own:
            left = int(units.sum()) - need
            probe = np.ones(m, bool)
            for i in np.flatnonzero(sizes == 0).tolist():  # empty segments are given up first
                if units[i] <= left:
                    left -= int(units[i])
                    probe[i] = False
            emit, spare = np.ones(m, bool), left
        else:  # the largest segments of capacity 1 come first, then designated ones, then empty ones
            by = np.lexsort((-sizes, np.where(sizes == 0, 2, units - 1)))
            probe = np.zeros(m, bool)
            probe[by[: int(np.searchsorted(np.cumsum(units[by]), need)) + 1]] = True
            emit = probe
        tag = np.where(probe, PROBE, 0) | np.where(probe & (units == 1) & (band == own), SPARE, 0) | (NEXT if band > own else 0)
        keys.append(_mix(sums + name)[emit])
        tags.append(tag[emit])
        if designated:
            inside = seg < np.uint64(designated)
            at = seg[inside].astype(np.int64)
            at, token = at[emit[at]], tokens[inside][emit[at]]
            keys.append(_mix(sums[at] - token + name[at]))
            tags.append(np.where(probe[at], PROBE, 0) | (NEXT if band > own else 0) | MINUS)
    return np.concatenate(keys).view(np.int64), np.concatenate(tags).astype(np.int8), spare


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the set in a power of two of places, as many as it has shingles: sketches differ in no more bits than sets."""
    places = 64 * max(SKETCH, 1 << max(0, len(h) - 1).bit_length() >> 6)
    odd = np.bincount((h >> np.uint64(7)).astype(np.int64) % places, minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def turned(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which sketches differ, pair by pair; the longer one of a pair is folded to the size of the other."""
    sizes = np.array([(len(x) // 8, len(y) // 8) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    out = np.zeros(len(a), np.int64)
    for i, j in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (i, j)).all(axis=1))
        small = min(i, j)
        sides = (np.frombuffer(b"".join([side[r] for r in at]), np.uint64).reshape(len(at), -1, small) for side in (a, b))
        one, two = (np.bitwise_xor.reduce(side, axis=1) for side in sides)
        out[at] = np.bitwise_count(one ^ two).sum(axis=1)
    return out


def _allowed(a: Column, b: Column, turned: Column, threshold: int) -> Column:
    """Whether sets of these sizes can be similar if at least ``turned`` shingles differ."""
    near = 100 * F.least(a, b) >= threshold * F.greatest(a, b)
    return near & ((100 + threshold) * turned <= (100 - threshold) * (a + b))


def prints(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, t1, t2): size, digest, sketch and folded sketch of its set, and its signatures with tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", 4 << 20):
            cells: list[list] = [[] for _ in range(4)]
            sketches, folds, keys, tags = [], [], [], []
            for text in text_list(part.column("text")):
                h = shingle_hashes(text, shingle)
                digest = np.frombuffer(blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
                key, tag, spare = signatures(h, threshold) if len(h) else (np.zeros(0, np.int64), np.zeros(0, np.int8), 0)
                for cell, value in zip(cells, (len(h), int(digest[0]), int(digest[1]), spare)):
                    cell.append(value)
                places = sketch(h)
                sketches.append(places.tobytes())
                folds.append(np.bitwise_xor.reduce(places.reshape(-1, FOLD), axis=0))
                keys.append(key)
                tags.append(tag)
            ends = pa.array(np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32))
            columns = [part.column(c) for c in ("doc_id", "t1", "t2")] + [pa.array(c, pa.int64()) for c in cells] + [pa.array(sketches, pa.binary()), pa.array(folds, pa.list_(pa.int64()))]
            columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tags)))]
            names = ["doc_id", "t1", "t2", "n", "d1", "d2", "spare", "sketch", "fold", "keys", "tags"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = "doc_id long, t1 long, t2 long, n long, d1 long, d2 long, spare long, "
    return docs.mapInArrow(run, kept + "sketch binary, fold array<long>, keys array<long>, tags array<tinyint>")


def _possible(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """(u, v, turned): the pairs of nodes that sizes and sketches allow."""
    facts = nodes.select("node", "n", "sketch")
    sides = [facts.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")) for side in "uv"]
    both = pairs.join(sides[0], "u").join(sides[1], "v").filter(_allowed(F.col("u_n"), F.col("v_n"), F.lit(0), threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = turned(batch.column("u_sketch").to_pylist(), batch.column("v_sketch").to_pylist())
            both = batch.column("u_n").to_numpy() + batch.column("v_n").to_numpy()
            good = (100 + threshold) * bits <= (100 - threshold) * both
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(bits)], names=["u", "v", "turned"]).filter(pa.array(good, pa.bool_()))

    return both.select("u", "v", "u_n", "v_n", "u_sketch", "v_sketch").mapInArrow(run, "u long, v long, turned long")


def word_shingles(text: bytes, shingle: int = SHINGLE) -> set[bytes]:
    """The distinct shingles themselves."""
    words = text.translate(_LOWER).split()
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    ends = np.cumsum([len(w) + 1 for w in words])
    joined = b" ".join(words)
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - shingle + 1].tolist()
    return {joined[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())}


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets of shingles, made from the texts, are similar."""
    pairs = stored(pairs.select("u", "v"), "pairs")
    named = nodes.select("node", "t1", "t2")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    needed = stored(ends.join(named, "node"), "needed")
    texts = docs.select("t1", "t2", "text").join(few(needed.select("t1", "t2"), BROADCAST_ROWS), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    texts = stored(texts.join(needed, ["t1", "t2"]).select("node", "text"), "texts")
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            good = []
            for v, a, b in zip(batch.column("v").to_pylist(), text_list(batch.column("a")), text_list(batch.column("b"))):
                if v != last:  # rows come sorted by v, so its set is made once
                    last, own = v, word_shingles(b, shingle)
                other = word_shingles(a, shingle)
                common = len(own & other)
                good.append(100 * common >= threshold * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(good, pa.bool_())], names=["u", "v", "good"])

    met = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return met.mapInArrow(run, "u long, v long, good boolean").filter("good").select("u", "v")


def _mixed(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries (key, node, tag) of keys held by several components, with the place (size, name) of the node's component
    and a drawn member of the last component of the key.  ``found``: node, component; a node not in it stands alone."""
    by_key = W.partitionBy("key")
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = entries.join(found.join(size, "component"), "node", "left")
    placed = placed.select("key", "node", "tag", F.struct(F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("component", "node").alias("c")).alias("place"))
    star = F.max(F.struct("place", F.xxhash64("key", "node").alias("h"), "node")).over(by_key)
    return placed.withColumn("low", F.min("place").over(by_key)).withColumn("star", star).filter("low <> star.place").drop("low")


def classes(nodes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(node, component) for the nodes that have a link: the smallest node reachable.

    ``nodes``: node, n, t1, t2, sketch, fold, keys, tags, spare of different sets; ``docs``: t1, t2, text.
    """
    by_key = W.partitionBy("key")
    entries = nodes.select("node", "tags", F.posexplode("keys").alias("at", "key")).select("key", "node", F.col("tags")[F.col("at")].cast("int").alias("tag"))
    drawn = F.min(F.struct(F.xxhash64("node").alias("h"), "node")).over(by_key)["node"]
    seen = entries.select("*", F.count(F.lit(1)).over(by_key).alias("holders"), F.max(F.col("tag").bitwiseAND(F.lit(PROBE))).over(by_key).alias("probed"), F.min(F.col("tag").bitwiseAND(F.lit(MINUS))).over(by_key).alias("minus"), drawn.alias("star"))
    shared = stored(seen.filter("holders > 1 and probed = 1 and minus = 0").select("key", "node", "tag", "star"), "shared")

    def nearest(pairs: DataFrame) -> DataFrame:
        allowed = _possible(pairs.distinct(), nodes, threshold).groupBy("u").agg(F.min(F.struct("turned", "v")).alias("to"))
        return _verified(allowed.select("u", "to.v"), nodes, docs, shingle, threshold)

    first = stored(components(nearest(shared.filter("node <> star").select(F.col("node").alias("u"), F.col("star").alias("v")))), "first")

    # signatures whose holders are of one component are done; under the others a set is compared with one member of the
    # last component, another one under each signature, and joins the component of the nearest
    mixed = stored(_mixed(shared.select("key", "node", "tag").distinct(), first), "mixed")
    links = nearest(mixed.filter("place <> star.place").select(F.col("node").alias("u"), F.col("star.node").alias("v")))
    first = stored(components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links)), "first")

    # within a band a set seeks members of later components, so that the large ones never seek; from the band below it
    # seeks all others, as its signatures there are no more than it needs
    mixed = _mixed(mixed.select("key", "node", "tag"), first).drop("star")
    mixed = stored(mixed.join(nodes.select("node", "n", "fold", "spare"), "node"), "mixed")
    has = lambda flag: F.col("tag").bitwiseAND(F.lit(flag)) > 0
    own = mixed.filter(~has(NEXT))
    upto = F.count(F.lit(1)).over(by_key.orderBy(F.desc("place")))
    cost = own.withColumn("cost", upto - F.count(F.lit(1)).over(W.partitionBy("key", "place"))).filter(has(PROBE) & (F.col("cost") > 0))
    dearest = W.partitionBy("node", has(SPARE)).orderBy(F.desc("cost"), "key")
    ranked = cost.withColumn("rank", F.row_number().over(dearest))
    seeking = ranked.filter(~has(SPARE) | (F.col("rank") > F.col("spare"))).withColumn("above", F.lit(False))
    above = mixed.filter(has(NEXT)).withColumn("above", F.lit(True))
    side = lambda u, p: [F.col("node").alias(u), F.col("place").alias(p), F.col("n").alias(f"{u}_n"), F.col("fold").alias(f"{u}_fold"), has(MINUS).alias(f"{u}_less")]
    seek = seeking.select("key", *side("u", "p"), "above").union(above.select("key", *side("u", "p"), "above"))
    met = seek.join(own.select("key", *side("v", "q")), "key")
    bits = reduce(add, [F.bit_count(F.col("u_fold")[i].bitwiseXOR(F.col("v_fold")[i])) for i in range(FOLD)])
    met = met.filter("(p < q or (above and p > q)) and not (u_less and v_less)").filter(_allowed(F.col("u_n"), F.col("v_n"), bits, threshold))
    more = _possible(met.select("u", "v").distinct(), nodes, threshold)
    later = _verified(more, nodes, docs, shingle, threshold)
    return components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).union(later))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links).

    Texts without words (null, empty, blank) have size 0 and are linked with nothing, not with each other either.  Equal
    sets are linked; repeated rows give one row each.  Null ids count only where a component has no other id.  Other
    columns are ignored; an empty table gives no rows.  Candidates come from 64-bit shingle hashes, which can only add
    candidates; sizes count different hashes (two shingles of one text agree with a chance of about 10^-12), equal sets
    have equal 128-bit digests of them, and links are verified on the words.  ``threshold`` is 80 to 99 (hundredths).
    """
    if not 80 <= threshold <= 99:
        raise ValueError("bands are laid out for thresholds from 80 to 99")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("t"), text).alias("t2"))
    made = stored(prints(narrow, shingle, threshold).withColumn("uid", F.monotonically_increasing_id()), "prints")
    sets = made.filter("n > 0").groupBy("d1", "d2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("low"))
    sets = stored(sets, "sets")
    members = made.select("uid", "doc_id", "n", "d1", "d2")
    copies = stored(members.filter("n > 0").join(sets, ["d1", "d2"]).filter("uid <> node").select("uid"), "copies")
    nodes = made.filter("n > 0").join(few(copies, BROADCAST_ROWS), "uid", "left_anti").withColumnRenamed("uid", "node")
    found = stored(classes(nodes, narrow, shingle, threshold), "classes")
    named = sets.join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
    low = named.groupBy("c").agg(F.min("low").alias("component_id"))
    named = named.join(low, "c").select("d1", "d2", "component_id")
    linked = members.join(named, ["d1", "d2"], "left")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
