"""Suffix-array deduplication: bytes that lie in a 50-byte string which also starts in a document of smaller id.

1. Rows are dealt to groups.  Every 50-byte string has an anchor, the position of the smallest hash among its 20-byte
   substrings; neighbouring strings with the same anchor form a run.  The anchor's hash is the run's key, so equal
   strings meet under one key.  Groups tell buckets of keys how many windows of which documents hold each key; keys of
   one document end.  A group holds about ``GROUP_BYTES`` of text, so groups grow in number and not in size.
2. Groups cut the runs of shared keys out as windows (a run and the 49 bytes after it), merged if equal, and deal them
   by key.  A key of very many windows, whether of many documents or of few, is dealt by its single 50-byte strings
   instead, of which each group sends one row, so no string gathers more rows than there are groups.
3. Each bucket builds one suffix array (``suffixes``) over its distinct windows and reads off the classes of equal
   50-byte strings and each class's smallest document.
4. Groups mark the bytes of strings whose class has a smaller document.

Copies of a whole text are found first, by digest, and take no part in 1 to 3.  Documents are shuffled once; all three
passes over a group read the same exchange.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_list
from .suffixes import suffix_array

LENGTH = 50
ANCHOR = 20
#: Windows of a key above which its strings are dealt one by one.
HOT_WINDOWS = 20_000
#: Text of one group.
GROUP_BYTES = 16 << 20
STEP = 6
CHUNK_BYTES = 2 << 20
NO_ID = (1 << 63) - 1
_SEGMENT = 30_000
_BLOCK = 60_000

_SIDE = "_g bigint, _kind int, _a binary, _b binary"
_SIDE_SCHEMA = pa.schema([("_g", pa.int64()), ("_kind", pa.int32()), ("_a", pa.binary()), ("_b", pa.binary())])
_KEYS, _COPIES, _CLASSES = 0, 1, 2
#: Added to a number of windows that belong to more than one document of a group.
_SEVERAL = 1 << 31


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as one number (little-endian); ``data`` must have 8 spare bytes."""
    return np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))


def anchors(data: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> np.ndarray:
    """For every position that starts a string of ``length`` bytes: 48 bits of the anchor's hash, 16 of its position.

    ``data`` has at most 65,536 bytes; of equal hashes the leftmost wins.
    """
    n = len(data)
    w, m = length - k + 1, n - k + 1
    if n < length:
        return np.zeros(0, np.uint64)
    v = _words8(np.concatenate([data, np.zeros(8, np.uint8)]))
    h = v[:m] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += v[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += v[k - 8 : k - 8 + m] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(30)
    h &= np.uint64(0xFFFFFFFFFFFF0000)
    h |= np.arange(m, dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    q = m - w + 1
    return np.minimum(h[:q], h[w - span : w - span + q])


def runs(texts: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of runs: (key, text number, start, length, anchor minus start) of all strings of all texts."""
    block: list[tuple[int, int, bytes]] = []
    size = 0
    for d, text in enumerate(texts):
        for base in range(0, len(text) - LENGTH + 1, _SEGMENT):
            part = text[base : base + _SEGMENT + LENGTH - 1]
            if size + len(part) > _BLOCK:
                yield _block_runs(block, buckets)
                block, size = [], 0
            block.append((d, base, part))
            size += len(part)
    if block:
        yield _block_runs(block, buckets)


def _block_runs(block: list[tuple[int, int, bytes]], buckets: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(p) for _, _, p in block])
    starts = np.cumsum(sizes) - sizes
    low = anchors(np.frombuffer(b"".join(p for _, _, p in block), np.uint8))
    valid = np.zeros(len(low) + 1, bool)
    for a, n in zip(starts.tolist(), sizes.tolist()):
        valid[a : a + n - LENGTH + 1] = True
    valid = valid[:-1]
    change = np.concatenate([[True], (low[1:] != low[:-1]) | ~valid[:-1]]) & valid
    first = np.flatnonzero(change)
    ends = np.flatnonzero(np.concatenate([change[1:] | ~valid[1:], [True]]) & valid) + 1
    which = np.searchsorted(starts, first, side="right") - 1
    key = low[first] >> np.uint64(16)
    bucket, rest = key % np.uint64(buckets), key // np.uint64(buckets)
    key = bucket << np.uint64(32) | rest & np.uint64(0xFFFFFFFF)
    doc = np.array([d for d, _, _ in block])[which]
    base = np.array([b for _, b, _ in block])[which] - starts[which]
    return key, doc, first + base, ends - first, (low[first] & np.uint64(0xFFFF)).astype(np.int64) - first


class _Group:
    """The documents of one group in a fixed order, without copies."""

    def __init__(self, docs: pa.Table, side: pa.Table, text_col: str):
        rid = docs.column("_rid").to_numpy()
        self.rows_of, first, self.number = np.unique(rid, return_index=True, return_inverse=True)
        self.ids = docs.column("_doc").to_numpy()
        self.texts = text_list(docs.column(text_col))
        kinds = side.column("_kind").to_pylist()
        a, b = side.column("_a").to_pylist(), side.column("_b").to_pylist()
        self.side = {k: [(x, y) for x, y, z in zip(a, b, kinds) if z == k] for k in (_KEYS, _COPIES, _CLASSES)}
        copies = {x for x, _ in self.side[_COPIES]}
        self.copy = np.array([int(r).to_bytes(8, "big", signed=True) in copies for r in self.rows_of], bool)
        self.single = [b"" if self.copy[i] else self.texts[r] for i, r in enumerate(first)]
        self.single_ids = self.ids[first]


def _runs_of(group: _Group, buckets: int) -> tuple[np.ndarray, ...]:
    found = list(runs(group.single, buckets))
    if not found:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    return tuple(np.concatenate(c) for c in zip(*found))


def _report(buckets: int, text_col: str):
    """Per group: every key, the number of its windows and whether several documents hold it, one row per bucket."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, side: pa.Table) -> pa.Table:
        group = _Group(docs, side, text_col)
        keys, doc, *_ = _runs_of(group, buckets)
        order = np.argsort(keys, kind="stable")
        k, d = keys[order], doc[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        other = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else new
        at = np.flatnonzero(new)
        several = np.add.reduceat(other.astype(np.int64), at) > 1 if len(at) else at
        count = np.minimum(np.diff(np.append(at, len(k))), _SEVERAL - 1) + _SEVERAL * several
        # equal documents (same id and text) are one here; a key of one document stays unshared
        k = k[at]
        bucket = (k >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest, count = (k & np.uint64(0xFFFFFFFF)).astype("<u4"), count.astype("<u4")
        parts = list(zip(cut.tolist(), [*cut[1:].tolist(), len(k)]))
        return pa.table(
            {
                "_bucket": pa.array(bucket[cut], pa.int64()),
                "_g": pa.array([key[0].as_py()] * len(parts), pa.int64()),
                "keys": pa.array([rest[a:b].tobytes() for a, b in parts], pa.binary()),
                "windows": pa.array([count[a:b].tobytes() for a, b in parts], pa.binary()),
            }
        )

    return run


def _shared(hot: int):
    """Per bucket of keys: tell every group which of its keys another document holds, and which are hot."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, "<u4") for x in rows.column("keys").to_pylist()]
        told = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("windows").to_pylist()])
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        several = np.bincount(inverse, 1 + (told >= _SEVERAL), len(every)) > 1
        total = np.bincount(inverse, told % _SEVERAL, len(every))
        out, at = [], 0
        bucket = np.uint64(key[0].as_py()) << np.uint64(32)
        for g, own in zip(rows.column("_g").to_pylist(), keys):
            here = inverse[at : at + len(own)]
            at += len(own)
            n, keep = total[here], several[here]
            if keep.any():
                out.append((g, _KEYS, (bucket | own[keep].astype("<u8")).tobytes(), (n[keep] > hot).astype(np.uint8).tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _SIDE_SCHEMA)] if out else _SIDE_SCHEMA.empty_table().columns, schema=_SIDE_SCHEMA)

    return run


_WINDOWS = "_bucket bigint, _g bigint, key bigint, window binary, anchor int, strings int, low bigint, high bigint, refs binary"


def _windows(buckets: int, spread: int, text_col: str):
    """Per group: the distinct windows of its shared keys, with the places they stand at."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, side: pa.Table) -> pa.Table:
        group = _Group(docs, side, text_col)
        told = group.side[_KEYS]
        out: dict[tuple, list] = {}
        if told:
            shared = np.concatenate([np.frombuffer(x, "<u8") for x, _ in told])
            hot = np.concatenate([np.frombuffer(y, np.uint8) for _, y in told])
            order = np.argsort(shared)
            shared, hot = shared[order], hot[order]
            keys, doc, start, length, anchor = _runs_of(group, buckets)
            at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
            keep = np.flatnonzero(shared[at] == keys)
            columns = (keys[keep], hot[at[keep]], doc[keep], start[keep], length[keep], anchor[keep])
            for k, h, d, s, n, a in zip(*(c.tolist() for c in columns)):
                text = group.single[d]
                if h:
                    for p in range(s, s + n):
                        window = text[p : p + LENGTH]
                        out.setdefault((-1 - zlib.crc32(window), window, 0, 1), []).append((d, p))
                else:
                    out.setdefault((k, text[s : s + n + LENGTH - 1], a, n), []).append((d, s))
        ids = group.single_ids.tolist()
        own = [[ids[d] for d, _ in refs] for refs in out.values()]
        head = list(zip(*out)) or [[], [], [], []]
        return pa.table(
            {
                "_bucket": pa.array([k % spread for k in head[0]], pa.int64()),
                "_g": pa.array([key[0].as_py()] * len(out), pa.int64()),
                "key": pa.array(head[0], pa.int64()),
                "window": pa.array(head[1], pa.binary()),
                "anchor": pa.array(head[2], pa.int32()),
                "strings": pa.array(head[3], pa.int32()),
                "low": pa.array([min(x) for x in own], pa.int64()),
                "high": pa.array([max(x) for x in own], pa.int64()),
                "refs": pa.array([np.array(r, "<i4").tobytes() for r in out.values()], pa.binary()),
            }
        )

    return run


def string_classes(windows: list[bytes], anchor: np.ndarray, strings: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """For each window and each of its 50-byte strings, the smallest document of all windows that hold the string.

    Windows with a string in common hold it at the same distance from their anchors, so suffixes need to be sorted at
    every sixth byte from the anchor only: symbols are six bytes, a string starts up to five bytes before one.  The
    strings of one such remainder that follow each other in suffix order and agree in all bytes are a class.
    """
    sizes = np.array([len(w) for w in windows], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(windows) + bytes(64), np.uint8)
    word = _words8(data)
    # symbols of all windows, each window closed by one more place
    shift = anchor % STEP
    counts = (sizes - shift + STEP - 1) // STEP
    ends = np.cumsum(counts + 1) - 1
    owner = np.repeat(np.arange(len(windows)), counts + 1)
    inner = np.arange(len(owner)) - np.repeat(ends - counts, counts + 1)
    place = starts[owner] + shift[owner] + STEP * inner
    symbol = (word[place] & np.uint64((1 << 8 * STEP) - 1)).byteswap() >> np.uint64(64 - 8 * STEP)
    over = place + STEP - (starts + sizes)[owner]  # bytes past the window's end count as 0
    over = np.clip(over, 0, STEP).astype(np.uint64)
    symbol = (symbol >> (np.uint64(8) * over)) << (np.uint64(8) * over)
    _, code = np.unique(symbol, return_inverse=True)
    order = suffix_array(code + 1, ends, int(code.max(initial=0)) + 1)
    closing = np.zeros(len(owner), bool)
    closing[ends] = True
    order = order[~closing[order]]
    result = [np.empty(int(n), np.int64) for n in strings]
    flat = np.empty(int(strings.sum()), np.int64)
    base = np.cumsum(strings) - strings
    for r in range(STEP):
        at = place[order] - r - starts[owner[order]]  # the string's place in its window
        use = order[(at >= 0) & (at < strings[owner[order]])]
        if not len(use):
            continue
        q, who = place[use], owner[use]
        tail = LENGTH - r
        same = word[q[1:] + tail - 8] == word[q[:-1] + tail - 8]
        for j in range(0, tail - 8, 8):
            same &= word[q[1:] + j] == word[q[:-1] + j]
        group = np.concatenate([[0], np.cumsum(~same)])
        if r:
            lead = word[q - r] & np.uint64((1 << (8 * r)) - 1)
            _, group = np.unique(group.astype(np.uint64) << np.uint64(8 * STEP - 8) | lead, return_inverse=True)
        least = np.full(int(group.max()) + 1, NO_ID)
        np.minimum.at(least, group, low[who])
        flat[base[who] + q - r - starts[who]] = least[group]
    for k in range(len(windows)):
        result[k] = flat[base[k] : base[k] + strings[k]]
    return result


def _judge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Per bucket of windows: the smallest document of every string, sent to the groups that may have to remove some."""
    keys, windows = rows.column("key").to_pylist(), rows.column("window").to_pylist()
    anchor, strings = rows.column("anchor").to_pylist(), rows.column("strings").to_pylist()
    low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
    distinct: dict[tuple, int] = {}
    number = [distinct.setdefault(x, len(distinct)) for x in zip(keys, windows, anchor, strings)]
    least = np.full(len(distinct), NO_ID)
    np.minimum.at(least, np.array(number, np.int64), low)
    parts = list(distinct)
    held: dict[int, int] = {}
    for k, *_ in parts:
        held[k] = held.get(k, 0) + 1
    several = sorted((i for i, p in enumerate(parts) if held[p[0]] > 1), key=lambda i: parts[i][0])
    classes: dict[int, np.ndarray] = {}
    chunk: list[int] = []
    size = 0
    for at, i in enumerate(several):  # one suffix array for some megabytes of whole keys
        chunk.append(i)
        size += len(parts[i][1])
        last = at + 1 == len(several)
        if last or size >= CHUNK_BYTES and parts[several[at + 1]][0] != parts[i][0]:
            got = string_classes(
                [parts[k][1] for k in chunk],
                np.array([parts[k][2] for k in chunk], np.int64),
                np.array([parts[k][3] for k in chunk], np.int64),
                least[chunk],
            )
            classes.update(zip(chunk, got))
            chunk, size = [], 0
    short: dict[int, bytes] = {}
    lowest: dict[int, int] = {}
    out = []
    refs, groups = rows.column("refs").to_pylist(), rows.column("_g").to_pylist()
    for row, i in enumerate(number):
        if i not in short:
            found = classes.get(i)
            if found is None:
                pairs, lowest[i] = [(parts[i][3], int(least[i]))], int(least[i])
            else:
                cut = np.flatnonzero(np.diff(found, prepend=found[0] - 1))
                pairs, lowest[i] = list(zip(np.diff(np.append(cut, len(found))).tolist(), found[cut].tolist())), int(found.min())
            short[i] = np.array(pairs, "<i8").tobytes()
        if lowest[i] < high[row]:
            out.append((groups[row], _CLASSES, refs[row], short[i]))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _SIDE_SCHEMA)] if out else _SIDE_SCHEMA.empty_table().columns, schema=_SIDE_SCHEMA)


def _removed(group: _Group) -> list[list[tuple[int, int]]]:
    """Maximal removed byte ranges of every document of the group (copies: not filled in)."""
    found: list[list[tuple[int, int]]] = [[] for _ in group.single]
    ids = group.single_ids.tolist()
    for refs, pairs in group.side[_CLASSES]:
        classes = np.frombuffer(pairs, "<i8").reshape(-1, 2).tolist()
        for d, start in np.frombuffer(refs, "<i4").reshape(-1, 2).tolist():
            at, doc_id, spans = start, ids[d], found[d]
            for n, least in classes:
                if least < doc_id:
                    spans.append((at, at + n + LENGTH - 1))
                at += n
    for k, spans in enumerate(found):
        if len(spans) > 1:
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    if b > merged[-1][1]:
                        merged[-1] = (merged[-1][0], b)
                else:
                    merged.append((a, b))
            found[k] = merged
    return found


def _whole(text: bytes) -> list[tuple[int, int]]:
    return [(0, len(text))] if len(text) >= LENGTH else []


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def _digest(text_col: str):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, side: pa.Table) -> pa.Table:
        group = _Group(docs, side, text_col)
        removed = _removed(group)
        rows = []
        for text, k, doc_id in zip(group.texts, group.number.tolist(), group.ids.tolist()):
            spans = _whole(text) if group.copy[k] else removed[k]
            gone = sum(b - a for a, b in spans)
            rows.append((None if doc_id == NO_ID else doc_id, len(text), gone, len(spans), hashlib.sha256(_kept(text, spans)).hexdigest()))
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _rewrite(names: list[str], text_col: str, length_col: str | None):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, side: pa.Table) -> pa.Table:
        group = _Group(docs, side, text_col)
        removed = _removed(group)
        old, texts, lengths = docs.column(text_col).to_pylist(), [], []
        for value, text, k in zip(old, group.texts, group.number.tolist()):
            spans = _whole(text) if group.copy[k] else removed[k]
            # a character that loses a byte goes as a whole
            texts.append(_kept(text, spans).decode("utf-8", "ignore") if spans else value)
            lengths.append(len(texts[-1]) if spans else None)
        columns = []
        for name in names:
            column = docs.column(name)
            if name == text_col:
                column = pa.array(texts, column.type)
            elif name == length_col:
                column = pa.array([new if new is not None else was for new, was in zip(lengths, column.to_pylist())], column.type)
            columns.append(column)
        return pa.table(columns, names=names)

    return run


def _plan(docs: DataFrame, id_col: str, text_col: str, groups: int | None, hot: int) -> tuple[DataFrame, DataFrame]:
    """The documents by group, and what steps 1 to 3 tell the groups."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    if groups is None:
        size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
        groups = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))
    buckets, spread = max(1, groups // 4), 4 * groups
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    dealt = docs.withColumns({"_doc": doc, "_rid": F.xxhash64(doc, body)}).withColumn("_g", F.pmod("_rid", F.lit(groups)).cast("long"))
    # whole copies: by digest, combined before the shuffle
    names = dealt.select("_doc", "_rid", "_g", F.sha2(body.cast("binary"), 256).alias("digest"))
    first = names.groupBy("digest").agg(F.min("_doc").alias("low"), F.max("_doc").alias("high")).filter("low < high")
    later = names.join(first, "digest").filter("_doc > low").select("_g", "_rid").distinct()
    none = F.lit(None).cast("binary")
    raw = F.unhex(F.lpad(F.hex("_rid"), 16, "0"))
    copies = later.select((F.col("_g") + F.lit(0)).alias("_g"), F.lit(_COPIES).alias("_kind"), raw.alias("_a"), none.alias("_b"))
    by = lambda df: df.groupBy("_g")
    told = by(dealt).cogroup(by(copies)).applyInArrow(_report(buckets, text_col), "_bucket bigint, _g bigint, keys binary, windows binary")
    shared = told.groupBy("_bucket").applyInArrow(_shared(hot), _SIDE)
    windows = by(dealt).cogroup(by(copies.union(shared))).applyInArrow(_windows(buckets, spread, text_col), _WINDOWS)
    classes = windows.groupBy("_bucket").applyInArrow(_judge, _SIDE)
    return dealt, copies.union(classes)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None, hot: int = HOT_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Strings are judged on the input.  A null text is empty.  Rows with the same id do not remove each other's strings;
    a null id counts as larger than every other one.  Texts below 50 bytes lose nothing.  Other columns are ignored; an
    empty table gives no rows.  ``groups`` follows the bytes of the texts (and is at least four times the shuffle partitions of the
    session); any number gives the result.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt, told = _plan(narrow, "doc_id", "text", groups, hot)
    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return dealt.groupBy("_g").cogroup(told.groupBy("_g")).applyInArrow(_digest("text"), out)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", groups: int | None = None, hot: int = HOT_WINDOWS
) -> DataFrame:
    """``docs`` with removed bytes cut out of the texts, and ``length_col`` set to the new number of characters.

    No row is dropped.  A character that loses a byte is removed as a whole.
    """
    dealt, told = _plan(docs, id_col, text_col, groups, hot)
    run = _rewrite(docs.columns, text_col, length_col)
    return dealt.groupBy("_g").cogroup(told.groupBy("_g")).applyInArrow(run, T.StructType(docs.schema.fields))
