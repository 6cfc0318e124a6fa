"""Phrase collocations by set-oriented relational mining (SETM).

The relation of level k holds, sorted by piece and position, the occurrences of the frequent phrases of k words.  Joined
with itself on piece and adjacent position it gives the occurrences of phrases of k + 1 words; these are counted by
group, and the semi-join with the frequent groups makes the next level's relation.

A relation is persisted in blocks of about ``BLOCK_BYTES`` of text, each one row of group numbers in order of piece and
position (-1: a gap, where a piece ends or an occurrence is not frequent).  Both sides of the merge join lie sorted in
the same block; what is shuffled are a block's distinct groups with their counts, and the relation once a level to meet the
block's frequent groups.  A level is deleted when the next one is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_table
from .common import dropped, stored, text_list

BLOCK_BYTES = 8 << 20
MIN_COUNT, MAX_WORDS, KEEP, COVER = 10, 3, 2000, 50
#: Groups in which a language's phrases are ranked first.
SALTS = 64

_FORM = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_FIRST = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("relation", pa.binary())])
_LEVEL = pa.schema([("block", pa.int64()), ("relation", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.binary())])


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.tobytes())


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


class _Codes(dict):
    """Numbers of the words of one language, given in order of first sight; empty words are 0, ends of pieces 1."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str]):
        super().__init__({b"": 0, b"\n": 1})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.words) + 2
        self.words.append(word)
        self.langs.append(self.lang)
        return code


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut at ends of pieces only."""
    start = 0
    while len(text) - start > size:
        end = text.find(b"\n", start + size)
        if end < 0:
            break
        yield text[start:end]
        start = end + 1
    yield text[start:]


def words(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The relation of level 1 over ``docs`` (lang, text), and its groups (lang, word) with their counts by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() + 1) << 32
        found: list[bytes] = []
        langs: list[str] = []
        by_lang: dict[str, _Codes] = {}
        parts: list[np.ndarray] = []
        size = 0

        def full() -> pa.RecordBatch:
            codes = np.concatenate(parts)
            codes = codes[codes > 0] - 2
            n = np.bincount(codes[codes >= 0], minlength=len(found)).astype(np.int64)
            text = pa.array(found, pa.binary()).cast(pa.string())
            size = len(found) + 1  # the block's words, one row each, and its relation in a last row
            rows = [pa.array(np.full(size, block)), pa.array(np.arange(size, dtype=np.int32)), pa.array([*langs, None], pa.string())]
            rows += [pa.concat_arrays([text, pa.nulls(1, pa.string())]), pa.array(np.r_[n, 0]), pa.array([None] * len(found) + [_packed(codes)], pa.binary())]
            return pa.RecordBatch.from_arrays(rows, schema=_FIRST)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), text_list(batch.column("text"))):
                lang = "und" if lang is None else lang
                codes = by_lang.setdefault(lang, _Codes(lang, found, langs))
                for part in _parts(text.translate(_FORM), block_bytes):
                    marked = part.replace(b"\n", b" \n ").split(b" ")
                    marked.append(b"\n")
                    parts.append(np.fromiter(map(codes.__getitem__, marked), np.int32, len(marked)))
                    size += len(part)
                    if size >= block_bytes:
                        yield full()
                        block, size = block + 1, 0
                        found, langs, parts = [], [], []
                        by_lang = {}
                        codes = by_lang.setdefault(lang, _Codes(lang, found, langs))
        if parts:
            yield full()

    return docs.mapInArrow(run, "block long, code int, lang string, word string, n long, relation binary")


def extended(relation: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One block's relation of the next level: (relation, left ids, right ids, counts).

    ``codes`` are the block's frequent groups and ``ids`` their names: occurrences of others are left out (semi-join);
    what remains is merge-joined with itself on adjacent positions.
    """
    size = int(max(relation.max(initial=-1), codes.max(initial=-1))) + 1
    known = np.full(size + 1, -1, np.int64)  # the last place answers for gaps
    known[codes] = np.arange(len(codes))
    at = known[relation]
    out = np.full(len(relation), -1, np.int64)
    here = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0)) if len(at) else np.zeros(0, np.int64)
    key = at[here] * max(1, len(codes)) + at[here + 1]
    groups, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    out[here] = inverse
    return out, ids[groups // max(1, len(codes))], ids[groups % max(1, len(codes))], n


def _next(relation: DataFrame, frequent: DataFrame) -> DataFrame:
    """The relation of the next level and its groups, a row per block, from ``relation`` and ``frequent`` (block, code, id)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, raw in zip(left.column("block").to_pylist(), left.column("relation").to_pylist()):
            codes, ids = right.column("code").to_numpy(), right.column("id").to_numpy()
            by = np.argsort(ids)  # groups then come in order of the left name, so that its steps are small
            got = extended(_unpacked(raw, np.int32), codes[by], ids[by])
            cells = (got[0].astype(np.int32), np.diff(got[1], prepend=0), got[2], got[3].astype(np.int64))
            out.append({"block": block} | dict(zip(("relation", "left", "right", "n"), map(_packed, cells))))
        return pa.Table.from_pylist(out, _LEVEL)

    asked = frequent.select(F.col("block").alias("at"), "code", "id")
    schema = "block long, relation binary, left binary, right binary, n binary"
    return relation.select("block", "relation").groupBy("block").cogroup(asked.groupBy("at")).applyInArrow(run, schema)


def _groups(level: DataFrame) -> DataFrame:
    """(block, code, left, right, n): the groups of a level, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *raw in zip(*(batch.column(c).to_pylist() for c in ("block", "left", "right", "n"))):
                steps, right, n = (_unpacked(r, np.int64) for r in raw)
                columns = [np.full(len(n), block), np.arange(len(n), dtype=np.int32), np.cumsum(steps), right, n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "code", "left", "right", "n"])

    return level.select("block", "left", "right", "n").mapInArrow(run, "block long, code int, left long, right long, n long")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, block_bytes: int = BLOCK_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1 to ``max_words`` words, and (lang, n): all word occurrences.

    A table has id, lang, phrase, last (its last word), f, heads (f of its first 1, 2, ... words), tails (f of what
    starts at its first, second, ... word), left and right (ids of the phrases without its last and first word).
    """
    narrow = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch_table(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    relation, path = kept(words(narrow, block_bytes), "setm-1")
    own = relation.filter("word is not null").select("block", "code", "lang", "word", "n")
    relation = relation.filter("relation is not null")
    counts = own.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    totals = stored(own.groupBy("lang").agg(F.sum("n").alias("n")), "setm-totals")
    table = counts.filter(F.col("f") >= min_count).select(
        F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f",
        F.array("f").alias("heads"), F.array("f").alias("tails"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"),
    )
    tables = [stored(table, "setm-frequent-1")]
    first = tables[0].select("id", "lang", F.col("phrase").alias("word"))
    answer = own.join(first, ["lang", "word"]).select("block", "code", "id")
    for k in range(2, max_words + 1):
        level, made = kept(_next(relation, answer), f"setm-{k}")
        dropped(spark, path)  # the level before is not read again
        own, relation, path = _groups(level), level, made
        summed = stored(own.groupBy("left", "right").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count), f"setm-kept-{k}")
        head, tail = (tables[-1].select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("lang", "phrase", "last", "heads", "tails"))) for s in ("left", "right"))
        table = summed.join(head, "left").join(tail, "right").select(
            F.monotonically_increasing_id().alias("id"), F.col("left_lang").alias("lang"), F.concat_ws(" ", "left_phrase", "right_last").alias("phrase"), F.col("right_last").alias("last"), "f",
            F.concat("left_heads", F.array("f")).alias("heads"), F.concat(F.array("f"), "right_tails").alias("tails"), "left", "right",
        )
        tables.append(stored(table, f"setm-frequent-{k}"))
        names = tables[-1].select("id", "left", "right")
        answer = own.join(names, ["left", "right"]).select("block", "code", "id")
    dropped(spark, path)
    return tables, totals


def _score(f: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * f * f / (left * right)) in decimals, exact for counts below 10^15."""
    wide = [c.cast("decimal(15,0)") for c in (f, left, right)]
    over = (F.lit(1_000_000).cast("decimal(7,0)") * (wide[0] * wide[0]).cast("decimal(30,0)")).cast("decimal(37,0)")
    return F.call_function("div", over, (wide[1] * wide[2]).cast("decimal(30,0)"))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    keep: int = KEEP,
    cover: int = COVER,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per language the first ``keep`` phrases by score: lang, rank, phrase, a, l, r, n, score (see README for the terms).

    A phrase goes if a longer candidate has its words and ``cover`` hundredths of its occurrences; of longer candidates
    those of one word more decide, as no longer one is more frequent.  Null texts are empty, a null language is ``und``
    (and meets the rows of that name); repeated rows count as often as they stand; other columns are ignored; a text of
    any length is cut at ends of pieces only.  Equal scores and counts are ordered by the bytes of the phrase, so ranks
    are unique; a table without frequent phrases (an empty one too) gives no rows.
    """
    tables, totals = phrases(docs, text_col, lang_col, min_count, max_words, block_bytes)
    found = None
    for k, table in enumerate(tables[1:], 2):
        cuts = F.array(*(F.struct(_score(F.col("f"), F.col("heads")[i - 1], F.col("tails")[i]).alias("score"), F.lit(i).alias("k"), F.col("heads")[i - 1].alias("l"), F.col("tails")[i].alias("r")) for i in range(1, k)))
        scored = table.select("id", "lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
        if k < max_words:
            longer = tables[k].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
            scored = scored.join(longer, "id", "left").filter(F.coalesce(100 * F.col("most") < cover * F.col("a"), F.lit(True)))
        scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        found = scored if found is None else found.unionByName(scored)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= keep)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep)
    return last.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
