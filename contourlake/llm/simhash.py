"""SimHash near-duplicates: deletion-variant signatures, an equality join on them, and an exact check of each pair.

Fingerprints of 64 bits link at up to four differing bits.  Cut into three segments, one of them differs by at most
one bit; so two linked fingerprints agree on some segment with one of its bits left out.  Every fingerprint is indexed
under its 64 one-wildcard segment variants.  Equal texts and equal fingerprints are merged first.

Near copies crowd under the same keys, so no key's pairs are listed.  First every member of a key is checked against a
few members drawn from the key only, and what that links is merged (components).  Then only members of different
components can add anything: per key, the members outside its largest component meet all its members.  A key whose
members are one component costs nothing more, and every link between different components is still found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, stored, text_list
from .components import components

SHINGLE = 4
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
STARS = 4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is set if over half of the shingle hashes have it; 0 for a text without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    set_bits = bits.sum(axis=0, dtype=np.uint32) * 2 > len(hashes)
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, out: str = "_fp") -> DataFrame:
    """``docs`` with the fingerprint appended as a signed long; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text_col, 4 << 20):
            values = np.array([fingerprint(t, shingle) for t in text_list(part.column(text_col))], np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values.view(np.int64))], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def _variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: its segment without one bit, and which bit that is."""
    keys = []
    for start, width in SEGMENTS:
        part = F.shiftrightunsigned(fp, start)
        for bit in range(width):
            mask = ((1 << width) - 1) ^ (1 << bit)
            keys.append((F.shiftleft(part.bitwiseAND(F.lit(mask).cast("long")), 6) + F.lit(start + bit)).cast("int"))
    return F.array(*keys)


def near(a: Column | str, b: Column | str, distance: int = DISTANCE) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def classes(nodes: DataFrame, distance: int = DISTANCE, stars: int = STARS) -> DataFrame:
    """(fp, component) for distinct fingerprints: component is the smallest (signed) fingerprint reachable by links.

    Fingerprints without a link are left out.  ``distance`` is at most 4 (three segments, one wildcard each).
    """
    if not 0 <= distance <= 4:
        raise ValueError("three segments with one wildcard find links of up to 4 bits")
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    keyed = nodes.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    by_key = W.partitionBy("key")
    drawn = [F.min(F.struct(F.xxhash64("fp", "key", F.lit(i)).alias("h"), "fp")).over(by_key)["fp"] for i in range(stars)]
    starred = keyed.select("fp", F.array(*drawn).alias("drawn"))
    linked = F.filter("drawn", lambda d: (d != F.col("fp")) & near(F.col("fp"), d, distance))
    links = starred.select("fp", F.explode(F.array_distinct(linked)).alias("to"))
    merged = stored(components(links.select(*pair("fp", "to")).distinct()), "merged")

    placed = nodes.join(merged.select(F.col("node").alias("fp"), "component"), "fp", "left")
    placed = placed.select("fp", F.coalesce("component", "fp").alias("c")).select("fp", "c", F.explode(_variants(F.col("fp"))).alias("key"))
    size = F.count(F.lit(1)).over(W.partitionBy("key", "c"))
    sized = placed.withColumn("n", size).withColumn("main", F.max(F.struct("n", "c")).over(by_key)["c"])
    others = sized.filter("c <> main").select(F.col("key").alias("k"), F.col("fp").alias("f"), F.col("c").alias("d"))
    met = placed.join(others, (F.col("key") == F.col("k")) & (F.col("c") != F.col("d")) & near("fp", "f", distance))
    joined = stored(components(met.select(*pair("c", "d")).distinct()), "joined")
    every = merged.select(F.col("node").alias("fp"), F.col("component").alias("c")).union(
        joined.select(F.col("node").alias("fp"), F.col("node").alias("c"))
    )
    top = joined.select(F.col("node").alias("c"), F.col("component").alias("top"))
    # a node of ``joined`` is the smallest of its first component, so both rows of it name the same one
    return every.join(top, "c", "left").select("fp", F.coalesce("top", "c").alias("component")).distinct()


def _named(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id) of every fingerprint in ``prints`` (doc_id, fp)."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    top = stored(classes(nodes.select("fp"), distance), "classes")
    grouped = nodes.join(top, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    ids = grouped.groupBy("c").agg(F.min("low").alias("component_id"))
    return grouped.join(ids, "c").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable).

    Texts without words (null, empty, blank) have fingerprint zero and are linked like any other.  Null ids count only
    where a component has no other id (component_id is then null).  Repeated rows give one row each; other columns are
    ignored; an empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(fingerprints(narrow, "text", shingle, "fp").select("doc_id", "fp"), "fingerprints")
    named = _named(prints, distance)
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` without near copies: of every component the document of the smallest id stays.

    Rows with a null id stay only in components without any other id (all of them); rows that repeat id and text stay
    or go together.  The rows to drop are named by a hash of id and text, so only that is joined.
    """
    row = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row.alias("row"))
    prints = stored(fingerprints(narrow, "text", shingle, "fp").select("doc_id", "row", "fp"), "fingerprints")
    named = _named(prints, distance)
    drop = prints.join(named, "fp").filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("row").alias("_row")).distinct()
    return docs.join(drop, row == F.col("_row"), "left_anti")
