"""Token counts of whole texts: huge documents in overlapping chunks, spliced where a token must end.

A token covers two neighbouring characters only if some piece of the vocabulary holds them side by side.  A place
between two characters that no piece joins is therefore a token boundary in every text around it, and merging left of
it never depends on what stands right of it.  Overlapping chunks are spliced at such places only, and only if both
chunks' encodings show the boundary there; otherwise the overlap is widened, up to the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, record, text_list

MODEL = "piece_bpe_32k.model"
CHUNK = 1 << 15
OVERLAP = 256

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def _load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    joined = set()
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            p = model.id_to_piece(i).replace("▁", " ")
            joined.update(a + b for a, b in zip(p, p[1:]))
    return model, joined


def boundaries(model, text: str) -> list[int]:
    """First character of every token; the byte pieces of one unknown character share theirs."""
    return [a for a, _ in model.encode(text, return_type="offset_mapping", num_threads=1)["offsets"]]


def count_spliced(text: str, model, joined: set[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of ``text``, from chunks of about ``chunk`` characters that overlap by ``overlap`` or more.

    A chunk counts the tokens between the splice before it and the splice after it.  A splice is a place inside the
    overlap where no piece can cross and both chunks start a token; what a chunk shows left of its first splice (the
    model's leading mark included) is not counted.  Without a splice the overlap doubles to the left, then the left
    chunk grows, at most to the end of the text, so any chunk size gives the count of one encoding of the whole text.
    """
    total, start, cut, n = 0, 0, 0, len(text)
    chunk, overlap = max(chunk, 2), max(2, min(overlap, chunk))
    size, wide = chunk, overlap
    left = boundaries(model, text[:size])
    while start + size < n:
        end = start + size
        low = max(cut, end - wide)
        right = boundaries(model, text[low : low + chunk])
        at = _splice(text, start, low, end, left, right, joined)
        if at is None:
            if low > cut:
                wide *= 2
            else:
                size, wide = 2 * size, overlap
                left = boundaries(model, text[start : start + size])
            continue
        total += sum(1 for x in left if cut <= x + start < at)
        start, cut, size, wide, left = low, at, chunk, overlap, right
    return total + sum(1 for x in left if x + start >= cut)


def _splice(text: str, start: int, low: int, end: int, left: list[int], right: list[int], joined: set[str]) -> int | None:
    """The first place in (low, end) that no piece crosses and where both encodings start a token."""
    ours, theirs = {x + start for x in left}, {x + low for x in right}
    for i in range(low + 1, end):
        if text[i - 1 : i + 1] not in joined and i in ours and i in theirs:
            return i
    return None


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str | None = None,
    limit: int = 4096,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens).  Repeated and null ids give one row each; other columns are
    ignored, whatever their names.  An empty table gives an empty table.  Texts above ``chunk`` characters are encoded
    in overlapping chunks; the model path must be readable by the executors.
    """
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, joined = _load(path)
        for part in pieces(batches, "text", 4 << 20):
            texts = part.column("text").fill_null("").to_pylist()
            small = [t if len(t) <= chunk else "" for t in texts]
            counts = [len(x) for x in sp.encode(small, num_threads=1)]
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    counts[i] = count_spliced(t, sp, joined, chunk, overlap)
            sizes = [len(b) for b in text_list(part.column("text"))]
            yield record(SCHEMA, doc_id=part.column("doc_id"), n_bytes=sizes, n_tokens=counts)

    out = T.StructType.fromDDL("doc_id bigint, n_bytes bigint, n_tokens bigint")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
