"""Words of a slice of texts as codes into the slice's distinct words (Arrow and numpy, inside a task)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    first: int  # position of the first text in its batch
    n: int  # texts
    row: np.ndarray  # text of each word
    code: np.ndarray  # distinct word of each word
    uniq: pa.Array  # distinct words


def word_slices(texts: pa.Array, size: int = 3_000_000) -> Iterator[Words]:
    """Slices of about ``size`` bytes of text; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bytes_ = np.asarray(pc.binary_length(texts), dtype=np.int64)
    group = np.cumsum(bytes_) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(cuts, cuts[1:]):
        flat = pc.replace_substring_regex(texts.slice(a, b - a), r"[\x09-\x0D]", " ")
        parts = pc.split_pattern(flat, " ")
        row = np.repeat(np.arange(b - a), np.diff(np.asarray(parts.offsets, dtype=np.int64)))
        enc = pc.dictionary_encode(parts.values)
        code = np.asarray(enc.indices, dtype=np.int64)
        blank = pc.equal(enc.dictionary, "").to_numpy(zero_copy_only=False)
        keep = ~blank[code]
        yield Words(a, b - a, row[keep], code[keep], enc.dictionary)


def sample_labels(labels, label: str, rows: int):
    """At most ``rows`` training labels (doc_id, y), one per doc_id, in hash order; ids whose crc32 is divisible by 5 are left out.

    Nulls in either column take no part; of several labels of a document the largest counts.
    """
    from pyspark.sql import functions as F

    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs, labels, label: str, rows: int):
    """(doc_id, text, y) of the labels of :func:`sample_labels`: ``rows`` rows at most, as of documents that share an id the one whose text has the smallest hash counts."""
    from pyspark.sql import functions as F

    known = docs.select("doc_id", "text").join(F.broadcast(sample_labels(labels, label, rows)), "doc_id")
    return known.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y"))


def held_out(doc_id):
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
