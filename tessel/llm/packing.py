"""Packing of token sequences by non-negative least squares.

Each document's ids (with an end id) are cut into windows of ``size`` ids; what
is left over, shorter than a window, is packed:

1. The histogram of left-over lengths (at most ``size - 1`` numbers, whatever
   the corpus) goes to the driver. Shallow patterns are enumerated: one length
   that is a power of two, two lengths, or three lengths of which two are
   frequent, that fill a window exactly.
2. Non-negative least squares by coordinate descent finds how often to repeat
   each pattern so that the histogram is met; the counts are rounded and
   clipped to what is there.
3. Residual left-overs are packed greedily end to end and cut at window ends;
   the last window is cut at powers of two. So no window is padded.

A document's rank among those of its length decides its pattern; ranks and
running totals are found in hash buckets, so no window spans the table and no
length is collected anywhere.

Defined results: a null or empty text holds only the end id; rows that share a
doc_id are packed each for themselves; an empty table gives no piece; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import materialize, prefix_sum, table, tidy

FREQUENT = 64  # lengths from which patterns of three are made


def patterns_of(hist: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths present in ``hist`` (count by length) that need no padding."""
    have = {int(x) for x in np.flatnonzero(hist)}
    found = [(x,) for x in sorted(have) if x & (x - 1) == 0]
    found += [(a, size - a) for a in sorted(have) if a <= size - a and size - a in have]
    top = sorted(have, key=lambda x: (-hist[x], x))[:FREQUENT]
    found += sorted({tuple(sorted((a, b, size - a - b))) for a in top for b in top if size - a - b in have})
    return found


def solve(hist: np.ndarray, patterns: list[tuple[int, ...]], sweeps: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of the packed to the given histogram."""
    cols = [(np.array(sorted(set(p))), np.array([p.count(v) for v in sorted(set(p))], float)) for p in patterns]
    x, left = np.zeros(len(patterns)), hist.astype(float).copy()
    for _ in range(sweeps):
        moved = 0.0
        for j, (rows, mult) in enumerate(cols):
            step = max(-x[j], float(left[rows] @ mult) / float(mult @ mult))
            if step:
                x[j] += step
                left[rows] -= step * mult
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(hist: np.ndarray, size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, ranks, first sequence, offset) and the number of sequences they fill."""
    pats = patterns_of(hist, size)
    x = solve(hist, pats)
    left, used, rows, seq = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64), [], 0
    for j in sorted(range(len(pats)), key=lambda j: (-x[j], pats[j])):
        p = pats[j]
        k = min(int(round(x[j])), *(int(left[v]) // p.count(v) for v in p))
        if k <= 0:
            continue
        at = 0
        for v in p:
            rows.append((v, int(used[v]), k, seq, at))
            used[v] += k
            left[v] -= k
            at += v
        seq += k
    return rows, seq


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values between neighbouring byte offsets of ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _count(path: str, end_id: int, size: int):
    """Per document its length, the checksums of its windows, and the ids of what is left over (in two bytes each where all ids fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._tokens import encode_slices, encoder, spans

        kind = _kind(encoder(path).n_ids)
        for b in batches:
            ids = b.column("doc_id")
            for a, flat, offs in encode_slices(b.column("text"), path, end_id):
                n = np.diff(offs)
                image = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
                crcs = [[zlib.crc32(image[4 * i : 4 * min(i + size, z)]) for i in range(s, z, size)] for s, z in zip(offs[:-1].tolist(), offs[1:].tolist())]
                rest = flat[spans(offs[1:] - n % size, n % size)].astype(kind)
                left = _binary(rest, np.concatenate([[0], np.cumsum(n % size)]) * rest.itemsize)
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(n)), pa.array(n), pa.array(crcs, pa.list_(pa.int64())), left], ["doc_id", "doc_tokens", "crcs", "ids"])

    return run


def _kind(n_ids: int) -> str:
    return "<u2" if n_ids <= 1 << 16 else "<u4"


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _checksums(path: str):
    """Pieces with the checksum of their part (from ``begin``) of the left-over ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._tokens import encoder

        kind = np.dtype(_kind(encoder(path).n_ids))
        for b in batches:
            sums = [zlib.crc32(np.frombuffer(x, kind, n, s * kind.itemsize).astype("<u4").tobytes()) for x, s, n in zip(*(b.column(c).to_pylist() for c in ("ids", "begin", "length")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("length"), pa.array(sums, pa.int64()), b.column("doc_tokens"), b.column("sequence_id"), b.column("offset")], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = docs.mapInArrow(tidy(_count(tokenizer, end_id, size)), "doc_id long, doc_tokens long, crcs array<long>, ids binary")
    d = materialize(counted.withColumn("row", F.monotonically_increasing_id()), "packing-counts")
    d = d.withColumn("full", F.expr(f"doc_tokens div {size}")).withColumn("rest", (F.col("doc_tokens") % size).cast("int"))

    hist, n_full = np.zeros(size, np.int64), 0
    for r in d.groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("f")).collect():  # one row per length below size
        hist[r["rest"]] = r["n"]
        n_full += r["f"]
    hist[0] = 0
    rows, n_planned = plan(hist, size)

    full = prefix_sum(d.where("full > 0").select("row", "doc_id", "doc_tokens", "crcs", "full"), "row", "full", "at")
    full = full.select("doc_id", "doc_tokens", "at", F.posexplode(F.slice("crcs", F.lit(1), F.col("full").cast("int"))).alias("j", "ids_crc32"))
    full = full.select(
        "doc_id", (F.col("j") * F.lit(size)).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("at") + F.col("j")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )

    rest = d.where("rest > 0").select("row", "doc_id", "doc_tokens", "crcs", "full", "rest")
    b = rest.withColumn("_b", F.pmod(F.xxhash64("row"), F.lit(1024)))
    before = b.groupBy("rest", "_b").count()
    before = before.select("rest", "_b", (F.sum("count").over(W.partitionBy("rest").orderBy("_b")) - F.col("count")).alias("_before"))
    ranked = b.withColumn("_in", F.row_number().over(W.partitionBy("rest", "_b").orderBy("row")) - 1).join(before, ["rest", "_b"])
    ranked = ranked.withColumn("rank", F.col("_before") + F.col("_in")).drop("_b", "_before", "_in")
    slots = spark.createDataFrame(rows, "rest int, first long, ranks long, seq long, slot long")  # bounded by the window size
    inside = (ranked["rest"] == slots["rest"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    placed = materialize(ranked.join(F.broadcast(slots), inside, "left").drop(slots["rest"]), "packing-placed")
    last = F.element_at("crcs", -1)
    good = placed.where("seq is not null").select(
        "doc_id", (F.col("full") * size).alias("start"), F.col("rest").cast("long").alias("length"), last.alias("ids_crc32"), "doc_tokens",
        (F.lit(n_full) + F.col("seq") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("slot").alias("offset"),
    )

    res = prefix_sum(placed.where("seq is null").select("row", "doc_id", "doc_tokens", "crcs", "full", F.col("rest").cast("long").alias("rest")), "row", "rest", "at")
    total = sum(int(h) * v for v, h in enumerate(hist)) - sum(r[0] * r[2] for r in rows)
    tail, ends = total % size, []
    for bit in range(size.bit_length(), -1, -1):  # the last window's powers of two
        if tail >> bit & 1:
            ends.append((ends[-1] if ends else total - tail) + (1 << bit))
    # Starts of sequences that lie inside a left-over, and its own start.
    wins = F.filter(F.sequence(F.expr(f"(at div {size}) * {size}"), F.col("at") + F.col("rest") - 1, F.lit(size).cast("long")), lambda x: x > F.col("at"))
    tails = F.filter(F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array().cast("array<long>"), lambda x: (x > F.col("at")) & (x < F.col("at") + F.col("rest")))
    res = res.withColumn("cuts", F.array_sort(F.array_union(F.array("at"), F.array_union(wins, tails))))
    res = res.withColumn("next", F.concat(F.slice("cuts", 2, F.size("cuts")), F.array(F.col("at") + F.col("rest"))))
    res = materialize(res, "packing-residual")
    n_win = total // size
    seq = F.expr(f"a div {size}") + n_full + n_planned
    off = F.expr(f"a % {size}")
    for i, e in enumerate(ends):
        s = ends[i - 1] if i else total - tail
        here = (F.col("a") >= s) & (F.col("a") < e)
        seq = F.when(here, F.lit(n_full + n_planned + n_win + i)).otherwise(seq)
        off = F.when(here, F.col("a") - s).otherwise(off)
    parts = res.select("row", "doc_id", "doc_tokens", "full", "at", last.alias("crc"), F.size("cuts").alias("k"), F.inline(F.arrays_zip(F.col("cuts").alias("a"), F.col("next").alias("z"))))
    parts = parts.select(
        "row", "doc_id", (F.col("full") * size + F.col("a") - F.col("at")).alias("start"), (F.col("z") - F.col("a")).alias("length"), "crc", "k",
        "doc_tokens", seq.cast("long").alias("sequence_id"), off.cast("long").alias("offset"), (F.col("a") - F.col("at")).alias("begin"),
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = parts.where("k = 1").withColumnRenamed("crc", "ids_crc32").select(names)
    # Parts of cut left-overs, about two a window of these, meet their ids; Spark chooses the join by their size.
    cut = parts.where("k > 1").join(d.select("row", "ids"), "row").select("ids", "begin", "length", "doc_id", "start", "doc_tokens", "sequence_id", "offset")
    parts = whole.unionByName(cut.mapInArrow(tidy(_checksums(tokenizer)), _PIECE))
    return full.unionByName(good).unionByName(parts)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
