"""Token files: patched frame-of-reference blocks.

Documents are encoded, ended by one id and written in ascending doc_id order as
shards. A shard is one byte string:

    magic "TFR1" | block size u2 | documents u4 | ids u8 | blocks u4
    doc_id i8 each | doc_id known u1 each | ids per document u4 each
    byte offset of each block u4
    blocks: minimum u4 | width u1 | exceptions u2 | packed differences |
            exception positions u2 each | exception differences u4 each

All numbers are little-endian. A block's differences to its minimum are packed
at the width that holds a share ``percentile`` of them, eight numbers in as many
bytes as the width has bits; larger ones leave their low bits in place and are
patched from the exception list. A token file is a Parquet file whose rows are
shards (part, seq, n_docs, n_ids, image), so that Spark's commit protocol
protects it and any store works.

Defined results: a null or empty text gives only the end id; rows with a null
doc_id come first; rows that share a doc_id are written one after the other, in
the order of their texts; an empty table gives no shard; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import partitions, shared_dir, table, tidy

BLOCK = 256
_HEAD = np.dtype([("magic", "S4"), ("block", "<u2"), ("docs", "<u4"), ("ids", "<u8"), ("blocks", "<u4")])
_BLOCK_HEAD = 7
_LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each number below 2**32."""
    return _LENGTHS[x] if not x.size or x.max() < 1 << 16 else np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """Rows of numbers below 2**w, eight of them in w bytes, the lowest bits first."""
    v = v.astype(np.uint64).reshape(len(v), -1, 8)
    words = np.zeros((*v.shape[:2], -(-w // 8)), np.uint64)
    for j in range(8):
        at, low = divmod(j * w, 64)
        words[:, :, at] |= v[:, :, j] << np.uint64(low)
        if low + w > 64:
            words[:, :, at + 1] |= v[:, :, j] >> np.uint64(64 - low)
    return np.ascontiguousarray(words.astype("<u8", copy=False).view(np.uint8)[:, :, :w]).reshape(len(v), -1)


def _unpack(raw: np.ndarray, w: int) -> np.ndarray:
    """The numbers of :func:`_pack`."""
    image = np.zeros((len(raw), raw.shape[1] // w, 8 * -(-w // 8)), np.uint8)
    image[:, :, :w] = raw.reshape(len(raw), -1, w)
    words, mask = image.view("<u8"), np.uint64((1 << w) - 1)
    out = np.empty((*image.shape[:2], 8), np.uint32)
    for j in range(8):
        at, low = divmod(j * w, 64)
        v = words[:, :, at] >> np.uint64(low)
        if low + w > 64:
            v = v | words[:, :, at + 1] << np.uint64(64 - low)
        out[:, :, j] = v & mask
    return out.reshape(len(raw), -1)


def _places(start: np.ndarray, n: int) -> np.ndarray:
    return start[:, None] + np.arange(n)


def pack_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the blocks (a multiple of eight numbers each), and their bytes."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u4"), np.zeros(0, np.uint8)
    k = -(-n // block)
    m = np.full(k * block, ids[-1], np.uint32)
    m[:n] = ids
    m = m.reshape(k, block)
    low = m.min(axis=1)
    diff = m - low[:, None]
    need = _bits(diff)
    width = np.sort(need, axis=1)[:, min(block - 1, int(percentile * block))]
    row, pos = np.nonzero(need > width[:, None])
    exceptions = np.bincount(row, minlength=k)
    packed = block // 8 * width.astype(np.int64)
    sizes = _BLOCK_HEAD + packed + 6 * exceptions
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    out[_places(at, 4)] = low.astype("<u4").view(np.uint8).reshape(k, 4)
    out[at + 4] = width
    out[_places(at + 5, 2)] = exceptions.astype("<u2").view(np.uint8).reshape(k, 2)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        for r, x in zip((at[rows] + _BLOCK_HEAD).tolist(), _pack(diff[rows] & np.uint32((1 << w) - 1), w)):
            out[r : r + len(x)] = x
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        first = (at + _BLOCK_HEAD + packed)[row]
        out[_places(first + 2 * nth, 2)] = pos.astype("<u2").view(np.uint8).reshape(-1, 2)
        out[_places(first + 2 * exceptions[row] + 4 * nth, 4)] = diff[row, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return at.astype("<u4"), out


def unpack_ids(raw: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids of :func:`pack_ids`; ``offsets`` are those of the blocks in ``raw``."""
    k = len(offsets)
    out = np.zeros((k, block), np.uint32)
    if k:
        at = offsets.astype(np.int64)
        low = raw[_places(at, 4)].view("<u4").ravel()
        width = raw[at + 4].astype(np.int64)
        exceptions = raw[_places(at + 5, 2)].view("<u2").ravel().astype(np.int64)
        for w in np.unique(width[width > 0]).tolist():
            rows = np.flatnonzero(width == w)
            out[rows] = _unpack(raw[_places(at[rows] + _BLOCK_HEAD, block // 8 * w)], w)
        row = np.repeat(np.arange(k), exceptions)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        first = (at + _BLOCK_HEAD + block // 8 * width)[row]
        pos = raw[_places(first + 2 * nth, 2)].view("<u2").ravel()
        out[row, pos] = raw[_places(first + 2 * exceptions[row] + 4 * nth, 4)].view("<u4").ravel()
        out += low[:, None]
    return out.ravel()[:n]


def write_shard(doc_ids: pa.Array, lens: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One shard of documents of these lengths, whose ids follow each other (the format in the module's docstring)."""
    offsets, blocks = pack_ids(ids, block)
    head = np.array([(b"TFR1", block, len(lens), len(ids), len(offsets))], _HEAD)
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
    return b"".join([head.tobytes(), doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), known.tobytes(), lens.astype("<u4").tobytes(), offsets.tobytes(), blocks.tobytes()])


def read_shard(image: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a shard's documents."""
    head = np.frombuffer(image, _HEAD, 1)[0]
    if head["magic"] != b"TFR1":
        raise ValueError("not a token shard")
    d, at = int(head["docs"]), _HEAD.itemsize
    names = pa.array(np.frombuffer(image, "<i8", d, at), mask=np.frombuffer(image, np.uint8, d, at + 8 * d) == 0)
    lens = np.frombuffer(image, "<u4", d, at + 9 * d).astype(np.int64)
    offsets = np.frombuffer(image, "<u4", int(head["blocks"]), at + 13 * d)
    return names, lens, unpack_ids(np.frombuffer(image, np.uint8, offset=at + 13 * d + 4 * len(offsets)), offsets, int(head["ids"]), int(head["block"]))


_SHARDS = "part int, seq int, n_docs long, n_ids long, image binary"


def _write(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from ._tokens import encode_slices

        part, seq, names, lens, ids = TaskContext.get().partitionId(), 0, [], [], []

        def flush():
            n, x = np.concatenate(lens), np.concatenate(ids)
            row = [[part], [seq], [len(n)], [len(x)], [write_shard(pa.concat_arrays(names), n, x)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seq", "n_docs", "n_ids", "image"])

        for b in batches:
            for a, flat, offs in encode_slices(b.column("text"), path, end_id):
                # A shard ends with the document that reaches its size; documents stay whole.
                n = np.diff(offs)
                group = (sum(map(len, ids)) + offs[1:] - 1) // shard_ids
                cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)]
                for s, z in zip(cuts, cuts[1:]):
                    if s:
                        yield flush()
                        seq, names, lens, ids = seq + 1, [], [], []
                    names.append(b.column("doc_id").slice(a + s, z - s))
                    lens.append(n[s:z])
                    ids.append(flat[offs[s] : offs[z]])
        if lens:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, image in zip(*(b.column(c) for c in ("part", "seq", "image"))):
            names, lens, ids = read_shard(image.as_py())
            data, ends = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), np.cumsum(lens)
            sums = [zlib.crc32(data[4 * (z - n) : 4 * z]) for z, n in zip(ends.tolist(), lens.tolist())]
            same = lambda x: pa.array(np.full(len(lens), x.as_py(), np.int32))
            yield pa.RecordBatch.from_arrays([same(part), same(seq), names, pa.array(ends - lens), pa.array(lens), pa.array(sums, pa.int64())], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = 1 << 20) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards below ``path``, in doc_id order over (part, seq)."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows of one id, or of none, are cut by a hash of their texts.
    order = ["doc_id", F.xxhash64("text")]
    d = d.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text")
    d.mapInArrow(tidy(_write(tokenizer, end_id, shard_ids)), _SHARDS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32.

    Shard starts: totals per part are summed over the parts (one row each), and
    inside a part over its shards.
    """
    from pyspark.sql import Window as W

    shards = spark.read.schema(_SHARDS).parquet(path)
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_t"))
    parts = parts.select("part", (F.sum("_t").over(W.orderBy("part")) - F.col("_t")).alias("_before"))
    at = sizes.withColumn("_in", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).join(parts, "part")
    at = at.select("part", "seq", (F.col("_before") + F.col("_in")).alias("_at"))
    docs = shards.select("part", "seq", "image").mapInArrow(_read, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(at, ["part", "seq"]).select("doc_id", (F.col("_at") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path)
