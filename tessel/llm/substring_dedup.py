"""Substring dedup by fixed-block anchors.

A window is ``window`` consecutive words of one document. Each word covered by
a window whose words also start earlier (smaller doc_id, or earlier in the same
document) is removed.

1. Anchors: each document is cut into non-overlapping blocks of ``window / 2``
   words. These blocks are the index; every rolling run of that many words
   probes it. Any window of a repeat holds a whole block of each of its
   occurrences, so every repeat is hit. Index and probes travel as packed hash
   columns, dealt by hash; runs that already meet inside one slice of texts
   send one member for all, so a passage in very many documents stays small. The
   number of parts that hashes are dealt into follows the size of the texts.
2. Extension: around the hits, and only there, whole windows are compared by
   128-bit hashes made from 128-bit hashes of their words; all but the first
   occurrence are repeats. A window in very many documents comes once from each
   slice of texts. Overlapping windows join to maximal repeats, in both
   directions from the hit.
3. The covered words are removed.

Defined results: null texts have no words; texts shorter than a window keep all
words; rows with a null doc_id count as last, in the order of a hash of their
texts, with ids of 2**62 and more; rows that share doc_id and text
are one occurrence and each keep what it keeps; rows that share a doc_id only
are ordered by a hash of their texts; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import discard, materialize, partitions, table, tidy
from ._words import Words, word_slices
from .jaccard_join import _mix, word_hashes

LAST = 2**62  # where the order of rows without a doc_id begins
BUCKET = 64 << 20  # bytes of text to a bucket of hashes, about
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def rolling(h: np.ndarray, row: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words of one text, and where the runs start."""
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m, g = len(h) - size + 1, np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        g = g * _ODD[seed] + h[k : k + m]
    at = np.flatnonzero(row[:m] == row[size - 1 :])
    return _mix(g[at] + np.uint64(seed)), at


def long_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit hash of each word of a slice, through its distinct words."""
    from xxhash import xxh3_128_digest

    both = np.frombuffer(b"".join(map(xxh3_128_digest, w.uniq.to_pylist())), "<u8").reshape(-1, 2)
    return both[:, 0][w.code], both[:, 1][w.code]


def _starts(w: Words) -> np.ndarray:
    size = np.bincount(w.row, minlength=w.n)
    return np.cumsum(size) - size


def _probes(size: int, window: int, buckets: int):
    """Packed probes per bucket (kind 0) and hits found inside a slice (kind 1)."""

    def blob(x: np.ndarray, kind: str) -> bytes:
        return x.astype(kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column("doc").to_numpy()
            for w in word_slices(b.column("text")):
                start, count = _starts(w), np.bincount(w.row, minlength=w.n)
                h, at = rolling(word_hashes(w, lower=False), w.row, size)
                use = count[w.row[at]] >= window
                h, at = h[use], at[use]
                row = w.row[at]
                pos = at - start[row]
                order = np.argsort(h, kind="stable")
                hs = h[order]
                new = np.ones(len(hs), bool)
                new[1:] = hs[1:] != hs[:-1]
                group = np.cumsum(new) - 1
                n_in, anchored = np.bincount(group), np.bincount(group, pos[order] % size == 0) > 0
                meets = (n_in > 1) & anchored if len(hs) else np.zeros(0, bool)
                local = meets[group]
                # One member of a local meeting speaks for it: the first that is an index block.
                lead = np.zeros(len(hs), bool)
                blocks = np.flatnonzero(local & (pos[order] % size == 0))
                lead[blocks[np.unique(group[blocks], return_index=True)[1]]] = True
                send = ~local | lead
                out = []
                for kind, pick in ((0, order[send]), (1, order[local])):
                    if not len(pick):
                        continue
                    key = ((h[pick] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64) if kind == 0 else row[pick] % buckets
                    o = np.lexsort((pos[pick], row[pick], key))
                    pick, key = pick[o], key[o]
                    for a, z in zip(*(lambda c: (c, [*c[1:], len(key)]))([0, *(np.flatnonzero(np.diff(key)) + 1).tolist()])):
                        p = pick[a:z]
                        runs = np.flatnonzero(np.concatenate([[True], row[p][1:] != row[p][:-1]]))
                        r = {"bucket": int(key[a]), "kind": kind, "docs": blob(docs[w.first + row[p][runs]], "<i8"), "lens": blob(np.diff([*runs, len(p)]), "<u4"), "pos": blob(np.diff(pos[p], prepend=0), "<i4")}
                        out.append(r | ({"low": blob(h[p] & np.uint64(0xFFFFFFFF), "<u4"), "high": blob((h[p] >> np.uint64(32)) & np.uint64(0xFF), "u1")} if kind == 0 else {"low": b"", "high": b""}))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_PROBE)

    return run


_PROBE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("docs", "lens", "pos", "low", "high"))])
_PROBE_SQL = "bucket int, kind int, docs binary, lens binary, pos binary, low binary, high binary"


_HIT_SQL = "bucket int, docs binary, lens binary, pos binary"


def _meet(size: int, buckets: int):
    """Hits among the probes and blocks that meet in this partition, packed per bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, pos, key, lead = [], [], [], []
        for b in batches:
            for x in b.to_pylist():
                d = np.repeat(np.frombuffer(x["docs"], "<i8"), np.frombuffer(x["lens"], "<u4"))
                p = np.cumsum(np.frombuffer(x["pos"], "<i4"), dtype=np.int64)
                if x["kind"]:
                    yield from _packed(d, p, buckets)
                    continue
                docs.append(d)
                pos.append(p.astype(np.int32))
                key.append((np.uint64(x["bucket"] & 0xFFFFFF) << np.uint64(40)) | (np.frombuffer(x["high"], "u1").astype(np.uint64) << np.uint64(32)) | np.frombuffer(x["low"], "<u4").astype(np.uint64))
        if not key:
            return
        d, p, k = np.concatenate(docs), np.concatenate(pos), np.concatenate(key)
        del docs, pos, key
        o = np.argsort(k, kind="stable")
        k = k[o]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        meets = (np.bincount(group) > 1) & (np.bincount(group, p[o] % size == 0) > 0)
        o = o[meets[group]]
        yield from _packed(d[o], p[o], buckets)

    return run


def _packed(d: np.ndarray, p: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    key = (_mix(d.view(np.uint64).copy()) % np.uint64(buckets)).astype(np.int64)
    o = np.lexsort((p, d, key))
    d, p, key = d[o], p[o], key[o]
    ends = [*(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else []
    rows, a = [], 0
    for z in ends:
        runs = np.flatnonzero(np.concatenate([[True], d[a:z][1:] != d[a:z][:-1]]))
        rows.append({"bucket": int(key[a]), "docs": d[a:z][runs].astype("<i8").tobytes(), "lens": np.diff([*runs, z - a]).astype("<u4").tobytes(), "pos": np.diff(p[a:z], prepend=0).astype("<i4").tobytes()})
        a = z
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("lens", pa.binary()), ("pos", pa.binary())]))


def _by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (doc, hits) per document of this partition."""
    docs, pos = [], []
    for b in batches:
        for x in b.to_pylist():
            docs.append(np.repeat(np.frombuffer(x["docs"], "<i8"), np.frombuffer(x["lens"], "<u4")))
            pos.append(np.cumsum(np.frombuffer(x["pos"], "<i4"), dtype=np.int64).astype(np.int32))
    if not docs:
        return
    d, p = np.concatenate(docs), np.concatenate(pos)
    o = np.lexsort((p, d))
    d, p = d[o], p[o]
    runs = np.append(np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])), len(d))
    for a in range(0, len(runs) - 1, 5_000):
        r = runs[a : a + 5_001]
        yield pa.RecordBatch.from_arrays([pa.array(d[r[:-1]]), pa.ListArray.from_arrays(pa.array((r - r[0]).astype(np.int32)), pa.array(p[r[0] : r[-1]]))], ["doc", "hits"])


def _text_key(t: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(t or "") - 2**63


def _windows(size: int, window: int):
    """Windows around the hits: first of each kind in a slice (h1, h2, doc, tkey, start); the others at once as repeats (starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column("doc").to_numpy()
            hits = pc.list_flatten(b.column("hits")).to_numpy()
            per = pc.list_value_length(b.column("hits")).to_numpy().astype(np.int64)
            cut = np.concatenate([[0], np.cumsum(per)])
            for w in word_slices(b.column("text")):
                start, count = _starts(w), np.bincount(w.row, minlength=w.n)
                low, high = long_hashes(w)
                (h1, at), (h2, _) = rolling(low, w.row, window), rolling(high, w.row, window, 1)
                # Starts in [q - (window - size), q] for a hit at q.
                mark = np.zeros(len(w.row) + 1, np.int64)
                for i in range(w.n):
                    q = hits[cut[w.first + i] : cut[w.first + i + 1]].astype(np.int64)
                    q = q[q < count[i]]  # hits of another row with this doc_id may lie outside
                    np.add.at(mark, start[i] + np.maximum(q - (window - size), 0), 1)
                    np.add.at(mark, start[i] + np.minimum(q + 1, count[i]), -1)
                use = np.cumsum(mark)[:-1][at] > 0
                h1, h2, at = h1[use], h2[use], at[use]
                if not len(at):
                    continue
                row = w.row[at]
                pos = at - start[row]
                tkey = np.zeros(w.n, np.int64)
                texts = b.column("text")
                for i in np.unique(row).tolist():
                    tkey[i] = _text_key(texts[w.first + i].as_py())
                doc = docs[w.first + row]
                o = np.lexsort((pos, tkey[row], doc, h2, h1))
                h1, h2, doc, tk, pos = h1[o], h2[o], doc[o], tkey[row][o], pos[o]
                first = np.ones(len(o), bool)
                first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                group = np.cumsum(first) - 1
                head = np.flatnonzero(first)[group]
                same = (doc == doc[head]) & (tk == tk[head]) & (pos == pos[head])  # a repeated row is the same occurrence
                for a in range(0, int(first.sum()), 200_000):
                    f = np.flatnonzero(first)[a : a + 200_000]
                    yield _batch(h1[f].view(np.int64), h2[f].view(np.int64), doc[f], tk[f], pos[f], False)
                rest = np.flatnonzero(~same)
                for a in range(0, len(rest), 200_000):
                    f = rest[a : a + 200_000]
                    yield _batch(h1[f].view(np.int64), h2[f].view(np.int64), doc[f], tk[f], pos[f], True)

    return run


def _batch(h1, h2, doc, tkey, pos, repeat: bool) -> pa.RecordBatch:
    """Windows as rows; repeats packed as one row per document."""
    if not repeat:
        return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(doc), pa.array(tkey), pa.array(pos.astype(np.int32)), pa.nulls(len(h1), pa.list_(pa.int32()))], _WINDOW.names)
    o = np.lexsort((pos, tkey, doc))
    doc, tkey, pos = doc[o], tkey[o], pos[o].astype(np.int32)
    runs = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tkey[1:] != tkey[:-1])]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(runs, len(doc)).astype(np.int32)), pa.array(pos))
    none = pa.nulls(len(runs), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(doc[runs]), pa.array(tkey[runs]), pa.nulls(len(runs), pa.int32()), lists], _WINDOW.names)


_WINDOW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tkey", pa.int64()), ("start", pa.int32()), ("starts", pa.list_(pa.int32()))])


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            repeats = b.column("_dedup_repeats").to_pylist()
            for w in word_slices(b.column("text")):
                start = _starts(w)
                count = np.bincount(w.row, minlength=w.n)
                gone = np.zeros(len(w.row) + 1, np.int64)
                for i in range(w.n):
                    groups = [g for g in repeats[w.first + i] or []]
                    if not groups:
                        continue
                    key = _text_key(b.column("text")[w.first + i].as_py())
                    for g in groups:
                        if g["tkey"] == key:
                            s = start[i] + np.array(g["starts"], np.int64)
                            np.add.at(gone, s, 1)
                            np.add.at(gone, s + window, -1)
                out = np.cumsum(gone)[:-1] > 0
                names = w.uniq.to_pylist()
                code = w.code.tolist()
                n_gone = np.bincount(w.row, out, w.n).astype(np.int64)
                kept = []
                for i in range(w.n):
                    a, z = int(start[i]), int(start[i] + count[i])
                    kept.append(" ".join([names[c] for c, o in zip(code[a:z], out[a:z].tolist()) if not o] if n_gone[i] else [names[c] for c in code[a:z]]))
                part = b.slice(w.first, w.n).drop_columns(["_dedup_repeats"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(count.astype(np.int64)), pa.array(n_gone), pa.array(kept)], names=[*part.schema.names, "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` (doc_id, text and further columns) with n_words, n_removed and kept_text (kept words, one space apart); columns of these names are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", "kept_text")
    doc = F.coalesce(F.col("doc_id").cast("long"), LAST + F.pmod(F.xxhash64("text"), F.lit(LAST - 1)))
    text = docs.select(doc.alias("doc"), "text")
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size, n = window // 2, max(2 * partitions(spark), -(-total // BUCKET))
    probes = text.mapInArrow(tidy(_probes(size, window, n)), _PROBE_SQL).repartition(n, "bucket")
    hits = probes.mapInArrow(tidy(_meet(size, n)), _HIT_SQL).repartition(n, "bucket")
    hits = materialize(hits.mapInArrow(_by_doc, "doc long, hits array<int>"), "dedup-hits")
    near = text.join(hits, "doc")
    spans = near.mapInArrow(tidy(_windows(size, window)), "h1 long, h2 long, doc long, tkey long, start int, starts array<int>")
    spans = materialize(spans, "dedup-windows")
    discard(hits)
    first = W.partitionBy("h1", "h2").orderBy("doc", "tkey", "start")
    later = spans.where("h1 is not null").withColumn("_k", F.dense_rank().over(first)).where("_k > 1").groupBy("doc", "tkey").agg(F.collect_list("start").alias("starts"))
    again = spans.where("h1 is null").select("doc", "tkey", "starts").union(later)
    repeats = again.groupBy(F.col("doc").alias("_dedup_doc")).agg(F.collect_list(F.struct("tkey", "starts")).alias("_dedup_repeats"))
    repeats = materialize(repeats, "dedup-repeats")
    discard(spans)
    out = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema
    return docs.withColumn("_dedup_doc", doc).join(repeats, "_dedup_doc", "left").drop("_dedup_doc").mapInArrow(tidy(_remove(window)), out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

