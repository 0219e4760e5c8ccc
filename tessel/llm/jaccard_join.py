"""N-gram Jaccard join: a blocked sparse product of the document x n-gram incidence.

Links are all pairs of documents whose sets of word n-grams have a Jaccard
similarity of at least ``percent`` / 100, found exactly:

1. Documents with equal sets form one class; only classes are compared.
2. A first product over the block of n-grams with the smallest hashes counts,
   per class, the n-grams that no other class has. At a similarity t a class
   may keep at most (1 - t) of its n-grams to itself, so classes above that
   bound are dropped (:func:`lonely`).
3. The columns (n-grams) of the rest are dealt into blocks by their smallest class.
   Each block's product adds up, inside a task, how many of its columns each pair
   of classes shares; pairs whose sizes can't meet the bound are left out; Spark
   sums the counts of the blocks (:func:`block_products`). So the overlap of a pair
   is the sum over all its columns of up to SHORT classes.
4. What a pair may still share are columns of more classes. Pairs whose count and
   number of these can't reach the bound are discarded, for the others the
   overlap in them is added (:func:`counted`).
5. Pairs that meet in such long columns only have nearly all their n-grams there.
   Their columns are cut to the first l - ceil(t n) + 1 (rare ones first), one
   of which such a pair must share, and in each a pivot member is compared
   first: a large group of near copies costs a few pairs a member. After two
   rounds of pivots the classes that still meet are dealt into blocks, whose
   products are taken inside the tasks (:func:`block_links`).

N-grams are compared by 64-bit hashes, sets by 128 bits: a class is named by 64
of them, or if other classes have the same by a hash of all. Defined results: a
text of fewer than n words is one n-gram of all its words; null texts and texts
without words have the empty set and link with nothing; equal sets are linked;
rows with a null doc_id are returned with a component of their own texts'
smallest known doc_id, or null; rows that share a doc_id are compared each for
themselves; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._graph import components
from ._shared import discard, hot_join, materialize, partitions, table, tidy
from ._words import Words, word_slices

FIRST_BLOCK = 0.25  # share of the n-gram hashes in the first product
PIVOT_ROUNDS = 2
SHORT = 32  # classes in a column up to which its pairs are counted
SAMPLED, HOT = 64, 64  # a column with more than HOT of every SAMPLED-th class is hot: long for certain, and spread over all tasks
HOT_BROADCAST = 250_000  # hot columns up to which their names are broadcast; beyond, they are joined by shuffle
BLOCK_CLASSES, BLOCK_GRAMS = 1_024, 500_000  # size of a block of the product, in classes and in n-grams
ACTIVE_BROADCAST = 250_000  # class representatives up to which their ids are broadcast; beyond, texts are joined by shuffle
PART_ROWS = 2_000  # members of a long column that meet in one task, about


def _limit(share: float) -> int:
    return int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(w: Words, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word of a slice, through its distinct words (ASCII letters lowered or as they stand)."""
    from xxhash import xxh64_intdigest

    names = (pc.ascii_lower(w.uniq) if lower else w.uniq).to_pylist()
    return np.fromiter(map(xxh64_intdigest, names), np.uint64, len(names))[w.code]


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], np.uint64)


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' rows and n-gram hashes (int64), distinct, by row and hash."""
    h = word_hashes(w)
    size = np.bincount(w.row, minlength=w.n)
    start = np.cumsum(size) - size
    grams, rows = [], []
    if len(h) >= n:
        g = sum((h[k : len(h) - n + 1 + k] * _FACTORS[k] for k in range(1, n)), h[: len(h) - n + 1] * _FACTORS[0])
        whole = w.row[: len(g)] == w.row[n - 1 :]
        grams.append(_mix(g[whole]))
        rows.append(w.row[: len(g)][whole])
    for i in np.flatnonzero((size > 0) & (size < n)).tolist():
        x = h[start[i] : start[i] + size[i]]
        grams.append(_mix((x * _FACTORS[: len(x)]).sum(keepdims=True) + _FACTORS[7:] * np.uint64(len(x))))
        rows.append(np.array([i]))
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, r = np.concatenate(grams).view(np.int64), np.concatenate(rows)
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return r[keep], g[keep]


def _digests(g: np.ndarray, cut: np.ndarray, clash: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: the class's name, and the rest."""
    import xxhash

    both = [xxhash.xxh3_128_intdigest(g[a:b].tobytes(), seed=b - a) for a, b in zip(cut.tolist(), cut[1:].tolist())]
    low, high = (np.array([x >> s & (1 << 64) - 1 for x in both], np.uint64).view(np.int64) for s in (0, 64))
    for i in np.flatnonzero(np.isin(low, np.array(sorted(clash), np.int64))).tolist() if clash else ():
        low[i] = np.uint64(xxhash.xxh64_intdigest(both[i].to_bytes(16, "little"), seed=1)).astype(np.int64)
    return low, high


def _emit(n: int, what: str, clash: frozenset[int] = frozenset()):
    """mapInArrow functions over (doc_id, text): ``classes`` doc_id, n, cls, more; ``block`` gram, cls; ``sets`` cls, n, g. ``clash``: names of more than one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_slices(b.column("text")):
                r, g = shingle_sets(w, n)
                cut = np.searchsorted(r, np.arange(w.n + 1))
                (cls, more), size = _digests(g, cut, clash), np.diff(cut)
                if what == "classes":
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(w.first, w.n), pa.array(size), pa.array(cls), pa.array(more)], ["doc_id", "n", "cls", "more"])
                elif what == "block":
                    _, first = np.unique(cls, return_index=True)  # copies in one slice count once
                    lead = np.zeros(w.n, bool)
                    lead[first] = True
                    low = (g < _limit(FIRST_BLOCK)) & lead[r]
                    for a in range(0, int(low.sum()), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(g[low][a : a + 100_000]), pa.array(cls[r[low][a : a + 100_000]])], ["gram", "cls"])
                else:
                    sets = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(g))
                    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(size), sets], ["cls", "n", "g"])

    return run


def lonely(docs: DataFrame, n: int, clash: frozenset[int]) -> DataFrame:
    """(cls, own): n-grams of the first block that only this class has."""
    rows = docs.mapInArrow(tidy(_emit(n, "block", clash)), "gram long, cls long")
    return rows.groupBy("gram").agg(F.min("cls").alias("cls"), F.max("cls").alias("_z")).where("cls = _z").groupBy("cls").agg(F.count("*").alias("own"))


def _need(percent: int, both="both"):
    """Whether ``both`` shared n-grams are enough for sets of sizes na and nb: 100 * both >= percent * union."""
    return (100 + percent) * (F.col(both) if isinstance(both, str) else both) >= percent * (F.col("na") + F.col("nb"))


_COLUMN = "cls long, n long, gram long, c array<long>, k array<int>"


def _columns():
    """Columns, which come sorted: one of 2 to SHORT classes is a row of its classes c and their sizes k, beside the smallest class; of longer ones each member (cls, n, gram) is a row."""
    names = ["cls", "n", "gram", "c", "k"]

    def members(gram, cls, n):
        return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(n), pa.array(gram), pa.nulls(len(gram), pa.list_(pa.int64())), pa.nulls(len(gram), pa.list_(pa.int32()))], names)

    def whole(gram, cls, n):
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        m = np.diff(np.append(first, len(gram)))
        long = np.repeat(m > SHORT, m)
        if long.any():
            yield members(gram[long], cls[long], n[long])
        short = (m > 1) & (m <= SHORT)
        if short.any():
            some, none = np.repeat(short, m), pa.nulls(int(short.sum()), pa.int64())
            cut = pa.array(np.append(0, np.cumsum(m[short])).astype(np.int32))
            c, k = pa.ListArray.from_arrays(cut, pa.array(cls[some])), pa.ListArray.from_arrays(cut, pa.array(n[some].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(cls[first[short]]), none, none, c, k], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, over = [], 0, None  # ``over``: the column at hand, if it is long already
        for b in batches:
            gram, cls, n = (b.column(c).to_numpy() for c in ("gram", "cls", "n"))
            if not len(gram):
                continue
            if over is not None:
                z = int(np.searchsorted(gram, over, side="right"))
                if z:
                    yield members(gram[:z], cls[:z], n[:z])
                gram, cls, n = gram[z:], cls[z:], n[z:]
                if not len(gram):
                    continue
                over = None
            held.append((gram, cls, n))
            count += len(gram)
            if count < 200_000:
                continue
            gram, cls, n = (np.concatenate(x) for x in zip(*held))
            new = np.ones(len(gram), bool)  # a class may come twice, from rows that share a doc_id
            new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])
            gram, cls, n = gram[new], cls[new], n[new]
            z = int(np.searchsorted(gram, gram[-1]))
            if z:
                yield from whole(gram[:z], cls[:z], n[:z])
            if len(gram) - z > SHORT:
                over = gram[-1]
                yield members(gram[z:], cls[z:], n[z:])
                held, count = [], 0
            else:
                held, count = [(gram[z:], cls[z:], n[z:])], len(gram) - z
        if held:
            gram, cls, n = (np.concatenate(x) for x in zip(*held))
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])
            yield from whole(gram[new], cls[new], n[new])

    return run


def _product(percent: int):
    """The product of a block of columns (c, k): (a, b, na, nb, both) per pair of classes."""

    def cells(c, k, m):
        first = np.cumsum(m) - m
        ids, at = np.unique(c, return_inverse=True)
        size = np.zeros(len(ids), np.int64)
        size[at] = k
        keys = []
        for w in np.unique(m).tolist():
            rows = at[first[m == w][:, None] + np.arange(w)]  # in order, as a column's classes are
            i, j = np.triu_indices(w, 1)
            a, b = rows[:, i].ravel(), rows[:, j].ravel()
            near = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
            keys.append(a[near] * len(ids) + b[near])
        key, both = np.unique(np.concatenate(keys), return_counts=True)
        a, b = key // len(ids), key % len(ids)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], size[a], size[b], both.astype(np.int64))], ["a", "b", "na", "nb", "both"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            c, k = b.column("c"), b.column("k")
            held.append((c.flatten().to_numpy(), k.flatten().to_numpy(), pc.list_value_length(c).to_numpy()))
            count += len(held[-1][0])
            if count >= 200_000:
                yield cells(*(np.concatenate(x) for x in zip(*held)))
                held, count = [], 0
        if count:
            yield cells(*(np.concatenate(x) for x in zip(*held)))

    return run


def block_products(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, na, nb, both): n-grams that pairs of classes share in columns of up to SHORT classes; (cls, n, gram): the members of longer columns. Both are written tables.

    A block holds all columns with the same smallest class (at most that class's
    own set), in order: a pair's columns meet in a few products, however many
    blocks and tasks there are.
    """
    spark = sets.sparkSession
    rows = sets.select(F.explode("g").alias("gram"), "cls", "n")
    hot = materialize(rows.where(F.pmod(F.xxhash64("cls"), F.lit(SAMPLED)) == 0).groupBy("gram").agg(F.count_distinct("cls").alias("m")).where(F.col("m") > HOT).select("gram"), "jaccard-hot")
    few = hot.limit(HOT_BROADCAST + 1).count() <= HOT_BROADCAST
    side = F.broadcast(hot) if few else hot
    cool = rows.join(side, "gram", "left_anti").repartition(partitions(spark), "gram").sortWithinPartitions("gram", "cls")
    out = materialize(cool.mapInArrow(tidy(_columns()), _COLUMN), "jaccard-columns")
    blocks = out.where("c is not null").repartition(partitions(spark), "cls").sortWithinPartitions("cls").select("c", "k")
    cells = blocks.mapInArrow(tidy(_product(percent)), "a long, b long, na long, nb long, both long")
    pairs = cells.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("both").alias("both"))
    long = out.where("c is null").select("cls", "n", "gram").union(rows.join(side, "gram", "left_semi").select("cls", "n", "gram").distinct())
    pairs, long = materialize(pairs, "jaccard-counts"), materialize(long, "jaccard-members")
    discard(out, hot)
    return pairs, long


def counted(pairs: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """Pairs of :func:`block_products` that meet the bound, what they share in long columns added where it can matter."""
    per = materialize(long.groupBy("cls").agg(F.count("*").alias("l"), F.collect_list("gram").alias("gl")), "jaccard-long")  # at most a class's own set
    l = lambda side: per.select(F.col("cls").alias(side), F.col("l").alias(f"l{side}"))  # noqa: E731, E741
    near = pairs.join(l("a"), "a", "left").join(l("b"), "b", "left").withColumn("more", F.coalesce(F.least("la", "lb"), F.lit(0)) * F.col("la").isNotNull().cast("long") * F.col("lb").isNotNull().cast("long"))
    near = materialize(near.where(_need(percent, F.col("both") + F.col("more"))).select("a", "b", "na", "nb", "both"), "jaccard-near")
    sure = near.where(_need(percent)).select("a", "b")
    open_ = near.where(~_need(percent))
    g = lambda side: per.select(F.col("cls").alias(side), F.col("gl").alias(f"g{side}"))
    added = open_.join(g("a"), "a").join(g("b"), "b").where(_need(percent, F.col("both") + F.size(F.array_intersect("ga", "gb"))))
    return sure.union(added.select("a", "b"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) of pivots whose overlap reaches the bound. b's set travels once a pair, a's once for each 1,024th of them."""
    salt = F.pmod(F.xxhash64("b"), F.lit(1024))
    p = pairs.withColumn("salt", salt)
    right = p.join(sets.select(F.col("cls").alias("b"), F.col("g").alias("gb")), "b")
    left = p.select("a", "salt").distinct().join(sets.select(F.col("cls").alias("a"), F.col("g").alias("ga")), "a")
    both = right.join(left, ["a", "salt"]).withColumn("both", F.size(F.array_intersect("ga", "gb")))
    return both.where(_need(percent)).select("a", "b")


def block_links(cls: np.ndarray, side: np.ndarray, size: np.ndarray, row: np.ndarray, gram: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the classes of side 0 and those of side 1 (or among those of side 2), as (class, a class it reaches).

    The overlaps of all pairs are the product of two sparse incidence blocks:
    n-grams in many rows are multiplied as dense columns, the others column by
    column. Pairs below the size-derived bound are discarded, and of the links
    only what connects their ends is returned: at most one a class.
    """
    one = side[0] == 2
    left, right = (np.arange(len(cls)), np.arange(len(cls))) if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    at_l, at_r = np.full(len(cls), -1), np.full(len(cls), -1)
    at_l[left], at_r[right] = np.arange(len(left)), np.arange(len(right))
    _, code = np.unique(gram, return_inverse=True)
    in_l, in_r = at_l[row] >= 0, at_r[row] >= 0
    both = np.zeros((len(left), len(right)), np.float32)
    n_code = int(code.max()) + 1 if len(code) else 0
    df_l, df_r = np.bincount(code[in_l], minlength=n_code), np.bincount(code[in_r], minlength=n_code)
    dense = np.flatnonzero((df_l >= 32) & (df_r >= 32))
    for a in range(0, len(dense), 4_096):
        pick = np.full(n_code, -1)
        pick[dense[a : a + 4_096]] = np.arange(len(dense[a : a + 4_096]))
        x, y = np.zeros((len(left), 4_096), np.float32), np.zeros((len(right), 4_096), np.float32)
        use = (pick[code] >= 0) & in_l
        x[at_l[row[use]], pick[code[use]]] = 1
        use = (pick[code] >= 0) & in_r
        y[at_r[row[use]], pick[code[use]]] = 1
        both += x @ y.T
    thin = ((df_l < 32) | (df_r < 32)) & (df_l > 0) & (df_r > 0)
    use_l, use_r = in_l & thin[code], in_r & thin[code]
    ol, orr = np.argsort(code[use_l], kind="stable"), np.argsort(code[use_r], kind="stable")
    cl, rl = code[use_l][ol], at_l[row[use_l]][ol]
    cr, rr = code[use_r][orr], at_r[row[use_r]][orr]
    lo, hi = np.searchsorted(cr, cl), np.searchsorted(cr, cl, side="right")
    k = hi - lo
    ends = np.cumsum(k)
    start = 0
    while start < len(cl):  # about four million cells at a time
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 4_000_000, side="right")))
        kk = k[start:stop]
        pos = np.repeat(lo[start:stop] - (np.cumsum(kk) - kk), kk) + np.arange(kk.sum())
        cell = np.repeat(rl[start:stop], kk) * len(right) + rr[pos]
        both += np.bincount(cell, minlength=both.size).reshape(both.shape).astype(np.float32) if len(cell) > both.size // 8 else 0
        if len(cell) <= both.size // 8:
            np.add.at(both.reshape(-1), cell, 1)
        start = stop
    near = (100 + percent) * both.astype(np.float64) >= percent * (size[left][:, None] + size[right][None])
    near &= both > 0
    if one:
        np.fill_diagonal(near, False)
    label = np.arange(len(cls))
    while True:
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(near, label[right][None], len(cls)).min(1, initial=len(cls)))
        label[right] = np.minimum(label[right], np.where(near, label[left][:, None], len(cls)).min(0, initial=len(cls)))
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(cls)))
    return cls[moved], cls[label[moved]]


def _products(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): what the links inside each group (node, label) connect.

    A group's classes are dealt into blocks by hash; each pair of blocks is one
    product. A class travels once for each block of its group.
    """
    g = groups.join(sets.select(F.col("cls").alias("node"), "n"), "node")
    blocks = g.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("nb"))
    m = g.join(blocks, "label").withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    m = m.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
    m = m.select("label", F.least("i", "j").alias("bi"), F.greatest("i", "j").alias("bj"), side.alias("side"), "node")
    data = m.join(sets.select(F.col("cls").alias("node"), "n", "g"), "node").select("label", "bi", "bj", "side", "node", "n", "g")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = t.column("side").to_numpy()
        lists = t.column("g").chunk(0) if t.num_rows else None
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if t.num_rows > 1 and (side[0] == 2 or len(set(side.tolist())) == 2):
            size = t.column("n").to_numpy()
            out = block_links(t.column("node").to_numpy(), side, size, np.repeat(np.arange(t.num_rows), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy(), percent)
        return pa.table({"a": pa.array(out[0]), "b": pa.array(out[1])})

    return data.groupBy("label", "bi", "bj").applyInArrow(run, "a long, b long")


def links_of(sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the classes of ``sets`` (cls, n, g; one row a class) that have links."""
    pairs, long = block_products(sets, percent)
    found = materialize(counted(pairs, long, percent), "jaccard-links")
    discard(pairs)
    labels = materialize(components(found), "jaccard-labels")

    # Pairs without a short column in common: classes with nearly all n-grams in long columns, cut to the first few of these.
    many = long.groupBy("cls").agg(F.count("*").alias("l"), F.first("n").alias("n")).withColumn("p", F.col("l") - F.ceil(F.col("n") * percent / 100) + 1)
    many = many.where("p > 0")
    if not many.limit(1).count():
        return labels
    # Columns are dealt over parts of about PART_ROWS members, 10,000 columns at most over more than one. What is joined
    # to a column is repeated once a part, not once a partition: Spark broadcasts it by its size before that.
    rows = max(PART_ROWS, long.count() // 10_000)
    df = long.groupBy("gram").agg(F.count("*").alias("df")).withColumn("parts", F.ceil(F.col("df") / rows).cast("int"))
    df = materialize(df, "jaccard-sizes")
    hot = F.broadcast(df.where("parts > 1").select("gram", "parts"))
    spread = lambda d: d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")  # noqa: E731  d: one row a column
    parts = F.first("parts").alias("parts")
    inside = long.join(many.select("cls", "p"), "cls").join(hot, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    inside = inside.withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).join(spread(df), ["gram", "salt"])
    w = W.partitionBy("cls")
    # A text that others were copied from shares most of its n-grams with most of them: the best pivot.
    posts = inside.withColumn("place", F.row_number().over(w.orderBy("df", "gram"))).withColumn("hub", F.sum("df").over(w) / F.col("n"))
    posts = materialize(posts.where("place <= p").select("gram", "cls", "n", "hub", "parts", "salt"), "jaccard-posts")
    shared = posts.groupBy("gram").agg(F.count("*").alias("m"), parts).where("m > 1").select("gram", "parts")
    posts = materialize(posts.join(spread(shared), ["gram", "salt"]), "jaccard-posts")
    tested = None
    near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    for turn in range(PIVOT_ROUNDS + 1):
        now = posts.join(labels, posts["cls"] == labels["node"], "left").withColumn("label", F.coalesce("label", "cls")).drop("node")
        sizes = now.groupBy("gram", "label").agg(F.count("*").alias("k"), parts)
        main = sizes.groupBy("gram").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("_c"), parts).where("_c > 1").drop("_c")
        some = materialize(now.join(spread(main), ["gram", "salt"]), "jaccard-open")
        if turn == PIVOT_ROUNDS:
            break
        # The pivot comes from outside the column's largest component, which earlier pivots have met.
        pivot = some.where(F.col("label") != F.col("main")).groupBy("gram").agg(F.max_by(F.struct("cls", "n", "label"), F.struct("hub", "cls")).alias("v"), parts)
        pairs = some.join(spread(pivot), ["gram", "salt"]).where(F.col("label") != F.col("v.label")).select(F.col("v.cls").alias("a"), F.col("v.n").alias("na"), F.col("cls").alias("b"), F.col("n").alias("nb"))
        pairs = pairs.where(near).distinct()
        if tested is not None:
            # A pair that failed before fails again, whichever end was the pivot.
            pairs = pairs.join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "jaccard-pairs")
        found = found.union(materialize(_verify(pairs, sets, percent), "jaccard-links"))
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        labels = materialize(components(found), "jaccard-labels")
    if not some.limit(1).count():
        return labels
    # All that is left: products of the blocks of classes that still meet.
    lead = some.groupBy("gram").agg(F.min("cls").alias("lead"), parts)
    meet = some.select("gram", "cls", "salt").join(spread(lead), ["gram", "salt"]).where("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b"))
    return materialize(components(found.union(materialize(_products(components(meet), sets, percent), "jaccard-links"))), "jaccard-labels")


def jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    meta = materialize(docs.mapInArrow(tidy(_emit(n, "classes")), "doc_id long, n long, cls long, more long"), "jaccard-classes")
    classes = meta.where("n > 0").groupBy("cls", "more", "n").agg(F.min("doc_id").alias("rep"))
    # Names that by chance stand for several classes: about one pair in 10**10 classes.
    clash = frozenset(r["cls"] for r in classes.groupBy("cls").count().where("count > 1").select("cls").collect())
    if clash:
        meta = materialize(docs.mapInArrow(tidy(_emit(n, "classes", clash)), "doc_id long, n long, cls long, more long"), "jaccard-classes")
        classes = meta.where("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes.select("cls", "n", "rep"), "jaccard-names")
    own = lonely(docs, n, clash)
    active = classes.join(own, "cls", "left").where(100 * F.coalesce("own", F.lit(0)) <= (100 - percent) * F.col("n")).where("rep is not null")
    active = materialize(active.select("cls", "n", "rep"), "jaccard-active")
    ids = active.select(F.col("rep").alias("doc_id"))
    small = active.count() <= ACTIVE_BROADCAST
    some = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    # A row that shares its doc_id with a representative comes along; a class that comes twice counts once.
    sets = some.mapInArrow(tidy(_emit(n, "sets", clash)), "cls long, n long, g array<long>").where("n > 0")
    if meta.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["cls"])
    sets = materialize(sets, "jaccard-sets")
    labels = links_of(sets, percent)
    discard(sets, active)
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select("cls", "n", "rep", F.coalesce("label", "cls").alias("label"))
    named = materialize(named, "jaccard-labelled")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    component = hot_join(named, least, ["label"]).select("cls", "n", "component_id")
    out = hot_join(meta, component, ["cls", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cls").alias("class_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")
