"""Image sources and sinks: an image table is (image_id, height, width, channels, data), row-major, channel last, BGR."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbers(data: str) -> Column:
    """The bytes of a picture as an array of 0..255."""

    @F.pandas_udf("array<int>")
    def bytes_(data: pd.Series) -> pd.Series:
        return data.map(lambda b: np.frombuffer(b, np.uint8).astype(np.int32))

    return bytes_(data)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files; unreadable ones are left out. ``data`` is an array of 0..255."""
    df = spark.read.format("image").option("dropInvalid", True).load(path)
    return df.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), numbers("image.data").alias("data"))


def _png(height: int, width: int, channels: int, data: np.ndarray) -> bytes:
    a = np.asarray(data).astype(np.uint8).reshape(height, width, channels)[..., ::-1]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), a.reshape(height, -1)], axis=1)
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    kind = {1: 0, 3: 2}[channels]  # gray, RGB
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(images: DataFrame, path: str) -> None:
    """Write gray or BGR images as PNG files ``<image_id>.png`` in a folder that all executors share.

    Tasks write through the store's client (local paths, or URIs that Arrow's
    file systems know). A repeated task writes the same bytes again.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        store.create_dir(folder)
        for p in it:
            for i, *image in zip(p["image_id"], p["height"], p["width"], p["channels"], p["data"]):
                with store.open_output_stream(f"{folder}/{i}.png") as f:
                    f.write(_png(*image))
            yield pd.DataFrame({"n": [len(p)]})

    images.select("image_id", "height", "width", "channels", "data").mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()


WAVE = 10_000  # files whose names are handed to one read
OPEN_COST = 16_384  # bytes that opening a picture file counts for when files are dealt into tasks; Spark's 4 MB gives a task 4 to 32 files
LISTERS = 32  # tasks that look up the files of a read; Spark takes one a file


@dataclass
class Annotated:
    all: DataFrame  # (path: as annotated, label, status: found, missing or unreadable, height, width, channels, data), from one read
    found: DataFrame  # (path, label, height, width, channels, data)
    missing: DataFrame  # (path, label) without a file
    unreadable: DataFrame  # (path, label) whose file is no picture


def many_files(spark: SparkSession) -> SparkSession:
    """A session for reads of many small files, whose tasks follow the files' bytes and not their number. What is joined to another session's frame runs in that one."""
    s = spark.newSession()
    s.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)
    s.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTERS)
    return s


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, name: below the folder, length) of all files below a folder; no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    file = _plain(F.col("path"))
    base = _plain(F.lit(folder.rstrip("/") + "/"))
    return listed.select(file.alias("file"), F.element_at(F.split(F.regexp_replace(file, "^[a-z0-9]+:", ""), F.concat(F.lit("^\\Q"), F.regexp_replace(base, "^[a-z0-9]+:", ""), F.lit("\\E"))), -1).alias("name"), "length")


def _plain(path: Column) -> Column:
    """scheme:/path, however many slashes follow the scheme."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def load_annotated_images(annotations: DataFrame, folder: str, wave: int = WAVE) -> Annotated:
    """Pictures of a folder with the labels of ``annotations`` (path below the folder, label).

    Files are listed with their sizes, matched with the narrow annotations, and only
    those that match are opened, in reads of at most ``wave`` names. Pictures that
    several rows name appear with each; names are those of the whole path. Files
    without a byte count as missing, as Spark doesn't list them.
    """
    spark = annotations.sparkSession
    a = annotations.select("path", "label")
    reader = many_files(spark)
    files = list_files(reader, folder)
    named = a.join(files, a["path"] == files["name"]).select("path", "label", "file")
    missing = a.join(files, a["path"] == files["name"], "left_anti")
    reads, names = [], []
    read = lambda names: reader.read.format("image").option("dropInvalid", False).load(names).select(_plain(F.col("image.origin")).alias("file"), "image")
    for r in named.select("file").distinct().toLocalIterator():  # names alone, as Spark's own index of a read holds them
        names.append(r["file"])
        if len(names) == wave:
            reads.append(read(names))
            names = []
    if names or not reads:
        reads.append(read(names) if names else spark.createDataFrame([], "file string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"))
    pictures = reads[0]
    for r in reads[1:]:
        pictures = pictures.union(r)
    both = named.join(pictures, "file")
    size = [F.col(f"image.{c}").alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"))]
    status = F.when(F.col("image.height") > 0, "found").otherwise("unreadable")
    opened = both.select("path", "label", status.alias("status"), *size, numbers("image.data").alias("data"))
    every = opened.union(missing.select("path", "label", F.lit("missing"), *[F.lit(None).cast("int")] * 3, F.lit(None).cast("array<int>")))
    pick = lambda s: opened.where(F.col("status") == s)
    return Annotated(every, pick("found").drop("status"), missing, pick("unreadable").select("path", "label"))


def vector_images(vectors: DataFrame) -> DataFrame:
    """One 8x8 gray image per 64-number vector: floor((e + 1) * 127.5), clipped to 0..255."""
    px = F.transform("embedding", pixel_of)
    return vectors.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), px.alias("data"))


def pixel_of(e: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5).cast("int")))


def tiled_images(vectors: DataFrame, channels: int = 1) -> DataFrame:
    """32x32 images of ``16 * channels`` vectors with consecutive ids, tile by tile, channel after channel; a missing vector is a tile of zeros.

    Only the vectors are shuffled, as arrays; of several with one id the smallest stays.
    """
    per = 16 * channels
    px = vectors.select(F.expr(f"vec_id div {per}").alias("image_id"), F.struct((F.col("vec_id") % per).alias("t"), F.transform("embedding", pixel_of).alias("px")).alias("s"))
    tiles = px.groupBy("image_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.get(F.filter("s", lambda s: s["t"] == i), F.lit(0))["px"])

    def value(slots: Column, k: Column) -> Column:
        # position k of the image: its channel, row y and column x; tile and place in the tile
        at, c = F.floor(k / channels), k % channels
        y, x = F.floor(at / 32), at % 32
        tile, place = c * 16 + F.floor(y / 8) * 4 + F.floor(x / 8), (y % 8) * 8 + x % 8
        return F.coalesce(F.get(F.get(slots, tile.cast("int")), place.cast("int")), F.lit(0))

    # the array around ``slots`` has it evaluated once an image
    data = F.transform(F.array(slots), lambda s: F.transform(F.sequence(F.lit(0), F.lit(1024 * channels - 1)), lambda k: value(s, k)))[0]
    return tiles.select("image_id", F.lit(32).alias("height"), F.lit(32).alias("width"), F.lit(channels).alias("channels"), data.alias("data"))
