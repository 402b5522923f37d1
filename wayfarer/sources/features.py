"""Feature files: text and binary, without words, with one or with several."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

DIMENSIONS = 128
ROWS = "file string, feature_id int, x float, y float, a float, b float, c float, words array<long>, descriptor array<float>"


@dataclass(frozen=True)
class Kind:
    """How a tool's files are read: the descriptor's type and whether the stored matrix is inverted. The two are independent."""

    dtype: str
    invert: bool


#: Presets by the number that the tools go by (fixed values): 0 VL_FEAT, 1 VGG, 2 HesAff.
KINDS = {0: Kind("u1", True), 1: Kind("<f4", False), 2: Kind("u1", False)}


def record(words: int, dtype: str, dimensions: int = DIMENSIONS) -> np.dtype:
    """One feature: five floats, the words, the descriptor."""
    return np.dtype([("k", "<f4", (5,)), ("words", "<u4", (words,)), ("descriptor", dtype, (dimensions,))])


def _batch(name: str, k: np.ndarray, words: np.ndarray, descriptor: np.ndarray) -> pa.RecordBatch:
    n = len(k)
    lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().astype(t)))
    columns = [pa.array([name] * n), pa.array(np.arange(n), pa.int32()), *[pa.array(k[:, j].astype(np.float32)) for j in range(5)], lists(words, np.int64), lists(descriptor, np.float32)]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ROWS.split(", ")])


def _files(spark: SparkSession, path: str, parse, mode: str) -> DataFrame:
    """Rows of all files; a file that can't be parsed fails the job (FAILFAST) or is left out (PERMISSIVE)."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(mode)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, content = b.column("path")[i].as_py(), b.column("content")[i].as_py()
                try:
                    k, words, descriptor = parse(content)
                except ValueError as problem:
                    if mode == "FAILFAST":
                        raise ValueError(f"{name}: {problem}") from problem
                    continue
                for a in range(0, len(k), 4096):
                    out = _batch(name, k[a : a + 4096], words[a : a + 4096], descriptor[a : a + 4096])
                    yield out.set_column(1, "feature_id", pa.array(np.arange(a, a + out.num_rows), pa.int32()))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def read_text(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Features of text files: '128 n', then x y a b c and 128 entries each. n may be 0."""

    def parse(content: bytes):
        numbers = np.array(content.split(), float)
        if len(numbers) < 2 or numbers[0] != DIMENSIONS or numbers[1] < 0 or len(numbers) < 2 + numbers[1] * (5 + DIMENSIONS):
            raise ValueError("not a feature file of 128 dimensions")
        n = int(numbers[1])
        rows = numbers[2 : 2 + n * (5 + DIMENSIONS)].reshape(n, 5 + DIMENSIONS)
        return rows[:, :5], np.zeros((n, 0)), rows[:, 5:]

    return _files(spark, path, parse, mode)


def read_binary(spark: SparkSession, path: str, words: int = 0, dtype: str = "u1", mode: str = "FAILFAST") -> DataFrame:
    """Features of binary files: a 32-bit count and as many records."""
    kind = record(words, dtype)

    def parse(content: bytes):
        n = int(np.frombuffer(content, "<u4", 1)[0]) if len(content) >= 4 else -1
        if n < 0 or len(content) < 4 + n * kind.itemsize:
            raise ValueError("shorter than its count of features")
        rows = np.frombuffer(content, kind, n, 4)
        return rows["k"], rows["words"].reshape(n, words), rows["descriptor"]

    return _files(spark, path, parse, mode)


def read_features(spark: SparkSession, path: str, sift_type: int, words: int, mode: str = "FAILFAST") -> DataFrame:
    """Features with words by a tool's preset, ellipses in canonical form."""
    kind = KINDS[sift_type]
    return canonical(read_binary(spark, path, words, kind.dtype, mode), kind.invert)


def canonical(df: DataFrame, invert: bool) -> DataFrame:
    a, b, c = C.canonical_ellipse("a", "b", "c", invert)
    return df.withColumns({"a": a.cast("float"), "b": b.cast("float"), "c": c.cast("float")})


def root_sift(df: DataFrame, descriptor: str = "descriptor") -> DataFrame:
    return df.withColumn(descriptor, C.root_sift(F.col(descriptor)))


def with_ids(features: DataFrame, images: DataFrame, suffix: str = "") -> DataFrame:
    """Features with the id of their image: names in the list are matched by the end of the file's path. Files that the list doesn't name are left out."""
    base: Column = F.element_at(F.split("file", "/"), -1)
    return features.withColumn("base", base).join(images.select(F.col("id").alias("image_id"), F.concat(F.element_at(F.split("name", "/"), -1), F.lit(suffix)).alias("base")), "base").drop("base", "file")


def to_files(df: DataFrame, words: int, dtype: str = "u1", by: str = "image_id") -> DataFrame:
    """(image_id, content): each image's features as the bytes of a binary file, in order of feature_id. An image's features fit into memory."""
    kind = record(words, dtype)

    def each(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["feature_id"])
        out = np.zeros(len(rows), kind)
        for n, r in enumerate(rows):
            out["k"][n] = [r[c] for c in "xyabc"]
            out["words"][n] = (r["words"] or [])[:words]
            out["descriptor"][n] = r["descriptor"]
        return pa.table({by: key[:1], "content": pa.array([np.uint32(len(rows)).tobytes() + out.tobytes()], pa.binary())})

    return df.select(by, "feature_id", "x", "y", "a", "b", "c", F.coalesce("words", F.array().cast("array<long>")).alias("words"), "descriptor").groupBy(by).applyInArrow(each, f"{by} {df.schema[by].dataType.simpleString()}, content binary")


def write_files(df: DataFrame, folder: str, words: int, dtype: str = "u1", by: str = "image_id", suffix: str = ".bin") -> DataFrame:
    """Writes each image's features as a file `<image><suffix>` of the folder, from the tasks that hold them, and returns (file, bytes). Nothing is written before an action.

    A file is written under a name of its attempt and then renamed, so that a task that runs again, or twice, leaves whole files. The folder must be one that all executors share.
    """

    def run(batches):
        files, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(base)
        for b in batches:
            done = []
            for image, content in zip(b.column(by).to_pylist(), b.column("content").to_pylist(), strict=True):
                name, attempt = f"{base}/{image}{suffix}", f"{base}/_{uuid.uuid4().hex}"
                with files.open_output_stream(attempt) as f:
                    f.write(content)
                files.move(attempt, name)
                done.append((name, len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["file", "bytes"])

    return to_files(df, words, dtype, by).mapInArrow(run, "file string, bytes long")
