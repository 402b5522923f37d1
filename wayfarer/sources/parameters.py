"""Vocabulary, projection and thresholds as text; the index and its weights in their former binary form; rankings as text.

Parquet is the engine's own form of all these (operators.index.save). What is read here are parameters, or files of an earlier tool.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import density
from ..operators.index import Index
from ..operators.rank import SCHEMES
from .store import Steps

DIMENSIONS, BITS = 128, 64
POSTING = np.dtype([("image_id", "<i4"), ("k", "<f4", (5,)), ("code", "<u8")])


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, t) of the lines that aren't empty: their numbers, in order over all parts of the file, and their tokens. The driver holds a count for each part."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"), F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")).where(F.col("t")[0] != "")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    counts = sorted((r.part, r["count"]) for r in lines.groupBy("part").count().collect())
    before, total = [], 0
    for part, n in counts:
        before += [F.lit(part), F.lit(total).cast("long")]
        total += n
    start = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0).cast("long")
    return lines.select((start + inside - 1).alias("line"), "t")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word_id, center) from rows of 128 numbers, rounded to bytes; the n-th row is word n.

    A file of one word a line, as they are written, is read in parts, line by line. Numbers that are laid out otherwise are put in order first, one by one.
    """
    lines = _numbered_lines(spark, path)
    if not lines.where(F.size("t") != DIMENSIONS).limit(1).count():
        rows = lines.select(F.col("line").alias("word_id"), F.transform("t", lambda x: x.cast("double")).alias("center"))
    else:
        tokens = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "x"))
        number = tokens.select(F.floor(F.col("pos") / DIMENSIONS).alias("word_id"), "pos", F.col("x").cast("double").alias("x"))
        rows = number.groupBy("word_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("center")).where(F.size("center") == DIMENSIONS)
    return rows.select(F.col("word_id").cast("long").alias("word_id"), C.quantize(F.col("center")).alias("center"))


def read_matrix(spark: SparkSession, path: str, rows: int = BITS, columns: int = DIMENSIONS) -> np.ndarray:
    """A projection, row by row."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    out = np.array(text.split(), np.float32)
    if len(out) < rows * columns:
        raise ValueError(f"{len(out)} numbers for a {rows} x {columns} matrix")
    return out[: rows * columns].reshape(rows, columns)


def read_thresholds(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """((word_id, thresholds), projection) from 'W 128 64', W rows of 64 and the projection."""
    numbers = np.array("".join(r.value for r in spark.read.text(path, wholetext=True).collect()).split(), float)
    words, dimensions, bits = (int(x) for x in numbers[:3])
    if (dimensions, bits) != (DIMENSIONS, BITS) or len(numbers) < 3 + words * bits + bits * dimensions:
        raise ValueError(f"{dimensions} dimensions, {bits} bits, {len(numbers)} numbers")
    rows = numbers[3 : 3 + words * bits].astype(np.float32).reshape(words, bits)
    table = pa.table({"word_id": np.arange(words), "thresholds": pa.ListArray.from_arrays(pa.array(np.arange(words + 1) * bits, pa.int32()), pa.array(rows.ravel()))})
    return spark.createDataFrame(table), numbers[3 + words * bits :][: bits * dimensions].astype(np.float32).reshape(bits, dimensions)


def thresholds_text(model: DataFrame, projection: np.ndarray) -> str:
    """The same, written out with all the digits of a float."""
    rows = model.orderBy("word_id").select("thresholds").collect()
    line = lambda r: " ".join(repr(float(x)) for x in r)
    return "\n".join([f"{len(rows)} {projection.shape[1]} {projection.shape[0]}", *[line(r.thresholds) for r in rows], *[line(r) for r in projection.tolist()]]) + "\n"


HEAD = "<ifi"
HEAD_BYTES = struct.calcsize(HEAD)
#: Bytes of a word's thresholds and densities, between its head and its postings.
MODEL_BYTES = 4 * BITS + 256 * BITS // 8
START = 8 + 4 * BITS * DIMENSIONS


def _open(path: str):
    """A file that can be read at any place, by its path or address."""
    files, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return files.open_input_file(name)


def index_layout(path: str) -> tuple[list[tuple[int, int]], np.ndarray, bytes]:
    """Where each word of an index file starts and how many postings it has, the projection, and the words' flags. Only the words' heads are read."""
    with _open(path) as f:
        size = f.size()
        if size < START:
            raise ValueError("shorter than its head")
        words, bits = struct.unpack("<ii", f.read(8))
        if words <= 0 or bits != BITS:
            raise ValueError(f"{words} words of {bits} bits")
        projection = np.frombuffer(f.read(START - 8), "<f4").reshape(bits, DIMENSIONS)
        places, at = [], START
        for _ in range(words):
            f.seek(at + 8)
            head = f.read(4)
            f.seek(at + HEAD_BYTES + MODEL_BYTES)
            count = f.read(8)
            if len(head) < 4 or len(count) < 8:
                raise ValueError("shorter than its words")
            if struct.unpack("<i", head)[0] != bits:
                raise ValueError(f"a word has {struct.unpack('<i', head)[0]} bits")
            places.append((at, struct.unpack("<Q", count)[0]))
            at += HEAD_BYTES + MODEL_BYTES + 8 + places[-1][1] * POSTING.itemsize
        f.seek(at)
        flags = f.read(words)
        if len(flags) < words:
            raise ValueError("shorter than its words")
    return places, projection, flags


def index_bytes(model: list, sigma: dict, postings: dict, projection: np.ndarray) -> bytes:
    """The file of an index: model rows (word, thresholds, v, initialised), sigma[word] (8 x 256) and postings[word] (image, x, y, a, b, c, code)."""
    out = [struct.pack("<ii", len(model), BITS), np.asarray(projection, "<f4").tobytes()]
    for word, thresholds, v, _ in model:
        rows = np.array([(i, k, np.int64(code).view(np.uint64)) for i, *k, code in postings.get(word, [])], POSTING) if postings.get(word) else np.zeros(0, POSTING)
        out += [struct.pack("<ifi", word, v, BITS), np.asarray(thresholds, "<f4").tobytes(), np.asarray(sigma.get(word, np.zeros((BITS // 8, 256))), "u1").tobytes(), struct.pack("<Q", len(rows)), rows.tobytes()]
    return b"".join([*out, bytes(int(m[3]) for m in model)])


def parse_weights(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """idf by word and norm by image of a weights file."""
    (words,) = struct.unpack_from("<i", content)
    (images,) = struct.unpack_from("<i", content, 4 + 4 * max(words, 0))
    if words <= 0 or images <= 0:
        raise ValueError(f"{words} words, {images} images")
    return np.frombuffer(content, "<f4", words, 4), np.frombuffer(content, "<f4", images, 8 + 4 * words)


def weights_bytes(idf: np.ndarray, norm: np.ndarray) -> bytes:
    return struct.pack("<i", len(idf)) + np.asarray(idf, "<f4").tobytes() + struct.pack("<i", len(norm)) + np.asarray(norm, "<f4").tobytes()


def _content(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def read_index(spark: SparkSession, index_path: str, weights_path: str, rows_a_part: int = 1 << 20) -> tuple[Index, np.ndarray]:
    """An index of an earlier tool. The driver reads where each word lies; tasks read ranges of words, a long list in several pieces. The path must be one that all executors can read."""
    places, projection, flags = index_layout(index_path)
    idf, norm = parse_weights(_content(spark, weights_path))
    if len(idf) != len(places):
        raise ValueError("the weights don't fit the index")
    base, pieces = 0, []
    for at, n in places:
        pieces += [(at, first, min(rows_a_part, n - first), base + first) for first in range(0, n, rows_a_part)]
        base += n
    parts = max(1, min(len(pieces), base // rows_a_part + 1))
    named = lambda rows, shape: spark.createDataFrame(rows, shape)
    lists = lambda x, t: pa.array(list(x), t)

    def read_postings(batches):
        with _open(index_path) as f:
            for b in batches:
                for at, first, n, number in zip(*(b.column(c).to_pylist() for c in ("at", "first", "n", "number")), strict=True):
                    f.seek(at)
                    (word,) = struct.unpack("<i", f.read(4))
                    f.seek(at + HEAD_BYTES + MODEL_BYTES + 8 + first * POSTING.itemsize)
                    r = np.frombuffer(f.read(n * POSTING.itemsize), POSTING)
                    columns = [np.full(n, word, np.int64), np.arange(number, number + n), r["image_id"], *[np.ascontiguousarray(r["k"][:, j]) for j in range(5)], r["code"].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word_id", "posting_id", "image_id", "x", "y", "a", "b", "c", "code"])

    def read_models(batches):
        with _open(index_path) as f:
            for b in batches:
                for at, used in zip(b.column("at").to_pylist(), b.column("used").to_pylist(), strict=True):
                    f.seek(at)
                    head = f.read(HEAD_BYTES + MODEL_BYTES)
                    word, v, _ = struct.unpack_from(HEAD, head)
                    thresholds = np.frombuffer(head, "<f4", BITS, HEAD_BYTES)
                    sigmas = np.frombuffer(head, "u1", 256 * BITS // 8, HEAD_BYTES + 4 * BITS).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array([word], pa.int64()), lists([thresholds], pa.list_(pa.float32())), pa.array([float(v)]), pa.array([used]), lists([sigmas], pa.list_(pa.int8()))], ["word_id", "thresholds", "v", "initialized", "sigmas"])

    asked = named(pieces, "at long, first long, n long, number long").repartition(parts)
    rows = asked.mapInArrow(read_postings, "word_id long, posting_id long, image_id int, x float, y float, a float, b float, c float, code long")
    heads = named([(at, bool(u)) for (at, _), u in zip(places, flags, strict=True)], "at long, used boolean").repartition(max(1, len(places) // 4096))
    steps = Steps(spark, "read_index")
    models = steps.write(heads.mapInArrow(read_models, "word_id long, thresholds array<float>, v double, initialized boolean, sigmas array<tinyint>"))
    whole = steps.write(density.with_sigma(rows, models.select("word_id", "sigmas"), models.select("word_id", "v")))
    weights = named([(i, float(x)) for i, x in enumerate(idf)], "word_id long, idf double")
    norms = named([(i, float(x)) for i, x in enumerate(norm)], "image_id int, norm double")
    return Index(whole, models.drop("sigmas"), models.select("word_id", "sigmas"), weights, norms), projection


def write_index(index: Index, projection: np.ndarray, path: str) -> None:
    """The index as such a file, densities included, word by word: for other tools; its own form is operators.index.save(). A file is one record, so it is written in
    one place; words come in order and are held one at a time."""
    words = index.word_model.join(index.sigma, "word_id", "left").select("word_id", "thresholds", "v", "initialized", "sigmas")
    lists = index.postings.groupBy("word_id").agg(F.sort_array(F.collect_list(F.struct("image_id", "posting_id", "x", "y", "a", "b", "c", "code"))).alias("rows"))
    flags = []
    files, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with files.open_output_stream(name) as f:
        f.write(struct.pack("<ii", words.count(), BITS) + np.asarray(projection, "<f4").tobytes())
        for w in words.join(lists, "word_id", "left").orderBy("word_id").toLocalIterator():
            rows = np.array([(r.image_id, (r.x, r.y, r.a, r.b, r.c), np.int64(r.code).view(np.uint64)) for r in w.rows or []], POSTING)
            f.write(struct.pack(HEAD, w.word_id, w.v, BITS) + np.asarray(w.thresholds, "<f4").tobytes() + np.asarray(w.sigmas or np.zeros(2048), "u1").tobytes() + struct.pack("<Q", len(rows)) + rows.tobytes())
            flags.append(w.initialized)
        f.write(bytes(map(int, flags)))


def read_external_sigma(spark: SparkSession, path: str, words: int) -> DataFrame:
    """(word_id, s, byte, sigma) of densities learned elsewhere: for each word 8 x 256 bytes and a shift; never below 0.01."""
    content, size = _content(spark, path), 8 * 256 + 8
    if len(content) < words * size:
        raise ValueError("shorter than its words")
    rows = []
    for w in range(words):
        table = np.frombuffer(content, "u1", 2048, w * size).reshape(8, 256)
        (shift,) = struct.unpack_from("<d", content, w * size + 2048)
        rows += [(w, s, b, max(float(table[s, b]) + shift, 0.01)) for s in range(8) for b in range(256)]
    return spark.createDataFrame(rows, "word_id long, s int, byte int, sigma double")


def ranking_lines(rankings: DataFrame, queries: DataFrame, images: DataFrame) -> DataFrame:
    """(scheme, query_id, rank, line): the text of the six ranking files, '<query>jpg <image> <score>'."""
    named = rankings.join(queries.select(F.col("id").alias("query_id"), F.col("name").alias("query")), "query_id").join(images.select(F.col("id").alias("image_id"), F.col("name").alias("image")), "image_id")
    return named.select("scheme", "query_id", "rank", F.concat(F.concat("query", F.lit("jpg")), F.lit(" "), "image", F.lit(" "), F.col("score").cast("string")).alias("line"))


def write_rankings(lines: DataFrame, prefix: str) -> None:
    """One folder of text for each scheme, lines by query and rank."""
    for scheme in SCHEMES:
        lines.where(F.col("scheme") == scheme).repartitionByRange("query_id").sortWithinPartitions("query_id", "rank").select("line").write.mode("overwrite").text(f"{prefix}.{scheme}_ranking.txt")
