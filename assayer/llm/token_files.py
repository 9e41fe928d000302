"""Token ids in binary files: frames of one document each, compressed with a shared zstandard dictionary."""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import scratch, texts
from .encoder import encoder

#: A file begins with MAGIC, the bytes of an id (2 or 4) and the sha256 of the dictionary.
MAGIC = b"TIDF1"
HEADER = len(MAGIC) + 1 + 32
#: Documents that the dictionary is trained on and bytes of their ids, at most, and its own bytes. It bears on sizes alone.
DICTIONARY_DOCS, DICTIONARY_IDS, DICTIONARY_BYTES = 2000, 8 << 20, 64 << 10
LEVEL = 3
#: Bytes of text that are encoded at once: the more, the fewer pieces are looked for twice.
GATHERED = 4 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def _put(uri: str, content: bytes) -> None:
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(content)


def _get(uri: str) -> bytes:
    fs, path = _open(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def encode(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, tie, ids): each text's ids and the end id, as the bytes of a little-endian array of 2 or 4 bytes each.

    ``tokenizer`` is the content of a tokenizers file; special tokens are not added. Null texts have the end id alone;
    bytes that aren't UTF-8 count as U+FFFD. ``tie`` is a hash of the text.
    """
    spark = docs.sparkSession
    scratch.short_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer)  # a tokenizer file
    sent = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("tie"), texts.utf8(docs, text).alias("text"))
    schema = T.StructType([sent.schema["id"], *T.StructType.fromDDL("tie long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(shared.value)
        for own in texts.gathered(batches, 2, GATHERED):
            flat, counts = known.encode(*texts.flat(own.column(2)))
            ends = np.cumsum(counts)
            made = np.insert(flat, ends, end_id)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * known.type.itemsize
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), texts.binary(offsets, made)], names=["id", "tie", "ids"])

    return sent.mapInArrow(run, schema)


def train_dictionary(encoded: DataFrame, most: int = DICTIONARY_DOCS, most_bytes: int = DICTIONARY_IDS) -> bytes:
    """A dictionary from the whole id arrays of a sample: about ``most`` rows of (id, tie, ids) at most, by the hash of id and
    text, as far as they fit into ``most_bytes`` together (the driver trains it). A sample too small to train on gives no bytes.
    """
    share = min(1.0, most / max(1, encoded.count()))
    lot = F.pmod(F.xxhash64(F.col("id").cast("string"), "tie", F.lit(11)), F.lit(1 << 30))
    sample = scratch.cut(encoded.select(lot.alias("lot"), F.octet_length("ids").alias("n"), "ids").where(F.col("lot") < int(share * (1 << 30))).limit(2 * most), "sample")
    left, chosen = most_bytes, set()
    for r in sample.select("lot", "n").orderBy("lot", "n").collect():
        if r.n <= left:
            left -= r.n
            chosen.add((r.lot, r.n))
    told = encoded.sparkSession.createDataFrame(sorted(chosen), "lot long, n int")  # at most 2 * most rows
    rows = sample.join(F.broadcast(told), ["lot", "n"]).dropDuplicates(["lot", "n"]).orderBy("lot", "n").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r.ids) for r in rows], level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", id: str = "doc_id") -> None:
    """Encode whole texts and write them to files below ``path`` in ascending order of id.

    ``encode`` says how. A task sorts a range of ids and writes one file: header, then a zstandard frame for each document. The table
    ``index`` tells a document's file, offset, bytes, number of ids and the ids before it in the file; ``dictionary``
    holds what the frames refer to. A file of a failed task is in no index row. Null ids come first; rows that repeat an
    id stand side by side, by the hash of their text. An empty table has an index without rows.
    """
    spark = docs.sparkSession
    encoded = scratch.cut(encode(docs, tokenizer, end_id, text, id).withColumn("row", F.monotonically_increasing_id()), "ids")
    dictionary = train_dictionary(encoded)
    _put(f"{path}/dictionary", dictionary)
    width = encoder(tokenizer).type.itemsize
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    sent = encoded.repartitionByRange("id", "tie", "row").sortWithinPartitions("id", "tie", "row").select("id", "ids")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), sent.schema["id"], *T.StructType.fromDDL("offset long, size long, n_tokens long, ahead long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_checksum=True, write_content_size=True)
        part, name = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}.tid"
        fs, place = _open(f"{path}/{name}")
        file, at, ahead = None, HEADER, 0
        try:
            for own in batches:
                if file is None:
                    file = fs.open_output_stream(place)
                    file.write(MAGIC + bytes([width]) + hashlib.sha256(raw).digest())
                flat, bounds = texts.flat(own.column(1))
                frames = [press.compress(flat[a:b]) for a, b in itertools.pairwise(bounds.tolist())]
                file.write(b"".join(frames))
                n, counts, sizes = len(frames), np.diff(bounds) // width, np.fromiter(map(len, frames), np.int64, len(frames))
                columns = [np.full(n, part, np.int32), [name] * n, own.column(0), at + np.cumsum(sizes) - sizes, sizes, counts, ahead + np.cumsum(counts) - counts]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
                at, ahead = at + int(sizes.sum()), ahead + int(counts.sum())
        finally:
            if file is not None:
                file.close()

    with scratch.setting(spark, scratch._KEPT_FILES, "true"):
        sent.mapInArrow(run, schema).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents in the files below ``path``: ``id``, ``start`` (ids before it in all files), ``n_tokens`` and ``frame``
    (its ids, little-endian, unsigned 32 bits), each read at its offset.

    A file whose header names another dictionary is an error.
    """
    index = spark.read.parquet(f"{path}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    placed = index.join(files, F.col("part") == F.col("__part")).select("file", "id", "offset", "size", (F.col("ahead") + F.col("__base")).alias("start"), "n_tokens")
    schema = T.StructType([placed.schema["id"], *T.StructType.fromDDL("start long, n_tokens long, frame binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = _get(f"{path}/dictionary")
        unpack, wanted = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)), hashlib.sha256(raw).digest()
        fs, root = _open(path)
        name, file, width = None, None, 4
        for batch in batches:
            for own in texts.slices(batch, pc.multiply(batch.column(5), 4)):
                out = []
                for f, at, size in zip(own.column(0).to_pylist(), own.column(2).to_pylist(), own.column(3).to_pylist(), strict=True):
                    if f != name:
                        name, file = f, fs.open_input_file(f"{root}/{f}")
                        head = file.read_at(HEADER, 0)
                        if head[: len(MAGIC)] != MAGIC or head[-32:] != wanted:
                            raise ValueError(f"{f} needs another dictionary")
                        width = head[len(MAGIC)]
                    out.append(np.frombuffer(unpack.decompress(file.read_at(size, at)), f"<u{width}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(4), own.column(5), pa.array(out, pa.binary())], schema=arrow)

    return placed.mapInArrow(run, schema)


def read_one(path: str, file: str, offset: int, size: int) -> np.ndarray:
    """The ids of one document, by its index row; nothing else of the file is read."""
    fs, root = _open(path)
    with fs.open_input_file(f"{root}/{file}") as f:
        head, frame = f.read_at(HEADER, 0), f.read_at(size, offset)
    raw = _get(f"{path}/dictionary")
    if head[-32:] != hashlib.sha256(raw).digest():
        raise ValueError(f"{file} needs another dictionary")
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress(frame), f"<u{head[len(MAGIC)]}").astype(np.uint32)

