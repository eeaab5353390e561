"""Token-id files: each document's ids compressed on its own under a shared zstandard dictionary.

A shard file holds, in this order: MAGIC; a header of width of an id in bytes, format version, number of documents and the
dictionary's sha256; the documents' zstandard frames; the offset index, per document the id (64 bits, the least value
standing for null), frame offset, frame length and number of ids; and the index's own offset. A reader seeks to the index
and decompresses only the document it needs. The dictionary file stands beside the shards, named by its hash.

Shards hold ascending ids over disjoint ranges. Null ids come first, ties by the text's hash, then by text. Null or empty texts have only the end
id. Repeated rows are stored as often as they come. No rows: no shards.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table, tidy, written
from .tokens import WordIds

MAGIC = b"LSMTOK1\n"
HEADER = struct.Struct("<HHI32s")
ENTRY = np.dtype([("doc", "<i8"), ("at", "<u8"), ("size", "<u4"), ("n", "<u4")])
NO_ID = -(2**63)
TOKENIZER, END_ID = "word_bpe_49k.json", 2
_WORDS: dict[str, WordIds] = {}


def words(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def store(uri: str):
    """File system and path of a folder every executor reaches: file:, hdfs: and the object stores pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """A whole file or none: written under a name of its own, then moved, so a repeated task does no harm."""
    fs, path = store(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(own := f"{path}.{os.getpid()}.{os.urandom(4).hex()}") as f:
        f.write(data)
    fs.move(own, path)


def get(uri: str) -> bytes:
    fs, path = store(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int, dict_bytes: int, sample_bytes: int) -> bytes:
    """A dictionary from the whole id arrays of at most sample_docs documents, the first by hash of their ids, of which those
    with more than sample_bytes of text are left out: a dictionary serves short documents, and the driver's share stays bounded.

    Too few documents to train on: an empty dictionary, and frames without one.
    """
    import zstandard

    enc = words(tokenizer)
    end = np.array([end_id], enc.kind).tobytes()
    rows = docs.select(F.xxhash64("id").alias("h"), F.col("id")).orderBy("h", "id").limit(sample_docs).select("id").distinct()
    short = docs.join(F.broadcast(rows), "id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
    # ids may repeat, so the rows taken of them are fixed by an order of their own
    got = short.orderBy(F.xxhash64("id"), "id", "text").limit(sample_docs).select("text").collect()
    made = [enc.encode(r.text) + end for r in got]
    try:
        return zstandard.train_dictionary(dict_bytes, made).as_bytes() if len(made) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def shard_bytes(width: int, dictionary: bytes, ids: list, frames: list[bytes], n: list[int]) -> bytes:
    index = np.zeros(len(ids), ENTRY)
    index["doc"] = [NO_ID if i is None else i for i in ids]
    index["size"], index["n"] = [len(x) for x in frames], n
    start = len(MAGIC) + HEADER.size
    index["at"] = start + np.concatenate([[0], np.cumsum(index["size"], dtype=np.uint64)[:-1]]) if ids else 0
    body = b"".join(frames)
    return b"".join([MAGIC, HEADER.pack(width, 1, len(ids), hashlib.sha256(dictionary).digest()), body, index.tobytes(), struct.pack("<Q", start + len(body))])


class Shard:
    """Reads a shard. It refuses another dictionary than the one it was written with."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token-id shard")
        self.width, _, n, digest = HEADER.unpack_from(data, len(MAGIC))
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.data, self.index = data, np.frombuffer(data, ENTRY, n, struct.unpack("<Q", data[-8:])[0])
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        e = self.index[k]
        raw = self.open.decompress(self.data[int(e["at"]) : int(e["at"]) + int(e["size"])], max_output_size=int(e["n"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def write_shards(docs: DataFrame, root: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000, dict_bytes: int = 65_536, sample_bytes: int = 32_768, shard_size: int = 32 << 20, level: int = 3) -> DataFrame:
    """Writes the shards below root and returns the manifest: shard path, n_docs, n_ids, lo and hi id, part and number.

    docs' rows are dealt by range of the id and the text's hash, so one shuffle moves the texts once. shard_size: bytes of ids, uncompressed.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end_id, sample_docs, dict_bytes, sample_bytes)
    name = f"{root}/{hashlib.sha256(dictionary).hexdigest()}.dict"
    put(name, dictionary)

    def run(batches):
        import zstandard

        part, number, enc = TaskContext.get().partitionId(), 0, words(tokenizer)
        d = get(name)
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d) if d else None)
        end = np.array([end_id], enc.kind).tobytes()
        ids, frames, n, held = [], [], [], 0

        def flush():
            nonlocal ids, frames, n, held, number
            path = f"{root}/shard-{part:06d}-{number:05d}.tok"
            put(path, shard_bytes(enc.width, d, ids, frames, n))
            row = (path, part, number, len(ids), sum(n), ids[0], ids[-1])
            ids, frames, n, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["path", "part", "number", "n_docs", "n_ids", "lo", "hi"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = enc.encode(x.as_py()) + end
                ids.append(i)
                frames.append(zip_.compress(raw))
                n.append(len(raw) // enc.width)
                held += len(raw)
                if held >= shard_size:
                    yield flush()
        if ids:
            yield flush()

    # the text's hash is part of the range, so that very many rows of one id, or of none, don't meet in one task
    order = [F.col("id"), F.xxhash64("text")]
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(tidy(run), "path string, part int, number int, n_docs long, n_ids long, lo long, hi long")
    made = written(rows, "manifest")
    return made.withColumn("dictionary", F.lit(name)).withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per stored document: id, start, n_tokens, ids_crc32 and stored_bytes, read from the files."""

    def run(batches):
        for b in batches:
            for path, name, base in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = Shard(get(path), get(name))
                n = s.index["n"].astype(np.int64)
                start = base + np.concatenate([[0], np.cumsum(n)[:-1]])
                crc = [zlib.crc32(s.ids(k).astype("<u4")) for k in range(len(n))]
                yield pa.RecordBatch.from_arrays([pa.array(s.index["doc"], pa.int64(), mask=s.index["doc"] == NO_ID), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(s.index["size"].astype(np.int64))], ["id", "start", "n_tokens", "ids_crc32", "stored_bytes"])

    tasks = max(2, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("path", "dictionary", "start").repartition(tasks).mapInArrow(tidy(run), "id long, start long, n_tokens long, ids_crc32 long, stored_bytes long").withColumnRenamed("id", id_col)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(table(spark, sf_dir, "documents"), scratch(spark, "ids"), public_tokenizers.path(TOKENIZER), END_ID))
