"""Token-id files: one shared zstandard dictionary, one frame per document.

File layout (little endian): ``RFTK1\\n``, the dictionary's SHA-256 (32 bytes), then the
frames; then the index, four int64 for each document (id, 1 if the id is null, byte offset of
its frame, number of ids), and a trailer: -1, number of documents,
byte offset of the index.  A reader seeks to the trailer, then to one frame.
Ids are stored as uint16 where the vocabulary allows, else as uint32.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import steps
from .tokens import encoder
from .workspace import new_path

MAGIC = b"RFTK1\n"
TRAILER = "<qqq"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else "file://" + uri[5:])


def dictionary_sample(docs: DataFrame, samples: int, longest: int) -> DataFrame:
    """At most ``samples`` texts of ``docs`` (doc_id, text), drawn by row; of a longer text a slice of ``longest`` characters, drawn too."""
    share = min(1.0, 1.1 * samples / max(docs.count(), 1))
    rows = docs.where(F.length("text") > 0).withColumn("draw", F.xxhash64("doc_id", "text"))
    some = rows.where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < share)
    nth = F.pmod(F.xxhash64("draw"), F.ceil(F.length("text") / longest))
    return some.orderBy(F.pmod("draw", F.lit(1 << 30)), "draw").limit(samples).select(F.substring("text", (nth * longest + 1).cast("int"), F.lit(longest)).alias("text"))


def train_dictionary(docs: DataFrame, tokenizer: str, end: int, samples: int = 2000, longest: int = 16_384, size: int = 65_536) -> bytes:
    """A zstandard dictionary fitted on serialized ids of at most ``samples`` documents, or slices of ``longest`` characters of them.

    The sample is the rows of the lowest hashes, so it does not depend on order and copies don't add to it.
    One task trains in memory, so the sample has to be bounded.
    Too little data to train on: an empty dictionary (frames are then plain).
    """
    dtype = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        blobs = []
        for batch in batches:
            ids, at = encoder(tokenizer).encode(batch.column("text"), end)
            blobs += [ids[a:b].astype(dtype).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        trained = b""
        if sum(map(len, blobs)) >= 20 * 4096 and len(blobs) >= 64:
            try:
                trained = zstandard.train_dictionary(min(size, sum(map(len, blobs)) // 10), blobs).as_bytes()
            except zstandard.ZstdError:
                trained = b""
        yield pa.RecordBatch.from_arrays([pa.array([trained], pa.binary())], names=["dictionary"])

    found = dictionary_sample(docs, samples, longest).repartition(1).sortWithinPartitions("text").mapInArrow(run, "dictionary binary").collect()
    return bytes(found[0][0]) if found else b""


def id_type(tokenizer: str) -> str:
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int) -> tuple[DataFrame, bytes]:
    """Writes the ids of ``docs`` (doc_id, text) in ascending doc_id order (nulls first) under ``path``.

    Returns the manifest (file, part, n_docs, n_tokens) and the dictionary.  A file is
    written under another name and renamed when whole, so a task may run twice.
    """
    dictionary, dtype = train_dictionary(docs, tokenizer, end), id_type(tokenizer)
    digest = hashlib.sha256(dictionary).digest()
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, index, at, tokens = TaskContext.get().partitionId(), [], len(MAGIC) + 32, 0
        to, folder = filesystem(path)
        name, enc = f"part-{part:06d}.rftk", encoder(tokenizer)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out = None
        try:
            for whole in batches:
                for batch in steps(whole, "text"):
                    if out is None:
                        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
                        out = to.open_output_stream(draft)
                        out.write(MAGIC + digest)
                    ids, begin = enc.encode(batch.column("text"), end)
                    for key, a, b in zip(batch.column("doc_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                        frame = packer.compress(ids[a:b].astype(dtype).tobytes())
                        out.write(frame)
                        index.append((key or 0, key is None, at, b - a))
                        at += len(frame)
                        tokens += b - a
            if out is not None:
                out.write(np.array(index, "<i8").tobytes() + struct.pack(TRAILER, -1, len(index), at))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            to.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([len(index)], pa.int64()), pa.array([tokens], pa.int64())], names=["file", "part", "n_docs", "n_tokens"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(run, "file string, part int, n_docs long, n_tokens long").collect()  # one row a file
    spark: SparkSession = docs.sparkSession
    rows, start = [], 0
    for r in sorted(manifest, key=lambda r: r["part"]):
        rows.append((r["file"], r["part"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    table = spark.createDataFrame(rows, "file string, part int, n_docs long, n_tokens long, start long")
    return table, dictionary


class TokenFile:
    """Random access to one file; ``dictionary`` must be the one that it was written with."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes, dtype: str):
        import zstandard

        self.file = fs.open_input_file(path)
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no token file")
        if head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        size = self.file.size()
        _, n, at = struct.unpack(TRAILER, self.file.read_at(struct.calcsize(TRAILER), size - struct.calcsize(TRAILER)))
        self.index = np.frombuffer(self.file.read_at(32 * n, at), "<i8").reshape(n, 4)
        self.ends = np.r_[self.index[1:, 2], at] if n else np.zeros(0, np.int64)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.dtype = dtype

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document: one read of its frame alone."""
        at = int(self.index[i, 2])
        frame = self.file.read_at(int(self.ends[i]) - at, at)
        return np.frombuffer(self.unpacker.decompress(frame), self.dtype).astype(np.uint32)

    def ranges(self, most: int = 4_000_000, rows: int = 1000) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, the number of the first and the ids of some: one read for frames of ``most`` bytes or one document."""
        lo = 0
        while lo < len(self):
            at = int(self.index[lo, 2])
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(self.ends, at + most, side="right"))))
            data = memoryview(self.file.read_at(int(self.ends[hi - 1]) - at, at))
            frames = [data[int(a) - at : int(b) - at] for a, b in zip(self.index[lo:hi, 2], self.ends[lo:hi], strict=True)]
            yield lo, [np.frombuffer(self.unpacker.decompress(x), self.dtype).astype(np.uint32) for x in frames]
            lo = hi

    def close(self) -> None:
        self.file.close()


def read_token_files(manifest: DataFrame, path: str, dictionary: bytes, dtype: str, with_ids: bool = False) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32 (and ids), decoded from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                f = TokenFile(fs, f"{folder}/{name}", dictionary, dtype)
                for lo, ids in f.ranges():
                    hi = lo + len(ids)
                    n = np.array([len(x) for x in ids], np.int64)
                    begin = start + np.cumsum(n) - n
                    start += int(n.sum())
                    cols = [pa.array(f.index[lo:hi, 0], pa.int64(), mask=f.index[lo:hi, 1] == 1), pa.array(begin), pa.array(n), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.view(np.int32) for x in ids], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                f.close()

    files = manifest.select("file", "start")
    n = max(1, min(manifest.count(), 10_000))
    return files.repartition(n, "file").mapInArrow(run, schema)


def token_binary(docs: DataFrame, tokenizer: str, end: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Writes ``docs`` as token files (under ``path`` or the shared folder) and reads them back.

    A null text counts as empty, a null id comes first; repeated rows are stored as often
    as they come; an empty table gives no file and an empty result.
    """
    path = path or new_path(docs.sparkSession, "tokens")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    manifest, dictionary = write_token_files(docs, path, tokenizer, end)
    return read_token_files(manifest, path, dictionary, id_type(tokenizer), with_ids)
