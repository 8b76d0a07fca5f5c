"""Media columns: payloads as 8-bit sound, kept as content-defined chunks stored once.

A payload becomes a WAV file of one channel of unsigned 8-bit samples.  A rolling gear hash
over 32 bytes cuts it where its upper bits are zero, so equal stretches of different media cut
alike.  Digests are joined to find chunks that several media share.  What is written is each
distinct chunk once, those of one medium with that medium and shared ones in the chunk
store, and for each medium the ordered list of its chunks' digests.  Reading back has these
tables alone: own chunks come from the medium's row, shared ones by join from the
store, the list puts them in order, and every digest, that of the whole too, is checked.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, codes, steps
from .workspace import materialise

UNIT, RATE, HEADER = 192, 8000, 44
LEAST, CUT_BITS, MOST = 512, 10, 8192
GEAR = (codes(77) >> U64(32)).astype(np.uint32)


def pad(raw: bytes) -> bytes:
    """``raw`` and spaces up to a positive multiple of ``UNIT``."""
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(payload: bytes) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def from_wav(media: bytes) -> bytes:
    riff, size, wave, fmt, _, kind, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) != HEADER + n or size != 36 + n:
        raise ValueError("not a sound file of 8-bit samples in one channel")
    return media[HEADER:]


def features(payload: bytes) -> str:
    """Mean, root mean square and crossings of the middle of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def cut(media: list[bytes]) -> list[list[int]]:
    """Where the chunks of each medium end."""
    if not media:
        return []
    data = np.frombuffer(b"".join(media), np.uint8)
    h = GEAR[data]
    with np.errstate(over="ignore"):
        for width in (1, 2, 4, 8, 16):  # doubling: in the end the sum of GEAR << age over 32 bytes
            shifted = h[:-width] << np.uint32(width)
            h = h.copy()
            h[width:] += shifted
    ends = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, base = [], 0
    for m in media:
        cuts, at, n = [], 0, len(m)
        while at < n:
            i = bisect_left(ends, base + at + LEAST)
            to = min(n, at + MOST, ends[i] - base if i < len(ends) else n)
            cuts.append(to)
            at = to
        out.append(cuts)
        base += n
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _wavs(batch: pa.RecordBatch) -> list[bytes]:
    return [to_wav(pad((t or "").encode())) for t in batch.column("text").to_pylist()]


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in steps(whole, "text"):
            wavs, keys, out = _wavs(batch), [], []
            for key, m, cuts in zip(batch.column("k").to_pylist(), wavs, cut(wavs), strict=True):
                found = {digest(m[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)}
                keys += [key] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["k", "digest"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Media on their way to the list of their shared chunks."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=LEVEL)
    for whole in batches:
        for batch in steps(whole, "text"):
            packed = [packer.compress(w) for w in _wavs(batch)]
            n = [len((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "k", "n_bytes", "packed"])


class _Described:
    """Columns that describe media read back."""

    NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks", "n_shared"]
    TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    DDL = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long, n_shared long"

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, parts: list[bytes], shared: int) -> None:
        media = b"".join(parts)
        payload = from_wav(media)
        self.rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload), len(parts), shared))

    def arrays(self) -> list[pa.Array]:
        return [pa.array([r[i] for r in self.rows], t) for i, t in enumerate(self.TYPES)]


def _pieces(media: bytes, cuts: list[int]) -> list[bytes]:
    return [media[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


OWN, LENT, BORROWED = 0, 1, 2  # where a chunk of a list is: with its medium, or in the store by this medium or another
STORED = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "k": pa.int64(), "list": pa.list_(pa.binary()), "places": pa.binary(), "whole": pa.binary(),
    "own": pa.binary(), "sizes": pa.list_(pa.int32()), "digest": pa.binary(), "chunk": pa.binary(),
}
STORED_DDL = "doc_id long, n_bytes long, k long, list array<binary>, places binary, whole binary, own binary, sizes array<int>, digest binary, chunk binary"
MEDIUM = ["doc_id", "n_bytes", "k", "list", "places", "whole", "own", "sizes"]
SLICE, LEVEL, PAGES = 200, 15, 9
BLOCK = 1 << 17


def _stored_frame(raw: bytes) -> bytes:
    """A zstandard frame of stored blocks, for bytes that the pages of a table compress better together."""
    ends = [*range(BLOCK, len(raw), BLOCK), len(raw)]
    blocks = [struct.pack("<I", (b - a) << 3 | (b == len(raw)))[:3] + raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return b"".join([struct.pack("<IBQ", 0xFD2FB528, 0xE0, len(raw)), *blocks])


def _stored(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in STORED.items()], names=list(STORED))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of media, without the bytes of their shared chunks, and rows of the store, which have a digest."""
    import zstandard

    packer, unpacker = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    last, given = None, set()  # repeated rows have one key and follow each other: their chunks are given out once
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            rows = batch.slice(lo, SLICE).to_pylist()
            media = [unpacker.decompress(x["packed"]) for x in rows]
            out, digests, chunks = {c: [] for c in MEDIUM}, [], []
            for x, m, cuts in zip(rows, media, cut(media), strict=True):
                if x["k"] != last:
                    last, given = x["k"], set()
                shared, lent = set(x["shared"] or ()), set(x["lent"] or ())
                parts = _pieces(m, cuts)
                order, own = [digest(part) for part in parts], {}
                for d, part in zip(order, parts, strict=True):
                    if d not in shared:
                        own[d] = part
                    elif d in lent and d not in given:
                        given.add(d)
                        digests.append(d)
                        chunks.append(packer.compress(part))
                places = bytes(OWN if d not in shared else LENT if d in lent else BORROWED for d in order)
                frame = packer.compress if shared else _stored_frame  # those with shared chunks move again
                row = (x["doc_id"], x["n_bytes"], x["k"], order, places, digest(m), frame(b"".join(own.values())), [len(c) for c in own.values()])
                for c, v in zip(MEDIUM, row, strict=True):
                    out[c].append(v)
            yield _stored(**out)
            if digests:
                yield _stored(digest=digests, chunk=chunks)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            rows, told = batch.slice(lo, SLICE).to_pylist(), _Described()
            for x in rows:
                chunks = {}
                for f in x["fetched"] or ():
                    chunks[f["digest"]] = unpacker.decompress(f["chunk"])
                own, ends = unpacker.decompress(x["own"]), np.cumsum(x["sizes"]).tolist()
                own_digests = dict.fromkeys(d for d, place in zip(x["list"], x["places"], strict=True) if place == OWN)
                chunks |= zip(own_digests, _pieces(own, ends), strict=True)
                if any(digest(c) != d for d, c in chunks.items()):
                    raise ValueError("a stored chunk doesn't match its digest")
                if not chunks.keys() >= set(x["list"]):
                    raise ValueError("a chunk isn't in the store")
                parts = [chunks[d] for d in x["list"]]
                if digest(b"".join(parts)) != x["whole"]:
                    raise ValueError("a rebuilt medium doesn't match its digest")
                told.add(parts, len(parts) - x["places"].count(OWN))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in ("doc_id", "n_bytes")] + told.arrays(), names=["doc_id", "n_bytes", *_Described.NAMES])


def chunk_digests(docs: DataFrame) -> DataFrame:
    """(k, digest): the distinct chunks of each medium of ``docs`` (k, text)."""
    return docs.select("k", "text").mapInArrow(_list_digests, "k long, digest binary")


def store_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes the media of ``docs`` (doc_id, text) as two tables: media with their chunk lists and own chunks, and the store of shared ones (digest, chunk)."""
    # the key only has to be the same each time and spread well: what meets by chance does no harm, as digests decide
    docs = docs.withColumn("k", F.xxhash64("doc_id", "text"))
    chunks = chunk_digests(docs)
    shared = materialise(chunks.groupBy("digest").agg(F.min("k").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner"), "shared-chunks", tidy=True)
    held = chunks.join(shared.hint("merge"), "digest").select("k", "digest", F.when(F.col("k") == F.col("owner"), F.col("digest")).alias("lent"))
    links = held.groupBy("k").agg(F.collect_set("digest").alias("shared"), F.collect_set("lent").alias("lent"))  # a medium's own chunks at most
    packed = docs.mapInArrow(_pack, "doc_id long, k long, n_bytes long, packed binary")
    split = packed.join(links.hint("merge"), "k", "left").select("doc_id", "k", "n_bytes", "packed", "shared", "lent").mapInArrow(_split, STORED_DDL)
    written = materialise(split, "media-chunks", level=PAGES, tidy=True)
    return written.where("digest IS NULL").select(MEDIUM), written.where("digest IS NOT NULL").select("digest", "chunk")


def read_media(media: DataFrame, store: DataFrame) -> DataFrame:
    """Rebuilds every medium from the two tables of ``store_media`` and describes it."""
    ddl = f"doc_id long, n_bytes long, {_Described.DDL}"
    rows = media.select(*MEDIUM, F.expr(f"hex(places) RLIKE '^(0{OWN})*$'").alias("alone"))
    waits = rows.where("NOT alone").drop("alone")
    elsewhere = F.filter("list", lambda _, i: F.substring("places", i + 1, F.lit(1)) != F.unhex(F.lit(f"0{OWN}")))
    wanted = waits.select("k", F.explode(elsewhere).alias("digest")).distinct()
    # both sides of the join are dealt for it alone, so Spark can split a chunk that very many media share; a set, as
    # the rows of one key may be split too when they are stored, and each part then gives its chunks out
    fetched = wanted.join(store.hint("merge"), "digest").groupBy("k").agg(F.collect_set(F.struct("digest", "chunk")).alias("fetched"))
    late = waits.join(fetched, "k", "left").select(*MEDIUM, "fetched").mapInArrow(_rebuild, ddl)
    none = F.lit(None).cast("array<struct<digest:binary,chunk:binary>>").alias("fetched")
    return rows.where("alone").select(*MEDIUM, none).mapInArrow(_rebuild, ddl).unionByName(late)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text of ``docs`` as a medium, reads all back and describes what was read.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_chunks and n_shared (chunks that another medium has too, read from
    the store).  Equal texts have equal values.  A null or empty text has a payload of spaces;
    repeated rows are media of their own; a null id stays null; an empty table gives an empty result.

    Media move once, to meet the list of their shared chunks; those that have any
    move a second time, to meet the chunks.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read_media(*store_media(docs))
