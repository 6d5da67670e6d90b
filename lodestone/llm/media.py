"""Media columns in content-defined chunks.

Each text's UTF-8 bytes, filled up with 255 to a positive multiple of 576, are
stored as the 8-bit samples of a mono WAV stream. A gear hash rolls over the
stream; where its upper bits are zero a chunk ends, so that equal stretches of
different media give equal chunks. Digests are counted by Spark joins. A medium's row
holds the ordered list of its digests, and the bytes of those chunks that it owns: a chunk is owned by the
least of the rows that hold it, and stored there only, so that no bytes are
stored twice. Owners are elected among digests alone, and only rows with a chunk that other rows hold as well take part in
the join; the bytes of owned chunks that others need are written as a table of their own.
Reading joins each medium's list with that table; the chunks that very many media need are few, and sent to all
tasks. The SHA-256 of every chunk and of the medium is checked.

Defined results: a null text counts as empty (its payload is one unit of 576 bytes);
equal texts give equal rows; repeated rows, null and repeated ids give one row each;
an empty table gives an empty table; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begun, discard, grouped, small_batches, written

UNIT = 576
RATE = 8000
LEAST, MOST, MASK_BITS = 2048, 65536, 12  # a cut each 4 KiB beyond the least length, on average
#: Chunks with over one in SHARE of all rows of shared digests, and OFTEN at least, are sent to all tasks: fewer than SHARE chunks, 64 KiB each at most.
SHARE, OFTEN = 1000, 500
LEVEL = 6  # of compression
#: The gear table: 256 words from a fixed generator.
GEAR = np.random.Generator(np.random.PCG64(576)).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def wav(samples: bytes) -> bytes:
    """A mono PCM stream of 8-bit samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples_of(stream: bytes) -> bytes:
    if stream[:4] != b"RIFF" or stream[36:40] != b"data":
        raise ValueError("not a stream of this package")
    (n,) = struct.unpack("<I", stream[40:44])
    return stream[44 : 44 + n]


def cuts(stream: bytes) -> list[int]:
    """Ends of the chunks of a stream.

    The hash at a byte is the sum of the gear words of the last 32 bytes, each
    doubled once for every byte since; it is built by doubling the reach five times.
    """
    n = len(stream)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(stream, np.uint8)]
    for reach in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h = longer
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(marks, at + LEAST))
        end = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def chunked(text: str) -> tuple[bytes, int, list[bytes]]:
    """The payload, the text's bytes, and the stream's chunks."""
    body, n = payload(text)
    stream = wav(body)
    ends = cuts(stream)
    return body, n, [stream[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def feature(samples: bytes) -> str:
    """Root mean square, zero crossings and entropy of the samples around their middle."""
    x = np.frombuffer(samples, np.uint8)
    centred = x.astype(np.int16) - 128
    count = np.bincount(x, minlength=256)
    share = count[count > 0] / len(x)
    rms = float(np.sqrt(np.dot(count, (np.arange(256) - 128.0) ** 2) / len(x)))
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    return f"rms={rms:.4f};zcr={crossings};entropy={abs(float((share * np.log2(share)).sum())):.4f}"


def _zipped(texts: pa.Array) -> pa.Array:
    zip_ = zstandard.ZstdCompressor(level=LEVEL).compress
    return pa.array([None if t is None else zip_(t) for t in (x.as_py() for x in texts)], pa.binary())


def _rows(docs: DataFrame, files: bool) -> DataFrame:
    """doc_id, text and ``row``, a name of each row that stays the same whenever the rows are read."""
    if files:
        place = F.concat(F.unhex(F.substring(F.md5(F.col("_metadata.file_path")), 1, 16)), F.unhex(F.lpad(F.hex(F.col("_metadata.row_index")), 10, "0")))
        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), place.alias("row"))
    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")).alias("row")), "rows")


def stored(docs: DataFrame, files: bool = False) -> tuple[DataFrame, DataFrame]:
    """The two tables of the store: media with their digest lists and the chunks that are theirs alone, and shared chunks by digest.

    In ``own`` a chunk of the list is null where it lies in the shared table. Chunk bytes are compressed. With ``files``, ``docs`` is
    a table read from Parquet files and nothing else: then a row is told by its file and place in it, and no copy of the texts is written first.
    """
    small_batches(docs.sparkSession)
    since = begun()
    rows = _rows(docs, files)

    def names(batches):
        for table in grouped(batches, 4 << 20):
            found, row = [], []
            for r, t in zip(table["row"].to_pylist(), table["text"].to_pylist(), strict=True):
                some = {digest(c) for c in chunked(t or "")[2]}
                found += some
                row += [r] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(row, pa.binary())], ["digest", "row"])

    held = written(rows.select("row", "text").mapInArrow(names, "digest binary, row binary"), "digests")
    shared = written(held.groupBy("digest").agg(F.count("*").alias("n"), F.min("row").alias("owner")).where("n > 1"), "shared")
    # What each row has to know: which of its chunks are shared, and which of these it owns.
    told = _joined(held, shared).groupBy("row").agg(F.collect_list(F.struct("digest", (F.col("owner") == F.col("row")).alias("mine"))).alias("told"))
    # Texts are dealt out compressed.
    known = rows.select("doc_id", "row", F.arrow_udf(_zipped, "binary")(F.col("text").cast("binary")).alias("text")).join(told, "row", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("sha", pa.binary()), ("digests", pa.list_(pa.binary())), ("own", pa.list_(pa.binary())), ("given", pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())])))])

    def run(batches):
        zip_, unzip = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        for table in grouped(batches, 2 << 20):
            out = []
            for r in table.to_pylist():
                mine = {x["digest"]: x["mine"] for x in r["told"] or []}
                body, n, chunks = chunked(unzip(r["text"]).decode("utf-8", "surrogatepass") if r["text"] else "")
                found = [digest(c) for c in chunks]
                given = {d: c for d, c in zip(found, chunks, strict=True) if mine.get(d)}
                out.append({"doc_id": r["doc_id"], "row": r["row"], "n_bytes": n, "payload_bytes": len(body), "sha": hashlib.sha256(b"".join(chunks)).digest(), "digests": found, "own": [None if d in mine else zip_(c) for d, c in zip(found, chunks, strict=True)], "given": [{"digest": d, "data": zip_(c)} for d, c in given.items()]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    cut = written(known.select("doc_id", "row", "text", "told").mapInArrow(run, "doc_id long, row binary, n_bytes long, payload_bytes long, sha binary, digests array<binary>, own array<binary>, given array<struct<digest:binary,data:binary>>"), "media")
    # Lists of digests and any copy of the texts have served.
    discard(docs.sparkSession, since, cut.select("row").unionAll(shared.select(F.hex("digest"))))
    chunks = cut.where(F.size("given") > 0).select(F.explode("given").alias("x")).select("x.digest", "x.data").join(shared.select("digest", "n"), "digest")
    return cut.drop("given"), chunks


def _joined(many: DataFrame, shared: DataFrame) -> DataFrame:
    """``many`` rows of digests with what ``shared`` (digest, n, …) has of them; frequent digests are broadcast, so that no task gathers one's rows."""
    least = max(OFTEN, (shared.agg(F.sum("n")).first()[0] or 0) // SHARE)
    often = F.broadcast(shared.where(F.col("n") > least))
    rare = many.join(often.select("digest"), "digest", "left_anti").join(shared.where(F.col("n") <= least), "digest")
    return many.join(often, "digest").unionByName(rare)


def rebuilt(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, digests of what is read back, and the feature."""
    whole = media.where(~F.exists("own", lambda x: x.isNull())).select("doc_id", "n_bytes", "payload_bytes", "sha", "digests", "own")
    parts = media.where(F.exists("own", lambda x: x.isNull()))
    need = parts.select("row", F.posexplode(F.arrays_zip("digests", "own")).alias("pos", "x")).where("x.own is null").select("row", "pos", F.col("x.digests").alias("digest"))
    got = _joined(need, chunks).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "data"))).alias("at"))
    filled = parts.join(got, "row").select("doc_id", "n_bytes", "payload_bytes", "sha", "digests", F.transform("own", lambda x, i: F.coalesce(x, F.try_element_at("at", i))).alias("own"))

    def run(batches):
        unzip = zstandard.ZstdDecompressor().decompress
        for table in grouped(batches, 4 << 20):
            rows = []
            for r in table.to_pylist():
                chunks = [unzip(c, max_output_size=MOST) for c in r["own"]]
                stream = b"".join(chunks)
                if [digest(c) for c in chunks] != r["digests"] or hashlib.sha256(stream).digest() != r["sha"]:
                    raise ValueError(f"the stored chunks of document {r['doc_id']} don't give its medium")
                body = samples_of(stream)
                rows.append({"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest(), "tail_crc32": zlib.crc32(body[-32:]), "media_bytes": len(stream), "media_sha256": hashlib.sha256(stream).hexdigest(), "feature": feature(body), "n_chunks": len(chunks)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int32())]))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"
    return whole.unionByName(filled).mapInArrow(run, schema)


def round_trip(docs: DataFrame, files: bool = False) -> DataFrame:
    """Store every text as a medium and read all of them back; ``files`` as in ``stored``."""
    media, chunks = stored(docs, files)
    return rebuilt(media, written(chunks, "chunks"))
