"""Framed log segments and checksummed envelopes.

A record is a 16-byte header (magic, version, flags, length, CRC-32 of the
body; little-endian) and a JSON body.  Segments are read whole by Spark's
binary file reader, one task row per segment, and decoded there.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerweave.functions.encoding import number_of

#: Fixed values of the formats.
LOG_MAGIC, CHECKPOINT_MAGIC, MANIFEST_MAGIC = b"LDBW", b"LDBC", b"LDBM"
HEADER, ENVELOPE = "<4sHHII", "<4sII"
VERSIONS = (1, 2)
MAX_RECORD = 1 << 20
REQUIRED = ("type", "lsn", "committed_at", "key", "fingerprint", "request", "result")
RECORDS = "segment bigint, position bigint, problem string, version int, lsn bigint, kind string, committed_at bigint, key string, fingerprint string, request string, result string, state string"


class Corrupt(ValueError):
    """A complete record or envelope whose contents are wrong."""


def encode_record(record: dict, version: int = 2) -> bytes:
    body = json.dumps(record, separators=(",", ":"), ensure_ascii=False).encode()
    if len(body) > MAX_RECORD:
        raise ValueError("record too large")
    return struct.pack(HEADER, LOG_MAGIC, version, 0, len(body), zlib.crc32(body)) + body


def decode_record(data: bytes, at: int = 0) -> tuple[int, dict, int] | None:
    """(version, record, where the next one begins), or None if the data ends within the record."""
    if len(data) - at < struct.calcsize(HEADER):
        return None
    magic, version, flags, size, crc = struct.unpack_from(HEADER, data, at)
    if magic != LOG_MAGIC or version not in VERSIONS or flags or not 0 < size <= MAX_RECORD:
        raise Corrupt("header")
    body = data[at + struct.calcsize(HEADER) : at + struct.calcsize(HEADER) + size]
    if len(body) < size:
        return None
    if zlib.crc32(body) != crc:
        raise Corrupt("checksum")
    try:
        record = json.loads(body)
    except ValueError:
        raise Corrupt("body") from None
    if not isinstance(record, dict) or any(record.get(k) in (None, "") for k in REQUIRED) or record["lsn"] < 1 or len(record["fingerprint"]) != 32:
        raise Corrupt("fields")
    return version, record, at + struct.calcsize(HEADER) + size


def encode_envelope(magic: bytes, value) -> bytes:
    body = json.dumps(value, separators=(",", ":")).encode()
    return struct.pack(ENVELOPE, magic, len(body), zlib.crc32(body)) + body


def decode_envelope(magic: bytes, data: bytes):
    if len(data) < struct.calcsize(ENVELOPE):
        raise Corrupt("envelope too short")
    found, size, crc = struct.unpack_from(ENVELOPE, data)
    body = data[struct.calcsize(ENVELOPE) :]
    if found != magic or size != len(body) or zlib.crc32(body) != crc:
        raise Corrupt("envelope")
    return json.loads(body)


def _text(value) -> str | None:
    return None if value is None else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def scan_segment(segment: int, data: bytes):
    """Rows of RECORDS; a last row with a problem (TORN or CORRUPT) if the segment doesn't end after a whole record."""
    at, position = 0, 0
    while at < len(data):
        try:
            got = decode_record(data, at)
        except Corrupt:
            yield (segment, position, "CORRUPT", *[None] * 9)
            return
        if got is None:
            yield (segment, position, "TORN", *[None] * 9)
            return
        version, r, at = got
        yield segment, position, None, version, r["lsn"], r["type"], r["committed_at"], r["key"], bytes(r["fingerprint"]).hex(), _text(r["request"]), _text(r["result"]), _text(r.get("state"))
        position += 1


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _decode(batches):
    fields = [f.split() for f in RECORDS.split(", ")]
    for batch in batches:
        for segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = list(scan_segment(segment, data))
            for k in range(0, len(rows), 4096):
                cols = zip(*rows[k : k + 4096])
                yield pa.record_batch([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def encode_segments(records: DataFrame, written_out: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """writer, segment, content: the records (writer, segment, lsn, kind, committed_at, key, fingerprint, request, result) of each segment, framed in order.

    Rows are sorted within their task, so a segment of bytes is all that is held.
    written_out makes those columns of records(writer, segment, lsn, ...) where
    they have been placed, so that what can be derived doesn't cross the network.
    """
    names = ["writer", "segment", "lsn", "kind", "committed_at", "key", "fingerprint", "request", "result"]
    n = max(2, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def done(at, frames):
        return pa.record_batch([pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int64()), pa.array([b"".join(frames)], pa.binary())], names=["writer", "segment", "content"])

    def run(batches):
        at, frames = None, []
        for batch in batches:
            for writer, segment, lsn, kind, when, key, fp, request, result in zip(*(batch.column(k).to_pylist() for k in range(len(names)))):
                if at != (writer, segment):
                    if frames:
                        yield done(at, frames)
                    at, frames = (writer, segment), []
                frames.append(encode_record({"type": kind, "lsn": lsn, "committed_at": when, "key": key, "fingerprint": list(bytes.fromhex(fp)), "request": json.loads(request), "result": json.loads(result)}))
        if frames:
            yield done(at, frames)

    records = records if written_out else records.select(*names)
    placed = records.repartition(n, "writer", "segment").sortWithinPartitions("writer", "segment", "lsn")
    return (written_out(placed) if written_out else placed).select(*names).mapInArrow(run, "writer string, segment bigint, content binary")


def decode_segments(segments: DataFrame) -> DataFrame:
    """writer and the columns of RECORDS."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                writer = batch.column(0)[k]
                for out in _decode([batch.slice(k, 1).select([1, 2])]):
                    yield pa.record_batch([pa.array([writer.as_py()] * out.num_rows, pa.string()), *out.columns], names=["writer", *out.schema.names])

    return segments.select("writer", F.col("segment").cast("bigint"), "content").mapInArrow(run, f"writer string, {RECORDS}")


def read_log(spark: SparkSession, path: str, after_lsn: int = 0) -> DataFrame:
    """Records after after_lsn.

    The last segment may end within a record, which is left out.  A torn record
    elsewhere, a wrong one anywhere, a file with another name or a number that
    doesn't rise makes the read fail with CORRUPT.
    """
    from ledgerweave.operators.recovery import log_breaks

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path)
    number = number_of(F.element_at(F.split("path", "/"), -1))
    rows = files.select(F.coalesce(number, F.raise_error(F.lit("CORRUPT")).cast("bigint")).alias("segment"), "content").mapInArrow(_decode, RECORDS)
    newest = files.agg(F.max(number).alias("newest"))
    # one condition, as a filter on lsn alone would drop the rows that report a problem
    bad = (F.col("problem") == "CORRUPT") | ((F.col("problem") == "TORN") & (F.col("segment") < F.col("newest")))
    checked = rows.crossJoin(F.broadcast(newest)).where(F.when(bad, F.raise_error(F.lit("CORRUPT")).cast("boolean")).otherwise(F.col("problem").isNull() & (F.col("lsn") > after_lsn))).drop("newest", "problem")  # one row
    broken = log_breaks(checked).agg(F.count("*").alias("_breaks"))
    kept = checked.crossJoin(F.broadcast(broken))  # one row
    return kept.where(F.when(F.col("_breaks") > 0, F.raise_error(F.lit("CORRUPT")).cast("boolean")).otherwise(F.lit(True))).drop("_breaks")


def write_segments(directory: str, records: list[dict], limit: int, first_segment: int = 1, version: int = 2) -> list[str]:
    """Write records to segments of at most `limit` bytes (or one record) in a folder that this process sees; for small logs and fixtures."""
    import os

    names, segment, held = [], first_segment, b""
    for r in [*records, None]:
        frame = b"" if r is None else encode_record(r, version)
        if held and (r is None or len(held) + len(frame) > limit):
            name = os.path.join(directory, f"{segment:020d}.wal")
            with open(f"{name}.tmp", "wb") as f:
                f.write(held)
                f.flush()
                os.fsync(f.fileno())
            os.rename(f"{name}.tmp", name)
            names.append(name)
            segment, held = segment + 1, b""
        held += frame
    return names
