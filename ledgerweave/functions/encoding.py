"""Fingerprints, shard numbers, names of files, leases and ranks, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Order of the fields in a request's JSON, by kind: (JSON name, column).
REQUEST_FIELDS = {
    "create_account": (("ID", "account_id"), ("Currency", "currency"), ("OpeningBalance", "opening_balance")),
    "transfer": (("FromAccount", "from_account"), ("ToAccount", "to_account"), ("Amount", "amount")),
    "reserve": (("HoldID", "hold_id"), ("FromAccount", "from_account"), ("ToAccount", "to_account"), ("Amount", "amount")),
    "settle": (("HoldID", "hold_id"), ("Amount", "amount")),
    "cancel": (("HoldID", "hold_id"),),
}
#: FNV-1a, 32 bits.
FNV_BASIS, FNV_PRIME, SHARDS = 2166136261, 16777619, 64


#: Code points that are written as escapes in JSON text.
ESCAPED = (0x3C, 0x3E, 0x26, 0x2028, 0x2029)


def escaped_json(c: Column) -> Column:
    """JSON text with the characters that HTML minds, and line separators, written as escapes."""
    for point in ESCAPED:
        c = F.replace(c, F.lit(chr(point)), F.lit("\\" + f"u{point:04x}"))
    return c


def request_json(c=F.col) -> Column:
    """The request of a row of `ops` as compact JSON; null for an unknown kind."""
    out = None
    for kind, fields in REQUEST_FIELDS.items():
        text = escaped_json(F.to_json(F.struct(*(c(column).alias(name) for name, column in fields)), {"ignoreNullFields": "false"}))
        out = F.when(c("kind") == kind, text) if out is None else out.when(c("kind") == kind, text)
    return out


def fingerprint(kind: Column, request: Column) -> Column:
    """SHA-256 of kind, a zero byte and the request's JSON."""
    return F.sha2(F.concat(kind, F.lit("\0"), request), 256)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the text's bytes."""
    digits = F.hex(F.encode(c, "UTF-8"))
    at = F.when(F.octet_length(c) > 0, F.sequence(F.lit(0), F.octet_length(c) - 1)).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(at, F.lit(FNV_BASIS).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def shard_index(c: Column, shards: int = SHARDS) -> Column:
    return (fnv1a(c) % shards).cast("int")


def expired(committed_at: Column, now: Column, lease: int | Column) -> Column:
    """A lease ends on the nanosecond it runs out."""
    return now - committed_at >= (F.lit(lease) if isinstance(lease, int) else lease)


def numbered_name(prefix: str, number: Column, suffix: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 20, "0"), F.lit(suffix))


def segment_name(number: Column) -> Column:
    return numbered_name("", number, ".wal")


def checkpoint_name(lsn: Column) -> Column:
    return numbered_name("checkpoint-", lsn, ".ckpt")


def number_of(name: Column) -> Column:
    """The number in a canonical name, null for any other."""
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"\A(?:checkpoint-)?([0-9]{20})\.(?:wal|ckpt)\z", 1), F.lit("")), F.lit("9" * 20)).cast("decimal(20,0)").cast("long")


def supported_version(version: Column) -> Column:
    return version.isin(1, 2)


def nearest_rank(values: Column, q: float) -> Column:
    """values[floor((n - 1) * q)] of the sorted values; null if there are none."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.floor((F.size(ordered) - 1) * F.lit(q)).cast("int"))
