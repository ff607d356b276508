"""Tables of the engine, error codes and options."""

from __future__ import annotations

from dataclasses import dataclass

KINDS = ("create_account", "transfer", "reserve", "settle", "cancel")
HOLD_STATUS = ("reserved", "settled", "cancelled")

#: Every way in which an operation or a folder can be refused.
ERROR_CODES = (
    "INVALID_HOLD_ID", "HOLD_EXISTS", "HOLD_NOT_FOUND", "HOLD_CONFLICT", "CLOSED", "ALREADY_OPEN", "LOCK_UNSUPPORTED", "POISONED",
    "ACCOUNT_EXISTS", "ACCOUNT_NOT_FOUND", "INVALID_ACCOUNT_ID", "INVALID_CURRENCY", "INVALID_AMOUNT", "INVALID_OPENING_BALANCE",
    "CURRENCY_MISMATCH", "INSUFFICIENT_FUNDS", "BALANCE_OVERFLOW", "SAME_ACCOUNT", "INVALID_IDEMPOTENCY_KEY", "IDEMPOTENCY_CONFLICT",
    "CORRUPT", "LSN_EXHAUSTED",
)
#: The caller gave up before the operation was looked at; not an error of the ledger.
CANCELLED = "CANCELLED"

MAX_INT64 = 2**63 - 1
DAY_NANOS = 86_400_000_000_000


class Table(str):
    """A schema as DDL text; fields are parted by a comma and a blank."""

    @property
    def names(self) -> list[str]:
        return [f.split()[0] for f in self.split(", ")]


OPS = Table(
    "seq bigint, kind string, key string, ts_nanos bigint, account_id string, currency string, opening_balance bigint, hold_id string, from_account string, to_account string, amount bigint, cancelled boolean"
)
ACCOUNTS = Table("id string, currency string, balance bigint, reserved bigint, lsn bigint")
TERMINAL = "hold_id string, status string, settled_amount bigint, from_balance bigint, from_reserved bigint, to_balance bigint, lsn bigint"
HOLDS = Table(f"hold_id string, from_account string, to_account string, amount bigint, status string, settled_amount bigint, lsn bigint, terminal_result struct<{TERMINAL.replace(', ', ',').replace(' ', ':')}>")
KEYS = Table("key string, fingerprint string, kind string, result string, lsn bigint, committed_at bigint")
OUTCOMES = Table(
    "seq bigint, key string, kind string, error_code string, replayed boolean, wal_lsn bigint, commit_lsn bigint, status string, settled_amount bigint, from_balance bigint, from_reserved bigint, to_balance bigint"
)
STATE = "struct<accounts:array<struct<id:string,currency:string,balance:bigint,reserved:bigint,lsn:bigint>>,holds:array<struct<hold_id:string,from_account:string,to_account:string,amount:bigint,status:string,settled_amount:bigint,lsn:bigint>>>"
WAL = Table(f"lsn bigint, kind string, committed_at bigint, key string, fingerprint string, request string, result string, state {STATE}")


@dataclass(frozen=True)
class Options:
    """Limits and cadences; a retention of 0 is the default of 30 days."""

    retention_nanos: int = 0
    max_batch: int = 64
    segment_bytes: int = 64 << 20
    checkpoint_every: int = 0
    checkpoint_seconds: float = 0

    def __post_init__(self):
        if self.retention_nanos < 0:
            raise ValueError("retention must not be negative")
        if self.max_batch < 1 or self.segment_bytes < 1 or self.checkpoint_every < 0 or self.checkpoint_seconds < 0:
            raise ValueError("batch and segment sizes must be positive")

    @property
    def lease(self) -> int:
        return self.retention_nanos or 30 * DAY_NANOS
