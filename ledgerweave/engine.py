"""A ledger in a folder: operations in, outcomes out, state recovered from a snapshot and the log's tail.

The folder holds `log/` (Parquet, an append per submitted table), `state-<lsn>/`
(accounts, holds and keys as of a log number), `MANIFEST-<lsn>` (which snapshot
counts: the highest; each is renamed into place whole) and `LOCK`.

One ledger at a time has the folder open.  `LOCK` names its owner, which renews
it while it lives.  It falls with the owner: at once where that was in a process
of this host that has ended, or in this process and is gone, and else after
`LOCK_SECONDS` without renewal.  An owner whose lock was taken writes no more.
"""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
import weakref
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ledgerweave.functions.encoding import expired, fingerprint, request_json
from ledgerweave.functions.validation import available
from ledgerweave.operators import audit, recovery, replay
from ledgerweave.plans.schema import OPS, Options
from ledgerweave.sources.log_files import MANIFEST_MAGIC, decode_envelope, encode_envelope

_ACCOUNT = "id string, currency string, balance bigint, reserved bigint, lsn bigint"
_HOLD = "hold_id string, from_account string, to_account string, amount bigint, status string, settled_amount bigint, lsn bigint, result array<string>, commit bigint"
_KEY = "key string, fingerprint string, kind string, result array<string>, lsn bigint, committed_at bigint"
_LOG = "seq bigint, lsn bigint, kind string, key string, fingerprint string, committed_at bigint, replayed boolean, commit_lsn bigint, " + ", ".join(c for c in replay.FOLD.split(", ") if c.split()[0] in ("status", "settled_amount", "amount", "from_account", "to_account", "hold_id", "from_balance", "from_reserved", "to_balance", "to_reserved", "currency"))
_RESULT = ("status", "settled_amount", "amount", "from_account", "to_account", "hold_id", "from_balance", "from_reserved", "to_balance", "to_reserved", "currency")


#: Seconds after which a lock that isn't renewed has fallen.
LOCK_SECONDS = 60.0
_OPEN: weakref.WeakValueDictionary = weakref.WeakValueDictionary()


class LedgerError(Exception):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


class LedgerAPI(Protocol):
    def create_account(self, key: str, account_id: str, currency: str, opening_balance: int = 0) -> Row: ...
    def transfer(self, key: str, from_account: str, to_account: str, amount: int) -> Row: ...
    def reserve(self, key: str, hold_id: str, from_account: str, to_account: str, amount: int) -> Row: ...
    def settle(self, key: str, hold_id: str, amount: int) -> Row: ...
    def cancel(self, key: str, hold_id: str) -> Row: ...
    def get_account(self, account_id: str) -> Row: ...
    def get_hold(self, hold_id: str) -> Row: ...
    def stats(self) -> Row: ...
    def checkpoint(self) -> int: ...
    def close(self) -> None: ...


class _Folder:
    """Hadoop file system calls on one folder."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path, self._Path = path.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = jvm

    def at(self, name: str):
        return self._Path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._Path(self.path))] if self.fs.exists(self._Path(self.path)) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def publish(self, name: str, data: bytes) -> None:
        """A new file, written under another name and renamed when it is whole."""
        new = f"{name}.{uuid.uuid4().hex}.tmp"
        self.write(new, data)
        if not self.fs.rename(self.at(new), self.at(name)):
            raise OSError(f"cannot publish {name}")

    def write(self, name: str, data: bytes, replace: bool = True) -> None:
        stream = self.fs.create(self.at(name), replace)
        stream.write(data)
        stream.hsync()
        stream.close()

    def age(self, name: str) -> float:
        """Seconds since the file was written."""
        return time.time() - self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class _Lock:
    """The file LOCK of a folder, renewed by a thread until it is released or its owner is gone."""

    def __init__(self, folder: _Folder):
        self.folder, self.owner = folder, {"host": socket.gethostname(), "pid": os.getpid(), "id": uuid.uuid4().hex}
        self._stop = threading.Event()
        data = json.dumps(self.owner).encode()
        for _ in range(3):
            try:
                folder.write("LOCK", data, replace=False)
                break
            except Exception as e:  # the file is there, or was a moment ago
                if not folder.exists("LOCK"):
                    if "AlreadyExists" not in str(e):
                        raise
                    continue
                if not self._fallen():
                    raise LedgerError("ALREADY_OPEN") from e
                gone = f"LOCK.{self.owner['id']}.tmp"  # of several that find it fallen, one renames it
                folder.fs.rename(folder.at("LOCK"), folder.at(gone))
                folder.remove(gone)
        if not self.held():
            raise LedgerError("ALREADY_OPEN")
        _OPEN[self.owner["id"]] = self
        threading.Thread(target=_renew, args=(weakref.ref(self), self._stop), daemon=True).start()

    def _read(self) -> dict | None:
        try:
            return json.loads(self.folder.read("LOCK"))
        except Exception:
            return None

    def _fallen(self) -> bool:
        owner = self._read()
        if owner is None:  # being written, or torn
            return self.folder.exists("LOCK") and self.folder.age("LOCK") > LOCK_SECONDS
        if owner["host"] == self.owner["host"]:
            if owner["pid"] == self.owner["pid"]:
                return owner["id"] not in _OPEN
            try:
                os.kill(owner["pid"], 0)
            except ProcessLookupError:
                return True
            except PermissionError:
                pass
        return self.folder.age("LOCK") > LOCK_SECONDS

    def held(self) -> bool:
        owner = self._read()
        return owner is not None and owner["id"] == self.owner["id"]

    def renew(self) -> None:
        if self.held():
            now = int(time.time() * 1000)
            self.folder.fs.setTimes(self.folder.at("LOCK"), now, -1)

    def release(self) -> None:
        self._stop.set()
        _OPEN.pop(self.owner["id"], None)
        if self.held():
            self.folder.remove("LOCK")


def _renew(lock: weakref.ref, stop: threading.Event) -> None:
    while not stop.wait(LOCK_SECONDS / 4):
        mine = lock()
        if mine is None:
            return
        try:
            mine.renew()
        except Exception:  # noqa: S110  the next renewal may succeed; if none does, the lock falls
            pass
        del mine


class Ledger:
    """All operations of the ledger API, one at a time or as tables of `ops`."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, clock=time.time_ns):
        self.spark, self.options, self._clock = spark, options or Options(), clock
        self._dir = _Folder(spark, path)
        self._dir.fs.mkdirs(self._dir._Path(self._dir.path))
        self._lock = _Lock(self._dir)
        self._closed = self._poisoned = False
        self._counts = dict.fromkeys(("mutations", "syncs", "duplicates", "batches", "checkpoint_attempts", "checkpoint_successes"), 0)
        self._since_checkpoint = 0
        self._sync_seconds, self._last_checkpoint, self._checkpoint_error = 0.0, None, None
        began = time.time()
        try:
            for name in self._dir.names():
                if name.endswith(".tmp"):
                    self._dir.remove(name)
            self._base = self._newest_snapshot()
            self._load()
            violations = audit.account_violations(self.accounts(), self.holds(), self._lsn).limit(1).count() + audit.hold_violations(self.holds(), self.accounts(), self._lsn).limit(1).count()
            if violations:
                raise LedgerError("CORRUPT")
        except BaseException:
            self._lock.release()
            raise
        self._opened = time.time()
        self._recovery_seconds = self._opened - began

    # --- state -----------------------------------------------------------

    def _newest_snapshot(self) -> int:
        """The newest manifest's snapshot, else the newest whole one without a manifest, else none (0)."""
        done = sorted(int(n[6:]) for n in self._dir.names() if n.startswith("state-") and self._dir.exists(f"{n}/DONE"))
        manifests = sorted(int(n[9:]) for n in self._dir.names() if n.startswith("MANIFEST-") and n[9:].isdigit())
        if manifests:
            try:
                base = decode_envelope(MANIFEST_MAGIC, self._dir.read(f"MANIFEST-{manifests[-1]}"))["base_lsn"]
            except Exception as e:
                raise LedgerError("CORRUPT") from e
            if base not in done or base != manifests[-1]:
                raise LedgerError("CORRUPT")
            return base
        return done[-1] if done else 0

    def _table(self, name: str, schema: str) -> DataFrame:
        if self._base:
            return self.spark.read.schema(schema).parquet(f"{self._dir.path}/state-{self._base}/{name}")
        return self.spark.createDataFrame([], schema)

    def log(self, after_lsn: int = 0) -> DataFrame:
        """Log records after a number; the filter reaches the scan."""
        if not self._dir.exists("log"):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(f"{self._dir.path}/log").where(F.col("lsn") > after_lsn)

    def _load(self) -> None:
        self._lsn = max(self._base, self.log(self._base).agg(F.max("lsn")).first()[0] or 0)

    def _images(self) -> tuple[DataFrame, DataFrame]:
        return replay.log_images(self.log(self._base).withColumnRenamed("lsn", "wal_lsn"))

    def accounts(self) -> DataFrame:
        self._usable()
        return recovery.recover_accounts(self._images()[0], self._table("accounts", _ACCOUNT)).withColumn("available", available(F.col("balance"), F.col("reserved")))

    def holds(self) -> DataFrame:
        """Holds with, once closed, the result that a repeated closing gets."""
        self._usable()
        result = F.array(*(F.col(c).cast("string") for c in _RESULT))
        log = self.log(self._base).where("hold_id is not null and not replayed")
        rows = log.select("hold_id", "from_account", "to_account", "amount", "status", "settled_amount", "lsn", F.when(F.col("status") != "reserved", result).alias("result"), F.when(F.col("status") != "reserved", F.col("lsn")).alias("commit"))
        return recovery.last_written(self._table("holds", _HOLD).unionByName(rows), "hold_id")

    def keys(self, now: int | None = None) -> DataFrame:
        """Keys whose lease still runs."""
        result = F.array(*(F.col(c).cast("string") for c in _RESULT))
        rows = self.log(self._base).select("key", "fingerprint", "kind", result.alias("result"), F.col("commit_lsn").alias("lsn"), "committed_at")
        both = self._table("keys", _KEY).unionByName(rows).where(~expired(F.col("committed_at"), F.lit(self._clock() if now is None else now), self.options.lease))
        return recovery.last_written(both, "key", "committed_at")

    # --- operations ------------------------------------------------------

    def _usable(self, writing: bool = False) -> None:
        if self._closed:
            raise LedgerError("CLOSED")
        if writing and not self._poisoned and not self._lock.held():
            self._poisoned = True
        if writing and self._poisoned:
            raise LedgerError("POISONED")

    def submit(self, ops: DataFrame) -> DataFrame:
        """Judge a table of operations in the order of seq, append what commits to the log, and return the outcomes.

        Rows without a time get the present one.  If the log can't be written,
        nothing of the table counts and the ledger takes no more operations.
        """
        self._usable(writing=True)
        now = self._clock()
        ops = ops.withColumn("ts_nanos", F.coalesce("ts_nanos", F.lit(now)))
        holds = self.holds().withColumn("commit", -F.col("commit"))
        # results travel as arrays of text; whole numbers become numbers again in the fold
        typed = lambda df: df.withColumn("result", _numbers(F.col("result")))
        told = replay.replay(ops, self.options.lease, self.accounts().drop("available"), typed(holds), typed(self.keys(now)))
        out = replay.with_lsn(told, self._lsn)
        key = ops.select("seq", F.col("ts_nanos").alias("committed_at"), fingerprint(F.col("kind"), request_json()).alias("fingerprint"))
        path = f"{self._dir.path}/outcomes-{uuid.uuid4().hex}.tmp"
        began = time.time()
        try:
            out.join(key, "seq").write.parquet(path)
            out = self.spark.read.parquet(path)
            n = out.agg(F.count("wal_lsn"), F.count_if(F.expr("replayed"))).first()
            if n[0]:
                logged = out.where("wal_lsn is not null").withColumnRenamed("wal_lsn", "lsn")
                logged.select(*(c.split()[0] for c in _LOG.split(", "))).write.mode("append").parquet(f"{self._dir.path}/log")
        except Exception:
            self._poisoned = True
            raise
        self._lsn += n[0]
        self._sync_seconds += time.time() - began
        self._counts["mutations"] += n[0]
        self._counts["syncs"] += bool(n[0])
        self._counts["duplicates"] += n[1]
        self._counts["batches"] += -(-n[0] // self.options.max_batch)
        self._since_checkpoint += n[0]
        due = self.options.checkpoint_every and self._since_checkpoint >= self.options.checkpoint_every
        late = self._since_checkpoint and self.options.checkpoint_seconds and time.time() - (self._last_checkpoint or self._opened) >= self.options.checkpoint_seconds
        if due or late:
            try:
                self.checkpoint()
            except Exception as e:  # the log has everything; the next submission tries again
                self._checkpoint_error = str(e)
        return out

    def _one(self, kind: str, key: str, **fields) -> Row:
        row = dict.fromkeys(OPS.names) | fields | {"seq": 1, "kind": kind, "key": key, "cancelled": False}
        out = self.submit(self.spark.createDataFrame([row], OPS)).first()
        if out.error_code:
            raise LedgerError(out.error_code)
        return out

    def create_account(self, key, account_id, currency, opening_balance=0):
        return self._one("create_account", key, account_id=account_id, currency=currency, opening_balance=opening_balance)

    def transfer(self, key, from_account, to_account, amount):
        return self._one("transfer", key, from_account=from_account, to_account=to_account, amount=amount)

    def reserve(self, key, hold_id, from_account, to_account, amount):
        return self._one("reserve", key, hold_id=hold_id, from_account=from_account, to_account=to_account, amount=amount)

    def settle(self, key, hold_id, amount):
        return self._one("settle", key, hold_id=hold_id, amount=amount)

    def cancel(self, key, hold_id):
        return self._one("cancel", key, hold_id=hold_id)

    # --- reads -----------------------------------------------------------

    def get_account(self, account_id: str) -> Row:
        self._usable()
        if not account_id or len(account_id.encode()) > 128:
            raise LedgerError("INVALID_ACCOUNT_ID")
        row = self.accounts().where(F.col("id") == account_id).first()
        if row is None:
            raise LedgerError("ACCOUNT_NOT_FOUND")
        return row

    def get_hold(self, hold_id: str) -> Row:
        self._usable()
        if not hold_id or len(hold_id.encode()) > 128:
            raise LedgerError("INVALID_HOLD_ID")
        row = self.holds().where(F.col("hold_id") == hold_id).first()
        if row is None:
            raise LedgerError("HOLD_NOT_FOUND")
        return row

    def stats(self) -> Row:
        self._usable()
        h = self.holds().agg(F.count_if(F.expr("status = 'reserved'")).alias("a"), F.count_if(F.expr("status != 'reserved'")).alias("t")).first()
        return Row(last_lsn=self._lsn, idempotency_keys=self.keys().count(), active_holds=h.a, terminal_holds=h.t, poisoned=self._poisoned, recovery_seconds=self._recovery_seconds, checkpoint_lsn=self._base, sync_seconds=self._sync_seconds, queue_depth=0, last_checkpoint=self._last_checkpoint, checkpoint_error=self._checkpoint_error, **self._counts)

    # --- snapshots -------------------------------------------------------

    def checkpoint(self) -> int:
        """Write the state as of now, make it the one that counts, and drop log and snapshots that it covers."""
        self._usable(writing=True)
        self._counts["checkpoint_attempts"] += 1
        base, old = self._lsn, self._base
        if base == old:
            return base
        name = f"state-{base}"
        self._dir.remove(name)
        for part, df in (("accounts", self.accounts().drop("available")), ("holds", self.holds()), ("keys", self.keys())):
            df.write.parquet(f"{self._dir.path}/{name}/{part}")
        self._dir.publish(f"{name}/DONE", b"")
        self._dir.publish(f"MANIFEST-{base}", encode_envelope(MANIFEST_MAGIC, {"version": 2, "checkpoint": name, "base_lsn": base}))
        self._base = base
        self._since_checkpoint = 0
        self._dir.remove("log")  # all of it is covered: this process is the only writer
        if old:
            self._dir.remove(f"MANIFEST-{old}")
            self._dir.remove(f"state-{old}")
        self._counts["checkpoint_successes"] += 1
        self._last_checkpoint, self._checkpoint_error = time.time(), None
        return base

    def close(self) -> None:
        if not self._closed:
            for name in self._dir.names():
                if name.endswith(".tmp"):
                    self._dir.remove(name)
            self._lock.release()
            self._closed = True

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def _numbers(result):
    """The array of a stored result as a struct whose whole numbers are numbers, for JSON."""
    whole = {"settled_amount", "amount", "from_balance", "from_reserved", "to_balance", "to_reserved"}
    return F.when(result.isNotNull(), F.struct(*(result[k].cast("bigint").alias(c) if c in whole else result[k].alias(c) for k, c in enumerate(_RESULT))))
