import gc
import json
import os
import socket
import subprocess
import sys
import time

import pytest

from ledgerweave.engine import Ledger, LedgerError
from ledgerweave.plans.schema import OPS, Options


class Clock:
    now = 10**18

    def __call__(self):
        return self.now


def refused(code, f, *args):
    with pytest.raises(LedgerError) as e:
        f(*args)
    assert e.value.code == code


def test_payment_lifecycle_over_reopening(spark, tmp_path):
    clock, path = Clock(), str(tmp_path / "db")
    db = Ledger(spark, path, clock=clock)
    refused("ALREADY_OPEN", lambda: Ledger(spark, path))
    db.create_account("k1", "driver", "INR", 100000)
    db.create_account("k2", "operator", "INR")
    db.reserve("k3", "session", "driver", "operator", 50000)
    a = db.get_account("driver")
    assert (a.balance, a.reserved, a.available) == (100000, 50000, 50000)
    refused("INSUFFICIENT_FUNDS", db.transfer, "k4", "driver", "operator", 50001)
    done = db.settle("k5", "session", 18000)
    assert (done.status, done.settled_amount, done.from_balance, done.from_reserved, done.to_balance) == ("settled", 18000, 82000, 0, 18000)
    base = db.checkpoint()
    assert base == 4
    late = db.settle("k6", "session", 18000)  # under a new key: logged again, same result
    assert late.replayed and late.wal_lsn == 5 and late.commit_lsn == 4 and late.from_balance == 82000
    assert db.settle("k5", "session", 18000).wal_lsn is None
    refused("HOLD_CONFLICT", db.cancel, "k7", "session")
    refused("IDEMPOTENCY_CONFLICT", db.transfer, "k5", "driver", "operator", 1)
    db.close()
    refused("CLOSED", db.get_account, "driver")

    with Ledger(spark, path, clock=clock) as db:
        assert db.get_account("driver").balance == 82000
        assert db.get_hold("session").status == "settled"
        again = db.settle("k5", "session", 18000)
        assert again.replayed and again.commit_lsn == 4 and again.to_balance == 18000
        refused("ACCOUNT_NOT_FOUND", db.get_account, "nobody")
        refused("HOLD_NOT_FOUND", db.get_hold, "nothing")
        s = db.stats()
        assert (s.last_lsn, s.active_holds, s.terminal_holds, s.checkpoint_lsn) == (5, 0, 1, 4)
        clock.now += 31 * 86_400_000_000_000  # every lease has run out: keys work anew, holds stay closed
        assert db.stats().idempotency_keys == 0
        assert db.transfer("k5", "driver", "operator", 1).wal_lsn == 6
        assert db.settle("k8", "session", 18000).commit_lsn == 4


def test_tables_of_operations_and_automatic_checkpoints(spark, tmp_path):
    clock = Clock()
    base = dict.fromkeys(OPS.names) | {"cancelled": False}
    with Ledger(spark, str(tmp_path / "db"), Options(checkpoint_every=5), clock=clock) as db:
        ops = [base | {"seq": k + 1, "kind": "create_account", "key": f"c{k}", "account_id": f"a{k}", "currency": "USD", "opening_balance": 100} for k in range(4)]
        ops += [base | {"seq": 10 + k, "kind": "transfer", "key": f"t{k}", "from_account": f"a{k % 4}", "to_account": f"a{(k + 1) % 4}", "amount": 30} for k in range(20)]
        db.submit(spark.createDataFrame(ops, OPS))
        assert db.stats().checkpoint_lsn == db.stats().last_lsn == 24
        assert sum(r.balance for r in db.accounts().collect()) == 400
        out = db.submit(spark.createDataFrame(ops[4:8], OPS)).collect()
        assert all(r.replayed for r in out)
    with Ledger(spark, str(tmp_path / "db"), clock=clock) as db:
        assert db.stats().last_lsn == 24


def test_damaged_manifest_is_refused(spark, tmp_path):
    path = tmp_path / "db"
    with Ledger(spark, str(path)) as db:
        db.create_account("k", "a", "USD", 1)
        db.checkpoint()
    data = bytearray((path / "MANIFEST-1").read_bytes())
    data[-2] ^= 1
    for f in path.glob(".MANIFEST*"):
        f.unlink()
    (path / "MANIFEST-1").write_bytes(bytes(data))
    refused("CORRUPT", lambda: Ledger(spark, str(path)))
    (path / "MANIFEST-1").unlink()
    with Ledger(spark, str(path)) as db:  # the newest whole snapshot counts
        assert db.get_account("a").balance == 1


def test_reopens_after_a_crash(spark, tmp_path):
    """A ledger that is dropped without close, or whose process has ended, leaves a lock that falls."""
    path = str(tmp_path / "db")
    db = Ledger(spark, path)
    db.create_account("k", "a", "USD", 5)
    refused("ALREADY_OPEN", lambda: Ledger(spark, path))
    del db
    gc.collect()
    with Ledger(spark, path) as again:
        assert again.get_account("a").balance == 5
    ended = subprocess.Popen([sys.executable, "-c", ""])
    ended.wait()
    lock = tmp_path / "db" / "LOCK"
    lock.write_text(json.dumps({"host": socket.gethostname(), "pid": ended.pid, "id": "x"}))
    Ledger(spark, path).close()
    lock.write_text(json.dumps({"host": "elsewhere", "pid": 1, "id": "x"}))
    refused("ALREADY_OPEN", lambda: Ledger(spark, path))
    os.utime(lock, (time.time() - 3600,) * 2)  # not renewed for an hour
    db = Ledger(spark, path)
    lock.write_text(json.dumps({"host": "elsewhere", "pid": 1, "id": "y"}))  # taken by another
    refused("POISONED", lambda: db.create_account("k2", "b", "USD"))
    db.close()
    assert lock.exists()


def test_failed_checkpoint_is_tried_again(spark, tmp_path, monkeypatch):
    with Ledger(spark, str(tmp_path / "db"), Options(checkpoint_every=1)) as db:
        whole = db._dir.publish
        monkeypatch.setattr(db._dir, "publish", lambda *a: (_ for _ in ()).throw(OSError("no room")))
        db.create_account("k", "a", "USD", 5)
        s = db.stats()
        assert (s.checkpoint_lsn, s.checkpoint_attempts, s.checkpoint_successes, s.mutations, s.syncs) == (0, 1, 0, 1, 1) and "no room" in s.checkpoint_error
        monkeypatch.setattr(db._dir, "publish", whole)
        db.create_account("k2", "b", "USD", 5)
        s = db.stats()
        assert s.checkpoint_lsn == 2 and s.checkpoint_error is None and s.last_checkpoint and s.sync_seconds > 0 and s.queue_depth == 0
