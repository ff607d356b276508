"""Replay in micro-batches against the plain walk of test_replay, and what a fold remembers."""

import pytest
from test_replay import LEASE, sample, walk

from ledgerweave.operators.replay import Book, groups_of
from ledgerweave.plans.schema import OPS
from ledgerweave.streaming.replay import outcomes, stream_replay


@pytest.mark.parametrize("seed", [0, 5])
def test_micro_batches_equal_walk(spark, tmp_path, seed):
    ops = sample(seed, 400)
    for k in range(4):
        part = ops[k * 100 : (k + 1) * 100]
        spark.createDataFrame(part, OPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(OPS).parquet(f"{tmp_path}/in")
        stream_replay(stream, LEASE, f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    want, acc, _ = walk(ops)
    lsn = {o[2]: seq for seq, o in want.items() if o[2] is not None}
    got = {r.seq: (r.error_code, r.replayed, r.logged, r.commit_seq if r.error_code is None else None) for r in outcomes(spark, f"{tmp_path}/out").collect()}
    assert got == {seq: (e, again, n is not None, None if c is None else lsn[c]) for seq, (e, again, n, c) in want.items()}
    assert {r.id: [r.currency, r.balance, r.reserved] for r in spark.read.parquet(f"{tmp_path}/at/accounts/3").collect()} == acc


def test_keys_are_held_only_until_their_last_use():
    book = Book(LEASE)
    book.load("=account", {"id": "a", "currency": "USD", "balance": 10**6, "reserved": 0})
    book.load("=account", {"id": "b", "currency": "USD", "balance": 0, "reserved": 0})
    send = lambda seq, key, keep: book.apply(seq, "transfer", key, 0, None, None, None, None, "a", "b", 1, "f", keep)
    for seq in range(100):
        send(seq, f"once{seq}", False)
    assert not book.keys
    assert send(100, "twice", True)[2] and set(book.keys) == {"twice"}
    assert send(101, "twice", False)[1] and not book.keys


def test_last_uses_are_marked_and_nameless_rows_are_not_joined(spark):
    base = dict.fromkeys(OPS.names) | {"kind": "transfer", "ts_nanos": 0, "from_account": "a", "to_account": "b", "amount": 1, "cancelled": False}
    ops = spark.createDataFrame([base | {"seq": n, "key": k} for n, k in enumerate("abacba", 1)], OPS)
    got = {r.seq: (r.again, r.keep) for r in groups_of(ops).collect()}
    assert got == {1: (True, True), 2: (True, True), 3: (True, True), 4: (False, False), 5: (True, False), 6: (True, False)}
