import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import encoding, validation
from ledgerweave.operators import admission, audit, idempotency, stats
from ledgerweave.plans.schema import MAX_INT64, Options


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_validators(spark):
    cases = [(validation.valid_key, "k" * 256, True), (validation.valid_key, "k" * 257, False), (validation.valid_key, "é" * 129, False), (validation.valid_key, "", False), (validation.valid_key, None, False), (validation.valid_account_id, "a" * 128, True), (validation.valid_account_id, "a" * 129, False), (validation.valid_currency, "USD", True), (validation.valid_currency, "USD\n", False), (validation.valid_currency, "usd", False), (validation.valid_currency, None, False)]
    for f, v, want in cases:
        assert one(spark, f(F.col("v")), v=v) is want, (f, v)
    bad = spark.sql("select cast(X'ff41' as string) as v").select(validation.valid_key(F.col("v"))).first()[0]
    assert bad is False


def test_encoding(spark):
    for text, want in (("", 0x811C9DC5), ("a", 0xE40C292C), ("foobar", 0xBF9CF968), ("é", None)):
        got = one(spark, encoding.fnv1a(F.col("v")), v=text)
        h = 0x811C9DC5
        for b in text.encode():
            h = (h ^ b) * 16777619 % 2**32
        assert got == h and (want is None or got == want)
    json = one(spark, encoding.request_json(lambda c: F.lit("cancel") if c == "kind" else F.col("v")), v="h<1>&é")
    escape = lambda p: "\\" + f"u{p:04x}"
    assert json == '{"HoldID":"h' + escape(0x3C) + "1" + escape(0x3E) + escape(0x26) + 'é"}'
    assert one(spark, encoding.fingerprint(F.lit("cancel"), F.col("v")), v=json) == hashlib.sha256(b"cancel\0" + json.encode()).hexdigest()
    assert one(spark, encoding.expired(F.col("a"), F.col("b"), 60), a=0, b=59) is False
    assert one(spark, encoding.expired(F.col("a"), F.col("b"), 60), a=0, b=60) is True
    assert one(spark, validation.overflows(F.col("a"), F.col("b")), a=MAX_INT64 - 1, b=2) is True
    assert one(spark, encoding.number_of(encoding.checkpoint_name(F.col("a"))), a=12) == 12
    assert one(spark, encoding.number_of(F.col("a")), a="12.wal") is None
    assert one(spark, F.crc32(F.encode("a", "UTF-8")), a="123456789") == 0xCBF43926
    assert one(spark, encoding.supported_version(F.col("a")), a=3) is False


def test_percentiles_agree(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 4, 4, 9)] + [("b", 7), ("b", None)], "g string, v long")
    got = {r.g: (r.n, r.p50, r.p95) for r in stats.percentiles(df, "v", "g").collect()}
    assert got == {"a": (5, 4, 5), "b": (1, 7, 7)}
    assert {r.g: r.value for r in stats.small_group_percentile(df, "v", 0.95, "g").collect()} == {"a": 5, "b": 7}


def test_lease_boundary_and_options(spark):
    df = spark.createDataFrame([(1, "k", "f", 0), (2, "k", "g", 59), (3, "k", "g", 60), (4, "k", "f", 61), (5, "k", "g", 119)], "seq long, key string, fingerprint string, ts_nanos long")
    out = [r.outcome for r in idempotency.with_leases(df, 60).orderBy("seq").collect()]
    assert out == ["winner", "conflict", "winner", "conflict", "replay"]
    assert Options().lease == 30 * 86_400_000_000_000
    with pytest.raises(ValueError):
        Options(retention_nanos=-1)


def test_audit_fails_closed(spark):
    accounts = spark.createDataFrame([("a", "USD", 10, 4, 1), ("b", "USD", 1, 2, 1), ("c", "usd", 1, 0, 1), ("d", "USD", 5, 0, 99)], "id string, currency string, balance long, reserved long, lsn long")
    holds = spark.createDataFrame([("h1", "a", "b", 3, "reserved", 0, 1), ("h2", "a", "zz", 3, "cancelled", 0, 1), ("h3", "a", "b", 3, "settled", 4, 1), ("h4", "a", "b", 3, "odd", 0, 1)], "hold_id string, from_account string, to_account string, amount long, status string, settled_amount long, lsn long")
    bad = audit.account_violations(accounts, holds, 50)
    assert {r.id: r.violation for r in bad.collect()} == {"a": "reserved differs from open holds", "b": "reserved out of range", "c": "currency", "d": "account lsn"}
    assert {r.hold_id for r in audit.hold_violations(holds, accounts.where("id != 'c'"), 50).collect()} == {"h2", "h3", "h4"}
    with pytest.raises(Exception, match="CORRUPT"):
        audit.fail_closed(accounts, bad).collect()
    assert audit.fail_closed(accounts, bad.limit(0)).count() == 4


def test_settle_cancel_race(spark):
    holds = spark.createDataFrame([("h", 40, 1)], "hold_id string, amount long, seq long")
    t = spark.createDataFrame([(2, "h", "settle", 50), (3, "h", "settle", 40), (4, "h", "cancel", 0), (5, "h", "settle", 40), (0, "h", "cancel", 0), (9, "x", "cancel", 0)], "seq long, hold_id string, kind string, amount long")
    got = {r.seq: (r.error_code, r.replayed) for r in admission.lifecycle(holds, t).collect()}
    assert got == {2: ("INVALID_AMOUNT", False), 3: (None, False), 4: ("HOLD_CONFLICT", False), 5: (None, True), 0: ("HOLD_NOT_FOUND", False), 9: ("HOLD_NOT_FOUND", False)}
