"""Replays against a plain walk over the operations, written here from the rules."""

import random

from ledgerweave.operators import recovery, replay
from ledgerweave.plans.schema import MAX_INT64, OPS

LEASE = 100


def walk(ops):
    acc, holds, keys, out, lsn = {}, {}, {}, {}, 0
    for o in sorted(ops, key=lambda o: o["seq"]):
        def no(code):
            out[o["seq"]] = (code, False, None, None)

        k = o["kind"]
        pair = lambda: "INVALID_ACCOUNT_ID" if not o["from_account"] or not o["to_account"] else "SAME_ACCOUNT" if o["from_account"] == o["to_account"] else "INVALID_AMOUNT" if o["amount"] <= 0 else None
        bad = "CANCELLED" if o["cancelled"] else "INVALID_IDEMPOTENCY_KEY" if not o["key"] else None
        if not bad and k == "create_account":
            bad = "INVALID_OPENING_BALANCE" if o["opening_balance"] < 0 else None
        elif not bad and k == "transfer":
            bad = pair()
        elif not bad and k == "reserve":
            bad = pair() if o["hold_id"] else "INVALID_HOLD_ID"
        elif not bad:
            bad = "INVALID_HOLD_ID" if not o["hold_id"] else "INVALID_AMOUNT" if k == "settle" and o["amount"] < 0 else None
        if bad:
            no(bad)
            continue
        fp = (k, *(o[c] for c in {"create_account": ("account_id", "currency", "opening_balance"), "transfer": ("from_account", "to_account", "amount"), "reserve": ("hold_id", "from_account", "to_account", "amount"), "settle": ("hold_id", "amount"), "cancel": ("hold_id",)}[k]))
        old = keys.get(o["key"])
        if old and o["ts_nanos"] - old[2] < LEASE:
            if old[0] != fp:
                no("IDEMPOTENCY_CONFLICT")
            else:
                out[o["seq"]] = (None, True, None, old[1])
            continue
        new = lsn + 1
        commit, again = new, False
        if k == "create_account":
            if o["account_id"] in acc:
                no("ACCOUNT_EXISTS")
                continue
            acc[o["account_id"]] = [o["currency"], o["opening_balance"], 0]
        else:
            h = None
            if k in ("settle", "cancel"):
                h = holds.get(o["hold_id"])
                if not h:
                    no("HOLD_NOT_FOUND")
                    continue
                amount = o["amount"] if k == "settle" else 0
                want = "settled" if k == "settle" else "cancelled"
                if h["status"] != "reserved":
                    if h["status"] == want and h["moved"] == amount:
                        commit, again = h["lsn"], True
                    else:
                        no("HOLD_CONFLICT")
                        continue
                elif amount > h["amount"]:
                    no("INVALID_AMOUNT")
                    continue
                source, target = h["from"], h["to"]
            else:
                source, target, amount = o["from_account"], o["to_account"], o["amount"]
                if k == "reserve" and o["hold_id"] in holds:
                    no("HOLD_EXISTS")
                    continue
            if not again:
                a, b = acc.get(source), acc.get(target)
                code = "ACCOUNT_NOT_FOUND" if not a or not b else "CURRENCY_MISMATCH" if a[0] != b[0] else None
                if not code and k in ("transfer", "reserve") and a[1] - a[2] < amount:
                    code = "INSUFFICIENT_FUNDS"
                if not code and k in ("transfer", "settle") and b[1] > MAX_INT64 - amount:
                    code = "BALANCE_OVERFLOW"
                if code:
                    no(code)
                    continue
                if k == "transfer":
                    a[1] -= amount
                    b[1] += amount
                elif k == "reserve":
                    a[2] += amount
                    holds[o["hold_id"]] = {"from": source, "to": target, "amount": amount, "status": "reserved", "moved": 0, "lsn": new}
                else:
                    a[2] -= h["amount"]
                    a[1] -= amount
                    b[1] += amount
                    h.update(status=want, moved=amount, lsn=new)
        lsn = new
        keys[o["key"]] = (fp, commit, o["ts_nanos"])
        out[o["seq"]] = (None, again, new, commit)
    return out, acc, holds


def sample(seed, n=600):
    r = random.Random(seed)
    ops, names = [], [f"a{k}" for k in range(12)] + ["b é"]
    for seq in range(1, n):
        kind = r.choice(["create_account", "transfer", "transfer", "transfer", "reserve", "reserve", "settle", "cancel"]) if seq > 15 else "create_account"
        o = dict.fromkeys(OPS.names) | {"seq": seq, "kind": kind, "key": "" if r.random() < 0.02 else f"k{r.randrange(n) if r.random() < 0.8 else r.randrange(12)}", "ts_nanos": seq // 2, "cancelled": r.random() < 0.02}
        if kind == "create_account":
            i = r.randrange(len(names))
            o |= {"account_id": names[i], "currency": ["USD", "EUR", "INR"][i % 3], "opening_balance": r.choice([-1, 0, 50, 1000, MAX_INT64 - 20])}
        elif kind in ("transfer", "reserve"):
            i = r.randrange(len(names))
            same = [x for k, x in enumerate(names) if k % 3 == i % 3]
            o |= {"from_account": names[i], "to_account": r.choice(same if r.random() < 0.9 else names + ["zz"]), "amount": r.choice([-1, 0, 1, 10, 30, 400])}
        if kind in ("reserve", "settle", "cancel"):
            o |= {"hold_id": r.choice(["", *(f"h{k}" for k in range(40))])}
        if kind == "settle":
            o |= {"amount": r.choice([-1, 0, 1, 10, 30])}
        ops.append(o)
    return ops


def compare(out, want):
    got = {r.seq: (r.error_code, r.replayed, r.wal_lsn, r.commit_lsn if r.error_code is None else None) for r in out}
    assert got == want


def test_random_logs(spark):
    for seed in range(4):
        ops = sample(seed)
        want, acc, holds = walk(ops)
        assert len({w[0] for w in want.values()}) >= 10
        df = spark.createDataFrame(ops, OPS).repartition(3)
        out = replay.with_lsn(replay.replay(df, LEASE)).cache()
        compare(out.collect(), want)
        images, hold_images = replay.log_images(out)
        got = {r.id: [r.currency, r.balance, r.reserved] for r in recovery.recover_accounts(images).collect()}
        assert got == acc
        held = {r.hold_id: (r.status, r.settled_amount, r.amount, r.lsn) for r in recovery.recover_holds(hold_images).collect()}
        assert held == {k: (h["status"], h["moved"], h["amount"], h["lsn"]) for k, h in holds.items()}


def test_groups_are_split_by_currency(spark):
    ops = [o for o in sample(1) if o["kind"] in ("create_account", "transfer")]
    for o in ops:
        o["key"] = f"own{o['seq']}"
    parts = replay.groups_of(spark.createDataFrame(ops, OPS).withColumnRenamed("x", "x")).select("part").distinct().count()
    assert parts >= 3
    want, *_ = walk(ops)
    compare(replay.with_lsn(replay.replay(spark.createDataFrame(ops, OPS), LEASE)).collect(), want)


def test_overspend_race(spark):
    base = dict.fromkeys(OPS.names) | {"ts_nanos": 0, "cancelled": False}
    ops = [base | {"seq": 1, "kind": "create_account", "key": "a", "account_id": "a", "currency": "USD", "opening_balance": 1000}, base | {"seq": 2, "kind": "create_account", "key": "b", "account_id": "b", "currency": "USD", "opening_balance": 0}]
    ops += [base | {"seq": 3 + k, "kind": "reserve", "key": f"r{k}", "hold_id": f"h{k}", "from_account": "a", "to_account": "b", "amount": 100} for k in range(32)]
    out = replay.replay(spark.createDataFrame(ops, OPS), LEASE).where("kind = 'reserve' and error_code is null").count()
    assert out == 10


def test_coupled_query_equals_walk(spark):
    from ledgerweave.plans import catalogue
    from ledgerweave.sources import views

    sf = "/root/testdata/sf0.001"
    bal = {r.id: r.balance for r in catalogue.p2p_accounts(spark, sf).collect()}
    want = {}
    for r in sorted(views.p2p(spark, sf).collect(), key=lambda r: r.seq):
        if bal[r.from_account] < r.amount:
            want[r.seq] = ("INSUFFICIENT_FUNDS", None, None)
        else:
            bal[r.from_account] -= r.amount
            bal[r.to_account] += r.amount
            want[r.seq] = (None, bal[r.from_account], bal[r.to_account])
    for name in ("coupled_replay", "stream_replay"):
        got = {r.seq: (r.error_code, r.from_balance, r.to_balance) for r in catalogue.QUERIES[name](spark, sf).collect()}
        assert got == want, name


def test_duplicates_add_no_state(spark):
    ops = [o for o in sample(3) if o["key"]]
    n = max(o["seq"] for o in ops)
    for o in ops:
        o["ts_nanos"] = 0
    again = ops + [o | {"seq": o["seq"] + n} for o in ops]
    keys = set()
    once = [o for o in again if o["seq"] <= n]
    _, a, _ = walk(once)
    out, b, _ = walk(again)
    compare(replay.with_lsn(replay.replay(spark.createDataFrame(again, OPS), LEASE)).collect(), out)
    assert sum(x[1] for x in a.values()) <= sum(x[1] for x in b.values())
    del keys
