"""Queries over a log of all five kinds of operation, with retries, keys that end, rejections and repeated endings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerweave.functions import encoding
from ledgerweave.operators import idempotency, recovery, replay
from ledgerweave.plans.schema import DAY_NANOS
from ledgerweave.sources import views

#: Nanoseconds: a key is good for twenty operations of its group.
LEASE = 20 * 10**9

#: Twenty currencies of three accounts each.  Every fifth operation sends the one three before again, every fifth of the rest the
#: one 25 before, whose key has ended by then.  g, n: currency and place in it; a, f, t, h, k: numbers of accounts, hold and key.
PARTS = """
with b as (select event_id as e, event_id % 20 as g, cast(floor(event_id / 20) as bigint) as n from events),
c as (select e, g, n, case when n % 5 = 4 and n >= 8 then n - 3 when n % 5 = 3 and n >= 30 then n - 25 else n end as m from b),
d as (select e, g, n, m, (m * 7919 + g * 104729 + m * m * 31) % 1000003 as x from c),
i as (select e, g, n, m, x, 1 + cast(floor(x / 11) as bigint) % 3 as f from d)
select e + 1 as seq, g, n, n * 1000000000 as happened,
       case when m < 2 or x % 10 = 0 then 'create_account' when x % 10 < 4 then 'transfer' when x % 10 < 6 then 'reserve' when x % 10 < 8 then 'settle' else 'cancel' end as kind,
       case when m < 2 then m + 1 else 1 + x % 3 end as a, f, 1 + (f + cast(floor(x / 37) as bigint) % 2) % 3 as t,
       case when x % 29 = 0 then 0 when x % 10 in (6, 7) then 50 * (1 + cast(floor(x / 13) as bigint) % 3) else 1 + cast(floor(x / 17) as bigint) % 400 end as amount,
       1 + (12 * cast(floor(m / 50) as bigint) + cast(floor(x / 60) as bigint) % 6) % 200 as h, 1 + cast(floor(x / 7) as bigint) % 200 as k
from i
"""

_NONE = "list_transform(range({}), lambda i: cast(null as {}))"
_SET = "list_transform({0}, lambda v, i: case when {1} then {2} else v end)"
_END = "kind in ('settle', 'cancel')"
#: The walk over every currency's operations, in order, as recursion: lists hold the accounts, holds and keys of one currency.
WALK = f"""o as ({PARTS}),
w as (
  select g, cast(0 as bigint) as n, {_NONE.format(3, 'bigint')} as bal, {_NONE.format(3, 'bigint')} as res,
    {_NONE.format(200, 'varchar')} as hst, {_NONE.format(200, 'bigint')} as ham, {_NONE.format(200, 'bigint')} as hfr, {_NONE.format(200, 'bigint')} as hto, {_NONE.format(200, 'bigint')} as hmv, {_NONE.format(200, 'bigint')} as hcm,
    {_NONE.format(200, 'varchar')} as kfp, {_NONE.format(200, 'bigint')} as kcm, {_NONE.format(200, 'bigint')} as kat,
    cast(null as bigint) as seq, cast(null as varchar) as kind, cast(null as varchar) as err, false as logged, false as again, cast(null as bigint) as done,
    cast(null as varchar) as st, cast(null as bigint) as moved, cast(null as bigint) as fb, cast(null as bigint) as fr, cast(null as bigint) as tb
  from (select distinct g from o) x
  union all
  select g, n, bal, res, hst, ham, hfr, hto, hmv, hcm, kfp, kcm, kat, seq, kind, err, act or alias as logged, hit or alias as again, done,
    case when act then case kind when 'reserve' then 'reserved' when 'settle' then 'settled' when 'cancel' then 'cancelled' end end as st,
    case when act and kind in ('reserve', 'settle', 'cancel') then moved end as moved, case when act then bal[ff] end as fb, case when act then res[ff] end as fr, case when act then bal[tt] end as tb
  from (
    select * replace (
      {_SET.format('bal', "act and kind = 'create_account' and i = a", '1000')} as bal, {_SET.format('res', "act and kind = 'create_account' and i = a", '0')} as res,
      {_SET.format('kfp', '(act or alias) and i = k', 'fp')} as kfp, {_SET.format('kcm', '(act or alias) and i = k', 'done')} as kcm, {_SET.format('kat', '(act or alias) and i = k', 'happened')} as kat)
    from (
      select * replace (
        {_SET.format('bal', "act and kind in ('transfer', 'settle') and i in (ff, tt)", 'v + (case when i = ff then -1 else 1 end) * (case when kind = $$transfer$$ then amount else moved end)')} as bal,
        {_SET.format('res', f"act and (kind = 'reserve' or {_END}) and i = ff", 'case when kind = $$reserve$$ then v + amount else v - ham[h] end')} as res,
        {_SET.format('hst', f"act and i = h and (kind = 'reserve' or {_END})", 'case kind when $$reserve$$ then $$reserved$$ when $$settle$$ then $$settled$$ else $$cancelled$$ end')} as hst,
        {_SET.format('ham', "act and i = h and kind = 'reserve'", 'amount')} as ham, {_SET.format('hfr', "act and i = h and kind = 'reserve'", 'f')} as hfr, {_SET.format('hto', "act and i = h and kind = 'reserve'", 't')} as hto,
        {_SET.format('hmv', f"act and i = h and (kind = 'reserve' or {_END})", 'moved')} as hmv, {_SET.format('hcm', f'act and i = h and {_END}', 'seq')} as hcm)
      from (
        select *, case when err is not null then null when hit then kcm[k] when alias then hcm[h] else seq end as done, err is null and not hit and not alias as act
        from (
          select *, coalesce(known and kfp[k] = fp, false) as hit, not known and err is null and {_END} and hst[h] <> 'reserved' as alias
          from (
            select *, case
                when kind in ('transfer', 'reserve') and amount <= 0 then 'INVALID_AMOUNT'
                when known then case when kfp[k] <> fp then 'IDEMPOTENCY_CONFLICT' end
                when kind = 'create_account' then case when bal[a] is not null then 'ACCOUNT_EXISTS' end
                when kind = 'reserve' and hst[h] is not null then 'HOLD_EXISTS'
                when kind in ('transfer', 'reserve') then case when bal[f] is null or bal[t] is null then 'ACCOUNT_NOT_FOUND' when bal[f] - res[f] < amount then 'INSUFFICIENT_FUNDS' end
                when hst[h] is null then 'HOLD_NOT_FOUND'
                when hst[h] <> 'reserved' then case when hst[h] <> (case kind when 'cancel' then 'cancelled' else 'settled' end) or hmv[h] <> moved then 'HOLD_CONFLICT' end
                when moved > ham[h] then 'INVALID_AMOUNT' end as err
            from (
              select w.g, w.n + 1 as n, bal, res, hst, ham, hfr, hto, hmv, hcm, kfp, kcm, kat, o.seq, o.kind, o.a, o.f, o.t, o.h, o.k, o.happened, o.amount,
                case when o.kind = 'settle' then o.amount else 0 end as moved, coalesce(o.happened - kat[o.k] < {LEASE}, false) as known,
                case o.kind when 'create_account' then o.a when 'settle' then hfr[o.h] when 'cancel' then hfr[o.h] else o.f end as ff,
                case o.kind when 'create_account' then null when 'settle' then hto[o.h] when 'cancel' then hto[o.h] else o.t end as tt,
                concat(o.kind, case o.kind when 'create_account' then concat(':', o.a) when 'transfer' then concat(':', o.f, ':', o.t, ':', o.amount) when 'reserve' then concat(':', o.h, ':', o.f, ':', o.t, ':', o.amount) when 'settle' then concat(':', o.h, ':', o.amount) else concat(':', o.h) end) as fp
              from w join o on o.g = w.g and o.n = w.n) s1) s2) s3) s4) s5) s6
),
l as (select seq, cast(row_number() over (order by seq) as bigint) as lsn from w where logged),
outcomes as (
  select w.seq, w.kind, w.err as error_code, w.again as replayed, l.lsn as wal_lsn, c.lsn as commit_lsn, r.st as status, r.moved as settled_amount, r.fb as from_balance, r.fr as from_reserved, r.tb as to_balance
  from w left join l on l.seq = w.seq left join l c on c.seq = w.done left join w r on r.seq = w.done where w.seq is not null)"""

_COLUMNS = ("seq", "kind", "error_code", "replayed", "wal_lsn", "commit_lsn", "status", "settled_amount", "from_balance", "from_reserved", "to_balance")


def operations(spark, sf_dir: str) -> DataFrame:
    """The log as a table of operations."""
    made, pair, held = "kind = 'create_account'", "kind in ('transfer', 'reserve')", "kind in ('reserve', 'settle', 'cancel')"
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(1 + g as int), 1)"
    return views.run(spark, sf_dir, PARTS).selectExpr(
        "seq", "kind", "concat('k:', g, ':', k) as key", "happened as ts_nanos", f"if({made}, concat('m:', g, ':', a), null) as account_id", f"if({made}, concat({letter}, 'QX'), null) as currency",
        f"if({made}, 1000L, null) as opening_balance", f"if({held}, concat('w:', g, ':', h), null) as hold_id", f"if({pair}, concat('m:', g, ':', f), null) as from_account",
        f"if({pair}, concat('m:', g, ':', t), null) as to_account", "if(kind in ('transfer', 'reserve', 'settle'), amount, null) as amount", "false as cancelled",
    )


def _outcomes(spark, sf_dir: str) -> DataFrame:
    return replay.with_lsn(replay.replay(operations(spark, sf_dir), LEASE))


def mixed_replay(spark, sf_dir):
    """What becomes of each operation of the log."""
    return _outcomes(spark, sf_dir).select(*_COLUMNS)


def alias_records(spark, sf_dir):
    """Endings of holds that were repeated under another key: logged again, with the older result."""
    return idempotency.alias_records(_outcomes(spark, sf_dir)).select("seq", "kind", "wal_lsn", "commit_lsn", "status", "settled_amount")


def freed_keys(spark, sf_dir):
    """Keys that a rejected operation gave back: how often they were rejected for themselves, and the first commit after that."""
    out = _outcomes(spark, sf_dir).where("error_code is null or error_code not in ('IDEMPOTENCY_CONFLICT', 'INVALID_AMOUNT')")
    failed = out.groupBy("key").agg(F.count("error_code").cast("bigint").alias("rejections"), F.min(F.when(F.col("error_code").isNotNull(), F.col("seq"))).alias("_at")).where("rejections > 0")
    later = out.where("wal_lsn is not null").join(failed, "key").where("seq > _at").groupBy("key").agg(F.min("wal_lsn").alias("committed"))
    return failed.join(later, "key", "left").select("key", "rejections", "committed")


def recover_mixed_log(spark, sf_dir):
    """A log whose first half has records without post-images, read as one log."""
    out = _outcomes(spark, sf_dir).where("wal_lsn is not null and not replayed and kind in ('create_account', 'transfer')").withColumnRenamed("wal_lsn", "lsn")
    image = lambda side: F.struct(F.col(f"{side}_account").alias("id"), "currency", F.col(f"{side}_balance").alias("balance"), F.col(f"{side}_reserved").alias("reserved"), "lsn")
    images = F.when(F.col("kind") == "transfer", F.array(image("from"), image("to"))).otherwise(F.array(image("from")))
    made = F.col("kind") == "create_account"
    wal = out.select(
        "lsn", "kind", F.struct("from_account", "to_account").alias("request"),
        F.struct(F.when(made, F.col("from_account")).alias("account_id"), F.when(made, F.col("currency")).alias("currency"), F.col("from_balance").alias("balance"), "from_balance", "to_balance").alias("result"),
        F.when(F.col("seq") % 40 >= 20, F.struct(images.alias("accounts"))).alias("state"),
    )
    return recovery.recover_accounts(recovery.account_images(wal)).select("id", "balance", "lsn")


def pruned_shard(spark, sf_dir):
    """Keys of the events, of which one shard has been relieved of those older than a day."""
    e = views.events(spark, sf_dir)
    keys = e.select("key", F.expr("timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', ts) * 1000").alias("committed_at"))
    now = keys.agg(F.max("committed_at")).first()[0] or 0
    return idempotency.prune_shard(keys, 5, now, DAY_NANOS).groupBy(encoding.shard_index(F.col("key")).alias("shard")).agg(F.count("*").alias("keys"), F.min("committed_at").alias("oldest"))


QUERIES = {f.__name__: f for f in (mixed_replay, alias_records, freed_keys, recover_mixed_log, pruned_shard)}

SQL = {
    "mixed_replay": f"with recursive {WALK} select * from outcomes",
    "alias_records": f"with recursive {WALK} select seq, kind, wal_lsn, commit_lsn, status, settled_amount from outcomes where replayed and commit_lsn < wal_lsn",
    "freed_keys": f"""
with recursive {WALK}, u as (select concat('k:', o.g, ':', o.k) as key, c.* from outcomes c join o on o.seq = c.seq where error_code is null or error_code not in ('IDEMPOTENCY_CONFLICT', 'INVALID_AMOUNT')),
x as (select key, count(error_code) as rejections, min(case when error_code is not null then seq end) as first_no from u group by key having count(error_code) > 0)
select x.key, rejections, (select min(wal_lsn) from u where u.key = x.key and u.seq > first_no) as committed from x
""",
    "recover_mixed_log": f"""
with recursive {WALK}, u as (select concat('m:', o.g, ':', o.a) as made, concat('m:', o.g, ':', o.f) as f, concat('m:', o.g, ':', o.t) as t, c.* from outcomes c join o on o.seq = c.seq where wal_lsn is not null and not replayed),
x as (select made as id, wal_lsn as lsn, from_balance as balance from u where kind = 'create_account' union all select f, wal_lsn, from_balance from u where kind = 'transfer' union all select t, wal_lsn, to_balance from u where kind = 'transfer')
select id, arg_max(balance, lsn) as balance, max(lsn) as lsn from x group by id
""",
    "pruned_shard": f"""
with e as ({views.EVENTS}), k as (select key, epoch_us(ts) * 1000 as committed_at,
  cast(list_reduce(list_prepend(2166136261::bigint, list_transform(str_split(key, ''), lambda c: ascii(c)::bigint)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 64 as integer) as shard from e)
select shard, count(*) as keys, min(committed_at) as oldest from k where shard <> 5 or (select max(committed_at) from k) - committed_at < {DAY_NANOS} group by shard
""",
}
