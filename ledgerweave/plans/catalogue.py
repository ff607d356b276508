"""Registered queries of the ledger engine and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerweave.functions import encoding, validation
from ledgerweave.operators import admission, audit, committed, idempotency, numbering, recovery, replay, stats
from ledgerweave.plans import mixed
from ledgerweave.plans.schema import DAY_NANOS, MAX_INT64
from ledgerweave.sources import views, workload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

A, P, H, E, X = views.ACCOUNTS, views.PAYMENTS, views.HOLDS, views.EVENTS, views.P2P


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _big(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


# --- accounts and holds ------------------------------------------------------

#: Payments between accounts of one currency, and their entries.
OK = f"a as ({A}), p as ({P}), ok as (select p.* from p join a f on f.id = p.from_account join a t on t.id = p.to_account where f.currency = t.currency)"
ENTRIES = "entries as (select id, cast(0 as bigint) as seq, opening as delta, 0 as moved from a union all select from_account, seq, -amount, 1 from ok union all select to_account, seq, amount, 1 from ok)"


_MOVED = ("from_account", "to_account", "amount")


def _ok(spark: SparkSession, sf_dir: str, numbered: bool = True) -> tuple[DataFrame, DataFrame]:
    ok = views.committed(spark, sf_dir, *_MOVED, numbered=numbered)
    return views.accounts(spark, sf_dir), ok.drop("lsn")


@query(f"with {OK}, {ENTRIES} select id, cast(sum(delta) as bigint) as balance, cast(sum(moved) as bigint) as entries from entries group by id")
def account_statement(spark, sf_dir):
    return committed.balances(*_ok(spark, sf_dir, numbered=False))


@query(f"with s as ({views.STATES}) select *, balance - reserved as available from s where id = 'c:7'")
def account_lookup(spark, sf_dir):
    return views.states(spark, sf_dir).where("id = 'c:7'").withColumn("available", validation.available(F.col("balance"), F.col("reserved")))


@query(f"with a as ({A}) select distinct concat('c:', cast(o_orderkey as string)) as id, 'ACCOUNT_NOT_FOUND' as error_code from orders where concat('c:', cast(o_orderkey as string)) not in (select id from a)")
def account_missing(spark, sf_dir):
    """Numbers of orders asked for as if they were customers' accounts."""
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("c:"), F.col("o_orderkey").cast("string")).alias("id")).distinct()
    return ids.join(views.accounts(spark, sf_dir), "id", "left_anti").withColumn("error_code", F.lit("ACCOUNT_NOT_FOUND"))


@query(f"select * from ({H}) h where hold_id = 'h:7'")
def hold_lookup(spark, sf_dir):
    return views.holds(spark, sf_dir).where("hold_id = 'h:7'")


@query(f"select status, count(*) as holds, cast(sum(amount) as bigint) as amount, cast(sum(settled_amount) as bigint) as settled from ({H}) h group by status")
def holds_by_status(spark, sf_dir):
    return views.holds(spark, sf_dir).groupBy("status").agg(F.count("*").alias("holds"), F.sum("amount").alias("amount"), F.sum("settled_amount").alias("settled"))


@query(f"""
select seq, account_id, case when row_number() over (partition by account_id order by seq) > 1 then 'ACCOUNT_EXISTS' end as error_code
from ({E}) e where event_type = 'signup'
""")
def create_accounts_first_wins(spark, sf_dir):
    made = views.events(spark, sf_dir).where("event_type = 'signup'").select("seq", "account_id")
    return admission.first_creations(made)


# --- checks ------------------------------------------------------------------

_BAD_PAIR = "case when from_account is null or length(from_account) = 0 then 'INVALID_ACCOUNT_ID' when to_account is null or length(to_account) = 0 then 'INVALID_ACCOUNT_ID' when from_account = to_account then 'SAME_ACCOUNT' when amount <= 0 then 'INVALID_AMOUNT' end"


@query(f"""
select seq, kind, case when cancelled then 'CANCELLED' when length(key) = 0 then 'INVALID_IDEMPOTENCY_KEY'
  when kind = 'create_account' then case when account_id is null then 'INVALID_ACCOUNT_ID' when not regexp_full_match(currency, '[A-Z][A-Z][A-Z]') then 'INVALID_CURRENCY' when opening_balance < 0 then 'INVALID_OPENING_BALANCE' end
  when kind = 'transfer' then {_BAD_PAIR}
  when hold_id = '' then 'INVALID_HOLD_ID'
  when kind = 'reserve' then {_BAD_PAIR}
  when kind = 'settle' and amount < 0 then 'INVALID_AMOUNT' end as error_code
from ({views.OPS}) o
""")
def validate_ops_errors(spark, sf_dir):
    return views.ops(spark, sf_dir).select("seq", "kind", validation.shape_error().alias("error_code"))


@query(f"""
with a as ({A}), p as ({P})
select seq, case when f.id is null or t.id is null then 'ACCOUNT_NOT_FOUND' when f.currency <> t.currency then 'CURRENCY_MISMATCH' end as error_code
from p left join a f on f.id = p.from_account left join a t on t.id = p.to_account
""")
def pair_check(spark, sf_dir):
    pairs = committed.same_currency(views.payments(spark, sf_dir, "from_account", "to_account"), views.accounts(spark, sf_dir), "left")
    return pairs.select("seq", validation.pair_error(F.col("from_currency"), F.col("to_currency")).alias("error_code"))


@query(f"""
with s as ({views.STATES}), p as ({P})
select seq, case when f.balance - f.reserved < amount then 'INSUFFICIENT_FUNDS' when t.balance > {MAX_INT64} - amount then 'BALANCE_OVERFLOW' end as error_code
from p join s f on f.id = p.from_account join s t on t.id = p.to_account
""")
def funds_check(spark, sf_dir):
    s = views.states(spark, sf_dir)
    rows = views.payments(spark, sf_dir, *_MOVED).join(s.select(F.col("id").alias("from_account"), "balance", "reserved"), "from_account").join(s.select(F.col("id").alias("to_account"), F.col("balance").alias("to_balance")), "to_account")
    return rows.select("seq", validation.funds_error(F.col("balance"), F.col("reserved"), F.col("to_balance"), F.col("amount")).alias("error_code"))


@query(f"select seq from ({views.OPS}) o where cancelled")
def cancelled_ops(spark, sf_dir):
    return views.ops(spark, sf_dir).where("cancelled").select("seq")


# --- idempotency -------------------------------------------------------------

#: Every tenth payment is sent again, and every seventh of those with another amount.
RETRIED = f"""p as ({P}), r as (
  select seq, key, from_account, to_account, amount from p
  union all select seq + (select max(seq) from p), key, from_account, to_account, amount + case when seq % 70 = 0 then 1 else 0 end from p where seq % 10 = 0)"""


def _retried(spark, sf_dir):
    p = views.payments(spark, sf_dir, "key", *_MOVED)
    again = p.where("seq % 10 = 0").crossJoin(F.broadcast(p.agg(F.max("seq").alias("top"))))  # one row
    return p.unionAll(again.select(F.col("seq") + F.col("top"), "key", "from_account", "to_account", F.col("amount") + F.expr("if(seq % 70 = 0, 1, 0)")))


_JSON = """concat('{"FromAccount":"', from_account, '","ToAccount":"', to_account, '","Amount":', amount, '}')"""


def _with_fingerprint(df):
    json = encoding.request_json(lambda c: F.col(c) if c in ("from_account", "to_account", "amount") else F.lit("transfer") if c == "kind" else F.lit(None).cast("string"))
    return df.withColumn("fingerprint", encoding.fingerprint(F.lit("transfer"), json))


@query(f"""
with {RETRIED}, c as (select *, concat(from_account, '>', to_account, '=', amount) as f from r)
select seq, key, case when row_number() over w = 1 then 'winner' when f = first_value(f) over w then 'replay' else 'conflict' end as outcome
from c window w as (partition by key order by seq)
""")
def idempotency_outcomes(spark, sf_dir):
    return idempotency.classify(_with_fingerprint(_retried(spark, sf_dir))).select("seq", "key", "outcome")


@query(f"with {RETRIED} select key, min(seq) as seq, arg_min(amount, seq) as amount from r group by key")
def idempotency_winners(spark, sf_dir):
    return idempotency.winners(_retried(spark, sf_dir)).select("key", "seq", "amount")


@query(f"with p as ({P}) select seq, sha256('transfer' || chr(0) || {_JSON}) as fingerprint from p")
def request_fingerprint(spark, sf_dir):
    return _with_fingerprint(views.payments(spark, sf_dir, *_MOVED)).select("seq", "fingerprint")


@query(f"""
with a as ({A}), h as (
  select list_reduce(list_prepend(2166136261::bigint, list_transform(str_split(id, ''), lambda c: ascii(c)::bigint)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) as f from a)
select cast(f % 64 as integer) as shard, count(*) as accounts from h group by 1
""")
def shard_distribution(spark, sf_dir):
    return views.accounts(spark, sf_dir).groupBy(encoding.shard_index(F.col("id")).alias("shard")).agg(F.count("*").alias("accounts"))


LEASE = 3 * DAY_NANOS
_NANOS = "epoch_us(ts) * 1000"


def _nanos(c):
    return F.expr(f"timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', {c}) * 1000")


@query(f"""
with recursive e as (select seq, account_id as key, event_type as f, {_NANOS} as happened, row_number() over (partition by account_id order by seq) as n from ({E}) e),
w as (
  select seq, key, n, f as held, happened as since, 'winner' as outcome from e where n = 1
  union all
  select e.seq, e.key, e.n, case when e.happened - w.since >= {LEASE} then e.f else held end, case when e.happened - w.since >= {LEASE} then e.happened else since end,
         case when e.happened - w.since >= {LEASE} then 'winner' when e.f = held then 'replay' else 'conflict' end
  from w join e on e.key = w.key and e.n = w.n + 1
)
select key, seq, outcome from w
""")
def lease_expiry(spark, sf_dir):
    e = views.events(spark, sf_dir).select("seq", F.col("account_id").alias("key"), F.col("event_type").alias("fingerprint"), _nanos("ts").alias("ts_nanos"))
    return idempotency.with_leases(e, LEASE)


NOW = "(select max(ts) from events)"


def _keys(spark, sf_dir):
    e = views.events(spark, sf_dir).select(F.col("account_id").alias("key"), F.col("event_type").alias("kind"), F.col("seq").alias("lsn"), _nanos("ts").alias("committed_at"))
    return e, e.agg(F.max("committed_at")).first()[0] or 0


@query(f"""
with e as ({E})
select account_id as key, arg_max(event_type, seq) as kind, max(seq) as lsn, arg_max({_NANOS}, seq) as committed_at
from e where epoch_us({NOW}) * 1000 - {_NANOS} < {LEASE} group by account_id
""")
def recover_keys(spark, sf_dir):
    e, now = _keys(spark, sf_dir)
    return recovery.recover_keys(e, now, LEASE)


@query(f"with e as ({E}) select count(*) as retained, cast(sum(case when epoch_us({NOW}) * 1000 - {_NANOS} >= {DAY_NANOS} then 1 else 0 end) as bigint) as pruned_after_a_day from e where epoch_us({NOW}) * 1000 - {_NANOS} < {LEASE}")
def retained_keys(spark, sf_dir):
    e, now = _keys(spark, sf_dir)
    return idempotency.retained(e, now, LEASE).agg(F.count("*").alias("retained"), F.count_if(encoding.expired(F.col("committed_at"), F.lit(now), DAY_NANOS)).alias("pruned_after_a_day"))


# --- committed log -----------------------------------------------------------

RUNNING = f"{OK}, {ENTRIES}, running as (select id, seq, cast(sum(delta) over (partition by id order by seq rows unbounded preceding) as bigint) as balance from entries)"


@query(f"with {RUNNING} select id, seq, balance from running")
def running_balance(spark, sf_dir):
    return committed.running_balances(*_ok(spark, sf_dir))


@query(f"with {OK}, {ENTRIES} select id, cast(sum(delta) as bigint) as balance from entries where seq <= 1000 group by id")
def balance_as_of(spark, sf_dir):
    return committed.balance_as_of(*_ok(spark, sf_dir), 1000)


@query(f"with {OK}, b as (select id, sum(delta) as delta from (select from_account as id, -amount as delta from ok union all select to_account, amount from ok) x group by id) select a.id, a.currency, cast(opening + coalesce(delta, 0) as bigint) as balance from a left join b on b.id = a.id")
def committed_balances(spark, sf_dir):
    a, ok = _ok(spark, sf_dir, numbered=False)
    return committed.balances(a, ok).join(a.select("id", "currency"), "id").select("id", "currency", "balance")


@query(f"with {OK} select seq, cast(row_number() over (order by seq) as bigint) as lsn from ok")
def lsn_assignment(spark, sf_dir):
    return views.committed(spark, sf_dir).select("seq", "lsn")


def _log(spark, sf_dir, *columns):
    """The committed payments' log: lsn and columns."""
    return views.committed(spark, sf_dir, *columns).drop("seq")


LOG = f"{OK}, log as (select ok.seq, key, from_account, to_account, amount, a.currency, cast(row_number() over (order by seq) as bigint) as lsn from ok join a on a.id = ok.from_account)"


@query(f"with {LOG} select cast(floor((lsn - 1) / 64) as bigint) as batch, count(*) as records, min(lsn) as first_lsn, max(lsn) as last_lsn from log group by 1")
def group_commit_batches(spark, sf_dir):
    return numbering.commit_batches(_log(spark, sf_dir), 64).groupBy("batch").agg(F.count("*").alias("records"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


@query(f"with {LOG} select count(*) / cast(count(distinct floor((lsn - 1) / 64)) as double) as average_batch_size from log")
def average_batch_size(spark, sf_dir):
    return stats.average_batch(numbering.commit_batches(_log(spark, sf_dir), 64))


@query(f"with {LOG} select cast(lsn / 500 as bigint) as checkpoint, lsn as base_lsn from log where lsn % 500 = 0")
def checkpoints_due(spark, sf_dir):
    return numbering.checkpoints_due(_log(spark, sf_dir), 500)


def _images(spark, sf_dir):
    a, log = views.accounts(spark, sf_dir), _log(spark, sf_dir, *_MOVED)
    w = Window.partitionBy("id").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    run = committed.entries(log, "lsn").withColumn("delta", F.sum("delta").over(w)).join(a, "id")
    return a, run.select("id", "currency", (F.col("opening") + F.col("delta")).alias("balance"), F.lit(0).cast("bigint").alias("reserved"), "lsn", "debit")


def log_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account post-images of the committed payments' log."""
    return _images(spark, sf_dir)[1].drop("debit")


IMAGES = f"{LOG}, e as (select from_account as id, lsn, -amount as delta from log union all select to_account, lsn, amount from log), images as (select e.id, currency, cast(opening + sum(delta) over (partition by e.id order by lsn rows unbounded preceding) as bigint) as balance, cast(0 as bigint) as reserved, lsn from e join a on a.id = e.id)"


@query(f"with {IMAGES} select id, arg_max(currency, lsn) as currency, arg_max(balance, lsn) as balance, arg_max(reserved, lsn) as reserved, max(lsn) as lsn from images group by id")
def recover_accounts(spark, sf_dir):
    return recovery.recover_accounts(_images(spark, sf_dir)[1])


@query(f"with {IMAGES} select id, arg_max(currency, lsn) as currency, arg_max(balance, lsn) as balance, arg_max(reserved, lsn) as reserved, max(lsn) as lsn from images group by id")
def snapshot_plus_tail(spark, sf_dir):
    """A snapshot at record 1000 and the tail after it give what the whole log gives."""
    images = _images(spark, sf_dir)[1]
    return recovery.recover_accounts(recovery.tail(images, 1000), recovery.recover_accounts(images.where("lsn <= 1000")))


@query(f"""
with {IMAGES}, made as (select id, currency, opening as balance, cast(0 as bigint) as reserved, cast(0 as bigint) as lsn from a), x as (select * from made union all select * from images)
select id, max(currency) as currency, arg_max(balance, lsn) as balance, arg_max(reserved, lsn) as reserved, max(lsn) as lsn from x group by id
""")
def recover_old_records(spark, sf_dir):
    """Records without post-images: a creation's account, and each side of a transfer by itself."""
    a, images = _images(spark, sf_dir)
    moved = images.where("debit").select("lsn", F.col("id").alias("from_account"), F.col("balance").alias("fb")).join(images.where("not debit").select("lsn", F.col("id").alias("to_account"), F.col("balance").alias("tb")), "lsn")
    null = F.lit(None).cast("string")
    request = F.struct(F.col("from_account"), F.col("to_account"))
    rows = moved.select("lsn", F.lit("transfer").alias("kind"), request.alias("request"), F.struct(null.alias("account_id"), null.alias("currency"), F.lit(None).cast("bigint").alias("balance"), F.col("fb").alias("from_balance"), F.col("tb").alias("to_balance")).alias("result"))
    big = F.lit(None).cast("bigint")
    made = a.select(F.lit(0).cast("bigint").alias("lsn"), F.lit("create_account").alias("kind"), F.struct(null.alias("from_account"), null.alias("to_account")).alias("request"), F.struct(F.col("id").alias("account_id"), "currency", F.col("opening").alias("balance"), big.alias("from_balance"), big.alias("to_balance")).alias("result"))
    return recovery.recover_accounts(recovery.old_images(made.unionByName(rows)))


@query(f"""
with h as ({H}), n as (select *, row_number() over (order by cast(substr(hold_id, 3) as bigint)) as i from h)
select hold_id, from_account, to_account, amount, status, settled_amount, cast(2 * i - case when status = 'reserved' then 1 else 0 end as bigint) as lsn from n
""")
def recover_holds(spark, sf_dir):
    """A reservation at 2i - 1 and, if the hold is closed, its end at 2i."""
    h = views.holds(spark, sf_dir).withColumn("o", F.expr("cast(substr(hold_id, 3) as bigint)"))
    n = numbering.dense_number(h, "i", F.floor(F.col("o") / 4096), "o")
    opened = n.select("hold_id", "from_account", "to_account", "amount", F.lit("reserved").alias("status"), F.lit(0).cast("bigint").alias("settled_amount"), (2 * F.col("i") - 1).cast("bigint").alias("lsn"))
    closed = n.where("status != 'reserved'").select("hold_id", "from_account", "to_account", "amount", "status", "settled_amount", (2 * F.col("i")).cast("bigint").alias("lsn"))
    return recovery.recover_holds(opened.unionAll(closed))


@query(f"""
with {LOG}, d as (select lsn as position, cast(case when lsn % 250 = 0 then lsn - 3 else lsn end as bigint) as lsn from log),
p2 as (select lsn, lag(lsn) over (order by position) as before from d)
select lsn, before from p2 where before >= lsn
""")
def wal_monotonic_check(spark, sf_dir):
    """A damaged log: every 250th record has a number that was given before, also where a segment begins."""
    log = _log(spark, sf_dir).select("lsn", F.floor(F.col("lsn") / 1000).alias("segment"), F.col("lsn").alias("position"))
    log = log.withColumn("lsn", F.when(F.col("lsn") % 250 == 0, F.col("lsn") - 3).otherwise(F.col("lsn")))
    return recovery.log_breaks(log).select("lsn", "before")


_SIZE = f"""16 + length({_JSON})"""


@query(f"""
with recursive {LOG}, r as (select currency as writer, lsn, cast({_SIZE} as bigint) as size, row_number() over (partition by currency order by lsn) as n from log),
w as (
  select writer, lsn, size, n, cast(1 as bigint) as segment, size as used from r where n = 1
  union all
  select r.writer, r.lsn, r.size, r.n, case when used + r.size > 20000 then segment + 1 else segment end, case when used + r.size > 20000 then r.size else used + r.size end
  from w join r on r.writer = w.writer and r.n = w.n + 1
)
select writer, lsn, size, segment from w
""")
def segment_rotation(spark, sf_dir):
    """A log per currency in segments of 20,000 bytes."""
    log = _log(spark, sf_dir, *_MOVED, "currency")
    return recovery.segments(log.select(F.col("currency").alias("writer"), "lsn", F.expr(f"cast(16 + octet_length({_JSON}) as bigint)").alias("size")), 20000)


@query(f"""
with {LOG}, s as (select lsn, cast(floor(lsn / 1000) as bigint) as segment from log), g as (select segment, max(lsn) as last_lsn, count(*) as records from s group by segment)
select segment, last_lsn, records from g where segment < (select max(segment) from g) and last_lsn <= 7500
""")
def compaction_plan(spark, sf_dir):
    log = _log(spark, sf_dir).select("lsn", F.floor(F.col("lsn") / 1000).alias("segment"))
    return recovery.compactable(log, 7500)


@query(f"with {LOG} select lsn, lpad(cast(lsn as varchar), 20, '0') || '.wal' as segment, 'checkpoint-' || lpad(cast(lsn as varchar), 20, '0') || '.ckpt' as checkpoint, lsn as number, cast(null as bigint) as none from log")
def file_names(spark, sf_dir):
    log = _log(spark, sf_dir).select("lsn", encoding.segment_name(F.col("lsn")).alias("segment"), encoding.checkpoint_name(F.col("lsn")).alias("checkpoint"))
    return log.withColumn("number", encoding.number_of(F.col("segment"))).withColumn("none", encoding.number_of(F.concat(F.lit("x"), F.col("segment"))))


# --- holds -------------------------------------------------------------------

RESERVES = f"rv as (select cast(substr(hold_id, 3) as bigint) as seq, from_account, amount from ({H}) h)"


@query(f"""
with recursive a as ({A}), {RESERVES}, r as (select rv.*, opening, row_number() over (partition by from_account order by seq) as n from rv join a on a.id = rv.from_account),
w as (
  select from_account, seq, amount, n, opening - case when opening >= amount then amount else 0 end as left_, opening >= amount as accepted from r where n = 1
  union all
  select r.from_account, r.seq, r.amount, r.n, left_ - case when left_ >= r.amount then r.amount else 0 end, left_ >= r.amount from w join r on r.from_account = w.from_account and r.n = w.n + 1
)
select from_account, seq, amount, accepted from w
""")
def reserve_admission(spark, sf_dir):
    r = views.holds(spark, sf_dir).selectExpr("cast(substr(hold_id, 3) as bigint) as seq", "from_account", "amount")
    return admission.reserve_admission(r, views.accounts(spark, sf_dir))


#: Three closing attempts per hold: settle for what was settled, then for one less, or cancel; and the first one again.
TERMINALS = f"""h as ({H}), held as (select hold_id, amount, cast(substr(hold_id, 3) as bigint) as seq from h),
t as (
  select seq + 1000000 as seq, hold_id, case when seq % 3 = 0 then 'cancel' else 'settle' end as kind, case when seq % 3 = 0 then 0 when seq % 7 = 0 then amount + 1 else amount end as amount from held
  union all select seq + 2000000, hold_id, case when seq % 5 = 0 then 'cancel' else 'settle' end, case when seq % 5 = 0 then 0 else amount - seq % 2 end from held
  union all select seq + 3000000, hold_id, case when seq % 3 = 0 then 'cancel' else 'settle' end, case when seq % 3 = 0 then 0 else amount end from held
  union all select seq + 4000000, 'none', 'cancel', 0 from held where seq % 50 = 0)"""


@query(f"""
with {TERMINALS}, j as (select t.*, held.amount as most, held.seq < t.seq as known from t left join held on held.hold_id = t.hold_id),
d as (select hold_id, min(seq) as at from j where known and (kind = 'cancel' or amount <= most) group by hold_id),
f as (select d.hold_id, d.at, t.kind, t.amount from d join t on t.hold_id = d.hold_id and t.seq = d.at)
select j.seq, j.hold_id, j.kind, cast(j.amount as bigint) as amount,
  case when known is not true then 'HOLD_NOT_FOUND' when j.seq > f.at and not (j.kind = f.kind and (j.kind = 'cancel' or j.amount = f.amount)) then 'HOLD_CONFLICT'
       when (f.at is null or j.seq < f.at) then 'INVALID_AMOUNT' end as error_code,
  coalesce(j.seq > f.at and j.kind = f.kind and (j.kind = 'cancel' or j.amount = f.amount), false) as replayed
from j left join f on f.hold_id = j.hold_id
""")
def hold_lifecycle(spark, sf_dir):
    tables = views.holds(spark, sf_dir).selectExpr("hold_id", "amount", "cast(substr(hold_id, 3) as bigint) as seq")
    t = tables.selectExpr(
        "explode(array(named_struct('seq', seq + 1000000, 'hold_id', hold_id, 'kind', if(seq % 3 = 0, 'cancel', 'settle'), 'amount', case when seq % 3 = 0 then 0L when seq % 7 = 0 then amount + 1 else amount end),"
        "named_struct('seq', seq + 2000000, 'hold_id', hold_id, 'kind', if(seq % 5 = 0, 'cancel', 'settle'), 'amount', case when seq % 5 = 0 then 0L else amount - seq % 2 end),"
        "named_struct('seq', seq + 3000000, 'hold_id', hold_id, 'kind', if(seq % 3 = 0, 'cancel', 'settle'), 'amount', case when seq % 3 = 0 then 0L else amount end),"
        "if(seq % 50 = 0, named_struct('seq', seq + 4000000, 'hold_id', 'none', 'kind', 'cancel', 'amount', 0L), null))) as x"
    ).where("x is not null").select("x.*")
    return admission.lifecycle(tables, t)


@query(f"""
with h as ({H}), x as (
  select from_account as id, case when status = 'settled' then -settled_amount else 0 end as b, case when status = 'reserved' then amount else 0 end as r from h
  union all select to_account, case when status = 'settled' then settled_amount else 0 end, 0 from h)
select id, cast(sum(b) as bigint) as balance_delta, cast(sum(r) as bigint) as reserved_delta from x group by id
""")
def settlement_release(spark, sf_dir):
    return admission.hold_effects(views.holds(spark, sf_dir))


@query(f"""
with s as ({views.STATES}), h as ({H})
select hold_id, h.status, settled_amount, f.balance - settled_amount as from_balance, f.reserved as from_reserved, t.balance + settled_amount as to_balance
from h join s f on f.id = h.from_account join s t on t.id = h.to_account
""")
def payment_results(spark, sf_dir):
    """What each hold's last result would say if it were the only one to move money."""
    s = views.states(spark, sf_dir)
    rows = views.holds(spark, sf_dir).join(s.select(F.col("id").alias("from_account"), F.col("balance").alias("fb"), "reserved"), "from_account").join(s.select(F.col("id").alias("to_account"), F.col("balance").alias("tb")), "to_account")
    return rows.select("hold_id", "status", "settled_amount", (F.col("fb") - F.col("settled_amount")).alias("from_balance"), F.col("reserved").alias("from_reserved"), (F.col("tb") + F.col("settled_amount")).alias("to_balance"))


# --- audits and statistics ---------------------------------------------------


@query(f"""
with s as ({views.STATES})
select id, case when reserved > balance then 'reserved out of range' end as violation from s where reserved > balance
""")
def audit_accounts(spark, sf_dir):
    s = views.states(spark, sf_dir).withColumn("lsn", F.lit(1).cast("bigint"))
    return audit.account_violations(s, views.holds(spark, sf_dir))


@query(f"""
with a as ({A}), h as ({H}), x as (select hold_id, f.currency as fc, t.currency as tc from h left join a f on f.id = h.from_account left join a t on t.id = h.to_account)
select hold_id, case when fc is null or tc is null then 'account missing' else 'currencies differ' end as violation from x where fc is null or tc is null or fc <> tc
""")
def audit_holds(spark, sf_dir):
    return audit.hold_violations(views.holds(spark, sf_dir).withColumn("lsn", F.lit(1).cast("bigint")), views.accounts(spark, sf_dir))


@query(f"""
with s as ({views.STATES}), h as ({H}), g as (select from_account, cast(sum(amount) as bigint) as held from h where status = 'reserved' and amount % 10 <> 0 group by 1)
select coalesce(s.id, g.from_account) as id, coalesce(reserved, 0) as reserved, coalesce(held, 0) as held from s full join g on g.from_account = s.id where coalesce(reserved, 0) <> coalesce(held, 0)
""")
def audit_reservations(spark, sf_dir):
    """Reservations against holds of which a tenth has been lost."""
    return audit.reconciliation(views.states(spark, sf_dir), views.holds(spark, sf_dir).where("amount % 10 != 0"))


@query(f"""
with {OK}, {ENTRIES}, b as (select id, sum(delta) as balance from entries group by id)
select a.currency, cast(sum(opening) as bigint) as opened, cast(sum(balance) as bigint) as held, sum(opening) = sum(balance) as conserved from a join b on b.id = a.id group by a.currency
""")
def conservation(spark, sf_dir):
    a, ok = _ok(spark, sf_dir, numbered=False)
    return committed.conservation(a, committed.balances(a, ok))


@query(f"""
with {OK}, o as (select from_account as id, sum(amount) as debits from ok group by 1), i as (select to_account as id, sum(amount) as credits from ok group by 1)
select a.id, opening, cast(coalesce(debits, 0) as decimal(38,0)) as debits, cast(coalesce(credits, 0) as decimal(38,0)) as credits, opening >= coalesce(debits, 0) and opening + coalesce(credits, 0) <= {MAX_INT64} as proven
from a left join o on o.id = a.id left join i on i.id = a.id
""")
def no_reject_proof(spark, sf_dir):
    return committed.always_affordable(*_ok(spark, sf_dir, numbered=False))


@query(f"""
with {RETRIED}, c as (select *, row_number() over (partition by key order by seq) as n, concat(from_account, to_account, amount) as f, first_value(concat(from_account, to_account, amount)) over (partition by key order by seq) as g from r),
h as ({H}), e as ({E})
select (select count(*) from c where n = 1) as last_lsn, (select count(*) from c where n = 1) as mutations, cast(ceil((select count(*) from c where n = 1) / 64.0) as bigint) as batches,
  (select count(*) from c where n > 1 and f = g) as duplicates, (select count(*) from c where f <> g) as rejections,
  (select count(*) from h where status = 'reserved') as active_holds, (select count(*) from h where status <> 'reserved') as terminal_holds,
  (select count(*) from e where epoch_us({NOW}) * 1000 - {_NANOS} < {LEASE}) as idempotency_keys
""")
def ledger_stats(spark, sf_dir):
    told = idempotency.classify(_with_fingerprint(_retried(spark, sf_dir)))
    n = _big(numbering.assign_lsn(told.where("outcome = 'winner'").select("seq")), "lsn").select("seq", F.col("lsn").alias("wal_lsn"))
    out = told.join(n, "seq", "left").select("seq", "wal_lsn", (F.col("outcome") == "replay").alias("replayed"), F.when(F.col("outcome") == "conflict", "IDEMPOTENCY_CONFLICT").alias("error_code"))
    keys, now = _keys(spark, sf_dir)
    return stats.ledger_stats(out, views.holds(spark, sf_dir), keys, now, LEASE, 64)


@query(f"""
with e as ({E}), l as (select event_type, list_sort(list(amount)) as x, count(*) as n from e group by event_type)
select event_type, n, x[cast(floor((n - 1) * 0.5) as bigint) + 1] as p50, x[cast(floor((n - 1) * 0.95) as bigint) + 1] as p95, x[cast(floor((n - 1) * 0.99) as bigint) + 1] as p99 from l
""")
def latency_percentiles(spark, sf_dir):
    return stats.percentiles(views.events(spark, sf_dir), "amount", "event_type")


# --- workloads and replays ---------------------------------------------------


def _workload(name: str, a: str, b: str):
    sql = f"""
with ops as (select i, {a} as a, {b} as b from range(10000) t(i))
select 'account-' || n as id, cast(10001 - coalesce(d, 0) + coalesce(c, 0) as bigint) as balance, cast(coalesce(d, 0) + coalesce(c, 0) as bigint) as entries
from range(64) x(n) left join (select a, count(*) as d from ops group by a) y on y.a = n left join (select b, count(*) as c from ops group by b) z on z.b = n
"""

    def run(spark, sf_dir):
        return committed.balances(workload.accounts(spark, 64, 10000), workload.transfers(spark, name, 10000))

    run.__name__ = f"workload_{name}"
    query(sql)(run)


_workload("disjoint", "(i % 16) * 2", "(i % 16) * 2 + 1")
_workload("uniform", "i * 31 % 64", "(i * 31 % 64 + 1 + i * 17 % 63) % 64")
_workload("hot", "0", "1 + i % 63")


def _transfer_ops(df: DataFrame) -> DataFrame:
    null = F.lit(None)
    return df.select(
        "seq", F.lit("transfer").alias("kind"), "key", F.lit(0).cast("bigint").alias("ts_nanos"), null.cast("string").alias("account_id"), null.cast("string").alias("currency"),
        null.cast("bigint").alias("opening_balance"), null.cast("string").alias("hold_id"), "from_account", "to_account", "amount", F.lit(False).alias("cancelled"),
    )


#: Customers only pay and suppliers only receive, so a fold per source is exact there.
ADMITTED = f"""a as ({A}), p as ({P}), c as (select p.*, f.opening, f.currency <> t.currency as differ from p join a f on f.id = p.from_account join a t on t.id = p.to_account),
n as (select *, row_number() over (partition by from_account order by seq) as n from c where not differ),
w as (
  select seq, from_account, n, opening - case when opening >= amount then amount else 0 end as left_, opening >= amount as ok from n where n = 1
  union all
  select n.seq, n.from_account, n.n, left_ - case when left_ >= amount then amount else 0 end, left_ >= amount from w join n on n.from_account = w.from_account and n.n = w.n + 1
)"""


@query(f"with recursive {ADMITTED} select from_account, seq, ok as accepted from w")
def payments_admission(spark, sf_dir):
    a, ok = _ok(spark, sf_dir)
    return admission.reserve_admission(ok.select("seq", "from_account", "amount"), a).select("from_account", "seq", "accepted")


@query(f"""
with recursive {ADMITTED}
select c.seq, case when differ then 'CURRENCY_MISMATCH' when not ok then 'INSUFFICIENT_FUNDS' end as error_code, case when ok then left_ end as from_balance
from c left join w on w.seq = c.seq
""")
def replay_payments(spark, sf_dir):
    """The full fold over all payments, each under a key of its own."""
    a = views.accounts(spark, sf_dir).select("id", "currency", F.col("opening").alias("balance"), F.lit(0).cast("bigint").alias("reserved"))
    ops = _transfer_ops(views.payments(spark, sf_dir, *_MOVED).withColumn("key", F.concat(F.lit("p:"), F.col("seq").cast("string"))))
    return replay.replay(ops, DAY_NANOS, accounts=a).select("seq", "error_code", "from_balance")


def p2p_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("USD").alias("currency"), F.lit(5_000_000).cast("bigint").alias("balance"), F.lit(0).cast("bigint").alias("reserved"))


#: One walk over all operations in order: a list of the 25 balances, and after them number and balances of each transfer accepted.
COUPLED = f"""o as (select seq, key, [seq, cast(substr(from_account, 3) as bigint) + 1, cast(substr(to_account, 3) as bigint) + 1, amount] as x from ({X}) x),
r as (select list_reduce(list(x order by seq), lambda s, o: case when s[o[2]] < o[4] then s else list_concat(
  list_transform(s[1:25], lambda v, i: case when i = o[2] then v - o[4] when i = o[3] then v + o[4] else v end), s[26:], [o[1], s[o[2]] - o[4], s[o[3]] + o[4]]) end,
  list_transform(range(25), lambda i: cast(5000000 as bigint))) as s from o),
k as (select unnest(range(26, len(s), 3)) as i, s from r),
done as (select s[i] as seq, s[i + 1] as from_balance, s[i + 2] as to_balance, cast((i - 23) // 3 as bigint) as wal_lsn from k)"""
_COUPLED_OUT = "o.seq, key, case when d.seq is null then 'INSUFFICIENT_FUNDS' end as error_code, from_balance, to_balance"


@query(f"with {COUPLED} select {_COUPLED_OUT}, wal_lsn from o left join done d on d.seq = o.seq")
def coupled_replay(spark, sf_dir):
    """Accounts that fund each other."""
    out = replay.replay(_transfer_ops(views.p2p(spark, sf_dir)), DAY_NANOS, accounts=p2p_accounts(spark, sf_dir))
    return replay.with_lsn(out).select("seq", "key", "error_code", "wal_lsn", "from_balance", "to_balance")


@query(f"with {COUPLED} select {_COUPLED_OUT} from o left join done d on d.seq = o.seq")
def stream_replay(spark, sf_dir):
    """The same as a stream over the orders' file, appended to a table."""
    from ledgerweave.sources.scratch import scratch_path
    from ledgerweave.streaming.replay import outcomes, stream_replay as streamed

    orders = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/orders.parquet").schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).selectExpr(
        "o_orderkey + 1 as seq", "concat('p:', o_orderkey) as key", "concat('n:', c_nationkey) as from_account", "concat('n:', (c_nationkey + 1 + o_orderkey % 24) % 25) as to_account", "cast(round(o_totalprice * 100) as bigint) as amount"
    )
    made = orders.where("o_orderkey < 25").selectExpr("o_orderkey - 25 as seq", "'create_account' as kind", "concat('a:', o_orderkey) as key", "0L as ts_nanos", "concat('n:', o_orderkey) as account_id", "'USD' as currency", "5000000L as opening_balance", "cast(null as string) as hold_id", "cast(null as string) as from_account", "cast(null as string) as to_account", "cast(null as bigint) as amount", "false as cancelled")
    out, at = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    streamed(made.unionByName(_transfer_ops(rows)), DAY_NANOS, out, at).awaitTermination()
    return outcomes(spark, out).where("kind = 'transfer'").select("seq", "key", "error_code", "from_balance", "to_balance")


@query(f"with {LOG} select currency as writer, lsn, 'transfer' as kind, key, sha256('transfer' || chr(0) || {_JSON}) as fingerprint, {_JSON} as request, cast(2 as integer) as version from log")
def log_round_trip(spark, sf_dir):
    """The committed log framed into segments of bytes, a log per currency, and decoded again."""
    from ledgerweave.sources.log_files import decode_segments, encode_segments

    log = _log(spark, sf_dir, "key", *_MOVED, "currency").withColumnRenamed("currency", "writer").withColumn("segment", F.floor(F.col("lsn") / 500))

    def written_out(rows):
        return _with_fingerprint(rows).select(
            "writer", "segment", "lsn", F.lit("transfer").alias("kind"), F.lit(1).cast("bigint").alias("committed_at"), "key", "fingerprint",
            F.to_json(F.struct(F.col("from_account").alias("FromAccount"), F.col("to_account").alias("ToAccount"), F.col("amount").alias("Amount"))).alias("request"), F.lit('{"CommitLSN":1}').alias("result"),
        )

    return decode_segments(encode_segments(log, written_out)).select("writer", "lsn", "kind", "key", "fingerprint", "request", "version")


QUERIES |= mixed.QUERIES
SQL |= mixed.SQL
