"""Stateless checks of operations, as columns.  Each check gives an error code or null, in a fixed order of precedence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerweave.plans.schema import CANCELLED, MAX_INT64


def _text(c: Column, most: int) -> Column:
    """1 to `most` bytes of valid UTF-8; null is not."""
    return F.coalesce(F.octet_length(c).between(1, most) & F.is_valid_utf8(c), F.lit(False))


def valid_key(c: Column) -> Column:
    return _text(c, 256)


def valid_account_id(c: Column) -> Column:
    return _text(c, 128)


valid_hold_id = valid_account_id


def valid_currency(c: Column) -> Column:
    """Exactly three capital letters; a line break after them doesn't pass."""
    return F.coalesce(c.rlike(r"\A[A-Z]{3}\z"), F.lit(False))


def first_error(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that holds."""
    out = None
    for bad, code in checks:
        out = F.when(bad, code) if out is None else out.when(bad, code)
    return out


def create_error(account_id: Column, currency: Column, opening: Column) -> Column:
    return first_error((~valid_account_id(account_id), "INVALID_ACCOUNT_ID"), (~valid_currency(currency), "INVALID_CURRENCY"), (F.coalesce(opening < 0, F.lit(True)), "INVALID_OPENING_BALANCE"))


def pair_shape_error(source: Column, target: Column, amount: Column) -> Column:
    return first_error(
        (~valid_account_id(source), "INVALID_ACCOUNT_ID"), (~valid_account_id(target), "INVALID_ACCOUNT_ID"),
        (source == target, "SAME_ACCOUNT"), (F.coalesce(amount <= 0, F.lit(True)), "INVALID_AMOUNT"),
    )


def shape_error(c=F.col) -> Column:
    """What is wrong with a row of `ops` by itself: given up, then the key, then the request."""
    kind, hold = c("kind"), ~valid_hold_id(c("hold_id"))
    pair = pair_shape_error(c("from_account"), c("to_account"), c("amount"))
    request = (
        F.when(kind == "create_account", create_error(c("account_id"), c("currency"), c("opening_balance")))
        .when(kind == "transfer", pair)
        .when(kind == "reserve", F.when(hold, "INVALID_HOLD_ID").otherwise(pair))
        .when(kind == "settle", first_error((hold, "INVALID_HOLD_ID"), (F.coalesce(c("amount") < 0, F.lit(True)), "INVALID_AMOUNT")))
        .when(kind == "cancel", F.when(hold, "INVALID_HOLD_ID"))
    )
    return F.when(F.coalesce(c("cancelled"), F.lit(False)), CANCELLED).when(~valid_key(c("key")), "INVALID_IDEMPOTENCY_KEY").otherwise(request)


def pair_error(from_currency: Column, to_currency: Column) -> Column:
    """Of a pair looked up in the accounts (null where there is none)."""
    return first_error((from_currency.isNull() | to_currency.isNull(), "ACCOUNT_NOT_FOUND"), (from_currency != to_currency, "CURRENCY_MISMATCH"))


def funds_error(balance: Column, reserved: Column, to_balance: Column, amount: Column) -> Column:
    """Available funds first, then room on the other side; written so that nothing overflows."""
    return first_error((balance - reserved < amount, "INSUFFICIENT_FUNDS"), (overflows(to_balance, amount), "BALANCE_OVERFLOW"))


def overflows(balance: Column, amount: Column) -> Column:
    return balance > F.lit(MAX_INT64) - amount


def available(balance: Column, reserved: Column) -> Column:
    return balance - F.coalesce(reserved, F.lit(0).cast("long"))
