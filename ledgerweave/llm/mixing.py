"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves of a tree (domain, language, source).  What a node can
give is the sum of its leaves' tokens times the epochs allowed.  The budget is
handed down from the root: among siblings by weight, and what one cannot use
goes to its siblings by weight (a common fill level, in closed form); only
what a whole subtree cannot use reaches the siblings of its parent.  A leaf
takes whole epochs and then a prefix of the next one, in an order seeded by
the epoch, up to the first document that reaches its budget.

No group is ever sorted as a whole: a leaf's order is cut into ranges of its
sort key, ranges are summed, and only the range that holds the end of the
prefix is walked.

Nulls and special cases: a null domain, language or source is a group of its
own; null text has no tokens and is taken with the prefix that it falls in;
documents that tie in the order are taken together or not at all; a null id
ties with other null ids; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerweave.llm._store import Stored

LEVELS = ("domain", "lang", "source")
#: Sources fall into domains by the number in their name.
_NUMBER = "try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)"
DOMAIN = f"case {_NUMBER} % 4 when 0 then 'web' when 1 then 'books' when 2 then 'code' else 'forum' end"
#: Weight of a name among its siblings, by level; others have weight 1.
WEIGHTS = {"domain": {"web": 2.0, "books": 4.0}, "lang": {"en": 4.0}, "source": {"src0": 0.5}}
#: Hex digits of the sort key that name a range.
RANGE_DIGITS = 3


def _named(c: Column) -> Column:
    """A group's name; null is a name that no value has."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == f"={name}", F.lit(float(w))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict, epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens) with `budget`: tokens to take from each."""
    caps = leaves.withColumn("cap", F.col("tokens").cast("double") * epochs)
    given = caps.agg(budget.alias("budget"))
    for depth, level in enumerate(LEVELS):
        keys = LEVELS[: depth + 1]
        up = Window.partitionBy(*LEVELS[:depth])
        order = up.orderBy("ratio", level)
        nodes = caps.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        nodes = nodes.join(given, list(LEVELS[:depth])) if depth else nodes.crossJoin(F.broadcast(given))  # one row
        nodes = nodes.withColumn("ratio", F.col("cap") / F.col("w"))
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("f", (F.col("budget") - before) / rest)
        given = nodes.withColumn("budget", F.least("cap", F.col("w") * F.max("f").over(up))).select(*keys, "budget")
    return leaves.join(given, list(LEVELS))


def mix(docs: DataFrame, share: float = 0.5, epochs: int = 2, seed: int = 17, weights: dict = WEIGHTS, domain: str = DOMAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, domain, lang, source, n_tokens and copies (0 if it isn't taken); the budget is `share` of all tokens."""
    rows = docs.select(
        F.col(id_col).alias("_id"), _named(F.expr(domain)).alias("domain"), _named(F.col("lang")).alias("lang"), _named(F.col("source")).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long").alias("n_tokens"),
    )
    rows = Stored(rows, "mixing").df  # read three times, without texts
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaf_budgets(leaves, F.floor(F.sum("tokens") * F.lit(share)).cast("double"), weights, epochs)
    tokens = F.greatest("tokens", F.lit(1))
    leaves = leaves.select(*LEVELS, F.floor(F.col("budget") / tokens).alias("full"), (F.col("budget") - F.floor(F.col("budget") / tokens) * tokens).alias("left"))
    rows = rows.join(leaves, list(LEVELS)).withColumn("key", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("null")))))
    rows = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sums = rows.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.select(*LEVELS, "range", before.alias("before"), (before + F.col("sum")).alias("upto"))
    placed = rows.join(ranges, [*LEVELS, "range"])
    # the one range of each leaf in which the prefix ends is walked; those before it are whole
    whole = placed.where("upto <= left or before >= left").withColumn("taken", F.col("before") < F.col("left"))
    part = placed.where("upto > left and before < left")
    walk = Window.partitionBy(*LEVELS, "range")
    upto = F.col("before") + F.sum("n_tokens").over(walk.orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("taken", upto - F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "range", "key")) < F.col("left"))
    shown = [F.when(F.col(c) != "-", F.substring(F.col(c), 2, 1 << 30)).alias(c) for c in LEVELS]
    return whole.unionByName(part).select(F.col("_id").alias(id_col), *shown, "n_tokens", (F.col("full") + F.col("taken").cast("long")).cast("long").alias("copies"))


def _sql(share: float = 0.5, epochs: int = 2, seed: int = 17) -> str:
    """The same in SQL."""
    ctes = []
    for depth, level in enumerate(LEVELS):
        keys, up = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        part = f"partition by {up}" if up else ""
        w = "1.0::double"
        for name, x in WEIGHTS[level].items():
            w = f"case when {level} = '={name}' then {x}::double else {w} end"
        source = f"join b{depth - 1} using ({up})" if up else f"cross join (select floor(sum(tokens) * {share}::double) as budget from leaves)"
        ctes.append(f"""n{level} as (
  select {keys}, sum(cap) as cap, {w} as w from leaves group by {keys}
), f{level} as (
  select n{level}.*, budget, (budget - coalesce(sum(cap) over ({part} order by cap / w, {level} rows between unbounded preceding and 1 preceding), 0))
         / sum(w) over ({part} order by cap / w, {level} rows between current row and unbounded following) as f
  from n{level} {source}
), b{depth} as (
  select {keys}, least(cap, w * max(f) over ({part})) as budget from f{level}
)""")
    return rf"""
with docs as (
  select doc_id, coalesce('=' || ({DOMAIN}), '-') as domain, coalesce('=' || lang, '-') as lang, coalesce('=' || source, '-') as source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens
  from documents
), leaves as (
  select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens, cast(sum(n_tokens) as double) * {epochs} as cap from docs group by all
), {", ".join(ctes)},
ends as (
  select domain, lang, source, cast(floor(budget / greatest(tokens, 1)) as bigint) as fully, budget - floor(budget / greatest(tokens, 1)) * greatest(tokens, 1) as rest
  from leaves join b{len(LEVELS) - 1} using (domain, lang, source)
), keyed as (
  select docs.*, fully, rest, md5('{seed}/' || fully || '/' || coalesce(cast(doc_id as varchar), 'null')) as k from docs join ends using (domain, lang, source)
), walked as (
  select *, sum(n_tokens) over (partition by domain, lang, source order by k range between unbounded preceding and current row)
            - sum(n_tokens) over (partition by domain, lang, source, k) as before
  from keyed
)
select doc_id, case when domain <> '-' then substr(domain, 2) end as domain, case when lang <> '-' then substr(lang, 2) end as lang,
       case when source <> '-' then substr(source, 2) end as source, cast(n_tokens as bigint) as n_tokens,
       cast(fully + (before < rest)::int as bigint) as copies
from walked
"""


SQL = _sql()
