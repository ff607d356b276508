"""Quality rules with adaptive thresholds, all in DataFrame functions.

Fixed cutoffs fail texts outright.  The others are set for each language and
source from mergeable KLL quantile sketches of each measure: a text is kept if
every measure lies within its group's fences, the quartiles widened by `reach`
times the distance between them and never narrower than `floor` (so a group
whose texts are all alike doesn't fail one that differs slightly).  Quartiles of
a group are drawn towards its language's, and those towards all texts', as if
`weight` texts more had the parent's, so that small groups don't set fences of
their own and no size switches the method.  A group none of whose texts passes
the fixed cutoffs takes its parent's.

Nulls and special cases: null text has no words and fails; null language or
source is a group of its own; a null id stays null; repeated rows count and are
judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerweave.llm._store import Stored

#: Measure -> narrowest distance of a fence from its quartile, and whether low values fail too.
MEASURES = {
    "mean_word_chars": (1.5, True),
    "symbol_share": (0.05, False),
    "dup_line_share": (0.15, False),
    "repeat_share": (0.15, False),
}
BLANKS = " \t\n\x0b\f\r"


def _fn(sql: str) -> Column:
    return F.expr(sql)


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and scratch columns that begin with `_`.

    Repeated windows are found by sorting longs that hold a window's hash above
    its position: equal hashes then stand side by side, and the full hashes at
    the two positions decide.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_text", text)
    df = df.withColumn("_words", F.filter(F.split("_text", r"[ \t-\r]+"), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.translate("_text", BLANKS, "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn(
        "_hashes",
        _fn("if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))"),
    )
    df = df.withColumn("_bits", _fn("length(bin(n_words))"))
    df = df.withColumn("_sorted", _fn("sort_array(transform(_hashes, (h, i) -> shiftleft(shiftright(h, _bits), _bits) | i))"))
    same = "shiftright(x, _bits) = shiftright({y}, _bits) and _hashes[cast(x & (shiftleft(1L, _bits) - 1) as int)] = _hashes[cast({y} & (shiftleft(1L, _bits) - 1) as int)]"
    found = f"filter(_sorted, (x, i) -> (i > 0 and {same.format(y='_sorted[i - 1]')}) or (i < size(_sorted) - 1 and {same.format(y='_sorted[i + 1]')}))"
    df = df.withColumn("_at", _fn(f"sort_array(transform({found}, x -> x & (shiftleft(1L, _bits) - 1)))"))
    df = df.withColumn(
        "n_repeat_words",
        _fn("aggregate(transform(_at, (x, i) -> if(i = size(_at) - 1, 3L, least(3L, _at[i + 1] - x))), 0L, (s, x) -> s + x)"),
    )
    return df


def measured(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """The columns of docs (as one struct `_row`), the base counts, base_failed and the measures."""
    df = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_in"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    df = base_counts(df, "_in")
    df = df.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    n = F.greatest("n_words", F.lit(1))
    lines = F.greatest(F.size("_lines"), F.lit(1))
    df = df.select(
        "_row", "_lang", "_source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (F.col("word_chars") / n).alias("mean_word_chars"), (F.col("n_symbols") / n).alias("symbol_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"), (F.col("n_repeat_words") / n).alias("repeat_share"),
    )
    return df


def thresholds(df: DataFrame, reach: float, weight: float, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fences by language and source, by language, and overall: sketches of the first are merged into the others."""
    good = df.where(~F.col("base_failed"))
    sketches = good.groupBy("_lang", "_source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, k).alias(m) for m in MEASURES))
    names = [f"{m}_{q}" for m in MEASURES for q in (25, 75)]

    def quartiles(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, "n", *(F.kll_sketch_get_quantile_double(m, F.lit(q / 100)).alias(f"{m}_{q}") for m in MEASURES for q in (25, 75)))

    def merged(*keys: str) -> DataFrame:
        return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m).alias(m) for m in MEASURES))

    def drawn(df: DataFrame, parent: DataFrame, *keys: str) -> DataFrame:
        up = parent.select(*(F.col(c).alias(f"up_{c}") for c in parent.columns))
        both = df.join(up, df["_lang"].eqNullSafe(up["up__lang"])) if "_lang" in parent.columns else df.crossJoin(up)  # one row
        return both.select(*keys, "n", *((F.col(c) * (F.col("n") / (F.col("n") + weight)) + F.col(f"up_{c}") * (weight / (F.col("n") + weight))).alias(c) for c in names))

    def fences(df: DataFrame, *keys: str) -> DataFrame:
        out = [*keys]
        for m, (floor, low) in MEASURES.items():
            q1, q3 = F.col(f"{m}_25"), F.col(f"{m}_75")
            wide = F.greatest(reach * (q3 - q1), F.lit(floor))
            out += [(q1 - wide if low else F.lit(None).cast("double")).alias(f"{m}_low"), (q3 + wide).alias(f"{m}_high")]
        return df.select(*out)

    overall = quartiles(merged().where("n is not null"))
    by_lang = drawn(quartiles(merged("_lang"), "_lang"), overall, "_lang")
    near = drawn(quartiles(sketches, "_lang", "_source"), by_lang, "_lang", "_source")
    return fences(near, "_lang", "_source"), fences(by_lang, "_lang"), fences(overall)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: float = 3.0, weight: float = 200.0, k: int = 400, **cutoffs) -> DataFrame:
    """The id, base counts, base_failed, kept, and the measures with the fences that judged them."""
    stored = Stored(measured(docs.select(*dict.fromkeys([id_col, text_col, lang_col, source_col])), text_col, lang_col, source_col, **cutoffs).select(F.col(f"_row.{id_col}").alias("_id"), "*").drop("_row"), "measures").df
    near, by_lang, overall = thresholds(stored, reach, weight, k)
    cols = [f"{m}_{s}" for m in MEASURES for s in ("low", "high")]
    out = stored
    for tag, df, keys in (("a", near, ["_lang", "_source"]), ("b", by_lang, ["_lang"]), ("c", overall, [])):
        df = df.select(*(F.col(c).alias(f"{tag}_{c}") for c in keys), F.struct(*cols).alias(tag))
        on = [out[c].eqNullSafe(df[f"{tag}_{c}"]) for c in keys]
        cond = on[0] if on else F.lit(True)
        for c in on[1:]:
            cond = cond & c
        out = out.join(df, cond, "left").drop(*(f"{tag}_{c}" for c in keys))
    fence = F.coalesce("a", "b", "c")
    verdict = F.lit(True)
    for m in MEASURES:
        verdict = verdict & F.coalesce(F.col(m) >= fence[f"{m}_low"], F.lit(True)) & F.coalesce(F.col(m) <= fence[f"{m}_high"], F.lit(True))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & verdict).alias("kept"), *MEASURES,
        F.when(F.col("a").isNotNull(), "source").when(F.col("b").isNotNull(), "language").otherwise("all").alias("judged_by"),
    )
