"""Line dedup by a segment-partition edit join, all in DataFrame functions.

Two lines are linked if they are equal, or within `threshold` edits of each
other and at least 0.8 alike (edits at most a fifth of the longer one's
characters, so lines under 5 characters are linked only to their copies).
Whatever such links connect is one class; of each class the first line
(smallest id, then smallest position) stays.

Of threshold + 1 segments of the shorter line of a pair, one is found whole in
the longer line near its own place, so lines meet on a hash of (length, number,
segment), each distinct line once.  Where few meet, pairs are kept if counts of
letters allow the distance.  Where many meet and the threshold is 1, pairs are
not made: those lines meet again on what they share of the rest but for one of
its three parts, and so on, and those that still crowd together in the end
differ in one place, where one line stands for all.  With a higher threshold a crowd's pairs are
dealt over tasks in tiles.  Every pair is verified on its texts: what lies
between the common beginning and end goes through a banded bit-parallel
automaton, a word of 2 * threshold + 1 diagonals per number of edits.

Copies are told apart by 128 bits of their SHA-256.

Nulls and special cases: null text has no lines; a line without a word stays,
as it parts paragraphs; a null id ranks after every number; repeated rows get
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerweave.llm._components import components
from ledgerweave.llm._store import Stored

NO_ID = 2**63 - 1
BLANKS = " \t\n\x0b\f\r"
#: Letters whose counts modulo 8 are compared before texts are; an edit changes two of them at most.
LETTERS = "etaoin"
#: Rows (at most 50 bytes each) that may be sent to every task; more are joined by a shuffle.
MOST_SENT = 500_000
#: Lines that meet on one segment and are paired; more meet again on longer parts.
PAIRED = 16
#: Rows of a crowd's tile where the threshold is above 1.
TILE = 1024
#: Classes with more lines than this, and more than this share of all lines, are joined without a shuffle: there are at most 4096.
HOT_LINES, HOT_SHARE = 4096, 4096
INDEX, PROBE, SHORTER = 0, 1, 2


def _print(text: Column) -> Column:
    return F.unhex(F.left(F.sha2(text, 256), F.lit(32)))


def _start(i: int, t: int, length: str) -> str:
    return f"(1 + {i} * ({length} div {t + 1}) + greatest(0, {i} - ({t + 1} - {length} % {t + 1})))"


def _size(i: int, t: int, length: str) -> str:
    return f"({length} div {t + 1} + if({i} >= {t + 1} - {length} % {t + 1}, 1, 0))"


def _keys(t: int) -> list[tuple[int, str]]:
    """(INDEX, PROBE or SHORTER, SQL of a hash over line and its length n, null where it doesn't fit).

    An INDEX key also probes for lines of its own length; PROBE is for those at another place, SHORTER for shorter lines.
    """
    out = []

    def key(i: int, less: int, shift: int, flag: int) -> None:
        length = f"(n - {less})" if less else "n"
        at = f"({_start(i, t, length)} + {shift})"
        size = _size(i, t, length)
        fits = f"n >= {5 * max(1, less)} and {at} >= 1 and {at} + {size} - 1 <= n" if flag else "n >= 4"
        out.append((flag, f"if({fits}, xxhash64({i}, {length}, substring(line, {at}, {size})), null)"))

    for i in range(t + 1):
        key(i, 0, 0, INDEX)
    for less in range(t + 1):
        for i in range(t + 1):
            # either the left or the right part has few edits, which bounds how far a segment has moved
            for shift in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1):
                if less or shift:
                    key(i, less, shift, SHORTER if less else PROBE)
    return out


def _bits(parts: list[str]) -> str:
    return " + ".join(parts)


def within(a: str, b: str, threshold: int) -> str:
    """SQL for: strings a and b, a not the longer, are within threshold edits and a fifth of b's characters."""
    t, mask = threshold, (1 << 2 * threshold + 1) - 1
    lengths = "sequence(20, 0, -1)"
    head = f"aggregate({lengths}, 0, (p, k) -> if(p + shiftleft(1, k) <= length({a}) and substring({a}, p + 1, shiftleft(1, k)) = substring({b}, p + 1, shiftleft(1, k)), p + shiftleft(1, k), p))"
    tail = f"aggregate({lengths}, 0, (p, k) -> if(p + shiftleft(1, k) <= length({{a}}) and substring({{a}}, length({{a}}) - p - shiftleft(1, k) + 1, shiftleft(1, k)) = substring({{b}}, length({{b}}) - p - shiftleft(1, k) + 1, shiftleft(1, k)), p + shiftleft(1, k), p))"
    same = _bits([f"if(i + {j - t} >= 0 and i + {j - t} < length(w.x) and substring(w.x, i + {j - t + 1}, 1) = substring(w.y, i + 1, 1), {1 << j}, 0)" for j in range(2 * t + 1)])
    new = ["(s[0] & m)"]
    for e in range(1, t + 1):
        new.append(f"((s[{e}] & m) | s[{e - 1}] | shiftright(s[{e - 1}], 1) | (shiftleft({new[-1]}, 1) & {mask}))")
    first = ", ".join(str(((1 << e + 1) - 1) << t & mask) for e in range(t + 1))
    # each step hands its value on through a one-element array, so that it is computed once
    rest = f"transform(array({head}), p -> named_struct('x', substring({a}, p + 1), 'y', substring({b}, p + 1)))"
    core = f"transform(transform({rest}, v -> named_struct('v', v, 'q', {tail.format(a='v.x', b='v.y')})), u -> named_struct('x', left(u.v.x, length(u.v.x) - u.q), 'y', left(u.v.y, length(u.v.y) - u.q)))"
    steps = f"transform(if(length(w.y) = 0, cast(array() as array<int>), sequence(0, length(w.y) - 1)), i -> {same})"
    final = f"aggregate({steps}, array({first}), (s, m) -> array({', '.join(new)}))"
    return f"exists({core}, w -> abs(length(w.y) - length(w.x)) <= {t} and shiftright({final}[least({t}, length({b}) div 5)], length(w.x) - length(w.y) + {t}) & 1 = 1)"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rank and print of the document, pos and text of each line with a word, and its id and length n."""
    text = F.col(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rank"), _print(text).alias("print"), F.split(text, "\n").alias("_lines"))
    rows = rows.select("rank", "print", F.posexplode("_lines").alias("pos", "line"))
    return rows.where(F.ltrim("line", F.lit(BLANKS)) != "").withColumn("id", _print(F.col("line"))).withColumn("n", F.length("line"))


def _allowed(threshold: int) -> str:
    """SQL for: the letter counts ma and mb differ by no more than threshold edits can make them.

    An edit takes one letter away, puts one in, or both.
    """
    differ = [f"((((shiftright(ma, {3 * k}) & 7) - (shiftright(mb, {3 * k}) & 7) + 12) & 7) - 4)" for k in range(len(LETTERS))]
    changes = f"{' + '.join(f'abs({d})' for d in differ)} <= {2 * threshold}"
    return f"{changes} and abs({' + '.join(differ)}) <= {threshold}" if threshold < 4 else changes  # modulo 8, larger changes have no sign


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def _meetings(keyed: DataFrame) -> DataFrame:
    """The rows (id, flag, h) that meet on h a line they may be linked to, with c, the number that meet there."""
    busy = keyed.groupBy("h").agg(F.count("*").alias("c"), F.count_if(F.col("flag") == INDEX).alias("i")).where("c > 1 and i > 0").drop("i")
    return Stored(keyed.join(_sent(Stored(busy, "line-busy").df), "h"), "line-meetings").df


def _pairs(met: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a not the longer, of met rows (h, id, flag, m) that letter counts allow; of a tile only, where tiles are told."""
    on = ["h", "tile"] if "tile" in met.columns else ["h"]
    b_rows = met
    if "tile" in met.columns:
        b_rows = met.withColumn("tile", F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / TILE).cast("int"))))
    a = met.where(F.col("flag") == INDEX).select(*on, F.col("id").alias("a"), F.col("m").alias("ma"))
    b = b_rows.select(*on, F.col("id").alias("b"), F.col("m").alias("mb"), "flag")
    near = F.expr(_allowed(threshold)) & (F.col("a") != F.col("b")) & ((F.col("flag") == SHORTER) | (F.col("a") < F.col("b")) | (F.col("flag") == PROBE))
    return a.join(b, on).where(near).select("a", "b")


def _parts(k: int) -> str:
    """SQL of an array of (h, part): what two lines that differ in part alone share besides each of its k segments, and that segment.

    Of a SHORTER row, part has a character more than in the rows it probes for.
    """
    r = "(length(part) - more)"
    k = f"least({k}, {r})"
    start = f"(j * ({r} div {k}) + greatest(0, j - ({k} - {r} % {k})))"
    size = f"({r} div {k} + if(j >= {k} - {r} % {k}, 1, 0))"
    return f"transform(sequence(0, {k} - 1), j -> named_struct('h', xxhash64(h, {r}, j, left(part, {start}), right(part, {r} - {start} - {size})), 'part', substring(part, {start} + 1, {size} + more)))"


#: SQL of an array of (f, h) for rows whose part is at most one character: what meets an equal line, a line with one more, and any other in that place.
ENDS = f"""if(more = 0, array(named_struct('f', {INDEX}, 'h', xxhash64(h, part)), named_struct('f', {PROBE}, 'h', h)),
  transform(sequence(1, length(part)), j -> named_struct('f', {SHORTER}, 'h', xxhash64(h, concat(left(part, j - 1), right(part, length(part) - j))))))"""


def _crowd_pairs(rows: DataFrame, parts: int = 3) -> list[DataFrame]:
    """Pairs (a, b) for a threshold of 1 among rows (h, id, flag, m, part) that share all but their parts; not all, but enough to connect what is linked."""
    out = []
    rows = Stored(rows, "line-crowd").df
    while rows.count():
        rows = rows.withColumn("more", F.when(F.col("flag") == SHORTER, 1).otherwise(0))
        ends = rows.where("length(part) - more <= 1").select("id", F.expr(f"inline({ENDS})")).distinct()
        # one line may stand for all that differ in this place alone, or that have one character more
        center = ends.groupBy("h").agg(F.coalesce(F.max(F.when(F.col("f") == INDEX, F.col("id"))), F.min(F.when(F.col("f") == PROBE, F.col("id")))).alias("a"), F.count("*").alias("c"))
        out.append(ends.join(center.where("c > 1 and a is not null"), "h").where("a != id").select("a", F.col("id").alias("b")))
        met = _meetings(rows.where("length(part) - more > 1").select("id", "flag", "m", F.expr(f"inline({_parts(parts)})")))
        out.append(_pairs(met.where(F.col("c") <= PAIRED), 1))
        rows = Stored(met.where(F.col("c") > PAIRED).drop("c"), "line-crowd").df
    return out


def line_links(distinct: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) between ids that connect what is linked; distinct(id, n, k0, k1, ...) has each line once, lines(id, n, line) its text at least once."""
    keys = ", ".join(f"named_struct('flag', {f}, 'key', {k}, 'h', k{k})" for k, (f, _) in enumerate(_keys(threshold)))
    keyed = distinct.select("id", F.expr(f"inline(array({keys}))")).where("h is not null")
    met = _meetings(keyed)
    counts = _bits([f"shiftleft((octet_length(line) - octet_length(replace(line, '{c}', ''))) & 7, {3 * k})" for k, c in enumerate(LETTERS)])
    ids = Stored(met.select("id").distinct(), "line-ids").df
    texts = Stored(lines.select("id", "n", "line").join(_sent(ids), "id", "left_semi").dropDuplicates(["id"]).withColumn("m", F.expr(counts)), "line-texts").df
    met = Stored(met.join(texts.select("id", "m"), "id"), "line-met").df
    parts = [_pairs(met.where(F.col("c") <= PAIRED), threshold)]
    crowds = met.where(F.col("c") > PAIRED)
    if threshold == 1:
        half = f"((n - if(flag = {SHORTER}, 1, 0)) div 2)"  # keys by turns share the first and the second half
        part = F.expr(f"if(key % 2 = 0, substring(line, {half} + 1), left(line, n - (n - if(flag = {SHORTER}, 1, 0) - {half})))")
        parts += _crowd_pairs(crowds.drop("m").join(texts, "id").select("h", "id", "flag", "m", part.alias("part")))
    else:
        parts.append(_pairs(crowds.withColumn("tile", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / TILE) + 1).cast("int")), threshold))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionAll(p)
    pairs = Stored(pairs.distinct(), "line-pairs").df
    texts = texts.select("id", "line", "n")
    both = pairs.join(texts.toDF("a", "xa", "na"), "a").join(texts.toDF("b", "xb", "nb"), "b")
    both = both.select("a", "b", F.expr("if(na <= nb, xa, xb)").alias("x"), F.expr("if(na <= nb, xb, xa)").alias("y"))
    return both.where(F.expr(within("x", "y", threshold))).select("a", "b")


def removals(docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """rank, print, gone (positions of lines that go) and kept_in (ids of the documents in which their classes stay)."""
    lines = _lines(docs, id_col, text_col)
    keys = [F.expr(e).alias(f"k{k}") for k, (_, e) in enumerate(_keys(threshold))]
    at = Stored(lines.select("rank", "print", "pos", "id", "n", *keys), "line-places").df
    first = at.groupBy("id").agg(F.min(F.struct("rank", "print", "pos")).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), *(F.max(f"k{k}").alias(f"k{k}") for k in range(len(keys))))
    first = Stored(first, "line-classes").df
    roots = Stored(components(line_links(first, lines, threshold)).toDF("id", "root"), "line-roots").df
    member = Stored(roots.unionAll(roots.select(F.col("root").alias("id"), "root").distinct()), "line-members").df
    linked = Stored(first.select("id", "first", "copies").join(_sent(member), "id"), "line-linked").df
    classes = Stored(linked.groupBy("root").agg(F.min("first").alias("kept")), "line-first").df
    told = linked.join(_sent(classes), "root").select("id", "kept", "copies")
    alone = first.where("copies > 1").select("id", F.col("first").alias("kept"), "copies").join(_sent(member.select("id")), "id", "left_anti")
    kept = Stored(told.unionAll(alone), "line-kept").df
    hot = max(HOT_LINES, at.count() // HOT_SHARE)
    at = at.select("rank", "print", "pos", "id")
    hot_ids = F.broadcast(kept.where(F.col("copies") > hot).drop("copies"))  # at most HOT_SHARE rows
    common = at.join(hot_ids, "id")
    rest = at.join(hot_ids.select("id"), "id", "left_anti").join(kept.where(F.col("copies") <= hot).drop("copies"), "id")
    gone = common.unionAll(rest).where("struct(rank, print, pos) != kept")
    gone = gone.select("rank", "print", "pos", F.when(F.col("kept.rank") != NO_ID, F.col("kept.rank")).alias("in"))
    return gone.groupBy("rank", "print").agg(F.collect_set("pos").alias("gone"), F.sort_array(F.collect_set("in")).alias("kept_in"))


def _kept(docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """The rows of docs as struct `_row`, with `gone`, `kept_in` and the text that is left in `_kept`."""
    gone = removals(docs, id_col, text_col, threshold)
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rank"), _print(F.col(text_col)).alias("print"))
    out = rows.join(gone, ["rank", "print"], "left").withColumn("_lines", F.when(F.col("gone").isNotNull(), F.split(f"_row.`{text_col}`", "\n")))
    # sorted by position, a mark of a line that goes stands right before that line
    marks = "sort_array(concat(transform(_lines, (x, i) -> named_struct('p', i, 'line', true, 'x', x)), transform(gone, g -> named_struct('p', g, 'line', false, 'x', cast(null as string)))))"
    out = out.withColumn("_marked", F.when(F.col("gone").isNotNull(), F.expr(marks)))
    left = F.expr("transform(filter(_marked, (m, i) -> m.line and (i = 0 or _marked[i - 1].line)), m -> m.x)")
    return out.withColumn("_kept", F.when(F.col("gone").isNull(), F.col(f"_row.`{text_col}`")).otherwise(F.array_join(left, "\n")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 1) -> DataFrame:
    """The id, n_lines, n_removed, kept_sha256, kept_in and, as `kept_text`, the lines that stay."""
    out = _kept(docs, id_col, text_col, threshold)
    text = F.col(f"_row.`{text_col}`")
    return out.select(
        F.col(f"_row.`{id_col}`").alias(id_col),
        F.when(text.isNull(), F.lit(0)).otherwise(1 + F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"),
        F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"),
        F.col("_kept").alias("kept_text"),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 1, chars_col: str = "n_chars") -> DataFrame:
    """docs, all rows and columns, with the text cut to the lines that stay (null stays null) and its length renewed where there is one."""
    out = _kept(docs, id_col, text_col, threshold)
    cols = []
    for f in docs.schema.fields:
        if f.name == text_col:
            cols.append(F.col("_kept").alias(text_col))
        elif f.name == chars_col:
            cols.append(F.when(F.col("gone").isNull(), F.col(f"_row.{chars_col}")).otherwise(F.length("_kept")).cast(f.dataType).alias(chars_col))
        else:
            cols.append(F.col(f"_row.`{f.name}`").alias(f.name))
    return out.select(*cols)
