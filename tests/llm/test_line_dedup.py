import hashlib
import random

from ledgerweave.llm import line_dedup as ld


def distance(a, b, most=10**9):
    """Edit distance, or anything above `most`."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            break
    return row[-1] if min(row) <= most else most + 1


def edited(r, line, k):
    for _ in range(k):
        at = r.randrange(len(line) + 1)
        line = r.choice([line[:at] + r.choice("abé ") + line[at:], line[:at] + line[at + 1 :], line[:at] + r.choice("xyñ") + line[at + 1 :]])
    return line


def sample(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé ") for _ in range(r.randrange(8, 40))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [edited(r, r.choice(base), r.choice([0, 0, 1, 1, 2, 3])) if r.random() < 0.7 else "".join(r.choice("fghi j") for _ in range(r.randrange(0, 30))) for _ in range(r.randrange(1, 6))]
        rows.append((i * 7 % 61, "\n".join(lines)))
    return rows + [(200, None), (201, ""), (202, rows[3][1]), (203, rows[3][1]), (203, rows[3][1]), (None, rows[4][1]), (204, "\n\n" + base[0] + "\n" + base[0])]


def brute(rows, threshold):
    rank = lambda i: 2**63 if i is None else i
    word = lambda x: x.strip(" \t\n\x0b\f\r") != ""
    lines = sorted({x for _, t in rows if t is not None for x in t.split("\n") if word(x)})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            most = min(threshold, max(len(a), len(b)) // 5)
            if abs(len(a) - len(b)) <= most and distance(a, b, most) <= most:
                root[find(a)] = find(b)
    first = {}
    where = [(rank(i), t, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if word(x)]
    for i, t, k, x in where:
        c = find(x)
        first[c] = min(first.get(c, (2**64, "", 0)), (i, t, k), key=lambda z: (z[0], z[2]) if z[1] == t else (z[0], 0))
    out = []
    for i, t in rows:
        all_lines = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(all_lines) if not word(x) or first[find(x)] == (rank(i), t, k)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, threshold):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rank int, line string").repartition(4)
    got = ld.line_dedup(df, threshold=threshold)
    assert sorted((tuple(x)[:4] for x in got.collect()), key=str) == brute(rows, threshold)


def test_equals_brute_force(spark):
    for seed, threshold in ((1, 1), (2, 2), (3, 3)):
        check(spark, sample(seed), threshold)


def test_short_lines(spark):
    r = random.Random(4)
    rows = [(i, "\n".join("".join(r.choice("ab é\t") for _ in range(r.randrange(0, 9))) for _ in range(8))) for i in range(80)]
    check(spark, rows, 1)


def test_crowds_and_hot_lines(spark, monkeypatch):
    """Hundreds of variants of one line, which share a half, and copies joined as hot lines."""
    monkeypatch.setattr(ld, "HOT_LINES", 3)
    monkeypatch.setattr(ld, "HOT_SHARE", 10**9)
    monkeypatch.setattr(ld, "TILE", 16)
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(45))
    lines = [edited(r, base, r.choice([0, 1, 1, 2, 3])) for _ in range(150)]
    # one character at one place takes many values, and nothing but that place links these
    lines += [base[:20] + chr(0x4E00 + k) + base[23:] for k in range(40)] + [base[:20] + chr(0x4E00 + k) * 3 + base[23:] for k in range(40)]
    lines += ["x" + base[1:22] + "y" + base[26:]] * 7
    rows = [(i, x) for i, x in enumerate(lines)]
    check(spark, rows, 1)
    check(spark, rows, 2)


def test_very_long_line(spark):
    r = random.Random(8)
    base = "".join(r.choice("abcdefgh ") for _ in range(60000))
    lines = [base, base[:30000] + "!" + base[30000:], base[:59990] + base[59991:], base[:7] + "?" + base[8:], base[:7] + "??" + base[9:]]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in ld.line_dedup(df).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}  # the last is one edit from the fourth


def test_distance_automaton(spark):
    r = random.Random(9)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abé") for _ in range(r.randrange(0, 30)))
        b = edited(r, a, r.randrange(0, 6))
        pairs.append((a, b) if len(a) <= len(b) else (b, a))
    df = spark.createDataFrame(pairs, "x string, y string")
    for t in (1, 2, 3):
        from pyspark.sql import functions as F

        got = [v[0] for v in df.select(F.expr(ld.within("x", "y", t))).collect()]
        assert got == [distance(a, b) <= min(t, len(b) // 5) for a, b in pairs]


def test_rows_columns_and_empty(spark):
    rows = [(1, "a long enough line here\nb", 25, None), (2, "a long enough line hero\nc\n", 26, "k"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, gone string")
    got = {x.doc_id: tuple(x) for x in ld.drop_lines(df).collect()}
    assert got == {1: rows[0], 2: (2, "c\n", 2, "k"), 3: rows[2]}
    assert ld.drop_lines(df).columns == df.columns
    assert ld.line_dedup(df).where("doc_id = 2").first().kept_in == [1]
    assert ld.line_dedup(df.limit(0)).collect() == []
