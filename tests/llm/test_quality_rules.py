import math
import random
import re
from collections import Counter

from ledgerweave.llm.quality_rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {p for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def text(r, n, vocab=500):
    return "".join(f"w{r.randrange(vocab)}é" + r.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(n))


def verdicts(rows, weight=200, reach=3.0):
    """kept by exact quartiles (the sketches are exact for so few texts), of groups drawn towards their languages and those towards all."""
    floors = ((1.5, True), (0.05, False), (0.15, False), (0.15, False))

    def measures(t):
        n, chars, symbols, dup, rep, failed = brute(t)
        lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
        return (chars / max(n, 1), symbols / max(n, 1), dup / max(lines, 1), rep / max(n, 1)), failed

    told = [(i, lang, source, *measures(t)) for i, t, lang, source in rows]

    def quartiles(use, up=None):
        out = []
        for k in range(4):
            x = sorted(m[k] for m in use)
            own = [x[max(0, math.ceil(q * len(x)) - 1)] for q in (0.25, 0.75)]
            out.append(own if up is None else [(a * len(x) + b * weight) / (len(x) + weight) for a, b in zip(own, up[k])])
        return out

    good = [(lang, source, m) for _, lang, source, m, failed in told if not failed]
    everything = quartiles([m for *_, m in good])
    out = {}
    for i, lang, source, m, failed in told:
        fence = everything
        if use := [x for a, _, x in good if a == lang]:
            fence = quartiles(use, fence)
            if use := [x for a, b, x in good if a == lang and b == source]:
                fence = quartiles(use, fence)
        ok = all(v <= q3 + max(reach * (q3 - q1), floor) and (not low or v >= q1 - max(reach * (q3 - q1), floor)) for v, (q1, q3), (floor, low) in zip(m, fence, floors))
        out[i] = ok and not failed
    return out


def test_few_texts_and_repeated_rows(spark):
    """The method also judges tables of a few texts; repeated rows count and are judged alike; a value on the fence stays."""
    r = random.Random(5)
    rows = [(i, text(r, 90), r.choice(["en", "de"]), r.choice(["s1", "s2", None])) for i in range(40)]
    rows += [(50 + k, "# ".join(f"w{k}" for k in range(100)), "en", "s1") for k in range(2)] + [rows[3]] * 6
    rows += [(60, " ".join(["abcdef#"] * 0 + [f"w{k}" for k in range(60)]), "xx", "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules(df).collect()
    assert len(got) == len(rows) and not any(x.kept for x in got if x.doc_id in (50, 51))
    assert {x.doc_id: x.kept for x in got} == verdicts(rows)


def test_counts_equal_brute_force_and_outliers_go(spark):
    r = random.Random(4)
    rows = [(i, text(r, r.choice([0, 1, 2, 3, 49, 50, 120, 300])), "en", "s1") for i in range(150)]
    rows += [(200 + i, text(r, 80, 3), None, "s2") for i in range(5)] + [(300, None, "en", None), (None, "a b a b a b", "de", "s1"), (301, "x\n\nx\nx \n", "en", "s1")]
    rows += [(400, "# ".join(f"w{k}" for k in range(200)), "en", "s1"), (401, " ".join("abcdefghijklmnopqrstuvwxyz" * 2 + str(k) for k in range(99)), "fr", "s9")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, source string, n_words int").repartition(4)
    got = quality_rules(df).collect()
    assert sorted((x.doc_id or -1, *tuple(x)[1:7]) for x in got) == sorted((i or -1, *brute(t)) for i, t, *_ in rows)
    by = {x.doc_id: x for x in got}
    assert not any(x.kept and x.base_failed for x in got)
    assert not by[400].kept and not by[400].base_failed and by[400].judged_by == "source"
    assert not by[401].kept and by[401].judged_by == "source" and by[200].judged_by == "all"
    assert {x.doc_id: x.kept for x in got if x.doc_id} == {i: k for i, k in verdicts(rows).items() if i}
    clean = [by[i] for i, t, *_ in rows[:150] if not brute(t)[-1]]
    assert sum(x.kept for x in clean) >= 0.98 * len(clean)
    assert quality_rules(df.limit(0)).collect() == []
