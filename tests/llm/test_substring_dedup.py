import hashlib
import random
import re

from ledgerweave.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    rank = lambda i: 2**63 if i is None else i
    for i, w in split:
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, rank(i)), rank(i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < rank(i):
                gone.update(range(k, k + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def sample(seed):
    r = random.Random(seed)
    words = ["a", "bb", "ccc", "é", "dé", "x,", "Y.", "z z"] + [f"w{k}" for k in range(300)]
    passages = [[r.choice(words) for _ in range(r.choice([13, 14, 20, 40]))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = [r.choice(words) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w) + 1)
            w[k:k] = r.choice(passages)
        rows.append((i * 3 % 61, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (None, rows[5][1]), (104, " ".join(["same"] * 50)), (105, " ".join(["same"] * 30))]
    return rows


def test_equals_brute_force(spark):
    for seed in range(2):
        rows = sample(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted((tuple(x) for x in substring_dedup(df).collect()), key=str)
        assert got == brute(rows, 13)


def test_other_period_names_and_empty(spark):
    rows = [(1, "q " * 3 + "a b c d e"), (2, "z a b c d e f")]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "n long, body string, rank int, print string")
    got = substring_dedup(df, "n", "body", length=5, period=3, with_text=True).collect()
    assert sorted((x.n, x.kept_text) for x in got) == [(1, "q q q a b c d e"), (2, "z f")]
    assert substring_dedup(df.limit(0), "n", "body").collect() == []
