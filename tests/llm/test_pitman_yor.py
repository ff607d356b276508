import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np

from ledgerweave.llm import pitman_yor as py

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["\0end"]


def sample(seed, n=160):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "a,"] + [f"w{k}" for k in range(60)]
    # words follow each other by rule more often than not
    rows = []
    for i in range(n):
        at, out = r.randrange(66), []
        for _ in range(r.choice([0, 1, 5, 80, 200])):
            at = (at * 7 + 3) % 66 if r.random() < 0.7 else r.randrange(66)
            out.append(words[at])
        rows.append((i, r.choice([" ", "\n", " \t"]).join(out)))
    return rows + [(n, None), (n + 1, ""), (n + 2, rows[4][1]), (None, "the of"), rows[3], (n + 3, "never seen words 1 2 3")]


def fold(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 10


def base(rows):
    c = Counter(x for i, t in rows if fold(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(i, fold(i) == 0, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) for i, t in rows]


def test_base_columns_and_better_than_base(spark):
    rows = sample(1)
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, train boolean").repartition(4)
    got = py.score_texts(df)
    out = got.collect()
    n, want = base(rows)
    key = lambda x: str(x[:4])
    for g, w in zip(sorted((tuple(x) for x in out), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == n and abs(g[5] - w[4]) < 1e-6
    assert all(x.score < 0 for x in out)
    by = {x.held_out: x for x in py.perplexity(got).collect()}
    assert all(x.perplexity < 0.2 * x.base_perplexity for x in by.values())
    again = {x.doc_id: x.score for x in py.score_texts(df).collect()}
    assert all(again[x.doc_id] == x.score for x in out)
    assert py.score_texts(df.limit(0)).collect() == []
    alone = py.score_texts(df.where("doc_id is null")).collect()  # nothing to learn from
    assert [(x.n_known, x.train_tokens) for x in alone] == [(0, 0)] and alone[0].score == 0


def test_probabilities_sum_to_one():
    # all words after one context, with an unknown one: the parent's and the context's probabilities
    rng = np.random.default_rng(3)
    count = np.array([300, 40, 7, 3, 2, 2, 1, 1, 0, 0], dtype=np.int64)
    customers, tables = np.array([30.0, 9, 4, 2, 1, 1, 1, 1, 2, 1]), np.array([2.0, 1, 1, 1, 1, 1, 1, 1, 1, 1])
    parent = (customers - 0.8 * tables + (1 + 0.8 * tables.sum()) / 11) / (1 + customers.sum())
    unknown = (1 + 0.8 * tables.sum()) / 11 / (1 + customers.sum())
    assert abs(parent.sum() + unknown - 1) < 1e-12
    p = py.downward(np.zeros(10, dtype=np.int64), 1, count, parent, 0.8, 1.0, 3, 20, rng)
    fresh = (1 - p.sum()) / unknown
    assert 0 < fresh < 1  # what is left is the unknown word's share by the same weight of the parent
    assert abs(p[8] / parent[8] - fresh) < 1e-9


def test_numbers_of_tables_follow_seatings():
    """Draws against a walk over seatings, customer by customer."""
    d, theta, p, others, c = 0.5, 1.0, 0.3, 4, 6
    rng = np.random.default_rng(1)
    n = 20000
    t = py.draw_tables(np.full(n, c), np.full(n, others), np.full(n, p), d, theta, rng)
    seats = []
    tables = [c]
    for step in range(40000):
        k = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
        weight = np.array([x - d for x in tables] + [(theta + d * (others + len(tables))) * p])
        j = rng.choice(len(weight), p=weight / weight.sum())
        if j == len(tables):
            tables.append(1)
        else:
            tables[j] += 1
        seats.append(len(tables))
    assert abs(np.mean(t) - np.mean(seats)) < 0.06
    for k in range(1, c + 1):
        assert abs(np.mean(t == k) - np.mean(np.array(seats) == k)) < 0.03
    many = py.draw_tables(np.full(50, 5000), np.full(50, 100), np.full(50, 0.05), d, theta, rng)
    assert (many > 1).all() and (many <= 5000).all()


def test_scores_do_not_follow_the_number_of_partitions(spark):
    # one context with 40 words: the parent's share of a word follows its tables there
    often, seldom = [f"x{k}" for k in range(20)], [f"y{k}" for k in range(20)]
    train, held = [i for i in range(2000) if fold(i)], [i for i in range(2000) if not fold(i)]
    rows = [(train[j], " ".join(f"a {w}" for w in often * 4 + (seldom if j < 2 else []))) for j in range(20)]
    rows += [(i, f"q{i} {w}") for i, w in zip(held, often + seldom)]  # after an unknown word the parent decides
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def often_over_seldom(partitions, seed):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            score = {x.doc_id: x.score for x in py.score_texts(df, seed=seed).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        x = np.array([score[i] for i in held[:40]])
        return x[:20].mean() - x[20:].mean()

    two, again, many = often_over_seldom("2", 5), often_over_seldom("2", 6), often_over_seldom("200", 5)
    assert abs(two - many) < 3 * abs(two - again) + 0.1, (two, again, many)


def test_scores_are_equal_however_rows_are_partitioned(spark, monkeypatch):
    monkeypatch.setattr(py, "BUCKET_BYTES", 1500)
    r = random.Random(12)
    rows = [(i, " ".join(f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randrange(40)))) for i in range(90)]
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions, slices in ((2, 1), (9, 5)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(slices)
            got.append(sorted(tuple(x) for x in py.score_texts(df).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) == 90


def join(tables, fresh, r):
    """Seats a customer; whether the table is new."""
    x = r.random() * (sum(tables) - D * len(tables) + fresh)
    for k, size in enumerate(tables):
        x -= size - D
        if x < 0:
            tables[k] += 1
            return False
    tables.append(1)
    return True


def leave(tables, r):
    """Sends a customer away; whether the table is gone."""
    k = r.choices(range(len(tables)), tables)[0]
    tables[k] -= 1
    if tables[k]:
        return False
    tables.pop(k)
    return True


D, THETA = 0.8, 1.0


class Walk:
    """Gibbs over whole seatings: one customer at a time leaves its table, and its table's customer the parent, and sits down again."""

    def __init__(self, rows, seed):
        self.r = random.Random(seed)
        texts = [tokens(t) for i, t in rows if fold(i)]
        self.pairs = [p for t in texts for p in zip(["\0start", *t], t)]
        self.known = len({w for _, w in self.pairs})
        self.tables, self.top = defaultdict(list), defaultdict(list)
        self.customers, self.n_tables = Counter(), Counter()
        self.top_customers = self.top_tables = 0
        for u, w in self.pairs:
            self.sit(u, w)

    def parent(self, w):
        x = self.top.get(w, ())
        return (sum(x) - D * len(x) + (THETA + D * self.top_tables) / (self.known + 1)) / (THETA + self.top_customers)

    def p(self, u, w):
        x = self.tables.get((u, w), ())
        return (sum(x) - D * len(x) + (THETA + D * self.n_tables[u]) * self.parent(w)) / (THETA + self.customers[u])

    def sit(self, u, w):
        new = join(self.tables[u, w], (THETA + D * self.n_tables[u]) * self.parent(w), self.r)
        self.customers[u] += 1
        if new:
            self.n_tables[u] += 1
            self.top_tables += join(self.top[w], (THETA + D * self.top_tables) / (self.known + 1), self.r)
            self.top_customers += 1

    def stand(self, u, w):
        self.customers[u] -= 1
        if leave(self.tables[u, w], self.r):
            self.n_tables[u] -= 1
            self.top_customers -= 1
            self.top_tables -= leave(self.top[w], self.r)

    def sweep(self):
        for u, w in self.pairs:
            self.stand(u, w)
            self.sit(u, w)


def test_scores_follow_a_walk_over_whole_seatings(spark):
    """The whole score against seatings of every customer, in contexts and their parent."""
    r = random.Random(4)
    rows = []
    for i in range(60):
        at, out = 0, []
        for _ in range(r.randrange(25)):
            at = (at * 5 + 1) % 12 if r.random() < 0.6 else min(r.randrange(12), r.randrange(12))
            out.append(f"w{at}")
        rows.append((i, " ".join(out)))
    rows += [(100, "w1 unknown w2"), (101, None), (102, "w3 w4 " * 20)]
    walk, sums = Walk(rows, 1), Counter()
    wanted = {p for _, t in rows for p in zip(["\0start", *tokens(t)], tokens(t))}
    for k in range(240):
        walk.sweep()
        if k >= 40:
            for p in wanted:
                sums[p] += walk.p(*p) / 200
    seen = Counter(walk.pairs)
    total, kinds = Counter(u for u, _ in walk.pairs), Counter(u for u, _ in seen)
    met = Counter(w for _, w in seen)

    def one_table(u, w):
        """Without Gibbs: a table for each pair, and one in the parent for each word."""
        parent = (met[w] - D * (w in met) + (THETA + D * len(met)) / (len(met) + 1)) / (THETA + len(seen))
        return (seen[u, w] - D * ((u, w) in seen) + (THETA + D * kinds[u]) * parent) / (THETA + total[u])

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.score for x in py.score_texts(df, burn=4, keep=10).collect()}
    far, simple = [], []
    for i, t in rows:
        pairs = list(zip(["\0start", *tokens(t)], tokens(t)))
        want = sum(log10(sums[p]) for p in pairs)
        far.append(abs(got[i] - want) / len(pairs))
        simple.append(abs(sum(log10(one_table(*p)) for p in pairs) - want) / len(pairs))
    assert np.mean(far) < 0.01 and np.mean(far) < 0.3 * np.mean(simple), (np.mean(far), np.mean(simple))
