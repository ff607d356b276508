import random

import duckdb

from ledgerweave.llm import mixing as m


def sample(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice([f"src{r.choice([0, 0, 0, 1, 2, 3, 4, 9])}", None, "odd"]) if i % 9 == 0 else f"src{r.choice([0, 0, 0, 0, 1, 2, 3, 5, 6])}"
        rows.append((i, "w " * r.choice([0, 1, 10, 90]), r.choice(["en", "en", "de", None]), source))
    return rows + [(None, "a b", "en", "src1"), (None, "a b", "en", "src1"), (900, None, "en", "src1"), (901, "", "fr", "src77"), rows[1]]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, source string, budget string")


def test_equals_sql(spark):
    rows = sample(1)
    got = sorted((tuple(x) for x in m.mix(frame(spark, rows).repartition(4)).collect()), key=str)
    c = duckdb.connect()
    c.sql("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?, ?)", rows)
    assert got == sorted(c.sql(m.SQL).fetchall(), key=str)
    assert m.mix(frame(spark, rows).limit(0)).collect() == []


def fill(children, budget):
    """Water filling by steps: (name, weight, cap) -> share."""
    out, open_ = {}, dict((n, (w, c)) for n, w, c in children)
    while open_:
        level = budget / sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c <= w * level]
        if not full:
            return out | {n: w * level for n, (w, _) in open_.items()}
        for n in full:
            out[n] = open_.pop(n)[1]
            budget -= out[n]
    return out


def test_shortages_go_to_siblings_first(spark):
    rows = sample(2)
    out = m.mix(frame(spark, rows), share=0.7, epochs=3).collect()
    tokens, taken, longest = {}, {}, {}
    for x in out:
        k = (x.domain, x.lang, x.source)
        tokens[k] = tokens.get(k, 0) + x.n_tokens
        taken[k] = taken.get(k, 0) + x.n_tokens * x.copies
        longest[k] = max(longest.get(k, 0), x.n_tokens)
    weight = lambda level, name: m.WEIGHTS[level].get(name, 1.0)

    def share(prefix, budget):
        if len(prefix) == 3:
            got = taken[prefix]
            assert budget - 1e-6 <= got <= budget + 2 * longest[prefix] + 1e-6  # documents that tie go together
            return
        below = {k[: len(prefix) + 1] for k in tokens if k[: len(prefix)] == prefix}
        caps = [(k, weight(m.LEVELS[len(prefix)], k[-1]), 3 * sum(v for x, v in tokens.items() if x[: len(k)] == k)) for k in below]
        for k, b in fill(caps, budget).items():
            share(k, b)

    share((), float(int(sum(tokens.values()) * 0.7)))
    assert max(x.copies for x in out) <= 3
