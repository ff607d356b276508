import random
import re

import numpy as np
import xxhash

from ledgerweave.llm import simhash_dedup as s

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_fp(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = WORD.findall(low)
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=3):
    fp = [(i, brute_fp(t)) for i, t in rows]
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fp)):
        for b in range(a):
            if (fp[a][1] ^ fp[b][1]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fp):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(fp)), key=str)


def sample(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["É", "Ab", "c."]
    rows = []
    for i in range(40):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 60, 120]))]
        rows.append((i * 7 % 41, " ".join(base)))
        for k in range(r.randrange(3)):
            b = list(base)
            b[r.randrange(len(b))] = r.choice(vocab)
            rows.append((100 + i * 3 + k, "\n".join(b)))
    return rows + [(500, None), (501, ""), (502, " \t "), (None, rows[3][1]), (rows[4])]


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = sample(1)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = sorted((tuple(x) for x in s.simhash_components(df).collect()), key=str)
    assert got == brute_components(rows)
    kept = s.keep_first(df).collect()
    assert sorted(x.doc_id for x in kept) == sorted({c for *_, c in got})
    assert s.simhash_components(df.limit(0)).collect() == []


def test_tiles_of_a_heavy_block(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 6, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(60):
            x ^= 1 << int(r.integers(20, 62))  # a chain: neighbours differ by one bit
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = [tuple(e) for e in s.links(df, 3, tile=10).collect()]
    at = {x: k for k, x in enumerate(fps)}
    got = s.local_roots(len(fps), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    a, b = np.nonzero(np.bitwise_count(np.array(fps)[:, None] ^ np.array(fps)[None, :]) <= 3)
    assert (got == s.local_roots(len(fps), a, b)).all()
