import hashlib
import random
import re

from ledgerweave.llm.automaton import Automaton
from ledgerweave.llm.secret_scan import BASE, MORE, Scanner, secret_scan

KEY = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in KEY.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    out.sort()
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in out)
    return (*(sum(k == j for _, k, _ in out) for j in range(3)), hashlib.sha256(said.encode()).hexdigest())


def sample(seed):
    r = random.Random(seed)
    bits = ["token", "PassWord", "api_key", "apikey", "ſecret", "secret", "=", ":", " ", "  ", '"', "'", "é", "ß\n", "AKIA", "A9", "Z" * 7, "AKIAAKIA", "deadbeef", "0123456789abcdef", "x" * 11, "y" * 12, "-", "/", "ghp_" + "a" * 36]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 25))) for _ in range(400)]


def texts(seed):
    r = random.Random(seed)
    return sample(seed) + ["".join(r.choice("abcdefxz") for _ in range(20)) for _ in range(300)] + [""]


def test_automaton_equals_re():
    rules = [(x.counted if x.kind == "hex" else x.pattern, x.fold) for x in (*BASE[:2], *MORE[:2], BASE[2])] + [("a(b|cd)*e{2,3}f?", False), ("[^a-y]{2}x+", False)]
    a = Automaton(rules)
    for text, got in zip(texts(2), a.matched([t.encode() for t in texts(2)], lanes=64).tolist()):
        want = sum(1 << k for k, (p, fold) in enumerate(rules) if re.search(p.encode(), text.encode(), re.I if fold else 0))
        assert got == want, text


def test_spans_equal_re_for_every_rule():
    long = ["ghp_" + "aB3" * 13, "github_pat_" + "x_1" * 31, "xoxb-12-" + "a" * 9, "AIza" + "Q-_9" * 9, "AIza" * 12, "sk_live_" + "z" * 16, "eyJ" + "a" * 9 + ".eyJ" + "b" * 8 + "." + "c" * 8, "-----BEGIN RSA PRIVATE KEY-----", "https://user:" + "t0K-" * 30 + "@host", "é://a:b@", " ", "é", "\n", "ab://x:yz1@"]
    r = random.Random(7)
    rules = (*BASE, *MORE)
    scanner, hit = Scanner(rules), set()
    for text in texts(3) + ["".join(r.choice(long) for _ in range(r.randrange(8))) for _ in range(400)]:
        raw = text.encode()
        bits = int(scanner.all.matched([raw])[0])
        want = []
        for k, rule in enumerate(rules):
            for m in re.finditer(f"(?P<head>{rule.head})(?P<run>{rule.run + '+' if rule.run else ''})", text, re.A | (re.I if rule.fold else 0)):
                if len(m["run"]) >= rule.least:
                    want.append((m.start(), k, m.end()))
                    hit.add(k)
        assert scanner.spans(raw, bits) == sorted(want), text
    assert hit == set(range(len(rules)))
    assert len(scanner.all) < 2000


def test_equals_brute_force(spark):
    rows = [(k, t, "n") for k, t in enumerate(sample(1))] + [(900, None, "n"), (None, "token=abcdefabcdefabcdef", "n"), (901, "a" * 100_000, "n"), (901, "a" * 100_000, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = secret_scan(df).collect()
    assert sorted((x.doc_id or -1, *tuple(x)[1:5]) for x in got) == sorted((i or -1, *brute(t)) for i, t, _ in rows)
    assert any("github:" in x.spans for x in got)
    assert secret_scan(df.limit(0)).collect() == []
