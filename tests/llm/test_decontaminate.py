import pickle
import random

import numpy as np

from ledgerweave.llm import decontaminate as d


def sample(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["the", "of", "é"]
    sent = lambda n: " ".join(r.choice(vocab) for _ in range(n)).capitalize() + "."
    items = [(k, " ".join(sent(r.choice([5, 9, 14])) for _ in range(r.choice([2, 3, 8])))) for k in range(40)]
    docs = []
    for i in range(120):
        w = [sent(r.choice([4, 10, 20])) for _ in range(r.choice([1, 5, 30]))]
        if i % 4 == 0:
            w.insert(r.randrange(len(w) + 1), items[r.randrange(40)][1])
        if i % 11 == 0:  # half an item is no leak
            w.insert(0, " ".join(items[3][1].split()[: len(items[3][1].split()) // 2]))
        docs.append((i, "\n".join(w) if i % 8 else "  ".join(w).upper()))
    return items, docs


def shingles(h, k):
    return {tuple(h[i : i + k].tolist()) for i in range(len(h) - k + 1)} if len(h) >= k else set()


def brute(items, docs):
    """Whole texts against whole items."""
    out = set()
    for i, t in docs:
        h = d.terms_of([t.encode()])[0]
        for j, x in items:
            shares = []
            for p in (x, *d.split_item(x)):
                g = d.terms_of([p.encode()])[0]
                s = shingles(g, min(5, len(g)))
                shares.append(len(s & shingles(h, min(5, len(g)))) / len(s))
            if shares[0] >= 0.8 and min(shares[1:]) >= 0.5:
                out.add((i, j))
    return out


def test_finds_what_brute_force_finds(spark):
    items, docs = sample(2)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(900, None, 1), (901, "", 1), (None, items[0][1], 1)], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items + [(77, None), (78, " "), (None, "only one here")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in d.contaminated(df, bench).collect()}
    assert got == brute(items, docs) | {(None, 0)}
    kept = d.keep_uncontaminated(df, bench)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect()} == ({i for i, _ in docs} | {900, 901}) - {i for i, _ in got}
    assert d.contaminated(df, bench.limit(0)).collect() == []
    assert d.contaminated(df.limit(0), bench).collect() == []


def test_pruning_loses_no_score():
    items, docs = sample(3)
    shard = d.Shard(items)
    h, first = d.terms_of([t.encode() for _, t in docs])
    for threshold in (0.2, 0.5):
        a, b = (sorted((*x[:4], round(x[4], 4)) for x in shard.hits(h, first, threshold, p)) for p in (True, False))
        assert a == b and a
    # the scores are those of BM25 over the passage's terms
    t, begin, end, item, score = shard.hits(h, first, 0.5)[0]
    term = np.repeat(np.arange(len(shard.vocab)), np.diff(shard.first))
    present = np.isin(shard.vocab, h[begin:end])[term] & (shard.item == item)
    assert abs(shard.impact[present].sum() - score) < 1e-4


def test_marks_text_ids_and_repeated_rows(spark):
    item = "Which of these rivers runs through the old town of the north? It is the long blue river of the hills."
    marked = "so: " + " ".join(f"*****{w}!!!!!!)" for w in item.split()) + " end"
    df = spark.createDataFrame([(1, marked), (1, marked), (2, "nothing of it " * 20000)], "doc_id long, text string")
    bench = spark.createDataFrame([("river-1", item), ("other", "One more question of no use here at all? No answer to it.")], "item_id string, text string")
    assert [(x.doc_id, x.item_id) for x in d.contaminated(df, bench).collect()] == [(1, "river-1")] * 2


def test_index_is_sized_and_sent_in_groups(spark, monkeypatch):
    items, docs = sample(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(x)[:2] for x in d.contaminated(df, bench).collect()}
    monkeypatch.setattr(d, "SHARD", 7)
    monkeypatch.setattr(d, "SENT_BYTES", 20_000)
    groups = d._item_groups(bench, "item_id", "text")
    assert len(groups) > 1 and all(sum(s.nbytes() for s in g) <= 20_000 for g in groups)
    assert {tuple(x)[:2] for x in d.contaminated(df, bench).collect()} == one == brute(items, docs)
    text = sum(len(t) for _, t in items)
    assert len(pickle.dumps(d.Shard(items))) < 20 * text


def test_clean_rows_stay_where_ids_are_null_or_shared(spark):
    items, docs = sample(4)
    leak, clean = f"Before it. {items[0][1]} After it.", "nothing of any item is in here"
    rows = [(None, leak), (None, clean), (None, None), (7, leak), (7, clean), (7, clean), (8, clean)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = d.keep_uncontaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(x.n for x in kept.collect()) == [1, 2, 4, 5, 6]


def test_items_of_any_script(spark):
    texts = ["Какая река самая длинная в Европе? Самая длинная река в Европе это Волга.", "ποιος ποταμός είναι ο μεγαλύτερος; ο μεγαλύτερος ποταμός είναι ο Νείλος", "ما هي عاصمة مصر اليوم؟ عاصمة مصر هي مدينة القاهرة", "最 长 的 河 是 哪 条 ？ 最 长 的 河 是 尼 罗 河"]
    items = [*enumerate(texts), (90, "... !!! ---"), (91, " \n\t"), (92, None)]
    docs = [(k, f"before it {t} after it") for k, t in enumerate(texts)] + [(9, "... !!! --- and words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in d.contaminated(df, bench).collect()) == [(k, k) for k in range(len(texts))]
    assert [x.doc_id for x in d.keep_uncontaminated(df, bench).collect()] == [9]
