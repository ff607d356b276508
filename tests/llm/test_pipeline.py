"""The pipeline stage by stage: each stage's result on its own input against a brute-force version."""

import random

import duckdb
import test_decontaminate
import test_line_dedup
import test_simhash

import corpus_pipeline
from ledgerweave.llm import mixing, toxicity


def corpus(tmp_path, spark):
    r = random.Random(6)
    vocab = [f"word{k}" for k in range(500)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, line(12).capitalize() + ". " + line(9).capitalize() + ".") for k in range(30)]
    common = [line(9) for _ in range(5)]
    docs = []
    for i in range(300):
        lines = [line(r.choice([8, 15, 40])) for _ in range(r.choice([1, 3, 6]))]
        if i % 5 == 0:
            lines.append(r.choice(common))
        if i % 6 == 0:
            lines[0] += " moron and a moron"
        if i % 17 == 0:
            lines.append(items[i % 30][1])
        docs.append([i, "\n".join(lines)])
    for i in range(300, 340):  # near copies: a few words of a long text differ
        words = docs[(i * 7) % 90][1].split(" ")
        words[r.randrange(len(words))] = "changed"
        docs.append([i, " ".join(words)])
    docs += [[340, None], [341, ""], [342, docs[3][1]], [None, docs[5][1]]]
    rows = [(i, t, r.choice(["en", "de", None]), f"src{r.randrange(6)}", None if t is None else len(t)) for i, t in docs]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, items


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, tmp_path):
    sf, items = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(path := f"{tmp_path}/{name}")
        held[name] = docs, docs = docs, spark.read.parquet(path)
        if name != "mixing":
            assert docs.dtypes == columns, name

    before, after = held["toxicity"]
    said = {(x.doc_id): x.is_toxic for x in toxicity.toxicity(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert pairs(after) == [p for p in pairs(before) if not said[p[0]]]
    gone = {p[0] for p in pairs(before)} - {p[0] for p in pairs(after)}
    assert {i for i in range(0, 300, 6)} <= gone and all(i is not None and (i % 6 == 0 or i >= 300) for i in gone)

    before, after = held["line_dedup"]
    want = test_line_dedup.brute([p for p in pairs(before)], 1)
    import hashlib

    assert sorted((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs(after) if i is not None) == sorted((w[0], w[3]) for w in want if w[0] is not None)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.collect())

    before, after = held["simhash_dedup"]
    groups = test_simhash.brute_components(pairs(before))
    assert sorted(p[0] for p in pairs(after)) == sorted({c for *_, c in groups})

    before, after = held["decontaminate"]
    hits = {i for i, _ in test_decontaminate.brute(items, [(i, t or "") for i, t in pairs(before)])}
    assert hits and [p[0] for p in pairs(after)] == [p[0] for p in pairs(before) if p[0] not in hits]

    before, after = held["mixing"]
    c = duckdb.connect()
    c.sql("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?, ?)", [(r.doc_id, r.text, r.lang, r.source) for r in before.collect()])
    assert sorted((tuple(r) for r in after.collect()), key=str) == sorted(c.sql(mixing.SQL).fetchall(), key=str)

    whole = corpus_pipeline.run(spark, sf)
    assert sorted((tuple(r) for r in whole.collect()), key=str) == sorted((tuple(r) for r in after.collect()), key=str)
