"""Rows of few keys in order, without a sort of all of them in one task."""

from ledgerweave.operators import recovery, sequential


def test_runs_come_in_order_and_are_few(spark):
    n = 60000
    rows = spark.range(n).selectExpr("if(id % 3 = 0, 'a', 'b') as k", f"if(id < 25000, -1, id * 7919 % {n}) as seq", "id")
    packed = sequential.in_order(rows, "k", "seq")
    assert packed.count() <= 40  # rows that the last task sorts

    def seen(batches):
        for run in sequential.runs(batches):
            yield run

    got = [(r.k, r.seq) for r in packed.mapInArrow(seen, rows.schema).collect()]
    assert len(got) == n
    for k in "ab":
        own = [s for name, s in got if name == k]
        assert own == sorted(own) and own


def test_segments_sort_runs(spark):
    log = spark.range(1, 50001).selectExpr("if(id % 5 = 0, 'x', 'y') as writer", "id as lsn", "10L + id % 7 as size")
    out = recovery.segments(log, 500)
    assert "_rows" in out._jdf.queryExecution().executedPlan().toString()
    want, held = {}, {"x": [1, 0], "y": [1, 0]}
    for i in range(1, 50001):
        w, size = held["y" if i % 5 else "x"], 10 + i % 7
        if w[1] and w[1] + size > 500:
            w[0], w[1] = w[0] + 1, 0
        w[1] += size
        want[i] = w[0]
    assert {r.lsn: r.segment for r in out.collect()} == want
