"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every context (the word before) is a restaurant whose customers are the words
that follow it; a table sends one customer to the restaurant that all contexts
share as their parent, which itself backs off to a uniform choice among known
words and one unknown word.  Seatings matter only through numbers of tables,
so Gibbs steps draw those from their full conditionals (generalised Stirling
numbers times the parent's weights) and predictive probabilities are averaged
over the draws kept.

Two meetings carry everything, as packed arrays rather than rows, and between
them go the upward sweeps:

1. by word: counts.  Then each sweep draws the tables of a word in all contexts
   together with its tables in the shared parent.  Contexts are spread over all
   words, so before every sweep their tables are added up across the buckets of
   words and sent back, as are the parent's; within a sweep all draws are given
   the totals after the sweep before.
2. by context: a downward sweep that draws the tables of each context with its
   own totals, given the parent; then every token of every text is scored.

Tokens of one text that are alike travel once.  The global sums that probabilities
need (tokens, words, customers and tables of the parent) are four numbers.

Numbers of tables of more than `EXACT` customers are drawn by seating them in
growing batches instead.  Buckets are as many as the bytes of text need, and the
draws' seeds follow the buckets, so scores depend on the texts alone and not on
how they or the shuffles are partitioned.

Nulls and special cases: null text has only its end; a null id counts as empty
text in the fold rule; repeated rows are scored (and learnt from) each; without
training texts every token is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerweave.llm._store import Stored
from ledgerweave.llm._words import U64, Words, give_back_memory, groups, narrow, pack, pieces, planes, unpack, unplanes

END, START = U64(0x0E4D), U64(0x57A7)
#: Tokens of a task that are sorted and sent together.
FLUSH_TOKENS = 2 << 20
PIECE_BYTES = 1 << 20
#: Bytes of text for each bucket of words, and of contexts.
BUCKET_BYTES = 6 << 20
EXACT = 256
FIXED = float(1 << 32)  # sums of logarithms travel as whole multiples of 2 ** -32
ROW = "bucket int, kind int, flush long, blob binary"
ENTRIES, DOCS, SUMS, STATE, USED, SENT, TOTALS, TABLES, INFOS = range(9)


def _sorted_planes(x: np.ndarray) -> np.ndarray:
    return planes(np.diff(x, prepend=U64(0)), 8)


def _unsorted(p: np.ndarray) -> np.ndarray:
    return np.cumsum(unplanes(p), dtype=np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of either sign as planes."""
    x = np.rint(x).astype(np.int64)
    return planes(np.where(x >= 0, 2 * x, -2 * x - 1).astype(np.uint64), 8)


def _unsigned(p: np.ndarray) -> np.ndarray:
    x = unplanes(p).astype(np.int64)
    return np.where(x & 1, -((x + 1) >> 1), x >> 1)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Never falls as hashes rise."""
    return ((h >> U64(40)) * U64(n) >> U64(24)).astype(np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _batch(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names=["bucket", "kind", "flush", "blob"])


# --- numbers of tables -------------------------------------------------------

_STIRLING: dict = {}


def log_stirling(d: float, n: int = EXACT) -> np.ndarray:
    """log S_d(c, t) at [c, t]: seatings of c customers at t tables with discount d."""
    if (d, n) not in _STIRLING:
        out = np.full((n + 1, n + 2), -np.inf)
        out[0, 0] = 0
        t = np.arange(n + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(n):
                stay = np.log(np.maximum(c - d * t, 0)) + out[c]
                out[c + 1, 1:] = np.logaddexp(stay[1:], out[c, :-1])
        _STIRLING[d, n] = out
    return _STIRLING[d, n]


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, theta: float, rng) -> np.ndarray:
    """Numbers of tables of a dish with c customers, in a restaurant with `others` tables besides, whose parent gives it probability p."""
    t = np.minimum(c, 1).astype(np.int64)
    stirling = log_stirling(d)
    p = np.maximum(p, 1e-300)
    for low, high in ((2, 2), (3, 4), (5, 16), (17, 64), (65, EXACT), (EXACT + 1, None)):
        mine = np.flatnonzero((c >= low) & (c <= high) if high else c >= low)
        width = min(high or EXACT, EXACT)
        for k in range(0, len(mine), step := max(1, (1 << 21) // width)):
            i = mine[k : k + step]
            weight = np.cumsum(np.log((theta + d * (others[i, None] + np.arange(width))) * p[i, None]), axis=1)
            weight += stirling[np.minimum(c[i], EXACT), 1 : width + 1]
            weight -= weight.max(axis=1, keepdims=True)
            chance = np.cumsum(np.exp(weight), axis=1)
            t[i] = 1 + (chance < rng.random(len(i))[:, None] * chance[:, -1:]).sum(axis=1)
        if high is None and len(mine):
            seated = np.full(len(mine), EXACT, dtype=np.int64)
            while len(left := np.flatnonzero(seated < c[mine])):
                i = mine[left]
                come = np.minimum(c[i] - seated[left], seated[left] // 8)
                a = (theta + d * (others[i] + t[i])) * p[i]
                t[i] += rng.binomial(come, np.clip(a / (a + seated[left] - d * t[i]), 0, 1))
                seated[left] += come
    return t


# --- first meeting: by word --------------------------------------------------


class _Tokens:
    """Tokens of one task since the last flush."""

    def __init__(self):
        self.parts, self.docs, self.n = [], [], 0

    def add(self, rows: list[bytes], ids: pa.Array, train: np.ndarray) -> None:
        w = Words(rows, lower=True)
        size = np.diff(w.first) + 1
        token = np.empty(size.sum(), dtype=np.uint64)
        last = np.cumsum(size) - 1
        inside = np.ones(len(token), dtype=bool)
        inside[last] = False
        token[inside], token[last] = w.hashes(), END
        self.parts.append((token, size))
        self.docs.append((ids, train))
        self.n += len(token)

    def blobs(self, flush: int, n: int):
        token, size = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        self.parts = []
        train = np.concatenate([t for _, t in self.docs])
        yield flush % n, DOCS, flush, pack(pa.concat_arrays([i for i, _ in self.docs]), ~train, size)
        vocab, key = np.unique(token, return_inverse=True)
        del token
        before = np.empty(len(key), dtype=np.uint32)
        before[1:] = key[:-1]
        before[np.cumsum(size) - size] = len(vocab)
        key *= len(vocab) + 1
        key += before
        del before
        order = np.argsort(key, kind="stable")
        key = key[order]
        doc = np.repeat((np.arange(len(size)) * 2 + train).astype(np.uint32), size)[order]
        del order
        at = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) + 1))
        times, key, doc = np.diff(np.append(at, len(key))), key[at], doc[at]
        at = groups(key)
        n_docs = np.diff(np.append(at, len(key)))
        word, before = np.divmod(key[at], len(vocab) + 1)
        hashes = np.append(vocab, START)
        words = np.searchsorted(_bucket(vocab, n), np.arange(n + 1))
        pairs = np.searchsorted(word, words)
        ends = np.append(at, len(key))
        for b in range(n):
            s, e = slice(pairs[b], pairs[b + 1]), slice(ends[pairs[b]], ends[pairs[b + 1]])
            if s.start == s.stop:
                continue
            contexts, context = np.unique(before[s], return_inverse=True)
            per_word = np.bincount(word[s] - words[b], minlength=words[b + 1] - words[b])
            yield b, ENTRIES, flush, pack(
                _sorted_planes(vocab[words[b] : words[b + 1]]), narrow(per_word), _sorted_planes(hashes[contexts]),
                narrow(context), narrow(n_docs[s]), narrow(doc[e]), narrow(times[e]),
            )


def _send(n: int):
    def run(batches):
        from pyspark import TaskContext

        give_back_memory()
        flush, held = TaskContext.get().partitionId() << 24, _Tokens()
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for first, rows in pieces(batch.column(2), PIECE_BYTES):
                held.add(rows, batch.column(0).slice(first, len(rows)), train[first : first + len(rows)])
                if held.n >= FLUSH_TOKENS:
                    for row in held.blobs(flush, n):
                        yield from _batch([row]).to_batches()
                    flush, held = flush + 1, _Tokens()
        if held.n:
            for row in held.blobs(flush, n):
                yield from _batch([row]).to_batches()

    return run


class _Pairs:
    """All pairs of a meeting: number of context and word, and their entries (flush, document, times)."""

    def __init__(self, blobs: list[tuple[int, pa.BinaryScalar]]):
        self.flushes = sorted({f for f, _ in blobs})
        number = {f: k for k, f in enumerate(self.flushes)}
        words, contexts, per_word, context, n_docs, doc, times, flush = ([] for _ in range(8))
        for f, blob in blobs:
            w, pw, c, ci, nd, dc, tm = unpack(blob.as_py())
            words.append(_unsorted(w))
            contexts.append(_unsorted(c))
            per_word.append(pw)
            context.append(ci)
            n_docs.append(nd)
            doc.append(dc)
            times.append(tm)
            flush.append(np.full(len(dc), number[f], dtype=np.uint32))
        self.words, at_w = np.unique(np.concatenate(words), return_inverse=True)
        self.contexts, at_c = np.unique(np.concatenate(contexts), return_inverse=True)
        w_from = np.cumsum([0, *map(len, words)])
        c_from = np.cumsum([0, *map(len, contexts)])
        key = np.concatenate([at_c[a : a + len(cs)][ci] for a, cs, ci in zip(c_from, contexts, context)]) * np.int64(len(self.words))
        key += np.concatenate([np.repeat(at_w[a : a + len(p)], p) for a, p in zip(w_from, per_word)])
        del words, contexts, per_word, context, at_w, at_c
        n_docs = np.concatenate([x.astype(np.int64) for x in n_docs])
        start = np.cumsum(n_docs) - n_docs
        order = np.argsort(key, kind="stable")
        key, n_docs = key[order], n_docs[order]
        entry = _spread(start[order], n_docs)
        del order, start
        self.doc = np.concatenate([x.astype(np.uint32) for x in doc])[entry]
        del doc
        self.times = np.concatenate([x.astype(np.uint32) for x in times])[entry]
        del times
        self.flush = np.concatenate(flush)[entry]
        del flush, entry
        at = groups(key)
        self.n_docs = np.add.reduceat(n_docs, at)
        self.context, self.word = np.divmod(key[at], len(self.words))
        first = np.cumsum(self.n_docs) - self.n_docs
        self.count = np.add.reduceat(self.times.astype(np.int64) * (self.doc & 1), first)


def _state(pairs: _Pairs, mine: int, n: int) -> list[tuple]:
    """What the sweeps over a word bucket need, and the number of pairs of each context for the contexts' buckets."""
    n_words = len(pairs.words)
    seen = np.flatnonzero(pairs.count > 0)
    word, context, c = pairs.word[seen], pairs.context[seen], pairs.count[seen]
    multi = c > 1
    single = np.bincount(word[~multi], minlength=n_words)
    met = np.bincount(context, minlength=len(pairs.contexts))
    per = np.bincount(context[multi], minlength=len(pairs.contexts))
    count = np.bincount(word, weights=c, minlength=n_words).astype(np.int64)
    out = [
        (mine, STATE, 0, pack(narrow(single), narrow(count), _sorted_planes(pairs.contexts[per > 0]), narrow(per[per > 0]), narrow(word[multi]), narrow(c[multi]))),
        (mine, SUMS, 0, pack(np.array([count.sum(), (count > 0).sum(), len(seen), (count > 0).sum()], dtype=float))),
    ]
    had = met > 0
    return out + _sent(pairs.contexts[had], met[had], per[had] > 0, mine, n)


def _sent(contexts: np.ndarray, values: np.ndarray, asked: np.ndarray, mine: int, n: int) -> list[tuple]:
    edges = np.searchsorted(_bucket(contexts, n), np.arange(n + 1))
    parts = [(b, slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges))]
    return [(int(b), SENT, mine, pack(_sorted_planes(contexts[x]), narrow(values[x]), asked[x])) for b, x in parts]


def _totals(table: pa.Table) -> pa.Table:
    """The sum for each context, sent back to the word buckets that asked."""
    give_back_memory()
    mine = table.column("bucket")[0].as_py()
    got = [unpack(x) for x in table.column("blob").to_pylist()]
    _, at = np.unique(np.concatenate([_unsorted(c) for c, *_ in got]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([v for _, v, _ in got])).astype(np.int64)[at]
    parts = np.split(total, np.cumsum([len(v) for _, v, _ in got])[:-1])
    return _batch([(m, TOTALS, mine, pack(narrow(x[asked]))) for m, x, (*_, asked) in zip(table.column("flush").to_pylist(), parts, got) if asked.any()])


def _sweep(k: int, totals: np.ndarray, n: int, d: float, theta: float, burn: int, keep: int, seed: int):
    """Draws the tables of all pairs of a word bucket and of its words in the parent, given all totals after the sweep before."""
    known, all_customers, all_tables = totals

    def run(table: pa.Table) -> pa.Table:
        give_back_memory()
        mine = table.column("bucket")[0].as_py()
        rows = sorted(zip(table.column("kind").to_pylist(), table.column("flush").to_pylist(), table.column("blob").to_pylist()))
        of = lambda kind: [unpack(x) for r, _, x in rows if r == kind]
        single, count, contexts, per, word, c = of(STATE)[0]
        contexts, word, c = _unsorted(contexts), word.astype(np.int64), c.astype(np.int64)
        context = np.repeat(np.arange(len(contexts)), per)
        n_words = len(count)
        total = np.concatenate([np.empty(0, np.int64), *(x.astype(np.int64) for (x,) in of(TOTALS))])
        if k:
            t, tables, base, customers_sum, tables_sum = of(TABLES)[0]
            total = total + base  # of tables beyond one a pair
        else:
            t, tables, base = np.ones(len(c), dtype=np.int64), np.minimum(count, 1).astype(np.int64), total
            customers_sum, tables_sum = np.zeros(n_words, dtype=np.int64), np.zeros(n_words, dtype=np.int64)
        rng = np.random.default_rng((seed, mine, k))
        customers = single + np.bincount(word, weights=t, minlength=n_words).astype(np.int64)
        tables = draw_tables(customers, np.maximum(int(all_tables) - tables, 0), np.full(n_words, 1 / (known + 1)), d, theta, rng)
        rest = customers[word] - t  # the pair's own tables leave the parent while they are drawn
        back = (theta + d * all_tables) / (known + 1)
        p = (np.maximum(rest - d * np.minimum(tables[word], rest), 0) + back) / (theta + all_customers - t)
        t = draw_tables(c, total[context] - t, p, d, theta, rng)
        if k >= burn:
            customers_sum, tables_sum = customers_sum + customers, tables_sum + tables
        if k < burn + keep - 1:
            after = single.sum() + t.sum()
            out = [(mine, TABLES, 0, pack(t, tables, base, customers_sum, tables_sum)), (mine, SUMS, 0, pack(np.array([after, tables.sum()], dtype=float)))]
            extra = np.bincount(context, weights=t - 1, minlength=len(contexts)).astype(np.int64)
            return _batch(out + _sent(contexts, extra, np.ones(len(contexts), dtype=bool), mine, n))
        out = [(mine, SUMS, 0, pack(np.array([customers_sum.sum() / keep, tables_sum.sum() / keep])))]
        infos = np.column_stack([count, customers_sum / keep, tables_sum / keep])
        for r, b, blob in rows:
            if r == USED:
                each, at = np.unique(infos[unpack(blob)[0]], axis=0, return_inverse=True)
                out.append((b, INFOS, mine, pack(each, narrow(at.reshape(-1)))))
        return _batch(out)

    return run


def _sums(df: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n)
    for r in df.where(F.col("kind") == SUMS).select("blob").toLocalIterator():  # a row for each word bucket
        out += unpack(r.blob)[0]
    return out


def _let_go(spark) -> None:
    """Lets Spark delete the shuffle files of what is written, before the next shuffle writes its own."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def upward(met: DataFrame, n: int, d: float, theta: float, burn: int, keep: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """INFOS rows (count, mean customers and mean tables in the parent of the words of each entry) and the global sums.

    Before each sweep every context's tables are added up over all word buckets, and the parent's over all words.
    """
    tokens, known, customers, tables = _sums(met, 4)
    state, last = met.where(F.col("kind") == STATE), met
    old = []
    for k in range(burn + keep):
        rows = state.unionAll(last.where(F.col("kind") == SENT).groupBy("bucket").applyInArrow(_totals, ROW))
        if k:
            rows = rows.unionAll(last.where(F.col("kind") == TABLES))
        if k == burn + keep - 1:
            rows = rows.unionAll(met.where(F.col("kind") == USED))
        stored = Stored(rows.groupBy("bucket").applyInArrow(_sweep(k, np.array([known, customers, tables]), n, d, theta, burn, keep, seed), ROW), "tables")
        last = stored.df
        customers, tables = _sums(last, 2)
        for x in old:
            x.drop()
        old = [stored]
        del rows
        _let_go(met.sparkSession)
    return last.where(F.col("kind") == INFOS), np.array([tokens, known, customers, tables])


def _by_word(n: int):
    def run(table: pa.Table) -> pa.Table:
        give_back_memory()
        mine = table.column("bucket")[0].as_py()
        kinds, flushes = table.column("kind").to_pylist(), table.column("flush").to_pylist()
        out = [(mine, DOCS, f, x.as_py()) for k, f, x in zip(kinds, flushes, table.column("blob")) if k == DOCS]
        if ENTRIES not in kinds:
            return _batch(out)
        pairs = _Pairs([(f, x) for k, f, x in zip(kinds, flushes, table.column("blob")) if k == ENTRIES])
        del table
        out += _state(pairs, mine, n)
        edges = np.searchsorted(pairs.context, np.searchsorted(_bucket(pairs.contexts, n), np.arange(n + 1)))
        ends = np.append(np.cumsum(pairs.n_docs) - pairs.n_docs, len(pairs.doc))
        flushes = np.array(pairs.flushes, dtype=np.int64)
        for b in range(n):
            s, e = slice(edges[b], edges[b + 1]), slice(ends[edges[b]], ends[edges[b + 1]])
            if s.start == s.stop:
                continue
            low = pairs.context[s.start]
            per = np.bincount(pairs.context[s] - low)
            has = np.flatnonzero(per)
            used, local = np.unique(pairs.word[s], return_inverse=True)
            out.append((mine, USED, b, pack(narrow(used))))
            out.append((b, ENTRIES, mine, pack(
                _sorted_planes(pairs.contexts[low + has]), narrow(per[has]), narrow(pairs.count[s]), narrow(local), narrow(pairs.n_docs[s]),
                flushes, narrow(pairs.flush[e]), narrow(pairs.doc[e] >> 1), narrow(pairs.times[e]),
            )))
        return _batch(out)

    return run


# --- second meeting: by context ----------------------------------------------


def downward(context: np.ndarray, n_contexts: int, count: np.ndarray, parent: np.ndarray, d: float, theta: float, burn: int, keep: int, rng) -> np.ndarray:
    """Predictive probability of each pair, averaged over draws; context: numbers of the pairs' contexts."""
    total = np.bincount(context, weights=count, minlength=n_contexts)
    t = np.minimum(count, 1)
    multi = np.flatnonzero(count > 1)
    mean = np.where(count == 1, 1.0, 0.0)
    sums = np.zeros(len(multi))
    for k in range(burn + keep):
        tables = np.bincount(context, weights=t, minlength=n_contexts)
        half = multi[rng.random(len(multi)) < 0.5]  # of each context about half the words at once
        for part in (half, np.setdiff1d(multi, half, assume_unique=True)):
            t[part] = draw_tables(count[part], tables[context[part]] - t[part], parent[part], d, theta, rng)
            tables = np.bincount(context, weights=t, minlength=n_contexts)
        if k >= burn:
            sums += t[multi]
    mean[multi] = sums / keep
    tables = np.bincount(context, weights=mean, minlength=n_contexts)
    # linear in the numbers of tables, so their means give the mean probability
    return (count - d * mean + (theta + d * tables[context]) * parent) / (theta + total[context])


def _by_context(totals: np.ndarray, d: float, theta: float, burn: int, keep: int, seed: int):
    _, n_words, customers, tables = totals

    def run(table: pa.Table) -> pa.Table:
        give_back_memory()
        mine = table.column("bucket")[0].as_py()
        cols = [[] for _ in range(8)]
        numbers: dict = {}
        kinds, froms, blobs = table.column("kind").to_pylist(), table.column("flush").to_pylist(), table.column("blob")
        infos_of = {m: i for i, (k, m) in enumerate(zip(kinds, froms)) if k == INFOS}
        for m, i in sorted((m, i) for i, (k, m) in enumerate(zip(kinds, froms)) if k == ENTRIES):
            ctx, per, count, local, n_docs, flushes, flush, doc, times = unpack(blobs[i].as_py())
            infos, of_word = unpack(blobs[infos_of[m]].as_py())
            of = np.array([numbers.setdefault(int(f), len(numbers)) for f in flushes], dtype=np.uint32)
            info = infos[of_word[local]]
            for c, x in zip(cols, (np.repeat(_unsorted(ctx), per), count.astype(np.int64), info[:, 0], info[:, 1], info[:, 2], n_docs.astype(np.int64), (of[flush].astype(np.int64) << 32) | doc, times.astype(np.uint32))):
                c.append(x)
        del table, blobs
        ctx, count, c_word, customers_of, tables_of, n_docs, at, times = (np.concatenate(c) for c in cols)
        del cols
        contexts, ctx = np.unique(ctx, return_inverse=True)
        parent = (customers_of - d * tables_of + (theta + d * tables) / (n_words + 1)) / (theta + customers)
        p = downward(ctx, len(contexts), count, parent, d, theta, burn, keep, np.random.default_rng((seed, 1, mine)))
        del ctx, contexts, count, parent
        order = np.argsort(at, kind="stable")
        at, times = at[order], times[order]
        first = groups(at)
        pair = np.repeat(np.arange(len(p), dtype=np.uint32), n_docs)[order]
        del order
        base, score, known = (np.add.reduceat(x[pair] * times, first) for x in (np.rint(np.log10(c_word + 0.1) * FIXED), np.rint(np.log10(p) * FIXED), (c_word > 0).astype(np.int64)))
        at = at[first]
        edges = np.searchsorted(at >> 32, np.arange(len(numbers) + 1))
        out = []
        for f, k in numbers.items():
            s = slice(edges[k], edges[k + 1])
            if s.start < s.stop:
                out.append((mine, ENTRIES, f, pack(narrow(at[s] & 0xFFFFFFFF), _signed(base[s]), _signed(score[s]), narrow(known[s].astype(np.int64)))))
        return _batch(out)

    return run


def _together(totals: np.ndarray, kind: str):
    n_tokens, n_words = totals[:2]
    each = np.log10(n_tokens + 0.1 * (n_words + 1))

    def run(table: pa.Table) -> pa.Table:
        give_back_memory()
        rows = list(zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()))
        ids, held, size = next(unpack(b) for k, b in rows if k == DOCS)
        base, score, known = (np.zeros(len(size), dtype=np.int64) for _ in range(3))
        for k, blob in rows:
            if k == ENTRIES:
                doc, b, s, n = unpack(blob)
                base[doc] += _unsigned(b)
                score[doc] += _unsigned(s)
                known[doc] += n.astype(np.int64)
        return pa.table({
            "_id": ids, "held_out": pa.array(held), "n_tokens": pa.array(size.astype(np.int64)), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(size), int(n_tokens))), "base_score": pa.array(base / FIXED - size * each), "score": pa.array(score / FIXED),
        })

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, discount: float = 0.8, strength: float = 1.0, burn: int = 2, keep: int = 4, seed: int = 5) -> DataFrame:
    """The id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32 of the id as text is 0 modulo `folds` are held out of training.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1)).first()[0] or 0
    n = max(2, -(-size // BUCKET_BYTES))  # groups of a partition are worked on one after the other
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds != 0).alias("train"), F.col(text_col).alias("_text"))
    met = rows.mapInArrow(_send(n), ROW).groupBy("bucket").applyInArrow(_by_word(n), ROW)
    met = Stored(met, "word-pairs").df
    _let_go(spark)
    infos, totals = upward(met, n, discount, strength, burn, keep, seed)
    parts = met.where(F.col("kind") == ENTRIES).unionAll(infos).groupBy("bucket").applyInArrow(_by_context(totals, discount, strength, burn, keep, seed), ROW)
    out = parts.unionAll(met.where(F.col("kind") == DOCS)).groupBy("flush").applyInArrow(
        _together(totals, kind), f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumnRenamed("_id", id_col)


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, tokens, perplexity and base_perplexity of the texts on either side."""
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("tokens"),
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"),
    )
