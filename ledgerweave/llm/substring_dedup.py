"""Substring dedup by difference-cover anchors.

A repeated run of ``length`` words is found without sorting all windows: word
hashes are taken only at positions whose remainder modulo a period lies in a
difference cover, so that two copies of a run, however aligned, share an anchor
at the same distance from their starts.  Anchors that two documents share are
extended to whole windows, and of equal windows the one in the document with
the smallest id stays.

Anchor keys may clash (that costs one needless extension); window keys have 80
bits below the bits that choose the bucket.

Nulls and special cases: null text is empty; a null doc_id ranks after every
number; equal ids never remove each other; rows are told apart by id and text,
so repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerweave.llm._store import Stored, n_partitions
from ledgerweave.llm._words import U64, Words, groups, narrow, pack, pieces, planes, unpack, unplanes, windows

#: Perfect difference covers: period -> positions.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
NO_ID = 2**63 - 1


class _Found:
    """Keys of one task: (key, second key, document, position)."""

    def __init__(self):
        self.parts, self.ids, self.prints = [], [], []

    def add(self, ids, prints, key, extra, row, pos):
        base = sum(map(len, self.ids))
        self.ids.append(np.asarray(ids, dtype=np.int64))
        self.prints.append(np.asarray(prints, dtype=np.int64))
        self.parts.append((key, extra, (row + base).astype(np.uint32), pos.astype(np.uint32)))

    def blobs(self, n_buckets: int, smaller: bool):
        """A row per bucket: what it must be asked, and what this task knows of its own documents.

        smaller: False asks whether another document has the key; True whether one with a smaller id has.
        """
        if not self.parts:
            return
        key, extra, row, pos = (np.concatenate(x) for x in zip(*self.parts))
        ids, prints = np.concatenate(self.ids), np.concatenate(self.prints)
        order = np.lexsort((pos, row, ids[row], extra, key)) if smaller else np.lexsort((pos, row, key))
        key, extra, row, pos = key[order], extra[order], row[order], pos[order]
        at = np.concatenate(([True], (key[1:] != key[:-1]) | (extra[1:] != extra[:-1]))) if len(key) else np.zeros(0, bool)
        group = np.cumsum(at) - 1
        begin = np.flatnonzero(at)
        if smaller:
            known = ids[row] > ids[row[begin]][group]  # a smaller id is here
            ask = ~known
        else:
            low, high = np.minimum.reduceat(row, begin), np.maximum.reduceat(row, begin)
            known = (low != high)[group]
            ask = ~known
            ask[begin] = True  # the others must hear of it
        bucket = ((key >> U64(40)) * U64(n_buckets) >> U64(24)).astype(np.int64)
        local_bucket = row % n_buckets
        order = np.lexsort((pos, row, bucket))
        order = order[ask[order]]
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        mine = np.flatnonzero(known)
        mine = mine[np.lexsort((pos[mine], row[mine], local_bucket[mine]))]
        edges2 = np.searchsorted(local_bucket[mine], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            q, k = order[edges[b] : edges[b + 1]], mine[edges2[b] : edges2[b + 1]]
            if not len(q) and not len(k):
                continue
            rows, n = np.unique(row[q], return_counts=True)
            krows, kn = np.unique(row[k], return_counts=True)
            step = np.diff(pos[q].astype(np.int64), prepend=0)
            yield b, pack(
                (ids[rows], prints[rows], narrow(n)),
                planes(key[q], 8 if smaller else 5),
                planes(extra[q], 2) if smaller else None,
                _fold(step),
                known[q] if not smaller else None,
                (ids[krows], prints[krows], narrow(kn), narrow(pos[k])),
            )


def _fold(x: np.ndarray) -> np.ndarray:
    return narrow(np.where(x >= 0, 2 * x, -2 * x - 1).astype(np.uint64))


def _unfold(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return np.where(x & 1, -(x + 1) // 2, x // 2)


def _answers(blobs: list[bytes], smaller: bool, n_to: int) -> pa.Table:
    """Per document, the positions whose key another (smaller) document has; packed by where the document goes."""
    cols, out = [], []
    for blob in blobs:
        (ids, prints, n), key, extra, step, known, (kids, kprints, kn, kpos) = unpack(blob)
        at = np.cumsum(kn.astype(np.int64))
        for i, p, x in zip(kids, kprints, np.split(kpos, at[:-1]) if len(kids) else []):
            out.append((int(i), int(p), x))
        n = n.astype(np.int64)
        cols.append((np.repeat(ids, n), np.repeat(prints, n), unplanes(key), unplanes(extra) if smaller else None, np.cumsum(_unfold(step)), known))
    if cols:
        ids, prints, key = (np.concatenate([c[k] for c in cols]) for k in range(3))
        pos = np.concatenate([c[4] for c in cols])
        if smaller:
            extra = np.concatenate([c[3] for c in cols])
            order = np.lexsort((ids, extra, key))
            key, extra = key[order], extra[order]
            at = np.concatenate(([True], (key[1:] != key[:-1]) | (extra[1:] != extra[:-1]))) if len(key) else np.zeros(0, bool)
            hit = ids[order] > ids[order][np.flatnonzero(at)][np.cumsum(at) - 1] if len(key) else np.zeros(0, bool)
        else:
            known = np.concatenate([c[5] for c in cols])
            order = np.argsort(key, kind="stable")
            begin = groups(key[order])
            if len(begin):
                who = ids[order] ^ prints[order]
                many = np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin)
                many |= np.logical_or.reduceat(known[order], begin)
                size = np.diff(np.append(begin, len(key)))
                hit = np.repeat(many, size) & ~known[order]
            else:
                hit = np.zeros(0, bool)
        pick = order[hit]
        pick = pick[np.lexsort((pos[pick], prints[pick], ids[pick]))]
        if len(pick):
            i, p, x = ids[pick], prints[pick], pos[pick]
            cut = np.flatnonzero((i[1:] != i[:-1]) | (p[1:] != p[:-1])) + 1
            for part, at in zip(np.split(x, cut), np.concatenate(([0], cut))):
                out.append((int(i[at]), int(p[at]), part))
    to: dict = {}
    for i, p, x in out:
        to.setdefault((i ^ p) % n_to, []).append((i, p, x))
    return pa.table({
        "bucket": pa.array(list(to), pa.int32()),
        "blob": pa.array([pack([x[0] for x in v], [x[1] for x in v], [narrow(x[2]) for x in v]) for v in to.values()], pa.binary()),
    })


def _delivered(table: pa.Table) -> pa.Table:
    """A row per document from the packed answers of all buckets."""
    at: dict = {}
    for blob in table.column("blob").to_pylist():
        for i, p, x in zip(*unpack(blob)):
            at.setdefault((i, p), []).append(x)
    return pa.table({
        "rank": pa.array([k[0] for k in at], pa.int64()),
        "print": pa.array([k[1] for k in at], pa.int64()),
        "at": pa.array([np.unique(np.concatenate(v)).astype("<u4").tobytes() for v in at.values()], pa.binary()),
    })


def _anchors(cover, period, length, n_buckets):
    width = length - period + 1
    inside = np.zeros(period, dtype=bool)
    inside[list(cover)] = True

    def run(batches):
        found = _Found()
        for batch in batches:
            ids, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, rows in pieces(batch.column(2)):
                w = Words(rows)
                if len(w) < length:
                    continue
                text = w.text_of()
                at = np.arange(len(w)) - w.first[text]
                n = np.diff(w.first)[text]
                h = windows(w.hashes(), width)
                ok = np.flatnonzero(inside[at % period] & (at + width <= n) & (n >= length))
                found.add(ids[first : first + len(rows)], prints[first : first + len(rows)], h[ok], np.zeros(len(ok), np.uint64), text[ok], at[ok])
        yield from _rows(found.blobs(n_buckets, False))

    return run


def _rows(blobs):
    for b, blob in blobs:
        yield pa.record_batch([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])


def _marked(column, first, rows):
    """For each text, the positions sent for it."""
    return [np.frombuffer(x, "<u4").astype(np.int64) for x in column.slice(first, len(rows)).to_pylist()]


def _extend(period, length, n_buckets):
    def run(batches):
        found = _Found()
        for batch in batches:
            ids, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, rows in pieces(batch.column(2)):
                w = Words(rows)
                if len(w) < length:
                    continue
                marks = _marked(batch.column(3), first, rows)
                near = np.zeros(len(w) + 1, dtype=np.int32)
                for t, m in enumerate(marks):
                    if len(m):
                        np.add.at(near, w.first[t] + np.maximum(m - period + 1, 0), 1)
                        np.add.at(near, w.first[t] + m + 1, -1)
                text = w.text_of()
                at = np.arange(len(w)) - w.first[text]
                ok = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (at + length <= np.diff(w.first)[text]))
                h = w.hashes()
                found.add(ids[first : first + len(rows)], prints[first : first + len(rows)], windows(h, length)[ok], windows(h, length, 1)[ok] & U64(0xFFFF), text[ok], at[ok])
        yield from _rows(found.blobs(n_buckets, True))

    return run


def _cut(length, with_text):
    """For each text: n_words, n_removed, kept_sha256 and the kept text; `at` is absent where nothing goes."""

    def run(batches):
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("text", "at")]
            marked = "at" in batch.schema.names
            n_words, n_removed, sha, kept_text = [], [], [], []
            for first, rows in pieces(batch.column("text")):
                w = Words(rows)
                gone = np.zeros(len(w) + 1, dtype=np.int32)
                for t, m in enumerate(_marked(batch.column("at"), first, rows) if marked else []):
                    np.add.at(gone, w.first[t] + m, 1)
                    np.add.at(gone, w.first[t] + m + length, -1)
                keep = np.cumsum(gone)[:-1] == 0
                joined, off = w.spaced(keep)
                kept_at = np.concatenate(([0], np.cumsum(keep)))[w.first]
                for t in range(len(rows)):
                    a, b = off[kept_at[t]], off[kept_at[t + 1]]
                    x = joined[a : max(a, b - 1)]
                    sha.append(hashlib.sha256(x).hexdigest())
                    kept_text.append(x.decode() if with_text else None)
                n_words += np.diff(w.first).tolist()
                n_removed += (np.diff(w.first) - np.diff(kept_at)).tolist()
            yield pa.record_batch(
                [batch.column(n) for n in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())] + ([pa.array(kept_text, pa.string())] if with_text else []),
                names=[*names, *_OUT, *(["kept_text"] if with_text else [])],
            )

    return run


_OUT = ("n_words", "n_removed", "kept_sha256")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, period: int = 7, with_text: bool = False) -> DataFrame:
    """Remove words covered by a `length`-word window that a document with a smaller id has too.

    Returns the id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.
    Texts cross the network once, to meet the anchors they share; those that
    share any are kept in the shared folder for the second meeting.
    """
    if period not in COVERS or period > length:
        raise ValueError(f"period must be one of {sorted(COVERS)} and at most the length")
    n = n_partitions(docs.sparkSession)
    all_rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rank"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("print"),
        F.col(text_col).alias("text"),
    )
    rows = all_rows.select("rank", "print", "text").where(F.length("text") >= 2 * length - 1)  # shorter texts have no window

    def ask(stage: DataFrame, smaller: bool) -> DataFrame:
        def answer(table: pa.Table) -> pa.Table:
            return _answers(table.column("blob").to_pylist(), smaller, n)

        told = stage.groupBy("bucket").applyInArrow(answer, "bucket int, blob binary")
        return told.groupBy("bucket").applyInArrow(_delivered, "rank long, print long, at binary")

    shared = ask(rows.mapInArrow(_anchors(COVERS[period], period, length, n), "bucket int, blob binary"), False)
    near = Stored(rows.join(shared, ["rank", "print"]), "near", compression="zstd").df
    gone = ask(near.mapInArrow(_extend(period, length, n), "bucket int, blob binary"), True)
    extra = ", n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    cut = near.drop("at").join(gone, ["rank", "print"]).select("rank", "print", "text", "at").mapInArrow(_cut(length, with_text), "rank long, print long" + extra)
    new = [*_OUT[1:], *(["kept_text"] if with_text else [])]
    changed = cut.dropDuplicates(["rank", "print"]).select("rank", "print", *(F.col(c).alias(f"_{c}") for c in new))
    kind = docs.schema[id_col].dataType.simpleString()
    whole = all_rows.mapInArrow(_cut(length, with_text), f"id {kind}, rank long, print long" + extra)
    return whole.join(changed, ["rank", "print"], "left").select(
        F.col("id").alias(id_col), "n_words", *(F.coalesce(f"_{c}", c).alias(c) for c in new)
    )
