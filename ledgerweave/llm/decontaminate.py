"""Benchmark decontamination by a BM25 index with block-max pruning.

The test items are indexed with BM25 impacts, each item's scaled so that a
passage with all its terms scores 1.  Every passage of every text (windows of
two strides) is a query.  As in block-max WAND, the largest impact of a term in
each block of items bounds what a block can still reach; blocks below the
threshold are skipped and only the others are scored in full, for all passages
of a batch at once.  Hits are then verified by shared word shingles of the
whole item, of its question and of its answer (its last sentence).

The index is cut into shards of at most `SHARD` items of like length, so that a
passage always has room for an item, and holds postings, not a matrix: about
six times the size of the items' text.  It is sent to the tasks in groups of at
most `SENT_BYTES`, measured, one pass over the documents per group; the driver
holds the whole of it.

Words are runs of characters other than blanks, in any script; only ASCII letters
are brought to lower case and only ASCII marks are cut off around words.

Nulls and special cases: null or blank texts and items, and items of nothing but
ASCII marks, match nothing; a null id stays null; item ids may be of any type;
an item found in several passages of a text gives one row, the best; repeated
rows give repeated results; empty tables give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerweave.llm._words import U64, Words, give_back_memory, groups, pieces, windows

SHARD, BLOCK = 256, 16
#: Bytes of item text of a shard, and of index sent at once (more only where one shard has more).
SHARD_BYTES, SENT_BYTES = 1 << 20, 16 << 20
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def terms_of(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, lower-case and without marks around them, and where each text's begin."""
    w = Words(rows, lower=True)
    mark, at = _PUNCT[w.buf], np.arange(len(w.buf), dtype=np.int32)
    after = np.minimum.accumulate(np.where(mark, np.int32(len(at)), at)[::-1])[::-1]  # the next byte that isn't a mark
    before = np.maximum.accumulate(np.where(mark, np.int32(-1), at))
    s = np.minimum(after[w.starts], w.ends)
    e = np.maximum(before[w.ends - 1] + 1, s)
    w.starts, w.ends = s, e
    h = w.hashes()
    keep = e > s
    return h[keep], np.concatenate(([0], np.cumsum(keep)))[w.first]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last line or sentence is the answer; of a single sentence, its last quarter."""
    text = text.strip()
    for pattern in (r"\n+", r"(?<=[.!?])\s+"):
        parts = re.split(pattern, text)
        if len(parts) > 1 and len(parts[-1].split()) >= 3:
            return text[: len(text) - len(parts[-1])].strip(), parts[-1]
    words = text.split()
    cut = max(1, len(words) * 3 // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    return np.unique(windows(h, min(k, len(h)))) if len(h) else np.empty(0, np.uint64)


def _spread(first: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, its number of entries, and the places of all of them."""
    n = first[key + 1] - first[key]
    return n, np.repeat(first[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Shard:
    """An inverted index of items (id, text): postings of each term, and its largest impact in each block of items."""

    def __init__(self, items: list, k1: float = 1.2, b: float = 0.75, shingle: int = 5):
        self.ids = [i for i, _ in items]
        h, first = terms_of([t.encode() for _, t in items])
        size = np.diff(first)
        self.stride = max(64, int(size.max()))
        item = np.repeat(np.arange(len(items)), size)
        self.vocab, term = np.unique(h, return_inverse=True)
        pair, tf = np.unique(term * len(items) + item, return_counts=True)
        t, i = pair // len(items), pair % len(items)
        n = np.bincount(t, minlength=len(self.vocab))
        idf = np.log(1 + (len(items) - n + 0.5) / (n + 0.5))
        impact = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[i] / max(size.mean(), 1)))
        whole = np.bincount(i, weights=impact, minlength=len(items))
        self.item, self.impact = i.astype(np.uint16), (impact / np.maximum(whole[i], 1e-9)).astype(np.float32)
        self.first = np.searchsorted(t, np.arange(len(self.vocab) + 1))
        self.n_blocks = -(-len(items) // BLOCK)
        at = groups(t * self.n_blocks + i // BLOCK)
        self.block, self.most = (i[at] // BLOCK).astype(np.uint16), np.maximum.reduceat(self.impact, at)
        self.block_first = np.searchsorted(t[at], np.arange(len(self.vocab) + 1))
        self.parts = []
        for _, text in items:
            q, a = split_item(text)
            hashes = [terms_of([x.encode()])[0] for x in (text, q, a)]
            self.parts.append(tuple((_shingles(x, shingle), min(shingle, len(x))) for x in hashes))

    def nbytes(self) -> int:
        arrays = (self.vocab, self.item, self.impact, self.first, self.block, self.most, self.block_first)
        return sum(x.nbytes for x in arrays) + sum(x.nbytes for p in self.parts for x, _ in p)

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of words that have postings, and their terms."""
        if "known" not in self.__dict__:  # made in the task, not sent
            self.known = np.zeros(1 << 20, dtype=bool)
            self.known[self.vocab & U64((1 << 20) - 1)] = True
        ok = np.flatnonzero(self.known[h & U64((1 << 20) - 1)])
        term = np.searchsorted(self.vocab, h[ok])
        same = self.vocab[np.minimum(term, len(self.vocab) - 1)] == h[ok]
        return ok[same], term[same]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def hits(self, h: np.ndarray, first: np.ndarray, threshold: float, pruned: bool = True):
        """(text, first word, last word, item, score) of every passage and item at or above the threshold."""
        stride, least = self.stride, threshold - 1e-4 if pruned else -1
        at = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        n_seg = -(-np.diff(first) // stride)
        seg_first = np.concatenate(([0], np.cumsum(n_seg)))
        n = int(seg_first[-1])
        ok, term = self.terms(h)
        pair = np.unique((seg_first[text[ok]] + at[ok] // stride) * len(self.vocab) + term)
        seg, term = pair // len(self.vocab), pair % len(self.vocab)
        if not len(seg):
            return []
        # bounds by segment and block; a passage is a segment and the next of the same text
        times, place = _spread(self.block_first, term)
        bound = np.bincount(np.repeat(seg, times) * self.n_blocks + self.block[place], weights=self.most[place], minlength=n * self.n_blocks).reshape(n, -1)
        goes_on = np.ones(n, dtype=bool)
        goes_on[seg_first[1:][n_seg > 0] - 1] = False
        passage = bound.copy()
        passage[:-1][goes_on[:-1]] += bound[1:][goes_on[:-1]]
        live = passage >= least
        # in blocks that may reach the threshold, each item's own bound, counting a term of both segments twice
        need = live.copy()
        need[1:][goes_on[:-1]] |= live[:-1][goes_on[:-1]]
        some = need.any(axis=1)
        number = np.cumsum(some) - 1
        mine = np.flatnonzero(some[seg])
        times, place = _spread(self.first, term[mine])
        row = np.repeat(seg[mine], times)
        use = need[row, self.item[place] // BLOCK]
        row, place = number[row[use]], place[use]
        sums = np.bincount(row * len(self.ids) + self.item[place], weights=self.impact[place], minlength=int(some.sum()) * len(self.ids)).reshape(-1, len(self.ids))
        p = np.flatnonzero(live.any(axis=1))
        both = sums[number[p]]
        both[goes_on[p]] += sums[number[p[goes_on[p]] + 1]]
        r, near = np.nonzero((both >= least) & live[p][:, np.arange(len(self.ids)) // BLOCK])
        seg_at = np.searchsorted(seg, np.arange(n + 1))
        seg_text = np.repeat(np.arange(len(n_seg)), n_seg)
        out = []
        cut = np.append(groups(r), len(r))
        for x, y in zip(cut[:-1], cut[1:]):
            k = int(p[r[x]])
            mine = np.unique(term[seg_at[k] : seg_at[k + 1 + goes_on[k]]])
            t = int(seg_text[k])
            begin = int(first[t] + (k - seg_first[t]) * stride)
            end = int(min(first[t + 1], begin + 2 * stride))
            _, place = _spread(self.first, mine)
            scores = np.bincount(self.item[place], weights=self.impact[place], minlength=len(self.ids))[near[x:y]]
            for c in np.flatnonzero(scores >= threshold):
                out.append((t, begin, end, int(near[x + c]), float(scores[c])))
        return out

    def overlaps(self, h: np.ndarray, item: int) -> list[float]:
        """Shares of the shingles of the whole item, its question and its answer that are among these words."""
        out = []
        for shingles, k in self.parts[item]:
            out.append(float(np.isin(shingles, windows(h, k)).mean()) if len(shingles) else 1.0)
        return out


def _found(shards: list[Shard], texts: pa.Array, threshold: float, least: float, least_part: float) -> list[tuple]:
    """(row, item id, score, overlaps) of every text and item that it holds."""
    out = []
    for first_row, rows in pieces(texts):
        h, first = terms_of(rows)
        for shard in shards:
            best: dict = {}
            for t, begin, end, item, score in shard.hits(h, first, threshold):
                lo, hi = max(first[t], begin - shard.stride), min(first[t + 1], end + shard.stride)
                whole, q, a = shard.overlaps(h[lo:hi], item)
                if whole >= least and q >= least_part and a >= least_part:
                    best[t, item] = max(best.get((t, item), (0,)), (score, whole, q, a))
            out += [(first_row + t, shard.ids[i], *v) for (t, i), v in best.items()]
    return out


def _without_hits(shards: list[Shard], text_col: str, *limits: float):
    def run(batches):
        give_back_memory()
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[[x[0] for x in _found(shards, batch.column(batch.schema.get_field_index(text_col)), *limits)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _search(shards: list[Shard], item_type: pa.DataType, threshold: float, least: float, least_part: float):
    def run(batches):
        give_back_memory()
        for batch in batches:
            ids = batch.column(0)
            out = _found(shards, batch.column(1), threshold, least, least_part)
            yield pa.record_batch(
                [ids.take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], item_type), *(pa.array([x[k] for x in out], pa.float64()) for k in (2, 3, 4, 5))],
                names=["_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"],
            )

    return run


def _item_groups(items: DataFrame, item_col: str, item_text_col: str) -> list[list[Shard]]:
    """Shards of the items that have a term, by length, in groups for one pass each."""
    known = items.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where(F.col("t").rlike(r"[^\x20\x09-\x0D]")).orderBy(F.length("t"), "i")
    out, sent, held, size = [], SENT_BYTES + 1, [], 0

    def close():
        nonlocal sent, held, size
        if held:
            shard = Shard(held)
            if sent + shard.nbytes() > SENT_BYTES:
                out.append([])
                sent = 0
            out[-1].append(shard)
            sent += shard.nbytes()
            held, size = [], 0

    for r in known.toLocalIterator():
        text = r.t.encode()
        if not len(terms_of([text])[0]):  # nothing but marks
            continue
        if len(held) == SHARD or (held and size + len(text) > SHARD_BYTES):
            close()
        held.append((r.i, r.t))
        size += len(text)
    close()
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, overlap: float = 0.8, part_overlap: float = 0.5) -> DataFrame:
    """A row per text and item that it holds: the id, item_id, BM25 score and the overlaps.

    A hit has at least `overlap` of the item's five-word shingles and at least
    `part_overlap` of its question's and of its answer's.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType
    schema = f"_id {kind}, item_id {item_kind.simpleString()}, score double, overlap double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = None
    for group in _item_groups(items, item_col, item_text_col) or [[]]:
        part = rows.mapInArrow(_search(group, to_arrow_type(item_kind), threshold, overlap, part_overlap), schema)
        found = part if found is None else found.unionAll(part)
    return found.withColumnRenamed("_id", id_col)


def keep_uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, overlap: float = 0.8, part_overlap: float = 0.5) -> DataFrame:
    """The rows of docs without a hit, all columns kept, judged row by row: ids may be null or shared."""
    schema, out = docs.schema, docs
    for group in _item_groups(items, item_col, item_text_col):
        out = out.mapInArrow(_without_hits(group, text_col, threshold, overlap, part_overlap), schema)
    return out
