"""Secret scan by one combined automaton.

All rules are compiled into one deterministic byte automaton that reads each
text once and says which rules may match in it; for this automaton alone, a rule
is read up to its first long run and `CAP` characters of that, as long runs of
many rules at once would multiply its states.  For those texts and rules the exact spans, leftmost and longest and
not overlapping per kind, are walked by the rule's own minimal automaton, which
is compiled from the same rule.

Nulls and special cases: null text is empty and has no spans; a null id stays
null; spans of one rule never overlap, those of different rules may; repeated
rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerweave.llm._words import give_back_memory, pieces
from ledgerweave.llm.automaton import Automaton

#: Bytes of text whose rows are walked together.
SCAN_BYTES = 16 << 20
CAP = 3


@dataclass(frozen=True)
class Rule:
    """A span is a head and a run after it; only spans whose run has `least` characters count, but all of them take their place."""

    kind: str
    head: str
    run: str = ""
    least: int = 0
    fold: bool = False
    cap: int = CAP

    @property
    def pattern(self) -> str:
        return self.head + (f"{self.run}+" if self.run else "")

    @property
    def counted(self) -> str:
        """What a span that counts has in it."""
        return self.head + (f"{self.run}{{{self.least},}}" if self.run else "")


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]", 12, fold=True),
    Rule("access", r"AKIA", r"[A-Z0-9]", 14),
    Rule("hex", r"", r"[0-9a-f]", 16, cap=16),
)
MORE = (
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", 36),
    Rule("github_pat", r"github_pat_", r"[A-Za-z0-9_]", 22),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9\-]", 10),
    Rule("google", r"AIza", r"[0-9A-Za-z_\-]", 35),
    Rule("stripe", r"[sr]k_live_", r"[0-9A-Za-z]", 16),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.", r"[A-Za-z0-9_\-]", 8),
    Rule("pem", r"\-\-\-\-\-BEGIN [A-Z ]*PRIVATE KEY\-\-\-\-\-"),
    Rule("url", r"://[^\s:@/]+:[^\s:@/]{3,}@"),
)


class Scanner:
    """The combined automaton, and each rule's own: of whole spans and of heads."""

    def __init__(self, rules):
        self.rules = rules
        self.all = Automaton([(r.counted, r.fold, r.cap) for r in rules])
        self.own = [Automaton([(r.pattern, r.fold)], anchored=True) for r in rules]
        self.heads = [Automaton([(r.head, r.fold)], anchored=True) if r.head and r.run else None for r in rules]

    def spans(self, text: bytes, bits: int) -> list[tuple[int, int, int]]:
        """(start, rule number, end) of every span that counts, in code points."""
        out = []
        for r, rule in enumerate(self.rules):
            if bits >> r & 1:
                for start, end in self.own[r].spans(text):
                    head = self.heads[r].longest(text, start) if self.heads[r] else start
                    if end - head >= rule.least:
                        out.append((start, r, end))
        if out and not text.isascii():
            inside = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) == 0x80)  # bytes that go on a character
            points = lambda at: at - (int(inside[at - 1]) if at else 0)
            out = [(points(a), r, points(b)) for a, r, b in out]
        return sorted(out)


def _scan(scanner: Scanner, n_base: int):
    rules = scanner.rules

    def run(batches):
        give_back_memory()
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts = [[] for _ in range(n_base)]
            digests, texts = [], []
            for _, rows in pieces(batch.column(batch.num_columns - 1), SCAN_BYTES):
                for row, bits in zip(rows, scanner.all.matched(rows).tolist()):
                    found = scanner.spans(row, bits) if bits else []
                    said = [f"{rules[r].kind}:{a}:{b}" for a, r, b in found]
                    for k in range(n_base):
                        counts[k].append(sum(r == k for _, r, _ in found))
                    base = ",".join(s for s, (_, r, _) in zip(said, found) if r < n_base)
                    digests.append(hashlib.sha256(base.encode()).hexdigest() if base else empty)
                    texts.append(",".join(said))
            yield pa.record_batch(
                [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=[*batch.schema.names[:-1], *(f"n_{r.kind}" for r in rules[:n_base]), "base_sha256", "spans"],
            )

    return run


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, more=MORE) -> DataFrame:
    """The id, a count per base rule, base_sha256 and spans (kind:start:end, comma-joined)."""
    scanner = Scanner((*base, *more))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{r.kind} long" for r in base) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_scan(scanner, len(base)), schema)
