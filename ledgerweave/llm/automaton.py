"""Rule regexes compiled into one minimal deterministic byte automaton.

The accepted syntax is what secret rules need: literals, escapes, classes,
groups, alternation and the quantifiers ``? * + {m} {m,n} {m,}``.  Rules are
joined into one automaton by subset construction, minimised by partition
refinement and stored as a transition array; an accepting state carries a bit
per rule.

A scanning automaton lets a match begin anywhere.  An anchored one reads from a
given byte on and tells the longest match from there.
"""

from __future__ import annotations

import numpy as np

_ESCAPES = {"n": {10}, "t": {9}, "r": {13}, "f": {12}, "v": {11}, "d": set(range(48, 58)), "s": {9, 10, 11, 12, 13, 32}, "w": {*range(48, 58), *range(65, 91), *range(97, 123), 95}}


class _Parser:
    """Builds a nondeterministic automaton: moves are (from, set of bytes, to), skips are (from, to)."""

    def __init__(self, fold: bool, cap: int | None = None):
        self.fold, self.cap, self.moves, self.skips, self.n, self.depth = fold, cap, [], [], 0, 0

    def state(self) -> int:
        self.n += 1
        return self.n - 1

    def parse(self, text: str) -> tuple[int, int]:
        self.text, self.at = text, 0
        out = self.choice()
        if self.at != len(text):
            raise ValueError(f"cannot read the rule at {self.at}: {text!r}")
        return out

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def choice(self) -> tuple[int, int]:
        begin, end = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.skips += [(begin, a), (b, end)]
            if self.peek() != "|":
                return begin, end
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        begin = end = self.state()
        while self.peek() not in ("", "|", ")"):
            mark = self.at
            a, b = self.atom()
            low, high = self.quantifier()
            wide = self.text[self.at - 1] != "?" and len(self.moves[-1][1]) > 2
            cut = self.cap is not None and not self.depth and (max(low, high or 0) > self.cap or (high is None and wide))
            if cut:
                low = high = min(low, self.cap)
            parts = [(a, b)]
            stop = self.at
            for _ in range(max(low, high or 1) - 1):
                self.at = mark
                parts.append(self.atom())
            self.at = stop
            out = self.state()
            here = end
            for k, (x, y) in enumerate(parts):
                if k >= low:
                    self.skips.append((here, out))
                self.skips.append((here, x))
                here = y
            if high is None:
                self.skips.append((parts[-1][1], parts[-1][0]))
            if high != 0:
                self.skips.append((here, out))
            end = out
            if cut:
                self.at = len(self.text)
        return begin, end

    def quantifier(self) -> tuple[int, int | None]:
        c = self.peek()
        if c in "?*+" and c:
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            stop = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : stop].partition(",")
            self.at = stop + 1
            return int(low), int(high) if high else None if comma else int(low)
        return 1, 1

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        self.at += 1
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            self.depth += 1
            out = self.choice()
            self.depth -= 1
            self.at += 1
            return out
        chars = self.klass() if c == "[" else self.escape() if c == "\\" else (set(range(256)) - {10}) if c == "." else None
        begin = end = self.state()
        for s in [chars] if chars is not None else [{x} for x in c.encode()]:
            if self.fold:
                s = s | {x ^ 32 for x in s if 65 <= x & ~32 <= 90}
            nxt = self.state()
            self.moves.append((end, frozenset(s), nxt))
            end = nxt
        return begin, end

    def escape(self) -> set[int]:
        c = self.peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return {int(self.text[self.at - 2 : self.at], 16)}
        return set(_ESCAPES.get(c, {ord(c)}))

    def klass(self) -> set[int]:
        negate = self.peek() == "^"
        self.at += negate
        out: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.peek()
            self.at += 1
            one = self.escape() if c == "\\" else {ord(c)}
            if len(one) == 1 and self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                c = self.peek()
                self.at += 1
                stop = self.escape() if c == "\\" else {ord(c)}
                one = set(range(min(one), min(stop) + 1))
            out |= one
        self.at += 1
        return set(range(256)) - out if negate else out


class Automaton:
    """table[state * 256 + byte] is the next state; accepts[state] has bit r set where rule r has just matched.

    A rule is its text, whether case is ignored and, optionally, a cap: the rule is then read up to its first run of a class that is
    unbounded or longer than the cap, and of that run no more than the cap, so the automaton stays small and matches wherever the rule does.
    """

    def __init__(self, rules: list[tuple], anchored: bool = False):
        nfa: list = []
        skips: list = []
        starts, ends, base = [], {}, 0
        for r, (text, *how) in enumerate(rules):
            p = _Parser(*how)
            a, b = p.parse(text)
            nfa += [(x + base, s, y + base) for x, s, y in p.moves]
            skips += [(x + base, y + base) for x, y in p.skips]
            starts.append(a + base)
            ends[b + base] = 1 << r
            base += p.n
        table, accepts = self._subsets(nfa, skips, starts, ends, base, anchored)
        self.table, self.accepts = self._minimal(table, accepts)
        self.first_accepting = int(np.argmax(self.accepts != 0)) if self.accepts.any() else len(self.accepts)

    @staticmethod
    def _subsets(moves, skips, starts, ends, n, anchored):
        by: list = [[] for _ in range(n)]
        for x, s, y in moves:
            by[x].append((s, y))
        free: list = [[] for _ in range(n)]
        for x, y in skips:
            free[x].append(y)

        def close(states):
            seen, todo = set(states), list(states)
            while todo:
                for y in free[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return seen

        # bytes that no rule tells apart are one class
        splits = {s for _, s, _ in moves}
        kinds: dict = {}
        for b in range(256):
            kinds.setdefault(frozenset(i for i, s in enumerate(splits) if b in s), []).append(b)
        origin = close(starts)
        again = set() if anchored else origin
        useful = lambda states: frozenset(x for x in states if by[x] or x in ends)
        number = {useful(origin): 0}
        order, rows, accepts = [useful(origin)], [], []
        for now in order:  # grows while it is read
            accepts.append(sum({ends[x] for x in now if x in ends}))
            row = np.zeros(256, dtype=np.int64)
            for members in kinds.values():
                nxt = useful(close({y for x in now for s, y in by[x] if members[0] in s}) | again)
                if nxt not in number:
                    number[nxt] = len(order)
                    order.append(nxt)
                row[members] = number[nxt]
            rows.append(row)
        return np.array(rows), np.array(accepts, dtype=np.int64)

    @staticmethod
    def _minimal(table, accepts):
        _, part = np.unique(accepts, return_inverse=True)
        while True:
            _, new = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
            new = new.reshape(-1)
            if new.max() == part.max():
                break
            part = new
        # the start state is number 0, and accepting states come last
        first = np.zeros(part.max() + 1, dtype=np.int64)
        first[part[::-1]] = np.arange(len(part))[::-1]
        order = np.lexsort((np.arange(len(first)) != part[0], accepts[first] != 0))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        first = first[order]
        return rank[part[table[first]]].astype(np.int32).reshape(-1), accepts[first]

    def __len__(self) -> int:
        return len(self.accepts)

    def matched(self, rows: list[bytes], lanes: int = 1 << 15, few: int = 128) -> np.ndarray:
        """For each text, the bits of the rules that match somewhere in it, in one pass over its bytes.

        Texts are walked in step, one byte of each at a time, longest first;
        when few are left, each is finished alone.
        """
        out = np.zeros(len(rows), dtype=np.int64)
        lens = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        buf = np.frombuffer(b"".join(rows) + b"\0", dtype=np.uint8)
        begin = np.cumsum(lens) - lens
        flat = [x << 8 for x in self.table.tolist()]
        bits, accepting = self.accepts.tolist(), self.first_accepting << 8
        order = np.argsort(-lens, kind="stable")
        for k in range(0, len(order), lanes):
            lane = order[k : k + lanes]
            n, at = lens[lane], begin[lane]
            state = np.zeros(len(lane), dtype=np.int32)
            hit = np.zeros(len(lane), dtype=np.int64)
            longest = int(n[0]) if len(n) else 0
            live = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")
            steps = int(np.searchsorted(-live, -few, side="right"))  # as long as enough lanes are left
            for j in range(steps):
                m = live[j]
                s = self.table[(state[:m] << 8) + buf[at[:m] + j]]
                state[:m] = s
                hit[:m] |= self.accepts[s]
            for i in range(int(live[steps]) if steps < longest else 0):
                now, found = int(state[i]) << 8, int(hit[i])
                for b in rows[lane[i]][steps:]:
                    now = flat[now + b]
                    if now >= accepting:
                        found |= bits[now >> 8]
                hit[i] = found
            out[lane] = hit
        return out

    def _anchored(self):
        """The table as a list of offsets, the first accepting offset, the offset from which nothing matches any more, and the bytes that may begin a match."""
        if "walk" not in self.__dict__:
            table = self.table.reshape(-1, 256)
            dead = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (self.accepts == 0))
            sink = int(dead[0]) if len(dead) else -1
            self.walk = [x << 8 for x in self.table.tolist()], self.first_accepting << 8, sink << 8, table[0] != sink
        return self.walk

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "walk"}

    def longest(self, text: bytes, start: int = 0) -> int:
        """Where the longest match that begins at start ends, or -1."""
        flat, accepting, sink, _ = self._anchored()
        now, last = 0, start if self.accepts[0] else -1
        for at in range(start, len(text)):
            now = flat[now + text[at]]
            if now >= accepting:
                last = at + 1
            elif now == sink:
                break
        return last

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """Leftmost longest matches that don't overlap, none of them empty."""
        begins = self._anchored()[3]
        out, end = [], 0
        for start in np.flatnonzero(begins[np.frombuffer(text, dtype=np.uint8)]).tolist():
            if start >= end:
                stop = self.longest(text, start)
                if stop > start:
                    out.append((start, stop))
                    end = stop
        return out
