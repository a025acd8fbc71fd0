"""Secrets in texts, found by one automaton for all rules."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from chirrup.llm.common import byte_sizes, kept_by_worker, map_batches, packed, slices, unpacked, utf8

#: Rules: kind, pattern, a group (0: the whole match) and its least length.  Fixed values; the first three are the base.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
    ("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
)
BASE = ("assign", "access", "hex")
#: What a match of a kind goes on with: a key's fields and base64 lines, a shorter last one, and its END line if it is next.
_GAP = rb"(?:[\x20\t\r\n>]|\\[nr])"
TAILS = {
    "pem": re.compile(
        rb"(?:" + _GAP + rb"+[A-Za-z]+(?:-[A-Za-z]+)*:[^\n\\]*)*(?:" + _GAP + rb"+[A-Za-z0-9+/]{20,}+={0,2})*"
        rb"(?:(?:" + _GAP + rb"+[A-Za-z0-9+/]+={0,2})?" + _GAP + rb"*-----END [A-Z ]*PRIVATE KEY-----|(?<=[A-Za-z0-9+/=]{20})" + _GAP + rb"+[A-Za-z0-9+/]+={0,2}|(?<=[A-Za-z0-9+/=]{20}))"
    )
}


class _Pattern:
    """A reader for the part of the pattern language that rules use.

    It gives a tree of ("bytes", set), ("then", nodes), ("or", nodes) and
    ("repeat", node, least, most or None).
    """

    def __init__(self, source: str):
        self.source, self.at, self.fold = source, 0, False

    def tree(self):
        node = self._either()
        if self.at != len(self.source):
            raise ValueError(f"unread: {self.source[self.at:]}")
        return node

    def _peek(self, text: str) -> bool:
        return self.source.startswith(text, self.at)

    def _take(self, text: str) -> bool:
        found = self._peek(text)
        self.at += len(text) * found
        return found

    def _either(self):
        branches = [self._sequence()]
        while self._take("|"):
            branches.append(self._sequence())
        return branches[0] if len(branches) == 1 else ("or", branches)

    def _sequence(self):
        nodes = []
        while self.at < len(self.source) and self.source[self.at] not in "|)":
            nodes.append(self._repeated(self._atom()))
        return ("then", nodes)

    def _repeated(self, node):
        for sign, least, most in (("*", 0, None), ("+", 1, None), ("?", 0, 1)):
            if self._take(sign):
                return ("repeat", node, least, most)
        if found := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.source, self.at):
            self.at = found.end()
            least = int(found[1])
            return ("repeat", node, least, int(found[3]) if found[3] else None if found[2] else least)
        return node

    def _atom(self):
        if self._take("("):
            outer, self.fold = self.fold, self.fold or self._take("?i:")
            node = self._either()
            self.fold = outer
            if not self._take(")"):
                raise ValueError("open group")
            return node
        if self._take("["):
            held = set()
            while not self._take("]"):
                first = self._byte()
                last = first
                if self._peek("-") and not self._peek("-]"):
                    self.at += 1
                    last = self._byte()
                held.update(range(first, last + 1))
            return self._bytes(held)
        return self._bytes({self._byte()})

    def _bytes(self, held):
        if self.fold:
            held = {ord(f(chr(b))) for b in held for f in (str.lower, str.upper)}
        return ("bytes", frozenset(held))

    def _byte(self) -> int:
        if self._take("\\"):
            if self._take("x"):
                self.at += 2
                return int(self.source[self.at - 2 : self.at], 16)
        self.at += 1
        return ord(self.source[self.at - 1])


def _backwards(node):
    if node[0] == "then":
        return ("then", [_backwards(x) for x in reversed(node[1])])
    if node[0] == "or":
        return ("or", [_backwards(x) for x in node[1]])
    if node[0] == "repeat":
        return ("repeat", _backwards(node[1]), *node[2:])
    return node


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, begin: int) -> int:
        """Build the node from state `begin`; gives its last state."""
        if node[0] == "bytes":
            end = self.state()
            here = self.state()
            self.empty[begin].append(here)
            self.moves[here] = (node[1], end)
            return end
        if node[0] == "then":
            for x in node[1]:
                begin = self.add(x, begin)
            return begin
        if node[0] == "or":
            ends = [self.add(x, begin) for x in node[1]]
            end = self.state()
            for e in ends:
                self.empty[e].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            begin = self.add(inner, begin)
        if most is None:
            loop = self.state()
            self.empty[begin].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[begin].append(end)
        for _ in range(most - least):
            begin = self.add(inner, begin)
            self.empty[begin].append(end)
        return end


class Automaton:
    """A minimal deterministic automaton for several patterns at once.

    `classes` maps a byte to its class, `step[state + class]` is the next state
    (states are multiples of the number of classes), and `accepts[state]` names
    the patterns that end there.  With `anywhere`, a match may begin anywhere.
    """

    def __init__(self, trees: list, anywhere: bool):
        nfa = _Nfa()
        start = nfa.state()
        final = {nfa.add(t, start): k for k, t in enumerate(trees)}
        sets = {m[0] for m in nfa.moves if m}
        signature = [tuple(b in s for s in sets) for b in range(256)]
        kinds = list(dict.fromkeys(signature))
        self.classes = bytes(kinds.index(x) for x in signature)
        sample = [self.classes.index(k) for k in range(len(kinds))]

        def closed(states):
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if nfa.moves[s] or s in final)

        first = closed({start})
        found, rows, todo = {first: 0}, [], [first]
        for states in todo:
            row = []
            for b in sample:
                reached = {nfa.moves[s][1] for s in states if nfa.moves[s] and b in nfa.moves[s][0]}
                after = closed(reached | ({start} if anywhere else set()))
                if after not in found:
                    found[after] = len(found)
                    todo.append(after)
                row.append(found[after])
            rows.append(row)
        marks = [tuple(sorted(final[s] for s in states if s in final)) for states in found]
        # Minimise: split states by what they accept, then by where they lead, until nothing splits.
        block = [sorted(set(marks)).index(m) for m in marks]
        while True:
            seen: dict = {}
            finer = [seen.setdefault((block[i], *[block[t] for t in row]), len(seen)) for i, row in enumerate(rows)]
            if len(seen) == len(set(block)):
                break
            block = finer
        size = max(block) + 1
        # States that accept nothing come first, so that one comparison tells them.
        leader = {b: i for i, b in reversed(list(enumerate(block)))}
        order = sorted(range(size), key=lambda b: (bool(marks[leader[b]]), leader[b]))
        place = {b: k * len(kinds) for k, b in enumerate(order)}
        self.width, self.start = len(kinds), place[block[0]]
        self.step = [place[block[t]] for b in order for t in rows[leader[b]]]
        self.accepts = {place[b]: marks[leader[b]] for b in order if marks[leader[b]]}
        self.accept_from = min(self.accepts, default=len(self.step))
        #: The state that no match comes after, if there is one.
        self.dead = next((s for s in place.values() if s not in self.accepts and self.step[s : s + self.width] == [s] * self.width), -1)


class Scanner:
    """Leftmost, longest, non-overlapping matches of each rule.

    One pass over the bytes from the end, through the automaton of all reversed
    rules, marks every place where some rule's match begins.  From the leftmost
    mark of a rule its forward automaton gives the longest end, and so on.  A
    match of a kind in TAILS takes its tail along.
    """

    def __init__(self, rules=RULES):
        trees = [_Pattern(p).tree() for _, p, _, _ in rules]
        self.rules, self.all = rules, Automaton([_backwards(t) for t in trees], anywhere=True)
        self.each = [Automaton([t], anywhere=False) for t in trees]
        self.exact = [re.compile(p.encode()) for _, p, _, _ in rules]
        self.tails = [TAILS.get(kind) for kind, *_ in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(begin, end, rule) in bytes, by begin and rule."""
        step, state, limit = self.all.step, self.all.start, self.all.accept_from
        marks = []
        for p, c in enumerate(reversed(data.translate(self.all.classes))):
            state = step[state + c]
            if state >= limit:
                marks.append((p, state))
        found, cursor = [], [0] * len(self.rules)
        for p, state in reversed(marks):
            begin = len(data) - 1 - p
            for rule in self.all.accepts[state]:
                if begin >= cursor[rule]:
                    end = self._longest(self.each[rule], data, begin)
                    if self.tails[rule] and (tail := self.tails[rule].match(data, end)):
                        end = tail.end()
                    cursor[rule] = end
                    _, _, group, least = self.rules[rule]
                    if end - begin >= least and (not group or len(self.exact[rule].fullmatch(data, begin, end)[group]) >= least):
                        found.append((begin, end, rule))
        return sorted(found)

    @staticmethod
    def _longest(dfa: Automaton, data: bytes, begin: int) -> int:
        step, state, classes, end = dfa.step, dfa.start, dfa.classes, begin
        for at in range(begin, len(data)):
            state = step[state + classes[data[at]]]
            if state >= dfa.accept_from:
                end = at + 1
            elif state == dfa.dead:
                break
        return end


def find_secrets(df: DataFrame, rules=RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, begin, end): one row per secret, in code points, end exclusive.

    Matches of one kind do not overlap, those of different kinds may.  Null and
    empty texts have none; repeated rows repeat theirs.
    """
    ddl = f"`{id}` {df.schema[id].dataType.simpleString()}, kind string, begin bigint, end bigint"

    def rows(batch, scan):
        keys, texts = batch.columns
        ids, out = keys.to_pylist(), []
        for key, data, spans in scan(texts):
            out.extend((ids[key], rules[r][0], b, e) for b, e, r in _points(data, spans))
        return [list(zip(*out))] if out else []

    return map_batches(df.select(id, text), lambda: (lambda batch, scan=_scan(rules): rows(batch, scan)), ddl)


def _scan(rules):
    scanner = kept_by_worker(("secrets", rules), lambda: Scanner(rules))

    def scan(texts):
        data, at = utf8(texts)
        for i in range(len(texts)):
            row = data[at[i] : at[i + 1]].tobytes()
            yield i, row, scanner.spans(row)

    return scan


def _points(data: bytes, spans):
    """Byte spans as code point spans."""
    at = {}
    last = points = 0
    for p in sorted({p for b, e, _ in spans for p in (b, e)}):
        points += len(data[last:p].decode())
        at[p], last = points, p
    return [(at[b], at[e], r) for b, e, r in spans]


def summarise_secrets(df: DataFrame, rules=RULES, base=BASE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_<kind> for the base kinds, base_spans, spans): one row per text.

    Both lists hold `kind:begin:end` by begin, then kind in the order of the
    rules, joined by commas.  Texts without secrets have zeros and empty lists.
    """
    ddl = f"`{id}` {df.schema[id].dataType.simpleString()}, {', '.join(f'n_{k} bigint' for k in base)}, base_spans string, spans string"
    kinds = [r[0] for r in rules]

    def make():
        scan = _scan(rules)

        def step(batch):
            keys, texts = batch.columns
            counts, firsts, alls = [[] for _ in base], [], []
            for _, data, spans in scan(texts):
                named = [(kinds[r], f"{kinds[r]}:{b}:{e}") for b, e, r in (_points(data, spans) if spans else ())]
                for k, column in zip(base, counts):
                    column.append(sum(k == kind for kind, _ in named))
                firsts.append(",".join(s for kind, s in named if kind in base))
                alls.append(",".join(s for _, s in named))
            yield keys, *counts, firsts, alls

        return step

    return map_batches(df.select(id, text), make, ddl)


def redact(df: DataFrame, rules=RULES, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each secret in `text` replaced by `mark`; overlapping ones by one mark.

    Null stays null, and a text without secrets stays as it is.
    """
    rows, place = packed(df), df.columns.index(text)

    def make():
        scan = _scan(rules)

        def step(batch):
            held = batch.column(0)
            texts = held.field(place)
            sizes = byte_sizes(texts)
            for i, j in slices(sizes, 8 << 20):
                part, out = texts[i:j], []
                for k, data, spans in scan(part):
                    pieces, last = [], 0
                    for b, e, _ in spans:
                        if b >= last:
                            pieces += [data[last:b], mark.encode()]
                        last = max(last, e)
                    out.append((b"".join(pieces) + data[last:]).decode() if part[k].is_valid else None)
                cells = [pa.array(out, texts.type) if k == place else held.field(k)[i:j] for k in range(held.type.num_fields)]
                yield (pa.StructArray.from_arrays(cells, fields=list(held.type)),)

        return step

    return unpacked(map_batches(rows, make, rows.schema))
