"""Conversations as training windows: turn-aligned spans under a token budget, with a mask over the targets."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chirrup.llm.common import kept_by_worker, map_batches
from chirrup.session import materialize

#: Tokens of a window, and of the turns that it repeats from before.
BUDGET, HISTORY = 1024, 256
#: A conversation longer than so many budgets is cut into segments, each windowed by a task of its own.
SEGMENT = 64

#: Where a turn stands in its segment: the retained system turn, a turn of the segment before, a turn of its own.
HEAD, BEFORE, OWN = 0, 1, 2


@dataclass(frozen=True)
class Template:
    """Marks around turns, and how texts keep clear of them.

    A turn is an opening mark, a space, the text, a space and a closing mark; a
    role without marks of its own is written out.  A text that holds a mark, or
    a mark with shields after its first character, gets one more shield there,
    so marks never occur in a written text and reading takes one shield away.
    A null role reads back as an empty one.
    """

    begin: str = "<s>"
    roles: tuple = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "[ANS]", "</s>"))
    other: tuple = ("[ROLE]", "[SAYS]", "[/SAYS]")
    target: str = "assistant"
    shield: str = "\\"
    _cut: dict = field(default_factory=dict, compare=False, repr=False)

    def marks(self) -> list[str]:
        return [self.begin, *(m for _, *both in self.roles for m in both), *self.other]

    def __post_init__(self):
        marks = set(self.marks())
        heads = {m[0] for m in marks}
        if any(len(m) < 2 or heads & set(m[1:]) or self.shield in m for m in marks):
            raise ValueError("a mark needs two characters at least, none after its first may begin a mark or be the shield")
        s = re.escape(self.shield)
        places = "|".join(f"(?<={re.escape(m[0])})%s(?={s}*{re.escape(m[1:])})" for m in sorted(marks))
        self._cut.update({
            "add": re.compile(places.replace("%s", "")),
            "drop": re.compile(places.replace("%s", s)),
            "mark": re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True)))),
            "open": {role: (a, b) for role, a, b in self.roles},
            "role": {a: (role, b) for role, a, b in self.roles},
        })

    def escape(self, text: str) -> str:
        return self._cut["add"].sub(lambda _: self.shield, text)

    def unescape(self, text: str) -> str:
        return self._cut["drop"].sub("", text)

    def write(self, role: str | None, text: str | None) -> tuple[str, int, int]:
        """The turn as written, and the place and size of its text in it, in code points."""
        said = self.escape(text or "")
        if role in self._cut["open"]:
            a, b = self._cut["open"][role]
            lead = f"{a} "
        else:
            a, m, b = self.other
            lead = f"{a} {self.escape(role or '')} {m} "
        return f"{lead}{said} {b}", len(lead), len(said)

    def read(self, window: str) -> list[tuple[str, str, int, int]]:
        """(role, text, start, end) of each turn of a window; start and end enclose the text as written."""
        turns, found = [], list(self._cut["mark"].finditer(window))
        if not found or found[0].start() or found[0].group() != self.begin:
            raise ValueError("a window begins with its mark")
        at, i = found[0].end(), 1
        while i < len(found):
            if found[i].start() != at:
                raise ValueError("text outside of turns")
            known = self._cut["role"].get(found[i].group())
            if known:
                role, close = known
                start, last = found[i].end() + 1, i + 1
            else:
                role, close = self.unescape(window[found[i].end() + 1 : found[i + 1].start() - 1]), self.other[2]
                start, last = found[i + 1].end() + 1, i + 2
            if found[last].group() != close:
                raise ValueError("a turn that does not end with its mark")
            end = found[last].start() - 1
            turns.append((role, self.unescape(window[start:end]), start, end))
            at, i = found[last].end(), last + 1
        if at != len(window):
            raise ValueError("text outside of turns")
        return turns


def _counter(vocabulary: str, pattern: str):
    """Tokens of a text under a byte-level vocabulary of ranks, special strings read as text."""
    import tiktoken

    def build():
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    library = kept_by_worker(("chat", vocabulary, pattern), build)
    return lambda text: len(library.encode_ordinary(text))


def _marked(turns: DataFrame, vocabulary: str, pattern: str, template: Template) -> DataFrame:
    """Each turn as written, with its tokens; stored, so that the ids of rows stay as they are."""

    def make():
        count = _counter(vocabulary, pattern)

        def step(batch):
            written = [template.write(role, text) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield [*batch.columns[:3], [w[0] for w in written], [w[1] for w in written], [w[2] for w in written], [count(w[0]) for w in written]]

        return step

    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv", "turn", "role")}
    rows = map_batches(turns, make, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", piece string, lead long, size long, tokens long")
    return materialize(rows.withColumns({"tie": F.xxhash64("piece"), "row": F.monotonically_increasing_id()}))


ORDER = ["turn", "role", "tie", "row"]


def _entries(marked: DataFrame, segment: int, history: int) -> DataFrame:
    """(row, segment, kind): where the turns of conversations of more than `segment` tokens go.

    Running sums over narrow rows that are dealt by ranges of (conversation,
    turn), so one conversation spreads over many tasks; only a sum per
    conversation and range crosses the window over ranges.
    """
    narrow = marked.select("conv", *ORDER, "tokens")
    long = narrow.groupBy(F.col("conv").alias("_long")).agg(F.sum("tokens").alias("_sum")).where(F.col("_sum") > segment)
    rows = narrow.join(long, F.col("conv").eqNullSafe(F.col("_long")), "left_semi")
    rows = materialize(rows.repartitionByRange("conv", *ORDER).withColumn("range", F.spark_partition_id()))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "range").agg(F.sum("tokens").alias("_n"))
    carry = sums.select(F.col("conv").alias("_conv"), F.col("range").alias("_range"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy("conv", "range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    rows = rows.join(carry, (rows["range"] == F.col("_range")) & rows["conv"].eqNullSafe(F.col("_conv")))
    start = F.col("_carry") + F.col("_inside")
    placed = materialize(rows.select("conv", "row", "role", start.alias("start"), F.floor(start / segment).alias("segment")))

    head = (F.col("start") == 0) & F.col("role").eqNullSafe(F.lit("system"))
    near = F.col("start") >= (F.col("segment") + 1) * segment - history
    own = placed.select("row", "segment", F.lit(OWN).alias("kind"))
    before = placed.where(near & ~head).select("row", F.col("segment") + 1, F.lit(BEFORE))
    later = placed.where("segment > 0").groupBy("conv", "segment").agg(F.lit(HEAD).alias("kind"))
    heads = placed.where(head).select(F.col("conv").alias("_conv"), "row")
    return own.union(before).union(later.join(heads, F.col("conv").eqNullSafe(F.col("_conv"))).select("row", "segment", "kind"))


def windows_of(tokens: list[int], head: bool, i: int, begin: int, budget: int, history: int) -> list[tuple[bool, int, int, int]]:
    """(head, first, new, end) of each window over a segment's turns of these many tokens, of which those from `i` on are new.

    `turns[first:end]` are in the window, those from `new` on for the first
    time; `head` says that the first turn is to be retained, and of a window
    that it comes before the others.
    """
    kept = tokens[0] if head else 0
    sums = list(accumulate(tokens, initial=0))
    low = 1 if head else 0
    out = []
    while i < len(tokens):
        base = begin + (kept if i else 0)
        j = 0
        if i:
            floor = max(sums[i] - history, base + sums[i + 1] - budget)
            j = min(max(low, bisect_left(sums, floor)), i)
        end = max(i + 1, bisect_right(sums, budget - base + sums[j]) - 1)
        out.append((head and i > 0, j, i, end))
        i = end
    return out


def format_windows(
    conversations: DataFrame,
    vocabulary: str,
    pattern: str,
    budget: int = BUDGET,
    history: int = HISTORY,
    segment: int | None = None,
    template: Template | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv_id, segment, window, first_turn, tokens, over_budget, repeated, text, loss): each conversation as windows.

    Turns are taken by `turn`, nulls first, ties by role and then by a hash of
    the written turn; repeated rows are repeated turns.  A window takes whole
    turns while their tokens, each turn counted by itself, fit the budget: the
    conversation's first turn if its role is system, then the turns just before
    the new ones, at most `history` tokens of them, then new turns.  Every turn
    is new in exactly one window; `repeated` counts the leading turns that are
    not.  A turn that does not fit makes a window of its own, which is marked
    `over_budget`; no text is cut.  `loss` lists the code points [start, end) of
    the new turns of role assistant: their text without marks, empty ones too.

    A conversation is cut where its running token count passes a multiple of
    `segment` (64 budgets unless given), and windows begin anew there, with
    history; so no task holds more than a segment, however long the
    conversation.  A null text or role is empty; a null id is a conversation.
    No rows give none; other columns are left out.
    """
    template = template or Template()
    segment = SEGMENT * budget if segment is None else segment
    if not 0 <= history < min(budget, segment):
        raise ValueError("history must be shorter than the budget and the segment")
    turns = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    marked = _marked(turns, vocabulary, pattern, template)
    entries = _entries(marked, segment, history)
    rows = marked.join(entries, "row", "left").withColumns({"segment": F.coalesce("segment", F.lit(0)), "kind": F.coalesce("kind", F.lit(OWN))})
    rows = rows.select("conv", "segment", "kind", *ORDER, "piece", "lead", "size", "tokens")
    rows = rows.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "kind", *ORDER)

    def make():
        begin = _counter(vocabulary, pattern)(template.begin)
        key, held = None, []

        def emit(out):
            opening = key[1] == 0 and held[0][2] == "system"
            new = next((k for k, h in enumerate(held) if h[0] == OWN), len(held))
            spans = windows_of([h[-1] for h in held], opening or held[0][0] == HEAD, new, begin, budget, history)
            for number, (head, first, new, end) in enumerate(spans):
                chosen = ([held[0]] if head else []) + held[first:end]
                repeated = len(chosen) - (end - new)
                at, loss, tokens = len(template.begin), [], begin
                for place, (_, _, who, piece, lead, size, count) in enumerate(chosen):
                    if place >= repeated and who == template.target:
                        loss.append({"start": at + lead, "end": at + lead + size})
                    at += len(piece)
                    tokens += count
                whole = template.begin + "".join(c[3] for c in chosen)
                out.append((*key, number, held[new][1], tokens, tokens > budget, repeated, whole, loss))

        def step(batch):
            nonlocal key, held
            out, size = [], 0
            if batch is None:
                if held:
                    emit(out)
            else:
                cells = [c.to_pylist() for c in batch.columns]
                for now, kind, number, who, piece, lead, length, count in zip(zip(*cells[:2]), *cells[2:5], *cells[7:]):
                    if now != key:
                        if held:
                            emit(out)
                        key, held = now, []
                    held.append((kind, number, who, piece, lead, length, count))
                    size += len(piece)
                    if size > 1 << 24 and out:
                        yield list(zip(*out))
                        out, size = [], 0
            if out:
                yield list(zip(*out))

        return step

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    ddl = (
        f"conv_id {kind['conv']}, segment long, window int, first_turn {kind['turn']}, tokens long, over_budget boolean, repeated int, "
        "text string, loss array<struct<start:long, end:long>>"
    )
    return map_batches(rows, make, ddl, finish=True)


def read_windows(windows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, segment, window, place, role, text, target): the turns that are new in each window, read from its text.

    `target` is the text under the loss mask of that turn, null where there is none.
    """
    template = template or Template()

    def make():
        def step(batch):
            cells = [c.to_pylist() for c in batch.columns]
            for conv, segment, window, repeated, text, loss in zip(*cells):
                masked = {m["start"]: m["end"] for m in loss}
                new = list(enumerate(template.read(text)))[repeated:]
                if new:
                    rows = [
                        (conv, segment, window, place, role, said, template.unescape(text[start : masked[start]]) if start in masked else None)
                        for place, (role, said, start, _) in new
                    ]
                    yield list(zip(*rows))

        return step

    kind = windows.schema["conv_id"].dataType.simpleString()
    chosen = windows.select("conv_id", "segment", "window", "repeated", "text", "loss")
    return map_batches(chosen, make, f"conv_id {kind}, segment long, window int, place int, role string, text string, target string")


def digest_windows(windows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows): digests of what the windows hold.

    Turns are read back from the windows' texts, targets from the loss masks.
    A digest over all of a conversation is sequential, so windows stream past
    it in order; a task holds a batch of them and the running digests.
    """
    template = template or Template()
    chosen = windows.select("conv_id", "segment", "window", "repeated", "text", "loss")
    rows = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")

    def make():
        key, turns, sums, marks = None, 0, None, None

        def row():
            return (key[0], turns, marks[0].hexdigest(), sums[0], marks[1].hexdigest(), sums[1], sums[2])

        def step(batch):
            nonlocal key, turns, sums, marks
            out = []
            if batch is None:
                if key is not None:
                    out.append(row())
            else:
                for conv, _, _, repeated, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                    if key != (conv,):
                        if key is not None:
                            out.append(row())
                        key, turns, sums, marks = (conv,), 0, [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                    for role, said, _, _ in template.read(text)[repeated:]:
                        turns += 1
                        marks[0].update(f"{role}\n{said}\n".encode())
                    for m in loss:
                        said = template.unescape(text[m["start"] : m["end"]])
                        sums[0] += len(said)
                        marks[1].update(said.encode())
                    sums[1] += len(text)
                    sums[2] += 1
            if out:
                yield list(zip(*out))

        return step

    kind = windows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return map_batches(rows, make, ddl, finish=True)
