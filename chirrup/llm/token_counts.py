"""Token counts under a unigram vocabulary, without building the tokens."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from chirrup.llm.common import kept_by_worker, map_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces of a model file and their scores, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def read_matching(path: str) -> tuple[list[tuple[str, float]], bool, bool]:
    """The normal and user-defined pieces of a model file with their unigram scores, whether it falls back to bytes, and whether it puts a space first.

    Control, unknown, unused and byte pieces never match text.  A user-defined
    piece scores as in the public library.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rule, kinds = model.normalizer_spec, model.SentencePiece
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("a model that changes its texts is not supported")
    normal = [(p.piece, p.score) for p in model.pieces if p.type == kinds.NORMAL]
    best = max(s for _, s in normal)
    own = [(p.piece, len(p.piece.encode()) * best - 0.1) for p in model.pieces if p.type == kinds.USER_DEFINED]
    return normal + own, model.trainer_spec.byte_fallback, rule.add_dummy_prefix


def stretches(pieces: list[tuple[str, float]]):
    """A function that cuts a text, its spaces marked, where no piece can cross: before each run of spaces.

    That holds if pieces have spaces at their beginning or of nothing else, and
    a space is a piece; else a text is one stretch.
    """
    names = {p for p, _ in pieces}
    if SPACE in names and all(SPACE not in p[1:] or not p.strip(SPACE) for p in names):
        return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
    return lambda text: [text]


class Counter(dict):
    """Piece counts of the words met lately; two generations bound its size.

    An Aho-Corasick automaton names every vocabulary piece that ends at a
    place, longest first.  Of the paths that end there only the best score and
    its number of pieces are kept.  Of equal scores the earliest start wins, as
    in the public unigram tokenizer.  A character that is no piece by itself
    may be unknown at the lowest score less a penalty; neighbouring unknowns
    count as one string, which costs one piece for each of its bytes unless
    the vocabulary has it.
    """

    LIMIT, LONGEST = 250_000, 64

    def __init__(self, pieces: list[tuple[str, float]], fallback: bool | None = None):
        import ahocorasick

        super().__init__()
        self.older: dict[str, int] = {}
        self.known = {p for p, _ in pieces}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.known for b in range(256)) if fallback is None else fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.best(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n

    def best(self, word: str) -> int:
        scores, counts = [0.0] + [None] * len(word), [0] * (len(word) + 1)
        runs = [-1] * (len(word) + 1)  # where the unknown string that ends here begins
        matches = self.automaton.iter(word)
        at, found = next(matches, (len(word), None))
        for end in range(1, len(word) + 1):
            score, single = None, False
            while at == end - 1:
                length, gain = found
                path = gain + scores[end - length]
                if score is None or path > score:
                    score, start = path, end - length
                single = single or length == 1
                at, found = next(matches, (len(word), None))
            if not single:
                path = self.unknown + scores[end - 1]
                if score is None or path > score:
                    scores[end] = path
                    runs[end] = begin = runs[end - 1] if runs[end - 1] >= 0 else end - 1
                    text = word[begin:end]
                    counts[end] = counts[begin] + (1 if text in self.known or not self.bytes else len(text.encode()))
                    continue
            scores[end], counts[end] = score, counts[start] + 1
        return counts[-1]


def count_tokens(df: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", words_apart: bool = True) -> DataFrame:
    """(id, n_tokens) of each row's whole text under the unigram pieces of a model file.

    With `words_apart` a space begins a word and belongs to it, so does the
    start of the text, words are counted one by one, and all pieces of the file
    match: as the public tokenizer does when it splits at spaces.  Without, the
    whole text is cut into pieces, runs of spaces too, and only normal and
    user-defined pieces match: as the public unigram model does, in double
    precision.  Null and empty texts have 0 tokens.  Rows are independent: no
    shuffle, repeated rows stay.  The vocabulary (under 1 MB) is read on the
    driver and broadcast.
    """
    pieces = df.sparkSession.sparkContext.broadcast((read_pieces(model_path), None, True) if words_apart else read_matching(model_path))

    def make():
        found, fallback, prefix = pieces.value
        counter = kept_by_worker(("unigram", model_path, words_apart), lambda: Counter(found, fallback))
        cut = stretches(found)

        def count(text: str) -> int:
            if not text:
                return 0
            marked = text.replace(" ", SPACE)
            if not words_apart:
                return sum(map(counter.__getitem__, cut(SPACE + marked if prefix else marked)))
            words = marked.split(SPACE)
            if not words[0]:
                words = words[1:]
            return sum(map(counter.__getitem__, [SPACE + w for w in words]))

        def step(batch):
            keys, texts = batch.columns
            yield keys, [count(t.as_py()) for t in texts]

        return step

    return map_batches(df.select(id, text), make, f"`{id}` {df.schema[id].dataType.simpleString()}, n_tokens bigint")
