"""Line-first cleaning of texts by rules, and the documents that it rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirrup.llm.common import WORD, let

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: Marks that a line of prose has few of, what separates links, and what ends a sentence.
MARKS = SYMBOLS + "=_~^{}[]@+"
SEPARATORS = "|»›•·"
ENDS = (".", "!", "?", "…", ":", ";", "。", "！", "？")
CLOSING = "\"'”’»)]"
#: Characters of a short line, of a line that may be furniture, the share of marks that is too much, and words to a separator, below which links are listed.
SHORT, FURNITURE, MARKED, LINKED = 30, 240, 0.1, 5
#: A line of a program: an assignment, a call or brace at its end, or a word that begins a statement.
CODE = (
    r"[A-Za-z_][0-9A-Za-z_.\[\]]*[ \t]*(?:[-+*/%]|<<|>>)?=[ \t]*[^ \t=>]|[0-9A-Za-z_]\([^()]*\)[ \t);,{]*\z|[{};][ \t]*\z"
    r"|\A[ \t]*(?:return|import|from|def|class|if|elif|else|for|while|try|except|with|let|const|var|public|private|static|void)[ \t(:].*[(:={;]"
)
BRACES = r"\A[ \t]*[{}()\[\];,]+[ \t]*\z"
#: Phrases of site furniture, lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "forgot your password",
    "powered by", "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to our", "terms of service",
    "terms of use", "use of cookies",
)


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the array, first ones included.

    Windows are told apart by 64-bit hashes first: texts without equal hashes
    are done.  Else the hashes' low bits, with the positions below them, are
    sorted as numbers; windows whose neighbour agrees are compared as words.
    So equal hashes of different words do no harm, and the cost is that of a
    sort even where everything repeats.
    """

    def count(w):
        n = F.size(w) - 2
        hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == n, 0).otherwise(positions(w, h, n)))

    def positions(w, h, n):
        bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")
        place = F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("bigint")))

        def agreeing(p):
            def prefix(x):
                return F.call_function("shiftright", x, bits)

            near = F.filter(p, lambda x, i: ((i > 0) & (prefix(x) == prefix(F.get(p, i - 1)))) | ((i < n - 1) & (prefix(x) == prefix(F.get(p, i + 1)))))
            mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
            named = F.transform(near, lambda x: let(x.bitwiseAND(mask).cast("int"), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("t"), i.alias("i"))))
            return let(F.sort_array(named), repeats)

        def repeats(s):
            last = F.size(s) - 1
            twice = F.filter(s, lambda x, k: ((k > 0) & (x["t"] == F.get(s, k - 1)["t"])) | ((k < last) & (x["t"] == F.get(s, k + 1)["t"])))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

        def covered(at):
            gains = F.transform(at, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(at, k - 1))))
            return F.aggregate(gains, F.lit(0), lambda a, x: a + x)

        return let(F.sort_array(place), agreeing)

    return let(words, lambda w: F.when(F.size(w) < 3, 0).otherwise(count(w))).cast("bigint")


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACES))) > 0


def occurrences(text: Column, characters: str) -> Column:
    """How many of the given characters a text holds.  Replacing them one by one is far quicker than `translate`, which looks up each character."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.length(text) - F.length(left)


def line_fails(line: Column) -> Column:
    """Whether a line is furniture: navigation, mostly marks, a short line without an end mark, or short boilerplate.

    Navigation has three separators or more and few words to each; « and » that
    enclose a quotation separate nothing.  Lines of programs may be short and
    bear marks, as long as letters outweigh those.
    """
    bare = F.btrim(F.rtrim(F.btrim(line, F.lit(SPACES)), F.lit(CLOSING)), F.lit(SPACES))
    ended, boilerplate, lower = F.lit(False), F.lit(False), F.lower(line)
    for end in ENDS:
        ended = ended | F.endswith(bare, F.lit(end))
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | F.contains(lower, F.lit(phrase))
    size = F.length(line)
    separators = occurrences(line, SEPARATORS) - F.least(occurrences(line, "«"), occurrences(line, "»"))
    marks = occurrences(line, MARKS)
    navigation = let(separators, lambda n: (n >= 3) & (F.regexp_count(line, F.lit(WORD)) < n * LINKED))
    code = (F.rlike(line, F.lit(CODE)) & (3 * marks < size)) | F.rlike(line, F.lit(BRACES))
    return ((((size < SHORT) & ~ended) | (marks > size * MARKED)) & ~code) | navigation | ((size < FURNITURE) & boilerplate)


def clean_lines(df: DataFrame, least_words: int = 50, repeated: float = 0.5, least_left: float = 0.5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, cleaned): each line is judged first, then what is left of the document.

    Failing lines go from `cleaned`; lines without a word stay where they are.
    A document is not kept if the base rules fail (fewer than `least_words`
    words, or more than the share `repeated` of them in repeated three-word
    windows) or if less than the share `least_left` of its characters is left.
    All in one pass over each row, without a shuffle.  A null text counts as
    empty, and so fails; repeated rows get the same verdict.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(id, whole.alias("_t"))
    lines = F.split("_t", "\n")
    counts = rows.select(
        id,
        F.length("_t").alias("_size"),
        occurrences(F.col("_t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        let(F.filter(lines, has_word), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(F.regexp_extract_all("_t", F.lit(WORD), 0), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.length(F.array_join(w, "")).cast("bigint").alias("chars"), repeated_words(w).alias("repeats"))).alias("_w"),
        F.concat_ws("\n", F.filter(lines, lambda x: ~has_word(x) | ~line_fails(x))).alias("cleaned"),
    )
    n, again = F.col("_w.n"), F.col("_w.repeats")
    failed = (n < least_words) | (100 * again > round(100 * repeated) * n)
    return counts.select(
        id, n.alias("n_words"), F.col("_w.chars").alias("word_chars"), "n_symbols", "n_dup_lines", again.alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & (F.length("cleaned") >= F.col("_size") * least_left)).alias("kept"), "cleaned",
    )
