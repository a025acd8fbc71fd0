"""Toxicity of texts by two class-conditional Kneser-Ney language models that share their backoff."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirrup.llm.common import map_batches, packed, small_batches
from chirrup.session import discard, fresh_path, materialize, shuffles_freed

#: What stands before the first and after the last word of a text, among the words' hashes.
BEGIN, END = 0x5851F42D4C957F2D, 0x14057B7EF767814F
#: Log-likelihood ratios count a second time beyond this, with a weight of their own.
TELLING = 3.0
#: Labelled texts that calibrate the score, at most (a sample by a hash of the id); the models do not count them.
CALIBRATION = 20_000
#: Rows of labels or of scored texts up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
FOLDS, HELD_OUT, CALIBRATING = 5, 0, 4
#: Words that a task counts or asks for at a time, n-grams of the models that it deals out at a time, and those of a shard on average.
AT_ONCE, OFFERED, SHARD = 1 << 19, 1 << 18, 1 << 17
#: Parts in which texts are scored, one after the other: what one shuffles is gone before the next begins.
SLICES = 4
#: Weights are whole multiples of this, so sums are exact in any order.
UNIT = 2.0**-24


def fold(id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words, which are runs of letters, in lower case; none for null."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(offsets: np.ndarray, words: np.ndarray):
    """(context, word, text) of all places: each word and the end of each text, after what stands before."""
    sizes = np.diff(offsets) + 1
    last = np.cumsum(sizes) - 1
    word, context = np.full(sizes.sum(), END, np.int64), np.full(sizes.sum(), BEGIN, np.int64)
    inner = np.ones(len(word), bool)
    inner[last] = False
    word[inner] = words
    context[np.flatnonzero(inner) + 1] = words
    return context, word, np.repeat(np.arange(len(sizes)), sizes)


def _runs(batch, column: int):
    """Parts of a batch of about AT_ONCE words: their rows, the lists' offsets from 0, and the lists' values."""
    lists = batch.column(column)
    offsets, values = np.asarray(lists.offsets).astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
    begin = 0
    while begin < len(lists):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + AT_ONCE, side="right")) - 1)
        end = min(end, begin + 65_535)
        yield slice(begin, end), offsets[begin : end + 1] - offsets[begin], values[offsets[begin] : offsets[end]]
        begin = end


def count_pairs(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """(context, word, ordinary, toxic, and of the context: n_ordinary, n_toxic, f_ordinary, f_toxic).

    How often a word follows another in the texts of each class; a context's
    places (n) and different followers (f).  Words are 64-bit hashes, so a
    pair's key has 128 bits.  A task counts its own places first; what is
    shuffled, once and by context, is a row per different pair of a task.
    """

    def count(labels, offsets, words):
        context, word, owner = _pairs(offsets, words)
        some = (np.diff(offsets) > 0)[owner]
        context, word, toxic = context[some], word[some], labels[owner[some]]
        order = np.lexsort((word, context))
        context, word, toxic = context[order], word[order], toxic[order]
        new = np.ones(len(order), bool)
        new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        n_toxic = np.add.reduceat(toxic.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        return context[at], word[at], np.diff(at, append=len(order)) - n_toxic, n_toxic

    def make():
        def step(batch):
            labels = np.asarray(batch.column(1))
            for rows, offsets, words in _runs(batch, 0):
                yield count(labels[rows], offsets, words)

        return step

    rows = labelled.select(word_hashes(F.col(text)).alias("words"), F.col(label).cast("int").alias("label"))
    parts = map_batches(rows, make, "context bigint, word bigint, ordinary bigint, toxic bigint").repartition("context")
    pairs = parts.groupBy("context", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    return pairs.selectExpr(
        "*",
        *(f"sum({c}) OVER (PARTITION BY context) AS n_{c}" for c in ("ordinary", "toxic")),
        *(f"count_if({c} > 0) OVER (PARTITION BY context) AS f_{c}" for c in ("ordinary", "toxic")),
    )


def _discount(ones: int, twos: int) -> float:
    """Kneser-Ney's absolute discount from the numbers of n-grams counted once and twice."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _spectrum(df: DataFrame, *columns: str) -> dict[str, tuple[float, float, float]]:
    """Of each column: its discount, the sum, and how many are not zero."""
    aggregates = [f(F.col(c)) for c in columns for f in (lambda x: F.count_if(x == 1), lambda x: F.count_if(x == 2), F.sum, lambda x: F.count_if(x > 0))]
    row = [x or 0 for x in df.agg(*aggregates).first()]
    return {c: (_discount(*row[4 * i : 4 * i + 2]), *row[4 * i + 2 : 4 * i + 4]) for i, c in enumerate(columns)}


@dataclass
class Model:
    """The n-grams with log P(toxic) - log P(ordinary), as a stored table, and what calibrates a text's sums.

    `table` has context, word, gap and base.  Without a context: the word's gap
    by the models of words, and, as base, the gap of what its two contexts
    leave to backoff.  With one: what the pair's gap adds to the word's, and
    again that base of its context.  `unseen` is the gap of an unknown word;
    `prior` the share of toxic texts among those that calibrated.
    """

    table: DataFrame
    unseen: float
    shards: int
    weights: tuple[float, ...] = (-1.0, 1.0, 0.0, 1.0, 0.0)
    prior: float = 0.0


def fit_models(labelled: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """Interpolated Kneser-Ney models of the two classes, from the words of all labelled rows.

    A class's probability of a word after another is its discounted count, and
    what the discount frees goes to the class's probability of the word, which
    is made of its numbers of different contexts in the same way.  That in turn
    leaves its freed share to one distribution of both classes together, by the
    contexts of either, which leaves its own to unknown words.  Each level has
    its discount from the n-grams that were counted once and twice.  All of it
    is tables and joins; only sums of the tables reach the driver.
    """
    with shuffles_freed(labelled.sparkSession):
        return _fit(labelled, text, label)


def _fit(labelled: DataFrame, text: str, label: str) -> Model:
    classes = ("ordinary", "toxic")
    counted = fresh_path(labelled.sparkSession, "stored")
    with small_batches(labelled.sparkSession):
        pairs = materialize(count_pairs(labelled, text, label), counted)
    found = pairs.groupBy("word").agg(*(F.count_if(F.col(c) > 0).alias(f"k_{c}") for c in classes), F.count("*").alias("k"))
    found = materialize(found)
    of_pairs, of_words = _spectrum(pairs, *classes), _spectrum(found, "k_ordinary", "k_toxic", "k")
    discount, places, types = of_words["k"]
    unknown = discount * types / (types + 1) / max(places, 1)
    shared = (F.col("k") - discount) / max(places, 1) + unknown

    def left(c):
        d, total, different = of_words[f"k_{c}"]
        return d * different / total if total else 1.0

    def of_word(c):
        d, total, _ = of_words[f"k_{c}"]
        return F.greatest(F.col(f"k_{c}") - d, F.lit(0.0)) / max(total, 1) + left(c) * shared

    def freed(c):
        return F.when(F.col(f"n_{c}") > 0, of_pairs[c][0] * F.col(f"f_{c}") / F.col(f"n_{c}")).otherwise(1.0)

    def of_pair(c):
        kept = F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - of_pairs[c][0], F.lit(0.0)) / F.col(f"n_{c}")).otherwise(0.0)
        return kept + freed(c) * F.col(f"p_{c}")

    base = F.log(freed("toxic") / freed("ordinary"))
    words = materialize(found.select("word", *(of_word(c).alias(f"p_{c}") for c in classes)))
    gap = F.log(F.col("p_toxic") / F.col("p_ordinary"))
    unseen = math.log(left("toxic") / left("ordinary"))
    in_pairs = pairs.join(words, "word").select("context", "word", (F.log(of_pair("toxic") / of_pair("ordinary")) - gap).alias("gap"), base.alias("base"))
    contexts = pairs.groupBy(F.col("context").alias("word")).agg(F.first(base).alias("base"))
    alone = words.select("word", gap.alias("gap")).join(contexts, "word", "full_outer")
    alone = alone.select(F.lit(None).cast("bigint").alias("context"), "word", F.coalesce("gap", F.lit(unseen)).alias("gap"), F.coalesce("base", F.lit(0.0)).alias("base"))
    table = materialize(in_pairs.unionByName(alone))
    discard(labelled.sparkSession, counted)
    return Model(table, unseen, 1 << max(0, math.ceil(math.log2(max(1, table.count()) / SHARD))))


def _beyond(x):
    return np.maximum(x - TELLING, 0.0)


def _parts(alone, gap, base, unseen: float) -> np.ndarray:
    """Of n-grams: what a place adds to the four sums of a text, over the places of unknown words."""
    zero = np.zeros(len(gap))
    return np.stack([
        np.where(alone, gap - unseen, zero), np.where(alone, _beyond(gap) - _beyond(unseen), zero),
        np.where(alone, base, gap - base), np.where(alone, _beyond(base), _beyond(gap) - _beyond(base)),
    ])


def _pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, compressed: the lowest bytes of all first, then the next; the high ones are mostly zeros."""
    if numbers.dtype == np.int64:
        numbers = (numbers << 1) ^ (numbers >> 63)  # the sign goes to the lowest bit
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    numbers = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
    return (numbers >> 1) & (2**63 - 1) ^ -(numbers & 1) if kind == np.int64 else numbers


def _rising(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the shards begin and end in rising keys."""
    width = np.uint64(2**64 // shards - (shards == 1))
    return np.append(np.searchsorted(keys, np.arange(shards, dtype=np.uint64) * width), len(keys))


#: n-grams of the models (batch -1: keys, values), what a batch of texts asks (keys, sizes, texts, times), its texts (shard below 0: keys, sizes).
_ASKED = "shard int, batch bigint, keys binary, sizes binary, texts binary, values binary"


def _offered(model: Model, weights: np.ndarray) -> DataFrame:
    """The n-grams with their values, `weights` times the four parts, dealt into shards by their keys."""
    unseen, shards = model.unseen, model.shards

    def offer(batches):
        columns = pa.Table.from_batches(batches).combine_chunks().columns
        alone = columns[0].is_null().to_numpy()
        context, word, gap, base = (c.fill_null(0).to_numpy() for c in columns)
        keys = np.where(alone, word.view(np.uint64), _pair_key(context, word))
        values = np.rint(weights @ _parts(alone, gap, base, unseen) / UNIT).astype(np.int64)
        order = np.argsort(keys)
        keys, values = keys[order], values[:, order]
        at = _bounds(keys, shards)
        some = np.flatnonzero(np.diff(at))
        cut, none = [(at[s], at[s + 1]) for s in some], [None] * len(some)
        return some, np.full(len(some), -1), [_rising(keys[b:e]) for b, e in cut], none, none, [_packed(values[:, b:e].ravel()) for b, e in cut]

    def make():
        held = []

        def step(batch):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= OFFERED):
                yield offer(held)
                held.clear()

        return step

    return map_batches(model.table, make, _ASKED, finish=True)


def _asked(texts: DataFrame, shards: int) -> DataFrame:
    """What batches of the texts ask the shards: n-grams, each once, with the texts that hold it and how often."""

    def ask(shard, batch, one, two, offsets, words):
        context, word, owner = _pairs(offsets, words)
        some = (np.diff(offsets) > 0)[owner]
        context, word, owner = context[some], word[some], owner[some].astype(np.uint16)
        first = np.flatnonzero(context == BEGIN)
        keys = np.concatenate([word.view(np.uint64), np.full(len(first), BEGIN, np.uint64), _pair_key(context, word)])
        owner = np.concatenate([owner, owner[first], owner])
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        held = new.copy()
        held[1:] |= owner[1:] != owner[:-1]
        places = np.flatnonzero(held)
        times, owner = np.diff(places, append=len(keys)).astype(np.uint32), owner[places]
        begins = np.flatnonzero(new[places])
        sizes, keys = np.diff(begins, append=len(places)).astype(np.uint32), keys[places[begins]]
        at, begins = _bounds(keys, shards), np.append(begins, len(places))
        some = np.flatnonzero(np.diff(at))
        cut = [(at[s], at[s + 1], begins[at[s]], begins[at[s + 1]]) for s in some]
        return (
            np.append(some, shard), np.full(len(some) + 1, batch),
            [_rising(keys[b:e]) for b, e, _, _ in cut] + [np.stack([one, two]).tobytes()],
            [_packed(sizes[b:e]) for b, e, _, _ in cut] + [np.diff(offsets).tobytes()],
            [_packed(owner[b:e]) for _, _, b, e in cut] + [None], [_packed(times[b:e]) for _, _, b, e in cut] + [None],
        )

    def make():
        task, count = TaskContext.get().partitionId(), 0

        def step(batch):
            nonlocal count
            one, two = (np.asarray(batch.column(c)) for c in (0, 1))
            for rows, offsets, words in _runs(batch, 2):
                yield ask(-1 - task, (task << 32) + count, one[rows], two[rows], offsets, words)
                count += 1

        return step

    return map_batches(texts, make, _ASKED)


def _answered(rows: DataFrame, n: int) -> DataFrame:
    """Of every batch and shard, the texts' sums of the values of the n-grams that they hold; a batch's own row passes."""

    def make():
        shard, offers, known, values = None, [], None, None

        def step(batch):
            nonlocal shard, offers, known, values
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, offers, known = row["shard"], [], None
                if shard < 0:
                    yield [[row["batch"]], [row["keys"]], [row["sizes"]], [None]]
                    continue
                if row["batch"] < 0:
                    offers.append((_risen(row["keys"]), _unpacked(row["values"], np.int64).reshape(n, -1)))
                    continue
                if known is None:
                    known = np.concatenate([k for k, _ in offers]) if offers else np.zeros(0, np.uint64)
                    values = np.concatenate([v for _, v in offers], axis=1) if offers else np.zeros((n, 0), np.int64)
                    order = np.argsort(known)
                    known, values, offers = known[order], values[:, order].astype(float), []
                if not len(known):
                    continue
                keys = _risen(row["keys"])
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                sizes = _unpacked(row["sizes"], np.uint32)
                owner, times = _unpacked(row["texts"], np.uint16), _unpacked(row["values"], np.uint32)
                mine = np.repeat(np.where(known[at] == keys, values[:, at], 0.0), sizes, axis=1) * times
                sums = np.stack([np.bincount(owner, v) for v in mine]).astype(np.int64)
                some = np.flatnonzero(sums.any(axis=0))
                if len(some):
                    yield [[row["batch"]], [None], [_packed(some.astype(np.uint16))], [_packed(sums[:, some].ravel())]]

        return step

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "batch")
    return map_batches(dealt, make, "batch bigint, keys binary, texts binary, sums binary")


def _text_keys(text: str) -> list[Column]:
    """Two hashes of a text, null as empty, that tell texts apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("one"), F.xxhash64(F.lit(1), whole).alias("two")]


def _sums(df: DataFrame, text: str, model: Model, weights: np.ndarray) -> DataFrame:
    """(one, two, words, sums): of each text, by its two hashes, the number of words, and the sums over all its places.

    `weights` has a row for each sum, over the four parts.  The models' n-grams
    and the texts' meet in shards of the keys' range.  A batch of texts asks
    for an n-gram once, whichever texts hold it.
    """
    texts = df.select(*_text_keys(text), word_hashes(F.col(text)).alias("words"))
    n = len(weights)
    parts = _answered(_offered(model, weights).union(_asked(texts, model.shards)), n)
    always = weights @ np.array([model.unseen, _beyond(model.unseen), 0.0, 0.0])

    def make():
        now, keys, words, sums = None, None, None, None

        def done():
            if now is not None:
                yield [*keys, words, list(((sums * UNIT) + np.outer(always, words + 1)).T)]

        def step(batch):
            nonlocal now, keys, words, sums
            if batch is None:
                yield from done()
                return
            for row in batch.to_pylist():
                if row["batch"] != now:
                    yield from done()
                    now, keys, words = row["batch"], np.frombuffer(row["keys"], np.int64).reshape(2, -1), np.frombuffer(row["texts"], np.int64)
                    sums = np.zeros((n, len(words)), np.int64)
                    continue
                sums[:, _unpacked(row["texts"], np.uint16)] += _unpacked(row["sums"], np.int64).reshape(n, -1)

        return step

    whole = parts.repartition("batch").sortWithinPartitions("batch", F.col("keys").isNull())
    return map_batches(whole, make, "one bigint, two bigint, words bigint, sums array<double>", finish=True)


def _logistic(x, y, n, steps=50, ridge=1e-3):
    """Weights of a logistic regression over rows that stand for n each, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        move = np.linalg.solve(h, x.T @ (n * (y - p)) - ridge * beta)
        beta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return beta


def train(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The two models and their calibration from the labelled rows that are not held out.

    Of the five folds by `fold(id)`, 0 is held out.  A sample of fold 4 of at
    most CALIBRATION ids fits the logistic curve from a text's sums to a score;
    all other rows of folds 1 to 4 are counted.  Null labels are none; of
    several labels of an id the highest counts.
    """
    with shuffles_freed(df.sparkSession):
        return _train(df, labels, id, text, label)


def _train(df: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> Model:
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg((F.max(label) > 0).cast("int").alias("_label"))
    known = known.where(fold(F.col("_id")) != HELD_OUT)
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = df.select(F.col(id).alias("_doc"), F.col(text).alias("_text")).where(fold(F.col("_doc")) != HELD_OUT).join(known, F.col("_doc") == F.col("_id")).select("_id", "_text", "_label")
    calibrating = rows.where(fold(F.col("_id")) == CALIBRATING)
    ids = F.broadcast(materialize(calibrating.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(CALIBRATION)))
    model = fit_models(rows.join(ids, "_id", "left_anti"), "_text", "_label")
    sample = calibrating.join(ids, "_id", "left_semi")
    marked = sample.groupBy(*_text_keys("_text")).agg(F.count("*").alias("n"), F.sum("_label").alias("toxic"))
    sums = _sums(sample, "_text", model, np.eye(4)).dropDuplicates(["one", "two"])
    with small_batches(df.sparkSession):
        found = sums.join(marked, ["one", "two"]).where("words > 0").orderBy("one", "two").limit(2 * CALIBRATION).toPandas()
    n, toxic = found["n"].to_numpy(float), found["toxic"].to_numpy(float)
    if 0 < toxic.sum() < n.sum():
        x = np.stack(found["sums"]) / np.sqrt(found["words"].to_numpy(float) + 1)[:, None]
        scale = np.maximum(x.std(axis=0), 1e-9)
        fitted = _logistic(np.column_stack([np.ones(len(x)), x / scale]), toxic / n, n)
        model.weights, model.prior = (float(fitted[0]), *map(float, fitted[1:] / scale)), float(toxic.sum() / n.sum())
    return model


def score(df: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The columns of `df`, with score and predicted, of each row's whole text; nothing else is an input.

    A text without words, or null, has the score of no evidence: the share of
    toxic texts.  Equal texts get equal scores.  Columns of those two names are
    replaced.  `df` is read SLICES times for its texts, each time for those
    whose hash falls into a slice, and once for its rows.
    """
    one, two = _text_keys(text)
    line = model.weights[0] + F.col("sums")[0] / F.sqrt(F.col("words") + 1)
    value = F.when(F.col("words") > 0, 1 / (1 + F.exp(-line))).otherwise(model.prior).alias("value")

    def found_in(part: int) -> DataFrame:
        sums = _sums(df.where(F.pmod(one, F.lit(SLICES)) == part), text, model, np.array([model.weights[1:]])).dropDuplicates(["one", "two"])
        return materialize(sums.select("one", "two", value))

    with small_batches(df.sparkSession), shuffles_freed(df.sparkSession):
        found = reduce(DataFrame.union, [found_in(part) for part in range(SLICES)])
        texts = found.count()
    if texts <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = packed(df, one=one, two=two).join(found, ["one", "two"], "left")
    rest = df.drop(score, predicted).columns
    return rows.select(*(F.col("row").getField(c).alias(c) for c in rest), F.col("value").alias(score), (F.col("value") >= 0.5).cast("int").alias(predicted))
