"""Column expressions over short numeric arrays and sample arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """Marked for broadcast when it is proven to have at most `limit` rows, else left to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def label_names(labels: DataFrame, limit: int = 10_000) -> list[str]:
    """Class names in id order: the columns of wide reports."""
    rows = labels.select("label_id", "label").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} classes")
    return [r.label for r in sorted(rows, key=lambda r: r.label_id)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`.

    A lambda re-evaluates every outer expression in it per element, which would
    make `x / sum(xs)` quadratic; a lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def peak(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x).cast("double")))


def energy(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def scale(xs: Column, factor: Column) -> Column:
    return let(factor, lambda g: F.transform(xs, lambda x: x * g))


def log_softmax(scores: Column) -> Column:
    return let(
        F.array_max(scores),
        lambda m: let(
            F.ln(F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - m))),
            lambda z: F.transform(scores, lambda x: x - m - z),
        ),
    )


def softmax(scores: Column) -> Column:
    return F.transform(log_softmax(scores), F.exp)


def normalized(p: Column) -> Column:
    return let(total(p), lambda t: F.transform(p, lambda x: x / t))


def top1(p: Column) -> Column:
    """Index of the greatest value, the first one on ties.  NaN must be ruled out before."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("bigint")


def dbfs(value: Column) -> Column:
    """Level in decibels of full scale; NULL for silence."""
    return F.when(value > 0, 20 * F.log10(value))


def frame_to_seconds(frame: Column, rate: Column | int) -> Column:
    return frame / (F.lit(rate) if isinstance(rate, int) else rate)


def seconds_to_frame(seconds: Column, rate: Column | int) -> Column:
    """Nearest frame; halves go to the even one."""
    return F.rint(seconds * (F.lit(rate) if isinstance(rate, int) else rate)).cast("bigint")


def downmix(interleaved: Column, channels: int, mode: str = "error") -> Column:
    """One channel from interleaved ones: their mean, or an error unless already mono."""
    if channels == 1:
        return interleaved
    if mode != "mean":
        raise ValueError("expected mono audio; use mode='mean' to mix channels down")
    starts = F.sequence(F.lit(1), F.size(interleaved) - channels + 1, F.lit(channels))
    mixed = F.transform(starts, lambda i: total(F.slice(interleaved, i, channels)) / channels)
    return F.when(F.size(interleaved) >= channels, mixed).otherwise(F.array().cast("array<double>"))


def limiter_gain(samples: Column, ceiling: float = 0.98) -> Column:
    return F.least(F.lit(1.0), F.lit(ceiling) / F.greatest(peak(samples), F.lit(1e-12)))


def peak_limit(samples: Column, ceiling: float = 0.98) -> Column:
    return scale(samples, limiter_gain(samples, ceiling))


def silence(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), n.cast("int"))


def pad(samples: Column, left: Column, right: Column) -> Column:
    return F.concat(silence(left), samples, silence(right))


def fit_length(
    samples: Column,
    n: int,
    label: Column,
    pad_position: str = "center",
    long: str = "error",
    crop_labels: tuple[str, ...] = ("unknown", "background"),
) -> tuple[Column, Column]:
    """(samples of length n, action).

    Short clips are padded.  Long clips of `crop_labels`, or any under
    long='crop', lose both ends evenly; others give NULL under 'skip' and stop
    the job under 'error'.
    """
    size = F.size(samples)
    extra = n - size
    left = F.floor(extra / 2) if pad_position == "center" else F.lit(0)
    croppable = label.isin(*crop_labels) if long != "crop" else F.lit(True)
    refused = F.raise_error(F.lit("command exceeds the window; use long='skip' or long='crop'"))
    action = (
        F.when(size < n, "padded")
        .when(size == n, "unchanged")
        .when(croppable, "cropped")
        .otherwise(F.lit("skipped_long") if long == "skip" else refused)
    )
    fitted = (
        F.when(size < n, pad(samples, left, extra - left))
        .when(size == n, samples)
        .when(croppable, F.slice(samples, (F.floor((size - n) / 2) + 1).cast("int"), n))
    )
    return fitted, action


def random_align(samples: Column, n: int, label: Column, commands: tuple[str, ...] | Column, u: Column) -> Column:
    """Length n at a random place: short clips shift within the window, long ones are cropped.

    `u` is uniform in [0, 1).  Commands are never cropped: a long one stops the job.
    """
    size = F.size(samples)
    is_command = commands if isinstance(commands, Column) else label.isin(*commands)
    left = F.floor(u * (n - size + 1)).cast("int")
    start = F.floor(u * (size - n + 1)).cast("int")
    refused = F.raise_error(F.lit("command exceeds the window")).cast("array<double>")
    return (
        F.when(size < n, pad(samples, left, n - size - left))
        .when(size == n, samples)
        .when(is_command, refused)
        .otherwise(F.slice(samples, start + 1, n))
    )


def gain_factor(peak_value: Column, u_apply: Column, u_db: Column, probability: float, low_db: float, high_db: float) -> Column:
    """Random gain: 1 when not applied, never so large that the peak passes 1."""
    g = F.pow(F.lit(10.0), (F.lit(low_db) + u_db * (high_db - low_db)) / 20)
    safe = F.when(peak_value > 0, F.least(g, F.lit(1.0) / peak_value)).otherwise(g)
    return F.when(u_apply < probability, safe).otherwise(F.lit(1.0))


INTEGER_RANGE = {"int8": (-128, 127), "uint8": (0, 255), "int16": (-32768, 32767)}


def quantize(xs: Column, scales: Column, zeros: Column, dtype: str = "int8") -> Column:
    """round(x / scale + zero), halves to even, clipped to the type's range.

    `scales` and `zeros` are arrays of length 1 (per tensor) or of the length of xs.
    """
    low, high = INTEGER_RANGE[dtype]
    refused = F.raise_error(F.lit("scales must be positive"))

    def step(x, i):
        at = F.when(F.size(scales) == 1, F.lit(1)).otherwise(i + 1)
        q = F.rint(x / F.element_at(scales, at) + F.element_at(zeros, at))
        return F.greatest(F.lit(low), F.least(F.lit(high), q)).cast("int")

    valid = (F.size(scales) > 0) & ~F.exists(scales, lambda s: s <= 0)
    return F.when(valid, F.transform(xs, step)).otherwise(refused.cast("array<int>"))


def dequantize(qs: Column, scales: Column, zeros: Column) -> Column:
    def step(q, i):
        at = F.when(F.size(scales) == 1, F.lit(1)).otherwise(i + 1)
        return (q - F.element_at(zeros, at)) * F.element_at(scales, at)

    return F.transform(qs, step)


def mask_axis(length: Column | int, count: int, bound: int, u: Callable[[str], Column]) -> Column:
    """Random spans struct(start, stop) along one axis; `u(name)` gives each draw.

    Widths are uniform in [0, min(bound, length + 1)), starts leave the span inside.
    """
    length = F.lit(length) if isinstance(length, int) else length
    if bound == 0 or count == 0:
        return F.array().cast("array<struct<start:int,stop:int>>")
    spans = []
    for i in range(count):
        width = F.floor(u(f"width{i}") * F.least(F.lit(bound), length + 1)).cast("int")
        start = F.floor(u(f"start{i}") * (length - width + 1)).cast("int")
        spans.append(F.struct(start.alias("start"), (start + width).alias("stop")))
    return F.array(*spans)


def masked(index: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (index >= s.start) & (index < s.stop))


def spec_augment(features: Column, frequency_spans: Column, time_spans: Column) -> Column:
    """Features (mel x frame) with the spans' rows and columns set to 0."""
    return let(
        frequency_spans,
        lambda fs: let(
            time_spans,
            lambda ts: F.transform(
                features,
                lambda row, i: let(
                    masked(i, fs),
                    lambda whole: F.transform(row, lambda x, j: F.when(whole | masked(j, ts), F.lit(0.0)).otherwise(x)),
                ),
            ),
        ),
    )
