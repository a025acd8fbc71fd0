"""Waveform queries over the clip view."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirrup.functions import arrays, dsp
from chirrup.functions.scan import running
from chirrup.operators import checks, clips
from workloads import standins as v
from workloads.views_sql import sql

QUERIES, ORACLES = {}, {}
SQUARES = "list_sum(list_transform(samples, lambda x: x * x))"
PEAK = "list_max(list_transform(samples, lambda x: abs(x)))"


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def r(column, digits=6):
    return F.round(column, digits) + F.lit(0.0)


def spread(df, column="y", *keys):
    """One row per sample, so that whole signals are compared."""
    keys = keys or ("clip_id",)
    long = df.select(*keys, F.posexplode(column).alias("pos", "x"))
    return long.select(*keys, F.col("pos").cast("bigint").alias("pos"), r(F.col("x")).alias("x"))


def spread_sql(relation, expr, keys="clip_id"):
    return f"""SELECT {keys}, pos, round(x, 6) + 0.0 AS x FROM (SELECT {keys}, unnest(ys) AS x, unnest(range(0, len(ys))) AS pos
FROM (SELECT {keys}, {expr} AS ys FROM {relation}))"""


@query("downmix", sql(spread_sql("v_clips", "list_transform(range(1, 33), lambda i: (samples[2 * i - 1] + samples[2 * i]) / 2)"), "v_clips"))
def downmix(spark, sf_dir):
    return spread(v.clips(spark, sf_dir).withColumn("y", arrays.downmix(F.col("samples"), 2, "mean")))


@query("peak_limit", sql(spread_sql("v_clips", f"list_transform(samples, lambda x: x * least(1.0, 0.3 / greatest({PEAK.replace('lambda x: abs(x)', 'lambda z: abs(z)')}, 1e-12)))"), "v_clips"))
def peak_limit(spark, sf_dir):
    return spread(v.clips(spark, sf_dir).withColumn("y", arrays.peak_limit(F.col("samples"), 0.3)))


FIT_CROP = ("class_1", "class_2")


@query(
    "fit_length",
    sql(
        f"""SELECT n, clip_id, action, pos, round(x, 6) + 0.0 AS x FROM (
  SELECT n, clip_id, action, unnest(range(0, len(ys))) AS pos, unnest(ys) AS x FROM (
    SELECT 80 AS n, clip_id, 'padded' AS action, list_concat(list_transform(range(0, 8), lambda i: 0.0), samples, list_transform(range(0, 8), lambda i: 0.0)) AS ys FROM v_clips
    UNION ALL SELECT 64, clip_id, 'unchanged', samples FROM v_clips
    UNION ALL SELECT 48, clip_id, 'cropped', samples[9:56] FROM v_clips WHERE label IN {FIT_CROP}))
UNION ALL SELECT 48, clip_id, 'skipped_long', NULL, NULL FROM v_clips WHERE label NOT IN {FIT_CROP}""",
        "v_clips",
    ),
)
def fit_length(spark, sf_dir):
    c = v.clips(spark, sf_dir)
    out = None
    for n in (80, 64, 48):
        y, action = arrays.fit_length(F.col("samples"), n, F.col("label"), long="skip", crop_labels=FIT_CROP)
        fitted = c.select(F.lit(n).alias("n"), "clip_id", action.alias("action"), y.alias("y"))
        part = fitted.select("n", "clip_id", "action", F.posexplode_outer("y").alias("pos", "x"))
        out = part if out is None else out.unionByName(part)
    return out.select("n", "clip_id", "action", F.col("pos").cast("bigint").alias("pos"), r(F.col("x")).alias("x"))


@query("dbfs", sql(f"SELECT clip_id, round(20 * log10({PEAK}), 6) + 0.0 AS peak_dbfs FROM v_clips", "v_clips"))
def dbfs(spark, sf_dir):
    return v.clips(spark, sf_dir).select("clip_id", r(arrays.dbfs(arrays.peak(F.col("samples")))).alias("peak_dbfs"))


LEVELS = f"""SELECT clip_id AS recording_id, CAST(64 AS BIGINT) AS frames, 0.004 AS duration_seconds, 20 * log10({PEAK}) AS peak_dbfs,
  20 * log10(sqrt({SQUARES} / 64)) AS rms_dbfs, len(list_filter(samples, lambda x: abs(x) >= 0.3)) / 64 AS clipped_fraction FROM v_clips"""


def levels(spark, sf_dir):
    """Each clip as four chunks of a recording."""
    c = v.clips(spark, sf_dir)
    chunks = c.select(F.col("clip_id").alias("recording_id"), "sample_rate", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chunk_idx"), "samples")
    chunks = chunks.withColumn("samples", F.slice("samples", F.col("chunk_idx") * 16 + 1, F.lit(16)))
    return clips.recording_levels(chunks, clip_at=0.3)


@query(
    "recording_levels",
    sql("SELECT recording_id, frames, duration_seconds, round(peak_dbfs, 6) + 0.0 AS peak_dbfs, round(rms_dbfs, 6) + 0.0 AS rms_dbfs, clipped_fraction FROM l", "v_clips", l=LEVELS.replace("0.004 AS", "CAST(0.004 AS DOUBLE) AS")),
)
def recording_levels(spark, sf_dir):
    return levels(spark, sf_dir).withColumns({c: r(F.col(c)) for c in ("peak_dbfs", "rms_dbfs")})


@query(
    "level_flags",
    sql("SELECT recording_id, peak_dbfs < -9.0 AS too_quiet, clipped_fraction > 0.02 AS clipping FROM l", "v_clips", l=LEVELS),
)
def level_flags(spark, sf_dir):
    return checks.level_flags(levels(spark, sf_dir), -9.0, 0.02).select("recording_id", "too_quiet", "clipping")


@query(
    "validate_audio_format",
    sql(
        """SELECT clip_id, CASE WHEN clip_id % 13 = 1 THEN 'sample_rate' WHEN clip_id % 11 = 2 THEN 'channels' WHEN clip_id % 7 = 3 THEN 'empty'
  WHEN abs(samples[64]) > 0.2 THEN 'nonfinite' END AS fault FROM v_clips""",
        "v_clips",
    ),
)
def validate_audio_format(spark, sf_dir):
    c, i = v.clips(spark, sf_dir), F.col("clip_id")
    last = F.element_at("samples", 64)
    broken = F.when(last > 0.2, float("nan")).when(last < -0.2, float("inf")).otherwise(last)
    rows = c.select(
        "clip_id",
        F.when(i % 13 == 1, 8000).otherwise(16000).alias("sample_rate"),
        F.when(i % 11 == 2, 2).otherwise(1).alias("channels"),
        F.when(i % 7 == 3, F.array().cast("array<double>")).otherwise(F.concat(F.slice("samples", 1, 63), F.array(broken))).alias("samples"),
    )
    return checks.validate_audio_format(rows).select("clip_id", "fault")


@query(
    "quantize",
    sql(
        """SELECT clip_id, pos, CAST(q AS INTEGER) AS q, round((q - z) * s, 9) + 0.0 AS x FROM (
  SELECT clip_id, pos, s, z, greatest(-128, least(127, round_even(x / s + z, 0))) AS q FROM (
    SELECT clip_id, unnest(range(0, 64)) AS pos, unnest(samples) AS x, unnest(list_transform(range(0, 64), lambda i: 0.001 + i / 32000)) AS s,
      unnest(list_transform(range(0, 64), lambda i: CAST(i % 5 - 2 AS DOUBLE))) AS z FROM v_clips))""",
        "v_clips",
    ),
)
def quantize(spark, sf_dir):
    i = F.sequence(F.lit(0), F.lit(63))
    scales = F.transform(i, lambda k: F.lit(0.001) + k / F.lit(32000))
    zeros = F.transform(i, lambda k: (k % 5 - 2).cast("double"))
    c = v.clips(spark, sf_dir).select("clip_id", "samples", scales.alias("s"), zeros.alias("z"))
    q = c.withColumn("q", arrays.quantize(F.col("samples"), F.col("s"), F.col("z"), "int8"))
    both = q.withColumn("x", arrays.dequantize(F.col("q"), F.col("s"), F.col("z")))
    long = both.select("clip_id", F.posexplode(F.arrays_zip("q", "x")).alias("pos", "e"))
    return long.select("clip_id", F.col("pos").cast("bigint").alias("pos"), F.col("e.q").alias("q"), r(F.col("e.x"), 9).alias("x"))


def rms_sql(frame, hop, count):
    return f"""list_transform(range(0, {count}), lambda i: sqrt(list_sum(list_transform(samples[i * {hop} + 1 : i * {hop} + {frame}], lambda x: x * x)) / {frame}))"""


@query("frame_rms", sql(spread_sql("v_clips", rms_sql(8, 4, 15)), "v_clips"))
def frame_rms(spark, sf_dir):
    return spread(v.clips(spark, sf_dir).withColumn("y", dsp.rms_frames(F.col("samples"), 8, 4)))


TRIM = {"min_s": 0.0025, "max_s": 0.0038, "margin_ms": 0.1875, "frame": 8, "hop": 4, "relative_db": -3.0, "exempt": ("class_0",)}


def trim_sql(source, count):
    return {
        "rms": f"SELECT *, {rms_sql(8, 4, count)} AS rms FROM {source}",
        "act": """SELECT *, list_filter(range(0, len(rms)), lambda i: rms[i + 1] > greatest(list_max(rms) * pow(10, -3.0 / 20), pow(10, -55.0 / 20))) AS act FROM rms""",
        "span": """SELECT *, CASE WHEN label = 'class_0' THEN 0 ELSE greatest(0, act[1] * 4 - 3) END AS a,
  CASE WHEN label = 'class_0' THEN len(samples) ELSE least(len(samples), act[-1] * 4 + 8 + 3) END AS b FROM act""",
        "trim": """SELECT *, CASE WHEN label = 'class_0' THEN NULL WHEN len(act) = 0 THEN 'no_speech_activity'
  WHEN (b - a) / 16000 < LOW OR (b - a) / 16000 > HIGH THEN 'speech_duration_outside_limits:' || printf('%.5f', (b - a) / 16000) END AS reason FROM span""",
    }


def limits(steps, low, high):
    return {**steps, "trim": steps["trim"].replace("LOW", str(low)).replace("HIGH", str(high))}


@query(
    "activity_trim",
    sql("SELECT clip_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS \"end\", reason FROM trim", "v_clips", **limits(trim_sql("v_clips", 15), 0.0025, 0.0038)),
)
def activity_trim(spark, sf_dir):
    return clips.activity_trim(v.clips(spark, sf_dir), **TRIM).select("clip_id", "start", "end", "reason")


@query(
    "clean_clip",
    sql(
        """SELECT clip_id, reason, round(d0, 6) AS original_duration_s, round(lft, 9) AS trimmed_left_s, round(rgt, 9) AS trimmed_right_s,
  round(dur, 9) AS duration_s, round(g, 5) AS gain, round(list_sum(list_transform(part, lambda x: abs(x) * g)), 4) + 0.0 AS level FROM (
  SELECT clip_id, reason, samples[a + 1 : b] AS part, CASE WHEN reason IS NULL THEN CAST(0.002 AS DOUBLE) END AS d0, CASE WHEN reason IS NULL THEN a / 16000 END AS lft,
    CASE WHEN reason IS NULL THEN (32 - b) / 16000 END AS rgt, CASE WHEN reason IS NULL THEN (b - a) / 16000 END AS dur,
    CASE WHEN reason IS NULL THEN least(1.0, 0.25 / greatest(list_max(list_transform(samples[a + 1 : b], lambda x: abs(x))), 1e-12)) END AS g FROM trim)""",
        "v_clips",
        mono="SELECT clip_id, label, list_transform(range(1, 33), lambda i: (samples[2 * i - 1] + samples[2 * i]) / 2) AS samples FROM v_clips",
        **limits(trim_sql("mono", 7), 0.0012, 0.0019),
    ),
)
def clean_clip(spark, sf_dir):
    c = v.clips(spark, sf_dir).withColumn("channels", F.lit(2))
    out = clips.clean_clip(c, **{**TRIM, "min_s": 0.0012, "max_s": 0.0019}, ceiling=0.25).select("clip_id", "clean.*")
    level = F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.abs(x).cast("double"))
    return out.select(
        "clip_id", "reason", F.round("original_duration_s", 6).alias("original_duration_s"),
        *[F.round(c, 9).alias(c) for c in ("trimmed_left_s", "trimmed_right_s", "duration_s")],
        F.round("peak_limiter_gain", 5).alias("gain"), r(level, 4).alias("level"),
    )


def recordings(spark, sf_dir):
    """Clips in a row as the chunks of one recording per class; no task numbers a whole recording."""
    c = v.clips(spark, sf_dir).withColumnRenamed("label", "recording_id")
    block = F.floor(F.col("clip_id") / 65_536)
    placed = running(c, ["recording_id"], ["clip_id"], block, {"chunk_idx": ("sum", F.lit(1)), "start_frame": ("sum", F.size("samples"))})
    places = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("chunk_idx", "start_frame")]
    return placed.select("recording_id", *places, "samples")


@query(
    "sliding_windows",
    sql(
        """SELECT recording_id, window_index, start_seconds, end_seconds, left_padding_seconds, round(list_sum(w), 5) + 0.0 AS total, round(w[1], 6) + 0.0 AS first, round(w[100], 6) + 0.0 AS last FROM (
  SELECT recording_id, k AS window_index, greatest(0, e - 100) / 16000 AS start_seconds, e / 16000 AS end_seconds, greatest(0, 100 - e) / 16000 AS left_padding_seconds,
    list_concat(list_transform(range(0, greatest(0, 100 - e)), lambda i: 0.0), audio[greatest(0, e - 100) + 1 : e]) AS w FROM (
    SELECT recording_id, audio, unnest(range(0, CAST(ceil(len(audio) / 24) AS BIGINT))) AS k, least((k + 1) * 24, len(audio)) AS e FROM (
      SELECT label AS recording_id, flatten(list(samples ORDER BY clip_id)) AS audio FROM v_clips GROUP BY 1)))""",
        "v_clips",
    ),
)
def sliding_windows(spark, sf_dir):
    w = clips.sliding_windows(recordings(spark, sf_dir), 100, 24, block_seconds=0.02)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return w.select(
        "recording_id", "window_index", "start_seconds", "end_seconds", "left_padding_seconds", r(total, 5).alias("total"),
        r(F.element_at("samples", 1).cast("double")).alias("first"), r(F.element_at("samples", 100).cast("double")).alias("last"),
    )


# A short-time transform spelled out as cosine and sine sums: 16-point frames, 12-sample Hann window, hop 4, 6 mel bands.
MEL_SQL = {
    "padded": "SELECT clip_id, list_concat(list_transform(range(0, 8), lambda i: samples[9 - i]), samples, list_transform(range(0, 8), lambda i: samples[63 - i])) AS y FROM v_clips",
    "term": """SELECT clip_id, f, n, y[f * 4 + n + 1] * CASE WHEN n BETWEEN 2 AND 13 THEN 0.5 - 0.5 * cos(2 * pi() * (n - 2) / 12) ELSE 0.0 END AS s
FROM padded, (SELECT unnest(range(0, 17)) AS f), (SELECT unnest(range(0, 16)) AS n)""",
    "spec": """SELECT clip_id, f, k, pow(sum(s * cos(2 * pi() * k * n / 16)), 2) + pow(sum(s * sin(2 * pi() * k * n / 16)), 2) AS p
FROM term, (SELECT unnest(range(0, 9)) AS k) GROUP BY 1, 2, 3""",
    "edge": "SELECT i, 700 * (pow(10, i * 2595 * log10(1 + 8000 / 700) / 7 / 2595) - 1) AS hz FROM (SELECT unnest(range(0, 8)) AS i)",
    "bank": """SELECT b.i - 1 AS m, k, greatest(0, least((k * 1000 - a.hz) / (b.hz - a.hz), (c.hz - k * 1000) / (c.hz - b.hz))) AS w
FROM edge a JOIN edge b ON b.i = a.i + 1 JOIN edge c ON c.i = b.i + 1, (SELECT unnest(range(0, 9)) AS k)""",
}


@query(
    "log_mel",
    sql("SELECT clip_id, m AS mel, f AS frame, round(ln(sum(p * w) + 1e-6), 5) + 0.0 AS x FROM spec JOIN bank USING (k) GROUP BY 1, 2, 3", "v_clips", **MEL_SQL),
)
def log_mel(spark, sf_dir):
    mel = dsp.log_mel(F.col("samples"), n_fft=16, win=12, hop=4, n_mels=6)
    rows = v.clips(spark, sf_dir).select("clip_id", F.posexplode(mel).alias("mel", "row")).select("clip_id", "mel", F.posexplode("row").alias("frame", "x"))
    return rows.select("clip_id", F.col("mel").cast("bigint").alias("mel"), F.col("frame").cast("bigint").alias("frame"), r(F.col("x"), 5).alias("x"))


# The filter from its definition: a sinc cut at the lower Nyquist rate under a Kaiser window (Bessel series), with gain `up`.
RESAMPLE_SQL = {
    "conv": "SELECT 44100 AS rate, 160 AS up, 441 AS down, 441 AS widest UNION ALL SELECT 8000, 2, 1, 2",
    "grid": "SELECT rate, up, widest, unnest(range(-10 * widest, 10 * widest + 1)) AS t FROM conv",
    "raw": """SELECT rate, up, t, CASE WHEN t = 0 THEN 1.0 ELSE sin(pi() * t / widest) / (pi() * t / widest) END
  * list_sum(list_transform(range(0, 30), lambda j: pow(pow(2.5 * sqrt(1 - pow(t / (10 * widest), 2)), j) / gamma(j + 1), 2))) AS v FROM grid""",
    "taps": "SELECT rate, t, v * up / sum(v) OVER (PARTITION BY rate) AS h FROM raw",
    "outs": "SELECT rate, up, down, unnest(range(0, CAST(ceil(64 * up / down) AS BIGINT))) AS m FROM conv",
    "weight": """SELECT o.rate, m, list(coalesce(h, 0.0) ORDER BY k) AS hs FROM outs o CROSS JOIN (SELECT unnest(range(0, 64)) AS k)
LEFT JOIN taps ON taps.rate = o.rate AND taps.t = m * down - k * up GROUP BY 1, 2""",
    "y": "SELECT clip_id, rate, m, list_dot_product(samples, hs) AS y FROM weight CROSS JOIN v_clips",
}


@query("resample", sql("SELECT clip_id, rate, m AS pos, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 5) + 0.0 AS x FROM y", "v_clips", **RESAMPLE_SQL))
def resample(spark, sf_dir):
    """Every clip from 44.1 kHz and from 8 kHz to 16 kHz."""
    c = v.clips(spark, sf_dir).select("clip_id", "samples", F.explode(F.array(F.lit(44100), F.lit(8000))).alias("rate"))
    y = c.withColumn("y", dsp.resampled(F.col("samples"), F.col("rate")))
    long = y.select("clip_id", "rate", F.posexplode("y").alias("pos", "x"))
    return long.select("clip_id", "rate", F.col("pos").cast("bigint").alias("pos"), r(F.col("x").cast("double"), 5).alias("x"))


@query(
    "pcm16_content_hash",
    sql(
        """SELECT clip_id, sha256(unhex(string_agg(printf('%02x%02x', u % 256, u // 256), '' ORDER BY pos))) AS content_sha256 FROM (
  SELECT clip_id, pos, CAST(round_even(greatest(-1.0, least(1.0, x)) * 32767, 0) AS BIGINT) AS q, CASE WHEN q < 0 THEN q + 65536 ELSE q END AS u FROM (
    SELECT clip_id, unnest(samples) AS x, unnest(range(0, 64)) AS pos FROM v_clips)) GROUP BY 1""",
        "v_clips",
    ),
)
def pcm16_content_hash(spark, sf_dir):
    return v.clips(spark, sf_dir).select("clip_id", dsp.pcm16_content_hash(F.col("samples")).alias("content_sha256"))
