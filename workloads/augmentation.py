"""Augmentation queries; the draws are the same md5 numbers in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirrup.functions import arrays
from chirrup.functions.rand import unit
from chirrup.operators import augment, joins
from chirrup.plans import examples
from workloads import standins as v
from workloads import views_sql
from workloads.views_sql import sql, u
from workloads.waveforms import MEL_SQL, RESAMPLE_SQL, r, spread, spread_sql

QUERIES, ORACLES = {}, {}
FREE = ("class_0", "class_1")


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


POOL = "SELECT clip_id AS pool_id, samples AS noise, row_number() OVER (ORDER BY md5(CAST(clip_id AS VARCHAR)), clip_id) - 1 AS i FROM v_clips WHERE label_id < 5"


def pick_sql(salt, seed=42):
    return f"CAST(floor({u('clip_id', salt, seed)} * (SELECT count(*) FROM pool)) AS BIGINT)"


def pool(spark, sf_dir):
    return v.clips(spark, sf_dir).where("label_id < 5")


@query(
    "random_pool_pick",
    sql(f"SELECT clip_id, i AS pool_index, pool_id FROM v_clips JOIN pool ON i = {pick_sql('pick')}", "v_clips", pool=POOL),
)
def random_pool_pick(spark, sf_dir):
    p = pool(spark, sf_dir).select(F.col("clip_id").alias("pool_id"))
    out = joins.random_pool_pick(v.clips(spark, sf_dir).select("clip_id"), "clip_id", p, "pool_id", "pick")
    return out.select("clip_id", "pool_index", "pool_id")


ZEROS = "list_transform(range(0, {n}), lambda i: 0.0)"


@query(
    "random_align",
    sql(
        f"""SELECT n, clip_id, pos, round(x, 6) + 0.0 AS x FROM (SELECT n, clip_id, unnest(range(0, n)) AS pos, unnest(ys) AS x FROM (
  SELECT 80 AS n, clip_id, list_concat(list_transform(range(0, shift), lambda i: 0.0), samples, list_transform(range(0, 16 - shift), lambda i: 0.0)) AS ys
  FROM (SELECT *, CAST(floor({u('clip_id', 'align')} * 17) AS BIGINT) AS shift FROM v_clips)
  UNION ALL SELECT 48, clip_id, samples[shift + 1 : shift + 48] FROM (SELECT *, CAST(floor({u('clip_id', 'align')} * 17) AS BIGINT) AS shift FROM v_clips)))""",
        "v_clips",
    ),
)
def random_align(spark, sf_dir):
    c, out = v.clips(spark, sf_dir), None
    everyone = tuple(f"class_{i}" for i in range(10))
    for n, exempt in ((80, FREE), (48, everyone)):
        y = augment.random_alignment(F.col("samples"), n, F.col("label"), F.col("clip_id"), exempt=exempt)
        part = spread(c.select(F.lit(n).alias("n"), "clip_id", y.alias("y")), "y", "n", "clip_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "random_gain",
    sql(
        spread_sql(
            f"""(SELECT clip_id, samples, CASE WHEN {u('clip_id', 'gain')} < 0.8 THEN
  least(pow(10, (-6.0 + {u('clip_id', 'gain_db')} * 24.0) / 20), 1.0 / list_max(list_transform(samples, lambda x: abs(x)))) ELSE 1.0 END AS g FROM v_clips)""",
            "list_transform(samples, lambda x: x * g)",
        ),
        "v_clips",
    ),
)
def random_gain(spark, sf_dir):
    y = augment.random_gain(F.col("samples"), F.col("clip_id"), 0.8, (-6.0, 18.0))
    return spread(v.clips(spark, sf_dir).withColumn("y", y))


@query(
    "random_speed",
    sql(
        f"""SELECT clip_id, rate AS speed_rate, CAST(ceil(64 * 100 / rate) AS INTEGER) AS frames FROM (
  SELECT clip_id, CASE WHEN {u('clip_id', 'speed')} < 0.5 THEN CAST(low + floor({u('clip_id', 'speed_rate')} * (110 - low + 1)) AS BIGINT) ELSE 100 END AS rate
  FROM (SELECT clip_id, CASE WHEN label IN {FREE} THEN 90 ELSE greatest(90, CAST(ceil(64 * 100 / 68) AS BIGINT)) END AS low FROM v_clips))""",
        "v_clips",
    ),
)
def random_speed(spark, sf_dir):
    out = augment.random_speed(v.clips(spark, sf_dir), 68, "clip_id", exempt=FREE)
    return out.select("clip_id", "speed_rate", F.size("samples").alias("frames"))


REVERB_SQL = {
    "pool": POOL,
    "cut": "SELECT i, noise[p0 : p0 + 15] AS h FROM (SELECT i, noise, list_position(list_transform(noise, lambda x: abs(x)), list_max(list_transform(noise, lambda x: abs(x)))) AS p0 FROM pool)",
    "kern": "SELECT i, list_transform(h, lambda x: x / sqrt(list_sum(list_transform(h, lambda z: z * z)))) AS h FROM cut",
    "chosen": f"""SELECT clip_id, samples, CASE WHEN label NOT IN {FREE} AND {u('clip_id', 'reverb')} < 0.5 THEN h END AS h
FROM v_clips JOIN kern ON i = {pick_sql('rir_pick')}""",
    "wet": """SELECT clip_id, samples, h, CASE WHEN h IS NOT NULL THEN list_transform(range(0, len(samples)),
  lambda n: list_sum(list_transform(range(0, least(len(h), n + 1)), lambda b: samples[n - b + 1] * h[b + 1]))) END AS w FROM chosen""",
    "even": """SELECT clip_id, samples, list_transform(w, lambda z: z * sqrt(list_sum(list_transform(samples, lambda q: q * q))
  / greatest(list_sum(list_transform(w, lambda q: q * q)), 1e-12))) AS v FROM wet""",
    "dry": "SELECT clip_id, CASE WHEN v IS NULL THEN samples ELSE list_transform(v, lambda z: z / greatest(1.0, list_max(list_transform(v, lambda q: abs(q))))) END AS y FROM even",
}


@query(
    "random_reverb",
    sql(
        "SELECT clip_id, unnest(range(0, len(y))) AS pos, round(unnest(y), 6) + 0.0 AS x FROM dry",
        "v_clips",
        **REVERB_SQL,
    ),
)
def random_reverb(spark, sf_dir):
    out = augment.random_reverb(v.clips(spark, sf_dir), pool(spark, sf_dir), "clip_id", "clip_id", 0.5, 16, FREE)
    return spread(out, "samples")


# Every other noise is doubled, and some clips are padded: noises are both longer and shorter than clips.
MIX_SQL = {
    "pool": POOL,
    "noises": "SELECT i, CASE WHEN i % 2 = 1 THEN list_concat(noise, list_reverse(noise)) ELSE noise END AS noise FROM pool",
    "fit": """SELECT clip_id, label, CASE WHEN label_id < 6 THEN list_concat(samples, list_transform(range(0, 16), lambda i: 0.0)) ELSE samples END AS samples FROM v_clips""",
    "drawn": f"""SELECT clip_id, samples, {u('clip_id', 'offset')} AS uo, 5.0 + {u('clip_id', 'snr')} * 15.0 AS snr,
  CASE WHEN label NOT IN {FREE} AND {u('clip_id', 'noise')} < 0.8 THEN noise END AS noise FROM fit JOIN noises ON i = {pick_sql('noise_clip_pick')}""",
    "cut": """SELECT *, CASE WHEN len(noise) < len(samples)
    THEN list_transform(range(0, len(samples)), lambda i: noise[(CAST(floor(uo * len(noise)) AS BIGINT) + i) % len(noise) + 1])
    ELSE list_transform(range(0, len(samples)), lambda i: noise[CAST(floor(uo * (len(noise) - len(samples) + 1)) AS BIGINT) + i + 1]) END AS z FROM drawn WHERE noise IS NOT NULL""",
    "mixed": """SELECT clip_id, list_transform(range(1, len(samples) + 1), lambda i: samples[i] + z[i] * sqrt(list_sum(list_transform(samples, lambda x: x * x))
    / (list_sum(list_transform(z, lambda x: x * x)) * pow(10, snr / 10)))) AS y FROM cut""",
}


@query(
    "background_mix",
    sql(
        """SELECT clip_id, pos, round(x, 6) + 0.0 AS x FROM (
  SELECT clip_id, unnest(range(0, len(y))) AS pos, unnest(list_transform(y, lambda v: v / greatest(1.0, list_max(list_transform(y, lambda w: abs(w)))))) AS x FROM mixed
  UNION ALL SELECT clip_id, unnest(range(0, len(samples))), unnest(samples) FROM drawn WHERE noise IS NULL)""",
        "v_clips",
        **MIX_SQL,
    ),
)
def background_mix(spark, sf_dir):
    fitted = F.when(F.col("label_id") < 6, arrays.pad(F.col("samples"), F.lit(0), F.lit(16))).otherwise(F.col("samples"))
    c = v.clips(spark, sf_dir).withColumn("samples", fitted)
    noises = joins.index_pool(pool(spark, sf_dir), "clip_id")
    doubled = F.when(F.col("pool_index") % 2 == 1, F.concat("samples", F.reverse("samples"))).otherwise(F.col("samples"))
    noises = noises.withColumn("samples", doubled).drop("pool_index")
    return spread(augment.background_mix(c, noises, "clip_id", "clip_id", exclude=FREE), "samples")


def hidden(axis, index, bound, length, seed=42):
    """Does one of two random spans of the axis cover the index?"""
    spans = []
    for i in range(2):
        w = f"CAST(floor({u('clip_id', f'{axis}_width{i}', seed)} * {min(bound, length + 1)}) AS BIGINT)"
        s = f"CAST(floor({u('clip_id', f'{axis}_start{i}', seed)} * ({length} - {w} + 1)) AS BIGINT)"
        spans.append(f"({index} >= {s} AND {index} < {s} + {w})")
    return "(" + " OR ".join(spans) + ")"


@query(
    "spec_augment",
    sql(
        f"""SELECT clip_id, mel, frame, round(CASE WHEN {hidden('mel', 'mel', 3, 8)} OR {hidden('time', 'frame', 4, 8)} THEN 0.0
  ELSE samples[mel * 8 + frame + 1] END, 6) + 0.0 AS x FROM v_clips, (SELECT unnest(range(0, 8)) AS mel), (SELECT unnest(range(0, 8)) AS frame)""",
        "v_clips",
    ),
)
def spec_augment(spark, sf_dir):
    config = augment.Augmentation(frequency_mask=3, time_mask=4)
    bands, times = augment.mask_spans(F.col("clip_id"), 8, 8, config)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("samples", i * 8 + 1, 8))
    c = v.clips(spark, sf_dir).select("clip_id", rows.alias("features"), bands.alias("b"), times.alias("t"))
    y = c.select("clip_id", F.posexplode(arrays.spec_augment(F.col("features"), F.col("b"), F.col("t"))).alias("mel", "row"))
    long = y.select("clip_id", "mel", F.posexplode("row").alias("frame", "x"))
    return long.select("clip_id", F.col("mel").cast("bigint").alias("mel"), F.col("frame").cast("bigint").alias("frame"), r(F.col("x")).alias("x"))


def training_clips(spark, sf_dir):
    part = F.when(unit(F.col("clip_id"), "split") < 0.8, "train").otherwise("test")
    return v.clips(spark, sf_dir).select("clip_id", "label", part.alias("split"), F.size("samples").alias("frames"), F.col("samples").cast("array<float>").alias("samples"))


def noise_pool(spark, sf_dir):
    return pool(spark, sf_dir).select(F.col("clip_id").alias("id"), F.col("samples").cast("array<float>").alias("samples"))


def sumsq(xs):
    return f"list_sum(list_transform({xs}, lambda q: q * q))"


def top(xs):
    return f"list_max(list_transform({xs}, lambda q: abs(q)))"


# Speed, place, reverb, noise and gain of each training clip, step by step.
def chain_sql(seed=42):
    def u(key, salt):
        return views_sql.u(key, salt, seed)

    return {
        "conv": """SELECT rate, 100 // g AS up, rate // g AS down, greatest(100 // g, rate // g) AS widest
FROM (SELECT r AS rate, gcd(r, 100) AS g FROM (SELECT unnest(range(90, 111)) AS r)) WHERE rate <> 100""",
        **{k: RESAMPLE_SQL[k] for k in ("grid", "raw", "taps", "outs", "weight")},
        "speeds": "SELECT rate, list(hs ORDER BY m) AS ws FROM weight GROUP BY 1",
        **{k: REVERB_SQL[k] for k in ("pool", "cut", "kern")},
        "train": f"""SELECT *, CASE WHEN {u('clip_id', 'speed')} < 0.5 THEN CAST(floor(90 + {u('clip_id', 'speed_rate')} * 21) AS BIGINT) ELSE 100 END AS rate
FROM v_clips WHERE {views_sql.u('clip_id', 'split')} < 0.8""",
        "sped": "SELECT t.*, CASE WHEN t.rate = 100 THEN samples ELSE list_transform(ws, lambda w: list_dot_product(samples, w)) END AS y FROM train t LEFT JOIN speeds USING (rate)",
        "placed": f"""SELECT *, list_concat(list_transform(range(0, lft), lambda i: 0.0), y, list_transform(range(0, 80 - len(y) - lft), lambda i: 0.0)) AS p
FROM (SELECT *, CAST(floor({u('clip_id', 'align')} * (81 - len(y))) AS BIGINT) AS lft FROM sped)""",
        "wet": f"""SELECT *, CASE WHEN label NOT IN {FREE} AND {u('clip_id', 'reverb')} < 0.5
  THEN list_transform(range(0, 80), lambda n: list_sum(list_transform(range(0, least(len(h), n + 1)), lambda b: p[n - b + 1] * h[b + 1]))) END AS w
FROM placed JOIN kern ON i = {pick_sql('rir_pick', seed)}""",
        "even": f"SELECT *, list_transform(w, lambda z: z * sqrt({sumsq('p')} / greatest({sumsq('w')}, 1e-12))) AS v FROM wet",
        "rev": f"SELECT * EXCLUDE (i), CASE WHEN v IS NULL THEN p ELSE list_transform(v, lambda z: z / greatest(1.0, {top('v')})) END AS d FROM even",
        "noisy": f"""SELECT rev.*, CASE WHEN label NOT IN {FREE} AND {u('clip_id', 'noise')} < 0.8
  THEN list_transform(range(0, 80), lambda k: noise[(CAST(floor({u('clip_id', 'offset')} * 64) AS BIGINT) + k) % 64 + 1]) END AS z, 5.0 + {u('clip_id', 'snr')} * 15.0 AS snr
FROM rev JOIN pool ON pool.i = {pick_sql('noise_clip_pick', seed)}""",
        "mixed": f"""SELECT *, list_transform(range(1, 81), lambda k: d[k] + z[k] * sqrt({sumsq('d')} / ({sumsq('z')} * pow(10, snr / 10)))) AS m FROM noisy""",
        "loud": f"SELECT *, CASE WHEN z IS NULL THEN d ELSE list_transform(m, lambda x: x / greatest(1.0, {top('m')})) END AS f FROM mixed",
        "done": f"""SELECT clip_id, rate AS speed_rate, list_transform(f, lambda x: CAST(CAST(x * CASE WHEN {u('clip_id', 'gain')} < 0.8
  THEN least(pow(10, (-6.0 + {u('clip_id', 'gain_db')} * 12.0) / 20), 1.0 / {top('f')}) ELSE 1.0 END AS FLOAT) AS DOUBLE)) AS x FROM loud""",
    }


@query("augment_chain", sql(f"SELECT clip_id, speed_rate, 80 AS frames, round({sumsq('x')}, 5) + 0.0 AS energy FROM done", "v_clips", **chain_sql()))
def augment_chain(spark, sf_dir):
    config = augment.Augmentation(reverb_exclude=FREE, noise_exclude=FREE, commands_exempt=FREE, max_rir_seconds=0.001)
    sources = noise_pool(spark, sf_dir)
    out = augment.augment_chain(training_clips(spark, sf_dir), 80, config, "clip_id", sources, sources)
    return out.select("clip_id", "speed_rate", F.size("samples").alias("frames"), r(arrays.energy(F.col("samples")), 5).alias("energy"))


SEED = "42.1"
EXAMPLE_SQL = {
    **chain_sql(SEED),
    "ex": f"""SELECT clip_id, 'train' AS split, x FROM done UNION ALL
SELECT clip_id, 'test', list_concat(list_transform(range(0, 8), lambda i: 0.0), samples, list_transform(range(0, 8), lambda i: 0.0)) FROM v_clips WHERE {u('clip_id', 'split')} >= 0.8""",
    "padded": "SELECT clip_id, split, list_concat(list_transform(range(0, 8), lambda i: x[9 - i]), x, list_transform(range(0, 8), lambda i: x[79 - i])) AS y FROM ex",
    **{k: MEL_SQL[k].replace("range(0, 17)", "range(0, 21)") for k in ("term", "spec", "edge", "bank")},
    "mel": "SELECT clip_id, m, f, ln(sum(p * w) + 1e-6) AS x FROM spec JOIN bank USING (k) GROUP BY 1, 2, 3",
    "seen": f"""SELECT clip_id, split, CASE WHEN split = 'train' AND ({hidden('mel', 'm', 3, 6, SEED)} OR {hidden('time', 'f', 4, 21, SEED)}) THEN 0.0
  ELSE CAST(CAST(mel.x AS FLOAT) AS DOUBLE) END AS v FROM mel JOIN ex USING (clip_id)""",
}


@query(
    "materialize_examples",
    sql(
        """SELECT clip_id, split, label_id, 80 AS frames, 6 AS mels, CAST(count(*) AS INTEGER) AS cells, round(sum(v), 3) + 0.0 AS total
FROM seen JOIN v_clips USING (clip_id) GROUP BY 1, 2, 3""",
        "v_clips",
        **EXAMPLE_SQL,
    ),
)
def materialize_examples(spark, sf_dir):
    config = augment.Augmentation(reverb_exclude=FREE, noise_exclude=FREE, commands_exempt=FREE, max_rir_seconds=0.001, frequency_mask=3, time_mask=4)
    sources, out = noise_pool(spark, sf_dir), None
    for split in ("train", "test"):
        part = examples.materialize_examples(
            training_clips(spark, sf_dir), v.class_map(spark, sf_dir), config, split, "clip_id", 1, 42, sources, sources,
            window_seconds=0.005, n_fft=16, win=12, hop=4, n_mels=6,
        )
        out = part.select("clip_id", "split", "label_id", "samples", "features") if out is None else out.unionByName(
            part.select("clip_id", "split", "label_id", "samples", "features")
        )
    flat = F.flatten("features")
    return out.select(
        "clip_id", "split", "label_id", F.size("samples").alias("frames"), F.size("features").alias("mels"), F.size(flat).alias("cells"),
        r(arrays.total(F.transform(flat, lambda x: x.cast("double"))), 3).alias("total"),
    )
