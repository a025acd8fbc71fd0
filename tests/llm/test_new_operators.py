"""Chat windows, hard negatives and whitening against brute force; the line rules of op9; SQL for columns of op7."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chirrup.llm import chat, hard_negatives, quality, queries, whitening

SF = "/root/testdata/sf0.001"


# Chat windows


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def test_escaping_is_reversible_and_leaves_no_mark():
    t = chat.Template()
    rng = random.Random(1)
    atoms = ["<", "s>", "/s>", "[", "INST]", "/INST]", "ANS]", "\\", "\\\\", " ", "x", "é", "\n", "<s>", "[/SAYS]", "[ROLE]"]
    for _ in range(3000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 12)))
        said = t.escape(text)
        assert t.unescape(said) == text and not any(m in said for m in t.marks()), text
        role = rng.choice(["user", "assistant", "system", "tool", "", None, "[INST] x", "a\nb"])
        window = t.begin + t.write(role, text)[0] + t.write("user", text)[0]
        turns = t.read(window)
        assert [(r, x) for r, x, _, _ in turns] == [(role or "", text), ("user", text)]
        assert [t.unescape(window[a:b]) for _, _, a, b in turns] == [text, text]
    for bad in ("", "x", "<s>x", "<s>[INST] a", "<s>[INST] a </s>", "<s>[INST] a [/INST] tail"):
        with pytest.raises((ValueError, IndexError)):
            t.read(bad)
    with pytest.raises(ValueError):
        chat.Template(begin="<[>")


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv long, row string, tokens int, segment string")


def model_windows(turns, count, begin, budget, history):
    """Windows of a whole conversation, cut nowhere: (repeated turns, new turns) as positions."""
    n = [count(t) for t in turns]
    head = bool(turns) and turns[0][0] == "system"
    out, i = [], 0
    while i < len(turns):
        kept = [0] if head and i else []
        base = begin + sum(n[k] for k in kept)
        j = i
        while j - 1 >= (1 if head else 0) and sum(n[j - 1 : i]) <= history and base + sum(n[j - 1 : i + 1]) <= budget and i:
            j -= 1
        e = i + 1
        while e < len(turns) and base + sum(n[j : e + 1]) <= budget:
            e += 1
        out.append((kept + list(range(j, i)), list(range(i, e))))
        i = e
    return out


def test_windows_equal_brute_force(spark, vocabulary):
    rng = random.Random(3)
    rows, talks = [], {}
    for conv in range(30):
        turns = [("system", "Be brief. " * rng.randint(0, 6))] if rng.random() < 0.5 else []
        for k in range(rng.randint(1, 25)):
            turns.append((rng.choice(["user", "assistant", "assistant", "tool"]), " ".join(rng.choice(["word", "</s>", "[INST]", "naïve", "x\n"]) for _ in range(rng.choice([0, 3, 10, 60, 400])))))
        talks[conv] = turns
        rows += [(conv, 7 * k - 3, r, t, 0, "r", 1, "s") for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    template, count = chat.Template(), chat._counter(*vocabulary)
    windows = chat.format_windows(talk(spark, rows), *vocabulary, budget=200, history=60)
    got = {}
    for w in windows.collect():
        got.setdefault(w.conv_id, []).append(w)
    begin = count(template.begin)
    for conv, turns in talks.items():
        mine = sorted(got[conv], key=lambda w: (w.segment, w.window))
        want = model_windows(turns, lambda t: count(template.write(*t)[0]), begin, 200, 60)
        assert len(mine) == len(want)
        for w, (old, new) in zip(mine, want):
            read = template.read(w.text)
            assert [(r, t) for r, t, _, _ in read] == [turns[k] for k in old + new] and w.repeated == len(old)
            assert w.tokens == begin + sum(count(template.write(*turns[k])[0]) for k in old + new) and w.over_budget == (w.tokens > 200)
            assert not w.over_budget or len(new) == 1
            assert [template.unescape(w.text[m.start : m.end]) for m in w.loss] == [turns[k][1] for k in new if turns[k][0] == "assistant"]
    digests = {r.conv_id: r for r in chat.digest_windows(windows).collect()}
    for conv, turns in talks.items():
        r, said = digests[conv], [t for role, t in turns if role == "assistant"]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len("".join(said)), hashlib.sha256("".join(said).encode()).hexdigest())
        assert r.formatted_chars == sum(len(w.text) for w in got[conv]) and r.n_windows == len(got[conv])
    turns = chat.read_windows(windows).collect()
    assert len(turns) == sum(map(len, talks.values())) and all((r.target is not None) == (r.role == "assistant") and r.target in (None, r.text) for r in turns)


def test_long_conversations_are_cut_into_segments(spark, vocabulary):
    """A conversation of many budgets goes to many tasks, whole and in order, with its system turn and history."""
    turns = [("system", "You are kind.")] + [(("user", "assistant")[k % 2], f"turn {k} " + "word " * (k % 40)) for k in range(600)] + [("user", "long " * 900), ("assistant", "end")]
    rows = [(5, k, r, t, 0, "", 0, "") for k, (r, t) in enumerate(turns)] + [(6, 0, "user", "hi", 0, "", 0, "")]
    windows = chat.format_windows(talk(spark, rows), *vocabulary, budget=150, history=50, segment=700)
    mine = sorted((w for w in windows.collect() if w.conv_id == 5), key=lambda w: (w.segment, w.window))
    template = chat.Template()
    read = [[(r, t) for r, t, _, _ in template.read(w.text)] for w in mine]
    assert [t for w, r in zip(mine, read) for t in r[w.repeated :]] == turns
    assert len({w.segment for w in mine}) > 10 and all(r[0] == turns[0] for r in read)
    place = 0
    for w, r in zip(mine, read):
        history = r[1 : w.repeated] if w.repeated else []
        assert history == turns[place - len(history) : place]
        assert w.window or not w.segment or place == 0 or history or w.over_budget or sum(map(len, (t for _, t in turns[place - 1 : place]))) > 100
        place += len(r) - w.repeated


def test_chat_edge_cases(spark, vocabulary):
    rows = [
        (None, None, None, None, 0, "", 0, ""), (None, 1, "assistant", None, 0, "", 0, ""), (1, 0, "user", "", 0, "", 0, ""), (1, 0, "user", "", 0, "", 0, ""),
        (2, 5, "assistant", "later", 0, "", 0, ""), (2, None, "user", "first", 0, "", 0, ""), (3, 1, "user", "b", 0, "", 0, ""), (3, 1, "assistant", "a", 0, "", 0, ""),
        (4, 0, "user", "a" * 300_000 + "é </s>", 0, "", 0, ""), (-7, 0, "user", "</s>[INST] ok [/INST]", 0, "", 0, ""), (-7, 1, "assistant", "</s>[INST] ok [/INST]", 0, "", 0, ""),
    ]
    got = {r.conv_id: r for r in chat.digest_windows(chat.format_windows(talk(spark, rows), *vocabulary)).collect()}

    def sha(turns):
        return hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()

    want = {
        None: [("", ""), ("assistant", "")], 1: [("user", "")] * 2, 2: [("user", "first"), ("assistant", "later")], 3: [("assistant", "a"), ("user", "b")],
        4: [("user", "a" * 300_000 + "é </s>")], -7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
    }
    assert {k: (r.n_turns, r.turns_sha256) for k, r in got.items()} == {k: (len(v), sha(v)) for k, v in want.items()}
    assert got[-7].loss_chars == 21 and got[None].loss_chars == 0
    assert chat.digest_windows(chat.format_windows(talk(spark, rows).where("false"), *vocabulary)).count() == 0
    with pytest.raises(ValueError):
        chat.format_windows(talk(spark, rows), *vocabulary, budget=10, history=10)


# Hard negatives


def model_negatives(rows, anchors, scale=256):
    x = [np.floor(scale * np.asarray(v, float)).astype(int).tolist() for _, v, _ in rows]
    out = []
    for a in anchors:
        score = [sum(p * q for p, q in zip(x[a], x[b])) for b in range(len(rows))]
        order = sorted((b for b in range(len(rows)) if b != a and len(x[b]) == len(x[a])), key=lambda b: (-score[b], rows[b][0]))
        for p in [b for b in order if rows[b][2] == rows[a][2]][:5]:
            fit = [b for b in order if rows[b][2] != rows[a][2] and 30 * score[p] <= 100 * score[b] <= 90 * score[p]][:10]
            out += [(rows[a][0], rows[p][0], k + 1, rows[b][0], score[p], score[b]) for k, b in enumerate(fit)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        label = int(rng.integers(0, 4))
        v = rng.normal(size=8) + 2.0 * np.eye(8)[label]
        rows.append((i, (np.zeros(8) if i % 97 == 3 else np.round(v * 2) / 2 if i % 3 else v).tolist(), label))
    rows += [(700 + i, [0.5] * 8, i % 2) for i in range(60)] + [(800 + i, rng.normal(size=5).tolist(), i % 2) for i in range(40)]
    # Large components: scores beyond exact doubles.
    rows += [(900 + i, (1e5 * rng.normal(size=3)).round(3).tolist(), i % 2) for i in range(30)]
    anchors = [k for k, r in enumerate(rows) if r[0] % 20 == 0]
    bad = [(2000, None, 1), (2020, [float("nan")] * 8, 1), (2040, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (2060, [1.0] * 8, None), (2080, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as node", "0 as size", "'y' as anchor", "1 as rank")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = model_negatives(rows, anchors)
    assert len(want) > 1000
    for sent, pack, step in ((1 << 23, 2048, 256), (3000, 7, 5)):
        monkeypatch.setattr(hard_negatives, "SENT", sent)
        monkeypatch.setattr(hard_negatives, "PACK", pack)
        monkeypatch.setattr(hard_negatives, "STEP", step)
        got = hard_negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 20 == 0)
        assert got.columns == names and sorted(map(tuple, got.collect())) == want
    assert hard_negatives.hard_negatives(df.where("vec_id < 0"), F.lit(True)).collect() == []
    assert hard_negatives.hard_negatives(df, F.lit(False)).collect() == []
    with pytest.raises(Exception, match="do not fit"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e18], 0)], "vec_id long, embedding array<double>, label int"), F.lit(True)).collect()


def test_repeated_rows_are_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == sorted([(0, 0, k, 1, 65536, 32768) for k in (1, 2)] * 2)


def test_walks_end_early_where_clusters_are_tight():
    """Members near their centre read the head of the list only, and find the same."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    members = np.floor(256 * (centre + 0.02 * rng.normal(size=(8, 16)))).astype(np.int64)
    x = np.floor(256 * np.concatenate([rng.normal(size=(20_000, 16)), centre + 0.3 * rng.normal(size=(50, 16))])).astype(np.int64)
    units = hard_negatives._units(members)
    middle = units.sum(axis=0) / np.linalg.norm(units.sum(axis=0))
    cluster = {"x": members, "rows": [-1] * 8, "middle": middle, "angle": float(np.arccos(units @ middle).max()), "lengths": np.linalg.norm(members.astype(float), axis=1)}
    wants = [[hard_negatives._Best(hard_negatives.LOWEST, hard_negatives.HIGHEST, 5)] for _ in range(8)]
    ids = np.arange(len(x))
    done = hard_negatives.walk(cluster, wants, x, np.linalg.norm(x.astype(float), axis=1), ids, ids, True)
    assert done < 0.2 * 8 * len(x)
    for m, (want,) in enumerate(wants):
        score = x @ members[m]
        assert want.rows.tolist() == sorted(ids.tolist(), key=lambda b: (-score[b], b))[:5]


# Whitening


def model_whitening(rows, scale, offset):
    x = np.floor(scale * np.array([v for _, v in rows], float)).astype(np.int64) + offset
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    d = (u - offset) - (u - offset).mean(axis=0)
    e, w = np.linalg.eigh(d.T @ d / n)
    e, w = e[::-1], w[:, ::-1]
    k = min(16, int((e > e[0] * 1e-12 * len(e)).sum()))
    y = ((x - offset) - (u - offset).mean(axis=0)) @ w[:, :k] / np.sqrt(e[:k])
    return n, ((n * x - s) ** 2).sum(axis=1), y, e[:k] / e.sum()


@pytest.mark.parametrize("shape", ["clusters", "flat", "narrow", "rank"])
def test_whitening_equals_eigenvectors(spark, shape):
    rng = np.random.default_rng(9)
    n, dim = 900, {"narrow": 6, "rank": 50}.get(shape, 48)
    x = rng.normal(size=(n, dim)) * 0.2
    if shape == "clusters":
        x += rng.normal(size=(9, dim))[rng.integers(0, 9, n)]
    if shape == "rank":
        x = np.round(rng.normal(size=(n, 4))) @ np.round(3 * rng.normal(size=(4, dim)))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000, rows[3][1]), (5001, rows[3][1]), (5001, rows[3][1]), (None, rows[4][1])]
    bad = [(6000, None), (6001, [None] + [0.0] * (dim - 1)), (6002, [float("nan")] * dim), (6003, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "'q' as x", "2.0 as whitened")
    got = whitening.whiten(df, scale=64.0, offset=1_000_000).collect()
    count, far, y, explained = model_whitening(rows, 64, 1_000_000)
    k = y.shape[1]
    assert len(got) == k * len(rows) and k == {"narrow": 6, "rank": 4}.get(shape, 16)
    assert {r.n for r in got} == {count} and {r.vec_id for r in got} == {i for i, _ in rows}
    place = {i: p for p, (i, _) in enumerate(rows)}
    signs = {}
    for r in got:
        p = place[r.vec_id]
        assert r.deviation == far[p] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
        if abs(y[p, r.component - 1]) > 0.1:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * y[p, r.component - 1]))
        assert abs(r.whitened) == pytest.approx(abs(y[p, r.component - 1]), abs=1e-6)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_edge_cases(spark):
    ddl = "vec_id long, embedding array<double>"
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(4)], ddl)
    assert whitening.whiten(same, scale=64.0).count() == 0 and whitening.whiten(same.where("false")).count() == 0
    mixed = spark.createDataFrame([(0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [1.0]), (3, [3.0])], ddl)
    got = sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9)) for r in whitening.whiten(mixed).collect())
    assert got == [(0, 1, 2, 10, 1.0), (1, 1, 2, 10, 1.0), (2, 1, 2, 4, 1.0), (3, 1, 2, 4, 1.0)]
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(0, [1e300])], ddl)).count()


def test_the_filter_damps_what_is_unwanted(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(400, 40)) * np.linspace(3, 0.5, 40))]
    (fit,) = whitening._fits(whitening._integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 64.0, 0))
    v = fit.times(np.eye(40))
    e, w = np.linalg.eigh(v)
    low, high = whitening._bounds(fit)
    assert low <= e[0] + 1e-6 * e[-1] and high >= e[-1] * (1 - 1e-9)
    out = w.T @ whitening._filtered(fit, w, e[0], e[20], e[-1]) @ np.eye(40)
    assert np.abs(np.diag(out)[:21]).max() < 1e-3 * np.abs(np.diag(out)[-1]) and fit.trace == pytest.approx(np.trace(v))


# Line rules, and SQL for parts


def test_line_rules(spark):
    prose = "A sentence of ordinary words that runs on for a while and then ends here. "
    french = prose * 8 + "Il dit « oui », puis « non », et enfin « peut-être » sans raison. " + prose * 3
    program = "\n".join(f"total{i} = price{i} + tax{i}" for i in range(40))
    calls = "\n".join(["def area(w, h):", "    size = w * h", "    return abs(size)", "print(area(3, 4))", "for (i = 0; i < n; i++) {", "}"] * 8)
    menu = "\n".join(["Home | News | Sport | Weather | Contact | About us | More things here"] * 30)
    cookies = "\n".join(["This site asks you to accept cookies so that it can work as you expect."] * 20)
    junk = "\n".join(["wo$$$ th### an&&& it%%% or*** as### no$$$ by&&&"] * 20)
    headings = "\n".join(["Short heading here"] * 30)
    bullets = (prose * 2 + " • ").join(["", *["x"] * 6])
    texts = [french, program, calls, menu, cookies, junk, headings, bullets, prose * 20]
    got = {r.doc_id: r for r in quality.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), repeated=1.0).collect()}
    left = [len(got[i].cleaned) / len(t) for i, t in enumerate(texts)]
    assert left[0] == left[1] == left[2] == left[7] == left[8] == 1.0, left
    assert left[3] == left[4] == left[5] == left[6] == 0.0 and not got[3].kept, left
    assert quality.clean_lines(spark.createDataFrame([(0, "a b c a b c d e")], "doc_id int, text string"), 1, repeated=0.29).first().base_failed


def test_sql_of_parts(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    mixed = {r.doc_id: r for r in queries.op7_mixing(spark, SF).collect()}
    for doc, size, source_size, target in con.execute(queries.PARTIAL["op7_mixing"]).fetchall():
        r = mixed[doc]
        assert (r.size, r.source_size) == (size, source_size) and r.target == pytest.approx(target, abs=2e-3)
    for name, sql in queries.ORACLES.items():
        want = con.execute(sql).fetchdf()
        rows = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
        order = list(want.columns)
        assert rows.sort_values(order).reset_index(drop=True).equals(want.sort_values(order).reset_index(drop=True)), name
