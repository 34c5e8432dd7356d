"""Periodic runs, language and spelling groups against brute force, and the SQL of all text operators."""

import glob
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import byte_language, periodic_runs, queries, spelling_groups
from panelwright.llm.words import LOWER

from .conftest import odd_rows, prose

SF = "/root/testdata/sf0.001"

# 11 periodic runs


def brute_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            s = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - s >= q and i - s + q >= least:
                out.setdefault((s - q, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def fibonacci(n):
    a, b = ["x"], ["x", "y"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def mixed_words(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return fibonacci(rng.randint(1, 300))
    if kind == 1:
        return [x for _ in range(rng.randint(1, 8)) for x in ["a"] * rng.randint(0, 60) + ["b"] * rng.randint(0, 3)]
    if kind == 2:
        u, v = ([rng.choice("ab") for _ in range(rng.randint(1, 12))] for _ in range(2))
        return [x for _ in range(rng.randint(1, 8)) for x in u * rng.randint(0, 12) + v * rng.randint(0, 12)][:500]
    if kind == 3:
        blocks = [[rng.choice("abcdefghi"[: rng.choice([1, 2, 9])]) for _ in range(rng.randint(1, 30))] * rng.randint(1, 6) for _ in range(rng.randint(1, 5))]
        return [x for b in blocks for x in b]
    return [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 400))]


def test_runs_match_brute_force(spark):
    rng = random.Random(4)
    texts = [mixed_words(rng) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in periodic_runs.periodic_runs(docs).collect():
        want = brute_runs(texts[r.doc_id])
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == collapsed(texts[r.doc_id], want)


@pytest.mark.parametrize("least", [2, 3, 5, 20])
def test_runs_of_other_least_lengths(spark, least):
    rng = random.Random(least)
    texts = [mixed_words(rng)[:150] for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for r in periodic_runs.periodic_runs(docs, least=least).collect():
        assert [tuple(x) for x in r.runs] == brute_runs(texts[r.doc_id], least)


def test_runs_of_long_texts_take_linear_time(spark):
    rng = random.Random(1)
    line = prose(rng, 10)
    texts = ["x " * 400_000, "x " * 20_000 + "y " + "x " * 20_000, " ".join(f"{line} {rng.random()}" for _ in range(20_000)), " ".join(prose(rng, 999).split() * 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(docs).collect()}
    assert got[0] == [(0, 400_000, 1)]
    assert got[1] == [(0, 20_000, 1), (20_001, 20_000, 1)]
    assert got[2] == []
    assert (0, 99_900, 999) in got[3]


def test_runs_of_odd_rows(odd_docs, no_docs):
    assert periodic_runs.periodic_runs(no_docs).collect() == []
    want = Counter()
    for row in odd_rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")
        runs = brute_runs(w[:2000])  # the long text has no repeats
        want[row[0], collapsed(w, runs), str(runs)] += 1
    got = Counter((r.doc_id, r.collapsed, str([tuple(x) for x in r.runs])) for r in periodic_runs.periodic_runs(odd_docs).collect())
    assert got == want


def test_planted_words(spark):
    rng = random.Random(8)
    texts = {i: prose(rng, rng.randint(0, 60)) for i in range(200)} | {None: "a b c", 1000: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen = 0
    for r in periodic_runs.planted(docs).collect():
        w, h = (texts[r.id] or "").split(), zlib.crc32(str(r.id).encode())
        if r.id is None or h % 10 or not w:
            assert r.t == texts[r.id]
            continue
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        seen += 1
        assert r.t.split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    assert seen > 10


# 12 language


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return byte_language.train_language(docs, byte_language.language_fold())


def test_language_of_held_out_rows(spark, net):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = byte_language.predict_language(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter(byte_language.language_fold() & F.col("lang").isNotNull())
    rows = got.collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 < r.score <= 1 for r in rows)


def test_language_training_is_repeatable(spark, net):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    again = byte_language.train_language(docs.repartition(5), byte_language.language_fold())
    assert again.langs == net.langs
    assert all(np.array_equal(a, b) for a, b in zip(again.filters, net.filters, strict=True))


def test_pooled_responses_match_a_plain_convolution(net):
    rng = np.random.default_rng(2)
    win = rng.integers(0, 256, (5, byte_language.LENGTH)).astype(np.uint8)
    got, want = net.pooled(win), []
    for w, f, b in zip(byte_language.WIDTHS, net.filters, net.bias, strict=True):
        at = np.stack([[sum(f[k, row[i + k]] for k in range(w)) for i in range(byte_language.LENGTH - w + 1)] for row in win])
        want.append(at.max(axis=1) + b)
    assert got == pytest.approx(np.concatenate(want, axis=1), abs=1e-4)


def test_windows_cover_whole_texts():
    raw = [b"", b"a" * 192, b"b" * 193, b"c" * 500]
    win, first = byte_language.windows(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    assert first.tolist() == [0, 1, 2, 4, 7]
    assert [win[a:b].tobytes().rstrip(b"\0") for a, b in zip(first[:-1], first[1:], strict=True)] == raw


def test_language_rows_stand_alone(spark, net):
    """A row's numbers don't depend on the rows beside it."""
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(150)]
    whole = net.predict(LOWER[np.frombuffer("".join(texts).encode(), dtype=np.uint8)], np.cumsum([0, *(len(t.encode()) for t in texts)]))
    for i in (0, 7, 149):
        raw = texts[i].encode()
        name, score = net.predict(LOWER[np.frombuffer(raw, dtype=np.uint8)], np.array([0, len(raw)]))
        assert name[0] == whole[0][i] and score[0] == whole[1][i]


def test_language_of_odd_rows(spark, odd_docs, no_docs, net):
    assert byte_language.predict_language(no_docs, net).collect() == []
    rows = odd_docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    by = {}
    for r in byte_language.predict_language(rows, net).join(rows, "doc_id").collect():
        spoken = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred in net.langs) if spoken else (r.lang_pred, r.score) == ("und", 0.0)
        assert by.setdefault(r.text, (r.lang_pred, r.score)) == (r.lang_pred, r.score)
    odd = spark.createDataFrame([(1, "12 34!"), (2, "東京"), (3, "… —")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in byte_language.predict_language(odd, net).collect()} == {1: True, 2: False, 3: True}
    for docs in (no_docs, odd_docs.withColumn("lang", F.lit(None).cast("string"))):
        empty = byte_language.train_language(docs, byte_language.language_fold())
        assert {r.lang_pred for r in byte_language.predict_language(odd_docs, empty).collect()} == {"und"}
    few = byte_language.train_language(odd_docs, byte_language.language_fold())
    assert {r.lang_pred for r in byte_language.predict_language(odd_docs, few).collect()} <= {"en", "fr", "und"}


# 13 spelling groups


def edits(u, v):
    row = list(range(len(v) + 1))
    for i, a in enumerate(u):
        new = [i + 1]
        for j, b in enumerate(v):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute_groups(words, times=5):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    form = {w: next((v for v in sorted(near[w], key=lambda v: (-words[v], v))[:1] if words[v] >= times * words[w]), None) for w in words}
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (words[w], form[w], words.get(form[w]), root, len(near[w]))
    return out


def groups_of(spark, words):
    rows = spelling_groups.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    return {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in rows}


def test_groups_match_brute_force(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abéÿ"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 3, 5, 26, 130, 700]) for _ in range(400)}
    words |= {"x" * n: 5**k for k, n in enumerate(range(30, 36))} | {"w𝔊rd": 3, "wrd": 40, "a" * 3000: 1, "a" * 1500 + "b" + "a" * 1499: 9}
    assert groups_of(spark, words) == brute_groups(words)


def test_large_lists_are_halved(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(500)})
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    want = {tuple(sorted((u, v), key=lambda w: (len(w), w))) for i, u in enumerate(words) for v in words[:i] if abs(len(u) - len(v)) < 2 and edits(u, v) == 1}
    for most in (4, 30, 10_000):
        assert {(r.u, r.v) for r in spelling_groups.near_pairs(table, most=most).collect()} == want


def test_word_counts_match_brute_force(spark, odd_docs, no_docs):
    assert spelling_groups.spelling_groups(spelling_groups.word_counts(no_docs)).collect() == []
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for misspell in (0, 3):
        want = Counter()
        for row in odd_rows():
            for w in re.findall("[A-Za-zÀ-ÿ]+", row[1] or ""):
                w = w.translate(up)
                h = zlib.crc32(f"{row[0]}:{w}".encode())
                if misspell and row[0] is not None and h % misspell == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                want[w] += len(w) > 5
        got = {r.word: r.n for r in spelling_groups.word_counts(odd_docs, misspell=misspell).collect()}
        assert got == {w: n for w, n in want.items() if n >= 5}


def test_carried_checksums():
    for size in (0, 1, 7, 300):
        table, state = spelling_groups.carry_table(size), 0x89ABCDEF
        word = bytes(range(256))[:size] or b""
        word += b"z" * (size - len(word))
        moved = 0
        for k in range(4):
            moved ^= int(table[k, state >> 8 * k & 255])
        assert moved ^ zlib.crc32(word) == zlib.crc32(word, state)


# SQL of all text operators


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df, sql = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    rows = lambda r: sorted(map(repr, r))
    assert rows(tuple(r) for r in df.select(*cols).collect()) == rows(sql.select(*(f'"{c}"' for c in cols)).fetchall())


# candidates of disguised words


def test_candidates_match_brute_force():
    from panelwright.llm import noisy_toxicity as nt

    rng = random.Random(3)
    names = ["moron", "stupid", "looser", "aab", "é" * 3 + "b"]
    lexicon = np.sort(nt.bag(names))
    plain = np.unique(nt.bag([re.sub(r"([a-z])\1+", r"\1", w) for w in names]))
    parts = ["mo", "ron", "m", "o", "r", "n", "stu", "pid", "s", "tupid", "loo", "ser", "lo", "sser", "aa", "b", "ab", "x", "é", "éé", "mor", "on", "7", "aabb", "stuupid", "moronn", "lloser"]
    gaps = [" ", "  ", ".", "..", "-", "--", "#", "[", "", " 7 ", "\n", "'", ", "]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(0, 30))) for _ in range(900)]
    raw = [t.encode() for t in texts]
    low, offs = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
    got = Counter(zip(*(x.tolist() for x in nt.pieced(low, offs, lexicon, max(len(w.encode()) for w in names))), strict=True))
    want = Counter()
    for i, t in enumerate(texts):
        runs = [(m.start(), m.end()) for m in re.finditer("[a-zé]+", t)]
        at = lambda k: len(t[:k].encode()) + int(offs[i])  # noqa: B023, E731
        joined = lambda a, b: re.fullmatch("[^0-9]*", t[runs[a][1] : runs[b][0]]) is not None  # noqa: B023, E731
        bound = lambda a: 0 <= a < len(runs) - 1 and joined(a, a + 1) and t[runs[a][1]] in "-_'`*~^"  # noqa: B023, E731
        for a in range(len(runs)):
            for b in range(a + 1, len(runs)):
                if all(joined(k, k + 1) for k in range(a, b)) and "".join(t[x:y] for x, y in runs[a : b + 1]) in names and not bound(a - 1) and not bound(b):
                    want[i, at(runs[a][0]), at(runs[b][1])] += 1
    assert got == want and len(want) > 20
    got = Counter(zip(*(x.tolist() for x in nt.repeated(low, offs, lexicon, plain)), strict=True))
    once = lambda w: re.sub(r"([a-z])\1+", r"\1", w)
    want = Counter()
    for i, t in enumerate(texts):
        for m in re.finditer("[a-zé]+", t):
            if once(m[0]) != m[0] and m[0] not in names and once(m[0]) in map(once, names):
                want[i, len(t[: m.start()].encode()) + int(offs[i]), len(t[: m.end()].encode()) + int(offs[i])] += 1
    assert got == want and len(want) > 3


@pytest.fixture(scope="module")
def abuse(spark):
    from panelwright.llm import noisy_toxicity as nt

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return nt.train_toxicity(docs, labels, nt.toxic_fold())


def test_disguises_score_like_the_plain_word(spark, abuse):
    from panelwright.llm.noisy_toxicity import score_toxicity

    frame = "the and of {} in the and that was there with of and to"
    hidden = ["stuupid", "stupiid", "looser", "iidiot", "idiott", "trassh", "st  upid", "s..tupid", "stu--pid", "mor  on", "s t up i d", "pa th e t ic", "s&t&u&p&i&d", "mor#on", "mo[ro]n", "s%tupid"]
    clean = ["idiom", "looses", "patent", "more on", "mortal", "trace", "stupor", "was"]
    rows = spark.createDataFrame([(i, frame.format(w)) for i, w in enumerate(["stupid", *hidden, *clean])] + [(90, None), (91, ""), (92, frame.format("stupid"))], "doc_id long, text string")
    got = {r.doc_id: r.toxic_score for r in score_toxicity(rows, abuse).collect()}
    assert got[0] > 0.9 and all(got[i] == pytest.approx(got[0], abs=0.05) for i in range(1, 1 + len(hidden)))
    assert all(got[i] < 0.5 for i in range(1 + len(hidden), 1 + len(hidden) + len(clean)))
    assert got[90] == got[91] and got[92] == got[0]
