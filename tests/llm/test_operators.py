"""Each operator on rows that break careless code, against brute force where its result is defined by more than itself."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import flow_mixing, fm_decontaminate, fm_quality, fst_tokens, graph, hilbert_shards, noisy_toxicity, parity_join, preference_format, store, url_rules, wav_prints

from .conftest import odd_rows, prose

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


# 1 quality


def test_quality_rows_and_columns(odd_docs, no_docs, labels, no_labels):
    for docs, marks in itertools.product((odd_docs, no_docs), (labels, no_labels)):
        m = fm_quality.train_quality(docs, marks, fm_quality.quality_fold(), meta_cols=("n_chars",))
        out = fm_quality.score_quality(docs, m, meta_cols=("n_chars",))
        assert sorted(out.columns) == sorted(docs.columns)
        rows = out.collect()
        assert len(rows) == docs.count()
        assert all(0 <= r.quality_score <= 1 for r in rows)
        by = {}
        for r in rows:
            assert by.setdefault((r.text, r.n_chars), r.quality_score) == r.quality_score
        if marks is no_labels:
            assert {r.quality_score for r in rows} <= {0.5}


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    m = fm_quality.Machine(np.zeros((2, fm_quality.BINS - 1)), 0.3, rng.standard_normal(70_000), rng.standard_normal((70_000, 4)).astype(np.float32))
    dense = np.array([[0.5, np.nan]])
    bucket, weight = np.array([3, 9, 200]), np.array([0.2, 0.5, 0.7])
    cells = m.cells(dense)[0]
    idx, x = np.concatenate([bucket, cells]), np.concatenate([weight, np.full(2, 1 / np.sqrt(2))])
    z = m.bias + x @ m.w[idx] + sum(x[i] * x[j] * float(m.v[idx[i]] @ m.v[idx[j]]) for i, j in itertools.combinations(range(5), 2))
    got = m.score(dense, np.zeros(3, dtype=int), bucket, weight)
    assert got[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_quality_features_match_brute_force():
    rng = random.Random(3)
    texts = ["", "  ", "One two, TWO two?! ##", "A\nB\nC9 é", *(" ".join(rng.choice(["the", "The", "THE", "x!", "?", "a1!!", "ß", "ab-cd"]) for _ in range(rng.randint(1, 60))) for _ in range(20))]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    stats, row, bucket, weight = fm_quality.features(np.frombuffer(b"".join(raw), dtype=np.uint8), offs)
    marks = "!?,.:;#$%&*+<=>@\\^_`{|}~"
    for i, t in enumerate(texts):
        words, low, size = re.findall(r"[^\x20\x09-\x0D]+", t), spaced(t), len(raw[i])
        share = lambda n, of: n / max(of, 1)
        bytes_of = lambda f: share(sum(len(c.encode()) for c in t if f(c)), size)
        want = [bytes_of(lambda c: "A" <= c <= "Z"), bytes_of(lambda c: "0" <= c <= "9"), bytes_of(lambda c: c == "\n"), bytes_of(lambda c: c in "!?,.:;"), bytes_of(lambda c: c in marks[6:]), bytes_of(lambda c: ord(c) > 127)]
        want += [share(sum(len(w) > 1 and w[-1] in marks and w[-2] in marks for w in words), len(words)), share(sum(bool(re.match("[A-Z]{2}", w)) for w in words), len(words))]
        want += [share(sum(w in marks for w in words), len(words)), share(len(set(zip(low, low[1:], low[2:], strict=False))), max(len(low) - 2, 1))]
        want += [min(share(sum(len(w.encode()) for w in words), len(words)), 40) / 40, np.log2(size + 1) / 32, share(len(set(alnum(t))), len(alnum(t)))]
        assert stats[i] == pytest.approx(want), t
        counts = Counter(alnum(t))
        length = np.sqrt(sum(np.log1p(n) ** 2 for n in counts.values()))
        assert sorted(weight[row == i]) == pytest.approx(sorted(np.log1p(n) / length for n in counts.values()))


def test_quality_learns_one_row_an_id(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30)) for i in range(40) for _ in range(1 + 20 * (i == 1))]
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = (fm_quality.train_quality(spark.createDataFrame(r, "doc_id long, text string").repartition(n), marks, fm_quality.quality_fold()) for r, n in ((rows, 2), (rows[::-1], 5)))
    assert a.bias == b.bias and np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_quality_learns_junk(spark):
    rng = random.Random(2)
    texts = [(i, prose(rng, 80) if i % 2 else " ".join(w + "***" for w in prose(rng, 80).split()), i % 2) for i in range(400)]
    docs, marks = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, quality int")
    m = fm_quality.train_quality(docs, marks, fm_quality.quality_fold())
    got = {r.doc_id: r.quality_score for r in fm_quality.score_quality(docs, m, keep=["doc_id"]).collect()}
    held = [i for i, *_ in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] > 0.5) == bool(i % 2) for i in held]) > 0.97


# 2 decontamination


def brute_hits(texts, items, width=10):
    windows = {}
    for name, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(name)
    out = []
    for t in texts:
        w, hit, who = alnum(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    who |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(who)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 25, 300, 2000])
def test_decontamination(spark, odd_docs, block_bytes):
    rng = random.Random(3)
    items = [(str(i), prose(rng, rng.choice([3, 9, 10, 11, 40]))) for i in range(25)] + [("n", None), ("e", "..."), ("a", "one two"), ("b", "One, TWO!")]
    texts = [r[1] for r in odd_rows()]
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1] or ""
            cut = rng.randint(0, 4)
            parts += [" ".join(w.split()[cut:]), prose(rng, rng.randint(0, 12))]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = fm_decontaminate.find_contamination(docs, bench, keep=["doc_id"], block_bytes=block_bytes).select("row.doc_id", "n_words", "spans", "items").collect()
    got = {r.doc_id: (r.n_words, sum(s.hi - s.lo for s in r.spans), r["items"]) for r in out}
    for i, want in enumerate(brute_hits(texts, items)):
        assert got[i] == want, i
    for r in out:
        kept = fm_decontaminate.cut_spans(texts[r.doc_id] or "", [(s.lo, s.hi) for s in r.spans])
        assert len(alnum(kept)) == r.n_words - sum(s.hi - s.lo for s in r.spans)


def test_decontamination_of_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert fm_decontaminate.find_contamination(no_docs, some).count() == 0
    rows = fm_decontaminate.find_contamination(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and not any(r.spans for r in rows)


def test_long_items_are_cut_and_lose_no_window(spark):
    rng = random.Random(14)
    texts = [prose(rng, n) for n in (0, 3, 9, 10, 11, 200, 900)] + ["x", "word" * 300, "... " * 400]
    items = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "item string, text string")

    def windows(t):
        w = alnum(t)
        return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}

    for most in (1, 40, 500, 10_000):
        got = {}
        for r in fm_decontaminate._cut(items, 10, most).collect():
            assert len(r.text) <= 4 * most + 200 or len(alnum(r.text)) <= 11
            got.setdefault(int(r["item"]), set()).update(windows(r.text))
        assert {i: got.get(i, set()) for i in range(len(texts))} == {i: windows(t) for i, t in enumerate(texts)}


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(4)
    for n, sigma in ((30, 2), (300, 3), (2000, 40), (500, 1)):
        text = np.concatenate([rng.integers(1, sigma + 1, n), [0]])
        index = fm_decontaminate.FMIndex(text)
        for k in (1, 2, 5):
            phrase = text[7 : 7 + k]
            live, lo, hi = index.search(text, np.array([7 + k]), np.array([k]))
            want = [i for i in range(n - k + 1) if (text[i : i + k] == phrase).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0]))) == want


# 3 Jaccard join


def brute_groups(texts, size=5):
    sets = []
    for t in texts:
        w = spaced(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_jaccard_components_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    passage = prose(rng, 12)
    texts = [r[1] for r in odd_rows() if r[1] is None or len(r[1]) < 10_000]
    for size in (3, 6, 9, 12, 20, 40, 80, 130, 150):
        words = prose(rng, size).split()
        texts += [edited(rng, words, rng.randint(0, max(1, size // 12))) for _ in range(14)]
        texts += [prose(rng, size) + " " + passage for _ in range(4)]
    words = prose(rng, 60).split()
    texts += [edited(rng, words, rng.randint(0, 6)) for _ in range(150)]  # many near copies, many of them apart
    texts += [" ".join(words[: 40 + k]) for k in range(20)]  # a chain of growing texts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = {i: w for i, w in enumerate(brute_groups(texts))}
    for block, shingles in ((4096, 1 << 20), (64, 1 << 20), (4096, 500)):
        monkeypatch.setattr(parity_join, "BLOCK", block)
        monkeypatch.setattr(parity_join, "SHINGLES", shingles)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(docs).collect()}
        assert got == want


def test_slices_that_many_distant_documents_file_are_filed_anew(spark, monkeypatch):
    rng = random.Random(21)
    passage = prose(rng, 14)
    texts = []
    for k in range(320):
        words = [f"w{rng.randrange(10**6)}" for _ in range(56)]
        at = rng.randrange(57)
        texts.append(" ".join([*words[:at], passage, *words[at:]]))
        texts += [texts[-1] + " more"] * (k % 8 == 0)
    texts += [edited(rng, texts[0].split(), 2) for _ in range(90)]  # and a component within the same slices
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {i: w for i, w in enumerate(brute_groups(texts))}
    compare, seen = parity_join._links_left, []
    monkeypatch.setattr(parity_join, "_links_left", lambda placed, sets, apart, percent: seen.append(apart.collect()) or compare(placed, sets, apart, percent))
    monkeypatch.setattr(parity_join, "COMMON", 0)  # the passage isn't known to be common
    monkeypatch.setattr(parity_join, "BLOCK", 16)
    for many in (1 << 20, 4):
        monkeypatch.setattr(parity_join, "MANY", many)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(docs).collect()}
        assert got == want
    crowded, dealt = seen
    assert max(r.rest_blocks for r in crowded) > 10
    assert max((r.rest_blocks for r in dealt), default=0) <= 4


def test_jaccard_links_depend_on_texts_and_not_on_ids(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        words = prose(rng, 60).split()
        texts += [" ".join(words), " ".join([*words[:59], "changed"])]
    want = collections_of(brute_groups(texts))
    for ids in ([None] * 60, [7] * 60, [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(60)]):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
        keyed = docs.withColumn("key", F.struct("doc_id", "text"))
        got = {r.key.text: r.component_id.text for r in parity_join.jaccard_components(keyed, id_col="key").collect()}
        assert collections_of([(0, got[t]) for t in texts]) == want
        rows = parity_join.jaccard_components(docs).collect()
        groups = [{ids[i] for i in g} - {None} for g in want]
        assert Counter(r.component_id for r in rows) == Counter(min(s, default=None) for g, s in zip(want, groups, strict=True) for _ in g)


def collections_of(groups):
    out = {}
    for i, (_, g) in enumerate(groups):
        out.setdefault(g, []).append(i)
    return sorted(out.values())


def cell_of(sets, own, comp, pivot):
    """A cell as the join collects it."""
    fields = {"own": own, "c": list(range(len(sets))), "n": [len(x) for x in sets], "comp": comp, "pivot": pivot, "sketch": [parity_join.parity_bits(x) for x in sets], "shingles": [np.sort(x).view(np.int64) for x in sets]}
    return pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))


@pytest.mark.parametrize("own", [0, 2])
def test_cells_of_like_documents_give_a_link_a_document(own):
    rng = np.random.default_rng(3)
    k = 20_000 if own == 0 else 4000
    base = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    sets = [np.concatenate([base[2:], rng.integers(1, 1 << 62, 2).astype(np.uint64)]) for _ in range(k)] + [rng.integers(1, 1 << 62, 60).astype(np.uint64)]
    cell = cell_of(sets, [i % own if own else 0 for i in range(k + 1)], list(range(k + 1)), [False] * k + [True])
    at = parity_join.close(cell, 0, own and 1)
    assert len(at) == k  # the odd one is near none
    a, b = parity_join.spanning_links(cell.take(pa.array(at)), 0, own and 1, 80)
    assert len(a) == k - 1 and {*a, *b} == set(range(k))


def test_cells_keep_every_component():
    rng = np.random.default_rng(4)
    for _ in range(20):
        bases = rng.integers(1, 1 << 62, (4, 30)).astype(np.uint64)
        sets = [np.concatenate([bases[rng.integers(4)][rng.integers(0, 6) :], rng.integers(1, 1 << 62, rng.integers(0, 5)).astype(np.uint64)]) for _ in range(60)]
        cell = cell_of(sets, [i % 2 for i in range(60)], list(range(60)), [False] * 60)
        links = set()
        for i, j in ((0, 0), (0, 1), (1, 1)):
            near = cell.take(pa.array(parity_join.close(cell, i, j)))
            links.update(zip(*parity_join.spanning_links(near, i, j, 80), strict=True))
        want = {(x, y) for x, y in itertools.combinations(range(60), 2) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))}
        assert links <= want
        root = list(range(60))
        for some in (links, want):
            for _ in range(60):
                for x, y in some:
                    root[x] = root[y] = min(root[x], root[y])
            joined, root = root, list(range(60))
            if some is links:
                first = joined
        assert first == joined


def test_slices_of_similar_sets_meet():
    rng = np.random.default_rng(8)
    for n in (1, 2, 4, 5, 9, 14, 40, 128, 700):
        for _ in range(30):
            a = rng.integers(1, 1 << 62, n).astype(np.uint64)
            drop = rng.integers(0, n // 9 + 1)
            b = np.concatenate([a[drop:], rng.integers(1, 1 << 62, rng.integers(0, n // 9 + 1)).astype(np.uint64)])
            if 100 * (n - drop) < 80 * (len(b) + drop):
                continue
            common = np.sort(rng.choice(a, n // 3, replace=False))
            row = np.repeat([0, 1], [len(a), len(b)])
            r, key = parity_join.filed_slices(row, np.concatenate([np.sort(a), np.sort(b)]), 2, common)
            assert set(key[r == 0]) & set(key[r == 1])


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(9)
    for n in (10, 300, 9000):
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[n // 5 :], rng.integers(1, 1 << 62, n // 3).astype(np.uint64)])
        sketches = [parity_join.parity_bits(x) for x in (a, b)]
        x, y = parity_join.folded(sketches, min(map(len, sketches)))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_jaccard_of_nothing(no_docs, odd_docs):
    assert parity_join.jaccard_components(no_docs).count() == 0
    assert parity_join.jaccard_components(odd_docs).count() == odd_docs.count()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in {x for a, b in links if a != b for x in (a, b)}:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[start] == min(seen)


# 4 urls


@pytest.mark.parametrize("literal", [100, 0])
def test_url_rules(spark, literal):
    urls = ["http://example.org/es/a", "HTTPS://A.EXAMPLE.ORG/en/12?x#y", "http://example.org", "http://notexample.org/es/", "x://b.com/fr/", "x://b.com/fr", "x://com/de/1", "//no", None, "", "http://a.b?q=/es/", "ftp://u@example.org:80/es/", "x://example.org/es/#/", "a\nb://example.org/en/1", "http://fr.com/com/fr/"]
    pages = spark.createDataFrame([(i % 12, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], None)], "page_id long, url string, tokens string")

    def want(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = host.translate(UP)
        fit = [(p, a) for a, p in url_rules.RULES for h, s, q in (p.partition("/"),) if (host == h or host.endswith("." + h)) and path.startswith(s + q)]
        p, a = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, p, a

    got = url_rules.judge_urls(pages, url_rules.RULES, literal_rules=literal).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter([(i % 12, *want(u)) for i, u in enumerate(urls)] + [(None, *want(urls[0]))])
    assert url_rules.judge_urls(pages.limit(0), url_rules.RULES).count() == 0


def test_url_rules_of_whole_hosts(spark):
    pages = spark.createDataFrame(list(enumerate(["x://organic.net/a", "x://a.org", "x://org/b", "x://b.org?q", "x://organic"])), "page_id long, url string")
    got = {r.page_id: r.rule for r in url_rules.judge_urls(pages, [("block", "org")]).collect()}
    assert got == {0: None, 1: "org", 2: "org", 3: "org", 4: None}


# 5 token counts


def test_token_counts(odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = fst_tokens.count_tokens(odd_docs, path).collect()
    want = Counter((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in odd_rows())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert fst_tokens.count_tokens(no_docs, path).count() == 0


def test_token_counts_of_random_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(7)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 200))) for pool in ("theinganrs ", "abc'stremlvd '", "ab1 ,.!?'é\u0301\u00a0ß", [chr(c) for c in range(32, 0x3000, 7)], "aaab") for _ in range(60)]
    texts += ["ab" * 2000, "the" * 500 + "\u2028" + "z" * 300]
    library, ours = Tokenizer.from_file(path), fst_tokens.Counter(path)
    assert ours.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    ours.machine.reset()
    assert ours.counts(texts[:50]).tolist() == [len(e.ids) for e in library.encode_batch(texts[:50], add_special_tokens=False)]


def test_token_maps_compose():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    library, ours = Tokenizer.from_file(path), fst_tokens.Counter(path)
    for text in ("ab" * 50_000, "a" * 100_001, "".join(rng.choice("theinganrs") for _ in range(100_000)), "é" * 30_000, "!?" * 20_000):
        assert ours.counts([text])[0] == len(library.encode(text, add_special_tokens=False).ids)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        at = np.arange(0, len(raw), fst_tokens.CHUNK)
        size = np.minimum(fst_tokens.CHUNK, len(raw) - at)
        leave, made, follow = ours.machine._maps(raw, at, size, at + size == len(raw))
        tail, total = fst_tokens.composed(follow, made, len(at))
        state, count = np.zeros(1, dtype=np.int32), 0  # chunk after chunk
        for a, n in zip(at, size, strict=True):
            state, more = ours.machine._run(raw, np.array([a]), np.array([n]), state)
            count += int(more[0])
        assert leave[tail[0]] == state[0] and total[0] == count
    gen = np.random.default_rng(1)
    f, g, h = ((gen.integers(0, 50, 50), gen.integers(0, 9, 50)) for _ in range(3))
    left, right = fst_tokens.compose(fst_tokens.compose(f, g), h), fst_tokens.compose(f, fst_tokens.compose(g, h))
    assert all(np.array_equal(a, b) for a, b in zip(left, right, strict=True))


# 6 preferences


def test_preferences(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "a"), (1, "chosen", 2, "user", "more"), (1, "chosen", 3, "assistant", "good"),
        (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "a"), (1, "rejected", 2, "user", "more"), (1, "rejected", 3, "assistant", "bad"),
        (2, "chosen", 0, None, None), (2, "rejected", 0, "user", ""), (3, "chosen", 5, "user", "alone"),
        (4, "chosen", 0, "user", "x"), (4, "rejected", 0, "system", "x"), (None, "chosen", 0, "user", "x"), (5, None, 0, "user", "x"),
        (6, "chosen", 0, "user", "q"), (6, "rejected", 0, "user", "q"), (6, "rejected", 1, "assistant", "extra"),
    ]
    df = spark.createDataFrame([(*t, 9) for t in turns], "pair_id long, side string, pos int, role string, text string, n int")
    got = {r.pair_id: r for r in preference_format.format_preferences(df).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    one = got[1]
    assert one.n_common == 3 and one.prompt.count("<|end|>") == 3 and one.chosen == "<|assistant|>\ngood<|end|>\n"
    assert [one.chosen[s.lo : s.hi] for s in one.chosen_mask] == ["good<|end|>\n"] and [one.rejected[s.lo : s.hi] for s in one.rejected_mask] == ["bad<|end|>\n"]
    assert got[2].n_common == 1 and got[2].chosen == got[2].rejected == "" and got[2].chosen_mask == []
    assert got[3].prompt == "" and got[3].rejected is None and got[3].chosen
    assert got[4].n_common == 0 and got[4].prompt == ""
    assert got[6].n_common == 1 and got[6].chosen == "" and got[6].rejected_mask
    assert preference_format.format_preferences(df.limit(0)).count() == 0


def test_branches_part_where_their_texts_do(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None]), rng.choice(["a", "b", None, "ccc", "dd"])) for c in range(120) for t in range(rng.randint(1, 9))]
    rows += [(7, 0, "assistant", "again"), (None, 1, "user", "x"), (500, None, "assistant", "x"), (500, None, "assistant", "y")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, side int").repartition(4)
    sides = {}
    for r in preference_format.branched_pairs(turns).collect():
        sides.setdefault(r.pair_id, {"chosen": [], "rejected": []})[r.side].append((r.pos, r.role or "user", r.text or ""))
    got = {r.pair_id: r for r in preference_format.format_preferences(preference_format.branched_pairs(turns)).collect()}
    assert set(got) == {r[0] for r in rows} - {None}
    shown = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)
    lengths = set()
    for c, r in got.items():
        a, b = ([t[1:] for t in sorted(sides[c][s])] for s in ("chosen", "rejected"))
        n = 0
        while b and n < len(a) and a[n] == b[n]:
            n += 1
        lengths.add((n, len(a)))
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == (n, shown(a[:n]), shown(a[n:]), shown(b[n:]) if b else None)
        assert (r.rejected is None) == (sum(x[0] == c and x[2] == "assistant" for x in rows) < 2)
        for text, mask, rest in ((r.chosen, r.chosen_mask, a[n:]), (r.rejected, r.rejected_mask, b[n:])):
            assert [text[m.lo : m.hi] for m in mask or []] == [f"{t}<|end|>\n" for role, t in rest if role == "assistant"]
    assert len(lengths) > 20


# 7 mixing


def test_mixing(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        rows = flow_mixing.mix_sources(docs, F.array("source")).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
    got = Counter((r.doc_id, r["size"]) for r in flow_mixing.mix_sources(odd_docs, F.array("source")).collect())
    assert got == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in odd_rows())


def test_mixing_meets_targets_and_repeats(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(0, 60)), f"s{i % 7 if i % 3 else 0}") for i in range(3000)], "doc_id long, text string, source string")
    a, b = (sorted((r.doc_id, r.size, r.members[0], r.targets[0], r.taken) for r in flow_mixing.mix_sources(docs.repartition(n), F.array("source")).collect()) for n in (3, 7))
    assert a == b
    for s in {x[2] for x in a}:
        mine = [x for x in a if x[2] == s]
        assert abs(sum(x[4] for x in mine) - mine[0][3]) <= max(x[1] for x in mine)


def test_targets_and_flow():
    t = flow_mixing.capped_targets([100, 10, 10], [1, 3, 2], Fraction(3, 2), 2)
    assert t == [140, 20, 20]
    assert sum(flow_mixing.capped_targets([50, 30, 20, 0], [3, 1, 2, 3], Fraction(3, 2), 2)) == 150
    assert flow_mixing.capped_targets([], [], Fraction(3, 2), 2) == []
    # pattern (0, 1) can serve both; single copies are used up before any is repeated
    given = flow_mixing.min_cost_flow({(0,): 10, (0, 1): 10, (1,): 4}, [12, 12], 2)
    assert sum(given.values()) == 24 and given == {(0,): 10, (0, 1): 10, (1,): 4}
    given = flow_mixing.min_cost_flow({(0,): 10, (1,): 4}, [15, 8], 2)
    assert given == {(0,): 15, (1,): 8}


def test_flow_is_cheapest_of_all():
    rng = random.Random(1)

    def deals(v, width):
        if width == 1:
            yield (v,)
        else:
            for a in range(v + 1):
                yield from ((a, *rest) for rest in deals(v - a, width - 1))

    def best(patterns, supply, left):
        if not patterns:
            return 0, 0
        p, found = patterns[0], []
        for v in range(2 * supply[p] + 1):
            for part in deals(v, len(p)):
                room = list(left)
                for s, a in zip(p, part, strict=True):
                    room[s] -= a
                if min(room) >= 0:
                    words, cost = best(patterns[1:], supply, room)
                    found.append((words - v, cost + max(0, v - supply[p])))
        return min(found)

    for _ in range(150):
        n = rng.randint(1, 3)
        patterns = [p for k in range(1, n + 1) for p in itertools.combinations(range(n), k)]
        supply = {p: rng.randint(0, 3) for p in rng.sample(patterns, rng.randint(1, min(3, len(patterns))))}
        quota = [rng.randint(0, 6) for _ in range(n)]
        given = flow_mixing.min_cost_flow(supply, quota, 2)
        assert (-sum(given.values()), sum(max(0, v - supply[p]) for p, v in given.items())) == best(sorted(supply), supply, quota)


def test_mixing_of_overlapping_sources(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.randint(1, 40)), sorted({f"s{rng.randrange(4)}" for _ in range(rng.randint(1, 3))})) for i in range(2000)]
    rows = flow_mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, of array<string>"), F.col("of")).collect()
    assert len(rows) == 2000 and all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    quota = {m: t for r in rows for m, t in zip(r.members, r.targets, strict=True)}
    assert abs(sum(quota.values()) - 1.5 * sum(r["size"] for r in rows)) < 1
    # as much as any cut between sources lets through
    cuts = [sum(quota[s] for s in some) + sum(2 * r["size"] for r in rows if set(r.members) - set(some)) for k in range(5) for some in itertools.combinations(sorted(quota), k)]
    assert abs(sum(r.taken for r in rows) - min(cuts)) <= 40 * len({tuple(r.members) for r in rows})


def test_mixing_reruns_agree_on_repeated_ids(spark):
    rng = random.Random(6)
    rows = [(7 if i % 2 else None, prose(rng, rng.randint(0, 60)), "a" if i % 3 else "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(repr, flow_mixing.mix_sources(docs.repartition(n), F.array("source")).collect())) for n in (2, 9))
    assert a == b


def test_mixing_refuses_too_many_overlaps(spark, monkeypatch):
    monkeypatch.setattr(flow_mixing, "PATTERNS", 3)
    docs = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="patterns"):
        flow_mixing.mix_sources(docs, F.array("source", F.lit("x")))
    assert flow_mixing.mix_sources(docs.limit(3), F.array("source", F.lit("x"))).count() == 3


def test_rows_without_ids_are_drawn_like_others(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(5, 30)) for _ in range(6000)]
    docs = spark.createDataFrame([(None if i % 3 == 0 else i // 2 if i % 3 == 1 else i, t, "a" if i % 2 else "b") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    copies = spark.createDataFrame([(None, "same words again", "b")] * 3000, docs.schema)
    rows = flow_mixing.mix_sources(docs.unionByName(copies).repartition(7), F.array("source")).collect()
    assert len(rows) == 9000 and len({r.draw for r in rows}) == 9000
    for s in "ab":
        own = [r for r in rows if r.members == [s]]
        share = lambda some: sum(r.taken for r in some) / sum(r["size"] for r in some)
        whole = share(own)
        assert abs(share([r for r in own if r.doc_id is None]) - whole) < 0.04 * whole
        assert abs(share([r for r in own if r.doc_id is not None]) - whole) < 0.04 * whole
        assert abs(sum(r.taken for r in own) - own[0].targets[0]) <= 30
    same = Counter(r.taken for r in rows if r["size"] == 3)
    assert len(same) == 2  # copies are drawn one by one


def test_sources_without_number(spark):
    """Far more sources than the flow may have patterns; targets as by the exact loop."""
    rng = random.Random(4)
    sizes = [rng.randint(0, 9) for _ in range(3000)]
    docs = spark.createDataFrame([(i, "w " * n, f"{i:05d}") for i, n in enumerate(sizes)] + [(9000, "x y z", None)], "doc_id long, text string, source string")
    old, flow_mixing.PATTERNS = flow_mixing.PATTERNS, 2
    try:
        got = {r.doc_id: (r["size"], r.targets[0]) for r in flow_mixing.mix_sources(docs, F.array("source")).collect()}
    finally:
        flow_mixing.PATTERNS = old
    want = flow_mixing.capped_targets([*sizes, 3], [(3, 1, 2)[i % 3] for i in range(3001)], Fraction(3, 2), 2)
    for i, (n, t) in enumerate(zip([*sizes, 3], want, strict=True)):
        assert got[i if i < 3000 else 9000] == (n, pytest.approx(float(t)))
    free = spark.createDataFrame([(1, "a b", []), (2, "a b", None), (3, "a b", ["s"])], "doc_id long, text string, of array<string>")
    assert {r.doc_id: r.taken for r in flow_mixing.mix_sources(free, F.col("of")).collect()} == {1: 0, 2: 0, 3: 4}


# 8 shards


def test_shards(odd_docs, no_docs, spark):
    assert hilbert_shards.hilbert_shards(no_docs).count() == 0
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.repeat(F.lit("ab "), (F.col("id") % 97).cast("int"))).alias("text"), F.concat(F.lit("l"), F.col("id") % 4).alias("lang"), F.concat(F.lit("s"), F.col("id") % 20).alias("source"))
    for docs in (odd_docs, many):
        rows = hilbert_shards.hilbert_shards(docs).collect()
        assert len(rows) == docs.count()
        counts = Counter(r.shard for r in rows)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
        for s in counts:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)
    assert {(r.doc_id, r["size"], r.text_crc32) for r in hilbert_shards.hilbert_shards(odd_docs).collect()} == {(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows()}


def brute_shards(rows, shards=8, levels=16, cells=4096):
    """Sorted (curve, salt, crc, id) with shard and slot; rows are (id, text, labels...)."""
    table = [(len((t or "").encode()) + 1, *labels) for _, t, *labels in rows]
    place = [0] * len(rows)
    for d in range(len(table[0])):
        upto, found = 0, {}
        for v, n in sorted(Counter(x[d] for x in table).items(), key=lambda x: (x[0] is not None, x[0])):
            upto += n
            found[v] = (2 * upto - n) * levels // (2 * len(rows))
        dense = {v: i for i, v in enumerate(sorted(set(found.values())))}
        place = [p * levels + dense[found[x[d]]] for p, x in zip(place, table, strict=True)]
    curve = [hilbert_shards.hilbert_index((p >> 8, p >> 4 & 15, p & 15), 4) for p in place]
    share = Counter(curve)
    keyed = []
    for (i, t, *_), c in zip(rows, curve, strict=True):
        crc = zlib.crc32((t or "").encode())
        draw = hashlib.md5(":".join(str(x) for x in (i, crc) if x is not None).encode()).hexdigest()
        keyed.append((c, int(draw[:8], 16) % -(-share[c] * cells // len(rows)), crc, -1 if i is None else i))
    out, seen = [], Counter()
    for k, (c, _, crc, i) in enumerate(sorted(keyed)):
        shard = k * shards // len(rows)
        out.append((None if i == -1 else i, crc, c, shard, seen[shard]))
        seen[shard] += 1
    return out


def test_shards_match_brute_force(spark, odd_docs):
    rng = random.Random(4)
    many = [(rng.randrange(400), rng.choice([None, "", "copy " * 40, prose(rng, rng.randint(1, 50))]), rng.choice(["en", "fr", None]), f"https://site{rng.randrange(30)}.org") for _ in range(3000)]
    for docs, rows in ((odd_docs, [(r[0], r[1], r[2], r[3]) for r in odd_rows()]), (spark.createDataFrame(many, "doc_id long, text string, lang string, source string").repartition(7), many)):
        got = hilbert_shards.hilbert_shards(docs).collect()
        assert Counter((r.doc_id, r.text_crc32, r.curve, r.shard, r.slot) for r in got) == Counter(brute_shards(rows))


def test_shards_prune_on_labels_of_one_prefix(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("https://site"), F.col("id") % 8).alias("source"))
    placed = hilbert_shards.hilbert_shards(docs).join(docs, "doc_id").groupBy("shard").agg(F.count_distinct("source").alias("n"))
    assert max(r.n for r in placed.collect()) <= 2
    with pytest.raises(ValueError, match="cells"):
        hilbert_shards.curve_table(6, 4)
    assert hilbert_shards.hilbert_shards(docs, label_dims=("lang", "source") * 3).count() == 4000


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 3), (3, 3)):
        at = {hilbert_shards.hilbert_index(p, bits): p for p in itertools.product(range(1 << bits), repeat=dims)}
        assert sorted(at) == list(range(1 << (dims * bits)))
        assert all(sum(abs(x - y) for x, y in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(at) - 1))


# 9 media


def test_media(odd_docs, no_docs):
    rows = wav_prints.media_columns(odd_docs).collect()
    assert wav_prints.media_columns(no_docs).count() == 0
    texts = Counter((r[0], r[1] or "") for r in odd_rows())
    got = Counter()
    for r in rows:
        back = wav_prints.from_wav(bytes(r.media))
        raw = back[: r.n_bytes]
        assert len(back) == r.payload_bytes and len(back) % 192 == 0 and back[r.n_bytes :].strip(b" ") == b"" and r.payload_bytes > 0
        assert r.payload_sha256 == hashlib.sha256(back).hexdigest() and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert r.tail_crc32 == zlib.crc32(back[-16:]) and r.media_bytes == len(r.media) and len(r.times) == len(r.codes)
        got[r.doc_id, raw.decode()] += 1
    assert got == texts


def test_peak_pairs_find_a_tone():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / 8000)).astype(np.uint8)
    at, codes = wav_prints.peak_pairs(tone.tobytes())
    assert len(codes) and set(codes >> 40) == {32} and (np.diff(at) >= 0).all()


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", "x", prose(rng, 40), prose(rng, 900), "ab" * 3000, "é" * 500]
    rows = wav_prints.media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    turn = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255)
    for r in rows:
        x = np.frombuffer(wav_prints.from_wav(bytes(r.media)), dtype=np.uint8).astype(float) - 128
        frames = 1 + max(0, -(-(len(x) - 256) // 128))
        x = np.concatenate([x, np.zeros(frames * 128 + 256 - len(x))])
        peaks = []
        for f in range(frames):
            power = np.abs(turn @ (x[128 * f : 128 * f + 256] * hann))
            for a, b in ((4, 20), (20, 52), (52, 129)):
                best = a + int(np.argmax(power[a:b]))
                if power[best] > 2 * power.mean():
                    peaks.append((f, best))
        peaks.sort()
        pairs = sorted((t, f << 40 | g << 24 | (u - t) << 16) for k in (1, 2, 3) for (t, f), (u, g) in zip(peaks, peaks[k:], strict=False) if u - t < 256)
        assert list(zip(r.times, r.codes, strict=True)) == pairs
        assert r.feature == wav_prints.feature_of(np.array([t for t, _ in pairs], dtype=np.int64), np.array([c for _, c in pairs], dtype=np.int64))


# 10 toxicity


def test_toxicity_rows(odd_docs, no_docs, labels, no_labels):
    for docs, marks in itertools.product((odd_docs, no_docs), (labels, no_labels)):
        m = noisy_toxicity.train_toxicity(docs, marks, noisy_toxicity.toxic_fold())
        rows = noisy_toxicity.score_toxicity(docs, m).collect()
        assert len(rows) == docs.count() and all(0 <= r.toxic_score <= 1 for r in rows)


def test_toxicity_sees_through_disguise(spark):
    rng = random.Random(4)
    bad = ["stupid", "moron", "trash", "disgusting"]
    texts = []
    for i in range(600):
        w = prose(rng, 60).split()
        if i % 3 == 0:
            for b in rng.sample(bad, 2):
                w.insert(rng.randrange(len(w)), b)
        texts.append((i, " ".join(w), int(i % 3 == 0)))
    docs, marks = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int")
    m = noisy_toxicity.train_toxicity(docs, marks, noisy_toxicity.toxic_fold())
    assert set(m.names) == set(bad)
    hidden = ["5tup1d", "s t u p i d", "m0r0n", "tr@sh", "$tuuupid", "d.i.s.g.u.s.t.i.n.g", "MORON", "trrraaash"]
    clean = [prose(rng, 40), "call 555-1234 or mail a.b@c.org at 10:30", "A B C D E F", "", "x = 3 + 4; y = (2 < 3)"]
    plain = ["stupid", "stupid", "moron", "trash", "stupid", "disgusting", "moron", "trash"]
    around = prose(rng, 20), prose(rng, 20)
    probe = spark.createDataFrame([(i, f"{around[0]} {h} {around[1]}") for i, h in enumerate(hidden + plain)] + [(100 + i, c) for i, c in enumerate(clean)], "doc_id long, text string")
    got = {r.doc_id: r.toxic_score for r in noisy_toxicity.score_toxicity(probe, m).collect()}
    for i in range(len(hidden)):
        assert abs(got[i] - got[len(hidden) + i]) < 0.1, (hidden[i], got)
        assert got[i] > 0.3
    assert all(got[100 + i] < 0.1 for i in range(len(clean))), got


def insulted(rng: random.Random, bad: list[str]) -> list[tuple[int, str, int]]:
    texts = []
    for i in range(600):
        w = prose(rng, 60).split()
        for b in rng.sample(bad, 2) if i % 3 == 0 else []:
            w.insert(rng.randrange(len(w)), b)
        texts.append((i, " ".join(w), int(i % 3 == 0)))
    return texts


@pytest.mark.parametrize("word", ["vwlxk", "vwixk"])
def test_toxicity_language_model_counts_unlabelled_texts(spark, word):
    rng = random.Random(4)
    texts = insulted(rng, ["stupid", "moron", "trash", "disgusting"])
    marks = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int")
    docs = spark.createDataFrame([t[:2] for t in texts] + [(1000 + i, f"{prose(rng, 5)} {word}") for i in range(40)] + [(2000, None)], "doc_id long, text string").repartition(5)
    m = noisy_toxicity.train_toxicity(docs, marks, noisy_toxicity.toxic_fold())
    model = noisy_toxicity.CharModel(m.table)
    assert "".join(model.decode("vw1xk")) == word
    words = Counter(w for r in docs.collect() for w in set(re.findall("[a-z]+", (r.text or "").lower())))
    want = np.zeros(2 * noisy_toxicity.CELLS)
    noisy_toxicity.add_grams(want, list(words), np.rint(noisy_toxicity.PARTS * noisy_toxicity.weigh(np.array(list(words.values())))))
    assert np.array_equal(noisy_toxicity.language_table(docs) * noisy_toxicity.PARTS, want)


def test_toxicity_finds_several_words_in_one_disguise(spark):
    rng = random.Random(4)
    texts = insulted(rng, ["stupid", "idiot", "trash", "disgusting"])
    texts = [(i, f"a {t} you are such and the world of", y) for i, t, y in texts]
    docs, marks = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int")
    m = noisy_toxicity.train_toxicity(docs, marks, noisy_toxicity.toxic_fold())
    pairs = [("a i d i o t", "a idiot"), ("stup1d,1d10t", "stupid idiot"), ("y o u a r e s u c h a s t u p i d i d i o t o f t h e w o r l d", "stupid idiot"), ("d1sgusting-1diot/and-the-tr@sh-of-the-w0rld-and-such", "disgusting idiot trash")]
    around = prose(rng, 20), prose(rng, 20)
    rows = [(2 * i + k, f"{around[0]} {x} {around[1]}") for i, p in enumerate(pairs) for k, x in enumerate(p)]
    got = {r.doc_id: r.toxic_score for r in noisy_toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    for i, p in enumerate(pairs):
        assert abs(got[2 * i] - got[2 * i + 1]) < 0.1 and got[2 * i] > 0.3, (p, got)
    long = " ".join("stupid" * 2000)
    assert noisy_toxicity.CharModel(m.table).decode(long).count("stupid") > 1900


def test_decoding_finds_the_best_path_of_all():
    rng = random.Random(13)
    words = [prose(rng, 1) for _ in range(60)] + ["idiot", "stupid", "a", "on"]
    table = np.zeros(2 * noisy_toxicity.CELLS)
    noisy_toxicity.add_grams(table, words, np.array([1.0 + i % 5 for i in range(len(words))]))
    model = noisy_toxicity.CharModel(table)

    def worth(path):
        score, context = 0.0, "^^^"
        for add, cost in path:
            s, context = model.follow(context, add)
            score += s + cost
        return score + (model.at(context, "$") if context != "^^^" else 0.0)

    for token in ("1d10t", "s t u p", "i-d.10t", "aa  b", "stuup1d", "th3.0n", "о-n a", "++", "$ a", *("".join(rng.choice("ao1 -te!") for _ in range(6)) for _ in range(40))):
        paths = list(itertools.product(*noisy_toxicity.lattice(token)))
        best = max(map(worth, paths))
        top = {tuple("".join(add for add, _ in p).split()) for p in paths if worth(p) > best - 1e-9}
        assert tuple(model.decode(token)) in top, token


def test_toxicity_sees_through_every_disguise(spark):
    rng = random.Random(4)
    texts = [(i, f"a {t} you are such and the world of", y) for i, t, y in insulted(rng, ["pathetic", "moron", "loser", "stupid"])]
    docs, marks = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int")
    m = noisy_toxicity.train_toxicity(docs, marks, noisy_toxicity.toxic_fold())
    assert set(m.names) == {"pathetic", "moron", "loser", "stupid"}
    hidden = ["p a t h e t i c", "y o u a r e p a t h e t i c", "a b c d e f g h i j k l m n o p q r s t u v w x y z p a t h e t i c", "pa.thetic", "path-etic", "pat he tic", "ｐａｔｈｅｔｉｃ", "p\u200ba\u200bthetic", "path\u00adetic", "pаthetic", "é p a t h e t i c", "𝐩𝐚𝐭𝐡𝐞𝐭𝐢𝐜"]
    pairs = ["m o r o n  l o s e r", "m o r o n\nl o s e r", "mor-on/los-er"]
    around = prose(rng, 20), prose(rng, 20)
    clean = ["p a t h", "the mo-ron-da and lo serene", "а это по-русски", "straße é è"]
    probe = [f"{around[0]} {x} {around[1]}" for x in [*hidden, *pairs, *clean, "pathetic", "moron loser", ""]]
    got = [r.toxic_score for r in noisy_toxicity.score_toxicity(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), m).orderBy("doc_id").collect()]
    for i, x in enumerate(hidden + pairs):
        assert got[i] > 0.3 and abs(got[i] - got[-3 if i < len(hidden) else -2]) < 0.1, (x, got[i], got[-3:])
    for i, x in enumerate(clean):
        assert abs(got[len(hidden) + len(pairs) + i] - got[-1]) < 0.05, x


def test_toxicity_learns_distinct_texts(spark):
    rng = random.Random(4)
    texts = [(i, t, y) for i, t, y in insulted(rng, ["stupid", "moron", "trash", "disgusting"])]
    copies = [(1000 + i, "gargle " + texts[3][1], 1) for i in range(200)] + [(texts[0][0], "another text", None)]
    for seed in (1, 2):
        rows = [*texts, *copies]
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([t[:2] for t in rows], "doc_id long, text string").repartition(seed + 2)
        marks = spark.createDataFrame([(t[0], t[2]) for t in rows if t[2] is not None], "doc_id long, toxic int")
        m = noisy_toxicity.train_toxicity(docs, marks, noisy_toxicity.toxic_fold())
        assert set(m.names) == {"stupid", "moron", "trash", "disgusting"}


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    unset = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        store.shared_dir(unset)


def test_settled_tables_keep_rows(spark):
    df = spark.range(10).select("id", F.lit(None).cast("string").alias("x"))
    assert store.settle(df, "t").orderBy("id").collect() == df.orderBy("id").collect()


def test_settled_tables_of_a_scope_are_removed(spark):
    import os

    with store.cleared(spark):
        t = store.settle(spark.range(5), "t")
        assert t.count() == 5
        path = t.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))
