"""The corpus pipeline, stage by stage and as a whole."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np

import corpus_pipeline as cp
from panelwright.llm import flow_mixing, fm_quality, queries

from .conftest import prose
from .test_operators import alnum, brute_groups, brute_hits, brute_shards, spaced

SF = "/root/testdata/sf0.001"


def brute_quality(machine, rows):
    """Rows that the machine accepts, each pair of features multiplied out."""
    kept = []
    for r in rows:
        raw = np.frombuffer((r.text or "").encode(), dtype=np.uint8)
        stats, _, bucket, weight = fm_quality.features(raw, np.array([0, len(raw)]))
        cells = machine.cells(np.concatenate([stats, [[np.nan if r.n_chars is None else np.log1p(r.n_chars)]]], axis=1))[0]
        idx, x = np.concatenate([bucket, cells]), np.concatenate([weight, np.full(len(cells), 1 / np.sqrt(len(cells)))])
        v = machine.v[idx].astype(float)
        pairs = np.triu(np.outer(x, x) * (v @ v.T), 1).sum()
        if 1 / (1 + np.exp(-(machine.bias + x @ machine.w[idx] + pairs))) >= 0.7:
            kept.append(r)
    return kept


def brute_mixture(rows):
    """How often each row is taken: whole rounds, then a prefix of the seeded order."""
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    mine = {s: [(len(spaced(r.text)), r) for r in rows if r.source == s] for s in names}
    sizes = [sum(n for n, _ in mine[s]) for s in names]
    targets = flow_mixing.capped_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], Fraction(3, 2), 2)
    times = Counter()
    for s, size, target in zip(names, sizes, targets, strict=True):
        rounds, rest = divmod(round(target), size) if size else (0, 0)
        draw = lambda x: hashlib.md5(f"mix:{x[1].doc_id}:{hashlib.md5((x[1].text or '').encode()).hexdigest()}:1".encode()).hexdigest()
        at = 0
        for n, r in sorted(mine[s], key=lambda x: (int(draw(x)[:8], 16) % 4096, draw(x))):
            if n:
                times[r.doc_id] = rounds + (rounds < 2 and at + n / 2 <= rest)
            at += n
    return +times


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        out = cp.settle(stage(spark, docs, SF), name)
        assert out.columns == docs.columns, name
        before, after = docs.collect(), out.collect()
        seen[name] = (before, after)
        docs = out
    before, after = seen["near_duplicates"]
    before = sorted(before, key=lambda r: r.doc_id)
    groups = brute_groups([r.text for r in before])
    assert {r.doc_id for r in after} == {before[g].doc_id for _, g in groups}
    before, after = seen["decontaminate"]
    clean = {r.doc_id for r, (_, hit, _) in zip(before, brute_hits([r.text for r in before], items), strict=True) if not hit}
    assert {r.doc_id for r in after} == clean
    before, after = seen["mixture"]
    assert Counter(r.doc_id for r in after) == brute_mixture(before)
    shards = cp.STAGES[-1][1](spark, docs, SF).collect()
    got = Counter((r.doc_id, r.text_crc32, r.curve, r.shard, r.slot) for r in shards)
    assert got == Counter(brute_shards([(r.doc_id, r.text, r.lang, r.source) for r in after]))


def test_quality_stage_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    machine = fm_quality.train_quality(docs, labels, fm_quality.quality_fold(), meta_cols=("n_chars",))
    before, after = docs.collect(), cp.quality(spark, docs, sf).collect()
    assert {r.doc_id for r in after} == {r.doc_id for r in brute_quality(machine, before)} and len(after) < len(before)


def test_odd_and_empty_rows_pass(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.count()
        assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_rows_of_null_and_repeated_ids_are_judged_by_their_texts(spark):
    rng = random.Random(3)
    texts = [prose(rng, 50) for _ in range(12)]
    rows = [(None, t, "a", 1) for t in texts[:4]] + [(7, t, "a", 1) for t in texts[4:8]] + [(20 + i, t, "b", 1) for i, t in enumerate(texts[8:])]
    rows += [(None, texts[0], "a", 1), (7, texts[8], "b", 1), (None, None, "a", 1), (None, None, "a", 1), (7, texts[5], "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(3)
    got = cp.near_duplicates(spark, docs, SF).collect()
    assert Counter(r.text for r in got) == Counter([*texts, None, None])
    assert {r.text: r.doc_id for r in got}[texts[8]] == 7
    out = cp.mixture(spark, docs.filter("text is not null"), SF)
    assert out.columns == docs.columns
    taken = {(r.doc_id, r.text) for r in out.collect()}
    assert {t for i, t in taken if i is None} and len({t for i, t in taken if i == 7}) > 1
    assert not (taken - {r[:2] for r in rows})


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert alnum("Ab-1é") == ["ab", "1é"]
