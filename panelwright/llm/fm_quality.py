"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions in time
linear in the features. Features of a text: its distinct lower-cased words, hashed into 2^16 buckets with weights of unit
length; one bin for each structure statistic (shares of character kinds, of symbol-tailed and upper-case words, of
distinct words and word triples, lengths); one bin for each numeric metadata column given.

The model is fitted in the driver on at most ``max_train`` labelled rows (one an id), picked by a hash of the id; scoring
passes over whole texts. A null or empty text has only its (empty) structure bins, null metadata a bin of its own, so each row gets a
score. Rows are scored one by one: repeated rows get equal scores; without any label all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, LOWER, NON_SPACE, carried_text, carrying, free_name, hashes, passes, spans, text_column, word_rows

WORD_BITS, BINS, FACTORS = 16, 10, 8
#: Scores from here on are accepted.
ACCEPT = 0.7

KINDS = np.zeros((6, 256), dtype=bool)
KINDS[0, 65:91] = True  # upper case
KINDS[1, 48:58] = True  # digits
KINDS[2, 10] = True  # line ends
KINDS[3, [33, 63, 44, 46, 58, 59]] = True  # sentence marks
KINDS[4, [*range(35, 39), 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = True  # symbols
KINDS[5, 128:] = True  # outside ASCII
MARKS = KINDS[3] | KINDS[4]
STATS = 6 + 7


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics (rows x STATS) and the words as (row, bucket, weight), sorted by row."""
    n = len(offs) - 1
    size = np.diff(offs)
    stats = np.zeros((n, STATS))
    for k, kind in enumerate(KINDS):
        stats[:, k] = _share(np.diff(np.searchsorted(np.flatnonzero(kind[buf]), offs)), size)
    starts, ends, before = spans(buf, offs, NON_SPACE)
    rows, words = word_rows(before), np.diff(before)
    tally = lambda mask: np.bincount(rows[mask], minlength=n)[:n]
    tail = MARKS[buf[ends - 1]] if len(ends) else np.zeros(0, dtype=bool)
    two = tail & (ends - starts > 1)
    two[two] &= MARKS[buf[ends[two] - 2]]
    high = KINDS[0][buf[starts]] if len(starts) else tail
    wide = high & (ends - starts > 1)
    wide[wide] &= KINDS[0][buf[starts[wide] + 1]]
    stats[:, 6], stats[:, 7] = _share(tally(two), words), _share(tally(wide), words)
    stats[:, 8] = _share(tally(tail & (ends - starts == 1)), words)
    low = LOWER[buf]
    h = hashes(low, starts, ends)
    if len(h) > 2:
        three = h[:-2] * np.uint64(31) + h[1:-1] * np.uint64(17) + h[2:]
        whole = rows[:-2] == rows[2:]
        got = np.unique(np.stack([rows[:-2][whole].astype(np.uint64) << np.uint64(40) | three[whole] >> np.uint64(24)]))
        stats[:, 9] = _share(np.bincount((got >> np.uint64(40)).astype(np.int64), minlength=n)[:n], np.maximum(words - 2, 1))
    stats[:, 10] = np.minimum(_share(ends_total(ends - starts, before), words), 40) / 40
    stats[:, 11] = np.log2(size + 1) / 32
    starts, ends, before = spans(low, offs, ALNUM)
    rows, words = word_rows(before), np.diff(before)
    bucket = hashes(low, starts, ends) >> np.uint64(64 - WORD_BITS)
    keys, times = np.unique(rows.astype(np.uint64) << np.uint64(WORD_BITS) | bucket, return_counts=True)
    row, bucket = (keys >> np.uint64(WORD_BITS)).astype(np.int64), (keys & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    stats[:, 12] = _share(np.bincount(row, minlength=n)[:n], words)
    weight = np.log1p(times)
    length = np.sqrt(np.bincount(row, weights=weight**2, minlength=n))
    return stats, row, bucket, weight / length[row]


def ends_total(lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(lengths)])
    return np.diff(upto[before])


@dataclass
class Machine:
    edges: np.ndarray  # dims x (BINS - 1), of statistics and metadata
    bias: float
    w: np.ndarray
    v: np.ndarray

    def cells(self, dense: np.ndarray) -> np.ndarray:
        """Feature numbers of the bins (rows x dims); a missing value takes the bin after the last."""
        at = np.stack([np.where(np.isnan(x), BINS, np.searchsorted(e, x, "right")) for x, e in zip(dense.T, self.edges, strict=True)], axis=1)
        return (1 << WORD_BITS) + np.arange(dense.shape[1]) * (BINS + 1) + at

    def score(self, dense: np.ndarray, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> np.ndarray:
        n, dims = dense.shape
        cells, x = self.cells(dense), 1 / np.sqrt(dims)
        linear = self.bias + x * self.w[cells].sum(axis=1) + np.bincount(row, weights=weight * self.w[bucket], minlength=n)[:n]
        once, square = x * self.v[cells].sum(axis=1), x * x * (self.v[cells] ** 2).sum(axis=1)
        if len(row):
            xv = weight[:, None].astype(np.float32) * self.v[bucket]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            once[row[first]] += np.add.reduceat(xv, first, axis=0)
            square[row[first]] += np.add.reduceat(xv * xv, first, axis=0)
        z = linear + 0.5 * (once**2 - square).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(dense: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 15, rate: float = 0.15, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss over minibatches."""
    dims = dense.shape[1]
    rng = np.random.default_rng(seed)
    edges = np.stack([np.nanquantile(np.where(np.isnan(x).all(), 0.0, x), np.linspace(0, 1, BINS + 1)[1:-1]) if len(x) else np.zeros(BINS - 1) for x in dense.T]) if len(dense) else np.zeros((dims, BINS - 1))
    total = (1 << WORD_BITS) + dims * (BINS + 1)
    m = Machine(edges, 0.0, np.zeros(total), (rng.standard_normal((total, FACTORS)) * 0.02).astype(np.float32))
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        m.bias = 0.0 if not len(y) else 2.0 if y[0] else -2.0
        return m
    m.bias = float(np.log(y.mean() / (1 - y.mean())))
    cells, x = m.cells(dense), 1 / np.sqrt(dims)
    gw, gv, gb = np.full(total, 1e-2), np.full((total, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 128):
            take = order[lo : lo + 128]
            n = len(take)
            lens = np.array([len(docs[i][0]) for i in take])
            row = np.concatenate([np.repeat(np.arange(n), lens), np.repeat(np.arange(n), dims)])
            idx = np.concatenate([*(docs[i][0] for i in take), cells[take].ravel()])
            val = np.concatenate([*(docs[i][1] for i in take), np.full(n * dims, x)])
            xv = val[:, None] * m.v[idx]
            once = np.stack([np.bincount(row, weights=xv[:, f], minlength=n) for f in range(FACTORS)], axis=1)
            z = m.bias + np.bincount(row, weights=val * m.w[idx], minlength=n) + 0.5 * ((once**2).sum(axis=1) - np.bincount(row, weights=(xv**2).sum(axis=1), minlength=n))
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[take]) / n
            used, back = np.unique(idx, return_inverse=True)
            g = np.bincount(back, weights=err[row] * val) + decay * m.w[used]
            gw[used] += g * g
            m.w[used] -= rate * g / np.sqrt(gw[used])
            slope = (err[row] * val)[:, None] * (once[row] - xv)
            for f in range(FACTORS):
                g = np.bincount(back, weights=slope[:, f]) + decay * m.v[used, f]
                gv[used, f] += g * g
                m.v[used, f] -= (0.3 * rate * g / np.sqrt(gv[used, f])).astype(np.float32)
            gb += err.sum() ** 2
            m.bias -= rate * err.sum() / np.sqrt(gb)
    return m


def _meta(meta_cols: tuple[str, ...]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in meta_cols)).cast("array<double>")


def _dense(stats: np.ndarray, meta: pa.Array, width: int) -> np.ndarray:
    flat = np.array(meta.values.slice(meta.offset * width, len(meta) * width).to_numpy(zero_copy_only=False), dtype=float) if width else np.zeros(0)
    return np.concatenate([stats, np.log1p(np.abs(flat.reshape(len(stats), width)))], axis=1)


def train_quality(docs: DataFrame, labels: DataFrame, held_out: Column, max_train: int = 6000, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", meta_cols: tuple[str, ...] = ()) -> Machine:
    """``held_out`` is a condition on the id; its rows are never learned from. Of several texts of one id the smallest is."""
    width = len(meta_cols)
    draw = F.xxhash64(F.lit("fm"), F.col(id_col))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), draw.alias("k"), held_out.alias("held")).dropna()
    picked = known.filter("not held").select("id", "k", "y").distinct().orderBy("k", "y").limit(max_train)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, meta = text_column(batch, "t"), batch.column(3)
            for lo, hi, buf, offs in passes(col):
                stats, row, bucket, weight = features(buf, offs)
                dense = _dense(stats, meta.slice(lo, hi - lo), width)
                cut = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(list(dense), pa.list_(pa.float64())), pa.ListArray.from_arrays(cut, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(weight, pa.float32()))], names=["k", "y", "d", "i", "x"])

    fed = docs.select(F.col(id_col).alias("id"), F.struct(F.col(text_col).alias("t"), _meta(meta_cols).alias("m")).alias("of"))
    one = fed.join(F.broadcast(picked), "id").groupBy("id", "k", "y").agg(F.min("of").alias("of"))  # max_train rows at most
    rows = one.select("k", "y", "of.t", "of.m")
    got = rows.mapInArrow(prepare, "k long, y int, d array<double>, i array<int>, x array<float>").toArrow().sort_by([("k", "ascending"), ("y", "ascending")])
    dense = np.array(got["d"].to_pylist(), dtype=float).reshape(-1, STATS + width)
    ragged = lambda name: [np.asarray(a.values) for a in got[name].combine_chunks()] if len(got) else []
    return fit(dense, list(zip(ragged("i"), ragged("x"), strict=True)), np.asarray(got["y"], dtype=float))


def score_quality(docs: DataFrame, machine: Machine, text_col: str = "text", meta_cols: tuple[str, ...] = (), keep: list[str] | None = None, score_col: str = "quality_score") -> DataFrame:
    """The columns ``keep`` of ``docs`` (None: all) and ``score_col`` (a column of that name is replaced); one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size: 2^16 words and a few hundred bins
    width = len(meta_cols)
    keep = [c for c in keep or docs.columns if c != score_col]
    meta_col = free_name(docs, "_meta")
    fed = carrying(docs.withColumn(meta_col, _meta(meta_cols)), [*keep, meta_col], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, meta = carried_text(batch, text_col), pc.struct_field(batch.column(0), meta_col)
            for lo, hi, buf, offs in passes(col):
                stats, row, bucket, weight = features(buf, offs)
                score = shared.value.score(_dense(stats, meta.slice(lo, hi - lo), width), row, bucket, weight)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score, pa.float64())], names=["row", "score"])

    out = fed.mapInArrow(run, f"row {fed.schema['row'].dataType.simpleString()}, score double")
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("score").alias(score_col))


def quality_fold() -> Column:
    """The rows that quality labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op1_fm_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = train_quality(docs, labels, quality_fold(), meta_cols=("n_chars",))
    out = score_quality(docs, machine, meta_cols=("n_chars",), keep=["doc_id"], score_col="score")
    held = F.coalesce(quality_fold(), F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
