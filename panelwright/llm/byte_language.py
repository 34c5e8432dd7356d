"""Language identification by a byte convolutional network.

A text is cut into windows of LENGTH bytes, the last one filled up with zeros; A-Z are lower-cased. Filters of several
widths run over the bytes of a window (each weight is of one byte value at one place of the filter), the highest response
of each filter in the window is kept, and a softmax layer on these gives each language's probability. A text's prediction
is the language of the greatest mean probability over all its windows, weighted by their letters, and that mean is its
score. Filters and layer are trained in numpy on windows of at most ``max_train`` labelled texts (one an id, picked by a
hash of the id, as many of each language as there are), WINDOWS of them at most from each, spread over the whole text.

Inference adds tables of byte pairs instead of multiplying matrices, so a row's numbers don't depend on the rows beside it:
repeated rows get equal results. Null texts and texts without a letter are ``und`` with score 0, and so is everything where
nothing could be learned; letters are those of Unicode. Null labels teach nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import LOWER, passes, text_column

LENGTH, WIDTHS, FILTERS, WINDOWS = 192, (2, 3, 4), 16, 4
#: Windows that go through the tables at a time.
CHUNK = 64
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True


def windows(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows (n x LENGTH) of the rows, in order, and the first window of each row; one for an empty row."""
    size = np.diff(offs)
    first = np.concatenate([[0], np.cumsum(np.maximum(-(-size // LENGTH), 1))])
    flat = np.zeros(first[-1] * LENGTH, dtype=np.uint8)
    shift = first[:-1] * LENGTH - offs[:-1]
    flat[np.arange(len(low)) + np.repeat(shift, size)] = low
    return flat.reshape(-1, LENGTH), first


def highest(x: np.ndarray) -> np.ndarray:
    """Maximum over the second of three axes, by halves (in place): long contiguous rows instead of short ones."""
    n, flat = x.shape[1], x.reshape(len(x), -1)
    while n > 1:
        half = n // 2
        a, b = flat[:, : half * FILTERS], flat[:, (n - half) * FILTERS : n * FILTERS]
        np.maximum(a, b, out=a)
        n -= half
    return flat[:, :FILTERS]


@dataclass
class ByteNet:
    langs: list[str] = field(default_factory=list)
    filters: list[np.ndarray] = field(default_factory=list)  # width x 256 x FILTERS, for each width
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.float32))
    out_bias: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))

    def __post_init__(self):
        self.pairs: list[list[np.ndarray]] = []

    def __getstate__(self):
        return {**self.__dict__, "pairs": []}

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the responses to byte pairs (65,536 x FILTERS), and to the last byte of an odd width."""
        if not self.pairs:
            both = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
            self.pairs = [[both(f[k], f[k + 1]) if k + 1 < len(f) else f[k] for k in range(0, len(f), 2)] for f in self.filters]
        return self.pairs

    def pooled(self, win: np.ndarray) -> np.ndarray:
        """The highest response of each filter in each window."""
        one = win.astype(np.intp)
        two = one[:, :-1] << 8 | one[:, 1:]
        out = []
        for width, tables in zip(WIDTHS, self.tables(), strict=True):
            n = LENGTH - width + 1
            total = tables[0].take(two[:, :n], axis=0)
            for k in range(2, width, 2):
                total += tables[k // 2].take((two if k + 1 < width else one)[:, k : k + n], axis=0)
            out.append(highest(total))
        return np.concatenate(out, axis=1) + np.concatenate(self.bias)

    def probabilities(self, win: np.ndarray) -> np.ndarray:
        """Windows x languages."""
        out = np.zeros((len(win), len(self.langs)))
        for lo in range(0, len(win), CHUNK):
            x = np.maximum(self.pooled(win[lo : lo + CHUNK]), 0)
            z = np.stack([(x * self.out[:, k]).sum(axis=1) for k in range(len(self.langs))], axis=1) + self.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out[lo : lo + CHUNK] = e / e.sum(axis=1, keepdims=True)
        return out

    def predict(self, low: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of lower-cased bytes."""
        n = len(offs) - 1
        raw = low.tobytes()
        plain = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])[offs]
        spoken = np.diff(plain) > 0
        for i in np.flatnonzero(~spoken & (np.diff(offs) > 0)).tolist():
            spoken[i] = any(map(str.isalpha, raw[offs[i] : offs[i + 1]].decode("utf-8", "replace")))
        if not self.langs:
            spoken[:] = False
        live = np.flatnonzero(spoken)
        names, score = ["und"] * n, np.zeros(n)
        if len(live):
            keep = np.repeat(spoken, np.diff(offs))
            win, first = windows(low[keep], np.concatenate([[0], np.cumsum(np.diff(offs)[live])]))
            weight = 1e-3 + LETTER[win].sum(axis=1)
            total = np.add.reduceat(self.probabilities(win) * weight[:, None], first[:-1], axis=0) / np.add.reduceat(weight, first[:-1])[:, None]
            best = total.argmax(axis=1)
            score[live] = np.clip(total[np.arange(len(live)), best], 0, 1)
            for i, k in zip(live.tolist(), best.tolist(), strict=True):
                names[i] = self.langs[k]
        return names, score


def train(win: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.004, seed: int = 3) -> ByteNet:
    """Adam on the cross entropy; through the pooling only the place of the highest response learns."""
    rng = np.random.default_rng(seed)
    net = ByteNet(langs, [(rng.standard_normal((w, 256, FILTERS)) * 0.3 / w**0.5).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS])
    total = FILTERS * len(WIDTHS)
    net.out, net.out_bias = (rng.standard_normal((total, len(langs))) * 0.2).astype(np.float32), np.zeros(len(langs), dtype=np.float32)
    values = [*net.filters, *net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            take = order[lo : lo + batch]
            x, n = win[take].astype(np.intp), len(take)
            peaks, places = [], []
            for w, f, b in zip(WIDTHS, net.filters, net.bias, strict=True):
                size = LENGTH - w + 1
                z = sum(f[k].take(x[:, k : k + size], axis=0) for k in range(w))
                at = z.argmax(axis=1)
                places.append(at)
                peaks.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0] + b)
            pool = np.concatenate(peaks, axis=1)
            act = np.maximum(pool, 0)
            z = act @ net.out + net.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            err = e / e.sum(axis=1, keepdims=True)
            err[np.arange(n), y[take]] -= 1
            err /= n
            back = (err @ net.out.T) * (pool > 0)
            grads = []
            for i, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
                g, grad = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros((w, 256, FILTERS), dtype=np.float32)
                for k in range(w):
                    np.add.at(grad[k], (np.take_along_axis(x, at + k, axis=1), np.arange(FILTERS)[None]), g)
                grads.append(grad)
            grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))] + [act.T @ err, err.sum(axis=0)]
            steps += 1
            for v, (m, s), g in zip(values, moments, grads, strict=True):
                g = g + 1e-5 * v
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-6)
    return net


def train_language(docs: DataFrame, held_out: Column, max_train: int = 4000, id_col: str = "doc_id", label_col: str = "lang", text_col: str = "text") -> ByteNet:
    """``held_out`` is a condition on the id; its rows are never learned from, nor rows without id, text or label. Of
    several texts of one id the smallest is learned from. Languages in code-point order."""
    fed = docs.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("y"), F.col(text_col).alias("t"), held_out.alias("held")).dropna().filter("not held and y <> 'und'")
    counts = fed.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(max_train).collect()
    if not counts:
        return ByteNet()
    # the rows of the smallest draws of each language, at most max_train in all; of many rows only draws below four times
    # the share that is wanted are ranked at all, so what meets by language doesn't grow
    share = max(1, max_train // len(counts))
    draw = F.xxhash64(F.lit("cnn"), F.col("id"), F.col("y"))
    below = docs.sparkSession.createDataFrame([(r["y"], min(2**63 - 1, int(4 * share / r["n"] * 2**63))) for r in counts], "y string, below long")
    ids = fed.select("id", "y", draw.alias("k")).join(F.broadcast(below), "y").filter(F.shiftrightunsigned("k", 1) <= F.col("below"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("k", "id"))
    picked = ids.select("id", "y", "k").distinct().withColumn("rank", rank).filter(F.col("rank") <= share).select("id", "y")
    rows = fed.join(F.broadcast(picked), ["id", "y"]).groupBy("id", "y").agg(F.min("t").alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in passes(text_column(batch, "t")):
                win, first = windows(LOWER[buf], offs)
                full = LETTER[win].sum(axis=1) > 0
                at, row = [], []
                for r in range(hi - lo):
                    own = np.flatnonzero(full[first[r] : first[r + 1]]) + first[r]
                    own = own[np.unique(np.linspace(0, len(own) - 1, min(WINDOWS, len(own))).astype(int))] if len(own) else own
                    at += own.tolist()
                    row += [lo + r] * len(own)
                data = pa.array([win[i].tobytes() for i in at], pa.binary())
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), data], names=["k", "y", "w"])

    got = rows.select(draw.alias("k"), "y", "t").mapInArrow(cut, "k long, y string, w binary").toArrow()  # bounded by the sample
    got = got.sort_by([("k", "ascending"), ("y", "ascending"), ("w", "ascending")])
    langs = sorted(set(got["y"].to_pylist()))
    if not langs:
        return ByteNet()
    win = np.frombuffer(b"".join(got["w"].to_pylist()), dtype=np.uint8).reshape(-1, LENGTH)
    number = {x: i for i, x in enumerate(langs)}
    return train(win, np.array([number[x] for x in got["y"].to_pylist()]), langs)


def predict_language(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every input row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size but for a few numbers a language
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in passes(text_column(batch, "t")):
                names, score = shared.value.predict(LOWER[buf], offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    fed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return fed.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_fold() -> Column:
    """The rows that languages are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op12_byte_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict_language(docs, train_language(docs, language_fold()))
    return out.select("doc_id", F.coalesce(language_fold(), F.lit(False)).alias("held_out"), "lang_pred", "score")
