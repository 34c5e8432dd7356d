"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of whole documents inside a task. Its words are mapped to the words of the test phrases; words that no
phrase has end a run, runs shorter than the shortest window can hold no occurrence, and the remaining runs, set apart by a
separator, are the shard's indexed text. From its suffix array come the Burrows-Wheeler transform, held as a wavelet
matrix, and the positions of every ``SAMPLE``-th suffix. All windows are searched backwards together through wavelet ranks;
rows of the surviving ranges are walked back to a sampled suffix to locate them; located word ranges are merged into the
spans to remove.

A window is ``width`` consecutive words of an item, or the whole item where it has fewer; an item without words has none.
Words are runs of digits, lower-cased Latin letters and non-ASCII characters. Null and empty texts have no words. Null
item ids read as the empty string. Repeated rows get equal results; items that share a window all count, rows of one item
id are one item. An empty
benchmark or corpus gives rows without hits or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settle
from .words import ALNUM, LOWER, carried_text, carrying, hashes, passes, spans, word_rows

SHARD_BYTES, SAMPLE = 8 << 20, 8
#: A benchmark of more text is searched in blocks of about this size, each with a pass over the corpus. A block has at most
#: BLOCK_BYTES / 2 words and windows, so about 20 bytes of broadcast for each byte pair, and longer items are cut into pieces.
BLOCK_BYTES = 4 << 20
#: Windows that walk through an index together.
TOGETHER = 1 << 18
SEPARATOR = 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    step = text[order]
    rank = np.empty(n, dtype=np.int64)
    head = np.concatenate([[True], step[1:] != step[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    k = 1
    while True:
        first = np.flatnonzero(head)
        size = np.diff(first, append=n)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not tied.size:
            return order
        at = order[tied]
        ahead = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        key = rank[at]
        by = np.lexsort((ahead, key))
        order[tied], key, ahead = at[by], key[by], ahead[by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ahead[1:] != ahead[:-1])])
        head[tied] = new
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        k *= 2


class FMIndex:
    """Of an integer text whose last symbol is 0 and nowhere else."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels = max(1, int(text.max()).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = bwt >> level & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        marked = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)]).astype(np.int32)
        self.samples = order[marked]
        self.origin = self._down(np.arange(len(self.before) - 1), np.zeros(len(self.before) - 1, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` lies, among all symbols sorted by their wavelet path, once its prefix is reduced to ``symbol``."""
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ones[at]
            at = np.where(symbol >> (self.levels - 1 - i) & 1, zeros + up, at - up)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before ``at`` in the transform."""
        return self._down(symbol, at) - self.origin[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one position longer."""
        symbol, at = np.zeros_like(row), row
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[at]
            bit = ones[at + 1] - up
            at = np.where(bit, zeros + up, at - up)
            symbol = symbol << 1 | bit
        return self.before[symbol] + at - self.origin[symbol]

    def search(self, symbols: np.ndarray, stop: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row after the last) of those phrases that occur; a phrase is the ``length`` symbols before
        ``stop``."""
        live = np.arange(len(stop))
        lo, hi = np.zeros(len(live), dtype=np.int64), np.full(len(live), self.before[-1])
        for j in range(int(length.max()) if len(length) else 0):
            going = length[live] > j
            c = symbols[np.maximum(stop[live] - 1 - j, 0)]
            known = c < len(self.before) - 1
            go = np.flatnonzero(going & known)
            lo[go] = self.before[c[go]] + self.rank(c[go], lo[go])
            hi[go] = self.before[c[go]] + self.rank(c[go], hi[go])
            keep = (~going) | (known & (lo < hi))
            live, lo, hi = live[keep], lo[keep], hi[keep]
        return live, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, todo, walked = np.zeros(len(row), dtype=np.int64), np.arange(len(row)), 0
        while len(todo):
            there = self.marks[row + 1] > self.marks[row]
            at[todo[there]] = self.samples[self.marks[row[there]]] + walked
            todo, row = todo[~there], row[~there]
            row, walked = self.back(row), walked + 1
        return at


@dataclass
class Phrases:
    """A block of the benchmark: distinct windows, as places in one text of symbols, and the items that have each."""

    items: list[str]
    words: np.ndarray  # sorted hashes; symbol = place + 2
    symbols: np.ndarray
    stop: np.ndarray  # of each window, the place after its last symbol
    length: np.ndarray
    first: np.ndarray  # of each window's items in `owners`, one more at the end
    owners: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, str]], width: int) -> Phrases:
        rows = sorted(rows)
        items, hashed, counts = sorted({a for a, _ in rows}), [], []
        for _, _, buf, offs in passes(pa.array([t for _, t in rows], pa.large_string())):
            low = LOWER[buf]
            starts, ends, before = spans(low, offs, ALNUM)
            hashed.append(hashes(low, starts, ends))
            counts.append(np.diff(before))
        h = np.concatenate([*hashed, np.zeros(0, dtype=np.uint64)])
        count = np.concatenate([*counts, np.zeros(0, dtype=np.int64)])
        words, symbols = np.unique(h, return_inverse=True)
        symbols = symbols.astype(np.int32) + 2
        windows = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
        row = np.repeat(np.arange(len(rows)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = (np.cumsum(count) - count)[row] + nth
        length = np.minimum(count, width)[row]
        # right-aligned symbols tell windows apart
        shown = np.zeros((len(row), width), dtype=np.int32)
        for j in range(width):
            on = length > j
            shown[on, width - 1 - j] = symbols[(start + length)[on] - 1 - j]
        _, some, which = np.unique(shown, axis=0, return_index=True, return_inverse=True)
        number = {a: i for i, a in enumerate(items)}
        owner = np.array([number[a] for a, _ in rows], dtype=np.int64)[row] if len(row) else row
        pairs = np.unique(which.ravel() * np.int64(len(items) or 1) + owner)
        first = np.searchsorted(pairs // (len(items) or 1), np.arange(len(some) + 1))
        return cls(items, words, symbols, (start + length)[some].astype(np.int32), length[some].astype(np.int32), first.astype(np.int64), (pairs % (len(items) or 1)).astype(np.int32))

    def search(self, buf: np.ndarray, offs: np.ndarray):
        """Of one shard: words of each row, the (row, first word, word after the last) spans, and distinct (row, item)."""
        low = LOWER[buf]
        starts, ends, before = spans(low, offs, ALNUM)
        n_words, none = np.diff(before), np.zeros(0, dtype=np.int64)
        empty = n_words, none, none, none, none, none
        if not len(self.length) or not len(starts):
            return empty
        h = hashes(low, starts, ends)
        place = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[place] == h
        rows = word_rows(before)
        new = np.concatenate([[True], (known[1:] != known[:-1]) | (rows[1:] != rows[:-1])])
        run_at = np.flatnonzero(new)
        run_size = np.diff(run_at, append=len(known))
        keep = np.repeat(known[run_at] & (run_size >= self.length.min()), run_size)
        kept = np.flatnonzero(keep)
        if not len(kept):
            return empty
        # a separator stands before each run, the end mark after the last
        gap = np.concatenate([[True], (np.diff(kept) != 1) | new[kept[1:]]])
        slot = np.arange(len(kept)) + np.cumsum(gap)
        text = np.full(slot[-1] + 2, SEPARATOR, dtype=np.int64)
        text[slot], text[-1] = place[kept] + 2, 0
        source = np.zeros(len(text), dtype=np.int64)
        source[slot] = kept
        index = FMIndex(text)
        found, at = [], []
        for lo in range(0, len(self.length), TOGETHER):
            w, a, b = index.search(self.symbols, self.stop[lo : lo + TOGETHER], self.length[lo : lo + TOGETHER])
            times = b - a
            row = np.repeat(a - np.cumsum(times) + times, times) + np.arange(times.sum())
            found.append(np.repeat(lo + w, times))
            at.append(source[index.locate(row)])
        found, at = np.concatenate(found), np.concatenate(at)
        change = np.bincount(at, minlength=len(known) + 1) - np.bincount(at + self.length[found], minlength=len(known) + 1)
        hit = np.cumsum(change)[:-1] > 0
        edge = np.concatenate([[False], hit, [False]])
        firsts = np.flatnonzero(hit & (~edge[:-2] | np.concatenate([[True], rows[1:] != rows[:-1]])))
        lasts = np.flatnonzero(hit & (~edge[2:] | np.concatenate([rows[1:] != rows[:-1], [True]]))) + 1
        span_row = rows[firsts]
        each = np.unique(rows[at] * np.int64(len(self.length)) + found)
        row, window = each // len(self.length), each % len(self.length)
        times = self.first[window + 1] - self.first[window]
        owner = self.owners[np.repeat(self.first[window] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        each = np.unique(np.repeat(row, times) * np.int64(len(self.items)) + owner)
        return n_words, span_row, firsts - before[span_row], lasts - before[span_row], each // len(self.items), each % len(self.items)


HIT = "n_words bigint, spans array<struct<lo:bigint,hi:bigint>>, items array<string>"
_SPAN = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])


def _ragged(row: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _search(docs: DataFrame, phrases: Phrases, text_col: str, keep: list[str] | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)  # at most one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        names = pa.array(p.items, pa.string())
        for batch in batches:
            for lo, hi, buf, offs in passes(carried_text(batch, text_col), SHARD_BYTES):
                words, row, a, b, item_row, item = p.search(buf, offs)
                cols = [pa.array(words, pa.int64()), _ragged(row, hi - lo, pa.StructArray.from_arrays([pa.array(a), pa.array(b)], fields=list(_SPAN))), _ragged(item_row, hi - lo, names.take(pa.array(item)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], names=["row", "n_words", "spans", "items"])

    fed = carrying(docs, keep, text_col)
    return fed.mapInArrow(run, f"row {fed.schema['row'].dataType.simpleString()}, {HIT}")


def _cut(items: DataFrame, width: int, most: int) -> DataFrame:
    """Items of more than ``most`` bytes in pieces of about as many, which overlap so that each window lies in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts, raw = [text], text.encode()
                if len(raw) > most:
                    starts, ends, _ = spans(LOWER[np.frombuffer(raw, dtype=np.uint8)], np.array([0, len(raw)]), ALNUM)
                    last = max(len(starts) - width + 1, 1)  # windows
                    heads = [0]
                    while (to := int(np.searchsorted(starts, starts[heads[-1]] + most)) if len(starts) else last) < last:
                        heads.append(max(to, heads[-1] + 1))
                    parts = [raw[starts[a] : ends[min(b + width - 2, len(ends) - 1)]].decode() for a, b in zip(heads, [*heads[1:], last], strict=True) if len(starts)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["item", "piece", "text"])

    return items.mapInArrow(run, "item string, piece int, text string")


def _merged(found: list[DataFrame]) -> DataFrame:
    """uid, spans and items over all blocks: one row a block at most comes together."""
    some = found[0].filter(F.size("items") > 0)
    for f in found[1:]:
        some = some.unionByName(f.filter(F.size("items") > 0))
    some = some.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def touching(acc, s):
        last = F.element_at(acc, -1)
        wider = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))
        joins = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["hi"] >= s["lo"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    spans_ = F.aggregate(F.array_sort("spans"), F.array().cast("array<struct<lo:bigint,hi:bigint>>"), touching)
    return some.select("uid", spans_.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, or all), n_words, spans of hit words to remove, items whose windows occur (sorted)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    items = _cut(items, width, max(1, block_bytes // 4))
    block = F.pmod(F.xxhash64("item", "piece", "text"), F.lit(blocks))
    phrases = (Phrases.of([(r["item"], r["text"]) for r in items.filter(block == b).collect()], width) for b in range(blocks))  # a block at a time
    if blocks == 1:
        return _search(docs, next(phrases), text_col, keep).withColumn("items", F.array_sort(F.array_distinct("items")))
    whole = carrying(docs, keep, text_col)
    text = F.col("t") if "t" in whole.columns else F.col("row")[text_col]
    base = settle(whole.withColumns({"uid": F.monotonically_increasing_id(), "t": text}), "decontaminate-docs")
    found = []
    for p in phrases:
        hits = _search(base.select("uid", "t"), p, "t", ["uid"]).select("row.uid", "n_words", "spans", "items")
        found.append(settle(hits, "decontaminate-hits"))
    out = base.drop("t").join(found[0].select("uid", "n_words"), "uid").join(_merged(found), "uid", "left")
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    return out.select("row", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def cut_spans(text: str, spans_: list[tuple[int, int]]) -> str:
    """``text`` without the words of the given spans and what stands between them."""
    raw = text.encode()
    low = LOWER[np.frombuffer(raw, dtype=np.uint8)]
    starts, ends, _ = spans(low, np.array([0, len(raw)]), ALNUM)
    out, at = [], 0
    for lo, hi in spans_:
        out.append(raw[at : starts[lo]])
        at = int(ends[hi - 1])
    return b"".join([*out, raw[at:]]).decode()


def op2_fm_index_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = find_contamination(docs, bench, keep=["doc_id"])
    out = out.select("row.doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"]).alias("n_hit"), "items")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
      FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM p),
o AS (SELECT d.n, g.i, k.k, array_to_string(d.w[g.i : g.i + k.k - 1], ' ') AS win
      FROM d, k, unnest(generate_series(1, greatest(len(d.w) - k.k + 1, 0))) AS g(i)),
h AS (SELECT DISTINCT o.n, o.i, o.k, p.item FROM o JOIN p ON o.win = p.win AND o.k = p.k),
c AS (SELECT n, count(DISTINCT i + j) AS n_hit FROM h, unnest(generate_series(0, k - 1)) AS g(j) GROUP BY n),
t AS (SELECT n, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM h GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (n) LEFT JOIN t USING (n)
"""
