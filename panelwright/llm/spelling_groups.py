"""Spelling variants of a vocabulary: words one edit apart, by dynamic programming down sorted lists.

Two words that differ by one inserted, deleted or replaced code point share, of the shorter one's length a, the first half
or the last half whole. So each word is filed under its halves for a = its length and a = its length - 1, and what a group
has in common is a prefix and a suffix; what is open in between is sorted. Down such a list each word of length a walks
with the band (one cell to each side) of its edit matrix: a list entry goes on from the row at its longest common prefix
with the entry before it, and once all cells of a row exceed one edit, every entry that shares that prefix is skipped.
All words of many lists walk side by side in numpy.

Lists of more than ``most`` words are halved again: what is open has its first or its last half in common. An open part of
one code point isn't halved further; its list is bounded by the square of the alphabet. No pair is lost or capped.

Null texts have no words; a null id misspells nothing; repeated rows count as often as they stand there. Ties between
equally frequent forms go to the smallest in code-point order. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settle
from .words import LOWER, hashes, mask_spans, passes, text_column, word_rows

LATIN = np.zeros(256, dtype=bool)
LATIN[65:91] = LATIN[97:123] = True
LEAD = 0xC3  # first byte of U+00C0 to U+00FF, and of nothing else
#: Distinct words, and their bytes, that a task counts before it sends them on.
WORDS, WORD_BYTES = 1 << 18, 32 << 20
#: Rows of lists that are walked side by side, and cells of rows kept for them.
SIDE, CELLS = 1 << 16, 1 << 25


@functools.lru_cache(4096)
def carry_table(size: int) -> np.ndarray:
    """What ``size`` further bytes do to a CRC-32: a linear map, as one table a byte of the checksum (4 x 256)."""
    zeros = bytes(size)
    none = zlib.crc32(zeros, 0)
    columns = np.array([zlib.crc32(zeros, 1 << i) ^ none for i in range(32)], dtype=np.uint32)
    bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)
    return np.stack([np.bitwise_xor.reduce(np.where(bits, columns[8 * k : 8 * k + 8], 0), axis=1) for k in range(4)]).astype(np.uint32)


def word_counts(docs: DataFrame, least: int = 6, rare: int = 5, misspell: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the maximal runs of Latin letters with ``least`` code points or more and ``rare`` uses or more, A-Z
    lower-cased. With ``misspell`` (a number of which about every such run is hit), a run whose CRC-32 of ``id:run`` it
    divides loses its code point number checksum mod length first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held = 0

        def add(word: bytes, k: int) -> int:
            known = seen.get(word)
            seen[word] = k if known is None else known + k
            return len(word) if known is None else 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for lo, hi, buf, offs in passes(text_column(batch, "t")):
                lead = buf == LEAD
                inside = LATIN[buf] | lead
                inside[1:] |= lead[:-1]
                starts, ends, before = mask_spans(inside, offs)
                wide = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
                points = ends - starts - (wide[ends] - wide[starts])
                keep = points >= least
                row, starts, ends, points = word_rows(before)[keep], starts[keep], ends[keep], points[keep]
                if not len(row):
                    continue
                low = LOWER[buf]
                _, some, word = np.unique(hashes(low, starts, ends), return_index=True, return_inverse=True)
                raw, first, last = low.tobytes(), starts[some].tolist(), ends[some].tolist()
                words = [raw[a:b] for a, b in zip(first, last, strict=True)]
                if misspell:
                    pair, times = np.unique(row.astype(np.int64) * len(words) + word, return_counts=True)
                    at, which = pair // len(words), pair % len(words)
                    ids = batch.column(0).slice(lo, hi - lo)
                    state = np.array([zlib.crc32(f"{i}:".encode()) if i is not None else 0 for i in ids.to_pylist()], dtype=np.uint32)[at]
                    sizes, sort = np.unique(ends[some] - starts[some], return_inverse=True)
                    tables = np.stack([carry_table(int(s)) for s in sizes])
                    own = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
                    crc, sort = own[which], sort[which]
                    for k in range(4):
                        crc = crc ^ tables[sort, k, state >> np.uint32(8 * k) & np.uint32(255)]
                    hit = (crc % misspell == 0) & np.asarray(pc.is_valid(ids))[at]
                    for w, k, h in zip(which[hit].tolist(), times[hit].tolist(), crc[hit].tolist(), strict=True):
                        text = words[w].decode()
                        drop = h % len(text)
                        if len(text) > least:
                            held += add((text[:drop] + text[drop + 1 :]).encode(), k)
                    count = np.bincount(which, weights=np.where(hit, 0, times), minlength=len(words)).astype(np.int64)
                else:
                    count = np.bincount(word, minlength=len(words))
                for w, k in zip(words, count.tolist(), strict=True):
                    if k:
                        held += add(w, k)
                if len(seen) > WORDS or held > WORD_BYTES:
                    yield flushed()
                    seen.clear()
                    held = 0
        yield flushed()

    fed = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    return fed.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rare)


def common_prefixes(codes: np.ndarray, offs: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of each entry with the one before it; -1 where a list begins and after the last."""
    size = np.diff(offs)
    out = np.full(len(size) + 1, -1, dtype=np.int64)
    at = np.flatnonzero(~new)
    out[at] = 0
    depth = 0
    while len(at):
        at = at[(size[at] > depth) & (size[at - 1] > depth)]
        at = at[codes[offs[at] + depth] == codes[offs[at - 1] + depth]]
        depth += 1
        out[at] = depth
    return out


def next_shorter(lcp: np.ndarray) -> np.ndarray:
    """For each entry the next whose common prefix is shorter than its own; the end for the last and for those of -1."""
    end = len(lcp) - 1
    out = np.minimum(np.arange(len(lcp)) + 1, end)
    live = np.flatnonzero(lcp > -1)
    while len(live):
        live = live[lcp[out[live]] >= lcp[live]]
        out[live] = out[out[live]]
    return out


def one_edit(codes: np.ndarray, offs: np.ndarray, new: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asker, entry) of the same list that are one edit apart; ``new`` marks where a sorted list begins, ``asks`` the
    entries that walk it. Entries are as long as the asker or one longer; of equal lengths the later entry is reported."""
    size = np.diff(offs)
    lcp = common_prefixes(codes, offs, new)
    after = next_shorter(lcp)
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    codes = np.concatenate([codes, np.zeros(2, dtype=codes.dtype)])
    found: tuple[list, list] = ([], [])
    asks = asks[(lcp[asks] >= 0) | (lcp[asks + 1] >= 0)]  # not alone
    depth = int(size.max()) + 2 if len(size) else 2
    for lo in range(0, len(asks), step := max(1, CELLS // depth)):
        q = asks[lo : lo + step]
        rows = np.full((len(q), depth, 3), 2, dtype=np.uint8)
        rows[:, 0, 1], rows[:, 0, 2] = 0, np.where(size[q] > 0, 1, 2)
        own = np.arange(len(q))
        b, t = head[q], np.zeros(len(q), dtype=np.int64)
        while len(q):
            mine = size[q]
            whole = t == size[b]
            if whole.any():
                e = np.flatnonzero(whole)
                gap = mine[e] - t[e]
                hit = e[(np.abs(gap) < 2) & (rows[own[e], t[e], np.clip(1 + gap, 0, 2)] == 1)]
                hit = hit[(size[b[hit]] > mine[hit]) | (b[hit] > q[hit])]
                found[0].append(q[hit])
                found[1].append(b[hit])
            r0, r1, r2 = rows[own, t].T
            c, at = codes[np.minimum(offs[b] + t, len(codes) - 1)], offs[q] + t
            n0 = np.minimum(r1 + 1, np.where(t > 0, r0 + (codes[at - 1] != c), 2))
            n0[t > mine] = 2
            n1 = np.minimum(np.minimum(r2 + 1, n0 + 1), r1 + (codes[np.minimum(at, len(codes) - 1)] != c))
            n1[t + 1 > mine] = 2
            n2 = np.minimum(n1 + 1, r2 + (codes[np.minimum(at + 1, len(codes) - 1)] != c))
            n2[t + 2 > mine] = 2
            on = ~whole & ((n0 < 2) | (n1 < 2) | (n2 < 2))
            rows[own[on], t[on] + 1] = np.stack([n0, n1, n2], axis=1)[on]
            t[on] += 1
            # the others leave the entry: a whole one to the next, a dead one past all that share the dead prefix
            off = np.flatnonzero(~on)
            if len(off):
                nxt, stop = b[off] + 1, np.where(whole[off], np.iinfo(np.int64).max, t[off])
                far = np.flatnonzero(lcp[nxt] > stop)
                while len(far):
                    nxt[far] = after[nxt[far]]
                    far = far[lcp[nxt[far]] > stop[far]]
                b[off] = nxt
                t[off] = np.minimum(t[off], lcp[nxt])
                left = t >= 0
                if not left.all():
                    q, own, b, t = q[left], own[left], b[left], t[left]
    if not found[0]:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found[0]), np.concatenate(found[1])


_KEY = ["a", "pre", "suf"]


def _filed(rows: DataFrame) -> DataFrame:
    """Two rows for one: the open part (after ``x``, before the last ``z``) without its first and without its last half."""
    half = F.floor((F.col("a") - F.col("x") - F.col("z")) / 2).cast("int")
    cuts = F.array(F.struct((F.col("x") + half).alias("x"), F.col("z").alias("z")), F.struct(F.col("x").alias("x"), (F.col("a") - F.col("x") - half).alias("z")))
    cut = rows.select("word", "n", "a", F.explode(cuts).alias("cut")).select("word", "n", "a", "cut.x", "cut.z")
    mid = F.expr("substring(word, x + 1, length(word) - x - z)")
    return cut.withColumns({"pre": F.expr("substring(word, 1, x)"), "suf": F.expr("right(word, z)"), "mid": mid})


def near_pairs(words: DataFrame, most: int = 2048) -> DataFrame:
    """(u, v, nu, nv): each pair of distinct words (word, n) one edit apart once, u the shorter or else the smaller."""
    size = F.length("word")
    rows = _filed(words.withColumn("a", F.explode(F.array(size, size - 1))).filter("a > 0").withColumns({"x": F.lit(0), "z": F.lit(0)}))
    parts = []
    while True:  # at most as often as the longest word can be halved
        large = (F.count("*") > most) & (F.col("a") - F.length("pre") - F.length("suf") > 1)
        hot = settle(rows.groupBy(_KEY).agg(large.alias("large")).filter("large").select(_KEY), "spelling-hot")
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(hot, _KEY, "left_anti"))
        rows = settle(_filed(rows.join(hot, _KEY)), "spelling-halved")

    def walked(table: pa.Table) -> pa.RecordBatch:
        a, pre, suf, mid, n = (table[c].combine_chunks() for c in ("a", "pre", "suf", "mid", "n"))
        new = np.ones(len(a), dtype=bool)
        new[1:] = False
        for col in (a, pre, suf):
            code = np.asarray(col.dictionary_encode().indices)
            new[1:] |= code[1:] != code[:-1]
        points = lambda col: np.asarray(pc.utf8_length(col)).astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(points(mid))])
        codes = np.frombuffer("".join(mid.to_pylist()).encode("utf-32-le"), dtype="<u4")
        shorter = np.flatnonzero(np.diff(offs) == np.asarray(a) - points(pre) - points(suf))
        u, v = map(pa.array, one_edit(codes, offs, new, shorter))
        whole = pc.binary_join_element_wise(pre, mid, suf, "")
        return pa.RecordBatch.from_arrays([whole.take(u), whole.take(v), n.take(u), n.take(v)], names=["u", "v", "nu", "nv"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < SIDE:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.slice(len(table) - 1)
            same = functools.reduce(pc.and_, (pc.equal(table[c], last[c][0]) for c in _KEY))
            cut = len(table) - pc.sum(same).as_py()  # the last list may go on
            if cut:
                yield walked(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), len(table) - cut
        if rows:
            yield walked(pa.Table.from_batches(held))

    fed = functools.reduce(DataFrame.unionByName, (p.select(*_KEY, "mid", "n") for p in parts))
    return fed.repartition(*_KEY).sortWithinPartitions(*_KEY, "mid").mapInArrow(run, "u string, v string, nu long, nv long").distinct()


def spelling_groups(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, form, form_n, root, n_near) for a table of distinct words and their uses: ``form`` is the most frequent
    word one edit away if it has ``times`` the uses or more, ``root`` where following forms ends."""
    pairs = settle(near_pairs(words), "spelling-pairs")
    ways = [pairs.select(F.col(u).alias("word"), F.struct((-F.col(f"n{v}")).alias("less"), F.col(v).alias("other")).alias("near")) for u, v in ("uv", "vu")]
    near = ways[0].unionByName(ways[1]).groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    known = words.join(near, "word", "left")
    clear = -F.col("best.less") >= times * F.col("n")
    known = known.select("word", "n", F.when(clear, F.col("best.other")).alias("form"), F.when(clear, -F.col("best.less")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    known = settle(known, "spelling-forms")
    up = known.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # paths double; uses grow by ``times`` a step, so they are short
        onward = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        up = settle(up.join(onward, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        if up.filter("moved").isEmpty():
            break
        up = up.drop("moved")
    return known.join(up.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_groups(spark, sf_dir: str) -> DataFrame:
    words = settle(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), misspell=199), "spelling-words")
    return spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


#: Checksums go byte by byte with the remainders of single bytes; near words share a form with one place replaced or gone.
ORACLE_SQL = r"""
WITH RECURSIVE b(i, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM b WHERE k < 8),
z AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
r AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents)
  WHERE length(w) > 5 GROUP BY doc_id, w),
x AS (SELECT *, hex(encode(concat(CAST(doc_id AS VARCHAR), ':', w))) AS s FROM r),
h AS (
  SELECT w, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s), 2), lambda i: CAST('0x' || s[i : i + 1] AS BIGINT))),
    lambda a, y: xor(a // 256, z.t[xor(a, y) % 256 + 1])), 4294967295) AS h FROM x, z),
g AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM g WHERE length(word) > 5 GROUP BY word HAVING sum(k) > 4),
o AS MATERIALIZED (SELECT word, n, left(word, i - 1) AS l, substr(word, i + 1) AS r FROM v, unnest(generate_series(1, length(word))) AS y(i)),
p AS (
  SELECT DISTINCT a.word, c.word AS other, c.n FROM o a JOIN o c ON a.l = c.l AND a.r = c.r AND a.word <> c.word
  UNION SELECT a.word, c.word, c.n FROM o a JOIN v c ON c.word = a.l || a.r
  UNION SELECT c.word, a.word, a.n FROM o a JOIN v c ON c.word = a.l || a.r),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.best[1].n >= 5 * v.n THEN m.best[1].other END AS form, CASE WHEN m.best[1].n >= 5 * v.n THEN m.best[1].n END AS form_n
  FROM v LEFT JOIN (SELECT word, count(*) AS n_near, list({'n': n, 'other': other} ORDER BY n DESC, other) AS best FROM p GROUP BY word) m USING (word)),
u(word, root, d) AS (SELECT word, word, 0 FROM f UNION ALL SELECT u.word, f.form, d + 1 FROM u JOIN f ON f.word = u.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, d) AS root FROM u GROUP BY word) t USING (word)
"""
