"""Periodic runs of words, by a sparse diagonal dynamic program that goes over each text once.

The state is the set of active lags with their match lengths: a word equal to the one ``lag`` words before adds one to that
diagonal's length, another word ends the diagonal, and one that ends long enough emits its run at once. A run is a stretch
of smallest period q of max(``least``, 2q) words or more which no neighbouring word extends: a diagonal of q that held for
max(q, least - q) words. Stretches that several lags find are those of a smallest period and of its multiples, so the least
lag of equal stretches is their period.

A lag opens only where it may come to be a run. Every run of lag q in [G, 2G) repeats G words in a row (G = 6, 12, 24, ...;
the first level takes the lags below 12 with half of ``least``), so lags are read off earlier occurrences of the last G
words, which array passes number for all texts of a batch, level by level among what recurred on the level before. Some
kinds of occurrence open nothing, as no run can end there with that lag: those inside a stretch of a smaller lag that has matched
more words than the lag is long (Fine and Wilf), and, where the last G words have a period of at most G / 2, those at which
both stretches go on or share too few words. So a text of one repeated word costs a few steps a word and not a step a pair.

Null texts and texts without words have no runs and an empty collapsed text. Rows are judged one by one: repeated rows give
equal results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import NON_SPACE, hashes, mix, passes, spans, text_column, word_rows

WORDS = r"[^\x20\x09-\x0D]++"
ODD = np.uint64(0xD6E8FEB86659FD93)


def openings(h: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag), sorted, at which diagonals open; ``h`` are hashes of words, ``before`` the first word of each row."""
    n = len(h)
    row = word_rows(before)
    first = before[:-1][row] if n else row
    gram = max(1, least // 2)
    at = np.flatnonzero(np.arange(n) - first >= gram - 1)
    code = mix(row[at].astype(np.uint64))
    for k in range(gram):
        code = mix(code * ODD + h[at - gram + 1 + k])
    lags, words, floor = [], [], 1
    while len(at):
        order = np.argsort(code, kind="stable")
        pos, code = at[order], code[order]
        same = code[1:] == code[:-1]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        pos, code = pos[again], code[again]
        if not len(pos):
            break
        new = np.concatenate([[True], code[1:] != code[:-1]])
        group = np.cumsum(new) - 1
        near = np.zeros(n + 1, dtype=np.int64)  # lag of the nearest occurrence before
        near[pos[1:]] = np.where(new[1:], 0, np.diff(pos))
        ahead = np.zeros(n + 1, dtype=np.int64)
        ahead[pos[:-1]] = near[pos[1:]]
        starts = np.flatnonzero(np.diff(near, prepend=-1))
        held = gram + np.arange(n + 1) - np.repeat(starts, np.diff(np.append(starts, n + 1)))  # words that the nearest lag has matched
        goes_on = np.zeros(n + 1, dtype=bool)
        goes_on[:-1] = (near[1:] == near[:-1]) & (near[:-1] > 0) & (near[:-1] <= gram // 2)
        goes_on |= (ahead > 0) & (ahead <= gram // 2)
        lag = near[pos]
        plain = (lag >= floor) & (lag < 2 * gram)
        words.append(pos[plain])
        lags.append(lag[plain])
        # occurrences farther than what the nearest lag has matched
        width = np.int64(n + 1)
        away = np.maximum(np.where(lag > 0, held[pos], 0), np.maximum(floor, lag + 1))
        for still in (False, True):
            ask = np.flatnonzero((goes_on[pos] == still) & (away < 2 * gram) & (lag > 0))
            there = pos[~goes_on[pos]] if still else pos
            base = group[~goes_on[pos]] * width + there if still else group * width + pos
            lo = np.searchsorted(base, group[ask] * width + np.maximum(pos[ask] - 2 * gram + 1, 0))
            hi = np.searchsorted(base, group[ask] * width + pos[ask] - np.minimum(away[ask], pos[ask] + 1), "right")
            many = np.maximum(hi - lo, 0)
            which = np.repeat(np.arange(len(ask)), many)
            of = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[which]
            i, j = pos[ask][which], there[of]
            # two stretches of one small period that began unlike: the words they share are those of the shorter one
            small = near[i] <= gram // 2
            short = small & (near[i] == near[j]) & (held[i] != held[j])
            fit = ~short | (np.minimum(held[i], held[j]) + near[i] >= i - j)
            early = small & (near[i] != near[j]) & (near[i] == ahead[j])  # at the beginning of its stretch
            fit &= ~early | (gram + near[i] > i - j)
            words.append(i[fit])
            lags.append((i - j)[fit])
        # the next level's grams are two of this one
        recurs = np.zeros(n, dtype=bool)
        recurs[pos] = True
        whole = np.zeros(n, dtype=np.uint64)
        whole[pos] = code
        at = np.sort(pos)
        at = at[at - first[at] >= 2 * gram - 1]
        at = at[recurs[at - gram]]
        code = mix(whole[at - gram] * ODD + whole[at])
        gram, floor = 2 * gram, 2 * gram
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # a diagonal opens once; its length goes on by itself
    key = np.unique(np.concatenate(lags) * (n + 1) + np.concatenate(words))
    key = key[np.concatenate([[True], key[1:] != key[:-1] + 1])] if len(key) else key
    lag, word = key // (n + 1), key % (n + 1)
    order = np.lexsort((lag, word))
    return word[order], lag[order]


def online(words: list[int], opens: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period, of one text; ``opens`` are (word, lag) in order."""
    active: dict[int, int] = {}  # match length of each lag
    out: dict[tuple[int, int], int] = {}

    def end(lag: int, i: int) -> None:
        held = active.pop(lag)
        if held >= lag and held + lag >= least:
            at = (i - held - lag, held + lag)
            out[at] = min(lag, out.get(at, lag))

    def implied(lag: int) -> bool:
        """Whether the stretch is that of a lag of which this is a multiple."""
        return any(a < lag <= held and not lag % a for a, held in active.items())

    k = i = 0
    while active or k < len(opens):
        if not active:
            i = opens[k][0]
        elif i == len(words):
            for lag in list(active):
                end(lag, i)
            continue
        word = words[i]
        for lag in list(active):
            if words[i - lag] == word:
                active[lag] += 1
            else:
                end(lag, i)
        while k < len(opens) and opens[k][0] == i:
            lag = opens[k][1]
            k += 1
            if lag not in active and not implied(lag):
                held = 1
                while i - held >= lag and words[i - held] == words[i - held - lag]:
                    held += 1
                active[lag] = held
        if len(active) > 1 and i % 16 == 0:  # lags that smaller ones imply
            for lag in [x for x in active if implied(x)]:
                del active[lag]
        i += 1
    return sorted((start, length, lag) for (start, length), lag in out.items())


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed) for every input row: the runs (start, length, period) by start and period, and the words
    joined by blanks without those that some run contains after its first period."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in passes(text_column(batch, "t")):
                starts, ends, before = spans(buf, offs, NON_SPACE)
                h = hashes(buf, starts, ends)
                word, lag = openings(h, before, least)
                cut = np.searchsorted(word, before)
                raw, at = buf.tobytes(), offs.tolist()
                found, texts = [], []
                for r in range(hi - lo):
                    own, first = raw[at[r] : at[r + 1]].split(), int(before[r])
                    runs = []
                    if cut[r] < cut[r + 1]:
                        opens = list(zip((word[cut[r] : cut[r + 1]] - first).tolist(), lag[cut[r] : cut[r + 1]].tolist(), strict=True))
                        runs = online(h[first : before[r + 1]].tolist(), opens, least)
                    if runs:
                        drop = np.zeros(len(own) + 1, dtype=np.int64)
                        s, size, p = np.array(runs).T
                        np.add.at(drop, s + p, 1)
                        np.add.at(drop, s + size, -1)
                        own = [own[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    texts.append(b" ".join(own))
                made = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found, run_type), made], names=["id", "runs", "collapsed"])

    fed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return fed.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t): one text in ten with its words from some place on made periodic, as its id's checksum says."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(F.col(text_col), F.lit(WORDS), F.lit(0))).alias("w"))
    sized = words.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    sized = sized.withColumn("p", F.expr("1 + cast((n - a) div (3 + g % 8) as int)"))
    period = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    made = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.expr("slice(w, 1, a)"), period), " "))
    return sized.select("id", F.coalesce(made, "t").alias("t"))


def longest(runs: str) -> Column:
    """The run of greatest length, then smallest start and period; NULL of none."""
    key = F.transform(F.col(runs), lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(key)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = periodic_runs(docs, id_col="id", text_col="t").withColumn("best", longest("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    listed = F.concat_ws("", F.transform(lines, lambda s: F.concat(s, F.lit("\n"))))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


#: Pairs of equal six-word grams, put together to diagonals by gaps and islands.
ORACLE_SQL = r"""
WITH RECURSIVE b(i, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM b WHERE k < 8),
z AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, hex(encode(CAST(doc_id AS VARCHAR))) AS s FROM documents),
h AS (
  SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s), 2), lambda i: CAST('0x' || s[i : i + 1] AS BIGINT))),
    lambda a, y: xor(a // 256, z.t[xor(a, y) % 256 + 1])), 4294967295) AS h FROM d, z),
a AS (SELECT doc_id, w, n, h, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM h),
e AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM a),
g AS MATERIALIZED (SELECT doc_id, i, n, hash(w[i - 5 : i]) AS g FROM e, unnest(generate_series(6, n)) AS y(i)),
m AS (SELECT x.doc_id, x.i, x.i - y.i AS lag FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i < x.i AND 2 * (x.i - y.i) <= x.n),
l AS (SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM m),
f AS (SELECT doc_id, lag, min(i) - 6 - lag AS start, count(*) + 5 + lag AS length FROM l GROUP BY doc_id, lag, island HAVING count(*) + 5 >= lag AND count(*) + 5 + lag >= 12),
r AS MATERIALIZED (SELECT doc_id, start, length, min(lag) AS period FROM f GROUP BY doc_id, start, length),
s AS (SELECT doc_id, count(*) AS n_runs, list({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period)[1] AS best,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
k AS (SELECT e.doc_id, i, e.w[i + 1] AS word FROM e, unnest(range(n)) AS y(i)),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT k.* FROM k ANTI JOIN r ON r.doc_id = k.doc_id AND k.i >= r.start + r.period AND k.i < r.start + r.length) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)
"""
