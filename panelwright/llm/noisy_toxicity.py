"""Toxicity by noisy-channel deobfuscation.

A disguised word is a path through a lattice of characters: a look-alike digit, symbol or foreign letter may stand for a
letter, a run of one letter may stand for one or two of it, and marks or blanks may be nothing or end a word. Viterbi
decoding under a character 4-gram language model picks the likeliest clean words; the restored words are then scored with
the words of the text. Compatibility forms (full-width, mathematical and circled letters) are folded and invisible
characters dropped beforehand.

Decoded are tokens and stretches that look disguised (look-alikes or several marks among letters, long runs, stretches of
single characters), pieces of words with marks or blanks between them that spell a lexicon word if these are left out, and
words with repeated letters that are a lexicon word but for the repeats: there the decoder decides whether they are one word
or several, and which. Each distinct candidate is decoded once a pass.

Lexicon and score are learned from at most ``max_train`` labelled rows, picked by a hash of the id, each distinct text
once: the lexicon are words far more frequent in toxic texts, and a logistic model of lexicon evidence gives the score.
The language model counts the words of all texts, without labels, in a hashed table of fixed size (lexicon words weighted
up).

Null and empty texts have no evidence and get the score of a text without lexicon words. Rows are scored one by one, so
repeated rows get equal scores; without any label all scores are 0. Other columns take no part. An empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import math
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import settle
from .words import ALNUM, LOWER, NON_SPACE, hashes, mix, passes, spans, text_column, word_rows

#: Letters that a digit, a symbol or a letter of another script may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e"}
LOOKS |= {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "і": "i", "ѕ": "s", "ј": "j", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u"}
#: Bytes of full-width, mathematical and enclosed letters and of characters without width.
FORMS = re.compile(rb"\xef[\xbc\xbd]|\xf0\x9d[\x90-\x9f]|\xe2[\x92\x93]|\xe2\x80[\x8b-\x8f]|\xe2\x81\xa0|\xef\xbb\xbf|\xc2\xad")
NO_WIDTH = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])
#: Log costs: a look-alike, a dropped mark, a shortened run; an unlikely character keeps itself.
LOOK_COST, DROP_COST, RUN_COST = -1.0, -0.3, -0.7
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True
LEET = np.zeros(256, dtype=bool)
LEET[[ord(c) for c in LOOKS if ord(c) < 128]] = True
JOINT = np.zeros(256, dtype=bool)
JOINT[[ord(c) for c in ".-_*~'`,:;^=/\\"]] = True
#: What may be nothing inside a word or stand between two.
JOINTS = ".-_*~'`,:;^=/\\ "
GAP = JOINT.copy()
GAP[[9, 10, 11, 12, 13, 32]] = True
#: Marks that make one word of what stands around them.
BINDING = np.zeros(256, dtype=bool)
BINDING[[ord(c) for c in "-_'`*~^"]] = True
BLANKS = str.maketrans("\t\n\v\f\r", "     ")
#: First bytes of the scripts whose letters may be look-alikes.
FOREIGN = np.zeros(256, dtype=bool)
FOREIGN[[0xCE, 0xCF, 0xD0, 0xD1]] = True
#: Cells of each of the two rows of the language model's table, and parts of its whole-number weights.
CELLS, PARTS = 1 << 21, 1024
GOLD, MASK = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1
#: Distinct words, and their bytes, that a task counts before it sends them on.
WORDS, WORD_BYTES = 1 << 18, 32 << 20


def bag(words) -> np.ndarray:
    """The same 64-bit hashes as of spans, for words given as strings."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, dtype=np.int64)
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return hashes(buf, ends - np.array([len(r) for r in raw], dtype=np.int64), ends)


def _step(h, c):
    """The next hash of a chain of characters, on arrays."""
    return mix((h + GOLD) ^ c)


def _step1(h: int, c: int) -> int:
    """The same on plain numbers."""
    x = (h + int(GOLD) & MASK) ^ c
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def add_grams(table: np.ndarray, words: list[str], weights: np.ndarray) -> None:
    """Add each word's characters after their last 0 to 3, and those contexts, to the two rows of a flat table."""
    codes = np.frombuffer("".join(f"^^^{w}$" for w in words).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    at = np.arange(sizes.sum()) + 3 * (np.repeat(np.arange(len(words)), sizes) + 1)
    n = np.repeat(weights, sizes).astype(table.dtype)
    for k in range(4):
        h = np.full(len(at), k + 1, dtype=np.uint64)
        for j in range(k, 0, -1):
            h = _step(h, codes[at - j])
        for key in (_step(h, codes[at] + np.uint64(1 << 32)), _step(h, np.uint64(1 << 33))):
            np.add.at(table, (key & np.uint64(CELLS - 1)).astype(np.int64), n)
            np.add.at(table, (key >> np.uint64(32) & np.uint64(CELLS - 1)).astype(np.int64) + CELLS, n)


class CharModel:
    """Interpolated character 4-grams over words with their ends marked; counts are the lesser of two hashed cells."""

    def __init__(self, table: np.ndarray):
        self.table = memoryview(np.ascontiguousarray(table, dtype=np.float32))
        self.after = functools.lru_cache(1 << 16)(self._after)
        self.at = functools.lru_cache(1 << 18)(self._at)

    def _count(self, key: int) -> float:
        return min(self.table[key & CELLS - 1], self.table[(key >> 32 & CELLS - 1) + CELLS])

    def _after(self, context: str) -> list[tuple[int, float]]:
        """Hash and count of the context's last 0 to 3 characters, as far as they were seen."""
        out = []
        for k in range(4):
            h = k + 1
            for x in context[len(context) - k :]:
                h = _step1(h, ord(x))
            if total := self._count(_step1(h, 1 << 33)):
                out.append((h, total))
        return out

    def _at(self, context: str, c: str) -> float:
        p = 1e-4
        for h, total in self.after(context):
            trust = total / (total + 3.0)
            p = (1 - trust) * p + trust * min(1.0, self._count(_step1(h, ord(c) + (1 << 32))) / total)
        return math.log(p)

    def decode(self, token: str) -> list[str]:
        """The likeliest clean words behind ``token`` (Viterbi over the last three clean characters). What all paths share
        is set down as decoding goes, so time and memory are linear."""
        beam: dict[str, tuple[float, str]] = {"^^^": (0.0, "")}
        done: list[str] = []
        for i, ways in enumerate(lattice(token)):
            after: dict[str, tuple[float, str]] = {}
            for context, (score, word) in beam.items():
                for add, cost in ways:
                    s, ctx = self.follow(context, add)
                    s += score + cost
                    if s > -math.inf and (ctx not in after or s > after[ctx][0]):
                        after[ctx] = (s, word + add)
            beam = after
            if i % 32 == 31:
                done.append(os.path.commonprefix([w for _, w in beam.values()]))
                beam = {x: (s, w[len(done[-1]) :]) for x, (s, w) in beam.items()}
        last = max((s + (self.at(c, "$") if c != "^^^" else 0.0), w) for c, (s, w) in beam.items())[1]
        return ("".join(done) + last).split()

    def follow(self, context: str, add: str) -> tuple[float, str]:
        """Log probability of going on with ``add``, and the context after it; a word can't end before it begins."""
        if add == " ":
            return (self.at(context, "$") if context != "^^^" else -math.inf), "^^^"
        s = 0.0
        for x in add:
            s += self.at(context, x)
            context = context[1:] + x
        return s, context


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character what it may stand for, a blank being the end of a word, and the log cost of that."""
    out = []
    for m in re.finditer(r"(.)\1*", token.translate(BLANKS), re.DOTALL):
        c, run = m[1], len(m[0])
        ways: list[tuple[str, float]] = []
        for k in range(min(run, 2), 0, -1):
            cost = 0.0 if k == run else RUN_COST
            if c.isalpha():
                ways.append((c * k, cost))
            ways += [(x * k, cost + LOOK_COST) for x in LOOKS.get(c, "")]
        if not c.isalpha():
            # a wide blank among narrow ones is rarely nothing
            ways.append(("", DROP_COST * (run * run if c == " " else 1 if c in JOINTS else 8)))
        if c in JOINTS:
            ways.append((" ", 0.0))
        out.append(ways)
    return out


def folded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, compatibility forms as what they stand for, nothing without width."""
    raw = buf.tobytes()
    if FORMS.search(raw):
        rows = [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        rows = [unicodedata.normalize("NFKC", r.decode("utf-8", "replace").translate(NO_WIDTH)).encode() if FORMS.search(r) else r for r in rows]
        buf, offs = np.frombuffer(b"".join(rows), dtype=np.uint8), np.cumsum([0, *map(len, rows)])
    return LOWER[buf], offs


def known(lexicon: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a sorted array holds."""
    return lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h if len(lexicon) else np.zeros(len(h), dtype=bool)


def pieced(low: np.ndarray, offs: np.ndarray, lexicon: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of two or more runs of letters, anything but letters and digits between two, that spell a word of the
    lexicon (of ``longest`` bytes at most) and are not bound to more letters by a mark."""
    starts, ends, before = spans(low, offs, LETTER)
    rows = word_rows(before)
    none = np.zeros(0, dtype=np.int64)
    if len(starts) < 2 or not len(lexicon):
        return none, none, none
    letters = low[LETTER[low]]
    stop = np.cumsum(ends - starts)
    begin = stop - (ends - starts)
    digits = np.concatenate([[0], np.cumsum((low >= 48) & (low <= 57), dtype=np.int32)])
    near = (digits[starts[1:]] == digits[ends[:-1]]) & (rows[1:] == rows[:-1])
    bound = np.concatenate([[False], near & BINDING[low[ends[:-1]]], [False]])  # to the run before
    first, found = np.flatnonzero(near & ~bound[:-2]), [(none, none, none)]
    k = 0
    while len(first):  # until every stretch is longer than the longest word
        k += 1
        first = first[first + k < len(starts)]
        first = first[near[first + k - 1] & (stop[first + k] - begin[first] <= longest)]
        hit = first[~bound[first + k + 1]]
        hit = hit[known(lexicon, hashes(letters, begin[hit], stop[hit + k]))]
        found.append((rows[hit], starts[hit], ends[hit + k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def outside(some: tuple[np.ndarray, ...], whole: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The spans (row, start, end) that lie in none of the disjoint spans ``whole``, which are decoded anyway."""
    order = np.argsort(whole[1])
    starts, ends = np.append(whole[1][order], np.iinfo(np.int64).max), np.append(whole[2][order], 0)
    at = np.searchsorted(starts, some[1], "right") - 1
    free = (at < 0) | (ends[at] < some[2])
    return tuple(x[free] for x in some)


def single_letters(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that repeat an ASCII letter, and the hash of each with every run of one letter as one letter."""
    again = np.zeros(len(low), dtype=bool)
    if len(low) > 1:
        again[1:] = (low[1:] == low[:-1]) & (low[1:] >= 97) & (low[1:] <= 122)
    again[starts] = False
    tally = np.concatenate([[0], np.cumsum(again, dtype=np.int64)])
    some = np.flatnonzero(tally[ends] > tally[starts])
    once = low[~again]
    return some, hashes(once, starts[some] - tally[starts[some]], ends[some] - tally[ends[some]])


def repeated(low: np.ndarray, offs: np.ndarray, lexicon: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of runs of letters with repeats that aren't in the lexicon but are a word of it but for repeats;
    ``plain`` are the sorted hashes of its words with every run of one letter as one letter."""
    starts, ends, before = spans(low, offs, LETTER)
    some, h = single_letters(low, starts, ends)
    some = some[known(plain, h)]
    some = some[~known(lexicon, hashes(low, starts[some], ends[some]))]
    return word_rows(before)[some], starts[some], ends[some]


def disguised(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of what may hide a word: tokens with look-alikes or marks among letters or with long runs, and
    stretches of single characters."""
    starts, ends, before = spans(low, offs, NON_SPACE)
    rows = word_rows(before)
    size = ends - starts
    plain = LETTER[low]
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
    tally = lambda mask: upto(mask)[ends] - upto(mask)[starts]
    n_letters, n_odd, n_marks = tally(plain), tally(LEET[low]), tally(JOINT[low])
    foreign = tally(FOREIGN[low])
    foreign = (foreign > 0) & (n_letters > 2 * foreign)  # among Latin letters
    run = np.zeros(len(low), dtype=bool)
    if len(low) > 2:
        run[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & plain[2:]
    mixed = (n_letters >= 1) & (n_odd >= 1) & (n_odd <= 2 * n_letters + 1)
    dotted = (n_marks >= 2) & (n_letters + n_odd <= n_marks + 2)
    take = (size >= 3) & (mixed | dotted | foreign | ((tally(run) > 0) & (n_letters >= 3)))
    chars = tally((low & 0xC0) != 0x80)
    single = (chars == 1) & (plain[starts] | LEET[low[starts]]) if len(starts) else take
    edge = np.diff(np.concatenate([[0], (single).astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(a):  # a stretch ends where its row does
        cut = np.unique(np.concatenate([a, before[(before > 0) & (before < len(single))]]))
        cut = cut[single[cut]]
        stop = b[np.searchsorted(b, cut, "right")]
        nxt = np.append(cut[1:], len(single))
        a, b = cut, np.minimum(stop, nxt)
        keep = b - a >= 3
        a, b = a[keep], b[keep]
    return np.concatenate([rows[take], rows[a]]), np.concatenate([starts[take], starts[a]]), np.concatenate([ends[take], ends[b - 1] if len(b) else b])


@dataclass
class Machine:
    names: list[str] = field(default_factory=list)
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # sorted hashes
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    model: CharModel | None = None
    table: np.ndarray = field(default_factory=lambda: np.zeros(2 * CELLS, dtype=np.float32))
    beta: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0.0, 0.0, 0.0]))

    plain: np.ndarray | None = None
    longest: int = 0

    def __getstate__(self):
        return {**self.__dict__, "model": None}

    def restored(self, words: list[str]) -> list[list[str]]:
        if self.model is None:
            self.model = CharModel(self.table)
        return [self.model.decode(w.strip(".,;:?")) for w in words]

    def evidence(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Per row: summed odds of its distinct lexicon words, log of their uses, uses a hundred words."""
        n = len(offs) - 1
        low, offs = folded(buf, offs)
        starts, ends, before = spans(low, offs, ALNUM)
        rows, words = word_rows(before), np.diff(before)
        h = hashes(low, starts, ends)
        if self.plain is None:
            self.plain = np.unique(bag([re.sub(r"([a-z])\1+", r"\1", w) for w in self.names]))
            self.longest = max((len(w.encode()) for w in self.names), default=0)
        whole = disguised(low, offs)
        spelled = pieced(low, offs, self.lexicon, self.longest), repeated(low, offs, self.lexicon, self.plain)
        row, start, end = (np.concatenate(x) for x in zip(whole, *(outside(s, whole) for s in spelled), strict=True))
        if len(row):
            _, some, which = np.unique(hashes(low, start, end), return_index=True, return_inverse=True)
            clean = self.restored([low[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in some])
            size = np.array([len(c) for c in clean], dtype=np.int64)
            first, many = (np.cumsum(size) - size)[which], size[which]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)
            rows, h = np.concatenate([rows, np.repeat(row, many)]), np.concatenate([h, bag([w for c in clean for w in c])[at]])
        if not len(self.lexicon):
            return np.zeros((n, 3))
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        hit = self.lexicon[at] == h
        rows, at = rows[hit], at[hit]
        uses = np.bincount(rows, minlength=n)[:n]
        once = np.unique(rows.astype(np.int64) * len(self.lexicon) + at)
        odds = np.bincount(once // len(self.lexicon), weights=self.odds[once % len(self.lexicon)], minlength=n)[:n]
        return np.stack([odds, np.log1p(uses), np.minimum(100 * uses / np.maximum(words, 1), 20)], axis=1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + evidence @ self.beta[1:], -40, 40)))


def _word_sets(rows: DataFrame) -> DataFrame:
    """(y, word) once for each row and word of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, y = text_column(batch, "t"), batch.column(1)
            for lo, hi, buf, offs in passes(col):
                low, offs = folded(buf, offs)
                starts, ends, before = spans(low, offs, LETTER)
                row = word_rows(before)
                key = np.stack([row.astype(np.uint64), hashes(low, starts, ends)])
                _, some = np.unique(key, axis=1, return_index=True)
                words = pa.array([low[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in some], pa.string())
                yield pa.RecordBatch.from_arrays([y.slice(lo, hi - lo).take(pa.array(row[some])), words], names=["y", "w"])

    return rows.select(F.col("t"), "y").mapInArrow(run, "y int, w string")


def weigh(n):
    """What a word of ``n`` texts counts in the language model."""
    return np.log1p(n)


def _word_counts(docs: DataFrame) -> DataFrame:
    """(w, n): the texts that have each word of letters, each task's words added up before they are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held = 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["w", "n"])

        for batch in batches:
            for _, _, buf, offs in passes(text_column(batch, "t")):
                low, offs = folded(buf, offs)
                starts, ends, before = spans(low, offs, LETTER)
                h = hashes(low, starts, ends)
                _, some = np.unique(mix(h ^ mix(word_rows(before).astype(np.uint64) + GOLD)), return_index=True)
                _, first, n = np.unique(h[some], return_index=True, return_counts=True)
                raw, some = low.tobytes(), some[first]
                for lo, hi, k in zip(starts[some].tolist(), ends[some].tolist(), n.tolist(), strict=True):
                    w = raw[lo:hi]
                    if w not in seen:
                        held += hi - lo
                    seen[w] = seen.get(w, 0) + k
                if len(seen) > WORDS or held > WORD_BYTES:
                    yield flushed()
                    seen, held = {}, 0
        yield flushed()

    return docs.mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def language_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character 4-grams of all words of all texts, as the table of a CharModel in whole parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * CELLS, dtype=np.int64)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            add_grams(table, words, np.rint(PARTS * weigh(batch.column(1).to_numpy())))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["cell", "n"])

    got = _word_counts(docs.select(F.col(text_col).alias("t"))).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * CELLS rows
    table = np.zeros(2 * CELLS)
    table[got["cell"].to_numpy()] = got["n"].to_numpy() / PARTS
    return table


def train_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, max_train: int = 8000, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text") -> Machine:
    """``held_out`` is a condition on the id; labels of its rows are never learned from."""
    draw = F.xxhash64(F.lit("nc"), F.col("id"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), held_out.alias("held")).dropna().filter("not held").select("id", "y").distinct()
    # at most max_train rows, half of them toxic where there are so many
    half = known.filter("y = 1").orderBy(draw).limit(max_train // 2).unionByName(known.filter("y = 0").orderBy(draw).limit(max_train - max_train // 2))
    # of several texts of one id the smallest; copies teach nothing more
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(half), "id")
    rows = settle(rows.groupBy("id", "y").agg(F.min("t").alias("t")).groupBy("y", "t").agg(F.min("id").alias("id")).select("t", "y"), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos:
        return Machine()
    table = _word_sets(rows).groupBy("w").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q")).filter("p + q >= 3").toPandas()  # bounded by the sample
    table = table.sort_values("w")
    p, q = table["p"].to_numpy(float), table["q"].to_numpy(float)
    odds = np.log(((p + 0.5) / (pos + 1)) / ((q + 0.5) / (neg + 1)))
    sure = odds / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
    strong = (odds > 2) & (sure > 3.3) & (p >= max(4, 0.01 * pos)) & (table["w"].str.len().to_numpy() > 2)
    names = table["w"].to_numpy()[strong].tolist()
    h = bag(names)
    order = np.argsort(h)
    grams = language_table(docs, text_col)
    # the lexicon's share of the language model is what it would be among the words of the sample
    key = _step1(1, 1 << 33)
    share = min(grams[key & CELLS - 1], grams[(key >> 32 & CELLS - 1) + CELLS]) / max(1.0, float(weigh(p + q) @ (table["w"].str.len().to_numpy() + 1)))
    add_grams(grams, names, max(1.0, share) * (20.0 + 20 * np.log1p(p[strong])))
    m = Machine([names[i] for i in order], h[order], odds[strong][order], None, grams.astype(np.float32))

    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in passes(text_column(batch, "t")):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), *map(pa.array, shared.value.evidence(buf, offs).T)], names=["y", "a", "b", "c"])

    got = rows.mapInArrow(run, "y int, a double, b double, c double").toPandas().sort_values(["y", "a", "b", "c"])
    y, x = got["y"].to_numpy(float), np.concatenate([np.ones((len(got), 1)), got[["a", "b", "c"]].to_numpy()], axis=1)
    beta = np.zeros(4)
    for _ in range(40):  # Newton steps on the penalised logistic likelihood
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (mu - y) + 0.5 * beta * [0, 1, 1, 1]
        step = np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x + np.diag([1e-3, 0.5, 0.5, 0.5]), grad)
        beta -= np.clip(step, -2, 2)
    m.beta = beta
    return m


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and toxic_score for every input row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size: 2 * CELLS numbers, and a lexicon bounded by the training sample
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in passes(text_column(batch, "t")):
                m = shared.value
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(m.score(m.evidence(buf, offs)))], names=["id", "toxic_score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, toxic_score double").withColumnRenamed("id", id_col)


def toxic_fold() -> Column:
    """The rows that toxicity labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op10_noisy_channel_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_toxicity(docs, train_toxicity(docs, labels, toxic_fold()))
    held, score = F.coalesce(toxic_fold(), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score")
    return out.select("doc_id", held, score, (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
