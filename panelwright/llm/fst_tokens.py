"""Token counts from a word-BPE vocabulary compiled to a deterministic transducer.

A state stands for all that the rest of a word can depend on: the longest suffix that may still grow into a vocabulary
entry and, at each cut inside it from which an entry can go on, the token that ends there and how many fewer tokens the
text up to there has. A transition on a byte carries the change in the number of emitted tokens; the last byte of a word
has a final output instead. That the state is enough rests on a property of BPE: a token sequence is the encoding of its
text exactly when each pair of neighbours is (Berglund and van der Merwe, "Formalizing BPE tokenization", 2023).

The machine is built where texts first need a transition, in each Python worker, and forgotten beyond ``MAX_STATES``.
Words are cut into chunks, and all chunks step through the machine side by side. A chunk's map takes an entry state to its
exit state and emitted count. It is tabulated for the start state and for every state at which the map of the chunk before
may leave, until the tables are closed; then maps are composed pairwise, doubling their reach each time (a parallel prefix
scan), so a word of n chunks takes log2(n) compositions. States forget what lies more than a token back, so few chunks
have more than two entries. Per-document counts are differences of a prefix sum over words.

Null text counts as empty (0 tokens). Special strings inside a text count as one token, as the library does by default.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import hashes, passes, text_column

CHUNK = 48
MAX_STATES = 150_000
END = "</w>"
UNSET = -128
#: The one word pattern that the class rules of ``_word_starts`` spell out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Texts without these are in normal form C already and lower-case letter by letter.
COMPOSABLE = re.compile("[^\0-\u012f\u0131-\u02ff]")


@functools.cache
def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every character, as the library's own regular expressions see it."""
    from tokenizers import Regex, normalizers

    kinds = np.zeros(0x110000, dtype=np.uint8)
    chars = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], dtype="<u4")
    for kind, pattern, mark in ((LETTER, r"\p{L}", "L"), (NUMBER, r"\p{N}", "1"), (SPACE, r"\s", " ")):
        swap = normalizers.Replace(Regex(pattern), mark).normalize_str
        for part in np.split(chars, range(4096, len(chars), 4096)):
            seen = np.frombuffer(swap(part.tobytes().decode("utf-32-le")).encode("utf-32-le"), dtype="<u4")
            kinds[part[seen == ord(mark)]] = kind
    return kinds


class Transducer:
    def __init__(self, vocab: dict[str, int], merges: list):
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        self.vocab = vocab
        self.grows = {w[:k] for t in vocab for w in (t.removesuffix(END),) for k in range(len(w))}
        self.fits = functools.lru_cache(1 << 17)(self._fits)
        self.reset()

    def reset(self) -> None:
        self.column = np.full(256, -1, dtype=np.int16)  # bytes get columns as they turn up
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.next = np.full((4096, 96), -1, dtype=np.int32)
        self.emit = np.zeros((4096, 96), dtype=np.int8)
        self.last = np.full((4096, 96), UNSET, dtype=np.int8)
        self.state(("", ((None, 0),)))

    def encode(self, parts: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2 :]]
        return parts

    def _fits(self, left: str | None, right: str) -> bool:
        body = right.removesuffix(END)
        tail = [*body[:-1], body[-1] + END] if right != body else [*body]
        return self.encode([*(left or ""), *tail]) == ([left, right] if left else [right])

    def state(self, key: tuple) -> int:
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.keys)
            self.keys.append(key)
            if at == len(self.next):
                grow = lambda a, fill: np.concatenate([a, np.full_like(a, fill)])
                self.next, self.emit, self.last = grow(self.next, -1), grow(self.emit, 0), grow(self.last, UNSET)
        return at

    def columns(self, used: np.ndarray) -> None:
        for b in used[self.column[used] < 0]:
            self.column[b] = self.column.max() + 1
        if (short := int(self.column.max()) + 1 - self.next.shape[1]) > 0:
            wide = lambda a, fill: np.concatenate([a, np.full((len(a), max(short, 32)), fill, dtype=a.dtype)], axis=1)
            self.next, self.emit, self.last = wide(self.next, -1), wide(self.emit, 0), wide(self.last, UNSET)

    def _token(self, key: tuple, name: str, end: str) -> tuple[str, int]:
        """The token that ends with this byte, and how many tokens it leaves more than there were."""
        suffix, cuts = key
        text = suffix + name
        for p, cut in enumerate(cuts):
            if cut is not None and (t := text[p:] + end) in self.vocab and self.fits(cut[0], t):
                return t, 1 - cut[1]
        raise ValueError(f"the vocabulary can't spell {text!r}")

    def step(self, s: int, b: int) -> None:
        name, key, col = byte_names()[b], self.keys[s], self.column[b]
        token, more = self._token(key, name, "")
        suffix, cuts = key[0] + name, [c and (c[0], c[1] + more) for c in key[1]] + [(token, 0)]
        # of the cuts, those from which some entry can still go on; the rest of the text is forgotten
        live = [c if c is not None and suffix[p:] in self.grows else None for p, c in enumerate(cuts)]
        first = next(p for p, c in enumerate(live) if c is not None)
        self.emit[s, col] = more
        self.next[s, col] = self.state((suffix[first:], tuple(live[first:])))

    def finish(self, s: int, b: int) -> None:
        self.last[s, self.column[b]] = self._token(self.keys[s], byte_names()[b], END)[1]

    def _run(self, buf: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and emitted count of each chunk; longer chunks come first."""
        state, count = state.copy(), np.zeros(len(at), dtype=np.int64)
        for j in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -j, "left"))
            col, s = self.column[buf[at[:n] + j]], state[:n]
            to = self.next[s, col]
            if (holes := np.flatnonzero(to < 0)).size:
                for pair in np.unique(s[holes].astype(np.int64) << 8 | buf[at[holes] + j]):
                    self.step(int(pair) >> 8, int(pair) & 255)
                to = self.next[s, col]
            count[:n] += self.emit[s, col]
            state[:n] = to
        return state, count

    def _maps(self, buf: np.ndarray, at: np.ndarray, size: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunks' maps as one table of rows (chunk, entry state): exit state, emitted count, and the row of the next
        chunk at that state (itself for the last of a word). The first rows are those of the start state, in order."""

        def run(chunk: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(-size[chunk], kind="stable")
            leave, made = np.empty(len(chunk), dtype=np.int32), np.empty(len(chunk), dtype=np.int64)
            leave[order], made[order] = self._run(buf, at[chunk[order]], size[chunk[order]], entry[order])
            return leave, made

        chunk, entry = np.arange(len(at)), np.zeros(len(at), dtype=np.int32)
        leave, made = run(chunk, entry)
        key = lambda chunk, state: chunk.astype(np.int64) << 32 | state
        known = key(chunk, entry)
        new = np.arange(len(at))
        while True:
            on = new[~last[chunk[new]]]
            want = np.setdiff1d(key(chunk[on] + 1, leave[on]), known)
            if not len(want):
                break
            new = len(chunk) + np.arange(len(want))
            more, state = want >> 32, (want & 0xFFFFFFFF).astype(np.int32)
            parts = run(more, state)
            chunk, leave, made = (np.concatenate(x) for x in ((chunk, more), (leave, parts[0]), (made, parts[1])))
            known = np.concatenate([known, want])
        order = np.argsort(known)
        on = np.flatnonzero(~last[chunk])
        follow = np.arange(len(chunk))
        follow[on] = order[np.searchsorted(known, key(chunk[on] + 1, leave[on]), sorter=order)]
        return leave, made, follow

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word (its bytes from start to end, none empty)."""
        if not len(starts):
            return np.zeros(0, dtype=np.int64)
        if len(self.keys) > MAX_STATES:
            self.reset()
        self.columns(np.unique(buf))
        body = ends - starts - 1  # all bytes but the last
        pieces = np.maximum(1, -(-body // CHUNK))
        head = np.cumsum(pieces) - pieces
        word = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(word)) - head[word]
        at, size = starts[word] + nth * CHUNK, np.minimum(CHUNK, body[word] - nth * CHUNK)
        leave, made, follow = self._maps(buf, at, size, nth == pieces[word] - 1)
        tail, total = composed(follow, made, int(pieces.max()))
        s, b = leave[tail[head]], buf[ends - 1]
        out = self.last[s, self.column[b]]
        if (holes := np.flatnonzero(out == UNSET)).size:
            for pair in np.unique(s[holes].astype(np.int64) << 8 | b[holes]):
                self.finish(int(pair) >> 8, int(pair) & 255)
            out = self.last[s, self.column[b]]
        return total[head] + out


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``then`` after ``first``; maps are (row to go on from, tokens emitted on the way there). Associative."""
    return then[0][first[0]], first[1] + then[1][first[0]]


def composed(follow: np.ndarray, made: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """From every row to the end of its word, of ``most`` chunks or fewer: the last row, and the tokens of all chunks."""
    stays = follow == np.arange(len(follow))
    reach = follow, np.where(stays, 0, made)
    for _ in range((most - 1).bit_length()):
        reach = compose(reach, reach)
    return reach[0], reach[1] + made[reach[0]]


def word_spans(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in characters, of the matches of ``PATTERN``."""
    n = len(cps)
    kind = char_classes()[cps]
    before = np.concatenate([[SPACE], kind[:-1]]).astype(np.uint8)
    begins = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
    mark = np.flatnonzero((cps == 39) & (before != OTHER))
    ahead = np.concatenate([cps, np.zeros(2, dtype=cps.dtype)])
    one, two = ahead[mark + 1], ahead[mark + 2]
    pair = lambda a, b: (one == ord(a)) & (two == ord(b))
    short, long = np.isin(one, [ord(c) for c in "stmd"]), pair("r", "e") | pair("v", "e") | pair("l", "l")
    begins[mark[short | long] + 1] = False
    after = np.concatenate([mark[short] + 2, mark[long] + 3])
    after = after[after < n]
    begins[after[kind[after] != SPACE]] = True
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(begins | (kind == SPACE))
    return starts, np.concatenate([stops, [n]])[np.searchsorted(stops, starts, "right")]


class Counter:
    """Counts tokens of texts as the library does for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        model = spec["model"]
        if split["pattern"]["Regex"] != PATTERN or level["type"] != "ByteLevel" or model["end_of_word_suffix"] != END:
            raise ValueError(f"{path}: not a word BPE of the pattern {PATTERN}")
        self.machine = Transducer(model["vocab"], model["merges"])
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")

    def counts(self, texts: list[str]) -> np.ndarray:
        extra, clean = np.zeros(len(texts), dtype=np.int64), []
        for i, t in enumerate(texts):
            if "<|" in t:
                t, extra[i] = self.special.subn(" ", t)
            clean.append(self.normalise(t) if COMPOSABLE.search(t) else t.lower())
        joined = " ".join(clean)
        cps = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        starts, ends = word_spans(cps)
        place = np.concatenate([[0], np.cumsum(1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000))])
        buf = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
        lo, hi = place[starts], place[ends]
        _, some, which = np.unique(hashes(buf, lo, hi), return_index=True, return_inverse=True)
        each = self.machine.count(buf, lo[some], hi[some])[which]
        rows = np.cumsum([len(t) + 1 for t in clean])
        upto = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, rows, "left")]
        return np.diff(upto, prepend=0) + extra


@functools.cache
def counter(path: str) -> Counter:
    """One machine a Python worker."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit for every input row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = text_column(batch, "t")
            for lo, hi, _, offs in passes(col):
                n = counter(path).counts(col.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def op5_fst_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
