"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles of ``size`` words. Every shingle is XORed into a sketch: it flips its code in
one of m slices. Sets that differ in d shingles have sketches that differ in at most d slices, so the distance of sketches
is a lower bound of the symmetric difference, and two sets of sizes a and b with Jaccard similarity >= 0.8 differ in at
most (a + b) / 9 shingles.

Per size band (all sizes of a band use one m; sizes near a border enter both bands) a document files D + 1 of its
non-empty slices, D being the most shingles that a partner may lack or add. By the pigeonhole principle, taken over one
common order of slices, any two similar documents file an equal slice. The order puts slices of many rare shingles first,
so passages that many documents share bring few together. Documents with too few filled slices for the argument share one
more key. Equal slices are candidates, and verified on whole sets:

1. each document against the centre of its slice (one pair a document, not all pairs);
2. slices that links leave apart (a passage that many otherwise different documents hold), with more than ``MANY`` blocks
   outside of their largest component, move to the end of the order, and slices are filed anew. The argument holds for any common order, so nothing is lost,
   and only documents that are little else but such slices still file them. This goes on while it halves such rows;
3. what links leave apart inside a slice, by Hamming distance of one-bit-a-shingle parity sketches, in blocks of bounded
   size; members of the slice's largest component aren't compared with each other. Of the documents that stay close to
   another, sets are fetched and compared until what is linked spans them: a block of documents that are all alike gives
   one link a document and not one a pair.

So every link is found but those between documents that are joined already: components are exact. Exact copies are one
class throughout (128-bit fingerprints of the set; 64-bit ids of classes in the search).

Null texts, empty texts and texts without words have no shingles and link with nothing; texts of fewer words than
``size`` have their whole sequence as only shingle. Repeated rows are copies. Links depend on texts alone: rows whose ids are
null or repeated are compared like others (a component's id is the smallest that isn't null, null where all are). An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import settle
from .words import LOWER, NON_SPACE, hashes, mix, passes, spans, text_column, word_rows

#: Size bands start at these set sizes.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(max(BANDS[-1] + 1, BANDS[-1] * 8 // 5))
BANDS = np.array(BANDS, dtype=np.int64)
#: Shingles in this share of a pass of documents are reported, and the commonest of them all rank last among slices.
OFTEN, COMMON = 0.004, 1 << 16
#: Documents of one slice that are compared in one block, and about how many shingles these have at most.
BLOCK, SHINGLES = 4096, 1 << 20
#: Slices with more blocks than these outside of their largest component are filed anew before they are compared; in those
#: with fewer, a document's sketch is copied 2 * MANY times on average at most.
MANY = 4
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle), sorted and distinct."""
    low = LOWER[buf]
    starts, ends, before = spans(low, offs, NON_SPACE)
    h = hashes(low, starts, ends)
    rows, count = word_rows(before), np.diff(before)
    take = np.minimum(count, size)[rows]  # words of a shingle of this row
    at = np.flatnonzero(np.arange(len(h)) + take <= before[1:][rows])
    at = at[(count[rows[at]] >= size) | (at == before[:-1][rows[at]])]
    code, left = np.full(len(at), GOLD, dtype=np.uint64), take[at]
    for k in range(size):
        on = np.flatnonzero(left > k)
        code[on] = mix(code[on] * np.uint64(0xD6E8FEB86659FD93) + h[at[on] + k])
    row = rows[at]
    order = np.argsort(code)
    order = order[np.argsort(row[order].astype(np.uint16) if len(offs) < 1 << 16 else row[order], kind="stable")]
    row, code = row[order], code[order]
    if len(row):
        keep = np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
        row, code = row[keep], code[keep]
    return row, code


def filed_slices(row: np.ndarray, code: np.ndarray, n: int, common: np.ndarray, late: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the slices that each row files, over its one or two bands; keys in the bitmap ``late`` rank last."""
    sizes = np.bincount(row, minlength=n)[:n]
    rare = ~np.isin(code, common)
    home = np.searchsorted(BANDS, np.maximum(sizes, 1), "right") - 1
    out_row, out_key = [], []
    for lower in (0, 1):
        band = home - lower
        top = BANDS[band + 1] - 1
        # as guest of the band below: only where a partner of that band can be large enough
        inside = (sizes > 0) & ((lower == 0) | ((band >= 0) & (4 * sizes <= 5 * top)))
        mate = np.minimum(5 * sizes // 4, 5 * top // 4) if lower == 0 else top
        most = (sizes + mate) // 9
        m = np.maximum(BANDS[np.maximum(band, 0)], 1) * np.where(BANDS[np.maximum(band, 0)] < 128, 4, 1)
        on = inside[row]
        r, c = row[on], code[on]
        part = (mix(c ^ GOLD) % m[r].astype(np.uint64)).astype(np.int64)
        place = r * np.int64(1 << 44) + part if n < 1 << 18 else None
        order = np.argsort(place) if place is not None else np.lexsort((part, r))
        r, c, part, good = r[order], c[order], part[order], rare[on][order]
        if not len(r):
            continue
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (part[1:] != part[:-1])]))
        slice_row = r[first]
        key = np.bitwise_xor.reduceat(mix(c), first) ^ mix(band[slice_row].astype(np.uint64) + GOLD)
        weight = np.add.reduceat(good.astype(np.int64), first)
        behind = np.zeros(len(key), dtype=bool) if late is None else _in_bitmap(late, key)
        order = np.lexsort((key, -weight, behind, slice_row))
        slice_row, key = slice_row[order], key[order]
        filled = np.bincount(slice_row, minlength=n)[:n]
        nth = np.arange(len(slice_row)) - np.repeat(np.cumsum(filled) - filled, filled)
        keep = nth <= most[slice_row]
        wild = np.flatnonzero(inside & (filled <= most))
        out_row += [slice_row[keep], wild]
        out_key += [key[keep], mix(band[wild].astype(np.uint64) ^ np.uint64(0xABCDEF))]
    if not out_row:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(out_row), np.concatenate(out_key)


def fingerprints(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit fingerprints of each row's set."""
    a, b = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        a[row[first]] = mix(np.add.reduceat(mix(code + GOLD), first))
        b[row[first]] = mix(np.bitwise_xor.reduceat(mix(code * np.uint64(0xA24BAED4963EE407)), first))
    return a, b


def parity_bits(codes: np.ndarray) -> bytes:
    """One bit a shingle, flipped; about twice as many bits as shingles, 64 to 16,384."""
    width = min(max(64, 1 << (2 * len(codes) - 1).bit_length()), 1 << 14)
    flips = np.bincount((mix(codes ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of 64-bit words; a wider one folds onto ``width`` bytes, as its shorter one would be."""
    out = np.zeros((len(sketches), width // 8), dtype=np.uint64)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, dtype="<u8").reshape(-1, width // 8), axis=0)
    return out


def _cell(cell: pa.StructArray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a cell that are of block i and of block j, and all sketches at their common width."""
    own, sketches = np.asarray(cell.field("own")), cell.field("sketch").to_pylist()
    return np.flatnonzero(own == i), np.flatnonzero(own == j), folded(sketches, min(map(len, sketches), default=8))


def close(cell: pa.StructArray, i: int, j: int) -> np.ndarray:
    """Rows, of blocks i and j, to which the bounds leave a similar row of the other block in another component."""
    n, comp = (np.asarray(cell.field(f)) for f in ("n", "comp"))
    pivot = np.asarray(cell.field("pivot").to_numpy(zero_copy_only=False))  # compared with all rows already
    left, right, bits = _cell(cell, i, j)
    found = np.zeros(len(n), dtype=bool)
    step = max(1, (1 << 21) // max(1, len(right) * bits.shape[1]))
    for lo in range(0, len(left) if len(right) else 0, step):
        s = left[lo : lo + step]
        both = n[s, None] + n[None, right]
        ok = (comp[s, None] != comp[None, right]) & ~(pivot[s, None] | pivot[None, right]) & (9 * np.abs(n[s, None] - n[None, right]) <= both)
        if ok.any():
            far = np.bitwise_count(bits[s, None, :] ^ bits[None, right]).sum(axis=2, dtype=np.int32)
            ok &= 9 * far <= both
            found[s[ok.any(axis=1)]] = True
            found[right[ok.any(axis=0)]] = True
    return np.flatnonzero(found)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def spanning_links(cell: pa.StructArray, i: int, j: int, percent: int) -> tuple[list[int], list[int]]:
    """Links between rows of blocks i and j that join whatever similar rows join: fewer than there are rows.

    A row tries the components near it, each until one of its rows is similar; rows that links join are one from then on."""
    c, n = (np.asarray(cell.field(f)) for f in ("c", "n"))
    label = np.unique(np.asarray(cell.field("comp")), return_inverse=True)[1]
    left, right, bits = _cell(cell, i, j)
    sets = cell.field("shingles")
    out: tuple[list[int], list[int]] = [], []
    for s in left.tolist():
        right = right[right > s] if i == j else right
        open_ = right[(label[right] != label[s]) & (9 * np.abs(n[right] - n[s]) <= n[right] + n[s])]
        far = np.bitwise_count(bits[open_] ^ bits[s]).sum(axis=1, dtype=np.int64)
        for r in open_[9 * far <= n[open_] + n[s]].tolist():
            if label[r] != label[s] and similar(np.asarray(sets[s].values), np.asarray(sets[r].values), percent):
                out[0].append(int(min(c[s], c[r])))
                out[1].append(int(max(c[s], c[r])))
                label[label == label[r]] = label[s]
    return out


def _sets_of(docs: DataFrame, size: int, schema: str, make) -> DataFrame:
    """mapInArrow over (id, t) with ``make(ids, row, code, n)``, which returns columns."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in passes(text_column(batch, "t")):
                cols = make(batch.column(0).slice(lo, hi - lo), *shingle_sets(buf, offs, size), hi - lo)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted; at most COMMON of them. They only order slices: which links are found doesn't depend on them."""

    def often(ids, row, code, n):
        values, times = np.unique(code, return_counts=True)
        keep = times >= max(4, OFTEN * n)
        return [_signed(values[keep]), pa.array(times[keep])]

    seen = _sets_of(docs, size, "s long, n long", often).groupBy("s").agg(F.sum("n").alias("n"))
    got = seen.orderBy(F.desc("n"), "s").limit(COMMON).select("s").toArrow()["s"].to_numpy()
    return np.sort(got.view(np.uint64))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A hashed bitmap of the keys, about sixteen bits a key and 32 MB at most; a fuller one lets more other keys pass."""
    width = 1 << min(28, max(15, (16 * keys.count()).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(width - 1))
    blocks = keys.groupBy(F.shiftright(at, 15).alias("block")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(width // 8, dtype=np.uint8)
    for r in blocks.toLocalIterator():  # of fixed size
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _in_bitmap(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = (key & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ok = [similar(np.asarray(left[i].values), np.asarray(right[i].values), percent) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sized = sets.select("c", "n")
    pairs = pairs.join(sized.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(sized.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
    pairs = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")
    full = pairs.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _apart(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """The slices that links leave in several components: key, rows, main (their largest component), and the blocks of
    main's rows and of the others. Counted by component first, so a slice meets as its components only."""
    sized = placed.join(sets.select("c", "n"), "c")
    parts = sized.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    first = F.max(F.struct("rows", "comp", "all"))
    slices = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("all").alias("all"), first.alias("main"))

    def blocks(rows, shingles):
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / SHINGLES)).cast("int")

    rest = blocks(F.col("rows") - F.col("main.rows"), F.col("all") - F.col("main.all"))
    slices = slices.filter("parts > 1 and rows > 2")
    return slices.select("key", "rows", F.col("main.comp").alias("main"), rest.alias("rest_blocks"), blocks(F.col("main.rows"), F.col("main.all")).alias("main_blocks"))


def _links_left(placed: DataFrame, sets: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that a slice leaves in several components; ``placed`` is (key, c, centre, comp).

    Blocks 0 to rest_blocks - 1 are of the smaller components and the others of the largest, which need not meet."""
    open_ = placed.join(apart, "key").join(sets.select("c", "n", "sketch"), "c")
    at, rest, all_ = F.xxhash64("c"), F.col("rest_blocks"), F.col("rest_blocks") + F.col("main_blocks")
    open_ = open_.withColumn("own", F.when(F.col("comp") == F.col("main"), rest + F.pmod(at, F.col("main_blocks"))).otherwise(F.pmod(at, rest)).cast("int"))
    others = F.when(F.col("own") < rest, all_).otherwise(rest)
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    open_ = open_.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "pivot": F.col("c") == F.col("centre")})
    cells = open_.groupBy("key", "i", "j").agg(F.collect_list(F.struct("own", "c", "n", "comp", "pivot", "sketch")).alias("m"))  # at most two blocks

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                cell = batch.column(3)[r].values
                at = close(cell, batch.column(1)[r].as_py(), batch.column(2)[r].as_py())
                if len(at):
                    where = [batch.column(f).slice(r, 1).take(pa.array(np.zeros(len(at), dtype=np.int64))) for f in range(3)]
                    kept = cell.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*where, *(kept.field(f) for f in ("own", "c", "comp"))], names=["key", "i", "j", "own", "c", "comp"])

    near = settle(cells.mapInArrow(look, "key long, i int, j int, own int, c long, comp long"), "jaccard-near")
    cells = near.join(sets, "c").groupBy("key", "i", "j").agg(F.collect_list(F.struct("own", "c", "n", "comp", "sketch", "shingles")).alias("m"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                got = spanning_links(batch.column(2)[r].values, batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), percent)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["a", "b"])

    return settle(cells.select("i", "j", "m").mapInArrow(link, "a long, b long").distinct(), "jaccard-more")


def jaccard_components(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every input row: the smallest id that links of similarity >= 0.8 reach."""
    percent = 80  # the bounds above are those of 0.8
    fed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = fed.schema["id"].dataType.simpleString()
    spark = docs.sparkSession

    def prints(ids, row, code, n):
        a, b = fingerprints(row, code, n)
        return [ids, pa.array(np.bincount(row, minlength=n)[:n].astype(np.int64)), _signed(a), _signed(b)]

    marked = settle(_sets_of(fed, size, f"id {kind}, n long, c long, c2 long", prints), "jaccard-classes")
    common = spark.sparkContext.broadcast(_common_shingles(fed, size))

    def filing(late, wanted):
        def file(ids, row, code, n):
            c, _ = fingerprints(row, code, n)
            r, key = filed_slices(row, code, n, common.value, late and late.value)
            if wanted is not None:
                r, key = (x[_in_bitmap(wanted.value, key)] for x in (r, key))
            return [_signed(key), _signed(c[r])]

        return _sets_of(fed, size, "key long, c long", file)

    def met(late) -> DataFrame:
        """(key, c, centre) of the slices that several classes file."""
        shared = filing(late, None).groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
        shared = settle(shared, "jaccard-shared")
        # most slices are one document's alone and need not be dealt out again
        wanted = spark.sparkContext.broadcast(_bitmap(shared))
        members = settle(filing(late, wanted).join(shared, "key").distinct(), "jaccard-members")
        # a slice's centre is its member that shares most slices: in a group of copies, one with few changes of its own
        ranked = members.join(members.groupBy("c").agg(F.count("*").alias("shares")), "c")
        centre = ranked.groupBy("key").agg(F.max_by("c", F.struct("shares", "c")).alias("centre"))
        return settle(members.join(centre, "key"), "jaccard-centred")

    def sets_of(members: DataFrame) -> DataFrame:
        """n, shingles and sketch of the members' classes."""
        # sets are fetched by their own fingerprints, whatever the ids; the bitmap lets a few more classes pass
        sought = spark.sparkContext.broadcast(_bitmap(settle(members.select(F.col("c").alias("key")).distinct(), "jaccard-sought")))
        got = fed.select("t").mapInArrow(lambda batches: whole(batches, sought), "c long, n long, shingles array<long>, sketch binary")
        return settle(got.dropDuplicates(["c"]), "jaccard-sets")

    def whole(batches: Iterator[pa.RecordBatch], sought) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # each class once a task
        for batch in batches:
            for lo, hi, buf, offs in passes(text_column(batch, "t")):
                row, code = shingle_sets(buf, offs, size)
                c, _ = fingerprints(row, code, hi - lo)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                at = []
                for i in np.flatnonzero(_in_bitmap(sought.value, c) & (np.diff(cut) > 0)).tolist():
                    if (x := int(c[i])) not in seen:
                        seen.add(x)
                        at.append(i)
                at = np.array(at, dtype=np.int64)
                on = np.zeros(hi - lo, dtype=bool)
                on[at] = True
                n = np.diff(cut)[at].astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), _signed(code[on[row]]))
                bits = [parity_bits(code[cut[i] : cut[i + 1]]) for i in at]
                yield pa.RecordBatch.from_arrays([_signed(c[at]), pa.array(n), lists, pa.array(bits, pa.binary())], names=["c", "n", "shingles", "sketch"])

    late, links, crowd, behind = None, None, None, None
    while True:
        members = met(late)
        ends = members.filter("c <> centre").select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b"))
        pairs = settle(ends.distinct(), "jaccard-pairs")
        sets = sets_of(members)
        more = settle(_verified(pairs, sets, percent), "jaccard-links")
        links = more if links is None else links.unionByName(more)
        roots = settle(components(links, "a", "b"), "jaccard-roots")
        placed = members.join(roots.withColumnRenamed("node", "c"), "c", "left").select("key", "c", "centre", F.coalesce("root", "c").alias("comp"))
        apart = settle(_apart(placed, sets), "jaccard-apart")
        crowded = apart.filter(F.col("rest_blocks") > MANY)
        before, crowd = crowd, crowded.agg(F.sum("rows")).first()[0] or 0
        if not crowd or (before is not None and 2 * crowd > before):
            break
        behind = crowded.select("key") if behind is None else behind.unionByName(crowded.select("key"))
        late = spark.sparkContext.broadcast(_bitmap(behind.distinct()))

    more = _links_left(placed, sets, apart, percent)
    if not more.isEmpty():
        roots = settle(components(links.unionByName(more), "a", "b"), "jaccard-roots")

    known = settle(marked.join(roots.withColumnRenamed("node", "c"), "c", "left"), "jaccard-known")
    known = known.withColumn("of", F.struct(F.coalesce("root", "c").alias("root"), F.when(F.col("root").isNull(), F.col("c2")).alias("c2")))
    known = known.withColumns({"r1": F.col("of.root"), "r2": F.coalesce("of.c2", F.lit(0)), "linked": F.col("root").isNotNull()})
    full = known.filter("n > 0")
    least = settle(full.groupBy("r1", "r2", "linked").agg(F.min("id").alias("component_id")), "jaccard-least")
    out = full.join(least, ["r1", "r2", "linked"]).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(known.filter("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def op3_parity_sketch_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g
      FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS x(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(v, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(m) AS component_id FROM r GROUP BY v) c USING (doc_id)
"""
