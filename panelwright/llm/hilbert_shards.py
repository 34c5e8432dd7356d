"""Sharding along a Hilbert curve (DataFrame functions only).

Several metadata dimensions are quantised into 2^bits levels of about equal row counts: a value's level is where the
middle of its rows lies in the order of all rows, whole values compared (text by code points). The level vector is mapped
to its index on a Hilbert curve, rows are ordered by that index and the order is cut into runs. Neighbours on the curve are
neighbours in every dimension, so each shard's min/max statistics prune on all of them. The law is ``rows``: shard counts
differ by one at most.

The order is (curve index, salt, crc32 of the text, id): rows that share a curve index may be a third of the table, so an
index with many rows is split by a hash of id and checksum into salted cells that each get a window of their own. Rows
that agree in all of these may change places; nothing else depends on how the table is partitioned.

Nulls are the lowest values of their dimension; a null text has size 1 and the checksum of the empty text. Repeated
rows each get a slot. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import settle

#: Most cells of a curve (its table is a constant of the plan), ranges that distinct values are counted in.
CELLS, RANGES = 1 << 15, 32


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Distance along the curve of a point of a 2^bits cube (Skilling's transpose, AIP Conf. Proc. 707, 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def curve_table(dims: int, bits: int) -> Column:
    """The indices of all 2^(dims*bits) cells, row-major, as one constant array; CELLS of them at most."""
    cells = 1 << (dims * bits)
    if cells > CELLS:
        raise ValueError(f"{dims} dimensions of {bits} bits make {cells} cells; at most {CELLS}")
    mask = (1 << bits) - 1
    values = (hilbert_index(tuple(c >> (bits * (dims - 1 - d)) & mask for d in range(dims)), bits) for c in range(cells))
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def level_cuts(rows: DataFrame, numbers: list[str], labels: list[str], levels: int) -> dict[str, list]:
    """For each dimension the least value of each level but the lowest, ascending: fewer than ``levels`` values.

    Distinct values of all dimensions are counted and numbered in Spark, in ranges of values with a window each: however
    many there are, no task sees them all, and where the ranges are cut makes no difference."""
    dims = [*numbers, *labels]
    number = lambda d: F.col(d).cast("long") if d in numbers else F.lit(None).cast("long")
    label = lambda d: F.col(d).cast("string") if d in labels else F.lit(None).cast("string")
    values = F.array(*(F.struct(F.lit(i).alias("dim"), number(d).alias("number"), label(d).alias("label")) for i, d in enumerate(dims)))
    counts = rows.select(F.inline(values)).groupBy("dim", "number", "label").agg(F.count("*").alias("n"))
    ranged = settle(counts.repartitionByRange(RANGES, "dim", "number", "label").withColumn("range", F.spark_partition_id()), "hilbert-values")
    ranges = ranged.groupBy("range").agg(F.sum("n").alias("m"))  # RANGES rows
    upto = F.sum("m").over(Window.orderBy("range"))
    ranges = ranges.select("range", (upto - F.col("m")).alias("before"), (F.sum("m").over(Window.partitionBy()) / len(dims)).cast("long").alias("total"))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy("dim", "number", "label"))
    placed = ranged.join(F.broadcast(ranges), "range").withColumn("upto", F.col("before") + inside - F.col("dim") * F.col("total"))
    placed = placed.withColumn("level", F.expr(f"(2 * upto - n) * {levels} div (2 * total)"))
    firsts = placed.groupBy("dim", "level").agg(F.min(F.struct("number", "label")).alias("first"))
    cuts: dict[str, list] = {d: [] for d in dims}
    for r in firsts.orderBy("dim", "level").collect():  # a row a level
        cuts[dims[r["dim"]]].append(r["first"]["number" if r["dim"] < len(numbers) else "label"])
    return {d: c[1:] for d, c in cuts.items()}


def level_of(dim: str, cuts: list) -> Column:
    return sum((F.coalesce((F.col(dim) >= F.lit(c)).cast("int"), F.lit(0)) for c in cuts), F.lit(0))


def hilbert_shards(docs: DataFrame, n_shards: int = 8, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_dims: tuple[str, ...] = ("lang", "source"), cells: int = 4096) -> DataFrame:
    """One row per input row: id, size, text_crc32, curve index, shard and slot.

    ``bits`` of levels a dimension; None takes four, or fewer where many dimensions need it."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    labels = [F.col(c).cast("string").alias(f"d{i}") for i, c in enumerate(label_dims)]
    size = (F.octet_length(raw) + F.lit(1)).cast("long").alias("size")
    meta = settle(docs.select(F.col(id_col).alias("id"), size, F.crc32(raw).alias("crc"), *labels), "hilbert-meta")

    dims = ["size", *(f"d{i}" for i in range(len(label_dims)))]
    bits = bits or max(1, min(4, int(math.log2(CELLS)) // len(dims)))
    place = F.lit(0)
    for d, cuts in level_cuts(meta, dims[:1], dims[1:], 1 << bits).items():
        place = place * (1 << bits) + level_of(d, cuts)
    at = meta.withColumn("curve", F.element_at(curve_table(len(dims), bits), (place + 1).cast("int")))

    # at most CELLS rows: how many rows share each curve index, and into how many salted cells they are dealt
    runs = at.groupBy("curve").agg(F.count("*").alias("rows"))
    share = F.col("rows") * cells / F.sum("rows").over(Window.partitionBy())
    runs = runs.select("curve", F.ceil(share).cast("int").alias("salts"))
    draw = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("crc").cast("string")))
    draw = F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")
    at = at.join(F.broadcast(runs), "curve").withColumn("salt", (draw % F.col("salts")).cast("int"))
    # at most CELLS + `cells` rows
    tiles = at.groupBy("curve", "salt").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("curve", "salt"))
    tiles = tiles.select("curve", "salt", (upto - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    number = F.row_number().over(Window.partitionBy("curve", "salt").orderBy("crc", "id"))
    ranked = at.join(F.broadcast(tiles), ["curve", "salt"]).withColumn("rank", F.col("before") + number - 1)
    ranked = ranked.withColumn("shard", F.expr(f"rank * {n_shards} div total"))
    first = F.expr(f"(shard * total + {n_shards} - 1) div {n_shards}")
    slot = (F.col("rank") - first).cast("long").alias("slot")
    return ranked.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "curve", F.col("shard").cast("int").alias("shard"), slot)


def op8_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    out = hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "curve")


def _level_sql(dim: str) -> str:
    return f"""{dim}_l AS (
  SELECT {dim}, CAST((2 * sum(count(*)) OVER (ORDER BY {dim} NULLS FIRST) - count(*)) * 16 // (2 * sum(count(*)) OVER ()) AS INT) AS l FROM m GROUP BY {dim}),
{dim}_k AS (SELECT {dim}, dense_rank() OVER (ORDER BY l) - 1 AS k FROM {dim}_l)"""


_CURVE = ",".join(str(hilbert_index((c >> 8, c >> 4 & 15, c & 15), 4)) for c in range(4096))
#: The checksum goes byte by byte over the text with the remainders of single bytes; the curve's indices are listed.
ORACLE_SQL = f"""
WITH RECURSIVE b(i, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM b WHERE k < 8),
z AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
u AS MATERIALIZED (
  SELECT t.text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 2 * octet_length(encode(t.text)), 2), lambda i: CAST('0x' || h[i : i + 1] AS BIGINT))),
    lambda a, x: xor(a // 256, z.t[xor(a, x) % 256 + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents) t, z),
m AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, octet_length(encode(u.text)) + 1 AS size, crc, lang, source FROM documents d JOIN u ON u.text = coalesce(d.text, '')),
{", ".join(map(_level_sql, ("size", "lang", "source")))},
p AS (SELECT m.*, [{_CURVE}][1 + 256 * a.k + 16 * b.k + c.k] AS curve FROM m
  JOIN size_k a USING (size) JOIN lang_k b ON m.lang IS NOT DISTINCT FROM b.lang JOIN source_k c ON m.source IS NOT DISTINCT FROM c.source),
s AS (SELECT curve, CAST(ceil(count(*) * 4096 / sum(count(*)) OVER ()) AS INT) AS salts FROM p GROUP BY curve),
r AS (SELECT p.*, count(*) OVER () AS total,
  row_number() OVER (ORDER BY curve, CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(crc AS VARCHAR))), 1, 8) AS BIGINT) % salts, crc, doc_id) - 1 AS rank
  FROM p JOIN s USING (curve))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(rank * 8 // total AS INT) AS shard,
  CAST(rank - ((rank * 8 // total) * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, CAST(curve AS INT) AS curve
FROM r
"""
