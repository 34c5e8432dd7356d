"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources that list them). Targets of sources come from running
sums over the sources. A pattern offers its words once at no cost and again at convex costs, one unit more for each further
copy. The flow that fills every source's quota at least cost says how many words each pattern gives. Where sources overlap,
that network (patterns -> sources) is solved in the driver, for at most PATTERNS patterns, or an error; a source that only
patterns of its own have is one arc, which needs no network, so of such sources there may be any number. Inside a pattern
whole rounds go to every document and the rest goes to a seeded prefix of its documents, the last of them where that comes
nearer to the amount.

Null text has size 0, a null source is a source of its own (last in order). Documents of size 0 take 0; those without any
source, or with a null array, take 0. Every row is a document of its own and has its own draw, of id, text and its number
among equal rows: rows of null or repeated ids are drawn like others, and reruns agree whatever the partitioning. Other
columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import PART, by_ranges, with_offsets
from .store import settle

WORDS = r"[^\x20\x09-\x0D]++"
#: Overlapping membership patterns that the flow is solved for in the driver; each is a row of a few numbers.
PATTERNS = 200_000


def capped_targets(sizes: list[int], weights: list[int], share: Fraction, most: int, total: int | None = None) -> list[Fraction]:
    """``share`` of all words (``total``, or the sum of the sizes where sources don't overlap) dealt by weight, none above
    ``most`` times its source's size, the excess dealt again."""
    left, open_, out = share * (sum(sizes) if total is None else total), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_ and left > 0:
        unit = Fraction(left) / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        for i in full or open_:
            out[i] = Fraction(most * sizes[i]) if full else unit * weights[i]
        left = left - sum(out[i] for i in full) if full else Fraction(0)
        open_ -= full or open_
    return out


def min_cost_flow(supply: dict[tuple[int, ...], int], quota: list[int], copies: int) -> dict[tuple[int, ...], int]:
    """Words that each pattern (a tuple of source numbers) gives, filling the quotas at least convex repetition cost.

    Network: start -> pattern (an arc a copy, cost = copies before it) -> source -> end. Only the first arc of a path
    costs anything, so the cheapest augmenting paths of successive shortest paths are those of the cheapest open copy:
    one maximum flow (by blocking flows on level graphs) for each copy, kept while the next copy is opened, is the
    least-cost flow. A pattern of one source needs no search beyond its own arc."""
    patterns = sorted(supply)
    n, end = len(patterns), 1 + len(patterns) + len(quota)
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]  # arcs of each node; the arc at i ^ 1 runs back

    def arc(a: int, b: int, most: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((most, 0))

    for k, p in enumerate(patterns):
        arc(0, 1 + k, 0)  # arc 2k of the open copies
        out[1 + k].pop()  # nothing flows back to the start
    for k, p in enumerate(patterns):
        for s in p:
            arc(1 + k, 1 + n + s, copies * supply[p])
    for s, q in enumerate(quota):
        arc(1 + n + s, end, q)
    given = [0] * n
    for _ in range(copies):
        for k, p in enumerate(patterns):
            room[2 * k] += supply[p]
        while True:
            level, queue = {0: 0}, [0]
            for a in queue:
                for i in out[a]:
                    if room[i] and to[i] not in level:
                        level[to[i]] = level[a] + 1
                        queue.append(to[i])
            if end not in level:
                break
            tried = [0] * (end + 1)
            path: list[int] = []
            while True:
                a = to[path[-1]] if path else 0
                if a == end:
                    push = min(room[i] for i in path)
                    for i in path:
                        room[i] -= push
                        room[i ^ 1] += push
                    given[to[path[0]] - 1] += push
                    path = []
                elif tried[a] < len(out[a]):
                    i = out[a][tried[a]]
                    if room[i] and level.get(to[i]) == level[a] + 1:
                        path.append(i)
                    else:
                        tried[a] += 1
                elif path:
                    tried[to[path.pop() ^ 1]] += 1
                else:
                    break
    return dict(zip(patterns, given, strict=True))


def numbered_copies(rows: DataFrame, salts: int = 64) -> DataFrame:
    """``rows`` with ``copy``, 1 to m among the m rows that are equal in all columns. Equal rows are counted where they are read
    and made again from their counts, so a row that is repeated without end is never brought together."""
    counted = rows.withColumn("salt", F.spark_partition_id() % salts).groupBy(*rows.columns, "salt").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*rows.columns).orderBy("salt"))  # at most ``salts`` rows
    dealt = counted.withColumn("upto", upto).repartition(*rows.columns, "salt")
    return dealt.select(*rows.columns, F.explode(F.sequence(F.col("upto") - F.col("m") + 1, F.col("upto"))).alias("copy"))


def source_targets(sources: DataFrame, total: int, weights: tuple[int, ...], share: Fraction, copies: int) -> DataFrame:
    """``sources`` (source, size) with ``target``: ``share`` of all words dealt by the weights, which repeat along the code-point
    order of the sources (null last), none above ``copies`` times its size, the excess dealt again. The level to which
    targets rise is found on running sums along the sources' ratios, so there may be any number of sources."""
    whole = sources.withColumn("none", F.col("source").isNull())
    first = with_offsets(by_ranges(whole, ["none", "source"]), [], {"rows": F.count("*")})
    place = F.col("rows_before") + F.row_number().over(Window.partitionBy(PART).orderBy("none", "source")) - 1
    cycle = F.array(*(F.lit(w) for w in weights))
    sized = first.select("source", "none", "size", F.element_at(cycle, (place % len(weights) + 1).cast("int")).alias("weight"))
    sized = sized.withColumn("ratio", copies * F.col("size").cast("double") / F.col("weight"))
    cells = with_offsets(by_ranges(sized, ["ratio", "none", "source"]), [], {"full": F.sum(copies * F.col("size")), "open": F.sum("weight")})
    inside = Window.partitionBy(PART).orderBy("ratio", "none", "source").rowsBetween(Window.unboundedPreceding, 0)
    full = F.col("full_before") + F.sum(copies * F.col("size")).over(inside) - copies * F.col("size")
    left = F.col("open_all") - F.col("open_before") - F.sum("weight").over(inside) + F.col("weight")
    level = cells.select("ratio", ((F.lit(float(share * total)) - full) / left).alias("level")).filter("level <= ratio")
    found = level.agg(F.max("level")).first()[0]  # one number; none where all are full
    top = float(copies) * F.col("size")
    return sized.select("source", "size", (top if found is None else F.least(F.lit(found) * F.col("weight"), top)).alias("target"))


def _flow_plan(patterns: DataFrame, sources: DataFrame, copies: int) -> DataFrame:
    """(pattern, given) for patterns that hold several sources, and for those that share a source with one of these."""
    joint = patterns.filter(F.size("members") > 1)
    tied = joint.select(F.explode("members").alias("tied")).distinct()
    beside = patterns.filter(F.size("members") == 1).join(tied, F.col("members")[0].eqNullSafe(F.col("tied")), "left_semi")
    rows = joint.unionByName(beside).select("pattern", "members", "offered").limit(PATTERNS + 1).collect()  # a row a pattern
    if len(rows) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} overlapping membership patterns; group sources that few documents have")
    spark = patterns.sparkSession
    if not rows:
        return spark.createDataFrame([], "pattern string, given long")
    quotas = sources.join(tied, F.col("source").eqNullSafe(F.col("tied"))).select("source", F.floor(F.col("target") + 0.5).alias("quota")).collect()  # of these patterns
    quotas.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    number = {r["source"]: i for i, r in enumerate(quotas)}
    key = {r["pattern"]: tuple(sorted(number[m] for m in r["members"])) for r in rows}
    given = min_cost_flow({key[r["pattern"]]: r["offered"] for r in rows}, [r["quota"] for r in quotas], copies)
    return spark.createDataFrame([(p, given[k]) for p, k in key.items()], "pattern string, given long")


def mix_sources(docs: DataFrame, memberships: Column, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), copies: int = 2, id_col: str = "doc_id", text_col: str = "text", seed: str = "mix", slices: int = 4096, key_col: str | None = None) -> DataFrame:
    """(id, size, members, source_sizes, targets, taken, draw) for every input row; ``memberships`` is an array of source
    names, null elements allowed. A ``key_col`` is carried into the result.

    Patterns of one source that no other pattern has need no flow: they give what their source's target says. More than
    PATTERNS patterns of overlapping sources are refused: group rare sources first."""
    keys = [F.col(key_col).alias("key")] if key_col else []
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size")
    members = F.array_sort(F.array_distinct(F.coalesce(memberships, F.array().cast("array<string>")))).alias("members")
    rows = docs.select(F.col(id_col).alias("id"), size, members, F.md5(F.coalesce(text, F.lit(""))).alias("print"), *keys)
    parts_of = [F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("print"), F.col("copy").cast("string")]
    meta = numbered_copies(rows).withColumn("draw", F.md5(F.concat_ws(":", F.lit(seed), *parts_of)))
    slice_ = F.expr(f"cast(conv(substr(draw, 1, 8), 16, 10) as bigint) % {slices}").cast("int")
    meta = settle(meta.drop("print", "copy").withColumns({"slice": slice_, "pattern": F.to_json("members")}), "mix-meta")

    patterns = settle(meta.groupBy("pattern").agg(F.min("members").alias("members"), F.sum("size").alias("offered")), "mix-patterns")
    sources = patterns.select(F.explode("members").alias("source"), "offered").groupBy("source").agg(F.sum("offered").alias("size"))
    total = patterns.agg(F.sum("offered")).first()[0] or 0
    sources = settle(source_targets(sources, total, weights, share, copies), "mix-sources")
    # what each pattern's sources are, in the order of the pattern
    each = patterns.select("pattern", F.posexplode("members").alias("i", "source"))
    each = each.join(sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
    listed = each.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("i", "size", "target"))).alias("of"))
    listed = patterns.join(listed, "pattern", "left").join(_flow_plan(patterns, sources, copies), "pattern", "left")
    alone = F.least(F.floor(F.col("of")[0]["target"] + 0.5), copies * F.col("offered"))
    given = F.coalesce("given", F.when(F.size("members") == 1, alone), F.lit(0))
    plan = listed.select("pattern", "offered", given.alias("given"), F.coalesce("of.target", F.array().cast("array<double>")).alias("targets"), F.coalesce("of.size", F.array().cast("array<bigint>")).alias("source_sizes"))
    plan = plan.withColumns({"rounds": F.expr("if(offered > 0, given div offered, 0)"), "rest": F.expr("if(offered > 0, given % offered, 0)")})
    # at most `slices` rows a pattern: words before each slice of the seeded order
    parts = meta.groupBy("pattern", "slice").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("slice")) - F.col("words")
    parts = parts.withColumn("before", before).drop("words").join(plan, "pattern")
    inside = Window.partitionBy("pattern", "slice").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    mixed = meta.join(parts, ["pattern", "slice"]).withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    extra = F.when(F.col("start") + F.col("size") / 2 <= F.col("rest"), F.col("size")).otherwise(F.lit(0))
    taken = F.col("rounds") * F.col("size") + F.when(F.col("rounds") < copies, extra).otherwise(F.lit(0))
    shown = [F.col("key").alias(key_col)] if keys else []
    return mixed.select(F.col("id").alias(id_col), "size", "members", "source_sizes", "targets", taken.cast("long").alias("taken"), "draw", *shown)


def op7_flow_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix_sources(docs, F.array("source"))
    return out.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || CAST(row_number() OVER (PARTITION BY doc_id, text, source) AS VARCHAR)) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, 2.0 * source_size / weight AS ratio,
             coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
             1.5 * sum(source_size) OVER () AS total FROM w),
l AS (SELECT max((total - capped) / open_weight) AS level FROM o WHERE (total - capped) / open_weight <= ratio),
t AS (SELECT o.source, o.source_size, least(l.level * o.weight, 2.0 * o.source_size) AS target FROM o, l),
r AS (
  SELECT d.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(draw, 1, 8) AS BIGINT) % 4096, draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start,
         CAST(floor(t.target + 0.5) AS BIGINT) AS given
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (given // source_size) * size + CASE WHEN given // source_size < 2 AND start + size / 2.0 <= given % source_size THEN size ELSE 0 END END AS BIGINT) AS taken
FROM r
"""
