"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

The mix is a row of slots, each of one block of words. Slot j asks for the source into whose part of
[0, 1) the point frac(j * golden ratio) falls; parts are as wide as the sources' targets. The r-th slot of
a source takes the r-th block of that source's documents, which follow each other in a shuffled order,
time and again. Blocks of equal size make counting slots the same as counting words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import grouped_prefix, ordered_index
from ..plans.storage import materialize

#: Weights of the sources in their order, repeating, and how often a document may be taken.
WEIGHTS, EPOCHS = (1, 2, 3), 3
#: Slots that a mix has at least (if it has as many words), and the largest block in words.
SLOTS, BLOCK = 65_536, 4_096
#: frac(j * GOLDEN) is the schedule's j-th point.
GOLDEN = 0.6180339887498949
#: Equal cells of [0, 1) by which points find their source, slots and documents in a chunk of a running sum.
CELLS, CHUNK, HASH_CHUNKS = 4_096, 65_536, 256


def size_of(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(seed: str = "mix") -> Column:
    """The MD5 by which documents are shuffled."""
    return F.md5(F.concat_ws("\x1f", F.lit(seed), F.col("doc_id").cast("string"), F.col("text")))


def source_targets(sizes: DataFrame, total: int, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, label: str = "mix-sources") -> DataFrame:
    """sizes(source, source_size) with w, cap, target and [lo, hi): the source's part of [0, total).

    Targets are shares of the total by weight, stop at `epochs` times the source's size and leave the rest
    to the others by weight, until none is above: min(cap, w * level) for the level at which they add up.
    The level is found by repeating that on sums alone, each round one number more exact; each sum is of
    whole numbers, so that reruns agree.
    """
    indexed = ordered_index(sizes, [F.col("source")], "idx", label)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    rows = materialize(indexed.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * epochs), label)
    level, open_w = 0.0, None
    while True:
        over = F.col("cap") < F.lit(level) * F.col("w")
        a, b = rows.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("w")))).first()
        if not b or b == open_w:
            break
        open_w, level = b, (total - a) / b
    full = F.col("cap") < F.lit(level) * F.col("w")
    rows = rows.withColumn("_a", F.when(full, F.col("cap")).otherwise(F.lit(0))).withColumn("_b", F.when(full, F.lit(0)).otherwise(F.col("w")))
    chunk = F.floor(F.col("idx") / CHUNK)
    rows = rows.withColumn("_g", F.lit(0))
    rows = grouped_prefix(rows, ["_g"], chunk, [F.col("idx")], F.col("_a"), "_pa")
    rows = grouped_prefix(rows, ["_g"], chunk, [F.col("idx")], F.col("_b"), "_pb")
    at = lambda x, y: x.cast("double") + F.lit(float(level)) * y.cast("double")
    return rows.select("source", "source_size", "idx", at(F.col("_a"), F.col("_b")).alias("target"), at(F.col("_pa"), F.col("_pb")).alias("lo"), at(F.col("_pa") + F.col("_a"), F.col("_pb") + F.col("_b")).alias("hi"))


def block_size(total: int, slots: int = SLOTS, block: int = BLOCK) -> int:
    """Words of a block: so many that `slots` slots cover the total, at most `block`."""
    return max(1, min(block, total // slots))


def schedule(targets: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, idx, rank): each slot's source and its place among that source's slots."""
    spark = targets.sparkSession
    n = -(-total // block)
    cell = lambda x: F.floor(x * CELLS / total).cast("int")
    parts = targets.filter("hi > lo").select("idx", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(CELLS - 1)))).alias("cell"))
    u = F.col("id") * F.lit(GOLDEN)
    points = spark.range(n).select(F.col("id").alias("slot"), ((u - F.floor(u)) * total).alias("u"))
    points = points.withColumn("cell", F.least(cell(F.col("u")), F.lit(CELLS - 1)))
    # Parts meet exactly: the end of one is computed as the start of the next.
    slots = points.join(parts, "cell").filter("u >= lo AND u < hi").select("slot", "idx")
    return grouped_prefix(slots, ["idx"], F.floor(F.col("slot") / CHUNK), [F.col("slot")], F.lit(1), "rank")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, slots: int = SLOTS, block: int = BLOCK, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(plan, documents): what each slot takes, and per document what the mix takes of it.

    docs(doc_id, source, text). plan: slot, doc_id, uid, from_word, n_words. documents: uid, h, doc_id, source,
    size, source_size, target, taken; h is the hash that orders them. Null and wordless texts have size 0 and are never taken; a null source
    is a source of its own, last in order. Documents are shuffled within their source by the MD5 of seed,
    doc_id and text; rows that repeat all of these follow each other and are taken like others. An empty table,
    or one without words, gives an empty plan.
    """
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), order_hash(seed).alias("h"))
    sized = materialize(sized.withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")
    per = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-per-source")
    total = int(per.agg(F.sum("source_size")).first()[0] or 0)
    if not total:
        none = sized.select("uid", "h", "doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
        return none.select(F.lit(0).cast("long").alias("slot"), "doc_id", "uid", F.lit(0).cast("long").alias("from_word"), F.lit(0).cast("long").alias("n_words")).limit(0), none
    targets = materialize(source_targets(per, total, weights, epochs), "mix-targets")
    step = block_size(total, slots, block)
    asked = schedule(targets, total, step)

    rows = _with_source(sized, targets)
    chunk = F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % HASH_CHUNKS
    placed = materialize(grouped_prefix(rows, ["idx"], chunk, [F.col("h"), F.col("doc_id"), F.col("uid")], F.col("size"), "at"), "mix-placed")
    turns = placed.filter("size > 0").select("uid", "doc_id", "idx", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: F.col("at") + e * F.col("source_size"))).alias("start"))
    blocks = turns.select("*", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("start") + F.col("size") - 1) / step))).alias("rank"))
    got = blocks.join(asked, ["idx", "rank"])
    first = F.greatest(F.col("start"), F.col("rank") * step)
    end = F.least(F.col("start") + F.col("size"), (F.col("rank") + 1) * step)
    plan = got.select("slot", "doc_id", "uid", (first - F.col("start")).alias("from_word"), (end - first).alias("n_words"))
    taken = plan.groupBy("uid").agg(F.sum("n_words").alias("_taken"))
    out = placed.join(taken, "uid", "left").select("uid", "h", "doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken"))
    return plan, out


def _with_source(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with their source's row. Sources of many rows are spread: each source's row stands once for each hash chunk that occurs in it."""
    part = F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % HASH_CHUNKS
    rows = sized.withColumn("_part", part)
    there = rows.select("source", "_part").distinct()
    t = targets.select(F.col("source").alias("_s"), "source_size", "idx", "target", "lo", "hi")
    wide = there.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnsRenamed({"source": "_s", "_part": "_q"})
    return rows.join(wide, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_q"))).drop("_s", "_q", "_part", "lo", "hi")


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs that the mix takes, with size, source_size, target and taken, which replace columns of these names.

    Rows that repeat doc_id and text show the mean of their counts, rounded down. Null and wordless texts are
    never taken; an empty table, or one without words, gives no rows.
    """
    _, found = mix(docs)
    per = found.groupBy("h").agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.floor(F.avg("taken")).cast("long").alias("taken"))
    own, per = docs.drop("size", "source_size", "target", "taken"), materialize(per.filter("taken > 0").withColumnRenamed("h", "_mix_hash"), "mix-per-hash")
    return own.join(per, order_hash() == per["_mix_hash"]).select(*[own[c] for c in own.columns], *[per[c] for c in ("size", "source_size", "target", "taken")])


def oracle() -> str:
    """DuckDB SQL for what the mix takes of each document."""
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5(concat_ws(chr(31), 'mix', doc_id::VARCHAR, text)) AS h, row_number() OVER () AS uid FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, 3 * source_size AS cap, idx % 3 + 1 AS w FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM g)),
t AS (SELECT sum(source_size)::BIGINT AS total, sum(w)::BIGINT AS all_w FROM p),
r AS (SELECT p.*, total, (total - coalesce(sum(cap) OVER o, 0))::DOUBLE / (all_w - coalesce(sum(w) OVER o, 0))::DOUBLE AS level,
        row_number() OVER (ORDER BY cap / w, idx) AS k FROM p, t WINDOW o AS (ORDER BY cap / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, k) FILTER (NOT cap < level * w) AS level FROM r),
s AS (SELECT p.*, level, CASE WHEN cap < level * w THEN cap ELSE 0 END AS a, CASE WHEN cap < level * w THEN 0 ELSE w END AS b FROM p, l),
q AS (SELECT *, a::DOUBLE + level * b::DOUBLE AS target, sum(a) OVER i::BIGINT AS ha, sum(b) OVER i::BIGINT AS hb FROM s WINDOW i AS (ORDER BY idx)),
x AS (SELECT *, (ha - a)::DOUBLE + level * (hb - b)::DOUBLE AS lo, ha::DOUBLE + level * hb::DOUBLE AS hi FROM q),
z AS (SELECT total, greatest(1, least({BLOCK}, total // {SLOTS})) AS block FROM t),
u AS (SELECT slot, (slot * {GOLDEN}::DOUBLE - floor(slot * {GOLDEN}::DOUBLE)) * total AS u FROM (SELECT total, unnest(range((total + block - 1) // block)) AS slot FROM z)),
sl AS (SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS rank FROM u JOIN x ON u >= lo AND u < hi),
pl AS (SELECT d.*, x.idx, x.source_size, x.target, coalesce(sum(size) OVER (PARTITION BY x.idx ORDER BY h, doc_id, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
        FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
tn AS (SELECT uid, idx, size, place + e * source_size AS start FROM pl, (SELECT unnest(range({EPOCHS})) AS e) WHERE size > 0),
bl AS (SELECT tn.*, block, unnest(range(start // block, (start + size - 1) // block + 1)) AS rank FROM tn, z),
tk AS (SELECT uid, sum(least(start + size, (rank + 1) * block) - greatest(start, rank * block)) AS taken FROM bl JOIN sl USING (idx, rank) GROUP BY uid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM pl LEFT JOIN tk USING (uid)"""
