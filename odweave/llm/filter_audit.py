"""Filter interaction audit: what each of several filters removes in every order, alone and beside the others.

Every row gets a mask with a bit for each filter that it fails. The filter of repeated texts finds them by
partition refinement: rows are split by length in code points, then by hashes of successive blocks of the
text; rows left alone in their class are dropped after each split. Texts of the surviving classes are then
compared whole. All figures of all orders follow from counts of masks.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import HOT_KEYS
from ..plans.storage import forget, materialize

LETTERS = "ABCDE"
#: Code points of the blocks that split classes one after the other; the last block is the rest of the text.
BLOCKS = (256, 4096)
#: Rows of one class that a task compares with the class's first text.
ROWS_PER_SALT = 10_000
_WORD = r"[^\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits of the filters that look at one text: A few words, B few distinct words, C many capitals, D holds a symbol. No nulls."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = lambda n, d: F.when(n < 200, 1).otherwise(0) + F.when(100 * d < 50 * n, 2).otherwise(0)
    of_words = F.transform(F.array(counts), lambda c: fails(c["n"], c["d"]))[0]
    return (of_words + F.when(100 * capitals.cast("long") > 2 * F.length(text), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)).cast("int")


def _block_hashes(text: Column) -> list[Column]:
    out, at = [], 1
    for size in BLOCKS:
        out.append(F.xxhash64(F.substring(text, at, size)))
        at += size
    return [*out, F.xxhash64(F.expr(f"substring(_text, {at})"))]


def _salted_join(rows: DataFrame, classes: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined with classes (one row a key, `_n` rows of it), the classes that hold more than 1/HOT_KEYS of all rows in several parts."""
    total = classes.agg(F.sum("_n")).first()[0] or 0
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / ROWS_PER_SALT)).cast("int")
    hot = classes.filter((F.col("_n") * HOT_KEYS > total) & (F.col("_n") > ROWS_PER_SALT)).select(F.col(key).alias("_hk"), parts.alias("_parts"))
    spread = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")  # at most HOT_KEYS rows of two numbers
    spread = spread.withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_hk", "_parts")
    many = (F.col("_n") * HOT_KEYS > total) & (F.col("_n") > ROWS_PER_SALT)
    wide = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(many, parts - 1).otherwise(0)))).drop("_n")
    return spread.join(wide.hint("merge"), [key, "_salt"], how).drop("_salt")


def later_copies(rows: DataFrame) -> DataFrame:
    """_uid of the rows whose _text stands under a smaller _id too. rows(_uid, _id, _text) has no null texts.

    Joins are merged at every size: left to itself, Spark broadcasts on small tables what it shuffles on large ones.

    A null id is never the smaller one, and is after all others; rows that repeat an id are not after each other.
    """
    text = F.col("_text")
    hashes = _block_hashes(text)
    keyed = rows.select("_uid", "_id", "_text", F.xxhash64(F.length(text)).alias("_class"), *[h.alias(f"_h{i}") for i, h in enumerate(hashes)])
    left = keyed.drop("_text")
    for i in range(len(hashes) + 1):
        if i:
            left = left.withColumn("_class", F.xxhash64("_class", f"_h{i - 1}"))
        classes = left.groupBy("_class").agg(F.count("*").alias("_n")).filter("_n > 1")
        left, before = materialize(_salted_join(left, materialize(classes, "audit-classes"), "_class", "inner"), f"audit-split{i}"), left
        forget(before)
    # What is left agrees in length and in all hashes; texts decide. A class of several texts (a collision) is gone through once for each.
    open_rows, found = left.select("_uid", "_id", "_class"), None
    texts = rows.select("_uid", "_text").join(open_rows.hint("merge"), "_uid")
    open_rows = materialize(texts, "audit-texts")
    while True:
        first = open_rows.groupBy("_class").agg(F.count("*").alias("_n"), F.min_by(F.struct(F.col("_id").alias("_first"), F.col("_text").alias("_seen")), F.struct(F.col("_id").isNull(), "_id")).alias("_f"))
        first = materialize(first.select("_class", "_n", "_f.*"), "audit-first")
        met = materialize(_salted_join(open_rows, first, "_class", "inner").withColumn("_same", F.col("_text") == F.col("_seen")), "audit-met")
        later = F.col("_same") & F.coalesce(F.col("_id") > F.col("_first"), F.col("_id").isNull() & F.col("_first").isNotNull())
        new = met.filter(later).select("_uid")
        found = new if found is None else found.unionByName(new)
        rest = met.filter("NOT _same").select("_uid", "_id", "_class", "_text")
        if not rest.take(1):
            return found
        open_rows = materialize(rest, "audit-rest")


def masks(docs: DataFrame) -> DataFrame:
    """(_uid, doc_id, part, mask): a row for each row of docs(doc_id, source, text). Null texts are empty; so are null sources."""
    own = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col("doc_id").alias("_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = materialize(own.withColumn("_mask", failures(F.col("_text"))), "audit-rows")
    copies = later_copies(rows.select("_uid", "_id", "_text")).withColumn("_copy", F.lit(16))
    return rows.drop("_text").join(copies.hint("merge"), "_uid", "left").select("_uid", F.col("_id").alias("doc_id"), "part", (F.col("_mask") + F.coalesce("_copy", F.lit(0))).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each filter does at each step of each order, for each part: a row for (part, filter_order, step), zeros included.

    docs(doc_id, source, text), labels(doc_id, quality, toxic). A document counts as good (toxic) if any label row
    of its id says so; null ids have no labels. Rows that repeat an id count each. An empty table has no parts.
    """
    per_id = masks(docs).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("_n"))
    marks = labels.groupBy(F.col("doc_id").alias("_lid")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    told = per_id.join(marks, F.col("doc_id") == F.col("_lid"), "left")
    counts = told.groupBy("part", "mask").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.coalesce("_good", F.lit(0))).alias("good"), F.sum(F.col("_n") * F.coalesce("_toxic", F.lit(0))).alias("toxic"))
    # A filter's figures hang on the set of the earlier ones alone, whatever their order: one row for (part, filter, earlier set).
    n, sets = len(letters), 1 << len(letters)
    bit, earlier, mask = F.expr("shiftleft(1, filter)"), F.col("earlier"), F.col("mask")
    states = counts.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("earlier", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    states = states.filter(earlier.bitwiseAND(bit) == 0)
    fails, met = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(earlier) != 0
    total = lambda when, column="n": F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0)).cast("long")
    # In a share of 1/f of all orders, a filter is the first to see a document that fails f filters.
    share = math.factorial(n) / F.bit_count(mask)
    figures = states.groupBy("part", "filter", "earlier").agg(
        total(~fails & ~met).alias("kept"), total(fails & ~met).alias("removed"), total(fails & met).alias("redundant"), total(mask == bit).alias("unique_fails"),
        total(fails & ~met, "good").alias("good_lost"), total(fails & ~met, "toxic").alias("toxic_lost"), F.coalesce(F.sum(F.when(fails, F.col("n") * share.cast("long"))), F.lit(0)).cast("long").alias("shapley"),
    )
    steps = []
    for order in itertools.permutations(range(n)):
        for step, f in enumerate(order):
            steps.append(("".join(letters[i] for i in order), step + 1, f, sum(1 << i for i in order[:step])))
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, earlier int")  # n! * n rows, whatever the documents
    return figures.join(F.broadcast(orders), ["filter", "earlier"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def oracle() -> str:
    """DuckDB SQL for the audit of documents with labels."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
e AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    list_concat(CASE WHEN len(w) < 200 THEN ['A'] ELSE [] END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN ['B'] ELSE [] END,
        CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN ['C'] ELSE [] END,
        CASE WHEN regexp_matches(text, '[#$%&*|]') THEN ['D'] ELSE [] END, CASE WHEN doc_id > first OR (doc_id IS NULL AND first IS NOT NULL) THEN ['E'] ELSE [] END) AS fails
    FROM e LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
    WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS c, string_split(filter_order[1:step - 1], '') AS earlier FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, c,
    sum(CASE WHEN NOT list_contains(fails, c) AND NOT list_has_any(fails, earlier) THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN list_contains(fails, c) AND NOT list_has_any(fails, earlier) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN list_contains(fails, c) AND list_has_any(fails, earlier) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = [c] THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN list_contains(fails, c) AND NOT list_has_any(fails, earlier) THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN list_contains(fails, c) AND NOT list_has_any(fails, earlier) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, c)::BIGINT AS shapley FROM r"""
