"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources share a budget by weight, none above ``most_repeats`` times its
own size; what a capped source leaves is shared again by weight (a water level).

Curriculum: a source's weight at training time t in [0, 1] is a straight line from
``1 + slope`` to ``1 - slope`` times its mean; the slope goes evenly from
``+drift`` for the first source to ``-drift`` for the last.  The integral of the
schedule times the target is the source's cumulative demand; inverting it at the
words that stand before a copy of a document in its source's order gives that copy
its training position.  ``positions`` gives each copy its place, ``in_order`` sorts the
copies by it, and ``deal`` does both and gathers the copies of each row again.

Sizes are counted and summed in hashed buckets of each source, so a source with a
third of all rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_width

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents that fill what is left of a source's target where no document may be cut.
FILL = 4


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most_repeats: float = 2.0) -> DataFrame:
    """(source, source_size, ordinal, sources, target) from one row (source, source_size) for each source.

    Sources in code-point order, null last, take the weights in turn.  Sizes of zero
    have target zero.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", (F.row_number().over(order) - 1).alias("ordinal"), w.alias("w"))
    rows = rows.withColumns({"cap": most_repeats * F.col("source_size"), "budget": share * F.sum("source_size").over(Window.partitionBy())})
    # the water level: sources in order of cap / weight are capped while their cap is under their share of the rest
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "ordinal")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    rows = rows.withColumn("open", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    rows = rows.withColumn("level", F.first("open", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return rows.select("source", "source_size", "ordinal", F.count("*").over(Window.partitionBy()).alias("sources"), target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most_repeats: float = 2.0, keep: bool = False, whole: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, ...): one row for each row of ``docs``.

    ``taken`` words are ``repeats`` whole copies and, for the one document of a source
    at which its target is reached, ``part`` words of one more.  Also: ``source``,
    ``before`` (words of the source ahead of the document in its order), ``ordinal``,
    ``sources`` and, with ``keep``, the whole row as a struct ``row``.  With ``whole`` no
    document is taken in part: what is left of a source's target goes to a few documents
    not yet taken, each the largest that fits, the last one that whose size comes nearest.

    The order within a source is that of a digest of doc_id (null last), then the text;
    rows that are equal in both are taken one after the other.  Null texts have size
    0 and are taken 0 times; a null source is a source.  An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # a source as a key that is never null, so that window and join share one shuffle
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select("doc_id", "source", key.alias("_source"), n_words(F.col("text")).alias("size"), F.md5(F.col("doc_id").cast("string")).alias("_order"), F.xxhash64("text").alias("_tie"), *([F.struct(*docs.columns).alias("row")] if keep else []))
    # cells are ranges of a source's order; rows without an id come last, by the digest of their text
    cells, span = 4 * shuffle_width(spark), 1 << 24
    place = F.coalesce(F.conv(F.substring("_order", 1, 6), 16, 10).cast("long"), F.shiftright("_tie", 40) + span + span // 2)
    rows = rows.withColumn("_cell", F.floor(place * cells / span).cast("int"))
    narrow = scratch.save(rows.drop("row"))
    cell = narrow.groupBy("_source", "_cell").agg(F.sum("size").alias("cell_size"), F.first("source").alias("source"))
    ahead = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell = scratch.save(cell.select("_source", "source", "_cell", "cell_size", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)).alias("cell_before")))
    aims = targets(cell.groupBy("_source").agg(F.first("source").alias("source"), F.sum("cell_size").alias("source_size")).drop("_source"), weights, share, most_repeats)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.withColumn("repeats", F.floor(ratio + 1e-12).cast("long"))
    aims = scratch.save(aims.withColumn("more", F.round(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long")))
    at = cell.join(aims, cell["source"].eqNullSafe(aims["source"])).select("_source", "_cell", "cell_before", "source_size", "ordinal", "sources", "target", "repeats", "more")

    def placed(rows: DataFrame) -> DataFrame:
        inner = Window.partitionBy("_source", "_cell").orderBy("_order", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        return rows.join(at, ["_source", "_cell"]).withColumn("before", F.col("cell_before") + F.col("_within"))

    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("more") - F.col("before")))
    if whole:
        late = scratch.save(placed(narrow).where("size > 0 and before + size > more").select("_source", "before", "size", "more"))
        gap = late.groupBy("_source").agg(F.min("before").alias("first"), F.max("more").alias("more")).selectExpr("_source", "greatest(0L, more - first) AS gap")
        picks = []
        for turn in range(FILL):  # a row for each source at most
            fits = "abs(size - gap) <= gap AND gap > 0" if turn == FILL - 1 else "size <= gap"
            off = F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("before"), F.col("size"))
            best = scratch.save(late.join(gap, "_source").where(fits).groupBy("_source").agg(F.min(off).alias("l")).selectExpr("_source", "l.before AS before", "l.size AS _picked"))
            picks.append(best.select("_source", "before"))
            late = late.join(picks[-1], ["_source", "before"], "left_anti")
            gap = scratch.save(gap.join(best, "_source", "left").selectExpr("_source", "gap - coalesce(_picked, 0L) AS gap"))
        last = reduce(DataFrame.union, picks).groupBy("_source").agg(F.collect_list("before").alias("last"))
        at = at.join(last, "_source", "left")
        chosen = F.coalesce(F.array_contains("last", F.col("before")), F.lit(False)) & (F.col("size") > 0)
        part = F.when((F.col("before") + F.col("size") <= F.col("more")) | chosen, F.col("size")).otherwise(F.lit(0).cast("long"))
    rows = placed(rows if keep else narrow).withColumn("part", part)
    taken = (F.col("repeats") * F.col("size") + F.col("part")).alias("taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken, "repeats", "part", "before", "ordinal", "sources", *(["row"] if keep else []))


def positions(mixed: DataFrame, drift: float = 0.5) -> DataFrame:
    """One row for each copy that the mix takes: ``copy`` (from 0), ``words`` (of the copy) and ``position`` in [0, 1].

    A document without words is taken as often as its source is taken whole.

    Demand by time t is target * (t * (1 + s) - s * t * t), s the source's slope.
    """
    n = F.col("repeats") + (F.col("part") > 0).cast("long")
    rows = mixed.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    words = F.when(F.col("copy") < F.col("repeats"), F.col("size")).otherwise(F.col("part"))
    done = (F.col("copy") * F.col("source_size") + F.col("before")) / F.col("target")
    s = F.when(F.col("sources") > 1, drift * (1 - 2 * F.col("ordinal") / (F.col("sources") - 1))).otherwise(0.0)
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + s) * (1 + s) - 4 * s * done))
    t = F.when(F.abs(s) < 1e-9, done).otherwise(((1 + s) - root) / (2 * s))
    return rows.withColumns({"words": words, "position": F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))})


def in_order(copies: DataFrame) -> DataFrame:
    """Copies in training order: range-partitioned and sorted by position."""
    return copies.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def deal(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most_repeats: float = 2.0, drift: float = 0.5) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, position): one row for each row of ``docs``, in training order.

    All copies are dealt out: each gets its position, and they are range-sorted by it and written.  ``taken``
    sums the words of a row's copies, ``position`` is that of the first one.  Rows that the mix does not take
    come last (taken 0, no copies, position null).
    """
    scratch = Scratch(docs.sparkSession)
    mixed = scratch.save(mix(docs, weights, share, most_repeats))
    copies = scratch.save(in_order(positions(mixed, drift)))
    # rows with words differ in what stands before them in their source
    row = ["doc_id", "size", "source_size", "target"]
    dealt = copies.where("words > 0").groupBy("ordinal", "before", *row).agg(F.sum("words").alias("taken"), F.count("*").alias("copies"), F.min("position").alias("position"))
    zero = F.lit(0).cast("long")
    left = mixed.where("size = 0 or repeats + part = 0").select(*row, zero.alias("taken"), zero.alias("copies"), F.lit(None).cast("double").alias("position"))
    return dealt.select(left.columns).unionByName(left).orderBy(F.col("position").asc_nulls_last(), "doc_id")


_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS o,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, 2 * source_size AS cap, 1.5 * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT source, source_size, k, count(*) OVER () AS sources, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l),
c AS (SELECT d.doc_id, d.size, f.source_size, f.target, f.k, f.sources,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
    CASE WHEN f.source_size > 0 THEN floor(f.target / f.source_size + 1e-12) ELSE 0 END AS r
    FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
"""
_TAKEN_SQL = "CAST(r * size + greatest(0, least(size, round(target - r * source_size) - ahead)) AS BIGINT)"
MIX_SQL = f"{_MIX_SQL}SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target, {_TAKEN_SQL} AS taken FROM c"
#: With the training position of the first copy, at the default drift.
DEAL_SQL = f"""{_MIX_SQL}, t AS (SELECT *, {_TAKEN_SQL} AS taken, CASE WHEN sources > 1 THEN 0.5::DOUBLE * (1 - 2 * k::DOUBLE / (sources - 1)) ELSE 0 END AS s FROM c),
p AS (SELECT *, CASE WHEN taken > 0 THEN ahead::DOUBLE / target END AS done FROM t)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target, taken,
    CASE WHEN taken > 0 THEN round(least(1, greatest(0, CASE WHEN abs(s) < 1e-9 THEN done ELSE ((1 + s) - sqrt(greatest(0, (1 + s) * (1 + s) - 4 * s * done))) / (2 * s) END)), 6) END AS position FROM p"""


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word (n >= 1), white space kept."""
    ends = F.regexp_extract_all(text, F.lit(rf"({WORDS})[\x20\x09-\x0D]*"), F.lit(0))
    lead = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    return F.regexp_replace(F.concat(lead, F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")), r"[\x20\x09-\x0D]+$", "")
