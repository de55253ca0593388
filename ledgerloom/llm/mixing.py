"""Mixing sources to target weights: capped water-filling over sources, seeded whole and fractional repetitions of documents.

Method. Every source has a size (words) and a weight; the mix shares ``share`` percent of all words by weight. A source is clamped at
``epochs`` times its size, and what it can't take is shared again among the others in proportion to their weights, until no source is above
its limit. A document is then taken ``floor(target / size)`` times whole, and the rest of the target goes to the documents of the source in a
seeded order (a digest of seed, id and text): those before the cut are taken once more, the one at the cut in part, so a source's words come
within its repeated rows of the target. Nothing but one-row sums of the small source table reaches the driver.

Only DataFrame functions. Documents are read once for sizes and digests; a compact row (no text) is written. The cut is found through sums by
(source, digest prefix) and an exact order within one prefix only, 1/4096 of a source, so a source with a third of all rows is never in one task.

Cases. A null text has size 0; null and empty sources are sources of their own, null last; a source without words has target 0; rows with the
same id and text share one digest and are taken alike, in equal parts at the cut; an empty table gives no rows; further columns, whatever
their names, are ignored by :func:`mix` and kept by :func:`sample`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.session import broadcast_if_small, plan_bytes

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Bytes of a source table for each part of it that is ordered on its own.
PART_BYTES = 4 << 20
#: Hexadecimal digits of a digest that name a bucket.
PREFIX = 3
#: Parts of a source where the source table is too large for a broadcast.
SALTS = 64


def _named(df: DataFrame, text: Column, doc_id: Column, source: Column, seed: int) -> DataFrame:
    """Adds __key (sorts as the source does, null last), __size and __u, the seeded digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return df.withColumns({
        "__key": F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit("~")),
        "__size": F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long")),
        "__u": F.substring(digest, 1, 16),
    })


def positions(sources: DataFrame) -> DataFrame:
    """Adds ``position``, from 0, by ``key``: order within ranges, counts of the ranges before; no single task orders all."""
    parts = max(1, -(-(plan_bytes(sources) or PART_BYTES) // PART_BYTES))
    ranged = written(sources.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "mix-ranges")
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offset = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return ranged.join(offset, "part").withColumn("position", F.row_number().over(W.partitionBy("part").orderBy("key")) - 1 + F.col("offset")).drop("part", "offset")


def water_fill(sources: DataFrame, share: int = 150, epochs: int = 2) -> DataFrame:
    """sources(..., size long, weight long) -> the same rows with ``target`` double.

    Clamping is decided in whole numbers: a level of ``num / den`` words a unit of weight clamps a source when ``epochs * size * den <= weight * num``.
    """
    cap, weight = (F.lit(epochs) * F.col("size")).cast("decimal(38,0)"), F.col("weight").cast("decimal(10,0)")
    total, weights = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    num, den, clamped = share * total, 100 * weights, 0
    full = F.lit(False)
    while den:
        full = cap * F.lit(str(den)).cast("decimal(24,0)") <= weight * F.lit(str(num)).cast("decimal(28,0)")
        n, taken, rest = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, epochs * F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == clamped:
            break
        num, den, clamped = share * total - 100 * taken, 100 * rest, n
    else:
        full = F.lit(True)
    level = F.col("weight").cast("double") * F.lit(float(num)) / F.lit(float(den or 1))
    return sources.withColumn("target", F.when(full, (F.lit(epochs) * F.col("size")).cast("double")).otherwise(level))


def _plan(rows: DataFrame, weights: tuple[int, ...], share: int, epochs: int) -> DataFrame:
    """One row a source: key, source_size, target, whole, cut, rest, tied (rows at the cut share ``rest`` of their ``tied`` words)."""
    buckets = written(rows.groupBy("key", F.substring("u", 1, PREFIX).alias("bucket")).agg(F.sum("size").alias("words")), "mix-buckets")
    placed = positions(buckets.groupBy("key").agg(F.sum("words").alias("size")))
    weighted = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int")).cast("long"))
    targets = water_fill(written(weighted.drop("position"), "mix-sources"), share, epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    sources = written(targets.select("key", F.col("size").alias("source_size"), "target", whole.alias("whole"))
                      .withColumn("extra", F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")), "mix-targets")
    # the bucket in which the wanted words end, then the digest in it
    until = F.sum("words").over(W.partitionBy("key").orderBy("bucket"))
    ends = buckets.withColumn("before", until - F.col("words")).join(broadcast_if_small(sources, sources), "key").filter("before < extra and extra <= before + words").select("key", "bucket", "before", "extra")
    ends = written(ends, "mix-ends")
    near = rows.withColumn("bucket", F.substring("u", 1, PREFIX)).join(broadcast_if_small(ends, ends), ["key", "bucket"]).groupBy("key", "u").agg(F.sum("size").alias("tied"), F.max("before").alias("before"), F.max("extra").alias("extra"))
    start = F.col("before") + F.sum("tied").over(W.partitionBy("key").orderBy("u")) - F.col("tied")
    cuts = near.withColumn("start", start).filter("start < extra and extra <= start + tied").select("key", F.col("u").alias("cut"), (F.col("extra") - F.col("start")).alias("rest"), "tied")
    return written(sources.drop("extra").join(cuts, "key", "left"), "mix-plan")


def _taken(size: Column, u: Column) -> Column:
    more = F.when(u < F.col("cut"), size).when(u == F.col("cut"), F.expr("__size * rest div tied"))
    return (F.col("whole") * size + F.coalesce(more, F.lit(0))).cast("long")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows meet the row of their source: by broadcast where that is small, else by (source, salt), so that no source is one task."""
    small = broadcast_if_small(plan, plan)
    if small is not plan:
        return rows.join(small.withColumnRenamed("key", "__key"), "__key")
    salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("key", "__key")
    return rows.withColumn("__salt", F.pmod(F.xxhash64("__u"), F.lit(SALTS)).cast("int")).join(salted, ["__key", "__salt"]).drop("__salt")


def _compact(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    return written(_named(own, F.col("text"), F.col("doc_id"), F.col("source"), seed).select("doc_id", F.col("__key").alias("key"), F.col("__size").alias("size"), F.col("__u").alias("u")), "mix-rows")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = 150, epochs: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    rows = _compact(docs, id_col, text_col, source_col, seed)
    both = _with_plan(rows.withColumnsRenamed({"key": "__key", "size": "__size", "u": "__u"}), _plan(rows, weights, share, epochs))
    source = F.when(F.col("__key") != "~", F.substring("__key", 2, 1 << 30)).alias("source")
    return both.select("doc_id", source, F.col("__size").alias("size"), "source_size", "target", _taken(F.col("__size"), F.col("__u")).alias("taken"))


def sample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = 150, epochs: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str = "copy") -> DataFrame:
    """The mix itself: the rows of docs, once for each repetition (``copy_col`` from 1), the last one cut to its first words where it is taken in part.

    The texts aren't shuffled where the plan of sources is small enough for a broadcast.
    """
    plan = _plan(_compact(docs, id_col, text_col, source_col, seed), weights, share, epochs)
    # the caller's columns travel in one struct, so that no name of theirs meets one of the plan's
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    of = lambda c: F.col("__row").getField(c)
    both = _with_plan(_named(boxed, of(text_col).cast("string"), of(id_col).cast("long"), of(source_col), seed), plan)
    left = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    copies = both.withColumn("__taken", _taken(F.col("__size"), F.col("__u"))).filter("__taken > 0").withColumn("__copy", F.explode(F.expr("sequence(1, cast(ceil(__taken / __size) as int))")))
    head = F.array_join(F.slice(F.regexp_extract_all(of(text_col), F.lit(rf"([\x20\x09-\x0D]*{WORD})")), 1, left.cast("int")), "")
    text = F.when(left < F.col("__size"), head).otherwise(of(text_col)).alias(text_col)
    return copies.select(*(text if c == text_col else of(c).alias(c) for c in docs.columns), F.col("__copy").alias(copy_col))
