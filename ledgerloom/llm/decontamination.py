"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with document words, DataFrame functions only.

A window is ``size`` consecutive words of an item (an item of fewer words, but not none, is one window). To contain it, a text
must contain all its shingles, so one of them is a sufficient prefix: the rarest. Shingles are ordered by the corpus count of
their rarest word, which bounds their own count. Document positions that hold such a word (the anchor) form the shingle
around it; the shingle joins the windows it stands for; position and length bounds leave windows that fit into the text;
the words of the window are compared one by one. Words covered by any occurrence are hits.

Benchmark words and prefixes are broadcast only while their written size is below spark.sql.autoBroadcastJoinThreshold, else joined
by shuffle. Null and empty texts have no words and no windows. Null ids and repeated rows are answered like others; a
row is known by its id and text. Empty tables give empty results, or documents without hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import texts, words, written
from ledgerloom.session import broadcast_if_small

SHINGLE = 5


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, window: the distinct windows of each item."""
    cut = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    return cut.select("item_id", "w", starts.alias("i")).select("item_id", F.slice("w", F.col("i"), size).alias("window")).distinct()


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, n: how often each word of the vocabulary stands in the documents."""
    found = docs.select(F.explode(words(F.col("text"))).alias("word")).join(broadcast_if_small(vocabulary, vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    return vocabulary.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """For each distinct window its rarest shingle: window, shingle, offset (of the shingle in it), anchor, at (of the anchor in the shingle)."""
    distinct = windows.select("window").distinct()
    rated = distinct.select("window", F.posexplode("window").alias("i", "word")).join(counts, "word").groupBy("window").agg(F.sort_array(F.collect_list(F.struct("i", "n", "word"))).alias("rated"))
    width = F.least(F.size("window"), F.lit(SHINGLE))
    each = rated.select("window", "rated", width.alias("k"), F.explode(F.sequence(F.lit(0), F.size("window") - width)).alias("offset"))
    part = F.slice("rated", F.col("offset") + 1, F.col("k"))
    least = F.array_min(F.transform(part, lambda x: F.struct(x.n.alias("n"), x.i.alias("i"), x.word.alias("word"))))
    each = each.select("window", "offset", "k", least.alias("anchor"))
    best = each.groupBy("window").agg(F.min(F.struct(F.col("anchor.n").alias("n"), "offset", "k", F.col("anchor.i").alias("i"), F.col("anchor.word").alias("word"))).alias("b"))
    return best.select("window", F.array_join(F.slice("window", F.col("b.offset") + 1, F.col("b.k")), " ").alias("shingle"), F.col("b.offset").alias("offset"), F.col("b.k").alias("k"),
                       F.col("b.word").alias("anchor"), (F.col("b.i") - F.col("b.offset")).alias("at"))


def occurrences(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """doc_id, h, start, length, window: every place where a window stands in a document."""
    anchors = written(prefix.select("anchor", "at", "k").distinct(), "anchors")
    placed = docs.select("doc_id", "h", words(F.col("text")).alias("w")).select("doc_id", "h", "w", F.posexplode("w").alias("pos", "anchor"))
    near = placed.join(broadcast_if_small(anchors, anchors), "anchor").filter((F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("k") <= F.size("w")))
    near = near.select("doc_id", "h", "w", (F.col("pos") - F.col("at")).alias("from"), F.array_join(F.slice("w", F.greatest(F.col("pos") - F.col("at"), F.lit(0)) + 1, F.col("k")), " ").alias("shingle"))
    met = near.join(broadcast_if_small(prefix, prefix), "shingle").withColumn("start", F.col("from") - F.col("offset")).withColumn("length", F.size("window"))
    fits = met.filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.size("w")))
    return fits.filter(F.slice("w", F.greatest("start", F.lit(0)) + 1, F.col("length")) == F.col("window")).select("doc_id", "h", "start", "length", "window").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted strings), contaminated: one row for each row of ``docs``."""
    docs = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    windows = written(item_windows(items, size), "windows")
    vocabulary = written(windows.select(F.explode("window").alias("word")).distinct(), "vocabulary")
    counts = written(word_counts(docs, vocabulary), "word-counts")
    prefix = written(prefixes(windows, counts), "prefixes")
    hits = written(occurrences(docs, prefix), "occurrences")

    row = ["doc_id", "h"]
    before = F.max(F.col("start") + F.col("length")).over(W.partitionBy(*row).orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1))
    covered = hits.select(*row, "start", "length").distinct().withColumn("before", before)
    n_hit = covered.groupBy(*row).agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", F.coalesce("before", "start")))).alias("n_hit"))
    of_items = hits.select(*row, "window").distinct().join(broadcast_if_small(windows, windows), "window").groupBy(*row).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    named = lambda df, c: df.select(F.col("doc_id").alias("id_" + c), F.col("h").alias("h_" + c), c)
    same = lambda c: F.col("doc_id").eqNullSafe(F.col("id_" + c)) & (F.col("h").eqNullSafe(F.col("h_" + c)))
    both = docs.select(*row, F.size(words(F.col("text"))).cast("long").alias("n_words")).join(named(n_hit, "n_hit"), same("n_hit"), "left").join(named(of_items, "items"), same("items"), "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return both.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
