"""Text, lexicon, embedding, profile and scenario analytics."""

from __future__ import annotations

import difflib
import hashlib
import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import ratio
from ledgerloom.functions.text import BLANKS
from ledgerloom.session import blocks_of, written

C = F.col
# Words left out of the recurring terms.
STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "from", "you", "your", "are", "was",
    "have", "has", "not", "can", "will", "but", "all", "only", "into", "make", "need",
    "create", "file", "report", "data", "same", "different", "inside", "also", "then",
]
TOKEN = "[A-Za-z][A-Za-z0-9_%-]{2,}"
# Metric vocabulary of the lexicon match.
LEXICON = {
    "contract_price": ["contract price", "contract value", "award value", "contract amount", "revised contract value"],
    "direct_budget": ["direct budget", "direct cost budget", "budget direct", "direct costs budget"],
    "indirect_budget": ["indirect budget", "indirect cost budget", "project overhead budget", "overheads budget"],
    "fees_budget": ["fees", "sponsorship", "fees and sponsorship", "commercial provisions", "deductions"],
    "total_budget": ["total budget", "project budget", "budget at completion", "bac", "total cost budget"],
    "earned_value": ["earned value", "ev", "budgeted cost of work performed", "bcwp"],
    "actual_cost": ["actual cost", "ac", "actual expense", "cost incurred", "acwp"],
    "cost_variance": ["cost variance", "cv", "variance cost"],
    "cpi": ["cpi", "cost performance index", "cost index"],
    "completion": ["completion", "completion %", "progress", "progress %", "physical progress"],
    "activity_weight": ["activity weight", "weight", "weight %", "wbs weight", "wp weight"],
    "revenue": ["revenue", "billed revenue", "unbilled revenue", "certified revenue", "sales"],
    "gross_profit": ["gross profit", "gp", "gross margin", "profit"],
    "gross_profit_pct": ["gross profit %", "gp %", "gross margin %", "margin %"],
    "cash_in": ["cash in", "cash inflow", "receipts", "collections"],
    "cash_out": ["cash out", "cash outflow", "payments", "disbursements"],
    "cash_flow": ["cash flow", "cumulative cash flow", "net cash"],
    "subcontractor_cost": ["subcontractor", "subcontract", "subcontractors cost"],
    "labor_cost": ["labor", "labour", "manpower cost", "labor cost"],
    "equipment_cost": ["equipment", "plant cost", "machinery cost"],
    "material_cost": ["material", "materials", "material cost"],
    "other_cost": ["other cost", "miscellaneous", "misc cost"],
    "soil_settlement": ["soil settlement", "settlement", "soil"],
    "wbs": ["wbs", "work breakdown structure", "control account", "work package"],
    "activity": ["activity", "activity id", "activity name", "task"],
    "cost_code": ["cost code", "cost element", "sap cost code", "gl account"],
    "status": ["status", "budget status", "signal", "performance status"],
}
# Keyword groups of the cluster fallback, in priority order.
CLUSTER_WORDS = [["dashboard", "summary", "overview"], ["cash", "revenue", "profit"], ["cost", "budget", "actual"]]


def normal_text(c: Column | str) -> Column:
    """Lower-case text with separators and punctuation as blanks."""
    c = C(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.trim(F.lower(c)), r"[_\-–—/\\|]+", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_%+. ]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


# Named entities decoded in page text; the ampersand comes last.
ENTITIES = [
    ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "\u00a9"), ("&reg;", "\u00ae"),
    ("&middot;", "\u00b7"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&hellip;", "\u2026"), ("&euro;", "\u20ac"), ("&amp;", "&"),
]
HIDDEN_TAGS = ["script", "style", "svg", "noscript"]
MARK = "\x01"


def visible_text(html: Column | str) -> Column:
    """Text nodes outside script, style, svg and noscript, one per line; entities decoded, blanks collapsed."""
    s = C(html) if isinstance(html, str) else html
    for tag in HIDDEN_TAGS:
        s = F.regexp_replace(s, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", MARK)
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", MARK)
    s = F.regexp_replace(s, r"<[^>]+>", MARK)
    for name, ch in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(ch))
    s = F.regexp_replace(s, BLANKS, " ")
    return F.regexp_replace(F.regexp_replace(s, rf" ?(?:{MARK} ?)+", "\n"), r"^[\n ]+|[\n ]+$", "")


def recurring_terms(texts: DataFrame, text: str, n: int | None = 80) -> DataFrame:
    """Most frequent terms without stop words; counted map-side before anything is shuffled."""
    terms = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)).alias("term"))
    counts = terms.filter(~C("term").isin(STOP_WORDS)).groupBy("term").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(n) if n else counts


@F.pandas_udf(T.DoubleType())
def _similarity(label: pd.Series, alias: pd.Series) -> pd.Series:
    """Sequence similarity of pairs; a label's matcher is made once for the aliases that follow each other."""
    matcher = difflib.SequenceMatcher(None)
    return pd.Series([matcher.set_seqs(n, a) or matcher.ratio() for n, a in zip(label, alias)], dtype=float)


ALIASES = [(m, a) for m, al in LEXICON.items() for a in al]
LETTERS = sorted({c for _, a in ALIASES for c in a})


def similarity_pairs(labels: DataFrame, threshold: float = 0.58) -> DataFrame:
    """(label, n, i, metric, alias, native): the pairs of labels and aliases that can decide: exact or containing ones with their score, and those
    without one whose bound reaches the threshold and the label's best native score.

    The bound is twice the characters that both have, over both lengths; no sequence similarity is higher.
    """
    counts = F.array(*[F.length("n") - F.length(F.replace(C("n"), F.lit(c), F.lit(""))) for c in LETTERS])
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("metric"), F.lit(a).alias("alias"), F.array(*[F.lit(a.count(c)) for c in LETTERS]).alias("letters")) for i, (m, a) in enumerate(ALIASES)])
    d = labels.select("label").distinct().withColumn("n", normal_text("label")).filter(F.length("n") >= 2).withColumn("counts", counts)
    n = F.length("n")

    def pair(x: Column) -> Column:
        size = F.length(x["alias"])
        share = F.least(F.lit(0.97), F.least(n, size) / F.greatest(n, size) * 0.22 + 0.72)
        native = F.when(C("n") == x["alias"], 1.0).when(C("n").contains(x["alias"]) | x["alias"].contains(C("n")), share)
        shared = F.aggregate(F.zip_with("counts", x["letters"], lambda p, q: F.least(p, q)), F.lit(0), lambda s, y: s + y)
        return F.struct(x["i"].alias("i"), x["metric"].alias("metric"), x["alias"].alias("alias"), native.alias("native"), (shared * 2.0 / (n + size)).alias("bound"))

    every = d.select("label", "n", F.transform(table, pair).alias("pairs"))
    best = every.withColumn("needed", F.greatest(F.lit(threshold), F.coalesce(F.array_max(F.transform("pairs", lambda x: x["native"])), F.lit(0.0))))
    kept = F.filter("pairs", lambda x: F.coalesce(x["native"], x["bound"]) >= F.when(x["native"].isNotNull(), 0.0).otherwise(C("needed") - 1e-12))
    return best.select("label", "n", F.inline(kept)).drop("bound")


def lexicon_match(labels: DataFrame, fuzzy: bool = True, threshold: float = 0.58) -> DataFrame:
    """Best metric of each distinct label: 1 for an equal alias, a share for a contained one, else sequence similarity; the first alias wins a tie.

    Python sees only pairs without a native score whose upper bound, from lengths and common characters, can still decide.
    """
    pairs = similarity_pairs(labels, threshold)
    if not fuzzy:
        scored = pairs.filter("native IS NOT NULL").withColumn("score", C("native")).withColumn("tier", F.lit("native"))
    else:
        # a UDF sees every row it is given, so the pairs with a native score go around it
        near = pairs.filter("native IS NULL").withColumn("score", _similarity("n", "alias")).withColumn("tier", F.lit("similar"))
        scored = pairs.filter("native IS NOT NULL").withColumn("score", C("native")).withColumn("tier", F.lit("native")).unionByName(near)
    best = scored.groupBy("label").agg(F.max_by(F.struct("metric", "score", "tier"), F.struct("score", -C("i"))).alias("b")).select("label", "b.*")
    return best.filter(C("score") >= threshold) if fuzzy else best


# ------------------------------------------------------------------ vectors


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): counts of the uni- and bi-grams of every key.

    A key that stands in one row has its grams sorted and counted inside the row, without a shuffle. Only rows that share a key (null is one)
    meet by key and term.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_%.\-]{2,})"), 1)
    grams = F.concat("t", F.when(F.size("t") > 1, F.zip_with(
        F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t")), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))
    repeated = written(docs.groupBy(C(key).alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key"), "repeated-keys")
    same = C(key).eqNullSafe(C("_key"))
    once, more = docs.select(key, text).join(repeated, same, "left_anti"), docs.select(key, text).join(repeated, same, "left_semi")
    once = once.select(key, tokens.alias("t")).select(key, F.sort_array(grams).alias("g")).filter(F.size("g") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: (i == 0) | (F.get("g", i) != F.get("g", i - 1)))
    once = once.select(key, "g", starts.alias("s"))
    runs = F.transform("s", lambda p, j: F.struct(F.get("g", p).alias("term"), (F.coalesce(F.get("s", j + 1), F.size("g")) - p).cast("long").alias("tf")))
    more = more.select(key, tokens.alias("t")).select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return once.select(key, F.inline(runs)).unionByName(more)


def _statistics(tf: DataFrame, max_features: int | None) -> DataFrame:
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if max_features is None:
        return stats
    return stats.orderBy(F.desc("total"), "term").limit(max_features)


def term_statistics(docs: DataFrame, key: str, text: str, max_features: int | None = None) -> DataFrame:
    """Document frequency and total count of uni- and bi-grams, of all or of a caller's number of the most frequent."""
    return _statistics(term_frequencies(docs, key, text), max_features)


def _grams(text: str) -> Column:
    """Uni- and bi-grams of a text, one by one; none for a text without tokens."""
    t = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_%.\-]{2,})"), 1)
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t)), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(t, F.coalesce(pairs, F.array().cast("array<string>")))


def tfidf(docs: DataFrame, key: str, text: str, max_features: int | None = None, numbered: bool = False) -> DataFrame:
    """Unit-length weights with logarithmic term frequency, as sparse (key, term, weight) rows.

    With ``numbered`` a term is a number of its own instead of its text, which makes every further shuffle of the rows smaller.

    Texts are dealt to blocks of keys. Each block asks once for each of its terms how many keys have it; the answers are written, without the terms
    of one key only, which a block knows by itself. Texts and answers then meet in their block, where grams are counted, weighed and
    normalised: no row of a key and a term is shuffled.
    """
    blocks = blocks_of(docs)
    own = docs.select(F.pmod(F.hash(C(key)), F.lit(blocks)).alias("_block"), C(key), C(text))
    grams = own.repartition(blocks, "_block").select("_block", key, F.explode(_grams(text)).alias("term"))
    counted = grams.groupBy("_block", key, "term").agg(F.count("*").alias("tf"))
    asked = counted.groupBy("_block", "term").agg(F.count("*").alias("k"), F.sum("tf").alias("total"))
    if max_features is None:
        term = W.partitionBy("term")
        told = asked.withColumn("id", F.monotonically_increasing_id()) if numbered else asked.withColumn("id", F.lit(None).cast("long"))
        told = told.select("_block", "term", F.sum("k").over(term).alias("df"), F.min("id").over(term).alias("number")).filter("df > 1")
    else:
        best = asked.groupBy("term").agg(F.sum("k").alias("df"), F.sum("total").alias("total")).orderBy(F.desc("total"), "term").limit(max_features)
        told = asked.select("_block", "term").join(best.select("term", "df", F.monotonically_increasing_id().alias("number")), "term")
    told = written(told.select("_block", "term", "df", "number"), "term-answers")
    answer = F.struct("term", "df", "number")
    none = F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("df"), F.lit(None).cast("long").alias("number"))
    met = own.select("_block", key, text, none.alias("_told")).unionByName(told.select(
        "_block", F.lit(None).cast(docs.schema[key].dataType).alias(key), F.lit(None).cast("string").alias(text), answer.alias("_told"))).repartition(blocks, "_block")
    told_term = C("_told.term")
    rows = met.select("_block", key, told_term.isNotNull().alias("_answer"), C("_told.df").alias("df"), C("_told.number").alias("number"),
                      F.explode(F.when(told_term.isNotNull(), F.array(told_term)).otherwise(_grams(text))).alias("term"))
    rows = rows.groupBy("_block", "_answer", key, "term").agg(F.count("*").alias("tf"), F.max("df").alias("df"), F.max("number").alias("number"))
    here = W.partitionBy("_block", "term")
    rows = rows.select("_block", "_answer", key, "term", "tf", F.max("df").over(here).alias("df"), F.max("number").over(here).alias("number")).filter("NOT _answer")
    if max_features is None:
        rows = rows.withColumn("df", F.coalesce("df", F.lit(1).cast("long")))
    name = F.coalesce("number", -1 - F.monotonically_increasing_id()) if numbered else C("term")
    idf = F.log((C("n_docs") + 1) / (C("df") + 1)) + 1
    w = rows.filter("df IS NOT NULL").join(docs.agg(F.count("*").alias("n_docs")), how="cross").select("_block", key, name.alias("term"), ((F.log("tf") + 1) * idf).alias("w"))
    norm = F.sqrt(F.sum(C("w") * C("w")).over(W.partitionBy("_block", key)))
    return w.filter(C(key).isNotNull()).select(key, "term", (C("w") / norm).alias("weight"))


def cluster_count(n: int) -> int:
    """k = max(1, min(8, round(sqrt(n)), n))."""
    return max(1, min(8, int(round(n ** 0.5)) if n > 1 else 1, n))


def kmeans_clusters(vectors: DataFrame, features: str, k: int, seed: int = 42) -> DataFrame:
    """Cluster of each row of dense vectors; the vectors column stays distributed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = vectors.withColumn("_v", array_to_vector(C(features).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", maxIter=20).fit(d)
    return model.transform(d).drop("_v")


def hash_order(*parts: Column | str) -> Column:
    """A seeded order that any engine repeats: hexadecimal MD5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def sparse_kmeans(docs: DataFrame, weights: DataFrame, key: str, k: int, iterations: int | None = None, seed: int = 42) -> DataFrame:
    """(key, cluster, distance) of every document by Lloyd's steps over sparse unit vectors (key, term, weight).

    Neither vocabulary nor centres reach the driver: centres are a table with one row a term and an array of k weights. The first centres are
    the k documents with terms that come first in a seeded order; a cluster that loses its documents keeps no centre. A document without terms
    goes to the centre nearest to zero. Distances are compared after rounding to nine places, the smaller number wins a tie. It ends when no
    document moves, or after a caller's number of ``iterations``.
    """
    weights = written(weights.select(key, "term", "weight"), "kmeans-weights")
    order = hash_order(str(seed), C(key))
    first = weights.select(key).distinct().orderBy(order, key).limit(k)
    assigned = written(first.select(key, (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order, key)) - 1).alias("cluster")), "kmeans-clusters")
    every = docs.select(key).distinct()
    for _ in itertools.count() if iterations is None else range(iterations):
        sizes = assigned.agg(*[F.count_if(C("cluster") == j).alias(f"n{j}") for j in range(k)])
        sums = weights.join(assigned, key).groupBy("term").agg(*[F.sum(F.when(C("cluster") == j, C("weight"))).alias(f"s{j}") for j in range(k)])
        mean = [F.coalesce(F.try_divide(C(f"s{j}"), C(f"n{j}")), F.lit(0.0)) for j in range(k)]
        centre = written(sums.join(sizes, how="cross").select("term", F.array(*mean).alias("c")), "kmeans-centres")
        # |x - c|^2 = |x|^2 - 2 x.c + |c|^2; clusters without documents have no distance
        norms = centre.agg(*[F.sum(C("c")[j] * C("c")[j]).alias(f"q{j}") for j in range(k)])
        dots = weights.join(centre, "term").groupBy(key).agg(F.sum(C("weight") * C("weight")).alias("x"), *[F.sum(C("weight") * C("c")[j]).alias(f"d{j}") for j in range(k)])
        zero = [F.coalesce(c, F.lit(0.0)) for c in ("x", *(f"d{j}" for j in range(k)))]
        distance = F.array(*[F.when(C(f"q{j}") > 0, F.struct((F.round(zero[0] - 2 * zero[j + 1] + C(f"q{j}"), 9) + 0.0).alias("distance"), F.lit(j).alias("cluster"))) for j in range(k)])
        best = F.array_min(F.filter(distance, lambda d: d.isNotNull()))
        new = written(every.join(dots, key, "left").join(norms, how="cross").select(key, best.alias("b")).select(key, "b.cluster", "b.distance"), "kmeans-clusters")
        old = assigned.select(C(key).alias("_key"), C("cluster").alias("old"))
        moved = new.join(old, C(key).eqNullSafe(C("_key")), "left").filter("old IS DISTINCT FROM cluster")
        assigned = new.select(key, "cluster")
        if moved.isEmpty():
            break
    return new


def standardise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the population deviation; a constant column is left as it is."""
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    j = rows.join(stats, how="cross")
    z = {c: F.when(C(f"_s_{c}") > 1e-12, (C(c) - C(f"_m_{c}")) / C(f"_s_{c}")).otherwise(C(c).cast("double")) for c in columns}
    return j.select(*[c for c in rows.columns if c not in columns], *[z[c].alias(c) for c in columns])


def _uniform_of(*parts) -> float:
    """A number in [0, 1) from the SHA-256 of the parts, the same in every engine."""
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) / float(1 << 48)


def isolation_draws(rows: DataFrame, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, x): up to ``sample`` rows for each tree, the same draw for every table size and every dealing of the rows.

    A pool keeps the first rows of each of ``trees`` hash groups, at most trees x sample rows; Spark keeps the first of each group in a task
    before the shuffle. Every tree then takes the first rows of the pool in an order of its own.
    """
    own = hash_order(str(seed), C(key))
    group = F.conv(F.substring(own, 1, 8), 16, 10).cast("long") % trees
    ranked = rows.select(key, "x", group.alias("group"), own.alias("u")).withColumn("rank", F.row_number().over(W.partitionBy("group").orderBy("u", key, "x")))
    pool = written(ranked.filter(C("rank") <= sample).select(key, "x"), "isolation-pool")
    dealt = pool.select(key, "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    order = W.partitionBy("tree").orderBy(hash_order(str(seed), C("tree"), C(key)), key, "x")
    return dealt.withColumn("rank", F.row_number().over(order)).filter(C("rank") <= sample).select("tree", "x")


TREE = "tree int, size int, i int, feature int, cut double, low int, high int, length double"


def isolation_forest(draws: DataFrame, seed: int) -> DataFrame:
    """The trees as a table of nodes; features and cuts follow from hashes of (seed, tree, node), a tree from the set of its rows."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x, tree = np.array(pdf["x"].tolist(), dtype=float), int(pdf["tree"].iloc[0])
        depth = int(np.ceil(np.log2(max(len(x), 2))))
        nodes: list[list] = []

        def build(rows: np.ndarray, node: int, level: int) -> int:
            me = len(nodes)
            nodes.append([tree, len(x), me, -1, 0.0, me, me, level + _path(len(rows))])
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
            if level < depth and len(rows) > 1 and len(spread):
                f = int(spread[int(_uniform_of(seed, tree, node, "feature") * len(spread))])
                lowest = float(rows[:, f].min())
                cut = lowest + _uniform_of(seed, tree, node, "cut") * (float(rows[:, f].max()) - lowest)
                nodes[me][3:5] = f, cut
                nodes[me][5] = build(rows[rows[:, f] <= cut], 2 * node, level + 1)
                nodes[me][6] = build(rows[rows[:, f] > cut], 2 * node + 1, level + 1)
            return me

        build(x, 1, 0)
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in TREE.split(", ")])

    return draws.groupBy("tree").applyInPandas(grow, TREE)


def anomaly_scores(rows: DataFrame, key: str, columns: list[str], trees: int = 50, sample: int = 256, seed: int = 42, least: int = 5) -> DataFrame:
    """Isolation score (0 centred, lower is more anomalous); a sample of fewer than ``least`` rows says nothing, all scores are then 0.

    The trees are a written table of at most trees x 2 x sample nodes; all of them meet every row as one joined record, and the walk from the
    root to a leaf is an expression. NULL counts as 0.
    """
    d = rows.select(key, F.array(*[F.coalesce(C(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"))
    nodes = written(isolation_forest(isolation_draws(d, key, trees, sample, seed), seed), "isolation-trees")
    one = nodes.groupBy("tree").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("i", "feature", "cut", "low", "high", "length"))).alias("nodes"))
    forest = written(one.agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("tree", "nodes"))).alias("trees")), "isolation-forest")
    levels = F.sequence(F.lit(1), F.lit(int(np.ceil(np.log2(max(sample, 2))))))

    def walk(tree):
        def step(i, _):
            n = F.get(tree["nodes"], i)
            return F.when(n["feature"] < 0, i).when(F.get("x", n["feature"]) <= n["cut"], n["low"]).otherwise(n["high"])

        return F.get(tree["nodes"], F.aggregate(levels, F.lit(0), step))["length"]

    total = F.aggregate(F.transform("trees", walk), F.lit(0.0), lambda a, b: a + b)
    n = C("size").cast("double")
    usual = F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(n - 1) + EULER) - 2 * (n - 1) / n)
    score = F.when(C("size") < least, 0.0).otherwise(F.round(0.5 - F.pow(F.lit(2.0), -total / F.size("trees") / usual), 6))
    return d.join(forest, how="cross").select(key, F.coalesce(score, F.lit(0.0)).alias("score"))


EULER = 0.5772156649015329


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def keyword_cluster(text: Column | str) -> Column:
    t = normal_text(text)
    out = F.lit(3)
    for i, words in reversed(list(enumerate(CLUSTER_WORDS))):
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, i).otherwise(out)
    return out


def family_scores(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """Best anchor of each unit vector by dot product, first anchor on ties.

    The anchors (one short vector per family) are folded into a single array column.
    """
    packed = anchors.agg(F.sort_array(F.collect_list(F.struct("family", "anchor"))).alias("a"))
    dot = F.transform("a", lambda x: F.struct(
        F.aggregate(F.zip_with("v", x["anchor"], lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y).alias("score"), (-x["family"]).alias("neg")))
    best = F.array_max(dot)
    return vectors.join(packed, how="cross").select("vec_id", best.alias("b")).select("vec_id", (-C("b.neg")).alias("family"), C("b.score").alias("score"))


def unit_vectors(rows: DataFrame, key: str, array: str) -> DataFrame:
    d = rows.select(key, F.transform(array, lambda x: x.cast("double")).alias("v"), *[c for c in rows.columns if c not in (key, array)])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return d.withColumn("_n", norm).withColumn("v", F.transform("v", lambda x: x / C("_n"))).drop("_n")


# ----------------------------------------------------------------- scenarios

# Perturbation size per similarity level.
MAGNITUDES = [(90, 0.06), (60, 0.12), (30, 0.20), (10, 0.30)]
# Cost elements, activities and quarters of a scenario with the bounds of their draws.
MIX = [("Subcontractors", 0.10, 0.35), ("Labor", 0.10, 0.28), ("Equipment", 0.05, 0.18), ("Materials", 0.15, 0.40), ("Other", 0.02, 0.12)]
ACTIVITIES = [
    "Mobilization & Preliminaries", "Earthworks", "Substructure", "Superstructure",
    "Architectural Works", "MEP Works", "External Works", "Testing & Handover",
]
QUARTERS = [("Q1", 0.10, 0.30, 0.12, 0.30), ("Q2", 0.18, 0.34, 0.20, 0.34), ("Q3", 0.22, 0.38, 0.22, 0.38), ("Q4", 0.12, 0.30, 0.12, 0.28)]


def _uniform(name: str, low, high) -> Column:
    """Counter-based draw in [low, high): 48 bits of the SHA-256 of project, similarity, seed and name."""
    digest = F.sha2(F.concat_ws(":", C("project"), C("similarity").cast("string"), C("seed").cast("string"), F.lit(name)), 256)
    u = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / float(1 << 48)
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return low + (high - low) * u


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def scenario_table(base: DataFrame, seeds: list[int]) -> DataFrame:
    """Perturbed scenarios per project, similarity level and seed; ratios and totals always reconcile.

    ``base`` has project, contract_price, direct_budget, indirect_budget, fees_budget, completion, cpi.
    """
    grid = F.array(*[F.struct(F.lit(s).alias("similarity"), F.lit(m).alias("mag"), F.lit(seed).alias("seed")) for s, m in MAGNITUDES for seed in seeds])
    d = base.select("*", F.inline(grid))
    m = C("mag")
    d = d.withColumn("contract", F.greatest(F.lit(1.0), C("contract_price") * (1 + _uniform("contract", -m, m))))
    direct = _clip(F.coalesce(C("direct_budget"), C("contract") * 0.72) / F.greatest("contract", F.lit(1.0)), 0.55, 0.90)
    indirect = _clip(F.coalesce(C("indirect_budget"), C("contract") * 0.12) / F.greatest("contract", F.lit(1.0)), 0.05, 0.25)
    fees = _clip(F.coalesce(C("fees_budget"), C("contract") * 0.03) / F.greatest("contract", F.lit(1.0)), 0.0, 0.12)
    progress = F.when(C("completion") > 1.5, C("completion") / 100).otherwise(C("completion"))
    d = d.select(
        "project", "similarity", "seed", "mag", "contract", "cpi",
        (C("contract") * direct * (1 + _uniform("direct", -m / 2, m / 2))).alias("direct_budget"),
        (C("contract") * indirect * (1 + _uniform("indirect", -m / 2, m / 2))).alias("indirect_budget"),
        (C("contract") * fees * (1 + _uniform("fees", -m / 2, m / 2))).alias("fees_budget"),
        _clip(F.coalesce(progress, F.lit(0.55)) + _uniform("progress", -0.12, 0.12), 0.08, 0.96).alias("completion"))
    ev = (C("direct_budget") + C("indirect_budget")) * C("completion")
    target = _clip(F.coalesce("cpi", F.lit(0.96)) + _uniform("cpi", -m, m), 0.72, 1.18)
    billing = _clip(_uniform("billing", -m, m) + 0.93, 0.72, 1.15)
    d = d.select("*", ev.alias("earned_value"), (ev / target).alias("actual_cost"), (C("contract") * C("completion") * billing).alias("revenue"))
    d = d.withColumn("gross_profit", C("revenue") - C("actual_cost") - C("fees_budget") * C("completion"))
    out = d.select(
        "project", "similarity", "seed", "contract", "direct_budget", "indirect_budget", "fees_budget",
        (C("direct_budget") + C("indirect_budget") + C("fees_budget")).alias("total_budget"), "completion", "earned_value", "actual_cost",
        (C("earned_value") - C("actual_cost")).alias("cost_variance"), ratio("earned_value", "actual_cost").alias("scenario_cpi"), "revenue", "gross_profit",
        ratio("gross_profit", "revenue").alias("gross_profit_pct"))
    return out


def _scaled(raw: list[Column], target: Column) -> list[Column]:
    """Parts of one scenario scaled so that they sum to the target."""
    total = reduce(lambda x, y: x + y, raw)
    return [r / total * target for r in raw]


def scenario_parts(s: DataFrame) -> DataFrame:
    """Cost mix, activities and quarterly cash of every scenario, each scaled to its total. The parts of a scenario stay in its row until the end."""
    keys = ["project", "similarity", "seed"]
    none = F.lit(None).cast("double")

    def listed(df: DataFrame, kind: str, names: list[str], amount: list, second: list | None = None, budget: list | None = None) -> DataFrame:
        rows = [F.struct(F.lit(n).alias("part"), amount[i].alias("amount"), (second[i] if second else none).alias("second"), (budget[i] if budget else none).alias("budget")) for i, n in enumerate(names)]
        return df.select(*keys, F.lit(kind).alias("kind"), F.inline(F.array(*rows)))

    def named(prefix: str, names: list) -> list[Column]:
        return [C(f"{prefix}{i}") for i in range(len(names))]

    mix = s.select(*keys, "actual_cost", *[_uniform(f"mix-{n}", lo, hi).alias(f"r{i}") for i, (n, lo, hi) in enumerate(MIX)])
    mix = listed(mix, "cost_mix", [m[0] for m in MIX], _scaled(named("r", MIX), C("actual_cost")))

    share = C("direct_budget") / F.greatest(C("direct_budget") + C("indirect_budget"), F.lit(1.0))
    act = s.select(*keys, "direct_budget", "completion", "scenario_cpi", (C("earned_value") * share).alias("ev_target"), (C("actual_cost") * share).alias("ac_target"),
                   *[_uniform(f"{x}-{a}", lo, hi).alias(f"{x}{i}") for i, a in enumerate(ACTIVITIES) for x, lo, hi in (("w", 0.7, 1.4), ("p", -0.2, 0.2), ("c", -0.16, 0.16))])
    act = act.select("*", *[x.alias(f"b{i}") for i, x in enumerate(_scaled(named("w", ACTIVITIES), C("direct_budget")))])
    act = act.select("*", *[(C(f"b{i}") * _clip(C("completion") + C(f"p{i}"), 0.0, 1.0)).alias(f"e{i}") for i in range(len(ACTIVITIES))])
    act = act.select("*", *[(C(f"e{i}") / _clip(C("scenario_cpi") + C(f"c{i}"), 0.65, 1.25)).alias(f"a{i}") for i in range(len(ACTIVITIES))])
    act = listed(act, "activity", ACTIVITIES, _scaled(named("e", ACTIVITIES), C("ev_target")), _scaled(named("a", ACTIVITIES), C("ac_target")), named("b", ACTIVITIES))

    cash = s.select(*keys, "revenue", "actual_cost", *[_uniform(f"in-{q}", lo, hi).alias(f"i{k}") for k, (q, lo, hi, _, _) in enumerate(QUARTERS)],
                    *[_uniform(f"out-{q}", lo, hi).alias(f"o{k}") for k, (q, _, _, lo, hi) in enumerate(QUARTERS)])
    cash = listed(cash, "cash", [q[0] for q in QUARTERS], _scaled(named("i", QUARTERS), C("revenue")), _scaled(named("o", QUARTERS), C("actual_cost")))
    return mix.unionByName(act).unionByName(cash)


def validate_scenarios(s: DataFrame, parts: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Eight reconciliation checks; the errors array is empty for a coherent scenario."""
    keys = ["project", "similarity", "seed"]
    p = parts.groupBy(*keys).agg(
        F.sum(F.when(C("kind") == "cost_mix", C("amount"))).alias("mix"), F.sum(F.when(C("kind") == "cash", C("amount"))).alias("cin"),
        F.sum(F.when(C("kind") == "cash", C("second"))).alias("cout"), F.sum(F.when(C("kind") == "activity", C("budget"))).alias("act"))
    j = s.join(p, keys)

    def off(a: Column, b: Column) -> Column:
        bound = F.greatest(F.lit(tolerance), F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * 1e-6)
        return F.abs(a - b) > bound

    checks = {
        "total_budget": off(C("total_budget"), C("direct_budget") + C("indirect_budget") + C("fees_budget")),
        "cost_variance": off(C("cost_variance"), C("earned_value") - C("actual_cost")),
        "cpi": (C("actual_cost") != 0) & off(C("scenario_cpi"), C("earned_value") / C("actual_cost")),
        "gross_profit_pct": (C("revenue") != 0) & off(C("gross_profit_pct"), C("gross_profit") / C("revenue")),
        "cost_mix": off(C("mix"), C("actual_cost")), "cash_in": off(C("cin"), C("revenue")), "cash_out": off(C("cout"), C("actual_cost")),
        "activity_budget": off(C("act"), C("direct_budget")),
    }
    errors = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return j.select(*keys, errors.alias("errors"))


