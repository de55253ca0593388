"""Text methods against plain versions: sparse k-means, isolation trees dealt differently, the bound of sequence similarity."""

import difflib
import hashlib

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import text


def test_sparse_kmeans_takes_lloyds_steps(spark):
    draw = np.random.default_rng(2)
    rows = [(i, " ".join(draw.choice(list("abcdefgh") if i % 2 else list("stuvwxyz"), 30)).replace(" ", " w")) for i in range(40)] + [(90, ""), (91, "single"), (1, "again")]
    docs = spark.createDataFrame(rows[:-1], "id long, text string")
    weights = text.tfidf(docs, "id", "text")
    got = {r.id: (r.cluster, r.distance) for r in text.sparse_kmeans(docs, weights, "id", 3, 5).collect()}
    terms = {t: j for j, t in enumerate(sorted({r.term for r in weights.collect()}))}
    x = {i: np.zeros(len(terms)) for i, _ in rows[:-1]}
    for r in weights.collect():
        x[r.id][terms[r.term]] = r.weight
    first = sorted((i for i in x if x[i].any()), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:3]
    cluster = {i: k for k, i in enumerate(first)}
    for _ in range(5):
        centres = {k: np.mean([x[i] for i in cluster if cluster[i] == k], axis=0) for k in set(cluster.values())}
        best = {i: min((round(float(((v - c) ** 2).sum()), 9), k) for k, c in centres.items()) for i, v in x.items()}
        cluster = {i: k for i, (_, k) in best.items()}
    assert {i: k for i, (k, _) in got.items()} == cluster
    assert all(abs(got[i][1] - best[i][0]) < 1e-8 for i in got)


def test_kmeans_query_ends_when_no_document_moves(spark, tmp_path):
    """Documents along a line of words need more steps than four; a document without an id or without terms ends it too."""
    import duckdb

    import __spark_entry__ as entry

    draw = np.random.default_rng(10)
    rows = [(i, " ".join(f"w{int(j):03d}" for j in np.clip(draw.normal(i / 2, 9, 25), 0, 120))) for i in range(200)] + [(900, ""), (None, "w001 w002")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.cluster, r.distance) for r in entry.queries()["t05_kmeans_clusters"](spark, str(tmp_path)).collect()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    weights = text.tfidf(docs, "doc_id", "text")
    few, many = ({r.doc_id: r.cluster for r in text.sparse_kmeans(docs, weights, "doc_id", 8, n).collect()} for n in (4, 40))
    assert len(got) == len(rows) and {i: k for i, (k, _) in got.items()} == many != few
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    assert len(con.execute(entry.oracle_sql()["t05_kmeans_clusters"]).fetchall()) == len(rows) - 1


def test_isolation_scores_do_not_depend_on_the_dealing(spark):
    draw = np.random.default_rng(1)
    rows = [(i, float(draw.normal()), float(draw.normal())) for i in range(300)] + [(1000, 40.0, -40.0), (1001, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    one, two = ({r.id: r.score for r in text.anomaly_scores(df.repartition(n), "id", ["a", "b"], trees=20, sample=16).collect()} for n in (1, 7))
    assert one == two and len(one) == 302 and min(one, key=one.get) == 1000
    assert {r.score for r in text.anomaly_scores(df.limit(4), "id", ["a", "b"]).collect()} == {0.0} and text.anomaly_scores(df.limit(0), "id", ["a", "b"]).collect() == []


def test_the_bound_loses_no_match(spark):
    labels = ["Actual Cots", "Net Prófit", "cash inn flow", "Wieght %", "Eqiupment hire", "zz", "x", "", "Gross proffit pct", "ACWP", "Total budgt", "mobilisation plan", "progress%"]
    df = spark.createDataFrame([(v,) for v in labels], "label string")
    got = {r.label: (r.metric, round(r.score, 9)) for r in text.lexicon_match(df).collect()}
    want = {}
    for label, n in df.select("label", text.normal_text("label")).collect():
        best = None
        for m, a in text.ALIASES if len(n) >= 2 else []:
            s = 1.0 if n == a else min(0.97, 0.72 + min(len(a), len(n)) / max(len(a), len(n)) * 0.22) if a in n or n in a else difflib.SequenceMatcher(None, n, a).ratio()
            if best is None or s > best[1] + 1e-12:
                best = (m, s)
        if best and best[1] >= 0.58:
            want[label] = (best[0], round(best[1], 9))
    assert got == want
    pairs = text.similarity_pairs(df).filter(F.col("native").isNull()).count()
    assert pairs < 0.1 * len(labels) * len(text.ALIASES)


def test_terms_of_single_rows_are_counted_without_a_shuffle(spark):
    from ledgerloom.operators.text import term_frequencies, term_statistics, tfidf

    rows = [(1, "aa bb aa bb"), (2, "aa"), (3, None), (4, ""), (5, "xx yy"), (5, "xx yy zz"), (None, "qq qq"), (None, "qq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.term): r.tf for r in term_frequencies(docs, "doc_id", "text").collect()}
    assert found == {(1, "aa"): 2, (1, "bb"): 2, (1, "aa bb"): 2, (1, "bb aa"): 1, (2, "aa"): 1, (5, "xx"): 2, (5, "yy"): 2, (5, "zz"): 1, (5, "xx yy"): 2, (5, "yy zz"): 1,
                     (None, "qq"): 3, (None, "qq qq"): 1}
    assert {r.term: (r.df, r.total) for r in term_statistics(docs, "doc_id", "text").collect()}["aa"] == (2, 3)
    named, numbered = tfidf(docs, "doc_id", "text").collect(), tfidf(docs, "doc_id", "text", numbered=True).collect()
    assert sorted((r.doc_id, round(r.weight, 9)) for r in named) == sorted((r.doc_id, round(r.weight, 9)) for r in numbered)
    assert {r.doc_id for r in named} == {1, 2, 5} and len({r.term for r in numbered}) == len({r.term for r in named})
    assert abs(sum(r.weight ** 2 for r in named if r.doc_id == 1) - 1) < 1e-9


def test_weights_shuffle_texts_and_answers_only(spark):
    """No exchange carries rows of a key and a term: only the blocks of texts and answers, and the one-row count of documents."""
    rows = [(1, "aa bb aa bb"), (2, "aa cc"), (3, None), (4, ""), (5, "xx yy"), (5, "xx yy zz"), (None, "qq qq aa"), (None, "qq"), (6, "one"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        weights = text.tfidf(docs, "doc_id", "text")
        plan = weights._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
    grams = {}
    for i, t in rows:
        words = (t or "").split()
        for g in words + [" ".join(p) for p in zip(words, words[1:])]:
            grams.setdefault(i, {}).setdefault(g, 0)
            grams[i][g] += 1
    df = {g: sum(g in own for own in grams.values()) for own in grams.values() for g in own}

    def weighed(terms):
        w = {(i, g): (np.log(n) + 1) * (np.log((len(rows) + 1) / (df[g] + 1)) + 1) for i, own in grams.items() for g, n in own.items() if i is not None and g in terms}
        return {(i, g): round(float(v / np.sqrt(sum(x * x for (j, _), x in w.items() if j == i))), 9) for (i, g), v in w.items()}

    assert {(r.doc_id, r.term): round(r.weight, 9) for r in weights.collect()} == weighed(df)
    few = text.tfidf(docs, "doc_id", "text", max_features=3).collect()
    assert {(r.doc_id, r.term): round(r.weight, 9) for r in few} == weighed({"aa", "qq", "aa bb"})


def test_slug_of_texts_beyond_ascii():
    import re
    import unicodedata

    import pandas as pd

    from ledgerloom.functions.text import _slug_nfkd

    texts = ["Ärger & ﬁne ①½ — ß x", "", "--abc DEF--9 ", "é̀ñ", "日本 Kﬀ…", "a\x00b\tc"]
    plain = [unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in texts]
    want = [re.sub("^-+|-+$", "", re.sub("[^A-Za-z0-9]+", "-", p)).lower() for p in plain]
    assert list(_slug_nfkd.func(pd.Series([*texts, None], dtype=object))) == [*want, None]
