"""License scan by a positional index of licence words, DataFrame functions only.

Each text keeps the places of its licence words. The index holds, for every template, the place of each of its licence words; the
words are weighted by their inverse document frequency over all documents. A place stands for the start that the template would then
have, and starts fall into regions of ``REGION`` words that overlap by half. In each region a text looks up, of each template, the
``RARE`` words of the highest weight among those it holds there, so neither other licences of the file nor prose far away displace
them. Postings meet by relative position: each looked-up word votes with its weight for its starts. A template is named when the
votes for one start reach ``SHARE`` of the looked-up weight, come from three different words or more, and all its mandatory key
phrases stand within ``SLACK`` words of where that start puts them. Base phrases name their label wherever their words stand
consecutively; they use the same index, with every word mandatory.

Null and empty texts have no words, no labels and score 0. Repeated rows and null ids are answered each: a row is known by its id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import texts, words, written

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The sentence that tells a licence, and the key phrases that must stand in it.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
            ("hereby granted free", "without restriction")),
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version",)),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
            ("gnu general public license", "free software foundation")),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("binary forms", "following conditions")),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("source code form", "mozilla public license")),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("hereby granted",)),
    "cc": ("this work is licensed under a creative commons attribution international license", ("creative commons attribution",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
}
#: Template words too common in any text to index.
COMMON = set("a and any are as by can for in is it met of or the this to under use with you not may v be at 0 2 work form file".split())
SHARE, SLACK, VOTERS = 0.5, 8, 3
REGION, RARE = 64, 8


def vocabulary() -> list[str]:
    """Licence words: those of the templates that are not common, and all words of the phrases."""
    told = {w for sentence, _ in TEMPLATES.values() for w in sentence.split()} - COMMON
    return sorted(told | {w for p in [*BASE, *(p for _, keys in TEMPLATES.values() for p in keys)] for w in p.split()})


def _postings(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The index, of templates (label, word, at) and of phrases (label, phrase, base, word, at, length, off: where it stands in the template)."""
    listed = set(vocabulary())
    templates = [(label, w, i) for label, (sentence, _) in TEMPLATES.items() for i, w in enumerate(sentence.split()) if w in listed]
    phrases = [(label, p, True, w, i, len(p.split()), 0) for p, label in BASE.items() for i, w in enumerate(p.split())]
    for label, (sentence, keys) in TEMPLATES.items():
        for p in keys:
            off = len(sentence[: f" {sentence} ".index(f" {p} ")].split())
            phrases += [(label, p, False, w, i, len(p.split()), off) for i, w in enumerate(p.split())]
    return (spark.createDataFrame(templates, "label string, word string, at int"),
            spark.createDataFrame(phrases, "label string, phrase string, base boolean, word string, at int, length int, off int"))


def licence_places(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_words, places array<struct<pos int, word string>>: where each text has licence words."""
    listed = vocabulary()
    cut = docs.select("doc_id", "h", words(F.col("text")).alias("w"))
    at = F.filter(F.transform("w", lambda w, i: F.when(w.isin(listed), i)), lambda i: i.isNotNull())
    found = cut.select("doc_id", "h", F.size("w").cast("long").alias("n_words"), "w", at.alias("at"))
    return found.select("doc_id", "h", "n_words", F.transform("at", lambda i: F.struct(i.alias("pos"), F.element_at("w", i + 1).alias("word"))).alias("places"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted), score: one row for each row of ``docs``."""
    docs = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    template, phrase = _postings(docs.sparkSession)
    held = written(licence_places(docs), "licence-places")
    rows = held.select("doc_id", "h", "places").filter(F.size("places") > 0).dropDuplicates(["doc_id", "h"])
    places = rows.select("doc_id", "h", F.explode("places").alias("x")).select("doc_id", "h", "x.pos", "x.word")
    row = ["doc_id", "h"]

    # phrases whose words stand consecutively
    stands = places.join(F.broadcast(phrase), "word").groupBy(*row, "label", "phrase", "base", "length", "off", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("n")).filter("n = length")
    stands = written(stands.select(*row, "label", "phrase", "base", "off", "start"), "phrases")

    # votes of the words of each template
    per_row = rows.select(*row, F.explode(F.array_distinct(F.transform("places", lambda x: x.word))).alias("word"))
    total = F.broadcast(held.agg(F.count("*").alias("docs")))
    idf = written(per_row.groupBy("word").agg(F.count("*").alias("df")).crossJoin(total).select("word", F.log((F.col("docs") + 1) / F.col("df")).alias("idf")), "idf")
    names = lambda df: df.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), *[c for c in df.columns if c not in row])
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g"))
    start = F.col("pos") - F.col("at")
    regions = F.array(F.floor(start / REGION) * 2, F.floor((start + REGION // 2) / REGION) * 2 + 1)
    # a region holds the words of one template at REGION starts at most, so its sets are bounded
    looked = places.join(F.broadcast(idf), "word").join(F.broadcast(template), "word").select(*row, "label", "word", "idf", start.alias("start"), F.explode(regions).alias("region"))
    looked = looked.groupBy(*row, "label", "region").agg(F.collect_set(F.struct("idf", "word")).alias("held"), F.collect_set(F.struct("start", "idf", "word")).alias("at")).filter(F.size("held") >= VOTERS)
    looked = looked.withColumn("held", F.slice(F.sort_array("held", asc=False), 1, RARE))
    reachable = F.aggregate("held", F.lit(0.0), lambda x, w: x + w.idf)
    voting = looked.select(*row, "label", "region", reachable.alias("reachable"), F.explode(F.filter("at", lambda v: F.exists("held", lambda w: w.word == v.word))).alias("v"))
    votes = voting.groupBy(*row, "label", "region", "reachable", F.col("v.start").alias("start")).agg(F.sum("v.idf").alias("votes"), F.count("*").alias("voters"))
    share = F.round(F.col("votes") / F.col("reachable"), 9)
    votes = votes.filter(F.col("voters") >= VOTERS).withColumn("share", share).filter(F.col("share") >= SHARE).groupBy(*row, "label", "start").agg(F.max("share").alias("share"))
    keys = phrase.filter("not base").groupBy("label").agg(F.count_distinct("phrase").alias("wanted"))
    near = names(stands.filter("not base").withColumnRenamed("start", "stood").withColumnRenamed("label", "l"))
    checked = votes.join(near, same & (F.col("label") == F.col("l")) & (F.abs(F.col("stood") - F.col("off") - F.col("start")) <= SLACK)).groupBy(*row, "label", "start", "share").agg(F.count_distinct("phrase").alias("have"))
    told = checked.join(F.broadcast(keys), "label").filter("have = wanted").groupBy(*row, "label").agg(F.max("share").alias("share"))

    based = stands.filter("base").groupBy(*row).agg(F.count("*").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"), F.sort_array(F.collect_set("label")).alias("base_labels"))
    added = told.groupBy(*row).agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    both = held.select(*row, "n_words").join(names(based), same, "left").drop("d", "g").join(names(added), same, "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(F.coalesce("base_labels", none), F.coalesce("more", none)))
    score = F.when(F.size(labels) == 0, F.lit(0.0)).otherwise(0.5 + 0.5 * F.coalesce("share", F.lit(0.0)))
    return both.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), labels.alias("labels"), score.alias("score"))
