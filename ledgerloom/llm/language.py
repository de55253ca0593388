"""Language of web pages by fusing evidence with Bayes' rule.

Evidence: the likelihood of the visible text (three-byte groups, counted over all labelled documents), the language that the markup declares, the
suffix of the address, and a prior of the host. Text alone gives first posteriors; grouped sums of these give how often each language
declares what and uses which suffix, and the host priors, smoothed in levels: a host towards its domain, a domain towards its suffix, a
suffix towards all pages. A page's own share is taken out of its host's counts, so that it is no evidence for itself.

Null pages have no text and declare nothing; a null address has the host "". Ties go to the alphabetically first language. Without labelled
documents there are no languages and the answer is null. Repeated rows are answered each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch_of, slices, written

BUCKETS, FAN = 1 << 14, 8
#: The share of the text's log-likelihood that counts (its groups overlap), the weight of a parent level in rows, the add-one weight of the tables.
TEMPER, PARENT, ADD = 0.05, 5.0, 1.0
OPENED = re.compile(r"<(?:!--|(script|style|noscript|template)\b)", re.I)
CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")}
TAG = re.compile(r"<[^>]*>")
HTML, LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def buckets(text: str) -> np.ndarray:
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.uint32)
    return ((data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(18)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and, for each, the log-probability of each bucket; counts of tasks are merged in a tree."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    schema = pa.schema([("lang", pa.string()), ("n", pa.binary())])

    def tell(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
        return batch_of(schema, list(counts), [c.tobytes() for c in counts.values()])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            parts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(lang, []).append(buckets(text or ""))
            for lang, found in parts.items():
                counts[lang] = counts.get(lang, 0) + np.bincount(np.concatenate(found), minlength=BUCKETS)
        yield tell(counts)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, 16):
            for lang, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[lang] = counts.get(lang, 0) + np.frombuffer(n, np.int64)
        yield tell(counts)

    total: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(count, "lang string, n binary").repartition(FAN).mapInArrow(merge, "lang string, n binary").toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(bytes(r["n"]), np.int64)
    langs = sorted(total)
    return langs, np.array([np.log((total[x] + 0.5) / (total[x].sum() + 0.5 * BUCKETS)) for x in langs]).reshape(len(langs), BUCKETS)


def visible(html: str) -> str:
    """The text outside tags, comments and elements that aren't shown; one that is never closed runs to the end. Each place is passed once."""
    shown, at = [], 0
    while m := OPENED.search(html, at):
        shown.append(html[at : m.start()])
        closed = CLOSED[m[1].lower()].search(html, m.end()) if m[1] else None
        end = closed.end() if closed else html.find("-->", m.end()) + 3 if not m[1] else 2
        at = end if end > 2 else len(html)
    text = " ".join([*shown, html[at:]])
    last = text.rfind(">") + 1  # behind it no tag is closed
    return TAG.sub(" ", text[:last]) + text[last:]


def declared_language(html: str) -> str | None:
    """The language that the first html tag with one declares."""
    at = 0
    while m := HTML.search(html, at):
        end = html.find(">", m.end())
        at = len(html) if end < 0 else end
        if told := LANG.search(html[m.end() : at]):
            return told[1].lower()
    return None


def text_evidence(pages: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, url, declared, logl: the log-likelihoods of the visible text, one for each language, less their largest."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("declared", pa.string()), ("logl", pa.list_(pa.float64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            declared, found = [], []
            for html in batch.column(2).to_pylist():
                declared.append(declared_language(html or ""))
                at, n = np.unique(buckets(visible(html or "")), return_counts=True)
                x = logs[:, at] @ n if len(at) else np.zeros(len(langs))
                found.append((x - x.max()).tolist())
            yield batch_of(schema, batch.column(0), batch.column(1), declared, found)

    return pages.mapInArrow(run, "page_id long, url string, declared string, logl array<double>")


def softmax(x: Column) -> Column:
    """Probabilities of log-weights; the largest is taken off first."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(k: int) -> list[Column]:
    return [F.array(*[F.sum(F.element_at("first", i + 1)) for i in range(k)]).alias("mass")]


def _table(df: DataFrame, key: str, k: int) -> DataFrame:
    """For each value of ``key`` its log-probability given each language: rows (key, log_<key>), as many as there are values."""
    mass = df.groupBy(key).agg(*_sums(k))
    all_ = df.agg(*_sums(k)).select(F.col("mass").alias("total"))
    values = mass.agg(F.count("*").alias("values"))
    fused = mass.crossJoin(F.broadcast(all_)).crossJoin(F.broadcast(values))
    return fused.select(key, F.zip_with("mass", "total", lambda m, t: F.log((m + ADD) / (t + ADD * F.col("values")))).alias(f"log_{key}"))


def detect(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang, posterior: one row for each row of ``pages``."""
    langs, logs = train(docs)
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    if not langs:
        none = F.lit(None).cast("string")
        return plain.select("page_id", none.alias("host"), none.alias("suffix"), none.alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("posterior"))
    k = len(langs)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    found = text_evidence(plain, langs, logs).withColumn("host", host)
    found = found.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("domain", F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, 2), ".")).withColumn("declared", F.coalesce("declared", F.lit("")))
    found = written(found.withColumn("first", softmax(F.transform("logl", lambda v: v * TEMPER))), "page-evidence")

    top = written(found.agg(*_sums(k)).select(F.transform("mass", lambda m: (m + ADD) / (F.aggregate("mass", F.lit(0.0), lambda a, b: a + b) + ADD * k)).alias("of_all")), "level-all")
    smooth = lambda mass, up: F.transform(F.arrays_zip(mass.alias("m"), up.alias("p")), lambda x: (x.m + PARENT * x.p) / (F.aggregate(mass, F.lit(0.0), lambda a, b: a + b) + PARENT))
    suffix = found.groupBy("suffix").agg(*_sums(k)).crossJoin(F.broadcast(top))
    suffix = suffix.select("suffix", smooth(F.col("mass"), F.col("of_all")).alias("of_suffix"))
    domain = found.groupBy("suffix", "domain").agg(*_sums(k)).join(suffix, "suffix").select("domain", smooth(F.col("mass"), F.col("of_suffix")).alias("of_domain"))
    hosts = written(found.groupBy("domain", "host").agg(*_sums(k)).join(domain, "domain").select("host", F.col("mass").alias("host_mass"), "of_domain"), "level-host")
    declared, suffixes = written(_table(found, "declared", k), "declared"), written(_table(found, "suffix", k), "suffixes")

    joined = found.join(hosts, "host").join(declared, "declared").join(suffixes, "suffix")
    rest = F.zip_with("host_mass", "first", lambda m, f: F.greatest(m - f, F.lit(0.0)))
    prior = smooth(rest, F.col("of_domain"))
    fused = joined.withColumn("prior", prior).withColumn("fused", F.transform(F.arrays_zip("prior", "logl", "log_declared", "log_suffix"), lambda x: F.log(x.prior) + TEMPER * x.logl + x.log_declared + x.log_suffix))
    names = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    done = fused.withColumn("p", softmax(F.col("fused")))
    return done.select("page_id", "host", "suffix", F.nullif("declared", F.lit("")).alias("declared"), best(F.col("logl")).alias("text_lang"), best(F.col("p")).alias("lang"), F.array_max("p").alias("posterior"))
