"""Deterministic assessment rules, risk report, clusters and lineage.

Rules are column expressions over named metrics, so any number of descriptors is
assessed in one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import ratio

# Default thresholds.
DEFAULT_POLICY: dict[str, float] = {
    "cpi_favorable": 1.0,
    "cpi_caution": 0.95,
    "cv_caution_pct": -5.0,
    "vac_caution_pct": -5.0,
    "margin_target_pct": 0.0,
    "cash_deficit_caution_pct": 5.0,
    "cash_deficit_critical_pct": 15.0,
    "waste_caution_points": 1.0,
    "waste_critical_points": 3.0,
    "reconciliation_caution_pct": 1.0,
    "reconciliation_critical_pct": 5.0,
    "concentration_caution_pct": 25.0,
    "concentration_critical_pct": 40.0,
    "minimum_trend_periods": 3.0,
    "trend_r_squared_caution_floor": 0.5,
    "trend_anomaly_caution_z": 2.0,
    "trend_anomaly_critical_z": 3.0,
}
# Severity order of results.
STATUS_ORDER = ["critical", "caution", "mixed", "favorable", "informational", "unavailable"]
Policy = dict[str, float]


def status_rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), c)


def _graded(unavailable: Column, critical: Column, caution: Column) -> Column:
    """Guard first, then the worst matching grade; a NULL comparison never matches."""
    return (
        F.when(unavailable, "unavailable").when(critical, "critical").when(caution, "caution").otherwise("favorable")
    )


def valid_policy(c: dict[str, Column]) -> Column:
    """True when all 17 thresholds are numbers in a consistent order."""
    present = F.lit(True)
    for k in DEFAULT_POLICY:
        present = present & c[k].isNotNull() & ~F.isnan(c[k])
    ordered = (
        (c["cpi_caution"] <= c["cpi_favorable"])
        & (c["reconciliation_caution_pct"] <= c["reconciliation_critical_pct"])
        & (c["cash_deficit_caution_pct"] <= c["cash_deficit_critical_pct"])
        & (c["concentration_caution_pct"] <= c["concentration_critical_pct"])
        & (c["waste_caution_points"] <= c["waste_critical_points"])
        & (c["minimum_trend_periods"] >= 2)
        & c["trend_r_squared_caution_floor"].between(0, 1)
        & (c["trend_anomaly_caution_z"] > 0)
        & (c["trend_anomaly_caution_z"] <= c["trend_anomaly_critical_z"])
    )
    return present & F.coalesce(ordered, F.lit(False))


def policies_from_answers(answers: DataFrame) -> DataFrame:
    """Six management answers to a full policy; out-of-range answers give status 'rejected'."""
    a = {c: F.col(c) for c in (
        "cpi_critical", "adverse_variance_pct", "minimum_margin_pct", "cash_deficit_pct", "concentration_pct", "reconciliation_pct")}
    p = DEFAULT_POLICY
    ok = (
        (a["cpi_critical"] > 0) & (a["cpi_critical"] <= p["cpi_favorable"])
        & a["adverse_variance_pct"].between(0, 100)
        & a["minimum_margin_pct"].between(-100, 100)
        & a["cash_deficit_pct"].between(p["cash_deficit_caution_pct"], 100)
        & a["concentration_pct"].between(p["concentration_caution_pct"], 100)
        & a["reconciliation_pct"].between(p["reconciliation_caution_pct"], 100)
    )
    cols = {k: F.lit(v) for k, v in p.items()}
    cols.update(
        cpi_caution=a["cpi_critical"], cv_caution_pct=-F.abs(a["adverse_variance_pct"]),
        vac_caution_pct=-F.abs(a["adverse_variance_pct"]), margin_target_pct=a["minimum_margin_pct"],
        cash_deficit_critical_pct=a["cash_deficit_pct"], concentration_critical_pct=a["concentration_pct"],
        reconciliation_critical_pct=a["reconciliation_pct"],
    )
    accepted = F.coalesce(ok, F.lit(False)) & valid_policy(cols)
    return answers.select(
        "*", F.when(accepted, "accepted").otherwise("rejected").alias("status"),
        *[F.when(accepted, cols[k]).alias(k) for k in ("cpi_caution", "cv_caution_pct", "margin_target_pct", "cash_deficit_critical_pct")],
    )


# ------------------------------------------------------------------- rules


def cost_performance(ev, ac, cpi, cv, p: Policy = DEFAULT_POLICY) -> Column:
    cpi = F.coalesce(cpi, ratio(ev, ac))
    cv = F.coalesce(cv, ev - ac)
    pct = F.when(ev != 0, cv / F.abs(ev) * 100)
    return _graded(
        ((ev == 0) & (ac == 0)) | (cpi.isNull() & cv.isNull()),
        (cpi < p["cpi_caution"]) | (pct < p["cv_caution_pct"]),
        (cpi < p["cpi_favorable"]) | (pct < 0),
    )


def profitability_methods(methods: Column, losses: Column, misses: Column) -> Column:
    """All methods count: a loss or a missed target in some of them is 'mixed'."""
    none = methods.isNull() | (methods == 0)
    return (
        F.when(none, "unavailable")
        .when(losses == methods, "critical").when(losses > 0, "mixed")
        .when(misses == methods, "caution").when(misses > 0, "mixed").otherwise("favorable")
    )


def method_counts(methods: DataFrame, p: Policy = DEFAULT_POLICY) -> DataFrame:
    """Usable methods, losses and target misses per project; a missing margin is a miss."""
    usable = F.col("profit").isNotNull() | F.col("profit_pct").isNotNull()
    return methods.filter(usable).groupBy("project").agg(
        F.count("*").alias("methods"),
        F.count_if((F.col("profit") < 0) | (F.col("profit_pct") < 0)).alias("losses"),
        F.count_if(F.col("profit_pct").isNull() | (F.col("profit_pct") * 100 < p["margin_target_pct"])).alias("misses"),
    )


def profitability(profit, margin, p: Policy = DEFAULT_POLICY) -> Column:
    pct = margin * 100
    return _graded(
        profit.isNull() & margin.isNull(), (profit < 0) | (pct < 0), pct.isNull() | (pct < p["margin_target_pct"])
    )


def deficit_pct(net, cash_in, cash_out) -> Column:
    """Deficit as % of cash-in; 100 when cash went out and none came in."""
    share = F.when(cash_in != 0, F.abs(net) / F.abs(cash_in) * 100).when(cash_out > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return F.when(net < 0, share).otherwise(F.lit(0.0))


def cash(cash_in, cash_out, net, negative_periods, p: Policy = DEFAULT_POLICY) -> Column:
    return _graded(
        (net.isNull() & cash_in.isNull() & cash_out.isNull()) | ((cash_in == 0) & (cash_out == 0) & (net == 0)),
        deficit_pct(net, cash_in, cash_out) >= p["cash_deficit_critical_pct"],
        (net < 0) | (negative_periods > 0),
    )


def cash_trend(periods, slope, r2, forecast, last_net, max_z, cash_in, cash_out, p: Policy = DEFAULT_POLICY) -> Column:
    missing = slope.isNull() | r2.isNull() | forecast.isNull() | last_net.isNull() | max_z.isNull()
    deep = deficit_pct(last_net, cash_in, cash_out) >= p["cash_deficit_critical_pct"]
    return (
        F.when(F.coalesce(periods, F.lit(0)) < p["minimum_trend_periods"], "unavailable")
        .when(missing, "unavailable")
        .when((last_net < 0) & deep, "critical").when(last_net < 0, "caution")
        .when(forecast < 0, "critical")
        .when((slope < 0) | (r2 < p["trend_r_squared_caution_floor"]) | (max_z >= p["trend_anomaly_caution_z"]), "caution")
        .otherwise("favorable")
    )


def waste(steel_actual, steel_budget, concrete_actual, concrete_budget, p: Policy = DEFAULT_POLICY) -> Column:
    gap = F.greatest((steel_actual - steel_budget) * 100, (concrete_actual - concrete_budget) * 100)
    return _graded(gap.isNull(), gap > p["waste_critical_points"], gap > p["waste_caution_points"])


def reconciliation(accounting, reported, p: Policy = DEFAULT_POLICY) -> Column:
    gap = F.abs(F.coalesce(F.when(reported != 0, (accounting - reported) / F.abs(reported) * 100), F.lit(0.0)))
    return _graded(
        accounting.isNull() | reported.isNull() | ((accounting == 0) & (reported == 0)),
        gap > p["reconciliation_critical_pct"], gap > p["reconciliation_caution_pct"],
    )


def concentration(top, total, p: Policy = DEFAULT_POLICY) -> Column:
    share = F.when(total != 0, F.abs(top) / F.abs(total) * 100)
    return _graded(
        share.isNull() | (top <= 0) | (total <= 0) | (top > total),
        share > p["concentration_critical_pct"], share > p["concentration_caution_pct"],
    )


def forecast(row_count, remaining, etc, bac, p: Policy = DEFAULT_POLICY) -> Column:
    delta = remaining - etc
    pct = F.when(F.coalesce(bac, F.lit(0.0)) != 0, delta / F.abs(bac) * 100)
    return (
        F.when(F.coalesce(row_count, F.lit(0)) == 0, "unavailable").when(delta.isNull(), "informational")
        .when((delta < 0) & (pct < p["vac_caution_pct"]), "critical").when(delta < 0, "caution").otherwise("favorable")
    )


def indirect_variance(budget, actual, variance, p: Policy = DEFAULT_POLICY) -> Column:
    variance = F.coalesce(variance, budget - actual)
    pct = F.when(budget > 0, variance / F.abs(budget) * 100)
    return _graded(
        budget.isNull() | actual.isNull() | variance.isNull() | (budget <= 0), pct < p["cv_caution_pct"], pct < 0
    )


def data_quality(severe, warnings, unaccounted) -> Column:
    z = F.lit(0)
    return _graded(
        F.lit(False), (F.coalesce(severe, z) > 0) | (F.coalesce(unaccounted, z) > 0), F.coalesce(warnings, z) > 0
    )


def scenario(profit, margin, p: Policy = DEFAULT_POLICY) -> Column:
    pct = margin * 100
    return _graded(profit.isNull() | margin.isNull(), (profit < 0) | (pct < 0), pct < p["margin_target_pct"])


def ledger_trend(periods, p: Policy = DEFAULT_POLICY) -> Column:
    return F.when(F.coalesce(periods, F.lit(0)) < p["minimum_trend_periods"], "unavailable").otherwise("informational")


def direction(first, last) -> Column:
    return F.when(last > first, "up").when(last < first, "down").when(last == first, "flat")


# ------------------------------------------------------------------- trend


def cash_trend_metrics(flow: DataFrame) -> DataFrame:
    """Least-squares line through cumulative net cash per project, with the largest residual z."""
    pts = flow.filter(F.col("cash_in_cum").isNotNull() & F.col("cash_out_cum").isNotNull())
    w = W.partitionBy("project").orderBy("month")
    pts = pts.select(
        "project", "month", "cash_in_cum", "cash_out_cum",
        (F.col("cash_in_cum") - F.col("cash_out_cum")).alias("net"),
        (F.row_number().over(w) - 1).cast("double").alias("x"),
    )
    line = pts.groupBy("project").agg(
        F.count("*").alias("periods"),
        F.regr_slope("net", "x").alias("slope"), F.regr_intercept("net", "x").alias("intercept"),
        F.regr_r2("net", "x").alias("r2"), F.var_pop("net").alias("var_y"),
        F.max_by(F.struct("net", "cash_in_cum", "cash_out_cum"), "month").alias("last"),
    )
    res = pts.join(line.select("project", "slope", "intercept"), "project").withColumn(
        "residual", F.col("net") - (F.col("slope") * F.col("x") + F.col("intercept")))
    spread = res.groupBy("project").agg(
        F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("sd"),
        F.max("residual").alias("hi"), F.min("residual").alias("lo"))
    enough = F.col("periods") >= 2
    z = F.when(F.col("sd") != 0, F.greatest(F.abs((F.col("hi") - F.col("mean")) / F.col("sd")),
                                            F.abs((F.col("lo") - F.col("mean")) / F.col("sd")))).otherwise(F.lit(0.0))
    r2 = F.when(F.col("var_y") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r2"))))
    return line.join(spread, "project").select(
        "project", "periods",
        F.when(enough, F.col("slope")).alias("slope"), F.when(enough, F.col("intercept")).alias("intercept"),
        F.when(enough, r2).alias("r_squared"),
        F.when(enough, F.col("slope") * F.col("periods") + F.col("intercept")).alias("forecast_next_net"),
        F.when(enough, z).alias("max_residual_z"),
        F.col("last.net").alias("last_net"), F.col("last.cash_in_cum").alias("latest_cash_in"),
        F.col("last.cash_out_cum").alias("latest_cash_out"),
    )


# ------------------------------------------------------- generic evaluation


def evaluate(descriptors: DataFrame, p: Policy = DEFAULT_POLICY) -> DataFrame:
    """Status, confidence and rule of every descriptor (semantic_type, metrics map, confidence)."""
    def m(k: str) -> Column:
        return F.try_element_at("metrics", F.lit(k))

    values = F.filter(F.map_values("metrics"), lambda v: v.isNotNull() & ~F.isnan(v))
    guard = (F.size(values) == 0) | (F.col("confidence") < 0.5)
    kind = F.col("semantic_type")
    cash_in = F.coalesce(m("cumulative_cash_in"), m("latest_cash_in"))
    cash_out = F.coalesce(m("cumulative_cash_out"), m("latest_cash_out"))
    net = F.coalesce(m("cumulative_net"), m("latest_net"))
    status = (
        F.when(guard, "unavailable")
        .when(kind.isin("cost_performance", "cost_table"), cost_performance(m("ev"), m("ac"), m("cpi"), m("cv"), p))
        .when(kind == "profitability_methods", profitability_methods(m("method_count"), m("losses"), m("misses")))
        .when(kind == "profitability", profitability(m("profit"), m("margin"), p))
        .when(kind.isin("cashflow", "cumulative_cashflow"), cash(cash_in, cash_out, net, m("negative_periods"), p))
        .when(kind == "cashflow_trend", cash_trend(
            m("periods"), m("slope"), m("r_squared"), m("forecast_next_net"), m("last_net"), m("max_residual_z"),
            m("latest_cash_in"), m("latest_cash_out"), p))
        .when(kind == "waste", waste(m("steel_actual"), m("steel_budget"), m("concrete_actual"), m("concrete_budget"), p))
        .when(kind == "reconciliation", reconciliation(m("accounting"), m("reported"), p))
        .when(kind == "concentration", concentration(m("top"), m("total"), p))
        .when(kind == "forecast", forecast(m("row_count"), m("remaining_budget"), m("etc"), m("bac"), p))
        .when(kind == "indirect_variance", indirect_variance(m("budget"), m("actual"), m("variance"), p))
        .when(kind == "data_quality", data_quality(m("severe"), m("warnings"), m("unaccounted")))
        .when(kind == "scenario", scenario(m("profit"), m("margin"), p))
        .when(kind == "ledger_trend", ledger_trend(F.coalesce(m("periods"), m("row_count")), p))
        .otherwise("informational")
    )
    out = descriptors.withColumn("status", status)
    return out.withColumn("result_confidence", F.when(F.col("status") == "unavailable", 0.0).otherwise(F.col("confidence")))


def family_of(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "cost_table", "cost_performance").otherwise(c)


def risk_assessments(evaluated: DataFrame) -> DataFrame:
    """First result per project and family wins; favorable and informational ones are dropped."""
    first = evaluated.groupBy("project_id", family_of("semantic_type").alias("family")).agg(
        F.min_by(F.struct("component_id", "component_name", "status", "result_confidence", "period"), "ordinal").alias("r"))
    return first.select(
        "project_id", "family", "r.component_id", F.col("r.component_name").alias("title"), "r.period",
        F.col("r.result_confidence").alias("confidence"), F.col("r.status").alias("status"),
        F.when(F.col("r.status") == "mixed", "caution").otherwise(F.col("r.status")).alias("severity"),
    )


def risk_report(evaluated: DataFrame) -> DataFrame:
    """Ordered risks: severity, confidence (high first), title."""
    risks = risk_assessments(evaluated).filter(F.col("severity").isin("critical", "caution", "unavailable"))
    return risks.select("*", F.when(F.col("project_id") == "portfolio", "portfolio").otherwise("project").alias("scope"))


def risk_counts(evaluated: DataFrame) -> DataFrame:
    r = risk_assessments(evaluated)
    return r.agg(F.count("*").alias("evaluated"), *[
        F.count_if(F.col("severity") == s).alias(f"{s}_count")
        for s in ("critical", "caution", "unavailable", "favorable", "informational")])


def risk_clusters(risks: DataFrame) -> DataFrame:
    """Risks by family with counts, worst severity, spread and the weakest assessable confidence."""
    sev = F.col("severity")
    assessable = sev != "unavailable"
    out = risks.groupBy("family").agg(
        *[F.count_if(sev == s).alias(f"{s}_count") for s in ("critical", "caution", "unavailable")],
        F.count("*").alias("assessments"), F.countDistinct("project_id").alias("projects"),
        F.countDistinct("period").alias("periods"),
        F.coalesce(F.min(F.when(assessable, F.col("confidence"))), F.min("confidence"), F.lit(0.0)).alias("confidence_floor"),
        F.countDistinct(F.when(assessable, sev)).alias("decisions"),
    )
    worst = F.when(F.col("critical_count") > 0, "critical").when(F.col("caution_count") > 0, "caution").otherwise("unavailable")
    return out.withColumn("severity", worst)


def overview(risks: DataFrame, counts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Assessable coverage %, adverse count, leading assessable cluster, latest period."""
    order = F.struct(status_rank("severity"), -F.col("critical_count"), -F.col("caution_count"), F.col("family"))
    lead = clusters.filter("severity <> 'unavailable'").agg(F.min_by("family", order).alias("top_cluster"))
    latest = risks.agg(F.max("period").alias("latest_period"))
    return counts.join(lead, how="cross").join(latest, how="cross").select(
        (F.when(F.col("evaluated") != 0, (F.col("evaluated") - F.col("unavailable_count")) / F.col("evaluated") * 100)
         .otherwise(F.lit(0.0))).alias("coverage_pct"),
        (F.col("critical_count") + F.col("caution_count")).alias("adverse"), "top_cluster", "latest_period",
    )


# ------------------------------------------------------------------ lineage


def normal_title(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def evidence_places(evidence: DataFrame) -> DataFrame:
    """Distinct places (sheet and row) per project and dataset."""
    place = F.concat_ws(" row ", "source_sheet", F.col("source_row").cast("string")).alias("place")
    return evidence.filter("source_sheet IS NOT NULL").select("project", "dataset", "source_sheet", "source_row", place).distinct()


def first_places(evidence: DataFrame, limit: int = 12) -> DataFrame:
    """The first distinct places of each project and dataset, by sheet and row, as an array of texts.

    Spark keeps the first of each group in a task before the shuffle, so that what is gathered is bounded by tasks x limit.
    """
    place = F.concat_ws(" · row ", "source_sheet", F.col("source_row").cast("string")).alias("place")
    own = evidence.filter("source_sheet <> ''").select("project", "dataset", "source_sheet", "source_row", place).distinct()
    order = W.partitionBy("project", "dataset").orderBy("source_sheet", F.col("source_row").asc_nulls_first())
    first = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return first.groupBy("project", "dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "place"))), lambda x: x["place"]).alias("first_places"))


def json_paths(project_id: Column | str, metric: Column | str, datasets: Column | str, preferred: bool = True) -> Column:
    """Where the values of an output stand in a project's documents: its metric, then its datasets."""
    project_id, metric, datasets = (F.col(c) if isinstance(c, str) else c for c in (project_id, metric, datasets))
    base = F.concat(F.lit("/generated/projects/"), project_id, F.lit("/latest.json"))
    one = F.array(F.concat(base, F.lit("#/metrics/"), metric, F.lit("/preferred" if preferred else "")))
    return F.concat(F.when(metric.isNotNull(), one).otherwise(F.array().cast("array<string>")), F.transform(datasets, lambda d: F.concat(base, F.lit("#/normalized_path#/"), d)))


def united(*lists: Column) -> Column:
    """Distinct texts of several lists in their order, without nulls and empty texts."""
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), lambda v: v != ""))


def dataset_stats(evidence: DataFrame) -> DataFrame:
    """Records, number of distinct places and mean confidence per project and dataset."""
    stats = evidence.groupBy("project", "dataset").agg(
        F.count("*").alias("records"), F.avg("mapping_confidence").alias("confidence"))
    places = evidence_places(evidence).groupBy("project", "dataset").agg(F.count("*").alias("n_places"))
    return stats.join(places, ["project", "dataset"], "left")


def lineage(bindings: DataFrame, projects: DataFrame, stats: DataFrame, places: DataFrame, metrics: DataFrame, first: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """Output bindings x projects: records, evidence, confidence and wired/derived/unavailable.

    With ``first`` (:func:`first_places`) and a column project_id of ``projects`` also ``evidence``, the metric's place and the first distinct places of
    the datasets in their order, and ``paths``. ``locations`` counts all distinct places.

    ``bindings`` has (ordinal, family, page, component, metric, datasets array);
    ``metrics`` has one row per project and available metric with its location.
    """
    base = projects.join(bindings, how="cross")
    used = base.select("project", "ordinal", F.explode("datasets").alias("dataset")).join(stats, ["project", "dataset"])
    agg = used.groupBy("project", "ordinal").agg(
        F.sum("records").alias("records"), F.sum(F.col("confidence") * F.col("records")).alias("weighted"),
        F.sum(F.when(F.col("confidence").isNotNull(), F.col("records"))).alias("weight"))
    # a place that several datasets of a binding share counts once
    told = bindings.select("ordinal", F.explode("datasets").alias("dataset")).join(places.select("project", "dataset", "place"), "dataset")
    told = told.groupBy("project", "ordinal").agg(F.count_distinct("place").alias("n_places"))
    out = base.join(agg, ["project", "ordinal"], "left").join(told, ["project", "ordinal"], "left").join(metrics, ["project", "metric"], "left")
    places = F.coalesce("n_places", F.lit(0)) + F.when(F.col("location").isNotNull(), 1).otherwise(0)
    present = F.col("location").isNotNull() | (F.col("records") > 0)
    more = []
    if first is not None:
        shown = base.select("project", "ordinal", F.posexplode("datasets").alias("pos", "dataset")).join(first, ["project", "dataset"]).groupBy("project", "ordinal").agg(
            F.array_sort(F.collect_list(F.struct("pos", "first_places"))).alias("f"))
        out = out.join(shown, ["project", "ordinal"], "left")
        found = F.slice(F.array_distinct(F.flatten(F.transform("f", lambda x: x["first_places"]))), 1, limit)
        more = [united(F.array("location"), found).alias("evidence"), json_paths("project_id", "metric", "datasets").alias("paths")]
    return out.select(
        "project", "ordinal", "family", "page", "component", F.coalesce("records", F.lit(0)).cast("long").alias("records"),
        places.cast("long").alias("locations"), (F.col("weighted") / F.col("weight")).alias("confidence"),
        F.when(~F.coalesce(present, F.lit(False)), "unavailable").when(places > 0, "wired").otherwise("derived").alias("status"), *more,
    )


def adaptive_lineage(bindings: DataFrame, stats: DataFrame, projects: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """Datasets no binding covers are still listed, with their places where ``first`` and ``projects`` (project, project_id) are given."""
    covered = bindings.select(F.explode("datasets").alias("dataset")).distinct()
    title = F.initcap(F.regexp_replace("dataset", "_", " "))
    n = F.coalesce("n_places", F.lit(0))
    rest, more = stats.join(covered, "dataset", "left_anti"), []
    if first is not None:
        rest = rest.join(projects, "project").join(first, ["project", "dataset"], "left")
        more = [united(F.col("first_places")).alias("evidence"), json_paths("project_id", F.lit(None).cast("string"), F.array("dataset")).alias("paths")]
    return rest.select(
        "project", F.lit(None).cast("int").alias("ordinal"), F.lit("Source & Assurance").alias("family"),
        F.lit("Data Mapping").alias("page"), F.concat(F.lit("Adaptive dataset · "), title).alias("component"),
        F.col("records").cast("long").alias("records"), n.cast("long").alias("locations"), "confidence",
        F.when(n > 0, "adaptive").otherwise("derived").alias("status"), *more,
    )


def attach_lineage(descriptors: DataFrame, lineage_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Evidence (the descriptor's own, the places and the paths of its output, each once) and the weaker of both confidences by normalised title.

    The title map is one row per (project, title), so the join cannot fan out.
    """
    lin = lineage_rows.groupBy("project", normal_title("component").alias("title")).agg(
        F.min_by(F.struct("status", "records", "locations", "evidence", "paths", F.col("confidence").alias("lc")), "ordinal").alias("l"))
    named = descriptors.join(aliases, "component_id", "left")
    named = named.withColumn("title", normal_title(F.coalesce("alias", "component_name")))
    j = named.join(lin, (named["project_name"] == lin["project"]) & (named["title"] == lin["title"]), "left")
    return j.select(
        "project_name", "surface", "component_id", F.col("l.status").alias("mapping_status"),
        F.col("l.records").alias("source_records"), F.col("l.locations").alias("locations"), united(F.col("source_evidence"), F.col("l.evidence"), F.col("l.paths")).alias("evidence"),
        F.when(F.col("l.lc").isNotNull(), F.least("confidence", F.col("l.lc"))).otherwise(F.col("confidence")).alias("confidence"),
    )
