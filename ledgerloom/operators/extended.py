"""Period movement, ranking, exception and control-total operators.

Windows run over monthly snapshots (one row per project or work package and
month), never over transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import line_sum, ratio, running_total, total_sum

C = F.col
# Weights of the overall cost-risk score.
RISK_WEIGHTS = {
    "forecast": 0.20, "cpi": 0.15, "etc_growth": 0.15, "commitment": 0.10, "contingency": 0.10,
    "cash": 0.10, "revenue": 0.10, "productivity": 0.05, "data_quality": 0.05,
}
# Upper bounds of the five risk classes.
RISK_CLASSES = [(25, "Low"), (50, "Moderate"), (70, "High"), (85, "Very High")]


def by_month(*keys: str):
    return W.partitionBy(*keys).orderBy("month")


def snapshots(months: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative monthly snapshot: budget, EV, AC to date, CPI, CV and forecast at completion."""
    w = by_month(*keys).rowsBetween(W.unboundedPreceding, 0)
    cum = months.select(*keys, "month", *[running_total(c, w).alias(c) for c in ("bac", "ev", "ac")])
    etc = C("bac") - C("ev")
    return cum.select(
        "*", ratio("ev", "ac").alias("cpi"), (C("ev") - C("ac")).alias("cv"), etc.alias("etc"),
        (C("ac") + etc).alias("eac"), (C("bac") - (C("ac") + etc)).alias("vac"),
    )


def rag(snap: DataFrame, cash: DataFrame, cpi_green: float = 1.0, cpi_amber: float = 0.95, cv_tolerance_pct: float = -5.0,
        forecast_tolerance: float = 1.05) -> DataFrame:
    """Red/amber/green on CPI, CV, forecast and cash with the movement against the prior month."""
    w = by_month("project")
    j = snap.join(cash, ["project", "month"], "left")
    cv_pct = F.when(C("ev") != 0, C("cv") / F.abs("ev") * 100)
    net = C("cash_in_cum") - C("cash_out_cum")
    prior_net, prior_cpi = F.lag(net).over(w), F.lag("cpi").over(w)

    def grade(green: Column, amber: Column, known: Column) -> Column:
        return F.when(~known, None).when(green, "green").when(amber, "amber").otherwise("red")

    over = ratio("eac", "bac")
    return j.select(
        "project", "month",
        grade(C("cpi") >= cpi_green, C("cpi") >= cpi_amber, C("cpi").isNotNull()).alias("cpi_status"),
        grade(C("cv") >= 0, cv_pct >= cv_tolerance_pct, cv_pct.isNotNull()).alias("cv_status"),
        grade(C("eac") <= C("bac"), over <= forecast_tolerance, over.isNotNull()).alias("forecast_status"),
        grade((net > 0) & (prior_net.isNull() | (net >= prior_net)), net > 0, net.isNotNull()).alias("cash_status"),
        F.when(prior_cpi.isNull() | C("cpi").isNull(), None).when(C("cpi") > prior_cpi, "up")
        .when(C("cpi") < prior_cpi, "down").otherwise("flat").alias("movement"),
    )


def metric_long(snap: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    items = [F.struct(F.lit(m).alias("metric"), C(m).alias("value")) for m in metrics]
    return snap.select(*keys, "month", F.inline(F.array(*items)))


def month_delta(snap: DataFrame, metrics: list[str], higher_is_better: list[str]) -> DataFrame:
    """Absolute and percent change of every metric against the prior month, better or worse."""
    long = metric_long(snap, ["project"], metrics)
    w = W.partitionBy("project", "metric").orderBy("month")
    d = long.withColumn("prior", F.lag("value").over(w)).filter("prior IS NOT NULL")
    delta = C("value") - C("prior")
    good = F.when(C("metric").isin(higher_is_better), delta > 0).otherwise(delta < 0)
    return d.select(
        "project", "month", "metric", "value", "prior", delta.alias("delta"),
        F.when(C("prior") != 0, delta / F.abs("prior") * 100).alias("delta_pct"),
        F.when(delta == 0, "same").when(good, "better").otherwise("worse").alias("direction"),
    )


def growth(snap: DataFrame, cumulative: bool) -> DataFrame:
    """Growth of AC, EV, CV and EAC: monthly increments or the cumulative values."""
    w = by_month("project")

    def g(c):
        return C(c) if cumulative else C(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0))

    return snap.select("project", "month", *[g(c).alias(f"{c}_growth") for c in ("ac", "ev", "cv", "eac")])


def latest(snap: DataFrame) -> DataFrame:
    cols = [c for c in snap.columns if c != "project"]
    return snap.groupBy("project").agg(F.max_by(F.struct(*cols), "month").alias("s")).select("project", "s.*")


def comparison(last: DataFrame, metrics: list[str]) -> DataFrame:
    """Best, worst, spread and mean of every metric over the projects."""
    long = metric_long(last, ["project"], metrics)
    return long.groupBy("metric").agg(
        F.min_by("project", F.struct((-C("value")).alias("v"), C("project"))).alias("best"), F.max("value").alias("best_value"),
        F.min_by("project", F.struct("value", "project")).alias("worst"), F.min("value").alias("worst_value"),
        (total_sum("value") / F.count("value")).alias("benchmark"),
    ).withColumn("max_delta", C("best_value") - C("worst_value"))


def ranking(last: DataFrame) -> DataFrame:
    """Ranks per mode and a weighted composite, raw metrics kept (one row per project)."""
    everything = W.partitionBy()
    cv_pct, vac_pct = C("cv") / C("ev") * 100, C("vac") / C("bac") * 100
    scored = last.select("project", "month", "cpi", "cv", "eac", "vac", cv_pct.alias("cv_pct"), vac_pct.alias("vac_pct"))
    modes = {"efficiency": "cpi", "variance": "cv_pct", "forecast": "vac_pct"}
    ranks = scored.select("*", *[
        F.rank().over(everything.orderBy(F.desc(c))).cast("long").alias(f"{m}_rank") for m, c in modes.items()])
    score = C("efficiency_rank") * 0.5 + C("variance_rank") * 0.3 + C("forecast_rank") * 0.2
    return ranks.withColumn("composite", F.round(score, 6)).withColumn(
        "overall_rank", F.rank().over(everything.orderBy("composite", "project")).cast("long"))


def heat_map(snap: DataFrame, key: str, value: str, months: list[str]) -> DataFrame:
    """A caller's months side by side; the long form is the snapshot itself."""
    return snap.groupBy(key).pivot("month", months).agg(F.max(value))


def deterioration(snap: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Longest run of consecutive falling periods per key, with its last month."""
    w = by_month(*keys)
    d = snap.select(*keys, "month", (C(metric) < F.lag(metric).over(w)).alias("down"))
    runs = d.withColumn("island", F.sum(F.when(C("down"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    lengths = runs.filter("down").groupBy(*keys, "island").agg(F.count("*").alias("len"), F.max("month").alias("until"))
    return lengths.groupBy(*keys).agg(F.max(F.struct("len", "until")).alias("m")).select(
        *keys, C("m.len").alias("longest"), C("m.until").alias("until"))


def exceptions(snap: DataFrame, cash: DataFrame, packages: DataFrame, drop: float = 0.01, growth_pct: float = 2.0) -> DataFrame:
    """Eleven management-exception rules on the monthly history, each with a severity."""
    w = by_month("project")
    j = snap.join(cash, ["project", "month"], "left")
    net = C("cash_in_cum") - C("cash_out_cum")
    l = {c: F.lag(c).over(w) for c in ("cpi", "eac", "ac", "ev")}
    falls = (C("cpi") < l["cpi"]) & (l["cpi"] < F.lag("cpi", 2).over(w)) & (F.lag("cpi", 2).over(w) < F.lag("cpi", 3).over(w))
    cv_pct = C("cv") / F.abs("ev") * 100
    rules = [
        ("cpi_below_threshold", 3, C("cpi") < 0.95), ("cpi_deteriorated", 2, l["cpi"] - C("cpi") > drop),
        ("cv_materially_negative", 3, cv_pct < -5), ("eac_increased", 2, (C("eac") - l["eac"]) / l["eac"] * 100 > growth_pct),
        ("vac_negative", 2, C("vac") < 0),
        ("ac_outgrows_ev", 2, (C("ac") - l["ac"]) / l["ac"] - (C("ev") - l["ev"]) / l["ev"] > 0.001),
        ("cash_turned_negative", 3, (net < 0) & (F.lag(net).over(w) >= 0)), ("three_months_deterioration", 3, falls),
    ]
    flags = j.select("project", "month", *[F.coalesce(cond, F.lit(False)).alias(n) for n, _, cond in rules])
    hits = flags.select("project", "month", F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), C(n).alias("hit")) for n, s, _ in rules]))).filter("hit")
    p = packages.select(
        "project", "month", F.inline(F.array(
            F.struct(F.lit("package_cpi_below_threshold").alias("rule"), F.lit(2).alias("severity"), (C("ev") / C("ac") < 0.93).alias("hit")),
            F.struct(F.lit("code_over_budget").alias("rule"), F.lit(2).alias("severity"), (C("ac") > C("bac") * 1.05).alias("hit")),
            F.struct(F.lit("category_variance").alias("rule"), F.lit(1).alias("severity"), ((C("ev") - C("ac")) / C("ev") * 100 < -7).alias("hit")),
        ))).filter("hit")
    both = hits.drop("hit").unionByName(p.drop("hit"))
    return both.groupBy("project", "rule", "severity").agg(
        F.count("*").alias("occurrences"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def month_basis(snap: DataFrame) -> DataFrame:
    """Three bases per project: the latest common month, its own latest month, the first month."""
    n = snap.agg(F.countDistinct("project").alias("n"))
    common = snap.groupBy("month").agg(F.countDistinct("project").alias("k")).join(n, how="cross").filter("k = n").agg(
        F.max("month").alias("month"))
    cols = ["project", "month", "ev", "ac", "cpi"]
    a = snap.join(common, "month").select(F.lit("common").alias("basis"), *cols)
    own = latest(snap.select(*cols)).select(F.lit("latest").alias("basis"), *cols)
    first = snap.agg(F.min("month").alias("month"))
    sel = snap.join(first, "month").select(F.lit("selected").alias("basis"), *cols)
    return a.unionByName(own).unionByName(sel)


def share_table(costs: DataFrame) -> DataFrame:
    """Category table with % of its group and % of the total, one roll-up pass."""
    g = costs.rollup("project", "raw_di", "division").agg(
        total_sum("ac").alias("ac"), F.grouping_id().alias("level"))
    cat = g.filter("level = 0")
    grp = g.filter("level = 1").select("project", "raw_di", C("ac").alias("group_ac"))
    tot = g.filter("level = 3").select("project", C("ac").alias("total_ac"))
    return cat.join(grp, ["project", "raw_di"]).join(tot, "project").select(
        "project", "raw_di", "division", "ac", (ratio("ac", "group_ac") * 100).alias("pct_of_group"),
        (ratio("ac", "total_ac") * 100).alias("pct_of_total"))


def resource_variance(res: DataFrame) -> DataFrame:
    """Quantity, rate and cost variance of each resource against its budget."""
    q, bq, ac, bc = (C(c) for c in ("work_qty", "budget_qty", "actual_cost", "budget_cost"))
    rate, brate = ratio(ac, q), ratio(bc, bq)
    return res.select(
        "project", "main_code", "resource", (bq - q).alias("qty_variance"), (brate - rate).alias("rate_variance"),
        (bc - ac).alias("cost_variance"), ((brate - rate) * q).alias("price_effect"), ((bq - q) * brate).alias("usage_effect"))


def drill_tree(lines: DataFrame) -> DataFrame:
    """project > division > code > resource subtotals in one roll-up."""
    return lines.rollup("project", "division", "main_code", "resource").agg(
        total_sum("ac").alias("ac"), F.sum("n").alias("transactions"), F.grouping_id().cast("long").alias("level"))


def ledger_groups(lines: DataFrame, low: float, high: float, first: str, last: str) -> DataFrame:
    """One switchable grouping per set (month, vendor, code, category) of the transactions in an amount and a month range."""
    view = lines.filter(C("ac").between(low, high) & C("month").between(first, last))
    view = view.groupBy("month", "resource", "main_code", "division").agg(line_sum("ac").alias("ac"), F.count("*").alias("n"))
    sets = [["month"], ["resource"], ["main_code"], ["division"]]
    cols = ["month", "resource", "main_code", "division"]
    g = view.groupingSets(sets, *cols).agg(
        total_sum("ac").alias("ac"), F.sum("n").alias("transactions"),
        *[F.grouping(c).alias(f"g_{c}") for c in cols])
    name = F.coalesce(*[F.when(C(f"g_{c}") == 0, F.lit(c)) for c in cols])
    return g.select(name.alias("grouping"), F.coalesce(*cols).alias("name"), "ac", "transactions")


def control_totals(pairs: DataFrame, tolerance_pct: float = 0.01) -> DataFrame:
    """Reconciled / Warning / Not Available for each (left, right) total."""
    gap = F.abs(C("left_total") - C("right_total"))
    ok = gap <= F.abs("right_total") * (tolerance_pct / 100)
    return pairs.withColumn("status", F.when(C("left_total").isNull() | C("right_total").isNull(), "Not Available")
                            .when(ok, "Reconciled").otherwise("Warning"))


def forecast_bands(rows: DataFrame) -> DataFrame:
    over = ratio("eac", "bac")
    band = (F.when(over.isNull(), None).when(over <= 1.02, "Low").when(over <= 1.05, "Medium").when(over <= 1.10, "High").otherwise("Critical"))
    return rows.select("project", "main_code", "month", (C("eac") - C("bac")).alias("overrun"), ((C("eac") - C("bac")) / C("bac")).alias("overrun_pct"), band.alias("band"))


def cpi_band(cpi: Column) -> Column:
    return F.when(cpi.isNull(), None).when(cpi >= 1.0, "Healthy").when(cpi >= 0.95, "Watch").when(cpi >= 0.90, "High").otherwise("Critical")


def risk_class(score: Column) -> Column:
    out = F.lit("Critical")
    for bound, name in reversed(RISK_CLASSES):
        out = F.when(score < bound, name).otherwise(out)
    return F.when(score.isNull(), None).otherwise(out)


def risk_score(components: DataFrame) -> DataFrame:
    """Weighted score of nine 0..100 components, its class, and probability-impact measures."""
    score = sum((C(k) * w for k, w in RISK_WEIGHTS.items()), F.lit(0.0))
    rounded = F.round(score, 6)
    return components.select(
        "project", "main_code", "month", rounded.alias("score"), risk_class(rounded).alias("risk_class"),
        F.round(C("probability") * C("impact"), 6).alias("risk"),
        F.round(C("probability") * C("impact") * C("urgency"), 6).alias("urgent_risk"),
        F.round(C("probability") * C("exposure"), 4).alias("emv"))


def transaction_findings(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Data-quality findings of transactions: duplicates, unmapped codes, non-positive amounts, bad periods, missing codes.

    Each line gives its own key and its code; both kinds are counted in one shuffle, behind map-side combine. A null code is unmapped
    and missing; lines with equal keys, nulls included, are duplicates of each other. Without lines every count is 0.
    """
    checks = {
        "missing_code": C("l_partkey").isNull(), "negative_value": C("l_extendedprice") < 0, "zero_quantity": C("l_quantity") <= 0,
        "zero_tax": C("l_tax") == 0, "bad_period": C("l_shipdate").isNull() | (F.year("l_shipdate") < 1990),
    }
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    def entry(kind, one, two, n, known, flags):
        return F.struct(F.lit(kind).alias("kind"), one.cast("long").alias("one"), two.cast("long").alias("two"), n.alias("n"), F.lit(known).alias("known"),
                        *[f.alias(name) for name, f in flags.items()])

    nothing = dict.fromkeys(checks, zero)
    failed = {n: F.when(c, 1).otherwise(0).cast("long") for n, c in checks.items()}
    one = F.lit(1).cast("long")
    keys = lines.select(F.inline(F.array(
        entry("line", C("l_orderkey"), C("l_linenumber"), one, False, failed), entry("code", C("l_partkey"), none, one, False, nothing))))
    known = parts.filter("p_partkey IS NOT NULL").select(F.inline(F.array(entry("code", C("p_partkey"), none, zero, True, nothing))))
    counted = keys.unionByName(known).groupBy("kind", "one", "two").agg(F.sum("n").alias("n"), F.bool_or("known").alias("known"), *[F.sum(c).alias(c) for c in checks])
    sums = {"duplicate_transactions": F.when(C("kind") == "line", C("n") - 1), "unmapped_code": F.when((C("kind") == "code") & ~C("known"), C("n")), **{c: C(c) for c in checks}}
    return counted.agg(*[F.coalesce(F.sum(v), zero).alias(n) for n, v in sums.items()]).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("finding"), C(n).alias("rows")) for n in sums])))


def driver_shares(exposure: DataFrame) -> DataFrame:
    """Share of each driver in the exposure of its project (few drivers per project)."""
    w = W.partitionBy("project")
    return exposure.select("project", "driver", "exposure",
                           (C("exposure") / F.sum(C("exposure").cast("decimal(38,6)")).over(w).cast("double") * 100).alias("share_pct"))


def trend_tag(scores: DataFrame, dead_band: float) -> DataFrame:
    delta = C("score") - F.lag("score").over(by_month("project"))
    return scores.select("project", "month", "score", F.when(delta.isNull(), None).when(delta > dead_band, "deteriorating")
                         .when(delta < -dead_band, "improving").otherwise("stable").alias("tag"))


def commentary(delta: DataFrame) -> DataFrame:
    """Largest deterioration and improvement per month as plain sentences."""
    cpi = delta.filter("metric = 'cpi'")
    g = cpi.groupBy("month").agg(
        F.min(F.struct("delta", "project")).alias("down"),
        F.min(F.struct((-C("delta")).alias("neg"), C("project"))).alias("up"))
    return g.select(
        "month", F.format_string("Largest CPI deterioration: %s", C("down.project")).alias("deterioration"), C("down.delta").alias("deterioration_delta"),
        F.format_string("Largest CPI improvement: %s", C("up.project")).alias("improvement"), (-C("up.neg")).alias("improvement_delta"))
