"""The engine's long tables, bound to the given star schema.

Each binding joins only the dimensions whose columns are asked for: an unused
dimension would cost a shuffle of every line at scale. A lookup side carries a
broadcast hint only while the scans behind it are below the session's threshold
(``session.broadcast_if_small``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import line_sum, running_total
from ledgerloom.operators.cube import measure_cube
from ledgerloom.session import broadcast_if_small, dealt_by_size, dealt_to_groups, fits_broadcast, removed, written


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def month_of(c) -> F.Column:
    """'YYYY-MM'; put together from numbers, which costs half of formatting the timestamp."""
    return F.concat(F.year(c).cast("string"), F.lit("-"), F.lpad(F.month(c).cast("string"), 2, "0"))


def projects_dim(spark: SparkSession, sf: str) -> DataFrame:
    """customer -> project (nation) and region key."""
    nation = table(spark, sf, "nation").select(
        "n_nationkey", F.col("n_name").alias("project"), F.col("n_regionkey").alias("regionkey")
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    dim = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "project", "regionkey")
    return broadcast_if_small(dim, customer)


def order_projects(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Orders with their project; ``columns`` (default all) decides what is carried and measured."""
    columns = columns or ("o_orderkey", "project", "regionkey", "o_totalprice", "o_orderdate")
    own = [c for c in columns if c.startswith("o_")]
    orders = table(spark, sf, "orders").select("o_custkey", *own)
    dealt = dealt_by_size(orders, "o_custkey", table(spark, sf, "orders"), table(spark, sf, "customer"))
    out = dealt.join(projects_dim(spark, sf), F.col("o_custkey") == F.col("c_custkey")).select(*columns)
    return broadcast_if_small(out, orders)


def line_parts(spark: SparkSession, sf: str, part: bool = False, supplier: bool = False) -> DataFrame:
    """Cost transactions as they are joined: keys and the plain columns of the lines, which are smaller than the amounts made of them.

    Where a lookup side is above the broadcast threshold, the lines are dealt for its join in parts that follow the size of their table.
    """
    li = table(spark, sf, "lineitem")
    day = F.col("l_shipdate")
    lines = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", (F.year(day) * 12 + F.month(day) - 1).alias("month_no"), F.col("l_returnflag").alias("source"), "l_linestatus",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    lines = dealt_by_size(lines, "l_orderkey", li, table(spark, sf, "orders"))
    op = order_projects(spark, sf, "o_orderkey", "project", "regionkey")
    out = lines.join(op, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
    year = F.floor(F.col("month_no") / 12)
    month = F.concat(year.cast("string"), F.lit("-"), F.lpad((F.col("month_no") - year * 12 + 1).cast("string"), 2, "0"))
    out = out.withColumn("month", month).drop("month_no")
    if part:
        out = with_part(spark, sf, out)
    return with_supplier(spark, sf, out) if supplier else out


def with_part(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    p = table(spark, sf, "part").select(
        "p_partkey", F.col("p_type").alias("division"), F.col("p_brand").alias("main_code")
    )
    dealt = dealt_by_size(lines, "l_partkey", table(spark, sf, "lineitem"), table(spark, sf, "part"))
    return dealt.join(p, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def stored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Joined lines with their parts and spreadsheet-like work codes, as a table.

    Where the parts are above the broadcast threshold, the lines with their orders are written before they meet the parts, so that one
    join at a time has its shuffle files.
    """
    if fits_broadcast(table(spark, sf, "part")):
        return written(ledger_codes(line_parts(spark, sf, part=True)), "cost-lines")
    ordered = written(line_parts(spark, sf), "order-lines")
    lines = written(ledger_codes(with_part(spark, sf, ordered)), "cost-lines")
    removed(ordered)
    return lines


def with_supplier(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("resource"))
    dealt = dealt_by_size(lines, "l_suppkey", table(spark, sf, "lineitem"), table(spark, sf, "supplier"))
    return dealt.join(s, F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey", "s_suppkey")


def amounts(lines: DataFrame) -> DataFrame:
    """The amounts of joined lines beside their keys."""
    price = F.col("l_extendedprice")
    keys = [k for k in ("division", "main_code", "resource") if k in lines.columns]
    return lines.select(
        "project", "regionkey", "month", "source", F.when(F.col("l_linestatus") == "F", "D").otherwise("I").alias("raw_di"),
        F.col("l_quantity").alias("work_qty"), price.alias("bac"), (price * (1 - F.col("l_discount"))).alias("ev"),
        (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("ac"), *keys)


def cost_lines(spark: SparkSession, sf: str, part: bool = False, supplier: bool = False) -> DataFrame:
    """One row per cost transaction. ``part`` adds division and main_code, ``supplier`` adds resource."""
    return amounts(line_parts(spark, sf, part, supplier))


def _lines(lines: DataFrame | None, build, spark: SparkSession, sf: str, **kw) -> DataFrame:
    """The caller's shared lines, or a plan reading only what this binding needs."""
    return lines if lines is not None else build(spark, sf, **kw)


def money_sums(*names: str) -> list:
    return [line_sum(n).alias(n) for n in names]


def work_packages(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    return (
        _lines(lines, cost_lines, spark, sf, part=True)
        .groupBy("project", "main_code", "month")
        .agg(*money_sums("bac", "ev", "ac"))
    )


def project_months(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """Monthly snapshot per project: the history table of the period operators."""
    return _lines(lines, cost_lines, spark, sf).groupBy("project", "month").agg(
        F.min("regionkey").alias("regionkey"), *money_sums("bac", "ev", "ac")
    )


def ledger_codes(lines: DataFrame) -> DataFrame:
    """Spreadsheet-like work codes (B.12)."""
    return lines.withColumn("main_code", F.regexp_replace("main_code", "^Brand#", "B."))


def ledger_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger lines with a spreadsheet-like work code (B.12)."""
    return ledger_codes(cost_lines(spark, sf, part=True, supplier=True))


MEASURES = ("bac", "ev", "ac", "work_qty")


def level_keys(keys: str) -> tuple[str, ...]:
    return ("project", "regionkey", *keys.split())


def cost_cube(spark: SparkSession, sf: str, measures: tuple[str, ...] = MEASURES, coded: bool = True, **levels: str) -> dict[str, DataFrame]:
    """Cells by level, from one scan of the lines; any of them serves as the ``lines`` of the bindings below.

    A level names its keys beside project and regionkey, parted by blanks. Only the dimensions these keys need are joined.
    """
    named = {level: level_keys(keys) for level, keys in levels.items()}
    used = {k for keys in named.values() for k in keys}
    lines = cost_lines(spark, sf, part=bool(used & {"division", "main_code"}), supplier="resource" in used)
    if coded and "main_code" in used:
        lines = ledger_codes(lines)
    return measure_cube(lines, named, measures, "cost-cells")


def direct_details(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """Direct-cost rows per project, work code and division."""
    g = (
        _lines(lines, cost_lines, spark, sf, part=True)
        .filter("raw_di = 'D'")
        .withColumn("main_code", F.regexp_replace("main_code", "^Brand#", "B."))
        .groupBy("project", "regionkey", "main_code", "division")
        .agg(*money_sums("bac", "ev", "ac", "work_qty"))
    )
    return g.select(
        "project",
        "main_code",
        "division",
        F.concat_ws(" ", "main_code", "division").alias("description"),
        F.col("bac").alias("original_budget"),
        "bac",
        "ev",
        "ac",
        F.lit(None).cast("double").alias("cv"),
        "work_qty",
        F.when(F.col("regionkey") != 2, F.col("work_qty") * 1.25).alias("final_qs_qty"),
        F.round(F.col("ev") / F.col("bac"), 6).alias("invoice_pct"),
        (F.col("bac") - F.col("ev")).alias("etc"),
        F.when(F.col("regionkey") != 3, F.col("ac") + (F.col("bac") - F.col("ev"))).alias("eac"),
        F.lit(None).cast("double").alias("vac"),
    )


def indirect_details(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    g = (
        _lines(lines, cost_lines, spark, sf, part=True)
        .filter("raw_di = 'I'")
        .withColumn("main_code", F.regexp_replace("main_code", "^Brand#", "B."))
        .groupBy("project", "main_code")
        .agg(*money_sums("bac", "ev", "ac"))
    )
    return g.select(
        "project",
        "main_code",
        F.concat(F.lit("Indirect "), F.col("main_code")).alias("description"),
        F.col("bac").alias("original_budget"),
        "ev",
        "ac",
        (F.col("ev") - F.col("ac")).alias("cv"),
        "bac",
    )


def boq_resources(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """Actual cost per project, direct work code and resource."""
    return (
        _lines(lines, ledger_lines, spark, sf)
        .filter("raw_di = 'D'")
        .groupBy("project", "main_code", "resource")
        .agg(
            line_sum("ac").alias("actual_cost"),
            line_sum("work_qty").alias("work_qty"),
            line_sum("bac").alias("eac"),
        )
    )


def ledger(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """Ledger transactions with a monthly array, one row per project, code, resource, source and class.

    Lines are dealt to transactions once, before anything is summed: months and transactions are then grouped where they are.
    """
    if lines is None:
        parts = ledger_codes(line_parts(spark, sf, part=True, supplier=True))
        lines = amounts(dealt_to_groups(parts, table(spark, sf, "lineitem"), "project", "main_code", "resource", "source"))
    monthly = (
        lines.groupBy("project", "main_code", "resource", "source", F.col("raw_di").alias("di"), "month")
        .agg(line_sum("work_qty").alias("qty"), line_sum("ac").alias("total"))
    )
    return (
        monthly.groupBy("project", "main_code", "resource", "source", "di")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "month",
                        "qty",
                        F.when(F.col("qty") != 0, F.col("total") / F.col("qty")).alias("unit_price"),
                        "total",
                    )
                )
            ).alias("months"),
            F.sum(F.col("total").cast("decimal(38,6)")).cast("double").alias("total_cost"),
            F.sum(F.col("qty").cast("decimal(38,6)")).cast("double").alias("total_qty"),
        )
    )


def ledger_totals(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """Ledger transactions without their monthly detail: one aggregation of the lines."""
    return (
        _lines(lines, ledger_lines, spark, sf)
        .groupBy("project", "main_code", "resource", "source", F.col("raw_di").alias("di"))
        .agg(line_sum("ac").alias("total_cost"), line_sum("work_qty").alias("total_qty"))
    )


def cash(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """Monthly cash per project: receipts by order month, payments by ship month, NULL where absent."""
    receipts = order_projects(spark, sf).groupBy("project", month_of(F.col("o_orderdate")).alias("month")).agg(
        line_sum(F.col("o_totalprice") * (F.col("regionkey") + 7) / 10).alias("cash_in")
    )
    payments = _lines(lines, cost_lines, spark, sf).groupBy("project", "month").agg(line_sum("ac").alias("cash_out"))
    return receipts.join(payments, ["project", "month"], "full_outer")


def cashflow(spark: SparkSession, sf: str, lines: DataFrame | None = None, flow: DataFrame | None = None) -> DataFrame:
    """cash, computed here or given as ``flow``, plus running sums that treat a missing month as 0."""
    w = W.partitionBy("project").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return (flow if flow is not None else cash(spark, sf, lines)).select(
        "project",
        "month",
        "cash_in",
        "cash_out",
        running_total(F.coalesce("cash_in", F.lit(0.0)), w).alias("cash_in_cum"),
        running_total(F.coalesce("cash_out", F.lit(0.0)), w).alias("cash_out_cum"),
    )


def project_model(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """Registry metrics (m_*) and normalised KPIs (k_*) per project.

    Some regions lack one side, so the fallback chains are exercised.
    """
    cost = _lines(lines, cost_lines, spark, sf).groupBy("project").agg(
        F.min("regionkey").alias("regionkey"),
        *money_sums("bac", "ev", "ac"),
        *[
            line_sum(F.when(F.col("raw_di") == f, F.col(c))).alias(f"{c}_{f.lower()}")
            for f in ("D", "I")
            for c in ("bac", "ac")
        ],
        F.max("month").alias("period"),
    )
    income = order_projects(spark, sf).groupBy("project").agg(
        line_sum("o_totalprice").alias("contract"),
        line_sum(F.col("o_totalprice") * (F.col("regionkey") + 7) / 10).alias("revenue"),
    )
    rk = F.col("regionkey")

    def unless(c, *keys):
        return F.when(~rk.isin(*keys), c)

    return cost.join(income, "project").select(
        F.lower(F.regexp_replace("project", "_", "-")).alias("id"),
        F.col("project").alias("name"),
        "regionkey",
        "period",
        F.sha2(F.concat_ws("|", "project", "period"), 256).alias("fingerprint"),
        F.col("contract").alias("m_contract_value"),
        F.col("bac").alias("m_budget"),
        F.col("ev").alias("m_earned_value"),
        F.col("ac").alias("m_actual_cost"),
        F.col("ac_d").alias("m_direct_cost"),
        F.col("ac_i").alias("m_indirect_cost"),
        unless(F.col("revenue"), 3).alias("m_revenue"),
        unless(F.col("revenue") - F.col("ac"), 4).alias("m_gross_profit"),
        unless(F.col("contract"), 3).alias("k_contract_price_dashboard"),
        unless(F.col("contract"), 2, 3).alias("k_total_price_project_summary"),
        unless(F.col("bac"), 1).alias("k_total_budget_cost"),
        F.col("bac_d").alias("k_direct_budget_cost"),
        unless(F.col("bac_i"), 0).alias("k_indirect_budget_cost"),
        unless(F.col("ev"), 1).alias("k_ev_dashboard_scope"),
        unless(F.col("ev") * 1.02, 2).alias("k_ev_total_project_scope"),
        unless(F.col("ac"), 1).alias("k_actual_cost_dashboard_scope"),
        unless(F.col("ac") * 1.03, 2).alias("k_actual_cost_total_project_scope"),
        unless(F.col("ac_d"), 3).alias("k_direct_actual"),
        unless(F.col("ac_i"), 3).alias("k_indirect_actual"),
        F.when(rk == 1, F.col("ac") * 1.04).otherwise(F.col("ac")).alias("k_ledger_accounting_cost"),
        F.col("ac_d").alias("k_ledger_raw_direct"),
        F.col("ac_i").alias("k_ledger_raw_indirect"),
        unless(F.col("revenue"), 4).alias("k_revenue_gross_profit"),
    )


def with_methods(model: DataFrame) -> DataFrame:
    """The model with the available profitability methods of each project in one array, never merged."""
    contract, revenue, ac = F.col("m_contract_value"), F.col("m_revenue"), F.col("m_actual_cost")
    none = F.lit(None).cast("double")
    profit = revenue - ac - revenue * 0.02

    def method(idx, name, base, deductions, gain, share, there):
        return F.struct(
            F.lit(idx).alias("idx"), F.lit(name).alias("method"), base.alias("base"), ac.alias("cost"), deductions.alias("deductions"),
            gain.alias("profit"), share.alias("profit_pct"), there.alias("there"))

    both = F.array(
        method(0, "Contract method", contract, none, contract - ac, F.when(contract != 0, (contract - ac) / contract), F.lit(True)),
        method(1, "Revenue method", revenue, revenue * 0.02, profit,
               F.when((F.col("regionkey") != 2) & (revenue != 0), profit / revenue), revenue.isNotNull() & (F.col("regionkey") != 4)),
    )
    return model.withColumn("methods", F.filter(both, lambda m: m["there"]))


def profit_methods(model: DataFrame) -> DataFrame:
    """One row per project and available profitability method."""
    return with_methods(model).select(F.col("name").alias("project"), "regionkey", F.inline("methods")).drop("there")


# ---------------------------------------------------------------- oracle text


def S(expr: str) -> str:
    """Exact sum in oracle SQL."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(38,6))) AS DOUBLE)"


def RUN(expr: str, part: str = "project", order: str = "month") -> str:
    return (
        f"CAST(sum(CAST({expr} AS DECIMAL(38,6))) OVER (PARTITION BY {part} ORDER BY {order} "
        "ROWS UNBOUNDED PRECEDING) AS DOUBLE)"
    )


CTE: dict[str, str] = {
    "cost_lines": """
 SELECT n.n_name AS project, n.n_regionkey AS regionkey, strftime(l.l_shipdate,'%Y-%m') AS month,
  p.p_type AS division, p.p_brand AS main_code, s.s_name AS resource, l.l_returnflag AS source,
  CASE WHEN l.l_linestatus='F' THEN 'D' ELSE 'I' END AS raw_di, l.l_quantity AS work_qty,
  l.l_extendedprice AS bac, l.l_extendedprice*(1-l.l_discount) AS ev,
  l.l_extendedprice*(1-l.l_discount)*(1+l.l_tax) AS ac
 FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey
 JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN part p ON l.l_partkey=p.p_partkey
 JOIN supplier s ON l.l_suppkey=s.s_suppkey""",
    "work_packages": f"""
 SELECT project, main_code, month, {S('bac')} AS bac, {S('ev')} AS ev, {S('ac')} AS ac
 FROM cost_lines GROUP BY ALL""",
    "project_months": f"""
 SELECT project, month, min(regionkey) AS regionkey, {S('bac')} AS bac, {S('ev')} AS ev, {S('ac')} AS ac
 FROM cost_lines GROUP BY project, month""",
    "ledger_lines": "SELECT * REPLACE (regexp_replace(main_code,'^Brand#','B.') AS main_code) FROM cost_lines",
    "direct_details": f"""
 SELECT project, main_code, division, main_code||' '||division AS description, bac AS original_budget, bac, ev, ac,
  CAST(NULL AS DOUBLE) AS cv, work_qty, CASE WHEN regionkey<>2 THEN work_qty*1.25 END AS final_qs_qty,
  round(ev/bac,6) AS invoice_pct, bac-ev AS etc, CASE WHEN regionkey<>3 THEN ac+(bac-ev) END AS eac,
  CAST(NULL AS DOUBLE) AS vac
 FROM (SELECT project, regionkey, main_code, division, {S('bac')} bac, {S('ev')} ev, {S('ac')} ac,
  {S('work_qty')} work_qty FROM ledger_lines WHERE raw_di='D' GROUP BY ALL)""",
    "indirect_details": f"""
 SELECT project, main_code, 'Indirect '||main_code AS description, bac AS original_budget, ev, ac, ev-ac AS cv, bac
 FROM (SELECT project, main_code, {S('bac')} bac, {S('ev')} ev, {S('ac')} ac
  FROM ledger_lines WHERE raw_di='I' GROUP BY ALL)""",
    "boq_resources": f"""
 SELECT project, main_code, resource, {S('ac')} AS actual_cost, {S('work_qty')} AS work_qty, {S('bac')} AS eac
 FROM ledger_lines WHERE raw_di='D' GROUP BY ALL""",
    "ledger_months_detail": f"""
 SELECT project, main_code, resource, source, raw_di AS di, month, {S('work_qty')} AS qty, {S('ac')} AS total
 FROM ledger_lines GROUP BY ALL""",
    "ledger": f"""
 SELECT project, main_code, resource, source, di, {S('total')} AS total_cost, {S('qty')} AS total_qty,
  count(*) AS n_months FROM ledger_months_detail GROUP BY project, main_code, resource, source, di""",
    "cash": f"""
 SELECT coalesce(i.project,o.project) AS project, coalesce(i.month,o.month) AS month, cash_in, cash_out FROM
 (SELECT n_name AS project, strftime(o_orderdate,'%Y-%m') AS month,
   {S('o_totalprice*(n_regionkey+7)/10')} AS cash_in
  FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2) i
 FULL OUTER JOIN (SELECT project, month, {S('ac')} AS cash_out FROM cost_lines GROUP BY 1,2) o
 ON i.project=o.project AND i.month=o.month""",
    "cashflow": f"""
 SELECT project, month, cash_in, cash_out, {RUN('coalesce(cash_in,0)')} AS cash_in_cum,
  {RUN('coalesce(cash_out,0)')} AS cash_out_cum FROM cash""",
    "model": f"""
 SELECT lower(replace(c.project,'_','-')) AS id, c.project AS name, regionkey, period,
  sha256(c.project||'|'||period) AS fingerprint,
  contract AS m_contract_value, bac AS m_budget, ev AS m_earned_value, ac AS m_actual_cost,
  ac_d AS m_direct_cost, ac_i AS m_indirect_cost, CASE WHEN regionkey<>3 THEN revenue END AS m_revenue,
  CASE WHEN regionkey<>4 THEN revenue-ac END AS m_gross_profit,
  CASE WHEN regionkey<>3 THEN contract END AS k_contract_price_dashboard,
  CASE WHEN regionkey NOT IN (2,3) THEN contract END AS k_total_price_project_summary,
  CASE WHEN regionkey<>1 THEN bac END AS k_total_budget_cost, bac_d AS k_direct_budget_cost,
  CASE WHEN regionkey<>0 THEN bac_i END AS k_indirect_budget_cost,
  CASE WHEN regionkey<>1 THEN ev END AS k_ev_dashboard_scope,
  CASE WHEN regionkey<>2 THEN ev*1.02::DOUBLE END AS k_ev_total_project_scope,
  CASE WHEN regionkey<>1 THEN ac END AS k_actual_cost_dashboard_scope,
  CASE WHEN regionkey<>2 THEN ac*1.03::DOUBLE END AS k_actual_cost_total_project_scope,
  CASE WHEN regionkey<>3 THEN ac_d END AS k_direct_actual, CASE WHEN regionkey<>3 THEN ac_i END AS k_indirect_actual,
  CASE WHEN regionkey=1 THEN ac*1.04::DOUBLE ELSE ac END AS k_ledger_accounting_cost,
  ac_d AS k_ledger_raw_direct, ac_i AS k_ledger_raw_indirect,
  CASE WHEN regionkey<>4 THEN revenue END AS k_revenue_gross_profit
 FROM (SELECT project, min(regionkey) regionkey, max(month) period, {S('bac')} bac, {S('ev')} ev, {S('ac')} ac,
   {S("CASE WHEN raw_di='D' THEN bac END")} bac_d, {S("CASE WHEN raw_di='D' THEN ac END")} ac_d,
   {S("CASE WHEN raw_di='I' THEN bac END")} bac_i, {S("CASE WHEN raw_di='I' THEN ac END")} ac_i
   FROM cost_lines GROUP BY project) c
 JOIN (SELECT n_name AS project, {S('o_totalprice')} contract, {S('o_totalprice*(n_regionkey+7)/10')} revenue
   FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1) i
 ON c.project=i.project""",
    "methods": """
 SELECT name AS project, regionkey, 0 AS idx, 'Contract method' AS method, m_contract_value AS base,
  m_actual_cost AS cost, CAST(NULL AS DOUBLE) AS deductions, m_contract_value-m_actual_cost AS profit,
  CASE WHEN m_contract_value<>0 THEN (m_contract_value-m_actual_cost)/m_contract_value END AS profit_pct FROM model
 UNION ALL
 SELECT name, regionkey, 1, 'Revenue method', m_revenue, m_actual_cost, m_revenue*0.02::DOUBLE,
  m_revenue-m_actual_cost-m_revenue*0.02::DOUBLE,
  CASE WHEN regionkey<>2 AND m_revenue<>0 THEN (m_revenue-m_actual_cost-m_revenue*0.02::DOUBLE)/m_revenue END
 FROM model WHERE m_revenue IS NOT NULL AND regionkey<>4""",
    "base": """
 SELECT id, name, model.regionkey, period, fingerprint,
  coalesce(k_contract_price_dashboard,m_contract_value,0) AS contract,
  coalesce(k_total_price_project_summary,k_contract_price_dashboard,m_contract_value,0) AS price,
  coalesce(k_total_budget_cost,m_budget,0) AS budget, coalesce(k_direct_budget_cost,0) AS direct_budget,
  coalesce(k_indirect_budget_cost,0) AS indirect_budget,
  coalesce(k_ev_dashboard_scope,m_earned_value,0) AS ev_dashboard,
  coalesce(k_ev_total_project_scope,k_ev_dashboard_scope,m_earned_value,0) AS ev_total,
  coalesce(k_actual_cost_dashboard_scope,m_actual_cost,0) AS ac_dashboard,
  coalesce(k_actual_cost_total_project_scope,k_actual_cost_dashboard_scope,m_actual_cost,0) AS ac_total,
  coalesce(k_direct_actual,m_direct_cost,0) AS direct_ac, coalesce(k_indirect_actual,m_indirect_cost,0) AS indirect_ac,
  coalesce(k_ledger_accounting_cost,0) AS ledger, coalesce(k_revenue_gross_profit,r.base,m_revenue,0) AS revenue,
  coalesce(r.profit,m_gross_profit,0) AS gp, coalesce(r.profit_pct,0) AS gp_pct, coalesce(r.deductions,0) AS deductions
 FROM model LEFT JOIN (SELECT * FROM methods QUALIFY row_number() OVER (PARTITION BY project ORDER BY
  CASE WHEN lower(method) LIKE '%revenue%' THEN 0 ELSE 1 END, idx)=1) r ON r.project=model.name""",
    "scoped": """
 SELECT *, ev_dashboard AS ev, ac_dashboard AS ac, ev_dashboard-ac_dashboard AS cv,
  CASE WHEN ac_dashboard<>0 THEN ev_dashboard/ac_dashboard END AS cpi, indirect_budget-indirect_ac AS indirect_var
 FROM base""",
}
NEEDS: dict[str, list[str]] = {
    "work_packages": ["cost_lines"],
    "project_months": ["cost_lines"],
    "ledger_lines": ["cost_lines"],
    "direct_details": ["ledger_lines"],
    "indirect_details": ["ledger_lines"],
    "boq_resources": ["ledger_lines"],
    "ledger_months_detail": ["ledger_lines"],
    "ledger": ["ledger_months_detail"],
    "cash": ["cost_lines"],
    "cashflow": ["cash"],
    "model": ["cost_lines"],
    "methods": ["model"],
    "base": ["model", "methods"],
    "scoped": ["base"],
}


def define(name: str, sql: str, *needs: str) -> None:
    """Add a named oracle CTE."""
    CTE[name] = sql
    NEEDS[name] = list(needs)


def sql_with(body: str, *ctes: str) -> str:
    """A statement: the CTEs it needs, in order, then the body."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for c in ctes:
        add(c)
    if not order:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + body.strip()
