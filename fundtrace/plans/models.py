"""Queries of model jobs, attributions and the remaining selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundtrace.operators import evaluation as ev
from fundtrace.operators import models as md
from fundtrace.operators.joins import first_by
from fundtrace.operators.scores import number_rows
from fundtrace.plans.fixtures import EVENTS
from fundtrace.plans.registry import Views, query
from fundtrace.sources import tables as st
from fundtrace.sources.scratch import written

FEATURES = ["bond", "exp_ratio", "turn_ratio", "mret"]


def _rows(v: Views):
    v.keep(*EVENTS)
    e = v.fx_events.withColumn("event_id", F.concat_ws("_", "portfolio", "report_dt")).where("d_bond is not null")
    rows = ev.inner_split(e.withColumn("y", (F.col("d_bond") > 0).cast("int")), "report_dt").select("event_id", "split", "y", "d_bond", *FEATURES)
    return written(rows, "model-rows")


@query("m01_feature_inference", "SELECT 'bond' AS feature, count(bond) AS known, count(bond) AS numeric, count(bond) >= 20 AS usable FROM {fx_events} UNION ALL SELECT 'manager', count(manager), 0, false FROM {fx_events}")
def feature_inference(v: Views):
    return md.infer_features(v.fx_events, ["bond", "manager"])


@query("m05_direction_models")
def direction_models(v: Views):
    scores = written(md.fit_direction(_rows(v), FEATURES), "scores")  # read by three jobs; each would ask every model anew
    return md.choose(scores, "candidate")


WEIGHTS, MEANS = {"bond": 2.0, "mret": -3.0}, {"bond": 0.33, "mret": 0.0}


@query("m24_linear_attribution", """
SELECT portfolio, report_dt, 'bond' AS feature, round((bond - 0.33) * 2, 6) AS contribution, round(0.1 + 0.66, 6)::DOUBLE AS base FROM {fx_events} UNION ALL SELECT portfolio, report_dt, 'mret', round(mret * -3, 6), round(0.76, 6)::DOUBLE FROM {fx_events}""")
def linear_attribution(v: Views):
    rows = v.fx_events.withColumn("k", F.struct("portfolio", "report_dt"))
    return md.linear_contributions(rows, WEIGHTS, MEANS, 0.1, "k").select("k.portfolio", "k.report_dt", "feature", "contribution", "base")


@query("m24_additivity_check", "SELECT 0 AS broken")
def additivity_check(v: Views):
    rows = v.fx_events.withColumn("k", F.struct("portfolio", "report_dt"))
    total = md.linear_contributions(rows, WEIGHTS, MEANS, 0.1, "k").groupBy("k").agg((F.sum("contribution") + F.max("base")).alias("total"))
    score = rows.select("k", (0.1 + 2 * F.col("bond") - 3 * F.col("mret")).alias("score"))
    return total.join(score, "k").agg(F.count_if(F.abs(F.col("total") - F.col("score")) > 1e-8).cast("int").alias("broken"))


def _deviations(v: Views):
    rows = v.fx_events.withColumn("k", F.struct("portfolio", "report_dt")).withColumn("score", F.col("bond") + F.col("turn_ratio"))
    return md.deviation_contributions(rows, {"bond": 0.7, "turn_ratio": 0.3}, "k", "score")


@query("m25_deviation_attribution", """
WITH m AS (SELECT median(bond) AS b, median(turn_ratio) AS t FROM {fx_events})
SELECT portfolio, report_dt, round((bond - b) * 0.7, 6) AS bond_part, round(bond + turn_ratio - (bond - b) * 0.7 - (turn_ratio - t) * 0.3, 6) AS base FROM {fx_events}, m""")
def deviation_attribution(v: Views):
    return _deviations(v).where("feature = 'bond'").select("k.portfolio", "k.report_dt", F.col("contribution").alias("bond_part"), "base")


@query("m26_global_importance", """
WITH m AS (SELECT median(bond) AS b, median(turn_ratio) AS t FROM {fx_events}) SELECT 'bond' AS feature, round(avg(abs((bond - b) * 0.7)), 6) AS importance, round(sum(greatest((bond - b) * 0.7, 0)), 4) AS up FROM {fx_events}, m UNION ALL SELECT 'turn_ratio', round(avg(abs((turn_ratio - t) * 0.3)), 6), round(sum(greatest((turn_ratio - t) * 0.3, 0)), 4) FROM {fx_events}, m""")
def global_importance(v: Views):
    c = F.col("contribution")
    return _deviations(v).groupBy("feature").agg(F.avg(F.abs(c)).alias("importance"), F.round(F.sum(F.greatest(c, F.lit(0.0))), 4).alias("up"))


@query("k06_top_features", """
WITH m AS (SELECT median(bond) AS b, median(turn_ratio) AS t FROM {fx_events}) SELECT portfolio, report_dt, CASE WHEN abs((bond - b) * 0.7) >= abs((turn_ratio - t) * 0.3) THEN 'bond' ELSE 'turn_ratio' END AS feature FROM {fx_events}, m""")
def top_features(v: Views):
    return md.top_features(_deviations(v), "k", 1).select("k.portfolio", "k.report_dt", "feature")


@query("m27_clusters")
def clusters(v: Views):
    return md.clusters(v.embeddings, "vec_id", "embedding")


@query("a38_cluster_composition")
def cluster_composition(v: Views):
    c = md.clusters(v.embeddings, "vec_id", "embedding").join(v.embeddings.select("vec_id", "label"), "vec_id")
    return c.groupBy("cluster").agg(F.count("*").alias("size"), F.mode("label", deterministic=True).alias("main_label"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("quartiles"))


@query("m28_greedy_groups")
def greedy_groups(v: Views):
    scores = v.fx_port_month.groupBy("manager").agg(F.array(F.avg("exp_ratio") * 20 - 0.79, F.avg("turn_ratio") * 2 - 1, F.avg("mret") * 1000).alias("v"))
    return md.greedy_groups(scores, "manager", "v")


@query("j21_trailing_self_join", """
WITH d AS (SELECT DISTINCT manager, report_dt FROM {fx_events}) SELECT a.manager, a.report_dt, count(b.report_dt) AS n FROM d a LEFT JOIN d b ON a.manager = b.manager AND b.report_dt < a.report_dt AND b.report_dt >= a.report_dt - INTERVAL 36 MONTH GROUP BY 1, 2""")
def trailing_self_join(v: Views):
    d = v.fx_events.select("manager", "report_dt").distinct()
    b = d.toDF("m", "before")
    return d.join(b, (F.col("manager") == F.col("m")) & (F.col("before") < F.col("report_dt")) & (F.col("before") >= F.add_months("report_dt", -36)), "left").groupBy("manager", "report_dt").agg(F.count("before").alias("n"))


@query("p01_fund_month_derivation", """
SELECT fund, f.caldt, round(mret - coalesce(bret, 0.1 / 12), 6) AS excess, round(new_sls - redemp, 2) AS net_flow, round(greatest((f.caldt - DATE '1995-06-30') / 365.25, 0), 6) AS tenure, year(f.caldt)::INTEGER AS year, coalesce(manager, 'Unknown Manager') AS manager FROM {fx_fund_month} f LEFT JOIN {fx_benchmark} USING (month_idx)""")
def fund_month_derivation(v: Views):
    f = v.fx_fund_month.join(v.fx_benchmark.drop("caldt"), "month_idx", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tenure = F.greatest(F.datediff("caldt", F.lit("1995-06-30").cast("date")) / 365.25, F.lit(0.0))
    return f.select("fund", "caldt", (F.col("mret") - F.coalesce("bret", F.lit(0.1 / 12))).alias("excess"), F.round(zero("new_sls") - zero("redemp"), 2).alias("net_flow"), tenure.alias("tenure"), F.year("caldt").alias("year"), F.coalesce("manager", F.lit("Unknown Manager")).alias("manager"))


@query("p06_report_filter", "SELECT portfolio, report_dt FROM {fx_events} WHERE report_dt BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND manager IN (SELECT n_name FROM {nation} WHERE n_regionkey = 1) ORDER BY 2, 1")
def report_filter(v: Views):
    m = v.nation.where("n_regionkey = 1").select(F.col("n_name").alias("manager"))
    return v.fx_events.where(F.col("report_dt").between("1996-01-01", "1998-12-31")).join(m, "manager", "left_semi").select("portfolio", "report_dt").orderBy("report_dt", "portfolio")


@query("p12_horizon_slice", "SELECT portfolio, report_dt FROM {fx_events} WHERE d_bond IS NOT NULL AND CAST(date_trunc('month', report_dt) + INTERVAL 7 MONTH - INTERVAL 1 DAY AS DATE) <= DATE '2000-12-31'")
def horizon_slice(v: Views):
    from fundtrace.streaming.monthly import mature_labels

    return mature_labels(v.fx_events, "report_dt", 6, "2000-12-31").where("label_available and d_bond is not null").select("portfolio", "report_dt")


@query("p14_manager_choice", """
WITH n AS (SELECT manager, count(*) AS c FROM {fx_events} GROUP BY 1), w AS (SELECT 'NATION_3' AS a UNION ALL SELECT 'nation_1'), x AS (SELECT a, manager, c, CASE WHEN manager = a THEN 0 ELSE 1 END AS how FROM w JOIN n ON manager = a OR contains(lower(manager), lower(a)))
SELECT a AS wanted, manager FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY how, c DESC, manager) AS k FROM x) WHERE k = 1""")
def manager_choice(v: Views):
    n = v.fx_events.groupBy("manager").agg(F.count("*").alias("c"))
    wanted = F.broadcast(v.spark.createDataFrame([("NATION_3",), ("nation_1",)], "wanted string"))  # what the caller names
    x = n.join(wanted, (F.col("manager") == F.col("wanted")) | F.lower("manager").contains(F.lower("wanted")))
    return first_by(x, ["wanted"], [(F.col("manager") != F.col("wanted")).cast("int"), F.desc("c"), F.col("manager")]).select("wanted", "manager")


@query("p15_case_flags", """
SELECT portfolio, report_dt, stock IS NOT NULL AND cash IS NOT NULL AS clean, coalesce(greatest(abs(d_stock), abs(d_bond)) >= 0.03, false) AS clear_action, d_bond IS NOT NULL AS has_outcome, round(coalesce(stock, 0) * mret, 6) AS stock_x_market, CASE WHEN bond IS NULL AND cash IS NULL THEN NULL ELSE round(coalesce(bond, 0) + coalesce(cash, 0), 6) END AS non_stock FROM {fx_events}""")
def case_flags(v: Views):
    non_stock = F.when(F.col("bond").isNull() & F.col("cash").isNull(), None).otherwise(F.coalesce("bond", F.lit(0.0)) + F.coalesce("cash", F.lit(0.0)))
    clear = F.coalesce(F.greatest(F.abs("d_stock"), F.abs("d_bond")) >= 0.03, F.lit(False))
    return v.fx_events.select("portfolio", "report_dt", (F.col("stock").isNotNull() & F.col("cash").isNotNull()).alias("clean"), clear.alias("clear_action"), F.col("d_bond").isNotNull().alias("has_outcome"), (F.coalesce("stock", F.lit(0.0)) * F.col("mret")).alias("stock_x_market"), non_stock.alias("non_stock"))


@query("k03_newest_rows", "SELECT doc_id, doc_date FROM {fx_docs} WHERE doc_date IS NOT NULL ORDER BY doc_date DESC, doc_id LIMIT 50")
def newest_rows(v: Views):
    return v.fx_docs.where("doc_date is not null").orderBy(F.desc("doc_date"), "doc_id").limit(50).select("doc_id", "doc_date")


@query("l18_capability_status", "SELECT lang, count(*) AS n, CASE WHEN count(*) < 40 THEN 'not_eligible' WHEN abs(avg(p) - avg(y)) > 0.2 THEN 'calibration_warning' ELSE 'ok' END AS status FROM {fx_scores} GROUP BY 1")
def capability_status(v: Views):
    s = v.fx_scores.groupBy("lang").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return s.select("lang", "n", F.when(F.col("n") < 40, "not_eligible").when(F.abs(F.col("p") - F.col("y")) > 0.2, "calibration_warning").otherwise("ok").alias("status"))


@query("s06_ticker_aliases", """
WITH t AS (SELECT DISTINCT replace(p_brand, '#', CASE WHEN p_size % 2 = 0 THEN '.' ELSE '-' END) AS t FROM {part}), a AS (SELECT t, unnest(list_distinct([t, replace(t, '.', '-'), replace(t, '-', '.')])) AS alias FROM t)
SELECT alias, t FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY (alias <> t)::INT, t) AS n FROM a) WHERE n = 1""")
def ticker_alias_rows(v: Views):
    from fundtrace.functions.ingest import ticker_aliases

    t = v.part.select(F.replace("p_brand", F.lit("#"), F.when(F.col("p_size") % 2 == 0, ".").otherwise("-")).alias("t")).distinct()
    return st.with_aliases(t, "t", ticker_aliases(F.col("t")), []).select("alias", "t")
