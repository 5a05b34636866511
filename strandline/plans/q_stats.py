"""Queries of the summaries and group statistics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from strandline.operators import resampling as B
from strandline.operators import stats as S
from strandline.operators import summaries as U
from strandline.plans.q_tracks import rounded
from strandline.plans.fixtures import view
from strandline.plans.registry import ORACLE_SQL, QUERIES, query

RM = "recording_metrics"
METRICS = ["mean_speed", "mean_area", "n_cells"]
LONG = """
wide AS (SELECT {grp} AS grp, mean_speed::DOUBLE AS mean_speed, mean_area::DOUBLE AS mean_area, n_cells::DOUBLE AS n_cells FROM recording_metrics {where}),
vals AS (SELECT metric, grp, value FROM (UNPIVOT wide ON mean_speed, mean_area, n_cells INTO NAME metric VALUE value) u WHERE value IS NOT NULL)
"""
BY_GRP, TWO = LONG.format(grp="grp", where=""), LONG.format(grp="cohort", where="WHERE cohort IN ('F', 'O')")
PAIRS = """,
s AS (SELECT metric, grp, count(*)::DOUBLE AS n, avg(value) AS m, var_samp(value) AS v FROM vals GROUP BY ALL HAVING count(*) >= 2),
pairs AS (SELECT a.metric, a.grp AS grp_a, b.grp AS grp_b, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb FROM s a JOIN s b ON a.metric = b.metric AND a.grp < b.grp),
welch AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS statistic, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df1,
  (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM pairs)
"""
RANKS = """,
cnt AS (SELECT metric, value, count(*) AS t FROM vals GROUP BY ALL),
rk AS (SELECT metric, value, t, coalesce(sum(t) OVER (PARTITION BY metric ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0::DOUBLE AS rank FROM cnt),
tied AS (SELECT metric, sum(pow(t, 3) - t) AS ties, sum(t)::DOUBLE AS total FROM cnt GROUP BY ALL),
rs AS (SELECT metric, grp, sum(rank) AS r, count(*)::DOUBLE AS n FROM vals JOIN rk USING (metric, value) GROUP BY ALL)
"""
#: Tails of the tests' distributions as ratios of two integrals of one density, by Simpson's rule: the t and F tails over the angle whose
#: squared sine is the beta variable, normal and chi-square tails over the root of the chi-square variable.
TAILS = """,
span AS (SELECT *, CASE kind WHEN 'z' THEN 0 ELSE df1 - 1 END AS c, CASE kind WHEN 'f' THEN df2 - 1 ELSE 0 END AS d,
  CASE kind WHEN 't' THEN atan(abs(raw) / sqrt(df1)) WHEN 'f' THEN 0 WHEN 'z' THEN abs(raw) ELSE sqrt(greatest(raw, 0)) END AS lo,
  CASE kind WHEN 't' THEN pi() / 2 WHEN 'f' THEN asin(sqrt(df2 / (df2 + df1 * raw))) WHEN 'z' THEN abs(raw) + 40 ELSE sqrt(greatest(raw, 0)) + 40 END AS hi, CASE WHEN kind IN ('t', 'f') THEN pi() / 2 ELSE 40 END AS whole FROM tests),
bits AS (SELECT *, CASE WHEN i = 0 OR i = 20000 THEN 1 ELSE 2 + 2 * (i % 2) END AS w, lo + (hi - lo) * i / 20000 AS u, whole * i / 20000 AS v FROM span CROSS JOIN range(0, 20001) r(i)),
tail AS (SELECT metric, test, kind, max(statistic) AS statistic, max(df1) AS df1, max(df2) AS df2, max(hi - lo) * sum(w * CASE WHEN kind IN ('t', 'f') THEN pow(abs(cos(u)), c) * pow(sin(u), d) ELSE pow(u, c) * exp(-u * u / 2) END)
  / (max(whole) * sum(w * CASE WHEN kind IN ('t', 'f') THEN pow(abs(cos(v)), c) * pow(sin(v), d) ELSE pow(v, c) * exp(-v * v / 2) END)) AS p FROM bits GROUP BY metric, test, kind)
"""
MARK = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END"
MORE = """SELECT metric, 'anova' AS test, 'f' AS kind, f AS statistic, f AS raw, k - 1 AS df1, n - k AS df2
  FROM (SELECT metric, k, n, ((nmm - nm * nm / n) / (k - 1)) / (w / (n - k)) AS f FROM (SELECT metric, count(*)::DOUBLE AS k, sum(n) AS n, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum((n - 1) * v) AS w FROM s GROUP BY ALL) x) x
UNION ALL SELECT metric, 'kruskal_wallis', 'chi2', h, h, k - 1, 0 FROM (SELECT metric, k, (12 / (total * (total + 1)) * q - 3 * (total + 1)) / (1 - ties / (pow(total, 3) - total)) AS h
  FROM (SELECT metric, count(*)::DOUBLE AS k, sum(r * r / n) AS q FROM rs GROUP BY ALL) x JOIN tied USING (metric)) x"""
BOTH = """SELECT metric || '_by_cohort', 'welch_t', 't', statistic, statistic, df1, 0 FROM welch2
UNION ALL SELECT metric || '_by_cohort', 'mann_whitney_u', 'z', u, (abs(u - n1 * n2 / 2) - 0.5::DOUBLE) / sqrt(n1 * n2 / 12 * (total + 1 - ties / (total * (total - 1)))), 0, 0
  FROM (SELECT a.metric, a.r - a.n * (a.n + 1) / 2 AS u, a.n AS n1, b.n AS n2, ties, total FROM rs2 a JOIN rs2 b ON a.metric = b.metric AND a.grp = 'F' AND b.grp = 'O' JOIN tied2 t ON t.metric = a.metric) x"""


def second(ctes: str) -> str:
    """The common table expressions under names that end in 2."""
    return re.sub(r"\b(wide|vals|s|pairs|welch|cnt|rk|tied|rs)\b", r"\g<1>2", ctes)


def by_grp(rm):
    return S.long_metrics(rm, METRICS)


def two(rm):
    return S.long_metrics(rm.where("cohort in ('F', 'O')"), METRICS, "cohort")


@query("group_stats", RM, ctes=BY_GRP, sql="""SELECT metric, grp, count(*) AS n, round(avg(value), 5) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END, 5) AS std,
  round(CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END / sqrt(count(*)), 5) AS sem, round(median(value), 5) AS median FROM vals GROUP BY ALL""")
def group_stats(rm):
    return rounded(S.group_stats(by_grp(rm)), "mean", "std", "sem", "median", n=5)


@query("cohens_d", RM, ctes=BY_GRP + PAIRS, sql="SELECT metric, grp_a, grp_b, round(d, 8) AS d FROM welch")
def cohens_d(rm):
    return rounded(S.cohens_d(by_grp(rm)), "d", n=8)


@query("welch_t", RM, ctes=BY_GRP + PAIRS, sql="SELECT metric, grp_a, grp_b, round(statistic, 6) AS statistic, round(df1, 4) AS df1 FROM welch")
def welch_t(rm):
    return rounded(rounded(S.welch_t(by_grp(rm)), "statistic"), "df1", n=4)


@query("mann_whitney_u", RM, ctes=TWO + RANKS, sql="""SELECT metric, round(u, 1) AS u, round((abs(u - n1 * n2 / 2) - 0.5::DOUBLE) / sqrt(n1 * n2 / 12 * (total + 1 - ties / (total * (total - 1)))), 6) AS statistic
FROM (SELECT a.metric, a.r - a.n * (a.n + 1) / 2 AS u, a.n AS n1, b.n AS n2, ties, total FROM rs a JOIN rs b ON a.metric = b.metric AND a.grp = 'F' AND b.grp = 'O' JOIN tied t ON t.metric = a.metric) x""")
def mann_whitney_u(rm):
    return rounded(rounded(S.mann_whitney_u(two(rm), "F", "O").select("metric", "u", "statistic"), "u", n=1), "statistic")


@query("anova_oneway", RM, ctes=BY_GRP + PAIRS, sql="""SELECT metric, round(((nmm - nm * nm / n) / (k - 1)) / (w / (n - k)), 5) AS statistic, k - 1 AS df1, n - k AS df2
FROM (SELECT metric, count(*)::DOUBLE AS k, sum(n) AS n, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum((n - 1) * v) AS w FROM s GROUP BY ALL) x""")
def anova_oneway(rm):
    return rounded(S.anova_oneway(by_grp(rm)), "statistic", n=5)


@query("kruskal_wallis", RM, ctes=BY_GRP + RANKS, sql="""SELECT metric, round((12 / (total * (total + 1)) * q - 3 * (total + 1)) / (1 - ties / (pow(total, 3) - total)), 4) AS statistic, k - 1 AS df1
FROM (SELECT metric, count(*)::DOUBLE AS k, sum(r * r / n) AS q FROM rs GROUP BY ALL) x JOIN tied USING (metric)""")
def kruskal_wallis(rm):
    return rounded(S.kruskal_wallis(by_grp(rm)), "statistic", n=4)


@query("pairwise_bonferroni", RM, ctes=BY_GRP + PAIRS + ",\ntests AS (SELECT metric, grp_a || '/' || grp_b AS test, 't' AS kind, statistic, statistic AS raw, df1, 0 AS df2 FROM welch)" + TAILS + """,
times AS (SELECT metric, grp_a, grp_b, tail.statistic, least(1, p * count(*) OVER (PARTITION BY metric)) AS p, d FROM tail JOIN welch USING (metric) WHERE test = grp_a || '/' || grp_b)
""", sql=f"SELECT metric, grp_a, grp_b, round(statistic, 6) AS statistic, round(p, 6) AS p, round(d, 6) AS d, {MARK} AS marker FROM times")
def pairwise_bonferroni(rm):
    return rounded(S.pairwise_bonferroni(by_grp(rm)), "statistic", "p", "d")


@query("significance_marker", RM, ctes=BY_GRP + PAIRS, sql="SELECT metric, grp_a, grp_b, CASE WHEN abs(d) / 10 < 0.001 THEN '***' WHEN abs(d) / 10 < 0.01 THEN '**' WHEN abs(d) / 10 < 0.05 THEN '*' ELSE 'ns' END AS marker FROM welch")
def significance_marker(rm):
    return S.cohens_d(by_grp(rm)).select("metric", "grp_a", "grp_b", S.significance_marker(F.abs("d") / 10).alias("marker"))


@query("group_comparison", RM, ctes=BY_GRP + PAIRS + RANKS + "," + second(TWO + PAIRS + RANKS) + f",\ntests AS ({MORE}\nUNION ALL {BOTH})" + TAILS,
       sql=f"SELECT metric, test, kind, round(statistic, 4) AS statistic, round(df1, 4) AS df1, round(df2::DOUBLE, 4) AS df2, round(p, 6) AS p, {MARK} AS marker FROM tail")
def group_comparison(rm):
    both = S.group_comparison(by_grp(rm)).unionByName(S.group_comparison(two(rm).withColumn("metric", F.concat("metric", F.lit("_by_cohort")))))
    return rounded(rounded(both, "p"), "statistic", "df1", "df2", n=4)


@query("comparison_text", RM, ctes=BY_GRP + PAIRS + RANKS + f",\ntests AS ({MORE})" + TAILS,
       sql=f"SELECT metric, string_agg(printf('%s: %.4f (p=%s) %s', test, statistic, CASE WHEN p < 0.0001 THEN printf('%.3e', p) ELSE printf('%.' || (3 - floor(log10(p)))::INT || 'f', p) END, {MARK}), chr(10) ORDER BY test) AS report FROM tail GROUP BY metric")
def comparison_text(rm):
    return S.comparison_text(S.group_comparison(by_grp(rm)))


def _part(name: str, item: str, figures: str) -> str:
    """A part of comparison_result from another query's SQL; figures are those that it has."""
    at = lambda c: c if c in figures.split() else f"NULL::{'VARCHAR' if c == 'marker' else 'BIGINT' if c == 'n' else 'DOUBLE'} AS {c}"
    return f"SELECT metric, '{name.split()[0]}' AS part, {item} AS item, {', '.join(map(at, 'n mean std sem median statistic p d marker'.split()))} FROM ({ORACLE_SQL[name.split()[1]]}) {name.split()[0]}s"


def comparison_result(spark, sf_dir):
    out = S.comparison_result(by_grp(view(spark, sf_dir, RM)))
    # Figures of pairs, and p of tests, are rounded to six places first: the SQL takes them from queries that do so.
    six = rounded(out, "p", "d").withColumn("statistic", F.when(F.col("part") == "pair", F.round(F.col("statistic") * 1e6) / 1e6).otherwise(F.col("statistic")))
    return rounded(rounded(six, "mean", "std", "sem", "median", n=5), "statistic", "p", "d", n=4)


QUERIES["comparison_result"] = comparison_result
ORACLE_SQL["comparison_result"] = "SELECT * REPLACE (round(statistic, 4) AS statistic, round(p, 4) AS p, round(d, 4) AS d) FROM (" + " UNION ALL ".join([
    _part("group group_stats", "grp", "n mean std sem median"), _part("test group_comparison", "test", "statistic p marker") + " WHERE metric NOT LIKE '%_by_cohort'",
    _part("pair pairwise_bonferroni", "grp_a || '/' || grp_b", "statistic p d marker")]) + ") x"


@query("bootstrap_ci", RM)
def bootstrap_ci(rm):
    return rounded(B.bootstrap_ci(by_grp(rm)), "mean", "ci_low", "ci_high", "se", n=5)


@query("bootstrap_ci_1000", RM)
def bootstrap_ci_1000(rm):
    """The older name of bootstrap_ci at 1,000 resamples."""
    return bootstrap_ci(rm)


@query("pluggable_statistic", RM, ctes=BY_GRP, sql="SELECT metric, grp, round(max(value) - min(value), 6) AS statistic FROM vals GROUP BY ALL")
def pluggable_statistic(rm):
    return rounded(B.group_statistic(by_grp(rm), B.Extent()), "statistic")


@query("pluggable_bootstrap", RM)
def pluggable_bootstrap(rm):
    """The statistic of pluggable_statistic with its bootstrap interval, which the SQL above does not have."""
    return rounded(B.bootstrap_statistic(by_grp(rm), B.Extent()), "statistic", "ci_low", "ci_high", "se")


@query("normality_check", RM)
def normality_check(rm):
    return S.normality_check(by_grp(rm))


@query("group_summary", RM, sql="""SELECT grp, count(*) AS n, """ + ", ".join(
    f"round(avg({m}), 5) AS {m}_mean, round(stddev_samp({m}), 5) AS {m}_std, round(stddev_samp({m}) / sqrt(count(*)), 5) AS {m}_sem" for m in METRICS) + " FROM recording_metrics GROUP BY grp")
def group_summary(rm):
    out = U.group_summary(rm, "grp", METRICS)
    return rounded(out, *[c for c in out.columns if c not in ("grp", "n")], n=5)


@query("recording_from_cells", RM, sql="SELECT grp, cohort, count(*) AS n_cells, round(avg(mean_speed), 5) AS mean_speed, round(avg(mean_area), 5) AS mean_area FROM recording_metrics GROUP BY ALL")
def recording_from_cells(rm):
    return rounded(U.recording_from_cells(rm, ["mean_speed", "mean_area"], ("grp", "cohort")), "mean_speed", "mean_area", n=5)


@query("metric_values", RM, sql="""SELECT metric, grp, value FROM (UNPIVOT (SELECT grp, mean_speed::DOUBLE AS mean_speed, mean_area::DOUBLE AS mean_area, coalesce(n_cells, 0)::DOUBLE AS n_cells FROM recording_metrics)
  ON mean_speed, mean_area, n_cells INTO NAME metric VALUE value) u WHERE value IS NOT NULL""")
def metric_values(rm):
    return U.metric_values(rm, "grp", METRICS, {"n_cells": 0.0})


@query("metric_pivot", RM, ctes=LONG.format(grp="cohort", where=""), sql="SELECT metric, round(avg(value) FILTER (grp = 'F'), 5) AS F, round(avg(value) FILTER (grp = 'O'), 5) AS O, round(avg(value) FILTER (grp = 'P'), 5) AS P FROM vals GROUP BY metric")
def metric_pivot(rm):
    return rounded(U.metric_pivot(rm, "cohort", METRICS, ["F", "O", "P"]), "F", "O", "P", n=5)


@query("box_stats", RM, ctes="""
q AS (SELECT grp, count(*) AS n, quantile_cont(mean_speed, 0.25) AS q1, quantile_cont(mean_speed, 0.5) AS median, quantile_cont(mean_speed, 0.75) AS q3 FROM recording_metrics WHERE mean_speed IS NOT NULL GROUP BY grp)
""", sql="""SELECT q.grp, q.n, round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3,
  round(min(mean_speed) FILTER (mean_speed BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 5) AS low,
  round(max(mean_speed) FILTER (mean_speed BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 5) AS high, q.n >= 2 AS violin
FROM q JOIN recording_metrics r USING (grp) GROUP BY q.grp, q.n, q1, median, q3""")
def box_stats(rm):
    return rounded(U.box_stats(rm, "grp", "mean_speed"), "q1", "median", "q3", "low", "high", n=5)


@query("batch_status", "run_log", sql="SELECT kind, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM run_log GROUP BY kind")
def batch_status(log):
    return U.batch_status(log)
