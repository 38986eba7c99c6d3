"""SQL text of the oracle queries.

Every builder returns one DuckDB statement over the pre-registered parquet
views.  The fixture pair is declared as CTEs ``d1``/``d2`` (deduplicated
shared columns), the long form as ``L``; statistics follow the textbook / SQL
definitions, independent of the Spark plans they check.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from featurelens.sources.fixtures import FIXTURE_FEATURES, FIXTURE_SQL

FIXTURE_COLUMNS = {k: ["id"] + v for k, v in FIXTURE_FEATURES.items()}
FIXTURE_COLUMNS["f3"] = ["id", "acctbal", "name", "nationkey"]

QGRID = [float(x) for x in np.linspace(0.01, 0.99, 100)]


def SIG(e: str, digits: int = 10) -> str:
    """Round to significant digits; mirrors ``functions.columns.sig``."""
    scale = f"{float(10 ** (digits - 1))!r}"
    mag = f"pow(10, floor(log10(abs({e}))))"
    return (f"(CASE WHEN ({e}) IS NULL THEN NULL WHEN isnan({e}) OR ({e}) = 0 OR isinf({e}) THEN ({e}) "
            f"ELSE round(({e}) / {mag} * {scale}) / {scale} * {mag} END)")


def SIGCOLS(cols: list, inner: str, other: list = (), order: str = "") -> str:
    sel = ", ".join([f"{SIG(c)} AS {c}" for c in cols] + list(other))  # c may be a quoted identifier
    return f"SELECT {sel} FROM ({inner}) _r {order}"


def base(fx: str, dedup: bool = True) -> str:
    s1, s2 = FIXTURE_SQL[fx]
    cols = ", ".join(FIXTURE_COLUMNS[fx])
    distinct = "DISTINCT " if dedup else ""
    feats = FIXTURE_FEATURES[fx]
    casts = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in feats)
    on = ", ".join(feats)
    return (f"WITH r1 AS ({s1}), r2 AS ({s2}), "
            f"d1 AS (SELECT {distinct}{cols} FROM r1), d2 AS (SELECT {distinct}{cols} FROM r2), "
            f"L AS (SELECT 1 AS ds, id, feature, value FROM (UNPIVOT (SELECT id, {casts} FROM d1) "
            f"ON {on} INTO NAME feature VALUE value) "
            f"UNION ALL SELECT 2 AS ds, id, feature, value FROM (UNPIVOT (SELECT id, {casts} FROM d2) "
            f"ON {on} INTO NAME feature VALUE value))")


def _np_bin(v: str, lo: str, hi: str, bins: int = 100) -> str:
    step = f"((({hi}) - ({lo})) / {bins})"
    g0 = f"CAST(floor((({v}) - ({lo})) / (({hi}) - ({lo})) * {bins}) AS INTEGER)"
    g = f"(CASE WHEN {g0} >= {bins} THEN {bins - 1} ELSE {g0} END)"
    return (f"(CASE WHEN {v} < CAST({g} AS DOUBLE) * {step} + {lo} THEN {g} - 1 "
            f"WHEN {g} <> {bins - 1} AND {v} >= CAST({g} + 1 AS DOUBLE) * {step} + {lo} THEN {g} + 1 "
            f"ELSE {g} END)")


def _stats_ctes(k: int = 10) -> str:
    """CTEs shared by comparison and similarity: mom, rk, ks, hm."""
    return f""",
mom AS (SELECT feature,
  count(*) FILTER (WHERE ds = 1) AS n1, count(*) FILTER (WHERE ds = 2) AS n2,
  avg(value) FILTER (WHERE ds = 1) AS mean1, avg(value) FILTER (WHERE ds = 2) AS mean2,
  var_samp(value) FILTER (WHERE ds = 1) AS var1, var_samp(value) FILTER (WHERE ds = 2) AS var2,
  quantile_cont(value, 0.5) FILTER (WHERE ds = 1) AS med1, quantile_cont(value, 0.5) FILTER (WHERE ds = 2) AS med2,
  min(value) AS lo, max(value) AS hi
  FROM L GROUP BY feature HAVING count(*) FILTER (WHERE ds = 1) >= {k} AND count(*) FILTER (WHERE ds = 2) >= {k}),
vc AS (SELECT feature, value, CAST(count(*) FILTER (WHERE ds = 1) AS DOUBLE) AS n1,
  CAST(count(*) FILTER (WHERE ds = 2) AS DOUBLE) AS n2 FROM L GROUP BY feature, value),
rk AS (SELECT feature, value, n1, n2,
  sum(n1) OVER (PARTITION BY feature ORDER BY value) AS c1, sum(n2) OVER (PARTITION BY feature ORDER BY value) AS c2,
  sum(n1) OVER (PARTITION BY feature) AS t1, sum(n2) OVER (PARTITION BY feature) AS t2 FROM vc),
ks AS (SELECT feature, max(abs(c1 / t1 - c2 / t2)) AS ks,
  sum(n1 * ((c1 + c2 - (n1 + n2)) + (n1 + n2 + 1) / 2.0)) AS r1,
  sum((n1 + n2) * (n1 + n2) * (n1 + n2) - (n1 + n2)) AS tie FROM rk GROUP BY feature),
bins AS (SELECT vc.feature, {_np_bin('vc.value', 'm.lo', 'm.hi')} AS bin, sum(vc.n1) AS c1, sum(vc.n2) AS c2
  FROM vc JOIN mom m ON vc.feature = m.feature WHERE m.lo < m.hi GROUP BY 1, 2),
grid AS (SELECT m.feature, g.b AS bin, m.lo, m.hi, m.n1 AS N1, m.n2 AS N2, (m.hi - m.lo) / 100 AS step
  FROM mom m, range(100) g(b) WHERE m.lo < m.hi),
h AS (SELECT g.feature, g.bin, coalesce(b.c1, 0) AS c1, coalesce(b.c2, 0) AS c2, g.step, g.N1, g.N2,
  (CASE WHEN g.bin = 99 THEN g.hi ELSE CAST(g.bin + 1 AS DOUBLE) * g.step + g.lo END)
   - (CAST(g.bin AS DOUBLE) * g.step + g.lo) AS width
  FROM grid g LEFT JOIN bins b ON g.feature = b.feature AND g.bin = b.bin),
hp AS (SELECT feature, c1 / width / N1 * step AS a1, c2 / width / N2 * step AS a2,
  c1 / width / N1 + 1e-10 AS e1, c2 / width / N2 + 1e-10 AS e2 FROM h),
hs AS (SELECT feature, sum(e1) AS s1, sum(e2) AS s2 FROM hp GROUP BY feature),
hm AS (SELECT hp.feature, sum(least(a1, a2)) AS overlap,
  0.5 * sum((e1 / s1) * ln((e1 / s1) / (0.5 * (e1 / s1 + e2 / s2))))
  + 0.5 * sum((e2 / s2) * ln((e2 / s2) / (0.5 * (e1 / s1 + e2 / s2)))) AS jsd
  FROM hp JOIN hs ON hp.feature = hs.feature GROUP BY hp.feature),
core AS (SELECT m.feature, m.n1, m.n2, m.mean1, m.mean2, m.med1, m.med2,
  CASE WHEN ((m.n1 - 1) * m.var1 + (m.n2 - 1) * m.var2) / (m.n1 + m.n2 - 2) > 0
       THEN (m.mean1 - m.mean2) / sqrt(((m.n1 - 1) * m.var1 + (m.n2 - 1) * m.var2) / (m.n1 + m.n2 - 2))
       ELSE 0.0 END AS cohen_d,
  ks.ks, ks.r1 - m.n1 * (m.n1 + 1) / 2.0 AS u1,
  CASE WHEN m.lo = m.hi THEN 1.0 ELSE coalesce(hm.overlap, 0.0) END AS overlap,
  CASE WHEN m.lo = m.hi THEN 0.0 ELSE hm.jsd END AS jsd
  FROM mom m JOIN ks ON m.feature = ks.feature LEFT JOIN hm ON m.feature = hm.feature)"""


def comparison_stats(fx: str) -> str:
    inner = ("SELECT feature AS Feature, mean1 - mean2 AS Mean_Diff, med1 - med2 AS Median_Diff, "
             "cohen_d AS Cohen_d, overlap AS Overlap_Coefficient, ks AS KS_Stat, u1 AS MW_Stat, "
             "CASE WHEN overlap > 0.8 THEN 'Similar' WHEN overlap < 0.5 THEN 'Substantially Different' "
             "ELSE 'Moderately Different' END AS Similarity FROM core")
    return base(fx) + _stats_ctes() + " " + SIGCOLS(
        ["Mean_Diff", "Median_Diff", "Cohen_d", "Overlap_Coefficient", "KS_Stat", "MW_Stat"], inner,
        ["Feature", "Similarity"])


def similarity_stats(fx: str) -> str:
    probs = ", ".join(repr(q) for q in QGRID)
    qc = f""",
qa AS (SELECT feature, quantile_cont(value, [{probs}]) FILTER (WHERE ds = 1) AS a,
  quantile_cont(value, [{probs}]) FILTER (WHERE ds = 2) AS b FROM L GROUP BY feature),
qs AS (SELECT feature, unnest(a) AS x, unnest(b) AS y FROM qa),
qc AS (SELECT feature, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS qcorr
  FROM qs GROUP BY feature)"""
    inner = ("SELECT c.feature AS Feature, ks AS KS_Statistic, cohen_d AS Cohens_d, jsd AS JS_Divergence, "
             "qc.qcorr AS Quantile_Correlation, "
             "((1 - least(jsd, 1.0)) * 0.4 + overlap * 0.4 + (1 - ks) * 0.2) * 100 AS Similarity_Score "
             "FROM core c LEFT JOIN qc ON c.feature = qc.feature")
    return base(fx) + _stats_ctes() + qc + " " + SIGCOLS(
        ["KS_Statistic", "Cohens_d", "JS_Divergence", "Quantile_Correlation", "Similarity_Score"], inner,
        ["Feature"])


def ks_exact(fx: str) -> str:
    """The law of D by all lattice paths: the share of the paths to (i, j) that have met |i/n1 - j/n2| >= D, a diagonal i + j = s at a
    time, in a list over j.  Cumulative counts and D are whole numbers over n1 * n2."""
    laws = """,
n AS (SELECT feature, count(*) FILTER (WHERE ds = 1) AS n1, count(*) FILTER (WHERE ds = 2) AS n2 FROM L GROUP BY feature),
vals AS (SELECT feature, value, count(*) FILTER (WHERE ds = 1) AS c1, count(*) FILTER (WHERE ds = 2) AS c2 FROM L GROUP BY feature, value),
cums AS (SELECT feature, sum(c1) OVER w AS f1, sum(c2) OVER w AS f2 FROM vals WINDOW w AS (PARTITION BY feature ORDER BY value)),
far AS (SELECT feature, n1, n2, CAST(max(abs(f1 * n2 - f2 * n1)) AS BIGINT) AS h FROM cums JOIN n USING (feature)
  WHERE n1 >= 10 AND n2 >= 10 GROUP BY feature, n1, n2),
paths AS (
  SELECT feature, n1, n2, h, CAST(0 AS BIGINT) AS s, list_transform(range(n2 + 1), lambda j: CASE WHEN j = 0 AND h <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS gone
  FROM far
  UNION ALL
  SELECT feature, n1, n2, h, s + 1, list_transform(range(n2 + 1), lambda j: CASE
      WHEN s + 1 - j < 0 OR s + 1 - j > n1 THEN 0.0::DOUBLE
      WHEN abs((s + 1 - j) * n2 - j * n1) >= h THEN 1.0::DOUBLE
      ELSE ((s + 1 - j) * gone[j + 1] + CASE WHEN j > 0 THEN j * gone[j] ELSE 0.0::DOUBLE END) / (s + 1) END)
  FROM paths WHERE s < n1 + n2)"""
    inner = ("SELECT feature AS Feature, n1 AS N1, n2 AS N2, h / (n1 * n2)::DOUBLE AS KS_Statistic, "
             "gone[n2 + 1] AS KS_pvalue FROM paths WHERE s = n1 + n2")
    with_paths = (base(fx) + laws).replace("WITH ", "WITH RECURSIVE ", 1)
    return with_paths + " " + SIGCOLS(["KS_Statistic", "KS_pvalue"], inner, ["Feature", "N1", "N2"])


# ----------------------------------------------------------------- profiles
FIXTURE_NAMES = {"f1": ("F", "O"), "f2": ("en", "other"), "f3": ("customer", "supplier"),
                 "f4": ("orders", "lines"), "f5": ("exact", "rounded"), "f6": ("stored", "measured"),
                 "f7": ("low", "high"), "f8": ("view", "purchase"), "f9": ("F", "O"), "f10": ("F", "O"), "f11": ("first", "second")}
FIXTURE_STRINGS = {"f3": {"name"}}
FIXTURE_PAIRED = {"f4", "f5", "f6", "f11"}


def _q(c: str) -> str:
    return f'"{c}"'


def missingness(fx: str) -> str:
    parts = []
    for d, name in zip(("d1", "d2"), FIXTURE_NAMES[fx]):
        for c in FIXTURE_COLUMNS[fx]:
            parts.append(f"SELECT '{name}' AS Dataset, '{c}' AS Feature, count(*) - count({_q(c)}) AS Missing_Count, "
                         f"(count(*) - count({_q(c)})) / count(*) * 100 AS Missing_Percent FROM {d}")
    return base(fx) + " " + SIGCOLS(["Missing_Percent"], " UNION ALL ".join(parts),
                                     ["Dataset", "Feature", "Missing_Count"])


def _col_flags(fx: str, d: str, c: str) -> str:
    qc = _q(c)
    modal = f"(SELECT max(k) FROM (SELECT count(*) AS k FROM {d} WHERE {qc} IS NOT NULL GROUP BY {qc}))"
    const = f"(count(DISTINCT {qc}) <= 1)"
    near = f"((NOT {const}) AND coalesce({modal} / count({qc}), 0) >= 0.99)"
    return const, near, f"(count({qc}) = 0)"


def _dtype(fx: str, c: str) -> str:
    if c in FIXTURE_STRINGS.get(fx, set()):
        return "'object'"
    qc = _q(c)
    return (f"CASE WHEN any_value(typeof({qc})) IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') "
            f"THEN CASE WHEN count(*) > count({qc}) THEN 'float64' ELSE 'int64' END ELSE 'float64' END")


def feature_summary(fx: str) -> str:
    parts = []
    for d, name in zip(("d1", "d2"), FIXTURE_NAMES[fx]):
        for c in FIXTURE_COLUMNS[fx]:
            const, near, allm = _col_flags(fx, d, c)
            parts.append(f"SELECT '{name}' AS Dataset, '{c}' AS Feature, {_dtype(fx, c)} AS DataType, "
                         f"count(*) - count({_q(c)}) AS Missing_Count, "
                         f"(count(*) - count({_q(c)})) / count(*) * 100 AS Missing_Percent, "
                         f"{const} AS Is_Constant, {near} AS Is_Near_Constant, {allm} AS Is_All_Missing FROM {d}")
    return base(fx) + " " + SIGCOLS(["Missing_Percent"], " UNION ALL ".join(parts),
                                     ["Dataset", "Feature", "DataType", "Missing_Count", "Is_Constant",
                                      "Is_Near_Constant", "Is_All_Missing"])


def overview(fx: str) -> str:
    parts = []
    cols = FIXTURE_COLUMNS[fx]
    strings = FIXTURE_STRINGS.get(fx, set())
    for d, r, name in zip(("d1", "d2"), ("r1", "r2"), FIXTURE_NAMES[fx]):
        width = " + ".join(f"coalesce(strlen(CAST({_q(c)} AS VARCHAR)), 0)" if c in strings else "8"
                           for c in cols)
        flags = []
        for c in cols:
            const, near, allm = _col_flags(fx, d, c)
            flags.append(f"SELECT {const} AS c, {near} AS n, {allm} AS a FROM {d}")
        fl = " UNION ALL ".join(flags)
        parts.append(
            f"SELECT '{name}' AS Dataset, (SELECT count(*) FROM {d}) AS Total_ECGs, {len(cols)} AS Total_Features, "
            f"(SELECT round(sum({width}) / (1024.0 * 1024.0), 2) FROM {d}) AS Memory_Usage_MB, "
            f"(SELECT count(*) - count(DISTINCT id) - max(CASE WHEN id IS NULL THEN 1 ELSE 0 END) FROM {d}) "
            f"AS Duplicate_IDs, "
            f"(SELECT count(*) FROM {r}) - (SELECT count(*) FROM {d}) AS Duplicate_Rows, "
            f"(SELECT count(*) FILTER (WHERE c) FROM ({fl})) AS Constant_Columns, "
            f"(SELECT count(*) FILTER (WHERE n) FROM ({fl})) AS Near_Constant_Columns, "
            f"(SELECT count(*) FILTER (WHERE a) FROM ({fl})) AS All_Missing_Columns")
    return base(fx) + " " + " UNION ALL ".join(parts)


# ------------------------------------------------------------ distributions
_PCT = [("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)]


def distribution_stats(fx: str) -> str:
    n1, n2 = FIXTURE_NAMES[fx]
    pc = ", ".join(f"quantile_cont(value, {q}) AS {k}" for k, q in _PCT)
    ctes = f""",
st AS (SELECT ds, feature, avg(value) AS mean, stddev_pop(value) AS sd, var_pop(value) AS var,
  min(value) AS mn, max(value) AS mx, {pc} FROM L GROUP BY ds, feature),
cm AS (SELECT L.ds, L.feature, avg(power(value - st.mean, 2)) AS m2, avg(power(value - st.mean, 3)) AS m3,
  avg(power(value - st.mean, 4)) AS m4, quantile_cont(abs(value - st.p50), 0.5) AS mad
  FROM L JOIN st ON L.ds = st.ds AND L.feature = st.feature GROUP BY L.ds, L.feature)"""
    inner = (f"SELECT CASE WHEN st.ds = 1 THEN '{n1}' ELSE '{n2}' END AS Dataset, st.feature AS Feature, "
             "mean AS Mean, p50 AS Median, sd AS SD, mn AS Min, mx AS Max, p75 - p25 AS IQR, mad AS MAD, "
             "var AS Variance, CASE WHEN m2 = 0 THEN NULL ELSE m3 / power(m2, 1.5) END AS Skewness, "
             "CASE WHEN m2 = 0 THEN NULL ELSE m4 / (m2 * m2) - 3 END AS Kurtosis, "
             + ", ".join(k for k, _ in _PCT) +
             " FROM st JOIN cm ON st.ds = cm.ds AND st.feature = cm.feature")
    num = ["Mean", "Median", "SD", "Min", "Max", "IQR", "MAD", "Variance", "Skewness", "Kurtosis"] + [k for k, _ in _PCT]
    return base(fx) + ctes + " " + SIGCOLS(num, inner, ["Dataset", "Feature"])


def plausibility(fx: str) -> str:
    n1, n2 = FIXTURE_NAMES[fx]
    paired = fx in FIXTURE_PAIRED
    ref_ds, tgt_ds, ref = (1, 2, n1) if paired else (2, 1, n2)
    ctes = f""",
b AS (SELECT feature, quantile_cont(value, 0.01) AS lower, quantile_cont(value, 0.99) AS upper
  FROM L WHERE ds = {ref_ds} GROUP BY feature),
t AS (SELECT L.feature, L.id, (L.value < b.lower OR L.value > b.upper) AS o FROM L JOIN b ON L.feature = b.feature
  WHERE L.ds = {tgt_ds}),
c AS (SELECT feature, count(*) FILTER (WHERE o) AS n_out, count(*) AS n_valid FROM t GROUP BY feature),
e AS (SELECT feature, list(CAST(id AS VARCHAR) ORDER BY id) AS ex FROM
  (SELECT feature, id, row_number() OVER (PARTITION BY feature ORDER BY id) AS rn FROM t WHERE o AND id IS NOT NULL)
  WHERE rn <= 5 GROUP BY feature)"""
    inner = (f'SELECT b.feature AS Feature, b.lower AS "Lower_Bound_{ref}", b.upper AS "Upper_Bound_{ref}", '
             "coalesce(c.n_out, 0) AS Num_Outside_Range, "
             "CASE WHEN c.n_valid > 0 THEN round_even(coalesce(c.n_out, 0) / c.n_valid * 100, 2) ELSE 0.0 END "
             "AS Pct_Outside_Range, coalesce(e.ex, []::VARCHAR[]) AS Extreme_ECG_ID_Examples, "
             f"'Bounds from {ref}' AS Note FROM b LEFT JOIN c ON b.feature = c.feature "
             "LEFT JOIN e ON b.feature = e.feature")
    return base(fx) + ctes + " " + SIGCOLS(
        [f'"Lower_Bound_{ref}"', f'"Upper_Bound_{ref}"', "Pct_Outside_Range"], inner,
        ["Feature", "Num_Outside_Range", "Extreme_ECG_ID_Examples", "Note"])


def extremes(fx: str, n: int = 20) -> str:
    n1, n2 = FIXTURE_NAMES[fx]
    parts = []
    for label, order in ((f"Top {n}", "value DESC, id ASC"), (f"Bottom {n}", "value ASC, id ASC")):
        parts.append(
            f"SELECT CASE WHEN ds = 1 THEN '{n1}' ELSE '{n2}' END AS Dataset, feature AS Feature, "
            f"'{label}' AS Extreme_Type, list(round_even(value, 4) ORDER BY rn) AS \"Values\", "
            f"list(id ORDER BY rn) AS ECG_IDs FROM (SELECT ds, feature, value, id, "
            f"row_number() OVER (PARTITION BY ds, feature ORDER BY {order}) AS rn FROM L) WHERE rn <= {n} "
            f"GROUP BY ds, feature")
    return base(fx) + " " + " UNION ALL ".join(parts)


def missingness_correlation(fx: str) -> str:
    parts = []
    cols = FIXTURE_COLUMNS[fx]
    for d, name in zip(("d1", "d2"), FIXTURE_NAMES[fx]):
        for i, a in enumerate(cols):
            for b in cols[i + 1:]:
                x = f"CAST({_q(a)} IS NULL AS DOUBLE)"
                y = f"CAST({_q(b)} IS NULL AS DOUBLE)"
                parts.append(f"SELECT '{name}' AS Dataset, '{a}' AS Feature_1, '{b}' AS Feature_2, "
                             f"CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 "
                             f"THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END AS Correlation FROM {d}")
    inner = "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE Correlation IS NOT NULL"
    return base(fx) + " " + SIGCOLS(["Correlation"], inner, ["Dataset", "Feature_1", "Feature_2"])


def missingness_patterns(fx: str) -> str:
    parts = []
    cols = FIXTURE_COLUMNS[fx]
    pat = " || ".join(f"CASE WHEN {_q(c)} IS NULL THEN '1' ELSE '0' END" for c in cols)
    for d, name in zip(("d1", "d2"), FIXTURE_NAMES[fx]):
        parts.append(f"SELECT '{name}' AS Dataset, {pat} AS Pattern, count(*) AS Rows FROM {d} GROUP BY 2")
    return base(fx) + " " + " UNION ALL ".join(parts)


# ----------------------------------------------------------------- outliers
def univariate_outliers(fx: str) -> str:
    n1, n2 = FIXTURE_NAMES[fx]
    feats = FIXTURE_FEATURES[fx]
    grid = " UNION ALL ".join(f"SELECT {d} AS ds, '{f}' AS feature" for d in (1, 2) for f in feats)
    ctes = f""",
grid AS ({grid}),
rows_ AS (SELECT 1 AS ds, count(*) AS rows FROM d1 UNION ALL SELECT 2 AS ds, count(*) AS rows FROM d2),
st AS (SELECT ds, feature, avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.5) AS med FROM L GROUP BY ds, feature),
md AS (SELECT L.ds, L.feature, quantile_cont(abs(L.value - st.med), 0.5) AS mad FROM L JOIN st
  ON L.ds = st.ds AND L.feature = st.feature GROUP BY L.ds, L.feature),
cnt AS (SELECT L.ds, L.feature,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_iqr,
  count(*) FILTER (WHERE sd > 0 AND abs((value - mean) / sd) > 3.0) AS n_z,
  count(*) FILTER (WHERE mad > 0 AND abs(0.6745 * (value - med) / mad) > 3.5) AS n_mad
  FROM L JOIN st ON L.ds = st.ds AND L.feature = st.feature JOIN md ON L.ds = md.ds AND L.feature = md.feature
  GROUP BY L.ds, L.feature),
g AS (SELECT grid.ds, grid.feature, rows_.rows, cnt.n_iqr, cnt.n_z, cnt.n_mad FROM grid
  JOIN rows_ ON grid.ds = rows_.ds LEFT JOIN cnt ON grid.ds = cnt.ds AND grid.feature = cnt.feature
  WHERE rows_.rows >= 50)"""
    parts = []
    for col, method in (("n_iqr", "IQR"), ("n_z", "Z-Score"), ("n_mad", "MAD")):
        parts.append(f"SELECT CASE WHEN ds = 1 THEN '{n1}' ELSE '{n2}' END AS Dataset, 'Univariate' AS Analysis_Type, "
                     f"feature AS Feature_or_Method, '{method}' AS Method, "
                     f"round_even(coalesce({col}, 0) / rows * 100, 2) AS Pct_Outliers FROM g")
    return base(fx) + ctes + " " + SIGCOLS(["Pct_Outliers"], " UNION ALL ".join(parts),
                                           ["Dataset", "Analysis_Type", "Feature_or_Method", "Method"])


# ------------------------------------------------------------------- paired
def record_matching(fx: str) -> str:
    n1, n2 = FIXTURE_NAMES[fx]
    ctes = """,
i1 AS (SELECT DISTINCT id FROM r1 WHERE id IS NOT NULL), i2 AS (SELECT DISTINCT id FROM r2 WHERE id IS NOT NULL),
m AS (SELECT (SELECT count(*) FROM i1 JOIN i2 ON i1.id = i2.id) AS matched,
  (SELECT count(*) FROM i1 WHERE id NOT IN (SELECT id FROM i2)) AS only1,
  (SELECT count(*) FROM i2 WHERE id NOT IN (SELECT id FROM i1)) AS only2,
  (SELECT count(*) FROM i1) AS ids1,
  (SELECT count(*) FROM r1) AS n1, (SELECT count(*) FROM r2) AS n2,
  (SELECT count(*) - count(DISTINCT id) - max(CASE WHEN id IS NULL THEN 1 ELSE 0 END) FROM r1) AS dup1,
  (SELECT count(*) - count(DISTINCT id) - max(CASE WHEN id IS NULL THEN 1 ELSE 0 END) FROM r2) AS dup2)"""
    items = [(f"Records in {n1}", "n1"), (f"Records in {n2}", "n2"), ("Successfully matched", "matched"),
             (f"Present only in {n1}", "only1"), (f"Present only in {n2}", "only2"),
             (f"Duplicate IDs in {n1}", "dup1"), (f"Duplicate IDs in {n2}", "dup2"),
             ("Match percentage (%)", "CASE WHEN ids1 > 0 THEN round_even(matched / ids1 * 100, 2) ELSE 0.0 END")]
    inner = " UNION ALL ".join(f"SELECT '{k}' AS Metric, CAST({v} AS DOUBLE) AS Value FROM m" for k, v in items)
    return base(fx) + ctes + " " + SIGCOLS(["Value"], inner, ["Metric"])


def _pl(fx: str) -> str:
    feats = FIXTURE_FEATURES[fx]
    order = ", ".join(f"CAST({f} AS DOUBLE) ASC NULLS FIRST" for f in feats)
    casts = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in feats)
    k = f"""k1 AS (SELECT * FROM (SELECT id, {casts}, row_number() OVER (PARTITION BY id ORDER BY {order}) AS rn
  FROM r1 WHERE id IS NOT NULL) WHERE rn = 1),
k2 AS (SELECT * FROM (SELECT id, {casts}, row_number() OVER (PARTITION BY id ORDER BY {order}) AS rn
  FROM r2 WHERE id IS NOT NULL) WHERE rn = 1),"""
    pl = " UNION ALL ".join(f"SELECT k1.id, '{f}' AS feature, k1.{f} AS v1, k2.{f} AS v2 FROM k1 JOIN k2 "
                            f"ON k1.id = k2.id WHERE k1.{f} IS NOT NULL AND k2.{f} IS NOT NULL" for f in feats)
    return f",\n{k}\nPL AS ({pl})"


def paired_stats(fx: str) -> str:
    ctes = _pl(fx) + """,
pm AS (SELECT feature, count(*) AS n, avg(v2 - v1) AS mean_d, avg(abs(v2 - v1)) AS mae,
  sqrt(avg((v2 - v1) * (v2 - v1))) AS rmse,
  avg(CASE WHEN v1 <> 0 THEN abs((v2 - v1) / v1) END) * 100 AS mape, stddev_samp(v2 - v1) AS sd_d,
  var_samp(v1) AS s1, var_samp(v2) AS s2, covar_samp(v1, v2) AS c12,
  covar_pop(v1, v2) AS cv, var_pop(v1) AS vx, var_pop(v2) AS vy,
  quantile_cont(v2 - v1, 0.5) AS median_d FROM PL GROUP BY feature HAVING count(*) >= 10),
rr AS (SELECT feature, v1, v2,
  rank() OVER (PARTITION BY feature ORDER BY v1) + (count(*) OVER (PARTITION BY feature, v1) - 1) / 2.0 AS r1,
  rank() OVER (PARTITION BY feature ORDER BY v2) + (count(*) OVER (PARTITION BY feature, v2) - 1) / 2.0 AS r2
  FROM PL),
sp AS (SELECT feature, CASE WHEN var_pop(r1) > 0 AND var_pop(r2) > 0
  THEN covar_pop(r1, r2) / sqrt(var_pop(r1) * var_pop(r2)) END AS spearman FROM rr GROUP BY feature),
wz AS (SELECT feature, v2 - v1 AS d,
  rank() OVER (PARTITION BY feature ORDER BY abs(v2 - v1))
  + (count(*) OVER (PARTITION BY feature, abs(v2 - v1)) - 1) / 2.0 AS r FROM PL WHERE v2 - v1 <> 0),
wx AS (SELECT feature, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0))
  AS w_stat FROM wz GROUP BY feature),
core AS (SELECT pm.*, sp.spearman, wx.w_stat,
  CASE WHEN n >= 3 AND s1 + s2 <> 0 THEN 2 * c12 / (s1 + s2) END AS icc,
  CASE WHEN vx > 0 AND vy > 0 THEN cv / sqrt(vx * vy) END AS pearson,
  CASE WHEN sd_d > 0 THEN -mean_d / (sd_d / sqrt(n)) END AS t_stat
  FROM pm LEFT JOIN sp ON pm.feature = sp.feature LEFT JOIN wx ON pm.feature = wx.feature)"""
    inner = """SELECT feature AS Feature, n AS N_Paired, round_even(mean_d, 6) AS Mean_Diff,
  round_even(median_d, 6) AS Median_Diff, round_even(mae, 6) AS MAE, round_even(rmse, 6) AS RMSE,
  round_even(mape, 4) AS MAPE_pct, round_even(t_stat, 4) AS Paired_t_stat, round_even(w_stat, 4) AS Wilcoxon_stat,
  round_even(pearson, 6) AS Pearson_r, round_even(spearman, 6) AS Spearman_r, round_even(icc, 6) AS ICC,
  round_even(mean_d, 6) AS BlandAltman_MeanDiff, round_even(sd_d, 6) AS BlandAltman_SD,
  round_even(mean_d + 1.96 * sd_d, 6) AS BlandAltman_LoA_Upper, round_even(mean_d - 1.96 * sd_d, 6) AS BlandAltman_LoA_Lower,
  CASE WHEN icc >= 0.95 AND mape < 5 THEN 'Excellent' WHEN icc >= 0.90 AND mape < 10 THEN 'Good'
       WHEN icc >= 0.75 AND mape < 20 THEN 'Moderate' WHEN icc >= 0.50 THEN 'Fair' ELSE 'Poor' END AS Agreement
  FROM core"""
    num = ["Mean_Diff", "Median_Diff", "MAE", "RMSE", "MAPE_pct", "Paired_t_stat", "Wilcoxon_stat", "Pearson_r",
           "Spearman_r", "ICC", "BlandAltman_MeanDiff", "BlandAltman_SD", "BlandAltman_LoA_Upper",
           "BlandAltman_LoA_Lower"]
    return base(fx) + ctes + " " + SIGCOLS(num, inner, ["Feature", "N_Paired", "Agreement"])


# -------------------------------------------------------------- correlation
def _pair_list(fx: str):
    f = FIXTURE_FEATURES[fx]
    return [(f[i], f[j]) for i in range(len(f)) for j in range(i, len(f))]


def _corr_expr(x: str, y: str) -> str:
    return (f"CASE WHEN count(*) >= 2 AND var_pop({x}) > 0 AND var_pop({y}) > 0 "
            f"THEN greatest(-1.0, least(1.0, covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})))) END")


def _named(fx: str) -> str:
    n1, n2 = FIXTURE_NAMES[fx]
    return f"CASE WHEN ds = 1 THEN '{n1}' ELSE '{n2}' END"


def pearson_matrix(fx: str) -> str:
    parts = []
    for d in (1, 2):
        for a, b in _pair_list(fx):
            parts.append(f"SELECT {d} AS ds, '{a}' AS Feature_1, '{b}' AS Feature_2, "
                         f"{_corr_expr(a, b)} AS Correlation FROM d{d} WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    inner = (f"SELECT {_named(fx)} AS Dataset, 'Pearson' AS Method, Feature_1, Feature_2, Correlation "
             f"FROM ({' UNION ALL '.join(parts)})")
    return base(fx) + " " + SIGCOLS(["Correlation"], inner, ["Dataset", "Method", "Feature_1", "Feature_2"])


def _pair_rows(fx: str) -> str:
    parts = []
    for d in (1, 2):
        for a, b in _pair_list(fx):
            parts.append(f"SELECT {d} AS ds, '{a}' AS fa, '{b}' AS fb, CAST({a} AS DOUBLE) AS x, "
                         f"CAST({b} AS DOUBLE) AS y FROM d{d} WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return f",\npr AS ({' UNION ALL '.join(parts)})"


#: Fixtures with missing values: their pairs are ranked one by one, the others' columns once.
WITH_NULLS = {"f2", "f9", "f11"}


def spearman_matrix(fx: str) -> str:
    order = ["Dataset", "Method", "Feature_1", "Feature_2"]
    if fx not in WITH_NULLS:
        feats, parts = FIXTURE_FEATURES[fx], []
        for d in (1, 2):
            ranks = ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}" for f in feats)
            items = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': {_corr_expr(a, b)}}}" for a, b in _pair_list(fx))
            parts.append(f"SELECT {d} AS ds, unnest([{items}], recursive := true) FROM (SELECT {ranks} FROM d{d})")
        inner = (f"SELECT {_named(fx)} AS Dataset, 'Spearman' AS Method, a AS Feature_1, b AS Feature_2, r AS Correlation "
                 f"FROM ({' UNION ALL '.join(parts)})")
        return base(fx) + " " + SIGCOLS(["Correlation"], inner, order)
    ctes = _pair_rows(fx) + """,
rr AS (SELECT ds, fa, fb,
  rank() OVER (PARTITION BY ds, fa, fb ORDER BY x) + (count(*) OVER (PARTITION BY ds, fa, fb, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY ds, fa, fb ORDER BY y) + (count(*) OVER (PARTITION BY ds, fa, fb, y) - 1) / 2.0 AS ry
  FROM pr)"""
    inner = (f"SELECT {_named(fx)} AS Dataset, 'Spearman' AS Method, fa AS Feature_1, fb AS Feature_2, "
             f"{_corr_expr('rx', 'ry')} AS Correlation FROM rr GROUP BY ds, fa, fb")
    return base(fx) + ctes + " " + SIGCOLS(["Correlation"], inner, order)


def kendall_matrix(fx: str) -> str:
    order = ["Dataset", "Method", "Feature_1", "Feature_2"]
    if fx not in WITH_NULLS:  # one self-join of the rows for all pairs of columns
        feats, parts = FIXTURE_FEATURES[fx], []
        for d in (1, 2):
            ties = {f: f"sum(CAST(a.{f} <> b.{f} AS BIGINT))" for f in feats}
            items = ", ".join(
                f"{{'a': '{x}', 'b': '{y}', 's': CAST(sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) AS DOUBLE), "
                f"'x': CAST({ties[x]} AS DOUBLE), 'y': CAST({ties[y]} AS DOUBLE)}}" for x, y in _pair_list(fx))
            parts.append(f"SELECT {d} AS ds, unnest([{items}], recursive := true) FROM n{d} a JOIN n{d} b ON a.rid < b.rid")
        cols = ", ".join(feats)
        rows = ", ".join(f"n{d} AS (SELECT {cols}, row_number() OVER () AS rid FROM d{d})" for d in (1, 2))
        inner = (f"SELECT {_named(fx)} AS Dataset, 'Kendall' AS Method, a AS Feature_1, b AS Feature_2, "
                 f"CASE WHEN x * y > 0 THEN s / sqrt(x * y) END AS Correlation FROM ({' UNION ALL '.join(parts)})")
        return base(fx) + f", {rows} " + SIGCOLS(["Correlation"], inner, order)
    ctes = _pair_rows(fx) + """,
pn AS (SELECT *, row_number() OVER (PARTITION BY ds, fa, fb ORDER BY x, y) AS rid FROM pr),
s AS (SELECT a.ds, a.fa, a.fb, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS cd,
  count(*) FILTER (WHERE a.x = b.x) AS tx, count(*) FILTER (WHERE a.y = b.y) AS ty, count(*) AS n0
  FROM pn a JOIN pn b ON a.ds = b.ds AND a.fa = b.fa AND a.fb = b.fb AND a.rid < b.rid GROUP BY 1, 2, 3)"""
    inner = (f"SELECT {_named(fx)} AS Dataset, 'Kendall' AS Method, fa AS Feature_1, fb AS Feature_2, "
             "CASE WHEN (n0 - tx) * (n0 - ty) > 0 THEN cd / sqrt(CAST((n0 - tx) AS DOUBLE) * (n0 - ty)) END "
             "AS Correlation FROM s")
    return base(fx) + ctes + " " + SIGCOLS(["Correlation"], inner, order)


def high_correlation_pairs(fx: str, builders: tuple = (pearson_matrix, spearman_matrix, kendall_matrix)) -> str:
    """C5 over the matrices of the fixture."""
    mats = []
    for builder in builders:
        mats.append(builder(fx))
    # each matrix statement is self-contained; wrap them as subqueries
    parts = [f"SELECT * FROM ({m})" for m in mats]
    return ("SELECT Dataset, Method, '> ' || CAST(t AS VARCHAR) AS Threshold, Feature_2 AS Feature_1, "
            "Feature_1 AS Feature_2, Correlation FROM (" + " UNION ALL ".join(parts) + ") m, "
            "(SELECT unnest([0.9, 0.95, 0.99]::DOUBLE[]) AS t) th "
            "WHERE Feature_1 <> Feature_2 AND Correlation IS NOT NULL AND abs(Correlation) > t")


# ------------------------------------------------------- redundancy, quality
def _flags_sql(fx: str, d: str) -> str:
    parts = []
    for f in FIXTURE_FEATURES[fx]:
        modal = f"(SELECT max(k) FROM (SELECT count(*) AS k FROM {d} WHERE {f} IS NOT NULL GROUP BY {f}))"
        const = f"(count(DISTINCT {f}) <= 1)"
        near = (f"((NOT {const}) AND (coalesce(var_samp(CAST({f} AS DOUBLE)) < 0.0001, false) "
                f"OR coalesce({modal} / count({f}) >= 0.99, false)))")
        parts.append(f"SELECT '{f}' AS feature, {const} AS is_constant, {near} AS is_near_constant FROM {d}")
    return " UNION ALL ".join(parts)


def redundancy_flags(fx: str) -> str:
    n1, n2 = FIXTURE_NAMES[fx]
    parts = []
    for d, name in (("d1", n1), ("d2", n2)):
        parts.append(f"SELECT feature AS Feature, '{name}' AS Dataset, is_constant AS Is_Constant, "
                     f"is_near_constant AS Is_Near_Constant, CASE WHEN is_constant THEN 'Remove (Constant)' "
                     f"WHEN is_near_constant THEN 'Review for Removal (Near Constant)' ELSE 'Check VIF' END "
                     f"AS Recommendation FROM ({_flags_sql(fx, d)})")
    return base(fx) + " " + " UNION ALL ".join(parts)


def vif_two(fx: str) -> str:
    """Uncentred two-column VIF: G11 G22 / (G11 G22 - G12^2), median-imputed."""
    a, b = FIXTURE_FEATURES[fx]
    n1, n2 = FIXTURE_NAMES[fx]
    parts = []
    for d, name in (("d1", n1), ("d2", n2)):
        imp = (f"SELECT coalesce(CAST({a} AS DOUBLE), (SELECT quantile_cont({a}, 0.5) FROM {d})) AS x, "
               f"coalesce(CAST({b} AS DOUBLE), (SELECT quantile_cont({b}, 0.5) FROM {d})) AS y FROM {d}")
        g = f"(SELECT sum(x * x) AS gxx, sum(y * y) AS gyy, sum(x * y) AS gxy FROM ({imp}))"
        parts.append(f"SELECT '{name}' AS Dataset, '{a}' AS Feature, gxx * gyy / (gxx * gyy - gxy * gxy) AS VIF FROM {g}")
        parts.append(f"SELECT '{name}' AS Dataset, '{b}' AS Feature, gxx * gyy / (gxx * gyy - gxy * gxy) AS VIF FROM {g}")
    return base(fx) + " " + SIGCOLS(["VIF"], " UNION ALL ".join(parts), ["Dataset", "Feature"])


def _fmt1(x: str) -> str:
    return f"printf('%.1f', {x})"


def quality_score(fx: str) -> str:
    n1, n2 = FIXTURE_NAMES[fx]
    feats = ", ".join(f"'{f}'" for f in FIXTURE_FEATURES[fx])
    q = f"""WITH feats AS (SELECT unnest([{feats}]) AS feature),
miss AS (SELECT Feature AS feature, Missing_Percent AS miss_pct FROM ({missingness(fx)}) WHERE Dataset = '{n2}'),
iqr AS (SELECT Feature_or_Method AS feature, Pct_Outliers AS iqr_pct FROM ({univariate_outliers(fx)})
  WHERE Dataset = '{n2}' AND Method = 'IQR'),
pl AS (SELECT Feature AS feature, Pct_Outside_Range AS implaus_pct FROM ({plausibility(fx)})),
sim AS (SELECT Feature AS feature, Similarity_Score AS sim_score FROM ({similarity_stats(fx)})),
fl AS (SELECT * FROM ({base(fx)} {_flags_sql(fx, 'd2')})),
j AS (SELECT feats.feature, miss_pct AS m, iqr_pct AS o, implaus_pct AS p, sim_score AS s, is_constant, is_near_constant
  FROM feats LEFT JOIN miss ON feats.feature = miss.feature LEFT JOIN iqr ON feats.feature = iqr.feature
  LEFT JOIN pl ON feats.feature = pl.feature LEFT JOIN sim ON feats.feature = sim.feature
  LEFT JOIN fl ON feats.feature = fl.feature),
sc AS (SELECT feature, CAST(100
  - CASE WHEN m > 5.0 THEN least(30, floor((m - 5.0) * 1.5)) ELSE 0 END
  - CASE WHEN o > 5.0 THEN least(20, floor((o - 5.0) * 2)) ELSE 0 END
  - CASE WHEN p > 1.0 THEN least(20, floor(p * 2)) ELSE 0 END
  - CASE WHEN s < 70.0 THEN least(30, floor((70.0 - s) * 0.5)) ELSE 0 END
  - CASE WHEN is_constant THEN 50 WHEN is_near_constant THEN 30 ELSE 0 END AS INTEGER) AS sc,
  concat_ws(' | ',
    CASE WHEN m > 5.0 THEN 'Missingness (' || {_fmt1('m')} || '%)' END,
    CASE WHEN o > 5.0 THEN 'Outliers (' || {_fmt1('o')} || '%)' END,
    CASE WHEN p > 1.0 THEN 'Implausible Values (' || {_fmt1('p')} || '%)' END,
    CASE WHEN s < 70.0 THEN 'Low Similarity (' || {_fmt1('s')} || '/100)' END,
    CASE WHEN is_constant THEN 'Constant' WHEN is_near_constant THEN 'Near-Constant' END) AS iss FROM j)
SELECT feature AS Feature, greatest(sc, 0) AS Quality_Score,
  CASE WHEN sc >= 90 THEN 'Excellent' WHEN sc >= 80 THEN 'Good' WHEN sc >= 70 THEN 'Fair' WHEN sc >= 60 THEN 'Poor'
  ELSE 'Very Poor' END AS Category, CASE WHEN iss = '' THEN 'None' ELSE iss END AS Primary_Issues FROM sc"""
    return q


# ---------------------------------------------------------------- normality
def normality_tests(fx: str, k: int = 20) -> str:
    ctes = f""",
st AS (SELECT ds, feature, count(*) AS n, avg(value) AS mean FROM L GROUP BY ds, feature HAVING count(*) >= {k}),
cm AS (SELECT L.ds, L.feature, st.n, avg(power(value - st.mean, 2)) AS m2, avg(power(value - st.mean, 3)) AS m3,
  avg(power(value - st.mean, 4)) AS m4 FROM L JOIN st ON L.ds = st.ds AND L.feature = st.feature
  GROUP BY L.ds, L.feature, st.n),
g AS (SELECT ds, feature, CAST(n AS DOUBLE) AS n, CASE WHEN m2 = 0 THEN NULL ELSE m3 / power(m2, 1.5) END AS g1,
  CASE WHEN m2 = 0 THEN NULL ELSE m4 / (m2 * m2) - 3 END AS g2 FROM cm),
s1 AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y,
  3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
  (g2 + 3 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
  6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb1
  FROM g),
s2 AS (SELECT *, -1 + sqrt(2 * (beta2 - 1)) AS w2, CASE WHEN y = 0 THEN 1.0 ELSE y END AS yy,
  6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS a FROM s1),
s3 AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS alpha, 1 + x * sqrt(2 / (a - 4.0)) AS den
  FROM s2),
s4 AS (SELECT *, delta * ln(yy / alpha + sqrt((yy / alpha) * (yy / alpha) + 1)) AS z1,
  ((1 - 2 / (9.0 * a)) - CASE WHEN den = 0 THEN NULL ELSE sign(den) * pow((1 - 2.0 / a) / abs(den), 1 / 3.0) END)
  / sqrt(2 / (9.0 * a)) AS z2 FROM s3)"""
    inner = (f"SELECT {_named(fx)} AS Dataset, feature AS Feature, CAST(n AS BIGINT) AS N, g1 AS Skewness, "
             "g2 AS Kurtosis, z1 * z1 + z2 * z2 AS DAgostino_K2_Stat, exp(-(z1 * z1 + z2 * z2) / 2) AS DAgostino_K2_pvalue, "
             "(abs(g1) < 2.0 AND abs(g2) < 7.0) AS Practically_Normal FROM s4")
    return base(fx) + ctes + " " + SIGCOLS(["Skewness", "Kurtosis", "DAgostino_K2_Stat", "DAgostino_K2_pvalue"],
                                           inner, ["Dataset", "Feature", "N", "Practically_Normal"])


# ---------------------------------------------------------------- plot data
def density_histogram(fx: str, bins: int = 50) -> str:
    ctes = f""",
rg AS (SELECT ds, feature, min(value) AS lo, max(value) AS hi, count(*) AS n FROM L GROUP BY ds, feature
  HAVING min(value) < max(value)),
c AS (SELECT L.ds, L.feature, {_np_bin('L.value', 'rg.lo', 'rg.hi', bins)} AS bin, count(*) AS cnt
  FROM L JOIN rg ON L.ds = rg.ds AND L.feature = rg.feature GROUP BY 1, 2, 3),
g AS (SELECT rg.*, b.b AS bin FROM rg, range({bins}) b(b)),
e AS (SELECT g.ds, g.feature, g.bin, g.n, coalesce(c.cnt, 0) AS cnt,
  CAST(g.bin AS DOUBLE) * ((g.hi - g.lo) / {bins}) + g.lo AS le,
  CASE WHEN g.bin = {bins - 1} THEN g.hi ELSE CAST(g.bin + 1 AS DOUBLE) * ((g.hi - g.lo) / {bins}) + g.lo END AS re
  FROM g LEFT JOIN c ON g.ds = c.ds AND g.feature = c.feature AND g.bin = c.bin)"""
    inner = (f"SELECT {_named(fx)} AS Dataset, feature AS Feature, CAST(bin AS INTEGER) AS Bin, le AS Left_Edge, "
             "re AS Right_Edge, cnt AS Count, cnt / (re - le) / n AS Density FROM e")
    return base(fx) + ctes + " " + SIGCOLS(["Left_Edge", "Right_Edge", "Density"], inner,
                                           ["Dataset", "Feature", "Bin", "Count"])


def kde_curve(fx: str, grid_points: int = 200, cut: float = 3.0, bins: int = 512) -> str:
    ctes = f""",
m AS (SELECT ds, feature, count(*) AS n, min(value) AS lo, max(value) AS hi,
  pow(CAST(count(*) AS DOUBLE), -0.2) * sqrt(var_samp(value)) AS bw FROM L GROUP BY ds, feature
  HAVING count(*) > 1 AND var_samp(value) > 0),
b AS (SELECT L.ds, L.feature, {_np_bin('L.value', 'm.lo', 'm.hi', bins)} AS bin, count(*) AS c
  FROM L JOIN m ON L.ds = m.ds AND L.feature = m.feature GROUP BY 1, 2, 3),
bc AS (SELECT b.ds, b.feature, b.c, m.lo + (b.bin + 0.5) * ((m.hi - m.lo) / {bins}) AS centre
  FROM b JOIN m ON b.ds = m.ds AND b.feature = m.feature),
gr AS (SELECT m.ds, m.feature, m.n, m.bw, k.k, m.lo - {cut} * m.bw AS g0, m.hi + {cut} * m.bw AS g1
  FROM m, range({grid_points}) k(k)),
gx AS (SELECT *, g0 + k * (g1 - g0) / {grid_points - 1} AS x FROM gr)"""
    n1, n2 = FIXTURE_NAMES[fx]
    inner = (f"SELECT CASE WHEN gx.ds = 1 THEN '{n1}' ELSE '{n2}' END AS Dataset, gx.feature AS Feature, "
             "CAST(k AS INTEGER) AS Point, x AS X, "
             f"sum(c * exp(-0.5 * ((x - centre) / bw) * ((x - centre) / bw))) / (n * bw * {math.sqrt(2 * math.pi)!r}) "
             "AS Density FROM gx JOIN bc ON gx.ds = bc.ds AND gx.feature = bc.feature "
             "GROUP BY gx.ds, gx.feature, k, x, n, bw")
    return base(fx) + ctes + " " + SIGCOLS(["X", "Density"], inner, ["Dataset", "Feature", "Point"])


def box_summary(fx: str) -> str:
    ctes = """,
p AS (SELECT ds, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
  quantile_cont(value, 0.75) AS q3 FROM L GROUP BY ds, feature)"""
    inner = (f"SELECT {_named(fx)} AS Dataset, p.feature AS Feature, q1 AS Q1, q2 AS Median, "
             "q3 AS Q3, min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS Whisker_Low, "
             "max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS Whisker_High, "
             "count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS Outliers "
             "FROM L JOIN p ON L.ds = p.ds AND L.feature = p.feature GROUP BY p.ds, p.feature, q1, q2, q3")
    inner = inner.replace(f"SELECT {_named(fx)} AS Dataset", f"SELECT CASE WHEN p.ds = 1 THEN '{FIXTURE_NAMES[fx][0]}' "
                                                             f"ELSE '{FIXTURE_NAMES[fx][1]}' END AS Dataset")
    return base(fx) + ctes + " " + SIGCOLS(["Q1", "Median", "Q3", "Whisker_Low", "Whisker_High"], inner,
                                           ["Dataset", "Feature", "Outliers"])


def ecdf_points(fx: str, points: int = 100) -> str:
    ctes = """,
ev AS (SELECT ds, feature, value, count(*) AS c FROM L GROUP BY ds, feature, value),
er AS (SELECT *, CAST(sum(c) OVER (PARTITION BY ds, feature ORDER BY value) AS DOUBLE) AS cum,
  CAST(sum(c) OVER (PARTITION BY ds, feature) AS DOUBLE) AS tot FROM ev)"""
    inner = (f"SELECT {_named(fx)} AS Dataset, feature AS Feature, value AS Value, cum / tot AS ECDF FROM er "
             f"WHERE floor(cum * {points} / tot) > floor((cum - c) * {points} / tot)")
    return base(fx) + ctes + " " + SIGCOLS(["Value", "ECDF"], inner, ["Dataset", "Feature"])


def two_sample_qq(fx: str, k: int = 10) -> str:
    probs = ", ".join(repr(q) for q in QGRID)
    ctes = f""",
qa AS (SELECT feature, count(*) FILTER (WHERE ds = 1) AS n1, count(*) FILTER (WHERE ds = 2) AS n2,
  quantile_cont(value, [{probs}]) FILTER (WHERE ds = 1) AS a,
  quantile_cont(value, [{probs}]) FILTER (WHERE ds = 2) AS b FROM L GROUP BY feature),
qs AS (SELECT feature, unnest(a) AS x, unnest(b) AS y, unnest([{probs}]) AS q FROM qa)"""
    inner = "SELECT feature AS Feature, q AS Q, x AS Quantile_1, y AS Quantile_2 FROM qs"
    return base(fx) + ctes + " " + SIGCOLS(["Q", "Quantile_1", "Quantile_2"], inner, ["Feature"])


def relationships(fx: str, pairs=(("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"))) -> str:
    parts = []
    for d in (1, 2):
        for x, y in pairs:
            parts.append(f"SELECT {d} AS ds, '{x}' AS X, '{y}' AS Y, CAST(regr_count({y}, {x}) AS BIGINT) AS N, "
                         f"regr_slope({y}, {x}) AS Slope, regr_intercept({y}, {x}) AS Intercept, "
                         f"regr_r2({y}, {x}) AS R2 FROM d{d}")
    inner = (f"SELECT {_named(fx)} AS Dataset, X, Y, N, Slope, Intercept, R2 FROM ({' UNION ALL '.join(parts)}) "
             "WHERE N >= 10")
    return base(fx) + " " + SIGCOLS(["Slope", "Intercept", "R2"], inner, ["Dataset", "X", "Y", "N"])


# -------------------------------------------------------------------- sinks
def publication_quality(fx: str) -> str:
    return quality_score(fx)  # no double columns: rounding leaves it unchanged


def publication_missingness_top20(fx: str) -> str:
    inner = missingness(fx)
    return (f"SELECT Dataset, Feature, Missing_Count, round_even(Missing_Percent, 3) AS Missing_Percent "
            f"FROM ({inner}) ORDER BY Missing_Percent DESC, Dataset, Feature LIMIT 20")


def plausibility_text(fx: str) -> str:
    inner = plausibility(fx)
    return (f"SELECT * EXCLUDE (Extreme_ECG_ID_Examples), CASE WHEN len(Extreme_ECG_ID_Examples) > 0 "
            f"THEN array_to_string(Extreme_ECG_ID_Examples, ', ') ELSE 'None' END AS Extreme_ECG_ID_Examples "
            f"FROM ({inner})")


def scaled_matrix(fx: str) -> str:
    feats = FIXTURE_FEATURES[fx]
    n1, n2 = FIXTURE_NAMES[fx]
    parts = []
    for d, name in (("d1", n1), ("d2", n2)):
        imp = ", ".join(f"coalesce(CAST({f} AS DOUBLE), (SELECT quantile_cont({f}, 0.5) FROM {d})) AS {f}"
                        for f in feats)
        st = ", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1.0 END AS s_{f}"
                       for f in feats)
        z = ", ".join(f"({f} - m_{f}) / s_{f} AS {f}" for f in feats)
        parts.append(f"SELECT '{name}' AS Dataset, id, {z} FROM (SELECT id, {imp} FROM {d}) i, "
                     f"(SELECT {st} FROM (SELECT {imp} FROM {d})) s")
    return base(fx) + " " + SIGCOLS(feats, " UNION ALL ".join(parts), ["Dataset", "id"])


def paired_summary(fx: str) -> str:
    inner = paired_stats(fx)
    cats = ("Excellent", "Good", "Moderate", "Fair", "Poor")
    items = [("Features analyzed", "CAST(count(*) AS DOUBLE)"), ("Mean ICC", "avg(ICC)"),
             ("Median ICC", "quantile_cont(ICC, 0.5)"), ("Mean Pearson r", "avg(Pearson_r)"),
             ("Mean MAE", "avg(MAE)"), ("Mean MAPE", "avg(MAPE_pct)")] + \
            [(f"{c} agreement", f"CAST(count(*) FILTER (WHERE Agreement = '{c}') AS DOUBLE)") for c in cats]
    sel = " UNION ALL ".join(f"SELECT '{k}' AS Metric, {v} AS Value FROM ps" for k, v in items)
    return f"WITH ps AS ({inner}) " + SIGCOLS(["Value"], sel, ["Metric"])


def bland_altman_density(fx: str, bins: int = 50) -> str:
    ctes = _pl(fx) + """,
pts AS (SELECT feature, (v1 + v2) / 2 AS m, v2 - v1 AS d FROM PL),
rg AS (SELECT feature, min(m) AS m0, max(m) AS m1, min(d) AS d0, max(d) AS d1 FROM pts GROUP BY feature)"""
    def cell(v, lo, hi):
        return (f"CASE WHEN {hi} > {lo} THEN least({bins - 1}, CAST(floor(({v} - {lo}) / ({hi} - {lo}) * {bins}) "
                f"AS INTEGER)) ELSE 0 END")
    return (base(fx) + ctes + f" SELECT pts.feature AS Feature, {cell('m', 'm0', 'm1')} AS Mean_Bin, "
            f"{cell('d', 'd0', 'd1')} AS Diff_Bin, count(*) AS Points FROM pts JOIN rg ON pts.feature = rg.feature "
            "GROUP BY 1, 2, 3")


def histogram_table(fx: str) -> str:
    inner = ("SELECT h.feature AS Feature, CAST(h.bin AS INTEGER) AS Bin, CAST(h.c1 AS BIGINT) AS Count_1, "
             "CAST(h.c2 AS BIGINT) AS Count_2, CAST(h.bin AS DOUBLE) * h.step + g.lo AS Left_Edge "
             "FROM h JOIN grid g ON h.feature = g.feature AND h.bin = g.bin")
    return base(fx) + _stats_ctes(k=0) + " " + SIGCOLS(["Left_Edge"], inner, ["Feature", "Bin", "Count_1", "Count_2"])


def redundancy_report_two(fx: str) -> str:
    n1, n2 = FIXTURE_NAMES[fx]
    a, b = FIXTURE_FEATURES[fx]
    fl = (f"SELECT '{n1}' AS Dataset, * FROM ({_flags_sql(fx, 'd1')}) UNION ALL "
          f"SELECT '{n2}' AS Dataset, * FROM ({_flags_sql(fx, 'd2')})")
    v = vif_two(fx)
    inner = (f"SELECT f.feature AS Feature, CASE WHEN f.is_constant THEN NULL ELSE v.VIF END AS VIF, "
             "CASE WHEN f.is_constant THEN NULL ELSE false END AS VIF_Is_Infinite, f.Dataset, "
             "f.is_constant AS Is_Constant, f.is_near_constant AS Is_Near_Constant, "
             "CASE WHEN f.is_constant THEN 'Remove (Constant)' WHEN f.is_near_constant THEN "
             "'Review for Removal (Near Constant)' WHEN v.VIF > 10.0 THEN 'Review for Removal (High VIF)' "
             f"ELSE 'Keep' END AS Recommendation FROM ({base(fx)} {fl}) f LEFT JOIN ({v}) v "
             "ON f.feature = v.Feature AND f.Dataset = v.Dataset")
    return SIGCOLS(["VIF"], inner, ["Feature", "VIF_Is_Infinite", "Dataset", "Is_Constant", "Is_Near_Constant",
                                    "Recommendation"])


def conclusions(fx: str) -> str:
    n1, n2 = FIXTURE_NAMES[fx]
    miss = f"(SELECT * FROM ({missingness(fx)}) WHERE Dataset = '{n2}' AND Missing_Percent > 10.0)"
    pl = f"(SELECT * FROM ({plausibility(fx)}) WHERE Pct_Outside_Range > 5.0)"
    sim = f"(SELECT * FROM ({similarity_stats(fx)}) WHERE Similarity_Score < 60.0)"
    qs = f"({quality_score(fx)})"
    parts = [
        f"SELECT 'high_missing' AS Section, 0 AS Rank, 'count' AS Item, CAST(count(*) AS DOUBLE) AS Value FROM {miss}",
        f"SELECT * FROM (SELECT 'high_missing' AS Section, CAST(row_number() OVER (ORDER BY Missing_Percent DESC, "
        f"Feature) AS INTEGER) AS Rank, Feature AS Item, Missing_Percent AS Value FROM {miss}) WHERE Rank <= 5",
        f"SELECT 'high_implausible', 0, 'count', CAST(count(*) AS DOUBLE) FROM {pl}",
        f"SELECT * FROM (SELECT 'high_implausible', CAST(row_number() OVER (ORDER BY Pct_Outside_Range DESC, Feature) "
        f"AS INTEGER) AS r, Feature, Pct_Outside_Range FROM {pl}) WHERE r <= 5",
        f"SELECT 'severe_shift', 0, 'count', CAST(count(*) AS DOUBLE) FROM {sim}",
        f"SELECT 'quality_category', 0, Category, CAST(count(*) AS DOUBLE) FROM {qs} GROUP BY Category",
    ]
    inner = " UNION ALL ".join(parts)
    return SIGCOLS(["Value"], inner, ["Section", "Rank", "Item"])


def conclusions_paired(fx: str) -> str:
    """K6 for a paired fixture: the unpaired sections plus the paired summary and weak-agreement list."""
    ps = paired_stats(fx)
    summ = paired_summary(fx)
    extra = [
        f"SELECT 'paired_summary' AS Section, 0 AS Rank, Metric AS Item, Value FROM ({summ})",
        f"SELECT * FROM (SELECT 'weak_agreement' AS Section, CAST(row_number() OVER (ORDER BY ICC DESC NULLS LAST, "
        f"Feature) AS INTEGER) AS Rank, Feature AS Item, ICC AS Value FROM ({ps}) "
        f"WHERE Agreement IN ('Fair', 'Poor')) WHERE Rank <= 10",
    ]
    base_sql = conclusions(fx)
    return f"SELECT * FROM ({base_sql}) UNION ALL BY NAME " + " UNION ALL BY NAME ".join(
        f"SELECT * FROM ({e})" for e in extra)


def mahalanobis_single(fx: str) -> str:
    """O4 for a one-feature fixture: md = |z| sqrt((n-1)/n) on median-imputed, population-scaled values."""
    (f,) = FIXTURE_FEATURES[fx]
    thr = NormalDist().inv_cdf(1 - 0.001 / 2)  # with one degree of freedom, chi-square is a squared normal
    n1, n2 = FIXTURE_NAMES[fx]
    parts = []
    for d, name in (("d1", n1), ("d2", n2)):
        imp = f"coalesce(CAST({f} AS DOUBLE), (SELECT quantile_cont({f}, 0.5) FROM {d}))"
        parts.append(
            f"SELECT '{name}' AS Dataset, 'Multivariate' AS Analysis_Type, 'All' AS Feature_or_Method, "
            f"'Mahalanobis' AS Method, round_even(count(*) FILTER (WHERE abs(x - m) / s * sqrt((n - 1.0) / n) > {thr!r}) "
            f"/ count(*) * 100, 2) AS Pct_Outliers FROM (SELECT {imp} AS x FROM {d}) i, "
            f"(SELECT avg({imp}) AS m, stddev_pop({imp}) AS s, count(*) AS n FROM {d}) st HAVING count(*) >= 50")
    return base(fx) + " " + SIGCOLS(["Pct_Outliers"], " UNION ALL ".join(parts),
                                    ["Dataset", "Analysis_Type", "Feature_or_Method", "Method"])


def pca_variance_two(fx: str) -> str:
    """M3 for two features: eigenvalues of the sample covariance of population-scaled data,
    n/(n-1) (1 +- |r|), in closed form."""
    a, b = FIXTURE_FEATURES[fx]
    n1, n2 = FIXTURE_NAMES[fx]
    parts = []
    for d, name in (("d1", n1), ("d2", n2)):
        x = f"coalesce(CAST({a} AS DOUBLE), (SELECT quantile_cont({a}, 0.5) FROM {d}))"
        y = f"coalesce(CAST({b} AS DOUBLE), (SELECT quantile_cont({b}, 0.5) FROM {d}))"
        st = (f"SELECT CAST(count(*) AS DOUBLE) AS n, abs(covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y}))) AS r "
              f"FROM {d}")
        for k, sign in ((1, "+"), (2, "-")):
            parts.append(f"SELECT '{name}' AS Dataset, {k} AS Component, n / (n - 1) * (1 {sign} r) AS Explained_Variance, "
                         f"(1 {sign} r) / 2 AS Explained_Variance_Ratio, "
                         f"{'(1 + r) / 2' if k == 1 else '1.0'} AS Cumulative_Ratio FROM ({st})")
    return base(fx) + " " + SIGCOLS(["Explained_Variance", "Explained_Variance_Ratio", "Cumulative_Ratio"],
                                    " UNION ALL ".join(parts), ["Dataset", "Component"])


def row_counts(fx: str) -> str:
    n1, n2 = FIXTURE_NAMES[fx]
    return base(fx) + f" SELECT '{n1}' AS Dataset, count(*) AS \"Rows\" FROM d1 UNION ALL SELECT '{n2}', count(*) FROM d2"


def _scaled(fx: str) -> str:
    """Median-imputed features scaled by the population SD, with ``ds`` and a row number, as CTE ``sx``."""
    feats = FIXTURE_FEATURES[fx]
    parts = []
    for k, d in ((1, "d1"), (2, "d2")):
        med = ", ".join(f"quantile_cont({f}, 0.5) AS m_{f}" for f in feats)
        imp = ", ".join(f"coalesce(CAST({f} AS DOUBLE), m_{f}) AS {f}" for f in feats)
        st = ", ".join(f"avg({f}) AS a_{f}, CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1.0 END AS s_{f}"
                       for f in feats)
        z = ", ".join(f"({f} - a_{f}) / s_{f} AS {f}" for f in feats)
        i = f"SELECT id, {imp} FROM {d}, (SELECT {med} FROM {d})"
        parts.append(f"SELECT {k} AS ds, id, {z} FROM ({i}) i, (SELECT {st} FROM ({i}))")
    return f",\nsx AS ({' UNION ALL '.join(parts)})"


def _lof(fx: str, k: int = 20) -> str:
    """Local Outlier Factor by all pairs of distinct vectors (weights = rows), neighbourhoods with ties: CTE ``lf``."""
    feats = FIXTURE_FEATURES[fx]
    cols = ", ".join(feats)
    gap = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in feats)
    return _scaled(fx) + f""",
pt AS (SELECT ds, {cols}, count(*) AS w, row_number() OVER () AS p FROM sx
  WHERE ds IN (SELECT ds FROM sx GROUP BY ds HAVING count(*) >= 50) GROUP BY ds, {cols}),
pq AS (SELECT a.ds, a.p, b.p AS o, sqrt({gap}) AS d, b.w - (a.p = b.p)::INT AS w FROM pt a JOIN pt b ON a.ds = b.ds
  WHERE a.p <> b.p OR b.w > 1),
cu AS (SELECT p, d, sum(w) OVER (PARTITION BY p ORDER BY d) AS c FROM pq),
kd AS (SELECT p, min(d) AS kd FROM cu WHERE c >= {k} GROUP BY p),
nb AS (SELECT pq.*, kd.kd FROM pq JOIN kd ON pq.p = kd.p WHERE d <= kd * (1 + 1e-9)),
ld AS (SELECT nb.p, any_value(nb.kd) AS kd, sum(nb.w) AS n, 1 / (sum(nb.w * greatest(nb.d, kd.kd)) / sum(nb.w) + 1e-10) AS lrd
  FROM nb JOIN kd ON nb.o = kd.p GROUP BY nb.p),
lp AS (SELECT nb.p, any_value(ld.kd) AS kd, any_value(ld.n) AS n,
  sum(nb.w * lo.lrd) / sum(nb.w) / any_value(ld.lrd) AS lof
  FROM nb JOIN ld ON nb.p = ld.p JOIN ld lo ON nb.o = lo.p GROUP BY nb.p),
lf AS (SELECT sx.ds, sx.id, lp.kd, lp.n, lp.lof FROM sx JOIN pt ON sx.ds = pt.ds
  AND {' AND '.join(f'sx.{f} = pt.{f}' for f in feats)} JOIN lp ON pt.p = lp.p),
lt AS (SELECT ds, quantile_cont(lof, 0.99) AS thr FROM lf GROUP BY ds)"""


def lof_scores(fx: str) -> str:
    inner = (f"SELECT {_named(fx).replace('ds =', 'lf.ds =')} AS Dataset, id, CAST(n AS BIGINT) AS Neighbours, kd AS K_Distance, "
             "lof AS LOF, lof > thr * (1 + 1e-9) AS Is_Outlier FROM lf JOIN lt ON lf.ds = lt.ds")
    return base(fx) + _lof(fx) + " " + SIGCOLS(["K_Distance", "LOF"], inner, ["Dataset", "id", "Neighbours", "Is_Outlier"])


def lof_summary(fx: str) -> str:
    inner = (f"SELECT {_named(fx).replace('ds =', 'lf.ds =')} AS Dataset, 'Multivariate' AS Analysis_Type, "
             "'All' AS Feature_or_Method, 'LOF' AS Method, round_even(count(*) FILTER (WHERE lof > thr * (1 + 1e-9)) / count(*) "
             "* 100, 2) AS Pct_Outliers FROM lf JOIN lt ON lf.ds = lt.ds GROUP BY lf.ds")
    return base(fx) + _lof(fx) + " " + SIGCOLS(["Pct_Outliers"], inner,
                                               ["Dataset", "Analysis_Type", "Feature_or_Method", "Method"])


#: Columns with a finite VIF, and an independent set that holds them (elsewhere all columns that are not constant).
INDEPENDENT = {"f9": ["k_near", "l_discount", "l_extendedprice", "l_quantity", "l_tax"],
               "f10": ["qty", "qty_far", "qty_mid", "qty_near"]}
INFINITE = {"f10": ["blend", "qty_mid", "qty_near"]}


def _vif(fx: str) -> str:
    """Uncentred VIFs by sweeping the Gram matrix of the median-imputed independent columns: (ds, feature, vif)."""
    feats = INDEPENDENT.get(fx, FIXTURE_FEATURES[fx])
    p, parts = len(feats), []
    for k in (1, 2):
        med = ", ".join(f"quantile_cont({f}, 0.5) AS m_{f}" for f in feats)
        imp = ", ".join(f"coalesce(CAST({f} AS DOUBLE), m_{f}) AS {f}" for f in feats)
        gram = ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in feats) + "]" for a in feats)
        parts.append(f"SELECT {k} AS ds, 1 AS k, [{gram}] AS m FROM (SELECT {imp} FROM d{k}, (SELECT {med} FROM d{k}))")
    names = ", ".join(f"'{f}'" for f in feats)
    return f""",
g0 AS ({' UNION ALL '.join(parts)}),
sw AS (SELECT * FROM g0 UNION ALL
  SELECT ds, k + 1, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 1}), lambda j:
    CASE WHEN i = k AND j = k THEN -1 / m[k][k] WHEN i = k OR j = k THEN m[i][j] / m[k][k]
    ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END)) FROM sw WHERE k <= {p}),
vf AS (SELECT sw.ds, unnest([{names}]) AS feature, unnest(list_transform(range(1, {p + 1}), lambda i: -sw.m[i][i] * g0.m[i][i])) AS vif
  FROM sw JOIN g0 ON sw.ds = g0.ds WHERE sw.k = {p + 1})"""


def redundancy_report(fx: str) -> str:
    """R4 with VIFs of all columns: infinite ones are known by construction of the fixture."""
    inf = ", ".join(f"'{f}'" for f in INFINITE.get(fx, [""]))
    flags = f"SELECT 1 AS ds, * FROM ({_flags_sql(fx, 'd1')}) UNION ALL SELECT 2 AS ds, * FROM ({_flags_sql(fx, 'd2')})"
    inner = (f"SELECT f.feature AS Feature, CASE WHEN is_constant THEN NULL WHEN f.feature IN ({inf}) THEN 9999.0 ELSE v.vif END AS VIF, "
             f"CASE WHEN NOT is_constant THEN f.feature IN ({inf}) END AS VIF_Is_Infinite, "
             f"{_named(fx).replace('ds =', 'f.ds =')} AS Dataset, is_constant AS Is_Constant, is_near_constant AS Is_Near_Constant "
             f"FROM ({flags}) f LEFT JOIN vf v ON f.ds = v.ds AND f.feature = v.feature")
    rec = ("CASE WHEN Is_Constant THEN 'Remove (Constant)' WHEN Is_Near_Constant THEN 'Review for Removal (Near Constant)' "
           "WHEN VIF > 10.0 THEN 'Review for Removal (High VIF)' ELSE 'Keep' END AS Recommendation")
    # the sweep is recursive, so the whole statement is
    return base(fx).replace("WITH ", "WITH RECURSIVE ", 1) + _vif(fx) + " " + SIGCOLS(
        ["VIF"], f"SELECT *, {rec} FROM ({inner})",
        ["Feature", "VIF_Is_Infinite", "Dataset", "Is_Constant", "Is_Near_Constant", "Recommendation"])


def paired_scatter(fx: str, bins: int = 50) -> str:
    ctes = _pl(fx) + """,
rg AS (SELECT feature, min(v1) AS a0, max(v1) AS a1, min(v2) AS b0, max(v2) AS b1, min(least(v1, v2)) AS lo,
  max(greatest(v1, v2)) AS hi FROM PL GROUP BY feature)"""

    def cell(v, lo, hi):
        return (f"CASE WHEN {hi} > {lo} THEN least({bins - 1}, CAST(floor(({v} - {lo}) / ({hi} - {lo}) * {bins}) "
                f"AS INTEGER)) ELSE 0 END")
    inner = (f"SELECT PL.feature AS Feature, {cell('v1', 'a0', 'a1')} AS Bin_1, {cell('v2', 'b0', 'b1')} AS Bin_2, count(*) AS Points, "
             "any_value(lo) AS Line_Low, any_value(hi) AS Line_High FROM PL JOIN rg ON PL.feature = rg.feature GROUP BY 1, 2, 3")
    return base(fx) + ctes + " " + SIGCOLS(["Line_Low", "Line_High"], inner, ["Feature", "Bin_1", "Bin_2", "Points"])


def violin_curve(fx: str) -> str:
    return f"SELECT * REPLACE ({SIG('Density', 7)} AS Density) FROM ({kde_curve(fx, cut=0.0)})"


def pca_identities(fx: str) -> str:
    """All components of at most ten features: total variance, squared covariances of the scaled features, no covariance of scores."""
    feats, parts = FIXTURE_FEATURES[fx], []
    squares = " + ".join(f"power(covar_samp({a}, {b}), 2)" for a in feats for b in feats)
    total = " + ".join(f"var_samp({f})" for f in feats)
    for item, value in (("total", total), ("squares", squares), ("across", "0.0::DOUBLE")):
        parts.append(f"SELECT ds, '{item}' AS Item, {value} AS Value FROM sx GROUP BY ds")
    inner = f"SELECT {_named(fx)} AS Dataset, Item, Value FROM ({' UNION ALL '.join(parts)})"
    return base(fx) + _scaled(fx) + " " + SIGCOLS(["Value"], inner, ["Dataset", "Item"])
