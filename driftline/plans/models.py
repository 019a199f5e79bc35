"""Queries that fit models."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import rsem
from driftline.models import boost, linear, local, mixed
from driftline.models.design import Factor, Interaction, Numeric, Smooth, build_design
from driftline.operators import cohort, reshape
from driftline.plans.prep import QUALITY_INPUTS
from driftline.plans.registry import FO, n_distinct_sql, over_records, query, r, records
from driftline.plans.summaries import full, over_studies, study_table
from driftline.session import cut_lineage

YEARS = "Publication_year > 2009"
LINE_COLUMNS = ["term", "estimate", "std_error", "t_value", "p_value", "n", "sigma", "r_squared", "f_value"]


def _line_sql(source: str) -> str:
    """Weighted straight line over rows (x, y, w) of ``source``, as a coefficient table.

    As in ``linear_fit``, too few rows or a constant x give no rows.
    """
    return f"""d AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w FROM ({source})
      WHERE x IS NOT NULL AND y IS NOT NULL AND w > 0),
    m AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my
      FROM d),
    s AS (SELECT any_value(n) AS n, any_value(sw) AS sw, any_value(mx) AS mx, any_value(my) AS my,
      sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy,
      sum(w * (y - my) * (y - my)) AS syy FROM d, m),
    f AS (SELECT *, sxy / sxx AS b, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM s
      WHERE n > 2 AND sxx > 0),
    c AS (SELECT 'x' AS term, b AS estimate, sqrt(s2 / sxx) AS std_error, * FROM f UNION ALL
      SELECT '(Intercept)', my - b * mx, sqrt(s2 * (1 / sw + mx * mx / sxx)), * FROM f)
    SELECT term, {r("estimate", "estimate")}, {r("std_error", "std_error")},
      {r("estimate / std_error", "t_value")}, {r(_t_tail_sql("estimate / std_error", "n - 2"), "p_value")}, n,
      {r("sqrt(s2)", "sigma")}, {r("sxy * sxy / sxx / syy", "r_squared")},
      {r("(sxy * sxy / sxx) / s2", "f_value")} FROM c"""


def _t_tail_sql(t: str, df: str) -> str:
    """Two-sided tail of the t distribution: Simpson's rule for the angle atan(t / sqrt(df))."""
    return f"""(SELECT greatest(0, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * h / 3 * sum(
      CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * cos(i * h) ** (v - 1)))
      FROM (SELECT i, v, atan(abs(t) / sqrt(v)) / 20000 AS h FROM (SELECT ({t})::DOUBLE AS t, ({df})::DOUBLE AS v),
      range(20001) s(i)) GROUP BY v, h)"""


@query("fit_fo_year", over_records(", " + _line_sql(
    "SELECT publication_year AS x, prop_w_plastic AS y, N AS w FROM full_"
    " WHERE publication_year > 2009")))
def fit_fo_year(spark, sf_dir):
    df = full(spark, sf_dir, "publication_year", "prop_w_plastic", "N")
    return linear.linear_fit(df.filter("publication_year > 2009"), F.col("prop_w_plastic"),
                             {"x": F.col("publication_year")}, weight=F.col("N"),
                             origin={"x": 2015}).select(*LINE_COLUMNS)


@query("fit_detect_year", over_studies(", " + _line_sql(
    f"SELECT Publication_year AS x, 1 - Smallest_detect_size AS y, 1 AS w FROM study WHERE {YEARS}"
)))
def fit_detect_year(spark, sf_dir):
    return linear.linear_fit(study_table(spark, sf_dir).filter(YEARS),
                             1 - F.col("Smallest_detect_size"),
                             {"x": F.col("Publication_year")}, origin={"x": 2015}
                             ).select(*LINE_COLUMNS)


@query("fit_large_size", over_studies(", " + _line_sql(
    "SELECT Smallest_detect_size AS x, Overall_FO AS y, N AS w FROM study"
    " WHERE Smallest_detect_size > 0.15")))
def fit_large_size(spark, sf_dir):
    df = study_table(spark, sf_dir).filter("Smallest_detect_size > 0.15")
    return linear.linear_fit(df, F.col("Overall_FO"), {"x": F.col("Smallest_detect_size")},
                             weight=F.col("N")).select(*LINE_COLUMNS)


@query("fit_geo_pollution", over_records(", " + _line_sql(
    f"SELECT any_value(mean_poll_abund) AS x, {FO} AS y, 1 AS w FROM rec WHERE ProvCode IS NOT NULL"
    " GROUP BY ProvCode")))
def fit_geo_pollution(spark, sf_dir):
    """Share of positive individuals per province against its mean pollution."""
    df = records(spark, sf_dir, "source", "ProvCode", "NwP", "N", lookup=True)
    provinces = df.filter("ProvCode is not null").groupBy("ProvCode").agg(
        rsem.frequency().alias("prop_by_region"), F.max("mean_poll_abund").alias("mean_poll_abund"))
    return linear.linear_fit(provinces, F.col("prop_by_region"),
                             {"x": F.col("mean_poll_abund")}).select(*LINE_COLUMNS)


QUAD_SQL = f""", d AS (SELECT Smallest_detect_size AS x, Smallest_detect_size ** 2 AS z,
      Overall_FO AS y, N::DOUBLE AS w FROM study WHERE Smallest_detect_size < 0.25
      AND Overall_FO IS NOT NULL AND N > 0),
    m AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my,
      sum(w * z) / sum(w) AS mz FROM d),
    s AS (SELECT any_value(n) AS n, any_value(sw) AS sw, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz,
      sum(w * (x - mx) ** 2) AS sxx, sum(w * (z - mz) ** 2) AS szz, sum(w * (y - my) ** 2) AS syy,
      sum(w * (x - mx) * (z - mz)) AS sxz, sum(w * (x - mx) * (y - my)) AS sxy,
      sum(w * (z - mz) * (y - my)) AS szy FROM d, m),
    f AS (SELECT *, sxx * szz - sxz * sxz AS det, (sxy * szz - szy * sxz) / det AS bx,
      (szy * sxx - sxy * sxz) / det AS bz FROM s),
    g AS (SELECT *, (syy - bx * sxy - bz * szy) / (n - 3) AS s2 FROM f WHERE n > 3)
    SELECT term, {r("estimate", "estimate")}, {r("std_error", "std_error")}, n,
      {r("sqrt(s2)", "sigma")}, {r("(bx * sxy + bz * szy) / syy", "r_squared")} FROM (
      SELECT '(Intercept)' AS term, my - bx * mx - bz * mz AS estimate,
        sqrt(s2 * (1 / sw + (mx * mx * szz - 2 * mx * mz * sxz + mz * mz * sxx) / det)) AS std_error, * FROM g
      UNION ALL SELECT 'x', bx, sqrt(s2 * szz / det), * FROM g
      UNION ALL SELECT 'x2', bz, sqrt(s2 * sxx / det), * FROM g)"""


def _small_sizes(spark, sf_dir):
    return study_table(spark, sf_dir).filter("Smallest_detect_size < 0.25")


@query("fit_quad_size", over_studies(QUAD_SQL))
def fit_quad_size(spark, sf_dir):
    x = F.col("Smallest_detect_size")
    fit = linear.linear_fit(_small_sizes(spark, sf_dir), F.col("Overall_FO"),
                            {"x": x, "x2": F.pow(x, F.lit(2.0))}, weight=F.col("N"))
    return fit.select("term", "estimate", "std_error", "n", "sigma", "r_squared")


@query("band_quad_size")
def band_quad_size(spark, sf_dir):
    """The quadratic with its 90 % band on a grid."""
    return linear.fit_band(_small_sizes(spark, sf_dir), F.col("Overall_FO"),
                           F.col("Smallest_detect_size"), degree=2, weight=F.col("N"),
                           level=0.90)


# --- ranking and averaging: three linear models per taxonomic order ---------------------

MODELS_SQL = """, d AS (SELECT "order" AS o, average_depth AS x, publication_year::DOUBLE AS z,
      prop_w_plastic AS y FROM full_ WHERE "order" IS NOT NULL AND average_depth IS NOT NULL
      AND publication_year IS NOT NULL AND prop_w_plastic IS NOT NULL),
    s AS (SELECT o, count(*) AS n, var_pop(x) * count(*) AS sxx, var_pop(z) * count(*) AS szz,
      var_pop(y) * count(*) AS syy, covar_pop(x, z) * count(*) AS sxz,
      covar_pop(x, y) * count(*) AS sxy, covar_pop(z, y) * count(*) AS szy FROM d GROUP BY o),
    f AS (SELECT *, sxx * szz - sxz * sxz AS det, (sxy * szz - szy * sxz) / det AS bx,
      (szy * sxx - sxy * sxz) / det AS bz FROM s),
    models AS (SELECT o, n, 'depth' AS model_id, 3 AS k, syy - sxy * sxy / sxx AS rss FROM f
      UNION ALL SELECT o, n, 'year', 3, syy - szy * szy / szz FROM f
      UNION ALL SELECT o, n, 'both', 4, syy - bx * sxy - bz * szy FROM f),
    scored AS (SELECT *, -n / 2.0::DOUBLE * (ln(2 * pi() * rss / n) + 1) AS loglik,
      -2 * loglik + 2 * k + 2.0::DOUBLE * k * (k + 1) / (n - k - 1) AS aicc FROM models),
    ranked AS (SELECT *, aicc - min(aicc) OVER w AS delta, exp(-delta / 2)
      / sum(exp(-(aicc - best) / 2)) OVER w AS weight FROM (
      SELECT *, min(aicc) OVER (PARTITION BY o) AS best FROM scored)
      WINDOW w AS (PARTITION BY o)),
    coefs AS (SELECT o, 'depth' AS model_id, 'depth' AS term, sxy / sxx AS estimate,
      sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se FROM f
      UNION ALL SELECT o, 'year', 'year', szy / szz, sqrt((syy - szy * szy / szz) / (n - 2) / szz)
      FROM f UNION ALL SELECT o, 'both', 'depth', bx,
      sqrt((syy - bx * sxy - bz * szy) / (n - 3) * szz / det) FROM f
      UNION ALL SELECT o, 'both', 'year', bz,
      sqrt((syy - bx * sxy - bz * szy) / (n - 3) * sxx / det) FROM f)"""


def _order_models(spark, sf_dir):
    """Coefficients and model table of the three models, fitted per order in one pass."""
    df = full(spark, sf_dir, "order", "average_depth", "publication_year", "prop_w_plastic")
    df = rsem.drop_na(df, "order", "average_depth", "publication_year", "prop_w_plastic")
    fits = linear.linear_fit(
        df, F.col("prop_w_plastic"),
        {"depth": F.col("average_depth"), "year": F.col("publication_year")}, by=["order"],
        origin={"depth": 750, "year": 2015},
        models={"depth": ["depth"], "year": ["year"], "both": ["depth", "year"]})
    fits = cut_lineage(fits)
    n = F.col("n")
    loglik = -n / 2.0 * (F.log(2 * F.pi() * F.col("rss") / n) + 1)
    table = fits.filter("term = '(Intercept)'").select("order", "model_id", "k", "n",
                                                       loglik.alias("loglik"))
    return fits.filter("term <> '(Intercept)'").select(
        "order", "model_id", "term", "estimate", "std_error"), table


@query("model_rank", over_records(f"""{MODELS_SQL} SELECT o AS "order", model_id, k, n,
    {r("loglik", "loglik")}, {r("aicc", "AICc")}, {r("delta", "delta")}, {r("weight", "weight")}
    FROM ranked"""))
def model_rank(spark, sf_dir):
    return linear.weights_of(_order_models(spark, sf_dir)[1], by=["order"])


@query("model_avg", over_records(f"""{MODELS_SQL}, j AS (SELECT * FROM coefs JOIN ranked
    USING (o, model_id)), a AS (SELECT o, term, sum(weight) AS imp, sum(weight * estimate) AS f
    FROM j GROUP BY o, term) SELECT o AS "order", term, {r("imp", "importance")},
    {r("f", "full")}, {r("f / imp", "conditional")},
    {r("e", "std_error")}, {r("fe", "full_error")}, {r("f / imp - z * e", "lower")}, {r("f / imp + z * e", "upper")},
    {r("f - z * fe", "full_lower")}, {r("f + z * fe", "full_upper")} FROM (
      SELECT o, term, imp, any_value(f) AS f, 1.959963984540054::DOUBLE AS z,
        sum(weight * sqrt(se ** 2 + (estimate - f / imp) ** 2)) / any_value(imp) AS e,
        sum(weight * sqrt(se ** 2 + (estimate - f) ** 2)) + greatest(1 - imp, 0) * abs(any_value(f)) AS fe
      FROM j JOIN a USING (o, term) GROUP BY o, term, imp)"""))
def model_avg(spark, sf_dir):
    coefs, table = _order_models(spark, sf_dir)
    return linear.average_coefficients(coefs, linear.weights_of(table, by=["order"]), ["order"])


# --- local regression ------------------------------------------------------------------


def _loess_sql(source: str, key: str | None, band: bool = False) -> str:
    """Local quadratic fit on 80 grid points over rows (k, x, y, w) of ``source``, with its error band.

    Matrix products are joins on (k, row, column).  The quantile of the t distribution is its series in
    1 / df at 0.975.
    """
    out = f"k AS {key}, " if key else ""
    det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))"
    fit = f"""rows_ AS (SELECT k, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w FROM ({source})
      WHERE x IS NOT NULL AND y IS NOT NULL AND w > 0),
    c AS (SELECT k, x, count(*) AS n, sum(w) AS w, sum(w * w) AS w2, sum(w * y) AS wy, sum(w * y * y) AS wyy
      FROM rows_ GROUP BY k, x),
    range_ AS (SELECT k AS gk, min(x) AS lo, max(x) AS hi, count(*) AS n FROM rows_ GROUP BY k),
    grid AS (SELECT gk, i, lo + i * ((hi - lo) / 79) AS g, floor(n * 0.75 + 0.00001) AS q FROM range_, range(80) t(i)),
    near AS (SELECT *, abs(x - g) AS d, sum(n) OVER (PARTITION BY gk, i ORDER BY abs(x - g)) AS cum
      FROM grid JOIN c ON k = gk),
    wide AS (SELECT *, min(CASE WHEN cum >= q THEN d END) OVER (PARTITION BY gk, i) AS h FROM near),
    tri AS (SELECT *, (1 - (d / h) ** 3) ** 3 AS t, (x - g) / h AS u FROM wide WHERE d < h),
    sums AS (SELECT gk AS k, i, any_value(g) AS x, sum(t * w) AS s0, sum(t * w * u) AS s1,
      sum(t * w * u ** 2) AS s2, sum(t * w * u ** 3) AS s3, sum(t * w * u ** 4) AS s4,
      sum(t * wy) AS t0, sum(t * wy * u) AS t1, sum(t * wy * u ** 2) AS t2 FROM tri GROUP BY gk, i),
    fit AS (SELECT k, i, x, (s2 * s4 - s3 * s3) / {det} AS c0, (s2 * s3 - s1 * s4) / {det} AS c1,
      (s1 * s3 - s2 * s2) / {det} AS c2, c0 * t0 + c1 * t1 + c2 * t2 AS fit FROM sums)"""
    if not band:
        return fit + f""" SELECT {out}{r("x", "x")}, {r("fit", "fit")} FROM fit"""
    return fit + f""",
    op AS (SELECT f.k, f.i, t.x, t.t * (c0 + c1 * t.u + c2 * t.u ** 2) AS l, t.w, t.w2
      FROM tri t JOIN fit f ON f.k = t.gk AND f.i = t.i),
    place AS (SELECT *, least(floor((x - lo) / ((hi - lo) / 79)), 78)::INT AS p, (x - lo) / ((hi - lo) / 79) - p AS s
      FROM c JOIN (SELECT gk, lo, hi FROM range_) ON k = gk),
    line AS (SELECT k, x, w, w2, n, wy, wyy, unnest([p, p + 1]) AS j, unnest([1 - s, s]) AS b FROM place),
    a AS (SELECT u.k, u.j AS i, v.j, sum(u.n * u.b * v.b) AS v FROM line u JOIN line v ON u.k = v.k AND u.x = v.x GROUP BY ALL),
    cc AS (SELECT u.k, u.i, v.i AS j, sum(u.l * v.l * u.w2) AS v FROM op u JOIN op v ON u.k = v.k AND u.x = v.x GROUP BY ALL),
    dd AS (SELECT u.k, u.i, v.j, sum(u.l * u.w * v.b) AS v FROM op u JOIN line v ON u.k = v.k AND u.x = v.x GROUP BY ALL),
    ac AS (SELECT u.k, u.i, v.j, sum(u.v * v.v) AS v FROM a u JOIN cc v ON u.k = v.k AND u.j = v.i GROUP BY ALL),
    ad AS (SELECT u.k, u.i, v.j, sum(u.v * v.v) AS v FROM a u JOIN dd v ON u.k = v.k AND u.j = v.i GROUP BY ALL),
    td AS (SELECT k, sum(v) AS v FROM dd WHERE i = j GROUP BY k),
    tac AS (SELECT k, sum(v) AS v FROM ac WHERE i = j GROUP BY k),
    tdd AS (SELECT u.k, sum(u.v * v.v) AS v FROM dd u JOIN dd v ON u.k = v.k AND u.i = v.j AND u.j = v.i GROUP BY u.k),
    tadc AS (SELECT u.k, sum(u.v * v.v) AS v FROM ad u JOIN cc v ON u.k = v.k AND u.i = v.j AND u.j = v.i GROUP BY u.k),
    tacac AS (SELECT u.k, sum(u.v * v.v) AS v FROM ac u JOIN ac v ON u.k = v.k AND u.i = v.j AND u.j = v.i GROUP BY u.k),
    rss AS (SELECT k, sum(wyy - 2 * wy * y + w * y * y) AS v FROM (
      SELECT l.k, l.x, any_value(wyy) AS wyy, any_value(wy) AS wy, any_value(w) AS w, sum(b * fit) AS y
      FROM line l JOIN fit f ON f.k = l.k AND f.i = l.j GROUP BY l.k, l.x) GROUP BY k),
    free AS (SELECT g.gk AS k, g.n - 2 * td.v + tac.v AS one,
      g.n - 4 * td.v + 4 * tac.v + 2 * tdd.v - 4 * tadc.v + tacac.v AS two, sqrt(rss.v / one) AS sigma, one * one / two AS df
      FROM range_ g JOIN td ON td.k = g.gk JOIN tac ON tac.k = g.gk JOIN tdd ON tdd.k = g.gk JOIN tadc ON tadc.k = g.gk
      JOIN tacac ON tacac.k = g.gk JOIN rss ON rss.k = g.gk),
    norm AS (SELECT k, i, sqrt(sum(l * l * w)) AS v FROM op GROUP BY k, i),
    z AS (SELECT 1.959963984540054::DOUBLE AS z),
    quant AS (SELECT *, z + (z ** 3 + z) / (4 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * df ** 2)
      + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * df ** 3)
      + (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / (92160 * df ** 4) AS t FROM free, z)
    SELECT {"f.k AS " + key + ", " if key else ""}{r("x", "x")}, {r("fit", "fit")}, {r("sigma * v", "std_error")},
      {r("fit - t * sigma * v", "lower")}, {r("fit + t * sigma * v", "upper")}, {r("sigma", "sigma")}, {r("df", "df")}
    FROM fit f JOIN norm m ON m.k = f.k AND m.i = f.i JOIN quant q ON q.k = f.k"""


@query("loess_depth", over_records(", " + _loess_sql(
    "SELECT Found AS k, average_depth AS x, prop_w_plastic AS y, N AS w FROM full_"
    " WHERE Found IS NOT NULL AND average_depth BETWEEN 0 AND 350", "Found", band=True)))
def loess_depth(spark, sf_dir):
    """Proportion against depth per habitat group, weighted by individuals, with its 95 % band."""
    df = full(spark, sf_dir, "habitat", "average_depth", "prop_w_plastic", "N")
    df = df.filter(F.col("Found").isNotNull() & F.col("average_depth").between(0, 350))
    return local.local_regression(df, F.col("prop_w_plastic"), F.col("average_depth"), ["Found"], F.col("N"))


@query("trend_studies", over_records(", " + _loess_sql(
    f"""SELECT 1 AS k, publication_year AS x, {n_distinct_sql("source")} AS y, 1 AS w FROM rec
    WHERE includes_microplastic IS NOT NULL GROUP BY publication_year, method_type,
    includes_microplastic""", None)))
def trend_studies(spark, sf_dir):
    """Smooth trend of the number of studies per year, method and kind."""
    df = records(spark, sf_dir, "source", "publication_year", "method_type",
                 "includes_microplastic").groupBy(
        "publication_year", "method_type", "includes_microplastic").agg(
        rsem.n_distinct("source").alias("n_studies"))
    return local.local_regression(df, F.col("n_studies"), F.col("publication_year")).select("x", "fit")


def _studies_sql(kind: str) -> str:
    return over_records(", " + _loess_sql(
        f"""SELECT 1 AS k, publication_year AS x, {n_distinct_sql("source")} AS y, 1 AS w FROM rec
        GROUP BY publication_year, {kind}""", None))


def _trend_of_studies(spark, sf_dir, kind, inputs=None, **kw):
    """Smooth trend over the number of studies per year and ``kind``, all kinds as one series of points."""
    rec = records(spark, sf_dir, "source", "publication_year", *(inputs or [kind]), **kw)
    counts = rec.groupBy("publication_year", kind).agg(
        rsem.n_distinct("source").alias("n_studies"))
    return local.local_regression(counts, F.col("n_studies"), F.col("publication_year")).select("x", "fit")


@query("trend_studies_kind", _studies_sql("includes_microplastic"))
def trend_studies_kind(spark, sf_dir):
    return _trend_of_studies(spark, sf_dir, "includes_microplastic")


@query("trend_studies_method", _studies_sql("method_type"))
def trend_studies_method(spark, sf_dir):
    return _trend_of_studies(spark, sf_dir, "method_type")


@query("trend_studies_region", _studies_sql("adjacency_water"))
def trend_studies_region(spark, sf_dir):
    return _trend_of_studies(spark, sf_dir, "adjacency_water", ["ProvCode", "water_type"], lookup=True)


# --- logistic, mixed and additive models ---------------------------------------------------


@query("qa_logistic")
def qa_logistic(spark, sf_dir):
    """Chance that a study reports each quality measure, by year, with its band."""
    long = reshape.to_long(study_table(spark, sf_dir).filter(YEARS),
                           ["source", "Publication_year"], "Polymer_confirmation", "Min_size",
                           "Metric_type", "Metric_value").dropna()
    return mixed.logistic_bands(long, "Metric_type", "Publication_year", "Metric_value")


FIVE = ("order", "publication_year", "method_type", "overall_reliability", "brk_pt_MD")
DEPTH, TROPHIC = Numeric("average_depth"), Numeric("trophic_level_via_fishbase")
POLLUTION, FOUND = Numeric("mean_poll_abund"), Factor("Found")
FORAGE = Factor("prime_forage", "Benthic foraging")
DEPTH_FOUND = [DEPTH, FOUND, Interaction(DEPTH, FOUND)]

#: model -> (cohort, fixed terms, random intercepts)
SPECS = {
    "method": ("method", [Factor("method_type")], ("order", "source")),
    "full": ("full", [Factor("prime_forage"), TROPHIC, DEPTH, FOUND, POLLUTION,
                      Factor("adjacency_water"), Numeric("publication_year"),
                      Factor("brk_pt_MD"), Interaction(DEPTH, FOUND)],
             ("order", "method_type", "overall_reliability")),
    "forage": ("forage", [FORAGE], FIVE),
    "depth": ("depth", DEPTH_FOUND, FIVE),
    "pollution": ("pollution", [POLLUTION], FIVE),
    "water": ("water", [Factor("adjacency_water")], FIVE),
    "trophic": ("trophic", [TROPHIC], FIVE),
    "year_check": ("forage", [Numeric("publication_year")],
                   ("brk_pt_MD", "overall_reliability", "method_type")),
    "year": ("year", [Numeric("publication_year")],
             ("brk_pt_MD", "overall_reliability", "order", "method_type")),
    "depth_source": ("depth", DEPTH_FOUND, ("order", "source", "method_type")),
    "eco": ("forage", [Factor("prime_forage"), DEPTH, FOUND], ("order", "source")),
    "geo": ("geo", [POLLUTION, Factor("adjacency_water")], ("order", "source")),
}

_NEEDS = {"Found": ["habitat"], "adjacency_water": ["ProvCode", "water_type"],
          "mean_poll_abund": ["ProvCode"], "brk_pt_MD": ["publication_year"],
          "overall_reliability": list(QUALITY_INPUTS)}


def _terms_columns(terms, random):
    cols = set(random)
    for t in terms:
        cols |= {t.a.col, t.b.col} if isinstance(t, Interaction) else {t.col}
        if isinstance(t, Smooth) and t.by:
            cols.add(t.by)
    return cols


def model_data(spark, sf_dir, name, terms, random, micro=True, extra=()):
    """Complete cohort of a model with only the columns it uses."""
    cols = _terms_columns(terms, random) | set(cohort.MODEL_COHORTS[name][0]) | set(extra) | {
        "prime_forage" if name in ("forage", "full") else "N",
        "adjacency_water" if name in ("pollution", "water") else "N",
        "method_type" if name in ("geo", "particles") else "N"}
    raw = sorted({c for col in cols for c in _NEEDS.get(col, [col])} | {"source", "N", "NwP"})
    lookup = bool(cols & {"adjacency_water", "mean_poll_abund"})
    if micro:
        df = full(spark, sf_dir, *[c for c in raw if c != "source"], lookup=lookup)
    else:
        df = records(spark, sf_dir, *raw, lookup=lookup)
    if "overall_reliability" in cols:
        df = cohort.with_quality(df)
    return rsem.drop_na(cohort.model_cohort(df, name), *sorted(_terms_columns(terms, random)))


def fit_spec(spark, sf_dir, key):
    name, terms, random = SPECS[key]
    design = build_design(model_data(spark, sf_dir, name, terms, random), terms, random)
    return mixed.fit_binomial(design, {key: [t.name for t in terms]})[key], design


def _register_specs() -> None:
    for key in SPECS:
        def run(spark, sf_dir, key=key):
            return mixed.coefficients(spark, [fit_spec(spark, sf_dir, key)[0]])
        query(f"glmm_{key}")(run)


_register_specs()


@query("r2_glmm")
def r2_glmm(spark, sf_dir):
    return mixed.variance_components(spark, [fit_spec(spark, sf_dir, "depth")[0]])


@query("ranef_order")
def ranef_order(spark, sf_dir):
    return mixed.random_intercepts(spark, *fit_spec(spark, sf_dir, "depth"), "order")


@query("model_sel")
def model_sel(spark, sf_dir):
    """Ranking of five mixed models by corrected AIC."""
    fits = [fit_spec(spark, sf_dir, k)[0]
            for k in ("forage", "depth", "pollution", "water", "trophic")]
    return linear.weights_of(mixed.model_table(spark, fits))


SMALL = [FORAGE, TROPHIC, *DEPTH_FOUND]


def _small_dredge(spark, sf_dir):
    random = ("order", "method_type")
    df = model_data(spark, sf_dir, "full", SMALL, random)
    return mixed.dredge(build_design(df, SMALL, random), SMALL)


@query("dredge_small")
def dredge_small(spark, sf_dir):
    """All admissible submodels of forage + trophic level + depth * habitat, ranked."""
    return linear.weights_of(mixed.model_table(spark, _small_dredge(spark, sf_dir)))


@query("dredge_avg")
def dredge_avg(spark, sf_dir):
    """Coefficients averaged over those submodels."""
    fits = _small_dredge(spark, sf_dir)
    return linear.average_coefficients(mixed.coefficients(spark, fits),
                                       linear.weights_of(mixed.model_table(spark, fits)))


@query("dredge_full")
def dredge_full(spark, sf_dir):
    """All admissible submodels of the full model's nine terms, with its three intercepts, ranked."""
    return linear.weights_of(mixed.model_table(spark, _full_dredge(spark, sf_dir)))


@query("dredge_full_avg")
def dredge_full_avg(spark, sf_dir):
    """Coefficients averaged over all submodels of the full model, with their intervals."""
    fits = _full_dredge(spark, sf_dir)
    return linear.average_coefficients(mixed.coefficients(spark, fits),
                                       linear.weights_of(mixed.model_table(spark, fits)))


def _full_dredge(spark, sf_dir):
    cohort_name, terms, random = SPECS["full"]
    df = model_data(spark, sf_dir, cohort_name, terms, random)
    return mixed.dredge(build_design(df, terms, random), terms)


@query("lmm_particles")
def lmm_particles(spark, sf_dir):
    """Log mean particles by water type, with intercepts per order and study."""
    terms, random = [Factor("adjacency_water", "estuarine")], ("order", "source")
    df = model_data(spark, sf_dir, "particles", terms, random, micro=False)
    design = build_design(df, terms, random,
                          response=rsem.log_or_null("mean_num_particles_per_indv"))
    return mixed.coefficients(spark, [mixed.fit_gaussian(design, [terms[0].name], "particles")])


@query("gam_depth")
def gam_depth(spark, sf_dir):
    """Curves of trophic level and of depth per habitat, weighted by individuals."""
    terms = [Smooth("trophic_level_via_fishbase"), Smooth("average_depth", by="Found"),
             Factor("adjacency_water")]
    df = model_data(spark, sf_dir, "trophic", terms, (), extra=("prop_w_plastic",))
    design = build_design(df.filter("average_depth < 301"), terms,
                          response=F.col("prop_w_plastic"), weight=F.col("N"))
    fit = mixed.fit_gaussian(design, [t.name for t in terms], "gam")
    return mixed.curve_table(spark, fit)


@query("gamm_depth")
def gamm_depth(spark, sf_dir):
    """Binomial curves of trophic level and of depth per water type, with two intercepts."""
    terms = [Smooth("trophic_level_via_fishbase"),
             Smooth("average_depth", by="adjacency_water"), FOUND]
    random = ("order", "source")
    df = model_data(spark, sf_dir, "trophic", terms, random).filter("average_depth < 1501")
    design = build_design(df, terms, random)
    fit = mixed.fit_binomial(design, {"gamm": [t.name for t in terms]})["gamm"]
    return mixed.curve_table(spark, fit)


# --- boosted trees ---------------------------------------------------------------------------


def _boosted(spark, sf_dir):
    df = full(spark, sf_dir, "prime_forage", "order", "average_depth", "habitat",
              "prop_w_plastic", "N")
    return boost.fit_boosted(df, F.col("prop_w_plastic"), ["average_depth"],
                             ["prime_forage", "order", "Found"], F.col("N"), trees=10, rate=0.3,
                             folds=2)


@query("brt_fit")
def brt_fit(spark, sf_dir):
    return boost.cv_table(_boosted(spark, sf_dir))


@query("brt_importance")
def brt_importance(spark, sf_dir):
    return boost.importance(_boosted(spark, sf_dir))


@query("brt_pdp")
def brt_pdp(spark, sf_dir):
    return boost.partial_dependence(_boosted(spark, sf_dir), "average_depth")
