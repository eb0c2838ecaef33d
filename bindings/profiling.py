"""Profiles, meta-features and information."""

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import CONST, DOC, DUP, EVENT, LINE, LINE_FEATURES, LINE_LONG, NULLS
from sondage.functions.scalars import right_closed_bin
from sondage.operators import information, profile
from sondage.plans.quantiles import melt

EVENT_FEATURES = ["value", "hour", "k"]
EVENT_LONG = EVENT + """, long AS (SELECT event_id, 'value' AS feature, value AS value, event_type AS y FROM event
  UNION ALL SELECT event_id, 'hour', hour, event_type FROM event UNION ALL SELECT event_id, 'k', k, event_type FROM event)"""


def rounded(df, digits, *columns):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("shape", "SELECT count(*) AS n_instances, 6 AS n_features FROM lineitem")
def _(t):
    return profile.shape(t.line(), "l_returnflag")


@query("missing_pct", f"""WITH {NULLS} SELECT round(least(100.0 * (count(*) - count(price) + count(*) - count(priority))
  / (count(*) * 4), 100.0), 4)::DOUBLE AS missing_pct FROM nulls""")
def _(t):
    return rounded(profile.missing_pct(t.null(), "o_orderstatus"), 4, "missing_pct")


MISSING = f"""{NULLS}, miss AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS share FROM nulls"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "price", "priority")) + ")"


@query("missing_by_column", f"WITH {MISSING} SELECT * FROM miss")
def _(t):
    return rounded(profile.missing_by_column(t.null()), 6, "share")


@query("class_distribution", """SELECT l_returnflag, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS share FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(profile.class_distribution(t.line(), "l_returnflag"), 6, "share")


@query("imbalance_ratio", f"""WITH {DOC} SELECT round(least(max(n) / min(n)::DOUBLE, 1000), 4) AS imbalance_ratio
  FROM (SELECT quality, count(*) AS n FROM doc GROUP BY 1)""")
def _(t):
    return rounded(profile.imbalance_ratio(t.doc(), "quality"), 4, "imbalance_ratio")


@query("role_counts", """WITH n AS (SELECT count(*) AS n FROM lineitem)
  SELECT 'numeric' AS role, 'double' AS dtype, 5::BIGINT AS columns, (5 * n)::BIGINT AS cells FROM n
  UNION ALL SELECT 'categorical', 'string', 2, 2 * n FROM n""")
def _(t):
    return profile.role_counts(t.line())


@query("duplicate_rows", f"""WITH {DUP} SELECT (SELECT count(*) FROM dup) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup))
  AS duplicate_rows""")
def _(t):
    return profile.duplicate_rows(t.dup())


@query("distinct_target", "SELECT count(DISTINCT l_returnflag) AS distinct_target FROM lineitem")
def _(t):
    return profile.distinct_target(t.line(), "l_returnflag")


MOMENTS = """mom AS (SELECT feature, count(value) AS n, var_pop(value) AS var_pop, kurtosis_pop(value) AS kurtosis,
  skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1.0)) AS skewness FROM long GROUP BY 1)"""


@query("mean_skewness", f"WITH {LINE_LONG}, {MOMENTS} SELECT round(avg(skewness), 5) AS mean_skewness FROM mom WHERE n > 3")
def _(t):
    return profile.moments(t.line(), LINE_FEATURES, 3).agg(F.round(F.avg("skewness"), 5).alias("mean_skewness"))


@query("mean_kurtosis", f"WITH {LINE_LONG}, {MOMENTS} SELECT round(avg(kurtosis), 5) AS mean_kurtosis FROM mom WHERE n > 3")
def _(t):
    return profile.moments(t.line(), LINE_FEATURES, 3).agg(F.round(F.avg("kurtosis"), 5).alias("mean_kurtosis"))


@query("mean_variance", f"WITH {LINE_LONG}, {MOMENTS} SELECT round(avg(var_pop), 0) AS mean_variance FROM mom WHERE n > 3")
def _(t):
    return profile.moments(t.line(), LINE_FEATURES, 3).agg(F.round(F.avg("var_pop"), 0).alias("mean_variance"))


@query("top_variance", f"""WITH {LINE_LONG} SELECT feature, round(var_samp(value), 4 - ceil(log10(var_samp(value)))::INT + 4) AS variance
  FROM long GROUP BY 1 ORDER BY var_samp(value) DESC, feature LIMIT 10""")
def _(t):
    v = profile.top_variance(t.line(), LINE_FEATURES)
    return v.select("feature", F.expr("double(round(variance * pow(10, 8 - ceil(log10(variance))), 0) / pow(10, 8 - ceil(log10(variance))))").alias("variance"))


CORR = """corr AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, coalesce(corr({a}, {b}), 0) AS corr FROM line"
    for a in LINE_FEATURES for b in LINE_FEATURES) + ")"


@query("correlation_matrix", f"WITH {LINE}, {CORR} SELECT a, b, round(corr, 5) + 0 AS corr FROM corr")
def _(t):
    return rounded(profile.correlation_matrix(t.line(), LINE_FEATURES), 5, "corr").withColumn("corr", F.col("corr") + 0.0)


@query("mean_abs_correlation", f"""WITH {LINE}, {CORR} SELECT round(avg(abs(corr)), 5) AS mean_abs_correlation FROM corr
  WHERE list_position({LINE_FEATURES}, a) < list_position({LINE_FEATURES}, b)""")
def _(t):
    return rounded(profile.mean_abs_correlation(t.line(), LINE_FEATURES), 5, "mean_abs_correlation")


OUT = """qs AS (SELECT feature, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
   FROM long GROUP BY 1),
 outl AS (SELECT l.feature, any_value(n) AS n, any_value(q1) AS q1, any_value(q3) AS q3,
   count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers
   FROM long l JOIN qs ON l.feature = qs.feature GROUP BY 1)"""


@query("outliers_by_column", f"WITH {EVENT_LONG}, {OUT} SELECT feature, n, round(q1, 4) AS q1, round(q3, 4) AS q3, outliers FROM outl")
def _(t):
    return rounded(profile.outliers_by_column(t.event(), EVENT_FEATURES), 4, "q1", "q3")


@query("outlier_ratio", f"WITH {EVENT_LONG}, {OUT} SELECT round(sum(outliers) / sum(n)::DOUBLE, 6) AS outlier_ratio FROM outl")
def _(t):
    return rounded(profile.outlier_ratio(t.event(), EVENT_FEATURES), 6, "outlier_ratio")


@query("box_stats", f"""WITH {EVENT_LONG}, {OUT}, x AS (SELECT l.feature, value, event_id, row_number() OVER (PARTITION BY l.feature
   ORDER BY greatest(q1 - 1.5 * (q3 - q1) - value, value - (q3 + 1.5 * (q3 - q1))) DESC, value, event_id) AS r
   FROM long l JOIN qs ON l.feature = qs.feature WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)),
  o AS (SELECT feature, string_agg(round(value * 100, 0)::BIGINT::VARCHAR, ',' ORDER BY r) AS outliers FROM x WHERE r <= 50 GROUP BY 1)
  SELECT l.feature, round(min(value), 4) AS low, round(any_value(q1), 4) AS q1, round(median(value), 4) AS median,
   round(any_value(q3), 4) AS q3, round(max(value), 4) AS high, coalesce(any_value(outliers), '') AS outliers
  FROM long l JOIN qs ON l.feature = qs.feature LEFT JOIN o ON l.feature = o.feature GROUP BY 1""")
def _(t):
    df = profile.box_stats(t.event(), EVENT_FEATURES, "event_id").drop("n")
    shown = F.array_join(F.transform("outliers", lambda v: F.round(v * 100, 0).cast("long").cast("string")), ",")
    return rounded(df, 4, "low", "q1", "median", "q3", "high").withColumn("outliers", shown)


def _hist_sql(long, by=""):
    group = f"{by}, " if by else ""
    on = f"g.{by} = c.{by} AND " if by else ""
    return f"""rng AS (SELECT feature, min(value) AS lo, max(value) AS hi, least(20, count(DISTINCT value)) AS k FROM {long} GROUP BY 1),
 cnt AS (SELECT {group}l.feature, least(coalesce(floor((value - lo) / nullif((hi - lo) / k, 0)), 0), k - 1)::BIGINT AS bin, count(*) AS n
   FROM {long} l JOIN rng ON l.feature = rng.feature GROUP BY ALL),
 grid AS (SELECT {group}rng.feature, unnest(range(k)) AS bin, lo, (hi - lo) / k AS w FROM rng
   {f"CROSS JOIN (SELECT DISTINCT {by} FROM {long}) d" if by else ""}),
 hist AS (SELECT {('g.' + by + ', ') if by else ''}g.feature, g.bin, round(lo + w * g.bin, 4) AS low,
   round(lo + w * (g.bin + 1), 4) AS high, coalesce(n, 0) AS n
   FROM grid g LEFT JOIN cnt c ON {on}g.feature = c.feature AND g.bin = c.bin)"""


@query("histogram", f"WITH {LINE_LONG}, {_hist_sql('long')} SELECT * FROM hist")
def _(t):
    return rounded(profile.histogram(t.line(), LINE_FEATURES), 4, "low", "high")


STATS = """stats AS (SELECT feature, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std,
  skewness(value) AS skew, kurtosis(value) AS kurt FROM long GROUP BY 1)"""


@query("stats_table", f"""WITH {LINE_LONG}, {STATS} SELECT feature, round(mean, 3) AS mean, round(median, 3) AS median,
  round(std, 3) AS std, round(skew, 4) + 0 AS skew, round(kurt, 4) AS kurt FROM stats""")
def _(t):
    df = profile.stats_table(t.line(), LINE_FEATURES)
    return rounded(rounded(df, 3, "mean", "median", "std"), 4, "skew", "kurt").withColumn("skew", F.col("skew") + 0.0)


PROFILE = f"""WITH {LINE_LONG}, {OUT}, {STATS}, ends AS (SELECT feature, min(value) AS low, max(value) AS high,
    count(value) AS cnt, count(*) - count(value) AS missing FROM long GROUP BY 1)
  SELECT feature, cnt AS n, missing, round(mean, 3) AS mean, round(median, 3) AS median, round(std, 3) AS std,
    round(skew, 4) + 0 AS skew, round(kurt, 4) AS kurt, round(low, 3) AS low, round(q1, 3) AS q1, round(q3, 3) AS q3,
    round(high, 3) AS high, outliers FROM stats JOIN outl USING (feature) JOIN ends USING (feature)"""


@query("profile_columns", PROFILE)
def _(t):
    df = profile.profile_columns(t.line(), LINE_FEATURES)
    df = rounded(df, 3, "mean", "median", "std", "low", "q1", "q3", "high")
    return rounded(df, 4, "skew", "kurt").withColumn("skew", F.col("skew") + 0.0)


@query("dataset_profile", f"""WITH {LINE_LONG}, {OUT}, {STATS}, {CORR}, {_hist_sql('long')},
  ends AS (SELECT feature, min(value) AS low, max(value) AS high FROM long GROUP BY 1),
  num AS (SELECT * FROM stats JOIN outl USING (feature) JOIN ends USING (feature)),
  tab AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM line)) AS d FROM line)
  SELECT 'table' AS section, 'table' AS name, 'n_rows' AS metric, n::DOUBLE AS value FROM tab
  UNION ALL SELECT 'table', 'table', 'n_columns', 7 UNION ALL SELECT 'table', 'table', 'numeric_columns', 5
  UNION ALL SELECT 'table', 'table', 'categorical_columns', 2 UNION ALL SELECT 'table', 'table', 'missing_total', 0
  UNION ALL SELECT 'table', 'table', 'duplicate_rows', n - d FROM tab
  UNION ALL SELECT 'table', 'target', 'distinct_target', count(DISTINCT l_returnflag) FROM line
  UNION ALL SELECT 'numeric', feature, metric, round(value, 3) FROM (UNPIVOT (SELECT feature, mean, median, std, skew, kurt, low,
     q1, q3, high, outliers::DOUBLE AS outliers FROM num) ON mean, median, std, skew, kurt, low, q1, q3, high, outliers
     INTO NAME metric VALUE value)
  UNION ALL SELECT 'correlation', a || '~' || b, 'corr', round(corr, 3) FROM corr
  UNION ALL SELECT 'histogram', feature || '~' || bin, 'n', n FROM hist""")
def _(t):
    return rounded(profile.dataset_profile(t.line(), "l_returnflag"), 3, "value")


@query("fingerprint", f"""WITH {NULLS} SELECT count(*) AS n_rows, 5 AS n_columns,
  (2 * count(*) - count(price) - count(priority))::BIGINT AS missing_total, 3 AS numeric_columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM nulls)) AS duplicate_rows FROM nulls""")
def _(t):
    return profile.fingerprint(t.null())


@query("class_entropy", """SELECT round(-sum(p * log2(p)), 6) AS class_entropy FROM (
  SELECT count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS p FROM lineitem GROUP BY l_returnflag)""")
def _(t):
    return rounded(profile.class_entropy(t.line(), "l_returnflag"), 6, "class_entropy")


def mi_sql(long):
    """Cells of exact decile bins: a value's bin follows from the rows strictly below it."""
    return f"""ranked AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS below,
   count(*) OVER (PARTITION BY feature) AS n FROM {long}),
 cells AS (SELECT feature, least(floor(below * 10 / n::DOUBLE), 9)::VARCHAR AS x, y, count(*)::DOUBLE AS c FROM ranked GROUP BY ALL)"""


MI = """tot AS (SELECT feature, x, y, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, x) AS cx,
   sum(c) OVER (PARTITION BY feature, y) AS cy FROM cells),
 mi AS (SELECT feature, greatest(sum(c / n * ln(c * n / (cx * cy))), 0) AS mi,
   (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) / (2 * any_value(n)) AS bias, any_value(n)::BIGINT AS n FROM tot GROUP BY 1)"""


@query("mutual_info_class", f"WITH {LINE_LONG}, {mi_sql('long')}, {MI} SELECT feature, round(mi, 7) AS mi, round(bias, 8) AS bias, n FROM mi")
def _(t):
    df = information.mutual_information(t.line(), LINE_FEATURES, "l_returnflag")
    return rounded(rounded(df, 7, "mi"), 8, "bias")


@query("mutual_info_summary", f"WITH {EVENT_LONG}, {mi_sql('long')}, {MI} SELECT round(avg(mi), 7) AS mean_mi, round(max(mi), 7) AS max_mi FROM mi")
def _(t):
    df = information.mutual_information(t.event(), EVENT_FEATURES, "event_type")
    return df.agg(F.round(F.avg("mi"), 7).alias("mean_mi"), F.round(F.max("mi"), 7).alias("max_mi"))


@query("redundancy_score", f"WITH {LINE_LONG}, {mi_sql('long')}, {MI} SELECT round(avg(mi) * 2, 7) AS redundancy_score FROM mi")
def _(t):
    df = information.mutual_information(t.line(), LINE_FEATURES, "l_returnflag")
    return rounded(information.redundancy_score(df), 7, "redundancy_score")


@query("joint_mi", f"""WITH {EVENT}, b AS (SELECT least(floor((rank() OVER (ORDER BY value) - 1) * 10 / (count(*) OVER ())::DOUBLE), 9) AS value,
   least(floor((rank() OVER (ORDER BY hour) - 1) * 10 / (count(*) OVER ())::DOUBLE), 9) AS hour,
   least(floor((rank() OVER (ORDER BY k) - 1) * 10 / (count(*) OVER ())::DOUBLE), 9) AS k FROM event),
  cells AS (SELECT 'value~hour' AS feature, value AS x, hour AS y, count(*)::DOUBLE AS c FROM b GROUP BY ALL
   UNION ALL SELECT 'value~k', value, k, count(*) FROM b GROUP BY ALL UNION ALL SELECT 'hour~k', hour, k, count(*) FROM b GROUP BY ALL),
  {MI} SELECT feature AS pair, round(mi, 7) AS mi, round(bias, 8) AS bias, n FROM mi""")
def _(t):
    return rounded(rounded(information.joint_information(t.event(), EVENT_FEATURES), 7, "mi"), 8, "bias")


@query("mutual_info_regr", """WITH b AS (SELECT least(floor((rank() OVER (ORDER BY p_size) - 1) * 10 / (count(*) OVER ())::DOUBLE), 9) AS a,
   least(floor((rank() OVER (ORDER BY p_partkey) - 1) * 10 / (count(*) OVER ())::DOUBLE), 9) AS k,
   least(floor((rank() OVER (ORDER BY p_retailprice) - 1) * 10 / (count(*) OVER ())::DOUBLE), 9) AS y FROM part),
  cells AS (SELECT 'p_size' AS feature, a AS x, y, count(*)::DOUBLE AS c FROM b GROUP BY ALL
   UNION ALL SELECT 'p_partkey', k, y, count(*) FROM b GROUP BY ALL),
  """ + MI + " SELECT feature, round(mi, 7) AS mi, round(bias, 8) AS bias, n FROM mi")
def _(t):
    df = information.mutual_information(t.part, ["p_size", "p_partkey"], "p_retailprice", regression=True)
    return rounded(rounded(df, 7, "mi"), 8, "bias")


@query("feature_signal", f"""WITH {DOC}, long AS (SELECT 'n_chars' AS feature, n_chars AS value, quality AS y FROM doc), {mi_sql('long')}, c1 AS (
   SELECT 'lang_' || v AS feature, (lang = v)::INT::VARCHAR AS x, quality AS y, count(*)::DOUBLE AS c FROM doc, (SELECT DISTINCT lang AS v FROM doc) GROUP BY ALL
   UNION ALL SELECT 'source_' || v, (source = v)::INT::VARCHAR, quality, count(*) FROM doc, (SELECT DISTINCT source AS v FROM doc) GROUP BY ALL
   UNION ALL SELECT * FROM cells),
  tot AS (SELECT feature, x, y, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, x) AS cx,
   sum(c) OVER (PARTITION BY feature, y) AS cy FROM c1)
  SELECT feature, round(greatest(sum(c / n * ln(c * n / (cx * cy))), 0), 7) AS score FROM tot GROUP BY 1""")
def _(t):
    return rounded(information.feature_signal(t.doc(), ["n_chars", "lang", "source"], "quality"), 7, "score")


@query("dataset_hash", """SELECT count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus,
  o_orderpriority)), 1, 8))::BIGINT)::BIGINT AS content_hash,
  md5('o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderpriority:string') AS schema_hash FROM orders""")
def _(t):
    return profile.dataset_hash(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


META = f"""{LINE_LONG}, {OUT}, {MOMENTS}, {CORR}, {mi_sql('long')}, {MI}, cls AS (SELECT l_returnflag, count(*)::DOUBLE AS n FROM line GROUP BY 1),
 wide AS (SELECT (SELECT count(*) FROM line)::DOUBLE AS l1_n_instances, 6::DOUBLE AS l1_n_features, 5::DOUBLE AS l1_n_numerical,
  1::DOUBLE AS l1_n_categorical, 0::DOUBLE AS l1_missing_pct, (SELECT count(*) FROM cls)::DOUBLE AS l1_n_classes,
  (SELECT least(max(n) / min(n), 1000) FROM cls) AS l1_imbalance_ratio,
  (SELECT avg(skewness) FROM mom) AS l2_mean_skewness, (SELECT avg(kurtosis) FROM mom) AS l2_mean_kurtosis,
  (SELECT round(avg(var_pop), 0) FROM mom) AS l2_mean_variance,
  (SELECT avg(abs(corr)) FROM corr WHERE list_position({LINE_FEATURES}, a) < list_position({LINE_FEATURES}, b)) AS l2_mean_correlation,
  (SELECT sum(outliers) / sum(n)::DOUBLE FROM outl) AS l2_outlier_ratio,
  (SELECT avg(mi) FROM mi) AS l3_mean_mutual_info, (SELECT max(mi) FROM mi) AS l3_max_mutual_info,
  (SELECT -sum(n / s * log2(n / s)) FROM cls, (SELECT sum(n) AS s FROM cls)) AS l3_class_entropy,
  (SELECT avg(mi) * 2 FROM mi) AS l3_redundancy_score)"""


@query("meta_features", f"""WITH {META} SELECT feature_name, round(feature_value, 5) + 0 AS feature_value FROM
  (UNPIVOT wide ON COLUMNS(*) INTO NAME feature_name VALUE feature_value)""")
def _(t):
    from sondage.operators.metafeatures import extract, to_long

    wide = extract(t.line(), "l_returnflag").withColumn("l2_mean_variance", F.round("l2_mean_variance", 0))
    return to_long(wide).select("feature_name", (F.round("feature_value", 5) + 0.0).alias("feature_value"))


@query("meta_features_grouped", """WITH long AS (SELECT c_mktsegment AS dataset_id, o_orderpriority AS y, f AS feature,
   CASE f WHEN 'o_totalprice' THEN o_totalprice ELSE c_acctbal END AS value
   FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT unnest(['o_totalprice', 'c_acctbal']) AS f)),
  per AS (SELECT dataset_id, feature, var_pop(value) AS v, kurtosis_pop(value) AS k,
    skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS s, count(*) AS n FROM long GROUP BY ALL),
  cls AS (SELECT dataset_id, y, count(*) / 2.0::DOUBLE AS n FROM long GROUP BY ALL),
  tot AS (SELECT dataset_id, sum(n) AS n, count(*) AS k, max(n) / min(n) AS r FROM cls GROUP BY 1)
  SELECT per.dataset_id, any_value(tot.n)::BIGINT AS n_instances, any_value(tot.k) AS n_classes, round(any_value(r), 5) AS imbalance_ratio,
   round(avg(s), 4) AS mean_skewness, round(avg(per.k), 4) AS mean_kurtosis, round(avg(v / 1000.0), 2) AS mean_variance_k,
   round(any_value(e), 6) AS class_entropy
  FROM per JOIN tot ON per.dataset_id = tot.dataset_id JOIN (SELECT cls.dataset_id, -sum(cls.n / tot.n * log2(cls.n / tot.n)) AS e
    FROM cls JOIN tot ON cls.dataset_id = tot.dataset_id GROUP BY 1) ent ON per.dataset_id = ent.dataset_id GROUP BY 1""")
def _(t):
    from sondage.operators.metafeatures import extract_grouped

    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("dataset_id"), "o_totalprice", "c_acctbal", "o_orderpriority")
    out = extract_grouped(df, "dataset_id", ["o_totalprice", "c_acctbal"], "o_orderpriority")
    return out.select(
        "dataset_id", "n_instances", "n_classes", F.round("imbalance_ratio", 5).alias("imbalance_ratio"),
        F.round("mean_skewness", 4).alias("mean_skewness"), F.round("mean_kurtosis", 4).alias("mean_kurtosis"),
        F.round(F.col("mean_variance") / 1000, 2).alias("mean_variance_k"), F.round("class_entropy", 6).alias("class_entropy"))


def vector_sql(numeric, categorical, key="id", folds=3):
    """CTEs from ``base (ds, id, columns..., y)`` to ``wide``: all features but the linear machine's, by dataset."""
    features = [*numeric, *categorical]
    long = " UNION ALL ".join(f"SELECT ds, y, '{f}' AS feature, {f}::DOUBLE AS value FROM base WHERE {f} IS NOT NULL" for f in numeric)
    corr = " UNION ALL ".join(
        f"SELECT ds, abs(corr({a}, {b})) AS c FROM base GROUP BY ds" for i, a in enumerate(numeric) for b in numeric[i + 1:])
    filled = [f"coalesce({f}, median({f}) OVER (PARTITION BY ds), 0)::DOUBLE" for f in numeric] + [
        f"(dense_rank() OVER (PARTITION BY ds ORDER BY coalesce({f}, 'missing')) - 1)::DOUBLE" for f in categorical]
    x = ", ".join(f"{e} AS x{i}" for i, e in enumerate(filled))
    z = ", ".join(f"(x{i} - avg(x{i}) OVER w) / CASE WHEN stddev_pop(x{i}) OVER w > 0 THEN stddev_pop(x{i}) OVER w ELSE 1 END" for i in range(len(features)))
    return f"""sets AS (SELECT ds, count(*)::DOUBLE AS n, {' + '.join(f'count_if({c} IS NULL)' for c in (*features, 'y'))} AS gaps FROM base GROUP BY ds),
 cls AS (SELECT ds, y, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY ds) AS t FROM base WHERE y IS NOT NULL GROUP BY ds, y),
 bal AS (SELECT ds, count(*)::DOUBLE AS k, least(max(n) / min(n), 1000) AS r, -sum(n / t * log2(n / t)) AS e FROM cls GROUP BY ds),
 long AS ({long}),
 mom AS (SELECT ds, avg(s) AS s, avg(k) AS k, avg(v) AS v FROM (SELECT ds, skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS s,
   kurtosis_pop(value) AS k, var_pop(value) AS v FROM long GROUP BY ds, feature HAVING count(*) > 3) GROUP BY ds),
 cor AS (SELECT ds, avg(c) AS c FROM ({corr}) WHERE NOT isnan(c) GROUP BY ds),
 kept AS (SELECT * FROM long WHERE y IS NOT NULL),
 qs AS (SELECT ds, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM kept GROUP BY ALL HAVING count(*) >= 4),
 outl AS (SELECT ds, count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*)::DOUBLE AS o FROM kept JOIN qs USING (ds, feature) GROUP BY ds),
 ranked AS (SELECT ds, feature, y, rank() OVER (PARTITION BY ds, feature ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY ds, feature) AS n FROM kept),
 cells AS (SELECT ds, feature, least(floor(below * 10 / n::DOUBLE), 9) AS x, y, count(*)::DOUBLE AS c FROM ranked GROUP BY ALL),
 margins AS (SELECT *, sum(c) OVER (PARTITION BY ds, feature) AS n, sum(c) OVER (PARTITION BY ds, feature, x) AS cx, sum(c) OVER (PARTITION BY ds, feature, y) AS cy FROM cells),
 mi AS (SELECT ds, avg(m) AS mean, max(m) AS high FROM (SELECT ds, feature, greatest(sum(c / n * ln(c * n / (cx * cy))), 0) AS m FROM margins GROUP BY ALL) GROUP BY ds),
 xs AS (SELECT ds, {key} AS id, y, ({f"row_number() OVER (PARTITION BY ds, y ORDER BY md5('42-' || {key}), {key}) - 1) % {folds} AS fold"}, {x} FROM base WHERE y IS NOT NULL),
 zs AS (SELECT ds, id, y, fold, [{z}] AS v FROM xs WINDOW w AS (PARTITION BY ds)),
 zl AS (SELECT ds, id, y, fold, unnest(v) AS v, generate_subscripts(v, 1) AS j FROM zs), g AS (SELECT unnest(range({folds})) AS g),
 nbp AS (SELECT ds, g, y AS c, j, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM zl, g WHERE fold <> g GROUP BY ALL),
 eps AS (SELECT ds, g, max(s) * 1e-9 AS e FROM (SELECT ds, g, var_pop(v) AS s FROM zl, g WHERE fold <> g GROUP BY ds, g, j) GROUP BY ALL),
 pri AS (SELECT ds, g, c, n / sum(n) OVER (PARTITION BY ds, g) AS p FROM nbp WHERE j = 1),
 ll AS (SELECT l.ds, l.id, l.fold, any_value(l.y) AS y, p.c, any_value(ln(pri.p)) - sum(0.5 * ln(greatest(s + e, 1e-300)) + (v - m) * (v - m) / (2 * greatest(s + e, 1e-300))) AS q
   FROM zl l JOIN nbp p ON p.ds = l.ds AND p.g = l.fold AND p.j = l.j JOIN eps ON eps.ds = l.ds AND eps.g = l.fold JOIN pri ON pri.ds = l.ds AND pri.g = l.fold AND pri.c = p.c
   GROUP BY l.ds, l.id, l.fold, p.c),
 counts AS (SELECT ds, g, j, v, y, count(*)::DOUBLE AS n FROM zl, g WHERE fold <> g GROUP BY ALL),
 grid AS (SELECT a.ds, a.g, a.j, a.v, b.y FROM (SELECT DISTINCT ds, g, j, v FROM counts) a JOIN (SELECT DISTINCT ds, y FROM counts) b USING (ds)),
 side AS (SELECT *, sum(coalesce(n, 0)) OVER (PARTITION BY ds, g, j, y ORDER BY v) AS l, sum(coalesce(n, 0)) OVER (PARTITION BY ds, g, j, y) AS t
   FROM grid LEFT JOIN counts USING (ds, g, j, v, y)),
 cut AS (SELECT ds, g, j, v, sum(l * l) / sum(l) + sum((t - l) * (t - l)) / sum(t - l) AS p, sum(t) AS n FROM side GROUP BY ALL HAVING sum(t - l) > 0),
 best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY ds, g ORDER BY round(p / n, 6) DESC, j, v) = 1),
 vote AS (SELECT ds, g, s.v <= b.v AS below, y, sum(n) AS n FROM counts s JOIN (SELECT ds, g, j, v FROM best) b USING (ds, g, j) GROUP BY ALL),
 win AS (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY ds, g, below ORDER BY n DESC, y) = 1),
 nn AS (SELECT a.ds, a.id, a.fold, a.y, b.y AS o FROM zs a JOIN zs b ON a.ds = b.ds AND a.fold <> b.fold
   QUALIFY row_number() OVER (PARTITION BY a.ds, a.id ORDER BY round(list_distance(a.v, b.v), 9), b.id) <= 3),
 pr AS (SELECT 'nb' AS kind, ds, fold, y, c AS y_hat FROM ll QUALIFY row_number() OVER (PARTITION BY ds, id ORDER BY q DESC, c) = 1
   UNION ALL SELECT 'dt', l.ds, l.fold, l.y, w.y FROM zl l JOIN best b ON b.ds = l.ds AND b.g = l.fold AND b.j = l.j
     JOIN win w ON w.ds = l.ds AND w.g = l.fold AND w.below = (l.v <= b.v)
   UNION ALL SELECT 'knn', ds, fold, y, o FROM (SELECT ds, id, fold, y, o, count(*) AS n FROM nn GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ds, id ORDER BY n DESC, o) = 1),
 per AS (SELECT kind, p.ds, fold, c.y AS c, count_if(p.y = c.y)::DOUBLE AS s, count_if(y_hat = c.y)::DOUBLE AS h, count_if(p.y = c.y AND y_hat = c.y)::DOUBLE AS tp FROM pr p JOIN cls c USING (ds) GROUP BY ALL),
 f1s AS (SELECT kind, ds, avg(f) AS f FROM (SELECT kind, ds, fold, sum(s * CASE WHEN s + h > 0 THEN 2 * tp / (s + h) ELSE 0 END) / sum(s) AS f FROM per GROUP BY ALL) GROUP BY ALL),
 wide AS (SELECT ds AS dataset_id, sets.n AS l1_n_instances, {len(features)}::DOUBLE AS l1_n_features, {len(numeric)}::DOUBLE AS l1_n_numerical,
   {len(categorical)}::DOUBLE AS l1_n_categorical, least(gaps / (sets.n * {len(features)}) * 100, 100) AS l1_missing_pct, bal.k AS l1_n_classes, r AS l1_imbalance_ratio,
   mom.s AS l2_mean_skewness, mom.k AS l2_mean_kurtosis, mom.v AS l2_mean_variance, c AS l2_mean_correlation, o AS l2_outlier_ratio,
   mean AS l3_mean_mutual_info, high AS l3_max_mutual_info, mean * 2 AS l3_redundancy_score, bal.e AS l3_class_entropy,
   dt.f AS l4_landmark_dt, nb.f AS l4_landmark_nb, knn.f AS l4_landmark_knn
   FROM sets JOIN bal USING (ds) JOIN mom USING (ds) JOIN cor USING (ds) JOIN outl USING (ds) JOIN mi USING (ds)
   JOIN (SELECT * FROM f1s WHERE kind = 'dt') dt USING (ds) JOIN (SELECT * FROM f1s WHERE kind = 'nb') nb USING (ds) JOIN (SELECT * FROM f1s WHERE kind = 'knn') knn USING (ds))
SELECT dataset_id, feature_name, round(feature_value, 3) + 0 AS feature_value FROM (
  UNPIVOT (SELECT * REPLACE (l2_mean_variance / 1e6 AS l2_mean_variance) FROM wide) ON COLUMNS(* EXCLUDE (dataset_id)) INTO NAME feature_name VALUE feature_value)"""


def _vector_rows(wide):
    """Long and rounded, without the linear machine's score, which SQL does not have."""
    from sondage.operators.metafeatures import to_long

    scaled = wide.withColumn("l2_mean_variance", F.col("l2_mean_variance") / 1e6).drop("l4_landmark_svm")
    return to_long(scaled, ["dataset_id"]).select("dataset_id", "feature_name", (F.round("feature_value", 3) + 0.0).alias("feature_value"))


@query("meta_features_full", f"""WITH {EVENT}, base AS (SELECT 'events' AS ds, event_id AS id, value, hour, k, event_type AS y FROM event),
  {vector_sql(['value', 'hour', 'k'], [])}""")
def _(t):
    from sondage.operators.metafeatures import extract

    return _vector_rows(extract(t.event(), "event_type", "event_id").withColumn("dataset_id", F.lit("events")))


def _orders_by_segment(t):
    return t.null().join(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("dataset_id"), "o_orderkey", "price", "c_acctbal", "priority", "o_orderstatus")


@query("meta_features_many", f"""WITH base AS (SELECT c_mktsegment AS ds, o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, c_acctbal,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority, o_orderstatus AS y FROM orders JOIN customer ON o_custkey = c_custkey),
  {vector_sql(['price', 'c_acctbal'], ['priority'])}""")
def _(t):
    from sondage.operators.metafeatures import extract_many

    return _vector_rows(extract_many(_orders_by_segment(t), "dataset_id", "o_orderkey", ["price", "c_acctbal", "priority"], "o_orderstatus"))


@query("group_count_2d", """SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem
  GROUP BY CUBE (l_linestatus, l_returnflag)""")
def _(t):
    return profile.group_count_2d(t.line(), "l_linestatus", "l_returnflag", margins=True)


@query("mean_by_bin", """WITH b AS (SELECT * FROM (VALUES ('0-12', -1, 12), ('13-24', 12, 24), ('25-48', 24, 48), ('49-72', 48, 72)) v(bin, lo, hi))
  SELECT bin, count(l_quantity) AS n, round(avg(l_extendedprice), 3) AS mean FROM b LEFT JOIN lineitem
  ON l_quantity > lo AND l_quantity <= hi GROUP BY 1""")
def _(t):
    labels = ["0-12", "13-24", "25-48", "49-72"]
    place = right_closed_bin(F.col("l_quantity"), [-1, 12, 24, 48, 72], labels)
    return rounded(profile.mean_by_bin(t.line().where(place.isNotNull()), place, "l_extendedprice", labels), 3, "mean")


@query("flow_links", """WITH f AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
  l AS (SELECT 'c_mktsegment=' || c_mktsegment AS source, 'o_orderpriority=' || o_orderpriority AS sink, count(*) AS n FROM f GROUP BY ALL
   UNION ALL SELECT 'o_orderpriority=' || o_orderpriority, 'o_orderstatus=' || o_orderstatus, count(*) FROM f GROUP BY ALL),
  nd AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS node FROM (SELECT source AS name FROM l UNION SELECT sink FROM l))
  SELECT source, sink, n, a.node AS source_node, b.node AS sink_node FROM l JOIN nd a ON source = a.name JOIN nd b ON sink = b.name""")
def _(t):
    flow = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return profile.flow_links(flow, "c_mktsegment", "o_orderpriority", "o_orderstatus").select(
        "source", "sink", "n", F.col("source_node").cast("long"), F.col("sink_node").cast("long"))


@query("grouped_quantiles", """SELECT event_type, round(min(value), 4) AS low, round(quantile_cont(value, 0.25), 4) AS q1,
  round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, round(max(value), 4) AS high
  FROM events GROUP BY 1""")
def _(t):
    return rounded(profile.grouped_quantiles(t.events, "event_type", "value"), 4, "low", "q1", "median", "q3", "high")


@query("grouped_histogram", f"""WITH long AS (SELECT event_type, 'value' AS feature, value FROM events), {_hist_sql('long', 'event_type')}
  SELECT * FROM hist""")
def _(t):
    return rounded(profile.histogram(t.events, ["value"], by=["event_type"]), 4, "low", "high")


@query("target_histogram", """WITH r AS (SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 30 AS w FROM part),
  c AS (SELECT least(floor((p_retailprice - lo) / w), 29)::BIGINT AS bin, count(*) AS n FROM part, r GROUP BY 1)
  SELECT 'p_retailprice' AS feature, g.bin, round(lo + w * g.bin, 4) AS low, round(lo + w * (g.bin + 1), 4) AS high, coalesce(n, 0) AS n
  FROM (SELECT unnest(range(30)) AS bin) g CROSS JOIN r LEFT JOIN c ON g.bin = c.bin""")
def _(t):
    return rounded(profile.histogram(t.part, ["p_retailprice"], 30, fixed=True), 4, "low", "high")


@query("pair_sample", """SELECT event_id, value, user_id FROM events ORDER BY md5('42-' || event_id), event_id LIMIT 300""")
def _(t):
    return profile.pair_sample(t.events, "event_id", ["value", "user_id"], 300)
