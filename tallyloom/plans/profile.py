"""Profiles and exploratory analyses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog import query, table
from tallyloom.operators import profile as P

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_TEXTS = ["l_returnflag", "l_linestatus"]
DESCRIBE = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS "min", round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, max({c}) AS "max" FROM lineitem""" for c in LINE_NUMBERS)
CATEGORICAL = " UNION ALL ".join(f"""(SELECT '{c}' AS "column", sum(n)::BIGINT AS "count", count(*) AS "unique", min_by(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1))""" for c in LINE_TEXTS)


@query("""SELECT 'quality' AS "column", count(*) FILTER (WHERE quality IS NULL) AS "value" FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL) FROM documents LEFT JOIN labels USING (doc_id)""")
def profile_nulls(spark, sf_dir):
    return P.null_counts(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"))


@query(DESCRIBE)
def profile_numeric(spark, sf_dir):
    return P.describe_numeric(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)


@query(CATEGORICAL)
def profile_categorical(spark, sf_dir):
    return P.describe_categorical(table(spark, sf_dir, "lineitem"), LINE_TEXTS)


@query("SELECT o_orderkey, to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority})::VARCHAR AS record FROM orders ORDER BY o_orderkey LIMIT 5")
def profile_sample(spark, sf_dir):
    """The first five rows as JSON records."""
    rows = table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(5)
    return rows.select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")).alias("record"))


@query("""SELECT column_name AS "column", CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'other' END AS kind FROM (DESCRIBE lineitem) t(column_name, data_type, a, b, c, d)""")
def profile_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    kind = lambda c: "numeric" if c in P.numeric_columns(df) else "text" if c in P.text_columns(df) else "other"
    return spark.createDataFrame([(c, kind(c)) for c in df.columns], "column string, kind string")


@query("SELECT * FROM (VALUES ('lineitem', 'numerisch,kategorisch,zeitreihe'), ('documents_with_labels', 'numerisch,kategorisch,fehlende_werte'), ('region', 'numerisch,kategorisch')) t(table_name, analyses)")
def profile_skills(spark, sf_dir):
    """Which analyses each table calls for; only whether there are nulls is read from the data."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tables = {"lineitem": table(spark, sf_dir, "lineitem"), "documents_with_labels": labelled, "region": table(spark, sf_dir, "region")}
    rows = [(n, ",".join(P.choose_analyses(df, not P.null_counts(df).isEmpty()))) for n, df in tables.items()]
    return spark.createDataFrame(rows, "table_name string, analyses string")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_value_counts(spark, sf_dir):
    return P.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS rn FROM c)
SELECT CASE WHEN rn <= 20 THEN p_brand ELSE 'rest' END AS name, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def agg_top20_rest(spark, sf_dir):
    """The twenty most frequent values and what is left, as one row."""
    counts = P.value_counts(table(spark, sf_dir, "part"), "p_brand")
    best = counts.orderBy(F.desc("n"), "p_brand").limit(20)
    rest = counts.agg(F.sum("n").alias("every")).crossJoin(best.agg(F.sum("n").alias("top"))).select(F.lit("rest").alias("name"), (F.col("every") - F.col("top")).alias("n")).where("n > 0")
    return best.select(F.col("p_brand").alias("name"), "n").unionByName(rest)


@query("SELECT floor(value / 10) * 10 AS bin, count(*) AS n FROM events GROUP BY 1")
def eda_histogram(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "events"), "value", 10.0)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for k, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[k + 1 :]))
def eda_corr(spark, sf_dir):
    return P.correlations(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) SELECT event_id, value FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def eda_outlier_iqr(spark, sf_dir):
    return P.iqr_outliers(table(spark, sf_dir, "events"), "value").select("event_id", "value")


@query("WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, value FROM events, s WHERE abs(value - m) > 3 * s")
def eda_outlier_z(spark, sf_dir):
    return P.z_outliers(table(spark, sf_dir, "events"), "value").select("event_id", "value")


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1")
def eda_group_mean(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("SELECT lang, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS \"view\", count(*) FILTER (WHERE event_type = 'error') AS error FROM (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS lang FROM events) GROUP BY 1")
def eda_crosstab(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("lang", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return P.crosstab(events, "lang", "event_type", ["click", "view", "error"])


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS missing, round(count(*) FILTER (WHERE quality IS NULL) / count(*)::DOUBLE, 6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def eda_missing_by_group(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    missing = F.count_if(F.col("quality").isNull())
    return both.groupBy("lang").agg(F.count("*").alias("n"), missing.alias("missing"), F.round(missing / F.count("*"), 6).alias("share"))


MONTHLY = "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"


@query(MONTHLY)
def eda_monthly(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT isodow(ts)::BIGINT AS weekday, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1")
def eda_weekday(spark, sf_dir):
    day = (F.weekday("ts") + 1).cast("long").alias("weekday")
    return table(spark, sf_dir, "events").groupBy(day).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(sum(value)) OVER (ORDER BY strftime(ts, '%Y-%m-%d') ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling FROM events GROUP BY 1")
def eda_rolling(spark, sf_dir):
    """Mean of seven days; the window runs over one row per day, not over events."""
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("value").alias("v"))
    return days.select("day", F.round(F.avg("v").over(Window.orderBy("day").rowsBetween(-6, 0)), 4).alias("rolling"))


@query(f"SELECT month, total, round(total / lag(total) OVER (ORDER BY month) - 1, 6) AS growth FROM ({MONTHLY})")
def eda_growth(spark, sf_dir):
    monthly = eda_monthly(spark, sf_dir).withColumn("_all", F.lit(1))
    return P.growth(monthly, "month", "total", "_all").select("month", "total", "growth")


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 2, 8) ORDER BY vec_id LIMIT 300")
def emb_label_head(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 2, 8)).orderBy("vec_id").limit(300).select("vec_id", "label")


BUCKET = "('0x' || substring(md5({}::VARCHAR), 1, 7))::BIGINT % 100"


@query(f"SELECT vec_id, CASE WHEN {BUCKET.format('vec_id')} < 80 THEN 'train' ELSE 'test' END AS part FROM embeddings")
def split_hash(spark, sf_dir):
    """An 80/20 split that is the same each time."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(P.hash_bucket(F.col("vec_id")) < 80, "train").otherwise("test").alias("part"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part ORDER BY md5(p_partkey || ':0') , p_partkey LIMIT 12) ORDER BY md5(p_partkey || ':1'), p_partkey LIMIT 12")
def rotate_pick(spark, sf_dir):
    """Twelve terms that the pick before did not use, in the order of a hash."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    order = lambda k: F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(f":{k}")))
    used = parts.orderBy(order(0), "p_partkey").limit(12).select("p_partkey")
    return parts.join(F.broadcast(used), "p_partkey", "left_anti").orderBy(order(1), "p_partkey").limit(12)


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::BIGINT AS batch FROM conversations")
def batch_40(spark, sf_dir):
    """Numbered batches within each log (of 3 here, of 40 paragraphs in a document)."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor((n - 1) / 3).alias("batch"))
