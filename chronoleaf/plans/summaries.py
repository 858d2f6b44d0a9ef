"""Driver queries on text scores (each turn of a conversation is the reference of the turn after it), and queries in SQL alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoleaf.functions import sql
from chronoleaf.operators import graph, metrics
from chronoleaf.operators import text_scores as ts
from chronoleaf.plans.base import stored, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), after.alias("pred"), F.col("text").alias("ref")).filter("pred IS NOT NULL")


@query(r"""WITH t AS (SELECT conv_id * 100 + turn AS id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
x AS (SELECT id, list_filter(string_split_regex(nxt, '\s+'), lambda w: w <> '') AS p, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS r FROM t WHERE nxt IS NOT NULL),
w AS (SELECT id, 0 AS s, p AS w FROM x UNION ALL SELECT id, 1, r FROM x),
f AS (SELECT id, s, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM w, (VALUES (1), (2), (3), (4)) AS v(n)),
per AS (SELECT id, n, g, count_if(s = 0) AS cp, count_if(s = 1) AS cr FROM f GROUP BY ALL), df AS (SELECT n, g, count_if(cr > 0) AS df FROM per GROUP BY ALL),
v AS (SELECT id, n, cp, cr, cp * i AS vp, cr * i AS vr FROM (SELECT *, ln((SELECT count(*) FROM x)::DOUBLE) - ln(greatest(df, 1)::DOUBLE) AS i FROM per JOIN df USING (n, g))),
s AS (SELECT id, n, sum(least(vp, vr) * vr) AS dot, sqrt(sum(vp * vp)) AS lp, sqrt(sum(vr * vr)) AS lr, sum(cp) - sum(cr) AS d FROM v GROUP BY ALL),
b AS (SELECT id, sum(CASE WHEN lp * lr > 0 THEN dot / (lp * lr) ELSE 0 END) AS t, coalesce(max(d) FILTER (WHERE n = 2), 0)::DOUBLE AS d FROM s GROUP BY id)
SELECT id, round(coalesce(1e1 * t / 4 * exp(-d * d / 72), 0), 6) AS cider FROM x LEFT JOIN b USING (id)""")
def summary_cider(spark: SparkSession, sf: str) -> DataFrame:
    return ts.cider(turns(spark, sf), "id").select("id", F.round("cider", 6).alias("cider"))


@query()
def summary_meteor(spark: SparkSession, sf: str) -> DataFrame:
    """Compared with brute force over all alignments in the tests."""
    return ts.meteor(turns(spark, sf), "id").select("id", "matches", "chunks", F.round("meteor", 6).alias("meteor"))


SAID = "CASE o_orderkey % 5 WHEN 0 THEN '<answer>ABSTAIN</answer>' WHEN 1 THEN 'no idea' ELSE '<answer>[' || (o_orderkey % 90) || '.5, ' || (o_orderkey % 70) || ']</answer>' END"
LOW, HIGH = "least(o_orderkey % 90 + 0.5, o_orderkey % 70)::DOUBLE", "greatest(o_orderkey % 90 + 0.5, o_orderkey % 70)::DOUBLE"


@query(f"""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'abstain' WHEN 1 THEN 'bad' ELSE 'span' END AS kind, {LOW} AS t0, {HIGH} AS t1, o_totalprice / 30 AS d, o_orderpriority FROM orders), i AS (SELECT *, greatest(0, least(t1, 40) - greatest(t0, 10)) AS i FROM s)
SELECT o_orderkey, kind, CASE WHEN kind = 'span' THEN round(i / (t1 - t0 + 30 - i), 6) END AS iou, CASE WHEN d / 60 < 30 THEN '<30min' WHEN d / 60 < 60 THEN '30-60min' WHEN d / 60 < 120 THEN '60-120min' ELSE '>120min' END AS len_bucket, CASE WHEN d < 2700 THEN 'short' WHEN d >= 7200 THEN 'retrieve' ELSE 'hier' END AS regime FROM i""")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """A query written in SQL alone, with the engine's functions in it."""
    sql.register(spark)
    return spark.sql(
        f"""WITH said AS (SELECT o_orderkey, parse_answer({SAID}) AS p, CAST(o_totalprice / 30 AS DOUBLE) AS d, o_orderpriority FROM {{orders}})
        SELECT o_orderkey, p.kind, CASE WHEN p.kind = 'span' THEN round(tiou(get(p.spans, 0).t0, get(p.spans, 0).t1, 10D, 40D), 6) END AS iou, length_bucket(d) AS len_bucket, regime(d, o_orderpriority) AS regime FROM said""",
        orders=table(spark, sf, "orders"),
    )


TRADE = """f AS (SELECT s_nationkey AS a, c_nationkey AS b, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
edges AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY q DESC, b) AS k FROM f) WHERE k = 1)"""


@query(f"WITH RECURSIVE {TRADE}, c(a, b, d) AS (SELECT a, b, 1 FROM edges UNION ALL SELECT c.a, e.b, d + 1 FROM c JOIN edges e ON c.b = e.a WHERE d < 30) SELECT DISTINCT a, b FROM c")
def graph_closure_trade(spark: SparkSession, sf: str) -> DataFrame:
    """The closure of a graph from the tables: each nation of suppliers with the nation of customers that takes most of its goods."""
    t = lambda name: table(spark, sf, name)
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    flow = x.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.sum("l_quantity").alias("q"))
    # the closure reads its edges at every level: they are written first, a row for each nation
    return graph.closure(stored(flow.groupBy("a").agg(F.max_by("b", F.struct("q", -F.col("b"))).alias("b")), "edges"))


@query("""WITH g AS (SELECT o_custkey, list(o_orderkey % 400 ORDER BY o_orderdate, o_orderkey) AS g, list(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 400 + 1 ELSE o_orderkey % 400 END ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderkey % 11 <> 0) AS p FROM orders GROUP BY 1),
d AS (SELECT o_custkey, len(g) AS m, len(coalesce(p, [])) AS n, list_reduce(coalesce(p, []), lambda row, x, i: list_transform(generate_series(0, len(g)), lambda j: list_min(list_transform(generate_series(0, j), lambda k: j - k + CASE WHEN k = 0 THEN row[1] + 1 ELSE least(row[k + 1] + 1, row[k] + CASE WHEN g[k] = x THEN 0 ELSE 1 END) END))), generate_series(0, len(g))) AS row FROM g)
SELECT o_custkey, round((1 - row[m + 1]::DOUBLE / greatest(m, n)) * 100, 6) AS edit FROM d""".replace("lambda row, x, i:", "lambda row, x:"))
def edit_score_many_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Edit scores of each customer's orders as runs of 400 labels, against the same with changed and missing ones."""
    o = table(spark, sf, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("run_id"), (F.col("o_orderkey") % 400).alias("code"), "o_orderkey")
    gt = o.select("o_custkey", F.lit("gt").alias("side"), "run_id", "code")
    pred = o.filter("o_orderkey % 11 <> 0").select("o_custkey", F.lit("pred").alias("side"), "run_id", F.when(F.col("o_orderkey") % 7 == 0, F.col("code") + 1).otherwise(F.col("code")).alias("code"))
    return metrics.edit_score(gt.union(pred), ["o_custkey"], "pred", "gt").select("o_custkey", F.round("edit", 6).alias("edit"))
