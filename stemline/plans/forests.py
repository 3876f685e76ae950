"""Registered queries of decision trees, with SQL forms that grow a tree level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.operators import labels, sampling, trees
from stemline.plans.projections import points
from stemline.plans.registry import LABEL, RP, draw_sql, query
from stemline.sources.shared import folder

NAMES = ("x", "y", "z")
CAP = 40


def _best_sql(rows: str) -> str:
    """The split of each node of ``rows`` (node, label, x, y, z) with the least weighted impurity."""
    over = "OVER (PARTITION BY node, i ORDER BY v)"
    whole = "OVER (PARTITION BY node, i)"
    gini = "(({0}) + ({1})) - (({0}) * ({0}) + ({1}) * ({1})) / (({0}) + ({1}))"
    cost = f"{gini.format('CAST(a0 AS DOUBLE)', 'CAST(a1 AS DOUBLE)')} + ({gini.format('CAST(t0 - a0 AS DOUBLE)', 'CAST(t1 - a1 AS DOUBLE)')})"
    return f"""(SELECT node, i, v, (v + nx) / 2 AS split, {cost} AS cost FROM (SELECT node, i, v, LEAD(v) {over} AS nx, SUM(k0) {over} AS a0, SUM(k1) {over} AS a1, SUM(k0) {whole} AS t0, SUM(k1) {whole} AS t1
  FROM (SELECT node, i, v, COUNT(*) FILTER (label = 0) AS k0, COUNT(*) FILTER (label = 1) AS k1 FROM (SELECT node, label, UNNEST([0, 1, 2]) AS i, UNNEST([x, y, z]) AS v FROM {rows}) GROUP BY node, i, v))
  WHERE nx IS NOT NULL AND t0 > 0 AND t1 > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY cost, i, v) = 1)"""


VALUE = "CASE b.i WHEN 0 THEN r.x WHEN 1 THEN r.y ELSE r.z END"
NODES_SQL = f"""{RP}, tr AS MATERIALIZED (SELECT point_id, label, x, y, z FROM (SELECT *, {LABEL} AS label FROM p) WHERE label >= 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY plot, label ORDER BY {draw_sql(42, "plot", "label", "point_id")}, point_id) <= {CAP}),
r(node, label, x, y, z) AS (SELECT '', label, x, y, z FROM tr UNION ALL SELECT r.node || CASE WHEN {VALUE} <= b.v THEN 'L' ELSE 'R' END, r.label, r.x, r.y, r.z FROM r JOIN {_best_sql("r")} b ON b.node = r.node),
e AS MATERIALIZED (SELECT * FROM r), b AS MATERIALIZED (SELECT * FROM {_best_sql("e")}),
nodes AS MATERIALIZED (SELECT e.node, ['x', 'y', 'z'][ANY_VALUE(b.i) + 1] AS feature, ANY_VALUE(b.i) AS i, ANY_VALUE(b.split) AS split, CAST(COUNT(*) AS DOUBLE) AS n, CAST(COUNT(*) FILTER (label = 0) AS DOUBLE) AS n0, CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) AS n1, ANY_VALUE(b.cost) AS cost FROM e LEFT JOIN b ON b.node = e.node GROUP BY e.node),
gains AS MATERIALIZED (SELECT *, CASE WHEN feature IS NULL THEN 0 ELSE n - (n0 * n0 + n1 * n1) / n - cost END AS gain FROM nodes)"""


def _tree(spark: SparkSession, d: str, few: int = 20_000) -> DataFrame:
    p = labels.valid(points(spark, d).withColumn("label", labels.binary_label()))
    return trees.train(sampling.cap_per_class(p, CAP, ("plot", "label")), NAMES, 1, len(NAMES), bootstrap=False, balanced=False, few=few)


@query(f"{NODES_SQL} SELECT node, COALESCE(feature, '') AS feature, ROUND(COALESCE(split, 0), 6) + 0.0 AS split, n, n0, n1, ROUND(gain, 6) + 0.0 AS gain FROM gains")
def forest_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One tree on capped samples of every plot and class; levels of large nodes are relational, and 200 rows are a small node."""
    rounded = lambda c: (F.round(F.coalesce(c, F.lit(0.0)), 6) + 0.0).alias(c)
    return _tree(spark, d, 200).select("node", F.coalesce("feature", F.lit("")).alias("feature"), rounded("split"), "n", "n0", "n1", rounded("gain"))


@query(
    f"""{NODES_SQL}, wk(plot, point_id, x, y, z, node) AS (SELECT plot, point_id, x, y, z, '' FROM p UNION ALL SELECT plot, point_id, x, y, z, r.node || CASE WHEN CASE b.i WHEN 0 THEN x WHEN 1 THEN y ELSE z END <= b.split THEN 'L' ELSE 'R' END FROM wk r JOIN gains b ON b.node = r.node AND b.feature IS NOT NULL)
SELECT plot, point_id, CAST(CASE WHEN n1 / n > 0.5 THEN 1 ELSE 0 END AS INT) AS semantic_pred, ROUND(n1 / n, 6) AS p1 FROM wk JOIN gains g ON g.node = wk.node WHERE g.feature IS NULL"""
)
def forest_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The tree's class of every point."""
    return trees.predict(_tree(spark, d), points(spark, d), NAMES).select("plot", "point_id", "semantic_pred", F.round("p1", 6).alias("p1"))


@query(f"{NODES_SQL} SELECT feature, ROUND(SUM(gain) / SUM(SUM(gain)) OVER (), 6) AS importance FROM gains WHERE feature IS NOT NULL GROUP BY feature ORDER BY importance DESC LIMIT 10")
def forest_importances(spark: SparkSession, d: str) -> DataFrame:
    """The ten greatest importances of the tree, from its stored table of nodes."""
    path = f"{folder(spark)}/forest-{spark.sparkContext.applicationId}-{id(d)}"
    trees.save(_tree(spark, d), path)
    return trees.importances(trees.load(spark, path)).select("feature", F.round("importance", 6).alias("importance")).limit(10)
