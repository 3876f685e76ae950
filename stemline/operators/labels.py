"""Labels, filters and predicates on points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemline.functions.guards import col, ratio

KEYS = ("plot", "point_id")


def binary_label(classification: Column | str = "classification") -> Column:
    """0 for low vegetation and terrain, 1 for stems and branches, -1 for every other code."""
    c = col(classification)
    return F.when(c.isin(1, 2), 0).when(c.isin(4, 5, 6), 1).otherwise(-1).cast("int")


def valid(points: DataFrame, label: str = "label") -> DataFrame:
    return points.where(F.col(label) != -1)


def tree_points(points: DataFrame, pred: str = "semantic_pred", hag: str = "hag", min_hag: float = 0.5, require_valid: bool = True) -> DataFrame:
    """Predicted tree points from a height on; by default only those with a valid label."""
    kept = points.where((F.col(pred) == 1) & (F.col(hag) >= min_hag))
    return valid(kept) if require_valid else kept


def ground_points(points: DataFrame, code: int = 2) -> DataFrame:
    return points.where(F.col("classification") == code)


def scale_intensity(points: DataFrame, plot: str = "plot", intensity: str = "intensity") -> DataFrame:
    """Intensity over the greatest of the plot; unchanged where that is not positive.

    The maximum is combined before it is shuffled, so a large plot never meets in one task."""
    top = points.groupBy(plot).agg(F.max(intensity).alias("_top"))
    value = F.when(F.col("_top") > 0, ratio(intensity, "_top", None)).otherwise(F.col(intensity))
    return points.join(top, plot).withColumn(intensity, value.cast("float")).drop("_top")


def scatter(full: DataFrame, part: DataFrame, defaults: dict[str, int | float], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Columns of ``part`` brought back to all rows of ``full``, with a default where a row has none."""
    some = part.select(*keys, *[F.col(c).alias(f"_{c}") for c in defaults])
    kept = [c for c in full.columns if c not in defaults]
    return full.select(*kept).join(some, list(keys), "left").select(*kept, *[F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in defaults.items()])


def plot_key(path: Column | str) -> tuple[Column, Column]:
    """(parent__stem, parent) of a file path."""
    parent, stem = F.regexp_extract(col(path), r"([^/]+)/[^/]+$", 1), F.regexp_extract(col(path), r"([^/]+?)(\.[^./]*)?$", 1)
    return F.concat_ws("__", parent, stem), parent


def institution(plot: Column | str) -> Column:
    """What stands before a slash, or ``unknown``."""
    return F.when(F.contains(col(plot), F.lit("/")), F.split(col(plot), "/")[0]).otherwise(F.lit("unknown"))


def confusion_class(gt: Column | str, pred: Column | str) -> Column:
    g, p = col(gt), col(pred)
    return (
        F.when((g == -1) | g.isNull(), "Excl").when((g == 1) & (p == 1), "TP").when((g == 0) & (p == 0), "TN").when((g == 0) & (p == 1), "FP").when((g == 1), "FN").otherwise("TN")
    )


def overlay_code(gt: Column | str, pred: Column | str) -> Column:
    """1 and 0 for right tree and other points, 2 for false and -2 for missed trees, null for excluded points."""
    kind = confusion_class(gt, pred)
    return F.when(kind == "TP", 1).when(kind == "TN", 0).when(kind == "FP", 2).when(kind == "FN", -2)


def slab(points: DataFrame, half: float, axis: str = "y", by: str = "plot", strict: bool = False) -> DataFrame:
    """Points within ``half`` of the middle of their plot's extent; all of a plot whose slab is empty."""
    mid = points.groupBy(by).agg(((F.min(axis) + F.max(axis)) / 2).alias("_mid"))
    away = F.abs(F.col(axis) - F.col("_mid"))
    marked = points.join(mid, by).withColumn("_in", away < half if strict else away <= half)
    if strict:
        return marked.where("_in").drop("_in", "_mid")
    some = marked.groupBy(by).agg(F.max("_in").alias("_some"))
    return marked.join(some, by).where(F.col("_in") | ~F.col("_some")).drop("_in", "_some", "_mid")


def window_of(x: Column | str, y: Column | str, cx: Column | float, cy: Column | float, half: float) -> Column:
    """Strictly within a square around a centre."""
    return (F.abs(col(x) - cx) < half) & (F.abs(col(y) - cy) < half)


def border(points: DataFrame, percent: float, by: str = "plot") -> DataFrame:
    """``points`` with ``border``: whether a point lies within percent of its plot's bounding box from an edge."""
    box = points.groupBy(by).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    mx, my = (F.col("_x1") - F.col("_x0")) * percent / 100, (F.col("_y1") - F.col("_y0")) * percent / 100
    edge = (F.col("x") < F.col("_x0") + mx) | (F.col("x") > F.col("_x1") - mx) | (F.col("y") < F.col("_y0") + my) | (F.col("y") > F.col("_y1") - my)
    return points.join(box, by).withColumn("border", edge).drop("_x0", "_x1", "_y0", "_y1")


def mapped(value: Column | str, table: dict[str, str], default: str | None = None) -> Column:
    """A value's entry in a small fixed table."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, col(value))
    return found if default is None else F.coalesce(found, F.lit(default))


def pretty(value: Column | str) -> Column:
    return F.replace(F.split(col(value), ":")[0], F.lit("_"), F.lit(" "))


def subset(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that there are."""
    return df.select(*[c for c in columns if c in df.columns])


def first_row(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first row with a key, or none."""
    return df.where(F.col(key) == value).orderBy(order).limit(1)


def plots_like(rows: DataFrame, part: str, plot: str = "plot") -> DataFrame:
    """Rows whose plot name holds a string."""
    return rows.where(F.contains(F.col(plot), F.lit(part)))
