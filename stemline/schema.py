"""Explicit schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "f": T.FloatType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


POINTS = _struct("plot:s institution:s point_id:l x:d y:d z:d intensity:f return_number:i number_of_returns:i classification:i tree_id:i")
INSTANCE_METRICS = _struct("plot:s institution:s TP:l FP:l FN:l precision:d recall:d f1:d coverage:d n_gt_trees:l n_pred_trees:l mean_iou_matched:d over_seg:d under_seg:d")
SEMANTIC_METRICS = _struct("plot:s institution:s sem_accuracy:d sem_iou_tree:d sem_iou_notree:d sem_miou:d sem_seg_f1:d sem_n_points_evaluated:d")
MANIFEST = _struct("path:s folder:s split:s")
PREDICTIONS = _struct("method:s plot:s point_id:l semantic_pred:i instance_id:i")
BEST_PARAMS = _struct("method:s voxel_size:d gaussian_sigma:d min_crown_radius_m:d top_band_m:d mean_f1:d")
