"""Parameters of the experiment, as frozen dataclasses on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

#: The five methods in report order, and the pairs that are compared (first, second).
METHODS = ("baseline", "rf", "pointnet2", "rf_density", "pointnet2_density")
COMPARISONS = (
    ("rf", "rf_density"),
    ("pointnet2", "pointnet2_density"),
    ("baseline", "rf_density"),
    ("rf", "pointnet2"),
    ("rf_density", "pointnet2_density"),
)
#: Preprocessing and seeding of each method.
DESIGN = {
    "baseline": ("none", "chm"),
    "rf": ("rf", "chm"),
    "pointnet2": ("pointnet2", "chm"),
    "rf_density": ("rf", "density"),
    "pointnet2_density": ("pointnet2", "density"),
}


@dataclass(frozen=True)
class Data:
    random_state: int = 42
    val_split: float = 0.2


@dataclass(frozen=True)
class Terrain:
    resolution: float = 0.5
    hag_min: float = 0.0
    hag_max: float = 50.0
    smooth_window: int = 5
    min_tree_hag: float = 0.5


@dataclass(frozen=True)
class Features:
    k_small: int = 20
    k_large: int = 50
    density_radius: float = 0.5
    max_neighbor_distance: float = 5.0


@dataclass(frozen=True)
class Forest:
    trees: int = 200
    max_depth: int | None = None
    seed: int = 42
    max_samples_per_class: int = 12_000


@dataclass(frozen=True)
class Blocks:
    points: int = 8192
    classes: int = 2
    jitter: float = 0.02
    scale_low: float = 0.9
    scale_high: float = 1.1
    min_passes: int = 50
    max_passes: int = 1000


@dataclass(frozen=True)
class Watershed:
    voxel_size: float = 0.1
    min_tree_height: float = 2.0
    min_points_per_tree: int = 50
    gaussian_sigma: float = 0.5
    min_crown_radius_m: float = 1.0
    top_band_m: float = 3.0


@dataclass(frozen=True)
class Evaluation:
    iou_threshold: float = 0.5


@dataclass(frozen=True)
class Config:
    data: Data = field(default_factory=Data)
    terrain: Terrain = field(default_factory=Terrain)
    features: Features = field(default_factory=Features)
    forest: Forest = field(default_factory=Forest)
    blocks: Blocks = field(default_factory=Blocks)
    watershed: Watershed = field(default_factory=Watershed)
    evaluation: Evaluation = field(default_factory=Evaluation)


def from_mapping(values: dict[str, dict[str, Any]], kind: type = Config) -> Any:
    """A config from nested mappings such as a parsed YAML file; unknown names raise."""
    known = {f.name: f for f in fields(kind)}
    if wrong := set(values) - set(known):
        raise ValueError(f"unknown settings: {sorted(wrong)}")
    made = {}
    for name, value in values.items():
        default = known[name].default_factory() if is_dataclass(kind) and kind is Config else None
        made[name] = from_mapping(value, type(default)) if default is not None else value
    return kind(**made)


def load(path: str) -> Config:
    """Read a config file of two levels, ``group:`` and ``  name: scalar``."""
    values: dict[str, dict[str, Any]] = {}
    group = ""
    with open(path, encoding="utf-8") as file:
        for line in file:
            body = line.split("#", 1)[0].rstrip()
            if not body:
                continue
            name, _, value = body.strip().partition(":")
            if not body.startswith(" "):
                group = name
                values[group] = {}
            else:
                values[group][name] = _scalar(value.strip())
    return from_mapping(values)


def _scalar(text: str) -> Any:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return {"true": True, "false": False, "null": None}.get(text.lower(), text.strip("'\""))
