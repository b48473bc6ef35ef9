"""Settings of the engine as frozen records, with the rules that keep them consistent."""

from __future__ import annotations

import dataclasses
import re
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path


class ConfigError(ValueError):
    """A setting is missing, unknown, of the wrong kind, or at odds with another."""


def _need(ok: bool, text: str) -> None:
    if not ok:
        raise ConfigError(text)


def _compiled(pattern: str) -> re.Pattern:
    try:
        return re.compile(pattern)
    except re.error as e:
        raise ConfigError(f"pattern {pattern!r} does not compile: {e}") from e


@dataclass(frozen=True)
class AreaBuckets:
    small_max: float = 0.0025
    medium_max: float = 0.0225

    def __post_init__(self):
        _need(0 < self.small_max < self.medium_max < 1, "0 < small_max < medium_max < 1 has to hold")


@dataclass(frozen=True)
class Fractions:
    train: float = 0.7
    valid: float = 0.15
    test: float = 0.15

    def __post_init__(self):
        _need(all(0 < f < 1 for f in self.all), "each fraction has to lie between 0 and 1")
        _need(abs(sum(self.all) - 1) <= 1e-9, "train, valid and test have to sum to 1")

    @property
    def all(self) -> tuple[float, float, float]:
        return self.train, self.valid, self.test


@dataclass(frozen=True)
class SplitMethod:
    method: str
    recording_pattern: str
    train_only_pattern: str | None = None
    dedupe_copies: bool = False

    def __post_init__(self):
        _need(self.method in ("temporal", "grouped", "eval_only"), f"unknown split method {self.method!r}")
        lacking = {"recording", *(["frame"] if self.method == "temporal" else [])} - set(_compiled(self.recording_pattern).groupindex)
        _need(not lacking, f"recording_pattern needs named groups {sorted(lacking)}")
        if self.train_only_pattern is not None:
            _compiled(self.train_only_pattern)
            _need(self.method == "temporal", "train_only_pattern is for the temporal method")


@dataclass(frozen=True)
class Splits:
    fractions: Fractions = field(default_factory=Fractions)
    buffer_frames: int = 5
    min_recording_images: int = 20
    datasets: dict[str, SplitMethod] = field(default_factory=dict)

    def __post_init__(self):
        _need(self.buffer_frames >= 0, "buffer_frames can't be negative")
        _need(self.min_recording_images >= 3, "a cut needs three images at least")


@dataclass(frozen=True)
class MergeSource:
    role: str
    dedupe_copies: bool = False
    exclude_pattern: str | None = None
    exclude_files: tuple[str, ...] = ()

    def __post_init__(self):
        _need(self.role in ("keep_splits", "train_only"), f"unknown role {self.role!r}")
        if self.exclude_pattern is not None:
            _compiled(self.exclude_pattern)


@dataclass(frozen=True)
class Merge:
    name: str = "merged"
    sources: dict[str, MergeSource] = field(default_factory=dict)
    protected: tuple[str, ...] = ()

    def __post_init__(self):
        both = set(self.sources) & set(self.protected)
        _need(not both, f"{sorted(both)} can't be sources and protected at once")
        _need(not self.sources or any(s.role == "keep_splits" for s in self.sources.values()), "one source at least has to keep its splits")


@dataclass(frozen=True)
class Range:
    start: float
    stop: float
    step: float

    def __post_init__(self):
        _need(0 <= self.start <= self.stop <= 1 and self.step > 0, "a range has to rise within 0 and 1")

    @property
    def values(self) -> list[float]:
        return [round(self.start + i * self.step, 6) for i in range(round((self.stop - self.start) / self.step) + 1)]


@dataclass(frozen=True)
class EdgeRule:
    classes: tuple[str, ...] = ()
    tolerance_px: float = 2.0
    min_overlap: float = 0.5


@dataclass(frozen=True)
class Evaluate:
    confidence: float = 0.5
    iou: float = 0.5
    confidence_floor: float = 0.01
    predictions_per_image: int = 25
    max_cache_bytes: int = 500_000
    curve: Range = field(default_factory=lambda: Range(0.05, 0.95, 0.05))
    resamples: int = 1000
    level: float = 0.95
    edge: EdgeRule | None = None

    def __post_init__(self):
        _need(0 < self.iou < 1 and 0 < self.level < 1, "iou and level have to lie between 0 and 1")
        _need(self.predictions_per_image > 0 and self.resamples > 0, "limits have to be positive")
        _need(self.confidence_floor <= min(self.confidence, self.curve.start), "the floor can't be above a threshold")


@dataclass(frozen=True)
class Diagnose:
    scored_class: str = "fuel"
    localization_floor: float = 0.1
    bins: int = 4
    crowding: tuple[int, ...] = (0, 1, 2, 5, 10)
    gallery_rows: int = 3
    gallery_cols: int = 4
    min_frame_gap: int = 30
    review_per_kind: int = 25
    verdicts: tuple[str, ...] = ("model_error", "label_error", "unclear")

    def __post_init__(self):
        _need(self.crowding[:1] == (0,) and all(a < b for a, b in zip(self.crowding, self.crowding[1:])), "crowding has to start at 0 and rise")
        _need(self.bins > 0 and self.gallery_rows * self.gallery_cols > 0, "bins and tiles have to be positive")


@dataclass(frozen=True)
class Costs:
    false_positive: float = 3.0
    false_negative: float = 1.0


@dataclass(frozen=True)
class Threshold:
    scored_class: str = "fuel"
    grid: Range = field(default_factory=lambda: Range(0.05, 0.95, 0.01))
    costs: Costs = field(default_factory=Costs)
    band: float = 0.05
    tuning: tuple[str, ...] = ()
    held_out: tuple[str, ...] = ()

    def __post_init__(self):
        both = set(self.tuning) & set(self.held_out)
        _need(not both, f"{sorted(both)} can't be tuned on and held out at once")


@dataclass(frozen=True)
class Project:
    seed: int = 2026
    area_buckets: AreaBuckets = field(default_factory=AreaBuckets)
    box_tolerance_px: float = 1.0
    near_distance: int = 4
    max_examples: int = 20
    splits: Splits = field(default_factory=Splits)
    merge: Merge = field(default_factory=Merge)
    evaluate: Evaluate = field(default_factory=Evaluate)
    diagnose: Diagnose = field(default_factory=Diagnose)
    threshold: Threshold = field(default_factory=Threshold)

    def __post_init__(self):
        _need(0 <= self.near_distance <= 64, "a distance of 64-bit hashes lies between 0 and 64")
        _need(self.threshold.grid.start >= self.evaluate.confidence_floor, "the threshold grid can't start below the floor")


def build(kind, told, where: str = ""):
    """An instance of a record from plain data; unknown keys and wrong kinds raise with their place."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (types.UnionType, typing.Union):
        return None if told is None and type(None) in args else build(next(a for a in args if a is not type(None)), told, where)
    if origin is dict:
        _need(isinstance(told, dict), f"{where}: expected a mapping")
        return {k: build(args[1], v, f"{where}.{k}") for k, v in told.items()}
    if origin is tuple:
        _need(isinstance(told, list | tuple), f"{where}: expected a list")
        return tuple(build(args[0], v, f"{where}[{i}]") for i, v in enumerate(told))
    if dataclasses.is_dataclass(kind):
        _need(isinstance(told, dict), f"{where or kind.__name__}: expected a mapping")
        hints = typing.get_type_hints(kind)
        unknown = sorted(set(told) - set(hints))
        _need(not unknown, f"{where or kind.__name__}: unknown keys {unknown}")
        try:
            return kind(**{k: build(hints[k], v, f"{where}.{k}".lstrip(".")) for k, v in told.items()})
        except TypeError as e:
            raise ConfigError(f"{where or kind.__name__}: {e}") from e
    if kind is float and isinstance(told, int) and not isinstance(told, bool):
        told = float(told)
    _need(isinstance(told, kind) and not (kind is int and isinstance(told, bool)), f"{where}: expected {kind.__name__}, got {told!r}")
    return told


def load(path: str | Path, kind=Project):
    """Settings from a JSON file, or a YAML file where a YAML reader is installed."""
    import json

    path = Path(path)
    try:
        text = path.read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e}") from e
    try:
        if path.suffix in (".yaml", ".yml"):
            import yaml

            told = yaml.safe_load(text)
        else:
            told = json.loads(text)
    except Exception as e:
        raise ConfigError(f"{path} isn't readable: {e}") from e
    try:
        return build(kind, told)
    except ConfigError as e:
        raise ConfigError(f"{path}: {e}") from e


def check_targets(mapping: dict[str, str], classes: list[str], drop: str = "DROP") -> None:
    """Every target has to be a class or the drop word, and no class may be listed twice."""
    _need(len(set(classes)) == len(classes), "a class is listed twice")
    wrong = sorted({t for t in mapping.values() if t not in classes and t != drop})
    _need(not wrong, f"unknown targets {wrong}")
