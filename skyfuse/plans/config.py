"""Configuration: frozen defaults, files that build on others, and overrides by dotted name."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path

from ..functions.camera import Camera
from ..functions.scores import Prior
from ..operators.terrain import Rays


@dataclass(frozen=True)
class Windows:
    size: int = 1024
    overlap: float = 0.5
    most_prompts: int = 3
    min_score: float = 0.45
    min_area_px: float = 500.0


@dataclass(frozen=True)
class Fusion:
    image_nms: bool = True
    image_iou: float = 0.2
    views: bool = True
    views_k: int = 5
    views_iou: float = 0.1
    views_distance: float = 0.0
    method: str = "nms_keep_max"
    iou: float = 0.2
    merge: bool = False
    strategy: str = "confidence"
    merge_iou: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class Prompts:
    mode: str = "both"  # oblique, ortho or both
    min_confidence: float = 0.5
    min_size: float = 50.0
    min_size_ortho: float = 1.0


@dataclass(frozen=True)
class Config:
    windows: Windows = field(default_factory=Windows)
    camera: Camera = field(default_factory=Camera)
    rays: Rays = field(default_factory=Rays)
    prior: Prior = field(default_factory=Prior)
    fusion: Fusion = field(default_factory=Fusion)
    prompts: Prompts = field(default_factory=Prompts)
    projection: str = "auto"
    score_threshold: float = 0.7
    crs: tuple[str, ...] = ()


#: What sites set themselves: module length and width, and the overlap at which detections of one image are one (fixed values).
SITES = {"a": {"prior": {"length": 2.22, "width": 1.09}}, "b": {"prior": {"length": 2.17, "width": 1.10}, "fusion": {"image_iou": 0.25}}, "c": {"prior": {"length": 2.20, "width": 1.09}}}


def merged(base: dict, over: dict) -> dict:
    """Nested mappings, the second winning."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str) -> dict:
    """A JSON file (or YAML where that library is present) on top of the files that its ``_base_`` names, in order."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        own = yaml.safe_load(text) or {}
    else:
        own = json.loads(text)
    base = own.pop("_base_", [])
    out: dict = {}
    for b in [base] if isinstance(base, str) else base:
        out = merged(out, load(str(Path(path).parent / b)))
    return merged(out, own)


def override(values: dict, args: list[str]) -> dict:
    """name.part=value arguments on top; values are JSON where they can be, else text."""
    for a in args:
        name, _, text = a.partition("=")
        try:
            v = json.loads(text)
        except ValueError:
            v = text
        for part in reversed(name.split(".")):
            v = {part: v}
        values = merged(values, v)
    return values


def build(values: dict, into=None):
    """The dataclass with the given values; unknown names are an error."""
    into = into if into is not None else Config()
    known = {f.name for f in fields(into)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(into, **{k: build(v, getattr(into, k)) if is_dataclass(getattr(into, k)) else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def first_crs(*names: str | None, default: str = "EPSG:4550") -> str:
    """Reference system of the output: the first that is known of image, configuration and code."""
    return next((n for n in names if n), default)
