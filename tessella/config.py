"""Configuration as frozen dataclasses; JSON in and out with defaults for what is missing."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path

from .operators.edges import EdgeConfig

METHODS = ("palette", "dither", "weighted", "nearest", "bilinear")


@dataclass(frozen=True)
class TransformConfig:
    output_size: int = 32
    scale: float = 1.0
    rotation: float = 0.0
    offset_x: float = 0.0
    offset_y: float = 0.0
    flip_horizontal: bool = False
    flip_vertical: bool = False
    export_scale: int = 1
    method: str = "palette"


@dataclass(frozen=True)
class ShadingConfig:
    strength: float = 0.6
    gamma: float = 0.8
    mad_threshold: float = 0.02
    l_shift_scale: float = 40.0
    global_depth_weight: float = 0.6
    bg_cluster_size_pct: float = 0.15
    use_otsu: bool = True
    bg_depth_threshold: float = 0.6
    bg_desaturation: float = 0.65
    bg_lightness_shift: float = -0.08


@dataclass(frozen=True)
class PaletteConfig:
    mode: str = "auto"  # auto, preset, custom, hybrid (as auto)
    max_colors: int = 32
    preset: str = "none"
    custom: tuple = ()


@dataclass(frozen=True)
class Preset:
    name: str = "Default"
    transform: TransformConfig = field(default_factory=TransformConfig)
    shading: ShadingConfig = field(default_factory=ShadingConfig)
    edges: EdgeConfig = field(default_factory=EdgeConfig)
    palette: PaletteConfig = field(default_factory=PaletteConfig)


def _from(kind: type, data: dict):
    """An instance from a dict: unknown keys are ignored, missing ones have their defaults."""
    parts = {"transform": TransformConfig, "shading": ShadingConfig, "edges": EdgeConfig, "palette": PaletteConfig}
    known = {f.name for f in dataclasses.fields(kind)}
    return kind(**{k: _from(parts[k], v) if k in parts and isinstance(v, dict) else tuple(map(tuple, v)) if k == "custom" else v for k, v in data.items() if k in known})


def to_json(preset: Preset) -> str:
    """SNK06."""
    return json.dumps(dataclasses.asdict(preset), indent=2)


def from_json(text: str) -> Preset:
    """SRC04."""
    return _from(Preset, json.loads(text))


def load_or_create(path: str) -> Preset:
    """SRC05: the file's settings, or the defaults, which are then written there."""
    p = Path(path)
    if p.exists():
        return from_json(p.read_text())
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(to_json(Preset()))
    return Preset()


#: SRC10: the built-in presets, and the menu's.
PRESETS = (
    Preset("Portrait - Minimal", TransformConfig(method="weighted"), palette=PaletteConfig(max_colors=12)),
    Preset("Portrait - Detailed", TransformConfig(output_size=64, method="weighted"), edges=EdgeConfig(mode="both", darkener=0.4)),
    Preset("Game Boy Style", TransformConfig(output_size=48, export_scale=2, method="nearest"), edges=EdgeConfig(darkener=0.2, style="black"), palette=PaletteConfig("preset", 4, "gameboy")),
)
MENU = {
    "minimal": {"output_size": 32, "aspect": "square", "mode": "auto", "max_colors": 12},
    "detailed": {"output_size": 64, "aspect": "square", "mode": "auto", "max_colors": 32},
    "hd": {"output_size": 128, "aspect": "preserve", "mode": "auto", "max_colors": 64},
    "gameboy": {"output_size": 48, "aspect": "square", "mode": "preset", "max_colors": 4, "preset": "gameboy", "export_scale": 2},
}
