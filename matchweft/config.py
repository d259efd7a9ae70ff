"""Pipeline settings with the defaults of the configuration skeleton; switches decide which plans are built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Project:
    data_root: str = "data"
    models_root: str = "models"
    game_data_root: str = "game_data"


@dataclass(frozen=True)
class Capture:
    enabled: bool = False
    target_fps: float = 4
    save_periodic_keyframes: bool = True
    keyframe_interval_seconds: float = 10
    save_on_scene_change: bool = True
    save_low_confidence_evidence: bool = True


@dataclass(frozen=True)
class Perception:
    min_confidence: float = 0.70
    unknown_below_confidence: bool = True


@dataclass(frozen=True)
class Tracking:
    min_event_confidence: float = 0.80
    temporal_confirmation_frames: int = 2


@dataclass(frozen=True)
class Storage:
    observations_format: str = "jsonl"
    events_format: str = "jsonl"
    states_format: str = "parquet"
    decisions_format: str = "parquet"


@dataclass(frozen=True)
class Switch:
    enabled: bool = False
    policy_gate: bool = True


@dataclass(frozen=True)
class Config:
    schema_version: int = 1
    project: Project = field(default_factory=Project)
    capture: Capture = field(default_factory=Capture)
    perception: Perception = field(default_factory=Perception)
    tracking: Tracking = field(default_factory=Tracking)
    storage: Storage = field(default_factory=Storage)
    analysis: Switch = field(default_factory=lambda: Switch(enabled=True))
    realtime: Switch = field(default_factory=Switch)
    ml: Switch = field(default_factory=Switch)
    rl: Switch = field(default_factory=Switch)


def _build(base, given: Mapping, at: str):
    known = {f.name for f in fields(base)}
    if extra := set(given) - known:
        raise ValueError(f"unknown settings in {at or 'the root'}: {', '.join(sorted(map(str, extra)))}")
    values = {}
    for name in known & set(given):
        now = getattr(base, name)
        values[name] = _build(now, given[name] or {}, f"{at}.{name}".lstrip(".")) if is_dataclass(now) else given[name]
    return type(base)(**{f.name: values.get(f.name, getattr(base, f.name)) for f in fields(base)})


def load_config(settings: Mapping | str | None = None) -> Config:
    """Defaults overridden by a mapping or by a YAML file; unknown keys and other schema versions are refused."""
    if isinstance(settings, str):
        import yaml

        with open(settings, encoding="utf-8") as f:
            settings = yaml.safe_load(f)
    config = _build(Config(), settings or {}, "")
    if config.schema_version != 1:
        raise ValueError(f"settings have schema version {config.schema_version}; 1 is known")
    return config
