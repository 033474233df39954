"""Typed settings: defaults, then a YAML file, then dotted overrides."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, get_args, get_origin, get_type_hints


@dataclass(frozen=True)
class Data:
    dataset_dir: str = ""
    lods: list[int] = field(default_factory=lambda: [1, 2])
    normalize_coords: bool = True
    n_max: int | None = None


@dataclass(frozen=True)
class Model:
    num_node_classes: int = 2
    hidden_dim: int = 64
    num_layers: int = 4
    T: int = 500
    discrete_noise_type: str = "uniform"


@dataclass(frozen=True)
class EarlyStopping:
    enabled: bool = True
    monitor: str = "val_coord_mse"
    patience: int = 10
    mode: str = "min"


@dataclass(frozen=True)
class Checkpoint:
    enabled: bool = True
    monitor: str = "val_coord_mse"
    mode: str = "min"
    save_top_k: int = 3
    filename: str = "{epoch:02d}-{val_coord_mse:.4f}"


@dataclass(frozen=True)
class Training:
    batch_size: int = 32
    train_val_test_split: list[float] = field(default_factory=lambda: [0.8, 0.1, 0.1])
    lr: float = 1e-3
    max_epochs: int = 100
    lr_scheduler: str = "none"
    lr_decay_steps: int = 50
    lr_decay_rate: float = 0.5
    early_stopping: EarlyStopping = field(default_factory=EarlyStopping)
    checkpoint: Checkpoint = field(default_factory=Checkpoint)


@dataclass(frozen=True)
class Logging:
    """Where ``sources.metrics`` writes."""

    loggers: list[str] = field(default_factory=lambda: ["tensorboard"])
    project_name: str = "buildings"
    experiment_name: str | None = None
    run_name: str | None = "default"
    save_dir: str = "outputs"


@dataclass(frozen=True)
class Inference:
    checkpoint_path: str | None = None
    batch_size: int = 10
    edge_threshold: float = 0.5
    output_dir: str = "outputs/generated"


@dataclass(frozen=True)
class Config:
    mode: str = "train"
    seed: int = 42
    data: Data = field(default_factory=Data)
    model: Model = field(default_factory=Model)
    training: Training = field(default_factory=Training)
    logging: Logging = field(default_factory=Logging)
    inference: Inference = field(default_factory=Inference)


#: Settings of frameworks for training and logging, which this engine does not have: accepted and not used.
UNUSED = {"": {"trainer", "resume_from"}, "data": {"num_workers"}, "training": {"gradient_clip_val"}, "logging": {"wandb_entity", "wandb_offline", "log_model"}}


def _typed(value: Any, kind: Any, where: str) -> Any:
    """``value`` as ``kind``; a wrong type is an error that names its place."""
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise TypeError(f"{where}: a section is expected")
        return _section(kind, value, where)
    options = get_args(kind)
    if get_origin(kind) is list:
        if not isinstance(value, list):
            raise TypeError(f"{where}: a list is expected")
        return [_typed(v, options[0], f"{where}[{i}]") for i, v in enumerate(value)]
    if type(None) in options:
        return None if value is None else _typed(value, next(o for o in options if o is not type(None)), where)
    if kind is bool:
        if isinstance(value, bool):
            return value
        raise TypeError(f"{where}: true or false is expected, not {value!r}")
    if kind is str:
        return str(value)
    if isinstance(value, bool) or kind is int and isinstance(value, float) and value != int(value):
        raise TypeError(f"{where}: {kind.__name__} is expected, not {value!r}")
    try:
        return kind(value)
    except (TypeError, ValueError) as e:
        raise TypeError(f"{where}: {kind.__name__} is expected, not {value!r}") from e


def _section(kind: type, values: dict, where: str = "") -> Any:
    hints = get_type_hints(kind)
    values = {k: v for k, v in values.items() if k not in UNUSED.get(where, ())}
    if unknown := set(values) - set(hints):
        raise KeyError(f"{where or 'config'}: no such setting: {', '.join(sorted(unknown))}")
    return kind(**{k: _typed(v, hints[k], f"{where}.{k}".lstrip(".")) for k, v in values.items()})


def _merge(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | Path, overrides: list[str] | None = None) -> Config:
    """The settings of a YAML file with overrides such as ``training.max_epochs=50``."""
    import yaml

    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"config file not found: {file}")
    values = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
    for text in overrides or []:
        key, _, raw = text.partition("=")
        value: Any = yaml.safe_load(raw) if raw else None
        for part in reversed(key.split(".")):
            value = {part: value}
        values = _merge(values, value)
    return _section(Config, values)
