"""Contract and model settings from YAML or JSON files."""

from __future__ import annotations

import json
from pathlib import Path

# The model settings used when no file is given.
MODEL_DEFAULTS: dict[str, dict] = {
    "UC1": {
        "target": "cuaca",
        "model_name": "random_forest",
        "hyperparameters": {"n_estimators": 200, "max_depth": 12, "class_weight": "balanced", "min_samples_leaf": 2},
        "cv": {"n_splits": 5},
        "quality_gate": {"margin_over_baseline": 0.10},
    },
    "UC2": {
        "target": "t2m",
        "model_name": "gradient_boosting",
        "hyperparameters": {"n_estimators": 300, "max_depth": 3, "learning_rate": 0.05},
        "cv": {"n_splits": 5},
        "quality_gate": {"threshold": 0.0},
    },
    "UC3": {"model_name": "isolation_forest", "contamination": 0.05},
    "UC4": {
        "target": "t2m_celsius",
        "model_name": "random_forest",
        "hyperparameters": {"n_estimators": 300, "max_depth": 10, "min_samples_leaf": 3},
        "cv": {"n_splits": 5},
        "quality_gate": {"threshold": 0.0},
    },
    "UC5": {
        "target": "avg_kejadian_per_tahun",
        "model_name": "gradient_boosting",
        "hyperparameters": {"n_estimators": 200, "max_depth": 3, "learning_rate": 0.05},
    },
}


def load_config(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading YAML settings needs the yaml package; use a .json file") from exc
    return yaml.safe_load(text)


def load_contract(path: str) -> dict:
    """The ``contract`` section of a settings file."""
    return load_config(path)["contract"]


def model_config(use_case: str, path: str | None = None) -> dict:
    defaults = MODEL_DEFAULTS.get(use_case.upper(), {})
    return {**defaults, **(load_config(path) if path else {})}
