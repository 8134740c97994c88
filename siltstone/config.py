"""Configuration of a run: nested mappings from a file, places in them, overrides, and what is shown of them later."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping
from typing import Any

from .operators.generate import HttpGenerator, Reasoning, RetryPolicy, laid_over
from .operators.select import UnitPlan

#: Names under which a client's key is kept, and what stands for nothing secret.
SECRETS = ("api_key",)
NO_SECRET = (None, "", "EMPTY")


def load(path: str) -> dict[str, Any]:
    """A mapping from a JSON or YAML file (YAML needs PyYAML)."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        out = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError(f"{path} needs PyYAML; a JSON file does not") from error
        out = yaml.safe_load(text)
    if not isinstance(out or {}, dict):
        raise ValueError(f"{path} must hold a mapping")
    return out or {}


def get(config: Mapping[str, Any], at: str, default: Any = None) -> Any:
    """The value at a dotted place; the default where a part of it is missing."""
    here: Any = config
    for name in at.split("."):
        if not isinstance(here, Mapping) or name not in here:
            return default
        here = here[name]
    return here


def with_value(config: Mapping[str, Any], at: str, value: Any) -> dict[str, Any]:
    """A copy with a value at a dotted place; what stands in the way of a nested place is replaced."""
    first, _, rest = at.partition(".")
    inner = config.get(first)
    return dict(config) | {first: with_value(inner if isinstance(inner, Mapping) else {}, rest, value) if rest else value}


def overridden(config: Mapping[str, Any], values: Mapping[str, Any]) -> dict[str, Any]:
    """A copy with the values (by dotted place) that are given, None meaning not given."""
    out = copy.deepcopy(dict(config))
    for at, value in values.items():
        if value is not None:
            out = with_value(out, at, value)
    return out


def expanded(value: Any, folder: str, environment: bool = False) -> Any:
    """``${cwd}`` in all texts stands for the folder; environment variables are filled in on request."""
    if isinstance(value, str):
        text = value.replace("${cwd}", folder)
        return os.path.expandvars(text) if environment else text
    if isinstance(value, Mapping):
        return {k: expanded(v, folder, environment) for k, v in value.items()}
    return [expanded(v, folder, environment) for v in value] if isinstance(value, list) else value


def redacted(config: Mapping[str, Any]) -> dict[str, Any]:
    """A copy that can be written beside the results: no keys of clients."""
    return {k: redacted(v) if isinstance(v, Mapping) else "<redacted>" if k in SECRETS and v not in NO_SECRET else v for k, v in config.items()}


def unit_plan(config: Mapping[str, Any]) -> UnitPlan:
    """The plan of units that ``sampling`` and ``similarity`` ask for; what they leave out keeps its default."""
    places = {
        "members": "sampling.audio_count", "count": "sampling.unit_count", "strategy": "sampling.grouping_strategy", "seed": "sampling.random_seed", "subset": "sampling.subset_size", "reuse": "sampling.max_audio_reuse",
        "most": "sampling.max_enumerated_units", "similar_from": "similarity.similarity_min", "similar_to": "similarity.similarity_max", "dissimilar_to": "similarity.dissimilarity_max",
    }
    return UnitPlan(**{name: value for name, at in places.items() if (value := get(config, at)) is not None})


def reasoning(config: Mapping[str, Any]) -> Reasoning:
    places = {
        "enabled": "enabled", "mode": "mode", "effort": "effort", "instruction": "instruction", "token_budget": "thinking_token_budget",
        "include": "include_reasoning", "preserve": "preserve_thinking", "strip": "strip_visible_reasoning", "reject": "reject_visible_reasoning",
    }
    given = {name: value for name, key in places.items() if (value := get(config, f"generation.reasoning.{key}")) is not None}
    return Reasoning(**{k: v.strip().lower() if k in ("effort", "mode") else v for k, v in given.items()})


def http_generator(config: Mapping[str, Any], stage: str = "default", **call: Any) -> HttpGenerator:
    """The chat server of ``client`` with a stage's sampling; arguments of the call come before the configuration."""
    asked = laid_over(get(config, "generation.default", {}), get(config, f"generation.{stage}", {}))
    base = get(config, "client.base_url")
    found = {
        "url": base and f"{base.rstrip('/')}/chat/completions", "model": get(config, "client.model"), "timeout": get(config, "client.timeout_s"), "key": get(config, "client.api_key"), "extra": get(config, "client.extra_body"),
        "max_tokens": asked.get("max_tokens"), "temperature": asked.get("temperature"), "top_p": asked.get("top_p"),
    }
    places = {"attempts": "max_attempts", "initial": "initial_delay_s", "most": "max_delay_s", "factor": "backoff_multiplier", "jitter": "jitter_s"}
    found["retry"] = RetryPolicy(**{name: value for name, key in places.items() if (value := get(config, f"retry.{key}")) is not None})
    found["reasoning"] = reasoning(config) if get(config, "generation.reasoning") else None
    return HttpGenerator(**{k: v for k, v in found.items() if v is not None} | call)
