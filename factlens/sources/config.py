"""Configuration of scans, rules, scores and boundaries."""

from __future__ import annotations

import dataclasses
import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Weights:
    """Weights of the quality signal."""

    modularity: float = 1.0
    acyclicity: float = 1.0
    depth: float = 1.0
    equality: float = 1.0
    redundancy: float = 1.0
    structural_uniformity: float = 0.0


@dataclass
class Limits:
    """Limits of the built-in rules; 0 turns a limit off where the rule says so."""

    min_quality_signal: int = 0
    min_modularity: float = 0.0
    min_acyclicity: float = 0.0
    min_depth: float = 0.0
    min_equality: float = 0.0
    min_redundancy: float = 0.0
    high_file_fan_in: int = 50
    high_file_fan_out: int = 15
    max_cycles: int = 0
    max_coupling_ratio: float = 1.0
    max_function_complexity: int = 15
    max_cognitive_complexity: int = 0
    max_file_lines: int = 0
    max_function_lines: int = 0
    no_god_files: bool = True
    large_file_lines: int = 500
    max_large_file_findings: int = 20
    low_call_resolution_min_calls: int = 100
    low_call_resolution_ratio: float = 0.5
    high_function_fan_in: int = 200
    high_function_fan_out: int = 100
    max_call_hotspot_findings: int = 5
    max_upward_layer_violations: int = 0
    no_tests_detected: bool = True
    language_overrides: dict[str, dict[str, int]] = field(default_factory=dict)


@dataclass
class Layer:
    """A named, ordered part of the tree."""

    name: str
    path: str
    order: int = 0


@dataclass
class Forbidden:
    """A module edge that must not be."""

    from_module: str
    to_module: str
    reason: str = ""


@dataclass
class Config:
    """The whole configuration."""

    weights: Weights = field(default_factory=Weights)
    limits: Limits = field(default_factory=Limits)
    module_roots: list[str] = field(default_factory=list)
    test_roots: list[str] = field(default_factory=list)
    public_api_paths: list[str] = field(default_factory=list)
    ignored_paths: list[str] = field(default_factory=list)
    generated_paths: list[str] = field(default_factory=list)
    layers: list[Layer] = field(default_factory=list)
    forbidden: list[Forbidden] = field(default_factory=list)
    plugins: list[dict] = field(default_factory=list)


def _fill(cls, values: dict):
    names = {f.name for f in dataclasses.fields(cls)}
    unknown = set(values) - names
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return cls(**values)


def load(text: str) -> Config:
    """A configuration from TOML: [score], [rules], [scan], [boundaries] and [[plugins]]."""
    raw = tomllib.loads(text)
    scan, bounds = raw.get("scan", {}), raw.get("boundaries", {})
    return Config(
        weights=_fill(Weights, {k.removesuffix("_weight"): v for k, v in raw.get("score", {}).items()}),
        limits=_fill(Limits, raw.get("rules", {})),
        **{k: list(scan.get(k, [])) for k in ("module_roots", "test_roots", "public_api_paths", "ignored_paths", "generated_paths")},
        layers=[_fill(Layer, x) for x in bounds.get("layers", [])],
        forbidden=[Forbidden(x["from"], x["to"], x.get("reason", "")) for x in bounds.get("forbidden_edges", [])],
        plugins=list(raw.get("plugins", [])),
    )


def dump(config: Config) -> str:
    """The TOML text of the limits, weights, scan paths, boundaries and plugins that `load` reads back."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else repr(v).replace("'", '"') if not isinstance(v, str) else '"' + v + '"'
    out = ["[score]"] + [f"{k}_weight = {show(v)}" for k, v in dataclasses.asdict(config.weights).items()]
    out += ["", "[rules]"] + [f"{k} = {show(v)}" for k, v in dataclasses.asdict(config.limits).items() if k != "language_overrides"]
    out += ["", "[scan]"] + [f"{k} = {show(getattr(config, k))}" for k in ("module_roots", "test_roots", "public_api_paths", "ignored_paths", "generated_paths")]
    for layer in config.layers:
        out += ["", "[[boundaries.layers]]", f'name = "{layer.name}"', f'path = "{layer.path}"', f"order = {layer.order}"]
    for f in config.forbidden:
        out += ["", "[[boundaries.forbidden_edges]]", f'from = "{f.from_module}"', f'to = "{f.to_module}"', f'reason = "{f.reason}"']
    for language, over in config.limits.language_overrides.items():
        out += ["", f"[rules.language_overrides.{language}]"] + [f"{k} = {v}" for k, v in over.items()]
    for p in config.plugins:
        out += ["", "[[plugins]]"] + [f"{k} = {json.dumps(v)}" for k, v in p.items()]
    return "\n".join(out) + "\n"


def write(config: Config, path: str) -> str:
    """Writes a configuration, and gives its path."""
    Path(path).write_text(dump(config))
    return path


#: Policy presets by name.
PRESETS: dict[str, Config] = {
    "rust-crate": Config(limits=Limits(max_function_complexity=15), module_roots=["src"], test_roots=["tests"], public_api_paths=["src/lib.rs"]),
    "monorepo": Config(limits=Limits(max_coupling_ratio=0.6), module_roots=["crates", "packages", "apps"]),
    "service-backend": Config(limits=Limits(max_function_complexity=20, max_file_lines=1000), module_roots=["src"], test_roots=["tests"]),
    "library": Config(limits=Limits(max_cycles=0, max_function_complexity=12), module_roots=["src"], public_api_paths=["src/lib.rs", "src/index.ts"]),
}
