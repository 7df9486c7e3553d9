"""Settings of the stages, as frozen dataclasses; expressions take them as literals."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any


# The numbers below are those of the published scoring method and must equal them.


@dataclass(frozen=True)
class DensityScore:
    zeta: float = 1.2
    use_truncation: bool = True


@dataclass(frozen=True)
class Weighting:
    """Three parabolas in d / r: slope, centre and offset of each, and where one ends."""

    first: tuple[float, float, float] = (-1.0, 0.0, 1.0)
    second: tuple[float, float, float] = (5.1177, 1.29366, -0.4)
    third: tuple[float, float, float] = (-0.9507, 2.0, 0.0)
    end_first: float = 1.0822
    end_second: float = 1.4043


@dataclass(frozen=True)
class WaterScoring:
    sigma_threshold: float = 1.0
    classification_threshold: float = 0.24
    covalent_radius: float = 0.66
    vdw_radius: float = 1.52


@dataclass(frozen=True)
class Aggregation:
    shift: float = 0.1
    exponent: float = -2.0
    opia_threshold: float = 0.8
    clash_threshold: float = 0.1
    unaccounted_density_threshold: float = 0.2
    missing_density_threshold: float = 0.8


@dataclass(frozen=True)
class MapNormalization:
    normalize: bool = False
    mean: float | None = None
    sigma: float | None = None


@dataclass(frozen=True)
class Scoring:
    density: DensityScore = field(default_factory=DensityScore)
    weighting: Weighting = field(default_factory=Weighting)
    water: WaterScoring = field(default_factory=WaterScoring)
    aggregation: Aggregation = field(default_factory=Aggregation)
    normalization: MapNormalization = field(default_factory=MapNormalization)
    max_spacing: float = 0.7
    bond_tolerance: float = 0.4
    neighbour_buffer: float = 3.0


def default_config() -> Scoring:
    return Scoring()


def snr_map_config(zeta: float = 5.0) -> Scoring:
    """Signal-to-noise maps are not normalised, and high values are not clipped early."""
    return Scoring(density=DensityScore(zeta=zeta))


@dataclass(frozen=True)
class Debias:
    structure_path: str | None = None
    reflections_path: str | None = None
    screening_path: str | None = None
    screening_outcomes: str | None = None
    max_structures: int | None = None
    omit_type: str = "atoms"
    omit_fraction: float = 0.1
    iterations: int = 5
    always_omit: str | None = None
    seed: int | None = None
    mtz_f_labels: str | None = None
    mtz_rfree_label: str | None = None
    simulated_annealing: bool = False


@dataclass(frozen=True)
class Slurm:
    job_name: str = "densika"
    partition: str | None = None
    num_nodes: int = 1
    cpus_per_task: int = 1
    mem_per_cpu: str = "5G"
    time_limit: str = "3-00:00:00"
    chunk_size: int = 1000


@dataclass(frozen=True)
class Run:
    output_dir: str = "."
    force: bool = False
    debias: Debias = field(default_factory=Debias)
    slurm: Slurm = field(default_factory=Slurm)


def read_settings(path: str | Path) -> dict[str, Any]:
    """Nested settings of a file: JSON, or by its extension YAML, of which blocks, plain values and comments are read."""
    text = Path(path).read_text(encoding="utf-8")
    return yaml_blocks(text) if Path(path).suffix in (".yaml", ".yml") else json.loads(text)


def yaml_blocks(text: str) -> dict[str, Any]:
    """Nested ``name: value`` blocks by indentation; lists, anchors and texts of several lines are refused."""
    words = {"null": None, "~": None, "": None, "none": None, "true": True, "false": False}

    def value(raw: str) -> Any:
        if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"":
            return raw[1:-1]
        if raw.lower() in words:
            return words[raw.lower()]
        for kind in (int, float):
            try:
                return kind(raw)
            except ValueError:
                continue
        return raw

    root: dict[str, Any] = {}
    blocks = [(-1, root)]
    for number, line in enumerate(text.splitlines(), 1):
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not body.strip() or body.strip() == "---":
            continue
        found = re.fullmatch(r"(\s*)([\w.-]+):(?:\s+([^&*|>\[{-].*|-[\d.].*))?", body)
        if found is None:
            raise ValueError(f"line {number} of the settings is neither a block nor a value: {line.strip()}")
        depth, name = len(found[1]), found[2]
        while blocks[-1][0] >= depth:
            blocks.pop()
        if found[3] is None:
            blocks[-1][1][name] = child = {}
            blocks.append((depth, child))
        else:
            blocks[-1][1][name] = value(found[3].strip())
    return root


def layered(base: Any, *layers: dict[str, Any]) -> Any:
    """``base`` with nested dictionaries laid over it, the last on top; unknown names are refused."""
    for layer in layers:
        known = {f.name for f in fields(base)}
        if unknown := set(layer) - known:
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        new = {}
        for name, value in layer.items():
            old = getattr(base, name)
            if isinstance(value, dict) and not is_dataclass(old):
                value = value or None  # a name without anything under it
            new[name] = layered(old, value) if is_dataclass(old) and isinstance(value, dict) else value
        base = replace(base, **new)
    return base


def validated(run: Run) -> Run:
    """Either a screening table or both a structure and reflections must be given, and be paths."""
    d = run.debias
    if not d.screening_path and not (d.structure_path and d.reflections_path):
        raise ValueError("give a screening path, or a structure path and a reflections path")
    if not 0.0 < d.omit_fraction < 1.0:
        raise ValueError("omit fraction must be > 0.0 and < 1.0")
    if d.iterations is not None and d.iterations < 1:
        raise ValueError("iterations must be >= 1")
    if d.omit_type not in ("atoms", "amino_acids"):
        raise ValueError("omit type must be 'atoms' or 'amino_acids'")
    return run
