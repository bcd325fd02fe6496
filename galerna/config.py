"""Configuration: YAML files with overlays, and settings made of them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml

from galerna.constants import GEV_MIN_SEASONS, GPD_MIN_EXCESSES, KNOT_MS, PEAKS_A_SEASON, QUANTILES
from galerna.functions.hazard import RainMatrix
from galerna.operators.quantiles import check_levels
from galerna.plans.snapshot import Settings


@dataclass(frozen=True)
class RainOptions:
    """Sums of hourly rain."""

    first_year: int = 2000
    last_year: int = 2025
    hours: int = 6
    label_is: str = "start"
    unit: str = "mm"
    overwrite: bool = False


@dataclass(frozen=True)
class PercentileOptions:
    first_year: int = 2000
    last_year: int = 2025
    levels: tuple[float, ...] = QUANTILES
    durations: tuple[int, ...] = (6, 24, 72)
    by_hour: bool = True

    def __post_init__(self) -> None:
        if any(h % 6 for h in self.durations):
            raise ValueError("durations are multiples of 6 hours")
        check_levels(self.levels)


@dataclass(frozen=True)
class ReturnOptions:
    first_year: int = 2000
    last_year: int = 2025
    durations: tuple[int, ...] = (6, 24, 72)
    min_seasons: int = GEV_MIN_SEASONS
    min_excesses: int = GPD_MIN_EXCESSES
    peaks_a_season: float = PEAKS_A_SEASON

    @property
    def k(self) -> int:
        """Peaks of a cell that the distribution is fitted to."""
        return round(self.peaks_a_season * (self.last_year - self.first_year + 1))


@dataclass(frozen=True)
class CaseOptions:
    """A case study: storm, experiments by tag, and the hours of rain read before its first position."""

    storm_id: str
    experiments: dict[str, dict] = field(default_factory=lambda: {"floor": {}})
    lead_in_hours: int = 84

    def settings(self, base: dict | None = None) -> dict[str, Settings]:
        return {tag: settings(merged(base or {}, overlay)) for tag, overlay in self.experiments.items()}


def options_of(kind: type, section: dict):
    """A set of options from a section; lists become tuples, and an unknown key is an error."""
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(section) - known):
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in section.items()})


def default() -> dict:
    """The configuration whose settings are the defaults."""
    s = Settings()
    return {
        "rain": {"nodes": list(s.matrix.nodes), "base": list(s.matrix.base), "escalated": list(s.matrix.escalated), "missing": s.rain_missing},
        "radii": {"mode": s.mode, "r34_unit": s.r34_unit, "cloud_unit": s.cloud_unit}, "wind": {"tail_end_kt": s.tail_end_kt},
        "weights": {k: getattr(s, k) for k in ("alpha", "beta", "lam", "mu")},
    }


def load(path: str) -> dict:
    """A missing, empty or other than mapping file is an error."""
    text = Path(path).read_text(encoding="utf-8")
    found = yaml.safe_load(text)
    if not isinstance(found, dict) or not found:
        raise ValueError(f"{path} holds no configuration")
    return found


def merged(base: dict, overlay: dict) -> dict:
    """Mappings are merged level by level; anything else is replaced."""
    out = dict(base)
    for k, v in overlay.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def settings(config: dict | None = None) -> Settings:
    """Of the sections rain, radii, wind and weights; what they lack keeps its default."""
    config = config or {}
    rain, radii, wind, weights = (config.get(k) or {} for k in ("rain", "radii", "wind", "weights"))
    if "tail_end_kt" in wind and "tail_end_ms" in wind:
        raise ValueError("the tail's end is given twice")
    plain = Settings()
    matrix = RainMatrix(**{k: tuple(v) if isinstance(v, list) else v for k, v in rain.items() if k in ("nodes", "base", "escalated", "combine")})
    tail = wind["tail_end_ms"] / KNOT_MS if "tail_end_ms" in wind else wind.get("tail_end_kt", plain.tail_end_kt)
    return Settings(
        matrix=matrix, mode=radii.get("mode", plain.mode), r34_unit=radii.get("r34_unit", plain.r34_unit), cloud_unit=radii.get("cloud_unit", plain.cloud_unit),
        direct_fallback_km=radii.get("direct_fallback_km"), tail_end_kt=tail, rain_missing=rain.get("missing", plain.rain_missing),
        **{k: weights.get(k, getattr(plain, k)) for k in ("alpha", "beta", "lam", "mu")},
    )
