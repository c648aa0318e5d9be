"""States, table schemas and rule cutoffs."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum, StrEnum

POINTS = "sample_id string, CpG_chrm string, CpG_beg long, CpG_end long, beta double, input_row_index long"
REGIONS = "sample_id string, CpG_chrm string, start long, end long, avg_beta double, probe_count long, state string"
SUMMARY = "chrom string, available boolean, selected_for_training boolean, n_cpg_total long, n_cpg_sampled long, sampled boolean, sampling_fraction double"
POINT_KEYS = ["sample_id", "CpG_chrm"]


class State(IntEnum):
    """Biological states; numeric codes are part of the data format."""

    LOW = 0
    PMD = 1
    INTERMEDIATE = 2
    HIGH = 3


STATES = [s.name for s in State]
#: Display colours of the states.
COLOURS = {"LOW": "#440154", "PMD": "#31688E", "INTERMEDIATE": "#35B779", "HIGH": "#FDE725"}
AUTOSOMES = [f"chr{i}" for i in range(1, 23)]


class _Words(StrEnum):
    @classmethod
    def _missing_(cls, value):
        return next((m for m in cls if str(value).strip().lower() == m.value), None)


class Assignment(_Words):
    DEFINITION = "definition"
    KMEANS = "kmeans"
    AUTO = "auto"


class Smoother(_Words):
    CONTINUOUS = "continuous-time"
    STICKY = "sticky"


class Resolution(_Words):
    WGBS = "wgbs"
    K450 = "450k"
    K27 = "27k"
    K850 = "850k"
    AUTO = "auto"


#: Default windows by resolution, size in base pairs and label.
WINDOWS = {
    Resolution.WGBS: [(500, "500bp"), (40_000, "40kb"), (450_000, "450kb")],
    Resolution.K450: [(40_000, "40kb"), (450_000, "450kb")],
}


def default_windows(resolution: str) -> list[tuple[int, str]]:
    found = WINDOWS.get(Resolution(resolution))
    if found is None:
        raise ValueError(f"no default windows for resolution {resolution!r}; give them")
    return list(found)


def by_size(windows: list[tuple[int, str]]) -> list[str]:
    """Window labels from the smallest window to the largest."""
    return [label for _, label in sorted(windows, key=lambda w: w[0])]


@dataclass(frozen=True)
class WindowCutoffs:
    int_min: float = 0.56
    std_max: float = 0.264
    high_max: float = 0.246
    low_max: float | None = 0.246

    @property
    def low(self) -> float:
        return self.high_max if self.low_max is None else self.low_max


@dataclass(frozen=True)
class StateCutoffs:
    """Rule cutoffs: one set per window label, and the beta bounds of LOW and HIGH."""

    windows: dict[str, WindowCutoffs] = field(default_factory=dict)
    beta_low_max: float = 0.290
    beta_high_min: float = 0.694

    @classmethod
    def default(cls, labels: list[str]) -> StateCutoffs:
        return cls({w: WindowCutoffs() for w in labels})

    @classmethod
    def from_mapping(cls, values: dict) -> StateCutoffs:
        """From the nested form, {state_cutoffs: {...}}, or the flat one; a missing low_max falls back to high_max."""
        values = values.get("state_cutoffs", values)
        missing = {"beta_low_max", "beta_high_min", "pmd_cutoffs"} - set(values)
        if missing:
            raise ValueError(f"state cutoffs lack {sorted(missing)}")
        windows = {}
        for label, cell in values["pmd_cutoffs"].items():
            if absent := {"int_min", "std_max", "high_max"} - set(cell):
                raise ValueError(f"cutoffs of window {label} lack {sorted(absent)}")
            windows[str(label)] = WindowCutoffs(*(float(cell[k]) for k in ("int_min", "std_max", "high_max")), float(cell.get("low_max", cell["high_max"])))
        return cls(windows, float(values["beta_low_max"]), float(values["beta_high_min"]))

    def to_mapping(self) -> dict:
        return {
            "beta_low_max": self.beta_low_max,
            "beta_high_min": self.beta_high_min,
            "pmd_cutoffs": {w: {"int_min": c.int_min, "std_max": c.std_max, "high_max": c.high_max, "low_max": c.low} for w, c in self.windows.items()},
        }

    def describe(self) -> str:
        """The rules as text."""
        pmd = " or ".join(f"({w}: int >= {c.int_min:g}, std <= {c.std_max:g}, high <= {c.high_max:g}, low <= {c.low:g})" for w, c in self.windows.items())
        return f"PMD: {pmd}, and {self.beta_low_max:g} <= beta <= {self.beta_high_min:g}\nLOW: beta <= {self.beta_low_max:g} and not PMD\nHIGH: beta >= {self.beta_high_min:g} and not PMD\nINTERMEDIATE: all others"
