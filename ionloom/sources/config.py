"""Run configuration."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field, fields


@dataclass
class Config:
    """Parameters of a run, checked when made."""

    offset: int = 1
    interval: int = 6
    sn_ratio: float = 3.0
    min_hit_rate: float = 0.1
    ppm_threshold: int = 10
    intensity_threshold: float = 200.0
    cell_marker: dict[str, float | None] = field(default_factory=lambda: {"TIC": None})
    main_cell_marker: str = ""
    save_file_type: str = "csv"
    metab_anno: str = ""
    cell_type_marker_library: str = ""
    cell_type_color: str = ""
    input_path: str = ""

    def __post_init__(self):
        for name in ("offset", "interval", "ppm_threshold"):
            v = getattr(self, name)
            if not isinstance(v, int) or isinstance(v, bool) or v <= 0:
                raise ValueError(f"{name} must be a whole number above 0")
        for name in ("sn_ratio", "min_hit_rate", "intensity_threshold"):
            v = getattr(self, name)
            if not isinstance(v, (int, float)) or isinstance(v, bool) or v <= 0:
                raise ValueError(f"{name} must be a number above 0")
        if self.save_file_type not in ("csv", "parquet", "tsv", "xlsx"):
            raise ValueError("save_file_type must be csv, tsv, xlsx or parquet")
        if not self.cell_marker:
            raise ValueError("cell_marker is empty")
        self.main_cell_marker = main_marker(self.cell_marker, self.main_cell_marker)


def main_marker(markers: dict, main: str = "") -> str:
    """The main marker: the only one, the stated one, or the total ion current where that is among several."""
    if not markers:
        return "TIC"
    if main:
        if main not in markers:
            raise ValueError(f"{main} isn't among the markers")
        return main
    if len(markers) == 1:
        return next(iter(markers))
    if "TIC" in markers:
        return "TIC"
    raise ValueError("several markers and none is the main one")


def load(path: str) -> Config:
    """A JSON file, flat or with one level of sections; unknown keys are logged and left out."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    known = {f.name for f in fields(Config)}
    flat = {}
    for key, value in raw.items():
        flat.update(value if isinstance(value, dict) and key not in known else {key: value})
    if "ppm_tolerance" in flat:
        flat["ppm_threshold"] = flat.pop("ppm_tolerance")
    for key in flat.keys() - known:
        logging.getLogger(__name__).warning("unknown setting %s", key)
    return Config(**{k: v for k, v in flat.items() if k in known})


def prefer_text(paths: list[str]) -> list[str]:
    """Without the .mzML files that have a .txt file of the same name."""
    texts = {p[: -len(".txt")] for p in paths if p.endswith(".txt")}
    return [p for p in paths if not (p.lower().endswith(".mzml") and p[: -len(".mzml")] in texts)]
