"""Job parameters with range checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

# Fixed values of the reference workload.
DEFAULT_PLOT = ((207, 156), (1014, 156), (207, 677), (1014, 677))
ALTERNATIVE_AREA = ((308, 247), (923, 247), (308, 612), (923, 612))
CENTRE_CELL = ((0, 0, 0), (0, 1, 0), (0, 0, 0))

Point = tuple[int, int]


def check_bounds(bounds) -> None:
    """A plot is given by four points: top left, top right, bottom left, bottom right."""
    if len(bounds) != 4 or any(len(p) != 2 for p in bounds):
        raise ValueError("bounds must be four (x, y) points")


def check_regions(regions) -> None:
    if not regions or any(len(row) != len(regions[0]) or not row for row in regions):
        raise ValueError("region matrix must be two-dimensional")


@dataclass(frozen=True)
class FrameParams:
    """Geometry, colour thresholds and smoothing of a frame job."""

    height: int = 720
    width: int = 1280
    plot: tuple[Point, ...] = DEFAULT_PLOT
    regions: tuple[tuple[int, ...], ...] = CENTRE_CELL
    lower: int = 155
    upper: int = 255
    highlight: str = "linear"
    highlight_distance: int = 8
    highlight_out: float = 0.99
    min_peak: float = 0.0
    bad_share: float = 0.2
    best_share: float = 0.10
    present_threshold: float = 0.0001
    check_present: bool = False
    time_zone: str = "America/Regina"

    def __post_init__(self) -> None:
        check_bounds(self.plot)
        check_regions(self.regions)
        if self.height <= 0 or self.width <= 0:
            raise ValueError("frame size must be positive")
        if not 0 <= self.lower <= self.upper <= 255:
            raise ValueError("need 0 <= lower <= upper <= 255")
        if self.highlight not in ("linear", "logistic"):
            raise ValueError("highlight is 'linear' or 'logistic'")
        if self.highlight_distance <= 0:
            raise ValueError("highlight distance must be positive")
        if not 0 < self.highlight_out < 1:
            raise ValueError("highlight_out must lie between 0 and 1")
        if not 0 < self.best_share <= 1 or not 0 < self.bad_share <= 1:
            raise ValueError("shares must lie in (0, 1]")

    def stamp(self) -> str:
        """Canonical text of all parameters, used to key cached tables."""
        return json.dumps(asdict(self), sort_keys=True)


@dataclass(frozen=True)
class WinnowParams:
    """Thresholds of the feature-selection loop."""

    min_count: float = 3
    keep_thresh: float = 0.5
    num_to_pull: int = 1
    num_required: int = 50
    correlation: str = "spearman"
    centrality: str = "betweenness"

    def __post_init__(self) -> None:
        if self.num_to_pull <= 0 or self.num_required <= 0:
            raise ValueError("num_to_pull and num_required must be positive")
        if not 0 <= self.keep_thresh <= 1:
            raise ValueError("keep_thresh must lie in [0, 1]")
        if self.correlation not in ("spearman", "pearson"):
            raise ValueError("correlation is 'spearman' or 'pearson'")
        if self.centrality not in ("betweenness", "closeness", "degree", "eigenvector"):
            raise ValueError(f"unknown centrality {self.centrality!r}")
