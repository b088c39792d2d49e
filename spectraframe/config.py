"""Parameters of the image pipeline, in one frozen object that jobs take."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """D20. The defaults of the pipeline."""

    seed: int = 42
    size: tuple[int, int] = (256, 256)
    n_per_cell: int = 10
    rotation: tuple[float, float] = (-15, 15)
    elastic_alpha: float = 50
    elastic_sigma: float = 5
    noise_std: float = 0.02
    brightness: tuple[float, float] = (0.8, 1.2)
    contrast: tuple[float, float] = (0.8, 1.2)
    zoom: tuple[float, float] = (0.9, 1.1)
    control_points: int = 10
    displacement: float = 20
    warp: str = "piecewise"  # or "spline"
    diffusion_steps: int = 1000
    beta_start: float = 0.0001
    beta_end: float = 0.02
    n_clusters: int = 3
    n_init: int = 10
    min_keep: int = 21
    per_channel_noise: bool = True
    cells: tuple[str, ...] = ("CellA", "CellB", "CellC")


#: Channels in order with their names inside, file name parts, and cells' own prefixes.
ALIASES = {"BF": "phase", "Actin": "actin", "Microtubules": "mt", "Nuclei": "nuc"}
SUFFIXES = {"actin": "Actin", "mt": "Microtubules", "nuc": "Nuclei", "combo": "Combo", "phase": "BF"}
PREFIXES = {"CellB": "PhenotypeI", "CellC": "PhenotypeII"}
EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
CHANNELS = ("phase", "actin", "mt", "nuc")
#: The order in which the mode of sizes prefers channels.
SIZE_ORDER = ("actin", "mt", "nuc", "phase")
