"""Settings that queries depend on, and the layout of a project's folders."""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: band names in their order, indices, periods
BANDS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12")
INDICES = ("NDVI", "NDWI", "MNDWI", "NDBI", "BSI")
PERIODS = ("2022-01-01_2023-01-01", "2023-01-01_2024-01-01")
# fixed values: land-cover codes and the classes that they stand for; classes' names
CODE_TO_CLASS = {10: 1, 20: 2, 30: 3, 40: 4, 50: 5, 60: 6, 70: 0, 80: 7, 90: 8, 95: 8, 100: 2}
CLASS_NAMES = {0: "nodata", 1: "tree_cover", 2: "shrubland", 3: "grassland", 4: "cropland", 5: "built_up", 6: "bare", 7: "water", 8: "wetland"}
EARTH_RADIUS_M = 6371007.1809


@dataclass(frozen=True)
class Config:
    """One project: where it lies, its area, period and grid level, and what decides samples and splits."""

    root: str
    aoi: str = "london"
    period: str = PERIODS[0]
    level: int = 18
    seed: int = 42
    block_deg: float = 0.05
    test_permille: int = 250
    samples_per_class: int = 5000
    max_train_rows: int = 50_000
    cv_epsilon: float = 1e-6
    exclude_classes: tuple[int, ...] = ()

    def path(self, *parts: str) -> str:
        return "/".join((self.root.rstrip("/"), self.aoi, *parts))

    def cells(self, level: int | None = None) -> str:
        return self.path("cells", f"level={level or self.level}")

    def pixels(self) -> str:
        return self.path("pixels")

    def labels(self) -> str:
        return self.path("labels")

    def predictions(self) -> str:
        return self.path("predictions")

    def models(self) -> str:
        return self.path("models")

    def results(self) -> str:
        return self.path("results")

    def manifests(self) -> str:
        return self.path("manifests")


def band_index(band: str) -> int:
    """A band's number in the stack, from 1."""
    return BANDS.index(band) + 1
