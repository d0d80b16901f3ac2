"""Settings of the document pipeline; every default can be overridden in the session under ``pagewright.<name>``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    # The defaults that existing requests rely on.
    max_file_mb: int = 20
    allowed_types: tuple[str, ...] = ("image/jpeg", "image/png", "image/webp", "image/tiff", "application/pdf")
    min_box_area: int = 150
    min_box_height: int = 8
    fallback_min_lines: int = 4
    fallback_min_chars: int = 80
    fallback_min_conf: float = 0.65
    fallback_min_arabic: float = 0.60
    replace_margin: float = 0.03
    mixed_page_ratio: float = 0.35
    band_tolerance: int = 15
    column_gap_ratio: float = 0.10
    high_dpi: int = 3000
    side_limit: int = 0  # 0: no limit
    max_accuracy: bool = True
    fold_alef: bool = False
    filter_isolated: bool = True
    precision: str = "fp32"
    fp16: bool = False

    @property
    def effective_precision(self) -> str:
        known = self.precision if self.precision in ("fp32", "fp16", "bf16") else "fp32"
        return "fp16" if self.fp16 and known == "fp32" else known


def from_session(spark: SparkSession, base: Settings = Settings()) -> Settings:
    """Empty values are ignored, as are names that no setting has."""
    found = {}
    for f in fields(base):
        value = spark.conf.get(f"pagewright.{f.name}", None)
        if value:
            old = getattr(base, f.name)
            found[f.name] = value.lower() == "true" if isinstance(old, bool) else tuple(x.strip() for x in value.split(",")) if isinstance(old, tuple) else type(old)(value)
    return replace(base, **found)
