"""Thresholds and switches, read from a nested mapping such as a YAML file holds; every entry has a default."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Config:
    invisible_contrast: float = 1.5
    suspicious_contrast: float = 3.0
    min_contrast: float = 4.5
    min_readable_size: float = 8.0
    suspicious_size: float = 4.0
    invisible_size: float = 1.0
    check_off_screen: bool = True
    check_zero_area: bool = True
    invisible_threshold: int = 1
    suspicious_threshold: int = 5
    check_hidden_instructions: bool = True
    default_strategy: str = "strip"
    remove_suspicious: bool = False
    flag_prefix: str = "[SUSPICIOUS] "
    ocr_enabled: bool = True
    ocr_dpi: int = 300
    page_width: float = 612.0
    page_height: float = 792.0
    highlight_mode: str = "white"


# Where each setting stands in the nested mapping.
PATHS = {
    "invisible_contrast": "visibility.contrast.invisible_ratio",
    "suspicious_contrast": "visibility.contrast.suspicious_ratio",
    "min_contrast": "visibility.contrast.min_ratio",
    "min_readable_size": "visibility.font_size.min_readable",
    "suspicious_size": "visibility.font_size.suspicious_size",
    "invisible_size": "visibility.font_size.invisible_size",
    "check_off_screen": "visibility.bbox.check_off_screen",
    "check_zero_area": "visibility.bbox.check_zero_area",
    "invisible_threshold": "risk.invisible_span_threshold",
    "suspicious_threshold": "risk.suspicious_span_threshold",
    "check_hidden_instructions": "risk.check_hidden_instructions",
    "default_strategy": "sanitization.default_strategy",
    "remove_suspicious": "sanitization.remove_suspicious",
    "flag_prefix": "sanitization.flag_prefix",
    "ocr_enabled": "extraction.ocr.enabled",
    "ocr_dpi": "extraction.ocr.dpi",
}

DEFAULT = Config()


def from_mapping(found: Mapping) -> Config:
    given = {}
    for field, path in PATHS.items():
        node = found
        for part in path.split("."):
            node = node.get(part) if isinstance(node, Mapping) else None
        if node is not None:
            given[field] = node
    return Config(**given)


def load(path: str | Path) -> Config:
    """The file's settings; the defaults where it is missing or empty."""
    import yaml

    path = Path(path)
    return from_mapping((yaml.safe_load(path.read_text(encoding="utf-8")) or {}) if path.exists() else {})
