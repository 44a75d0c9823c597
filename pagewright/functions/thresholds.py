"""Limits of all rules, as one immutable value that every rule takes."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Thresholds:
    critical_width: int = 400
    critical_height: int = 300
    warn_width: int = 800
    warn_height: int = 600
    critical_blur: float = 30.0
    warn_blur: float = 60.0
    extreme_blur: float = 15.0
    critical_dark: float = 15.0
    critical_bright: float = 300.0
    warn_dark: float = 35.0
    warn_bright: float = 220.0
    critical_contrast: float = 15.0
    warn_contrast: float = 22.0
    white_space: float = 80.0
    skew: float = 15.0
    critical_ocr: float = 25.0
    ocr: float = 45.0
    high_words: int = 5
    high_word_confidence: int = 70
    text_regions: int = 2
    characters: int = 30
    brisque: float = 55.0
    accept_score: float = 70.0
    review_score: float = 50.0
    index2_ocr: float = 30.0
    index2_accept: float = 50.0
    max_bytes: int = 10_485_760
    max_files: int = 50

    @classmethod
    def code_defaults(cls) -> Thresholds:
        return cls()

    @classmethod
    def env_example(cls) -> Thresholds:
        """The sample configuration: one pair of resolution limits serves as critical and as warning, BRISQUE is laxer."""
        return replace(cls(), warn_width=400, warn_height=300, brisque=80.0)


DEFAULTS = Thresholds.code_defaults()
EXTENSIONS = ("pdf", "png", "jpg", "jpeg")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif")
URL_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "bmp", "tiff", "tif")
