"""Settings of corpus preparation, as one typed value."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    min_script_ratio: float = 0.5
    max_length_ratio: float = 3.0
    min_length_for_ratio: int = 10
    min_length_for_lid: int = 15
    max_assamese_letters: int = 3
    fold_bengali_danda: bool = False
    lid_alpha: float = 0.1
    lid_orders: tuple[int, ...] = (1, 2, 3)
    lid_max_features: int = 60_000
    #: Code point ranges of each language's script; the Latin ones serve European languages.
    scripts: dict[str, tuple[int, int]] = field(
        default_factory=lambda: {"hi": (0x0900, 0x097F), "bn": (0x0980, 0x09FF)} | dict.fromkeys(("en", "fr", "de", "es"), (0x0041, 0x024F))
    )


DEFAULT = Config()
