"""Parameters of the rules, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

from feedloom import rules as R


@dataclass(frozen=True)
class RuleParameters:
    themes: tuple[str, ...] = tuple(R.MODEL_THEMES)
    languages: tuple[str, ...] = ("en", "es", "fr", "de", "pt")
    profanity: tuple[str, ...] = tuple(R.PROFANITY)
    review_threshold: float = 0.70
    similarity_threshold: float = 0.80
    customer_weight: float = 0.4
    theme_spike_pct: float = 50.0
    sentiment_shift_points: float = 15.0
    severity_escalation: float = 1.0

    def __post_init__(self) -> None:
        if not self.themes or "other" not in self.themes:
            raise ValueError("themes must hold 'other'")
        for name, low, high in (
            ("review_threshold", 0, 1),
            ("similarity_threshold", 0, 1),
            ("customer_weight", 0, 1),
            ("theme_spike_pct", 1, 1000),
            ("sentiment_shift_points", 1, 100),
            ("severity_escalation", 0.1, 4),
        ):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if "en" not in self.languages:
            raise ValueError("languages must hold 'en'")
