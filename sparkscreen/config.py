"""Settings of a screen."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Weights of the scoring categories in each preset (profit, value, safety, dividend, technical).
PRESETS = {
    "balanced": (1.0, 1.0, 1.0, 1.0, 1.0),
    "dividend_focus": (1.0, 0.8, 1.2, 2.5, 0.5),
    "deep_value": (0.8, 2.5, 1.2, 0.8, 0.5),
    "growth_quality": (2.5, 0.5, 1.0, 0.5, 1.0),
}
CATEGORIES = ("profit", "value", "safety", "dividend", "technical")
#: The most points of each category.
MOST_POINTS = (30.0, 25.0, 15.0, 10.0, 20.0)
#: Sectors whose cash flow isn't judged.
CASH_EXEMPT_SECTORS = ("銀行業", "保険業", "証券、商品先物取引業", "その他金融業")


@dataclass(frozen=True)
class ScreenConfig:
    min_trading_value: float = 30_000_000.0
    min_price: float = 50.0
    min_equity_ratio: float = 0.0
    min_cash_margin: float = -0.10
    target_markets: tuple[str, ...] | None = None
    preset: str = "balanced"
    multipliers: dict = field(default_factory=dict)
    verdict_mode: str = "grade"

    def weights(self) -> tuple[float, ...]:
        """An unknown preset is the balanced one; own multipliers override it; negative ones count as 0."""
        base = dict(zip(CATEGORIES, PRESETS.get(self.preset, PRESETS["balanced"]), strict=True))
        base |= {k: float(v) for k, v in self.multipliers.items() if k in base}
        return tuple(max(0.0, base[k]) for k in CATEGORIES)
