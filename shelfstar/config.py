"""Run configuration (T14): validated, passed to jobs as a plain dataclass."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Seasonality, segment and default parameters of the retail model.
MONTH_FACTOR = {1: 0.7, 2: 0.8, 3: 1.0, 4: 1.2, 5: 1.1, 6: 1.0, 7: 0.9, 8: 0.9, 9: 1.1, 10: 1.2, 11: 1.5, 12: 1.8}
PEAK_STOCKOUT_MONTHS = (11, 12)
DIGITAL_RETURN_FACTOR = 2.5
STORE_RETURN_FACTOR = 0.8


@dataclass(frozen=True)
class SegmentRule:
    """Discount and return behaviour of one customer segment (percent values)."""

    name: str
    discount_probability: int
    discount_low: int
    discount_high: int
    return_probability: int


# Fixed values, keyed by the market segment that plays the role.
SEGMENT_RULES = {
    "AUTOMOBILE": SegmentRule("vip", 15, 5, 15, 5),
    "BUILDING": SegmentRule("premium", 25, 8, 18, 8),
    "FURNITURE": SegmentRule("loyal", 30, 10, 20, 10),
    "HOUSEHOLD": SegmentRule("regular", 35, 12, 25, 12),
    "MACHINERY": SegmentRule("new", 40, 15, 30, 15),
}


@dataclass(frozen=True)
class Config:
    """All tunable parameters of a run; ``validate`` raises on the first bad value."""

    historical_days: int = 90
    low_stock_threshold: int = 5
    overstock_days: int = 60
    return_delay_days: tuple[int, int] = (1, 3)
    default_price: float = 50.0
    default_forecast_units: int = 25
    price_cuts: tuple[float, float, float] = (975.0, 950.0, 925.0)
    event_shift_days: int = 8123
    write_mode: str = "overwrite"
    table_prefix: str = ""
    position_buckets: int = 32
    count_tolerance: float = 0.2
    extra: dict = field(default_factory=dict)

    def validate(self) -> "Config":
        def need(ok: bool, text: str) -> None:
            if not ok:
                raise ValueError(text)

        need(self.historical_days >= 1, "historical_days must be at least 1")
        need(self.low_stock_threshold >= 0, "low_stock_threshold must not be negative")
        need(self.overstock_days > 0, "overstock_days must be positive")
        lo, hi = self.return_delay_days
        need(1 <= lo <= hi <= 30, "return_delay_days must rise within 1..30")
        need(self.price_cuts[0] > self.price_cuts[1] > self.price_cuts[2] > 0, "price_cuts must fall")
        need(0.0 <= self.count_tolerance < 1.0, "count_tolerance lies in 0..1")
        need(self.position_buckets >= 1, "position_buckets must be at least 1")
        need(self.write_mode in ("overwrite", "append", "errorifexists", "ignore"), "unknown write_mode")
        return self

    @classmethod
    def from_dict(cls, values: dict) -> "Config":
        known = {k: v for k, v in values.items() if k in cls.__dataclass_fields__}
        rest = {k: v for k, v in values.items() if k not in known}
        if "return_delay_days" in known:
            known["return_delay_days"] = tuple(known["return_delay_days"])
        return replace(cls(), **known, extra=rest).validate()
