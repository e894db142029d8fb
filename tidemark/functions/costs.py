"""Transaction costs and position sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Costs

#: Multiples of every cost component.
SCENARIOS = {"zero_cost": 0.0, "low_cost": 0.5, "base_cost": 1.0, "high_cost": 2.0, "stress_cost": 3.0}


def cost_fraction(costs: Costs = Costs(), scenario: str = "base_cost", side: str = "buy") -> float:
    """One leg's cost as a fraction of its value. Tax on services applies to brokerage and exchange charges."""
    own = costs.stt_buy_pct if side == "buy" else costs.stt_sell_pct
    stamp = costs.stamp_duty_pct if side == "buy" or not costs.stamp_duty_buy_only else 0.0
    services = costs.brokerage_pct + costs.exchange_charges_pct
    percent = costs.brokerage_pct + (costs.stt_pct if own is None else own) + costs.exchange_charges_pct + services * costs.gst_pct + stamp + costs.sebi_charges_pct + costs.slippage_pct
    return percent / 100.0 * SCENARIOS[scenario]


def round_trip_fraction(costs: Costs = Costs(), scenario: str = "base_cost") -> float:
    return cost_fraction(costs, scenario, "buy") + cost_fraction(costs, scenario, "sell")


def geometry_ok(entry: Column, stop: Column, side: str = "LONG") -> Column:
    return F.coalesce(stop < entry if side == "LONG" else stop > entry, F.lit(False))


def position_size(capital: Column, entry: Column, stop: Column, risk_pct: float = 0.5, lot: int = 1, min_qty: int = 1, side: str = "LONG") -> Column:
    """struct(qty, reason): what a loss of risk_pct of capital at the stop allows, in whole lots."""
    gap = F.abs(entry - stop)
    qty = (F.floor(F.try_divide(capital * (risk_pct / 100.0), gap) / lot) * lot).cast("long")
    reason = F.when(~geometry_ok(entry, stop, side), "invalid_risk_geometry").when(~(gap > 0), "invalid_stop_distance").when(qty < min_qty, "below_min_qty").otherwise("ok")
    return F.struct(F.when(reason == "ok", qty).otherwise(F.lit(0)).alias("qty"), reason.alias("reason"))


def size(capital: float, entry: float, stop: float, risk_pct: float, min_qty: int = 1) -> tuple[int, str]:
    """position_size of plain numbers, for the portfolio fold."""
    if not stop < entry:
        return 0, "invalid_risk_geometry"
    qty = int(capital * (risk_pct / 100.0) / (entry - stop) // 1)
    return (qty, "ok") if qty >= min_qty else (0, "below_min_qty")
