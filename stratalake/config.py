"""Reference data, scales and the logical clock."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import date

SEED = 42
START_DATE, END_DATE = date(2024, 1, 1), date(2026, 6, 30)
N_USERS = 2000
NOISE_FRACTION = 0.60
HORIZON_DAYS = PURGE_DAYS = 5


def n_transactions() -> int:
    return int(os.environ.get("N_TRANSACTIONS", "250000"))


@dataclass(frozen=True)
class Company:
    ticker: str
    name: str
    merchants: tuple[str, ...]
    lag_days: int
    beta: float
    start_price: float
    drift: float
    volatility: float
    ticket_mean: float
    category: tuple[str, int, str]


# Companies with the merchant spellings of their transactions, and the merchants that are noise.
COMPANIES = (
    Company("SBUX", "Starbucks", ("Starbucks", "STARBUCKS STORE #1234", "STARBUCKS #0917"), 3, 0.35, 95.0, 0.06, 0.28, 9.5, ("Restaurants/Dining", 22, "Coffee Shop")),
    Company("CMG", "Chipotle Mexican Grill", ("Chipotle Mexican Grill", "CHIPOTLE 0455", "CHIPOTLE ONLINE"), 2, 0.45, 58.0, 0.11, 0.32, 16.0, ("Restaurants/Dining", 22, "Fast Food")),
    Company("TGT", "Target", ("Target", "TARGET.COM", "TARGET T-1088"), 5, 0.25, 142.0, 0.04, 0.30, 62.0, ("General Merchandise", 44, "Department Store")),
    Company("LULU", "lululemon athletica", ("lululemon athletica", "LULULEMON #212", "LULULEMON.COM"), 7, 0.40, 310.0, 0.08, 0.38, 118.0, ("Clothing/Shoes", 9, "Athletic Apparel")),
    Company("DPZ", "Domino's Pizza", ("Domino's Pizza", "DOMINOS 8871", "DOMINOS.COM"), 2, 0.30, 415.0, 0.05, 0.26, 27.0, ("Restaurants/Dining", 22, "Pizza")),
    Company("ULTA", "ULTA Beauty", ("ULTA Beauty", "ULTA #0921", "ULTA.COM"), 5, 0.35, 385.0, 0.07, 0.33, 58.0, ("Personal Care", 26, "Cosmetics")),
)
NOISE_MERCHANTS = (
    "SAFEWAY #1422", "WHOLE FOODS MKT", "SHELL OIL 5748", "CHEVRON 0091", "NETFLIX.COM", "SPOTIFY USA", "UBER TRIP", "LYFT RIDE",
    "COMCAST CABLE", "PG&E PAYMENT", "GEICO PREMIUM", "ATM WITHDRAWAL", "PAYROLL DIRECT DEP", "RENT PAYMENT", "CVS/PHARMACY #4410", "HOME DEPOT 6612",
)
# NYSE holidays of 2024, 2025 and 2026.
MARKET_HOLIDAYS = tuple(
    date.fromisoformat(d)
    for d in (
        "2024-01-01 2024-01-15 2024-02-19 2024-03-29 2024-05-27 2024-06-19 2024-07-04 2024-09-02 2024-11-28 2024-12-25 "
        "2025-01-01 2025-01-20 2025-02-17 2025-04-18 2025-05-26 2025-06-19 2025-07-04 2025-09-01 2025-11-27 2025-12-25 "
        "2026-01-01 2026-01-19 2026-02-16 2026-04-03 2026-05-25 2026-06-19 2026-07-03 2026-09-07 2026-11-26 2026-12-25"
    ).split()
)


def resolve_as_of(newest: date | None) -> date:
    """The logical clock: AS_OF_DATE if set, else the newest date of the data, else END_DATE.  Never the wall clock."""
    override = os.environ.get("AS_OF_DATE")
    return date.fromisoformat(override) if override else newest or END_DATE
