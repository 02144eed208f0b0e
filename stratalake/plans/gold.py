"""Marts: daily spend, price features and the training set."""

from __future__ import annotations

from .. import config
from ..operators.contracts import assert_valid, load_contract
from ..operators.features import daily_spend, price_features, training_set
from ..schema import GOLD_FEATURES, GOLD_SPEND, GOLD_TRAINING, SILVER_MAP, SILVER_PRICES, SILVER_TRANSACTIONS
from ..sources.store import Lakehouse
from .bronze import newest_date


def build_all(lake: Lakehouse) -> dict[str, int]:
    """Marts first, then the training set from what was written; its contract is checked before the commit."""
    as_of = config.resolve_as_of(newest_date(lake))
    out = {
        GOLD_SPEND.name: lake.overwrite(GOLD_SPEND.name, daily_spend(lake.scan(SILVER_TRANSACTIONS.name), lake.scan(SILVER_MAP.name))).total,
        GOLD_FEATURES.name: lake.overwrite(GOLD_FEATURES.name, price_features(lake.scan(SILVER_PRICES.name))).total,
    }
    rows = training_set(lake.scan(GOLD_FEATURES.name), lake.scan(SILVER_PRICES.name), lake.scan(GOLD_SPEND.name)).persist()
    try:
        assert_valid(rows, load_contract("gold_training_set.yaml"), as_of)
        out[GOLD_TRAINING.name] = lake.overwrite(GOLD_TRAINING.name, rows).total
    finally:
        rows.unpersist()
    return out
