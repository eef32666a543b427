"""The column contract of the 98-feature order-book vector, labels, regimes and signal metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 10
SCHEMA_VERSION = 2.1

#: The features in their positions.
BOOK = [f"{side}_{what}_l{k}" for side in ("ask", "bid") for what in ("price", "size") for k in range(LEVELS)]
DERIVED = "mid_price spread spread_bps total_bid_volume total_ask_volume volume_imbalance weighted_mid_price price_impact".split()
ORDER_FLOW = (
    "add_rate_bid add_rate_ask cancel_rate_bid cancel_rate_ask trade_rate_bid trade_rate_ask net_order_flow net_cancel_flow net_trade_flow "
    "aggressive_order_ratio order_flow_volatility flow_regime_indicator size_mean_bid size_mean_ask size_std_bid size_std_ask size_max_bid size_max_ask "
    "size_skewness size_concentration queue_size_bid queue_size_ask average_queue_position level_concentration depth_ticks_bid depth_ticks_ask "
    "large_order_count_bid large_order_count_ask institutional_ratio_bid institutional_ratio_ask order_lifetime_mean order_lifetime_std cancel_ratio "
    "modify_ratio queue_size_ahead order_count_active"
).split()
CORE_SIGNALS = "true_ofi depth_norm_ofi executed_pressure signed_mp_delta_bps trade_asymmetry cancel_asymmetry fragility_score depth_asymmetry".split()
META = "book_valid time_regime mbo_ready dt_seconds invalidity_delta schema_version_feature".split()
FEATURES = BOOK + DERIVED + ORDER_FLOW + CORE_SIGNALS + META
SIGNALS = CORE_SIGNALS + META
INDEX = {name: k for k, name in enumerate(FEATURES)}

SAFETY_GATES = ("book_valid", "mbo_ready", "invalidity_delta")
UNSIGNED_FEATURES = ("price_impact",)
ASYMMETRY_SIGNALS = ("trade_asymmetry", "cancel_asymmetry", "depth_asymmetry")

LABELS = {-1: "Down", 0: "Stable", 1: "Up"}
REGIMES = {0: "OPEN", 1: "EARLY", 2: "MIDDAY", 3: "CLOSE", 4: "CLOSED"}

#: Expected sign of the correlation with the label; kind of value.
EXPECTED_SIGN = {name: "?" if name in ("fragility_score", "dt_seconds") else "+" if name in CORE_SIGNALS else "N/A" for name in SIGNALS}
KIND = {name: "continuous" for name in CORE_SIGNALS} | {"book_valid": "binary", "time_regime": "categorical", "mbo_ready": "binary", "dt_seconds": "continuous", "invalidity_delta": "count", "schema_version_feature": "constant"}
CATEGORIES: dict[str, list[float] | None] = {"book_valid": [0, 1], "time_regime": [0, 1, 2, 3, 4], "mbo_ready": [0, 1], "invalidity_delta": None, "schema_version_feature": [SCHEMA_VERSION]}


def label_name(label: Column, shifted: bool = False) -> Column:
    """Name of a label column; an unknown label is its own text. Shifted labels start at 0."""
    plain = label - 1 if shifted else label
    out = F.when(plain == -1, LABELS[-1]).when(plain == 0, LABELS[0]).when(plain == 1, LABELS[1])
    return out.otherwise(label.cast("string"))


def signal_info(spark: SparkSession) -> DataFrame:
    """(index, signal, kind, expected_sign) of the signals and gates."""
    return spark.createDataFrame([(INDEX[s], s, KIND[s], EXPECTED_SIGN[s]) for s in SIGNALS], "index int, signal string, kind string, expected_sign string")
