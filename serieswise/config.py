"""Column roles and parameters.

Fixed values: the column names, prefix lists, windows, thresholds and search
ranges below define the results and are stated plainly.
"""

from __future__ import annotations

# keys of every panel
SERIES = "series_id"
DAY = "date_id"
POS = "pos"  # dense 0-based row position inside a series
BLOCK = "_block"  # floor(pos / BLOCK_ROWS), the unit of work of every window
KEYS = (SERIES,)

# rows of one series handled by one window partition
BLOCK_ROWS = 65536

# fixed values: column roles
META_COLS = ["date_id", "is_scored"]
FINANCE_COLS = [
    "forward_returns",
    "risk_free_rate",
    "market_forward_excess_returns",
    "lagged_forward_returns",
    "lagged_risk_free_rate",
    "lagged_market_forward_excess_returns",
]
NON_FEATURE_COLS = META_COLS + FINANCE_COLS
RETURN_TARGET = "forward_returns"
EXCESS_TARGET = "market_forward_excess_returns"

# fixed values: prefixes of the feature groups
PREFIXES = ["M", "E", "I", "P", "V", "S", "MOM", "D"]
# fixed values: prefix -> number of raw columns (D1..D9, E1..E20, ...)
PREFIX_COUNTS = {"D": 9, "E": 20, "I": 9, "M": 18, "P": 13, "S": 12, "V": 13}
RAW_COLUMNS = {p: [f"{p}{i}" for i in range(1, n + 1)] for p, n in PREFIX_COUNTS.items()}

# fixed values: first-generation feature recipe
MACRO_COLS, MACRO_WINDOWS = ["E18", "E20"], [60, 120]
DYNAMIC_COLS, MOMENTUM_LAGS, RANK_WINDOW = ["M3", "M4", "M11", "M12", "M18"], [5, 10], 20
PRICE_COLS, REVERSION_WINDOWS = ["P5", "P6", "P9", "P12"], [30, 60]
SENTIMENT_COLS, SMOOTH_WINDOW, SPIKE_WINDOW = ["S2", "S7"], 20, 5

# fixed values: second-generation feature recipe
M_WINDOW, V_WINDOW, P_WINDOW = 5, 21, 21
E_LAGS = [21, 63]
I_LAG = 5
RATE_REGIME_THRESHOLD = 0.0001

# fixed values: splits, selection, positions
TRAIN_RATIO, VAL_RATIO, TEST_RATIO = 0.7, 0.2, 0.10
HIGH_NA = 0.40
INITIAL_TRAIN, TUNE_FOLDS, EVAL_FOLDS = 1512, 5, 10
IC_T_MIN, CORR_MAX, VAR_QUANTILE = 0.5, 0.85, 0.25
TOP_PAIRS, GAIN_KEEP = 200, 0.90
K_DEFAULT, K_WINDOW, K_MIN_ROWS = 1.0, 63, 20
IC_BLOCK = 63
TRADING_DAYS = 252
SCORE_CAP = 1_000_000.0
SEED = 42

# fixed values: back-test grid
VOL_TARGETS = [0.10, 0.12, 0.14, 0.16, 0.18]
VOL_WINDOWS = [30, 60, 90]
VOL_SMOOTH = 5
