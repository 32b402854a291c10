"""Shared constants."""

from __future__ import annotations

# --- fixed values: indicator periods and zones ---
SMA_DEFAULT = 20
SMA_TRIO = (20, 50, 200)
RSI_PERIOD = 14
RSI_OVERBOUGHT, RSI_OVERSOLD = 70.0, 30.0
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BOLLINGER_STD = 2.0
ATR_PERIOD, ATR_STOP_MULTIPLIER = 14, 2.0
STOCH_K, STOCH_D, STOCH_SMOOTH = 14, 3, 3
STOCH_OVERBOUGHT, STOCH_OVERSOLD = 80.0, 20.0
ADX_PERIOD, ADX_TREND = 14, 25.0
TENKAN, KIJUN, SENKOU_B = 9, 26, 52

# --- fixed values: risk ---
RISK_FREE = 0.04
TRADING_DAYS = 252
FEAR_HIGH, FEAR_DEFAULT, YIELD_DEFAULT = 25.0, 20.0, 4.0
ALTMAN_SAFE, ALTMAN_GREY = 2.99, 1.81
HURST_REVERTING, HURST_TRENDING = 0.45, 0.55
VAR_CONFIDENCE, VAR_LOOKBACK, VAR_MIN_OBS = 0.95, 252, 20
VOL_WINDOW = 21
ALIGN_MIN_OBS, BETA_MIN_OBS = 20, 60
KELLY_HALF, KELLY_MACRO = 2.0, 2.0
# metric, best anchor, worst anchor, weight
RISK_FACTORS = (
    ("rolling_vol", 0.15, 0.60, 0.15),
    ("hist_var", 0.0, -0.08, 0.15),
    ("expected_shortfall", 0.0, -0.12, 0.15),
    ("max_drawdown", 0.0, -0.60, 0.20),
    ("sharpe", 2.5, 0.0, 0.10),
    ("sortino", 2.5, 0.0, 0.10),
    ("calmar", 5.0, 0.0, 0.10),
    ("altman_z", 2.99, 0.0, 0.05),
)

# --- fixed values: valuation model ---
MARKET_RETURN, TAX_RATE, TERMINAL_GROWTH, PROJECTION_YEARS = 0.10, 0.21, 0.02, 5
STRONG_BUY_MARGIN = 20.0
GRID_WACC_DELTA, GRID_GROWTH_DELTA, GRID_STEPS = 0.02, 0.05, 3
AGREEMENT_TOLERANCE = 0.15

# --- fixed values: scorecard ---
# key, default, minimum, maximum
HIGH_ALIGNMENT, MODERATE_ALIGNMENT = 75.0, 40.0
MIN_NET_MARGIN, MAX_DEBT_TO_EQUITY, FINANCIALS_MAX_DEBT_TO_EQUITY = 0.10, 2.5, 4.0
MIN_CURRENT_RATIO, MAX_BETA = 1.0, 1.5
PE_RANGE, PEG_RANGE = (10.0, 45.0), (0.0, 2.5)
MIN_INTEREST_COVERAGE, MIN_ROIC_PCT, MIN_FCF_YIELD_PCT = 3.0, 10.0, 4.0
SCORE_WEIGHTS = {
    "net_margin": 1.5, "debt_to_equity": 1.5, "roic": 1.5, "interest_coverage": 1.0,
    "current_ratio": 1.0, "pe_ratio": 0.75, "peg_ratio": 0.75, "beta": 0.5,
}
FINANCIAL_SECTORS = ("Financial Services", "Financials")
SECTOR_PE = {
    "Technology": (15.0, 65.0), "Financial Services": (6.0, 18.0), "Financials": (6.0, 18.0),
    "Utilities": (12.0, 22.0), "Energy": (6.0, 22.0), "Consumer Defensive": (14.0, 28.0),
}
WATCH_MIN_MARGIN, WATCH_MAX_DE, WATCH_MIN_CURRENT, WATCH_PE, WATCH_CARDS = 0.10, 1.0, 1.2, (15.0, 45.0), 4

# --- fixed values: outlier bounds (metric, limit, applies to the magnitude) ---
OUTLIER_BOUNDS = (
    ("net_margin", 200.0, True), ("gross_margin", 100.0, False), ("operating_margin", 100.0, False),
    ("roa", 100.0, True), ("roe", 500.0, True), ("roic", 200.0, True),
    ("current_ratio", 20.0, False), ("quick_ratio", 20.0, False), ("debt_to_equity", 10.0, False),
    ("pe_ratio", 300.0, False), ("price_to_book", 100.0, False), ("peg_ratio", 10.0, True),
    ("ev_ebitda", 100.0, True), ("fcf_yield", 50.0, True),
)

# --- fixed values: quality factors (factor, factor weight, metric, low or ideal, high; None = ideal score) ---
QUALITY_FACTORS = (
    ("profitability", 0.25, "net_margin", 0.0, 25.0),
    ("profitability", 0.25, "gross_margin", 0.0, 60.0),
    ("profitability", 0.25, "operating_margin", 0.0, 30.0),
    ("profitability", 0.25, "roa", 0.0, 15.0),
    ("stability", 0.25, "current_ratio", 0.0, 3.0),
    ("stability", 0.25, "interest_coverage", 0.0, 10.0),
    ("stability", 0.25, "altman_z", 0.0, 3.5),
    ("growth", 0.15, "earnings_growth", -10.0, 25.0),
    ("valuation", 0.15, "pe_ratio", 20.0, None),
    ("valuation", 0.15, "peg_ratio", 1.0, None),
    ("valuation", 0.15, "price_to_book", 3.0, None),
    ("valuation", 0.15, "ev_ebitda", 12.0, None),
    ("efficiency", 0.20, "roic", 0.0, 20.0),
    ("efficiency", 0.20, "roe", 0.0, 30.0),
    ("efficiency", 0.20, "asset_turnover", 0.0, 1.5),
)
DEBT_ZERO_POINT = 2.0  # debt-to-equity scores 0 at this multiple of the sector threshold
QUALITY_BANDS = (85.0, 70.0, 50.0, 30.0)

# --- fixed values: verdict bands ---
STRONG_BUY_SCORE, STRONG_BUY_SAFETY, HOLD_SCORE, HOLD_SAFETY = 75.0, -30.0, 50.0, -25.0
HIGH_INSIDER_PCT = 5.0

# --- fixed values: projections, model, text, alerts ---
SIMULATIONS, FORECAST_DAYS, BLOCK_DAYS, MIN_HISTORY = 1000, 60, 5, 30
UPSIDE_PCT, DOWNSIDE_PCT = 65.0, 40.0
LABEL_HORIZON, TEST_FRACTION, MIN_TRAIN_ROWS, MIN_TRAIN_BARS = 10, 0.2, 200, 60
WALK_TRAIN, WALK_TEST = 126, 42
COST_BPS = 10.0
MAX_ARTICLES, MIN_ARTICLES, POSITIVE, NEGATIVE = 20, 3, 0.05, -0.05
MAX_HISTORY, MAX_SUGGESTIONS, MIN_EVALUABLE = 100, 10, 3
OUTPERFORM_PCT = 10.0
RISK_PROFILES = {"Conservative": 0.7, "Balanced": 1.0, "Aggressive": 1.6}
MIN_HOLDING_OBS = 30
