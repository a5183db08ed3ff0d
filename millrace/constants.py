"""Fixed values of the screening rules (defaults, thresholds, enumerations)."""

MAX_LAG = 12
MIN_VALID_RATIO = 0.7
TOP_K = 20
LOWPASS_TAU_MINUTES = 5.0
DETREND_WINDOW = 24
INTERPOLATE_LIMIT = 5
SEED = 42

NEAR_PEAK_RATIO = 0.95
NEUTRAL_BAND = 1
BOUNDARY_FACTOR = 0.75

RAW_MIN_SCORE = 0.30
RESIDUAL_MIN_CORR = 0.30
RESIDUAL_MIN_N = 30
TARGET_LEADS_RATE = 0.50
TARGET_LEADS_CAP = 0.25

RESIDUAL_BONUS = 0.10
STABILITY_BONUS = 0.10
TOTAL_BONUS_CAP = 0.20

REGIMES = ("low", "mid", "high")
MIN_REGIMES = 2
REGIME_UNSTABLE = 0.5
REGIME_WEIGHT_STRENGTH = 0.6
REGIME_WEIGHT_LAG = 0.4
ROLLING_UNSTABLE = 0.35
INNOVATION_RADIUS = 2
REDUNDANT_CORR = 0.995
EVIDENCE_MARGIN = 0.05
TOLERANT_STEP = 1.5

GRADES = (("A", 0.75), ("B", 0.6), ("C", 0.45), ("D", 0.3))

QUALITY_REFERENCE = {"missing_rate": 0.20, "saturation_ratio": 0.20, "abnormal_jump_ratio": 0.01, "robust_outlier_ratio": 0.01}
POOR_QUALITY = {"missing_rate": 0.2, "saturation_ratio": 0.2, "abnormal_jump_ratio": 0.01, "robust_outlier_ratio": 0.01}
SEVERE_QUALITY = {"missing_rate": 0.5, "saturation_ratio": 0.8, "abnormal_jump_ratio": 0.05, "robust_outlier_ratio": 0.05}

STRONG_RISKS = ("strong_formula_leakage", "common_capacity_driver", "severe_data_quality")
