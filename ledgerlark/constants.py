"""Fixed values of the experiment-analytics domain."""

# The action types an attempt can take.
ACTION_TYPES = ("feature_engineering", "preprocessing", "model_swap", "hyperparam_search", "ensemble")

# Attempt stages, labels, lesson levels and lesson types.
STAGES = ("bootstrap", "reflexion", "exploitation")
LABELS = ("jump", "neutral", "regression", "error")
GENERALITY = ("L1_local", "L2_class", "L3_general")
LESSON_TYPES = ("failure", "recommend", "avoid", "no_op")

# Significance, seeds and budgets.
SIGNIFICANCE_Z = 2.0
CONFIRM_SEEDS = (7, 101)
AUDIT_SEED = 2025
ROW_CAP_SEED = 42
SUBMISSIONS_PER_DAY = 5

# Tolerance of a re-computed score.
NOISE_ABS = 1e-6
NOISE_REL = 1e-6

# Bandit updates.
BANDIT_DECAY = 0.95
DEAD_MEAN = 0.1
DEAD_MIN_OBSERVED = 5.0
REEXPLORE_EVERY = 100

# What an outcome counts as success, and its weight, in the calibration of beliefs.
OUTCOME_WORTH = {"jump": (1.0, 1.0), "gain": (0.5, 0.6), "failed": (0.0, 1.0), "even": (0.1, 0.2)}

# Bounds of the four traffic lights.
CITE_RATE_GOOD, CITE_RATE_BAD = 0.30, 0.10
SPREAD_GOOD, SPREAD_BAD = 0.15, 0.05
CALIBRATION_GOOD, CALIBRATION_BAD = 0.15, 0.30
REPEAT_RATE_GOOD, REPEAT_RATE_BAD = 0.20, 0.50
COVERAGE_GOOD, COVERAGE_BAD = 3, 1

# Bounds of fleet attention.
STALE_DAYS = 7
ERROR_SHARE_RED = 0.7

# Retrieval.
MMR_LAMBDA = 0.5
IMPACT_WEIGHT = 0.15
IMPACT_LOW, IMPACT_HIGH = 0.5, 1.5
NOOP_DAMP = 0.5
DUPLICATE_COSINE = 0.90
DUPLICATE_NEWEST = 250

# Evaluation guards.
LEAK_PERFECT_HIGH = 0.9999
LEAK_PERFECT_LOW = 1e-9
LEAK_BASELINE_RATIO = 100.0
IMPLAUSIBLE_BASELINE_RATIO = 10.0
FUTILITY_STD = 0.75
FUTILITY_AUDIT_SHARE = 0.1
TWIN_ABORT_SHARE = 0.5
PRESELECT_SHARE = 0.2
IMPORTANCE_REPEATS = 3
CEILING_SE = 3.0
LB_DEADBAND = 0.001

# Metric name -> (sign, class).
METRICS = {
    "auc": (1, "binary_proba"),
    "roc_auc": (1, "binary_proba"),
    "logloss": (-1, "binary_proba"),
    "accuracy": (1, "classification"),
    "f1": (1, "classification"),
    "qwk": (1, "classification"),
    "balanced_accuracy": (1, "classification"),
    "rmse": (-1, "regression_error"),
    "mae": (-1, "regression_error"),
    "rmsle": (-1, "regression_error"),
}

# Ordering of size classes and of fleet attention.
SIZE_RANK = {"tiny": 0, "small": 1, "mid": 2, "large": 3}
ATTENTION_ORDER = {"red": 0, "amber": 1, "green": 2}
