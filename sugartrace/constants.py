"""Fixed clinical and algorithm values. They must equal these numbers for results to be right."""

# glucose bands, mmol/L
VERY_LOW = 3.0
LOW = 3.9
HIGH = 10.0
VERY_HIGH = 13.9
STATUS_ORDER = ("very_low", "low", "in_range", "high", "very_high")

# mg/dL per mmol/L: server formulas and display / importers
MGDL_SERVER = 18.018
MGDL_DISPLAY = 18.0182

# insulin and carbohydrate delivery
BASAL_BOLUS_CUT_MU = 100.0
BOLUS_SPREAD_MIN = 3
BASAL_SPREAD_MIN = 60
BOLUS_DURATION = 3
ANNOUNCE_DURATION = 20
ANNOUNCE_PAIR_MIN = 15
EXCHANGE_G = 10.0
BASAL_STEP_MIN = 5

# series
MINUTES_PER_DAY = 1440
MAX_GAP_MIN = 30
BASAL_MEDIAN_WINDOW = 61
BOLUS_MIN_U = 0.05

# windows
CONTEXT_LEN = 120
HORIZON = 40
FORECAST_WINDOW = CONTEXT_LEN + HORIZON
TRAIN_STRIDE = 15
SCORE_STRIDE = 5

# detection
MERGE_GAP_MIN = 30
MIN_EVENT_MIN = 30
THRESHOLD_K = 2.0
PERSIST_SEVERITY = 6.0
IQR_PER_SIGMA = 1.349
SIGMA_FLOOR = 1e-6
STD_FLOOR = 1e-8

# rule layer
BOLUS_LEAD = 10
LATE_DELAY = 30
LATE_MAX = 60
LARGE_K = 1.5
LARGE_MIN_CV = 0.1
HISTORY_DAYS = 7
MIN_PRIOR_MEALS = 3
MIN_CARB_G = 10.0
DETECT_LOOKBACK = 15
DETECT_ATTRIBUTE_MAX = 75
DETECT_LATE = 15

# insulin / carbs on board
TAU_INSULIN = 55.871
TAU_CARB = 39.908
CARB_BIOAVAILABILITY = 0.7943

# post-meal excursion
EXCURSION_PRE = 30
EXCURSION_RISE = 1.1
EXCURSION_SUSTAIN = 10
EXCURSION_RETURN = 0.5
EXCURSION_CAP = {"missed": 180, "late": 240, "large": 300}
FLAT_LABEL_MIN = 60

CLASSES = ("missed", "late", "large", "prolonged", "anaerobic")

# Rates and sizes of sensor artefacts (14 days, mmol/L, minutes), and their codes.
ARTEFACT = {
    "gap_share": 0.10,
    "gap_log_mean": 3.0,
    "gap_log_deviation": 0.8,
    "jumps_fortnightly": 2.0,
    "jump_largest": 2.0,
    "dips_fortnightly": 3.0,
    "dip_deepest": 3.0,
    "dip_minutes": (20, 60),
    "dip_at_night": 0.7,
}
ARTEFACT_CODES = {"clean": 0, "dropout": 1, "jump": 2, "compression": 3}
SENSOR_FLOOR = 1.5
