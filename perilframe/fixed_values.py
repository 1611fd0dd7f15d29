"""They define results, so they must not drift."""

# Hazards the monthly panel models.
PANEL_HAZARDS = ["Landslide", "Snake Bite", "Fire", "Flood"]

# Feed name, trailing days of a full and of a daily intake.
FEED_NAME = "drr_api"
INTAKE_DAYS = 30
DAILY_INTAKE_DAYS = 3

# Quality bounds.
HAZARD_ID_MIN, HAZARD_ID_MAX = 1, 47
LATITUDE_MIN, LATITUDE_MAX = 26.3, 30.5
LONGITUDE_MIN, LONGITUDE_MAX = 80.0, 88.3
COORDINATE_MOSTLY = 0.98
LOSS_ID_MIN = 1

# Rainfall windows in days, and the window of the daily peak.
RAIN_WINDOWS = [1, 3, 7]
PEAK_WINDOW = 7

# Page size of the incident list, rows per anomaly ranking.
PAGE_SIZE = 50
ANOMALY_ROWS = 15

# Held-out share and periods, folds, tautology cut.
TEST_FRACTION = 0.2
TEST_PERIODS = 3
CV_FOLDS = 5
SEED = 42
TAUTOLOGY_RATE = 0.9

# Risk bands (upper bounds, exclusive) and the wet season.
COUNT_BANDS = [(2, "Low"), (6, "Moderate")]
PROBABILITY_BANDS = [(0.3, "Low"), (0.6, "Moderate")]
TOP_BAND = "High"
MONSOON_FIRST_MONTH, MONSOON_LAST_MONTH = 6, 9

# Percentiles tried by the rainfall threshold rule.
THRESHOLD_PERCENTS = list(range(5, 100, 5))

# Feature sets.
PANEL_FEATURES = ["district_encoded", "hazard_encoded", "month", "prev_month_count", "historical_month_avg"]
LEADLAG_FEATURES = ["rain_1d", "rain_3d", "rain_7d", "rain_peak_7d", "month", "district_id"]
SEVERITY_FEATURES = [
    "hazard_id", "district_id", "month", "day_of_week",
    "rain_1d", "rain_3d", "rain_7d", "rain_peak_7d",
]
RAIN_SUMS = ["rain_1d", "rain_3d", "rain_7d"]
RAIN_ALL = ["rain_1d", "rain_3d", "rain_7d", "rain_peak_7d"]

# Split points per feature: above the number of hazards and districts, so that every code can be told apart.
MAX_BINS = 256

# Model settings, in Spark ML parameter names.
RF_COUNTS = {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 3, "maxBins": MAX_BINS}
GBT_LEADLAG = {"maxIter": 150, "maxDepth": 5, "stepSize": 0.2, "minInstancesPerNode": 50, "subsamplingRate": 0.85, "maxBins": MAX_BINS}
GBT_SEVERITY = {"maxIter": 150, "maxDepth": 5, "stepSize": 0.1, "minInstancesPerNode": 30, "subsamplingRate": 0.85, "maxBins": MAX_BINS}
GBT_LOSS = {"maxIter": 150, "maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 20, "subsamplingRate": 0.85, "maxBins": MAX_BINS}
GBT_DEFAULT = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "maxBins": MAX_BINS}
# Names that runs and their metrics are logged under.
BASELINE_RUN, FULL_RUN, HARD_RUN, TIER_RUN = "hazard_only_baseline", "full_features", "full_features_hard_subset", "tier_classification"
LOSS_METRICS = ("r2_log_scale", "mae_log_scale", "mae_real")

LOGISTIC_MAX_ITER = 1000
SEARCH_SPACE = {
    "maxIter": [100, 150, 200, 300],
    "maxDepth": [2, 3, 4, 5],
    "stepSize": [0.01, 0.05, 0.1, 0.2],
    "minInstancesPerNode": [5, 10, 20, 50],
    "subsamplingRate": [0.7, 0.85, 1.0],
}
SEARCH_DRAWS = 30
