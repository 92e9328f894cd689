"""Fixed values that must equal the reference application's behaviour.

Everything here is plain data: column lists, code mappings, plan limits and
bounds.  Operators take these as defaults and accept overrides.
"""

from __future__ import annotations

# ---- fixed values: raw listing columns removed before training -----------
COLUMNS_TO_DROP = [
    "index", "name", "seller", "offerType", "abtest", "dateCrawled",
    "monthOfRegistration", "yearOfRegistration", "postalCode", "dateCreated",
    "lastSeen", "nrOfPictures",
]
# ---- fixed values: raw listing columns removed by the cleaning job -------
COLUMNS_CLEANUP = [
    "index", "name", "seller", "offerType", "abtest", "dateCrawled",
    "monthOfRegistration", "postalCode", "dateCreated", "lastSeen", "nrOfPictures",
]

TARGET = "price"
TEST_SIZE = 0.2
SPLIT_SEED = 15

OUTLIER_FEATURES = ["powerPS"]
OUTLIER_FACTOR = 1.5
NUMERICAL_FEATURES = ["powerPS", "kilometer", "age"]
QUANTILE_FEATURES = ["kilometer"]
BOXCOX_FEATURES = ["powerPS", "age"]
CATEGORICAL_FEATURES = ["vehicleType", "model", "fuelType", "brand"]
BINARY_FEATURES = ["gearbox", "notRepairedDamage"]
PCA_VARIANCE = 0.95

# ---- fixed values: cleaning bounds ---------------------------------------
PRICE_MIN, PRICE_MAX = 200, 20_000
POWER_MIN_EXCLUSIVE, POWER_MAX = 0, 1000
YEAR_MIN, YEAR_MAX = 1980, 2023
EXCLUDED_FUEL = "Other"
EXCLUDED_DAMAGE = "NaN"

# ---- fixed values: strict binary codes of the training data --------------
DAMAGE_CODES = {"ja": 1, "nein": 0}
GEARBOX_CODES = {"automatik": 1, "manuell": 0}
# ---- fixed values: decoded labels of the cleaned data --------------------
DAMAGE_LABELS = {1: "Yes", 0: "No"}
GEARBOX_LABELS = {1: "Automatic", 0: "Manual"}

# ---- fixed values: German -> English value translation -------------------
FUEL_TRANSLATION = {
    "benzin": "petrol", "diesel": "diesel", "lpg": "lpg", "cng": "cng",
    "hybrid": "hybrid", "elektro": "electric", "andere": "other",
}
BODY_TRANSLATION = {
    "limousine": "sedan", "kleinwagen": "small car", "kombi": "station wagon",
    "bus": "bus", "cabrio": "convertible", "coupe": "coupe", "suv": "suv",
    "andere": "other",
}

# ---- fixed values: camelCase listing columns -> stored snake_case --------
RENAME_TO_STORED = {
    "brand": "brand",
    "model": "model",
    "vehicleType": "vehicle_type",
    "fuelType": "fuel_type",
    "powerPS": "power_ps",
    "kilometer": "kilometer",
    "yearOfRegistration": "year_of_registration",
    "gearbox": "gearbox",
    "notRepairedDamage": "not_repaired_damage",
    "price": "price",
}
REQUIRED_IMPORT_COLUMNS = list(RENAME_TO_STORED)

# ---- fixed values: age groups, right-closed (lo, hi] ---------------------
AGE_BINS = [0, 3, 5, 10, 15, 20, 100]
AGE_LABELS = ["0-3", "4-5", "6-10", "11-15", "16-20", "20+"]

# ---- fixed values: subscription plans (id, name, per minute, per day, price)
PLANS = [
    (1, "Free", 10, 100, 0.0),
    (2, "Basic", 50, 1000, 9.99),
    (3, "Premium", 100, 5000, 19.99),
]
DEFAULT_PLAN_ID = 1

# ---- fixed values: score request defaults and bounds ---------------------
REQUEST_DEFAULTS = {
    "vehicleType": "coupe", "gearbox": "automatic", "powerPS": 190.0,
    "model": "a5", "kilometer": 125000.0, "fuelType": "diesel",
    "brand": "audi", "notRepairedDamage": "no", "yearOfRegistration": 2010,
}
REQUEST_MIN_YEAR = 1885
DEFAULT_ERROR_MARGIN = 500.0
CACHE_TTL_SECONDS = 3600

# ---- fixed values: comparable listings -----------------------------------
SIMILAR_LOW, SIMILAR_HIGH = 0.3, 1.3
SIMILAR_TOP_K = 10
VERDICT_CLOSE = 100.0

# ---- fixed values: dashboard caps and annotations ------------------------
FACET_POWER_CAP = 500
FACET_KM_CAP = 150_000
YEAR_SERIES_START = 1990
YEAR_EVENTS = [(2008, "Financial Crisis"), (2020, "COVID-19")]

# ---- fixed values: boosted-tree settings of the shipped model ------------
GBT_PARAMS = {"n_estimators": 500, "max_depth": 10, "learning_rate": 0.02,
              "subsample": 0.8, "colsample_bytree": 0.9, "random_state": 42}
GBT_PATIENCE = 10

# ---- fixed values: tuning of the boosted trees ----------------------------
TUNING = {"n_trials": 30, "timeout": 1200, "cv_folds": 5}
TUNING_SPACE = {
    "n_estimators": [50, 300, 500, 600, 800],
    "max_depth": [8, 10, 12, 15],
    "learning_rate": [0.0001, 0.02, 0.05, 0.08, 0.5],
    "subsample": [0.7, 0.8],
    "colsample_bytree": [0.9],
    "random_state": [15, 42, 100],
}
# ---- fixed values: model comparison ---------------------------------------
CV_REPORT_FOLDS = 10
SEARCH_FOLDS = 5
SEARCH_CANDIDATES = 5
SEARCH_SPACES = {
    "knn": {"k": [3, 5, 8, 10, 15, 20]},
    "gbt": {"maxIter": [300, 500, 800, 1000], "maxDepth": [5, 10, 20], "stepSize": [0.001, 0.05, 0.1]},
    "rf": {"numTrees": [50, 100, 150, 200], "maxDepth": [5, 15]},
}
TUNED_MODELS = {
    "knn": {"k": 8},
    "gbt": {"max_iter": 300, "max_depth": 10, "step": 0.05, "subsample": 1.0, "colsample": 1.0},
    "rf": {"num_trees": 200, "max_depth": 15},
}
# untuned models: the usual defaults of such regressors (trees of a forest grow
# as deep as Spark allows)
PLAIN_MODELS = {
    "knn": {"k": 5},
    "gbt": {"max_iter": 100, "max_depth": 6, "step": 0.3, "subsample": 1.0, "colsample": 1.0},
    "rf": {"num_trees": 100, "max_depth": 30},
}
