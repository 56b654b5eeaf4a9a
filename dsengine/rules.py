"""Fixed values that must equal the behaviour being reproduced.

Everything here is plain data: keyword lists, dictionaries and thresholds.
Operators read them as defaults and accept overrides as parameters.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (keyword lists, dictionaries, thresholds) - keep in this order
# ---------------------------------------------------------------------------

# Target inference / problem type
INFER_TARGET_MAX_DISTINCT = 10

# Boolean detection: every non-null value must be one of these (at most 2 distinct)
BOOLEAN_VALUES = [0, 1, True, False, "True", "False", "true", "false", "yes", "no",
                  "Yes", "No", "YES", "NO"]

# Date-like text patterns and required share
DATE_TEXT_PATTERNS = [r"^\d{4}-\d{2}-\d{2}", r"^\d{2}/\d{2}/\d{4}",
                      r"^\d{1,2}-\d{1,2}-\d{4}"]
DATE_TEXT_SHARE = 0.8

# Binary categorical dictionary: lowered value -> (positive, negative)
BINARY_PAIRS = {
    "yes": ("yes", "no"),
    "no": ("yes", "no"),
    "available": ("available", "not available"),
    "not available": ("available", "not available"),
    "present": ("present", "absent"),
    "absent": ("present", "absent"),
    "true": ("true", "false"),
    "false": ("true", "false"),
    "1": ("1", "0"),
    "0": ("1", "0"),
    "y": ("yes", "no"),
    "n": ("yes", "no"),
}
CLUSTERED_MIN, CLUSTERED_MAX = 3, 10
FULLY_CATEGORICAL_MIN = 5   # literal condition (> 5), shadowed by the 3-10 branch
DECODE_THRESHOLD = 0.5

# Cleaning thresholds
IQR_FACTOR = 1.5
HIGH_VARIATION_SHARE = 0.1
HIGH_MISSING_SHARE = 0.4
ROWS_FIRST_LIMIT = 0.05
LOW_MISSING_ROWS_LIMIT = 0.05
IDENTIFIER_ROW_KEYWORDS = ["id", "roll", "code", "number", "serial", "reference"]
IDENTIFIER_ROW_UNIQUENESS = 0.8
IDENTIFIER_DROP_KEYWORDS = ["id", "uuid", "guid", "pk"]
IDENTIFIER_DROP_UNIQUENESS = 0.95
LOW_IMPACT_KEYWORDS = ["name", "description", "notes", "comments", "remarks",
                       "email", "phone", "address"]
RARE_CATEGORY_SHARE = 0.01
RARE_CATEGORY_LABEL = "Other"
UNKNOWN_CATEGORY = "Unknown"

# Domain rules: first match wins, numeric columns only (substring of lower name)
DOMAIN_RULES = [
    (["age"], 0.0, 120.0),
    (["salary", "income", "revenue"], 0.0, None),
    (["percent", "ratio", "rate"], 0.0, 100.0),
]

# Canonical synonyms for text values (exact spellings)
CANONICAL_VALUES = {
    "male": ["m", "M", "Male", "MALE", "male"],
    "female": ["f", "F", "Female", "FEMALE", "female"],
    "yes": ["y", "Y", "Yes", "YES", "yes", "1", "true", "True", "TRUE"],
    "no": ["n", "N", "No", "NO", "no", "0", "false", "False", "FALSE"],
}

# Consistency checks
DATE_ORDER_KEYWORDS = ["start", "end"]
DATE_KEYWORD = "date"
NON_NEGATIVE_KEYWORDS = ["quantity", "count"]

# Feature selection
LOW_CORRELATION = 0.05

# EDA
HISTOGRAM_BINS = 30
TOP_VALUES = 10
PAIR_PLOT_COLUMNS = 5
NEAR_CONSTANT_RATIO = 0.01

# Dashboard
CATEGORY_SHARE_KEYWORDS = ["country", "state", "city", "region", "category",
                           "segment", "department", "group", "type"]
DASHBOARD_IDENTIFIER_KEYWORDS = ["id", "uuid", "code"]
CATEGORY_SHARE_TEXT_RANGE = (2, 20)
CATEGORY_SHARE_NUMERIC_RANGE = (2, 10)
PIE_TOP = 8
BAR_TOP = 10
HEATMAP_COLUMNS = 8
RELATION_SAMPLE_ROWS = 800

# Modelling
TEST_SHARE = 0.2
SEED = 42
TASK_MAX_DISTINCT = 20
TASK_INTEGER_SHARE = 0.98
TASK_UNIQUE_RATIO = 0.05
TASK_MAX_DISTINCT_WIDE = 50
TASK_UNIQUE_RATIO_WIDE = 0.02
LABEL_ROUND_SHARE = 0.95
ISCLOSE_ATOL = 1e-8
ISCLOSE_RTOL = 1e-5
N_TREES = 100
MAX_ITER = 1000
KNN_K = 5
#: models that train_all fits side by side
FITS_AT_ONCE = 4
#: models of many small rounds, each waiting for the one before: train_all begins with them
FIT_FIRST = ["Gradient Boosting Regressor", "AdaBoost Regressor", "Support Vector Regressor", "Neural Network Regressor"]
#: text columns with more values are one sparse vector, not a column a value
ONE_HOT_COLUMNS = 1000
MLP_HIDDEN = [100, 50]

# Report labels
IMPUTE_MEAN = "mean"
IMPUTE_MEDIAN = "median"
IMPUTE_MEDIAN_HIGH_VARIATION = "median (high variation detected)"
IMPUTE_FILL = "ffill/bfill"
PROBLEM_TYPES = ["Binary Classification", "Multi-class Classification", "Regression", "Unknown"]

# Model line-up, in training order
CLASSIFIERS = ["Logistic Regression", "Random Forest Classifier", "Gradient Boosting Classifier", "Support Vector Machine",
               "Decision Tree Classifier", "K-Nearest Neighbors Classifier", "Neural Network Classifier", "AdaBoost Classifier"]
REGRESSORS = ["Linear Regression", "Random Forest Regressor", "Gradient Boosting Regressor", "Support Vector Regressor",
              "Decision Tree Regressor", "K-Nearest Neighbors Regressor", "Neural Network Regressor", "AdaBoost Regressor"]
#: Spark's limit; trees grow until it or a pure leaf stops them
TREE_MAX_DEPTH = 30
MLP_MAX_ITER = 1000
#: landmarks and iterations of the kernel models
LANDMARKS = 256
KERNEL_MAX_ITER = 100

# Input-type inference (scoring form)
INPUT_DATE_SHARE = 0.7
INPUT_DATE_SHARE_NAMED = 0.3
INPUT_NUMBER_SHARE = 0.9
INPUT_DATE_NAME_PATTERN = r"(date|dob|timestamp|created|updated|time)"
INPUT_TIME_PATTERN = r"\d{1,2}:\d{2}|T\d{1,2}:\d{2}"
INPUT_SHORT_NUMBER_LEN = 6

# Target suitability
SUITABILITY_NUMERIC_CLASSES = 20
SUITABILITY_TEXT_RANGE = (2, 10)
