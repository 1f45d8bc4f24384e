"""Fixed values the results depend on; they must equal the published behaviour of the analyses."""

IQR_MULTIPLIER = 1.5
Z_CUT = 3.0
FOREST_CONTAMINATION = 0.05
FOREST_SEED = 42
STRONG_CORRELATION = 0.7
SKEW_CUT = 1.0
HEAVY_TAIL_KURTOSIS = 3.0
HIGH_NULL_SHARE = 0.20
QUANTILES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
TOP_CATEGORIES = 15
NORMAL_P = 0.05
ROLLING_DAYS = 30
ONE_HOT_LIMIT = 10
PREVIEW_ROWS = 8
SCHEMA_ROWS = 3
QUERY_TEXT_CHARS = 2000
FINDING_CHARS = 300
REPORT_OUTPUT_CHARS = 1500
REPORT_ERROR_CHARS = 300
CHAT_OUTPUT_CHARS = 800
CHAT_ERROR_CHARS = 300
STEP_ATTEMPTS = 3

# Fixed texts of step contexts, findings and capped outputs.
STEP_OPEN, STEP_CLOSE = "\n--- Step ", " ---\n"
OUTPUT_LABEL, ERROR_LABEL = "Output:\n", "Error: "
CHART_MARK = "[Visualisation generated]\n"
NO_OUTPUT = "completed successfully."
CUT_OPEN, CUT_CLOSE = "\n... [truncated, ", " chars total]"

# Thresholds of our own; every operator that uses one takes it as a parameter.
NEAR_CONSTANT_SHARE = 0.99
LOW_CARDINALITY = 20
DATE_PARSE_SHARE = 0.8
GAP_FACTOR = 5.0
TREND_R2 = 0.5

# Text tokens a CSV reader of the pandas family takes as missing (fixed values).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Timestamp patterns tried by parse_datetimes, in order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy", "dd.MM.yyyy")
