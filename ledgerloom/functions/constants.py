"""Fixed values that must equal the reference service's for the same results.

Everything in this module is a fixed value: token sets, keyword lists,
thresholds, defaults, limits and message texts, written in their natural
order. Logic lives elsewhere.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES -- keep equal to the reference behaviour.
# ---------------------------------------------------------------------------

# Text that reads as missing. These are the default NA tokens of pandas'
# CSV reader, which the reference relies on when it reads a file.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Text read as a real boolean column (what pandas' CSV reader types as bool).
BOOLEAN_TRUE_TOKENS = ["True", "TRUE", "true"]
BOOLEAN_FALSE_TOKENS = ["False", "FALSE", "false"]

# The detector's boolean label set: True, False, 0, 1, "True", "False",
# "true", "false", "YES", "NO", "yes", "no". A string column can only meet
# the string members.
BOOLEAN_LABEL_STRINGS = ["True", "False", "true", "false", "YES", "NO", "yes", "no"]

# Keyword lists for suggesting a sales field from a column name. Order of
# fields and of keywords matters: the first field with a contained keyword
# wins.
COLUMN_KEYWORDS = [
    ("date", ["date", "day", "time", "timestamp", "datetime", "dt", "period"]),
    ("sku", ["sku", "product_id", "item_id", "product_code", "item_code", "id"]),
    ("quantity", ["quantity", "qty", "amount", "count", "units", "volume"]),
    ("revenue", ["revenue", "sales", "price", "total", "amount", "value", "turnover"]),
    ("stock", ["stock", "inventory", "on_hand", "available", "balance"]),
    ("category", ["category", "type", "group", "department", "class", "segment"]),
]

# Column-type labels.
LABEL_DATE = "date"
LABEL_DATETIME = "datetime"
LABEL_NUMERIC = "numeric"
LABEL_INTEGER = "integer"
LABEL_STRING = "string"
LABEL_CATEGORICAL = "categorical"
LABEL_BOOLEAN = "boolean"
LABEL_UNKNOWN = "unknown"

# Type inference: share of *all* rows that must parse, strictly greater.
PARSE_SHARE_THRESHOLD = 0.8
# Categorical: distinct / non-null strictly below, and distinct strictly below.
CATEGORICAL_RATIO = 0.1
CATEGORICAL_MAX_DISTINCT = 50

# Validation thresholds.
MAX_COLUMNS = 50                  # more -> warning too_many_columns
MIN_COLUMNS = 2                   # fewer -> error too_few_columns
MISSING_ERROR_PCT = 50            # null % above -> error
MISSING_WARNING_PCT = 20          # null % above (and <= 50) -> warning
OLD_DATE = "2000-01-01"           # dates before -> warning very_old_dates
SHORT_RANGE_DAYS = 30             # whole days between min and max below -> warning
ZERO_SHARE = 0.5                  # zeros above this share of all rows -> warning

# Severities, in report order.
ERROR = "error"
WARNING = "warning"
INFO = "info"

# Issue texts. Placeholders: {col}, {pct} (one decimal), {n}, {days}.
ISSUE_TEXT = {
    "empty_file": ("File contains no data rows",
                   "Upload a file with at least one data row"),
    "too_many_columns": ("File has {n} columns, which is unusual",
                         "Ensure the first row contains column headers"),
    "too_few_columns": ("File has less than 2 columns",
                        "Sales data typically has date, SKU, and quantity columns"),
    "excessive_missing_values": ('Column "{col}" has {pct}% missing values',
                                 "This column may not be useful for analysis"),
    "high_missing_values": ('Column "{col}" has {pct}% missing values',
                            "Consider filling missing values or removing this column"),
    "missing_values": ('Column "{col}" has {pct}% missing values',
                       "Missing values will be handled during processing"),
    "invalid_dates": ('Could not parse dates in column "{col}"',
                      "Ensure dates are in YYYY-MM-DD format"),
    "future_dates": ("{n} rows have future dates",
                     "Future dates may indicate data entry errors"),
    "very_old_dates": ("{n} rows have dates before year 2000",
                       "Old dates may indicate incorrect data"),
    "short_date_range": ("Data spans only {days} days",
                         "Forecasting works best with at least 3 months of data"),
    "negative_values": ('{n} rows have negative values in "{col}"',
                        "Negative values may be valid for returns/discounts"),
    "many_zeros": ('More than 50% of values in "{col}" are zero',
                   "Many zeros may indicate missing data coded as zero"),
}

# Report summary texts. Placeholder {n}.
SUMMARY_ERRORS = "File has {n} error(s) that must be fixed before processing"
SUMMARY_WARNINGS = "File is valid but has {n} warning(s)"
SUMMARY_CLEAN = "File validation passed with no issues"

# Conformed sales table: required columns and the default used when absent.
# ``date`` defaults to today's UTC midnight (``as_of`` truncated to the day).
REQUIRED_DEFAULTS = [
    ("date", None),
    ("sku_id", "UNKNOWN"),
    ("sales_quantity", 0.0),
    ("unit_price", 0.0),
    ("sales_revenue", 0.0),
    ("stock_level", 0),
    ("category", ""),
]

# Upload admission.
ALLOWED_EXTENSIONS = [".csv", ".xlsx", ".xls", ".txt"]
MAX_FILE_BYTES = 50 * 1024 * 1024
REJECT_EXTENSION = "File type not allowed. Allowed: {allowed}"
REJECT_SIZE = "File too large. Max size: {mb}MB"
REJECT_CONTENT = "Invalid file content. File may be corrupted."
MAGIC_XLSX = "504B0304"           # zip container
MAGIC_XLS = "D0CF11E0"            # OLE2 compound file

# Registry status values.
STATUS_UPLOADED = "uploaded"
STATUS_PROCESSING = "processing"
STATUS_PROCESSED = "processed"
STATUS_ERROR = "error"

# Paging limits of the list queries.
SALES_PAGE_DEFAULT = 100
SALES_PAGE_MAX = 1000
UPLOADS_PAGE_DEFAULT = 10
PREVIEW_ROWS = 10
CLEANED_PREVIEW_ROWS = 20
SAMPLE_VALUES = 5
