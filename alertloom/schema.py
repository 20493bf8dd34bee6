"""Column lists and default parameters."""

from pyspark.sql import types as T

ALERT_COLUMNS = ["ts", "source", "service", "severity", "message", "event_id", "raw_line"]

ALERT_SEVERITIES = ["WARN", "ERROR", "FATAL"]

SEVERITY_RANK = {"FATAL": 4, "ERROR": 3, "WARN": 2, "INFO": 1}

LOG_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("log_id", "timestamp", "cmdb_id", "log_name", "value")]
)

SPAN_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in (
            "timestamp",
            "cmdb_id",
            "span_id",
            "trace_id",
            "duration",
            "type",
            "status_code",
            "operation_name",
            "parent_span",
        )
    ]
)

FAULT_FIELDS = ["timestamp", "level", "cmdb_id", "failure_type"]
FAULT_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in FAULT_FIELDS])
FAULT_JSON_SCHEMA = T.StructType(
    [T.StructField(c, T.ArrayType(T.StringType())) for c in FAULT_FIELDS]
)

# Correlation defaults.
WINDOW_SEC = 240
SIMILARITY = 0.75
UPLOAD_SIMILARITY = 0.85
CONFIDENCE_FLOOR = 0.75
MIN_INCIDENT_SIZE = 2
SLOW_SPAN = 5000
FAULT_TOLERANCE_SEC = 600

# No published default exists for these three; the values are this library's own.
CROSS_SERVICE_SIMILARITY = 0.90
MAX_GAP_SEC = 240
MAX_SPAN_SEC = 1800

# Sampling and serving defaults.
SAMPLE_TARGET = 15_000
DETAIL_MEMBERS = 500
REPLAY_TARGET = 40_000
TIMELINE_ROWS = 5
DETAIL_TIMELINE_ROWS = 8
