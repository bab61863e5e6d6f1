"""Word lists, patterns, name lists and thresholds.

Everything in this file is a value that results depend on, stated as plain text.
There is no logic here.
"""

# Strings that mean "missing", compared exactly and case-sensitively.
MISSING_TOKENS = [
    "", "null", "NULL", "none", "NONE", "na", "NA", "n/a", "N/A",
    "nan", "NaN", "nil", "missing",
]

# Names of identifier columns, compared in lower case.
IDENTIFIER_NAMES = ["id", "guid", "uuid", "pk", "fk", "key"]
IDENTIFIER_ENDINGS = ["_id", "_pk", "_fk", "_guid", "_uuid", "_key", "id_", "key_"]

# Text forms of a boolean.
BOOLEAN_WORDS = ["0", "1", "true", "false", "True", "False", "Y", "N", "y", "n"]

# A date is the whole text; a datetime only has to start like this.
DATE_FORMS = [r"\d{4}-\d{2}-\d{2}", r"\d{4}/\d{2}/\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}"]
DATETIME_FORMS = [
    r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}",
    r"\d{4}/\d{2}/\d{2}[ T]\d{2}:\d{2}:\d{2}",
]

# Texts that read as a number.
NUMBER_FORMS = [r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", r"[+-]?(?i:inf|infinity)"]

# White space as str.strip() removes it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Ordered vocabularies, compared in lower case.
ORDINAL_WORDS = {
    "education": [
        "no schooling", "primary", "middle school", "secondary", "high school", "diploma", "associate",
        "bachelor", "undergraduate", "master", "postgraduate", "phd", "doctorate",
    ],
    "membership_tier": ["basic", "bronze", "silver", "gold", "platinum", "diamond"],
    "agreement": ["strongly disagree", "disagree", "neutral", "agree", "strongly agree"],
    "quality": ["very poor", "poor", "fair", "average", "good", "very good", "excellent"],
    "priority": ["low", "medium", "high", "critical", "urgent"],
    "size": ["xs", "s", "m", "l", "xl", "xxl"],
}

# Columns left out when rows are compared for duplicates (lower case).
AUDIT_COLUMNS = [
    "id", "created_at", "updated_at", "modified_at", "created_by",
    "updated_by", "row_id", "etl_timestamp", "insert_date",
]

# Schemas and databases that belong to the server itself.
SYSTEM_SCHEMAS = {
    "mysql": ["information_schema", "mysql", "performance_schema", "sys"],
    "postgres": ["pg_catalog", "information_schema"],
    "oracle": [
        "SYS", "SYSTEM", "AUDSYS", "OUTLN", "GSMADMIN_INTERNAL", "GSMUSER", "DIP", "DBSNMP",
        "ORACLE_OCM", "APPQOSSYS", "WMSYS", "EXFSYS", "CTXSYS", "XDB", "ANONYMOUS",
        "ORDS_METADATA", "ORDS_PUBLIC_USER", "MDSYS", "OLAPSYS", "LBACSYS", "DVSYS", "FLOWS_FILES",
        "APEX_040200", "APEX_050000", "APEX_200200", "APEX_PUBLIC_USER", "OJVMSYS", "ORDDATA",
        "ORDSYS", "SI_INFORMTN_SCHEMA", "XS$NULL",
    ],
    "sqlserver": ["master", "tempdb", "model", "msdb", "mssqlsystemresource", "distribution"],
}
SYSTEM_SCHEMA_PREFIX = "pg_"

# Shown for code that refers to no known table.
STANDALONE = "None (Standalone Code)"

# Large-object column types (lower case).
LARGE_OBJECT_TYPES = [
    "tinyblob", "blob", "mediumblob", "longblob", "tinytext", "text", "mediumtext", "longtext",
    "bytea", "xml", "clob", "nclob", "long", "long raw",
]
JSON_TYPES = ["json", "jsonb"]
CHARACTER_TYPES = ["varchar", "char", "nvarchar"]
LARGE_CHARACTER_LENGTH = 255

# Waits that do not mean work is held up.
IDLE_WAIT_CLASS = "Idle"
IDLE_WAIT_PREFIX = "idle"
BENIGN_WAITS = [
    "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT", "CLR_SEMAPHORE", "LAZYWRITER_SLEEP",
    "OLD_ALLOC_CHECK", "REQUEST_FOR_DEADLOCK_SEARCH", "SLEEP_TASK",
    "CHECKPOINT_QUEUE", "LOGMGR_QUEUE", "BROKER_TASK_STOP", "WAITFOR",
    "XE_TIMER_EVENT", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "DIRTY_PAGE_POLL",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "SP_SERVER_DIAGNOSTICS_SLEEP",
]
BENIGN_WAITS_LONG = [
    "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP",
    "BROKER_TO_FLUSH", "BROKER_TRANSMITTER", "CHECKPOINT_QUEUE", "CHKPT",
    "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT", "CLR_SEMAPHORE", "CXCONSUMER",
    "DBMIRROR_DBM_EVENT", "DBMIRROR_EVENTS_QUEUE", "DBMIRROR_WORKER_QUEUE",
    "DBMIRRORING_CMD", "DIRTY_PAGE_POLL", "DISPATCHER_QUEUE_SEMAPHORE",
    "EXECSYNC", "FSAGENT", "FT_IFTS_SCHEDULER_IDLE_WAIT", "FT_IFTSHC_MUTEX",
    "HADR_CLUSAPI_CALL", "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_LOGCAPTURE_WAIT",
    "HADR_NOTIFICATION_DEQUEUE", "HADR_TIMER_TASK", "HADR_WORK_QUEUE",
    "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE", "MEMORY_ALLOCATION_EXT",
    "ONDEMAND_TASK_QUEUE", "PARALLEL_REDO_DRAIN_WORKSPACE", "PARALLEL_REDO_LOG_CACHE",
    "PARALLEL_REDO_TRAN_LIST", "PARALLEL_REDO_WORKER_SYNC", "PARALLEL_REDO_WORKER_WAIT",
    "PREEMPTIVE_OS_FLUSHFILTERBUFFERS", "PREEMPTIVE_XE_GETTARGETSTATE",
    "PWAIT_ALL_COMPONENTS_INITIALIZED", "PWAIT_DIRECTLOGCONSUMER_GETNEXT",
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP", "QDS_ASYNC_QUEUE",
    "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP", "QDS_SHUTDOWN_QUEUE",
    "REDUNDANT_CLIENT_INFO", "REQUEST_FOR_DEADLOCK_SEARCH", "RESOURCE_QUEUE",
    "SERVER_IDLE_CHECK", "SLEEP_BPOOL_FLUSH", "SLEEP_DBSTARTUP", "SLEEP_DCOMSTARTUP",
    "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY", "SLEEP_MASTERUPGRADED",
    "SLEEP_MSDBSTARTUP", "SLEEP_SYSTEMTASK", "SLEEP_TASK", "SLEEP_TEMPDBSTARTUP",
    "SNI_HTTP_ACCEPT", "SOS_WORK_DISPATCHER", "SP_SERVER_DIAGNOSTICS_SLEEP",
    "SQLTRACE_BUFFER_FLUSH", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "SQLTRACE_WAIT_ENTRIES",
    "STARTUP_DEPENDENCY_MANAGER", "WAIT_FOR_RESULTS", "WAITFOR",
    "WAITFOR_TASKSHUTDOWN", "WAIT_XTP_HOST_WAIT", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG",
    "WAIT_XTP_CKPT_CLOSE", "XE_DISPATCHER_JOIN", "XE_DISPATCHER_WAIT",
    "XE_TIMER_EVENT", "XE_LIVE_TARGET_TVF",
]

# Parameters shown by the configuration reports, in their rank order.
CONFIGURATION_LISTS = {
    "mysql": [
        "binlog_format", "character_set_server", "collation_server", "gtid_mode",
        "innodb_buffer_pool_size", "innodb_file_per_table", "log_bin", "max_connections",
        "sql_mode", "version",
    ],
    "postgres": [
        "max_connections", "shared_buffers", "effective_cache_size", "work_mem", "maintenance_work_mem",
        "wal_buffers", "checkpoint_timeout", "max_wal_size", "random_page_cost", "effective_io_concurrency",
    ],
    "postgres_memory": [
        "effective_cache_size", "huge_pages", "maintenance_work_mem", "shared_buffers", "temp_buffers",
        "wal_buffers", "work_mem",
    ],
    "postgres_archive": [
        "archive_command", "archive_mode", "archive_timeout", "max_wal_size", "min_wal_size", "wal_level",
    ],
    "oracle": [
        "db_name", "sga_target", "pga_aggregate_target", "memory_target", "processes", "sessions",
        "open_cursors", "db_block_size", "db_recovery_file_dest_size", "optimizer_mode",
    ],
    "oracle_archive": ["log_archive_dest_1", "log_archive_dest_2", "log_archive_format"],
    "sqlserver": [
        "backup compression default", "clr enabled", "contained database authentication",
        "cost threshold for parallelism", "fill factor (%)", "max degree of parallelism",
        "max server memory (mb)", "min server memory (mb)", "optimize for ad hoc workloads",
        "remote admin connections",
    ],
    "sqlserver_database": [
        "elevate_online", "elevate_resumable", "identity_cache", "legacy_cardinality_estimation",
        "lightweight_query_profiling", "maxdop", "optimize_for_ad_hoc_workloads", "parameter_sniffing",
        "paused_resumable_index_abort_duration_minutes", "query_optimizer_hotfixes",
    ],
}

# Counters of the database load profile.
LOAD_PROFILE_COUNTERS = ["DB CPU", "DB time", "execute count", "user commits", "user rollbacks"]

# Minutes covered by a named time range; a trend has TREND_BUCKETS points.
RANGE_MINUTES = {"15m": 15, "30m": 30, "1h": 60, "3h": 180, "6h": 360, "12h": 720, "24h": 1440}
RANGE_LABELS = {
    "15m": "Last 15 Minutes", "30m": "Last 30 Minutes", "1h": "Last 1 Hour", "3h": "Last 3 Hours",
    "6h": "Last 6 Hours", "12h": "Last 12 Hours", "24h": "Last 24 Hours",
}
TREND_BUCKETS = 12

# Issue texts.
ISSUE_TEXTS = {
    "IDENTIFIER_NULL": (
        "ERROR",
        "Identifier-like column contains NULL or blank values.",
        "Identifiers/keys should be fully populated. Reject or repair missing keys.",
    ),
    "LEADING_TRAILING_SPACES": (
        "WARNING",
        "String values contain leading or trailing whitespace.",
        "Trim leading and trailing whitespace from string column values.",
    ),
    "MIXED_NUMERIC_TEXT": (
        "INFO",
        "Column contains a mixture of numeric values and text strings.",
        "Standardize data format or separate mixed text and numeric entries.",
    ),
}

# Imputation methods and their reasons.
METHOD_NONE = "None (Complete)"
METHOD_MEDIAN = "Median Imputation"
METHOD_MEAN = "Mean Imputation"
METHOD_MODE = "Mode Imputation"
METHOD_CONSTANT = "Constant / Flag Imputation"
METHOD_DATE = "DATE_METHOD_SELECTION_REQUIRED"
REASON_NONE = "No missing values detected."
REASON_MEDIAN = "Skewed distribution detected (|skew|=%.2f > 1.0); median imputation is robust to outliers."
REASON_MEAN = "Symmetric numerical distribution detected; mean imputation preserves central tendency."
REASON_MODE = (
    "Categorical/Discrete column; mode imputation replaces missing values with the most frequent value."
)
REASON_CONSTANT = (
    "Missing indicator token or placeholder imputation recommended for unclassified text/date missing entries."
)
