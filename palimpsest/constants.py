"""Fixed values of the domain: formats, limits and thresholds."""

DELIMITER = "\n§\n"
POINTER_SIGIL = "↪"
HEADER_SENTINEL = "Long-form notes live in"

CHAR_LIMITS = {"MEMORY.md": 15000, "USER.md": 6000}
CAPACITY_WARN, CAPACITY_CRIT = 80, 90
ENTRY_TARGET, ENTRY_CEILING = 25, 35
DB_WARN_MB, DB_CRIT_MB, DB_REMEDIATE_MB = 50, 200, 30
MAX_ENTRY_CHARS, POINTER_IDEAL, DUMP_CHARS, USER_IDEAL, USER_MAX = 350, 200, 420, 420, 700
DUP_NEAR, DUP_STRONG = 0.45, 0.60
CONTRA_SUBJECT, CONTRA_POLARITY = 0.18, 0.45
SEMANTIC_PREFILTER, SEMANTIC_COSINE = 0.30, 0.85
STALE_DAYS = 30
FUZZY_MATCH = 0.6
PRUNE_DAYS, PRUNE_KEEP = 90, 10
RESTORE_LIMIT = 2000
WEIGHTS = {"durability": 0.25, "hot_memory_fit": 0.15, "freshness": 0.15, "specificity": 0.10, "recency": 0.15, "relevance": 0.20}
BUDGET, HALF_LIFE_DAYS, RESERVE_COUNT, RESERVE_MIN = 2000, 30, 3, 0.35
CHARS_PER_TOKEN, JOIN_TOKENS, VALUE_SCALE, NEUTRAL_RECENCY = 4, 1, 100_000, 0.5
RRF_K = 60
HIDDEN_SOURCES = ("subagent", "tool")
GATE_MIN_DUMP, GATE_MAX, GATE_DUP = 200, 420, 0.6
EXTRACT_MIN_TURNS, EXTRACT_MIN_CHARS, EXTRACT_TRANSCRIPT, EXTRACT_CHUNK = 2, 12, 2600, 12
SESSION_CAP, NIGHT_CAP, GROUNDING, CONTAINMENT = 5, 10, 0.34, 0.7
USAGE_JACCARD = 0.16
GATE_SAVINGS, GATE_MISSING, GATE_ANSWERS, GATE_DAEMON, GATE_SUBPROCESS, GATE_P95 = 40, 0.10, 5, 0.95, 0, 500
LANE_WEIGHTS = {"intent": 2, "topic": 3, "availability": 1, "feedback": 1}
FEEDBACK_DECAY_DAYS, FEEDBACK_WINDOW_DAYS, FEEDBACK_MIN_EVENTS, FEEDBACK_MIN_ANSWERS = 7, 14, 3, 5
DORMANT_DAYS, PROTECT_DAYS = 14, 2
POINTER_MAX, SUMMARY_MAX = 240, 150
