"""Fixed values of the event contract and the default operating limits."""

# The event types, which are also the default funnel, in funnel order.
EVENT_TYPES = ("view", "search", "add_to_cart", "order")
FUNNEL_STEPS = EVENT_TYPES

# Role names.
ROLE_NAMES = ("admin", "analyst", "client_app")

# Column limits of the event table.
SESSION_ID_MAX = 64
EVENT_TYPE_MAX = 32
IP_HASH_MAX = 64

# Ingest limits.
BATCH_MIN_EVENTS = 1
BATCH_MAX_EVENTS = 100
MAX_BODY_BYTES = 256 * 1024
CLAIM_TTL_SECONDS = 86_400

# Message reliability.
READ_BATCH = 100
CLAIM_MIN_IDLE_MS = 60_000
MAX_DELIVERIES = 5
STREAM_KEEP = 1_000_000
DEAD_LETTER_KEEP = 100_000

# Names shown in queue statistics.
STREAM_NAME = "stream:events"
GROUP_NAME = "cg:event-writers"

# Request quotas, per scope and window.
QUOTA_WINDOW_SECONDS = 60
QUOTA_LIMITS = {"ip": 120, "user": 300, "events": 600}

# Cache lifetimes in seconds.
CACHE_TTL = {"dau": 300, "funnel": 300, "retention": 600, "realtime": 30}

# Upper bounds of the request latency buckets, in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)

# Housekeeping.
EXPIRED_KEY_GRACE_HOURS = 48
SKETCH_TTL_DAYS = 3

# 2**14 registers keep the standard error of a distinct count near 0.8 %.
HLL_LG_K = 14
