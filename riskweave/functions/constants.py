"""Limits, patterns and vocabularies of the signal contract."""

# They must equal the published contract for results to agree.
RISK_ID_PATTERN = r"\A[0-9a-f]{64}\z"
REASON_CODE_PATTERN = r"\A[a-z][a-z0-9_]{1,39}\z"
BANK_ID_PATTERN = r"\A[A-Z][A-Z0-9-]{1,31}\z"
MODEL_VERSION_PATTERN = r"\A[A-Za-z0-9][A-Za-z0-9._+-]{0,31}\z"
# The account before upper-casing: an ASCII letter is the only one that maps into A-Z unambiguously.
ACCOUNT_PATTERN = r"\A[A-Za-z0-9-]{4,34}\z"
CURRENCY_PATTERN = r"\A[A-Z]{3}\z"
PRINTABLE_ASCII_PATTERN = r"\A[\x20-\x7E]*\z"
NON_ASCII_PATTERN = r"[^\x00-\x7F]"
# The 29 code points Unicode calls whitespace (Java's \s knows only six of them).
WHITESPACE = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Limits and defaults of the contract.
MAX_REASON_CODES = 8
MIN_TTL_HOURS = 1
MAX_TTL_HOURS = 168
DEFAULT_TTL_HOURS = 24
MAX_CLOCK_SKEW_MINUTES = 5
MIN_KEY_BYTES = 32
MAX_AMOUNT_MINOR = 10**15
MINOR_UNITS_PER_MAJOR = 100
DEFAULT_CURRENCY = "INR"
DEFAULT_MAX_ACCOUNTS = 100_000
DEFAULT_PUBLISHER_SHARE = 0.25
DEFAULT_AUDIT_CAPACITY = 10_000
# Fixed field names of a signal and of a transfer request.
SIGNAL_FIELDS = (
    "risk_id",
    "risk_score",
    "confidence",
    "reason_codes",
    "model_version",
    "source_bank_id",
    "ttl_hours",
    "timestamp",
)
TRANSFER_FIELDS = (
    "transfer_id",
    "user_ref",
    "bank_id",
    "receiver_account",
    "amount_minor",
    "currency",
)

# Outcome and status vocabularies.
ACCEPTED, STALE, EXPIRED, QUOTA_EXCEEDED = "accepted", "stale", "expired", "quota_exceeded"
FOUND, NOT_FOUND, UNAVAILABLE = "found", "not_found", "unavailable"
ALLOW, STEP_UP, BLOCK = "allow", "step_up", "block"
