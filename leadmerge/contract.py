"""Fixed values of the lead data contract.

Everything here is data, not logic: source names, spreadsheet headers, status
names and keyword lists that must be spelled exactly like this for results to
agree with existing data. All operators take these as arguments and only use
them as defaults.
"""

# --- fixed values: source names ------------------------------------------------
BASE_SOURCE = "NFULL"
SECONDARY_SOURCE = "MFULL"
SOURCES = (BASE_SOURCE, SECONDARY_SOURCE)
BOTH = "BOTH"

# --- fixed values: the nine display headers, in output order --------------------
DISPLAY_HEADERS = (
    "Lead Statement",
    "Timestamp",
    "Company Name",
    "Phone Number",
    "Address 1 (Road/Street/Lane/Park/Industrial Estate)",
    "Address 2 (Village/Town/City)",
    "Phone 2",
    "Post Code (Please Put The Full Postcode, Example: CH41 5LH)",
    "Lead Proof URL",
)

# --- fixed values: accepted header spellings per field, first match wins --------
ALIASES = {
    "timestamp": ("Timestamp",),
    "business_name": ("Company Name",),
    "phone": ("Phone Number", "Primary Contact"),
    "phone2": ("Phone 2", "Secondary Contact"),
    "phone3": ("Phone 3",),
    "url": ("Lead Proof URL",),
    "message": ("Lead Statement", "Business Note"),
    "postcode": (
        "Post Code (Please Put The Full Postcode, Example: CH41 5LH)",
        "Post Code",
        "Postal Code",
    ),
    "town": (
        "Address 2 (Village/Town/City)",
        "Address 2 (Town or City)",
        "Address 2",
    ),
    "address1": (
        "Address 1 (Road/Street/Lane/Park/Industrial Estate)",
        "Address 1 (Road or Street)",
        "Address 1",
    ),
    "county": ("County",),
    "email": ('Email Address ("." if None)', "Email Address", "Email"),
    "industry": ("Industry Type", "Business Type"),
    "old_address": (
        "Old Address? (For relocation, new branch, and moving premises only"
        " with no given address)",
        "Old Address",
    ),
    "posting_date": ("Lead Posting Date",),
}

# --- fixed values: canonical lead columns, in order -----------------------------
CANONICAL_COLUMNS = (
    "source", "source_record_id", "dedup_key", "match_key", "post_id", "url",
    "owner_name", "message", "post_timestamp", "scrape_timestamp",
    "business_name", "phone", "phone2", "email", "postcode", "address1",
    "location", "norm_permalink", "norm_phone", "raw_payload",
)

# --- fixed values: URL rules ----------------------------------------------------
CONTENT_PARAMS = ("story_fbid", "id", "fbid", "v")
SHORT_LINK_HOSTS = ("fb.watch", "fb.me")
HOST_SUFFIXES = (("facebook.com", "www.facebook.com"), ("fb.com", "www.facebook.com"))
POST_TOKEN = r"(?i)pfbid[0-9A-Za-z]+"
POST_ID_PATTERNS = (
    r"(?i)/posts/(\d+)",
    r"(?i)/permalink/(\d+)",
    r"(?i)/videos/(\d+)",
    r"(?i)/reel/(\d+)",
    r"(?i)[?&]story_fbid=(\d+)",
    r"(?i)[?&]fbid=(\d+)",
    r"(?i)[?&]v=(\d+)",
    r"(?i)/photos/[^/]+/(\d+)",
)

# --- fixed values: words dropped from a business key ----------------------------
BUSINESS_STOPWORDS = (
    "ltd", "limited", "llp", "llc", "plc", "inc", "co", "company", "the", "and",
)

# --- fixed values: advisory keyword flags, in declared order ----------------------
SIGNAL_KEYWORDS = {
    "education": (
        "school", "academy", "nursery", "tutoring", "training centre",
        "training center", "college",
    ),
    "non_commercial": ("church", "charity", "mosque", "temple", "fundraiser"),
    "banned_location": (
        "ireland", "northern ireland", "guernsey", "jersey", "isle of man",
    ),
    "minor_update": (
        "new menu", "new items", "new pricelist", "new price list", "renovated",
        "refurbished", "new decor", "new staff",
    ),
}
EXCLUDING_FLAGS = ("education", "non_commercial", "banned_location", "minor_update")

# --- fixed values: statuses, versions, thresholds and texts ------------------------
JOB_ACTIVE = ("PENDING", "PROCESSING", "RETRY")
JOB_CLAIMABLE = ("PENDING", "RETRY")
LEAD_PENDING = ("INGESTED", "READY_FOR_VALIDATION", "VALIDATING")
RULES_VERSION = "1.1.0"
PROMPT_VERSION = "validator-remote"
APPROVE_MIN = 75
REVIEW_MIN = 50
FRESHNESS_HOURS = 24
MAX_ATTEMPTS = 4
RETRY_BASE_MINUTES = 5
ERROR_TEXT_LIMIT = 500
ERROR_SAMPLES = 5
PAGE_SIZE_DEFAULT = 100
PAGE_SIZE_MAX = 500
RUNS_LIMIT_DEFAULT = 50
RUNS_LIMIT_MAX = 200
CLAIM_LIMIT_DEFAULT = 10
EXAMPLES_LIMIT = 10
DISAGREEMENT_TEXT = (
    "Deterministic rules flagged excluded signals; routed to manual review."
)
RED_FLAG_PREFIX = "⚠ "
REJECT_PREFIX = "Deterministic reject: "
