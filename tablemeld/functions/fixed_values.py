"""Lookup tables, thresholds and word lists that define the results."""

# Region spellings -> region code
REGION_CODES = {
    "ny": "US-NY", "new york": "US-NY", "n.y.": "US-NY", "newyork": "US-NY",
    "ca": "US-CA", "california": "US-CA", "calif": "US-CA",
    "tx": "US-TX", "texas": "US-TX",
    "fl": "US-FL", "florida": "US-FL",
    "uk": "GB", "united kingdom": "GB", "england": "GB", "britain": "GB",
    "de": "DE", "germany": "DE", "deutschland": "DE",
    "fr": "FR", "france": "FR",
    "north": "NORTH", "south": "SOUTH", "east": "EAST", "west": "WEST",
    "northeast": "NORTHEAST", "northwest": "NORTHWEST",
    "southeast": "SOUTHEAST", "southwest": "SOUTHWEST",
    "central": "CENTRAL", "midwest": "MIDWEST",
    "apac": "APAC", "asia pacific": "APAC", "asia-pacific": "APAC",
    "emea": "EMEA", "latam": "LATAM", "na": "NA", "north america": "NA",
}

# Country spellings -> ISO 3166 alpha-2
COUNTRY_CODES = {
    "united states": "US", "usa": "US", "u.s.a.": "US", "u.s.": "US", "america": "US",
    "united kingdom": "GB", "uk": "GB", "great britain": "GB", "england": "GB",
    "germany": "DE", "deutschland": "DE",
    "france": "FR", "french": "FR",
    "spain": "ES", "españa": "ES",
    "italy": "IT", "italia": "IT",
    "japan": "JP", "nippon": "JP",
    "china": "CN", "prc": "CN",
    "india": "IN", "bharat": "IN",
    "brazil": "BR", "brasil": "BR",
    "canada": "CA",
    "australia": "AU", "aus": "AU",
    "mexico": "MX", "méxico": "MX",
    "netherlands": "NL", "holland": "NL",
    "switzerland": "CH", "suisse": "CH",
    "civ": "CI", "ivory coast": "CI", "cote divoire": "CI",
}

# Channel, product and status spellings -> category code
CATEGORY_CODES = {
    "online": "ONLINE", "web": "ONLINE", "ecommerce": "ONLINE", "digital": "ONLINE",
    "retail": "RETAIL", "store": "RETAIL", "shop": "RETAIL", "brick and mortar": "RETAIL",
    "mobile": "MOBILE", "app": "MOBILE",
    "social": "SOCIAL", "facebook": "SOCIAL", "instagram": "SOCIAL",
    "cigarettes": "CIGARETTES", "cig": "CIGARETTES",
    "heated tobacco": "HTU", "htu": "HTU", "iqos": "HTU",
    "vape": "VAPE", "e-cigarette": "VAPE", "ecig": "VAPE",
    "oral": "ORAL", "snus": "ORAL",
    "active": "ACTIVE", "a": "ACTIVE", "1": "ACTIVE",
    "inactive": "INACTIVE", "i": "INACTIVE", "0": "INACTIVE",
    "pending": "PENDING", "p": "PENDING",
}

# Age band spellings -> age band
AGE_BANDS = {
    "18-24": "18-24", "18_24": "18-24", "18 to 24": "18-24", "18-25": "18-24",
    "25-34": "25-34", "25_34": "25-34", "25 to 34": "25-34",
    "35-44": "35-44", "35_44": "35-44", "35 to 44": "35-44",
    "45-54": "45-54", "45_54": "45-54", "45 to 54": "45-54",
    "55+": "55+", "55 plus": "55+", "56-65": "55+", "65+": "55+",
    "under 18": "<18", "<18": "<18",
}

# Market spellings -> market name
MARKET_NAMES = {
    "US": "USA", "USA": "USA", "UNITED STATES": "USA",
    "UK": "UK", "UNITED KINGDOM": "UK", "GB": "UK",
    "DE": "Germany", "GERMANY": "Germany",
    "FR": "France", "FRANCE": "France",
    "ES": "Spain", "SPAIN": "Spain",
    "IT": "Italy", "ITALY": "Italy",
    "NL": "Netherlands", "NETHERLANDS": "Netherlands",
    "BE": "Belgium", "BELGIUM": "Belgium",
    "JP": "Japan", "JAPAN": "Japan",
    "AU": "Australia", "AUSTRALIA": "Australia",
    "CA": "Canada", "CANADA": "Canada",
    "BR": "Brazil", "BRAZIL": "Brazil",
    "IN": "India", "INDIA": "India",
    "CN": "China", "CHINA": "China",
}

# Default value maps per column name
DEFAULT_VALUE_MAPS = {
    "age": AGE_BANDS,
    "age_group": AGE_BANDS,
    "market": MARKET_NAMES,
    "country": MARKET_NAMES,
}

# Name fragments that mark a column's role
REGION_WORDS = ("region", "geo", "state", "area", "territory", "location")
COUNTRY_WORDS = ("country", "nation", "market", "civ", "cntry")
DATE_WORDS = ("date", "time", "dt", "period")
CATEGORY_WORDS = ("category", "channel", "type", "segment", "status", "cat", "product")

# Candidate columns, in order of preference
RECORD_ID_COLUMNS = ("record_id", "respondent_id", "id", "case_id")
CALIBRATION_GROUP_COLUMNS = (
    "market", "country", "region", "vendor", "source_vendor", "supplier", "wave", "date",
)
MARKET_COLUMNS = ("market", "country", "region")

# Date patterns, in order of detection
DATE_PATTERNS = (
    "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy-M-d H:m:s", "d-M-yyyy", "yyyyMMdd",
)

# Response-scale bands of descriptive statistics, in order
SCALE_BANDS = (("0-1", 0.0, 1.0), ("1-5", 1.0, 5.0), ("0-10", 0.0, 10.0), ("0-100", 0.0, 100.0))

# Response-scale bands of mixed-scale detection, in order
MIXED_BANDS = (("0_1", 0.0, 1.05), ("1_5", 1.0, 5.05), ("0_10", 0.0, 10.05), ("0_100", 0.0, 100.05))
MIXED_BAND_SHARE = 0.15
PERCENTILE_SPREAD = 0.7

# Quality thresholds
BLOCKING_MISSING_PCT = 50.0
FIXABLE_MISSING_PCT = 20.0
DUPLICATE_BLOCKING_PCT = 5.0
DUPLICATE_FIXABLE_PCT = 1.0
MIN_SAMPLE_ROWS = 30
OUTLIER_STD = 3.0
ACCEPTABLE_SCORE = 60.0

# Confidence and similarity thresholds
REVIEW_BELOW = 0.8
VALID_SCHEMA_CONFIDENCE = 0.80
MEMORY_SIMILARITY = 0.75
LEARN_CONFIDENCE = 0.8
CONFIRMED_CONFIDENCE = 0.95
CALIBRATION_MIN_ROWS = 5

# Strategy codes -> strategy labels
STRATEGY_LABELS = {
    "mean": "Replace with MEAN",
    "median": "Replace with MEDIAN",
    "zero": "Replace with 0",
    "mode": "Replace with MODE",
    "unknown": "Replace with 'Unknown'",
    "other": "Replace with 'Other'",
    "remove": "Remove rows",
    "keep": "Keep missing",
    "drop": "Drop column",
}
