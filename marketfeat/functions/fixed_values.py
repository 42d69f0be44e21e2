"""The lookup tables that decide results. Larger rule sets are parameters, see ``rules.RuleTable``."""

from __future__ import annotations

from marketfeat.functions.rules import AnnouncementRules

# Raw label to standard category.
CATEGORY_MAP = {
    "macro": "macro",
    "fiscal": "macro",
    "monetary": "macro",
    "market_political": "macro",
    "general_market": "macro",
    "general": "macro",
    "rates": "macro",
    "economy": "macro",
    "corporates": "corporate",
    "equities": "corporate",
    "stocks": "corporate",
    "corporate": "corporate",
    "equity": "corporate",
    "company_analysis": "corporate",
    "technical": "corporate",
    "analyst_briefing": "corporate",
    "stock_picks": "corporate",
    "press_release": "corporate",
    "native": "corporate",
    "mg_opinion": "corporate",
    "energy": "energy",
    "commodities": "energy",
    "forex": "forex",
    "exchange": "forex",
    "banking": "banking",
}

# Tickers of each category.
CATEGORY_TICKERS = {
    "banking": ("BAFL", "HBL", "MCB", "NBP", "UBL"),
    "energy": ("HUBC", "KAPCO", "MARI", "OGDC", "POL", "PPL", "PSO"),
    "macro": ("DGKC", "EFERT", "FATIMA", "FFC", "LUCK", "MLCF", "PIOC"),
    "forex": ("AVN", "GATM", "NCL", "NML", "SYS", "TRG"),
    "corporate": ("ENGRO", "FEROZ", "INDU", "PSMC", "SEARL"),
}

# Which source wins when several carry the same title on one day; others come last.
SOURCE_PRIORITY = {"brecorder": 0, "dawn": 1, "mettis": 2}
LAST_PRIORITY = 99

# Source whose label is the subcategory when there is one.
CATEGORY_COLUMNS = {"mettis": ("subcategory", "category")}

# Announcement types by code; type E is fetched once for the whole market.
ANNOUNCEMENT_TYPES = {
    "C": "Companies Announcements",
    "E": "PSX Notices",
    "D": "Dividends",
    "B": "Book Closure",
    "A": "AGM/EGM",
    "R": "Rights",
    "T": "Takeover/Acquisitions",
}
MARKET_TYPE = "E"

# What marks an announcement cell as junk, as a time, or as a bare company name.
ANNOUNCEMENT_RULES = AnnouncementRules(
    junk=("VIEW PDF", "VIEW   PDF", "VIEW", "PDF", ""),
    time=r"^\d{1,2}:\d{2}\s*(AM|PM)$",
    company_suffixes=(
        "Limited", "Bank", "Company", "Mills", "Factory", "Corporation", "Industries",
        "Pakistan", "Energy", "Energies", "Cement", "Petroleum", "Chemicals", "Textiles?",
        "Securities", "Capital", "Investments?", "Modaraba", "Insurance", "Leasing",
        "Fertilizer", "Fertilizers",
    ),
    keywords=(
        "dividend", "announce", "result", "profit", "loss", "agm", "egm", "merger",
        "acquisition", "rights", "bonus", "notice", "suspension", "listing", "meeting",
        "financial", "quarterly", "annual", "half.year", "interim", "book.closure",
        "placement", "unusual", "movement", "issuance", "change", "de-?list",
        "resumption", "adjustment", "recomposition", "rebalancing",
    ),
)
YEARS = (2010, 2026)

# Sections of the JSON feed; the last rule set rejects world news.
FEED_SECTIONS = (
    "economy", "equity", "forex", "company_analysis", "technical", "mg_opinion",
    "global_business", "native", "press_release", "analyst_briefing", "stock_picks",
)
REJECTED_FEEDS = ("global_business",)

# Article addresses of the two sites, and an article pinned to every page of one of them.
ARTICLE_PATTERNS = {"brecorder": r"brecorder\.com/news/\d+", "dawn": r"dawn\.com/news/(\d+)"}
PINNED_IDS = {"dawn": ("1984584",)}
