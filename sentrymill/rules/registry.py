"""Source registry.

Fixed values: names, classes and kinds decide weights, trust and routing and
have to equal the published registry.
"""

# -- fixed values: (name, label, class, kind, ingest type, url, tier, trusted alone, active)
SOURCES = [
    ("the-record-cybercrime", "The Record", "incident_news", "incident", "rss",
     "https://therecord.media/news/cybercrime/feed", "core", False, True),
    ("bleepingcomputer", "BleepingComputer", "incident_news", "incident", "rss",
     "https://www.bleepingcomputer.com/feed/", "core", False, True),
    ("krebsonsecurity", "Krebs on Security", "incident_news", "incident", "rss",
     "https://krebsonsecurity.com/feed/", "curated", True, True),
    ("the-hacker-news", "The Hacker News", "incident_news", "incident", "rss",
     "https://feeds.feedburner.com/TheHackersNews", "core", False, True),
    ("ncsc-uk", "NCSC", "official_alert", "incident", "rss",
     "https://www.ncsc.gov.uk/api/1/services/v1/news-rss-feed.xml", "curated", True, True),
    ("cisa-alerts-advisories", "CISA Advisories", "official_alert", "activity", "rss",
     "https://www.cisa.gov/cybersecurity-advisories/all.xml", "curated", False, True),
    ("cisa-kev", "CISA KEV", "exploited_vulnerability", "activity", "json",
     "https://www.cisa.gov/sites/default/files/feeds/known_exploited_vulnerabilities.json",
     "curated", False, True),
    ("sec-edgar-cyber-8k", "SEC EDGAR", "primary_disclosure", "incident", "sec_edgar_cyber",
     "https://efts.sec.gov/LATEST/search-index?q=%22material+cybersecurity+incident%22&forms=8-K",
     "official", True, True),
]
FILING_SOURCE = "sec-edgar-cyber-8k"
CATALOGUE_SOURCE = "cisa-kev"
ADVISORY_SOURCE = "cisa-alerts-advisories"

# -- fixed values: domains accepted for submitted pages ------------------------
DOMAIN_TO_SOURCE = {
    "bleepingcomputer.com": "bleepingcomputer",
    "krebsonsecurity.com": "krebsonsecurity",
    "therecord.media": "the-record-cybercrime",
    "thehackernews.com": "the-hacker-news",
    "ncsc.gov.uk": "ncsc-uk",
}

# -- fixed values: limits ------------------------------------------------------
MAX_AGE_DAYS = 90
FILING_MAX_BYTES = 750_000
BODY_MAX_CHARS = 5_000
BODY_MIN_CHARS = 100
THIN_CONTENT_CHARS = 300
SUBMITTED_SUMMARY_CHARS = 500

# -- fixed values: publisher labels of the structured feeds -------------------
CATALOGUE_PUBLISHER = "CISA Known Exploited Vulnerabilities"
FILING_PUBLISHER = "SEC EDGAR (8-K cyber disclosures)"

# -- fixed values: filings -----------------------------------------------------
FILING_ITEM = "1.05"
FILING_CLOSING = ("Direct primary-source disclosure from the affected company "
                  "under SEC reporting rules.")
FILING_TEMPLATE_MARK = "Filed in a statement to investors."
US_STATE_CODES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN",
    "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV",
    "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN",
    "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR",
]
US_HINT = "Filer is based in the United States."
INDUSTRY_HINT = {
    "Technology": "Filer is a technology company.",
    "Healthcare": "Filer is a healthcare provider.",
    "Financial Services": "Filer is a financial services company.",
    "Education": "Filer is an education provider.",
    "Government": "Filer is a government agency.",
    "Energy": "Filer is an energy company.",
    "Transportation": "Filer is a transportation and logistics company.",
    "Media": "Filer is a media company.",
}
# (industry, inclusive ranges, single codes), first match wins
SIC_RULES = [
    ("Technology", [(7370, 7379), (4810, 4829)], [3576, 3577, 3578, 3669, 3674, 3825, 3827]),
    ("Financial Services", [(6000, 6799)], []),
    ("Healthcare", [(8000, 8099), (2830, 2839)], []),
    ("Education", [(8200, 8299)], []),
    ("Government", [(9100, 9999)], []),
    ("Energy", [(1300, 1389), (4900, 4999)], []),
    ("Transportation", [(4000, 4789)], [3711, 3713, 3714, 3715]),
    ("Media", [(2700, 2799), (4830, 4899)], []),
]
DISCLOSURE_SECTION = (
    r"Item\s*1\.05[\.\s]*Material\s+Cybersecurity\s+Incidents?[\.\s]*(.+?)"
    r"(?=Item\s+\d+\.\d+\b|SIGNATURES?\b|\bPursuant to the requirements\b)"
)
DISCLOSURE_TERMS = (
    r"\b(cyber|cybersecurity|unauthorized\s+access|data\s+breach|ransomware"
    r"|threat\s+actor|incident|exfiltrat)\b"
)
KEEP_UPPER = ["LLC", "PLC", "GMBH", "USA", "UK", "EU", "II", "III", "IV", "VI"]
TITLE_CASE = ["INC", "CORP", "LTD", "CO", "COMPANY", "CORPORATION"]
