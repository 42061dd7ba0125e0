"""Rule tables for organisation names, victims and anchors.

Fixed values: word lists and patterns have to equal the published rule set.
"""

# -- fixed values: characters stripped from both ends of a name ----------------
EDGE_CHARS = " -,:;\"'[]{}“”‘’"

# -- fixed values: name cleaning ------------------------------------------------
SENTENCE_STARTERS = ["The", "A", "An", "This", "These", "Those", "It", "They", "He", "She", "We", "Its"]
CLAUSE_BOUNDARY = [
    "affects?", "affected", "impacting", "impacts?", "hits?", "hit", "after", "via",
    "through", "using", "on", r"linked\s+to", "with", "in", "as", "amid", "following",
    "from", "that", "which", "where", "when", r"according\s+to", "said", "says",
    "confirmed", "confirms", "reported", "reportedly",
]
CATEGORY_PREFIX = [
    "company", "organization", "firm", "vendor", "provider", "developer", "publisher",
    "operator", "platform", "exchange", "chain", "group", "maker", "giant",
]
TRAILING_LOWER = (
    r"^([A-Z][A-Za-z0-9&._-]*(?:\s+[A-Z][A-Za-z0-9&._-]*){0,3})"
    r"\s+[a-z][a-z0-9&._-]*(?:\s+[a-z][a-z0-9&._-]*)*$"
)
BLOCKED_NAMES = [
    "data", "breach", "hack", "attack", "ransomware", "cyberattack", "cyber", "accounts",
    "users", "customers", "employees", "systems", "platform", "suite", "plugin",
    "plugins", "report", "reports", "analysis", "hackers", "threat actors",
    "official website", "download links", "new", "official", "multiple", "several",
    "hundreds", "thousands", "millions", "they", "he", "she", "it", "we", "them", "their",
    "popular", "major", "widely", "commonly", "newly", "recently", "legitimate",
    "notorious", "local", "regional", "global", "international", "federal", "state",
    "municipal", "public", "government", "unnamed", "unknown", "cybersecurity",
    "security", "technology", "tech", "software", "cloud", "digital", "online",
    "internet", "financial", "healthcare", "medical", "pharmaceutical", "managed",
]
NAME_MIN_CHARS = 3
NAME_MAX_WORDS = 6

# -- fixed values: plausibility --------------------------------------------------
ACTION_WORDS = [
    "affects", "affected", "breached", "hacked", "hit", "targeted", "attacked", "exposed",
    "leaked", "stolen", "pushed", "push", "infected", "compromised", "extorted",
    "disrupted", "running", "using",
]
GENERIC_TAIL_WORDS = [
    "suite", "plugin", "plugins", "package", "packages", "tool", "tools", "system",
    "systems", "platform", "platforms", "app", "apps", "application", "applications",
    "sites", "website", "websites", "accounts", "users", "customers", "data", "records",
]
BAD_FIRST_WORDS = [
    "defending", "targeting", "exploiting", "using", "abusing", "protecting", "securing",
    "warning", "alerting", "exposing", "bypassing", "hijacking", "stealing", "deploying",
    "tracking", "fake", "false", "executive", "summary", "advisory",
]

# -- fixed values: generic descriptors -------------------------------------------
GENERIC_TERMINAL_WORDS = [
    "agency", "bank", "company", "cybersecurity", "firm", "government", "group",
    "hospital", "ministry", "organization", "organisation", "provider", "school",
    "service", "university", "vendor",
]
DESCRIPTOR_PREFIXES = [
    "cybersecurity", "security", "technology", "tech", "software", "it", "cloud",
    "digital", "online", "internet", "financial", "healthcare", "medical",
    "pharmaceutical", "managed", "local", "regional", "global", "international",
    "federal", "state", "municipal", "public", "government", "unnamed", "unknown", "a",
    "an",
]

# -- fixed values: legal forms dropped from the cluster key ----------------------
LEGAL_FORMS = [
    "inc", "llc", "ltd", "corp", "corporation", "company", "co", "group", "plc", "sa",
    "ag", "gmbh", "nv", "bv", "services", "solutions", "systems", "holdings",
    "enterprises", "international", "technologies",
]

# -- fixed values: candidate filters ----------------------------------------------
AUDIENCE_TAIL = (
    r"\b(?:users?|customers?|citizens?|people|visitors?|clients?|residents?|nationals?"
    r"|workers?|members?|subscribers?|patients?|students?|employees?|consumers?|tenants?"
    r"|guests?|riders?|shoppers?|viewers?|readers?|listeners?)\s*$"
)
BLOCKED_ACTION = (
    r"\bto\s+(?:steal|deploy|push|harvest|leak|breach|hack|target|attack|compromise"
    r"|disrupt|extort)\b"
)
ACTOR_NOUNS = [
    "hackers", "researchers", "attackers", "cybercriminals", "criminals", "nation-state",
    "adversaries", "scammers",
]
CONTENT_SCAN_CHARS = 2000

_ORG = r"([A-Z][A-Za-z0-9._-]+(?:\s+[A-Z][A-Za-z0-9._-]*){0,2})"
_ORG_LONG = r"([A-Z][A-Za-z0-9._-]{3,}(?:\s+[A-Z][A-Za-z0-9._-]*){0,2})"
_ORG_AMP = r"([A-Z][A-Za-z0-9&._'-]*(?:\s+[A-Z][A-Za-z0-9&._'-]*){0,3})"
_OWNED = (r"(?:platform|service|software|system|product|application|app|tool|portal|website"
          r"|network|infrastructure|database|plugin|suite|suite of tools)")
_HARM = r"(?:ransomware attack|cyberattack|cyber attack|data breach|security breach)"

# -- fixed values: victim patterns -------------------------------------------------
# (name, pattern, anchors).  The pattern is matched ignoring case; group 1 is the
# candidate.  Anchors are lower-case substrings of which at least one occurs in every
# text the pattern can match: they let a row skip patterns that cannot fire.
_CREATED_BY = ("created-by",
               r"\b(?:created by|developed by|owned by|operated by|provided by|made by)\s+" + _ORG + r"\b",
               ["ed by", "made by"])
_MAKER_OF = ("maker-of", r"\b" + _ORG + r",?\s+(?:maker|developer|creator|provider|vendor)\s+of\b",
             ["maker", "developer", "creator", "provider", "vendor"])
_PARENT_FIRM = ("parent-firm",
                r"\bparent\s+(?:firm|company|organization|corp|corporation)\s+" + _ORG + r"\b",
                ["parent"])
_POSSESSIVE = ("possessive-product", r"\b" + _ORG + r"'s\s+" + _OWNED + r"\b", ["'s"])
BODY_PATTERNS = [
    _CREATED_BY,
    _MAKER_OF,
    _PARENT_FIRM,
    _POSSESSIVE,
    ("subsidiary", r"\b([^,.;:]+?),\s+a\s+(?:wholly\s+)?owned\s+subsidiary\s+of\b", ["subsidiary"]),
]
HEADLINE_PATTERNS = [
    ("disclosure-verb",
     r"^\s*([^,.;:]+?)\s+(?:confirms|confirmed|discloses|disclosed|acknowledges|acknowledged|admits"
     r"|admitted|warns|reported|notified)\b",
     ["confirm", "disclose", "acknowledge", "admit", "warns", "reported", "notified"]),
    ("resolution",
     r"^\s*" + _ORG + r"\s+(?:reaches?|reached)\s+(?:\S+\s+){0,2}(?:agreement|deal|settlement)\b.*\s+with\b",
     ["reach"]),
    ("pays-ransom", r"^\s*" + _ORG + r"\s+(?:pays?|paid)\s+ransom\b", ["ransom"]),
    ("fined",
     r"\bfined\s+([A-Z][A-Za-z0-9._-]+(?:\s+[A-Z][A-Za-z0-9._-]*){0,3})\s+[£$€¥]", ["fined"]),
    ("site-hacked",
     r"^" + _ORG + r"\s+(?:site|system|network|server|database|website|download manager|repository)"
     r"\s+(?:hacked|breached|hijacked)(?:\s+to\b|\s+by\b|\s+in\b|\s*$)",
     ["hacked", "breached", "hijacked"]),
    ("package-compromised",
     r"^(?:[Oo]fficial\s+)?([A-Z][A-Za-z0-9._-]+(?:\s+[A-Z][A-Za-z0-9._-]*){0,1})\s+\w+\s+"
     r"(?:package|plugin|library|module|extension)\s+(?:compromised|backdoored|tampered|poisoned|hacked)\b",
     ["package", "plugin", "library", "module", "extension"]),
    _CREATED_BY,
    _MAKER_OF,
    _PARENT_FIRM,
    _POSSESSIVE,
    ("x-breach", r"^\s*" + _ORG_LONG + r"\s+(?:source code|data|systems?|network)\s+breach\b", ["breach"]),
    ("breach-disrupts",
     r"^\s*" + _ORG_LONG + r"\s+[Bb]reach\s+(?:[Dd]isrupt|[Ee]xpose|[Hh]it|[Ff]orce|[Ss]hut|[Kk]nock)\w*\b",
     ["breach"]),
    ("breach-at",
     r"\b(?:breach|hack|attack|cyberattack|cyber attack|data theft)\s+at\s+(?:[a-z][a-z0-9&._' -]*\s+){0,5}"
     + _ORG_AMP + r"\b",
     ["breach", "hack", "attack", "theft"]),
    ("hacker-claims", r"\b" + _ORG_AMP + r"\s+hacker\s+claims\s+data\s+theft\b", ["theft"]),
    ("attack-on",
     r"\b(?:breach|hack|attack|cyberattack|cyber attack|ransomware attack)\s+(?:at|on|against|of)\s+([^,.;:]+)",
     ["breach", "hack", "attack"]),
    ("attack-affecting",
     r"\b(?:breach|attack|cyberattack|cyber attack|ransomware attack)\s+affecting\s+(?:the\s+)?([^,.;:]+)",
     ["affecting"]),
    ("reports-breach-of",
     r"\b(?:confirms|confirmed|reports|reported|discloses|disclosed)\s+(?:a\s+)?(?:data\s+)?breach\s+(?:at|of)\s+([^,.;:]+)",
     ["breach"]),
    ("confirms-incident",
     r"\b([A-Z][A-Za-z0-9&._' -]{1,80}?)\s+(?:confirms|confirmed|acknowledges|acknowledged)\s+(?:the\s+)?"
     r"(?:incident|cyberattack|cyber attack|attack|breach)\b",
     ["confirm", "acknowledge"]),
    ("was-breached",
     r"\b([^,.;:]+?)\s+(?:was|were|has been|have been)\s+"
     r"(?:breached|hacked|attacked|targeted|compromised|disrupted|extorted)\b",
     ["breached", "hacked", "attacked", "targeted", "compromised", "disrupted", "extorted"]),
    ("confirms-breach",
     r"\b([^,.;:]+?)\s+(?:confirms|confirmed|reports|reported|discloses|disclosed)\s+(?:a\s+)?(?:data\s+)?breach\b",
     ["breach"]),
    ("hit-by",
     r"\b([^,.;:]+?)\s+(?:was\s+|were\s+)?(?:hit by|suffered|suffers)\s+(?:a\s+)?" + _HARM + r"\b",
     ["hit by", "suffer"]),
    ("fell-victim", r"\b([^,.;:]+?)\s+(?:falls victim to|fell victim to)\s+(?:a\s+)?" + _HARM + r"\b",
     ["victim to"]),
    ("hit-by-ransomware", r"^(.+?)\s+(?:was\s+)?hit\s+by\s+(?:a\s+)?ransomware\s+attack\b", ["ransomware"]),
    ("recovery",
     r"^\s*([^,.;:]+?)\s+(?:fully\s+)?(?:operational|restored|back\s+online|back\s+up|recovers?|recovered"
     r"|resuming?|resumed?)\s+after\b",
     ["operational", "restored", "back", "recover", "resum"]),
]
# Title forms that name the victim outright; first usable one wins.
TITLE_FORMS = [
    ("in-supply-chain", r"\bin\s+" + _ORG + r"\s+supply[\s-]chain\s+attack\b", ["supply"]),
    ("supply-chain-subject", r"^" + _ORG + r"\s+supply[\s-]chain\s+attack\b", ["supply"]),
    ("confirms-x-breach",
     r"\bconfirms?\s+([A-Z][A-Za-z0-9._-]+(?:\s+(?!(?:data|breach)\b)[A-Z][A-Za-z0-9._-]*){0,2})"
     r"\s+(?:data\s+)?breach\b",
     ["confirm"]),
]

# -- fixed values: anchors -----------------------------------------------------------
CVE_ID = r"\b(CVE-\d{4}-\d+)\b"
INCIDENT_PHRASES = [
    r"^(.+?)\s+(?:heaped|enabled|launched|conducted|carried out|fueled)\s+attacks?\b",
    r"^(.+?)\s+(?:hit|hits|targeted|attacked|breached|compromised)\b",
]
CAMPAIGN_PHRASES = [
    r"\bin\s+['\"]?([^'\"]+?)['\"]?\s+ransomware\s+attacks?\b",
    r"\b([^,.;:]+?)\s+campaign\b",
]
PRODUCT_PHRASES = [
    r"\b(?:flaw|vulnerability|bug)\s+in\s+([^,.;:]+)",
    r"\b([^,.;:]+?)\s+(?:flaw|vulnerability|bug)\b",
    r"\b([^,.;:]+?)\s+(?:zero-day|0-day)\b",
]
FLAW_SUBJECTS = [  # case-sensitive
    r"^(?:Critical|High-severity|High severity|Severe|New)\s+"
    r"([A-Z][A-Za-z0-9._-]*(?:\s+[A-Z][A-Za-z0-9._-]*){0,2})\s+.*\bflaw\b",
    r"^([A-Z][A-Za-z0-9._-]*(?:\s+[A-Z][A-Za-z0-9._-]*){0,2})\s+.*\bflaw\b",
]
ANCHOR_BLOCKED = [
    "critical", "high-severity", "new", "severe", "flaw", "vulnerability", "bug",
    "attack", "attacks", "campaign", "ransomware", "malware",
]
ANCHOR_ACTOR_WORDS = [
    "official", "hackers", "researchers", "attackers", "threat", "criminals", "adversaries",
]
ANCHOR_MIN_CHARS = 2
ANCHOR_MAX_CHARS = 120
VENDOR_STOP_WORDS = [
    "multiple", "improper", "missing", "insufficient", "incorrect", "arbitrary",
    "cross-site", "remote", "local", "server-side",
]
ANCHOR_TYPES = ["organization", "product_or_platform", "vulnerability", "campaign", "actor", "unknown"]

# -- fixed values: words after which a full stop does not end a sentence ----------------
ABBREVIATIONS = [
    "dr", "mr", "mrs", "ms", "st", "vs", "no", "inc", "corp", "ltd", "co", "dept", "govt",
    "fig", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "ave", "blvd", "est", "approx", "prof", "gen", "rep", "sen", "sgt", "capt", "lt",
    "col", "maj",
]

# -- fixed values: headings that are not victims -----------------------------------------
HEADING_PREFIXES = [
    "executive summary", "defending against", "protecting against", "advisory:", "alert:",
    "warning:",
]
AUDIENCE_TITLE = r"affecting .+ (users|customers|citizens|people|visitors|clients|residents|nationals)"
