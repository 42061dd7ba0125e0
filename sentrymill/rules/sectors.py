"""Rule tables for industry, attack type and impact.

Fixed values: labels, terms and their order have to equal the published rule
set.  The first label that matches wins.
"""

# -- fixed values: industry from the victim's own name ---------------------------
INDUSTRY_BY_NAME = [
    ("Healthcare", ["pharmaceutical", "pharma", "biopharmaceutical", "biopharma", "hospital",
                    "health", "medical", "clinic", "therapeutics", "biotech", "biologics",
                    "healthcare"]),
    ("Financial Services", ["bank", "bancorp", "bancshares", "financial", "finance", "insurance",
                            "capital", "investment", "credit union", "asset management",
                            "brokerage", "mortgage", "bitcoin", "crypto", "blockchain", "defi",
                            "dao", "payments", "fintech", "exchange", "wallet", "trading",
                            "protocol", "bridge"]),
    ("Education", ["university", "college", "school", "academy", "institute of technology",
                   "polytechnic", "edu"]),
    ("Energy", ["energy", "power", "electric", "utility", "utilities", "pipeline", "petroleum",
                "oil", "gas company", "water works"]),
    ("Transportation", ["airline", "airways", "airport", "railway", "railroad", "transit",
                        "shipping", "logistics", "freight", "auto", "automotive", "automobile",
                        "motors", "vehicle"]),
    ("Manufacturing", ["manufacturing", "foxconn", "hon hai", "industrial systems",
                       "industrial automation"]),
    ("Government", ["county", "municipality", "municipal", "city of", "department of",
                    "ministry of", "federal", "government"]),
    ("Telecommunications", ["telecom", "telecommunications", "wireless", "mobile network",
                            "broadband", "telco"]),
    ("Hospitality", ["hotel", "resort", "casino", "hospitality"]),
    ("Retail", ["retail", "supermarket", "grocer"]),
]

# -- fixed values: industry from "attack on ... <noun>" ---------------------------
_ATTACK_ON = r"\battacks?\s+(?:on|against)\s+[^.;:]*\b(?:{})\b"
INDUSTRY_BY_TARGET = [(label, _ATTACK_ON.format(nouns)) for label, nouns in [
    ("Government", "government|govt|agency|ministry|municipalit(?:y|ies)|federal|state government|department"),
    ("Healthcare", "hospital|hospitals|healthcare|clinic|health system|medical"),
    ("Education", "school|schools|university|universities|college|education|educational|student|campus|district"),
    ("Financial Services", "bank|banks|financial|credit union|insurance|brokerage|payment processor"),
    ("Energy", "utility|utilities|power grid|water utility|water company|oil pipeline|gas pipeline|energy provider|energy company"),
    ("Transportation", "airport|airline|aviation|rail|railway|transit|metro|shipping|logistics|freight|port authority"),
    ("Media", "newspaper|news outlet|media company|broadcaster|television network|radio station|publisher"),
    ("Manufacturing", "manufacturer|manufacturing|factory|industrial|electronics maker|contract manufacturer"),
    ("Retail", "retailer|retail chain|supermarket|department store|e-commerce|online store"),
    ("Telecommunications", "telecom|telecommunications|isp|internet service provider|mobile carrier|wireless provider"),
    ("Hospitality", "hotel|casino|resort|hospitality"),
    ("Legal", "law firm|legal services|accounting firm|professional services"),
]]

# -- fixed values: industry keywords ------------------------------------------------
INDUSTRY_KEYWORDS = [
    ("Healthcare", ["hospital", "healthcare", "patient", "medical", "clinic", "health system",
                    "health service", "pharmaceutical", "pharma", "biotech", "medtech",
                    "health care"]),
    ("Energy", ["energy company", "energy sector", "energy provider", "utility company",
                "utility provider", "power grid", "power plant", "substation", "water utility",
                "water treatment", "water company", "water works", "gas utility",
                "oil pipeline", "gas pipeline", "critical pipeline"]),
    ("Education", ["school", "university", "college", "education", "educational", "edtech",
                   "student", "campus", "district"]),
    ("Government", ["government", "agency", "ministry", "public sector", "municipal",
                    "city of ", "county", "state government", "federal", "department of",
                    "public service", "township", "parish"]),
    ("Transportation", ["airport", "airline", "aviation", "rail", "railway", "transit", "metro",
                        "port authority", "shipping", "logistics", "freight",
                        "electric bicycle", "electric bike", "e-bike", "ebike", "motorcycle",
                        "vehicle", "automotive", "fleet"]),
    ("Manufacturing", ["contract manufacturer", "electronics manufacturer",
                       "manufacturing company", "manufacturing firm", "contract electronics",
                       "industrial manufacturer"]),
    ("Media", ["newspaper", "news outlet", "media company", "media firm", "media group",
               "media outlet", "news organization", "publishing company", "broadcaster",
               "television network", "radio station", "publisher"]),
    ("Financial Services", ["bank", "banking", "financial institution", "financial services",
                            "financial sector", "atm", "cryptocurrency exchange",
                            "crypto exchange", "crypto platform", "crypto protocol",
                            "crypto bridge", "defi platform", "defi protocol", "defi project",
                            "defi attack", "defi hack", "decentralized finance",
                            "web3 platform", "blockchain protocol", "flash loan", "rug pull",
                            "rugpull", "smart contract", "crypto heist", "crypto theft",
                            "fintech", "payment processor", "credit union", "brokerage",
                            "insurance company", "insurer"]),
    ("Retail", ["retailer", "retail chain", "retail store", "retail company", "retail group",
                "e-commerce", "ecommerce", "online retailer", "online store",
                "online marketplace", "supermarket", "grocery chain", "department store",
                "clothing retailer", "fashion retailer"]),
    ("Telecommunications", ["telecom", "telecommunications", "internet service provider",
                            "mobile carrier", "wireless carrier", "wireless provider",
                            "broadband provider", "mobile network", "phone company", " isp ",
                            "telco"]),
    ("Legal", ["law firm", "legal services", "legal firm", "law practice", "attorneys at law",
               "solicitors", "accounting firm", "audit firm", "professional services firm"]),
    ("Hospitality", ["hotel chain", "hotel group", "hotel operator", "casino operator",
                     "casino resort", "resort chain", "hospitality company",
                     "hospitality group", "hospitality industry"]),
    ("Technology", ["software provider", "software vendor", "technology", "tech company",
                    "tech firm", "it provider", "cloud", "saas", "hosting provider",
                    "managed service provider", "msp", "it services", "data center",
                    "software", "suite", "control panel", "platform", "plugin", "browser",
                    "developer tool", "application framework", "firmware",
                    "virtual machines", "vendor:", "product:", "video game developer",
                    "gaming", "game studio", "gpu", "semiconductor", "chipmaker", "cpanel",
                    "telematics", "fleet management", "fleet management company",
                    "gps tracking", "tracking platform", "macos", "mac malware",
                    "malvertising", "infostealer", "stealer malware", "ai chatbot",
                    "google ads", "npm package", "pypi package"]),
]

# -- fixed values: organisation-type phrases, all Technology --------------------------
ORGANISATION_TYPES = [
    ("Technology", r"\b(?:cybersecurity|security|threat intelligence|endpoint security|network security)\s+"
                   r"(?:company|firm|vendor|provider|platform)\b"),
    ("Technology", r"\b(?:company|firm|vendor|provider|platform)\s+"
                   r"(?:specializing in|focused on|providing|offering)\s+"
                   r"(?:cybersecurity|security|threat intelligence|endpoint security|network security)\b"),
]

# -- fixed values: last-resort industry terms -------------------------------------------
INDUSTRY_FALLBACK = [
    ("Healthcare", ["hospital", "healthcare", "medical", "medtech", "clinic"]),
    ("Education", ["school", "university", "education", "student"]),
    ("Government", ["government", "ministry", "agency", "municipality", "city of"]),
    ("Financial Services", ["bank", "banking", "fintech", "payment processor", "credit union"]),
    ("Telecommunications", ["telecom", "telecommunications", "mobile carrier",
                            "wireless carrier", "broadband provider",
                            "internet service provider"]),
    ("Hospitality", ["hotel chain", "hotel group", "casino", "resort", "hospitality company",
                     "hospitality group"]),
    ("Retail", ["retailer", "retail chain", "supermarket", "e-commerce", "online retailer",
                "online store", "department store"]),
    ("Legal", ["law firm", "legal services", "accounting firm", "professional services firm"]),
    ("Technology", ["software vendor", "software provider", "tech company", "tech firm", "saas",
                    "hosting provider", "managed service provider", "msp", "data center",
                    "developer tool", "application framework", "web admin", "npm package",
                    "pypi package", "package registry", "open-source",
                    "open source software", "zero-day exploit", "macos", "mac malware",
                    "malvertising", "google ads", "infostealer", "stealer malware",
                    "ai chatbot", "browser extension", "apple mac", "apple silicon"]),
]

# -- fixed values: attack types -----------------------------------------------------------
ATTACK_TYPES = [
    "Supply Chain", "Ransomware", "Financial Theft", "DDoS", "Phishing", "Data Breach",
    "Account Compromise", "Malware", "Exploitation", "Disruption", "Authentication Bypass",
    "Remote Code Execution", "Privilege Escalation", "Injection", "Unknown",
]
TITLE_BREACH = [
    "data breach", "security breach", "source code breach", "breach of", "breach at",
    "breach disrupts", "breach exposes", "data leak", "data theft", " leak", "tb leak",
    "gb leak", "mb leak", "stolen data", "data stolen",
]
TITLE_WIPER = [
    "data-wiping", "data wiping", "wiping attack", "wiper attack", "wiper malware",
    "disk wiper", "disk wiping", "wiping malware",
]
ANTI_RANSOMWARE = r"\banti-ransomware\b"
# One row per rule, in cascade order: (label, scope, terms, guards).
# Scopes: lead = title and summary, text = everything, ransom = text without
# "anti-ransomware".  Guards name conditions that switch the rule off.
_CHAIN, _THEFT = "Supply Chain", "Financial Theft"
ATTACK_RULES = [
    (_CHAIN, "lead", [
        "supply chain attack", "supply chain compromise", "supply chain hack",
        "supply chain intrusion", "supply-chain attack", "supply chain infection",
        "attacked via supply chain"], ["activity"]),
    (_CHAIN, "text", [
        "malicious package", "malicious update", "poisoned package", "dependency confusion",
        "compromised vendor", "third-party compromise"], ["activity"]),
    ("Ransomware", "ransom", [
        "ransomware", "ransom note", "ransom demand", "double extortion", "extortion gang",
        "encryptor"], ["activity", "title_breach"]),
    (_THEFT, "lead", [
        "million stolen", "billion stolen", "million drained", "billion drained",
        "million in crypto", "million in bitcoin", "million in ethereum", "million in ether",
        "million worth of crypto", "hacked for $", "stolen $", "theft of $", "funds stolen",
        "stolen funds", "crypto stolen", "cryptocurrency stolen", "funds drained",
        "drained funds", "assets stolen", "assets drained", "wallet drained",
        "treasury drained", "cyber heist", "crypto heist", "crypto theft",
        "cryptocurrency theft", "wire fraud", "bank fraud"], ["activity"]),
    (_THEFT, "text", [
        "flash loan", "flash-loan", "rug pull", "rugpull", "defi exploit", "defi hack",
        "defi attack", "bridge exploit", "bridge hack", "bridge attack",
        "smart contract exploit", "protocol exploit", "protocol hack", "drain attack",
        "drained the protocol"], ["activity"]),
    ("DDoS", "text", [
        "ddos", "denial of service", "distributed denial of service", "botnet",
        "traffic flood"], ["activity"]),
    ("Phishing", "text", [
        "phishing", "phishing-as-a-service", "spear-phishing", "credential harvesting",
        "malicious email", "business email compromise", "bec ", "vishing", "smishing",
        "spear phishing"], ["activity", "title_breach"]),
    ("Data Breach", "text", [
        "data breach", "security breach", "source code breach", "breached",
        "breaching systems", "breach of", "hack at", "hack of", "data theft", "data leak",
        "data stolen", "stolen data", "stolen data records", "stolen records", "stole data",
        "exposed data", "data exposed", "unauthorized access to data",
        "customer data was accessed", "records were accessed",
        "personal information was accessed", "sensitive data",
        "personally identifiable information", "pii", "patient data",
        "medical records exposed"], ["activity", "title_wiper"]),
    ("Account Compromise", "text", [
        "credential theft", "stolen credentials", "credentials stolen", "account takeover",
        "compromised account", "hijacked account", "accounts were compromised",
        "obtained control of credentials", "credential stuffing", "password spraying",
        "brute force", "unauthorized login", "fraudulent login"], ["activity"]),
    ("Authentication Bypass", "text", [
        "authentication bypass", "auth bypass", "improper authentication",
        "broken authentication", "bypass authentication", "authentication vulnerability",
        "missing authentication"], []),
    ("Remote Code Execution", "text", [
        "remote code execution", "arbitrary code execution", "code execution vulnerability"], []),
    ("Privilege Escalation", "text", [
        "privilege escalation", "elevation of privilege", "escalate privileges",
        "escalating privileges", "local privilege escalation"], []),
    ("Injection", "text", [
        "sql injection", "command injection", "os command injection", "code injection",
        "injection vulnerability", "xpath injection", "ldap injection",
        "cross-site scripting", "xss", "stored xss", "reflected xss"], []),
    ("Malware", "text", [
        "malware", "trojan", "infostealer", "backdoor", "loader", "spyware", "wiper",
        "rootkit", "keylogger", "rat ", "remote access trojan", "malicious executables",
        "payload", "payloads", "deployed payloads", "used to deploy malware",
        "abused to deploy", "deployed malware", "running with system privileges",
        "disabled antivirus", "killing scripts", "data-wiping", "data wiping",
        "wiping attack", "wiper attack", "disk wiping", "disk wiper"],
     ["activity", "title_breach"]),
    ("Exploitation", "exploitation_signal", [], []),
    ("Disruption", "text", [
        "service disruption", "services disrupted", "systems disrupted", "knocked offline",
        "taken offline", "forced offline", "systems offline", "systems down",
        "services down", "operations disrupted", "operations halted",
        "operations suspended", "temporarily offline", "website defaced", "defaced",
        "disrupted operations", "disrupting operations"], ["activity"]),
]

# -- fixed values: high impact ---------------------------------------------------------------
HIGH_IMPACT = [
    "mass-exploited", "mass exploited", "mass exploitation", "actively exploited",
    "widespread", "large-scale", "millions", "critical infrastructure", "data breach",
    "wiper", "ransomware", "hacktivist", "state-sponsored", "nation-state",
    "military intelligence",
]
ACTIVITY_HIGH_IMPACT = [
    "mass-exploited", "mass exploited", "actively exploited",
    "known exploited vulnerability", "critical infrastructure",
]

# -- fixed values: victim-confirmation phrases -------------------------------------------------
PRIMARY_EVIDENCE = [
    "the company said", "the company announced", "the organization said", "the victim said",
    "according to the company", "according to the organization", "the regulator said",
    "the sec said", "the sec filing", "in a filing", "in a statement",
    "in a statement shared", "official statement", "official disclosure",
    "company statement", "company disclosed", "the hospital said", "the vendor said",
    "the provider said", "confirmed in a statement",
    "announced that hackers breached its systems", "confirmed the incident",
    "confirmed the breach", "confirmed the attack", "confirmed the cyberattack",
    "confirmed a breach", "confirmed a data breach", "disclosed a breach",
    "disclosed a data breach", "discloses data breach", "discloses a breach",
    "acknowledged the breach", "acknowledged the incident",
]
