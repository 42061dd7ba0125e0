"""Rule tables for actor attribution and a seed dictionary.

Fixed values: phrases have to equal the published rule set.  The actor
dictionary itself is an input (see sources.actors): the full list of groups is
data that a user lands as JSON; SEED_ACTORS only keeps the package usable, and
its queries checkable, without such a file.
"""

# -- fixed values: attribution phrases -------------------------------------------------
CLAIMED = [
    "claimed responsibility", "claims responsibility", "claiming responsibility",
    "claimed the attack", "claimed the breach", "claimed credit", "claims credit",
    "took credit", "claimed they", "claims they", "claimed to have", "claims to have",
    "claim to have", "claiming to have", "claimed to", "claimed it", "claimed that",
    "claiming that", "claimed by", "has claimed", "have claimed", "is claiming",
    "added the company to", "listed the victim on", "posted on its leak site",
    "posted on their leak site", "added to its leak site", "added to their leak site",
    "named on its leak site", "named on their leak site", "leaked data on its",
    "leaked data on their", "demonstrated they", "demonstrated access",
]
CONFIRMED = [
    "officials confirmed", "officials said", "fbi confirmed", "cisa confirmed",
    "investigators confirmed", "investigators determined", "researchers confirmed",
    "the company attributed", "the company attributed the attack", "victim confirmed",
    "decision to pay", "agreed to pay", "confirming their decision",
]
SUSPECTED = [
    "suspected", "linked to", "believed to be", "attributed to", "tied to",
    "associated with", "behind the attack", "behind the breach", "appears to be",
    "consistent with", "tactics overlap with",
]

# -- fixed values: guards -----------------------------------------------------------------
ACTOR_CLASS_CONTEXT = (
    r"\b(?:ransomware|threat\s+(?:group|actor|actors|campaign)|hacking\s+(?:group|gang|crew)"
    r"|cybercriminal|criminal\s+(?:group|gang)|hackers|hacktivist|nation.state|apt\b"
    r"|cyber\s+(?:gang|group|crew)|gang|crew)\b"
)
HISTORICAL_MARKER = (
    r"\b(?:in\s+(?:late\s+|early\s+)?(?:january|february|march|april|may|june|july|august"
    r"|september|october|november|december)|last\s+(?:year|month|quarter|week)|previously"
    r"|earlier\s+this\s+(?:year|month)"
    r"|a\s+(?:prior|previous|separate)\s+(?:incident|breach|attack|compromise)"
    r"|the\s+previous\s+(?:attack|breach|incident)"
    r"|an?\s+earlier\s+(?:attack|breach|incident))\b"
)
GENERIC_ACTORS = [
    "hackers", "attackers", "threat actors", "ransomware group", "ransomware gang",
    "cybercriminals", "criminal group", "unknown", "unknown actor", "unidentified", "global",
]

# -- fixed values: window sizes in characters -----------------------------------------------
PHRASE_WINDOW = 200
STATUS_WINDOW = 160
SHORT_ALIAS_WINDOW = 30
HISTORY_WINDOW = 50
SHORT_ALIAS_CHARS = 5

# -- fixed values: seed dictionary, (canonical, type, aliases) --------------------------------
SEED_ACTORS = [
    ("LockBit", "cybercriminal",
     ["LockBit 3.0", "LockBit Black", "LockBit 2.0", "LockBit Red", "LockBit Green"]),
    ("ALPHV", "cybercriminal", ["BlackCat", "ALPHV/BlackCat", "ALPHV BlackCat", "AlphV"]),
    ("Cl0p", "cybercriminal", ["Clop", "Cl0p ransomware", "TA505"]),
    ("Akira", "cybercriminal", ["Akira ransomware"]),
    ("Black Basta", "cybercriminal", ["BlackBasta"]),
    ("RansomHub", "cybercriminal", ["Ransom Hub"]),
    ("Play", "cybercriminal", ["Play ransomware", "PlayCrypt"]),
    ("Royal", "cybercriminal", ["Royal ransomware"]),
    ("Qilin", "cybercriminal", ["Agenda ransomware", "Agenda"]),
]
