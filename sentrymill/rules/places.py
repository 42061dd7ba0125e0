"""Rule tables for countries and regions.

Fixed values: names, terms and their order have to equal the published rule
set.  Terms are substrings of lower-cased text; the first entry wins.
"""

# -- fixed values: canonical region of a country ------------------------------------
REGION_COUNTRIES = [
    ("North America", ["United States", "Canada", "Mexico"]),
    ("Europe", ["United Kingdom", "Netherlands", "Germany", "France", "Italy", "Spain",
                "Portugal", "Belgium", "Switzerland", "Austria", "Poland", "Sweden", "Norway",
                "Finland", "Denmark", "Ireland", "Romania", "Czech Republic", "Ukraine",
                "Russia"]),
    ("Asia", ["China", "Taiwan", "Japan", "India", "Singapore", "South Korea", "Hong Kong",
              "Thailand", "Vietnam", "Indonesia", "Philippines", "Malaysia"]),
    ("Oceania", ["Australia", "New Zealand"]),
    ("South America", ["Brazil", "Argentina", "Chile", "Colombia", "Peru"]),
    ("Africa", ["South Africa", "Nigeria", "Kenya", "Egypt"]),
    ("Middle East", ["Israel", "United Arab Emirates", "Saudi Arabia", "Qatar", "Turkey",
                     "Iran", "Iraq", "Jordan", "Lebanon", "Kuwait", "Oman", "Bahrain",
                     "Yemen"]),
    ("Asia", ["Armenia", "Azerbaijan", "Georgia", "Kazakhstan", "Pakistan", "Bangladesh",
              "Sri Lanka", "Nepal"]),
    ("Europe", ["Belarus", "Estonia", "Latvia", "Lithuania", "Slovakia", "Slovenia",
                "Croatia", "Serbia", "Bulgaria", "Hungary", "Greece", "Iceland",
                "Luxembourg", "Malta"]),
    ("Africa", ["Morocco", "Algeria", "Tunisia", "Ethiopia", "Ghana", "Tanzania",
                "Zimbabwe"]),
    ("North America", ["Costa Rica", "Panama", "Cuba", "Dominican Republic", "Jamaica"]),
    ("South America", ["Venezuela", "Ecuador", "Bolivia", "Uruguay", "Paraguay"]),
]
CANONICAL_REGIONS = ["North America", "Europe", "South America", "Asia", "Oceania", "Global"]

# -- fixed values: country terms in text, (terms, country, region) ---------------------
COUNTRY_TERMS = [
    (["united states", "u.s.", "u.s.a.", "usa", "american"], "United States", "North America"),
    (["california", "texas", "new york", "new jersey", "virginia", "washington state",
      "washington, d.c.", "washington dc", "florida", "illinois", "georgia", "pennsylvania",
      "massachusetts", "ohio", "michigan", "north carolina", "arizona", "colorado",
      "maryland", "nevada", "minnesota", "indiana", "tennessee", "missouri", "wisconsin",
      "connecticut", "oregon", "utah", "louisiana", "alabama", "kentucky", "oklahoma",
      "kansas", "arkansas", "iowa", "mississippi", "nebraska", "idaho", "new mexico",
      "hawaii", "alaska", "west virginia"], "United States", "North America"),
    (["canada", "canadian"], "Canada", "North America"),
    (["mexico", "mexican"], "Mexico", "North America"),
    (["united kingdom", "uk ", " uk", "britain", "british", "england"], "United Kingdom", "Europe"),
    (["netherlands", "dutch"], "Netherlands", "Europe"),
    (["germany", "german"], "Germany", "Europe"),
    (["france", "french"], "France", "Europe"),
    (["italy", "italian"], "Italy", "Europe"),
    (["spain", "spanish"], "Spain", "Europe"),
    (["portugal", "portuguese"], "Portugal", "Europe"),
    (["belgium", "belgian"], "Belgium", "Europe"),
    (["switzerland", "swiss"], "Switzerland", "Europe"),
    (["austria", "austrian"], "Austria", "Europe"),
    (["poland", "polish"], "Poland", "Europe"),
    (["sweden", "swedish"], "Sweden", "Europe"),
    (["norway", "norwegian"], "Norway", "Europe"),
    (["finland", "finnish"], "Finland", "Europe"),
    (["denmark", "danish"], "Denmark", "Europe"),
    (["ireland", "irish"], "Ireland", "Europe"),
    (["romania", "romanian"], "Romania", "Europe"),
    (["czech republic", "czechia", "czech"], "Czech Republic", "Europe"),
    (["ukraine", "ukrainian"], "Ukraine", "Europe"),
    (["russia", "russian"], "Russia", "Europe"),
    (["china", "chinese"], "China", "Asia"),
    (["taiwan", "taiwanese"], "Taiwan", "Asia"),
    (["japan", "japanese"], "Japan", "Asia"),
    (["india", "indian"], "India", "Asia"),
    (["singapore"], "Singapore", "Asia"),
    (["south korea", "korea", "korean"], "South Korea", "Asia"),
    (["hong kong"], "Hong Kong", "Asia"),
    (["thailand", "thai"], "Thailand", "Asia"),
    (["vietnam", "vietnamese"], "Vietnam", "Asia"),
    (["indonesia", "indonesian"], "Indonesia", "Asia"),
    (["philippines", "philippine"], "Philippines", "Asia"),
    (["malaysia", "malaysian"], "Malaysia", "Asia"),
    (["australia", "australian"], "Australia", "Oceania"),
    (["new zealand"], "New Zealand", "Oceania"),
    (["brazil", "brazilian"], "Brazil", "South America"),
    (["argentina", "argentinian", "argentine"], "Argentina", "South America"),
    (["chile", "chilean"], "Chile", "South America"),
    (["colombia", "colombian"], "Colombia", "South America"),
    (["peru", "peruvian"], "Peru", "South America"),
    (["south africa"], "South Africa", "Africa"),
    (["nigeria", "nigerian"], "Nigeria", "Africa"),
    (["kenya", "kenyan"], "Kenya", "Africa"),
    (["egypt", "egyptian"], "Egypt", "Africa"),
    (["israel", "israeli"], "Israel", "Middle East"),
    (["uae", "united arab emirates"], "United Arab Emirates", "Middle East"),
    (["saudi arabia", "saudi"], "Saudi Arabia", "Middle East"),
    (["qatar"], "Qatar", "Middle East"),
    (["turkey", "turkish"], "Turkey", "Middle East"),
    (["iran", "iranian"], "Iran", "Middle East"),
    (["iraq", "iraqi"], "Iraq", "Middle East"),
    (["armenia", "armenian"], "Armenia", "Central Asia"),
    (["azerbaijan"], "Azerbaijan", "Central Asia"),
    (["kazakhstan"], "Kazakhstan", "Central Asia"),
    (["uzbekistan"], "Uzbekistan", "Central Asia"),
    (["pakistan", "pakistani"], "Pakistan", "Asia"),
    (["bangladesh"], "Bangladesh", "Asia"),
    (["afghanistan"], "Afghanistan", "Asia"),
]

# -- fixed values: region terms, used when no country was found --------------------------
REGION_TERMS = [
    ("North America", ["north america"]),
    ("South America", ["south america", "latin america"]),
    ("Europe", ["europe", "european"]),
    ("Asia", ["asia", "asia-pacific", "apac"]),
    ("Middle East", ["middle east"]),
    ("Africa", ["africa"]),
    ("Oceania", ["oceania"]),
    ("Global", ["global attack", "worldwide attack", "international attack",
                "global campaign", "worldwide campaign"]),
]

# -- fixed values: phrases ------------------------------------------------------------------
TARGET_PHRASES = [  # (pattern, substrings of which one occurs in every match)
    (r"\battacks?\s+(?:on|against)\s+([^.;:]+)", ["attack"]),
    (r"\btarget(?:ing|ed)\s+([^.;:]+)", ["target"]),
    (r"\bcampaign(?:s)?\s+against\s+([^.;:]+)", ["campaign"]),
    (r"\bmalware\s+used\s+in\s+attacks?\s+(?:on|against)\s+([^.;:]+)", ["malware"]),
    (r"\bbased\s+in\s+([^.;:,]+)", ["based"]),
]
AUDIENCE_PHRASE = (
    r"\b\w+(?:ian|ish|ese|an)\s+(?:users?|customers?|citizens?|people|residents?|nationals?"
    r"|workers?|members?|subscribers?|patients?|students?|employees?)\b"
)
LANGUAGE_SOFTWARE = r"\b\w+-language\s+(?:software|systems?|apps?|tools?|platforms?|code)\b"
NATIONALITY_PHRASE = (
    r"\bis\s+an?\s+([^.;:]+?)\s+(?:company|corporation|corp|firm|manufacturer|organisation"
    r"|organization|enterprise|conglomerate|subsidiary)\b"
)
NATIONALITY_ACTOR_WORDS = [
    "cybercrime", "ransomware", "malware", "hacking", "espionage", "extortion", "criminal",
    "threat actor", "hacker",
]
