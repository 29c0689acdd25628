"""Word lists, patterns and constants that decide results.

Patterns are written for Java's regex engine and, lookarounds aside, also mean
the same in RE2, which the SQL checks use.
"""

# --- fixed values: text clean-up -------------------------------------------
BREAK_TAG = r"(?i)<\s*(br|/p|/div|/li|/h[1-6])\s*/?>"
LIST_ITEM_TAG = r"(?i)<\s*li[^>]*>"
ANY_TAG = r"<[^>]+>"
BLANK_RUN = r"[ \t\r\f\x0B]+"
NEWLINE_RUN = r"\n{3,}"

# --- fixed values: employer and title normalisation ------------------------
COMPANY_QUOTES = "[‘’“”']"
COMPANY_OTHER = r"[^a-z0-9&\s.-]"
LEGAL_SUFFIXES = [
    "inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company",
    "plc", "gmbh", "sa", "sas", "bv", "nv", "ag", "pty", "pte", "llp", "lp",
    "pc", "pllc", "group", "holdings", "holding", "the",
]
TITLE_BRACKETED = r"[\(\[\{].*?[\)\]\}]"
TITLE_NOISE = (
    r"\b(urgent(ly)?\s+hiring|hiring\s+now|immediate\s+start|apply\s+now|"
    r"remote|work\s+from\s+home|w2|1099|full[\s-]?time|part[\s-]?time)\b"
)
TITLE_OTHER = r"[^a-z0-9+#/\s-]"

# --- fixed values: places ---------------------------------------------------
US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR",
    "california": "CA", "colorado": "CO", "connecticut": "CT",
    "delaware": "DE", "district of columbia": "DC", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL",
    "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY",
    "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY", "puerto rico": "PR",
}
ZIP_CODE = r"\b(\d{5})(?:-\d{4})?\b"
US_WORDS = r"(?i)\b(united states of america|united states|usa|u\.s\.a\.|u\.s\.)\b"
NOT_A_CITY = ["remote", "anywhere", "united states", "us"]

# --- fixed values: labels, first match wins ---------------------------------
HYBRID = r"\bhybrid\b"
REMOTE = (
    r"\b(fully remote|100% remote|remote[- ]first|work from home|"
    r"telecommut\w*|wfh|remote)\b"
)
NOT_REMOTE = r"\b(no|not|non)[- ]remote\b"
ONSITE = r"\b(on[- ]site|onsite|in[- ]office|in[- ]person)\b"
EMPLOYMENT_PATTERNS = [
    ("internship", r"\b(intern(ship)?|co[- ]op)\b"),
    ("temporary", r"\b(temporary|temp\b|seasonal|locum)\b"),
    ("contract", r"\b(contract(or)?|freelance|1099|c2c|corp[- ]to[- ]corp|"
                 r"contract[- ]to[- ]hire)\b"),
    ("part_time", r"\b(part[\s-]?time|prn\b)\b"),
    ("full_time", r"\b(full[\s-]?time|permanent|regular)\b"),
]
LEVEL_PATTERNS = [
    ("executive", r"\b(chief|c[toefi]o\b|vp\b|vice president|president|"
                  r"executive vice)\b"),
    ("director", r"\b(director|head of)\b"),
    ("manager", r"\b(manager|supervisor|team lead|team leader)\b"),
    ("senior", r"\b(senior|sr\.?|staff|principal|lead|iii|iv)\b"),
    ("entry", r"\b(entry[- ]level|junior|jr\.?|associate|trainee|graduate|"
              r"apprentice|intern)\b"),
]
EDUCATION_PATTERNS = [
    ("doctorate", r"\b(ph\.?d|doctorate|doctoral)\b"),
    ("masters", r"\b(master'?s?(\s+degree)?\b|m\.?s\.?c?\b|m\.?b\.?a\b|"
                r"master of|graduate degree)\b"),
    ("bachelors", r"\b(bachelor'?s?(\s+degree)?\b|b\.?s\.?c?\b|b\.?a\b|"
                  r"undergraduate degree|bachelor of|four[- ]year degree)\b"),
    ("associates", r"\b(associate'?s?\s+degree|a\.?a\.?s?\b|two[- ]year degree)\b"),
    ("certification", r"\b(certification required|certified|cpc\b|ccs\b|"
                      r"rhia\b|rhit\b)\b"),
    ("high_school", r"\b(high school diploma|ged\b|hs diploma)\b"),
]
BENEFIT_PATTERNS = [
    ("health_insurance", r"\b(health insurance|medical insurance|health benefits|"
                         r"medical, dental|health coverage)\b"),
    ("dental", r"\bdental\b"),
    ("vision", r"\bvision (insurance|coverage|plan)\b"),
    ("retirement_401k", r"\b(401\s?\(?k\)?|403\s?\(?b\)?|retirement plan|pension)\b"),
    ("paid_time_off", r"\b(pto\b|paid time off|vacation days|paid vacation|"
                      r"annual leave)\b"),
    ("paid_holidays", r"\bpaid holidays?\b"),
    ("parental_leave", r"\b(parental leave|maternity leave|paternity leave)\b"),
    ("remote_stipend", r"\b(home office stipend|remote work stipend|"
                       r"internet reimbursement)\b"),
    ("tuition_reimbursement", r"\b(tuition (reimbursement|assistance)|"
                              r"education (reimbursement|assistance))\b"),
    ("bonus", r"\b(annual bonus|performance bonus|signing bonus|bonus eligible)\b"),
    ("equity", r"\b(equity|stock options|rsus?\b|espp\b)\b"),
    ("life_insurance", r"\blife insurance\b"),
    ("disability", r"\b(short[- ]term disability|long[- ]term disability|std/ltd)\b"),
    ("flexible_schedule", r"\b(flexible (schedule|hours)|flex time|flextime)\b"),
    ("professional_development", r"\b(professional development|learning budget|"
                                 r"conference budget)\b"),
]

# --- fixed values: flags and contacts ---------------------------------------
SPONSOR_YES = (
    r"(?i)\b(visa sponsorship (is )?(available|provided|offered)|will sponsor|"
    r"we sponsor|sponsorship available|h1[- ]?b sponsorship|"
    r"open to sponsorship|able to sponsor)\b"
)
SPONSOR_NO = (
    r"(?i)\b(no (visa )?sponsorship|unable to sponsor|cannot sponsor|"
    r"not able to sponsor|do(es)? not (provide|offer) sponsorship|"
    r"sponsorship is not available|without sponsorship|"
    r"not (currently )?sponsor)\b"
)
RELOCATION_YES = (
    r"(?i)\b(relocation (assistance|package|support|reimbursement|bonus)|"
    r"will relocate|relocation offered|relocation provided)\b"
)
RELOCATION_NO = r"(?i)\bno relocation( assistance| package)?\b"
URGENT = (
    r"(?i)\b(urgent(ly)? hiring|immediate (start|opening|hire|need)|"
    r"start (immediately|asap)|asap\b|hiring now|"
    r"multiple openings|filling quickly)\b"
)
AGENCY = (
    r"(?i)\b(staffing|recruit(ing|ment) (agency|firm|partner)|talent (partner|"
    r"acquisition firm)|on behalf of our client|our client is (seeking|"
    r"looking)|search firm|headhunt)\b"
)
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b"
PHONE = r"\b(?:\+1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b"

# --- fixed values: experience ------------------------------------------------
YEARS_RANGE = (
    "(?i)(\\d{1,2})\\s*(?:\\+|plus)?\\s*(?:-|to|–)\\s*(\\d{1,2})\\s*\\+?\\s*"
    "(?:years?|yrs?)"
)
YEARS_SINGLE = (
    r"(?i)(?:(?:at least|minimum(?: of)?|min\.?|over|more than)\s*)?"
    r"(\d{1,2})\s*\+?\s*(?:years?|yrs?)"
)
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight",
                "nine", "ten"]

# --- fixed values: pay --------------------------------------------------------
PERIODS_PER_YEAR = {
    "hourly": 2080.0, "daily": 260.0, "weekly": 52.0, "biweekly": 26.0,
    "monthly": 12.0, "yearly": 1.0, "annual": 1.0,
}
YEARLY_SYNONYMS = ["annual", "year", "yearly", "per_year"]
SALARY_AMOUNT = (
    "\\$\\s?(\\d{1,3}(?:,\\d{3})+|\\d+(?:\\.\\d+)?)\\s?([kK])?"
    "(?:\\s?(?:-|--|to|through|–)\\s?"
    "\\$?\\s?(\\d{1,3}(?:,\\d{3})+|\\d+(?:\\.\\d+)?)\\s?([kK])?)?"
)
PERIOD_HINTS = [
    ("hourly", r"\b(per hour|/\s?hour|/\s?hr|an hour|hourly|p/h)\b"),
    ("weekly", r"\b(per week|/\s?week|weekly)\b"),
    ("monthly", r"\b(per month|/\s?month|monthly|per mo)\b"),
    ("yearly", r"\b(per year|/\s?year|annually|annual|per annum|/\s?yr|a year)\b"),
]
PERIOD_CEILINGS = [("hourly", 200.0), ("weekly", 2000.0), ("monthly", 25000.0)]
SALARY_BANDS = [
    ("Under $40k", 40000.0), ("$40k-$60k", 60000.0), ("$60k-$80k", 80000.0),
    ("$80k-$100k", 100000.0), ("$100k-$130k", 130000.0),
    ("$130k-$160k", 160000.0), ("$160k+", 1000000000.0),
]

# --- fixed values: skills ------------------------------------------------------
REQUIRED_HEADING = (
    r"(required|requirements|must have|qualifications|you (will )?need|"
    r"minimum qualifications|essential)"
)
PREFERRED_HEADING = (
    r"(preferred|nice to have|bonus|plus|desirable|a plus|advantageous)"
)
# The same headings as plain words.
REQUIRED_WORDS = ["required", "requirements", "must have", "qualifications", "you need",
                  "you will need", "minimum qualifications", "essential"]
PREFERRED_WORDS = ["preferred", "nice to have", "bonus", "plus", "desirable", "a plus",
                   "advantageous"]
ALIAS_ALLOWED = r"^[\w+#./ -]+$"
HEADING_WINDOW = 700

# --- fixed values: fingerprints and linking -------------------------------------
WORD = r"[a-z0-9+#]+"
MIN_SIMHASH_TOKENS = 4
TITLE_THRESHOLD = 0.92
DESCRIPTION_THRESHOLD = 0.85
CONTRADICTION_FLOOR = 0.45
SOURCE_DEPTH = {
    "greenhouse": 100, "lever": 100, "ashby": 100, "workable": 95,
    "recruitee": 95, "smartrecruiters": 90,
    "usajobs": 80, "remotive": 60, "adzuna": 40,
}

# --- fixed values: job boards (host pattern, platform, token path) ----------------
BOARD_HOSTS = [
    (r"(^|\.)greenhouse\.io$", "greenhouse", r"^/([A-Za-z0-9_-]+)"),
    (r"(^|\.)lever\.co$", "lever", r"^/([A-Za-z0-9_-]+)"),
    (r"(^|\.)ashbyhq\.com$", "ashby", r"^/([A-Za-z0-9_.-]+)"),
    (r"(^|\.)workable\.com$", "workable", r"^/(?:j/)?([A-Za-z0-9_-]+)"),
    (r"(^|\.)recruitee\.com$", "recruitee", None),
    (r"(^|\.)smartrecruiters\.com$", "smartrecruiters", r"^/([A-Za-z0-9_-]+)"),
]
BOARD_RESERVED = ["embed", "jobs", "job", "api", "v1", "search", "companies",
                  "boards", "static", "assets", "j", "o"]
BOARD_SUBDOMAINS_SKIPPED = ["boards", "job-boards", "api", "apply", "jobs", "www"]

# --- fixed values: research, export and search vocabularies -----------------------
UNTITLED = "(untitled)"
DATE_PRESET_DAYS = [1, 3, 7, 14, 30]
RESEARCH_STATUSES = ["new", "reviewed", "relevant", "not_relevant", "follow_up",
                     "archived"]
FIELD_TYPES = ["text", "longtext", "number", "boolean", "date", "dropdown",
               "multiselect", "score"]
SUMMARY_LENGTH = 320
