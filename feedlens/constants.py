"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is data, not logic: term lists, weights, ordered
rule tables and label strings. They are written out plainly, in their
natural order, so they can be reviewed against the behaviour they pin.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES — scoring
# --------------------------------------------------------------------------

DEFAULT_WEIGHTS = {
    "cvss_weight": 30.0,
    "recency_weight": 25.0,
    "source_tier_weight": 20.0,
    "engagement_weight": 10.0,
    "watchlist_weight": 15.0,
}

# tier -> share of the tier weight; any other tier gets TIER_OTHER
TIER_SHARE = {1: 1.0, 2: 0.66, 3: 0.33}
TIER_OTHER = 0.1

RECENCY_HALF_LIFE_HOURS = 12.0
ENGAGEMENT_FULL_POINTS = 500          # log(points+1)/log(501) saturates here
WATCHLIST_FULL_HITS = 3

DEFAULT_WATCHLIST = [
    "ransomware", "zero-day", "critical", "RCE", "remote code execution",
    "authentication bypass", "supply chain", "nation-state", "APT",
    "active exploitation", "CISA KEV", "Log4j", "Exchange", "Ivanti",
    "Fortinet", "Cisco", "Microsoft", "Apple", "Linux kernel",
]

DEFAULT_SIMILARITY_THRESHOLD = 85
DEFAULT_MIN_SCORE = 40.0
DEFAULT_DIGEST_HOURS = 24
DEFAULT_INCIDENT_DAYS = 14
DEFAULT_INCIDENT_CATEGORIES = ["incidents", "threat_intel", "blogs", "advisories", "community"]
ALL_CATEGORIES = ["cve", "blogs", "community", "advisories", "threat_intel", "incidents"]
DEFAULT_TIER = 3

# --------------------------------------------------------------------------
# FIXED VALUES — keyword dictionaries (topic keywords)
# --------------------------------------------------------------------------

THREAT_ACTORS = [
    "lazarus", "apt28", "apt29", "cozy bear", "fancy bear", "sandworm",
    "volt typhoon", "salt typhoon", "scattered spider", "lapsus$",
    "cl0p", "lockbit", "blackcat", "alphv", "play", "black basta",
    "rhysida", "akira", "8base", "medusa", "darkside", "revil",
]

ATTACK_TYPES = [
    "ransomware", "phishing", "supply chain", "zero-day", "zero day",
    "rce", "remote code execution", "sql injection", "xss", "csrf",
    "privilege escalation", "lateral movement", "credential stuffing",
    "man-in-the-middle", "mitm", "ddos", "dos", "backdoor",
    "rootkit", "keylogger", "spyware", "adware", "trojan", "worm",
    "botnet", "c2", "command and control", "exfiltration",
    "authentication bypass", "path traversal", "lfi", "rfi",
    "deserialization", "buffer overflow", "heap spray",
]

PRODUCTS = [
    "windows", "linux", "macos", "ios", "android",
    "exchange", "outlook", "office", "microsoft", "azure", "active directory",
    "cisco", "juniper", "palo alto", "fortinet", "ivanti", "vmware",
    "apple", "google", "android", "chrome", "firefox", "safari",
    "apache", "nginx", "tomcat", "spring", "log4j", "log4shell",
    "openssl", "openssh", "curl", "libwebp",
    "aws", "gcp", "azure", "kubernetes", "docker",
    "citrix", "pulse secure", "solarwinds", "kaseya",
    "confluence", "jira", "atlassian", "gitlab", "github",
    "wordpress", "drupal", "joomla",
]

# capitalised words that are never keywords
NOUN_STOPWORDS = ["this", "that", "with", "from", "have", "been"]

CLUSTER_MIN_SHARED = 2
CLUSTER_OTHER_NAME = "Other"
CLUSTER_SHARED_SHOWN = 5

# --------------------------------------------------------------------------
# FIXED VALUES — source rules
# --------------------------------------------------------------------------

# a news-aggregator story is security related if its title contains any of
HN_SECURITY_TERMS = [
    "security", "vulnerability", "exploit", "hack", "breach", "malware",
    "ransomware", "CVE", "zero-day", "phishing", "CISA", "threat", "attack",
    "injection", "XSS", "RCE", "authentication", "cryptography", "encryption",
    "privacy", "surveillance", "APT", "backdoor", "trojan", "worm",
]
HN_TOP_STORIES = 200
HN_MAX_ITEMS = 30
HN_ITEM_URL = "https://news.ycombinator.com/item?id={}"

KEV_MIN_CVE_YEAR = 2018
KEV_URL = "https://www.cisa.gov/known-exploited-vulnerabilities-catalog"
KEV_CVSS = 9.0

NVD_DETAIL_URL = "https://nvd.nist.gov/vuln/detail/{}"
OSV_DETAIL_URL = "https://osv.dev/vulnerability/{}"
OSV_MAX_PER_ECOSYSTEM = 8
OSV_MAX_MEMBER_BYTES = 10 * 1024 * 1024
OSV_MAX_TOTAL_BYTES = 150 * 1024 * 1024

JSON_FEED_MAX_RAW = 50
JSON_FEED_CONTAINER_KEYS = ["items", "data", "entries", "results", "vulnerabilities"]

DESCRIPTION_MAX = 500
NVD_TITLE_DESC_MAX = 80

# --------------------------------------------------------------------------
# FIXED VALUES — incident report selection
# --------------------------------------------------------------------------

INCIDENT_TERMS = [
    "breach", "breached", "hacked", "hack", "compromised", "ransomware",
    "attack", "attacked", "stolen", "leaked", "exposed", "exfiltrated",
    "phishing", "malware", "intrusion", "incident", "exploit", "zero-day",
    "0-day", "CVE-", "data leak", "data theft", "unauthorized access",
    "supply chain", "backdoor", "outage", "disrupted", "credential",
    "APT", "nation-state", "espionage", "extortion", "DDoS",
]

# --------------------------------------------------------------------------
# FIXED VALUES — incident field rules (ordered; first match wins)
# --------------------------------------------------------------------------

INCIDENT_TYPE_RULES = [
    (r"ransomware|ransom demand|encrypted files|file-encrypting", "Ransomware"),
    (r"data breach|data leak|data exposed|records exposed|leaked database|database leak", "Data Breach"),
    (r"supply chain|dependency confusion|malicious package|npm package|pypi package|typosquat", "Supply Chain Attack"),
    (r"phishing|spear.?phish|credential harvest|business email compromise|BEC", "Phishing"),
    (r"zero.?day|0.?day", "Zero-Day Exploit"),
    (r"DDoS|distributed denial|denial.of.service", "DDoS Attack"),
    (r"APT|nation.state|state.sponsored|espionage|cyber.espionage", "Nation-State / APT"),
    (r"authentication bypass|auth bypass|login bypass|password bypass", "Authentication Bypass"),
    (r"remote code execution|RCE|arbitrary code", "Remote Code Execution"),
    (r"privilege escalation|privesc|elevated privilege", "Privilege Escalation"),
    (r"sql injection|SQLi", "SQL Injection"),
    (r"cross.site scripting|XSS", "Cross-Site Scripting"),
    (r"cryptojack|cryptomining|coin.?miner", "Cryptojacking"),
    (r"backdoor|trojan|malware|spyware|infostealer|stealer", "Malware"),
    (r"vulnerability|CVE-\d{4}-\d+|flaw|security bug|patch", "Vulnerability"),
    (r"breach|hacked|compromised|intrusion|unauthorized access", "Security Breach"),
    (r"outage|disruption|service.down|unavailable", "Service Disruption"),
]
INCIDENT_TYPE_DEFAULT = "Security Incident"

# (pattern with group 1, template); "{}" is replaced by the stripped group
IMPACT_RULES = [
    (r"(\d[\d,\.]+\s*(?:million|billion|thousand|M|B|K)?\s*(?:records?|users?|accounts?|customers?|individuals?|people)\s*(?:exposed|stolen|leaked|affected|compromised))", "{}"),
    (r"(data of [\d,\.]+ (?:million|billion|thousand|M|B|K)?\s*(?:users?|customers?|people|individuals?))", "{}"),
    (r"(PII|personally identifiable information|SSN|social security|credit card|financial data|health records?|medical records?)\s*(?:exposed|stolen|leaked|compromised)", "{} exposed"),
    (r"(systems?\s+(?:taken offline|shut down|disrupted|encrypted|locked))", "{}"),
    (r"(\$[\d,\.]+(?:\s*(?:million|billion|M|B))?(?:\s*ransom|\s*stolen|\s*lost|\s*in damage)?)", "{}"),
    (r"(production (?:systems?|environment|servers?) (?:down|affected|impacted))", "{}"),
    (r"(source code (?:stolen|exposed|leaked))", "{}"),
    (r"(intellectual property|trade secrets?) (?:stolen|exfiltrated|accessed)", "{} stolen"),
    (r"(no (?:data|customer|user) (?:was )?(?:stolen|exposed|compromised|affected))", "{}"),
]
IMPACT_DEFAULT = "Not reported"

ROOT_CAUSE_RULES = [
    (r"(CVE-\d{4}-\d{4,7})", "{}"),
    (r"(misconfigur(?:ed|ation)|exposed\s+(?:S3|bucket|database|API|endpoint|server))", "Misconfiguration — {}"),
    (r"(phishing|spear.?phish)", "Phishing attack"),
    (r"(stolen credentials?|credential stuffing|compromised credentials?|password reuse)", "Compromised credentials"),
    (r"(unpatched|outdated software|legacy system|end.of.life)", "Unpatched/legacy software"),
    (r"(third.party|vendor|supplier|contractor|MSP|managed service)", "Third-party/supply chain compromise"),
    (r"(insider threat|malicious insider|rogue employee)", "Insider threat"),
    (r"(brute.?force|password spray)", "Brute-force attack"),
    (r"(social engineering)", "Social engineering"),
    (r"(zero.?day|0.?day)", "Zero-day vulnerability (unpatched at time of attack)"),
    (r"(SQL injection|XSS|CSRF|RCE|buffer overflow|deserialization)", "Web vulnerability — {}"),
    (r"(default password|default credential)", "Default credentials not changed"),
    (r"(MFA bypass|multi.?factor bypass|OTP bypass)", "MFA bypass"),
]
ROOT_CAUSE_DEFAULT = "Under investigation"

# fix-signal alternatives (any one matching means "a fix exists")
FIX_SIGNAL_PATTERN = (
    r"patch(?:ed|es|ing)(?!\s+not|\s+unavailable)|"
    r"(?<!no\s)(?<!not\s)patch(?:\s+is)?\s+available|"
    r"fix(?:ed|es)(?!\s+not|\s+unavailable)|"
    r"(?<!no\s)(?<!not\s)fix\s+(?:is\s+)?available|"
    r"update(?:d|s)?\s+available|remediat(?:ed|ion)|"
    r"mitigat(?:ed|ion)|workaround available|upgrade to|upgrade available|"
    r"version \d[\d\.]+ (?:addresses|fixes|resolves)|security advisory|"
    r"has been (?:fixed|patched|resolved)|released a (?:fix|patch|update)|"
    r"required patch by|patch required by"
)
NO_FIX_SIGNAL_PATTERN = (
    r"no patch available|no fix available|not yet patched|"
    r"no workaround|still vulnerable|no available (?:fix|patch)|"
    r"patch not (?:yet )?available|has not (?:been )?patched|"
    r"\bunpatched\b"
)

KNOWN_VICTIMS = [
    "Microsoft", "Google", "Apple", "Meta", "Facebook", "Amazon", "AWS",
    "Cisco", "Fortinet", "Ivanti", "Palo Alto", "CrowdStrike", "SentinelOne",
    "VMware", "Broadcom", "Citrix", "Juniper", "F5", "Check Point",
    "SolarWinds", "Kaseya", "MOVEit", "GoAnywhere", "Progress Software",
    "Atlassian", "Confluence", "Jira", "GitHub", "GitLab", "Bitbucket",
    "Okta", "1Password", "LastPass", "Bitwarden", "Twilio", "Cloudflare",
    "Uber", "Lyft", "Twitter", "X", "LinkedIn", "Slack", "Zoom",
    "Salesforce", "ServiceNow", "SAP", "Oracle", "IBM",
    "NHS", "Change Healthcare", "UnitedHealth", "Ascension",
    "T-Mobile", "AT&T", "Verizon", "Comcast", "Dish Network",
    "MGM", "Caesars", "Casino", "Clorox", "Johnson Controls",
    "Boeing", "Lockheed", "Northrop", "General Electric",
    "Apache", "Log4j", "OpenSSL", "OpenSSH", "curl", "libwebp",
    "WordPress", "Drupal", "Magento", "Shopify",
    "npm", "PyPI", "RubyGems", "crates.io",
]

# generic victim patterns, tried in order; group 1 is the candidate
VICTIM_RULES = [
    r"(?:hack(?:ed|s)|breach(?:ed|es|ing)?|attack(?:ed|s)|hit|target(?:ed|s)|struck|affect(?:ed|s)|compromised)\s+(?:by\s+\w+\s+)?([A-Z][A-Za-z0-9\s&\-']{2,40}?)(?:\s*[,\.;]|\s+(?:systems?|users?|customers?|data|network))",
    r"([A-Z][A-Za-z0-9\s&\-']{2,40}?)\s+(?:confirms?|discloses?|reports?|warns?|reveals?|says?|acknowledges?)\s+(?:a\s+)?(?:data\s+)?breach",
    r"([A-Z][A-Za-z0-9\s&\-']{2,40}?)\s+(?:hit|struck|targeted|crippled|disrupted)\s+by",
    r"vulnerability\s+in\s+([A-Za-z0-9][A-Za-z0-9\s&\-'\.]{1,40}?)(?:\s*[,\.;]|\s+(?:allows?|enables?|could|lets?))",
    r"(?:flaw|bug|issue|vulnerability)\s+(?:found|discovered|identified)\s+in\s+([A-Za-z0-9][A-Za-z0-9\s&\-'\.]{1,40}?)(?:\s*[,\.;])",
]
# Necessary conditions for the generic victim patterns: the verb phrase each
# pattern ends with. A cheap scan for it runs first, so the lazy
# 2..40-character candidate search only runs on texts that can match.
VICTIM_GUARDS = [
    None,
    r"(?:confirm|disclose|report|warn|reveal|say|acknowledge)s?\s+(?:a\s+)?(?:data\s+)?breach",
    r"(?:hit|struck|targeted|crippled|disrupted)\s+by",
    None,
    None,
]
VICTIM_REJECT_PREFIXES = ["the ", "a ", "an ", "this ", "that ", "its ", "their "]
VICTIM_TRAILING_CHARS = ".,;'\""
VICTIM_MIN_LEN = 3
VICTIM_MAX_LEN = 60
VICTIM_DEFAULT = "Unknown"

# --------------------------------------------------------------------------
# FIXED VALUES — labels
# --------------------------------------------------------------------------

FIXED_LABEL = {True: "Yes — patch/fix available", False: "No — actively exploited / no patch", None: "Unknown"}
FIXED_DISPLAY = {True: "YES — Patch Available", False: "NO  — No Fix / Actively Exploited", None: "Unknown"}
STATUS_COLOR = {True: "blue", False: "red", None: "yellow"}

TYPE_ICONS = [
    ("Ransomware", "🔒"),
    ("Data Breach", "💾"),
    ("Supply Chain Attack", "📦"),
    ("Phishing", "🎣"),
    ("Zero-Day Exploit", "💥"),
    ("DDoS Attack", "🌊"),
    ("Nation-State / APT", "🕵"),
    ("Authentication Bypass", "🔓"),
    ("Remote Code Execution", "⚡"),
    ("Privilege Escalation", "⬆"),
    ("SQL Injection", "💉"),
    ("Cross-Site Scripting", "🕸"),
    ("Malware", "🦠"),
    ("Vulnerability", "🔍"),
    ("Security Breach", "🚨"),
    ("Service Disruption", "⛔"),
    ("Cryptojacking", "⛏"),
]
TYPE_ICON_DEFAULT = "⚠"

# severity badge thresholds on cvss, then on score when cvss is missing
SEVERITY_CVSS = [(9.0, "CRITICAL"), (7.0, "HIGH"), (4.0, "MEDIUM")]
SEVERITY_CVSS_ELSE = "LOW"
SEVERITY_SCORE = [(70.0, "HIGH"), (40.0, "MEDIUM")]
SEVERITY_SCORE_ELSE = "INFO"

SCORE_BANDS = [(80.0, "bold red"), (60.0, "bold yellow"), (40.0, "yellow")]
SCORE_BAND_ELSE_DIGEST = "dim white"
SCORE_BAND_ELSE_INCIDENT = "dim"

DIGEST_ITEMS_PER_CLUSTER = 5
DIGEST_DESC_MAX = 300
INCIDENT_SNIPPET_MAX = 350
INCIDENT_SNIPPET_MIN = 20
URL_SHOWN_MAX = 100
CVES_SHOWN = 3
DUP_SOURCES_SHOWN = 3
SHARED_KEYWORDS_SHOWN = 4

# --------------------------------------------------------------------------
# FIXED VALUES — external enrichment responses
# --------------------------------------------------------------------------

ENRICH_INCIDENT_TYPES = [
    "Ransomware", "Data Breach", "Supply Chain Attack", "Phishing",
    "Zero-Day Exploit", "DDoS Attack", "Nation-State / APT",
    "Authentication Bypass", "Remote Code Execution", "Privilege Escalation",
    "SQL Injection", "Cross-Site Scripting", "Malware", "Vulnerability",
    "Security Breach", "Service Disruption", "Cryptojacking", "Other",
]
ENRICH_REQUIRED_FIELDS = [
    "incident_type", "victim", "impact", "root_cause",
    "is_fixed", "severity_rationale", "ai_score_boost",
]
ENRICH_BOOST_MIN = 0.0
ENRICH_BOOST_MAX = 20.0
ENRICH_DESC_MAX = 800
