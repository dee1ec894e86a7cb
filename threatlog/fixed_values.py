"""Fixed values.

Everything in this module is a value that has to be exactly so for the results to
be right: severities, rule identifiers and texts, search patterns, thresholds, field
aliases and time layouts.  There is no logic here.
"""

# Severity names and their scores.
SEVERITY = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

# Severity names from worst to mildest, the order of every severity table.
SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

# Java flags for every pattern below: ignore case, Unicode classes, only \n ends a line.
# Log-line patterns are case-sensitive, so they leave out the first flag.
THREAT_FLAGS = "(?iUd)"
LINE_FLAGS = "(?Ud)"

# Threat patterns.
SQL_INJECTION = (
    r"(?:union[\s+]+select|select\s+.*from|insert\s+into|drop\s+table"
    r"|--\s*$|;\s*--|'\s*or\s+'1'='1|1=1|exec\s*\(|xp_cmdshell)"
)
CROSS_SITE_SCRIPT = r"(?:<script[^>]*>|javascript:|onerror=|onload=|eval\(|alert\(|document\.cookie)"
PATH_TRAVERSAL = r"\.\.[\\/]|%2e%2e[\\/]|%252e"
SCANNER = r"(?:nikto|sqlmap|nmap|masscan|zgrab|nuclei|dirbuster|gobuster)"
SENSITIVE_PATH = r"(?:/admin|/phpmyadmin|/actuator|/api/v\d+/admin)"
FILE_INCLUSION = r"(?:=https?://|=ftp://|/etc/passwd|/etc/hosts|/win\.ini|boot\.ini)"
COMMAND_INJECTION = (
    r"(?:[;&|`]\s*(?:cat|wget|curl|ping|id|whoami|uname|sh|bash|powershell|cmd\.exe)\b|\$\(.*\))"
)
WEB_SHELL = r"(?:shell\.php|cmd\.php|c99\.php|r57\.php|eval-stdin\.php|backdoor\.php|shell\.jsp|cmd\.jsp|cmd\.aspx)"
CONFIG_FILE = r"(?:\.env|\.git/config|wp-config\.php|database\.yml|config\.json|settings\.py|backup\.sql|dump\.sql|\.bak|\.sql)"

# Phrases that make a line an authentication failure (rule R006).
AUTH_FAILURE_PHRASES = (
    "failed password",
    "authentication failure",
    "invalid user",
    "failed login",
    "unauthorized",
)

# Words that make a line count for the brute-force counter (rule R008).
FAILURE_WORDS = ("failed", "invalid", "failure")

# Statuses that mean "not let in".
DENIED_STATUSES = (401, 403)

# Row rules: id, name, severity, description, evidence prefix.
# {ip}, {user} and {status} stand for the fields of the line.
ROW_RULE_TEXTS = (
    ("R001", "SQL Injection Attempt", "HIGH", "Possible SQLi in request from {ip}", "Matched SQLi: "),
    ("R002", "XSS Attempt", "MEDIUM", "Possible XSS payload from {ip}", "Matched XSS: "),
    ("R003", "Path Traversal Attempt", "HIGH", "Directory traversal detected from {ip}", "Matched traversal: "),
    ("R004", "Sensitive Path Access", "MEDIUM", "Access to sensitive admin/management resource by {ip}", "Path: "),
    ("R005", "Security Scanner Detected", "HIGH", "Known vulnerability scanner UA from {ip}", "Scanner UA: "),
    ("R006", "Authentication Failure", "LOW", "Login failure for user '{user}' from {ip}", "Failure log: "),
    ("R007", "Server Error", "LOW", "HTTP {status} response logged", "Status {status} message: "),
    ("R011", "LFI/RFI Attempt", "HIGH", "Possible Local/Remote File Inclusion from {ip}", "Matched LFI/RFI: "),
    ("R012", "Command Injection Attempt", "HIGH", "Possible command injection from {ip}", "Matched command injection: "),
    ("R013", "Web Shell Access Attempt", "HIGH", "Web shell file access detected from {ip}", "File: "),
    ("R014", "Sensitive Config Access", "HIGH", "Access to configuration/backup file from {ip}", "File: "),
)

# Burst rules: id, name, severity, counter, threshold, alert step, description, evidence.
# {n}, {ip}, {minutes} and {start} stand for the peak, the address, the window length and its first time.
BURST_RULE_TEXTS = (
    ("R008", "Brute Force Attack", "CRITICAL", "fail", 5, 5,
     "Brute force: {n} failed logins from {ip} in {minutes}min",
     "{n} failures in {minutes} minutes starting at {start}"),
    ("R009", "Directory Scanning", "HIGH", "not_found", 20, 10,
     "Directory scan: {n} 404s from {ip} in {minutes}min",
     "{n} 404 responses in {minutes} minutes starting at {start}"),
    ("R010", "Possible DoS Attack", "CRITICAL", "request", 200, 50,
     "High request rate: {n} reqs from {ip} in {minutes}min",
     "{n} requests in {minutes} minutes starting at {start}"),
)
WINDOW_MINUTES = 5

# Line patterns.  Groups: access = ip, user, time, method, path, status;
# ssh = time, outcome, user, ip; syslog and generic = time, message.
ACCESS_LINE = r'(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+) \S+" (\d{3})'
SSH_LINE = (
    r"(\w{3}\s+\d+\s+\d+:\d+:\d+).*?(Failed|Accepted|Invalid)\s+"
    r"(?:password|publickey)?\s*for\s+(?:invalid user\s+)?(\S+)\s+from\s+(\S+)"
)
SYSLOG_LINE = r"(\w{3}\s+\d+\s+\d+:\d+:\d+)\s+\S+\s+\S+:\s+(.*)"
GENERIC_LINE = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})\s+(.*)"
IP_ADDRESS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"

# JSON field aliases, first filled one wins.
JSON_ALIASES = {
    "ip": ("ip", "client_ip", "host"),
    "user": ("user", "username"),
    "path": ("path", "uri", "url", "request"),
    "method": ("method", "request_method"),
    "status": ("status", "response_code"),
    "message": ("message", "msg"),
    "time": ("timestamp", "time", "@timestamp"),
}

# Numbers above this are epoch milliseconds, others epoch seconds.
EPOCH_MILLIS_ABOVE = 1e11

# Lengths of the text taken as message, and shown as evidence.
MESSAGE_CHARS = 200
EVIDENCE_CHARS = 200
SHORT_EVIDENCE_CHARS = 100
EVIDENCE_CAP = 5

# Layout detection: candidate delimiters in order, share of JSON lines that makes a JSON log, column patterns.
DELIMITERS = ("|", ",", "\t", ";")
JSON_SHARE = 0.7
STATUS_TOKEN = r"^\b[1-5]\d{2}\b$"
METHOD_TOKEN = r"^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$"
PATH_TOKEN = r"^/[a-zA-Z0-9_\-\.\/]*$"

# Lines of context kept with an alert, the alert line included.
CONTEXT_LINES = 15

# Risk bands: lowest score, band.
RISK_BANDS = ((75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM"))
RISK_CAP = 100

# Line colouring: a line is HIGH, MEDIUM or LOW by these patterns, else ok.
LOW_LINE = r"failed|invalid user|unauthorized"

# Marked parts of evidence per rule: pattern, ignore case.
EVIDENCE_MARKS = {
    "R001": (r"(union[\s+]+select|select|from|insert|drop|--|'|1=1)", True),
    "R002": (r"(script|onerror|onload|eval|alert|cookie)", True),
    "R003": (r"(\.\.\/|\.\.\\)", False),
    "R011": (r"(http:\/\/|https:\/\/|\/etc\/passwd|win\.ini|boot\.ini)", True),
    "R012": (r"(whoami|id|cat|wget|curl|sh|bash)", True),
    "R013": (r"(shell\.php|cmd\.php|cmd\.jsp)", True),
    "R014": (r"(\.env|config\.json|database\.yml)", True),
}

# Blanks cut off both ends of a line.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
