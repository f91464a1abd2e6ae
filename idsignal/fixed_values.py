"""Values that results depend on: word lists, thresholds, messages, formats.

They are part of the data contract, not design choices, so they are stated
here as plain text and used by name everywhere else.
"""

# -- fixed values: parsing ----------------------------------------------------
UNKNOWN = "unknown"
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
JSON_WHITESPACE = " \t\n\r"
IPV4_TOKEN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV4_SHAPE = r"^[0-9]{1,3}([.][0-9]{1,3}){3}$"
IAM_SOURCE = "iam.amazonaws.com"
BLANK_WORDS = ["nan", "none", "", "null"]
BLANK_IPS = ["", "-", "unknown", "none", "nan"]
# (what the text must look like, how it is read)
TIME_FORMATS = [
    ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "yyyy-M-d H:m:s"),
    ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
]

# -- fixed values: risk rules -------------------------------------------------
SENSITIVE_ACTIONS = [
    "CreateAccessKey", "DeleteAccessKey", "AttachUserPolicy", "AttachRolePolicy",
    "PutUserPolicy", "CreateUser", "DeleteUser", "DeleteTrail", "StopLogging",
]
ELEVATED_ACTIONS = ["ConsoleLogin", "AssumeRole", "CreateLoginProfile"]
TAMPERING_ACTIONS = ["DeleteTrail", "StopLogging"]
INTERNAL_PREFIXES = ["10.", "172.", "192.168."]

SENSITIVE_POINTS = 50
ELEVATED_POINTS = 25
FAILURE_POINTS = 20
EXTERNAL_POINTS = 15
TAMPERING_POINTS = 30
RISK_CAP = 100

SENSITIVE_REASON = "Sensitive IAM action detected: "
ELEVATED_REASON = "High-risk IAM activity detected: "
FAILURE_REASON = "Failed authentication detected"
EXTERNAL_REASON = "External source IP detected: "
TAMPERING_REASON = "CloudTrail tampering detected"

PRIORITY_FLOORS = [("CRITICAL", 80), ("HIGH", 60), ("MEDIUM", 35)]
LOWEST_PRIORITY = "LOW"
PRIORITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

RECOMMENDATIONS = {
    "CRITICAL": [
        "Review IAM activity immediately",
        "Revoke suspicious credentials",
        "Force MFA reset",
        "Block malicious IP",
    ],
    "HIGH": [
        "Investigate user session",
        "Verify if activity is authorized",
        "Monitor additional IAM activity",
    ],
}
DEFAULT_RECOMMENDATIONS = ["Continue monitoring"]

# -- fixed values: reputation and score buckets -------------------------------
REPUTATION_STEPS = [(10, 1), (30, 3), (60, 6), (80, 8)]  # (confidence below, score)
REPUTATION_TOP = 10
NO_REPUTATION = "NA"
FUSION_STEPS = [("CRITICAL", 0.85), ("HIGH", 0.6), ("MEDIUM", 0.3)]  # strictly above
PRIORITY_CODES = [("LOW", 0), ("MEDIUM", 1), ("HIGH", 2), ("CRITICAL", 3)]

# -- fixed values: row validation ---------------------------------------------
REQUIRED_FIELDS = ["user_id", "action_id", "ip_id", "result", "alert_score", "prelim_priority"]
VALID_PRIORITIES = ["LOW", "MEDIUM", "HIGH"]
SCORE_RANGE = (0, 10)
MISSING_FIELD = "Missing required field: "
BAD_NUMBER = "could not convert string to float: "
BAD_SCORE = "Alert score must be between 0 and 10"
BAD_PRIORITY = "Invalid prelim_priority value"
BAD_IP = "Invalid IP format: "
VALID = "Valid"

# -- fixed values: report texts -----------------------------------------------
FEED_NAMES = {
    "backup": "Backup Service Account",
    "level6": "Production IAM Role",
    "securitymonkey": "Security Monitor Bot",
    "admin": "Admin Account",
    "unknown": "Unidentified User",
}
INSIGHT_NAMES = {
    "backup": "Backup Service Account",
    "Level6": "Production IAM Role",
    "securityMonkey": "Security Monitor Bot",
    "admin": "Admin Account",
}
DASH = "—"
LOCKDOWN_ADVICE = ("🚨 High risk activity detected for ", ". Recommend MFA review or session lockdown.")
REVIEW_ADVICE = ("⚠️ Review ", "'s actions — repeated high-priority alerts from ", ".")
NORMAL_ADVICE = ("✅ Normal pattern detected for ", ", no immediate action required.")
NO_INSIGHTS = ("System", "No data available to generate insights.")
NO_FINDINGS = "No log data available"
ENTITY_STEPS = [
    (0.7, "🚨 High-risk IAM behavior detected. Recommend MFA review or session lockdown."),
    (0.4, "⚠️ Elevated access pattern observed. Recommend permission audit."),
]
ENTITY_NORMAL = "✅ Normal IAM activity observed. No immediate action required."
SAFE = "SAFE"
