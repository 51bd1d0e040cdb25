"""Lists, patterns and texts that results depend on.

Everything here is data with an agreed value; changing an entry changes results.
Patterns are written without flags; the operators add them.
"""

# Choices of the generated access log.
DOMAINS = [
    "google.com", "meta.com", "amazon.com", "deloitte.com", "mckinsey.com",
    "walmart.com", "target.com", "nike.com", "apple.com", "microsoft.com",
    "goldmansachs.com", "jpmorganchase.com", "bcg.com", "bain.com",
]
ENDPOINTS = [
    "/resume", "/resume/experience", "/resume/skills", "/resume/education",
    "/resume/certifications", "/analytics/queries", "/analytics/top-domains",
]
SKILLS = [
    "Python", "SQL", "BigQuery", "API Design", "Cloud", "Agile",
    "Terraform", "AWS", "Docker", "CI/CD", "JavaScript", "React",
]

# Skills endpoint and the search parameter in its query string.
SKILLS_ENDPOINT = "/resume/skills"
KEYWORD_PARAM = r"keyword=([^&]+)"

# Request headers that carry the funnel columns.
FUNNEL_HEADERS = {
    "session_id": "x-session-id",
    "search_campaign": "x-search-campaign",
    "traffic_source": "x-traffic-source",
    "funnel_stage": "x-funnel-stage",
    "device_type": "x-device-type",
    "geo_region": "x-geo-region",
}

# Personal-data patterns of the document anonymiser, in order.
DOCUMENT_CODE_RULES = [
    (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE REDACTED]"),
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "[EMAIL REDACTED]"),
    (r"https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_-]+/?", "[LINKEDIN REDACTED]"),
    (r"\b\d+\s+[A-Z][a-z]+\s+(?:St|Ave|Blvd|Dr|Rd|Ln|Way|Ct)\b", "[ADDRESS REDACTED]"),
]
DOCUMENT_CLEARANCE_RULES = [
    (r"\bTop Secret/?SCI\b", "[CLEARANCE LEVEL]"),
    (r"\bTS/?SCI\b", "[CLEARANCE LEVEL]"),
    (r"\bSecret\s+clearance\b", "[CLEARANCE LEVEL]"),
]
DOCUMENT_PII_RULES = [*DOCUMENT_CODE_RULES, *DOCUMENT_CLEARANCE_RULES]
# What each match of a code rule holds: a digit, an at sign, the start of a link.
CODE_MARK = r"[\d@]|://"

# Organisation patterns and their descriptors, in order.
ORGANISATION_RULES = [
    (r"\bDeloitte\b", "a Big Four professional services firm"),
    (r"\bConsulting Firm B\b", "a mid-size technology consulting firm"),
    (r"\bMeta\b", "a top-3 social media conglomerate"),
    (r"\bFacebook\b", "a top-3 social media conglomerate"),
    (r"\bDell\b", "a Fortune 100 technology manufacturer"),
    (r"\bKroger\b", "a top-5 US grocery retailer"),
    (r"\bExelon\b", "a Fortune 100 energy utility"),
    (r"\bWake Forest\b", "a regional academic medical center"),
    (r"\bFinancial Services Program\b", "a multi-state community banking group"),
    (r"\bNGA\b", "a federal defense intelligence agency"),
    (r"\bDoD\b", "the Department of Defense"),
    (r"\bDoJ\b", "the Department of Justice"),
    (r"\bRiot Games?\b", "a major gaming company"),
    (r"\bRiot\b", "a major gaming company"),
    (r"\bGoogle\b", "a leading technology company"),
    (r"\bgTech\b", "a technical solutions division at a leading technology company"),
    (r"\bBCG\b", "a top-3 management consulting firm"),
    (r"\bBoston Consulting Group\b", "a top-3 management consulting firm"),
    (r"\bBoeing\b", "a Fortune 50 aerospace and defense company"),
    (r"\bFanDuel\b", "a leading sports technology company"),
    (r"\bJP Morgan\b", "a top-3 global financial institution"),
    (r"\bJPMorgan\b", "a top-3 global financial institution"),
    (r"\bKPMG\b", "a Big Four professional services firm"),
    (r"\bWavestone\b", "a European management consulting firm"),
    (r"\bGuidehouse\b", "a federal technology consulting firm"),
    (r"\bTwelveLabs\b", "an AI video understanding startup"),
    (r"\bExtraHop\b", "a network security analytics company"),
    (r"\bPortswigger\b", "a web security tooling company"),
    (r"\bMoody'?s\b", "a global financial analytics company"),
    (r"\bBloomberg\b", "a global financial data company"),
    (r"\bCare\s*First\b", "a regional health insurance provider"),
    (r"\bBlue Cross\b", "a national health insurance provider"),
    (r"\bRecorded Future\b", "a threat intelligence company"),
    (r"\bLogic\s*20/?20\b", "a federal IT services company"),
    (r"\bL20\s*20\b", "a federal IT services company"),
    (r"\bbeacon\s*hills?\b", "a technology staffing firm"),
    (r"\bFairly\b", "a proptech startup"),
    (r"\bVacasa\b", "a vacation rental management company"),
    (r"\bMicroStrategy\b", "an enterprise BI platform"),
    (r"\bOracle\b", "an enterprise database and cloud company"),
    (r"\bPeopleSoft\b", "a legacy HR management system"),
]

# What replaces an interviewer's name, the transcript credit
# lines that are dropped, and the name a file gets when nothing is left.
INTERVIEWER_LABEL = "the interviewer"
CREDIT_LINE_ANY_CASE = r"^.*otter\.ai.*$"
CREDIT_LINE_AS_WRITTEN = r"^.*Transcribed by.*$"
CREDIT_MARK, CREDIT_WORDS = r"otter\.ai", "Transcribed by"  # what each holds
FILENAME_SUFFIX = r"_otter_ai"
FILENAME_COPY_NUMBER = r"\(\d+\)"
EMPTY_FILENAME = "interview_transcript"

# Personal-data patterns of the answer filter, in order.
ANSWER_PII_RULES = [
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "[email redacted]"),
    (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "[phone redacted]"),
    (r"https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_-]+/?", "[linkedin redacted]"),
    (r"\b\d+\s+[A-Z][a-z]+\s+(?:St|Ave|Blvd|Dr|Rd|Ln|Way|Ct)\b", "[address redacted]"),
]

# Kinds of personal data reported by the detector, in order.
PII_KINDS = [
    (r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b", "SSN pattern"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "Phone number"),
    (r"\b\d{5}(?:[-]\d{4})?\b", "ZIP code"),
    (r"\b\d+\s+[A-Z][a-z]+\s+(?:St|Ave|Blvd|Dr|Rd|Ln|Ct|Way)\b", "Street address"),
]
WITHHELD_MESSAGE = (
    "I generated a response but my safety filter caught something "
    "that looked like personal information. Let me try answering "
    "that differently — could you rephrase your question?"
)

# Prompt-injection patterns, in the order they are tried.
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"system\s*prompt",
    r"you\s+are\s+now\s+",
    r"pretend\s+(you\s+are|to\s+be)",
    r"jailbreak",
    r"DAN\s+mode",
    r"act\s+as\s+(if\s+you\s+are|a\s+)",
    r"disregard\s+(all|your|previous)",
    r"\[INST\]|\[SYS\]|<\|im_start\|>",
    r"reveal\s+(your|the)\s+(system|hidden|secret)",
    r"what\s+are\s+your\s+instructions",
    r"repeat\s+(the\s+)?(above|previous)\s+(text|instructions|prompt)",
]

# Lower-case phrases that make a message suspicious.
SUSPICIOUS_PHRASES = [
    "ignore your instructions",
    "ignore previous instructions",
    "disregard your prompt",
    "new instructions:",
    "system prompt:",
    "you are now",
    "pretend you are",
    "act as if",
    "override your",
    "forget your rules",
]

# Lower-case keywords that route a question to a tier.
ARCHITECTURE_KEYWORDS = [
    "architecture", "architected", "stack", "tech stack", "how is this built",
    "how is the system built", "how was this built", "deployed", "deployment",
    "infrastructure", "cloud run", "docker", "gemini", "chroma", "rag",
    "embedding model", "vector store", "n8n", "cloud build", "ci/cd",
    "workload identity",
]
BEHAVIOURAL_KEYWORDS = [
    "behavioral", "tell me about a time", "interview", "star method",
    "leadership", "conflict", "mistake", "weakness", "disagreement",
    "prioritize", "ambiguity", "ideal work",
]

# Tier name -> prefix of its chunk ids.
TIER_PREFIXES = {"resume": "chunk", "interview": "iv", "architecture": "arch"}

# Headings of the context sections and the chunk separator.
CONTEXT_HEADINGS = {
    "resume": "[RESUME FACTS]",
    "interview": "[INTERVIEW PATTERNS — use only for behavioral questions]",
    "architecture": "[SYSTEM ARCHITECTURE]",
}
CHUNK_SEPARATOR = "\n\n---\n\n"
ITEM_SEPARATOR = "\n---\n"

# Role tags looked for in résumé file names, in order.
ROLE_TAGS = ["product", "pm", "consulting", "cloud"]

# Acknowledgements of the two recruiter actions.
CONTACT_FIELDS = ["recruiter_email", "company", "message", "role"]
SHORTLIST_FIELDS = ["list_name", "priority"]
CONTACT_MESSAGE = (
    "Contact request logged. This is a portfolio demo — no actual message is sent."
)
SHORTLIST_MESSAGE = "Candidate added to shortlist. This is a portfolio demo."

# Mail labels and the subject of a mail without one.
JUNK_LABELS = ["CATEGORY_PROMOTIONS", "CATEGORY_UPDATES"]
ANSWERED_LABELS = ["bot-replied", "auto-replied"]
DEFAULT_SUBJECT = "(no subject)"

# The characters Python counts as white space, as a string and
# as a pattern.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
