"""Word lists, closed sets, maps and thresholds of the feedback rules."""

# fixed values, in the order in which they are tried
CHANNELS = ["email", "survey", "call_transcript", "social_post"]
PLATFORMS = ["reddit", "x", "facebook"]
MODEL_THEMES = ["billing", "network_speed", "outage", "support_experience", "device_hardware", "pricing", "other"]
THEMES = [
    "outage", "billing", "speed_performance", "installation", "technician_visit",
    "support_experience", "app_usability", "equipment", "cancellation_retention",
]
INTENTS = [
    "complaint", "request_for_help", "outage_report", "billing_dispute",
    "feature_suggestion", "praise", "cancellation_risk", "unclassified",
]
ACTION_INTENTS = ["complaint", "request_for_help", "outage_report", "billing_dispute", "cancellation_risk"]
SENTIMENTS = ["positive", "neutral", "negative"]
PHASES = ["new", "triaged", "routed", "in_progress", "waiting", "resolved", "closed", "auto_closed"]
OPEN_PHASES = ["new", "triaged", "routed", "in_progress", "waiting"]
NEXT_PHASES = {
    "new": ["triaged"],
    "triaged": ["routed"],
    "routed": ["in_progress"],
    "in_progress": ["waiting", "resolved"],
    "waiting": ["in_progress", "resolved"],
    "resolved": ["closed"],
    "closed": [],
    "auto_closed": [],
}
RESOLUTIONS = ["resolved_by_agent", "auto_resolved", "duplicate", "known_resolved", "no_action_required", "faq_matched"]
DEPARTMENTS = [
    "Network_Operations", "Billing_Support", "Technical_Support", "Field_Operations", "Digital_Product",
    "Customer_Care", "Retention", "Social_Media_Care", "Executive_Escalations",
]
ENTITY_TYPES = [
    "service_area", "product_name", "time_reference", "dollar_amount",
    "equipment_name", "outage_mention", "competitor_mention",
]
PROFANITY = ["fuck", "shit", "ass", "damn", "bitch", "bastard", "crap", "dick", "piss", "hell"]
OUTAGE_WORDS = ["outage", "service down", "system down", "not working for everyone", "widespread issue"]
ESCALATION_WORDS = ["ceo", "executive", "lawyer", "attorney", "fcc", "regulatory", "lawsuit"]
LEGAL_WORDS = ["lawyer", "attorney", "lawsuit", "fcc", "regulatory", "legal action", "class action"]
MEDIUM_INTENTS = ["request_for_help", "billing_dispute"]
THEME_DEPARTMENT = {
    "outage": "Network_Operations",
    "billing": "Billing_Support",
    "speed_performance": "Technical_Support",
    "installation": "Field_Operations",
    "technician_visit": "Field_Operations",
    "app_usability": "Digital_Product",
    "support_experience": "Customer_Care",
    "cancellation_retention": "Retention",
}
INTENT_DEPARTMENT = {
    "outage_report": "Network_Operations",
    "billing_dispute": "Billing_Support",
    "request_for_help": "Technical_Support",
    "feature_suggestion": "Digital_Product",
    "cancellation_risk": "Retention",
}
FAQ_TOPICS = ["billing", "speed_performance", "installation", "app_usability", "equipment", "support_experience"]
KEYWORD_DEPARTMENT = [
    ("outage", "Network Operations"), ("connectivity", "Network Operations"), ("network", "Network Operations"),
    ("speed", "Network Operations"), ("slow", "Network Operations"), ("latency", "Network Operations"),
    ("bill", "Billing"), ("charge", "Billing"), ("payment", "Billing"), ("price", "Billing"), ("pricing", "Billing"),
    ("refund", "Billing"), ("install", "Field Services"), ("appointment", "Field Services"),
    ("technician", "Field Services"), ("equipment", "Technical Support"), ("router", "Technical Support"),
    ("modem", "Technical Support"), ("device", "Technical Support"), ("cancel", "Retention"),
    ("retention", "Retention"), ("churn", "Retention"), ("promotion", "Marketing"), ("praise", "Marketing"),
    ("compliment", "Marketing"), ("support", "Customer Support"), ("service", "Customer Support"),
]
DEFAULT_DEPARTMENT = "Customer Support"
LANGUAGE_HINTS = {
    "en": [
        "the", "is", "are", "was", "were", "have", "has", "been", "will", "would", "could", "should", "this", "that", "with", "from",
        "they", "your", "what", "when", "where", "which", "their", "about", "just", "like", "very", "some", "more", "also", "than",
        "other", "into", "only", "come", "made", "after", "back", "much", "then",
    ],
    "es": [
        "el", "la", "los", "las", "es", "son", "está", "están", "fue", "ser", "una", "uno", "que", "por", "con", "para", "como", "pero",
        "más", "este", "esta", "esto", "todo", "todos", "otra", "otro", "muy", "también", "puede", "desde", "donde", "cuando", "porque",
    ],
    "fr": [
        "le", "la", "les", "est", "sont", "une", "des", "que", "pour", "avec", "dans", "sur", "pas", "plus", "par", "mais", "être",
        "fait", "tout", "aussi", "comme", "bien", "très", "cette", "ces",
    ],
    "de": [
        "der", "die", "das", "ist", "sind", "ein", "eine", "und", "für", "mit", "von", "auf", "nicht", "sich", "auch", "noch", "wie",
        "oder", "aber", "nach", "wenn", "nur", "kann", "dem", "den",
    ],
    "pt": [
        "o", "os", "uma", "que", "não", "para", "com", "por", "mais", "como", "mas", "foi", "está", "ser", "tem", "seu", "sua", "isso",
        "são", "quando", "muito", "também", "pode", "entre", "depois",
    ],
}
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
WIDE_PHONE = r"\+?\d[\d\s\-().]{5,14}\d"
INITIAL_PROGRESS = {"negative": 50, "positive": 100, "neutral": 25}
NOT_NAMES = [
    "austin", "denver", "orlando", "raleigh", "charlotte", "columbus", "cincinnati", "tampa", "manhattan",
    "colorado", "texas", "florida", "york", "los", "angeles", "san", "antonio", "louis", "north", "south", "carolina",
    "ohio", "missouri", "california", "the", "wifi", "wi", "internet", "support",
]
PRAISE_CUE = (
    r"(?:[Tt]hank(?:s| you)?(?:\s+to)?|[Ss]hout\s?out(?:\s+to)?|[Kk]udos(?:\s+to)?|[Pp]rops(?:\s+to)?|[Nn]amed|[Aa]gent"
    r"|[Tt]echnician|[Tt]ech|[Ii]nstaller|[Ee]ngineer|[Ss]pecialist|[Rr]ep(?:resentative)?)\s+(?:to\s+|named\s+)?"
    r"([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})?)"
)
STATES = {
    "AL": "Alabama",
    "AK": "Alaska",
    "AZ": "Arizona",
    "AR": "Arkansas",
    "CA": "California",
    "CO": "Colorado",
    "CT": "Connecticut",
    "DE": "Delaware",
    "DC": "District of Columbia",
    "FL": "Florida",
    "GA": "Georgia",
    "HI": "Hawaii",
    "ID": "Idaho",
    "IL": "Illinois",
    "IN": "Indiana",
    "IA": "Iowa",
    "KS": "Kansas",
    "KY": "Kentucky",
    "LA": "Louisiana",
    "ME": "Maine",
    "MD": "Maryland",
    "MA": "Massachusetts",
    "MI": "Michigan",
    "MN": "Minnesota",
    "MS": "Mississippi",
    "MO": "Missouri",
    "MT": "Montana",
    "NE": "Nebraska",
    "NV": "Nevada",
    "NH": "New Hampshire",
    "NJ": "New Jersey",
    "NM": "New Mexico",
    "NY": "New York",
    "NC": "North Carolina",
    "ND": "North Dakota",
    "OH": "Ohio",
    "OK": "Oklahoma",
    "OR": "Oregon",
    "PA": "Pennsylvania",
    "RI": "Rhode Island",
    "SC": "South Carolina",
    "SD": "South Dakota",
    "TN": "Tennessee",
    "TX": "Texas",
    "UT": "Utah",
    "VT": "Vermont",
    "VA": "Virginia",
    "WA": "Washington",
    "WV": "West Virginia",
    "WI": "Wisconsin",
    "WY": "Wyoming",
}
