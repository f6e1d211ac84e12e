"""Fixed word lists, patterns and constants.

Everything here is a fixed value that results depend on; nothing is derived.
"""

import string

# --- fixed values: stop words of the indexer -------------------------------
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall", "can", "need", "dare", "ought", "to", "of", "in",
    "for", "on", "with", "at", "by", "from", "as", "into", "about", "between", "through", "after", "before", "above",
    "below", "and", "but", "or", "nor", "not", "so", "yet", "both", "either", "neither", "each", "every", "all",
    "any", "few", "more", "most", "other", "some", "such", "no", "only", "own", "same", "than", "too", "very", "just",
    "also", "now", "then", "here", "there", "when", "where", "why", "how", "what", "which", "who", "whom", "this",
    "that", "these", "those", "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her", "it",
    "its", "they", "them", "their", "tell", "know", "think", "say", "get", "make", "go", "see", "come", "take",
    "give", "find", "let", "put", "keep",
]

# --- fixed values: stop words used when matching recurring events ----------
EVENT_STOP_WORDS = [
    "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "they", "them", "a", "an", "the", "is", "was",
    "are", "were", "be", "been", "have", "has", "had", "do", "did", "will", "would", "could", "should", "may",
    "might", "to", "of", "in", "on", "at", "by", "for", "with", "and", "or", "but", "so", "yet", "if", "this", "that",
    "these", "those", "there", "here", "what", "when", "where", "who", "how", "why", "which", "go", "went", "get",
    "got", "s", "t", "re", "ll", "ve", "d", "yesterday", "today", "tomorrow", "morning", "afternoon", "evening",
    "night", "tonight", "now", "just", "ago", "back", "last", "next", "some", "all", "up", "out", "over", "new",
    "like", "very",
]

# --- fixed values: stop words of the second retrieval hop ------------------
HOP_STOP_WORDS = [
    "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "they", "them", "a", "an", "the", "is", "was",
    "are", "were", "be", "been", "have", "has", "had", "do", "did", "will", "would", "could", "should", "may",
    "might", "to", "of", "in", "on", "at", "by", "for", "with", "and", "or", "but", "so", "yet", "if", "this", "that",
    "these", "those", "there", "here", "what", "when", "where", "who", "how", "why", "which", "go", "went", "get",
    "got", "s", "t", "re", "ll", "ve", "d", "work", "works", "live", "lives", "name", "called", "known",
]

# --- fixed values: punctuation trimmed from both ends of a word ------------
PUNCTUATION = string.punctuation + (
    "‘’‚‛“”„‟–—―…"
    "«»‹›·•‣"
)

# --- fixed values: override signals ----------------------------------------
OVERRIDE_WORDS = ["exclusively", "switched", "anymore"]
OVERRIDE_PHRASES = ["no longer", "not anymore", "switched to"]

# --- fixed values: synonyms added at indexing and query time ---------------
SYNONYMS = {
    "husband": ["married", "spouse"],
    "wife": ["married", "spouse"],
    "spouse": ["married", "husband", "wife"],
    "daughter": ["child", "girl"],
    "son": ["child", "boy"],
    "child": ["daughter", "son"],
    "children": ["daughter", "son", "kids"],
    "university": ["graduated", "college", "degree", "school", "studied", "masters", "bachelor"],
    "college": ["graduated", "university", "degree", "school", "studied"],
    "school": ["graduated", "university", "college", "studied"],
    "undergrad": ["graduated", "university", "college", "bachelor", "degree"],
    "education": ["graduated", "university", "college", "degree", "studied", "masters"],
    "role": ["title", "position", "job", "engineer", "manager", "director", "vp", "cto", "ceo"],
    "title": ["role", "position", "job", "engineer", "manager", "director", "vp"],
    "job": ["work", "role", "title", "position", "company"],
    "position": ["role", "title", "job", "work"],
    "hobby": ["hobbies", "interests", "enjoy", "love", "favorite"],
    "hobbies": ["hobby", "interests", "enjoy", "love", "favorite"],
    "allergy": ["allergic", "intolerant", "sensitive"],
    "allergies": ["allergic", "intolerant", "sensitive"],
    "car": ["drive", "vehicle", "tesla", "toyota", "honda"],
    "vehicle": ["car", "drive"],
    "home": ["house", "apartment", "address"],
    "house": ["home", "apartment", "property"],
    "salary": ["compensation", "pay", "income", "earning"],
    "email": ["mail", "contact", "address"],
    "phone": ["call", "number", "mobile", "cell"],
    "birthday": ["born", "birth", "age"],
    "age": ["old", "years", "born"],
}

# --- fixed values: category patterns, tried in this order ------------------
CATEGORIES = {
    "Identity": r"\b(name|called|i am|i'm|born|from|live|based|nationality|age|old)\b",
    "Preference": r"\b(prefer|like|love|hate|enjoy|dislike|favourite|favorite|don't like|want)\b",
    "Work": r"\b(work|job|role|company|employer|position|career|profession|office|salary)\b",
    "Project": r"\b(build|building|startup|product|project|launch|app|platform|startup|mvp)\b",
    "Relationship": r"\b(wife|husband|partner|friend|colleague|team|family|brother|sister|son|daughter|manager|boss)\b",
    "Goal": r"\b(goal|plan|want to|trying|aim|vision|mission|target|milestone)\b",
    "Temporal": r"\b(yesterday|today|tomorrow|last week|next week|deadline|schedule|meeting|remind)\b",
    "Context": r"\b(remember|note|context|background|mentioned|told|said|asked|discussed)\b",
}

# --- fixed values: visitor intent keywords ---------------------------------
DEVELOPER_SIGNALS = [
    "api", "sdk", "integrate", "code", "build", "install", "npm", "pip", "docker", "deploy",
    "endpoint", "webhook", "python", "javascript", "fastapi", "langchain", "crewai",
    "framework", "library", "package",
]
FOUNDER_SIGNALS = [
    "startup", "product", "saas", "users", "customers", "ship", "launch", "mvp", "pricing",
    "scale", "revenue", "business", "app", "platform", "chatbot", "support bot", "ai product",
    "remember",
]
RESEARCH_SIGNALS = [
    "paper", "neuroscience", "cls", "hippocampus", "neocortex", "consolidation", "mcclelland",
    "memory theory", "cognitive", "research", "academic", "architecture", "dual store",
    "schema", "phase",
]

# --- fixed values: question prefixes ---------------------------------------
QUESTION_STARTS = ["what", "who", "where", "when", "how", "which", "is my", "do you"]
QUESTION_ONLY_STARTS = [
    "what is my", "what's my", "where do i", "where am i", "who am i", "do you know my",
    "tell me my", "what do you know", "can you tell me", "do you remember",
]

# --- fixed values: sentences about the user, and boiler-plate --------------
YOU_KEYWORDS = [
    "you ", "your ", "you've", "you are", "you were", "you like", "you prefer", "you work",
    "you use", "you have", "you're",
]
ASSISTANT_SKIP = [
    "i don't", "i do not", "however", "if you'd like", "let me know", "feel free",
    "i can help", "is there anything",
]
NOISE_FRAGMENTS = [
    "personalization in progress", "connecting…", "try again",
    "the following facts were learned", "use this as background context",
    "the user has shared the following", "to monitor your current usage", "[schema:", "[memory — verified", "treat them as ground truth", "verified user facts",
    "how can i help you", "is there anything else", "let me know if", "do you have any",
    "feel free to", "i'd be happy to", "i don't have details", "i don't have specific",
    "i don't have information", "if you'd like to share", "i can help you with",
    "what would you like", "is there something specific",
]

# --- fixed values: starter facts for a namespace without memories ----------
STARTER_FACTS = [
    "The sun rises in the east and sets in the west.",
    "Water boils at 100 degrees Celsius at sea level.",
    "The Earth orbits the Sun once every 365.25 days.",
    "Light travels at approximately 300,000 kilometers per second.",
    "There are 7 continents: Asia, Africa, North America, South America, Antarctica, Europe, and Australia.",
    "The human brain has approximately 86 billion neurons.",
]

# --- fixed values: memory dynamics -----------------------------------------
KT = 1.0
LAMBDA = 0.5
TAU_CRITICAL = 10.0
TAU_DEFAULT = 50.0
TAU_OVERRIDE = 200.0
TAU_SCHEMA = 400.0
STRENGTH_FLOOR = 0.05
CAPACITY = 1000
BETA = 0.15
SIGMA_MAX = 13.815510557964274  # -ln(1e-6)
LN2 = 0.6931471805599453
ABSORB_COVERAGE = 0.6
FIXED_POINT_COVERAGE = 0.8
MIN_GROUP = 3
MIN_FIXED_TOKENS = 2
MAX_GROUP = 10
K_CRITICAL = 0.15

# --- fixed values: promotion -----------------------------------------------
PLASTICITY = {"salience": 1.0, "usage": 0.3, "authority": 0.5, "conflict": 0.7, "surprise": 0.4}
L1_THRESHOLD = 1.5
L2_THRESHOLD = 2.2
L2_MIN_CONFIDENCE = 0.85
L2_MIN_DAYS = 5
DECAY_K = 0.1
PRUNE_SALIENCE = 0.2
SIMILARITY_THRESHOLD = 0.7
CONFLICT_THRESHOLD = 0.3
QUORUM_THRESHOLD = 0.8

# --- fixed values: tiers, prices, rates and unit costs ---------------------
TIERS = ["free", "pro", "business", "enterprise"]
TIER_CAPS = {"free": 1000, "pro": 50000, "business": 200000, "enterprise": 1000000}
TIER_ITEMS = {"free": 500, "pro": 50000, "business": 200000, "enterprise": 1000000}
TIER_NAMESPACES = {"free": 1, "pro": 10, "business": 50, "enterprise": 500}
TIER_RATE_LIMITS = {"free": 20, "pro": 100, "business": 1000, "enterprise": 5000}
TIER_PRICES = {"free": 0.0, "pro": 9.0, "business": 29.0, "enterprise": 149.0}
OVERAGE_CENTS = {"free": 0, "pro": 2, "business": 1, "enterprise": 0}
FREE_LAUNCH_CAP = 8000
FREE_POST_TRIAL_CAP = 800
WINDOW_CAPS = {"hour": 120, "day": 1000, "week": 4000, "month": 8000}
WINDOW_SECONDS = {"hour": 3600, "day": 86400, "week": 604800, "month": 2592000}
UNIT_COSTS = {
    "write": 0.0001, "encode": 0.0001, "read": 0.00005, "retrieve": 0.00005, "search": 0.0001,
    "knowledge": 0.00005, "delete": 0.00001, "adjudication": 0.0005, "prewarm": 0.0001,
    "chat_message": 0.0005, "embedding": 0.0002, "hippocampal_replay": 0.0005,
    "l2_promotion": 0.0003, "consolidation": 0.001, "context_injection": 0.0001,
    "llm_token_in": 0.000003, "llm_token_out": 0.000015, "ext_write": 0.00005,
    "ext_search": 0.00005, "ext_context_injection": 0.00008, "ext_memory_fetch": 0.00002,
    "ext_delete": 0.00001, "ext_download": 0.0, "ext_llm_proxy_openai": 0.0005,
    "ext_llm_proxy_anthropic": 0.0005, "storage_per_item_month": 0.00001,
}
ACTOR_KINDS = ["user", "ext", "ns", "api_key", "system"]

# --- fixed values: user pulse ----------------------------------------------
PULSE_WEIGHTS = {
    "error_5xx": 22, "rage_retry": 20, "thumbs_down": 30, "quota_block": 14, "error_4xx": 9,
}
PULSE_WINDOW = 900
RETRY_WINDOW = 60

# --- fixed values: abuse guard ---------------------------------------------
PROBE_FRAGMENTS = [
    "/wp-login.php", "/wp-admin", "/xmlrpc.php", "/.env", "/.git/", "/admin.php",
    "/phpmyadmin", "/phpunit", "/vendor/phpunit", "/.aws/credentials", "/config.php",
    "/shell.php", "/cgi-bin/", "/.ssh/", "/owa/auth", "/solr/", "/actuator/env",
    "/eval-stdin.php",
]
EXEMPT_PREFIXES = [
    "/health", "/v1/health", "/v1/memory/health", "/docs", "/redoc", "/openapi.json",
]
ABUSE_RULES = {  # signal: (threshold, window seconds)
    "auth_fail": (20, 300), "burst": (200, 10), "path_scan": (8, 300), "malformed": (30, 300),
}
BLOCK_SECONDS = 86400

# --- fixed values: calendar names ------------------------------------------
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
]
