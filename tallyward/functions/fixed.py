"""Word lists, code points and patterns whose hits must be the same in every engine.

Patterns are in the syntax of ``text.wide``: ``\\s`` is wide white space, ``@`` any
character that ends no line, letters match in either case and classes are ASCII.
"""

from __future__ import annotations

# ---------------------------------------------------------------- names (survey R6, R25)

GENERIC_NAMES = ["run", "execute", "exec", "query", "do", "process", "handle", "call", "invoke", "action", "perform", "task", "go", "main", "operation", "op", "command", "cmd", "tool", "helper", "util", "misc", "generic", "request", "submit", "use"]

DESTRUCTIVE_VERB = "(?:delete|remove|destroy|drop|purge|wipe|erase|terminate|kill|uninstall|truncate|revoke)[ds]?"

# ---------------------------------------------------------------- hidden characters (survey F6-F11)

ZERO_WIDTH = [0x00AD, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x2061, 0x2062, 0x2063, 0x2064, 0x3164, 0xFFA0]
BIDI_CONTROL = [0x061C, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069]
TAGS = (0xE0000, 0xE007F)
SELECTORS, SELECTORS_SUPPLEMENT = (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)
BLACK_FLAG = 0x1F3F4
FLAG_REGION = "[a-z]{2}[a-z0-9]{2,3}"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]"
# control and operating system commands, with introducers of 7 and 8 bits, and two-character escapes (ECMA-48)
ESCAPE_SEQUENCE = r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)?|\x1b[@-Z\-_]|\x9b[0-?]*[ -/]*[@-~]|\x9d[^\x07\x9c]*[\x07\x9c]?"

# ---------------------------------------------------------------- prompt injection (survey R21)

OVERRIDE = "instruction override"
CONCEAL = "concealment from the user"
BLOCK = "<IMPORTANT> block"
ORDERING = "forced tool ordering"

INJECTIONS = [
    (OVERRIDE, r"ignore\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+instructions?"),
    (OVERRIDE, r"disregard\s+(all\s+|any\s+)?(previous|prior|above)\s+instructions?"),
    (OVERRIDE, r"\b(?:override|ignore|replace|disregard|bypass|forget)\b@{0,30}\b(?:system\s+prompt|system\s+instructions|developer\s+message)\b"),
    (CONCEAL, r"do\s+not\s+tell\s+(the\s+)?user"),
    (CONCEAL, r"without\s+(telling|informing|notifying)\s+the\s+user"),
    (CONCEAL, r"don'?t\s+(let|allow)\s+the\s+user\s+(know|see)"),
    (CONCEAL, r"\b(?:do\s+not|don'?t|never)\s+(?:mention|reveal|disclose)\b[^.]{0,60}\bto\s+the\s+user\b"),
    (CONCEAL, r"\b(?:do\s+not|don'?t|never)\s+(?:mention|reveal|disclose|tell\s+(?:the\s+)?user)\s+that\s+you\b"),
]
IMPORTANT_OPEN, IMPORTANT_CLOSE = "<important>", "</important>"
ORDERINGS = [
    r"you\s+must\s+always\s+call\s+this\s+tool\s+first",
    r"this\s+is\s+(a\s+)?(mandatory|required)\s+(first\s+)?step",
]

# ---------------------------------------------------------------- credentials (survey R22)

EXFILTRATION = "exfiltration instruction"
STORE = "credential store"
FOREIGN = "instructions about another server's tool"
HIDDEN = "hidden text"

STORES = [
    ("~/.ssh", r"~/\.ssh\b"),
    ("SSH private key", r"\.ssh/id_[a-z0-9]+"),
    ("AWS credentials file", r"~/\.aws/credentials"),
    ("/etc/passwd or /etc/shadow", r"/etc/(passwd|shadow)\b"),
    ("credentials dotfile", r"(?:~|\$HOME)/\.(?:netrc|npmrc|pgpass|git-credentials)\b"),
    ("cluster/registry/GitHub credentials", r"(?:~|\$HOME)/\.(?:kube/config|docker/config\.json|config/gh/hosts\.yml)\b"),
    ("Google Cloud credentials", r"application_default_credentials\.json"),
    ("MCP client config (holds other servers' credentials)", r"""(?:\.cursor|\.vscode|\.codeium|\.claude|\.config)[\\/][^\s"'`]*mcp\.json\b|(?<!\w)\.mcp\.json\b|claude_desktop_config\.json"""),
]

OBTAIN = r"(?:(?:read|open|cat|load|fetch|retrieve|copy|grab|collect|access)(?:e?s|ing)?|look(?:s|ing)?\s+(?:at|in|up))"
LOCAL_SECRET = (
    r"(?:~/\.ssh|\.ssh/id_[a-z0-9]+|\bid_(?:rsa|ed25519|ecdsa)\b|~/\.aws/credentials|/etc/(?:passwd|shadow)"
    r"|(?:~|\$HOME)/\.(?:netrc|npmrc|pgpass|git-credentials|kube/config|docker/config\.json|config/gh/hosts\.yml)"
    r"|application_default_credentials\.json|\bmcp\.json\b|claude_desktop_config\.json"
    r"|(?<![A-Za-z0-9_])\.env\b|\benv(?:ironment)?\s+file\b|\bsystem\s+prompt\b|\b(?:conversation|chat)\s+history\b)"
)
PASS_ON = r"(?:pass|send|include|put|add|append|attach|forward|encode|embed|upload|post|paste|write|insert|place|e?mail|transmit|exfiltrate|share|submit)(?:e?s|ing)?"
EXFILTRATES = rf"\b{OBTAIN}\b[^\n]{{0,80}}?{LOCAL_SECRET}(?s:.){{0,200}}?\b{PASS_ON}\b"

# ---------------------------------------------------------------- other servers' tools (survey R23)

COERCION = r"(?:must\s+always|must\s+never|always\s+call|never\s+call|must\s+call|required\s+to\s+call)"
TOOL_NAME = "[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)+"
COERCES = rf"\b{COERCION}\b"
NAMED_TOOL = rf"\bthe\s+`?({TOOL_NAME})`?\s+tool\b|\btool\s+`?({TOOL_NAME})`?|\b{COERCION}\s+`?({TOOL_NAME})`?"

# ---------------------------------------------------------------- blobs and URLs (survey R24)

BASE64 = "(?:[A-Za-z0-9+/]{4}){20,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"
NO_BLOB_FIELD = r"\$(?:ref|id|schema|anchor)\Z"
URL = r"""https?://[^\s"'<>]+"""
URL_TAIL = r"[.,;:!?)\]]+\Z"
SUSPICIOUS_HOST = r"\b\d{1,3}(?:\.\d{1,3}){3}\b|\.(?:xyz|top|zip|click|gq|tk)\b|bit\.ly|tinyurl\.com"
LOCAL_HOST = r"https?://(?:127\.\d{1,3}\.\d{1,3}\.\d{1,3}|0\.0\.0\.0|10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})(?::\d+)?(?:[/?#]|\Z)"

# ---------------------------------------------------------------- schemas (survey F24, F32)

NUMBER_MENTION = r"(?<![\w.,+-])[-+]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:e[-+]?[0-9]+)?(?!\w|[.,][0-9])"
DIALECTS = {
    "06": "http://json-schema.org/draft-06/schema",
    "07": "http://json-schema.org/draft-07/schema",
    "2019-09": "https://json-schema.org/draft/2019-09/schema",
    "2020-12": "https://json-schema.org/draft/2020-12/schema",
}
