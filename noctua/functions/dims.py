"""Constants of the data model: enums, policy per memory type, word lists, patterns."""

from __future__ import annotations

#: The time at which registered queries look at the data; operators never read the clock.
AS_OF = "2026-07-01"

# Fixed values of the data model.
DOMAINS = ("work", "planphysique", "personal", "family", "finance", "research")
MEM_TYPES = ("fact", "decision", "preference", "entity", "episode")
TASK_STATUSES = ("created", "classified", "planned", "running", "waiting_for_tool", "waiting_for_approval", "resuming", "verifying", "completed", "failed", "cancelled", "partially_completed")
ACTIVE_STATUSES = ("running", "resuming", "verifying", "waiting_for_tool")
TERMINAL_STATUSES = ("completed", "failed", "cancelled", "partially_completed")
PROPOSAL_STATUSES = ("pending", "approved", "discarded", "auto_applied")
KINDS = ("agent", "automation", "mcp", "plugin", "prompt", "routine", "skill", "workflow")
#: Days after which recency falls to a half; 180 for types not named.
HALF_LIFE = {"fact": 180, "decision": 730, "preference": 365, "entity": 365, "episode": 30}
#: Days after which a memory turns stale by default, and after which an episode expires.
STALE_AFTER = {"fact": 180, "preference": 365, "entity": 365, "episode": 90}
EPISODE_TTL, CAPTURE_TTL = 90, 30
SHORT_BODY_TYPES, SHORT_BODY = ("fact", "decision", "preference"), 1200
SWEPT_TYPES = ("fact", "entity", "preference")
AUTO_APPLY_DOMAINS = ("work", "research")
SUBDIRS = {"decision": "decisions", "episode": "episodes"}
KIND_CONFIDENCE = {"skill": 0.9, "plugin": 0.92, "agent": 0.82, "routine": 0.86, "workflow": 0.84, "prompt": 0.82, "mcp": 0.88, "automation": 0.72}
KIND_RANK = {"skill": 0, "plugin": 1, "agent": 2, "routine": 3, "workflow": 4, "prompt": 5, "mcp": 6, "automation": 7}

# Words that a search leaves out.
SEARCH_STOPWORDS = (
    "a an and are is of or the to what when where which who why che chi come cosa della delle il la un"
).split()
# Words that say nothing about a claim.
SUPPORT_STOPWORDS = (
    "about also and are che come con cosa dei del della delle enable enables for from gli has have include includes including into its nel nella nelle "
    "offre offrono offers per provide provides sono support supports that the their this those through una uno was were which with your comprende comprendono anche"
).split()
# Placeholders of documentation, and patterns of secrets, injected instructions, sensitive matters.
PLACEHOLDERS = ("YOUR_API_TOKEN", "YOUR_SIGNED_JWT", "YOUR_PASSWORD", "__TOKEN__", "<TOKEN>", "<PASSWORD>")
BEARER_PROSE = r"(?i)\bbearer\s+(api\s+)?token\b"
SECRETS = (
    r"(?i)AKIA[0-9A-Z]{16}",
    r"(?i)-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY",
    r"(?i)(password|passwd|pwd)\s*[:=]\s*\S+",
    r"(?i)bearer\s+[A-Za-z0-9\-._~+/]+=*",
    r"(?i)eyJ[A-Za-z0-9_-]{10,}\.eyJ",
    r"[0-9a-fA-F]{64,}",
)
INJECTIONS = (r"(?i)ignore\s+previous\s+instructions", r"(?i)always\s+run", r"(?i)you\s+are\s+now", r"(?i)system\s*prompt")
SENSITIVE = r"(?i)\b(salary|stipendio|ral|iban|bank account|conto corrente|health|salute|medical|medico|diagnos|disabilit|legal case|contenzioso|codice fiscale|social security)\b"
# Verbs that make a goal risky.
HIGH_RISK = ("push", "merge", "deploy", "delete", "remove", "drop", "rm -rf", "send email", "send", "publish", "pay", "payment", "invoice", "force push")
MEDIUM_RISK = ("commit", "branch", "pull request", "pr", "write", "create file", "modify", "update", "install")
# Points of a claim for what it mentions.
CLAIM_POINTS = {
    "authentication": 30, "oauth": 28, "jwt": 28, "compatibility date": 24, "required": 18, "requires": 18, "must": 16, "supports": 14, "recommended": 14,
    "deprecated": 18, "only": 10, "enable": 8, "disable": 8, "endpoint": 8, "header": 8, "identity": 10, "conversation": 6, "timeout": 8, "idempotency": 16,
}
DECISION_PHRASES = ("we decided", "it was decided", "approved decision", "we agreed")
# Signals in manifests, in the order in which they are asked; providers likewise.
KIND_SIGNALS = (
    ("workflow", ("n8n", "n8n-nodes-")),
    ("prompt", ("prompt", "template")),
    ("workflow", ("workflow", "langgraph", "dag", "pipeline")),
    ("agent", ("agent", "autogen", "crewai", "langgraph", "openai-agents", "semantic-kernel")),
    ("automation", ("automation", "playwright", "script", "scrape", "runner")),
)
MCP_SIGNALS = ("mcp", "modelcontextprotocol", "@modelcontextprotocol/sdk")
PROVIDER_SIGNALS = (
    ("claude", ("claude", "anthropic")), ("gemini", ("gemini", "@google/genai", "google-generativeai")), ("openai", ("openai", "gpt")), ("crewai", ("crewai",)),
    ("langgraph", ("langgraph",)), ("autogen", ("autogen",)), ("n8n", ("n8n",)), ("mcp", ("mcp", "modelcontextprotocol")), ("playwright", ("playwright",)),
)
MANIFEST_TAGS = ("agent", "autogen", "claude", "crewai", "gemini", "langgraph", "mcp", "n8n", "openai", "playwright", "prompt", "workflow")
SCRIPT_PRIORITY = ("agent", "workflow", "prompt", "mcp", "n8n", "start", "dev", "run")
SCRIPT_NAMES = ("agent", "automation", "playwright", "prompt", "routine", "workflow")
SCRIPT_EXTENSIONS = ("js", "mjs", "py", "sh", "ts", "tsx")
KIND_EXTENSIONS = {
    "agent": ("json", "md", "py", "toml", "ts", "tsx", "yaml", "yml"),
    "automation": ("js", "mjs", "py", "sh", "ts", "tsx"),
    "mcp": ("json", "md", "py", "toml", "ts"),
    "plugin": ("json", "md", "toml"),
    "prompt": ("json", "md", "txt", "yaml", "yml"),
    "routine": ("js", "json", "md", "mjs", "py", "sh", "ts", "txt", "yaml", "yml"),
    "workflow": ("js", "json", "md", "mjs", "py", "sh", "ts", "txt", "yaml", "yml"),
}
NOISE_DIRS = (".git", ".idea", ".next", ".turbo", "coverage", "dist", "node_modules", "target", "venv")
NOISE_FILES = ("package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "tsconfig.json", "pyproject.toml", "poetry.lock", "Cargo.toml", "Cargo.lock")
