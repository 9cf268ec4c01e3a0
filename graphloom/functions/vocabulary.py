"""Vocabularies: what text must hold to count as a signal, and the open enumerations."""

# They must equal those that existing graphs were built with.
NODE_TYPES = ["concept", "person", "decision", "pattern", "bug", "convention", "initiative", "tool", "meeting", "rule"]

RELATIONSHIPS = [
    "relates_to", "depends_on", "belongs_to", "authored_by", "mentioned_in", "supersedes", "learned_from", "evolved_into", "conflicts_with", "blocked_by",
]

IMPORTANCE = {
    "architectural decision": 0.9, "design decision": 0.9, "key decision": 0.9, "breaking change": 0.9, "security": 0.85, "root cause": 0.85, "blocked": 0.8,
    "bug": 0.7, "fix": 0.7, "pattern": 0.7, "convention": 0.7, "rule": 0.7, "initiative": 0.65, "milestone": 0.65,
    "decision": 0.6, "action item": 0.6, "created": 0.5, "updated": 0.5, "implemented": 0.5,
    "meeting": 0.3, "discussed": 0.3, "mentioned": 0.2, "register": 0.2,
}

NOVELTY = {
    "breakthrough": 0.95, "insight": 0.9, "discovery": 0.9, "unexpected": 0.85, "surprise": 0.85, "first time": 0.8, "new": 0.6, "never": 0.6,
    "workaround": 0.7, "learned": 0.65, "realized": 0.65, "correction": 0.6, "changed": 0.4, "updated": 0.3,
}

SENSITIVE = {
    3: (["1on1", "1:1", "private", "dm", "direct-message"], "source:private/1on1/dm"),
    2: (["confidential", "strategy", "sensitive", "security"], "source:confidential/strategy"),
    1: (["observation", "finding", "internal"], "source:observation/finding"),
}

DECISION_WORDS = ["decided", "agreed", "chose", "going with", "settled on", "key decision", "design decision"]
ACTION_WORDS = ["created", "updated", "built", "implemented", "fixed", "deployed", "published", "posted", "sent"]

ENTITY_KEYWORDS = {
    "person": ["mentioned", "said", "asked", "responded", "messaged", "posted", "reviewed"],
    "decision": ["decided", "agreed", "chose", "approved", "settled on", "going with", "won't"],
    "bug": ["bug", "broken", "fix", "error", "crash", "regression", "root cause", "workaround"],
    "pattern": ["pattern", "convention", "best practice", "anti-pattern", "always", "never", "should"],
    "concept": ["architecture", "system", "framework", "model", "approach", "strategy"],
    "initiative": ["initiative", "project", "feature", "epic", "story", "sprint", "milestone"],
    "tool": ["tool", "cli", "mcp", "skill", "agent", "plugin", "extension", "library"],
    "meeting": ["meeting", "standup", "sync", "review", "demo", "retrospective", "hub hour"],
    "rule": ["rule", "constraint", "must not", "always use", "never use", "workaround"],
    "convention": ["naming", "format", "style", "convention", "standard", "template"],
}

#: In order of priority; the third is the type that the target must have where types are enforced.
RELATION_PHRASES = [
    ("depends_on", ["depends on", "requires", "needs", "blocked by", "waiting for"], None),
    ("relates_to", ["related to", "connects to", "similar to", "see also", "cf."], None),
    ("supersedes", ["replaces", "supersedes", "obsoletes", "instead of", "no longer"], None),
    ("learned_from", ["learned from", "discovered in", "found during", "came from"], None),
    ("belongs_to", ["part of", "belongs to", "under", "within", "inside"], None),
    ("authored_by", ["created by", "authored by", "built by", "designed by", "wrote"], "person"),
    ("mentioned_in", ["mentioned in", "discussed at", "came up in", "raised during"], "meeting"),
    ("evolved_into", ["evolved into", "became", "grew into", "led to", "resulted in"], None),
    ("conflicts_with", ["conflicts with", "contradicts", "incompatible with", "clashes with"], None),
]

TOOL_KEYWORDS = [
    "kubernetes", "docker", "terraform", "ansible", "jenkins", "github", "gitlab", "azure", "aws", "gcp", "redis", "postgres", "mongodb",
    "graphql", "webpack", "vite", "eslint", "prettier", "jest", "vitest", "typescript", "python", "rust", "golang", "nodejs", "react", "angular",
    "vue", "svelte", "nextjs", "express", "fastapi", "django", "flask", "sqlite", "onnx", "gliner", "tree-sitter", "copilot",
    "bicep", "powershell", "bash", "git", "npm", "pip", "cargo",
]

NOT_PEOPLE = [
    "Red PI", "Hub Hour", "Mission Control", "Key Vault", "Service Bus", "Azure DevOps", "Private Link", "Teams MCP", "Daily Report", "Session Handover",
    "Phase 1", "Phase 2", "Phase 3", "Phase 4",
]

NOT_NAMES = [
    "System", "Built", "Framework", "Decision", "Architecture", "Ecosystem", "Restructure", "Report", "Pipeline", "Integration", "Research",
    "Session", "Handover", "Vision", "Morning", "Evening", "Afternoon", "Night", "Memory", "Consolidation", "Heartbeat", "Domain", "Patching",
    "Lifecycle", "Description", "Feature", "Populated", "Diagnosed", "Fixed", "Expansion", "Recap", "Update", "Notes", "Audit", "Rewrite",
    "Connectivity", "Actions", "Patch", "Control", "Graph", "Sync", "Code", "Data", "Tool", "Skill", "Agent", "Rule", "Convention", "Pattern", "Bug",
    "Sprint", "Backlog", "Setup", "Config", "Status", "Deployment", "Orchestration", "Convergence", "Breakthough", "Day", "Refinement", "Established",
    "Analyzed", "Discovered", "Updated", "Created", "Calendar", "Channel", "Chat", "Message", "Personal", "Recurring", "Security", "Credential",
    "Geneva", "Private", "Instance", "Coast", "Pulse", "Time", "Dark", "Scheduler", "Task", "Windows", "Uses", "Setting", "Line", "Descriptions",
    "Multi", "Azure", "Connection", "Preview", "Public", "Key", "Value", "Table", "West", "East", "North", "South",
]

GARBAGE = [
    "person", "people", "bug", "bugs", "bugfix", "tool", "tools", "pattern", "patterns", "decision", "decisions", "rule", "rules", "meeting",
    "meetings", "initiative", "concept", "convention", "open", "closed", "fixed", "done", "pending", "blocked", "error", "warning", "issue", "issues",
    "feature", "features", "code", "data", "file", "files", "config", "setup", "update", "system", "module", "service", "api", "cli", "ui", "test",
    "tests", "build", "deploy", "run", "start", "stop", "true", "false", "null", "undefined", "none", "yes", "no", "ok", "the", "this", "that",
    "real tools", "reparse",
]

GENERIC_CODE_NAMES = [
    "service", "execute", "created", "domain", "output", "module", "resource", "config", "default", "common", "location", "result", "client",
    "context", "options", "request", "response", "handler", "provider", "factory", "builder", "helper", "manager", "worker", "monitor", "status",
    "source", "target", "deploy", "update", "delete", "create",
]

#: Phrases that announce a decision, a bug or a pattern, and the capitalised phrase that must follow.
SIGNALS = [
    ("decision", r"(?i:\b(?:decided to|agreed on|chose|approved|settled on|going with)\b)"),
    ("bug", r"(?i:\b(?:bug in|broken|crash(?:es|ed)?|regression|root cause|workaround for)\b)"),
    ("pattern", r"(?i:\b(?:pattern for|best practice|convention|anti-pattern|always use|never use)\b)"),
]
#: Words one of which stands, in lower case, wherever a signal of the kind does.
SIGNAL_WORDS = {
    "decision": ["decided to", "agreed on", "chose", "approved", "settled on", "going with"],
    "bug": ["bug in", "broken", "crash", "regression", "root cause", "workaround for"],
    "pattern": ["pattern for", "best practice", "convention", "anti-pattern", "always use", "never use"],
}
SIGNAL_TAIL = r"^\s+(?:the\s+)?([A-Z][A-Za-z0-9 ]+?)(?:[.,;:\n]|$)"

#: The dates at the end of a remembered bullet, between asterisks or bare.
DATED_STARRED = r"\s*-\s*\*(?:corrected|learned):\s*(\d{4}-\d{2}-\d{2})(?:,\s*reinforced:\s*(\d{4}-\d{2}-\d{2}))?\s*\*\s*$"
DATED_BARE = r"\s*-\s*(?:corrected|learned):\s*(\d{4}-\d{2}-\d{2})(?:,\s*reinforced:\s*(\d{4}-\d{2}-\d{2}))?\s*$"

# Fixed values of notes: what begins a section, its parts, an item, an action and a done one.
SECTION = r"^##\s+"
SECTION_DATE = r"^(\d{4}-\d{2}-\d{2})(?:\s+\d{2}:\d{2})?"
PARTS = [("notes", r"(?i)^###\s+notes"), ("decisions", r"(?i)^###\s+decisions"), ("next_steps", r"(?i)^###\s+next\s+steps"), ("raw", r"^###\s+")]
ITEM = r"^\s*-\s+(.+)"
DONE = r"(?i)^✅|^\(✅|\[x\]"
DONE_MARK = r"(?i)^✅\s*|^\(✅\s*\)\s*|\[x\]\s*"
ACTION = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*?)\s*:\s+(.+)"
ACTION_OF_TWO = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*\+\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*:\s+(.+)"
OPEN_HEAD, DONE_HEAD = r"(?i)^##\s+Open", r"(?i)^##\s+Done"

# Words that are no keywords of a prompt.
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "must", "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "they", "them",
    "their", "this", "that", "these", "those", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into", "about", "between",
    "through", "after", "before", "above", "and", "or", "but", "not", "no", "nor", "so", "if", "then", "than", "what", "which", "who", "whom",
    "how", "when", "where", "why", "all", "each", "every", "both", "few", "more", "most", "some", "any", "just", "also", "very", "too", "only",
    "still", "already", "even", "here", "there", "up", "out", "over", "now", "get", "make", "like", "know", "think", "see", "come", "go", "want",
    "use", "find", "tell",
]
