"""Word lists, markers and patterns that results depend on."""

from __future__ import annotations

# Fixed values. Terms that carry no content.
STOPWORDS = (
    "about after again also and are assistant because been before being but can could does for from have how into its just "
    "more not please should that the their then there these they this user was what when which will with would you your "
    "conversation help need using work review analysis design result results approach project title call must fictional"
).split()

# Fixed values. Phrases that mark a sentence or a text.
QUESTION_MARKERS = ("unresolved", "open question", "still need", "remains to", "not yet", "defer", "follow up")
DECISION_MARKERS = ("decided", "decision", "we will", "switch to", "adopt", "keep", "drop", "defer", "pivot")
GOAL_MARKERS = ("goal", "aim", "requirement", "hypothesis", "objective", "want to")
REVERSAL_MARKERS = ("reversal", "reframe", "revised", "changed direction", "instead of", "no longer", "abandon", "pivot", "weakened", "disappeared")
RESUMPTION_MARKERS = ("resumed", "reactivated", "returned to", "after the hiatus")
MILESTONE_MARKERS = ("completed", "shipped", "validated", "milestone")
INITIATION_MARKERS = ("start", "initial", "first prototype")

# Fixed values. Conversation types in order of precedence, with the phrases that tell them.
CONVERSATION_TYPES = (
    ("troubleshooting", ("traceback", "error", "failed", "debug")),
    ("implementation", ("create", "implement", "write", "build")),
    ("decision support", ("recommend", "compare", "should i", "best")),
    ("explanation and inquiry", ("why", "explain", "describe", "what is")),
)
DEFAULT_TYPE = "general discussion"

# Fixed values. Temporal roles in order of precedence.
TEMPORAL_ROLES = (
    ("resumption", RESUMPTION_MARKERS),
    ("reversal or reframing", REVERSAL_MARKERS),
    ("milestone", MILESTONE_MARKERS),
    ("initiation", INITIATION_MARKERS),
)

# Fixed values. Broad domains and their keywords.
DOMAINS = (
    ("Scientific and Technical Work", "analysis bioinformatics biology code data github model notebook python research science software".split()),
    ("Health and Wellbeing", "anxiety doctor health medical medication sleep symptom treatment".split()),
    ("Music, Arts, and Culture", "art bach book composition literature midi music piano".split()),
    ("Career, Learning, and Finance", "career education finance interview job learn resume salary".split()),
    ("Home and Practical Life", "apartment car drive fan home mac plant storage".split()),
    ("Society, History, and Ideas", "bible history humanity philosophy politics religion society universe".split()),
)
DEFAULT_DOMAIN = "General and Personal Conversations"

# Fixed values. Patterns.
TOKEN = r"[A-Za-z][A-Za-z0-9_+-]{2,}"
HANDLE = r"\b(?:[a-z][a-z0-9]+(?:[-_][a-z0-9]+)+|[A-Za-z0-9_-]+\.(?:py|json|parquet|ipynb|md|csv|mid|midi|wav|pdf))\b"
SENTENCE_END = r"(?<=[.!?])\s+"

# Fixed values. Safety rules: a match of the first group excludes, of the second asks for review.
EXCLUDE_RULES = (
    ("credential", r"(?i)(?:api[_ -]?key|password|secret)\s*[:=]\s*\S{6,}"),
    ("intimate", r"(?i)\b(intimate|dating|sexual|breakup|my partner)\b"),
    ("medical", r"(?i)\b(my diagnosis|my medication|therapist|mental health)\b"),
    ("financial", r"(?i)\b(my debt|financial hardship|cannot pay rent|account number)\b"),
    ("explicitly-private", r"(?i)\b(mark this private|do not share|confidential personal)\b"),
)
REVIEW_RULES = (
    ("workplace", r"(?i)\b(my manager|workplace grievance|coworker complaint)\b"),
    ("personal", r"(?i)\b(family conflict|religious belief|political belief|address)\b"),
)
PRIORITIES = {"exclude": 0.95, "review": 0.7, "include": 0.2}
REASONS = {
    "exclude": "A local high-risk pattern indicates this conversation needs private handling.",
    "review": "Context may be professionally sensitive; review before sharing.",
    "include": "No narrow high-risk local rule matched; manual review is still recommended.",
}

# Fixed values. What a text keeps when its middle is left out.
OMISSION = "\n\n[... middle omitted by deterministic character limit ...]\n\n"
KEY_VERSION = "semantic-conversation-v1"

# Fixed values. Enumerations of the archive.
ROLES = ("system", "developer", "user", "assistant", "tool", "unknown")
TEXT_BLOCKS = ("text", "markdown", "code", "unknown")
REASONING_BLOCKS = ("thinking_trace", "reasoning_summary")
REFERENCE_BLOCKS = ("file_reference", "image_reference", "audio_reference")
