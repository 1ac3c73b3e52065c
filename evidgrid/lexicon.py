"""Vocabularies and limits. All of them are arguments; these are only the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------------
# Word lists, patterns and limits that results depend on. Java regex syntax;
# ``(?U)`` makes ``\b`` and ``\w`` follow Unicode.
# ---------------------------------------------------------------------------------------------

CORRECTION_PATTERN = (
    r"(?iU)\b(?:new rule|i (?:said|asked)|you (?:did not|didn't)|stop (?:doing|saying|thrashing)|"
    r"do not|don't|never again|why (?:would|did)|that's (?:wrong|not)|this is wrong|must not)\b"
)
DIRECTIVE_PATTERN = (
    r"(?iU)\b(?:must|should|always|never|do not|don't|default|prefer|only|ensure|require|"
    r"commit|merge|push|deploy|verify|test|archive|restore|remember)\b"
)
EXPLICIT_PATTERN = (
    r"(?iU)\b(?:new rule|general directives?|add (?:that|this) to (?:your )?memory|"
    r"every future interaction|always, forever)\b"
)
EXPLICIT_DURABLE_PATTERN = (
    r"(?iU)\b(?:new rule|general directives?|add (?:that|this) to (?:your )?memory|"
    r"every future interaction|always, forever|persist(?:ent|ently)?|from now on)\b"
)
EXPLICIT_REVERSAL_PATTERN = (
    r"(?iU)\b(?:new rule|no longer|supersedes?|replace the rule|from now on|"
    r"instead of (?:the )?(?:old|previous|prior|current|existing) rule)\b"
)
CHANGE_REVERSAL_PATTERN = r"(?iU)\b(?:new rule|no longer|supersedes?|replace the rule)\b"
OPT_IN_PATTERN = r"(?iU)\bonly when asked\b"
NEGATIVE_PATTERN = r"(?iU)\b(?:do not|don't|never|only when asked|must not|no longer)\b"
POSITIVE_PATTERN = r"(?iU)\b(?:by default|always|go ahead|make it so|commit|merge|push|deploy)\b"
REQUIRED_HEADING_PATTERN = r"(?iU)\b(?:required|must|critical|mandatory)\b"
EXCEPTION_PATTERN = r"(?iU)\b(?:but|except|unless|however|only if|provided that)\b"
INTENSIFIER_PATTERN = (
    r"(?iU)\b(?:always|automatically|every|immediately|must|never|only|unconditionally)\b"
)
ACTION_PATTERN = (
    r"(?iU)\b(?:archive|commit|delete|deploy|merge|publish|push|release|restore|rev|test|verify)\b"
)
CONSEQUENTIAL_PATTERN = (
    r"(?iU)\b(?:api[ -]?keys?|auth(?:entication|orization)?|credentials?|secrets?|tokens?|"
    r"permissions?|hooks?|settings(?:\.json)?|delete|overwrite|force[- ]push|"
    r"disable\s+(?:archive|backup|rollback|restore)|automatic(?:ally)?\s+"
    r"(?:deploy|publish|push|release)|cron|scheduled|event[- ]driven)\b"
)
SELF_ATTESTED_PATTERN = r"(?iU)\b(?:verified|verifying)\b"
EXTERNAL_CRITERION_PATTERN = r"(?iU)\b(?:approvals?|checks?|ci|project procedures?|tests?)\b"
INVARIANT_SUPPORT_PATTERN = r"(?iU)\b(?:always|must|never|required?|invariant)\b"
CATCH_ALL_PATTERNS = (
    r"(?U)\bother\s+applicable\s+actions?\b",
    r"(?U)\badditional\s+applicable\s+actions?\b",
    r"(?U)\band\s+similar\b",
    r"(?U)\betc\b",
    r"(?U)\band\s+so\s+on\b",
)
DECISION_NEGATIVE_PATTERN = (
    r"(?iU)\b(?:avoid|cannot|disable|do not|don't|exclude|forbid|must not|never|omit|"
    r"prohibit|stop|without)\b"
)
DECISION_POSITIVE_PATTERN = (
    r"(?iU)\b(?:always|apply|commit|deploy|enable|include|keep|merge|must|perform|publish|"
    r"push|release|require|run|use|write)\b"
)
DECISION_INCOMPATIBLE_PATTERN = (
    r"(?iU)\b(?:cannot both|choose between|either\b.{0,120}\bor|instead of|mutually exclusive|"
    r"rather than|versus|vs\.?)\b"
)
DECISION_EXCLUSIVE_PATTERN = r"(?iU)\b(?:exclusively|only|solely)\b"
NEGATED_CONTEXT_PATTERN = (
    r"(?U)\b(?:do not|don't|never|avoid|without|rather than|instead of|not)\b"
)
CLAUSE_BOUNDARY_PATTERN = r"[.;:!?\n]|,\s*(?:and|but|then)\s+"

FINGERPRINT_TOKEN = r"(?i)[a-z0-9][a-z0-9_-]*"
WORD_TOKEN = r"[\p{L}\p{N}]+"
FINGERPRINT_STOP = (
    "a an and are as at be because but by for from has have i if in is it me my of on or our so "
    "that the their them then there this to we what when which who why with you your do not only "
    "should must always never default"
).split()
BLOCK_STOP = (
    "and because but directive do does except for from however if in it may must not only or "
    "provided rule should that the this to unless when with"
).split()
ANALYST_STOP = (
    "a an and are as at be because but by do for from if in is it may must not of on or rule "
    "should that the this to when with"
).split()
DECISION_STOP = (
    "and always avoid before between cannot choice disable directive do don either exclude forbid "
    "from into must never not omit option other prohibit rather should stop than that the their "
    "this with without"
).split()
DECISION_FAMILIES = {
    "automatic": "automatic",
    "automatically": "automatic",
    "deploy": "deploy",
    "deployed": "deploy",
    "deploying": "deploy",
    "deployment": "deploy",
    "deployments": "deploy",
    "deploys": "deploy",
}
BEHAVIOR_ANCHORS = (
    "archive ask build clear commit delete deploy edit fix merge plan push release restore "
    "review test verify write"
).split()
STRONG_TERMS = ["commit", "deploy", "push", "merge"]
HIGH_IMPACT_ACTIONS = ["deploy", "merge", "publish", "push", "release"]
UNIVERSAL_SCOPE_TERMS = ["always", "every", "unconditionally"]
EXCLUDED_HEADINGS = ["api keys & secrets", "identity"]
EXCLUDED_PREFIXES = ["- push to:", "- git commits as:"]

AUTHORITY_LEVELS = (
    (1, "explicit user correction with antecedent"),
    (2, "current instruction baseline"),
    (3, "repeated user preference"),
    (4, "deterministic outcome"),
    (5, "active knowledge node"),
    (6, "auto-memory"),
    (7, "assistant inference"),
    (8, "unknown"),
)
CANDIDATE_CLASSES = (
    "contradiction",
    "temporal_supersession",
    "underspecified",
    "overspecified",
    "wrong_scope",
    "enforcement_candidate",
    "missing_rule",
)
EVIDENCE_REQUIRED_CLASSES = ("missing_rule", "temporal_supersession", "enforcement_candidate")
DOMAINS = (
    "communication",
    "coding_style",
    "documentation",
    "git",
    "privacy",
    "release",
    "research",
    "security",
    "testing",
    "tooling",
    "workflow",
    "other",
)
CLASS_WEIGHTS = {
    "contradiction": 75,
    "temporal_supersession": 72,
    "enforcement_candidate": 68,
    "wrong_scope": 64,
    "underspecified": 58,
    "overspecified": 58,
}
DEFAULT_CLASS_WEIGHT = 50
ATTENTION_OUTCOMES = (
    "drafter_rejected",
    "enforcement_candidates",
    "reviewed_noop",
    "semantic_analysis_inconclusive",
    "semantic_review_required",
)
ACTIVE_RUN_STATES = ("applied", "applying", "rolling_back", "recovery_required")
RUN_TRANSITIONS = (
    ("planned", "applying"),
    ("applying", "applied"),
    ("applying", "rolling_back"),
    ("applying", "recovery_required"),
    ("rolling_back", "rolled_back"),
    ("rolling_back", "recovery_required"),
    ("rolling_back", "rolling_back"),
    ("rolling_back", "restored"),
    ("recovery_required", "rolling_back"),
    ("applied", "rolling_back"),
)

MAX_EVENTS = 180
MAX_EXCERPT_CHARS = 700
MAX_LINE_BYTES = 1_000_000
MAX_MALFORMED_RATIO = 0.02
SIZE_FLOOR_RATIO = 0.40
SIZE_CEILING_RATIO = 1.20
SIZE_SLACK_BYTES = 4096
MAX_CHURN_RATIO = 0.65
UNATTENDED_CHURN_RATIO = 0.25
MAX_REFERENCE_DEPTH = 4
MAX_DECISION_DEPTH = 3
MAX_STEPS = 128
MAX_STEP_CHARS = 2000
MAX_RESULT_CHARS = 12_000
NEGATION_WINDOW_CHARS = 160
LEDGER_KEEP = 1000
ENTROPY_BITS = 4.25

# Terms that describe a stage gate: every group must be represented (see ``has_stage_gate``).
GATE_TERM_GROUPS = {
    "source": ("instruction", "procedure", "workflow", "repository rule", "project rule"),
    "check": ("explicit", "authoriz", "permit", "allow", "confirm", "check", "inspect"),
    "identified": (
        "loaded",
        "documented",
        "repository instruction",
        "project instruction",
        "repository rule",
        "project rule",
    ),
    "stage": ("each", "before", "per-stage", "per stage", "at any"),
    "stop": ("only where", "only when", "stop", "pause", "do not proceed"),
    "human": ("approval", "handoff", "human", "named actor", "autonomous action"),
    "order_binding": ("exact", "follow", "required by", "according to", "specified by"),
    "order_source": (
        "loaded repository",
        "loaded instruction",
        "documented workflow",
        "documented repository",
        "repository instruction",
        "repository workflow",
        "project instruction",
        "project workflow",
    ),
    "stage_local": (
        "before each action",
        "at each stage",
        "at that stage",
        "at the relevant stage",
        "per-stage",
        "per stage",
        "stage-local",
        "stage local",
        "before the action",
        "before each high-impact action",
        "before every action",
    ),
    "stage_required": (
        "project-required",
        "project required",
        "required by the project",
        "project requirements",
    ),
    "stage_applicable": ("applicable", "checks that apply", "checks apply", "apply to that action"),
    "stage_check": ("check", "ci", "test"),
    "stage_moment": (
        "before that action",
        "before each action",
        "at that stage",
        "when they exist",
        "when available",
        "at that point",
        "available before",
        "available at that stage",
        "available at each stage",
    ),
}
GATE_WORDS = (r"(?U)\border\b", r"(?U)\bavailable\b")
PREREQUISITE_PATTERNS = {
    "all": r"(?U)\ball\b",
    "ci": r"(?U)\bci\b",
    "commit": r"(?U)\bcommit(?:s|ted|ting)?\b",
    "negated": (
        r"(?U)\b(?:do not|don't|never|must not|cannot|should not)\b.{0,60}"
        r"\b(?:require|run|pass|complete|all)\b"
    ),
    "ordering": (
        r"(?U)\b(?:after|before|complete|ensure|green|if|once|pass|prior to|require|run|"
        r"succeed|then|verify|when)\b"
    ),
}
# ---------------------------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """The vocabulary an evidence job works with; pass another one for other languages."""

    correction: str = CORRECTION_PATTERN
    directive: str = DIRECTIVE_PATTERN
    explicit: str = EXPLICIT_PATTERN
    negative: str = NEGATIVE_PATTERN
    positive: str = POSITIVE_PATTERN
    exception: str = EXCEPTION_PATTERN
    required_heading: str = REQUIRED_HEADING_PATTERN
    stop: list[str] = field(default_factory=lambda: list(FINGERPRINT_STOP))
    block_stop: list[str] = field(default_factory=lambda: list(BLOCK_STOP))
    anchors: list[str] = field(default_factory=lambda: list(BEHAVIOR_ANCHORS))
    strong: list[str] = field(default_factory=lambda: list(STRONG_TERMS))
    excluded_headings: list[str] = field(default_factory=lambda: list(EXCLUDED_HEADINGS))
    excluded_prefixes: list[str] = field(default_factory=lambda: list(EXCLUDED_PREFIXES))
    min_token_chars: int = 3
    fingerprint_tokens: int = 28


DEFAULT_LEXICON = Lexicon()
