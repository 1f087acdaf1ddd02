"""Rule-based classifiers as column expressions. The word lists and patterns are fixed values of the query semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loopwright.functions.text import bigrams, half_up, split_space

# The lists, patterns and their order below are what classifies; they must stay as they are for right results.
POSITIVE = [
    "excellent", "amazing", "brilliant", "fantastic", "wonderful", "incredible", "awesome", "perfect", "great", "nice", "superb", "outstanding",
    "terrific", "love it", "nailed it", "well done", "good job", "great job", "nice work", "stellar", "phenomenal", "remarkable", "splendid",
    "beautiful", "magnificent",
]
NEGATIVE = [
    "wrong", "broken", "terrible", "awful", "horrible", "bad", "frustrated", "annoying", "useless", "disappointed", "fail", "failure", "disaster",
    "mess", "garbage", "waste",
]
SESSION_CORRECTIONS = ["no ", "wrong", "stop ", "not like that", "i didn't ask", "that's not", "incorrect", "fix that", "that's wrong"]
SESSION_APPROVALS = ["yes", "perfect", "exactly", "great", "good", "go for it", "that's right", "correct", "nice", "love it"]
DEBRIEF_APPROVALS = ["perfect", "yes exactly", "great work", "love it", "keep doing that", "nice", "that's right", "excellent", "well done", "nailed it", "go for it"]
COUNTED = (
    r"^(?:10|[1-9])\s+(?:items?|files?|steps?|times?|things?|of\b|bugs?|issues?|errors?|warnings?|tasks?|projects?|versions?|minutes?|hours?|days?|seconds?|people|users?|more|left|remaining|total|pages?|lines?|commits?|tests?|prs?|tickets?|runs?|ways?|options?|modules?|components?|endpoints?|queries?|rows?|columns?|fields?|records?)\b"
)
CORRECTIONS = [
    (r"\bno[,.]?\s+not\s+(?:like\s+)?that\b", 7),
    (r"\bstop\s+doing\s+", 8),
    (r"\bstop\s+(?!by\b|at\b|for\b|to\b|and\b|the\b|in\b)", 6),
    (r"\bthat'?s\s+(?:not\s+what|wrong)", 7),
    (r"\bi\s+didn'?t\s+ask\s+(?:for|you)", 8),
    (r"\bdon'?t\s+do\s+that\b", 7),
    (r"\bwrong\b(?!\s+(?:with|about|way)\s+(?:the|a|my|your))", 6),
    (r"\bincorrect\b", 6),
    (r"\bnot\s+(?:right|correct)\b", 5),
    (r"\byou\s+missed\b", 5),
    (r"\btoo\s+much\b", 4),
    (r"\bbad\s+approach\b", 7),
]
NOISE = [
    r"\bno\s+problem\b",
    r"\bno\s+worries\b",
    r"\bno\s+rush\b",
    r"\bno\s+need\b",
    r"\bno\s+thanks\b",
    r"\bno\s+big\s+deal\b",
    r"\bnot\s+(?:yet|now|sure|necessarily)\b",
    r"\bstop\s+(?:by|at|for|to|in)\b",
    r"\bdon'?t\s+worry\b",
    r"\bdon'?t\s+(?:forget|mind)\b",
    r"\bperfect\b",
    r"\bnice\b",
    r"\bgreat\s+work\b",
    r"\byes\s+exactly\b",
    r"\bthat'?s\s+right\b",
    r"\bgood\s+job\b",
    r"\bwell\s+done\b",
    r"\bexactly\s+right\b",
    r"\blove\s+it\b",
    r"\bawesome\b",
]
ASSERTIONS = [
    r"can'?t (?:run|access|connect|reach|execute|scrape|use) (?:from |on |locally|here)",
    r"only (?:works?|runs?|available) (?:on|from|in|at) ",
    r"not possible (?:from|on|to run|to access)",
    r"(?:requires?|needs?) .{3,40} (?:to run|to work|to access|to scrape)",
    r"(?:won'?t|cannot|unable to) (?:work|run|execute|connect) (?:from|on|here|locally)",
    r"no (?:way to|ability to) (?:run|access|connect|scrape) ",
    r"(?:doesn'?t|does not) (?:have|support) .{3,30} (?:auth|access|session|credentials)",
]
EVIDENCE = [
    r"error:",
    r"(?:tried|attempted|ran|executed) (?:it|the|and)",
    r"(?:verified|confirmed|checked) (?:that|by|with)",
    r"(?:output|result|response) (?:shows?|was|is|returned)",
    r"exit (?:code|status) \d",
    r"actually (?:got|received|saw|returned)",
    r"the (?:actual|real) (?:error|issue|problem|blocker)",
    r"here'?s? (?:what|the error)",
    r"stack ?trace",
    r"failed (?:with|because)",
]
INCIDENTS = [
    (r"Exit code [^0\s]", "non-zero-exit"),
    (r"exit status [^0\s]", "non-zero-exit"),
    (r"returned non-zero", "non-zero-exit"),
    (r"TypeError", "TypeError"),
    (r"SyntaxError", "SyntaxError"),
    (r"Error:", "Error"),
    (r"error:", "error"),
    (r"\bFAILED\b", "FAILED"),
    (r"\bfailed\b", "failed"),
    (r"Exception", "Exception"),
    (r"Cannot find", "Cannot find"),
    (r"not found", "not found"),
    (r"(?i)permission denied", "permission denied"),
]
TOOLS = {"Read": "file-read", "Write": "file-write", "Edit": "file-write", "NotebookEdit": "file-write", "Bash": "shell", "WebSearch": "search", "WebFetch": "web", "Skill": "skill", "Agent": "agent"}
SEVERITIES = [(5, ["hard stop", "zero exceptions", "critical"]), (4, ["never", "always", "mandatory"]), (3, ["must", "required", "important"]), (2, ["should", "prefer", "typically"])]
MEMORY_TYPES = {
    "episodic": [r"\bfound\b", r"\bdiscovered\b", r"\boccurred\b", r"\bhappened\b", r"\bconfirmed\b", r"\bbroke\b", r"\bfailed\b", r"\bincident\b", r"\bsession\b.*\b(revealed|showed|exposed)\b"],
    "procedural": [r"\balways\b", r"\bnever\b", r"\bmust\b", r"\bstep\s*\d", r"\bworkflow\b", r"\bprocess\b", r"\bsequence\b", r"\bbefore\b.*\bafter\b", r"\bfirst\b.*\bthen\b", r"\bpipeline\b"],
    "semantic": [r"\buser\s+(is|prefers|uses|wants)\b", r"\bproject\s+(uses|has|requires)\b", r"\bsystem\s+(is|uses|has)\b", r"\barchitecture\b", r"\bpreference\b", r"\bfact\b", r"\bconfiguration\b"],
}
BEHAVIOURAL = [
    "verify", "read", "check", "confirm", "validate", "test", "before", "always", "never", "must", "surgical", "evidence", "ask", "first", "ensure",
    "review", "inspect",
]
PROCEDURAL = [
    "run", "spawn", "invoke", "execute", "after", "when", "trigger", "fire", "launch", "call", "deploy", "rebuild", "use", "apply", "switch", "route",
    "queue",
]
COHORTS = [
    ("testing", ["verify", "assert", "claim", "check", "confirm", "evidence"]),
    ("delegation", ["delegate", "agent", "team", "escalate", "routing", "spawn"]),
    ("scope", ["scope", "incomplete", "wrong", "misread", "missing", "partial", "delivery", "complete"]),
    ("process", ["test", "deploy", "build", "pipeline", "loop", "workflow", "process", "gate"]),
    ("delivery", ["communicate", "context", "unclear", "misunderstand", "ask", "clarify"]),
]
#: Rebuttals by cohort; the first and the last key match no cohort's name.
REBUTTALS = {
    "verification": "Name every source checked. If fewer than 2 independent sources, it's incomplete",
    "scope": "Re-read the original request. Check every named item was addressed",
    "delegation": "Read the agent's actual output. Grep for hedged claims",
    "process": "Tests verify code correctness, not feature correctness. Check the actual UI/output",
    "communication": "Re-read the exact request. Present interpretations before picking one",
}
INJECTIONS = [r"(?i)ignore\s+(all\s+)?previous\s+instructions", r"(?i)you\s+are\s+now\s+", r"(?i)act\s+as\s+(a\s+)?", r"(?i)system\s*:\s*", r"(?i)\[INST\]", r"(?i)<<SYS>>", r"(?i)<\|im_start\|>"]
ACKS = ["yes", "no", "sure", "ok", "right", "yeah", "yep", "nah", "another claude session", "got it", "go ahead", "do it", "sounds good", "let's go", "proceed", "continue"]
GARBAGE = ["context:", "<local-command-caveat>", "analyze these source file changes"]
VERBS = [
    "fix", "add", "build", "ship", "create", "implement", "debug", "investigate", "refactor", "update", "remove", "deploy", "migrate", "test",
    "review", "configure", "optimize", "replace", "wire", "integrate", "delete", "merge", "rewrite", "extract", "move",
]
HARVEST_CORRECTIONS = [r"actually,?\s+", r"wait,?\s+", r"no,?\s+i meant", "let me clarify", r"that's not (quite )?right", "you misunderstood", "i was wrong", "my mistake"]
HARVEST_ERRORS = ["error:", "failed:", "exception:", "stderr:", "command failed", "permission denied"]
HARVEST_INSIGHTS = ["learned that", "realized that", "discovered that", "key insight", "important:", "note to self", "for next time", "lesson:"]
SYSTEM = ["hook|crash|broken", "tool|config|deploy|path", "import|module|file.*not.*found", "typescript|javascript|npm|bun"]
APPROACH = ["over.?engineer", "wrong approach", "should have asked", "didn't follow", "missed the point", "too complex", "didn't understand", "wrong direction", "not what i wanted", "approach|method|strategy|reasoning"]
LEARNING = ["problem|issue|bug|error|failed|broken", "fixed|solved|resolved|discovered|realized|learned", "troubleshoot|debug|investigate|root cause", "lesson|takeaway|now we know|next time"]
EXTENSIONS = {
    ".tsx": "frontend", ".jsx": "frontend", ".css": "frontend", ".scss": "frontend", ".vue": "frontend", ".svelte": "frontend", ".sql": "database", ".prisma": "database",
    ".ts": "code", ".js": "code", ".py": "code", ".go": "code", ".rs": "code", ".md": "documentation", ".yaml": "config", ".yml": "config", ".json": "config", ".toml": "config",
    ".dockerfile": "infrastructure", ".tf": "infrastructure",
}
PATHS = [
    ("src/graph/", "graph"), ("src/capture/", "algorithm"), ("src/daemon/", "data"), ("src/detect/", "algorithm"), ("src/adapters/", "architecture"), ("bin/commands/", "delegation"),
    ("test/", "testing"), ("hooks/", "deployment"), (r"\.tsx?$", "code"), (r"\.md$", "documentation"), (r"\.json$", "config"),
]
#: Domains in order of priority: (name, pattern of the cascade, broad pattern, veto).
DOMAINS = [
    ("infra", r"docker.*build|podman.*run|mac.?mini|ghcr\.io|rebuild.*image|makefile.*target|hero.*install|\binfra\b|container.*image", r"docker|podman|container|mac.?mini|ghcr|\bdeploy\b|\brebuild\b|makefile|daemon|\bimage\b.*build|\bport\b.*\d|\bhero\b", "before assert|check before|read before|verify state"),
    ("scraper", "scraper.*run|saleshub.*page|enrich.*product|product.*scrap|extraction.*gate|vnc.*session", r"scraper|saleshub|\benrich\b|product.*scrap|extraction|\bvnc\b|checklist|signal.*refresh", None),
    ("process", "dev.?loop.*mandatory|worktree.*isolation|commit.*gate.*pass|ship.*workflow.*scope|scope.*check.*diff|quality.*loop.*cycle", "dev.?loop|worktree|commit.*gate|ship.*workflow|scope.*check|quality.*loop|pipeline.*sequence|audit.*gate", None),
    ("deployment", "makefile|make rebuild|make test|test container|deploy sequence", "makefile|make rebuild|make test|test container|deploy", "before assert|check before|read before|verify state"),
    ("testing", "test.*first.*deploy|tdd.*cycle|unit.*test.*gate|e2e.*test.*run|regression.*suite|test.*gate.*pass", r"test.*first|\btdd\b|unit.*test|e2e.*test|regression|test.*gate|fresh.*container.*test|cleanup.*test", None),
    ("ui", r"\bquinn\b|playwright.*project|visual.*test|screenshot.*valid|ui.*review.*post|browser.*automat.*wait", r"\bquinn\b|playwright|visual.*test|screenshot|ui.*review|\bux\b|component.*render|browser.*automat", None),
    ("browser", r"\biframe\b|page\.fill|page\.route|selector.*fail|sso.*redirect|login.*flow|browser.*context", r"\biframe\b|page\.fill|page\.route|sso|login.*flow|browser.*context", None),
    ("security", None, r"security scan|security.*gate|security.*review|vulnerability|destructive|force push|\bauth\b|credential|token.*secret|session.*permission|access.control|encrypt|secret.*key", None),
    ("delegation", "spawn.*agent|agent.*spawn|worktree isolation|pre-brief|handoff|delegate.*code", "spawn.*agent|agent.*spawn|worktree|pre-brief|handoff|delegate|marcus|brief.*template", None),
    ("escalation", "escalat|bring in.*specialist|wrong approach|1-2 attempt|after.*fail|stuck.*diagnos", "escalat|bring in.*specialist|wrong approach|stuck", None),
    ("algorithm", r"\bprd\b|\bisc\b|algorithm.*phase|effort level|criteria.*count|scoring.*signal|correlation.*track", r"\bprd\b|\bisc\b|algorithm.*phase|effort level|scoring|rating.*signal|correlation", None),
    ("memory", r"feedback_.*\.md|memory\.md|ratings\.jsonl|learning capture|failure capture|backlog.*log.*immediate", r"feedback_.*\.md|memory\.md|ratings\.jsonl|learning capture|backlog.*log", None),
    ("scope", "minimal.*scope|only.*asked|don.t add|unrequested|no.*cleanup|stay.*focused|match.*question.*scope", "minimal.*scope|only.*asked|unrequested|stay.*focused|match.*question", None),
    ("delivery", "false.*complet|partial.*deliver|incomplete.*deliver|not.*done|self.audit|before.*claiming.*done", r"false.*complet|partial.*deliver|incomplete|not.*done|self.audit|\bship\b|acceptance.*criter|template.*ac|github.*issue", None),
    ("data", "actual.*data|live.*data|measure.*before|read.*before.*plan|real.*numbers|pipeline.*health|promote.*rule|evict.*stale|lifecycle.*manage", r"actual.*data|live.*data|measure.*before|read.*before.*plan|pipeline|\bpromote\b|\bevict\b|lifecycle", None),
    ("architecture", None, r"\brefactor\b|abstract.*interface|module.boundary|coupling|cohesion|deep.module|migration.*architecture|\barchitecture\b.*decision|interface.*design", None),
]


def first_match(c: Column, ladder: Sequence[tuple[str, object]], otherwise: object = None) -> Column:
    """The label of the first pattern that is found."""
    out = F.lit(otherwise)
    for pattern, label in reversed(ladder):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def any_of(c: Column, patterns: Sequence[str], insensitive: bool = True) -> Column:
    return c.rlike(("(?i)" if insensitive else "") + "|".join(f"(?:{p})" for p in patterns))


def hits(c: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns are found, whatever the case."""
    return sum((c.rlike("(?i)" + p).cast("int") for p in patterns), F.lit(0))


def holds(c: Column, phrases: Sequence[str]) -> Column:
    """Whether one of some literal phrases stands in the text."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def first_phrase(c: Column, phrases: Sequence[str]) -> Column:
    """The first of some literal phrases that stands in the text."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(p)), F.lit(p)) for p in phrases])


def counted(c: Column, words: Sequence[str]) -> Column:
    return sum((F.contains(F.lower(c), F.lit(w)).cast("int") for w in words), F.lit(0))


def explicit_rating(message: Column) -> Column:
    """struct(mode, scope, quality, comment, composite) of `/rate M:x S:y Q:z [comment]`, null if a mark leaves 1 to 10."""
    p = r"(?i)^/rate\s+M:(\d+(?:\.\d+)?)\s+S:(\d+(?:\.\d+)?)\s+Q:(\d+(?:\.\d+)?)(?:\s+(.+))?$"
    m = F.trim(message)
    mark = lambda i: half_up(F.regexp_extract(m, p, i).try_cast("double"), 0)
    ok = m.rlike(p) & mark(1).between(1, 10) & mark(2).between(1, 10) & mark(3).between(1, 10)
    comment = F.nullif(F.trim(F.regexp_extract(m, p, 4)), F.lit(""))
    return F.when(ok, F.struct(mark(1).alias("mode"), mark(2).alias("scope"), mark(3).alias("quality"), comment.alias("comment"), composite(mark(1), mark(2), mark(3)).alias("composite")))


def composite(mode: Column, scope: Column, quality: Column) -> Column:
    return half_up(mode * 0.34 + scope * 0.33 + quality * 0.33, 1)


def bare_rating(message: Column) -> Column:
    m = F.trim(message)
    return F.when(m.rlike(r"^(10|[1-9])\b") & ~m.rlike(r"^(?:10|[1-9])\.\d") & ~m.rlike("(?i)" + COUNTED), F.regexp_extract(m, r"^(10|[1-9])\b", 1).try_cast("double"))


def plain_words(c: Column) -> Column:
    return split_space(F.regexp_replace(F.lower(F.trim(c)), "[.!?,'\"]", ""))


def praise_rating(message: Column, score: float = 8.0) -> Column:
    w = plain_words(message)
    praise = F.array(*[F.lit(x) for x in POSITIVE])
    return F.when((F.size(split_space(F.trim(message))) <= 5) & F.arrays_overlap(F.concat(w, bigrams(w)), praise), F.lit(score))


def thumbs_rating(message: Column, up: float = 9.0, down: float = 2.0) -> Column:
    return F.when(message.rlike(r"(?i)👍|\bthumbs\s*up\b|\+1\b"), up).when(message.rlike(r"(?i)👎|\bthumbs\s*down\b|(?<!\w)-1\b"), down)


def rating_cascade(message: Column) -> Column:
    """struct(rating, source): explicit marks, then a bare number, then praise, then thumbs."""
    return F.coalesce(
        *[F.when(r.isNotNull(), F.struct(r.cast("double").alias("rating"), F.lit(s).alias("source"))) for s, r in (("explicit", explicit_rating(message)["composite"]), ("bare", bare_rating(message)), ("praise", praise_rating(message)), ("thumbs", thumbs_rating(message)))]
    )


def sentiment(text: Column) -> Column:
    """struct(label, confidence) by praise and blame words and word pairs; null without any."""
    w = split_space(F.regexp_replace(F.lower(text), "[.!?,'\"]", ""))
    count = lambda words: F.size(F.filter(F.concat(w, bigrams(w)), lambda x: x.isin(*words)))
    p, n = count(POSITIVE), count(NEGATIVE)
    sure = lambda k: F.least(0.5 + k * 0.15, F.lit(0.95))
    return (
        F.when(p > n, F.struct(F.lit("positive").alias("label"), sure(p).alias("confidence")))
        .when(n > p, F.struct(F.lit("negative").alias("label"), sure(n).alias("confidence")))
        .when(p > 0, F.struct(F.lit("mixed").alias("label"), F.lit(0.4).alias("confidence")))
    )


def keyword_sentiment(text: Column, positive: Sequence[str], negative: Sequence[str], noise: Sequence[str] = ()) -> Column:
    """(praise - blame) / hits, held in -1 to 1; 0 for noise and texts without hits."""
    p, n = hits(text, positive), hits(text, negative)
    value = F.coalesce(F.try_divide((p - n).cast("double"), (p + n).cast("double")), F.lit(0.0))
    return F.when(any_of(text, noise), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))) if noise else value


def correction_severity(message: Column) -> Column:
    """Severity of the first correction pattern found, null for noise and for no correction."""
    return F.when(~any_of(message, NOISE), first_match(message, [("(?i)" + p, s) for p, s in CORRECTIONS]))


def failure_severity(rating: Column) -> Column:
    return F.when(rating > 3, None).when(rating <= 1, "critical").when(rating <= 2, "high").otherwise("medium")


def incident_type(output: Column) -> Column:
    return F.when(~output.rlike("(?i)no changes|0 errors"), first_match(output, INCIDENTS))


def tool_category(tool: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, tool), F.when(F.contains(tool, F.lit("__")), "mcp").otherwise("other"))


def severity(text: Column) -> Column:
    t, out = F.lower(text), F.lit(1)
    for level, words in reversed(SEVERITIES):
        out = F.when(holds(t, words), level).otherwise(out)
    return out


def memory_type(text: Column) -> Column:
    """The class with strictly the most patterns found, in the order episodic, procedural, semantic; semantic by default."""
    e, p, s = (hits(text, MEMORY_TYPES[k]) for k in ("episodic", "procedural", "semantic"))
    best = F.greatest(e, p, s)
    return F.when(best == 0, "semantic").when(e == best, "episodic").when(p == best, "procedural").otherwise("semantic")


def route_tier(rule: Column, n_projects: Column) -> Column:
    return F.when(n_projects <= 1, "project").when(counted(rule, BEHAVIOURAL) > counted(rule, PROCEDURAL), "global").otherwise("graph")


def cohort(text: Column) -> Column:
    """The first of the cohorts with most key words; the first cohort where none is found."""
    scores = F.array(*[counted(text, words) for _, words in COHORTS])
    return F.element_at(F.array(*[F.lit(n) for n, _ in COHORTS]), F.array_position(scores, F.array_max(scores)).cast("int"))


def sanitise(text: Column) -> Column:
    for p in INJECTIONS:
        text = F.regexp_replace(text, p, "")
    return F.trim(text)


def normal_id(rule_id: Column) -> Column:
    """One known prefix and a `(from ...)` ending go; lower-case letters, digits and single hyphens are left."""
    n = F.regexp_replace(rule_id, r"^(?:feedback_|success_|project_|traj-|traj_)", "")
    n = F.lower(F.regexp_replace(n, r"\s*\(from\s.*?\)\s*$", ""))
    for p, r in ((r"[_/]", " "), (r"[^a-z0-9\s-]", ""), (r"\s+", "-"), ("-+", "-"), ("^-|-$", "")):
        n = F.regexp_replace(n, p, r)
    return n


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def domain_cascade(text: Column) -> Column:
    """The first domain, in order of priority, whose pattern is found and whose veto is not."""
    t, out = F.lower(text), F.lit(None).cast("string")
    for name, cascade, broad, veto in reversed(DOMAINS):
        found = t.rlike(cascade or broad)
        out = F.when(found & ~t.rlike(veto) if veto else found, name).otherwise(out)
    return out


def domain_set(text: Column) -> Column:
    """All domains whose broad pattern is found."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + broad), name) for name, _, broad, _ in DOMAINS]))


def augmented_gate(text: Column, terms: Column) -> Column:
    """Mined terms count if one of several words is found, or two different ones, or three hits in all."""
    t = F.lower(text)
    times = lambda x: ((F.length(t) - F.length(F.replace(t, F.lower(x), F.lit("")))) / F.length(x)).cast("int")
    found = F.filter(terms, lambda x: F.instr(t, F.lower(x)) > 0)
    total = F.aggregate(F.transform(found, times), F.lit(0), lambda a, b: a + b)
    return F.exists(found, lambda x: F.instr(x, " ") > 0) | (F.size(found) >= 2) | (total >= 3)


def file_domain(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.when(path.rlike(r"\.(test|spec)\.[tj]sx?$"), "testing").otherwise(F.try_element_at(known, F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def path_domain(path: Column) -> Column:
    return first_match(path, PATHS)


def message_score(text: Column) -> Column:
    """How much of a task a message states, from 0.1 to 1."""
    t = F.lower(F.trim(text))
    n = F.size(split_space(t))
    starts = lambda ps: F.coalesce(*[F.when(F.startswith(t, F.lit(p)), True) for p in ps], F.lit(False))
    ack = F.coalesce(*[F.when((t == p) | (F.startswith(t, F.lit(p + " ")) & (n <= 6)), True) for p in ACKS], F.lit(False))
    score = F.when(n > 20, 0.3).when(n > 10, 0.15).otherwise(0.0) + F.when(holds(t, VERBS), 0.3).otherwise(0.0) + F.when(starts(ACKS), 0.0).otherwise(0.2) + F.when(holds(t, GARBAGE), 0.0).otherwise(0.2)
    return F.when(starts(GARBAGE) | ack, 0.1).when(n <= 3, 0.15).otherwise(F.least(score, F.lit(1.0)))


def harvest_category(text: Column) -> Column:
    return F.when(any_of(text, SYSTEM), "system").otherwise("algorithm")


def learning_class(text: Column) -> Column:
    t = F.lower(text)
    return F.when(any_of(t, APPROACH), "approach").when(any_of(t, SYSTEM), "tooling").otherwise("approach")


def is_learning(text: Column) -> Column:
    return hits(text, LEARNING) >= 2


def skill_outcome(skill: Column, trigger: Column) -> Column:
    ok = (F.length(skill) > 0) & F.contains(F.lower(trigger), F.lower(skill))
    return F.when(F.coalesce(ok, F.lit(False)), "hit").otherwise("unknown")


def skill_workflow(args: Column) -> Column:
    named = F.regexp_extract(args, r"(?i)workflow[:\s]+([A-Za-z0-9_-]+)", 1)
    leading = F.regexp_extract(args, r"^([A-Za-z0-9_-]+)\s", 1)
    t = F.trim(args)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(leading, F.lit("")), F.when((F.length(t) > 0) & (F.length(t) < 40), t))


def criteria_score(text: Column, patterns: Sequence[str], least: int, anchor: str | None = None, target: str | None = None) -> Column:
    """1 if enough patterns are found and, where asked, the anchor stands before the target."""
    ok = hits(text, patterns) >= least
    if anchor and target:
        a, b = F.regexp_instr(text, F.lit("(?i)" + anchor)), F.regexp_instr(text, F.lit("(?i)" + target))
        ok = ok & (a > 0) & ((b == 0) | (a < b))
    return ok.cast("int")


def is_uuid_text(text: Column) -> Column:
    return text.rlike("(?i)^(?:session )?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def is_system_snippet(text: Column) -> Column:
    return F.startswith(text, F.lit("<system-reminder>")) | F.startswith(text, F.lit("<task-notification>"))


def staleness(days: Column, yellow: int = 2, red: int = 7) -> Column:
    return F.when(days.isNull() | (days > red), "RED").when(days > yellow, "YELLOW").otherwise("GREEN")


def age_text(seconds: Column) -> Column:
    unit = lambda n, u: F.concat(F.floor(seconds / n).cast("string"), F.lit(u + " ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def interval_seconds(text: str, default: int = 1800) -> int:
    """`30m`, `2h`, `45s` as seconds; anything else is the default."""
    unit = {"s": 1, "m": 60, "h": 3600}.get(text[-1:], 0)
    return int(text[:-1]) * unit if unit and text[:-1].isdigit() else default
