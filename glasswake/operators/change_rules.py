"""Rules over single changed files.  All rules of a file are evaluated on its row;
one explode turns the hits into review findings."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.functions.bind import bind
from glasswake.functions.patch import (
    first, first_with_context, longest_run, nesting, unsigned, with_lines,
)
from glasswake.functions.paths import is_test

REVIEW_FIELDS = ["analyzer_ord", "file_ord", "rule_ord", "category", "severity", "rule_id",
                 "title", "summary", "why_flagged", "suggestion", "file_path", "start_line",
                 "end_line", "snippet", "score_impact"]
TEXT_FIELDS = ["summary", "why_flagged", "suggestion", "snippet"]
ANALYZER = {"maintainability": 2, "naming": 3, "exposure": 4, "tests": 5, "workflow": 6}

# ---- fixed values: patterns on single diff lines (the leading sign included) ---
_W, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"     # ASCII word borders
AUTH_GUARD = (r"requireAuth|authenticate|isAuthenticated|checkAuth|verifyToken|authMiddleware"
              r"|passport\.authenticate|jwt\.verify|authorize")
ROUTES = (
    (r"""router\.(get|post|put|delete|patch)\s*\(\s*['"`][^'"`]*/"""
     r"""(admin|internal|debug|root|superuser)[^'"`]*['"`]""", "admin/internal"),
    (r"""router\.(get|post|put|delete|patch)\s*\(\s*['"`][^'"`]*/login[^'"`]*['"`]""", "login"),
    (r"""app\.(get|post|put|delete|patch)\s*\(\s*['"`][^'"`]*/(admin|internal|debug)[^'"`]*['"`]""",
     "admin/internal"),
)
SECRETS = (
    (r"""(?i)^\+.*(password|passwd|pwd)\s*[:=]\s*['"`][^'"`]{3,}['"`]""", "Hardcoded password"),
    (r"""(?i)^\+.*(api[_-]?key|apikey)\s*[:=]\s*['"`][A-Za-z0-9+/]{10,}['"`]""", "API key"),
    (r"(?i)^\+.*Bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer token"),
    (r"""(?i)^\+.*['"](sk|pk|rk)-[A-Za-z0-9]{16,}['"]""", "Service key"),
    (r"""(?i)^\+.*const\s+\w*(secret|token|key|password)\w*\s*=\s*['"`][^'"`]{6,}['"`]""",
     "Hardcoded credential"),
    (r"""(?i)^\+.*ADMIN[_-]?(SECRET|KEY|TOKEN|PASSWORD)\s*=\s*['"`][^'"`]{3,}['"`]""",
     "Admin credential"),
)
SECRET_MASK = r"""(['"`])[A-Za-z0-9+/]{4,}(\1)"""
CONSOLE_LOG = r"^\+.*console\.(log|debug|info|warn)"
SENSITIVE_WORD = r"(?i)password|token|secret|key|auth|session|cvv|card|ssn"
BYPASS = (r"(?i)^\+.*(?:skipAuth|bypassAuth|noAuth|disableAuth|authDisabled|testMode\s*=\s*true)"
          r"|^\+.*mock.*(?:user|auth|session|token)\s*=")
DEV_ARTIFACTS = (
    (r"(?i)^\+.*" + _W + r"(seed|fixture|factory|mock|fake|stub)" + _E + r".*(?:user|data|db)",
     "seed/mock data reference"),
    (r"(?i)^\+.*" + _W + r"test[_-]?(?:user|password|token|key|secret)" + _E,
     "test credential reference"),
)
TODO = r"^\+.*" + _W + r"(TODO|FIXME|HACK|XXX)" + _E
WORKAROUNDS = (
    r"(?i)^\+.*" + _W + r"temp(orary)?" + _E, r"(?i)^\+.*" + _W + r"workaround" + _E,
    r"(?i)^\+.*" + _W + r"quick[_-]?fix" + _E, r"(?i)^\+.*hardcoded", r"(?i)^\+.*bypass",
    r"(?i)^\+.*skip.*for now",
)
IMPORT, AWAIT = r"import\s+.+from", r"await\s+\w"
CONDITIONAL = (r"^\+.*(?:" + _W + r"else if" + _E + r"|(?<=[A-Za-z0-9_])\} else if" + _E
               + r"|(?<=[A-Za-z0-9_])(?:\|\||&&)(?=[A-Za-z0-9_]))")
CONDITIONAL_SNIPPET = r"else if|\|\||&&"
VAGUE_WORDS = "tmp mgr hlpr util proc res req cb fn val obj idx arr str num".split()
VAGUE_WORD = _W + "(" + "|".join(VAGUE_WORDS) + ")" + _E
VAGUE = r"^\+.*" + VAGUE_WORD
BOOLEAN = (r"^\+.*" + _W + r"(const|let|var)\s+(active|enabled|visible|valid|ready|loaded|done"
           r"|open|found|exists)\s*=")
LOGIC_PARTS = (
    r"^\+.*(function|const\s+\w+\s*=\s*(?:async\s+)?\()",
    r"(?i:^\+.*" + _W + r"validat)",
    r"(?i:^\+.*" + _W + r"processOrder|checkout|payment|refund|authorize|authenticate)",
    r"^\+.*" + _W + r"(if|switch|try|catch)" + _E + r".*\{",
    r"^\+.*throw\s+new\s+Error", r"^\+.*return\s+\w",
)
LOGIC = "|".join(LOGIC_PARTS)
#: Per pattern what a matching line holds whatever its case: of each group one word at least.
#: (Patterns fold ASCII letters only, which lower-casing folds too.)
_SECRET_WORDS, _HIDDEN = ("secret", "token", "key", "password"), ("/admin", "/internal", "/debug")
WORDS: dict[str, tuple[tuple[str, ...], ...]] = {
    ROUTES[0][0]: (("router.",), (*_HIDDEN, "/root", "/superuser")),
    ROUTES[1][0]: (("router.",), ("/login",)),
    ROUTES[2][0]: (("app.",), _HIDDEN),
    SECRETS[0][0]: (("password", "passwd", "pwd"),),
    SECRETS[1][0]: (("api_key", "api-key", "apikey"),),
    SECRETS[2][0]: (("bearer",),),
    SECRETS[3][0]: (("sk-", "pk-", "rk-"),),
    SECRETS[4][0]: (("const",), _SECRET_WORDS),
    SECRETS[5][0]: (("admin",), _SECRET_WORDS),
    CONSOLE_LOG: (("console.",),),
    BYPASS: (("auth", "testmode", "mock"),),
    DEV_ARTIFACTS[0][0]: (("seed", "fixture", "factory", "mock", "fake", "stub"), ("user", "data", "db")),
    DEV_ARTIFACTS[1][0]: (("test",), ("user", *_SECRET_WORDS)),
    TODO: (("todo", "fixme", "hack", "xxx"),),
    WORKAROUNDS[0]: (("temp",),), WORKAROUNDS[1]: (("workaround",),), WORKAROUNDS[2]: (("quick",),),
    WORKAROUNDS[3]: (("hardcoded",),), WORKAROUNDS[4]: (("bypass",),), WORKAROUNDS[5]: (("for now",),),
    IMPORT: (("import",),), AWAIT: (("await",),), CONDITIONAL: (("else if", "||", "&&"),),
    BOOLEAN: (("const", "let", "var"), ("active", "enabled", "visible", "valid", "ready", "loaded", "done", "open",
                                        "found", "exists")),
    LOGIC_PARTS[0]: (("function", "const"),), LOGIC_PARTS[1]: (("validat",),),
    LOGIC_PARTS[2]: (("processorder", "checkout", "payment", "refund", "authorize", "authenticate"),),
    LOGIC_PARTS[3]: (("if", "switch", "try", "catch"), ("{",)), LOGIC_PARTS[4]: (("throw",),), LOGIC_PARTS[5]: (("return",),),
}
SYNONYMS = (
    ("customer", "client", "accountuser", "acctusr", "account_user"),
    ("user", "usr", "member", "subscriber"),
    ("order", "purchase", "transaction"),
    ("product", "item", "listing", "sku"),
    ("payment", "charge", "billing"),
)
RUN_MEDIUM, RUN_HIGH, NESTING, IMPORTS, AWAITS, CONDITIONALS = 40, 70, 4, 5, 5, 5
ABBREVIATIONS, LOGIC_LINES = 2, 3

# rule id -> title, reason, advice (titles are fixed values, the prose is our own)
TEXTS = {
    "exposure/removed-auth-guard": ("Auth Guard Removed", "A check that kept strangers out is gone.",
                                    "Show where the check happens now."),
    "exposure/sensitive-route": ("Potential API Exposure", "Such routes often reach private data.",
                                 "Guard the route by role or explain why it is open."),
    "exposure/hardcoded-secret": ("Possible Secret Leakage", "Secrets stay in history for good.",
                                  "Keep it outside the code and replace the value."),
    "exposure/sensitive-console-log": ("Sensitive Data in Console Log", "Logs are widely readable.",
                                       "Do not log such values."),
    "exposure/auth-bypass": ("Auth Exposure Risk", "Shortcuts around login tend to stay.",
                             "Take the shortcut out of production code."),
    "exposure/dev-artifact": ("Development Artifact Left Behind", "Test data may reach users.",
                              "Move it to test-only files."),
    "maint/todo-shortcut": ("Unresolved TODO / FIXME in new code", "Open work gets forgotten.",
                            "Finish it or link an issue."),
    "maint/hardcoded-workaround": ("Hardcoded Workaround Pattern", "Stopgaps outlive their reason.",
                                   "Fix the cause or link an issue."),
    "maint/complexity-spike": ("Complexity Spike", "Long blocks are hard to review.",
                               "Split the block into small functions."),
    "maint/deep-nesting": ("Deep Nesting Detected", "Many levels hide the flow.",
                           "Return early or extract functions."),
    "maint/mixed-responsibilities": ("Mixed Responsibilities", "One place does too many things.",
                                     "Separate the concerns."),
    "maint/long-conditional-chain": ("Long Conditional Chain", "Chains break when they grow.",
                                     "Use a table or strategies."),
    "naming/domain-term-drift": ("Naming Consistency Risk", "Two words for one thing confuse.",
                                 "Agree on one word."),
    "naming/vague-abbreviations": ("Reduced Naming Clarity", "Short names hide their meaning.",
                                   "Write the words out."),
    "naming/boolean-naming": ("Variable Meaning Drift", "The name does not say it is a flag.",
                              "Start the name with is, has or can."),
    "tests/no-test-update": ("Missing Test Coverage Update", "Behaviour changed, tests did not.",
                             "Add or change tests."),
    "tests/service-without-test": ("Logic Changed Without Test Evidence",
                                   "No test of this name was touched.", "Test the changed paths."),
    "workflow/large-pr": ("Large PR", "Large changes are reviewed less well.", "Split it."),
    "workflow/no-reviewer": ("No Reviewer Assigned", "Nobody else will look at it.",
                             "Ask someone to review."),
    "workflow/stale-pr": ("Stale PR", "The code around it has moved on.", "Rebase and run checks."),
    "workflow/checks-failing": ("CI Checks Failing", "Automatic checks found a problem.",
                                "Fix it before merging."),
}


def review_finding(analyzer: str, file_ord, rule_ord: int, rule_id: str, category: str, severity,
                   summary, file_path, snippet, impact) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    number = lambda v, t="int": (v if isinstance(v, Column) else F.lit(v)).cast(t)
    title, why, advice = TEXTS[rule_id]
    return F.struct(
        F.lit(ANALYZER[analyzer]).alias("analyzer_ord"),
        number(file_ord, "bigint").alias("file_ord"),
        F.lit(rule_ord).alias("rule_ord"), F.lit(category).alias("category"),
        text(severity).alias("severity"), F.lit(rule_id).alias("rule_id"),
        F.lit(title).alias("title"), text(summary).alias("summary"),
        F.lit(why).alias("why_flagged"), F.lit(advice).alias("suggestion"),
        text(file_path).alias("file_path"), F.lit(None).cast("int").alias("start_line"),
        F.lit(None).cast("int").alias("end_line"), text(snippet).alias("snippet"),
        number(impact).alias("score_impact"))


def emit_reviews(df: DataFrame, rules: list[Column]) -> DataFrame:
    rows = df.select("review_id", F.explode(F.array_compact(F.array(*rules))).alias("f"))
    return rows.select("review_id", "f.*")


def lowered(files: DataFrame) -> DataFrame:
    """Adds the lower-cased added lines to files with the arrays of ``split_patch``: ``low_added``,
    and as one text, ``low``."""
    # array functions are interpreted, and so is all that stands in a generator with them
    df = files.withColumn("low_", F.transform("added", lambda l: F.lower(l)))
    return bind(bind(df, "low_added", F.col("low_")).drop("low_"), "low", F.array_join("low_added", "\n"))


def _holds(text: Column, groups) -> Column:
    return reduce(and_, [reduce(or_, [text.contains(w) for w in words]) for words in groups])


def _line_matches(line: Column, at: Column, pattern: str) -> Column:
    """Whether an added line, the one at ``at``, matches; its words are looked for first, those
    of the smallest group before others: many words cost less than one pattern."""
    return _holds(F.get("low_added", at), sorted(WORDS[pattern], key=len)) & line.rlike(pattern)


def _found(pattern: str, take=lambda found: found) -> Column:
    """What ``take`` makes of the added lines that match; null, and no line read, if their text
    doesn't hold the pattern's words."""
    return F.when(_holds(F.col("low"), WORDS[pattern]),
                  take(F.filter("added", lambda l, i: _line_matches(l, i, pattern))))


def _matching(pattern: str) -> Column:
    return F.coalesce(_found(pattern), F.array().cast("array<string>"))


def _first_of(patterns) -> Column:
    """(line, label): first added line that matches the first pattern that matches at all."""
    def hit(pattern: str, label: str) -> Column:
        return _found(pattern, lambda found: F.get(F.transform(
            found, lambda l: F.struct(l.alias("line"), F.lit(label).alias("label"))), 0))

    return F.coalesce(*[hit(p, label) for p, label in patterns])


def _facts_of_lines() -> dict[str, Column]:
    """What the rules ask of a file's lines; each is computed once per file.  What no rule
    could use (a run of few lines, a few levels) is null."""
    added, removed, lines = (F.col(c) for c in ("added", "removed", "lines"))
    one = lambda p: _found(p, lambda found: F.get(found, 0))
    return {
        "guard": F.when(F.size(removed) > 0, first(removed, lambda l: l.rlike(AUTH_GUARD))),
        "route": _first_of(ROUTES), "secret": _first_of(SECRETS),
        "log": _found(CONSOLE_LOG, lambda found: first(found, lambda l: l.rlike(SENSITIVE_WORD))),
        "bypass": one(BYPASS), "artifact": _first_of(DEV_ARTIFACTS),
        "todo": _matching(TODO), "work": _first_of([(p, "") for p in WORKAROUNDS]),
        "run": F.when(F.size(added) > RUN_MEDIUM, longest_run(lines)),
        "deep": F.when(nesting(F.col("low")) >= NESTING, F.array_max(F.transform(added, nesting))),
        "imports": F.size(_matching(IMPORT)), "awaits": F.size(_matching(AWAIT)),
        "conditions": F.size(_matching(CONDITIONAL)), "flag": one(BOOLEAN),
        "vague": F.when(_holds(F.col("low"), [VAGUE_WORDS]),
                        F.filter(added, lambda l: _holds(l, [VAGUE_WORDS]) & l.rlike(VAGUE))),
    }


#: What each rule reads of ``_facts_of_lines``.
READS = {"removed_guard": ("guard",), "route": ("route",), "secret": ("secret",), "console_log": ("log",),
         "bypass": ("bypass",), "dev_artifact": ("artifact",), "todo": ("todo",), "workaround": ("work",),
         "complexity": ("run",), "nesting": ("deep",), "mixed": ("imports", "awaits"), "conditionals": ("conditions",),
         "abbrev": ("vague",), "boolean": ("flag",)}


#: Patterns without which a rule finds nothing in a file; a rule that isn't named reads every file.
NEEDS = {"route": [p for p, _ in ROUTES], "secret": [p for p, _ in SECRETS], "console_log": [CONSOLE_LOG], "bypass": [BYPASS],
         "dev_artifact": [p for p, _ in DEV_ARTIFACTS], "todo": [TODO], "workaround": WORKAROUNDS, "mixed": [IMPORT],
         "conditionals": [CONDITIONAL], "boolean": [BOOLEAN]}


def _rules(names: tuple[str, ...], texts: bool) -> list[Column]:
    """The named rules over files with a column ``seen`` (see ``with_hits``)."""
    added, path = F.col("added"), F.col("file_path")
    read = {field for name in names for field in READS[name]}
    seen = {f: F.col("seen")[f] if f in read else F.lit(None) for fields in READS.values() for f in fields}
    line = lambda f: seen[f]["line"] if f in read else F.lit(None).cast("string")
    label = lambda f: seen[f]["label"] if f in read else F.lit(None).cast("string")
    prod = ~is_test(path)
    any_added = F.size(added) > 0
    two = lambda found: F.array_join(F.transform(
        F.slice(found, F.lit(1), F.lit(2)), lambda l: F.regexp_replace(l, r"^\+", "")), "\n")

    def rule(name, severity, test, summary, snippet, impact):
        text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
        kind = [F.lit(FILE_RULES.index(name)).cast("byte").alias("rule"), text(severity).alias("severity"),
                (impact if isinstance(impact, Column) else F.lit(impact)).cast("int").alias("score_impact")]
        return F.when(test, F.struct(*kind, *([text(summary).alias("summary"), text(snippet).alias("snippet")] if texts else [])))

    say = lambda text: F.concat(F.lit(text + ": "), path)
    count = lambda text, n: F.concat(n.cast("string"), F.lit(" " + text + ": "), path)

    out: dict[str, Column] = {}
    guard = seen["guard"]
    out["removed_guard"] = rule(
        "removed_guard", "high", guard.isNotNull() & prod,
        say("Access check removed"), unsigned(guard, "-"), 5)
    out["route"] = rule(
        "route", "high", line("route").isNotNull() & prod,
        F.concat(F.lit("New "), label("route"), F.lit(" route: "), path), unsigned(line("route")), 5)
    masked = F.regexp_replace(F.regexp_replace(line("secret"), r"^\+", ""), SECRET_MASK, "$1***$2")
    out["secret"] = rule(
        "secret", "high", line("secret").isNotNull(),
        F.concat(label("secret"), F.lit(" in code: "), path), unsigned(F.concat(F.lit("+"), masked)), 5)
    log = seen["log"]
    out["console_log"] = rule(
        "console_log", "medium",
        log.isNotNull() & prod, say("Sensitive value logged"), unsigned(log), 3)
    bypass = seen["bypass"]
    out["bypass"] = rule(
        "bypass", "high", bypass.isNotNull() & prod,
        say("Login can be skipped"), unsigned(bypass), 5)
    out["dev_artifact"] = rule(
        "dev_artifact", "medium", line("artifact").isNotNull() & prod,
        F.concat(label("artifact"), F.lit(": "), path), unsigned(line("artifact")), 2)

    todo = seen["todo"]
    out["todo"] = rule(
        "todo", "low", F.size(todo) > 0,
        count("open work markers", F.size(todo)), unsigned(F.concat(F.lit("+"), two(todo))), 1)
    out["workaround"] = rule(
        "workaround", "low",
        line("work").isNotNull(), say("Stopgap"), unsigned(line("work")), 1)
    run = seen["run"]
    out["complexity"] = rule(
        "complexity", F.when(run > RUN_HIGH, "high").otherwise("medium"), any_added & (run > RUN_MEDIUM),
        count("added lines in a row", run), None, F.when(run > RUN_HIGH, 3).otherwise(2))
    deep = seen["deep"]
    out["nesting"] = rule(
        "nesting", "medium", deep >= NESTING,
        count("levels on one line", deep), None, 2)
    imports, awaits = seen["imports"], seen["awaits"]
    out["mixed"] = rule(
        "mixed", "medium",
        (imports >= IMPORTS) & (awaits >= AWAITS),
        F.concat(imports.cast("string"), F.lit(" imports, "), count("async calls", awaits)), None, 2)
    conditions = seen["conditions"]
    out["conditionals"] = rule(
        "conditionals", "low",
        conditions >= CONDITIONALS, count("chained conditions", conditions),
        first_with_context(F.array_join("lines", "\n"), CONDITIONAL_SNIPPET), 1)

    vague = seen["vague"]
    out["abbrev"] = rule(
        "abbrev", "low",
        F.size(vague) >= ABBREVIATIONS, count("lines with vague names", F.size(vague)),
        unsigned(F.concat(F.lit("+"), two(vague))), 0)
    flag = seen["flag"]
    out["boolean"] = rule(
        "boolean", "low", flag.isNotNull(),
        say("Flag without a prefix"), unsigned(flag), 0)
    return [out[name] for name in names]


FILE_RULES = ("todo", "workaround", "complexity", "nesting", "mixed", "conditionals", "abbrev",
              "boolean", "removed_guard", "route", "secret", "console_log", "bypass",
              "dev_artifact")


#: Of each file rule: analyzer, order within it, rule id, category.
FILE_RULE = {
    "removed_guard": ("exposure", 1, "exposure/removed-auth-guard", "exposure"),
    "route": ("exposure", 2, "exposure/sensitive-route", "exposure"),
    "secret": ("exposure", 3, "exposure/hardcoded-secret", "security"),
    "console_log": ("exposure", 4, "exposure/sensitive-console-log", "exposure"),
    "bypass": ("exposure", 5, "exposure/auth-bypass", "exposure"),
    "dev_artifact": ("exposure", 6, "exposure/dev-artifact", "exposure"),
    "todo": ("maintainability", 1, "maint/todo-shortcut", "maintainability"),
    "workaround": ("maintainability", 2, "maint/hardcoded-workaround", "maintainability"),
    "complexity": ("maintainability", 3, "maint/complexity-spike", "maintainability"),
    "nesting": ("maintainability", 4, "maint/deep-nesting", "maintainability"),
    "mixed": ("maintainability", 5, "maint/mixed-responsibilities", "maintainability"),
    "conditionals": ("maintainability", 6, "maint/long-conditional-chain", "maintainability"),
    "abbrev": ("naming", 11, "naming/vague-abbreviations", "naming"),
    "boolean": ("naming", 12, "naming/boolean-naming", "naming"),
}


def with_hits(files: DataFrame, only: tuple[str, ...] = FILE_RULES, texts: bool = True) -> DataFrame:
    """Adds ``hits``, the findings of the rules, to files with the columns of ``split_patch`` and
    ``lowered``.  A hit holds what differs from file to file: the rule's number, severity, impact and, with ``texts``,
    summary and snippet."""
    asked = {field for name in only for field in READS[name]}
    df = files.withColumn("file_path", F.col("path")).withColumn("seen_", F.struct(*[
        value.alias(name) for name, value in _facts_of_lines().items() if name in asked]))
    df = bind(df, "seen", F.col("seen_")).drop("seen_").withColumn("rules_", F.array(*_rules(only, texts))).drop("seen", "file_path")
    return bind(df, "rules", F.col("rules_")).withColumn("hits", F.array_compact("rules")).drop("rules_", "rules")


def file_findings(files: DataFrame, only: tuple[str, ...] = FILE_RULES, texts: bool = True) -> DataFrame:
    """The findings of the named rules; without ``texts`` they have none of the columns TEXT_FIELDS."""
    files = files.select("review_id", "file_ord", "path", "patch")
    if all(name in NEEDS for name in only):
        files = _with_words(files, [p for name in only for p in NEEDS[name]])
    return explode_hits(with_hits(lowered(with_lines(files)), only, texts), texts)


def _with_words(files: DataFrame, patterns: list[str]) -> DataFrame:
    """The files whose patch holds the words of one of the patterns; the others are never split."""
    df = bind(files.filter("patch <> ''"), "text_", F.lower("patch"))
    return df.filter(reduce(or_, [_holds(F.col("text_"), WORDS[p]) for p in patterns])).drop("text_")


def explode_hits(df: DataFrame, texts: bool = True) -> DataFrame:
    """The findings of files with ``hits``; without ``texts`` they have none of the columns TEXT_FIELDS."""
    rows = df.select("review_id", "file_ord", "path", F.explode("hits").alias("f"))
    kinds = [FILE_RULE[name] for name in FILE_RULES]
    same = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("f.rule").cast("int"))
    text = lambda i: same([TEXTS[rule_id][i] for _, _, rule_id, _ in kinds])
    own = {
        "analyzer_ord": same([ANALYZER[k[0]] for k in kinds]), "file_ord": F.col("file_ord").cast("bigint"),
        "rule_ord": same([k[1] for k in kinds]), "category": same([k[3] for k in kinds]), "severity": F.col("f.severity"),
        "rule_id": same([k[2] for k in kinds]), "title": text(0), "file_path": F.col("path"),
        "start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int"), "score_impact": F.col("f.score_impact")}
    if texts:
        own |= {"summary": F.col("f.summary"), "why_flagged": text(1), "suggestion": text(2), "snippet": F.col("f.snippet")}
    return rows.select("review_id", *[own[c].alias(c) for c in REVIEW_FIELDS if c in own])


def logic_line_count() -> Column:
    """Added lines that match LOGIC, in files with the columns of ``lowered``."""
    low, few = F.col("low"), LOGIC_PARTS[2]
    rare = F.size(F.filter("added", lambda l, i: reduce(or_, [_line_matches(l, i, p) for p in LOGIC_PARTS])))
    rest = F.size(F.filter("added", lambda l, i: reduce(or_, [_line_matches(l, i, p) for p in LOGIC_PARTS if p != few])))
    return F.when(_holds(low, WORDS[few]), rare).otherwise(rest)


def term_mask(text: Column) -> Column:
    """Which synonym terms occur in a (lower-cased) text, one bit per term."""
    mask, bit = F.lit(0), 0
    for group in SYNONYMS:
        for term in group:
            mask = mask.bitwiseOR(F.when(text.contains(term), F.lit(1 << bit)).otherwise(0))
            bit += 1
    return mask


def group_masks() -> list[int]:
    out, bit = [], 0
    for group in SYNONYMS:
        out.append(((1 << len(group)) - 1) << bit)
        bit += len(group)
    return out


def plural_conflicts(files: DataFrame, limit: int = 3) -> DataFrame:
    """Optional rule: words used both as singular and plural in a file's added lines.

    Works on the row's own distinct words, so no pairs are formed: a plural is kept
    when its stem is in the same word set (array_intersect is hash based).
    """
    df = with_lines(files)
    tokens = F.flatten(F.transform("added", lambda l: F.regexp_extract_all(
        l, F.lit(r"(?<![A-Za-z0-9_])[a-z][a-zA-Z]{3,}(?![A-Za-z0-9_])"), F.lit(0))))
    words = F.array_distinct(F.transform(tokens, F.lower))
    df = bind(df, "words", words)
    stems = F.transform(F.filter("words", lambda w: w.endswith("s") & (F.length(w) > 4)),
                        lambda w: F.left(w, F.length(w) - 1))
    both = F.slice(F.array_intersect(stems, F.col("words")), F.lit(1), F.lit(limit))
    conflicts = F.transform(both, lambda s: F.concat(s, F.lit("/"), s, F.lit("s")))
    return bind(df, "conflicts", conflicts).filter(F.size("conflicts") > 0).select(
        "review_id", "file_ord", "path", "conflicts")
