"""Rules over source texts: a table of patterns, one pass over the lines that any of them can match."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.review import blank_literals


@dataclass(frozen=True)
class Rule:
    """A pattern that a line of certain languages (empty: any) matches.

    ``code``: strings and comments don't count. ``wide``: matched over the whole text. ``once``: only the first hit of a
    text is reported, with the number of further ones. ``suppress``: what cancels a hit within two lines before and
    three after. ``skip``: paths that are left out. ``commented``: comment lines count too.
    """

    name: str
    category: str
    severity: str
    pattern: str
    languages: tuple[str, ...] = ()
    code: bool = False
    wide: bool = False
    once: bool = False
    suppress: str = ""
    skip: str = ""
    commented: bool = False


JS = ("TypeScript", "JavaScript")
LOGGING = (*JS, "Python", "Java", "Kotlin", "Go", "PHP", "C#", "Ruby")
TOOLS = r"(^|/)(scripts?|bin|cli|tools)/"

# Names, categories, severities and languages of the rules.
RULES = (
    Rule("eval", "Security", "High", r"(?<![\w.])eval\s*\(", (*JS, "Python", "Ruby", "PHP"), code=True, suppress=r"literal_eval|no-eval"),
    Rule("new-function", "Security", "High", r"\bnew\s+Function\s*\(", JS, code=True),
    Rule("child-process-exec", "Security", "High", r"(?<![\w.])exec(?:Sync)?\s*\(|\bchild_process\.exec", JS, code=True),
    Rule("python-shell", "Security", "High", r"\bos\.(?:system|popen)\s*\(|\bshell\s*=\s*True\b", ("Python",), code=True),
    Rule("pickle-load", "Security", "High", r"(?<!\w)(?:pickle|cPickle|dill|marshal)\.loads?\s*\(", ("Python",), code=True),
    Rule("sql-concat", "Security", "High", r"(?i)[\"'`]\s*(?:select|insert\s+into|update|delete\s+from)\s[^\"'`]*[\"'`]\s*(?:\+|%|\.format)|`\s*(?:select|insert|update|delete)\s[^`]*\$\{"),
    Rule("tls-verify-off", "Security", "High", r"rejectUnauthorized\s*:\s*false|\bverify\s*=\s*False\b|InsecureSkipVerify\s*:\s*true|NODE_TLS_REJECT_UNAUTHORIZED"),
    Rule("weak-hash", "Security", "Medium", r"(?i)\b(?:md5|sha1)\s*\(|createHash\(\s*[\"'](?:md5|sha1)[\"']|getInstance\(\s*\"(?:md5|sha-?1)\""),
    Rule("weak-random", "Security", "Medium", r"(?i)(?:token|secret|password|nonce|salt|session)\w*\s*[:=].*(?:Math\.random|random\.(?:random|randint|choice))\s*\(", (*JS, "Python"), once=True),
    Rule("innerhtml", "Security", "Medium", r"\.(?:inner|outer)HTML\s*\+?=(?!=)|\bdangerouslySetInnerHTML\b|\bv-html\s*=", (*JS, "HTML", "Vue", "Svelte"), code=True),
    Rule("cors-wildcard", "Security", "Medium", r"(?i)access-control-allow-origin[\"']?\s*[,:]\s*[\"']\*|\borigin\s*:\s*[\"']\*[\"']|allow_origins\s*=\s*\[\s*[\"']\*"),
    Rule("debug-on", "Operations", "Medium", r"(?<![\w.])(?:DEBUG|debug)\s*=\s*(?:True|true)\b", ("Python", *JS, "Ruby", "PHP"), code=True),
    Rule("jwt-none", "Security", "High", r"(?i)algorithms?[\"']?\s*[:=]\s*\[?\s*[\"']none[\"']|verify_signature[\"']?\s*:\s*false"),
    Rule("hardcoded-password", "Security", "High", r"(?i)(?<![a-z])(?:password|passwd|pwd)\w*\s*(?::=|[:=])\s*[\"'][^\"'\s]{6,}[\"']", suppress=r"(?i)example|placeholder|your[-_]|getenv|environ|process\.env"),
    Rule("path-join-user", "Security", "Medium", r"\bpath\.(?:join|resolve)\s*\([^)]*\breq(?:uest)?\.(?:params|query|body)|\bopen\s*\(\s*request\."),
    Rule("open-redirect", "Security", "Medium", r"\bredirect\s*\(\s*req(?:uest)?\.(?:query|params|body|args|GET)\b"),
    Rule("ssrf", "Security", "Medium", r"\b(?:fetch|axios(?:\.\w+)?|requests\.\w+|http\.[Gg]et)\s*\(\s*req(?:uest)?\.(?:query|params|body|args|GET)\b"),
    Rule("empty-catch", "Reliability", "Low", r"\bcatch\s*(?:\([^)]*\)\s*)?\{\s*\}", (*JS, "Java", "C#", "PHP"), code=True, wide=True),
    Rule("python-bare-except", "Reliability", "Low", r"^\s*except\s*:", ("Python",), code=True),
    Rule("python-except-pass", "Reliability", "Low", r"^\s*except\b[^:]*:\s*pass\b", ("Python",), code=True),
    Rule("unhandled-promise", "Reliability", "Low", r"^\s*[\w.]+\([^()]*\)\.then\(", JS, code=True, once=True, suppress=r"\.catch\(|\.finally\("),
    Rule("todo-fixme", "Maintainability", "Informational", r"\b(?:TODO|FIXME|HACK|XXX)\b", once=True, commented=True),
    Rule("console-log", "Operations", "Informational", r"\bconsole\.(?:log|debug|info)\s*\(", JS, once=True, skip=TOOLS),
    Rule("pii-logging", "Privacy", "Medium", r"(?i)\b(?:log(?:ger|ging)?\.\w+|console\.\w+|print(?:ln)?)\s*\(.*(?<![a-z])(?:e_?mail|ssn|passport|phone|birth_?date)", LOGGING, code=True, once=True, skip=TOOLS),
    Rule("pii-in-url", "Privacy", "Medium", r"(?i)[?&](?:e_?mail|ssn|phone|dob)=\s*(?:\$\{|\{|[\"']\s*\+)", once=True),
    Rule("sync-io", "Performance", "Low", r"\bfs\.\w+Sync\s*\(|\b(?:read|write|append)FileSync\s*\(", JS, once=True, skip=TOOLS, suppress=r"require\.main|process\.argv"),
    Rule("loop-await", "Performance", "Low", r"\b(?:for|while)\s*\([^)]*\)\s*\{[^{}]*(?<![\w.])await\s", JS, code=True, wide=True, once=True),
    Rule("select-star", "Performance", "Informational", r"(?i)\bselect\s+\*\s+from\s", once=True),
    Rule("float-money", "Correctness", "Low", r"(?i)\b(?:price|amount|balance|invoice_?total)\w*\s*(?::\s*(?:float|double)\b|=\s*(?:float\(|parseFloat\())", once=True),
    Rule("http-plain", "Security", "Low", r"[\"'`]http://(?!localhost|127\.|0\.0\.0\.0|\[::1\])[\w.-]+", once=True),
    Rule("cookie-insecure", "Security", "Medium", r"(?i)\b(?:secure|http_?only)\s*[:=]\s*false\b", code=True),
    Rule("csrf-disabled", "Security", "Medium", r"@csrf_exempt\b|\bcsrf\s*[:=]\s*(?:false|False)\b|\.csrf\(\)\.disable\(|skip_before_action\s+:verify_authenticity_token", code=True),
    Rule("go-unchecked-err", "Reliability", "Low", r"(?:^|,)\s*_\s*:?=\s*[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\(", ("Go",), code=True),
    Rule("java-printstack", "Operations", "Informational", r"\.printStackTrace\s*\(\s*\)", ("Java", "Kotlin"), code=True),
    Rule("dotnet-async-void", "Reliability", "Low", r"\basync\s+void\s+(?!On[A-Z])\w+\s*\(", ("C#",), code=True),
    Rule("rails-html-safe", "Security", "Medium", r"\.html_safe\b|\braw\s*\(", ("Ruby",), code=True),
    Rule("php-extract", "Security", "Medium", r"\bextract\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)\b", ("PHP",), code=True),
    Rule("rust-unsafe", "Correctness", "Informational", r"\bunsafe\s*(?:\{|fn\b|impl\b)", ("Rust",), code=True),
    Rule("rust-unwrap", "Reliability", "Low", r"\.unwrap\(\)|\.expect\(", ("Rust",), code=True, suppress=r"#\[(?:cfg\(test\)|test)\]"),
)
COMMENT = r"^\s*(//|#|\*|/\*|<!--)"
#: Limits of a usual scan: characters of a line, lines of a text, hits of a rule in a text. None lifts one.
LONGEST_LINE, MOST_LINES, PER_FILE = 1200, 20_000, 5
LINES = "id {0}, language string, path string, line_no int, line string, code string, before string, context string, wide string"


def _lines(frames: Iterator[pd.DataFrame], rules: Sequence[Rule], longest: int | None, most_lines: int | None) -> Iterator[pd.DataFrame]:
    """The lines that any rule may match, blanked too, with their surroundings; hits of wide rules by name."""
    plain, wide = [r for r in rules if not r.wide], [r for r in rules if r.wide]
    flags = lambda p: re.compile(p.replace("(?i)", ""), re.I if "(?i)" in p else 0)
    tests = [(flags(r.pattern), r.languages) for r in plain]
    patterns = [(r, flags(r.pattern)) for r in wide]
    for frame in frames:
        out = []
        for i, language, path, text in zip(frame["id"], frame["language"], frame["path"], frame["content"], strict=True):
            lines = text.split("\n")
            if most_lines is not None and len(lines) > most_lines:
                continue
            blanked = blank_literals(text)
            code = blanked.split("\n")
            for r, pattern in patterns:
                if r.languages and language not in r.languages:
                    continue
                for m in pattern.finditer(blanked):
                    if not re.search(r"//|/\*|#", text[m.start() : m.end()]):  # a comment in it excuses it
                        n = blanked.count("\n", 0, m.start())
                        out.append((i, language, path, n + 1, lines[n], code[n], lines[n - 1] if n else "", "", r.name))
            own = [p for p, languages in tests if not languages or language in languages]
            for n, line in enumerate(lines):
                if (longest is None or len(line) <= longest) and any(p.search(line) for p in own):
                    out.append((i, language, path, n + 1, line, code[n], lines[n - 1] if n else "", "\n".join(lines[max(0, n - 2) : n + 4]), None))
        yield pd.DataFrame(out, columns=["id", "language", "path", "line_no", "line", "code", "before", "context", "wide"])


def scan(texts: DataFrame, rules: Sequence[Rule] = RULES, per_file: int | None = PER_FILE, longest: int | None = LONGEST_LINE, most_lines: int | None = MOST_LINES) -> DataFrame:
    """(id, rule, category, severity, line_no, more) of each hit.

    ``texts`` has id, language, content and may have path and is_test; tests are left out, as are null ids and texts. A
    rule hits a line once and a text at most ``per_file`` times; rules that report once carry the number of further hits
    in ``more``. Longer lines than ``longest`` and longer texts than ``most_lines`` are skipped; None lifts each limit.
    Comment lines don't count (but for rules that look there), nor does a line that names the rule after
    ``lint-ignore:``, or the line after it. Texts without any rule's pattern never leave the scan.
    """
    kind = texts.schema["id"].dataType.simpleString()
    path = F.col("path") if "path" in texts.columns else F.lit(None).cast("string")
    kept = texts.where("id is not null and content is not null")
    kept = kept.where("not coalesce(is_test, false)") if "is_test" in texts.columns else kept
    any_rule = "|".join(f"(?:{r.pattern})" for r in rules).replace("(?i)", "")
    possible = kept.where(F.col("content").rlike("(?im)" + any_rule)).select("id", "language", path.alias("path"), "content")
    lines = possible.mapInPandas(lambda frames: _lines(frames, rules, longest, most_lines), LINES.format(kind))
    comment = F.col("line").rlike(COMMENT)
    hits = []
    for r in rules:
        ok = F.col("wide").eqNullSafe(r.name) if r.wide else F.col("wide").isNull() & F.col("code" if r.code else "line").rlike(r.pattern)
        mark = F.lit(f"lint-ignore:{r.name}")
        ok &= ~F.contains("line", mark) & ~F.contains("before", mark)
        ok &= F.col("language").isin(*r.languages) if r.languages else F.lit(True)
        ok &= F.lit(True) if r.commented else ~comment
        ok &= ~F.col("context").rlike(r.suppress) if r.suppress else F.lit(True)
        ok &= ~F.coalesce(F.col("path"), F.lit("")).rlike(r.skip) if r.skip else F.lit(True)
        hits.append(F.when(ok, F.lit(r.name)))
    found = lines.select("id", "line_no", F.explode(F.array_compact(F.array(*hits))).alias("rule")).distinct()
    table = {r.name: r for r in rules}
    look = lambda value: F.create_map(*[F.lit(x) for n, r in table.items() for x in (n, value(r))])[F.col("rule")]
    own = Window.partitionBy("id", "rule")  # hits of one rule in one text
    ranked = found.select("*", F.row_number().over(own.orderBy("line_no")).alias("n"), F.count("*").over(own).alias("all"), look(lambda r: r.once).alias("once"))
    kept = ranked.where(F.when(F.col("once"), F.col("n") == 1).otherwise(F.lit(True) if per_file is None else F.col("n") <= per_file))
    return kept.select("id", "rule", look(lambda r: r.category).alias("category"), look(lambda r: r.severity).alias("severity"), "line_no", F.when(F.col("once"), F.col("all") - 1).otherwise(F.lit(0)).alias("more"))
