"""Source files that do not parse.

Contents are lexed into rows: each different pair of adjacent token classes of a file (with its first line), each
bracket that does not close in its own line, each lexical error. Pairs are anti-joined against those that the grammar
of the language permits. Brackets, indented blocks among them, are validated with windowed reductions: the running sum
of openers and closers gives a depth, and along each depth of a file openers and matching closers must alternate.
Statement productions are checked on the same rows: a try block's closer must be followed by a handler and a do block's
by its condition, a JSON text is one value, a Go file begins with its package clause. Headers, argument and parameter
lists, displays, conditional expressions and assignment targets are rows of their own, each the sequence of its parts,
and are matched against PRODUCTIONS.

Token classes are single characters; the tables of permitted pairs are generated from follow sets below. Commas and line
ends have classes by the bracket they stand in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import written

LANGUAGES = ("Python", "JavaScript", "TypeScript", "Go", "JSON")
OPEN, CLOSE = "([{", ")]}"
MATCH = {")": "(", "]": "[", "}": "{", "<": ">"}

# --- Python -------------------------------------------------------------------------------------------------------
# n name, m soft keyword, c number or constant, s string, E ellipsis, u + -, ~, * and ^ for **, o binary operator, < comparison, = , a augmented
# assignment, w walrus, r arrow, b and/or, ! not, i in, I is, 1..9 and letters below for keywords, N newline, O newline after a block in one line, B newline after a block's colon,
# > indent, } ... brackets themselves, < dedent as "d", S start, Z end
PY_KEYWORDS = {"and": "b", "or": "b", "not": "!", "in": "i", "is": "I", "if": "f", "else": "e", "for": "F", "lambda": "l", "await": "W", "yield": "y", "async": "A", "from": "R", "import": "M", "as": "T", "def": "D", "class": "D", "return": "t", "raise": "t", "del": "x", "assert": "x", "global": "g", "nonlocal": "g", "pass": "p", "break": "p", "continue": "p", "while": "h", "elif": "L", "try": "Y", "except": "X", "finally": "Q", "with": "h", "None": "c", "True": "c", "False": "c", "match": "m", "case": "m", "type": "m"}
PY_TOKEN = re.compile(
    r"(?P<skip>[ \t\f]+|\\\r?\n|#[^\n\r]*)|(?P<nl>\r\n|\n|\r)|(?P<s>(?:[rRbBuUfFtT]{1,2}(?=[\"']))?(?:\"\"\"|'''|\"|'))|(?P<c>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"|(?P<n>[^\W\d]\w*)|(?P<o>\.\.\.|->|:=|\*\*=|//=|>>=|<<=|\*\*|//|<<|>>|[<>=!]=|[-+*/%@&|^]=|[-+*/%@&|^~<>=.,:;(){}\[\]])"
)
PY_OPERATORS = {"...": "E", "->": "r", ":=": "w", "**": "^", "*": "*", "+": "u", "-": "u", "~": "~", "=": "=", "<": "<", ">": "<", "@": "@"} | dict.fromkeys(["==", "!=", "<=", ">="], "<") | dict.fromkeys(["//", "<<", ">>", "/", "%", "&", "|", "^"], "o") | dict.fromkeys(["**=", "//=", ">>=", "<<=", "+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^="], "a")
PY_START, PY_END = "ncsm([{u~!lWE", "ncsm)]}E"
PY_AFTER_END = "u*^o<!iIbfeFATRM,:.;=awr([)]}NOB@"
PY_STATEMENT = PY_START + "@*yfFADRMtxgphLYXQedZTt" + "m"
PY_NEW = "".join(c for c in PY_STATEMENT if c not in "eLXQ")
PY_FOLLOW = (
    dict.fromkeys(PY_END, PY_AFTER_END)
    | {"s": PY_AFTER_END + "s", "m": PY_AFTER_END + PY_START, "u": PY_START, "~": PY_START, "o": PY_START + ",):", "*": PY_START + ",):NO;", "^": PY_START, "<": PY_START, "=": PY_START + "*y", "a": PY_START + "*y", "w": PY_START + "y", "r": PY_START, "b": PY_START, "!": PY_START + "i", "i": PY_START + "*", "I": PY_START}
    | {"(": PY_START + "*^)y", "[": PY_START + "*]:y", "{": PY_START + "*^}", ",": PY_START + "*^)]}NO=:oB", ":": PY_START + "*NOB],):=ytpxgRMhfFDA}", ".": "nmME.", ";": PY_NEW + "NO", "@": PY_START}
    | {"f": PY_START, "e": PY_START + ":", "F": PY_START + "*", "T": "nm([", "R": PY_START + ".E", "M": "nm(*", "D": "nm", "t": PY_START + "*NO;", "y": PY_START + "*RNO),;]}", "X": PY_START + ":*", "Y": ":", "Q": ":", "h": PY_START, "A": "DFh", "W": PY_START, "g": "nm", "x": PY_START, "p": "NO;", "L": PY_START, "l": "nm:*^"}
    | {"N": PY_NEW, "O": PY_STATEMENT, "B": ">", ">": PY_NEW.replace("Z", "").replace("d", ""), "d": PY_STATEMENT, "S": PY_NEW}
)

# --- JavaScript and TypeScript ------------------------------------------------------------------------------------
# n name, x contextual keyword, c number or constant, s string, t template, r regular expression, k private name, v ?. , q ?, > arrow, = , a assignment
# operator, u + -, p ++ --, o binary operator, < and G for comparison and >, !, ~, . , j a comma outside of [ ], D ..., V declaration, f function, K class, R return/throw, P keyword before (, E do, e else, Y try, H catch,
# Q finally, N new, U unary keyword, I in/instanceof, C case, F default, B break, M import, X export, W yield, T extends
JS_KEYWORDS = dict.fromkeys(["var", "const"], "V") | {"let": "x", "function": "f", "class": "K", "return": "R", "throw": "R", "else": "e", "do": "E", "try": "Y", "catch": "H", "finally": "Q", "new": "N", "case": "C", "default": "F", "import": "M", "export": "X", "yield": "W", "extends": "T", "debugger": "B", "enum": "K"} | dict.fromkeys(["if", "while", "for", "switch", "with"], "P") | dict.fromkeys(["typeof", "void", "delete", "await"], "U") | dict.fromkeys(["in", "instanceof"], "I") | dict.fromkeys(["break", "continue"], "B") | dict.fromkeys(["this", "super", "null", "true", "false"], "c") | dict.fromkeys(["async", "of", "get", "set", "static", "from", "as"], "x")
TS_WORDS = ["type", "interface", "declare", "namespace", "module", "abstract", "readonly", "public", "private", "protected", "keyof", "infer", "satisfies", "implements", "is", "asserts", "unique", "override", "accessor", "out", "global"]
JS_TOKEN = re.compile(
    r"(?P<skip>[ \t\f\v ﻿]+|//[^\n\r ]*)|(?P<long>/\*)|(?P<nl>\r\n|[\n\r  ])|(?P<s>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')|(?P<q>[\"'])|(?P<t>`)"
    r"|(?P<c>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<n>[A-Za-z_$ª-῿぀-퟿][\w$‌‍]*)|(?P<k>#[A-Za-z_$][\w$]*)"
    r"|(?P<o>\.\.\.|=>|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|\*\*|<<|>>>|>>|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[<>=!]=|[-+*/%&|^]=|[-+*/%&|^~!<>=.,:;?@(){}\[\]])"
)
JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[A-Za-z]*")
JS_OPERATORS = {"...": "D", "=>": ">", "=": "=", "?.": "v", "?": "q", "++": "p", "--": "p", "+": "u", "-": "u", "!": "!", "~": "~", ">": "G", ">>": "G", ">>>": "G", "<": "<", "*": "*"} | dict.fromkeys([">>>=", "**=", "<<=", ">>=", "&&=", "||=", "??=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="], "a") | dict.fromkeys(["===", "!==", "==", "!=", "<=", ">="], "L") | dict.fromkeys(["**", "<<", "&&", "||", "??", "/", "%", "&", "|", "^"], "o")
JS_END, JS_START = "ncstrkx)]}", "ncstrkx([{up!~fKNUMW@<"
JS_BINARY = "uoLG<*I=aqvT.,;:)]}([>ptx"
JS_STATEMENT = JS_START + "VRPEYBCFX;{}HQ"


def _js_follow(typed: bool) -> dict[str, str]:
    end = JS_BINARY + "{" + ("!" if typed else "")
    follow = dict.fromkeys("ncstrk", end) | {"s": JS_BINARY, "c": JS_BINARY + "{", "r": JS_BINARY, "t": JS_BINARY, "n": end, "k": end}
    follow |= {"x": end + JS_START + "VDE", ")": end + JS_STATEMENT, "]": JS_BINARY + ("!{" if typed else "{"), "}": end + JS_STATEMENT + "Z", "p": JS_BINARY + "nck([x", "(": JS_START + ")DV;" + ("*" if typed else ""), "[": JS_START + "],D" + ("-" if typed else ""), "{": JS_STATEMENT + "D,*.I" + ("o" if typed else ""), ",": JS_START + "D)]},*" + "VFIPERCYHQBTX", ";": JS_STATEMENT + ")DZ", ":": JS_STATEMENT + ("o)D*" if typed else ""), ".": "nkx", "v": "nkx([t"}
    follow["s"] += "{" if typed else ""
    follow |= dict.fromkeys("uoL*=a~!Iq>", JS_START) | {"<": JS_START + ("cs" if typed else ""), "G": JS_START + ("uoLG<=,;:)]}([>.T{qxvI*" if typed else ""), "*": JS_START + "x=,}", "q": JS_START + (":),;=]}G" if typed else "") + ".", "D": JS_START, "=": JS_START + ("o" if typed else ""), "<": JS_START + "/", ">": JS_START}
    if typed:
        follow[","] += "G"
        follow |= {"!": JS_START + "uoLG<*I=aqv.,;:)]}([", "o": JS_START + "<", "u": JS_START + "q", "I": JS_START, "T": JS_START, "=": JS_START + "o"}
    follow |= {"V": "nx[{k" + ("K" if typed else ""), "f": "nx(*" + ("<" if typed else ""), "K": "nx{T" + ("<" if typed else ""), "R": JS_START + ";}", "P": "(xU", "E": JS_STATEMENT, "Y": "{", "H": "({", "Q": "{", "N": "ncx(.fK[t", "U": JS_START + ")" + ("G,;]}|o:=Z" if typed else ""), "C": JS_START, "F": ":" + JS_START + "xV" + "},", "B": "nx;}Z", "M": "nxs{*(.t" + ("=" if typed else ""), "X": "VfKxF{*nM@" + ("=" if typed else ""), "W": JS_START + "*;)],}", "T": JS_START, "@": "nxc(", "S": JS_STATEMENT + "Z"}
    follow |= {"e": JS_STATEMENT, "j": follow[","].replace(",", "")}
    follow["}"] += "e"
    follow[";"] += "e"
    return {a: b + "j" * ("," in b) for a, b in follow.items()}


# --- Go -----------------------------------------------------------------------------------------------------------
# n name, c number, s string, = , : , d :=, a assignment operator, u + - , *, &, o binary operator, L comparison, !, A <-, D ..., p ++ --, keywords: P package, M import, F func, T type, K struct/interface,
# m map, C chan, V var/const, R return, I if/switch/for/select, E else, G range, c case -> H, default -> J, B break..., g go/defer
GO_KEYWORDS = {"package": "P", "import": "M", "func": "F", "type": "T", "struct": "K", "interface": "K", "map": "m", "chan": "C", "var": "V", "const": "V", "return": "R", "if": "I", "switch": "I", "for": "I", "select": "I", "else": "E", "range": "G", "case": "H", "default": "J", "break": "B", "continue": "B", "goto": "B", "fallthrough": "B", "go": "g", "defer": "g"}
GO_TOKEN = re.compile(
    r"(?P<skip>[ \t\r﻿]+|//[^\n]*)|(?P<long>/\*)|(?P<nl>\n)|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\(?:[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.))'|`[^`]*`)|(?P<q>[\"'`])"
    r"|(?P<c>0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)|(?P<n>[^\W\d]\w*)|(?P<o>\.\.\.|<<=|>>=|&\^=|<-|:=|<<|>>|&\^|&&|\|\||\+\+|--|[<>=!]=|[-+*/%&|^]=|[-+*/%&|^~!<>=.,:;(){}\[\]])"
)
GO_OPERATORS = {"...": "D", "<-": "A", ":=": "d", "=": "=", "++": "p", "--": "p", "+": "u", "-": "u", "*": "*", "&": "&", "!": "!", "~": "!", "^": "u"} | dict.fromkeys(["<<=", ">>=", "&^=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="], "a") | dict.fromkeys(["==", "!=", "<=", ">=", "<", ">"], "L") | dict.fromkeys(["<<", ">>", "&^", "&&", "||", "/", "%", "|"], "o")
GO_START = "ncs([u*&!AFKmC"
GO_AFTER = "u*&oL=da:.,;([)]}{pAD"
GO_STATEMENT = GO_START + "TVRIHJBg;}{M"
GO_FOLLOW = {"n": GO_AFTER + "nsFKmC*[", "c": "u*&oL=a:.,;)]}{D", "s": "u*&oL=a:.,;([)]}{", ")": GO_AFTER + "nFKmC", "]": GO_AFTER + "nFKmC", "}": GO_AFTER + "Es", "(": GO_START + ")DT", "[": GO_START + "]:D", "{": GO_STATEMENT + "", ",": GO_START + ")}]DG_{", ";": GO_STATEMENT + "Z)", ":": GO_STATEMENT + "])}G", ".": "n(Ts", "u": GO_START, "*": GO_START, "&": GO_START, "o": GO_START, "L": GO_START, "!": GO_START, "A": GO_START + "C", "D": GO_START + ")]},", "=": GO_START + "G", "d": GO_START + "G", "a": GO_START, "p": ";{})", "P": "n", "M": "s(n.", "F": "n(", "T": "n()", "K": "{", "m": "[", "C": GO_START, "V": "n(", "R": GO_START + ";}", "I": GO_START + "{;VG", "E": "{I", "G": GO_START, "H": GO_START, "J": ":", "B": "n;}", "g": GO_START, "S": "P"}
GO_FOLLOW = {a: b + "j" * ("," in b) for a, b in (GO_FOLLOW | {"j": "".join(c for c in GO_FOLLOW[","] if c not in ")}]")}).items()}

# --- JSON ---------------------------------------------------------------------------------------------------------
# k key string, v any other value, : , o and l comma in an object or list
JSON_TOKEN = re.compile(r"(?P<skip>[ \t\r\n]+)|(?P<v>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|true\b|false\b|null\b)|(?P<o>[\[\]{}:,])")
JSON_KEY = re.compile(r"[ \t\r\n]*:")
JSON_FOLLOW = {"S": "v[{", "{": "k}", "k": ":", ":": "v[{", "v": "ol}]Z", "}": "ol}]Z", "]": "ol}]Z", "[": "v[{]", "o": "k", "l": "v[{"}

#: What the parts of a production may be, by language and its name. A call's parts are p positional, k keyword, s *, w **;
#: a parameter list's p plain, d with default, s *name, b bare *, w **name, /; a display's d key and value, e element,
#: w **; a conditional's f if and e else; a target's are token classes; a header's ; i (in or of) and x (anything else).
PY_TARGET = r"\*?(?:(?:[nmcs]|\(\)|\[\]|\{\})(?:\.[nm]|\(\)|\[\])*(?:\.[nm]|\[\])|[nm]|\(\)|\[\])"
PRODUCTIONS = {
    ("Python", "call"): r"[ps]*[ks]*[kw]*",
    ("Python", "parameters"): r"(?!/)(?!.*/.*/)p*(?:/p*)?d*(?:/d*)?(?:(?:s[pd]*|b[pd]+)w?|w)?",
    ("Python", "display"): r"[dw]*|[es]*",
    ("Python", "conditional"): r"(?:f(?:f(?:fe)*e)*e)*",
    ("Python", "target"): rf"{PY_TARGET}(?:,{PY_TARGET})*,?(?::.*)?|mn(?:\[\])?",
} | {(language, name): pattern for language in ("JavaScript", "TypeScript") for name, pattern in {"for": ";;|i", "if": "x", "while": "x", "switch": "x", "with": "x", "case in": "switch", "constant without value": "", "function without name": ""}.items()}
PRODUCTIONS |= {("Go", name): pattern for name, pattern in {"for": "|;;", "if": ";?", "switch": ";?", "select": "", "header without block": "", "two names": "fields|any", "three names": ""}.items()}

FOLLOW = {"Python": PY_FOLLOW, "JavaScript": _js_follow(False), "TypeScript": _js_follow(True), "Go": GO_FOLLOW, "JSON": JSON_FOLLOW}


class Sink:
    """Collects the rows of one text: first line of each pair, open brackets, lexical errors."""

    def __init__(self) -> None:
        self.pairs: dict[str, int] = {}
        self.brackets: list[tuple[int, str, str]] = []
        self.error: tuple[int, str] | None = None
        self.line_from = 0
        self.productions: dict[str, int] = {}

    def bracket(self, line: int, kind: str, note: str = "") -> None:
        if kind in CLOSE and len(self.brackets) > self.line_from and self.brackets[-1][1] == MATCH[kind] and not self.brackets[-1][2] and not note:
            self.brackets.pop()
        else:
            self.brackets.append((line, kind, note))

    def production(self, name: str, parts: str, line: int) -> None:
        self.productions.setdefault(f"{name}:{parts}", line)

    def end_line(self) -> None:
        self.line_from = len(self.brackets)


class Level:
    """What stands between two Python brackets, or one statement: token classes in parts, inner brackets closed up."""

    def __init__(self, name: str) -> None:
        self.name, self.parts, self.part = name, [], []

    def cut(self) -> None:
        self.parts.append("".join(self.part))
        self.part = []

    def close(self, out: Sink, line: int) -> None:
        if self.part:
            self.cut()
        whole = ",".join(self.parts)
        for part in whole.split("F")[0].split(","):
            ways = "".join(c for c in part if c in "fe")
            if ways:
                out.production("conditional", ways, line)
        if "F" in whole:
            return
        if self.name == "call" and len(self.parts) > 1:
            out.production("call", "".join("k" if x[1:2] == "=" else "s" if x[:1] == "*" else "w" if x[:1] == "^" else "p" for x in self.parts), line)
        elif self.name == "parameters" and self.parts:
            out.production("parameters", "".join("w" if x[:1] == "^" else "b" if x == "*" else "s" if x[:1] == "*" else "/" if x == "o" else "d" if "=" in x else "p" for x in self.parts), line)
        elif self.name == "{" and len(self.parts) > 1:
            out.production("display", "".join("w" if x[:1] == "^" else "s" if x[:1] == "*" else "d" if ":" in x.split("l")[0] else "e" for x in self.parts), line)

    def statement(self, out: Sink, line: int) -> None:
        """End a statement: its targets and conditionals."""
        self.cut()
        whole = ",".join(self.parts)
        head = whole[:1]
        if head != "m" or "=" in whole:
            ways = "".join(c for c in whole[head in ("f", "e") :].split("F")[0] if c in "fe") if head not in ("F", "A") else ""
            if ways:
                out.production("conditional", ways, line)
        for target in whole.split("l")[0].split("=")[:-1] if "=" in whole.split("l")[0] else ():
            out.production("target", target, line)
        self.parts = []


def lex_python(text: str, out: Sink) -> None:
    at, line, depth, prev, begin = 0, 1, 0, "S", True
    indents, head, last_open = [0], "", ""
    n, match, pairs = len(text), PY_TOKEN.match, out.pairs
    if text.startswith("﻿"):
        at = 1
    fresh = False
    levels, defined, before = [Level("")], "", ""
    while at < n:
        if begin and not depth:
            stop = at
            column = 0
            while stop < n and text[stop] in " \t\f":
                column = column + 1 if text[stop] == " " else column // 8 * 8 + 8 if text[stop] == "\t" else 0
                stop += 1
            if stop < n and text[stop] not in "#\r\n":
                if column > indents[-1]:
                    indents.append(column)
                    pairs.setdefault(prev + ">", line)
                    prev = ">"
                    out.brackets.append((line, ">", head))
                while column < indents[-1]:
                    indents.pop()
                    pairs.setdefault(prev + "d", line)
                    prev = "d"
                    word = re.match(r"\w*", text[stop : stop + 8])[0]
                    out.brackets.append((line, "<", word if column >= indents[-1] and word in ("except", "finally", "else", "elif") else ""))
                    if column > indents[-1]:
                        out.error = (line, "unindent matches no outer level")
                        return
                out.end_line()
                fresh = True
            at, begin = stop, False
            continue
        m = match(text, at)
        if not m:
            out.error = (line, f"invalid character {text[at]!r}")
            return
        kind, value = m.lastgroup, m[0]
        at = m.end()
        if kind == "skip":
            if value[0] == "\\":
                line += 1
            continue
        if kind == "nl":
            line += 1
            if depth:
                continue
            begin = True
            out.end_line()
            levels[0].statement(out, line - 1)
            if prev in "SNOBd>":
                continue
            code = "B" if prev == ":" and last_open else "O" if last_open else "N"
            pairs.setdefault(prev + code, line - 1)
            prev, head = code, last_open or ""
            last_open = ""
            continue
        if kind == "s":
            quote = value.lstrip("rRbBuUfFtT")
            end = _string_end(text, at, quote)
            if end < 0:
                out.error = (line, "unterminated string literal")
                return
            if "f" in value[: len(value) - len(quote)].lower() and _bad_braces(text[at : end - len(quote)], "r" in value.lower()):
                out.error = (line, "f-string braces do not match")
                return
            line += text.count("\n", at, end)
            at, code = end, "s"
        elif kind == "c":
            code = "c"
            if at < n and (text[at].isalnum() or text[at] == "_") and not re.match(r"(?:and|or|if|else|in|is|for|not)\b", text[at : at + 5]):
                out.error = (line, "invalid number")
                return
            if len(value) > 1 and value[0] == "0" and value[1].isdigit() and not re.search(r"[.eEjJ]", value) and value.strip("0_"):
                out.error = (line, "leading zeros in a number")
                return
        elif kind == "n":
            code = PY_KEYWORDS.get(value, "n")
            if prev == ".":
                code = "n" if code in "nm" else code
            if code == "D":
                defined = value
            if fresh:
                last_open = value if value in ("if", "for", "while", "with", "try", "except", "finally", "else", "elif", "def", "class", "async", "match", "case") else ""
        else:
            code = PY_OPERATORS.get(value, value)
            if code in OPEN:
                depth += 1
                out.bracket(line, code)
                named = "parameters" if before == "D" and defined == "def" else "call" if prev in "nm)]" else ""
                levels[-1].part.append(code)
                levels.append(Level(named if code == "(" else code))
            elif code in CLOSE:
                depth = max(0, depth - 1)
                out.bracket(line, code)
                if len(levels) > 1:
                    levels.pop().close(out, line)
                levels[-1].part.append(code)
        if code == ";" or code == ":" and not depth and last_open and "l" not in levels[0].part:
            levels[0].statement(out, line)
        elif code == ",":
            levels[-1].cut()
        elif code not in OPEN and code not in CLOSE:
            levels[-1].part.append(code)
        before = "" if code == "[" and before == "D" else before if before == "D" and prev in "D" else code if code == "D" else ""
        fresh = False
        pairs.setdefault(prev + code, line)
        prev = code
    levels[0].statement(out, line)
    if depth == 0 and prev not in "SNOBd>":
        code = "B" if prev == ":" and last_open else "O" if last_open else "N"
        pairs.setdefault(prev + code, line)
        prev = code
    for _ in indents[1:]:
        pairs.setdefault(prev + "d", line)
        prev = "d"
        out.brackets.append((line, "<", ""))
    pairs.setdefault(prev + "Z", line)


def _string_end(text: str, at: int, quote: str) -> int:
    """Where a Python string that begins before ``at`` ends, or -1."""
    while True:
        end = text.find(quote, at)
        if end < 0:
            return -1
        if len(quote) == 1:
            stop = text.find("\n", at, end)
            while stop >= 0:
                back = stop - 1 if text[stop - 1] != "\r" else stop - 2
                if (len(text[at : back + 1]) - len(text[at : back + 1].rstrip("\\"))) % 2 == 0:
                    return -1
                stop = text.find("\n", stop + 1, end)
        slashes = 0
        while end - 1 - slashes >= at and text[end - 1 - slashes] == "\\":
            slashes += 1
        if slashes % 2 == 0:
            return end + len(quote)
        at = end + 1


def _bad_braces(body: str, raw: bool) -> bool:
    if "{" not in body and "}" not in body:
        return False
    depth = 0
    body = body.replace("\\N{", "")if not raw else body
    k = 0
    while k < len(body):
        c = body[k]
        if depth == 0 and body[k : k + 2] in ("{{", "}}"):
            k += 2
            continue
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth < 0:
                return "\\N" not in body
        k += 1
    return depth != 0


class Block:
    """An open bracket: its kind (block, literal, list, fields, any), what it belongs to, and the statement in it so far."""

    def __init__(self, kind: str, name: str, opener: str = "", members: bool = False) -> None:
        self.kind, self.name, self.opener, self.members, self.header, self.line, self.classes, self.any = kind, name, opener, members, "", 0, False, False
        self.begin()

    def begin(self) -> None:
        self.head, self.entered, self.semicolons, self.function, self.seen = "", False, 0, False, ""


def _js_block(code: str, prev: str, name: str, around: Block, typed: bool) -> Block:
    if code != "{":
        return Block("list", name, code)
    inner = around.kind != "block"
    literal = prev in "([" or prev in ",j:" and inner or prev in "=Rq" and not typed
    return Block("literal" if literal and not around.classes else "block", name, code, around.classes or prev in "=Rq:")


def _go_block(code: str, prev: str, around: Block) -> Block:
    if code != "{":
        return Block("any" if prev in "MVT" else "list", "", code)
    if prev == "K":
        return Block("fields", "", code)
    if prev in ",j:({=d&" and around.kind in ("literal", "list"):
        return Block("literal", "", code)
    if around.any or around.head and prev not in ")" or around.function and prev != ")":
        return Block("any", "", code)
    if prev in ")E;{I":
        return Block("block", "", code)
    return Block("literal" if prev in "n]" and not around.head and around.kind in ("block", "list", "literal") else "any", "", code)


def _lex_c(text: str, out: Sink, token: re.Pattern, keywords: dict[str, str], operators: dict[str, str], go: bool, after_operand: str) -> None:
    at, line, prev, fresh = 0, 1, "S", False
    n, match, pairs, depth = len(text), token.match, out.pairs, 0
    if text.startswith("#!") and not go:
        at = text.find("\n") if "\n" in text else n
    prev3, prev2, stack, word, closed, tried, typed = "", "", [], "", "", None, keywords.get("interface") == "x"
    names = 0
    top = Block("block", "") if go else Block("block", "", "")
    while at < n:
        m = match(text, at)
        if not m:
            out.error = (line, f"invalid character {text[at]!r}")
            return
        kind, value = m.lastgroup, m[0]
        begin, at = at, m.end()
        if kind == "skip":
            continue
        if kind == "nl":
            line += 1
            fresh = True
            out.end_line()
            continue
        if kind == "long":
            end = text.find("*/", at)
            if end < 0:
                out.error = (line, "unterminated comment")
                return
            breaks = text.count("\n", at, end)
            if breaks:
                line, fresh = line + breaks, True
                out.end_line()
            at = end + 2
            continue
        if kind == "q":
            out.error = (line, "unterminated string literal")
            return
        if kind == "t":
            end = _template_end(text, at)
            if end < 0:
                out.error = (line, "unterminated template")
                return
            line += text.count("\n", at, end)
            at, code = end, "t"
        elif kind == "s":
            code = "s"
            line += value.count("\n")
        elif kind == "c":
            code = "c"
            if at < n and (text[at].isalnum() or text[at] in "_$"):
                out.error = (line, "invalid number")
                return
        elif kind == "n":
            code = keywords.get(value, "n")
            if code != "n" and (prev in ".v" and prev != "S" or not go and code != "x" and value not in ("default", "case", "return", "else") and re.match(r"\s*:(?!:)", text[at : at + 3]) and prev in "{,j"):
                code = "n"
            elif value == "const" and prev == "x" and not go and text[m.start() - 3 : m.start() - 1] == "as":
                code = "n"
            elif code not in "nx" and not go and prev in "{,j;}>" and text[at : at + 1] == "(" and code not in "PUHRMcNWfI":
                code = "n"
        elif kind == "k":
            code = "k"
        elif value == "/" and not go and prev not in after_operand and (r := JS_REGEX.match(text, begin)):
            at, code = r.end(), "r"
        elif value == "/=" and not go and prev not in after_operand and (r := JS_REGEX.match(text, begin)):
            at, code = r.end(), "r"
        else:
            code = operators.get(value, value)
            if code == "," and (top.kind == "block" if go else top.opener != "["):
                code = "j"
        if tried is not None and not go:
            if value in ("catch", "finally", "while"):
                out.brackets[tried] = (*out.brackets[tried][:2], value)
            tried = None
        if go:
            if fresh and prev in "ncs)]}pRB":
                pairs.setdefault(prev + ("X" if top.kind in ("list", "literal") else ";"), line)
                if depth == 0 and prev != "P" and code not in ")]}":
                    pairs.setdefault("0" + code, line)
                pairs.setdefault(";" + code, line)
                if top.head and not top.entered:
                    out.production("header without block", top.head, line)
                top.begin()
            else:
                pairs.setdefault(prev + code, line)
            if code == ";":
                top.semicolons += 1
                if not top.head:
                    top.begin()
            elif code == "I":
                top.head, top.entered, top.semicolons = value, False, 0
            elif code == "F":
                top.any = top.any or prev == "]"
                top.function = True
            names = (0 if fresh else names) + 1 if code == "n" else 0
            if names == 3:
                out.production("three names", "nnn", line)
            elif top.seen == "n" and code == "n" and top.kind == "block" and depth:
                out.production("two names", top.kind, line)
            top.seen += code if len(top.seen) < 2 else ""
        else:
            if not (fresh and top.kind == "block" and (prev in JS_END + "pRB;" or code in "p")):
                pairs.setdefault(prev + code, line)
            if prev2 + prev == "(n" and code == ":" and not fresh:
                pairs.setdefault("(:", line)
            if prev2 == "S" and prev == "{" and code == "s":
                pairs.setdefault("S{s", line)
            if prev == "f" and code == "(" and (prev2 in "S;{" or prev2 == "}" and top.kind == "block" and line > top.line) and top.kind == "block" and not top.members:
                out.production("function without name", "f", line)
            if code == "C":
                out.production("case in", top.name, line)
            if code == ";" and prev in "nx" and prev2 == "V" and word == "const" and prev3 != "x":
                out.production("constant without value", ";", line)
            top.header += "" if code in CLOSE else ";" if code == ";" else "i" if code == "I" or value == "of" and prev in "nx]}" else "x"
        if code in OPEN:
            depth += 1
            stack.append(top)
            if go:
                top = _go_block(code, prev, top)
                if code == "{" and stack[-1].head and not stack[-1].entered:
                    out.production(stack[-1].head, ";" * stack[-1].semicolons, line)
                    stack[-1].entered = True
                out.bracket(line, code)
            else:
                name = ("for" if prev == "U" and prev2 == "P" else word if prev == "P" else "") if code == "(" else "try" if prev == "Y" else "do" if prev == "E" else closed if prev == ")" else ""
                top = _js_block(code, prev, name, top, typed)
                out.bracket(line, code, name if name in ("try", "do") else "")
        elif code in CLOSE:
            depth -= 1
            if not go and top.opener == "(" and top.name in ("for", "if", "while", "switch", "with"):
                kept = top.header.replace("x", "") if top.name == "for" else "".join(sorted(set(top.header)))
                out.production(top.name, "i" if top.name == "for" and "i" in kept and ";" not in kept else kept.replace("i", "") if top.name == "for" else kept.replace("i", "x")[:1] if ";" not in kept else kept, line)
            closed = top.name if top.opener == "(" else ""
            if not go and code == "}" and top.name in ("try", "do"):
                out.brackets.append((line, code, ""))
                tried = len(out.brackets) - 1
            else:
                out.bracket(line, code)
            top = stack.pop() if stack else Block("block", "")
            top.line = line
        if kind == "n" and code in "PVK":
            word = value
        if code in "K" and not go or value in ("interface", "enum", "declare", "namespace", "module") and not go:
            top.classes = True
        elif code in ";":
            top.classes = False
        prev3, prev2, prev, fresh = prev2, prev, code, False
    if prev not in JS_END + "pRB;S" or (go and prev == "S"):
        pairs.setdefault(prev + "Z", line)


def _template_end(text: str, at: int) -> int:
    """Where a template literal that begins before ``at`` ends, nested ones included, or -1."""
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif text.startswith("${", at):
            at, depth = at + 2, 1
            while at < n and depth:
                c = text[at]
                if c == "`":
                    at = _template_end(text, at + 1)
                    if at < 0:
                        return -1
                    continue
                if c in "\"'":
                    end = re.compile(r"(?:[^\\\n" + c + r"]|\\.)*" + c).match(text, at + 1)
                    if not end:
                        return -1
                    at = end.end()
                    continue
                depth += (c == "{") - (c == "}")
                at += 1
        else:
            nxt = re.compile(r"[\\`$]").search(text, at + 1)
            at = nxt.start() if nxt else n
    return -1


def lex_json(text: str, out: Sink) -> None:
    at, line, prev, stack = 0, 1, "S", []
    n = len(text)
    while at < n:
        m = JSON_TOKEN.match(text, at)
        if not m:
            out.error = (line, f"no JSON token at {text[at : at + 12]!r}")
            return
        at = m.end()
        if m.lastgroup == "skip":
            if "\n" in m[0]:
                line += m[0].count("\n")
                out.end_line()
            continue
        code = m[0]
        if m.lastgroup == "v":
            code = "k" if code[0] == '"' and JSON_KEY.match(text, at) else "v"
        elif code == ",":
            code = "o" if stack and stack[-1] == "{" else "l" if stack else ","
        elif code in OPEN:
            stack.append(code)
            out.bracket(line, code)
        elif code in CLOSE:
            if stack:
                stack.pop()
            out.bracket(line, code)
        if code == "k" and not (stack and stack[-1] == "{"):
            code = ","
        out.pairs.setdefault(prev + code, line)
        prev = code
    out.pairs.setdefault(prev + "Z", line)


def _words(typed: bool) -> dict[str, str]:
    return JS_KEYWORDS | (dict.fromkeys(TS_WORDS, "x") if typed else {})


LEXERS: dict[str, Callable[[str, Sink], None]] = {
    "Python": lex_python,
    "JSON": lex_json,
    "JavaScript": lambda t, out: _lex_c(t, out, JS_TOKEN, _words(False), JS_OPERATORS, False, JS_END),
    "TypeScript": lambda t, out: _lex_c(t, out, JS_TOKEN, _words(True), JS_OPERATORS, False, JS_END),
    "Go": lambda t, out: _lex_c(t, out, GO_TOKEN, GO_KEYWORDS, GO_OPERATORS, True, ""),
}


def permitted() -> list[tuple[str, str]]:
    """(language, pair) of all that the grammars permit; a bounded table."""
    out = [(language, a + b) for language, follow in FOLLOW.items() for a, bs in follow.items() for b in set(bs)]
    out.append(("TypeScript", "(:"))  # a parameter with its type
    out += [("Go", "0" + b) for b in "MFTV"] + [("Go", x + ";") for x in "ncs)]}pRB"] + [("Go", ";" + b) for b in set(GO_STATEMENT + ")F")]
    return sorted(set(out))


def lexed(text: str, language: str) -> list[tuple[str, int, int, str, str]]:
    """(kind, seq, line, code, note): kind P a pair, B a bracket, S a production, E an error."""
    out = Sink()
    LEXERS[language](text, out)
    rows = [("P", 0, line, pair, "") for pair, line in out.pairs.items()]
    rows += [("B", k, line, kind, note) for k, (line, kind, note) in enumerate(out.brackets)]
    rows += [("S", 0, line, parts, name) for made, line in out.productions.items() for name, parts in [made.split(":", 1)]]
    if out.error:
        rows.append(("E", 0, out.error[0], out.error[1], ""))
    return rows


def token_rows(texts: DataFrame) -> DataFrame:
    """The lexed rows of (key, language, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, lang, *row) for k, lang, t in zip(frame["key"], frame["language"], frame["content"], strict=True) for row in lexed(t, lang)]
            yield pd.DataFrame(rows, columns=["key", "language", "kind", "seq", "line", "code", "note"])

    return texts.select("key", "language", "content").mapInPandas(run, "key long, language string, kind string, seq int, line int, code string, note string")


def faults(rows: DataFrame) -> DataFrame:
    """(key, line, fault) of the lexed rows: lexical errors, pairs not permitted, brackets that do not match."""
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(permitted(), "language string, code string"))  # under 10,000 pairs
    wrong = rows.where("kind = 'P'").join(table, ["language", "code"], "left_anti").select("key", "line", F.concat(F.lit("token pair "), "code").alias("fault"))
    valid = F.broadcast(spark.createDataFrame([(*k, f"^(?:{v})$") for k, v in PRODUCTIONS.items()], "language string, note string, pattern string"))  # under 100 rows
    made = rows.where("kind = 'S'").join(valid, ["language", "note"], "left").where("not coalesce(code rlike pattern, true)")
    wrong = wrong.unionByName(made.select("key", "line", F.concat_ws(" ", F.lit("production"), "note", "code").alias("fault")))
    lexical = rows.where("kind = 'E'").select("key", "line", F.col("code").alias("fault"))
    opens = F.col("code").isin(*OPEN, ">")
    ordered = Window.partitionBy("key").orderBy("seq")
    depth = F.sum(F.when(opens, 1).otherwise(-1)).over(ordered) + F.when(opens, 0).otherwise(1)
    along = Window.partitionBy("key", "depth").orderBy("seq")
    b = rows.where("kind = 'B'").select("key", "seq", "line", "code", "note", depth.alias("depth"), opens.alias("opens"))
    b = b.select("*", F.lag("code").over(along).alias("before"), F.lag("note").over(along).alias("block"), F.lead("code").over(along).alias("after"))
    partner = F.create_map(*[F.lit(x) for pair in MATCH.items() for x in pair])
    handler = F.col("block").eqNullSafe("try") & ~F.col("note").isin("except", "catch", "finally") | F.col("block").eqNullSafe("do") & (F.col("note") != "while")
    orphan = F.when(F.col("note") == "except", ~F.col("block").isin("try", "except")).when(F.col("note") == "elif", ~F.col("block").isin("if", "elif")).when(F.col("note") == "finally", ~F.col("block").isin("try", "except", "else") & (F.col("code") == "<")).when((F.col("note") == "else"), ~F.col("block").isin("if", "elif", "for", "while", "try", "except", "async")).when(F.col("note") == "catch", F.col("block") != "try").otherwise(False)
    bad = (~F.col("opens") & (F.col("before").isNull() | (F.col("before") != F.element_at(partner, F.col("code"))) | handler | orphan)) | (F.col("opens") & (F.col("after").isNull() | F.col("after").isin(*OPEN, ">")))
    return wrong.unionByName(lexical).unionByName(b.where(bad).select("key", "line", F.concat(F.lit("unmatched "), "code").alias("fault")))


def unparsable(files: DataFrame, blobs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(id, project_id, language, line, fault) of each file whose content is not valid in its language; the first fault.

    ``files`` has id, project_id, language, hash; ``blobs`` hash, content. Files without content or in other languages
    are left out, as are rows without id; repeated rows count once. An empty text is valid except in Go and JSON. Each
    content is lexed once per language, whatever the number of its files.
    """
    own = files.where(F.col("id").isNotNull() & F.col("language").isin(*languages) & F.col("hash").isNotNull()).select("id", "project_id", "language", "hash").distinct()
    own = own.withColumn("key", F.xxhash64("hash", "language"))
    texts = own.select("hash", "language", "key").distinct().join(blobs.where("hash is not null and content is not null").select("hash", "content"), "hash")
    rows = written(token_rows(texts))
    first = faults(rows).groupBy("key").agg(F.min_by(F.struct("line", "fault"), F.struct("line", "fault")).alias("f")).select("key", "f.line", "f.fault")
    return own.join(first, "key").select("id", "project_id", "language", "line", "fault")
