"""Lexers of the supported languages and the check of one text."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

from factlens.llm.syntax import grammars
from factlens.llm.syntax.gll import Grammar

#: The extensions of each language.
EXTENSIONS = {
    "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hh", "hpp", "hxx"],
    "csharp": ["cs"],
    "java": ["java"],
    "kotlin": ["kt", "kts"],
    "python": ["py"],
    "rayfall": ["rfl"],
    "ruby": ["rb"],
    "rust": ["rs"],
    "scala": ["scala", "sc"],
    "swift": ["swift"],
    "typescript": ["ts", "tsx", "js", "jsx"],
}
LANGUAGE_OF = {e: lang for lang, es in EXTENSIONS.items() for e in es}

CLOSE = {")": "(", "]": "[", "}": "{"}
LINE, BLOCK = r"//[^\n]*", r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
NUMBER = r"0[xXbBoO][0-9a-fA-F_']+\w*|(?:\d[\d_]*(?:'\d+)*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?\w*"
NAME = r"[^\W\d]\w*"
DQ, SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"


def braced(open_: str, depth: int = 8) -> str:
    """An interpolation: the opening text, then anything with paired braces and strings to this depth."""
    inner = r"[^{}\"'`\n]"
    for _ in range(depth):
        inner = rf"(?:[^{{}}\"'`\n]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\{{{inner}*\}})"
    return rf"{open_}{inner}*\}}"


def rounded(open_: str, depth: int = 8) -> str:
    """The same with round brackets."""
    inner = r"[^()\"\n]"
    for _ in range(depth):
        inner = rf"(?:[^()\"\n]|\"(?:[^\"\\\n]|\\.)*\"|\({inner}*\))"
    return rf"{open_}{inner}*\)"


CLOSES = {"(": ")", "[": "]", "{": "}"}


def inside(text: str, at: int, close: str) -> int:
    """The place of the bracket that closes what opened before `at`, strings and comments skipped; the end of the text if there is none."""
    wanted = [close]
    n = len(text)
    while at < n:
        c = text[at]
        if c == wanted[-1]:
            wanted.pop()
            if not wanted:
                return at
        elif c in CLOSES and wanted[-1] != "`":
            wanted.append(CLOSES[c])
        elif c == "`":
            wanted.append("`")
        elif c == "\\":
            at += 1
        elif wanted[-1] == "`":
            if text.startswith("${", at):
                wanted.append("}")
                at += 1
        elif c in "\"'":
            end = re.compile(r"(?:[^\\%s\n]|\\.)*" % c).match(text, at + 1).end()
            at = end if text[end : end + 1] == c else at
        elif text.startswith("//", at):
            at = text.find("\n", at) if "\n" in text[at:] else n
        elif text.startswith("/*", at):
            end = text.find("*/", at)
            at = end + 1 if end >= 0 else n
        at += 1
    return n


@dataclass
class Language:
    """A lexer and a grammar. `ends` are the terminals after which a line may end, `goes_on` those that never begin a statement."""

    name: str
    text: str
    start: str
    trivia: list[str]
    strings: list[str]
    operators: str
    keywords: str
    context: str = ""
    op: str = ""
    asg: str = ""
    lines: bool = False
    ends: str = ""
    goes_on: str = ""
    chars: str = ""
    special: list[tuple[str, str]] = field(default_factory=list)
    holes: str = ""
    hole_rule: str = ""
    string_first: str = "\"'`"
    names: str = NAME
    char_literals: bool = True

    def __post_init__(self) -> None:
        words = self.context.split()
        self.grammar = Grammar(self.text.replace("CTX", " | ".join(f'"{w}"' for w in words) or "ID"))
        t = self.grammar.terminals
        self.kind: dict[str, int] = {}
        for w in self.keywords.split() + words:
            self.kind[w] = self.grammar.terminal(w)
        ops = self.operators.split()
        for o in ops:
            name = "~~" if o == "~" else o
            if name in t:
                self.kind[o] = t[name]
            elif o in self.asg.split():
                self.kind[o] = self.grammar.terminal("ASG")
            elif o in self.op.split() or not self.op:
                self.kind[o] = self.grammar.terminal("OP")
        ids = {n: self.grammar.terminal(n) for n in ("ID", "NUM", "STR", "CHR", "N")}
        self.id, self.num, self.str, self.chr, self.n = ids["ID"], ids["NUM"], ids["STR"], ids["CHR"], ids["N"]
        self.open = {b: self.grammar.terminal(b) for b in "([{~"}
        self.may_end = {self.id, self.num, self.str, self.chr} | {self.grammar.terminal(w) for w in self.ends.split() + words}
        self.no_start = {self.kind.get(w, self.grammar.terminal(w)) for w in self.goes_on.split()}
        self.start_rule = [self.grammar.rules[r] for r in self.start.split()]
        skip = [r"[ \t\f\v\r﻿ ]+" if self.lines else r"[\s﻿]+", *self.trivia]
        tokens = [r"\n" if self.lines else "", *[p for p, k in self.special if k != "BAD"], *self.strings, NUMBER, self.names, *[p for p, k in self.special if k == "BAD"], *[re.escape(o) for o in sorted(ops, key=len, reverse=True)], r"[()\[\]{}]", r"[\s\S]"]
        self.pattern = re.compile(rf"(?:{'|'.join(skip)})*({'|'.join(x for x in tokens if x)}|\Z)")
        self.specials = [(re.compile(re.sub(r"\(\?[=!<](?:[^()]|\([^()]*\))*\)$", "", p)), self.grammar.terminal(k) if k != "BAD" else 0) for p, k in self.special]
        self.hole = re.compile(self.holes) if self.holes else None
        self.hole_at = self.grammar.rules[self.hole_rule] if self.hole_rule else -1

    def classify(self, tok: str) -> int:
        """The terminal of a token that is no keyword or operator; 0 if it is none."""
        c = tok[0]
        for p, k in self.specials:
            if p.fullmatch(tok):
                return k
        if c.isdigit() or (c == "." and len(tok) > 1 and tok[1].isdigit()):
            return self.num
        last = tok[-1]
        if len(tok) > 1 and last in self.string_first + "#" and (c in self.string_first or '"' in tok or "'" in tok):
            if last == "'" and self.char_literals:
                return self.chr
            return self.str
        if (c.isalpha() or c == "_" or c in "$@`") and len(tok) >= 1 and (c not in "$@`" or len(tok) > 1):
            return self.id
        return 0

    def accepts(self, text: str) -> bool:
        """Whether the text is a whole file of the language; blank texts and comments only are."""
        seq = self.fold(text)
        return seq is not None and any(self.grammar.derives(r, seq) for r in self.start_rule)

    def fold(self, text: str) -> tuple[int, ...] | None:
        """The nested terminals of a text, or None if it has no token or brackets that do not pair."""
        kind, classify, lines, n = self.kind, self.classify, self.lines, self.n
        fold, opens, may_end, no_start, sid = self.grammar.fold, self.open, self.may_end, self.no_start, self.str
        cur: list[int] = []
        stack: list[tuple[str, list[int]]] = []
        flat = ""  # innermost bracket
        prev, broke = 0, False
        for tok in self.tokens(text):
            k = kind.get(tok)
            if k is None:
                if tok == "\n":
                    broke = True
                    continue
                if tok in "([{" and tok:
                    if broke:
                        if lines and flat not in ("(", "[") and prev in may_end and self.starts(tok):
                            cur.append(n)
                        broke = False
                    stack.append((flat, cur))
                    flat, cur, prev = tok, [], 0
                    continue
                if tok in ")]}" and tok:
                    if flat != CLOSE[tok]:
                        return None
                    if lines and tok == "}" and prev in may_end:
                        cur.append(n)
                    broke = False
                    sym = fold(opens[flat], tuple(cur))
                    flat, cur = stack.pop()
                    cur.append(sym)
                    prev = -1
                    may_end.add(-1)
                    continue
                if not tok:
                    continue
                k = classify(tok)
                if k == 0:
                    return None
                if k == sid and self.hole is not None and not self.holes_ok(tok):
                    return None
            if broke:
                if lines and flat not in ("(", "[") and prev in may_end and k not in no_start:
                    cur.append(n)
                broke = False
            cur.append(k)
            prev = k
        if stack:
            return None
        if lines and prev in may_end:
            cur.append(n)
        return tuple(cur)

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text; what lies between them is dropped."""
        return self.pattern.findall(text) if self.pattern.groups == 1 else [m[1] for m in self.pattern.finditer(text)]

    def starts(self, bracket: str) -> bool:
        """Whether a bracket at the start of a line begins a statement."""
        return self.open[bracket] not in self.no_start

    def hole_texts(self, tok: str) -> list[str]:
        """The texts of the expressions inside a string; where `holes` is plain text, it opens one that ends at the bracket that pairs with it."""
        if self.hole.groups:
            return [m[1] for m in self.hole.finditer(tok)]
        out, at = [], 0
        while (m := self.hole.search(tok, at)) is not None:
            at = inside(tok, m.end(), CLOSES[m[0][-1]])
            out.append(tok[m.end() : at])
        return out

    def holes_ok(self, tok: str) -> bool:
        """Whether each expression inside a string is one."""
        for inner in self.hole_texts(tok):
            seq = self.fold(inner)
            while seq and seq[-1] == self.n:
                seq = seq[:-1]
            if not seq or not (self.grammar.derives(self.hole_at, seq) or self.grammar.derives(self.hole_at, (*seq, self.n))):
                return False
        return True


C_OPS = "== != <= >= && || << / % ^ | ? : ; , . -> ++ -- ... + - * & < > = ! ~ += -= *= /= %= &= |= ^= <<= >>= ::"
C_ASG = "+= -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??="
C_TYPES = "void char short int long float double signed unsigned _Bool bool _Complex"


class CLike(Language):
    """C and C++: type words are one terminal, conditional lines must pair, calls to cast words."""

    def __post_init__(self) -> None:
        super().__post_init__()
        self.kind |= {w: self.grammar.terminal("TYPE") for w in C_TYPES.split() + (["wchar_t", "char8_t", "char16_t", "char32_t"] if self.name == "cpp" else [])}
        if self.name == "cpp":
            self.kind |= {w: self.grammar.terminal("CAST") for w in ("static_cast", "dynamic_cast", "const_cast", "reinterpret_cast")}
            self.kind |= {w: self.grammar.terminal("OP") for w in ("and", "or", "xor", "bitand", "bitor", "not_eq")}

    def fold(self, text: str) -> tuple[int, ...] | None:
        depth = 0
        if "#" in text:
            for m in re.finditer(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|endif|el\w*)\b", text, re.M):
                depth += {"i": 1, "e": 0}[m[1][0]] if m[1] != "endif" else -1
                if depth < 0 or (m[1].startswith("el") and not depth):
                    return None
        return None if depth else super().fold(text)


PP = (r"(?m:^[ \t]*)#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|line|warning|elifdef|elifndef|include_next|import)\b(?:[^\n\\]|\\[\s\S])*|(?<![^\n])#[ \t]*(?=\n)", "PP")


class JavaLike(Language):
    """Java and C#: primitive types are one terminal."""

    def __post_init__(self) -> None:
        super().__post_init__()
        own = {"java": "boolean byte short int long char float double", "csharp": "bool byte sbyte short ushort int uint long ulong char float double decimal string object"}
        self.kind |= {w: self.grammar.terminal("PRIM") for w in own[self.name].split()}


class TsLike(Language):
    """TypeScript with JavaScript: var and const are one terminal, a slash after an operator opens a regular expression."""

    def __post_init__(self) -> None:
        super().__post_init__()
        self.kind |= {w: self.grammar.terminal("VAR") for w in ("var", "const")}
        self.may_end -= {self.kind[w] for w in ("type", "interface", "namespace", "declare", "abstract", "keyof", "infer", "implements") if w in self.kind}

    def fold(self, text: str) -> tuple[int, ...] | None:
        if text.startswith("#!"):
            text = text[text.find("\n") if "\n" in text else len(text) :]
        if "/" in text:
            text = _REGEX.sub(lambda m: m[1] or m[2] + "``", text) if _REGEX_HINT.search(text) else text
        return super().fold(text)


class Markup(TsLike):
    """The dialect with elements inside scripts: each whole element is rewritten as a sequence of the expressions it holds."""

    def fold(self, text: str) -> tuple[int, ...] | None:
        return super().fold(self.plain(text))

    def plain(self, text: str) -> str:
        out, at = [], 0
        for m in _ELEMENT.finditer(text):
            if m[1] or m.start(2) < at:
                continue
            got = self.element(text, m.start(2))
            if got is not None:
                out += [text[at : m.start(2)], got[0]]
                at = got[1]
        return "".join([*out, text[at:]]) if out else text

    def element(self, text: str, at: int) -> tuple[str, int] | None:
        """(the expressions as a sequence, end) of the element that begins at a place; None if it is none. Open tags are kept in a list, not by recursion."""
        parts: list[str] = []
        tags: list[str] = []
        while True:
            m = _TAG.match(text, at)
            if m is None:
                return None
            at = m.end()
            if m[1]:
                if not tags or tags.pop() != m[2]:
                    return None
                at = _BLANK.match(text, at).end()
                if not text.startswith(">", at):
                    return None
                at += 1
            else:
                alone = False
                while True:
                    at = _BLANK.match(text, at).end()
                    if text.startswith("/>", at) or text.startswith(">", at):
                        alone = text[at] == "/"
                        at += 2 if alone else 1
                        break
                    a = _ATTRIBUTE.match(text, at)
                    if a is not None:
                        at = a.end()
                    elif not text.startswith("{", at):
                        return None
                    if a is None or a[0].endswith("="):
                        if not text.startswith("{", at):
                            return None
                        end = inside(text, at + 1, "}")
                        hole = text[at + 1 : end].strip()
                        if end == len(text) or not hole or (a is None and not hole.startswith("...")):
                            return None
                        parts.append(hole.removeprefix("..."))
                        at = end + 1
                if not alone:
                    tags.append(m[2])
            # Text and holes between tags.
            while tags and not text.startswith("<", at):
                at = _WORDS.match(text, at).end()
                if text.startswith("{", at):
                    end = inside(text, at + 1, "}")
                    if end == len(text):
                        return None
                    hole = _COMMENTS.sub("", text[at + 1 : end]).strip()
                    if hole:
                        parts.append(hole.removeprefix("..."))
                    at = end + 1
                elif at == len(text) or text[at] in ">}":
                    return None
            if not tags:
                return "(" + ", ".join(["null", *[f"({self.plain('=' + x)[1:]})" for x in parts]]) + ")", at


_BLANK, _WORDS, _COMMENTS = re.compile(rf"(?:\s|{BLOCK}|{LINE})*"), re.compile(r"[^<>{}]*"), re.compile(rf"{BLOCK}|{LINE}")
_TAG = re.compile(r"<(/?)\s*((?:[A-Za-z_$][\w$]*(?:[-:.][\w$]+)*)?)(?=[\s/>])")
_ATTRIBUTE = re.compile(rf"[A-Za-z_$][\w$]*(?:[-:][\w$]+)*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?={{)))?")


_SKIP_JS = rf"{LINE}|{BLOCK}|{DQ}|{SQ}|`(?:[^`\\]|\\[\s\S])*`"
_REGEX_HINT = re.compile(r"(?:[=(,:;!&|?{\[}]|return)\s*/(?![*/])")
_REGEX = re.compile(rf"({_SKIP_JS})|((?:[=(,:;!&|?{{\[]|\breturn\b)[ \t\n]*)/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


_ELEMENT = re.compile(rf"({_SKIP_JS})|(?:[=(,:;!&|?{{}}\[>]|\breturn\b|\bdefault\b|\A)\s*(?=<)(?=<[A-Za-z_$>])()")


class Indented(Language):
    """Scala with significant indentation: a deeper block after a line that opens one is put in braces."""

    def fold(self, text: str) -> tuple[int, ...] | None:
        bare = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " " if m[0][0] == "/" else "x", m[0]), text)
        lines, plain = text.split("\n"), bare.split("\n")
        full = [i for i, x in enumerate(plain) if x.strip()]
        indent = {i: len(plain[i]) - len(plain[i].lstrip()) for i in full}
        out = [x for x in lines]
        open_: list[int] = []
        for k, i in enumerate(full):
            closed = 0
            while open_ and indent[i] < open_[-1]:
                open_.pop()
                closed += 1
            if _END.match(plain[i]):
                out[i] = ""
            lead = "}\n" * closed if plain[i].lstrip()[:1] not in (")", "]") else "}" * closed
            out[i] = lead + out[i]
            nxt = full[k + 1] if k + 1 < len(full) else None
            if nxt is None or indent[nxt] <= indent[i] or _END.match(plain[i]):
                continue
            code = plain[i].rstrip()
            m = _OPENS.search(code)
            if m is not None and not plain[nxt].lstrip().startswith("{"):
                # What follows the code of a line, a comment, is dropped.
                head = out[i][: len(out[i]) - len(lines[i]) + len(code)]
                out[i] = (head[:-1] if m[0] == ":" else head) + " {"
                open_.append(indent[nxt])
        return super().fold("\n".join(out) + "\n" + "}" * len(open_))


_HIDDEN = re.compile(rf'{LINE}|{BLOCK}|"""[\s\S]*?"""+|{DQ}|\'(?:[^\'\\\n]|\\[^\n]{{1,6}}?)\'')
_END = re.compile(r"\s*end(?:\s+[\w]+)?\s*$")
_OPENS = re.compile(r"(?<=[\w\])`]):$|(?:(?<=\s)=|\b(?:then|else|do|try|finally|match|catch|yield|return|with))$")


class Ruby(Language):
    """Blocks that close with `end` are folded as brackets; a modifier differs from the statement of the same word."""

    OPENERS = {"def", "class", "module", "begin", "case", "if", "unless", "while", "until", "for"}
    MODIFIERS = {"if", "unless", "while", "until", "rescue"}

    def __post_init__(self) -> None:
        super().__post_init__()
        t = self.grammar.terminal
        self.const, self.ivar, self.sym, self.label = t("CONST"), t("IVAR"), t("SYM"), t("LABEL")
        self.may_end |= {self.const, self.ivar, self.sym, -1}

    def fold(self, text: str) -> tuple[int, ...] | None:
        text = re.sub(r"(?ms)^__END__$.*", "", text)
        text = re.sub(r"(?ms)^=begin\b.*?^=end\b[^\n]*", "", text)
        text = _HEREDOC.sub(lambda m: '""' + m[3] + "\n", text)
        t = self.grammar.terminals
        opens, fold, n, may_end, no_start = self.open, self.grammar.fold, self.n, self.may_end, self.no_start
        cur: list[int] = []
        stack: list[tuple[str, list[int], bool]] = []
        flat, header = "", False
        prev, broke, word = 0, False, ""
        for tok in self.tokens(text):
            if tok == "\n":
                broke = True
                header = False
                continue
            if not tok:
                continue
            after_dot = word in (".", "&.")
            begins = not cur or cur[-1] == n or (broke and prev in may_end)
            k = self.kind.get(tok)
            if tok in "([{":
                if broke and flat not in ("(", "[") and prev in may_end:
                    cur.append(n)
                broke = False
                stack.append((flat, cur, header))
                flat, cur, prev, word, header = tok, [], 0, tok, False
                continue
            if tok in ")]}":
                if flat != CLOSE[tok]:
                    return None
                if tok == "}" and prev in may_end:
                    cur.append(n)
                sym = fold(opens[flat], tuple(cur))
                flat, cur, header = stack.pop()
                cur.append(sym)
                prev, broke, word = -1, False, tok
                continue
            first = tok[0]
            if k is not None and (after_dot or word == "def") and (first.isalpha()) and tok != "self":
                k = self.id
            elif k is None:
                if first == "@" or first == "$":
                    k = self.ivar
                elif first == ":" and len(tok) > 1:
                    k = self.sym
                elif len(tok) > 1 and tok[-1] == ":" and (first.isalpha() or first == "_" or first in "\"'"):
                    k = self.label
                elif first.isupper():
                    k = self.const
                elif first in "%/?" and len(tok) > 1:
                    k = self.str
                else:
                    k = self.classify(tok)
                    if k == 0:
                        return None
                    if k == self.str and '#{' in tok and first != "'" and not self.holes_ok(tok):
                        return None
            name = tok if k == self.kind.get(tok) else ""
            if name in self.MODIFIERS and not begins and (prev in may_end):
                k, name = t[name + "_"], ""
            if broke:
                if flat not in ("(", "[") and prev in may_end and k not in no_start:
                    cur.append(n)
                broke = False
            if name == "end":
                if flat != "~":
                    return None
                if prev in may_end:
                    cur.append(n)
                sym = fold(opens["~"], tuple(cur))
                flat, cur, header = stack.pop()
                cur.append(sym)
                prev, word = -1, "end"
                continue
            if name == "do" and header:
                header = False
                k, name = t["do_"], ""
            if name in self.OPENERS or name == "do":
                stack.append((flat, cur, header))
                flat, cur = "~", [k]
                header = name in ("while", "until", "for")
                prev, word = 0, tok
                continue
            cur.append(k)
            prev, word = k, tok
        if stack:
            return None
        if prev in may_end:
            cur.append(n)
        return tuple(cur)


_HEREDOC = re.compile(r"""<<([~-]?)(["'`]?)(?=[A-Z_])(?P<tag>[A-Z_]\w*)\2([^\n]*)\n(?:[\s\S]*?\n)??[ \t]*(?P=tag)(?=\n|\Z)""")
_HEREDOC = re.compile(r"""<<[~-]?(["'`]?)(?P<tag>[A-Z_][A-Z_0-9]*)\1((?:(?!\n)[\s\S])*)\n(?:[\s\S]*?\n)??[ \t]*(?P=tag)(?=\n|\Z)""")


class Python(Language):
    """Indentation is folded as brackets."""

    def fold(self, text: str) -> tuple[int, ...] | None:
        kind, classify, n, sid = self.kind, self.classify, self.n, self.str
        fold, opens = self.grammar.fold, self.open
        cur: list[int] = []
        stack: list[tuple[str, list[int]]] = []
        flat = ""
        levels = [0]
        indent: int | None = None
        depth = 0
        for tok in self.tokens("\n" + text):
            if not tok:
                continue
            if tok[0] == "\n":
                if not depth:
                    indent = len(tok[1:].expandtabs(8))
                continue
            if indent is not None:
                if cur and cur[-1] != n and not (cur[-1] >= 65536 and self.grammar.content[cur[-1] - 65536][0] == opens["~"]):
                    cur.append(n)
                if indent > levels[-1]:
                    if not cur or cur[-1] != n:
                        return None
                    levels.append(indent)
                    stack.append((flat, cur))
                    flat, cur = "~", []
                else:
                    while indent < levels[-1]:
                        levels.pop()
                        sym = fold(opens["~"], tuple(cur))
                        flat, cur = stack.pop()
                        cur.append(sym)
                    if indent != levels[-1]:
                        return None
                indent = None
            k = kind.get(tok)
            if k is None:
                if tok in "([{":
                    stack.append((flat, cur))
                    flat, cur = tok, []
                    depth += 1
                    continue
                if tok in ")]}":
                    if flat != CLOSE[tok]:
                        return None
                    sym = fold(opens[flat], tuple(cur))
                    flat, cur = stack.pop()
                    cur.append(sym)
                    depth -= 1
                    continue
                k = classify(tok)
                if k == 0:
                    return None
                if k == sid and "{" in tok and _FSTRING.match(tok) and not self.holes_ok(tok):
                    return None
            cur.append(k)
        if depth:
            return None
        if cur and cur[-1] < 65536 and cur[-1] != n or cur and cur[-1] >= 65536 and self.grammar.content[cur[-1] - 65536][0] != opens["~"]:
            cur.append(n)
        while len(levels) > 1:
            levels.pop()
            sym = fold(opens["~"], tuple(cur))
            flat, cur = stack.pop()
            cur.append(sym)
        return tuple(cur)

    def holes_ok(self, tok: str) -> bool:
        body = tok[_FSTRING.match(tok).end() :]
        return self._fields_ok(body[3:-3] if body[:3] in ('"""', "'''") else body[1:-1], False)

    def _fields_ok(self, body: str, spec: bool) -> bool:
        """Whether the fields of a format text are expressions; a format spec may hold fields of its own."""
        i = 0
        while i < len(body):
            two = body[i : i + 2]
            if two in ("{{", "}}") and not spec:
                i += 2
            elif body[i] == "}":
                return False
            elif body[i] != "{":
                i += 1
            else:
                depth, at, end = 0, i + 1, -1
                while at < len(body):
                    c = body[at]
                    if depth == 0 and (c in ":}" or (c == "!" and body[at + 1 : at + 2] != "=")):
                        end = at
                        break
                    depth += (c in "([{") - (c in ")]}")
                    at += 1
                if end < 0:
                    return False
                seq = self.fold("(" + body[i + 1 : end].strip().removesuffix("=").strip() + ")")
                if seq is None or not self.grammar.derives(self.hole_at, seq[:1]) or seq[1:] != (self.n,):
                    return False
                close, depth = end, 0
                while close < len(body) and (depth or body[close] != "}"):
                    depth += (body[close] == "{") - (body[close] == "}")
                    close += 1
                if close == len(body):
                    return False
                colon = body.find(":", end, close)
                if colon >= 0 and not self._fields_ok(body[colon + 1 : close], True):
                    return False
                i = close + 1
        return True


_FSTRING = re.compile(r"(?i)(?:f|rf|fr|t|rt|tr)(?=[\"'])")


def _languages() -> dict[str, list[Language]]:
    c_kw = "auto break case const continue default do else enum extern for goto if inline register restrict return sizeof static struct switch typedef union volatile while _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local __attribute__ asm typeof"
    c = CLike("c", grammars.C, "file", [LINE, BLOCK, r"\\\n"], [r"(?:u8|[uUL])?" + DQ, r"[uUL]?" + SQ], C_OPS, c_kw, asg=C_ASG, special=[PP, (r"/\*", "BAD"), (r"\"|'", "BAD")])
    cpp_kw = "alignas alignof asm auto break case catch class concept const consteval constexpr constinit continue co_await co_return co_yield decltype default delete do else enum explicit export extern final for friend goto if inline mutable namespace new noexcept operator override private protected public register requires return sizeof static static_assert struct switch template this thread_local throw try typedef typeid typename union using virtual volatile while __attribute__"
    cpp = CLike("cpp", grammars.CPP, "file", [LINE, BLOCK, r"\\\n"], [r"(?:u8|[uUL])?R\"(?P<d>[^()\\\s]{0,16})\([\s\S]*?\)(?P=d)\"", r"(?:u8|[uUL])?" + DQ, r"(?:u8|[uUL])?" + SQ], C_OPS + " <=>", cpp_kw, asg=C_ASG, special=[PP, (r"/\*", "BAD"), (r"\"|'", "BAD")])
    java_kw = "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while true false null record module open sealed permits var yield when non"
    java = JavaLike("java", grammars.JAVA, "file", [LINE, BLOCK], [r'"""[\s\S]*?"""', DQ, r"'(?:[^'\\\n]|\\[^\n]{1,6}?)'"], "== != <= >= && || << / % ^ | ? : ; , . -> ++ -- ... + - * & < > = ! ~ += -= *= /= %= &= |= ^= <<= >>= >>>= :: @", java_kw, asg=C_ASG, special=[(r"/\*", "BAD"), (r"\"|'", "BAD")])
    cs_kw = "abstract as base break case catch checked class const continue default delegate do else enum event explicit extern false finally fixed for foreach goto if implicit in interface internal is lock namespace new null operator out override params private protected public readonly ref return sealed sizeof stackalloc static struct switch this throw true try typeof unchecked unsafe using virtual void volatile while with get set init var when record partial where yield async await global add remove value file required and or not nameof scoped from select orderby let join group into on equals by ascending descending dynamic"
    inner = braced(r"\{")
    cs = JavaLike("csharp", grammars.CSHARP, "file", [LINE, BLOCK], [r'"""+[\s\S]*?"""+', r'\$@"(?:[^"]|"")*"|@\$"(?:[^"]|"")*"|@"(?:[^"]|"")*"', rf'\$"(?:[^"\\\n{{}}]|\\.|\{{\{{|\}}\}}|{inner})*"', DQ, r"'(?:[^'\\\n]|\\[^\n]{1,6}?)'"], "== != <= >= && || ?? << / % ^ | ? : ; , . -> => ++ -- .. + - * & < > = ! ~ += -= *= /= %= &= |= ^= <<= >>= ??= :: ?.", cs_kw, asg=C_ASG,
        special=[(r"(?m:^[ \t]*)#[ \t]*(?:if|else|elif|endif|region|endregion|pragma|nullable|define|undef|error|warning|line)\b[^\n]*", "PP"), (r"/\*", "BAD"), (r"\"|'", "BAD"), (r"@[^\W\d]\w*", "ID")], holes=rf'(?<!\{{)\{{(?!\{{)([^{{}}:,"]+)[^{{}}]*\}}', hole_rule="e", string_first="\"'")
    rust_kw = "as async await box break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub raw ref return self Self static struct super trait true type union unsafe use where while auto default _"
    rust = Language("rust", grammars.RUST.replace('"as_"', '"="').replace(" ID ", " id ").replace(" ID?", " id?").replace(" ID>", " id>").replace("<ID ", "<id ").replace("(<<ID", "(<<id") + 'id : ID | "auto" | "default" | "union" | "raw" | "box"\n', "file", [LINE, r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"], [r'b?r(?P<h>#*)"[\s\S]*?"(?P=h)', r'[bc]?"(?:[^"\\]|\\[\s\S])*"', r"b?'(?:[^'\\\n]|\\[^\n]{1,10}?)'"], "== != <= >= && || << / % ^ | ? : ; , . -> => .. ... ..= + - * & < > = ! ~ += -= *= /= %= &= |= ^= <<= >>= :: @ #", rust_kw, asg=C_ASG, special=[(r"'[^\W\d]\w*(?!')", "LIFE"), (r"r#[^\W\d]\w*", "ID"), (r"/\*", "BAD"), (r"\"|'", "BAD"), (r"\$[^\W\d]\w*|\$", "DOLLAR")], string_first="\"'#")
    ts_kw = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let"
    ts_ctx = "async await of get set type interface namespace module declare abstract readonly public private protected static as is keyof infer implements from global satisfies asserts unique require accessor override assert yield out"
    dollar = braced(r"\$\{")
    ts = TsLike("typescript", grammars.TS, "file", [LINE, BLOCK], [rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|{dollar.replace(chr(92) + 'n', '')})*`", DQ, SQ], "=== !== == != <= >= && || ?? ** << / % ^ | ? ?. : ; , . => ++ -- ... + - * & < > = ! ~ += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= @ #", ts_kw, ts_ctx, asg=C_ASG, lines=True, ends="break continue return this super null true false debugger default ++ -- !", goes_on=". ?. , ; : ? => = == === != !== <= >= && || ?? * / % ^ | & < > + - ) ] in instanceof else catch finally ASG OP {",
        special=[(r"/\*", "BAD"), (r"[\"'`]", "BAD")], names=r"[^\W\d]\w*|\$[\w$]*|[^\W\d][\w$]*", holes=r"(?<!\\)\$\{", hole_rule="e", char_literals=False)
    ts.name = "typescript"
    markup = Markup.__new__(Markup)
    markup.__dict__ = ts.__dict__
    kt_kw = "as break class continue do else false for fun if in interface is null object return super this throw true try typealias val var when while as? !in !is package import"
    kt_ctx = "public private protected internal open abstract final sealed data inner override lateinit const suspend inline infix operator tailrec external vararg noinline crossinline expect actual annotation enum value companion reified out by where constructor init get set file catch finally"
    ktargs = dict(trivia=[LINE, r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"], strings=[r'"""[\s\S]*?"""+', rf'"(?:[^"\\\n$]|\\.|\$(?!\{{)|{dollar})*"', r"'(?:[^'\\\n]|\\[^\n]{1,6}?)'"], operators="=== !== == != <= >= && || ?: .. ..< / % ? ?. : ; , . -> :: ++ -- !! + - * & < > = ! += -= *= /= %= @ !in !is as?", keywords=kt_kw, context=kt_ctx, asg=C_ASG, lines=True, ends="break continue return this super null true false ++ -- !! ? > * object", goes_on=". ?. , : ?: && || -> = ) ] else catch finally ASG as as? by where in is {",
        special=[(r"/\*", "BAD"), (r"[\"']", "BAD"), (r"`[^`\n]+`", "ID"), (r"!in\b|!is\b|as\?", "NEVER")], holes=r"(?<!\\)\$\{", hole_rule="e")
    kt = Language("kotlin", grammars.KOTLIN, "file", **ktargs)
    kts = Language("kotlin", grammars.KOTLIN, "file script", **ktargs)
    for k in (kt, kts):
        k.specials = k.specials[:-1]
        k.no_start -= {k.kind["where"], k.kind["by"]}
        # a soft keyword that follows a block goes on with it
        k.no_start |= {k.kind["catch"], k.kind["finally"]}
    sw_kw = "as associatedtype break case catch class continue default defer deinit do else enum extension fallthrough false for func guard if import in init inout is let nil operator precedencegroup protocol repeat rethrows return self Self static struct subscript super switch throw throws true try typealias var where while _ any some actor"
    sw_ctx = "get set willSet didSet public private fileprivate internal open package final override mutating nonmutating lazy weak unowned required convenience indirect dynamic optional async await nonisolated isolated prefix postfix infix each borrowing consuming Type Protocol"
    paren = rounded(r"\\\(")
    sw = Language("swift", grammars.SWIFT, "file", [LINE, r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"], [r'#"[\s\S]*?"#|"""[\s\S]*?"""', rf'"(?:[^"\\\n]|\\[^(\n]|{paren})*"'], "=== !== == != <= >= && || ?? .. ... ..< << / % ^ | ? : ; , . -> ++ -- + - * & < > = ! ~ += -= *= /= %= &= |= ^= <<= >>= &+ &- &* @ \\", sw_kw, sw_ctx, asg=C_ASG, lines=True, ends="break continue return fallthrough self Self super nil true false ? ! > init _ default rethrows throws",
        goes_on=". , : ? = == && || ?? -> ) ] else catch where in ASG OP | & {", special=[(r"#(?:if|elseif|else|endif|available|unavailable|selector|keyPath|file|line|function|warning|error|imageLiteral|colorLiteral)\b", "PP"), (r"/\*", "BAD"), (r"\"", "BAD"), (r"`[^`\n]+`|\$\d+|\$\w+", "ID")], holes=r"(?<!\\)\\\(", hole_rule="items", string_first='"#')
    sw.no_start.add(sw.kind["catch"])
    sc_kw = "case catch class def do else extends false final finally for forSome if implicit import lazy match new null object override package private protected return sealed super this throw trait true try type val var while with yield abstract enum given then export"
    sc_ctx = "inline open opaque transparent infix derives using extension as end"
    scala = Language("scala", grammars.SCALA, "file", [LINE, r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"], [r'(?:[a-z]\w*)?"""[\s\S]*?"""+', rf'(?:[a-z]\w*)"(?:[^"\\\n$]|\\.|\$(?!\{{)|{dollar})*"', DQ, r"'(?:[^'\\\n]|\\[^\n]{1,6}?)'"], "== != <= >= && || => <- ?=> <: >: <% ++ -- :: ::: += -= *= /= %= ++= | ^ / % ? : ; , . + - * & < > = ! ~ @ # :+ +: -> _", sc_kw, sc_ctx, asg="+= -= *= /= %= ++= |= &=", lines=True, ends="this super null true false return type _ * + given", goes_on=". , : => = ) ] else catch finally match yield extends with ASG then {", special=[(r"/\*", "BAD"), (r"[\"']", "BAD"), (r"`[^`\n]+`", "ID")], holes=r"(?<![\\$])\$\{", hole_rule="e")
    rb_kw = "alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __method__"
    rstr = r'"(?:[^"\\#]|\\[\s\S]|#(?!\{)|#\{(?:[^{}"]|"(?:[^"\\]|\\.)*"|\{[^{}]*\})*\})*"'
    ruby = Ruby("ruby", grammars.RUBY, "file", [r"#[^\n]*", r"\\\n"], [r"(?:" + rstr + r"|'(?:[^'\\]|\\[\s\S])*')(?::(?!:))?", r"`[^`]*`", r"%[wWiIqQr]?(?:\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|\|[^|\n]*\|)[a-z]*", r"(?<=[=(,~|&!\[{\s])/(?![ =/])(?:[^/\\\n]|\\.)+/[a-z]*", r":\"(?:[^\"\\]|\\.)*\"", r"(?<!:):(?:[^\W\d]\w*(?:[?!]|=(?![=~>]))?|\[\]=?|[+\-*/<>!~%]+)", r"[@$]{1,2}\w+|\$[!@&~0-9]", r"\?[A-Za-z](?!\w)"], "=== == != =~ !~ <= >= <=> && || << >> ** / % ^ | ? : ; , . &. -> => .. ... :: + - * & < > = ! ~ += -= *= /= %= &= |= ^= <<= >>= **= &&= ||=", rb_kw, asg=C_ASG, lines=True, ends="break next redo retry return self super nil true false yield __FILE__ __method__", goes_on=". &. , => ? : = && || and or ) ] then ASG", names=r"defined\?|[^\W\d]\w*:(?![:\w])(?=\s|$|[)\]},])|[^\W\d]\w*[?!]?(?!=[^=~>])|[^\W\d]\w*", holes=r"(?<!\\)#\{", hole_rule="stmts", char_literals=False)
    py_kw = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _"
    pre = r"(?i:[rbuft]|br|rb|fr|rf|tr|rt)?"
    py = Python("python", grammars.PYTHON, "file", [r"#[^\n]*", r"\\\n"], [rf'{pre}"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""', rf"{pre}'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''", pre + DQ, pre + SQ], "== != <= >= << >> ** // / % ^ | : ; , . -> := ... + - * & < > = ~ += -= *= /= //= %= &= |= ^= <<= >>= **= @ @=", py_kw, asg=C_ASG + " //= @=", lines=False, special=[(r"\n[ \t\f]*", "NEVER"), (r"[\"']", "BAD")], hole_rule="atom", char_literals=False)
    py.specials = py.specials[1:]
    for o in ("==", "!=", "<=", ">="):
        py.kind[o] = py.grammar.terminal("CMP")
    py.pattern = re.compile(py.pattern.pattern.replace(r"[\s﻿]+", r"[ \t\f\r﻿]+", 1))
    rfl = Language("rayfall", grammars.RFL, "file", [r";[^\n]*"], [r'"(?:[^"\\]|\\[\s\S])*"'], "'", "", names=r"[^\s()\[\]{}\"';]+", special=[(r"[^\s()\[\]{}\"';:]+:", "KEY"), (r"[^\s()\[\]{}\"';]+", "ATOM"), (r'"', "BAD")], string_first='"', char_literals=False)
    out = {x.name: [x] for x in (c, cpp, java, cs, rust, ts, kt, sw, scala, ruby, py, rfl)}
    indented = Indented.__new__(Indented)
    indented.__dict__ = scala.__dict__
    out["scala"].append(indented)
    out |= {"kts": [kts], **{e: [ts, markup] for e in ("tsx", "jsx", "js")}}
    return out


_ALL: dict[str, list[Language]] | None = None


def parses(text: str, extension: str) -> bool | None:
    """Whether a text is a whole file of the language of its extension; None for an extension of no language.

    Line ends of any kind count, a byte order mark is dropped.
    """
    global _ALL
    language = LANGUAGE_OF.get(extension)
    if language is None:
        return None
    if _ALL is None:
        # Brackets nest as deep as a file likes; calls between Python functions take heap, not stack.
        sys.setrecursionlimit(max(20_000_000, sys.getrecursionlimit()))
        _ALL = _languages()
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    for dialect in _ALL.get(extension) or _ALL[language]:
        dialect.grammar.forget()
        if dialect.accepts(text):
            return True
    return False
