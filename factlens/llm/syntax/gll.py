"""A generalised LL recogniser with a graph-structured stack.

Grammars are written as text, one rule per line:

    name : alternative | alternative

    "x"      the terminal x                 name     a rule
    UPPER    a terminal class               < ... >  a group, also before ? * +
    ANY      any terminal
    ( ... )  a bracket pair whose content derives what stands inside; same for [ ... ] and { ... } and ~ ... ~
    %list name sep sep                      the rule is a list, which may be cut after these terminals

Every bracket of the supported languages comes in pairs, so a token stream is first folded into nested sequences: a
bracket pair is one symbol that names its content. Equal contents share one number, and what a content derives is kept,
so a repeated structure is parsed once per process. Within a sequence the parser is the usual GLL loop: descriptors
(rule, dot, stack node, position), stack nodes (rule, position) with return edges, and the positions each node was
popped at. It takes any context-free grammar, ambiguous or left-recursive.
"""

from __future__ import annotations

import re

#: Numbers of bracket contents start here; below are terminals.
GROUPS = 1 << 16
OPEN = {"(": ")", "[": "]", "{": "}", "~": "~"}


class Grammar:
    """One grammar with its folded contents and what they derive."""

    def __init__(self, text: str):
        self.terminals: dict[str, int] = {}
        self.rules: dict[str, int] = {}
        self.alts: list[list[tuple]] = []
        self.cuts: dict[int, frozenset[int]] = {}
        self.content: list[tuple[int, tuple[int, ...]]] = []
        self.known: dict[tuple[int, tuple[int, ...]], int] = {}
        self.derived: dict[tuple[int, tuple[int, ...]], bool] = {}
        lists = []
        lines: list[str] = []
        for raw in text.splitlines():
            line = raw.strip()
            if not line or line.startswith("#"):
                continue
            if line.startswith("%list"):
                lists.append(line.split()[1:])
            elif re.match(r"\w+ :", line):
                lines.append(line)
            else:
                lines[-1] += " " + line
        for line in lines:
            self.rule(line.split(" :", 1)[0])
        for line in lines:
            name, body = line.split(" :", 1)
            words = re.findall(r'"[^"]+"|[A-Za-z_]\w*|[<>()\[\]{}~|?*+]', body)
            got, at = self._alternatives(words, 0, None)
            if at != len(words):
                raise ValueError(f"{name}: {words[at:]}")
            self.alts[self.rules[name]] += got
        for name, *seps in lists:
            self.cuts[self.rules[name]] = frozenset(self.terminal(s.strip(chr(34))) for s in seps)
        self._first()

    def rule(self, name: str) -> int:
        if name not in self.rules:
            self.rules[name] = len(self.alts)
            self.alts.append([])
        return self.rules[name]

    def terminal(self, name: str) -> int:
        return self.terminals.setdefault(name, len(self.terminals) + 1)

    def _fresh(self, alts: list[tuple]) -> int:
        self.alts.append(alts)
        return len(self.alts) - 1

    def _alternatives(self, words: list[str], at: int, end: str | None) -> tuple[list[tuple], int]:
        alts: list[list[tuple]] = [[]]
        while at < len(words) and words[at] != end:
            w = words[at]
            at += 1
            if w == "|":
                alts.append([])
                continue
            if w == "<":
                got, at = self._alternatives(words, at, ">")
                at += 1
                sym = ("n", self._fresh(got))
            elif w in OPEN:
                got, at = self._alternatives(words, at, OPEN[w])
                at += 1
                sym = ("g", self.terminal(w), self._fresh(got))
            elif w[0] == '"':
                sym = ("t", self.terminal(w[1:-1]))
            elif w == "ANY":
                sym = ("a", -1)
            elif w.isupper():
                sym = ("t", self.terminal(w))
            elif w[0].isalpha():
                sym = ("n", self.rules[w])
            else:
                raise ValueError(f"unexpected {w}")
            if at < len(words) and words[at] in "?*+":
                kind = words[at]
                at += 1
                if kind == "?":
                    sym = ("n", self._fresh([(), (sym,)]))
                else:
                    again = self._fresh([])
                    self.alts[again] += [(), (sym, ("n", again))]
                    sym = ("n", again) if kind == "*" else ("n", self._fresh([(sym, ("n", again))]))
            alts[-1].append(sym)
        return [tuple(a) for a in alts], at

    def _first(self) -> None:
        n = len(self.alts)
        self.null = [False] * n
        first: list[set[int]] = [set() for _ in range(n)]
        moved = True
        while moved:
            moved = False
            for r, alts in enumerate(self.alts):
                for alt in alts:
                    empty = True
                    for sym in alt:
                        if sym[0] == "n":
                            new = first[sym[1]] - first[r]
                            empty = self.null[sym[1]]
                        else:
                            new = {sym[1]} - first[r]
                            empty = False
                        if new:
                            first[r] |= new
                            moved = True
                        if not empty:
                            break
                    if empty and not self.null[r]:
                        self.null[r] = moved = True
        self.slots: list[tuple[tuple, ...]] = []
        self.entry: list[list[tuple[int, frozenset[int] | None]]] = []
        for alts in self.alts:
            here = []
            for alt in alts:
                can: set[int] | None = set()
                for sym in alt:
                    can |= first[sym[1]] if sym[0] == "n" else {sym[1]}
                    if sym[0] != "n" or not self.null[sym[1]]:
                        break
                else:
                    can = None
                here.append((len(self.slots), None if can is None or -1 in can else frozenset(can)))
                self.slots.append(alt)
            self.entry.append(here)

    def fold(self, bracket: int, inside: tuple[int, ...]) -> int:
        """The symbol of a bracket pair with this content."""
        key = (bracket, inside)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = GROUPS + len(self.content)
            self.content.append(key)
        return got

    def forget(self, most: int = 400_000) -> None:
        """Drops what is kept once it is large; call it between files only."""
        if len(self.content) + len(self.derived) > most:
            self.content.clear()
            self.known.clear()
            self.derived.clear()

    def derives(self, rule: int, seq: tuple[int, ...]) -> bool:
        """Whether the rule derives the whole sequence."""
        if not seq:
            return self.null[rule]
        key = (rule, seq)
        got = self.derived.get(key)
        if got is None:
            cuts = self.cuts.get(rule)
            if cuts is None and len(self.alts[rule]) == 1 and len(self.alts[rule][0]) == 1 and self.alts[rule][0][0][0] == "n":
                got = self.derives(self.alts[rule][0][0][1], seq)
            else:
                got = bool(cuts and self._by_parts(rule, seq, cuts)) or self._parse(rule, seq)
            self.derived[key] = got
        return got

    def _by_parts(self, rule: int, seq: tuple[int, ...], cuts: frozenset[int]) -> bool:
        """A list of lists is a list: true if the sequence falls into parts that each derive the rule (false says nothing)."""
        ends = [i + 1 for i, s in enumerate(seq) if (self.content[s - GROUPS][0] if s >= GROUPS else s) in cuts]
        if not ends or ends == [len(seq)]:
            return False
        if ends[-1] != len(seq):
            ends.append(len(seq))
        at = k = 0
        while at < len(seq):
            for j in range(k, min(k + 8, len(ends))):
                part = seq[at : ends[j]]
                got = self.derived.get((rule, part))
                if got is None:
                    got = self.derived[(rule, part)] = self._parse(rule, part)
                if got:
                    at, k = ends[j], j + 1
                    break
            else:
                return False
        return True

    def _parse(self, start: int, seq: tuple[int, ...]) -> bool:
        slots, entry, content, derives = self.slots, self.entry, self.content, self.derives
        n = len(seq)
        heads = [content[s - GROUPS][0] if s >= GROUPS else s for s in seq]
        root = (start, 0)
        edges: dict[tuple[int, int], list[tuple[int, int, tuple[int, int]]]] = {root: []}
        popped: dict[tuple[int, int], set[int]] = {root: set()}
        seen = set()
        todo = []
        head = heads[0] if n else 0
        for slot, can in entry[start]:
            if can is None or head in can:
                todo.append((slot, 0, root, 0))
        while todo:
            slot, dot, node, i = todo.pop()
            rhs = slots[slot]
            end = len(rhs)
            while dot < end:
                sym = rhs[dot]
                kind = sym[0]
                if kind == "t":
                    if i < n and seq[i] == sym[1]:
                        i += 1
                        dot += 1
                        continue
                    break
                if kind == "a":
                    if i < n and seq[i] < GROUPS:
                        i += 1
                        dot += 1
                        continue
                    break
                if kind == "g":
                    if i < n and heads[i] == sym[1] and seq[i] >= GROUPS and derives(sym[2], content[seq[i] - GROUPS][1]):
                        i += 1
                        dot += 1
                        continue
                    break
                callee = (sym[1], i)
                edge = (slot, dot + 1, node)
                back = edges.get(callee)
                if back is None:
                    edges[callee] = [edge]
                    popped[callee] = set()
                    head = heads[i] if i < n else 0
                    for s, can in entry[sym[1]]:
                        if can is None or head in can:
                            todo.append((s, 0, callee, i))
                elif edge not in back:
                    back.append(edge)
                    for j in popped[callee]:
                        d = (slot, dot + 1, node, j)
                        if d not in seen:
                            seen.add(d)
                            todo.append(d)
                break
            else:
                out = popped[node]
                if i not in out:
                    out.add(i)
                    if i == n and node is root or (i == n and node == root):
                        return True
                    for s, d, up in edges[node]:
                        e = (s, d, up, i)
                        if e not in seen:
                            seen.add(e)
                            todo.append(e)
        return False
