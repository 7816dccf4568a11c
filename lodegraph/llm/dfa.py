"""Regular grammars compiled into one deterministic automaton.

Grammars are written as regular expressions without look-around or back-references. All of them become one
non-deterministic automaton (Thompson), which the subset construction makes deterministic, so a run reads each character
once, whatever the number of grammars, and never goes back. A group named ``v`` marks where a grammar's value begins.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_SPACE = frozenset(" \t\n\r\f\v")
_DIGIT = frozenset("0123456789")
#: Characters are told apart up to here; all others are one class, matched by what excludes or is not limited to these.
_ASCII = frozenset(map(chr, range(128)))
OTHER = "\u0100"
_ALL = _ASCII | {OTHER}


def _set(items) -> frozenset[str]:
    out: set[str] = set()
    negate = False
    for op, arg in items:
        if op is sre.NEGATE:
            negate = True
        elif op is sre.LITERAL:
            out.add(chr(arg) if arg < 128 else OTHER)
        elif op is sre.RANGE:
            out |= {chr(x) for x in range(arg[0], min(arg[1], 127) + 1)}
        elif op is sre.CATEGORY:
            named = {sre.CATEGORY_WORD: _WORD | {OTHER}, sre.CATEGORY_SPACE: _SPACE, sre.CATEGORY_DIGIT: _DIGIT, sre.CATEGORY_NOT_SPACE: _ALL - _SPACE, sre.CATEGORY_NOT_WORD: _ASCII - _WORD}
            out |= named[arg]
        else:
            raise ValueError(f"not regular here: {op}")
    return frozenset(_ALL - out if negate else out)


class _Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[str], int] | None] = []
        self.mark: dict[int, int] = {}
        self.accept: dict[int, int] = {}

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def add(self, tree, at: int, number: int, fold: bool) -> int:
        """Appends a parsed pattern after state ``at``; the state it ends in."""
        for op, arg in tree:
            if op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY):
                if op is sre.IN:
                    chars = _set(arg)
                elif op is sre.ANY:
                    chars = frozenset(_ALL - {"\n"})
                else:
                    one = _set([(sre.LITERAL, arg)])
                    chars = one if op is sre.LITERAL else frozenset(_ALL - one)
                if fold:
                    chars = frozenset(x for c in chars for x in (c.lower(), c.upper()))
                end = self.state()
                self.step[at] = chars, end
                at = end
            elif op is sre.SUBPATTERN:
                group, _, _, inner = arg
                start = self.state()
                self.eps[at].append(start)
                if group is not None and group == self.value_group:
                    self.mark[start] = number
                at = self.add(inner, start, number, fold)
            elif op is sre.BRANCH:
                end = self.state()
                for inner in arg[1]:
                    start = self.state()
                    self.eps[at].append(start)
                    self.eps[self.add(inner, start, number, fold)].append(end)
                at = end
            elif op is sre.MAX_REPEAT:
                low, high, inner = arg
                for _ in range(low):
                    start = self.state()
                    self.eps[at].append(start)
                    at = self.add(inner, start, number, fold)
                if high is sre.MAXREPEAT:
                    loop, out = self.state(), self.state()
                    self.eps[at].append(loop)
                    start = self.state()
                    self.eps[loop] += [start, out]
                    self.eps[self.add(inner, start, number, fold)].append(loop)
                    at = out
                else:
                    out = self.state()
                    for _ in range(high - low):
                        self.eps[at].append(out)
                        start = self.state()
                        self.eps[at].append(start)
                        at = self.add(inner, start, number, fold)
                    self.eps[at].append(out)
                    at = out
            else:
                raise ValueError(f"not regular here: {op}")
        return at

    def grammar(self, pattern: str, root: int, number: int) -> None:
        p = parser.parse(pattern)
        self.value_group = p.state.groupdict.get("v")
        start = self.state()
        self.eps[root].append(start)
        self.accept[self.add(p, start, number, bool(p.state.flags & sre.SRE_FLAG_IGNORECASE))] = number


class Dfa:
    """The automaton of all ``patterns``. States are numbers; 0 is the start, -1 means that nothing can match any more."""

    def __init__(self, patterns: list[str]) -> None:
        n = _Nfa()
        root = n.state()
        for i, p in enumerate(patterns):
            n.grammar(p, root, i)
        # characters that no grammar tells apart are one class
        sets = {s[0] for s in n.step if s}
        kinds: dict[tuple[bool, ...], int] = {}
        order = sorted(sets, key=sorted)
        self.classes = {c: kinds.setdefault(tuple(c in s for s in order), len(kinds)) for c in sorted(_ALL)}
        sample = {k: c for c, k in self.classes.items()}
        self.other = self.classes[OTHER]

        def closure(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for x in n.eps[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        first = closure([root])
        numbers, todo = {first: 0}, [first]
        self.next: list[list[int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.marks: list[tuple[int, ...]] = []
        while todo:
            now = todo.pop(0)
            row = []
            for k in range(len(kinds)):
                to = {n.step[s][1] for s in now if n.step[s] and sample[k] in n.step[s][0]}
                if not to:
                    row.append(-1)
                    continue
                c = closure(to)
                if c not in numbers:
                    numbers[c] = len(numbers)
                    todo.append(c)
                row.append(numbers[c])
            self.next.append(row)
            self.accepts.append(tuple(sorted({n.accept[s] for s in now if s in n.accept})))
            self.marks.append(tuple(sorted({n.mark[s] for s in now if s in n.mark})))

    def run(self, text: str, at: int) -> dict[int, tuple[int, int]]:
        """The grammars that match from ``at``: number -> (where its value begins, where its longest match ends)."""
        state, found, marked = 0, {}, {}
        following, accepts, marks, classes, other = self.next, self.accepts, self.marks, self.classes, self.other
        start = at
        for c in text[at:] if at + 4096 >= len(text) else _from(text, at):
            state = following[state][classes.get(c, other)]
            if state < 0:
                break
            at += 1
            for g in marks[state]:
                marked[g] = at
            for g in accepts[state]:
                found[g] = marked.get(g, start), at
        return found


def _from(text: str, at: int):
    """The characters of a long text from a place on, a stretch at a time."""
    while at < len(text):
        yield from text[at : at + 4096]
        at += 4096
