"""Which patterns of a catalog can match a text at all: one automaton over the literals that they require."""

from __future__ import annotations

import re
from collections import deque
from re import _constants as C
from re import _parser

#: Characters of a literal that is worth looking for.
LEAST = 3

#: Other letters that Python's patterns take for an ASCII one when case is ignored (fixed values).
_FOLDS = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def folded(text: str) -> str:
    """The text in lower case, with what matches an ASCII letter regardless of case as that letter."""
    return text.lower() if text.isascii() else text.translate(_FOLDS).lower()


def required(pattern: str, least: int = LEAST) -> frozenset[str]:
    """Lower-case ASCII literals of which every match of the pattern holds one; empty if none of ``least`` characters is known.

    They come from the pattern's parse tree: runs of plain characters, through groups and what is repeated at
    least once, and of alternatives one literal each. What is optional, a class, a look-around or a reference ends
    a run. Of several possible sets that with the longest shortest literal is taken, then the smallest.
    """
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return frozenset()
    return _best(_sets(tree), least)


def _best(sets: list[frozenset[str]], least: int) -> frozenset[str]:
    fit = [s for s in sets if s and min(map(len, s)) >= least]
    return max(fit, key=lambda s: (min(map(len, s)), -len(s), sorted(s)), default=frozenset())


def _sets(tree) -> list[frozenset[str]]:
    """Every known set of literals one of which the parsed sequence must hold."""
    out, run = [], []

    def ended() -> None:
        if run:
            out.append(frozenset(["".join(run)]))
            run.clear()

    def walk(items) -> None:
        for op, value in items:
            if op is C.LITERAL and value < 128:
                run.append(chr(value).lower())
            elif op is C.AT:
                continue  # no width: characters on both its sides still touch
            elif op is C.SUBPATTERN:
                walk(value[3])
            elif op is C.ATOMIC_GROUP:
                walk(value)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, inner = value
                if low == high == 1:
                    walk(inner)
                elif low:
                    walk(inner)  # the first time round follows what is before it
                    ended()
                else:
                    ended()
            elif op is C.BRANCH:
                ended()
                each = [_best(_sets(b), 1) for b in value[1]]
                if all(each):
                    out.append(frozenset().union(*each))
            else:
                ended()

    walk(tree)
    ended()
    return out


class Automaton:
    """Aho-Corasick: every literal in a text by one pass over it, in Python; see ``automaton``."""

    def __init__(self, literals: dict[str, list[int]]):
        self.step: list[dict[str, int]] = [{}]
        self.found: list[tuple[int, ...]] = [()]
        fail = [0]
        for literal, values in literals.items():
            at = 0
            for c in literal:
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.found.append(())
                    fail.append(0)
                at = self.step[at][c]
            self.found[at] += tuple(values)
        # breadth first, what a state can't go on with is taken over from the state it falls back to (but for the root's)
        queue = deque(self.step[0].values())
        while queue:
            at = queue.popleft()
            back = fail[at]
            for c, to in self.step[at].items():
                fail[to] = self.step[back].get(c) or self.step[0].get(c, 0)
                queue.append(to)
            self.found[at] += self.found[back]
            if back:
                self.step[at] = self.step[back] | self.step[at]

    def held(self, text: str) -> set[int]:
        """What the literals in the text stand for."""
        out: set[int] = set()
        at, step, found, root = 0, self.step, self.found, self.step[0].get
        for c in text:
            at = step[at].get(c) or root(c, 0)
            if found[at]:
                out.update(found[at])
        return out


class _Compiled:
    """The same by the compiled automaton of ``ahocorasick``."""

    def __init__(self, literals: dict[str, list[int]]):
        import ahocorasick

        self.built = ahocorasick.Automaton()
        for literal, values in literals.items():
            self.built.add_word(literal, values)
        self.built.make_automaton()

    def held(self, text: str) -> set[int]:
        out: set[int] = set()
        for _, values in self.built.iter(text):
            out.update(values)
        return out


def automaton(literals: dict[str, list[int]]) -> Automaton | _Compiled:
    """An automaton for literals with what each stands for: compiled, where the module is installed."""
    try:
        return _Compiled(literals) if literals else Automaton(literals)
    except ImportError:
        return Automaton(literals)


class Prefilter:
    """The patterns, by number, that can match a text: those without a required literal, and those of whom the text holds one."""

    def __init__(self, patterns: list[str], least: int = LEAST):
        self.always: list[int] = []
        literals: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            need = required(p, least)
            if not need:
                self.always.append(i)
            for literal in need:
                literals.setdefault(literal, []).append(i)
        self.automaton = automaton(literals)

    def candidates(self, text: str) -> list[int]:
        """In the order of the patterns."""
        return sorted(self.automaton.held(folded(text)).union(self.always))
