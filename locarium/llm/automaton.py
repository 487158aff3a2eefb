"""Regular expressions to one combined, minimised, deterministic byte automaton.

Supported syntax: literals, ``\\xHH`` and escaped punctuation, classes with
ranges and ``^``, groups, ``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}``, ``{n,m}``.
"""

from __future__ import annotations

from array import array
from collections import defaultdict


class _Parser:
    def __init__(self, pattern: str, any_case: bool):
        self.s, self.i, self.any_case = pattern, 0, any_case

    def parse(self):
        node = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return node

    def alternatives(self):
        parts = [self.sequence()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.atom()
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.s.index("}", self.i)
                a, comma, b = self.s[self.i : end].partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
                self.i = end + 1
            node = ("rep", node, low, high)
        return node

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        if c.isalnum():
            raise ValueError(f"escape \\{c} isn't supported")
        return ord(c)

    def atom(self):
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            node = self.alternatives()
            if self.s[self.i : self.i + 1] != ")":
                raise ValueError(f"missing ) in {self.s!r}")
            self.i += 1
            return node
        if c == "[":
            self.i += 1
            negative = self.s[self.i] == "^"
            self.i += negative
            members: set[int] = set()
            while self.s[self.i] != "]":
                a = self.char()
                if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    members.update(range(a, self.char() + 1))
                else:
                    members.add(a)
            self.i += 1
            return ("set", self.cased(set(range(256)) - members if negative else members))
        return ("set", self.cased({self.char()}))

    def cased(self, members: set[int]) -> frozenset[int]:
        if self.any_case:
            for b in list(members):
                if 65 <= b <= 90 or 97 <= b <= 122:
                    members.add(b ^ 32)
        return frozenset(members)


def parse(pattern: str, any_case: bool = False):
    return _Parser(pattern, any_case).parse()


def mirrored(node):
    """The tree of the reversed language."""
    if node[0] == "cat":
        return ("cat", [mirrored(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [mirrored(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", mirrored(node[1]), *node[2:])
    return node


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, at: int) -> int:
        """Build node from state at; the state where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            start = self.state()
            self.empty[at].append(start)
            self.moves[start] = (node[1], end)
            return end
        if kind == "cat":
            for x in node[1]:
                at = self.add(x, at)
            return at
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                start = self.state()
                self.empty[at].append(start)
                self.empty[self.add(x, start)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            at = self.add(inner, at)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[at].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[at].append(end)
        for _ in range(high - low):
            at = self.add(inner, at)
            self.empty[at].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for y in self.empty[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(x for x in seen if self.moves[x] or x in self.accepts)


class Automaton:
    """``moves[state + byte]`` is the next state; states are multiples of 256.

    States of ``first_hit`` and above accept: ``hits[state]`` is the tuple of the
    rules that end there. State ``dead`` (of an anchored automaton) has no way out.
    """

    def __init__(self, moves: list[int], start: int, first_hit: int, hits: dict[int, tuple[int, ...]], dead: int):
        self.moves, self.start, self.first_hit, self.hits, self.dead = moves, start, first_hit, hits, dead

    def __getstate__(self) -> dict:
        return self.__dict__ | {"moves": array("i", self.moves).tobytes()}

    def __setstate__(self, state: dict) -> None:
        one = {}  # equal states are one object each, which keeps the list small
        self.__dict__ |= state | {"moves": [one.setdefault(x, x) for x in array("i", state["moves"])]}

    @property
    def states(self) -> int:
        return len(self.moves) // 256


def compile_rules(trees: list, anchored: bool = False) -> Automaton:
    """Subset construction over all rules at once, then minimisation."""
    nfa = _Nfa()
    root = nfa.state()
    for k, tree in enumerate(trees):
        start = nfa.state()
        nfa.empty[root].append(start)
        nfa.accepts[nfa.add(tree, start)] = k
    begin = nfa.closure([root])
    # bytes that no set tells apart share a class
    shapes: dict[tuple, list[int]] = defaultdict(list)
    sets = list({m[0] for m in nfa.moves if m})
    for b in range(256):
        shapes[tuple(b in s for s in sets)].append(b)
    classes = list(shapes.values())
    ids, order, rows = {begin: 0}, [begin], []
    for subset in order:
        row = []
        for members in classes:
            b = members[0]
            to = {m[1] for x in subset if (m := nfa.moves[x]) and b in m[0]}
            target = nfa.closure(to) if anchored else nfa.closure(to) | begin
            if target not in ids:
                ids[target] = len(order)
                order.append(target)
            row.append(ids[target])
        rows.append(row)
    labels = [tuple(sorted(nfa.accepts[x] for x in s if x in nfa.accepts)) for s in order]
    # Moore's refinement: split blocks until all members move to the same blocks
    block = [sorted(set(labels)).index(x) for x in labels]
    while True:
        kinds: dict[tuple, int] = {}
        new = [kinds.setdefault((block[i], *(block[t] for t in rows[i])), len(kinds)) for i in range(len(rows))]
        if len(kinds) == len(set(block)):
            break
        block = new
    first = {}
    for i, k in enumerate(block):
        first.setdefault(k, i)
    ranked = sorted(first, key=lambda k: (bool(labels[first[k]]), first[k]))
    place = {k: n * 256 for n, k in enumerate(ranked)}
    moves = [0] * (256 * len(ranked))
    for k in ranked:
        for members, t in zip(classes, rows[first[k]], strict=True):
            for b in members:
                moves[place[k] + b] = place[block[t]]
    hits = {place[k]: labels[first[k]] for k in ranked if labels[first[k]]}
    dead = next((place[block[i]] for i, s in enumerate(order) if not s), -1)
    return Automaton(moves, place[block[0]], min(hits, default=256 * len(ranked)), hits, dead)
