"""Weighted finite-state transducers for clauses, and their composition.

- ``Disguise``: from the characters of a token to words of a vocabulary (digits and signs for letters,
  one masked letter, stretched letters).
- ``Scope``: a bimachine over word classes. Its left-to-right half follows negation, denied opinions and
  reports, and naming; its right-to-left half finds words that are named afterwards ("... is a term").
  It gives every word the factor that what the word says keeps.
- ``Rules``: a grammar of weighted rules. A rule may call others (``@insult``, ``@you``), whose machines
  are put in its place and whose weights multiply.
- ``Composition``: Scope o Rules over the max-times semiring, made deterministic while it is used: a
  state is the state of the scope with the weighted set of rule states, and each (state, word) pair is
  worked out once a process.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# What is kept of a word that is denied, of one that is named, of one that a report puts in doubt.
SAID, DENIED, NAMED = 1.0, 0.1, 0.05
ANY = "*"


class Disguise:
    """Decodes a token by walking a trie of the vocabulary with all readings of its characters at once."""

    def __init__(self, words, signs: dict[str, str], masks: str, least: int = 4):
        self.root: dict = {}
        self.signs, self.masks, self.least = signs, set(masks), least
        for w in sorted(words):
            here = self.root
            for c in w:
                here = here.setdefault(c, {})
            here[""] = w

    def decode(self, token: str) -> str:
        """The vocabulary word behind the token, "" if there is none; a reading without a mask comes first."""
        live: list[tuple[dict, int]] = [(self.root, 0)]
        i, n = 0, len(token)
        while i < n and live:
            c = token[i]
            run = 1
            while i + run < n and token[i + run] == c:
                run += 1
            times = {run} if run < 3 else {1, 2, run}  # a stretched letter stands for one or two
            readings = {c, *self.signs.get(c, "")}
            following: dict[tuple[int, int], dict] = {}
            for node, masked in live:
                for r in readings:
                    here, k = node, 0
                    while here is not None and k < run:
                        here = here.get(r)
                        k += 1
                        if here is not None and k in times:
                            following[(id(here), masked)] = here
                if c in self.masks and not masked and run == 1:
                    for letter, here in node.items():
                        if letter:
                            following[(id(here), 1)] = here
            live = [(here, masked) for (_, masked), here in following.items()]
            i += run
        ends = sorted((masked, node[""]) for node, masked in live if "" in node)
        return next((w for masked, w in ends if not masked or len(w) >= self.least), "")


class Scope:
    """Negation, denied opinion or report, and naming, read in order.

    A state is (denial, naming, distance from the last noun for words). Denial: 0 none, 1 of what comes
    next, 2 of a whole clause ("nobody thinks that ..."), 3 a bar that becomes 2 at a verb of saying.
    """

    START = (0, False, 9)

    def __init__(self, terms: set[str], noun: str = "<meta>", link: str = "<link>"):
        self.terms, self.noun, self.link = terms, noun, link

    def step(self, state: tuple, symbols: frozenset, pause: str, after: bool) -> tuple[tuple, float]:
        """(next state, factor). ``pause`` is "", "," or ":" after the word; ``after``: named afterwards."""
        denial, naming, far = state
        far = min(far + 1, 9)
        term = bool(symbols & self.terms)
        factor = NAMED if after and term else SAID
        saying = "<attitude>" in symbols or "<attribution>" in symbols
        if saying and denial in (1, 3):
            denial, naming = 2, False
        elif "<attribution>" in symbols and denial != 2:
            denial, naming, far = 0, False, 9
        elif "<but>" in symbols:
            denial, naming = 0, False
        elif self.noun in symbols:
            far, naming = 0, False
        elif self.link in symbols and far <= 3:
            naming = True
        elif naming or (term and far == 1):
            if term:
                factor = min(factor, NAMED)
            naming = term or "<or>" in symbols or ("<degree>" in symbols and "<you>" not in symbols)
        if "<neg>" in symbols:
            denial = max(denial, 1) if denial != 3 else 3
        elif "<bar>" in symbols:
            denial = max(denial, 3) if denial != 1 else 1
        elif denial == 1:
            if term:
                factor = min(factor, DENIED)
            elif "<merely>" in symbols or not symbols & {"<be>", "<degree>", "<or>", "<attitude>", "<modal>"}:
                denial = 0
        elif denial == 2 and term:
            factor = min(factor, DENIED)
        if pause:
            if pause == ":" and far <= 2:
                naming = True
            if far == 0 and pause == ",":
                far = 9
            if not (denial == 1 and term and pause == ","):
                denial = 0
        return (denial, naming, far), factor

    def named_after(self, clause: list[frozenset]) -> list[bool]:
        """The right-to-left half: terms followed by a form of to be (or "as") and, within its noun phrase, a noun for words."""
        out, phrase, ready = [False] * len(clause), False, False
        for i in range(len(clause) - 1, -1, -1):
            s = clause[i]
            out[i] = ready and bool(s & self.terms)
            ready = phrase and bool(s & {"<be>", self.link})
            phrase = self.noun in s or (phrase and "<degree>" in s and not s & self.terms)
        return out


@dataclass
class State:
    """A state of the rules: weighted arcs by symbol and without one, and the rules that end here."""

    arcs: dict[str, list[tuple[int, float]]] = field(default_factory=dict)
    free: list[tuple[int, float]] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)


class Rules:
    """Machines of weighted rules.

    In a rule ``<class>`` reads a word of a class (``<a|b>`` of several; what is no class is a word), ``a|b`` one
    of the words, ``~n`` up to n words of any kind, ``@name`` what one of the rules ``name`` reads; ``x?`` may be missing.
    """

    def __init__(self, called: dict[str, list[tuple[float, str]]], rules: list[tuple[str, float, str]], classes: set[str], plain=lambda w: w):
        self.called, self.classes, self.plain = called, classes, plain
        self.states = [State()]
        self.words: set[str] = set()
        self.tags: list[tuple[str, float]] = []
        for category, weight, pattern in rules:
            self.states[self._chain(0, pattern)].ends.append(len(self.tags))
            self.tags.append((category, weight))
        self._closures: dict[int, list[tuple[int, float]]] = {}

    def _new(self) -> int:
        self.states.append(State())
        return len(self.states) - 1

    def _chain(self, here: int, pattern: str, inside: tuple[str, ...] = ()) -> int:
        for item in pattern.split():
            optional, item = item.endswith("?"), item.rstrip("?")
            if item[0] == "~":
                for _ in range(int(item[1:])):
                    there = self._new()
                    self.states[here].arcs.setdefault(ANY, []).append((there, 1.0))
                    self.states[here].free.append((there, 1.0))
                    here = there
                continue
            there = self._new()
            if item[0] == "@":
                name = item[1:]
                if name in inside:
                    raise ValueError(f"rule {name} calls itself")
                for weight, alternative in self.called[name]:
                    first = self._new()
                    self.states[here].free.append((first, weight))
                    self.states[self._chain(first, alternative, (*inside, name))].free.append((there, 1.0))
            else:
                listed = item[1:-1].split("|") if item[0] == "<" else item.split("|")
                names = [f"<{x}>" if item[0] == "<" and x in self.classes else self.plain(x) for x in listed]
                for symbol in names:
                    self.states[here].arcs.setdefault(symbol, []).append((there, 1.0))
                    if symbol[0] != "<":
                        self.words.add(symbol)
            if optional:
                self.states[here].free.append((there, 1.0))
            here = there
        return here

    def closed(self, state: int) -> list[tuple[int, float]]:
        known = self._closures.get(state)
        if known is None:
            best, stack = {state: 1.0}, [state]
            while stack:
                s = stack.pop()
                for t, w in self.states[s].free:
                    if best[s] * w > best.get(t, 0.0):
                        best[t] = best[s] * w
                        stack.append(t)
            # Only states that read or end something are kept.
            known = self._closures[state] = [(s, w) for s, w in best.items() if self.states[s].arcs or self.states[s].ends]
        return known

    def reads_all(self, light: set[str]) -> list[int]:
        """The rules that can be read through with symbols of ``light`` and skipped words only."""
        seen, stack = {0}, [0]
        while stack:
            s = self.states[stack.pop()]
            for t, _ in s.free + [x for symbol, to in s.arcs.items() if symbol == ANY or symbol in light for x in to]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return sorted({r for s in seen for r in self.states[s].ends})


class Composition:
    """Scope o Rules, made deterministic as far as texts need it."""

    LIMIT = 2_000_000  # transitions remembered by a process; beyond it they are worked out anew

    def __init__(self, scope: Scope, rules: Rules):
        self.scope, self.rules = scope, rules
        self.words: list[tuple] = []
        self.number_of: dict[tuple, int] = {}
        # What the first states of all rules read, by symbol: a match may begin at any word.
        self.begin: dict[str, list[tuple[int, float]]] = {}
        for s, w in rules.closed(0):
            for symbol, to in rules.states[s].arcs.items():
                self.begin.setdefault(symbol, []).extend((t, w * more) for t, more in to)
        self._reset()

    def word(self, symbols: frozenset, pause: str = "", after: bool = False) -> int:
        """The number of a word: its classes and form, the pause behind it, whether it is named afterwards."""
        key = (symbols, pause, after)
        if key not in self.number_of:
            self.number_of[key] = len(self.words)
            self.words.append(key)
        return self.number_of[key]

    def _reset(self) -> None:
        start = (Scope.START, frozenset())
        self.number = {start: 0}
        self.keys = [start]
        self.moves: dict[tuple[int, int], tuple[int, tuple]] = {}

    def _move(self, at: int, word: int) -> tuple[int, tuple]:
        """(next state, rules that end here with what is kept of their weight)."""
        scope_state, live = self.keys[at]
        symbols, pause, after = self.words[word]
        following, factor = self.scope.step(scope_state, symbols, pause, after)
        states = self.rules.states
        # A skipped word says nothing, so only words that are read by class or form are scaled.
        scale = {s: factor if symbols & self.scope.terms else SAID for s in symbols} | {ANY: SAID}
        best: dict[int, float] = {}
        for symbol, kept in scale.items():
            for t, w in self.begin.get(symbol, ()):
                best[t] = max(best.get(t, 0.0), w * kept)
        for s, w in live:
            arcs = states[s].arcs
            for symbol in scale.keys() & arcs.keys():
                for t, more in arcs[symbol]:
                    best[t] = max(best.get(t, 0.0), w * more * scale[symbol])
        closed: dict[int, float] = {}
        for t, w in best.items():
            for s, more in self.rules.closed(t):
                closed[s] = max(closed.get(s, 0.0), w * more)
        fired: dict[int, float] = {}
        for s, w in closed.items():
            for rule in states[s].ends:
                fired[rule] = max(fired.get(rule, 0.0), w)
        key = (following, frozenset((s, w) for s, w in closed.items() if states[s].arcs))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
        out = self.moves[(at, word)] = (to, tuple(fired.items()))
        return out

    def run(self, clause: list[int]) -> dict[int, float]:
        """Rules that match in the clause, each with the best of what is kept of its weight."""
        if len(self.moves) > self.LIMIT:
            self._reset()
        at, found, moves = 0, {}, self.moves
        for word in clause:
            step = moves.get((at, word)) or self._move(at, word)
            at = step[0]
            for rule, kept in step[1]:
                if kept > found.get(rule, 0.0):
                    found[rule] = kept
        return found
