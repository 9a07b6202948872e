"""Secret scans: fixed patterns and probabilistic automata learned from labelled credentials.

Grammar inference: labelled credentials of a kind become a prefix tree with counts.  States whose futures
are statistically compatible (Hoeffding bounds on the frequencies of ending and of each next symbol, and
so on below them) are merged, red and blue, into a probabilistic automaton (the ALERGIA method).  A
candidate is a run of credential characters.  Its score is its mean log likelihood by character under the
best automaton, against a bigram model of ordinary strings; the threshold is set on held-out strings so that
no ordinary one passes.

Characters are read as classes (capital, small, digit, the sign itself); the first ``LITERAL`` positions
keep the character where a format fixes it there.  Labelled strings are drawn with a fixed seed from
published credential formats, ``LABELLED`` of each kind; the corpus has no credential labels.

A run that is no credential as a whole, or that base patterns have parts of, is searched for credentials inside:
a sub-candidate starts where a free piece does or after one of ``SEPARATORS`` (never with one) and ends before one or with the
piece.  Of all sets of accepted ones that don't overlap, the one with the largest sum of log ratios above the
threshold is taken, in one pass over the piece.

Base patterns: assignments, access keys and long hexadecimal runs, as leftmost matches.  What the
automata accept is added as kind ``format`` where no base match overlaps it.

No labelled format is shorter than ``LEAST_FORMAT`` characters, so nothing shorter is a candidate.

Defined results: a null text counts as empty and has no spans; a very long text is scanned whole, a long run in
time in proportion to its length; spans are in code points; repeated rows are scanned each; an empty table
gives an empty result; further columns, whatever their names, are ignored by ``scan`` and kept by ``mask_secrets``.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string
from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: Fixed patterns and lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "format")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEAST_FORMAT = 20
#: What may set a credential off within a run, and what is trimmed from the ends of one.
SEPARATORS, TRIMMED = "=/.", ".=-_+/"
#: The most parts that separators make of a credential.
PARTS = 3

LABELLED, LITERAL, CONFIDENCE = 400, 5, 0.01
SEED = 7

_ALNUM, _URL = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_"


def _drawn(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choices(letters, k=n))


#: Published credential formats.
FORMATS: dict[str, Callable[[random.Random], str]] = {
    "github": lambda r: r.choice(("ghp_", "gho_", "ghs_")) + _drawn(r, _ALNUM, 36),
    "slack": lambda r: f"xoxb-{_drawn(r, string.digits, 12)}-{_drawn(r, string.digits, 12)}-{_drawn(r, _ALNUM, 24)}",
    "google": lambda r: "AIza" + _drawn(r, _URL, 35),
    "stripe": lambda r: r.choice(("sk_live_", "rk_live_")) + _drawn(r, _ALNUM, 24),
    "gitlab": lambda r: "glpat-" + _drawn(r, _URL, 20),
    "npm": lambda r: "npm_" + _drawn(r, _ALNUM, 36),
    "jwt": lambda r: f"eyJ{_drawn(r, _URL, r.randint(20, 40))}.eyJ{_drawn(r, _URL, r.randint(40, 120))}.{_drawn(r, _URL, 43)}",
    "access_secret": lambda r: _drawn(r, _ALNUM + "+/", 40),
}


def ordinary(rng: random.Random) -> str:
    """A string of credential characters that is none: words, paths, addresses, numbers, dates, versions."""
    syllables = ("an", "ber", "con", "der", "eau", "for", "ing", "ment", "on", "pre", "que", "re", "sch", "th", "tion", "ung", "ver", "wh", "os", "ado")
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 6)))
    number = lambda n: _drawn(rng, string.digits, n)
    shape = rng.randrange(10)
    if shape == 0:
        return "".join(w.capitalize() for w in (word() for _ in range(rng.randint(3, 6))))
    if shape == 1:
        return "/".join(word() for _ in range(rng.randint(3, 7)))
    if shape == 2:
        return f"www.{word()}.{word()}.com/{word()}/{number(4)}/{number(2)}/{word()}.html"
    if shape == 3:
        return "_".join(word() for _ in range(rng.randint(3, 6))) + number(rng.randint(0, 3))
    if shape == 4:
        return f"{number(4)}-{number(2)}-{number(2)}T{number(2)}.{number(2)}.{number(2)}-{number(5)}"
    if shape == 5:
        return number(rng.randint(16, 40))
    if shape == 6:
        return "-".join(w for w in (word() for _ in range(rng.randint(3, 8))))
    if shape == 7:
        return rng.choice("=-_.+") * rng.randint(16, 60)
    if shape == 8:
        return ".".join(word().capitalize() for _ in range(rng.randint(2, 5))) + f"-{number(1)}.{number(2)}.{number(1)}"
    return "".join(rng.choices(syllables, k=rng.randint(6, 14)))


def _class(c: str) -> str:
    return "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c


def symbols(text: str, fixed: dict[int, set[str]] | None = None) -> list[str]:
    """The classes of a string's characters; a character that ``fixed`` has for its position stays itself ('=x')."""
    out = [_class(c) for c in text]
    for i, letters in (fixed or {}).items():
        if i < len(text) and text[i] in letters:
            out[i] = "=" + text[i]
    return out


class Automaton:
    """A probabilistic automaton learned by merging the states of a prefix tree."""

    def __init__(self, samples: list[str], confidence: float = CONFIDENCE):
        self.fixed = {}
        for i in range(LITERAL):
            seen = {s[i] for s in samples if i < len(s)}
            if 0 < len(seen) <= 4:
                self.fixed[i] = seen
        self.confidence = confidence
        self.count, self.ends, self.next = defaultdict(int), defaultdict(int), defaultdict(dict)
        size = 1
        for s in samples:
            at = 0
            self.count[0] += 1
            for a in symbols(s, self.fixed):
                if a not in self.next[at]:
                    self.next[at][a] = size
                    size += 1
                at = self.next[at][a]
                self.count[at] += 1
            self.ends[at] += 1
        self.arrivals = defaultdict(lambda: defaultdict(int))
        for state in range(size):
            for a, to in self.next[state].items():
                self.arrivals[state][a] = self.count[to]
        self._merge_states()
        self._finish()

    def _differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / self.confidence)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, p: int, q: int) -> bool:
        todo, seen = [(p, q)], set()
        while todo:
            p, q = todo.pop()
            if p == q or (p, q) in seen:
                continue
            seen.add((p, q))
            if self._differ(self.count[p], self.ends[p], self.count[q], self.ends[q]):
                return False
            for a in {*self.next[p], *self.next[q]}:
                if self._differ(self.count[p], self.arrivals[p][a], self.count[q], self.arrivals[q][a]):
                    return False
                if a in self.next[p] and a in self.next[q]:
                    todo.append((self.next[p][a], self.next[q][a]))
        return True

    def _fold(self, p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            self.count[p] += self.count[q]
            self.ends[p] += self.ends[q]
            for a, to in self.next[q].items():
                self.arrivals[p][a] += self.arrivals[q][a]
                if a in self.next[p]:
                    todo.append((self.next[p][a], to))
                else:
                    self.next[p][a] = to

    def _merge_states(self) -> None:
        red, parent = [0], {}
        while True:
            blue = [(self.arrivals[p][a], p, a) for p in red for a, to in self.next[p].items() if to not in red]
            if not blue:
                break
            _, p, a = max(blue, key=lambda x: (x[0], -x[1], x[2]))
            q = self.next[p][a]
            for r in red:
                if self._compatible(r, q):
                    self.next[p][a] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
        self.states = red

    def _finish(self) -> None:
        """Log probabilities, a little mass kept for what was not seen; the counts of the prefix tree go, as workers outlive a stage."""
        self.log = {}
        for s in self.states:
            total = self.count[s] + 1.0
            for a, n in self.arrivals[s].items():
                if a in self.next[s]:
                    self.log[s, a] = (math.log(n / total), self.next[s][a])
            self.log[s, ""] = (math.log(max(self.ends[s], 1e-3) / total), s)
        del self.count, self.ends, self.next, self.arrivals

    def likelihood(self, text: str) -> float:
        """Log likelihood; minus infinity where the automaton has no way."""
        at, out = 0, 0.0
        for a in symbols(text, self.fixed):
            step = self.log.get((at, a))
            if step is None:
                return -math.inf
            out += step[0]
            at = step[1]
        return out + self.log[at, ""][0]


class Background:
    """A bigram model of the classes of ordinary strings."""

    def __init__(self, samples: list[str]):
        pairs, ones = defaultdict(int), defaultdict(int)
        for s in samples:
            for a, b in zip(["", *map(_class, s)], [*map(_class, s), ""]):
                pairs[a, b] += 1
                ones[a] += 1
        self.pairs, self.ones = pairs, ones

    def step(self, before: str, c: str) -> float:
        """Log likelihood of the class c after another; "" is the start or the end."""
        return math.log((self.pairs.get((before, c), 0) + 0.5) / (self.ones.get(before, 0) + 35.0))

    def likelihood(self, text: str) -> float:
        out, before = 0.0, ""
        for c in [*map(_class, text), ""]:
            out += self.step(before, c)
            before = c
        return out


class Grammar:
    """Automata of all formats, the background, and the threshold from held-out strings."""

    def __init__(self, seed: int = SEED, labelled: int = LABELLED):
        rng = random.Random(seed)
        self.automata = {kind: Automaton([make(rng) for _ in range(labelled)]) for kind, make in FORMATS.items()}
        self.background = Background([ordinary(rng) for _ in range(10 * labelled)])
        held = [self.score(x) for x in (ordinary(rng) for _ in range(10 * labelled)) if len(x) >= LEAST_FORMAT]
        self.threshold = max(0.25, max(held) + 0.05)

    def score(self, text: str) -> float:
        """Mean log ratio by character of the best format to ordinary strings."""
        best = max(a.likelihood(text) for a in self.automata.values())
        return (best - self.background.likelihood(text)) / (len(text) + 1) if best > -math.inf else -math.inf

    def accepts(self, text: str) -> bool:
        return len(text) >= LEAST_FORMAT and self.score(text) > self.threshold

    def inside(self, text: str) -> list[tuple[int, int]]:
        """The best set, with up to ``PARTS`` neighbours as one where an accepted sub-candidate spans them."""
        found, out, i = self.best_set(text), [], 0
        while i < len(found):
            last = next((j for j in range(min(i + PARTS, len(found)) - 1, i, -1) if self.accepts(text[found[i][0] : found[j][1]])), i)
            out.append((found[i][0], found[last][1]))
            i = last + 1
        return out

    def best_set(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the accepted sub-candidates, none overlapping, with the largest sum of (score - threshold) * (length + 1).

        A walk is an automaton's way from a start; of walks that have the same future only the best goes on.
        """
        n = len(text)
        if n < LEAST_FORMAT:
            return []
        first = n - len(text.lstrip(TRIMMED))
        automata, classes = list(self.automata.values()), [_class(c) for c in text]
        best, taken = [0.0] * (n + 1), [-1] * (n + 1)
        walks: dict[tuple[int, int, int], tuple[float, int]] = {}  # (automaton, state, length): (-sum, start)
        for i in range(n + 1):
            if i:
                best[i] = best[i - 1]
                if walks and (i == n or text[i] in SEPARATORS):
                    end = self.background.step(classes[i - 1], "") + self.threshold
                    for (k, state, length), (cost, start) in walks.items():
                        if length == LEAST_FORMAT and (total := automata[k].log[state, ""][0] - end - cost) > best[i]:
                            best[i], taken[i] = total, start
            if i == n:
                break
            if text[i] not in SEPARATORS and (i in (0, first) or text[i - 1] in SEPARATORS):
                walks |= {(k, 0, 0): (-best[i], i) for k in range(len(automata))}
            c, now = classes[i], {}
            for (k, state, length), (cost, start) in walks.items():
                own = automata[k]
                letter = "=" + text[i] if length < LITERAL and text[i] in own.fixed.get(length, ()) else c
                step = own.log.get((state, letter))
                if step is not None:
                    cost += self.background.step(classes[i - 1] if length else "", c) + self.threshold - step[0]
                    key = (k, step[1], min(length + 1, LEAST_FORMAT))
                    now[key] = min(now.get(key, (math.inf, 0)), (cost, start))
            walks = now
        out, i = [], n
        while i:
            if taken[i] >= 0:
                out.append((taken[i], i))
                i = taken[i]
            else:
                i -= 1
        return out[::-1]


@functools.lru_cache(maxsize=1)
def grammar() -> Grammar:
    """A worker's grammar; the seed makes it the same everywhere."""
    return Grammar()


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; kind counts in KINDS."""
    if runs is None:
        runs = [m.span() for m in CANDIDATE.finditer(text)]
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    for a, b in runs:  # any match long enough lies within one run
        if b - a >= LEAST_ACCESS and text.find("AKIA", a, b) >= 0:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= LEAST_ACCESS]
        if b - a >= LEAST_HEX:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, sorted by start, then kind."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    base = base_spans(text, runs)
    added = []
    for a, b in runs:
        over = [(s, e) for s, _, e in base if s < b and a < e]
        end = a + len(text[a:b].rstrip(TRIMMED))
        if not over and end - a >= LEAST_FORMAT and grammar().accepts(text[a:end]):
            added.append((a, 3, end))
            continue
        for s, e in [*over, (b, b)]:  # the pieces that base spans leave free
            piece = text[a:s].rstrip(TRIMMED) if s - a >= LEAST_FORMAT else ""
            if len(piece) >= LEAST_FORMAT:
                added += [(a + i, 3, a + j) for i, j in grammar().inside(piece)]
            a = max(a, e)
    return base, sorted(base + added) if added else base


def _named(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, names = ([], [], []), [], []
        for text in batch.column(1).to_pylist():
            base, found = spans(text or "")
            for kind, column in enumerate(counts):
                column.append(sum(k == kind for _, k, _ in base))
            digests.append(hashlib.sha256(_named(base).encode()).hexdigest())
            names.append(_named(found))
        columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(names, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_slices(chosen, work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, mask: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans by one mask."""
    out, at = [], 0
    for s, _, e in spans(text)[1]:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(docs: DataFrame, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets masked in its text (null stays null), other columns as they are."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_column)
        texts = [None if t is None else masked(t, mask) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_slices(docs, work, docs.schema)
