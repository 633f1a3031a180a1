"""Secret scan: rule matches, and strings that automata inferred from them find likely."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structnet.llm.common import map_rows, texts

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_GATE = ("passw", "secret", "token", "api")

#: Labelled credentials of a kind that the automata learn from, at most.
SAMPLE = 500
#: Labelled credentials that are longer teach nothing, which bounds the depth of the trees; they are found all the same.
LONGEST = 256
#: Chance, by Hoeffding's bound, that states that behave alike are kept apart.
ALPHA = 0.05
#: Share of the labelled credentials that may be less likely than the threshold of their kind.
MISSED = 0.02


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the rules, by start and kind. A credential is what follows the assignment, else the match."""
    out = []
    low = text.lower()
    if any(k in low for k in _GATE):
        out += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def symbols(word: str) -> str:
    """Classes of the characters: a hex letter, another small one, a capital, a digit; marks stay."""
    return "".join("h" if c in "abcdef" else "l" if "a" <= c <= "z" else "U" if "A" <= c <= "Z" else "d" if "0" <= c <= "9" else c for c in word)


class Automaton:
    """A deterministic probabilistic automaton, as counts: how often a state was reached, ended, and left by each symbol."""

    def __init__(self, words: list[str]) -> None:
        self.reached, self.ended, self.next, self.taken = [0], [0], [{}], [{}]
        for word in words:
            at = 0
            self.reached[0] += 1
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.reached)
                    self.reached.append(0)
                    self.ended.append(0)
                    self.next.append({})
                    self.taken.append({})
                self.taken[at][c] = self.taken[at].get(c, 0) + 1
                at = self.next[at][c]
                self.reached[at] += 1
            self.ended[at] += 1

    def _differ(self, a: int, na: int, b: int, nb: int) -> bool:
        return abs(a / na - b / nb) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (na**-0.5 + nb**-0.5)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the futures of two states could be the same; b is the root of a tree."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.reached[a], self.reached[b]
            if not na or not nb:
                continue
            if self._differ(self.ended[a], na, self.ended[b], nb):
                return False
            for c in self.taken[a].keys() | self.taken[b].keys():
                if self._differ(self.taken[a].get(c, 0), na, self.taken[b].get(c, 0), nb):
                    return False
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to what starts at a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.reached[a] += self.reached[b]
            self.ended[a] += self.ended[b]
            for c, n in self.taken[b].items():
                self.taken[a][c] = self.taken[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def merged(self) -> Automaton:
        """Merges compatible states: kept states grow from the root, each state next to them joins one or is kept."""
        kept, edge = [0], [(0, c) for c in sorted(self.next[0])]
        while edge:
            edge.sort(key=lambda x: (-self.reached[self.next[x[0]][x[1]]], x))
            at, c = edge.pop(0)
            state = self.next[at][c]
            if state in kept:
                continue
            to = next((k for k in kept if self.compatible(k, state)), None)
            if to is None:
                kept.append(state)
            else:
                self.next[at][c] = to
                self.fold(to, state)
            edge = [(k, x) for k in kept for x in sorted(self.next[k]) if self.next[k][x] not in kept]
        return self._compact()

    def _compact(self) -> Automaton:
        """Only the states that can still be reached."""
        order, new = [0], {0: 0}
        for state in order:
            for _, t in sorted(self.next[state].items()):
                if t not in new:
                    new[t] = len(order)
                    order.append(t)
        self.reached, self.ended, self.taken = ([x[s] for s in order] for x in (self.reached, self.ended, self.taken))
        self.next = [{c: new[t] for c, t in self.next[s].items()} for s in order]
        return self

    def likelihood(self, word: str) -> float:
        """Mean log likelihood of a symbol, the end being one; what was never seen is as likely as half a sighting."""
        at, total = 0, 0.0
        for c in word:
            n = self.taken[at].get(c, 0) if at is not None else 0
            if not n:
                total += math.log(0.5 / (1 + (self.reached[at] if at is not None else self.reached[0])))
                at = None
                continue
            total += math.log(n / self.reached[at])
            at = self.next[at][c]
        end = self.ended[at] if at is not None else 0
        total += math.log(max(end, 0.5) / (1 + (self.reached[at] if at is not None else self.reached[0])))
        return total / (len(word) + 1)


def infer(examples: dict[str, list[str]]) -> dict[str, tuple[Automaton, float]]:
    """An automaton and a threshold for each kind, from labelled credentials."""
    out = {}
    for kind, words in sorted(examples.items()):
        words = [symbols(w) for w in sorted(words)]
        automaton = Automaton(words).merged()
        scores = sorted(automaton.likelihood(w) for w in words)
        out[kind] = automaton, scores[int(len(scores) * MISSED)]
    return out


def labelled(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """Credentials that the rules find: of each kind those with the smallest hashes, ``sample`` at most, so the driver gets a bounded number of them."""

    def found(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in rows:
            yield from {(kind, word) for _, _, kind, word in base_spans(text) if len(word) <= LONGEST}

    words = map_rows(texts(docs), found, ["text"], "kind string, word string", pa.schema([("kind", pa.string()), ("word", pa.string())]))
    out = {}
    low = words.groupBy("kind", F.pmod(F.xxhash64("word"), F.lit(sample)).alias("slot")).agg(F.min_by("word", F.struct(F.xxhash64("word"), "word")).alias("word"))
    for row in low.select("kind", "word").collect():
        out.setdefault(row["kind"], []).append(row["word"])
    return out


def scan(text: str, model: dict[str, tuple[Automaton, float]]) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int, str, float]]]:
    """Rule spans; and (start, end, kind, likelihood) of the other strings that fit the format of a kind.

    Such a string is 16 characters or longer, has a digit, and overlaps no rule span.
    """
    base = base_spans(text)
    more = []
    for m in _WORD.finditer(text) if model else ():
        word = m[0]
        if word.isalpha() or not any("0" <= c <= "9" for c in word) or any(s < m.end() and m.start() < e for s, e, *_ in base):
            continue
        scores = [(a.likelihood(symbols(word)), kind, least) for kind, (a, least) in model.items()]
        fit = max(((s, kind) for s, kind, least in scores if s >= least), default=None)
        if fit:
            more.append((m.start(), m.end(), f"model-{fit[1]}", fit[0]))
    return base, more


def spans_text(spans: list[tuple]) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def find_secrets(docs: DataFrame, sample: int = SAMPLE, model: dict | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_model, base_spans, spans.

    The rules' matches are the labelled credentials; automata are inferred from ``sample`` hash slots of every kind
    (one credential each, the smallest), of all documents; then every candidate of every whole text is scored.
    Spans are ``kind:start:end`` in code points. Null texts count as empty, which have no spans; a null doc_id
    stays null; rows that repeat are scanned each; other columns are ignored; an empty table gives none. Without
    any labelled credential there is no automaton and nothing is added.
    """
    model = infer(labelled(docs, sample)) if model is None else model

    def found(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            base, more = scan(text, model)
            every = sorted([*base, *more], key=lambda x: (x[0], KINDS.index(x[2]) if x[2] in KINDS else len(KINDS), x[2]))
            yield doc_id, *(sum(x[2] == k for x in base) for k in KINDS), len(more), spans_text(base), spans_text(every)

    arrow = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex", "n_model")), ("base_spans", pa.string()), ("spans", pa.string())])
    return map_rows(texts(docs), found, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_spans string, spans string", arrow)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
