"""Substitution ciphers: letter bigrams of a language, and keys learned from unit bigrams by expectation-maximisation."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np

PUNCTUATION = "’‘“”–—…«»"
#: Marks a unit as a plain letter, which isn't part of the cipher.
PLAIN = "\x00"
#: Weight of a starting key, in occurrences of a unit.
PRIOR = 10.0
ROUNDS = 8
#: Log likelihoods of a character that is no letter of the language, and of a mark or space.
OOV, MARK = -11.0, -7.0

_MIXED = re.compile(r"[A-Za-z][^\W\d_A-Za-z]|[^\W\d_A-Za-z][A-Za-z]")

#: A cipher without a known page is only learned from at least so many letters in all, and so many a unit.
LEAST_LETTERS, LEAST_PER_UNIT = 400, 10
#: Starts from frequency ranks and their rounds; the likeliest of them is kept.
STARTS, START_ROUNDS = 24, 40
#: What a letter of a deciphered text may cost (natural log) beyond one of the language's own.
WORSE = 0.7


@dataclass
class Language:
    """Letter bigrams of a language."""

    letters: list[str]
    log: np.ndarray  # log P(next | letter), or one row for all letters; index 0 is the edge of a word
    joint: np.ndarray | None = None
    index: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.index = {c: i + 1 for i, c in enumerate(self.letters)}

    def score(self, text: str) -> float:
        """Log likelihood of text; signs inside are skipped at a price, unknown letters cost more."""
        log, single = self.log, len(self.log) == 1
        total, last, odd = 0.0, 0, False
        for c in text.lower():
            i = self.index.get(c)
            if i is not None:
                total += log[0 if single else last, i]
                last = i
            elif c < "\x80" and not c.isalnum() and c >= " " or c in PUNCTUATION:
                if last:
                    total += log[0 if single else last, 0]
                last = 0
            elif c < "\x80" and c.isalnum():
                total += -4.0 if self.latin else -5.0
                last = 0
            elif c in "·" or c.isspace():
                total += MARK
            else:
                total += OOV
                odd = True
                last = 0
        if last:
            total += log[0 if single else last, 0]
        return total - 2.0 * odd

    def knows(self, text: str) -> bool:
        """Whether text has only letters of the language, plain signs and, in a wide script, its other letters, and no
        word of Latin and other letters."""
        if not self.latin and _MIXED.search(text):
            return False
        return all(c in self.index or "\x20" <= c < "\x7f" or c in PUNCTUATION or self.wide and is_wide(c) for c in text.lower())

    def gains_letters(self, text: str, plain: str) -> bool:
        """Whether plain has letters of the language, and none of text became a sign."""
        if len(text) == len(plain) and any(a in self.index and b not in self.index for a, b in zip(text.lower(), plain.lower())):
            return False
        return self.latin or self.wide or any(c in self.index for c in plain.lower())

    @property
    def wide(self) -> bool:
        return is_wide(self.letters[0])

    @property
    def latin(self) -> bool:
        return "e" in self.index


def is_wide(char: str) -> bool:
    return "㐀" <= char <= "鿿" or "가" <= char <= "힣"


Pairs = list[tuple[str, str, int]]


class _Bigrams:
    """Unit bigrams of a source in matrix form; unit 0 is the edge of a word."""

    def __init__(self, pairs: Pairs):
        self.units = sorted({u for a, b, _ in pairs for u in (a, b)} - {""})
        self.at = {u: i for i, u in enumerate(["", *self.units])}
        self.a, self.b = (np.array([self.at[p[x]] for p in pairs], int) for x in (0, 1))
        self.n = np.array([p[2] for p in pairs], float)
        self.counts = np.zeros((len(self.at),) * 2)
        np.add.at(self.counts, (self.a, self.b), self.n)

    def maximise(self, start: np.ndarray, joint: np.ndarray, rounds: int, prior: float) -> np.ndarray:
        """Expected weight of each (unit, letter) after rounds of EM over P(unit | letter)."""
        place = np.arange(len(self.at))[:, None]
        of_a, of_b = ((place == x[None, :]) * self.n[None, :] for x in (self.a, self.b))
        weight = start
        for _ in range(rounds):
            emit = weight / np.maximum(weight.sum(0, keepdims=True), 1e-12)
            left, right = emit[self.a], emit[self.b]
            expected = np.zeros_like(emit)
            for of, post in ((of_a, left * (right @ joint.T)), (of_b, right * (left @ joint))):
                z = post.sum(1, keepdims=True)
                expected += of @ np.where(z > 0, post / np.maximum(z, 1e-300), 0)
            weight = expected + prior * start
        return weight


def decipher(pairs: Pairs, swap, model: Language, rounds: int = ROUNDS, prior: float = PRIOR) -> dict[str, str]:
    """The key (unit to letter) of a source that a known swap explains, by EM of its unit bigrams against the language's
    letter bigrams. The swap gives the starting key. Units for which it has a letter keep that letter: that the language's
    texts rarely have it (é in English) is no evidence against it. The others get theirs from the bigrams, if they occur
    often enough to outweigh the prior."""
    grams = _Bigrams(pairs)
    if not grams.units:
        return {}
    k = len(model.letters) + 1
    start = np.full((len(grams.at), k), 0.02 / k)
    start[0], start[:, 0], start[0, 0] = 0, 0, 1
    first: dict[str, str | None] = {}
    for u in grams.units:
        if u[0] == PLAIN:
            start[grams.at[u]] = 0
            start[grams.at[u], model.index.get(u[1:], 0)] = 1
            continue
        first[u] = swap.start(u)
        if first[u] and (i := model.index.get(first[u].lower())):
            start[grams.at[u], i] += 1
    key = {u: letter for u, letter in first.items() if letter}
    if len(key) < len(first):
        weight = grams.maximise(start, model.joint, rounds, prior)
        for u in first.keys() - key.keys():
            i = int(weight[grams.at[u]].argmax())
            if i:
                key[u] = model.letters[i - 1]
    return key


def _likelihood(counts: np.ndarray, of: np.ndarray, log: np.ndarray) -> float:
    """Log likelihood of unit bigrams under a key (unit to letter index, -1 for none), units of one letter sharing it."""
    known = of >= 0
    at = np.where(known, of, 0)
    each = np.where(known[None, :], log[at][:, at], OOV)
    single = counts.sum(0)
    by_letter = np.bincount(at, weights=single * known, minlength=len(log))
    share = np.where(known & (single > 0) & (of > 0), np.log(np.maximum(single, 1e-12) / np.maximum(by_letter[at], 1e-12)), 0.0)
    return float((counts * each).sum() + (single * share).sum())


def _climb(counts: np.ndarray, of: np.ndarray, free: list[int], log: np.ndarray) -> tuple[np.ndarray, float]:
    """The last rounds of EM in their hard form: a unit takes the letter, or two exchange theirs, while that is likelier."""
    best = _likelihood(counts, of, log)
    for _ in range(20):
        before = best
        for i, u in enumerate(free):
            for letter in range(1, len(log)):
                if letter != of[u]:
                    holder = [v for v in free if of[v] == letter]
                    for v in [None, *holder]:
                        made = of.copy()
                        made[u] = letter
                        if v is not None:
                            made[v] = of[u]
                        if (score := _likelihood(counts, made, log)) > best + 1e-6:
                            of, best = made, score
                            break
        if best - before < 1e-6:
            break
    return of, best


def decipher_unknown(pairs: Pairs, model: Language, pages: list[dict[str, str]], seed: int = 1) -> dict[str, str] | None:
    """The key of a source that no listed swap explains, None if its text is too little or nothing makes it look like the
    language.

    Starts are frequency ranks, blurred and shaken anew each time, and the keys of other public pages; EM over the unit
    bigrams leads from each to a key, and the likeliest is kept. A page that explains the text about as well is
    preferred: it also knows the rare units. Units that only begin words and share their letter with a more frequent one
    are its capitals.
    """
    grams = _Bigrams(pairs)
    free = [grams.at[u] for u in grams.units if u[0] != PLAIN]
    single = grams.counts.sum(0)
    total = single[free].sum() if free else 0.0
    often = sorted(free, key=lambda i: -single[i])
    need = int(np.searchsorted(np.cumsum(single[often]), 0.95 * total)) + 1 if free else 0
    if total < LEAST_LETTERS or total < LEAST_PER_UNIT * need:
        return None
    log, k, names = model.log, len(model.letters) + 1, ["", *grams.units]
    fixed = np.array([0] + [model.index.get(u[1:], -1) if u[0] == PLAIN else -1 for u in grams.units])
    shares = model.joint.sum(0)
    ranked = np.argsort(-shares[1:]) + 1
    if model.latin:  # what was garbled isn't ASCII
        ranked = np.array([i for i in ranked if not model.letters[i - 1].isascii()], int)
    if not len(ranked):
        return None
    rng = np.random.default_rng(seed)
    found: list[tuple[float, np.ndarray]] = []
    for _ in range(STARTS):
        start = np.zeros((len(names), k))
        start[0, 0] = 1
        for i, u in enumerate(grams.units, 1):
            if u[0] == PLAIN:
                start[i, max(fixed[i], 0)] = 1
        for r, u in enumerate(often):
            distance = (np.arange(len(ranked)) / len(ranked) - r / len(often)) * 6
            start[u, ranked] = np.exp(-(distance**2)) * rng.uniform(0.2, 1.0, len(ranked)) + 1e-3
        weight = grams.maximise(start, model.joint, START_ROUNDS, 0.0)
        of = fixed.copy()
        for u in free:
            of[u] = int(weight[u, 1:].argmax()) + 1
        found.append((_likelihood(grams.counts, of, log), of))
    found.sort(key=lambda x: -x[0])
    score, of = max((_climb(grams.counts, of, often, log)[::-1] for _, of in found[:3]), key=lambda x: x[0])
    key = {}
    for u in free:
        letter = model.letters[of[u] - 1]
        begins = grams.counts[0, u] >= 0.999 * single[u]
        shared = any(v != u and of[v] == of[u] and single[v] > single[u] for v in free)
        key[names[u]] = letter.upper() if begins and shared and len(letter.upper()) == 1 else letter
    # Keys of pages, against the learned one at the price of its letters.
    for page in pages:
        of = fixed.copy()
        for u in free:
            of[u] = model.index.get(page.get(names[u], "").lower(), -1)
        if (made := _likelihood(grams.counts, of, log)) + len(free) * math.log(k) > score:
            score, key = made + len(free) * math.log(k), page
    of = np.array([fixed[i] if i not in set(free) else model.index.get(key.get(u, "").lower(), -1) for i, u in enumerate(names)])
    each = np.where((of >= 0)[None, :], log[np.maximum(of, 0)][:, np.maximum(of, 0)], OOV)
    usual = float((model.joint * log).sum() / model.joint.sum())
    return key if (grams.counts * each).sum() / grams.counts.sum() > usual - WORSE else None
