"""Toxicity: disguised words are decoded under a character model, then the restored text is scored."""

from __future__ import annotations

import functools
import gc
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.rows import packed, unpacked
from passagemill.session import cut_lineage

SYMBOLS = 64
SAMPLE = 12_000
MAX_FEATURES = 20_000
CACHE = 200_000
#: Tokens that add nothing are kept by name alone, so more of them.
DULL = 300_000
#: The caches are many small tuples without cycles; looking through them for cycles is a tenth of the work.
COLLECT = (200_000, 50, 50)
#: Words of so many letters are taken for text without spaces.
LONG = 64

# Letters that signs commonly stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
# Marks that set words or letters apart, and those among them that never stand for a letter.
MARKS = ".,;:?\"'()[]{}<>«»„“”‘’…¿!_-–—*~/\\|+&=#%^`·、。，"
EDGE = "".join(ch for ch in MARKS if ch not in LEET)
_SIGN = re.compile("[" + re.escape("".join(LEET)) + "]")
_APART = re.compile(f"[{re.escape(MARKS)}]|\\s")
_PLAIN = re.compile(r"(?:([^\W\d_])(?!\1)){1,8}")
_START = re.compile(rf"({_PLAIN.pattern.replace('1', '2', 1)})[^{re.escape(MARKS)}\s]*[{re.escape(EDGE)}]*\Z")
_PARTED = re.compile(rf"([^\W\d_]{{2}})([{re.escape(EDGE)}\s]+)([^\W\d_]{{2,}})")
_CHOICE = re.compile(f"{_SIGN.pattern}|[{re.escape(MARKS)}]|(.)\\1", re.S)


@functools.lru_cache(maxsize=65_536)
def symbol(ch: str) -> int:
    """One of 64 classes: 0 edge or space, 1-26 a-z, 27 digits, 28 signs, the others shared by further letters."""
    code = ord(ch)
    if 97 <= code <= 122:
        return code - 96
    if ch.isspace():
        return 0
    if 48 <= code <= 57:
        return 27
    return 29 + code % 35 if code > 127 and ch.isalpha() else 28


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    return np.array([symbol(chr(c).lower()[:1] or " ") for c in range(0x3000)], dtype=np.int64)


def codes(text: str) -> np.ndarray:
    """Trigram numbers of a text with one edge in front and behind; spaces count as edges."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _classes()
    s = table[np.minimum(points, len(table) - 1)]
    beyond = np.flatnonzero(points >= len(table))
    if len(beyond):
        # The same classes as in decoding, also for scripts behind the table.
        found, place = np.unique(points[beyond], return_inverse=True)
        s[beyond] = np.array([symbol(chr(c).lower()[:1]) for c in found.tolist()], dtype=np.int64)[place]
    s = np.concatenate([[0, 0], s, [0]])
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def character_counts(texts: DataFrame) -> DataFrame:
    """``code, n``: how often each of the 64**3 character trigrams occurs in all of ``texts``."""

    def run(batches):
        total, waiting, size = np.zeros(SYMBOLS**3, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch["text"]:
                waiting.append(codes(text))
                size += len(waiting[-1])
                if size > 2_000_000:
                    total += np.bincount(np.concatenate(waiting), minlength=len(total))
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    return texts.select("text").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class CharacterModel:
    """Log probabilities of a character class after two others: 64**3 numbers at most, whatever the corpus."""

    logp: np.ndarray
    cache: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray, smoothing: float = 0.5) -> CharacterModel:
        table = np.zeros(SYMBOLS**3)
        table[codes] = counts
        table = table.reshape(SYMBOLS * SYMBOLS, SYMBOLS)
        # A token by itself begins like the words behind any border.
        table[0] = table[::SYMBOLS].sum(axis=0)
        single = table.sum(axis=0) + 1.0
        single /= single.sum()
        table = np.log((table + smoothing * SYMBOLS * single) / (table.sum(axis=1, keepdims=True) + smoothing * SYMBOLS))
        return cls(table.astype(np.float32))

    @functools.cached_property
    def listed(self) -> list[float]:
        return self.logp.ravel().tolist()

    @functools.cached_property
    def doubles(self) -> np.ndarray:
        return self.logp.ravel().astype(np.float64)

    def __getstate__(self):
        return {"logp": self.logp, "cache": {}}


@functools.lru_cache(maxsize=65_536)
def separates(ch: str) -> bool:
    return ch in MARKS or ch.isspace()


def omission(ch: str) -> float:
    """What it costs to leave a separator out: words are seldom cut by white space."""
    return 3.0 if ch.isspace() else 1.5


def lattice(token: str, disguised: bool = False) -> list[list[tuple[int, str, float]]]:
    """Edges (end, output, cost) from each position.

    Signs stand for themselves or for letters, runs of a letter for one, two or all, also where
    separators are between them. A separator is a word border (a space for white space, a tab for a mark) or
    nothing. ``disguised`` leaves only the readings of signs as letters and of separators as nothing.
    """
    n = len(token)
    edges: list[list[tuple[int, str, float]]] = [[] for _ in range(n)]
    last, i = "", 0
    while i < n:
        ch, j = token[i], i
        while j < n and token[j] == ch:
            j += 1
        run = j - i
        if separates(ch):
            for at in range(i, j):
                if not disguised or ch not in LEET:
                    edges[at].append((at + 1, "", 0.0 if disguised else omission(ch)))
                if not disguised:
                    edges[at].append((at + 1, " " if ch.isspace() else "\t", 0.0))
        elif not disguised or ch not in LEET:
            edges[i].append((j, ch * run, 0.0))
        letters = [(letter, 1.5) for letter in LEET.get(ch, "")] + [(ch, 0.0)] * ch.isalpha()
        end, dropped = j, 0.0
        if letters and ch != last and j < n and separates(token[j]):
            at, left_out = j, 0.0
            while at < n and (token[at] == ch or separates(token[at])):
                if token[at] == ch:
                    end, dropped = at + 1, left_out
                elif not disguised:
                    left_out += omission(token[at])
                at += 1
        for out, cost in letters:
            if out != ch:
                edges[i].append((j, out * run, cost))
            if run > 2 or run == 2 and not (disguised and out != ch):
                edges[i].append((j, out, cost + 1.0))
            if run > 2:
                edges[i].append((j, out * 2, cost + 1.0))
            if end > j:
                cost += 1.0 + dropped
                edges[i] += [(end, out, cost), (end, out * 2, cost)]
        if not separates(ch) or ch in LEET:
            last = ch
        i = j
    return edges


def decode(token: str, model: CharacterModel, disguised: bool = False) -> str:
    """The Viterbi path of a token's lattice under the character model; states are the last two classes, all of them kept.

    Borders come out as spaces and tabs; one after another counts once.
    """
    edges = lattice(token, disguised)
    # A state is one number: the class before the last times ``SYMBOLS``, plus the last.
    states: list[dict] = [{} for _ in range(len(token) + 1)]
    states[0][0] = (0.0, None, "")
    logp = model.listed
    for i, here in enumerate(edges):
        if not here or not states[i]:
            continue
        steps = [(states[end], out, cost, [symbol(ch) for ch in out]) for end, out, cost in here]
        for state, node in states[i].items():
            before = node[0]
            for reached, out, cost, classes in steps:
                total, at = before + cost, state
                for z in classes:
                    y = at % SYMBOLS
                    if z or y:
                        total -= logp[at * SYMBOLS + z]
                        at = y * SYMBOLS + z
                known = reached.get(at)
                if known is None or total < known[0]:
                    reached[at] = (total, node, out)
    if not states[-1]:
        return token
    ends = ((node[0] - (logp[at * SYMBOLS] if at % SYMBOLS else 0.0), node) for at, node in states[-1].items())
    _, node = min(ends, key=lambda e: e[0])
    parts = []
    while node is not None:
        parts.append(node[2])
        node = node[1]
    return "".join(reversed(parts))


def remembered(model: CharacterModel, key, value):
    if len(model.cache) >= CACHE:
        model.cache.clear()
    model.cache[key] = value
    return value


def readings(token: str, model: CharacterModel) -> tuple[str, tuple[str, ...]]:
    """The most likely reading of a token, and all its words: also those with every sign a letter and no separators.

    Tokens without signs, inner marks or repetitions have a one-path lattice and are returned as they are.
    A sign in front, as in brackets, or a number is mostly no letter: so both readings count.
    """
    known = model.cache.get(token)
    if known is not None:
        return known
    core = token.strip(EDGE)
    if not _CHOICE.search(core):
        return remembered(model, token, (core, (core,) if core else ()))
    best = " ".join(decode(core, model).split())
    words = best.split()
    if _SIGN.search(core) or any(separates(ch) for ch in core):
        words += decode(core, model, disguised=True).split()
    return remembered(model, token, (best, tuple(dict.fromkeys(words))))


def restore(token: str, model: CharacterModel) -> str:
    """The most likely reading of a token, without its outer punctuation."""
    return readings(token, model)[0]


def borders(token: str) -> tuple[str, str] | None:
    """What a token adds to the choice at the space behind and before it; None if no part of it is certain.

    Two different letters that are no part of a run have one reading, so the two classes after them are known
    and the path before them does not change the path behind them.
    """

    def certain(i: int) -> bool:
        a, b = token[i], token[i + 1]
        return a != b and a.isalpha() and b.isalpha() and token[i - 1 : i] != a and token[i + 2 : i + 3] != b

    first = next(filter(certain, range(len(token) - 1)), None)
    if first is None:
        return None
    last = next(filter(certain, range(len(token) - 2, first, -1)), first)
    return token[last:], token[: first + 2]


def letters_from(letters: str, at: int, model: CharacterModel) -> float:
    """Log probability of the best reading of letters behind a state of :func:`decode`, up to the border after them."""
    known = model.cache.get((letters, at))
    if known is not None:
        return known
    states, logp = {at: 0.0}, model.listed
    for ch, run in itertools.groupby(letters):
        z, n = symbol(ch), sum(1 for _ in run)
        reached: dict[int, float] = {}
        for state, total in states.items():
            for times in range(1, n + 1):
                total += logp[state * SYMBOLS + z]
                state = state % SYMBOLS * SYMBOLS + z
                if times < 3 or times == n:
                    reached[state] = max(reached.get(state, -math.inf), total - (times < n))
        states = reached
    return remembered(model, (letters, at), max(total + logp[state * SYMBOLS] for state, total in states.items()))


def crossed(text: str, model: CharacterModel) -> bool:
    """Whether the Viterbi path of a text leaves out a space."""
    parted = _PARTED.fullmatch(text)
    if parted and " " in parted[2] and parted[1][0] != parted[1][1] != parted[3][0]:
        # Two certain letters before the separators and letters alone behind them: the path leaves out all or none.
        a, b = map(symbol, parted[1])
        through = letters_from(parted[3], a * SYMBOLS + b, model) - sum(map(omission, parted[2]))
        return through > model.listed[(a * SYMBOLS + b) * SYMBOLS] + letters_from(parted[3], b * SYMBOLS, model)
    a, b, c, d = text[0], text[1:2], text[-2:-1], text[-1]
    if len(text) > 4 and (a + b + c + d).isalpha() and a != b and b != c and c != d and all(map(separates, text[2:-2])):
        # Two certain letters on both sides: the path has one choice, all separators or none.
        (a, b, c, d), logp = map(symbol, a + b + c + d), model.listed
        through = logp[(a * SYMBOLS + b) * SYMBOLS + c] + logp[(b * SYMBOLS + c) * SYMBOLS + d] - sum(map(omission, text[2:-2]))
        apart = logp[(a * SYMBOLS + b) * SYMBOLS] + logp[b * SYMBOLS * SYMBOLS + c] + logp[c * SYMBOLS + d]
        if not _SIGN.search(text):
            return through > apart
    return decode(text, model).count(" ") < text.count(" ")


def restored_words(text: str, model: CharacterModel) -> set[str]:
    """Distinct words of the restored text; letters and pieces set apart by spaces are read as words too."""
    tokens = text.lower().split()
    words = {word for token in set(tokens) for word in readings(token, model)[1]}
    for stretch in Stretches(tokens, model).all() if tokens else ():
        words.update(decode(stretch, model).split())
    single = [len(token.strip(EDGE)) == 1 for token in tokens]
    for alone, run in itertools.groupby(zip(single, tokens), key=lambda s: s[0]):
        if alone and len(run := [token for _, token in run]) > 2:
            words.add(decode("".join(run), model, disguised=True))
    words.discard("")
    return words


def features(text: str, model: CharacterModel) -> set[str]:
    """Restored words and their beginnings of four and five letters; in ``LONG`` words these count at every place."""
    return _word_features(restored_words(text, model))


def _word_features(words) -> set[str]:
    out = set()
    for word in words:
        out.add(word)
        if len(word) > 4:
            for i in range(len(word) - 3 if len(word) >= LONG else 1):
                out.add("^" + word[i : i + 4])
                out.add("^" + word[i : i + 5])
    return out


def fit_weights(rows: list[tuple[list[int], int]], n_features: int, steps: int = 300, shrink: float = 3e-4) -> np.ndarray:
    """Logistic regression with an intercept (last weight) on sets of features, by Adam on the whole sample."""
    if not rows:
        return np.zeros(n_features + 1)
    at = np.concatenate([np.array(f, dtype=np.int64) for f, _ in rows]) if rows else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    goal = np.array([y for _, y in rows], dtype=float)
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    rate = min(max(goal.mean(), 1e-3), 1 - 1e-3)
    w[-1] = math.log(rate / (1 - rate))
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(owner, weights=w[at], minlength=len(rows))
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal
        slope = np.append(np.bincount(at, weights=miss[owner], minlength=n_features) / len(rows) + shrink * w[:-1], miss.mean())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@functools.lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the table's characters: which are letters, their classes as they stand, and which are marks that are no signs."""
    every = [chr(c) for c in range(len(_classes()))]
    classes = np.array([symbol(ch) for ch in every], dtype=np.int64)
    return np.array([ch.isalpha() for ch in every]), classes, np.array([ch in EDGE for ch in every])


def kept_apart(tokens: list[str], model: CharacterModel) -> tuple[np.ndarray, np.ndarray]:
    """Places before, between and behind the tokens; and for each space between them 1 if the Viterbi path leaves it out, 0 if not, -1 where more than four letters decide.

    The sums are those of :func:`crossed` for two certain letters on both sides of a space, with at most one mark before it,
    and those of the one run that the inner letters make if they are equal.
    """
    points = np.frombuffer(f"    {' '.join(tokens)}   ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.flatnonzero(points == 32)[4:-3]
    letters, classes, edges = _letters()
    beyond = len(letters)
    marked = edges[np.minimum(points[at - 1], beyond - 1)]
    last = at - 1 - marked
    before, a, b, c, d, behind = (points[x] for x in (last - 2, last - 1, last, at + 1, at + 2, at + 3))
    simple = (before != a) & (a != b) & (c != d) & (d != behind)
    for x in (a, b, c, d):
        simple &= (x < beyond) & letters[np.minimum(x, beyond - 1)]
    a, b, c, d = (classes[x[simple]] for x in (a, b, c, d))
    logp = model.doubles
    omitted = np.where(marked[simple], omission(".") + omission(" "), omission(" "))
    through = logp[(a * SYMBOLS + b) * SYMBOLS + c] + logp[(b * SYMBOLS + c) * SYMBOLS + d] - omitted
    apart = logp[(a * SYMBOLS + b) * SYMBOLS] + logp[b * SYMBOLS * SYMBOLS + c] + logp[c * SYMBOLS + d]
    # A letter on both sides may also be one run, which costs 1.
    run = np.where(b == c, logp[(a * SYMBOLS + b) * SYMBOLS + d] - omitted - 1.0, -np.inf)
    out = np.full(len(at), -1, dtype=np.int8)
    out[simple] = np.maximum(through, run) > apart
    return np.concatenate([[3], at, [len(points) - 3]]), out


class Stretches:
    """Stretches of tokens in which the Viterbi path of the whole text leaves out a space.

    A space is decided between the certain letters on both sides of it.
    """

    def __init__(self, tokens: list[str], model: CharacterModel):
        self.tokens, self.model = tokens, model
        self.places, self.apart = kept_apart(tokens, model)
        self.known: dict[int, tuple[int, int, bool]] = {}

    def ends(self, i: int):
        ends = self.model.cache.get((0, self.tokens[i]), 0)
        return remembered(self.model, (0, self.tokens[i]), borders(self.tokens[i])) if ends == 0 else ends

    def segment(self, i: int) -> tuple[int, int, bool]:
        """Around the space behind token ``i``: the certain tokens before and behind it, and whether a space between them is left out."""
        if self.apart[i] >= 0:
            return i, i + 1, bool(self.apart[i])
        if i in self.known:
            return self.known[i]
        tokens, last = self.tokens, len(self.tokens) - 1
        first, behind = i, i + 1
        while first >= 0 and self.ends(first) is None:
            first -= 1
        while behind < last and self.ends(behind) is None:
            behind += 1
        tail = self.ends(first)[0] if first >= 0 else ""
        ends = self.ends(behind)
        key = (tail, *tokens[first + 1 : behind], ends[1] if ends else tokens[behind])
        drops = self.model.cache.get(key)
        if drops is None:
            text = " ".join(key).strip()
            drops = crossed(text, self.model)
            if len(text) < 100:
                remembered(self.model, key, drops)
        found = (max(first, 0), behind, drops)
        for at in range(found[0], behind):
            self.known[at] = found
        return found

    def around(self, i: int) -> tuple[int, int]:
        """First and last token of the stretch that holds token ``i``, the token itself if no space beside it is left out."""
        low = high = i
        while high < len(self.tokens) - 1:
            a, b, drops = self.segment(high)
            if not drops:
                break
            low, high = min(low, a), b
        while low > 0:
            a, b, drops = self.segment(low - 1)
            if not drops:
                break
            low, high = a, max(high, b)
        return low, high

    def all(self) -> Iterator[str]:
        behind = 0
        for i in np.flatnonzero(self.apart).tolist():
            if i >= behind and self.segment(i)[2]:
                low, behind = self.around(i)
                yield " ".join(self.tokens[low : behind + 1])

    def long(self) -> Iterator[int]:
        """A token of each stretch of at least ``LONG`` characters, and of some others."""
        places = self.places
        bounds = np.concatenate([[0], np.flatnonzero(self.apart == 0) + 1, [len(self.tokens)]])
        wide = np.flatnonzero(np.diff(places[bounds]) > LONG)
        todo = [(int(bounds[i]), int(bounds[i + 1]) - 1) for i in wide]
        while todo:
            a, b = todo.pop()
            if a >= b or places[b + 1] - places[a] <= LONG:
                continue
            middle = (a + b) // 2
            low, high, drops = self.segment(middle)
            if drops:
                low, high = self.around(middle)
                yield low
            todo += [(a, low), (high, b)]


@dataclass
class Scorer:
    """A logistic model over the features that have a weight.

    Which of these a text holds is found without decoding all of it: a token whose lattice can neither spell the
    beginning of a weighted feature nor end within one adds nothing, alone or joined with others.
    """

    characters: CharacterModel
    weights: dict[str, float]
    intercept: float
    dull: set = field(default_factory=set, repr=False)
    #: The names that ``dull`` held before it was full last, so that frequent ones are not looked at again at once.
    older: set = field(default_factory=set, repr=False)
    noted: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"characters": self.characters, "weights": self.weights, "intercept": self.intercept, "dull": set(), "older": set(), "noted": {}}

    @functools.cached_property
    def spelled(self) -> tuple[set[str], set[str]]:
        """The weighted words and beginnings, and what these begin with."""
        whole = {f.removeprefix("^") for f in self.weights} | self.weights.keys()
        return whole, {f[:i] for f in whole for i in range(len(f))}

    def walk(self, text: str) -> tuple[bool, set[str]]:
        """Whether any path of a text's lattice spells a weighted feature behind a border; else within which it may end.

        Paths are those of both lattices and some more: edges do not depend on what is before them.
        """
        whole, open_ = self.spelled
        core = text.strip(EDGE)
        if not _APART.search(core):
            # Up to the first choice there is one path.
            choice = _CHOICE.search(core)
            for i in range(1, (choice.start() if choice else len(core)) + 1):
                if core[:i] in whole:
                    return True, set()
                if core[:i] not in open_:
                    return False, set()
            if not choice:
                return False, {core} - {""}
            if core.isalpha():
                begun = {""}
                for ch, run in itertools.groupby(core):
                    begun = self.run(begun, ch, sum(1 for _ in run))
                    if not begun:
                        return begun is None, set()
                return False, begun
        n = len(text)
        todo = [(0, "")] + [(found.end(), "") for found in _APART.finditer(text)]
        seen, pending = set(todo), set()
        while todo:
            i, said = todo.pop()
            if i == n:
                pending.add(said)
                continue
            ch, j = text[i], i
            while j < n and text[j] == ch:
                j += 1
            run, mark = j - i, separates(ch)
            steps = [(i + 1, "")] if mark else [(j, ch * run)]
            letters = LEET.get(ch, "") + (ch if ch.isalpha() else "")
            if letters:
                end, at = j, j
                while at < n and (text[at] == ch or separates(text[at])):
                    if text[at] == ch:
                        end = at + 1
                    at += 1
                for out in letters:
                    steps += [(j, out * run), (j, out)] + [(j, out * 2)] * (run > 2)
                    if end > j:
                        steps += [(end, out), (end, out * 2)]
            for end, out in steps:
                now = said
                for letter in out:
                    now += letter
                    if now in whole:
                        return True, set()
                    if now not in open_:
                        break
                else:
                    if (end, now) not in seen:
                        seen.add((end, now))
                        todo.append((end, now))
        return False, pending - {""}

    def run(self, begun: set[str], ch: str, times: int) -> set[str] | None:
        """What the beginnings become with a run of a letter, read as one, as two or as it is; None if that spells a weighted feature."""
        whole, open_ = self.spelled
        after = set()
        for said in begun:
            for i in range(1, times + 1):
                said += ch
                if said in whole:
                    return None
                if said not in open_:
                    break
                if i < 3 or i == times:
                    after.add(said)
        return after

    def goes_on(self, token: str, pending: set[str], behind: str) -> bool:
        """Whether what a token begins may go on in the one behind it, by the letters that this begins with."""
        begun, i, n = pending, 0, len(behind)
        while i < n:
            ch, j = behind[i], i + 1
            if not ch.isalpha():
                return True
            while j < n and behind[j] == ch:
                j += 1
            after = self.run(begun, ch, j - i)
            if after is None:
                return True
            if i == 0 and ch == token.rstrip(MARKS)[-1:]:
                # A letter that stands on both sides of a space may be one run.
                after |= begun
            if not after:
                return False
            begun, i = after, j
        return True

    def ends_nowhere(self, letters: str) -> bool:
        """Whether a token's first letters, two at least, are neither part of a weighted feature's beginning nor hold one."""
        whole, open_ = self.spelled
        if len(letters) < 2 or letters in open_:
            return False
        for i in range(1, len(letters) + 1):
            begun = letters[:i]
            if begun in whole:
                return False
            if begun not in open_:
                return True
        return False

    def held(self, words) -> list[str]:
        """Those of the words' features that have a weight."""
        return [f for f in _word_features(words) if f in self.weights]

    def forget(self, token: str) -> None:
        if len(self.dull) >= DULL:
            self.dull, self.older = set(), self.dull
        self.dull.add(token)

    def note(self, token: str) -> tuple | None:
        """(features, whether it may spell one, whether it may begin one, whether it is one letter); None without any of these."""
        if len(token) >= LONG:
            spells, pending = True, set()
        else:
            spells, pending = self.walk(token)
        single = len(token.strip(EDGE)) == 1
        if not (spells or pending or single):
            return self.forget(token)
        if len(self.noted) >= CACHE:
            self.noted.clear()
        found = tuple(self.held(readings(token, self.characters)[1])) if spells else ()
        self.noted[token] = value = (found, spells, pending, single)
        return value

    def hits(self, text: str) -> set[str]:
        """The features of a text that have a weight."""
        tokens = text.lower().split()
        if not tokens or not self.weights:
            return set()
        here = {}
        new = set(tokens) - self.dull
        again = new & self.older
        for token in again:
            self.forget(token)
        for token in new - again:
            known = self.noted.get(token)
            if known is None:
                start = _START.match(token)
                # Mostly the first letters begin nothing and no mark begins another word.
                if start and len(token) < LONG and self.ends_nowhere(start[1]):
                    self.forget(token)
                    continue
                known = self.note(token)
            if known:
                here[token] = known
        found = {f for known in here.values() for f in known[0]}
        stretches, behind = Stretches(tokens, self.characters), -1
        asked = set(stretches.long())
        # What a token begins goes on behind it only where the space is left out.
        for i in np.flatnonzero(stretches.apart).tolist() if here else ():
            left, right = here.get(tokens[i]), here.get(tokens[i + 1])
            if right and right[1]:
                asked.add(i + 1)
            if left and (left[1] or left[2] and self.goes_on(tokens[i], left[2], tokens[i + 1]) and stretches.segment(i)[2]):
                asked.add(i)
        for i in sorted(asked):
            if i < behind:
                continue
            low, high = stretches.around(i)
            if high > low:
                behind = high
                stretch = " ".join(tokens[low : high + 1])
                if len(stretch) >= LONG or self.walk(stretch)[0]:
                    found.update(self.held(decode(stretch, self.characters).split()))
        letters = {token for token, known in here.items() if known[3]}
        single = [i for i, token in enumerate(tokens) if token in letters] if letters else []
        for _, run in itertools.groupby(enumerate(single), key=lambda s: s[1] - s[0]):
            run = [tokens[i] for _, i in run]
            if len(run) > 2 and (sum(map(len, run)) >= LONG or any(any(here[token][1:3]) for token in run)):
                found.update(self.held([decode("".join(run), self.characters, disguised=True)]))
        return found

    def score(self, text: str) -> float:
        z = self.intercept + math.fsum(self.weights[f] for f in self.hits(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by five; null ids are."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_features: int = MAX_FEATURES) -> Scorer:
    """Character model of all texts and a classifier of at most ``sample`` labelled rows (those of the smallest hashes).

    Held-out rows give no labels. Features (at most ``max_features``) are those that at least three
    toxic rows hold and that are much more frequent in them; exact copies in the sample count once.
    """
    wide = packed(docs)
    texts = wide.select(F.coalesce(F.col("row.text"), F.lit("")).alias("text"))
    counted = character_counts(texts).toPandas()
    characters = CharacterModel.fit(counted["code"].to_numpy(dtype=np.int64), counted["n"].to_numpy(dtype=np.float64))
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = cut_lineage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def run(batches):
        gc.set_threshold(*COLLECT)
        for batch in batches:
            yield pd.DataFrame(
                {
                    "toxic": batch["toxic"],
                    "digest": batch["digest"],
                    "features": [sorted(features(t, characters)) for t in batch["text"]],
                }
            )

    # The sample has a fixed number of (id, label) rows, so sending it to every task is bounded.
    labelled = wide.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(F.col("row.text"), F.lit("")).alias("text"))
    labelled = labelled.join(F.broadcast(chosen), "doc_id").select("toxic", F.md5("text").alias("digest"), "text")
    rows = labelled.mapInPandas(run, "toxic int, digest string, features array<string>")
    rows = cut_lineage(rows.dropDuplicates(["digest", "toxic"]))
    totals = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    if not toxic or not clean:
        return Scorer(characters, {}, -3.0 if not toxic else 3.0)
    seen = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
    seen = seen.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    lift = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    picked = (
        seen.filter("t >= 3")
        .withColumn("lift", lift)
        .filter("lift >= 3")
        .orderBy((F.col("t") * F.log("lift")).desc(), "feature")
        .limit(max_features)
    )
    names = [r["feature"] for r in picked.select("feature").collect()]
    held = F.array_intersect("features", F.lit(names)) if names else F.array().cast("array<string>")
    place = {name: i for i, name in enumerate(names)}
    sampled = rows.select("toxic", "digest", held.alias("held")).collect()
    sampled.sort(key=lambda r: (r["digest"], r["toxic"]))
    weights = fit_weights([([place[f] for f in r["held"]], r["toxic"]) for r in sampled], len(names))
    return Scorer(characters, dict(zip(names, weights.tolist())), float(weights[-1]))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``toxic_predicted`` (score of at least one half).

    Signs, repetitions and separators (marks and white space) that allow another reading are decoded by
    Viterbi over a character lattice, under trigram counts of the whole corpus; the restored words are
    scored by a logistic model learnt from labelled rows that are not held out. Null and empty texts
    get the score of a text without words. Ids, languages and sources are never looked at. Both passes
    over the texts are narrow; what is sent to the tasks is the trigram table (64**3 numbers at most)
    and the weights (``MAX_FEATURES`` at most). Rows are scored on their own, so repeated rows and ties change
    nothing; long texts are scored whole; an empty table stays empty; of columns named like the results the results stay.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer.value
        gc.set_threshold(*COLLECT)
        for batch in batches:
            yield pd.Series([model.score(text) for text in batch], dtype="float64")

    out = packed(docs).withColumn("score", scored(F.coalesce(F.col("row.text"), F.lit(""))))
    return out.withColumn("toxic_predicted", (F.col("score") >= 0.5).cast("int")).select(
        *unpacked(docs.columns, ["score", "toxic_predicted"])
    )
