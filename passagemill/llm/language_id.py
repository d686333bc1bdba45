"""Language spans of mixed texts: script ranges, per-word scores and a Viterbi path.

A word is a run of letters of one script, of at most 32 letters (longer runs, as unspaced scripts have
them, are several words). Its script says which languages it may belong to: those that write a share of
their training letters in it. Each candidate scores the word by the letter n-grams it holds, words are
strung together by a Viterbi path that pays a penalty for every change of language, and the path's pieces
are the text's spans. A text's language is the one whose spans hold most letters; its score is the share
of these letters, each span weighted by how sure its language is.

Learning counts every n-gram of every training text, in as many numbered cells for every language
(``CELLS`` per n-gram length: n-grams that meet in a cell are counted together, none is left out). So the
model has a fixed size per language (2 MB) whatever the corpus, and is what is sent to the tasks; the number of
languages is the number of distinct ``lang`` values, and more than ``MOST_LANGUAGES`` raise an error.

Results by case. A null text or one without letters gives ``und``, score 0 and no spans; so does every
text when there is nothing to learn from. Letters of scripts that no language was seen in join the words
around them; a text of nothing else gets the language with most training letters, score 0. Equal
numbers of letters go to the smaller name. Rows are labelled on their own, so repeated rows and ties change nothing;
long texts are scored window by window; an empty table stays empty. Of columns named like the results the results stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.rows import packed, unpacked

UNKNOWN = "und"
LENGTHS = (3, 4)
CELLS = 1 << 18
MOST_LANGUAGES = 512
WORD = 32
#: Share of a language's letters in a script that makes it a candidate there.
SCRIPT_SHARE = 0.01
#: Share of the background distribution in every n-gram probability.
BACKGROUND = 0.05
SWITCH = 6.0
WORST = -8.0
#: Letters scored at once, and letters of short texts taken together.
WINDOW = 1 << 20
RESULT = "lang string, score double, spans array<struct<start:int,end:int,lang:string>>"

# Code point ranges of scripts; what lies elsewhere is one more script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x250, 0x36F), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "oriya": ((0xB00, 0xB7F),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "myanmar": ((0x1000, 0x109F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)),
    "ethiopic": ((0x1200, 0x139F),),
    "cherokee": ((0x13A0, 0x13FF), (0xAB70, 0xABBF)),
    "khmer": ((0x1780, 0x17FF),),
    "mongolian": ((0x1800, 0x18AF),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}
N_SCRIPTS = len(SCRIPTS) + 1


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or 0, and the script. Marks belong to words, but are not letters."""
    points = [chr(i) for i in range(0x110000)]
    lower = np.zeros(len(points), dtype=np.uint32)
    for i, c in enumerate(points):
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            small = c.lower()
            lower[i] = ord(small) if len(small) == 1 else i
    script = np.full(len(points), N_SCRIPTS - 1, dtype=np.uint8)
    for number, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            script[first : last + 1] = number
    return lower, script


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def words_of(points: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(letters, starts, lengths, scripts)``: small letters with 0 elsewhere, and the words' places."""
    lower, script_of = characters()
    letters, script = lower[points], script_of[points]
    inside = letters > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (script[1:] != script[:-1])
    at = np.arange(len(points))
    from_start = at - np.maximum.accumulate(np.where(new, at, 0)) if len(points) else at
    new |= inside & (from_start % WORD == 0)
    starts = np.flatnonzero(new)
    gaps = np.append(np.flatnonzero(~inside), len(points))
    lengths = np.minimum(np.append(starts[1:], len(points)), gaps[np.searchsorted(gaps, starts)])[: len(starts)] - starts
    return letters, starts, lengths, script[starts]


def ngram_cells(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(cells, offsets)``: per word and n-gram length one cell for every letter, and where each word's begin.

    A word is read with an edge before and after it; the letter stands second in its n-gram.
    """
    total = int(lengths.sum())
    offsets = np.cumsum(lengths) - lengths
    places = np.arange(total) - np.repeat(offsets - starts, lengths)
    first, last = np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)
    padded = np.append(letters, 0).astype(np.uint64)

    def letter(shift: int) -> np.ndarray:
        at = places + shift
        return np.where((at >= first) & (at < last), padded[np.minimum(at, len(letters))], np.uint64(0))

    read = [letter(shift) for shift in range(-1, max(LENGTHS) - 1)]
    cells = []
    for i, n in enumerate(LENGTHS):
        key = np.full(total, n, dtype=np.uint64)
        for part in read[:n]:
            # Odd multiplier of a 64-bit congruential generator.
            key = key * np.uint64(6364136223846793005) + part + np.uint64(1)
        cells.append((key >> np.uint64(40)).astype(np.int64) % CELLS + i * CELLS)
    return np.stack(cells), offsets


def _windows(points: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """Words of a long text, window by window; a window ends where a word ends."""
    at = 0
    while at < len(points):
        found = words_of(points[at : at + WINDOW + WORD])
        letters, starts, lengths, scripts = found
        if at + len(letters) >= len(points):
            yield at, found
            return
        # A word that touches the window's end is read again in the next one.
        whole = starts + lengths < len(letters)
        yield at, (letters, starts[whole], lengths[whole], scripts[whole])
        at += len(letters) if whole.all() else int(starts[~whole][0])


# --- learning --------------------------------------------------------------------


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells and scripts counted in one task, by language; script counts stand behind the cells."""
    size = len(LENGTHS) * CELLS + N_SCRIPTS
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang", sort=False)["text"]:
            total = sums.setdefault(lang, np.zeros(size, dtype=np.int64))
            for points in _together(texts):
                for _, (letters, starts, lengths, scripts) in _windows(points):
                    cells, _ = ngram_cells(letters, starts, lengths)
                    total[: len(LENGTHS) * CELLS] += np.bincount(cells.ravel(), minlength=len(LENGTHS) * CELLS)
                    total[len(LENGTHS) * CELLS :] += np.bincount(scripts, weights=lengths, minlength=N_SCRIPTS).astype(np.int64)
    for lang, total in sums.items():
        used = np.flatnonzero(total)
        for start in range(0, len(used), 1 << 16):
            cells = used[start : start + (1 << 16)]
            yield pd.DataFrame({"lang": lang, "cell": cells, "n": total[cells]})


def _together(texts) -> Iterator[np.ndarray]:
    """Texts joined by a gap, about a window at a time."""
    held, size = [], 0
    for text in texts:
        held += [code_points(text), np.zeros(1, dtype="<u4")]
        size += len(held[-2]) + 1
        if size >= WINDOW:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


class Model:
    """``languages`` by name, n-gram log probabilities ``cells x languages``, candidates ``scripts x languages``."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """``counts``: rows are languages, columns the cells and then the scripts."""
        self.languages = languages
        split = len(LENGTHS) * CELLS
        scripts = counts[:, split:].astype(np.float64)
        self.most = int(np.argmax(scripts.sum(axis=1))) if languages else 0
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        usual = share >= SCRIPT_SHARE
        seen = scripts > 0
        self.candidates = np.where(usual.any(axis=0), usual, seen).T
        parts = []
        for i in range(len(LENGTHS)):
            part = counts[:, i * CELLS : (i + 1) * CELLS].astype(np.float64)
            everything = part.sum(axis=0)
            background = (everything + 1) / (everything.sum() + CELLS)
            own = part / np.maximum(part.sum(axis=1, keepdims=True), 1)
            parts.append(np.log((1 - BACKGROUND) * own + BACKGROUND * background).T)
        self.weights = np.ascontiguousarray(np.concatenate(parts).astype(np.float32)) / len(LENGTHS)

    def word_scores(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(starts, lengths, scores)``: log posteriors of the languages for each word; 0 for all where none is a candidate."""
        out = []
        for at, (letters, starts, lengths, scripts) in _windows(points):
            if not len(starts):
                continue
            cells, offsets = ngram_cells(letters, starts, lengths)
            scores = sum(np.add.reduceat(self.weights[row], offsets, axis=0) for row in cells).astype(np.float64)
            allowed = self.candidates[scripts]
            scores[~allowed] = -np.inf
            some = allowed.any(axis=1)
            scores[~some] = 0.0
            scores -= scores.max(axis=1, keepdims=True)
            scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
            scores = np.maximum(scores, WORST)
            scores[~some] = 0.0
            out.append((starts + at, lengths, scores))
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, len(self.languages)))
        return tuple(np.concatenate(part) for part in zip(*out))


def learn(docs: DataFrame) -> Model:
    """Counts all n-grams of ``lang, text`` rows without nulls; one small table comes to the driver."""
    counted = docs.select("lang", "text").mapInPandas(_counted, "lang string, cell long, n long")
    found = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(found.column("lang").unique().to_pylist())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages make a model too large to send to tasks")
    number = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), len(LENGTHS) * CELLS + N_SCRIPTS), dtype=np.int64)
    rows = found.column("lang").combine_chunks().dictionary_encode()
    if len(found):
        known = np.array([number[lang] for lang in rows.dictionary.to_pylist()])
        counts[known[rows.indices.to_numpy()], found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return Model(languages, counts)


# --- labelling -------------------------------------------------------------------


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The best language of every word, texts side by side: text t has ``count[t]`` words from ``first[t]`` on.

    Staying in a language is free, any change costs ``SWITCH``; of equal ways staying wins, then the first language.
    """
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), side="left")
    languages = scores.shape[1]
    own = np.arange(languages, dtype=np.uint16)
    back = np.zeros(scores.shape, dtype=np.uint16)
    state = np.zeros((len(first), languages))
    for t in range(longest):
        n = active[t]
        at = first[:n] + t
        if t:
            best = state[:n].argmax(axis=1)
            change = state[np.arange(n), best][:, None] - SWITCH
            moved = change > state[:n]
            back[at] = np.where(moved, best[:, None], own)
            state[:n] = np.maximum(state[:n], change)
        state[:n] += scores[at]
    path = np.zeros(len(scores), dtype=np.int64)
    now = state.argmax(axis=1) if len(first) else np.zeros(0, dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        path[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return path


def label_texts(model: Model, texts: list[str | None]) -> list[tuple]:
    """``(lang, score, spans)`` of each text."""
    out: list[tuple] = [(UNKNOWN, 0.0, [])] * len(texts)
    lower, _ = characters()
    parts, bounds, at = [], [], 0
    for text in texts:
        points = code_points(text or "")
        parts += [points, np.zeros(1, dtype="<u4")]
        bounds.append(at)
        at += len(points) + 1
    if not texts or not model.languages:
        return out
    bounds = np.array(bounds)
    starts, lengths, scores = model.word_scores(np.concatenate(parts))
    if not len(starts):
        return out
    owner = np.searchsorted(bounds, starts, side="right") - 1
    first = np.searchsorted(owner, np.arange(len(texts)))
    count = np.searchsorted(owner, np.arange(len(texts)), side="right") - first
    some = np.flatnonzero(count)
    path = viterbi(scores, first[some], count[some])

    new = np.ones(len(path), dtype=bool)
    new[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(path)) - 1
    total = np.add.reduceat(scores, begin, axis=0)
    lang, text = path[begin], owner[begin]
    sure = np.exp(total[np.arange(len(begin)), lang] - total.max(axis=1)) / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    known = np.abs(total).sum(axis=1) > 0
    weight = np.add.reduceat(lengths, begin) * known
    letters = np.zeros((len(texts), len(model.languages)))
    np.add.at(letters, (text, lang), weight)
    certain = np.zeros_like(letters)
    np.add.at(certain, (text, lang), weight * sure)
    all_letters = letters.sum(axis=1)
    choice = np.where(all_letters > 0, letters.argmax(axis=1), model.most)
    value = certain[np.arange(len(texts)), choice] / np.maximum(all_letters, 1)
    froms, tos = starts[begin] - bounds[text], starts[end] + lengths[end] - bounds[text]
    spans: list[list] = [[] for _ in texts]
    for t, a, b, l in zip(text.tolist(), froms.tolist(), tos.tolist(), lang.tolist()):
        spans[t].append({"start": a, "end": b, "lang": model.languages[l]})
    for t in some:
        # Marks alone are words, but not letters.
        if any(c.isalpha() for c in texts[t]):
            out[t] = (model.languages[choice[t]], float(min(1.0, value[t])), spans[t])
    return out


def identify_languages(docs: DataFrame, learn_from: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_spans`` (code points, end exclusive).

    Learns from rows where ``learn_from`` holds and neither text nor language is null; labels every row by its text alone.
    """
    training = docs.filter(learn_from).select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    model = learn(training)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows, held, size = [], [], 0
            for value in texts:
                held.append(value)
                size += len(value or "")
                if size >= 2 * WINDOW:
                    rows += label_texts(shared.value, held)
                    held, size = [], 0
            rows += label_texts(shared.value, held)
            yield pd.DataFrame(rows, columns=["lang", "score", "spans"])

    found = packed(docs).withColumn("_found", labelled(F.col("row").getField(text)))
    return found.select(
        "row",
        F.col("_found.lang").alias("lang_pred"),
        F.col("_found.score").alias("lang_score"),
        F.col("_found.spans").alias("lang_spans"),
    ).select(*unpacked(docs.columns, ["lang_pred", "lang_score", "lang_spans"]))
