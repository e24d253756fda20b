"""Scores for abusive, hateful and sexual content by gradient-boosted trees with isotonic calibration.

A document is read in windows of a sentence. Words lose disguises first (look-alike letters, digits for letters, dots
or blanks between letters, repeated letters; asterisks are matched by first letter, last letter and length). Dense
features of the windows, pooled by maximum: densities of the built-in and of learned word lists per category, distance
of listed words to the second person and to words for groups, capitals, punctuation and the rate of disguises. The
learned lists hold weights of word runs, counted in labelled documents; features of a training document always come from
lists counted without it. Scores out of fold are calibrated by isotonic regression.

Labels are read from a bounded sample of documents; the corpus is scored whole. A document is positive for a category
if a label gives it. Defined results: null and empty texts score as documents without a listed word; null categories
are no labels; several labels of a document are united; without any label the built-in lists alone decide.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.boosting import Boosted, calibrated, isotonic
from chatloom.llm.leakage import _FOLD, _PREFIX
from chatloom.storage import restored_key

CATEGORIES = ("abuse", "hate", "sexual")
#: Most labelled documents the model is fitted on, taken in the order of a hash of their id, and the longest of them in
#: characters; together they bound what the driver holds.
LABELLED, LABELLED_CHARS = 6000, 20_000
#: Windows whose features a task remembers, as sentences are repeated.
REMEMBERED = 50_000
FOLDS = 4
THRESHOLD = 0.5
WINDOW, STRIDE = 16, 8
#: Weight of documents of another category as negatives, as their labels may be incomplete.
OTHER_WEIGHT = 0.6

#: Built-in word lists, in the collapsed form of :func:`key_of`.
LISTS = {
    "abuse": "moron idiot imbecile cretin loser scumbag bastard parasite clown worthless useless pathetic filthy stupid disgusting brainless spineless dumb fool trash vollidiot idioten dreckiges maul gueule crétin imbécil asco deficiente schifoso sparisci idiotą idiota zamknij тупой идиот заткнись жалкий aptal salak kapa debiel klootzak rotzak ідіот дурень заткнися choke".split(),
    "hate": "vermin subhuman filth breed breeds disease thieves liars rats infest exterminate deport untermensch parasites savages cockroaches inferior scum".split(),
    "sexual": "nudes naked horny sext sex porn xxx nudity breasts thighs moaning stroking undress uncensored explicit nude erotic orgasm dick pussy cock tits fuck cum blowjob".split(),
}
#: Words for the person spoken to, and words that speak of a group.
YOU = set("you your yours u ya yourself du dich dir dein deine ihr euch tu toi te ton ta vous eres te tú tus usted sei ti tuo você voce jesteś ty cię тебя ты твой ти тебе sen sana je jij jou".split())
GROUP = set("all they them their people folk every kind ones those newcomers".split())

_SPLIT = re.compile(r"(?<=[.?!…])[\"')]*\s+|\n+")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W_][.\-_* ]{1,2}){2,}[^\W_](?![^\W\d_])")
_TOKEN = re.compile(r"[^\W_]+(?:\*+[^\W_]*)?")
_LEET = str.maketrans("013457@$", "oieastas")
_RUN, _THRICE = re.compile(r"(.)\1+"), re.compile(r"(.)\1\1")


@lru_cache(maxsize=1 << 17)
def key_of(word: str) -> str:
    """A word with repeated letters as one."""
    return _RUN.sub(r"\1", word)


class Memo(dict):
    """Results of a function of a word, kept for a bounded number of words."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str):
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = value = self.compute(word)
        return value


def plain_of(token: str) -> str:
    """The word a token stands for; a masked one by first letter, length and last letter."""
    if token.isalpha():
        return key_of(token)
    if token.isdigit():
        return "0"
    if "*" in token:
        return f"*{token[0]}{len(token)}{'' if token.endswith('*') else token[-1]}"
    return key_of(token.translate(_LEET))


def disguised(token: str) -> bool:
    if token.isalpha():
        return len(token) - len(key_of(token)) > 1 and bool(_THRICE.search(token))
    return not token.isdigit()


PLAIN, DISGUISED = Memo(plain_of), Memo(disguised)


class Window:
    """Words of a window with what its disguises and spelling tell."""

    __slots__ = ("clean", "words", "disguises")

    def __init__(self, text: str) -> None:
        self.disguises = 0.0
        if text.isascii():
            self.clean = text
        else:
            folded = unicodedata.normalize("NFKC", text)
            self.clean = folded.translate(_FOLD)
            if len(self.clean) != len(folded):
                self.disguises += 1
            elif self.clean != folded:
                self.disguises += 0.2 * sum(a != b for a, b in zip(folded, self.clean, strict=True))
        low = self.clean.lower()
        if _SPACED.search(low):
            low = _SPACED.sub(self._join, low)
        tokens = _TOKEN.findall(low)
        self.words: list[str] = list(map(PLAIN.__getitem__, tokens))
        self.disguises += sum(map(DISGUISED.__getitem__, tokens))

    def _join(self, m: re.Match) -> str:
        self.disguises += 1
        return re.sub(r"[^\w]|_", "", m.group())

    @property
    def capitals(self) -> float:
        letters = [c for c in self.clean if c.isalpha()]
        return sum(c.isupper() for c in letters) / max(len(letters), 1)

    @property
    def marks(self) -> int:
        return sum(c in "!?" or ord(c) > 0x1F300 for c in self.clean)


def pieces(text: str) -> list[str]:
    """Sentences of the text, long ones in overlapping windows."""
    out = []
    for sentence in _SPLIT.split(_PREFIX.sub("\n", text)):
        if not sentence or sentence.isspace():
            continue
        parts = sentence.split(" ")
        if len(parts) <= WINDOW + STRIDE or (len(parts) <= 3 * WINDOW and sum(len(p) <= 1 for p in parts) > 6):
            out.append(sentence)
        else:
            out += [" ".join(parts[i : i + WINDOW]) for i in range(0, len(parts) - STRIDE, STRIDE)]
    return out


def windows(text: str) -> list[Window]:
    return [Window(piece) for piece in pieces(text)]


def grams(words: list[str]) -> Iterator[str]:
    yield from words
    for a, b in zip(words, words[1:], strict=False):
        yield f"{a} {b}"
    for a, b, c in zip(words, words[1:], words[2:], strict=False):
        yield f"{a} {b} {c}"


class Lexicon:
    """Weights of word runs per category, built-in lists, and masked forms of listed words."""

    def __init__(self, counts: dict[str, Counter], sizes: dict[str, float]) -> None:
        self.lists = {c: {key_of(w) for w in LISTS[c]} for c in CATEGORIES}
        none, n = counts.get("none", Counter()), sizes.get("none", 0)
        others = {c: sum((counts.get(o, Counter()) for o in CATEGORIES if o != c), Counter()) for c in CATEGORIES}
        self.weights: dict[str, tuple[float, ...]] = {}
        found: dict[str, list[float]] = {}
        for i, c in enumerate(CATEGORIES):
            size = sizes.get(c, 0)
            rest = sum(sizes.get(o, 0) for o in CATEGORIES if o != c)
            for g, k in counts.get(c, Counter()).items():
                if k < 2:
                    continue
                here, there = (k + 0.2) / (size + 2), (none[g] + 0.2) / (n + 2)
                beside = (others[c][g] + 0.2) / (rest + 2)
                weight = np.log(here / there)
                if weight > 0.7:
                    # What is more frequent in another category counts for that one.
                    found.setdefault(g, [0.0] * 3)[i] = float(min(weight, 5) * (here / (here + beside)))
        self.weights = {g: tuple(w) for g, w in found.items()}
        self.hot = {g for g, w in self.weights.items() if " " not in g and max(w) > 1.2} | set().union(*self.lists.values())
        self.memo: dict[str, np.ndarray | None] = {}
        self.resolved = Memo(self._resolve)
        self.masked: dict[str, str] = {}
        for w in sorted(self.hot, key=lambda w: max(self.weights.get(w, (0.5,)))):
            for length in (len(w), len(w) + 1, len(w) + 2):
                self.masked[f"*{w[0]}{length}{w[-1]}"] = w
                self.masked.setdefault(f"*{w[0]}{length}", w)

    def read(self, words: list[str]) -> list[str]:
        """Words with masks resolved and an article split off a word whose letters were apart."""
        return list(map(self.resolved.__getitem__, words))

    def _resolve(self, w: str) -> str:
        if w in self.hot:
            return w
        if w[0] == "*":
            return self.masked.get(w, w)
        if len(w) > 4 and w[0] in "ai" and key_of(w[1:]) in self.hot:
            return key_of(w[1:])
        return w

    N_FEATURES = 3 * 7 + 7

    def features(self, found: list[Window]) -> np.ndarray:
        """Pooled features of a document; windows without a listed word leave no trace."""
        best = np.zeros(self.N_FEATURES)
        for window in found:
            row = self.row(window)
            if row is not None:
                np.maximum(best, row, out=best)
        return best

    def read_text(self, text: str) -> np.ndarray:
        """:func:`features` of a text; windows that occur again are read once."""
        best = np.zeros(self.N_FEATURES)
        for piece in pieces(text):
            if piece not in self.memo:
                if len(self.memo) >= REMEMBERED:
                    self.memo.clear()
                self.memo[piece] = self.row(Window(piece))
            row = self.memo[piece]
            if row is not None:
                np.maximum(best, row, out=best)
        return best

    def row(self, window: Window) -> np.ndarray | None:
        """Features of a window, null without a listed word."""
        words = self.read(window.words)
        if self.hot.isdisjoint(words):
            return None
        hot = [i for i, w in enumerate(words) if w in self.hot]
        n = len(words)
        row = np.zeros(self.N_FEATURES)
        weight, strong = [0.0] * 3, [0.0] * 3
        for g in set(grams(words)):
            w = self.weights.get(g)
            if w is not None:
                weight = [a + b for a, b in zip(weight, w, strict=True)]
                if g.count(" ") == 2:
                    strong = [a + b for a, b in zip(strong, w, strict=True)]
        row[0:3], row[3:6], row[6:9] = weight, [x / n for x in weight], strong
        you = [i for i, w in enumerate(words) if w in YOU]
        group = [i for i, w in enumerate(words) if w in GROUP]
        for k, c in enumerate(CATEGORIES):
            listed = [i for i in hot if words[i] in self.lists[c]]
            row[9 + k] = len(listed) / n
            row[12 + k] = max((1 / (1 + min(abs(i - j) for j in you)) for i in listed), default=0) if you else 0
        row[15] = max((1 / (1 + min(abs(i - j) for j in group)) for i in hot), default=0) if group else 0
        row[16], row[17], row[18] = len(you) / n, window.capitals, min(window.marks, 5)
        row[19], row[20], row[21] = min(window.disguises, 6), len(hot) / n, n
        for k in range(3):
            # How far the window speaks for this category rather than another.
            others = [j for j in range(3) if j != k]
            row[22 + k] = max(0.0, row[9 + k] - max(row[9 + j] for j in others))
            row[25 + k] = max(0.0, weight[k] - max(weight[j] for j in others))
        return row


def count_grams(found: list[Window]) -> set[str]:
    return {g for w in found for g in grams(w.words)}


def lexicon_of(docs: list[tuple[set[str], set[str]]]) -> Lexicon:
    """Counts the word runs of labelled documents; a document of one category only counts for it."""
    counts: dict[str, Counter] = {c: Counter() for c in (*CATEGORIES, "none")}
    sizes = dict.fromkeys((*CATEGORIES, "none"), 0.0)
    for runs, labels in docs:
        for c in labels:
            if c in counts:
                counts[c].update(runs)
                sizes[c] += 1
    return Lexicon(counts, sizes)


class Moderator:
    """Lexicon, trees and calibration of all categories."""

    def __init__(self, docs: list[tuple[str, set[str]]]) -> None:
        read = [(windows(text), labels) for text, labels in docs]
        runs = [(count_grams(w), labels) for w, labels in read]
        fold = np.arange(len(read)) % FOLDS
        x = np.zeros((len(read), Lexicon.N_FEATURES))
        for k in range(FOLDS):
            lexicon = lexicon_of([r for r, f in zip(runs, fold, strict=True) if f != k])
            for i in np.flatnonzero(fold == k):
                x[i] = lexicon.features(read[i][0])
        self.lexicon = lexicon_of(runs)
        self.trees: dict[str, Boosted] = {}
        self.curves: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for c in CATEGORIES:
            y = np.array([float(c in labels) for _, labels in docs])
            weight = np.array([1.0 if c in labels or "none" in labels else OTHER_WEIGHT for _, labels in docs])
            if y.sum() < 2 or y.sum() == len(y):
                continue
            out = np.zeros(len(y))
            for k in range(FOLDS):
                test = fold == k
                out[test] = Boosted().fit(x[~test], y[~test], weight[~test]).score(x[test])
            self.curves[c] = isotonic(out, y, weight)
            self.trees[c] = Boosted().fit(x, y, weight)

    def __getstate__(self) -> dict:
        """The model without what is remembered of the training texts."""
        self.lexicon.memo.clear()
        self.lexicon.resolved.clear()
        return self.__dict__

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of each category for each text."""
        x = np.stack([self.lexicon.read_text(t) for t in texts]) if texts else np.zeros((0, Lexicon.N_FEATURES))
        out = np.zeros((len(x), len(CATEGORIES)))
        for k, c in enumerate(CATEGORIES):
            if c in self.trees:
                out[:, k] = calibrated(self.trees[c].score(x), self.curves[c])
            else:
                out[:, k] = np.clip(x[:, 9 + k] * 3, 0, 1)
        return out


def labelled_sample(documents: DataFrame, key: str, text: str, labels: DataFrame, bound: int = LABELLED) -> list[tuple[str, set[str]]]:
    """Texts with their categories in the order of a hash of their id, within the bounds."""
    given = labels.where("category is not null").groupBy("doc_id").agg(F.collect_set("category").alias("_c"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumnRenamed("doc_id", "_id")
    texts = documents.select(F.col(key).alias("_id"), F.col(text).alias("_t")).where(F.length("_t") <= LABELLED_CHARS)
    # Repeated rows of a document count once, so the bound holds for what is collected.
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_t").alias("_t"), F.first("_c").alias("_c"))
    found = rows.select(F.xxhash64("_id").alias("_h"), F.col("_id").cast("string").alias("_id"), "_t", "_c").collect()
    return [(r["_t"], set(r["_c"])) for r in sorted(found, key=lambda r: (r["_h"], r["_id"]))]


def fit(documents: DataFrame, key: str, text: str, labels: DataFrame) -> Moderator:
    """The model of the labelled documents, for any number of calls of :func:`score`."""
    return Moderator(labelled_sample(documents, key, text, labels))


def score(documents: DataFrame, key: str, text: str, labels: DataFrame, keep: tuple[str, ...] = (), model: Moderator | None = None) -> DataFrame:
    """One row per document: key, columns to keep and a probability per category."""
    model = model or fit(documents, key, text, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    types = dict(documents.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moderator = shared.value
        for frame in frames:
            scores = moderator.scores([t if isinstance(t, str) else "" for t in frame["_t"]])
            out = frame.drop(columns="_t")
            for k, c in enumerate(CATEGORIES):
                out[f"p_{c}"] = scores[:, k]
            yield out

    narrow = documents.select(F.col(key).cast("string").alias("_k"), *keep, F.col(text).alias("_t"))
    columns = "".join(f", `{c}` {types[c]}" for c in keep)
    scored = narrow.mapInPandas(run, f"_k string{columns}, " + ", ".join(f"p_{c} double" for c in CATEGORIES))
    return restored_key(scored, key, types[key])


def flagged(scored: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and category at or above the threshold."""
    long = scored.unpivot([key], [f"p_{c}" for c in CATEGORIES], "category", "score")
    return long.where(F.col("score") >= threshold).select(key, F.expr("substring(category, 3)").alias("category"), "score")


def rates(scored: DataFrame, source: str, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, and share above the threshold and mean score per category, of each source."""
    return scored.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_documents"),
        *(F.avg((F.col(f"p_{c}") >= threshold).cast("double")).alias(f"rate_{c}") for c in CATEGORIES),
        *(F.avg(f"p_{c}").alias(f"mean_{c}") for c in CATEGORIES),
    )
