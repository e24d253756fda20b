"""Passages of evaluation items inside training documents, found with an FM-index per shard of documents.

Texts become words: compatibility form, look-alike letters as one, no case, no ignorable characters, punctuation or
line prefixes. Words that no item has cannot match, so a shard indexes the runs of item words of its documents. All
three-word phrases of the items are searched backwards, their occurrences located, and occurrences on one diagonal are
extended over single replaced words; runs on neighbouring diagonals are chained over short insertions. A chain leaks its
item if it covers

- 12 words of the item in a row, three quarters of them right, or
- a whole sentence or the whole item of three words or more, of any length: below six words all right, below nine one
  replaced, else a quarter replaced, which are the replacements that leave three right words in a row to be found.

Names and numbers tell items of one pattern apart: where any word is replaced, more of them have to be right than
replaced, except in items that have none; 12 words without a name count only where the names around them are right. Names are words with a capital inside a sentence of their item. A sentence of
words with capitals alone is a mere mention. Every rule looks at the item and the document alone, so items that have nothing in common with a document never change its verdict;
the one exception is stated: a sentence that at least three different items hold is an instruction and is not searched.

Defined results: null and empty texts match nothing; an item without a sentence of three words matches nothing; repeated
documents give rows each; items with the same text each match. Documents may have any length; items are searched in
blocks of a bounded number of words, each with one scan of the documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.fmindex import FMIndex
from chatloom.llm.lookalikes import IGNORABLE, LOOKALIKES
from chatloom.storage import restored_key

SEED, LEAST_WORDS = 3, 12
LEAST_SHARE = 0.75
#: A sentence is shared if at least this many different items hold it.
SHARED_ITEMS = 3
#: Words of a shard index, and of the items searched at once; the latter bounds what is broadcast.
SHARD_WORDS, BLOCK_WORDS = 400_000, 1_000_000
#: Meetings of a phrase in a document with one in an item that are laid out at once.
MEETINGS = 1_000_000
#: Longest insertion, in words, between two spans that belong together, such as a line prefix.
LONGEST_INSERTION = 8

_FORMAT = "".join(map(chr, [0xAD, 0x61C, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070)]))
_FOLD = {ord(c): None for c in IGNORABLE + _FORMAT} | {ord(c): g[0] for g in LOOKALIKES for c in g[1:]}
_WORD = re.compile(r"[^\W_]+")
_PREFIX = re.compile(r"^(?:\[[^\]\n]*\] [^:\n]{1,60}: |[>\-*•#|]+ ?)", re.M)
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def words(text: str) -> list[str]:
    text = _PREFIX.sub(" ", text)
    return _WORD.findall(unicodedata.normalize("NFKC", text).translate(_FOLD).lower())


def cased(sentence: str) -> list[tuple[str, bool, bool]]:
    """(word, begins with a capital, has a digit) of each of :func:`words`; no capitals where lower case changes lengths."""
    folded = unicodedata.normalize("NFKC", _PREFIX.sub(" ", sentence)).translate(_FOLD)
    lowered = folded.lower()
    upper = folded if len(folded) == len(lowered) else lowered
    return [(m.group(), upper[m.start()].isupper(), any(map(str.isdigit, m.group()))) for m in _WORD.finditer(lowered)]


def replaceable(n: int) -> int:
    """How many words of a sentence of ``n`` may be replaced so that three right words in a row must be left."""
    return 0 if n < 2 * SEED else 1 if n < 3 * SEED else n // 4


class Items:
    """One block of items: vocabulary, coded words, sentences, names and three-word phrases."""

    def __init__(self, rows: list[tuple[object, str]], shared: set[tuple[str, ...]]) -> None:
        self.ids, self.codes, self.sentences, self.telling, least = [], [], [], [], []
        self.vocabulary: dict[str, int] = {}
        phrases, owners, places = [], [], []
        for key, text in rows:
            split = [cased(s) for s in _SENTENCE.split(text)]
            names = {w for s in split for w, capital, _ in s[1:] if capital}
            coded, telling, bounds, every = [], [], [], True
            for sentence in split:
                found = tuple(w for w, _, _ in sentence)
                if not found or found in shared:
                    continue
                start = len(coded)
                mention = all(capital or digit for _, capital, digit in sentence)
                coded += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
                telling += [digit or w in names for w, _, digit in sentence]
                if len(found) >= SEED and not mention:
                    bounds.append((start, len(coded)))
                every &= mention
            if len(coded) >= SEED and not every:
                bounds.append((0, len(coded)))
            number = len(self.ids)
            self.ids.append(key)
            self.codes.append(np.array(coded, np.int64))
            self.telling.append(np.array(telling, bool))
            self.sentences.append(sorted(set(bounds)))
            # A replaced first or last word is not part of a run.
            least.append(min([LEAST_WORDS, *(b - a - min(2, replaceable(b - a)) for a, b in bounds)]))
            for j in range(len(coded) - SEED + 1):
                phrases.append(coded[j : j + SEED])
                owners.append(number)
                places.append(j)
        self.least = np.array(least, np.int64)
        # All items in one row with a margin of no words around each, for comparing many places at once.
        self.base = np.cumsum([0, *(len(c) + LEAST_WORDS for c in self.codes)]) + LEAST_WORDS
        self.row = np.full(int(self.base[-1]) + LEAST_WORDS + SEED, -1, np.int64)
        for at, codes in zip(self.base, self.codes, strict=False):
            self.row[at : at + len(codes)] = codes
        every = np.array(phrases, np.int64).reshape(-1, SEED)
        self.phrases, self.phrase_of = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, np.zeros(0, np.int64))
        order = np.argsort(self.phrase_of, kind="stable")
        self.owners, self.places = np.array(owners, np.int64)[order], np.array(places, np.int64)[order]
        # Phrase and owner as one rising number, so that the uses of a phrase in a range of items lie together.
        self.order = self.phrase_of[order] * len(self.ids) + self.owners


def item_blocks(rows: list[tuple[object, str]]) -> list[Items]:
    """Items in blocks of bounded size, with shared sentences taken over all of them."""
    sentences: Counter = Counter()
    # Counted over different texts, so that a repeated item does not make its own sentences shared.
    for text in {text for _, text in rows}:
        sentences.update({tuple(w for w, _, _ in cased(s)) for s in _SENTENCE.split(text)})
    shared = {s for s, n in sentences.items() if n >= SHARED_ITEMS}
    blocks, part, room = [], [], BLOCK_WORDS
    for row in rows:
        size = len(words(row[1]))
        if part and size > room:
            blocks.append(Items(part, shared))
            part, room = [], BLOCK_WORDS
        part.append(row)
        room -= size
    return [*blocks, Items(part, shared)] if part else blocks


class Shard:
    """Documents coded in the words of a block, searched together."""

    def __init__(self, items: Items) -> None:
        self.items, self.docs, self.keys = items, [], []
        self.pieces: list[np.ndarray] = []
        self.where: list[np.ndarray] = []
        self.size = 0
        self.row: np.ndarray | None = None

    def add(self, key: object, text: str) -> None:
        get = self.items.vocabulary.get
        codes = np.array([get(w, 0) for w in words(text)], np.int64)
        if len(codes) < SEED:
            return
        # Runs of at least SEED item words; shorter ones cannot hold a phrase.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).astype(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long_enough = ends - starts >= SEED
        if not long_enough.any():
            return
        number = len(self.docs)
        self.docs.append(codes)
        self.keys.append(key)
        for a, b in zip(starts[long_enough], ends[long_enough], strict=True):
            self.pieces += [codes[a:b], np.zeros(1, np.int64)]
            self.where.append(np.stack((np.full(b - a + 1, number), np.arange(a, b + 1))))
            self.size += b - a + 1

    def spans(self) -> list[tuple]:
        """(document key, item key, first word, end word, words of the item covered)."""
        if not self.docs or not len(self.items.phrases):
            return []
        index = FMIndex(np.concatenate(self.pieces), len(self.items.vocabulary) + 1)
        where = np.concatenate(self.where, 1)
        lo, hi = index.search(self.items.phrases)
        hit = np.flatnonzero(hi > lo)
        counts = hi[hit] - lo[hit]
        if not len(hit):
            return []
        rows = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        at = index.locate(rows)
        phrase, doc, place = np.repeat(hit, counts), where[0, at], where[1, at]
        order = np.argsort(doc, kind="stable")
        found = []
        for pair in self._meetings(phrase[order], doc[order], place[order], 0, len(self.items.ids)):
            found += self._spans_of(*pair)
        return found

    def _meetings(self, phrase: np.ndarray, doc: np.ndarray, place: np.ndarray, low: int, high: int) -> Iterator[tuple]:
        """Lays out where phrases in documents meet items ``low`` to ``high``; too many at once are halved, by documents
        first and then by items, so that memory does not grow with how many documents and items share a phrase."""
        items = self.items
        width = len(items.ids)
        first = np.searchsorted(items.order, phrase * width + low)
        uses = np.searchsorted(items.order, phrase * width + high) - first
        total = np.cumsum(uses)
        if not len(total) or not total[-1]:
            return
        if total[-1] > MEETINGS and doc[0] != doc[-1]:
            cuts = np.flatnonzero(np.diff(doc)) + 1
            cut = cuts[np.argmin(np.abs(total[cuts - 1] - total[-1] // 2))]
            yield from self._meetings(phrase[:cut], doc[:cut], place[:cut], low, high)
            yield from self._meetings(phrase[cut:], doc[cut:], place[cut:], low, high)
        elif total[-1] > MEETINGS and high - low > 1:
            half = (low + high) // 2
            yield from self._meetings(phrase, doc, place, low, half)
            yield from self._meetings(phrase, doc, place, half, high)
        else:
            at = np.repeat(first - np.concatenate(([0], total[:-1])), uses) + np.arange(total[-1])
            yield from self._diagonals(np.repeat(doc, uses), items.owners[at], np.repeat(place, uses), items.places[at])

    def _diagonals(self, doc: np.ndarray, item: np.ndarray, place: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Documents and items with neighbouring diagonals whose runs may be long enough together.

        The run around each meeting is measured up to LEAST_WORDS words, which is as much as any rule needs.
        """
        diagonal = place - own
        order = np.lexsort((place, diagonal, item, doc))
        doc, item, diagonal, place, own = doc[order], item[order], diagonal[order], place[order], own[order]
        step = lambda x: np.diff(x, prepend=x[:1] - 1)
        pair = (step(doc) != 0) | (step(item) != 0)
        pair[:1] = True
        line = np.flatnonzero(pair | (step(diagonal) != 0))
        # Diagonals that an insertion can join lie close together; such clusters are judged as one.
        cluster = np.cumsum(pair | (step(diagonal) > LONGEST_INSERTION + 1)) - 1
        longest = np.maximum.reduceat(self._lengths(doc, item, place, own), line)
        enough = np.bincount(cluster[line], longest) >= self.items.least[item[np.flatnonzero(np.diff(cluster, prepend=-1))]]
        chosen = line[enough[cluster[line]]]
        cuts = np.flatnonzero(np.diff(cluster[chosen])) + 1
        for part in np.split(chosen, cuts) if len(chosen) else []:
            yield int(doc[part[0]]), int(item[part[0]]), diagonal[part]

    def _lengths(self, doc: np.ndarray, item: np.ndarray, place: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Length of the run around each phrase, single replaced words included, at most LEAST_WORDS words to a side."""
        if self.row is None:
            margin = np.full(LEAST_WORDS + SEED, -2, np.int64)
            self.row = np.concatenate([x for codes in self.docs for x in (margin, codes)] + [margin])
            self.base = np.cumsum([0, *(len(c) + len(margin) for c in self.docs)])[:-1] + len(margin)
        a, b = self.base[doc] + place, self.items.base[item] + own
        length = np.full(len(a), SEED, np.int64)
        for side in (-1, 1):
            at = -1 if side < 0 else SEED
            open_, gap = np.ones(len(a), bool), np.zeros(len(a), bool)
            for k in range(LEAST_WORDS):
                same = self.row[a + at + side * k] == self.items.row[b + at + side * k]
                open_ &= same | ~gap
                # A replaced word counts once the word behind it is right.
                length += open_ & same
                length += open_ & same & gap
                gap = ~same
        return length

    def _spans_of(self, doc: int, item: int, diagonals: np.ndarray) -> Iterator[tuple]:
        codes, own = self.docs[doc], self.items.codes[item]
        runs = []
        for d in diagonals:
            a, b = max(0, -d), min(len(own), len(codes) - d)
            same = own[a:b] == codes[a + d : b + d]
            # A replaced word counts where both its neighbours are right.
            joined = same.copy()
            joined[1:-1] |= same[:-2] & same[2:]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.astype(np.int8), [0]))))
            for s, e in zip(edge[::2], edge[1::2], strict=True):
                if e - s >= SEED:
                    runs.append((int(a + s), int(a + e), int(d), same[s:e]))
        seen = set()
        for chain in chains(runs):
            start, end = chain[0][0], chain[-1][1]
            right = np.zeros(end - start, bool)
            for s, e, _, same in chain:
                right[s - start : e - start] |= same
            where = start + chain[0][2], end + chain[-1][2]
            if (start, end, where) not in seen and self._leaks(item, right, start, end):
                seen.add((start, end, where))
                yield self.keys[doc], self.items.ids[item], *where, end - start

    def _leaks(self, item: int, right: np.ndarray, start: int, end: int) -> bool:
        telling = self.items.telling[item]
        nameless = not telling.any()
        for a, b in self.items.sentences[item]:
            # The first and the last word of a sentence may be replaced as well.
            if start - 1 <= a and b <= end + 1:
                inside = np.zeros(b - a, bool)
                inside[max(0, start - a) : end - a] = right[max(0, a - start) : b - start]
                wrong, named = (~inside).sum(), telling[a:b]
                if wrong <= replaceable(b - a) and told(wrong, (named & inside).sum(), (named & ~inside).sum(), nameless):
                    return True
        if end - start < LEAST_WORDS:
            return False
        named = telling[start:end]
        rows = np.concatenate((np.zeros((3, 1), np.int64), np.cumsum((right, named & right, named & ~right), 1)), 1)
        n_right, n_good, n_bad = rows[:, LEAST_WORDS:] - rows[:, :-LEAST_WORDS]
        # Words around names that are replaced belong to another item of the same pattern.
        wrong = LEAST_WORDS - n_right + (n_good == 0) * (not told(1, rows[1, -1], rows[2, -1], False) and rows[2, -1] > 0)
        return bool(((n_right >= LEAST_SHARE * LEAST_WORDS) & told(wrong, n_good, n_bad, nameless)).any())


def told(wrong, good, bad, nameless: bool):
    """Whether a passage speaks for its item: more names and numbers right than replaced, or no word replaced at all.

    In an item without any name or number (``nameless``) replaced words are judged by their share alone.
    """
    return (good > bad) | (wrong == 0) | nameless


def chains(runs: list[tuple]) -> list[list[tuple]]:
    """Runs (first and end word of the item, diagonal, ...) that follow each other in item and document.

    A run may follow another if at most one word of the item is lost between them and at most LONGEST_INSERTION words of
    the document. Each run is linked to the predecessor with the most right words before it, found by its end and
    diagonal, which only one run can have; so the work grows with the number of runs. Given are all chains that no
    run continues, and each run of theirs by itself.
    """
    if len(runs) == 1:
        return [runs]
    runs = sorted(runs, key=lambda r: r[:3])
    ending: dict[tuple[int, int], int] = {}
    best, before, ended = [0] * len(runs), [-1] * len(runs), [True] * len(runs)
    for i, (s, e, d, same) in enumerate(runs):
        for end in range(s - 1, s + 3):
            # The document position moves by the insertion, and back by what the two runs share.
            nearest = s + d - end + max(0, end - s)
            for at in range(nearest - LONGEST_INSERTION, nearest + 1):
                j = ending.get((end, at)) if at != d else None
                if j is not None and runs[j][0] < s and best[j] > best[i]:
                    best[i], before[i] = best[j], j
        if before[i] >= 0:
            ended[before[i]] = False
        best[i] += int(same.sum())
        ending[e, d] = i
    out = []
    for i in range(len(runs)):
        if ended[i]:
            chain = [i]
            while before[chain[-1]] >= 0:
                chain.append(before[chain[-1]])
            out.append([runs[k] for k in reversed(chain)])
    return out + [[r] for r in runs]


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """One row per leaking span: document, item, first and end word of the span in the document, item words covered.

    The items are held by the driver, as evaluation sets are small; each block of them is broadcast by itself.
    """
    rows = [tuple(r) for r in items.select(F.col(item_key).cast("string").alias("_item"), item_text).where(F.col(item_text).isNotNull()).orderBy("_item").toLocalIterator()]
    kinds = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    names = ["_k", "_item", "first_word", "end_word", "n_words"]
    schema = "_k string, _item string, first_word long, end_word long, n_words long"
    narrow = documents.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_t")).where("_t is not null")
    results = []
    for block in item_blocks(rows):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            shard = Shard(shared.value)
            for frame in frames:
                for k, body in zip(frame["_k"], frame["_t"], strict=True):
                    shard.add(k, body)
                    if shard.size >= SHARD_WORDS:
                        yield pd.DataFrame(shard.spans(), columns=names)
                        shard = Shard(shared.value)
            yield pd.DataFrame(shard.spans(), columns=names)

        results.append(narrow.mapInPandas(run, schema))
    if not results:
        results = [documents.sparkSession.createDataFrame([], schema)]
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other)
    item = F.col("_item").cast(kinds[1]).alias(item_key if item_key != key else f"{item_key}_item")
    return restored_key(out, key, kinds[0]).select(key, item, "first_word", "end_word", "n_words")
