"""Personal data in message bodies: found by a linear-chain conditional random field and replaced by placeholders.

The field is trained on the labelled table in :mod:`chatloom.llm.pii_table` over word-shape features, plus two flags
that tell whether a word occurs as a given or family name in the sender labels of the corpus or in a short built-in list.
The corpus words lie in filters sized from their exact number, so that the flags mean the same at every size. A decoded
span is cut to the characters of its kind and counts if it passes an exact check (an address sign and a domain, 7 to 16
digits in figures or words, a number in the address, two words with capitals in a name, or a known one of two words where
case says nothing).

Defined results: sender labels and time stamps are not searched; a text without such a head is one message; what
stands before the first head is searched too, as message -1, which does not count as a message; null texts stay null and give no rows; empty texts stay empty. Repeated rows are handled one by one, texts of any length whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Container, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm import crf
from chatloom.llm.pii_table import DIGIT_WORDS, FAMILY_NAMES, GIVEN_NAMES, LABELS, labelled_rows
from chatloom.storage import restored_key, written

KINDS = ("email", "phone", "idnum", "address", "name")
#: Tenths of the training names that are taken to be known from sender labels.
KNOWN = 6
#: Bits and hashes for each different name word: one in 400 other words is taken for a name word, at any number of them.
BITS_A_NAME, HASHES, LEAST_BITS, SEGMENT = 16, 4, 1 << 16, 1 << 16
_HEAD = re.compile(r"^\[[^\]\n]*\] ([^:\n]{1,80}): ", re.M)
_SENDER = re.compile(r"([^\W\d_]{2,}) ([^\W\d_]{2,}(?:[-' ][^\W\d_]{2,})*)")
_AT = re.compile(r"[@＠]|\bat\b", re.I)
_GLUED = re.compile(r"[\w.+-]+[@＠][\w-]+(?:\.[\w-]+)+")
_DOT = re.compile(r"\.\w|\bdot\b", re.I)
#: Words of numbers that are read out, and words in small letters inside names.
NUMBER_WORDS = {*DIGIT_WORDS, "zero", "double", "triple", "hundred", "thousand"}
COMMON_GIVEN, COMMON_FAMILY = ({x for n in names for x in (n, n.upper())} for names in (GIVEN_NAMES, FAMILY_NAMES))
SMALL_WORDS = {"de", "van", "der", "den", "von", "zu", "di", "da", "do", "dos", "del", "la", "le", "bin", "ibn", "al", "el", "y", "e", "af", "ten", "ter", "o"}
#: Forms of address, which are no part of the two words a name must have.
TITLES = {"dr", "mr", "mrs", "ms", "prof", "herr", "frau", "mme", "sr", "sra"}


def message_bodies(text: str) -> list[tuple[int, int, int]]:
    """(number, start, end) of the body of each message; a non-blank part before the first head has number -1."""
    heads = list(_HEAD.finditer(text))
    if not heads:
        return [(0, 0, len(text))]
    bodies = [(i, m.end(), n.start() if n else len(text)) for i, (m, n) in enumerate(zip(heads, [*heads[1:], None], strict=True))]
    return [(-1, 0, heads[0].start()), *bodies] if text[: heads[0].start()].strip() else bodies


class NameFilter:
    """A set of words in a bit field that is sized from their number; other words are taken for members at a fixed rate."""

    def __init__(self, size: int, field: np.ndarray | None = None) -> None:
        self.size = max(LEAST_BITS, 1 << (BITS_A_NAME * size - 1).bit_length()) if field is None else len(field) * 8
        self.field = np.zeros(self.size // 8, np.uint8) if field is None else field

    def places(self, word: str) -> list[int]:
        h = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return [(h + i * (h >> 32 | 1)) % self.size for i in range(HASHES)]

    def __contains__(self, word: str) -> bool:
        return all(self.field[p >> 3] >> (p & 7) & 1 for p in self.places(word))


def sender_names(records: DataFrame, text: str) -> tuple[NameFilter, NameFilter]:
    """Given and family names in the sender labels of all rows.

    The different name words are counted exactly, which gives the size of the filter, two bytes a word; its segments are
    filled by the tasks, so the driver receives the bit fields and never the words.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: set[tuple[int, str]] = set()
            for body in frame["_t"]:
                for label in set(_HEAD.findall(body)):
                    m = _SENDER.fullmatch(unicodedata.normalize("NFKC", label))
                    if m and m[1][0].isupper() and m[2][0].isupper():
                        seen.add((0, m[1].lower()))
                        seen.update((1, w.lower()) for w in re.split(r"[-' ]", m[2]))
            yield pd.DataFrame(sorted(seen), columns=["part", "word"])

    texts = records.select(F.col(text).alias("_t")).where("_t is not null")
    words = written(texts.mapInPandas(read, "part int, word string").distinct(), "name-words")
    sizes = {r.part: r.n for r in words.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    filters = [NameFilter(sizes.get(part, 0)) for part in (0, 1)]
    limits = [f.size for f in filters]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sized = [NameFilter(0, np.broadcast_to(np.uint8(0), n // 8)) for n in limits]
        for frame in frames:
            rows = [(part, p // SEGMENT, p % SEGMENT) for part, word in zip(frame["part"], frame["word"], strict=True) for p in sized[part].places(word)]
            yield pd.DataFrame(rows, columns=["part", "segment", "at"])

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SEGMENT, np.uint8)
        bits[frame["at"].to_numpy()] = 1
        return pd.DataFrame({"part": frame["part"].iloc[:1], "segment": frame["segment"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    # A segment has a fixed number of places, so a group is as small however many words there are.
    placed = words.mapInPandas(place, "part int, segment long, at long").distinct()
    for r in placed.groupBy("part", "segment").applyInPandas(fill, "part int, segment long, bits binary").collect():
        start = r.segment * SEGMENT // 8
        filters[r.part].field[start : start + SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)
    return filters[0], filters[1]


def flagger(given: Callable[[str], bool], family: Callable[[str], bool]) -> Callable[[str], str]:
    """Flags of a word: known as a given name, as a family name, or a common one of the built-in lists."""
    return lambda word: ("g" if word in COMMON_GIVEN or given(word) else "") + ("f" if word in COMMON_FAMILY or family(word) else "") if word.isalpha() else ""


def allowed_moves() -> np.ndarray:
    """A continuation follows only the start or continuation of its kind."""
    n = len(LABELS)
    ok = np.ones((n, n), bool)
    for j, label in enumerate(LABELS):
        if label.startswith("I-"):
            ok[:, j] = [x[2:] == label[2:] for x in LABELS]
    return ok


@lru_cache(maxsize=1)
def train() -> crf.Model:
    """The model of the labelled table, fitted once in a process."""
    rows, given, family = labelled_rows()
    code = lambda w: zlib.crc32(w.lower().encode())
    # Part of the training names is left unknown and some other words are taken for names, as the corpus lists are not perfect.
    flags = flagger(lambda w: (w.lower() in given and code(w) % 10 < KNOWN) or code(w) % 61 == 0, lambda w: (w.lower() in family and code(w) % 10 < KNOWN) or code(w) % 67 == 1)
    sentences = []
    for text, spans in rows:
        tokens, tags = crf.tokens_of(text), []
        for start, _, _, _ in tokens:
            kind = next(((s, k) for s, e, k in spans if s <= start < e), None)
            tags.append(LABELS.index(f"{'B' if kind[0] == start else 'I'}-{kind[1]}") if kind else 0)
        sentences.append(([(w, g) for _, _, w, g in tokens], tags))
    return crf.train(sentences, LABELS, allowed_moves(), flags)


def trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The exact bounds of a decoded span.

    Punctuation at the ends is cut off, and words that cannot belong to the kind: those without a capital at the ends of a
    name that has capitals, those without a digit or capital at the ends of a number. Mail addresses grow to all characters
    that are glued to them.
    """
    if kind == "email":
        while a and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] in "_-"):
            b += 1
        glued = _GLUED.search(text, a, b)
        return glued.span() if glued else (a, b)
    while a < b and not text[a].isalnum() and text[a] not in "(+＋（":
        a += 1
    while a < b and not text[b - 1].isalnum() and text[b - 1] not in ").":
        b -= 1
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text[a:b])]
    if kind == "name":
        fits = lambda w: any(c.isupper() for c in w)
    elif kind in ("phone", "idnum") and any(c.isdigit() for c in text[a:b]):
        fits = lambda w: any(c.isdigit() or c.isupper() for c in w)
    else:
        return a, b
    good = [w for w in words if fits(text[a + w[0] : a + w[1]])]
    if not good:
        return a, b
    a, b = a + good[0][0], a + good[-1][1]
    while a < b and text[b - 1] in ".,;:!?":
        b -= 1
    return a, b


def passes(kind: str, text: str, before: str, after: str) -> bool:
    """Exact check of a decoded span; ``before`` and ``after`` are the neighbouring characters."""
    plain = unicodedata.normalize("NFKC", text)
    digits = sum(c.isdigit() for c in plain)
    if kind == "email":
        return bool(_AT.search(plain) and _DOT.search(plain))
    if kind == "phone":
        # Numbers in words count as their digits.
        return 7 <= digits + sum(w in NUMBER_WORDS for w in re.findall(r"[a-z]+", plain.lower())) <= 16
    if kind == "idnum":
        return digits >= 5 and sum(c.isalnum() for c in plain) >= 7
    if kind == "address":
        return digits >= 1 and sum(c.isalpha() for c in plain) >= 4
    words = [w for w in re.findall(r"[^\W\d_]+", plain) if w.lower() not in TITLES]
    return len([w for w in words if len(w) > 1]) >= 2 and not re.search(r"[@_/]", plain) and before not in ("@", "_", "/") and after not in ("@", "_")


class Tagger:
    """Spans of a batch of texts."""

    def __init__(self, model: crf.Model, given: Container[str] = (), family: Container[str] = ()) -> None:
        self.model, self.known = model, {}
        self.flags = flagger(lambda w: w in given, lambda w: w in family)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, str]]]:
        """For each text (message number, start, end, kind), in order."""
        vocabulary = crf.Vocabulary(self.flags, self.known)
        rows = []
        for i, text in enumerate(texts):
            for number, start, end in message_bodies(text):
                ids = vocabulary.ids_of(text[start:end])
                if ids:
                    rows.append((i, number, (start, end), ids))
        found: list[list[tuple[int, int, int, str]]] = [[] for _ in texts]
        tables = vocabulary.tables()
        rows.sort(key=lambda r: len(r[3]))
        at = 0
        while at < len(rows):
            stop = at + 1
            while stop < len(rows) and len(rows[stop][3]) * (stop + 1 - at) <= 60_000:
                stop += 1
            part = rows[at:stop]
            batch = np.zeros((len(part), len(part[-1][3])), np.int32)
            for j, row in enumerate(part):
                batch[j, : len(row[3])] = row[3]
            for row, tags in zip(part, self.model.decode(batch, tables), strict=True):
                self._collect(texts[row[0]], row, tags, found[row[0]])
            at = stop
        for spans in found:
            spans.sort()
        return found

    def _told(self, kind: str, text: str, a: int, b: int) -> bool:
        """Whether a name is told by its case: two words with a capital and nothing between them but particles. Where case
        says nothing, in small letters or in a line of capitals, one of two to five words must be known as a name."""
        if kind != "name":
            return True
        words = re.findall(r"[^\W\d_]+", text[a:b])
        around = [w for part in (text[max(0, a - 30) : a].split()[-1:], text[b : b + 30].split()[:1]) for w in part if len(w) > 2]
        capitals = [w for w in words if w[0].isupper()]
        shouted = all(map(str.isupper, words)) and any(w.isupper() for w in around)
        if capitals and not shouted:
            return len(capitals) >= 2 and all(w in capitals or w.lower() in SMALL_WORDS for w in words)
        return 2 <= len(words) <= 5 and any(self.flags(w) for w in words)

    def _collect(self, text: str, row: tuple, tags: np.ndarray, out: list) -> None:
        _, number, (first, stop), ids = row
        if not tags[: len(ids)].any():
            return
        # Offsets are needed only where something is found.
        tokens = [(first + a, first + b) for a, b, _, _ in crf.tokens_of(text[first:stop])]
        open_span: list | None = None
        for (start, end), tag in zip([*tokens, (0, 0)], [*tags[: len(tokens)], 0], strict=True):
            label = LABELS[tag]
            if open_span and (label == "O" or label.startswith("B-")):
                kind = open_span[2]
                a, b = trimmed(kind, text, *open_span[:2])
                if a < b and self._told(kind, text, a, b) and passes(kind, text[a:b], text[a - 1 : a], text[b : b + 1]):
                    out.append((number, a, b, kind))
                open_span = None
            if label.startswith("B-"):
                open_span = [start, end, label[2:]]
            elif open_span and label != "O":
                open_span[1] = end


def redacted(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with ``[KIND]`` in place of each span."""
    parts, at = [], 0
    for _, start, end, kind in spans:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def _tagged(records: DataFrame, key: str, text: str, schema: str, rows_of: Callable) -> DataFrame:
    with ThreadPoolExecutor(1) as beside:  # the tasks count names while the driver fits
        fitted = beside.submit(train)
        given, family = sender_names(records, text)
        model = fitted.result()
    shared = records.sparkSession.sparkContext.broadcast((model.word.astype(np.float16), model.pair.astype(np.float16), model.move, given.field, family.field))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word, pair, move, *fields = shared.value
        loaded = crf.Model(LABELS, allowed_moves())
        loaded.word, loaded.pair, loaded.move = word.astype(np.float32), pair.astype(np.float32), move
        tagger = Tagger(loaded, *(NameFilter(0, field) for field in fields))
        for frame in frames:
            for start in range(0, len(frame), 500):
                part = frame.iloc[start : start + 500]
                texts = [t if isinstance(t, str) else "" for t in part["_t"]]
                rows = []
                for k, raw, t, spans in zip(part["_k"], part["_t"], texts, tagger.spans(texts), strict=True):
                    rows += rows_of(k, raw, t, spans)
                yield pd.DataFrame(rows, columns=["_k", *names])

    kind = dict(records.dtypes)[key]
    narrow = records.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_t"))
    return restored_key(narrow.mapInPandas(run, f"_k string, {schema}"), key, kind)


def find(records: DataFrame, key: str, text: str) -> DataFrame:
    """One row per span: message number (-1 before the first head), offsets in the text, kind."""
    rows_of = lambda k, raw, t, spans: [(k, *s) for s in spans]
    return _tagged(records, key, text, "line_no long, start long, end long, kind string", rows_of)


def redact(records: DataFrame, key: str, text: str) -> DataFrame:
    """Key, the text with placeholders and the number of spans replaced."""
    rows_of = lambda k, raw, t, spans: [(k, redacted(t, spans) if isinstance(raw, str) else None, len(spans))]
    return _tagged(records, key, text, "redacted string, n_spans long", rows_of)
