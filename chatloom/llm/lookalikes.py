"""One consistent form for text that looks the same.

Compatibility normalization and the deletion of ignorable characters come first. Each letter then stands for its class
of look-alike letters; the classes of a token form a lattice, and Viterbi search under character bigram scores with a
penalty for changes of script picks one letter of each class. As the lattice depends only on the classes, strings that
look the same get the same form, and only they do.

Visible differences stay: letter case, accents, digits, punctuation, words. Defined results: null stays null; text of
ignorable characters alone becomes empty; white space of any kind becomes single blanks, none at the ends; texts of any
length are searched token by token.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators.state import current_state
from chatloom.storage import written

#: Letters that a reader cannot tell apart, Latin first, then Cyrillic, Greek, others.
LOOKALIKES = (
    "aаɑ", "cс", "dԁ", "eе", "gɡ", "hһ", "iі", "jјϳ", "lӏ", "oоοօ", "pрρ", "qԛ", "sѕ", "vνѵ", "wԝѡ", "xх", "yу",
    "AАΑ", "BВΒ", "CС", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜ", "NΝ", "OОΟՕ", "PРΡ", "QԚ", "SЅ",
    "TТΤ", "VѴ", "WԜ", "XХΧ", "YҮΥ", "ZΖ", "æӕ", "ÆӔ", "ΓГ", "ΠП", "ΦФ",
)
#: Hyphens that look like the ASCII one, and quotes like the ASCII apostrophe.
HYPHENS, APOSTROPHES = "\u2010\u2011\u2012\u2212\ufe63", "\u2018\u2019\u02bc\u02b9\u2032"
#: Characters without ink that are not of the category "format".
IGNORABLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164" + "".join(map(chr, range(0xFE00, 0xFE10)))

CLASS_OF = {letter: group for group in LOOKALIKES for letter in group}
SWITCH_PENALTY = 6.0
#: Scripts whose bigrams are counted; their letters bound the size of the model.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
MARK = "MARK"
_DROP = {ord(c): None for c in IGNORABLE} | {ord(c): "-" for c in HYPHENS} | {ord(c): "'" for c in APOSTROPHES}
_TOKEN = re.compile(r"[^\W\d_][^\W\d_\u0300-\u036f]*(?:[\u0300-\u036f]+[^\W\d_]*)*")
_SPACES = re.compile(r"\s+")


def normalize(text: str) -> str:
    """Compatibility form without ignorable characters, blanks and hyphens unified."""
    text = unicodedata.normalize("NFKC", text).translate(_DROP)
    if not text.isascii():
        text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n\r\x0b\x0c\x85")
        text = unicodedata.normalize("NFC", text)
    return _SPACES.sub(" ", text).strip()


@lru_cache(maxsize=4096)
def script(letter: str) -> str:
    if unicodedata.combining(letter):
        return MARK
    name = unicodedata.name(letter, "")
    return next((s for s in SCRIPTS if name.startswith(s)), "OTHER")


def token_bigrams(token: str) -> Iterator[tuple[str, str]]:
    """Bigrams of a token of one script, with blanks for its ends; a token of several scripts gives none."""
    if len({script(c) for c in token} - {MARK}) == 1 and script(token[0]) != "OTHER":
        yield from zip(" " + token, token + " ", strict=True)


def bigram_counts(texts: DataFrame, column: str) -> dict[tuple[str, str], int]:
    """Counts over all rows. The result is bounded by the letters of three scripts, not by the rows."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], int] = {}
        for frame in frames:
            for text in frame["_t"]:
                for token in _TOKEN.findall(normalize(text)):
                    for pair in token_bigrams(token):
                        seen[pair] = seen.get(pair, 0) + 1
        yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["a", "b", "n"])

    partial = texts.select(F.col(column).alias("_t")).where("_t is not null").mapInPandas(count, "a string, b string, n long")
    return {(r.a, r.b): r.n for r in partial.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


class Lattice:
    """Viterbi search for the most plausible letters of a token."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.counts, self.memo = counts, {}

    def step(self, a: str, b: str) -> float:
        # Joint rather than conditional counts: a letter the corpus never shows must not gain by being unknown.
        score = math.log(self.counts.get((a, b), 0) + 0.1)
        apart = a != " " and b != " " and script(a) != script(b) and MARK not in (script(a), script(b))
        return score - SWITCH_PENALTY * apart

    def best(self, token: str) -> str:
        key = "".join(CLASS_OF.get(c, c)[0] for c in token)
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[key] = self._search([CLASS_OF.get(c, c) for c in token])
        return self.memo[key]

    def _search(self, groups: list[str]) -> str:
        if all(len(g) == 1 for g in groups):
            return "".join(groups)
        layer: list[tuple[float, str]] = [(0.0, " ")]
        back: list[list[int]] = []
        for group in groups:
            arrows, following = [], []
            for letter in group:
                score, at = max((s + self.step(c, letter), -i) for i, (s, c) in enumerate(layer))
                arrows.append(-at)
                following.append((score, letter))
            back.append(arrows)
            layer = following
        at = -max((s + self.step(c, " "), -i) for i, (s, c) in enumerate(layer))[1]
        out = []
        for group, arrows in zip(reversed(groups), reversed(back), strict=True):
            out.append(group[at])
            at = arrows[at]
        return "".join(reversed(out))

    def canonical(self, text: str) -> str:
        """Letters are matched without their accents, which are put back on the letter chosen."""
        text = normalize(text)
        if text.isascii():
            return _TOKEN.sub(lambda m: self.best(m.group()), text)
        apart = unicodedata.normalize("NFD", text)
        return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: self.best(m.group()), apart))


def with_canonical(rows: DataFrame, column: str, target: str, counts: dict | None = None) -> DataFrame:
    """Adds the consistent form of ``column``; the model is counted over all of it unless given."""
    counts = bigram_counts(rows, column) if counts is None else counts
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(shared.value)
        for texts in batches:
            yield texts.map(lattice.canonical, na_action="ignore")

    return rows.withColumn(target, form(F.col(column)))


def names_of(state: DataFrame) -> DataFrame:
    """Id, field and value of the names in the current row of each chat; empty ones are left out."""
    now = current_state(state.select("id", "username", "qualname", "ord"))
    return now.unpivot(["id"], ["qualname", "username"], "field", "value").where("value <> '' and id is not null")


def classes(names: DataFrame) -> DataFrame:
    """One row per field and spelling with its form and the number of names: names of one field and form look the same.

    Each different spelling is searched once, however many chats have it; bigrams are counted over all names.
    """
    spelled = names.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_names"))
    return with_canonical(spelled, "value", "form", bigram_counts(names, "value"))


def same_looking(names: DataFrame) -> DataFrame:
    """Pairs of different chats whose names look the same without being the same string, smaller id first.

    ``names`` holds each id once per field. Different spellings of one form are paired first and then given their chats,
    so names that are spelled alike are never paired, and the last join is as large as the result.
    """
    names = written(names, "names")
    spelled = written(classes(names), "classes")
    several = spelled.groupBy("field", "form").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("field", "form")
    part = spelled.join(several, ["field", "form"], "left_semi").select("field", "form", "value")
    a, b = part.withColumnRenamed("value", "_a"), part.withColumnRenamed("value", "_b")
    spellings = a.join(b, ["field", "form"]).where("_a < _b").select("field", "_a", "_b")
    one = names.select("field", F.col("value").alias("_a"), F.col("id").alias("_i"))
    other = names.select("field", F.col("value").alias("_b"), F.col("id").alias("_j"))
    pairs = spellings.join(one, ["field", "_a"]).join(other, ["field", "_b"]).where("_i <> _j")
    return pairs.select(F.least("_i", "_j").alias("id_a"), F.greatest("_i", "_j").alias("id_b"), "field")
