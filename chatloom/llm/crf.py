"""A linear-chain conditional random field over hashed token features, in numpy batches.

Tokens are scored per distinct token: a weight table for each neighbour position holds word-shape features, another one
pairs of neighbouring shapes and words. Training is AdaGrad on the exact log-likelihood (batched forward-backward);
decoding is batched Viterbi.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Sequence

import numpy as np

#: Neighbour positions and how many of a token's features count there, the most telling first.
OFFSETS = {-3: 2, -2: 2, -1: 6, 0: 99, 1: 6, 2: 2, 3: 2}
WORD_SIZE, PAIR_SIZE = 1 << 14, 1 << 15
#: Tokens whose features are kept.
KEPT = 200_000
TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\s]", re.U)
_DIGITS = re.compile(r"\d")


def hashed(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def word_shape(word: str) -> str:
    """Digits keep their number, letters their case."""
    if word.isdigit():
        return "0" * min(len(word), 12)
    if not word[0].isalpha():
        return word
    if word.isupper():
        return "X" if len(word) == 1 else "XX"
    return "Xx" if word[0].isupper() else "x"


def features(word: str, glued: bool, flags: str) -> list[str]:
    """Names of a token's features; ``glued`` tells that no space precedes it, ``flags`` come from word lists."""
    low, shape = word.lower(), word_shape(word)
    out = [f"w={_DIGITS.sub('0', low)}", f"s={shape}", f"g={shape[:1]}{glued}", f"f={flags}", f"fs={flags}{shape}"]
    if word.isalpha():
        script = "c" if "Ѐ" <= word[0] <= "ԯ" else "l"
        out += [f"e={low[-3:]}", f"p={low[:3]}", f"e4={low[-4:]}", f"n={min(len(word), 10)}", f"c={script}{shape}"]
    elif word.isdigit():
        out += [f"d={min(len(word), 12)}", f"d0={word[0] == '0'}"]
    return out


class Vocabulary:
    """Distinct tokens of a batch with their feature ids; what is known of a token is kept from batch to batch."""

    def __init__(self, flags: Callable[[str], str], known: dict | None = None) -> None:
        self.flags, self.known, self.index = flags, {} if known is None else known, {}
        self.rows: list[tuple] = []
        self.chunks: dict[str, list[int]] = {}

    def add(self, word: str, glued: bool) -> int:
        key = (word, glued)
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.rows) + 1  # 0 is the padding
            row = self.known.get(key)
            if row is None:
                if len(self.known) >= KEPT:
                    self.known.clear()
                code = lambda text: zlib.crc32(text.encode("utf-8", "surrogatepass"))
                ids = [hashed(f, WORD_SIZE) for f in features(word, glued, self.flags(word))]
                row = self.known[key] = (ids, code(word.lower()), code(f"{word_shape(word)}{glued}"))
            self.rows.append(row)
        return at

    def ids_of(self, text: str) -> list[int]:
        """Numbers of the tokens of a text; what stands between blanks is cut into tokens once a batch."""
        out: list[int] = []
        for chunk in text.split():
            ids = self.chunks.get(chunk)
            if ids is None:
                ids = self.chunks[chunk] = [self.add(w, g) for _, _, w, g in tokens_of(chunk)]
            out += ids
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(feature ids, their mask, word codes, shape codes), row 0 for the padding."""
        width = max([len(r[0]) for r in self.rows], default=1)
        ids, mask = np.zeros((len(self.rows) + 1, width), np.int32), np.zeros((len(self.rows) + 1, width), np.float32)
        for i, (row, _, _) in enumerate(self.rows, 1):
            ids[i, : len(row)], mask[i, : len(row)] = row, 1
        mask[0, 0] = 1
        return ids, mask, np.array([7, *(r[1] for r in self.rows)], np.uint64), np.array([11, *(r[2] for r in self.rows)], np.uint64)


def tokens_of(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, normalized token, glued) of a text; offsets are those of the text itself."""
    out, last = [], -1
    for m in TOKEN.finditer(text):
        word, (start, end) = m.group(), m.span()
        if not word.isascii():
            word = unicodedata.normalize("NFKC", word) or word
        out.append((start, end, word, start == last))
        last = end
    return out


def shifted(batch: np.ndarray, offset: int) -> np.ndarray:
    out = np.zeros_like(batch)
    if offset == 0:
        return batch
    if abs(offset) < batch.shape[1]:
        if offset > 0:
            out[:, :-offset] = batch[:, offset:]
        else:
            out[:, -offset:] = batch[:, :offset]
    return out


def pair_ids(batch: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> list[np.ndarray]:
    """Hashed pairs of a token with its neighbours."""
    before, after = shifted(batch, -1), shifted(batch, 1)
    mix = lambda a, b, salt: ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt)) >> np.uint64(40)) % np.uint64(PAIR_SIZE)
    return [
        mix(shapes[before], shapes[batch], 1).astype(np.int32), mix(shapes[batch], shapes[after], 2).astype(np.int32),
        mix(words[before], shapes[batch], 3).astype(np.int32), mix(shapes[batch], words[after], 4).astype(np.int32),
        mix(words[before] ^ (words[shifted(batch, -2)] << np.uint64(1)), shapes[batch], 5).astype(np.int32),
    ]


def present(batch: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a batch, the padding first, and the batch in numbers of that list."""
    seen = np.zeros(size, bool)
    seen[0] = True
    seen[batch.ravel()] = True
    used = np.flatnonzero(seen)
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    return used, place[batch]


class Model:
    """Weights: one table per neighbour position, one of pairs, one of label transitions."""

    def __init__(self, labels: Sequence[str], allowed: np.ndarray) -> None:
        self.labels = list(labels)
        n = len(labels)
        self.word = np.zeros((len(OFFSETS), WORD_SIZE, n), np.float32)
        self.pair = np.zeros((PAIR_SIZE, n), np.float32)
        self.move = np.where(allowed, 0, -1e4).astype(np.float32)
        self.allowed = allowed

    def emissions(self, batch: np.ndarray, tables: tuple) -> np.ndarray:
        ids, mask, words, shapes = tables
        total = np.zeros((*batch.shape, len(self.labels)), np.float32)
        used, local = present(batch, len(ids))
        ids, mask = ids[used], mask[used]
        for k, (offset, width) in enumerate(OFFSETS.items()):
            scores = np.zeros((len(ids), len(self.labels)), np.float32)
            for f in range(min(width, ids.shape[1])):
                scores += self.word[k, ids[:, f]] * mask[:, f, None]
            total += scores[shifted(local, offset)]
        for p in pair_ids(batch, words, shapes):
            total += self.pair[p]
        return total

    def decode(self, batch: np.ndarray, tables: tuple) -> np.ndarray:
        """Best labels of each row; those of the padding mean nothing.

        The first label throughout is best, without a search, where no token gains by another label even with the two
        best transitions beside it; that holds for most rows.
        """
        scores = self.emissions(batch, tables)
        best = np.zeros(batch.shape, np.int8)
        gain = scores[:, :, 1:].max(2) - scores[:, :, 0] + 2 * (self.move.max() - self.move[0, 0])
        open_rows = np.flatnonzero(((gain >= 0) & (batch != 0)).any(1))
        if len(open_rows):
            best[open_rows] = self._search(scores[open_rows], batch[open_rows] == 0)
        return best

    def _search(self, scores: np.ndarray, padded: np.ndarray) -> np.ndarray:
        rows, length, n = scores.shape
        back = np.zeros((rows, length, n), np.int8)
        start = scores[:, 0] + self.move[0]
        for t in range(1, length):
            reach = start[:, :, None] + self.move[None]
            back[:, t] = reach.argmax(1)
            following = np.take_along_axis(reach, back[:, t, None], 1)[:, 0] + scores[:, t]
            pad = padded[:, t]
            back[pad, t], following[pad] = np.arange(n), start[pad]
            start = following
        best = np.zeros((rows, length), np.int8)
        best[:, -1] = start.argmax(1)
        for t in range(length - 1, 0, -1):
            best[:, t - 1] = back[np.arange(rows), t, best[:, t]]
        return best


def _marginals(local: np.ndarray, move: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the labels of each token, and expected numbers of the moves, by forward and backward sweeps whose
    sums are kept at one; ``local`` and ``move`` are exponentials of scores."""
    rows, length, n = local.shape
    ahead, behind, total = np.zeros_like(local), np.ones_like(local), np.ones((rows, length))
    ahead[:, 0] = local[:, 0] * move[0]
    for t in range(length):
        if t:
            step = (ahead[:, t - 1] @ move) * local[:, t]
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])  # padding passes on what was reached
        total[:, t] = ahead[:, t].sum(1)
        ahead[:, t] /= total[:, t, None]
    for t in range(length - 2, -1, -1):
        step = (local[:, t + 1] * behind[:, t + 1] / total[:, t + 1, None]) @ move.T
        behind[:, t] = np.where(real[:, t + 1, None], step, 1)
    reached = (local * behind / total[:, :, None])[:, 1:][real[:, 1:]]
    return ahead * behind, move * (ahead[:, :-1][real[:, 1:]].T @ reached)


def train(
    sentences: list[tuple[list[tuple[str, bool]], list[int]]], labels: Sequence[str], allowed: np.ndarray,
    flags: Callable[[str], str], epochs: int = 10, size: int = 256, rate: float = 0.25, decay: float = 1e-5, seed: int = 7,
) -> Model:
    """Fits the weights on labelled token rows."""
    model, vocabulary = Model(labels, allowed), Vocabulary(flags)
    coded = [(np.array([vocabulary.add(*t) for t in toks], np.int32), np.array(tags, np.int64)) for toks, tags in sentences if toks]
    tables = vocabulary.tables()
    ids, mask, words, shapes = tables
    n = len(labels)
    sums = [np.full(w.shape, 1e-3, np.float32) for w in (model.word, model.pair, model.move)]
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(coded))
        order = sorted(order, key=lambda i: len(coded[i][0]) // 6)
        groups = [order[i : i + size] for i in range(0, len(order), size)]
        for g in random.permutation(len(groups)):
            part = [coded[i] for i in groups[g]]
            length = max(len(x) for x, _ in part)
            batch, gold, real = np.zeros((len(part), length), np.int32), np.zeros((len(part), length), np.int64), np.zeros((len(part), length), bool)
            for i, (x, y) in enumerate(part):
                batch[i, : len(x)], gold[i, : len(x)], real[i, : len(x)] = x, y, True
            scores = model.emissions(batch, tables).astype(np.float64)
            marginal, joint = _marginals(np.exp(scores - scores.max(2, keepdims=True)), np.exp(model.move.astype(np.float64)), real)
            gradient = -marginal
            np.put_along_axis(gradient, gold[:, :, None], np.take_along_axis(gradient, gold[:, :, None], 2) + 1, 2)
            gradient[~real] = 0
            follows = real[:, 1:]
            moves = np.bincount(gold[:, :-1][follows] * n + gold[:, 1:][follows], minlength=n * n).reshape(n, n) - joint
            first = gradient[:, 0].sum(0)
            moves[0] += first
            flat = gradient.reshape(-1, n).astype(np.float32)
            used, local = present(batch, len(ids))
            for k, (offset, width) in enumerate(OFFSETS.items()):
                own, weight = ids[used, :width], mask[used, :width]
                rows = np.unique(own)
                at = np.searchsorted(rows, own).ravel()
                by_token = _sum_rows(shifted(local, offset).ravel(), flat, len(used))
                step = _sum_rows(at, (by_token[:, None] * weight[:, :, None]).reshape(-1, n), len(rows))
                _climb(model.word[k], sums[0][k], rows, step, rate, decay)
            pairs = np.concatenate([p.ravel() for p in pair_ids(batch, words, shapes)])
            rows, at = np.unique(pairs, return_inverse=True)
            _climb(model.pair, sums[1], rows, _sum_rows(at, np.tile(flat, (len(pairs) // len(flat), 1)), len(rows)), rate, decay)
            _climb(model.move, sums[2], np.arange(n), np.where(allowed, moves, 0).astype(np.float32), rate, decay)
            model.move[~allowed] = -1e4
    return model


def _climb(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, step: np.ndarray, rate: float, decay: float) -> None:
    """AdaGrad on some rows of a table."""
    squares[rows] += step**2
    weights[rows] += rate * step / np.sqrt(squares[rows]) - decay * weights[rows] * (step != 0)


def _sum_rows(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(keys, values[:, j], size) for j in range(values.shape[1])], 1).astype(np.float32)
