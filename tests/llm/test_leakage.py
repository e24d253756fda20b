"""Leaked passages: short items, insertions, brute force and items that have nothing to do with a document."""

import random

import numpy as np
import pytest

from chatloom.llm import leakage


def found(documents, items):
    block = leakage.item_blocks(list(enumerate(items)))[0]
    shard = leakage.Shard(block)
    for key, text in enumerate(documents):
        shard.add(key, text)
    return {(d, i) for d, i, *_ in shard.spans()}


@pytest.mark.parametrize("fragments", [0, 8, 40, 1000])
def test_halves_around_an_insertion_behind_fragments(fragments):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    words = item.split()
    text = "five six seven blank " * fragments + " ".join([*words[:7], "well", "now", *words[7:]])
    assert found([text], [item]) == {(0, 0)}


def test_short_items_and_sentences():
    items = ["Bread rises slowly in cold rooms", "It rained. The tall clock in Orsel stopped early. Nobody noticed at all that day.", "Orsel Varn Dell", "Why?", "Come now"]
    documents = [
        "he said bread rises slowly, in COLD rooms and left", "bread rises slowly in warm rooms", "bread rises slowly",
        "> the tall clock in Orsel stopped early", "the tall clock in Orsel stopped twice", "the tall clock in Mirn stopped early",
        "Orsel Varn Dell was there", "why? come now",
    ]
    assert found(documents, items) == {(0, 0), (1, 0), (3, 1), (4, 1)}


def test_unrelated_items_change_nothing():
    item = "The keeper of Ellhol Ford folded 780 sheets of tin before the well was dry. Nobody asked why."
    documents = [item, "the keeper of Ellhol Ford folded 12 sheets of tin before the well was dry", "keeper of Mirn Steps folded 9 sheets of tin before the well was dry", "nobody asked why"]
    alone = found(documents, [item])
    rng = random.Random(5)
    others = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=20)) for _ in range(400)]
    assert alone == {x for x in found(documents, [item, *others]) if x[1] == 0} == {(0, 0), (1, 0), (3, 0)}


def runs_of(own, codes):
    """All runs of three words or more on all diagonals, word by word."""
    for d in range(-len(own), len(codes)):
        same = {a: own[a] == codes[a + d] for a in range(len(own)) if 0 <= a + d < len(codes)}
        right = lambda a: same.get(a, False) or (a in same and same.get(a - 1, False) and same.get(a + 1, False))  # noqa: B023, E731
        start = None
        for a in range(len(own) + 1):
            if right(a) and start is None:
                start = a
            elif not right(a) and start is not None:
                if a - start >= 3:
                    yield start, a, d, np.array([same[k] for k in range(start, a)])
                start = None


def every_chain(runs, chain):
    yield chain
    s, e, d, _ = chain[-1]
    for run in runs:
        inserted = run[0] + run[2] - e - d + max(0, e - run[0])
        if run[0] > s and run[2] != d and -2 <= run[0] - e <= 1 and 0 <= inserted <= leakage.LONGEST_INSERTION:
            yield from every_chain(runs, [*chain, run])


def test_brute_force():
    """Whatever one diagonal shows is found; whatever is found, some chain shows."""
    rng = random.Random(7)
    hits = 0
    for _ in range(150):
        words = [f"{c}{i}" if rng.random() < 0.8 else f"{c.upper()}{c}" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"[: rng.randint(4, 14)])]
        items = [" ".join(rng.choices(words, k=rng.randint(3, 16))) + rng.choice(["", ". " + " ".join(rng.choices(words, k=5))]) for _ in range(4)]
        documents = []
        for _ in range(5):
            text = rng.choice(items).replace(".", "").split()
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            at = rng.randrange(len(text))
            documents.append(" ".join([*rng.choices(words, k=3), *text[:at], *rng.choices(words, k=rng.choice([0, 0, 2])), *text[at:]]))
        got = found(documents, items)
        block = leakage.item_blocks(list(enumerate(items)))[0]
        judge = leakage.Shard(block)
        for d, text in enumerate(documents):
            codes = [block.vocabulary.get(w, 0) for w in leakage.words(text)]
            for i in range(len(items)):
                runs = list(runs_of(list(block.codes[i]), codes))
                leaks = lambda chain: judge._leaks(i, covered(chain), chain[0][0], chain[-1][1])  # noqa: B023, E731
                single = any(leaks([r]) for r in runs)
                some = single or any(leaks(c) for r in runs for c in every_chain(runs, [r]))
                assert single <= ((d, i) in got) <= some, (documents[d], items[i])
                hits += (d, i) in got
    assert hits > 200


def covered(chain):
    right = np.zeros(chain[-1][1] - chain[0][0], bool)
    for s, e, _, same in chain:
        right[s - chain[0][0] : e - chain[0][0]] |= same
    return right


def test_many_documents_and_items_share_a_phrase(monkeypatch):
    """Meetings are halved by documents and items without losing any."""
    items = [f"it was on the way home that Name{i} lost the {i} keys again" for i in range(30)]
    documents = [items[i % 30] + " and it was on the way" for i in range(60)]
    whole = found(documents, items)
    assert whole == {(d, d % 30) for d in range(60)}
    monkeypatch.setattr(leakage, "MEETINGS", 50)
    assert found(documents, items) == whole
