"""Operators on training text: brute force, round trips, held-out accuracy, and the edge cases that docstrings define."""

import itertools
import os
import random
import sys
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import connect, differences

from chatloom.llm import conversations, crf, fmindex, langid, leakage, lookalikes, moderation, packing, pii, queries
from chatloom.llm.boosting import Boosted, calibrated, isotonic

# -- queries ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    extra, missing, rows = differences(spark, connect(data), data, queries.queries()[name], queries.oracle_sql()[name])
    assert not extra and not missing and rows > 0


@pytest.mark.parametrize("name", ["p3_found", "p6_redacted", "p7_fill", "p9_rates", "p8_spans", "p2_forms", "p2_classes"])
def test_query_runs(spark, data, name):
    assert queries.queries()[name](spark, data).count() > 0


# -- conversations ------------------------------------------------------------------------------------------------------

M = "chat_id long, id long, reply_to_top_message_id long, text string, caption string, date timestamp_ntz, from_user struct<id: long>, arrival_seq long, role string, has_body int"
S = "id long, latest_message_id long, ord long, role string"


def chat(spark, rows, marks=()):
    full = [(c, i, t, text, None, None, None if who is None else (who,), k, "x", 1) for k, (c, i, t, text, who) in enumerate(rows)]
    bots = spark.createDataFrame([(100, "b"), (None, "n"), (100, "b")], "id long, role string")
    return spark.createDataFrame(full, M), spark.createDataFrame(list(marks), S), bots


def test_conversations_are_dropped_for_each_reason(spark):
    rows = [
        (1, 1, None, "q", 5), (1, 2, 1, "a", 100), (1, 3, 1, "thanks", 5), (1, 4, 1, "welcome", 100),  # kept
        (2, 1, None, "q", 5), (2, 2, 1, "a", 100), (2, 3, 1, "and?", 5),  # unanswered
        (3, 2, 1, "a", 100), (3, 3, 1, "q", 5), (3, 4, 1, "a", 100),  # no opening row
        (4, 1, None, "a", 100), (4, 2, 1, " ​", 5), (4, 3, 1, "b", 100),  # no user row with a body
        (5, 0, 0, "q", 5), (5, 3, 0, "a", 100),  # thread 0, opening row points to itself: kept
        (None, 1, 1, "q", 5), (6, None, 1, "q", 5), (7, 1, None, "alone", 5),
        (8, 1, None, "q", 5), (8, 2, 1, "a", 100), (8, 2, 1, None, 5),  # a later copy does not count: kept
        (9, 1, None, "q", 5), (9, 2, 1, "a", 100),  # the answer is above the mark
    ]
    inputs = chat(spark, rows, [(9, 5, 1, "r"), (9, 1, 2, "r"), (1, None, 1, "r")])
    got = {(r.chat_id, r.thread_id): r.drop_reason for r in conversations.dropped(*inputs).collect()}
    assert got == {(2, 1): "unanswered", (3, 1): "no opening row", (4, 1): "no user row"}
    kept = conversations.rebuild(*inputs).orderBy("chat_id", "turn").collect()
    assert [(r.id, r.role, r.turn) for r in kept if r.chat_id == 1] == [(1, "user", 0), (2, "assistant", 1), (3, "user", 2), (4, "assistant", 3)]
    assert {r.chat_id for r in kept} == {1, 5, 8}
    assert conversations.rebuild(*(x.limit(0) for x in inputs)).count() == 0


def dated(spark, rows):
    """Rows (chat, thread, id, hours or None) as rows of conversations with slots."""
    frame = spark.createDataFrame([(c, t, i, None if h is None else float(h)) for c, t, i, h in rows], "chat_id long, thread_id long, id long, h double")
    at = "cast(case when h is not null then timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, h * 3600) end as timestamp_ntz) as at"
    return conversations.conversation_rows(frame.selectExpr("chat_id", "thread_id", "id", at, "true as has_body", "'user' as role"))


def test_sessions_split_at_long_pauses(spark):
    hours = [0.0, 0.1, 0.2, 30.0, 30.1, None]
    paused = conversations.with_pauses(conversations.slots(dated(spark, [(1, 0, i, h) for i, h in enumerate(hours)])))
    got = conversations.sessions(paused, 3600).orderBy(F.col("slot").asc_nulls_last()).collect()
    assert [(r.session, r.n_rows) for r in got] == [(0, 3), (1, 2), (None, 1)]


def test_calibrated_gap_is_an_exact_quantile(spark):
    rng = random.Random(4)
    rows, pauses = [], []
    for thread in range(40):
        at, last = 0.0, None
        for i in range(rng.randint(1, 30)):
            at += rng.choice([0, 0.01, 0.2, 0.4, 0.6, 3, 40]) * rng.random()
            rows.append((1, 1000 + thread, 100_000 * thread + i, at))
            seconds = int(round(at * 3600e6))
            pauses += [] if last is None else [seconds - last]
            last = seconds
    paused = conversations.with_pauses(conversations.slots(dated(spark, rows)))
    want = sorted(pauses)[-(-95 * len(pauses) // 100) - 1] // 60_000_000 * 60
    assert conversations.calibrated_gap(paused) == max(want, 1800) > 1800
    assert conversations.calibrated_gap(paused.limit(0)) == 1800


def test_rows_of_one_date_make_one_slot(spark):
    rows = spark.range(100_000).selectExpr("1L as chat_id", "id as id", "0L as thread_id", "timestamp_ntz'2000-01-01 00:00:00' as at", "true as has_body", "if(id % 2 = 0, 'user', 'assistant') as role")
    slotted = conversations.slots(conversations.conversation_rows(rows))
    assert [(r.n_rows, r.asked, r.answered, r.opened) for r in slotted.collect()] == [(100_000, 99_998, 99_999, 1)]
    # The sum per slot is taken before rows are exchanged, and by hash.
    plan = slotted._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2


# -- look-alikes --------------------------------------------------------------------------------------------------------


def brute_class(text):
    apart = unicodedata.normalize("NFD", lookalikes.normalize(text))
    return "".join(lookalikes.CLASS_OF.get(c, c)[0] for c in apart)


letters = st.text(alphabet="aаоoсcpрx eéе́​\xa0Ａ1l-‑BВ", max_size=8)


@settings(max_examples=300, deadline=None)
@given(letters, letters)
def test_forms_are_equal_exactly_for_equal_classes(a, b):
    lattice = lookalikes.Lattice({("о", "к"): 5, ("o", "k"): 9, ("a", "b"): 3})
    assert (lattice.canonical(a) == lattice.canonical(b)) == (brute_class(a) == brute_class(b))
    assert lattice.canonical(lattice.canonical(a)) == lattice.canonical(a)


def test_search_prefers_the_script_of_the_corpus(spark):
    rows = spark.createDataFrame([("мост над рекой",), ("most over the river",), (None,), ("",)], "v string")
    counts = lookalikes.bigram_counts(rows, "v")
    lattice = lookalikes.Lattice(counts)
    assert lattice.canonical("моcт") == "мост" and lattice.canonical("оver") == "over"


def test_printed_forms_follow_the_script_of_a_token(spark):
    """Classes alone would print Latin letters; the search prints the script that the letters around speak for."""
    names = [(1, "qualname", "Cосна и ель"), (2, "qualname", "Сoсна и ель"), (3, "qualname", "Сосна и ель"), (4, "qualname", "Pоrt cосktail"), (5, "qualname", "Port cocktail"), (6, "username", "nothing")]
    frame = spark.createDataFrame([*names, *((i, "qualname", "Port cocktail") for i in range(10, 15))], "id long, field string, value string")
    rows = lookalikes.classes(frame).collect()
    assert {r.form for r in rows if r.field == "qualname"} == {"Сосна и ель", "Port cocktail"}
    assert {r.value: r.n_names for r in rows}["Port cocktail"] == 6 and len(rows) == 6
    got = sorted(tuple(r) for r in lookalikes.same_looking(frame).collect())
    assert got == sorted([(1, 2, "qualname"), (1, 3, "qualname"), (2, 3, "qualname"), (4, 5, "qualname"), *((4, i, "qualname") for i in range(10, 15))])


def test_pairs_equal_brute_force(spark):
    names = ["Radio Club", "Rаdio Club", "Radio\xa0Club", "Radio Club", "radio Club", "Radiö Club", "Radio Club!", "", None, "Ｒadio Club", "Café", "Café", "Cafe"]
    rows = [(i, None, n, 1) for i, n in enumerate(names)] + [(0, None, "Old name", 0), (50, "x", "Radio Club", 2)]
    state = spark.createDataFrame(rows, "id long, username string, qualname string, ord long")
    got = sorted(tuple(r) for r in lookalikes.same_looking(lookalikes.names_of(state)).collect())
    current = dict(enumerate(names)) | {50: "Radio Club"}
    want = sorted(
        (a, b, "qualname") for a, b in itertools.combinations(sorted(current), 2)
        if current[a] and current[b] and current[a] != current[b] and brute_class(current[a]) == brute_class(current[b])
    )
    assert got == want and len(want) > 5
    assert lookalikes.same_looking(lookalikes.names_of(state.limit(0))).count() == 0


# -- languages ----------------------------------------------------------------------------------------------------------

HELD_OUT = {
    "en": "We were told that the library opens later because the heating is broken", "de": "Wir haben gehört, dass die Bücherei später öffnet, weil die Heizung kaputt ist",
    "fr": "On nous a dit que la bibliothèque ouvre plus tard parce que le chauffage est en panne", "es": "Nos dijeron que la biblioteca abre más tarde porque la calefacción no funciona",
    "pt": "Disseram-nos que a biblioteca abre mais tarde porque o aquecimento não está a funcionar", "it": "Ci hanno detto che la biblioteca apre più tardi perché il riscaldamento non funziona",
    "nl": "Ons werd verteld dat de bibliotheek later opengaat omdat de verwarming niet werkt", "pl": "Powiedziano nam, że biblioteka otworzy się później, bo ogrzewanie nie działa",
    "ru": "Нам сказали, что библиотека откроется позже, потому что отопление не работает", "uk": "Нам сказали, що бібліотека відчиниться пізніше, бо опалення не працює",
    "tr": "Bize kütüphanenin daha geç açılacağını söylediler çünkü ısıtma çalışmıyor",
}


PLAIN = {
    "en": ["Do you know where we can buy fresh bread?", "We will meet you after lunch tomorrow", "Can someone help me carry these boxes upstairs?"],
    "de": ["Weißt du, wo man frisches Brot kaufen kann?", "Wir treffen euch morgen nach dem Mittagessen", "Kann mir jemand helfen, diese Kisten zu tragen?"],
    "fr": ["Sais-tu où on peut acheter du pain frais?", "Nous vous retrouverons demain après le déjeuner", "Quelqu'un peut m'aider à porter ces cartons?"],
    "es": ["¿Sabes dónde podemos comprar pan fresco?", "Nos vemos mañana después de comer", "¿Alguien puede ayudarme a subir estas cajas?"],
    "pt": ["Sabes onde podemos comprar pão fresco?", "Encontramo-nos amanhã depois do almoço", "Alguém me pode ajudar a levar estas caixas?"],
    "it": ["Sai dove possiamo comprare del pane fresco?", "Ci vediamo domani dopo pranzo", "Qualcuno può aiutarmi a portare queste scatole?"],
    "nl": ["Weet jij waar we vers brood kunnen kopen?", "We zien jullie morgen na de lunch", "Kan iemand me helpen deze dozen te dragen?"],
    "pl": ["Czy wiesz, gdzie można kupić świeży chleb?", "Spotkamy się z wami jutro po obiedzie", "Czy ktoś pomoże mi zanieść te pudła?"],
    "ru": ["Ты знаешь, где можно купить свежий хлеб?", "Мы встретимся с вами завтра после обеда", "Кто-нибудь поможет мне отнести эти коробки?"],
    "uk": ["Ти знаєш, де можна купити свіжий хліб?", "Ми зустрінемося з вами завтра після обіду", "Хтось допоможе мені віднести ці коробки?"],
    "tr": ["Taze ekmeği nereden alabileceğimizi biliyor musun?", "Yarın öğle yemeğinden sonra sizinle buluşacağız", "Bu kutuları taşımama yardım edecek biri var mı?"],
}


def test_seed_dictionaries_on_plain_sentences():
    """Without any sampled sentence: nearly all right, nothing decided wrongly, most decided."""
    judge = langid.seed_compressors()
    judged = [(code, *judge.decide(s)) for code, many in [*PLAIN.items(), *((c, [s]) for c, s in HELD_OUT.items())] for s in many]
    assert sum(code == found for code, found, _ in judged) >= 0.95 * len(judged)
    decided = [(code, found) for code, found, margin in judged if margin >= langid.LEAST_MARGIN]
    assert all(code == found for code, found in decided) and len(decided) >= 0.7 * len(judged)


def test_seed_dictionaries_on_held_out_sentences():
    judge = langid.seed_compressors()
    assert sum(judge.decide(s)[0] == code for code, s in HELD_OUT.items()) >= 9


def test_labels_are_checked_by_sentence(spark):
    line = "[2024-01-01 00:00:00] a b: {}\n\n"
    text = {code: line.format(s[: s.index(".")] + ".") for code, s in langid.SEEDS.items()}
    rows = [
        (1, text["de"], "deu"), (2, text["de"], "en"), (3, text["de"], None), (4, text["de"] + text["ru"], "de-AT"), (5, line.format("ok 👍 https://a.example/b") * 3, None),
        (6, None, None), (7, "", "und"), (8, text["fr"] + line.format("deadline"), "FR"), (9, text["ru"], "xx"), (9, text["ru"], "xx"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, text string, lang string, language string")
    fitted = langid.fit(docs, "record_id", "text", "lang")
    labelled = langid.label_sentences(docs, "record_id", "text", fitted)
    languages = langid.document_languages(labelled, "record_id")
    got = sorted(tuple(r) for r in langid.missing_or_wrong(docs, "record_id", "lang", languages).distinct().collect())
    assert got == [(2, "de"), (3, "de"), (4, "de"), (4, "ru"), (9, "ru")]
    assert [(r.language, r.stretch) for r in langid.stretches(labelled.where("record_id = 4"), "record_id").orderBy("stretch").collect()] == [("de", 1), ("ru", 2)]
    assert langid.label_sentences(docs.limit(0), "record_id", "text", fitted).count() == 0
    each = {r.record_id: (r.language, r.confidence) for r in langid.record_languages(docs, labelled, "record_id").collect()}
    assert len(each) == 9 and each[2][0] == each[3][0] == "de" and each[8][0] == "fr" and each[9][0] == "ru"
    assert each[5] == each[6] == each[7] == (None, 0.0) and all(c > 0.2 for k, (_, c) in each.items() if k not in (5, 6, 7))


# -- personal data ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.train())


def test_held_out_accuracy(tagger):
    rows, _, _ = pii.labelled_rows(seed=99, repeats=4)
    right = found = wanted = 0
    for text, spans in rows:
        got = {(k, text[a:b]) for _, a, b, k in tagger.spans([text])[0]}
        want = {(k, text[a:b]) for a, b, k in spans}
        right, found, wanted = right + len(got & want), found + len(got), wanted + len(want)
    assert right / found > 0.9 and right / wanted > 0.85


def test_redaction_keeps_the_rest(spark, tagger):
    text = "[2024-01-01 10:00:00] Ann Lee: call me on +44 7700 900123 after six\n\n[unknown] Bob: mail ann.lee@hexby.example or not\n\n"
    spans = tagger.spans([text])[0]
    assert [(n, k) for n, _, _, k in spans] == [(0, "phone"), (1, "email")]
    assert pii.redacted(text, spans) == text.replace("+44 7700 900123", "[PHONE]").replace("ann.lee@hexby.example", "[EMAIL]")
    rows = spark.createDataFrame([(1, text, "c"), (2, None, "c"), (3, "", "c"), (4, "plain " * 20_000, "c"), (1, text, "c")], "record_id long, text string, kind string")
    out = {r.record_id: r for r in pii.redact(rows, "record_id", "text").collect()}
    assert out[2].redacted is None and out[3].redacted == "" and out[4].redacted == "plain " * 20_000 and out[1].n_spans == 2
    assert pii.find(rows, "record_id", "text").count() == 4


def test_viterbi_equals_brute_force():
    random.seed(1)
    labels, allowed = ["O", "B-x", "I-x"], np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], bool)
    model, vocabulary = crf.Model(labels, allowed), crf.Vocabulary(lambda w: "")
    rng = np.random.default_rng(0)
    model.word += rng.normal(size=model.word.shape).astype(np.float32)
    model.move = np.where(allowed, rng.normal(size=(3, 3)), -1e4).astype(np.float32)
    words = [[random.choice(["a", "B", "7", "."]) for _ in range(n)] for n in (5, 3, 4)]
    batch = np.zeros((3, 5), np.int32)
    for i, row in enumerate(words):
        batch[i, : len(row)] = [vocabulary.add(w, False) for w in row]
    tables = vocabulary.tables()
    scores, best = model.emissions(batch, tables), model.decode(batch, tables)
    for i, row in enumerate(words):
        value = lambda path: model.move[0, path[0]] + scores[i, 0, path[0]] + sum(model.move[a, b] + scores[i, t + 1, b] for t, (a, b) in enumerate(itertools.pairwise(path)))  # noqa: B023, E731
        assert abs(value(list(best[i, : len(row)])) - max(value(list(p)) for p in itertools.product(range(3), repeat=len(row)))) < 1e-3


# -- packing ------------------------------------------------------------------------------------------------------------


def best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60))
def test_plan_is_complete_and_as_full_as_best_fit(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    plan = packing.Plan(counts, 40)
    used, seen = {}, {s: [] for s in counts}
    for size, first, end, container in plan.run():
        seen[size] += range(first, end)
        for k in range(end - first):
            used[container + k] = used.get(container + k, 0) + size
    assert all(sorted(seen[s]) == list(range(n)) for s, n in counts.items() if s)
    assert all(v <= 40 for v in used.values())
    assert len(used) == best_fit([s for s in sizes if s], 40)


def test_packing_edges(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 300), (5, "x"), (5, "x"), (6, "same"), (7, "same")]
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, size long, rank long, piece string")
    got = packing.pack(docs, "doc_id", "text", capacity=64).collect()
    each = {}
    for r in got:
        each[r.container_id] = each.get(r.container_id, 0) + r.size
    assert max(each.values()) <= 64 and len(got) == 6 + 5
    long = sorted((r.piece, r.start_token, r.size) for r in got if r.doc_id == 4)
    assert [p[1] for p in long] == [0, 64, 128, 192, 256] and sum(p[2] for p in long) == len(packing.encoding(packing.TOKENIZER).encode_ordinary("word " * 300))
    assert packing.pack(docs.limit(0), "doc_id", "text").count() == 0


# -- leaked passages ----------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index_finds_what_a_scan_finds(text, pattern):
    index = fmindex.FMIndex(np.array(text), 5, sample=3)
    lo, hi = index.search(np.array([pattern]))
    n = len(pattern)
    assert sorted(index.locate(np.arange(lo[0], hi[0]))) == [i for i in range(len(text) - n + 1) if text[i : i + n] == pattern]


ITEM = "The keeper of Ellhol Ford, who distrusts Kelxan, folded 780 sheets of tin before the well was dry. Which of the two touched the copper moth last before it reached Ellhol Ford?"


def test_leaks_and_lookalikes_of_leaks(spark):
    shared = "Read the exchange below and answer the question that follows it.\n"
    items = [(1, shared + ITEM), (2, shared + ITEM.replace("Kelxan", "Torven").replace("Ellhol", "Grisor").replace("780", "12").replace("copper moth", "brass snail")), (3, None), (4, ""), (5, shared + "A short one about nothing that matters in the least today or ever.")]
    sentence = "Which of the two touched the copper moth last before it reached Ellhol Ford?"
    swapped = sentence.replace("touched", "perhaps")
    docs = [
        (10, ITEM), (11, "chatter. " + sentence.upper() + " more"), (12, "x " + swapped), (13, "> The keeper of Ellhol Ford, who\n> distrusts Kelxan, folded 780\n> sheets of tin before the well was dry."),
        (14, shared), (15, "Kelxan of Ellhol Ford folded sheets of tin"), (16, None), (17, ""), (18, "tо​uched thе copper moth last before it reached Еllhol Ford. Which of the two " + sentence.replace("o", "о")), (10, ITEM), (19, "nothing " * 5000),
    ]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_words long")
    spans = leakage.leaks(frame, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert sorted({(r.doc_id, r.item_id) for r in spans.collect()}) == [(10, 1), (11, 1), (12, 1), (13, 1), (18, 1)]
    assert leakage.leaks(frame, "doc_id", "text", spark.createDataFrame([], "item_id long, text string"), "item_id", "text").count() == 0
    assert leakage.leaks(frame.limit(0), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").count() == 0


# -- moderation ---------------------------------------------------------------------------------------------------------


def test_disguises_are_removed():
    words = moderation.Window("You are a m.o.r.o.n, a b a s t a r d, n4k3d and losssser w​orthlеss").words
    lexicon = moderation.Lexicon({}, {})
    assert {"moron", "bastard", "naked", "loser", moderation.key_of("worthless")} <= set(lexicon.read(words))
    masked = lexicon.read(moderation.Window("what a p******e you are").words)
    assert "parasite" in masked


def test_boosting_and_calibration_on_held_out_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    w = np.ones(1000)
    model = Boosted().fit(x[:1000], y[:1000], w)
    score = model.score(x[1000:])
    assert ((score > 0) == (y[1000:] > 0)).mean() > 0.93
    upper, rate = isotonic(model.score(x[:1000]), y[:1000], w)
    assert (np.diff(rate) > 0).all() and (np.diff(upper) > 0).all()
    assert ((calibrated(score, (upper, rate)) > 0.5) == (y[1000:] > 0)).mean() > 0.9


def test_scores_on_held_out_documents(spark):
    bad = {"abuse": "you are a worthless {} and nobody wants you here", "hate": "all the {} are vermin and their kind breeds filth", "sexual": "send me nudes, I am horny and naked, {}"}
    fill = ["moron", "clown", "idiot", "northsiders", "neighbours", "loser", "tonight", "please"]
    plain = ["the ferry leaves at noon", "this stupid cable is worthless again", "the radio club met on Friday", "a talk about how people were driven out of town"]
    rng = random.Random(2)
    docs, labels, docs_truth = [], [], {}
    for i in range(320):
        c = rng.choice(["none", "none", *bad])
        text = rng.choice(plain) + ". " + (bad[c].format(rng.choice(fill)) + ". " if c in bad else "") + rng.choice(plain)
        docs.append((i, text, "s" + str(i % 2), 0.5))
        if i < 200:
            labels.append((i, c, "a"))
        docs_truth[i] = c
    docs += [(900, None, "s0", 0.1), (901, "", "s0", 0.1), (902, "word " * 50_000, None, 0.1), (901, "", "s0", 0.1)]
    labels += [(3, None, "b"), (900, "abuse", "b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, p_abuse double")
    scored = moderation.score(frame, "doc_id", "text", spark.createDataFrame(labels, "doc_id long, category string, annotator string"), ("source",))
    got = {(r.doc_id, r.category) for r in moderation.flagged(scored, "doc_id").collect()}
    want = {(i, c) for i, c in docs_truth.items() if c != "none"}
    held = {x for x in got if x[0] >= 200}, {x for x in want if x[0] >= 200}
    assert len(held[0] & held[1]) >= 0.9 * len(held[1]) and len(held[0] - held[1]) <= 3
    assert not {x for x in got if x[0] >= 900}
    assert {r.source for r in moderation.rates(scored, "source").collect()} == {"s0", "s1", None}
    unlabelled = moderation.score(frame, "doc_id", "text", spark.createDataFrame([], "doc_id long, category string"))
    assert unlabelled.count() == len(docs)


def test_normal_forms_are_stable():
    for text in ("ＡＢＣ", "é", "a​b", "x\xa0y"):
        once = lookalikes.normalize(text)
        assert lookalikes.normalize(once) == once == unicodedata.normalize("NFC", once)


def test_null_and_large_keys(spark):
    big = 2**60 + 1
    text = "[2024-01-01 00:00:00] a b: " + langid.SEEDS["de"][:80] + ". mail ann.lee@hexby.example please\n\n" + ITEM
    rows = spark.createDataFrame([(big, text, "en"), (None, text, "en"), (big + 2, None, None)], "k long, text string, lang string")
    labelled = langid.label_sentences(rows, "k", "text", {c: langid.dictionary([s]) for c, s in langid.SEEDS.items()})
    assert {r.k for r in labelled.collect()} == {big, None}
    assert {r.k for r in pii.redact(rows, "k", "text").collect()} == {big, None, big + 2}
    items = spark.createDataFrame([(big, ITEM), (big + 1, ITEM.replace("Ellhol", "Grisor"))], "item_id long, text string")
    # The second item differs in one name, which is a single replaced word, so both items leak.
    assert {(r.k, r.item_id) for r in leakage.leaks(rows, "k", "text", items, "item_id", "text").collect()} == {(k, i) for k in (big, None) for i in (big, big + 1)}
    assert {r.k for r in packing.pack(rows, "k", "text").collect()} == {big, None}
    labels = spark.createDataFrame([], "doc_id long, category string")
    assert {r.k for r in moderation.score(rows, "k", "text", labels).collect()} == {big, None, big + 2}


def test_personal_data_before_the_first_head(tagger):
    rest = "[2024-01-01 10:00:00] Bob: call +44 7700 900124 please\n\n"
    text = "reach me at ann.lee@hexby.example or +44 7700 900123\n\n" + rest
    found, plain = tagger.spans([text, " \n" + rest])
    assert [(n, k) for n, _, _, k in found] == [(-1, "email"), (-1, "phone"), (0, "phone")]
    assert [(n, k) for n, _, _, k in plain] == [(0, "phone")]
    want = text.replace("+44 7700 900123", "[PHONE]").replace("+44 7700 900124", "[PHONE]")
    assert pii.redacted(text, found) == want.replace("ann.lee@hexby.example", "[EMAIL]")
