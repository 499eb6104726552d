import pickle
import random

import numpy as np
import pyarrow as pa

from corpuscule.llm import lang_id


def phrases(text: np.ndarray, training: np.ndarray) -> int:
    """Greedy longest matches, by brute force; a character that never occurs is a phrase of its own."""
    whole, total = training.tobytes(), 0
    for a in range(0, len(text), lang_id.BLOCK):
        block = text[a : a + lang_id.BLOCK]
        i = 0
        while i < len(block):
            j = i + 1
            while j < len(block) and block[i : j + 1].tobytes() in whole:
                j += 1
            total, i = total + 1, j
    return total


def test_parse_equals_brute_force(written):
    training = {"en": written(1, 300), "fr": written(2, 300, "fr")}
    model = lang_id.Model(training)
    texts = [written(3, 40), written(4, 400), written(5, 60, "fr"), "xyz qqq", "a"]
    rate, n, _ = lang_id.classify(model, pa.array(texts))
    for i, t in enumerate(texts):
        sequence = model.sequence(t)
        assert n[i] == len(sequence)
        for j, name in enumerate(model.languages):
            own = model.sequence(training[name])
            assert round(rate[i, j] * n[i] / model.bits[j]) == phrases(sequence, own[own != 1]), (i, name)


def test_held_out_accuracy(spark, written):
    rows = [(i, written(i, 60, lang), lang) for i, lang in enumerate(["en", "fr"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs.where("doc_id < 40"))
    got = {r.doc_id: r for r in lang_id.identify_languages(docs.where("doc_id >= 40"), model).collect()}
    assert all(got[i].lang_id == lang and got[i].keep for i, _, lang in rows[40:])
    strange = spark.createDataFrame([(1, "zzq kxv wjp qzx " * 20), (2, "привет как дела " * 20)], "doc_id long, text string")
    assert not any(r.keep for r in lang_id.identify_languages(strange, model).collect())


def test_odd_rows(odd, clashing, nothing):
    got = lang_id.identify_languages(clashing).collect()
    assert len(got) == clashing.count()
    assert all(not r.keep and r.lang_id is None for r in got if r.doc_id in (3, 4, 5, 6))
    kept = lang_id.keep_identified(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    assert lang_id.identify_languages(nothing).count() == 0
    unlabelled = lang_id.identify_languages(odd.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()
    assert all(r.lang_id is None for r in unlabelled)


def han(seed: int, letters: int, first: int = 0x4E00) -> str:
    """Text of words of one or two letters out of 2,000, some far more frequent than others."""
    lexicon, rng = random.Random(1), random.Random(seed)
    words = ["".join(chr(first + lexicon.randrange(2_000)) for _ in range(lexicon.randint(1, 2))) for _ in range(4_000)]
    return "".join(rng.choices(words, [1 / (i + 3) for i in range(4_000)], k=letters))[:letters]


def test_languages_of_many_letters_are_kept(spark, written):
    rows = [(i, han(i, 700) if i % 2 else written(i, 100), "zh" if i % 2 else "en") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs.where("doc_id < 60"))
    got = {r.doc_id: r for r in lang_id.identify_languages(docs.where("doc_id >= 60"), model).collect()}
    assert all(got[i].lang_id == lang and got[i].keep for i, _, lang in rows[60:])
    strange = spark.createDataFrame([(1, han(1, 400, 0xAC00)), (2, "zzq kxv wjp qzx " * 20)], "doc_id long, text string")
    assert not any(r.keep for r in lang_id.identify_languages(strange, model).collect())


def test_parse_equals_brute_force_over_many_alphabets(written):
    scripts = {f"s{k}": "".join(chr(0x400 + 40 * k + ord(c) % 32) if c != " " else c for c in written(k, 200)) for k in range(4)}
    training = scripts | {"zh": han(1, 3_000), "en": written(9, 200), "none": ""}
    model = lang_id.Model(training)
    texts = [han(2, 300), written(3, 60), training["s1"][:90] + han(4, 30), "ÅÅ Ωω", "x"]
    rate, n, _ = lang_id.classify(model, pa.array(texts))
    for i, t in enumerate(texts):
        for j, name in enumerate(model.languages):
            assert round(rate[i, j] * n[i] / model.bits[j]) == phrases(model.sequence(t), model.sequence(training[name])), (i, name)


def test_every_label_gets_a_model(spark, written):
    """80 labels of 48 rows and more, each with letters of its own."""
    write = lambda k, i: "".join(chr(0x4E00 + 32 * k + ord(c) % 32) if c != " " else c for c in written(i, 6))
    rows = [(50 * k + i, write(k, i), f"l{k:02}") for k in range(80) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs)
    assert model.languages == [f"l{k:02}" for k in range(80)]
    texts = pa.array([write(k, 5_000 + k) for k in range(80)])
    rate = lang_id.classify(model, texts)[0]
    assert rate.argmin(1).tolist() == list(range(80))


def test_each_of_many_languages_keeps_its_sample(spark, written):
    rows = [(i, written(i, 1_500), f"l{i % 20:02}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs)
    assert len(model.languages) == 20 and all(2**b > 0.95 * lang_id.SAMPLE_CHARS for b in model.bits)


def test_many_models_in_one_process_agree_with_fresh_ones(written):
    """Models made and freed one after the other, some at the same address, each with letters of its own."""
    for k in range(30):
        shift = lambda x, k=k: "".join(chr(0x400 + 32 * k + ord(c) % 32) if c != " " else c for c in x)
        model = lang_id.Model({"own": shift(written(1, 300)), "en": written(2, 300)})
        rate = lang_id.classify(model, pa.array([shift(written(3, 60)), written(4, 60)]))[0]
        assert rate.argmin(1).tolist() == [1, 0] and (rate.min(1) < model.most(lang_id.STRANGE)).all(), k
        again = pickle.loads(pickle.dumps(model))
        assert "table" not in again.__dict__ and (again.table == model.table).all()


SCRIPTS = {"en": 0x61, "ru": 0x430, "el": 0x3B1, "th": 0xE01, "ja": 0x3041}


def scripted(seed: int, lang: str, words: int, written) -> str:
    if lang == "zh":
        return han(seed, 6 * words)
    return "".join(chr(SCRIPTS[lang] + (ord(c) - 97) % 24) if c.isalpha() else c for c in written(seed, words))


def test_six_scripts_are_kept_and_gibberish_goes_at_every_size(spark, written):
    kept = {}
    for size in (40, 120):
        rows = [(1_000 * k + i, scripted(1_000 * k + i, lang, 70, written), lang) for k, lang in enumerate([*SCRIPTS, "zh"]) for i in range(size)]
        rng = random.Random(2)
        for k, lang in enumerate([*SCRIPTS, "zh"]):
            for i in range(5):  # the letters of the language's own texts, in no order
                letters = list(scripted(50_000 + i, lang, 70, written))
                rng.shuffle(letters)
                rows.append((100_000 + 10 * k + i, "".join(letters), None))
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = {r.doc_id: r for r in lang_id.identify_languages(docs).collect()}
        assert all(got[i].keep and got[i].lang_id == lang for i, _, lang in rows if lang)
        kept[size] = [got[i].keep for i, _, lang in rows if not lang]
    assert kept[40] == kept[120] and not any(kept[40][:-5])


def test_short_texts_follow_the_same_rule(spark, written):
    model = lang_id.Model({"en": written(1, 3_000)})
    texts = ["a", "the", "He is on", "zq", "zqx kvj wpf zzx qkq jjv xqz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.keep for r in lang_id.identify_languages(docs, model).orderBy("doc_id").collect()] == [True, True, True, True, False]
