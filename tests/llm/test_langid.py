import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from packetlog.llm import langid

WORDS = {"aa": ["kala", "masa", "taka", "ralla", "saka"], "bb": ["grint", "drosp", "bront", "stolk", "prumt"], "cc": ["żółw", "gęśl", "ćma", "łódź"]}


def corpus():
    rng = random.Random(1)
    return [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang)
            for k, lang in enumerate(rng.choice(sorted(WORDS)) for _ in range(300))]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(0)).withColumn("code", F.lit(0))


def brute_distance(text, profile, depth):
    """Out-of-place distance from the definition, with n-grams as strings."""
    words = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    counts = {}
    for n in (1, 2, 3):
        for k in range(len(words) - n + 1):
            g = words[k:k + n]
            counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum(ord(c) << langid.BITS * (len(g) - 1 - k) for k, c in enumerate(g))
    top = sorted(counts, key=lambda g: (-counts[g], code(g)))[:depth]
    rank = {c: r for r, c in enumerate(profile)}
    return sum(abs(rank[code(g)] - r) if code(g) in rank else depth for r, g in enumerate(top)) / (depth * len(top))


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    docs = table(spark, [*rows, (1000, None, "aa"), (1001, "123 !?", "aa"), (1002, "", None), (None, "kala masa taka", None), (0, rows[0][1], rows[0][2])])
    profiles = langid.fit(docs)
    found = langid.predict(docs, profiles).withColumn("held_out", langid.held_out()).collect()
    truth = {k: lang for k, _, lang in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert all(r.lang_pred == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in found}
    assert [by[k].lang_pred for k in (1000, 1001, 1002, None)] == ["und", "und", "und", "aa"] and by[1000].score == 0
    assert all(0 <= r.score <= 1 for r in found)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*truth, None}


def test_distance_is_as_defined(spark):
    profiles = langid.fit(table(spark, corpus()))
    model, grams = langid.Profiles(profiles, langid.DEPTH), langid.Grams(langid.letter_table())
    for text in ("kala, MASA! drosp", "żółw", "a", "Qué 12 grint  stolk x"):
        name, score = model.best(grams.top(text, langid.DEPTH))
        all_ = {n: brute_distance(text, profiles[n], langid.DEPTH) for n in profiles}
        assert np.isclose(1 - score, all_[name]) and np.isclose(all_[name], min(all_.values()))


def test_nothing_learned_and_empty(spark):
    docs = table(spark, [(1, "abc", None)])
    assert langid.fit(docs) == {} and [r.lang_pred for r in langid.predict(docs, {}).collect()] == ["und"]
    nothing = docs.where(F.lit(False))
    assert langid.fit(nothing) == {} and langid.predict(nothing, {}).count() == 0 == langid.keep_known(nothing).count()


def test_short_texts_of_a_large_alphabet_are_kept(spark):
    rng = random.Random(5)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    lexicon = ["".join(rng.choices(letters, k=rng.choice([1, 2, 2, 3]))) for _ in range(20_000)]
    weights = [1 / (k + 1) for k in range(len(lexicon))]
    say = lambda n: "".join(rng.choices(lexicon, weights, k=n))[:n]
    rows = [(k, say(rng.choice([20, 50, 100, 400])), "zz") for k in range(400)] + [(1000, "12 !", "zz")]
    docs = table(spark, [*corpus_with_ids(2000), *rows])
    low = [r.doc_id for r in langid.predict(docs, langid.fit(docs)).where("score < 0.25 AND lang_pred = 'zz'").collect()]
    assert len(low) > 50
    assert {r.doc_id for r in langid.keep_known(docs).collect()} == {r.doc_id for r in docs.collect()} - {1000}


def corpus_with_ids(first):
    return [(first + k, text, lang) for k, text, lang in corpus()]


def test_texts_of_an_unknown_language_are_rejected(spark):
    rng = random.Random(8)
    strange = ["zzyqx", "qwyzj", "xxqzv", "jjwqy"]
    rows = [(5000 + k, " ".join(rng.choice(strange) for _ in range(20)), None) for k in range(30)]
    docs = table(spark, [*corpus(), *rows])
    assert {r.doc_id for r in langid.keep_known(docs).collect()} == {k for k, _, _ in corpus()}


def test_sample_is_bounded_and_nearly_full(spark):
    """Copies count once; null ids with different texts are different documents."""
    rows = [(k, f"text {k}", "aa") for k in range(3000)] + [(7, "text 7", "aa")] * 500 + [(None, f"more {k}", "bb") for k in range(900)] + [(9, "x", "cc")] * 700
    docs = table(spark, rows).where(~langid.held_out())
    for sample in (10, 100, 400):
        n = {r["lang"]: r["count"] for r in langid._teachers(docs, sample).groupBy("lang").count().collect()}
        assert n["cc"] == 1 and all(0.8 * sample <= n[k] <= sample for k in ("aa", "bb"))
    assert langid._teachers(docs, 5000).count() == docs.select("doc_id", "text").distinct().count()


def test_filter_learns_from_all_rows(spark, monkeypatch):
    """Profiles and least scores of the filter come from every labelled row, whatever
    the sample of op5 is; repeated rows count once."""
    monkeypatch.setattr(langid, "SAMPLE", 5)
    monkeypatch.setattr(langid, "CHUNK", 100, raising=False)
    rng = random.Random(3)
    strange = ["zzyqx", "qwyzj", "xxqzv", "jjwqy"]
    odd = [(6000 + k, " ".join(rng.choice(strange) for _ in range(20)), "aa") for k in range(8)]
    rows = [(k, text, "aa") for k, text, lang in corpus() if lang == "aa"] + odd
    docs = table(spark, [*rows, *odd * 50, (7000, "12 !", "aa"), (7001, None, "aa")])
    assert {zlib.crc32(str(k).encode()) % 4 == 2 for k, _, _ in odd} == {True, False}
    assert {r.doc_id for r in langid.keep_known(docs).collect()} == {k for k, _, _ in rows}
    seen = []
    monkeypatch.setattr(langid, "_least", lambda taught, profiles, depth: seen.append(profiles) or {})
    langid.keep_known(docs)
    assert seen == [langid.fit(docs, sample=10**6)]
