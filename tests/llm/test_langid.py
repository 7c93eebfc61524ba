import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import langid


@pytest.fixture(scope="module")
def model(spark, docs):
    return langid.fit(docs.where(~langid.is_held_out("doc_id")))


def test_held_out_accuracy(docs, model):
    found = langid.identify(docs, model).where(langid.is_held_out("doc_id") & F.col("lang").isNotNull()).select("lang", "lang_pred").collect()
    assert len(found) > 20 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.9 * len(found)


def test_odd_rows(odd_docs, no_docs, model):
    rows = langid.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        none = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1 and r["node"] == "clash"
    assert langid.identify(no_docs, model).collect() == []
    nothing = langid.fit(odd_docs.where("false"))
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}


def test_mixed_text_has_spans(docs, model):
    by = {r["lang"]: r["text"] for r in docs.where("length(text) between 900 and 3000 and lang is not null").orderBy("doc_id").collect()}
    a, b = by["de"], by["en"]
    label, score, spans = langid.Labeller(model)(a + "\n" + b)
    assert {"de", "en"} <= {s[2] for s in spans} and 0 < score < 1
    assert all(s[1] <= t[0] for s, t in itertools.pairwise(spans))


def test_viterbi_and_dominance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k = rng.integers(1, 7), rng.integers(1, 4)
        scores, penalty = rng.normal(0, 3, (n, k)), float(rng.choice([0.5, 2, 6]))
        value = lambda p: sum(scores[t, x] for t, x in enumerate(p)) - penalty * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
        best = max(map(value, itertools.product(range(k), repeat=int(n))))
        assert value(langid.viterbi(scores, penalty).tolist()) == pytest.approx(best)
        a = langid.dominant(scores, penalty)
        if a >= 0:
            assert value([a] * n) == pytest.approx(best)


def test_scripts():
    assert [langid.script(c) for c in "aéЖ日あ한ع"] == ["Latin", "Latin", "Cyrillic", "Han", "Kana", "Hangul", "Arabic"]


def test_identify_against_a_full_viterbi_of_every_text(docs, odd_docs, model):
    """Scores word by word and the plain dynamic programme, without memo, batches or the test of dominance."""
    for frame in (docs.limit(150), odd_docs):
        for r in langid.identify(frame, model).collect():
            words = [m for m in langid.WORD.finditer(r["text"] or "")]
            if not any(c.isalpha() for c in r["text"] or ""):
                assert (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, [])
                continue
            scores = np.concatenate([model.word_scores([m[0]]) for m in words])
            path = langid.viterbi(scores, model.penalty)
            letters = [sum(m.end() - m.start() for m, k in zip(words, path, strict=True) if k == i) for i in range(len(model.langs))]
            value = lambda p: sum(scores[t, x] for t, x in enumerate(p)) - model.penalty * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
            at = np.zeros(len(r["text"]), int) - 1
            for s in r["spans"]:
                at[s["start"] : s["end"]] = model.langs.index(s["lang"])
            own = [int(at[m.start()]) for m in words]
            assert -1 not in own and value(own) == pytest.approx(value(path.tolist()))
            if own == path.tolist():
                assert r["lang_pred"] == model.langs[int(np.argmax(letters))] and r["score"] == pytest.approx(max(letters) / sum(letters))


def test_clear_documents(spark, docs, model):
    """Texts of one language stay with all their columns; mixed ones, those without letters and other languages go."""
    by = {r["lang"]: r["text"] for r in docs.where("length(text) between 900 and 3000 and lang is not null").orderBy("doc_id").collect()}
    part = [t[:600] for t in by.values()]
    assert len(part) >= 4
    rows = [(90_001, "\n".join(part), None), (90_002, "12 34 !!", "en"), (90_003, None, "en"), (90_004, by["en"], None)]
    planted = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame = docs.select("doc_id", "text", "lang").union(planted).withColumns({"score": F.col("doc_id") * 2.0, "spans": F.lit("own"), "Lang_Pred": F.lit("own"), "_found": F.lit("own"), "_text": F.lit("own"), "a.b": F.lit(1)})
    kept = langid.confident(frame)
    assert kept.columns == frame.columns and kept.dtypes == frame.dtypes
    found = {r["doc_id"]: r for r in kept.collect()}
    assert {90_001, 90_002, 90_003} & set(found) == set() and 90_004 in found
    assert all(r["score"] == 2.0 * i and r["spans"] == r["Lang_Pred"] == r["_found"] == r["_text"] == "own" and r["a.b"] == 1 for i, r in found.items())
    clean = [r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert len(set(clean) - set(found)) <= 0.005 * len(clean)
    english = {r["doc_id"] for r in langid.confident(frame, languages=["en"]).collect()}
    assert 90_004 in english and english < set(found)


def test_rare_languages_stay_in_the_fit(spark):
    rows = [(i, "the cat and the dog saw the thing", "en") for i in range(6000)] + [(6000 + i, "kot oraz pies widzieli rzecz", "pl") for i in range(6)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=600)
    assert sorted(model.langs) == ["en", "pl"] and langid.Labeller(model)("oraz pies widzieli")[0] == "pl"
    assert [langid.quota(c, 10) for c in ([1, 100, 100], [5, 4], [100])] == [4.5, float("inf"), 10]
