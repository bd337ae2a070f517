"""Held-out accuracy, mixtures, and texts without a language."""

import itertools

import numpy as np
from conftest import values

from flightlens.llm import language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", language_id.held_out())
    model = language_id.learn(docs.where("NOT held_out"))
    assert model[0] == ["de", "en", "es", "fr"]
    found = language_id.identify(docs.where("held_out AND n_chars >= 20"), model).collect()
    assert np.mean([r.mixture.lang_pred == r.lang for r in found]) >= 0.98
    assert all(0 <= r.mixture.score <= 1 for r in found)


def test_two_languages_in_one_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, table = language_id.learn(docs)
    text = {x: docs.where(f"lang = '{x}' AND n_chars > 3000").orderBy("doc_id").first().text for x in ("en", "de")}
    lang, score, chosen, share = language_id.mixture(text["en"][:2000] + "\n" + text["de"][:1000], names, table)
    assert lang == "en" and sorted(chosen) == ["de", "en"] and 0.55 < score < 0.8
    assert abs(sum(share) - 1) < 1e-9
    assert language_id.mixture(text["en"], names, table)[2] == ["en"]


def test_proportions_are_those_of_the_mixture():
    draw = np.random.default_rng(1)
    likelihood = draw.dirichlet(np.full(200, 0.05), 3).T + 1e-6
    times = 30_000 * likelihood @ np.array([0.6, 0.0, 0.4])
    share, best = language_id.fit(likelihood, times)
    assert np.abs(share - [0.6, 0.0, 0.4]).max() < 0.02
    assert best > times @ np.log(likelihood @ np.full(3, 1 / 3))


def test_edges(spark, rows):
    docs = [(1, None, "xx"), (2, "", "xx"), (3, "123 ... ²", "xx"), (4, "hello there", None), (5, "the quick brown fox", "en"), (6, "der schnelle Fuchs", "de"), (6, "der schnelle Fuchs", "de"), (None, "z" * 50_000, None)]
    df = rows("doc_id long, text string, lang string, mixture string", *[(*x, "m") for x in docs])
    model = language_id.learn(df)
    assert model[0] == ["de", "en"]  # no text with a letter has "xx"
    out = language_id.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "mixture", "mixture_1"]
    got = {r.doc_id: (r.mixture_1.lang_pred, r.mixture_1.score) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[6][0] == "de" and got[5][0] == "en" and got[None][0] in ("de", "en")
    assert values(language_id.identify(df.limit(0), model)) == []
    nothing = language_id.learn(df.limit(0))
    assert nothing[0] == [] and {r.mixture_1.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_chosen_languages_against_all_subsets(spark):
    """The penalised likelihood of the chosen set is that of the best of all subsets, on texts of one to three languages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, table = language_id.learn(docs)
    text = {x: docs.where(f"lang = '{x}' AND n_chars > 3000").orderBy("doc_id").first().text for x in names}
    made = [text[x][:500] for x in names] + [text[a][:m] + " " + text[b][:n] for a, b in itertools.permutations(names, 2) for m, n in ((900, 900), (1500, 150))]
    made += [text["en"][:700] + text["fr"][:700] + text["es"][:700], "a", "ok ok ok"]
    for one in made:
        counts = np.bincount(language_id.trigrams(one), minlength=language_id.BUCKETS)
        (at,) = counts.nonzero()
        times = counts[at].astype(float)

        def worth(subset):
            return language_id.fit(table[list(subset)][:, at].T, times)[1] - 0.5 * np.log(times.sum()) * (len(subset) - 1)

        best = max(worth(s) for k in range(1, 5) for s in itertools.combinations(range(4), k))
        _, score, chosen, share = language_id.mixture(one, names, table)
        assert worth([names.index(x) for x in chosen]) >= best - 0.1, (one[:40], chosen)
        assert abs(sum(share) - 1) < 1e-6 and score == max(share)


def test_ties_go_to_the_smaller_name():
    table = np.full((2, language_id.BUCKETS), 1.0 / language_id.BUCKETS)
    assert language_id.mixture("some words", ["aa", "bb"], table)[:2] == ("aa", 1.0)
