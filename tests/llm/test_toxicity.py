"""The pattern grammar, its composition, and learning on small corpora."""

import itertools
import random

import pytest

from sluice.llm import toxicity as t

LEX = t.Lexicon({"idiot": 3}, {"grubl": 2})


def readings(text):
    return sorted(t.read(text, LEX, t.grammar()).elements())


@pytest.mark.parametrize("text, want", [
    ("What an idiot.", ["I3"]), ("you idiot", ["D3"]), ("idiot, that is what you are", ["I3"]), ("an idiot are you", ["D3"]),
    ("You are not an idiot", ["n3"]), ("he said an idiot came", ["r3"]), ('the word "idiot" is rude', ["r3"]), ("grublish grubl grublen", ["I2", "I2"]),
    ("I will kill you", ["H"]), ("they kill time", []), ("I would never kill you", ["nH"]), ("She wrote: fine. Idiot!", ["I3"]), ("not now. idiot", ["I3"]),
    ("", []), (None, []), ("...!?", []), ("he said she is not an idiot", ["n3"]),
])
def test_clauses(text, want):
    assert readings(text) == want


def test_composition_is_the_cascade():
    """The composed machine gives the heaviest of all readings of one transducer after the other."""

    def outputs(machine, symbols):
        at = [(0, 0.0, ())]
        for s in symbols:
            at = [(to, w + v, (*out, end)) for state, w, out in at for end, v, to in machine.arcs[state].get(s, ())]
        return [(w, out) for state, w, out in at if state in machine.final]

    weights = {r: t.prior(r) for r in t.READINGS}
    whole, rng = t.grammar(weights), random.Random(5)
    for _ in range(150):
        symbols = rng.choices(["I1", "I4", "T", "Y", "N", "R", "Q", "o"], k=rng.randint(0, 7))
        strings = {tuple(symbols)}
        for machine in (t.threat(), t.target(), t.negation(), t.reported()):
            strings = {out for s in strings for _, out in outputs(machine, s)}
        best = max((sum(weights.get(x, 0.0) for x in s) for s in strings), default=float("-inf"))
        got, path = whole.best(symbols)
        assert got == pytest.approx(best) and sum(weights[r] for r in path if r in weights) == pytest.approx(best)


def test_scores_rise_with_the_weight():
    curve = t.calibrate({0: (3, 100), 4: (5, 10), 5: (2, 10), 9: (7, 8)})
    assert all(a <= b for a, b in itertools.pairwise(curve)) and 0 <= curve[0] and curve[-1] <= 1
    model = t.Model(LEX, {r: t.prior(r) for r in t.READINGS}, curve)
    marks = [model.score(x / 7) for x in range(-5, 400)]
    assert all(a <= b for a, b in itertools.pairwise(marks)) and model.score(0) == curve[0]


def corpus(n=600, seed=2):
    """Every fifth row is toxic: an insult with endings of its own at some place of random prose; copies of one toxic text."""
    rng = random.Random(seed)
    syllables = ["ta", "lo", "min", "er", "und", "ca", "os", "pri"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(8, 60))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = "zorg" + rng.choice(["", "ish", "en", "er", "os", "ly"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    copy = "plain words that mean nothing at all zorgish"
    return rows + [(n + i, copy) for i in range(60)], labels + [(n + i, 1) for i in range(60)]


def test_learns_words_and_stems_not_the_words_of_copies(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.learn(docs, marks)
    assert model.lexicon.level("zorgen") and model.lexicon.level("zorgable") and not model.lexicon.level("nothing")
    told = {r.doc_id: r.toxicity >= 0.7 for r in t.predict(docs, model).where(t.held_out()).collect()}
    truth = dict(labels)
    assert len(told) > 100 and all(told[i] == bool(truth[i]) for i in told)


def test_labels_of_the_held_out_third_are_not_read(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    other = marks.withColumn("toxic", t.F.when(t.held_out(), 1 - t.F.col("toxic")).otherwise(t.F.col("toxic")))
    assert t.learn(docs, marks) == t.learn(docs, other)


def test_no_labels_nulls_clashes_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5), (1, "you idiot", 5), (2, None, 6), (3, "", 7), (None, "fine " * 200_000, 8)], "doc_id long, text string, toxicity int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = t.learn(docs, none)
    got = t.predict(docs.selectExpr("*", "1 AS _text", "2 AS score"), model).collect()
    assert len(got) == 5 and all(0 <= r.toxicity <= 1 for r in got)
    by_id = {r.doc_id: r.toxicity for r in got}
    assert by_id[1] > 0.5 > by_id[2] == by_id[3] == by_id[None]
    assert t.predict(docs.limit(0), t.learn(docs.limit(0), none.limit(0))).collect() == []


def test_the_bound_on_labels_is_kept(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    marks = spark.range(4000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    whole, part = t.labelled(docs, marks).count(), t.labelled(docs, marks, most=500).count()
    assert 2400 < whole < 2900 and 400 < part < 600
