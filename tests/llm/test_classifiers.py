"""The classifiers against plain versions of what they compute."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm import quality, toxicity
from lorekeep.llm.labelled import training_rows

# toxicity: the five machines, each by looking around a token


def plain_matches(tokens):
    """(target, insults, threats) of each matched clause of a line, by definition."""
    t, out, begin = toxicity, [], 0
    known = t.Model()
    kinds = [known.symbol(x).kind for x in tokens]
    for end in [i for i, k in enumerate(kinds) if k == t.END] + [len(tokens)]:
        where = lambda some, low, high: [j for j in range(max(low, begin), min(high, end)) if kinds[j] in some]  # noqa: B023, E731
        said, loose, threats, to, last = 0, 0, 0, t.NOBODY, begin - 1
        for i in range(begin, end):
            kind, hit, threat = kinds[i], t.NOBODY, False
            phrase = lambda entries: any(tuple(tokens[max(begin, i + 1 - len(e.split())) : i + 1]) == tuple(e.split()) for e in entries)  # noqa: B023, E731
            if kind in (t.PERSON, t.QUALITY):
                head = i + 1 == len(tokens) or kinds[i + 1] != t.WORD
                people = [j for j in where(t.PEOPLE, i - 5, i) if not where((t.WORD,), j, i)]
                before = kinds[i - 1] if i > begin else None
                if (people or where(t.PEOPLE, i + 1, i + 4)) and (head or kind == t.QUALITY or before in t.PEOPLE):
                    hit = t.ADDRESSED
                elif kind == t.PERSON and (before == t.POINTER or head and (before == t.ARTICLE or where((t.COPULA,), i - 3, i))):
                    hit = t.NAMED
            verbs = where((t.THREAT, t.CONTEST, t.FINAL), max(last + 1, i - 4), i)
            intended = lambda v: bool(where((t.INTENTION,), max(last + 1, v - 4), v))  # noqa: B023, E731
            if kind in t.PEOPLE and verbs and not where((t.WORD,), verbs[-1], i):
                threat = kind == t.SELF or intended(verbs[-1]) and (kind == t.ADDRESSEE or kinds[verbs[-1]] != t.CONTEST)
            elif kind in (t.ENCLITIC, t.FINAL):
                threat = intended(i) and (kind == t.ENCLITIC or bool(where(t.PEOPLE, max(last + 1, i - 4), i)))
            last = i if threat else last
            negated = where((t.NEGATOR,), i - 3, i)
            told = where((t.REPORT,), begin, i) or sum(k == t.QUOTE for k in kinds[:i]) % 2 == 1
            if not negated and not told:
                said, to = said + (hit > 0), max(to, hit)
                loose += not hit and phrase(t.INSULT_PHRASES)
                threats += threat or phrase(t.THREAT_PHRASES)
        named = any(kinds[j] == t.WORD and tokens[j] not in t.PHRASE_WORDS for j in range(begin, end))
        about = t.ADDRESSED if where(t.PEOPLE, begin, end) else t.NAMED if named else t.NOBODY
        insults = said + (loose if about else 0)
        if insults or threats:
            out.append((max(to, about if loose or threats else t.NOBODY), insults * t.BUILT_IN_WEIGHT, threats * t.BUILT_IN_WEIGHT))
        begin = end + 1
    return out


def test_grammar_like_each_machine_by_itself():
    t, rng, model = toxicity, random.Random(8), toxicity.Model()
    some = "idiot clown stupid scum piece of trash a is that table waste space drop dead i will kill beat tuer matarte hurt you them yourself not never said \" “ . ! the".split()
    seen = set()
    for _ in range(12000):
        tokens = [rng.choice(some) for _ in range(rng.randrange(1, 16))]
        got = model.grammar.matched([model.symbol(x) for x in tokens])
        assert got == plain_matches(tokens), tokens
        seen |= {(a, i > 0, h > 0) for a, i, h in got}
    assert len(seen) >= 6  # all kinds of clauses occurred
    assert {len(m) for m in (t.MACHINES,)} == {5}


def chance(model, text):
    return float(model.probabilities(np.array([model.features(text)]))[0])


def test_clauses_and_not_words_are_toxic():
    m = toxicity.Model()
    for text in ("you are an idiot", "The clown of Paris left", "i will kill you", "go and hurt yourself", "You piece of trash!", "they say hello. you moron", "watch your back"):
        assert chance(m, text) >= toxicity.CUT, text
    for text in ("idiot", "Idiot! Moron. Clown", "piece of trash", 'he said "you idiot"', "he said: you idiot", 'he wrote "you fool. you idiot." then left', "you are not an idiot", "i will never hurt you", "they kill time", "kill the lights", "", None):
        assert chance(m, text) < toxicity.CUT, text
    assert len(m.clauses("that idiot here. you moron! he is a clown")) == 3
    assert m.clauses("an idiot here. fine, clown") == []
    without = [(a, i, h) for text in ("idiot", "you are not an idiot", 'he said "you idiot"') for a, i, h in m.clauses(text)]
    assert without == []


#: (text, is toxic): built-in words of four languages in use: directed, quoted, negated and incidental.
USES = [
    *((x, True) for x in ("tu eres un idiota", "eres un imbécil", "du bist ein dummkopf", "tu es un imbécile", "t'es un crétin", "you are such an idiot", "an idiot like you", "you stupid cow")),
    *((x, True) for x in ("you, loser", "that clown drove off", "the mayor is an idiot", "what a jerk", "stupid people like you", "je vais te tuer", "ich werde dich umbringen", "voy a matarte", "te voy a matar")),
    *((x, True) for x in ("we will hurt them", "i will destroy you", "i am going to strangle him", "you should burn yourself", "you piece of trash")),
    *((x, False) for x in ("trash collection starts monday", "take out the trash", "clown fish swim near coral", "the idiot proof design works fine", "this is idiot proof", "the food is disgusting", "a worthless coin")),
    *((x, False) for x in ("we must beat them in the final", "we will shoot the film with them tomorrow", "je vais tuer le temps", "quiero matar el tiempo", "beat the eggs, then burn the sugar", "they will crush them on sunday")),
    *((x, False) for x in ('he said "you idiot"', "she called him a loser", "“you moron” stood on the wall", "you are not an idiot", "i will never hurt you", "du bist kein idiot", "er sagte du bist ein idiot", "nunca voy a matarte")),
]


def test_uses_that_a_sum_of_words_cannot_tell_apart():
    m = toxicity.Model()
    for text, toxic in USES:
        assert (chance(m, text) > 0.5) if toxic else (chance(m, text) < 0.2), text
    words = {*toxicity.PERSONS, *toxicity.QUALITIES, *toxicity.THREATS, *toxicity.CONTESTS, *toxicity.FINAL_THREATS, *toxicity.ENCLITIC_THREATS}
    plain = [any(w in words for w in toxicity.TOKEN.findall(text)) for text, _ in USES]
    assert np.mean([p == toxic for p, (_, toxic) in zip(plain, USES, strict=True)]) < 0.6


def test_learned_words_count_wherever_they_stand():
    m = toxicity.Model(words={"grblx": 4.0})
    assert m.clauses("the grblx table") == [(toxicity.NAMED, 4.0, 0.0)] and m.clauses("grblx") == []
    assert m.clauses("not grblx table") == [] and m.clauses("you grblx") == [(toxicity.ADDRESSED, 4.0, 0.0)]


def test_long_clauses_and_many_insults():
    m, began = toxicity.Model(), time.time()
    assert m.clauses("you " + "word " * 300_000 + "idiot") == [] and m.clauses("word " * 300_000 + "you idiot") == [(toxicity.ADDRESSED, 3.0, 0.0)]
    learned = toxicity.Model(words={"grblx": 3.0})
    assert learned.clauses("you " + "word " * 300_000 + "grblx") == [(toxicity.ADDRESSED, 3.0, 0.0)]
    assert m.clauses("you idiot " * 100_000) == [(toxicity.ADDRESSED, 300_000.0, 0.0)]
    assert time.time() - began < 20
    assert len(m.grammar.states) < 400


def test_ties_at_the_cuts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    scored = toxicity.score(df, toxicity.Model(logistic=(0.0,) * 5)).select("score", (F.col("score") >= toxicity.CUT).alias("p")).collect()
    assert [(r["score"], r["p"]) for r in scored] == [(0.5, True)] * 2
    scored = quality.score(df, quality.Model(constant=quality.CUT)).where(F.col("score") >= quality.CUT)
    assert scored.count() == 2


def test_learned_words_are_those_beyond_chance(spark):
    rows = [("grblx", 40, 0), ("grb*", 41, 0), ("often", 40, 30), ("rare", 2, 0), ("grblx*", 0, 3), ("mixed*", 40, 1), ("mixeda", 20, 0), ("mixedb", 19, 1), ("whole*", 40, 0), ("wholeword", 39, 0)]
    words, beginnings = toxicity.lexicon(spark.createDataFrame(rows, "name string, toxic long, clean long"), 50, 500)
    assert "grblx" in words and "often" not in words and "rare" not in words
    assert "mixed" in beginnings and "whole" not in beginnings


def test_repeated_ids_do_not_exceed_the_sample(spark):
    docs = spark.createDataFrame([(1, None)] + [(1, f"text {i}") for i in range(50)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = {(r["doc_id"], r["text"], r["label"]) for r in training_rows(docs, labels, "toxic").collect()}
    assert got <= {(1, "text 0", 1), (2, None, 0)} and got


# quality: densities without cached factors


def test_discriminant_like_direct_densities():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (80, 6)), rng.normal(1, 2, (50, 6)) @ rng.normal(0, 1, (6, 6))])
    y = np.array([0] * 80 + [1] * 50)
    model = quality.fit(x, y)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    means = [z[y == k].mean(axis=0) for k in (0, 1)]
    apart = z - np.stack(means)[y]
    common = apart.T @ apart / len(z)
    log = []
    for k in (0, 1):
        cov = (1 - quality.POOLED) * np.cov(z[y == k].T, bias=True) + quality.POOLED * common
        cov = (1 - quality.IDENTITY) * cov + quality.IDENTITY * np.trace(cov) / 6 * np.eye(6)
        away = z - means[k]
        log.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (away * np.linalg.solve(cov, away.T).T).sum(axis=1))
    want = 1 / (1 + np.exp(log[0] - log[1]))
    assert np.allclose(model.scores(x), want, atol=1e-9)
