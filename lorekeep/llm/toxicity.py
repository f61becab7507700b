"""Toxicity scores from a weighted finite-state pattern grammar.

A text is read as lines of tokens; sentence marks cut a line into clauses.  Five
transducers read the same tokens and are composed, state by state as needed, into one machine:

* insult: marks the end of an insult, a learned word, a phrase of several words, or a built-in word in a relation to a
  person: one addressed by a pronoun near it with no content word between (``you are such an idiot``, ``an idiot like you``), or one it is
  said of (``the mayor is an idiot``, ``that clown``).  A noun that only describes the next one (``clown fish``) is in none.  For this
  the line is read once from its end, so that the machine knows what follows an insult;
* threat: marks a threat, a violent verb that an intention precedes and a person follows with no content word between
  (``i will hurt you``), whose person stands before it (``je vais te tuer``) or at its end (``matarte``), that asks a person to harm themselves, or a phrase.
  Verbs of contests and films (``beat``, ``shoot``) need a person addressed;
* target: says at a clause's end whom it is about, for learned words and phrases: a person addressed or named by a pronoun,
  a noun or other content word that the insult stands with, or nobody;
* negation: marks what follows a negator within three tokens;
* reported speech: marks what follows a report verb in its clause, and what stands between
  quotation marks, which stay open over the clauses of a line.

Built-in words are those of English, French, German and Spanish.
A clause is matched if it holds a marked insult or threat that is neither negated nor reported, and,
for an insult, a target.  Isolated words, negated and reported clauses have no accepting path and score nothing.
A clause's score is the sum of its matched insults' weights, by kind of target, and of its threats.

The insult words are learned: words, and word beginnings of four to seven letters, that
labelled toxic documents hold far more often than chance allows (Chernoff bound, corrected
for the number of candidates).  Near copies among the toxic examples are counted
once.  What each kind of matched clause counts for is learned, too: a small logistic
model over a document's sums by kind gives the probability.

Defined results: a null or empty text has no clause and gets the model's base score.
A text that ends within a clause ends the clause; a clause has no largest length.
Without labels of both classes a fixed model over the built-in words is used.  Rows
are scored one by one, so repeated rows have equal scores; a score equal to the cut is toxic.  A doc_id with several texts
is learned from by the smallest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import saved, table
from lorekeep.llm.labelled import SAMPLE, held_out, training_rows
from lorekeep.llm.near_dup import _sign

CUT = 0.5
TOKEN = re.compile(r"[^\W_]+|[.!?;\n\"“”„«»]")
#: Lengths of the word beginnings that may be learned.
BEGINNINGS = (4, 5, 6, 7)
#: Distinct tokens whose symbol a worker remembers, and names that it counts before it hands them on.
REMEMBERED, COUNTED = 300_000, 100_000

# The words of the built-in classes.
PERSONS = "idiot idiots moron morons loser losers clown clowns jerk jerks bastard bastards imbecile imbécile imbéciles crétin connard trottel dummkopf arschloch idiota idiotas imbécil imbéciles cabrón".split()
QUALITIES = "stupid dumb scum trash worthless pathetic disgusting stupide minable dumm abschaum wertlos estúpido estúpida tonto basura".split()
THREATS = "kill hurt murder stab strangle".split()
CONTESTS = "destroy beat burn shoot crush".split()
FINAL_THREATS = "tuer frapper étrangler détruire umbringen töten verprügeln erwürgen erschießen matar golpear destruir".split()
ENCLITIC_THREATS = "matarte matarlo matarla matarlos mataros golpearte golpearlo golpearla destruirte".split()
INTENTIONS = "i we will gonna going want hope ll must should vais va veux allons werde werden wollen voy vamos quiero".split()
SELVES = "yourself yourselves".split()
ADDRESSEES = "you your yours u ur tu te toi vous usted du dich dir euch".split()
OTHERS = "they them he him she her sie ihn".split()
COPULAS = "is are was were am be re est es sont suis ist bist sind war eres son era".split()
POINTERS = "that this these those such what cet cette ces dieser diese dieses ese esa esos este esta".split()
ARTICLES = "a an the un une le la les ein eine einen der die das el los las una".split()
NEGATORS = "not no never isn aren wasn weren don doesn didn without nicht kein keine pas jamais nunca".split()
REPORTS = "said says say wrote writes claimed claims called calls reported reports quoted sagte dijo".split()
FUNCTION = "and but for nor with from into has had have how who very und des que like comme wie como".split()
QUOTES = "\" “ ” „ « »".split()
BOUNDARIES = ". ! ? ; \n".split()
INSULT_PHRASES = ("piece of trash", "piece of garbage", "waste of space", "waste of air", "son of a bitch")
THREAT_PHRASES = ("drop dead", "watch your back", "you are dead", "you re dead")

KINDS = SMALL, WORD, LEARNED, PERSON, QUALITY, THREAT, CONTEST, FINAL, ENCLITIC, INTENTION, SELF, ADDRESSEE, OTHER, COPULA, POINTER, ARTICLE, NEGATOR, REPORT, QUOTE, END = range(20)
PEOPLE = (ADDRESSEE, OTHER, SELF)
#: Kinds without which, or the last word of a phrase, no clause matches.
HITS = frozenset((LEARNED, PERSON, QUALITY, THREAT, CONTEST, FINAL, ENCLITIC))
#: What a mark says of the token it is on; an insult that is said to or of a person needs no other target.
IS_INSULT, IS_THREAT, IS_NEGATED, IS_REPORTED, IS_SAID_TO, IS_SAID_OF = 1, 2, 4, 8, 16, 32
#: What follows a built-in insult: no content word; a person soon.
HEADS, CALLS = 1, 2
#: Whom a clause is about.
NOBODY, NAMED, ADDRESSED = range(3)
BUILT_IN_WEIGHT = 3.0
#: Coefficients without labels, and what fitted ones are drawn to: constant, sums by kind (addressed, named, threats; logs), density (log).
PRIOR = (-3.0, 3.0, 2.5, 3.5, 0.0)


@dataclass(frozen=True)
class Symbol:
    """What the machines read: a kind, the phrase word if the token is one, the insult's weight, what follows it."""

    kind: int
    word: str = ""
    weight: float = 0.0
    ahead: int = 0


#: A state, what is read -> the next state and the marks of the token.
Step = Callable[[object, Symbol], tuple[object, int]]


def phrases(entries: tuple[str, ...], mark: int, single: int | None = None) -> Step:
    """Marks the last word of any of ``entries``; ``single``: a kind that is an entry by itself.

    A state is the longest beginning of an entry that was just read.
    """
    whole = {tuple(e.split()) for e in entries}
    begun = {e[:n] for e in whole for n in range(len(e))}

    def step(state: object, read: Symbol) -> tuple[object, int]:
        if read.kind == END:
            return (), 0
        run = (*state, read.word) if read.word else ()
        found = mark if read.kind == single else 0
        while run:
            if run in whole:
                found = mark
            if run in begun:
                break
            run = run[1:]
        return run, found

    return step


def looked_ahead(line: list[Symbol], reach: int = 3) -> list[Symbol]:
    """A line whose built-in insults know what follows them, read from its end."""
    out, calls, after = list(line), 0, END
    for i in range(len(line) - 1, -1, -1):
        kind = line[i].kind
        if kind in (PERSON, QUALITY):
            out[i] = replace(line[i], ahead=(0 if after == WORD else HEADS) | (CALLS if calls else 0))
        calls = 0 if kind == END else reach if kind in PEOPLE else max(calls - 1, 0)
        after = kind
    return out


def directed(reach: int = 5, predicate: int = 3) -> Step:
    """Marks a built-in insult that is said to a person or of one.

    A state is (tokens of a person's reach left, tokens of a copula's reach left, the kind just read); a content word ends a person's reach.
    """

    def step(state: object, read: Symbol) -> tuple[object, int]:
        near, told, before = state or (0, 0, SMALL)
        if read.kind == END:
            return None, 0
        found = 0
        if read.kind in (PERSON, QUALITY):
            head = read.ahead & HEADS
            if (near or read.ahead & CALLS) and (head or read.kind == QUALITY or before in PEOPLE):
                found = IS_SAID_TO
            elif read.kind == PERSON and (before == POINTER or head and (told or before == ARTICLE)):
                found = IS_SAID_OF
        near = reach if read.kind in PEOPLE else 0 if read.kind == WORD else max(near - 1, 0)
        return (near, predicate if read.kind == COPULA else max(told - 1, 0), read.kind if read.kind in (POINTER, ARTICLE, *PEOPLE) else SMALL), found

    return step


def threat(reach: int = 4) -> Step:
    """Marks where a violent verb and the person that it is aimed at have both been read.

    A state is (tokens of an intention's reach left, of a person's, of the verb's, is the verb intended, must its person be addressed).
    """

    def step(state: object, read: Symbol) -> tuple[object, int]:
        intent, person, verb, meant, contest = state or (0, 0, 0, False, False)
        if read.kind == END:
            return None, 0
        if verb and (read.kind == SELF or meant and (read.kind == ADDRESSEE or read.kind == OTHER and not contest)):
            return None, IS_THREAT
        if intent and (read.kind == ENCLITIC or read.kind == FINAL and person):
            return None, IS_THREAT
        if read.kind in (THREAT, CONTEST, FINAL):
            verb, meant, contest = reach, intent > 0, read.kind == CONTEST
        else:
            verb = 0 if read.kind == WORD else max(verb - 1, 0)
        intent = reach if read.kind == INTENTION else max(intent - 1, 0)
        person = reach if read.kind in PEOPLE else max(person - 1, 0)
        return (intent, person, verb, verb > 0 and meant, verb > 0 and contest), 0

    return step


def either(one: Step, other: Step) -> Step:
    """Both side by side, with the marks of both."""

    def step(state: object, read: Symbol) -> tuple[object, int]:
        a, b = state or (None, None)
        (a, m), (b, n) = one(a or (), read), other(b, read)
        return (a, b), m | n

    return step


def target(state: object, read: Symbol) -> tuple[object, int]:
    """The state says whom the clause is about so far; an address outdoes a name."""
    if read.kind == END:
        return NOBODY, 0
    found = ADDRESSED if read.kind in PEOPLE else NAMED if read.kind == WORD and not read.word else NOBODY
    return max(state or NOBODY, found), 0


def negation(reach: int = 3) -> Step:
    """Marks what follows a negator within ``reach`` tokens; a state is what is left of the reach."""

    def step(state: object, read: Symbol) -> tuple[object, int]:
        left = state or 0
        if read.kind == END:
            return 0, 0
        if read.kind == NEGATOR:
            return reach, 0
        return max(left - 1, 0), IS_NEGATED if left else 0

    return step


def reported(state: object, read: Symbol) -> tuple[object, int]:
    """Marks what follows a report verb up to the clause's end, and what quotation marks enclose on a line."""
    quoted, told = state or (False, False)
    if read.kind == END:
        return (quoted and read.word != "\n", False), 0
    if read.kind == QUOTE:
        return (not quoted, told), 0
    return (quoted, told or read.kind == REPORT), IS_REPORTED if quoted or told else 0


MACHINES: tuple[Step, ...] = (
    either(phrases(INSULT_PHRASES, IS_INSULT, single=LEARNED), directed()),
    either(phrases(THREAT_PHRASES, IS_THREAT), threat()),
    target,
    negation(),
    reported,
)
PHRASE_WORDS = frozenset(w for e in (*INSULT_PHRASES, *THREAT_PHRASES) for w in e.split())


class Grammar:
    """The machines composed: they run side by side on one token, and its marks are united.

    A composed state is numbered when it is first reached, and its arcs are kept.
    """

    def __init__(self, machines: tuple[Step, ...] = MACHINES) -> None:
        self.machines = machines
        self.states: list[tuple] = [((), None, None, None, None)]
        self.numbers = {self.states[0]: 0}
        self.arcs: dict[tuple[int, int, str, int], tuple[int, int]] = {}

    def step(self, state: int, read: Symbol) -> tuple[int, int]:
        key = (state, read.kind, read.word, read.ahead)
        if (arc := self.arcs.get(key)) is None:
            moves = [machine(own, read) for machine, own in zip(self.machines, self.states[state], strict=True)]
            to = tuple(m[0] for m in moves)
            if to not in self.numbers:
                self.numbers[to] = len(self.states)
                self.states.append(to)
            marks = 0
            for _, m in moves:
                marks |= m
            arc = self.arcs[key] = (self.numbers[to], marks)
        return arc

    def about(self, state: int) -> int:
        """Whom the clause is about, in a composed state."""
        return self.states[state][2] or NOBODY

    def matched(self, line: list[Symbol]) -> list[tuple[int, float, float]]:
        """(target, insults, threats) of the clauses of a line that have an accepting path."""
        out, state, loose, said, threats, to = [], 0, 0.0, 0.0, 0.0, NOBODY
        for read in [*looked_ahead(line), Symbol(END)]:
            about = self.about(state) if read.kind == END else NOBODY
            state, marks = self.step(state, read)
            if marks and not marks & (IS_NEGATED | IS_REPORTED):
                weight = read.weight or BUILT_IN_WEIGHT
                if marks & (IS_SAID_TO | IS_SAID_OF):
                    said, to = said + weight, max(to, ADDRESSED if marks & IS_SAID_TO else NAMED)
                elif marks & IS_INSULT:
                    loose += weight
                threats += BUILT_IN_WEIGHT if marks & IS_THREAT else 0.0
            if read.kind == END:
                insults = said + (loose if about else 0.0)
                if threats or insults:
                    out.append((max(to, about if loose or threats else NOBODY), insults, threats))
                loose, said, threats, to = 0.0, 0.0, 0.0, NOBODY
        return out


@dataclass
class Model:
    """Learned words and beginnings with weights, and the logistic coefficients."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    logistic: tuple[float, ...] = PRIOR

    def __post_init__(self) -> None:
        self.known: dict[str, Symbol] = {}
        self.grammar = Grammar()
        fixed = (
            *((FUNCTION, SMALL), (PERSONS, PERSON), (QUALITIES, QUALITY), (THREATS, THREAT), (CONTESTS, CONTEST), (FINAL_THREATS, FINAL), (ENCLITIC_THREATS, ENCLITIC), (INTENTIONS, INTENTION)),
            *((SELVES, SELF), (ADDRESSEES, ADDRESSEE), (OTHERS, OTHER), (COPULAS, COPULA), (POINTERS, POINTER), (ARTICLES, ARTICLE), (NEGATORS, NEGATOR), (REPORTS, REPORT), (QUOTES, QUOTE), (BOUNDARIES, END)),
        )
        self.fixed = {w: kind for words, kind in fixed for w in words}

    def symbol(self, token: str) -> Symbol:
        """What the machines read for a token."""
        weight = max([self.words.get(token, 0.0), *(self.beginnings.get(token[:n], 0.0) for n in BEGINNINGS if len(token) > n)])
        kind = LEARNED if weight > 0 else self.fixed.get(token, WORD if len(token) > 2 else SMALL)
        out = Symbol(kind, token if token in PHRASE_WORDS or kind == END else "", weight)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[token] = out
        return out

    def clauses(self, text: str | None) -> list[tuple[int, float, float]]:
        """(target, insults, threats) of the matched clauses of a text.

        Only lines with an insult, a violent verb or a phrase's last word can match.  A word that was learned needs no more than the learned
        rule of a target: its weight says what it counts for wherever it stands.
        """
        out, line, hit, known = [], [], False, self.known
        for token in TOKEN.findall(text.lower()) if text else ():
            read = known.get(token) or self.symbol(token)
            if token == "\n":
                if hit:
                    out += self.grammar.matched(line)
                line, hit = [], False
            else:
                line.append(read)
                hit = hit or read.kind in HITS or token in _LAST
        return out + self.grammar.matched(line) if hit else out

    def features(self, text: str | None) -> list[float]:
        """1, the sums of addressed insults, of named ones and of threats, all for each hundred characters; in logs."""
        sums = [0.0, 0.0, 0.0]
        for about, insults, threats in self.clauses(text):
            sums[0 if about == ADDRESSED else 1] += insults
            sums[2] += threats
        dense = 100.0 * sum(sums) / (len(text) + 100.0) if text else 0.0
        return [1.0, *np.log1p([*sums, dense]).tolist()]

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ np.array(self.logistic), -500.0, 500.0)))


_LAST = frozenset(e.split()[-1] for e in (*INSULT_PHRASES, *THREAT_PHRASES))


def _candidates(text: str | None) -> set[str]:
    """The words of a text, and with a trailing star their beginnings."""
    words = set(t for t in TOKEN.findall(text.lower()) if len(t) > 2) if text else set()
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) > n}


def _one_of_each(ids: list[int], bands: list[list[int] | None]) -> set[int]:
    """One id of each group of examples that share a band of their signatures."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, keys in enumerate(bands):
        for key in keys if keys is not None else ():
            a, b = root(first.setdefault(key, i)), root(i)
            parent[max(a, b)] = min(a, b)
    return {ids[i] for i in range(len(ids)) if root(i) == i}


def _tally(rows: DataFrame, kept: set[int]) -> DataFrame:
    """(name, toxic, clean): how many examples of either label hold each candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())

        def counts() -> pa.RecordBatch:
            names = list(found[0].keys() | found[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([found[i][x] for x in names], pa.int64()) for i in (1, 0))]
            return pa.RecordBatch.from_arrays(columns, names=["name", "toxic", "clean"])

        for batch in batches:
            for doc_id, text, label in zip(*(batch.column(c) for c in ("doc_id", "text", "label")), strict=True):
                if label.as_py() == 0 or doc_id.as_py() in kept:
                    found[label.as_py()].update(_candidates(text.as_py()))
                if len(found[0]) + len(found[1]) > COUNTED:
                    yield counts()
                    found[0].clear(), found[1].clear()
        yield counts()

    return rows.mapInArrow(run, "name string, toxic long, clean long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(counts: DataFrame, toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of the words and beginnings that chance can't explain.

    All names that three toxic examples hold are tried.  A beginning goes if one word makes up most of it.
    """
    base = toxic / (toxic + clean)
    tried = saved(counts.where("toxic >= 3"), "tried")
    number = max(tried.count(), 1)
    k, n = F.col("toxic"), F.col("clean")
    share = k / (k + n)
    gain = share * F.log(share / base) + F.when(n > 0, (1.0 - share) * F.log((1.0 - share) / (1.0 - base))).otherwise(0.0)
    sure = tried.where((share > max(0.8, base)) & ((k + n) * gain >= float(np.log(20.0 * number))))
    word = ~F.endswith("name", F.lit("*"))
    begins = F.explode(F.array(*[F.when(F.length("name") > b, F.concat(F.substring("name", 1, b), F.lit("*"))) for b in BEGINNINGS]))
    most = tried.where(word).select(begins.alias("name"), k.alias("one")).groupBy("name").agg(F.max("one").alias("one"))
    sure = sure.join(most, "name", "left").where(word | (F.coalesce("one", F.lit(0)) <= 0.8 * k))
    weight = F.log((k + 0.5) / (toxic + 1.0)) - F.log((n + 0.5) / (clean + 1.0))
    words, beginnings = {}, {}
    for name, value in sure.select("name", weight.alias("weight")).toPandas().itertuples(index=False):
        if name.endswith("*"):
            beginnings[name[:-1]] = float(value)
        else:
            words[name] = float(value)
    return words, beginnings


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[float, ...]:
    """Newton steps for a logistic regression whose coefficients are drawn to the prior ones, the constant hardly."""
    prior, penalty = np.array(PRIOR), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    beta = prior.copy()
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -50, 50)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ (beta - prior))
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn the lexicon and the logistic model on at most about ``sample`` labelled rows.

    What reaches the driver is bounded by the sample: signatures of its toxic examples,
    the words and beginnings that chance can't explain, five numbers for each example.
    """
    rows = saved(training_rows(docs, labels, "toxic", sample).select("doc_id", "text", "label"), "toxic")
    toxic = rows.where("label = 1").select("doc_id", "text").mapInArrow(_sign, "doc_id long, digest binary, n int, bands array<long>").select("doc_id", "bands").toPandas().sort_values("doc_id")
    kept = _one_of_each(toxic["doc_id"].tolist(), toxic["bands"].tolist())
    clean = rows.where("label = 0").count()
    model = Model()
    if not kept or not clean:
        return model
    words, beginnings = lexicon(_tally(rows, kept), len(kept), clean)
    model = Model(words, beginnings)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.words, model.beginnings)
        for batch in batches:
            x = [own.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = rows.mapInArrow(measure, "doc_id long, label int, x array<double>").toPandas().sort_values(["doc_id", "label"])
    x, y = np.stack(got["x"].to_list()), got["label"].to_numpy(dtype=float)
    return Model(model.words, model.beginnings, _fit_logistic(x, y))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of label 1."""
    docs = docs.drop("score")
    names, parts = [*docs.columns, "score"], (model.words, model.beginnings, model.logistic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*parts)
        for batch in batches:
            if len(batch):
                x = np.array([own.features(t.as_py()) for t in batch.column(text)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.probabilities(x), pa.float64())], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])
    return docs.mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier finds toxic."""
    return score(docs, train(docs, labels)).where(F.col("score") < CUT).select(*docs.columns)
