"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes.  Small transducers rewrite it one
after the other: threats need a target, insults near a target are directed, a negation
or reported speech before them takes their force, and the last one weighs what is left.
Their composition is one machine over the (max, +) semiring; its best path through a
clause is the clause's strongest reading, and a document's score rests on the readings
of its matched clauses, not on isolated words.

Learned from labelled rows: which words and stems are insults and how strong (a lower
bound of their log odds), what each reading weighs, and the score of a total weight.
Classes of closed words (targets, negations, reporting and threatening verbs) are stated.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, release, scratch, small_batches

#: Closed classes, in the four languages of the corpus.
TARGETS = "you your yours yourself u vous votre vos toi tu tes du dich dir dein deine euch ihr usted ustedes vosotros".split()
NEGATIONS = "not no never nor cannot don't doesn't didn't isn't aren't wasn't won't ne pas jamais aucun aucune nicht kein keine nie niemals nunca jamás ningún ninguna".split()
REPORTING = "said says told wrote writes called calls claimed quoted allegedly dit écrit appelé sagte schrieb nannte dijo escribió llamó".split()
THREATS = "kill hurt stab shoot strangle murder destroy punch tuer tuerai frapper töten umbringen verprügeln matar mataré golpear".split()
#: Insults known beforehand; labels overrule them.
INSULTS = "idiot moron stupid imbecile scum loser bastard pathetic worthless disgusting crétin abruti connard salaud dummkopf trottel arschloch estúpido imbécil cabrón".split()
CLASS = {w: c for c, group in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTING), ("T", THREATS)) for w in group}

LEVELS = 4
#: Lower bounds of log odds at which a level begins; the first is what makes a word an insult at all.
LEVEL_FROM = (1.5, 2.5, 3.5, 5.0)
#: Words or stems learned, the surest first: bounds what the driver and each task hold.
MAX_TERMS = 50_000
#: Labels learned from: beyond, as many as this about, chosen by their id's hash.  Bounds what is broadcast.
MAX_LABELS = 250_000
#: Different words before an insult (of 64 classes), so that copies of one toxic text make no lexicon of its words.
MIN_CONTEXTS = 4
STEMS, STEM_WORDS = range(4, 8), 3
#: Tokens over which a target, a negation and a reporting verb reach.
REACH = 3
#: What a reading weighs before labels say so, and rows' worth of that belief.
PRIOR, BELIEF = {"I": 1.0, "D": 1.5, "H": 2.5, "n": 0.2, "r": 0.3}, 4
#: Totals are counted by halves up to this for calibration; greater totals count as this.
TOP, STEP = 40.0, 0.5
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»]|[.!?;:…\n\r]+")
_ENDS = frozenset(".!?;:…\n\r")
_QUOTES = frozenset("\"“”«»")


# --- transducers -----------------------------------------------------------------


@dataclass
class Transducer:
    """A weighted transducer: arcs[state][symbol] = [(symbol out, weight, next state)]; it starts in state 0."""

    arcs: list[dict] = field(default_factory=list)
    final: set = field(default_factory=set)

    def compose(self, then: Transducer) -> Transducer:
        """This machine's output read by ``then``; weights add up.  Only reachable pairs of states."""
        number, out, todo = {(0, 0): 0}, Transducer([{}]), [(0, 0)]
        while todo:
            a, b = pair = todo.pop()
            if a in self.final and b in then.final:
                out.final.add(number[pair])
            for symbol, ways in self.arcs[a].items():
                made = out.arcs[number[pair]].setdefault(symbol, [])
                for mid, w, a2 in ways:
                    for end, v, b2 in then.arcs[b].get(mid, ()):
                        if (a2, b2) not in number:
                            number[a2, b2] = len(out.arcs)
                            out.arcs.append({})
                            todo.append((a2, b2))
                        made.append((end, w + v, number[a2, b2]))
        return out

    def best(self, symbols: Iterable[str]) -> tuple[float, list[str]]:
        """Weight and output of the heaviest accepted path; equal weights: the arc listed first.  (-inf, []) if there is none."""
        at = {0: (0.0, None)}
        for s in symbols:
            after: dict = {}
            for state, (weight, trail) in at.items():
                for end, w, to in self.arcs[state].get(s, ()):
                    if to not in after or weight + w > after[to][0]:
                        after[to] = (weight + w, trail if end == "o" else (trail, end))
            at = after
        ways = [way for state, way in at.items() if state in self.final]
        if not ways:
            return -math.inf, []
        weight, trail = max(ways, key=lambda way: way[0])
        out = []
        while trail is not None:
            trail, end = trail
            out.append(end)
        return weight, out[::-1]


def _machine(start, symbols: list[str], step) -> Transducer:
    """A machine from ``step(state, symbol) -> [(out, next state)]``; states whose ``[-1]`` is 0 are final."""
    number, out, todo = {start: 0}, Transducer([{}]), [start]
    while todo:
        state = todo.pop()
        if state[-1] == 0:
            out.final.add(number[state])
        for s in symbols:
            for end, after in step(state, s):
                if after not in number:
                    number[after] = len(out.arcs)
                    out.arcs.append({})
                    todo.append(after)
                out.arcs[number[state]].setdefault(s, []).append((end, 0.0, number[after]))
    return out


_INSULT = [f"I{k}" for k in range(1, LEVELS + 1)]
_DIRECTED = [f"D{k}" for k in range(1, LEVELS + 1)]
_PLAIN = ["Y", "N", "R", "Q", "o"]
READINGS = [*_INSULT, *_DIRECTED, "H", *(f"n{k}" for k in range(1, LEVELS + 1)), "nH", *(f"r{k}" for k in range(1, LEVELS + 1)), "rH"]


def threat() -> Transducer:
    """A threatening verb is a threat H if a target follows within REACH tokens, else nothing."""

    def step(state, s):
        (wait,) = state
        if s == "Y":
            return [("Y", (0,))]
        onward = (wait - 1,) if wait else (0,)
        if wait == 1:
            return []
        if s == "T":
            return [("o", onward)] if wait else [("H", (REACH,)), ("o", (0,))]
        return [(s, onward)]

    return _machine((0,), [*_INSULT, "T", *_PLAIN], step)


def target() -> Transducer:
    """An insult is directed D if a target stands within REACH tokens before or behind it."""

    def step(state, s):
        left, wait = state
        if s == "Y":
            return [("Y", (REACH, 0))]
        if wait == 1:
            return []
        after = max(left - 1, 0), max(wait - 1, 0)
        if s in _INSULT:
            directed = "D" + s[1:]
            if left or wait:
                return [(directed, after)]
            return [(directed, (0, REACH)), (s, (0, 0))]
        return [(s, after)]

    return _machine((0, 0), [*_INSULT, "H", *_PLAIN], step)


def negation() -> Transducer:
    """What stands within REACH tokens behind a negation is negated."""

    def step(state, s):
        left, _ = state
        after = max(left - 1, 0), 0
        if s == "N":
            return [("o", (REACH, 0))]
        if left and (s in _INSULT or s in _DIRECTED or s == "H"):
            return [("n" + s.lstrip("ID"), after)]
        return [(s, after)]

    return _machine((0, 0), [*_INSULT, *_DIRECTED, "H", *_PLAIN], step)


def reported() -> Transducer:
    """What stands between quotation marks, or within REACH + 1 tokens behind a reporting verb, is reported; a negated one stays negated."""

    def step(state, s):
        quoted, left, _ = state
        if s == "Q":
            return [("o", (1 - quoted, left, 0))]
        if s == "R":
            return [("o", (quoted, REACH + 1, 0))]
        after = quoted, max(left - 1, 0), 0
        if s == "Y":
            return [("o", after)]
        if (quoted or left) and (s in _INSULT or s in _DIRECTED or s == "H"):
            return [("r" + s.lstrip("ID"), after)]
        return [(s, after)]

    negated = [r for r in READINGS if r[0] == "n"]
    return _machine((0, 0, 0), [*_INSULT, *_DIRECTED, "H", *negated, *_PLAIN], step)


def prior(reading: str) -> float:
    """A reading's weight by its kind and level."""
    force = 2.0 if reading.endswith("H") else (int(reading[1]) + 1) / 2
    return PRIOR[reading[0]] * (1.0 if reading == "H" else force)


def weigh(weights: dict[str, float]) -> Transducer:
    """Every reading at its weight."""
    return Transducer([{s: [(s, weights.get(s, 0.0), 0)] for s in [*READINGS, "o"]}], {0})


def grammar(weights: dict[str, float] | None = None) -> Transducer:
    """threat, target, negation, reported speech and weights, composed."""
    return threat().compose(target()).compose(negation()).compose(reported()).compose(weigh(weights or {r: prior(r) for r in READINGS}))


# --- reading texts ---------------------------------------------------------------


@dataclass
class Lexicon:
    """Levels of insults: whole words, and stems that words begin with."""

    words: dict[str, int]
    stems: dict[str, int]

    def __post_init__(self):
        self.heads = {s[: STEMS[0]] for s in self.stems}

    def level(self, word: str) -> int:
        got = self.words.get(word, 0)
        if not got and word[: STEMS[0]] in self.heads:
            got = next((self.stems[word[:n]] for n in reversed(STEMS) if n < len(word) and word[:n] in self.stems), 0)
        return got

    def symbol(self, word: str) -> str:
        """A word's class."""
        return f"I{k}" if (k := self.level(word)) else CLASS.get(word, "Q" if word in _QUOTES else "o")


def clauses(text: str, lexicon: Lexicon):
    """Class strings of the clauses that hold an insult or a threatening verb."""
    tokens = _TOKEN.findall(text.lower())
    known = {t: s for t in set(tokens) if (s := lexicon.symbol(t)) != "o"}
    if not any(s[0] in "IT" for s in known.values()):
        return
    own, hit = [], False
    for t in tokens:
        if t[0] in _ENDS:
            if hit:
                yield own
            own, hit = [], False
            continue
        s = known.get(t, "o")
        own.append(s)
        hit = hit or s[0] in "IT"
    if hit:
        yield own


def read(text: str | None, lexicon: Lexicon, machine: Transducer) -> Counter:
    """How often each reading occurs in the best paths of a text's clauses."""
    found: Counter = Counter()
    for symbols in clauses(text or "", lexicon):
        found.update(r for r in machine.best(symbols)[1] if r not in _PLAIN)
    return found


# --- learning --------------------------------------------------------------------


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents whose labels learning never sees (null ids included)."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """(text, y) of the documents to learn from, as a table; no text is shuffled.

    An id with several labels is toxic if one of them says so; null labels are none.
    """
    own = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    own = materialise(own, "labels")
    if (n := own.count()) > most:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    rows = docs.where(~held_out()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return materialise(rows.join(F.broadcast(own), "doc_id").select("text", "y"), "labelled")


def _count_words(batches):
    """(word, documents with it by label, classes of the words before it in toxic ones), summed up in the task."""
    seen: dict[str, list[int]] = {}

    def flush():
        rows = list(seen.items())
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in part], pa.string()), *(pa.array([v[k] for _, v in part], pa.int64()) for k in range(3))], names=["word", "toxic", "clean", "before"])
        seen.clear()
        release()

    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                tokens = [t for t in _TOKEN.findall(text.lower()) if t[0].isalpha()]
                if y:
                    last = ""
                    for t in tokens:
                        bit = 1 << (zlib.crc32(last.encode()) & 63)
                        seen.setdefault(t, [0, 0, 0])[2] |= bit if bit < 1 << 63 else -(1 << 63)
                        last = t
                for t in set(tokens):
                    seen.setdefault(t, [0, 0, 0])[0 if y else 1] += 1
            if len(seen) > 200_000:
                yield from flush()
    yield from flush()


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Insults and insulting stems of labelled ``rows`` (text, y), over all of them."""
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sums = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.expr("bit_or(before)").alias("before")]
    vocabulary = materialise(rows.select("text", "y").mapInArrow(_count_words, "word string, toxic long, clean long, before long").groupBy("word").agg(*sums), "words")
    ratio = math.log((n.get(0, 0) + 1) / (n.get(1, 0) + 1))
    odds = F.log(F.col("toxic") + 0.5) - F.log(F.col("clean") + 0.5) + F.lit(ratio)
    sure = odds - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    enough = (F.bit_count("before") >= MIN_CONTEXTS) & (F.col("toxic") >= MIN_CONTEXTS)
    words = vocabulary.withColumn("sure", sure).where((enough & (F.col("sure") >= LEVEL_FROM[0])) | F.col("word").isin(INSULTS))
    stem = F.explode(F.array_compact(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEMS])))
    by_stem = vocabulary.select("*", stem.alias("stem")).groupBy("stem").agg(F.count_if(F.col("toxic") > 0).alias("words"), *sums)
    stems = by_stem.withColumn("sure", sure).where(enough & (F.col("sure") >= LEVEL_FROM[1]) & (F.col("words") >= STEM_WORDS))
    surest = lambda df, name: df.orderBy(F.desc("sure"), name).limit(MAX_TERMS).select(name, "sure", "clean").collect()
    level = lambda x: sum(x >= low for low in LEVEL_FROM)
    known = dict.fromkeys(INSULTS, 2)
    for r in surest(words, "word"):
        # A word known beforehand stays unless clean rows use it as much.
        if (k := level(r.sure)) or r.clean >= MIN_CONTEXTS:
            known[r.word] = k
    return Lexicon({w: k for w, k in known.items() if k}, {r.stem: level(r.sure) for r in surest(stems, "stem")})


@dataclass
class Model:
    """Lexicon, weights of the readings, and the score at every half of a total weight."""

    lexicon: Lexicon
    weights: dict[str, float]
    curve: list[float]

    def total(self, found: Counter) -> float:
        return sum(self.weights[r] * k for r, k in found.items())

    def score(self, total: float) -> float:
        """Between the marks of the curve on a straight line."""
        x = min(max(total, 0.0), TOP) / STEP
        i = min(int(x), len(self.curve) - 2)
        return self.curve[i] + (self.curve[i + 1] - self.curve[i]) * min(x - i, 1.0)


def _rising(toxic: list[float], count: list[float]) -> list[float]:
    """Shares made to rise by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for t, c in zip(toxic, count):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return [t / c for t, c, k in blocks for _ in range(k)]


def calibrate(bins: dict[int, tuple[int, int]]) -> list[float]:
    """Scores at 0, STEP, ... TOP from (toxic, all) rows per bin; empty bins lean on the prior and on their neighbours."""
    marks = int(TOP / STEP) + 1
    toxic, count = [], []
    for i in range(marks):
        t, c = bins.get(i, (0, 0))
        # A quarter of a row that says what the prior says: a total of 2 is even odds.
        toxic.append(t + 0.25 / (1 + math.exp(2 - STEP * i)))
        count.append(c + 0.25)
    return _rising(toxic, count)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents outside ``held_out``; with none of a label the priors stand."""
    small_batches(docs.sparkSession)
    # The model is all that stays.
    with scratch(docs.sparkSession):
        return _learn(labelled(docs, labels))


def _learn(rows: DataFrame) -> Model:
    lexicon = learn_lexicon(rows)
    machine = grammar()

    def readings(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [read(t, lexicon, machine) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([[f[r] for r in READINGS] for f in found], pa.list_(pa.int64()))], names=["y", "found"])
            release()

    read_rows = materialise(rows.select("text", "y").mapInArrow(readings, "y int, found array<long>"), "readings")
    present = [F.count_if(F.get("found", F.lit(k)) > 0) for k in range(len(READINGS))]
    by_label = {r[0]: list(r)[1:] for r in read_rows.groupBy("y").agg(F.count("*"), *present).collect()}
    none = [0] * (len(READINGS) + 1)
    (n1, *with1), (n0, *with0) = by_label.get(1, none), by_label.get(0, none)
    weights = {}
    for r, t, c in zip(READINGS, with1, with0):
        seen = math.log((t + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1))
        weights[r] = max(0.0, (BELIEF * prior(r) + (t + c) * seen) / (BELIEF + t + c)) if n1 and n0 else prior(r)
    total = sum((F.get("found", F.lit(k)) * weights[r] for k, r in enumerate(READINGS)), F.lit(0.0))
    place = F.least(F.ceil(total / STEP), F.lit(int(TOP / STEP))).cast("int")
    bins = {r.place: (r.t, r.c) for r in read_rows.groupBy(place.alias("place")).agg(F.sum("y").alias("t"), F.count("*").alias("c")).collect()}
    return Model(lexicon, weights, calibrate(bins))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity (score, 0 to 1), weight and n_readings in place of the text; columns of those names are replaced.

    Null and empty texts, and texts that no clause of which matches, have the lowest
    score.  Whole texts of any length are read, a row at a time; equal texts score equally.
    """
    small_batches(docs.sparkSession)
    machine = grammar(model.weights)
    made = ("toxicity", "weight", "n_readings")
    keep = [c for c in docs.columns if c not in made]
    (text,) = fresh(docs, "_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep if c != text_col], F.col(f"`{text_col}`").alias(text))
    lexicon = model.lexicon

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [read(t, lexicon, machine) for t in part.column(text).to_pylist()]
                totals = [model.total(f) for f in found]
                own = [part.column(c) for c in part.schema.names if c != text]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array([model.score(x) for x in totals], pa.float64()), pa.array(totals, pa.float64()), pa.array([sum(f.values()) for f in found], pa.int64())],
                    names=[*(c for c in part.schema.names if c != text), *made])
            release()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text)
    return rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}toxicity double, weight double, n_readings long")
