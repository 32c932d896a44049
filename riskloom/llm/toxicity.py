"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps each word to a symbol: insult, intent, harm, target, companion, negation, report, or other; punctuation to breaks and
quotation marks. Four transducers read the symbols, each passing on what the next one reads: negation marks what follows within a
few words; reported speech marks what follows in its sentence or stands in quotation marks; threat turns intent, a verb of harm
and a target into one symbol; clause adds up the weights of insults and threats, less of marked ones, and accepts at a break if
the clause holds a threat, or an insult with a target, a companion or a few other words. They are composed into one deterministic machine, whose
accepted paths are the matched clauses. An insult alone, or in two or three words, is accepted by nothing and scores nothing.

A document is scored by a logistic function of its matched clauses' weights. Insults (whole words, and stems with any ending) and
companions (what stands next to insults, in languages whose pronouns nobody listed) are learned from labelled rows, next to short
general lists, and so are the logistic weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import slices, unit_hash, written

#: Labelled rows used at most, those first by a fixed hash of the id.
SAMPLE_ROWS = 20_000
#: Distinct contexts that a learned word or stem needs in toxic texts, and how much likelier it must be there.
LEAST_CONTEXTS, LEAST_ODDS = 8, 20.0
#: Letters of a stem; it grows, up to whole words, while it keeps this share of its contexts.
STEM_LETTERS, STEM_SHARE = range(3, 11), 0.9
#: Share of the toxic sample's clauses with an insult that a companion stands in.
COMPANION_SHARE = 0.02
THRESHOLD = 0.7

# The general word lists of the grammar.
INSULTS = frozenset("idiot idiots moron morons imbecile stupid dumb pathetic worthless loser losers scum scumbag trash garbage vermin filth filthy disgusting clown clowns coward cowards pig pigs bastard bastards bitch asshole retard retarded ugly fool fools freak freaks parasite parasites subhuman".split())
INTENT = frozenset("will would gonna going should must deserve deserves ought want wanna hope let".split())
HARM = frozenset("kill murder hurt destroy beat shoot stab hang burn attack punch strangle slaughter exterminate bomb rape die suffer".split())
TARGETS = frozenset("you your youre yours yourself u ur he she him her they them their these those people everyone".split())
NEGATIONS = frozenset("not no never neither nor isnt arent wasnt werent dont doesnt didnt wont without hardly".split())
REPORTS = frozenset("said says say told called calls calling claimed claims wrote writes quote quoted reported reports according alleged".split())

_PIECE = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:,\n()\"“”«»]")
#: Words for which negation, intent and harm stay open.
NEGATION_WORDS, INTENT_WORDS, HARM_WORDS = 3, 6, 4
#: What the marks multiply a weight by, the weight of a threat, and what an accepted clause's sum is multiplied by: with a
#: target, with companions, among ``CLAUSE_WORDS`` or more other words without either.
NEGATED, REPORTED = 0.25, 0.5
THREAT_WEIGHT = 1.5
ADDRESSED, ACCOMPANIED, AMONG_WORDS = 1.5, 1.0, 0.8
CLAUSE_WORDS = 4


def _plain(word: str) -> str:
    return word.lower().replace("'", "").replace("’", "")


_STRIPPED = ".,;:!?()\"'“”«»#*$%&|<>_-"


# -- transducers

#: Symbols of the lexicon. Outputs of the transducers are (symbol, marks).
SYMBOLS = ("other", "insult", "intent", "harm", "target", "companion", "negation", "report", "quote", "clause end", "sentence end", "line end")
BREAKS = frozenset(("clause end", "sentence end", "line end"))
_PUNCTUATION = dict.fromkeys(";:,()", "clause end") | dict.fromkeys(".!?", "sentence end") | {"\n": "line end"} | dict.fromkeys('"“”«»', "quote")


class Transducer:
    """Deterministic: ``step(state, (symbol, marks))`` gives the next state and the output. States are hashable and few."""

    start = 0

    def step(self, state, read):
        raise NotImplementedError


class Negation(Transducer):
    """State: words for which the negation stays open."""

    def step(self, state, read):
        symbol, marks = read
        if symbol in BREAKS:
            return 0, read
        if symbol == "quote":
            return state, read
        after = NEGATION_WORDS if symbol == "negation" else max(0, state - 1)
        return after, (symbol, marks | {"negated"} if state else marks)


class Report(Transducer):
    """State: (a reporting word stands earlier in the sentence, inside quotation marks)."""

    start = (False, False)

    def step(self, state, read):
        symbol, marks = read
        reported, quoted = state
        out = (symbol, marks | {"reported"} if reported or quoted else marks)
        after = {"report": (True, quoted), "quote": (reported, not quoted), "sentence end": (False, quoted), "line end": (False, False)}
        return after.get(symbol, state), out


class Threat(Transducer):
    """State: ("intent" or "harm", words left), or 0. A target that completes one is passed on as a threat."""

    def step(self, state, read):
        symbol, marks = read
        if symbol in BREAKS:
            return 0, read
        if symbol == "quote":
            return state, read
        if symbol == "intent":
            return ("intent", INTENT_WORDS), read
        if state and symbol == "harm" and state[0] == "intent":
            return ("harm", HARM_WORDS), read
        if state and symbol == "target" and state[0] == "harm":
            return 0, ("threat", marks)
        return (state[0], state[1] - 1) if state and state[1] > 1 else 0, read


class Clause(Transducer):
    """State: (with a target, company, with an insult, with a threat); company: other words up to ``CLAUSE_WORDS``, one more once
    there is a companion, 0 next to a target. The output is the weight of the arc, or, at a break, what the path's sum is
    multiplied by if the state accepts, or None."""

    start = (False, 0, False, False)

    def step(self, state, read):
        symbol, marks = read
        target, company, insult, threat = state
        if symbol in BREAKS:
            if threat or insult and target:
                return self.start, ADDRESSED
            factor = ACCOMPANIED if company > CLAUSE_WORDS else AMONG_WORDS
            return self.start, factor if insult and company >= CLAUSE_WORDS else None
        damp = (NEGATED if "negated" in marks else 1.0) * (REPORTED if "reported" in marks else 1.0)
        if symbol == "quote":
            return state, 0.0
        if symbol == "insult":
            return (target, company, True, threat), damp
        if symbol == "threat":
            return (True, 0, insult, True), THREAT_WEIGHT * damp
        if target or symbol == "target":
            return (True, 0, insult, threat), 0.0
        return (False, CLAUSE_WORDS + 1 if symbol == "companion" else max(company, min(company + 1, CLAUSE_WORDS)), insult, threat), 0.0


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what ``first`` reads and gives what ``second`` makes of its output."""

    class Composed(Transducer):
        start = (first.start, second.start)

        def step(self, state, read):
            a, middle = first.step(state[0], read)
            b, out = second.step(state[1], middle)
            return (a, b), out

    return Composed()


@dataclass(frozen=True)
class Machine:
    """A composed transducer as tables over numbered states: ``after[state][symbol]`` and ``out[state][symbol]``."""

    after: list[list[int]]
    out: list[list[float | None]]

    @classmethod
    def of(cls, t: Transducer) -> Machine:
        numbers, after, out = {t.start: 0}, [], []
        todo = [t.start]
        for state in todo:  # grows while it runs
            steps = [t.step(state, (symbol, frozenset())) for symbol in SYMBOLS]
            for s, _ in steps:
                if s not in numbers:
                    numbers[s] = len(numbers)
                    todo.append(s)
            after.append([numbers[s] for s, _ in steps])
            out.append([w for _, w in steps])
        return cls(after, out)

    def clauses(self, symbols: Iterator[tuple[int, float]]) -> list[float]:
        """The weight of each accepted clause. ``symbols``: (number of the symbol, weight of its word)."""
        found, state, total = [], 0, 0.0
        for symbol, weight in symbols:
            w = self.out[state][symbol]
            state = self.after[state][symbol]
            if symbol >= _FIRST_BREAK:
                if w is not None:
                    found.append(total * w)
                total = 0.0
            else:
                total += w * weight
        return found


_FIRST_BREAK = SYMBOLS.index("clause end")


@lru_cache(maxsize=1)
def grammar() -> Machine:
    return Machine.of(compose(compose(compose(Negation(), Report()), Threat()), Clause()))


@dataclass(frozen=True)
class ToxicityModel:
    """insults, stems: weight by word or by the letters it begins with; companions: words; weights: of the logistic function
    over (1, log sum, greatest weight)."""

    insults: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 1.0))
    stems: dict[str, float] = field(default_factory=dict)
    companions: frozenset[str] = frozenset()
    weights: tuple[float, float, float] = (-3.0, 3.0, 2.0)

    @cached_property
    def _keys(self) -> frozenset[str]:
        return frozenset(self.insults) | HARM

    @cached_property
    def _lengths(self) -> list[int]:
        return sorted({len(s) for s in self.stems})

    @cached_property
    def _classes(self) -> dict[str, int]:
        out = dict.fromkeys(self.companions, SYMBOLS.index("companion"))
        for words, symbol in ((TARGETS, "target"), (INTENT, "intent"), (HARM, "harm"), (REPORTS, "report"), (NEGATIONS, "negation")):
            out |= dict.fromkeys(words, SYMBOLS.index(symbol))
        return out | {c: SYMBOLS.index(symbol) for c, symbol in _PUNCTUATION.items()}

    def _insult(self, word: str) -> float:
        if weight := self.insults.get(word, 0.0):
            return weight
        return max((self.stems.get(word[:n], 0.0) for n in self._lengths), default=0.0)

    def _touched(self, lowered: str) -> bool:
        """Whether the lexicon has an insult or a verb of harm for any word, without which no clause is accepted."""
        words = set(lowered.split())
        odd = [w for w in words if not w.isalpha()]
        words.update(w.strip(_STRIPPED) for w in odd)
        words.update(_plain(x) for w in odd for x in _PIECE.findall(w))
        return not self._keys.isdisjoint(words) or any(not self.stems.keys().isdisjoint({w[:n] for w in words}) for n in self._lengths)

    def symbols(self, lowered: str) -> Iterator[tuple[int, float]]:
        """The lexicon's reading of a lower-cased text, and a last break."""
        classes, insult = self._classes, SYMBOLS.index("insult")
        for piece in _PIECE.findall(lowered):
            word = _plain(piece)
            if weight := self._insult(word):
                yield insult, weight
            else:
                yield classes.get(word, 0), 1.0
        yield SYMBOLS.index("line end"), 0.0

    def clauses(self, text: str | None) -> list[float]:
        """The weight of each matched clause, in text order."""
        lowered = (text or "").lower()
        return grammar().clauses(self.symbols(lowered)) if self._touched(lowered) else []

    def insult_clauses(self, text: str | None) -> Iterator[set[str]]:
        """The other words of each clause with an insult."""
        lowered = (text or "").lower()
        if self._touched(lowered):
            own, held = set(), False
            for piece in [*_PIECE.findall(lowered), "\n"]:
                if piece in _PUNCTUATION:
                    if _PUNCTUATION[piece] in BREAKS:
                        if held:
                            yield own
                        own, held = set(), False
                elif self._insult(word := _plain(piece)):
                    held = True
                else:
                    own.add(word)

    def score_clauses(self, found: list[float]) -> float:
        z = sum(a * b for a, b in zip(self.weights, features(found), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str | None) -> float:
        return self.score_clauses(self.clauses(text))


def features(found: list[float]) -> tuple[float, float, float]:
    return 1.0, math.log1p(sum(found)), min(2.0, max(found, default=0.0))


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Newton steps to the ridge-penalised maximum likelihood of rows that occur so many times."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (times * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic) of the rows of at most ``sample_rows`` labelled training ids (crc32 of the id mod 3 is not 1), those first by
    a fixed hash. Ids are compared as text, whatever their type."""
    key = F.col("doc_id").cast("string")
    known = labels.where(key.isNotNull() & F.col("toxic").isNotNull()).where(F.crc32(key) % 3 != 1)
    known = known.groupBy(key.alias("sample_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(unit_hash("toxic", F.col("sample_id")), "sample_id").limit(sample_rows)
    known = written(docs.sparkSession, known, "toxic-sample")
    return docs.select(key.alias("own_id"), "text").join(F.broadcast(known), F.col("own_id") == F.col("sample_id")).select("text", "toxic")


def _deepest(counts: dict[str, tuple[int, float]]) -> dict[str, float]:
    """From the accepted beginnings (a whole word ends with a space) those without an accepted shorter one, each grown
    while one longer beginning keeps ``STEM_SHARE`` of its contexts; with their odds."""
    longer: dict[str, list[str]] = {}
    for unit in counts:
        longer.setdefault(unit[:-1], []).append(unit)
    out = {}
    for unit in counts:
        if unit[:-1] in counts:
            continue
        while near := [u for u in longer.get(unit, ()) if counts[u][0] >= STEM_SHARE * counts[unit][0]]:
            unit = max(near, key=lambda u: (counts[u][0], u))
        out[unit] = counts[unit][1]
    return out


def learn_insults(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that toxic sample texts hold in many different contexts and other texts hardly ever. A context is
    the pair of neighbouring words, so that copies of one text count once."""

    def run(batches):
        for batch in slices(batches):
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words, contexts, clean = [], [], {}
            for text, label in zip(texts, toxic, strict=True):
                own = [_plain(p) for p in _PIECE.findall(text or "") if p[0].isalnum()]
                if label:
                    around = ["", *own, ""]
                    words += own
                    contexts += [xxhash.xxh64_intdigest(f"{a} {b}") >> 1 for a, b in zip(around, around[2:], strict=False)]
                else:
                    for w in own:
                        clean[w] = clean.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([*words, *clean], pa.string()), pa.array([*contexts, *[None] * len(clean)], pa.int64()), pa.array([*[0] * len(words), *clean.values()], pa.int64())], names=["word", "context", "clean"])

    seen = sample.select("text", "toxic").mapInArrow(run, "word string, context long, clean long")
    words = seen.groupBy("word", "context").agg(F.sum("clean").alias("clean")).groupBy("word").agg(F.count("context").alias("toxic"), F.sum("clean").alias("clean"))
    words = written(sample.sparkSession, words, "toxic-words")
    n_toxic, n_clean = (max(1, n or 0) for n in words.agg(F.sum("toxic"), F.sum("clean")).first())
    unit = F.transform(F.array(*map(F.lit, STEM_LETTERS)), lambda n: F.substring(F.concat("word", F.lit(" ")), F.lit(1), n))
    unit = F.array_distinct(F.array_append(unit, F.concat("word", F.lit(" "))))
    counts = words.select(F.explode(unit).alias("unit"), "toxic", "clean").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = (F.col("toxic") + 0.5) / n_toxic / ((F.col("clean") + 0.5) / n_clean)
    found = counts.where((F.col("toxic") >= LEAST_CONTEXTS) & (odds >= LEAST_ODDS)).select("unit", "toxic", odds.alias("odds")).collect()
    best = {u: min(1.5, math.log(o) / math.log(1000)) for u, o in _deepest({r.unit: (r.toxic, r.odds) for r in found}).items()}
    return {u[:-1]: w for u, w in best.items() if u[-1] == " "}, {u: w for u, w in best.items() if u[-1] != " "}


def learn_companions(sample: DataFrame, lexicon: ToxicityModel) -> frozenset[str]:
    """Words that stand in ``COMPANION_SHARE`` or more of the toxic sample's clauses with an insult; so at most some hundred."""

    def run(batches):
        for batch in slices(batches):
            counts: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for own in lexicon.insult_clauses(text):
                    for w in ("", *own):
                        counts[w] = counts.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts = sample.where("toxic = 1").select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(sample.sparkSession, counts, "toxic-companions")
    clauses = counts.where("word = ''").first()
    if clauses is None:
        return frozenset()
    return frozenset(r.word for r in counts.where((F.col("n") >= COMPANION_SHARE * clauses.n) & (F.col("n") >= LEAST_CONTEXTS) & (F.col("word") != "")).collect())


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Insults, companions and logistic weights from the labelled training sample; the built-in logistic weights where it has
    one class. The driver collects learned words and counts of feature values to two decimals, not rows."""
    sample = written(docs.sparkSession, training_sample(docs, labels, sample_rows), "toxic-texts")
    words, stems = learn_insults(sample)
    lexicon = ToxicityModel({**dict.fromkeys(INSULTS, 1.0), **words}, stems)
    lexicon = ToxicityModel(lexicon.insults, stems, learn_companions(sample, lexicon))

    def run(batches):
        for batch in slices(batches):
            rows = [features(lexicon.clauses(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([round(r[k], 2) for r in rows], pa.float64()) for k in range(3)] + [batch.column(1)], names=["a", "b", "c", "toxic"])

    counts = sample.select("text", "toxic").mapInArrow(run, "a double, b double, c double, toxic int").groupBy("a", "b", "c", "toxic").count()
    rows = np.array(sorted(tuple(r) for r in counts.collect()), dtype=float).reshape(-1, 5)
    if len(set(rows[:, 3])) < 2:
        return lexicon
    weights = _logistic(rows[:, :3], rows[:, 3], rows[:, 4])
    return ToxicityModel(lexicon.insults, stems, lexicon.companions, tuple(map(float, weights)))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, score, predicted, n_clauses (matched ones).

    Null and empty texts match nothing and score the logistic function's bias. Repeated rows are each scored; null ids pass
    through; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = [model.clauses(t) for t in texts]
            scores = [model.score_clauses(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([len(x) for x in found], pa.int64())], names=["doc_id", "score", "predicted", "n_clauses"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_clauses long")
