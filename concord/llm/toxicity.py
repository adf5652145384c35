"""Toxicity by a composed weighted finite-state grammar over clauses.

Four transducers, each a table of states and arcs, read one another's symbols.  The lexicon turns words into classes:
insult (learned stems), threat, target, negation, report, quote, other.  ``negations`` marks insults and threats that a
negation reaches, ``reports`` those told of somebody else's words, ``targets`` those aimed at somebody.  ``compose`` makes
one machine of the last three; each event that its arcs put out has a weight, and a clause weighs the sum of its
path.  A document's score is a logistic function of the events of all its clauses.

Stems and weights are learned from labelled documents, under constraints: what is negated or reported never speaks for
toxicity, a plain insult never against it, and an aimed threat alone is enough, whether or not the sample shows one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.session import settle

#: Labelled documents that stems and weights are learned from, at most about.
SAMPLE_ROWS = 30_000
#: Letters of a stem; shares of toxic and of other documents that hold one, at least and at most.
STEM = range(3, 11)
TOXIC_SHARE, CLEAN_SHARE, ODDS = 0.01, 0.001, 100.0
#: A longer stem replaces a shorter one that it explains to this share.
EXPLAINS = 0.95
#: Words over which a negation and a target reach.
REACH = 3

# Small closed classes, in English, German, French and Spanish.
CLASSES = {
    "threat": "kill hurt destroy beat shoot stab burn töten umbringen schlagen zerstören tuer frapper détruire matar golpear destruir".split(),
    "target": "you your youre u he she they them du dich dir ihr euch sie er tu te toi vous il elle ils tú ti usted ustedes él ella ellos".split(),
    "negation": "not no never neither isn't aren't don't nicht kein keine nie niemals ne pas jamais ni nunca jamás sin".split(),
    "report": "said says say told claimed called reported quoted wrote sagte sagt meinte schrieb dit disait écrit dijo dice escribió".split(),
}
CLASS_OF = {word: name for name, words in CLASSES.items() for word in words}
THREATS = frozenset(CLASSES["threat"])
EVENTS = ["insult", "insult_aimed", "threat", "threat_aimed", "insult_negated", "insult_reported", "threat_negated", "threat_reported"]
FEATURES = [*EVENTS, "strongest"]
#: Signs that the weights may have; a threat's least logit when it stands alone in a document.
AT_LEAST_ZERO, AT_MOST_ZERO = ["insult", "insult_aimed", "threat", "threat_aimed", "strongest"], EVENTS[4:]
THREAT_LOGIT = 1.0

_word = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_token = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»]")
_clause_end = re.compile(r"[.!?;:\n]+")


Symbol = str


@dataclass(frozen=True)
class Transducer:
    """Arcs: (state, symbol read) -> (next state, symbols put out).  "end" closes a clause and leads to the start."""

    start: object
    arcs: dict[tuple[object, Symbol], tuple[object, tuple[Symbol, ...]]]

    def read(self, symbols: list[Symbol]) -> list[list[Symbol]]:
        """What is put out at each symbol."""
        state, out = self.start, []
        for symbol in symbols:
            state, told = self.arcs[state, symbol]
            out.append(list(told))
        return out


def transducer(start: object, inputs: list[Symbol], step) -> Transducer:
    """The table of a rule ``step(state, symbol) -> (state, symbols)``, for all states reached from the start."""
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in inputs:
            arcs[state, symbol] = step(state, symbol)
            if (to := arcs[state, symbol][0]) not in seen:
                seen.add(to)
                todo.append(to)
    return Transducer(start, arcs)


def compose(first: Transducer, second: Transducer, inputs: list[Symbol]) -> Transducer:
    """The machine that gives what ``second`` puts out when it reads what ``first`` puts out."""
    def step(state, symbol):
        to, told = first.arcs[state[0], symbol]
        other, out = state[1], ()
        for t in told:
            other, more = second.arcs[other, t]
            out += more
        return (to, other), out

    return transducer((first.start, second.start), inputs, step)


WORDS = ["insult", "threat", "target", "negation", "report", "quote", "other", "end"]
MARKED = ["insult_negated", "threat_negated", "insult_reported", "threat_reported"]


def negations() -> Transducer:
    """The state counts the words that a negation still reaches."""
    def step(left, symbol):
        if symbol == "end":
            return 0, ("end",)
        if symbol == "negation":
            return REACH, ("other",)
        if symbol == "quote":
            return left, ("quote",)
        return max(left - 1, 0), (f"{symbol}_negated" if left and symbol in ("insult", "threat") else symbol,)

    return transducer(0, WORDS, step)


def reports() -> Transducer:
    """After a word of saying up to the clause's end, and within quotation marks, speech is somebody else's."""
    def step(state, symbol):
        told, quoted = state
        if symbol == "end":
            return (False, False), ("end",)
        if symbol == "report":
            return (True, quoted), ("other",)
        if symbol == "quote":
            return (told, not quoted), ()
        return state, (f"{symbol}_reported" if (told or quoted) and symbol in ("insult", "threat") else symbol,)

    return transducer((False, False), [*WORDS, *MARKED[:2]], step)


def targets() -> Transducer:
    """The state holds the words that a target still reaches and an insult or threat that waits for a target after it."""
    def step(state, symbol):
        left, waiting, more = state
        flushed = (waiting,) if waiting else ()
        if symbol == "end":
            return (0, None, 0), flushed
        if symbol == "target":
            return (REACH, None, 0), ((f"{waiting}_aimed",) if waiting else ())
        if symbol in ("insult", "threat"):
            return ((left - 1, None, 0), (*flushed, f"{symbol}_aimed")) if left else ((0, symbol, REACH), flushed)
        out = (symbol,) if symbol in MARKED else ()
        if waiting and more == 1:
            return (max(left - 1, 0), None, 0), (*flushed, *out)
        return (max(left - 1, 0), waiting, max(more - 1, 0)), out

    return transducer((0, None, 0), ["insult", "threat", "target", "other", "end", *MARKED], step)


CLAUSE = compose(compose(negations(), reports(), WORDS), targets(), WORDS)


@dataclass
class Grammar:
    """Learned stems with their log odds, and the weights of the features (a constant last)."""

    stems: dict[str, float]
    weights: np.ndarray

    def machine(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for stem, weight in self.stems.items():
            out.add_word(stem, (len(stem), weight))
        for word in THREATS:
            if word not in self.stems:
                out.add_word(word, (len(word), 0.0))
        out.make_automaton()
        return out

    def clause_weight(self, clause: str) -> float:
        """Sum of the weights of the events on a clause's path."""
        return float(sum(self.weights[EVENTS.index(e)] for e in events(clause.lower(), self.stems)[0]))


def stem_weight(word: str, stems: dict[str, float]) -> float | None:
    """Weight of the heaviest stem that the word begins with."""
    found = [stems[word[:n]] for n in STEM if word[:n] in stems and len(word) >= n]
    return max(found) if found else None


def classes(clause: str, stems: dict[str, float]) -> list[tuple[Symbol, float]]:
    """The lexicon: (class, weight) of each word and quotation mark."""
    out = []
    for word in _token.findall(clause):
        if word in "\"“”«»":
            out.append(("quote", 0.0))
            continue
        weight = stem_weight(word, stems)
        out.append(("insult", weight) if weight is not None else (CLASS_OF.get(word, "other"), 0.0))
    return out


def events(clause: str, stems: dict[str, float]) -> tuple[list[Symbol], float]:
    """Events on the path of a clause, and its heaviest stem if an insult is meant."""
    read = classes(clause, stems)
    out = [e for told in CLAUSE.read([name for name, _ in read] + ["end"]) for e in told]
    meant = any(e in ("insult", "insult_aimed") for e in out)
    return out, max((weight for name, weight in read if name == "insult"), default=0.0) if meant else 0.0


def document_features(text: str, machine: ahocorasick.Automaton, stems: dict[str, float]) -> np.ndarray:
    """Damped sums of the events of all clauses of the whole text, and the heaviest stem of a meant insult."""
    total, strongest = np.zeros(len(EVENTS)), 0.0
    low = text.lower()
    hits = [begin for end, (size, _) in machine.iter(low) if (begin := end + 1 - size) == 0 or not low[begin - 1].isalnum()]
    done = 0
    for begin in sorted(hits):
        if begin < done:
            continue
        first = max((low.rfind(c, done, begin) for c in ".!?;:\n"), default=-1) + 1
        match = _clause_end.search(low, begin)
        first, done = max(first, done), match.start() if match else len(low)
        found, weight = events(low[first:done], stems)
        for e in found:
            total[EVENTS.index(e)] += 1
        strongest = max(strongest, weight)
    return np.append(np.log1p(total), strongest)


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """A grammar from (text, toxic) rows, about ``sample_rows`` of them chosen by a hash of the text and label.

    Rows without a label are left out.  What reaches the driver is bounded by the sample.
    """
    rows = labelled.filter(F.col("toxic").isNotNull()).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    n = rows.count()
    part, whole = min(1 << 40, int((1 << 40) * sample_rows / max(n, 1))), 1 << 40
    # A text that was copied often counts once, or its own words would pass for stems.
    sample = settle(rows.filter(F.pmod(F.xxhash64("text", "toxic"), F.lit(whole)) < part).dropDuplicates(["text", "toxic"]))
    size = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Grammar({}, _with_threats(np.append(np.zeros(len(FEATURES)), 5.0 if toxic else -5.0)))
    found = _counted(sample.filter("toxic = 1"), None).filter(F.col("n") >= max(3, TOXIC_SHARE * toxic)).collect()
    in_toxic = {r[0]: r[1] for r in found}
    in_clean = {r[0]: r[1] for r in _counted(sample.filter("toxic = 0"), set(in_toxic)).collect()}
    stems = chosen_stems(in_toxic, in_clean, toxic, clean)
    grammar = Grammar(stems, np.zeros(len(FEATURES) + 1))
    # Events repeat over documents, so distinct rows of features with their counts are all that the fit needs.
    fields = ", ".join(f"{e} double" for e in FEATURES)
    rows = sample.mapInArrow(_feature_rows(grammar), f"toxic int, {fields}").groupBy("toxic", *FEATURES).count().collect()
    rows.sort()
    x = np.array([[*r[1:-1], 1.0] for r in rows])
    y, times = np.array([r[0] for r in rows], float), np.array([r[-1] for r in rows], float)
    grammar.weights = _with_threats(weighted_logistic(x, y, times))
    return grammar


def _with_threats(weights: np.ndarray) -> np.ndarray:
    """An aimed threat's weight, raised until one alone gives THREAT_LOGIT; the constant is the last weight."""
    out, at = weights.copy(), FEATURES.index("threat_aimed")
    out[at] = max(out[at], (THREAT_LOGIT - out[-1]) / np.log(2))
    return out


def sampled(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic) of about ``sample_rows`` labelled documents, chosen by a hash of the id before any text is read.

    Rows without an id or a label are left out; of several labels of a document the highest counts.
    """
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    part, whole = min(1 << 40, int((1 << 40) * sample_rows / max(own.count(), 1))), 1 << 40
    return own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < part)


def weighted_logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Newton's method with a little shrinkage on the free weights; a weight that its bound stops stays at 0 until the
    slope leads it back inside."""
    low, high = np.full(x.shape[1], -np.inf), np.full(x.shape[1], np.inf)
    low[[FEATURES.index(f) for f in AT_LEAST_ZERO]] = 0
    high[[FEATURES.index(f) for f in AT_MOST_ZERO]] = 0
    weights = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (times * (p - y)) + 0.05 * weights
        free = ~((weights <= low) & (slope > 0) | (weights >= high) & (slope < 0))
        curve = (x * (times * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(len(weights))
        move = np.zeros(len(weights))
        move[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        before = weights
        weights = np.clip(weights - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9)), low, high)
        if np.abs(weights - before).max() < 1e-8:
            break
    return weights


def chosen_stems(in_toxic: dict[str, int], in_clean: dict[str, int], toxic: int, clean: int) -> dict[str, float]:
    """Beginnings of words that mark toxic documents, no chosen one beginning with another."""
    def odds(stem: str) -> float:
        return float(np.log((in_toxic[stem] + 0.5) / (toxic + 1)) - np.log((in_clean.get(stem, 0) + 0.5) / (clean + 1)))

    good = {s for s in in_toxic if in_clean.get(s, 0) <= CLEAN_SHARE * clean and odds(s) >= np.log(ODDS)}
    longer: dict[str, int] = {}
    for s in good:
        longer[s[:-1]] = max(longer.get(s[:-1], 0), in_toxic[s])
    out: dict[str, float] = {}
    for stem in sorted(good, key=len):
        if any(stem[:n] in out for n in range(1, len(stem))) or longer.get(stem, 0) >= EXPLAINS * in_toxic[stem]:
            continue
        out[stem] = odds(stem)
    return out


def _counted(rows: DataFrame, only: set[str] | None) -> DataFrame:
    """(stem, n): documents with a word that begins so."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                counts: Counter[str] = Counter()
                for text in batch.column("text").slice(begin, 500).to_pylist():
                    found = {w[:n] for w in set(_word.findall(text.lower())) for n in STEM if n <= len(w)}
                    counts.update(found if only is None else found & only)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["stem", "n"])

    return rows.select("text").mapInArrow(run, "stem string, n bigint").groupBy("stem").agg(F.sum("n").alias("n"))


def _feature_rows(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar.machine()
        for batch in batches:
            got = np.array([document_features(t or "", machine, grammar.stems) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(np.ascontiguousarray(c)) for c in got.T]], ["toxic", *FEATURES])

    return run


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and toxicity (0 to 1) of every whole text; an empty or null text has no event.

    Other columns are ignored; repeated rows give repeated results.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar.machine()
        for batch in batches:
            got = [document_features(t or "", machine, grammar.stems) for t in batch.column("text").to_pylist()]
            x = np.array(got).reshape(-1, len(FEATURES)) @ grammar.weights[:-1] + grammar.weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], ["doc_id", "toxicity"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, toxicity double")
