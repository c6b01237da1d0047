"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, person, other target, negation, reported speech, other) and six small transducers read the
symbols of a clause side by side: the insult and threat transducers mark a match, the target and person transducers whether
somebody is addressed within reach, the negation transducer whether a negator reaches it, the reported-speech transducer
whether the clause cites somebody. Their composition is one table; each match leaves it with a category and a weight.

A document's score comes from its matched clauses. What one match is worth by itself stays below the bound: it takes a target, or
a further match, to pass it. A threat needs a person behind it and is worth the strongest insult. Negation and reported speech
take off, never add. The fit to labelled rows moves the weights within these signs (a logistic regression with a Gaussian
prior around the grammar's own weights, projected Newton steps), so whatever the rows say, no sign turns.

Labelled rows teach the insults too: beside a general list, words and word beginnings that stand in far more toxic texts than
clean ones, weighted by their log-odds (of nested beginnings the longest that explains as much stays).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm import simhash
from chronofold.llm.common import mapped, partitions, slices, written

#: Labelled rows that the weights are fitted to, at most; of rows of one label whose fingerprints of 256 bits differ in so
#: many bits or fewer (some four fifths of the five-word shingles in common), one counts.
MAX_TRAINING_ROWS, SAME_BITS = 20_000, 48
INSULTS = (
    "idiot idiots moron morons stupid dumb fool loser losers clown clowns scum trash garbage pathetic worthless disgusting imbecile "
    "cretin jerk bastard bitch asshole dumbass retard degenerate vermin pig creep freak coward liar "
    "idiota estúpido estúpida imbécil basura escoria asqueroso inútil connard salaud imbécile ordure abruti "
    "dummkopf trottel arschloch abschaum widerlich wertlos erbärmlich"
).split()
THREATS = "kill hurt destroy murder strangle stab shoot punch smash burn beat töten umbringen matar tuer".split()
TARGETS = "you your yours youre u ya he she they him her them his their this these those du dich dir euch sie tú te usted tu toi vous".split()
#: Targets that a threat is against, when they stand behind it.
PERSONS = "you u ya him them her dich dir euch te usted toi vous".split()
NEGATORS = "not no never isnt arent wasnt dont doesnt didnt wont cannot cant nicht kein keine nie pas jamais nunca jamás".split()
REPORTERS = "said says say told tells wrote writes called calls quoted quote claims claimed sagte schrieb dit écrit dijo escribió".split()
#: Words that a target, a negator and a reporter reach.
TARGET_REACH, NEGATOR_REACH, REPORTER_REACH = 4, 3, 8

OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTER, PERSON = range(7)
SYMBOLS = {w: s for s, words in ((REPORTER, REPORTERS), (NEGATOR, NEGATORS), (TARGET, TARGETS), (PERSON, PERSONS), (THREAT, THREATS), (INSULT, INSULTS)) for w in words}


class Transducer:
    """start, and a table (state, symbol) -> (state, output)."""

    def __init__(self, start: int, table: dict[tuple[int, int], tuple[int, tuple]]) -> None:
        self.start, self.table = start, table

    @classmethod
    def of(cls, step: Callable[[object, int], tuple[object, tuple]], start: object) -> Transducer:
        """The reachable part of a step function, with numbered states."""
        numbers, table, todo = {start: 0}, {}, [start]
        while todo:
            state = todo.pop()
            for symbol in range(7):
                to, out = step(state, symbol)
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
                table[numbers[state], symbol] = numbers[to], out
        return cls(0, table)

    def beside(self, other: Transducer) -> Transducer:
        """Both read the same symbols; their outputs are joined."""

        def step(state: tuple[int, int], symbol: int) -> tuple:
            (a, x), (b, y) = self.table[state[0], symbol], other.table[state[1], symbol]
            return (a, b), x + y

        return Transducer.of(step, (self.start, other.start))

    def run(self, symbols: list[int]) -> Iterator[tuple]:
        state, table = self.start, self.table
        for symbol in symbols:
            state, out = table[state, symbol]
            yield out


def match(wanted: int) -> Transducer:
    return Transducer.of(lambda state, symbol: (0, (symbol == wanted,)), 0)


def reach(wanted: tuple[int, ...], words: int) -> Transducer:
    """Outputs whether a wanted symbol stood within so many words before."""
    return Transducer.of(lambda left, symbol: (words if symbol in wanted else max(0, left - 1), (left > 0,)), 0)


def grammar() -> Transducer:
    """Outputs (insult, threat, target before, person before, negated, reported) for each word of a clause."""
    near = reach((TARGET, PERSON), TARGET_REACH).beside(reach((PERSON,), TARGET_REACH))
    return match(INSULT).beside(match(THREAT)).beside(near).beside(reach((NEGATOR,), NEGATOR_REACH)).beside(reach((REPORTER,), REPORTER_REACH))


#: Categories of matches. A threat has the weight of the strongest insult; weights of a document add up to MOST at most.
CATEGORIES = ("insult", "insult at a target", "negated insult", "reported insult", "threat at a target", "negated or reported threat")
STRONGEST, MOST, UNSEEN = 6.0, 12.0, 4.0
#: Features of a document, the grammar's own weights, and the bounds that the fit keeps to: how far the strongest match stays behind
#: the strongest there is, a match by itself, what other clauses add, what is at a target, what negation and reported speech
#: take off.
FEATURES = ("short of the strongest", "one match", "further clauses", "at a target", "negated", "reported")
PRIOR = np.array([4.0, 0.3, 0.5, 0.6, -0.3, -0.3])
LOW = np.array([0.0, 0.2, 0.1, 0.5, -np.inf, -np.inf])
HIGH = np.array([np.inf, np.inf, np.inf, np.inf, -0.1, -0.1])
#: Lengths of word beginnings that are looked at, the evidence (nats) and the log-odds that one needs, and how many are kept
#: at most.
HELD = 100_000  # beginnings that a task counts before it hands them on
STEMS, EVIDENCE, LEAST, MAX_STEMS = range(3, 9), 16.0, 3.5, 4000
_CLAUSE = re.compile(r"[.!?;\n|]")
_WORD = re.compile(r"[^\W\d_]+")


class Lexicon:
    """Weights of insults: of whole words, and of words that begin with a stem (the longest stem counts)."""

    def __init__(self, words: dict[str, float] | None = None, stems: dict[str, float] | None = None) -> None:
        self.words = dict.fromkeys(INSULTS, UNSEEN) | (words or {})
        self.stems = stems or {}

    def weight(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            found = next((self.stems[word[:n]] for n in range(min(len(word), STEMS.stop - 1), STEMS.start - 1, -1) if word[:n] in self.stems), 0.0)
        return found


class Grammar:
    def __init__(self, lexicon: Lexicon) -> None:
        self.composed, self.lexicon = grammar(), lexicon
        self.cores = ahocorasick.Automaton()
        for words, whole in ((lexicon.stems, False), (lexicon.words, True), (THREATS, True)):
            for word in words:
                self.cores.add_word(word, (len(word), whole and word not in lexicon.stems))
        self.cores.make_automaton()

    def clauses(self, text: str) -> list[Counter]:
        """Weights by category of the matches of each clause that has any; clauses without an insult or threat are never read."""
        low, found, done = text.lower(), [], -1
        for end, (n, whole) in self.cores.iter(low):
            a, b = end - n + 1, end + 1
            if a < done or a and low[a - 1].isalpha() or whole and b < len(low) and low[b].isalpha():
                continue
            start = max(low.rfind(mark, max(done, 0), a) for mark in ".!?;\n|") + 1
            stop = _CLAUSE.search(low, b)
            stop = stop.start() if stop else len(low)
            start, done = max(start, done), stop
            words = _WORD.findall(low[start:stop].replace("'", ""))
            weights = [self.lexicon.weight(w) for w in words]
            symbols = [INSULT if x else SYMBOLS.get(w, OTHER) for w, x in zip(words, weights, strict=True)]
            marks = Counter()
            ahead = reversed([out[2:4] for out in self.composed.run(symbols[::-1])])
            for (insult, threat, target, _, negated, reported), (after, person), weight in zip(self.composed.run(symbols), ahead, weights, strict=True):
                if insult:
                    marks["negated insult" if negated else "reported insult" if reported else "insult at a target" if target or after else "insult"] += weight
                elif threat and person:
                    marks["negated or reported threat" if negated or reported else "threat at a target"] += 1
            if marks:
                found.append(marks)
        return found

    def features(self, text: str) -> list[float]:
        """FEATURES of a text. Clauses count by what is neither negated nor reported, the strongest one apart."""
        found = self.clauses(text)
        total = sum(found, Counter())
        plain = [m["insult"] + m["insult at a target"] + STRONGEST * m["threat at a target"] for m in found]
        softened = [m["negated insult"] + m["reported insult"] + STRONGEST * m["negated or reported threat"] for m in found]
        first = min(STRONGEST, max((p + q for p, q in zip(plain, softened, strict=True)), default=0.0))
        further = sum(plain) - min(STRONGEST, max(plain, default=0.0))
        at_target = total["insult at a target"] + STRONGEST * total["threat at a target"]
        negated = total["negated insult"] + STRONGEST * total["negated or reported threat"]
        return [first / STRONGEST - 1, -1.0, *(min(MOST, x) for x in (further, at_target, negated, total["reported insult"]))]


def beginnings(text: str) -> set[str]:
    """Beginnings of a text's words, and the words themselves, marked as whole."""
    words = set(_WORD.findall(text.lower().replace("'", "")))
    return {w[:n] for n in STEMS for w in words if len(w) >= n} | {f"{w}$" for w in words if len(w) >= STEMS.start}


def evidence(pos: float, neg: float, share: float) -> float:
    """Log-likelihood gain of a beginning's own share of toxic texts over the share of all; 0 where it is no larger."""
    own = (pos + share) / (pos + neg + 1)
    return pos * math.log(own / share) + neg * math.log((1 - own) / (1 - share)) if own > share else 0.0


def lexicon_of(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """From (beginning, toxic texts, clean texts): those with evidence, without the ones that others explain."""
    weight = lambda p, n: min(STRONGEST, math.log((p + 0.5) / (toxic + 0.5)) - math.log((n + 0.5) / (clean + 0.5)))
    seen = {w: (p, n) for w, p, n in counts if weight(p, n) >= LEAST}
    longest: dict[str, int] = {}
    for w, (p, _) in seen.items():
        for k in range(STEMS.start, len(w)):
            if w[:k] in seen:
                longest[w[:k]] = max(longest.get(w[:k], 0), p)
    words, stems = {}, {}
    for w in sorted(seen, key=len):
        p, n = seen[w]
        if longest.get(w, 0) >= 0.9 * p:
            continue  # a longer beginning stands in as many toxic texts
        shorter = [seen[w[:k]] for k in range(STEMS.start, len(w)) if w[:k] in stems]
        if any(a / (a + b) >= p / (p + n) - 0.02 for a, b in shorter):
            continue  # a shorter one is as good
        if w.endswith("$"):
            words[w[:-1]] = weight(p, n)
        else:
            stems[w] = weight(p, n)
    return Lexicon(words, stems)


def fit(rows: np.ndarray, labels: np.ndarray, prior: np.ndarray = PRIOR, low: np.ndarray = LOW, high: np.ndarray = HIGH, strength: float = 1.0, steps: int = 100) -> np.ndarray:
    """Damped Newton steps, projected to the bounds, for the logistic loss plus strength / 2 times the squared distance from the
    prior. Weights at a bound that the loss pushes on take no part in a step."""

    def loss(w: np.ndarray) -> float:
        z = rows @ w
        return float((np.logaddexp(0, z) - labels * z).sum() + strength / 2 * ((w - prior) ** 2).sum())

    w = np.clip(prior, low, high)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (p - labels) + strength * (w - prior)
        curvature = (rows * (p * (1 - p))[:, None]).T @ rows + strength * np.eye(len(w))
        free = np.flatnonzero(~(((w <= low) & (gradient > 0)) | ((w >= high) & (gradient < 0))))
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(curvature[np.ix_(free, free)], gradient[free])
        scale, now = 1.0, loss(w)
        while scale > 1e-6 and loss(np.clip(w - scale * step, low, high)) > now:
            scale /= 2
        after = np.clip(w - scale * step, low, high)
        moved, w = np.abs(after - w).max(), after
        if moved < 1e-9:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def first_of_copies(prints: np.ndarray, labels: np.ndarray, bits: int = SAME_BITS, rows: int = 1024) -> np.ndarray:
    """Which rows have no near copy of their label before them; ``prints`` (n, words) are fingerprints."""
    kept = np.ones(len(prints), bool)
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        signs = np.unpackbits(np.ascontiguousarray(prints[own]).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        for at in range(0, len(own), rows):
            # a product of signs is the number of equal bits less that of differing ones
            near = signs[at : at + rows] @ signs[: at + rows].T >= signs.shape[1] - 2 * bits
            kept[own[at : at + rows]] = ~np.tril(near, at - 1).any(axis=1)
    return kept


def learn(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAINING_ROWS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from labelled rows that are not held out: at most ``bound``, those of the smallest hashed ids.

    Of the equal texts and near copies of one label one counts, that of the smallest hash. Rows with a null doc_id, label or
    a label but 0 and 1 teach nothing; null texts count as empty. Without labels, or with one kind only, the general list and
    the grammar's own weights. The driver gets fingerprints, counts of beginnings and features of at most ``bound`` rows.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # at most `bound` ids are broadcast
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(known), "doc_id").select("toxic", "text").distinct().withColumn("h", F.xxhash64("text"))
    texts = written(texts, "labelled")
    if texts.count() > bound:  # ids may repeat
        texts = written(texts.orderBy("h", "toxic", "text").limit(bound), "labelled")
    texts = texts.repartition(partitions(docs.sparkSession), "h")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            found = [simhash.wide(np.unique(simhash.shingles(t, simhash.SHINGLE, simhash.SEED))).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["h", "toxic", "print"])

    found = sorted(tuple(r) for r in texts.select("h", "toxic", "text").mapInArrow(printed, "h long, toxic int, print binary").collect())
    if not found:
        return Lexicon(), PRIOR.copy()
    kept = first_of_copies(np.frombuffer(b"".join(r[2] for r in found), np.uint64).reshape(len(found), -1), np.array([r[1] for r in found]))
    chosen = docs.sparkSession.createDataFrame([r[:2] for r, k in zip(found, kept, strict=True) if k], "h long, toxic int")
    rows = written(texts.join(F.broadcast(chosen), ["h", "toxic"], "left_semi").select("toxic", "text", "h"), "training")
    kinds = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = kinds.get(1, 0), kinds.get(0, 0)
    if not toxic or not clean:
        return Lexicon(), PRIOR.copy()
    share = toxic / (toxic + clean)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: dict[str, list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([n[y] for n in found.values()], pa.int64()) for y in (1, 0))], names=["w", "pos", "neg"])

        found: dict[str, list[int]] = {}
        for batch in slices(batches):
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in beginnings(text):
                    found.setdefault(w, [0, 0])[y] += 1
            if len(found) > HELD:  # the counts are added up behind the shuffle anyway
                yield told(found)
                found = {}
        yield told(found)

    counts = rows.select("toxic", "text").mapInArrow(counted, "w string, pos long, neg long").groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    strong = counts.where(F.col("pos") * -math.log(share) >= EVIDENCE).where(F.col("pos") > share * (F.col("pos") + F.col("neg")))
    ranked = strong.orderBy(F.desc(F.col("pos") / (F.col("pos") + F.col("neg") + 1.0)), F.desc("pos"), "w").limit(MAX_STEMS).collect()
    lexicon = lexicon_of([(r["w"], r["pos"], r["neg"]) for r in ranked if evidence(r["pos"], r["neg"], share) >= EVIDENCE], toxic, clean)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Grammar(lexicon)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([reader.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["toxic", "h", "x"])

    # at most `bound` rows of a few numbers, in an order of their own: the fit's sums don't depend on the tasks
    found = sorted(rows.mapInArrow(featured, "toxic int, h long, x array<double>").collect(), key=lambda r: (r["h"], r["toxic"], r["x"]))
    return lexicon, fit(np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found], float))


def _scores(reader: Grammar, texts: list, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.array([reader.features(t or "") for t in texts]) @ weights, -30, 30)))


def without_toxic(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose score is below 0.5.

    Null and empty texts have the score of no match, rows with a null doc_id are scored like any other, repeated rows
    alike, very long texts whole; an empty table gives an empty one, other columns are carried along, whatever their names.
    """
    lexicon, weights = learn(docs, labels, bound)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Grammar(lexicon)
        for batch in slices(batches, at):
            yield batch.filter(pa.array(_scores(reader, batch.column(at).to_pylist(), weights) < 0.5))

    return mapped(docs, run, docs.schema)


def score(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAINING_ROWS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, score, predicted), a row for each row.

    Null and empty texts have no clause and get the score of no match. Only the text enters the score. Rows with a
    null doc_id are never learned from and count as held out. Repeated rows get repeated results, very long texts are read
    whole, an empty table gives an empty result, other columns are not read. The texts pass one narrow stage; labelled ones
    pass it once more for the fit.
    """
    lexicon, weights = learn(docs, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Grammar(lexicon)
        for batch in slices(batches):
            p = _scores(reader, batch.column(1).to_pylist(), weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype("i4"))], names=["doc_id", "score", "predicted"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
