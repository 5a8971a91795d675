"""Toxicity scores: misspelled lexicon terms by Levenshtein automata over a trie, read in context.

The lexicon is learned from labelled documents: words, and word beginnings of four to six letters, that
occur far more often in toxic documents. It is compiled into a trie; a word is matched by running it
through the product of that trie with the Levenshtein automata of its terms (states are sets of
(trie node, edits), determinised as words ask for them), so one pass over a word finds every term
within the allowed edits. Each hit is weighed by its log odds, by its edits and by its context window:
hits between quotation marks or beside words of reporting count a quarter. Words of reporting are those that stand beside hits of
clean documents rather than of toxic ones; a short list holds where the sample says nothing. A logistic model over a
handful of such sums gives the score; it is fitted on features from a lexicon learned on the other half
of the sample.

Training uses at most ``max_rows`` labelled documents, those of the least id hashes; every document is
scored as a whole. Nulls and empty texts have no hits and get the model's base score. Repeated documents
score alike; a document with several labels counts once for each. Without labels of both kinds, or
without any term that tells them apart, every score is 0. Words of any length are read whole. A column named as the result is replaced.
"""

from __future__ import annotations

import math
import string
import uuid
from array import array
from collections import Counter, defaultdict
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpointed, steps, text_sizes

EDGE = string.punctuation + "“”„‚‘’«»‹›…–—¿¡"
QUOTES = set("\"“”„«»‹›")
REPORTING = frozenset("said says saying wrote writes quoted quote quotes called calls reported zitat zitiert sagte schrieb dit disait écrit cite dijo dice escribió cita".split())
CACHE_WORDS = 100_000
STATES = 150_000
#: Words before and after a hit that tell whether it is spoken of.
BESIDE = 3
STEMS = (4, 5, 6)
#: Letters by which a word may go on after a stem; no longer word is a hit of it.
REACH = 16


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights; stems match all words that begin with them and go on by at most ``REACH`` letters. Terms from ``long_from`` letters on may have ``long_edits``.

    ``reporting``: words beside which a term is spoken of rather than said.
    """

    words: dict
    stems: dict
    reporting: frozenset = REPORTING
    max_edits: int = 1
    fuzzy_from: int = 5
    long_from: int = 9
    long_edits: int = 2

    def allowed(self, length: int) -> int:
        """Edits that a term of so many letters may have."""
        if length < self.fuzzy_from:
            return 0
        return max(self.max_edits, self.long_edits) if length >= self.long_from else self.max_edits


def _reached(stems: tuple, length: int) -> float:
    """The largest weight of the stems (letters, weight) that a word of so many letters goes on from."""
    return max((weight for letters, weight in stems if length <= letters + REACH), default=0.0)


class FuzzyTrie:
    """The lexicon trie intersected with Levenshtein automata, determinised on demand."""

    def __init__(self, lexicon: Lexicon):
        self.allowed = lexicon.allowed
        self.children: list[dict[str, int]] = [{}]
        self.depth: list[int] = [0]
        self.word: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.deep: list[int] = [0]  # the most edits that a term below may have
        for term, weight in lexicon.words.items():
            self._add(term, weight, self.word, lexicon.allowed(len(term)))
        for term, weight in lexicon.stems.items():
            self._add(term, weight, self.stem, 0)
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.begin = self._state({0: 0}, ())

    def _add(self, term: str, weight: float, into: list, edits: int) -> None:
        node = 0
        self.deep[0] = max(self.deep[0], edits)
        for letter in term:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.depth.append(self.depth[node] + 1)
                self.word.append(None)
                self.stem.append(None)
                self.deep.append(0)
            node = self.children[node][letter]
            self.deep[node] = max(self.deep[node], edits)
        into[node] = weight

    def _state(self, nodes: dict[int, int], stems: tuple) -> int:
        """``nodes``: trie node -> least edits; kept as numbers, four for each node, so that a state is small. ``stems``: (letters, weight) of those met."""
        grow = list(nodes.items())
        while grow:  # letters of a term that the word leaves out
            node, used = grow.pop()
            if used < self.deep[node]:
                for child in self.children[node].values():
                    if used < self.deep[child] and nodes.get(child, 99) > used + 1:
                        nodes[child] = used + 1
                        grow.append((child, used + 1))
        key = (array("I", sorted(node << 2 | used for node, used in nodes.items())).tobytes(), stems)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.states[key]

    def _next(self, state: int, letter: str) -> int:
        items, stems = self.sets[state]
        nodes: dict[int, int] = {}

        def put(node, used):
            if nodes.get(node, 99) > used:
                nodes[node] = used

        for item in array("I", items):
            node, used = item >> 2, item & 3
            child = self.children[node].get(letter)
            if child is not None:
                put(child, used)
                if used == 0 and self.stem[child] is not None:
                    stems += ((self.depth[child], self.stem[child]),)
            if used < self.deep[node]:
                put(node, used + 1)
                for other, child in self.children[node].items():
                    if other != letter and used < self.deep[child]:
                        put(child, used + 1)
        to = self._state(nodes, stems)
        self.steps[state][letter] = to
        return to

    def match(self, word: str) -> tuple[float, float]:
        """The largest weight of an exact (or stem) hit and of a misspelled one; zero if none."""
        if len(self.sets) > STATES:
            self._forget()
        state, steps = self.begin, self.steps
        for letter in word:
            to = steps[state].get(letter)
            state = self._next(state, letter) if to is None else to
            if not self.sets[state][0]:  # no term can follow, however long the word is
                stems = self.sets[state][1]
                return (_reached(stems, len(word)) if stems else 0.0), 0.0
        items, stems = self.sets[state]
        exact, fuzzy = _reached(stems, len(word)) if stems else 0.0, 0.0
        for item in array("I", items):
            node, used = item >> 2, item & 3
            weight = self.word[node]
            if weight is not None:
                if used == 0:
                    exact = max(exact, weight)
                elif used <= self.allowed(self.depth[node]):
                    fuzzy = max(fuzzy, weight)
        return exact, fuzzy


class Reader:
    """Features of texts under a lexicon."""

    NAMES = ("hits", "density", "largest", "kinds", "misspelled", "quoted")

    def __init__(self, lexicon: Lexicon, window: int = 8):
        self.trie, self.window, self.reporting = FuzzyTrie(lexicon), window, lexicon.reporting
        self.known: set[str] = set()
        self.found: dict[str, tuple[float, float]] = {}

    def hits(self, chunks: list[str]) -> None:
        """Makes the hits of the words known."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.found = set(), {}
        for chunk in set(chunks).difference(self.known):
            self.known.add(chunk)
            if word := chunk.strip(EDGE):
                hit = self.trie.match(word)
                if hit != (0.0, 0.0):
                    self.found[chunk] = hit

    def neighbours(self, text: str | None) -> list[str]:
        """The words beside each exact hit."""
        chunks = text.lower().split() if text else []
        self.hits(chunks)
        at = [i for i, chunk in enumerate(chunks) if self.found.get(chunk, (0.0, 0.0))[0]]
        return [w for i in at for c in (*chunks[max(0, i - BESIDE) : i], *chunks[i + 1 : i + 1 + BESIDE]) if (w := c.strip(EDGE))]

    def features(self, text: str | None) -> list[float]:
        chunks = text.lower().split() if text else []
        self.hits(chunks)
        if self.found.keys().isdisjoint(chunks):
            return [0.0] * 6
        total = loose = quoted = largest = 0.0
        kinds = set()
        for i, chunk in enumerate(chunks):
            hit = self.found.get(chunk)
            if hit is None:
                continue
            weight = hit[0] or 0.5 * hit[1]
            if self._quotation(chunks, i):
                quoted += weight
                weight *= 0.25
            elif hit[0]:
                largest = max(largest, weight)
            if hit[0]:
                total += weight
                kinds.add(chunk.strip(EDGE)[: STEMS[0]])
            else:
                loose += weight
        return [math.log1p(total), math.sqrt(total / len(chunks)), largest, math.log1p(len(kinds)), math.sqrt(loose / len(chunks)), math.log1p(quoted)]

    def _quotation(self, chunks: list[str], i: int) -> bool:
        """Whether a hit stands between quotation marks, or beside words of reporting."""
        before, after = chunks[max(0, i - self.window) : i], chunks[i + 1 : i + 1 + self.window]
        if any(c.strip(EDGE) in self.reporting for c in (*before[-BESIDE:], *after[:BESIDE])):
            return True
        opened = sum(x in QUOTES for c in before for x in c) + (chunks[i][0] in QUOTES)
        closed = (chunks[i][-1] in QUOTES) or any(x in QUOTES for c in after for x in c)
        return opened % 2 == 1 and closed


# ---------------------------------------------------------------- learning


def _lexicon(counts: list, clean: int, toxic: int, min_support: int, min_odds: float) -> Lexicon:
    """Terms (kind, term, toxic documents, clean documents) of high odds."""
    words, stems = {}, {}
    for kind, term, t, c in counts:
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        if t >= min_support and odds >= min_odds:
            (stems if kind else words)[term] = odds
    # a word or a longer stem adds nothing where a shorter stem is as good
    covered = lambda term, odds: any(stems.get(term[:k], -1.0) >= odds - 0.5 for k in STEMS if k < len(term))
    keep_stems = {s: w for s, w in stems.items() if not covered(s, w)}
    # words that may be misspelled stay all the same: stems may not be
    keep_words = {w: o for w, o in words.items() if len(w) >= Lexicon.fuzzy_from or not covered(w, o)}
    return Lexicon(keep_words, keep_stems)


#: Where the weights are drawn to without evidence: misspelled hits speak for abuse, quoted ones against it.
PRIOR = (0.0, 0.0, 0.0, 0.0, 2.0, -1.0, 0.0)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; weights, then the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.array(PRIOR)
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ (w - np.array(PRIOR)))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple


_readers: dict[str, list[Reader]] = {}


def _kept_readers(name: str, lexicons: list[Lexicon]) -> list[Reader]:
    """Readers that a worker keeps between tasks, with the automaton states and words they have met; those of one model at a time."""
    if name not in _readers:
        _readers.clear()
        _readers[name] = [Reader(x) for x in lexicons]
    return _readers[name]


def _reporting(counts: dict[str, tuple[int, int]], support: int = 20, odds: float = 2.0) -> frozenset:
    """Words that stand beside hits of clean documents more than beside those of toxic ones: (clean, toxic) times each.

    Listed words that are met often enough must show the same.
    """
    clean, toxic = (sum(c[i] for c in counts.values()) + 0.5 for i in range(2))
    known = {w: math.log((c + 0.5) / (t + 0.5) * toxic / clean) for w, (c, t) in counts.items() if c + t >= support}
    return frozenset({w for w, o in known.items() if o >= odds} | {w for w in REPORTING if known.get(w, odds) >= odds / 2})


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, min_support: int = 3, min_odds: float = 2.5, chance_terms: int = 10, parts: int = 32) -> Model | None:
    """Learns a model from labels (doc_id, toxic).

    A term counts if it stands in ``min_support`` toxic documents at least and is so much more frequent in those that about
    ``chance_terms`` of all terms met would be so by chance: the more terms a sample has, the more evidence each needs.
    All that reaches the driver comes from the sample of ``max_rows`` labels at most; where several documents have one
    id, the least text is learned from.
    """
    spark = docs.sparkSession
    sample = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # by hash range first, so that no task sorts or sends more than its share of the sample
    share = 1.1 * max_rows / max(sample.count(), 1)
    sample = sample.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53) < min(share, 1.0))
    sample = sample.orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id", "toxic").limit(max_rows)
    sample = spark.createDataFrame(sample.toArrow()) if not sample.isEmpty() else None
    if sample is None:
        return None
    # bounded by max_rows, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    rows = checkpointed(texts.join(F.broadcast(sample), "doc_id").select("text", "toxic", half.alias("half")).repartition(parts))

    def count(batches):
        counts = defaultdict(lambda: [0, 0, 0, 0])
        for batch in batches:
            for part in steps(batch, text_sizes(batch.column(0))):
                for text, toxic, half in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    words = {w for c in set((text or "").lower().split()) if (w := c.strip(EDGE))}
                    terms = {(0, w) for w in words} | {(1, w[:k]) for w in words for k in STEMS if len(w) >= k} | {(2, "")}
                    for term in terms:
                        counts[term][2 * half + (toxic > 0)] += 1
                if len(counts) > 300_000:
                    yield table(counts)
                    counts.clear()
        yield table(counts)

    def table(counts):
        keys, values = list(counts), np.array(list(counts.values()), np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([t for _, t in keys], pa.string()), *(pa.array(values[:, i].copy()) for i in range(4))], names=["kind", "term", "c0", "t0", "c1", "t1"])

    counts = checkpointed(rows.mapInArrow(count, "kind int, term string, c0 long, t0 long, c1 long, t1 long").groupBy("kind", "term").agg(*(F.sum(n).alias(n) for n in ("c0", "t0", "c1", "t1"))))
    totals = counts.filter("kind = 2").first()
    if totals is None or not totals["t0"] + totals["t1"] or not totals["c0"] + totals["c1"]:
        return None
    t, c = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    share = (totals["t0"] + totals["t1"]) / (totals["t0"] + totals["t1"] + totals["c0"] + totals["c1"])
    surprise = t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0)
    least = math.log(max(counts.count() / chance_terms, 1.0))
    terms = counts.filter("kind < 2").filter((t >= min_support) & (t > (t + c) * share) & (surprise >= least)).collect()

    def learned(keys, support):
        pick = lambda r, kind: sum(r[f"{kind}{k}"] for k in keys)
        return _lexicon([(r["kind"], r["term"], pick(r, "t"), pick(r, "c")) for r in terms], pick(totals, "c"), pick(totals, "t"), support, min_odds)

    whole = learned((0, 1), min_support)
    if not whole.words and not whole.stems:
        return None
    halves = [learned((1,), max(2, min_support // 2)), learned((0,), max(2, min_support // 2))]  # for the rows of half 0 and of half 1
    shared = spark.sparkContext.broadcast(halves)

    name = uuid.uuid4().hex

    def beside(batches):
        readers = _kept_readers(name, shared.value)
        for batch in batches:
            met = [(w, y > 0) for t, y, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for w in readers[h].neighbours(t)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in met], pa.string()), pa.array([int(y) for _, y in met], pa.int64())], names=["word", "toxic"])

    around = rows.mapInArrow(beside, "word string, toxic long").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    reporting = _reporting({r["word"]: (r["n"] - r["toxic"], r["toxic"]) for r in around.collect()})

    def features(batches):
        readers = _kept_readers(name, shared.value)
        for reader in readers:
            reader.reporting = reporting
        for batch in batches:
            out = [(*readers[h].features(t), float(y > 0)) for t, y, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], names=["f"])

    data = np.array(rows.mapInArrow(features, "f array<double>").toArrow().column(0).to_pylist())
    return Model(replace(whole, reporting=reporting), tuple(_fit(data[:, :-1], data[:, -1])))


def score(docs: DataFrame, model: Model | None, *, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, rounded to six digits."""
    if model is None:
        return docs.withColumn(output, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    name = uuid.uuid4().hex

    def make():
        (reader,), weights = _kept_readers(name, [shared.value.lexicon]), np.array(shared.value.weights)

        def function(texts):
            x = np.array([reader.features(t) for t in texts.to_pylist()]).reshape(-1, 6)
            return [pa.array(np.round(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))), 6))]

        return function

    return append_columns(docs, text, [text], [(output, T.DoubleType())], make)


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_open_labels(docs: DataFrame, labels: DataFrame, **options) -> Model | None:
    """A model from the labels that are not held out."""
    return train(docs, labels.filter(~held_out()), **options)
