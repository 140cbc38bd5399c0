"""Toxicity: Levenshtein automata over a lexicon trie, and context windows that tell quotation from abuse.

``fit`` learns from at most about ``SAMPLE_ROWS`` labelled rows (chosen by a hash of the id). All of them count: rows that
share ``MINIMA`` least hashes of their 5-word shingles, copies and most near copies, share one vote, so that groups of copies
don't lend weight to their incidental words. From these votes come

* the lexicon: seed terms, and terms and stems whose share of toxic documents beats chance at a level that lets about ``FALSE_TERMS`` pass by luck;
* a logistic regression over a document's context features.

A word is matched by the Levenshtein automata of all terms at once, intersected with the lexicon's trie: a state is a set of
(trie node, edits), built when first met. Terms of 5 letters may have 1 edit, of 9 letters 2; stems match words that begin
with them. Each hit is scored in a window of words around it: quotation marks or reporting verbs lower it, a second
person raises it.

Defined results: null and empty texts have no hit and get the score of such texts; a single letter is no term; without labels,
or without one of the two classes among those that aren't held out, the seed terms decide; a null id counts as held out; an empty table gives none; repeated rows repeat; several labels of one document count as toxic if one is.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, materialize, mix
from .near_dedup import shingle_sets

SAMPLE_ROWS = 10_000
#: Least hashes by which labelled texts count as copies.
MINIMA = 3
#: Terms that chance alone may bring into the lexicon.
FALSE_TERMS = 5
STEMS = (4, 5, 6)
WINDOW = 6
# Seed terms, words that report speech, second persons.
SEEDS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile bastard vermin"
REPORTING = frozenset(
    "said says wrote writes quoted quote quotes called calls term word phrase reported claims shouted article defined means "
    "sagte schrieb zitat wort begriff nannte dit écrit citation mot terme appelé dijo escribió cita palabra término llamó".split()
)
SECOND = frozenset("you your you're youre u ur du dich dir dein deine ihr tu toi te ton ta vous votre tú usted ustedes vosotros eres".split())
QUOTES = "\"'“”„«»‘’‹›`"
EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def normal(word: str) -> str:
    """Without marks at its ends."""
    return word if word.isalpha() else EDGE.sub("", word)


class Lexicon:
    """A trie of terms and stems, with the product of their Levenshtein automata built as needed."""

    def __init__(self, terms: list[str], stems: list[str], memo: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.stem = [-1], [False]
        self.best: list[int] = []
        for text, is_stem in [(t, False) for t in terms] + [(s, True) for s in stems]:
            node = 0
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.allowed.append(-1), self.stem.append(False)
                node = self.children[node][c]
            if is_stem:
                self.stem[node] = True
            else:
                self.allowed[node] = 2 if len(text) >= 9 else 1 if len(text) >= 5 else 0
        self.reach = self._reach()
        self.letters = {c for kids in self.children for c in kids}
        self.memo: dict[str, int] = {}
        self.limit = memo
        self._reset()

    def _reach(self) -> list[int]:
        """The most edits any term below each node allows."""
        reach = list(self.allowed)
        for node in range(len(self.children) - 1, -1, -1):
            reach[node] = max([reach[node], 0 if self.stem[node] else -1, *(reach[k] for k in self.children[node].values())])
        return reach

    def _closed(self, state: dict[int, int]) -> tuple[tuple[int, int], ...]:
        """With the terms' letters that may be missing skipped, and without nodes that can't end a term any more."""
        todo = list(state.items())
        while todo:
            node, edits = todo.pop()
            for kid in self.children[node].values():
                if edits + 1 <= self.reach[kid] and edits + 1 < state.get(kid, 9):
                    state[kid] = edits + 1
                    todo.append((kid, edits + 1))
        return tuple(sorted((n, e) for n, e in state.items() if e <= self.reach[n]))

    def _reset(self) -> None:
        self.states = {(start := self._closed({0: 0})): 0}
        self.members, self.moves, self.ends = [start], [{}], [self._end(start)]

    def _end(self, state: tuple[tuple[int, int], ...]) -> int:
        return min((e for n, e in state if e <= self.allowed[n]), default=9)

    def _move(self, at: int, letter: str) -> int:
        """The state after a letter; -1 if none is left, -2 if a stem is complete."""
        new: dict[int, int] = {}
        for node, edits in self.members[at]:
            kid = self.children[node].get(letter)
            if kid is not None:
                if self.stem[kid] and edits == 0:
                    return -2
                new[kid] = min(edits, new.get(kid, 9))
            if edits + 1 <= self.reach[node]:
                new[node] = min(edits + 1, new.get(node, 9))
                for other in self.children[node].values():
                    if other != kid:
                        new[other] = min(edits + 1, new.get(other, 9))
        state = self._closed(new)
        if not state:
            return -1
        if state not in self.states:
            self.states[state] = len(self.members)
            self.members.append(state), self.moves.append({}), self.ends.append(self._end(state))
        return self.states[state]

    def edits(self, word: str) -> int:
        """Least edits between the word and a term that allows them; 0 for a word that begins with a stem; else 9."""
        if len(self.members) > 20_000:
            self._reset()
        at = 0
        for c in word:
            c = c if c in self.letters else "\0"
            nxt = self.moves[at].get(c)
            if nxt is None:
                nxt = self.moves[at][c] = self._move(at, c)
            if nxt < 0:
                return 0 if nxt == -2 else 9
            at = nxt
        return self.ends[at]

    def hits(self, chunks: set[str]) -> dict[str, int]:
        """Edits of those space-separated chunks that match."""
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        for chunk in chunks.difference(memo):
            word = normal(chunk)
            memo[chunk] = self.edits(word) if len(word) > 1 else 9
        return {c: e for c in chunks if (e := memo[c]) < 9}


def context_features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Hits as abuse (exact, misspelled), hits as quotation, addressed hits, the largest and summed window scores, density."""
    words = text.lower().split() if text else []
    hits = lexicon.hits(set(words))
    if not hits:
        return [0.0] * 7
    exact = fuzzy = quoted = addressed = 0
    scores = []
    for i, w in enumerate(words):
        edits = hits.get(w)
        if edits is None:
            continue
        around = words[max(0, i - WINDOW) : i + WINDOW + 1]
        near = {normal(x) for x in around}
        before = sum(x[0] in QUOTES for x in words[max(0, i - WINDOW) : i + 1])
        after = sum(x.rstrip(".,;:!?")[-1:] in QUOTES and x.rstrip(".,;:!?") != "" for x in words[i : i + WINDOW + 1])
        quote = bool(before and after) or not near.isdisjoint(REPORTING)
        direct = not near.isdisjoint(SECOND)
        score = (1.0, 0.8, 0.6)[edits] * (0.25 if quote else 1.0) * (1.25 if direct else 1.0)
        scores.append(score)
        quoted += quote
        addressed += direct
        exact += edits == 0 and not quote
        fuzzy += edits > 0 and not quote
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(addressed), max(scores), math.log1p(sum(scores)), 100 * sum(scores) / len(words)]


class Model:
    """The lexicon's terms and stems, and the regression's weights."""

    def __init__(self, terms: list[str], stems: list[str], weights: np.ndarray | None = None):
        self.terms, self.stems = terms, stems
        #: Without labels a single clear hit decides.
        self.weights = np.array([2.0, 0.5, 0.0, 0.5, 2.0, 2.0, 0.0, -3.0]) if weights is None else weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ self.weights, -50, 50)))


def regression(x: np.ndarray, y: np.ndarray, votes: np.ndarray | None = None, ridge: float = 0.1) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression, by Newton's steps; rows count by their ``votes``."""
    votes = np.ones(len(x)) if votes is None else votes
    x = np.hstack([x, np.ones((len(x), 1))])
    w, hold = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (votes * p * (1 - p))[:, None]).T @ x + hold, x.T @ (votes * (y - p)) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _classes():
    """Rows with the key of their class of copies: least hashes of the text's shingles."""
    seeds = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(1, MINIMA + 1)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for values in shingle_sets(batch.column("text")):
            keys.append(hash(tuple(int(mix(values ^ s).min()) for s in seeds)) if len(values) else 0)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "key"])

    return work


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, vote) of about ``rows`` labelled documents that aren't held out; copies share one vote."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chance = rows / max(1, known.count())
    uniform = F.xxhash64("doc_id", F.lit(29)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    ids = known.where(uniform < chance)  # about ``rows`` rows of two numbers, whatever the tables' size
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id")
    found = materialize(map_rows(found.select("text", "toxic"), _classes, "text string, toxic int, key long"), "toxic-sample")
    sizes = found.groupBy("key", "toxic").agg((1 / F.count("*")).alias("vote"))  # about ``rows`` rows
    return found.join(F.broadcast(sizes), ["key", "toxic"]).select("text", "toxic", "vote")


def _term_counts(sample: DataFrame) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic, vote in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "vote")), strict=True):
                words = {n for w in set(text.lower().split()) if len(n := normal(w)) > 1}
                stems = {w[:k] + "*" for w in words for k in STEMS if len(w) > k}
                side = counts[toxic > 0]
                for term in words | stems:
                    side[term] += vote
            terms = list(counts[0].keys() | counts[1].keys())
            cols = [pa.array(terms, pa.string()), *(pa.array([float(side[t]) for t in terms]) for side in reversed(counts))]
            return pa.RecordBatch.from_arrays(cols, ["term", "bad", "good"])

        return work

    return map_rows(sample, make, "term string, bad double, good double").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def significant(counts: DataFrame, bad_docs: float, good_docs: float) -> DataFrame:
    """Terms whose Chernoff bound beats chance at that level, and that are 50 times likelier in toxic documents (all by votes)."""
    base = bad_docs / max(1e-9, bad_docs + good_docs)
    n = F.col("bad") + F.col("good")
    p = F.col("bad") / n
    gain = n * (p * F.log(p / F.lit(base)) + F.when(p < 1 - 1e-9, (1 - p) * F.log((1 - p) / F.lit(1 - base))).otherwise(0.0))
    rate = (F.col("bad") / max(1, bad_docs)) / F.greatest(F.col("good") / max(1, good_docs), F.lit(0.01 / max(1, good_docs)))
    terms = counts.count()
    return counts.where("bad > 3.5").where((p > base) & (gain > math.log(max(3, terms / FALSE_TERMS))) & (rate > 50)).select("term", gain.alias("gain"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    sample = materialize(_sample(docs, labels, rows), "toxic-docs")
    sizes = {bool(r.t): r.n for r in sample.groupBy((F.col("toxic") > 0).alias("t")).agg(F.sum("vote").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return Model(SEEDS.split(), [])
    counts = materialize(_term_counts(sample), "toxic-terms")
    found = [r.term for r in significant(counts, sizes[True], sizes[False]).orderBy(F.desc("gain"), "term").collect()]  # of a bounded sample
    stems = sorted((t[:-1] for t in found if t.endswith("*")), key=len)
    short: list[str] = []
    for s in stems:
        if not any(s.startswith(x) for x in short):
            short.append(s)
    terms = [t for t in found if not t.endswith("*")]
    model = Model(sorted({*terms, *SEEDS.split()}), short)

    def make():
        lexicon = Lexicon(model.terms, model.stems)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [context_features(t, lexicon) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic"), batch.column("vote")], ["x", "toxic", "vote"])

        return work

    got = map_rows(sample, make, "x array<double>, toxic int, vote double").collect()  # about ``rows`` rows
    model.weights = regression(np.array([r.x for r in got]), np.array([r.toxic > 0 for r in got], float), np.array([r.vote for r in got]))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    def make():
        lexicon = Lexicon(model.terms, model.stems)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = model.score(np.array([context_features(t, lexicon) for t in batch.column("text").to_pylist()]))
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on labelled rows that aren't held out, score all."""
    return predict(docs, fit(docs, labels, rows))
