"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is a trie of whole terms and of stems (any word that begins so).
Its product with the Levenshtein automata of all terms is walked lazily: a
state is a set of (trie node, edits so far), found once per state and
character and kept, so that a word costs a few table look-ups and most words
leave the automaton after two or three characters.  A term of 5 letters or
more tolerates one edit, of 8 or more two; stems are exact, and stand beside the
terms that begin so.

Hits are scored in their context window: hits between quotation marks or
beside reporting verbs count as quotation, hits with other hits or address
("you") near them as abuse.  A logistic regression over these counts gives
the score.

The lexicon and the weights are learned from a bounded sample of the
labelled rows: at most ``per_class`` rows of each class, chosen by a hash of
the id, equal texts once.  Terms are words and word beginnings that mark the class; their
counts are combined in Spark; the lexicon, which comes to the driver, has at
most ``max_terms`` of them, the clearest first.
For the weights the sample is cut into halves, and each is measured with the
lexicon of the other, so that a term's chance luck earns it no trust.

Defined cases: a null or empty text has no hits and the score of that; ids
and labels that are null are not learned from; without labels of both classes
every score is ``0.0``; repeated rows give repeated results; an empty table
gives an empty result.  Only the id and text columns enter a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows

EDGES = ".,;:!?\"'()[]{}<>|#$%&*+=~`_-/\\“”‘’«»"
QUOTES = "\"“”«»„"
# Words that report speech, and words of address.
REPORTING = frozenset("said says say wrote writes called calls quote quoted word term phrase insult sagte schrieb zitat dit cita dijo".split())
ADDRESS = frozenset("you your youre yourself u du dich dein tu toi vous te ti usted".split())
WINDOW = 6
OTHER = "\x00"
WHOLE, FUZZY, STEM = 1, 2, 3
STEM_LENGTHS = (4, 5)
N_FEATURES = 7


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Lexicon:
    """Trie of terms and stems with its Levenshtein product automaton."""

    def __init__(self, words: Iterable[str], stems: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_end: dict[int, int] = {}  # node: edits its term tolerates
        self.stem_end: set[int] = set()
        self.budget = [0]  # most edits that any term below tolerates
        for term in sorted(set(words)):
            if term:
                self.word_end[self._add(term, edits_allowed(term))] = edits_allowed(term)
        for stem in sorted(set(stems)):
            if stem:
                self.stem_end.add(self._add(stem, 0))
        self.alphabet = {c for kids in self.children for c in kids}
        self._ids: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.stops: list[bool] = []
        self.start = self._state({(0, 0)})

    def _add(self, term: str, edits: int) -> int:
        node = 0
        self.budget[0] = max(self.budget[0], edits)
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.budget.append(0)
            node = self.children[node][c]
            self.budget[node] = max(self.budget[node], edits)
        return node

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The id of a set of (node, edits), closed under skipped letters and
        without items that a smaller number of edits makes needless; -1 for
        the empty set."""
        best: dict[int, int] = {}
        todo = sorted(items, key=lambda x: x[1])
        while todo:
            node, e = todo.pop(0)
            if e > self.budget[node] or best.get(node, e + 1) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append(key)
            self.moves.append({})
            ends = [e for node, e in key if e <= self.word_end.get(node, -1)]
            self.stops.append(any(node in self.stem_end and e == 0 for node, e in key))
            self.accepts.append((WHOLE if min(ends) == 0 else FUZZY) if ends else 0)
        return self._ids[key]

    def _move(self, state: int, c: str) -> int:
        items = set()
        for node, e in self._sets[state]:
            kids = self.children[node]
            if c in kids:
                items.add((kids[c], e))
            if e < self.budget[node]:
                items.add((node, e + 1))  # a letter too many
                items.update((child, e + 1) for child in kids.values())  # another letter
        to = self.moves[state][c] = self._state(items)
        return to

    def match(self, word: str) -> int:
        """WHOLE, FUZZY (within the term's edits), STEM, or 0."""
        state, moves, alphabet = self.start, self.moves, self.alphabet
        if not self.alphabet:
            return 0
        stem = 0
        for c in word:
            if c not in alphabet:
                c = OTHER
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return stem
            if self.stops[state]:
                stem = STEM  # unless a term that begins so takes the word
        return self.accepts[state] or stem


def plain(word: str) -> str:
    return word.strip(EDGES)


class Words:
    """What the lexicon says of words, kept for those seen before."""

    LIMIT = 300_000

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.seen: set[str] = set()
        self.hits: dict[str, int] = {}

    def among(self, words: set[str]) -> set[str]:
        """Those of the words that hit the lexicon."""
        if len(self.seen) > self.LIMIT:
            self.seen.clear()
            self.hits.clear()
        new = words - self.seen
        for w in new:
            kind = self.lexicon.match(plain(w))
            if kind:
                self.hits[w] = kind
        self.seen |= new
        return words & self.hits.keys()


@lru_cache(maxsize=4)
def lexicon_words(words: tuple[str, ...], stems: tuple[str, ...]) -> Words:
    """One automaton per worker process, whatever the number of its tasks."""
    return Words(Lexicon(words, stems))


def features(text: str, known: Words) -> list[float]:
    """Counts of hits by kind and context."""
    words = text.lower().split()
    found = known.among(set(words))
    if not found:
        return [0.0] * N_FEATURES
    kinds = [known.hits[w] if w in found else 0 for w in words]
    hits = [i for i, k in enumerate(kinds) if k]
    n = Counter()
    # quotation marks so far, to see whether a hit stands between two
    marks = np.zeros(len(words), dtype=int)
    if any(q in text for q in QUOTES):
        marks = np.cumsum([sum(w.count(q) for q in QUOTES) for w in words])
    for i in hits:
        near = [plain(w) for w in words[max(0, i - WINDOW):i + WINDOW + 1]]
        before = int(marks[i - 1]) if i else 0
        quoted = before % 2 == 1 and int(marks[-1]) > before or sum(words[i].count(q) for q in QUOTES) >= 2
        if quoted or any(w in REPORTING for w in near):
            n["quoted"] += 1
            continue
        n[kinds[i]] += 1
        n["address"] += any(w in ADDRESS for w in near)
        n["company"] += any(kinds[j] for j in range(max(0, i - 4 * WINDOW), min(len(kinds), i + 4 * WINDOW + 1)) if j != i)
    abuse = n[WHOLE] + n[FUZZY] + n[STEM]
    return [
        math.log1p(n[WHOLE]), math.log1p(n[FUZZY]), math.log1p(n[STEM]), math.log1p(n["quoted"]),
        math.log1p(n["address"]), math.log1p(n["company"]), float(abuse + n["quoted"] >= 2),
    ]


def candidate_terms(text: str) -> set[str]:
    """Words of a text, as ``=word``, and beginnings of longer ones, as
    ``^stem``."""
    words = {plain(w) for w in text.lower().split()}
    return {f"={w}" for w in words if 3 <= len(w) <= 24} | {
        f"^{w[:n]}" for w in words for n in STEM_LENGTHS if len(w) > n
    }


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (intercept last) by Newton steps on the penalised likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(docs, labels, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``label, text, half`` of at most ``per_class`` rows of each class outside the
    held-out fold, smallest hashes of the id first."""
    clean = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("label")).where(
        "_id is not null and label in (0, 1)"
    ).where(~held_out("_id")).dropDuplicates(["_id"])
    order = [F.xxhash64("_id"), F.col("_id")]
    some = None
    for label in (0, 1):
        part = clean.where(F.col("label") == label).orderBy(*order).limit(per_class)
        some = part if some is None else some.unionByName(part)
    # at most 2 * per_class rows of two numbers: bounded, so broadcast
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(some), "_id"
    ).dropDuplicates(["label", "text"]).select("label", "text", (F.xxhash64("_id") % 2 == 0).alias("half"))


def held_out(id_col: str):
    """The held-out fold: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn_lexicon(sample: DataFrame, min_rows: int = 4, min_odds: float = 3.5, max_terms: int = 50_000) -> tuple[list[str], list[str]]:
    """(words, stems) that mark class 1 in the sample."""
    def run(batches):
        for batch in batches:
            counts = Counter()
            for label, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts.update((t, label) for t in candidate_terms(text or ""))
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in counts]), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())],
                    names=["term", "label", "n"],
                )

    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return [], []
    share = [
        (F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)) + 0.5) / (classes[y] + 1.0) for y in (0, 1)
    ]
    marked = (
        sample.select("label", "text").mapInArrow(run, "term string, label int, n long")
        .groupBy("term").agg(
            F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("rows"),
            F.log(share[1] / share[0]).alias("odds"),
        )
        .where((F.col("rows") >= min_rows) & (F.col("odds") >= min_odds))
        .orderBy(F.desc("odds"), F.desc("rows"), "term").limit(max_terms).collect()
    )
    words = {r["term"][1:]: r["rows"] for r in marked if r["term"][0] == "="}
    found = {r["term"][1:]: r["rows"] for r in marked if r["term"][0] == "^" and r["rows"] >= 2 * min_rows}
    # a stem must be more than the beginning of one marked word, and no
    # shorter stem may begin it
    stems: set[str] = set()
    for stem in sorted(found, key=lambda s: (len(s), s)):
        one = max((n for w, n in words.items() if w.startswith(stem)), default=0)
        if found[stem] > 1.3 * one and not any(stem.startswith(s) for s in stems):
            stems.add(stem)
    # the words stay beside their stems: a misspelling inside the stem is theirs
    return sorted(words), sorted(stems)


def _measure(words, stems, seed_words):
    terms = tuple(sorted({*words, *seed_words})), tuple(stems)

    def make():
        known = lexicon_words(*terms)
        return lambda label, text: (label, features(text or "", known))

    return make


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 4000,
    seed_words: Iterable[str] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted, hits`` (the words
    that hit the lexicon)."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", per_class, id_col, text_col).cache()
    halves = [sample.where(F.col("half") == h) for h in (True, False)]
    rows = []
    for own, other in (halves, halves[::-1]):
        learned = learn_lexicon(other)
        rows += map_rows(own.select("label", "text"), "label int, x array<double>", _measure(*learned, seed_words)).collect()
    words, stems = learn_lexicon(sample)
    terms = tuple(sorted({*words, *seed_words})), tuple(stems)
    sample.unpersist()
    y = np.array([r["label"] for r in rows], dtype=float)
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), N_FEATURES)
    both = len(set(y)) == 2
    weights = fit_logistic(x, y) if both else np.zeros(N_FEATURES + 1)

    def make():
        known = lexicon_words(*terms)

        def row(doc_id, text):
            text = text or ""
            v = features(text, known)
            score = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(v, weights[:-1]) + weights[-1]))))) if both else 0.0
            hits = sorted({plain(w) for w in known.among(set(text.lower().split()))}) if any(v) else []
            return doc_id, score, int(score >= 0.5), hits

        return row

    scored = map_rows(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")),
        "doc_id long, score double, predicted int, hits array<string>", make,
    )
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "hits")
