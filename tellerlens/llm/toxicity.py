"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of context windows.

The lexicon is learned from labelled rows: whole words and stems that occur in toxic texts far more often than chance.
All terms form one trie. The automata of all terms run over it together, as one automaton whose states are made when
first needed: a state is a set of (trie node, edits), so a word is matched in one pass and most words die after a few
letters. Terms of 5 letters allow one edit, of 9 two; a swap of neighbours is one edit. Close words that clean labelled
texts use are innocent. A term must have different neighbours in the toxic texts, before it as well as after it
(``CONTEXTS`` effective ones, the inverse of the chance that two uses have the same; or ``VARIED`` ones in all, should
one text of many copies make up most uses): the words of a set phrase, and the invented words of a text that is labelled
in many copies, would otherwise look toxic. Uses at the very start or end of a text have no neighbour there, and a side
with few neighbours is not judged.

Hits are weighed by their window: a hit inside quotation marks counts as quotation, a hit with other hits near it as
abuse. A logistic model over these sums gives the score. It starts from prior weights, so quotation counts less even
where the labels hold none.

Bounds: lexicon and model are fitted on at most ``sample_rows`` labelled rows of each class, chosen by hash. Of the
sample's words and stems the ``candidates`` most frequent are tried, and ``terms`` at most enter the lexicon; as many
close words as ``candidates`` can be innocent, the most frequent first. All three are parameters of ``fit``, all ties go
by the word, so two fits agree. Scores cover all rows, whole texts. What a task remembers goes with the task.

Rows: a null or empty text has no hits and gets the model's score for none; null ids are never held out; equal rows get
equal scores; labels without a text, or null labels, are ignored; without both classes the prior weights hold and the
lexicon is empty. Other columns pass through ``keep_clean`` and are ignored elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ship, stored

#: Most labelled rows of either class that the lexicon and the model are fitted on.
SAMPLE_ROWS = 20_000
#: Defaults of ``fit``: most terms that are counted in clean texts, and most that enter the lexicon.
CANDIDATES, TERMS = 50_000, 2_000
STEMS = range(4, 13)
#: Fewest effective neighbours of a term on either side; or fewest in all, and as a share of its uses there.
CONTEXTS, VARIED, VARIED_SHARE = 4.0, 30, 0.25
#: A term's neighbours are the words so many places before and after it, beyond a set phrase, or else the first and last.
BESIDE = 5
#: Most words that a task remembers.
KNOWN = 150_000
WINDOW = 8
QUOTED_WITHIN = 25
#: Digits and signs that stand for letters inside a word, and marks that open and close quotations (fixed values).
LOOKALIKES = str.maketrans("013457@$", "oieastas")
OPENING, CLOSING = "\"“„«‹‘'>", "\"”“»›’'"
#: Bias and weight of each feature before any label is seen.
PRIOR = np.array([-3.0, 1.2, 1.0, 0.8, 0.3, 0.8, 0.0])


def held_out(doc_id: Column) -> Column:
    """Rows never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def plain(word: str) -> str:
    """Lower case, without marks at the ends or signs inside; lookalikes as letters."""
    word = re.sub(r"^\W+|[\W_]+$", "", word.lower())
    if not word.isalpha():
        word = "".join(c for c in word.translate(LOOKALIKES) if c.isalpha())
    return word


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """Terms (``word`` or ``stem*``) as a trie, and the automaton over it."""

    def __init__(self, terms: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.most = [0]  # edits that some term below a node allows
        self.least: list[int] = []
        for i, term in enumerate(terms):
            text, node = term.rstrip("*"), 0
            k = edits(text) if not term.endswith("*") else 0  # stems are matched exactly, inflections may follow
            self.least.append(k)
            self.most[0] = max(self.most[0], k)
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], k)
            (self.stem if term.endswith("*") else self.whole)[node] = i
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.ends: list[tuple[int, int] | None] = []
        self.stems: list[int | None] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, found: set[tuple[int, int, str]]) -> int:
        todo, best = list(found), {}
        while todo:  # letters of a term left out, at one edit each
            node, e, wait = todo.pop()
            if best.get((node, wait), 9) <= e:
                continue
            best[node, wait] = e
            if not wait:
                todo += [(n, e + 1, "") for n in self.next[node].values() if e < self.most[n]]
        key = frozenset((n, e, w) for (n, w), e in best.items())
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
            ends = [(e, self.whole[n]) for n, e, w in key if not w and n in self.whole and e <= self.least[self.whole[n]]]
            self.ends.append(min(ends) if ends else None)
            self.stems.append(min((self.stem[n] for n, e, w in key if not w and e == 0 and n in self.stem), default=None))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        found: set[tuple[int, int, str]] = set()
        for node, e, wait in self.items[state]:
            if wait:
                if c == wait:
                    found.add((node, e, ""))
                continue
            if c in self.next[node]:
                found.add((self.next[node][c], e, ""))
            if e < self.most[node]:
                found.add((node, e + 1, ""))  # a letter too many
                for d, n in self.next[node].items():
                    if e < self.most[n]:
                        found.add((n, e + 1, ""))  # another letter
                        if d != c and c in self.next[n]:
                            found.add((self.next[n][c], e + 1, d))  # neighbours swapped
        return self._state(found)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term, or none."""
        state, stem = self.start, None
        for c in word:
            to = self.moves.get((state, c))
            if to is None:
                to = self.moves[state, c] = self._move(state, c)
            state = to
            if stem is None:
                stem = self.stems[state]
            if not self.items[state]:
                break
        if stem is not None:
            return (0, stem)
        return self.ends[state]


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    term_weights: tuple[float, ...]
    innocent: tuple[str, ...]
    weights: tuple[float, ...]


@cache
def _tools(terms: tuple[str, ...], innocent: tuple[str, ...]) -> tuple[Matcher, frozenset[str], dict[str, tuple[int, int] | None]]:
    return Matcher(list(terms)), frozenset(innocent), {}


def matches(words: list[str], model: Model) -> list[tuple[int, int] | None]:
    matcher, innocent, known = _tools(model.terms, model.innocent)
    if len(matcher.items) > 20_000:  # states and words are made again when needed
        _tools.cache_clear()
        matcher, innocent, known = _tools(model.terms, model.innocent)
    elif len(known) > KNOWN:
        known.clear()
    out = []
    for word in words:
        if word not in known:
            p = plain(word)
            m = matcher.match(p) if p else None
            known[word] = None if m and m[0] and p in innocent else m
        out.append(known[word])
    return out


def quoted(words: list[str], at: int) -> bool:
    """Whether a mark opens before the word and one closes after it, both near and neither answered in between."""
    before = range(at, max(-1, at - QUOTED_WITHIN), -1)
    opens = next((i for i in before if words[i][:1] and words[i][0] in OPENING), None)
    if opens is None or any(words[i].rstrip(".,;:!?")[-1:] in tuple(CLOSING) for i in range(opens, at) if len(words[i]) > 1):
        return False
    return any(words[i].rstrip(".,;:!?")[-1:] in tuple(CLOSING) for i in range(at, min(len(words), at + QUOTED_WITHIN)))


def features(words: list[str], hits: list[tuple[int, tuple[int, int]]], weights: tuple[float, ...]) -> tuple[np.ndarray, int]:
    """Features of a text from its words and its hits (place, match); and how many hits are quoted."""
    exact: dict[str, float] = {}
    close: dict[str, float] = {}
    said: dict[str, float] = {}
    open_hits = []
    for at, (e, term) in hits:
        word = plain(words[at])
        if quoted(words, at):
            said[word] = weights[term]
        else:
            (close if e else exact)[word] = weights[term]
            open_hits.append(at)
    near = sum(1 for a, b in zip(open_hits, open_hits[1:], strict=False) if b - a <= WINDOW)
    dense = len(open_hits) / math.sqrt(len(words) + 100.0) if words else 0.0
    return np.array([1.0, sum(exact.values()) ** 0.5, math.log1p(len(exact)), sum(close.values()) ** 0.5, sum(said.values()) ** 0.5, dense + 0.2 * near, math.log1p(len(words)) - 5]), len(said)


def _slices(batch: pa.RecordBatch, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, whose last column holds the words of each text, with so many words each, or one text."""
    ends, start = batch.column(batch.num_columns - 1).offsets.to_numpy(), 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or ends[i + 1] - ends[start] > most:
            yield batch.slice(start, i - start)
            start = i


def _batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[int], list[list[str]]]]:
    try:
        yield from _scored_batches(batches, model)
    finally:  # workers outlive their tasks: nothing stays for the stages to come
        _tools.cache_clear()


def _scored_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[int], list[list[str]]]]:
    for batch in (part for whole in batches for part in _slices(whole)):
        pieces = batch.column(batch.num_columns - 1)
        offsets = pieces.offsets.to_numpy()
        found = pc.dictionary_encode(pieces.values.slice(offsets[0], offsets[-1] - offsets[0]))
        offsets = offsets - offsets[0]
        index, names = found.indices.to_numpy(), found.dictionary.to_pylist()
        match = matches(names, model)
        hit = np.array([m is not None for m in match], bool)
        places = np.flatnonzero(hit[index]) if len(names) else np.array([], int)
        bounds = np.searchsorted(places, offsets)
        x = np.zeros((batch.num_rows, len(PRIOR)))
        said, terms = [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
        for i in range(batch.num_rows):
            start, end = offsets[i], offsets[i + 1]
            own = places[bounds[i] : bounds[i + 1]]
            words = [names[j] for j in index[start:end]] if len(own) else []
            hits = [(int(p - start), match[index[p]]) for p in own]
            x[i], said[i] = features(words, hits, model.term_weights)
            x[i, -1] = math.log1p(end - start) - 5 if hits else 0.0  # length weighs hits only
            terms[i] = sorted({model.terms[t] for _, (_, t) in hits})
        yield batch, x, said, terms


def chance(x: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights), -30, 30)))


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


class Forms(dict):
    """word: its terms (itself and its stems), of the given ones only if there are such."""

    def __init__(self, given: frozenset[str] | None) -> None:
        super().__init__()
        self.given = given

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > KNOWN:
            self.clear()
        w = plain(word)
        forms = (w, *(w[:n] + "*" for n in STEMS if n <= len(w))) if len(w) >= STEMS[0] else ()
        self[word] = forms if self.given is None else tuple(f for f in forms if f in self.given)
        return self[word]


def _term_counts(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])


def _counts(rows: DataFrame, candidates: list[str] | None) -> DataFrame:
    """term, n: texts that hold each word or stem; of the candidates only, if given."""
    given = None if candidates is None else rows.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        forms = Forms(None if given is None else given.value)
        for words in (w for whole in batches for batch in _slices(whole) for w in batch.column("words_").to_pylist()):
            total.update({f for w in set(words) for f in forms[w]})
            if len(total) > 300_000:
                yield _term_counts(total)
                total.clear()
        yield _term_counts(total)

    return rows.select(word_array(F.col("text")).alias("words_")).mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _contexts(rows: DataFrame, candidates: list[str]) -> DataFrame:
    """term, varied: whether each side on which the term has neighbours enough shows different ones, and there is such a side."""
    given = rows.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(given.value)
        for words in (w for whole in batches for batch in _slices(whole) for w in batch.column("words_").to_pylist()):
            last = len(words) - 1
            found = [(f, i) for i, w in enumerate(words) for f in forms[w]]
            sides = [(f, 0, words[max(0, i - BESIDE)]) for f, i in found if i] + [(f, 1, words[min(last, i + BESIDE)]) for f, i in found if i < last]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in sides], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["term", "side", "beside"])

    found = rows.select(word_array(F.col("text")).alias("words_")).mapInArrow(uses, "term string, side int, beside string")
    same = found.groupBy("term", "side", F.xxhash64("beside").alias("context")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sides = same.groupBy("term", "side").agg(F.sum("n").alias("uses"), (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("spread"), F.count(F.lit(1)).alias("kinds"))
    varied = (F.col("spread") >= CONTEXTS) | ((F.col("kinds") >= VARIED) & (F.col("kinds") >= VARIED_SHARE * F.col("uses")))
    return sides.filter(F.col("uses") >= CONTEXTS).groupBy("term").agg(F.bool_and(varied).alias("varied"))


def scored_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, tuple[float, float]]:
    """(gain, weight) of the terms that tell toxic texts from clean ones: likelihood ratio and log odds."""
    base, scored = n_toxic / (n_toxic + n_clean), {}
    for term, t in toxic.items():
        c = clean.get(term, 0)
        rate = t / (t + c)
        if rate <= 2 * base and rate < 0.9:
            continue
        gain = t * math.log(rate / base) + (c * math.log((1 - rate) / (1 - base)) if c else 0.0)
        weight = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        if gain > math.log(len(toxic) + 1) + 3 and weight > 0.5:  # beyond what the best of so many terms reaches by chance
            scored[term] = round(gain, 6), weight
    return scored


def select_terms(scored: dict[str, tuple[float, float]], most: int = TERMS) -> list[tuple[str, float]]:
    """(term, weight) by gain, each family of nested words and stems once."""
    taken: list[tuple[str, float]] = []
    texts: list[str] = []
    for term in sorted(scored, key=lambda t: (-scored[t][0], t.endswith("*"), -len(t), t)):
        text = term.rstrip("*")
        if len(taken) < most and not any(text.startswith(o) or o.startswith(text) for o in texts):
            taken.append((term, scored[term][1]))
            texts.append(text)
    return taken


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
    candidates: int = CANDIDATES, terms: int = TERMS,
) -> Model:
    """Learn from labelled rows that are not held out."""
    ship(docs.sparkSession)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, sample_rows / max(1, sizes.get(1, 0))).otherwise(sample_rows / max(1, sizes.get(0, 0)))
    sample = F.broadcast(known.filter(bucket < share * 1_000_000))  # about 2 * sample_rows rows at most
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(sample, "doc_id").select("text", "toxic"))
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model((), (), (), tuple(PRIOR))
    seen = _counts(rows.filter("toxic = 1"), None).filter(F.col("n") >= 4).orderBy(F.desc("n"), "term").limit(candidates)
    toxic = {r[0]: r[1] for r in seen.collect()}
    clean = {r[0]: r[1] for r in _counts(rows.filter("toxic = 0"), list(toxic)).collect()}
    scored = scored_terms(toxic, clean, n[1], n[0])
    varied = _contexts(rows.filter("toxic = 1"), list(scored)).filter("varied")
    taken = select_terms({r[0]: scored[r[0]] for r in varied.select("term").collect()}, terms)
    draft = Model(tuple(t for t, _ in taken), tuple(w for _, w in taken), (), tuple(PRIOR))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        try:
            for batch in (part for whole in batches for part in _slices(whole)):
                counts = pc.value_counts(batch.column("words_").flatten())
                words, n = counts.field("values").to_pylist(), counts.field("counts").to_pylist()
                for w, k, m in zip(words, n, matches(words, draft), strict=True):
                    if m and m[0]:
                        found[plain(w)] += k
        finally:
            _tools.cache_clear()
        yield _term_counts(found)

    words = rows.filter("toxic = 0").select(word_array(F.col("text")).alias("words_"))
    near = words.mapInArrow(close, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    innocent = sorted(r[0] for r in near.orderBy(F.desc("n"), "term").limit(candidates).collect())
    model = Model(draft.terms, draft.term_weights, tuple(innocent), tuple(PRIOR))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, _, _ in _batches(batches, model):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    pairs = rows.select(F.col("toxic").cast("int"), word_array(F.col("text")).alias("words_")).mapInArrow(measure, "toxic int, x array<double>")
    sums = pairs.groupBy("toxic", "x").count().orderBy("toxic", "x").collect()
    x, y, m = np.array([r[1] for r in sums]), np.array([r[0] for r in sums], float), np.array([r[2] for r in sums], float)
    w = PRIOR.copy()
    for _ in range(50):  # Newton steps towards the labels, held near the prior
        p = chance(x, tuple(w))
        step = np.linalg.solve((x * (m * p * (1 - p))[:, None]).T @ x + 2 * np.eye(len(w)), x.T @ (m * (y - p)) - 2 * (w - PRIOR))
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        w[-1] = min(w[-1], 0.0)  # length alone never makes a text toxic, however far beyond the labelled ones
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.terms, model.term_weights, model.innocent, tuple(np.round(w, 9).tolist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, terms, n_quoted of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, said, terms in _batches(batches, model):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chance(x, model.weights)), pa.array(terms, pa.list_(pa.string())), pa.array(said, pa.int32())], names=["doc_id", "score", "terms", "n_quoted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), word_array(F.col(text_col)).alias("words_")).mapInArrow(run, f"doc_id {kind}, score double, terms array<string>, n_quoted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all their columns, whose score is below one half."""
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, _, _ in _batches(batches, model):
            yield batch.select(names).filter(pa.array(chance(x, model.weights) < 0.5))

    free = "words_" + "_" * max(map(len, names))  # no column of the documents has this name
    return docs.select("*", word_array(F.col(text_col)).alias(free)).mapInArrow(run, docs.schema)
