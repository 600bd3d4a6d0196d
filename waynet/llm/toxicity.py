"""Toxicity by Levenshtein automata over a lexicon trie, with scores of context windows.

The lexicon holds words, and stems of words, that come nearly only with toxic labels. The words of
several texts run at once along those paths of the trie whose terms share a shortened head with them, by the
terms' Levenshtein automata, so misspelled terms are found however many terms there are. A stem (written
with a star) takes any ending and no edit. The words and quotes around a hit
tell quotation from abuse; a logistic model weighs the counts.

A null text counts as empty, and a text without a hit gets the model's lowest score. Scores
depend on the text alone, so repeated rows score alike. An empty table gives an empty result; columns besides the id and
the text are not read. A long text is one list of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waynet.llm.common import bounded_sample, released, whole_text

#: Bound of the fit: labelled rows of each class. It bounds the terms too.
ROWS_PER_CLASS = 6000
#: A term is in this many toxic texts at least, and this share of its texts is toxic when classes weigh alike.
LEAST_TEXTS, LEAST_SHARE = 3, 0.95
#: The same for a stem, and the letters that a stem may have.
STEM_TEXTS, STEM_SHARE, STEM_LETTERS = 8, 0.98, (4, 5, 6)
#: Words on each side of a hit that make its context.
WINDOW = 6
STATES, REMEMBERED = 100_000, 300_000
#: Letters of texts whose words are sifted at once; a longer text is sifted alone.
SIFTED = 1_000_000

#: Words that report speech, and words that address a reader, in English, German, French and Spanish.
REPORTS = {"called", "calling", "calls", "quote", "quoted", "said", "saying", "says", "term", "word", "wrote", "genannt", "sagt", "sagte", "wort", "appelle", "disait", "dit", "mot", "dice", "dijo", "palabra"}
ADDRESSES = {"you", "your", "youre", "du", "dich", "dein", "ihr", "tu", "ton", "vous", "votre", "eres", "usted"}
QUOTES = "\"'“”„«»‘’"

_WORD = re.compile(r"\w+")
FEATURES = ["abuse_any", "abuse_log", "abuse_misspelled_any", "abuse_misspelled_log", "quoted_log", "addressed_log"]


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 or term[-1] == "*" else 1 if len(term) < 10 else 2


#: Letters from the start of a word and a term whose shortened forms are compared before the automaton runs.
HEAD = 10


def _shortened(word: str, edits: int) -> set[str]:
    """The word's head without that many letters or fewer.

    Words within so many edits have one in common: leaving out each letter that the least edits leave out, put in or change
    makes both equal, and what stands in one's head but not in the other's is left out within the same number.
    """
    head = word[:HEAD]
    return {"".join(c) for n in range(max(0, len(head) - edits), len(head) + 1) for c in combinations(head, n)}


#: Odd multipliers of the letters' places in hashes of shortened heads, the bits of a hash that mark it, and words hashed at a time.
_TIMES = np.cumprod(np.full(HEAD, 11400714819323198485, np.uint64))
MARK_BITS, HASHED = 24, 16_384
#: Words and terms put side by side at a time, but for one shortened head's.
PAIRS = 1 << 20
#: Letters of a path whose states fit the bits of a number, and what stands for more edits than a term allows.
STEPS, FAR = 62, 9


def _letters(words: list[str] | np.ndarray, most: int) -> np.ndarray:
    """A row for each word: its first letters, zeros after the last."""
    return np.array(words, f"U{most}").view(np.uint32).reshape(len(words), most)


def _codes(words: list[str]) -> np.ndarray:
    return _letters(words, HEAD).astype(np.uint64)


def _hashes(codes: np.ndarray, length: int, edits: int) -> np.ndarray:
    """A row for each head of that length: the hashes of what _shortened would give."""
    kept = [c for n in range(max(0, length - edits), length + 1) for c in combinations(range(length), n)]
    weights = np.zeros((length, len(kept)), np.uint64)
    for k, c in enumerate(kept):
        weights[list(c), k] = _TIMES[: len(c)]
    return codes[:, :length] @ weights


def _accept(words: np.ndarray, sizes: np.ndarray, paths: np.ndarray, depths: np.ndarray, edits: int) -> np.ndarray:
    """The least edits of each word (a row of letters) to the trie's path beside it (a row of letters, STEPS at most), FAR if these are more than so many.

    The Levenshtein automata of all paths take a letter of their words at a time. A state is a bit: bit i of reached[e] says that the
    path's first i letters are passed with e edits.
    """
    one, bits = np.uint64(1), np.uint64(2) << np.arange(paths.shape[1], dtype=np.uint64)
    reached = [np.full(len(words), (2 << e) - 1, np.uint64) for e in range(edits + 1)]
    for k in range(int(sizes.max(initial=0))):
        here, going = (paths == words[:, k : k + 1]) @ bits, k < sizes
        before = reached
        reached = [(before[0] << one) & here]
        for e in range(1, edits + 1):  # a letter met, a letter too many, another letter, a letter left out
            reached.append(((before[e] << one) & here) | before[e - 1] | (before[e - 1] << one) | (reached[e - 1] << one))
        reached = [np.where(going, now, old) for now, old in zip(reached, before)]
    least = np.full(len(words), FAR)
    for e in range(edits, -1, -1):
        least[(reached[e] >> depths.astype(np.uint64)) & one == one] = e
    return least


class TermAutomaton:
    """The trie of the terms, run with Levenshtein automata: a state is a set of (trie node, edits so far).

    A word can be accepted with an edit only by terms that share a shortened head with it. So the words of several texts run along
    the trie's paths to these terms alone, which costs no more where the trie has many others; walk() runs one over the whole trie.
    """

    def __init__(self, terms: list[str]):
        self.exact = {t for t in terms if t[-1] != "*"}
        self.begun = {t[:-1] for t in terms if t[-1] == "*"}
        self.begun_letters = sorted({len(t) for t in self.begun})
        self.heads: dict[int, set[str]] = {}
        for term in self.exact:
            if edits := allowed_edits(term):
                self.heads.setdefault(edits, set()).update(_shortened(term, edits))
        self.least = {e: min(len(t) - e for t in self.exact if allowed_edits(t) == e) for e in self.heads}
        self.next: list[dict[str, int]] = [{}]
        self.ends, self.most = [-1], [-1]
        self.stems: set[int] = set()
        for term in sorted(set(terms)):
            node, edits = 0, allowed_edits(term)
            self.most[0] = max(self.most[0], edits)
            for c in term.rstrip("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                    self.most.append(-1)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], edits)
            self.ends[node] = max(edits, self.ends[node])
            if term[-1] == "*":
                self.stems.add(node)
        self._mark()
        self._forget()

    def _mark(self) -> None:
        """The hashes of the terms' shortened heads and the terms of each, and marks that tell for most words that they have none of these."""
        self.paths: dict[int, np.ndarray] = {}
        self.marks, self.shared = {}, {}
        for edits in self.heads:
            terms = sorted(t for t in self.exact if allowed_edits(t) == edits)
            self.paths[edits] = np.array(terms)
            codes, sizes = _codes(terms), np.array([len(t) for t in terms])
            hashes, owners = [], []
            for length in np.unique(np.minimum(sizes, HEAD)):
                own = np.flatnonzero(np.minimum(sizes, HEAD) == length)
                found = _hashes(codes[own], int(length), edits)
                hashes.append(found.ravel())
                owners.append(np.repeat(own, found.shape[1]))
            hashes, owners = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(hashes, kind="stable")
            self.shared[edits] = hashes[order], owners[order]
            self.marks[edits] = np.zeros(1 << MARK_BITS, bool)
            self.marks[edits][hashes >> np.uint64(64 - MARK_BITS)] = True

    def _met(self, codes: np.ndarray, sizes: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words and of the terms of so many edits that share a shortened head with them and have about their length."""
        lengths, marks, (hashes, owners) = np.minimum(sizes, HEAD), self.marks[edits], self.shared[edits]
        longest = np.char.str_len(self.paths[edits])
        for length in np.unique(lengths):
            own = np.flatnonzero((lengths == length) & (sizes >= self.least[edits]))
            for block in (own[k : k + HASHED] for k in range(0, len(own), HASHED)):
                found = _hashes(codes[block], int(length), edits)
                at, form = np.nonzero(marks[found >> np.uint64(64 - MARK_BITS)])
                seen = found[at, form]
                first, last = np.searchsorted(hashes, seen, "left"), np.searchsorted(hashes, seen, "right")
                parts = np.cumsum(last - first) // PAIRS
                for part in np.split(np.arange(len(seen)), np.flatnonzero(np.diff(parts)) + 1):
                    begin, n = first[part], (last - first)[part]
                    term = owners[np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)]
                    word = np.repeat(block[at[part]], n)
                    fits = np.abs(sizes[word] - longest[term]) <= edits
                    both = np.unique(word[fits] * len(longest) + term[fits])
                    yield both // len(longest), both % len(longest)

    def near(self, words: list[str]) -> Iterator[tuple[str, int]]:
        """The words that a term accepts with an edit, and the least edits; none of the words is a term, or begins with a stem."""
        if not words:
            return
        codes, sizes = _codes(words), np.array([len(w) for w in words])
        letters, least = np.array(words), np.full(len(words), FAR)
        for edits, paths in self.paths.items():
            depths = np.char.str_len(paths)
            for word, term in self._met(codes, sizes, edits):
                long = depths[term] > STEPS
                for k in np.unique(word[long]).tolist():
                    if (found := self.walk(words[k])) >= 0:
                        least[k] = min(least[k], found)
                word, term = word[~long], term[~long]
                for w, t in ((word[k : k + HASHED], term[k : k + HASHED]) for k in range(0, len(word), HASHED)):
                    found = _accept(_letters(letters[w], int(sizes[w].max())), sizes[w], _letters(paths[t], int(depths[t].max())), depths[t], edits)
                    np.minimum.at(least, w, found)
        yield from ((words[k], int(least[k])) for k in np.flatnonzero(least < FAR))

    def accepted(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """The words with edits() of 0 and more, and these."""
        others, letters = [], self.begun_letters
        for word in words:
            if word in self.exact or not self.begun.isdisjoint([word[:n] for n in letters]):
                yield word, 0
            else:
                others.append(word)
        yield from self.near(others)

    def _forget(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.states = [self._closed({(0, 0)}) if self.most[0] >= 0 else frozenset()]
        self.numbers = {self.states[0]: 0}
        self.accepts = [self._edits(self.states[0])]
        self.whole = [False]

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the letters of a term that a word may leave out; without pairs that a better one covers."""
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or least.get(node, 9) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.next[node].values()]
        return frozenset(least.items())

    def _edits(self, state: frozenset) -> int:
        return min((e for node, e in state if e <= self.ends[node]), default=-1)

    def _step(self, number: int, c: str) -> int:
        pairs = set()
        for node, e in self.states[number]:
            pairs.add((node, e + 1))  # a letter too many
            for other, child in self.next[node].items():
                pairs.add((child, e if other == c else e + 1))
        state = self._closed(pairs)
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.accepts.append(self._edits(state))
            self.whole.append(any(e == 0 and node in self.stems for node, e in state))
        self.steps[number, c] = self.numbers[state]
        return self.numbers[state]

    def edits(self, word: str) -> int:
        """The least number of edits from the word to a term that allows so many, or -1."""
        if word in self.exact or any(word[:n] in self.begun for n in self.begun_letters):
            return 0
        if all(len(word) < self.least[e] or heads.isdisjoint(_shortened(word, e)) for e, heads in self.heads.items()):
            return -1
        return self.walk(word)

    def walk(self, word: str) -> int:
        """The same by the automaton alone."""
        if len(self.states) > STATES or len(self.steps) > 20 * STATES:
            self._forget()
        number, steps = 0, self.steps
        for c in word:
            key = (number, c)
            number = steps[key] if key in steps else self._step(number, c)
            if self.whole[number]:
                return 0
            if not self.states[number]:
                return -1
        return self.accepts[number]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("steps", "states", "numbers", "accepts", "whole", "marks", "shared", "paths")}

    def __setstate__(self, kept):
        self.__dict__.update(kept)
        self._mark()
        self._forget()


def _is_quoted(text: str, start: int, end: int) -> bool:
    """A quote opens within 80 characters before the hit, in its line, and one closes within 80 after it."""
    before, after = text[max(0, start - 80) : start].rpartition("\n")[2], text[end : end + 80].partition("\n")[0]
    opened = sum(before.count(q) for q in '"“”„«»')
    near = start > 0 and end < len(text) and text[start - 1] in QUOTES and text[end] in QUOTES
    return near or (opened % 2 == 1 and any(q in after for q in '"“”»«'))


class Sifted:
    """The words that were asked for, and the edits of those that a term accepts."""

    def __init__(self, automaton: TermAutomaton):
        self.automaton = automaton
        self.known: set[str] = set()
        self.hits: dict[str, int] = {}

    def among(self, words: set[str]) -> set[str]:
        """Those of the words that a term accepts; their edits are in hits."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.hits.clear()
        new = words - self.known
        self.hits.update(self.automaton.accepted(new))
        self.known |= new
        return words & self.hits.keys()


def _starts(text: str, words: list[str]) -> Iterator[int]:
    """Where these words of the text, all of their kinds and in order, stand as whole words."""
    inner = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    end = 0
    for word in words:
        start = text.find(word, end)
        while inner(start - 1) or inner(start + len(word)):
            start = text.find(word, start + 1)
        end = start + len(word)
        yield start


def features(text: str, sifted: Sifted) -> list[float] | None:
    """FEATURES of a text, or None without a hit."""
    return next(all_features([text], sifted))


def all_features(texts: list[str], sifted: Sifted) -> Iterator[list[float] | None]:
    """FEATURES of each text, or None without a hit. The words of several texts are sifted at once."""
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= SIFTED:
            size, last = size + len(texts[last]), last + 1
        words = [_WORD.findall(text) for text in texts[first:last]]
        found = sifted.among(set().union(*words))
        yield from (_features(text, own, found, sifted.hits) for text, own in zip(texts[first:last], words))
        first = last


def _features(text: str, words: list[str], found: set[str], edits: dict[str, int]) -> list[float] | None:
    hits = [i for i, word in enumerate(words) if word in found] if found else []
    if not hits:
        return None
    starts = _starts(text, [words[i] for i in hits])
    exact = misspelled = quoted = addressed = 0.0
    for i, start in zip(hits, starts):
        context = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        if _is_quoted(text, start, start + len(words[i])) or not REPORTS.isdisjoint(context[:WINDOW]):
            quoted += 1
        elif edits[words[i]]:
            misspelled += 1
        else:
            exact += 1
        addressed += not ADDRESSES.isdisjoint(context)
    return [exact > 0, np.log1p(exact), misspelled > 0, np.log1p(misspelled), np.log1p(quoted), np.log1p(addressed)]


class ToxicityModel:
    def __init__(self, automaton: TermAutomaton, weights: np.ndarray, bias: float):
        self.automaton, self.weights, self.bias = automaton, weights, bias

    def scores(self, texts: list[str], sifted: Sifted) -> list[float]:
        out = []
        for found in all_features(texts, sifted):
            out.append(1 / (1 + np.exp(-(self.bias + (0.0 if found is None else float(np.dot(found, self.weights)))))))
        return out


def lexicon(sample: DataFrame, n_toxic: int, n_clean: int, label: str = "label") -> list[str]:
    """Words and stems of the sample that come nearly only with the label, those in most texts first."""
    words = sample.select(F.col(label).alias("label"), F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("word"))
    toxic, clean = F.col("toxic") / max(1, n_toxic), (F.col("all") - F.col("toxic")) / max(1, n_clean)

    def sure(words: DataFrame, texts: int, share: float) -> list[str]:
        counts = words.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("label").alias("all"))
        kept = counts.where((F.col("toxic") >= texts) & (toxic / (toxic + clean) >= share))
        return [r["word"] for r in kept.orderBy(F.desc("toxic"), "word").collect()]

    terms = sure(words.where("word <> ''"), LEAST_TEXTS, LEAST_SHARE)
    begun = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")), lambda w: F.filter(F.array(*(F.when(F.length(w) > n, F.substring(w, 1, n)) for n in STEM_LETTERS)), lambda x: x.isNotNull()))))
    stems = sure(sample.select(F.col(label).alias("label"), F.explode(begun).alias("word")), STEM_TEXTS, STEM_SHARE)
    known = set(stems)
    return terms + [x + "*" for x in stems if not any(x[:n] in known for n in range(1, len(x)))]


#: The prior of the weights, towards which the fit is drawn: abuse counts, quotation doesn't.
PRIOR = np.array([3.0, 1.0, 1.5, 0.5, -1.0, 0.5])


def fit(labelled: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", totals: dict[int, int] | None = None) -> ToxicityModel:
    """Learns lexicon and weights from a bounded sample of labelled rows; totals are the classes' rows, if labelled is a sample already."""
    rows = labelled.where(F.col(label_col).isNotNull())
    drawn = {r[label_col]: r["count"] for r in rows.groupBy(label_col).count().collect()}
    sample = bounded_sample(rows, label_col, id_col, ROWS_PER_CLASS, 2).select(F.col(label_col).cast("int").alias("label"), whole_text(text_col).alias("text"))
    terms = lexicon(sample, min(ROWS_PER_CLASS, drawn.get(1, 0)), min(ROWS_PER_CLASS, drawn.get(0, 0)))
    totals = totals or drawn
    automaton = TermAutomaton(terms)
    shared = labelled.sparkSession.sparkContext.broadcast(automaton)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sifted = Sifted(shared.value)
        for batch in batches:
            found = [own or [0.0] * len(FEATURES) for own in all_features(batch.column("text").to_pylist(), sifted)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([[float(v) for v in f] for f in found], pa.list_(pa.float64()))], names=["label", "f"])

    # Equal rows are counted, so what reaches the driver is bounded by the sample and mostly far less.
    seen = sample.select("label", F.lower("text").alias("text")).mapInArrow(released(rows_of), "label int, f array<double>").groupBy("label", "f").count().collect()
    weights, bias = PRIOR.copy(), -3.0
    if seen:
        seen.sort(key=lambda r: (r["label"], r["f"]))
        x, y = np.array([r["f"] for r in seen]), np.array([float(r["label"]) for r in seen])
        size = {k: max(1, sum(r["count"] for r in seen if r["label"] == k)) for k in (0, 1)}
        n = np.array([r["count"] * totals.get(r["label"], 0) / size[r["label"]] for r in seen])
        n *= sum(r["count"] for r in seen) / n.sum()
        for _ in range(30):  # Newton's steps for ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
            full = np.concatenate((x, np.ones((len(x), 1))), axis=1)
            pull = np.concatenate((weights - PRIOR, [0.02 * (bias + 3.0)]))
            gradient = full.T @ (n * (p - y)) + pull
            hessian = (full * (n * p * (1 - p))[:, None]).T @ full + np.diag([1.0] * len(PRIOR) + [0.02])
            step = np.linalg.solve(hessian, gradient)
            weights, bias = weights - np.clip(step[:-1], -2, 2), bias - float(np.clip(step[-1], -2, 2))
    return ToxicityModel(automaton, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(whole_text(text_col)).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sifted = Sifted(shared.value.automaton)
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(part.column("text").to_pylist(), sifted))], names=["doc_id", "score"])

    return rows.mapInArrow(released(scored), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
