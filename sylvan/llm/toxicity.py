"""Toxicity by a lexicon trie intersected with Levenshtein automata, read in context.

The lexicon (whole words and word stems, with log-odds weights) is learned from labelled
documents. Its trie and the Levenshtein automata of its words are one lazily determinised
automaton: a state is a set of trie nodes with the edits spent, so a word of a text is
read in one transition a character and most words die after a few. Words of 5 to 8
characters may have one edit (two exchanged characters are one), longer ones two; stems are matched exactly. A misspelling
of an entry counts only as far as the entry's misspellings are rare in clean documents.

Every hit is read in its context window: inside quotation marks, or after a word of
reporting, it is quotation, else abuse. A logistic model over both sums, with a Gaussian
prior that holds where the labels say nothing, gives the score.

Edge cases: null and empty texts get the score of a text without hits; without labels of
both kinds the lexicon is empty and nothing is predicted toxic; repeated labels of a
document count once, toxic if any says so; repeated rows get equal scores; texts are read
whole; an empty table gives an empty table; only the named columns are read. Rows with
null ids are scored, are never held out and never trained on.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import Staged, doc_text, documents, map_columns

WORD = re.compile(r"[^\W_]+")
#: At most so many labelled documents are fitted on, chosen by a hash of their id.
TRAIN_ROWS = 12_000
#: A task remembers so many words and states of the automaton, then begins anew.
WORDS_MOST, STATES_MOST = 150_000, 20_000
STEM, WINDOW_CHARS, WINDOW_WORDS, CUT = (4, 5), 160, 6, 0.3
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’", "`": "`"}
REPORT = frozenset("said says saying called calls calling wrote writes writing quoted quotes quote word term phrase insult slur uses used dit disait appelle mot terme sagte sagt nannte wort begriff dijo dice llamó palabra término".split())
PRIOR = np.array([3.0, 3.0, 0.3, 0.3])
SPREAD = np.array([2.0, 0.7, 0.2, 0.5])


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def allowed(n: int) -> int:
    return 0 if n < 5 else 1 if n < 9 else 2


class FuzzyTrie:
    """The words of a lexicon as a trie, run together with their Levenshtein automata."""

    def __init__(self, words: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.reach = [0]  # most edits that any word below a node may have
        for w in sorted(set(words)):
            node = 0
            self.reach[0] = max(self.reach[0], allowed(len(w)))
            for c in w:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], allowed(len(w)))
            self.word[node] = w
        self._begin()

    def _begin(self) -> None:
        """Forget the states made so far."""
        self.ids: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._state(self._close({0: 0}))

    def _close(self, state: dict[int, int]) -> dict[int, int]:
        """Adds the nodes reached by leaving out characters of lexicon words; drops those with too many edits."""
        todo = [x for x in state.items() if not isinstance(x[0], tuple) and x[1] <= self.reach[x[0]]]
        out: dict = {x: e for x, e in state.items() if isinstance(x, tuple)}
        while todo:
            node, e = todo.pop()
            if out.get(node, 9) <= e:
                continue
            out[node] = e
            todo += [(c, e + 1) for c in self.children[node].values() if e + 1 <= self.reach[c]]
        return out

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
            ends = [(e, self.word[n]) for n, e in nodes.items() if not isinstance(n, tuple) and self.word[n] is not None and e <= allowed(len(self.word[n]))]
            best = min(ends, default=None)
            self.accepts.append((best[1], best[0]) if best else None)
        return self.ids[key]

    def _step(self, at: int, c: str) -> int:
        out: dict = {}
        for node, e in self.states[at].items():
            if isinstance(node, tuple):  # the second of two exchanged characters is awaited
                if node[1] == c and out.get(node[0], 9) > e:
                    out[node[0]] = e
                continue
            if e < self.reach[node] and out.get(node, 9) > e + 1:
                out[node] = e + 1
            for x, child in self.children[node].items():
                cost = e + (x != c)
                if cost <= self.reach[child] and out.get(child, 9) > cost:
                    out[child] = cost
                swapped = self.children[child].get(c)
                if x != c and swapped is not None and e < self.reach[swapped] and out.get((swapped, x), 9) > e + 1:
                    out[swapped, x] = e + 1
        move = self._state(self._close(out))
        self.moves[at][c] = move
        return move

    def match(self, word: str) -> tuple[str, int] | None:
        """The lexicon word nearest to this one, within its edits, and their number."""
        if len(self.states) > STATES_MOST:
            self._begin()
        at, moves, states = self.start, self.moves, self.states
        for c in word:
            nxt = moves[at].get(c)
            at = self._step(at, c) if nxt is None else nxt
            if not states[at]:
                return None
        return self.accepts[at]


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: the weight of a misspelling of a word, by edits
    fuzzy: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = -3.0


class Matcher(dict):
    """word: (entry, weight, edits), or None; remembers the words it has seen."""

    def __init__(self, model: Model, limit: int = WORDS_MOST):
        super().__init__()
        self.model, self.limit = model, limit
        self.trie = FuzzyTrie(list(model.words))

    def __missing__(self, word: str) -> tuple[str, float, int] | None:
        m, hit = self.model, None
        if word in m.words:
            hit = (word, m.words[word], 0)
        else:
            for n in STEM:
                if len(word) > n and word[:n] in m.stems and (hit is None or m.stems[word[:n]] > hit[1]):
                    hit = (word[:n] + "*", m.stems[word[:n]], 0)
            if hit is None and (found := self.trie.match(word)):
                weight = m.fuzzy.get(found[0], 0.7 * m.words[found[0]]) * 0.8 ** (found[1] - 1)
                hit = (found[0], weight, found[1]) if weight > 0 else None
        if len(self) >= self.limit:
            self.clear()
        self[word] = hit
        return hit


def quoted(text: str, start: int, before: list[str]) -> bool:
    """Whether the place lies in quotation marks of its line, or soon after a word of reporting."""
    lead = text[max(0, start - WINDOW_CHARS) : start].rsplit("\n", 1)[-1]
    for a, b in QUOTES.items():
        if lead.count(a) % 2 if a == b else lead.rfind(a) > lead.rfind(b):
            tail = text[start : start + WINDOW_CHARS].split("\n", 1)[0]
            if b in tail:
                return True
    return not REPORT.isdisjoint(before)


def hits_of(text: str, matcher: Matcher) -> tuple[list[tuple[str, float, int, bool, int, int]], int]:
    """(entry, weight, edits, quoted, start, end) of every hit, and the number of words."""
    words = words_of(text)
    if not any([matcher[w] for w in set(words)]):
        return [], len(words)
    out, seen = [], []
    for m in WORD.finditer(text):
        w = m[0].lower()
        hit = matcher[w]
        if hit:
            out.append((*hit, quoted(text, m.start(), seen[-WINDOW_WORDS:]), m.start(), m.end()))
        seen.append(w)
    return out, len(words)


def features(hits: list[tuple], n_words: int) -> list[float]:
    exact = sum(h[1] for h in hits if not h[3] and h[2] == 0)
    fuzzy = sum(h[1] for h in hits if not h[3] and h[2] > 0)
    quote = sum(h[1] for h in hits if h[3])
    abuse = sum(1 for h in hits if not h[3])
    return [min(20.0, exact) / 5, min(20.0, fuzzy) / 5, min(20.0, quote) / 5, math.sqrt(100 * abuse / n_words) if n_words else 0.0]


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Maximum a posteriori under a Gaussian prior around PRIOR; Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    mean, precision = np.append(PRIOR, -3.0), np.append(1 / SPREAD**2, 0.02)
    w = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        grad = x1.T @ (p - y) + precision * (w - mean)
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(precision)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled documents outside the held-out quarter, chosen by a hash of their id."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    ids = ids.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most ``most`` rows of 12 bytes


def held_out(col: str):
    return F.coalesce(F.crc32(F.col(col).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights from labelled documents; copies of a text count once."""
    rows = Staged(training_rows(docs, labels, most), "toxicity-train").df
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()

    def terms(_: object, texts: list, toxic: list) -> dict:
        group, found = [], []
        for text in texts:
            words = words_of(text)
            own = set(words)
            # near copies share their least hash of three words, mostly
            group.append(min((xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))), default=0) >> 1)
            found.append(sorted({w for w in own if len(w) > 2} | {w[:n] + "*" for w in own for n in STEM if len(w) > n}))
        return {"grp": group, "toxic": toxic, "terms": found}

    seen = map_columns(rows, terms, "grp long, toxic int, terms array<string>")
    # one row a term and group of near copies, as terms of fewer groups are no evidence
    counts = seen.select("grp", "toxic", F.explode("terms").alias("term")).groupBy("term", "grp").agg(F.max("toxic").alias("toxic")).groupBy("term").agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("bad"))
    counts = counts.where("bad >= 3")
    groups = seen.groupBy("grp").agg(F.max("toxic").alias("toxic")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("bad")).first()
    n1, n0 = groups["bad"], groups["n"] - groups["bad"]
    base = n1 / max(1, groups["n"])
    # evidence against chance: twice the log likelihood ratio, above what the best of all terms would reach
    p = F.col("bad") / F.col("n")
    gain = 2 * (F.col("bad") * F.log(p / base) + F.when(F.col("n") > F.col("bad"), (F.col("n") - F.col("bad")) * F.log((1 - p) / (1 - base))).otherwise(0.0))
    odds = F.log((F.col("bad") + 0.5) / (n1 + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n0 + 1.0))
    rated = counts.select("term", "bad", "n", gain.alias("gain"), odds.alias("odds")).where("odds > 2")
    least = 2 * math.log(max(1, counts.count())) + 2
    # a term of gain g has at least g / (2 ln(1/base)) of the toxic groups, so their number is bounded by the sample
    lexicon = rated.where(F.col("gain") >= least).orderBy(F.desc("gain"), "term").collect()
    model = Model()
    words = [r for r in lexicon if not r["term"].endswith("*")]
    for r in lexicon:
        # a stem must say more than the best single word that it begins
        if r["term"].endswith("*") and r["bad"] < 1.3 * max((w["bad"] for w in words if w["term"].startswith(r["term"][:-1])), default=0):
            continue
        (model.stems if r["term"].endswith("*") else model.words)[r["term"].rstrip("*")] = min(7.0, r["odds"])

    def observed(matcher: Matcher, texts: list, toxic: list) -> dict:
        hits = [hits_of(t, matcher) for t in texts]
        return {"toxic": toxic, "n": [n for _, n in hits], "hits": [[{"entry": h[0], "edits": h[2], "quote": h[3]} for h in x] for x, _ in hits]}

    hits = map_columns(rows, observed, "toxic int, n long, hits array<struct<entry:string,edits:int,quote:boolean>>", lambda: Matcher(model))
    found = [(r["toxic"] > 0, r["n"], [(h["entry"], h["edits"], h["quote"]) for h in r["hits"]]) for r in hits.toLocalIterator()]
    # what misspellings of an entry mean: their log-odds, at most a discounted exact weight
    fuzzy: dict[str, list[int]] = {}
    for bad, _, own in found:
        for e in {h[0] for h in own if h[1] > 0}:
            fuzzy.setdefault(e, [0, 0])[bad] += 1
    for w, weight in model.words.items():
        clean, bad = fuzzy.get(w, (0, 0))
        seen_odds = math.log((bad + 1) / (sizes[1] + 2)) - math.log((clean + 1) / (sizes[0] + 2))
        model.fuzzy[w] = 0.7 * weight if not clean or seen_odds >= 3 else 0.0
    weight_of = lambda h: (model.stems.get(h[0][:-1], 0.0) if h[0].endswith("*") else model.words[h[0]] if h[1] == 0 else model.fuzzy[h[0]] * 0.8 ** (h[1] - 1))
    x = np.array([features([(h[0], weight_of(h), h[1], h[2]) for h in own], n) for _, n, own in found])
    model.weights, model.bias = fit_logistic(x, np.array([float(b) for b, _, _ in found]))
    return model


def score_text(text: str, matcher: Matcher) -> tuple[float, list[tuple]]:
    hits, n = hits_of(text, matcher)
    z = matcher.model.bias + float(np.dot(matcher.model.weights, features(hits, n))) if hits else matcher.model.bias
    return sigmoid(z), hits


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, hits (with places) of every text."""

    def run(matcher: Matcher, ids: list, texts: list) -> dict:
        found = [score_text(t, matcher) for t in texts]
        return {"doc_id": ids, "score": [s for s, _ in found], "hits": [[{"entry": h[0], "edits": h[2], "quoted": h[3], "start": h[4], "end": h[5]} for h in x] for _, x in found]}

    docs = doc_text(df, id_col, text_col)
    scored = map_columns(docs, run, "doc_id long, score double, hits array<struct<entry:string,edits:int,quoted:boolean,start:long,end:long>>", lambda: Matcher(model))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "hits")


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with their columns, whose text isn't predicted toxic."""
    names = df.columns

    def run(matcher: Matcher, *columns: list) -> dict:
        texts = columns[names.index(text_col)]
        keep = [k for k, t in enumerate(texts) if score_text(t or "", matcher)[0] < CUT]
        return {n: [c[k] for k in keep] for n, c in zip(names, columns)}

    return map_columns(df, run, df.schema, lambda: Matcher(model))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(doc_text(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("hits").cast("long").alias("n_hits"))
