"""Secret scan: stated patterns, and a character convolutional network over candidates.

Candidates are all matches of the stated patterns, key-like runs with a digit and a letter,
what stands soon after a word such as "password" (letters alone too), and key headers. A
network in numpy (character embedding, one convolution over the candidate with its
surrounding context, pooled over each, one output) scores each. It is trained on labelled findings
drawn by a seeded generator, as the tables label none: keys and passwords of many forms,
the stated forms among them, against words, paths, numbers and placeholders, each with and
without a telling context. Half of them are held out to calibrate its output (Platt) and
to choose the highest threshold that keeps the required recall. Stated matches always
stay. A candidate that overlaps one is scored too, and what it has beyond the stated ones
is added.

Edge cases: null and empty texts have no spans; repeated rows give repeated results;
candidates of any length are scored in segments of 48 characters and take the highest
score; an empty table gives an empty table; only the named columns are read. Null ids
stay null. In ``redact`` a null text stays null.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame

from sylvan.llm.common import doc_text, documents, map_columns

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HINTS = ("passw", "secret", "token", "apikey", "api_key", "api key", "api-key", "bearer", "credential")
#: Shorter pieces of a candidate beyond stated matches aren't added.
PIECE = 4
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
HINT = re.compile(r"(?:passw(?:or)?d|secret|token|api[_\x20-]?key|bearer|credential)s?(?![a-z])", re.I | re.A)
#: What may lie between such a word and its value, and the value.
VALUE = re.compile(r"(?:[\x20\t]*(?:is|was|are|set|to|of|for|the|now|=+>?|:|-+>|[\"'(<\[]))*[\x20\t]*[\"'(<\[]?([^\s\"'`,;()<>\[\]{}]{6,})", re.A)
HEADER = re.compile(r"-----BEGIN [A-Z ]{3,40}-----")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
KINDS = ("assign", "access", "hex", "cnn")
LEFT, BODY, RIGHT = 24, 48, 8
WIDTH = LEFT + BODY + RIGHT
#: Code 0 pads; characters beyond ASCII share one code.
CODES = {c: k + 1 for k, c in enumerate(map(chr, range(32, 127)))}
OTHER, EMBED, FILTERS, SPAN = 96, 12, 32, 5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the stated patterns, by start and then kind as listed."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    out.sort(key=lambda s: (s[0], s[2]))
    return [(s, e, KINDS[k]) for s, e, k in out]


def candidates(text: str) -> list[tuple[int, int]]:
    """What the network looks at besides the stated matches."""
    found = {(m.start(), m.end()) for m in RUN.finditer(text) if DIGIT.search(m[0]) and LETTER.search(m[0])}
    low = text.lower()
    if any(h in low for h in HINTS):
        for h in HINT.finditer(text):
            m = VALUE.match(text, h.end())
            if m:
                start, end = m.span(1)
                while end - start > 6 and text[end - 1] in ".!?:":  # the sentence's
                    end -= 1
                found.add((start, end))
    if "-----BEGIN" in text:
        found |= {m.span() for m in HEADER.finditer(text)}
    return sorted(found)


def beyond(start: int, end: int, taken: list[tuple[int, int]], firsts: list[int]) -> list[tuple[int, int]]:
    """The pieces of a stretch outside those taken, which are sorted and begin at ``firsts``."""
    out, at = [], start
    k = max(0, bisect.bisect_right(firsts, start) - 1)
    while k < len(taken) and taken[k][0] < end:
        s, e = taken[k]
        if e > at:
            if s > at:
                out.append((at, s))
            at = e
        k += 1
    if at < end:
        out.append((at, end))
    return out if out == [(start, end)] else [(s, e) for s, e in out if e - s >= PIECE]


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate in segments, each with its context, at fixed width."""
    left, right = text[max(0, start - LEFT) : start].rjust(LEFT, "\0"), text[end : end + RIGHT].ljust(RIGHT, "\0")
    return [left + text[k : min(end, k + BODY)].ljust(BODY, "\0") + right for k in range(start, end, BODY)]


def encode(wins: list[str]) -> np.ndarray:
    return np.array([[CODES.get(c, 0 if c == "\0" else OTHER) for c in w] for w in wins], np.int64).reshape(-1, WIDTH)


class CharCnn:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.3, (OTHER + 1, EMBED)).astype(np.float32)
        self.conv = r.normal(0, (2 / (SPAN * EMBED)) ** 0.5, (SPAN * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, (3 * FILTERS,)).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.emb[x]
        n, w, _ = e.shape
        cols = np.concatenate([e[:, i : w - SPAN + 1 + i] for i in range(SPAN)], axis=2)
        h = np.maximum(cols @ self.conv + self.bias, 0)
        # the candidate's own places, and those that begin before it
        top, lead = LEFT + h[:, LEFT:].argmax(1), h[:, :LEFT].argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h[:, LEFT:].mean(1), np.take_along_axis(h, lead[:, None], 1)[:, 0]], 1)
        return cols, h, top, lead, pooled, pooled @ self.out + self.out_bias

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k : k + 256])[-1] for k in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.float32)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(x) + self.shift)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.004, batch: int = 64, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        params = [self.emb, self.conv, self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for k in range(0, len(x), batch):
                at = order[k : k + batch]
                cols, h, top, lead, pooled, z = self._forward(x[at])
                d = ((1 / (1 + np.exp(-z))) - y[at]).astype(np.float32) / len(at)
                dp = d[:, None] * self.out
                dh = np.zeros_like(h)
                dh[:, LEFT:] = dp[:, None, FILTERS : 2 * FILTERS] / (h.shape[1] - LEFT)
                for place, part in ((top, dp[:, None, :FILTERS]), (lead, dp[:, None, 2 * FILTERS :])):
                    np.put_along_axis(dh, place[:, None], np.take_along_axis(dh, place[:, None], 1) + part, 1)
                dh *= h > 0
                flat = dh.reshape(-1, FILTERS)
                dcols = (flat @ self.conv.T).reshape(cols.shape)
                de = np.zeros((len(at), WIDTH, EMBED), np.float32)
                for i in range(SPAN):
                    de[:, i : i + h.shape[1]] += dcols[:, :, i * EMBED : (i + 1) * EMBED]
                demb = np.zeros_like(self.emb)
                np.add.at(demb, x[at], de)
                grads = [demb, cols.reshape(-1, SPAN * EMBED).T @ flat, flat.sum(0), d @ pooled, d.sum(keepdims=True)]
                t += 1
                pace = rate * (1 - 0.9 * t * batch / (epochs * len(x) + batch))
                for j, (p, g) in enumerate(zip(params, grads)):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p -= pace * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps on held-out findings; then the highest threshold with that recall there."""
        z = self.logits(x).astype(np.float64)
        n1, n0 = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * z + b)))
            g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
            w = p * (1 - p) + 1e-9
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, g)
        self.slope, self.shift = float(a), float(b)
        scores = np.sort(self.probability(x[y > 0]))
        self.threshold = float(scores[int((1 - recall) * len(scores))])


def findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Labelled findings: (text, start, end) and whether it is a secret."""
    r = random.Random(seed)
    pick = lambda alphabet, lo, hi: "".join(r.choice(alphabet) for _ in range(r.randint(lo, hi)))
    prose = lambda k: " ".join(pick("etaoinshrdlu", 2, 9) for _ in range(k))
    mixed, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    secret = [
        lambda: pick("0123456789abcdef", 24, 64), lambda: pick(mixed, 20, 44), lambda: pick(b64, 24, 64) + r.choice(["", "=", "=="]),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16), lambda: r.choice(["ghp_", "sk-", "xoxb-", "pk_live_", "glpat-"]) + pick(mixed, 20, 40),
        lambda: "eyJ" + pick(mixed, 20, 60), lambda: pick(mixed + "_-", 16, 32),
    ]
    # these are secrets only where the context says so
    told = [
        lambda: pick(string.ascii_letters, 10, 24), lambda: pick(mixed, 8, 16), lambda: pick(string.ascii_lowercase, 4, 7).capitalize() + pick(string.digits, 2, 4) + r.choice("!@#$%*"), lambda: pick(mixed + "!@#$%^*+", 8, 20),
        lambda: pick("0123456789abcdef", 12, 40),
    ]
    hint = lambda: r.choice(["password", "Password", "passwd", "secret", "token", "api key", "api_key", "apikey", "Bearer", "credentials"]) + r.choice([" is ", " was ", ": ", " = ", '="', ' = "', " -> ", " set to ", " "])
    word = lambda: pick("etaoinshrdlucmf", 3, 9)
    plain = [
        lambda: "_".join(word() for _ in range(3)) + str(r.randint(0, 99)), lambda: "-".join(word() for _ in range(4)) + "-" + str(r.randint(1, 2030)), lambda: "/".join(word() for _ in range(4)) + "/v" + str(r.randint(1, 9)),
        lambda: "".join(word().capitalize() for _ in range(4)) + str(r.randint(0, 9)), lambda: pick("0123456789", 16, 22), lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-00-00",
        lambda: "x" * r.randint(12, 30) + "0", lambda: r.choice(["your_token_here_123", "changeme_changeme1", "example_key_0000000", "placeholder-value-1"]), lambda: "=" * r.randint(16, 40) + "1",
        lambda: word() + str(r.randint(1, 9)) + word() + word() + word(), lambda: "0" * r.randint(16, 40),
    ]
    onsets, vowels, codas = "b bl br c ch cl cr d dr f fl fr g gl gr h j k l m n p ph pl pr qu r s sc sch sh sp st str t th tr v w wh y z".split(), "a e i o u ai au ea ee ie oo ou io".split(), " b ck d f ft g l ll m n nd ng nt p r rd rt s ss st t th x z ñ ß é".split(" ")
    natural = lambda: "".join(r.choice(onsets) + r.choice(vowels) + r.choice(codas) for _ in range(r.randint(2, 4)))
    prosy = [
        natural, natural, lambda: natural() + r.choice([".", "###", "!!", "%%%", ",", "'s"]), lambda: natural().capitalize(), lambda: pick("etaoinshrdlucmf", 6, 13), lambda: r.choice(["password", "passwords", "secret", "secrets", "token", "tokens", "credential", "bearer", "Bearer", "manager", "rotation", "management"]),
        lambda: "".join(r.choice(["tion", "the", "keit", "ing", "oso", "eau", "ver", "ment", "er", "an"]) for _ in range(r.randint(3, 5))), lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: natural() + "-" + natural(), lambda: natural() + "_" + natural(),
        lambda: pick("0123456789", 6, 8), lambda: r.choice(["v1.2.3", "required", "********", "<password>", "${TOKEN}", "%s_value", "undefined", "changeme"]),
    ]
    out, labels = [], []
    for k in range(n):
        good = k % 2
        near = r.random() < 0.5
        body = r.choice((told if good else prosy) if near else secret if good else plain)()
        lead = hint() if near else r.choice(["", "", prose(1) + " ", r.choice(["key", "token", "id", "auth", "value", "path", "ref", "commit"]) + r.choice(["=", ": ", ' = "', " "])])
        before = r.choice(secret)() + r.choice([" ", "\n", '" ', ", "]) if r.random() < 0.25 else ""  # another key nearby says nothing
        text = prose(3) + r.choice([" ", "\n"]) + before + r.choice(["", prose(1) + " "]) + lead
        out.append((text + body + r.choice([" ", '"', "\n", ". "]) + prose(2), len(text), len(text) + len(body)))
        labels.append(good)
    return out, labels


@functools.lru_cache(4)
def trained(n: int = 20_000, recall: float = 0.98, seed: int = 11) -> CharCnn:
    """Trained on half of n generated findings, calibrated on the other half."""
    found, labels = findings(n, seed)
    x, y = encode([windows(*f)[0] for f in found]), np.array(labels, np.float32)
    fit = np.arange(n) % 4 < 2
    model = CharCnn()
    model.train(x[fit], y[fit])
    model.calibrate(x[~fit], y[~fit], recall)
    return model


def add_scores(model: CharCnn, texts: list[str]) -> list[tuple[list, list]]:
    """Stated spans, and all spans with a score, of each text; candidates of all texts are scored together."""
    base = [base_spans(t) for t in texts]
    wins: list[str] = []
    pieces: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    owner: list[tuple[int, int, int, bool]] = []
    for k, t in enumerate(texts):
        taken = sorted((s, e) for s, e, _ in base[k])
        firsts = [s for s, _ in taken]
        # stated matches of different kinds may overlap: the furthest end so far counts
        taken = list(zip(firsts, itertools.accumulate((e for _, e in taken), max)))
        for s, e in candidates(t):
            pieces[k, s, e] = beyond(s, e, taken, firsts)
            if not pieces[k, s, e]:
                continue
            w = windows(t, s, e)
            owner += [(k, s, e, False)] * len(w)
            wins += w
        for s, e in dict.fromkeys((s, e) for s, e, _ in base[k]):
            w = windows(t, s, e)
            owner += [(k, s, e, True)] * len(w)
            wins += w
    best: dict[tuple, float] = {}
    for o, p in zip(owner, model.probability(encode(wins)).tolist() if wins else ()):
        best[o] = max(p, best.get(o, 0.0))
    out = []
    for k, own in enumerate(base):
        out.append((own, []))
    added: list[list] = [[] for _ in texts]
    for (k, s, e, stated), p in best.items():
        if not stated and p >= model.threshold:
            added[k] += [(a, b, "cnn", p) for a, b in pieces[k, s, e]]
    for k, own in enumerate(base):
        rows = [(s, e, kind, best[k, s, e, True]) for s, e, kind in own] + widest(added[k])
        rows.sort(key=lambda x: (x[0], KINDS.index(x[2])))
        out[k] = (own, rows)
    return out


def widest(spans: list[tuple]) -> list[tuple]:
    """Of added spans that overlap the one that begins first, and of these the longest."""
    out: list[tuple] = []
    for x in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.98) -> DataFrame:
    """Counts, digest and all spans of every text; ``findings`` has the network's score of each span."""
    model = trained(recall=recall)

    def run(_: object, ids: list, texts: list) -> dict:
        rows = []
        for i, (base, spans) in zip(ids, add_scores(model, texts)):
            kinds = [k for _, _, k in base]
            rows.append((i, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), [{"start": s, "end": e, "kind": k, "score": p} for s, e, k, p in spans]))
        names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings")
        return {k: [r[j] for r in rows] for j, k in enumerate(names)}

    return map_columns(doc_text(df, id_col, text_col), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, findings array<struct<start:long,end:long,kind:string,score:double>>")


def cut(text: str, spans: list[tuple], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for s, e, *_ in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "[SECRET]", recall: float = 0.98) -> DataFrame:
    """The same rows and columns; secrets in the text are replaced and ``length_col`` counts the new text."""
    model = trained(recall=recall)
    names = df.columns

    def run(_: object, *columns: list) -> dict:
        out = dict(zip(names, columns))
        texts = out[text_col]
        marked = [t if t is None or not spans else cut(t, spans, mark) for t, (_, spans) in zip(texts, add_scores(model, [t or "" for t in texts]))]
        if length_col in out:
            out[length_col] = [n if a is b or b is None else len(b) for n, a, b in zip(out[length_col], texts, marked)]
        out[text_col] = marked
        return out

    return map_columns(df, run, df.schema)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir)).drop("findings")
