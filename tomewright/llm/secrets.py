"""Secret scans: every candidate and its surroundings go through a character convolutional network.

Patterns only propose candidates, without upper bounds on any length: runs of 16 or more
characters of a key alphabet that hold a digit or both cases in a row (`aB`), values of 6
or more characters assigned to a name that holds a word such as `token`, private key
blocks (encrypted ones too), and passwords of 4 or more characters in URLs. They are read
alike by Spark (the test in front) and by Python: character classes are ASCII in both. A
run of letters of one case is a word unless it is assigned to a name. What begins with the
mark that `redact` leaves is no value, so a second pass finds nothing new.

The network (numpy) reads `before` characters, a window of `inside` characters of the
candidate and `after` characters; a candidate longer than a window is read in overlapping
windows and its highest score counts, so no part of it goes unread. Scores are
calibrated on held-out findings, and the threshold of each kind is the highest
one at which at least `recall` of the held-out secrets of that kind are kept (of all
kinds together where a kind has fewer than `least_held`).

Defined results: null or empty text has no candidates; a very long text is read whole;
candidates of one kind don't overlap (an assignment within a value is read as part of
it); all candidates are scored, and of accepted ones that overlap the longest counts, of
equally long ones the earlier kind, then the earlier place; equal texts in repeated rows
give equal findings, one set a row; findings carry a SHA-256 of the secret and never the
secret; a null doc_id stays null; an empty table gives an empty result; other columns are
not touched, whatever their names, but for n_chars, which `redact` brings up to date.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free_name
from .text import lean

RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9]|[A-Za-z+/_\-]*[a-z][A-Z])[A-Za-z0-9+/_\-]{16,}={0,2}"
_NAMES = "token|secret|passwd|password|pwd|api[_\\-]?key|access[_\\-]?key|credential"
ASSIGNED = rf"(?i:(?<![\w\-])(?=[\w\-]*?(?:{_NAMES}))[\w\-]++[\"']?\]?\s*+[:=]++>?\s*+[\"']?)"
KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----\s*+(?:[A-Za-z\-]++:[^\n]*+\n\s*+)*+[A-Za-z0-9+/=\s\\]{16,}"
MARK = "[SECRET]"
_NOT_MARK = rf"(?!{re.escape(MARK)})"
VALUE = rf"{_NOT_MARK}[^\s\"',;<>]{{6,}}"
IN_URL = rf"://[^\s:/@]*+:{_NOT_MARK}[^\s/@]{{4,}}@"
_PATTERNS = {
    "key_block": re.compile(KEY_BLOCK, re.ASCII),
    "in_url": re.compile(IN_URL.replace(":(?!", ":((?!", 1).replace("{4,}@", "{4,})@"), re.ASCII),
    "assigned": re.compile(f"{ASSIGNED}({VALUE})", re.ASCII),
    "run": re.compile(RUN, re.ASCII),
}
KINDS = tuple(_PATTERNS)
ALPHABET = string.ascii_letters + string.digits + string.punctuation + " \n"
_CODES = np.full(256, 1, np.uint8)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i + 2
N_CODES = len(ALPHABET) + 2


@dataclass(frozen=True)
class SecretParams:
    before: int = 28
    inside: int = 48
    after: int = 8
    dim: int = 8
    filters: int = 24
    width: int = 5
    epochs: int = 10
    batch: int = 64
    rate: float = 0.01
    recall: float = 0.998
    least_held: int = 20
    findings: int = 16_000
    seed: int = 11

    @property
    def length(self) -> int:
        return self.before + self.inside + self.after


@dataclass
class SecretModel:
    params: SecretParams
    weights: dict[str, np.ndarray]
    scale: tuple[float, float]
    thresholds: dict[str, float] = field(default_factory=dict)


def proposals(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in characters of all that the patterns match; they may overlap."""
    found = []
    for kind, pattern in _PATTERNS.items():
        group = 1 if pattern.groups else 0
        found += [(*m.span(group), kind) for m in pattern.finditer(text)]
    return found


def apart(found: list[tuple], size: int) -> list[tuple]:
    """Those of found (start, end, kind, ...) in a text of this size that stay, in order, without overlaps; longer ones win, then earlier kinds."""
    if len(found) < 2:
        return found
    kept: list[tuple] = []
    taken = np.zeros(size + 1, bool)
    for x in sorted(found, key=lambda x: (x[0] - x[1], KINDS.index(x[2]), x[0])):
        if not taken[x[0] : x[1]].any():
            taken[x[0] : x[1]] = True
            kept.append(x)
    return sorted(kept)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in characters, in order, without overlaps; longer ones win, then earlier kinds."""
    return apart(proposals(text), len(text))


def windows(text: str, start: int, end: int, p: SecretParams) -> list[np.ndarray]:
    """Character codes of each window: context before, candidate, context after, each padded with 0."""
    step, out = p.inside - 8, []
    raw = lambda s, n, right: np.pad(_CODES[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)], (n - len(s), 0) if right else (0, n - len(s)))
    head = raw(text[max(0, start - p.before) : start], p.before, True)
    tail = raw(text[end : end + p.after], p.after, False)
    for at in range(start, max(start + 1, end - 8), step):
        body = raw(text[at : min(end, at + p.inside)], p.inside, False)
        out.append(np.concatenate([head, body, tail]))
    return out


def _parts(p: SecretParams) -> list[tuple[int, int]]:
    """Ranges of filter positions pooled apart: before, candidate, after."""
    n = p.length - p.width + 1
    return [(0, p.before), (p.before, p.before + p.inside - p.width + 1), (p.before + p.inside - p.width + 1, n)]


def _forward(x: np.ndarray, w: dict[str, np.ndarray], p: SecretParams):
    e = w["e"][x]
    n = p.length - p.width + 1
    r = np.zeros((len(x), n, p.filters), np.float32)
    for j in range(p.width):
        r += e[:, j : j + n] @ w["f"][j]
    r = np.maximum(r + w["b"], 0)
    pooled = [r[:, a:b].max(1) for a, b in _parts(p)]
    mean = r[:, slice(*_parts(p)[1])].mean(1)
    h = np.concatenate([*pooled, mean], 1)
    z = np.maximum(h @ w["u"] + w["d"], 0)
    return e, r, h, z, z @ w["v"] + w["c"][0]


def logits(x: np.ndarray, w: dict[str, np.ndarray], p: SecretParams) -> np.ndarray:
    return np.concatenate([_forward(x[i : i + 2048], w, p)[-1] for i in range(0, len(x), 2048)] or [np.empty(0, np.float32)])


def train(x: np.ndarray, y: np.ndarray, p: SecretParams) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    new = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    w = {"e": new(N_CODES, p.dim, scale=0.5), "f": new(p.width, p.dim, p.filters, scale=0.2), "b": np.zeros(p.filters, np.float32), "u": new(4 * p.filters, 24, scale=0.15), "d": np.zeros(24, np.float32), "v": new(24, scale=0.3), "c": np.zeros(1, np.float32)}
    moments, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}, 0
    n = p.length - p.width + 1
    for epoch in range(p.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), p.batch):
            part = order[at : at + p.batch]
            xb = x[part]
            e, r, h, z, logit = _forward(xb, w, p)
            g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) / len(part)).astype(np.float32)
            grads = {"v": z.T @ g, "c": np.array([g.sum()], np.float32)}
            gz = g[:, None] * w["v"] * (z > 0)
            grads["u"], grads["d"] = h.T @ gz, gz.sum(0)
            gh = gz @ w["u"].T
            gr = np.zeros_like(r)
            rows, cols = np.arange(len(part))[:, None], np.arange(p.filters)[None]
            for k, (a, b) in enumerate(_parts(p)):
                np.add.at(gr, (rows, a + r[:, a:b].argmax(1), cols), gh[:, k * p.filters : (k + 1) * p.filters])
            a, b = _parts(p)[1]
            gr[:, a:b] += gh[:, None, 3 * p.filters :] / (b - a)
            gr *= r > 0
            grads["b"], grads["f"], ge = gr.sum((0, 1)), np.zeros_like(w["f"]), np.zeros_like(e)
            for j in range(p.width):
                grads["f"][j] = np.tensordot(e[:, j : j + n], gr, ((0, 1), (0, 1)))
                ge[:, j : j + n] += gr @ w["f"][j].T
            grads["e"] = np.zeros_like(w["e"])
            np.add.at(grads["e"], xb, ge)
            step += 1
            rate = p.rate * (0.1 + 0.9 * (1 - epoch / p.epochs))
            for k, gk in grads.items():
                m, v = moments[k]
                m += 0.1 * (gk - m)
                v += 0.001 * (gk * gk - v)
                w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return w


def synthetic_findings(n: int, seed: int) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings: (text, start, end, kind, 1 for a secret). Half are secrets of common
    makers' forms; half are look-alikes: digests, ids, card numbers, placeholders, file names."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    chars = lambda a, k: "".join(a[i] for i in rng.integers(0, len(a), k))
    alnum, hexa, digits, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.digits, string.ascii_letters + string.digits + "+/"
    syllables = "the an in er on re ed nd ha at en es of or ti to is it st al ar te se ch que der ein la os ciel eau".split()
    letters = string.ascii_lowercase + "etaoinsr"
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    stray = lambda: pick([lambda: f"{word()}.{chars(digits, 2)}@{word()}.example.com", lambda: f"https://{word()}.example.com/{word()}", lambda: f"{chars(digits, 3)}-{chars(digits, 4)}", lambda: f"{word()}_{word()}", lambda: f"20{chars(digits, 2)}"])()
    any_word = lambda: stray() if rng.random() < 0.06 else word() if rng.random() < 0.5 else chars(letters, int(rng.integers(1, 11)))
    prose = lambda k: " ".join(any_word() + pick(["", "", "", ",", ".", "###", "%%%", "!!", ".\n"]) for _ in range(k))
    names = "token secret password passwd api_key apikey secret_key access_key auth_token client_secret db_password credential".split()
    camel = lambda: "".join(w if i == 0 and rng.random() < 0.5 else w.capitalize() for i, w in enumerate([word() + word() for _ in range(rng.integers(3, 6))]))
    uuid = lambda: "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12))
    secret_value = lambda: pick([lambda: chars(hexa, int(pick([32, 40, 64]))), lambda: chars(alnum, int(rng.integers(16, 44))), lambda: "ghp_" + chars(alnum, 36), lambda: "AKIA" + chars(string.ascii_uppercase + digits, 16), lambda: "sk_live_" + chars(alnum, 24), lambda: "xoxb-" + chars(digits, 11) + "-" + chars(alnum, 24), lambda: chars(b64, 40), lambda: "AIza" + chars(alnum + "-_", 35), lambda: ".".join(["eyJ" + chars(alnum, 20), "eyJ" + chars(alnum, 40), chars(alnum + "-_", 43)])])()
    assign = lambda name, v: pick([f'{name} = "{v}"', f'{name}="{v}"', f"{name}: {v}", f"{name.upper()}={v}", f"'{name}': '{v}'"])
    good = [
        lambda: assign(pick(names), secret_value()),
        lambda: assign(pick(names), secret_value()),
        lambda: assign(pick(["token", "secret"]), chars(hexa, 40)),
        lambda: assign(pick(["password", "passwd", "pwd"]), chars(alnum + "!#$%^*", int(rng.integers(8, 20)))),
        lambda: "Authorization: Bearer " + secret_value(),
        lambda: pick(["ghp_", "gho_"]) + chars(alnum, 36),
        lambda: "AKIA" + chars(string.ascii_uppercase + digits, 16),
        lambda: pick(["sk_live_", "rk_live_"]) + chars(alnum, 24),
        lambda: f"-----BEGIN {pick(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----\n{pick(['', '', f'Proc-Type: 4,ENCRYPTED{chr(10)}DEK-Info: AES-128-CBC,{chars(hexa, 32).upper()}{chr(10) * 2}'])}{chars(b64, 64)}\n{chars(b64, 64)}\n",
        lambda: f"{pick(['postgres', 'mysql', 'https', 'amqp', 'redis'])}://{pick([word(), word(), ''])}:{chars(alnum, int(pick([rng.integers(8, 20), rng.integers(20, 140)])))}@{word()}.example.com/{word()}",
    ]
    bad = [
        lambda: chars(digits, 16),
        lambda: chars(digits, int(rng.integers(16, 24))),
        uuid,
        lambda: pick(["commit ", "sha1: ", "sha256:", "md5 ", "checksum ", "etag ", "digest ", "rev "]) + chars(hexa, int(pick([32, 40, 64]))),
        lambda: f"https://{word()}.example.com/{word()}/{chars(digits, 6)}/{word()}-{word()}-{chars(digits, 8)}",
        lambda: f"{word()}_{word()}_{word()}_{chars(digits, 3)}",
        lambda: f"20{chars(digits, 2)}-0{chars('123456789', 1)}-1{chars(digits, 1)}T1{chars(digits, 1)}-{chars(digits, 6)}Z",
        lambda: assign(pick(names), pick(["changeme", "YOUR_TOKEN_HERE", "xxxxxxxxxxxxxxxx", "${SECRET}", "example", "os.environ", "********", "placeholder123456", "0000000000000000", "<your-key>", "getenv()", "required", word() + word()])),
        lambda: assign(pick(["name", "path", "id", "version", "token_count", "max_tokens"]), pick([chars(digits, 16), f"{word()}/{word()}-{chars(digits, 12)}", uuid()])),
        lambda: "data:image/png;base64," + chars(b64, int(rng.integers(40, 90))) + "==",
        lambda: f"isbn-{chars(digits, 13)}-{word()}",
        camel,
        lambda: f"{camel()}/{camel()}_{word()}",
        lambda: f"https://{word()}:{pick(['8080', '443', '5432x', 'port'])}@home.example.com",
    ]
    out: list[tuple[str, int, int, str, int]] = []
    while len(out) < n:
        label = int(rng.random() < 0.5)
        body = (pick(good) if label else pick(bad))()
        if rng.random() < 0.25 and "PRIVATE" not in body and "://" not in body:
            body = body.upper()
        left = prose(int(rng.integers(0, 7))) + pick([" ", " ", "\n", ""])
        right = pick(["", "", " ", "###", "$$$ ", "!! ", ".", "\n", ", "]) + prose(int(rng.integers(0, 5)))
        if rng.random() < 0.15:
            left, right = left.upper(), right.upper()
        text = left + body + right
        here = [c for c in candidates(text) if c[1] > len(left) and c[0] < len(left) + len(body)]
        if here:
            out.append((text, *max(here, key=lambda c: c[1] - c[0]), label))
    return out


def fit(findings: list[tuple[str, int, int, str, int]], p: SecretParams) -> SecretModel:
    """findings: (text, start, end, kind, label). 60 % are fitted, the rest calibrate and set the thresholds."""
    rng = np.random.default_rng(p.seed)
    split = rng.random(len(findings)) < 0.6
    x, y = [], []
    for (text, a, b, _, label), use in zip(findings, split, strict=True):
        if use:
            own = windows(text, a, b, p)
            x += own
            y += [label] * len(own)
    weights = train(np.stack(x), np.array(y, np.float32), p)
    rest = [f for f, use in zip(findings, split, strict=True) if not use]
    raw, truth = _scores([(t, a, b) for t, a, b, _, _ in rest], weights, p), np.array([f[4] for f in rest])
    scale = _platt(raw, truth)
    prob = 1 / (1 + np.exp(-np.clip(scale[0] * raw + scale[1], -30, 30)))
    model = SecretModel(p, weights, scale)
    every = np.sort(prob[truth == 1])
    for kind in KINDS:
        own = np.sort(prob[[f[3] == kind and f[4] == 1 for f in rest]])
        own = own if len(own) >= p.least_held else every
        model.thresholds[kind] = float(min(own[int((1 - p.recall) * len(own))] * 0.999, 0.9)) if len(own) else 0.5
    return model


def _scores(found: list[tuple[str, int, int]], weights: dict[str, np.ndarray], p: SecretParams) -> np.ndarray:
    x = [windows(t, a, b, p) for t, a, b in found]
    if not x:
        return np.empty(0)
    sizes = [len(w) for w in x]
    raw = logits(np.stack([w for own in x for w in own]), weights, p)
    return np.maximum.reduceat(raw, np.cumsum([0, *sizes[:-1]]))


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits by logistic regression, drawn towards (1, 0), with halved steps where a Newton step overshoots."""
    t, design = np.array([1.0, 0.0]), np.stack([np.clip(x, -30, 30), np.ones(len(x))], 1)
    loss = lambda t: np.sum(np.logaddexp(0, (design @ t) * (1 - 2 * y))) + 0.5 * np.sum((t - [1.0, 0.0]) ** 2)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(design @ t, -30, 30)))
        step, size = np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + np.eye(2), design.T @ (q - y) + (t - [1.0, 0.0])), 1.0
        while size > 1e-3 and loss(t - size * step) > loss(t):
            size /= 2
        t = t - size * step
    return float(t[0]), float(t[1])


def default_model(p: SecretParams = SecretParams(), store: dict = {}) -> SecretModel:  # noqa: B006
    """Model trained on the built-in labelled findings; kept for the session."""
    if p not in store:
        store[p] = fit(synthetic_findings(p.findings, p.seed), p)
    return store[p]


def find(texts: list[str | None], m: SecretModel) -> list[list[tuple[int, int, str, float]]]:
    """Accepted findings (start, end, kind, probability) of each text."""
    found = [(i, *c) for i, t in enumerate(texts) for c in proposals(t or "")]
    raw = _scores([(texts[i], a, b) for i, a, b, _ in found], m.weights, m.params)
    prob = 1 / (1 + np.exp(-np.clip(m.scale[0] * raw + m.scale[1], -30, 30)))
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for (i, a, b, kind), q in zip(found, prob, strict=True):
        if q >= m.thresholds[kind]:
            out[i].append((a, b, kind, float(q)))
    return [apart(own, len(t or "")) for t, own in zip(texts, out, strict=True)]


def may_hold(text: Column) -> Column:
    """True where a text has a candidate. The cheap test in front of each pattern is one that all its candidates pass."""
    tests = [
        text.rlike(RUN),
        (text.contains("=") | text.contains(":")) & text.rlike(ASSIGNED + VALUE),
        text.contains("-----BEGIN ") & text.rlike(KEY_BLOCK),
        text.contains("://") & text.rlike(IN_URL),
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def scan(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """One row a finding: doc_id, start, end (characters), kind, probability, sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            rows = [(d, *f, hashlib.sha256(t[f[0] : f[1]].encode("utf-8", "replace")).hexdigest()) for d, t, own in zip(pdf["doc_id"], texts, find(texts, shared.value), strict=True) for f in own]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "end", "kind", "probability", "sha256"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(may_hold(F.col("text")))
    return picked.mapInPandas(lean(run), "doc_id bigint, start long, end long, kind string, probability double, sha256 string")


def redact(docs: DataFrame, model: SecretModel | None = None, mark: str = MARK) -> DataFrame:
    """docs with every found secret replaced by `mark`, and n_chars (if there) brought up to date; all rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def blot(batches):
        for text in batches:
            texts, out = text.tolist(), []
            for t, own in zip(texts, find(texts, shared.value), strict=True):
                for a, b, _, _ in reversed(own):
                    t = t[:a] + mark + t[b:]
                out.append(t)  # null stays null
            yield pd.Series(out, dtype=object)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return lean(blot)(batches)

    # texts without a candidate don't go to Python
    name = free_name("clean", docs.columns)
    out = docs.withColumn(name, clean(F.when(may_hold(F.col("text")), F.col("text"))))
    changed = F.col(name).isNotNull() & (F.col(name) != F.col("text"))
    new = {"text": F.coalesce(name, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(name).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
