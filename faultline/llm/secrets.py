"""8. Secret scans: patterns, and a character convolutional network over every candidate with its context.

Candidates are the spans of the base patterns and all other runs of ``RUN`` key characters or more that hold a letter and a digit; of a run that
a base span overlaps, what is left on each side. Each is
read with ``LEFT`` characters before and ``RIGHT`` behind it. A candidate longer than ``BODY`` is read in overlapping parts and from each separator inside it, and
has the greatest score of these. The network (embedding, one convolution, maximum and mean over
places, one dense layer; numpy alone) is trained on labelled findings that ``findings`` draws: keys of the usual kinds in assignments, headers and running text, against names, hosts, paths, versions,
dates, numbers and words; ``long_findings`` draws runs with long plain leads. A third of the findings is set aside; one half of it calibrates the scores (Platt), the other chooses, for each class of
candidates, the highest threshold that keeps a recall of ``RECALL``. ``report`` gives recall and calibration on findings that were drawn anew. Candidates of no base pattern whose score reaches the threshold become spans of kind ``cnn``; base spans
always stay, with their score.

The network is trained once on the driver (a few thousand findings, a fixed number) and goes to the workers inside the task; there is no shuffle.

Defined results: null text is empty; very long texts are scanned whole, in time that grows with their length; an empty table gives no row; spans of one kind do not overlap and cnn spans overlap no base span; ties in start are listed as assign,
access, hex, cnn; repeated rows give a row each; other columns, whatever their names, are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

RUN = 16
LEFT, BODY, RIGHT = 24, 40, 8
RECALL = 0.97
FINDINGS, LONG_FINDINGS, EPOCHS = 4500, 1500, 8
KINDS = ("assign", "access", "hex", "cnn")

# The base patterns and the lengths that their spans need.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "api")

_KEY = bytes(49 if chr(b) in string.ascii_letters + string.digits + "+/_.=-" else 48 for b in range(256))
_HEX = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_SIXTEEN = b"1" * RUN


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """start, end and kind in code points. The prefilters on bytes only skip texts that cannot match."""
    out = []
    low = raw.lower()
    if any(w.encode() in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if _SIXTEEN in raw.translate(_HEX):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def runs(raw: bytes) -> Iterator[tuple[int, int]]:
    """Runs of key characters that hold a letter and a digit, in code points."""
    marks = raw.translate(_KEY)
    at = marks.find(_SIXTEEN)
    bytes_to = points_to = 0  # code points are counted on from the run before
    while at >= 0:
        end = marks.find(b"0", at)
        end = len(raw) if end < 0 else end
        body = raw[at:end]
        if not body.isalpha() and any(48 <= c <= 57 for c in body) and any(c > 57 and c != 95 and c != 61 for c in body):
            points_to += len(raw[bytes_to:at].decode("utf-8", "replace"))
            bytes_to = at
            yield points_to, points_to + end - at
        at = marks.find(_SIXTEEN, end)


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the context before, the candidate's first characters, and the context behind; candidates count from 128 on."""
    out = np.zeros(LEFT + BODY + RIGHT, np.uint8)
    before, body, behind = text[max(0, start - LEFT) : start], text[start : min(end, start + BODY)], text[end : end + RIGHT]
    for at, part, high in ((LEFT - len(before), before, 0), (LEFT, body, 128), (LEFT + BODY, behind, 0)):
        out[at : at + len(part)] = [high + min(ord(c), 127) for c in part]
    return out


def mixed(body: str) -> bool:
    """Whether a run of key characters is long enough and holds a letter and a digit."""
    return len(body) >= RUN and any(c.isdigit() for c in body) and any(c.isalpha() for c in body)


def outside(stretches: Iterable[tuple[int, int]], base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, int, int]]:
    """What base spans (in order of their start) leave of each run (in order, apart): start and end, and those of the run. One pass over both."""
    k, reach = 0, 0  # base[:k] begin before this run's end; reach: the furthest end among them
    for first, last in stretches:
        a = max(first, min(reach, last))
        while k < len(base) and base[k][0] < last:
            s, e = base[k][:2]
            if s > a:
                yield a, s, first, last
            a, reach, k = max(a, min(e, last)), max(reach, e), k + 1
        if a < last:
            yield a, last, first, last


def views(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Parts of a candidate that are scored: itself; of a long one also overlapping parts up to its end, and what follows each separator."""
    out = [(start, end)]
    if end - start > BODY:
        out += [(a, a + BODY) for a in range(start + BODY // 2, end - BODY, BODY // 2)] + [(end - BODY, end)]
        cuts = [start, *(k + 1 for k in range(start, end) if text[k] in "=/.+"), end + 1]
        for k, a in enumerate(cuts[1:-1], 1):
            out += [(a, b) for b in {cuts[k + 1] - 1, end} if b - a >= RUN]
    return out


def findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Labelled findings: text, start, end, and 1 for a secret. Drawn by rule, the same for every run."""
    r = random.Random(seed)
    alnum, b64, hexa = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    pick = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    syllables = ["an", "ber", "con", "de", "er", "ing", "la", "men", "or", "pre", "ra", "st", "th", "ti", "un", "ver"]
    word = lambda a=1, b=4: "".join(r.choice(syllables) for _ in range(r.randint(a, b)))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6)))
    keys = [
        lambda: pick(alnum, 20, 44), lambda: pick(b64, 32, 64), lambda: pick(hexa, 32, 40), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16),
        lambda: r.choice(["ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "npm_"]) + pick(alnum, 24, 40), lambda: "eyJ" + pick(alnum, 20, 30) + "." + pick(alnum, 20, 40),
        lambda: pick(string.ascii_uppercase + string.digits, 20, 32), lambda: pick(alnum + "_-", 24, 48), lambda: pick(b64, 30, 42) + "==",
    ]
    leads = ["key: ", "auth=", "bearer ", "Authorization: Bearer ", "credential = ", "private_key=", "access key ", "pwd=", "", "", ""]
    plain = [
        lambda: f"{word()}{r.randint(1, 99)}.{word()}.example.com", lambda: f"{word()}/{word()}/{word()}{r.randint(1, 20)}.{r.choice(['py', 'txt', 'html', 'json'])}",
        lambda: f"{word(2, 3)}_{word(2, 3)}_{r.randint(1, 999)}", lambda: f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", lambda: f"{word(2, 4)}-{word(2, 4)}-{r.randint(1, 12)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
        lambda: f"www.{word(2, 3)}{r.randint(1, 9)}.org/{word(1, 3)}", lambda: f"{word(3, 5).title()}{word(2, 3).title()}{r.randint(1, 9)}", lambda: f"{word(2, 4)}={r.randint(1, 10**6)}", lambda: f"mail{r.randint(1, 9)}.{word(2, 3)}.com", lambda: "=" * r.randint(14, 30) + word() + str(r.randint(1, 9)),
        lambda: f"{word(5, 8)}{r.randint(1, 99)}", lambda: f"{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}-{word(1, 2)}",
    ]
    out = []
    for k in range(n):
        good = k % 2
        lead = prose() + " " + (r.choice(leads) if good or r.random() < 0.3 else "")
        body = ""
        while len(body) < RUN:
            body = r.choice(keys if good else plain)() if not body or good else body + r.choice("-_./") + word(1, 2)
        out.append((lead + body + r.choice([" ", ". ", '" ', ", "]) + prose(), len(lead), len(lead) + len(body), good))
    return out


def long_findings(n: int = LONG_FINDINGS, seed: int = 12) -> list[tuple[str, int, int, int, int]]:
    """Labelled findings with a plain lead, such as a path or a name, of more than BODY characters: text, start, end, 1 for a secret, and where it begins."""
    r = random.Random(seed)
    drawn = findings(2 * n, seed + 1000)
    bodies = [[t[a:b] for t, a, b, k in drawn if k == good] for good in (0, 1)]
    out = []
    for k in range(n):
        good, lead, sep = k % 2, "", r.choice("/=/=._-")
        while len(lead) <= BODY + r.randint(0, 40):
            lead += r.choice(bodies[0]) + r.choice("/._-/")
        lead = lead[:-1] + sep
        before, behind = r.choice(["see ", "at ", "in ", "export ", "from ", ""]), r.choice([" ", ". ", '" ', ", "]) + "then on"
        body = r.choice(bodies[good])
        out.append((before + lead + body + behind, len(before), len(before + lead + body), good, len(before + lead)))
    return out


@dataclass
class Network:
    embed: np.ndarray  # 256 x E
    conv: np.ndarray  # W*E x F
    conv_bias: np.ndarray
    dense: np.ndarray  # 2F
    bias: float
    platt: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, float] = (0.5, 0.5)  # without and with a lower-case letter

    def forward(self, x: np.ndarray):
        e = self.embed[x]
        n, length, size = e.shape
        width = len(self.conv) // size
        cols = np.concatenate([e[:, k : length - width + 1 + k] for k in range(width)], 2)
        h = np.maximum(cols @ self.conv + self.conv_bias, 0)
        top = h.argmax(1)
        pooled = np.concatenate((np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)), 1)
        return cols, h, top, pooled, pooled @ self.dense + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = [self.forward(x[k : k + 512])[-1] for k in range(0, len(x), 512)]
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * np.concatenate(out) + b, -30, 30))) if out else np.zeros(0)

    def best(self, candidates: list[tuple[str, int, int]]) -> np.ndarray:
        """The greatest score of each candidate's parts."""
        parts = [views(*c) for c in candidates]
        if not parts:
            return np.zeros(0)
        score = self.scores(np.stack([window(t, a, b) for (t, _, _), part in zip(candidates, parts) for a, b in part]))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.maximum.reduceat(score, np.cumsum(size) - size)


def kind_of(body: str) -> int:
    """Class of a candidate for its threshold."""
    return int(any(c.islower() for c in body))


def train(labelled: list[tuple[str, int, int, int]] | None = None, epochs: int = EPOCHS, seed: int = 3, embed: int = 8, filters: int = 24, width: int = 5, batch: int = 64) -> Network:
    long = long_findings() if labelled is None else []
    labelled = findings() if labelled is None else labelled
    labelled, begins = labelled + [f[:4] for f in long], [a for _, a, _, _ in labelled] + [f[4] for f in long]
    rng = np.random.default_rng(seed)
    away = rng.random(len(labelled)) < 1 / 3
    taught = []  # parts with RUN characters of a secret are secrets, those with none are not, and others teach nothing
    for k, ((t, a, b, good), begin) in enumerate(zip(labelled, begins)):
        if not away[k]:
            for u, v in views(t, a, b):
                inside = min(v, u + BODY) - max(u, begin)
                if not good or inside >= RUN or inside <= 0:
                    taught.append((window(t, u, v), good and inside > 0))
    x, y = np.stack([w for w, _ in taught]), np.array([k for _, k in taught], float)
    tests = [f for k, f in enumerate(labelled) if away[k] and k % 4 < 2]  # calibrate
    chosen = [f for k, f in enumerate(labelled) if away[k] and k % 4 >= 2]  # choose thresholds
    net = Network(rng.normal(0, 0.3, (256, embed)), rng.normal(0, (2 / (width * embed)) ** 0.5, (width * embed, filters)), np.zeros(filters), rng.normal(0, 0.1, 2 * filters), 0.0)
    names = ("embed", "conv", "conv_bias", "dense", "bias")
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in names}
    use, step = np.arange(len(y)), 0
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(use), max(1, len(use) // batch)):
            cols, h, top, pooled, z = net.forward(x[pick])
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            dp = g[:, None] * net.dense
            dh = np.repeat(dp[:, None, filters:] / h.shape[1], h.shape[1], 1)
            np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :filters], 1)
            dh *= h > 0
            dcols = dh @ net.conv.T
            de = np.zeros((len(pick), x.shape[1], embed))
            for k in range(width):
                de[:, k : k + h.shape[1]] += dcols[:, :, k * embed : (k + 1) * embed]
            flat = x[pick].ravel()
            grads = {"embed": np.stack([np.bincount(flat, de[:, :, k].ravel(), 256) for k in range(embed)], 1), "conv": np.tensordot(cols, dh, ([0, 1], [0, 1])), "conv_bias": dh.sum((0, 1)), "dense": pooled.T @ g, "bias": g.sum()}
            step += 1
            for n in names:
                m, v = moments[n]
                m = moments[n][0] = 0.9 * m + 0.1 * grads[n]
                v = moments[n][1] = 0.999 * v + 0.001 * grads[n] ** 2
                setattr(net, n, getattr(net, n) - 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    p = np.clip(net.best([f[:3] for f in tests]), 1e-12, 1 - 1e-12)
    z = np.log(p / (1 - p))
    a, b, t = 1.0, 0.0, np.array([f[3] for f in tests], float)
    for _ in range(200):  # Platt: logistic regression on the logit
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a, b = a - 0.05 * float(((p - t) * z).mean()), b - 0.05 * float((p - t).mean())
    net.platt = (a, b)
    p, t, kinds = net.best([f[:3] for f in chosen]), np.array([f[3] for f in chosen], float), np.array([kind_of(x[u:v]) for x, u, v, _ in chosen])
    net.thresholds = tuple(threshold(p[kinds == k], t[kinds == k]) for k in (0, 1))
    return net


def report(net: Network, seed: int = 1001) -> list[dict]:
    """On findings that were drawn anew, by class and length: how many, the threshold, recall, the share of others that pass, and the mean score of each (calibrated: near their share of secrets)."""
    plain, long = findings(seed=seed), [f[:4] for f in long_findings(seed=seed + 1)]
    out = []
    for name, some in (("short", plain), ("long lead", long)):
        p, y, kinds = net.best([f[:3] for f in some]), np.array([f[3] for f in some]), np.array([kind_of(t[a:b]) for t, a, b, _ in some])
        for k in (0, 1):
            here, hit = kinds == k, p >= net.thresholds[k]
            share = lambda m: float(hit[here & m].mean()) if (here & m).any() else None
            out.append({"length": name, "lower_case": bool(k), "n": int(here.sum()), "threshold": net.thresholds[k], "recall": share(y == 1), "others": share(y == 0), "mean_score": float(p[here].mean()) if here.any() else None, "secrets": float(y[here].mean()) if here.any() else None})
    return out


def threshold(p: np.ndarray, y: np.ndarray, recall: float = RECALL) -> float:
    """The highest threshold at which the share of secrets that reach it is at least ``recall``; 0.5 without secrets."""
    hits = np.sort(p[y > 0])
    return float(hits[int(len(hits) * (1 - recall))]) if len(hits) else 0.5


class Scanner:
    def __init__(self, net: Network):
        self.net = net

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """Of each text its spans: start, end, kind, score."""
        found: list[tuple[int, int, int, str]] = []
        for k, t in enumerate(texts):
            raw = t.encode("utf-8", "replace")
            base = base_spans(t, raw)
            found += [(k, a, b, kind) for a, b, kind in base]
            found += [(k, u, v, "cnn") for u, v, a, b in outside(runs(raw), base) if (u, v) == (a, b) or mixed(t[u:v])]
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        if found:
            score = self.net.best([(texts[k], a, b) for k, a, b, _ in found])
            for (k, a, b, kind), p in zip(found, score.tolist()):
                if kind != "cnn" or p >= self.net.thresholds[kind_of(texts[k][a:b])]:
                    out[k].append((a, b, kind, p))
        return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in out]


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


def scan(df: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (start, stop, kind, score), a row for each row of df."""
    S.ship(df.sparkSession)
    net = net or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(net)
        for batch in batches:
            spans = [[{"start": a, "stop": b, "kind": k, "score": p} for a, b, k, p in x] for x in scanner.scan(S.texts(batch))]
            yield pa.record_batch([batch.column(0), pa.array(spans, SPAN)], ["doc_id", "spans"])

    return S.plain(df, id_col, text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(S.tidy(run), "doc_id bigint, spans array<struct<start: int, stop: int, kind: string, score: double>>")


def masked(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """text with each stretch of spans replaced by <secret>."""
    out, at = [], 0
    for a, b, *_ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, net: Network | None = None, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """df with the secrets in its texts masked, and their code points counted anew."""
    S.ship(df.sparkSession)
    S.need(df, text_col)
    net = net or train()
    at, names = df.columns.index(text_col), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(net)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = scanner.scan([t or "" for t in texts])
            cols = list(batch.columns)
            cols[at] = pa.array([masked(t, x) if x else t for t, x in zip(texts, found)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    out = df.mapInArrow(S.tidy(run), df.schema)
    if size_col and size_col in names:
        out = out.withColumn(size_col, F.length(F.col(f"`{text_col}`")).cast(df.schema[size_col].dataType))
    return out
