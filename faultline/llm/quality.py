"""2. Quality rules with verdicts on hosts.

Each document is measured by a few rules. Rule failures are then counted by host, every host's
failure rate is shrunk towards a beta prior that is fitted to all hosts by the method of moments
for the beta-binomial, and a host whose shrunk rate reaches ``MAX_RATE`` for some rule is refused;
that verdict is joined back to its documents.

Measures are made once and written without the text. Counts by host are summed before the shuffle, so a
hot host costs a row per task. Only refused hosts are joined back: they are broadcast up to
``BROADCAST_HOSTS`` rows, and beyond that joined by a salted key, so that one host's documents spread.

Defined results: null text has no words; null and empty hosts are not judged; a host is the host name of a URL, else the
value as it stands, in lower case; equal rows count each; very long texts are
measured whole; hosts of equal rates are judged alike; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as S

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
MAX_RATE = 0.5
BROADCAST_HOSTS = 50_000
SALTS = 32
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Failures that are counted by host.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"n_words > 0 and 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words",
    "dup_lines": f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines",
}


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that stand twice or more in the text."""
    n = len(words)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    size = len(number)
    if n < 4 or size == n:
        return 0
    a = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pair = a[:-1] * size + a[1:]
    if size >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * size + a[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[at + k] = True
    return int(inside.sum())


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of a text. Bytes split at the same six white-space characters as the word pattern."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the MEASURES, a row for each row of df."""
    S.ship(df.sparkSession)
    S.need(df, id_col, text_col, host_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array([measure(t) for t in S.texts(batch)], np.int64).reshape(-1, len(MEASURES))
            yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array(m[:, k]) for k in range(len(MEASURES)))], ["doc_id", "host", *MEASURES])

    value = F.lower(F.trim(F.col(f"`{host_col}`").cast("string")))
    name = F.regexp_extract(value, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    host = F.when(name != "", name).when(value != "", value)
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), host.alias("host"))
    return rows.mapInArrow(S.tidy(run), "doc_id bigint, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def beta_prior(hosts: int, n: float, f: float, n2: float, f2: float) -> tuple[float, float]:
    """Moments of the beta-binomial. n, f: all documents and failures; n2: sum of squared counts; f2: sum of failures squared over count."""
    if not n or hosts < 2:
        return 1.0, 1.0
    p = min(max(f / n, 1e-6), 1 - 1e-6)
    free = n - n2 / n - (hosts - 1)
    spread = ((f2 - f * f / n) / (p * (1 - p)) - (hosts - 1)) / free if free > 0 else 0.5
    spread = min(max(spread, 1e-3), 0.5)
    weight = 1 / spread - 1
    return p * weight, (1 - p) * weight


def host_rates(measures: DataFrame) -> DataFrame:
    """A row for each host: host, n, and for each rule its shrunk failure rate rate_<rule>."""
    by = measures.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.expr(f"cast({rule} as int)")).alias(f"f_{r}") for r, rule in RULES.items()))
    by = S.stash(by, "host-counts")
    sums = by.agg(F.count("*").alias("hosts"), F.sum("n").cast("double").alias("n"), F.sum(F.expr("double(n) * n")).alias("n2"), *(F.sum(f"f_{r}").cast("double").alias(f"f_{r}") for r in RULES), *(F.sum(F.expr(f"double(f_{r}) * f_{r} / n")).alias(f"q_{r}") for r in RULES)).first()
    out: list[Column] = [F.col("host"), F.col("n")]
    for r in RULES:
        a, b = beta_prior(sums["hosts"], sums["n"] or 0, sums[f"f_{r}"] or 0, sums["n2"] or 0, sums[f"q_{r}"] or 0)
        out.append(((F.col(f"f_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias(f"rate_{r}"))
    return by.select(*out)


def join_verdicts(measures: DataFrame, refused: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS, salts: int = SALTS) -> DataFrame:
    """measures with host_refused."""
    marked = refused.select("host", F.lit(True).alias("_refused"))
    if refused.count() <= broadcast_hosts:
        out = measures.join(F.broadcast(marked), "host", "left")
    else:
        salted = marked.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
        out = measures.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")
    return out.withColumn("host_refused", F.coalesce("_refused", F.lit(False))).drop("_refused")


def judge(df: DataFrame, max_rate: float = MAX_RATE, **columns: str) -> DataFrame:
    """doc_id, host, the MEASURES, base_failed, host_refused and kept, a row for each row of df."""
    m = S.stash(measured(df, **columns), "quality")
    refused = S.stash(host_rates(m).filter(" or ".join(f"rate_{r} >= {max_rate}" for r in RULES)), "refused-hosts")
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    return join_verdicts(m, refused).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("host_refused"))
