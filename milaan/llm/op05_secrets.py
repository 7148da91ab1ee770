"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, the other of ordinary identifiers.  Their samples are labelled by the patterns: what the patterns
catch is random, every other run of token characters is ordinary; transitions are counted over all documents and summed by Spark.
A run of at least ``LEAST`` token characters that no pattern caught is a secret if it holds a letter and the ratio favours the
random model by ``PER_CHAR`` nats a character and ``TOTAL`` nats in all.

Only texts that hold a keyword, the key prefix or a long run are looked at with the patterns; the rest cannot match.
Defined results: null and empty texts have no spans; positions count code points, end exclusive; a pattern's failing matches are
dropped after they have used up their text; repeated rows are scanned one by one; without any labelled secret nothing is
added to the patterns.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milaan.llm.common import prepare, table, text_slices

# Fixed by the contract: kind, pattern, group that holds the secret, its least length.
PATTERNS = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+", re.A), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+", re.A), 0, 32),
)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "markov")
MARKOV = "markov"
LEAST = 20
PER_CHAR = 0.5
TOTAL = 15.0
SMOOTH = 0.5
BACK_OFF = 500.0  # so a few unlabelled secrets among the identifiers do not make their own transitions ordinary
SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Code 0 stands for everything else, so a run's first and last transitions are learned too.
CODE = np.zeros(256, np.int64)
CODE[np.frombuffer(SIGNS, np.uint8)] = np.arange(1, len(SIGNS) + 1)
SIDE = len(SIGNS) + 1
HEX = np.zeros(256, bool)
HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the secret itself) of what the patterns catch."""
    out = []
    for k, (_, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end(), m.start(group)))
    return sorted(out)


def _runs(on: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal runs of at least ``least`` bytes, none across rows."""
    n = len(on)
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = on[1:] != on[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    use = np.diff(at) >= least
    start, end = at[:-1][use], at[1:][use]
    real = on[start] if n else start > 0
    return start[real], end[real]


def _suspects(raw: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Rows on which a pattern can match."""
    data = raw.tobytes()
    low = data.lower()
    at = []
    for word, where in [(w, low) for w in KEYWORDS] + [(b"AKIA", data)]:
        i = where.find(word)
        while i >= 0:
            at.append(i)
            i = where.find(word, i + 1)
    at.extend(_runs(HEX[raw], offsets, 32)[0].tolist())
    return set((np.searchsorted(offsets, at, "right") - 1).tolist()) if at else set()


def _caught(raw: np.ndarray, offsets: np.ndarray) -> dict[int, tuple[str, list]]:
    out = {}
    for row in _suspects(raw, offsets):
        text = raw[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
        spans = base_spans(text)
        if spans:
            out[row] = (text, spans)
    return out


def _steps(code: np.ndarray) -> np.ndarray:
    """Transitions inside runs and at their ends."""
    step = code[:-1] * SIDE + code[1:]
    return step[step > 0]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every, random = np.zeros(SIDE * SIDE, np.int64), np.zeros(SIDE * SIDE, np.int64)
    for _, raw, offsets, _ in text_slices(batches):
        code = CODE[raw]
        step = np.concatenate((code, [0])) if len(code) else np.zeros(1, np.int64)
        pair = np.concatenate(([0], code)) * SIDE + step
        edge = offsets[(offsets > 0) & (offsets < len(code))]
        every += np.bincount(pair, minlength=SIDE * SIDE)
        # Rows that touch: the pair across them is two ends.
        cut = np.bincount(pair[edge], minlength=SIDE * SIDE)
        every += np.bincount(code[edge - 1] * SIDE, minlength=SIDE * SIDE) + np.bincount(code[edge], minlength=SIDE * SIDE) - cut
        for text, spans in _caught(raw, offsets).values():
            upto = 0
            for _, _, end, secret in spans:
                if secret >= upto:  # a secret that two patterns catch is learned once
                    own = np.frombuffer(text[secret:end].encode(), np.uint8)
                    random += np.bincount(_steps(np.concatenate(([0], CODE[own], [0]))), minlength=SIDE * SIDE)
                    upto = end
    for kind, sums in ((0, np.maximum(every - random, 0)), (1, random)):
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"random": np.full(len(at), kind), "step": at, "n": sums[at]})


def fit(docs: DataFrame) -> np.ndarray | None:
    """Log-likelihood ratio of every transition, random against ordinary; nothing if no secret was labelled."""
    rows = docs.select("text").mapInArrow(_learn, "random long, step long, n long").groupBy("random", "step").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, SIDE, SIDE))
    for r in rows:
        counts[r["random"], r["step"] // SIDE, r["step"] % SIDE] = r["n"]
    counts[:, 0, 0] = 0
    if not counts[1].any():
        return None
    # A rare context falls back on how often each character comes at all.
    single = counts.sum(1) + SMOOTH
    single /= single.sum(1, keepdims=True)
    chance = np.log((counts + BACK_OFF * single[:, None, :]) / (counts.sum(2, keepdims=True) + BACK_OFF))
    return (chance[1] - chance[0]).ravel()


def _scan(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for rows, raw, offsets, _ in text_slices(batches):
            caught = _caught(raw, offsets)
            spans: dict[int, list[tuple[int, int, int]]] = {r: [x[:3] for x in s] for r, (_, s) in caught.items()}
            code = CODE[raw]
            starts, ends = _runs(code > 0, offsets, LEAST) if ratio is not None else ([], [])
            for a, b in zip(starts, ends, strict=True):
                own = np.concatenate(([0], code[a:b], [0]))
                total = ratio[own[:-1] * SIDE + own[1:]].sum()
                if total < TOTAL or total < PER_CHAR * (b - a) or not (own[1:-1] <= 52).any():
                    continue
                row = int(np.searchsorted(offsets, a, "right")) - 1
                start = int(np.count_nonzero((raw[offsets[row] : a] & 0xC0) != 0x80))
                end = start + int(b - a)
                if all(end <= s or start >= e for s, _, e in spans.get(row, ())):
                    spans.setdefault(row, []).append((start, 3, end))
            out = {n: np.zeros(rows.num_rows, np.int64) for n in ("n_assign", "n_access", "n_hex", "n_markov")}
            names, digests = [""] * rows.num_rows, [hashlib.sha256(b"").hexdigest()] * rows.num_rows
            for row, found in spans.items():
                found.sort()
                for _, k, _ in found:
                    out[f"n_{KINDS[k]}"][row] += 1
                names[row] = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
                digests[row] = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found if k < 3).encode()).hexdigest()
            kept = {f.name: rows.column(i) for i, f in enumerate(rows.schema) if f.name not in MADE}
            yield pa.RecordBatch.from_pydict(kept | out | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(names, pa.string())})

    return scan


MADE = ("n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans")


def secrets(docs: DataFrame) -> DataFrame:
    """The documents with the number of spans of each kind, the digest of the pattern spans, and all spans."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(*[c for c in docs.columns if c in MADE])
    model = spark.sparkContext.broadcast(fit(docs))
    out = docs.withColumns({n: F.lit("" if n in ("base_sha256", "spans") else 0).cast("string" if n in ("base_sha256", "spans") else "long") for n in MADE})
    return out.mapInArrow(_scan(model), out.schema)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
