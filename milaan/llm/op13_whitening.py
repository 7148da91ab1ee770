"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become whole numbers (``floor(64 c) + 1000000``); the fit list holds each distinct one once.  The leading eigenvectors of
its covariance are found without ever forming the covariance: a block Q of a few columns goes to the executors, which send back
the sums of ``z (z' Q)`` over the centred vectors z, and that is one pass.  A Lanczos run of a few passes bounds the spectrum from
below.  Every round damps what lies between that bound and the smallest Ritz value of the block by a Chebyshev polynomial
(``DEGREE`` passes of the three-term recurrence), orthogonalises by QR and rotates by Rayleigh and Ritz.  Rounds go on until the
residuals of all wanted pairs are down to rounding; a block that converges slowly, because eigenvalues lie close together, is
widened, at the latest to the whole space, where one Rayleigh-Ritz step is exact.  At the end the covariance of the whitened fit
list is measured against the identity.

The driver holds blocks of dimensions x block columns, however many vectors there are; sums are combined on the executors.

Defined results: null vectors and those with null or non-finite entries, or with an entry of 2^46 or more (its whole number would
not be exact), take no part, neither do vectors of another length than the most common one (of two equally common, the longer);
rows that repeat an id are rows of their own; a null vec_id comes back as null; components whose eigenvalue is not above
``RANK_TOLERANCE`` of the largest do not exist (n vectors span n - 1 directions at most), so a table of one distinct vector, like
an empty one, has no rows.  ``deviation`` is exact as decimal(38, 0); the query's long is null where it does not fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.llm.common import prepare, table
from milaan.sources.writers import materialized

COMPONENTS = 16
# Columns of the block beside the wanted ones, passes of a filter, passes of the Lanczos run.
GUARD, DEGREE, LANCZOS = 32, 8, 10
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 46)
RANK_TOLERANCE = 1e-11
# Residuals relative to the largest eigenvalue: reached by rounding alone; and the most that a certified pair may have.
ROUNDING, CERTIFIED = 1e-15, 1e-12
SEED = 13


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): the rows that take part, as whole numbers."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    rows = vectors.select(F.col(key).alias("id"), F.transform(vector, lambda c: c.cast("double")).alias("v"))
    rows = rows.filter(F.coalesce(F.forall("v", fine), F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("top")).first()["top"]
    x = F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT)
    return rows.filter(F.size("v") == (sizes["d"] if sizes else 0)).select("id", x.alias("x"))


@dataclass
class Centre:
    """Count and exact sums of the fit list; the mean as a whole part and what is left of the division."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.floor = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = [s % self.n for s in self.sums]
        self.part = np.array([r / self.n for r in self.rest])

    def numbers(self, batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(batch.num_rows, len(self.sums)) - self.floor

    def centred(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.numbers(batch) - self.part

    def deviation(self, whole: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n x - S)^2, exact."""
        largest = self.n * (int(np.abs(whole).max(initial=0)) + 1)
        exact = np.int64 if largest**2 * len(self.sums) < 1 << 62 else object
        apart = whole.astype(exact) * self.n - np.array(self.rest, exact)
        return pa.array([Decimal(int(s)) for s in (apart * apart).sum(1)], pa.decimal128(38, 0))


def centre(fit: DataFrame, dimensions: int) -> Centre | None:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dimensions, object), 0
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dimensions)
                total, n = total + np.array([int(s) for s in x.sum(0)], object), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"i": range(dimensions), "n": [n] * dimensions, "s": pa.array([Decimal(s) for s in total], pa.decimal128(38, 0))})

    got = fit.select("x").mapInArrow(sums, "i long, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    return Centre(got[0]["n"], [int(r["s"]) for r in sorted(got, key=lambda r: r["i"])]) if got else None


def summed(fit: DataFrame, mid: Centre, kernel: Callable[[np.ndarray], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """The sum of ``kernel(z)``, a rows x columns matrix, over blocks z of the centred vectors: one pass."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((rows, columns)), False
        for b in batches:
            if b.num_rows:
                total, any_row = total + kernel(mid.centred(b)), True
        if any_row:
            yield pa.RecordBatch.from_pydict({"cell": np.arange(rows * columns), "y": total.ravel()})

    cells = fit.select("x").mapInArrow(partial, "cell long, y double").groupBy("cell").agg(F.sum("y").alias("y")).toArrow()
    out = np.zeros(rows * columns)
    out[cells["cell"].to_numpy()] = cells["y"].to_numpy()
    return out.reshape(rows, columns)


def lowest(apply: Callable, dimensions: int, steps: int, draw: np.random.Generator) -> float:
    """A bound below the spectrum, from a Lanczos run: the least Ritz value less its residual, at least 0."""
    q, alphas, betas = [draw.standard_normal(dimensions)], [], []
    q[0] /= np.linalg.norm(q[0])
    for _ in range(min(steps, dimensions)):
        w = apply(q[-1][:, None])[:, 0]
        alphas.append(q[-1] @ w)
        basis = np.array(q)
        for _ in range(2):
            w = w - basis.T @ (basis @ w)
        betas.append(np.linalg.norm(w))
        if betas[-1] <= 1e-12 * max(abs(a) for a in alphas):
            break
        q.append(w / betas[-1])
    values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))
    return max(0.0, float(values[0] - betas[-1] * abs(vectors[-1, 0])))


def filtered(apply: Callable, block: np.ndarray, low: float, cut: float, top: float) -> np.ndarray:
    """The scaled Chebyshev recurrence: what lies in [low, cut] is damped, what lies near top keeps its size."""
    half, mid = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - mid)
    last, now = block, (apply(block) - mid * block) * (sigma / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / first - sigma)
        last, now = now, (apply(now) - mid * now) * (2 * after / half) - (sigma * after) * last
        sigma = after
    return now


def leading(apply: Callable, dimensions: int, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors, largest residual relative to the first eigenvalue) of the ``wanted`` leading pairs."""
    draw = np.random.default_rng(seed)
    wanted = min(wanted, dimensions)
    width = min(dimensions, wanted + GUARD)
    block, low, before, stalled = draw.standard_normal((dimensions, width)), None, np.inf, 0
    while True:
        q, _ = np.linalg.qr(block)
        image = apply(q)
        inner = q.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = max(values[0], 0.0)
        off = np.linalg.norm(image[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max(initial=0) / (top or 1.0)
        stalled = stalled + 1 if off > before / 2 else 0
        if off <= ROUNDING or top == 0 or width == dimensions or (off <= CERTIFIED and stalled):
            if off > CERTIFIED:
                raise ArithmeticError(f"eigenpairs not certified: residual {off:.1e}")
            return values[:wanted], q[:, :wanted], float(off)
        if off > before / 10 and off > CERTIFIED:
            width = min(dimensions, 2 * width)
            q = np.hstack([q, draw.standard_normal((dimensions, width - q.shape[1]))])
        before = off
        low = lowest(apply, dimensions, LANCZOS, draw) if low is None else low
        cut = max(values[-1], low + 1e-6 * top)
        block = q if width == dimensions or cut >= top else filtered(apply, q, low, cut, top)


@dataclass
class Whitening:
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    identity_error: float


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of (id, x) rows; None where there is nothing to whiten."""
    fit = materialized(rows.select("x").distinct(), "fit-list")
    first = fit.first()
    if first is None or not len(first["x"]):
        return None
    d = len(first["x"])
    mid = centre(fit, d)
    trace = float(summed(fit, mid, lambda z: (z * z).sum(0)[:, None], d, 1).sum()) / mid.n
    if not trace > 0:
        return None
    apply = lambda q: summed(fit, mid, lambda z: z.T @ (z @ q), d, q.shape[1]) / mid.n
    values, vectors, residual = leading(apply, d, components)
    real = values > RANK_TOLERANCE * values[0]
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    turn = vectors / np.sqrt(values)

    def spread(z: np.ndarray) -> np.ndarray:
        w = np.hstack([z @ turn, np.ones((len(z), 1))])
        return w.T @ w

    gram = summed(fit, mid, spread, k + 1, k + 1) / mid.n
    cov = gram[:k, :k] - np.outer(gram[:k, k], gram[:k, k])
    return Whitening(mid, values, vectors, trace, residual, float(np.abs(cov - np.eye(k)).max()))


def projected(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>) of (id, x) rows."""
    mid, turn = model.centre, model.vectors / np.sqrt(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                whole = mid.numbers(b)
                white = (whole - mid.part) @ turn
                yield pa.RecordBatch.from_pydict({"id": b.column(0), "deviation": mid.deviation(whole), "whitened": pa.array(list(white), pa.list_(pa.float64()))})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(project, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """One row per usable vector with its whitened form, and the fitted whitening."""
    prepare(vectors.sparkSession)
    rows = usable(vectors, key, vector)
    model = fitted(rows, components)
    if model is None:
        return rows.limit(0).select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")), None
    return projected(rows, model), model


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    ratio = [float(v / model.trace) for v in model.values] if model else []
    share: Column = F.array(*[F.lit(r) for r in ratio]) if ratio else F.array().cast("array<double>")
    each = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.centre.n if model else 0).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", share[F.col("at")].alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
