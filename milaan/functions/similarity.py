"""Jaro-Winkler similarity and greedy token matching from built-in functions only.

Everything stays in the JVM: the character walk is an ``aggregate`` over positions that carries the unmatched rest of
the second word (matched characters are blanked out) and the matched characters of the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIKE = 0.88
_BLANK = "\u0001"


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _char(s: Column, at: Column) -> Column:
    return s.substr(at, F.lit(1))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Similarity of two non-empty words, with half the transpositions rounded down and a prefix bonus of up to 4."""
    len_a, len_b = F.length(a), F.length(b)
    reach = F.greatest(F.lit(0), F.floor(F.greatest(len_a, len_b) / 2).cast("int") - 1)

    def step(state: Column, i: Column) -> Column:
        low = F.greatest(F.lit(1), i - reach)
        window = state["rest"].substr(low, F.greatest(F.lit(0), F.least(len_b, i + reach) - low + 1))
        found = F.position(_char(a, i), window)

        def take(p: Column) -> Column:
            blanked = F.overlay(state["rest"], F.lit(_BLANK), low + p - 1, F.lit(1))
            return F.struct(
                F.when(p > 0, blanked).otherwise(state["rest"]).alias("rest"),
                F.when(p > 0, F.concat(state["hits"], _char(a, i))).otherwise(state["hits"]).alias("hits"),
            )

        return bind(found, take)

    start = F.struct(b.alias("rest"), F.lit("").alias("hits"))
    walked = F.aggregate(F.sequence(F.lit(1), len_a), start, step)

    def score(w: Column) -> Column:
        m = F.length(w["hits"])
        hit_places = F.filter(F.sequence(F.lit(1), len_b), lambda j: _char(w["rest"], j) == _BLANK)
        swapped = F.size(F.filter(hit_places, lambda j, k: _char(b, j) != _char(w["hits"], k + 1)))
        jaro = (m / len_a + m / len_b + (m - F.floor(swapped / 2)) / m) / 3
        return F.when(m == 0, F.lit(0.0)).otherwise(bind(jaro, lambda s: s + _prefix(a, b) * 0.1 * (1 - s)))

    return F.when(a == b, F.lit(1.0)).otherwise(bind(walked, score))


def _prefix(a: Column, b: Column) -> Column:
    shorter = F.least(F.length(a), F.length(b))
    out = F.lit(0)
    for n in (1, 2, 3, 4):
        out = F.when((shorter >= n) & (a.substr(1, n) == b.substr(1, n)), F.lit(n)).otherwise(out)
    return out


def _ceiling(a: Column, b: Column) -> Column:
    """No similarity of two words is above this: characters the other word lacks can never match."""
    len_a, len_b = F.length(a), F.length(b)
    m = F.least(F.length(_shared(a, b)), F.length(_shared(b, a)))
    jaro = (m / len_a + m / len_b + 1) / 3
    return jaro + _prefix(a, b) * 0.1 * (1 - jaro)


def _shared(a: Column, b: Column) -> Column:
    """The characters of ``a`` that occur anywhere in ``b``."""
    others = F.call_function("translate", a, b, F.lit(""))
    return F.call_function("translate", a, others, F.lit(""))


def similarity_if_alike(a: Column, b: Column) -> Column:
    """Jaro-Winkler where it can reach the threshold, else 0: the character walk is skipped for clearly unlike words."""
    return F.when(_ceiling(a, b) < ALIKE - 1e-9, F.lit(0.0)).otherwise(jaro_winkler(a, b))


def unlike_pairs(tokens_a: Column, tokens_b: Column) -> Column:
    """Position by position, the pairs below the threshold, written as ``'x' vs 'y'``."""
    told = F.zip_with(
        tokens_a,
        tokens_b,
        lambda x, y: F.when(
            similarity_if_alike(x, y) < ALIKE, F.concat(F.lit("'"), x, F.lit("' vs '"), y, F.lit("'"))
        ),
    )
    return F.filter(told, lambda t: t.isNotNull())


def tokens_within(small: Column, big: Column) -> Column:
    """Each token of ``small`` in turn takes its best remaining token of ``big``; true when all are alike."""

    def step(state: Column, token: Column) -> Column:
        sims = F.transform(state["left"], lambda r: similarity_if_alike(token, r))

        def take(s: Column) -> Column:
            best = F.array_max(s)
            at = F.array_position(s, best).cast("int")
            rest = F.concat(
                F.slice(state["left"], F.lit(1), at - 1),
                F.slice(state["left"], at + 1, F.greatest(F.lit(0), F.size(state["left"]) - at)),
            )
            alike = best >= ALIKE
            return F.struct(
                F.when(alike, rest).otherwise(state["left"]).alias("left"),
                (state["ok"] & alike).alias("ok"),
            )

        return F.when(state["ok"], bind(sims, take)).otherwise(state)

    start = F.struct(big.alias("left"), F.lit(True).alias("ok"))
    return F.aggregate(small, start, step, lambda state: state["ok"])
