"""Spelling variants: words one edit apart, found by search schemes on FM-indexes of the vocabulary.

Of two words one edit apart, one half of either is free of the edit.  Search one matches the first half of the asking word exactly and
extends to the right across the second with one error; search two matches the second half exactly and extends to the left.  Each runs
on an FM-index of delimited words that steps in its direction (search two's index is that of the words read backwards): a state
is an interval of suffix ranks, one step is two searches in the sorted (sign, rank) list of the Burrows-Wheeler transform, and where
the error may fall the signs that occur in the interval are tried.  Work for a state is bounded by the alphabet, however many
words its interval holds.  Search two counts only pairs whose common beginning is shorter than the first half, so no
pair is found twice, and tiles return a count and the best word per asking word, never pairs.

The vocabulary is dealt by exact halves: a word is posted under the (at most two) first and last parts that words one edit away can
have as their exact half, and asks where its own halves are posted.  Small groups share an index by hash; a part with more than
``LIMIT`` words is cut into tiles of words by asking words.  So no index and no task grows with the vocabulary.

Defined results: a null text has no words; a null doc_id counts as the empty string in the hash; rows that repeat an id are counted as
often as they come, and equal texts too; ties for the best near word go to the smallest in code-point order; texts of any length
are read whole, words too; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.llm.common import prepare, small, table
from milaan.llm.op03_jaccard import groups
from milaan.sources.writers import materialized

LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
DAMAGE = 199
# Words of one index, and asking words worked on at a time.
LIMIT, ASKING = 1 << 16, 1 << 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[^a-zÀ-ÿ]+"


def vocabulary(docs: DataFrame, damage: int = DAMAGE, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of the documents, every ``damage``-th run (by hash of id and run) short of one letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.split(F.translate("text", UPPER, LOWER), BETWEEN)).alias("run"))
    long = runs.filter(F.length("run") >= LEAST_LENGTH).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.when(at > 0, F.substring(F.col("run"), F.lit(1), at)).otherwise(""), F.substring(F.col("run"), at + 2, F.length("run")))
    words = long.select(F.when(F.col("h") % damage == 0, short).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("word").alias("n")).filter(F.col("n") >= least)


@dataclass
class Index:
    """The FM-index of delimited words; prefixing the pattern by a sign extends the word to the right (words lie backwards)."""

    signs: np.ndarray  # code points; their places + 1 are the symbols, 0 is the delimiter
    ranked: np.ndarray  # symbol * (n + 1) + suffix rank, sorted: the transform, and its first column at once
    before: np.ndarray  # the transform: the symbol before each suffix
    word: np.ndarray  # the word each suffix lies in

    @classmethod
    def of(cls, words: list[str]) -> Index:
        text = np.frombuffer(("\0" + "\0".join(w[::-1] for w in words) + "\0").encode("utf-32-le"), np.uint32)
        signs, symbols = np.unique(text, return_inverse=True)
        n = len(text)
        ends = np.flatnonzero(symbols == 0)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # signs up to the next delimiter
        # Ranks of the first h signs (none beyond the delimiter) become ranks of the first 2 h.
        rank, h = symbols.astype(np.int64), 1
        while h <= left.max():
            there = np.zeros(n, np.int64)
            there[:-h] = rank[h:] + 1
            rank = np.unique(rank * (n + 2) + np.where(left >= h, there, 0), return_inverse=True)[1].astype(np.int64)
            h *= 2
        order = np.argsort(rank, kind="stable")
        before = symbols[order - 1]
        return cls(signs[1:], np.sort(before.astype(np.int64) * (n + 1) + np.arange(n)), before, np.searchsorted(ends, order) - 1)

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol.astype(np.int64) * (len(self.before) + 1)
        return np.searchsorted(self.ranked, base + low), np.searchsorted(self.ranked, base + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol): the signs that occur before the suffixes of each interval, delimiters left out."""
        kinds = len(self.signs)
        size = high - low
        few = np.flatnonzero(size <= kinds)
        many = np.flatnonzero(size > kinds)
        owner = np.repeat(few, size[few])
        row = np.arange(len(owner)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]) + low[owner]
        seen = np.unique(owner * (kinds + 1) + self.before[row])
        owner, symbol = seen // (kinds + 1), seen % (kinds + 1)
        state = np.concatenate([owner[symbol > 0], np.repeat(many, kinds)])
        return state, np.concatenate([symbol[symbol > 0], np.tile(np.arange(1, kinds + 1), len(many))])

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of each word, one row each, -1 for signs that the index lacks and after the end; and the lengths."""
        size = np.array([len(w) for w in words])
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        place = np.minimum(np.searchsorted(self.signs, text), len(self.signs) - 1)
        out = np.full((len(words), size.max() + 1), -1, np.int64)
        out[np.repeat(np.arange(len(words)), size), np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)] = np.where(self.signs[place] == text, place + 1, -1)
        return out, size

    def forward(self, code, who, at, low, high):
        """Match the next sign of each asking word; states that cannot go."""
        symbol = code[who, at]
        go = symbol > 0
        who, at = who[go], at[go]
        low, high = self.step(low[go], high[go], symbol[go])
        go = high > low
        return who[go], at[go] + 1, low[go], high[go]

    def one_error(self, asking: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asking word, index word): all pairs one edit apart whose edit lies behind the ``exact`` first signs."""
        code, size = self.codes(asking)
        who = np.arange(len(asking))
        state = (who, np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), np.full(len(who), int((self.before == 0).sum())))
        found_who, found_word, behind, wrong = [], [], [], None
        for _ in range(exact.max()):  # the exact part
            wait = state[1] == exact[state[0]]
            behind.append([x[wait] for x in state])
            state = self.forward(code, *[x[~wait] for x in state])
        state = [np.concatenate(x) for x in zip(*behind, state, strict=True)]
        while True:
            who, at, low, high = state
            next_symbol = np.where(at < size[who], code[who, at], 0)
            owner, symbol = self.children(low, high)
            other = symbol != next_symbol[owner]
            owner, symbol = owner[other], symbol[other]
            more_low, more_high = self.step(low[owner], high[owner], symbol)
            real = more_high > more_low
            owner, more_low, more_high = owner[real], more_low[real], more_high[real]
            inside = at[owner] < size[who[owner]]
            # A sign of the asking word that equals the next one is left out later; one that is put in before its like, too.
            after = code[who, np.minimum(at + 1, size[who])]
            drop = (at < size[who]) & ((at + 1 >= size[who]) | (after != next_symbol) | (next_symbol < 0))
            new = [
                (who[owner], at[owner], more_low, more_high),
                (who[owner[inside]], at[owner[inside]] + 1, more_low[inside], more_high[inside]),
                (who[drop], at[drop] + 1, low[drop], high[drop]),
            ]
            if wrong is not None:
                new.append(wrong)
            wrong = tuple(np.concatenate(x) for x in zip(*new, strict=True))
            done = wrong[1] == size[wrong[0]]
            first, last = self.step(wrong[2][done], wrong[3][done], np.zeros(done.sum(), np.int64))
            whole = last > first
            found_who.append(wrong[0][done][whole])
            found_word.append(self.word[self.ranked[first[whole]]])
            wrong = self.forward(code, *[x[~done] for x in wrong])
            go = at < size[who]
            state = self.forward(code, who[go], at[go], low[go], high[go])
            if not len(state[0]) and not len(wrong[0]):
                pairs = np.unique(np.concatenate(found_who).astype(np.int64) * (self.word.max() + 2) + np.concatenate(found_word))
                return pairs // (self.word.max() + 2), pairs % (self.word.max() + 2)


def _half(length: int, backwards: bool) -> int:
    return length - length // 2 if backwards else length // 2


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile: for each asking word the number of its near words here, and the best of them."""
    for group in groups(batches, ("bin",)):
        backwards = group.column("bin")[0].as_py()[0] == "1"
        asks = np.array(group.column("asks").to_pylist(), bool)
        key, count = group.column("key").to_pylist(), np.array(group.column("n").to_pylist(), np.int64)
        entry = {key[i]: count[i] for i in np.flatnonzero(~asks)}
        asking = sorted({key[i] for i in np.flatnonzero(asks)})
        if not entry or not asking:
            continue
        names = list(entry)
        index, n = Index.of(names), np.array(list(entry.values()))
        plain = [w[::-1] for w in names] if backwards else names
        place = np.empty(len(plain), np.int64)
        place[sorted(range(len(plain)), key=plain.__getitem__)] = np.arange(len(plain))
        for first in range(0, len(asking), ASKING):
            some = asking[first : first + ASKING]
            who, word = index.one_error(some, np.array([_half(len(w), backwards) for w in some]))
            if backwards:
                begin = [some[i][len(some[i]) - len(some[i]) // 2 :] for i in who]
                new = np.array([not names[j].endswith(b) for j, b in zip(word, begin, strict=True)], bool)
                who, word = who[new], word[new]
            order = np.lexsort((place[word], -n[word], who))
            who, word = who[order], word[order]
            start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([some[i][::-1] if backwards else some[i] for i in who[start]], pa.string()),
                "n_near": np.diff(np.r_[start, len(who)]).astype(np.int64), "best_n": n[word[start]],
                "best": pa.array([plain[j] for j in word[start]], pa.string()),
            })


def _dealt(words: DataFrame, backwards: bool, limit: int) -> DataFrame:
    """(bin, asks, key, n): words posted under the parts they can be found by, and asking under their own."""
    key = F.reverse("word") if backwards else F.col("word")
    half = lambda length: (length - F.floor(length / 2) if backwards else F.floor(length / 2)).cast("int")
    part = lambda size: F.substring(key, F.lit(1), size)
    size = F.length("word")
    parts = F.array_distinct(F.array(*[half(F.greatest(size + d, F.lit(LEAST_LENGTH))) for d in (-1, 0, 1)]))
    posted = words.select(key.alias("key"), "n", F.explode(parts).alias("size")).select("key", "n", F.substring(F.col("key"), F.lit(1), F.col("size")).alias("part"))
    asking = words.select(key.alias("key"), "n", part(half(size)).alias("part"))
    counts = posted.groupBy("part").agg(F.count("key").alias("m")).filter(F.col("m") > limit)
    # A hot part holds more than ``limit`` words, so there are few of them; the table is counted before it is sent.
    hot = small(materialized(counts.select("part", F.ceil(F.col("m") / limit).cast("int").alias("cuts")), "hot-parts"))
    tag = F.lit("1" if backwards else "0")
    bins = max(1, -(-words.count() * 2 // limit))
    plain = F.concat_ws(":", tag, F.pmod(F.xxhash64("part"), F.lit(bins)).cast("string"))
    own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("cuts"))
    every = F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1)))

    def to_bins(rows: DataFrame, asks: bool) -> DataFrame:
        met = rows.join(hot, "part", "left").withColumn("other", every)
        across = (F.col("other"), own) if asks else (own, F.col("other"))
        name = F.when(F.col("cuts").isNull(), plain).otherwise(F.concat_ws(":", tag, F.col("part"), *[x.cast("string") for x in across]))
        return met.select(name.alias("bin"), F.lit(asks).alias("asks"), "key", "n")

    return to_bins(posted, False).unionByName(to_bins(asking, True))


def near(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near words; ``words`` is a written table of (word, n)."""
    tiles = max(1, -(-words.count() * 6 // limit))
    dealt = _dealt(words, False, limit).unionByName(_dealt(words, True, limit)).repartition(tiles, "bin").sortWithinPartitions("bin")
    found = dealt.mapInArrow(_tile, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b")["w"].alias("best"), (-F.col("b")["m"]).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of a written table (word, form) without circles: every round doubles the way that has been gone."""
    now = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialized(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = moved.drop("moved")
        if not moved.filter("moved").take(1):
            return now


def variants(words: DataFrame, limit: int = LIMIT, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table (word, n)."""
    prepare(words.sparkSession)
    words = materialized(words, "vocabulary")
    met = words.join(near(words, limit), "word", "left")
    enough: Column = F.col("best_n") >= factor * F.col("n")
    formed = materialized(met.select(
        "word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


# Near words by equal strings: a letter left out of the longer one, or both with one letter blanked at the same place.
ORACLE = """
WITH RECURSIVE bits(i, c, step) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT COALESCE(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
long AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM long),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h
  FROM coded, crc),
made AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
shorter AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS w FROM places),
blanked AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS w FROM places),
near AS (
  SELECT s.word, o.word AS other, o.n AS m FROM shorter s JOIN words o ON s.w = o.word
  UNION SELECT o.word, s.word, s.n FROM shorter s JOIN words o ON s.w = o.word
  UNION SELECT a.word, b.word, b.n FROM blanked a JOIN blanked b ON a.w = b.w WHERE a.word <> b.word),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, min_by(other, (-m, encode(other))) AS other FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain(word, place) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.place = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.place AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed e ON c.place = e.word WHERE e.form IS NULL
"""
