"""Quality rules with an isolation forest on their statistics.

Each document's rule statistics are computed with numpy over the UTF-8 bytes of whole texts. Fixed rules reject what has
fewer than MIN_WORDS words or more than MAX_REPEAT_PERCENT of its words in repeated windows. An isolation forest over
ratios of the statistics judges the rest: short path lengths over random splits mark a document as anomalous.

The forest is fitted on every labelled row that passes the fixed rules, in two halves by a hash of doc_id. Trees grow on the
good rows of one half. Splits are drawn over the range that all rows of the half span, good and bad, rather than over the
good ones alone: a statistic that good rows hardly have is split too, and what lies where none of them do is isolated at
once. As splits depend on that range only, each task counts its own rows at the bottom of every tree, the counts are added
up, and the sums give the path lengths: no row is left out of any tree, and the driver holds numbers by tree and node, never
rows. The other half, which no tree has seen, calibrates the threshold: of all cuts that reject at most GOOD_LOST of its good
rows, the one with the largest share of bad rows less twice that of good rows rejected, halfway between the scores on both
sides of it. Path lengths are whole multiples of 1 / UNIT, so that scores have a bounded number of levels (some 300,000 at
most) and held-out rows are counted by level exactly. The model depends on the rows alone, not on how they are dealt.

Defined results: a null or empty text has no words (base_failed); a null doc_id is judged like any other and never counts
as labelled; repeated rows are judged alike; with fewer than 64 labelled rows that pass the fixed rules, or 8 good ones in a half, there
is no forest and these rules alone decide; an empty table gives an empty result; other columns are kept by filter_quality and
ignored by judge, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import about
from octolith.llm.units import raw, text_slices
from octolith.session import materialize, release

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Trees, their greatest depth, the seed of the splits and the parts that a path's length is counted in.
TREES, DEPTH, SEED, UNIT = 100, 11, 7, 64
#: Share of the held-out good rows that the threshold may reject.
GOOD_LOST = 0.01
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_marks"]
STATS_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS + MORE)

_BYTE = np.zeros(256, np.uint8)  # bit flags of each byte
SPACE, SYMBOL, UPPER, MARK, LEAD = 1, 2, 4, 8, 16
_BYTE[[32, *range(9, 14)]] |= SPACE
_BYTE[list(SYMBOLS)] |= SYMBOL
_BYTE[65:91] |= UPPER
_BYTE[list(b"!?")] |= MARK
_BYTE[:128] |= LEAD
_BYTE[192:] |= LEAD
_MIX = np.random.default_rng(8).integers(1, 2**63, WINDOW + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of mask are true between each two offsets."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _codes(d: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A number for each segment of d between cuts; equal segments have equal numbers."""
    ends = np.r_[cut, len(d)].astype(np.int64)
    segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(d))])
    return segments.dictionary_encode().indices.to_numpy()


def _repeat_words(codes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document, the words within windows that occur twice or more in it."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return np.zeros(docs, np.int64)
    with np.errstate(over="ignore"):
        h = doc[:n].astype(np.uint64) * _MIX[WINDOW]
        for j in range(WINDOW):
            h = (h ^ (h >> np.uint64(29))) * _MIX[j] + codes[j : j + n].astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    h = h[at]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(docs, np.int64)
    at = at[np.isin(h, np.unique(twice))]
    # Equal hashes are checked against the words themselves.
    keys = np.stack([doc[at], *(codes[at + j] for j in range(WINDOW))], axis=1)
    order = np.lexsort(keys.T[::-1])
    same = (keys[order][1:] == keys[order][:-1]).all(axis=1)
    hit = np.zeros(len(at), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=docs)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of a large binary array of texts."""
    d, offsets = raw(texts)
    docs = len(texts)
    flag = _BYTE[d]
    space = (flag & SPACE) > 0
    out = {"word_chars": _sums(((flag & LEAD) > 0) & ~space, offsets)}
    for name, bit in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_marks", MARK)):
        out[name] = _sums((flag & bit) > 0, offsets)
    first = np.zeros(len(d) + 1, bool)  # a document begins here
    first[offsets] = True
    first = first[: len(d)]
    turn = np.empty(len(d), bool)  # a word or a gap begins here
    if len(d):
        turn[0], turn[1:] = True, space[1:] != space[:-1]
        turn |= first
    begin = np.flatnonzero(turn)
    word = ~space[begin]
    doc_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    doc = doc_of(begin[word])
    out["n_words"] = np.bincount(doc, minlength=docs)
    out["n_repeat_words"] = _repeat_words(_codes(d, begin)[word], doc, docs)
    newline = d == 10
    cut = newline.copy()
    cut[1:] |= newline[:-1]
    cut |= first
    at = np.flatnonzero(cut)
    line = ~newline[at]
    full = line & (_sums(~space, np.r_[at, len(d)]) > 0)
    doc = doc_of(at[full])
    out["n_lines"] = np.bincount(doc, minlength=docs)
    distinct = np.unique((doc << 32) | _codes(d, at)[full])
    out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct >> 32, minlength=docs)
    return out


#: The rows that base_failed() leaves, in SQL.
PASSED = f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words"


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


#: The statistics that are put into ratios, and how much of the good rows' own ratio each gets, so that short texts vary less.
RATIOS = [("word_chars", "n_words", 20), ("n_symbols", "word_chars", 100), ("n_upper", "word_chars", 100), ("n_marks", "n_words", 20), ("n_repeat_words", "n_words", 20), ("n_dup_lines", "n_lines", 4)]


def usual(s: dict[str, np.ndarray]) -> list[float]:
    """The ratios of all rows together."""
    return [float(s[a].sum() / max(1, s[b].sum())) for a, b, _ in RATIOS]


def features(s: dict[str, np.ndarray], prior: list[float]) -> np.ndarray:
    """Ratios of all statistics; none depends on a text's length. Roots spread what is rare."""
    out = [(s[a] + weight * p) / (s[b] + weight) for (a, b, weight), p in zip(RATIOS, prior, strict=True)]
    return np.stack([out[0], *map(np.sqrt, out[1:])], axis=1)


class IsolationForest:
    """Trees over random splits, each a heap of the same depth: feature, split and, at the bottom, path length.

    Splits are drawn from a box alone. Rows are then counted at the bottom of each tree, in as many parts as they lie in, and
    the sum of the counts settles the path lengths. From rows x in memory the constructor does all of it; box (x and more
    rows, say) spans the ranges that splits are drawn from.
    """

    def __init__(self, x: np.ndarray, box: np.ndarray | None = None, trees: int = TREES, seed: int = SEED):
        box = x if box is None else box
        self.draw(box.min(axis=0), box.max(axis=0), len(x), trees, seed)
        self.settle(self.visits(x))

    @classmethod
    def drawn(cls, low: np.ndarray, high: np.ndarray, rows: int, trees: int = TREES, seed: int = SEED) -> IsolationForest:
        """A forest for so many rows, with splits and no path lengths yet."""
        forest = cls.__new__(cls)
        forest.draw(low, high, rows, trees, seed)
        return forest

    @staticmethod
    def average(n: np.ndarray | int) -> np.ndarray:
        """Mean path length of an unsuccessful search among n rows."""
        n = np.maximum(np.asarray(n, np.float64), 1)
        return np.where(n <= 2, n - 1, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / n)

    def draw(self, low: np.ndarray, high: np.ndarray, rows: int, trees: int, seed: int) -> None:
        rng, live = np.random.default_rng(seed), np.flatnonzero(high > low)
        self.depth = min(DEPTH, max(1, int(np.ceil(np.log2(max(2, rows))))))
        nodes = 2**self.depth - 1
        self.feature, self.split = np.zeros((trees, nodes), np.int8), np.full((trees, nodes), np.inf, np.float32)
        self.norm = float(self.average(rows))
        for t in range(trees if len(live) else 0):
            lows, highs = np.array([low], np.float64), np.array([high], np.float64)
            for level in range(self.depth):
                at, first = np.arange(2**level), 2**level - 1
                f = live[rng.integers(len(live), size=2**level)]
                split = (lows[at, f] + rng.random(2**level) * (highs[at, f] - lows[at, f])).astype(np.float32)
                self.feature[t, first : 2 * first + 1], self.split[t, first : 2 * first + 1] = f, split
                lows, highs = np.repeat(lows, 2, axis=0), np.repeat(highs, 2, axis=0)
                highs[2 * at, f] = lows[2 * at + 1, f] = split

    def bottom(self, x: np.ndarray):
        """For each tree the place that each row reaches at its bottom."""
        rows = np.arange(len(x))
        for feature, split in zip(self.feature, self.split, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= split[node])
            yield node - len(split)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """How many rows reach each place at the bottom, by tree."""
        return np.stack([np.bincount(place, minlength=2**self.depth) for place in self.bottom(x)])

    def settle(self, visits: np.ndarray) -> None:
        """Path lengths from the visits of all rows: a path ends where fewer than two rows are left."""
        length, n = self.depth + self.average(visits), visits
        for level in range(self.depth - 1, -1, -1):
            n = n[:, ::2] + n[:, 1::2]
            length[np.repeat(n < 2, 2 ** (self.depth - level), axis=1)] = level
        self.path = np.rint(length * UNIT).astype(np.int64)

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """Path lengths, summed over the trees, in parts of 1 / UNIT."""
        return sum((path[place] for path, place in zip(self.path, self.bottom(x), strict=True)), np.zeros(len(x), np.int64))

    def score_of(self, lengths: np.ndarray) -> np.ndarray:
        return 2 ** (-lengths / (UNIT * len(self.path)) / max(self.norm, 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the higher, the more anomalous."""
        return self.score_of(self.lengths(x))


class QualityModel:
    """A forest and its threshold; without a forest the fixed rules alone decide."""

    def __init__(self, forest: IsolationForest | None, threshold: float, prior: list[float] | None = None):
        self.forest, self.threshold, self.prior = forest, threshold, prior

    def kept(self, s: dict[str, np.ndarray]) -> np.ndarray:
        ok = ~base_failed(s)
        if self.forest is not None and ok.any():
            at = np.flatnonzero(ok)
            ok[at] = self.forest.score(features({k: v[at] for k, v in s.items()}, self.prior)) <= self.threshold
        return ok


def _rows(batch: pa.RecordBatch, texts: str = "text"):
    for first, piece in text_slices(batch.column(texts)):
        yield batch.slice(first, len(piece)), statistics(piece)


def cut(score: np.ndarray, good: np.ndarray, good_lost: float = GOOD_LOST, times: np.ndarray | None = None) -> float:
    """The threshold on held-out scores: most bad rows rejected and at most good_lost of the good ones.

    With times, each score stands for so many rows.
    """
    times = np.ones(len(score)) if times is None else times
    levels, at = np.unique(score, return_inverse=True)

    def above(rows: np.ndarray) -> np.ndarray:
        n = np.bincount(at[rows], times[rows], len(levels))
        return (n.sum() - np.cumsum(n)) / max(1, n.sum())

    lost, caught = above(good), above(~good)
    gain = np.where(lost <= good_lost, caught - 2 * lost, -1.0)
    k = len(gain) - 1 - int(np.argmax(gain[::-1]))  # of equal cuts the highest
    return float(levels[k] + levels[k + 1]) / 2 if k + 1 < len(levels) else float(levels[k])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""

    def run(batches):
        for batch in batches:
            for part, s in _rows(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(s[c].astype(np.int64)) for c in COUNTS + MORE)], names=["doc_id", *COUNTS, *MORE])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, STATS_SCHEMA)


def _counted(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS + MORE}


def fit(docs: DataFrame, labels: DataFrame, bound: int | None = None, good_lost: float = GOOD_LOST) -> QualityModel:
    """Fit on all labelled rows. docs: doc_id, text; labels: doc_id, quality (1: good).

    A bound leaves out all labels but so many, so that the model can be tried on rows that it has not seen.
    """
    return fit_measured(measure(docs), labels, bound, good_lost)


def fit_measured(stats: DataFrame, labels: DataFrame, bound: int | None = None, good_lost: float = GOOD_LOST) -> QualityModel:
    """fit() on what measure() returns."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    known = (known if bound is None else about(known, bound, "doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if bound is not None:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    held = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 1
    known = known.select("doc_id", (F.col("quality") == 1).alias("good"), held.alias("held"))
    rows = materialize(stats.where(PASSED).join(known, "doc_id").select("good", "held", *COUNTS, *MORE), "quality-labelled")
    try:
        return _fit_rows(rows, good_lost)
    finally:
        release(rows)


def _fit_rows(rows: DataFrame, good_lost: float) -> QualityModel:
    """rows: good, held, statistics."""
    grown = F.col("good") & ~F.col("held")
    number = lambda which: F.count(F.when(which, 1))
    total = rows.agg(
        F.count("*").alias("all"), number(grown).alias("grown"), number(F.col("good") & F.col("held")).alias("calibrating"), *(F.coalesce(F.sum(F.when(grown, F.col(c))), F.lit(0)).alias(c) for c in COUNTS + MORE)
    ).first()
    if total["all"] < 64 or total["calibrating"] < 8 or total["grown"] < 8:
        return QualityModel(None, 1.0)
    prior = usual({c: np.int64(total[c]) for c in COUNTS + MORE})
    names = [f"f{j}" for j in range(len(RATIOS))]

    def ratios(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(f)) for f in features(_counted(batch), prior).T], names=names)

    box = rows.where("NOT held").mapInArrow(ratios, ", ".join(f"{f} double" for f in names)).agg(*(g(f).alias(f"{g.__name__}_{f}") for g in (F.min, F.max) for f in names)).first()
    forest = IsolationForest.drawn(np.array(box[: len(names)]), np.array(box[len(names) :]), total["grown"])
    shape = (len(forest.split), 2**forest.depth)

    def visits(batches):
        found = np.zeros(shape, np.int64)
        for batch in batches:
            found += forest.visits(features(_counted(batch), prior))
        place = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(found.ravel()[place])], names=["place", "n"])

    found = rows.where(grown).mapInArrow(visits, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    full = np.zeros(shape, np.int64)
    full.ravel()[found["place"].to_numpy()] = found["n"].to_numpy()
    forest.settle(full)

    def lengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(forest.lengths(features(_counted(batch), prior)))], names=["good", "length"])

    found = rows.where("held").mapInArrow(lengths, "good boolean, length bigint").groupBy("good", "length").agg(F.count("*").alias("n")).toArrow()
    good = found["good"].to_numpy().astype(bool)
    return QualityModel(forest, cut(forest.score_of(found["length"].to_numpy()), good, good_lost, found["n"].to_numpy()), prior)


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row."""
    return judge_measured(measure(docs), model)


def judge_measured(stats: DataFrame, model: QualityModel) -> DataFrame:
    """judge() on what measure() returns."""

    def run(batches):
        for batch in batches:
            s = _counted(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base_failed(s)), pa.array(model.kept(s))], names=["doc_id", *COUNTS, *MORE, "base_failed", "kept"])

    return stats.mapInArrow(run, STATS_SCHEMA + ", base_failed boolean, kept boolean")


def filter_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows that are kept, with all their columns."""

    def run(batches):
        for batch in batches:
            for part, s in _rows(batch):
                yield part.filter(pa.array(model.kept(s)))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule statistics and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = materialize(measure(docs), "quality-statistics")
    model = fit_measured(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_measured(stats, model).select("doc_id", *COUNTS, "base_failed", "kept")
