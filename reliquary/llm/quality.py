"""Quality rules: statistics of whole texts, judged by gradient-boosted trees.

The trees are grown here, on histograms, with logistic loss; chosen features may only lower the
score as they grow. A grown ensemble is flattened into arrays of nodes, and a block of documents
is scored by stepping all of them down all levels at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, fresh, materialise

SYMBOLS = b"#*$%&|<>"
#: Classes of bytes: 0 other, 1 blank, 2 lower, 3 upper, 4 digit, 5 symbol, 6 punctuation, 7 later byte of a character.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
_CLASS[[x for x in b"!\"'()+,-./:;=?@[\\]^_`{}~"]] = 6
_CLASS[list(SYMBOLS)] = 5
_CLASS[128:192] = 7

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_kinds", "n_upper", "n_digits", "n_punct", "longest")


def text_counts(data: bytes) -> tuple[int, ...]:
    """The COUNTS of one text; words are runs of anything but the six ASCII blanks."""
    words = data.split()  # of bytes: exactly those blanks
    n = len(words)
    by = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8)
    lines = [x for x in data.split(b"\n") if x.strip()]
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    repeated = 0
    if n > 3:
        a = np.array(ids, np.int64)
        pair = np.unique(a[:-1] * len(known) + a[1:], return_inverse=True)[1]
        _, where, times = np.unique(pair[:-1] * len(known) + a[2:], return_inverse=True, return_counts=True)
        twice = times[where] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= twice
        repeated = int(cover.sum())
    chars = int(len(data) - by[7] - by[1])
    return n, chars, int(by[5]), len(lines) - len(set(lines)), repeated, len(lines), len(known), int(by[3]), int(by[4]), int(by[6]), max(map(len, words), default=0)


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text; a null text has none."""
    schema = "doc_id long, th long, " + ", ".join(f"{c} long" for c in COUNTS)

    def count(batches):
        for b in batches:
            rows = np.array([text_counts(x.as_py()) for x in b["data"]], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], *map(pa.array, np.ascontiguousarray(rows.T))], ["doc_id", "th", *COUNTS])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.encode(text, "utf-8").alias("data"))
    return materialise(rows.mapInArrow(count, schema), "text-counts")


#: Features, with -1 where a higher value may only lower the score.
FEATURES = {
    "log_words": 0, "chars_per_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "words_per_line": 0,
    "kinds_share": 0, "upper_share": 0, "digit_share": 0, "punct_per_word": 0, "log_longest": 0,
}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, float) for k, v in c.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_words"] / lines,
        c["n_kinds"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_punct"] / words, np.log1p(c["longest"]),
    ])


def bin_numbers(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many of its feature's cuts lie below each value."""
    return np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]).astype(np.uint8)


def histograms(binned: np.ndarray, y: np.ndarray, ask: tuple) -> np.ndarray:
    """Sums of gradients, of second derivatives and of rows by open node of the last tree, feature and bin."""
    (feature, cut, left, right, value), roots, base, depth, wanted, width = ask
    at = np.broadcast_to(roots, (len(y), len(roots))).copy()
    rows = np.arange(len(y))[:, None]
    for _ in range(depth):
        at = np.where(binned[rows, feature[at]] <= cut[at], left[at], right[at])
    p = 1 / (1 + np.exp(-base - value[at[:, :-1]].sum(axis=1)))
    place = np.full(len(feature), -1)
    place[wanted] = np.arange(len(wanted))
    node = place[at[:, -1]]
    some, count = node >= 0, binned.shape[1]
    key = ((node[some, None] * count + np.arange(count)) * width + binned[some]).ravel()
    weights = ((y - p)[some], (p * (1 - p))[some], np.ones(int(some.sum())))
    return np.stack([np.bincount(key, np.repeat(w, count), len(wanted) * count * width).reshape(len(wanted), count, width) for w in weights])


class BoostedTrees:
    """feature, cut, left, right, value: one array each over all nodes; roots: each tree's first node."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 10, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray, monotone: np.ndarray) -> BoostedTrees:
        """On rows that are at hand."""
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = bin_numbers(x, cuts)
        return self.grow(cuts, float(y.mean()), monotone, lambda ask: histograms(binned, y, ask))

    def grow(self, cuts: list[np.ndarray], share: float, monotone: np.ndarray, sums) -> BoostedTrees:
        """Level by level from sums over all rows, wherever they lie: sums(ask) gives the `histograms` of the open nodes."""
        share = np.clip(share, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        nodes, roots = [], []  # feature, number of the cut, left, right, value
        leaf = lambda gs, hs, low, high: np.clip(gs / (hs + self.l2), low, high)
        for _ in range(self.trees):
            roots.append(len(nodes))
            nodes.append([0, 0, len(nodes), len(nodes), 0.0])
            todo = {roots[-1]: (-np.inf, np.inf)}
            for _ in range(self.depth):
                if not todo:
                    break
                arrays = [np.array(c) for c in zip(*nodes, strict=True)]
                found, after = sums((arrays, np.array(roots), self.base, self.depth, np.array(list(todo)), max(map(len, cuts)) + 1)), {}
                for (me, (low, high)), (g, h, n) in zip(todo.items(), np.moveaxis(found, 1, 0), strict=True):
                    total_g, total_h, total_n = g[0].sum(), h[0].sum(), n[0].sum()
                    if me == roots[-1]:
                        nodes[me][4] = self.rate * float(leaf(total_g, total_h, low, high))
                    best = (1e-6, None)
                    for f, c in enumerate(cuts if total_n >= 2 * self.least else ()):
                        if not len(c):
                            continue
                        gl, hl, nl = (np.cumsum(w[f])[: len(c)] for w in (g, h, n))
                        vl, vr = leaf(gl, hl, low, high), leaf(total_g - gl, total_h - hl, low, high)
                        gain = gl**2 / (hl + self.l2) + (total_g - gl) ** 2 / (total_h - hl + self.l2) - total_g**2 / (total_h + self.l2)
                        ok = (nl >= self.least) & (total_n - nl >= self.least) & (monotone[f] * (vr - vl) >= 0)
                        gain = np.where(ok, gain, -1)
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (gain[i], (f, i, gl[i], hl[i], (float(vl[i]) + float(vr[i])) / 2))
                    if best[1] is None:
                        continue
                    f, i, gl, hl, middle = best[1]
                    bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[int(monotone[f])]
                    nodes[me][:4] = f, i, len(nodes), len(nodes) + 1
                    for (gs, hs), limits in zip(((gl, hl), (total_g - gl, total_h - hl)), bounds, strict=True):
                        after[len(nodes)] = limits
                        nodes.append([0, 0, len(nodes), len(nodes), self.rate * float(leaf(gs, hs, *limits))])
                todo = after
        self.roots = np.array(roots)
        self.feature, self.left, self.right = (np.array([n[i] for n in nodes], np.int64) for i in (0, 2, 3))
        self.cut = np.array([cuts[n[0]][n[1]] if n[2] != me else np.inf for me, n in enumerate(nodes)], float)
        self.value = np.array([n[4] for n in nodes], float)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Scores (log odds): documents x trees step down together; leaves lead to themselves."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)


#: Bits of a number that its cell leaves out: cells are 1/512 of their values wide, so a feature has some thousands at most.
_CELL = 43
#: Labelled documents of a task that sums over them.
TASK_ROWS = 20_000


def _quantile_cuts(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Cuts into bins of equal numbers of rows, from counts of all rows by cell."""
    def count(batches):
        for b in batches:
            for f, v in enumerate(features({c: b[c].to_numpy() for c in COUNTS}).T):
                cells, n = np.unique(np.ascontiguousarray(v).view(np.int64) >> _CELL, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), f)), pa.array(cells), pa.array(n)], ["f", "cell", "n"])

    found = rows.select(*COUNTS).mapInArrow(count, "f long, cell long, n long").groupBy("f", "cell").agg(F.sum("n").alias("n")).orderBy("f", "cell").toPandas()
    cuts = []
    for f in range(len(FEATURES)):
        cells, n = (found.loc[found["f"] == f, c].to_numpy() for c in ("cell", "n"))
        below = np.cumsum(n)
        at = np.searchsorted(below, below[-1] * np.linspace(0, 1, bins + 1)[1:-1])
        cuts.append(((np.unique(cells[at]) + 1 << _CELL) - 1).view(float))  # the last number of a cell
    return cuts


def _at_rank(scores: DataFrame, rank: int) -> float:
    """The score of this rank from the lowest, 0 first, to 2**-36: counts of all rows by ever finer steps."""
    inside = scores
    for bits in (6, 16, 26, 36):
        step = F.floor(F.col("score") * float(1 << bits))
        for r in inside.groupBy(step.alias("step")).count().orderBy("step").collect():
            if rank < r["count"]:
                break
            rank -= r["count"]
        inside = inside.where(step == r["step"])
    return r["step"] / (1 << bits)


def train(counts: DataFrame, labels: DataFrame, keep_good: float = 0.995, seed: int = 7) -> tuple[BoostedTrees, float] | None:
    """Fit on all labelled documents: tasks sum over them, the driver gets histograms.

    A fifth of them, by hash of the id, is held out; the threshold is where `keep_good` of the good
    ones among the held-out pass. None if a class has fewer than 25 documents: then no document is
    rejected.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    one = counts.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min_by(F.struct(*COUNTS), "th").alias("c"))
    rows = materialise(one.select("doc_id", F.col("quality").cast("double").alias("quality"), (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(5)) == 0).alias("held"), "c.*"), "quality-labelled")
    sizes = {(r["held"], r["quality"]): r["count"] for r in rows.groupBy("held", "quality").count().collect()}
    total = lambda q: sizes.get((False, q), 0) + sizes.get((True, q), 0)
    if min(total(0.0), total(1.0)) < 25 or not sizes.get((True, 1.0)):
        return None
    fitted, trees = rows.where("not held"), BoostedTrees()
    n = sum(v for (held, _), v in sizes.items() if not held)
    share = sum(q * v for (held, q), v in sizes.items() if not held) / n
    cuts = _quantile_cuts(fitted, trees.bins)

    def blocks(batches):
        for b in batches:
            binned = bin_numbers(features({c: b[c].to_numpy() for c in COUNTS}), cuts)
            yield pa.RecordBatch.from_arrays([pa.array([binned.tobytes()]), pa.array([b["quality"].to_numpy().tobytes()])], ["x", "y"])

    tasks = max(4, -(-n // TASK_ROWS))
    dealt = fitted.repartition(tasks, "doc_id").sortWithinPartitions("doc_id").mapInArrow(blocks, "x binary, y binary").rdd.map(tuple).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(ask):
        def task(held):
            parts = [(np.frombuffer(x, np.uint8).reshape(-1, len(FEATURES)), np.frombuffer(y)) for x, y in held]
            return [histograms(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]), ask)] if parts else []

        return dealt.mapPartitions(task).reduce(np.add)

    model = trees.grow(cuts, share, np.array(list(FEATURES.values())), sums)
    dealt.unpersist()

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.predict(features({c: b[c].to_numpy() for c in COUNTS})))], ["score"])

    good = rows.where("held and quality = 1").mapInArrow(score, "score double")
    least = _at_rank(good, int((1 - keep_good) * sizes[True, 1.0])) - 1e-9
    discard(rows)
    return model, least


def judge_quality(docs: DataFrame, labels: DataFrame, keep_good: float = 0.995) -> DataFrame:
    """One row per document: doc_id, th, COUNTS, score, base_failed, kept.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. A null or
    empty text has no words and fails. Repeated rows and null ids are judged each by their text;
    an empty table gives an empty result, and further columns are ignored.
    """
    counts = document_counts(docs)
    fitted = train(counts, labels, keep_good)

    def judge(batches):
        for b in batches:
            c = {k: b[k].to_numpy() for k in COUNTS}
            score = fitted[0].predict(features(c)) if fitted else np.zeros(b.num_rows)
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            kept = ~failed & (score >= fitted[1] if fitted else True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array(failed), pa.array(kept)], [*b.schema.names, "score", "base_failed", "kept"])

    return counts.mapInArrow(judge, counts.withColumns({"score": F.lit(0.0), "base_failed": F.lit(True), "kept": F.lit(True)}).schema)


def keep_quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that pass, with all their columns. Null and empty texts go; rows that repeat
    an id with the same text all stay or all go, and null ids go by their text. An empty table
    stays empty, and no name of a column of docs is taken."""
    doc, text = fresh(docs, "doc"), fresh(docs, "text_hash")
    no_id = F.lit(-(2**63))
    good = judge_quality(docs, labels, **how).where("kept").select(F.coalesce("doc_id", no_id).alias(doc), F.col("th").alias(text)).distinct()
    rows = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), no_id), text: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    return rows.join(good, [doc, text], "left_semi").select(*docs.columns)
