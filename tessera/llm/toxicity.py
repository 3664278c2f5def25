"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models. Each model sees the text's features and the probabilities of the
categories before it; in training those are out-of-fold predictions, so that a later model meets earlier probabilities as uncertain
as they will be on new texts. All that is learned for such a prediction, the choice of features included, comes from the other
folds. The label ``toxic`` comes last; before it come two grades that are derived from it and from the text
in the training sample: ``repeated`` (a toxic text with several different telling features) and ``severe`` (one whose telling
features are dense). Which features tell is learned for each fold from the others, so no text's grades come from its own label alone.

Features are the words of the whole text and their first letters, hashed. The model is fitted on a bounded, documented sample of
labelled rows and scores every row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, sliced, staged

SAMPLE = 3_000  # labelled rows of each class that training draws at most
SPACE = 1 << 20  # hashed features
CHOSEN = 4_096  # features a model uses at most
SAMPLE_BYTES = 64 << 20  # bytes of features of a class that training takes, rounded up to a whole text
FOLDS = 5
TELLING = 3.0  # least root of a feature's likelihood ratio; of 2.5, 3, 3.5 and 4 the best on held-out thirds of labelled rows
PREFIXES = (4, 5, 6)
CATEGORIES = ("repeated", "severe", "toxic")
REPEATED, SEVERE = 3, 0.02  # telling features; telling words per word
WORD = regex.compile(r"\w+")


def features_of(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its first letters."""
    parts = [word, *(f"{word[:n]}\0{n}" for n in PREFIXES if len(word) > n)]
    return tuple(xxhash.xxh3_64_intdigest(p) % SPACE for p in parts)


def text_features(text: str | None) -> np.ndarray:
    """Sorted distinct features of a whole text."""
    found: set[int] = set()
    for word in set(WORD.findall((text or "").lower())):
        found.update(features_of(word))
    return np.array(sorted(found), np.int32)


@dataclass
class Linear:
    """Logistic regression over a sparse 0/1 part and a few dense inputs."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: np.ndarray, cols: np.ndarray, n: int, width: int, dense: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 120) -> Linear:
        """Nesterov's accelerated gradient, a fixed number of steps of a length set by the mean number of features of a row."""
        if y.min(initial=1) == y.max(initial=0):  # one class only: its probability, whatever the text
            p = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
            return cls(np.zeros(width), np.zeros(dense.shape[1]), float(np.log(p / (1 - p))))
        size = np.bincount(rows, minlength=n) + (dense**2).sum(axis=1) + 1
        rate = 1 / (0.25 * size.mean() * 4 + l2)
        share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # classes count alike
        w = np.zeros(width + dense.shape[1] + 1)
        ahead, k = w.copy(), 1.0
        for _ in range(steps):
            z = np.bincount(rows, ahead[cols], n) + dense @ ahead[width:-1] + ahead[-1]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
            grad = np.concatenate((np.bincount(cols, g[rows], width), dense.T @ g, [g.sum()]))
            grad[:-1] += l2 * 0.01 * ahead[:-1]
            new, k2 = ahead - rate * 20 * grad, (1 + (1 + 4 * k * k) ** 0.5) / 2
            ahead, w, k = new + (k - 1) / k2 * (new - w), new, k2
        return cls(w[:width], w[width:-1], float(w[-1]))

    def probability(self, evidence: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence + dense @ self.dense + self.bias, -30, 30)))


def _selected(counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features that a model uses, mask of telling features) from how many texts (not toxic, toxic) have each feature, of how many."""
    no, yes = counts
    n0, n1 = max(1, int(rows[0])), max(1, int(rows[1]))
    p, q, rate = yes / n1, no / n0, (yes + no) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        likelihood = np.nan_to_num(yes * np.log(p / rate)) + np.nan_to_num(no * np.log(q / rate))
    score = np.sqrt(np.maximum(2 * likelihood, 0)) * (p > q)  # signed root of the likelihood ratio
    strong = (score > TELLING) & (yes >= 4)  # what tells toxic texts from others
    candidates = np.flatnonzero(strong)
    return np.sort(candidates[np.argsort(-score[candidates], kind="stable")[:CHOSEN]]), strong & (q * 20 < p)


@dataclass
class Chain:
    """The fitted chain: chosen features and a model per category."""

    chosen: np.ndarray
    models: list[Linear]
    _cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"chosen": self.chosen, "models": self.models, "_cache": {}}

    @classmethod
    def fit(cls, features: list[np.ndarray], words: np.ndarray, toxic: np.ndarray) -> Chain:
        lengths = np.array([len(f) for f in features], np.int64)
        return cls.fit_flat(np.concatenate(features) if features else np.empty(0, np.int32), lengths, words, toxic)

    @classmethod
    def fit_flat(cls, flat: np.ndarray, lengths: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> Chain:
        """Fits on texts whose features follow each other in ``flat``; what is made of all features is made some at a time."""
        n = len(lengths)
        if not n:
            return cls(np.empty(0, np.int32), [Linear(np.zeros(0), np.zeros(k), -9.0) for k in range(len(CATEGORIES))])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        fold = np.arange(n) % FOLDS
        counts = np.zeros((FOLDS, 2, SPACE), np.int32)
        for f, s, e, y in zip(fold.tolist(), starts.tolist(), ends.tolist(), toxic.tolist()):
            counts[f, y, flat[s:e]] += 1  # a text's features are distinct
        size = np.array([[np.count_nonzero(toxic[fold == f] == y) for y in (0, 1)] for f in range(FOLDS)])
        everything, rows_of = counts.sum(axis=0), size.sum(axis=0)

        def inputs(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(row, place among the chosen) of each chosen feature of each text."""
            place = np.full(SPACE, -1, np.int32)
            place[chosen] = np.arange(len(chosen))
            found = [(x := place[flat[s:e]])[x >= 0] for s, e in zip(starts.tolist(), ends.tolist())]
            return np.repeat(np.arange(n), [len(x) for x in found]), np.concatenate(found).astype(np.int64)

        hits, without = np.zeros(n, np.int64), []
        for f in range(FOLDS):
            chosen, telling = _selected(everything - counts[f], rows_of - size[f])
            for i in np.flatnonzero(fold == f).tolist():
                hits[i] = telling[flat[starts[i] : ends[i]]].sum()
            without.append((len(chosen), *inputs(chosen)))
        chosen = _selected(everything, rows_of)[0]
        del counts, everything
        rows, cols = inputs(chosen)
        labels = {"repeated": toxic * (hits >= REPEATED), "severe": toxic * (hits >= SEVERE * np.maximum(words, 1)), "toxic": toxic}
        before, models = np.zeros((n, 0)), []
        for name in CATEGORIES:
            y = labels[name].astype(float)
            models.append(Linear.fit(rows, cols, n, len(chosen), before, y))
            out = np.zeros(n)
            for f, (width, r, c) in enumerate(without):
                test = fold == f
                if test.any() and not test.all():
                    part = ~test[r]
                    place = np.cumsum(~test) - 1
                    m = Linear.fit(place[r[part]], c[part], int((~test).sum()), width, before[~test], y[~test])
                    evidence = np.bincount(r, m.weights[c], n)
                    out[test] = m.probability(evidence[test], before[test])
            before = np.column_stack((before, out))
        return cls(chosen.astype(np.int32), models)

    def _weights(self, word: str) -> tuple[int, ...]:
        if len(self._cache) > 400_000:
            self._cache.clear()
        at = {f: i for i, f in enumerate(self.chosen.tolist())} if "" not in self._cache else self._cache[""]
        self._cache[""] = at
        got = tuple(at[f] for f in features_of(word) if f in at)
        self._cache[word] = got
        return got

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities (text, category)."""
        rows, cols, cache = [], [], self._cache
        for i, text in enumerate(texts):
            found: set[int] = set()
            for word in set(WORD.findall((text or "").lower())):
                got = cache.get(word)
                found.update(self._weights(word) if got is None else got)
            cols += found
            rows += [i] * len(found)
        rows, cols, n = np.array(rows, np.int64), np.array(cols, np.int64), len(texts)
        before = np.zeros((n, 0))
        for m in self.models:
            evidence = np.bincount(rows, m.weights[cols], n) if len(rows) else np.zeros(n)
            before = np.column_stack((before, m.probability(evidence, before)))
        return before


def _sample_rows(batches):
    for batch in sliced(batches):
        texts = batch.column(2).to_pylist()
        made = [pa.array([len(WORD.findall(t or "")) for t in texts], pa.int64()), pa.array([text_features(t).tobytes() for t in texts], pa.binary())]
        yield pa.record_batch([batch.column(0), batch.column(1), *made], ["place", "toxic", "words", "features"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Chain:
    """Fits the chain on up to ``sample`` labelled rows of each class, the first in order of a hash of the id.

    Labels that are null or of documents that are not there do not count; of several labels of one id the largest does, and of
    several texts of one id the smallest. Of each class texts are taken in that order until SAMPLE_BYTES of features are full.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    known = known.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    first = [known.where(F.col("_toxic") == v).orderBy(F.xxhash64("_id"), "_id").limit(sample) for v in (0, 1)]
    ids = F.broadcast(first[0].unionByName(first[1]))  # 2 * sample rows at most
    drawn = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(ids, "_id")
    drawn = drawn.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).select(F.xxhash64("_id").alias("place"), "_toxic", "_text")
    drawn = staged(drawn.mapInArrow(_sample_rows, "place long, toxic int, words long, features binary"), "drawn")
    order = Window.partitionBy("toxic").orderBy("place", "words").rowsBetween(Window.unboundedPreceding, -1)
    sizes = drawn.select("place", "toxic", "words", F.octet_length("features").alias("size"))  # 2 * sample rows at most
    some = sizes.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).where(F.col("before") < SAMPLE_BYTES)
    got = drawn.join(F.broadcast(some.select("place").distinct()), "place", "left_semi").toArrow().combine_chunks()
    data = got["features"].combine_chunks()
    keys = np.array([xxhash.xxh3_64_intdigest(x.as_buffer()) for x in data], np.uint64)
    order = np.argsort(keys, kind="stable")  # so that folds do not depend on the order of partitions
    parts = [np.frombuffer(data[int(i)].as_buffer(), np.int32) for i in order]
    chain = Chain.fit(parts, got["words"].to_numpy()[order], got["toxic"].to_numpy()[order].astype(np.int64))
    del got, data, parts
    pa.default_memory_pool().release_unused()
    return chain


def _scored(chain, schema_names):
    def run(batches):
        for batch in sliced(batches, 512):
            p = chain.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.record_batch([*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(c) for c in p.T)], schema_names)

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, p_repeated, p_severe, p_toxic, toxic), toxic where p_toxic is 0.5 or more.

    Every row is scored by its whole text; null and empty texts have no features and get what the model says of none. Ids may be
    null or repeat. Without labels of both classes no text is toxic. An empty table gives no rows.
    """
    chain = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col))
    names = ["_id", *(f"p_{c}" for c in CATEGORIES)]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, " + ", ".join(f"p_{c} double" for c in CATEGORIES)
    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(_scored(chain, names), schema)
    return got.withColumn("toxic", F.col("p_toxic") >= 0.5).withColumnRenamed("_id", id_col)


def _clean(chain):
    def run(batches):
        for batch in sliced(batches, 512):
            p = chain.value.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(p[:, -1] < 0.5))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose text the chain does not find toxic, with all their columns."""
    chain = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    return docs.mapInArrow(_clean(chain), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
