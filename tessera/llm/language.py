"""Language identification by cross-parsing entropy.

For each language a suffix automaton of some labelled text knows all its substrings. A document is parsed greedily into longest
matches: follow the automaton while it goes on, and where it does not, a phrase ends and the next begins at the symbol that broke
it. Fewer phrases mean a text closer to the language; phrases * log2(learned symbols) / symbols is the cross entropy in bits, and
the language with the least wins.

All blocks of BLOCK symbols of many texts walk one transition table in step, as whole-array operations. At first each block starts
afresh; then those whose block before ended in another state walk again from there, until none does: parses soon fall into step,
so few walks are needed, and the result is that of one walk over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, sliced, staged

BLOCK = 512
LETTER = regex.compile(r"\p{L}")
SPACE, PAD = 0, 1  # symbols; learned bytes follow, and one symbol stands for all others
UNKNOWN = "und"
SAMPLE = 60_000  # bytes of text learned per language
TOTAL = 600_000  # bytes of text learned of all languages, which share them alike: what a worker holds is some hundred bytes for each
LANGUAGES = 600  # languages learned: those with most rows
PART = 3_000  # characters of the parts in which whole texts enter the draw


def normal_bytes(text: str) -> np.ndarray:
    """Lower-case UTF-8 bytes in which each run of ASCII characters that are no letters is one space."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    out = np.where(letter, raw, np.uint8(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return out[keep]


def automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, state 0 first."""
    to, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        state = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = state
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return to


@dataclass
class Automaton:
    """A language's automaton as edges, small enough to send, and the symbols it was learned from."""

    states: int
    source: np.ndarray
    symbol: np.ndarray
    target: np.ndarray
    learned: int

    @classmethod
    def of(cls, symbols: bytes) -> Automaton:
        to = automaton(symbols)
        edges = np.array([(s, c, t) for s, d in enumerate(to) for c, t in d.items()], np.int32).reshape(-1, 3)
        return cls(len(to), edges[:, 0], edges[:, 1], edges[:, 2], len(symbols))

    def table(self, width: int) -> np.ndarray:
        """Flat table: for state * width + symbol the next state * width, and in the top two bits how many phrases end."""
        start = np.full(width, 1 << 30, np.uint32)  # from the start: an unknown symbol is a phrase by itself
        at = self.source == 0
        start[self.symbol[at]] = self.target[at].astype(np.uint32) * np.uint32(width)
        table = np.tile(start + np.uint32(1 << 30), self.states)  # elsewhere what breaks off also ends the phrase before it
        table[:width] = start
        table[self.source.astype(np.int64) * width + self.symbol] = self.target.astype(np.uint32) * np.uint32(width)
        table[np.arange(self.states, dtype=np.int64) * width + PAD] = np.arange(self.states, dtype=np.uint32) * np.uint32(width)
        return table


@dataclass
class Model:
    """Languages in order, their automata, and the symbol of each byte."""

    langs: list[str]
    automata: list[Automaton]
    symbol: np.ndarray
    width: int

    @classmethod
    def of(cls, samples: dict[str, str]) -> Model:
        raw = {k: normal_bytes(v) for k, v in sorted(samples.items())}
        seen = np.zeros(256, bool)
        for v in raw.values():
            seen[v] = True
        seen[32] = False
        symbol = np.full(256, 2 + seen.sum(), np.uint8)
        symbol[seen] = np.arange(2, 2 + seen.sum())
        symbol[32] = SPACE
        return cls(list(raw), [Automaton.of(symbol[v].tobytes()) for v in raw.values()], symbol, int(symbol.max()) + 1)

    def tables(self) -> list[np.ndarray]:
        if not hasattr(self, "_tables"):
            self._tables = [a.table(self.width) for a in self.automata]
        return self._tables

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text by each language."""
        blocks = np.array([-(-len(t) // BLOCK) for t in texts])
        grid = np.full((int(blocks.sum()), BLOCK), PAD, np.uint8)
        flat, at = grid.reshape(-1), 0
        for t, b in zip(texts, blocks):
            flat[at : at + len(t)] = self.symbol[t]
            at += int(b) * BLOCK
        columns = np.ascontiguousarray(grid.T)
        of = np.repeat(np.arange(len(texts)), blocks)
        later = np.flatnonzero(of[1:] == of[:-1]) + 1  # blocks that follow one of the same text
        last = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else later
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        low, bits = np.uint32((1 << 30) - 1), np.uint32(30)

        def walk(table, columns, state):
            count = np.zeros(len(state), np.uint32)
            for column in columns:
                step = table[state + column]
                count += step >> bits
                state = step & low
            return state, count

        for k, table in enumerate(self.tables()):
            start = np.zeros(len(grid), np.uint32)
            end, count = walk(table, columns, start)
            while len(again := later[start[later] != end[later - 1]]):
                start[again] = end[again - 1]
                end[again], count[again] = walk(table, np.ascontiguousarray(columns[:, again]), start[again])
            count[last] += end[last] != 0
            out[:, k] = np.bincount(of, count, len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of each text. The score is how far the best entropy lies under the next, as a part of the next."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        asked = [i for i, t in enumerate(texts) if t is not None and self.langs and LETTER.search(t)]
        parts: list[list[int]] = [[]]
        size = 0
        for i in asked:  # some megabytes at a time
            if size > 4 << 20:
                parts.append([])
                size = 0
            parts[-1].append(i)
            size += len(texts[i])
        bits = np.log2([max(2, a.learned) for a in self.automata]) if self.langs else np.empty(0)
        for part in parts:
            if not part:
                continue
            symbols = [normal_bytes(texts[i]) for i in part]
            entropy = self.phrases(symbols) * bits / np.array([len(s) for s in symbols])[:, None]
            best = entropy.argmin(axis=1)  # ties: the first language by name
            least = entropy[np.arange(len(part)), best]
            entropy[np.arange(len(part)), best] = np.inf
            second = entropy.min(axis=1)
            for i, b, x, y in zip(part, best, least, second):
                langs[i] = self.langs[b]
                scores[i] = 1.0 if np.isinf(y) else float(1 - x / y) if y else 0.0
        return langs, scores


def held_out(id_col: str, folds: int = 5) -> F.Column:
    """Whether crc32(id as text) mod folds is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from a bounded sample: per language the first ``sample`` bytes of the distinct parts of whole texts in order of a hash.

    The LANGUAGES languages with most rows are learned (ties by name); where more than TOTAL / ``sample`` are, each has an equal share of TOTAL.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    langs = staged(langs.select("lang"), "languages")
    sample = min(sample, TOTAL // max(1, langs.count()))
    part = F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)))
    known = rows.join(F.broadcast(langs), "lang").select("lang", part.alias("text"))  # LANGUAGES rows at most
    # a part's level: the binary digits of its place in the order; each level holds about as many distinct parts as all below it
    known = known.withColumn("h", F.xxhash64("text")).withColumn("level", F.length(F.bin(F.shiftrightunsigned("h", 1))))
    once = known.select("lang", "h", "level", F.octet_length("text").alias("bytes")).groupBy("lang", "h", "level").agg(F.min("bytes").alias("bytes"))
    level = once.groupBy("lang", "level").agg(F.sum("bytes").alias("bytes"))
    upto = F.sum("bytes").over(Window.partitionBy("lang").orderBy("level"))
    count = level.withColumn("upto", upto).groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= sample, F.col("level"))), F.lit(64)).alias("most"))
    count = F.broadcast(staged(count, "levels"))  # one row per language
    # parts that can be drawn: the levels that fill the sample, or all where all do not
    drawn = known.join(count, "lang").where(F.col("level") <= F.col("most"))
    drawn = drawn.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("place", F.shiftrightunsigned("h", 1))
    order = Window.partitionBy("lang").orderBy("place", "h").rowsBetween(Window.unboundedPreceding, -1)
    some = drawn.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(order), F.lit(0))).where(F.col("before") < sample)
    samples: dict[str, list[str]] = {}
    for r in some.orderBy("lang", "place", "h").select("lang", "text").collect():
        samples.setdefault(r.lang, []).append(r.text)
    return Model.of({k: " ".join(v) for k, v in samples.items()})


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def _predict(model):
    def run(batches):
        for batch in sliced(batches, 1000):
            langs, scores = model.value.predict(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: (id, held_out, lang_pred, score), learned from the rows that are not held out.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text where no row has a language to learn.
    Whole texts are parsed, of any length. Ids may be null or repeat. An empty table gives no rows.
    """
    out = held_out(id_col)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.where(~out), text_col, lang_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_predict(model), PREDICTED).withColumnRenamed("doc_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
