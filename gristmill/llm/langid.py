"""Language identification by interpolated Kneser-Ney character models, one a language, in sorted hash arrays.

Training takes a bounded sample of the labelled rows of every label: about SAMPLE_DOCS of each, fewer beyond 200 labels, chosen by a hash of the id. Their n-gram counts are summed by Spark; the
driver turns them into tables whose size the sample bounds. For every order the table is one sorted array of 64-bit n-gram hashes and,
beside it, a row of natural logarithms: for each language the interpolated probability of the last character after the others.
An n-gram that any language has seen has an entry for all, so one search at the highest order serves all languages; a miss
goes on one order lower and adds the context's interpolation weights, which are stored likewise.

A text's language is the one with the lowest cross-entropy per character. It is rejected if that lies above the limit calibrated on
the part of the sample that the counts leave out: mean + slack * (1 + 30 / sqrt(characters)). The slack is twice what all but a few of the calibration texts stay within (QUANTILE), or
LEAST_SLACK if that is more; a language without calibration texts takes the mean and slack of all. A rejected text still gets its nearest language as lang_pred, and `rejected` beside it.
The score is the language's share of the texts' probabilities, each to a power that makes shares fit how often they are right on the calibration texts.

Probabilities are kept for each n-gram and language, so the model's memory, on the driver and in each executor's Python, grows with the product of both: 0.8 MB for 50,000 n-grams in 4 languages,
but 4 GB for 5 million in 200. SAMPLE_DOCS is the parameter to lower where there are many labels.

Nulls and odd input: a null text, or one without letters, is `und` with score 0. Rows without label or text, and the held-out fold, are
not learned from; a null doc_id counts as the text 'null' in folds. Without any row to learn from, all texts are `und`. Texts are scored whole.
Repeated rows each give their row. Only doc_id, text and lang are read, lang in training alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, once, row_map, small

ORDER = 4
#: Documents a language, at most about, that training reads, outside the held-out fold.
SAMPLE_DOCS = 1500
#: Of ten sampled documents, one calibrates the limit and isn't counted.
CALIBRATE = 10
#: Documents that training reads in all, about: with more than 200 labels each has a smaller sample, of LEAST_DOCS or all of its rows at least. No label is left out.
SAMPLE_ROWS, LEAST_DOCS = 200 * SAMPLE_DOCS, 20
DISCOUNT = 0.75
#: The share of calibration texts whose overshoot the slack is twice of, and the least slack, in nats a character.
QUANTILE, LEAST_SLACK = 0.995, 0.4
#: Symbols that are scored at once.
PIECE = 1 << 16
START = 2  # a control character before the text; 1 stands for any run of characters that are no letters
KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def letters() -> np.ndarray:
    """For each code point: its lower-case form if it's a letter, else 1."""
    table = np.ones(0x110000, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            table[k] = ord(low) if len(low) == 1 else k
    return table


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters, with one 1 for each run of anything else."""
    s = once("letters", letters)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    other = s == 1
    if len(s) > 1:
        s = s[~(other & np.concatenate(([False], other[:-1])))]
    return s


def padded(s: np.ndarray) -> np.ndarray:
    return np.concatenate((np.full(ORDER - 1, START, np.uint32), s))


def hashes(s: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n-gram of s, by its first place."""
    m = len(s) - n + 1
    h = np.zeros(max(m, 0), np.uint64)
    for k in range(n):
        x = (s[k : k + m].astype(np.uint64) + np.uint64(1)) * KEYS[k]
        h += x ^ (x >> np.uint64(29))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


@dataclass
class Table:
    """Values by sorted hash; first[b] is where the hashes with top bits b begin."""

    keys: np.ndarray
    values: np.ndarray
    first: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        bits = max(1, int(len(keys)).bit_length() + 1)
        first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int64)
        return cls(keys, values, np.append(first, len(keys)), 64 - bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        top = (h >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(h), -1, np.int64)
        todo = np.flatnonzero(at < end)
        while len(todo):
            at_todo = at[todo]
            hit = self.keys[at_todo] == h[todo]
            out[todo[hit]] = at_todo[hit]
            at[todo] += 1
            todo = todo[~hit & (at_todo + 1 < end[todo])]
        return out


@dataclass
class Model:
    """tables[n - 1]: log probabilities by n-gram; weights[n - 1]: log interpolation weights by context of n characters. limits: mean, slack by language."""

    languages: list[str]
    tables: list[Table]
    weights: list[Table]
    floor: np.ndarray
    mean: np.ndarray
    slack: np.ndarray
    power: float = 1.0

    def state(self) -> tuple:
        """All of it as arrays and lists, to be sent without its class."""
        pairs = lambda tables: [(t.keys, t.values, t.first, t.shift) for t in tables]
        return self.languages, pairs(self.tables), pairs(self.weights), self.floor, self.mean, self.slack, self.power

    @classmethod
    def of(cls, state: tuple) -> Model:
        languages, tables, weights, *rest = state
        return cls(languages, [Table(*t) for t in tables], [Table(*t) for t in weights], *rest)

    def log_probabilities(self, text: str) -> tuple[np.ndarray, int]:
        """The sum of each language's log probabilities over the text's symbols, and their number."""
        s = symbols(text)
        total = np.zeros(len(self.languages))
        for at in range(0, len(s), PIECE):
            total += self._piece(padded(s[at : at + PIECE]) if not at else s[at - ORDER + 1 : at + PIECE])
        return total, len(s)

    def _piece(self, s: np.ndarray) -> np.ndarray:
        n_sym = len(s) - ORDER + 1
        total = np.zeros(len(self.languages))
        todo = np.arange(n_sym)  # the place in s where the longest n-gram of each symbol begins
        for n in range(ORDER, 0, -1):
            h = hashes(s[ORDER - n :], n)
            place = self.tables[n - 1].find(h[todo] if n < ORDER else h)
            hit = place >= 0
            total += self.tables[n - 1].values[place[hit]].sum(0, dtype=np.float64)
            todo = todo[~hit]
            if not len(todo):
                return total
            if n > 1:
                context = self.weights[n - 2].find(hashes(s[ORDER - n : len(s) - 1], n - 1)[todo])
                total += self.weights[n - 2].values[context[context >= 0]].sum(0, dtype=np.float64)
        return total + len(todo) * self.floor

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language or und, score, cross-entropy, rejected)."""
        total, n = self.log_probabilities(text) if text and self.languages else (np.zeros(0), 0)
        if not len(total) or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        entropy = -total / n
        best = int(np.argmin(entropy))
        score = 1.0 / float(np.exp(self.power * (total - total[best])).sum())
        return self.languages[best], score, float(entropy[best]), bool(entropy[best] > self.mean[best] + self.slack[best] * (1 + 30 / math.sqrt(n)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(5))


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, text, lang, n (rows of its label) of about per_language labelled rows of each language outside the held-out fold, chosen by a hash of the id."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    counts = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), ids=True)
    labels = counts.count()
    per_label = min(per_language, max(LEAST_DOCS, SAMPLE_ROWS // max(1, labels)))
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lang-sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(small(counts, labels), "lang").where(u * F.col("n") < per_label).select("doc_id", "text", "lang", "n")


def counts_of(rows: DataFrame) -> DataFrame:
    """lang, n, hash, context, rest, last, count of the n-grams of all orders: context hashes all but the last character, rest all but the first."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(padded(symbols(text)))
            if sum(len(x) for v in held.values() for x in v) > 1 << 21:
                yield from flush(held)
        yield from flush(held)

    def flush(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            for n in range(1, ORDER + 1):
                h = np.concatenate([hashes(s[ORDER - n :], n) for s in parts])
                order = np.argsort(h, kind="stable")
                starts = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, np.int64)
                at = order[starts]
                context = np.concatenate([hashes(s[ORDER - n : len(s) - 1], n - 1) if n > 1 else np.zeros(len(s) - ORDER + 1, np.uint64) for s in parts])
                rest = np.concatenate([hashes(s[ORDER - n + 1 :], n - 1) if n > 1 else np.zeros(len(s) - ORDER + 1, np.uint64) for s in parts])
                count = np.diff(np.append(starts, len(h)))
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.string()), pa.array(np.full(k, n, np.int32)), *[pa.array(x[at].view(np.int64)) for x in (h, context, rest)], pa.array(count.astype(np.int64))],
                    names=["lang", "n", "hash", "context", "rest", "count"],
                )
        held.clear()

    found = rows.select("text", "lang").mapInArrow(grams, "lang string, n int, hash long, context long, rest long, count long")
    return found.groupBy("lang", "n", "hash").agg(F.first("context").alias("context"), F.first("rest").alias("rest"), F.sum("count").alias("count"))


def train(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    """A model from docs (doc_id, text, lang)."""
    # a label of few rows is learned from all of them
    calibrates = (F.col("n") >= CALIBRATE) & (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibrate")), F.lit(CALIBRATE)) == 0)
    taken = cut(sample(docs, per_language).withColumn("calibrates", calibrates))
    table = counts_of(taken.where("not calibrates")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    model = build(table, languages)
    if not languages:
        return model

    def totals(given: Iterator[tuple]) -> Iterable[tuple]:
        for text, lang in given:
            total, n = model.log_probabilities(text)
            if n and lang in languages:
                yield languages.index(lang), total.tolist(), n

    seen = row_map(taken.where("calibrates").select("text", "lang"), totals, "lang int, total array<double>, n long").toArrow()
    calibrate(model, seen.column("lang").to_numpy(), np.array(seen.column("total").to_pylist()).reshape(-1, len(languages)), seen.column("n").to_numpy())
    return model


def calibrate(model: Model, lang: np.ndarray, total: np.ndarray, n: np.ndarray) -> None:
    """Sets mean, slack and power from the calibration texts: their languages, log probabilities by language, and lengths. Without any texts nothing is rejected."""
    if not len(n):
        return
    entropy = -total[np.arange(len(n)), lang] / n

    def limits(some: np.ndarray) -> tuple[float, float]:
        mean = float(np.average(entropy[some], weights=n[some]))
        over = (entropy[some] - mean) / (1 + 30 / np.sqrt(n[some]))
        return mean, max(LEAST_SLACK, 2 * float(np.quantile(over, QUANTILE)))

    everything = limits(np.ones(len(n), bool))
    for k in range(len(model.languages)):
        model.mean[k], model.slack[k] = limits(lang == k) if (lang == k).any() else everything
    powers = 0.5 ** np.arange(11)
    losses = [np.log(np.exp(p * (total - total.max(1, keepdims=True))).sum(1)).sum() + p * (total.max(1) - total[np.arange(len(n)), lang]).sum() for p in powers]
    model.power = float(powers[int(np.argmin(losses))])


def build(counts: pa.Table, languages: list[str]) -> Model:
    """The interpolated Kneser-Ney tables from counts_of() rows: the highest order from counts, the others from the number of different characters before."""
    L = len(languages)
    number = {x: k for k, x in enumerate(languages)}
    lang = np.array([number[x] for x in counts.column("lang").to_pylist()], np.int64)
    n_of, h_of, c_of, r_of, count_of = (counts.column(x).to_numpy() for x in ("n", "hash", "context", "rest", "count"))
    h_of, c_of, r_of = (x.view(np.uint64) for x in (h_of, c_of, r_of))
    tables: list[Table] = []
    weights: list[Table] = []
    floor = np.full(L, math.log(1e-7))
    lower: np.ndarray | None = None
    for n in range(1, ORDER + 1):
        own = n_of == n
        keys, where = np.unique(h_of[own], return_inverse=True)
        c = np.zeros((len(keys), L))
        if n == ORDER:
            c[where, lang[own]] = count_of[own]
        else:  # continuation counts: n + 1-grams that end so
            above = n_of == n + 1
            place = np.searchsorted(keys, r_of[above])
            place = np.minimum(place, max(len(keys) - 1, 0))
            good = keys[place] == r_of[above] if len(keys) else np.zeros(0, bool)
            np.add.at(c, (place[good], lang[above][good]), 1.0)
        if n == 1:
            total = c.sum(0)
            p = (np.maximum(c - DISCOUNT, 0) + DISCOUNT * (c > 0).sum(0) / max(len(keys) + 1, 1)) / np.maximum(total, 1)
            floor = np.log(np.maximum(DISCOUNT * (c > 0).sum(0) / max(len(keys) + 1, 1) / np.maximum(total, 1), 1e-9)) if L else floor
        else:
            context = np.zeros(len(keys), np.uint64)
            rest = np.zeros(len(keys), np.uint64)
            context[where], rest[where] = c_of[own], r_of[own]
            contexts, of = np.unique(context, return_inverse=True)
            total = np.zeros((len(contexts), L))
            kinds = np.zeros((len(contexts), L))
            np.add.at(total, of, c)
            np.add.at(kinds, of, (c > 0).astype(float))
            seen = total > 0
            gamma = np.where(seen, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            place = np.minimum(np.searchsorted(tables[-1].keys, rest), max(len(tables[-1].keys) - 1, 0))
            below = lower[place] if len(keys) else np.zeros((0, L))
            p = np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1)[of] + gamma[of] * below
            weights.append(Table.of(contexts, np.log(gamma).astype(np.float32)))
        lower = np.maximum(p, 1e-12)
        tables.append(Table.of(keys, np.log(lower).astype(np.float32)))
    return Model(languages, tables, weights, floor, np.zeros(L), np.full(L, math.inf))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score, entropy, rejected for every row of docs. The model, whose size the sample bounds, goes to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    of = Model.of

    def rows(given: Iterator[tuple]) -> Iterable[tuple]:
        m = of(shared.value)
        for *kept, text in given:
            yield *kept, *m.classify(text)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return row_map(docs.select(*keep, "text"), rows, f"{schema}, lang_pred string, score double, entropy double, rejected boolean")


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model that learns from the other folds of the same rows."""
    found = identify(docs, train(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is rejected; the columns stay as they are, whatever their types."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs).state())
    of = Model.of

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = of(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([not m.classify(t.as_py())[3] for t in texts], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
