"""Language identification by interpolated Kneser-Ney character models.

Counts of the highest order are gathered from all labelled texts in Spark; lower orders follow from them
(continuation counts), so the driver sees distinct n-grams only. Where these are more than ``MODEL_NGRAMS``, the
model is made and used in parts of about so many, by ranges of the character before the predicted one: all that
predicts after it but the unigrams is in one part, so the numbers are those of the whole model. A model is a set of sorted hash arrays: for each order the hashes of
its n-grams and, a column a language, their log-probabilities, and the same for contexts and
their back-off weights. A text gets the language of the lowest cross-entropy a character; it is rejected
when that is far above what labelled texts of the language show, or when no language stands out. Temperature and
limits come from all labelled texts: tasks score them and pass on sums.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy, utf8, written
from .words import mix

ORDER = 4
#: Distinct n-grams, over all languages, that a part of a model has (more only if one character comes before more of
#: them); each part is shipped to every worker, which holds one at a time.
MODEL_NGRAMS = 2_000_000
#: Temperatures that calibration chooses from.
TEMPERATURES = np.geomspace(0.01, 2, 40)
#: Calibration sums whole multiples of 1 / UNIT, so that the order of rows and tasks cannot show in the last digits.
UNIT = 1 << 32
#: A best cross-entropy beyond mean + SPREAD * deviation + SLACK (nats) is foreign.
SPREAD, SLACK = 8.0, 1.0
#: A best posterior below this stands out too little.
LEAST = 0.4
UNKNOWN = "und"

#: Bytes of text scored or counted in one go, and n-grams that a task holds before it passes their counts on.
SCORED_BYTES, HELD_NGRAMS, HELD_SLICES = 1 << 19, 1_500_000, 12

_EDGE = 1
_SPACE = 32
_K = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def _char_map() -> np.ndarray:
    """Code point -> its lower-case letter or its mark, or a space for what is neither."""
    if not _tables:
        out, alpha = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            s = chr(c)
            alpha[c] = s.isalpha()
            if alpha[c] or unicodedata.category(s)[0] == "M":
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables.extend([out, alpha])
    return _tables[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each after ORDER - 1 edges and with a space for a run of other characters;
    where each text's part begins (one more at the end), and whether it has a letter."""
    pad = ORDER - 1
    glue = "\x01" * pad
    codes = np.frombuffer((glue + glue.join(texts)).encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(size + pad, out=begin[1:])
    out = _char_map()[codes]
    edge = (begin[:-1, None] + np.arange(pad)).ravel()
    out[edge] = _EDGE
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _SPACE) | (out[:-1] != _SPACE)
    kept = np.append(0, np.cumsum(keep))
    first = kept[begin]
    letter = np.append(0, np.cumsum(_tables[1][codes]))  # a mark alone is no letter
    return out[keep], first, letter[begin[1:]] > letter[begin[:-1]]


def _predicted(first: np.ndarray, n: int) -> np.ndarray:
    """Which characters are predicted: all but the edges."""
    ok = np.ones(n, bool)
    ok[(first[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
    return ok


def hashes(chars: np.ndarray, at: np.ndarray, order: int, back: int = 0) -> np.ndarray:
    """Hashes of the n-grams of ``order`` characters that end ``back`` before each place ``at``."""
    h = np.full(len(at), order, np.uint64)
    for j in range(order - 1, -1, -1):
        h = h * _K + chars[at - back - j].astype(np.uint64)
    return mix(h)


def _gram_hashes(grams: np.ndarray) -> np.ndarray:
    """The same of rows of characters."""
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for j in range(grams.shape[1]):
        h = h * _K + grams[:, j].astype(np.uint64)
    return mix(h)


class Table:
    """Sorted hashes with a row of values each; a prefix index starts the search."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.start = self._index()

    def _index(self) -> np.ndarray:
        return np.append(0, np.cumsum(np.bincount((self.keys >> np.uint64(64 - self.BITS)).astype(np.int64), minlength=1 << self.BITS))).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where absent."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        top = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, end = self.start[top].astype(np.int64), self.start[top + 1]
        out = np.full(len(h), -1, np.int64)
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.keys[at] == h
            out[todo[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            todo, at, end, h = todo[more], at[more], end[more], h[more]
        return out


def discount(ones: int, twos: int) -> float:
    """What is taken from each count, by how many counts are one and two."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


class Model:
    """Kneser-Ney models of several languages over common tables."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int, unigrams: dict | None = None, cuts: dict | None = None):
        """grams: language -> (rows of ``order`` characters, counts). A part of a model has those after some characters
        only; it needs the whole model's unigrams (language -> (rows, counts)) and cuts ((language, order) -> cut)."""
        self.order, self.langs = order, sorted(grams)
        n = len(self.langs)
        levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
        for lang in self.langs:
            rows, counts = grams[lang]
            for o in range(order, 0, -1):
                levels[o].append((rows, counts.astype(np.float64)))
                if o > 1:  # continuation counts: distinct characters before
                    rows, counts = np.unique(rows[:, 1:], axis=0, return_counts=True) if o > 2 or unigrams is None else unigrams[lang]
        chars = max((len(np.unique(np.concatenate([r for r, _ in levels[1]]))), 1)) if n else 1
        self.floor = np.float32(-np.log(chars + 1))
        self.probs: list[Table | None] = [None]
        self.backs: list[Table | None] = [None]
        self.calibration = {"temperature": 1.0, "limits": [float("inf")] * n}
        for o in range(1, order + 1):
            union = np.unique(np.concatenate([r for r, _ in levels[o]]), axis=0) if n else np.zeros((0, o), np.uint32)
            keys, ctx = _gram_hashes(union), _gram_hashes(union[:, : o - 1])
            contexts, where = np.unique(ctx, return_inverse=True)
            lower = self._lower(union)
            value, back = np.empty((len(union), n)), np.zeros((len(contexts), n))
            for j, (rows, counts) in enumerate(levels[o]):
                own = np.searchsorted(keys[(by := np.argsort(keys))], _gram_hashes(rows))
                place = by[own]
                cut = cuts[self.langs[j], o] if cuts else discount((counts == 1).sum(), (counts == 2).sum())
                total = np.bincount(where[place], counts, len(contexts))
                kinds = np.bincount(where[place], minlength=len(contexts))
                with np.errstate(divide="ignore"):
                    weight = np.where(total > 0, np.log(np.maximum(cut * kinds, 1e-300)) - np.log(np.maximum(total, 1e-300)), 0.0)
                back[:, j] = weight
                mine = np.zeros(len(union))
                mine[place] = np.maximum(counts - cut, 0) / total[where[place]]
                value[:, j] = np.log(mine + np.exp(weight[where] + lower[:, j]))
            self.probs.append(Table(keys, value))
            self.backs.append(Table(contexts, back))

    def _lower(self, rows: np.ndarray) -> np.ndarray:
        """Log-probabilities of the rows' last characters after the rows' characters but the first."""
        o, n = rows.shape[1] - 1, len(self.langs)
        if o == 0:
            return np.full((len(rows), n), self.floor, np.float64)
        table = self.probs[o]
        at = table.find(_gram_hashes(rows[:, 1:]))
        return table.values[at].astype(np.float64)  # every part of a counted n-gram is counted

    def scores(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probabilities of the characters at ``at``, a column a language."""
        out = np.empty((len(at), len(self.langs)), np.float32)
        todo, plus = np.arange(len(at)), None
        for o in range(self.order, 0, -1):
            table = self.probs[o]
            found = table.find(hashes(chars, at[todo], o))
            hit = found >= 0
            got = table.values[found[hit]]
            out[todo[hit]] = got if plus is None else got + plus[hit]
            todo = todo[~hit]
            plus = np.zeros((len(todo), len(self.langs)), np.float32) if plus is None else plus[~hit]
            if not len(todo):
                return out
            back = self.backs[o].find(hashes(chars, at[todo], o - 1, 1))
            known = back >= 0
            plus[known] += self.backs[o].values[back[known]]
        out[todo] = plus + self.floor
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text in each language, and whether the text has a letter."""
        chars, first, some = letters(texts)
        at = np.flatnonzero(_predicted(first, len(chars)))
        begin = np.searchsorted(at, first)
        n = np.diff(begin)
        total, full = np.zeros((len(texts), len(self.langs))), np.flatnonzero(n)
        if len(full):  # each text is summed by itself, so that its place in a batch cannot show in the last digits
            total[full] = np.add.reduceat(self.scores(chars, at).astype(np.float64), begin[full], axis=0)
        return -total / np.maximum(n, 1)[:, None], some

    def posterior(self, entropy: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = -(entropy - entropy.min(axis=1, keepdims=True)) / (temperature or self.calibration["temperature"])
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


class Sharded(Model):
    """A model in parts, which are broadcast; a worker loads one at a time."""

    def __init__(self, parts: list, starts: np.ndarray, langs: list[str]):
        """starts: the least character before the predicted one, for each part but the first."""
        self.parts, self.starts, self.langs, self.order = parts, starts, langs, ORDER
        self.calibration = {"temperature": 1.0, "limits": [float("inf")] * len(langs)}

    def scores(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty((len(at), len(self.langs)), np.float32)
        part = np.searchsorted(self.starts, chars[at - 1], side="right")
        for j in np.unique(part):
            own = np.flatnonzero(part == j)
            out[own] = self._part(j).scores(chars, at[own])
        return out

    def _part(self, j: int) -> Model:
        sent = self.parts[j]
        model = sent.value
        if getattr(sent, "_path", None):  # can be read again, so it need not be held
            sent.__dict__.pop("_value", None)
        return model


class _Held:
    def __init__(self, value):
        self.value = value


def _sent(spark, model: Model | None):
    """The model for workers, by ``value``; parts are broadcast already."""
    return _Held(model) if isinstance(model, Sharded) else spark.sparkContext.broadcast(model)


def _scored_bytes(model: Model | None) -> int:
    """Parts are loaded for each slice, so slices are larger."""
    return SCORED_BYTES * (4 if isinstance(model, Sharded) else 1)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> (lang, a, b, n): n-grams of ORDER characters, packed two a long, with counts."""
    known: dict[str, list] = {}

    def settle(lang: str) -> None:
        h, a, b, n = (np.concatenate(x) for x in zip(*known[lang], strict=True))
        _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        known[lang] = [(h[index], a[index], b[index], np.bincount(inverse, n).astype(np.int64))]

    def out() -> Iterator[pa.RecordBatch]:
        for lang in list(known):
            settle(lang)
            _, a, b, n = known.pop(lang)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(n)], ["lang", "a", "b", "n"])

    for part in parts:
        _, at = utf8(part.column(0))
        for low, high in slices(at, SCORED_BYTES):
            texts = np.array(part.column(0).slice(low, high - low).to_pylist(), object)
            langs = part.column(1).slice(low, high - low)
            for lang in pc.unique(langs).to_pylist():
                own = [t for t in texts[np.asarray(pc.equal(langs, lang))] if t]
                if not own:
                    continue
                chars, first, _ = letters(own)
                place = np.flatnonzero(_predicted(first, len(chars)))
                h = hashes(chars, place, ORDER)
                _, index, count = np.unique(h, return_index=True, return_counts=True)
                place = place[index]
                c = [chars[place - j].astype(np.int64) for j in range(ORDER - 1, -1, -1)]
                known.setdefault(lang, []).append((h[index], c[0] << 21 | c[1], c[2] << 21 | c[3], count))
                if len(known[lang]) > HELD_SLICES:
                    settle(lang)
        if sum(len(x[0]) for k in known.values() for x in k) > HELD_NGRAMS:
            yield from out()
    yield from out()


_MASK = (1 << 21) - 1


def _rows(table: pa.Table, order: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(lang, a, b, n) -> language -> (rows of ``order`` characters, counts)."""
    lang = np.array(table["lang"].to_pylist(), object)
    a, b, n = (table[c].to_numpy() for c in "abn")
    rows = np.stack([a >> 21, a & _MASK, b >> 21, b & _MASK], axis=1).astype(np.uint32)[:, ORDER - order :]
    return {x: (rows[lang == x], n[lang == x]) for x in set(lang)}


def _sharded(counts: DataFrame, part_ngrams: int) -> Sharded:
    """The model of (lang, a, b, n) in parts of about ``part_ngrams`` n-grams. The driver sees one part at a time, and
    what there is of each character."""
    spark = counts.sparkSession
    cuts, level = {}, counts
    for o in range(ORDER, 0, -1):
        if o < ORDER:  # continuation counts, as Model takes them
            key = {3: [F.col("a").bitwiseAND(F.lit(_MASK)).alias("a"), "b"], 2: [F.lit(0).cast("long").alias("a"), "b"], 1: [F.lit(0).cast("long").alias("a"), F.col("b").bitwiseAND(F.lit(_MASK)).alias("b")]}[o]
            level, _ = written(level.select("lang", *key).groupBy("lang", "a", "b").agg(F.count(F.lit(1)).alias("n")), "grams")
        for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():  # as many as languages
            cuts[r.lang, o] = discount(r.ones, r.twos)
    unigrams = _rows(level.toArrow(), 1)
    langs = sorted(unigrams)
    before = F.shiftright("b", 21)
    sizes = counts.groupBy(before.alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy("c").collect()  # as many as characters
    starts, held, part = [], 0, []
    for c, n in sizes:
        if held and held + n > part_ngrams:
            starts.append(c)
            held = 0
        held += n
        part.append((c, len(starts)))
    of = spark.createDataFrame(part, "c long, part int")
    dealt = counts.join(F.broadcast(of), before == F.col("c")).select("lang", "a", "b", "n", "part")
    dealt, _ = written(dealt.repartition("part"), "parts", "part")
    parts, none = [], (np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64))
    for i in range(len(starts) + 1):
        own = _rows(dealt.where(F.col("part") == i).drop("part").toArrow(), ORDER)
        parts.append(spark.sparkContext.broadcast(Model({x: own.get(x, none) for x in langs}, ORDER, unigrams, cuts)))
    return Sharded(parts, np.array(starts, np.uint32), langs)


def _sums(model: Model, texts: list[str], langs: list[str]) -> dict[tuple[int, int], int]:
    """What calibration needs of labelled texts with a letter: (language, k) -> the sum of the k-th powers of their
    cross-entropies, in UNITs; (-1, i) and (-2, i) -> the sum of -log p and of -log(1 - p) at the i-th temperature,
    p being the posterior of the text's language."""
    entropy, some = model.entropies(texts)
    own = np.array([model.langs.index(x) for x, ok in zip(langs, some, strict=True) if ok], np.int64)
    if not len(own):
        return {}
    entropy, at, out = entropy[some], np.arange(len(own)), {}
    mine = np.rint(entropy[at, own] * UNIT).astype(np.int64)
    for j in np.unique(own).tolist():
        values = mine[own == j].tolist()  # beyond 64 bits when squared
        out |= {(j, 0): len(values), (j, 1): sum(values), (j, 2): sum(v * v for v in values)}
    for i, t in enumerate(TEMPERATURES.tolist()):
        p = model.posterior(entropy, t)[at, own]
        for which, q in ((-1, p), (-2, 1 - p)):
            out[which, i] = int(np.rint(-np.log(np.maximum(q, 1e-12)) * UNIT).astype(np.int64).sum())
    return out


def _limit(n: int, total: int, squares: int) -> float:
    """Mean + SPREAD * deviation + SLACK of n cross-entropies, from their sums."""
    return total / n / UNIT + SPREAD * math.sqrt(n * squares - total * total) / n / UNIT + SLACK


def _calibrate(model: Model, labelled: DataFrame) -> None:
    """Set the model's temperature and limits by all rows (text, lang). The driver sees a few sums a language and two a
    temperature."""
    sent, most = _sent(labelled.sparkSession, model), _scored_bytes(model)

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for part in parts:
            _, at = utf8(part.column(0))
            for low, high in slices(at, most):
                texts, langs = (part.column(c).slice(low, high - low).to_pylist() for c in (0, 1))
                for key, n in _sums(sent.value, texts, langs).items():
                    held[key] = held.get(key, 0) + n
        own, k = ([key[c] for key in held] for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(k, pa.int32()), pa.array([Decimal(n) for n in held.values()], pa.decimal128(38, 0))], ["own", "k", "n"])

    tasks, _ = written(labelled.select("text", "lang").mapInArrow(tidy(measure), "own int, k int, n decimal(38,0)"), "sums")
    sums = {(r.own, r.k): int(r.n) for r in tasks.groupBy("own", "k").agg(F.sum("n").alias("n")).collect()}
    if not sums:
        return
    each = {j: [sums[j, k] for k in range(3)] for j in range(len(model.langs)) if (j, 0) in sums}
    total = [sum(x) for x in zip(*each.values(), strict=True)]
    # smoothed by one wrong text in twice as many, so that perfect ones don't mean certainty
    loss = [sums[-1, i] + sums[-2, i] / (2 * total[0]) for i in range(len(TEMPERATURES))]
    model.calibration["temperature"] = float(TEMPERATURES[int(np.argmin(loss))])
    model.calibration["limits"] = [_limit(*(each[j] if j in each and each[j][0] > 4 else total)) for j in range(len(model.langs))]


def train(docs: DataFrame, part_ngrams: int = MODEL_NGRAMS) -> Model | None:
    """A model of every language among the rows (doc_id, text, lang) that are not held out; None without any.

    It is of order ORDER at every size, in parts where it has more than ``part_ngrams`` n-grams. All these rows are
    counted, and all calibrate it.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.select("text", "lang").mapInArrow(tidy(_grams), "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))
    counts, _ = written(counts, "grams")
    if counts.count() > part_ngrams:
        model = _sharded(counts, part_ngrams)
    else:
        table = counts.toArrow()
        if not table.num_rows:
            return None
        model = Model(_rows(table, ORDER), ORDER)
    _calibrate(model, labelled)
    return model


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


def _judged(model: Model | None, texts: pa.Array) -> tuple[list, np.ndarray, list, np.ndarray]:
    """Language, score, cross-entropy and rejection of each text."""
    n = len(texts)
    lang, score, best, bad = [UNKNOWN] * n, np.zeros(n), [None] * n, np.ones(n, bool)
    if model is not None:
        entropy, some = model.entropies([t or "" for t in texts.to_pylist()])
        pick, p = entropy.argmin(axis=1), model.posterior(entropy)
        limits = np.array(model.calibration["limits"])
        for i in np.flatnonzero(some):
            j = pick[i]
            lang[i], score[i], best[i] = model.langs[j], p[i, j], float(entropy[i, j])
            bad[i] = entropy[i, j] > limits[j] or (len(limits) > 1 and p[i, j] < LEAST)
    return lang, score, best, bad


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    Only the text decides. ``und`` with score 0 for a null text or one without a letter, or when there is no
    model; such rows and those beyond the calibrated limits are rejected. score is the calibrated
    posterior of the language. Ties go to the first language by name. Repeated rows repeat; a row without
    a doc_id is not held out; other columns are ignored; an empty table gives an empty result.
    """
    sent, most = _sent(docs.sparkSession, model), _scored_bytes(model)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in parts:
            _, at = utf8(part.column(2))
            for low, high in slices(at, most):
                n = high - low
                lang, score, best, bad = _judged(model, part.column(2).slice(low, n))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(low, n), part.column(1).slice(low, n), pa.array(lang, pa.string()), pa.array(score), pa.array(best, pa.float64()), pa.array(bad)], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    ident = F.col("doc_id").cast("long")
    return docs.select(ident.alias("doc_id"), held_out(ident).alias("held_out"), "text").mapInArrow(tidy(rows), RESULT)


def language_id(docs: DataFrame, **bounds) -> DataFrame:
    """Train on the rows that are not held out, then identify all."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return identify(own, train(own, **bounds))


def drop_unidentified(docs: DataFrame, **bounds) -> DataFrame:
    """The documents that language_id does not reject, with all their columns. Each row is judged in place by its own
    text, so null and repeated ids decide nothing."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), **bounds)
    sent, most, column = _sent(docs.sparkSession, model), _scored_bytes(model), docs.columns.index("text")

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in parts:
            texts = part.column(column)
            _, at = utf8(texts)
            for low, high in slices(at, most):
                _, _, _, bad = _judged(model, texts.slice(low, high - low))
                yield part.slice(low, high - low).filter(pa.array(~bad))

    return docs.mapInArrow(tidy(keep), docs.schema)
