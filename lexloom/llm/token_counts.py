"""Token counts with the whole-token shortcut.

Offline, on the driver, every vocabulary string is encoded by its own merges; those that end as one
token, themselves, are proven whole. A pre-token among them counts one without any merge. Only the rest
is merged, each distinct word once for as long as a worker remembers it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _FROM_CHARS, MEMO_WORDS, Bpe
from .common import tidy, utf8

#: Symbols up to which a plain scan for the best merge is faster than a queue.
SHORT = 48


def whole_tokens(bpe: Bpe) -> dict[str, int]:
    """Texts that encode alone as one token, as a table of ones."""
    proven = {}
    for string, ident in bpe.vocab.items():
        plain = string.removesuffix(bpe.end) if bpe.end else string
        try:
            text = bytes(_FROM_CHARS[c] for c in plain).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue  # no whole text is spelled so
        if text and bpe.encode_word(text) == [ident]:
            proven[text] = 1
    return proven


def merged_length(bpe: Bpe, word: str) -> int:
    """How many tokens a word ends as."""
    ids = bpe.symbols(word)
    if len(ids) > SHORT:
        return len(bpe.encode_word(word))
    get, none = bpe.merges.get, (1 << 40, 0)
    while len(ids) > 1:
        ranked = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        best = min(ranked)
        if best is none:
            break
        i = ranked.index(best)
        ids[i : i + 2] = [best[1]]
    return len(ids)


class _Known(dict):
    """word -> its tokens: one for the proven, merged at first sight for the rest."""

    def __init__(self, bpe: Bpe, whole: dict[str, int], most: int = MEMO_WORDS):
        super().__init__(whole)
        self.bpe, self.whole, self.most = bpe, whole, most + len(whole)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.whole)
        out = self[word] = self.whole.get(word) or merged_length(self.bpe, word)
        return out


_loaded: dict[str, _Known] = {}


def worker_counts(spec: str, whole: dict[str, int]) -> _Known:
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = _Known(Bpe(spec), whole)
    return _loaded[key]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts the tokens of each whole text by the tokenizer file at ``path`` (read by the driver), without
    tokens added at its ends; special strings in a text are one token each. A null text is an empty
    one: 0 bytes, 0 tokens. Rows are handled one by one, so repeated rows repeat; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    sent = spark.sparkContext.broadcast((spec, whole_tokens(Bpe(spec))))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_counts(*sent.value)
        bpe = known.bpe
        for part in parts:
            counts = []
            for text in part.column(1):
                n = 0
                for piece, special in bpe.segments(text.as_py() or ""):
                    n += 1 if special else sum(map(known.__getitem__, bpe.words(piece)))
                counts.append(n)
            _, at = utf8(part.column(1))
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(rows), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
