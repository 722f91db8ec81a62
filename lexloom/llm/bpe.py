"""Byte-level BPE read from a tokenizer file: encoding, decoding, and the words it splits texts into.

Encoding a word keeps its symbols in a doubly linked list and the possible merges in a priority
queue by (rank, place). A popped entry whose symbols have changed since is stale and is skipped.
Decoding joins vocabulary strings as the file's decoder says.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy


#: A worker keeps the encodings of up to so many words; then it begins anew.
MEMO_WORDS = 600_000

_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts with other characters than these take the slower, fully Unicode-aware patterns.
_RARE = re.compile("[\\x1c-\\x1f\\x85\\xb2\\xb3\\xb9\\xbc-\\xbe\\u0250-\\u200f\\u2028-\\u202f\\u2030-\\U0010ffff]")
_QUICK_BYTE = re.compile(r""" ?[^\W\d_]+| ?(?:[^\s\w']|_)(?:[^\s\w]|_)*|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+| ?\d+|\s+(?!\S)|\s+""")
_QUICK_WORD = re.compile(r"""[^\W\d_]+|(?:[^\s\w']|_)(?:[^\s\w]|_)*|'(?:[stmd]|re|ve|ll)|(?:[^\s\w]|_)+|\d""")

# What Unicode tables of different age disagree on. The tokenizers library takes letters and numbers as of
# Unicode 16, lower-cases as of 17, and composes as of 9; this Python and the regex package have other versions.
#: Ranges of letters and numbers that came after 16.
_LATER = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda
18d09-18d20 18d80-18df2 18e00-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5
1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""
#: Ranges of capitals that came after 15.1, with the lower-case letter of the first.
_LATER_CAPITALS = "1c89:1c8a a7cb:264 a7cc:a7cd a7ce:a7cf a7d2:a7d3 a7d4:a7d5 a7da:a7db a7dc:19b 10d50-10d65:10d70 16ea0-16eb8:16ebb"
#: Ranges of marks that came after 9 and so neither compose nor change places.
_LATER_MARKS = """7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85
11070 1133b 1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f
1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"""


def _ranges(listed: str) -> str:
    """The inside of a character class."""
    return "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in listed.split())


def _lower_map(listed: str) -> dict[int, int]:
    out = {}
    for capitals, low in (x.split(":") for x in listed.split()):
        first, last = (int(x, 16) for x in (capitals + "-" + capitals).split("-")[:2]) if "-" in capitals else (int(capitals, 16),) * 2
        out |= {first + i: int(low, 16) + i for i in range(last - first + 1)}
    return out


_LOWER = _lower_map(_LATER_CAPITALS)
_NEWLY_CASED = re.compile("[" + "".join(map(chr, _LOWER)) + "]")
_MARK = re.compile(f"([{_ranges(_LATER_MARKS)}])")
_L, _N, _OTHER = rf"[\p{{L}}--[{_ranges(_LATER)}]]", rf"[\p{{N}}--[{_ranges(_LATER)}]]", rf"[[^{_WHITE}\p{{L}}\p{{N}}]{_ranges(_LATER)}]"
_FULL_BYTE = regex.compile(rf"""(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?{_OTHER}+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+""")
_FULL_WORD = regex.compile(rf"""(?V1)'s|'t|'re|'ve|'m|'ll|'d|{_L}+|{_N}|{_OTHER}+""")


def composed(text: str) -> str:
    """NFC, with marks that composition does not know left where they are."""
    if not _RARE.search(text) or not _MARK.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", x) for x in _MARK.split(text))


def lowered(text: str) -> str:
    """Every character's full lower-case form; a sigma at a word's end is like any other."""
    if _RARE.search(text) and _NEWLY_CASED.search(text):
        text = text.translate(_LOWER)
    return text.replace("Σ", "σ").lower()


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_CHARS = byte_alphabet()
_TO_CHARS = {b: c for b, c in _CHARS.items()}
_FROM_CHARS = {c: b for b, c in _CHARS.items()}


def spelled(text: str) -> str:
    return "".join(map(_TO_CHARS.__getitem__, text.encode("utf-8", "replace")))


class Bpe:
    """A tokenizer file of kind byte-level BPE. ``words`` style: lower-cased words with an end mark."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE":
            raise ValueError(f"a BPE model is needed, not {model['type']}")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left, right) -> (rank, merged)
        self.merges = {(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.strings = {i: s for s, i in self.vocab.items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lower = data.get("normalizer") is not None
        self.byte_decoder = (data.get("decoder") or {}).get("type") == "ByteLevel"

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if self.lower:
            text = lowered(composed(text))
            return (_FULL_WORD if _RARE.search(text) else _QUICK_WORD).findall(text)
        return (_FULL_BYTE if _RARE.search(text) else _QUICK_BYTE).findall(text)

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings; whether a piece is one."""
        if self.cut is None or "<" not in text and all("<" in s for s in self.special):
            return [(text, False)]
        return [(s, s in self.special) for s in self.cut.split(text) if s]

    def symbols(self, word: str) -> list[int]:
        chars = list(spelled(word))
        if self.end and chars:
            chars[-1] += self.end
        return [self.vocab[c] for c in chars if c in self.vocab]

    def encode_word(self, word: str) -> list[int]:
        ids = self.symbols(word)
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapify(queue)
        while queue:
            _, i, left, right, merged = heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two has been merged meanwhile
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((merged, ids[k])):
                    heappush(queue, (m[0], i, merged, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], merged))):
                heappush(queue, (m[0], h, ids[h], merged, m[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for piece, special in self.segments(text or ""):
            if special:
                out.append(self.special[piece])
            else:
                for w in self.words(piece):
                    out.extend(self.encode_word(w))
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, as bytes for a byte-level decoder, else parted by spaces; unknown ids are skipped."""
        strings = [self.strings[i] for i in ids if i in self.strings]
        if not self.byte_decoder:
            return " ".join(strings)
        return b"".join(s.encode() if s in self.special else bytes(_FROM_CHARS[c] for c in s) for s in strings).decode("utf-8", "replace")


class _Memo(dict):
    """word -> made(word), forgotten when it grows too large."""

    def __init__(self, made, most: int = MEMO_WORDS):
        super().__init__()
        self.made, self.most = made, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.made(word)
        return out


_loaded: dict[str, tuple] = {}


def worker_coder(spec: str, most: int = MEMO_WORDS) -> tuple[Bpe, _Memo]:
    """This worker's tokenizer and what it knows of words: (little-endian ids, decoded string)."""
    key = f"{hashlib.sha1(spec.encode()).hexdigest()} {most}"
    if key not in _loaded:
        bpe = Bpe(spec)

        def made(word: str) -> tuple[bytes, str]:
            ids = bpe.encode_word(word)
            return np.array(ids, "<u4").tobytes(), bpe.decode(ids)

        _loaded[key] = bpe, _Memo(made, most)
    return _loaded[key]


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False, keep: tuple[str, ...] = (), memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids: ids array<int> too.

    Encodes each whole text with the tokenizer file at ``path`` (read by the driver), special strings
    in texts being their tokens, then decodes the ids. ids_sha256 is over little-endian unsigned 32-bit
    integers, decoded_sha256 over UTF-8. A null text is an empty one: no tokens. Rows are handled one by
    one, so repeated rows repeat; columns beyond doc_id, text and those named in ``keep`` are
    ignored; an empty table gives an empty result. A worker remembers at most ``memo_words`` words.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    kept = [F.col(c) for c in keep]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *kept)
    fields = [docs.schema[c] for c in keep]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = worker_coder(sent.value, memo_words)
        for part in parts:
            counts, ids_sha, text_sha, flat = [], [], [], []
            for text in part.column(1):
                ids, strings = [], []
                for piece, special in bpe.segments(text.as_py() or ""):
                    if special:
                        one = [bpe.special[piece]]
                        ids.append(np.array(one, "<u4").tobytes())
                        strings.append(bpe.decode(one))
                    else:
                        both = [*map(memo.__getitem__, bpe.words(piece))]
                        ids.extend(x[0] for x in both)
                        strings.extend(x[1] for x in both if x[1])
                raw = b"".join(ids)
                counts.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(("" if bpe.byte_decoder else " ").join(strings).encode()).hexdigest())
                if with_ids:
                    flat.append(raw)
            out = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), "<i4"))))
                names.append("ids")
            for i, f in enumerate(fields):
                out.append(part.column(2 + i))
                names.append(f.name)
            yield pa.RecordBatch.from_arrays(out, names)

    more = (", ids array<int>" if with_ids else "") + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)
    return source.mapInArrow(tidy(rows), RESULT + more)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the strings of the ids; a null list gives an empty text."""
    with open(path, encoding="utf-8") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = worker_coder(sent.value)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.decode(x.as_py() or []) for x in part.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidy(rows), "doc_id long, text string")


