import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexloom.llm.bpe import Bpe, decode_ids, encode_decode
from lexloom.llm.token_counts import count_tokens, merged_length, whole_tokens

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))

TEXTS = [
    "", " ", "a", "Hello world, it's 2024!  \n\n don't  stop", "x" * 3000, "ab" * 2000, "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext",
    "<|startoftext|>hi<|endoftext|>", "É́ é ΑΣ ΟΔΟΣ Σ İstanbul ß ﬁ Ⅷ ② ½ x²", "日本語テキスト 🙂👩‍👩‍👧 العربية", "\x1c\x1d a\x85b c　d\xa0e ​", "it's IT'S we'Re '' 's''t",
    "_under_score__ -- __", "tab\there\r\nthere\x0b\x0c", "1234 ٣٤ ४५", "퟿\U0010ffff", "   lead and trail   ",
]


def random_texts(n):
    r = random.Random(5)
    alphabet = "abcdeé'ß .,!\n\t0123_<|>²ΣσАб文🙂́\xa0 "
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def all_chars():
    """Every code point, assigned or not: in a word, alone, doubled, beside numbers, and between and after marks."""
    for c in range(1, 0x110000):
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            yield f"a{x}b {x} {x}{x} 1{x}2 á{x}\u0323 a{x}\u0301{x}"


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys_for_every_code_point(path):
    theirs, ours = Tokenizer.from_file(path), Bpe(open(path, encoding="utf-8").read())
    texts = list(all_chars())
    for low in range(0, len(texts), 50_000):
        part = texts[low : low + 50_000]
        bad = [x[1] for x, e in zip(part, theirs.encode_batch(part, add_special_tokens=False), strict=True) if ours.encode(x) != e.ids]
        assert not bad


def test_words_split_as_in_the_library_for_every_code_point():
    """Classes of characters, also where the ids would not show them."""
    for path, full in ((BYTE, "_FULL_BYTE"), (WORD, "_FULL_WORD")):
        ours, split = Bpe(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
        texts = [f"a{chr(c)}1{chr(c)}-{chr(c)} {chr(c)}a" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
        for x in texts:
            plain = split.normalizer.normalize_str(x) if split.normalizer else x
            assert [w[1][1] - w[1][0] for w in split.pre_tokenizer.pre_tokenize_str(plain)] == [len(w) for w in ours.words(x)], (full, x)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys(path):
    theirs, ours = Tokenizer.from_file(path), Bpe(open(path, encoding="utf-8").read())
    for text in TEXTS + random_texts(400) + ['\U00011935\U00011930 \U00011938', 'x' * 200_000, 'word ' * 60_000]:
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == want, text[:80]
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False), text[:80]


def test_whole_tokens_are_proven():
    bpe = Bpe(open(BYTE, encoding="utf-8").read())
    whole = whole_tokens(bpe)
    assert 45_000 < len(whole) <= len(bpe.vocab)
    for word in [*random.Random(1).sample(sorted(whole), 500), "antidisestablishment", "x" * 100]:
        assert merged_length(bpe, word) == len(bpe.encode_word(word))


def test_counts_and_round_trip(spark):
    theirs = Tokenizer.from_file(BYTE)
    other = Tokenizer.from_file(WORD)
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS + random_texts(50))] + [(None, "no id", "x", 1), (900, None, None, None), (900, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int").repartition(3)
    got = count_tokens(docs, BYTE, limit=5).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()), n := len(theirs.encode(t or "").ids), n > 5) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    enc = encode_decode(docs, WORD, with_ids=True)
    by = {r.doc_id: r for r in enc.collect()}
    texts = {r.doc_id: r.text for r in decode_ids(enc, WORD).collect()}
    for i, t, _, _ in rows:
        ids = other.encode(t or "", add_special_tokens=False).ids
        back = other.decode(ids, skip_special_tokens=False)
        assert (by[i].n_tokens, by[i].ids, texts[i]) == (len(ids), ids, back)
        assert by[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(docs, BYTE).collect() == [] == encode_decode(docs, WORD).collect()
