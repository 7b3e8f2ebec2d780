"""BPE and token counts against the tokenizers library; lookahead; decoding."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewarden.llm import bpe, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab eÉéÈ'’sStT<|>1²½ªºΣσςİıßẞ가각日本٣\u00a0\u2003\x85\x1c\x0b\n\t\r\U0001d538😀ǅŉﬁ_-—…“”\u0301\u200b\ufeffÅक़"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(5)
    bits = ["<|startoftext|>", "<|endoftext|>", "'s", "'ll", "the", " ", "<|end"]
    out = ["", " ", "Hello World's end", "a" * 3000, "ha" * 2000, "!" * 1500, "日本語" * 900, "x" * 70_000 + " y", "word " * 20_000]
    out += ["".join(rng.choice("abcdefghiéè") for _ in range(2500)) for _ in range(3)]
    return out + ["".join(rng.choice(ALPHABET) if rng.random() < 0.8 else rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


def test_digest_equals_the_library(library):
    encoder = bpe.Encoder(bpe.spec_of(PATH))
    some = texts()
    encoder.prepare(some[: len(some) // 2])
    for text in some:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert bpe.digest(text, encoder) == want, text[:60]
        assert bpe.decode_ids(ids, PATH) == decoded


def assert_like_the_library(library, some):
    split, counter, encoder = token_counts.Splitter(PATH), token_counts.piece_counter(PATH), bpe.encoder_of(PATH)
    encoder.prepare(some)
    for text, want in zip(some, library.encode_batch(some, add_special_tokens=False), strict=True):
        assert bpe.encode_ids(text, PATH) == want.ids, text[:80]
        units, special = split(text)
        pretokens = [p for u in units for p in split.cut(u)]
        assert special + sum(map(len, counter.encode_batch_fast(pretokens, add_special_tokens=False))) == len(want.ids), text[:80]


def test_every_code_point_inside_a_word(library):
    points = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    assert_like_the_library(library, [f"ab{c}cd {c}x" for c in points[:0x300]])
    assert_like_the_library(library, [" ".join(f"ab{c}cd {c}x" for c in points[i : i + 100]) for i in range(0, len(points), 100)])


def test_letters_whose_lower_case_lies_elsewhere(library):
    rng = random.Random(0)
    assert_like_the_library(library, ["Əli Bakı", "Hello Ɖa", "aƁb", "ƜɄybgynƔ"])
    assert_like_the_library(library, ["".join(chr(rng.randrange(0x180, 0x250)) if rng.random() < 0.6 else rng.choice("abcXYZ") for _ in range(rng.randint(1, 12))) for _ in range(20_000)])


def test_batch_merge_equals_one_by_one():
    spec = bpe.spec_of(PATH)
    encoder = bpe.Encoder(spec)
    words = ["there", "éclair", "x", "zzzz", "supercalifragilistic"]
    encoder.prepare([" ".join(words)])
    assert [encoder.cache[w] for w in words] == [encoder.encode(w) for w in words]


def test_lookahead_is_sufficient_for_small_merge_lists():
    rng = random.Random(1)
    for _ in range(60):
        merges, tokens = [], ["a", "b"]
        while len(merges) < 8:
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair not in merges and len("".join(pair)) < 9:
                merges.append(pair)
                tokens.append("".join(pair))
        ranks, reach = {m: i for i, m in enumerate(merges)}, bpe.lookahead(merges)
        for _ in range(40):
            text = [rng.choice("ab") for _ in range(reach + 12)]
            more = [rng.choice("ab") for _ in range(10)]
            short, long = bpe.merge(text, ranks), bpe.merge(text + more, ranks)
            at = 0
            for x, y in zip(short, long, strict=False):
                if at + len(x) > len(text) - reach:
                    break
                assert x == y
                at += len(x)


def test_byte_level_decoder():
    letters = bpe.byte_letters()
    decoder = bpe.Decoder(byte_level=True)
    parts = [decoder.feed(letters[b]) for b in "é😀".encode()]
    assert "".join(parts) + decoder.finish() == "é😀" and parts[0] == ""


def documents(spark):
    rows = [(i, t.replace("\0", ""), 7) for i, t in enumerate(texts()[:400])] + [(None, None, 7), (3, "again again", 7), (3, "again again", 7)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, pieces int")


def test_documents(spark, library):
    rows, docs = documents(spark)
    want = sorted(((i if i is not None else -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows))
    for head in (0, 50, 100_000):
        got = token_counts.count_tokens(docs, PATH, head_rows=head).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    got = bpe.encode_documents(docs, PATH).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == [(i, n) for i, _, n in want]
    assert token_counts.count_tokens(docs.where("false"), PATH).count() == 0
    assert bpe.encode_documents(docs.where("false"), PATH).count() == 0
