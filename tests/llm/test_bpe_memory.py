"""Texts without white space: constant memory, and the library's ids across every kind of border."""

import random
import tracemalloc

import pytest
from tokenizers import Tokenizer

from tablewarden.llm import bpe, queries

PATH = queries.tokenizer_path(queries.WORD_BPE)


def reference(text):
    if not hasattr(reference, "made"):
        reference.made = Tokenizer.from_file(PATH)
        reference.made.no_truncation()
        reference.made.no_padding()
    return reference.made.encode(text, add_special_tokens=False).ids


def text_of(rng, n):
    """Words, marks, digits, contractions, special strings, composed and decomposed letters, few or no spaces."""
    special = sorted(bpe.spec_of(PATH).added)
    parts = ["word", "It's", "'s", "''", "!!!", "!'", "9", "2024", "é", "é", "́", "İ", "ß", "中文", "の", "が", "゙", "한", "ᄒ", "ᅡ", "ᆫ", "—", "€", "<", "<|", *special, "<|endof", "a" * 30, "?" * 40, "漢" * 25, "x" * rng.randint(1, 1500)]
    parts += [" ", "\n", " ", " "] if rng.random() < 0.3 else []
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("chunk", [40, 700])
def test_ids_equal_the_library_whatever_the_chunks(chunk, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "BLOCK", 16)
    rng = random.Random(chunk)
    for _ in range(120):
        text = text_of(rng, rng.randint(1, 60))
        assert bpe.encode_ids(text, PATH) == reference(text), text


def test_long_runs_of_one_kind(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 1000)
    for run in ("a" * 5000, "!" * 5000 + "'s", "漢" * 3000, "ab" * 2000 + "'s" + "é" * 2500, "'" * 4001 + "ll", "x" * 3000 + "<|endoftext|>" + "y" * 3000):
        assert bpe.encode_ids(run, PATH) == reference(run)


def peak(text):
    encoder = bpe.encoder_of(PATH)
    bpe.digest(text[:100_000], encoder)
    tracemalloc.start()
    bpe.digest(text, encoder)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_memory_without_white_space_is_that_with_it():
    line = "some,words;and-more.12!of(this)kind/"
    n = 2_000_000 // len(line)
    spaced, joined = peak((line + " ") * n), peak(line * n)
    assert joined < spaced + 6_000_000, (spaced, joined)  # a chunk has more pre-tokens without spaces
    ten_mb = peak(line * 5 * n)
    assert ten_mb < 1.1 * joined, (joined, ten_mb)
