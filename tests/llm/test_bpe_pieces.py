"""Pre-tokens that are cut ahead: the same digests, and none of a rich vocabulary encoded twice."""

import itertools
import random

from tablewarden.llm import bpe, queries

PATH = queries.tokenizer_path(queries.WORD_BPE)


def test_many_rare_words_are_encoded_once(monkeypatch):
    words = ["".join(c) for c in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 180_000)]
    random.Random(3).shuffle(words)
    texts = [" ".join(words[at : at + 9000]) for at in range(0, len(words), 9000)]
    encoder, merged = bpe.Encoder(bpe.spec_of(PATH)), []
    whole = encoder._merged
    monkeypatch.setattr(encoder, "_merged", lambda rows, lengths: merged.append(len(rows)) or whole(rows, lengths))
    for text in texts:
        encoder.prepare([text])
    assert sum(merged) == len(words)
    for text in texts:
        encoder.prepare([text.title()])
    assert sum(merged) == len(words)


def test_digests_of_cut_texts_are_those_of_whole_ones(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 300)
    rng = random.Random(4)
    bits = ["Word", "it's", "'ll", "don't", "42", "!?", "é", "ÀB", "<", "<|endoftext|>", "<|startoftext|>", "—", "中", " ", "x" * 40, " ", "\n", "\t\r"]
    texts = ["", " ", *("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 150))) for _ in range(600))]
    encoder, plain = bpe.Encoder(bpe.spec_of(PATH)), bpe.Encoder(bpe.spec_of(PATH))
    cuts = encoder.prepare(texts)
    assert any(cuts) and None in cuts
    for text, cut in zip(texts, cuts, strict=True):
        assert bpe.digest(text, encoder, cut) == bpe.digest(text, plain), text
