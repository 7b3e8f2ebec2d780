"""BPE encoding and decoding as streaming transducers with bounded memory.

Encoding reads a text piece by piece. A pre-tokeniser state machine cuts it into pre-tokens; those of ordinary length
are encoded whole (and remembered in a bounded cache), a longer one is encoded in blocks: with the merge list's
sufficient lookahead L, a token that ends at least L symbols before the end of what has been read cannot change any
more, so it is emitted and forgotten. Decoding feeds tokens to an incremental byte-to-text machine.

Lookahead. Whether token t stays as it is depends on what is right of it only through a merge (x, y) with x on the right
edge of t: that needs y, and whether y forms depends in turn on earlier merges whose left part is on y's right edge.
Ranks fall at every step, so over the merge list in order ``need(x, y) = len(y) + max(need of earlier merges with a left
part on the right edge of y)``, and L is the largest need.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewarden.llm.text import slices

#: Characters of a text that the encoder takes at a time.
CHUNK = 1 << 16
#: Symbols of one pre-token that are encoded at a time, besides the lookahead.
BLOCK = 512
#: Characters that are cut into pre-tokens at once where there is no white space.
WINDOW = 8 * BLOCK
#: Bytes of a pre-token up to which pre-tokens are encoded together.
SHORT = 32
#: Pre-tokens that an encoder remembers, about 300 bytes each. Invented words bring one anew every dozen words, so with
#: few entries most of the time goes into encoding the same ones again.
PIECES = 1_000_000

#: Characters other than letters, digits and white space that plain texts may hold besides ASCII ones.
PLAIN_MARKS = "¡§«°»¿×÷–—‘’‚“”„…€"


def plain_characters() -> tuple[str, str]:
    """(lower-case letters, all letters) up to U+024F of plain texts: the lower case is one character that is its own
    composed form and also lies in that range, so a word that is lower-cased holds no other letter."""
    known = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and unicodedata.category(c) != "Lo" and unicodedata.normalize("NFC", c) == c]
    lower = {c for c in known if c.lower() == c}
    return "".join(sorted(lower)), "".join(c for c in known if c.lower() in lower)


PLAIN_LETTERS, PLAIN_CASES = plain_characters()
PLAIN_TEXT = re.compile(f"[\t-\r -~{PLAIN_MARKS}{PLAIN_CASES}]*")
PLAIN_PIECE = re.compile(f"[{PLAIN_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\s{PLAIN_LETTERS}0-9]+")


#: Characters that no composition joins to the one before them.
NO_SECOND = re.compile("[\x00-\u02ff\u3041-\u3096\u30a1-\u30fa\u3400-\u9fff\uac00-\ud7a3]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Spec:
    """What a tokenizer file with a byte-level BPE model says: vocabulary, merges, pre-token pattern, added tokens."""

    def __init__(self, path: str):
        data = json.load(open(path, encoding="utf-8"))
        model = data["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pieces = {i: t for t, i in (self.vocab | self.added).items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        kinds = [n["type"] for n in (data["normalizer"] or {"normalizers": []})["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a tokenizer that composes, folds white space and lower-cases is expected")
        split = data | {"pre_tokenizer": data["pre_tokenizer"]["pretokenizers"][0], "added_tokens": []}
        self.splitter = Tokenizer.from_str(json.dumps(split))
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.letters = byte_letters()
        self.lookahead = lookahead(merges)
        #: Whether every byte has a symbol of its own, so that no text is without an id.
        self.table = Ranks(self.vocab, merges)
        size = max(self.pieces) + 1
        self.id_bytes = [str(i).encode() for i in range(size)]
        self.token_bytes = [self.pieces.get(i, "").encode("utf-8") for i in range(size)]
        self.byte_ids = np.array([self.vocab.get(c, -1) for c in self.letters])
        self.last_byte_ids = np.array([self.vocab.get(c + self.suffix, -1) for c in self.letters])
        self.complete = all(c in self.vocab and c + self.suffix in self.vocab for c in self.letters)

    def symbols(self, pretoken: str, last: bool) -> list[str]:
        """First symbols of (a part of) a pre-token; the one at its end carries the end-of-word mark."""
        out = [self.letters[b] for b in pretoken.encode("utf-8")]
        if last and out:
            out[-1] += self.suffix
        return out


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols to the right of a token after which no merge can change it (see the module's text)."""
    right: dict[str, str] = {}
    need: dict[str, int] = {}
    longest = 0
    lengths: dict[str, int] = {}

    def length(token: str) -> int:
        return lengths.get(token, 1)

    for left, y in merges:
        edge, far = y, 0
        while edge is not None:
            far = max(far, need.get(edge, 0))
            edge = right.get(edge)
        own = length(y) + far
        need[left] = max(need.get(left, 0), own)
        longest = max(longest, own)
        merged = left + y
        if merged not in right:
            right[merged] = y
            lengths[merged] = length(left) + length(y)
    return longest


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Applies the merges: the lowest rank first, from the left."""
    out = list(symbols)
    none = len(ranks)
    found = [ranks.get(p, none) for p in zip(out, out[1:], strict=False)]
    while found and (best := min(found)) < none:
        i = found.index(best)
        out[i : i + 2] = [out[i] + out[i + 1]]
        del found[i]
        if i:
            found[i - 1] = ranks.get((out[i - 1], out[i]), none)
        if i < len(found):
            found[i] = ranks.get((out[i], out[i + 1]), none)
    return out


class Ranks:
    """Merge ranks for numpy: pairs of symbol numbers as sorted keys. Numbers are those of the vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values()) + 1
        usable = [(vocab[a], vocab[b], vocab[a + b], r) for r, (a, b) in enumerate(merges) if a in vocab and b in vocab and a + b in vocab]
        left, right, made, rank = np.array(usable, np.int64).reshape(-1, 4).T
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys = np.append((left * self.size + right)[order], np.iinfo(np.int64).max)
        self.rank, self.made, self.none = np.append(rank[order], -1), np.append(made[order], -1), len(merges)

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; the rank is ``none`` where there is no merge. Negative symbols are none."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], self.none), self.made[at]


def merge_all(words: np.ndarray, ranks: Ranks) -> np.ndarray:
    """Merges many short symbol rows (padded with -1) at once: in every round each row does its lowest-ranked merge."""
    words = words.copy()
    rows = np.arange(len(words))
    rank, _ = ranks.of(words[:, :-1], words[:, 1:])
    while len(rows):
        best = rank.argmin(axis=1)
        go = np.flatnonzero(rank[np.arange(len(rows)), best] < ranks.none)
        rows, rank, best = rows[go], rank[go], best[go]
        if not len(rows):
            break
        w, i = words[rows], np.arange(len(rows))
        merged = ranks.of(w[i, best], w[i, best + 1])[1]
        shift = np.arange(w.shape[1])
        take = np.minimum(shift + (shift > best[:, None]), w.shape[1] - 1)
        new = np.take_along_axis(w, take, 1)
        new[:, -1] = -1
        new[i, best] = merged
        words[rows] = new
        rank = np.take_along_axis(rank, np.minimum(take[:, :-1], rank.shape[1] - 1), 1)
        rank[:, -1] = ranks.none
        before, after = np.maximum(best - 1, 0), np.minimum(best, rank.shape[1] - 1)
        rank[i, after] = ranks.of(new[i, after], new[i, after + 1])[0]
        rank[i, before] = ranks.of(new[i, before], new[i, before + 1])[0]
    return words


class Remembered(dict):
    """A bounded cache of a function in two generations: what was used lately survives when the older one goes."""

    def __init__(self, function, limit: int = PIECES):
        super().__init__()
        self.function, self.limit, self.old = function, limit // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= 64:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.old = self.copy()
            self.clear()


class PieceStream:
    """Encodes one pre-token that comes in parts: ``feed`` gives the tokens that are stable, ``close`` the rest."""

    def __init__(self, spec: Spec, block: int = BLOCK):
        self.spec, self.block, self.held = spec, block, ""

    def feed(self, part: str) -> Iterator[str]:
        self.held += part
        while len(self.held) > self.block + self.spec.lookahead:
            size = self.block + self.spec.lookahead
            head = self.held[:size]
            tokens = merge(self.spec.symbols(head, last=False), self.spec.ranks)
            total = sum(map(len, tokens))
            done, kept = 0, []
            for token in tokens:
                if done + len(token) > total - self.spec.lookahead:
                    break
                done += len(token)
                kept.append(token)
            raw = head.encode("utf-8")
            while done and done < len(raw) and raw[done] & 0xC0 == 0x80:  # only whole characters leave the buffer
                done -= len(kept.pop())
            yield from kept
            self.held = raw[done:].decode("utf-8") + self.held[size:]
            if not kept:
                break

    def close(self) -> list[str]:
        symbols = self.spec.symbols(self.held, last=True)
        self.held = ""
        return merge(symbols, self.spec.ranks)


Piece = tuple[bytes, bytes]


class Encoder:
    """Text parts to pieces: (ids joined by a space, token strings joined by a space). One encoder serves many texts:
    ``feed`` the parts of one, then ``finish`` it."""

    def __init__(self, spec: Spec):
        self.spec, self.rest = spec, ""
        self.open, self.tail = None, ""  # a long pre-token whose first part has left ``rest``, and its last two characters
        self.cache = Remembered(self.encode)
        self.reach = max((len(t) for t in spec.added), default=1)

    def encode(self, pretoken: str) -> Piece:
        """Of a whole pre-token."""
        if len(pretoken) > BLOCK:
            return self._long(pretoken)
        return self.written(merge(self.spec.symbols(pretoken, last=True), self.spec.ranks))

    def prepare(self, texts: list[str]) -> list[list[str] | None]:
        """The pre-tokens of plain texts of one chunk; any other text has none here. Those of ordinary length that the plain
        texts bring anew are encoded together, and remembered."""
        self.cache.trim()
        spec = self.spec
        cuts: list[list[str] | None] = []
        found: set[str] = set()
        for text in texts:
            cuts.append(None)
            if not PLAIN_TEXT.fullmatch(text):
                continue
            for at in range(0, len(text), CHUNK):  # a pre-token that a border cuts is encoded again where it is whole
                pieces = PLAIN_PIECE.findall(text[at : at + CHUNK].lower())
                found.update(pieces)
            if len(text) <= CHUNK and not (spec.special is not None and "<" in text and spec.special.search(text)):
                cuts[-1] = pieces if text else []
        raw = {p: p.encode("utf-8") for p in found if p not in self.cache and p not in self.cache.old}
        raw = {p: b for p, b in raw.items() if len(b) <= SHORT}
        if not raw or not spec.complete:
            return cuts
        lengths = np.fromiter(map(len, raw.values()), np.int64, len(raw))
        rows = np.full((len(raw), SHORT), -1, np.int64)
        rows[np.arange(SHORT) < lengths[:, None]] = spec.byte_ids[np.frombuffer(b"".join(raw.values()), np.uint8)]
        last = np.frombuffer(bytes(b[-1] for b in raw.values()), np.uint8)
        rows[np.arange(len(raw)), lengths - 1] = spec.last_byte_ids[last]
        for pretoken, ids in zip(raw, self._merged(rows, lengths), strict=True):
            self.cache[pretoken] = self.piece(ids)
        return cuts

    def _merged(self, rows: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """Ids of each row, rows of like length together."""
        out: list[list[int]] = [[]] * len(rows)
        low = 0
        for high in (4, 7, 10, 14, 20, SHORT):
            some = np.flatnonzero((lengths > low) & (lengths <= high))
            merged = merge_all(rows[some, :high], self.spec.table) if len(some) else rows[:0]
            counts = (merged >= 0).sum(axis=1).tolist()
            for i, ids, n in zip(some.tolist(), merged.tolist(), counts, strict=True):
                out[i] = ids[:n]
            low = high
        return out

    def written(self, tokens: list[str]) -> Piece:
        """A token outside the vocabulary has no id and is left out, as by a model without an unknown token."""
        return self.piece([self.spec.vocab[t] for t in tokens if t in self.spec.vocab])

    def piece(self, ids: list[int]) -> Piece:
        return b" ".join([self.spec.id_bytes[i] for i in ids]), b" ".join([self.spec.token_bytes[i] for i in ids])

    def pretokens(self, text: str) -> list[str]:
        """Of any text that ends where pre-tokens end, cut by the file's own normaliser and pattern: Python's tables of
        letters and cases are of another Unicode version."""
        splitter = self.spec.splitter
        return [p for p, _ in splitter.pre_tokenizer.pre_tokenize_str(splitter.normalizer.normalize_str(text))]

    def _long(self, pretoken: str) -> Piece:
        stream = PieceStream(self.spec)
        tokens = [t for at in range(0, len(pretoken), BLOCK) for t in stream.feed(pretoken[at : at + BLOCK])]
        return self.written([*tokens, *stream.close()])

    def _plain(self, text: str) -> list[Piece]:
        self.cache.trim()
        if PLAIN_TEXT.fullmatch(text):
            return list(map(self.cache.__getitem__, PLAIN_PIECE.findall(text.lower())))
        return list(map(self.cache.__getitem__, self.pretokens(text)))

    def _pieces(self, text: str) -> list[Piece]:
        if self.spec.special is None or "<" not in text:
            return self._plain(text)
        out, at = [], 0
        for found in self.spec.special.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append(self.piece([self.spec.added[found[0]]]))
            at = found.end()
        return out + self._plain(text[at:])

    def feed(self, part: str) -> list[Piece]:
        """Pieces of what is complete so far: up to the last white space outside the reach of a special string, or else up to
        the last pre-token, of which a long one is streamed. So ``rest`` stays within a few chunks for any text."""
        self.rest += part
        limit = len(self.rest) - self.reach
        if limit <= 0:
            return []
        cut = max(self.rest.rfind(c, 0, limit) for c in " \n\t\r")
        if cut > 0 or (cut == 0 and self.open):
            ready, self.rest = self.rest[:cut], self.rest[cut:]
            return self._ready(ready)
        out: list[Piece] = []
        while limit > BLOCK:
            before = len(self.rest)
            out += self._unspaced(min(limit, WINDOW))
            if len(self.rest) == before:
                break
            limit = len(self.rest) - self.reach
        return out

    def finish(self) -> list[Piece]:
        ready, self.rest = self.rest, ""
        return self._ready(ready)

    def _split(self, normal: str) -> list[str]:
        return [p for p, _ in self.spec.splitter.pre_tokenizer.pre_tokenize_str(normal)]

    def _streamed(self, part: str, last: bool = False) -> list[Piece]:
        """More of the open pre-token."""
        tokens = [t for at in range(0, len(part), BLOCK) for t in self.open.feed(part[at : at + BLOCK])]
        if last:
            tokens += self.open.close()
            self.open, self.tail = None, ""
        else:
            self.tail = (self.tail + part)[-2:]
        return [self.written(tokens)] if tokens else []

    def _ready(self, text: str) -> list[Piece]:
        """Of text that ends where a pre-token does, behind the open one if there is one."""
        if self.open is None:
            return self._pieces(text)
        found = self.spec.special.search(text) if self.spec.special is not None else None
        near, far = (text[: found.start()], text[found.start() :]) if found else (text, "")
        first, *others = self._split(self.tail + self.spec.splitter.normalizer.normalize_str(near))
        out = self._streamed(first[len(self.tail) :], last=True)
        return out + list(map(self.cache.__getitem__, others)) + (self._pieces(far) if far else [])

    def _unspaced(self, limit: int) -> list[Piece]:
        """Of ``rest`` without white space before ``limit``: all pre-tokens but the last, which may go on; a last one that
        is all there is goes on as a stream. Two characters before tell how the pattern goes on behind an open one."""
        found = self.spec.special.search(self.rest) if self.spec.special is not None else None
        if found and found.start() < limit:
            at = found.start() or found.end()
            ready, self.rest = self.rest[:at], self.rest[at:]
            return self._ready(ready)
        while limit and not NO_SECOND.match(self.rest[limit]):
            limit -= 1  # what follows may be composed with the character before
        normal = self.spec.splitter.normalizer.normalize_str(self.rest[:limit])
        if not normal:
            return []
        first, *others = self._split(self.tail + normal)
        if not others:
            if self.open is None:
                if len(first) <= BLOCK:
                    return []
                self.open = PieceStream(self.spec)
            self.rest = self.rest[limit:]
            return self._streamed(first[len(self.tail) :])
        out = self._streamed(first[len(self.tail) :], last=True) if self.open is not None else [self.cache[first]]
        self.rest = others.pop() + self.rest[limit:]
        return out + list(map(self.cache.__getitem__, others))


class Decoder:
    """Token strings to text. Word-level files have no decoder: token strings are joined by spaces. Byte-level ones map
    letters to bytes, and bytes to text by a UTF-8 machine that keeps an unfinished character between calls."""

    def __init__(self, byte_level: bool = False):
        self.first, self.bytes = True, {c: b for b, c in enumerate(byte_letters())} if byte_level else None
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: str) -> str:
        if self.bytes is not None:
            return self.machine.decode(bytes(self.bytes[c] for c in token))
        return self.take(token.encode("utf-8"))

    def take(self, tokens: bytes) -> str:
        """Text of word-level tokens that are joined by spaces already, after those that came before."""
        lead, self.first = b"" if self.first else b" ", False
        return self.machine.decode(lead + tokens)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=4)
def spec_of(path: str) -> Spec:
    return Spec(path)


@lru_cache(maxsize=4)
def encoder_of(path: str) -> Encoder:
    """One encoder, and so one cache, for each Python worker and file."""
    return Encoder(spec_of(path))


def digest(text: str, encoder: Encoder, cuts: list[str] | None = None) -> tuple[int, str, str]:
    """(number of tokens, SHA-256 of the ids joined by a space, SHA-256 of the decoded text), in constant memory. ``cuts``
    are the text's pre-tokens where ``prepare`` has given them."""
    ids, decoded, decoder, n = hashlib.sha256(), hashlib.sha256(), Decoder(), 0
    lead = b""

    def take(pieces: list[Piece]) -> None:
        nonlocal n, lead
        if not encoder.spec.complete:
            pieces = [p for p in pieces if p[0]]
        if pieces:
            numbers, tokens = map(b" ".join, zip(*pieces, strict=True))
            n += numbers.count(b" ") + 1
            ids.update(lead + numbers)
            decoded.update(decoder.take(tokens).encode("utf-8"))
            lead = b" "

    if cuts is not None:
        take(list(map(encoder.cache.__getitem__, cuts)))
    else:
        for at in range(0, len(text) - CHUNK, CHUNK):
            take(encoder.feed(text[at : at + CHUNK]))
        encoder.rest += text[max(0, -(-len(text) // CHUNK) - 1) * CHUNK :]
        take(encoder.finish())
    decoded.update(decoder.finish().encode("utf-8"))
    return n, ids.hexdigest(), decoded.hexdigest()


def encode_ids(text: str, path: str) -> list[int]:
    """Ids of one text."""
    encoder = encoder_of(path)
    parts = [p for at in range(0, len(text), CHUNK) for p in encoder.feed(text[at : at + CHUNK])]
    return [int(i) for p, _ in [*parts, *encoder.finish()] for i in p.split()]


def decode_ids(ids: list[int], path: str) -> str:
    """Text of the ids, special tokens included."""
    pieces, decoder = spec_of(path).pieces, Decoder()
    return "".join([decoder.feed(pieces[i]) for i in ids] + [decoder.finish()])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded, and its ids decoded again.

    A null text counts as an empty one (0 tokens, digests of the empty string). One row per input row, repeated rows
    and rows with equal or null ids included; an empty table gives no rows; other columns are ignored. A very long
    text is encoded and decoded in parts of ``CHUNK`` characters that end at white space or, without any, at a pre-token; a
    very long pre-token in blocks. So memory beside the text is constant. The work is a map over documents: there is no shuffle, and a lost task is simply run again.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            start = 0
            for part in slices(batch.column("text")):
                cuts = encoder.prepare(part)
                n, ids, decoded = zip(*(digest(t, encoder, c) for t, c in zip(part, cuts, strict=True)), strict=True)
                columns = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(decoded)}
                yield pa.record_batch({"doc_id": batch.column("doc_id")[start : start + len(part)], **columns})
                start += len(part)

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
