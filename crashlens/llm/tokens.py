"""Token ids of whole texts, equal to those of the tokenizers library.

Both public BPE files split a text into pieces before any merge, and a piece's ids depend on the piece alone. Pieces are
found with array operations, encoded once each and kept in a bounded cache; texts with characters or strings for which
that split isn't spelled out here go through the library as they are.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np

from crashlens.llm.scan import powers

U64 = np.uint64
#: Characters below this are classified by table.
TOP = 0x250
#: Pieces kept by a worker.
CACHE = 400_000
#: Characters tokenized at a time.
BLOCK = 1 << 19

LETTER, NUMBER, OTHER, BLANK, UNKNOWN = range(5)
_KIND = np.full(TOP + 1, UNKNOWN, np.uint8)
for _c in range(TOP):
    _category = unicodedata.category(chr(_c))
    if _c == 0x20 or 0x09 <= _c <= 0x0D:
        _KIND[_c] = BLANK
    elif _category[0] in "LN":
        _KIND[_c] = LETTER if _category[0] == "L" else NUMBER
    elif _category[0] in "PS" and _c != 0x27:
        _KIND[_c] = OTHER
_KIND[0x130] = UNKNOWN
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, TOP + 1, dtype=U64)
_FOLDED = _VALUES.copy()
for _c in range(TOP):
    if len(chr(_c).lower()) == 1 and ord(chr(_c).lower()) < TOP:
        _FOLDED[_c] = _VALUES[ord(chr(_c).lower())]


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """encode(texts) gives flat ids and n + 1 offsets."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.style = "library"
        if spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"):
            if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer"):
                self.style = "spaced"
            elif before.get("type") == "Sequence" and [x["type"] for x in before["pretokenizers"]] == ["Split", "ByteLevel"] and [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                self.style = "words"
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.values = _FOLDED if self.style == "words" else _VALUES
        self.shown = _byte_characters()
        self.shown[0] = "\0"  # parts pieces; no piece that is cut here has it
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.size, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _plain(self, text: str) -> bool:
        return not any(x in text for x in self.added)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Adds the ids of new pieces, in ascending order of their keys, to the sorted table."""
        joined = "\0".join(pieces)
        if self.style == "words":
            joined = joined.lower()
        tokenize = self.library.model.tokenize
        found = [[x.id for x in tokenize(p)] for p in joined.encode().decode("latin-1").translate(self.shown).split("\0")]
        size = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(size.sum()))
        at = np.searchsorted(self.keys, keys)
        self.begin = np.insert(self.begin, at, len(self.flat) + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.keys, self.flat = np.insert(self.keys, at, keys), np.append(self.flat, flat)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = [x or "" for x in texts]
        ids, lengths = [], np.zeros(len(texts) + 1, np.int64)
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
                size += len(texts[j])
                j += 1
            flat, counts = self._block(texts[i:j])
            ids.append(flat)
            lengths[i + 1 : j + 1] = counts
            i = j
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.cumsum(lengths)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.style == "library":
            return self._library(texts)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.minimum(chars, TOP)
        offsets = np.cumsum([0, *map(len, texts)])
        kind = _KIND[chars]
        odd = np.zeros(len(texts), bool)
        if len(strange := np.flatnonzero(kind == UNKNOWN)):
            odd[np.searchsorted(offsets, strange, "right") - 1] = True
        for i, x in enumerate(texts):
            odd[i] |= not self._plain(x)
        if odd.any():
            out, counts = [], np.zeros(len(texts), np.int64)
            fine = np.flatnonzero(~odd)
            some, n = self._block([texts[i] for i in fine]) if len(fine) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            counts[fine] = n
            rest, n = self._library([texts[i] for i in np.flatnonzero(odd)])
            counts[odd] = n
            a = b = 0
            for i in range(len(texts)):
                if odd[i]:
                    out.append(rest[b : b + counts[i]])
                    b += counts[i]
                else:
                    out.append(some[a : a + counts[i]])
                    a += counts[i]
            return np.concatenate(out), counts
        starts, ends = self._split(chars, kind, offsets)
        return self._join("".join(texts), chars, starts, ends, offsets)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.asarray(self.library.encode(x, add_special_tokens=False).ids, np.int32) for x in texts]
        return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), np.array([len(x) for x in rows], np.int64)

    def _split(self, chars: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(chars)
        head = np.zeros(n, bool)
        tail = np.zeros(n, bool)
        head[offsets[:-1][offsets[:-1] < n]] = True
        tail[offsets[1:][offsets[1:] > 0] - 1] = True
        blank = kind == BLANK
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= head
        if self.style == "words":
            first = ~blank & (change | (kind == NUMBER))
            last = np.ones(n, bool)
            last[:-1] = first[1:] | blank[1:]
            last |= tail
            return np.flatnonzero(first), np.flatnonzero(last & ~blank) + 1
        before_blank = np.zeros(n, bool)  # a blank comes before, in the same text
        before_blank[1:] = blank[:-1]
        before_blank &= ~head
        before_space = np.zeros(n, bool)
        before_space[1:] = chars[:-1] == 0x20
        after_word = np.zeros(n, bool)  # a character that isn't blank follows, in the same text
        after_word[:-1] = ~blank[1:]
        after_word &= ~tail
        first = np.where(blank, ~before_blank | after_word, change & ~(before_blank & before_space))
        at = np.flatnonzero(first)
        return at, np.append(at[1:], n)

    def _join(self, text: str, chars, starts, ends, offsets) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        up, down = powers(len(chars) + 1)
        sums = np.zeros(len(chars) + 1, U64)
        np.cumsum(self.values[chars] * up[:-1], out=sums[1:])
        keys = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at, known = self._find(keys)
        if not known.all():
            new = first[~known]
            if len(self.keys) + len(new) > CACHE:
                self._forget()
                new = first
            self._learn(keys if len(new) == len(keys) else keys[~known], [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at, _ = self._find(keys)
        begin, sizes = self.begin[at], self.size[at]
        counts = sizes[inverse]
        done = np.cumsum(counts)
        at = np.repeat(begin[inverse] - (done - counts), counts)
        at += np.arange(len(at))
        edges = np.append(0, done)[np.searchsorted(starts, offsets)]
        return self.flat[at], np.diff(edges)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for a file."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = Encoder(path, special_as_text)
    return _encoders[path, special_as_text]


def public(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
