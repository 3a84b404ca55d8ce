"""Token ids of whole texts from a public tokenizer file, each distinct piece encoded once.

For tokenizers that lower-case, drop white space, and cut words into runs of letters, single
digits and runs of signs, a text's ids are those of its pieces one after the other. Words of
plain letters, digits and signs are cut here, with numpy; any other word (apostrophes, special
tokens, other scripts, controls) goes to the tokenizer whole. Pieces are told apart by
64-bit hashes; the ids of the pieces seen are held by the Python process in sorted arrays, up to ``HELD_BYTES``.
"""

from __future__ import annotations

from array import array

import numpy as np
from tokenizers import Tokenizer

from .words import Texts, keep_only, process_cache, span_hashes, words, _IN_WORD, _LOWER

HELD_BYTES = 24 << 20
SPACE, LETTER, DIGIT, SIGN, WHOLE = range(5)

_KIND = np.full(256, WHOLE, dtype=np.uint8)
_KIND[33:127] = SIGN
_KIND[97:123] = _KIND[65:91] = LETTER
_KIND[48:58] = DIGIT
_KIND[[ord("'"), ord("<")]] = WHOLE
_KIND[~_IN_WORD] = SPACE
_LATIN = 0xC3  # first byte of the Latin letters from U+00C0 to U+00FF, but for two signs among them


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    names = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [names[b] for b in range(256)]


def _cut(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (lower-cased where plain), starts, ends and kinds of the pieces, and their number per text."""
    raw = texts.data
    data, kind = _LOWER[raw], _KIND[raw]
    lead = np.flatnonzero((raw[:-1] == _LATIN) & (raw[1:] != 0x97) & (raw[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = LETTER
    upper = lead[data[lead + 1] < 0x9F] + 1
    data[upper] += 0x20
    # A word with any other byte stays whole, as it was written.
    found = words(texts, lower=False)
    odd = np.concatenate([[0], np.cumsum(kind == WHOLE)])
    whole = np.flatnonzero(odd[found.ends] > odd[found.starts])
    if len(whole):
        edge = np.zeros(len(raw) + 1, dtype=np.int8)
        edge[found.starts[whole]] += 1
        edge[found.ends[whole]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        kind[inside] = WHOLE
        data[inside] = raw[inside]
    begin = np.ones(len(raw), dtype=bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begin[texts.offsets[:-1][texts.offsets[:-1] < len(raw)]] = True
    edges = np.append(np.flatnonzero(begin), len(raw))
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] != SPACE
    starts, ends = starts[real], ends[real]
    return data, starts, ends, kind[starts], np.diff(np.searchsorted(starts, texts.offsets))


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self._forget()

    def _forget(self) -> None:
        """An empty table of pieces: sorted hashes, and where the ids of each begin and how many they are."""
        self.hashes, self.begins = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.sizes, self.ids = np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.uint32)

    @property
    def held(self) -> int:
        return self.hashes.nbytes + self.begins.nbytes + self.sizes.nbytes + self.ids.nbytes

    def _piece(self, piece: bytes, kind: int) -> bytes:
        """Ids of one piece as 32-bit numbers."""
        if kind == WHOLE:
            return array("I", self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids).tobytes()
        spelled = piece.decode("ascii") if piece.isascii() else piece.decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted hashes stand, or belong, in the table; which are in it."""
        place = np.searchsorted(self.hashes, hashes)
        there = np.append(self.hashes, np.uint64(0))[place] == hashes
        return place, there & (place < len(self.hashes))

    def _learn(self, place: np.ndarray, hashes: np.ndarray, pieces: list[bytes]) -> None:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        self.begins = np.insert(self.begins, place, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, place, sizes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(pieces), np.uint32)])

    def encode(self, texts: Texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and how many each text has; ``end`` closes every text."""
        data, starts, ends, kinds, counts = _cut(texts)
        hashes = span_hashes(data, starts, ends) ^ (kinds == WHOLE).astype(np.uint64)
        hashes, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.held > HELD_BYTES:
            self._forget()
        place, there = self._places(hashes)
        new = np.flatnonzero(~there)
        if len(new):
            body, first = data.tobytes(), at[new]
            self._learn(place[new], hashes[new], [
                self._piece(body[s:e], kind)
                for s, e, kind in zip(starts[first].tolist(), ends[first].tolist(), kinds[first].tolist())])
            place, _ = self._places(hashes)
        # The end id is one more piece of every text.
        sizes = np.append(self.sizes[place], 0 if end is None else 1)
        begins = np.append(self.begins[place], 0)
        order = np.insert(back, np.cumsum(counts), len(hashes))
        take = sizes[order]
        upto = np.cumsum(take)
        flat = np.repeat(begins[order] - (upto - take), take)
        flat += np.arange(len(flat))
        flat = self.ids[flat]
        last = np.cumsum(counts + 1) - 1
        if end is not None:
            flat[upto[last] - 1] = end
        return flat, np.diff(upto[last], prepend=0)


def encoder(path: str) -> WordEncoder:
    keep_only("tokenizer", "encoder")
    cache = process_cache()
    if cache.get("tokenizer") != path:
        cache["tokenizer"], cache["encoder"] = path, WordEncoder(path)
    return cache["encoder"]
