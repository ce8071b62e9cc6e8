"""Token ids of batches of texts, each distinct word of a batch encoded once."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

_CACHED_CHUNKS = 200_000
_CACHED_UNITS = 300_000
_SETTLED = "ɐ"
# The words of the vocabulary's own pattern, over characters below _SETTLED.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")
_SEGMENT_BYTES = 4 << 20
_LATIN, _TIMES, _LATIN_LOWER, _DIVIDE = 0xC3, 0x97, 0x9F, 0xB7
_BLANK, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)


def _byte_signs() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def _byte_kinds() -> np.ndarray:
    """What a byte is to the vocabulary's pattern; chunks with a byte of the last kind are left whole.

    0xC3 and the byte after it are one of the letters from U+00C0 on; the two signs among these are
    marked where they stand.
    """
    kinds = np.full(256, _SIGN, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = _BLANK
    kinds[[*range(65, 91), *range(97, 123)]] = _LETTER
    kinds[48:58] = _DIGIT
    kinds[192:] = kinds[ord("'")] = _WHOLE
    kinds[128:192] = kinds[_LATIN] = _LETTER
    return kinds


_BYTE_SIGNS, _KINDS = _byte_signs(), _byte_kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder(dict):
    """Token ids of chunks between blanks. Two generations of chunks are remembered: when the younger
    is full it becomes the older, and what is asked for again moves on.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its
    chunks in order. A chunk of letters and signs below U+0250, whose normal form and classes are
    settled, is cut into the vocabulary's words here and each new word goes to the tokenizer's
    model; every other chunk goes to the whole tokenizer.
    """

    def __init__(self, vocabulary: str | None, end_id: int):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary or default_vocabulary())
        self.model, self.words, self.older, self.older_words = self.tokenizer.model, {}, {}, {}
        self.code = "H" if max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "I"
        self.end = array(self.code, [end_id]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            if not chunk.isascii() and (max(chunk) >= _SETTLED or "İ" in chunk) or "<|" in chunk:
                found = array(self.code, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
            elif chunk.isalpha():
                found = self._word(chunk.lower())
            else:
                found = b"".join(map(self._word, _WORDS.findall(chunk.lower())))
        if len(self) >= _CACHED_CHUNKS:
            self.older = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def _word(self, word: str) -> bytes:
        found = self.words.get(word) or self.older_words.get(word)
        if found is None:
            signs = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_BYTE_SIGNS)
            found = array(self.code, [t.id for t in self.model.tokenize(signs)]).tobytes()
            if len(self.words) >= _CACHED_CHUNKS:
                self.older_words, self.words = self.words, {}
            self.words[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" "))) + self.end


class BatchEncoder:
    """Token ids of a column of texts, each text closed by ``end_id``.

    Bytes are classed and cut into words by array operations, in segments of bounded size that end at
    blanks, so a text of any length takes bounded memory besides its ids. A segment's distinct words
    go to the tokenizer's model, and their ids are gathered back. Chunks with apostrophes, characters
    beyond ASCII and the letters up to U+00FF, or the opening of a special token are units of their
    own, in the text's own case, and go to ``ChunkEncoder``.
    """

    def __init__(self, vocabulary: str | None, end_id: int):
        self.chunks = ChunkEncoder(vocabulary, end_id)
        self.kind = np.dtype(self.chunks.code)
        self.end_id = end_id
        self.units, self.older, self.tokenize = {}, {}, self.chunks.model.tokenize

    def _unit(self, unit: bytes, whole: bool) -> bytes:
        found = self.units.get(unit)
        if found is None:
            found = self.older.get(unit)
            if found is None:
                if whole:
                    found = self.chunks[unit.decode()]
                else:
                    signs = unit.decode() if unit.isalnum() else unit.decode("latin-1").translate(_BYTE_SIGNS)
                    found = array(self.chunks.code, [t.id for t in self.tokenize(signs)]).tobytes()
            if len(self.units) >= _CACHED_UNITS:
                self.older, self.units = self.units, {}
            self.units[unit] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after another, and their number per text (null is the end alone)."""
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        counts, found, at = np.zeros(len(texts), np.int64), [], int(offsets[0])
        while at < offsets[-1]:
            stop = self._segment_end(data, offsets, at)
            found.append(self._segment(data[at:stop], offsets - at, counts))
            at = stop
        out = np.empty(int(counts.sum()) + len(texts), self.kind)
        ends = np.cumsum(counts + 1) - 1
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner] = np.concatenate(found) if found else []
        out[ends] = self.end_id
        return out, counts + 1

    @staticmethod
    def _segment_end(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
        stop = at + _SEGMENT_BYTES
        if stop >= offsets[-1]:
            return int(offsets[-1])
        k = int(np.searchsorted(offsets, stop, "right"))
        blanks = np.flatnonzero(_KINDS[data[at:stop]] == _BLANK)
        cut = max(int(offsets[k - 1]), at + int(blanks[-1]) + 1 if len(blanks) else at)
        if cut > at:
            return cut
        blanks = np.flatnonzero(_KINDS[data[stop:offsets[k]]] == _BLANK)
        return stop + int(blanks[0]) + 1 if len(blanks) else int(offsets[k])

    def _segment(self, raw: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        kinds = _KINDS[raw]
        first, second = raw[:-1], raw[1:]
        latin = first == _LATIN
        kinds[:-1][(first == ord("<")) & (second == ord("|")) | latin & ((second == _TIMES) | (second == _DIVIDE))] = _WHOLE
        full = kinds != _BLANK
        fresh = np.ones(len(raw), bool)
        fresh[1:] = ~full[:-1]
        inside = (offsets >= 0) & (offsets < len(raw))
        fresh[offsets[inside]] = True
        fresh &= full
        chunk = np.cumsum(fresh, dtype=np.int32)
        whole = np.zeros(int(chunk[-1]) + 1, bool)
        whole[chunk[kinds == _WHOLE]] = True
        whole = whole[chunk]
        change = kinds == _DIGIT
        change[1:] |= kinds[1:] != kinds[:-1]
        starts = fresh | (full & change & ~whole)
        lower = _LOWER[raw]
        lower[1:][latin & (second < _LATIN_LOWER)] += 32
        kept = np.where(whole, raw, lower)[full]
        places = np.flatnonzero(starts)
        if not len(places):
            return np.zeros(0, self.kind)
        borders = np.append(np.flatnonzero(starts[full]), len(kept)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(borders), pa.py_buffer(kept)]).dictionary_encode()
        codes = units.indices.to_numpy()
        is_whole = np.zeros(len(units.dictionary), bool)
        is_whole[codes] = whole[places]
        ids = list(map(self._unit, units.dictionary.to_pylist(), is_whole.tolist()))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        firsts = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        before = np.concatenate([[0], np.cumsum(lengths)])
        counts += np.diff(before[np.searchsorted(places, offsets)])
        return np.frombuffer(b"".join(ids), self.kind)[np.repeat(firsts[codes] - before[:-1], lengths) + np.arange(before[-1])]
