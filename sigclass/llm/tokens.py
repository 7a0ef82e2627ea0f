"""Token ids of whole texts by a public byte-level BPE vocabulary.

Texts are cut into words where white space follows other characters: a byte-level BPE never
merges across such a place. The words of an Arrow batch of texts are dictionary-encoded, each
distinct one is encoded by the model of the ``tokenizers`` library (words of earlier batches are
remembered in flat arrays), and the texts' ids are gathered by the dictionary's indices. Texts with runs of
white space are cut one by one; those with white space beyond the ASCII kinds go through the library
whole, as there its runs may differ; so do texts that contain the string of an added token, which
the library takes out first.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECES = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+").findall
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]").search
#: Not for the way of whole batches: runs of white space, tabs, and in UTF-8 the characters of _OTHER_SPACE.
_ODD = (r"  |\n | \n|[\t\r\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e"
        r"|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xa4]|\xe3\x80\x80|\xef\xbb\xbf")
#: At most one space or line break, letters, then signs: pre-tokens of their own.
_LETTERS_SIGNS = re.compile("([ \n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\\[-`{-~]{0,8})").fullmatch
_BREAK = re.compile("[ \n\t\r]").search
#: Bytes of batches' words and their ids that an encoder remembers: about 800,000 words.
KNOWN_BYTES = 24 << 20
#: Stands before a text's first word, which has no space before it.
_FIRST = b"\x1f"
#: Characters whose UTF-8 forms have every byte that UTF-8 uses between them.
_ALL_BYTES = [*range(0x800), 0x800, *range(0x1000, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x40000), 0x100000]


def default_vocabulary() -> str:
    """The path of the public vocabulary file on the machine that calls it."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class _Memo(dict):
    """What ``make`` gives for a key, remembered for at least the ``size`` keys used last.

    Two generations: a full one becomes the old one, whose entries come back when they are used,
    so that frequent keys are not forgotten and at most 2 * ``size`` are held."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Known:
    """Words of batches and their ids, in flat arrays: some 30 bytes a word, a tenth of a dictionary's entry.

    ``make`` gives the ids of a word. Beyond ``max_bytes`` all are forgotten before the next batch."""

    def __init__(self, make, max_bytes: int):
        self.make, self.max_bytes = make, max_bytes
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.ids, self.ends = np.empty(0, "<u4"), np.empty(0, np.int64)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.ends.nbytes

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of the distinct words stands in ``words``, ``ends`` and (up to its end) ``ids``."""
        if self.nbytes > self.max_bytes:
            self.clear()
        found = pc.index_in(words, value_set=self.words)
        new = found.is_null().to_numpy(zero_copy_only=False)
        places = found.fill_null(0).to_numpy().astype(np.int64)
        if new.any():
            fresh = words.filter(pa.array(new))
            made = list(map(self.make, fresh.to_pylist()))
            places[new] = len(self.words) + np.arange(len(made))
            sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
            self.ends = np.append(self.ends, len(self.ids) + np.cumsum(sizes))
            self.ids = np.append(self.ids, np.frombuffer(b"".join(made), "<u4"))
            self.words = pa.concat_arrays([self.words, fresh])
        return places


class Encoder:
    """Maps texts to their ids (unsigned 32-bit, little-endian).

    ``vocabulary`` is the path of a tokenizer file; None takes ``default_vocabulary()`` where it
    runs. At most ``max_pieces`` words of single texts and parts of words are remembered, and ``KNOWN_BYTES`` of
    batches' words (and those of one batch more); forgetting changes no result.
    """

    def __init__(self, vocabulary: str | None = None, max_pieces: int = 1_000_000):
        import tokenizers
        self.tokenizer = tokenizers.Tokenizer.from_file(vocabulary or default_vocabulary())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # the memo takes its place
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # the byte-level alphabet, read off the library: the character that stands for each byte
        self.alphabet = {}
        for c in map(chr, _ALL_BYTES):
            self.alphabet.update(zip(c.encode(), self.split(c)[0][0]))
        #: A word (UTF-8) and its ids: with a space before it, unless it begins with a line break or _FIRST.
        self.words = _Memo(self._word, max(1, max_pieces // 2))
        self.known = _Known(self._word, KNOWN_BYTES)

    def __len__(self) -> int:
        return len(self.words) + len(self.words.old)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _model(self, part: str) -> bytes:
        """The ids of one pre-token."""
        ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        plain = _LETTERS_SIGNS(piece)
        if not plain:  # the library cuts it, already in its alphabet
            ids = [t.id for p, _ in self.split(piece) for t in self.model.tokenize(p)]
            return struct.pack(f"<{len(ids)}I", *ids)
        before, letters, signs = plain.groups()
        if before == "\n":
            found = self.words[b"\n"] + self._model(letters)
        elif signs and before:
            found = self.words[letters.encode()]
        else:
            found = self._model(before + letters)
        return found + self.words[_FIRST + signs.encode()] if signs else found

    def _word(self, word: bytes) -> bytes:
        if word[:1] == _FIRST:
            return self._piece(word[1:].decode("utf-8", "replace"))
        return self._piece(word.decode("utf-8", "replace") if word[:1] == b"\n" else " " + word.decode("utf-8", "replace"))

    def ids(self, text: str) -> bytes:
        """The ids of a text."""
        if not text:
            return b""
        if _OTHER_SPACE(text) or any(x in text for x in self.added):
            return self.whole(text)
        return b"".join(self.words[p[1:].encode()] if p[0] == " " and not _BREAK(p, 1) else self._piece(p)
                        for p in _PIECES(text))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts (UTF-8; null counts as empty), one after another, and the
        place in them where each text ends."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        odd = pc.match_substring_regex(texts, _ODD)
        for x in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        plain = pc.replace_substring_regex(texts.filter(pc.invert(odd)), r"(\n+)", r" \1")
        first, nothing = pa.scalar(_FIRST, pa.large_binary()), pa.scalar(b"", pa.large_binary())
        words = pc.split_pattern(pc.binary_join_element_wise(first, plain, nothing), b" ")
        cells = words.flatten().dictionary_encode()
        known, index = self.known.places(cells.dictionary), cells.indices.to_numpy()
        sizes = np.diff(self.known.ends, prepend=0)
        n = sizes[known][index]
        ends = np.cumsum(n)
        starts = (self.known.ends - sizes)[known][index]
        ids = self.known.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - n), n)]
        word_ends = np.diff(words.offsets.to_numpy()).cumsum()
        text_ends = np.append(0, ends)[word_ends]
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return ids, text_ends
        others = [self.ids(t.decode("utf-8", "replace")) for t in texts.filter(pa.array(odd)).to_pylist()]
        lengths = np.empty(len(odd), np.int64)
        lengths[~odd] = np.diff(text_ends, prepend=0)
        lengths[odd] = [len(x) // 4 for x in others]
        out, mine = np.empty(lengths.sum(), "<u4"), np.repeat(odd, lengths)
        out[~mine], out[mine] = ids, np.frombuffer(b"".join(others), "<u4")
        return out, lengths.cumsum()


_ENCODERS: dict = {}


def slices(batch: pa.RecordBatch, max_bytes: int = 16 << 20):
    """Parts of a batch with (doc_id, text) whose texts have about ``max_bytes`` at most (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encoder(vocabulary: str | None = None, max_pieces: int = 1_000_000) -> Encoder:
    """One encoder for each vocabulary, number of remembered words and Python worker."""
    key = vocabulary, max_pieces
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, max_pieces)
    return _ENCODERS[key]
