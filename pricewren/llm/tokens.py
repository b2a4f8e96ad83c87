"""Token ids of whole texts by the `tokenizers` library.

Where a tokenizer's rules show that no token spans a space or line feed, and that the pieces between them don't influence each other
(`SPACED`), each distinct piece is encoded once and remembered; otherwise texts are encoded whole. The ids are those of encoding the text.
"""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bounds of what a worker remembers.
PIECES, WORDS = 200_000, 100_000
#: Texts are cut into runs of about so many bytes; the encoder takes shorter ones, for it needs some 50 times their size while it learns.
RUN_BYTES, ENCODED_BYTES = 3 << 20, 1 << 20
#: Pre-tokenizer patterns whose matches hold no white space.
SPACED = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",)
#: Words of Latin-1 letters, and marks that may stand behind them; no mark here starts a special token or a contraction.
_LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªµº")
_MARKS = "!#$%&*+,./:;=?@^|~)\""


def _byte_letters() -> str:
    """For each byte but the space, the character that stands for it in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)} | {32: " "}
    return "".join(letter[b] for b in range(256))


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = (rules.get("normalizer") or {}).get("normalizers", [])
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.spaced = (
            [(s["type"], s.get("pattern", {}).get("Regex"), s.get("content")) for s in steps] == [("NFC", None, None), ("Replace", "\\s+", " "), ("Lowercase", None, None)]
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"].get("Regex") in SPACED
            and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
            and not splits[1]["add_prefix_space"]
            and rules["model"].get("end_of_word_suffix") == "</w>"
        )
        if self.spaced:
            self.words = Tokenizer.from_file(path)  # for words of small letters, as which they are already split and normalised
            self.words.normalizer = None
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            self.letters = _byte_letters()
            self.marks: dict[str, bytes] = {"": b""}
            self.pieces: dict[str, bytes] = {"": b""}
            self.known: dict[str, bytes] = {}

    def _plainly(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """Encode words of small Latin letters, all in one text."""
        letters, _ = codecs.charmap_decode(" ".join(words).encode(), "strict", self.letters)
        ids = np.array(self.words.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            self.known.update(zip(words, self._plainly(words), strict=True))
            return
        data, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
        self.known.update(zip(words, [data[a:b] for a, b in zip(bounds, bounds[1:])], strict=True))

    def _learn(self, new: pa.Array) -> list[bytes]:
        """Encode distinct pieces and remember them."""
        if len(self.pieces) + len(new) > PIECES:
            self.pieces = {"": b""}
        if len(self.marks) > PIECES:
            self.marks = {"": b""}
        stems, marks = pc.utf8_rtrim(new, characters=_MARKS), pc.utf8_ltrim(new, characters=_LETTERS)
        # A word and marks, if both together are the whole piece.
        plain = pc.equal(pc.add(pc.binary_length(stems), pc.binary_length(marks)), pc.binary_length(new))
        plain = pc.and_(plain, pc.greater(pc.binary_length(stems), 0)).to_numpy(zero_copy_only=False)
        at = pa.array(np.flatnonzero(plain))
        stems, marks = pc.utf8_lower(stems.take(at)).dictionary_encode(), marks.take(at).dictionary_encode()
        words, ends = _strings(stems.dictionary), _strings(marks.dictionary)
        if len(self.known) + len(words) > WORDS:
            self.known.clear()
        if unknown := [w for w in words if w not in self.known]:
            self._learn_words(unknown)
        if unknown := [m for m in ends if m not in self.marks]:
            self.marks.update(zip(unknown, self._plainly(unknown), strict=True))
        words, ends = [self.known[w] for w in words], [self.marks[m] for m in ends]
        out = np.empty(len(new), dtype=object)
        out[plain] = [words[i] + ends[j] for i, j in zip(stems.indices.to_numpy().tolist(), marks.indices.to_numpy().tolist(), strict=True)]
        if other := _strings(new.take(pa.array(np.flatnonzero(~plain)))):
            out[~plain] = self._plainly(other)
        found = out.tolist()
        self.pieces.update(zip(_strings(new), found, strict=True))
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: empty) as little-endian unsigned 32-bit numbers."""
        texts = pc.fill_null(texts, "")
        if not self.spaced:
            return self._plainly(texts.to_pylist())
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        found = [*map(self.pieces.get, _strings(coded.dictionary))]
        if gaps := [i for i, x in enumerate(found) if x is None]:
            for i, x in zip(gaps, self._learn(coded.dictionary.take(pa.array(gaps))), strict=True):
                found[i] = x
        # The ids of all pieces one behind the other: those of each kind are copied to where its pieces stand.
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        firsts = np.cumsum(sizes) - sizes
        kind = coded.indices.to_numpy()
        size = sizes[kind]
        ends = np.cumsum(size)
        flat = ids[np.repeat(firsts[kind] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()].tolist()
        return [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def slices(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows of about `size` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        n = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) - at
        n = max(1, min(n, len(ends) - at))
        yield at, n
        at += n


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)
