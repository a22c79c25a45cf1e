"""Ids of a BPE that drops white space: a text is cut where its tokens can't reach across, each distinct part encoded once.

No token and no step of the normaliser reaches across white space, nor, between plain characters, from letters to digits
or marks. Cuts are found in bytes by numpy, an Arrow dictionary finds equal parts, and numpy puts the ids together. A
word with an apostrophe, a control character or characters beyond Latin letters is one part, cut by the tokenizer's own rule or
left to the library; a tokenizer with other settings encodes whole texts. ``tests/llm/test_word_tokens.py`` holds this
against ``encode`` on whole texts.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

from emberlog.llm.tokens import CACHED_PIECES, Encoded, _byte_alphabet, _Cache

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: The rule by which the tokenizer cuts pieces; fixed, as ids depend on it.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = regex.compile(RULE)
#: Kinds of bytes: white space, letters (the bytes of U+00C0 to U+017F too), digits, marks, and what needs the whole word.
_SPACE, _LETTER, _DIGIT, _MARK, _WHOLE = range(5)
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*b" \t\n\v\f\r"]] = _SPACE
_KIND[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
_KIND[[*b"0123456789"]] = _DIGIT
_KIND[ord("'")] = _WHOLE
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32
#: Characters that only the library's own tables classify, compose and make small.
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xadɐ-\U0010ffff]")


def cuts_at_spaces(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer has RULE, drops white space and normalises character by character."""
    if any(getattr(tokenizer, k) is not None for k in ("truncation", "padding", "post_processor")) or not isinstance(tokenizer.model, BPE) or tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return False
    given, cut, model = json.loads(tokenizer.normalizer.__getstate__()), json.loads(tokenizer.pre_tokenizer.__getstate__()), tokenizer.model
    steps, cuts = given.get("normalizers", []), cut.get("pretokenizers", [])
    small = [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
    split = len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": RULE} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
    level = len(cuts) == 2 and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex", True)
    return small and split and level and not any((model.dropout, model.continuing_subword_prefix, model.byte_fallback))


class WordEncoder:
    """Ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False)``; strings of special tokens
    are ordinary text."""

    def __init__(self, path: str = WORD_TOKENIZER):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cuts = cuts_at_spaces(self.tokenizer) and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self.parts = _Cache(self._part, 2 * CACHED_PIECES)

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]

    def _part(self, part: str) -> bytes:
        """Packed ids of a part, as if nothing stood before or after it."""
        if part.isascii() and part.isalpha():
            return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()
        if _ODD.search(part):
            return self._whole(part)
        return array("I", [i for piece in _PIECE.findall(part.lower()) for i in self._piece(piece)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_batch(self, texts: pa.Array, end: bytes = b"") -> Encoded:
        """Encode an Arrow string array without nulls; ``end``, packed ids, follows each text's own."""
        if not self.cuts:
            packed = [self._whole(t) + end for t in texts.to_pylist()]
            return Encoded(np.frombuffer(b"".join(packed), np.uint32), np.cumsum([len(p) // 4 for p in packed], dtype=np.int64), None)
        bounds = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        raw = np.frombuffer(held if held is not None else b"", np.uint8)[bounds[0] : bounds[-1]] if len(texts) else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        parts, text = _cut(raw, bounds)
        words = parts.dictionary_encode()
        packed = [*map(self.parts.__getitem__, words.dictionary.to_pylist()), end]
        # The end of a text is one more part after its own.
        last = np.searchsorted(text, np.arange(len(texts)), "right")
        codes = np.insert(words.indices.to_numpy().astype(np.int64), last, len(packed) - 1)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts, counts = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.cumsum(counts)
        taken = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
        return Encoded(np.frombuffer(b"".join(packed), np.uint32)[taken], ends[last + np.arange(len(texts))] if len(texts) else ends, None)


def _cut(raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Parts of texts that lie end to end, lower-cased in ASCII, and the text of each."""
    kind = _KIND[raw]
    before = np.empty_like(kind)
    before[1:], before[:1] = kind[:-1], _SPACE
    before[bounds[:-1][bounds[:-1] < len(raw)]] = _SPACE
    inside = kind != _SPACE
    fresh = inside & (before == _SPACE)  # first bytes of words
    begins = np.flatnonzero(inside & ((kind != before) | (kind == _DIGIT)))
    whole = kind == _WHOLE
    # The two marks among the Latin letters, and the letter whose small form has a mark of its own.
    whole[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (raw[:-1] == 0xC4) & (raw[1:] == 0xB0)
    if whole.any():
        first = np.flatnonzero(fresh)
        odd = np.zeros(len(first), bool)
        odd[np.searchsorted(first, np.flatnonzero(whole), "right") - 1] = True
        begins = begins[fresh[begins] | ~odd[np.searchsorted(first, begins, "right") - 1]]
    # A part ends where the next begins, or at white space, which isn't copied.
    places = np.concatenate([np.cumsum(inside)[begins] - 1, [np.count_nonzero(inside)]]).astype(np.int32) if len(begins) else np.zeros(1, np.int32)
    data = pa.StringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(_SMALL[raw[inside]]))
    return data, np.searchsorted(bounds, begins, "right") - 1


@lru_cache(maxsize=2)
def word_encoder(path: str = WORD_TOKENIZER) -> WordEncoder:
    """The Python worker's own encoder, with the pieces that earlier tasks have met."""
    return WordEncoder(path)
