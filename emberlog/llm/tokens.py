"""Byte-level BPE inside Spark tasks.

A byte-level BPE never merges across the pieces its pre-tokenizer cuts, so a text's ids are the ids of its pieces put
end to end. Pieces repeat far more often than texts do: numpy cuts the bytes of a batch into them, Arrow finds equal ones, each
distinct one is encoded once with the ``tokenizers`` library, and numpy puts the ids together. With offsets, a batch is
split at spaces instead. A tokenizer that works otherwise encodes whole texts. ``tests/llm/test_tokens.py`` holds this against ``encode`` on whole texts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: The cut rule of the byte-level pre-tokenizer; fixed, as ids depend on it.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A single space between two other characters always begins a piece.
_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: Pieces in each of a cache's two generations; they bound a worker's memory (about 200 bytes a piece).
CACHED_PIECES = 80_000
#: Texts are taken together up to so many bytes; a longer one is taken alone.
SLAB_BYTES = 3 << 20
#: From this character on the library's own tables of Unicode classes decide where pieces are cut.
PLAIN_BELOW = "ɐ"


#: Parts that repeat, whose ids a worker keeps, and their longest in bytes.
KEPT_PARTS, KEPT_BYTES = 200_000, 64
#: Kinds of bytes: white space, letters (the bytes of U+00C0 to U+017F too), digits, marks, and what needs the whole word.
_SPACE_BYTE, _LETTER, _DIGIT, _MARK, _WHOLE = range(5)
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*b" \t\n\v\f\r"]] = _SPACE_BYTE
_KIND[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
_KIND[[*b"0123456789"]] = _DIGIT
_KIND[ord("'")] = _WHOLE
#: White space beyond ASCII.
_FAR_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_FAR_BYTES = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


def _byte_alphabet() -> dict[int, int]:
    """Byte value -> code point: printable Latin-1 stands for itself, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(kept))}


def cuts_at_pieces(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer is a byte-level BPE that PIECE alone cuts and that keeps offsets as they are."""
    plain = all(getattr(tokenizer, k) is None for k in ("normalizer", "truncation", "padding", "post_processor"))
    if not plain or tokenizer.pre_tokenizer is None or not isinstance(tokenizer.model, BPE):
        return False
    cut, model = json.loads(tokenizer.pre_tokenizer.__getstate__()), tokenizer.model
    level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    return level and not any((model.dropout, model.continuing_subword_prefix, model.end_of_word_suffix, model.byte_fallback))


def _cut(raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Texts that lie end to end cut into parts, and the text of each: a part is a piece of the rule, a word with what
    needs the rule itself, or a text with white space beyond ASCII."""
    kind, n = _KIND[raw], len(raw)
    start = np.zeros(n + 1, bool)
    start[bounds[:-1]] = True
    start = start[:n]
    space = kind == _SPACE_BYTE
    after, other, wide = np.zeros(n, bool), np.ones(n, bool), np.zeros(n, bool)
    after[1:], other[1:], wide[1:] = space[:-1], kind[1:] != kind[:-1], raw[:-1] != 32
    # The last of some white space is a piece, or begins one if it's a space; at a text's end it belongs to those before.
    last = np.zeros(n, bool)
    last[:-1] = ~space[1:] & ~start[1:]
    cut = start | np.where(space, ~after | last, np.where(after, wide, other))
    whole = kind == _WHOLE
    # The two marks among the Latin letters.
    whole[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    if whole.any():
        first = np.flatnonzero(~space & (after | start))
        odd = np.zeros(len(first), bool)
        odd[np.searchsorted(first, np.flatnonzero(whole), "right") - 1] = True
        inner = np.flatnonzero(cut & ~space & ~after & ~start)
        cut[inner[odd[np.searchsorted(first, inner, "right") - 1]]] = False
        for i in {int(np.searchsorted(bounds, m.start(), "right")) - 1 for m in _FAR_BYTES.finditer(raw)}:
            cut[bounds[i] + 1 : bounds[i + 1]] = False
    begins = np.flatnonzero(cut)
    parts = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, n).astype(np.int32)), pa.py_buffer(raw))
    return parts, np.searchsorted(bounds, begins, "right") - 1


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs, one after another: ``counts`` places from each of ``starts``."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class _Cache(dict):
    """Key -> ``make(key)``. When full, it begins anew and takes over what is asked for again from the entries before."""

    def __init__(self, make, entries: int):
        self.make, self.entries, self.before = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.entries:
            self.before = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoded(NamedTuple):
    """Ids of several texts end to end, where each text's ids end, and each token's first character, if asked for."""

    ids: np.ndarray
    ends: np.ndarray
    chars: np.ndarray | None


class Encoder:
    """Ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False)``.

    Strings of special tokens are ordinary text. With ``offsets``, also the index of the character that holds each token's first byte.
    """

    def __init__(self, path: str = DEFAULT_TOKENIZER, offsets: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cuts = cuts_at_pieces(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.special]
        self.model, self.alphabet, self.offsets = self.tokenizer.model, _byte_alphabet(), offsets
        #: Piece -> its ids (and offsets) packed as unsigned 32-bit values.
        self.pieces = _Cache(self._piece, CACHED_PIECES)
        self.width = 8 if offsets else 4
        #: Parts that were met twice in a batch, where the ids of each begin in ``kept_ids``, and how many it has.
        self.kept, self.kept_ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.kept_starts = self.kept_counts = np.zeros(0, np.int64)

    def _piece(self, piece: str) -> bytes:
        """Encode one piece of the pre-tokenizer's, or a chunk that only the library can cut."""
        plain = piece.isascii() and piece.isprintable()
        if plain and not self.offsets:
            return array("I", [t.id for t in self.model.tokenize(piece.replace(" ", "\u0120"))]).tobytes()
        if not piece.isascii() and max(piece) >= PLAIN_BELOW:
            return self._whole(piece)
        raw = piece.encode()
        tokens = self.model.tokenize(piece.replace(" ", "\u0120") if plain else raw.decode("latin-1").translate(self.alphabet))
        if not self.offsets:
            return array("I", [t.id for t in tokens]).tobytes()
        holds = range(len(raw)) if len(raw) == len(piece) else [i for i, c in enumerate(piece) for _ in c.encode()]
        at, pairs = 0, array("I")
        for t in tokens:
            pairs.append(t.id)
            pairs.append(holds[at])
            at += len(t.value)
        return pairs.tobytes()

    def _whole(self, text: str) -> bytes:
        got = self.tokenizer.encode(text, add_special_tokens=False)
        if self.offsets:
            return array("I", [x for i, (a, _) in zip(got.ids, got.offsets) for x in (i, a)]).tobytes()
        return array("I", got.ids).tobytes()

    def _joined(self, parts: list[str], packed) -> bytes:
        if not self.offsets:
            return b"".join(packed)
        at, out = 0, []
        for part, own in zip(parts, packed):
            pairs = np.frombuffer(own, np.uint32).copy()
            pairs[1::2] += np.uint32(at)
            out.append(pairs.tobytes())
            at += len(part)
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """Encode ``text`` as if nothing stood before or after it."""
        if not text:
            return b""
        if not text.isascii() and max(text) >= PLAIN_BELOW:
            return self._whole(text)
        pieces = PIECE.findall(text)
        return self._joined(pieces, map(self.pieces.__getitem__, pieces))

    def _uneven(self, text: str) -> bytes:
        """Encode a text that has other white space beside single spaces, cut where a single space is sure to begin a piece."""
        parts = _SPACE.split(text)
        return self._joined(parts, map(self.packed, parts))

    def _chunks(self, chunks: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Encode chunks with the space before each: packed values, where each chunk's begin, how many it has, and (with
        offsets) where each value's piece begins in its chunk.

        What is empty, or begins or ends with white space, isn't sure to be cut there and has no values.
        """
        # What is its own stripped form neither begins nor ends with white space.
        even = [c != "" and c.strip() == c for c in chunks]
        plain = [e and (c.isascii() or max(c) < PLAIN_BELOW) for e, c in zip(even, chunks)]
        pieces = PIECE.findall(" " + " ".join(c for c, p in zip(chunks, plain) if p)) if any(plain) else []
        first = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        packed = [*map(self.pieces.__getitem__, pieces)]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        counts = np.zeros(len(chunks), np.int64)
        counts[np.flatnonzero(plain)] = np.add.reduceat(sizes, first) if len(first) else 0
        begins = np.zeros(0, np.int64)
        if self.offsets:  # where a token's piece begins in its chunk
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            at = np.cumsum(lengths) - lengths
            begins = np.repeat(at - np.repeat(at[first], np.diff(np.append(first, len(pieces)))), sizes)
        starts = np.zeros(len(chunks), np.int64)
        starts[np.flatnonzero(plain)] = np.cumsum(counts[plain]) - counts[plain]
        rest, end = [], int(sizes.sum())
        for i in np.flatnonzero(np.array(even, bool) & ~np.array(plain, bool)).tolist():
            rest.append(self.pieces[" " + chunks[i]])
            starts[i], counts[i] = end, len(rest[-1]) // self.width
            end += counts[i]
        return b"".join(packed + rest), starts, counts, np.concatenate([begins, np.zeros((end - len(begins)) * self.offsets, np.int64)])

    def _part(self, part: str) -> bytes:
        """Encode a part that bytes were cut to."""
        if part.isascii() and part.isprintable() and "'" not in part:
            return self._piece(part)
        return self._uneven(part) if _FAR_SPACE.search(part) else self.packed(part)

    def _keep(self, parts: pa.Array, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Keep the ids of ``parts``; when there are too many, those kept before are dropped."""
        parts, starts, counts = parts[:KEPT_PARTS], starts[:KEPT_PARTS], counts[:KEPT_PARTS]
        if len(self.kept) + len(parts) > KEPT_PARTS:
            self.kept, self.kept_ids, self.kept_starts, self.kept_counts = self.kept[:0], self.kept_ids[:0], self.kept_starts[:0], self.kept_counts[:0]
        self.kept = pa.concat_arrays([self.kept, parts])
        self.kept_starts = np.append(self.kept_starts, len(self.kept_ids) + np.cumsum(counts) - counts)
        self.kept_counts = np.append(self.kept_counts, counts)
        self.kept_ids = np.append(self.kept_ids, ids[_spread(starts, counts)])

    def _by_parts(self, texts: pa.Array, end: bytes) -> Encoded:
        """Encode texts that are cut in bytes: Arrow finds equal parts, each is encoded once, and those that repeat are kept."""
        bounds = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        raw = np.frombuffer(held if held is not None else b"", np.uint8)[bounds[0] : bounds[-1]]
        parts, text = _cut(raw, bounds - bounds[0])
        words = parts.dictionary_encode()
        distinct, codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
        at = pc.fill_null(pc.index_in(distinct, value_set=self.kept), -1).to_numpy()
        fresh = np.flatnonzero(at < 0)
        packed = [*map(self._part, distinct.take(pa.array(fresh)).to_pylist()), end]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        # The end of a text is one more part.
        starts, counts = np.empty(len(distinct) + 1, np.int64), np.empty(len(distinct) + 1, np.int64)
        starts[:-1][at >= 0], counts[:-1][at >= 0] = self.kept_starts[at[at >= 0]], self.kept_counts[at[at >= 0]]
        own = np.append(fresh, len(distinct))
        starts[own], counts[own] = len(self.kept_ids) + np.cumsum(sizes) - sizes, sizes
        ids = np.concatenate([self.kept_ids, np.frombuffer(b"".join(packed), np.uint32)])
        again = fresh[(np.bincount(codes, minlength=len(distinct))[fresh] > 1) & (pc.binary_length(distinct).to_numpy()[fresh] <= KEPT_BYTES)]
        self._keep(distinct.take(pa.array(again)), starts[again], counts[again], ids)
        last = np.searchsorted(text, np.arange(len(texts)), "right")
        codes = np.insert(codes, last, len(distinct))
        ends = np.cumsum(counts[codes])[last + np.arange(len(texts))]
        return Encoded(ids[_spread(starts[codes], counts[codes])], ends, None)

    def encode_batch(self, texts: pa.Array, end: bytes = b"") -> Encoded:
        """Encode an Arrow string array without nulls; ``end``, packed ids, follows each text's own (not with offsets)."""
        if self.cuts and len(texts) and not self.offsets and not self.added:
            return self._by_parts(texts, end)
        split = pc.split_pattern(texts, " ")
        bounds, flat = split.offsets.to_numpy().astype(np.int64), split.flatten()
        begin, last = bounds[:-1], bounds[1:] - 1
        words = flat.dictionary_encode()
        codes = words.indices.to_numpy()
        inner = np.ones(len(codes), bool)
        inner[begin] = inner[last] = False
        asked = np.zeros(len(words.dictionary), bool)
        asked[codes[inner]] = True
        own = np.flatnonzero(asked)
        data, starts, counts, within = self._chunks(words.dictionary.take(pa.array(own)).to_numpy(zero_copy_only=False).tolist())
        nth = np.zeros(len(asked), np.int64)
        nth[own] = np.arange(len(own))
        at = nth[codes]
        # Texts that single spaces don't cut safely, and those that only the library as a whole encodes.
        uneven = np.zeros(len(texts), bool)
        uneven[np.searchsorted(bounds, np.flatnonzero(inner)[counts[at[inner]] == 0], "right") - 1] = True
        whole = np.full(len(texts), not self.cuts)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        n, more = len(own), [b""]
        heads, tails = (flat.take(pa.array(x)).to_numpy(zero_copy_only=False).tolist() for x in (begin, last))
        for i, (head, tail, a, b) in enumerate(zip(heads, tails, begin.tolist(), last.tolist())):
            if whole[i] or uneven[i] or b > a and (not tail or tail[0].isspace() or head[-1:].isspace()):
                text = texts[i].as_py()
                at[a : b + 1] = n
                at[a] = n + len(more)
                more.append((self._whole(text) if whole[i] else self._uneven(text)) + end)
                continue
            at[a] = n + len(more)
            more.append(self.packed(head) + (b"" if b > a else end))
            if b > a:
                at[b] = n + len(more)
                more.append(self.packed(" " + tail) + end)
        extra = np.fromiter(map(len, more), np.int64, len(more)) // self.width
        starts = np.concatenate([starts, len(data) // self.width + np.cumsum(extra) - extra])
        counts = np.concatenate([counts, extra])[at]
        ends = np.cumsum(counts)
        taken = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - counts), counts)
        held = np.frombuffer(data + b"".join(more), np.uint32)
        stops = ends[last] if len(ends) else np.zeros(0, np.int64)
        if not self.offsets:
            return Encoded(held[taken], stops, None)
        pairs = held.reshape(-1, 2)
        inside = pairs[:, 1].astype(np.int64)
        inside[: len(within)] += within
        # A chunk is encoded with the space before it; what stands for the head or for a whole text begins at its text.
        chars = pc.utf8_length(flat).to_numpy().astype(np.int64) + 1
        places = np.cumsum(chars) - chars
        places -= np.repeat(places[begin], np.diff(bounds)) + 1
        places[begin] = 0
        return Encoded(pairs[taken, 0], stops, inside[taken] + np.repeat(places, counts))

    def encode(self, text: str) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        """Ids of one text, or (ids, characters)."""
        got = self.encode_batch(pa.array([text], pa.string()))
        return (got.ids, got.chars) if self.offsets else got.ids


@lru_cache(maxsize=2)
def encoder(path: str = DEFAULT_TOKENIZER, offsets: bool = False) -> Encoder:
    """The Python worker's own encoder: a worker serves many tasks, and each finds the entries of those before it."""
    return Encoder(path, offsets)


def slabs(column: pa.Array, most: int = SLAB_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """A string column in slices of about ``most`` bytes, null as the empty text: (place of the first, texts)."""
    texts = pc.fill_null(column, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and held + n > most:
            yield begin, texts.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, texts.slice(begin)


def texts_of(column: pa.Array | pa.ChunkedArray):
    """The texts of an Arrow column one at a time, null as the empty text."""
    for x in column:
        yield x.as_py() or ""
