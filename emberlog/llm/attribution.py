"""Token counts of fields and sections from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.tokens import DEFAULT_TOKENIZER, encoder, slabs, texts_of

#: Who gets a token that lies in several sections: the one that holds its first character, the one that holds its last,
#: or the one that holds most of its characters (the earlier one of equals).
RULES = ("first", "last", "most")
#: Sections of one output batch.
BATCH_ROWS = 100_000


def owners(begins: np.ndarray, length: int, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Merge token spans with section spans, both in order and gapless: (section of each token, whether it crosses a boundary).

    A token spans from its first byte's character up to the next token's, and one character at least; sections end at
    ``ends`` (exclusive), and no character is in none.
    """
    stops = np.maximum(np.append(begins[1:], length), begins + 1)
    first = np.searchsorted(ends, begins, "right")
    last = np.searchsorted(ends, stops - 1, "right")
    if rule == "first":
        return first, first != last
    if rule == "last":
        return last, first != last
    owner = first.copy()
    for i in np.flatnonzero(first != last):
        cuts = np.concatenate([[begins[i]], ends[first[i] : last[i]], [stops[i]]])
        owner[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return owner, first != last


def _attribute(tokenizer: str, rule: str, with_fields: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, offsets=True)
        names = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"]

        def out(parts: list[tuple]) -> pa.RecordBatch:
            keys = pa.array([k for k, *rest in parts for _ in rest[0]], pa.int64())
            return pa.RecordBatch.from_arrays([keys, *(pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in range(1, 6))], names)

        for batch in batches:
            parts, held = [], 0
            keys, given = batch.column(0).to_pylist(), batch.column(2).to_pylist() if with_fields else None
            for first, texts in slabs(batch.column(1)):
                got, begin = coder.encode_batch(texts), 0
                for i, (text, stop) in enumerate(zip(texts_of(texts), got.ends.tolist()), first):
                    begins, begin = got.chars[begin:stop], stop
                    ends = np.array(given[i]) if with_fields else np.cumsum([len(x) + 1 for x in text.split("\n")])
                    ends[-1] = len(text)
                    if len(ends) > 1 and not with_fields and ends[-1] == ends[-2]:
                        ends = ends[:-1]  # the text ends with a line's end
                    owner, crossing = owners(begins, len(text), ends, rule)
                    counts = np.bincount(owner, minlength=len(ends)) if len(begins) else np.zeros(len(ends))
                    crossed = np.bincount(owner, crossing, len(ends)) if len(begins) else np.zeros(len(ends))
                    parts.append((keys[i], np.arange(len(ends)), np.concatenate([[0], ends[:-1]]), ends, counts, crossed))
                    held += len(ends)
                    if held >= BATCH_ROWS:
                        yield out(parts)
                        parts, held = [], 0
            if parts:
                yield out(parts)

    return run


def attribute_tokens(docs: DataFrame, fields: Sequence[str] = (), rule: str = "first", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Tokens per section of each document: ``doc_id, section, char_start, char_end, n_tokens, n_crossing``.

    Without ``fields`` the document is ``text`` and its sections are its lines, each with the ``\\n`` that ends it (a
    last line of no characters counts only in an empty text). With ``fields`` the document is those columns joined by
    ``\\n``, and section ``i`` is the ``i``-th of them with the ``\\n`` after it. The whole document is encoded once;
    the spans of its tokens are merged with those of its sections, and a token on a boundary goes, whole, to the
    section that ``rule`` names, so that counts add up to the document's. ``n_crossing`` counts those of a section's
    tokens that cross a boundary. Null or empty text: one section of 0 tokens; null fields are empty ones. One row in
    gives its own rows out, whatever else shares its ``doc_id``; null ids stay null; other columns are left out. Nothing
    is shuffled: a document's work is linear in its length.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    keys = [F.col("doc_id").cast("long").alias("doc_id")]
    if fields:
        parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
        ends, at = [], F.lit(0)
        for p in parts:
            at = at + F.length(p) + 1
            ends.append(at)
        keys += [F.concat_ws("\n", *parts).alias("text"), F.array(*ends).alias("ends")]
    else:
        keys.append(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select(*keys).mapInArrow(_attribute(tokenizer, rule, bool(fields)), "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long")
