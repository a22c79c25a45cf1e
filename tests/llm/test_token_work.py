"""How often words are encoded."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import token_orc, tokens

KEPT = tokens.Encoder()


def test_texts_of_six_megabytes_are_encoded_together(monkeypatch):
    calls, whole = [], tokens.Encoder.encode_batch
    monkeypatch.setattr(tokens.Encoder, "encode_batch", lambda self, texts, end=b"": calls.append(len(texts)) or whole(self, texts, end))
    texts = ["a few words that repeat, and one that doesn't: x%d \tend\x85" % i for i in range(120_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    assert batch.column(1).nbytes > 6_000_000
    got = pa.Table.from_batches(token_orc._encode(tokens.DEFAULT_TOKENIZER, 0)([batch]))
    assert calls == [120_000] and got.column("doc_id").to_pylist() == [*range(120_000)]
    plain = tokens.encoder()
    for i in (0, 7, 119_999):
        want = plain.tokenizer.encode(texts[i], add_special_tokens=False).ids
        assert np.array_equal(got.column("ids")[i].as_py(), [*want, 0])


def test_words_that_repeat_are_kept_from_batch_to_batch(monkeypatch):
    calls, whole = [], tokens.Encoder._piece
    monkeypatch.setattr(tokens.Encoder, "_piece", lambda self, piece: calls.append(piece) or whole(self, piece))
    own = tokens.Encoder()
    again = " ".join(f"again{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    for nth in "xy":
        rare = " ".join(nth + "".join(chr(97 + i // 26**d % 26) for d in range(4)) for i in range(170_000))
        own.encode_batch(pa.array([again, again, rare]))
    assert sum(c.startswith(" again") for c in calls) < 610


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "\n", "\t", "\x85", "\xa0", " ", "　", " ", "’", "a", "été", "×", "÷", "ß", "'s", "don't", "12", "².", "漢", "--", "\x1c", "\x7f", "<|endoftext|>"]), max_size=9).map("".join), max_size=8))
def test_parts_against_whole_texts(texts):
    own, whole = KEPT, KEPT.tokenizer
    got = own.encode_batch(pa.array([*texts, *texts], pa.string()).slice(1), b"\7\0\0\0")
    want = [whole.encode(t, add_special_tokens=False).ids + [7] for t in [*texts, *texts][1:]]
    assert [x.tolist() for x in np.split(got.ids, got.ends[:-1])][: len(want)] == want
    assert len(own.kept) <= tokens.KEPT_PARTS
    raw = "".join(texts).encode()
    if texts and raw:
        bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
        parts, of = tokens._cut(np.frombuffer(raw, np.uint8), bounds)
        assert ["".join(p for p, i in zip(parts.to_pylist(), of.tolist()) if i == n) for n in range(len(texts))] == texts


def test_kept_parts_are_dropped_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PARTS", 3)
    own = tokens.Encoder()
    for text in ("one two", "three two four", "one five six seven eight", "two one", "nine"):
        got = own.encode_batch(pa.array([text, text]))
        assert got.ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids * 2
        assert len(own.kept) <= 3
