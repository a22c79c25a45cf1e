"""Words encoded apart against the library on whole texts."""

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlog.llm.word_tokens import WORD_TOKENIZER, WordEncoder, cuts_at_spaces

WHOLE = Tokenizer.from_file(WORD_TOKENIZER)
WHOLE.encode_special_tokens = True
OWN = WordEncoder()


def check(texts):
    got = OWN.encode_batch(pa.array(texts, pa.string()), np.uint32(2).tobytes())
    begins = [0, *got.ends.tolist()]
    for text, a, b in zip(texts, begins, begins[1:]):
        assert got.ids[a:b].tolist() == [*WHOLE.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_shape():
    assert OWN.cuts and not cuts_at_spaces(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_documents():
    check(pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list(" \n\t\r'sStTdDlLvVeE019.,;-_<|>ßéÉİıſΣσς́̈¨ª²½\xa0\xad\x1c\x85")), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_any_text(texts):
    check(texts)


def test_odd_words():
    rnd = random.Random(1)
    parts = ["it's", "IT'S", "'s", "''s", "don't", "<|endoftext|>", "É", "É", "é", "á ́b", "x\n\ny", "  ", "\x1c", "a\x1cb", "İstanbul", "ΑΣ", "ΣΑΣ ΑΣ", "日本", "①", "1²½", "word</w>", "a\xa0b", "\xad", "🙂", "İ!", "!İ", "a×b", "÷", "é1", "ž_", "ŉa"]
    check(["", " ", *parts, *("".join(rnd.choice(parts) + rnd.choice(["", " ", "\n"]) for _ in range(12)) for _ in range(200))])


def test_other_settings(tmp_path):
    changed = json.loads(open(WORD_TOKENIZER).read())
    changed["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(changed))
    other = WordEncoder(str(path))
    assert not other.cuts
    assert other.encode_batch(pa.array(["Ab c", ""])).ids.tolist() == Tokenizer.from_file(str(path)).encode("Ab c").ids
