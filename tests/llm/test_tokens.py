import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyarrow import orc
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlog.llm.token_orc import read_token_orc, token_index, write_token_orc
from emberlog.llm.tokens import DEFAULT_TOKENIZER, Encoder, slabs

WHOLE = Tokenizer.from_file(DEFAULT_TOKENIZER)
WHOLE.encode_special_tokens = True
PLAIN, PLACED = Encoder(), Encoder(offsets=True)
PARTS = st.sampled_from(["it's", "don't", " ", "  ", "\n", "\t", " \n", ".", ",", "...", "été", "straße", "12", "3.14", "漢字", "🙂", "é", " ", "\x1c", "_", "#$", "'", "'s", "<|endoftext|>", "a", "Word", "\0"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PARTS, st.text(max_size=3)), max_size=25).map("".join))
def test_same_ids_and_offsets_as_the_whole_text(text):
    text = text.encode("utf-8", "ignore").decode()
    want = WHOLE.encode(text, add_special_tokens=False)
    assert PLAIN.encode(text).tolist() == want.ids
    ids, begins = PLACED.encode(text)
    assert ids.tolist() == want.ids
    assert begins.tolist() == [a for a, _ in want.offsets]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(PARTS, st.just(" x"), st.text(max_size=2)), max_size=12).map("".join), max_size=6))
def test_batches(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = [WHOLE.encode(t, add_special_tokens=False) for t in texts]
    got, placed = PLAIN.encode_batch(pa.array(texts, pa.string()), b"\7\0\0\0"), PLACED.encode_batch(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(got.ids, got.ends[:-1])][: len(texts)] == [w.ids + [7] for w in want]
    assert placed.ids.tolist() == [i for w in want for i in w.ids] and placed.chars.tolist() == [a for w in want for a, _ in w.offsets]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    settings = json.loads(open(DEFAULT_TOKENIZER, encoding="utf-8").read())
    assert PLAIN.cuts
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"added_tokens": settings["added_tokens"] + [{"id": 50257, "content": "ll wo", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}]}):
        path = tmp_path / "tokenizer.json"
        path.write_text(json.dumps(settings | change))
        whole, own = Tokenizer.from_file(str(path)), Encoder(str(path))
        whole.encode_special_tokens = True
        text = "Well WELL well worn words"
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids != PLAIN.encode(text).tolist()


def test_slabs():
    column = pa.array(["a" * 5, None, "b" * (9 << 20), "", "c"])
    parts = list(slabs(column))
    assert [i for i, _ in parts] == [0, 2, 3] and [x for _, t in parts for x in t.to_pylist()] == [x or "" for x in column.to_pylist()]
    assert not list(slabs(column.slice(0, 0)))


def test_orc_round_trip(spark, tmp_path):
    rows = [(5, "five five"), (1, None), (3, ""), (2, "two\n\ntwo"), (3, "again"), (None, "no id"), (9, "long " * 30_000)]
    rows += [(7, "word " * n) for n in (4, 1, 9, 1, 6)] + [(None, "none " * n) for n in (3, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS file").repartition(3)
    write_token_orc(docs, path := str(tmp_path / "orc"))
    got = sorted(map(tuple, token_index(spark, path).collect()), key=lambda r: r[1])
    at, want = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = WHOLE.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r[0], r[2], r[3]) for r in got if r[0]) == sorted(w for w in want if w[0])
    assert [r[0] for r in got] == [w[0] for w in want]
    for key, start, n, _ in got:
        assert start == at
        at += n
    assert [r.ids[-1] for r in read_token_orc(spark, path).filter("doc_id = 2").collect()] == [0]
    # The ids of each row are where its start says, when the files are read one after another.
    files = sorted(p for p in (tmp_path / "orc").iterdir() if p.name.startswith("part-"))
    ids = np.concatenate([x for p in files for x in orc.read_table(p).column("ids").combine_chunks().to_numpy(zero_copy_only=False)])
    assert Counter((r[2], r[3]) for r in got) == Counter((n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes())) for _, start, n, _ in got)
    assert all(zlib.crc32(ids[start : start + n].astype("<u4").tobytes()) == crc for _, start, n, crc in got)


def test_orc_of_no_rows(spark, tmp_path):
    write_token_orc(spark.createDataFrame([], "doc_id long, text string"), path := str(tmp_path / "orc"))
    assert token_index(spark, path).count() == 0
