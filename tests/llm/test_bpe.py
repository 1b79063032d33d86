import json
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import Encoder, checked, load_merges
from tidemark.llm.tokens import BYTE_BPE, TOKENIZERS, count_tokens, encode

PATH = Path(TOKENIZERS) / BYTE_BPE
tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not PATH.exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(str(PATH))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def own():
    return Encoder(load_merges(str(PATH)))


def ids(encoder, texts):
    raw = [t.encode() for t in texts]
    places = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    flat, upto = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), places)
    return [flat[upto[i] : upto[i + 1]].tolist() for i in range(len(texts))]


EDGES = ["", " ", "  a", "a  ", "it's  we'll 'tis ''s 's 'RE they're'll\n\n  x", "\n\n\nfoo", "a" * 5000, "don't'", "'", "' s", " 's", "ab　  x", "x\n", "\t\ttabs", "🙂🙂 é ١٢٣", "<|endoftext|> x", "abc" * 700 + "1", "''''s", "a\r\n b", "'dx 've", "x's" * 9, "\x00\x1c\x85 y", "é", "0123456789" * 40, " " * 3000 + "x", "﻿bom", "ﬁ Ⅷ ½", "I'Ll 'S"]


def test_edges(own, reference):
    assert ids(own, EDGES) == reference(EDGES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab 'strevmld1.\n\t", max_size=80)), max_size=8))
def test_any_text(own, reference, texts):
    assert ids(own, texts) == reference(texts)


def test_words_are_forgotten_and_chunks_split(own, reference, monkeypatch):
    from tidemark.llm import bpe

    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 1000)
    texts = [f"word{i} other{i * 7} the end\n" * (i % 9) for i in range(120)] + ["z" * 2500]
    assert ids(own, texts) == reference(texts)


def test_round_trip(own):
    model = json.loads(PATH.read_text())["model"]["vocab"]
    shown = {v: k for k, v in model.items()}
    table = {}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in range(256):
        table[chr(b) if b in printable else chr(256 + [x for x in range(256) if x not in printable].index(b))] = b
    for text, got in zip(EDGES, ids(own, EDGES)):
        assert bytes(table[c] for i in got for c in shown[i]).decode() == text


def test_frames(spark, reference):
    rows = [(1, None), (2, ""), (3, "Hello, world"), (3, "Hello, world"), (4, "x" * 300_000), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in encode(df).collect()), key=str)
    assert got == sorted(((i or 0, reference([t or ""])[0]) for i, t in rows), key=str)
    counts = sorted((r["doc_id"] or 0, r["tokens"]) for r in count_tokens(df).collect())
    assert counts == sorted((i, len(x)) for i, x in got)
    assert encode(df.filter("false")).count() == 0 and encode(df).columns == ["doc_id", "ids"]
    clash = spark.createDataFrame([(1, "a b", 5)], "ids bigint, text string, _text int")
    assert encode(clash, keep=["ids", "_text"], out="ids").columns == ["_text", "ids"]


def long_words():
    import random

    rng = random.Random(3)
    han, az = [chr(c) for c in range(0x4E00, 0x5200)], "abcdefghijklmnopqrstuvwxyz"
    yield ["".join(rng.choices(han, k=k)) + "。" for k in (20, 24, 60, 400) for _ in range(20)]
    yield ["ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอนหรือวรรณยุกต์เช่นเดียวกับภาษาจีน" * 9]
    yield ["".join(rng.choices("ACGT", k=20_000))]
    yield ["".join(f"function({rng.choice(az)},{rng.choice(az)}){{return{rng.choice(az) * 3}}}" for _ in range(2000)).replace("(", "").replace(")", "").replace(",", "").replace("{", "").replace("}", "")]
    yield ["".join(rng.choices(az, k=k)) for k in (127, 128, 129, 130, 255, 256, 257, 1000, 30_000)]
    yield ["a" * 20_001, "ab" * 5001, "aab" * 333, "-" * 7000, " " * 5001 + "x", "é" * 999, "a" * 131 + "b" + "a" * 977, "x" + "a" * 640]
    for _ in range(60):
        parts = ["the", "ing", "aaaa", "ab", "-", "=", "zz", "ational", "éé", "好"]
        yield ["".join(rng.choice(parts) * rng.randint(1, 9) for _ in range(rng.randint(20, 150))), "".join(rng.choices(rng.sample(az, rng.choice([2, 3, 5])), k=rng.randint(100, 1500)))]


def test_long_words(own, reference):
    for texts in long_words():
        own._clear()
        assert ids(own, texts) == reference(texts)


def test_time_grows_with_length_only(own):
    import random
    import time

    rng = random.Random(4)
    text = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=320_000))]
    own._clear()
    began = time.process_time()
    ids(own, text)
    assert time.process_time() - began < 6  # a sixth of that on an idle machine


def test_merges_are_checked():
    bytes_ = np.arange(256, dtype=np.int32)
    make = lambda *pairs: {k: np.array(v, np.int32) for k, v in zip(("left", "right", "merged"), zip(*pairs))} | {"byte_id": bytes_}
    assert int(checked(make((97, 98, 256), (256, 99, 257)))["longest"]) == 3
    with pytest.raises(ValueError):
        checked(make((256, 99, 257), (97, 98, 256)))
    big = Encoder(checked(make((97, 98, 70_000), (70_000, 99, 1_000_000), (97, 97, 66_000), (66_000, 98, 2_000_000))))
    assert ids(big, ["abc", "aab", "ab", "abcabc"]) == [[1_000_000], [97, 70_000], [70_000], [1_000_000] * 2]
