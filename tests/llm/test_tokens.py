import json
import base64

import pytest

from fieldmill.llm import tokens as T

PATH = f"{T.TOKENIZERS}/{T.BYTE_BPE}"
TEXTS = [None, "", " ", "Hello  world\n\n\tx", "naïve café — 日本語 🙂🙂", "<|endoftext|> is text", "a\r\nb\x00c", "é" * 3000, "x" * 50_000, "QUJD" * 5000, "﻿odd ​ ‮", "퟿�"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash")], "`doc.id` int, text string, ids string")


def test_ids_agree_with_another_library(spark, reference):
    got = T.encode(frame(spark), ["doc.id"], "text")
    assert got.columns == ["doc.id", "ids"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.ids == (reference.encode_ordinary(TEXTS[r["doc.id"]]) if TEXTS[r["doc.id"]] else []) for r in rows)
    assert {r["doc.id"]: r.n_tokens for r in T.count(frame(spark), ["doc.id"], "text").collect()} == {r["doc.id"]: len(r.ids) for r in rows}


def test_decoding_is_the_inverse(spark):
    coded = T.encode(frame(spark), ["doc.id"], "text")
    assert {r["doc.id"]: r.text for r in T.decode(coded, ["doc.id"], "ids").collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert T.decode_ids(None, PATH) is None
    split = T.encode_texts(["🙂"], PATH)[0]
    assert len(split) > 1 and T.decode_ids(split[:1], PATH).endswith("�") and T.decode_ids(split, PATH) == "🙂"


def test_offsets_cover_the_bytes(spark):
    for r in T.offsets(frame(spark), ["doc.id"], "text").collect():
        data = (TEXTS[r["doc.id"]] or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r.start, r.stop)) == data and r.start == [0, *r.stop][: len(r.start)]


def test_byte_table_and_empty(spark):
    assert sorted(T.byte_table().values()) == list(range(256))
    assert T.encode(frame(spark).limit(0), ["doc.id"], "text").count() == 0


def test_only_files_that_say_so_are_split_here(tmp_path):
    """A file that splits otherwise is left to the library, whatever its name."""
    path = f"{T.TOKENIZERS}/{T.BYTE_BPE}"
    assert T.splits_as_known(path) and not T.splits_as_known(f"{T.TOKENIZERS}/word_bpe_49k.json")
    held = json.loads(open(path, encoding="utf-8").read())
    held["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "\\p{N}"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]}
    other = tmp_path / "byte_bpe_digits.json"
    other.write_text(json.dumps(held), encoding="utf-8")
    text = "In 2024 it was 1234567 times as much"
    assert not T.splits_as_known(str(other)) and T.encode_texts([text], str(other)) == T.library_ids([text], str(other)) != T.library_ids([text], path)
