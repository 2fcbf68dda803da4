"""Encoding of texts with a public tokenizer, decoding, and offsets, in Arrow batches.

The vocabulary is a file named by a parameter. It is read once per Python worker. A byte-level vocabulary writes each byte as one
printable character; decoding reverses that table over the concatenated tokens, so characters split over tokens come back whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import col

#: The folder of the public vocabularies; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Characters of the texts encoded together. One longer text is encoded alone, whole.
SLICE = 1 << 18


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The public pattern that byte-level vocabularies of this family split a text by before their merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose classes all versions of Unicode in use agree. Other text is split by the library itself.
_SETTLED = re.compile(r"[\t\n\r -~¡-ɏΑ-ΡΣ-Ωα-ωЀ-ӿא-ת‐-‧、-〜ぁ-ゖ゛-ヿ一-龥가-힣，．：；！？（）［］]*")
#: A single line break between visible ASCII always ends a piece of the pattern.
_BREAK = re.compile(r"(?<=[!-~]\n)(?=[!-~])")
#: Pieces remembered by a worker, and the length above which they are not.
MEMO, MEMO_LENGTH = 200_000, 64


@lru_cache(maxsize=4)
def _memo(path: str) -> dict[str, list[int]]:
    return {}


def _class(kind: str) -> str:
    """The settled characters of a Unicode kind as the inside of a character class."""
    found = [c for c in range(0x20, 0xD7A4) if unicodedata.category(chr(c))[0] == kind and _SETTLED.fullmatch(chr(c))]
    out, i = [], 0
    while i < len(found):
        k = i
        while k + 1 < len(found) and found[k + 1] == found[k] + 1:
            k += 1
        out.append(f"\\u{found[i]:04x}-\\u{found[k]:04x}")
        i = k + 1
    return "".join(out)


@lru_cache(maxsize=2)
def _splitter(ascii_only: bool):
    """PATTERN spelled out for settled text: the standard library's matcher is the faster one and knows no Unicode kinds."""
    letters, numbers = ("A-Za-z", "0-9") if ascii_only else (_class("L"), _class("N"))
    spelled = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(spelled)


#: A text on which the splitter is held against the library's own before it is used.
_PROBE = "It's 12 o'clock,  they'll\t\tsay: f(x)=1.5e3;\n\n  def é_1(self): ÄÖ ß你好 3月 --\n"


@lru_cache(maxsize=4)
def splits_as_known(path: str) -> bool:
    """Whether the vocabulary file says that texts are split by PATTERN and changed by nothing else; any other file is left to the library."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    steps, model = held.get("pre_tokenizer") or {}, held.get("model") or {}
    plain = held.get("normalizer") is None and steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space", True)
    if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return False
    own = [m.span() for m in _splitter(False).finditer(_PROBE)]
    return own == [span for _, span in tokenizer(path).pre_tokenizer.pre_tokenize_str(_PROBE)]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > SLICE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def library_ids(texts: list[str], path: str) -> list[list[int]]:
    """The ids of each text, straight from the library."""
    t = tokenizer(path)
    return [e.ids for part in _slices(texts) for e in t.encode_batch_fast(part, add_special_tokens=False)]


def _settled_ids(text: str, path: str) -> list[int]:
    """The ids of a settled text: merges never cross pieces, so each distinct piece is encoded once."""
    memo = _memo(path)
    pieces = _splitter(text.isascii()).findall(text)
    missing = [x for x in set(pieces) if x not in memo]
    if len(memo) + len(missing) > MEMO:
        memo.clear()
        missing = list(set(pieces))
    if missing:
        memo.update(zip(missing, library_ids(missing, path)))
    ids = list(chain.from_iterable(map(memo.__getitem__, pieces)))
    for x in missing:
        if len(x) > MEMO_LENGTH:
            del memo[x]
    return ids


def _ids(text: str | None, path: str) -> list[int]:
    if not text:
        return []
    if not splits_as_known(path):
        return library_ids([text], path)[0]
    if _SETTLED.fullmatch(text):
        return _settled_ids(text, path)
    ids: list[int] = []
    for settled, run in groupby(_BREAK.split(text), lambda x: _SETTLED.fullmatch(x) is not None):
        joined = "".join(run)
        ids += _settled_ids(joined, path) if settled else library_ids([joined], path)[0]
    return ids


def encode_texts(texts: list, path: str) -> list[list[int]]:
    """The ids of each text; an empty list for an empty or null text.

    A byte-level vocabulary's texts are split as the library splits them and each worker remembers the ids of the pieces it has seen,
    which changes no id: the tests hold whole texts against the library.
    """
    return [_ids(x, path) for x in texts]


def encode_offsets(text: str | None, path: str) -> tuple[list[int], list[int], list[int]]:
    """ids, and the first and last-but-one byte offset of each token in the text's UTF-8 bytes."""
    t, inverse = tokenizer(path), byte_table()
    ids = encode_texts([text], path)[0]
    start, end, at = [], [], 0
    for i in ids:
        n = len(_token_bytes(t.id_to_token(i), inverse))
        start.append(at)
        at += n
        end.append(at)
    return ids, start, end


def _token_bytes(token: str | None, inverse: dict[str, int]) -> bytes:
    return bytes(inverse[c] for c in token or "" if c in inverse)


def decode_ids(ids: list[int] | None, path: str) -> str | None:
    """The text of byte-level ids; bytes that are no UTF-8 become U+FFFD. Null stays null."""
    if ids is None:
        return None
    t, inverse = tokenizer(path), byte_table()
    return b"".join(_token_bytes(t.id_to_token(i), inverse) for i in ids).decode("utf-8", "replace")


def _mapped(df: DataFrame, key: list[str], value: Column, schema: str, columns) -> DataFrame:
    """Key columns and what `columns` makes of each batch's values. Only these columns reach Python, under names without dots."""
    picked = df.select(*(col(k).alias(f"__k{i}") for i, k in enumerate(key)), value.alias("__value"))
    spelled = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in picked.schema[:-1]] + [schema])
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = columns(batch.column(n).to_pylist())
            names = [*batch.schema.names[:n], *(name for name, _ in made)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(a for _, a in made)], names=names)

    out = picked.mapInArrow(run, spelled)
    return out.select(*(F.col(f"__k{i}").alias(k) for i, k in enumerate(key)), *out.columns[n:])


def encode(df: DataFrame, key: list[str], text: str, path: str = f"{TOKENIZERS}/{BYTE_BPE}", out: str = "ids") -> DataFrame:
    """key columns and `out`, the ids of the text without special tokens: an empty list for an empty or null text.

    One row per row of df, repeated ones too; texts are encoded whole, whatever their length. Other columns are left out.
    """
    return _mapped(df, key, col(text).cast("string"), f"`{out}` array<int>", lambda texts: [(out, pa.array(encode_texts(texts, path), pa.list_(pa.int32())))])


def count(df: DataFrame, key: list[str], text: str, path: str = f"{TOKENIZERS}/{BYTE_BPE}", out: str = "n_tokens") -> DataFrame:
    """key columns and `out`, the number of tokens; 0 for an empty or null text."""
    return _mapped(df, key, col(text).cast("string"), f"`{out}` bigint", lambda texts: [(out, pa.array([len(x) for x in encode_texts(texts, path)], pa.int64()))])


def offsets(df: DataFrame, key: list[str], text: str, path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """key columns, ids, start, stop: each token's span in the UTF-8 bytes of the text. The spans join without gaps."""

    def columns(texts):
        made = list(zip(*(encode_offsets(x, path) for x in texts))) or [(), (), ()]
        return [(n, pa.array(list(v), pa.list_(pa.int32()))) for n, v in zip(("ids", "start", "stop"), made)]

    return _mapped(df, key, col(text).cast("string"), "ids array<int>, start array<int>, stop array<int>", columns)


def decode(df: DataFrame, key: list[str], ids: str, path: str = f"{TOKENIZERS}/{BYTE_BPE}", out: str = "text") -> DataFrame:
    """key columns and `out`, the text of the ids; null for null."""
    return _mapped(df, key, col(ids), f"`{out}` string", lambda given: [(out, pa.array([decode_ids(x, path) for x in given], pa.string()))])
