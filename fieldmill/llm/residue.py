"""Documents that hold template residue, filler, error-page messages or script notices in place of content.

No list says what residue reads like: the corpus does. A document is taken apart into the sentences of its cells, without cell marks and
markup, and every sentence into pairs of neighbouring words. A document is mismatched if it is low in information, that
is in different words, none of its code was run and no term of its address slug comes back in its title or body. A word pair is residue if it is duplicated over several hosts
and at least a set share of all documents that hold it, real ones counted, are mismatched: what sites send in place of content
comes again and again under addresses and titles it says nothing about, while real wording comes mostly in documents that run
or speak of what their address names. A sentence most of whose pairs are residue is residue. Two detectors of placeholders support this,
which know form and not wording: names enclosed in marks of templates, and sentences that repeat a few words over and over. A
document is flagged if most of its text by weight is residue.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, col, durable

# Detectors and markup --------------------------------------------------------------------------------------------------

#: Marks that enclose the name of a value to be filled in.
_SLOT = r"[A-Za-z][A-Za-z0-9_ .\-]{0,60}"
_MARKED = re.compile(
    rf"\{{\{{\{{?\s*{_SLOT}\s*\}}?\}}\}}|\$\{{\s*{_SLOT}\s*\}}|#\{{\s*{_SLOT}\s*\}}|\{{\d+:\s*{_SLOT}\}}|<%=?\s*{_SLOT}\s*%>|\{{%\s*{_SLOT}\s*%\}}"
    rf"|(?<![\w\\}}{{$])\{{[A-Za-z][A-Za-z0-9_]*(?: \d)?\}}(?![{{}}\w])|(?<![A-Za-z0-9])__[A-Za-z][A-Za-z0-9_ ]*?__(?![A-Za-z0-9])|\[\[\s*{_SLOT}\s*\]\]|<<\s*{_SLOT}\s*>>|@@\s*{_SLOT}\s*@@|%%\s*{_SLOT}\s*%%"
    r"|＜[^＜＞\n]{1,60}＞|<[a-z][a-z0-9_]*(?:[_ ][a-z0-9_]+)*>(?!\w)|<[A-Z][A-Z0-9_]*>(?!\w)|<(?:your|Ihre?n?|votre|vos|su|tu|your own)\s[^<>\n]{1,60}>"
)
_HTML = {
    "a", "abbr", "article", "aside", "b", "body", "br", "button", "center", "code", "div", "em", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr",
    "html", "i", "iframe", "img", "input", "li", "link", "main", "meta", "nav", "noscript", "ol", "p", "pre", "script", "section", "small", "span", "strong", "style",
    "table", "tbody", "td", "th", "thead", "title", "tr", "u", "ul", "font", "label", "svg",
}
# Sentences -----------------------------------------------------------------------------------------------------------

_MARKER = re.compile(r"^\s*(?:#\s*%%\s*(?:\[\w+\])?|#\s*output|```\s*(?:out|\w{0,12})?)\s*$")
_PROMPT = re.compile(r"^\s*(In|Out)\s?\[\s*\d*\s*\]:\s?")
_TAG = re.compile(r"</?(?:%s)\b[^<>]*>|<!--.*?-->|<!doctype[^>]*>" % "|".join(sorted(_HTML, key=len, reverse=True)), re.I | re.S)
#: A key of a JSON object, and what encloses values: markup, like tags.
_KEY = re.compile(r'"[A-Za-z_]\w*"\s*:|[{}]')
_SENTENCE = re.compile(r"(?<=[.!?…。！？])(?<!\d\.)\s*(?=\S)")
_ID = re.compile(r"\b[0-9a-f]{6,}(?:-[0-9a-f]{3,})*\b|\d+", re.I)
#: A word; of scripts without blanks, a character.
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W_\u3040-\u30ff\u3400-\u9fff]+")
_SOFT = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")


def cells_of(text: str, cells) -> list[tuple[str, str]]:
    """(kind, text) of each cell: of a JSON notebook as it says, else by the given spans, else the text as one markdown cell."""
    head = text.lstrip()
    if head.startswith('{"cells"') or head.startswith('{ "cells"'):
        try:
            out = []
            for c in json.loads(head)["cells"]:
                source = c.get("source") or ""
                out.append((str(c.get("cell_type")), source if isinstance(source, str) else "".join(map(str, source))))
            return out
        except (ValueError, TypeError, AttributeError, KeyError, RecursionError):
            pass
    out, at = [], 0
    for c in cells or ():
        if c is None or c["start"] is None or c["len"] is None or c["start"] < at or c["start"] + c["len"] > len(text):
            continue
        if text[at : c["start"]].strip():
            out.append(("between", text[at : c["start"]]))
        out.append((c["kind"] or "markdown", text[c["start"] : c["start"] + c["len"]]))
        at = c["start"] + c["len"]
    if text[at:].strip():
        out.append(("between" if out else "markdown", text[at:]))
    return out


_WORDS = re.compile(r"[^\W_]+")
_WIDE = re.compile(r"[\u2e80-\uffdc]")
_MUTE = bytes(c for c in range(128) if not chr(c).isalnum())


def weight(text: str) -> int:
    """Letters and digits, a wide character as two: what a reader gets out of a text."""
    if text.isascii():
        return len(text.encode().translate(None, _MUTE))
    return sum(map(len, _WORDS.findall(text))) + len(_WIDE.findall(text))


def sentences(cell: str) -> Iterator[str]:
    """The sentences of a cell without cell marks, prompts and markup."""
    if not cell.isascii():
        cell = _SOFT.sub("", cell)
    if "<" in cell:
        cell = _TAG.sub("\n", cell)
    for line in cell.split("\n"):
        if not line or line.isspace() or _MARKER.match(line):
            continue
        line = _PROMPT.sub("", line) if "]:" in line else line
        if line.lstrip()[:1] == "{" and '":' in line:
            line = _KEY.sub(" ", line)
        yield from (x for x in _SENTENCE.split(line.strip()) if x)


#: A digit by itself beside a letter, and the letters that digits are written for.
_DISGUISED = re.compile(r"(?<=[^\W\d_])[013457](?!\d)|(?<!\d)[013457](?=[^\W\d_])")
_LETTERS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t"}
_DIGIT = re.compile(r"\d")


def words_of(sentence: str) -> list[str]:
    """The words of a sentence in lower case, ids and numbers as 0, single digits within words as the letters they look like."""
    text = sentence.lower()
    if _DIGIT.search(text):
        text = _ID.sub("0", _DISGUISED.sub(lambda m: _LETTERS[m.group()], text))
    return _WORD.findall(text)


#: One of these is in every match of _MARKED.
_MARKS = re.compile(r"[{<_\[@%＜]")


def placeholder(sentence: str, whole: int) -> bool:
    """Whether little but enclosed names is in a sentence of so much weight."""
    if not _MARKS.search(sentence):
        return False
    left = _MARKED.sub(" ", sentence)
    return left != sentence and (rest := weight(left)) <= max(6, 0.34 * whole)


def repeats(words: list[str]) -> bool:
    """Whether a sentence of eight words or more says a few words over and over."""
    return len(words) >= 8 and len(set(words)) <= 0.35 * len(words) and not any(w == "0" for w in words)


# Documents -----------------------------------------------------------------------------------------------------------

#: Code of more weight than this makes a document one that runs.
_FIRM = 12
#: A document of more different words than this is not low in information.
LOW = 100
_MARKDOWN, _OUTPUT, _CODE_CELL = 0, 1, 2
_JUDGED = "doc string, host string, mismatched boolean, residue bigint, firm bigint, units array<struct<c:int,k:int,w:int,u:string>>"
_ARROW = pa.schema([
    ("doc", pa.string()), ("host", pa.string()), ("mismatched", pa.bool_()), ("residue", pa.int64()), ("firm", pa.int64()),
    ("units", pa.list_(pa.struct([("c", pa.int32()), ("k", pa.int32()), ("w", pa.int32()), ("u", pa.string())]))),
])
_COMMON = frozenset(("ipynb", "http", "https", "www", "html", "untitled", "title", "notebook"))


def terms(text: str | None) -> set[str]:
    """The words of an address slug or a title that could name what a body is about."""
    return {w for w in re.findall(r"[^\W\d_]{3,}", (text or "").lower()) if w not in _COMMON}


def ran(cells) -> bool:
    """Whether a cell of code was executed."""
    return any(c is not None and c["kind"] == "code" and c["exec_count"] is not None for c in cells or ())


def judge(text: str, cells, path: str | None) -> tuple[bool, int, int, list[tuple[int, int, int, str]]]:
    """(mismatched, residue, firm, units) of a document.

    residue is the weight of sentences that a detector knows, firm of code that was run. units are the other sentences as (cell, kind,
    weight, words): prose, what code printed, and the code of documents in which no code was run, since that may be a message as well.
    """
    executed, residue, firm, units = ran(cells), 0, 0, []
    for n, (kind, cell) in enumerate(cells_of(text, cells)):
        k = _CODE_CELL if kind == "code" else _OUTPUT if kind == "output" else _MARKDOWN
        if k == _CODE_CELL and executed:
            firm += weight(cell)
            continue
        for s in sentences(cell):
            w = weight(s)
            if not w:
                continue
            words = words_of(s)
            known = placeholder(s, w) or repeats(words)
            if known and k != _CODE_CELL:
                residue += w
            else:  # within code it depends on the rest of the cell
                units.append((n, k, -w if known else w, " ".join(words)))
    slug = terms(path and path.rsplit("/", 1)[-1])
    body = set() if executed else set().union(*(u.split(" ") for _, _, _, u in units))
    mismatched = not executed and len(body) <= LOW and slug.isdisjoint(body)
    return mismatched, residue, firm, units


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, cells, path, host in zip(*(c.to_pylist() for c in batch.columns)):
            if text and not text.isspace():
                mismatched, residue, firm, units = judge(text, cells, path)
                rows.append((doc, host, mismatched, residue, firm, [dict(zip("ckwu", u)) for u in units]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _if_small(df: DataFrame) -> DataFrame:
    """df, durable, with a broadcast hint if its counted rows are within the limit."""
    held = durable(df)
    return broadcast_if_small(held, held.count())


def pairs(words: Column) -> Column:
    """The pairs of neighbouring words of a sentence as hashes, its ends counting as words."""
    w = F.split(words, " ")
    return F.transform(F.arrays_zip(F.concat(F.array(F.lit("^")), w).alias("a"), F.concat(w, F.array(F.lit("$"))).alias("b")), lambda x: F.xxhash64(x["a"], x["b"]))


def wordings(judged: DataFrame) -> DataFrame:
    """h, n, n_bad, hosts: each word pair of prose and output with the documents that hold it, the mismatched ones and their hosts.

    A document counts once for a pair. Counts add up on the map side; hosts are a mergeable sketch.
    """
    prose = F.filter("units", lambda u: u["k"] != _CODE_CELL)
    held = judged.select("host", "mismatched", F.explode(F.array_distinct(F.flatten(F.transform(prose, lambda u: pairs(u["u"]))))).alias("h"))
    return held.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.col("mismatched").cast("bigint")).alias("n_bad"), F.approx_count_distinct(F.when(F.col("mismatched"), F.col("host"))).alias("hosts"))


def residue(
    df: DataFrame, key: str, text: str, cells: str | None = None, path: str | None = None, host: str | None = None,
    share: float = 0.5, hosts: int = 3, purity: float = 0.4, coverage: float = 0.5, detectors: bool = True,
) -> DataFrame:
    """(key string, residue, learned, total, flagged): the weights of every document that has a text, and whether it is residue.

    A document is flagged if the residue that detectors know and the residue that the corpus shows make up more than `share` of its weight. A
    word pair is residue if mismatched documents on at least about `hosts` hosts (a sketch, 5 % error) hold it and at least
    `purity` of the documents that hold it are mismatched; a sentence if at least `coverage` of its pairs are. Code that was run never is; of a document
    in which none was run, a cell of code counts as the larger part of it does. Null, empty and blank texts give no row; texts are read whole; repeated rows give a
    row each; missing cells, path or host columns and nulls in them count as unknown; other columns are ignored; an empty table
    gives an empty one. detectors=False leaves everything to the corpus.
    """
    picked = [col(key).cast("string").alias("doc"), col(text).cast("string").alias("text")]
    spans = "array<struct<kind:string,exec_count:int,start:int,len:int>>"
    cell = F.transform(col(cells), lambda c: F.when(c.isNotNull(), F.struct(*(c[n].alias(n) for n in ("kind", "exec_count", "start", "len"))))) if cells else F.lit(None).cast(spans)
    picked += [cell.alias("cells"), (col(path) if path else F.lit(None)).cast("string").alias("path"), (col(host) if host else F.lit(None)).cast("string").alias("host")]
    judged = durable(df.select(*picked).mapInArrow(_run, _JUDGED).withColumn("row", F.monotonically_increasing_id()))
    found = wordings(judged).where((F.col("hosts") >= hosts) & (F.col("n_bad") >= purity * F.col("n"))).select("h")
    learnt = _if_small(found)
    # only units of documents that could come out as residue need to be looked at: run code alone may already be most of the weight
    open_ = F.aggregate("units", F.lit(0).cast("bigint"), lambda a, u: a + F.abs(u["w"]))
    judged = judged.withColumn("open", open_)
    possible = judged.where(F.col("residue") + F.col("open") > share * (F.col("residue") + F.col("open") + F.col("firm")))
    each = possible.select("row", F.posexplode("units").alias("p", "u")).select("row", "p", pairs(F.col("u.u")).alias("hs"))
    met = each.select("row", "p", F.size("hs").alias("of"), F.explode("hs").alias("h")).join(learnt, "h")
    hit = met.groupBy("row", "p").agg(F.count("*").alias("n"), F.max("of").alias("of")).where(F.col("n") >= coverage * F.col("of"))
    judged = judged.join(hit.groupBy("row").agg(F.collect_set("p").alias("hits")), "row", "left")
    # (weight known by detectors, weight learnt) of units, -w marks a unit of code that a detector knows
    each_of = F.transform("units", lambda u, i: F.struct(u["c"].alias("c"), u["k"].alias("k"), F.abs(u["w"]).alias("w"), ((u["w"] < 0) & F.lit(detectors)).alias("known"), F.coalesce(F.array_contains("hits", i), F.lit(False)).alias("bad")))
    judged = judged.withColumn("each", each_of).withColumn("residue", F.col("residue") if detectors else F.lit(0).cast("bigint"))
    sure = F.lit(0).cast("bigint")
    weigh = lambda keep: F.aggregate("each", sure, lambda a, u: a + F.when(keep(u), u["w"]).otherwise(0))
    in_code = lambda u: u["k"] == _CODE_CELL
    of_cells = F.transform(
        F.array_distinct(F.transform(F.filter("each", in_code), lambda u: u["c"])),
        lambda c: F.struct(
            F.aggregate(F.filter("each", lambda u: in_code(u) & (u["c"] == c)), sure, lambda a, u: a + F.when(u["known"] | u["bad"], u["w"]).otherwise(0)).alias("bad"),
            F.aggregate(F.filter("each", lambda u: in_code(u) & (u["c"] == c)), sure, lambda a, u: a + u["w"]).alias("all"),
        ),
    )
    judged = judged.withColumn("code", of_cells)
    sum_of = lambda field, when: F.aggregate("code", sure, lambda a, c: a + F.when(when(c), c[field]).otherwise(0))
    turned = lambda c: c["bad"] * 2 >= c["all"]
    judged = judged.select(
        "doc", "residue", "open", (F.col("firm") + sum_of("all", lambda c: ~turned(c))).alias("firm"), sum_of("bad", turned).alias("coded"), (F.col("firm") + F.col("residue") + F.col("open")).alias("total"),
        weigh(lambda u: ~in_code(u) & u["bad"] & (u["k"] == _OUTPUT)).alias("printed"), weigh(lambda u: ~in_code(u) & u["bad"] & (u["k"] == _MARKDOWN)).alias("said"),
    )
    # with code that runs, outputs are no residue: code prints what it likes
    learned = F.col("said") + F.col("coded") + F.when(F.col("firm") > _FIRM, 0).otherwise(F.col("printed"))
    bad = F.col("residue") + learned
    flagged = (bad > share * F.col("total")) & ~((F.col("firm") > _FIRM) & (bad <= F.col("firm")))
    return judged.select(F.col("doc").alias("key"), "residue", learned.alias("learned"), "total", flagged.alias("flagged"))
