import json

import pytest

from fieldmill.llm import residue as R

CELL = "array<struct<kind:string,exec_count:int,start:int,len:int>>"
SCHEMA = f"doc_id long, text string, cells {CELL}, path string, repo string, residue string, total string"
PROSE = "The {0} of the river was measured at noon, and the curve of it rose after rain in May."
PAGE = "The server took too long to answer.\nThis {0} could not be rendered. Try again in a few minutes."


def doc(i, text, path="a/00_width.ipynb", host=None, cells=None):
    return (i, text, cells, path, host or f"h{i % 7}", "x", "y")


def notebook(i, more="", executed=1):
    """A notebook whose one cell of code was run."""
    prose, code = PROSE.format(i) + "\n" + more, f"rows = read('a{i}.csv').groupby('site').mean()"
    return doc(i, f"{prose}\n{code}\n17.5", cells=[("markdown", None, 0, len(prose)), ("code", executed, len(prose) + 1, len(code)), ("output", executed, len(prose) + len(code) + 2, 4)])


def flags(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return {int(r.key): (r.flagged, r.learned) for r in R.residue(df, "doc_id", "text", "cells", "path", "repo", **more).collect()}


def test_documents(spark):
    pages = [doc(i, PAGE.format(("file", "page", "view")[i % 3])) for i in range(30)]
    notices = [doc(i, "<noscript>Please enable scripting to see the cells.</noscript>") for i in range(30, 40)]
    fill = [doc(i, f"# (click to edit the {w})\n\nReplace this with your {w}.") for i, w in enumerate(("title", "goal", "course", "date", "author", "metric", "plan") * 2, 40)]
    real = [notebook(i) for i in range(100, 160)]
    cases = {
        200: (doc(200, "# Server\nThis chart could not be rendered. Try again in a few minutes."), True),
        201: (doc(201, json.dumps({"error": {"code": 503, "message": "The server took too long to answer."}})), True),
        202: (doc(202, "<html><title>502</title><h1>The server took too long to answer.</h1></html>"), True),
        203: (doc(203, json.dumps({"cells": [{"cell_type": "code", "source": ["The server took too long to answer."]}]})), True),
        204: (doc(204, "Replace this with your name. (click to edit the colour)"), True),
        205: (doc(205, "# {{title}}\n\n- {{ owner }} {{ DATE }}\n\n**${METRIC}, <your goal>\nIn [ ]: pass\n"), True),
        206: (doc(206, "# Title\nasdf asdf asdf asdf qwer tzui asdf asdf asdf asdf qwer tzui"), True),
        207: (doc(207, PROSE.format("width")), False),
        208: (doc(208, PROSE.format("depth") + " It said the server took too long to answer, so we measured the curve of it at noon."), False),
        209: (notebook(209, "The server took too long to answer."), False),
        210: (doc(210, "x"), False),
        211: (doc(211, None), None), 212: (doc(212, ""), None), 213: (doc(213, " \n\t"), None),
        214: (doc(214, PAGE.format("file"), path=None), True),
        215: ((215, PAGE.format("file"), [None, ("markdown", None, None, 3)], None, None, None, None), True),
    }
    rows = pages + notices + fill + real + [d for d, _ in cases.values()]
    got = flags(spark, rows)
    assert {i: got[i][0] if i in got else None for i in cases} == {i: w for i, (_, w) in cases.items()}
    assert all(got[i][0] for i in range(54)) and not any(got[i][0] for i in range(100, 160))
    # the corpus decides nearly all of it by itself; only form is left to the detectors
    alone = flags(spark, rows, detectors=False)
    assert {i for i in cases if i in alone and alone[i][0] != got[i][0]} == {205, 206} and all(alone[i][0] for i in range(54))


def test_what_real_documents_say_is_not_learnt(spark):
    wording = "Please fetch a biscuit, traveller."
    pages = [doc(i, PAGE.format("page") + "\n" + wording) for i in range(30)]
    assert flags(spark, [*pages, doc(100, wording)])[100] == (True, R.weight(wording))
    assert flags(spark, [*pages, *(notebook(i, wording) for i in range(200, 260)), doc(100, wording)])[100] == (False, 0)
    # one host, or an address that the body speaks of, is no evidence
    assert not flags(spark, [doc(i, PAGE.format("page"), host="one") for i in range(30)])[0][0]
    assert not flags(spark, [doc(i, PAGE.format("page"), path="a/00_server.ipynb") for i in range(30)])[0][0]
    # a long text that was copied is not low in information
    long = " ".join(f"Sentence {chr(97 + i % 26)}{chr(97 + i // 26)}a is about {chr(97 + i // 26)}{chr(97 + i % 26)}b." for i in range(120))
    assert not flags(spark, [doc(i, long) for i in range(30)])[0][0]


def test_code_that_was_run_prints_what_it_likes(spark):
    page, code = PAGE.format("page"), "reply = fetch('http://example.org/missing')\nprint(reply.text)"
    cells = [("code", 3, 0, len(code)), ("output", 3, len(code) + 1, len(page))]
    pages = [doc(i, page) for i in range(30)]
    assert flags(spark, [*pages, doc(100, f"{code}\n{page}", cells=cells), doc(101, page, cells=[("output", None, 0, len(page))])]) | {100: (False, 0)} == flags(spark, [*pages, doc(100, f"{code}\n{page}", cells=cells), doc(101, page)])


def test_spans_name_the_cells():
    text = "# Intro\nfoo(1)\nout"
    cells = [{"kind": "markdown", "start": 0, "len": 7}, {"kind": "code", "start": 8, "len": 6}, {"kind": None, "start": 15, "len": 3}, None, {"kind": "code", "start": 99, "len": 4}]
    assert R.cells_of(text, cells) == [("markdown", "# Intro"), ("code", "foo(1)"), ("markdown", "out")]
    assert R.cells_of(text, None) == [("markdown", text)]


@pytest.mark.parametrize("sentence,is_one", [("{{ owner }}", True), ("# <your dataset>", True), ("${a}, [[ b ]]: %%c%%", True), ("The value of {{ x }} is set by the reader of this page", False), ("a < b > c", False)])
def test_placeholders(sentence, is_one):
    assert R.placeholder(sentence, R.weight(sentence)) == is_one


@pytest.mark.parametrize("sentence,words", [("Th3 s3rv3r t00k 12 tries, id 8ac841b8-3e81!", "the server t0k 0 tries id 0"), ("3rr3ichbar (503)", "erreichbar 0"), ("続ける 5", "続 け る 0"), ("", "")])
def test_words(sentence, words):
    assert " ".join(R.words_of(sentence)) == words


def test_long_repeated_and_empty(spark):
    long = "lorem ipsum dolor amet " * 20_000
    rows = [doc(1, long), doc(1, long), doc(2, "word " * 50_000 + PROSE)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((int(r.key), r.flagged) for r in R.residue(df, "doc_id", "text").collect())[:2] == [(1, True), (1, True)]
    assert R.residue(df.limit(0), "doc_id", "text").count() == 0
