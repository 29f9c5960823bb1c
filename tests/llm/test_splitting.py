"""Pieces: sizes, overlaps, boundaries and the round trip."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataclaim.llm.splitting import LIMIT, OVERLAP, pieces, split_items

TEXTS = ["", "short", "x" * 5000, "word " * 2000, "Para one. It goes on.\n\n" * 300, "数据显示在两个地点差异约为百分之十六。" * 200, "a" * 1490 + " " + "b" * 3000, "e\u0301" * 2000, "👩‍🔬" * 1200, " " * 4000, "\n" * 4000, "x" * 1500, "x" * 1501]


def whole(text, ps):
    assert "".join(text[body:end] for _, body, end in ps) == text
    for k, (start, body, end) in enumerate(ps):
        assert end - start <= LIMIT and start <= body < end
        if k:
            assert body - OVERLAP <= start and start >= ps[k - 1][1] and ps[k - 1][2] == body
        else:
            assert start == body == 0


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    whole(text, pieces(text))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\u0301。", max_size=200).map(lambda s: s * 40))
def test_round_trip_of_any_text(text):
    whole(text, pieces(text))


def test_boundaries():
    text = "\n\n".join("A sentence of some words. " * 20 for _ in range(8))
    for start, body, end in pieces(text)[:-1]:
        assert text[end - 2 : end].isspace() or text[end - 1].isspace()
    for start, body, _ in pieces("word " * 2000)[1:]:
        assert start < body and ("word " * 2000)[start - 1] == " "
    # a short form is no sentence end
    assert all(not text[:end].endswith("Fig. ") for text in [("We saw it in Fig. 5 and cf. Fig. 6 too " * 100)] for _, _, end in pieces(text))


def test_marks_stay_with_their_letters():
    for text in ("e\u0301" * 2000,):
        assert all(text[body] != "\u0301" and text[start] != "\u0301" for start, body, _ in pieces(text))


def test_operator(spark):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate([*TEXTS, None])] + [(3, "word " * 2000, "again")], "id int, text string, piece string")
    got = split_items(df, "id", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r.row_id, set()).add((r.piece_no, r.start, r.body_start, r.end, r.n_pieces))
    assert set(by) == {k for k, t in enumerate(TEXTS) if t}
    for k, rows in by.items():
        assert [(s, b, e) for _, s, b, e, _ in sorted(rows)] == pieces(TEXTS[k])
    assert {r.row_id for r in split_items(df, "id", "text", keep_short=False).collect()} == {k for k, t in enumerate(TEXTS) if len(t) > LIMIT}
    with pytest.raises(ValueError):
        pieces("x" * 3000, 100, 100)
