import pytest
from hypothesis import given, settings, strategies as st

from marginalia.llm.split import split_points, split_texts

TEXT = st.text(alphabet="ab .!\n#\r\té😀", max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(5, 60), st.integers(0, 4))
def test_round_trip(text, limit, overlap):
    points = split_points(text, limit, overlap)
    pieces = [text[a:b] for a, b, _ in points]
    assert all(len(p) <= limit for p in pieces)
    back = pieces[0]
    for (_, end, _), (start, _, _), before, piece in zip(points, points[1:], pieces, pieces[1:]):
        assert end - start == overlap and (not overlap or before[-overlap:] == piece[:overlap])
        back += piece[overlap:]
    assert back == text


def test_boundaries():
    text = "One two three. " * 20 + "\n\n" + "Four five six. " * 20
    ends = [how for _, _, how in split_points(text, 320, 10)]
    assert ends == ["paragraph", "end"]
    assert [how for _, _, how in split_points("x" * 50, 20, 5)][:-1] == ["character"] * 3
    assert split_points("", 10, 2) == [(0, 0, "whole")]
    with pytest.raises(ValueError, match="overlap"):
        split_points("abc", 5, 5)


def test_table(spark):
    rows = [("g", "1", "a" * 25_001, 1), ("g", "1", "a" * 25_001, 2), ("g", "2", "short", 3), ("g", "3", None, 4), ("g", "4", "", 5), ("g", "5", "é" * 10_000, 6)]
    df = spark.createDataFrame(rows, "group_id string, uuid string, content string, piece_no int")
    got = split_texts(df, "content", ["group_id", "uuid"]).collect()
    assert sorted({r.uuid for r in got}) == ["1", "2", "4", "5"]
    long = sorted((r.piece_no, r.start_pos, r.end_pos, r.overlap_chars) for r in got if r.uuid == "1")
    assert len(long) == 3 and long[0][:3] == (0, 0, 9800) and long[-1][2] == 25_001 and all(o == 200 for _, _, _, o in long[1:])
    assert split_texts(df.limit(0), "content", ["uuid"]).count() == 0


def test_sentence_ends():
    from marginalia.llm.split import SEPARATORS

    ends = lambda text: [text[: m.end()] for m in dict(SEPARATORS)["sentence"].finditer(text)]
    assert ends("We saw Dr. Bo at J. P. Hill. He left! Why?") == ["We saw Dr. Bo at J. P. Hill. ", "We saw Dr. Bo at J. P. Hill. He left! "]
    assert ends("今天下雨。我们回家！好") == ["今天下雨。", "今天下雨。我们回家！"]
    assert ends("Well... so. \"Yes.\" No") == ["Well... ", "Well... so. ", 'Well... so. "Yes." ']
