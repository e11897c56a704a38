"""The dictionaries of the quality operator see whole texts."""

from hearken.llm import quality


def test_pieces_are_the_whole_text():
    text = "".join(f"naïve {i} " for i in range(20_000))
    cut = quality.pieces(text)
    assert b"".join(cut) == text.encode() and max(map(len, cut)) <= quality.PIECE
    assert quality.pieces("") == []
