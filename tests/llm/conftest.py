import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Texts with every awkward case: null, empty, blank, short, repeated, odd characters, long."""
    return [
        (1, "The cat sat on the mat, and it's 12.5% done!"),
        (2, None),
        (3, ""),
        (4, "   \n\t "),
        (5, "one"),
        (6, "The cat sat on the mat, and it's 12.5% done!"),
        (7, "Σίσυφος ΣΑΣ İstanbul naïve école  x\x1cy 한국어 漢字 😀"),
        (8, "<|endoftext|>hi<|startoftext|> <|endof"),
        (9, "word " * 6000),
        (None, "no id here at all"),
        (5, "one"),
        (9007199254740993, "a large id"),
    ]
