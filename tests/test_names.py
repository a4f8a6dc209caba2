"""Golden names."""

import pytest

from eventloom.functions import names as N

GIVEN = frozenset({"jane", "william", "dorje", "naomi", "astra"})


@pytest.mark.parametrize(
    ("title", "context", "want"),
    [
        ("Richard Dawkins in conversation with Alice Roberts", None, ["Richard Dawkins", "Alice Roberts"]),
        ("Lubaina Himid in conversation", None, ["Lubaina Himid"]),
        ("An evening with Mary Beard", None, ["Mary Beard"]),
        ("Jane Doe: A Title", None, ["Jane Doe"]),
        ("Slow Looking: Title", None, []),
        ("Digital Heists Uncovered: How Crime Went Online", None, []),
        ("Walk: William Tyndale", None, []),
        ("Inaugural Lecture: Professor Rajvinder Karda", None, ["Professor Rajvinder Karda"]),
        ("Finance Seminar – Dorje Brody", None, ["Dorje Brody"]),
        ("The Future of Cities", "A lecture by Professor Jane Smith FRS on urban life.", ["Professor Jane Smith"]),
        (None, None, []),
    ],
)
def test_title_speakers(title, context, want):
    assert N.title_speakers(title, context, GIVEN) == want


def test_names():
    assert N.honorific_names("Chaired by Dr Amina Patel, with Prof. Tom Jones OBE") == ["Dr Amina Patel", "Prof. Tom Jones"]
    assert N.clean_name("Professor Sir David Attenborough OM FRS") == "Professor Sir David Attenborough"
    assert N.uniq_names(["Ben Okri", "Rosemary Clunie", "Sir Ben Okri"]) == ["Sir Ben Okri", "Rosemary Clunie"]
    assert N.uniq_names(["Mary Beard", "mary beard", "Professor Mary Beard FBA"]) == ["Professor Mary Beard"]
    assert N.split_names("Jane Doe, John Smith and Ada Lovelace") == ["Jane Doe", "John Smith", "Ada Lovelace"]
