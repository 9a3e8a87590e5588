"""The field fitted on the given documents adds repeats whole, wherever they stand, and leaves other numbers alone."""

import pytest

from catalogcheck.llm import pii

PROSE = "the report was sent to the whole group before noon and nobody replied to it until the next week "
CASES = {
    "far": ("+14155550123", "14155550123"),
    "words": ("+44 20 7946 0958", "44 20 7946 0958"),
    "marks": ("+1 (213) 555-0001", "1 (213) 555-0001"),
    "joined": ("+44 20 7946 0958", "442079460958"),
    "card": ("4111 1111 1111 1111", "4111-1111-1111-1112"),
    "altered": ("+491701234567", "491701234568"),
}


@pytest.fixture(scope="module")
def fitted(spark):
    return pii.trained(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize("gap", [2, 20, 400])
@pytest.mark.parametrize("case", CASES)
def test_repeats_are_added_whole(fitted, case, gap):
    one, two = CASES[case]
    between = " ".join((PROSE * 30).split()[:gap])
    text = f"please call {one} {between} and then {two}, thanks"
    base, added = pii.find_all([text], fitted)[0]
    assert [text[a:b] for a, _, b in base] == [one]
    assert [text[a:b] for a, _, b in added] == [two] and added[0][1] == base[0][1]


def test_clean_numbers_stay(fitted):
    texts = [
        f"please call +14155550123 {PROSE} order 98765432101 of 2024-05-06 and 14155559999 or 20 7946 1111",
        f"in 2024 some 14155550123 units {PROSE} were sold, 14155550123 in all",
        f"host 10.0.0.1 {PROSE} build 10001 and version 10.0.0.1.2 of 10",
        f"card 4111 1111 1111 1111 {PROSE} then 4111 2222 1111 1111 and 1111",
    ]
    assert [added for _, added in pii.find_all(texts, fitted)] == [[], [], [], []]
