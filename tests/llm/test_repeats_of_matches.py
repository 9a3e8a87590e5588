"""What a pattern matches once is found where it stands again without its pattern; clean numbers are not."""

import pytest

from catalogcheck.llm import pii

PROSE = "word " * 30
CLEAN = [f"order {1000 + i * 37} of item {5000 + i * 91} weighs {200 + i} g, order {1000 + i * 37} again" for i in range(60)]
FORMS = {
    "in words": (lambda i: f"+1 (213) 555-{i:04d}", lambda i: f"1 (213) 555-{i:04d}", lambda i: f"1 (213) 555-{i:04d}"),
    "in one word": (lambda i: f"+12135550{i:03d}", lambda i: f"12135550{i:03d}", lambda i: f"12135550{i:03d}"),
}


@pytest.mark.parametrize("form", FORMS)
def test_repeats_without_the_pattern_are_added(form):
    matched, again, part = FORMS[form]
    docs = [f"{PROSE}call {matched(i)} now {PROSE}or {again(i)} again. {PROSE}ref 98765{i:03d} and ref 98765{i:03d}" for i in range(60)]
    found = pii.find_all(docs, pii.fit(docs + CLEAN))
    for i, (text, (base, added)) in enumerate(zip(docs, found, strict=True)):
        assert len(base) == 1
        assert [(k, text[a:b]) for a, k, b in added] == [(3, part(i))]


def test_clean_numbers_are_not_added():
    docs = [f"{PROSE}call +1 (213) 555-{i:04d} now {PROSE}or 1 (213) 555-{i:04d} again" for i in range(60)]
    assert not any(base or added for base, added in pii.find_all(CLEAN, pii.fit(docs + CLEAN)))
