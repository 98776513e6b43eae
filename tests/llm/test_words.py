"""The quick ways of splitting and classifying words against the plain rules."""

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from prismal.llm import decontam, words

TEXT = st.text(st.one_of(st.sampled_from(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0   　aZß١½.,'-09"), st.characters(codec="utf-8")), max_size=30)
WORD = st.one_of(TEXT, st.from_regex(r"\A[\"(]?[0-9]{1,3}([.,][0-9]+)?(km|st|KG|/h)?[.)]?\Z"), st.from_regex(r"\A[\"(]?[A-Za-z'ßé-]{1,8}[.,!]?\Z"))


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_split(text):
    assert words.split(text) == regex.findall(r"[^\x20\x09-\x0D]+", text)


@settings(max_examples=500, deadline=None)
@given(WORD)
def test_kinds(word):
    bare = regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", word)
    assert decontam.bare_of(word) == bare
    assert decontam.folded(bare) == bare.upper().casefold()
    kind = decontam._kind(word) & decontam.KIND
    if decontam.NUMBER.match(bare.upper().casefold()):
        assert kind == decontam.NUM
    elif decontam.AMOUNT.match(bare):
        assert kind == decontam.GLUED
    elif bare and (bare[0].isupper() or bare[0].istitle()):
        assert kind in (decontam.NAME, decontam.NAMED_UNIT)
    else:
        assert kind in (0, decontam.UNIT)
