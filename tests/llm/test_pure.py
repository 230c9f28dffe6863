"""The parts of the training-data operators that need no cluster."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserine.llm.chunking import chunk_spans
from tesserine.llm.fingerprints import Hasher, normal, shingles, simhash, units
from tesserine.llm.history import kept_in_order, marks_of, passages, similar
from tesserine.llm.languages import Model, fit, mixture, prose_lines
from tesserine.llm.leakage import cgk_keys, covered, plain, repetitions
from tesserine.llm.leakage import units as leak_units
from tesserine.llm.residue import _SLOT, has_slot, is_residue
from tesserine.llm.sentences import Lexicon, evidence, sentence_spans
from tesserine.llm.turns import Cast, clean, is_speech, turns_of
from tesserine.llm.wrappers import Expression, chrome_lines, host_of, key_of, token


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!éß中。́", max_size=400), st.integers(1, 80), st.integers(-3, 60))
def test_chunks_cover_and_overlap(text, size, overlap):
    spans = chunk_spans(text, size, overlap)
    assert (not spans) == (not text)
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
    held = max(0, min(overlap, size // 2)) if len(text) > size else 0
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c == max(0, b - held) and d > b
    assert all(0 < b - a <= size for a, b in spans)


def test_chunks_meet_again_after_an_edit():
    rng = random.Random(3)
    text = "".join(rng.choice(["word ", "longer words ", "end. ", "\n\n"]) for _ in range(20_000))
    before = {b for _, b in chunk_spans(text, 3000, 100)}
    edited = text[:5000] + "inserted here " + text[5000:]
    after = {b - 14 for _, b in chunk_spans(edited, 3000, 100) if b > 8000}
    assert len(after & before) >= 0.8 * len(after)


def test_chunk_sizes_that_make_no_sense():
    assert chunk_spans("abc", 0, 1) == [] and chunk_spans("", 5, 1) == []
    assert chunk_spans("abcdef", 6, 99) == [(0, 6)]


LEXICON = Lexicon({"Mr", "Dr", "etc", "p.m", "No", "Fig", "z", "ca"}, {"Once", "Our", "The", "This"})


@pytest.mark.parametrize(
    "text, parts",
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("Mr. Skomna bought pens, etc. Once more he paid 3.50.", ["Mr. Skomna bought pens, etc.", "Once more he paid 3.50."]),
        ("It began at 5 p.m. Our talk was long.", ["It began at 5 p.m.", "Our talk was long."]),
        ('"Who is it? Tell me," said Ann. This is next.', ['"Who is it? Tell me," said Ann.', "This is next."]),
        ('Ann asked, "Who is it?" The door opened.', ['Ann asked, "Who is it?"', "The door opened."]),
        ("(A whole one.) This is next.", ["(A whole one.)", "This is next."]),
        ("# A heading\n\n- one item\n- another\nText (see p. 4. there) goes\non. Ends", ["# A heading", "- one item", "- another", "Text (see p. 4. there) goes\non.", "Ends"]),
        ("Ends here.Notre suite.", ["Ends here.", "Notre suite."]),
        ("The file a.md is 1.5 MB.", ["The file a.md is 1.5 MB."]),
        ("这是一。“那是二！”他喊道。第三句？", ["这是一。", "“那是二！”他喊道。", "第三句？"]),
        ("「一つ。二つ。」と彼は言った。次の文。", ["「一つ。二つ。」と彼は言った。", "次の文。"]),
        ("यह एक है। वह दो है।", ["यह एक है।", "वह दो है।"]),
        ("บทใหม่ย่อเอกสาร ทีมแก้ไขร่าง", ["บทใหม่ย่อเอกสาร", "ทีมแก้ไขร่าง"]),
        ("   \n\t ", []),
        ("", []),
    ],
)
def test_sentences(text, parts):
    assert [text[a:b] for a, b in sentence_spans(text, LEXICON)] == parts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\n\"'“”(«»)-#1。」「\r ", max_size=120))
def test_sentences_hold_all_text_once(text):
    spans = sentence_spans(text, LEXICON)
    at = 0
    for a, b in spans:
        assert a >= at and b > a and not text[a].isspace() and not text[b - 1].isspace()
        assert not text[at:a].strip()
        at = b
    assert not text[at:].strip()


def test_evidence_of_abbreviations():
    found = evidence("See Fig. 3 and approx. the end. We left")
    assert ("d", "Fig") in found and ("a", "approx") in found


def test_turns():
    text = "[00:00:09] Dr. Lee: later.\n[00:00:01] Ann Poe: um, hello hello there.\n[00:00:02] ANN: (laughs)\n[00:00:03] A.P.: and more\n[00:00:05] Host: one"
    people = [("Ann Poe", "guest"), ("Kim Lee", "host")]
    got = [(k, s, t) for k, s, _, _, t in turns_of(text, people)]
    assert got == [(1, 1, "hello there. and more"), (2, 2, "one later.")]
    assert [t[:2] for t in turns_of("just words\nwithout names", [])] == [(1, 1)]
    assert list(turns_of("(laughs)\n[music]", people)) == []
    assert list(turns_of("", people)) == []


def test_numbered_speakers_and_labels():
    cast = Cast([("Ann Poe", "guest"), ("Ann Ray", "guest"), (None, None)])
    assert cast.resolve("SPEAKER_02") == cast.resolve("speaker 2") == cast.resolve("Spk 2") == {"#2"}
    assert cast.resolve("Ann") == {"ann poe", "ann ray"} and cast.resolve("Poe") == {"ann poe"} and cast.resolve("nobody") == set()
    assert clean("So, uh, [music] the the end") == "So, the end" and not is_speech("Hmm... (laughs)")


def test_leak_coverage_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        item = [rng.choice("abcd") for _ in range(12)]
        doc = [rng.choice("abcd") for _ in range(40)]
        if rng.random() < 0.5:
            k = rng.randrange(30)
            doc[k : k + 7] = item[2:9]
        want = {p for i in range(12 - 3) for j in range(40 - 3) if item[i : i + 4] == doc[j : j + 4] for p in range(i, i + 4)}
        assert covered(item, doc, 4) == len(want)


def test_equal_windows_share_cgk_keys():
    stream = np.array([3, 9, 4, 1, 5, 9, 2, 6, 5, 3, 9, 4, 1, 5, 9, 2], dtype=np.uint64) << np.uint64(40)
    (keys,) = cgk_keys(stream, 6, None, 1)
    assert keys[0] == keys[9] and len(set(keys.tolist())) == len(keys) - 1 - 1 + (keys[1] != keys[10])
    assert repetitions(6, 3, 0, 0.95) == 1 and repetitions(6, 3, 1, 0.95) > 1


def test_plain_text_of_markup():
    assert leak_units(plain("**Explain** why [suvra](https://x.example/a) moss­, ＡＢ"), False) == ["explain", "why", "suvra", "moss", "ab"]


def test_kept_in_order_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert kept_in_order(a, b) == table[-1][-1]
    assert similar(list("abcdefghij"), list("abcdefghxx")) and not similar(list("abcdefghij"), list("abcdefgxxx")) and not similar([], [])


def test_passages_and_marks():
    rng = np.random.default_rng(0)
    stream = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    starts = passages(stream, 14)
    assert starts[0] == 0 and max(np.diff(starts)) <= 56
    changed = stream.copy()
    changed[2500] = 1
    a, b = set(marks_of(stream, 14).tolist()), set(marks_of(changed, 14).tolist())
    assert len(a & b) >= len(a) - 4
    assert simhash(np.empty(0, np.uint64)) == 0 and len(shingles(stream[:3], 5)) == 1
    assert normal("ＡＢ c") == "ab c" and units("ab中文 c") == ["ab", "中", "文", "c"] and len(Hasher()(["a", "a"])) == 2


@pytest.mark.parametrize("text", ["Hi {{ name }}", "[INSERT TITLE HERE]", "${article.x}", "a %%BODY_TEXT%% b", "[object Object]", "__TITLE__", "<!-- intro goes here -->", "[hier Titel einfügen]", "Dear {FirstName}"])
def test_slots(text):
    assert has_slot(text) and not has_slot(f"the code `{text}` shows") and not has_slot(f"```\n{text}\n```")


@pytest.mark.parametrize("text", ["[[link]] and [a](b) #tag", "cost 50% of 30%", "f(x) = {1, 2}", "", "* [Shop](/0)"])
def test_no_slots(text):
    assert not has_slot(text)


def test_residue_bodies():
    ordinary = frozenset("the a of and archive keeps every page note in this story about".split())
    words = lambda t: units(normal(t))
    for t in ("Please enable JavaScript to go on", "# Oops! we could not load this item.", "Sample text. Sample text. Sample text.", "jewjh qkefjfw qqjehfs rsgj hfaeg qaf", "", "## \n"):
        assert is_residue(t, words(t), ordinary), t
    for t in ("The archive keeps every page of this story and the note about a page in the archive.", 'The note says "please enable JavaScript" and the archive keeps this page.'):
        assert not is_residue(t, words(t), ordinary), t


def test_streams_align_into_one_expression():
    e = Expression()
    assert e.align([1, 2, 3, 4]) == ([], set())
    assert e.align([1, 9, 3, 8, 8, 4]) == ([1, 3, 4], {8})  # 2 and 9 are optional, 8 repeats
    assert e.align([4, 1, 9, 8]) == ([1, 9, 8], set()) and e.align([]) == ([], set())  # 4 is out of order
    places = sorted(e.place, key=e.place.get)
    assert [k for k in places if k in (1, 3, 4)] == [1, 3, 4] and places.index(1) < places.index(9) < places.index(3)


def test_filler_without_phrases():
    ordinary = frozenset("the a of and archive keeps every page note in this story about".split())
    words = lambda t: units(normal(t))
    mash = "qwer tyui asdf text text foo bar baz text text foo bar baz qwer tyui asdf " * 4
    assert is_residue(mash, words(mash), ordinary | {"text", "bar"}) and not is_residue("the page of the note " * 3 + "is about a story in the archive and every note", words("the page of the note " * 3 + "is about a story in the archive and every note"), ordinary)


def test_page_lines():
    page = "Shop\nHome\n\n# Title\n\nA body line that says something.\n\n12 comments, join\n\nAnother body line here.\n© 2020 x.example. All rights reserved."
    known = {key_of(k) for k in ("Shop", "Home", "\x02 comments, join", "© \x02 \x01. All rights reserved.")}
    assert chrome_lines(page, "x.example", known.__contains__) == [1, 2, 8, 11]
    assert chrome_lines("", "x", known.__contains__) == [] and token(" ", "") is None
    assert host_of(None, "HTTPS://www.X.example:80/a") == "x.example" and host_of("clip/a.md") == ""


def test_language_mixture():
    english = "the notes of the archive are kept in the vault and every reader keeps this page " * 4
    french = "les notes des archives sont gardées dans le coffre et chaque lecteur garde cette page " * 4
    model = fit([("en", english)] * 3 + [("fr", french)] * 3)
    assert isinstance(model, Model)
    scores = model.score(["the reader keeps the notes", "chaque lecteur garde les notes"]).astype(float)
    assert scores.argmax(axis=1).tolist() == [0, 1] and (mixture(scores) > 0).all()
    assert prose_lines("```\ncode\n```\n123\nText", [9]) == [(5, "text")]


@pytest.mark.parametrize("text", ["[Überschrift einfügen]", "[Écran ici]", "[3 photos to come]", "[[INSERT NAME]]", "[[placeholder:x]]", "[вставить имя]"])
def test_slots_after_any_bracket(text):
    assert _SLOT.search(text) and has_slot(f"a {text} b")
