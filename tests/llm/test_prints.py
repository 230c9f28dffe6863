"""Fingerprints of many bodies at once equal those of single ones."""

import random

import numpy as np
import xxhash

from tesserine.llm.fingerprints import Texts, Units, grouped, normal, shingles, wide_simhash
from tesserine.llm.history import GRAM, SKETCH, _verify, keys_of, prints_of, script_of
from tesserine.llm.wrappers import _SENTENCE
from tesserine.llm.wrappers import sentences as page_sentences

TEXTS = [
    "", " \n", "a", "Straße İstanbul ŉ ﬁ ΐ ½ ™ … ´", "Ｆｕｌｌ－ｗｉｄｔｈ　ｶﾞ ㄱㅏ 각", "𝒳𝒴 𠀀𠮷 \U0002f800", "Á́é x " * 40, "กำ น้ำ ก็ " * 60, "中文，字。" * 90, "\x00 \n\n b" * 30,
    "Éa b c " * 50 + "́", "́ begins", "क़ि हिन्दी " * 30, "word " * 31, "word " * 33, "K ſ ẞ _x_ O’Neil " * 20,
]


def test_texts_at_once_equal_single_ones():
    rng = random.Random(5)
    pools = [range(0x20, 0x250), range(0x300, 0x370), range(0x1100, 0x1200), range(0x3040, 0x3200), range(0xAC00, 0xAC80), range(0xFF00, 0xFFF0), range(0x900, 0xE80), range(0x1E00, 0x2300)]
    texts = TEXTS + ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(60))) for _ in range(300)] + ["".join(chr(rng.choice(rng.choice(pools[::5]))) for _ in range(50)) for _ in range(100)]
    words = Texts(texts)
    for k, (text, letters, a, b) in enumerate(zip(texts, words.letters(), words.offsets, words.offsets[1:])):
        one = Units(normal(text))
        assert one.hashes.tolist() == words.hashes[a:b].tolist(), ascii(text)
        assert one.first.tolist() == words.first[a:b].tolist() and one.lengths().tolist() == words.lengths()[a:b].tolist()
        assert one.letters() == letters.tobytes()


def test_prints_at_once_equal_single_ones():
    rng = random.Random(6)
    pools = [[f"w{i}" for i in range(400)], [chr(c) for c in range(0x4E00, 0x4F00)], [chr(c) for c in range(0x0E01, 0x0E2F)]]
    texts = TEXTS + [(" " if p is pools[0] else "").join(rng.choices(p, k=n)) for p in pools for n in (1, 4, 20, 31, 32, 58, 61, 72, 245, 700, 3000)] + [" ".join(["same few words over and over"] * 90)]
    met = set()
    for lo, hi in grouped(texts, 4_000):
        rows, exact, sizes, script, sketch, keys, ends = prints_of(texts[lo:hi])
        for i, k in enumerate((lo + rows).tolist()):
            words = Units(normal(texts[k]))
            kind = script_of(words)
            assert (exact[i], sizes[i], script[i]) == (xxhash.xxh3_64_intdigest(words.letters()) - (1 << 63), len(words.hashes), kind)
            assert sketch[i].tolist() == wide_simhash(np.unique(shingles(words.hashes, GRAM[kind])), SKETCH).tolist()
            assert keys[ends[i] : ends[i + 1]].tolist() == keys_of(words.hashes, kind)
            met.add(k)
    assert met == {k for k, t in enumerate(texts) if any(map(str.isalnum, t))}


def test_sentences_of_pages_equal_the_split():
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choices(".!?؟。！？। \n\taé中", k=rng.randrange(12)))
        assert page_sentences(text) == _SENTENCE.split(text), ascii(text)


def test_bodies_of_a_square_are_moved_once_for_pairs_in_either_order(spark):
    rng = random.Random(8)
    base = [rng.choices(range(500), k=80) for _ in range(30)]
    texts = [" ".join(f"w{x}" for x in (b if copy == 0 else b[:70] + b[75:])) for copy in (0, 1) for b in base]
    rows = spark.createDataFrame(list(enumerate(texts)), "rec_id long, body string")
    pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(60) if a != b], "a long, b long")
    found = {(r["a"], r["b"]) for r in _verify(pairs, rows).collect()}
    assert found == {(a, b) for a in range(60) for b in range(60) if abs(a - b) == 30}
