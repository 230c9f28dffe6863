"""The training-data operators on small tables: results, nulls, empty and repeated rows, extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from tesserine.llm.chunking import chunk
from tesserine.llm.history import accept, fingerprint, kept_in_order, repeats, similar
from tesserine.llm.fingerprints import Units, normal, units
from tesserine.llm.languages import label_code, languages, missing_labels, train
from tesserine.llm.leakage import leaks, within
from tesserine.llm.mixing import mix, shares
from tesserine.llm.residue import residue
from tesserine.llm.sentences import sentences
from tesserine.llm.turns import speaker_turns
from tesserine.llm.wrappers import main_bodies

WORDS = "archive vault reader note page story graph record outline query table section margin letter ledger".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def test_chunk_tables(spark):
    docs = spark.createDataFrame([(1, "a b. " * 100, "x"), (1, "a b. " * 100, "x"), (2, None, "x"), (3, "", "x"), (4, "short", None)], "rec_id long, content string, text string")
    configs = spark.createDataFrame([(1, 100, 10, 5), (2, None, 3, 5), (3, 0, 1, 5), (4, 60, None, 5)], "config_id int, chunk_size int, chunk_overlap int, piece_no int")
    rows = chunk(docs, configs).collect()
    assert {r["config_id"] for r in rows} == {1, 4} and {r["rec_id"] for r in rows} == {1, 4}
    assert all(len(r["text"]) == r["end_pos"] - r["start_pos"] <= 100 for r in rows)
    assert not chunk(docs.limit(0), configs).count() and not chunk(docs, configs.limit(0)).count()


def test_history_against_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, 80) for _ in range(20)]
    rows = []
    for k in range(60):
        words = texts[rng.randrange(20)].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
        text = " ".join(words)
        rows.append((k, None if k == 0 else int(k >= 20), text.upper() + "!" if rng.random() < 0.3 else text, "x"))
    rows += [(100, 1, None, "x"), (101, 1, " ! ", "x"), (rows[30][0], 1, rows[30][2], "x")]
    table = spark.createDataFrame(rows, "rec_id long, batch_no int, body string, mark string")
    got = {(r[0], r[1]) for r in repeats(fingerprint(table), table).collect()}
    split = {r[0]: units(normal(r[2] or "")) for r in rows}
    want = set()
    for k in range(20, 60):
        first = next((j for j in range(k) if similar(split[j], split[k])), None)
        if first is not None:
            want.add((first, k))
    assert got == want and len(want) > 15
    empty = table.limit(0)
    assert repeats(fingerprint(empty), empty).count() == 0


def test_hot_group_of_near_copies_is_whole(spark):
    rng = random.Random(6)
    base = prose(rng, 120).split()
    rows = [(0, 0, " ".join(base))]
    for k in range(1, 80):
        words = list(base)
        words[rng.randrange(120)] = f"new{k}"
        rows.append((k, 1, " ".join(words)))
    table = spark.createDataFrame(rows, "rec_id long, batch_no int, body string")
    assert {(r[0], r[1]) for r in repeats(fingerprint(table), table).collect()} == {(0, k) for k in range(1, 80)}


def test_residue_spreads_to_copies_only(spark):
    rng = random.Random(7)
    good = [(k, prose(rng, 60)) for k in range(12)]
    filler = "Your story starts in this box. " * 6
    rows = [(*g, False, 1) for g in good] + [(50, filler, False, 1), (51, "x {{ slot }} y", True, 1), (52, "", None, 1), (53, None, None, 1), (51, "x {{ slot }} y", True, 1)]
    table = spark.createDataFrame(rows, "rec_id long, body string, marked boolean, mark int")
    got = {r["rec_id"]: r["reason"] for r in residue(table).collect()}
    assert got == {50: "notice or filler", 51: "slot", 52: "notice or filler"}
    assert residue(table.limit(0)).count() == 0


def test_main_bodies(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        host = f"h{k % 3}.example"
        body = "\n\n".join(prose(rng, 40) + "." for _ in range(3))
        rows.append((k, f"https://{host}/{k}", f"Shop\nAbout {host}\n{body}\n© 20{k % 30:02d} {host} all rights\nBack to top", None, "x"))
    rows += [(100, None, "only text", None, "x"), (101, "bad url", None, None, "x"), (102, "https://h0.example/", "", None, "x")]
    table = spark.createDataFrame(rows, "rec_id long, url string, content string, provenance struct<requested_url:string,resolved_url:string,extracted_url:string>, host string")
    got = {r["rec_id"]: r for r in main_bodies(table).collect()}
    assert len(got) == 63 and got[101]["body"] is None and got[100]["chrome"] == [] and got[102]["body"] == ""
    assert all(got[k]["chrome"] == [1, 2, 8, 9] for k in range(60))


def test_languages(spark):
    english = "the notes of the archive are kept in the vault and every reader keeps this page for the letters"
    french = "les notes des archives sont gardées dans le coffre et chaque lecteur garde cette page pour les lettres"
    docs = spark.createDataFrame([(english * 3, "en"), (french * 3, "fr-FR"), (english * 2, "English"), (french * 2, "fra"), (french, None), (None, "en")], "text string, lang string")
    model = train(docs)
    assert model.names == ["en", "fr"]
    bodies = spark.createDataFrame([(1, f"{english}\n{french}\n{english}", []), (2, french, None), (3, None, None), (4, "", [])], "rec_id long, text string, chrome array<int>")
    found = languages(bodies, model)
    assert {(r[0], r[1], r[2]) for r in found.collect()} == {(1, 0, "en"), (1, 2, "fr"), (2, 0, "fr"), (3, 0, None), (4, 0, None)}
    sources = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "rec_id long, source_file string")
    syn = spark.createDataFrame([("a", "EN_us"), ("b", "und"), (None, "fr")], "source_file string, language string")
    assert {(r[0], r[1], r[2]) for r in missing_labels(found, sources, syn).collect()} == {(1, 2, "fr"), (2, 0, "fr")}


@pytest.mark.parametrize("label, code", [("EN", "en"), ("pt-BR", "pt"), ("German", "de"), ("jpn", "ja"), ("  ", None), ("n/a", None), ("unknown", None), ("xx", None), (None, None), ("und", None)])
def test_label_codes(spark, label, code):
    assert spark.createDataFrame([(label,)], "l string").select(label_code(F.col("l"))).first()[0] == code


def test_leaks(spark):
    item = "Explain why suvra moss shuns trathei walls above many feet today"
    docs = spark.createDataFrame([(1, f"x {item.upper()}! y"), (2, "explain why suvra moss shuns trathei and stop"), (3, None), (4, ""), (5, "请写出流入某湾的某河名称并说明理由和出处")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "en", item, 0), (8, "zh", "请写出流入某湾的某河名称，并说明理由和出处。", 0), (9, "en", None, 0), (10, "en", "too short", 0)], "item_id long, lang string, text string, doc_id int")
    assert {(r[0], r[1]) for r in leaks(docs, items).collect()} == {(1, 7), (2, 7), (5, 8)}
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_mix_reaches_targets_within_caps(spark):
    rng = random.Random(9)
    docs = [(k, "big" if k % 10 < 7 else "small" if k % 10 < 9 else None, rng.randrange(5, 50)) for k in range(3000)]
    sized = spark.createDataFrame([*docs, (9000, "big", 0)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "big", 0.3, 2), ("m", "small", 0.6, 3), ("m", "absent", 0.1, 3), ("n", "big", 1.0, 1), ("z", None, None, None)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = mix(sized, targets, seed=4)
    rows = {(r["mix_name"], r["source"]): r for r in shares(mixed, targets, sized).collect()}
    assert abs(rows["m", "big"]["actual_share"] - 1 / 3) < 0.01 and abs(rows["m", "small"]["actual_share"] - 2 / 3) < 0.01 and rows["m", "absent"]["tokens"] == 0
    assert rows["m", "small"]["most_copies"] == 3 and rows["n", "big"]["tokens"] == rows["n", "big"]["available"]
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mix(sized, targets, seed=4).collect()))
    assert mix(sized.limit(0), targets).count() == 0 and mix(sized, targets.limit(0)).count() == 0


def test_sentences_table(spark):
    docs = spark.createDataFrame([(1, "One here. Two there.", "x"), (1, "One here. Two there.", "x"), (2, None, "x"), (3, "  ", "x")], "doc_id long, text string, sent_no string")
    assert sorted(map(tuple, sentences(docs).collect())) == sorted([(1, 1, 0, 9), (1, 2, 10, 20)] * 2)
    assert sentences(docs.limit(0)).count() == 0


def test_turn_tables(spark):
    rows = [(1, " e ", "Ann: hello\nBo: hi", "2024"), (1, " e ", "Ann: hello\nBo: hi", "2024"), (2, None, "no names", "2024"), (3, "e", None, None), (4, "gone", "", "2024")]
    said = spark.createDataFrame(rows, "transcript_id long, identity string, text string, acquired_at string")
    episodes = spark.createDataFrame([("e", [("Ann Poe", "host"), ("Bo Ray", None)])], "identity string, participants array<struct<name:string,role:string>>")
    assert sorted((r[0], r[1], r[2]) for r in speaker_turns(said, episodes).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]
    assert speaker_turns(said.limit(0), episodes).count() == 0 and speaker_turns(said, episodes.limit(0)).count() == 2  # without a cast the names are text


def pairs_found(spark, rows):
    table = spark.createDataFrame(rows, "rec_id long, batch_no int, body string")
    return {(r[0], r[1]) for r in repeats(fingerprint(table), table).collect()}


def test_batches_one_by_one_equal_all_at_once(spark, tmp_path):
    rng = random.Random(13)
    texts = [prose(rng, 70) for _ in range(12)]
    rows = []
    for k in range(48):
        words = texts[rng.randrange(12)].split()
        for _ in range(rng.randrange(12)):
            words[rng.randrange(70)] = f"new{rng.randrange(1000)}"
        rows.append((k, k // 12, " ".join(words)))
    table = spark.createDataFrame(rows, "rec_id long, batch_no int, body string")
    folder, got = f"file://{tmp_path}/prints", set()
    for batch in range(4):
        part = table.filter(F.col("batch_no") == batch)
        found = accept(folder, fingerprint(part), table)
        if batch:
            got |= {(r[0], r[1]) for r in found.collect()}
    split = [r[2].split() for r in rows]
    want = {(next(j for j in range(k) if similar(split[j], split[k])), k) for k in range(12, 48) if any(similar(split[j], split[k]) for j in range(k))}
    assert got == want and len(want) > 10
    again = accept(folder, fingerprint(table.filter("batch_no = 3")), table)  # a batch given twice is appended once
    assert spark.read.parquet(folder).count() == 48 and {(r[0], r[1]) for r in again.collect()} == {p for p in want if p[1] >= 36}


def test_tables_of_articles_stay(spark):
    rng = random.Random(14)
    own = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    rows = []
    for k in range(5000):
        table = "\n".join(f"| {own()} | {rng.randrange(100)} | {rng.randrange(100)} | {rng.choice(WORDS)} of {own()} |" for _ in range(3))
        menu = "Home | About | 12 | Contact" if k % 2 else "Home\nAbout"
        rows.append((k, f"https://h{k % 40}.example/{k}", f"{menu}\n\n{prose(rng, 20)}.\n\n| name | 1 | 2 | text |\n|---|---|---|---|\n{table}\n\n{prose(rng, 20)}.\n\nBack to top", None))
    sources = spark.createDataFrame(rows, "rec_id long, url string, content string, provenance struct<requested_url:string,resolved_url:string,extracted_url:string>")
    last = F.size(F.split("content", "\n"))
    want = sources.select("rec_id", F.when(F.col("rec_id") % 2 == 0, F.array(F.lit(1), F.lit(2), last)).otherwise(F.array(F.lit(1), last)).alias("chrome"))
    assert main_bodies(sources).select("rec_id", "chrome").exceptAll(want).count() == 0


def test_block_of_unlike_bodies_hides_no_pair(spark):
    rng = random.Random(10)
    common = prose(rng, 120)  # a passage that 40 bodies share, of which only the last two are alike
    own = [prose(rng, 120) for _ in range(39)]
    rows = [(k, 0, f"{common} {t}") for k, t in enumerate(own)]
    words = own[38].split()
    words[::4] = ["changed"] * len(words[::4])
    rows.append((39, 1, f"{common} {' '.join(words)}"))
    assert pairs_found(spark, rows) == {(38, 39)}


def test_drifting_copies_find_the_earliest(spark):
    rng = random.Random(11)
    texts, words = [], prose(rng, 100).split()
    for _ in range(60):  # each copy changes words of the one before, so the first is soon unlike
        texts.append(list(words))
        for _ in range(3):
            words[rng.randrange(100)] = f"drift{rng.randrange(10**6)}"
    want = {(next(j for j in range(k) if similar(texts[j], texts[k])), k) for k in range(1, 60)}
    assert pairs_found(spark, [(k, int(k > 0), " ".join(t)) for k, t in enumerate(texts)]) == want


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("length", [30, 120, 200, 450, 1000])
def test_edits_in_every_passage_hide_few_bodies(spark, wide, length):
    rng = random.Random(length)
    unit = (lambda: chr(0x4E00 + rng.randrange(1500))) if wide else (lambda: f"w{rng.randrange(1500)}")
    rows, pairs = [], 0
    for rate in (0.05, 0.1, 0.15, 0.19):
        for _ in range(20):
            words = [unit() for _ in range(length)]
            rows.append((2 * pairs, 0, ("" if wide else " ").join(words)))
            for at in rng.sample(range(length), int(rate * length)):
                words[at] = unit()
            rows.append((2 * pairs + 1, 1, ("" if wide else " ").join(words)))
            pairs += 1
    found = pairs_found(spark, rows)
    assert found <= {(2 * k, 2 * k + 1) for k in range(pairs)} and len(found) >= 0.9 * pairs


def test_residue_spreads_to_edited_copies(spark):
    rng = random.Random(12)
    rows = []
    for k in range(20):
        filler = [f"placeholder {prose(rng, 9)}." for _ in range(8)]
        edited = [*filler[:4], filler[4].replace("placeholder", "changed"), *filler[5:]]  # a shingle similarity of 71 / 81
        rows += [(2 * k, " ".join(filler)), (2 * k + 1, " ".join(edited))]
    table = spark.createDataFrame([(k, t, False) for k, t in rows], "rec_id long, body string, marked boolean")
    got = {r["rec_id"]: r["reason"] for r in residue(table).collect()}
    assert all(got[2 * k] == "notice or filler" for k in range(20)) and sum(got.get(2 * k + 1) == "copy of residue" for k in range(20)) >= 18


def test_menu_of_any_length_is_page(spark):
    rng = random.Random(15)
    menu = " | ".join(f"[Part {chr(97 + k)}{chr(97 + k // 3)} of the site](https://site.example/{'x' * 20}/{k})" for k in range(26))
    rows = [(k, f"https://h{k % 4}.example/{k}", f"{menu}\n\n{prose(rng, 400)}.\n\n{prose(rng, 400)}.", None) for k in range(60)]
    sources = spark.createDataFrame(rows, "rec_id long, url string, content string, provenance struct<requested_url:string,resolved_url:string,extracted_url:string>")
    assert len(menu) > 600 and [r["chrome"] for r in main_bodies(sources).collect()] == [[1]] * 60


def test_unlike_bodies_are_told_early_and_alike_ones_exactly():
    rng = random.Random(16)
    both = set()
    for _ in range(3000):
        a = [rng.randrange(rng.choice((3, 30, 300))) for _ in range(rng.randrange(1, 200))]
        b = a[rng.randrange(1 + len(a) // 5) :]
        for at in rng.sample(range(len(b)), rng.randrange(1 + len(b) // 4)):
            b[at] = -1
        b[len(b) // 2 : len(b) // 2] = [rng.randrange(30) for _ in range(rng.randrange(1 + len(a) // 6))]
        want = kept_in_order(a, b) >= 0.8 * max(len(a), len(b))
        assert similar(a, b) is want and similar(b, a) is want
        both.add(want)
    assert both == {True, False}

    class Unit(int):
        looked = 0

        def __hash__(self):
            Unit.looked += 1
            return int.__hash__(self)

    a, b = list(range(2000)), [Unit(k) for k in rng.sample(range(2000), 2000)]
    assert not similar(a, b) and Unit.looked < 1500  # before, all 2,000 were looked up


def test_edited_items_are_found_with_edits(spark):
    rng = random.Random(17)
    rows, items = [], []
    for k in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        items.append((k, "en", " ".join(words)))
        words[4::5] = [f"x{rng.randrange(10**6)}" for _ in words[4::5]]  # no six words stay
        rows += [(k, "a b " + " ".join(words) + " c"), (100 + k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)))]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, lang string, text string")
    assert leaks(docs, table).count() == 0
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs, table, edits=2).collect()}
    assert got == {(k, k) for k in range(20)}


def test_edit_distance_of_stretches():
    rng = random.Random(18)
    for _ in range(2000):
        window, text = tuple(rng.choices("abc", k=rng.randrange(1, 9))), rng.choices("abc", k=rng.randrange(12))
        row = list(range(len(window) + 1))
        best = row[-1]
        for u in text:
            new = [0]
            for i, w in enumerate(window):
                new.append(min(row[i] + (w != u), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        for edits in range(4):
            assert within(window, text, edits) is (best <= edits)


def test_all_copies_of_residue_are_found(spark):
    rng = random.Random(19)
    rows = []
    for k in range(200):
        filler = [f"placeholder {prose(rng, 9)}." for _ in range(8)]
        edited = [*filler[:4], filler[4].replace("placeholder", "changed"), *filler[5:]]  # a shingle similarity of 71 / 81
        rows += [(2 * k, " ".join(filler)), (2 * k + 1, " ".join(edited))]
    words = " ".join(f"placeholder {prose(rng, 9)}." for _ in range(3)).split()
    for k in range(12):  # each is the copy of the one before, and 1.2 times as long
        rows.append((1000 + k, " ".join(words)))
        words += prose(rng, len(words) // 6).split()
    rows.append((2000, prose(rng, 80)))
    table = spark.createDataFrame([(k, t, False) for k, t in rows], "rec_id long, body string, marked boolean")
    got = {r["rec_id"]: r["reason"] for r in residue(table).collect()}
    assert got == {k: "copy of residue" if k > 1000 or k < 1000 and k % 2 else "notice or filler" for k, _ in rows if k < 2000}


def test_units_as_arrays_equal_units_as_words():
    rng = random.Random(20)
    known, back = {}, {}
    ranges = [(32, 127), (32, 0x500), (0x900, 0xF00), (0x3000, 0x3200), (0x4E00, 0x4E80), (0x1F300, 0x1F700), (0x20000, 0x20040), (95, 96), (0xD800, 0xD801)]
    for _ in range(1000):
        text = normal("".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(60))))
        words, found = units(text), Units(text)
        assert [len(w) for w in words] == found.lengths().tolist() and [ord(w[0]) for w in words] == found.first.tolist()
        assert "".join(words).encode("utf-32-le", "surrogatepass") == found.letters()
        for w, h in zip(words, found.hashes.tolist(), strict=True):
            assert known.setdefault(w, h) == h and back.setdefault(h, w) == w


PAGE = "rec_id long, url string, content string, provenance struct<requested_url:string,resolved_url:string,extracted_url:string>"


def test_pages_of_a_host_in_different_tasks_are_aligned(spark):
    rng = random.Random(21)
    rows = [
        (20 * part + k, f"https://h{k}.example/{part}", f"Rooms of {chr(97 + k)}\nShelf {chr(97 + k)}\n\n{prose(rng, 40)}.\n\n{prose(rng, 40)}.\n\nImprint {chr(97 + k)} | Desk {chr(97 + k)}", None)
        for part in range(4)
        for k in range(20)
    ]
    sources = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), PAGE)  # a task has one page of each host
    assert [r["chrome"] for r in main_bodies(sources).collect()] == [[1, 2, 8]] * 80


def test_lines_of_copies_of_one_text_are_no_page(spark):
    rng = random.Random(22)
    line, copied = "a line that copies of one text share", prose(rng, 60)
    rows = [(k, f"https://h.example/{k}", f"{copied if k >= 10 else prose(rng, 60)}.\n\n{prose(rng, 20)}.\n\n{line}", None) for k in range(60)]
    assert [r["chrome"] for r in main_bodies(spark.createDataFrame(rows, PAGE).coalesce(1)).collect()] == [[]] * 60
