"""Problem 9: sentences of texts in many languages and scripts.

Whether a period ends a sentence is decided from the document itself where it
can be: a word that stands elsewhere before a period and a lower-case word or
digit is an abbreviation, one that stands elsewhere without its period is not;
a capital after the period means little if that word is a name, that is, if
it keeps its capital inside sentences. Where the document has no such
occurrence, counts over the whole corpus decide. Scripts without case or
without periods have their own rules.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.arrow import map_rows

# Words that introduce or follow quoted speech.
_SAID = frozenset(
    "said asked noted wrote replied added says asks shouted called answered explained recalled "
    "sagte fragte schrieb meinte rief dit demande écrit écrivit demanda répondit note dijo preguntó escribió "
    "disse perguntou escreveu сказал сказала спросил спросила написал написала".split()
)
_ZH_SAID = re.compile(r"(?:说|问|喊|写|答|叫|道|认为|表示|指出|提到)(?:道)?[。！？，：]")
_KO_SAID = re.compile(r"\s?(?:라고|이라고|하고|고\s|라며|라는|는\s)")
_HI_SAID = re.compile(r"\s?(?:ऐसा|यह|ये|कहकर|कहते|—|-)")
_JA_GOES_ON = re.compile(r"\s?(?:と|って|という|の|を|が|は|に|で|も|、)")

_LINE_MARK = re.compile(r"[ \t]*(?:#{1,6}[ \t]|[-*+•][ \t]|>|\d{1,3}[.)][ \t])")
_LEAD = re.compile(r"(?:[ \t]*(?:#{1,6}[ \t]|[-*+•][ \t]|>+[ \t]?|\d{1,3}[.)][ \t]))*[ \t]*")
_SPEAKER = re.compile(r"[^\W\d_][^\n:.!?。！？]{0,50}[:：][ \t]*(?=\S)")
_SPAN = (
    r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"\n]*(?:\n[^\"\n]+)*\""
    r"|\([^()]*\)|（[^（）]*）|‘[^‘’]*(?:’(?=\w)[^‘’]*)*’(?!\w)|(?<![\w’'])'(?=\w)(?:[^'\n]|\n(?!\n)|(?<=\w)'(?=\w))*'(?!\w)"
)
_TOKEN = re.compile(rf"(?P<span>{_SPAN})|(?P<wide>[。！？]+[」』”’）]*)|(?P<danda>[।॥؟۔]+[”’»\")\]]*)|(?P<hard>[!?][!?.…]*(?:[\"'”’»)\]]+(?!\w))?)|(?P<dots>\.{{2,}}|…+)|(?P<dot>\.(?:[\"'”’»)\]]+(?!\w))?)")
_SPANS = re.compile(_SPAN)
_ENDS = re.compile(r"[.!?…。！？।؟][\s]*$")
_WORD_BEFORE = re.compile(r"[^\s\"“„«»”(（\[「『,;:]+$")
_ADDRESS = re.compile(r"(?:www\.|://|/|@)")
_WORD_AFTER = re.compile(r"[\"“„«‘'(\[]*([^\W\d_]+(?:[-’'][^\W\d_]+)*)")
_THAI = re.compile(r"[฀-๿]")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")
_LAST_WORD = re.compile(r"(?<![\w.])[^\W\d_]{1,8}(?:\.[^\W\d_]{1,8})*$")
_FIRST_WORD = re.compile(r"\s+[\"“„«(]*(?:([^\W\d_]+)|(\d))|(,)")
_LONG_END = re.compile(r"[^\W\d_]{6,}$")
_MARKS = re.compile("[“„«\"(（‘'「『。！？।॥؟۔!?.…]")
_STOP = re.compile(r"[。！？]")
_BLANKS = re.compile(r"[ \t\r\n]+")
_LETTERS = re.compile(r"[^\W\d_]+")


class Lexicon:
    """Corpus counts that settle what a document leaves open."""

    def __init__(self, abbreviations=(), starters=()):
        self.abbreviations, self.starters = frozenset(abbreviations), frozenset(starters)


def evidence(text: str) -> set[tuple[str, str]]:
    """What one text says about abbreviations and sentence starts.

    Pairs: ("a", w) w stands before a period and a lower-case word or comma;
    ("d", w) before a period and a digit; ("c", w) before a period and a
    capital; ("f", w) without a period; ("s", w) starts a sentence.
    """
    found: set[tuple[str, str]] = set()
    pieces = text.split(".")
    dotted = set()
    for left, right in zip(pieces, pieces[1:]):
        tail = left[-9:]
        m = _FIRST_WORD.match(right)
        if not m:
            continue
        word = _LAST_WORD.search(tail)
        if word is None:
            if m[1] and m[1][0].isupper() and _LONG_END.search(tail):
                found.add(("s", m[1]))
            continue
        if left is not pieces[0] and len(left) == len(word[0]):
            continue  # inside a dotted word; its last letter group tells
        nxt = m[1]
        kind = "d" if m[2] else "a" if m[3] or nxt[0].islower() else "c" if nxt[0].isupper() else None
        if kind:
            found.add((kind, word[0]))
            dotted.add(word[0])
            if kind == "c" and len(word[0]) >= 6:
                found.add(("s", nxt))
    for part in text.split("\n\n"):
        m = _LETTERS.match(part)
        if m and m[0][0].isupper():
            found.add(("s", m[0]))
    if dotted:
        found.update(("f", w) for w in dotted.intersection(text.replace(",", " ").split()))
    return found


class _Document:
    """One text's own evidence, gathered when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self._words = None
        self._own = None

    def words(self) -> frozenset:
        if self._words is None:
            self._words = frozenset(self.text.replace(",", " ").split())
        return self._words

    def own(self) -> set:
        if self._own is None:
            self._own = evidence(self.text)
        return self._own


def _abbreviation(word: str, doc: _Document, lexicon: Lexicon) -> bool:
    if not word or word[-1].isdigit():
        return False
    letters = word.rstrip(".")
    if len(letters) == 1 and letters.isalpha() or "." in letters and all(len(p) <= 3 for p in letters.split(".")):
        return True
    if len(letters) > 8:
        return False
    if letters in doc.words():
        return False  # the document has it without a period
    if letters in lexicon.abbreviations:
        return True
    return len(letters) <= 4 and ("a", letters) in doc.own()


def _starts_sentence(word: str, doc: _Document, lexicon: Lexicon) -> bool:
    """Whether a capitalised word after an abbreviation is a sentence's first rather than a name."""
    return word in lexicon.starters or word.lower() in doc.words()


def _opens(text: str, at: int, end: int, closed: str, spanning: bool) -> bool:
    """Whether text[at:] can begin a sentence after a terminator or a closed span that ended at `at`."""
    i = at
    while i < end and text[i].isspace():
        i += 1
    if i >= end:
        return True
    c = text[i]
    if c in ",;:)]}»”’—–、，；：）」』" or c == "-" and i > at:
        return False
    if c.islower():
        return False
    if not spanning:
        return i > at or not (c.isalnum() and c.isascii() and not c.isupper())
    if closed in "」』" or "぀" <= c <= "ヿ":
        return not _JA_GOES_ON.match(text, at)
    if "一" <= c <= "鿿":
        stop = _STOP.search(text, i, end)
        clause = text[i : stop.end() if stop else end]
        return len(clause) > 24 or not _ZH_SAID.search(clause)
    if "가" <= c <= "힣":
        return i > at and not _KO_SAID.match(text, at)
    if "ऀ" <= c <= "ॿ":
        return not _HI_SAID.match(text, at)
    if "฀" <= c <= "๿":
        return i > at
    if i == at:
        return False
    words = _LETTERS.findall(text, i, min(end, i + 70))[:4]
    for k, w in enumerate(words):
        if k and w in _SAID:
            return False
        if w[0].islower() and k:
            break
    return True


def _splits(text: str, start: int, end: int, doc: _Document, lexicon: Lexicon, thai: bool) -> list[int]:
    """Ends of the sentences of one block text[start:end], without the last."""
    out: list[int] = []
    first = _LEAD.match(text, start, end).end()
    speaker = _SPEAKER.match(text, first, end)
    begin = speaker.end() if speaker and speaker.end() - first < 52 else first
    b = begin
    while hit := _MARKS.search(text, b, end):
        m = _TOKEN.match(text, hit.start(), end)
        if m is None:
            b = hit.end()
            continue
        a, b = m.span()
        if b >= end and m.lastgroup != "span":
            break
        kind = m.lastgroup
        if kind == "span":
            inner = text[a + 1 : b - 1]
            if not _ENDS.search(inner):
                continue
            at_start = not text[begin:a].strip()
            round_one = text[a] in "(（"
            if round_one and not at_start or not _opens(text, b, end, text[b - 1], True):
                continue
            if at_start and not (round_one and b >= end and a > start):
                inside = _splits(text, a + 1, a + 1 + len(inner.rstrip()), doc, lexicon, thai)
                out.extend(inside)
            if b < end:
                out.append(b)
            begin = b
            continue
        if kind == "wide":
            if text[b : b + 1] in "，、）":
                continue
        elif kind == "danda":
            if not _opens(text, b, end, "", False):
                continue
        elif kind == "hard":
            if not _opens(text, b, end, "", False):
                continue
            if not text[b].isspace() and not (text[b].isupper() or text[b] in "\"“„«(¿¡" or ord(text[b]) > 0x2FF and text[b].isalpha()):
                continue
        elif kind == "dots":
            nxt = text[b:end].lstrip()[:1]
            if not text[b].isspace() or not (nxt.isupper() or nxt in "\"“„«(¿¡"):
                continue
        elif not _dot_ends(text, begin, a, b, end, doc, lexicon):
            continue
        out.append(b)
        begin = b
    if thai:
        out = sorted({*out, *_thai_breaks(text, start, end)})
    return out


def _dot_ends(text: str, begin: int, a: int, b: int, end: int, doc: _Document, lexicon: Lexicon) -> bool:
    before = _WORD_BEFORE.search(text, max(begin, a - 60), a)
    word = before[0] if before else ""
    nxt = text[b]
    if not nxt.isspace():
        if b > a + 1 or not word or _ADDRESS.search(word) or word[-1].isdigit() and nxt.isdigit():
            return b > a + 1 and nxt.isupper()
        if nxt in "¿¡“„«(":
            return len(word) > 2 and not _abbreviation(word, doc, lexicon)
        if not nxt.isupper() and not ("ऀ" <= nxt <= "ॿ" or "؀" <= nxt <= "ۿ" or "가" <= nxt <= "힣"):
            return False
        tail = word.rpartition(".")[2]
        if len(tail) < 2 or not (tail[-1].islower() or tail[-1].isdigit() or not tail[-1].isascii()) or "." in word:
            return False
        if nxt.isupper() and not (b + 1 < end and (text[b + 1].islower() or text[b + 1].isspace() or text[b + 1] in "’'.")):
            return False
        return not _abbreviation(word, doc, lexicon)
    i = b
    while i < end and text[i].isspace():
        i += 1
    if i >= end:
        return True
    nxt = text[i]
    if nxt.islower() or nxt in ",;:)—–":
        return False
    if word and _DEVANAGARI.match(word[-1]) or word and "฀" <= word[-1] <= "๿":
        return False
    if not word:
        return True
    if word.isdigit() and len(word) <= 2 and nxt.isalpha():
        after = _WORD_AFTER.match(text, i, end)
        return not after or not nxt.isupper() or _starts_sentence(after[1], doc, lexicon)
    if not _abbreviation(word, doc, lexicon):
        return True
    if nxt.isdigit():
        return False
    after = _WORD_AFTER.match(text, i, end)
    if not after:
        return True
    if not after[1][0].isupper():
        return nxt in "\"“„«(¿¡" and not word[0].isupper()
    if word[0].isupper() and (len(word) == 1 or text[after.end() : after.end() + 1] == "." and _abbreviation(after[1], doc, lexicon)):
        return False  # an initial, or one title before another
    return _starts_sentence(after[1], doc, lexicon)


def _thai_breaks(text: str, start: int, end: int) -> list[int]:
    """Blanks between two Thai clauses; those beside digits, Latin or a short title stay inside one."""
    out, last = [], start
    spans = [m.span() for m in _SPANS.finditer(text, start, end)]
    for m in _BLANKS.finditer(text, start, end):
        a, b = m.span()
        if a <= last or b >= end or any(s < a < e for s, e in spans):
            continue
        left, right = text[a - 1], text[b]
        if left in "#->:：" or left == "." and not _THAI.search(text[max(last, a - 12) : a - 4]):
            continue
        if left == "." or right.isdigit() and left != "”":
            continue
        out.append(a)
        last = b
    return out


def sentence_spans(text: str, lexicon: Lexicon | None = None) -> list[tuple[int, int]]:
    """Spans (start, end) of the sentences of text, in order, without outer white space.

    All of text but white space is in exactly one span; an empty or blank text
    has none.
    """
    lexicon = lexicon or Lexicon()
    doc = _Document(text)
    blocks: list[list[int]] = []
    at, open_block, marked = 0, False, False
    for line in text.split("\n"):
        size = len(line) + 1
        if not line.strip():
            open_block = False
        else:
            mark = _LINE_MARK.match(line) is not None
            if not open_block or mark or marked:
                blocks.append([at, at + size])
            else:
                blocks[-1][1] = at + size
            open_block, marked = True, mark
        at += size
    out = []
    for start, end in blocks:
        end = min(end, len(text))
        thai = _THAI.search(text, start, end) is not None
        last = start
        for cut in [*_splits(text, start, end, doc, lexicon, thai), end]:
            a, b = last, cut
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            last = cut
    return out


#: Share of all texts in which a word must be seen before the corpus may decide about it.
MIN_SHARE = 1e-3


def learn(df: DataFrame, text_col: str = "text") -> Lexicon:
    """Abbreviations and sentence starters of a whole corpus.

    Counts are taken over all texts, combined inside each task and summed by
    word. Only words seen in MIN_SHARE of the texts reach the driver: at most
    (bearing words of a mean text) / MIN_SHARE of them, whatever the corpus.
    """
    texts = df.select(F.col(text_col)).filter(F.length(text_col) > 0)

    def make():
        total: Counter = Counter()

        def count(row):
            total.update(evidence(row[0]))
            total["n", ""] += 1
            if len(total) > 200_000:
                yield from rest()

        def rest():
            rows = [(kind, word, n) for (kind, word), n in total.items()]
            total.clear()
            return rows

        count.close = rest  # what is left at the end of the task
        return count

    counts = map_rows(texts, "kind string, word string, n long", make).groupBy("kind", "word").agg(F.sum("n").alias("n"))
    from tesserine.runtime import materialise

    counts = materialise(counts, "evidence")
    size = (counts.filter(F.col("kind") == "n").agg(F.sum("n")).first()[0]) or 0
    kept = counts.filter((F.col("kind") != "n") & (F.col("n") >= F.greatest(F.lit(3.0), F.lit(MIN_SHARE * size)))).collect()
    return judge({(r["kind"], r["word"]): r["n"] for r in kept})


def judge(by: dict[tuple[str, str], int]) -> Lexicon:
    """Lexicon from the counts of evidence() pairs."""
    abbreviations = set()
    for word in {w for k, w in by if k in "adc"}:
        dotted, free = sum(by.get((k, word), 0) for k in "adc"), by.get(("f", word), 0)
        soft = by.get(("a", word), 0) + by.get(("d", word), 0)
        if free > 0.1 * dotted or len(word) > 1 and not (word[0].isupper() or word[0].islower()):
            continue  # stands without a period too, or is a word of a script without case
        if soft >= 0.2 * dotted or len(word) <= 5 and word[0].isupper():
            abbreviations.add(word)
    return Lexicon(abbreviations, {w for k, w in by if k == "s"})


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """Sentences of every text: the id, sent_no (from 1), start_pos, end_pos (exclusive).

    Null, empty and blank texts give no row; repeated rows give repeated
    sentences; other columns are ignored. Without a lexicon one is learnt from
    the same texts first.
    """
    known = lexicon or learn(df, text_col)
    texts = df.select(id_col, text_col).filter(F.col(text_col).isNotNull())

    def make():
        def split(row):
            key, text = row
            for k, (a, b) in enumerate(sentence_spans(text, known), 1):
                yield key, k, a, b

        return split

    return map_rows(texts, f"{id_col} {dict(df.dtypes)[id_col]}, sent_no int, start_pos int, end_pos int", make)
