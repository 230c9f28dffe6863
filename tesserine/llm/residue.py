"""Problem 4: template residue, error pages and filler text.

Rules give trusted labels: unfilled slots, and bodies that are a known kind of
notice, error or filler, or made of words the corpus does not use. The labels
of whole-page residue spread to near copies by an exact similarity join of sets
of five-word shingles: a body most of whose shingles are in a bitmap of those of
labelled bodies is a candidate, and pairs that share a shingle of their prefixes
are compared. Labels propagate through the connected components that begin at a
trusted label, one round and one look at the texts a link.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.arrow import map_columns, map_rows
from tesserine.llm.fingerprints import Texts, grouped, shingles
from tesserine.runtime import materialise

# The ways an unfilled slot is written.
_SLOT = re.compile(
    r"\{\{\{?[^{}\n]{1,80}\}?\}\}|\{%[^%\n]{1,120}%\}|<%[=-]?[^%\n]{1,120}%>|<\?(?:php|=)[^?\n]{0,120}\?>|\$\{[^{}\n]{1,60}\}"
    r"|(?<![\w{$])\{[A-Za-z][A-Za-z_]{1,40}\}(?!\})|\{\d\} \w{1,10} \{\d\}|%%[A-Za-z_]{2,40}%%|(?<![\w%])%[A-Za-z]{3,30}%(?![\w%])|(?<!\w)#[A-Za-z]{2,30}_[A-Z]{2,12}#|(?<!\w)\$[A-Z]{3,20}\$"
    r"|(?<!\w)__[A-Za-z]{2,30}__(?!\w)|\[\[placeholder:[^\]\n]{1,40}\]\]|\[(?:INSERT|Insert|insert|insérer|insertar|inserir|inserire|hier|Hier|Your|YOUR|your|вставить|插入)\s[^\]\n]{1,50}\](?!\()|\[[^\]\[\n]{1,40} (?:to come|TO COME|goes here|here|HERE|einfügen|ici|aquí|aqui)\](?!\()"
    r"|<!--[^<>\n]{0,60}(?:goes here|here|ici|hier|aquí)[^<>\n]{0,10}-->|<[A-Z][a-zA-Z]{2,20}>(?!\w)|\[object Object\]|\bundefined, NaN\b|\bXX/XX/XXXX\b|\bTKTK\b|\bTODO: \w+"
)
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`", re.S)
_OPENERS = re.compile(r"\{\S|<[A-Z%?!]|%[A-Za-z%]|\$[A-Z{]|#[A-Za-z]+_|\[(?=[^\n])|__[A-Za-z]")
#: A slot in brackets has one of these.
_BRACKETED = ("[[placeholder:", "[object", "[INSERT", "[Insert", "[ins", "[hier", "[Hier", "[Your", "[YOUR", "[your", "[вставить", "[插入", " to come]", " TO COME]", " here]", " HERE]", " einfügen]", " ici]", " aquí]", " aqui]")
_WORDED = ("undefined, NaN", "XX/XX/XXXX", "TKTK", "TODO: ")
# Phrases of notices, errors and filler, by language.
_SCRIPT = re.compile(r"javascript|\bscripts?\b|スクリプト|脚本|скрипт|स्क्रिप्ट|스크립트|سكريبت|สคริปต์", re.I)
_ERROR = re.compile(
    r"\b(?:http |error |erreur |fehler |erro |ошибка )?[45]\d\d\b|\berror\b|\boops\b|\bsorry\b|not found|no longer|is not here|nothing lives|may not (?:open|view|see)|could not|cannot be|can't be|failed to|withdrawn|renamed|denied|forbidden|blocked|too many requests|too much traffic|slow down|gateway|did not answer|expired|typed wrongly|planned work|back soon|maintenance|unavailable|having a rest|try again|timed? ?out|please wait|"
    r"introuvable|n[’']existe|déplacée|erreur|refusé|indisponible|réessay|no existe|ya no|no encontrad|acceso denegado|no disponible|nicht gefunden|existiert nicht|fehler|verweigert|nicht verfügbar|nicht erreichbar|não (?:foi )?encontrad|não existe|negado|indisponível|не найден|ошибк|запрещ|недоступ|不存在|已被删除|错误|找不到|无法|拒绝|見つかり|エラー|できません|찾을 수 없|오류|거부|غير موجود|خطأ|تعذر|لم يتم العثور|नहीं मिल|त्रुटि|मौजूद नहीं|ไม่พบ|ข้อผิดพลาด",
    re.I,
)
_FILLER = re.compile(
    r"placeholder|lorem ipsum|dummy text|filler|blindtext|platzhalter|provisoire|faux[- ]texte|de relleno|texto de ejemplo|texto provisório|sample (?:paragraph|text|copy)|to be replaced|body text|insert copy|your story|copy goes here|占位|本文が入ります|ダミー|文字填充|рыба|заполнитель|текст-заглушка|자리 표시|본문이 들어|नमूना पाठ|यहाँ पाठ|نص (?:مؤقت|تجريبي|بديل)|ข้อความตัวอย่าง",
    re.I,
)
_MARKS = ".,;:!?…\"'()[]*#>-–—“”«»¿¡"
_MARK = re.compile(r"^[#>*\-\s]+")
_TRACE = re.compile(r"^\W*(?:ray|ref|id|trace|request|code)\b.{0,40}$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？।])\s*|\n+")
_QUOTED = re.compile(r"[\"“”„«»「『]")
#: Characters a notice or an error page has at most.
SHORT = 220
#: A word is ordinary if this share of the bodies has it.
WORD_SHARE = 1e-2
#: Share of ordinary words under which a text of five words or more is filler.
ORDINARY = 0.2
#: Ordinary words after which a body in which they are no rarity needs no further look.
ENOUGH = 60
#: Words of a shingle.
SHINGLE = 5
#: Base-2 logarithm of the most bits of the bitmap that is broadcast.
BITMAP = 28

def _openers(text: str) -> str:
    """The characters of text at which a slot may begin."""
    found = "".join(c for c in "{<%$" if c in text)
    if "_" in text:
        found += "#" * ("#" in text) + "_" * ("__" in text)
    return found + "[" * ("[" in text and any(b in text for b in _BRACKETED))


@cache
def _any_of(characters: str) -> re.Pattern:
    return re.compile(f"[{re.escape(characters)}]")


def has_slot(text: str) -> bool:
    """Whether text has an unfilled template slot outside code."""
    if not any(w in text for w in _WORDED):
        openers = _openers(text)
        if not openers or not any(_OPENERS.match(text, m.start()) and _SLOT.match(text, m.start()) for m in _any_of(openers).finditer(text)):
            return False
    return _SLOT.search(_CODE.sub(" ", text) if "`" in text or "~~~" in text else text) is not None


def words_of(body: str) -> Iterator[str]:
    """What stands between white space, folded, without marks around it."""
    for w in body.split():
        w = w.strip(_MARKS)
        if w:
            yield w.casefold()


def is_residue(body: str, words: Iterable[str], ordinary) -> bool:
    """Whether a main body (and its words) is nothing but a notice, an error message or filler."""
    text = body
    if len(body) <= 3 * SHORT:
        lines = [t for t in (_MARK.sub("", x).strip() for x in body.split("\n")) if t]
        core = [t for t in lines if not _TRACE.match(t)]
        if not core:
            return True
        text = "\n".join(core)
        if len(text) <= SHORT and len(core) <= 3 and "`" not in text:
            notice = bool(_SCRIPT.search(text))
            if not _QUOTED.search(text) and (notice or _ERROR.search(text)) and len(_SENTENCE.split(text)) <= 4 and all(len(t) < 130 for t in core):
                return len(text) < 130 or notice and len(text) < 180
    first = _MARK.sub("", _SENTENCE.split(text.strip(), maxsplit=1)[0]).strip()
    if first and (_FILLER.search(first[:200]) or text.count(first) > 1):
        parts = [q for q in (_MARK.sub("", p).strip() for p in _SENTENCE.split(text)) if q]
        seen = Counter(parts)
        if len(parts) > len(seen) and all(n > 1 or _FILLER.search(p) for p, n in seen.items()) or all(len(p) < 120 and _FILLER.search(p) for p in seen):
            return True
    if len(text) > 1000:  # most end here, with the words up to some place
        begin = [w for w in (w if w.isalpha() else w.strip(_MARKS) for w in text[:900].casefold().split()[:-1]) if w.isascii() and w.isalpha()]
        common = sum(map(ordinary.__contains__, begin))
        if common > ENOUGH and common > 0.3 * len(begin):
            return False
    common, plain, letters = 0, 0, 0
    seen = []
    for w in words:
        seen.append(w)
        letters += len(w)
        if w.isascii() and w.isalpha():
            plain += 1
            letters -= len(w)
            common += w in ordinary
            if common > ENOUGH and common > 0.3 * plain:
                return False
    return plain >= 5 and letters < 0.2 * sum(map(len, seen)) and (common < ORDINARY * plain or repetitive(seen))


def repetitive(words: list[str]) -> bool:
    """Whether a text of twelve words or more only repeats a handful of them."""
    return len(words) >= 12 and len(set(words)) ** 2 <= 2 * len(words)


def ordinary_words(bodies: DataFrame) -> frozenset:
    """Words that WORD_SHARE of all bodies have: at most (words of a mean body) / WORD_SHARE of them."""

    def make():
        total: Counter = Counter()

        def flush():
            rows = list(total.items())
            total.clear()
            return rows

        def step(row):
            total.update([w for w in set(row[0].casefold().split()) if w.isascii() and w.isalpha()])
            total[""] += 1
            if len(total) > 300_000:
                yield from flush()

        step.close = flush
        return step

    counts = map_rows(bodies.select("body").filter(F.length("body") > 0), "word string, n long", make).groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "words")
    size = (counts.filter("word = ''").agg(F.sum("n")).first()[0]) or 0
    return frozenset(r[0] for r in counts.filter((F.col("word") != "") & (F.col("n") >= F.greatest(F.lit(5.0), F.lit(WORD_SHARE * size)))).select("word").collect())


def residue(bodies: DataFrame, similarity: float = 0.8) -> DataFrame:
    """rec_id and reason ('slot', 'notice or filler', 'copy of residue') of every record to exclude.

    bodies: rec_id, body and marked (whether the whole content has a slot, see
    has_slot); other columns are ignored. A blank body is 'notice or filler', a
    null one no case. One row per rec_id, however often it is given. A near
    copy has `similarity` of the five-word shingles and at least
    0.8 * similarity of the characters of the longer body.
    """
    ordinary = ordinary_words(bodies)
    rec_kind = dict(bodies.dtypes)["rec_id"]

    def make():
        def label(row):
            rec, body, slot = row
            if body is None:
                return
            yield rec, 1 if slot else 2 if is_residue(body.strip(), words_of(body), ordinary) else 0, len(body)

        return label

    rows = map_rows(bodies.select("rec_id", "body", "marked"), f"rec_id {rec_kind}, kind int, size int", make)
    rows = materialise(rows.groupBy("rec_id").agg(F.max("kind").alias("kind"), F.max("size").alias("size")), "residue")
    own = rows.filter("kind > 0").select("rec_id", F.when(F.col("kind") == 1, "slot").otherwise("notice or filler").alias("reason"))
    # only bodies whose size is near that of a labelled one can be its copies; sizes are compared in steps of this ratio
    step = math.log(1 / (0.8 * similarity))

    def band(size):
        return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(step)).cast("int")

    texts = bodies.select("rec_id", "body").filter(F.col("body").isNotNull())
    frontier, labelled = rows.filter("kind = 2").select("rec_id", "size"), rows.filter("kind > 0").select("rec_id")
    copies = labelled.limit(0)
    while True:
        bands = {r[0] + d for r in frontier.select(band(F.col("size"))).distinct().collect() for d in (-1, 0, 1)}
        if not bands:
            break
        seeds = _classes(_sets(texts.join(frontier.select("rec_id"), "rec_id", "left_semi"), similarity))
        bitmap = _bitmap(seeds)
        near = texts.filter(band(F.length("body")).isin(sorted(bands)))  # read in place
        near = materialise(_sets(near, similarity, bitmap).join(labelled, "rec_id", "left_anti"), "near")
        found = _copies(seeds, _classes(near), similarity)
        frontier = materialise(near.join(found, ["exact", "size"], "left_semi").select("rec_id", "size").dropDuplicates(["rec_id"]), "frontier")
        bitmap.destroy()
        labelled, copies = labelled.unionAll(frontier.select("rec_id")), copies.unionAll(frontier.select("rec_id"))
    return own.unionAll(copies.select("rec_id", F.lit("copy of residue").alias("reason")))


def _sets(texts: DataFrame, similarity: float, bitmap=None) -> DataFrame:
    """exact (hash of the units), size (characters) and keys (the different shingles in order) of texts (rec_id, body);
    with a bitmap only of those of which at most 1 - similarity of the shingles aren't in it."""

    def make():
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)

        def lacking(keys):
            at = keys & np.uint64(8 * len(bits) - 1)
            return keys[bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 0]

        def keys_of(hashes):
            if bits is not None:
                most = int((1 - similarity) * len(hashes) + 1e-6)  # as many units as shingles or more
                first = lacking(shingles(hashes[: most + len(hashes) // 16 + 12], SHINGLE))
                if len(first) > most and len(np.unique(first)) > most:
                    return None
            keys = np.unique(shingles(hashes, SHINGLE))
            return keys if bits is None or len(lacking(keys)) <= (1 - similarity) * len(keys) + 1e-6 else None

        def step(columns):
            recs, bodies = columns
            bodies = bodies.to_pylist()
            for lo, hi in grouped(bodies):
                words = Texts(bodies[lo:hi])
                at = words.offsets.tolist()
                rows = []
                for k, (a, b) in enumerate(zip(at, at[1:]), lo):
                    hashes = words.hashes[a:b]
                    keys = keys_of(hashes) if b > a else None
                    if keys is not None:
                        rows.append((k, xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63), len(bodies[k]), np.sort(keys.view(np.int64))))
                if rows:
                    numbers, *rest = zip(*rows)
                    yield [recs.take(pa.array(numbers)), *rest]

        return step

    return map_columns(texts.select("rec_id", "body"), f"rec_id {dict(texts.dtypes)['rec_id']}, exact long, size int, keys array<long>", make)


def _classes(sets: DataFrame) -> DataFrame:
    """One row for equal units and sizes: exact, size, keys."""
    return materialise(sets.select("exact", "size", "keys").dropDuplicates(["exact", "size"]), "classes")


def _bitmap(sets: DataFrame):
    """Broadcast bitmap of all keys by their lowest bits. Two keys may share a bit, which adds candidates and loses none."""
    total = sets.agg(F.sum(F.size("keys"))).first()[0] or 1
    bits = min(max((16 * total - 1).bit_length(), 15), BITMAP)
    place = sets.select(F.explode("keys").alias("k")).select((F.col("k").bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("p"))
    rows = place.groupBy(F.expr("bitmap_bucket_number(p)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("b")).collect()
    whole = bytearray((1 << bits) // 8)
    for n, b in rows:
        whole[(n - 1) * 4096 : n * 4096] = b
    return sets.sparkSession.sparkContext.broadcast(bytes(whole))


def _copies(seeds: DataFrame, rest: DataFrame, similarity: float) -> DataFrame:
    """exact and size of those classes of rest that are near copies of one of seeds.

    Exact: sets of n and m keys of that similarity have all but a 1 - similarity
    of either in common, so one of the first n - ceil(similarity * n) + 1 of each.
    """

    def first(side: DataFrame, name: str) -> DataFrame:
        n = F.size("keys")
        return side.select(F.struct("exact", "size").alias(name), n.alias(f"{name}_n"), F.explode(F.slice("keys", F.lit(1), (n - F.ceil(n * similarity - 1e-6) + 1).cast("int"))).alias("k"))

    alike = (F.least("a.size", "b.size") >= similarity * 0.8 * F.greatest("a.size", "b.size")) & (F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-6)
    pairs = first(seeds, "a").join(first(rest, "b"), "k").filter(alike).select("a", "b").distinct()
    pairs = pairs.join(seeds.select(F.struct("exact", "size").alias("a"), F.col("keys").alias("x")), "a").join(rest.select(F.struct("exact", "size").alias("b"), F.col("keys").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("b.*").distinct()
