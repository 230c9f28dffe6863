"""Problem 2: languages of documents and of their segments.

Character n-gram models, one a language, give each line of a body a likelihood
under every language. Expectation-maximisation over a document's lines then
estimates its mixture of languages; a language stays in the mixture only if it
raises the likelihood by more than a penalty. Lines take the language with the
highest posterior, the document the one that holds most of its text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.arrow import map_rows
from tesserine.runtime import materialise, ship

# English names and three-letter codes of languages by two-letter code.
NAMES = {
    "en": "english eng", "fr": "french fra fre", "de": "german deu ger", "es": "spanish spa castilian", "pt": "portuguese por", "ru": "russian rus", "zh": "chinese zho chi mandarin", "ja": "japanese jpn",
    "ko": "korean kor", "ar": "arabic ara", "hi": "hindi hin", "th": "thai tha", "it": "italian ita", "nl": "dutch nld dut", "la": "latin lat", "uk": "ukrainian ukr", "fa": "persian fas per farsi", "pl": "polish pol", "tr": "turkish tur", "sv": "swedish swe",
}
_NOISE = re.compile(r"https?://\S+|www\.\S+|\[\[[^\]]*\]\]|\]\([^)]*\)|`[^`]*`|[\d_#>*|<\[\]{}()=/\\+~^$%&@-]+")
_FENCE = re.compile(r"\s*(?:```|~~~)")
BUCKETS = 1 << 17
#: Labelled texts read per label to fit the models, and characters of each.
TRAIN_TEXTS = 400
#: Log-likelihood a language must add to a document's mixture, and to a line that takes it.
PENALTY = 12.0
#: Letters a line needs to be a segment of its own.
LEAST_LETTERS = 12


def label_code(column: Column) -> Column:
    """Two-letter code a language label names, or null: codes with or without region and English names count."""
    key = F.lower(F.trim(column))
    base = F.regexp_extract(key, r"^([a-z]{2,3})(?:[-_][a-z0-9]{2,8})*$", 1)
    names = F.create_map(*[F.lit(x) for code, words in NAMES.items() for w in [code, *words.split()] for x in (w, code)])
    known = F.coalesce(F.try_element_at(names, F.nullif(base, F.lit(""))), F.try_element_at(names, key))
    return F.coalesce(known, F.when(F.length(base) == 2, F.when(base != "xx", base)))


def _grams(text: str) -> np.ndarray:
    """Bucket of the one- to three-character gram that ends at each character."""
    c = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        wide = c >= 0x2E80  # scripts with many characters: pairs
        h = c * np.uint64(0x9E3779B1)
        h[1:] ^= np.where(wide[1:], np.uint64(0), c[:-1] * np.uint64(0x85EBCA77))
        h[2:] ^= np.where(wide[2:], np.uint64(0), c[:-2] * np.uint64(0xC2B2AE3D))
        h ^= h >> np.uint64(15)
        h *= np.uint64(0x2545F4914F6CDD1D)
    return (h >> np.uint64(47)).astype(np.int64) % BUCKETS


def tidy(line: str) -> str:
    """A line's prose: lower case, without addresses, code, numbers and marks."""
    return " ".join(_NOISE.sub(" ", line).lower().split())


class Model:
    """Log-likelihoods of n-gram buckets by language."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table

    def score(self, lines: list[str]) -> np.ndarray:
        """Log-likelihood of each line (rows) under each language (columns)."""
        if not lines:
            return np.zeros((0, len(self.names)))
        text = " ".join(lines)
        each = self.table[_grams(text)]
        starts = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
        return np.add.reduceat(each, starts, axis=0)


def fit(texts: list[tuple[str, str]]) -> Model:
    """Models from (label, text) pairs; texts another label fits better are left out of a second fit."""
    names = sorted({label for label, _ in texts})
    rows = [(names.index(label), _grams(tidy(t))) for label, t in texts]

    def table(use):
        counts = np.full((BUCKETS, len(names)), 0.02, np.float64)
        for k, grams in use:
            np.add.at(counts[:, k], grams, 1.0)
        counts /= counts.sum(axis=0)
        return np.log(counts).astype(np.float32)

    first = table(rows)
    kept = [(k, g) for k, g in rows if len(g) and int(first[g].sum(axis=0).argmax()) == k]
    return Model(names, table(kept or rows))


def train(labelled: DataFrame, text_col: str = "text", label: Column | None = None) -> Model:
    """Fit on at most TRAIN_TEXTS texts of each language (drawn by hash), read by the driver.

    Labels that name no language are ignored.
    """
    code = label_code(label if label is not None else F.col("lang"))
    rows = labelled.select(code.alias("code"), F.col(text_col).alias("text")).filter(F.col("code").isNotNull() & (F.length("text") > 100))
    counts = {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}
    bound = F.lit(None)
    for code_name, n in counts.items():
        bound = F.when(F.col("code") == code_name, F.lit(min(1.0, 1.3 * TRAIN_TEXTS / n))).otherwise(bound)
    drawn = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < bound * (1 << 20)).limit(2 * TRAIN_TEXTS * max(1, len(counts))).collect()
    return fit([(r["code"], r["text"]) for r in drawn])


def mixture(scores: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Proportions of languages over lines with these log-likelihoods, after dropping what does not pay its penalty."""
    top = scores.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(scores - top, -700.0))
    use = np.unique(scores.argmax(axis=1))
    while True:
        share = np.full(len(use), 1.0 / len(use))
        part = like[:, use]
        for _ in range(rounds):
            post = part * share
            post /= post.sum(axis=1, keepdims=True) + 1e-300
            share = post.mean(axis=0)
        if len(use) == 1:
            break
        total = np.log(part @ share + 1e-300).sum()
        loss = [total - np.log(np.delete(part, k, axis=1) @ (np.delete(share, k) / max(1e-9, 1 - share[k])) + 1e-300).sum() for k in range(len(use))]
        worst = int(np.argmin(loss))
        if loss[worst] >= PENALTY:
            break
        use = np.delete(use, worst)
    out = np.zeros(scores.shape[1])
    out[use] = share
    return out


def prose_lines(content: str, chrome) -> list[tuple[int, str]]:
    """(number, prose) of the lines of the main body outside code that have letters."""
    skip, code, out = set(() if chrome is None else chrome), False, []
    for k, line in enumerate(content.split("\n"), 1):
        if k in skip or not line.strip():
            continue
        if _FENCE.match(line):
            code = not code
            continue
        if not code:
            text = tidy(line)
            if text:
                out.append((k, text))
    return out


def languages(bodies: DataFrame, model: Model) -> DataFrame:
    """Language of every record (line_no 0) and of each line in another language.

    bodies: rec_id, text (the content), chrome (its page lines). Result: rec_id,
    line_no, lang, confidence (posterior), chars. A null text, or one without
    letters, has the row line_no 0 with null lang and confidence 0.
    """
    ship(bodies.sparkSession)
    names, table = model.names, model.table
    kind = dict(bodies.dtypes)["rec_id"]
    shared = bodies.sparkSession.sparkContext.broadcast(table)  # BUCKETS x languages floats, whatever the data

    def make():
        own = Model(names, shared.value)

        def step(row):
            rec, text, chrome = row
            lines = prose_lines(text, chrome) if text is not None else []
            if not lines:
                yield rec, 0, None, 0.0, 0
                return
            scores = own.score([x for _, x in lines]).astype(np.float64)
            sizes = np.array([len(x) for _, x in lines])
            if len(np.unique(scores.argmax(axis=1))) == 1:
                chosen = scores.argmax(axis=1)
                post = np.ones(len(lines))
            else:
                share = mixture(scores)
                value = scores + np.log(np.maximum(share, 1e-300))
                chosen = value.argmax(axis=1)
                post = 1.0 / np.exp(value - value.max(axis=1, keepdims=True)).sum(axis=1)
            by = np.bincount(chosen, weights=sizes, minlength=len(names))
            main = int(by.argmax())
            yield rec, 0, names[main], float(by[main] / by.sum()), int(by[main])
            ahead = scores[np.arange(len(lines)), chosen] - scores[:, main]
            for (number, prose), k, p, n, gain in zip(lines, chosen, post, sizes, ahead):
                if k != main and gain >= PENALTY and sum(map(str.isalpha, prose)) >= LEAST_LETTERS:
                    yield rec, number, names[int(k)], float(p), int(n)

        return step

    return map_rows(bodies.select("rec_id", "text", "chrome"), f"rec_id {kind}, line_no int, lang string, confidence double, chars int", make)


def missing_labels(found: DataFrame, sources: DataFrame, syntheses: DataFrame) -> DataFrame:
    """rec_id, line_no, lang: line_no 0 for records whose label is missing or wrong, else the segments.

    A record is labelled right if any of its synthesis rows names its language;
    null source files have no row.
    """
    labels = syntheses.filter(F.col("source_file").isNotNull()).select("source_file", label_code(F.col("language")).alias("label")).groupBy("source_file").agg(F.collect_set("label").alias("labels"))
    keyed = sources.select("rec_id", "source_file").dropDuplicates(["rec_id"]).join(labels, "source_file", "left").select("rec_id", "labels")
    whole = found.filter((F.col("line_no") == 0) & F.col("lang").isNotNull()).join(keyed, "rec_id", "left")
    wrong = whole.filter(~F.coalesce(F.array_contains("labels", F.col("lang")), F.lit(False)))
    return wrong.select("rec_id", "line_no", "lang").unionAll(found.filter("line_no > 0").select("rec_id", "line_no", "lang"))


def cached(found: DataFrame) -> DataFrame:
    """The result of languages() as a table, for more than one use."""
    return materialise(found, "languages")
