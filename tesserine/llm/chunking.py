"""Problem 5: cut oversized texts by content-defined chunking.

A rolling hash over 16 characters marks landmarks; each landmark snaps to the
nearest natural boundary (paragraph, line, sentence, blank) inside the allowed
span. A cut depends only on the text around it, so after an edit the cuts meet
the old ones again a few pieces later.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.arrow import map_rows

WINDOW = 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Boundary kinds from strongest to weakest; a match ends where a piece may end.
_BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"(?:\r?\n[ \t]*){2,}",
        r"\r?\n",
        r"[.!?…][\"'”’»)\]]*\s+|[。！？।؟][」』”’）]*\s*",
        r"\s+",
    )
)
PIECES = "piece_no int, start_pos int, end_pos int"


def rolling_hashes(text: str) -> np.ndarray:
    """Hash of the WINDOW characters that end at each position (shorter at the start)."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = (h + np.uint64(1)) * _MULTIPLIER
    h ^= h >> np.uint64(29)
    width, factor = 1, _MULTIPLIER
    with np.errstate(over="ignore"):
        while width < WINDOW:
            h[width:] = h[width:] + h[:-width] * factor
            width, factor = width * 2, factor * factor
    return h ^ (h >> np.uint64(32))


def _nearest(pattern: re.Pattern, text: str, low: int, high: int, mark: int) -> int | None:
    best = None
    for m in pattern.finditer(text, low, high):
        end = m.end()
        if low < end <= high and (best is None or abs(end - mark) < abs(best - mark)):
            best = end
    return best


def _whole_character(text: str, at: int, low: int) -> int:
    while at > low + 1 and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def chunk_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces of text.

    Every piece has at most `size` characters and begins exactly `overlap`
    characters before the end of the one before. A text of at most `size`
    characters is one piece; an empty one has none. `overlap` is clipped to
    half the size and negative values count as 0; size < 1 gives no pieces.
    """
    n = len(text)
    if size < 1 or n == 0:
        return []
    overlap = max(0, min(overlap, size // 2))
    if n <= size:
        return [(0, n)]
    longest = size - overlap
    shortest = max(1, longest // 2)
    hashes = rolling_hashes(text)
    mask = np.uint64((1 << max(1, (max(2, longest // 4)).bit_length() - 1)) - 1)
    cuts, at = [], 0
    while n - max(0, at - overlap) > size:
        low, high = at + shortest, min(at + longest, n)
        inside = hashes[low - 1 : high]
        hits = np.flatnonzero((inside & mask) == 0)
        mark = low + int(hits[0] if len(hits) else inside.argmin())
        cut = None
        reach = max(1, longest // 8)
        for kind, pattern in enumerate(_BOUNDARIES):
            span = (low, high) if kind == 0 else (max(low, mark - reach), min(high, mark + reach))
            cut = _nearest(pattern, text, *span, mark)
            if cut is not None:
                break
        if cut is None:
            for pattern in _BOUNDARIES:
                cut = _nearest(pattern, text, low, high, mark)
                if cut is not None:
                    break
        cuts.append(at := _whole_character(text, mark, low) if cut is None else cut)
    bounds = [0, *cuts, n]
    return [(max(0, a - overlap) if i else 0, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def chunk(df: DataFrame, configs: DataFrame, id_col: str = "rec_id", text_col: str = "content", keep_text: bool = True, oversized_only: bool = False) -> DataFrame:
    """Pieces of every text under every config row.

    df needs id_col and text_col, configs config_id, chunk_size and
    chunk_overlap; other columns are ignored. Result: config_id, the id,
    piece_no (from 1), start_pos, end_pos (exclusive), n_chars of the text and,
    with keep_text, text. Null or empty texts give no row, as do configs whose
    size is null or below 1; a null overlap is 0. With oversized_only, texts
    within the size are left out instead of coming out as one piece. Repeated
    input rows give repeated pieces.

    configs is a parameter table: its rows are read by the driver (up to
    10,000, else ValueError), so no text is ever shuffled.
    """
    rows = configs.select("config_id", "chunk_size", "chunk_overlap").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("chunk: more than 10,000 configs")
    ways = [(r[0], int(r[1]), int(r[2] or 0)) for r in rows if r[1] is not None and r[1] >= 1]
    texts = df.select(F.col(id_col), F.col(text_col).alias("content")).filter(F.col("content").isNotNull())
    if oversized_only:
        texts = texts.filter(F.length("content") > min((w[1] for w in ways), default=2**31 - 1))

    def make():
        def pieces(row):
            key, text = row
            for config, size, overlap in ways:
                if oversized_only and len(text) <= size:
                    continue
                for k, (a, b) in enumerate(chunk_spans(text, size, overlap), 1):
                    yield (config, key, k, a, b, len(text), *([text[a:b]] if keep_text else []))

        return pieces

    kinds = dict(df.dtypes), dict(configs.dtypes)
    schema = f"config_id {kinds[1]['config_id']}, {id_col} {kinds[0][id_col]}, {PIECES}, n_chars int" + ", text string" * keep_text
    return map_rows(texts, schema, make, flush=2_000)
