"""Problem 6: transcripts into clean speaker turns.

A transcript is read into utterances (time, label, text). A semi-Markov model
then segments them into turns: a turn is one segment with one speaker, its
score the sum of how well the labels inside fit the speaker, of the pauses at
its edges and of the words it shares with itself and with the turn before.
The best segmentation is found exactly. Sound notes and hesitations are
removed when the turns are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.arrow import map_rows

# Sounds of hesitation and spoken fillers.
_SOUNDS = "uh uhm um umm er erm hm hmm mm mhm mmm ah eh em ehm heu euh hum äh ähm öh öhm hä eeh eem あの えー えっと 嗯 呃 啊 어 음 э эм мм ну".split()
_FILLERS = "you know|I mean|sort of|kind of|like|digamos|o sea|bueno|sozusagen|also|quasi|ähem|enfin|en fait|tu vois|du coup|quoi|pues|halt|genau genommen"
_NUMBERED = re.compile(r"(?:speaker|spk|spkr|sprecher|sprecherin|locuteur|intervenant|hablante|orador|спикер|s|p)[ _#-]*0*(\d{1,3})", re.I)
_ROLE = re.compile(r"\s*[(\[]([^()\[\]]{2,24})[)\]]\s*$")
_TITLE = re.compile(r"^(?:dr|prof|mr|mrs|ms|mme|m|sr|sra|dra|hr|fr|herr|frau)\.?\s+", re.I)
_NOTE = re.compile(r"\[[^\[\]\d][^\[\]]{0,40}\]|\((?!\d)[^()]{1,40}\)|<(?!/?(?:p|b|i|v|br)\b)[a-z][a-z ]{1,20}>|♪[^♪\n]*♪|♪|\*[^*\n]{2,30}\*")
_TAG = re.compile(r"</?(?:p|b|i|v|br|c|u|em|strong|span)\b[^<>]*>")
_CLOCK = r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?"
_CUE = re.compile(rf"^\s*{_CLOCK}\s*-->\s*{_CLOCK}.*$")
_VOICE = re.compile(r"^\s*<v(?:\.[^ >]*)?\s+([^>]+)>(.*)$", re.S)
_BOLD = re.compile(r"^\s*(?:<p[^>]*>)?\s*<(?:b|strong)>([^<>]{1,80})</(?:b|strong)>\s*[:：]?\s*(.*)$", re.S)
_LEADING = re.compile(rf"^\s*([\[(])?{_CLOCK}(?(1)[\])]|(?=\s))\s*(.*)$", re.S)
_HEAD_TIME = re.compile(rf"^\s*(\S[^\n]{{0,60}}?)\s{{2,}}[\[(]?{_CLOCK}[\])]?\s*$")
_INLINE = re.compile(r"^\s*((?:[^\s:：–—]+[ ]?){1,6}?)\s?(?:[:：]|\s[–—])\s*(.*)$", re.S)
_BARE = re.compile(r"^[\w.’'() -]{1,60}$")
_SOUND_ONLY = re.compile(rf"\b(?:{'|'.join(map(re.escape, _SOUNDS))})\b[.,!?…]*", re.I)
_FILLER_INSIDE = re.compile(rf"\b(?:{_FILLERS}),\s*", re.I)
_WORDS = re.compile(r"\w+")

#: Weights of the model.
LABEL, MISMATCH, SWITCH, PAUSE, LEXICAL = 10.0, -10.0, -2.0, 0.02, 0.5


def _seconds(groups: tuple) -> float:
    h, m, s, ms = groups
    return int(h or 0) * 3600 + int(m) * 60 + int(s) + (int(ms.ljust(3, "0")) / 1000 if ms else 0.0)


class Cast:
    """The people of one episode and how they may be named."""

    def __init__(self, participants: list[tuple[str | None, str | None]]):
        self.people: list[str] = []
        self.forms: dict[str, set[str]] = {}
        roles: dict[str, set[str]] = {}
        for name, role in participants or []:
            name = " ".join((name or "").split())
            if not name:
                continue
            key = name.casefold()
            if key not in self.people:
                self.people.append(key)
                for form in self.names(name):
                    self.forms.setdefault(form, set()).add(key)
            if role and role.strip():
                roles.setdefault(role.strip().casefold(), set()).add(key)
        self.roles = {r: who for r, who in roles.items()}

    @staticmethod
    def names(name: str) -> set[str]:
        parts = name.casefold().split()
        found = {" ".join(parts)}
        if len(parts) > 1:
            first, last = parts[0], parts[-1]
            found |= {first, last, f"{first} {last}", f"{first} {last[0]}.", f"{first} {last[0]}", f"{first[0]}. {last}", f"{first[0]} {last}", f"{last}, {first}", f"{last} {first}"}
            initials = [p[0] for p in parts]
            found |= {".".join(initials) + ".", ". ".join(initials) + ".", "".join(initials), ".".join(initials)}
        return found

    def resolve(self, label: str) -> set[str]:
        """Who a label may mean: people of the cast, a numbered speaker, or nobody."""
        text = " ".join(label.split()).strip(" :–—-*>")
        role = _ROLE.search(text)
        if role:
            text = text[: role.start()]
        key = text.casefold()
        number = _NUMBERED.fullmatch(key)
        if number:
            return {f"#{int(number[1])}"}
        bare = _TITLE.sub("", key)
        for form in (key, bare):
            if form in self.forms:
                found = self.forms[form]
                if len(found) > 1 and role and self.roles.get(role[1].casefold()):
                    found = found & self.roles[role[1].casefold()] or found
                return found
        if key in self.roles:
            return self.roles[key]
        return set()


def utterances(text: str, cast: Cast) -> list[tuple[float | None, str | None, frozenset, str]]:
    """(time, label, who it may mean, speech) of a transcript, in the order of the text."""
    out: list[list] = []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    cue_time: float | None = None
    pending: tuple[float | None, str] | None = None
    fresh = True  # at the start of a block

    def add(time, label, who, speech):
        out.append([time, label, frozenset(who), speech])

    for i, line in enumerate(lines):
        raw = line.strip()
        if not raw:
            fresh, cue_time = True, None
            continue
        if raw.startswith(("WEBVTT", "NOTE ", "Kind:", "Language:")) and fresh:
            continue
        cue = _CUE.match(raw)
        if cue:
            cue_time, fresh = _seconds(cue.groups()[:4]), True
            continue
        if raw.isdigit() and fresh and i + 1 < len(lines) and "-->" in lines[i + 1]:
            continue
        time, body = cue_time, raw
        lead = _LEADING.match(raw)
        if lead and lead[6]:
            time, body = _seconds(lead.groups()[1:5]), lead[6]
        head = _HEAD_TIME.match(raw)
        if head and not _BOLD.match(raw):
            pending = (_seconds(head.groups()[1:5]), head[1])
            fresh = False
            continue
        strong = _VOICE.match(body) or _BOLD.match(body)
        if strong:
            label = strong[1]
            who = cast.resolve(label) or {"?" + " ".join(_ROLE.sub("", label).split()).casefold()}
            add(time, label, who, _TAG.sub(" ", strong[2]))
        elif pending:
            who = cast.resolve(pending[1]) or {"?" + " ".join(pending[1].split()).casefold()}
            add(pending[0], pending[1], who, _TAG.sub(" ", body))
        else:
            named = _INLINE.match(body)
            who = cast.resolve(named[1]) if named and len(named[1]) <= 60 else set()
            if who:
                add(time, named[1], who, _TAG.sub(" ", named[2]))
            elif fresh and cue_time is None and time is None and _BARE.match(body) and i + 1 < len(lines) and lines[i + 1].strip() and cast.resolve(body):
                pending = (None, body)
                fresh = False
                continue
            else:
                speech = _TAG.sub(" ", body)
                if out and not fresh and (time is None or cue_time is not None):
                    time = out[-1][0]
                add(time, None, set(), speech)
        pending = None
        fresh = False
    last = None
    for u in out:  # a line without a time stays with the line before it
        if u[0] is None:
            u[0] = last
        last = u[0]
    if any(u[0] is not None for u in out):
        out.sort(key=lambda u: u[0] if u[0] is not None else float("-inf"))
    return [tuple(u) for u in out]


def clean(speech: str) -> str:
    """Speech without sound notes, hesitations, fillers and stuttered words."""
    text = _NOTE.sub(" ", speech)
    text = _FILLER_INSIDE.sub("", _SOUND_ONLY.sub(" ", text))
    text = re.sub(r"\b(\w+)( \1\b)+", r"\1", " ".join(text.split()))
    return re.sub(r"\s+([,.!?;:…])", r"\1", text).strip(" ,")


def is_speech(speech: str) -> bool:
    """Whether anything is said besides hesitation sounds and sound notes."""
    return bool(_WORDS.search(_SOUND_ONLY.sub(" ", _NOTE.sub(" ", speech))))


def segment(said: list[tuple[float | None, str | None, frozenset, str]]) -> list[str]:
    """Speaker of each utterance under the best segmentation into turns.

    best[s] is the best score of a segmentation whose open turn has speaker s;
    each utterance either goes on with that turn or opens another one.
    """
    states = sorted({w for _, _, who, _ in said for w in who}) or ["*"]
    best = dict.fromkeys(states, 0.0)
    back: list[dict[str, str]] = []
    words_of: dict[str, set[str]] = {s: set() for s in states}
    previous_time = None
    ambiguous = any(len(who) > 1 for _, _, who, _ in said)
    for time, label, who, speech in said:
        gap = max(0.0, time - previous_time) if time is not None and previous_time is not None else 0.0
        previous_time = time if time is not None else previous_time
        words = set(_WORDS.findall(speech.casefold())) if ambiguous else set()
        top = max(states, key=lambda s: best[s])
        new, came = {}, {}
        for s in states:
            fit = 0.0 if label is None else LABEL if s in who else MISMATCH
            if words and words_of[s]:
                fit += LEXICAL * len(words & words_of[s]) / len(words)
            opens = best[top] + SWITCH + PAUSE * min(gap, 30.0) if label is not None else best[top] + 10 * SWITCH
            if top != s and opens > best[s]:
                new[s], came[s] = opens + fit, top
            else:
                new[s], came[s] = best[s] + fit, s
        best = new
        back.append(came)
        if len(who) == 1 and ambiguous:
            words_of[next(iter(who))] |= words
    at = max(states, key=lambda s: best[s])
    out = []
    for came in reversed(back):
        out.append(at)
        at = came[at]
    return out[::-1]


def turns_of(text: str, participants) -> Iterator[tuple[int, int, str, float | None, str]]:
    """(turn_no, speaker_no, speaker, start, text) of one transcript."""
    cast = Cast(participants)
    found = utterances(text, cast)
    if not any(who for _, _, who, _ in found):
        merged = clean(" ".join(speech for _, _, _, speech in found))
        if any(is_speech(u[3]) for u in found):
            yield 1, 1, "", found[0][0], merged
        return
    numbers: dict[str, int] = {}
    turns: list[list] = []
    for (time, _, _, speech), speaker in zip(found, segment(found)):
        if not is_speech(speech):
            continue
        if turns and turns[-1][0] == speaker:
            turns[-1][2].append(speech)
        else:
            turns.append([speaker, time, [speech]])
            numbers.setdefault(speaker, len(numbers) + 1)
    for k, (speaker, time, parts) in enumerate(turns, 1):
        yield k, numbers[speaker], speaker.lstrip("#?"), time, " ".join(filter(None, map(clean, parts)))


def speaker_turns(transcripts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Clean turns of every transcript.

    transcripts needs transcript_id, identity, text, acquired_at; episodes
    identity and participants; other columns are ignored. Result:
    transcript_id, turn_no (from 1), speaker_no (from 1, by first turn),
    speaker, start_s (null without times), text. A transcript_id given more
    than once counts once, by its latest row. A null or empty text, or one
    with nothing but sounds, gives no turn; one that names no speaker is one
    turn. A null identity or one without an episode leaves only the labels.
    """
    one = transcripts.filter(F.col("transcript_id").isNotNull()).groupBy("transcript_id").agg(F.max(F.struct("acquired_at", "text", "identity")).alias("_r"))
    one = one.select("transcript_id", F.col("_r.text").alias("text"), F.trim("_r.identity").alias("_key")).filter(F.length("text") > 0)
    known = episodes.filter(F.col("identity").isNotNull()).groupBy(F.trim("identity").alias("_key")).agg(F.max(F.to_json("participants")).alias("_cast"))
    rows = one.join(known, "_key", "left").select("transcript_id", "text", "_cast")

    def make():
        import json

        def split(row):
            key, text, cast = row
            people = [(p.get("name"), p.get("role")) for p in json.loads(cast) if p] if cast else []
            for turn in turns_of(text, people):
                yield key, *turn

        return split

    return map_rows(rows, f"transcript_id {dict(transcripts.dtypes)['transcript_id']}, turn_no int, speaker_no int, speaker string, start_s double, text string", make)
