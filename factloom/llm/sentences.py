"""Sentence units of texts in any language and script.

Terminators and closing marks come from the standard sentence-break character properties; breaks
are then suppressed after abbreviations of the text's language, inside decimals and names, after initials and titles,
before a continuation in lower case, and around quotations inside a sentence.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Abbreviations that end in a period, without it and in lower case, by language.  They are taken from
# the languages' common ones in the sentence-break suppressions of Unicode CLDR and its locales' spelling.
# Those after which a sentence goes on whatever follows.
ALWAYS = {
    "en": ("cf", "e.g", "i.e", "approx", "vs", "incl", "viz", "resp", "mr", "mrs", "ms", "messrs"),
    "de": ("vgl", "ca", "bzw", "z.b", "d.h", "u.a", "sog", "inkl", "ggf", "evtl", "hr", "fr"),
    "fr": ("cf", "env", "p.ex", "mme", "mlle", "mm"),
    "es": ("aprox", "p.ej", "sr", "sra", "srta", "dña"),
    "it": ("ca", "p.es", "sig", "sig.ra", "cfr"),
    "pt": ("aprox", "p.ex", "sra", "cf"),
    "ru": ("см", "напр", "т.е", "т.к", "ср", "г-н"),
}
# Those that stand before a name: a sentence goes on unless a word follows that begins sentences.
TITLES = {
    "en": ("dr", "prof", "st", "gen", "col", "lt", "capt", "sgt", "maj", "rev", "hon", "gov", "sen", "pres", "mt", "ft"),
    "de": ("dr", "prof", "st", "dipl", "ing"),
    "fr": ("dr", "pr", "st", "ste", "m"),
    "es": ("dr", "prof", "d", "ing"),
    "it": ("dott", "prof", "ing", "avv"),
    "pt": ("dr", "prof", "eng", "sr"),
    "ru": ("проф", "акад", "им", "гр"),
}
# Those that stand before a number.
NUMBERED = {
    "en": ("no", "nos", "fig", "figs", "sec", "rev", "vol", "ch", "eq", "p", "pp", "ver"),
    "de": ("nr", "abschn", "abb", "kap", "bd", "s", "tab"),
    "fr": ("fig", "art", "p", "chap"),
    "es": ("pág", "págs", "núm", "fig", "art", "cap"),
    "it": ("fig", "pag", "art", "cap", "n"),
    "pt": ("fig", "pág", "art", "cap", "núm"),
    "ru": ("рис", "стр", "табл", "гл", "п"),
}
# Common words: they tell a paragraph's language, and those that begin sentences end an abbreviation's sentence.
COMMON = {
    "en": ("the", "an", "this", "that", "these", "it", "we", "they", "he", "she", "then", "there", "if", "in", "when", "is", "are", "was", "and", "of", "to", "each", "our", "all", "see", "compare"),
    "de": ("der", "die", "das", "ein", "eine", "es", "wir", "sie", "er", "dann", "wenn", "ist", "und", "nicht", "im", "am", "dieser", "diese", "dieses"),
    "fr": ("le", "la", "les", "un", "une", "il", "elle", "nous", "ils", "ce", "cette", "est", "et", "des", "dans", "puis", "si"),
    "es": ("el", "la", "los", "las", "un", "una", "es", "del", "en", "este", "esta", "luego", "véase", "esto"),
    "it": ("il", "lo", "gli", "una", "di", "che", "della", "questo", "questa", "poi", "non"),
    "pt": ("os", "um", "uma", "que", "este", "esta", "não", "depois", "isso"),
    "ru": ("и", "в", "не", "на", "это", "он", "она", "мы", "они", "эта", "этот", "затем", "если"),
}
# Words after which "no" is an answer and no number's mark.
ANSWERED = ("said", "says", "say", "answered", "replied", "is", "was", "means", "answer")
# Months that follow a day's ordinal number.
MONTHS = {
    "de": ("januar", "jänner", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"),
}


class Lists:
    """The lists of one language, or of several at once where a text's language isn't known."""

    def __init__(self, *languages: str):
        pick = lambda d: frozenset(x for k in languages for x in d.get(k, ()))
        self.always, self.titles, self.numbered, self.common, self.months = map(pick, (ALWAYS, TITLES, NUMBERED, COMMON, MONTHS))


LISTS = {k: Lists(k) for k in ALWAYS}
ANY = Lists(*ALWAYS)
#: Scripts that have one of the listed languages each; the others are written in Latin letters.
_CYRILLIC = regex.compile(r"\p{Cyrillic}")
_LATIN_WORD = regex.compile(r"(?<!\w)\p{Latin}+(?!\w)")


def language_key(lang: str | None) -> str | None:
    """The language of a tag as written ('EN', 'de-DE'), if it is one of the listed ones, else None."""
    k = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    return k if k in LISTS else None


#: Characters after a period that are looked at for common words.
_WINDOW = 120


@functools.cache
def _lists(languages: frozenset[str]) -> Lists:
    return Lists(*sorted(languages)) if languages else ANY


def lists_for(around: str, lang: str | None) -> Lists:
    """The lists for a sentence of a text in a language (None: unknown).

    Texts mix languages, so those of which the sentence has a common word count beside the text's own; where neither
    is known, all do.
    """
    words = set(_LATIN_WORD.findall(around.lower()))
    return _lists(frozenset(k for k, x in LISTS.items() if k == lang or not words.isdisjoint(x.common)))


_LINE = regex.compile(r"[^\r\n\v\f\x85  ]*(?:\r\n|[\r\n\v\f\x85  ]|\Z)")
_FENCE = regex.compile(r"[ \t]*(`{3,}|~{3,})")
_HEADING = regex.compile(r"[ \t]*#{1,6}[ \t]+\S")
_BULLET = regex.compile(r"[ \t]*[-*•‣◦·][ \t]+\S")
_NUMBER = regex.compile(r"[ \t]*\(?\d{1,4}[.)][ \t]+\S")

_TERMINATOR = regex.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…]+")
_CLOSERS = regex.compile(r"(?:[\p{Sentence_Break=Close}\"'”’»“]|[   ][»›])*")
_OPENERS = "\"'(“„«「『‹[{¿¡"
_CONTINUES = regex.compile(r"[\p{Sentence_Break=SContinue}]")
_PLAIN_LOWER = regex.compile(r"\p{Ll}[\p{Ll}\p{M}'’\-]*[,;:.!?…]*(?=\s|\Z)")
_WORD = regex.compile(r"\S+")
#: Terminators after which a sentence ends without a blank too: those of the standard's class STerm beside ! and ?, and full stops of full width.
_UNSPACED = regex.compile(r"[\p{Sentence_Break=STerm}--!?．﹒｡]", regex.V1)
_FULL_STOPS = "．﹒｡"
#: What follows ! or ? without a blank where a sentence ends there: a word with a capital, as in "true?Yes".
_CAPITAL_WORD = regex.compile(r"\p{Lu}\p{Ll}+(?=[\s,.;:!?…]|\Z)")
_UNCASED = regex.compile(r"[\p{Lo}--\p{Latin}]", regex.V1)
_THAI = regex.compile(r"(?<=[ก-๎])\s+(?=[ก-๎])")
_PAIRS = regex.compile(r"„[^„“\"]*[“\"]|“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"]*\"")
#: Japanese particles that go on after a quotation.
_PARTICLES = frozenset("とっのをがはにでもやへ、，")


def _quotes(s: str) -> tuple[list[int], list[int]]:
    """Starts and ends of quotations, in order."""
    if s.count('"') % 2:
        found = [m.span() for m in _PAIRS.finditer(s) if s[m.start()] != '"']
    else:
        found = [m.span() for m in _PAIRS.finditer(s)]
    return [a for a, _ in found], [b for _, b in found]


def _tight(s: str, m, end: int, nxt: int, began: int) -> bool:
    """Whether the sentence goes on after a terminator that nothing blank follows."""
    mark, closed = m.group(), s[m.end() : end]
    last = mark[-1]
    if last in "!?":
        # no marks of code or of module!name: after a plain word, before a capital's word or a letter without case
        before = s[m.start() - 1 : m.start()]
        if closed or not before.isalpha() or not (_UNCASED.match(s, nxt) or last == "?" and _CAPITAL_WORD.match(s, nxt)):
            return True
    elif last not in _FULL_STOPS and not _UNSPACED.match(last) and not mark.endswith("……"):
        return True
    if last in _FULL_STOPS and s[nxt].isdigit() or _CONTINUES.match(s, nxt):
        return True
    quoted = closed.rstrip(")）]】") != "" and closed != ""
    return quoted and (s[nxt] in _PARTICLES or s[began] not in _OPENERS)


def _goes_on(s: str, m, end: int, nxt: int, began: int, lang: str | None) -> bool:
    """Whether the sentence goes on after a terminator m whose closing marks reach to end; nxt: what follows."""
    mark, closed = m.group(), s[m.end() : end]
    if nxt == end:
        return _tight(s, m, end, nxt, began)
    if _CONTINUES.match(s, nxt) or _PLAIN_LOWER.match(s, nxt):
        return True
    if mark != "." or closed:
        return False
    at = m.start()
    while at > began and not s[at - 1].isspace():
        at -= 1
    written = s[at : m.start()].lstrip(_OPENERS)
    word, follows = written.lower(), _WORD.match(s, nxt).group()
    if not word or len(word) > 8 and not word.isdigit():
        return False
    spaced = word  # with the letters before it, as in "z. B."
    k = at
    while len(word) == 1 and k > began:
        j = k
        while j > began and s[j - 1].isspace():
            j -= 1
        if j - 2 < began or s[j - 1] != "." or not s[j - 2].isalpha() or j - 2 > began and s[j - 3].isalnum():
            break
        spaced, k = f"{s[j - 2].lower()}.{spaced}", j - 2
    capital = follows[0].isupper() and (word in ANY.titles and written[0].isupper() or len(written) == 1 and written.isupper() and _LATIN_WORD.match(written) is not None)
    month = word.isdigit() and follows.rstrip(".,;:!?").lower() in ANY.months
    lone = len(word) == 1 and word.isalpha() and len(follows) == 2 and follows[0].isalpha() and follows[1] == "."
    if not (capital or month or lone or word in ANY.always or spaced in ANY.always or word in ANY.numbered):
        return False
    x = LISTS["ru"] if _CYRILLIC.match(word) else lists_for(s[began : nxt + _WINDOW], lang)
    if lone or word in x.always or spaced in x.always:
        return True
    if word in x.numbered and follows[0].isdigit():
        return not (written == "no" and s[began:at].split()[-1:] and s[began:at].split()[-1].lower() in ANSWERED)
    if capital and (word in x.titles or len(written) == 1):
        return follows.rstrip(".,;:!?'’").lower() not in x.common
    return month and follows.rstrip(".,;:!?").lower() in x.months


def paragraph(s: str, lang: str | None = None) -> Iterator[tuple[int, int]]:
    """Sentences of one paragraph (line ends are blanks) of a text in a language (as of language_key)."""
    n = len(s)
    opens, closes = _quotes(s)
    breaks: list[int] = []
    thai = [m.start() for m in _THAI.finditer(s)]
    began = n - len(s.lstrip())
    t = 0
    for m in _TERMINATOR.finditer(s):
        if m.start() < began:
            continue
        while t < len(thai) and thai[t] < m.start():
            began = max(began, thai[t] + 1)
            t += 1
        end = _CLOSERS.match(s, m.end()).end()
        nxt = end
        while nxt < n and s[nxt].isspace():
            nxt += 1
        if nxt >= n:
            break
        i = bisect_right(opens, m.start()) - 1
        if i >= 0 and end < closes[i]:  # within a quotation that goes on
            continue
        if _goes_on(s, m, end, nxt, min(max(began, 0), n - 1), lang):
            continue
        breaks.append(end)
        began = nxt
    at = 0
    for b in sorted({*breaks, *thai, n}):
        yield from _trimmed(s, at, b)
        at = b


def _trimmed(s: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    while a < b and (s[a].isspace() or s[a] == "﻿"):
        a += 1
    while b > a and (s[b - 1].isspace() or s[b - 1] == "﻿"):
        b -= 1
    if a < b:
        yield a, b


def units(text: str, lang: str | None = None) -> Iterator[tuple[int, int]]:
    """(start, end) of each unit of a text, in code points, in order and without blanks around.  lang: the text's language tag, however written.

    A fenced block with its fences, a heading line, a list item with its mark and the line before a list
    that ends in a colon are one unit each; a fence without an end reaches to the text's end.
    """
    lines = [m.span() for m in _LINE.finditer(text) if m.end() > m.start()]
    lang = language_key(lang)
    i = 0
    while i < len(lines):
        a, b = lines[i]
        line = text[a:b]
        if not line.strip():
            i += 1
            continue
        if f := _FENCE.match(line):
            j = i + 1
            while j < len(lines) and not (text[slice(*lines[j])].strip().startswith(f.group(1)) and not text[slice(*lines[j])].strip().strip(f.group(1)[0])):
                j += 1
            j = min(j, len(lines) - 1)
            yield from _trimmed(text, a, lines[j][1])
            i = j + 1
            continue
        if _HEADING.match(line):
            yield from _trimmed(text, a, b)
            i += 1
            continue
        j = i  # the block: lines up to a blank line, a fence or a heading
        while j < len(lines):
            x = text[slice(*lines[j])]
            if not x.strip() or j > i and (_FENCE.match(x) or _HEADING.match(x)):
                break
            j += 1
        yield from _block(text, lines[i:j], lang)
        i = j


def _block(text: str, lines: list[tuple[int, int]], lang: str | None) -> Iterator[tuple[int, int]]:
    first = None
    for k, (a, b) in enumerate(lines):
        x = text[a:b]
        led = k == 0 or text[slice(*lines[k - 1])].rstrip().endswith((":", "："))
        if _BULLET.match(x) or led and _NUMBER.match(x):
            first = k
            break
    if first is None:
        yield from _sentences(text, lines[0][0], lines[-1][1], lang)
        return
    if first > 0:
        intro = first - 1 if text[slice(*lines[first - 1])].rstrip().endswith((":", "：")) else first
        if intro > 0:
            yield from _sentences(text, lines[0][0], lines[intro - 1][1], lang)
        if intro < first:
            yield from _trimmed(text, *lines[intro])
    start = lines[first][0]
    for a, b in lines[first + 1 :]:
        if _BULLET.match(text, a, b) or _NUMBER.match(text, a, b):
            yield from _trimmed(text, start, a)
            start = a
    yield from _trimmed(text, start, lines[-1][1])


def _sentences(text: str, a: int, b: int, lang: str | None) -> Iterator[tuple[int, int]]:
    for x, y in paragraph(text[a:b], lang):
        yield a + x, a + y


def sentences(df: DataFrame, ident: str, text: str, lang: str | None = None) -> DataFrame:
    """(id, sent_start, sent_end) of every sentence unit, as code point offsets, end exclusive.

    lang: the column of the texts' language tags, whose lists of abbreviations count (null and unlisted
    languages: see lists_for).

    Null, empty and blank texts have no units.  Every character that isn't blank lies in exactly one unit.
    Other columns aren't read; repeated rows give their units again.
    """
    schema = T.StructType([df.schema[ident], T.StructField("sent_start", T.IntegerType()), T.StructField("sent_end", T.IntegerType())])

    def run(batches):
        for b in batches:
            take, starts, ends = [], [], []
            tags = b.column(2).to_pylist() if lang else [None] * b.num_rows
            for i, t in enumerate(b.column(1).to_pylist()):
                for x, y in units(t, tags[i]) if t else ():
                    take.append(i)
                    starts.append(x)
                    ends.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=schema.names)

    return df.select(ident, text, *([lang] if lang else [])).mapInArrow(run, schema)
