"""Pages that repeat keywords, links, navigation labels or product tags instead of saying something.

A page is cut into units: sentences, lines and the items of separated lists.
Each unit is reduced to a shape that forgets its letters: what it is (link,
tag, keyword run, item, value, sentence), the separator it came with, its
number of words and its capitals. A page is flagged if few non-sentence shapes
hold more than half of its characters.

Nothing depends on a word list. A sentence is known by its form: it does not
start in lower case, it stops with an end mark, its words differ and are of
mixed length. Where one of these is missing, short words have to tie it
together, as they do in the languages that separate words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG_LINE = re.compile(r"<br\s*/?>|</?(?:li|p|div|ul|ol|td|tr)>", re.I)
_SENTENCE_END = re.compile(r"[.!?…؟।](?<!\.{3})[\"'»”)\]]*(?=\s)|[。？！]")
_LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|\S+@\S+\.\w+", re.I | re.S)
_LINK_SIGNS = ("://", "www.", "](", "<a", "@")
_SEPARATOR = re.compile(r"[|•·›»;>+/–—,、，-]")
_STRONG = re.compile(r"\s*[|•·›»;]\s*|\s+[>+/–—-]\s+")
_LIST = re.compile(r"\s*[|•·›»;]\s*|\s+[>+/–—-]\s+|,\s+|\s*,(?=#)|[、，]")
_TAG = re.compile(r"#[^\s#,]{2,}")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\d+(?:[.,:/]\d+)*")
_CODE = re.compile(r"(?:[A-Za-z]{2,5}|#)\.?[ #:.-]*\d{3,}")
_DOTS = re.compile(r"\.{4,}|…{2,}")
# letters of all scripts and their marks, in lower case and without the blocks of punctuation, signs and pictures
_WORD = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u1fff\u2c00-\u2fef\u3005-\ufaff\U00010000-\U0001cfff\U00020000-\U0003ffff]+")
# scripts without spaces between words count a word a character
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_WORD_OR_CHARACTER = re.compile(_UNSPACED.pattern + "|" + _WORD.pattern)
_ENDS = ".!?…:。？！؟।"
_CLOSING = "\"'»”)]* "
_OPENING = "\"'«“‘([{*>#-–—•¿¡ "

#: Letters up to which a word is short: words that tie others together mostly are.
SHORT = 3
#: A unit without the form of a sentence needs one short word in so many words.
TIED = 5
#: Words from which even a unit with the form of a sentence needs short words.
LONG = 25
#: Words that go with a number at most where a unit is a value or a row of them.
WORDS_A_VALUE = 20
#: Words of a unit that page-wide keywords can make one of keywords; different units of that length that must share
#: them, and so many more before what has the form of a sentence is doubted.
BRIEF = 8
SHARING = 3
SHARING_FORMED = 5
#: Times non-sentence shapes of a kind must come up on a page to count as repeated.
REPEATED = 3
#: Shapes that must hold the share of the page.
FEW = 8
SHARE = 0.5


class Unit:
    """A unit and what its shape is made of."""

    __slots__ = ("text", "kind", "separator", "size", "words", "formed", "tied", "times")

    def __init__(self, text: str, separator: str, times: int = 1, linked: bool = True):
        self.text, self.separator, self.size, self.times = text, separator, len(text), times
        self.words: list[str] = []
        self.formed = self.tied = False
        self.kind = self._kind(text, linked)

    def _kind(self, text: str, linked: bool) -> str:
        """``a`` link, ``h`` tags, ``k`` keywords, ``i`` item, ``v`` value, ``s`` sentence."""
        if linked:
            links = _LINK.findall(text)
            if links:
                text = _LINK.sub(" ", text)
                if sum(map(len, links)) * 2 >= self.size or len(_words(text)) < 4:
                    return "a"
        if text.count("#") > 1 and sum(map(len, _TAG.findall(text))) * 2 >= len(text):
            return "h"
        self.words = words = _words(text)
        n = len(words)
        ended = text.rstrip(_CLOSING)[-1:] in _ENDS
        self.formed = ended and (n >= 2 or _DIGIT.search(text) is not None) and not text.lstrip(_OPENING)[:1].islower()
        if len(set(words)) <= n - 2 and stuffed(words, self.formed):  # else no word comes three times
            return "k"
        short = sum([len(w) <= SHORT for w in words])
        self.tied = short * 2 * TIED >= n and short > 0
        if self.formed and (n < LONG or self.tied):
            return "s"
        if n >= 4 and short * TIED >= n and (n >= 6 or ended):
            return "s"
        if not words or (len(_NUMBER.findall(text)) * WORDS_A_VALUE >= n and not _CODE.fullmatch(text)) or _DOTS.search(text):
            return "v"
        return "k" if n > 8 else "i"

    @property
    def brief(self) -> bool:
        return self.kind in "iks" and 2 <= len(self.words) <= BRIEF and not _DIGIT.search(self.text)

    def shape(self) -> str:
        """The kind, the separator, half the number of words and the capitals, as ``i,1T``."""
        if self.kind != "i":
            return self.kind + self.separator
        words = self.text.split()
        capitals = "U" if self.text.isupper() else "T" if not any(w[:1].islower() for w in words) else "f" if words[0][:1].isupper() else "l"
        return f"i{self.separator}{min(len(self.words), 6) // 2}{capitals}"


def _words(text: str) -> list[str]:
    """Words in lower case."""
    text = text.lower()
    return _WORD.findall(text) if text.isascii() or not _UNSPACED.search(text) else _WORD_OR_CHARACTER.findall(text)


def stuffed(words: list[str], formed: bool) -> bool:
    """Whether one longer word comes three times and makes up a quarter of a unit; without the form of a sentence also if two make up half of the longer ones, or half of them are not new."""
    longer = [w for w in words if len(w) > SHORT]
    times = sorted(Counter(longer).values(), reverse=True)
    if not times or times[0] < 3:
        return False
    if formed:
        return times[0] * 4 >= len(words)
    return times[0] * 4 >= len(words) or sum(times[:2]) * 2 >= len(longer) or len(longer) >= 12 and len(times) * 2 <= len(longer)


def units(text: str) -> Iterator[tuple[str, str, int]]:
    """(unit, separator, times) of a page: sentences, lines, and the items of lists within a line; equal lines and sentences come once."""
    lines = _SENTENCE_END.sub("\\g<0>\n", text)
    if "<" in lines:
        lines = _TAG_LINE.sub("\n", lines)
    for part, times in Counter(map(str.strip, lines.splitlines())).items():
        if not part:
            continue
        if len(_SEPARATOR.findall(part)) > 1:
            items = [x for x in _STRONG.split(part) if x]
            if len(items) < 3 or part.count(",") >= 3 * len(items):
                items = [x for x in _LIST.split(part) if x]
            if len(items) > 2 and listed(part, items):
                for item in items:
                    yield item.strip(), ",", times
                continue
        yield part, "n", times


def listed(part: str, items: list[str]) -> bool:
    """Whether a unit is a list of short items and no sentence or row of values."""
    words = _words(part)
    tied = sum([len(w) <= SHORT for w in words]) * TIED >= len(words)
    if len(words) > (8 if len(items) >= 8 else 6) * len(items):
        return False
    if len(items) >= 8:
        return not (tied and part[-1:] in _ENDS and not part.lstrip(_OPENING)[:1].islower())
    return not tied and _DIGIT.search(part) is None


def keywords(found: list[Unit]) -> set[str]:
    """Words that half of a page's different brief units have: longer ones, and with them short ones that nearly all have.

    Equal units count once, so a sentence said again and again has no keywords;
    units with numbers are not looked at.
    """
    brief = [u for u in found if u.brief]
    if len(brief) < SHARING or sum([u.size * u.times for u in brief]) * 10 < 3 * sum([u.size * u.times for u in found]):
        return set()
    times: Counter[str] = Counter()
    for u in brief:
        times.update(set(u.words))
    longer = {w for w, k in times.items() if k * 2 >= len(brief) and len(w) > SHORT}
    return longer | {w for w, k in times.items() if k * 10 >= len(brief) * 9 and len(w) == SHORT} if longer else longer


def made_of(u: Unit, common: set[str], doubt: bool) -> bool:
    """Whether a brief unit is made of keywords: a quarter of its words, or two fifths of a tied one with the form of a sentence, which must not begin with one."""
    part = sum([w in common for w in u.words])
    if u.formed and (not doubt or u.words[0] in common):
        return False
    return part * 5 >= len(u.words) * 2 if u.formed and u.tied else part * 4 >= len(u.words)


def page(text: str | None) -> tuple[float, int, str]:
    """(share of characters in the ``FEW`` largest repeated non-sentence shapes, their number, the largest one). Null and blank pages: (0, 0, '')."""
    if not text or not text.strip():
        return 0.0, 0, ""
    low = text.lower()
    linked = any(sign in low for sign in _LINK_SIGNS)
    found = [Unit(*u, linked) for u in units(text)]
    common = keywords(found)
    if common:
        doubt = sum([u.brief for u in found]) >= SHARING_FORMED
        for u in found:
            if u.kind == "s" and u.brief and made_of(u, common, doubt):
                u.kind = "k"
    sizes: Counter[str] = Counter()
    times: Counter[str] = Counter()
    for u in found:
        name = u.shape()
        sizes[name] += u.size * u.times
        # shapes that differ in words and capitals only are of one kind; a run of links, tags or keywords is a repetition in itself
        times[name[:2]] += u.times * (1 + (len(u.words) // 6 if u.kind == "k" else u.size // 25 if u.kind in "ah" else 0))
    total = sum(sizes.values())
    bad = sorted(((size, n) for n, size in sizes.items() if n[0] in "akhi" and times[n[:2]] >= REPEATED), reverse=True)[:FEW]
    if not bad or not total:
        return 0.0, 0, ""
    return sum(size for size, _ in bad) / total, len(bad), bad[0][1]


@F.pandas_udf(T.StructType([T.StructField("share", T.DoubleType()), T.StructField("n_shapes", T.IntegerType()), T.StructField("top_shape", T.StringType())]))
def page_shapes(texts: pd.Series) -> pd.DataFrame:
    """:func:`page` of each text of a batch."""
    return pd.DataFrame([page(t) for t in texts], columns=["share", "n_shapes", "top_shape"])


def stuffed_pages(documents: DataFrame, text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of pages most of whose text is repeated keywords, links, labels or tags.

    Whole texts are read, each in its own row: nothing is shuffled. Null, empty
    and blank texts are not flagged; repeated texts are judged alike. Adds
    ``share``, ``n_shapes`` and ``top_shape`` (columns of these names are
    replaced).
    """
    kept = documents.drop("share", "n_shapes", "top_shape")
    judged = kept.where(F.col(text).isNotNull()).withColumn("_page", page_shapes(F.col(text)))
    return judged.where(F.col("_page.share") > share).select(*[F.col(f"`{c}`") for c in kept.columns], "_page.*")
