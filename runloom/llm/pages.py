"""Own text of a mail page, cut into units, and the content and link features of those units. Pure Python."""

from __future__ import annotations

import re
from collections import Counter

from runloom.llm.mail import anchors, html_to_text, leaf_parts

_QUOTE_INTRO = re.compile(r"^(?:on|am|le|el|op)\b.{0,120}(?:wrote|schrieb|a écrit|escribió|schreef)[^:\n]{0,80}:$", re.I)
_FORWARD = re.compile(r"^-{2,} ?(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|mensaje original)", re.I)
_GREETING = re.compile(r"^(?:(?:hello|hi|dear|hey|good (?:morning|day|evening)|hallo|liebe[rs]?|guten (?:tag|morgen)|bonjour|salut|chers?|chère|hola|estimad[oa]s?|buenos días)\b[^.!?\n]{0,40}[,!:]?|[^\W\d_]+(?: [^\W\d_]+)? ?[-–—,:!])$", re.I)
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]”]*\s+")
_BULLET = re.compile(r"(?:[-*•·+]|\d{1,4}[.)])\s")
_SEPARATORS = ",;|•·/#—"

# fixed values: words by which notices under a mail are known, in lower case
SHORT = 120  # characters of a paragraph that is a notice however it is put
NOTICES = (
    "confidential", "privileged", "vertraulich", "confidentiel", "confidencial", "disclaimer", "addressee", "intended recipient", "empfänger", "destinataire", "destinatario",
    "unsubscribe", "by mistake", "in error", "liability",
)
# fixed values: common function words of English, German, French and Spanish
FUNCTION_WORDS = frozenset(
    """a an the this that these those each every some any another no neither either nor our your their its his her my
    and or but if when then because while of in on at to from with by for under over inside outside behind beside beyond
    between above below before after against across around towards near is are was were be been will would could should
    must can may do does did not it he she they we you i who which what how there here have has had as than
    der die das ein eine einen dem den des und oder aber wir ich ihr sie unser jeder dieser ist war nicht mit ohne bei bis
    auf an am im dass zu von für noch heute bitte haben hinter neben gegen unter
    le la les un une des du de et ou mais nous vous il elle notre votre chaque cette ce est sera ne pas que avec avant après
    par pour dans sur je
    el los las una y o pero nuestro nuestra cada esta este está será por favor con antes después hemos en al""".split()
)


def own_text(raw: str | None) -> tuple[list[list[str]], int]:
    """Paragraphs (lists of lines) of the page without greeting, signature, notices and quoted replies, and the number
    of linked anchors."""
    paragraphs: list[list[str]] = []
    linked = 0
    for kind, _, body in leaf_parts(raw):
        text = body
        if kind.endswith(("html", "xml")):
            text, linked = html_to_text(body, quotes=False), linked + anchors(body)
        block: list[str] = []
        signature = False
        for line in text.split("\n"):
            line = line.strip()
            if not line:
                signature = False
            elif line in ("--", "—") or line.startswith("-- "):
                signature = True
            elif not (signature or line[0] == ">" or (line[-1] == ":" and _QUOTE_INTRO.match(line)) or (line[0] == "-" and _FORWARD.match(line))):
                block.append(line)
                continue
            if block:
                paragraphs.append(block)
                block = []
        if block:
            paragraphs.append(block)
    kept = []
    for p in paragraphs:
        if len(p) <= 6:
            n = sum(x.count(" ") for x in p) + len(p)
            if n <= 5 and (_GREETING.match(" ".join(p)) or (n <= 2 and all(x.replace(" ", "").isalpha() for x in p))):
                continue
            low = " ".join(p).lower()
            if n > 4 and any(x in low for x in NOTICES) and _reads(p):
                continue
        kept.append(p)
    return kept, linked


def _reads(lines: list[str]) -> bool:
    """Whether a paragraph is short, or at least half of it reads as sentences: a heap with a notice's word is no notice."""
    size = sum(map(len, lines))
    return size <= SHORT or sum(len(u) for u, ok in units(lines) if ok) >= size / 2


def units(lines: list[str]) -> list[tuple[str, bool]]:
    """(unit, whether it reads as a sentence). List items and lines with links stand alone, other lines run on.

    A sentence ends as one, has 3 to 80 words, few separators and little of its length in links; or, however
    punctuated, has the function words of running text.
    """
    joined: list[str] = []
    alone = True
    for line in lines:
        single = "://" in line or "www." in line or _BULLET.match(line) is not None
        if single or alone:
            joined.append(line)
        else:
            joined[-1] += " " + line
        alone = "://" in line or "www." in line
    out = []
    for text in joined:
        for unit in _SENTENCE.split(text):
            if not unit:
                continue
            bare = _URL.sub("", unit) if "://" in unit or "www." in unit else unit
            words = bare.split()
            n = len(words)
            linked = len(unit) - len(bare) > 0.6 * len(unit)
            separators = sum(map(bare.count, _SEPARATORS)) + bare.count(" - ")
            hyphens = bare.count("-")
            ended = unit.rstrip("\"')]”").endswith((".", "!", "?"))
            sentence = ended and 3 <= n <= 80 and separators <= 0.3 * n and hyphens <= 0.5 * n
            if not sentence and n >= 3:
                plain = [w.strip(".,;:!?\"“”'()-/—").lower() for w in words]
                plain = [w for w in plain if w]
                sentence = sum(w in FUNCTION_WORDS for w in plain) >= 0.28 * max(1, len(plain)) and len(set(plain)) > 0.35 * len(plain)
            out.append((unit, sentence and not linked))
    return out


def page_units(paragraphs: list[list[str]]) -> list[tuple[str, bool]]:
    """units() of all paragraphs; what a page says again and again is a heap even if it is put as a sentence: three times
    without any function word, or six times with."""
    found = [u for p in paragraphs for u in units(p)]
    often = {u: n for u, n in Counter(u.lower() for u, ok in found if ok).items() if n >= 3}
    if not often:
        return found
    bare = {u for u, n in often.items() if n >= 6 or not any(w.strip(".,;:!?\"'()") in FUNCTION_WORDS for w in u.split())}
    return [(u, ok and u.lower() not in bare) for u, ok in found]


FEATURES = ("heap_share", "heap_units", "separators", "function_words", "longest_unit", "repeated_lines", "top_word", "distinct", "links", "link_chars", "anchors", "bullets", "short_lines", "capital_starts")


def features(raw: str | None) -> tuple[float, ...]:
    """FEATURES of one page; all 0 for a page without own text."""
    paragraphs, linked = own_text(raw)
    all_units = page_units(paragraphs)
    chars = sum(len(u) for u, _ in all_units)
    if not chars:
        return (0.0,) * len(FEATURES)
    text = " ".join([u for u, _ in all_units])
    found = text.lower().split()
    n = len(found)
    counts = Counter(found)
    lines = [x for p in paragraphs for x in p]
    same = Counter(lines)
    urls = _URL.findall(text) if "://" in text or "www." in text else []
    heap = [u for u, ok in all_units if not ok]
    return (
        sum(map(len, heap)) / chars,
        len(heap) / len(all_units),
        (sum(map(text.count, _SEPARATORS)) + text.count(" - ")) / n,
        sum(c for w, c in counts.items() if w in FUNCTION_WORDS) / n,
        min(1.0, max(len(u) for u, _ in all_units) / 2000),
        sum(len(x) * c for x, c in same.items() if c > 1) / max(1, sum(map(len, lines))),
        max(counts.values()) / n,
        len(counts) / n,
        len(urls) / n,
        sum(map(len, urls)) / chars,
        linked / n,
        sum(1 for x in lines if _BULLET.match(x)) / len(lines),
        sum(1 for x in lines if len(x) < 30) / len(lines),
        sum(1 for u, _ in all_units if u[:1].isupper()) / len(all_units),
    )
