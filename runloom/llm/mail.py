"""Reading the text of raw e-mail: MIME parts, transfer encodings, mark-up and entities.

Pure Python without Spark, used inside Arrow-batched operators. Nothing here raises on damaged input: what can't be
decoded is kept as it stands, and a message without a usable header block counts as one plain part.
"""

from __future__ import annotations

import binascii
import html
import re
import unicodedata

_HEADER = re.compile(r"[!-9;-~]+[ \t]*:")
_CTYPE = re.compile(r"(?im)^content-type[ \t]*:[ \t]*([^;\s]*)((?:[^\n]|\n[ \t])*)")
_CTE = re.compile(r"(?im)^content-transfer-encoding[ \t]*:[ \t]*\"?([\w-]+)")
_DISPOSITION = re.compile(r"(?im)^content-disposition[ \t]*:[ \t]*\"?([\w-]+)")
_BOUNDARY = re.compile(r"(?i)boundary[ \t]*=[ \t]*(?:\"([^\"\n]+)\"|([^\s;]+))")
_CHARSET = re.compile(r"(?i)charset[ \t]*=[ \t]*\"?([\w.:-]+)")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_OPENS = re.compile(r"<!--|<(script|style|head|title|blockquote)\b", re.I)
_CLOSES = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "head", "title", "blockquote")} | {"": re.compile("-->")}
_ANCHOR = re.compile(r"(?i)<a\s[^<>]*href")
_BREAK = re.compile(r"(?i)</?(?:p|br|div|li|ul|ol|tr|td|th|table|tbody|thead|h[1-6]|hr|blockquote|pre|body|html|section|article|header|footer|dt|dd|dl)\b[^<>]*>")
_TAG = re.compile(r"<[!?/]?[A-Za-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")


def _decode_bytes(data: bytes, charset: str) -> str:
    try:
        return data.decode(charset or "utf-8", "strict")
    except (LookupError, UnicodeDecodeError):
        try:
            return data.decode("utf-8", "strict")
        except UnicodeDecodeError:
            return data.decode("latin-1")


def _transfer_decode(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        packed = _NOT_BASE64.sub("", body)
        packed = packed[: len(packed) - (len(packed) % 4 == 1)]
        try:
            return _decode_bytes(binascii.a2b_base64(packed + "=" * (-len(packed) % 4)), charset)
        except (binascii.Error, ValueError):
            return body
    if encoding == "quoted-printable":
        return _decode_bytes(binascii.a2b_qp(body.encode("utf-8", "surrogatepass")), charset)
    return body


def _shown(page: str, quotes: bool) -> str:
    """A page without comments and elements that don't show, with or without quoted blocks, in one pass. What is never
    closed is left as it stands."""
    out, at, unclosed = [], 0, set()
    for m in _OPENS.finditer(page):
        name = (m[1] or "").lower()
        if m.start() < at or name in unclosed or (quotes and name == "blockquote"):
            continue
        if end := _CLOSES[name].search(page, m.end()):
            out.append(page[at : m.start()])
            out.append("<p>" if name == "blockquote" else " ")
            at = end.end()
        else:
            unclosed.add(name)
    return "".join([*out, page[at:]]) if out else page


def html_to_text(page: str, quotes: bool = True) -> str:
    """Visible text of a page: block tags break lines, other tags vanish, entities are undone."""
    # source line ends are white space; only block tags break lines
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", _shown(page, quotes).replace("\n", " "))))


def anchors(page: str) -> int:
    return len(_ANCHOR.findall(page))


def _split(message: str) -> tuple[str, str]:
    if not _HEADER.match(message):
        return "", message[1:] if message.startswith("\n") else message
    head, gap, body = message.partition("\n\n")
    return head + "\n", body


def leaf_parts(raw: str | None) -> list[tuple[str, bool, str]]:
    """(media type, attached, decoded body) of every leaf part that holds text, in order. Binary parts are left out.

    However deep parts lie: an inner part is shorter than its message by a head or a boundary, so the walk ends.
    """
    if not raw:
        return []
    out, stack = [], [(raw.replace("\r\n", "\n").replace("\r", "\n"), False)]
    while stack:
        message, attached = stack.pop()
        head, body = _split(message)
        kind, tail = m.groups() if (m := _CTYPE.search(head)) else ("text/plain", "")
        kind = kind.strip("\"' ").lower() or "text/plain"
        attached = attached or bool((d := _DISPOSITION.search(head)) and d[1].lower() == "attachment")
        if kind.startswith("multipart/") and (b := _BOUNDARY.search(tail)):
            pieces = re.split(r"(?m)^--" + re.escape(b[1] or b[2]) + r"(--)?[ \t]*$\n?", body)
            if len(pieces) > 1:
                inner = []
                for i in range(2, len(pieces), 2):
                    if pieces[i - 1] is None:
                        inner.append((pieces[i], attached))
                stack.extend(reversed(inner))
                continue
            kind = "text/plain"
        encoding = e[1].lower() if (e := _CTE.search(head)) else "8bit"
        if kind.startswith("multipart/"):
            kind = "text/plain"
        if not kind.startswith(("text/", "message/")):
            continue
        charset = c[1] if (c := _CHARSET.search(tail)) else "utf-8"
        body = _transfer_decode(body, encoding, charset)
        if kind == "message/rfc822":
            stack.append((body.replace("\r\n", "\n").lstrip("\n"), attached))
            continue
        out.append((kind, attached, body.replace("\r\n", "\n").replace("\r", "\n") if "\r" in body else body))
    return out


def readable_texts(raw: str | None) -> list[str]:
    """The readable text parts of a message, plain, HTML and attached text alike."""
    return [html_to_text(body) if kind.endswith(("html", "xml")) else body for kind, _, body in leaf_parts(raw)]


def words(text: str) -> list[str]:
    """Unbroken runs of letters and digits, case folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.casefold())


def word_places(text: str) -> list[tuple[int, int]]:
    """Where each of words(text) begins and ends in a text of composed characters."""
    out = []
    for m in _WORD.finditer(text):
        # folding may take a word apart, as with a dotted capital I
        out += [m.span()] * (1 if m[0].isascii() else len(_WORD.findall(m[0].casefold())))
    return out
