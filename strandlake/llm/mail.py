"""The prose a message's sender wrote: bodies found and decoded, everything else taken out."""

from __future__ import annotations

import binascii
import html
import re
from bisect import bisect_right
from quopri import decodestring

_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:(?: |\t|$|\n)")
_PART_HEAD = re.compile(r"(?m)^--(?=\S)(.{1,100})\n(?=content-[a-z-]+:)", re.I)
_BASE64_LINE = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}\Z")
_QP = re.compile(r"=[0-9A-F]{2}|=\n")
_TAG_BREAK = re.compile(r"<\s*(?:br|/p|/div|/tr|/li|/h\d)\b[^>]*>\n?", re.I)
_DROPPED = re.compile(r"<(blockquote|style|script|head)\b", re.I)
_CLOSED = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("blockquote", "style", "script", "head")}
_TAG = re.compile(r"<[^<>]*>")
_QUOTE = re.compile(r"\s{0,3}[>|:](?:[\s>|:]|[^\s]|$)")
_ATTRIBUTION = re.compile(
    r"\s*(?:(?:On|Am|Le|El)\b.{0,160}?(?:wrote|schrieb|a écrit|escribió)\b.{0,60}|.{1,60}\b(?:writes|wrote|schreibt|schrieb|écrit|escribe|escribió)\s?)\s?:\s*\Z"
)
_ORIGINAL = re.compile(
    r"\s*-{3,}\s*\S[^-]{2,60}\s*-{3,}\s*\Z|\s*(?:From|Von|De)\s?:\s.*@|\s*(?:From|Von|De)\s?:\s+\S.*\Z", re.I
)
_RULE = re.compile(r"\s*([-_*=~#+])\1+\s*\Z")
_END_MARK = re.compile(r"\s*-{2,}\s*(?:End|Ende|Fin)\b[^-]{0,60}-{2,}\s*\Z", re.I)
_PASTED = re.compile(
    r"\$ |\[\d|\s*File \"|Traceback\b|[A-Za-z.]*(?:Error|Exception|Warning)\b:|https?://|www\.|begin \d{3} |(?:\S+\t)+\S+|@@ |\+\+\+ |--- |[ \t]{4,}\S"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_BODY_KINDS = ("text/plain", "text/html")


def _headers(block: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in re.sub(r"\n[ \t]+", " ", block).split("\n"):
        name, found, value = line.partition(":")
        if found:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _split(entity: str) -> tuple[dict[str, str], str]:
    if not _HEADER.match(entity):
        return {}, entity
    head, _, body = entity.partition("\n\n")
    return _headers(head), body


def _bytes_text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _decoded(headers: dict[str, str], body: str) -> str:
    """The body's text, by what it looks like where the header names another encoding."""
    encoding = headers.get("content-transfer-encoding", "").lower().strip()
    lines = [x.strip() for x in body.strip().split("\n") if x.strip()]
    packed = bool(lines) and all(_BASE64_LINE.match(x) for x in lines[:-1]) and " " not in lines[-1]
    if packed and (encoding == "base64" or (len(lines) > 1 and len(lines[0]) >= 60)):
        data = re.sub(r"[^A-Za-z0-9+/]", "", "".join(lines))
        try:
            return _bytes_text(binascii.a2b_base64(data[: len(data) // 4 * 4] if len(data) % 4 == 1 else data + "=" * (-len(data) % 4)))
        except binascii.Error:
            return body
    if encoding == "quoted-printable" or (encoding != "base64" and len(_QP.findall(body)) >= 3 and "=\n" in body):
        return _bytes_text(decodestring(body.encode("utf-8", "surrogatepass")))
    return body


def _parts(headers: dict[str, str], body: str) -> list[str]:
    named = re.search(r'boundary\s*=\s*(?:"([^"]*)"|([^\s;]+))', headers.get("content-type", ""), re.I)
    mark = (named.group(1) or named.group(2) or "") if named else ""
    if not mark or f"--{mark}" not in body:
        seen = _PART_HEAD.search(body)
        if not seen:
            return []
        mark = seen.group(1).rstrip()
    pieces = re.split(rf"(?m)^--{re.escape(mark)}(?:--)?[ \t]*$\n?", body)
    return [p for p in pieces[1:] if p.strip()]


def _is_attachment(headers: dict[str, str]) -> bool:
    return "attachment" in headers.get("content-disposition", "").lower() or bool(re.search(r"\bname\s*=", headers.get("content-type", ""), re.I))


def _bodies(headers: dict[str, str], body: str) -> list[tuple[str, str]]:
    """(kind, decoded text) of the sender's text bodies, in order: all inline ones, one of each set of alternatives.

    Entities wait in a list, so parts may nest to any depth.
    """
    entities = [(headers, body)]
    inside: list[tuple[bool, list[int]] | None] = []  # of a container: whether its parts are alternatives, and their numbers
    leaf: list[tuple[str, str] | None] = []
    at = 0
    while at < len(entities):
        own, content = entities[at]
        kind = own.get("content-type", "text/plain").split(";")[0].strip().lower()
        inside.append(None)
        leaf.append(None)
        if not _is_attachment(own):
            if kind.startswith("multipart/") or (at == 0 and _PART_HEAD.search(content)):
                parts = _parts(own, content)
                if parts:
                    inside[at] = (kind == "multipart/alternative", list(range(len(entities), len(entities) + len(parts))))
                    entities += [_split(p.lstrip("\n") if _HEADER.match(p.lstrip("\n")) else p) for p in parts]
                kind = "text/plain"
            if inside[at] is None and kind in _BODY_KINDS:
                leaf[at] = (kind, _decoded(own, content))
        entities[at] = ({}, "")
        at += 1
    found: list[list[tuple[str, str]]] = [[] for _ in entities]
    for i in range(len(entities) - 1, -1, -1):  # parts come after their container
        if inside[i] is None:
            found[i] = [leaf[i]] if leaf[i] and leaf[i][1].strip() else []
            continue
        alternatives, parts = inside[i]
        sets = [found[k] for k in parts if found[k]]
        if alternatives:
            plain = [x for x in sets if any(kind == "text/plain" for kind, _ in x)]
            found[i] = (plain or sets or [[]])[0]
        else:
            found[i] = [x for one in sets for x in one]
        for k in parts:
            found[k] = []
    return found[0]


def _without_dropped(body: str) -> str:
    """Takes out elements whose content isn't the sender's text; one that isn't closed stays. One pass, however many open."""
    out, at, unclosed = [], 0, set()
    for m in _DROPPED.finditer(body):
        name = m.group(1).lower()
        if m.start() < at or name in unclosed:
            continue
        end = _CLOSED[name].search(body, m.end())
        if end is None:
            unclosed.add(name)
            continue
        out += [body[at : m.start()], "\n"]
        at = end.end()
    return "".join([*out, body[at:]])


def _plain(kind: str, body: str) -> str:
    if kind == "text/html" or re.match(r"\s*<(?:html|!doctype)", body, re.I):
        body = _without_dropped(body)
        body = _TAG_BREAK.sub("\n", body)
        body = html.unescape(_TAG.sub("", body)).replace("\xa0", " ")
    return body


def message_body(text: str) -> str:
    """The plain bodies with content that aren't attachments, joined; without any, the HTML ones as plain text."""
    unix = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff\n")
    if unix.startswith("From ") and _HEADER.match(unix.partition("\n")[2]):
        unix = unix.partition("\n")[2]
    headers, body = _split(unix)
    found = _bodies(headers, body)
    for kind in _BODY_KINDS:
        texts = [_plain(k, b).replace("\r\n", "\n").replace("\r", "\n") for k, b in found if k == kind]
        if texts:
            return "\n\n".join(texts)
    return ""


def _is_sequence(line: str) -> bool:
    return " " not in line and len(line) > 12 and not line.isalpha() or (" " not in line and len(line) >= 25)


def _resumes(lines: list[str], at: int, ends: list[int]) -> int | None:
    """Where own text may go on after the rule or "original message" line at ``at``; None: nowhere.

    A block below it that is quoted line by line is passed over by its marks, one with an end mark by
    that mark. Anything else below (a signature, a footer, mail forwarded without marks) runs to the end.
    """
    below = at + 1
    while below < len(lines) and not lines[below].strip():
        below += 1
    if _END_MARK.match(lines[at]) or (below < len(lines) and _QUOTE.match(lines[below])):
        return at + 1
    if not _RULE.match(lines[at]):
        k = bisect_right(ends, at)
        return ends[k] + 1 if k < len(ends) else None
    return None


def own_paragraphs(text: str) -> list[str]:
    """Paragraphs of prose by the sender; no quotes, greetings, signatures, notices, footers or pasted lines."""
    kept: list[str] = []
    lines = message_body(text).split("\n")
    ends = [i for i, x in enumerate(lines) if _END_MARK.match(x)]
    i = -1
    while i + 1 < len(lines):
        i += 1
        line = lines[i]
        bare = line.strip()
        if not bare:
            kept.append("")
            continue
        if _QUOTE.match(line):
            continue
        if _RULE.match(line) or _ORIGINAL.match(line) or _END_MARK.match(line):
            after = _resumes(lines, i, ends)
            if after is None:
                break
            kept.append("")
            i = after - 1
            continue
        if _ATTRIBUTION.match(line) or (i + 1 < len(lines) and len(bare) < 120 and _ATTRIBUTION.match(f"{bare} {lines[i + 1].strip()}") and re.match(r"(?:On|Am|Le|El)\b", bare)):
            continue
        if _PASTED.match(line) or _is_sequence(bare) or "\t" in line:
            continue
        kept.append(bare)
    paragraphs = [re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n", "\n".join(kept))]
    paragraphs = [p for p in paragraphs if p]
    return [p for p in paragraphs if not (len(p.split()) <= 4 and not re.search(r"[.!?]\Z", p))]


def own_words(text: str) -> list[str]:
    """The words of the sender's own prose, in order, lower-case."""
    return [w.lower() for p in own_paragraphs(text) for w in _WORD.findall(p)]
