"""The text that a message's sender wrote in it.

Parts are found and decoded as they come: headers folded or missing, boundaries without an end, transfer encodings undone, charset labels
only believed where the bytes agree. Of the own part are then left out: quoted and forwarded messages, greeting, closing, signature and
disclaimer. Everything here is plain Python on one text, with patterns that don't backtrack over the whole text.
"""

from __future__ import annotations

import binascii
import html
import quopri
import re

_HEADER = re.compile(r"([!-9;-~]+)[ \t]*:(.*)")
_BOUNDARY = re.compile(r"boundary\s*=\s*(?:\"([^\"]*)\"|([^\s;]+))", re.IGNORECASE)
_CHARSET = re.compile(r"charset\s*=\s*\"?([^\s;\"]+)", re.IGNORECASE)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")


def _headers(text: str) -> tuple[dict[str, str], str]:
    """The header fields (lower case, unfolded) and the rest. A text that doesn't begin with a header is all rest."""
    fields: dict[str, str] = {}
    at, name = 0, ""
    while at < len(text):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        after = end + 1 if end >= 0 else len(text)
        if not line.strip():
            return fields, text[after:]
        if line[0] in " \t" and name:
            fields[name] += " " + line.strip()
        elif found := _HEADER.match(line):
            name = found[1].lower()
            fields.setdefault(name, found[2].strip())
        elif line.startswith("From "):  # the separator of mailbox files
            name = ""
        else:
            return (fields, text[at:]) if fields else ({}, text)
        at = after
    return fields, ""


def _charset_text(data: bytes, content_type: str) -> str:
    label = _CHARSET.search(content_type)
    for charset in ("utf-8", label[1] if label else "utf-8"):
        try:
            return data.decode(charset)
        except (LookupError, ValueError):
            pass
    return data.decode("latin-1")


def _decoded(body: str, encoding: str, content_type: str) -> str:
    encoding = encoding.strip().lower()
    if encoding == "quoted-printable":
        return _charset_text(quopri.decodestring(body.encode("utf-8", "surrogatepass")), content_type)
    if encoding == "base64":
        digits = _NOT_BASE64.sub("", body)
        digits = digits[: len(digits) - 1] if len(digits) % 4 == 1 else digits
        try:
            return _charset_text(binascii.a2b_base64(digits + "=" * (-len(digits) % 4)), content_type)
        except binascii.Error:
            return body
    return body


def _multipart(kind: str, content_type: str, body: str) -> list[str] | None:
    """The texts of the parts of a multipart body, in order; None for any other body, or where no boundary is found in it."""
    boundary = _BOUNDARY.search(content_type)
    if not kind.startswith("multipart/") or not boundary:
        return None
    pieces = ("\n" + body).split("\n--" + (boundary[1] or boundary[2] or ""))
    if len(pieces) == 1:
        return None
    parts = []
    for piece in pieces[1:]:
        if piece.startswith("--"):
            break
        parts.append(piece.partition("\n")[2])
    return parts


def _leaf_parts(text: str) -> list[tuple[str, str]]:
    """(kind, decoded text) of the parts to read: of alternatives the plain ones, no attachments, no messages inside. Nested to any depth."""
    root: list = []
    # Each entry: a text still to read, the list its parts go to, or (None, list, target): children are read, choose among them.
    stack: list[tuple[str | None, list, list]] = [(text, root, root)]
    while stack:
        part, found, target = stack.pop()
        if part is None:
            plain = [p for p in found if p[0] == "text/plain" and p[1].strip()]
            target += plain or found
            continue
        fields, body = _headers(part)
        content_type = fields.get("content-type", "text/plain")
        kind = content_type.split(";")[0].strip().lower()
        inner = _multipart(kind, content_type, body)
        if inner is not None:
            into = found
            if kind == "multipart/alternative":
                into = []
                stack.append((None, into, found))
            stack += [(x, into, into) for x in reversed(inner)]
        elif kind.startswith("multipart/") and _BOUNDARY.search(content_type):
            found.append(("text/plain", body))
        elif kind.startswith("text/") and not fields.get("content-disposition", "").lower().startswith("attachment"):
            found.append((kind, _decoded(body, fields.get("content-transfer-encoding", ""), content_type)))
    return root


_DROPPED_ELEMENTS = re.compile(r"<(style|script|head|title|blockquote)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.IGNORECASE | re.DOTALL)
_LINE_ENDS = re.compile(r"<br\s*/?>\n?|</?(?:p|div|ul|ol|table|pre|h\d)\b[^<>]*>\n?", re.IGNORECASE)
_ITEM, _CELL, _ROW = re.compile(r"<li\b[^<>]*>", re.IGNORECASE), re.compile(r"</t[dh]>\s*(?=<t[dh])", re.IGNORECASE), re.compile(r"</(?:tr|li)>\n?", re.IGNORECASE)
_TAG = re.compile(r"<[/!?A-Za-z][^<>]*>")


def html_text(markup: str) -> str:
    """Markup as lines: items get a bullet, cells a tab between them, quotations are left out."""
    text = _DROPPED_ELEMENTS.sub("", markup)
    text = _ITEM.sub("- ", _ROW.sub("\n", _CELL.sub("\t", _LINE_ENDS.sub("\n", text))))
    return html.unescape(_TAG.sub("", text)).replace("\xa0", " ")


_ATTRIBUTION = re.compile(r"\s*(?:On|Am|Le|El|Il|On the)\b.{5,}\b(?:wrote|schrieb|escri\S{1,12}|\S{0,14}crit)\b.{0,60}:\s*$")
_CUT = re.compile(
    r"\s*-{2,}\s*(?:Original|Forwarded|Urspr|Weitergeleitet|Message d|Mensaje|Message transf|Mensaje reenv).*-{2,}\s*$|\s*Begin forwarded message:|\s*_{5,}\s*From:", re.IGNORECASE
)
_BLOCK_FROM = re.compile(r"(?:From|Von|De)\s*: ?\S")
_BLOCK_SENT = re.compile(r"(?:Sent|Date|Gesendet|Datum|Envoy\S{1,3}|Enviado|Fecha)\s*: ?\S")
_QUOTE = re.compile(r"\s*>")
_SIGNATURE = re.compile(r"--\s?$")
_RULE = re.compile(r"\s*(?:_{5,}|\*{5,}|-{3,}|={5,}|#{5,})\s*$")
#: Words of the four languages that disclaimers are made of.
_DISCLAIMER_WORDS = re.compile(
    r"(?i)received (?:it|this)|in error|confidential|intended|meant only|liable|liability|virus|before you print|views in this|contract is formed|privileged"
    r"|irrt\S{1,8}mlich|haftet|haftung|vertraulich|nur f\S{1,8}r den|solo para la persona|recibido por|b\S{1,8}rrelo|se hace responsable|confidencial"
    r"|seule personne|re\S{1,8}u par erreur|d\S{1,8}truire|d\S{1,8}cline|responsabilit|confidentiel"
)
#: Greetings and closings of the four languages.
_GREETING = re.compile(
    r"(?i)\s*(?:dear|hi|hello|hey|good (?:morning|day|afternoon|evening)|hallo|moin|liebe[rs]?|guten (?:tag|morgen|abend)|sehr geehrte[rs]?|servus|bonjour|bonsoir|salut|ch\S{1,8}re?s?|hola|buen[oa]s|estimad[oa]s?|querid[oa]s?)\b[^.?!;]{0,45}[,:!]?\s*$"
)
_CLOSING = re.compile(
    r"(?i)\s*(?:(?:best|kind|warm|many)?\s*(?:regards|wishes|thanks)|best|cheers|thanks(?: again)?|thank you|yours(?: \w+)?|sincerely|mit (?:freundlichen|besten|vielen) gr\S{1,10}|(?:viele|beste|liebe|sch\S{1,8}ne)?\s*gr\S{1,10}|danke|cordialement|merci|bien \S{1,8} vous|\S{1,4} bient\S{1,8}t|(?:un )?saludos?(?: cordial\w*)?|gracias|atentamente|un abrazo)\s*[,.!]?\s*$"
)
_NAME = re.compile(r"\s*[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+){0,2}\s*[.,]?\s*$")
_NAMED_GREETING = re.compile(r"\s*[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+){0,2}\s*(?: -|,|:)\s*$")


def _without_quotes(lines: list[str]) -> list[str]:
    own, at = [], 0
    while at < len(lines):
        line = lines[at]
        if _QUOTE.match(line) or not line:
            if not line:
                own.append(line)
            at += 1
            continue
        if _CUT.match(line) or _BLOCK_FROM.match(line) and at + 1 < len(lines) and _BLOCK_SENT.match(lines[at + 1]):
            break
        attributed = line[0] in "OALEI \t" and (_ATTRIBUTION.match(line) or at + 1 < len(lines) and len(line) > 20 and lines[at + 1][:1] not in "|> " and _ATTRIBUTION.match(line + " " + lines[at + 1]) and 2)
        if attributed:
            at += 2 if attributed == 2 else 1
            while at < len(lines) and not lines[at].strip():
                at += 1
            prefix = lines[at].lstrip()[:1] if at < len(lines) else ""
            if prefix and prefix in ">|:":
                while at < len(lines) and lines[at].lstrip()[:1] == prefix:
                    at += 1
                continue
            break  # quoted without marks: to the end
        own.append(line)
        at += 1
    return own


def _without_frame(lines: list[str]) -> list[str]:
    """Without greeting, closing, signature and disclaimer."""
    for i, line in enumerate(lines):
        if line[:2] == "--" and _SIGNATURE.match(line):
            lines = lines[:i]
            break
    lines = _trimmed(lines)
    # Disclaimers: the last paragraphs, as long as they speak of errors, liability and the like; a rule above them goes too.
    while lines:
        begin = len(lines)
        while begin and lines[begin - 1].strip() and not _RULE.match(lines[begin - 1]):
            begin -= 1
        paragraph = lines[begin:]
        if len(paragraph) > 8 or not paragraph or not _DISCLAIMER_WORDS.search(" ".join(paragraph)):
            break
        lines = _trimmed(lines[:begin])
        if lines and _RULE.match(lines[-1]):
            lines = _trimmed(lines[:-1])
    for i in range(max(0, len(lines) - 8), len(lines)):
        if _CLOSING.match(lines[i]) and (i or len(lines) > 1) and all(not x.strip() or len(x) < 40 for x in lines[i + 1 :]):
            lines = lines[:i]
            break
    lines = _trimmed(lines)
    if lines and _NAME.match(lines[-1]) and (len(lines) == 1 or not lines[-2].strip() or _ends_block(lines)):
        lines = _trimmed(lines[:-1])
    if lines and (_GREETING.match(lines[0]) or _NAMED_GREETING.match(lines[0]) and (len(lines) < 2 or not lines[1].strip())):
        lines = lines[1:]
    return _trimmed(lines)


def _ends_block(lines: list[str]) -> bool:
    """A single capitalised word right below a line that looks nothing like it is a name."""
    return " " not in lines[-1].strip() and (len(lines[-2]) > 20 or "\t" in lines[-2] or lines[-2].rstrip()[-1:] in ".!?")


def _trimmed(lines: list[str]) -> list[str]:
    begin, end = 0, len(lines)
    while begin < end and not lines[begin].strip():
        begin += 1
    while end > begin and not lines[end - 1].strip():
        end -= 1
    return lines[begin:end]


def own_lines(text: str) -> list[str]:
    """The lines of the own text, blank ones inside it included."""
    own: list[str] = []
    for kind, part in _leaf_parts(text.replace("\r\n", "\n").replace("\r", "\n")):
        plain = html_text(part) if kind == "text/html" else part
        own += _without_frame(_without_quotes(_trimmed(plain.replace("\r\n", "\n").replace("\r", "\n").split("\n"))))
    return own
