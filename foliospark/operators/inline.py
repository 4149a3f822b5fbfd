"""CommonMark inline text: emphasis, code, links, raw tags, entities and escapes, reduced to what is visible."""

from __future__ import annotations

import re
import unicodedata
from html.entities import html5

_ESCAPABLE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]*));")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_TAG = re.compile(
    r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>|<!--(?:>|->|.*?-->)|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>",
    re.S,
)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)+)\]", re.S)
_PLAIN = re.compile(r"[^\\`*_\[\]!<&\n]+")


def normal_label(label: str) -> str:
    return " ".join(label.split()).casefold()


def entity(m: re.Match) -> str:
    if m[3]:
        return html5.get(m[3] + ";", m[0])
    n = int(m[1], 16) if m[1] else int(m[2])
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"


def plain(text: str) -> str:
    """Escapes and entities resolved, markup kept."""
    out, i = [], 0
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text) and text[i + 1] in _ESCAPABLE:
            out.append(text[i + 1])
            i += 2
        elif ch == "&" and (m := _ENTITY.match(text, i)):
            out.append(entity(m))
            i = m.end()
        elif ch == "`":
            n = len(text) - i - len(text[i:].lstrip("`"))
            end = _code_end(text, i + n, n)
            out.append(text[i : end + n] if end >= 0 else text[i : i + n])
            i = end + n if end >= 0 else i + n
        else:
            out.append(ch)
            i += 1
    return "".join(out)


def _code_end(text: str, at: int, n: int) -> int:
    for m in re.compile(r"`+").finditer(text, at):
        if len(m[0]) == n:
            return m.start()
    return -1


def _destination(text: str, at: int) -> int:
    """Where a link destination that starts at at ends; -1 if none does."""
    if text[at : at + 1] == "<":
        m = re.compile(r"<(?:[^<>\\\n]|\\.)*>").match(text, at)
        return m.end() if m else -1
    depth, i = 0, at
    while i < len(text):
        ch = text[i]
        if ch == "\\" and text[i + 1 : i + 2] in _ESCAPABLE and i + 1 < len(text):
            i += 2
            continue
        if ch <= " " or ch == "\x7f":
            break
        depth += (ch == "(") - (ch == ")")
        if depth < 0:
            break
        i += 1
    return i if i > at and depth <= 0 else -1


_TITLE = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)", re.S)
_WS = re.compile(r"[ \t]*\n?[ \t]*")


def reference_definition(text: str) -> tuple[str, str, int] | None:
    """Label, destination and end of the link reference definition that text starts with."""
    m = _LABEL.match(text)
    if not m or not m[1].strip() or text[m.end() : m.end() + 1] != ":":
        return None
    at = _WS.match(text, m.end() + 1).end()
    end = _destination(text, at)
    if end < 0:
        return None
    line = re.compile(r"[ \t]*(?:\n|$)")
    space = _WS.match(text, end)
    if space.end() > end and (t := _TITLE.match(text, space.end())) and (e := line.match(text, t.end())):
        return m[1], text[at:end], e.end()
    e = line.match(text, end)
    return (m[1], text[at:end], e.end()) if e else None


def _inline_link(text: str, at: int) -> int:
    """End of (destination "title") that starts at at; -1 if none does."""
    i = re.compile(r"\s*").match(text, at + 1).end()
    if text[i : i + 1] == ")":
        return i + 1
    end = _destination(text, i)
    if end < 0:
        return -1
    s = re.compile(r"\s*").match(text, end)
    i = s.end()
    if s.end() > end and (t := _TITLE.match(text, i)):
        i = re.compile(r"\s*").match(text, t.end()).end()
    return i + 1 if text[i : i + 1] == ")" else -1


def _flanks(before: str, after: str, ch: str) -> tuple[bool, bool]:
    space = lambda c: c == "" or c.isspace()
    punct = lambda c: c != "" and unicodedata.category(c)[0] in "PS"
    left = not space(after) and (not punct(after) or space(before) or punct(before))
    right = not space(before) and (not punct(before) or space(after) or punct(after))
    if ch == "_":
        return left and (not right or punct(before)), right and (not left or punct(after))
    return left, right


def pieces(text: str, references: dict[str, str]) -> list[tuple[str, str]]:
    """(kind, text) of the inline content: text, code, break or html; an empty text stands where markup was."""
    out: list[list] = []
    brackets: list[tuple[int, int, bool, bool]] = []  # piece, place in text, image, active
    delims: list[list] = []  # piece, character, count, opens, closes, original count
    i, n = 0, len(text)

    def emphasis(bottom: int) -> None:
        at = bottom
        while at < len(delims):
            c = delims[at]
            if not c[4] or not c[2]:
                at += 1
                continue
            k = at - 1
            while k >= bottom:
                o = delims[k]
                odd = (o[4] or c[3]) and (o[5] + c[5]) % 3 == 0 and (o[5] % 3 or c[5] % 3)
                if o[1] == c[1] and o[3] and o[2] and not odd:
                    break
                k -= 1
            if k < bottom:
                at += 1
                continue
            o = delims[k]
            use = 2 if o[2] >= 2 and c[2] >= 2 else 1
            o[2] -= use
            c[2] -= use
            for d in delims[k + 1 : at]:
                out[d[0]][1] = d[1] * d[2]
            del delims[k + 1 : at]
            at = k + 1
            if not c[2]:
                at += 1
        for d in delims[bottom:]:
            out[d[0]][1] = d[1] * d[2]
        del delims[bottom:]

    while i < n:
        ch = text[i]
        if m := _PLAIN.match(text, i):
            out.append(["text", m[0]])
            i = m.end()
        elif ch == "\n":
            if out and out[-1][0] == "text":
                out[-1][1] = out[-1][1].rstrip(" ")
            out.append(["break", "\n"])
            i = re.compile(r"[ \t]*").match(text, i + 1).end()
        elif ch == "\\":
            if text[i + 1 : i + 2] == "\n":
                i += 1
            elif i + 1 < n and text[i + 1] in _ESCAPABLE:
                out.append(["text", text[i + 1]])
                i += 2
            else:
                out.append(["text", ch])
                i += 1
        elif ch == "`":
            k = i
            while k < n and text[k] == "`":
                k += 1
            end = _code_end(text, k, k - i)
            if end < 0:
                out.append(["text", text[i:k]])
                i = k
            else:
                code = text[k:end].replace("\n", " ")
                if len(code) > 1 and code[0] == code[-1] == " " and code.strip(" "):
                    code = code[1:-1]
                out.append(["code", code])
                i = end + k - i
        elif ch in "*_":
            k = i
            while k < n and text[k] == ch:
                k += 1
            opens, closes = _flanks(text[i - 1 : i], text[k : k + 1], ch)
            out.append(["text", text[i:k]])
            delims.append([len(out) - 1, ch, k - i, opens, closes, k - i])
            i = k
        elif ch == "[" or ch == "!" and text[i + 1 : i + 2] == "[":
            image = ch == "!"
            i += 1 + image
            out.append(["text", "![" if image else "["])
            brackets.append([len(out) - 1, i, image, True, len(delims)])
        elif ch == "]":
            i += 1
            if not brackets:
                out.append(["text", "]"])
                continue
            piece, start, image, active, bottom = brackets.pop()
            end = -1
            if active:
                if text[i : i + 1] == "(":
                    end = _inline_link(text, i)
                if end < 0:
                    m = _LABEL.match(text, i)
                    label = m[1] if m else text[start : i - 1]
                    if normal_label(label) in references:
                        end = m.end() if m else i + 2 * (text[i : i + 2] == "[]")
            if end < 0:
                out.append(["text", "]"])
                continue
            emphasis(bottom)
            out[piece] = ["text", ""]
            if not image:
                for b in brackets:
                    b[3] = b[2] and b[3]
            i = end
        elif ch == "!":
            out.append(["text", ch])
            i += 1
        elif ch == "<":
            if m := _AUTOLINK.match(text, i):
                out.append(["text", m[1]])
            elif m := _TAG.match(text, i):
                out.append(["html", m[0]])
            else:
                out.append(["text", ch])
            i = m.end() if m else i + 1
        elif m := ch == "&" and _ENTITY.match(text, i):
            out.append(["text", entity(m)])
            i = m.end()
        else:
            out.append(["text", ch])
            i += 1
    emphasis(0)
    return [(k, t) for k, t in out]


def stripped(text: str, references: dict[str, str]) -> str:
    """Text without markup: links and emphasis give their text, images their alternative, tags nothing."""
    if _PLAIN.fullmatch(text):
        return text
    return "".join(t for k, t in pieces(text, references) if k != "html")


def visible(text: str, references: dict[str, str], faithful: bool = False) -> str:
    """As stripped, in one line; faithful puts code in backticks, the other form parts words where markup stands."""
    if _PLAIN.fullmatch(text):
        return " ".join(text.split())
    gap = "" if faithful else " "
    shown = {"code": "`{}`" if faithful else " {} ", "break": " "}
    parts = [gap if k == "html" or not t else shown.get(k, "{}").replace("{}", t) for k, t in pieces(text, references)]
    return " ".join("".join(parts).split())
