"""Markdown of findings as HTML: blocks first, then what stands in them.

Texts are escaped before they are read, as reports do, so nothing in them is HTML or a quotation; ``\\n`` written out is a line's end. Known: headings, paragraphs, fenced and indented code, lists (nested, tight and loose),
rules, tables, and in them code, emphasis, strike-through, links, images and hard breaks. Footnotes are left as text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^`\n]*)$")
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
BULLET = re.compile(r"^( {0,3})([-+*]|(\d{1,9})[.)])([ \t]+|$)(.*)$")
DIVIDER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LINK = re.compile(r"\(\s*(?:&lt;([^\n]*?)&gt;|([^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:\"([^\"]*)\"|'([^']*)'))?\s*\)")


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def to_html(text: str) -> str:
    return "".join(_blocks(escaped(text.replace("\\n", "\n")).replace("\r\n", "\n").expandtabs(4).split("\n"), False))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _cells(line: str) -> list[str]:
    inner = re.sub(r"(?<!\\)\|$", "", line.strip().removeprefix("|"))
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


def _begins(line: str) -> bool:
    """Whether a line ends a paragraph before it."""
    item = BULLET.match(line)
    return bool(FENCE.match(line) or HEADING.match(line) or RULE.match(line) or (item and item[5].strip() and item[3] in (None, "1")))


def _blocks(lines: list[str], tight: bool) -> list[str]:
    """The blocks of lines as HTML; in a tight list paragraphs stand bare."""
    out, i, n = [], 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif _indent(line) >= 4:
            j = i
            while j < n and (_indent(lines[j]) >= 4 or not lines[j].strip()):
                j += 1
            out.append(f"<pre><code>{escaped(chr(10).join(x[4:] for x in lines[i:j]).rstrip())}\n</code></pre>\n")
            i = j
        elif fence := FENCE.match(line):
            j = i + 1
            end = re.compile(rf"^ {{0,3}}{re.escape(fence[2][0])}{{{len(fence[2])},}}[ \t]*$")
            while j < n and not end.match(lines[j]):
                j += 1
            body = "".join(x[min(_indent(x), len(fence[1])) :] + "\n" for x in lines[i + 1 : j])
            kind = fence[3].split()
            out.append(f"<pre><code{f' class={chr(34)}language-{kind[0]}{chr(34)}' if kind else ''}>{escaped(body)}</code></pre>\n")
            i = j + 1
        elif (head := HEADING.match(line)) is not None:
            out.append(f"<h{len(head[1])}>{inline((head[2] or '').strip())}</h{len(head[1])}>\n")
            i += 1
        elif RULE.match(line):
            out.append("<hr />\n")
            i += 1
        elif BULLET.match(line):
            html, i = _list(lines, i)
            out.append(html)
        elif i + 1 < n and "|" in line and DIVIDER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            html, i = _table(lines, i)
            out.append(html)
        else:
            j, level = i + 1, 0
            while j < n and lines[j].strip() and not level:
                if under := UNDERLINE.match(lines[j]):
                    level = 1 if under[1][0] == "=" else 2
                elif _begins(lines[j]):
                    break
                else:
                    j += 1
            text = inline("\n".join(x.lstrip(" ") for x in lines[i:j]).rstrip())
            if level:
                out.append(f"<h{level}>{text}</h{level}>\n")
                j += 1
            else:
                out.append(text + "\n" if tight else f"<p>{text}</p>\n")
            i = j
    return out


def _list(lines: list[str], i: int) -> tuple[str, int]:
    first = BULLET.match(lines[i])
    mark, n = first[2][-1], len(lines)
    items: list[list[str]] = []
    loose = gap = False
    while i < n:
        item = BULLET.match(lines[i])
        if not item or item[2][-1] != mark or RULE.match(lines[i]):
            break
        loose |= gap and bool(items)
        room = len(item[4]) if item[5].strip() and len(item[4]) <= 4 else 1
        width = len(item[1]) + len(item[2]) + room
        own = [" " * (len(item[4]) - room) + item[5]]
        i, blank = i + 1, not item[5].strip()
        while i < n:
            line = lines[i]
            if not line.strip():
                own.append("")
                blank = True
            elif _indent(line) >= width:
                own.append(line[width:])
                blank = False
            elif not blank and not _begins(line) and not BULLET.match(line):
                own.append(line.lstrip(" "))  # a paragraph goes on
            else:
                break
            i += 1
        gap = not own[-1].strip() and len(own) > 1
        while own and not own[-1].strip():
            own.pop()
        items.append(own)
    loose |= any(_parted(own) for own in items)
    out = []
    for own in items:
        parts = _blocks(own, not loose)
        inner = "".join(parts)
        if loose and parts:
            out.append(f"<li>\n{inner}</li>\n")
        else:
            # A bare paragraph stands on the item's own line; before the item's end there is no line's end after it.
            bare = own and own[0].strip() and not _starts_block(own[0])
            ends_bare = parts and not parts[-1].endswith((">\n",)) or len(parts) == 1 and bare
            out.append(f"<li>{'' if bare or not parts else chr(10)}{inner[:-1] if ends_bare else inner}</li>\n")
    kind = "ul" if first[3] is None else "ol"
    start = f' start="{int(first[3])}"' if kind == "ol" and int(first[3]) != 1 else ""
    return f"<{kind}{start}>\n{''.join(out)}</{kind}>\n", i


def _starts_block(line: str) -> bool:
    return bool(FENCE.match(line) or HEADING.match(line) or RULE.match(line) or BULLET.match(line) or _indent(line) >= 4)


def _parted(own: list[str]) -> bool:
    """Whether an item's own blocks are parted by an empty line (inside code and deeper lists none counts)."""
    fence, deep = None, False
    for k, line in enumerate(own):
        found = FENCE.match(line)
        if found and (fence is None or found[2].startswith(fence)):
            fence = found[2] if fence is None else None
        if BULLET.match(line):
            deep = True
        if not line.strip() and fence is None and k + 1 < len(own):
            after = next((x for x in own[k:] if x.strip()), "")
            if not (deep and (_indent(after) >= 2 or BULLET.match(after))):
                return True
    return False


def _table(lines: list[str], i: int) -> tuple[str, int]:
    heads, marks = _cells(lines[i]), _cells(lines[i + 1])
    align = [f' style="text-align: {k}"' if k else "" for k in ("center" if m[0] == m[-1] == ":" and len(m) > 1 else "left" if m[0] == ":" else "right" if m[-1] == ":" else "" for m in marks)]
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}{a}>{inline(c)}</{tag}>" for c, a in zip(cells + [""] * len(heads), align)) + "</tr>"
    out = f"<table><thead>{row(heads, 'th')}</thead>"
    i, body = i + 2, []
    while i < len(lines) and lines[i].strip() and not _begins(lines[i]):
        body.append(row(_cells(lines[i])[: len(heads)], "td") + "\n")
        i += 1
    return out + ("<tbody>\n" + "".join(body) + "</tbody>" if body else "") + "</table>\n", i


def inline(text: str) -> str:
    """Code, links, images, emphasis and breaks of a block's text."""
    out: list[list] = []  # [kind, html, mark, count, opens, closes]
    i, n = 0, len(text)

    def put(html: str) -> None:
        out.append(["text", html])

    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n:
            if text[i + 1] == "\n":
                put("<br />\n")
                i += 2
                continue
            if text.startswith(("&amp;", "&lt;", "&gt;"), i + 1):
                stop = text.index(";", i) + 1
                put(text[i + 1 : stop])
                i = stop
                continue
            if text[i + 1] in PUNCTUATION:
                put(text[i + 1].replace('"', "&quot;"))
                i += 2
                continue
        if c == "`":
            ticks = re.match("`+", text[i:])[0]
            close = re.search(rf"(?<!`){ticks}(?!`)", text[i + len(ticks) :])
            if close:
                code = text[i + len(ticks) : i + len(ticks) + close.start()].replace("\n", " ")
                if code[:1] == code[-1:] == " " and code.strip():
                    code = code[1:-1]
                put(f"<code>{escaped(code)}</code>")
                i += len(ticks) + close.end()
            else:
                put(ticks)
                i += len(ticks)
            continue
        if c == "[" or text.startswith("![", i):
            image = c == "!"
            end = _bracket(text, i + image)
            found = LINK.match(text, end + 1) if end > 0 else None
            if found:
                to = (found[1] if found[1] is not None else found[2]).replace('"', "%22")
                title = next((t for t in (found[3], found[4]) if t is not None), None)
                more = f' title="{title.replace(chr(34), "&quot;")}"' if title is not None else ""
                inner = inline(text[i + image + 1 : end])
                put(f'<img src="{to}" alt="{re.sub("<[^>]*>", "", inner)}"{more} />' if image else f'<a href="{to}"{more}>{inner}</a>')
                i = found.end()
                continue
        if c in "*_~":
            run = re.match(re.escape(c) + "+", text[i:])[0]
            before, after = text[i - 1] if i else " ", text[i + len(run)] if i + len(run) < n else " "
            space, mark = str.isspace, lambda x: x in PUNCTUATION
            left = not space(after) and (not mark(after) or space(before) or mark(before))
            right = not space(before) and (not mark(before) or space(after) or mark(after))
            opens, closes = (left and (not right or mark(before)), right and (not left or mark(after))) if c == "_" else (left, right)
            if c == "~" and len(run) > 2:
                opens = closes = False
            out.append(["run", "", c, len(run), opens, closes, len(run)])
            i += len(run)
            continue
        if c == "\n":
            hard = i >= 2 and text[i - 2 : i] == "  "
            if out and out[-1][0] == "text":
                out[-1][1] = out[-1][1].rstrip(" ")
            put("<br />\n" if hard else "\n")
            i += 1
            while i < n and text[i] == " ":
                i += 1
            continue
        stop = i + 1
        while stop < n and text[stop] not in "\\`[!*_~\n":
            stop += 1
        put(text[i:stop].replace('"', "&quot;"))
        i = stop
    return _emphasised(out)


def _bracket(text: str, i: int) -> int:
    """Where the bracket that opens at i closes, code and escaped brackets passed over; -1 if it doesn't."""
    depth, k = 0, i
    while k < len(text):
        if text[k] == "\\":
            k += 1
        elif text[k] == "`":
            ticks = re.match("`+", text[k:])[0]
            close = text.find(ticks, k + len(ticks))
            k = close + len(ticks) - 1 if close >= 0 else k + len(ticks) - 1
        elif text[k] == "[":
            depth += 1
        elif text[k] == "]":
            depth -= 1
            if not depth:
                return k
        k += 1
    return -1


def _emphasised(out: list[list]) -> str:
    """Runs of marks paired from the left, each closing one with the nearest that opens."""
    k, bottom = 0, {}  # below which runs of a kind have nothing that opens them
    while k < len(out):
        run = out[k]
        if run[0] != "run" or not run[5] or not run[3]:
            k += 1
            continue
        kind = run[2], run[4], run[6] % 3 if run[2] != "~" else run[3]
        for j in range(k - 1, bottom.get(kind, 0) - 1, -1):
            o = out[j]
            if o[0] != "run" or o[2] != run[2] or not o[4] or not o[3]:
                continue
            if run[2] == "~":
                if o[3] != run[3]:
                    continue
                use, tag = run[3], "del"
            else:
                if (o[5] or run[4]) and (o[6] + run[6]) % 3 == 0 and (o[6] % 3 or run[6] % 3):
                    continue
                use = 2 if o[3] >= 2 and run[3] >= 2 else 1
                tag = "strong" if use == 2 else "em"
            o[3] -= use
            run[3] -= use
            inner = "".join(x[1] if x[0] == "text" else x[2] * x[3] for x in out[j + 1 : k])
            out[j + 1 : k] = [["text", f"<{tag}>{inner}</{tag}>"]]
            k = j + 2
            bottom = {x: min(b, j) for x, b in bottom.items()}
            break
        else:
            run[5], bottom[kind] = False, k
        if not run[5] or not run[3]:
            k += 1
    return "".join(x[1] if x[0] == "text" else x[2] * x[3] for x in out)


def html(text: Column) -> Column:
    """A column of markdown as HTML, over Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def converted(texts: pd.Series) -> pd.Series:
        return texts.map(to_html, na_action="ignore")

    return converted(text)
