"""Row-local document functions that SQL cannot express, as Arrow-batched pandas UDFs.

Each is a plain Python function first, so it can be tested without Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is not shown.
HIDDEN = ("script", "style", "noscript", "iframe", "object", "embed")
BLOCKS = ("p", "div", "section", "article", "ul", "ol", "table", "blockquote", "pre", "header", "footer", "main")


# --- HTML -------------------------------------------------------------------

class _Text(HTMLParser):
    """Text outside hidden elements; any other element's start ends hiding, nested ones included."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hide = [], False

    def handle_starttag(self, tag, attrs):
        self.hide = tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if not self.hide:
            self.out.append(data)


def html_to_text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return "".join(p.out).strip()


class _Markdown(HTMLParser):
    """A documented subset: headings, paragraphs, lists, links, emphasis, code, rules and breaks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.href: list[str] = []
        self.pre = False

    def block(self):
        self.out.append("\n\n")

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.block()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.block()
            self.out.append("---")
            self.block()
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.block() if len(self.lists) == 1 else None
        elif tag == "li":
            depth = max(len(self.lists) - 1, 0)
            mark = "-   "
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}.  "
            self.out.append("\n" + "    " * depth + mark)
        elif tag in BLOCKS:
            self.block()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag) or (tag in BLOCKS and tag not in ("ul", "ol", "pre")):
            self.block()
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.block() if not self.lists else None

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Markdown()
    p.feed(html)
    p.close()
    text = re.sub(r"[ \t]+\n(?!\n)", lambda m: "  \n" if m[0].startswith("  ") else "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+\n", "\n\n", text)).strip()


# --- Markdown ---------------------------------------------------------------

def sections(text: str | None, names: list[str]) -> list[str]:
    """Sections under second- and third-level headings of the given names, fences respected."""
    out = []
    for name in names:
        level, kept, fenced = 0, [], False
        for line in (text or "").split("\n"):
            head = None
            if line.lstrip().startswith("```"):
                fenced = not fenced
            elif not fenced:
                head = re.match(r"^(#{2,3})\s+(.+?)\s*$", line)
            if head and not level:
                level = len(head[1]) if head[2].lower() == name.lower() else 0
            elif head and len(head[1]) <= level:
                break
            if level:
                kept.append(line)
        if kept:
            out.append("\n".join(kept).strip())
    return out


# --- fuzzy replacement ------------------------------------------------------

def levenshtein(a: str, b: str) -> int:
    if not a or not b:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _spans(lines: list[str], size: int) -> Iterator[list[str]]:
    for i in range(len(lines) - size + 1):
        yield lines[i:i + size]


def _bare(find: str) -> list[str]:
    """Lines of a search text, without the empty one that a final line end makes."""
    lines = find.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _where(test: Callable[[str], str]) -> Callable[[str, str], Iterator[str]]:
    """Blocks of as many lines as ``find`` that equal it under a normal form."""
    def strategy(content: str, find: str) -> Iterator[str]:
        want = test(find)
        for span in _spans(content.split("\n"), find.count("\n") + 1):
            if test("\n".join(span)) == want:
                yield "\n".join(span)

    return strategy


def _exact(content: str, find: str) -> Iterator[str]:
    yield find


def _line_trimmed(content: str, find: str) -> Iterator[str]:
    want = [x.strip() for x in _bare(find)]
    for span in _spans(content.split("\n"), len(want)):
        if [x.strip() for x in span] == want:
            yield "\n".join(span)


def _anchored(content: str, find: str) -> Iterator[list[str]]:
    """From each line equal to the first searched line to the next one equal to the last."""
    lines, want = content.split("\n"), _bare(find)
    for i, line in enumerate(lines):
        if line.strip() == want[0].strip():
            for j in range(i + 2, len(lines)):
                if lines[j].strip() == want[-1].strip():
                    yield lines[i:j + 1]
                    break


def _alike(block: list[str], want: list[str]) -> float:
    """Mean likeness of the inner lines that both have; 1 where there is none to compare."""
    n = min(len(want), len(block)) - 2
    if n <= 0:
        return 1.0
    total = 0.0
    for a, b in zip(block[1:1 + n], want[1:1 + n], strict=True):
        longest = max(len(a.strip()), len(b.strip()))
        if longest:
            total += 1 - levenshtein(a.strip(), b.strip()) / longest
    return total / n


def _block_anchor(content: str, find: str) -> Iterator[str]:
    """A sole candidate always counts; of several the likeliest, if it is alike enough."""
    if find.count("\n") < 2:
        return
    found = list(_anchored(content, find))
    if len(found) == 1:
        yield "\n".join(found[0])
    elif found:
        scores = [_alike(x, _bare(find)) for x in found]
        if max(scores) >= 0.3:
            yield "\n".join(found[scores.index(max(scores))])


def _one_blank(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _blank_folded(content: str, find: str) -> Iterator[str]:
    want = _one_blank(find)
    inner = re.compile(r"\s+".join(map(re.escape, find.split())))
    for line in content.split("\n"):
        if _one_blank(line) == want:
            yield line
        elif want in _one_blank(line) and (hit := inner.search(line)):
            yield hit[0]
    if "\n" in find:
        yield from _where(_one_blank)(content, find)


def _unindented(text: str) -> str:
    lines = text.split("\n")
    depths = [len(x) - len(x.lstrip()) for x in lines if x.strip()]
    return "\n".join(x[min(depths):] if x.strip() else x for x in lines) if depths else text


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _unescaped(text: str) -> str:
    return re.sub(r"\\(n|t|r|'|\"|`|\\|\n|\$)", lambda m: _ESCAPES.get(m[1], m[1]), text)


def _escape_folded(content: str, find: str) -> Iterator[str]:
    want = _unescaped(find)
    if want in content:
        yield want
    for span in _spans(content.split("\n"), want.count("\n") + 1):
        if _unescaped("\n".join(span)) == want:
            yield "\n".join(span)


def _edge_trimmed(content: str, find: str) -> Iterator[str]:
    if find.strip() == find:
        return
    if find.strip() in content:
        yield find.strip()
    yield from _where(str.strip)(content, find)


def _half_alike(content: str, find: str) -> Iterator[str]:
    if find.count("\n") < 2:
        return
    want = [x.strip() for x in _bare(find)]
    for block in _anchored(content, find):
        if len(block) == len(want):
            pairs = [(a.strip(), b) for a, b in zip(block[1:-1], want[1:-1], strict=True) if a.strip() or b]
            if not pairs or sum(a == b for a, b in pairs) / len(pairs) >= 0.5:
                yield "\n".join(block)


#: Tried in this order; the first that finds a unique place decides.
STRATEGIES = (_exact, _line_trimmed, _block_anchor, _blank_folded, _where(_unindented), _escape_folded, _edge_trimmed, _half_alike)


def fuzzy_replace(content: str, old: str, new: str, everywhere: bool = False) -> str:
    """Replaces the one place (or every place) that matches ``old``; ValueError says why not."""
    if old == new:
        raise ValueError("identical")
    seen = False
    for strategy in STRATEGIES:
        for found in strategy(content, old):
            if found not in content:
                continue
            seen = True
            if everywhere:
                return content.replace(found, new)
            if content.find(found) == content.rfind(found):
                return content.replace(found, new, 1)
    raise ValueError("ambiguous" if seen else "not found")


# --- patches ----------------------------------------------------------------

# Punctuation folded to ASCII in the last pass.
_PUNCTUATION = {c: to for cs, to in (("\u2018\u2019\u201a\u201b", "'"), ("\u201c\u201d\u201e\u201f", '"'), ("\u2010\u2011\u2012\u2013\u2014\u2015", "-"), ("\u2026", "..."), ("\u00a0", " ")) for c in cs}
_FOLD = str.maketrans(_PUNCTUATION)


def seek(lines: list[str], pattern: list[str], start: int = 0, at_end: bool = False) -> int:
    """Where a block of lines stands: exactly, without trailing blanks, trimmed, or with its
    punctuation folded; -1 if nowhere."""
    if not pattern:
        return -1
    last = len(lines) - len(pattern)
    for form in (str, str.rstrip, str.strip, lambda x: x.strip().translate(_FOLD)):
        want = [form(x) for x in pattern]
        places = ([last] if at_end and last >= start else []) + list(range(start, last + 1))
        for i in places:
            if [form(x) for x in lines[i:i + len(pattern)]] == want:
                return i
    return -1


# --- as columns -------------------------------------------------------------

def _mapped(fn: Callable, kind) -> Callable:
    @F.pandas_udf(kind)
    def column(s: pd.Series) -> pd.Series:
        return s.map(fn)

    return column


text_of_html = _mapped(html_to_text, T.StringType())
markdown_of_html = _mapped(html_to_markdown, T.StringType())


def section_column(names: list[str]):
    return _mapped(lambda t: sections(t, names), T.ArrayType(T.StringType()))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def replaced(content: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """fuzzy_replace by row; a failure is an error value, not an exception."""
    out = []
    for c, o, n in zip(content, old, new, strict=True):
        try:
            out.append((fuzzy_replace(c, o, n), None))
        except ValueError as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["text", "error"])


@F.pandas_udf(T.IntegerType())
def place_of(lines: pd.Series, pattern: pd.Series) -> pd.Series:
    """seek by row, from the start."""
    return pd.Series([seek(list(a), list(b)) for a, b in zip(lines, pattern, strict=True)], dtype="int32")
