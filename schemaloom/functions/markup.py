"""Wiki markup to plain text.

Nested constructs aren't regular, so a page is read once with a stack; everything else is one pass of patterns.
Pages go through Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements dropped with their content, and elements that have none.
DROPPED = ("gallery", "timeline", "noinclude", "pre", "table", "tr", "td", "th", "caption", "div", "form", "input", "select", "option", "textarea", "ul", "li", "ol", "dl", "dt", "dd", "menu", "dir", "ref", "references", "img", "imagemap", "source", "small", "sub", "sup")
EMPTY = ("br", "hr", "nobr", "ref", "references", "nowiki")
REPLACED = {"math": "formula", "code": "codice"}
MAGIC = re.compile(r"__[A-Z]+__")
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
COMMENT = re.compile(r"<!--.*?-->", re.S)
EXTERNAL = re.compile(r"\[((?:https?|ftp):[^\s\]]+)(?:\s+([^\]]*))?\]")
IMAGE = re.compile(r"https?://\S+\.(?:gif|png|jpe?g)", re.I)
LINK_TAG = re.compile(r"<(?:a href=|/a>|img src=).*", re.S)
HEADING = re.compile(r"^(={2,6})\s*(.*?)\s*\1$")


def without_nested(text: str, opening: str, closing: str) -> str:
    """``text`` without balanced ``opening ... closing`` parts, however deep; what never closes stays."""
    out, depth, kept = [], 0, 0
    starts: list[int] = []
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if m.group() == opening:
            if depth == 0:
                starts.append(m.start())
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append(text[kept : starts.pop()])
                kept = m.end()
    return "".join(out) + text[kept:]


def internal_links(text: str, namespaces: frozenset[str] = frozenset({"w", "wiktionary", "wikt"})) -> str:
    """``[[page|label]]s`` becomes ``labels``; links into other namespaces go with their nested captions."""
    out, at, stack = [], 0, []
    for m in re.finditer(r"\[\[|\]\]", text):
        if m.group() == "[[":
            stack.append(m.start())
        elif stack:
            start = stack.pop()
            if stack:
                continue
            out.append(text[at:start])
            body, at = text[start + 2 : m.start()], m.end()
            page, _, label = body.partition("|")
            label = label.rsplit("|", 1)[-1] or page
            space = page.lstrip(":").partition(":")
            if not space[1] or space[0].strip().lower() in namespaces or page.startswith(":"):
                out.append(internal_links(label, namespaces))
    return "".join(out) + text[at:]


def external_links(text: str, keep_links: bool = False) -> str:
    """``[url label]`` becomes its label, or a link of HTML; a label that is the address of an image shows nothing without links."""

    def shown(m: re.Match) -> str:
        url, label = m.group(1), (m.group(2) or "").strip()
        if IMAGE.fullmatch(label):
            label = f'<img src="{label}" alt="">' if keep_links else ""
        return f'<a href="{quote(url, safe=":/?&=#%")}">{label}</a>' if keep_links else label

    return EXTERNAL.sub(shown, text)


def without_quotes(text: str) -> str:
    """Bold goes; what is in italics is quoted, once."""
    text = re.sub(r"'{5}(.*?)'{5}", r"\1", text)
    text = re.sub(r"'{3}(.*?)'{3}", r"\1", text)
    text = re.sub(r"''\"([^\"]*)\"''", r'"\1"', text)
    text = re.sub(r"''(.*?)''", r'"\1"', text)
    text = re.sub(r'""([^"]*)""', r'"\1"', text)
    return text.replace("'''", "").replace("''", '"')


def placeholders(text: str) -> str:
    """Formulas and code as numbered words; equal ones share a number."""
    for tag, word in REPLACED.items():
        seen: dict[str, str] = {}
        for m in re.finditer(rf"<{tag}\b[^<>]*>.*?</{tag}\s*>", text, re.I | re.S):
            seen.setdefault(m.group(), f"{word}_{len(seen) + 1}")
        for old, new in seen.items():
            text = text.replace(old, new)
    return text


def plain_text(page: str, expand: Callable[[str], str] | None = None, keep_links: bool = False, html_safe: bool = False) -> str:
    """Markup to text: calls of templates are dropped, or expanded by ``expand``."""
    text = COMMENT.sub("", page)
    text = expand(text) if expand else without_nested(text, "{{", "}}")
    text = without_nested(text, "{|", "|}")
    text = external_links(text, keep_links)
    text = internal_links(text)
    text = MAGIC.sub("", text)
    text = html.unescape(html.unescape(text))
    text = without_quotes(text)
    text = COMMENT.sub("", text)
    for tag in EMPTY:
        text = re.sub(rf"<{tag}\b[^<>]*/\s*>|<{tag}>(?=\s|$)", "", text, flags=re.I)
    for tag in DROPPED:
        text = re.sub(rf"<{tag}\b[^<>]*>.*?</{tag}\s*>", "", text, flags=re.I | re.S)
    text = placeholders(text)
    text = TAG.sub(lambda m: m.group() if keep_links and LINK_TAG.fullmatch(m.group()) else "", text)
    text = text.replace("<<", "«").replace(">>", "»").replace("\t", " ")
    text = re.sub(r" +", " ", text)
    text = re.sub(r"\.{4,}", "...", text)
    text = re.sub(r"(?:\(\s*[,;]*\s*\)|\[\s*\])", "", text)
    text = re.sub(r" ([,.:;?!])", r"\1", text).replace(",,", ",").replace(",.", ".")
    return html.escape(text, quote=False) if html_safe else text


def compact_lines(text: str) -> list[str]:
    """Paragraphs of plain text: headings only where text follows them, without list, table and bracket lines."""
    out: list[str] = []
    waiting: dict[int, str] = {}
    for line in text.split("\n"):
        line = line.strip()
        heading = HEADING.match(line)
        if heading:
            level = len(heading.group(1))
            waiting = {k: v for k, v in waiting.items() if k < level} | {level: heading.group(2)}
        elif not line or line[0] in "*#:;{|}!" or not any(c.isalnum() for c in line):
            continue
        else:
            out += [waiting[k] for k in sorted(waiting) if waiting[k]]
            waiting = {}
            out.append(line)
    return out


@F.pandas_udf(T.StringType())
def page_text(pages: pd.Series) -> pd.Series:
    """Plain paragraphs of each page, one a line; null stays null."""
    return pages.map(lambda t: None if t is None else "\n".join(compact_lines(plain_text(t))))


def normalised_title(title: Column) -> Column:
    """Blanks for underscores, single and inside only, and a capital first letter."""
    clean = F.trim(F.regexp_replace(title, r"[\s_]+", " "))
    return F.concat(F.upper(F.substring(clean, 1, 1)), F.substr(clean, F.lit(2)))
