"""Templates of wiki markup: calls, arguments, parser functions and magic words.

A text is read once into a tree of calls and arguments; expanding walks the tree. Calls of templates that aren't known give
nothing, as do those nested deeper than MOST_CALLS.
"""

from __future__ import annotations

import datetime
import html
import math
import operator
import re
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.session import with_checkpoints

MOST_CALLS, MOST_ARGUMENTS = 30, 10
# Prefixes of a title that change nothing here, and functions without a result.
SUBSTITUTION = ("subst:", "safesubst:")
WITHOUT_RESULT = ("#ifexpr", "#ifexist", "#rel2abs", "#time", "#timel", "#titleparts")
PART = re.compile(r"\{\{+|\}\}+|\[\[|\]\]|\||=")


@dataclass
class Call:
    """``{{...}}`` (braces 2) or ``{{{...}}}`` (braces 3); a part is a list of strings and calls."""

    braces: int
    parts: list[list] = field(default_factory=lambda: [[]])


def matching_braces(text: str, braces: int = 2) -> list[tuple[int, int]]:
    """Spans of the outermost balanced runs of so many braces; of a run of more the inner ones count."""
    found, stack = [], []
    for m in re.finditer(r"\{+|\}+", text):
        run = len(m.group())
        if m.group()[0] == "{":
            if run >= braces:
                stack.append((m.end() - braces, run))
        elif stack and run >= braces:
            start, _ = stack.pop()
            if not stack:
                found.append((start, m.start() + braces))
    return found


def balanced(text: str, opening: str = "[[", closing: str = "]]") -> list[tuple[int, int]]:
    """Spans of the outermost balanced ``opening ... closing`` parts."""
    found, starts = [], []
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if m.group() == opening:
            starts.append(m.start())
        elif starts:
            start = starts.pop()
            if not starts:
                found.append((start, m.end()))
    return found


def parsed(text: str) -> list:
    """The tree of ``text``: strings and calls. Bars inside links and inner calls don't part; braces that never close are text."""
    top: list = []
    stack: list[Call] = []
    links: list[int] = [0]
    at = 0

    def put(piece) -> None:
        target = stack[-1].parts[-1] if stack else top
        if isinstance(piece, str) and target and isinstance(target[-1], str):
            target[-1] += piece
        elif piece:
            target.append(piece)

    def fold() -> None:
        """An unclosed call is text again."""
        lost = stack.pop()
        links.pop()
        put("{" * lost.braces)
        for i, part in enumerate(lost.parts):
            if i:
                put("|")
            for piece in part:
                put(piece)

    for m in PART.finditer(text):
        put(text[at : m.start()])
        at = m.end()
        token = m.group()
        if token[0] == "{":
            run = len(token)
            while run >= 2:  # arguments, of three braces, are inside calls, of two
                braces = 3 if run % 3 == 0 else 2
                stack.append(Call(braces))
                links.append(0)
                run -= braces
            put("{" * run)
        elif token[0] == "}":
            run = len(token)
            while run >= 2 and stack:
                braces = stack[-1].braces
                if braces > run:
                    if run == 2 and braces == 3:
                        stack[-1].braces = 2
                        whole = stack.pop()
                        links.pop()
                        put("{")
                        put(whole)
                        run -= 2
                        continue
                    break
                done = stack.pop()
                links.pop()
                put(done)
                run -= braces
            put("}" * run)
        elif token == "[[":
            links[-1] += 1
            put(token)
        elif token == "]]":
            links[-1] = max(0, links[-1] - 1)
            put(token)
        elif token == "|" and stack and not links[-1]:
            stack[-1].parts.append([])
        else:
            put(token)
    put(text[at:])
    while stack:
        fold()
    return top


def first_capital(text: str) -> str:
    return text[:1].upper() + text[1:]


def title_of(name: str, namespaces: frozenset[str] = frozenset()) -> str:
    """A page's canonical title: blanks for underscores, capitals at the start and after a known namespace."""
    name = re.sub(r"[\s_]+", " ", name.strip(" _"))
    space, colon, rest = name.partition(":")
    if not colon or not rest.strip():
        return first_capital(name)
    known = first_capital(space.strip().lower())
    if known in namespaces:
        return f"{known}:{first_capital(rest.strip())}"
    return first_capital(space) + ":" + (" " if rest[0] == " " else "") + first_capital(rest.strip())


def template_title(name: str) -> str:
    """The template that a call names: ``:Page`` is a page itself, ``Template:`` may be left out; '' names nothing."""
    name = name.strip()
    if name.startswith(":"):
        return title_of(name[1:])
    if re.match(r"(?i)template\s*:", name):
        name = name.partition(":")[2]
    return title_of(name) if name.strip(" _") else ""


OPERATORS: dict[str, tuple[int, Callable[[float, float], float]]] = {
    "or": (1, lambda a, b: float(bool(a) or bool(b))), "and": (2, lambda a, b: float(bool(a) and bool(b))),
    "=": (3, lambda a, b: float(a == b)), "<>": (3, lambda a, b: float(a != b)), "!=": (3, lambda a, b: float(a != b)),
    "<": (3, lambda a, b: float(a < b)), ">": (3, lambda a, b: float(a > b)), "<=": (3, lambda a, b: float(a <= b)), ">=": (3, lambda a, b: float(a >= b)),
    "round": (4, lambda a, b: round(a, int(b))), "+": (5, operator.add), "-": (5, operator.sub),
    "*": (6, operator.mul), "/": (6, operator.truediv), "div": (6, operator.truediv), "mod": (6, math.fmod), "^": (7, operator.pow),
}
NUMBER_TOKEN = re.compile(r"\s*(\d+\.?\d*(?:e[+-]?\d+)?|\.\d+|[a-z]+|<>|!=|<=|>=|[-+*/^()<>=])", re.I)


def value_of(expression: str) -> float:
    """An arithmetic expression by precedence; a malformed one raises ValueError."""
    tokens, at = [], 0
    expression = html.unescape(expression).strip().lower()
    while at < len(expression):
        m = NUMBER_TOKEN.match(expression, at)
        if not m:
            raise ValueError(expression[at:])
        tokens.append(m.group(1))
        at = m.end()
    tokens.append("")

    def operand() -> float:
        token = tokens.pop(0)
        if token == "(":
            inside = level(0)
            if tokens.pop(0) != ")":
                raise ValueError("unclosed")
            return inside
        if token in ("+", "-"):
            return operand() if token == "+" else -operand()
        if token == "not":
            return float(not operand())
        if token in ("abs", "floor", "ceil", "trunc"):
            return float({"abs": abs, "floor": math.floor, "ceil": math.ceil, "trunc": math.trunc}[token](operand()))
        if token in ("pi", "e"):
            return math.pi if token == "pi" else math.e
        return float(token)

    def level(least: int) -> float:
        left = operand()
        while tokens[0] in OPERATORS and OPERATORS[tokens[0]][0] > least:
            rank, apply = OPERATORS[tokens.pop(0)]
            left = apply(left, level(rank))
        return left

    out = level(0)
    if tokens != [""]:
        raise ValueError(expression)
    return out


def shown(number: float) -> str:
    return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)


class Expander:
    """Expands the calls of one page. ``templates`` maps titles to bodies; ``modules`` maps (module, function) to functions of the arguments."""

    def __init__(self, templates: dict[str, str], magic: dict[str, str] | None = None, modules: dict | None = None):
        self.templates, self.magic, self.modules = templates, {"!": "|"} | (magic or {}), modules or {}
        self.trees: dict[str, list] = {}

    def expand(self, text: str) -> str:
        return self.walk(parsed(text), None, 0)

    def walk(self, tree: list, arguments: dict[str, str] | None, depth: int) -> str:
        return "".join(x if isinstance(x, str) else self.call(x, arguments, depth) for x in tree)

    def call(self, call: Call, arguments: dict[str, str] | None, depth: int) -> str:
        if call.braces == 3:
            return self.argument(call, arguments, depth)
        if depth >= MOST_CALLS:
            return ""
        name = self.walk(call.parts[0], arguments, depth).strip()
        for prefix in SUBSTITUTION:
            if name.lower().startswith(prefix):
                name = name[len(prefix) :]
        if name.lower() in self.magic:
            return self.magic[name.lower()]
        function, colon, first = name.partition(":")
        if colon and (function.startswith("#") or function.lower() in FUNCTIONS):
            return self.function(function.lower(), first.strip(), call.parts[1:], arguments, depth)
        title = template_title(name)
        if title not in self.templates:
            return ""
        if title not in self.trees:
            self.trees[title] = parsed(included(self.templates[title]))
        return self.walk(self.trees[title], self.given(call.parts[1:], arguments, depth), depth + 1)

    def argument(self, call: Call, arguments: dict[str, str] | None, depth: int) -> str:
        name = self.walk(call.parts[0], arguments, depth).strip()
        if arguments is not None and name in arguments:
            return arguments[name]
        if len(call.parts) > 1:
            return self.walk(call.parts[1], arguments, depth) if depth < MOST_CALLS + MOST_ARGUMENTS else ""
        return "" if arguments is not None else "{{{" + name + "}}}"

    def given(self, parts: list[list], arguments: dict[str, str] | None, depth: int) -> dict[str, str]:
        """Arguments by name or by number; the last of a name counts, blanks around a value go unless it holds a link."""
        out, number = {}, 0
        for part in parts:
            text = self.walk(part, arguments, depth)
            name, equals, value = text.partition("=")
            if equals and "[[" not in name and "<" not in name:
                key = name.strip()
            else:
                number += 1
                key, value = str(number), text
            out[key] = value if "]]" in value else value.strip()
        return out

    def function(self, name: str, first: str, rest: list[list], arguments: dict[str, str] | None, depth: int) -> str:
        lazy = lambda i: self.walk(rest[i], arguments, depth).strip() if i < len(rest) else ""
        if name == "#if":
            return lazy(0 if first else 1)
        if name == "#ifeq":
            other = lazy(0)
            return lazy(1 if equal(first, other) else 2)
        if name == "#iferror":
            failed = 'class="error"' in first
            return lazy(0) if failed else (lazy(1) if len(rest) > 1 else first)
        if name == "#expr":
            try:
                return shown(value_of(first)) if first else ""
            except (ValueError, ZeroDivisionError, OverflowError, IndexError):
                return '<span class="error"></span>'
        if name == "#switch":
            return self.switch(first, rest, arguments, depth)
        if name == "#invoke":
            made = self.modules.get((first, lazy(0)))
            return str(made(*(lazy(i) for i in range(1, len(rest))))) if made else ""
        if name in WITHOUT_RESULT:
            return ""
        return FUNCTIONS[name](first) if name in FUNCTIONS else ""

    def switch(self, key: str, cases: list[list], arguments: dict[str, str] | None, depth: int) -> str:
        falls, default, last = False, None, None
        for case in cases:
            text = self.walk(case, arguments, depth)
            name, equals, value = text.partition("=")
            name = name.strip()
            if not equals:
                falls, last = falls or equal(name, key), name
            elif falls or equal(name, key):
                return value.strip()
            elif name == "#default":
                default = value.strip()
                last = None
            else:
                last = None
        return last if last is not None else default or ""


def equal(a: str, b: str) -> bool:
    try:
        return float(a) == float(b)
    except ValueError:
        return a == b


FUNCTIONS: dict[str, Callable[[str], str]] = {
    "urlencode": lambda s: urllib.parse.quote_plus(s), "lc": str.lower, "uc": str.upper, "ucfirst": first_capital,
    "lcfirst": lambda s: s[:1].lower() + s[1:], "int": lambda s: s,
}


def included(body: str) -> str:
    """What of a template's page is put into others: without comments and ``noinclude``; only ``onlyinclude`` where there is some."""
    body = re.sub(r"<!--.*?-->", "", body, flags=re.S)
    body = re.sub(r"<noinclude\s*>.*?(?:</noinclude\s*>|\Z)", "", body, flags=re.S | re.I)
    only = re.findall(r"<onlyinclude\s*>(.*?)</onlyinclude\s*>", body, re.S | re.I)
    return re.sub(r"</?includeonly\s*/?>", "", "".join(only) if only else body, flags=re.I)


def clock_words(now: datetime.datetime) -> dict[str, str]:
    """Magic words of date and time, at a stated time, so that a page has one result."""
    return {
        "currentyear": f"{now:%Y}", "currentmonth": f"{now:%m}", "currentday": f"{now:%d}", "currenthour": f"{now:%H}", "currenttime": f"{now:%H:%M:%S}",
    }


@F.pandas_udf(T.StringType())
def titles(names: pd.Series) -> pd.Series:
    """The templates that names mean; null stays null."""
    return names.map(lambda n: None if n is None else template_title(n))


def resolved(templates: DataFrame) -> DataFrame:
    """``title, body`` of ``name, body, target``: a redirect has the body of the template it leads to."""
    rows = templates.select(titles("name").alias("title"), "body", titles("target").alias("target"))
    bodies = rows.where("target is null or target = ''").select(F.col("title").alias("target"), F.col("body").alias("_body"))
    return rows.join(bodies, "target", "left").select("title", F.when(F.coalesce("target", F.lit("")) == "", F.col("body")).otherwise(F.col("_body")).alias("body")).where("title <> '' and body is not null")


CALLED = r"\{\{\s*(?:(?i:subst|safesubst)\s*:)?\s*([^{}|<>\[\]\n#]+?)\s*(?:\||\}\}|\n)"


def with_templates(pages: DataFrame, page: str, text: str, templates: DataFrame) -> DataFrame:
    """``page, templates``: for each page a map of the templates that it calls, also by way of others; ``templates`` is ``title, body``.

    The closure over calls is found among templates alone. Names made by other calls aren't seen and give nothing.
    """
    with_checkpoints(pages.sparkSession)
    names = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(CALLED), F.lit(1))))
    calls = templates.select("title", names(F.col("body")).alias("n")).select("title", titles("n").alias("callee")).distinct().checkpoint()
    reach, frontier = calls, calls
    while True:
        step = frontier.alias("f").join(calls.alias("c"), F.col("f.callee") == F.col("c.title")).select("f.title", "c.callee").distinct()
        frontier = step.join(reach, ["title", "callee"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        reach = reach.unionByName(frontier).checkpoint()
    direct = pages.select(F.col(page).alias("_page"), names(F.col(text)).alias("n")).select("_page", titles("n").alias("title")).distinct()
    used = direct.unionByName(direct.join(reach, "title").select("_page", F.col("callee").alias("title"))).distinct()
    return used.join(templates, "title").groupBy(F.col("_page").alias(page)).agg(F.map_from_entries(F.collect_list(F.struct("title", "body"))).alias("templates"))


def expanded(pages: DataFrame, page: str, title: str, text: str, templates: DataFrame, magic: dict[str, str] | None = None) -> DataFrame:
    """``pages`` with the calls in ``text`` expanded; ``templates`` is ``name, body, target``. A null text stays null."""
    own = with_templates(pages, page, text, resolved(templates))
    rows = pages.join(own.withColumnRenamed("templates", "_templates"), page, "left")

    def run(batches):
        for part in batches:
            out = []
            for name, body, known in zip(part[title], part[text], part["_templates"]):
                words = (magic or {}) | {"pagename": name or "", "fullpagename": name or ""}
                out.append(None if body is None else Expander(dict(known) if known is not None else {}, words).expand(body))
            yield part.drop(columns="_templates").assign(**{text: pd.Series(out, index=part.index, dtype=object)})

    return rows.select(*pages.columns, "_templates").mapInPandas(run, pages.schema)
