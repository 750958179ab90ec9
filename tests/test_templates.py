import datetime

import pytest

from schemaloom.functions import templates as t

TEMPLATES = {
    "Hello": "Hi {{{1|you}}}{{{mark|!}}}<noinclude>docs</noinclude>", "Twice": "{{hello|{{{1}}}}} {{Hello|{{{1}}}|mark={{{2|?}}}}}",
    "Loop": "x{{loop}}", "Only": "a<onlyinclude>b</onlyinclude>c", "Sum": "{{#expr:{{{1}}}+{{{2}}}}}", "Link": "[[{{{1}}}|{{{2|label}}}]]",
}


@pytest.mark.parametrize("text, want", [
    ("{{hello}}", "Hi you!"), ("a {{Hello| Bo }} b", "a Hi Bo! b"), ("{{hello|1=Al|mark=.}}", "Hi Al."), ("{{twice|Bo|;}}", "Hi Bo! Hi Bo;"),
    ("{{missing|x}}", ""), ("{{Template:hello|[[a|b]]}}", "Hi [[a|b]]!"), ("{{only}}", "b"), ("{{subst:hello}}", "Hi you!"), ("{{!}}", "|"),
    ("{{#if: x | yes | no }}", "yes"), ("{{#if:|yes|no}}", "no"), ("{{#ifeq:1.0|1|same|other}}", "same"), ("{{#ifeq:a|b|same}}", ""),
    ("{{#switch: b | a = 1 | b | c = 2 | 3 }}", "2"), ("{{#switch: z | a = 1 | #default = 9 }}", "9"), ("{{#switch: z | a = 1 | rest }}", "rest"),
    ("{{#expr: 2 + 3 * (4 - 1) ^ 2 }}", "29"), ("{{#expr: 7 mod 4 }}", "3"), ("{{#expr: 1 / 4 }}", "0.25"), ("{{#expr: not 0 and 1 }}", "1"), ("{{sum|2|40}}", "42"),
    ("{{#iferror:{{#expr:1/0}}|bad|good}}", "bad"), ("{{#iferror:{{#expr:1/1}}|bad}}", "1"), ("{{uc:aB}}{{lcfirst:AB}}{{urlencode:a b&}}", "ABaBa+b%26"), ("{{#time:Y}}", ""),
    ("{{hello", "{{hello"), ("x }} {{hello}} {", "x }} Hi you! {"), ("{{{free}}}", "{{{free}}}"), ("{{{free|d}}}", "d"), ("{{link|p}}", "[[p|label]]"), ("{{{{{1|hello}}}}}", "Hi you!"),
])
def test_expansion(text, want):
    assert t.Expander(TEMPLATES).expand(text) == want


def test_a_template_that_calls_itself_ends():
    assert t.Expander(TEMPLATES).expand("{{loop}}") == "x" * t.MOST_CALLS


def test_modules_and_clock():
    made = t.Expander({}, t.clock_words(datetime.datetime(2024, 3, 9, 5)), {("m", "f"): lambda a, b: f"{b}{a}"})
    assert made.expand("{{#invoke:m|f|x|y}} {{CURRENTYEAR}}-{{currentmonth}}") == "yx 2024-03"


def test_titles_and_spans():
    spaces = frozenset({"Category"})
    assert [t.title_of(x, spaces) for x in (" some_page ", "category:  births", "3001: the_Final", "a:b", "")] == ["Some page", "Category:Births", "3001: The Final", "A:B", ""]
    assert t.template_title(":page x") == "Page x" and t.template_title("template: foo_bar") == "Foo bar" and t.template_title(" ") == ""
    assert t.matching_braces("a {{b {{c}} d}} {{e}}") == [(2, 15), (16, 21)] and t.balanced("[[a [[b]]]] [[c") == [(0, 11)]


def test_pages_get_the_templates_they_reach(spark):
    rows = [("Hello", TEMPLATES["Hello"], None), ("Twice", TEMPLATES["Twice"], None), ("Hey", "#REDIRECT [[Template:Hello]]", "Template:Hello"), ("Loop", TEMPLATES["Loop"], None), ("Unused", "u", None)]
    pages = spark.createDataFrame([(1, "P", "{{twice|Bo}} {{hey|Al}} {{PAGENAME}}"), (2, "Q", None), (3, "R", "plain"), (4, "S", "{{loop}}")], "id int, title string, text string")
    source = spark.createDataFrame(rows, "name string, body string, target string")
    assert {r["id"]: r["text"] for r in t.expanded(pages, "id", "title", "text", source).collect()} == {1: "Hi Bo! Hi Bo? Hi Al! P", 2: None, 3: "plain", 4: "x" * t.MOST_CALLS}
    used = {r["id"]: set(r["templates"]) for r in t.with_templates(pages, "id", "text", t.resolved(source)).collect()}
    assert used == {1: {"Twice", "Hello", "Hey"}, 4: {"Loop"}}
