"""Selectors against a tree built by hand, and the cost of many elements."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions.columns import running_sum
from lectern.functions.html import VOID, scopes, with_scopes


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [[rng.randint(-3, 3) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 9, 10, 100, 997)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>").select("i", running_sum(F.col("v")).alias("s"))
    for r in got.collect():
        assert r.s == [sum(rows[r.i][: k + 1]) for k in range(len(rows[r.i]))]


def elements(html):
    """(tag, attributes, begin and end of the inner markup, begin of the element, whether it is closed) by a list of what is open per tag."""
    found, open_ = [], {}
    for m in re.finditer(r"<(/?)([a-z0-9]+)([^>]*?)(/?)>", html):
        tag = m[2]
        if m[1]:
            if open_.get(tag):
                e = open_[tag].pop()
                e["end"], e["closed"] = m.start(), True
        else:
            e = {"tag": tag, "attrs": m[3], "at": m.end(), "begin": m.start(), "end": len(html), "closed": False}
            found.append(e)
            if m[4] or tag in VOID:
                rest = re.search(r"<[/a-z]", html[m.end() :])
                e["end"], e["closed"] = m.end() + (rest.start() if rest else len(html) - m.end()), True
                e["void"] = True
            else:
                open_.setdefault(tag, []).append(e)
    return found


def select(html, selector):
    every = elements(html)
    around = lambda e: [x for x in every if x["closed"] and not x.get("void") and x["begin"] < e["begin"] < x["end"]]

    def fits(e, simple):
        tag, _, cls = simple.partition(".")
        return (not tag or e["tag"] == tag) and (not cls or re.search(rf'class="([^"]*\s)?{cls}(\s[^"]*)?"', e["attrs"]))

    steps = re.findall(r">|[^\s>]+", selector)
    found, child = [e for e in every if fits(e, steps[0])], False
    for s in steps[1:]:
        if s == ">":
            child = True
            continue
        wanted = [e for e in every if fits(e, s)]
        if child:
            found = [e for e in wanted if any(x["closed"] and x in around(e) and len(around(x)) + 1 == len(around(e)) for x in found)]
        else:
            found = [e for e in wanted if any(x["begin"] < e["begin"] < x["end"] and not x.get("void") for x in found)]
        child = False
    return [html[e["at"] : e["end"]] for e in found]


def page(rng, depth=0, opened=False):
    made = []
    for _ in range(rng.randint(0, 4 if depth < 5 else 0)):
        tag = rng.choice(["a", "b", "c", "div", "br", "img"])
        attrs = rng.choice(["", ' class="x"', ' class="y x"', ' id="q"'])
        if tag in VOID or rng.random() < 0.1:
            made.append(f"<{tag}{attrs}/>" if tag not in VOID else f"<{tag}{attrs}>")
        else:
            made.append(f"<{tag}{attrs}>{page(rng, depth + 1)}</{tag}>")
        made.append(rng.choice(["", "text", " &amp; "]))
    return "".join(made)


@pytest.mark.parametrize("selector", ["a b", "a > b", "a a", "div > .x", "a b > c", "div a > b c", ".x .x", "a > br", "b   >a", "c.x > a.x"])
def test_joined_selectors(spark, selector):
    rng = random.Random(selector)
    pages = [page(rng) for _ in range(150)] + ["", "no tags", "<a>", "</a><b>", "<a><b>x</a>", "<a><p><b>x</b><p></a><b>y</b>"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    for r in with_scopes(df, selector, "s", "h").collect():
        assert r.s == select(pages[r.i], selector), pages[r.i]


@pytest.mark.parametrize("selector", ["a", "div.x", "b"])
def test_simple_selectors_and_elements_that_are_not_closed(spark, selector):
    rng = random.Random(selector)
    pages = [re.sub("</(a|div)>", lambda m: m[0] if rng.random() < 0.8 else "", page(rng)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    for r in df.select("i", scopes(F.col("h"), selector).alias("s")).collect():
        tag = selector.split(".")[0]
        got = [re.sub(rf"</?(?!{tag}\b)[^>]*>", "", x) for x in r.s]
        assert got == [re.sub(rf"</?(?!{tag}\b)[^>]*>", "", x) for x in by_depth(pages[r.i], selector)]


def by_depth(html, selector):
    """For each match, a walk from it to where its tag is closed as often as opened."""
    tag, _, cls = selector.partition(".")
    marks = list(re.finditer(rf"<(/?){tag}(?=[\s>/])([^>]*?)(/?)>", html))
    out = []
    for k, m in enumerate(marks):
        if m[1] or (cls and not re.search(rf'class="([^"]*\s)?{cls}(\s[^"]*)?"', m[2])):
            continue
        if m[3]:
            out.append(html[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(html)])
            continue
        depth, end = 1, len(html)
        for x in marks[k + 1 :]:
            depth += -1 if x[1] else 0 if x[3] else 1
            if depth == 0:
                end = x.start()
                break
        out.append(html[m.end() : end])
    return out


def test_time_grows_with_the_page_and_not_with_its_square(spark):
    def seconds(n):
        html = "<section>" + "".join(f"<div class='x'><p>{i}</p></div>" for i in range(n)) + "</section>"
        df = spark.createDataFrame([(html,)], "h string")
        start = time.perf_counter()
        made = with_scopes(df.withColumn("s", scopes(F.col("h"), "div.x")), "section > div", "c", "h")
        assert made.select(F.size("s"), F.size("c")).first() == (n, n)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(8000) < 16 * max(0.5, seconds(1000))
