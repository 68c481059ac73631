"""Markup expressions: element scopes, text and entities, all inside the JVM."""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, running_sum
from .text import collapse_newlines, strip_ws

UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_REST_OF_TAG = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""
ANY_TAG = r"<[/!?a-zA-Z]" + _REST_OF_TAG
HREF = r"""(?is)<a\s(?:[^>"']*(?:"[^"]*"|'[^']*'))*?[^>"']*?(?<![\w-])href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_UNDEFINED_1252 = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
_COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


def _selector(text: str) -> tuple[str | None, str | None, str | None]:
    """``tag``, ``tag#id``, ``tag.class``, ``#id`` or ``.class``."""
    found = re.fullmatch(r"([A-Za-z][\w-]*)?(?:#([\w-]+)|\.([\w-]+))?", text)
    if not text or not found:
        raise ValueError(f"unsupported selector {text!r}")
    return found.groups()


def _attribute_test(ident: str | None, cls: str | None) -> str | None:
    if ident:
        v = re.escape(ident)
        return rf"""(?is)[\s"']id\s*=\s*(?:"{v}"|'{v}'|{v}(?=[\s>/]))"""
    if cls:
        v = re.escape(cls)
        return (
            rf"""(?is)[\s"']class\s*=\s*(?:"(?:[^"]*\s)?{v}(?:\s[^"]*)?"|'(?:[^']*\s)?{v}(?:\s[^']*)?'|{v}(?=[\s>/]))"""
        )
    return None


#: Stands where a comment, script or style was; no text holds this control character.
HIDDEN = "\x1a"


def drop_unseen(html: Column) -> Column:
    """Comments, scripts and styles show no text; a mark stays, as they separate text nodes."""
    return F.regexp_replace(html, UNSEEN, HIDDEN)


#: Elements without content, fixed values.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_HEAD = "(?s)^<" + _REST_OF_TAG


def _closed_at(events: Column, *same: str) -> Column:
    """``array<struct<at, end>>`` of the opening events; ``end`` is NULL where an element is not closed.

    ``events`` are sorted by the columns ``same``, among them the nesting level,
    and then by place. From an opening at some level on, the next event at that
    level is the closing that ends it; so both are neighbours.
    """

    def one(e: Column, k: Column) -> Column:
        following = F.get(events, k + 1)
        ends = following["d"] == -1
        for c in same:
            ends = ends & (following[c] == e[c])
        return F.when(e["d"] == 1, F.struct(e["at"].alias("at"), F.when(ends, following["at"]).alias("end"), e["hit"].alias("hit")))

    return F.array_compact(F.transform(events, one))


def _level(d: Column, total: Column) -> Column:
    return F.when(d == 1, total).otherwise(total + 1)


def _intervals(pieces: Column, tag: Column, test: str | None) -> Column:
    """``array<struct<at, end>>`` of the matching elements: their pieces, from ``at`` up to but without ``end``.

    ``pieces`` is the page cut in front of each opening or closing ``tag``, so
    nesting is a running sum of +1 and -1 over the pieces, and one sort finds
    the ends of all elements.
    """
    opening = F.concat(F.lit("(?is)^<"), tag, F.lit(r"[\s>/]"))
    closing = F.concat(F.lit("(?is)^</"), tag, F.lit(r"[\s>/]"))

    def step(p: Column) -> Column:
        head = F.regexp_extract(p, _HEAD, 0)
        opens = F.regexp_like(p, opening)
        wanted = opens if test is None else opens & head.rlike(test)
        d = F.when(F.regexp_like(p, closing), -1).when(opens & ~head.endswith("/>"), 1).otherwise(0)
        return F.struct(d.alias("d"), F.coalesce(wanted, F.lit(False)).alias("hit"))

    def found(steps: Column, totals: Column) -> Column:
        def event(s: Column, i: Column) -> Column:
            placed = F.struct(_level(s["d"], F.get(totals, i)).alias("level"), (i + 1).alias("at"), s["d"].alias("d"), s["hit"].alias("hit"))
            return F.when(s["d"] != 0, placed)

        alone = F.transform(
            steps, lambda s, i: F.when((s["d"] == 0) & s["hit"], F.struct((i + 1).alias("at"), (i + 2).alias("end"), s["hit"].alias("hit")))
        )
        whole = let(F.array_sort(F.array_compact(F.transform(steps, event))), lambda events: _closed_at(events, "level"))
        return F.filter(F.array_sort(F.concat(whole, F.array_compact(alone))), lambda e: e["hit"])

    return let(F.transform(pieces, step), lambda steps: let(running_sum(F.transform(steps, lambda s: s["d"])), lambda t: found(steps, t)))


def _inner(pieces: Column, interval: Column) -> Column:
    """Markup of an element without its own tags; one that is not closed reaches to the end of the page."""
    n = F.coalesce(interval["end"], F.size(pieces) + 1) - interval["at"]
    return F.regexp_replace(F.array_join(F.slice(pieces, interval["at"], n), ""), _HEAD, "")


def _located(html: Column, selector: str, then) -> Column:
    """``then(pieces, intervals)`` of the elements that match a selector, NULL where its class or id is on no element."""
    tag, ident, cls = _selector(selector)
    test = _attribute_test(ident, cls)

    def cut(page: Column, name: Column) -> Column:
        pattern = F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s>/])"))
        return let(F.split(page, pattern), lambda pieces: let(_intervals(pieces, name, test), lambda found: then(pieces, found)))

    if tag:
        return let(drop_unseen(html), lambda page: cut(page, F.lit(tag)))
    first = rf"(?is)<([a-z][a-z0-9-]*)(?=[\s])(?=[^>]*?{test.removeprefix('(?is)')})"
    return let(drop_unseen(html), lambda page: let(F.regexp_extract(page, first, 1), lambda name: F.when(name != "", cut(page, name))))


_ELEMENT = "struct<depth:int,at:int,end:int>"


def _swept(df: DataFrame, outer: Column, queries: Column, then, name: str) -> DataFrame:
    """``df`` with ``name``: ``then(query, n)`` of each of ``queries`` (key, element), ``n`` being the intervals (key, at, end) of its key around it.

    One sort and one running sum: an interval counts from behind its beginning
    to its end. Every interval has an end, so the sum is zero between keys.
    """

    def mark(e: Column, place: Column, order: int, d: int) -> Column:
        element = e["element"] if d == 0 else F.lit(None).cast(_ELEMENT)
        return F.struct(e["key"].alias("key"), place.alias("place"), F.lit(order).alias("order"), F.lit(d).alias("d"), element.alias("element"))

    marks = F.concat(
        F.transform(outer, lambda e: mark(e, e["at"], 2, 1)),
        F.transform(outer, lambda e: mark(e, e["end"], 0, -1)),
        F.transform(queries, lambda e: mark(e, e["element"]["at"], 1, 0)),
    )
    held = df.withColumn("marks", F.array_sort(marks)).withColumn("totals", running_sum(F.transform("marks", lambda m: m["d"])))
    # a column that is read inside a lambda is bound first, as the optimizer may put its expression there
    read = let(F.col("totals"), lambda t: F.transform("marks", lambda m, i: F.when(m["d"] == 0, then(m["element"], F.get(t, i)))))
    return held.withColumn(name, F.array_compact(read)).drop("marks", "totals")


def _element(e: Column, depth: Column) -> Column:
    return F.struct(depth.alias("depth"), e["at"].alias("at"), e["end"].alias("end"))


def _with_elements(df: DataFrame) -> DataFrame:
    """``df`` with ``elements`` (depth, at, end) of ``pieces``, the page cut in front of every tag.

    ``depth`` is the number of closed elements around. An element that is not
    closed has no ``end``.
    """
    def step(p: Column, i: Column) -> Column:
        opens = p.startswith("<") & ~p.startswith("</")
        empty = F.regexp_extract(p, _HEAD, 0).endswith("/>") | _name(p).isin(*VOID)
        d = F.when(p.startswith("</"), -1).when(opens & ~empty, 1).otherwise(0)
        return F.struct(_name(p).alias("name"), (i + 1).alias("at"), d.alias("d"), opens.alias("hit"))

    def placed(totals: Column) -> Column:
        return F.transform(
            "paired",
            lambda t, i: F.struct(
                t["name"].alias("name"), _level(t["d"], F.get(totals, i)).alias("level"), t["at"].alias("at"), t["d"].alias("d"), t["hit"].alias("hit")
            ),
        )

    held = df.withColumn("tags", F.transform("pieces", step)).withColumn("paired", F.array_sort(F.filter("tags", lambda t: t["d"] != 0)))
    held = held.withColumn("totals", running_sum(F.transform("paired", lambda t: t["d"])))
    held = held.withColumn("paired", F.array_sort(let(F.col("totals"), placed))).drop("totals")
    alone = F.transform(
        F.filter("tags", lambda t: (t["d"] == 0) & t["hit"]), lambda t: F.struct(t["at"].alias("at"), (t["at"] + 1).alias("end"), t["hit"].alias("hit"))
    )
    held = held.withColumn("whole", F.concat(let(F.col("paired"), lambda e: _closed_at(e, "name", "level")), alone)).drop("tags", "paired")
    closed = F.filter("whole", lambda e: e["end"].isNotNull())
    outer = F.transform(closed, lambda e: F.struct(F.lit(0).alias("key"), e["at"].alias("at"), e["end"].alias("end")))
    queries = F.transform("whole", lambda e: F.struct(F.lit(0).alias("key"), _element(e, F.lit(0)).alias("element")))
    return _swept(held, outer, queries, _element, "elements").drop("whole")


def _name(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, "^</?([a-zA-Z][a-zA-Z0-9-]*)", 1))


def _matching(selector: str) -> Column:
    """Those of ``elements`` that a simple selector fits."""
    tag, ident, cls = _selector(selector)
    test = _attribute_test(ident, cls)

    def fits(piece: Column) -> Column:
        same = F.lit(True) if tag is None else _name(piece) == tag.lower()
        return same if test is None else same & F.regexp_extract(piece, _HEAD, 0).rlike(test)

    return let(F.col("pieces"), lambda pieces: F.filter("elements", lambda e: fits(F.get(pieces, e["at"] - 1))))


def _inside(df: DataFrame, selector: str, child: bool) -> DataFrame:
    """``df`` with ``found``: what the selector fits inside the elements that were ``found``, or directly inside."""
    if child:
        # of an element's depth there is one element around it, its parent; one that is not closed is none
        closed = F.filter("found", lambda e: e["end"].isNotNull())
        outer = F.transform(closed, lambda e: F.struct((e["depth"] + 1).alias("key"), e["at"].alias("at"), e["end"].alias("end")))
        queries = F.transform(_matching(selector), lambda e: F.struct(e["depth"].alias("key"), e.alias("element")))
    else:
        outer = let(
            F.size("pieces") + 1,
            lambda end: F.transform("found", lambda e: F.struct(F.lit(0).alias("key"), e["at"].alias("at"), F.coalesce(e["end"], end).alias("end"))),
        )
        queries = F.transform(_matching(selector), lambda e: F.struct(F.lit(0).alias("key"), e.alias("element")))
    return _swept(df, outer, queries, lambda e, n: F.when(n > 0, e), "found")


def with_scopes(df: DataFrame, selector: str, name: str, html: str = "html") -> DataFrame:
    """``df`` with ``name``: the inner markup of every matching element of ``html``, in document order.

    Beside the selectors of ``scopes``, simple ones may be joined: ``a b`` are the
    ``b`` inside an ``a``, ``a > b`` those directly inside one; there a class or
    id without a tag fits any tag. All elements of a page get their place by
    sorts and running sums, so time does not grow with the matches times the
    page. An element that is not closed reaches to the end of the page.
    """
    steps = re.findall(r"\s*>\s*|\s+|[^\s>]+", selector.strip())
    if len(steps) < 2:
        return df.withColumn(name, scopes(F.col(html), selector))
    pieces = F.split(drop_unseen(F.col(f"`{html}`")), "(?=</?[a-zA-Z])")
    held = _with_elements(df.select(F.struct("*").alias("row"), pieces.alias("pieces"))).withColumn("found", _matching(steps[0]))
    for combinator, simple in zip(steps[1::2], steps[2::2], strict=True):
        held = _inside(held, simple, bool(combinator.strip()))
    ordered = F.array_sort(F.transform("found", lambda e: F.struct(e["at"].alias("at"), e["end"].alias("end"))))
    return held.select("row.*", let(F.col("pieces"), lambda pieces: F.transform(ordered, lambda e: _inner(pieces, e))).alias(name))


def scopes(html: Column, selector: str) -> Column:
    """Inner markup of every element that matches, in document order.

    Nested matches are all returned. A class or id without a tag takes the tag
    of its first match. ``with_scopes`` also takes joined selectors.
    """
    every = _located(html, selector, lambda pieces, found: F.transform(found, lambda e: _inner(pieces, e)))
    return F.when(html.isNotNull(), F.coalesce(every, F.array().cast("array<string>")))


def first_scope(html: Column, selector: str) -> Column:
    """Inner markup of the first match, NULL if there is none; only that one is put together."""
    return _located(html, selector, lambda pieces, found: let(F.get(found, F.lit(0)), lambda e: F.when(e.isNotNull(), _inner(pieces, e))))


def _table(entries: dict[str, str]) -> Column:
    """A constant map written as one string literal, folded once by the optimizer."""
    text = "\x02".join(f"{k}\x01{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numeric(name: Column) -> Column:
    """``#65`` or ``#x41``; zero, surrogates and numbers out of range give U+FFFD."""
    is_hex = name.rlike("^#[xX][0-9a-fA-F]{1,8}$")
    digits = F.regexp_replace(name, "^#[xX]?", "")
    value = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint")
    # numbers 128..159 are read as Windows-1252, as browsers do
    western = _table({str(n): bytes([n]).decode("cp1252") for n in range(128, 160) if n not in _UNDEFINED_1252})

    def char(v: Column) -> Column:
        valid = ((v > 0) & (v < 0xD800)) | ((v > 0xDFFF) & (v <= 0x10FFFF))
        return (
            F.when(v.between(128, 159), F.coalesce(F.try_element_at(western, v.cast("string")), _code_point(v)))
            .when(valid, _code_point(v))
            .otherwise("\ufffd")
        )

    well_formed = name.rlike("^#(?:[0-9]{1,9}|[xX][0-9a-fA-F]{1,8})$")
    return F.when(well_formed, let(value, char))


def unescape(c: Column) -> Column:
    """Character references to characters in one pass, so ``&amp;lt;`` gives ``&lt;``."""
    named = _table({k[:-1]: v for k, v in html5.items() if k.endswith(";")})
    # older names are also known without the semicolon
    bare = _table({k: v for k, v in html5.items() if not k.endswith(";")})

    def decode(piece: Column) -> Column:
        at = F.instr(piece, ";")
        name = F.substring_index(piece, ";", 1)
        found = F.when(name == "amp", "&")
        for entity, char in _COMMON.items():
            found = found.when(name == entity, char)
        found = found.when(name.startswith("#"), _numeric(name)).otherwise(F.try_element_at(named, name))
        word = F.regexp_extract(piece, "^[a-zA-Z][a-zA-Z0-9]*", 0)
        return let(
            F.when((at > 1) & (at <= 33), found),
            lambda v: F.when(v.isNotNull(), F.concat(v, F.substr(piece, at + 1))).otherwise(
                let(
                    F.when(word != "", F.try_element_at(bare, word)),
                    lambda b: F.when(b.isNull(), F.concat(F.lit("&"), piece)).otherwise(
                        F.concat(b, F.substr(piece, F.length(word) + 1))
                    ),
                )
            ),
        )

    def join(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decode)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))

    return let(c, lambda t: F.when(F.instr(t, "&") == 0, t).otherwise(let(F.split(t, "&"), join)))


def block_text(inner: Column) -> Column:
    """Text of an element with one line per text node: tags to newlines, collapse, strip."""
    return strip_ws(collapse_newlines(unescape(F.regexp_replace(inner, f"{HIDDEN}|{ANY_TAG}", "\n"))))


def inline_text(inner: Column) -> Column:
    """Text of an element with its text nodes joined as they are."""
    return unescape(F.regexp_replace(inner, f"{HIDDEN}|{ANY_TAG}", ""))


def hrefs(inner: Column) -> Column:
    """``href`` values of the links in document order, duplicates kept."""
    found = F.regexp_extract_all(inner, F.lit(HREF), F.lit(1))
    return F.transform(found, lambda h: unescape(F.regexp_replace(h, "^[\"']|[\"']$", "")))
