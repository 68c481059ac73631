"""Reference resolution for links, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

# Fixed value: the generic URI pattern published in RFC 3986, appendix B.
URI = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def _parts(c: Column) -> Column:
    return F.struct(
        F.lower(F.regexp_extract(c, URI, 2)).alias("scheme"),
        F.regexp_extract(c, URI, 3).alias("authority"),
        F.regexp_extract(c, URI, 5).alias("path"),
        F.regexp_replace(F.regexp_extract(c, URI, 6), r"^\?$", "").alias("query"),
        F.regexp_replace(F.regexp_extract(c, URI, 8), "^#$", "").alias("fragment"),
    )


def _remove_dots(segments: Column) -> Column:
    def step(acc: Column, s: Column) -> Column:
        return (
            F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    path = F.array_join(F.concat(kept, tail), "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def _merged_path(base: Column, ref: Column) -> Column:
    rooted = F.split(ref, "/")
    folder = F.slice(F.split(base, "/"), F.lit(1), F.size(F.split(base, "/")) - 1)
    folder = F.when(F.size(folder) == 0, F.array(F.lit(""))).otherwise(folder)
    # empty inner segments of the joined path would only double slashes
    inner = F.filter(
        F.concat(F.slice(folder, F.lit(2), F.size(folder)), F.slice(rooted, F.lit(1), F.size(rooted) - 1)),
        lambda s: s != "",
    )
    joined = F.concat(F.slice(folder, F.lit(1), F.lit(1)), inner, F.array(F.element_at(rooted, -1)))
    return let(F.when(ref.startswith("/"), rooted).otherwise(joined), _remove_dots)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on a page at ``base``; absolute links pass unchanged."""
    clean = F.translate(F.regexp_replace(href, r"^[\x00-\x20]+", ""), "\t\r\n", "")

    def build(link: Column, b: Column, r: Column) -> Column:
        root = F.concat(b["scheme"], F.lit(":"), b["authority"])
        query = F.when(r["query"] != "", r["query"]).otherwise(b["query"])
        other = (r["scheme"] != "") & ((r["scheme"] != b["scheme"]) | (r["authority"] != ""))
        return (
            F.when(link == "", base)
            .when(other, link)
            .when(r["authority"] != "", F.concat(b["scheme"], F.lit(":"), link))
            .when(r["path"] == "", F.concat(root, b["path"], query, r["fragment"]))
            .otherwise(F.concat(root, _merged_path(b["path"], r["path"]), r["query"], r["fragment"]))
        )

    return let(
        clean,
        lambda link: let(_parts(base), lambda b: let(_parts(link), lambda r: build(link, b, r))),
    )
