"""Reading elements out of stored HTML with column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblode.functions.text import let, nonempty, strip


@dataclass(frozen=True)
class Css:
    """An element chosen by tag and, if given, class or attribute."""

    tag: str
    cls: str | None = None
    attr: str | None = None

    def opening(self) -> str:
        """Pattern of the opening tag."""
        if self.cls:
            need = r"(?<![\w-])class\s*=\s*[\"'][^\"'>]*(?<![\w-])" + self.cls + r"(?![\w-])"
        elif self.attr:
            need = rf"(?<![\w-]){self.attr}\s*="
        else:
            return rf"<{self.tag}\b[^>]*>"
        return rf"<{self.tag}\b[^>]*{need}[^>]*>"


def opening_tag(html: Column, *choices: Css) -> Column:
    """The first opening tag that fits one of ``choices``; NULL if none does."""
    pattern = "|".join(c.opening() for c in choices)
    return nonempty(F.regexp_extract(html, f"(?i)({pattern})", 1))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in an opening tag; NULL if absent."""
    value = F.regexp_extract(tag, rf"(?i)(?<![\w-]){name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.when(value != "", unescape(F.substring(value, F.lit(2), F.length(value) - 2)))


def inner(html: Column, css: Css) -> Column:
    """What lies inside the first element that fits; NULL if there is none.

    Elements of the same tag may nest: the text after the opening tag is cut at
    every ``<`` and the depth followed over the pieces to the closing tag.
    """
    rest = F.get(F.split(html, f"(?i){css.opening()}", 2), 1)
    return let(rest, lambda text: _to_closing(text, lambda piece: piece.rlike(rf"(?i)^{css.tag}\b"),
                                              lambda piece: piece.rlike(rf"(?i)^/{css.tag}\b")))


def _to_closing(text: Column, opens: Callable[[Column], Column], closes: Callable[[Column], Column]) -> Column:
    """What stands before the closing tag of an element whose opening tag lies before ``text``.

    ``opens`` and ``closes`` tell from what follows a ``<`` whether it is a tag of the element's
    name. An element that is not closed ends with the text.
    """
    def walk(acc: Column, piece: Column) -> Column:
        # The first piece (nothing counted yet) is text before any tag.
        step = (F.when(acc["chars"] < 0, F.lit(0)).when(closes(piece), F.lit(-1))
                .when(opens(piece), F.lit(1)).otherwise(F.lit(0)))
        depth = acc["depth"] + step
        more = F.when(depth > 0, F.length(piece) + 1).otherwise(F.lit(0))
        return F.when(acc["depth"] > 0, F.struct(depth.alias("depth"),
                                                 (acc["chars"] + more).alias("chars"))
                      ).otherwise(acc)

    start = F.struct(F.lit(1).alias("depth"), F.lit(-1).alias("chars"))
    chars = F.aggregate(F.split(text, "<"), start, walk, lambda acc: acc["chars"])
    return F.substring(text, F.lit(1), chars)


def short_inner(html: Column, *choices: Css) -> Column:
    """Like :func:`inner` where any tag may be chosen, for elements that are mostly short.

    The next closing tag of the element's name ends it. Only if another tag of that name
    opens before, the depth is followed. An element that is never closed is empty.
    """
    pattern = "|".join(c.opening() for c in choices)
    tag = opening_tag(html, *choices)
    body = F.regexp_extract(html, rf"(?is)(?={pattern})<([a-z][\w-]*)[^>]*>(.*?)</\1\s*>", 2)
    name = F.lower(F.regexp_extract(tag, r"^<([A-Za-z][\w-]*)", 1))

    def named(piece: Column, slash: str, name: Column) -> Column:
        return F.lower(F.regexp_extract(piece, rf"^{slash}([A-Za-z][\w-]*)", 1)) == name

    def whole(found: Column) -> Column:
        rest = F.struct(F.get(F.split(html, f"(?i){pattern}", 2), 1).alias("text"), found["name"].alias("name"))
        walked = let(rest, lambda r: _to_closing(r["text"], lambda piece: named(piece, "", r["name"]),
                                                 lambda piece: named(piece, "/", r["name"])))
        nests = F.contains(F.lower(found["body"]), F.concat(F.lit("<"), found["name"]))
        return F.when(nests, walked).otherwise(found["body"])

    return F.when(tag.isNotNull(), let(F.struct(body.alias("body"), name.alias("name")), whole))


# Names of characters in HTML, from the standard library; the apostrophe came later than the list.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def _character(code: Column) -> Column:
    """The character of a code point; the replacement character for a number that has none."""
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    four = F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0"))
    return F.when(code == 160, F.lit(" ")).otherwise(F.decode(four, "UTF-32"))


def unescape(text: Column) -> Column:
    """Named and numeric character references as the characters they stand for; others stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in sorted(ENTITIES.items()) for x in pair])

    def piece(part: Column, n: Column) -> Column:
        """What follows an ampersand, its reference resolved."""
        name = F.regexp_extract(part, r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        hexed = F.conv(F.substring(name, 3, 8), 16, 10).try_cast("long")
        number = F.when(name.rlike("^#[xX]"), hexed).otherwise(F.substring(name, 2, 9).try_cast("long"))
        found = F.when(name.startswith("#"), _character(number)).otherwise(F.try_element_at(names, name))
        known = (n > 0) & (name != "") & found.isNotNull()
        return F.when(known, F.concat(found, F.substring(part, F.length(name) + 2, F.length(part)))).otherwise(
            F.when(n > 0, F.concat(F.lit("&"), part)).otherwise(part))

    # Bound once: what is handed in may be a chain of patterns.
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&"), piece), "")).otherwise(t))


# Stands for a line break while white space is closed up.
_BREAK = "\x01"


def visible_text(html: Column) -> Column:
    """Text as a reader sees it: no scripts, styles or tags, one line per block, stripped."""
    text = F.regexp_replace(html, r"(?is)<(?:(script|style)\b.*?</\1\s*>|!--.*?-->)", "")
    text = F.regexp_replace(
        text, r"(?i)<(?:br|/?(?:p|div|li|ul|ol|h[1-6]|section|tr|table))\b[^>]*>", _BREAK)
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\s+", " ")
    text = F.regexp_replace(text, f" ?{_BREAK}[ {_BREAK}]*", "\n")
    return strip(unescape(text))
