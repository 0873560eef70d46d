"""HTML expressions on regular expressions.

They know the few elements the operators need and are not a general parser. Comments, scripts and
styles are removed first, in one pass from left to right, because markup quoted inside them must not count and each may
hold the marks of the others. Attributes are walked in order with their values. Patterns use
possessive quantifiers, so pages with unclosed scripts, comments or tags cost linear time.
"""

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.functions.arrays import bind

# Named character references that are decoded: those of HTML 4, and the few that may be written in capitals.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
ENTITIES |= {name.upper(): ENTITIES[name] for name in ("amp", "lt", "gt", "quot", "copy", "reg")}

# Elements that start a new line when a page is shown.
BLOCK_TAGS = (
    "address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul"
).split()

# A tag that is never closed ends where the next one begins.
_ATTRIBUTES = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""


# What stands between the name of a tag and an attribute: other attributes with their whole values.
# Possessive throughout, so a tag is walked once and a name inside a value is no attribute.
_BEFORE = r"""(?:[\s/]++|(?!(?<=[\s/"']){0}\s*=)[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+|["'=])*+(?<=[\s/"']){0}\s*=\s*"""


def strip_hidden(html: Column) -> Column:
    """Remove comments, scripts and styles, whichever begins first; one that never ends reaches to the end."""
    hidden = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+(?:>|\z).*?(?:</\1\s*>|\z)"
    return F.regexp_replace(html, hidden, "")


# One literal, so that the plan stays small however often text is decoded.
_ENTITY_LIST = "\n".join(f"{name}\t{char}" for name, char in ENTITIES.items())
_REFERENCE = "^&([A-Za-z][A-Za-z0-9]{1,7}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"


def _character(name: Column) -> Column:
    """The character of a reference such as ``amp``, ``#38`` or ``#x26``; null when there is none."""
    decimal = F.when(F.substring(name, 2, 1).isin("x", "X"), F.conv(F.substring(name, 3, 6), 16, 10))
    decimal = decimal.otherwise(F.substring(name, 2, 7)).cast("int")
    valid = decimal.between(1, 0xD7FF) | decimal.between(0xE000, 0x10FFFF)
    number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(decimal), 8, "0")), "UTF-32"))
    named = F.str_to_map(F.lit(_ENTITY_LIST), F.lit("\n"), F.lit("\t"))
    return F.when(name.startswith("#"), number).otherwise(F.try_element_at(named, name))


def _decode_first(piece: Column) -> Column:
    """Decode the reference that ``piece`` starts with; unknown ones stay."""

    def write(name: Column) -> Column:
        rest = F.substr(piece, F.length(name) + 3)
        return F.coalesce(F.concat(_character(name), rest), piece)

    return bind(F.regexp_extract(piece, _REFERENCE, 1), write)


def decode_entities(text: Column) -> Column:
    """Decode character references, each once; text without an ampersand is left alone."""
    pieces = F.transform(F.split(text, "(?=&)"), _decode_first)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def open_tag(*names: str) -> str:
    """Pattern of an opening tag of one of ``names``."""
    return rf"(?i)<(?:{'|'.join(names)})(?=[\s/>]){_ATTRIBUTES}>"


def open_tag_with(attribute: str, value: str, names: str = "[a-z][a-z0-9]*", word: bool = False) -> str:
    """Pattern of an opening tag whose attribute equals ``value`` (or has it as one ``word``)."""
    inner = rf"(?:[^\"']*\s)?{value}(?:\s[^\"']*)?" if word else value
    return rf"(?i)<(?:{names})(?=[\s/]){_BEFORE.format(attribute)}[\"']?{inner}[\"']?(?=[\s/>])[^>]*+>"


def elements(html: Column, *names: str) -> Column:
    """Opening tags of the named elements, in document order."""
    return F.regexp_extract_all(html, F.lit(open_tag(*names)), F.lit(0))


def tag_name(element: Column) -> Column:
    return F.lower(F.regexp_extract(element, r"^<([A-Za-z0-9]+)", 1))


def attribute(element: Column, name: str) -> Column:
    """Attribute value of one opening tag, as written; null when it is missing or empty."""
    pattern = rf"""(?i)^<[a-z0-9]++{_BEFORE.format(name)}("[^"]*"|'[^']*'|[^\s"'>]+)"""
    value = F.regexp_replace(F.regexp_extract(element, pattern, 1), "^[\"']|[\"']$", "")
    return bind(value, lambda v: F.when(v != "", v))


def inner_html(html: Column, opening: str) -> Column:
    """What lies between the first tag matching ``opening`` and the tag that closes it.

    The text after the opening tag is cut at every tag of the same name, and the running depth
    tells which of them closes the element. An element that is never closed reaches to the end;
    null when there is no such element.
    """

    def cut(source: Column, first: Column) -> Column:
        name = tag_name(first)
        after = F.substr(source, F.position(first, source) + F.length(first))
        edge = F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"(?=[\s/>]))"))
        return bind(F.split(after, edge), lambda pieces: _until_closed(pieces, name))

    return bind(html, lambda h: bind(F.regexp_substr(h, F.lit(opening)), lambda first: cut(h, first)))


def _until_closed(pieces: Column, name: Column) -> Column:
    def step(acc, piece):
        closes = piece.startswith("</")
        opens = F.startswith(F.lower(F.left(piece, F.lit(24))), F.concat(F.lit("<"), name))
        change = F.when(closes, -1).when(opens, 1).otherwise(0)
        depth = acc["depth"] + change
        return F.when(acc["depth"] == 0, acc).otherwise(
            F.struct(
                depth.alias("depth"),
                (acc["kept"] + F.when(depth == 0, 0).otherwise(1)).alias("kept"),
            )
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept"))
    kept = F.aggregate(pieces, start, step)["kept"]
    return F.array_join(F.slice(pieces, F.lit(1), kept), "")


def text_of(html: Column) -> Column:
    """Visible text on one line: block tags separate words, other tags vanish."""
    blocks = "|".join(BLOCK_TAGS)

    def without_tags(tagged: Column, rest: Column) -> Column:
        spaced = F.regexp_replace(tagged, rf"(?i)</?(?:{blocks})(?=[\s/>])[^>]*>", " ")
        return F.concat(F.regexp_replace(spaced, r"<[^>]*>", ""), rest)

    # After the last closing bracket there are no tags, so none is looked for to the end.
    tail = F.substring_index(html, ">", -1)
    plain = bind(tail, lambda rest: without_tags(F.left(html, F.length(html) - F.length(rest)), rest))
    return F.trim(F.regexp_replace(bind(plain, decode_entities), r"\s+", " "))
