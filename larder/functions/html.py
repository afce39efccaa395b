"""Text of a page, read by one scan over its markup.

The scan cuts a page into comments, raw elements (head, script, style), tags, declarations, character
references and text. Markup becomes a space, references become their character, text stays; so a
label and its value in neighbouring elements stay neighbours. What a page leaves open is defined:

- a comment, script or style without an end runs to the end of the page; a head without one ends
  where the body begins;
- ``>`` inside a quoted attribute doesn't end its tag; where quotes don't pair up, the first ``>`` does;
- a tag that the page ends in is dropped; ``<`` before anything but a name is text;
- a reference needs its semicolon; unknown names stay as they are; a number that is no character
  becomes U+FFFD. Decoded text is not scanned again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import collapse_ws, let, lookup

SCAN = (
    r"(?is)<!--(?:.*?-->|.*$)"
    r"|<(script|style)(?=[\s>/]).*?(?:</\1\s*>|$)"
    r"|<head(?=[\s>/]).*?(?:</head\s*>|(?=<body[\s>])|$)"
    r"|</?[a-z](?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-z][^<>]*+(?:>|(?=<)|$)"
    r"|<[!?][^>]*+(?:>|$)"
    r"|&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]*);"
    r"|[^<&]++|[<&]"
)
# Named character references that shop pages use.
NAMED = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "amp": "&", "apos": "'", "copy": "©", "reg": "®", "trade": "™", "deg": "°",
    "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "frac12": "½", "frac14": "¼", "frac34": "¾", "times": "×", "micro": "µ", "eacute": "é", "egrave": "è", "agrave": "à",
    "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "pound": "£", "euro": "€",
}


def _character(code: Column) -> Column:
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")


def _reference(token: Column) -> Column:
    name = F.substring(token, F.lit(2), F.length(token) - 2)
    number = let(
        F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).otherwise(
            F.substring(name, F.lit(2), F.length(name))).cast("int"), _character)
    return F.when(name.startswith("#"), number).otherwise(F.coalesce(lookup(NAMED, name), token))


def page_text(html: Column) -> Column:
    """The page's text with runs of white space as one blank; empty for a null."""
    def plain(token: Column) -> Column:
        long = F.length(token) > 1
        return F.when(long & token.startswith("<"), " ").when(long & token.startswith("&"), _reference(token)).otherwise(token)

    tokens = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(SCAN), F.lit(0))
    return collapse_ws(F.array_join(F.transform(tokens, plain), ""))
