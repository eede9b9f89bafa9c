"""Text clean-up and text predicates, all built-in expressions over whole texts."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from geneweft.config import (
    DEATH_WORDS,
    LOGIC_TOKENS,
    OSCILLATOR_WORDS,
    PARAGRAPH_WORDS,
    TOGGLE_WORDS,
)
from geneweft.functions.values import contains_any, is_json

ERROR_PREFIX = "ERROR:"
BLANK = " \n\r\t"
#: Everything that counts as white space at the ends of a text.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip_fences(text: Column) -> Column:
    """Remove a leading code fence (with or without ``json``) and a trailing one, then trim."""
    opened = F.regexp_replace(F.trim(text, F.lit(WHITE)), r"^```(json)?", "")
    return F.trim(F.regexp_replace(opened, r"```$", ""), F.lit(WHITE))


def json_slice(text: Column) -> Column:
    """From the first opening to the last closing brace, or the whole text without braces."""
    piece = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(piece == "", text).otherwise(piece)


def extract_proposals(text: Column) -> Column:
    """Object-valued members of the JSON slice as an array of JSON texts.

    Without such members the whole slice is the one proposal; a text without braces is itself.
    Null where the slice is not valid JSON.
    """
    piece = json_slice(text)
    members = F.map_values(F.from_json(piece, "map<string,string>"))
    objects = F.filter(members, lambda m: m.startswith("{"))
    has_braces = F.contains(text, F.lit("{")) & piece.startswith("{")
    return (
        F.when(~has_braces, F.array(text))
        .when(~is_json(piece), None)
        .when(F.size(objects) > 0, objects)
        .otherwise(F.array(piece))
    )


def extract_module(text: Column) -> Column:
    """First ``module name(...); ... endmodule`` of a text, trimmed; empty when there is none."""
    return F.trim(F.regexp_extract(text, r"(?s)module\s+\w+\s*\(.*?\);.*?endmodule", 0))


def validate_hdl(code: Column) -> Column:
    """Name of the first violated rule of combinational HDL, null when the code passes."""
    has_logic = code.contains(LOGIC_TOKENS[0])
    for token in LOGIC_TOKENS[1:]:
        has_logic = has_logic | code.contains(token)
    return (
        F.when(~(code.contains("module ") & code.contains("endmodule")), F.lit("missing module"))
        .when(~code.contains("input "), F.lit("missing input"))
        .when(~code.contains("output "), F.lit("missing output"))
        .when(~has_logic, F.lit("missing logic"))
        .when(code.rlike(r"(?U)\balways\b"), F.lit("forbidden always"))
        .when(code.rlike(r"(?U)\breg\b"), F.lit("forbidden reg"))
        .when(code.contains("#"), F.lit("forbidden delay"))
    )


def is_error(text: Column, localised_prefix: str | None = None) -> Column:
    flag = F.startswith(text, F.lit(ERROR_PREFIX))
    if localised_prefix:
        flag = flag | F.startswith(text, F.lit(localised_prefix))
    return F.coalesce(flag, F.lit(False))


def expects_death(intent: Column) -> Column:
    return contains_any(intent, DEATH_WORDS)


def motif_class(description: Column) -> Column:
    """toggle, oscillator or default; a label only, it never replaces a topology."""
    return (
        F.when(contains_any(description, TOGGLE_WORDS), F.lit("toggle"))
        .when(contains_any(description, OSCILLATOR_WORDS), F.lit("oscillator"))
        .otherwise(F.lit("default"))
    )


def intent_flags(text: Column) -> Column:
    return F.struct(expects_death(text).alias("expects_death"), motif_class(text).alias("motif"))


def relevant_paragraphs(text: Column, words: tuple[str, ...] = PARAGRAPH_WORDS, unicode_digits: bool = False) -> Column:
    """Lines with a digit and a kinetic word, trimmed and joined again; no explode, so no shuffle."""
    digit = r"\p{N}" if unicode_digits else "[0-9]"
    any_word = "|".join(words)
    lines = F.transform(F.split(text, "\n"), lambda p: F.trim(p, F.lit(WHITE)))
    kept = F.filter(lines, lambda p: p.rlike(digit) & F.lower(p).rlike(any_word))
    return F.array_join(kept, "\n")


def truncate_context(text: Column, max_chars: int = 2400) -> Column:
    return F.substring(F.trim(text, F.lit(BLANK)), 1, max_chars)


REFERENCE = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
# numbers that stand for what Windows-1252 has there, as browsers read them
CONTROL = {f"{c:08X}": bytes([c]).decode("cp1252") for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def decode_references(text: Column) -> Column:
    """Character references, named and numeric, each decoded once; unknown names stay.

    The text is cut before every reference, so all of them are looked up in one pass.
    """
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    control = F.create_map(*[F.lit(x) for pair in CONTROL.items() for x in pair])

    def decoded(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"^&#0*([0-9]{1,7});", 1)
        hexadecimal = F.regexp_extract(piece, r"^&#[xX]0*([0-9A-Fa-f]{1,6});", 1)
        code = F.when(decimal != "", F.conv(decimal, 10, 16)).when(hexadecimal != "", hexadecimal)
        padded = F.upper(F.lpad(code, 8, "0"))
        by_code = F.coalesce(F.try_element_at(control, padded), F.decode(F.unhex(padded), "UTF-32"))
        by_name = F.try_element_at(named, F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]*);", 1))
        rest = F.regexp_replace(piece, "^" + REFERENCE, "")
        return F.coalesce(F.concat(F.coalesce(by_code, by_name), rest), piece)

    pieces = F.transform(F.split(text, f"(?={REFERENCE})"), decoded)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


BOUNDARY = "\u0001"


def html_text(html: Column, keep_scripts: bool = False) -> Column:
    """Visible text of a page: every text node trimmed, blank ones dropped, one per line."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", BOUNDARY)
    if not keep_scripts:
        body = F.regexp_replace(body, r"(?is)<script\b[^>]*>.*?</script\s*>", BOUNDARY)
        body = F.regexp_replace(body, r"(?is)<style\b[^>]*>.*?</style\s*>", BOUNDARY)
    # quoted attributes may hold ">"; a tag with an unclosed quote ends at the next ">"
    body = F.regexp_replace(body, r"""(?s)<[!/?A-Za-z](?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+>""", BOUNDARY)
    body = F.regexp_replace(body, r"(?s)<[!/?A-Za-z][^>]*>", BOUNDARY)
    nodes = F.transform(F.split(body, BOUNDARY), lambda s: F.trim(decode_references(s), F.lit(WHITE)))
    return F.array_join(F.filter(nodes, lambda s: s != ""), "\n")
