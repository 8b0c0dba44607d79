"""Text of HTML by tokens: comments, script and style bodies, tags with quoted attributes, entities.

One regular expression takes a page apart from left to right, so that a `>` inside a quoted attribute, a tag inside of a
comment and a `<` inside of a script each belong to the token that holds them; what is no token of markup is text. Loops are
over single characters and quoted values, possessively, so long pages neither recurse deeply nor backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import Registry
from quillon.session import table

registry = Registry()

#: The rest of a tag after its name: quoted values may hold `>`.
_ATTRIBUTES = r"""[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+>"""
#: Elements whose content is no markup, and no text to be read either. An end tag that is missing ends with the page.
_RAW = r"<{0}(?=[\s/>])" + _ATTRIBUTES + r"[\s\S]*?(?:</{0}(?=[\s/>])[^>]*+>|\z)"
#: Markup, in the order of trial. A tag begins with a letter: `a < b` is text.
_MARKUP = (r"<!--[\s\S]*?(?:--!?>|\z)", *(_RAW.format(x) for x in ("script", "style")), rf"</?[a-z]{_ATTRIBUTES}", r"<[!?/][^>]*+>")
#: Elements that end a line of text.
_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|title"
#: Character references by name, as HTML fixes them; `&amp;` is last, so that nothing is decoded twice.
_NAMED = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&hellip;", "…"), ("&middot;", "·"), ("&bull;", "•"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"),
)


def without_markup(html: Column, blocks: str = "") -> Column:
    """html without its markup; in place of a tag that ends a line, `blocks`."""
    if blocks:
        inner = "|".join(_MARKUP[:3])
        # what is dropped as a whole goes first, so a block tag inside of it leaves nothing
        html = F.regexp_replace(html, f"(?i){inner}", "")
        html = F.regexp_replace(html, rf"(?i)</?(?:{_BLOCKS})(?=[\s/>]){_ATTRIBUTES}", blocks)
    return F.regexp_replace(html, f"(?i){'|'.join(_MARKUP)}", "")


def decoded(text: Column) -> Column:
    """Character references as characters: the named ones above, and numbers of any length that name one."""
    number = lambda m: F.when(F.lower(F.substring(m, 3, 1)) == "x", F.conv(F.regexp_extract(m, "[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(m, "([0-9]+)", 1)).cast("decimal(38,0)")
    valid = lambda n: n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    # UTF-32 is the number itself
    char = lambda m: F.when(valid(number(m)), F.decode(F.unhex(F.lpad(F.hex(number(m).cast("long")), 8, "0")), "UTF-32")).otherwise(F.lit("�"))
    # references apart from what is between them, so that a decoded & begins no name
    pieces = F.regexp_extract_all(text, F.lit(r"&#(?:[0-9]{1,30}|[xX][0-9a-fA-F]{1,15});|&[a-zA-Z]{1,30};|[^&]++|&"), F.lit(0))

    def name(piece: Column) -> Column:
        for entity, c in _NAMED:
            piece = F.replace(piece, F.lit(entity), F.lit(c))
        return piece

    whole = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("&#") & p.endswith(";"), char(p)).otherwise(name(p))), "")
    return F.when(F.contains(text, F.lit("&#")), whole).otherwise(name(text))


def plain_text(html: Column) -> Column:
    """What a reader sees: text without markup, block elements as line ends, references decoded, white space collapsed."""
    text = decoded(without_markup(html, "\n"))
    text = F.regexp_replace(text, r"[ \t\r\f ]+", " ")
    return F.trim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


# RE2, of the other engine, has no possessive loops and no look-ahead
_PLAIN = r"""[^"''>]*(?:(?:"[^"]*"|''[^'']*'')[^"''>]*)*>"""
_ORACLE = "(?i)" + "|".join([
    r"<!--[\s\S]*?(?:--!?>|\z)", *(rf"<{x}(?:[\s/]{_PLAIN}|>)[\s\S]*?(?:</{x}[^>]*>|\z)" for x in ("script", "style")), rf"</?[a-z]{_PLAIN}", r"<[!?/][^>]*>",
])


@registry.query(f"SELECT page_id, md5(regexp_replace(html, '{_ORACLE}', '', 'g')) AS h FROM pages")
def text_without_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(without_markup(F.col("html"))).alias("h"))


@registry.query()
def text_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As read; held against a parser in the tests."""
    return table(spark, sf_dir, "pages").select("page_id", plain_text(F.col("html")).alias("text"))
