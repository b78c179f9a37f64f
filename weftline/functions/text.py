"""Text expressions, all native: white space, signatures, lengths, slugs, Markdown stripping.

White space is the set that ECMAScript's ``\\s`` has; Java's and RE2's ``\\s`` lack
parts of it, so it is spelled out.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space characters.
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACES = f"[{SPACE}]+"
#: White space whose code is below 256, which Java looks up in one table, and how the rest begins in UTF-8.
_LATIN = r"[\t\n\x0B\f\r \u00a0]+"
_WIDE = (b"\xe2\x80", b"\xe2\x81\x9f", b"\xe1\x9a\x80", b"\xe3\x80\x80", b"\xef\xbb\xbf")
#: Patterns of Markdown that signatures and block classes are defined by, here and below.
LINK_OR_IMAGE = r"!?\[[^\]]*\]\([^)]*\)"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _has_wide_space(c: Column) -> Column:
    """Whether there may be white space beyond ``_LATIN``: a search for bytes, many times quicker than the class."""
    b = c.cast("binary")
    return functools.reduce(lambda x, y: x | y, (F.contains(b, F.lit(bytearray(w))) for w in _WIDE))


def collapsed(c: Column, of: Column | None = None) -> Column:
    """Runs of white space as one space, none at the ends; ``of`` is what c was made of by taking parts out."""
    wide = _has_wide_space(c if of is None else of)
    return F.trim(F.when(wide, F.regexp_replace(c, SPACES, " ")).otherwise(F.regexp_replace(c, _LATIN, " ")))


def normalised(c: Column) -> Column:
    return F.lower(collapsed(text_of(c)))


def page_signature(markdown: Column) -> Column:
    """What exact duplicates share: the text without links, images, URLs, case and layout."""
    t = text_of(markdown)
    without = F.regexp_replace(F.regexp_replace(t, LINK_OR_IMAGE, ""), rf"https?://[^{SPACE}]+", "")
    return F.lower(collapsed(F.when(t.contains("](") | t.contains("://"), without).otherwise(t), t))


def content_hash(markdown: Column) -> Column:
    return F.sha1(page_signature(markdown))


def content_word_len(markdown: Column) -> Column:
    """Length of the text that is neither link, image nor Markdown sign."""
    t = F.regexp_replace(text_of(markdown), LINK_OR_IMAGE, " ")
    t = F.regexp_replace(t, rf"(?i)<https?://[^>{SPACE}]+>", " ")
    return F.length(collapsed(F.regexp_replace(t, r"[#>|`*_~+\-]", " ")))


def slug(c: Column) -> Column:
    # 81 letters and what stands between them give the same first 80 characters as the whole text
    head = F.regexp_extract(text_of(c), r"^[^A-Za-z0-9_]*+(?:[A-Za-z0-9_][^A-Za-z0-9_]*+){0,81}", 0)
    s = F.regexp_replace(F.lower(head), r"[^A-Za-z0-9_]+", "-")
    s = F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, 80)
    return F.when(s == "", "section").otherwise(s)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(text_of(c)) / 4)


def ascii_tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9, of two characters or more."""
    return F.filter(F.split(F.lower(text_of(c)), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def shingle_features(c: Column, n: int = 2) -> Column:
    """Runs of n tokens, each joined by a space; the tokens themselves if there are fewer."""
    t = ascii_tokens(c)
    runs = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.when(F.size(t) < n, t).otherwise(runs)


def _tidied(c: Column) -> Column:
    """No blanks at ends of lines, at most one empty line, no white space at the ends."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_images(markdown: Column) -> Column:
    t = F.regexp_replace(text_of(markdown), r"\[\s*!\[[^\]]*\]\([^)]*\)\s*\]\([^)]*\)", "")
    t = F.regexp_replace(F.regexp_replace(t, IMAGE, ""), r"!\[[^\]]*\]\[[^\]]*\]", "")
    return _tidied(F.regexp_replace(t, r"(?i)<img\b[^>]*>", ""))


def strip_links(markdown: Column) -> Column:
    """Link texts stay, targets and autolinks go."""
    t = F.regexp_replace(text_of(markdown), r"\[([^\]]+)\]\([^)]*\)", "$1")
    return _tidied(F.regexp_replace(t, r"(?i)<https?://[^>\s]+>", ""))


def apply_exclusions(markdown: Column, images: bool = False, links: bool = False) -> Column:
    t = text_of(markdown)
    t = strip_images(t) if images else t
    return strip_links(t) if links else t


def strip_svg_noise(markdown: Column) -> Column:
    """Paragraphs without those that are inline drawings spilt into the text."""
    #: What only such markup has.
    marks = (
        "data:image/svg|%3c/?svg|feGaussianBlur|feFlood|feBlend|linearGradient|radialGradient|gradientUnits"
        "|stdDeviation|BackgroundImageFix|foregroundBlur|interpolation-filters|userSpaceOnUse"
    )
    kept = F.filter(F.split(text_of(markdown), r"\n{2,}"), lambda b: ~b.rlike(f"(?i){marks}"))
    return _tidied(F.array_join(kept, "\n\n"))


def strip_front_matter(markdown: Column) -> Column:
    return F.regexp_replace(text_of(markdown), r"^---\n[\s\S]*?\n---\n*", "")


def looks_rendered(html: Column, least: int = 800) -> Column:
    """True where a page has that much text without running its scripts."""
    t = F.regexp_replace(text_of(html), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.length(collapsed(F.regexp_replace(t, "<[^>]+>", " "))) > least


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter vector's components, within 0..1; 0 for a zero vector."""
    n = F.least(F.size(a), F.size(b))
    a, b = (F.transform(F.slice(x, 1, n), lambda e: e.cast("double")) for x in (a, b))
    total = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = total(a, a) * total(b, b)
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(a, b) / F.sqrt(norm)))).otherwise(0.0)


def classify_block(text: Column) -> Column:
    """(type, has_image) of a Markdown block: heading, code, table, list, image or text."""
    t = F.regexp_replace(text_of(text), rf"^[{SPACE}]+|[{SPACE}]+$", "")
    has_image = t.rlike(IMAGE)
    bare = F.regexp_replace(F.regexp_replace(t, IMAGE, ""), r"[\s)\]]", "")
    kind = (
        F.when(t.rlike(r"^#{1,6}\s"), "heading")
        .when(t.rlike(r"^(```|~~~)"), "code")
        .when(t.contains("|") & t.rlike(r"\n\s*\|?[\s:|-]*-{2,}"), "table")
        .when(t.rlike(r"(?m)^\s*([-*+]|\d+[.)])\s") & ~has_image, "list")
        .when(has_image & (F.length(bare) < 3), "image")
        .otherwise("text")
    )
    return F.struct(kind.alias("type"), has_image.alias("has_image"))


def normalised_block(text: Column) -> Column:
    """What a block is recognised by: table rows sorted, decorative images left out."""
    t = text_of(text)
    rows = F.array_join(F.array_sort(F.transform(F.split(t, "\n"), lambda r: F.regexp_replace(r, rf"^[{SPACE}]+|[{SPACE}]+$", ""))), "\n")
    t = F.when(t.rlike(r"^\s*\|") & t.rlike(r"\n\s*\|?[\s:|-]*-{2,}"), rows).otherwise(t)
    plain = normalised(F.regexp_replace(t, r"!\[\s*\]\([^)]*\)", " "))
    return F.when(plain == "", normalised(t)).otherwise(plain)


def mask_digits(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"\d+", "#")


def first_json(reply: Column, schema: str) -> Column:
    """The first JSON object or array in a model's reply, of a fenced part before all else; null if none parses."""
    value = r"(?s)(\{.*\}|\[.*\])"
    fenced = F.regexp_extract(text_of(reply), r"(?is)```(?:json)?\s*(.*?)```", 1)
    of = lambda c: F.from_json(F.regexp_extract(c, value, 1), schema)
    return F.coalesce(of(fenced), of(text_of(reply)))


def state_fingerprint(sizes: Column, signatures: Column, text: Column) -> Column:
    """16 hex digits that name a page's state: rounded sizes, its controls, and the start of its text."""
    return F.substring(F.sha1(F.concat_ws("#", sizes, F.array_join(signatures, ","), F.substring(text_of(text), 1, 400))), 1, 16)
