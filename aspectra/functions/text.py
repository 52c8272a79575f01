"""Text expressions: every function takes and gives columns, nothing leaves the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from aspectra.plans.constants import HASH_ATTRIBUTES, KEYWORDS, QUOTA_REASONS, UNIT_PATTERNS

WORD_CHAR = r"[\p{L}\p{N}_]"
NO_WORD_BEFORE, NO_WORD_AFTER = rf"(?<!{WORD_CHAR})", rf"(?!{WORD_CHAR})"


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_attribute(value: Column) -> Column:
    """Null or empty: 'unknown'; otherwise lower case with white space collapsed."""
    return F.when(value.isNull() | (value == ""), F.lit("unknown")).otherwise(collapse_space(F.lower(value)))


def hardware_hash(*attributes: Column) -> Column:
    """MD5 of the normalised attributes, in the order of HASH_ATTRIBUTES where those are given."""
    assert attributes, HASH_ATTRIBUTES
    return F.md5(F.concat_ws(" | ", *[normalize_attribute(a) for a in attributes]))


def device_id(hashed: Column) -> Column:
    return F.concat(F.lit("DEV-"), F.upper(F.substring(hashed, 1, 10)))


def blank_to_null(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.nullif(trimmed, F.lit(""))


def price_from_text(text: Column) -> Column:
    """Digits of a price as an integer; none: 0."""
    digits = F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def safe_name(text: Column, blank: str = "") -> Column:
    """Runs of other characters than a-z A-Z 0-9 _ - become '_', none at the ends; lower case."""
    out = F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", ""))
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(blank)).otherwise(out) if blank else out


def _accents() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, from Unicode's decompositions."""
    pairs = {"đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        bare = unicodedata.normalize("NFD", chr(code))[0]
        if bare.isascii() and bare.isalpha():
            pairs[chr(code)] = bare
    return "".join(pairs), "".join(pairs.values())


def unaccent(text: Column) -> Column:
    """Letters without their marks, composed or not."""
    have, want = _accents()
    bare = F.replace(F.replace(F.translate(text, have, want), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    return F.regexp_replace(bare, r"\p{Mn}", "")


def media_name(text: Column) -> Column:
    """safe_name of the unaccented text; object keys use safe_name alone, and so differ for accented names."""
    return safe_name(unaccent(text))


def object_key(prefix: str, name: Column, stem: Column, kind: Column, extension: Column) -> Column:
    """prefix/name/stem_kind.extension; an empty prefix is left out, a blank stem becomes 'asset'."""
    file = F.concat(safe_name(stem, blank="asset"), F.lit("_"), kind, F.lit("."), F.regexp_replace(extension, r"^\.+", ""))
    parts = [F.lit(prefix.strip("/"))] if prefix.strip("/") else []
    return F.concat_ws("/", *parts, safe_name(name), file)


def safe_title(index: Column, title: Column, video: Column) -> Column:
    """Two-digit index, underscore, and 50 characters of the sanitised title or else the video id."""
    short = F.substring(media_name(title), 1, 50)
    number = F.when(index < 100, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string"))
    return F.concat(number, F.lit("_"), F.coalesce(F.nullif(short, F.lit("")), video))


def video_id(url: Column) -> Column:
    """First path segment on the short host, else the query's v; null where there is neither."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    first = F.split_part(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+", ""), F.lit("/"), F.lit(1))
    found = F.when(host.isin("youtu.be", "www.youtu.be"), first).otherwise(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")))
    return F.nullif(found, F.lit(""))


def search_text(name: Column) -> Column:
    return F.concat(F.lit("review "), name)


def clamp_results(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(50), n))


def preview(text: Column, limit: int = 120, mark: str = "...") -> Column:
    """Texts over the limit are cut so that with the mark they have just that length."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(mark)), F.lit(mark))).otherwise(text)


def tool_preview(text: Column, limit: int = 3000, mark: str = "…") -> Column:
    """Texts over the limit are cut at it, then marked."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def quota_exceeded(status: Column, reasons: Column) -> Column:
    known = F.array(*map(F.lit, QUOTA_REASONS))
    return (status == 403) & F.coalesce(F.arrays_overlap(reasons, known), F.lit(False))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of lower-case words, each word padded by two spaces before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: F.length(w) > 0)
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def keyword_pattern(words: list[str]) -> str:
    """One alternation with boundaries that hold for every alphabet."""
    return f"(?iu){NO_WORD_BEFORE}(?:{'|'.join(map(re.escape, words))}){NO_WORD_AFTER}".replace("\\ ", " ").replace("\\-", "-")


def unit_pattern(pattern: str) -> str:
    r"""A unit pattern whose \d and \s stand for the digits and the white space of every script, spelled out for Java and RE2 alike."""
    return "(?i)" + pattern.replace(r"\d", r"\p{Nd}").replace(r"\s", r"[\t-\r\x1c-\x20\x{85}\p{Z}]")


def aspects_of(text: Column, keywords: dict[str, list[str]] = KEYWORDS, units: dict[str, list[str]] = UNIT_PATTERNS) -> Column:
    """map<aspect, 1> of the aspects that the text mentions; empty where there is none."""
    pairs = []
    for aspect, words in keywords.items():
        hit = text.rlike(keyword_pattern(words))
        for pattern in units.get(aspect, []):
            hit = hit | text.rlike(unit_pattern(pattern))
        pairs.append(F.struct(F.lit(aspect).alias("key"), F.when(hit, F.lit(1)).alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def conditional_ilike(column: Column, part: str) -> Column:
    """The wildcards of part keep their meaning."""
    return column.ilike(f"%{part}%")
