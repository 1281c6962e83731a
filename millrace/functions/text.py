"""String expressions, Column to Column; all but ``nfkc`` stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of tags that are shown, words that end a label, words that are no terms.
TAG_PREFIXES = ("author_tag_", "content_")
STOP_WORDS = "and are for from has have https into just like new not official the this that with world worlds www".split()
SUFFIX_WORDS = "world worlds room map hub place".split()


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dedupe_ordered(items: Column, key) -> Column:
    """Distinct items by ``key``, first spelling and order kept; null items dropped."""
    some = F.filter(items, lambda x: x.isNotNull())
    return let(
        some,
        lambda a: let(
            F.transform(a, key), lambda k: F.filter(a, lambda x, i: F.array_position(k, key(x)) == (i + 1).cast("long"))
        ),
    )


def clean_tags(tags: Column) -> Column:
    """Keep prefixed tags without their prefix, underscores as spaces; case-insensitive distinct, first spelling kept."""
    shown = F.filter(tags, lambda t: F.coalesce(t.rlike("^(?:" + "|".join(TAG_PREFIXES) + ")"), F.lit(False)))
    bare = F.transform(shown, lambda t: F.trim(F.replace(F.regexp_replace(t, "^(?:" + "|".join(TAG_PREFIXES) + ")", ""), F.lit("_"), F.lit(" "))))
    return dedupe_ordered(F.filter(bare, lambda t: t != ""), F.lower)


def compose(name: Column, description: Column, tags: Column, scene: Column | None = None) -> Column:
    """Name, ``Tags: a, b`` and description on lines; a single space if there is nothing; optionally a scene line."""
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    listed = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    parts = [some(name), listed, some(description)]
    if scene is not None:
        parts.append(F.when(some(scene).isNotNull(), F.concat(F.lit("Scene: "), some(scene))))
    return F.coalesce(F.nullif(F.concat_ws("\n", *parts), F.lit("")), F.lit(" "))


def platform(filename: Column) -> Column:
    """Substring classifier, Windows first."""
    f = F.lower(filename)
    return F.when(f.contains("windows"), "windows").when(f.contains("android"), "android").otherwise("unknown")


def strip_punctuation(text: Column) -> Column:
    """General punctuation as spaces; of the rest only ASCII and CJK are kept."""
    spaced = F.regexp_replace(text, "[\\u2000-\\u206F]", " ")
    return F.regexp_replace(spaced, "[^\\x00-\\x7F\\u3000-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uFF00-\\uFFEF]", "")


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode NFKC, for which Spark has no function: an Arrow-batched pandas UDF."""
    return F.pandas_udf(_nfkc, "string")(text)


def search_terms(query: str, most: int = 6) -> list[str]:
    """Lower-case NFKC terms of two characters or more; wildcards act as spaces."""
    plain = unicodedata.normalize("NFKC", query.lower()).replace("%", " ").replace("_", " ")
    return [w for w in plain.split() if len(w) >= 2][:most]


def haystack(*cols: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


def relevance(name: Column, author: Column, visits: Column, query: str) -> Column:
    """120 for the exact name, 80 as prefix, 45 inside, 18 in the author, plus ln(visits + 1)."""
    n, q = F.lower(name), F.lit(query.lower())
    score = lambda test, x: F.when(F.coalesce(test, F.lit(False)), x).otherwise(0)
    fixed = score(n == q, 120) + score(F.startswith(n, q), 80) + score(F.contains(n, q), 45) + score(F.contains(F.lower(author), q), 18)
    return fixed + F.log1p(F.coalesce(visits, F.lit(0)).cast("double"))


def file_reference(url: Column) -> Column:
    """struct<file_id, version> of ``/file_<id>/<version>/``, null where there is none."""
    pattern = r"/file_([\w-]+)/(\d+)/"
    found = F.coalesce(url.rlike(pattern), F.lit(False))
    return F.when(found, F.struct(F.regexp_extract(url, pattern, 1).alias("file_id"), F.try_to_number(F.regexp_extract(url, pattern, 2), F.lit("9" * 18)).cast("long").alias("version")))


def content_path(digest: Column, ending: str = ".png") -> Column:
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.concat(digest, F.lit(ending)))


def md5_matches(content: Column, expected: Column) -> Column:
    """Base64 MD5 against the content; anything that can't be decoded is false."""
    return F.coalesce(F.lower(F.hex(F.try_to_binary(expected, F.lit("base64")))) == F.md5(content), F.lit(False))


def verification(size: Column, wanted_size: Column, md5_ok: Column, known: Column, digest: Column) -> Column:
    """Status of a download: size first, then hash, then a clash with what is known."""
    return (
        F.when(size != wanted_size, "size_mismatch").when(~md5_ok, "md5_mismatch")
        .when(known.isNotNull() & (known != digest), "collision").otherwise("confirmed")
    )


def short_label(label: Column, words: int = 3, chars: int = 28, ellipsis: str = "…") -> Column:
    """Drop trailing suffix words while another word is left, then cap words and characters."""
    split = F.filter(F.split(F.trim(F.coalesce(label, F.lit(""))), r"\s+"), lambda w: w != "")
    plain = F.transform(split, lambda w: ~F.lower(w).isin(SUFFIX_WORDS))
    last = F.coalesce(F.array_max(F.transform(plain, lambda p, i: F.when(p, i + 1))), F.lit(1))
    joined = F.array_join(F.slice(split, F.lit(1), F.least(last, F.lit(words))), " ")
    return let(joined, lambda t: F.when(F.length(t) > chars, F.concat(F.rtrim(F.substring(t, 1, chars - len(ellipsis))), F.lit(ellipsis))).otherwise(t))


# Words that a label drops, labels that say nothing, and what a label is called that has none.
FORBIDDEN_WORDS = ("and", "for", "with")
BAD_LABELS = ("misc", "miscellaneous", "unknown", "unlabeled", "unlabelled", "untitled")
NUMBERED_LABEL = r"^(?:Island|Neighborhood|District) [0-9]+$"


def clean_label(raw: Column, fallback: Column, words: int = 4, chars: int = 32, forbidden: tuple[str, ...] = FORBIDDEN_WORDS) -> Column:
    """Outer quotes, line breaks and commas out, forbidden words out, capped; the fallback if it says nothing or nothing is left."""
    bare = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^[\"'`]+|[\"'`]+$", "")
    plain = F.regexp_replace(F.regexp_replace(bare, r"[\r\n\t]+", " "), "[,;:]+", " ")
    kept = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*forbidden))
    capped = F.rtrim(F.substring(F.array_join(F.slice(kept, 1, words), " "), 1, chars))
    return F.when(bad_label(plain), fallback).otherwise(F.coalesce(F.nullif(capped, F.lit("")), fallback))


def label_key(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^a-z0-9]+", " "))


def bad_label(label: Column) -> Column:
    """Nothing in Latin letters or digits, a word for nothing, or a numbered stand-in."""
    key = label_key(label)
    return (key == "") | key.isin(*BAD_LABELS) | F.coalesce(label, F.lit("")).rlike(NUMBERED_LABEL)


#: A word of three characters or more (digits, apostrophes, hyphens and underscores in it), or a run of two or more kana or ideographs.
TERM = r"([a-z0-9][a-z0-9'_-]{2,}|[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]{2,})"


def terms(text: Column, most: int | None = None, stop: list[str] = STOP_WORDS) -> Column:
    """Words of a text in order, without stop words and numbers; of the whole text, unless ``most`` is given."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), 1)
    kept = F.filter(found, lambda w: ~w.isin(stop) & ~w.rlike("^[0-9]+$"))
    return kept if most is None else F.slice(kept, 1, most)


def parsed_label(raw: Column) -> Column:
    """Label out of a model's answer: fences off, JSON object or list, else the first braces, else 40 characters."""
    bare = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"```(?:json)?", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*?\})", 1)
    of = lambda s: F.nullif(F.trim(F.coalesce(F.get_json_object(s, "$.label"), F.get_json_object(s, "$[0].label"))), F.lit(""))
    return F.coalesce(of(bare), of(inner), F.substring(bare, 1, 40))


def rgb(colour: Column) -> Column:
    """[r, g, b] of ``#rrggbb``, mid-grey for anything else."""
    part = lambda i: F.conv(F.substring(colour, i, 2), 16, 10).cast("int")
    return F.when(F.coalesce(colour.rlike("^#[0-9a-fA-F]{6}$"), F.lit(False)), F.array(part(2), part(4), part(6))).otherwise(F.array(*[F.lit(136)] * 3))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def non_latin(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\u0000-ɏ -⁯]"), F.lit(False))


def truncated(text: Column, most: int = 42) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def massing(key: Column, salt: str, n: int) -> Column:
    """Deterministic draw below n: the first eight bytes of a salted SHA-256, big-endian and unsigned."""
    head = F.substring(F.sha2(F.concat(F.lit(salt), key), 256), 1, 16)
    return F.pmod(F.conv(head, 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("int")


def typology(listed: Column, area: Column, n: Column, least: float) -> Column:
    """landmark if listed, detached where each has at least ``least`` of the area, else row."""
    return F.when(listed, "landmark").when(area / F.greatest(n, F.lit(1)) >= least, "detached").otherwise("row")
