"""Text expressions: white space, sentences, titles, term counts, identities. All are built-in Spark expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that counts as white space in web text, beyond Java's own class.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: A word boundary between ASCII word characters only.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Small letters of Latin script with marks, and the letters that their canonical decompositions begin with.
_DECOMPOSED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and unicodedata.normalize("NFD", c)[0].isascii()}
MARKED, PLAIN = "".join(c for c, p in _DECOMPOSED.items() if p != c), "".join(p for c, p in _DECOMPOSED.items() if p != c)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def normalize_space(text: Column | str) -> Column:
    """STR-1: runs of white space become one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), SPACE, " "))


def strip_html(text: Column | str) -> Column:
    """STR-2: tags become blanks, white space is normalised."""
    return normalize_space(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "<[^>]*>", " "))


def first_sentence(text: Column | str, fallback: Column | str = "", limit: int = 220) -> Column:
    """STR-3: up to the first sentence end that white space follows; longer than `limit` is cut and ends in dots."""
    # What comes after limit + 1 letters of the text with single blanks changes nothing; blanks in it are letters, too.
    sign = SPACE.removesuffix("+")
    t = normalize_space(F.regexp_extract(F.coalesce(_col(text), F.lit("")), rf"^(?:{sign}*+[^{sign[1:]}){{0,{limit + 2}}}+", 0))
    cut = lambda first: F.when(F.length(first) > limit, F.concat(F.substring(first, 1, limit - 3), F.lit("..."))).otherwise(first)
    found = lambda t: let(F.regexp_extract(t, r"^(.*?[.!?])(?:\s|$)", 1), lambda s: let(F.when(s == "", t).otherwise(s), cut))
    return let(t, lambda t: F.when(t == "", fallback if isinstance(fallback, Column) else F.lit(fallback)).otherwise(found(t)))


def includes_any(text: Column | str, terms: list[str]) -> Column:
    """STR-5: whether the text holds any of the terms, whatever the case; substrings count."""
    t = F.lower(_col(text))
    return F.coalesce(t.rlike("|".join(re.escape(x.lower()) for x in terms)), F.lit(False)) if terms else F.lit(False)


def count_matches(text: Column | str, terms: list[str]) -> Column:
    """STR-6: occurrences of each term, none overlapping itself, summed over the terms; nested terms count twice."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    total = F.lit(0)
    for x in terms:
        total = total + F.regexp_count(t, F.lit(re.escape(x.lower())))
    return total


def contains_word(text: Column | str, pattern: str) -> Column:
    """Whether the pattern stands between ASCII word boundaries, whatever the case."""
    return F.coalesce(_col(text).rlike(f"(?iu){EDGE}(?:{pattern}){EDGE}"), F.lit(False))


def plain(text: Column | str) -> Column:
    """Lower case without marks of Latin letters."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(_col(text), F.lit(""))), MARKED, PLAIN), r"[\x{0300}-\x{036F}]", "")


def fold(text: Column | str) -> Column:
    """STR-9: lower case, marks of Latin letters dropped (composed or not), only a-z and 0-9 kept."""
    return F.regexp_replace(plain(text), "[^a-z0-9]+", "")


def identity_tokens(text: Column | str, generic: list[str] = (), least: int = 3, most: int = 12) -> Column:
    """STR-10: the distinct folded words of at least `least` letters, generic ones left out, the first `most`."""
    words = F.split(F.regexp_replace(plain(text), "[^a-z0-9]+", " "), " ")
    long = F.filter(words, lambda w: F.length(w) >= least)
    return F.slice(F.array_distinct(F.array_except(long, F.array(*map(F.lit, generic)).cast("array<string>"))), 1, most)


def clean_title(title: Column | str) -> Column:
    """STR-7: a title without leading addresses, a trailing site name, and punctuation at the ends."""
    t = normalize_space(title)
    t = F.regexp_replace(t, r"(?i)^https?://\S+\s*", "")
    t = F.regexp_replace(t, r"\s+[|]\s+[^|]*$", "")
    return F.regexp_replace(t, r"^[\s\-|:,.]+|[\s\-|:,]+$", "")


def company_name(name: Column | str, drop: str = r"official site|official website|homepage|home page|reviews?|ltd|limited|llc|inc|corp|corporation") -> Column:
    """STR-11: a name without what follows a separator, legal forms and marks; 80 characters at most."""
    t = F.regexp_replace(F.coalesce(_col(name), F.lit("")), r"\s+[|–—-]\s+.*$", "")
    t = F.regexp_replace(t, rf"(?i)\b(?:{drop})\b", "")
    return F.substring(normalize_space(F.regexp_replace(t, r"[^\p{L}\p{N}&.' ]+", " ")), 1, 80)


def company_from_domain(domain: Column | str) -> Column:
    """STR-11: the registered label of a domain as words with capitals; co.uk and the like are second-level."""
    parts = F.split(F.regexp_replace(_col(domain), r"^www\.", ""), r"\.")
    n = F.size(parts)
    second = F.get(parts, n - 2).isin("co", "com", "net", "org") & (n > 2)
    return normalize_space(F.initcap(F.regexp_replace(F.when(second, F.get(parts, n - 3)).otherwise(F.get(parts, F.lit(0))), "[-_]+", " ")))


# Texts that a search leaves in a record, in the order in which they are taken out, and what stays for them. The
# first one is taken out once.
GENERATED = (
    (r"YouTube creator/channel result for .*?(?:Related titles:|\z)", "Related titles:"),
    (r"(?:Qwant|Extracted)\s+(?:web result|candidate|URL)\s+(?:for|from)\s+[\"'“”].*?[\"'“”]", " "),
    (r"(?:Qwant|Extracted)\s+(?:web result|candidate|URL)\s+(?:for|from).*\z", " "),
    (r"Matched public source:.*?(?:Source pack:|\z)", " "),
    (r"Source pack:.*?(?:\.|\z)", " "),
    (r"Found via [^.;]+[.;]?", " "),
    (r"TikTok public user/profile found for .*?Matched forex/trading search context:[^.;]+[.;]?", " "),
    (r"MQL5 public signal provider matched [^.;]+[.;]?", " "),
    (r"Potential copy trading, signal provider, money manager or high-calibre trader lead[.;]?", " "),
)


def strip_generated(text: Column | str) -> Column:
    """STR-14: a text without what searches wrote into it, blanks made single; null gives an empty one."""
    (first, kept), *others = GENERATED
    t = F.regexp_replace(F.coalesce(_col(text), F.lit("")), rf"(?i)\A((?s:.*?)){first}", f"$1{kept}")
    for pattern, instead in others:
        t = F.regexp_replace(t, f"(?i){pattern}", instead)
    return normalize_space(t)


def drop_after(text: Column | str, markers: list[str]) -> Column:
    """STR-14: the text without each marker word and all that follows it in its line."""
    t = _col(text)
    for m in markers:
        t = F.regexp_replace(t, rf"(?im)\b{re.escape(m)}.*$", " ")
    return t


def text_view(*columns: Column | str) -> Column:
    """STR-15: the non-empty columns joined with blanks; arrays are joined likewise."""
    return F.concat_ws(" ", *(F.when(_col(c) != "", _col(c)) if isinstance(c, str) else c for c in columns))


def csv_cell(value: Column | str) -> Column:
    """STR-16: quoted only if it holds a quote, comma or newline; quotes doubled; null is empty."""
    v = F.coalesce(_col(value).cast("string"), F.lit(""))
    return F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def falsy(*columns: Column | str) -> Column:
    """The first value that is neither null, nor empty, nor zero."""
    out = []
    for c in columns:
        c = _col(c)
        out.append(F.when((c.cast("string") != "") & (c.cast("string") != "0") & (c.cast("string") != "0.0"), c))
    return F.coalesce(*out)


def half_up(x: Column) -> Column:
    """MTH-1: rounded half towards plus infinity."""
    return F.floor(x + 0.5)


def decode_loose(text: Column | str) -> Column:
    """STR-8: escapes that pages leave in texts and links, undone where they are whole: \\u0026, \\/, &amp; and percent codes; a
    plus sign stays, and a text with a broken percent code stays as it is."""
    t = F.coalesce(_col(text), F.lit(""))
    for escaped, plain_ in (("\\u0026", "&"), ("\\u003d", "="), ("\\/", "/"), ("&amp;", "&")):
        t = F.replace(t, F.lit(escaped), F.lit(plain_))
    return F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)


def is_generic_name(name: Column | str, generic: str) -> Column:
    """STR-13: a name that no search for a person or firm can start from: too short, or the generic pattern as a whole."""
    n = F.trim(F.regexp_replace(F.lower(F.coalesce(_col(name), F.lit(""))), "[^a-z0-9]+", " "))
    return (F.length(n) < 3) | n.rlike(f"^(?:{generic})$")


def clean_identity(name: Column | str, drop: str = "official|profile|page|account") -> Column:
    """STR-12: a name without handles' marks, bracketed parts, generic words and what follows a separator."""
    t = F.regexp_replace(F.coalesce(_col(name), F.lit("")), r"\([^)]*\)|\[[^\]]*\]", " ")
    t = F.regexp_replace(t, r"\s+[|•–—-]\s+.*$", "")
    return normalize_space(F.regexp_replace(F.regexp_replace(t, rf"(?i)\b(?:{drop})\b", " "), "^@+", ""))


def is_useful_identity(name: Column | str, generic: str) -> Column:
    """STR-12: a clean name of three letters or more that isn't generic."""
    n = clean_identity(name)
    return (F.length(fold(n)) >= 3) & ~is_generic_name(n, generic)


def names_in_text(text: Column | str, most: int = 5) -> Column:
    """STR-12: runs of two or three capitalised words, and @handles, in order, distinct."""
    t = F.coalesce(_col(text), F.lit(""))
    found = F.concat(F.regexp_extract_all(t, F.lit(r"(?:^|[^\p{L}])(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,2})(?![\p{L}])"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"(?:^|[^\w.])@([A-Za-z0-9_]{3,30})"), F.lit(1)))
    return F.slice(F.array_distinct(found), 1, most)
