"""Text, number and URL functions as Column expressions.

Patterns are written once, in a form that Java and RE2 read alike; a failed or
empty match is null. Python's Unicode blanks are matched with ``(?U)``.
"""

from __future__ import annotations

import functools
import operator
import re
import sys
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from listforge.plans import rules


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"(\\.|\[(?:\\.|[^\]\\])+\]|\(\?:|.)((?:[?*+]|\{\d*,?\d*\})[?+]?)?", re.S)


@functools.cache
def needles(pattern: str) -> frozenset[str]:
    """Texts, in lower case, one of which is in all that the pattern matches; none where that isn't told."""
    if re.search(r"\(\?[^:]|\\[pPxuQkNc0-9]", pattern):
        return frozenset()
    tokens = _TOKEN.findall(pattern)[::-1]
    least = lambda texts: min(map(len, texts), default=0)

    def alternatives() -> tuple[frozenset[str], str]:
        """What the tokens up to the closing bracket ask for, and that bracket's quantifier."""
        found, here, run = [], [], ""
        while True:
            token, times = tokens.pop() if tokens else (")", "")
            plain = token[-1] if len(token) == 1 and token not in ".^$|()" or token[0] == "\\" and not token[1].isalnum() else ""
            if token in ("(", "(?:"):
                inner, times = alternatives()
            else:
                inner = frozenset()
            optional = times[:1] in ("?", "*") or times.startswith(("{0", "{,"))
            if plain and not optional and (plain.isascii() or plain.lower() == plain.upper()):
                run += plain.lower()
                if not times:
                    continue
            here += [frozenset([run])] if run else []
            here += [inner] if inner and not optional else []
            run = ""
            if token in ("|", ")"):
                found.append(max(here, key=least, default=frozenset()))
                here = []
            if token == ")":
                return frozenset().union(*found) if all(found) else frozenset(), times

    return alternatives()[0]


def folded(c: Column) -> Column:
    """c with ASCII letters in lower case, also the four characters that (?iu) takes for some of them: what needles are looked up in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER + "\u017f\u0131\u0130\u212a", LOWER + "siik"))


def may_match(low: Column, *patterns: str) -> Column:
    """False only where none of the patterns matches the text of which low is the folded form: byte searches, far cheaper than patterns."""
    wanted = [needles(p) for p in patterns]
    if not all(wanted):
        return F.lit(True)
    some = frozenset().union(*wanted)
    return functools.reduce(operator.or_, [low.contains(n) for n in sorted(some) if not any(m != n and m in n for m in some)])


def matches(c: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether the pattern, which ignores case, is found in c; low, if given, is c folded."""
    found = c.rlike("(?iu)" + pattern)
    return found if low is None else may_match(low, pattern) & found


def first(c: Column, pattern: str, group: int = 1, flags: str = "", low: Column | None = None) -> Column:
    """Group of the first match, null if there is none or it is empty; low, if given, is c folded."""
    found = let(F.regexp_extract(c, flags + pattern, group), lambda m: F.nullif(m, F.lit("")))
    return found if low is None else F.when(may_match(low, pattern), found)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which stands, and is evaluated, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(value: Column) -> Column:
    """value, evaluated once where it stands: filters on it aren't pushed below, where each would work it out anew, maybe before rows are spread over tasks."""
    return F.when(F.spark_partition_id() >= 0, value)  # not deterministic by Spark's rules


def first_of(c: Column, patterns: Sequence[str], flags: str = "(?iu)", low: Column | None = None) -> Column:
    return F.coalesce(*[first(c, p, 1, flags, low) for p in patterns])


def case_of(c: Column, ordered: Sequence[tuple[str, str]], low: Column | None = None) -> Column:
    """Label of the first rule that matches, else the empty string; low, if given, is c folded."""
    out = F.lit("")
    for pattern, label in reversed(ordered):
        out = F.when(matches(c, pattern, low), label).otherwise(out)
    return out


def clean_text(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def _unicode_forms() -> tuple[dict[str, str], dict[str, str], str]:
    """Characters whose compatibility form, without combining marks, has ASCII letters or digits: of one character, of several; and the marks, and what has a form of marks alone."""
    one, several, marks = {}, {}, []
    for i in range(128, sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.combining(c):
            marks.append(c)
        elif unicodedata.decomposition(c):
            form = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if not form:
                marks.append(c)
            elif any(x.isascii() and x.isalnum() for x in form):
                (one if len(form) == 1 else several)[c] = form
    return one, several, "".join(marks)


def _ranges(chars: Sequence[str], gap: int) -> str:
    """A class of these characters and of those between two that are at most gap apart."""
    spans: list[list[int]] = []
    for i in sorted(map(ord, chars)):
        if spans and i - spans[-1][1] <= gap:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in spans) + "]"


_ONE, _SEVERAL, _MARKS = _unicode_forms()
#: A few ranges with all of _SEVERAL, for characters beyond ASCII alone: a class of 400 single characters is tried one by one for each character of a text.
_NEAR_SEVERAL = rf"[\x{{80}}-\x{{{sys.maxunicode:X}}}&&{_ranges(list(_SEVERAL), 8)}]"


def norm_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits of the compatibility form without marks, anything else one underscore."""
    forms = F.create_map(*[F.lit(x) for kv in _SEVERAL.items() for x in kv])
    # Only the characters that the text has are replaced. Their forms hold none of them, so the order is no matter.
    present = F.array_distinct(F.regexp_extract_all(c, F.lit(_NEAR_SEVERAL), 0))
    spelled = F.when(c.rlike(_NEAR_SEVERAL), F.aggregate(present, c, lambda text, x: F.replace(text, x, F.coalesce(F.try_element_at(forms, x), x)))).otherwise(c)
    # What translate has no counterpart for goes: the marks.
    plain = F.translate(spelled, "".join(_ONE) + _MARKS, "".join(_ONE.values()))
    plain = F.when(F.octet_length(c) == F.length(c), c).otherwise(plain)  # ASCII is its own form
    return F.coalesce(F.btrim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(""))


def amenity_column(key: Column) -> Column:
    """Flag column of an amenity key, null for what is not one."""
    bad = key.isin(*rules.DROPPED_AMENITIES) | (key == "") | (F.length(key) > 40) | key.rlike("[0-9]") | key.rlike("|".join(rules.SPAM_AMENITIES))
    known = F.create_map(*[F.lit(x) for kv in rules.AMENITIES.items() for x in kv])
    return F.when(~bad, F.coalesce(F.try_element_at(known, key), F.concat(F.lit("has_"), key)))


def title_from_slug(c: Column) -> Column:
    words = F.filter(F.split(c, "-"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " ")


def clean_location_part(c: Column) -> Column:
    text = F.btrim(clean_text(c), F.lit(" .:-"))
    return F.when((F.length(text) > 70) | F.lower(text).rlike("|".join(w.replace("#", "[#]") for w in rules.NOT_PLACES)), "").otherwise(text)


def word_runs(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


def section(md: Column, name: str) -> Column:
    return F.regexp_extract(md, rf"(?siu)###\s*{name}(.+?)(?:###|\z)", 1)


def bullets(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"\*\s+([^\n*]+?)\s*(?:\n|$)"), 1)
    return F.filter(F.transform(found, clean_ends), lambda x: x != "")


def clean_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_number(c: Column) -> Column:
    """First decimal: with both separators dots group, a lone comma is decimal; null if that is no number."""

    def read(m: Column) -> Column:
        grouped = F.replace(F.replace(m, F.lit(".")), F.lit(","), F.lit("."))
        return F.when(m.contains(",") & m.contains("."), grouped).otherwise(F.replace(m, F.lit(","), F.lit("."))).try_cast("double")

    return let(F.regexp_extract(c, r"(-?[0-9][0-9.,]*)", 1), read)  # no match is empty, which casts to null


def parse_int(c: Column) -> Column:
    return F.bround(parse_number(c)).try_cast("bigint")


def parse_price(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, "([0-9][0-9.,]*)", 1), "[^0-9]", "").try_cast("bigint")


def parse_thousands(c: Column) -> Column:
    return F.replace(F.regexp_extract(F.replace(c, F.lit(" ")), "(-?[0-9][0-9.]*)", 1), F.lit(".")).try_cast("bigint")


def parse_decimal(c: Column) -> Column:
    return F.regexp_extract(c, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def floor_number(c: Column) -> Column:
    return F.when(F.upper(clean_ends(c)).isin("PB", "PLANTA BAJA", "P.B.", "BAJO"), F.lit(0).cast("bigint")).otherwise(parse_thousands(c))


def to_usd(amount: Column, currency: Column, country: Column) -> Column:
    """Half-even; a currency that isn't the country's stays as it is."""
    c = F.replace(F.replace(F.upper(currency), F.lit("U$S"), F.lit("USD")), F.lit("US$"), F.lit("USD"))
    return (
        F.when(c.isin("USD", "US DOLLAR", "DOLLAR"), amount)
        .when(c.isin("ARS", "AR$", "$") & (country == "AR"), F.bround(amount / float(rules.ARS_PER_USD)).cast("bigint"))
        .when(c.isin("UYU", "$U", "$") & (country == "UY"), F.bround(amount / float(rules.UYU_PER_USD)).cast("bigint"))
        .otherwise(amount)
    )


def ratio(top: Column, bottom: Column, digits: int = 2) -> Column:
    return F.bround(top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0)), digits)


def bucket(c: Column, limits: Sequence[tuple[float, str]]) -> Column:
    out = F.lit(limits[-1][1])
    for upper, label in reversed(limits):
        out = F.when(c <= upper, label).otherwise(out)
    return F.when(c.isNull(), "").otherwise(out)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def comparable_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def normalize_url(url: Column) -> Column:
    """No fragment, lower-case host, single slashes, query only for pagination; empty if not http(s)."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+", "/")
    path = F.regexp_replace(path, ";[^/]*$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.when(query.rlike(r"(?i)(^|[^\p{L}\p{N}_])(page|pagina|pag|offset)="), F.concat(F.lit("?"), query)).otherwise("")
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host(url), path, kept)).otherwise("")


def listing_id(url: Column) -> Column:
    end = r"(?:$|[/?#])"
    return F.coalesce(*[first(url, p) for p in (rf"--([0-9]{{6,}}){end}", rf"-inmuebles-([0-9]{{6,}}){end}", rf"/([0-9]{{6,}}){end}", rf"-([0-9]{{6,}})\.html{end}")], F.lit(""))


def apartment_url(url: Column) -> Column:
    return F.lower(url).rlike("departamento|apartamento")


def same_domain(url: Column, base: Column) -> Column:
    h, b = comparable_host(url), comparable_host(base)
    return (h == b) | F.endswith(h, F.concat(F.lit("."), b))


def detail_url(url: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: F.rlike(url, p))


def useful_url(url: Column, patterns: Column, words: Column, apartments_only: bool = False) -> Column:
    low = F.lower(url)
    ok = ~low.rlike(r"\.(jpg|jpeg|png|gif|webp|pdf)$") & ~low.rlike("/login|/signin|/contact|/contacto|/ayuda")
    if apartments_only:
        ok &= apartment_url(url)
    return ok & F.when(detail_url(url, patterns), ~low.contains("alquiler")).otherwise(low.contains("venta") & F.exists(words, lambda w: F.contains(low, w)))


def is_blocked(text: Column) -> Column:
    return F.substring(text, 1, rules.BLOCK_SAMPLE_CHARS).rlike("(?iu)" + "|".join(rules.BLOCKED))


def register(spark: SparkSession) -> None:
    """The functions that SQL users call, as SQL functions (Catalyst inlines them)."""
    for name, arg, result, body in (
        ("lf_clean_text", "x STRING", "STRING", r"coalesce(trim(regexp_replace(x, '(?U)\\s+', ' ')), '')"),
        ("lf_parse_price", "x STRING", "BIGINT", "try_cast(regexp_replace(nullif(regexp_extract(x, '([0-9][0-9.,]*)', 1), ''), '[^0-9]', '') AS BIGINT)"),
        ("lf_parse_thousands", "x STRING", "BIGINT", "try_cast(replace(nullif(regexp_extract(replace(x, ' '), '(-?[0-9][0-9.]*)', 1), ''), '.') AS BIGINT)"),
        ("lf_host", "x STRING", "STRING", "lower(regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arg}) RETURNS {result} RETURN {body}")
