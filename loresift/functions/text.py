"""Text functions as Column expressions: tokens, stems, slugs, identifier shapes and condensed sections.

Every function has a DuckDB twin (``sql_...``) that the oracles are put together from.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal in a query or a text.
STOP_WORDS = tuple(
    """
    a an and are as at be but by for from has have had he her him his i if in into is it its me my no not of on or so
    she than that the their them then there these they this those to us was we were will with you your yours
    how what when where which who whom whose why do does did doing done
    use uses used using make makes made making work works worked working get gets got getting
    see sees seen saw go goes went going can could should would may might must
    about any some all more most much many very just also too now only still
    """.split()
)

# Words about the activity or its wrapping, not about the code it is done to.
META_WORDS = tuple(
    """
    review reviewing check checking refactor refactoring investigate investigating debug debugging fix fixing
    look looking understand understanding audit auditing examine examining explore exploring inspect inspecting
    read reading learn learning analyze analyzing help helping implement implementing
    pull request pr prs code codebase repo repository changes diff issue issues bug bugs problem problems
    task tasks thing things stuff part parts way feature features
    new old existing current latest recent
    """.split()
)

SPLIT = "[^\\p{L}\\p{N}]+"
#: Punctuation that is cut off the ends of a query word before it is judged.
EDGES = ",.;:!?()[]{}\"'"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def stem(t: Column) -> Column:
    """Conservative suffix folding; words of under four letters stay."""
    n = F.length(t)

    def cut(k: int) -> Column:
        return F.substring(t, F.lit(1), n - k)

    def undouble(s: Column) -> Column:
        last, before = F.right(s, F.lit(1)), F.substring(s, F.length(s) - 1, F.lit(1))
        double = (F.length(s) >= 3) & (last == before) & ~last.isin("a", "e", "i", "o", "u")
        return F.when(double, F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)

    sibilant = F.substring(t, n - 2, F.lit(1)).isin("s", "x", "z")
    spared = t.endswith("ss") | t.endswith("us") | t.endswith("is") | t.endswith("os")
    return (
        F.when(n < 4, t)
        .when(t.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("es") & (n > 4) & sibilant, cut(2))
        .when(t.endswith("s") & ~spared, cut(1))
        .when(t.endswith("ing") & (n > 5), undouble(cut(3)))
        .when(t.endswith("ed") & (n > 4), undouble(cut(2)))
        .otherwise(t)
    )


def sql_stem(t: str) -> str:
    def undouble(k: int) -> str:
        s = f"{t}[:-{k + 1}]"
        return f"(case when length({s}) >= 3 and {s}[-1] = {s}[-2] and {s}[-1] not in ('a', 'e', 'i', 'o', 'u') then {s}[:-2] else {s} end)"

    return (
        f"(case when length({t}) < 4 then {t} when suffix({t}, 'ies') and length({t}) > 4 then {t}[:-4] || 'y' "
        f"when suffix({t}, 'es') and length({t}) > 4 and {t}[-3] in ('s', 'x', 'z') then {t}[:-3] "
        f"when suffix({t}, 's') and not (suffix({t}, 'ss') or suffix({t}, 'us') or suffix({t}, 'is') or suffix({t}, 'os')) then {t}[:-2] "
        f"when suffix({t}, 'ing') and length({t}) > 5 then {undouble(3)} "
        f"when suffix({t}, 'ed') and length({t}) > 4 then {undouble(2)} else {t} end)"
    )


def raw_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits without stop words, not stemmed yet; null gives none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT)
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def tokens(text: Column) -> Column:
    """Stemmed tokens in order; stop words are dropped before stemming."""
    return F.transform(raw_tokens(text), stem)


def sql_tokens(text: str) -> str:
    kept = f"list_filter(string_split_regex(lower(coalesce({text}, '')), '{SPLIT}'), lambda t: t <> '' and t not in ({quoted(STOP_WORDS)}))"
    return f"list_transform({kept}, lambda t: {sql_stem('t')})"


def identifier_shape(t: Column) -> Column:
    """Looks like a code identifier: a joined name or path, an acronym, letters with digits, or camel case."""
    joined = t.rlike("[_./-]")
    acronym = (F.length(t) >= 2) & t.rlike("\\p{Lu}") & ~t.rlike("\\p{Ll}")
    mixed = t.rlike("\\p{N}") & t.rlike("\\p{L}")
    camel = t.rlike("^\\p{Lu}(.*\\p{Ll}.*\\p{Lu}|.*\\p{Lu}.*\\p{Ll})")
    return joined | acronym | mixed | camel


def sql_identifier_shape(t: str) -> str:
    m = lambda p: f"regexp_matches({t}, '{p}')"
    return "(" + m("[_./-]") + f" or (length({t}) >= 2 and " + m("\\p{Lu}") + " and not " + m("\\p{Ll}") + ") or (" + m("\\p{N}") + " and " + m("\\p{L}") + ") or " + m("^\\p{Lu}(.*\\p{Ll}.*\\p{Lu}|.*\\p{Lu}.*\\p{Ll})") + ")"


def slug(s: Column) -> Column:
    """URL-safe form of a heading: ASCII letters, digits and single hyphens between words."""
    s = F.regexp_replace(F.lower(F.trim(s)), "[*_`\\[\\]()]", "")
    s = F.regexp_replace(F.regexp_replace(s, "[\\s/]+", "-"), "[^a-z0-9-]+", "")
    return F.regexp_replace(s, "^-+|-+$", "")


def sql_slug(s: str) -> str:
    one = f"regexp_replace(lower(trim({s})), '[*_`\\[\\]()]', '', 'g')"
    two = f"regexp_replace(regexp_replace({one}, '[\\s/]+', '-', 'g'), '[^a-z0-9-]+', '', 'g')"
    return f"regexp_replace({two}, '^-+|-+$', '', 'g')"


def truncated(s: Column, limit: int, mark: str = "\n\n[...truncated...]") -> Column:
    """At most ``limit`` characters, without trailing white space, and a mark where something was cut."""
    return F.when(F.length(s) > limit, F.concat(F.regexp_replace(F.substring(s, 1, limit), "\\s+$", ""), F.lit(mark))).otherwise(s)


_SECTION = "^Section \"([^\"]+)\" of `([^`]+)`\\.\\s*(?:Subsections:[^.]*\\.\\s*)?"


def condensed(s: Column, limit: int = 280) -> Column:
    """A section entry as one line: its title and path, and at most ``limit`` characters of its body; others unchanged."""
    title, path = F.regexp_extract(s, _SECTION, 1), F.regexp_extract(s, _SECTION, 2)
    body = F.regexp_replace(F.regexp_replace(s, _SECTION, ""), "^\\s*#{2,3}\\s+[^\n]+\n+", "")
    body = F.regexp_replace(body, "^\\s+|\\s+$", "")
    body = F.when(F.length(body) > limit, F.concat(F.regexp_replace(F.substring(body, 1, limit), "\\s+$", ""), F.lit(" […]"))).otherwise(body)
    body = F.trim(F.regexp_replace(body, "\\s+", " "))
    head = F.concat(F.lit('Section "'), title, F.lit('" of `'), path)
    return F.when(title == "", s).when(body == "", F.concat(head, F.lit("`."))).otherwise(F.concat(head, F.lit("` — "), body))


def sql_condensed(s: str, limit: int = 280) -> str:
    body = f"regexp_replace(regexp_replace(regexp_replace({s}, '{_SECTION}', ''), '^\\s*#{{2,3}}\\s+[^\n]+\n+', ''), '^\\s+|\\s+$', '', 'g')"
    cut = f"(case when length({body}) > {limit} then regexp_replace({body}[:{limit}], '\\s+$', '') || ' […]' else {body} end)"
    one = f"trim(regexp_replace({cut}, '\\s+', ' ', 'g'))"
    title, path = f"regexp_extract({s}, '{_SECTION}', 1)", f"regexp_extract({s}, '{_SECTION}', 2)"
    head = f"('Section \"' || {title} || '\" of `' || {path})"
    return f"(case when {title} = '' then {s} when {one} = '' then {head} || '`.' else {head} || '` — ' || {one} end)"


def word_set(text: Column) -> Column:
    """Distinct lower-cased tokens of over two letters, for set similarity; neither stop words nor stems."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda t: F.length(t) > 2))


def sql_word_set(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(coalesce({text}, '')), '{SPLIT}'), lambda t: length(t) > 2))"
