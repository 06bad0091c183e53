"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import vocabulary as V

_NUL = "\u0000"


def collapse_blanks(text: Column) -> Column:
    """Runs of white space, also beyond ASCII, to one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " "))


def normalize_lines(text: Column) -> Column:
    """One kind of line end, one blank for runs of horizontal white space, no blanks at the ends of lines or text."""
    unix = F.regexp_replace(F.regexp_replace(text, r"\r\n|\r|\u2028", "\n"), "\u2029", "\n\n")
    lines = F.transform(F.split(F.regexp_replace(unix, r"[ \t\f\x0B]+", " "), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")


def truncate_middle(text: Column, limit: int) -> Column:
    """A text over the limit keeps two thirds of what the limit leaves from its start, the rest from its end."""
    room = max(0, limit - len(V.OMISSION))
    head = room * 2 // 3
    tail = F.right(text, F.lit(room - head)) if room > head else F.lit("")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(V.OMISSION), tail))


def conversation_key(index: Column, path: Column, conversation_id: Column) -> Column:
    """24 hexadecimal digits that name a conversation by its place in the archive."""
    parts = F.concat_ws(_NUL, F.lit(V.KEY_VERSION), index.cast("string"), path, F.coalesce(conversation_id, F.lit("")))
    return F.substring(F.sha2(parts, 256), 1, 24)


def parent_id(name: Column) -> Column:
    return F.concat(F.lit("domain-"), F.substring(F.sha2(collapse_blanks(F.lower(name)), 256), 1, 12))


def tokens(text: Column) -> Column:
    """Lower-case content-bearing terms, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(V.TOKEN), F.lit(0)), F.lower)
    return F.filter(found, lambda t: ~t.isin(V.STOPWORDS))


def bigrams(terms: Column) -> Column:
    return F.zip_with(F.slice(terms, F.lit(1), F.greatest(F.size(terms) - 1, F.lit(0))), F.slice(terms, F.lit(2), F.greatest(F.size(terms) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("::"), b))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(collapse_blanks(text), V.SENTENCE_END), lambda s: F.substring(F.trim(s), 1, 500))
    return F.filter(parts, lambda s: s != "")


def contains_any(lowered: Column, markers: Sequence[str]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(lowered, F.lit(marker))
    return found


def told(text: Column) -> Column:
    """The sentences of a text with their lower-case forms: settled once where several lists are drawn from them."""
    return F.transform(sentences(text), lambda s: F.struct(s.alias("said"), F.lower(s).alias("lowered")))


def marked(told_sentences: Column, markers: Sequence[str], limit: int = 4) -> Column:
    """The first sentences that contain a marker, of what `told` gives."""
    found = F.slice(F.filter(told_sentences, lambda s: contains_any(s["lowered"], markers)), 1, limit)
    return F.transform(found, lambda s: s["said"])


def first_group(text: Column, groups: Sequence[tuple[str, Sequence[str]]], default: str | None) -> Column:
    """The name of the first group with a marker in the text."""
    lowered, out = F.lower(text), F.lit(default).cast("string")
    for name, markers in reversed(groups):
        out = F.when(contains_any(lowered, markers), F.lit(name)).otherwise(out)
    return out


def conversation_type(text: Column) -> Column:
    return first_group(text, V.CONVERSATION_TYPES, V.DEFAULT_TYPE)


def temporal_role(text: Column) -> Column:
    return first_group(text, V.TEMPORAL_ROLES, None)


def handles(text: Column) -> Column:
    """Names of files and repositories, lower-case, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?U)" + V.HANDLE), F.lit(0)), F.lower)


def title_case(text: Column) -> Column:
    """A capital after everything that is no letter."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")


def label(words: Column, fallback: Column) -> Column:
    """Up to three words as a label."""
    few = F.slice(words, 1, 3)
    return F.when(F.size(few) == 0, fallback).otherwise(F.array_join(F.transform(few, lambda w: title_case(F.replace(w, F.lit("_"), F.lit(" ")))), " · "))


def domain(words: Column) -> Column:
    """The broad domain with the most keywords among the words; ties by name."""
    lowered = F.array_distinct(F.transform(words, F.lower))
    scored = F.array(*(F.struct((-F.size(F.array_intersect(lowered, F.lit(terms)))).alias("n"), F.lit(name).alias("name")) for name, terms in V.DOMAINS))
    best = F.array_min(scored)
    return F.when(best["n"] == 0, F.lit(V.DEFAULT_DOMAIN)).otherwise(best["name"])


def synopsis(text: Column, title: Column, length: int = 360) -> Column:
    compact = collapse_blanks(text)
    cut = F.when(F.length(compact) > length, F.concat(F.rtrim(F.substring(compact, 1, length)), F.lit("…"))).otherwise(compact)
    return F.when(cut == "", F.concat(F.lit("Conversation titled '"), title, F.lit("'."))).otherwise(cut)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`|*_{}\[\]<>()#+\-.!])", r"\\$1")


def escape_pointer(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def redact(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Each pattern's matches replaced, one rule after the other; replacements are literal but for \\1, \\2, ..."""
    import re

    for pattern, replacement in rules:
        safe = re.sub(r"\\(\d)|([\\$])", lambda m: f"${m[1]}" if m[1] else f"\\{m[2]}", replacement)
        text = F.regexp_replace(text, pattern, safe)
    return text


def matching_rules(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Names of the rules whose pattern occurs, in order."""
    return F.array_compact(F.array(*(F.when(text.rlike(pattern.replace("(?i)", "(?iu)")), F.lit(name)) for name, pattern in rules)))


def volume_label(day: Column, mode: str) -> Column:
    """complete, or the year or month of a conversation, or undated."""
    if mode == "complete":
        return F.lit("complete")
    return F.coalesce(F.date_format(day, {"yearly": "yyyy", "monthly": "yyyy-MM"}[mode]), F.lit("undated"))


def approximate_tokens(characters: Column, per_token: int = 4) -> Column:
    return F.floor((characters + (per_token - 1)) / per_token).cast("long")


def estimated_tokens(text: Column) -> Column:
    """Three characters to a token: an estimate on the safe side, without a tokenizer."""
    return approximate_tokens(F.length(text), 3)


def bounded_text(text: Column, most_tokens: int) -> Column:
    """What of a text an embedding request may hold, at three characters to a token."""
    return F.substring(text, 1, 3 * most_tokens)


def display_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMMM d, yyyy"), F.lit("Undated"))


def month_label(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMM yyyy"), F.lit("Undated"))


def date_range(first: Column, last: Column) -> Column:
    """The months from `first` to `last`, as short as they can be; null without dates."""
    end = F.date_format(last, "MMMM yyyy")
    same_year = F.year(first) == F.year(last)
    start = F.when(same_year, F.date_format(first, "MMMM")).otherwise(F.date_format(first, "MMMM yyyy"))
    return F.when(same_year & (F.month(first) == F.month(last)), end).otherwise(F.concat(start, F.lit("–"), end))
