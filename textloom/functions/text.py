"""Text columns: normalising, tokens, query rewriting, snippets, prompt contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for search; a parameter of everything that takes tokens.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
TOKEN = r"\p{L}+"


def normalised(title: Column, text: Column, replacements: Sequence[tuple[str, str]] = (), limit: int | None = None) -> Column:
    """Title and text as one lower-case string with spellings replaced; ``limit`` cuts it to so many characters."""
    out = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    for old, new in replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.substring(out, 1, limit) if limit else out


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case runs of letters that are no stop words; null gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    stops = F.array(*map(F.lit, stop_words)) if stop_words else None
    return found if stops is None else F.filter(found, lambda t: ~F.array_contains(stops, t))


def rewritten_query(query: Column, term: str, spellings: Sequence[str] = ()) -> Column:
    """Trimmed lower-case query that surely has ``term``: its other ``spellings`` are replaced, else it is appended."""
    out = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    if not term:
        return out
    every = [*spellings, term]
    known = F.lit(False)
    for s in every:
        known = known | out.contains(s)
    out = F.when(known, out).otherwise(F.concat(out, F.lit(f" {term}")))
    for s in spellings:
        out = F.replace(out, F.lit(s), F.lit(term))
    return F.trim(out)


def snippet(text: Column, size: int = 200, empty: str = "No content available") -> Column:
    """The first ``size`` characters, with dots if there are more."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(empty))
        .when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("...")))
        .otherwise(text)
    )


def looks_english(text: Column) -> Column:
    """Whether common English words and commas are more than a hundredth of the words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.lit(0)
    for mark in (" the ", " and ", " of ", " to ", " in "):
        hits = hits + ((F.length(low) - F.length(F.replace(low, F.lit(mark), F.lit("")))) / len(mark)).cast("int")
    words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    return hits > words / 100


def prompt_context(windows: Column, most: int = 10, size: int = 4000) -> Column:
    """Numbered text windows for a prompt, the first ``most`` of an array, each cut to ``size`` characters."""
    parts = F.transform(F.slice(windows, 1, most), lambda w, i: F.concat(F.lit("Text Window "), (i + 1).cast("string"), F.lit(":\n"), F.substring(w, 1, size)))
    return F.array_join(parts, "\n\n")


def without_reasoning(answer: Column) -> Column:
    """A model's answer without what stands before its closing reasoning mark, trimmed."""
    return F.trim(F.regexp_replace(answer, r"(?s)^.*?</think>", ""))


def markdown_html(text: Column) -> Column:
    """Headings, bold, list items, paragraphs and line breaks as HTML."""
    out = F.regexp_replace(text, r"(?m)^### (.*)$", "<h3>$1</h3>")
    out = F.regexp_replace(out, r"\*\*(.*?)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"(?m)^- (.*)$", "<li>$1</li>")
    out = F.regexp_replace(out, r"\n\n", "</p><p>")
    return F.regexp_replace(out, r"\n", "<br>")


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur as whole words, a plural s allowed, in any letter case."""
    return lower_term_hits(F.lower(F.coalesce(text, F.lit(""))), terms)


def lower_term_hits(low: Column, terms: Sequence[str]) -> Column:
    """The same of a lower-case text."""
    hits = F.lit(0)
    for t in (t.lower() for t in terms):
        # A plain search rules most terms out before the pattern is tried.
        whole = low.contains(t) & low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){_escaped(t)}s?(?![\p{{L}}\p{{N}}_])")
        hits = hits + whole.cast("int")
    return hits


def _escaped(term: str) -> str:
    return "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}-" else c for c in term)
