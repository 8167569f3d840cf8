"""Predicates and measures of text as column expressions, and the few that need Python's Unicode tables."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headings by name, abbreviations that do not end a sentence, patterns of the four compared classes.
NAMED_HEADINGS = ("abstract", "references", "acknowledgments", "acknowledgements", "appendix")
ABBREVIATION_END = r"(?i)(et al|e\.g|i\.e|vs|fig|dr|mr|mrs|prof|al)\.$"
NUMBERED_HEADING = r"^\d+(\.\d+)*\.?\s+[A-Z]"
CAPTION = r"(?i)^(figure|table|fig\.?)\s+\d+\s*[:.]"
FOOTNOTE_MARK = "^[∗*†‡§¶‖]+\\s*\\S"
NUMBERS = r"(?U)(?<!\w)[−-]?\d+(?:[.,]\d+)*(?:[eE][+−-]?\d+)?"
UNITS = r"(?<![A-Za-z])(?:MPa|kPa|Pa|kW|MW|W|kg|mg|mm|cm|km|mL|m/s|Hz|GHz|MHz|K|°C|%)(?![A-Za-z])"
FORMULAS = r"\$\$[\s\S]*?\$\$|(?<!\$)\$[^$\n]+\$|\{\{formula:[^}]+\}\}"
CITATIONS = r"(?U)\[\d+(?:\s*[-–,]\s*\d+)*\]"
# Categories that may be resolved in a batch, words that say nothing, words that point at evidence.
BATCH_CATEGORIES = ("docx-crop", "docx-image", "docx-ole", "docx-omath", "image", "tex-env", "tex-includegraphics", "tex-input", "tex-unclosed")
SINGLE_CATEGORIES = ("docx-sym", "page")
FILLER_WORDS = ("ignore", "skip", "na", "ok", "done", "resolved", "limitation", "limitations", "known")
FILLER_PHRASES = ("known limitation", "known-limitation", "n/a", "已知限制", "忽略", "跳过")
EVIDENCE_WORDS = ("sample", "checked", "inspected", "confirmed", "source", "file", "missing", "remote", "not embedded", "single-file", "no compile", "核对", "确认", "源", "缺")
LEAST_EXPLANATION = 24


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def normal(text: Column) -> Column:
    """Collapsed and lower-cased, for comparing lines."""
    return F.lower(collapse(F.coalesce(text, F.lit(""))))


def n_words(text: Column) -> Column:
    collapsed = collapse(text)
    return F.when(collapsed == "", 0).otherwise(F.size(F.split(collapsed, " ")))


def ends_sentence(text: Column) -> Column:
    end = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+$", "")
    return end.rlike(r"[.?!]$") & ~end.rlike(ABBREVIATION_END) & ~end.rlike(r"(?U)\b[A-Z]\.$")


def is_caption(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))).rlike(CAPTION)


def is_heading(text: Column) -> Column:
    line = strip(F.coalesce(text, F.lit("")))
    numbered = line.rlike(NUMBERED_HEADING) & ~line.rlike(CAPTION) & (n_words(line) <= 14)
    return (F.length(line) > 0) & (F.length(line) <= 90) & (normal(line).isin(*NAMED_HEADINGS) | numbered)


def starts_footnote(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+", "").rlike(FOOTNOTE_MARK)


def heading_level(text: Column) -> Column:
    """By leading signs, else by the depth of its number up to 6, else 2."""
    signs = F.length(F.regexp_extract(text, r"^(#{1,6})\s", 1))
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)", 1)
    return F.when(signs > 0, signs).when(number != "", F.least(F.size(F.split(number, r"\.")) + 1, F.lit(6))).otherwise(2)


def line_kind(text: Column) -> Column:
    """The kind of a block that is one line of a document."""
    line = strip(F.coalesce(text, F.lit("")))
    pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    return (
        F.when(is_caption(line), "caption")
        .when(is_heading(line) | line.rlike(r"^#{1,6}\s"), "heading")
        .when(line.rlike(r"^\$\$.+\$\$$"), "formula")
        .when(pipes >= 2, "table")
        .when(starts_footnote(line), "footnote")
        .when(line == "", "unclassified")
        .otherwise("paragraph")
    )


def multiset(text: Column, pattern: str) -> Column:
    """All matches of a pattern, sorted: equal arrays are equal multisets."""
    return F.array_sort(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0))


def differences(source: Column, target: Column) -> Column:
    """Names of the classes whose multisets differ between a text and its translation."""
    classes = [("numbers", NUMBERS), ("units", UNITS), ("formulas", FORMULAS), ("citations", CITATIONS)]
    found = [F.when(~multiset(source, p).eqNullSafe(multiset(target, p)), F.lit(name)) for name, p in classes]
    return F.when(target.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*found)))


def issue_prefix(issue_id: Column, kind: Column | None = None) -> Column:
    """The category of an issue: its type, or its id without the number at the end."""
    bare = F.regexp_replace(F.coalesce(issue_id, F.lit("issue")), r"-(?:\d+|[ab]\d+)$", "")
    bare = F.when(bare == "", issue_id).otherwise(bare)
    return bare if kind is None else F.coalesce(F.nullif(strip(kind), F.lit("")), bare)


def shorten(text: Column, limit: int = 120) -> Column:
    whole = collapse(text)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, limit), r"(?U)\s+$", ""), F.lit("…")))


def is_filler(text: Column) -> Column:
    """Whether fewer than 8 letters are left when phrases and words that say nothing are gone."""
    left = F.lower(strip(text))
    for phrase in FILLER_PHRASES:
        left = F.replace(left, F.lit(phrase), F.lit(" "))
    words = F.filter(F.regexp_extract_all(left, F.lit("[a-z0-9]+"), 0), lambda w: ~w.isin(*FILLER_WORDS))
    han = F.regexp_replace(left, "[^一-鿿]", "")
    return F.length(F.array_join(words, "")) + F.length(han) < 8


def has_evidence(text: Column) -> Column:
    low = F.lower(text)
    hint = F.lit(False)
    for word in EVIDENCE_WORDS:
        hint = hint | low.contains(word)
    return low.rlike(r"(?U)\d") | hint


def explanation_error(text: Column, evidence: bool = False) -> Column:
    """Why an explanation of a limitation is refused; null if it is not."""
    bare = strip(text)
    out = F.when(text.isNull(), "missing").when(F.length(bare) < LEAST_EXPLANATION, "too short").when(is_filler(bare), "too weak")
    return out.when(~has_evidence(bare), "no evidence") if evidence else out


def category_error(category: Column) -> Column:
    name = strip(category)
    return F.when(category.isNull() | (name == ""), "missing").when(name.isin(*SINGLE_CATEGORIES), "only by id").when(~name.isin(*BATCH_CATEGORIES), "unknown")


def needs_translation(kind: Column, translated: Column) -> Column:
    from folium.schema import VERBATIM

    return ~kind.isin(*VERBATIM) & ((kind != "reference") | translated)


def has_formula_markup(text: Column) -> Column:
    """Whether some display or inline formula has a body that is not blank."""
    display = F.regexp_extract_all(text, F.lit(r"(?<!\\)\$\$([\s\S]+?)\$\$"), 1)
    inline = F.regexp_extract_all(text, F.lit(r"(?<![\\$])\$([^\n$]+?)\$(?!\$)"), 1)
    return F.exists(F.concat(display, inline), lambda b: b.rlike(r"(?U)\S"))


def is_math_only(text: Column) -> Column:
    """Whether a text is formulas and blanks only."""
    bare = strip(F.coalesce(text, F.lit("")))
    return (bare != "") & bare.rlike(r"^(?U)(?:\$\$[\s\S]*?\$\$|\$[^$]+\$|\s)+$") & ~bare.endswith("\n")


def wrap_math(latex: Column, display: Column) -> Column:
    """A formula between dollar signs, on one line; empty if there is none."""
    body = collapse(F.replace(F.coalesce(latex, F.lit("")), F.lit("$"), F.lit("")))
    sign = F.when(display, "$$").otherwise("$")
    return F.when(body == "", "").otherwise(F.concat(sign, body, sign))


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"(?U)\S")))


def rows_preserved(source: Column, target: Column) -> Column:
    """A table of several rows may not become one line."""
    return ~((nonblank_lines(source) > 1) & (nonblank_lines(target) <= 1))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """NFKC, case-folded, letters and digits only: equal if no wording changed."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum()))


def term_normal(text: Column) -> Column:
    """Lower-cased, with every run of other characters than letters and digits as one space. Give it nfkc(text) where that may matter."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def term_aliases(term: Column) -> Column:
    """A term and its aliases: a slash with a space at either side separates them."""
    return F.filter(F.transform(F.concat(F.array(term), F.split(term, r"\s+/\s*|\s*/\s+")), term_normal), lambda a: a != "")


def term_matches(text: Column, term: Column) -> Column:
    hay = F.concat(F.lit(" "), term_normal(text), F.lit(" "))
    return F.exists(term_aliases(term), lambda a: hay.contains(F.concat(F.lit(" "), a, F.lit(" "))))
