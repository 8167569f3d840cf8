"""Half-open code point spans: validity, coverage, notes and edits as column expressions, fragment location in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cover_error(text: Column, spans: Column) -> Column:
    """The first fault of sorted spans over a text: out of range, overlap, uncovered; null if they cover all that is not blank."""
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("error"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substr(text, state["at"] + 1, span["s"] - state["at"])
        fault = (
            F.when(state["error"].isNotNull(), state["error"])
            .when((span["s"] < 0) | (span["e"] > F.length(text)) | (span["s"] >= span["e"]), "out of range")
            .when(span["s"] < state["at"], "overlap")
            .when(gap.rlike(r"(?U)\S"), "uncovered")
        )
        return F.struct(F.greatest(state["at"], span["e"]).alias("at"), fault.alias("error"))

    last = F.aggregate(F.array_sort(spans), start, step)
    rest = F.substr(text, last["at"] + 1, F.length(text))
    return F.coalesce(last["error"], F.when(rest.rlike(r"(?U)\S"), "uncovered"))


def first_fault(text: str, spans: list[tuple[int, int]]) -> str | None:
    """cover_error for one text, in time proportional to its length however many spans there are."""
    at = 0
    for start, end in sorted(spans):
        if start < 0 or end > len(text) or start >= end:
            return "out of range"
        if start < at:
            return "overlap"
        if text[at:start].strip():
            return "uncovered"
        at = end
    return "uncovered" if text[at:].strip() else None


def spans_valid(text: Column, spans: Column) -> Column:
    return cover_error(text, spans).isNull()


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def note_status(text: Column, start: Column, end: Column, quote: Column) -> Column:
    return F.when(F.coalesce(slice_text(text, start, end) == quote, F.lit(False)), "attached").otherwise("orphaned")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)


def shift_spans(spans: Column, edit_start: Column, edit_end: Column, new_length: Column) -> Column:
    """Spans after the text in [edit_start, edit_end) got another length: later spans move, the edited one ends where the new text does."""
    delta = new_length - (edit_end - edit_start)

    def move(span: Column) -> Column:
        start = F.when(span["s"] >= edit_end, span["s"] + delta).otherwise(span["s"])
        end = F.when(span["e"] >= edit_end, span["e"] + delta).otherwise(span["e"])
        return F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"))

    return F.transform(spans, move)


class FragmentError(ValueError):
    pass


def positions(text: str, needle: str) -> list[int]:
    """Starts of all occurrences, overlapping ones too."""
    found, at = [], text.find(needle) if needle else -1
    while at >= 0:
        found.append(at)
        at = text.find(needle, at + 1)
    return found


def locate(text: str, needle: str, used: list[tuple[int, int]], occurrence: int | None = None, anchor: str | None = None) -> tuple[int, int]:
    """Span of a fragment: the n-th occurrence, or the first free one, within an anchor if there is one; it is added to used."""
    if occurrence is not None and (isinstance(occurrence, bool) or not isinstance(occurrence, int) or occurrence < 1):
        raise FragmentError("occurrence must be a positive number")
    found = [(p, p + len(needle)) for p in positions(text, needle)]
    if anchor:
        if needle not in anchor:
            raise FragmentError("anchor must contain fragment")
        holders = [(p, p + len(anchor)) for p in positions(text, anchor)]
        found = [f for f in found if any(a <= f[0] and f[1] <= b for a, b in holders)]

    def is_free(span: tuple[int, int]) -> bool:
        return all(span[1] <= a or b <= span[0] for a, b in used)

    if occurrence is None:
        span = next((f for f in found if is_free(f)), None)
        if span is None:
            raise FragmentError("fragment already used" if found else "fragment not found")
    else:
        if occurrence > len(found):
            raise FragmentError("fragment not found")
        span = found[occurrence - 1]
        if not is_free(span):
            raise FragmentError("fragment already used")
    used.append(span)
    return span


def fragments_of(group: object) -> list[tuple[str, int | None, str | None]]:
    """(text, occurrence, anchor) of a group's fragments: one of them or a list, each a text or a mapping that holds it."""
    listed = [group] if isinstance(group, (str, dict)) else group
    if not isinstance(listed, list) or not listed:
        raise FragmentError("fragment not found")
    out = []
    for fragment in listed:
        held = fragment if isinstance(fragment, dict) else {"text": fragment}
        needle, anchor = held.get("text"), held.get("anchor")
        if not isinstance(needle, str) or not needle:
            raise FragmentError("fragment not found")
        if anchor is not None and (not isinstance(anchor, str) or needle not in anchor):
            raise FragmentError("anchor must contain fragment")
        out.append((needle, held.get("occurrence"), anchor))
    return out


def locate_groups(text: str, groups: list) -> list[list[tuple[int, int]]]:
    """Spans of the fragments of each group in turn, each first-free unless it names its occurrence."""
    used: list[tuple[int, int]] = []
    return [[locate(text, needle, used, occurrence, anchor) for needle, occurrence, anchor in fragments_of(group)] for group in groups]
