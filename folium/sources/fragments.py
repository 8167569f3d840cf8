"""What importers of all formats share: a fragment, an issue, and places in the source."""

from __future__ import annotations

from dataclasses import dataclass, field

# Letters that have a raised or a lowered form in Unicode.
RAISED = dict(zip("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", strict=True))
LOWERED = dict(zip("0123456789+-=()aeoxhklmnpst", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜ", strict=True))


@dataclass
class Fragment:
    kind: str
    text: str
    start: int
    end: int
    line_start: int
    line_end: int


@dataclass
class Asset:
    """An image that a fragment shows: the fragment's number from 1, a name, the bytes, and the shares that the document cuts off."""

    fragment: int
    name: str
    content: bytes
    crop: tuple[int, int, int, int] | None = None


@dataclass
class Import:
    """Fragments of one document in reading order, the images that it holds, and what could not be taken over."""

    fragments: list[Fragment] = field(default_factory=list)
    issues: list[tuple[str, str]] = field(default_factory=list)
    assets: list[Asset] = field(default_factory=list)
    #: Number of a fragment, from 1, and where the image that it shows is said to be.
    links: list[tuple[int, str]] = field(default_factory=list)


class Places:
    """Finds fragments in a source: forwards from the last one, else anywhere, else at the last one."""

    def __init__(self, source: str, moves_when_lost: bool = False) -> None:
        self.source, self.at, self.moves_when_lost = source, 0, moves_when_lost

    def line(self, offset: int) -> int:
        return self.source.count("\n", 0, offset) + 1

    def span(self, start: int, end: int) -> tuple[int, int, int, int]:
        return start, end, self.line(start), self.line(end)

    def find(self, text: str) -> tuple[int, int, int, int]:
        bare = text.strip()
        if not bare:
            return self.span(self.at, self.at)
        start = self.source.find(bare, self.at)
        start = self.source.find(bare) if start < 0 else start
        if start < 0:
            end = min(self.at + len(bare), len(self.source))
            found = self.span(min(self.at, len(self.source)), end)
            self.at = end if self.moves_when_lost else self.at
            return found
        self.at = start + len(bare)
        return self.span(start, self.at)


def script(text: str, raised: bool) -> str | None:
    """Text in raised or lowered letters, if all of them have such a form."""
    forms = RAISED if raised else LOWERED
    return "".join(forms[c] for c in text) if text and all(c in forms for c in text) else None
