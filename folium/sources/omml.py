"""Office mathematics as LaTeX, with whether everything in it is known."""

from __future__ import annotations

from xml.etree.ElementTree import Element

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
# Signs over a base, large operators, brackets and functions by their LaTeX names.
ACCENTS = {"̂": r"\hat", "̃": r"\tilde", "̅": r"\bar", "̄": r"\bar", "̇": r"\dot", "̈": r"\ddot", "⃗": r"\vec", "́": r"\acute", "̀": r"\grave", "̌": r"\check", "̆": r"\breve"}
LARGE = {"∑": r"\sum", "∏": r"\prod", "∐": r"\coprod", "∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "⋃": r"\bigcup", "⋂": r"\bigcap", "⋁": r"\bigvee", "⋀": r"\bigwedge"}
SIGNS = {"{": r"\{", "}": r"\}", "‖": r"\|", "⟨": r"\langle", "⟩": r"\rangle", "⌊": r"\lfloor", "⌋": r"\rfloor", "⌈": r"\lceil", "⌉": r"\rceil", "": "."}
FUNCTIONS = frozenset("arccos arcsin arctan cos cosh cot coth csc deg det dim exp gcd hom inf ker lg lim ln log max min sec sin sinh sup tan tanh".split())
#: Elements that only hold others, and those that only describe.
PLAIN = frozenset(("oMath", "oMathPara", "e", "num", "den", "deg", "sub", "sup", "lim", "fName", "r", "box", "phant"))
PROPERTIES = frozenset(("rPr", "ctrlPr", "oMathParaPr", "argPr", "fPr", "radPr", "sSubPr", "sSupPr", "sSubSupPr", "sPrePr", "naryPr", "dPr", "accPr", "barPr", "funcPr", "limLowPr", "limUppPr", "mPr", "eqArrPr", "groupChrPr", "borderBoxPr", "boxPr", "phantPr"))


def _name(node: Element) -> str:
    return node.tag.rpartition("}")[2]


def _value(node: Element, *path: str, default: str | None = None) -> str | None:
    for step in path:
        node = node.find(M + step)
        if node is None:
            return default
    return node.get(M + "val", node.get("val", default))


class Latex:
    """Writes one formula; `faithful` falls where an element is not known."""

    def __init__(self) -> None:
        self.faithful = True

    def part(self, node: Element, name: str) -> str:
        found = node.find(M + name)
        return "" if found is None else self.children(found)

    def children(self, node: Element) -> str:
        return "".join(self.write(c) for c in node)

    def write(self, node: Element) -> str:
        name = _name(node)
        if not node.tag.startswith(M):
            if name in ("rPr", "ins", "smartTag"):
                return "" if name == "rPr" else self.children(node)
            self.faithful = False
            return "".join(node.itertext())
        if name == "t":
            return node.text or ""
        if name in PROPERTIES:
            return ""
        if name in PLAIN:
            return self.children(node)
        method = getattr(self, "write_" + name, None)
        if method is None:
            self.faithful = False
            return "".join(node.itertext())
        return method(node)

    def write_f(self, node: Element) -> str:
        top, bottom = self.part(node, "num"), self.part(node, "den")
        kind = _value(node, "fPr", "type")
        return f"{{{top}}}/{{{bottom}}}" if kind in ("lin", "skw") else rf"\binom{{{top}}}{{{bottom}}}" if kind == "noBar" else rf"\frac{{{top}}}{{{bottom}}}"

    def write_rad(self, node: Element) -> str:
        degree = self.part(node, "deg")
        return rf"\sqrt[{degree}]{{{self.part(node, 'e')}}}" if degree else rf"\sqrt{{{self.part(node, 'e')}}}"

    def write_sSub(self, node: Element) -> str:
        return f"{{{self.part(node, 'e')}}}_{{{self.part(node, 'sub')}}}"

    def write_sSup(self, node: Element) -> str:
        return f"{{{self.part(node, 'e')}}}^{{{self.part(node, 'sup')}}}"

    def write_sSubSup(self, node: Element) -> str:
        return f"{{{self.part(node, 'e')}}}_{{{self.part(node, 'sub')}}}^{{{self.part(node, 'sup')}}}"

    def write_sPre(self, node: Element) -> str:
        return f"{{}}_{{{self.part(node, 'sub')}}}^{{{self.part(node, 'sup')}}}{{{self.part(node, 'e')}}}"

    def write_nary(self, node: Element) -> str:
        sign = _value(node, "naryPr", "chr", default="∫")
        if sign not in LARGE:
            self.faithful = False
        low, high = self.part(node, "sub"), self.part(node, "sup")
        return LARGE.get(sign, sign) + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f"{{{self.part(node, 'e')}}}"

    def write_d(self, node: Element) -> str:
        left, right = _value(node, "dPr", "begChr", default="("), _value(node, "dPr", "endChr", default=")")
        between = _value(node, "dPr", "sepChr", default="|")
        inside = between.join(self.children(e) for e in node.findall(M + "e"))
        return rf"\left{SIGNS.get(left, left)}{inside}\right{SIGNS.get(right, right)}"

    def write_acc(self, node: Element) -> str:
        sign = _value(node, "accPr", "chr", default="̂")
        if sign not in ACCENTS:
            self.faithful = False
        return rf"{ACCENTS.get(sign, chr(92) + 'hat')}{{{self.part(node, 'e')}}}"

    def write_bar(self, node: Element) -> str:
        return rf"\{'overline' if _value(node, 'barPr', 'pos') == 'top' else 'underline'}{{{self.part(node, 'e')}}}"

    def write_func(self, node: Element) -> str:
        name = self.part(node, "fName").strip()
        return f"{chr(92) + name if name in FUNCTIONS else name}{{{self.part(node, 'e')}}}"

    def write_limLow(self, node: Element) -> str:
        base = self.part(node, "e").strip()
        return rf"{chr(92) + base if base in FUNCTIONS else base}_{{{self.part(node, 'lim')}}}"

    def write_limUpp(self, node: Element) -> str:
        return rf"\overset{{{self.part(node, 'lim')}}}{{{self.part(node, 'e')}}}"

    def write_m(self, node: Element) -> str:
        rows = [" & ".join(self.children(e) for e in row.findall(M + "e")) for row in node.findall(M + "mr")]
        return r"\begin{matrix}" + r" \\ ".join(rows) + r"\end{matrix}"

    def write_eqArr(self, node: Element) -> str:
        return r"\begin{aligned}" + r" \\ ".join(self.children(e) for e in node.findall(M + "e")) + r"\end{aligned}"

    def write_groupChr(self, node: Element) -> str:
        return rf"\{'overbrace' if _value(node, 'groupChrPr', 'pos') == 'top' else 'underbrace'}{{{self.part(node, 'e')}}}"

    def write_borderBox(self, node: Element) -> str:
        return rf"\boxed{{{self.part(node, 'e')}}}"


def to_latex(node: Element) -> tuple[str, bool]:
    writer = Latex()
    return writer.write(node).strip(), writer.faithful
