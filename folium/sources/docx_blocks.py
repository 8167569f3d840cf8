"""Blocks of Word documents: paragraphs, headings, tables, formulas, images, in the order of the body.

Offsets count code points of a virtual text: all fragments, one separator after each.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

from folium.sources.fragments import Asset, Fragment, Import, script
from folium.sources.omml import M, to_latex

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
V = "{urn:schemas-microsoft-com:vml}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
O = "{urn:schemas-microsoft-com:office:office}"
P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
RASTER = frozenset((".png", ".jpg", ".jpeg", ".webp", ".gif"))
# Greek letters and signs of the Symbol font by their codes.
SYMBOL = dict(zip(range(0x61, 0x7B), "αβχδεφγηιϕκλμνοπθρστυϖωξψζ", strict=True)) | dict(zip(range(0x41, 0x5B), "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ", strict=True))
SYMBOL |= {0x22: "∀", 0x24: "∃", 0x27: "∋", 0x2D: "−", 0x40: "≅", 0x5C: "∴", 0x5E: "⊥", 0xA2: "′", 0xA3: "≤", 0xA5: "∞", 0xAB: "↔", 0xAC: "←", 0xAD: "↑", 0xAE: "→", 0xAF: "↓", 0xB0: "°", 0xB1: "±", 0xB2: "″", 0xB3: "≥", 0xB4: "×", 0xB5: "∝", 0xB6: "∂", 0xB7: "•", 0xB8: "÷", 0xB9: "≠", 0xBA: "≡", 0xBB: "≈", 0xBC: "…", 0xC7: "∩", 0xC8: "∪", 0xCE: "∈", 0xD1: "∇", 0xD5: "∏", 0xD6: "√", 0xE5: "∑", 0xF2: "∫"}
OFF = ("0", "false", "off")
WRAPPERS = frozenset(("ins", "hyperlink", "smartTag", "sdt", "sdtContent", "fldSimple", "bdo", "dir", "customXml", "moveTo", "AlternateContent", "Choice"))


def _name(node: Element) -> str:
    return node.tag.rpartition("}")[2]


def _share(value: str | None) -> int:
    """A share of a side in thousandths of a percent; what is no number counts as none."""
    bare = (value or "").strip()
    return int(bare) if bare.lstrip("+-").isdecimal() else 0


def _on(properties: Element | None, name: str) -> bool:
    found = None if properties is None else properties.find(W + name)
    return found is not None and found.get(W + "val", "1").lower() not in OFF


class _Reader:
    def __init__(self, files: zipfile.ZipFile) -> None:
        self.out, self.at = Import(), 0
        self.body = ElementTree.fromstring(files.read("word/document.xml")).find(W + "body")
        self.headings = {s.get(W + "styleId"): (n.get(W + "val") or "").lower() for s in (ElementTree.fromstring(files.read("word/styles.xml")).iter(W + "style") if "word/styles.xml" in files.namelist() else ()) if (n := s.find(W + "name")) is not None}
        self.paragraph = 0
        self.files, self.related = files, {}
        if "word/_rels/document.xml.rels" in files.namelist():
            for r in ElementTree.fromstring(files.read("word/_rels/document.xml.rels")).iter(P + "Relationship"):
                target = posixpath.normpath(posixpath.join("word", r.get("Target", "")))
                if r.get("TargetMode") != "External" and target.lstrip("/") in files.namelist():
                    self.related[r.get("Id")] = target.lstrip("/")

    def add(self, kind: str, text: str) -> None:
        self.out.fragments.append(Fragment(kind, text, self.at, self.at + len(text), self.paragraph, self.paragraph))
        self.at += len(text) + 1

    def issue(self, kind: str, message: str) -> None:
        n = sum(name.startswith(kind + "-") for name, _ in self.out.issues) + 1
        self.out.issues.append((f"{kind}-{n}", message))

    def symbol(self, node: Element) -> str:
        font, code = node.get(W + "font", ""), int(node.get(W + "char", "0"), 16)
        code -= 0xF000 if 0xF000 <= code <= 0xF0FF else 0
        if font.lower() == "symbol" and code in SYMBOL:
            return SYMBOL[code]
        self.issue("docx-sym", f"Symbol {code:04X} of the font {font} is not known")
        return f"[sym {font} {code:04X}]"

    def formula(self, node: Element) -> str:
        latex, faithful = to_latex(node)
        if not faithful:
            self.issue("docx-omath", f"Formula not fully interpreted: {latex[:280]}")
        return latex

    def run(self, node: Element) -> Iterator[str]:
        properties = node.find(W + "rPr")
        if any(_on(properties, hidden) for hidden in ("vanish", "specVanish", "webHidden")):
            return
        align = None if properties is None else properties.find(W + "vertAlign")
        level = None if align is None else align.get(W + "val")
        for part in node:
            name = _name(part)
            if name == "t":
                text = part.text or ""
                if level in ("superscript", "subscript") and text.strip():
                    sign = "^" if level == "superscript" else "_"
                    yield script(text, level == "superscript") or f"${sign}{{{text}}}$"
                else:
                    yield text
            elif name in ("tab", "br", "cr"):
                yield "\t" if name == "tab" else "\n"
            elif name == "noBreakHyphen":
                yield "‑"
            elif name == "sym":
                yield self.symbol(part)
            elif name in ("drawing", "pict", "object"):
                self.figures(part, name)

    def figures(self, node: Element, name: str) -> None:
        """Notes the images of a drawing, or an embedded object with its preview, for when the paragraph is done."""
        if name == "object" or next(node.iter(O + "OLEObject"), None) is not None:
            self.objects.append(node)
            return
        parents = {child: parent for parent in node.iter() for child in parent}
        for image in [*node.iter(A + "blip"), *node.iter(V + "imagedata")]:
            key = image.get(R + "embed") or image.get(R + "id")
            if key and key not in [k for k, _ in self.images]:
                cut = None if image not in parents else parents[image].find(A + "srcRect")
                self.images.append((key, None if cut is None else tuple(_share(cut.get(side)) for side in "ltrb")))

    def show(self) -> None:
        """Figures of the images and objects that a paragraph or table holds."""
        for key, crop in self.images:
            path = self.related.get(key)
            if path is None:
                self.issue("docx-image", "Word drawing/image not embedded (missing relationship)")
                continue
            self.add("figure", "[image]")
            suffix = posixpath.splitext(path)[1].lower()
            n = len(self.out.fragments)
            self.out.assets.append(Asset(n, f"image-b{n:05d}{suffix if suffix in RASTER else '.png'}", self.files.read(path), crop if crop and any(crop) else None))
            if crop and any(crop):
                sides = " ".join(f"{side}={share}" for side, share in zip("ltrb", crop, strict=True))
                self.issue("docx-crop", f'Word drawing a:srcRect crop {sides} on relationship "{key}" was not applied; original image saved')
        for node in self.objects:
            self.object(node)

    def object(self, node: Element) -> None:
        held, shown = next(node.iter(O + "OLEObject"), None), next(node.iter(V + "imagedata"), None)
        made_by = None if held is None else held.get("ProgID")
        keys = [None if x is None else x.get(R + "id") for x in (held, shown)]
        paths = [self.related.get(key) for key in keys]
        self.add("figure", f"[OLE {made_by or 'object'}]" + (f" preview {paths[1]}" if paths[1] else ""))
        n = len(self.out.fragments)
        notes = [f'Word OLE object ProgID="{made_by or "?"}"', f'relationship "{keys[0] or "?"}"' + (f" → {paths[0]}" if paths[0] else ""), f'VML preview relationship "{keys[1] or "?"}" ' + (f"→ {paths[1]}" if paths[1] else "(missing)")]
        if paths[1]:
            suffix = posixpath.splitext(paths[1])[1].lower() or ".bin"
            name = f"image-b{n:05d}{suffix}"
            self.out.assets.append(Asset(n, name, self.files.read(paths[1])))
            notes.append(f"raster extracted as {name}" if suffix in RASTER else f"preview retained as {name}")
        else:
            notes.append("preview not extracted")
        self.issue("docx-ole", "; ".join(notes))

    def inline(self, node: Element) -> Iterator[str]:
        for part in node:
            name = _name(part)
            if part.tag == W + "r":
                yield from self.run(part)
            elif part.tag == M + "oMath":
                yield f"${self.formula(part)}$"
            elif part.tag == M + "oMathPara":
                yield f"$${' '.join(self.formula(f) for f in part.findall(M + 'oMath'))}$$"
            elif name in WRAPPERS:
                yield from self.inline(part)

    def text(self, node: Element) -> str:
        return "".join(self.inline(node))

    def block(self, node: Element) -> None:
        self.images: list[tuple] = []
        self.objects: list[Element] = []
        if node.tag == W + "p":
            text = self.text(node).strip("\n")
            style = node.find(f"{W}pPr/{W}pStyle")
            style = "" if style is None else self.headings.get(style.get(W + "val"), (style.get(W + "val") or "").lower())
            bare = text.strip()
            kind = "heading" if style.startswith(("heading", "title")) else "caption" if style == "caption" else "formula" if bare.startswith("$$") and bare.endswith("$$") and len(bare) > 4 else "paragraph"
            if bare:
                self.add(kind, text)
            self.paragraph += 1
        elif node.tag == W + "tbl":
            rows = []
            for row in node.iter(W + "tr"):
                rows.append(" | ".join("\n".join(self.text(p) for p in cell.iter(W + "p")).strip().replace("\n", " ") for cell in row.findall(W + "tc")))
            if any(r.strip(" |") for r in rows):
                self.add("table", "\n".join(rows))
        elif _name(node) in WRAPPERS:
            for part in node:
                self.block(part)
            return
        self.show()


def read_docx(raw: bytes) -> Import:
    with zipfile.ZipFile(io.BytesIO(raw)) as files:
        reader = _Reader(files)
        for node in reader.body if reader.body is not None else ():
            reader.block(node)
    return reader.out
