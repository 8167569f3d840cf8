"""Importers by small files, and a folder of them as a batch and as a stream."""

import io
import zipfile

from folium.sources import files
from folium.sources.docx_blocks import read_docx
from folium.sources.html_blocks import read_html
from folium.sources.markdown_blocks import read_markdown
from folium.sources.plain import fragments
from folium.sources.tex_blocks import read_tex, strip_comments
from folium.streaming import ingest


def kinds(found):
    return [(f.kind, f.text) for f in found.fragments]


def test_plain_text():
    found = list(fragments("First paragraph.\n\nSecond paragraph has more text.\n\n\nThird.\n"))
    assert [f[0] for f in found] == ["First paragraph.", "Second paragraph has more text.", "Third."]
    assert [f[1:] for f in found] == [(0, 16, 1, 1), (18, 49, 3, 3), (52, 58, 6, 6)]
    assert [f[0] for f in fragments("  a \r\n\n \n b", "paragraph")] == ["  a ", " b"]


def test_html():
    page = '<html><head><style>x{}</style></head><body><h1>Title</h1><p>One <b>two</b><br>x<sup>2</sup></p><img src="https://e.org/a.png" alt="far"><pre>a\n  b</pre><table><tr><th>a</th><td>b</td></tr><tr><td>1</td><td>2</td></tr></table><div><ul><li>item</li></ul>tail</div><script>no()</script></body></html>'
    found = read_html(page)
    assert kinds(found) == [("heading", "Title"), ("paragraph", "One two x²"), ("figure", "far"), ("code", "a\n  b"), ("table", "a | b\n1 | 2"), ("paragraph", "item tail")]
    assert found.issues == [("image-b00003", "Image https://e.org/a.png is not in the source folder")]


def test_html_never_closed():
    assert kinds(read_html("<body><p>a<p>b</body>")) == [("paragraph", "a b")]
    assert kinds(read_html("<div><li><p>x</p></li></div>")) == [("paragraph", "x")]
    assert kinds(read_html('<math alttext="x^2" display="block"></math>')) == [("paragraph", "$$x^2$$")]


def test_markdown():
    source = "# Test\n\nA is 5 kW.\nB is safe.\n\n```\n# code\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n$$x=1$$\n\nTitle\n===\n\n- one\n- two\n\n[ref]: http://e.org\n"
    found = read_markdown(source)
    assert [k for k, _ in kinds(found)] == ["heading", "paragraph", "code", "table", "formula", "heading", "paragraph", "unclassified"]
    assert all(source[f.start : f.end].rstrip("\n") == f.text for f in found.fragments)
    assert read_markdown("![a](http://e.org/a.png)").issues


def test_tex():
    source = r"""\documentclass{article} % a comment
\title{A \textbf{bold} title}
\author{A. Author\inst{1} \and B. Other}
\begin{document}
\section*{Intro}
Costs 5\% of \emph{all}. % gone

\begin{equation} x = 1 \end{equation}
\begin{figure}\includegraphics[width=1cm]{a.png}\caption{A caption}\end{figure}
\begin{verbatim}
% stays
\end{verbatim}
\input{other}
\begin{odd}raw\end{odd}
\section{Never closed
Last words.
\end{document}"""
    found = read_tex(source)
    assert kinds(found) == [("heading", "A bold title"), ("paragraph", "A. Author B. Other"), ("heading", "Intro"), ("paragraph", r"Costs 5\% of all."), ("formula", "x = 1"), ("caption", "A caption"), ("code", "% stays"), ("paragraph", "raw"), ("heading", "Never closed"), ("paragraph", "Last words.")]
    assert [i.rsplit("-", 1)[0] for i, _ in found.issues] == ["tex-includegraphics", "tex-input", "tex-env", "tex-unclosed"]
    assert strip_comments(r"a\%b % c") == r"a\%b "


def docx(body):
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {names}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {names}><w:style w:styleId="T1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_docx():
    run = "<w:r><w:t>{}</w:t></w:r>"
    body = '<w:p><w:pPr><w:pStyle w:val="T1"/></w:pPr>' + run.format("Head") + "</w:p>"
    body += "<w:p>" + run.format("x") + '<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>2</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r><w:del>' + run.format("old") + '</w:del><w:r><w:sym w:font="Symbol" w:char="F061"/></w:r></w:p>'
    body += "<w:tbl><w:tr><w:tc><w:p>" + run.format("a") + "</w:p></w:tc><w:tc><w:p>" + run.format("b") + "</w:p></w:tc></w:tr></w:tbl>"
    body += "<w:p><m:oMathPara><m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:rad><m:deg/><m:e><m:r><m:t>b</m:t></m:r></m:e></m:rad></m:den></m:f></m:oMath></m:oMathPara></w:p>"
    found = read_docx(docx(body))
    assert kinds(found) == [("heading", "Head"), ("paragraph", "x²α"), ("table", "a | b"), ("formula", r"$$\frac{a}{\sqrt{b}}$$")]
    assert [f.start for f in found.fragments] == [0, 5, 9, 15]
    assert read_docx(docx("<w:p><m:oMath><m:unknown><m:t>z</m:t></m:unknown></m:oMath></w:p>")).issues[0][0] == "docx-omath-1"


def test_folder_as_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One.\n\nTwo.")
    (tmp_path / "in" / "b.md").write_text("# H\n\ntext")
    (tmp_path / "in" / "c.bin").write_bytes(b"\0")
    (tmp_path / "in" / "d.tex").write_bytes(b"\xff\xfe")
    batch = files.import_files(spark, str(tmp_path / "in"))
    shown = ["doc_id", "ord", "kind", "text", "issue_id"]
    rows = sorted(map(str, batch.select(*shown).collect()))
    assert len(rows) == 5
    assert files.issues_of(batch).count() == 1
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    for _ in range(2):
        ingest.import_stream(spark, str(tmp_path / "in"), out, at).awaitTermination()
    assert sorted(map(str, spark.read.parquet(out).select(*shown).collect())) == rows
    assert files.import_files(spark, str(tmp_path / "in"), spark.read.parquet(out)).count() == 0


def test_windows_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(source)
    expected = {tuple(r) for r in ingest.event_windows(events).collect()}
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "p"))
    stream = ingest.event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "p")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("windows").collect()} == expected


def test_docx_images_and_objects():
    from folium.sources.files import image_size

    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x10\0\0\0\x08"
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office"'
    blip = '<w:r><w:drawing><a:blipFill><a:blip r:embed="{}"/>{}</a:blipFill></w:drawing></w:r>'
    body = "<w:p>" + blip.format("r1", '<a:srcRect l="1000" t="x"/>') + blip.format("r1", "") + blip.format("r9", "") + "</w:p>"
    body += '<w:p><w:r><w:object><v:shape><v:imagedata r:id="r2"/></v:shape><o:OLEObject ProgID="Equation.3" r:id="r3"/></w:object></w:r></w:p>'
    body += '<w:p><w:r><w:drawing><a:blip r:link="r1"/></w:drawing></w:r></w:p>'
    relation = "".join(f'<Relationship Id="{k}" Target="{t}"/>' for k, t in (("r1", "media/a.PNG"), ("r2", "/word/media/b.emf"), ("r3", "embeddings/o.bin")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {names}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{relation}</Relationships>')
        for name, content in (("word/media/a.PNG", png), ("word/media/b.emf", b"emf"), ("word/embeddings/o.bin", b"o")):
            z.writestr(name, content)
    found = read_docx(out.getvalue())
    assert kinds(found) == [("figure", "[image]"), ("figure", "[OLE Equation.3] preview word/media/b.emf")]
    assert [(a.fragment, a.name, a.content, a.crop) for a in found.assets] == [(1, "image-b00001.png", png, (1000, 0, 0, 0)), (2, "image-b00002.emf", b"emf", None)]
    assert [i for i, _ in found.issues] == ["docx-crop-1", "docx-image-1", "docx-ole-1"] and "word/embeddings/o.bin" in found.issues[2][1] and "preview retained as image-b00002.emf" in found.issues[2][1]
    assert image_size(png) == (16, 8) and image_size(b"GIF89a\x05\0\x07\0") == (5, 7) and image_size(b"") == (None, None)
    assert image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x09\0\x0c") == (12, 9)
