import io
import zipfile

from parlance.sources import attachments as at

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs, cells=()):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr></w:tbl>" if cells else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{table}{"".join(map(p, paragraphs))}</w:body></w:document>')
    return out.getvalue()


def test_extract(spark, tmp_path):
    files = {"a.docx": docx("one", " ", "two", cells=["c1", "c2"]), "b.txt": b"  x \n\n y", "c.docx": b"broken", "d.bin": b"?", "e": docx("by its bytes"), "f.txt": b" ", "g.txt": b"z" * 5000}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.outcome, r.text) for r in at.extract(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("text", "one\ntwo\nc1\nc2") and got["b.txt"] == ("text", "x\ny") and got["c.docx"][0] == "error" and got["d.bin"] == ("unsupported", None)
    assert got["e"] == ("text", "by its bytes") and got["f.txt"] == ("empty", None) and got["g.txt"] == ("text", "z" * 4000)
