"""Office documents made here, read back through Spark."""

import io
import zipfile

from noema.sources.office import office_parts, office_texts
from noema.sources.parsers import files


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in members.items():
            z.writestr(name.replace("__", "/") + ".xml", xml)
    return out.getvalue()


W = '<d xmlns:w="urn:w"><w:p><w:r><w:t>One </w:t><w:t>line</w:t></w:r></w:p><w:p><w:t> </w:t></w:p><w:p><w:t>Two</w:t></w:p></d>'
SLIDE = "<s><p><t>{}</t></p><tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>b</t></p></tc></tr></tbl></s>"
SHEET = '<s><row><c r="A1" t="s"><v>1</v></c><c r="C1"><v>7</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></s>'


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(archive(word__document=W))
    (tmp_path / "b.pptx").write_bytes(archive(ppt__slides__slide10=SLIDE.format("last"), ppt__slides__slide2=SLIDE.format("first"), ppt__slides__slide3="<s/>"))
    (tmp_path / "c.xlsx").write_bytes(archive(xl__sharedStrings="<q><si><t>no</t></si><si><t>yes</t></si></q>", xl__worksheets__sheet1=SHEET))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.txt").write_text("text")
    got = {(r.path.rpartition("/")[2], r.part): r.content for r in office_texts(files(spark, str(tmp_path))).collect()}
    assert got == {
        ("a.docx", 0): "One line\nTwo",
        ("b.pptx", 0): "first\na | b",
        ("b.pptx", 1): "last\na | b",
        ("c.xlsx", 0): "2 rows, 3 columns\nyes |  | 7\n | in",
    }


def test_nothing_to_read():
    assert office_parts(None, b"x") == office_parts("docx", None) == office_parts("docx", archive(other="<a/>")) == office_parts("docx", archive(word__document="<a>")) == []
