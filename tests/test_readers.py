import io
import json
import zipfile

from pyspark.sql import functions as F

from lectern.sources import readers


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_archives():
    word = archive(word__document_xml='<w:d xmlns:w="w"><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p></w:d>', docProps__core_xml="<c><dc:title>My &amp; title</dc:title></c>".replace("dc:", ""))
    assert readers.archive_text(word, "docx") == ("My & title", "One\nTwo")
    sheet = archive(xl__sharedStrings_xml="<sst><si><t>a</t></si><si><t>b</t></si></sst>", xl__worksheets__sheet1_xml='<s><row><c t="s"><v>1</v></c><c><v>7</v></c></row></s>')
    assert readers.archive_text(sheet, "xlsx") == (None, "b\t7")
    assert readers.archive_text(b"no archive", "docx") == (None, "")


def test_comments_notes_and_references(spark):
    word = archive(word__document_xml="<d><p><t>One</t></p></d>", word__comments_xml="<d><p><t>said</t></p></d>", word__header1_xml="<d><p><t>head</t></p></d>", word__styles_xml="<d><p><t>no</t></p></d>")
    assert readers.archive_text(word, "docx")[1].split() == ["said", "One", "head"]
    slides = archive(ppt__slides__slide2_xml="<d><p><t>two</t></p></d>", ppt__slides__slide10_xml="<d><p><t>ten</t></p></d>", ppt__notesSlides__notesSlide1_xml="<d><p><t>note</t></p></d>")
    assert readers.archive_text(slides, "pptx")[1].split() == ["note", "two", "ten"]
    paths = ["/a/readme-old.txt", "/a/README.rst", "/a/overview.md", "/b/docs/about.html", "/b/go.mod", "/c/doc/project", "/c/.github/README.md", "/d/Cargo.toml", "/d/readmes.md", "/e/index.html", "/f/getting-started.pdf"]
    files = spark.createDataFrame([(p, p.rpartition("/")[2]) for p in paths], "path string, name string").withColumn("ext", F.expr("nullif(lower(regexp_extract(name, '[^.][.]([^.]*)$', 1)), '')"))
    got = {r.directory: r.reference for r in readers.reference_files(files).collect()}
    want = {"/a": "/a/README.rst", "/b": "/b/docs/about.html", "/c": "/c/doc/project", "/d": "/d/Cargo.toml", "/f": "/f/getting-started.pdf"}
    assert {k: v for k, v in got.items() if k.count("/") == 1} == want


def test_html():
    assert readers.html_text("<p>a &amp; b</p><script>x()</script><div>c   d</div>") == "a & b\nc d"
    assert readers.html_text(None) == ""


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "README.md").write_text("hello")
    (tmp_path / "sub" / "a.html").write_text("<p>page</p>")
    (tmp_path / "sub" / "b.bin").write_bytes(b"\x00\x01")
    files = readers.listing(spark, str(tmp_path))
    assert {r["name"]: r["size"] for r in files.collect()} == {"README.md": 5, "a.html": 11, "b.bin": 2}
    assert readers.bounded_totals(files, 10).first()["files"] == 3 and readers.bounded_totals(files, 2).first()["files"] is None
    assert [r.reference.rpartition("/")[2] for r in readers.reference_files(files).collect()] == ["README.md"]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).withColumn("ext", F.regexp_extract("path", "\\.([^.]+)$", 1))
    assert {r.title: r.text for r in readers.extracted(read).collect()} == {"README.md": "hello", "a.html": "page", "b.bin": "b.bin"}


def test_parsed_and_transcripts(spark, tmp_path):
    line = json.dumps({"file_id": 3, "chunks": [{"text": "x", "kind": "odd", "page_start": 2}, {"text": "y", "kind": "table"}]})
    got = readers.parsed_chunks(spark.createDataFrame([(line,), ("broken",)], "value string")).orderBy("chunk_idx").collect()
    assert [(r.file_id, r.chunk_idx, r.kind, r.section_path) for r in got] == [(3, 0, "text", []), (3, 1, "table", [])]
    made = spark.createDataFrame([(1, [(0.0, 2.0, "a b"), (2.0, 4000.0, "c d")]), (2, None)], "file_id long, segments array<struct<start:double,end:double,text:string>>")
    assert [(r.text, r.label) for r in readers.transcript_chunks(made).collect()] == [("a b c d", "00:00–01:06:40")]
    assert len(readers.transcript_chunks(made, 3).collect()) == 2
    path = tmp_path / "feed.json"
    path.write_text(json.dumps({"releases": [{"id": "a", "version": "1.2", "build": 3}]}))
    assert [(r.id, r.build) for r in readers.release_feed(spark, str(path)).collect()] == [("a", 3)]
