"""Reading text, subtitles, sound and archives from bytes."""

import io
import math
import struct
import tarfile
import wave
import zipfile

from pyspark.sql import functions as F

from tracewright.sources import media, subtitles, texts


def test_decoding():
    assert texts.decoded("é".encode("utf-16-le").join([b"\xff\xfe", b""]))[:2] == ("é", "utf-16-le")
    assert texts.decoded("é".encode())[1] == "utf-8" and texts.decoded(b"\x93a\x94")[1] == "cp1252" and texts.decoded(b"\x81\x01")[1] == "latin-1"
    assert texts.decoded(None) == (None, None, 0.0)


def test_blocks(spark):
    md = "# T\n\na\nb\n\n> q\n- i\n```\ncode\n```\n![x](y.png)"
    assert [(b["kind"], b["text"]) for b in texts.markdown_blocks(md)] == [("heading", "T"), ("paragraph", "a b"), ("blockquote", "q"), ("list_item", "i"), ("fenced", "<fenced>"), ("image", "x")]
    assert [(b["kind"], b["text"]) for b in texts.html_blocks("<h1>T</h1><p>a <b>b</b></p><script>no</script>")] == [("heading", "T"), ("paragraph", "a b")]
    df = spark.createDataFrame([(md, bytearray(b"x"))], "t string, b binary")
    assert len(df.select(texts.markdown("t").alias("b")).first().b) == 6 and df.select(texts.epub("b").alias("b")).first().b == []


def epub():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("O/a.xhtml", "<p>second</p>")
        z.writestr("O/b.xhtml", "<p>first</p>")
    return b.getvalue()


def test_dispatch(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "b.md").write_text("# H")
    (tmp_path / "c.xyz").write_text("p1\n\np2")
    (tmp_path / "d.epub").write_bytes(b"broken")
    files = texts.read_files(spark, f"file://{tmp_path}")
    got = {}
    for r in texts.dispatch(files).orderBy("path", "ordinal").collect():
        got.setdefault(r.path[-6:], []).append((r.format, r.text, len(r.warnings)))
    assert got["a.epub"] == [("epub", "first", 0), ("epub", "second", 0)]
    assert got["/c.xyz"] == [("txt", "p1", 1), ("txt", "p2", 1)] and got["d.epub"] == [("epub", None, 1)]
    known = files.where(F.col("path").endswith("b.md"))
    assert texts.new_sources(files, known).count() == 3
    assert texts.read_text(spark, f"file://{tmp_path}").where("charset = 'utf-8'").count() >= 3


SRT = "1\n00:00:01,500 --> 00:00:02,000\n<i>Hi</i>\n\n2\n00:00:03,000 --> 00:00:04,000\nthere\nyou\n"
DOCS = [
    ("srt", SRT, [(1500, 2000, "Hi"), (3000, 4000, "there you")]),
    ("webvtt", "WEBVTT\nX-TIMESTAMP-MAP=MPEGTS:900000,LOCAL:00:00:00.000\n\n00:01.000 --> 00:02.000\n<v Ann>Hey\n", [(11000, 12000, "Hey")]),
    ("microdvd", "{25}{50}A|b\n", [(1000, 2000, "A b")]),
    ("mpl2", "[10][20]A\n", [(1000, 2000, "A")]),
    ("tmp", "00:00:01:A\n00:00:03:B\n", [(1000, 3000, "A"), (3000, None, "B")]),
    ("ass", "[Script Info]\n[Events]\nFormat: Layer, Start, End, Style, Name, Text\nDialogue: 0,0:00:01.00,0:00:02.50,Def,Bo,{\\i1}x, y\n", [(1000, 2500, "x, y")]),
    ("ttml", '<tt xmlns="http://www.w3.org/ns/ttml"><body><div><p begin="00:00:01.000" end="00:00:02.000">A</p></div></body></tt>', [(1000, 2000, "A")]),
    ("sami", "<SAMI><BODY><SYNC Start=1000><P>A<SYNC Start=2000><P>&nbsp;</BODY></SAMI>", [(1000, 2000, "A")]),
    (None, "plain words", [(None, None, None)]),
]


def test_subtitles(spark):
    df = spark.createDataFrame([(i, d[1]) for i, d in enumerate(DOCS)], "id int, t string")
    got = {}
    for r in subtitles.parse(df, "id", "t").orderBy("id", "index").collect():
        got.setdefault(r.id, []).append((r.format, (r.start_ms, r.end_ms, r.text)))
    for i, (fmt, _, want) in enumerate(DOCS):
        assert got[i] == [(fmt, w) for w in want], fmt
    assert spark.createDataFrame([("x", "a.smi"), (None, None)], "t string, h string").select(subtitles.detect_format(F.col("t"), F.col("h")).alias("f")).collect()[0].f == "sami"


def test_wav_and_archives(spark):
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"".join(struct.pack("<h", int(16384 * math.sin(i))) for i in range(80)))
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as tar:
        i = tarfile.TarInfo("../x")
        i.size = 1
        tar.addfile(i, io.BytesIO(b"x"))
    files = [("a.wav", b.getvalue()), ("t.tar", t.getvalue()), ("e.epub", epub()), ("bad", b"zz")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    got = {r.path: (r.sample_rate, r.samples and len(r.samples)) for r in media.read_wav(df).collect()}
    assert got["a.wav"] == (8000, 80) and got["bad"] == (None, None)
    got = {(r.path, r.reason) for r in media.list_archives(df).collect()}
    assert ("t.tar", "path") in got and ("bad", "malformed") in got and ("e.epub", None) in got
    assert media.fixity(df.withColumn("sha512", F.sha2("content", 512))).where("intact").count() == 4
    assert bytes(media.byte_range(df.where("path = 'bad'"), 1, 9).first().range) == b"z"
    probe = spark.createDataFrame([("v", '{"streams":[{"index":0,"codec_type":"video","codec_name":"h264","r_frame_rate":"25/0"},{"index":1,"codec_type":"subtitle","codec_name":"xsub","r_frame_rate":"0/0","tags":{"language":"en"}}]}')], "path string, report string")
    assert [(r["index"], r.fps, r.language, r.is_bitmap) for r in media.tracks(probe).orderBy("index").collect()] == [(0, 0.0, None, False), (1, 0.0, "en", True)]
