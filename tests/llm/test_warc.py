import base64
import gzip
import hashlib
import html
import random
import time

from tessera.llm import warc as x

PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp;
 B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no <b>this</b> --><h1>Head</h1><p title="a > b">One <b>two</b>&nbsp;three<br>four</p>
<ul><li>x</li><li>y &lt;z&gt;</li></ul></body></html>"""
ROWS = [(1, "http://a.example/ü", "2024-01-02T03:04:05Z", PAGE), (2, None, None, None), (3, "http://b.example/", "2024-01-01T00:00:00Z", ""), (None, "http://a\r\nInjected: x", "2024-01-01T00:00:00Z", "<p>" + "long " * 50000), (1, "http://a.example/ü", "2024-01-02T03:04:05Z", PAGE)]


def test_plain_text():
    assert x.plain_text(PAGE) == "Head\nOne two three\nfour\nx\ny <z>"
    assert x.plain_text("") == "" and x.plain_text("<script>never closed") == "" and x.plain_text("a<") == "a<"


def found(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "source_id long, target_uri string, warc_date string, html string")
    return df.selectExpr("source_id", "target_uri", "warc_date", "cast(html as binary) AS body", "'x' AS record")


def test_round_trip(spark):
    rows = x.derivatives(found(spark)).collect()
    assert len(rows) == 2 * len(ROWS)
    for r in rows:
        (fields, block), = x.read_records(bytes(r.record))
        assert "WARC-Payload-Digest" not in fields and fields["WARC-Type"] == r.warc_type and fields["WARC-Record-ID"] == r.record_id and fields["WARC-Refers-To"] == r.refers_to
        assert fields["WARC-Block-Digest"] == r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert int(fields["Content-Length"]) == r.content_length == len(block)
        assert "Injected" not in fields
        body = next((h or "") for i, u, d, h in ROWS if i == r.id_of_source).encode()
        assert r.source_payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        if r.warc_type == "conversion":
            assert block.decode() == x.plain_text(body.decode())
        else:
            assert f"source-payload-digest: {r.source_payload_digest}\r\n".encode() in block and b"http-content-type: text/html; charset=utf-8\r\n" in block
    pairs = {}
    for r in rows:
        pairs.setdefault((r.refers_to), set()).add(r.warc_type)
    assert all(kinds == {"metadata", "conversion"} for kinds in pairs.values())
    about = next(r for r in rows if r.id_of_source == 1 and r.warc_type == "metadata")
    assert b"language: fr\r\ntitle: A & B\r\n" in next(x.read_records(bytes(about.record)))[1]
    whole = b"".join(bytes(r.record) for r in rows)  # members in a row are a file
    assert [f["WARC-Record-ID"] for f, _ in x.read_records(whole)] == [r.record_id for r in rows]
    assert [f["WARC-Record-ID"] for f, _ in x.read_records(gzip.decompress(whole))] == [r.record_id for r in rows]


def test_own_headers_and_empty(spark):
    block = b"HTTP/1.1 200 OK\r\nX-One: 1\r\n\r\n<p>text"
    df = spark.createDataFrame([(5, "u", "d", bytearray(block))], "source_id long, target_uri string, warc_date string, body binary")
    rows = x.derivatives(df, http=True).collect()
    assert [r.source_headers for r in rows] == ["HTTP/1.1 200 OK\r\nX-One: 1"] * 2
    assert rows[0].source_payload_digest == x.digest(b"<p>text")
    assert x.derivatives(found(spark).limit(0)).count() == 0


def brute(page):
    """The text by a plain walk over the characters."""
    out, i = "", 0
    name_of = lambda j: "".join(page[k] for k in range(j, next((k for k in range(j, len(page)) if not (page[k].isascii() and page[k].isalnum())), len(page))))

    def tag_end(j):
        while j < len(page):
            if page[j] == ">":
                return j + 1
            if page[j] in "\"'" and page[j] in page[j + 1 :]:
                j = page.index(page[j], j + 1)
            j += 1
        return len(page)

    while i < len(page):
        rest = page[i + 1 : i + 2]
        if page[i] != "<" or not rest or not (rest in "!?/" or (rest.isascii() and rest.isalpha())):
            out += page[i]
            i += 1
        elif page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            out, i = out + " ", len(page) if end < 0 else end + 3
        else:
            closing = rest == "/"
            name = name_of(i + 1 + closing)
            if name[:1].isdigit():
                name = ""
            i = tag_end(i + 1 + (closing or rest in "!?") + len(name))
            if name.lower() in ("script", "style", "noscript", "template", "svg", "title") and not closing:
                end = page.lower().find("</" + name.lower(), i)
                out, i = out + " ", len(page) if end < 0 else tag_end(end + 2 + len(name))
            elif name.lower() in x._BLOCK:
                out += "\n"
    lines = [" ".join(t.split()) for t in html.unescape(out).split("\n")]
    return "\n".join(t for t in lines if t)


def test_text_against_brute_force():
    rnd = random.Random(3)
    pieces = ["<p>", "</P >", "<b", ">", "<!--", "-->", "-", "<script>", "</script>", "<title x='", "'", '"', "</title", "<br/>", "text ", "&lt;", "<", "</", "<1", "<!doctype html>", "é ", "\n", "<a href=\"x>y\">", "<svg", "&nbsp;", "<?x", "<li>"]
    for _ in range(3000):
        page = "".join(rnd.choices(pieces, k=rnd.randrange(1, 14)))
        assert x.plain_text(page) == brute(page), page


def test_time_grows_with_length():
    for page in ("<a " * 300_000 + '"', "<title " * 150_000, "<html lang " * 100_000, "<!--" * 250_000, "<script " * 100_000 + "'", '<p "' * 200_000, "</script" + " " * 500_000, "<" * 1_000_000):
        began = time.perf_counter()
        x.scan(page)
        assert time.perf_counter() - began < 5, page[:10]


def test_charsets():
    page = "<p>é ü".encode("latin-1")
    assert x.decoded("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1", page) == "<p>é ü"
    assert x.decoded("", b"<meta charset='latin-1'>" + page) == "<meta charset='latin-1'><p>é ü"
    for unknown in ("none-such", "hex", "base64"):
        assert x.decoded(f"HTTP/1.1 200 OK\r\ncontent-type: text/html; charset={unknown}", "é".encode()) == "é"
