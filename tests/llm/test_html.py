"""HTML tokens, media sequences and WARC records of whole and broken pages."""

import random
import time
from html.parser import HTMLParser

import pytest

from lakewarden.llm import html, media, warc


class Plain(HTMLParser):
    """The standard library's tokens, in the form of ours."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = []

    def handle_starttag(self, tag, attrs):
        first = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        self.out.append(("start", tag, first))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.out.append(("end", tag, ""))

    def handle_data(self, data):
        if not (self.out and self.out[-1][:2] in (("start", "script"), ("start", "style"))):
            self.out.append(("text", data, ""))


def ours(page):
    return [(kind, what, html.attributes(inside) if kind == "start" else "") for kind, what, inside in html.tokens(page)]


def joined(tokens):
    out = []
    for kind, what, more in tokens:
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + what, "")
        else:
            out.append((kind, what, more))
    return out


def test_tokens_of_given_pages_equal_a_parser_s(spark, data):
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").select("html").collect() if r.html]
    same = 0
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.close()
        same += joined(ours(page)) == joined(plain.out)
    assert same >= 0.95 * len(pages)  # they differ on broken markup


def test_odd_tokens():
    assert list(html.tokens("<a title='a > b' HREF=x>hi</A ><!-- <b> -->x &lt; 3 < 4<br/><?pi?><!DOCTYPE x>")) == [
        ("start", "a", " title='a > b' HREF=x"), ("text", "hi", ""), ("end", "a", ""), ("text", "x < 3 < 4", ""), ("start", "br", "/"),
    ]
    assert html.attributes(""" a=1 A=2 b='x "y"' c="p'q" d e = f&amp;g /""") == {"a": "1", "b": 'x "y"', "c": "p'q", "d": "", "e": "f&g"}
    assert list(html.tokens("<script>if (a<b) '</p>'</script>t<style>x")) == [("start", "script", ""), ("end", "script", ""), ("text", "t", ""), ("start", "style", ""), ("text", "x", "")]
    assert list(html.tokens("")) == [] and list(html.tokens("a<b")) == [("text", "a<b", "")]
    assert [t[:2] for t in html.tokens('<a b="c><p>d</p>')] == [("start", "a"), ("start", "p"), ("text", "d"), ("end", "p")]  # a quote that never closes does not count


BROKEN = {
    "open tags": "<b " * 350_000, "comments": "<!--" * 250_000, "scripts": "<script>" * 125_000, "quotes": '<a b=">" ' * 110_000, "half quotes": "<a b='" * 160_000, "titles": "<title>" * 140_000,
    "signs": "<" * 1_000_000, "equals": "<a =" + " " * 500_000 + '"x' * 250_000, "figures": "<figure>" * 120_000, "captions": "<figure><figcaption>c</figcaption>" * 15_000 + "<img src=a>" * 15_000,
    "late captions": "<figure>" * 15_000 + "<img src=a>" * 15_000 + "<figcaption>c</figcaption></figure>" * 15_000, "names": "<a " + "x " * 500_000 + ">",
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_broken_pages_take_linear_time(name):
    began = time.process_time()
    media.items(BROKEN[name])
    warc.plain_text(BROKEN[name])
    warc.metadata(BROKEN[name], "")
    assert time.process_time() - began < 15  # about 2; squares would take minutes


def test_captions_wherever_they_stand():
    shown = lambda page: [(r["kind"], r["caption"] if r["kind"] == "media" else r["text"]) for r in media.items(page)]
    assert shown("<figure><figcaption>c</figcaption><img src=a></figure>t") == [("media", "c"), ("text", "t")]  # before its image
    assert shown("<figure><img src=a alt=x><figcaption>never closed</figure>t") == [("media", "never closed"), ("text", "t")]
    assert shown("<figure><img src=a><figcaption>nor the figure") == [("media", "nor the figure")]
    assert shown("<figure><img src=a alt=x></figure><img src=b alt=y>") == [("media", "x"), ("media", "y")]
    assert shown("<picture><source srcset='u 2x, v'><img src=w></picture>") == [("media", None), ("media", None)]
    assert shown("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure></figure>") == [("media", None), ("media", "in")]


def page(rng, digests):
    """A page of paragraphs and figures, and its items as they should come out."""
    parts, wanted = [], []
    for i in range(rng.randrange(1, 9)):
        if rng.random() < 0.5:
            parts.append(f"<p title='1 > 0'>text <b>{i}</b> &amp; more")
            wanted.append(("text", f"text {i} & more", None, None))
        else:
            caption = f"caption {i}" if rng.random() < 0.7 else None
            own = [rng.choice([*digests, None]) for _ in range(rng.randrange(1, 4))]
            images = "".join(f"<img alt=alt{i} src='{'urn:sha256:' + d.upper() if d else 'http://x/y.png'}'>" for d in own)
            note = f"<figcaption>{caption}</figcaption>" if caption else ""
            parts.append(f"<figure>{note}{images}</figure>" if rng.random() < 0.5 else f"<figure>{images}{note}</figure>")
            wanted += [("media", "urn:sha256:" + d.upper() if d else "http://x/y.png", d, caption or f"alt{i}") for d in own]
    return "<script>'<img src=no>'</script>".join(parts), wanted


def test_sequences_of_an_estate_of_pages(spark):
    rng = random.Random(6)
    digests = ["%064x" % i for i in range(5)]
    made = {i: page(rng, digests) for i in range(60)}
    pages = spark.createDataFrame([(i, p) for i, (p, _) in made.items()], "page_id int, html string")
    store = spark.createDataFrame([(d, i) for i, d in enumerate(digests[:4])], "digest string, size int")
    found = media.resolve(media.parse(pages, ["page_id"]), store, ["page_id"]).orderBy("page_id", "position").collect()
    wanted = [(i, at, *item, digests.index(item[2]) if item[2] in digests[:4] else None) for i, (_, own) in made.items() for at, item in enumerate(own)]
    assert [(r.page_id, r.position, r.kind, r.text, r.digest, r.caption, r["size"]) for r in found] == wanted


def test_metadata_reads_what_is_shown():
    given = "<html lang=de><title>A &amp; B</title><script>\"<a href='no'>\"</script><meta charset=utf-8><a title='a > b' href='/u?a=1&amp;b=2'>hi</a><a>none</a>"
    assert warc.metadata(given, "HTTP/1.1 200 OK\r\nX: y\r\n\r\n").split("\r\n")[:-1] == ["title: A & B", "language: de", "charset: utf-8", "fetch-header: X: y", "outlink: /u?a=1&b=2"]
    assert warc.plain_text("<a title='a > b'>hi</a>") == "hi" and warc.plain_text("<head><title>t</title></head><body>a<br>b<template>c</template>d") == "a\nb d"
