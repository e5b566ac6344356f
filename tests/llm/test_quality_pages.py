"""Quality rules, the quality model, WARC archives and page texts."""

import base64
import collections
import gzip
import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from scoremart.llm import html_text, quality_model, quality_rules, queries, warc
from scoremart.llm.common import stage
from scoremart.session import scratch_path

from .conftest import odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    times = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = [False] * len(words)
    for k in range(len(words) - 2):
        if times[tuple(words[k : k + 3])] > 1:
            covered[k : k + 3] = [True] * 3
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        sum(covered),
    )


def test_base_measures(spark, odd_docs, no_docs):
    found = quality_rules.quality_verdicts(odd_docs).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = [(i, *brute_measures(x)) for i, x in odd_texts()]
    assert sorted(((r["doc_id"], *(r[k] for k in names)) for r in found), key=repr) == sorted(want, key=repr)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_verdicts(no_docs).count() == 0
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in found if r["kept"])
    assert quality_rules.keep_good(no_docs).count() == 0


def test_sketches_merge_and_fences_follow_groups(spark):
    """Symbols are common in one source and mark junk in the other; a small group takes its language's fence."""
    rng = np.random.default_rng(0)

    def text(share):
        return " ".join(f"w{rng.integers(10**6)}" + ("#" if rng.random() < share else "") for _ in range(80))

    rows = [(i, text(0.3), "en", "code") for i in range(300)] + [(1000 + i, text(0.0), "en", "web") for i in range(900)]
    rows += [(2000, text(0.3), "en", "web"), (2001, text(0.3), "en", "code"), (2002, text(0.9).replace("#", "###"), "en", "code"), (2003, text(0.5), "en", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(docs).collect()}
    assert all(kept[r[0]] for r in rows[:1200]) and kept[2001]
    assert not kept[2000] and not kept[2002] and not kept[2003]
    measured = quality_rules.with_measures(docs)
    whole = quality_rules.sketch(measured, ["lang"], "measures")
    parts = quality_rules.sketch(measured.where("doc_id % 2 = 0"), ["lang"], "measures").unionByName(
        quality_rules.sketch(measured.where("doc_id % 2 = 1"), ["lang"], "measures")
    )
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, quality_rules.merged(parts, ["lang"]).collect()))
    # A bucket's least value is within a thirty-second of every value in it.
    values = spark.range(100_000).select(F.col("id"), quality_rules.bucket(F.col("id")).alias("b"))
    assert values.where("b > id or id - b > id / 32").count() == 0


@pytest.mark.parametrize("size", [150, 250, 2500])
@pytest.mark.parametrize("junk", [0.51, 0.55, 0.7])
def test_sources_of_mostly_junk_keep_their_fence(spark, size, junk):
    """What is rejected does not depend on how large a source is, nor on whether junk is its larger part."""
    rng = np.random.default_rng(1)

    def text(share):
        return " ".join(f"w{i}" + ("##" if rng.random() < share else "") for i in range(60))

    rows = [(i, text(0.6 if i < junk * size else 0.0), "en", "hot") for i in range(size)]
    rows += [(10_000 + i, text(0.0), "en", f"s{i % 3}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs).select("doc_id").collect()}
    assert kept == {r[0] for r in rows if "#" not in r[1]}


def test_fence_is_bounded_by_the_language(spark):
    """Nearly all of a source is junk: its own quartile and spread would let it through."""
    rows = [(i, " ".join(f"w{j}###" if i % 20 else f"w{j}" for j in range(60)), "en", "hot") for i in range(600)]
    rows += [(10_000 + i, " ".join(f"w{j}" for j in range(60)), "en", "web") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs).select("doc_id").collect()}
    assert kept == {r[0] for r in rows if "#" not in r[1]}


def test_quality_model_learns_held_out_rows(spark, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scores = quality_model.quality_scores(docs, labels).toPandas()
    assert len(scores) == docs.count() and scores["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(scores["doc_id"], scores["held_out"], strict=True))
    both = scores[scores["held_out"]].merge(labels.toPandas(), on="doc_id")
    good, bad = (both.loc[both["quality"] == k, "score"].to_numpy() for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.85
    # Held-out labels do not change the scores.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_model.quality_scores(docs, flipped).toPandas()
    assert np.allclose(scores.sort_values("doc_id")["score"], again.sort_values("doc_id")["score"])
    assert quality_model.quality_scores(no_docs, labels).count() == 0


def test_quality_model_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(100, 1, 3), (99, None, 3), (None, 1, 3)], "doc_id long, quality int, vector int")
    rows = quality_model.quality_scores(odd_docs, labels).collect()
    assert len(rows) == len(odd_texts()) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    rows = quality_model.quality_scores(odd_docs, labels.where("doc_id < 0")).collect()
    assert all(r["score"] == pytest.approx(0.5) for r in rows)


PAGES = [
    (3, "http://b.example.org/x?y=1", "<p>same</p>"),
    (1, "https://a.example.org:8443/", "<p>same</p>"),
    (2, "http://b.example.org/x?y=1", "other\r\n\r\npage\r\nWARC/1.1\r\n\x1f"),
    (9, None, "<p>same</p>"),
    (5, "no host", None),
    (6, "", ""),
    (7, "http://B.example.org:80/x?y=1#f", "é" * 50_000),
    (8, "http://[bad", "éé"),
    (1, "https://a.example.org:8443/", "<p>same</p>"),
    (None, "http://c.example.org", "<p>same</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 4) for r in PAGES], "page_id long, url string, html string, file string, offset long").repartition(2)


def test_warc_round_trip(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages, f"{path}/archive")
    archives = warc.read_archives(spark, f"{path}/archive")
    assert sum(gzip.decompress(bytes(r["content"])).count(b"WARC/1.1\r\nWARC-Type") for r in archives.collect() if r["content"]) == len(PAGES)
    entries = stage(warc.index_entries(archives), "test-entries")
    warc.write_index(entries, f"{path}/index")
    index = warc.read_index(spark, f"{path}/index")
    hits = warc.look_up(index, spark.createDataFrame([(warc.surt("http://b.example.org/x?y=1"),), ("zz",), ("a",)], "surt string"))
    assert sorted(r["page_id"] for r in hits.collect()) == [2, 3, 7]
    found = warc.look_up(index, entries.select("surt"))
    records = stage(warc.read_records(found, archives), "test-records")
    texts = {(r["page_id"], bytes(r["payload"])) for r in records.where("record_type = 'response'").collect()}
    assert (2, PAGES[2][2].encode()) in texts and (7, PAGES[6][2].encode()) in texts
    want = []
    for i, u, h in PAGES:
        raw = (h or "").encode()
        first = min(j for j, _, x in PAGES if j is not None and (x or "") == (h or ""))
        refers = first if i is not None and i > first else None
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), sha, "response" if refers is None else "revisit", refers, u))
    got = [tuple(r) for r in warc.resolve(records).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_warc_finds_urls_with_line_breaks_and_outer_spaces(spark, tmp_path):
    urls = ["http://a.example/x\ny", "\thttp://a.example/z\r\n", "/rel/path ", " ", "\n", "", None, " /p\rq", "\xa0http://é.example/\x85", "http://a.example/x%0Ay"]
    rows = [(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op1_warc_index(spark, f"file://{tmp_path}").collect()
    assert sorted((r["page_id"], r["url"]) for r in found) == [(i, u) for i, u, _ in rows]


def test_warc_of_no_pages(spark, pages):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages.where("page_id < 0"), f"{path}/archive")
    archives = warc.read_archives(spark, f"{path}/archive")
    warc.write_index(warc.index_entries(archives), f"{path}/index")
    index = warc.read_index(spark, f"{path}/index")
    found = warc.look_up(index, spark.createDataFrame([("a",)], "surt string"))
    assert found.count() == 0 and warc.read_records(found, archives).count() == 0


def test_surt_orders_hosts():
    assert warc.surt("http://www.b.example.org:80/a?q=2#x") == "org,example,b,www)/a?q=2"
    assert warc.surt("https://u@B.example.org:8443") == "org,example,b:8443)/"
    assert warc.surt(None) == warc.surt("") == "" and warc.surt("mailto:x") == "mailto:x"


def test_page_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav>
    <!-- x --><div class="cookie-notice"><p>We use cookies, and more, and more.</p></div>
    <article><h1>Head &amp; line</h1><p><b>One,</b>\n two<br>three.<p>A &lt; B<script>if (a < b) "</p>"</script></p>
    <form><p>Mail us now, please.</p></form><ul><li>First<li>Second</ul><div class="ad">Buy this, now.</div><p>x</p></article>
    <aside><p>Other stories, by others.</p></aside><section id="comments"><p>Nice text, thank you, sir.</p></section>
    <footer>&copy; all, rights.</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\n\nOne, two three.\n\nA < B\n\nFirst\n\nSecond\n\nx"
    plain = "<body><div class=menu><a href=/>Home</a></div><div id=story><p>Long text, with marks. More of it, too.</p><p>Yes.</p></div><div><a href=/x>Link one</a> <a href=/y>Link two</a></div></body>"
    assert html_text.main_text(plain) == "Long text, with marks. More of it, too.\n\nYes."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p><!-- x") == ""
    assert html_text.main_text("just text < here") == "just text < here"


def test_page_text_beside_article_cards():
    """Teaser cards do not push out the main text of a plain element."""
    sentence = "The council met on Monday, and it agreed on the plan, after long talks. "
    cards = "".join(f"<article><h3><a href=/{i}>Story {i}</a></h3><p>Teaser, number {i}, in a few words.</p></article>" for i in range(4))
    page = f"<body><div id=story><p>{sentence * 3}</p><p>{sentence * 4}</p></div><div class=cards>{cards}</div></body>"
    assert html_text.main_text(page).startswith(f"{(sentence * 3).strip()}\n\n{(sentence * 4).strip()}")
    inside = f"<body><article><div class=by><p>By A.</p></div><div class=text><p>{sentence * 3}</p></div></article><div><p>All rights, reserved.</p></div></body>"
    assert html_text.main_text(inside) == f"By A.\n\n{(sentence * 3).strip()}"


@pytest.mark.parametrize("paragraphs", [2, 40])
def test_page_text_with_heading_and_lead_in_own_containers(paragraphs):
    """What is content does not depend on how long another container is."""
    sentence = "The council met on Monday, and it agreed on the plan, after long talks. "
    story = "".join(f"<p>{sentence * 3}</p>" for _ in range(paragraphs))
    page = f"<body><div class=top><h1>Plan agreed</h1></div><div class=lead><p>{sentence * 2}</p></div><div class=story>{story}</div><div class=end>Printed here</div></body>"
    want = ["Plan agreed", (sentence * 2).strip(), *[(sentence * 3).strip()] * paragraphs]
    assert html_text.main_text(page) == "\n\n".join(want)


SENTENCE = "The council met on Monday, and it agreed on the plan, after long talks."


def teaser_page():
    links = "".join(f"<li><a href=/{i}>Another story, number {i}</a></li>" for i in range(5))
    return f"<body><main><h1>Plan agreed</h1><p>{SENTENCE}</p><ul>{links}</ul><p>{SENTENCE}</p></main><div class=end><p>Printed, here.</p></div></body>"


def test_paths_are_selected_by_their_ratios(monkeypatch):
    """Link lists inside an article go, short items stay; without the ratios the links come back."""
    want = f"Plan agreed\n\n{SENTENCE}\n\n{SENTENCE}"
    assert html_text.main_text(teaser_page()) == want
    items = "".join(f"<li>Item {i}</li>" for i in range(5)) + "<li>See <a href=/x>this</a></li>"
    table = "<table><tr><th>a</th><td>1</td></tr></table>"
    page = f"<body><article><p>{SENTENCE}</p><ul>{items}</ul>{table}<p>{SENTENCE}</p></article></body>"
    assert html_text.main_text(page).split("\n\n") == [SENTENCE, *(f"Item {i}" for i in range(5)), "See this", "a", "1", SENTENCE]
    monkeypatch.setattr(html_text, "path_ratios", lambda blocks: dict.fromkeys((b[0] for b in blocks), 1.0))
    constant = html_text.main_text(teaser_page())
    assert constant != want and "Another story" in constant and "Printed" in constant


@pytest.mark.parametrize(
    "element", ['section id="search-methods"', 'div class="tags-explained"', 'div class="alert"', 'div data-id="search-12"', 'div class="share of-market"']
)
def test_article_parts_that_mention_boilerplate_stay(element):
    page = f"<!--><body><article><p>{SENTENCE}</p><{element}><p>{SENTENCE * 2}</p></{element.split()[0]}><div class='ad box'><p>{SENTENCE}</p></div></article></body>"
    assert html_text.main_text(page) == f"{SENTENCE}\n\n{SENTENCE * 2}"


class ArticleBlocks(HTMLParser):
    """Blocks of the article of a well-formed page of the given table, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.inside, self.skip = [], "", 0, 0

    def cut(self):
        if self.text.split():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        elif tag not in ("a", "b"):
            self.cut()
            self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.cut()
            self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.text += data


def test_given_pages_by_another_parser():
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for row in rows:
        parser = ArticleBlocks()
        parser.feed(row["html"] or "")
        parser.close()
        assert html_text.main_text(row["html"]) == "\n\n".join(parser.blocks), row["page_id"]


def test_extract_text_table(spark, pages):
    found = html_text.extract_text(pages).collect()
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in found), key=repr)
    want = sorted(((i, u, html_text.main_text(h), len(html_text.main_text(h))) for i, u, h in PAGES), key=repr)
    assert got == want
    assert html_text.extract_text(pages.where("page_id < 0")).count() == 0


def test_every_operator_is_registered():
    numbers = {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES}
    assert numbers == set(range(1, 14))
