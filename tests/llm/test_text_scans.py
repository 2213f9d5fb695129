"""HTML main text, license scans and line removal against brute force and examples."""

import html as charrefs
import random
import re

import pytest

from fleetaudit.llm import html_text, licenses, line_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain only", "plain only"), ("<p>unclosed <b>bold", "unclosed bold"),
    ("<p>a&amp;b &lt;c&gt; &eacute;&#233;&nbsp;x</p>", "a&b <c> éé x"),
    ("<body><p>One\n  two</p><p> </p><p>three</p>", "One two\nthree"),
    ("<p>x<script>var a='<p>no</p>'</script>y<style>p{}</style><!-- no --></p>", "xy"),
    ("<header><h1>Site</h1></header><nav>menu</nav><main><article><header><h1>Head</h1></header><p>Text <i>it</i> one.<p>Two."
     "<aside>no</aside><div class='ad'>no</div><form><p>no</form><section id=comments><p>no</section></article></main>"
     "<div class='sidebar'><p>no</div><footer>no</footer>", "Head\nText it one.\nTwo."),
    ("<div class='cookie-notice'>no no</div><article><p>a</p></article><div role=navigation>no</div>", "a"),
    ("<article><h1>T</h1><p><b>T<br><p>one</p><p>two</p></article>", "T\nT\none\ntwo"),
    ("<article><p>a</span></div><p>b</article><p>after", "a\nb"),
    ("<div id=menu><a>Home</a></div><div><p>A long paragraph of the real text, which goes on and on.</p><p>Short.</p></div>"
     "<div><a>x</a><a>y</a></div>", "A long paragraph of the real text, which goes on and on.\nShort."),
    ("<nav>all of it is menu</nav>", ""),
])
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(charrefs.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_page_edges(spark):
    long = "<article>" + "<p>word word</p>" * 30_000 + "</article>"
    rows = [(1, None, None, 5), (None, "u", "<p>a</p>", None), (2, "u", long, 5), (2, "u", long, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in html_text.extract_text(pages).collect()), key=repr)
    assert got == sorted([(1, None, 0), (None, "u", 1), (2, "u", 299_999), (2, "u", 299_999)], key=repr)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def license_case():
    rng = random.Random(2)
    lines = [t for _, t in licenses.TEMPLATES] + ["MIT License", "the apache\nlicense", "General public, License", "mit license license mit",
                                                 "LICENSED under CC BY", "plain words of no interest", "x"]
    rows = []
    for k in range(200):
        parts = []
        for _ in range(rng.randrange(5)):
            line = rng.choice(lines).split(" ")
            for _ in range(rng.choice((0, 0, 1, 2))):
                line[rng.randrange(len(line))] = rng.choice(("zzz", "license", "MIT", "free"))
            parts.append(" ".join(line))
        rows.append((k, "\n".join(parts), "x", None))
    long = "word " * 100_000 + "\nReleased under the MIT License.\n" + "word " * 50
    return [*rows, (900, None, None, None), (901, "", "x", "x"), (902, long, "x", "x"), (902, long, "x", "x"), (None, "mit license", "x", "x")]


def license_brute(text):
    found = words(text)
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split(" ")
        places += [(k, label) for k in range(len(found)) if found[k:k + len(p)] == p]
    blocks = []
    for line in (text or "").split("\n"):
        held = set(words(line))
        for label, template in licenses.TEMPLATES:
            t = set(words(template))
            if len(t & held) >= licenses.THRESHOLD * len(t) - 1e-9:
                blocks.append((label, len(t & held) / len(t)))
    base = {x for _, x in places}
    starts = [k for k, _ in places]
    return (len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {x for x, _ in blocks})), 1.0 if places else max((c for _, c in blocks), default=0.0))


def test_licenses_match_brute_force(spark):
    rows = license_case()
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words string")
    got = sorted((tuple(r) for r in licenses.license_digest(docs).collect()), key=repr)
    assert got == sorted(((d, *license_brute(t)) for d, t, *_ in rows), key=repr)
    assert sum(r[2] > 0 for r in got) > 10 and sum(r[6] != r[5] for r in got) > 10


def test_license_order_counts_all_documents(spark):
    docs = spark.createDataFrame(license_case(), "doc_id long, text string, labels string, n_words string").repartition(4)
    counts = licenses.word_counts(docs, {b"mit", b"absent"})
    assert counts == {b"mit": sum(words(t).count("mit") for _, t, *_ in license_case()), b"absent": 0}
    assert licenses.license_digest(docs.limit(0)).count() == 0


def line_brute(rows, ratio, least):
    hosts, pages = {}, {}
    for k, (_, text, host, *_) in enumerate(rows):
        hosts[host or ""] = hosts.get(host or "", 0) + 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            pages.setdefault((host or "", line), set()).add(k)
    bad = {key for key, at in pages.items() if len(at) >= least and len(at) > ratio * hosts[key[0]]}
    out = []
    for d, text, host, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (host or "", x.strip(" ")) not in bad]
        out.append((d, host or "", len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ratio, least", [(0.1, 3), (0.5, 1), (0.0, 1), (0.9, 2)])
def test_lines_match_brute_force(spark, ratio, least):
    rng = random.Random(9)
    rows = []
    for k in range(300):
        host = rng.choice(["hot"] * 4 + ["a", "b", "c", None])
        lines = [rng.choice(["Home", " Home ", "Copyright", "", "once", f"own {k}", f"pair {k // 2}", "é\t"]) for _ in range(rng.randrange(7))]
        rows.append((k, "\n".join(lines), host, "x"))
    rows += [(900, None, "a", None), (901, "", None, None), (902, "Home\n" * 5_000, "b", "x"), (903, "same", "d", "x"), (903, "same", "d", "x"),
             (None, "Home\nno id", "hot", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    got = sorted((tuple(r) for r in line_dedup.drop_boilerplate(docs, "source", ratio, least).collect()), key=repr)
    assert got == line_brute(rows, ratio, least)


def test_no_lines(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.drop_boilerplate(docs, "source").count() == 0
