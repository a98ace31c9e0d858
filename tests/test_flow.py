"""Search by vectors, rounds of retrieval, digests: against brute force and with providers that fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import claims, retrieval, search
from ledgerlens.plans import answers, digest

EMBED = search.HashedWords(32)


def near(x, i, rows, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return sorted(rows, key=lambda j: (round(1 - float(u[i] @ u[j]), 12), f"c{j:03}"))[:k]


def test_echoes_in_other_sections(spark):
    """Both ways of search against brute force: all sections, and others only; names differ in case and blanks; some sections are null."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6))
    x[::4] += 5  # a tight group, so that a claim's nearest are of its own section
    names = ["Item 1A", " item 1a ", "Item 7", None, "Legal"]
    section = [names[0] if i % 4 == 0 else names[i % 5] for i in range(120)]
    chunks = spark.createDataFrame([(f"c{i:03}", i % 2, v.tolist(), s) for i, (v, s) in enumerate(zip(x, section))], "chunk_id string, scope int, embedding array<double>, section string")
    cited = {i: ["Item 1A"] if i % 8 == 0 else ["LEGAL ", None] for i in range(0, 40, 4)}
    asked = spark.createDataFrame([(f"q{i}", i % 2, x[i].tolist(), c) for i, c in cited.items()] + [("none", 0, None, ["x"])], "claim_id string, scope int, embedding array<double>, cited_sections array<string>")
    key = lambda s: (s or "").strip().lower()
    for apart in (False, True):
        got = {r.claim_id: (r.neighbours, r.echoes) for r in claims.echoes(asked, chunks, 5, 2, apart).collect()}
        for i, own in cited.items():
            other = lambda j: key(section[j]) and key(section[j]) not in map(key, own)  # noqa: E731,B023
            found = near(x, i, [j for j in range(i % 2, 120, 2) if not apart or other(j)], 5)
            assert got[f"q{i}"] == ([f"c{j:03}" for j in found], sorted({section[j].strip() for j in found if other(j)})[:2])
        assert "none" not in got and len(got) == len(cited)


def test_mmr_by_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 5))
    x[50:60] = x[40]
    v = spark.createDataFrame([(f"v{i:03}", "s", r.tolist()) for i, r in enumerate(x)], "vec_id string, scope string, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", "s", x[i].tolist(), k) for i, k in ((40, 4), (7, 6), (3, 200))], "query_id string, scope string, query array<double>, k int")
    pool = retrieval.topk(v, q, 30).join(v.select("vec_id", "embedding"), "vec_id").join(q.select("query_id", "k"), "query_id")
    got = {}
    for r in retrieval.mmr(pool).orderBy("query_id", "pick").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, k in ((40, 4), (7, 6), (3, 200)):
        left = sorted(range(200), key=lambda j: (round(1 - float(u[i] @ u[j]), 12), j))[:30]
        picked = left if k >= 30 else []
        while len(picked) < min(k, 30):
            best = max((j for j in left if j not in picked), key=lambda j: (round(0.7 * float(u[i] @ u[j]) - 0.3 * max((float(u[j] @ u[p]) for p in picked), default=0.0), 9), -left.index(j)))
            picked.append(best)
        assert got[f"q{i}"] == [f"v{j:03}" for j in picked]


def corpus(spark):
    texts = ["the sea has risks of storm", "storm and sea and sea", "sales grew on cloud demand", "cloud sales fell", "a risk of new law", "sea", "storm law cloud", "old text of law"]
    rows = [(f"k{i}", f"d{i % 3}", "T" if i < 6 else "U", "Item 7", "benchmark" if i == 4 else "live", t) for i, t in enumerate(texts)]
    return texts, spark.createDataFrame(rows, "chunk_id string, doc_id string, ticker string, section string, corpus string, text string")


def test_retrieval_of_texts(spark):
    """Live chunks of the ticker, or one document of any corpus; each query with its k."""
    texts, chunks = corpus(spark)
    indexed = search.index(chunks, EMBED, EMBED.model)
    about = spark.createDataFrame([("1", "T", None, False), ("2", "T", "d1", False), ("3", "U", None, False), ("4", "T", None, True), ("5", "none", None, False)], "query_id string, ticker string, doc_id string, coverage boolean")
    asked = spark.createDataFrame([("1", "storm at sea", 2), ("2", "new law", 5), ("3", "law", 9), ("4", "sea storm", 2), ("5", "sea", 2)], "query_id string, query string, k int")
    got = {}
    for r in search.retriever(indexed, about, EMBED, EMBED.model)(asked).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
        assert r.text == texts[int(r.chunk_id[1:])] and r.section == "Item 7"
    assert got["1"][0] in ("k1", "k5") and len(got["1"]) == 2
    assert sorted(got["2"]) == ["k1", "k4", "k7"] and got["2"][0] == "k4"
    assert sorted(got["3"]) == ["k6", "k7"] and len(got["4"]) == 2 and "5" not in got


def test_refinement_rounds(spark):
    """Rewrites, expansions to the bound, a failing judge; every judgement is asked for once."""

    class Counted(answers.RuleProvider):
        """Rewrites the first question, expands the second for ever, fails on the third; counts its calls."""

        def __init__(self, calls):
            self.calls = calls

        def assess(self, question, previews):
            self.calls.add(1)
            if "third" in question:
                raise RuntimeError("down")
            return {"decision": "REWRITE", "new_query": " law " if "sea" not in question else ""} if "first" in question else {"decision": "EXPAND"}

    _, chunks = corpus(spark)
    calls = spark.sparkContext.accumulator(0)
    q = spark.createDataFrame([("1", "T", "first cloud"), ("2", "T", "second sea"), ("3", "T", "third sea"), ("4", "T", "first sea")], "query_id string, ticker string, question string")
    retrieve = search.retriever(search.index(chunks, EMBED, EMBED.model), q.select("query_id", "ticker"), EMBED, EMBED.model)
    hits, asked = answers.refinement(q.withColumn("k", F.lit(2)), retrieve, Counted(calls))
    got = {}
    for r in asked.orderBy("query_id", "round").collect():
        got.setdefault(r.query_id, []).append((r.query, r.k, r.decision))
    assert got["1"] == [("first cloud", 2, "REWRITE"), ("law", 2, "REWRITE"), ("law", 2, None)]
    assert got["2"] == [("second sea", 2, "EXPAND"), ("second sea", 4, "EXPAND"), ("second sea", 8, None)]
    assert got["3"] == [("third sea", 2, "ENOUGH")]
    assert got["4"] == [("first sea", 2, "REWRITE"), ("first sea", 4, "REWRITE"), ("first sea", 8, None)]  # a rewrite without a query expands
    hits.count()
    answers.chosen(hits).count()
    assert calls.value == 7
    # the last round's chunks come first
    last = [r.chunk_id for r in hits.where("query_id = '1' and round = 3").orderBy("place").collect()]
    assert [r.chunk_id for r in answers.chosen(hits).where("query_id = '1'").orderBy("place").collect()] == last


def test_digest_fails_softly(spark):
    """Four sections in order whatever fails: an error is shown, an unusable answer earns one more attempt; figures are no condition."""

    class Failing(answers.RuleProvider):
        def generate(self, question, chunks, feedback="", figures=""):
            if "risk" in question:
                raise RuntimeError("API down")
            if "profit" in question and not feedback:
                raise digest.Unusable("no claims")
            if "business" in question:
                raise digest.Unusable("never")
            return [{"text": f"on {question[:5]}" + " again" * bool(feedback), "cited": [chunks[0][0], "unknown"], "kind": "odd"}]

        def verify(self, claims_):
            return [{"claim_id": c["claim_id"], "verdict": "SUPPORTED", "reason": ""} for c in claims_]

    _, chunks = corpus(spark)
    companies = spark.createDataFrame([(1, " t "), (2, "U"), (3, "V")], "cik long, ticker string")
    tasks = digest.tasks(companies)
    assert tasks.count() == 12 and tasks.select("query_id").distinct().count() == 12
    retrieve = search.retriever(search.index(chunks, EMBED, EMBED.model), tasks.select("query_id", "ticker"), EMBED, EMBED.model)
    parts = digest.sections(companies, retrieve, Failing())
    figures = spark.createDataFrame([("T", i, f"T figure {i}") for i in range(5)], "ticker string, place int, text string")
    got = {r.ticker: r for r in digest.digest(companies, parts, figures).collect()}
    t = got["T"].sections
    assert [s.key for s in t] == [k for k, _, _ in digest.SECTIONS] and got["T"].figures == [f"T figure {i}" for i in range(5)]
    assert (t[0].error, t[0].attempt) == ("Unusable: never", 2) and (t[1].error, t[1].attempt, t[1].summary) == (None, 2, "on How d again")
    assert (t[2].error, t[2].attempt, t[2].summary) == ("RuntimeError: API down", 1, None) and t[3].summary == "on Which" and t[3].displayed == 1
    assert got["T"].sections_ok == got["T"].sections_failed == 2
    assert got["T"].summary == "T figure 0 | T figure 1 | T figure 2 | How the last fiscal year went: on How d again | What management emphasizes: on Which"
    assert [s.summary for s in got["V"].sections] == [answers.UNANSWERED] * 4 and got["V"].figures == [] and got["V"].sections_failed == 0
    assert digest.digest(companies, parts).where("size(figures) > 0").count() == 0


@pytest.mark.parametrize("text", ["", "Sea", "sea SEA storm", "été"])
def test_hashed_words(text):
    a, b = search.HashedWords(8)([text, text.upper() if text.isascii() else text])
    assert (a == b).all() and abs(a).sum() <= len(text.split()) * (2 if not text.isascii() else 1) + 1


class Reader(__import__("html.parser").parser.HTMLParser):
    """Page text by the standard library's parser, event by event."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)

    BLOCKS = frozenset("p div tr table br li h1 h2 h3 h4 h5 h6".split())


def test_page_text_as_the_parser_reads_it(spark):
    """Every page of a test table, and odd ones: quoted signs, what never closes, all kinds of character references."""
    odd = ['<p title="a > b">x</p>y', "<p title='a > b' c=d>x", "<script>var a='<p>';</script>z", "a<script>never closed <p>x", "<style>x</style >t", "a <!-- c > d --> b", "a < b & c", "1 <2> 3"]
    odd += ["&#8217;&#8220;x&#8221;&#8212;&nbsp;y&hellip;", "&notit; &#0; &#x110000; &#128; &amp;lt;b&amp;gt; &#X41;&#65", "<br/>x<BR>y<Li>z", "<!DOCTYPE html><p>a", "<?xml a?>b", "<a href=x>y</a>", "<div\nclass='a>b'\n>t", "x\x85", "<p/>q", "<scripty>x</scripty>"]
    odd += ["&amp x &quot;", "<table><tr><td>1</td><td>2</td></tr></table>", "a\n\n\n\n b \t c\n", "<p " + "a=1 " * 20_000 + ">x", "<p " + "=" * 50_000 + ">x", "", "no markup"]
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()] if __import__("os").path.exists("/root/testdata/sf0.001") else []

    def want(page):
        import re

        reader = Reader()
        reader.feed(page)
        reader.close()
        text = re.sub(r"[ \t]+", " ", "".join(reader.out).replace("\xa0", " "))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text)).strip()

    from ledgerlens.sources import filings

    rows = list(enumerate([*odd, *pages]))
    got = {r.i: r.t for r in spark.createDataFrame([*rows, (9999, None)], "i int, h string").select("i", filings.page_text(F.col("h")).alias("t")).collect()}
    assert got.pop(9999) is None
    for i, page in rows:
        assert got[i] == want(page), page[:200]
    # browsers end what never closes where the page ends
    assert spark.range(1).select(filings.page_text(F.lit("a <!-- open <p>b"))).first()[0] == "a"
