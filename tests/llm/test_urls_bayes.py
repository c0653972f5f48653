"""Naive Bayes of urls against a plain one, on names without a seed word, and segmentation with a large lexicon."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from ballotlake.llm import queries, urls
from ballotlake.llm.common import table

_RUN = re.compile(r"[^\W\d_]+")


def plain(rows, lexicon, bad):
    """page_id: score, by dictionaries over whole words."""
    counts = Counter(w for text in lexicon for w in _RUN.findall((text or "").lower()))
    total = sum(counts.values())
    for w in urls.SEED_WORDS:
        counts[w] += max(1, total // 100_000)
    tokens, label = {}, {}
    for page_id, url in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1], m[2]) if m else ("", "")
        names = host.split(".")
        own = [f"tld:{names[-1]}"] if host else []
        said = [w for n in names[:-1] or names for part in _RUN.findall(n.lower()) for w in urls.split(part, counts, total)]
        below = [w for part in _RUN.findall(path.lower()) for w in urls.split(part, counts, total)]
        tokens[page_id] = own + said + [f"path:{w}" for w in below]
        label[page_id] = bad[page_id] or not set(urls.SEED_WORDS).isdisjoint(said + below)
    by = {k: Counter(t for i, own in tokens.items() if label[i] == k for t in own) for k in (True, False)}
    size = len(by[True] | by[False])
    share = {k: (lambda t, k=k: math.log((by[k][t] + urls.SMOOTH) / (sum(by[k].values()) + urls.SMOOTH * size))) for k in by}
    prior = math.log((sum(label.values()) + 1) / (len(label) - sum(label.values()) + 1))
    return {i: 1 / (1 + math.exp(-(prior + sum(share[True](t) - share[False](t) for t in own)))) for i, own in tokens.items()}, tokens


def test_scores_equal_a_plain_classifier(spark, data):
    pages = table(spark, data.replace("sf0.001", "sf0.01"), "pages")
    rows = pages.select("page_id", "url", urls.symbols(F.col("html")).alias("bad"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title")).collect()
    lexicon = [re.sub(r"^.*?://[^/?#]*", "", r.url or "") + " " + r.title for r in rows]
    want, tokens = plain([(r.page_id, r.url) for r in rows], lexicon, {r.page_id: r.bad for r in rows})
    got = queries.op2_url_filter(spark, data.replace("sf0.001", "sf0.01")).collect()
    assert {r.page_id: r.words.split(" ") for r in got} == tokens
    for r in got:
        assert r.score == pytest.approx(want[r.page_id], abs=1e-6)
    assert 0 < sum(r.bad for r in rows) < len(rows) / 2


def test_names_without_a_seed_word(spark):
    good = [f"http://{a}{b}.org/{c}" for a in ("garden", "history", "music") for b in ("house", "school", "club") for c in ("about", "news", "a1")]
    bad = [f"http://{a}{b}.org/{c}" for a in ("casino", "poker") for b in ("lotto", "spins") for c in ("deal", "join", "now")] * 3
    rows = [(i, u) for i, u in enumerate([*good, *bad, "http://lottospins.org/join", "http://gardenclub.org/join"])]
    lexicon = spark.createDataFrame([("garden house school club history music lotto spins about news deal join now",)] * 3, "words string")
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), lexicon).collect()}
    odd, plain_one = got[len(rows) - 2], got[len(rows) - 1]
    assert odd.words == ["tld:org", "lotto", "spins", "path:join"] and odd.verdict == "block"
    assert plain_one.verdict == "allow"


def test_evidence_of_pages_is_learned(spark):
    rows = [(i, f"http://{'murky' if i % 2 else 'clear'}.org/x", "| # " * 30 if i % 2 and i < 20 else "plain words here") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, None, urls.symbols(F.col("html"))).collect()}
    assert got[21] == "block" and got[20] == "allow"


def test_segments_among_a_million_words(spark):
    noise = spark.range(1_200_000).select(F.concat_ws(" ", F.translate(F.conv(F.col("id").cast("string"), 10, 26), "0123456789", "qrstuvwxyz")).alias("words"))
    common = spark.createDataFrame([("river bank cloud market street",)] * 4000 + [("unbelievablylongcompoundwords",)], "words string")
    rows = [(1, "http://riverbank.org/cloudmarket/streetunbelievablylongcompoundwordsbank")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), noise.unionByName(common)).first().words
    assert got == ["tld:org", "river", "bank", "path:cloud", "path:market", "path:street", "path:unbelievablylongcompoundwords", "path:bank"]


def test_frequent_names_by_broadcast_and_others_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urls, "HOT", 3)
    rows = [(i, f"http://www.name{'x' * (i % 5)}.org/p{'q' * (i % 7)}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    one = sorted(map(str, urls.judge(pages).collect()))
    monkeypatch.setattr(urls, "HOT", 50_000)
    assert one == sorted(map(str, urls.judge(pages).collect()))


def test_a_name_of_a_hundred_thousand_different_letters(spark):
    draw = random.Random(6)
    name = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    pages = spark.createDataFrame([(1, f"http://a.org/{name}riverbank"), (2, "http://river.org/bank"), (3, f"http://a.org/{name[:40_000]}")], "page_id long, url string")
    got = {r.page_id: r.words for r in urls.judge(pages).collect()}
    assert "".join(w.removeprefix("path:") for w in got[1][2:]) == name + "riverbank" and got[2] == ["tld:org", "river", "path:bank"]
    assert sum(len(rows) for rows in urls._substrings([pa.RecordBatch.from_pydict({"id": [1], "name": [name]})])) <= urls.WINDOW * len(name)
