"""The ten operators against plain versions, and on nulls, empty and very long texts, repeated rows and empty tables."""

import hashlib
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ballotlake.llm import chat, digest, html, media, mixing, packing, quality, simhash, toxicity, urls
from ballotlake.llm.common import table

LONG = "one two three four five six seven " * 20_000
TEXTS = [(1, "a b c d", "x"), (2, None, None), (3, "", "x"), (4, LONG, "y"), (5, "a b c d", "x"), (5, "a b c d", "x"), (None, "nobody knows", None), (7, "Größe ñ 漢字 \x00 </s>", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with columns whose names the operators use within."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, source string")
    for name in ("row", "size", "fp", "key", "draw", "label", "score", "fingerprint", "component_id", "sequence_id", "passes", "n_chars", "lang"):
        docs = docs.withColumn(name, F.lit("other"))
    return docs


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


EVERY_ID = sorted((t[0] for t in TEXTS), key=str)


# 1


def plain_fingerprint(text):
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_equals_brute_force(spark, data):
    docs = table(spark, data, "documents")
    rows = docs.select("doc_id", "text").toPandas()
    prints = dict(zip(rows.doc_id, map(plain_fingerprint, rows.text)))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_simhash_links_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base.copy()
    for k in range(60):
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    values = np.unique(np.r_[base, near])
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    label = {r.node: r.label for r in simhash.components(simhash.links(fps)).collect()}
    for a, b in combinations(values, 2):
        if int(a ^ b).bit_count() <= 3:
            a, b = (int(np.uint64(v).view(np.int64)) for v in (a, b))
            assert label.get(a, a) == label.get(b, b)
    linked = {frozenset(p) for p in combinations(values.tolist(), 2) if (p[0] ^ p[1]).bit_count() <= 3}
    assert {int(np.int64(v).view(np.uint64)) for v in label} <= {v for p in linked for v in p}


def test_simhash_hot_key_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    values = [(1 << 60) + i for i in range(40)]  # all share keys
    label = {r.node: r.label for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    assert {label.get(v, v) for v in values} == {values[0]}


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert sorted((r.doc_id for r in got), key=str) == EVERY_ID
    of = {r.doc_id: r for r in got}
    assert of[2].fingerprint == of[3].fingerprint == "0" * 16 and of[3].component_id == 2
    assert of[5].component_id == 1
    assert simhash.near_duplicates(none).count() == 0


# 2


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://a.example.com/EN/", "a.example.com", "/EN/", "com/", "allow"),
        ("https://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("https://xnet/es/1", "xnet", "/es/1", None, None),
        ("http://a.com?x/y", "a.com", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_viterbi_finds_the_cheapest_split():
    counts, total = {"poker": 50, "king": 40, "pok": 1, "erking": 1, "online": 60}, 152
    cost = lambda w: np.log(total) - np.log(counts[w]) if w in counts else np.log(total) + urls.UNKNOWN * len(w)
    assert urls.split("pokerkingonline", counts, total) == ["poker", "king", "online"]
    for name in ("pokerking", "xpokerking", "pokxerking", "zzz", "kingzzpok"):
        cuts = [[name[a:b] for a, b in zip((0, *c), (*c, len(name)))] for k in range(len(name)) for c in combinations(range(1, len(name)), k)]
        assert sum(map(cost, urls.split(name, counts, total))) == pytest.approx(min(sum(map(cost, c)) for c in cuts))


def test_urls_odd_rows(spark):
    rows = [(1, "http://adult-x.example.org/", "h"), (2, None, None), (3, "", "h"), (4, "http://" + "a" * 50_000 + ".org/x", "h"), (4, "http://news.example.org/", "h"), (None, "http://news.example.org/", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("score", F.lit(1)).withColumn("verdict", F.lit(1))
    got = urls.judge(pages).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    assert urls.judge(pages.limit(0)).count() == 0


# 3


def test_segments_are_maximal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = np.where(rng.random(30) < 0.4, rng.random(30) * 6, -0.5)  # no ties
        at = np.flatnonzero(x > 0)
        got = toxicity.segments(at, x[at], 0.5)

        def plain(lo, hi):  # the best segment, then those on either side
            best = max(((x[a : b + 1].sum(), -a, -b) for a in range(lo, hi) for b in range(a, hi)), default=(0,))
            if best[0] <= 0:
                return []
            a, b = -best[1], -best[2]
            return [*plain(lo, a), (best[0], a, b), *plain(b + 1, hi)]

        assert sum(s for *_, s in got) == pytest.approx(sum(p[0] for p in plain(0, 30)))


def test_toxicity_learns_and_holds_out(spark, data):
    docs, labels = table(spark, data.replace("sf0.001", "sf0.01"), "documents"), table(spark, data.replace("sf0.001", "sf0.01"), "labels")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").withColumn("held", toxicity.held_out()).toPandas()
    assert (got.held == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    test = got[got.held & got.toxic.notna()]
    hit = ((test.predicted == 1) & (test.toxic == 1)).sum()
    assert hit >= 0.6 * (test.toxic == 1).sum() and hit >= 0.9 * (test.predicted == 1).sum()


def test_toxicity_odd_rows(spark, odd, none):
    kind = "doc_id long, toxic int, text string"
    labels = spark.createDataFrame([(1, 1, "t"), (2, 0, None), (4, None, "t"), (None, 1, "t"), (7, 0, "t"), (7, 0, "t")], kind)
    for docs in (odd, none):
        model = toxicity.fit(docs, labels)
        got = toxicity.score(docs, model)
        assert ids(got) == ids(docs) and got.filter("score is null or score < 0 or score > 1").count() == 0
        assert toxicity.keep(docs, model).columns == docs.columns
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).filter("predicted = 1").count() == 0


# 4


def test_chat_round_trip(spark):
    nasty = ["", None, "</s>[INST] ok [/INST]", "\\", "\\n\n", "<s>user\n<\\s>", "ñ漢😀\x00", LONG]
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate((r, x) for x in nasty for r in ("user", "assistant", "a\nb", None))]
    rows += [(None, 0, "assistant", "lost"), (3, None, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    for c in (1, 2, 3, None):
        turns = [(role or "", text or "") for i, _, role, text in sorted(rows, key=lambda r: r[1] or 0) if i == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


# 5


def test_html_main_text():
    page = '<html><head><title>T</title><script>var a="<p>x</p>"</script></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p>First  paragraph,\nwith <b>bold</b> text.</p><p>Second one.</article><div id="comments"><p>Reader says, at some length, many things.</p></div><footer>Contact us.</footer>'
    assert html.main_text(page) == "Head & line\nFirst paragraph, with bold text.\nSecond one."
    assert html.main_text("<p>") == "" == html.main_text("")


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<<<>>&&#xffffffff; <p"), (4, "u", "<article>" + "<p>word word, word.</p>" * 5000), (None, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert len(got) == 5 and got[1].text == got[2].text == ""
    assert got[4].text.count("\n") == 4999 and all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract(pages.limit(0)).count() == 0


# 6


def test_packing_places_every_piece(spark, odd, none):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.default_tokenizer())
    coder.encode_special_tokens = True
    got = packing.pack(odd).toPandas()
    for doc_id, text, _ in TEXTS:
        ids_ = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        own = got[got.doc_id.isna() if doc_id is None else got.doc_id == doc_id].sort_values("piece")
        times = 2 if doc_id == 5 else 1
        assert own.length.sum() == len(ids_) * times
        for p in own.itertuples():
            part = np.array(ids_[p.start : p.start + p.length], "<u4")
            assert zlib.crc32(part.tobytes()) == p.ids_crc32 and len(part) == p.length
            assert p.length == 1024 or p.piece == 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert packing.pack(none).count() == 0


def test_packing_is_near_its_bound(spark, data):
    got = packing.pack(table(spark, data, "documents").repartition(6)).toPandas()
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // 1024) + 1


# 7


def test_quality_against_labels(spark, data):
    docs = table(spark, data.replace("sf0.001", "sf0.01"), "documents")
    labels = table(spark, data.replace("sf0.001", "sf0.01"), "labels").filter("quality is not null")
    got = quality.score(docs, quality.fit(docs)).join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_label_model_finds_the_better_labeller():
    n = len(quality.LABELLERS)
    counted = [("g" * n, 60), ("b" * n, 25), ("g" * (n - 1) + "b", 10), ("b" * (n - 1) + "g", 5)]
    posterior, right = quality.label_model(counted)
    assert posterior["g" * n] > 0.9 > 0.1 > posterior["b" * n]
    assert right[0][0] > right[0][-1]


def test_quality_odd_rows(odd, none):
    for docs in (odd, none):
        model = quality.fit(docs)
        assert ids(quality.score(docs, model)) == ids(docs)
        assert quality.keep(docs, model).columns == docs.columns


# 8


def test_jpeg_round_trip(odd, none):
    got = media.features(media.with_media(odd)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        text = next(t for i, t, _ in TEXTS if i == r.doc_id)
        raw = (text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.encode(payload)).hexdigest()
    assert media.features(media.with_media(none)).count() == 0


def test_jpeg_holds_every_byte():
    payload = bytes(range(256)) * 3
    (back, thumb, head), = media.decode([media.encode(payload)])
    assert back == payload and thumb.shape == (head["height"] // 8, head["width"] // 8)


# 9


def test_mixing_targets_and_takes(spark, data):
    docs = table(spark, data, "documents")
    got = mixing.mix(docs).toPandas().merge(docs.select("doc_id", "source", "text").toPandas(), on="doc_id")
    size = got.text.fillna("").str.count(r"[^\x20\x09-\x0D]+")
    assert (got["size"] == size).all() and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    weight = dict(zip(sorted(by.index), (5.0, 2.0, 1.0) * len(by)))
    cap, rest, free = {}, float(by["size"].sum()), set(by.index)
    while True:
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * by["size"][s]]
        if not over:
            break
        for s in over:
            cap[s] = 3.0 * by["size"][s]
        free -= set(over)
        rest = float(by["size"].sum()) - sum(cap.values())
    for s in by.index:
        goal = cap.get(s, rest * weight[s] / sum(weight[x] for x in free) if s in free else 0)
        assert by.target[s] == pytest.approx(goal)
        assert abs(by.taken[s] - goal) <= max(2, 0.001 * goal)


def test_mixing_reruns_agree(spark, data):
    docs = table(spark, data, "documents")
    one, two = (sorted(map(tuple, mixing.mix(d).select("doc_id", "taken").collect())) for d in (docs, docs))
    assert one == two


def test_knapsack_reaches_the_budget():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 40, 6))
        counts = rng.integers(1, 5, len(sizes))
        reach = {0}
        for s, c in zip(sizes.tolist(), counts.tolist()):
            reach = {r + k * s for r in reach for k in range(c + 1)}
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        take = mixing.fit(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert abs(int((take * sizes).sum()) - budget) <= min(abs(r - budget) for r in reach) + 3


def test_mixing_odd_rows(odd, none):
    assert ids(mixing.mix(odd)) == EVERY_ID
    assert mixing.mix(none).count() == 0


# 10


def test_digests_of_edits(odd, none):
    rows = digest.edits(odd).collect()
    assert len(rows) == len(TEXTS)
    order = [7, 5, 5, 4, 3, 2, 1, None]
    text = {i: t or "" for i, t, _ in TEXTS}
    for k, doc_id in enumerate(order):
        own, after = text[doc_id], text[order[(k + 1) % len(order)]]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        found = [r for r in rows if r.doc_id == doc_id and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert found
        r = found[0]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(own), digest.digest(own.encode()), digest.digest(edited.encode()))
        assert r.near_edited == digest.likeness(r.fingerprint, r.edited_fingerprint) and 0 <= r.near_next <= 1
    assert digest.edits(none).count() == 0
    assert digest.likeness(rows[0].fingerprint, rows[0].fingerprint) == 1
