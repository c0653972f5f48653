"""op11 to op13 against their SQL, against plain versions, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotlake.llm import infill, manifest, queries, vectors
from ballotlake.llm.common import table

NAMES = ("op11_manifest", "op12_infill", "op13_vectors")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, data)
    columns = sorted(ours.columns)
    sql = con.execute(queries.ORACLE[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == columns
    assert Counter(tuple(r[names.index(c)] for c in columns) for r in sql.fetchall()) == Counter(tuple(r[c] for c in columns) for r in ours.collect())


# 11


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(hashes):
    """Root, and for each leaf its siblings on either side, level by level."""
    paths, level, groups = [[] for _ in hashes], list(hashes), [[i] for i in range(len(hashes))]
    while len(level) > 1:
        up, merged = [], []
        for at in range(0, len(level), 8):
            run = level[at : at + 8]
            for k, own in enumerate(groups[at : at + 8]):
                for i in own:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            merged.append(sum(groups[at : at + 8], []))
        level, groups = up, merged
    return level[0], paths


def plain_manifest(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: (sorted(langs[x], key=lambda t: t[:3]), *plain_tree([t[2] for t in sorted(langs[x], key=lambda t: t[:3])])) for x in order}
    root, tops = plain_tree([trees[x][1] for x in order])
    out = []
    for lang, top in zip(order, tops):
        leaves, subroot, paths = trees[lang]
        for (_, _, leaf, r), path in zip(leaves, paths):
            whole = path + top
            folded = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                folded = plain_leaf(r, r["text"] and re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
            for left, right in whole:
                folded = sha(left, folded, right)
            out.append((r["doc_id"], leaf, subroot, root, sha(*(a + b for a, b in whole)), folded, folded == root))
    return Counter(out)


def as_manifest(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in queries.op11_manifest(spark, str(tmp_path)).collect())


DOCS = "doc_id long, source string, lang string, n_chars long, text string, hash string, grp string, rank long"


def test_manifest_equals_plain_version_on_awkward_rows(spark, tmp_path):
    """Null fields, a null lang, languages of one leaf, nine and 65 leaves, repeated rows and ids, clashing columns."""
    rows = [(None, None, None, None, None), (1, "", None, 0, ""), (7, "x", "solo", 3, "ABC"), (7, "x", "é", 3, "Ünder ÀB"), (9, "x", "é", 3, None)]
    rows += [(k, "s", "nine", 4, f"Text {k} Q") for k in range(9)] + [(k // 2, None, "many", 4, "Same TEXT" * (k % 3)) for k in range(65)] + [(5, "s", "copies", 1, "C")] * 70
    rows = [(*r, "h", "g", 1) for r in rows]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert as_manifest(spark, docs, tmp_path) == plain_manifest([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows])


def test_manifest_of_nothing_and_of_one(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    assert as_manifest(spark, none, tmp_path / "none") == Counter()
    one = (3, "s", "en", 1, "A", "h", "g", 1)
    assert as_manifest(spark, spark.createDataFrame([one], DOCS), tmp_path / "one") == plain_manifest([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), one))])


def test_nodes_carry_the_ranks_they_cover(spark):
    leaves = spark.range(20).select(F.lit("a").alias("grp"), F.col("id").alias("rank"), F.lit(20).cast("long").alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.struct(F.col("id").alias("doc_id"), F.lit("").alias("changed")).alias("body"))
    found = manifest.levels(leaves)
    assert [sorted((r.lo, r.hi, r.root) for r in x.collect()) for x in found] == [[(0, 7, False), (8, 15, False), (16, 19, False)], [(0, 19, True)]]


# 12

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("block", [1, 4, infill.BLOCK])
def test_units_are_the_pattern_s(monkeypatch, block):
    monkeypatch.setattr(infill, "BLOCK", block)
    draw = np.random.default_rng(3)
    letters = ["a", " ", "\t", "\r", "\x0e", "\x08", "é", "漢", "😀", "\x00", "\x7f", "\x1f", "\xa0", "  "]
    for size in [0, 1, 7, 8, 9, 15, 16, 17, 63, 64, 65] * 20:
        text = "".join(draw.choice(letters, size))
        tokens = UNIT.findall(text)
        units = infill.Units(text.encode())
        assert units.n == len(tokens)
        assert [units.place(k) for k in range(units.n + 1)] == [len("".join(tokens[:k]).encode()) for k in range(units.n + 1)]
        assert infill.points(text.encode()) == len(text)


def test_infill_on_awkward_rows(spark):
    long = "wörd\t " * 400_000
    rows = [(1, None), (2, ""), (3, "holds <S> itself"), (None, "nobody knows this one"), (4, long), (4, long), (5, " \n "), (6, "one")] + [(k, f"a b c {k} <P ") for k in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("x")).withColumn("form", F.lit("y"))
    made = infill.restore(infill.transform(docs)).collect()
    assert Counter((r.doc_id, r.restored) for r in made) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in made if r.doc_id in (1, 2, 3)} == {"plain"} and {r.form for r in made} == {"plain", "psm", "spm"}
    for r in made:
        text = dict(rows)[r.doc_id] or ""
        assert r.n == len(UNIT.findall(text))
        assert (r.prefix_chars is None) == (r.form == "plain")
        if r.form != "plain":
            a, b = r.prefix_chars, r.prefix_chars + r.middle_chars
            pre, mid, suf = text[:a], text[a:b], text[b:]
            assert r.output == (f"<S>{suf}<P>{pre}<M>{mid}" if r.form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}")
    assert infill.restore(infill.transform(docs.limit(0))).count() == 0


def test_infill_takes_its_rates(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    forms = Counter(r.form for r in infill.transform(docs, rate=0.9, spm=0.5, seed=7, markers=("[p]", "[s]", "[m]")).collect())
    assert 150 < forms["plain"] < 250 and 800 < forms["spm"] < 1000
    assert {r.form for r in infill.transform(docs, rate=0.0).collect()} == {"plain"}


# 13


def plain_links(rows, threshold=0.93):
    """n_links, component_id and kept of each row (vec_id, vector, label), by all pairs."""

    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = {i: set() for i in range(len(rows))}
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and a is not None and a == b and fine(v) and fine(w) and len(v) == len(w):
                x, y = np.array(v) / max(map(abs, v)), np.array(w) / max(map(abs, w))
                if math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= threshold:
                    links[i].add(j)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, open_ = {i}, [i]
        while open_:
            new = links[open_.pop()] - seen
            seen |= new
            open_ += new
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((vec, len(links[i]), least, vec is not None and vec == least))
    return Counter(out)


SCHEMA = "vec_id long, embedding array<double>, label int, node long, n long, e string"


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "e") for r in rows], SCHEMA)
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())


@pytest.mark.parametrize("tile", [4, vectors.TILE])
def test_vectors_equal_all_pairs(spark, monkeypatch, tile):
    """Copies, chains, near ones, labels apart, and vectors that link with nothing; small tiles cut cells and make many pairs."""
    monkeypatch.setattr(vectors, "TILE", tile)
    draw = np.random.default_rng(5)
    base = draw.normal(size=(12, 16))
    rows = [(100 + k, (base[k % 12] + draw.normal(size=16) * (0.1 + 0.15 * (k % 3))).tolist(), k % 2) for k in range(120)]
    rows += [(300 + k, base[0].tolist(), 0) for k in range(9)] + [(7, base[1].tolist(), None), (8, None, 0), (9, [0.0] * 16, 0), (10, [], 0), (11, [float("nan")] * 16, 0)]
    rows += [(12, [None, *base[0][1:].tolist()], 0), (13, [1.0, 2.0], 0), (14, [2.0, 4.0], 0), (15, [float("inf"), 1.0], 0), (16, [1e-300, 2e-300], 0), (17, [1e300, 2e300], 0), (None, base[2].tolist(), 0), (300, (base[3] * 7).tolist(), 1)]
    assert found(spark, rows) == plain_links(rows)


def test_chains_reach_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 4)
    step = math.acos(0.94)
    rows = [(k, [math.cos(k * step), math.sin(k * step)], 1) for k in range(15)]
    assert found(spark, rows) == plain_links(rows)
    assert {r[2] for r in found(spark, rows)} == {0}


def test_no_vectors(spark):
    assert found(spark, []) == Counter()
    assert found(spark, [(1, None, 1), (2, [0.0], None)]) == Counter([(1, 0, 1, True), (2, 0, 2, True)])


def test_early_stop_loses_no_pair():
    draw = np.random.default_rng(8)
    a = vectors.unit(draw.normal(size=(300, 64)))
    b = vectors.unit(np.concatenate([a[:40] + 0.03 * draw.normal(size=(40, 64)), draw.normal(size=(200, 64))]))
    i, j, sums = vectors.reaching(a, b, 0.93)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.93))))
    assert np.allclose(sums, (a @ b.T)[i, j])


def test_vectors_of_the_table_equal_all_pairs(spark, data):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, data, "embeddings").collect()]
    ours = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.op13_vectors(spark, data).collect())
    assert ours == plain_links(rows)
