"""URL filtering: rules first, then naive Bayes over words that a unigram Viterbi finds in host and path.

Everything counted is exact and stays in tables: a name meets the counts of the substrings that it has by a join, is
split once however many urls hold it, and its words' odds come back by a join. Names and words that many urls
share are looked up by broadcast, of which there are at most HOT; the others by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (host, path, verdict). A rule fits its host and all subdomains where the path starts with its path.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Fixed words that mark a site to block: one of the two kinds of weak label.
SEED_WORDS = ("adult", "bet", "bets", "betting", "bonus", "casino", "cheap", "crack", "escort", "free", "gambling", "jackpot", "loan", "loans", "nude", "pharma", "pills", "poker", "porn", "replica", "roulette", "sex", "slots", "torrent", "viagra", "warez", "win", "xxx")
SMOOTH = 0.1  # added to each token's count in each class
HOT = 50_000  # a name or word with more than this part of all uses is looked up by broadcast: at most so many are
WINDOW = 24  # letters of the substrings that meet the lexicon; longer words are found by their first so many letters
SALTS = 16  # parts of the lexicon's words of up to four letters, which most names hold
_LETTERS = r"(\p{L}+)"


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    whole = F.coalesce(url, F.lit(""))
    host, path = (F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)([^?#]*)", k) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct rule, verdict of the longest rule that fits, host and path together; of equal ones that with the longer host."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    return F.coalesce(*(F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in order), F.lit(None).cast("struct<rule:string,verdict:string>"))


def symbols(html: Column, share: float = 0.3) -> Column:
    """Whether a page's visible text has so many symbols a word that it is no prose: the other kind of weak label."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    return F.coalesce(F.regexp_count(text, F.lit(r"[|#$%*^~={}\\]|&amp;")) > share * F.regexp_count(text, F.lit(r"\S+")), F.lit(False))


UNKNOWN = 2.5  # what each letter of a word without a count costs


def split(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely unigram split of a name, whose words with a count are given."""
    lengths = sorted({len(w) for w in counts})
    log_total = math.log(max(2, total))
    best, back, begin = [0.0], [0], 0  # begin: where a word without a count that ends here starts best
    for end in range(1, len(name) + 1):
        if best[end - 1] - UNKNOWN * (end - 1) < best[begin] - UNKNOWN * begin:
            begin = end - 1
        cost, start = best[begin] + log_total + UNKNOWN * (end - begin), begin
        for k in lengths:
            if k > end:
                break
            n = counts.get(name[end - k : end])
            if n and (known := best[end - k] + log_total - math.log(n)) < cost:
                cost, start = known, end - k
        best.append(cost)
        back.append(start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n: how often the texts (one string column) hold each run of letters, lower-cased."""
    words = F.explode(F.regexp_extract_all(F.lower(texts.columns[0]), F.lit(_LETTERS)))
    return texts.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, name) the distinct substrings of up to WINDOW letters, under the name's number: linear in its letters."""
    for batch in batches:
        for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = list({name[i : i + k] for k in range(1, WINDOW + 1) for i in range(len(name) - k + 1)})
            for at in range(0, len(own), 100_000):
                part = own[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), pa.array(part)], ["id", "word"])


def segment(names: DataFrame, lexicon: DataFrame, total: int) -> DataFrame:
    """name, words: each distinct name (id, name; written) split by a lexicon of word, n whose counts add up to total.

    Names stay where they are: what travels is their substrings, each under the name's number, and back come the words among
    them that have a count. Of a word longer than WINDOW its first letters travel, and the name itself tells if it holds it.
    """
    short = F.length("word") <= 4
    salted = lexicon.withColumn("salt", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    has = names.select("id", "name").mapInArrow(_substrings, "id long, word string")
    has = has.withColumn("salt", F.when(short, F.pmod(F.hash("id"), F.lit(SALTS))).otherwise(0))
    known = has.join(salted.filter(F.length("word") <= WINDOW), ["word", "salt"]).select("id", "word", "n")
    tails = lexicon.filter(F.length("word") > WINDOW).select(F.col("word").alias("whole"), "n", F.substring("word", 1, WINDOW).alias("word"))
    long = has.filter(F.length("word") == WINDOW).join(tails, "word").select("id", F.col("whole").alias("word"), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_pylist()
            words = [split(name, {x["word"]: x["n"] for x in own or () if len(x["word"]) <= WINDOW or x["word"] in name}, total) for name, own in zip(batch.column(0).to_pylist(), held)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    # a name's own words meet: their number is that of the name's letters times WINDOW at most
    own = known.unionByName(long).groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("own"))
    return names.select("id", "name").join(own, "id", "left").select("name", "own").mapInArrow(run, "name string, words array<string>")


def _look_up(rows: DataFrame, values: DataFrame, key: str, uses: int) -> DataFrame:
    """rows joined with values (unique keys, and n: each key's number of rows); uses: all rows."""
    hot = F.col("n") > uses / HOT
    often = F.broadcast(values.filter(hot).drop("n"))
    return rows.join(often, key).unionByName(rows.join(F.broadcast(values.filter(hot).select(key)), key, "left_anti").join(values.filter(~hot).drop("n"), key))


def _of_kind(kind: str):
    return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def judge(pages: DataFrame, lexicon: DataFrame | None = None, evidence: Column | None = None, rules=RULES, seed_words=SEED_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score, words of every row of pages (page_id, url, any others).

    lexicon: one string column whose words (in all rows) the segmenter knows; by default the urls' own.
    Where no rule fits, naive Bayes gives the verdict: block if the score, its probability of block, is over
    a half. It learns from all urls: block are those with a seed word among their words, and those whose
    page the evidence (a boolean column of pages) speaks against; rules are a policy and no labels. An
    empty table gives no row; a null url or one without letters has no tokens and falls to the prior's side.
    Names of any length are split; repeated rows and ids keep a row each and count each.
    """
    host, path = address(F.col("url"))
    bad = F.coalesce(evidence, F.lit(False)) if evidence is not None else F.lit(False)
    parts = pages.select(F.col("page_id").cast("long"), "url", bad.alias("bad")).withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    sites = F.when(F.size(labels) > 1, F.slice(labels, F.lit(1), F.size(labels) - 1)).otherwise(labels)
    found = lambda text: F.regexp_extract_all(F.lower(text), F.lit(_LETTERS))
    kinds = (("tld", F.when(F.col("host") != "", F.array(F.element_at(labels, -1))).otherwise(F.array())), ("host", found(F.array_join(sites, "."))), ("path", found(F.col("path"))))
    chunks = F.concat(*(F.transform(a, _of_kind(k)) for k, a in kinds))
    parts = parts.select("page_id", "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("fit"), "bad", chunks.alias("chunks"), F.monotonically_increasing_id().alias("row"))
    parts = materialize(parts, "urls")
    words = materialize(word_counts(lexicon if lexicon is not None else pages.select("url")), "lexicon")
    total = words.agg(F.sum("n")).first()[0] or 0
    seeds = pages.sparkSession.createDataFrame([(w, max(1, total // 100_000)) for w in seed_words], "word string, n long")
    words = words.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))

    rows = parts.select("row", F.posexplode("chunks").alias("pos", "chunk")).select("row", "pos", "chunk.*")
    names = materialize(rows.filter("kind <> 'tld'").groupBy("name").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "names")
    uses = names.agg(F.sum("n")).first()[0] or 0
    words_of = materialize(names.drop("id").join(segment(names, words, total), "name"), "segments")
    split_rows = _look_up(rows.filter("kind <> 'tld'"), words_of, "name", uses).select("row", "pos", "kind", "words")
    split_rows = split_rows.unionByName(rows.filter("kind = 'tld'").select("row", "pos", "kind", F.array("name").alias("words")))
    # a url's own chunks meet again: their number is that of its letters at most
    tokens = split_rows.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "words"))).alias("t"))
    own = F.flatten(F.transform("t", lambda c: F.transform(c["words"], lambda w: F.when(c["kind"] == "host", w).otherwise(F.concat(c["kind"], F.lit(":"), w)))))
    of_url = F.flatten(F.transform(F.filter("t", lambda c: c["kind"] != "tld"), lambda c: c["words"]))
    seeded = F.arrays_overlap(of_url, F.array(*map(F.lit, seed_words)))
    known = parts.drop("chunks").join(tokens.select("row", own.alias("words"), seeded.alias("seeded")), "row", "left")
    known = materialize(known.select("row", "page_id", "host", "path", "fit", F.coalesce("words", F.array().cast("array<string>")).alias("words"), (F.col("bad") | F.coalesce("seeded", F.lit(False))).alias("label")), "tokens")

    each = known.select("row", "label", F.explode("words").alias("token"))
    counts = materialize(each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("label").alias("blocked")), "token-counts")
    docs, blocked = known.agg(F.count("*"), F.count_if("label")).first()
    size, all_n, all_blocked = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    share = lambda n, of: F.log((n + SMOOTH) / F.lit(of + SMOOTH * max(1, size)))
    odds = counts.select("token", "n", (share(F.col("blocked"), all_blocked) - share(F.col("n") - F.col("blocked"), all_n - all_blocked)).alias("odds"))
    summed = _look_up(each.select("row", "token"), odds, "token", all_n).groupBy("row").agg(F.sum("odds").alias("odds"))
    prior = math.log((blocked + 1) / (docs - blocked + 1))
    score = F.round(1 / (1 + F.exp(-(F.coalesce("odds", F.lit(0.0)) + prior))), 9)
    judged = known.join(summed, "row", "left").withColumn("score", score)
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score", "words")
