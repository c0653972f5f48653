"""The registered queries of current tables, streams, the log and its anchors, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, divergence, rollups
from ..operators.consensus import KEY, consensus
from ..sources import fixture
from ..sources.current import Current, scratch, written
from ..streaming import anchor, deltas, idempotent, late
from ..streaming.recompute import touched_history
from .catalog import _live, query

#: Forms come in so many slices, and the first of them once more.
SLICES = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sliced(spark: SparkSession, sf_dir: str):
    """Number and forms of each slice, and the results of the units that it touches, from all forms so far."""
    forms = fixture.submissions(spark, sf_dir)
    history = Current(spark, scratch(spark, "history"), [*KEY, "id"])
    for number in range(SLICES):
        batch = forms.filter(F.col("id") % SLICES == number)
        yield number, written(consensus(touched_history(batch, history, number)), "results")


@query("B1_current_results", "SELECT election, pu, status, submission_count, source_count, a, CASE WHEN a IS NOT NULL THEN b END b, CASE WHEN a IS NOT NULL THEN c END c FROM results")
def _(spark, sf_dir):
    """Results kept up by key over three slices of the forms; every slice comes twice."""
    table = Current(spark, scratch(spark, "current"), KEY)
    for number, found in _sliced(spark, sf_dir):
        for _ in range(2):
            table.upsert(found, tag=("consensus", number))
    votes = (F.try_element_at("votes", F.lit(p)).alias(p.lower()) for p in "ABC")
    return table.read().select(*KEY, "status", "submission_count", "source_count", *votes)


@query("B4_unit_upserts", """SELECT c_custkey pu, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END loaded, c_nationkey::BIGINT first_lga, CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE c_custkey % 4 END::BIGINT seen, greatest(c_custkey % 7, CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 0 END)::BIGINT worst
  FROM customer""", False)
def _(spark, sf_dir):
    """Also B2 and B7: units in four loads, a third of them again under other values, then an old load that comes late; one column keeps its first value, one its greatest."""
    k = F.col("c_custkey")
    units = _table(spark, sf_dir, "customer").select(k.alias("pu"), F.lit("first").alias("loaded"), F.col("c_nationkey").cast("long").alias("first_lga"), (k % 4).cast("long").alias("seen"), (k % 7).cast("long").alias("worst"))
    again = units.filter("pu % 3 = 0").withColumns({"loaded": F.lit("second"), "first_lga": F.lit(-1).cast("long"), "seen": F.lit(5).cast("long"), "worst": F.lit(4).cast("long")})
    table = Current(spark, scratch(spark, "units"), ["pu"], 8)
    overtaken = again.withColumns({"loaded": F.lit("late"), "seen": F.lit(-1).cast("long"), "worst": F.lit(0).cast("long")})
    for rows in (*(units.filter(F.col("seen") == n) for n in range(4)), again, overtaken):
        table.upsert(rows, F.col("seen"), sticky=["worst"], keep=["first_lga"])
    return table.read()


_TOTALS = "SELECT coalesce(state, -1) state, coalesce(lga, -1) lga, coalesce(ward, '') ward, party, sum(n)::BIGINT n, count(*)::BIGINT units FROM votes WHERE status IN ('consensus', 'single_source', 'inec_confirmed') GROUP BY GROUPING SETS ((party, state, lga, ward), (party, state, lga), (party, state), (party))"


@query("O9_delta_totals", _TOTALS)
def _(spark, sf_dir):
    """The totals of E25, kept up by a stream over three slices that correct earlier results, and the first slice once more."""
    changes, totals, checkpoint = (scratch(spark, n) for n in ("changes", "totals", "deltas"))
    units = fixture.units(spark, sf_dir).select("pu", "state", "lga", "ward")
    for number, found in _sliced(spark, sf_dir):
        rows = found.join(units, "pu").withColumn("seq", F.lit(number + 1).cast("long")).select("election", "pu", "seq", "status", "votes", "state", "lga", "ward")
        for _ in range(2 if number == SLICES - 1 else 1):
            rows.write.mode("append").parquet(changes)
            deltas.start(spark.readStream.schema(rows.schema).parquet(changes), totals, checkpoint).awaitTermination()
    kept = Current(spark, totals, deltas.TOTAL_KEY).read().filter("election = 'cur' and units > 0")
    return kept.select(F.coalesce("state", F.lit(-1).cast("long")).alias("state"), F.coalesce("lga", F.lit(-1).cast("long")).alias("lga"), F.coalesce("ward", F.lit("")).alias("ward"), "party", "n", "units")


@query("O8_late_forms", """, said AS (SELECT pu, e.election, (CASE WHEN e.election = 'cur' THEN 1 ELSE 3 END) * (pu % 50) + 10 sa FROM units, (SELECT unnest(['cur', 'base']) election) e WHERE pu % 11 <> 0),
  own AS (SELECT election, pu, coalesce(max(abs(raw.a - sa)) FILTER (NOT official), 0)::BIGINT deepest FROM raw LEFT JOIN said USING (election, pu) GROUP BY ALL)
  SELECT election, pu, status, CASE WHEN results.a IS NULL OR sa IS NULL THEN 'insufficient' WHEN results.a <> sa THEN 'divergent' ELSE 'clean' END comparison, deepest > 0 flagged, deepest FROM own JOIN results USING (election, pu) LEFT JOIN said USING (election, pu)""")
def _(spark, sf_dir):
    """Forms by time of capture, though they arrive in another order: the last third first."""
    forms = fixture.submissions(spark, sf_dir).withColumns({"captured_at": F.col("submitted_at"), "uploaded_at": F.col("submitted_at") + F.make_dt_interval((F.col("id") % 40).cast("int"))})
    declared = late.declared_of(fixture.units(spark, sf_dir).filter("pu % 11 <> 0"))
    history, table = Current(spark, scratch(spark, "late-forms"), [*KEY, "id"]), Current(spark, scratch(spark, "late"), KEY)
    for number, part in enumerate((2, 0, 1)):
        batch = forms.filter((F.col("id") % SLICES == part) & F.col("approved")).drop("submitted_at")
        found = written(late.compare(touched_history(batch, history, number, "late"), declared), "found")
        table.upsert(found, sticky=late.STICKY, tag=("late", number))
    return table.read().select(*KEY, "status", "comparison", "flagged", "deepest")


@query("O5_idempotent", "SELECT user_id, date_trunc('hour', ts) AS hour, 1::BIGINT n FROM events GROUP BY 1, 2", False)
def _(spark, sf_dir):
    """A user's events of one hour carry one token; they come in three slices of time, cut within hours."""
    inbox, out, checkpoint = (scratch(spark, n) for n in ("tokens", "once", "once-state"))
    at = F.col("ts").cast("timestamp")
    hour = F.date_trunc("hour", at)
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("uploaded_at"), F.concat_ws(":", "user_id", hour.cast("string")).alias("client_submission_uuid"))
    cuts = [F.lit(t).cast("timestamp") for t in ("2000-01-01 00:00:00", "2024-01-11 10:30:00", "2024-01-21 20:30:00", "2100-01-01 00:00:00")]
    for low, high in zip(cuts, cuts[1:]):
        rows.filter((F.col("uploaded_at") >= low) & (F.col("uploaded_at") < high)).write.mode("append").parquet(inbox)
        stream = idempotent.once(spark.readStream.schema(rows.schema).parquet(inbox), row="event_id")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("user_id", F.date_trunc("hour", "uploaded_at").alias("hour")).agg(F.count("*").alias("n"))


# the log


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each nation: the customers as events, whose data are written with white space and keys out of order."""
    k = F.col("c_custkey")
    data = F.concat(F.lit('{"z" : '), k.cast("string"), F.lit(', "name": "Ọ̀yọ́ '), F.col("c_name"), F.lit('", "at": { "s" : "'), F.col("c_mktsegment"), F.lit('", "b": [1, 2.5,null , true]}}'))
    return _table(spark, sf_dir, "customer").select(k.cast("long").alias("seq"), F.col("c_nationkey").cast("long").alias("chain"), F.lit("e").alias("event_type"), F.lit("n").alias("entity_type"), F.col("c_name").alias("entity_id"), F.when(k % 2 == 0, "x").alias("actor_id"), F.lit("t").alias("event_at"), data.alias("event_data"))


_CANONICAL = """concat('{"at":{"b":[1,2.5,null,true],"s":"', c_mktsegment, '"},"name":"Ọ̀yọ́ ', c_name, '","z":', c_custkey, '}')"""


@query("K8_canonical_json", f"SELECT c_custkey seq, {_CANONICAL} event_data FROM customer", False)
def _(spark, sf_dir):
    return _log(spark, sf_dir).select("seq", audit.canonical_json(F.col("event_data")).alias("event_data"))


@query("K1_chain", f"""WITH RECURSIVE e AS (SELECT c_custkey seq, c_nationkey chain, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) k, concat('en', c_name, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END, 't', {_CANONICAL}) said FROM customer),
  c AS (SELECT seq, chain, k, sha256(repeat('0', 64) || said) log_hash FROM e WHERE k = 1 UNION ALL SELECT e.seq, e.chain, e.k, sha256(c.log_hash || said) FROM c JOIN e ON e.chain = c.chain AND e.k = c.k + 1)
  SELECT seq, log_hash FROM c""", False)
def _(spark, sf_dir):
    """Also B8: all events appended to empty logs, one a nation, side by side."""
    return audit.append(_log(spark, sf_dir), chain=["chain"]).select("seq", "log_hash")


@query("K2_broken_links", "SELECT c_custkey seq FROM customer WHERE c_custkey % 100 IN (7, 12, 13)", False)
def _(spark, sf_dir):
    """One log of all customers: rows whose data were changed, and rows whose hash was, which breaks the next one's link too."""
    log = written(audit.append(_log(spark, sf_dir)), "log")
    log = log.withColumn("event_data", F.when(F.col("seq") % 100 == 7, "[]").otherwise(F.concat(F.lit(" "), "event_data")))
    return audit.broken(log.withColumn("log_hash", F.when(F.col("seq") % 100 == 12, "f" * 64).otherwise(F.col("log_hash"))))


@query("K3_genesis", f"SELECT r_name AS name, sha256(concat('{audit.ZEROS}chain.genesissystem', r_name)) log_hash FROM region", False)
def _(spark, sf_dir):
    return _table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), audit.genesis(F.col("r_name")).alias("log_hash"))


def _root_sql(leaves: str) -> str:
    """Roots of leaves (batch, k, h, n), a level a step."""
    return f"""WITH RECURSIVE leaves AS ({leaves}), m AS (SELECT batch, k, h, n FROM leaves
  UNION ALL SELECT batch, k // 2, sha256(unhex(sha256(unhex(concat(min_by(h, k), max_by(h, k)))))), (max(n) + 1) // 2 FROM m WHERE n > 1 GROUP BY batch, k // 2)"""


@query("K4_merkle_root", _root_sql("SELECT o_orderstatus batch, row_number() OVER w - 1 k, sha256(o_orderkey::VARCHAR) h, count(*) OVER (PARTITION BY o_orderstatus) n FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)")
       + " SELECT batch, h merkle_root, (SELECT count(*) FROM orders WHERE o_orderstatus = batch)::BIGINT leaf_count FROM m WHERE n = 1", False)
def _(spark, sf_dir):
    """The roots over the hashes of all orders, in the order of their keys, by status."""
    leaves = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("batch"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"))
    return audit.merkle_roots(audit.numbered(leaves, by=["batch"]))


_LAST = "(SELECT coalesce(max(o_orderkey), 0) FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey < 900)"


@query("K5_batch", f"SELECT o_orderkey seq FROM orders WHERE o_orderkey > {_LAST} AND (SELECT count(*) FROM orders WHERE o_orderkey > {_LAST}) >= 10", False)
def _(spark, sf_dir):
    """Also E12: all rows after the last anchored one, 0 without any, if ten wait."""
    log = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"))
    anchors = log.filter("seq % 10 = 0 and seq < 900").select(F.col("seq").alias("end_seq"))
    return audit.waiting(log, anchors, 10)


_THIRDS = "SELECT *, row_number() OVER (PARTITION BY batch ORDER BY o_orderkey) - 1 k, count(*) OVER (PARTITION BY batch) n, sha256(o_orderkey::VARCHAR) h FROM (SELECT o_orderkey, CASE WHEN o_orderkey <= m // 3 THEN 0 WHEN o_orderkey <= m * 2 // 3 THEN 1 ELSE 2 END batch FROM orders, (SELECT max(o_orderkey) m FROM orders) WHERE o_orderkey > 0)"


@query("O7_anchors", _root_sql(_THIRDS) + """ SELECT min(o_orderkey) start_seq, max(o_orderkey) end_seq, any_value(m.h) merkle_root, count(*)::BIGINT leaf_count, CASE WHEN batch < 2 THEN 'confirmed' ELSE 'pending' END status FROM leaves JOIN m USING (batch) WHERE m.n = 1 GROUP BY batch""", False)
def _(spark, sf_dir):
    """A log that grows by thirds, picked up after each and twice after the last; the first two anchors are confirmed."""
    log = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("log_hash"))
    most = log.agg(F.max("seq")).first()[0]
    table = anchor.anchors(spark, scratch(spark, "anchors"))
    for number, end in enumerate((most // 3, most * 2 // 3, most, most)):
        anchor.pick_up(log.filter(F.col("seq") <= end), table, 1, number)
        if number < 2:
            anchor.confirm(table, table.read())
    return table.read()


# divergence by type

_STATED = """, u AS (SELECT pu, state, lga, ward, registered, p.party, p.n FROM units, LATERAL (SELECT unnest(['A', 'B', 'C']) party, unnest([pu % 50 + 10 + CASE WHEN pu % 25 = 3 THEN 7 ELSE 0 END, pu * 7 % 120 + 5, CASE WHEN pu % 97 = 0 THEN 4000 ELSE pu * 13 % 90 END]) n) p),
  f AS (SELECT state, lga, ward, pu, party, sum(n)::BIGINT n, CASE WHEN lga % 7 = 3 AND party = 'B' AND ward IS NOT NULL AND pu IS NULL THEN 9000000 WHEN state = 2 AND ward IS NULL AND party = 'C' THEN -5 ELSE 0 END::BIGINT wrong FROM u GROUP BY GROUPING SETS ((party), (party, state), (party, state, lga), (party, state, lga, ward), (party, state, lga, ward, pu))),
  g AS (SELECT state, lga, ward, pu, party, sum(n) FILTER (ok)::BIGINT computed FROM (SELECT pu, state, lga, ward, party, n, status IN ('consensus', 'single_source', 'inec_confirmed') ok FROM votes) GROUP BY GROUPING SETS ((party), (party, state), (party, state, lga), (party, state, lga, ward), (party, state, lga, ward, pu))),
  r AS (SELECT state, lga, ward, pu, count(*) units, count(*) FILTER (ok) verified, coalesce(sum(registered) FILTER (NOT ok), 0) room FROM (SELECT *, status IN ('consensus', 'single_source', 'inec_confirmed') AND a IS NOT NULL ok FROM live) GROUP BY GROUPING SETS ((), (state), (state, lga), (state, lga, ward), (state, lga, ward, pu))),
  x AS (SELECT f.state, f.lga, f.ward, f.pu, f.party, f.n + f.wrong declared, f.n own, coalesce(computed, 0) computed, units, verified, room, CASE WHEN f.pu IS NOT NULL THEN 'pu' WHEN f.ward IS NOT NULL THEN 'ward' WHEN f.lga IS NOT NULL THEN 'lga' WHEN f.state IS NOT NULL THEN 'state' ELSE 'nation' END lev
    FROM f LEFT JOIN g ON g.party = f.party AND g.state IS NOT DISTINCT FROM f.state AND g.lga IS NOT DISTINCT FROM f.lga AND g.ward IS NOT DISTINCT FROM f.ward AND g.pu IS NOT DISTINCT FROM f.pu
    JOIN r ON r.state IS NOT DISTINCT FROM f.state AND r.lga IS NOT DISTINCT FROM f.lga AND r.ward IS NOT DISTINCT FROM f.ward AND r.pu IS NOT DISTINCT FROM f.pu)
"""
_TYPES = _STATED + """ SELECT t.type, lev "level", coalesce(state, -1) state, coalesce(lga, -1) lga, coalesce(ward, '') ward, coalesce(pu, -1) pu, party, declared, against computed, declared - against difference,
  CASE WHEN 100.0::DOUBLE * verified / units < 30 THEN 'insufficient' WHEN 100.0::DOUBLE * verified / units < 50 THEN 'early' WHEN 100.0::DOUBLE * verified / units < 75 THEN 'significant' WHEN 100.0::DOUBLE * verified / units < 90 THEN 'strong' ELSE 'verified' END tier FROM
  (SELECT 'PU_ROW_ALTERED' type, *, computed against FROM x WHERE lev = 'pu' AND verified > 0 AND declared <> computed
  UNION ALL SELECT CASE lev WHEN 'ward' THEN 'WARD_TOTAL_FABRICATED' WHEN 'lga' THEN 'LGA_TOTAL_FABRICATED' WHEN 'state' THEN 'STATE_TOTAL_FABRICATED' ELSE 'DECLARATION_CONFLICT' END, *, computed FROM x WHERE lev <> 'pu' AND (declared < computed OR declared > computed + room)
  UNION ALL SELECT 'INTERNAL_ARITHMETIC_ERROR', *, own FROM x WHERE lev <> 'pu' AND declared <> own) t"""


def _forms(units: DataFrame) -> DataFrame:
    """Collation forms of all levels: rows that follow from the unit's number, more votes for A in some units, and totals that are wrong in some places."""
    pu = F.col("pu")
    votes = F.create_map(F.lit("A"), pu % 50 + 10 + F.when(pu % 25 == 3, 7).otherwise(0), F.lit("B"), pu * 7 % 120 + 5, F.lit("C"), F.when(pu % 97 == 0, 4000).otherwise(pu * 13 % 90))
    rows = units.select(*divergence.PATH, F.explode(votes).alias("party", "n"))
    sets = [["party", *divergence.PATH[:depth]] for depth in range(5)]
    sums = rows.groupingSets(sets, "party", *divergence.PATH).agg(F.sum("n").alias("n"))
    wrong = F.when((F.col("lga") % 7 == 3) & (F.col("party") == "B") & F.col("ward").isNotNull() & pu.isNull(), 9_000_000).when((F.col("state") == 2) & F.col("ward").isNull() & (F.col("party") == "C"), -5).otherwise(0)
    stated = sums.withColumn("n", F.col("n") + wrong).withColumn("own", F.lit(None).cast("boolean"))
    return stated.unionByName(sums.filter("pu is null").withColumn("own", F.lit(True)))


@query("M36_types", _TYPES)
def _(spark, sf_dir):
    """All six types of divergence, from one comparison of all levels."""
    found = divergence.detect(divergence.compared(_forms(fixture.units(spark, sf_dir)), _live(spark, sf_dir)))
    number = lambda c: F.coalesce(c, F.lit(-1).cast("long")).alias(c)
    return found.select("type", "level", number("state"), number("lga"), F.coalesce("ward", F.lit("")).alias("ward"), number("pu"), "party", "declared", "computed", "difference", "tier")


@query("M36_units_named", _STATED + """, o AS (SELECT * FROM x WHERE declared <> computed) SELECT o.state, o.lga, o.ward, o.pu, o.party, o.declared - o.computed difference FROM o
  JOIN o w ON w.lev = 'ward' AND w.ward = o.ward AND w.lga = o.lga AND w.party = o.party JOIN o l ON l.lev = 'lga' AND l.lga = o.lga AND l.party = o.party JOIN o s ON s.lev = 'state' AND s.state = o.state AND s.party = o.party WHERE o.lev = 'pu' AND o.verified > 0""")
def _(spark, sf_dir):
    """The units whose rows were changed, found within states, local governments and wards that differ."""
    base = divergence.compared(_forms(fixture.units(spark, sf_dir)), _live(spark, sf_dir))
    return divergence.localise(base).filter("level = 'pu'").select("state", "lga", "ward", "pu", "party", "difference")
