"""Registered queries of streams, neighbour walks over whole pools, contacts from coordinates and resampling."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import basins, potential
from ..operators import chains, families, generators, kinematics, levels, loops, nulls, quality, stats, verdicts, walks
from ..operators.shared import kept, shared_dir
from ..streaming import chain_metrics
from .catalogue import _LOOP, _SHUFFLE, FULL, GRID, RES, WRES, protein_table, query, residues, scored
from .extended import _CHAIN_STEP, members


@query(f"{FULL} SELECT chain_id, organism, length, round(bps, 6) AS bps, round(bps_norm, 6) AS bps_norm, round(mean_dw, 6) AS mean_dw, round(torus_l1, 6) AS torus_l1, round(torus_l2, 6) AS torus_l2, round(q_phi, 6) AS q_phi, round(q_psi, 6) AS q_psi, n_transitions FROM proteins")
def x07_chain_stream(spark, d):
    """The event table as a stream: keyed state per chain, emitted when the watermark has passed it. A row far ahead ends the stream.
    The stream's path is a pattern, as Spark takes a plain path for a folder and the table may be one file."""
    path, root = f"{d}/events.parquet", f"{shared_dir(spark)}/angleweave/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(path)
    span = events.agg(F.min(F.col("ts").cast("timestamp")).alias("a"), F.max(F.col("ts").cast("timestamp")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    gap = int((span.b - span.a).total_seconds()) + 1 if span.n else 1
    ends = events.limit(1).withColumns({"ts": F.lit(span.b).cast("timestamp") + F.make_dt_interval(secs=F.lit(2 * gap + 2)), "user_id": F.lit(None).cast("bigint")}).select(*[F.col(c).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    ends.limit(0).write.parquet(f"{root}/ends")

    def run():
        both = chain_metrics.event_stream(spark, f"{d}/events.parque[t]", events.schema).unionByName(chain_metrics.event_stream(spark, f"{root}/ends", events.schema))
        res = both.select("ts", F.col("event_id").alias("tie"), *chains.event_angles()).withColumn("basin", basins.basin(F.col("phi"), F.col("psi")))
        res = potential.with_nearest(res, potential.grid_table(spark, potential.build()))
        chain_metrics.run_until_now(chain_metrics.chain_stream(res, f"{gap} seconds", 1), f"{root}/rows", f"{root}/checkpoint")

    run()
    ends.write.mode("append").parquet(f"{root}/ends")
    run()
    rows = spark.read.schema(chain_metrics.METRICS).parquet(f"{root}/rows")
    return rows.where("chain_id is not null").drop("first_at")


def _sweep(spark, d):
    """BPS/L of every chain and of its walks at every k, by organism."""
    res = residues(spark, d)
    grid = potential.grid_table(spark, potential.build())
    lengths = res.groupBy("chain_id", "organism").agg(F.count(F.lit(1)).alias("length"))

    def value(rows, *by):
        scored = potential.with_bilinear(rows.where("phi is not null and psi is not null"), grid)
        step = F.abs(F.col("w") - F.lag("w").over(Window.partitionBy(*by, "chain_id").orderBy("pos")))
        return scored.withColumn("step", step).groupBy(*by, "chain_id", "organism").agg((F.coalesce(F.sum("step"), F.lit(0.0)) / F.count(F.lit(1))).alias("value"))

    walked = walks.neighbour_walks(res, lengths, walks.SWEEP)
    return kept(walks.k_sweep(value(res), value(walked, "k")), "sweep")


@query()
def m09_neighbour_sweep(spark, d):
    return _sweep(spark, d)


@query()
def t24_neighbour_verdict(spark, d):
    return walks.sweep_verdict(_sweep(spark, d))


_OBSERVED = """cnt AS (SELECT CAST(round_even((degrees(phi) + 180.0) * 360 / 360.0, 0) AS INT) % 360 AS gi, CAST(round_even((degrees(psi) + 180.0) * 360 / 360.0, 0) AS INT) % 360 AS gj, count(*) AS n FROM res WHERE phi IS NOT NULL AND psi IS NOT NULL GROUP BY 1, 2),
nod AS (SELECT i.range AS gi, j.range AS gj, coalesce(n, 0) / (sum(n) OVER () * (2 * pi() / 360) * (2 * pi() / 360)) AS d FROM range(360) i CROSS JOIN range(360) j LEFT JOIN cnt ON cnt.gi = i.range AND cnt.gj = j.range),
roo AS (SELECT gi, gj, -sqrt(greatest(d, 1e-6 * max(d) OVER ())) AS w FROM nod),
ker AS (SELECT range - 6 AS k, exp(-0.5 * ((range - 6) / 1.5) * ((range - 6) / 1.5)) AS e FROM range(13)),
kno AS (SELECT k, e / sum(e) OVER () AS e FROM ker),
sm1 AS (SELECT (gi + k + 360) % 360 AS gi, gj, sum(w * e) AS w FROM roo, kno GROUP BY 1, 2),
wg AS (SELECT gi, (gj + k + 360) % 360 AS gj, sum(w * e) AS w FROM sm1, kno GROUP BY 1, 2)"""


@query(f"WITH {RES}, {_OBSERVED} SELECT CAST(gi AS INT) AS gi, CAST(gj AS INT) AS gj, round(w, 6) AS w FROM wg")
def w05_observed(spark, d):
    """W from the table's own angles."""
    w = potential.from_counts(potential.histogram(residues(spark, d)))
    return potential.grid_table(spark, w).select("gi", "gj", F.col("w00").alias("w"))


@query()
def m11_observed(spark, d):
    res = residues(spark, d)
    return generators.from_observed(res, res)


def _shape(spark, d):
    return kinematics.shape(kept(kinematics.reconstructed(residues(spark, d)), "rebuilt"))


@query()
def p09_p10_shape(spark, d):
    """Radius of gyration and contact order of the chains rebuilt from their angles."""
    return _shape(spark, d)


@query()
def j07_contacts(spark, d):
    return kinematics.contacts(kept(kinematics.reconstructed(residues(spark, d)), "rebuilt"))


@query()
def g13_shape_correlations(spark, d):
    """What the shape reports measure, over coordinates instead of the id: correlations with BPS/L, by organism."""
    p = chains.proteins(scored(spark, d), _shape(spark, d))
    return p.groupBy("organism").agg(F.count("rg").alias("n_rg"), F.corr("bps_norm", "rg").alias("r_rg"), F.count("contact_order").alias("n_contact_order"), F.corr("bps_norm", "contact_order").alias("r_contact_order"), F.avg("rg").alias("rg"), F.avg("contact_order").alias("contact_order"))


_STRATUM = "CASE WHEN lp.length <= 7 THEN 'short' WHEN lp.length <= 10 THEN 'medium' WHEN lp.length <= 15 THEN 'long' ELSE 'very long' END"


@query(f"""WITH {RES}, {GRID}, {WRES}, {_LOOP}, one AS (SELECT lp.chain_id, lp.start, lp.direction, {_STRATUM} AS stratum, abs(max(CASE WHEN pos > lp."end" THEN w END) - max(CASE WHEN pos < lp.start THEN w END)) AS dw, coalesce(sum(CASE WHEN pos > lp.start AND pos <= lp."end" THEN sqrt(dphi * dphi + dpsi * dpsi) END), 0) AS pl FROM lp JOIN wres ON wres.chain_id = lp.chain_id AND pos BETWEEN lp.start - 1 AND lp."end" + 1 GROUP BY ALL),
g AS (SELECT direction, stratum, count(*) AS n, avg(dw) AS m, stddev_pop(dw) AS s, avg(pl) AS pm, stddev_pop(pl) AS ps FROM one GROUP BY ALL) SELECT direction, stratum, n, round(m, 6) AS dw_mean, CASE WHEN n < 3 OR m < 1e-6 THEN 'degenerate' WHEN 100 * s / m < 30 THEN 'tight' ELSE 'catch-all' END AS change, CASE WHEN CASE WHEN m > 0 THEN 100 * s / m ELSE 0 END < 30 AND CASE WHEN pm > 0 THEN 100 * ps / pm ELSE 0 END < 30 THEN 'tight' ELSE 'catch-all' END AS both, CASE WHEN n < 3 OR greatest(s / greatest(m, 1e-6), ps / greatest(pm, 1e-6)) < 0.3 THEN 'tight' ELSE 'catch-all' END AS largest FROM g""")
def c12_tightness(spark, d):
    """The three rules of tightness over the loops of a direction and length."""
    rows = loops.extract(scored(spark, d)).withColumn("stratum", loops.stratum(F.col("length")))
    g = rows.groupBy("direction", "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("delta_w").alias("dw_mean"), F.stddev_pop("delta_w").alias("s"), F.avg("path_len").alias("pm"), F.stddev_pop("path_len").alias("ps"))
    rule = lambda k: basins.tightness(F.col("n"), F.col("dw_mean"), F.col("s"), F.col("pm"), F.col("ps"), k).alias(k)
    return g.select("direction", "stratum", "n", "dw_mean", *map(rule, ("change", "both", "largest")))


_C15_LEAST = 60


@query(f"{FULL}, x AS (SELECT chain_id, CASE WHEN length < {_C15_LEAST} THEN 'short' END AS e FROM proteins) SELECT coalesce(e, 'done') AS kind, count(*) AS n, min(chain_id) AS first_id, max(chain_id) AS last_id FROM x GROUP BY 1")
def c15_outcomes(spark, d):
    """Both outputs of the split, counted; the least length is one that parts the test tables' chains."""
    done, failed = verdicts.split(protein_table(spark, d).withColumn("residues", F.col("length")), _C15_LEAST)
    rows = done.select("chain_id", F.lit("done").alias("kind")).unionByName(failed.select("chain_id", F.col("error_type").alias("kind")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("chain_id").alias("first_id"), F.max("chain_id").alias("last_id"))


@query(f"{FULL} SELECT organism, count(*) AS n, round(avg(bps_norm), 6) AS mean FROM proteins WHERE bps_norm IS NOT NULL AND plddt_mean IS NOT NULL AND rg IS NOT NULL AND contact_order IS NOT NULL AND plddt_mean >= 50 AND length >= 50 GROUP BY 1")
def c10_complete(spark, d):
    return verdicts.complete(protein_table(spark, d), least_plddt=50.0, least_length=50).groupBy("organism").agg(F.count(F.lit(1)).alias("n"), F.avg("bps_norm").alias("mean"))


_CLASS = "CASE WHEN 100 * a > 15 AND 100 * b > 15 THEN 'mixed' WHEN 100 * a > 40 AND 100 * b <= 15 THEN 'alpha-rich' WHEN 100 * b > 25 AND 100 * a <= 15 THEN 'beta-rich' ELSE 'Other' END"
_GAPS = f"""cls AS (SELECT chain_id, {_CLASS} AS class FROM (SELECT chain_id, avg(CASE WHEN basin = 'alpha' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN basin = 'beta' THEN 1.0 ELSE 0 END) AS b FROM res GROUP BY 1)), pair AS (SELECT class, r.s AS a, n.s AS b FROM cls JOIN {_CHAIN_STEP.format(t='res')} r USING (chain_id) JOIN {_CHAIN_STEP.format(t='pm')} n USING (chain_id)),
gap AS (SELECT class, count(*) AS n, avg(a) AS real_mean, avg(b) AS model_mean, 100 * (avg(b) - avg(a)) / nullif(avg(a), 0) AS agg_gap, avg(100 * (b - a) / nullif(a, 0)) AS chain_gap, corr(a, b) AS r FROM pair GROUP BY 1)"""


def _class_chains(spark, d):
    r = residues(spark, d)
    step = lambda rows, name: chains.stepped(rows).groupBy("chain_id").agg(F.avg(F.abs("dphi") + F.abs("dpsi")).alias(name))
    share = lambda b: F.avg((F.col("basin") == b).cast("double"))
    classes = r.groupBy("chain_id").agg(basins.fold(100 * share("alpha"), 100 * share("beta"), "percent").alias("class"))
    return classes.join(step(r, "real"), "chain_id").join(step(nulls.shuffled(r), "model"), "chain_id")


@query(f"WITH {RES}, {_SHUFFLE}, {_GAPS} SELECT class, n, round(real_mean, 6) AS real_mean, round(model_mean, 6) AS model_mean, round(agg_gap, 6) AS agg_gap, round(chain_gap, 6) AS chain_gap, round(r, 6) AS r FROM gap")
def t22_class_gaps(spark, d):
    """Shuffled chains against real ones, by fold class."""
    return verdicts.class_gaps(_class_chains(spark, d))


@query(f"WITH {RES}, {_SHUFFLE}, {_GAPS} SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS classes, round(sum(agg_gap * n) / sum(n), 6) AS agg_gap, round(sum(chain_gap * n) / sum(n), 6) AS chain_gap FROM gap")
def t22_overall_gap(spark, d):
    return verdicts.overall_gap(verdicts.class_gaps(_class_chains(spark, d)))


@query()
def t04_dominant_components(spark, d):
    """Which of the first three components roughness, pLDDT and size load on most strongly."""
    names = ["bps_norm", "length", "plddt_mean", "torus_l1", "rg", "contact_order", "pct_helix", "pct_sheet"]
    found = stats.principal(protein_table(spark, d), names)
    rows = [(c, *stats.dominant_component(found, names, c)) for c in ("bps_norm", "plddt_mean", "length")]
    own = rows[0][1]
    return spark.createDataFrame([(c, k, v, k == own) for c, k, v in rows], "variable string, component int, loading double, shared boolean")


@query()
def l05_refined_again(spark, d):
    found, pairs = members(spark, d)
    return families.refined_again(found, pairs)


@query()
def l09_stability_verdict(spark, d):
    pairs = families.stability(kept(families.density_clusters(loops.features(scored(spark, d))), "density")).where("a > 0")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg("ari").alias("ari"), F.avg("jaccard").alias("jaccard")).withColumn("verdict", verdicts.stability(F.col("ari")))


@query()
def m14_five_levels(spark, d):
    res = residues(spark, d)
    return levels.decomposed(res, potential.grid_table(spark, potential.build()))


@query()
def m14_level_shares(spark, d):
    return levels.shares(levels.decomposed(residues(spark, d), potential.grid_table(spark, potential.build())))


_DEGREES = "CAST(floor(degrees({a}) + 0.5 + 1e-9) AS INT)"


@query(f"WITH {RES} SELECT chain_id, CAST(to_json(list([{_DEGREES.format(a='phi')}, {_DEGREES.format(a='psi')}] ORDER BY pos)) AS VARCHAR) AS path FROM res GROUP BY chain_id")
def p19_paths(spark, d):
    """A chain's path as JSON, in whole degrees."""
    whole = lambda a: F.floor(F.degrees(a) + 0.5 + 1e-9).cast("int")
    points = F.array_sort(F.collect_list(F.struct("pos", F.array(whole("phi"), whole("psi")).alias("at"))))
    return residues(spark, d).groupBy("chain_id").agg(F.to_json(F.transform(points, lambda x: x["at"])).alias("path"))


_SWEEP_LEAST = 5


@query(f"{FULL}, sw AS (SELECT t.least_plddt, chain_id, abs(w - lag(w) OVER (PARTITION BY t.least_plddt, chain_id ORDER BY pos)) AS a FROM wres JOIN (SELECT unnest({list(quality.SWEEP)}::DOUBLE[]) AS least_plddt) t ON plddt >= t.least_plddt), c AS (SELECT least_plddt, chain_id, coalesce(sum(a), 0) / count(*) AS b FROM sw GROUP BY 1, 2 HAVING count(*) >= {_SWEEP_LEAST}) SELECT least_plddt, count(*) AS chains, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS sd, round(100 * stddev_samp(b) / avg(b), 6) AS cv_pct FROM c GROUP BY 1")
def g21_published_sweep(spark, d):
    """The published limits; chains of the test tables keep fewer residues than the published least number."""
    return quality.plddt_sweep(scored(spark, d), least=_SWEEP_LEAST)


@query(f"WITH {RES}, {_OBSERVED}, s AS (SELECT min(w) AS w_min, max(w) AS w_max, avg(w) AS w_mean, min(CASE WHEN gi = 90 THEN w END) AS w_saddle, arg_min(gj, w) FILTER (WHERE gi = 90) AS saddle_gj, max(CASE WHEN gi = 117 AND gj = 137 THEN w END) AS w_alpha, max(CASE WHEN gi = 60 AND gj = 310 THEN w END) AS w_beta, avg(CASE WHEN gi >= 80 AND gi < 140 AND gj >= 120 AND gj < 180 THEN w END) AS mean_alpha, avg(CASE WHEN gi >= 30 AND gi < 100 AND gj >= 280 AND gj < 350 THEN w END) AS mean_beta FROM wg) SELECT round(w_min, 6) AS w_min, round(w_max, 6) AS w_max, round(w_mean, 6) AS w_mean, round(w_saddle, 6) AS w_saddle, CAST(saddle_gj AS INT) AS saddle_gj, round(w_alpha, 6) AS w_alpha, round(w_beta, 6) AS w_beta, round(mean_alpha, 6) AS mean_alpha, round(mean_beta, 6) AS mean_beta, round(w_saddle - w_alpha, 6) AS depth_alpha, round(w_saddle - w_beta, 6) AS depth_beta, round(w_mean - mean_alpha, 6) AS below_alpha, round(w_mean - mean_beta, 6) AS below_beta FROM s")
def w09_observed_landscape(spark, d):
    """The landscape of the table's own angles."""
    w = potential.from_counts(potential.histogram(residues(spark, d)))
    return potential.landscape(potential.grid_table(spark, w).select("gi", "gj", F.col("w00").alias("w")))


_DIMENSION = "dim(organism, kingdom) AS (VALUES " + ", ".join(f"('{o}', '{k}')" for k, names in basins.KINGDOMS.items() for o in names) + ")"


@query(f"{FULL}, {_DIMENSION} SELECT coalesce(kingdom, '?') AS kingdom, count(DISTINCT p.organism) AS organisms, count(*) AS chains, round(avg(bps_norm), 6) AS mean FROM proteins p LEFT JOIN dim ON dim.organism = p.organism GROUP BY 1")
def j02_kingdoms(spark, d):
    return basins.with_kingdom(protein_table(spark, d)).groupBy("kingdom").agg(F.count_distinct("organism").alias("organisms"), F.count(F.lit(1)).alias("chains"), F.avg("bps_norm").alias("mean"))


@query()
def g36_cluster_coverage(spark, d):
    return families.coverage(members(spark, d)[0])


_GI, _GJ = (f"CAST(round_even((degrees({a}) + 180.0) * 360 / 360.0, 0) AS INT) % 360" for a in ("phi", "psi"))
_TRAINED = f"""cnt AS (SELECT organism AS train, {_GI} AS gi, {_GJ} AS gj, count(*) AS n FROM res WHERE phi IS NOT NULL AND psi IS NOT NULL GROUP BY ALL), tot AS (SELECT train, sum(n) AS total FROM cnt GROUP BY 1),
nod AS (SELECT tot.train, i.range AS gi, j.range AS gj, coalesce(n, 0) / (total * (2 * pi() / 360) * (2 * pi() / 360)) AS d FROM tot CROSS JOIN range(360) i CROSS JOIN range(360) j LEFT JOIN cnt ON cnt.train = tot.train AND cnt.gi = i.range AND cnt.gj = j.range),
roo AS (SELECT train, gi, gj, -sqrt(greatest(d, 1e-6 * max(d) OVER (PARTITION BY train))) AS w FROM nod),
ker AS (SELECT range - 6 AS k, exp(-0.5 * ((range - 6) / 1.5) * ((range - 6) / 1.5)) AS e FROM range(13)), kno AS (SELECT k, e / sum(e) OVER () AS e FROM ker),
sm1 AS (SELECT train, (gi + k + 360) % 360 AS gi, gj, sum(w * e) AS w FROM roo, kno GROUP BY 1, 2, 3), wg AS (SELECT train, gi, (gj + k + 360) % 360 AS gj, sum(w * e) AS w FROM sm1, kno GROUP BY 1, 2, 3),
stp AS (SELECT train, chain_id, abs(w - lag(w) OVER (PARTITION BY train, chain_id ORDER BY pos)) AS a FROM res JOIN wg ON wg.gi = {_GI} AND wg.gj = {_GJ} AND train <> organism), per AS (SELECT train, chain_id, coalesce(sum(a), 0) / count(*) AS b FROM stp GROUP BY 1, 2)"""


@query(f"WITH {RES}, {_TRAINED} SELECT train, count(*) AS chains, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS sd, round(100 * stddev_samp(b) / avg(b), 6) AS cv_pct FROM per GROUP BY 1")
def o11_transfer(spark, d):
    """W of one organism, measured on the chains of all others."""
    res = residues(spark, d)
    return quality.transferred(res, kept(potential.grids_by(res, "organism"), "grids"))
