"""The registered queries of the engine's operators, and their SQL for another engine.

The DataFrame side goes through the operators; the SQL side states the same thing from
the raw tables with common table expressions of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import angles, basins, potential
from ..operators import chains, families, loops, nulls, stats
from . import organism_reports, reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RES = """ev AS (SELECT user_id AS chain_id, list_extract(['ecoli','human','yeast','arabidopsis','malaria'], CAST(user_id % 5 AS INT) + 1) AS organism, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CAST((event_id * 37) % 101 AS DOUBLE) AS plddt, event_type AS resname, radians(((value * 29.0) % 360.0) - 180.0) AS phi, radians(((CAST(json_extract_string(props, '$.k') AS DOUBLE) * 7.0) % 360.0) - 180.0) AS psi FROM events),
res AS (SELECT *, CASE WHEN degrees(phi) > -160 AND degrees(phi) < 0 AND degrees(psi) > -120 AND degrees(psi) < 30 THEN 'alpha' WHEN degrees(phi) > -170 AND degrees(phi) < -70 AND (degrees(psi) > 90 OR degrees(psi) < -120) THEN 'beta' ELSE 'other' END AS basin FROM ev),
dif AS (SELECT *, atan2(sin(phi - lag(phi) OVER w), cos(phi - lag(phi) OVER w)) AS dphi, atan2(sin(psi - lag(psi) OVER w), cos(psi - lag(psi) OVER w)) AS dpsi, lag(basin) OVER w AS before FROM res WINDOW w AS (PARTITION BY chain_id ORDER BY pos))"""
_MIX = ", ".join(f"({w}, {mp}, {ms}, {kp}, {ks}, {r})" for w, mp, ms, kp, ks, r in potential.COMPONENTS)
GRID = f"""mix(wt, mp, ms, kp, ks, rho) AS (VALUES {_MIX}),
nod AS (SELECT i.range AS gi, j.range AS gj, -pi() + i.range * 2 * pi() / 360 AS p, -pi() + j.range * 2 * pi() / 360 AS s FROM range(360) i, range(360) j),
den AS (SELECT gi, gj, sum(wt * exp(kp * cos(p - radians(mp)) + ks * cos(s - radians(ms)) + rho * sin(p - radians(mp)) * sin(s - radians(ms)))) AS d FROM nod, mix GROUP BY gi, gj),
nrm AS (SELECT gi, gj, d / (sum(d) OVER () * (2 * pi() / 360) * (2 * pi() / 360)) AS d FROM den),
roo AS (SELECT gi, gj, -sqrt(greatest(d, 1e-6 * max(d) OVER ())) AS w FROM nrm),
ker AS (SELECT range - 6 AS k, exp(-0.5 * ((range - 6) / 1.5) * ((range - 6) / 1.5)) AS e FROM range(13)),
kno AS (SELECT k, e / sum(e) OVER () AS e FROM ker),
sm1 AS (SELECT (gi + k + 360) % 360 AS gi, gj, sum(w * e) AS w FROM roo, kno GROUP BY 1, 2),
wg AS MATERIALIZED (SELECT gi, (gj + k + 360) % 360 AS gj, sum(w * e) AS w FROM sm1, kno GROUP BY 1, 2)"""
WRES = """wres AS (SELECT dif.*, wg.w, abs(wg.w - lag(wg.w) OVER (PARTITION BY chain_id ORDER BY pos)) AS adw FROM dif JOIN wg ON wg.gi = CAST(round_even((degrees(phi) + 180.0) * 360 / 360.0, 0) AS INT) % 360 AND wg.gj = CAST(round_even((degrees(psi) + 180.0) * 360 / 360.0, 0) AS INT) % 360)"""
PROTEINS = """tra AS (SELECT chain_id, sum(CASE WHEN b <> basin THEN 1 ELSE 0 END) AS n_transitions FROM (SELECT chain_id, basin, lag(basin) OVER (PARTITION BY chain_id ORDER BY pos) AS b FROM res WHERE basin <> 'other') GROUP BY 1),
pr0 AS (SELECT chain_id, organism, count(*) AS length, coalesce(sum(adw), 0) AS bps, avg(adw) AS mean_dw, avg(abs(dphi) + abs(dpsi)) AS torus_l1, avg(sqrt(dphi * dphi + dpsi * dpsi)) AS torus_l2, coalesce(sum(dphi) / (2 * pi()), 0) AS q_phi, coalesce(sum(dpsi) / (2 * pi()), 0) AS q_psi, 100.0 * avg(CASE WHEN basin = 'alpha' THEN 1.0 ELSE 0 END) AS pct_helix, 100.0 * avg(CASE WHEN basin = 'beta' THEN 1.0 ELSE 0 END) AS pct_sheet, 100.0 * avg(CASE WHEN basin = 'other' THEN 1.0 ELSE 0 END) AS pct_coil, avg(plddt) AS plddt_mean, quantile_cont(plddt, 0.5) AS plddt_median, avg(CASE WHEN plddt < 50 THEN 1.0 ELSE 0 END) AS plddt_below50 FROM wres GROUP BY 1, 2),
proteins AS (SELECT pr0.*, bps / length AS bps_norm, sqrt(q_phi * q_phi + q_psi * q_psi) AS q_mag, sqrt(q_phi * q_phi + q_psi * q_psi) / sqrt(length) AS q_norm, coalesce(n_transitions, 0) AS n_transitions, 2.2 * pow(length, 0.38) * (1 + (chain_id % 7) / 50) AS rg, 0.05 + (chain_id % 13) / 100 AS contact_order, chain_id % 2 + 3 AS af_version FROM pr0 LEFT JOIN tra USING (chain_id))"""
FULL = f"WITH {RES}, {GRID}, {WRES}, {PROTEINS}"


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = chains.bind_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return res.withColumn("basin", basins.basin(F.col("phi"), F.col("psi")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return potential.with_nearest(residues(spark, sf_dir), potential.grid_table(spark, potential.build()))


def protein_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.proteins(scored(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of distributed sums does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def keep(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-organism roughness over chains, and its spread across chains."""
    return QUERIES["g18_organism_spread"](spark, sf_dir)


@query(f"WITH {RES} SELECT chain_id, pos, organism, round(phi, 6) AS phi, round(psi, 6) AS psi, basin FROM res")
def c01_wide_basins(spark, d):
    return residues(spark, d).select("chain_id", "pos", "organism", "phi", "psi", "basin")


@query(f"WITH {RES} SELECT chain_id, pos, CASE WHEN degrees(phi) > -100 AND degrees(phi) < -30 AND degrees(psi) > -67 AND degrees(psi) < -7 THEN 'alpha' WHEN degrees(phi) > -100 AND degrees(phi) < -50 AND degrees(psi) > 120 AND degrees(psi) < 180 THEN 'ppII' WHEN degrees(phi) > -170 AND degrees(phi) < -70 AND (degrees(psi) > 90 OR degrees(psi) < -120) THEN 'beta' WHEN degrees(phi) > 30 AND degrees(phi) < 90 AND degrees(psi) > 10 AND degrees(psi) < 70 THEN 'alphaL' ELSE 'other' END AS basin FROM ev")
def c02_narrow_basins(spark, d):
    return residues(spark, d).select("chain_id", "pos", basins.basin(F.col("phi"), F.col("psi"), "narrow").alias("basin"))


@query(f"WITH {RES} SELECT chain_id, pos, CASE WHEN degrees(phi) BETWEEN -100 AND -30 AND degrees(psi) BETWEEN -67 AND -7 THEN 'alpha' WHEN degrees(phi) BETWEEN -170 AND -70 AND (degrees(psi) BETWEEN 90 AND 180 OR degrees(psi) BETWEEN -180 AND -120) THEN 'beta' WHEN degrees(phi) BETWEEN -100 AND -50 AND degrees(psi) BETWEEN 120 AND 180 THEN 'ppII' WHEN degrees(phi) BETWEEN 30 AND 90 AND degrees(psi) BETWEEN 10 AND 70 THEN 'alphaL' ELSE 'other' END AS basin FROM ev")
def c03_inclusive_basins(spark, d):
    return residues(spark, d).select("chain_id", "pos", basins.basin(F.col("phi"), F.col("psi"), "inclusive").alias("basin"))


@query(f"WITH {RES}, h AS (SELECT chain_id, avg(CASE WHEN degrees(phi) BETWEEN -180 AND -40 AND degrees(psi) BETWEEN -80 AND 50 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN degrees(phi) BETWEEN -180 AND -40 AND (degrees(psi) > 80 OR degrees(psi) < -140) THEN 1.0 ELSE 0 END) AS b FROM ev GROUP BY 1) SELECT chain_id, round(a, 6) AS frac_alpha, round(b, 6) AS frac_beta, CASE WHEN a >= 0.40 AND b < 0.10 THEN 'all_alpha' WHEN b >= 0.30 AND a < 0.15 THEN 'all_beta' WHEN a >= 0.15 AND b >= 0.15 THEN 'alpha_beta' ELSE 'other' END AS fold FROM h")
def c04_c08_stratified_folds(spark, d):
    a, b = basins.stratum_hits(F.col("phi"), F.col("psi"))
    out = residues(spark, d).groupBy("chain_id").agg(F.avg(a.cast("double")).alias("frac_alpha"), F.avg(b.cast("double")).alias("frac_beta"))
    return out.withColumn("fold", basins.fold(F.col("frac_alpha"), F.col("frac_beta"), "stratified"))


@query(f"WITH {RES}, h AS (SELECT chain_id, avg(CASE WHEN basin = 'alpha' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN basin = 'beta' THEN 1.0 ELSE 0 END) AS b FROM res GROUP BY 1) SELECT chain_id, CASE WHEN a >= 0.35 AND b < 0.10 THEN 'all-alpha' WHEN b >= 0.25 AND a < 0.15 THEN 'all-beta' WHEN a >= 0.20 AND b >= 0.15 THEN 'alpha/beta' WHEN a >= 0.10 AND b >= 0.10 THEN 'alpha+beta' ELSE 'other' END AS c05, CASE WHEN 100 * a > 15 AND 100 * b > 15 THEN 'mixed' WHEN 100 * a > 40 AND 100 * b <= 15 THEN 'alpha-rich' WHEN 100 * b > 25 AND 100 * a <= 15 THEN 'beta-rich' ELSE 'Other' END AS c07 FROM h")
def c05_c07_folds(spark, d):
    out = residues(spark, d).groupBy("chain_id").agg(F.avg((F.col("basin") == "alpha").cast("double")).alias("a"), F.avg((F.col("basin") == "beta").cast("double")).alias("b"))
    return out.select("chain_id", basins.fold(F.col("a"), F.col("b")).alias("c05"), basins.fold(100 * F.col("a"), 100 * F.col("b"), "percent").alias("c07"))


@query(f"WITH {RES}, h AS (SELECT chain_id, avg(CASE WHEN basin = 'alpha' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN basin = 'beta' THEN 1.0 ELSE 0 END) AS b, count(*) FILTER (WHERE basin <> before AND basin <> 'other' AND before <> 'other') / nullif(count(*) FILTER (WHERE basin <> 'other'), 0) AS den FROM dif GROUP BY 1) SELECT chain_id, CASE WHEN a >= 0.15 AND b >= 0.15 THEN CASE WHEN den > 0.05 THEN 'alpha/beta' ELSE 'alpha+beta' END WHEN a >= 0.15 THEN 'all-alpha' WHEN b >= 0.15 THEN 'all-beta' ELSE 'other' END AS fold FROM h")
def c06_presence_folds(spark, d):
    r = residues(spark, d).withColumn("before", F.lag("basin").over(chains.order()))
    ss = F.col("basin") != "other"
    out = r.groupBy("chain_id").agg(F.avg((F.col("basin") == "alpha").cast("double")).alias("a"), F.avg((F.col("basin") == "beta").cast("double")).alias("b"), F.count_if(ss & (F.col("before") != "other") & (F.col("basin") != F.col("before"))).alias("x"), F.count_if(ss).alias("y"))
    return out.select("chain_id", basins.fold(F.col("a"), F.col("b"), "presence", F.col("x") / F.nullif(F.col("y"), F.lit(0))).alias("fold"))


@query(f"WITH {RES} SELECT chain_id, pos, round(dphi, 6) AS dphi, round(abs(dpsi), 6) AS abs_dpsi, round(cos(phi), 6) AS e0, round(sin(phi), 6) AS e1, round(cos(psi), 6) AS e2, round(sin(psi), 6) AS e3 FROM dif")
def p05_p07_circular(spark, d):
    r = chains.stepped(residues(spark, d))
    return r.select("chain_id", "pos", "dphi", F.abs("dpsi").alias("abs_dpsi"), *[e.alias(f"e{k}") for k, e in enumerate(angles.embed(F.col("phi"), F.col("psi")))])


@query(f"WITH {RES} SELECT chain_id, pos, CAST(round_even((degrees(phi) + 180.0) * 360 / 360.0, 0) AS INT) % 360 AS near_bin, CAST(floor((psi + pi()) * 72 / (2 * pi())) AS INT) % 72 AS floor_bin, (CAST(trunc(degrees(psi) * 360 / 360.0) AS INT) + 180) % 360 AS cut_bin FROM ev")
def p08_grid_bins(spark, d):
    r = residues(spark, d)
    return r.select("chain_id", "pos", angles.grid_index(F.col("phi")).alias("near_bin"), angles.grid_index(F.col("psi"), 72, "floor").alias("floor_bin"), angles.grid_index(F.col("psi"), 360, "truncate").alias("cut_bin"))


@query(f"WITH {RES}, v AS (SELECT chain_id, count(*) FILTER (WHERE degrees(phi) > -160 AND degrees(phi) < 0) AS plus, count(*) FILTER (WHERE degrees(-phi) > -160 AND degrees(-phi) < 0) AS minus FROM ev GROUP BY 1) SELECT chain_id, CASE WHEN minus > plus THEN -1 ELSE 1 END AS sign FROM v")
def p04_chain_sign(spark, d):
    p = F.degrees("phi")
    v = residues(spark, d).groupBy("chain_id").agg(F.count_if((p > -160) & (p < 0)).alias("plus"), F.count_if((-p > -160) & (-p < 0)).alias("minus"))
    return v.select("chain_id", F.when(F.col("minus") > F.col("plus"), -1).otherwise(1).alias("sign"))


@query(f"WITH {RES} SELECT chain_id, round(avg(plddt), 6) AS mean, round(quantile_cont(plddt, 0.5), 6) AS median, round(avg(CASE WHEN plddt < 50 THEN 1.0 ELSE 0 END), 6) AS below50, string_agg(basin, '' ORDER BY pos) AS basin_sequence, string_agg(substr(resname, 1, 1), '' ORDER BY pos) AS letters FROM res GROUP BY 1")
def p14_p17_chain_text(spark, d):
    g = residues(spark, d).groupBy("chain_id").agg(F.avg("plddt").alias("mean"), F.percentile("plddt", F.lit(0.5)).alias("median"), F.avg((F.col("plddt") < 50).cast("double")).alias("below50"), F.array_sort(F.collect_list(F.struct("pos", "basin", "resname"))).alias("r"))
    join = lambda f: F.array_join(F.transform("r", f), "")
    return g.select("chain_id", "mean", "median", "below50", join(lambda x: x["basin"]).alias("basin_sequence"), join(lambda x: F.substring(x["resname"], 1, 1)).alias("letters"))


@query(f"WITH {GRID} SELECT gi, gj, round(w, 6) AS w FROM wg")
def w01_grid(spark, d):
    return potential.grid_table(spark, potential.build()).select(F.col("gi").cast("bigint").alias("gi"), F.col("gj").cast("bigint").alias("gj"), F.col("w00").alias("w"))


@query(f"WITH {RES}, {GRID}, {WRES} SELECT chain_id, pos, round(w, 6) AS w FROM wres")
def w04_nearest(spark, d):
    return scored(spark, d).select("chain_id", "pos", "w")


@query(f"WITH {RES}, {GRID}, x AS (SELECT chain_id, pos, (phi + pi()) * 360 / (2 * pi()) AS x, (psi + pi()) * 360 / (2 * pi()) AS y FROM ev), c AS MATERIALIZED (SELECT chain_id, pos, x - floor(x) AS u, y - floor(y) AS v, CAST(floor(x) AS INT) % 360 AS i, CAST(floor(y) AS INT) % 360 AS j, CAST(floor(x) + 1 AS INT) % 360 AS i1, CAST(floor(y) + 1 AS INT) % 360 AS j1 FROM x), q AS (SELECT a.gi, a.gj, any_value(a.w) AS w FROM wg a GROUP BY 1, 2), k AS (SELECT chain_id, pos, u, v, i, j, i1, j1, i * 360 + j AS k00, i1 * 360 + j AS k10, i * 360 + j1 AS k01, i1 * 360 + j1 AS k11 FROM c), l AS MATERIALIZED (SELECT list(w ORDER BY gi * 360 + gj) AS w FROM q) SELECT chain_id, pos, round((1 - u) * (1 - v) * l.w[k00 + 1] + u * (1 - v) * l.w[k10 + 1] + (1 - u) * v * l.w[k01 + 1] + u * v * l.w[k11 + 1], 6) AS w FROM k, l")
def w03_bilinear(spark, d):
    return potential.with_bilinear(residues(spark, d), potential.grid_table(spark, potential.build())).select("chain_id", "pos", "w")


_HIST = "h AS (SELECT CAST(round_even((degrees(phi) + 180.0) * 360 / 360.0, 0) AS INT) % 360 AS gi, CAST(round_even((degrees(psi) + 180.0) * 360 / 360.0, 0) AS INT) % 360 AS gj, count(*) AS n FROM ev GROUP BY 1, 2)"


@query(f"WITH {RES}, {_HIST} SELECT gi, gj, round(-ln(n / (sum(n) OVER () * (2 * pi() / 360) * (2 * pi() / 360)) + 1e-5), 6) AS w FROM h")
def w05_w07_histogram_potential(spark, d):
    return potential.log_potential(potential.histogram(residues(spark, d)), 1e-5)


@query(f"WITH {RES} SELECT chain_id, round(avg(abs(f - g)), 6) AS roughness FROM (SELECT chain_id, CASE basin WHEN 'alpha' THEN 0.0 WHEN 'beta' THEN 1.0 ELSE 2.0 END AS f, CASE before WHEN 'alpha' THEN 0.0 WHEN 'beta' THEN 1.0 WHEN 'other' THEN 2.0 END AS g FROM dif) GROUP BY 1")
def w08_flat_roughness(spark, d):
    r = residues(spark, d).withColumn("w", potential.flat(F.col("basin")))
    return chains.stepped(r).groupBy("chain_id").agg(F.avg(F.abs("dw")).alias("roughness"))


@query(f"WITH {GRID} SELECT round(min(w), 6) AS w_min, round(max(w), 6) AS w_max, round(max(w) - min(w), 6) AS w_range, round(max(CASE WHEN gi = 117 AND gj = 137 THEN w END), 6) AS w_alpha, round(max(CASE WHEN gi = 60 AND gj = 310 THEN w END), 6) AS w_beta, round(min(CASE WHEN gi = 90 THEN w END), 6) AS w_saddle_line FROM wg")
def w09_landscape(spark, d):
    g = potential.grid_table(spark, potential.build())
    at = lambda i, j: F.max(F.when((F.col("gi") == i) & (F.col("gj") == j), F.col("w00")))
    return g.agg(F.min("w00").alias("w_min"), F.max("w00").alias("w_max"), (F.max("w00") - F.min("w00")).alias("w_range"), at(117, 137).alias("w_alpha"), at(60, 310).alias("w_beta"), F.min(F.when(F.col("gi") == 90, F.col("w00"))).alias("w_saddle_line"))


@query(f"{FULL} SELECT chain_id, organism, length, round(bps, 6) AS bps, round(bps_norm, 6) AS bps_norm, round(mean_dw, 6) AS mean_dw, round(torus_l1, 6) AS torus_l1, round(torus_l2, 6) AS torus_l2, round(q_phi, 6) AS q_phi, round(q_psi, 6) AS q_psi, round(q_mag, 6) AS q_mag, round(q_norm, 6) AS q_norm FROM proteins")
def n01_n05_roughness(spark, d):
    return chains.roughness(chains.stepped(scored(spark, d)))


@query(f"{FULL} SELECT chain_id, n_transitions, round(pct_helix, 6) AS pct_helix, round(pct_sheet, 6) AS pct_sheet, round(rg, 6) AS rg, NOT (bps_norm > 0.02 AND bps_norm < 0.5) AS is_outlier FROM proteins")
def n07_c11_proteins(spark, d):
    return protein_table(spark, d).select("chain_id", "n_transitions", "pct_helix", "pct_sheet", "rg", basins.outlier(F.col("bps_norm")).alias("is_outlier"))


_SEG = "sg AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM basin THEN 0 ELSE 1 END) OVER (PARTITION BY chain_id ORDER BY pos) AS seg FROM dif), runs AS (SELECT chain_id, seg, basin AS label, min(pos) AS start, max(pos) AS \"end\", count(*) AS length FROM sg GROUP BY 1, 2, 3)"


@query(f'WITH {RES}, {_SEG} SELECT chain_id, CAST(seg AS BIGINT) AS seg, label, start, "end", length FROM runs')
def n08_segments(spark, d):
    return chains.segments(residues(spark, d))


@query(f"WITH {RES}, {_SEG} SELECT label, count(*) AS n, round(avg(length), 6) AS mean_length, max(length) AS longest FROM runs GROUP BY 1")
def n09_segment_stats(spark, d):
    return chains.segments(residues(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"), F.max("length").alias("longest"))


@query(f"WITH {RES} SELECT before AS source, basin AS target, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY before), 6) AS share FROM dif WHERE before IS NOT NULL GROUP BY 1, 2")
def n15_transitions(spark, d):
    return chains.transition_counts(residues(spark, d))


@query(f"WITH {RES} SELECT a, b, c, count(*) AS n FROM (SELECT lag(basin, 2) OVER w AS a, lag(basin) OVER w AS b, basin AS c FROM res WINDOW w AS (PARTITION BY chain_id ORDER BY pos)) WHERE a IS NOT NULL GROUP BY 1, 2, 3")
def n15_trigrams(spark, d):
    return chains.trigram_counts(residues(spark, d))


@query(f"WITH {RES}, {GRID}, {WRES}, m AS (SELECT basin, avg(w) AS w FROM wres GROUP BY 1), t AS (SELECT before, basin, count(*) AS n FROM dif WHERE before IS NOT NULL GROUP BY 1, 2) SELECT round(sum(n * abs(a.w - b.w)) / sum(n), 6) AS predicted, round((SELECT avg(adw) FROM wres), 6) AS observed FROM t JOIN m a ON a.basin = t.before JOIN m b ON b.basin = t.basin")
def n16_predicted_roughness(spark, d):
    s = scored(spark, d)
    means = s.groupBy("basin").agg(F.avg("w").alias("w"))
    t = chains.transition_counts(s).join(F.broadcast(means.select(F.col("basin").alias("source"), F.col("w").alias("wa"))), "source").join(F.broadcast(means.select(F.col("basin").alias("target"), F.col("w").alias("wb"))), "target")
    seen = chains.stepped(s).agg(F.avg(F.abs("dw")).alias("observed"))
    return t.agg((F.sum(F.col("n") * F.abs(F.col("wa") - F.col("wb"))) / F.sum("n")).alias("predicted")).crossJoin(seen)


@query(f"WITH {RES} SELECT * FROM (SELECT chain_id, pos, round(phi, 6) AS phi, round(lead(phi) OVER w, 6) AS next_phi, round(lead(psi) OVER w, 6) AS next_psi FROM ev WINDOW w AS (PARTITION BY chain_id ORDER BY pos)) WHERE next_phi IS NOT NULL")
def n17_successors(spark, d):
    return chains.successor_pairs(residues(spark, d)).select("chain_id", "pos", "phi", "next_phi", "next_psi")


@query()
def n06_kinks(spark, d):
    return chains.kinks(chains.stepped(scored(spark, d)))


@query(f"WITH {RES}, {GRID}, {WRES}, m AS (SELECT chain_id, adw, avg(adw) OVER v + 2 * stddev_pop(adw) OVER v AS hi FROM wres WINDOW v AS (PARTITION BY chain_id)) SELECT chain_id, count(*) FILTER (WHERE adw > hi) AS n_kinks FROM m GROUP BY 1")
def n06_kinks_simple(spark, d):
    return chains.kinks_simple(chains.stepped(scored(spark, d)))


_LOOP = f'{_SEG}, ab AS (SELECT *, lead(label) OVER w AS nl, lead(start) OVER w AS ns FROM runs WHERE label <> \'other\' AND length >= 2 WINDOW w AS (PARTITION BY chain_id ORDER BY start)), lp AS (SELECT chain_id, "end" + 1 AS start, ns - 1 AS "end", label || \'->\' || nl AS direction, ns - "end" - 1 AS length FROM ab WHERE label <> nl AND ns - "end" - 1 BETWEEN 1 AND 20)'


@query(f"""WITH {RES}, {GRID}, {WRES}, {_LOOP} SELECT lp.chain_id, lp.start, lp."end", lp.direction, lp.length, round(abs(max(CASE WHEN pos > lp."end" THEN w END) - max(CASE WHEN pos < lp.start THEN w END)), 6) AS delta_w, round(coalesce(sum(CASE WHEN pos > lp.start AND pos <= lp."end" THEN sqrt(dphi * dphi + dpsi * dpsi) END), 0), 6) AS path_len, coalesce(string_agg(CASE WHEN pos BETWEEN lp.start AND lp."end" THEN substr(resname, 1, 1) END, '' ORDER BY pos), '') AS residues, CASE WHEN lp.length <= 7 THEN 'short' WHEN lp.length <= 10 THEN 'medium' WHEN lp.length <= 15 THEN 'long' ELSE 'very long' END AS stratum FROM lp JOIN wres ON wres.chain_id = lp.chain_id AND pos BETWEEN lp.start - 1 AND lp."end" + 1 GROUP BY ALL""")
def n10_loops(spark, d):
    return loops.extract(scored(spark, d)).select("chain_id", "start", "end", "direction", "length", "delta_w", "path_len", "residues", loops.stratum(F.col("length")).alias("stratum"))


@query(f"""WITH {RES}, {GRID}, {WRES}, {_SEG}, f AS (SELECT r.chain_id, r.seg, r.start, r.length, w, phi, psi, abs(w - lag(w) OVER (PARTITION BY r.chain_id, r.seg ORDER BY pos)) AS a FROM runs r JOIN wres ON wres.chain_id = r.chain_id AND pos BETWEEN r.start AND r."end" WHERE label = 'other' AND r.length >= 3) SELECT chain_id, start, length, round(avg(a), 6) AS bps_mean, round(stddev_pop(a), 6) AS bps_std, round(least(length, 50) / 50, 6) AS norm_len, round(avg(sin(phi)), 6) AS sin_phi, round(avg(cos(psi)), 6) AS cos_psi, round(max(w) - min(w), 6) AS w_range FROM f GROUP BY chain_id, seg, start, length""")
def n13_loop_features(spark, d):
    return loops.features(scored(spark, d)).select("chain_id", "start", "length", "bps_mean", "bps_std", "norm_len", "sin_phi", "cos_psi", "w_range")


@query()
def n18_l02_loop_distances(spark, d):
    return families.class_distances(loops.extract(scored(spark, d)))


_PERM = "sh AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY pos) AS slot, row_number() OVER (PARTITION BY {g} ORDER BY md5(concat_ws('|', '{m}', chain_id, 0, pos)), pos) AS rk FROM {t}), pm AS (SELECT a.chain_id, a.pos, b.phi, b.psi FROM sh a JOIN sh b ON {j} AND a.slot = b.rk)"


@query(f"WITH {RES}, {_PERM.format(g='chain_id', m='M01', t='res', j='a.chain_id = b.chain_id')} SELECT chain_id, pos, round(phi, 6) AS phi, round(psi, 6) AS psi FROM pm")
def m01_shuffle(spark, d):
    return nulls.shuffled(residues(spark, d)).select("chain_id", "pos", "phi", "psi")


@query(f"WITH {RES}, {_SEG}, {_PERM.format(g='chain_id, seg', m='M03', t='sg', j='a.chain_id = b.chain_id AND a.seg = b.seg')} SELECT chain_id, pos, round(phi, 6) AS phi, round(psi, 6) AS psi FROM pm")
def m03_segment_shuffle(spark, d):
    return nulls.segment_shuffled(residues(spark, d)).select("chain_id", "pos", "phi", "psi")


_POOL = "po AS (SELECT *, row_number() OVER (PARTITION BY chain_id, basin ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY chain_id, basin) AS sz FROM res), m2 AS (SELECT a.chain_id, a.pos, a.basin, b.phi, b.psi FROM po a JOIN po b ON a.chain_id = b.chain_id AND a.basin = b.basin AND b.k = CAST('0x' || substr(md5(concat_ws('|', 'M02', a.chain_id, 0, a.pos)), 1, 8) AS BIGINT) % a.sz)"


@query(f"WITH {RES}, {_POOL} SELECT chain_id, pos, basin, round(phi, 6) AS phi, round(psi, 6) AS psi FROM m2")
def m02_basin_pools(spark, d):
    return nulls.basin_pools(residues(spark, d)).select("chain_id", "pos", "basin", "phi", "psi")


@query(f"WITH {RES}, {_POOL}, nr AS (SELECT a.chain_id, a.pos, list(b.phi ORDER BY b.pos) AS f, list(b.psi ORDER BY b.pos) AS s FROM res a JOIN res b ON a.chain_id = b.chain_id AND a.basin = b.basin AND abs(a.pos - b.pos) <= 5 GROUP BY 1, 2), pk AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', 'M05', chain_id, 0, pos)), 1, 8) AS BIGINT) % len(f) + 1 AS k FROM nr) SELECT pk.chain_id, pk.pos, round(CASE WHEN len(f) < 2 THEN m2.phi ELSE f[k] END, 6) AS phi, round(CASE WHEN len(f) < 2 THEN m2.psi ELSE s[k] END, 6) AS psi FROM pk JOIN m2 ON m2.chain_id = pk.chain_id AND m2.pos = pk.pos")
def m05_local_window(spark, d):
    return nulls.local_windows(residues(spark, d)).select("chain_id", "pos", "phi", "psi")


@query()
def m06_markov(spark, d):
    return nulls.markov(residues(spark, d), 1, 1).select("chain_id", "pos", "basin", "phi", "psi")


@query()
def m07_markov_order2(spark, d):
    return nulls.markov(residues(spark, d), 1, 2).select("chain_id", "pos", "basin", "phi", "psi")


@query(f"{FULL}, o AS (SELECT organism, count(*) AS n, avg(bps_norm) AS m FROM proteins GROUP BY 1 HAVING count(*) >= 3) SELECT count(*) AS organisms, sum(n)::BIGINT AS chains, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd, round(100 * stddev_pop(m) / avg(m), 6) AS cv_pct FROM o")
def g18_organism_spread(spark, d):
    o = protein_table(spark, d).groupBy("organism").agg(F.count(F.lit(1)).alias("n"), F.avg("bps_norm").alias("m")).where("n >= 3")
    return o.agg(F.count(F.lit(1)).alias("organisms"), F.sum("n").alias("chains"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), (100 * F.stddev_pop("m") / F.avg("m")).alias("cv_pct"))


@query()
def t03_least_squares(spark, d):
    fit = stats.least_squares(protein_table(spark, d), "bps_norm", ["length", "pct_helix", "pct_sheet"])
    return spark.createDataFrame([(k, float(v)) for k, v in {**fit["coefficients"], "r2": fit["r2"], "adj_r2": fit["adj_r2"]}.items()], "term string, value double")


@query()
def t06_bootstrap(spark, d):
    return stats.bootstrap_mean(protein_table(spark, d), "organism", "bps_norm")


@query(f"{FULL}, x AS (SELECT bps_norm AS x, CASE WHEN organism = 'ecoli' THEN 1.0 ELSE 0.0 END AS a FROM proteins WHERE organism IN ('ecoli', 'human')), g AS (SELECT x, sum(a) AS ca, sum(1 - a) AS cb FROM x GROUP BY 1), s AS (SELECT x, abs(sum(ca) OVER (ORDER BY x) / sum(ca) OVER () - sum(cb) OVER (ORDER BY x) / sum(cb) OVER ()) AS gap, lead(x) OVER (ORDER BY x) - x AS width FROM g) SELECT round(sum(gap * width), 6) AS wasserstein, round(max(gap), 6) AS ks FROM s")
def t13_t14_distances(spark, d):
    return stats.wasserstein(protein_table(spark, d), "bps_norm", "organism", "ecoli", "human")


_SWEEP = (0.0, 25.0, 50.0, 75.0)


@query(f"{FULL}, sw AS (SELECT t.least_plddt, chain_id, abs(w - lag(w) OVER (PARTITION BY t.least_plddt, chain_id ORDER BY pos)) AS a FROM wres JOIN (SELECT unnest({list(_SWEEP)}::DOUBLE[]) AS least_plddt) t ON plddt >= t.least_plddt), c AS (SELECT least_plddt, chain_id, coalesce(sum(a), 0) / count(*) AS b FROM sw GROUP BY 1, 2 HAVING count(*) >= 5) SELECT least_plddt, count(*) AS chains, round(avg(b), 6) AS mean, round(100 * stddev_pop(b) / avg(b), 6) AS cv_pct FROM c GROUP BY 1")
def g21_plddt_sweep(spark, d):
    """Residues are dropped before the steps between neighbours are taken."""
    rows = scored(spark, d).withColumn("least_plddt", F.explode(F.array(*map(F.lit, _SWEEP)))).where("plddt >= least_plddt")
    steps = rows.select("least_plddt", "chain_id", F.abs(F.col("w") - F.lag("w").over(Window.partitionBy("least_plddt", "chain_id").orderBy("pos"))).alias("a"))
    per = steps.groupBy("least_plddt", "chain_id").agg((F.coalesce(F.sum("a"), F.lit(0.0)) / F.count(F.lit(1))).alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return per.groupBy("least_plddt").agg(F.count(F.lit(1)).alias("chains"), F.avg("b").alias("mean"), (100 * F.stddev_pop("b") / F.avg("b")).alias("cv_pct"))


@query(f"""WITH {RES}, {GRID}, {WRES}, {_LOOP} SELECT lp.direction, lp.length, CAST(wres.pos - lp.start AS INT) AS at, count(*) AS n, round(cos(atan2(avg(sin(phi)), avg(cos(phi)))), 6) AS cos_phi, round(atan2(avg(sin(psi)), avg(cos(psi))), 6) AS psi FROM lp JOIN wres ON wres.chain_id = lp.chain_id AND pos BETWEEN lp.start AND lp."end" GROUP BY 1, 2, 3""")
def g34_circular_centroids(spark, d):
    """Mean angles of every place of the loops of one direction and length."""
    found, rows = loops.extract(scored(spark, d)).select("chain_id", "start", "end", "direction", "length"), residues(spark, d).select("chain_id", "pos", "phi", "psi")
    placed = found.withColumn("pos", F.explode(F.sequence("start", "end"))).join(rows, ["chain_id", "pos"])
    mean = lambda a: F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))
    return placed.groupBy("direction", "length", (F.col("pos") - F.col("start")).cast("int").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.cos(mean("phi")).alias("cos_phi"), mean("psi").alias("psi"))


@query(f"WITH {RES}, {GRID}, {WRES}, {_LOOP}, f AS (SELECT direction, length, count(*) AS n FROM lp GROUP BY 1, 2) SELECT direction, count(*) AS families, CAST(max(n) AS BIGINT) AS largest, round(100.0 * sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / sum(n), 6) AS pct_in_2, round(100.0 * sum(CASE WHEN n >= 3 THEN n ELSE 0 END) / sum(n), 6) AS pct_in_3, quantile_cont(n, 0.5) AS median FROM f GROUP BY 1")
def g36_family_coverage(spark, d):
    """Families are the loops of one direction and length."""
    f = loops.extract(scored(spark, d)).groupBy("direction", "length").agg(F.count(F.lit(1)).alias("n"))
    share = lambda k: 100.0 * F.sum(F.when(F.col("n") >= k, F.col("n")).otherwise(0)) / F.sum("n")
    return f.groupBy("direction").agg(F.count(F.lit(1)).alias("families"), F.max("n").alias("largest"), share(2).alias("pct_in_2"), share(3).alias("pct_in_3"), F.percentile("n", 0.5).alias("median"))


def _mean_step(rows: DataFrame) -> DataFrame:
    """The mean over chains of the mean step on the torus (sum of both turns)."""
    w = Window.partitionBy("chain_id").orderBy("pos")
    turn = lambda a: F.abs(F.atan2(F.sin(F.col(a) - F.lag(a).over(w)), F.cos(F.col(a) - F.lag(a).over(w))))
    steps = rows.select("chain_id", (turn("phi") + turn("psi")).alias("step"))
    return steps.groupBy("chain_id").agg(F.avg("step").alias("step")).agg(F.avg("step").alias("step"))


def _steps_by_model(spark: SparkSession, d: str, models: dict) -> DataFrame:
    found = None
    for name, f in models.items():
        one = _mean_step(f(residues(spark, d))).select(F.lit(name).alias("model"), "step")
        found = one if found is None else found.unionByName(one)
    return found.groupBy().agg(*[F.max(F.when(F.col("model") == m, F.col("step"))).alias(m) for m in models])


_SHUFFLE = _PERM.format(g="chain_id", m="M01", t="res", j="a.chain_id = b.chain_id")
_SEGMENT = _PERM.format(g="chain_id, seg", m="M03", t="sg", j="a.chain_id = b.chain_id AND a.seg = b.seg").replace("sh ", "zh ").replace("pm AS", "zm AS")
_STEP = "(SELECT avg(s) AS step FROM (SELECT chain_id, avg(abs(a) + abs(b)) AS s FROM (SELECT chain_id, atan2(sin(phi - lag(phi) OVER w), cos(phi - lag(phi) OVER w)) AS a, atan2(sin(psi - lag(psi) OVER w), cos(psi - lag(psi) OVER w)) AS b FROM {t} WINDOW w AS (PARTITION BY chain_id ORDER BY pos)) GROUP BY 1))"


@query(f"WITH {RES}, {_SEG}, {_SHUFFLE}, {_SEGMENT} SELECT round(r.step, 6) AS real, round(s.step, 6) AS shuffled, round(g.step, 6) AS within_segments, round(s.step / r.step, 6) AS shuffled_ratio, round(g.step / r.step, 6) AS segment_ratio, round(100 * (s.step / r.step - 1), 6) AS gap_pct, round(100 * (s.step - g.step) / r.step, 6) AS between_pct FROM {_STEP.format(t='res')} r, {_STEP.format(t='pm')} s, {_STEP.format(t='zm')} g")
def t20_gap_chain(spark, d):
    """Ratios of means; the gap to the shuffled chains splits into a part within segments and one between them."""
    row = _steps_by_model(spark, d, {"real": lambda r: r, "shuffled": nulls.shuffled, "within_segments": nulls.segment_shuffled})
    return row.select("*", F.expr("shuffled / real AS shuffled_ratio"), F.expr("within_segments / real AS segment_ratio"), F.expr("100 * (shuffled / real - 1) AS gap_pct"), F.expr("100 * (shuffled - within_segments) / real AS between_pct"))


@query()
def t21_interaction(spark, d):
    """(S / R) over the product of (Seg / R) and (S / M1)."""
    row = _steps_by_model(spark, d, {"real": lambda r: r, "shuffled": nulls.shuffled, "within_segments": nulls.segment_shuffled, "markov": lambda r: nulls.markov(r, 1, 1)})
    return row.select("*", F.expr("(shuffled / real) / ((within_segments / real) * (shuffled / markov)) AS interaction"))


def _report(name: str, text: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(spark.sql(text.replace("$P", "{proteins}"), proteins=protein_table(spark, sf_dir)))
    SQL[name] = f"{FULL} {reports.other_dialect(text)}"


for _name, _text in (reports.REPORTS | organism_reports.every()).items():
    _report(_name, _text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import extended, later, measured  # noqa: F401 - they register their own; they import this module

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import extended, later  # noqa: F401

    return dict(SQL)
