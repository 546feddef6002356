"""Registered queries of loop families, generators, reconstruction and the later statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import basins, potential
from ..operators import chains, families, generators, kinematics, loops, nulls, quality, significance, stats, walks
from ..operators.shared import kept
from .catalogue import _SHUFFLE, FULL, GRID, RES, WRES, query, protein_table, residues, scored

_NARROW = "CASE WHEN degrees(phi) > -100 AND degrees(phi) < -30 AND degrees(psi) > -67 AND degrees(psi) < -7 THEN 'alpha' WHEN degrees(phi) > -100 AND degrees(phi) < -50 AND degrees(psi) > 120 AND degrees(psi) < 180 THEN 'ppII' WHEN degrees(phi) > -170 AND degrees(phi) < -70 AND (degrees(psi) > 90 OR degrees(psi) < -120) THEN 'beta' WHEN degrees(phi) > 30 AND degrees(phi) < 90 AND degrees(psi) > 10 AND degrees(psi) < 70 THEN 'alphaL' ELSE 'other' END"
_INCLUSIVE = "CASE WHEN degrees(phi) BETWEEN -100 AND -30 AND degrees(psi) BETWEEN -67 AND -7 THEN 'alpha' WHEN degrees(phi) BETWEEN -170 AND -70 AND (degrees(psi) BETWEEN 90 AND 180 OR degrees(psi) BETWEEN -180 AND -120) THEN 'beta' WHEN degrees(phi) BETWEEN -100 AND -50 AND degrees(psi) BETWEEN 120 AND 180 THEN 'ppII' WHEN degrees(phi) BETWEEN 30 AND 90 AND degrees(psi) BETWEEN 10 AND 70 THEN 'alphaL' ELSE 'other' END"


def _runs(basin: str) -> str:
    return f'lab AS (SELECT chain_id, pos, {basin} AS b FROM res), chg AS (SELECT *, sum(CASE WHEN b IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY chain_id ORDER BY pos) AS seg FROM (SELECT *, lag(b) OVER (PARTITION BY chain_id ORDER BY pos) AS p FROM lab)), nrun AS (SELECT chain_id, seg, b AS label, min(pos) AS start, max(pos) AS "end", count(*) AS length FROM chg GROUP BY 1, 2, 3)'


_LOOP_B = f"""{_runs(_NARROW)}, ab AS (SELECT *, lead(label) OVER w AS nl, lead(start) OVER w AS ns FROM nrun WHERE label IN ('alpha', 'beta') AND length >= 3 WINDOW w AS (PARTITION BY chain_id ORDER BY start)), lp AS (SELECT chain_id, "end" + 1 AS start, ns - 1 AS "end", label || '->' || nl AS direction, ns - "end" - 1 AS length FROM ab WHERE label <> nl AND ns - "end" - 1 BETWEEN 1 AND 20), lb AS (SELECT lp.chain_id, lp.start, lp."end", lp.direction, lp.length, coalesce(sum(CASE WHEN pos > lp.start THEN sqrt(dphi * dphi + dpsi * dpsi) END), 0) AS path_len, abs(arg_max(w, pos) - arg_min(w, pos)) AS inner_dw FROM lp JOIN wres ON wres.chain_id = lp.chain_id AND pos BETWEEN lp.start AND lp."end" GROUP BY ALL HAVING count(*) FILTER (WHERE phi IS NULL OR psi IS NULL) = 0)"""


def narrow_loops(spark, d):
    return loops.extract_narrow(scored(spark, d).withColumn("basin", basins.basin(F.col("phi"), F.col("psi"), "narrow")))


def members(spark, d, rows=None):
    """Loops with their family (L03), stored, and the near pairs of different paths, by their reps. The wide basins' loops, as the test tables' angles hold no narrow ones.
    rows: scored residues where they are at hand."""
    found = kept(families.classes(kept(families.bound_loops(loops.extract(scored(spark, d) if rows is None else rows)), "paths")), "loops")
    one = kept(families.folded(found, "pts"), "classes")
    pairs = kept(families.near_pairs(one, max(families.EPS)), "pairs")
    return kept(found.join(families.search(one, pairs).withColumnRenamed("id", "rep"), ["g", "rep"]), "members"), pairs


@query(f"""WITH {RES}, {GRID}, {WRES}, {_LOOP_B} SELECT chain_id, start, "end", direction, length, round(path_len, 6) AS path_len, round(inner_dw, 6) AS inner_dw FROM lb""")
def n11_narrow_loops(spark, d):
    return families.bound_loops(narrow_loops(spark, d)).select("chain_id", "start", "end", "direction", "length", "path_len", "inner_dw")


@query(f"""WITH {RES}, {GRID}, {WRES}, {_runs(_INCLUSIVE)}, cand AS (SELECT a.chain_id, a.seg, greatest(a.start, a."end" - 2) AS start, least(b."end", b.start + 2) AS "end", a.label || '->' || b.label AS direction, b.seg AS other, b.label = a.label AS same, b.label <> a.label AND b.length >= 3 AND least(b."end", b.start + 2) - greatest(a.start, a."end" - 2) + 1 BETWEEN 7 AND 20 AS ok FROM nrun a JOIN nrun b ON a.chain_id = b.chain_id AND b.seg BETWEEN a.seg + 1 AND a.seg + 5 WHERE a.label IN ('alpha', 'beta') AND a.length >= 3 AND b.label IN ('alpha', 'beta')), pick AS (SELECT *, min(CASE WHEN same THEN other END) OVER w AS stop, min(CASE WHEN ok THEN other END) OVER w AS first FROM cand WINDOW w AS (PARTITION BY chain_id, seg)), sp AS (SELECT chain_id, start, "end", direction FROM pick WHERE ok AND other = first AND (stop IS NULL OR other < stop)) SELECT sp.chain_id, sp.start, sp."end", sp.direction, sp."end" - sp.start + 1 AS length, round(sum(CASE WHEN pos > sp.start THEN adw END), 6) AS delta_w, round(sum(CASE WHEN pos > sp.start THEN sqrt(dphi * dphi + dpsi * dpsi) END), 6) AS path_len FROM sp JOIN wres ON wres.chain_id = sp.chain_id AND pos BETWEEN sp.start AND sp."end" GROUP BY ALL""")
def n12_flanked_loops(spark, d):
    r = scored(spark, d).withColumn("basin", basins.basin(F.col("phi"), F.col("psi"), "inclusive"))
    return loops.extract_flanked(r).select("chain_id", "start", "end", "direction", "length", "delta_w", "path_len")


@query()
def l03_loop_families(spark, d):
    return members(spark, d)[0].select("g", "id", "eps", "clusters", "cluster")


@query()
def l04_family_statistics(spark, d):
    return families.statistics(members(spark, d)[0])


@query()
def l04_family_centroids(spark, d):
    return families.centroids(members(spark, d)[0]).select("g", "cluster", F.posexplode("centroid").alias("k", "p")).select("g", "cluster", "k", "p.phi", "p.psi")


@query()
def l05_refined_families(spark, d):
    return families.refined(*members(spark, d)).select("g", "id", "cluster")


@query()
def l06_null_families(spark, d):
    return families.control(kept(families.bound_loops(loops.extract(scored(spark, d))), "paths"))


@query()
def l08_density_clusters(spark, d):
    return families.density_clusters(loops.features(scored(spark, d)), rounds=0)


@query()
def l09_subsample_stability(spark, d):
    return families.stability(kept(families.density_clusters(loops.features(scored(spark, d))), "density"))


@query(f"""WITH {RES}, h AS (SELECT chain_id, avg(CASE WHEN basin = 'alpha' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN basin = 'beta' THEN 1.0 ELSE 0 END) AS b FROM res GROUP BY 1), x AS (SELECT CASE WHEN a >= 0.35 AND b < 0.10 THEN 'all-alpha' WHEN b >= 0.25 AND a < 0.15 THEN 'all-beta' WHEN a >= 0.20 AND b >= 0.15 THEN 'alpha/beta' WHEN a >= 0.10 AND b >= 0.10 THEN 'alpha+beta' ELSE 'other' END AS p, CASE WHEN 100 * a > 15 AND 100 * b > 15 THEN 'mixed' WHEN 100 * a > 40 AND 100 * b <= 15 THEN 'alpha-rich' WHEN 100 * b > 25 AND 100 * a <= 15 THEN 'beta-rich' ELSE 'Other' END AS q FROM h), n AS (SELECT p, q, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2), z AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS bo, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM n GROUP BY p)) AS ra, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM n GROUP BY q)) AS rb, (SELECT sum(n) FROM n) AS t) SELECT round(coalesce((bo - ra * rb / (t * (t - 1) / 2)) / nullif((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2), 0), 1.0), 6) AS ari, round(bo / nullif(ra + rb - bo, 0), 6) AS jaccard FROM z""")
def l09_agreement(spark, d):
    share = residues(spark, d).groupBy("chain_id").agg(F.avg((F.col("basin") == "alpha").cast("double")).alias("a"), F.avg((F.col("basin") == "beta").cast("double")).alias("b"))
    return families.agreement(share.select(basins.fold(F.col("a"), F.col("b")).alias("p"), basins.fold(100 * F.col("a"), 100 * F.col("b"), "percent").alias("q")), "p", "q")


@query()
def l10_family_forest(spark, d):
    rows = families.loop_features(members(spark, d)[0].where("cluster >= 0")).withColumn("family", F.concat_ws("|", "g", "cluster"))
    return families.forest(rows, "family", [f"f{k}" for k in range(26)])


_HEX = "CAST('0x' || substr(md5(concat_ws('|', '{m}', chain_id, pos)), 1, 8) AS BIGINT)"
_CDF = "cd0 AS (SELECT gi, gj, sum(w * w) OVER (ORDER BY gi * 360 + gj) / sum(w * w) OVER () AS c FROM wg), cdf AS MATERIALIZED (SELECT gi, gj, CASE WHEN gi = 359 AND gj = 359 THEN 1.0 ELSE c END AS c FROM cd0)"


@query(f"WITH {GRID} SELECT gi::BIGINT AS gi, gj::BIGINT AS gj, round(1e6 * w * w / sum(w * w) OVER (), 3) AS share_ppm FROM wg")
def w10_sampling_table(spark, d):
    """All cells with their steps, as the running sums themselves are too close to each other to be compared by rounding."""
    # n * n rows whatever the data.
    step = F.col("cdf") - F.coalesce(F.lag("cdf").over(Window.orderBy("gi", "gj")), F.lit(0.0))
    return generators.sampling_table(spark, potential.build()).select(F.col("gi").cast("bigint").alias("gi"), F.col("gj").cast("bigint").alias("gj"), F.round(1e6 * step, 3).alias("share_ppm"))


@query(f"WITH {RES}, {GRID}, {_CDF}, u AS (SELECT chain_id, pos, {_HEX.format(m='M10')} / 4294967296.0::DOUBLE AS u, {_HEX.format(m='M10a')} / 4294967296.0::DOUBLE AS a, {_HEX.format(m='M10b')} / 4294967296.0::DOUBLE AS b FROM res) SELECT chain_id, pos, round(-pi() + (gi + a) * 2 * pi() / 360, 6) AS phi, round(-pi() + (gj + b) * 2 * pi() / 360, 6) AS psi FROM u ASOF JOIN cdf ON u.u <= cdf.c")
def m10_table_draws(spark, d):
    return generators.from_table(residues(spark, d), potential.build()).select("chain_id", "pos", "phi", "psi")


@query(f"WITH {RES}, u AS (SELECT chain_id, pos, ({_HEX.format(m='M11a')} + 1) / 4294967297.0::DOUBLE AS u, {_HEX.format(m='M11b')} / 4294967296.0::DOUBLE AS v, {_HEX.format(m='M11')} / 4294967296.0::DOUBLE AS k FROM res), z AS (SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS x, sqrt(-2 * ln(u)) * sin(2 * pi() * v) AS y FROM u) SELECT chain_id, pos, round(radians(CASE WHEN k < 0.60 THEN -63 + 12 * x WHEN k < 0.85 THEN -120 + 15 * x ELSE 360 * u - 180 END), 6) AS phi, round(radians(CASE WHEN k < 0.60 THEN -43 + 12 * y WHEN k < 0.85 THEN 130 + 15 * y ELSE 360 * v - 180 END), 6) AS psi FROM z")
def m11_mixture(spark, d):
    return generators.mixture(residues(spark, d))


def _lengths(spark, d):
    return residues(spark, d).groupBy("chain_id", "organism").agg(F.count(F.lit(1)).cast("int").alias("length"))


@query()
def m08_pooled_markov(spark, d):
    return generators.pooled_markov(residues(spark, d), _lengths(spark, d))


@query()
def m09_neighbour_markov(spark, d):
    return walks.neighbour_walks(residues(spark, d), _lengths(spark, d)).select("chain_id", "pos", "phi", "psi")


@query()
def m12_polymer_models(spark, d):
    """Mean torus L1 step of the four models."""
    res, few = residues(spark, d), _lengths(spark, d)
    models = {"independent": generators.mixture(res), "steric": generators.steric(few), "conditional": generators.conditional(res, few), "real": res.select("chain_id", "pos", "phi", "psi")}
    out = None
    for name, rows in models.items():
        one = chains.stepped(rows).agg(F.count(F.lit(1)).alias("residues"), F.avg(F.abs("dphi") + F.abs("dpsi")).alias("torus_l1")).select(F.lit(name).alias("model"), "residues", "torus_l1")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def m13_protein_like(spark, d):
    return generators.protein_like(spark, 20)


_FOUR = "cos({a}phi) AS {p}0, sin({a}phi) AS {p}1, cos({a}psi) AS {p}2, sin({a}psi) AS {p}3"


@query(f"WITH {RES}, sp AS (SELECT chain_id, organism, pos, {_FOUR.format(a='', p='e')} FROM (SELECT *, lead(phi) OVER w AS np, lead(psi) OVER w AS ns FROM res WINDOW w AS (PARTITION BY chain_id ORDER BY pos)) WHERE phi IS NOT NULL AND psi IS NOT NULL AND np IS NOT NULL AND ns IS NOT NULL), qu AS (SELECT chain_id * 100000 + pos AS query_id, organism, {_FOUR.format(a='', p='q')} FROM res), r AS (SELECT query_id, sqrt((q0 - e0) * (q0 - e0) + (q1 - e1) * (q1 - e1) + (q2 - e2) * (q2 - e2) + (q3 - e3) * (q3 - e3)) AS distance FROM qu JOIN sp USING (organism)), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance) AS rank FROM r) SELECT query_id, rank, round(distance, 6) AS distance FROM k WHERE rank <= 50")
def j06_nearest_pairs(spark, d):
    r = residues(spark, d)
    asked = r.select((F.col("chain_id") * 100_000 + F.col("pos")).cast("bigint").alias("query_id"), "organism", "phi", "psi")
    return generators.nearest(asked, chains.successor_pairs(r), 50).select("query_id", "rank", "distance")


@query(f"WITH {RES}, {GRID}, x AS (SELECT chain_id, pos, (phi + pi()) * 360 / (2 * pi()) AS x, (psi + pi()) * 360 / (2 * pi()) AS y FROM ev), c AS MATERIALIZED (SELECT chain_id, pos, CAST(least(greatest(floor(x), 0), 358) AS INT) AS i, CAST(least(greatest(floor(y), 0), 358) AS INT) AS j, x, y FROM x), l AS MATERIALIZED (SELECT list(w ORDER BY gi * 360 + gj) AS w FROM wg) SELECT chain_id, pos, round((1 - (x - i)) * (1 - (y - j)) * l.w[i * 360 + j + 1] + (x - i) * (1 - (y - j)) * l.w[i * 360 + j + 361] + (1 - (x - i)) * (y - j) * l.w[i * 360 + j + 2] + (x - i) * (y - j) * l.w[i * 360 + j + 362], 6) AS w FROM c, l")
def w02_extrapolated(spark, d):
    return potential.with_bilinear(residues(spark, d), potential.grid_table(spark, potential.build()), edge="extrapolate").select("chain_id", "pos", "w")


@query()
def w06_variants(spark, d):
    """Extremes and means of the potential's variants; reflecting borders, scaled kappas, an absolute floor, a coarser grid."""
    made = {"reference": {}, "reflect": {"boundary": "reflect"}, "kappa_half": {"kappa_scale": 0.5}, "floor": {"floor": 1e-8}, "coarse": {"n": 180}}
    rows = [(k, float(w.min()), float(w.max()), float(w.mean())) for k, w in ((k, potential.build(**v)) for k, v in made.items())]
    return spark.createDataFrame(rows, "variant string, lo double, hi double, mean double")


@query()
def r02_backbone(spark, d):
    return kinematics.reconstructed(residues(spark, d))


@query()
def r04_clashes(spark, d):
    return kinematics.clashes(kept(kinematics.reconstructed(residues(spark, d)), "atoms"))


def _canonical(spark, d):
    # Read four times below: written once.
    wide = kept(residues(spark, d).select("chain_id", "pos", "resname", "phi", "psi", "basin"), "residues")
    found, _ = members(spark, d, potential.with_nearest(wide, potential.grid_table(spark, potential.build())))
    res = wide.withColumn("basin", basins.basin(F.col("phi"), F.col("psi"), "narrow"))
    return res, kinematics.canonical(res, found, kept(families.centroids(found), "centroids"))


@query()
def r05_canonical_angles(spark, d):
    return _canonical(spark, d)[1].select("chain_id", "pos", "kind", "phi", "psi")


@query()
def r07_rebuilt(spark, d):
    """Chains rebuilt from the angles of their own coordinates."""
    atoms = kept(kinematics.reconstructed(residues(spark, d)), "atoms")
    return kinematics.deviations(atoms, kinematics.reconstructed(kinematics.angles(atoms)))


@query()
def r08_canonical_deviation(spark, d):
    """The test tables hold no coordinates: chains built from observed angles stand for the experiment."""
    res, new = _canonical(spark, d)
    atoms = kept(kinematics.reconstructed(res), "atoms")
    return kinematics.compared(atoms, kinematics.reconstructed(kinematics.angles(atoms)), kinematics.reconstructed(new))


@query()
def g32_rejections(spark, d):
    """The proposals that the steric generator made and rejected for chains of the table's lengths."""
    return stats.rejections(generators.steric_attempts(_lengths(spark, d)))


@query(f"{FULL}, s AS (SELECT (bps_norm - avg(bps_norm) OVER ()) / stddev_pop(bps_norm) OVER () AS a, (torus_l1 - avg(torus_l1) OVER ()) / stddev_pop(torus_l1) OVER () AS b, (rg - avg(rg) OVER ()) / stddev_pop(rg) OVER () AS c FROM proteins) SELECT 'total' AS item, round(var_samp(a) + var_samp(b) + var_samp(c), 6) AS value FROM s")
def t04_total_variance(spark, d):
    """The eigenvalues sum to the trace of the covariance."""
    found = stats.principal(protein_table(spark, d), ["bps_norm", "torus_l1", "rg"])
    return spark.createDataFrame([("total", float(sum(found["eigenvalues"])))], "item string, value double")


@query()
def t04_principal_components(spark, d):
    names = ["length", "bps_norm", "torus_l1", "torus_l2", "rg", "contact_order", "pct_helix", "pct_sheet"]
    found = stats.principal(protein_table(spark, d), names)
    rows = [(k + 1, float(v), float(v / max(sum(found["eigenvalues"]), 1e-300)), n, float(found["loadings"][k][i])) for k, v in enumerate(found["eigenvalues"]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "component int, eigenvalue double, share double, variable string, loading double")


@query()
def t07_ratio_interval(spark, d):
    step = lambda r, name: chains.stepped(r).groupBy("chain_id").agg(F.avg(F.abs("dphi") + F.abs("dpsi")).alias("value")).withColumn("kind", F.lit(name))
    r = residues(spark, d)
    return stats.bootstrap_ratio(step(r, "real").unionByName(step(nulls.shuffled(r), "null")), "kind", "value")


@query(f"{FULL}, p AS (SELECT organism, chain_id % 4 AS setting, avg(bps_norm) AS m FROM proteins GROUP BY 1, 2) SELECT organism, count(*) AS settings, round(avg(m), 6) AS mean, round(100 * stddev_pop(m) / nullif(avg(m), 0), 6) AS cv_pct, round(max(m) - min(m), 6) AS spread FROM p GROUP BY 1")
def t24_sweep_variation(spark, d):
    """The four residues of the chain id stand for the settings of a sweep."""
    p = protein_table(spark, d).groupBy("organism", F.pmod("chain_id", F.lit(4)).alias("setting")).agg(F.avg("bps_norm").alias("m"))
    return stats.sweep_variation(p, "organism", "m")


@query(f"WITH {RES}, f AS (SELECT DISTINCT chain_id FROM res ORDER BY 1 LIMIT 10), v AS (SELECT count(*) AS n, count(*) FILTER (WHERE degrees(phi) > -100 AND degrees(phi) < -20) AS plus, count(*) FILTER (WHERE -degrees(phi) > -100 AND -degrees(phi) < -20) AS minus FROM res JOIN f USING (chain_id)) SELECT n, plus, minus, CASE WHEN plus >= minus THEN 1 ELSE -1 END AS sign, round(greatest(plus, minus) / n, 6) AS share, greatest(plus, minus) >= 2 * least(plus, minus) AS clear, greatest(plus, minus) / n > 0.15 AS decided FROM v")
def p03_sign_vote(spark, d):
    return quality.sign_vote(residues(spark, d))


@query(f"{FULL}, b AS (SELECT chain_id, plddt_mean * (1 + chain_id % 4) AS plddt_mean, rg * (chain_id % 5 - 1) * 20 AS rg, contact_order * (chain_id % 11) AS contact_order, pct_helix, pct_sheet, pct_coil + CASE WHEN chain_id % 6 = 0 THEN 2 ELSE 0 END AS pct_coil FROM proteins) SELECT chain_id, round(CASE WHEN plddt_mean BETWEEN 0 AND 100 THEN plddt_mean END, 6) AS plddt_mean, round(CASE WHEN rg > 0 AND rg <= 500 THEN rg END, 6) AS rg, round(CASE WHEN contact_order > 0 AND contact_order <= 1 THEN contact_order END, 6) AS contact_order FROM b WHERE pct_helix + pct_sheet + pct_coil > 99 AND pct_helix + pct_sheet + pct_coil < 101")
def p13_sanity(spark, d):
    """The view holds sane values only; some are put out of their limits first."""
    c = F.col("chain_id")
    bad = {"plddt_mean": F.col("plddt_mean") * (1 + c % 4), "rg": F.col("rg") * (c % 5 - 1) * 20, "contact_order": F.col("contact_order") * (c % 11), "pct_coil": F.col("pct_coil") + F.when(c % 6 == 0, 2).otherwise(0)}
    return quality.sane(protein_table(spark, d).withColumns(bad)).select("chain_id", "plddt_mean", "rg", "contact_order")


@query()
def m04_two_level(spark, d):
    return quality.two_level(residues(spark, d), potential.grid_table(spark, potential.build()))


_SHARES = "SELECT '{r}' AS resname, quartile, count(*) AS n, round(avg(bps_norm), 6) AS mean, round(coalesce(stddev_samp(bps_norm), 0), 6) AS sd FROM (SELECT bps_norm, CASE WHEN pct <= q1 THEN 1 WHEN pct <= q2 THEN 2 WHEN pct <= q3 THEN 3 ELSE 4 END AS quartile FROM (SELECT chain_id, 100.0 * count(*) FILTER (WHERE resname = '{r}') / count(*) AS pct FROM res GROUP BY 1 HAVING count(*) >= 10) s JOIN proteins USING (chain_id), (SELECT quantile_cont(pct, 0.25) AS q1, quantile_cont(pct, 0.5) AS q2, quantile_cont(pct, 0.75) AS q3 FROM (SELECT 100.0 * count(*) FILTER (WHERE resname = '{r}') / count(*) AS pct FROM res GROUP BY chain_id HAVING count(*) >= 10)) l) GROUP BY 1, 2"


@query(f"{FULL} {_SHARES.format(r='click')} UNION ALL {_SHARES.format(r='purchase')}")
def g27_composition(spark, d):
    """Two kinds of event stand for glycine and proline."""
    rough, r = kept(protein_table(spark, d).select("chain_id", "bps_norm"), "rough"), residues(spark, d)
    return quality.composition_quartiles(r, rough, "click").unionByName(quality.composition_quartiles(r, rough, "purchase"))


_CHAIN_STEP = "(SELECT chain_id, avg(abs(a) + abs(b)) AS s FROM (SELECT chain_id, atan2(sin(phi - lag(phi) OVER w), cos(phi - lag(phi) OVER w)) AS a, atan2(sin(psi - lag(psi) OVER w), cos(psi - lag(psi) OVER w)) AS b FROM {t} WINDOW w AS (PARTITION BY chain_id ORDER BY pos)) GROUP BY 1)"


@query(f"WITH {RES}, {_SHUFFLE} SELECT organism, count(*) AS n, round(avg(CASE WHEN n.s >= r.s THEN 1 ELSE 0 END), 6) AS p FROM {_CHAIN_STEP.format(t='res')} r JOIN {_CHAIN_STEP.format(t='pm')} n USING (chain_id) JOIN (SELECT DISTINCT chain_id, organism FROM res) o USING (chain_id) GROUP BY 1")
def t23_null_against_real(spark, d):
    """The share of chains whose shuffled copy is at least as rough as the chain, by organism."""
    r = residues(spark, d)
    w = Window.partitionBy("chain_id").orderBy("pos")
    turn = lambda a: F.abs(F.atan2(F.sin(F.col(a) - F.lag(a).over(w)), F.cos(F.col(a) - F.lag(a).over(w))))
    step = lambda rows, name: rows.select("chain_id", (turn("phi") + turn("psi")).alias("s")).groupBy("chain_id").agg(F.avg("s").alias(name))
    both = step(r, "real").join(step(nulls.shuffled(r), "null"), "chain_id").join(r.select("chain_id", "organism").distinct(), "chain_id")
    return both.groupBy("organism").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("null") >= F.col("real")).cast("double")).alias("p"))


@query()
def t_p_values(spark, d):
    """Statistics and p-values of the tests, and a verdict by the size of the difference."""
    p = kept(protein_table(spark, d), "proteins")
    found = {
        "pearson length bps": significance.pearson(p, "length", "bps"), "partial helix | length": significance.partial(p, "bps_norm", "pct_helix", "length"), "spearman length transitions": significance.spearman(p, "length", "n_transitions"),
        "t ecoli human": significance.two_sample_t(p, "bps_norm", "organism", "ecoli", "human"), "mann-whitney ecoli human": significance.mann_whitney(p, "length", "organism", "ecoli", "human"), "wilcoxon windings": significance.wilcoxon(p, "q_phi", "q_psi"), "f organisms": significance.one_way_f(p, "bps_norm", "organism"),
    }
    size = p.where("organism in ('ecoli', 'human')").groupBy("organism").agg(F.avg("bps_norm").alias("m"), F.stddev_samp("bps_norm").alias("s")).orderBy("organism").collect()
    cohen = (size[0].m - size[1].m) / ((size[0].s ** 2 + size[1].s ** 2) / 2) ** 0.5 if len(size) == 2 else 0.0
    return spark.createDataFrame([(name, float(s), float(v), significance.verdict(v, cohen)) for name, (s, v) in found.items()], "test string, statistic double, p double, verdict string")


@query()
def t18_models(spark, d):
    """Leave-one-out errors of the six predictor sets; a response of the view stands for the measured one."""
    p = kept(protein_table(spark, d), "proteins")
    sets = {"CO": ["contact_order"], "BPS": ["bps"], "BPS/res": ["bps_norm"], "CO + BPS": ["contact_order", "bps"], "CO + BPS/res": ["contact_order", "bps_norm"], "CO + BPS + L": ["contact_order", "bps", "length"]}
    found = [(name, significance.leave_one_out(p, "plddt_mean", xs)) for name, xs in sets.items()]
    return spark.createDataFrame([(name, x["n"], x["mae"], x["rmse"], x["r2_cv"]) for name, x in found], "model string, n bigint, mae double, rmse double, r2_cv double")


_REGISTRY = "(" + " UNION ALL ".join(f"SELECT {k} AS chain_id, 'reference {k}' AS name" for k in range(1, 24)) + ")"


@query(f"{FULL} SELECT chain_id, name, organism, round(bps_norm, 6) AS bps_norm FROM (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY organism) AS k FROM {_REGISTRY} JOIN proteins USING (chain_id)) WHERE k = 1")
def j11_first_match(spark, d):
    """The first row of every reference chain."""
    registry = spark.range(1, 24).select(F.col("id").alias("chain_id"), F.format_string("reference %d", "id").alias("name"))
    rows = F.broadcast(registry).join(protein_table(spark, d), "chain_id").withColumn("k", F.row_number().over(Window.partitionBy("chain_id").orderBy("organism")))
    return rows.where("k = 1").select("chain_id", "name", "organism", "bps_norm")


@query()
def l08_noise_share(spark, d):
    """One row: runs of other, labels, noise."""
    found = families.density_clusters(loops.features(scored(spark, d)), rounds=0)
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"), F.count_if(F.col("label") < 0).alias("noise"))
