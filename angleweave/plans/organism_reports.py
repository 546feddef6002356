"""Report queries whose thresholds, bins and least counts are parameters.

Text is Spark SQL with $P for the proteins view, as in reports. DEFAULTS holds fixed values; FITTED has smaller ones, by
which the short chains and small organisms of the test tables fill every cell, and its reports end in _fitted.
"""

from __future__ import annotations

from itertools import combinations

from ..functions.basins import KINGDOMS
from .reports import _corr

#: Fixed values.
DEFAULTS = {
    "short": 30, "least_organism": 10, "size_edges": (100, 300, 1000), "least_cell": 5, "least_regression": 50,
    "tiers": (0, 50, 70, 90, 101), "confident": (0, 70, 80, 85, 90, 95), "helix": 40, "sheet": 25, "minor": 15, "coil": 80, "least_class": 11,
    "targets": (50, 100, 200, 300, 500, 800, 1000, 1500), "near": (100, 25, 50), "least_pooled": 10,
    "coarse": (20, 10), "fine": (5, 5), "fine_cells": (20, 12), "size_control": (200, 400), "length_bins": (50, 100, 200, 400, 800),
    "resolution": "rg / 5", "resolution_tiers": ((0, 1.0), (0, 1.5), (0, 2.0), (0, 2.5), (1.5, 2.0), (2.0, 2.5)),
    "match_edges": (0, 50, 70, 85, 90, 95, 101), "match_most": 200, "match_least": 50, "match_reference": "ecoli", "match_least_organism": 200, "least_audit": 100,
    "extreme": (0.03, 0.40), "fold": (0.35, 0.10, 0.25, 0.15, 0.20, 0.15, 0.10),
}

FITTED = DEFAULTS | {
    "short": 60, "size_edges": (60, 70), "least_cell": 3, "least_regression": 3, "tiers": (0, 48, 50, 52, 101), "confident": (0, 48, 50, 52),
    "helix": 20, "sheet": 10, "minor": 15, "coil": 65, "least_class": 2, "targets": (55, 65, 75, 85), "near": (100, 8, 8), "coarse": (5, 2), "fine": (2, 2), "fine_cells": (50, 30),
    "size_control": (55, 80), "length_bins": (50, 60, 70, 80), "match_edges": (0, 47, 50, 53, 101), "match_least": 5, "match_least_organism": 5, "fold": (0.20, 0.10, 0.10, 0.15, 0.15, 0.10, 0.05),
}


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


BACTERIA = _in(KINGDOMS["Bacteria"])
KINGDOM = "CASE " + " ".join(f"WHEN organism IN {_in(names)} THEN '{kingdom}'" for kingdom, names in KINGDOMS.items()) + " ELSE '?' END"
_MOMENTS = "count(*) AS n, round(avg(bps_norm), 6) AS mean, round(sqrt(greatest(avg(bps_norm * bps_norm) - avg(bps_norm) * avg(bps_norm), 0)), 6) AS sd"


def _bins(column: str, edges: tuple) -> str:
    """The place of a value between edges, null outside; the upper edge of a bin belongs to the next."""
    return "CASE " + " ".join(f"WHEN {column} >= {a} AND {column} < {z} THEN {k}" for k, (a, z) in enumerate(zip(edges, edges[1:]))) + " END"


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


def _classes(p: dict) -> list[tuple[str, str]]:
    """Fold classes that may overlap."""
    return [("alpha-rich", f"pct_helix > {p['helix']} AND pct_sheet < {p['minor']}"), ("beta-rich", f"pct_sheet > {p['sheet']} AND pct_helix < {p['minor']}"), ("mixed", f"pct_helix > {p['minor']} AND pct_sheet > {p['minor']}"), ("coil", f"pct_coil > {p['coil']}")]


def _fold(p: dict) -> str:
    a, b, c, d, e, f, g = p["fold"]
    h, s = "pct_helix / 100", "pct_sheet / 100"
    return f"CASE WHEN {h} >= {a} AND {s} < {b} THEN 'all-alpha' WHEN {s} >= {c} AND {h} < {d} THEN 'all-beta' WHEN {h} >= {e} AND {s} >= {f} THEN 'alpha/beta' WHEN {h} >= {g} AND {s} >= {g} THEN 'alpha+beta' ELSE 'other' END"


def _audit(p: dict) -> str:
    """Every check with its count and status."""
    nulls = [f"SELECT 'null {c}' AS item, count(CASE WHEN {c} IS NULL THEN 1 END) AS bad, CASE WHEN 100 * count(CASE WHEN {c} IS NULL THEN 1 END) < count(*) THEN 'OK' WHEN 20 * count(CASE WHEN {c} IS NULL THEN 1 END) < count(*) THEN 'WARN' ELSE 'BAD' END AS status FROM $P" for c in ("bps_norm", "plddt_mean", "pct_helix", "rg", "contact_order")]
    lo, hi = p["extreme"]
    hard = [("plddt out of range", "plddt_mean < 0 OR plddt_mean > 100"), ("shares not 100", "abs(pct_helix + pct_sheet + pct_coil - 100.0) > 1.0"), ("rg not positive", "rg <= 0"), ("contact order not positive", "contact_order <= 0")]
    checks = [f"SELECT '{name}' AS item, count(CASE WHEN {test} THEN 1 END) AS bad, CASE WHEN count(CASE WHEN {test} THEN 1 END) = 0 THEN 'OK' ELSE 'BAD' END AS status FROM $P" for name, test in hard]
    extreme = f"SELECT 'extreme roughness' AS item, count(CASE WHEN bps_norm < {lo} OR bps_norm > {hi} THEN 1 END) AS bad, 'INFO' AS status FROM $P"
    shared = "SELECT 'ids of several organisms' AS item, count(*) AS bad, 'INFO' AS status FROM (SELECT chain_id FROM $P GROUP BY chain_id HAVING count(DISTINCT organism) > 1) s"
    small = f"SELECT concat('small: ', organism) AS item, count(*) AS bad, 'WARN' AS status FROM $P GROUP BY organism HAVING count(*) < {p['least_audit']}"
    return _union([*nulls, extreme, *checks, shared, small])


def _minor(rows: list[str], columns: list[str]) -> str:
    """The determinant of the correlation matrix of some columns, by expansion along the first row. Entries are r_<a>_<b> of _R."""
    if not rows:
        return "1.0"
    head, out = rows[0], []
    for k, c in enumerate(columns):
        entry = "1.0" if head == c else f"r_{min(head, c)}_{max(head, c)}"
        out.append(f"{'-' if k % 2 else '+'} {entry} * ({_minor(rows[1:], columns[:k] + columns[k + 1 :])})")
    return " ".join(out).removeprefix("+ ")


_MODELS = {"CO": ["co"], "BPS": ["bps"], "BPS/res": ["norm"], "CO + BPS": ["co", "bps"], "CO + BPS/res": ["co", "norm"], "CO + BPS + L": ["co", "bps", "len"]}
_SOURCES = {"y": "plddt_mean", "co": "contact_order", "bps": "bps", "norm": "bps_norm", "len": "length"}
_R = "(SELECT count(*) AS n, var_pop(plddt_mean) AS v, " + ", ".join(f"corr({_SOURCES[a]}, {_SOURCES[b]}) AS r_{min(a, b)}_{max(a, b)}" for a, b in combinations(_SOURCES, 2)) + " FROM $P)"


def _models() -> str:
    """R2 of six predictor sets as one less a quotient of determinants; a response of the view stands for the measured one."""
    r2 = [f"SELECT '{name}' AS model, {len(xs)} AS k, n, v, 1 - ({_minor(['y', *xs], ['y', *xs])}) / nullif({_minor(xs, xs)}, 0) AS r2 FROM {_R} q{i}" for i, (name, xs) in enumerate(_MODELS.items())]
    return f"SELECT model, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - k - 1), 6) AS adj_r2, round(sqrt(greatest(v * (1 - r2), 0)), 6) AS rmse FROM ({_union(r2)}) m"


def _matched(p: dict) -> str:
    """Targets by tier after a reference organism, and the exact mean and standard error of resampling each tier to its target."""
    tier, n_tiers = _bins("plddt_mean", p["match_edges"]), len(p["match_edges"]) - 1
    rows = f"(SELECT organism, bps_norm, {tier} AS tier FROM $P WHERE plddt_mean IS NOT NULL AND length >= 30)"
    share = f"(SELECT tier, count(*) / sum(count(*)) OVER () AS share FROM {rows} r WHERE organism = '{p['match_reference']}' GROUP BY tier)"
    sizes = f"(SELECT organism, count(*) AS total, avg(bps_norm) AS raw FROM {rows} r GROUP BY organism HAVING count(*) >= {p['match_least_organism']})"
    tiers = _union([f"SELECT {k} AS tier" for k in range(n_tiers)])
    cells = f"(SELECT organism, tier, count(*) AS available, avg(bps_norm) AS m, var_pop(bps_norm) AS v FROM {rows} r GROUP BY organism, tier)"
    first = f"(SELECT s.organism, s.total, s.raw, t.tier, coalesce(c.available, 0) AS available, c.m, c.v, floor(coalesce(f.share, 0) * least({p['match_most']}, s.total) + 1e-9) AS target FROM {sizes} s CROSS JOIN ({tiers}) t LEFT JOIN {share} f ON f.tier = t.tier LEFT JOIN {cells} c ON c.organism = s.organism AND c.tier = t.tier)"
    scaled = f"(SELECT *, coalesce(min(CASE WHEN target > 0 AND available > 0 THEN least(available / target, 1.0) END) OVER (PARTITION BY organism), 0) AS scale, min(CASE WHEN target > available THEN 0 ELSE 1 END) OVER (PARTITION BY organism) AS feasible FROM {first} a)"
    final = f"(SELECT organism, total, raw, m, v, CASE WHEN available = 0 THEN 0 WHEN feasible = 1 THEN target ELSE floor(target * scale + 1e-9) END AS target FROM {scaled} b)"
    return f"SELECT organism, max(total) AS total, cast(sum(target) AS bigint) AS matched, round(max(raw), 6) AS raw, round(CASE WHEN sum(target) >= {p['match_least']} THEN sum(target * m) / sum(target) END, 6) AS matched_mean, round(CASE WHEN sum(target) >= {p['match_least']} THEN sqrt(sum(target * v)) / sum(target) END, 6) AS se FROM {final} c GROUP BY organism"


def reports(p: dict) -> dict[str, str]:
    edges = (0, *p["size_edges"], 1_000_000)
    cells = [(f"CASE WHEN length >= {a} AND length < {z} THEN bps_norm END", k) for k, (a, z) in enumerate(zip(edges, edges[1:]))]
    bacteria, rest = f"CASE WHEN organism IN {BACTERIA} THEN bps_norm END", f"CASE WHEN organism NOT IN {BACTERIA} THEN bps_norm END"
    near, small, wide = p["near"]
    window = lambda t: f"BETWEEN {t - (small if t <= near else wide)} AND {t + (small if t <= near else wide)}"
    targets = [f"SELECT {t} AS target, organism, bps_norm FROM $P WHERE length {window(t)}" for t in p["targets"]]
    lo, hi = p["size_control"]
    resolution, length_edges = p["resolution"], (*p["length_bins"], 1_000_000)
    fold = f"(SELECT organism, bps_norm, {_fold(p)} AS fold FROM $P)"
    by_fold = f"(SELECT fold, count(*) AS organisms, sum(n) AS n, avg(m) AS mean, 100 * stddev_pop(m) / nullif(avg(m), 0) AS cv FROM (SELECT fold, organism, count(*) AS n, avg(bps_norm) AS m FROM {fold} f GROUP BY fold, organism HAVING count(*) >= {p['least_cell']}) o GROUP BY fold)"
    pairs = f"{_corr('contact_order', 'bps_norm')} AS r_co, {_corr('rg', 'bps_norm')} AS r_rg, {_corr('rg / sqrt(length)', 'bps_norm')} AS r_rg_norm"
    coarse, least_coarse = p["coarse"]
    fine, least_fine = p["fine"]
    across, down = p["fine_cells"]
    of_class = "count(*) AS n, round(avg(bps_norm), 6) AS mean, round(stddev_pop(bps_norm), 6) AS sd, round(avg(length), 6) AS len, round(avg(plddt_mean), 6) AS plddt"
    inside = "bps_norm > 0.02 AND bps_norm < 0.5"
    groups = {
        "all": "1 = 1", **{f"length {k}": f"length >= {a} AND length < {z}" for k, (a, z) in enumerate(zip(edges, edges[1:]))}, **dict(_classes(p)),
        **{f"fold {f}": f"({_fold(p)}) = '{f}'" for f in ("all-alpha", "all-beta", "alpha/beta", "alpha+beta", "other")},
    }
    return {
        "g02_failures": f"SELECT error_type, n, row_number() OVER (ORDER BY n DESC, error_type) AS place FROM (SELECT CASE WHEN plddt_mean IS NULL OR bps IS NULL THEN 'parse' WHEN length < {p['short']} THEN 'short' END AS error_type, count(*) AS n FROM $P GROUP BY 1) q WHERE error_type IS NOT NULL",
        "g03_fingerprints": f"SELECT organism, {_MOMENTS}, round(avg(length), 6) AS len, round(avg(q_phi), 6) AS q_phi, round(avg(q_psi), 6) AS q_psi, round(avg(q_mag), 6) AS q_mag, round(avg(q_norm), 6) AS q_norm, round(avg(pct_helix), 6) AS helix, round(avg(pct_sheet), 6) AS sheet, round(avg(pct_coil), 6) AS coil, round(avg(rg), 6) AS rg, round(avg(contact_order), 6) AS co, round(avg(plddt_mean), 6) AS plddt, round(avg(n_transitions), 6) AS transitions FROM $P GROUP BY organism HAVING count(*) >= {p['least_organism']} ORDER BY mean DESC",
        "g04_size_classes": "SELECT organism, " + ", ".join(f"count({c}) AS n_{k}, round(CASE WHEN count({c}) >= {p['least_cell']} THEN avg({c}) END, 6) AS mean_{k}" for c, k in cells) + " FROM $P GROUP BY organism",
        "g05_length_regression": f"SELECT organism, count(*) AS n, round(covar_pop(length, bps) / nullif(var_pop(length), 0), 6) AS slope, round(avg(bps) - covar_pop(length, bps) / nullif(var_pop(length), 0) * avg(length), 6) AS intercept, {_corr('length', 'bps')} AS r, round(covar_pop(length, bps) * covar_pop(length, bps) / nullif(var_pop(length) * var_pop(bps), 0), 6) AS r2 FROM $P GROUP BY organism HAVING count(*) >= {p['least_regression']}",
        "g06_kingdoms": f"SELECT kingdom, count(*) AS organisms, sum(n) AS chains, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd FROM (SELECT organism, {KINGDOM} AS kingdom, count(*) AS n, avg(bps_norm) AS m FROM $P GROUP BY organism) q GROUP BY kingdom",
        "g06_bacteria_eukaryotes": f"SELECT n1 AS bacteria, n2 AS eukaryotes, round(m1, 6) AS mean_1, round(m2, 6) AS mean_2, round(m1 - m2, 6) AS gap FROM (SELECT count(CASE WHEN k = 'Bacteria' THEN 1 END) AS n1, count(CASE WHEN k NOT IN ('Bacteria', '?') THEN 1 END) AS n2, avg(CASE WHEN k = 'Bacteria' THEN m END) AS m1, avg(CASE WHEN k NOT IN ('Bacteria', '?') THEN m END) AS m2 FROM (SELECT {KINGDOM} AS k, avg(bps_norm) AS m FROM $P GROUP BY organism) a) b",
        "g07_plddt_tiers": f"SELECT tier, {_MOMENTS} FROM (SELECT bps_norm, {_bins('plddt_mean', p['tiers'])} AS tier FROM $P) q WHERE tier IS NOT NULL GROUP BY tier",
        "g08_fold_overlap": _union([f"SELECT '{name}' AS class, {of_class} FROM $P WHERE {test}" for name, test in _classes(p)]),
        "g08_structure_correlation": f"SELECT organism, count(*) AS n, {_corr('pct_helix', 'bps_norm')} AS r_helix, {_corr('pct_sheet', 'bps_norm')} AS r_sheet FROM $P GROUP BY organism",
        "g09_contact_order": f"SELECT organism, {pairs} FROM $P GROUP BY organism UNION ALL SELECT 'all' AS organism, {pairs} FROM $P",
        "g14_confident_separation": "SELECT least_plddt, n, round(bacteria, 6) AS bacteria, round(others, 6) AS others, round(bacteria - others, 6) AS gap, CASE WHEN abs(bacteria - others) > abs(first_value(bacteria - others) OVER (ORDER BY least_plddt)) THEN 'wider' WHEN abs(bacteria - others) < abs(first_value(bacteria - others) OVER (ORDER BY least_plddt)) THEN 'narrower' ELSE 'same' END AS verdict FROM (" + _union([f"SELECT {t} AS least_plddt, count(*) AS n, avg({bacteria}) AS bacteria, avg({rest}) AS others FROM $P WHERE plddt_mean >= {t}" for t in p["confident"]]) + ") q",
        "g15_versions": "SELECT organism, count(CASE WHEN af_version = 3 THEN 1 END) AS v3, count(CASE WHEN af_version = 4 THEN 1 END) AS v4, count(DISTINCT af_version) > 1 AS mixed FROM $P GROUP BY organism UNION ALL SELECT 'all' AS organism, count(CASE WHEN af_version = 3 THEN 1 END) AS v3, count(CASE WHEN af_version = 4 THEN 1 END) AS v4, count(DISTINCT af_version) > 1 AS mixed FROM $P",
        "g16_integrity": _audit(p),
        "g19_fold_table": f"SELECT fold, {_MOMENTS}, round(100 * stddev_pop(bps_norm) / nullif(avg(bps_norm), 0), 6) AS cv FROM {fold} f GROUP BY fold",
        "g20_within_fold_cv": f"SELECT fold, organisms, n, round(mean, 6) AS mean, round(cv, 6) AS cv, round(100.0 * n / sum(n) OVER (), 6) AS composition FROM {by_fold} b",
        "g20_summary": f"SELECT count(*) AS folds, round(sum(cv * n) / sum(n), 6) AS weighted_cv, round(avg(cv), 6) AS plain_cv, round(max(mean) - min(mean), 6) AS separation FROM {by_fold} b",
        "g22_size_convergence": f"SELECT target, organism, {_MOMENTS} FROM ({_union(targets)}) q GROUP BY target, organism HAVING count(*) >= {p['least_cell']} UNION ALL SELECT target, 'all' AS organism, {_MOMENTS} FROM ({_union(targets)}) q GROUP BY target HAVING count(*) >= {p['least_pooled']}",
        "g23_heat_map_coarse": f"SELECT cast(floor(pct_helix / {coarse}) AS int) AS hx, cast(floor(pct_sheet / {coarse}) AS int) AS sx, {_MOMENTS} FROM $P WHERE pct_helix < 100 AND pct_sheet < 100 GROUP BY 1, 2 HAVING count(*) >= {least_coarse}",
        "g23_heat_map": f"SELECT cast(floor(pct_helix / {fine}) AS int) AS hx, cast(floor(pct_sheet / {fine}) AS int) AS sx, {_MOMENTS} FROM $P WHERE pct_helix < {fine * across} AND pct_sheet < {fine * down} GROUP BY 1, 2 HAVING count(*) >= {least_fine}",
        "g24_size_control": _union([f"SELECT '{name}' AS class, {of_class} FROM $P WHERE length >= {lo} AND length <= {hi} AND {test} HAVING count(*) >= {p['least_class']}" for name, test in _classes(p)]),
        "g25_length_bins": f"SELECT bin, count(*) AS n, round(avg(torus_l1) / avg(torus_l2), 6) AS ratio, round(avg(length), 6) AS len FROM (SELECT torus_l1, torus_l2, length, {_bins('length', length_edges)} AS bin FROM $P) q WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) >= {p['least_cell']}",
        "g26_tiers": _union([f"SELECT '{a} to {z}' AS tier, {_MOMENTS}, round(100 * stddev_pop(bps_norm) / nullif(avg(bps_norm), 0), 6) AS cv FROM $P WHERE {resolution} > {a} AND {resolution} <= {z} HAVING count(*) >= {p['least_cell']}" for a, z in p["resolution_tiers"]]),
        "g33_outliers": _union([f"SELECT '{name}' AS part, count(*) AS n, count(CASE WHEN NOT ({inside}) THEN 1 END) AS outliers, round(avg(bps_norm), 6) AS with_all, round(avg(CASE WHEN {inside} THEN bps_norm END), 6) AS without, {_corr(resolution, 'bps_norm')} AS r_resolution FROM $P WHERE {test}" for name, test in groups.items()]),
        "j05_interval_overlap": "SELECT a.organism AS org_a, b.organism AS org_b FROM (SELECT organism, avg(bps_norm) - 1.96 * stddev_samp(bps_norm) / sqrt(count(*)) AS lo, avg(bps_norm) + 1.96 * stddev_samp(bps_norm) / sqrt(count(*)) AS hi FROM $P GROUP BY organism) a JOIN (SELECT organism, avg(bps_norm) - 1.96 * stddev_samp(bps_norm) / sqrt(count(*)) AS lo, avg(bps_norm) + 1.96 * stddev_samp(bps_norm) / sqrt(count(*)) AS hi FROM $P GROUP BY organism) b ON a.organism < b.organism AND a.lo <= b.hi AND b.lo <= a.hi",
        "o06_global_sample": "SELECT organism, chain_id FROM (SELECT organism, chain_id, row_number() OVER (ORDER BY md5(concat_ws('|', cast(chain_id AS string), '42')), chain_id) AS k FROM $P) q WHERE k <= 200",
        "o11_train_test": "SELECT chain_id, CASE WHEN 10 * (row_number() OVER (ORDER BY md5(concat_ws('|', cast(chain_id AS string), 'split')), chain_id)) <= count(*) OVER () THEN 'build' ELSE 'test' END AS part FROM $P",
        "t05_variance_split": f"SELECT round(sum(ss_kingdom), 6) AS kingdom_ss, round(sum(ss_organism), 6) AS organism_ss, round(sum(ss_within), 6) AS within_ss, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(ss_within) / (sum(n) - count(*))), 4) AS f FROM (SELECT n, m, g, ss_within, n * (km - g) * (km - g) AS ss_kingdom, n * (m - km) * (m - km) AS ss_organism FROM (SELECT *, sum(n * m) OVER (PARTITION BY kingdom) / sum(n) OVER (PARTITION BY kingdom) AS km, sum(n * m) OVER () / sum(n) OVER () AS g FROM (SELECT organism, {KINGDOM} AS kingdom, count(*) AS n, avg(bps_norm) AS m, var_pop(bps_norm) * count(*) AS ss_within FROM $P GROUP BY organism) a) b) c",
        "t08_matched_means": _matched(p),
        "t15_cohens_d": "SELECT round((m1 - m2) / nullif(sqrt((s1 * s1 + s2 * s2) / 2), 0), 6) AS d_equal, round((m1 - m2) / nullif(sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)), 0), 6) AS d_pooled FROM (SELECT count(CASE WHEN organism = 'ecoli' THEN 1 END) AS n1, count(CASE WHEN organism = 'human' THEN 1 END) AS n2, avg(CASE WHEN organism = 'ecoli' THEN bps_norm END) AS m1, avg(CASE WHEN organism = 'human' THEN bps_norm END) AS m2, stddev_samp(CASE WHEN organism = 'ecoli' THEN bps_norm END) AS s1, stddev_samp(CASE WHEN organism = 'human' THEN bps_norm END) AS s2 FROM $P) q",
        "t17_model_comparison": _models(),
    }


def every() -> dict[str, str]:
    """The reports by their defaults, and those whose text the fitted parameters change."""
    default, fitted = reports(DEFAULTS), reports(FITTED)
    return default | {f"{name}_fitted": text for name, text in fitted.items() if text != default[name]}
