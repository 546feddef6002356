"""Report queries over the proteins view. Text is Spark SQL with $P for the view; the other dialect differs in percentiles only."""

from __future__ import annotations


def other_dialect(text: str) -> str:
    return text.replace("$P", "proteins").replace("LEFT ANTI JOIN", "ANTI JOIN").replace("percentile(", "quantile_cont(")


def _corr(x: str, y: str) -> str:
    """Guarded Pearson r."""
    return f"round(CASE WHEN count(*) >= 5 AND stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END, 6)"


def _slope(y: str, x: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(var_pop({x}), 0)"


_PAIR = ("bps_norm", "length", "pct_helix", "pct_sheet", "pct_coil", "plddt_mean", "rg", "contact_order")
_KS = "SELECT organism, bps_norm AS x FROM $P"

REPORTS = {
    "g01_moments": "SELECT organism, count(*) AS n, round(avg(bps_norm), 6) AS mean, round(sqrt(greatest(avg(bps_norm * bps_norm) - avg(bps_norm) * avg(bps_norm), 0)), 6) AS sd FROM $P GROUP BY organism",
    "g02_overview": "SELECT count(*) AS n, count(DISTINCT organism) AS organisms, round(min(bps_norm), 6) AS lo, round(max(bps_norm), 6) AS hi, round(avg(bps_norm), 6) AS mean FROM $P",
    "g07_plddt_correlation": f"SELECT organism, {_corr('plddt_mean', 'bps_norm')} AS r FROM $P GROUP BY organism",
    "g12_histogram": "SELECT b.bin, round(100.0 * count(*) / max(t.n), 6) AS pct FROM (SELECT CASE WHEN bps_norm = 0.35 THEN 11 ELSE cast(floor((bps_norm - 0.05) / 0.025) AS int) END AS bin FROM $P WHERE bps_norm >= 0.05 AND bps_norm <= 0.35) b CROSS JOIN (SELECT count(*) AS n FROM $P) t GROUP BY b.bin",
    "g13_correlations": "SELECT " + ", ".join(f"{_corr(a, b)} AS r_{i}_{j}" for i, a in enumerate(_PAIR) for j, b in enumerate(_PAIR) if i < j) + " FROM $P",
    "g27_quartiles": "SELECT quartile, count(*) AS n, round(avg(bps_norm), 6) AS mean FROM (SELECT p.bps_norm, CASE WHEN p.pct_helix <= q.q1 THEN 1 WHEN p.pct_helix <= q.q2 THEN 2 WHEN p.pct_helix <= q.q3 THEN 3 ELSE 4 END AS quartile FROM $P p CROSS JOIN (SELECT percentile(pct_helix, 0.25) AS q1, percentile(pct_helix, 0.5) AS q2, percentile(pct_helix, 0.75) AS q3 FROM $P) q) z GROUP BY quartile",
    "g28_other_warning": "SELECT round(100.0 * avg(CASE WHEN pct_helix < 35 AND pct_sheet < 25 THEN 1 ELSE 0 END), 6) AS pct_other, avg(CASE WHEN pct_helix < 35 AND pct_sheet < 25 THEN 1 ELSE 0 END) > 0.9 AS warn FROM $P",
    "g35_error_bars": "SELECT organism, round(avg(bps_norm), 6) AS mean, round(1.96 * stddev_pop(bps_norm) / sqrt(count(*)), 6) AS bar FROM $P GROUP BY organism ORDER BY mean",
    "j04_organism_pairs": "SELECT a.organism AS org_a, b.organism AS org_b, round(abs(a.m - b.m), 6) AS gap FROM (SELECT organism, avg(bps_norm) AS m FROM $P GROUP BY organism) a JOIN (SELECT organism, avg(bps_norm) AS m FROM $P GROUP BY organism) b ON a.organism < b.organism",
    "j03_o02_remaining": "SELECT p.chain_id, p.organism FROM $P p LEFT ANTI JOIN (SELECT chain_id FROM $P WHERE length >= 70 UNION SELECT chain_id FROM $P WHERE bps_norm > 0.5) s ON p.chain_id = s.chain_id",
    "o05_o07_samples": "SELECT organism, chain_id FROM (SELECT organism, chain_id, row_number() OVER (PARTITION BY organism ORDER BY md5(concat_ws('|', cast(chain_id AS string), '42'))) AS k FROM $P) q WHERE k <= 5",
    "o04_top_pairs": "SELECT chain_id, round(bps_norm, 6) AS bps_norm FROM $P ORDER BY bps_norm DESC, chain_id LIMIT 15",
    "o12_having": "SELECT count(*) AS n, round(avg(bps_norm), 6) AS mean FROM $P HAVING count(*) > 10",
    "t02_partial_correlation": "SELECT round((rxy - rxz * ryz) / nullif(sqrt((1 - rxz * rxz) * (1 - ryz * ryz)), 0), 6) AS r FROM (SELECT corr(bps_norm, pct_helix) AS rxy, corr(bps_norm, length) AS rxz, corr(pct_helix, length) AS ryz FROM $P) q",
    "t09_log_length_fit": f"SELECT round({_slope('torus_l1', 'log10(length)')}, 6) AS slope, round(avg(torus_l1) - {_slope('torus_l1', 'log10(length)')} * avg(log10(length)), 6) AS intercept FROM $P",
    "t10_two_sample_t": "SELECT round((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 0), 6) AS t, n1 + n2 - 2 AS df FROM (SELECT count(CASE WHEN organism = 'ecoli' THEN 1 END) AS n1, count(CASE WHEN organism = 'human' THEN 1 END) AS n2, avg(CASE WHEN organism = 'ecoli' THEN bps_norm END) AS m1, avg(CASE WHEN organism = 'human' THEN bps_norm END) AS m2, var_samp(CASE WHEN organism = 'ecoli' THEN bps_norm END) AS v1, var_samp(CASE WHEN organism = 'human' THEN bps_norm END) AS v2 FROM $P) q",
    "t11_mann_whitney": "SELECT round(sum(CASE WHEN organism = 'ecoli' THEN rk ELSE 0 END) - count(CASE WHEN organism = 'ecoli' THEN 1 END) * (count(CASE WHEN organism = 'ecoli' THEN 1 END) + 1) / 2.0, 6) AS u FROM (SELECT organism, rank() OVER (ORDER BY length) + (count(*) OVER (PARTITION BY length) - 1) / 2.0 AS rk FROM $P WHERE organism IN ('ecoli', 'human')) q",
    "t12_wilcoxon": "SELECT round(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), 6) AS w_plus, round(sum(CASE WHEN d < 0 THEN rk ELSE 0 END), 6) AS w_minus FROM (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM (SELECT round(q_phi - q_psi, 4) AS d FROM $P) a WHERE d <> 0) b",
    "t16_spearman": "SELECT round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY length) + (count(*) OVER (PARTITION BY length) - 1) / 2.0 AS ra, rank() OVER (ORDER BY n_transitions) + (count(*) OVER (PARTITION BY n_transitions) - 1) / 2.0 AS rb FROM $P) q",
    "t19_histogram_kl": "SELECT round(sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END), 6) AS kl, round(sum(abs(p - q)), 6) AS l1, round(covar_pop(p, q) / nullif(stddev_pop(p) * stddev_pop(q), 0), 6) AS r FROM (SELECT bin, sum(a) / (sum(sum(a)) OVER ()) AS p, sum(b) / (sum(sum(b)) OVER ()) AS q FROM (SELECT floor(bps_norm * 20) AS bin, CASE WHEN organism = 'ecoli' THEN 1 ELSE 0 END AS a, CASE WHEN organism = 'human' THEN 1 ELSE 0 END AS b FROM $P) x GROUP BY bin) y WHERE q > 0 OR p > 0",
    "t22_weighted_gap": "SELECT round(sum(n * gap) / sum(n), 6) AS gap FROM (SELECT organism, count(*) AS n, avg(torus_l1) - avg(torus_l2) AS gap FROM $P GROUP BY organism) q",
    "t23_empirical_p": "SELECT round(avg(CASE WHEN torus_l1 >= t.m THEN 1 ELSE 0 END), 6) AS p FROM $P CROSS JOIN (SELECT avg(torus_l1) AS m FROM $P) t",
}

_NAMES = "(SELECT DISTINCT organism FROM $P)"
_DUOS = f"(SELECT a.organism AS org_a, b.organism AS org_b FROM {_NAMES} a JOIN {_NAMES} b ON a.organism < b.organism)"
_SIDES = f"(SELECT org_a, org_b, org_a AS member, 1 AS ia, 0 AS ib FROM {_DUOS} d1 UNION ALL SELECT org_a, org_b, org_b AS member, 0 AS ia, 1 AS ib FROM {_DUOS} d2)"
_MASSES = f"(SELECT s.org_a, s.org_b, p.bps_norm AS x, sum(s.ia) AS ca, sum(s.ib) AS cb FROM $P p JOIN {_SIDES} s ON p.organism = s.member GROUP BY s.org_a, s.org_b, p.bps_norm)"
_UP = "(PARTITION BY org_a, org_b ORDER BY x)"
_ALL = "(PARTITION BY org_a, org_b)"
_GAPS = f"(SELECT org_a, org_b, abs(sum(ca) OVER {_UP} / sum(ca) OVER {_ALL} - sum(cb) OVER {_UP} / sum(cb) OVER {_ALL}) AS gap, lead(x) OVER {_UP} - x AS width FROM {_MASSES} m)"
_MEANS = "(SELECT organism, count(*) AS n, avg(bps_norm) AS m FROM $P GROUP BY organism)"

REPORTS |= {
    "g10_distribution_distances": f"SELECT org_a, org_b, round(distance, 6) AS distance, near_rank, far_rank FROM (SELECT *, row_number() OVER (ORDER BY distance, org_a, org_b) AS near_rank, row_number() OVER (ORDER BY distance DESC, org_a, org_b) AS far_rank FROM (SELECT org_a, org_b, sum(gap * width) AS distance FROM {_GAPS} g GROUP BY org_a, org_b) w) r WHERE near_rank <= 15 OR far_rank <= 15",
    "g11_failures": "SELECT o.organism, coalesce(f.n, 0) AS failed, coalesce(f.short_chains, 0) AS short_chains, coalesce(f.uncertain, 0) AS uncertain, coalesce(d.n, 0) AS done, round(100.0 * coalesce(f.n, 0) / nullif(coalesce(f.n, 0) + coalesce(d.n, 0), 0), 6) AS pct FROM (SELECT organism FROM $P WHERE length < 60 OR plddt_mean < 47 UNION SELECT organism FROM $P WHERE length >= 60 AND plddt_mean >= 47) o LEFT JOIN (SELECT organism, count(*) AS n, count(CASE WHEN length < 60 THEN 1 END) AS short_chains, count(CASE WHEN length >= 60 THEN 1 END) AS uncertain FROM $P WHERE length < 60 OR plddt_mean < 47 GROUP BY organism) f ON f.organism = o.organism LEFT JOIN (SELECT organism, count(*) AS n FROM $P WHERE length >= 60 AND plddt_mean >= 47 GROUP BY organism) d ON d.organism = o.organism",
    "g17_quick_answers": f"SELECT 'organisms' AS item, cast(count(*) AS double) AS answer FROM {_MEANS} a UNION ALL SELECT 'cv_pct', round(100 * stddev_pop(m) / avg(m), 6) FROM {_MEANS} b UNION ALL SELECT 'range_ratio', round(max(m) / min(m), 6) FROM {_MEANS} c UNION ALL SELECT 'grand_mean', round(avg(bps_norm), 6) FROM $P UNION ALL SELECT 'mean_of_means', round(avg(m), 6) FROM {_MEANS} d UNION ALL SELECT 'within_cv_pct', round(100 * avg(s / m), 6) FROM (SELECT organism, avg(bps_norm) AS m, stddev_pop(bps_norm) AS s FROM $P GROUP BY organism) e",
    "g29_completeness": "SELECT r.organism, r.advertised, coalesce(s.ids, 0) AS ids, coalesce(s.done, 0) AS done, coalesce(s.ids - s.done, 0) AS failed, round(100.0 * coalesce(s.done, 0) / r.advertised, 6) AS pct, CASE WHEN coalesce(s.ids, 0) = 0 THEN 'absent' WHEN s.done >= r.advertised THEN 'complete' ELSE 'partial' END AS status FROM (SELECT 'ecoli' AS organism, 30 AS advertised UNION ALL SELECT 'human', 40 UNION ALL SELECT 'yeast', 20 UNION ALL SELECT 'mouse', 10) r LEFT JOIN (SELECT organism, count(*) AS ids, count(CASE WHEN length >= 60 THEN 1 END) AS done FROM $P GROUP BY organism) s ON s.organism = r.organism",
    "g30_organism_summary": "SELECT organism, count(*) AS n, round(avg(bps_norm), 6) AS mean, round(percentile(bps_norm, 0.5), 6) AS median, round(percentile(bps_norm, 0.05), 6) AS p5, round(percentile(bps_norm, 0.95), 6) AS p95, round(100 * stddev_pop(bps_norm) / nullif(avg(bps_norm), 0), 6) AS cv, round(avg(pct_helix), 6) AS helix, round(avg(pct_sheet), 6) AS sheet, min(length) AS shortest, max(length) AS longest FROM $P GROUP BY organism",
    "g31_by_count": "SELECT organism, n, rank() OVER (ORDER BY n DESC) AS place FROM (SELECT organism, count(*) AS n FROM $P GROUP BY organism) q ORDER BY n DESC, organism",
    "t18_leave_one_out": "SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / nullif(sum((y - my) * (y - my)), 0), 6) AS r2_cv FROM (SELECT p.bps_norm AS y, f.my, (p.bps_norm - f.my - f.b * (p.length - f.mx)) / (1 - 1.0 / f.n - (p.length - f.mx) * (p.length - f.mx) / f.sxx) AS e FROM $P p CROSS JOIN (SELECT count(*) AS n, avg(bps_norm) AS my, avg(length) AS mx, var_pop(length) * count(*) AS sxx, covar_pop(length, bps_norm) / var_pop(length) AS b FROM $P) f) q",
}
