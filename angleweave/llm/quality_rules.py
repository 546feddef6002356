"""Quality rules with risk-controlled thresholds.

Every document gets a few shares (symbols, repeated words, repeated lines, capitals,
long words ...). A rule rejects a document whose share is above a cutoff. The rules are
certified together: a sequence of joint rule sets, each tightening one rule by one
cutoff, is tested per stratum (language) on its good labelled documents from the loosest
set on, each by an exact binomial test of "this set rejects the risk or more of the good
documents", until the first set that is not certified (fixed-sequence testing, which needs
no correction within a stratum). CONFIDENCE is divided by the strata tested, the only
correction. The order of the sequence comes from the documents labelled bad, which
the tests do not use: what rejects most of them a step comes first.

The risk is RISK for every stratum. A stratum whose labels are too few to certify it without a
rejection (298 for the defaults) has no rules of the method, and is not counted in the correction. Every document carries its stratum's
cutoffs and the exact upper bound of their false rejection, null where there are none.

Defined cases: null text has no words and fails the base rules; a null language is a
stratum of its own; a stratum without labels certifies nothing; repeated rows are
judged alike; labels that repeat an id count once; very long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, utf8

#: Fixed by contract.
SYMBOL_CHARS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20

RISK = 0.01
CONFIDENCE = 0.05
#: Shares and their cutoffs from the loosest to the strictest.
CUTOFFS = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01),
    "repeat_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "line_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "capital_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "top_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2),
    "exclaim_share": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
}
WHITE = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))


def measures(text: bytes) -> tuple[int, int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, capitals, most frequent word's count, exclamations."""
    words = text.split()
    n = len(words)
    solid = text.translate(None, WHITE)
    chars = len(solid.decode())
    symbols = len(solid) - len(solid.translate(None, SYMBOL_CHARS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len({*lines})
    repeated = 0
    if n >= WINDOW:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len({*windows}) < len(windows):
            times = Counter(windows)
            end = 0
            for k, w in enumerate(windows):
                if times[w] > 1:
                    repeated += k + WINDOW - max(k, end)
                    end = k + WINDOW
    capitals = len(solid) - len(solid.translate(None, CAPITALS))
    top = max(Counter(words).values()) if words else 0
    return n, chars, symbols, dup_lines, repeated, len(lines), capitals, top, solid.count(b"!")


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "capitals", "top_words", "exclaims")


def _measured(batches):
    import pyarrow as pa

    for batch in batches:
        found = [measures(x) for x in utf8(batch.column(2))]
        columns = zip(*found) if found else [()] * len(NAMES)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "stratum", *NAMES])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string"))
    return rows.mapInArrow(_measured, "doc_id bigint, stratum string, " + ", ".join(f"{n} bigint" for n in NAMES))


def shares() -> dict:
    of = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": of("n_symbols", "word_chars"),
        "repeat_share": of("n_repeat_words", "n_words"),
        "line_share": of("n_dup_lines", "n_lines"),
        "capital_share": of("capitals", "word_chars"),
        "top_share": of("top_words", "n_words"),
        "exclaim_share": of("exclaims", "word_chars"),
    }


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, by a sum of exact terms in logarithms."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a probability after k of n."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid > 0 and binomial_cdf(k, n, mid) > level else (lo, mid) if mid > 0 else (lo, hi)
    return hi


def certified(rejected: list[int], n: int, risk: float, level: float) -> int | None:
    """Of counts of rejected good documents from the loosest set on: the place of the strictest certified one."""
    last = None
    for place, k in enumerate(rejected):
        # Binomial cdf at the risk at most the level: the exact upper bound is not above the risk.
        if n == 0 or k > risk * n or binomial_cdf(k, n, risk) > level:
            break
        last = place
    return last


def sequence(caught: dict[str, list[int]]) -> list[tuple[str, int]]:
    """(rule, place) of every cutoff, a rule's from loose to strict: the run of steps that newly rejects most bad documents a step comes next."""
    at, out = {r: 0 for r in caught}, []
    while open_ := [r for r in caught if at[r] < len(caught[r])]:
        before = {r: caught[r][at[r] - 1] if at[r] else 0 for r in open_}
        runs = [((caught[r][k] - before[r]) / (k + 1 - at[r]), -(k + 1) / len(caught[r]), r, k) for r in open_ for k in range(at[r], len(caught[r]))]
        _, _, r, k = max(runs)
        out += [(r, j) for j in range(at[r], k + 1)]
        at[r] = k + 1
    return out


def choose(rows: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> list[tuple[str, dict[str, float], int, int, float]]:
    """(stratum, cutoffs by rule, rejected, n, upper bound of the false rejection) of the certified joint sets. Two aggregations over the labelled rows."""
    label = labels.filter("quality is not null and toxic = 0 and doc_id is not null").groupBy(F.col("doc_id").alias("__aw_id")).agg(F.max("quality").alias("best"))
    held = stored(rows.filter(~base_failed()).join(label, F.col("doc_id") == F.col("__aw_id")), "rules-labelled")
    values = shares()
    counts = [F.count_if(values[r] > c).alias(f"{r}_{k}") for r, cs in CUTOFFS.items() for k, c in enumerate(cs)]
    bad = held.filter("best = 0").agg(*counts).first()
    order = sequence({r: [bad[f"{r}_{k}"] for k in range(len(cs))] for r, cs in CUTOFFS.items()})
    # The first set of the sequence that rejects a row; a least over all steps, as sets only get stricter.
    first = F.coalesce(*[F.when(values[r] > CUTOFFS[r][k], F.lit(i)) for i, (r, k) in enumerate(order)], F.lit(len(order)))
    good = held.filter("best = 1").select("stratum", first.alias("first")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("first") <= i).alias(f"s{i}") for i in range(len(order))])
    # At most n / least strata come back.
    strata = good.filter(F.col("n") >= math.log(confidence) / math.log1p(-risk)).collect()
    level = confidence / max(1, len(strata))
    out = []
    for s in strata:
        place = certified([s[f"s{i}"] for i in range(len(order))], s["n"], risk, level)
        if place is not None:
            k = s[f"s{place}"]
            out.append((s["stratum"], {r: CUTOFFS[r][j] for r, j in order[: place + 1]}, k, s["n"], upper_bound(k, s["n"], level)))
    return out


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, failed_rules, kept, cutoffs and risk_bound of its stratum."""
    rows = stored(measured(docs), "rules-measures")
    chosen = choose(rows, labels, risk, confidence)
    values = shares()
    rejects = {}
    named, bound = F.lit(None).cast("string"), F.lit(None).cast("double")
    for stratum, cutoffs, _, _, risk_bound in chosen:
        mine = F.col("stratum") == stratum
        named = F.when(mine, F.lit(",".join(f"{r}>{c}" for r, c in sorted(cutoffs.items())))).otherwise(named)
        bound = F.when(mine, F.lit(risk_bound)).otherwise(bound)
        for rule, cutoff in cutoffs.items():
            hit = (F.col("stratum") == stratum) & (values[rule] > F.lit(cutoff))
            rejects[rule] = rejects[rule] | hit if rule in rejects else hit
    names = F.filter(F.array(*[F.when(hit, F.lit(rule)) for rule, hit in sorted(rejects.items())]).cast("array<string>"), lambda x: x.isNotNull())
    rows = rows.withColumn("base_failed", base_failed()).withColumn("failed_rules", names)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).withColumn("cutoffs", named).withColumn("risk_bound", bound)
