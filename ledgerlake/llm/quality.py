"""Quality rules with risk-controlled thresholds.

Each rule rejects a document when one feature of its text exceeds a cutoff of its stratum (its language). Cutoffs come
from labelled documents: one half of them (by a hash of the id) ranks the candidates, the other half, the holdout,
certifies them. A cutoff is certified when the exact binomial test rejects "it turns away more than alpha / rules of
the good documents" - the same as the Clopper-Pearson upper bound being at most that. Along the grid the tests run from
the mildest cutoff to stricter ones and stop at the first failure (fixed sequence, so the grid needs no correction);
over strata and rules the error probability is split evenly (Bonferroni). With probability 1 - delta no stratum thus
loses more than alpha of its good documents to the rules together. Without enough labels nothing is certified and the
rules reject nothing.

Defined cases: a null text has no words; null or repeated ids are kept as they are; null strata count as "und"; labels
with null ids, or a quality other than 0 and 1, don't count; of repeated labels of an id the lowest quality counts, and of
rows that share a labelled id one; without a column lang all documents are one stratum; extra columns pass through filter_documents() untouched.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, columns, over_chunks, raw_texts, tidy
from .textvec import shingles, text_bytes, words

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: Feature of each rule: a numerator, a denominator, and a grid of cutoffs from mild to strict (fixed values).
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)),
    "repeated_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeated_words": ("n_repeat_words", "n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "capitals": ("n_upper", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "marks": ("n_marks", "n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "long_words": ("word_chars", "n_words", (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0)),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Risk:
    """alpha: share of good documents that a stratum may lose to the rules; delta: chance that this fails anywhere.
    penalty: bad documents that one good one outweighs when cutoffs are ranked."""

    alpha: float = 0.05
    delta: float = 0.05
    penalty: float = 10.0


def text_counts(text: pa.StringArray) -> dict[str, np.ndarray]:
    """COUNTS of each text: integers."""
    w = words(text)
    data, ends = text_bytes(text)
    n = len(ends)

    def summed(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return np.diff(total[np.r_[0, ends]])

    from .textvec import SPACE

    out = {
        "n_words": w.counts.astype(np.int64),
        "word_chars": summed(((data & 0xC0) != 0x80) & ~SPACE[data]),
        "n_symbols": summed(_SYMBOL[data]),
        "n_upper": summed((data >= 65) & (data <= 90)),
        "n_marks": summed((data == 33) | (data == 63)),
    }
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(raw_texts(text)):
        seen: set[bytes] = set()
        for line in t.split(b"\n"):
            if line.strip():
                lines[i] += 1
                if line in seen:
                    dup[i] += 1
                else:
                    seen.add(line)
    every, repeat = shingles(w.hashes, 3), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
        if b - a >= 4:
            s = every[a : b - 2]
            order = np.argsort(s, kind="stable")
            same = s[order][1:] == s[order][:-1]
            if same.any():
                covered = np.zeros(b - a, bool)
                hit = order[np.r_[same, False] | np.r_[False, same]]
                for j in range(3):
                    covered[hit + j] = True
                repeat[i] = covered.sum()
    return out | {"n_dup_lines": dup, "n_lines": lines, "n_repeat_words": repeat}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def rule_values(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {r: c[a] / np.maximum(c[b], 1) for r, (a, b, _) in RULES.items()}


def _stratum(docs: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("und")) if name in docs.columns else F.lit("und")


def features(docs: DataFrame, text: str = "text", stratum: str = "lang", ids: str = "doc_id") -> DataFrame:
    """doc_id, stratum and the COUNTS of each text, from one scan."""

    def count(part: pa.RecordBatch, t: pa.StringArray) -> pa.RecordBatch:
        c = text_counts(t)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c[k]) for k in COUNTS)], names=["doc_id", "stratum", *COUNTS])

    shape = "doc_id long, stratum string, " + ", ".join(f"{k} long" for k in COUNTS)
    picked = docs.select(F.col(ids).cast("long").alias("doc_id"), _stratum(docs, stratum).alias("stratum"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(over_chunks(count), shape)


def log_binom_cdf(x: int, n: int, p: float) -> float:
    """log P(Bin(n, p) <= x), exact but for rounding."""
    if x >= n or p <= 0:
        return 0.0
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(x + 1)]
    top = max(terms)
    return min(0.0, top + math.log(sum(math.exp(t - top) for t in terms)))


def upper_bound(x: int, n: int, error: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a share, from x of n, that fails with probability `error` at most."""
    if x >= n:
        return 1.0
    low, high = x / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if log_binom_cdf(x, n, mid) > math.log(error) else (low, mid)
    return high


def select_cutoffs(counts: list[tuple[str, str, int, int, int, int]], risk: Risk = Risk(), n_strata: int | None = None) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule from (stratum, rule, half, quality, number of cutoffs exceeded, documents).

    half 0 ranks, half 1 is the holdout. n_strata: how many share delta, if counts has some of them only."""
    seen: dict[tuple, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    strata = set()
    for stratum, rule, half, good, level, n in counts:
        seen[stratum, rule, half, good][level] += n
        strata.add(stratum)
    error = risk.delta / max(1, (n_strata or len(strata)) * len(RULES))
    share = risk.alpha / len(RULES)
    out: dict[str, dict[str, float]] = {}
    for stratum in sorted(strata):
        for rule, (_, _, grid) in RULES.items():
            # a value that exceeds `level` cutoffs exceeds the strictest ones, which stand last
            over = lambda half, good, k: sum(n for level, n in seen[stratum, rule, half, good].items() if level + k >= len(grid))  # noqa: B023, E731
            held = sum(seen[stratum, rule, 1, 1].values())
            best = (0.0, None)
            for k, cutoff in enumerate(grid):
                if not held or log_binom_cdf(over(1, 1, k), held, share) > math.log(error):
                    break
                worth = over(0, 0, k) - risk.penalty * over(0, 1, k)
                if worth > best[0]:
                    best = (worth, cutoff)
            if best[1] is not None:
                out.setdefault(stratum, {})[rule] = best[1]
    return out


def fit(found: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[str, dict[str, float]]:
    """Certified cutoffs; found: features() of documents. Each labelled stratum is certified by itself, in a task, from its
    histogram (rules x grid); what comes to the driver are the cutoffs of strata with labels enough for one."""
    clean = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))
    passed = found.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words")) & F.col("doc_id").isNotNull())
    # one trial an id: rows that share it aren't independent
    one = passed.groupBy("doc_id").agg(F.min(F.struct("stratum", *COUNTS)).alias("row")).select("doc_id", "row.*")
    known = one.join(clean, "doc_id")

    def exceeded(a: str, b: str, grid: tuple[float, ...]):
        value = F.col(a) / F.greatest(F.col(b), F.lit(1))
        return F.array_size(F.filter(F.array(*map(F.lit, grid)), lambda cutoff: value > cutoff))

    levels = F.array(*(exceeded(*rule) for rule in RULES.values())).alias("levels")
    half = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(2)).cast("int").alias("half")
    rows = known.select("stratum", "good", half, levels).select("stratum", "good", "half", F.posexplode("levels").alias("rule", "level"))
    counts = rows.groupBy("stratum", "good", "half", "rule", "level").count()
    n_strata = known.select("stratum").distinct().count()
    names = list(RULES)

    def certify(own: pa.Table) -> pa.Table:
        r = own.to_pydict()
        told = select_cutoffs([(s, names[i], h, g, level, n) for s, i, h, g, level, n in zip(r["stratum"], r["rule"], r["half"], r["good"], r["level"], r["count"])], risk, n_strata)
        rows = [(s, rule, cutoff) for s, by_rule in told.items() for rule, cutoff in by_rule.items()]
        return pa.table([pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64()))], names=["stratum", "name", "cutoff"])

    out: dict[str, dict[str, float]] = {}
    for x in counts.groupBy("stratum").applyInArrow(certify, "stratum string, name string, cutoff double").collect():
        out.setdefault(x.stratum, {})[x.name] = x.cutoff
    return out


def passes(c: dict[str, np.ndarray], strata: list[str], cutoffs: dict[str, dict[str, float]]) -> np.ndarray:
    """Where no certified rule of the stratum rejects; a stratum without one loses nothing."""
    good = np.ones(len(strata), bool)
    values = rule_values(c)
    at = np.array(strata, dtype=object)
    for stratum in set(strata):
        here = at == stratum
        for rule, cutoff in cutoffs.get(stratum, {}).items():
            good &= ~(here & (values[rule] > cutoff))
    return good


def judge(found: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """features() with base_failed and kept."""
    shape = found.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", base_failed boolean, kept boolean"

    @tidy
    def run(batches):
        for b in batches:
            c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in COUNTS}
            failed = base_failed(c)
            kept = ~failed & passes(c, b.column("stratum").to_pylist(), cutoffs)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(kept)], names=[*b.schema.names, "base_failed", "kept"])

    return found.mapInArrow(run, shape)


def assess(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per document: its counts, base_failed and kept. The texts are read once."""
    scratch = Scratch(docs.sparkSession, "quality")
    found = scratch.save(features(docs), "features")
    return judge(found, fit(found, labels, risk))


def filter_documents(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The documents that pass, all their columns unchanged. Texts are read twice and never shuffled."""
    scratch = Scratch(docs.sparkSession, "quality")
    found = scratch.save(features(docs), "features")
    cutoffs = fit(found, labels, risk)
    scratch.drop(found)
    # on the way the columns have names of their own, and the stratum is the last of them
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    widened = docs.select(*(c.alias(n) for c, n in zip(columns(docs), names)), _stratum(docs, "lang").alias("stratum"))

    def keep(part: pa.RecordBatch, t: pa.StringArray) -> pa.RecordBatch:
        c = text_counts(t)
        strata = part.column(part.num_columns - 1).to_pylist()
        part = pa.RecordBatch.from_arrays(part.columns[:-1], schema=pa.schema(list(part.schema)[:-1]))
        return part.filter(pa.array(~base_failed(c) & passes(c, strata, cutoffs)))

    return widened.mapInArrow(over_chunks(keep), widened.drop("stratum").schema).toDF(*docs.columns)
