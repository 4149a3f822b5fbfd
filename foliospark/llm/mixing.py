"""Mixing sources to target weights: domain posteriors from labelled rows, and document rates fitted by projected
gradient so that the expected tokens of each domain match their targets. DataFrame expressions alone."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, table

#: Share of tokens that each domain (a quality label) should have.
TARGETS = {"quality=1": 0.92, "quality=0": 0.08}
#: Steps of the fit at most, where it ends (largest gap to a target, of that target), and how sharp posteriors are. It also
#: ends after STALLED steps that bring it no nearer: targets that no rates meet, such as a domain's without documents.
ROUNDS, CLOSE, SHARPNESS, STALLED = 200, 0.002, 0.35, 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "#$%&*|!+=<>_{}[]@^~"


def features() -> dict[str, Column]:
    """What the classifier sees of column text (null as empty): sizes and shares, all from the text alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(text)
    share = lambda chars: 1 - F.length(F.translate(text, chars, "")) / F.greatest(n, F.lit(1))
    words = F.col("_words")
    return {
        "size": F.log1p(n),
        "marks": F.sqrt(F.when(n > 0, share(_MARKS)).otherwise(0.0)),
        "upper": F.sqrt(F.when(n > 0, share(_UPPER)).otherwise(0.0)),
        "wide": F.sqrt((F.octet_length(text) - n) / F.greatest(n, F.lit(1))),
        "distinct": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "word_length": F.log1p(n / F.greatest(F.size(words), F.lit(1))),
    }


def _seen(docs: DataFrame) -> DataFrame:
    """docs with n_tokens (words that white space parts), the classifier's features as _f, and a number from 0 to 1 by a hash
    of the row as _chance."""
    words = F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"), "")
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text"), 11) / F.lit(2.0**53)).cast("double")
    return docs.withColumn("_words", words).withColumn("_f", F.array(*features().values())).withColumn("n_tokens", F.size("_words").cast("bigint")).withColumn("_chance", chance).drop("_words")


def fit_domains(seen: DataFrame, labels: DataFrame) -> dict[str, list]:
    """Of each domain, its share of the labelled rows, and mean and variance of each feature there, from rows with doc_id and
    _f. One row a domain reaches the driver. Labelled rows without a document, or with null labels, don't count. Repeated
    labels count once."""
    m = len(features())
    names = labels.where("doc_id is not null and quality is not null").select("doc_id", F.concat(F.lit("quality="), "quality").alias("domain")).distinct()
    rows = seen.where("doc_id is not null").select("doc_id", "_f").join(names, "doc_id")
    found = rows.groupBy("domain").agg(F.count("*").alias("n"), *(F.avg(F.col("_f")[i]).alias(f"m{i}") for i in range(m)), *(F.var_pop(F.col("_f")[i]).alias(f"v{i}") for i in range(m))).orderBy("domain").collect()
    total = sum(r["n"] for r in found)
    return {r["domain"]: [r["n"] / total, [r[f"m{i}"] for i in range(m)], [r[f"v{i}"] + 1e-3 for i in range(m)]] for r in found}


def posteriors(domains: dict[str, list], sharpness: float = SHARPNESS) -> Column:
    """Chance of each domain in the order of domains, of a row with _f; one domain of chance 1 if there are none."""
    if not domains:
        return F.array(F.lit(1.0))
    scores = []
    for prior, mean, var in domains.values():
        s = F.lit(math.log(prior) - sharpness * 0.5 * sum(math.log(v) for v in var))
        for i, (mu, v) in enumerate(zip(mean, var, strict=True)):
            s = s - (F.col("_f")[i] - mu) * (F.col("_f")[i] - mu) * (sharpness * 0.5 / v)
        scores.append(s)
    exps = lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    norm = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
    return F.transform(F.transform(F.array(F.array(*scores)), exps), norm)[0]


def _rate(history: list[list[float]], start: float, p: Column) -> Column:
    """The document's rate after the steps in history: each takes off the step's gap in the document's domains, down to 0."""
    if not history:
        return F.lit(start)
    k = len(history[0])
    steps = F.array(*(F.array(*map(F.lit, g)) for g in history))

    def step(r: Column, g: Column) -> Column:
        dot = p[0] * g[0]
        for i in range(1, k):
            dot = dot + p[i] * g[i]
        return F.greatest(F.lit(0.0), r - dot)

    return F.aggregate(steps, F.lit(start), step)


@dataclass
class Plan:
    """A fit: a few numbers a domain. history holds the steps that lead from budget to each document's rate; gap is the
    largest distance left to a target, as a share of it."""

    domains: dict[str, list]
    budget: float
    history: list[list[float]]
    gap: float = 0.0

    def put(self, seen: DataFrame) -> DataFrame:
        """seen, rows of _seen, with domain (the likeliest), posteriors, rate and copies. A narrow pass."""
        names, p = F.array(*map(F.lit, self.domains or ["all"])), F.col("posteriors")
        out = seen.withColumn("posteriors", posteriors(self.domains)).withColumn("domain", F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")))
        out = out.withColumn("rate", _rate(self.history, self.budget, p))
        return out.withColumn("copies", F.floor(F.col("rate") + F.col("_chance")).cast("bigint")).drop("_f", "_chance")


def fit(seen: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, rounds: int = ROUNDS) -> Plan:
    """Rates for the rows of seen, a written table of what _seen makes: each step of the fit is one aggregation of a few
    numbers over a table without texts."""
    targets = TARGETS if targets is None else targets
    domains = {d: x for d, x in fit_domains(seen, labels).items() if targets.get(d, 0) > 0}
    k = max(1, len(domains))
    weight = [targets[d] for d in domains] or [1.0]
    written = Written(seen.sparkSession)
    small = written.put(seen.select("n_tokens", posteriors(domains).alias("posteriors")))
    p = F.col("posteriors")
    tokens = F.col("n_tokens").cast("double")
    whole = [x or 0.0 for x in small.agg(*(F.sum(tokens * p[i]).alias(f"a{i}") for i in range(k))).first()]
    if budget is None:
        budget = min((a / (w / sum(weight)) for a, w in zip(whole, weight, strict=True)), default=1.0) / (sum(whole) or 1.0) if domains else 1.0
    wanted = [budget * sum(whole) * w / sum(weight) for w in weight]
    history: list[list[float]] = []
    best, since, gap = math.inf, 0, math.inf
    while True:
        rate = _rate(history, budget, p)
        now = [x or 0.0 for x in small.withColumn("r", rate).agg(*(F.sum(F.col("r") * tokens * p[i]).alias(f"a{i}") for i in range(k))).first()]
        gap = max(abs(x - t) / max(t, 1e-9) for x, t in zip(now, wanted, strict=True)) if sum(whole) else 0.0
        best, since = (gap, 0) if gap < best * 0.999 else (best, since + 1)
        if gap <= CLOSE or len(history) >= rounds or since >= STALLED:
            break
        history.append([(x - t) / max(a, 1e-9) for x, t, a in zip(now, wanted, whole, strict=True)])
    if gap > CLOSE:
        logging.getLogger(__name__).warning("targets are missed by up to %.1f %% after %d steps", 100 * gap, len(history))
    written.drop(small)
    return Plan(domains, budget, history, gap)


def _slim(docs: DataFrame, written: Written | None = None) -> DataFrame:
    """What fit needs of docs, written: texts are read once for it."""
    return (written or Written(docs.sparkSession)).put(_seen(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "_f", "_chance"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """docs with n_tokens, domain (the likeliest), posteriors, rate, and copies: how often the row is taken.

    Of domains that are equally likely the first by name counts. Null texts count as empty; empty ones have no tokens; texts
    of any length are read whole; repeated rows are taken alike; an empty table gives no rows. A fit that ends without
    meeting its targets logs a warning, and Plan.gap tells how far it is. Rates are never negative; where the targets can be met, sum(rate * n_tokens * posterior) meets them for each domain
    within CLOSE. copies is rate rounded up or down by a hash of the row, so its mean is the rate. Domains without
    labelled rows leave their share to the others; without labelled rows at all, each rate is budget. Texts are never
    shuffled. budget is the share of all tokens to take; None takes the most for which no domain as a whole must repeat.
    """
    written = Written(docs.sparkSession)
    plan = fit(_slim(docs, written), labels, targets, budget, rounds)
    written.keep()
    return plan.put(_seen(docs))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """The rows that mix takes, as often as it takes them, with the columns of docs."""
    own = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    return mix(own, labels, targets, budget).withColumn("_i", F.explode(F.expr("array_repeat(1, cast(copies as int))"))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: rates and copies of all documents."""
    seen = _slim(table(spark, sf_dir, "documents"))
    return fit(seen, table(spark, sf_dir, "labels")).put(seen).select("doc_id", "n_tokens", "domain", "posteriors", "rate", "copies")
