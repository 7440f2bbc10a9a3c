"""Mixing sources to target weights by soft membership, DataFrame operations only.

1. A table of labelled documents (doc_id, domain) gives the domains and their shares of
   tokens (prior and default targets), counted over all labelled documents.  Domains beyond the
   ``MAX_DOMAINS`` - 1 largest are one domain, ``*``, with one share and one target;
   domains with a target of the caller stay apart.  Hashed word counts a domain, drawn
   towards the counts of all domains, make a classifier; only these word counts come from at
   most ``MAX_LABELLED`` labelled documents, by hash.
2. Every document's words are looked up in that table (``BUCKETS`` rows); the sums a
   document give its log-likelihoods, which together with the domains' shares give
   its posterior.  Evidence counts as at most ``EVIDENCE`` words, so that long
   texts stay soft.  A document's own label, if it has one, is one more observation: right with probability
   ``TRUST``, else any other domain alike.
3. With rate r of each document, domain d is expected to get S[d] = sum(r * tokens *
   posterior[d]) tokens.  Projected gradient steps from r = 1 fit rates of 0 to ``MAX_RATE`` by least
   squares of S against the target totals.  A document's step length is 1 over the sum of posterior[d] *
   tokens of d at rate 1, a separable majorant of the squares, so hot and small domains converge
   alike; steps carry momentum, given up wherever the squares grow.  A step is one aggregate of all
   documents to a number a domain; only those numbers reach the driver.  The steps' numbers are
   data of one and the same plan, which goes through the last few steps again; then the rates are written and read again.
   Steps end when every domain's share of tokens is within ``TOLERANCE`` of its target, the squares fall
   no more, or after ``STEPS``.  The reached shares are logged, as a warning if a target is missed
   (as with targets that rates of 0 to ``MAX_RATE`` cannot meet); ``report`` returns them.
4. A document is taken floor(rate) times, and once more if a hash of its doc_id falls under
   the rest; no document is taken more than ``MAX_RATE`` times.

Defined results: null or blank texts have 0 tokens, the domains' shares (and their label) as evidence and
their rate by it; a null domain is a domain of its own (``?``) like any other;
rows that share a doc_id are one document of their joint tokens and get one
rate each (null doc_ids likewise, without a label); a doc_id with several labels has the least; missing targets are 0
and all are scaled to sum 1; a target of a domain without tokens, or ``MAX_DOMAINS`` targets
or more, is an error; a domain without a sampled document has the common word counts; without labels
there is one domain, ``*``; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import logging
import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotbook.session import scratch_path

BUCKETS = 1024
MAX_LABELLED = 10_000
MAX_DOMAINS = 64
EVIDENCE = 25
SHRINK = 50_000  # tokens by which a domain's counts are drawn to those of all domains
TRUST = 0.9  # probability that a label is right
MAX_RATE = 8.0
STEPS = 100  # at most
TOLERANCE = 1e-6  # largest miss of a domain's share of tokens
MEMORY = 2  # steps that a plan goes through again before the rates are written
FLATTEN = 0.5  # default targets: shares of tokens to this power
SPACE = r"[ \t-\r]+"
_LOG = logging.getLogger(__name__)


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _exploded(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.explode(F.split(F.lower("text"), SPACE)).alias("word")).filter("word <> ''")


def source_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, domain) with a document's source as its domain."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("?")).alias("domain"))


def domain_tokens(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(domain, n): tokens of all labelled documents a domain; words are counted before the shuffle."""
    n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "")).cast("long")
    rows = docs.select("doc_id", n.alias("n"), F.lit(None).cast("string").alias("domain"))
    rows = rows.unionByName(labels.select("doc_id", F.lit(0).cast("long").alias("n"), F.coalesce("domain", F.lit("?")).alias("domain")))
    return (rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("domain").alias("domain"))
            .filter("n > 0 and domain is not null").groupBy("domain").agg(F.sum("n").alias("n")))


class Classifier:
    """Domains, their shares of labelled tokens, and log P(bucket | domain).  Domains of
    ``targets`` are kept before larger ones."""

    def __init__(self, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None):
        asked = [d for d, t in (targets or {}).items() if t > 0 and d != "*"]
        if len(asked) >= MAX_DOMAINS:
            raise ValueError(f"{len(asked)} targets; at most {MAX_DOMAINS - 1} domains can have one")
        self.labels = labels
        own = domain_tokens(docs, labels).persist(StorageLevel.MEMORY_AND_DISK)
        all_tokens = own.agg(F.sum("n")).first()[0] or 0
        by = (own.filter("domain <> '*'").orderBy(F.desc(F.col("domain").isin(asked)), F.desc("n"), "domain")
              .limit(MAX_DOMAINS - 1).collect())
        own.unpersist()
        by.sort(key=lambda r: (-r.n, r.domain))
        self.domains = [r.domain for r in by]
        sizes = [r.n for r in by]
        if all_tokens > sum(sizes) or not by:
            self.domains.append("*")
            sizes.append(all_tokens - sum(sizes))
        lost = [d for d, t in (targets or {}).items() if t > 0 and d not in self.domains]
        if all_tokens and lost:
            raise ValueError(f"targets of domains without any tokens: {sorted(lost)}")
        self.shares = [n / all_tokens if all_tokens else 1.0 for n in sizes]

        sample = (labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("domain", F.lit("?"))).alias("domain"))
                  .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
        rows = docs.join(F.broadcast(sample), "doc_id").select("domain", "text")  # MAX_LABELLED pairs
        counts = (_exploded(rows, "domain").withColumn("domain", F.when(F.col("domain").isin(self.domains), F.col("domain")).otherwise("*"))
                  .groupBy("domain", _bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n")))
        at = {d: i for i, d in enumerate(self.domains)}
        table = [[0] * len(self.domains) for _ in range(BUCKETS)]
        for d, b, n in counts.collect():  # MAX_DOMAINS * BUCKETS
            table[b][at[d]] = n
        seen = [sum(column) for column in zip(*table)]
        common = [(sum(row) + 1) / (sum(seen) + BUCKETS) for row in table]
        self.table = [tuple(math.log((n + SHRINK * c) / (size + SHRINK)) for n, size in zip(row, seen))
                      for row, c in zip(table, common)]

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, p0, p1, ...) a doc_id."""
        spark, k = docs.sparkSession, len(self.domains)
        weights = spark.createDataFrame([(i, *row) for i, row in enumerate(self.table)],
                                        "bucket int, " + ", ".join(f"w{i} double" for i in range(k)))
        # a word less text still has its row; the token "" has no bucket
        words = docs.select("doc_id", F.explode_outer(F.split(F.lower("text"), SPACE)).alias("word"))
        words = words.select("doc_id", F.when(F.col("word") != "", _bucket(F.col("word"))).alias("bucket"),
                             F.lit(None).cast("int").alias("label"), F.lit(1).alias("own"))
        # a label goes along as its domain's number: sums and numbers fold in a hash table, text would have to be sorted
        at = F.create_map(*[F.lit(x) for i, d in enumerate(self.domains) for x in (d, i)])
        told = (self.labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("domain", F.lit("?"))).alias("domain")))
        labels = told.select("doc_id", F.lit(None).cast("int").alias("bucket"),
                             F.coalesce(at[F.col("domain")], F.lit(k - 1 if self.domains[-1] == "*" else None)).alias("label"), F.lit(0).alias("own"))
        sums = (words.unionByName(labels).join(F.broadcast(weights), "bucket", "left").groupBy("doc_id")  # BUCKETS rows
                .agg(F.count("bucket").alias("n_tokens"), F.max("label").alias("label"), F.max("own").alias("own"),
                     *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(k)]).filter("own = 1"))
        heat = F.least(F.lit(1.0), EVIDENCE / F.greatest("n_tokens", F.lit(1)))
        right, wrong = math.log(TRUST), math.log((1 - TRUST) / max(1, k - 1))
        told = [F.when(F.col("label") == i, right).when(F.col("label").isNotNull(), wrong).otherwise(0.0) for i in range(k)]
        logs = sums.select(
            "doc_id", "n_tokens", *[(F.col(f"s{i}") * heat + math.log(self.shares[i]) + told[i]).alias(f"l{i}") for i in range(k)])
        top = F.greatest(*[F.col(f"l{i}") for i in range(k)]) if k > 1 else F.col("l0")
        logs = logs.withColumn("top", top).select("doc_id", "n_tokens", *[F.exp(F.col(f"l{i}") - F.col("top")).alias(f"e{i}") for i in range(k)])
        whole = _sum([F.col(f"e{i}") for i in range(k)])
        return logs.withColumn("whole", whole).select("doc_id", "n_tokens", *[(F.col(f"e{i}") / F.col("whole")).alias(f"p{i}") for i in range(k)])


def _sum(columns):
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


class Rates:
    """Rates of ``rows`` (n_tokens, p0, p1, ...) fitted to ``targets``, which sum to 1: ``rows`` with column
    ``rate``, the ``reached`` shares of tokens, and the number of ``steps``."""

    def __init__(self, rows: DataFrame, targets: list[float], steps: int = STEPS):
        self.k, self.targets, self.spark = len(targets), targets, rows.sparkSession
        self.rows, self.reached, self.steps = rows.withColumn("rate", F.lit(1.0)), list(targets), 0
        self.total = rows.agg(F.sum("n_tokens")).first()[0] or 0
        if self.total:
            self._fit(steps)
            miss = max(abs(r - t) for r, t in zip(self.reached, targets))
            _LOG.log(logging.INFO if miss < TOLERANCE else logging.WARNING, "source mix: largest miss %.2g after %d steps; targets %s, reached %s",
                     miss, self.steps, [round(t, 6) for t in targets], [round(r, 6) for r in self.reached])

    def _reached(self, rows: DataFrame) -> list[float]:
        tokens = F.col("n_tokens") * F.col("rate")
        return [x / self.total for x in rows.agg(*[F.sum(tokens * F.col(f"p{i}")) for i in range(self.k)]).first()]

    def _after(self, rows: DataFrame, steps: list[list[float]]) -> DataFrame:
        """``rows`` after the steps [1, momentum, gradient...], ``MEMORY`` at most.  The numbers are a scalar
        subquery, so the plan and its compiled code are the same for any numbers and any number of steps."""
        width = self.k + 2
        flat = [0.0] * ((MEMORY - len(steps)) * width) + [x for s in steps for x in s]  # steps of zeros change nothing
        number = self.spark.range(0, 1, 1, 1).selectExpr(f"array({', '.join(f'{x!r}D' for x in flat)}) as step").scalar()
        names = [c for c in rows.columns if c not in ("rate", "rate0")]
        rows = rows.select(*names, "rate0", F.col("rate").alias("rate1"), number.alias("step"))
        for j in range(MEMORY):
            slope = " + ".join(f"p{i} * step[{j * width + 2 + i}]" for i in range(self.k))
            ahead = f"rate1 + (rate1 - rate0) * step[{j * width + 1}] - ({slope}) / curve"
            rows = rows.selectExpr(*names, "step", f"rate0 + (rate1 - rate0) * step[{j * width}] as rate0",
                                   f"least({MAX_RATE!r}D, greatest(0D, {ahead})) as rate1")
        return rows.select(*names, "rate0", F.col("rate1").alias("rate"))

    def _fit(self, most: int) -> None:
        share = self._reached(self.rows)  # at rate 1
        rows = self.rows.withColumn("rate0", F.col("rate")).withColumn(
            "curve", F.greatest(F.lit(1e-12), _sum([F.col(f"p{i}") * share[i] for i in range(self.k)])))
        done, age, before, now = [], 1.0, share, share
        height = sum((r - t) ** 2 for r, t in zip(now, self.targets))
        idle = 0
        while self.steps < most and max(abs(r - t) for r, t in zip(now, self.targets)) >= TOLERANCE and idle < 8:
            if len(done) == MEMORY:
                at = scratch_path(self.spark, "rates")
                self._after(rows, done).write.parquet(at)
                rows, done = self.spark.read.parquet(at), []
            older = (1 + math.sqrt(1 + 4 * age * age)) / 2
            push = (age - 1) / older
            slope = [r + push * (r - b) - t for r, b, t in zip(now, before, self.targets)]
            done.append([1.0, push, *slope])
            before, now = now, self._reached(self._after(rows, done))
            self.steps += 1
            found = sum((r - t) ** 2 for r, t in zip(now, self.targets))
            idle = idle + 1 if found > height * (1 - 1e-4) else 0
            age = older if found <= height else 1.0
            height = min(height, found)
        self.rows, self.reached = self._after(rows, done).drop("curve", "rate0"), now


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS) -> DataFrame:
    """``rows`` (n_tokens, p0, ...) with column ``rate``; targets sum to 1."""
    return Rates(rows, targets, steps).rows


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None):
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    model = Classifier(texts, labels, targets)
    if targets is None:
        wanted = [s**FLATTEN for s in model.shares]
    else:
        wanted = [max(0.0, targets.get(d, 0.0)) for d in model.domains]
    scale = sum(wanted) or 1.0
    at = scratch_path(docs.sparkSession, "posteriors")
    model.posteriors(texts).write.parquet(at)
    return model, Rates(docs.sparkSession.read.parquet(at), [w / scale for w in wanted])


def report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(domain, share, target, reached): each domain's share of tokens as it is, as wanted, and as the mix expects it."""
    model, rates = _fitted(docs, labels, targets)
    return docs.sparkSession.createDataFrame(list(zip(model.domains, model.shares, rates.targets, rates.reached)),
                                             "domain string, share double, target double, reached double")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """One row a doc_id: doc_id, n_tokens, domain (likeliest), posterior (its
    probability), rate, copies."""
    model, fitted = _fitted(docs, labels, targets)
    rates, k = fitted.rows, len(model.domains)
    likeliest = F.greatest(*[F.col(f"p{i}") for i in range(k)]) if k > 1 else F.col("p0")
    name = F.coalesce(*[F.when(F.col(f"p{i}") == F.col("posterior"), F.lit(d)) for i, d in enumerate(model.domains)])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return (rates.withColumn("posterior", likeliest)
            .select("doc_id", "n_tokens", name.alias("domain"), "posterior", "rate",
                    (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies")))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``mix_rate`` and ``mix_copies``
    (how often each is taken, 1 or more)."""
    rates = mix(docs, labels, targets).select(F.col("doc_id").alias("mix_id"), F.col("rate").alias("mix_rate"),
                                              F.col("copies").alias("mix_copies")).filter("mix_copies > 0")
    own = docs.select(*[c for c in docs.columns if c not in ("mix_id", "mix_rate", "mix_copies")])
    return own.join(rates, F.col("doc_id").cast("long").eqNullSafe(F.col("mix_id"))).drop("mix_id")
