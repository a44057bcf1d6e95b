"""Mixing documents to target weights by soft membership, with DataFrame functions alone.

A classifier, trained on a bounded sample of a labelled table, gives every document a probability for
each domain: naive Bayes weights, moved towards 0 by what chance may explain, are summed to the evidence for each
domain, and the shares of the domains among labelled texts of like evidence are the probabilities. Documents then get nonnegative rates r, so that the expected tokens of the domains,
S_k = sum of r * p_k * tokens, come to their targets T_k: least squares by projected gradient steps. Rates are measured in the metric
in which a document weighs its tokens, so a step is r <- max(0, r - p . g), g = G^-1 (S - T), G = sum of tokens * p p' over documents with a
rate above 0 (domains by domains); G^-1 measures the error in coordinates in which one step is the right length. What a document is, and not
how long it is, decides its rate: equal probabilities get equal rates. Steps begin at r = 1, so
a mix that fits already is left alone. A step needs one sum over a narrow table; only domain totals reach the driver,
and a document's rate is an expression of the steps so far, so there is no state to lose.

Features of the classifier are a text's distinct words and its length, repetition and symbol classes, hashed to
``FEATURES`` places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import work_folder

SAMPLE = 16_000  # labelled rows the classifier is trained on, about, at most
FEATURES = 1 << 18
PRIOR = 5  # texts' worth of the overall share in a domain's share of a feature
MARGIN = 2.0  # standard errors that a weight is moved towards 0
TEMPER = 8  # features that may add up as they are
BIN, BINS = 1.0, 8  # width of a class of evidence, and classes to either side of 0
BACKING = 4  # texts' worth of naive Bayes in the shares of a class
STEPS = 25
TOLERANCE = 1e-3  # of the targets' sum
WHITE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WHITE_RUN, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _features(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``, which goes) by feature, as ``place`` from 1 to FEATURES; place 0 stands for the row itself.

    Adds ``n_tokens``.
    """
    plain = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("words", words(F.col("text"))).withColumns(
        {
            "n_tokens": F.size("words").cast("bigint"),
            "symbols": F.length(plain) - F.length(F.translate(plain, "#*$%&|<>", "")),
            "distinct": F.array_distinct("words"),
        }
    )
    count = F.col("n_tokens") + 1
    classes = F.array(
        F.lit(None).cast("string"),
        F.concat(F.lit("# length "), F.floor(F.log2(count)).cast("string")),
        F.concat(F.lit("# distinct "), F.floor(10 * F.size("distinct") / count).cast("string")),
        F.concat(F.lit("# symbols "), F.floor(10 * F.least(F.col("symbols") / count, F.lit(2.0))).cast("string")),
    )
    rest = [name for name in rows.columns if name not in ("text", "words", "symbols", "distinct")]
    each = rows.select(*rest, F.explode(F.concat(classes, "distinct")).alias("feature"))
    place = F.when(F.col("feature").isNotNull(), F.pmod(F.xxhash64("feature"), F.lit(FEATURES)) + 1).otherwise(F.lit(0))
    return each.select(*rest, place.cast("int").alias("place"))


@dataclass
class Classifier:
    """``weights``: (place, w0, w1, ...), places that say something, and place 0; ``classes``: (class, n, n0, n1, ...), labelled
    texts by class of evidence and domain. Columns are in the order of ``domains``."""

    domains: list[str]
    shares: list[float]
    weights: DataFrame
    classes: DataFrame


def _evidence(features: DataFrame, keys: list[str], classifier: Classifier) -> DataFrame:
    """``keys``, ``times`` (rows with these keys), the evidence s0, s1, ... for each domain, and its class.

    Weights are at most FEATURES + 1 rows, so they are broadcast; a document's features are summed before the shuffle.
    """
    n = len(classifier.domains)
    joined = features.join(F.broadcast(classifier.weights), "place")
    sums = joined.groupBy(*keys).agg(F.count_if(F.col("place") == 0).alias("times"), F.count_if(F.col("place") > 0).alias("hits"), *(F.sum(f"w{k}").alias(f"s{k}") for k in range(n)))
    # Repeated rows were summed together. What chance adds to a sum grows as the root of the number of features in it.
    tempered = F.col("times") * F.sqrt(1 + F.col("hits") / F.col("times") / TEMPER)
    sums = sums.withColumns({f"s{k}": F.col(f"s{k}") / tempered for k in range(n)}).drop("hits")
    bins = [F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col(f"s{k}") / BIN))).cast("int").cast("string") for k in range(n)]
    return sums.withColumn("class", F.concat_ws(" ", *bins) if n else F.lit(""))


def train(docs: DataFrame, labelled: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Classifier:
    """From ``labelled`` (id, domain). Rows with a NULL are left out; an id counts once, with its least domain.

    Of more than ``sample`` ids about so many are used, chosen by a hash of the id; only they are broadcast to
    the scan of the texts. Without any labelled text there is no domain.
    """
    spark = docs.sparkSession
    rows = labelled.toDF("id", "domain").dropna().groupBy("id").agg(F.min("domain").alias("domain"))
    share = min(1.0, sample / max(1, rows.count()))
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    known = texts.join(F.broadcast(chosen), "id").select(F.xxhash64("id", "text").alias("row"), "domain", "text")
    _features(known).select("row", "domain", "place").write.parquet(f"{folder}/known")
    known = spark.read.parquet(f"{folder}/known")
    # Weights come from one half of the texts, the shares of the domains by evidence from the other.
    half = F.pmod(F.xxhash64("row", F.lit(29)), F.lit(2))
    counts = known.filter(half == 0).groupBy("domain", "place").count()
    sizes = {row["domain"]: row["count"] for row in known.filter("place = 0").groupBy("domain").count().collect()}
    domains, total = sorted(sizes), sum(sizes.values())
    firsts = {row["domain"]: row["count"] for row in counts.filter("place = 0").collect()}
    half_total = sum(firsts.values())

    def by_domain(column: str):
        return [F.coalesce(F.sum(F.when(F.col("domain") == d, F.col(column))), F.lit(0)).alias(f"n{k}") for k, d in enumerate(domains)]

    places = counts.groupBy("place").agg(F.sum("count").alias("n"), *by_domain("count"))
    overall = (F.col("n") + 0.01) / (half_total + 0.02)
    weights = []
    for k, d in enumerate(domains):
        odds = F.log((F.col(f"n{k}") + PRIOR * overall) / (firsts.get(d, 0) + PRIOR)) - F.log(overall)
        error = MARGIN / F.sqrt(F.col(f"n{k}") + PRIOR * overall)
        sure = F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - error)
        weights.append(F.when(F.col("place") == 0, 0.0).otherwise(sure).alias(f"w{k}"))
    telling = F.col("place") == 0
    for k in range(len(domains)):
        telling = telling | (F.col(f"w{k}") != 0)
    none = spark.range(1).select(F.lit(0).alias("place"), *(F.lit(0.0).alias(f"w{k}") for k in range(len(domains))))
    places.select("place", *weights).filter(telling & (F.col("place") > 0)).union(none).write.parquet(f"{folder}/weights")
    found = Classifier(domains, [sizes[d] / total for d in domains], spark.read.parquet(f"{folder}/weights"), None)
    seen = _evidence(known.filter(half == 1), ["row", "domain"], found).groupBy("class").agg(F.sum("times").alias("n"), *by_domain("times"))
    seen.write.parquet(f"{folder}/classes")
    found.classes = spark.read.parquet(f"{folder}/classes")
    return found


def members(docs: DataFrame, classifier: Classifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row of ``docs`` as (id, row, n_tokens, chances); ``row`` is a hash of id and text.

    Chances are the shares of the domains among labelled texts of the same class of evidence, backed by naive Bayes where there are few.
    The classes are at most as many as labelled texts in the sample, so they are broadcast.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    features = _features(rows.withColumn("row", F.xxhash64("id", "text")))
    found = _evidence(features, ["row", "id", "n_tokens"], classifier).join(F.broadcast(classifier.classes), "class", "left")
    n = len(classifier.domains)
    chances = F.array().cast("array<double>")
    if n:
        top = F.greatest(*(F.col(f"s{k}") for k in range(n)), F.lit(-1e300))
        found = found.withColumns({f"s{k}": F.exp(F.col(f"s{k}") - top) * share for k, share in enumerate(classifier.shares)})
        whole = sum((F.col(f"s{k}") for k in range(n)), F.lit(0.0))
        backed = [F.coalesce(F.col(f"n{k}"), F.lit(0)) + BACKING * F.col(f"s{k}") / whole for k in range(n)]
        chances = F.array(*(b / (F.coalesce("n", F.lit(0)) + BACKING) for b in backed))
    found = found.select("id", "row", "n_tokens", chances.alias("chances"), "times")
    return found.withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).drop("times", "time")


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A small linear system, by elimination with pivots."""
    n = len(right)
    rows = [list(matrix[i]) + [right[i]] for i in range(n)]
    for i in range(n):
        pivot = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for k in range(i + 1, n):
            factor = rows[k][i] / rows[i][i]
            rows[k] = [x - factor * y for x, y in zip(rows[k], rows[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][k] * out[k] for k in range(i + 1, n))) / rows[i][i]
    return out


def rate(tokens: Column, chances: Column, steps: list[list[float]]) -> Column:
    """A document's rate after the steps; one without tokens keeps 1."""
    rate = F.lit(1.0)
    for step in steps:
        moved = sum((chances[k] * g for k, g in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - moved)
    return F.when(tokens > 0, rate).otherwise(F.lit(1.0))


def fit(members: DataFrame, domains: list[str], targets: dict[str, float], steps: int = STEPS) -> list[list[float]]:
    """Projected gradient steps for documents (``n_tokens``, ``chances``). ``targets`` are weights of the domains;
    domains without one have target 0, and the targets' sum is the tokens there are. Without tokens, or a
    domain that has a target, there is nothing to fit and no step."""
    n = len(domains)
    if not any(targets.get(d, 0.0) > 0 for d in domains):
        return []
    p = [F.col("chances")[k] for k in range(n)]
    whole = sum(targets.get(d, 0.0) for d in domains)
    done: list[list[float]] = []
    best: tuple[float, int] = (math.inf, 0)
    for turn in range(steps + 1):
        moved = members.select(rate(F.col("n_tokens"), F.col("chances"), done).alias("rate"), "n_tokens", "chances")
        free = F.when(F.col("rate") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        now = moved.agg(
            F.sum("n_tokens").alias("all"),
            *(F.sum(F.col("rate") * F.col("n_tokens") * p[k]).alias(f"s{k}") for k in range(n)),
            *(F.sum(free * F.col("n_tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)),
        ).first()
        if not now["all"]:
            return []
        error = [now[f"s{k}"] - now["all"] * targets.get(d, 0.0) / whole for k, d in enumerate(domains)]
        off = sum(map(abs, error)) / now["all"]
        best = min(best, (off, turn))
        if off <= TOLERANCE or turn == steps:
            break
        gram = [[now[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]
        ridge = 1e-9 * sum(gram[i][i] for i in range(n)) + 1e-12
        done.append(solve([[gram[i][j] + (ridge if i == j else 0.0) for j in range(n)] for i in range(n)], error))
    return done[: best[1]]


@dataclass
class Mix:
    domains: list[str]
    steps: list[list[float]]
    members: DataFrame  # id, row, n_tokens, chances

    def rate(self) -> Column:
        return rate(F.col("n_tokens"), F.col("chances"), self.steps)


def fit_mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_column: str = "doc_id", text_column: str = "text") -> Mix:
    if not any(w > 0 for w in targets.values()) or any(w < 0 for w in targets.values()):
        raise ValueError("targets are nonnegative weights with a positive sum")
    spark = docs.sparkSession
    folder = work_folder(spark, "mixing")
    classifier = train(docs, labelled, folder, id_column, text_column)
    members(docs, classifier, id_column, text_column).write.parquet(f"{folder}/members")
    found = spark.read.parquet(f"{folder}/members")
    return Mix(classifier.domains, fit(found, classifier.domains, targets), found)


def copies(rate: Column, identity: Column) -> Column:
    """A whole number with that mean: the fraction is decided by a hash of the id."""
    part = F.pmod(F.xxhash64(identity, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens`` (words), ``chances`` (a map from domain to probability), ``rate`` and ``copies``.

    ``labelled`` is (id, domain), ``targets`` weights by domain. Texts without words have no tokens and keep rate 1; NULL texts
    are such. Repeated rows are documents of their own with equal rates. If the labelled table names none of the
    documents, or only domains without a target, every rate is 1. An empty table gives an empty one.
    """
    mix = fit_mix(docs, labelled, targets, id_column, text_column)
    domains = F.array(*map(F.lit, mix.domains)).cast("array<string>")
    chances = F.map_from_arrays(domains, F.col("chances"))
    rows = mix.members.select(F.col("id").alias(id_column), "n_tokens", chances.alias("chances"), mix.rate().alias("rate"))
    return rows.withColumn("copies", copies(F.col("rate"), F.col(id_column)))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, each as often as its copies say."""
    mix = fit_mix(docs, labelled, targets, id_column, text_column)
    times = mix.members.select(F.col("row").alias("mixing_row"), copies(mix.rate(), F.col("id")).alias("mixing_copies")).distinct()
    rows = docs.withColumn("mixing_row", F.xxhash64(id_column, text_column)).join(times.filter("mixing_copies > 0"), "mixing_row")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), "mixing_copies"))
    return rows.withColumn("mixing_copy", each).select(*docs.columns)
