"""Language identification by fusing independent evidence about a text.

Evidence: the likelihood of the text's byte trigrams under each language, the language its markup
declares, the suffix of its address, and a prior of its host. The host prior is a grouped count of
what the other evidence says about all texts of the host, smoothed towards the host's domain, whose
prior is smoothed towards the whole corpus; both are Dirichlet means. Log evidences add up, and a
normalisation gives the posterior. The class ``und`` stands for text unlike every language.

Trigram counts are fitted on an expected ``fit_docs`` texts for each declared language, picked by
hash (a bound on fitting only); host counts, scores and decisions cover all rows. Hosts meet their
rows by a broadcast only while there are at most ``BROADCAST_HOSTS`` of them, else by a join.

Defined cases: a null or empty text gives no text evidence; null, unknown or missing declarations,
addresses and hosts give none either; with no evidence the corpus prior decides; without texts of
a language to fit on it has no text evidence in its favour; further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, stage
from .words import free_name, hash_share, text_bytes, text_parts

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
GRAMS = 1 << 15
BROADCAST_HOSTS = 100_000

# Address suffixes that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "es": "es", "mx": "es", "ar": "es", "fr": "fr"}

# ASCII letters lower-cased, other ASCII to a blank, further bytes as they are.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of many texts and the text each belongs to; runs of blanks are skipped."""
    data = np.frombuffer(b"  ".join([b"", *texts, b""]), np.uint8)
    folded = _FOLD[data]
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    owner = np.concatenate((owner, np.full(len(data) - len(owner), max(len(texts) - 1, 0))))[:len(data) - 2]
    code = folded[:-2] * np.uint32(65_536 + 1) ^ folded[1:-1] * np.uint32(263) ^ folded[2:] * np.uint32(40_503)
    code = (code * np.uint32(2_654_435_761)) >> np.uint32(17)
    said = (folded[1:-1] != 32) | ((folded[:-2] != 32) & (folded[2:] != 32))
    return code[said].astype(np.int64), owner[said]


def _counts(batches):
    """Trigram counts of each language in one task."""
    total: dict[str, np.ndarray] = {}
    with np.errstate(over="ignore"):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text")
            for lang in set(langs):
                own = texts.filter(pa.array([x == lang for x in langs]))
                for part in text_parts(own):
                    code, _ = _grams(part)
                    total[lang] = total.get(lang, 0) + np.bincount(code, minlength=GRAMS)
    for lang, n in total.items():
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen, pa.int32()),
                                          pa.array(n[seen], pa.int64())], names=["lang", "gram", "n"])


def train(docs: DataFrame, *, text: str = "text", declared: str = "lang", languages: tuple[str, ...] = LANGUAGES,
          fit_docs: int = 1500) -> np.ndarray:
    """Log probability of each trigram by language, the last row for ``und``."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.lower(F.col(declared).cast("string")).alias("lang"), F.col(text).alias("text")) \
        .filter(F.col("lang").isin(*languages))
    counts = dict(rows.groupBy("lang").count().collect())
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & hash_share(F.col("text"), min(1.0, fit_docs / n)))
    found = rows.filter(wanted).select("lang", text_bytes("text").alias("text")) \
        .mapInArrow(_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((len(languages) + 1, GRAMS))
    for lang, gram, n in found:  # at most GRAMS rows for each language
        table[languages.index(lang), gram] = n
    size = table.sum(1, keepdims=True)
    share = (table + 0.02) / (size + 0.02 * GRAMS)
    share[size[:, 0] == 0] = 1.0 / (4 * GRAMS)
    share[-1] = 1.5 / GRAMS
    return np.log(share).astype(np.float32)


def text_evidence(model: np.ndarray, docs: DataFrame, weight: float, most: int):
    """Function of the text: log likelihood by language. Trigrams overlap, so their mean counts for
    ``weight`` times their number, and for ``most`` trigrams at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def scored(texts: pa.Array) -> pa.Array:
        table = shared.value
        out = []
        with np.errstate(over="ignore"):
            for part in text_parts(texts):
                code, owner = _grams(part)
                n = np.bincount(owner, minlength=len(part))
                ll = np.column_stack([np.bincount(owner, weights=row[code], minlength=len(part)) for row in table]).astype(np.float64)
                ll *= (weight * np.minimum(n, most) / np.maximum(n, 1))[:, None]
                out += ll.tolist()
        return pa.array(out, type=pa.list_(pa.float64()))
    return scored


def _agrees(column: Column, classes: tuple[str, ...], trust: float) -> Column:
    """Log likelihood of a statement that names the true language with probability ``trust``."""
    known = [c for c in classes if c != UNKNOWN]
    said = F.lower(column.cast("string"))
    hit, miss = float(np.log(trust)), float(np.log((1 - trust) / max(len(known) - 1, 1)))
    return F.when(said.isin(*known), F.array(*[
        F.lit(float(-np.log(len(known)))) if c == UNKNOWN else F.when(said == c, hit).otherwise(miss)
        for c in classes])).otherwise(F.array(*[F.lit(0.0)] * len(classes)))


def _sum(*parts: Column) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = F.zip_with(out, part, lambda x, y: x + y)
    return out


def _posterior(logs: Column) -> Column:
    odds = F.transform(logs, lambda x: F.exp(F.greatest(x - F.array_max(logs), F.lit(-700.0))))
    return F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))


def identify(docs: DataFrame, *, text: str = "text", declared: str | None = "lang", host: str | None = "source",
             suffix: Column | None = None, languages: tuple[str, ...] = LANGUAGES, model: np.ndarray | None = None,
             declared_trust: float = 0.8, suffix_trust: float = 0.7, text_weight: float = 0.25, text_most: int = 400,
             host_strength: float = 20.0, domain_strength: float = 50.0, into: str = "language") -> DataFrame:
    """``docs`` with a struct column: language, its posterior, and the posterior of every class.

    ``host`` names the column that groups rows; its domain is the last two labels of a dotted
    name, or the name without its number. ``suffix`` is the last label of an address.
    """
    bound_batches(docs.sparkSession)
    classes = (*languages, UNKNOWN)
    k = len(classes)
    if model is None:
        model = train(docs, text=text, declared=declared, languages=languages)
    none = F.array(*[F.lit(0.0)] * k)
    speaks = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    says = _agrees(F.col(declared), classes, declared_trust) if declared else none
    ends = _agrees(speaks[F.lower(suffix)], classes, suffix_trust) if suffix is not None else none
    own = free_name(docs, "own_evidence")
    name = free_name(docs, "host_name")
    at = F.col(host).cast("string") if host else F.lit(None).cast("string")
    spoken = text_evidence(model, docs, text_weight, text_most)(text_bytes(text))
    seen = docs.withColumn(own, spoken).withColumn(own, _sum(F.col(own), says, ends)).withColumn(name, at)

    # Counts of what each host's texts look like, partly summed in each task before the shuffle.
    believed = seen.select(F.col(name).alias("host"), _posterior(F.col(own)).alias("p"))
    counts = believed.groupBy("host").agg(*[F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(k)])
    domain = F.when(F.col("host").contains("."), F.substring_index("host", ".", -2)) \
        .otherwise(F.regexp_replace("host", "[0-9]+$", ""))
    counts = stage(counts.withColumn("domain", domain))  # one row for each host
    whole = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)) for i in range(k)]).first()
    total = sum(whole)
    corpus = [(n + 1.0) / (total + k) for n in whole]
    domains = counts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(k)])

    def smoothed(n: list[Column], strength: float, towards: list) -> list[Column]:
        size = sum(n[1:], n[0])
        return [(x + strength * t) / (size + strength) for x, t in zip(n, towards)]

    upper = smoothed([F.coalesce(f"d{i}", F.lit(0.0)) for i in range(k)], domain_strength, [F.lit(p) for p in corpus])
    prior = smoothed([F.col(f"n{i}") for i in range(k)], host_strength, upper)
    hosts = counts.filter(F.col("host").isNotNull()).join(domains, "domain") \
        .select(F.col("host").alias(name), F.array(*[F.log(p) for p in prior]).alias("log_prior"))
    log_prior = free_name(seen, "log_prior")
    hosts = hosts.withColumnRenamed("log_prior", log_prior)
    if counts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    fallback = F.array(*[F.lit(float(np.log(p))) for p in corpus])
    known = seen.join(hosts, name, "left")
    posterior = free_name(known, "posterior")
    known = known.withColumn(posterior, _posterior(_sum(F.col(own), F.coalesce(F.col(log_prior), fallback))))
    best = F.array_max(posterior)
    named = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(F.col(posterior), best).cast("int"))
    return known.select(*[F.col(c) for c in docs.columns], F.struct(
        named.alias("name"), best.alias("probability"), F.col(posterior).alias("posterior")).alias(into))


def keep_languages(docs: DataFrame, *, least: float = 0.5, languages: tuple[str, ...] = LANGUAGES, **how) -> DataFrame:
    """Documents in one of the languages with a posterior of at least ``least``; same columns."""
    into = free_name(docs, "language")
    found = identify(docs, languages=languages, into=into, **how)
    return found.filter(F.col(f"{into}.name").isin(*languages) & (F.col(f"{into}.probability") >= least)) \
        .select(*docs.columns)
