"""Language identification by fusing text likelihoods, declared languages, address suffixes and host priors."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, stored, text_of, without

BUCKETS = 1 << 15
#: Labels before a country's that are part of the public suffix. Fixed values.
SECOND_LEVEL = ["ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org"]


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter and else a space."""
    table = np.full(0x110000, 32, np.uint32)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = 0
    return np.where(table == 0, np.arange(0x110000, dtype=np.uint32), table).astype(np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the letter trigrams of the lower-case text, with what is not a letter as one space."""
    c = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int64)


class Profiles:
    """Languages and their log probabilities of trigram buckets; the last language, "und", knows nothing and is uniform."""

    def __init__(self, languages: Sequence[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages = [*languages, "und"]
        p = (counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * counts.shape[1])
        self.log = np.vstack([np.log(p), np.full(counts.shape[1], -math.log(counts.shape[1]))]).astype(np.float32)

    def score(self, text: str) -> tuple[np.ndarray, int]:
        g = trigrams(text)
        return np.array([row[g].sum(dtype=np.float64) for row in self.log]), len(g)


def train_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200) -> Profiles:
    """Trigram profiles from at most per_language rows of each label; every label is a language.

    The rows are those with the least md5 of the id. This bounded sample only
    fits the classifier; everything counted later covers all rows.
    """
    ship(labelled.sparkSession)
    names = sorted(r[0] for r in labelled.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().collect())
    if not names:
        return Profiles([], np.zeros((0, BUCKETS)))
    draw = F.md5(F.concat_ws("|", F.lit("profile"), F.col(id_col).cast("string")))
    first = Window.partitionBy("lang").orderBy("draw", "id")
    ids = labelled.where(F.col(lang_col).isin(names)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), draw.alias("draw"))
    ids = ids.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language).select("id", "lang")
    sample = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text_of(text_col).alias("text")).join(F.broadcast(ids.distinct()), ["id", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(names), BUCKETS), np.int64)
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[names.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
        k, b = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(seen[k, b], pa.int64())], ["k", "bucket", "n"])

    counts = np.zeros((len(names), BUCKETS))
    for r in sample.select("lang", "text").mapInArrow(count, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.k, r.bucket] = r.n
    return Profiles(names, counts)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host of raw pages: text without markup, the language of the html element, the host of the address."""
    html = text_of("html")
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return pages.select("page_id", bare.alias("text"), F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("declared"), F.nullif(_host(F.col("url")), F.lit("")).alias("host"))


def identify_languages(
    rows: DataFrame,
    profiles: Profiles,
    text_col: str = "text",
    declared_col: str | None = "declared",
    host_col: str | None = "host",
    temper: float = 0.2,
    host_weight: float = 5.0,
    domain_weight: float = 20.0,
    min_confidence: float = 0.5,
    unknown_prior: float = 1e-3,
    carry: Sequence[str] | None = None,
    most_broadcast: int = 500_000,
) -> DataFrame:
    """rows (the columns of `carry`, all by default) plus lang, confidence, rejected and text_lang.

    The posterior of a language is proportional to the product of
    the likelihood of the text's letter trigrams to the power `temper` (they
    are not independent), the probability of the declared language given the
    language, that of the host's suffix given the language, and the host's
    prior. All three tables are counted over all rows by the language that
    the text alone suggests. The host's prior is its own counts smoothed with
    host_weight rows of its domain's prior (the label before the public suffix
    and the suffix), which is smoothed with domain_weight rows of the prior of
    all rows. A host without a dot has no address suffix. The table of
    host priors is counted, and broadcast only where it has at most
    most_broadcast numbers; a larger one is joined with salted keys.

    rejected is true where "und" (a uniform text model with a prior of
    unknown_prior) wins, or the best language has less than min_confidence.
    A null or empty text without other evidence has the global prior. A null
    declaration or host says nothing. Repeated rows come out alike, but count
    in the priors. Without known languages all rows are "und". An empty table
    gives no rows. Of languages with the same posterior the first by name
    wins. Columns named like a result column are replaced.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = without(rows, "lang_id", "confidence", "rejected", "text_lang")
    carry = [c for c in (rows.columns if carry is None else carry)]
    names = profiles.languages
    known = names[:-1]
    model = spark.sparkContext.broadcast(profiles)
    declared = F.lower(F.regexp_extract(F.col(declared_col).cast("string"), r"^\s*([A-Za-z]+)", 1)) if declared_col else F.lit(None).cast("string")
    keys = rows.select(*[F.col(f"`{c}`").alias(f"_of{i}") for i, c in enumerate(carry)], F.nullif(declared, F.lit("")).alias("_declared"), (F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")).alias("_host"), text_of(text_col).alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.value.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            ll = pa.array([s.tolist() for s, _ in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ll, pa.array([n for _, n in found], pa.int64())], [*batch.schema.names[:-1], "_ll", "_n"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields[:-1]) + ", `_ll` array<double>, `_n` bigint"
    scored = stored(keys.mapInArrow(score, schema), "language-scores")
    size = len(names)
    at = lambda a, i: F.element_at(a, i + 1)
    best = F.array_position(F.col("_ll"), F.array_max("_ll")).cast("int")
    sure = scored.where("_n > 0").select("_host", "_declared", best.alias("best"))
    per_host = sure.where(F.col("_host").isNotNull()).groupBy("_host").agg(*[F.count_if(F.col("best") == i + 1).alias(f"n{i}") for i in range(size)])
    domain = F.regexp_extract("_host", rf"([^.]+\.(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]+\.[^.]+|[^.]+)$", 1)
    per_host = per_host.withColumns({"_domain": domain, "_suffix": F.when(F.col("_host").contains("."), F.substring_index("_host", ".", -1))})
    total = lambda p: sum((F.col(f"{p}{i}") for i in range(size)), F.lit(0.0))

    # Bounded by the number of languages: what all rows say, and how often each known code is declared.
    codes = [*known, "other"]
    code = F.when(F.col("_declared").isNull(), F.lit(None)).when(F.col("_declared").isin(*known), F.col("_declared")).otherwise(F.lit("other")) if known else F.lit(None).cast("string")
    said: dict[tuple[str | None, int], int] = {(r[0], r[1]): r[2] for r in sure.select(code.alias("code"), "best").groupBy("code", "best").count().collect()}
    seen = np.array([sum(n for (_, b), n in said.items() if b == i + 1) for i in range(size)], float)
    base = np.array([*(seen[:-1] + 1), 0.0])
    base = base / max(base.sum(), 1) * (1 - unknown_prior)
    base[-1] = unknown_prior
    given = np.array([[said.get((c, i + 1), 0) for c in codes] for i in range(size)], float) + 0.5
    given[-1] = 1
    given = np.log(given / given.sum(axis=1, keepdims=True))
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    declared_log = functools.reduce(lambda c, k: F.when(code == codes[k], array(given[:, k])).otherwise(c), range(len(codes)), array(np.zeros(size)))

    domains = per_host.groupBy("_domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(size)])
    suffixes = per_host.where("_suffix is not null").groupBy("_suffix").agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(size)])
    kinds = suffixes.count() + 1
    hosts = per_host.join(domains, "_domain").join(suffixes, "_suffix", "left")
    prior = []
    for i in range(size):
        of_domain = (F.col(f"d{i}") + domain_weight * float(base[i])) / (total("d") + domain_weight)
        of_host = (F.col(f"n{i}") + host_weight * of_domain) / (total("n") + host_weight)
        suffix = (F.col(f"s{i}") + 0.5) / (float(seen[i]) + 0.5 * kinds) if i < size - 1 else F.lit(1 / kinds)
        prior.append(F.log(of_host) + F.when(F.col("_suffix").isNull(), 0.0).otherwise(F.log(suffix)))
    hosts = stored(hosts.select(F.col("_host").alias("_h"), F.array(*prior).alias("_prior")), "host-priors")
    if hosts.count() * size <= most_broadcast:
        fused = scored.join(F.broadcast(hosts), F.col("_host") == F.col("_h"), "left")
    else:
        # One host may hold a third of all rows: rows go to one of 32 copies of their host's prior.
        spread = scored.withColumn("_salt", F.pmod(F.xxhash64("_ll", "_n"), F.lit(32)))
        copies = hosts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(31))))
        fused = spread.join(copies, (F.col("_host") == F.col("_h")) & (F.col("_salt") == F.col("_s")), "left")
    log = F.zip_with(F.transform("_ll", lambda x: x * temper), F.zip_with(F.coalesce("_prior", array(np.log(base))), declared_log, lambda a, b: a + b), lambda a, b: a + b)
    fused = fused.withColumn("_log", log)
    odds = F.transform("_log", lambda x: F.exp(x - F.array_max("_log")))
    fused = fused.withColumn("_best", F.array_position(F.col("_log"), F.array_max("_log")).cast("int"))
    confidence = F.lit(1.0) / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    label = array_of(names)
    return fused.select(
        *[F.col(f"_of{i}").alias(c) for i, c in enumerate(carry)],
        at(label, F.col("_best") - 1).alias("lang_id"),
        F.round(confidence, 9).alias("confidence"),
        ((F.col("_best") == size) | (confidence < min_confidence)).alias("rejected"),
        F.when(F.col("_n") > 0, at(label, best - 1)).alias("text_lang"),
    )


def array_of(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])
