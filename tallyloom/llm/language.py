"""Language identification by fusing evidence in Bayes' rule.

For each supported language l the score of a row is

    temper * log P(text | l) + log P(declared | l) + log P(l | host)

* text: hashed character trigrams (letters, with runs of anything else as one
  blank) of the whole text, with frequencies per language counted on a bounded
  sample of labelled rows (``sample`` a language, chosen by a hash of the id);
* declared: the language that the markup or the row declares is right with
  probability ``1 - slip``; a missing or unknown declaration says nothing;
* host: priors smoothed in a hierarchy - the host's counts of declared
  languages over all rows towards its address suffix's, those towards all
  rows', those towards equal shares.  A row's own declaration is left out of
  all three counts, so it isn't heard twice.

One more class, ``other``, has every trigram equally likely.  A row is rejected
where its text has no trigram of letters at all or ``other`` is the likeliest.

Counts per host are grouped aggregations; they are joined to the rows by
broadcast below ``broadcast_hosts`` hosts and by a shuffle (which splits a hot
host) beyond.

Defined results: null and empty texts are rejected with a null language; null
host or declaration is no evidence; ties go to the language named first;
repeated rows are each decided; texts of any length count whole; an empty table
gives an empty table; a page without address or markup has no such evidence; the rows keep their columns (but for such as
are named like those added, which are replaced).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, modest_batches, slices, tidy, utf8_of

LANGUAGES = ("en", "fr", "de", "es")
BUCKETS = 1 << 16
_letter = np.zeros(0x110000, np.uint8)  # 1: letter, 2: not, 0: not looked at yet


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram with a letter in its middle, text it belongs to)."""
    data, offsets = utf8_of(pc.utf8_lower(texts.cast(pa.string()).fill_null("")))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = lead[offsets]
    kind = _letter[points]
    if not kind.all():
        fresh = np.unique(points[kind == 0])
        _letter[fresh] = [1 if chr(p).isalpha() else 2 for p in fresh.tolist()]
        kind = _letter[points]
    if len(points) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = np.where(kind == 1, points, 32).astype(np.uint32)
    edge = np.zeros(len(points) + 1, bool)
    edge[bounds] = True
    before, after = np.empty_like(symbols), np.empty_like(symbols)
    before[1:], before[0] = symbols[:-1], 32
    after[:-1], after[-1] = symbols[1:], 32
    before[edge[:-1]] = 32
    after[edge[1:]] = 32
    at = np.flatnonzero(symbols != 32)
    hashed = before[at] * np.uint32(0x9E3779B1) ^ symbols[at] * np.uint32(0x85EBCA6B) ^ after[at] * np.uint32(0xC2B2AE35)
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    return (hashed >> np.uint32(16)).astype(np.int64), np.searchsorted(bounds, at, side="right") - 1


def fit_text_model(df: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = 1000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> np.ndarray:
    """log P(trigram bucket | language), languages x BUCKETS, from at most about ``sample`` labelled rows a language."""
    modest_batches(df.sparkSession)
    rows = df.select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label")).where(F.col("label").isin(*languages))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("label") == name, math.ceil(1e6 * min(1.0, sample / n))).otherwise(share)
    chosen = rows.where(F.pmod("h", F.lit(1_000_000)) < share).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for whole in batches:
            for batch in slices(whole, 1, 1 << 18):
                bucket, text = trigrams(batch.column(1))
                label = np.asarray([languages.index(x) for x in batch.column(0).to_pylist()])
                total += np.bincount(label[text] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        label, bucket = np.nonzero(total)
        for at in range(0, len(label), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(label[part]), pa.array(bucket[part]), pa.array(total[label, bucket][part])], names=["label", "bucket", "n"])

    counted = chosen.mapInArrow(tidy(count), "label long, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    total = np.zeros((len(languages), BUCKETS))
    for r in counted.toLocalIterator():  # at most languages x BUCKETS rows
        total[r["label"], r["bucket"]] = r["n"]
    total += 0.05
    return np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32)


def host_counts(df: DataFrame, host: Column, suffix: Column, declared: Column, languages: tuple[str, ...]) -> DataFrame:
    """(host, suffix, by_host, by_suffix, by_all): counts of declared languages over all rows, as arrays."""
    named = df.select(host.alias("host"), suffix.alias("suffix"), declared.alias("declared"))
    per = [F.count(F.when(F.col("declared") == name, 1)).alias(f"n{i}") for i, name in enumerate(languages)]
    hosts = named.groupBy("host", "suffix").agg(*per)
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]
    array = lambda name: F.array(*[F.col(f"n{i}") for i in range(len(languages))]).alias(name)
    suffixes = hosts.groupBy("suffix").agg(*again)
    everything = suffixes.agg(*again).first()  # one row
    by_all = F.array(*[F.lit(int(n or 0)) for n in everything]).alias("by_all")
    by_suffix = suffixes.select(F.col("suffix").alias("of"), array("by_suffix"))
    return hosts.select("host", "suffix", array("by_host")).join(by_suffix, F.col("suffix").eqNullSafe(F.col("of"))).select("host", "suffix", "by_host", "by_suffix", by_all)


def identify_languages(df: DataFrame, model: np.ndarray, languages: tuple[str, ...] = LANGUAGES, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", suffix_col: str | None = None, temper: float = 0.25, slip: float = 0.1, host_weight: float = 20.0, suffix_weight: float = 50.0, all_weight: float = 4.0, other_prior: float = 0.001, broadcast_hosts: int = 20_000) -> DataFrame:
    """``df`` with the columns language, confidence, text_language, n_trigrams and rejected."""
    spark = df.sparkSession
    modest_batches(spark)
    k = len(languages)
    table = spark.sparkContext.broadcast(np.vstack([model, np.full((1, BUCKETS), -math.log(BUCKETS), np.float32)]))

    @F.pandas_udf("scores array<double>, n long")
    def score(texts: pd.Series) -> pd.DataFrame:
        arrow = pa.array(texts, pa.string())
        sums, n = np.zeros((len(arrow), k + 1)), np.zeros(len(arrow), np.int64)
        batch = pa.RecordBatch.from_arrays([arrow], names=["text"])
        at = 0
        for part in slices(batch, 0, 1 << 18):
            bucket, text = trigrams(part.column(0))
            rows = part.num_rows
            n[at : at + rows] = np.bincount(text, minlength=rows)
            for i, row in enumerate(table.value):
                sums[at : at + rows, i] = np.bincount(text, weights=row[bucket], minlength=rows)
            at += rows
        give_back()
        return pd.DataFrame({"scores": list(sums), "n": n})

    score = score.asNondeterministic()  # else a later filter on the result would be pushed below and score every text twice

    found = ("language", "confidence", "text_language", "n_trigrams", "rejected")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{declared_col}`").alias("declared"),
        F.col(f"`{host_col}`").alias("host"),
        (F.col(f"`{suffix_col}`") if suffix_col else F.lit("")).alias("suffix"),
    )
    host, suffix, declared = F.col("host"), F.col("suffix"), F.col("declared")
    priors = host_counts(rows, host, suffix, declared, languages).select(F.col("host").alias("_host"), F.col("suffix").alias("_suffix"), "by_host", "by_suffix", "by_all")
    if priors.count() <= broadcast_hosts:
        priors = F.broadcast(priors)
    own = {name: (F.coalesce(declared, F.lit("")) == name).cast("double") for name in languages}
    some = sum(own.values(), F.lit(0.0))
    joined = rows.withColumn("_text", score("text")).join(priors, host.eqNullSafe(F.col("_host")) & suffix.eqNullSafe(F.col("_suffix")), "left")

    def without(name: str, i: int) -> Column:
        return F.col(name)[i] - own[languages[i]]

    def total(name: str) -> Column:
        return sum((F.col(name)[i] for i in range(k)), F.lit(0.0)) - some

    scores = []
    for i, name in enumerate(languages):
        everywhere = (without("by_all", i) + all_weight / k) / (total("by_all") + all_weight)
        by_suffix = (without("by_suffix", i) + suffix_weight * everywhere) / (total("by_suffix") + suffix_weight)
        prior = (without("by_host", i) + host_weight * by_suffix) / (total("by_host") + host_weight)
        said = F.when(declared == name, 1 - slip).when(declared.isin(*languages), slip / max(1, k - 1)).otherwise(1.0)
        scores.append(F.col("_text.scores")[i] * temper + F.log(said) + F.log(F.when(host.isNull(), by_suffix).otherwise(prior)))
    scores.append(F.col("_text.scores")[k] * temper + F.lit(math.log(other_prior)))
    joined = joined.withColumn("_scores", F.array(*scores)).withColumn("_best", F.array_max("_scores"))
    joined = joined.withColumn("_at", F.array_position("_scores", F.col("_best")) - 1)
    total_odds = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best")))
    names = F.array(*[F.lit(x) for x in languages], F.lit(None).cast("string"))
    text_best = F.array_position(F.slice(F.col("_text.scores"), 1, k), F.array_max(F.slice(F.col("_text.scores"), 1, k))) - 1
    empty = F.col("_text.n") == 0
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in df.columns if c not in found],
        F.when(~empty, names[F.col("_at").cast("int")]).alias("language"),
        (1 / total_odds).alias("confidence"),
        F.when(~empty, names[text_best.cast("int")]).alias("text_language"),
        F.col("_text.n").alias("n_trigrams"),
        (empty | (F.col("_at") == k)).alias("rejected"),
    )


_DROPPED = re.compile(r"(?is)<(script|style|nav|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_ENTITY = re.compile(r"&(#\d+|#[xX][0-9a-fA-F]+|\w+);")


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text (markup removed), declared, host and suffix columns."""
    import html as entities

    @F.pandas_udf("string")
    def visible(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None else _ENTITY.sub(lambda m: entities.unescape(m[0]), _DROPPED.sub(" ", h)))

    host = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    declared = F.substring(F.lower(F.regexp_extract(F.col(html_col), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)), 1, 2)
    return pages.withColumn("text", visible(F.col(html_col))).withColumn("declared", F.when(declared != "", declared)).withColumn("host", F.when(host != "", host)).withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))
