"""Language identification by Bayesian fusion of evidence.

Text: byte trigrams in hashed slots, with a multinomial model for each language
counted over all texts by the language they declare. Declared markup language,
country domain and language part of the path: how often each goes with a text
whose own words say a language, from the same counts. Host: a prior by grouped
aggregation, smoothed towards the parent domain, which is smoothed towards the
whole corpus. Texts stay where they are read; only small rows are shuffled, and
host counts are pre-aggregated before they are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlab.llm import text as tx
from carrierlab.llm.tables import checkpointed

LANGUAGES = ("de", "en", "es", "fr")
# Country domains with one main language.
DOMAINS = {
    "de": "de", "at": "de", "li": "de", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "es": "es", "mx": "es",
    "ar": "es", "cl": "es", "pe": "es", "uy": "es", "ve": "es", "fr": "fr", "mc": "fr"}
SLOTS = 1 << 14
HOST_WEIGHT, PARENT_WEIGHT = 20.0, 50.0
MIN_POSTERIOR, LEAST_FIT = 0.5, -2.0
TEXT_UNITS = 40.0


def trigram_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of each byte trigram inside a text that holds a letter; A-Z as a-z."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = tx.LOWER[data].astype(np.uint32)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    letter = (low >= 128) | ((low >= 97) & (low <= 122))
    keep = (owner[:-2] == owner[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])
    return owner[:-2][keep], ((code[keep] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def identify(rows: DataFrame, id_cols: list[str], text_col: str, declared: Column, suffix: Column, host: Column,
             parent: Column, languages: tuple[str, ...] = LANGUAGES, path: Column | None = None) -> DataFrame:
    """``id_cols`` with predicted, posterior, text_language, fit, declared and kept.

    A row is kept when the best language has a posterior of at least
    ``MIN_POSTERIOR`` and the text has words of it: the mean log likelihood
    ratio of its trigrams against an even model is not below ``LEAST_FIT``.
    Null and empty texts, and texts without letters, have no text evidence and
    are rejected. ``suffix`` is the language of the host's country domain,
    ``path`` that of the address's path. Null or unknown declarations,
    suffixes, paths and hosts add nothing.
    Ids may repeat or be null; an empty table gives an empty result. Starts
    Spark jobs while the plan is built.
    """
    number = F.create_map(*[x for i, c in enumerate(languages) for x in (F.lit(c), F.lit(i))])
    k = len(languages)
    rows = rows.select(
        *id_cols, F.col(text_col).alias("text"), number[F.lower(F.substring(declared, 1, 2))].alias("declared"),
        number[F.lower(suffix)].alias("suffix"), host.alias("host"), parent.alias("parent"),
        *([] if path is None else [number[F.lower(path)].alias("path")]))
    evidence = ["declared", "suffix", *([] if path is None else ["path"])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((k, SLOTS), dtype=np.int64)
        for part, data, offsets in tx.slices(batches, "text"):
            owner, slot = trigram_slots(data, offsets)
            said = part.column("declared").fill_null(-1).to_numpy()[owner]
            counts += np.bincount(said[said >= 0] * SLOTS + slot[said >= 0], minlength=k * SLOTS).reshape(k, SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.reshape(-1)[at])], names=["at", "n"])

    # k * 16,384 sums at most, whatever the corpus.
    sums = rows.select("declared", "text").mapInArrow(count, "at long, n long").groupBy("at").agg(
        F.sum("n").alias("n")).toPandas()
    counts = np.zeros(k * SLOTS)
    counts[sums["at"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.float64)
    counts = counts.reshape(k, SLOTS) + 0.5
    model = np.log(counts / counts.sum(axis=1, keepdims=True)) + np.log(SLOTS)

    names = [*id_cols, *evidence, "host", "parent"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tx.slices(batches, "text"):
            owner, slot = trigram_slots(data, offsets)
            n = np.bincount(owner, minlength=part.num_rows)
            means = [np.bincount(owner, weights=m[slot], minlength=part.num_rows) / np.maximum(n, 1) for m in model]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), pa.array(n), *(pa.array(x) for x in means)],
                names=[*names, "n", *(f"t{i}" for i in range(k))])

    weighed = checkpointed(rows.mapInArrow(weigh, ", ".join(
        [*(f"`{c}` {types[c]}" for c in names), "n long", *(f"t{i} double" for i in range(k))])))
    # A text counts as at most TEXT_UNITS independent trigrams.
    units = F.least(F.col("n").cast("double"), F.lit(TEXT_UNITS))
    text = [F.col(f"t{i}") * units for i in range(k)]
    best = F.when(F.col("n") > 0, _argmax([F.col(f"t{i}") for i in range(k)]))
    weighed = weighed.withColumn("said", best)
    tables = {}
    for column in evidence:
        seen = np.ones((k, k))
        for r in weighed.where(f"said IS NOT NULL AND {column} IS NOT NULL").groupBy("said", column).count().collect():
            seen[r["said"], r[column]] += r["count"]
        tables[column] = np.log(seen / seen.sum(axis=1, keepdims=True))
    tally = [F.sum((F.col("said") == i).cast("long")).alias(f"h{i}") for i in range(k)]
    corpus = weighed.agg(*tally).first()
    prior = np.array([corpus[i] or 0 for i in range(k)]) + 1.0
    prior /= prior.sum()
    hosts = weighed.where("host IS NOT NULL").groupBy("host", "parent").agg(*tally)
    parents = hosts.groupBy("parent").agg(*[F.sum(f"h{i}").alias(f"p{i}") for i in range(k)])
    whole = sum((F.col(f"p{i}") for i in range(k)), F.lit(0))
    parents = parents.select("parent", *[
        ((F.col(f"p{i}") + PARENT_WEIGHT * float(prior[i])) / (whole + PARENT_WEIGHT)).alias(f"p{i}") for i in range(k)])
    whole = sum((F.col(f"h{i}") for i in range(k)), F.lit(0))
    hosts = hosts.join(parents, hosts["parent"].eqNullSafe(parents["parent"]), "left").drop(parents["parent"]).select(
        "host", F.col("parent").alias("above"), *[
            F.log((F.col(f"h{i}") + HOST_WEIGHT * F.col(f"p{i}")) / (whole + HOST_WEIGHT)).alias(f"h{i}") for i in range(k)])
    scored = weighed.join(hosts, (weighed["host"] == hosts["host"]) & weighed["parent"].eqNullSafe(hosts["above"]),
                          "left").drop(hosts["host"])

    def seen_log(column: str, i: int) -> Column:
        return F.coalesce(F.get(F.lit([float(x) for x in tables[column][i]]), F.col(column)), F.lit(0.0))

    logs = [text[i] + sum((seen_log(column, i) for column in evidence), F.lit(0.0))
            + F.coalesce(F.col(f"h{i}"), F.lit(float(np.log(prior[i])))) for i in range(k)]
    scored = scored.select(*id_cols, "n", "said", "declared", *[F.col(f"t{i}") for i in range(k)],
                           *[x.alias(f"l{i}") for i, x in enumerate(logs)])
    top = F.greatest(*[F.col(f"l{i}") for i in range(k)])
    winner = _argmax([F.col(f"l{i}") for i in range(k)])
    total = sum((F.exp(F.col(f"l{i}") - top) for i in range(k)), F.lit(0.0))
    names_of = F.lit(list(languages))
    fit = F.get(F.array(*[F.col(f"t{i}") for i in range(k)]), winner)
    return scored.select(
        *id_cols, F.get(names_of, winner).alias("predicted"), F.round(1.0 / total, 6).alias("posterior"),
        F.get(names_of, F.col("said")).alias("text_language"), F.round(fit, 6).alias("fit"),
        F.get(names_of, F.col("declared")).alias("declared"),
        ((F.col("n") > 0) & (1.0 / total >= MIN_POSTERIOR) & (fit >= LEAST_FIT)).alias("kept"))


def _argmax(values: list[Column]) -> Column:
    top = F.greatest(*values)
    out: Column = F.lit(len(values) - 1)
    for i in reversed(range(len(values) - 1)):
        out = F.when(values[i] == top, i).otherwise(out)
    return out


def documents_language(docs: DataFrame) -> DataFrame:
    """Documents declare ``lang``; their ``source`` stands for the host; they have no address."""
    return identify(docs, ["doc_id"], "text", F.col("lang"), F.lit(None).cast("string"), F.col("source"),
                    F.lit(None).cast("string"))


def path_language(url: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """Language that the first part of the path names, else its last part; a region may follow."""
    address, name = "(?i)^[a-z]+://[^/?#]+/", "([a-z]{2})(?:[-_][a-z]{2})?"
    parts = [F.lower(F.regexp_extract(url, address + between + name + end, 1)) for between, end in (
        ("", "(?:[/?#]|$)"), ("(?:[^?#]*/)?", "/?(?:[?#]|$)"))]
    return F.coalesce(*[F.when(x.isin(list(languages)), x) for x in parts])


def pages_language(pages: DataFrame) -> DataFrame:
    """Pages: markup language, country domain, language part of the path, host and its parent domain."""
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1))
    host = F.when(host != "", host)
    domain = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    pages = pages.withColumn("bare", F.regexp_replace(F.regexp_replace(
        "html", "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", " "))
    return identify(
        pages, ["page_id"], "bare", F.regexp_extract("html", "(?i)<html[^>]*\\blang=[\"']?([a-zA-Z]{2})", 1),
        domain[F.regexp_extract(host, "\\.([a-z]{2})$", 1)], host, F.regexp_extract(host, "([^.]+\\.[^.]+)$", 1),
        path=path_language(url))
