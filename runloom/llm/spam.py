"""Keyword-stuffed and link-list pages: bagged trees from weak labels, smoothed by host-level rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom import scratch
from runloom.llm.pages import FEATURES, features

#: What the trees see: how a page falls into units and lines. What the rules of weak_label() look at is left to the rules,
#: else the trees would learn the rules again and not what the pages that they label have in common.
SEEN = ("heap_share", "heap_units", "longest_unit", "distinct", "link_chars", "bullets", "short_lines", "capital_starts")

_SCHEMA = "doc_id long, host string, " + ", ".join(f"{f} double" for f in FEATURES)


def page_features(documents: DataFrame) -> DataFrame:
    """(doc_id, host, features...) of raw messages; host is the domain of the sender, '' where there is none."""
    host = F.coalesce(F.regexp_extract(F.lower("sender"), r"@([^\s<>@,;]+)", 1), F.lit(""))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([features(x) for x in b["text"]], columns=list(FEATURES))
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            out.insert(1, "host", b["host"].to_numpy())
            yield out

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", host.alias("host")).where("doc_id is not null").mapInPandas(measure, _SCHEMA)


def weak_label(votes_needed: int = 2):
    """1 for a page that votes_needed of the rules call stuffed, 0 for one that none does and that is rich in function
    words, else null. The rules look at counts of words, separators, links and lines, never at how much of a page is heaps."""
    rules = (
        F.col("function_words") < 0.2,
        F.col("separators") > 0.35,
        (F.col("links") > 0.08) | (F.col("anchors") > 0.08),
        F.col("top_word") > 0.15,
        F.col("repeated_lines") > 0.6,
    )
    votes = sum((F.when(c, 1).otherwise(0) for c in rules), F.lit(0))
    return F.when(votes >= votes_needed, 1).when((votes == 0) & (F.col("function_words") > 0.3), 0)


def score_pages(pages: DataFrame, *, trees: int = 20, depth: int = 5, sample: int = 20_000, host_weight: float = 0.2, host_prior: float = 20.0, seed: int = 7) -> DataFrame:
    """(doc_id, host, heap_share, page_score, host_rate, score) for page_features().

    Trees over SEEN are bagged on at most `sample` weakly labelled pages of each label (the bound on what is fitted), taken by the
    hash of doc_id, with a bin for every value, so that a split lies midway between two pages; every page is scored. A host's rate is the mean score of all its pages, drawn to the overall mean as
    by host_prior more pages; score = (1 - host_weight) * page_score + host_weight * host_rate. If only one label
    occurs, the weak label, or else the heap share, stands for the trees' score. A page without text of its own is not
    fitted on and has page_score 0. Empty input gives no rows.
    """
    pages = scratch.table(pages, "pages")
    blank = F.col("distinct") == 0
    labelled = pages.where(~blank).withColumn("label", weak_label().cast("double")).where("label is not null")
    order = F.xxhash64("doc_id", F.lit(seed))
    parts = [labelled.where(F.col("label") == x).orderBy(order, "doc_id").limit(sample) for x in (0.0, 1.0)]
    drawn = scratch.table(parts[0].union(parts[1]).coalesce(2), "drawn")
    seen = {r[0]: r[1] for r in drawn.groupBy("label").count().collect()}
    if len(seen) == 2:
        leaf = max(1, min(seen.values()) // 50)  # a few wrong labels make no leaf
        assembler = VectorAssembler(inputCols=list(SEEN), outputCol="v")
        forest = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", subsamplingRate=1.0, maxBins=max(32, 2 * sample), minInstancesPerNode=leaf, seed=seed)
        model = forest.fit(assembler.transform(drawn))
        scored = model.transform(assembler.transform(pages)).withColumn("page_score", vector_to_array("probability")[1])
    else:
        scored = pages.withColumn("page_score", F.coalesce(weak_label().cast("double"), F.col("heap_share")))
    scored = scratch.table(scored.select("doc_id", "host", "heap_share", F.when(blank, 0.0).otherwise(F.col("page_score")).alias("page_score")), "scores")
    scratch.forget(drawn, pages)
    mean = scored.agg(F.avg("page_score")).first()[0] or 0.0
    hosts = scored.groupBy("host").agg(((F.sum("page_score") + host_prior * mean) / (F.count(F.lit(1)) + host_prior)).alias("host_rate"))
    return scored.join(hosts, "host").select("doc_id", "host", "heap_share", "page_score", "host_rate", ((1 - host_weight) * F.col("page_score") + host_weight * F.col("host_rate")).alias("score"))


def stuffed_pages(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pages whose score, that of the trees smoothed by the host's rate, reaches the threshold; nothing else decides."""
    return score_pages(page_features(documents)).where(F.col("score") >= threshold)
