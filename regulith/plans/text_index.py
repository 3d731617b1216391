"""A positional index of citation texts, as two tables.

Each text is tokenised once. ``postings`` has a row per term and citation with the places of the term, partitioned by a hash
of the term and sorted by it, so that a search reads the partitions of its terms only and heavy terms are split over
files. ``terms`` has a row per term and scope with document frequency, largest frequency and shortest text: from it come
the rarest term of a question and upper bounds of scores without a look at the postings. The number of citations and
of tokens is that of the empty term, which every citation holds once, at place 0.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.functions.text import simple_tokens
from regulith.plans.posting_kernel import POSTINGS, grouped_places
from regulith.session import col, materialise, scratch_path

SCOPE = ("province", "doc_class")
EVERY = ""  # the term of all citations
BUCKETS = 16


def bucket_of(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(col(term)), F.lit(BUCKETS)).cast("int")


def keys_of(asked: DataFrame) -> DataFrame:
    """Asked terms with their partition. The predicate is one that the planner takes as ground for dynamic partition pruning."""
    return asked.filter(F.col("term") > EVERY).select(bucket_of("term").alias("bucket"), "term")


@dataclasses.dataclass(frozen=True)
class TextIndex:
    """postings: bucket, term, citation_id, province, doc_class, asset, length, positions. terms: bucket, term, province, doc_class, df, max_tf, min_length."""

    postings: DataFrame
    terms: DataFrame

    def of(self, asked: DataFrame) -> DataFrame:
        """Postings of a table of distinct terms; the partition filter comes from its hashes."""
        return self.postings.join(keys_of(asked), ["bucket", "term"], "left_semi")

    def frequencies(self, asked: DataFrame) -> DataFrame:
        """(term, df) of the asked terms that occur."""
        return self.terms.join(keys_of(asked), ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum("df").alias("df"))

    def sizes(self) -> tuple[Column, Column]:
        """Numbers of citations and of tokens, as scalar subqueries."""
        every = self.postings.filter((F.col("bucket") == bucket_of(F.lit(EVERY))) & (F.col("term") == EVERY))
        return every.agg(F.count("*").cast("double")).scalar(), every.agg(F.sum("length").cast("double")).scalar()


def read_index(spark, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"))


def build_index(citations: DataFrame, path: str | None = None, asked: DataFrame | None = None) -> TextIndex:
    """Write the index of (citation_id, province, doc_class, asset, content) below ``path`` and read it back. Null texts have no tokens.

    With ``asked``, a table of distinct terms, only these (and the term of all citations) are dealt and written: for one search.
    """
    path = path or scratch_path(citations.sparkSession, "text-index")
    tokens = F.coalesce(simple_tokens("content"), F.array().cast("array<string>"))
    rows = citations.select("citation_id", *SCOPE, "asset", F.concat(F.array(F.lit(EVERY)), tokens).alias("tokens"))
    postings = rows.mapInArrow(grouped_places, POSTINGS).withColumn("bucket", bucket_of("term"))
    if asked is not None:
        every = citations.sparkSession.range(1).select(F.lit(EVERY).alias("term"))
        postings = postings.join(materialise(asked.select("term").union(every), "indexed-terms"), "term", "left_semi")
    postings = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    postings.write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = citations.sparkSession.read.parquet(f"{path}/postings")
    terms = stored.groupBy("bucket", "term", *SCOPE).agg(F.count("*").alias("df"), F.max(F.size("positions")).alias("max_tf"), F.min("length").alias("min_length"))
    terms.write.parquet(f"{path}/terms")
    return read_index(citations.sparkSession, path)
