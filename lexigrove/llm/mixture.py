"""Problem 7: a mixture of sources with target shares of the tokens.

Tokens are summed by source, the repetition rate of each source follows from its
target, and every document comes ``floor(rate)`` times and once more if a seeded
hash of its id falls below the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.text import clean_source
from lexigrove.llm.tokenizer import DEFAULT_VOCABULARY, count_tokens
from lexigrove.session import release, stage

SEED = 20240


class Mixture:
    """A mixture of the documents of the sources in ``targets``.

    ``targets``: ``source``, ``target_share`` (shares of the mixed size, summing to
    1) and ``max_repeats``.  The mixed size is ``total_tokens``, by default the
    tokens of all listed sources with a share above 0.  A source's rate is its
    share of that size over its own tokens, at most ``max_repeats``: a source with
    too little text falls short, which the report shows.

    Sources are the same if they agree but for case and outer white space.
    Documents without a source or of an unlisted one, with a share of 0, and
    without a token don't come out.  A null or negative share or number of repeats
    counts as 0; a source listed twice counts once, with its greatest share.
    Repeated ids are drawn alike.  Other columns are ignored.  ``size`` is an
    expression that measures documents in something else than tokens.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, total_tokens: int | None = None, seed: int = SEED, size: Column | None = None) -> None:
        self.seed = seed
        source = clean_source(F.col("source")).alias("source")
        if size is None:
            sizes = count_tokens(documents.select("doc_id", source, "text"), "text", "n_tokens", vocabulary)
        else:
            sizes = documents.select("doc_id", source, F.coalesce(size, F.lit(0)).cast("long").alias("n_tokens"))
        self.sizes = stage(sizes, "sizes")
        wanted = targets.select(clean_source(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
        wanted = wanted.where("source IS NOT NULL").groupBy("source").agg(F.max_by("max_repeats", F.struct("target_share", "max_repeats")).alias("max_repeats"), F.max("target_share").alias("target_share"))
        there = self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
        plan = wanted.join(there, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
        self.plan = stage(plan, "plan")
        if total_tokens is None:
            total_tokens = self.plan.where("target_share > 0").agg(F.sum("tokens").alias("t")).first()["t"] or 0
        self.total_tokens = total_tokens
        rate = F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.lit(float(total_tokens)) / F.col("tokens"))).otherwise(0.0)
        self.rates = self.plan.withColumn("rate", rate)

    def counts(self) -> DataFrame:
        """``(doc_id, source, n_tokens, copies)`` of each document that is used."""
        rated = self.sizes.where("n_tokens > 0").join(self.rates.where("rate > 0").select("source", "rate"), "source")
        whole = F.floor("rate")
        # 52 bits of a digest that every engine has.
        digest = F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.col("doc_id").cast("string")))
        drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
        copies = whole + (drawn < F.col("rate") - whole).cast("long")
        return rated.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")

    def rows(self) -> DataFrame:
        """One row for each copy: ``(doc_id, source, n_tokens, copy_no)``, numbered from 1."""
        return self.counts().select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"))

    def close(self) -> None:
        """Delete the staged tables, once the results are written or collected."""
        release(self.sizes, self.plan)

    def report(self) -> DataFrame:
        """For each target: what there was, the rate, and the share reached."""
        reached = self.counts().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
        rows = stage(self.rates.join(reached, "source", "left").fillna(0, ["mixed_tokens", "most_copies"]), "report")
        mixed = rows.agg(F.sum("mixed_tokens").alias("t")).first()["t"] or 0
        share = F.when(F.lit(mixed) > 0, F.col("mixed_tokens") / F.lit(float(mixed))).otherwise(0.0)
        return rows.select("source", "target_share", "max_repeats", "n_docs", "tokens", F.round("rate", 9).alias("rate"), "mixed_tokens", "most_copies", F.round(share, 9).alias("share"))
