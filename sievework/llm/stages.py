"""The pipeline's stages: each takes (spark, docs, sf_dir) and returns a DataFrame, the last one with more columns than it was given.

None reads or changes a column by a name of its own: what a stage adds inside has a name that ``docs`` doesn't use, so columns of any
name come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import decontaminate, mixing, near_copies, quality_fm, sharding
from sievework.llm.common import fresh, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier gives less than 0.5. It is fitted on the labels of ``docs`` that aren't held out.

    Null and empty texts are scored as empty. Rows stay apart and are judged by text and length alone: repeated rows, and rows that
    agree in these, are all kept or all dropped, so there are no ties. A null id has no label, a null n_chars no metadata. Without labels every score is 0.5 and all
    rows stay. An empty table gives an empty one. Columns of any name come through.
    """
    meta, score = [quality_fm.length_class("n_chars")], fresh(docs, "score")
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"), meta=meta)
    return quality_fm.scored(docs, model, meta=meta, out=score).where(f"`{score}` >= 0.5").drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies, by op6's fingerprints and a similarity of 0.8 in five-word shingles. See ``near_copies.one_of_each``.

    The row with the least id stays, rows without id after all that have one, then the least text hash; of rows that agree in id and text any one. Null, empty
    and blank texts are one component. An empty table gives an empty one. Columns of any name come through.
    """
    return near_copies.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of the benchmark: ten consecutive words of an item, or the whole of a shorter one.

    Null and empty texts and texts without words hold none and stay, however many. Rows are judged each by its own text, so repeated rows go or stay together and there
    are no ties. Null ids matter to nothing. An empty benchmark drops nothing; an empty table gives an empty one. Columns of any name come through.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every document in as often as the mix takes it: not at all, once or twice.

    Null and empty texts have no words: taking them adds nothing to a source. A null source is a source, the last. Ties in the key go by id, then text; rows that
    agree in both are interchangeable and just as many are taken as the budget has room for. An empty table gives an empty one. Columns of any name come through.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the rows out to 16 shards of near equal bytes: the documents' columns, then size, text_crc32, law, shard, slot and grown_shard.

    Null text counts as empty (size 1). Equal texts, so repeated rows and documents that the mix took twice, share a shard, each row with a slot of its
    own. Ties in size go by the groups' hashes. An empty table gives an empty one. Columns of the input with one of the six names are replaced; all others come through.
    """
    return sharding.assign_shards(docs)
