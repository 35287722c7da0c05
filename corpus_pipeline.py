"""Corpus preparation as a chain of stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's input.
"""
from scangrid.llm import cotraining, mixing, packing, simhash, suffix_dedup
from scangrid.llm.common import Scratch, bounded_batches, table


def quality(spark, docs, sf_dir):
    """Documents that the co-trained classifier does not reject."""
    bounded_batches(spark)
    return cotraining.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of every group of texts linked by SimHash fingerprints or alike shingles of five words."""
    bounded_batches(spark)
    return simhash.one_of_each(docs)


def repeats(spark, docs, sf_dir):
    """Texts without strings of 400 bytes that occur elsewhere."""
    bounded_batches(spark)
    return suffix_dedup.remove_repeats(docs)


def mix(spark, docs, sf_dir):
    """Rows repeated so that languages meet their target weights; every row stays at least once."""
    bounded_batches(spark)
    return mixing.resampled(docs, table(spark, sf_dir, "labels"), budget="keep")


def pack(spark, docs, sf_dir):
    """Pieces of packed sequences with their token ids."""
    bounded_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats),
          ("mix", mix), ("pack", pack)]

#: The stages fit classifiers, so SQL cannot express them; tests use brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        following = scratch.write(stage(spark, docs, sf_dir))
        if i:
            scratch.drop(docs)
        docs = following
    return docs
