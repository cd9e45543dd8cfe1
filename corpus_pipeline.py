"""From raw documents to packed sequences, stage by stage.

Each stage takes the session, the rows that its predecessor kept and the folder of tables, and
works on all of them; its result is written as Parquet and read again for the next one. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.line_dedup import line_dedup
from siltstone.llm.mixing import mix_sources
from siltstone.llm.ngram_join import jaccard_components
from siltstone.llm.packing import pack
from siltstone.llm.quality import WORD, quality_rules
from siltstone.llm.queries import WEIGHTS, mix_levels, vocabulary
from siltstone.llm.scratch import Scratch
from siltstone.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicate documents share 80 of 100 of their five-word shingles.
NEAR = {"ngram": 5, "percent": 80}
#: Every leaf may give all that it has once, and the weights decide who gives up the rest.
MIX = {"percent": 90, "max_epochs": 1, "seed": 17}
SEQUENCE = {"end_id": 0, "capacity": 2048}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    A null or empty text has too few words and goes; repeated rows are judged alike; columns that
    are not those of documents are left out; an empty table stays empty.
    """
    return quality_rules(docs).filter("kept").select(*COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of line runs; documents of nothing else go.

    A null or empty text stays as it is, as nothing was cut from it. Rows with equal id and text are
    one document and get the same text; rows with a null id count as the earliest. ``n_chars`` is
    counted anew; an empty table stays empty.
    """
    cut = line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.filter((F.col("n_removed_lines") == 0) | F.col("text").rlike(WORD)).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, once.

    Of rows with equal ids the one with the smallest text stays. Rows with a null id are no
    duplicates of anything and stay. Wordless texts are no copies of each other. An empty table stays
    empty.
    """
    groups = jaccard_components(docs.select("doc_id", "text"), **NEAR)
    heads = groups.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(heads, "doc_id", "left_semi")
    once = named.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return once.unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents by target weights, each once at most.

    A null source or language is a name of its own; a null or wordless text costs nothing; rows with
    equal ids are in together or not at all; an empty table stays empty.
    """
    return mix_sources(docs, mix_levels(), WEIGHTS, **MIX).select(*COLUMNS)


def to_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences.

    A null text has the end id alone; rows with equal ids are separate documents; a null id stays
    null; an empty table gives no rows.
    """
    return pack(docs, vocabulary("word_bpe_49k.json"), **SEQUENCE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("line_dedup", cut_lines),
    ("ngram_jaccard_join", one_of_each),
    ("mix_sources", to_weights),
    ("best_fit_packing", to_sequences),
]

#: Hash order, fingerprints and token ids are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
