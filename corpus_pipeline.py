"""From raw documents to packed sequences: five stages, each one operator of the text subpackage over all it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import jaccard, language_id, packing, relative_parse, secrets
from driftline.llm.queries import tokenizer_path
from driftline.session import materialise


def _measured(docs: DataFrame) -> DataFrame:
    """Texts may have changed: their lengths follow."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, or others like them that no column has."""
    out = []
    for name in names:
        while name in docs.columns or name in out:
            name += "_"
        out.append(name)
    return tuple(out)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without a letter) go; all others stay as they are."""
    names = _free(docs, "held_out", "lang_pred", "score")
    found = language_id.identify(docs, language_id.gram_counts(docs), keep=True, names=names)
    return found.where(F.col(names[1]) != "und").select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows without an id all stay.

    A document is an id: rows of one id with different texts stay together, and of rows with the same id and text one
    stays, whichever comes first.
    """
    group = jaccard.similarity_components(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    names = _free(docs, "one", "two")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.join(materialise(group, "kept"), "doc_id", "left_semi")
    marked = marked.withColumns({names[0]: F.xxhash64(text), names[1]: F.xxhash64(F.lit(1), text, F.col("text").isNull())})
    return marked.dropDuplicates(["doc_id", *names]).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has too are cut out of the texts."""
    return _measured(relative_parse.remove_factors(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to their kind in brackets."""
    return _measured(secrets.redact(docs, secrets.train(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("substring dedup", cut_repeats),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: SQL can express neither the tokenizer nor the trained models; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialise(docs, f"stage{number}")
    return docs
