"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fingerprints, html_extract, jaccard, licenses, lmscore, mixing, packing, toxicity, urls

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary file lies, on every machine alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row of documents.  Null and empty texts have the score of a text without any vote; repeated rows score alike; an empty table gives an empty one."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each row and of its edited text.  Null texts are empty; rows of one doc_id follow each other by the digest of their text, null doc_ids come last; a document alone is its own next; an empty table gives an empty one."""
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each row whose vec_id is divisible by 50.  Null, zero and non-finite vectors and null ids take no part, ties go to the smaller vec_id, queries that share an id are answered each; an empty table gives an empty one."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page.  Null and empty pages have an empty text, null urls share a host; repeated rows stay; an empty table gives an empty one."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each piece of each row.  Null texts are a piece of the end id alone; equal rows are packed each on its own; an empty table gives an empty one."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each page.  Null urls and those without '://' have empty hosts and paths and are judged by the prior; of rules that fit the longest wins; repeated rows stay; an empty table gives an empty one."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each row.  Null and empty texts are linked with nothing; a row without a doc_id has the least doc_id of its component, null if there is none; repeated doc_ids keep their rows, each linked by its own text; an empty table gives an empty one."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each distinct doc_id (null is one); the texts of one doc_id are one document.  Documents without words have n_words 0 and a null score; an empty table gives an empty one."""
    return lmscore.score(_table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each row, in training order, and the position of its first copy (null if it isn't taken).  Null texts have size 0, a null source is a source; rows that are equal are taken one after the other; an empty table gives an empty one."""
    dealt = mixing.deal(_table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.round("position", 6).alias("position"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best licence of each distinct doc_id (null is one), null where nothing matches; ties go to the lesser name.  Null and empty texts match nothing; an empty table gives an empty one."""
    return licenses.scan(_table(spark, sf_dir, "documents"), windows=True).withColumn("dice", F.round("dice", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_fingerprints, op3_nearest, op4_html_text, op5_packing, op6_url_filter, op7_ngram_jaccard, op8_lm_score, op9_mixing, op10_licenses)}


def oracle_sql() -> dict[str, str]:
    return {"op8_lm_score": lmscore.SCORE_SQL, "op9_mixing": mixing.DEAL_SQL, "op10_licenses": licenses.scan_sql()}
